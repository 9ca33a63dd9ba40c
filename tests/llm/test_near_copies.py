"""The near-copy stage against brute-force Jaccard similarity of five-word shingles."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from gridflow.llm import shingles, simhash
from gridflow.llm.components import components

SF = "/root/testdata/sf0.01"


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def survivors(rows):
    """Ids of the smallest of each component of links at 0.8 or more, by comparing all pairs."""
    ids, sets = zip(*sorted((k, plain_shingles(t)) for k, t in rows))
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(ids)), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {ids[k] for k in range(len(ids)) if root(k) == k}


def test_stage_on_documents(spark):
    """Pairs of these documents at 0.8 differ in up to nine bits, and one at four bits is below 0.8."""
    docs = simhash_input(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = survivors(rows)
    assert len(want) < len(rows)
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()} == want


def simhash_input(spark):
    return corpus_pipeline.stored(corpus_pipeline.exact_copies(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF), "test")


@pytest.mark.parametrize("tile", [8, 4096])
def test_links_of_groups_chains_and_common_lines(spark, tile, monkeypatch):
    """Groups, chains, texts around 0.8, texts of one common line, short ones; shingles in many tiles."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(shingles, "COMMON", 50)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    texts = []
    for size in (12, 40, 200):
        base = word(size)
        for k in range(60):
            one = list(base)
            for at in rng.integers(0, size, rng.integers(0, 1 + size // 20)):
                one[at] = word(1)[0]
            texts.append(one)
    chain = word(60)
    for _ in range(30):
        chain = [*chain[3:], *word(3)]
        texts.append(chain)
    line = word(20)
    for n in range(0, 30):
        texts += [[*line, *word(n)], [*word(n), *line]]
    texts += [word(3), ["a"], ["a", "b"], ["a"] * 50, ["a"] * 70, [], word(2), ["A", "b"]]
    order = rng.permutation(len(texts))
    rows = [(int(k), " ".join(texts[at])) for k, at in enumerate(order)]
    frame, _ = shingles_frame(spark, rows)
    dropped = {r._uid for r in shingles.copies(frame, "_c0", "_c1", tile).collect()}
    kept = {r._c0 for r in frame.collect() if r._uid not in dropped}
    assert kept == survivors(rows)


def shingles_frame(spark, rows):
    return simhash.pinned(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))


def test_groups_below_the_limit_stay_linear(spark, monkeypatch):
    """Rows of one base whose pairs lie around 0.8: no working table grows with the square of the group."""
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 120)]
    rows = []
    for k in range(300):
        one, at = list(base), int(rng.integers(0, 110))
        one[at : at + 9] = [f"x{x}" for x in rng.integers(0, 1 << 40, 9)]
        rows.append((k, " ".join(one)))
    counts, stored = {}, shingles.stored

    def counted(df, name):
        out = stored(df, name)
        counts[name] = max(out.count(), counts.get(name, 0))
        return out

    monkeypatch.setattr(shingles, "stored", counted)
    frame, _ = shingles_frame(spark, rows)
    dropped = {r._uid for r in shingles.copies(frame, "_c0", "_c1").collect()}
    assert {r._c0 for r in frame.collect() if r._uid not in dropped} == survivors(rows)
    counts.pop("meetings")  # rows by their cells
    assert max(counts.values()) <= 24 * len(rows), counts


def test_open_pairs_are_linear():
    """Every pair of a cell is open: the links are one fewer than the rows, in small and large cells and between tiles."""
    rng = np.random.default_rng(2)
    for n in (9, 400):
        bits = [rng.integers(0, 1 << 62, 8).astype(np.uint64)] * n
        size, own = np.full(n, 500), np.arange(n)
        assert len(list(shingles.near_in_cell(size, own, own, own[:0], bits))) == n - 1
        assert len(list(shingles.near_in_cell(size, own, own, own % 2, bits))) == n - 1
        rows = pa.record_batch([pa.array(np.zeros(n, np.int64))] * 3 + [pa.array(x) for x in (own, size, own, own, own % 2)] + [pa.array([b.view(np.int64) for b in bits])], names=[*"cpqusrlmb"])
        assert sum(b.num_rows for b in shingles.links_of_cells(iter([rows, rows]))) == n - 1


def test_fingerprints_propose_links(spark):
    """Rows with fingerprints within four bits are connected, others are not; the stage takes its proposals from them."""
    rng = np.random.default_rng(4)
    fps = rng.integers(-(1 << 63), 1 << 63, 60, np.int64).tolist()
    for f in fps[:40]:
        for _ in range(3):
            bits = rng.choice(63, int(rng.integers(0, 7)), replace=False)
            fps.append(f ^ sum(1 << int(b) for b in bits))
    up = list(range(len(fps)))

    def root(x):
        return x if up[x] == x else root(up[x])

    for a, b in combinations(range(len(fps)), 2):
        if ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= simhash.DISTANCE:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    rows = spark.createDataFrame(list(enumerate(fps)), "uid bigint, fp bigint")
    got = {r.node: r.root for r in components(simhash.row_links(rows)).collect()}
    assert {k: got.get(k, k) for k in range(len(fps))} == {k: root(k) for k in range(len(fps))}
    assert shingles.fingerprint(np.array([3, 1, -1], np.int64)) == 3
