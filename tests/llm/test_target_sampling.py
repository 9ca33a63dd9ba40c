"""Target sampling against plain counts, one window at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridflow.llm import target_sampling
from gridflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(docs, targets):
    """doc_id: (n_features, weight, score, rank), as the contract says."""
    bucket = lambda s: zlib.crc32(s.encode()) % 10_000
    found = {k: windows(t) for k, t in docs}
    raw = Counter(bucket(f) for _, fs in found.values() for f in fs)
    good = Counter(bucket(f) for t in targets for f in windows(t)[1])
    whole_s, whole_t = sum(raw.values()), sum(good.values())
    gain = lambda b: math.floor(1000 * math.log((good[b] + 1) * (whole_s + 10_000) / ((raw[b] + 1) * (whole_t + 10_000))))
    out, able = {}, []
    for k, (words, fs) in found.items():
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{k}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[k] = [len(fs), weight, score, None]
        if len(words) >= 20:
            able.append((-score, k))
    for rank, (_, k) in enumerate(sorted(able)[: 25 * len(able) // 100], 1):
        out[k][3] = rank
    return {k: tuple(v) for k, v in out.items()}


def test_query_equals_plain_counts(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    targets = [t for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    rows = QUERIES["op11_target_sample"](spark, SF).collect()
    assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in rows} == plain(docs, targets)
    assert len(rows) == len(docs)


@given(st.lists(st.text(st.sampled_from("aZ09 _\x00\x7fé\x80日-"), max_size=90), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_windows_of_any_text(texts):
    found = target_sampling.Windows()
    bucket, doc, sizes = found.of(texts)
    for k, text in enumerate(texts):
        words, features = windows(text)
        assert sizes[k] == len(words)
        assert sorted(bucket[doc == k].tolist()) == sorted(zlib.crc32(f.encode()) % 10_000 for f in features)
        lowered = text.encode().lower().decode()
        assert [(w, (m.start(), m.end())) for w, m in zip(words, WORD.finditer(lowered))] == list(found.words(text))


@pytest.mark.parametrize("piece", [7, 64])
def test_long_texts_and_words(monkeypatch, piece):
    """Texts that are split in pieces, and words beyond the table of shifts."""
    text = " ".join(["a", "b" * 63, "c" * 64, "D" * 65, "é" * 200, "x1"] * 9)
    whole = [list(a) for a in (target_sampling.Windows().words(text),)]
    bucket = np.sort(target_sampling.Windows().of([text])[0]).tolist()
    monkeypatch.setattr(target_sampling, "PIECE", piece)
    assert [list(target_sampling.Windows().words(text))] == whole
    assert np.sort(target_sampling.Windows().of([text])[0]).tolist() == bucket == sorted(zlib.crc32(f.encode()) % 10_000 for f in windows(text)[1])


def test_edges(spark):
    """Nulls, empty and repeated rows, ties, clashing names, empty tables."""
    long = "the cat sat " * 30_000
    rows = [(1, "one two " * 15), (1, "one two " * 15), (None, "one two " * 15), (None, None), (2, None), (3, ""), (4, long), (5, "?!"), (6, "w " * 20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("_text", "weight", "rank", "_place", "score")})
    target = spark.createDataFrame([("one cat",), (None,), ("",)], "text string")
    got = target_sampling.sample_towards(docs, target, percent=80).collect()
    assert len(got) == len(rows)
    want = plain([(k, rows[k][1]) for k in range(len(rows))], ["one cat"])
    assert sorted((r.n_features, r.weight) for r in got) == sorted(v[:2] for v in want.values())
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == [1, 2, 3, 4] and all(r.n_words >= 20 for r in ranked)
    order = [(-r.score, r.doc_id is None, r.doc_id or 0) for r in ranked]
    assert order == sorted(order)
    twice = [r for r in got if r.doc_id == 1]
    assert twice[0].score == twice[1].score and twice[0]["rank"] != twice[1]["rank"]
    assert target_sampling.sample_towards(docs.limit(0), target).count() == 0
    assert target_sampling.sample_towards(docs, target.limit(0)).count() == len(rows)
    assert all(r["rank"] is None for r in target_sampling.sample_towards(docs, target, percent=0).collect())
