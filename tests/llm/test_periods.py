"""Periodic runs against every period of every stretch."""

import hashlib
import zlib
from fractions import Fraction

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridflow.llm import periods
from gridflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_runs(words):
    """(start, length, period): maximal stretches of each period, but for those of a smaller one."""
    found, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            stretch = words[start : start + length]
            smallest = all(stretch[p:] != stretch[:-p] for p in range(1, q))
            if length >= max(24, 3 * q) and smallest:
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    text = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(text.encode()).hexdigest(),
        hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


def test_query_equals_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    rows = {r[0]: tuple(r[1:]) for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(rows) == len(docs)
    small = [(k, t) for k, t in docs if len(t or "") < 6000]
    assert len(small) > 0.9 * len(docs)
    assert sum(rows[k][0] > 0 for k, _ in small) > 50
    for k, t in small:
        assert rows[k] == plain(k, t)


@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 30), st.integers(0, 3)), max_size=6), st.integers(1, 3), st.integers(0, 99))
@settings(max_examples=300, deadline=None)
def test_runs_of_any_words(parts, letters, seed):
    """Repeated blocks, some of them periodic themselves, broken in places; several texts together."""
    rng = np.random.default_rng(seed)
    texts = [[]]
    for size, times, odd in parts:
        texts[-1] += list(map(int, rng.integers(0, letters, size))) * times
        for _ in range(odd):
            if texts[-1]:
                texts[-1][int(rng.integers(len(texts[-1])))] = int(rng.integers(0, letters))
        if rng.random() < 0.4:
            texts.append([])
    for text, found in zip(texts, periods.search([[str(w).encode() for w in t] for t in texts])):
        assert sorted(found, key=lambda r: (r[0], r[2])) == plain_runs(text)


def test_deep_repeats():
    """Fibonacci words have many runs of close periods; all-equal and squared texts have deep levels."""
    a, b = "a", "ab"
    for _ in range(12):
        a, b = b, b + a
    block = list("abcdefghijklmnopqrstuvwxyz") * 2
    for text in (list(b), ["x"] * 5000, (["x"] * 30 + ["y"]) * 40, block + ["-"] + block * 3 + ["."] * 23, block[:24], block[:8] * 3, block[:8] * 3 + ["a", "c"]):
        assert sorted(periods.search([[w.encode() for w in text]])[0], key=lambda r: (r[0], r[2])) == plain_runs(text)


def test_groups_of_texts(spark, monkeypatch):
    """Texts searched one by one or together give the same rows; nulls, repeats, clashing names, empty tables."""
    rows = [(1, None), (2, ""), (None, "a b " * 40), (None, None), (3, "a b " * 40), (3, "a b " * 40), (4, " \t\x0b\n "), (5, "w " * 200_000), (6, "é é " * 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("_text", "_key", "start", "n_runs")})
    got = periods.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(tuple(r[1:]))
    assert by[3][0] == by[3][1] == by[None][0] and by[3][0][:5] == (1, 0, 80, 2, 40_000)
    assert by[1] == by[2] == by[4] and by[1][0][:5] == (0, None, None, None, None) and by[1][0][5:] == (hashlib.sha256(b"").hexdigest(),) * 2
    assert by[5][0][:5] == (1, 0, 200_000, 1, 200_000_000) and by[6][0][:5] == (1, 0, 30, 1, 30_000)
    planted = {(r.doc_id, r.runs_sha256) for r in periods.periodic_runs(docs, plant=True).collect()}
    assert (None, by[None][0][5]) in planted
    monkeypatch.setattr(periods, "TOGETHER", 1)
    assert sorted(map(str, periods.periodic_runs(docs).collect())) == sorted(map(str, got))
    assert periods.periodic_runs(docs.limit(0)).count() == 0
