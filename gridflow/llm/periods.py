"""Periodic runs of words by a dictionary of basic factors.

Level k names every stretch of 2**k words, equal names for equal stretches, from the pair of
names of its halves. A run of period q repeats each of its stretches of 2**k >= q words at
distance q, and no sooner. So at the level with 2**k / 2 < q <= 2**k the next occurrences at
equal distance, one word after the other, form a progression that proposes the period q, and
extending it to both sides gives the run. Only stretches that occur again take part in higher
levels, so levels shrink fast on ordinary text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run is at least this many words, and at least this many periods, long.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of texts that are searched together, whole texts always.
TOGETHER = 1 << 18
KINDS = "doc_id {}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def successors(name: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense new names of the positions `where`, distance to the next equal name (0: none), and whether it occurs twice."""
    order = np.argsort(name, kind="stable")  # positions rise, so equal names stay in text order
    new = np.r_[True, name[order][1:] != name[order][:-1]]
    dense, gap = np.empty(len(name), np.int64), np.zeros(len(name), np.int64)
    dense[order] = np.cumsum(new) - 1
    same = np.flatnonzero(~new)
    gap[order[same - 1]] = where[order[same]] - where[order[same - 1]]
    again = np.zeros(len(name), bool)
    again[order[same]] = again[order[same - 1]] = True
    return dense, gap, again


def runs_of(words: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All runs (start, length, period) of texts laid end to end; starts are places in `words`.

    `words` are numbers, equal for equal words; `doc` is the text of each word and `first`
    the place where each text starts, with the number of all words at the end.
    """
    n = len(words)
    found, size = [], 1
    if not n:
        return np.zeros((0, 3), np.int64)
    where = np.arange(n)
    dense, gap, again = successors(words * len(first) + doc, where)
    name = np.full(n, -1, np.int64)
    while True:
        fit = np.flatnonzero((2 * gap > size) & (gap <= size))
        if len(fit):
            at, period = where[fit], gap[fit]
            new = np.r_[True, (np.diff(at) != 1) | (period[1:] != period[:-1]) | (doc[at[1:]] != doc[at[:-1]])]
            ends = np.r_[np.flatnonzero(new)[1:], len(at)] - 1
            found.append(np.stack([at[new], at[ends] - at[new] + size + period[new], period[new]], axis=1))
        name[where] = np.where(again, dense, -1)
        # halves that both occur again, inside one text: the stretches of the next level
        here = where[again]
        here = here[here + 2 * size <= first[doc[here] + 1]]
        here = here[name[here + size] >= 0]
        if not len(here):
            break
        pair = name[here] * n + name[here + size]
        name[where] = -1
        where, size = here, 2 * size
        dense, gap, again = successors(pair, where)
    if not found:
        return np.zeros((0, 3), np.int64)
    return np.unique(extended(np.concatenate(found), words, doc), axis=0)


def extended(runs: np.ndarray, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Long enough runs, grown to both sides while the period holds inside the text."""
    runs = runs[runs[:, 1] >= np.maximum(LEAST_WORDS, LEAST_PERIODS * runs[:, 2])].copy()
    for run in runs:
        start, end, period = run[0], run[0] + run[1], run[2]
        while start > 0 and doc[start - 1] == doc[start] and words[start - 1] == words[start - 1 + period]:
            start -= 1
        while end < len(words) and doc[end] == doc[end - 1] and words[end] == words[end - period]:
            end += 1
        run[0], run[1] = start, end - start
    return runs


def planted(words: list[bytes], key: int) -> list[bytes]:
    """The words, made periodic from a place on for one key in ten, as the query's contract says."""
    g, n = key // 10, len(words)
    if key % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def most_periods(one: tuple[int, int, int], other: tuple[int, int, int]) -> int:
    """Order of runs by exact length over period, largest first, then by start and period."""
    by = other[1] * one[2] - one[1] * other[2]
    return by or one[0] - other[0] or one[2] - other[2]


def digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """Result columns of one text from its words and its runs."""
    keep = np.ones(len(words) + 1, np.int64)
    if runs:
        keep[:] = 0
        for start, length, period in runs:
            keep[start + period] += 1
            keep[start + length] -= 1
        inside = np.cumsum(keep)[: len(words)]
        kept = [w for w, x in zip(words, inside.tolist()) if not x]
    else:
        kept = words
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2])))
    best = min(runs, key=cmp_to_key(most_periods)) if runs else (None, None, None)
    exponent = 1000 * best[1] // best[2] if runs else None
    return (
        len(runs), *best, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


def search(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each list of words, searched together."""
    numbers = Numbers()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.fromiter((x for t in texts for x in map(numbers.__getitem__, t)), np.int64, int(sizes.sum()))
    doc, first = np.repeat(np.arange(len(texts)), sizes), np.r_[0, np.cumsum(sizes)]
    found = runs_of(words, doc, first)
    out: list[list] = [[] for _ in texts]
    for k, (s, n, p) in zip(doc[found[:, 0]].tolist() if len(found) else (), found.tolist()):
        out[k].append((s - int(first[k]), n, p))
    return out


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """One row per row of `df`: doc_id, n_runs, the run of most periods, and digests of runs and of the collapsed text.

    Words lie between ASCII white space. A run is a stretch of words of smallest period q, at
    least LEAST_WORDS words and LEAST_PERIODS periods long, that no neighbouring word extends.
    start, length, period and exponent_milli (thousandths of length over period, rounded
    down) are those of the run with the most periods, ties to the smaller start, then period;
    null without runs. runs_sha256 covers all runs, collapsed_sha256 the words that no run
    holds after its first period, joined by one space. With `plant` one id in ten is made
    periodic first (see `planted`).

    Whole texts are searched, in groups of at least TOGETHER words; rows are not moved. Null
    and empty texts have no words and no runs; a null id is planted nothing. Repeated rows
    get equal results; other columns are ignored, whatever their names; an empty table gives
    an empty result.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("_key"), F.col(text_col).alias("_text"))
    kinds = KINDS.format(df.schema[id_col].dataType.simpleString())
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
            columns = list(zip(*map(digest, texts, search(texts))))
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.string()) for c in columns[5:]]
            return pa.RecordBatch.from_arrays([ids, *arrays], names=names)

        for batch in batches:
            texts, size, at = [], 0, 0
            for k in range(batch.num_rows):
                words = (batch.column(2)[k].as_py() or "").encode().split()  # bytes: ASCII white space only
                key = batch.column(1)[k].as_py()
                if plant and key is not None:
                    words = planted(words, zlib.crc32(key.encode()))
                texts.append(words)
                size += len(words)
                if size >= TOGETHER:
                    yield out(batch.column(0).slice(at, len(texts)), texts)
                    texts, size, at = [], 0, k + 1
            if texts:
                yield out(batch.column(0).slice(at, len(texts)), texts)

    return rows.mapInArrow(run, kinds)
