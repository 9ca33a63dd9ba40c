"""Importance resampling towards a target table: hashed word windows, gains per bucket, Gumbel top-k.

Words and their offsets come from an untrained regular-expression split over ASCII-lowered
text. Windows over one offset or two neighbouring ones are the features; their CRC-32 picks
a bucket. The CRC of a joined pair is put together from those of its words, so no pair is
ever built as a string.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridflow.llm.common import in_order, stored

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
PERCENT, MIN_WORDS, SEED = 25, 20, 7
BATCH = 128
KNOWN_WORDS = 300_000
#: Characters of a text that are split at a time, cut between two words.
PIECE = 1 << 20
#: Longest word, in bytes, whose shift of a CRC is kept as a table.
TABLE_BYTES = 64
#: Parts of the draw's 32-bit noise.
NOISE = 4294967296.0


def zero_shifts(longest: int = TABLE_BYTES) -> np.ndarray:
    """[n, byte place, byte]: what a CRC-32 becomes when n zero bytes follow, byte by byte (the map is linear)."""
    v = np.arange(256, dtype=np.uint64)
    table = v.copy()
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint64(0xEDB88320), table >> 1)
    now = np.stack([v << np.uint64(8 * b) for b in range(4)])
    out = [now]
    for _ in range(longest):
        now = (now >> np.uint64(8)) ^ table[(now & 255).astype(np.int64)]
        out.append(now)
    return np.array(out)


class Windows(dict):
    """Splits texts and hashes their windows. As a dictionary it gives a word's CRC-32 and, above it, its bytes."""

    def __init__(self, pattern: str = PATTERN, buckets: int = BUCKETS):
        from tokenizers import Regex, pre_tokenizers

        super().__init__()
        self.split = pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True)
        self.buckets, self.shifts = buckets, zero_shifts()

    def __missing__(self, word: str) -> int:
        data = word.encode()
        got = zlib.crc32(data) | len(data) << 32
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = got
        return got

    def words(self, text: str | None) -> list[tuple[str, tuple[int, int]]]:
        """Words with their offsets in the lowered text; long texts go through the split in pieces."""
        lowered = (text or "").encode().lower().decode()  # bytes: lower() knows ASCII only
        if len(lowered) <= PIECE:
            return self.split.pre_tokenize_str(lowered)
        out, at = [], 0
        while at < len(lowered):
            end = min(len(lowered), at + PIECE)
            while end < len(lowered) and (lowered[end] > "\x7f" or lowered[end].isalnum()):
                end += 1  # never inside a word
            out += [(word, (at + a, at + b)) for word, (a, b) in self.split.pre_tokenize_str(lowered[at:end])]
            at = end
        return out

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all windows, the text each belongs to, and the number of words of each text."""
        found = [[self[word] for word, _ in self.words(t)] for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        doc = np.repeat(np.arange(len(found)), sizes)
        packed = np.fromiter((x for f in found for x in f), np.int64, len(doc))
        crc, n = (packed & 0xFFFFFFFF).astype(np.uint64), packed >> 32
        first = np.flatnonzero(doc[1:] == doc[:-1])
        pairs = self.joined(crc[first], crc[first + 1], n[first + 1])
        return np.r_[crc, pairs] % np.uint64(self.buckets), np.r_[doc, doc[first]], sizes

    def shift(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The CRCs with n zero bytes behind them."""
        out, left = crc, n.copy()
        while True:
            step = np.minimum(left, TABLE_BYTES)
            new = np.zeros_like(out)
            for b in range(4):
                new ^= self.shifts[step, b, (out >> np.uint64(8 * b)).astype(np.int64) & 255]
            out, left = new, left - step
            if not left.any():
                return out

    def joined(self, one: np.ndarray, two: np.ndarray, two_bytes: np.ndarray) -> np.ndarray:
        """CRC-32 of two words joined by one space, from the CRCs of the words."""
        space = np.uint64(zlib.crc32(b" "))
        spaced = self.shift(one, np.ones(len(one), np.int64)) ^ space
        return self.shift(spaced, two_bytes) ^ two


def windows(df: DataFrame, id_col: str | None, text_col: str, buckets: int = BUCKETS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_words and the buckets of all windows of every whole text, as little-endian 32-bit numbers; written.

    Texts are split once; counts and weights come from the buckets.
    """
    rows = df.select((F.col(id_col) if id_col else F.lit(None).cast("bigint")).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Windows(pattern, buckets)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                bucket, doc, words = known.of(part.column(1).to_pylist())
                order = np.argsort(doc, kind="stable")
                ends = np.cumsum(np.bincount(doc, minlength=part.num_rows))
                kept = [x.astype("<u4").tobytes() for x in np.split(bucket[order], ends[:-1])]
                columns = [part.column(0), pa.array(words), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "buckets"])

    return stored(rows.mapInArrow(cut, f"doc_id {kind}, n_words bigint, buckets binary"), "windows")


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bucket numbers of a column of windows, and how many each row has."""
    rows = [np.frombuffer(x.as_buffer(), "<u4") for x in column]
    return np.concatenate([np.zeros(0, np.uint32), *rows]), np.fromiter(map(len, rows), np.int64, len(rows))


def histogram(cut: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Windows in each bucket: summed inside tasks, then by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(laid_out(batch.column(0))[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = cut.select("buckets").mapInArrow(count, "bucket bigint, n bigint")
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target over its share of the source."""
    n, whole_s, whole_t = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * (whole_s + n) / ((s + 1.0) * (whole_t + n)))) for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def weights(cut: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row: the floored mean gain of its windows."""
    shared = cut.sparkSession.sparkContext.broadcast(gain)
    kind = cut.schema["doc_id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, n = laid_out(batch.column(2))
            total = np.zeros(len(n), np.int64)
            np.add.at(total, np.repeat(np.arange(len(n)), n), shared.value[bucket])
            columns = [*batch.columns[:2], pa.array(n), pa.array(total // np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return cut.mapInArrow(weigh, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def sample_towards(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, pattern: str = PATTERN,
) -> DataFrame:
    """One row per row of `df`: doc_id, n_words, n_features, weight, score, rank.

    A text's features are its words and pairs of neighbouring words, repeats counted, in
    `buckets` by CRC-32. A bucket's gain compares its share of the target table with its
    share of `df`, both counted over all whole texts; weight is the floored mean gain.
    score adds thousandths of Gumbel noise drawn from SHA-256 of `seed` and id. Of the rows
    with at least `min_words` words the `percent` % with the highest scores are drawn, which
    is sampling without replacement in proportion to the weights; they are ranked from 1,
    all others have rank null. Ties go to the smaller id.

    Null and empty texts have no words, weight 0, and are never drawn while `min_words` is
    positive. A null id draws its noise as an empty one and comes last among ties; repeated
    rows share weight and score and have ranks of their own. Other columns are ignored,
    whatever their names; empty tables give an empty result, an empty target gain by
    smoothing only.
    """
    cut = windows(df, id_col, text_col, buckets, pattern)
    gain = gains(histogram(cut, buckets), histogram(windows(target, None, target_col, buckets, pattern), buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(NOISE))))
    scored = weights(cut, gain).withColumn("score", (F.col("weight") + noise).cast("bigint"))
    scored = stored(scored, "scores")
    able = F.col("n_words") >= min_words
    drawn = scored.filter(able).count() * percent // 100
    order = [(~able).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    rank = F.when(F.col("_place") < drawn, F.col("_place") + 1)
    return in_order(scored, order).select("doc_id", "n_words", "n_features", "weight", "score", rank.cast("bigint").alias("rank"))
