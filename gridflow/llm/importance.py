"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridflow.llm.common import stored

#: Buckets of the hashed n-grams of each order: of word forms, then of the words themselves.
FORM_BITS, WORD_BITS = (12, 12, 12), (16, 16)
BITS = FORM_BITS + WORD_BITS
#: Rows of the target: a sample of the good rows, bounded as it is sent to every task.
TARGET_ROWS = 20_000
#: A document's mean log ratio counts as that of this many n-grams: the weights' inverse temperature. Larger values
#: leave the noise no part, as a document of hundreds of n-grams is then either taken or not.
EVIDENCE = 4.0
#: n-grams of raw text that smooth the target model, and those that each used bucket of words adds.
SMOOTH = 500.0
SMOOTH_WORDS = 4.0
#: Log weight of a document without words.
NO_WORDS = -1000.0
SEED = 17
BATCH = 256
KNOWN_WORDS = 200_000
#: Longer tokens without spaces are cut into pieces of so many characters, each a word.
PIECE = 64
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shape(word: str) -> str:
    """Form of a word: runs of lower and upper case letters, digits and each other character become one sign."""
    out = ""
    for c in word:
        s = ("a" if c.islower() else "A") if c.isalpha() else "0" if c.isdigit() else c
        if not out.endswith(s):
            out += s
    return out


class Words(dict):
    """Hash of a word's form, and above it a hash of its letters and digits."""

    def __missing__(self, w: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        plain = w.rstrip(".,")
        if plain.isalpha() and len(plain) >= len(w) - 1:
            form = "a" if plain.islower() else "A" if plain.isupper() else "Aa" if plain.istitle() else shape(plain)
            form += w[len(plain) :]
        else:
            form = shape(w)
            plain = "".join(c for c in w if c.isalnum()) or w
        got = self[w] = zlib.crc32(form.encode()) | (zlib.crc32(plain.lower().encode()) >> 1) << 32
        return got


def words_of(text: str | None) -> list[str]:
    """Tokens between white space, long ones as successive pieces."""
    words = text.split() if text else []
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[k : k + PIECE] for w in words for k in range(0, len(w), PIECE)]


class Features:
    """Hashed n-grams of word forms, where a word that repeats the one before it is a form of its own, and of words."""

    def __init__(self):
        self.words = Words()

    def of(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order of BITS, the buckets of all n-grams and the text each belongs to."""
        words = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        doc = np.repeat(np.arange(len(words)), sizes)
        get = self.words.__getitem__
        table = np.fromiter((x for ws in words for x in map(get, ws)), np.int64, len(doc))
        forms, plain = (table & 0xFFFFFFFF).astype(np.uint64), table >> 32
        again = np.flatnonzero((plain[1:] == plain[:-1]) & (doc[1:] == doc[:-1])) + 1
        forms[again] += np.uint64(1 << 33)
        out = []
        for units, sizes in ((forms, FORM_BITS), (plain.astype(np.uint64), WORD_BITS)):
            for order, bits in enumerate(sizes, 1):
                n = max(0, len(units) - order + 1)
                h = np.zeros(n, np.uint64)
                for k in range(order):
                    h = (h ^ (units[k : k + n] + np.uint64(k + 1))) * np.uint64(MIX[k])
                    h ^= h >> np.uint64(29)
                inside = doc[:n] == doc[order - 1 : order - 1 + n]
                out.append(((h[inside] >> np.uint64(64 - bits)).astype(np.int64), doc[:n][inside]))
        return out


def log_ratios(target: list[np.ndarray], raw: list[np.ndarray]) -> list[np.ndarray]:
    """Per order, the log of the target model's probability over the raw model's, for every bucket."""
    out = []
    for k, (t, r) in enumerate(zip(target, raw)):
        p = (r + 1e-9) / (r.sum() + 1e-9 * len(r))
        smooth = SMOOTH + (SMOOTH_WORDS * np.count_nonzero(r) if k >= len(FORM_BITS) else 0)
        out.append(np.log((t + smooth * p) / (t.sum() + smooth)) - np.log(p))
    return out


def log_weights(texts: list[str | None], ratios: list[np.ndarray], features: Features) -> np.ndarray:
    """EVIDENCE times the sum over orders of a text's mean log ratio; NO_WORDS without words."""
    total = np.zeros(len(texts))
    found = features.of(texts)
    for (bucket, doc), ratio in zip(found, ratios):
        n = np.bincount(doc, minlength=len(texts))
        total += np.bincount(doc, ratio[bucket], len(texts)) / np.maximum(n, 1)
    words = np.bincount(found[0][1], minlength=len(texts))
    return np.where(words > 0, EVIDENCE * total, NO_WORDS)


def good_ids(labels: DataFrame, id_col: str, bound: int) -> DataFrame:
    """At most `bound` ids of good rows, those with the smallest hashes."""
    good = labels.filter("quality = 1").select(F.col(id_col).alias("_good")).dropna().distinct()
    n = good.count()
    hashed = good.withColumn("_h", F.pmod(F.xxhash64(F.lit(SEED), "_good"), F.lit(1 << 30)))
    likely = hashed.filter(F.col("_h") < min(1.0, 1.3 * bound / max(n, 1)) * (1 << 30))
    return likely.orderBy("_h", "_good").limit(bound).select("_good")


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, bound: int) -> list[np.ndarray] | None:
    """Log ratios of target and raw n-gram models; None without good rows.

    The raw model counts every n-gram of every text, summed in each task and then by bucket.
    The target model counts the texts of at most `bound` good rows.
    """
    good = good_ids(labels, id_col, bound)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    marked = rows.join(F.broadcast(good), rows["_id"] == good["_good"], "left").select(F.col("_good").isNotNull(), "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        raw, target = ([np.zeros(1 << b, np.int64) for b in BITS] for _ in range(2))
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                isgood = np.array(part.column(0).to_pylist(), bool)
                for k, (bucket, doc) in enumerate(features.of(part.column(1).to_pylist())):
                    raw[k] += np.bincount(bucket, minlength=len(raw[k]))
                    target[k] += np.bincount(bucket[isgood[doc]], minlength=len(raw[k]))
        for k in range(len(BITS)):
            at = np.flatnonzero(raw[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(raw[k][at]), pa.array(target[k][at])],
                names=["k", "bucket", "raw", "target"],
            )

    counted = marked.mapInArrow(count, "k int, bucket bigint, raw bigint, target bigint")
    raw, target = ([np.zeros(1 << b) for b in BITS] for _ in range(2))
    for r in counted.groupBy("k", "bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r.k][r.bucket], target[r.k][r.bucket] = r.raw, r.target
    return log_ratios(target, raw) if target[0].sum() else None


def weighted(rows: DataFrame, text_col: str, ratios: list[np.ndarray]) -> DataFrame:
    """`rows` with `log_weight` in place of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(ratios)
    others = [f for f in rows.schema.fields if f.name not in (text_col, "log_weight")]
    names = [f.name for f in others]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                w = log_weights(part.column(len(names)).to_pylist(), shared.value, features)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(w)], names=[*names, "log_weight"])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "log_weight double"])
    return rows.select(*[F.col(f"`{n}`") for n in names], F.col(text_col)).mapInArrow(weigh, kinds)


def kth_largest(rows: DataFrame, value: str, k: int) -> float:
    """The k-th largest of a column, by counting bins and refining the bin that holds it."""
    span = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).first()
    if k <= 0 or not span.n:
        return float("inf")
    if k >= span.n:
        return span.lo
    lo, hi, left, bins = span.lo, span.hi, k, 4096
    while True:
        # values below lo or above hi are settled; `left` counts from hi downwards
        step = (hi - lo) / bins
        inside = rows.filter((F.col(value) >= lo) & (F.col(value) <= hi))
        if step <= 0 or lo + step == lo:
            return lo
        bin_of = F.least(F.floor((F.col(value) - lo) / step), F.lit(bins - 1)).alias("bin")
        found = inside.groupBy(bin_of).agg(
            F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")
        ).collect()
        for b in sorted(found, key=lambda r: -r.bin):
            if left <= b.n:
                break
            left -= b.n
        if b.lo == b.hi or left == b.n:
            return b.lo
        lo, hi = b.lo, b.hi


def gumbel(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise from a hash of the id."""
    u = (F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


class Resampler:
    """A fitted sampler: log ratios of the two models, the cut key, and how many rows it takes."""

    def __init__(self, ratios: list[np.ndarray] | None, cut: float, size: int, seed: int = SEED):
        self.ratios, self.cut, self.size, self.seed = ratios, cut, size, seed

    def shown(self) -> list[np.ndarray]:
        return self.ratios or [np.zeros(1 << b) for b in BITS]

    def keyed(self, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return weighted(rows, text_col, self.shown()).withColumn("key", F.col("log_weight") + gumbel(id_col, self.seed))


def break_even(scored: DataFrame, labels: DataFrame, id_col: str, bound: int) -> float:
    """Log weight that best parts good from bad rows, on at most `bound` labelled rows of each kind.

    The middle between the neighbouring weights at the cut with the highest balanced accuracy.
    Without rows of both kinds every row with words is above it.
    """
    known = labels.filter("quality in (0, 1)").select(F.col(id_col).alias("_lid"), "quality").dropna()
    known = known.groupBy("_lid").agg(F.min("quality").alias("quality"))
    n = max([r["count"] for r in known.groupBy("quality").count().collect()], default=0)
    h = F.pmod(F.xxhash64(F.lit(SEED + 2), "_lid"), F.lit(1 << 30))
    known = known.filter(h < min(1.0, bound / max(n, 1)) * (1 << 30))
    rows = scored.join(F.broadcast(known), F.col("doc_id") == F.col("_lid")).select("quality", "log_weight")
    rows = np.array([(r.log_weight, r.quality) for r in rows.collect()]).reshape(-1, 2)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    good = rows[:, 1] == 1
    if good.all() or not good.any():
        return NO_WORDS / 2
    bad_below = np.cumsum(~good) / (~good).sum()
    good_above = 1 - np.cumsum(good) / good.sum()
    best = (bad_below + good_above)[:-1] if len(rows) > 1 else np.zeros(1)
    top = np.flatnonzero(best >= best.max() - 1e-12)
    return float((rows[top[0], 0] + rows[min(top[-1] + 1, len(rows) - 1), 0]) / 2)


def resample(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int | None = None,
    target_rows: int = TARGET_ROWS, seed: int = SEED,
) -> tuple[DataFrame, Resampler]:
    """One row per row of `df` (doc_id, log_weight, key, kept) and the fitted sampler.

    `labels` has the ids and `quality` (1 good, 0 bad, null unknown). A text's log weight is the
    mean log ratio, per order of n-gram of word forms and of lower-cased words, of a model of
    good texts and a model of all texts. The sample are the `rows` largest sums of log weight and Gumbel noise, which is sampling
    without replacement in proportion to the weights: a row of log weight w is taken with
    probability 1 - exp(-exp(w - cut)). By default `rows` is the number of
    texts above the weight that best parts the labelled good from the bad. At most
    `target_rows` labelled rows of a kind are used; all counts, weights and the cut cover
    all rows.

    A token above PIECE characters, as in text without spaces, counts as its successive pieces.
    Null and empty texts have the least weight, NO_WORDS, and are kept only if `rows` asks
    for all. Noise is a hash of the id, so reruns agree; rows with a null id share their
    noise, and so do repeated rows, which stand or fall together: ties with the last row
    of the sample are all kept. Without good labels all weights are equal. Other columns
    are ignored; an empty table gives an empty result.
    """
    ratios = fit(df, labels, id_col, text_col, target_rows)
    sampler = Resampler(ratios, float("-inf"), 0, seed)
    narrow = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    scored = stored(sampler.keyed(narrow, "doc_id", "_text"), "weights")
    if rows is None:
        edge = break_even(scored, labels, id_col, target_rows)
        rows = scored.filter(F.col("log_weight") > edge).count()
    sampler.cut, sampler.size = kth_largest(scored, "key", rows), rows
    return scored.withColumn("kept", F.col("key") >= sampler.cut), sampler


def keep_sample(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The sampled rows of `df`, columns unchanged: weights are computed again as the rows pass, without a shuffle."""
    _, sampler = resample(df, labels, id_col, text_col, **options)
    width, text, cut = len(df.columns), df.columns.index(text_col), sampler.cut
    shared = df.sparkSession.sparkContext.broadcast(sampler.shown())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                w = log_weights(part.column(text).to_pylist(), shared.value, features)
                part = part.filter(pa.array(w + part.column(width).to_numpy() >= cut))
                yield pa.RecordBatch.from_arrays(part.columns[:width], names=names)

    names = df.columns
    frame = df.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(names)])
    noised = frame.withColumn("_noise", gumbel(f"_c{names.index(id_col)}", sampler.seed))
    return noised.mapInArrow(keep, df.schema)
