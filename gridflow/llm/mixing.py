"""Mixing sources along a curriculum whose weights change over training time (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridflow.identity import with_row_number
from gridflow.llm.common import BLANKS, WORD, bucket_bits, numbered, pinned, place_of, run_of, running, stored

CYCLE = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
#: Weight of a source at times 0 and 1, by its place in CYCLE: heavy sources rise, light ones fall.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (0.5, 1.4), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)))


def source_targets(sizes: DataFrame, cycle=CYCLE, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Words each source gives: `sizes` (source, source_size) with weight, target and place in the cycle.

    Sources are few next to documents: one narrow row each. All share `share` of the total
    by weight. A source stops at `repeats` times its size and its excess is shared again
    by weight until no source is above. In order of size per weight the sources that stop
    come first, so one running sum finds the level at which the others share.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(ordered) - 1) % len(cycle)
    weights = F.array(*[F.lit(int(w)) for w in cycle])
    w = sizes.withColumn("place", place).withColumn("weight", F.element_at(weights, F.col("place") + 1))
    limit = F.col("source_size") * F.lit(float(repeats))
    filled = Window.orderBy(limit / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(
        Window.unboundedPreceding, -1
    )
    everything = Window.partitionBy(F.lit(0))
    spent = F.coalesce(F.sum("source_size").over(filled), F.lit(0)) * F.lit(float(repeats))
    used = F.coalesce(F.sum("weight").over(filled), F.lit(0))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - spent) / (
        F.sum("weight").over(everything) - used
    )
    w = w.withColumn("_level", level).withColumn("_stops", limit / F.col("weight") <= F.col("_level"))
    shared = F.max(F.when(~F.col("_stops"), F.col("_level"))).over(everything)
    target = F.when(F.col("_stops"), limit).otherwise(F.col("weight") * shared)
    return w.withColumn("target", target).drop("_level", "_stops")


def segments(knots) -> list[tuple]:
    """(t0, t1, w0, w1, area before) for each piece of a piecewise linear schedule of unit area."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append((t0, t1, w0 / area, w1 / area, done))
        done += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def position(share: Column, place: Column, schedules=SCHEDULES) -> Column:
    """Training time in 0..1 at which a source has given `share` of its words.

    The integral of a linear piece is a quadratic; its stable root is taken.
    """
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        time = F.lit(None).cast("double")
        for t0, t1, w0, w1, done in segments(knots):
            rest, slope = share - F.lit(done), (w1 - w0) / (t1 - t0)
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
            step = F.when(rest > 0, 2 * rest / (F.lit(w0) + root)).otherwise(F.lit(0.0))
            time = F.when(share >= F.lit(done), F.lit(t0) + F.least(step, F.lit(t1 - t0))).otherwise(time)
        out = F.when(place == k, time).otherwise(out)
    return out


def clock(position: Column, by_place: Column, schedules=SCHEDULES) -> Column:
    """Share of all words of the mix that training has read at a curriculum position.

    `by_place` holds the words of the sources of each schedule. At a position the sources stand
    to each other as words times scheduled weight; the sum of what each has given until then,
    over all words, is training time, on which these shares always add up to one.
    """
    given, total = F.lit(0.0), F.lit(0).cast("bigint")
    for k, knots in enumerate(schedules):
        area = F.lit(0.0)
        for t0, t1, w0, w1, _ in segments(knots):
            step = F.greatest(F.lit(0.0), F.least(position - F.lit(t0), F.lit(t1 - t0)))
            area = area + step * (F.lit(w0) + step * F.lit((w1 - w0) / (t1 - t0) / 2))
        given, total = given + F.get(by_place, F.lit(k)) * area, total + F.get(by_place, F.lit(k))
    return F.least(given / F.greatest(total, F.lit(1).cast("bigint")), F.lit(1.0))


def plan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    cycle=CYCLE, share: float = SHARE, repeats: int = REPEATS, schedules=SCHEDULES, uid: str | None = None,
) -> DataFrame:
    """What the mix asks of every row: doc_id, size, source_size, target, copies, `_uid`.

    A source's documents stand in the order of a hash of their id, as often as needed; the
    first `target` words of that row are taken, so the last document is taken in part.
    `copies` lists (repeat, words, position, time): the curriculum position at which the source's
    schedule, integrated, has asked for the middle of that copy, and the training time of that
    position: the share of all the mix's words that the schedules have asked for by then (see `clock`).

    Null text has no words. Null source is a source of its own, last by code point. A null
    id is ordered by row number instead; repeated ids by size and row number. Sources
    without words get target 0. `uid` may name a column of row numbers. Empty tables give an empty result; other columns are ignored.
    """
    if len(schedules) != len(cycle) or any(w <= 0 for k in schedules for _, w in k):
        raise ValueError("one schedule of positive weights for each weight of the cycle")
    rows = stored(
        numbered(df, uid).select(
            "_uid", F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("row"), F.col("_uid")))).alias("_order"),
        ),
        "mix",
    )
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    bits = bucket_bits(rows.count())
    head = F.conv(F.substring("_order", 1, 12), 16, 10).cast("bigint")
    rows = rows.withColumn("_source", key).withColumn("_bucket", F.shiftright(head, 48 - bits))
    sums = rows.groupBy("_source", "source", run_of(F.col("_uid")).alias("_run")).agg(F.sum("size").alias("_n"))
    sums = sums.groupBy("_source", "source").agg(F.sum("_n").alias("source_size"))
    targets = source_targets(sums, cycle, share, repeats).drop("source")
    whole = F.round("target").cast("bigint")
    everything = Window.partitionBy(F.lit(0))
    by_place = [F.sum(F.when(F.col("place") == k, whole).otherwise(F.lit(0))).over(everything) for k in range(len(cycle))]
    targets = targets.withColumn("_by_place", F.array(*by_place))
    order = [F.col("_order"), F.col("doc_id"), F.col("size"), F.col("_uid")]
    placed = running(rows, ["_source"], "_bucket", order, F.col("size"), "_start")
    # the target reaches documents through their buckets: a hot source has many of them
    spread = rows.select("_source", "_bucket").distinct().join(targets, "_source")
    placed = placed.join(spread, ["_source", "_bucket"])
    copies = []
    for k in range(repeats):
        start = F.col("_start") + k * F.col("source_size")
        words = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), whole - start))
        middle = (start + words / 2) / F.greatest(whole, F.lit(1))
        copies.append(
            F.struct(F.lit(k).alias("repeat"), words.alias("words"), position(middle, F.col("place"), schedules).alias("position"))
        )
    placed = placed.withColumn("copies", F.array(*copies))
    placed = placed.withColumn(
        "copies", F.transform("copies", lambda c: c.withField("time", clock(c["position"], F.col("_by_place"), schedules)))
    )
    return placed.select("doc_id", "size", "source_size", "target", "copies", "_uid")


def as_read(frame: DataFrame, asked: DataFrame, text: Column) -> DataFrame:
    """Every copy of the mix that has words, range-sorted by curriculum position: `frame` with `_copy` and its words as `_read`.

    `asked` has `_uid`, size and copies of a plan of `frame`. A copy taken in part keeps its first words, joined by one space.
    """
    taken = asked.select("_uid", F.col("size").alias("_size"), F.explode("copies").alias("_copy")).filter("_copy.words > 0")
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    first = F.array_join(F.slice(words, F.lit(1), F.col("_copy.words").cast("int")), " ")
    read = F.when(F.col("_copy.words") < F.col("_size"), first).otherwise(text)
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("_copy.position"), F.col("_uid"), F.col("_copy.repeat")]
    return frame.join(taken, "_uid").repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_read", read)


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    cycle=CYCLE, share: float = SHARE, repeats: int = REPEATS, schedules=SCHEDULES, uid: str | None = None,
) -> DataFrame:
    """What the mix takes of every row: doc_id, size, source_size, target, taken, copies, `_uid`.

    The copies that `plan` asks for are cut from their texts and put in reading order (see `as_read`), and
    the result is read from there: the words of a copy are counted in the text that the mix holds of it,
    `taken` is their sum, and `copies` (repeat, words, position, time, before) has the words that
    training reads before a copy, null for copies without words.

    `uid` may name a column of row numbers that hold when `df` is read again. Everything else is as in `plan`.
    """
    own = {"_c0": id_col, "_c1": text_col, "_c2": source_col} | ({"_uid": uid} if uid else {})
    frame = df.select(*[F.col(c).alias(k) for k, c in own.items()])
    frame = frame if uid else with_row_number(frame, "_uid")
    asked = stored(plan(frame, "_c0", "_c1", "_c2", cycle, share, repeats, schedules, "_uid"), "plan")
    held = as_read(frame.select("_uid", "_c1"), asked, F.col("_c1"))
    read = stored(
        held.select(
            "_uid", F.col("_copy.repeat").alias("repeat"),
            F.regexp_count("_read", F.lit(WORD)).cast("bigint").alias("words"), F.monotonically_increasing_id().alias("_place"),
        ),
        "read",
    )
    read = read.withColumn("_all", F.lit(0)).withColumn("_part", F.shiftright("_place", 33))
    read = running(read, ["_all"], "_part", [F.col("_place")], F.col("words"), "before")
    entry = F.struct("repeat", F.struct("words", "before"))
    read = read.groupBy("_uid").agg(F.map_from_entries(F.collect_list(entry)).alias("_read"))
    none = F.lit(0).cast("bigint")

    def found(c: Column) -> Column:
        own = F.try_element_at("_read", c["repeat"])
        return c.withField("words", F.coalesce(own["words"], none)).withField("before", own["before"])

    rows = asked.join(read, "_uid", "left").withColumn("copies", F.transform("copies", found))
    taken = F.aggregate("copies", none, lambda s, c: s + c["words"])
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies", "_uid")


def training_order(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """`df` as training reads it: rows repeated and range-sorted by curriculum position.

    Columns are unchanged. A copy taken in part keeps its first words, joined by one space.
    Rows that give no words to the mix are left out.
    """
    frame, names = pinned(df)
    asked = plan(frame, *place_of(df, id_col, text_col, source_col), uid="_uid", **options)
    ordered = as_read(frame, asked, F.col(*place_of(df, text_col)))
    return ordered.select(*[F.col("_read").alias(text_col) if c == text_col else name for c, name in zip(df.columns, names)])
