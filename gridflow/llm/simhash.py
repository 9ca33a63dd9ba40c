"""Near-duplicates by SimHash fingerprints, joined on a grid of segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridflow.llm import shingles
from gridflow.llm.common import hot_join, numbered, pinned, place_of, stored
from gridflow.llm.components import Forest, components

SEED = 42
WORDS = 4
DISTANCE = 4
BLOCKS = 7
SALTS = 256
TILE = 4096
SHINGLES = 1 << 15
PAIR_LOW = 0x5555555555555555


def fingerprint(text: str, width: int = WORDS, seed: int = SEED) -> int:
    """64 bits of a text: bit set when set in more than half the hashes of its word shingles."""
    import xxhash

    joined = b" ".join(words := text.encode().lower().split())  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    n = max(1, len(words) - width + 1)
    ends = ends[min(width, len(words)) - 1 :]
    one, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES):
        part = [one(joined[a:b], seed) for a, b in zip(starts[at : at + SHINGLES].tolist(), ends[at : at + SHINGLES].tolist())]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", uid: str | None = None) -> DataFrame:
    """Row number `_uid`, doc_id and fingerprint `fp` (bigint, the 64 bits) of every row.

    ASCII letters are lowered, words lie between ASCII white space, shingles have four words,
    repeats included; a shorter text is one shingle. Null text, and text without words, has
    fingerprint zero. Whole texts are read, hashes in pieces of SHINGLES.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            found = np.array([fingerprint(t.as_py() or "") for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["_uid", "doc_id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = numbered(df, uid).select("_uid", F.col(id_col).alias("doc_id"), F.col(text_col))
    return stored(rows.mapInArrow(run, f"_uid bigint, doc_id {kind}, fp bigint"), "fingerprints")


def counts_code(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each written in unary: 0, 1, 2 are 00, 01, 11.

    The Manhattan distance of two count vectors is the number of differing bits of their
    codes, and it never exceeds the number of differing bits of the fingerprints.
    """
    low = fp.bitwiseAND(F.lit(PAIR_LOW))
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(PAIR_LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def code_of(fps: np.ndarray) -> np.ndarray:
    one, low = np.uint64(1), np.uint64(PAIR_LOW)
    a, b = fps & low, (fps >> one) & low
    return (a | b) | ((a & b) << one)


def grid_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Masks of the grid: codes at Manhattan distance `distance` agree on one of these block sets."""
    edges = [round(k * 32 / blocks) for k in range(blocks + 1)]
    masks = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(masks, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def cells(fps: DataFrame, blocks: int, distance: int) -> DataFrame:
    """(cell, fp): the grid cells of each fingerprint, one per block set."""
    masks = [signed(m) for m in grid_masks(blocks, distance)]
    keys = [F.xxhash64(F.lit(k), F.col("_code").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)]
    return fps.select("fp", counts_code(F.col("fp")).alias("_code")).select("fp", F.explode(F.array(*keys)).alias("cell"))


def close(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Verified links: the Manhattan bound on segment counts first, then the fingerprints themselves."""
    near = np.bitwise_count(code_of(a) ^ code_of(b)) <= distance
    near[near] = np.bitwise_count((a ^ b)[near]) <= distance
    return near


def walk(fps: np.ndarray, tiles: np.ndarray, distance: int, forest: Forest) -> Iterator[tuple[int, int]]:
    """Links that join the fingerprints of a large cell, by breadth-first search over those not yet reached.

    In a dense cell each step reaches many, so the work is far below all pairs. When the cell
    is a pair of tiles, links inside one tile are left to that tile's own cell.
    """
    codes = code_of(fps)
    left = np.arange(len(fps))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            bound = np.bitwise_count(codes[left] ^ codes[i]) <= distance
            reach = left[bound]
            exact = np.bitwise_count(fps[reach] ^ fps[i]) <= distance
            if len(tiles):
                exact &= tiles[reach] != tiles[i]
            reach = reach[exact]
            if len(reach):
                bound[np.flatnonzero(bound)[~exact]] = False
                left = left[~bound]
                queue.extend(reach.tolist())
                here = int(fps[i])
                for there in fps[reach].tolist():
                    if forest.join(here, there):
                        yield here, there


def links_of_cells(distance: int, small: int = 24):
    """Arrow function over rows (cell, lo, hi, tile, fp) sorted by cell, lo, hi."""

    def flush(cell, lo, hi, tile, fps, forest) -> tuple[list[int], list[int]]:
        a, b = [], []
        new = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        size = np.diff(np.r_[new, len(cell)])
        group = np.repeat(np.arange(len(new)), size)
        few = (size <= small)[group]
        for lag in range(1, small):
            at = np.flatnonzero(few[lag:] & (group[lag:] == group[:-lag]))
            if not len(at):
                break
            at = at[close(fps[at], fps[at + lag], distance)]
            for x, y in zip(fps[at].tolist(), fps[at + lag].tolist()):
                if forest.join(x, y):
                    a.append(x), b.append(y)
        for k in np.flatnonzero(size > small).tolist():
            part = slice(new[k], new[k] + size[k])
            tiles = tile[part] if lo[new[k]] != hi[new[k]] else tile[:0]
            for x, y in walk(fps[part], tiles, distance, forest):
                a.append(x), b.append(y)
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, rest = Forest(), None

        def out(columns):
            a, b = flush(*columns, forest)
            both = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
            return pa.RecordBatch.from_arrays(both, names=["a", "b"])

        for batch in batches:
            got = [batch.column(k).to_numpy() for k in range(5)]
            got[4] = got[4].view(np.uint64)
            if rest is not None:
                got = [np.concatenate(x) for x in zip(rest, got)]
            if not len(got[0]):
                continue
            inside = (got[0] != got[0][-1]) | (got[1] != got[1][-1]) | (got[2] != got[2][-1])
            cut = int(inside.nonzero()[0][-1]) + 1 if inside.any() else 0
            rest = [x[cut:] for x in got]
            if cut:
                yield out([x[:cut] for x in got])
        if rest is not None:
            yield out(rest)

    return run


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect what fingerprints within `distance` bits connect.

    `fps` has distinct fingerprints. Their segment counts are points; a grid cell is a point's
    coordinates in `blocks - distance` of `blocks` blocks. Points at Manhattan distance up to
    `distance` differ in at most that many blocks, so they share a cell. Inside a cell the
    Manhattan bound, then the fingerprints decide. Cells give joining links only, never all
    pairs. Cells above `tile` points are cut into tiles, and every pair of tiles is a task's
    cell, so that no link is lost.
    """
    spread = cells(fps, blocks, distance)
    heavy = spread.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > tile)
    heavy = stored(heavy, "cells")
    if heavy.isEmpty():
        dealt = spread.select("cell", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("tile"), "fp")
    else:
        heavy = heavy.select("cell", F.ceil(F.col("_n") / tile).cast("int").alias("_t"))
        salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS))
        known = hot_join(spread, heavy, ["cell"], salt, "left")
        own = F.when(F.col("_t").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("_t")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_t"), F.lit(1)) - 1))
        dealt = known.withColumn("tile", own).withColumn("_other", other).select(
            "cell", F.least("tile", "_other").alias("lo"), F.greatest("tile", "_other").alias("hi"), "tile", "fp"
        )
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_cells = dealt.repartition(n, "cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    return sorted_cells.mapInArrow(links_of_cells(distance), "a bigint, b bigint")


def near_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, uid: str | None = None
) -> DataFrame:
    """One row per row of `df`: doc_id, fingerprint (16 hex digits), component_id, first, `_uid`.

    Rows whose fingerprints differ in at most `distance` bits are linked; component_id is the
    smallest doc_id that links reach, the row's own included, and `first` marks one row of
    each component: its smallest id, then row number. Null ids come last; a component of null
    ids only has component_id null. See `fingerprints` for null and empty texts. Repeated rows
    share a fingerprint; `uid` may name a column of row numbers. Other columns are ignored; an empty table gives an empty result.
    """
    rows = fingerprints(df, id_col, text_col, uid)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.col("_uid").alias("uid")))
    fps = stored(rows.groupBy("fp").agg(first.alias("_first")), "distinct")
    roots = components(links(fps.select("fp"), distance)).withColumnRenamed("node", "fp")
    fps = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = fps.groupBy("root").agg(F.min("_first").alias("_least"))
    known = hot_join(fps.select("fp", "root"), least, ["root"], F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    known = known.select("fp", "_least")
    return hot_join(rows, known, ["fp"], F.pmod(F.col("_uid"), F.lit(SALTS))).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("_least.id").alias("component_id"),
        (F.col("_least.uid") == F.col("_uid")).alias("first"), "_uid",
    )


def row_links(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect rows (uid, fp) with equal fingerprints, or with some within `distance` bits."""
    fps = stored(rows.groupBy("fp").agg(F.min("uid").alias("least")), "distinct")
    equal = hot_join(rows, fps, ["fp"], F.pmod(F.xxhash64("uid"), F.lit(SALTS))).filter("uid > least")
    near = links(fps.select("fp"), distance).join(fps.toDF("a", "_a"), "a").join(fps.toDF("b", "_b"), "b")
    near = near.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return near.unionByName(equal.select(F.col("least").alias("a"), F.col("uid").alias("b")))


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each component of near copies, columns unchanged.

    Near copies have Jaccard similarity 0.8 or more of their five-word shingles. Fingerprints of these
    shingles are joined on the grid, and each link is verified on the whole sets. Near copies may differ
    in 13 bits and more, which no grid carries, so `shingles` completes the links, without loss.
    """
    frame, names = pinned(df)
    dropped = shingles.copies(frame, *place_of(df, id_col, text_col), near=row_links)
    return shingles.narrowed(frame, dropped, "left_anti").select(*names)
