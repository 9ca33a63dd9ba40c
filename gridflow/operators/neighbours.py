"""Exact nearest-neighbour joins in feature space.

Two plans give the same result:

* The base table is proven small (its bytes are counted up to a bound): it is broadcast
  and each query batch is compared with it in place. The query table is not shuffled, but
  for bases of DEALT_ROWS rows and more dealt evenly to tasks, as comparisons then cost more.
* Beyond the bound the base is cut into boxes of similar size. Each query is first
  compared with its nearest box, which bounds its k-th distance, and then only with the
  boxes that could hold something closer. Boxes and query lists that are too long for a
  task are split by hash, so a hot box never becomes one task. Where boxes exclude little, they
  are sent to the query rows block by block, instead of a copy of each query row to each box.
"""

from __future__ import annotations

import functools
import operator
import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridflow.functions import kernels
from gridflow.identity import with_row_number
from gridflow.schema import col, complete
from gridflow.session import BROADCAST_BYTES, fits_broadcast, stored

# tasks receive these modules with the job, so executors need no installed package
cloudpickle.register_pickle_by_value(kernels)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 20_000
SPLIT_SAMPLE = 50_000
#: Base rows from which a query row's comparisons cost more than sending it to another task, and tasks per core that then share them.
DEALT_ROWS, DEALT_TASKS = 2048, 3
#: Boxes are sent to the query rows when there are more than this, and a query row visits more than one in as many.
DENSE = 4
ROW = "_neighbour_row"


#: Names of distances, and the power of those that are Minkowski's.
METRICS = {
    "euclidean": 2.0, "l2": 2.0, "cityblock": 1.0, "manhattan": 1.0, "l1": 1.0, "chebyshev": float("inf"),
    "cosine": "cosine", "correlation": "correlation", "canberra": "canberra",
}


def distance_of(metric: str | float) -> str | float:
    """A Minkowski power as it is, or what a name in METRICS stands for."""
    if isinstance(metric, str) and metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; use a Minkowski power or one of {sorted(METRICS)}")
    return METRICS[metric] if isinstance(metric, str) else float(metric)


@dataclass(frozen=True)
class Space:
    """Which columns span the feature space and how distance is measured.

    `metric` is a Minkowski power or a name in METRICS. Cosine distance is measured between
    unit vectors, correlation distance between unit vectors of centred rows; rows without a
    direction are at 0 from each other and at 1 from all others. A pair of rows with equal
    `exclude` values is never compared (same row, same fold).
    """

    features: list[str]
    metric: float | str = 2.0
    exclude: str | None = None

    @property
    def p(self) -> float | str:
        """How tasks compare the vectors."""
        found = distance_of(self.metric)
        return "angle" if found in ("cosine", "correlation") else found

    @property
    def width(self) -> int:
        """Length of a row's vector: directions have one more place, for rows that have none."""
        return len(self.features) + (self.p == "angle")

    def vector(self, missing: float | None = None) -> Column:
        """A row's vector; `missing` stands for null features, of rows that are left out later."""
        parts = [col(f).cast("double") for f in self.features]
        point = F.array(*[F.coalesce(c, F.lit(missing)) if missing is not None else c for c in parts])
        if self.p != "angle":
            return point

        width, centred = len(parts), distance_of(self.metric) == "correlation"

        @F.arrow_udf("array<double>")
        def directions(x: pa.Array) -> pa.Array:
            found = kernels.directions(kernels.matrix(x, width), centred)
            return kernels.ragged(found, np.ones(found.shape, dtype=bool), pa.float64())

        return directions(point)

    def tag(self) -> Column:
        """The `exclude` values as text, so that ids and folds of any type can be compared."""
        return (col(self.exclude) if self.exclude else F.lit(None)).cast("string")

    @property
    def row_bytes(self) -> int:
        return 8 * (self.width + 3)


def points(column: pd.Series, width: int) -> np.ndarray:
    """A column of vectors as a matrix."""
    return np.concatenate([np.empty(0), *column]).reshape(-1, width)


def local_arrays(rows: pd.DataFrame, width: int, tagged: bool):
    """(ids, values, points, tags) of base rows, sorted by id."""
    rows = rows.sort_values("_id", kind="stable")
    tags = rows["_tag"].to_numpy(dtype=object) if tagged else None
    return rows["_id"].to_numpy(), rows["_y"].to_numpy(dtype=np.float64), points(rows["_x"], width), tags


def packed(df: DataFrame, space: Space, ident: str | None, value: str | None) -> DataFrame:
    """(_id, _x, _y, _tag) of the rows that have every feature; ids keep their type."""
    return complete(df, space.features).select(
        (col(ident) if ident else F.lit(0).cast("bigint")).alias("_id"),
        space.vector().alias("_x"),
        (col(value) if value else F.lit(None)).cast("double").alias("_y"),
        space.tag().alias("_tag"),
    )


def numbered(query: DataFrame) -> DataFrame:
    """`query` with a row number, which is the identity of a row in every plan.

    Rows of files are known by their places, other tables are written down. A caller that
    asks several times may number its rows itself.
    """
    return query if ROW in query.columns else with_row_number(query, ROW)


def with_answers(rows: DataFrame, answers: DataFrame, out: str, row_bytes: int = 64) -> DataFrame:
    """`rows` with the column `out` of `answers`, by ROW; answers that are proven small go to the rows."""
    answers = stored(answers.select(ROW, out), "answers")
    return rows.join(F.broadcast(answers) if fits_broadcast(answers, row_bytes) else answers, ROW, "left")


def dealt(query: DataFrame, base_rows: int) -> DataFrame:
    """`query` dealt evenly to tasks where its rows meet many base rows: a file read in one piece would be one task."""
    if base_rows < DEALT_ROWS:
        return query
    return query.repartition(max(8, DEALT_TASKS * query.sparkSession.sparkContext.defaultParallelism))


def local_base(
    base: DataFrame, space: Space, ident: str, value: str | None, limit: int = BROADCAST_BYTES
):
    """A broadcast of the base, or None when it is larger than the bound."""
    rows = packed(base, space, ident, value)
    if not fits_broadcast(rows, space.row_bytes, limit):
        return None
    local = local_arrays(rows.toArrow().to_pandas(), space.width, space.exclude is not None)
    return base.sparkSession.sparkContext.broadcast(local)


def with_neighbours(
    query: DataFrame,
    base: DataFrame,
    space: Space,
    k: int,
    query_id: str,
    base_id: str,
    value: str | None = None,
    limit: int = BROADCAST_BYTES,
    out: str = "nn",
    shared=None,
) -> DataFrame:
    """Add the k nearest base rows as struct of arrays (distance, id, value), nearest first.

    Ties are ordered by base id. Null for query rows with a missing feature. `shared` is
    the result of an earlier `local_base` for the same base. Ids may have any type and may
    repeat: each query row has its own neighbours.
    """
    shared = shared or local_base(base, space, base_id, value, limit)
    id_type = base.schema[base_id].dataType
    if shared is None:
        rows = numbered(query)
        found = _boxed(rows, base, space, k, base_id, value)
        rows = with_answers(rows, found.withColumnRenamed("_nn", out), out, 16 + 24 * k)
        return rows if ROW in query.columns else rows.drop(ROW)
    arrow_id = to_arrow_type(id_type)
    p, width, tagged = space.p, space.width, space.exclude is not None

    @F.arrow_udf(f"struct<distance array<double>, id array<{id_type.simpleString()}>, value array<double>>")
    def find(x: pa.Array, tag: pa.Array) -> pa.Array:
        ids, values, points, tags = shared.value
        q = kernels.matrix(x, width)
        q_tag = np.array(tag.to_pylist(), dtype=object) if tagged else None
        position, distance = kernels.nearest(q, points, k, p, q_tag, tags if tagged else None)
        return _pack(distance, ids, values, position, arrow_id)

    whole = F.lit(True)
    for f in space.features:
        whole = whole & col(f).isNotNull()
    point = space.vector(0.0)
    tag = space.tag() if tagged else F.lit("")
    return dealt(query, len(shared.value[0])).withColumn(out, F.when(whole, find(point, tag)))


def _pack(distance, ids, values, position, arrow_id: pa.DataType) -> pa.Array:
    kept = np.isfinite(distance)
    if len(ids) == 0:
        ids, values = np.zeros(1, dtype=ids.dtype), np.zeros(1)
    lists = [
        kernels.ragged(distance, kept, pa.float64()),
        kernels.ragged(ids[position], kept, arrow_id),
        kernels.ragged(values[position], kept, pa.float64()),
    ]
    return pa.StructArray.from_arrays(lists, ["distance", "id", "value"])


def knn_join(
    query: DataFrame,
    base: DataFrame,
    features: list[str],
    k: int,
    query_id: str,
    base_id: str,
    p: float | str = 2.0,
    exclude_self: bool = False,
    value: str | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows (query_id, rank, neighbour, distance[, value]) of the k nearest base rows; `p` as Space.metric."""
    space = Space(list(features), p, "_self" if exclude_self else None)
    if exclude_self:
        query = query.withColumn("_self", col(query_id))
        base = base.withColumn("_self", col(base_id))
    found = with_neighbours(query, base, space, k, query_id, base_id, value, limit)
    pairs = F.arrays_zip(F.col("nn.id"), F.col("nn.distance"), F.col("nn.value"))
    rows = found.select(col(query_id), F.posexplode(pairs).alias("rank", "pair"))
    return rows.select(
        col(query_id),
        (F.col("rank") + 1).alias("rank"),
        F.col("pair.id").alias("neighbour"),
        F.col("pair.distance").alias("distance"),
        *([F.col("pair.value").alias(value)] if value else []),
    )


# --- base tables beyond the broadcast bound ---------------------------------------------


def _splits(sample: np.ndarray, depth: int) -> tuple[list[int], list[float]]:
    """Cut feature and cut point of each node of a binary tree over the sample.

    The sample only places the cuts; every row is then assigned by them.
    """
    axis, cut = [0] * (1 << depth), [0.0] * (1 << depth)
    parts = {1: sample}
    for node in range(1, 1 << depth):
        rows = parts.pop(node)
        if len(rows):
            spread = rows.max(axis=0) - rows.min(axis=0)
            axis[node] = int(spread.argmax())
            cut[node] = float(np.median(rows[:, axis[node]]))
        right = rows[:, axis[node]] > cut[node]
        parts[2 * node], parts[2 * node + 1] = rows[~right], rows[right]
    return axis, cut


def _box_number(depth: int, axis: list[int], cut: list[float]) -> Column:
    axes, cuts = F.array(*[F.lit(a) for a in axis]), F.array(*[F.lit(c) for c in cut])

    def down(node, _):
        right = F.get(F.col("_x"), F.get(axes, node)) > F.get(cuts, node)
        return node * 2 + right.cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), down)


@dataclass(frozen=True)
class Boxes:
    """Base rows with their box, and the exact bounds of each box."""

    rows: DataFrame
    number: np.ndarray
    count: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _boxes(rows: DataFrame, width: int) -> Boxes:
    n = rows.count()
    depth = max(1, int(np.ceil(np.log2(max(2.0, n / BLOCK_ROWS)))))
    share = min(1.0, SPLIT_SAMPLE / max(1, n))
    # the share bounds the sample; a prefix of it would see the first partitions only
    sample = rows.select("_x").sample(share, seed=1).toArrow().column(0)
    axis, cut = _splits(kernels.matrix(sample.combine_chunks(), width), depth)
    rows = rows.withColumn("_box", _box_number(depth, axis, cut))
    bounds = [F.min(F.get("_x", F.lit(f))).alias(f"lo{f}") for f in range(width)]
    bounds += [F.max(F.get("_x", F.lit(f))).alias(f"hi{f}") for f in range(width)]
    table = rows.groupBy("_box").agg(F.count("*").alias("_n"), *bounds).toPandas()
    return Boxes(
        rows,
        table["_box"].to_numpy(dtype=np.int64),
        table["_n"].to_numpy(dtype=np.int64),
        table[[f"lo{f}" for f in range(width)]].to_numpy(dtype=np.float64),
        table[[f"hi{f}" for f in range(width)]].to_numpy(dtype=np.float64),
    )


@dataclass(frozen=True)
class Meeting:
    """What is asked of query rows and base rows that meet: each side's arrays, their comparison, and what to keep of several."""

    schema: str
    asked: Callable[[pd.DataFrame], tuple]
    known: Callable[[pd.DataFrame], tuple]
    compare: Callable[[tuple, tuple], pd.DataFrame]
    merge: Callable[[pd.DataFrame], pd.DataFrame]


def _compare(queries: DataFrame, visits: str, boxes: Boxes, row_bytes: int, meeting: Meeting) -> DataFrame:
    """Compare every query row with each box in its list `visits`.

    Where boxes exclude much, rows meet in tasks: a box with many rows is cut into pieces that
    each query visits; a box with many queries is repeated for slices of them. Both are spread
    by hash, so one task sees at most about BLOCK_ROWS rows of either side. Where query rows visit
    more than one in DENSE of all boxes, as they do in many features, copies of them would grow with the square of the
    rows: then the boxes are sent to the query rows instead, a block of them after another, and
    what a task finds in a block is merged. The comparisons are the same.
    """
    # a list is counted, not its rows: one row per box reaches the driver
    demand = {r[0]: r[1] for r in queries.select(F.explode(visits).alias("_box")).groupBy("_box").count().collect()}
    if len(boxes.number) > DENSE and sum(demand.values()) * DENSE > queries.count() * len(boxes.number):
        return _sent(queries, visits, boxes, row_bytes, demand, meeting)
    routes = queries.withColumn("_box", F.explode(visits)).drop(visits)
    return _met(routes, boxes, demand, meeting)


def _sent(queries: DataFrame, visits: str, boxes: Boxes, row_bytes: int, demand: dict, meeting: Meeting) -> DataFrame:
    """`_compare` by sending the boxes, in blocks of at most BROADCAST_BYTES or one box, to the query rows where they lie."""
    spark, size = queries.sparkSession, max(BLOCK_ROWS, BROADCAST_BYTES // row_bytes)
    tasks = max(DEALT_TASKS * spark.sparkContext.defaultParallelism, -(-queries.count() // BLOCK_ROWS))
    queries = stored(queries.repartition(tasks), "asked")
    rows = stored(boxes.rows.withColumn("_part", F.pmod(F.xxhash64("_number"), F.lit(1 << 20))), "boxed")
    blocks, filled = [], size
    for box, n in zip(boxes.number.tolist(), boxes.count.tolist()):
        if box not in demand:
            continue
        # a box of many rows, which may be equal, is cut by hash
        pieces = -(-n // size)
        for piece in range(pieces):
            if filled + n // pieces > size:
                blocks.append([])
                filled = 0
            blocks[-1].append((box, piece, pieces))
            filled += n // pieces

    def with_block(block) -> DataFrame:
        wanted = [(F.col("_box") == box) & (F.col("_part") % pieces == piece) for box, piece, pieces in block]
        part = rows.where(functools.reduce(operator.or_, wanted)).drop("_part").toArrow().to_pandas()
        sent = spark.sparkContext.broadcast({box: meeting.known(rows) for box, rows in part.groupby("_box", sort=False)})

        def per_batch(batches):
            for q in batches:
                lists = q[visits].to_numpy()
                owner = np.repeat(np.arange(len(q)), [len(x) for x in lists])
                wanted = np.concatenate(lists) if len(lists) else owner
                asked, found = meeting.asked(q), []
                for box, base in sent.value.items():
                    some = owner[wanted == box]
                    if len(some):
                        found.append(meeting.compare(tuple(None if x is None else x[some] for x in asked), base))
                found = [f for f in found if len(f)]
                if found:
                    yield meeting.merge(pd.concat(found, ignore_index=True))

        found = stored(queries.mapInPandas(per_batch, meeting.schema), "met")
        sent.destroy()
        return found

    # one block at a time: the driver and the tasks hold no more than that
    found = [with_block(block) for block in blocks]
    return functools.reduce(DataFrame.unionByName, found)


def _met(routes: DataFrame, boxes: Boxes, demand: dict, meeting: Meeting) -> DataFrame:
    """`_compare` of routed (query, box) rows by shuffling them."""
    spark = routes.sparkSession
    plan = [
        (int(b), -(-int(n) // BLOCK_ROWS), -(-demand[b] // BLOCK_ROWS))
        for b, n in zip(boxes.number, boxes.count)
        if b in demand
    ]
    # one row per box, which the driver holds: sent to the rows while small, so that a hot box is split before any shuffle
    layout = spark.createDataFrame(plan, "_box bigint, _pieces bigint, _slices bigint")
    if 24 * len(plan) <= BROADCAST_BYTES:
        layout = F.broadcast(layout)

    def spread(n, *key):
        return F.pmod(F.xxhash64(*key), F.col(n))

    def all_of(n):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    base = boxes.rows.withColumn("_box", F.col("_box").cast("bigint")).join(layout, "_box")
    base = base.withColumn("_piece", spread("_pieces", "_number"))
    base = base.withColumn("_slice", all_of("_slices")).drop("_pieces", "_slices")
    query = routes.join(layout, "_box").withColumn("_slice", spread("_slices", "_qid"))
    query = query.withColumn("_piece", all_of("_pieces")).drop("_pieces", "_slices")
    task = ["_box", "_piece", "_slice"]

    def met(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return meeting.compare(meeting.asked(q), meeting.known(b))

    return query.groupBy(*task).cogroup(base.groupBy(*task)).applyInPandas(met, meeting.schema)


def least(found: pd.DataFrame, keys: list[str], k: int) -> pd.DataFrame:
    """The rows of each group of `keys` that may be among its k nearest: all up to the k-th smallest distance."""
    found = found.sort_values([*keys, "distance"], kind="stable")
    rank = found.groupby(keys, sort=False).cumcount()
    edge = found[rank == k - 1].set_index(keys)["distance"].rename("_edge")
    edges = found[keys].merge(edge, how="left", left_on=keys, right_index=True)["_edge"].fillna(np.inf)
    return found[found["distance"].to_numpy() <= edges.to_numpy()]


def _top_k(queries: DataFrame, visits: str, boxes: Boxes, space: Space, k: int) -> DataFrame:
    """(_qid, _hits) with the k best (distance, id, value) of the boxes that each query visits, up to its `_reach` where it has one."""
    p, width, tagged = space.p, space.width, space.exclude is not None
    id_type = boxes.rows.schema["_id"].dataType.simpleString()
    bounded = "_reach" in queries.columns

    def asked(q: pd.DataFrame) -> tuple:
        reach = q["_reach"].to_numpy(dtype=np.float64) if bounded else None
        return q["_qid"].to_numpy(), points(q["_qx"], width), q["_qtag"].to_numpy(dtype=object) if tagged else None, reach

    def compare(q: tuple, b: tuple) -> pd.DataFrame:
        (who, x, tag, reach), (ids, values, base_points, tags) = q, b
        position, distance = kernels.nearest(x, base_points, k, p, tag, tags, reach)
        kept = np.isfinite(distance)
        return pd.DataFrame(
            {
                "_qid": np.repeat(who, kept.sum(axis=1)),
                "distance": distance[kept],
                "id": ids[position][kept] if len(ids) else ids[:0],
                "value": values[position][kept] if len(ids) else np.zeros(0),
            }
        )

    schema = f"_qid bigint, distance double, id {id_type}, value double"
    meeting = Meeting(schema, asked, lambda b: local_arrays(b, width, tagged), compare, lambda found: least(found, ["_qid"], k))
    hits = _compare(queries, visits, boxes, space.row_bytes, meeting)
    return _merge(hits.groupBy("_qid").agg(F.collect_list(F.struct("distance", "id", "value")).alias("_hits")), k)


def _merge(lists: DataFrame, k: int) -> DataFrame:
    return lists.withColumn("_hits", F.slice(F.array_sort("_hits"), 1, k))


def _base(base: DataFrame, space: Space, ident: str | None, value: str | None) -> DataFrame:
    """Packed base rows, written with a number by which a box of equal points can be split."""
    rows = packed(base, space, ident, value)
    return stored(rows.withColumn("_number", F.monotonically_increasing_id()), "base")


def _queries(query: DataFrame, space: Space) -> DataFrame:
    return packed(query, space, ROW, None).select(
        F.col("_id").alias("_qid"), F.col("_x").alias("_qx"), F.col("_tag").alias("_qtag")
    )


def _boxed(
    query: DataFrame, base: DataFrame, space: Space, k: int, base_id: str, value: str | None
) -> DataFrame:
    """(ROW, _nn) of the numbered query rows that have every feature."""
    width, p = space.width, space.p
    boxes = _boxes(_base(base, space, base_id, value), width)
    bounds = query.sparkSession.sparkContext.broadcast((boxes.number, boxes.low, boxes.high))

    @F.arrow_udf("bigint")
    def home(x: pa.Array) -> pa.Array:
        number, low, high = bounds.value
        q = kernels.matrix(x, width)
        parts = kernels.slices(len(q), len(low))
        nearest = [kernels.box_gap(q[part], low, high, p, far=False).argmin(axis=1) for part in parts]
        return pa.array(number[np.concatenate(nearest)])

    @F.arrow_udf("array<bigint>")
    def others(x: pa.Array, seen: pa.Array, reach: pa.Array) -> pa.Array:
        number, low, high = bounds.value
        q = kernels.matrix(x, width)
        # rounding must not lose a box that only just reaches
        limit = reach.to_numpy(zero_copy_only=False)[:, None] * (1 + 1e-9)
        home = seen.to_numpy(zero_copy_only=False)[:, None]
        found = []
        for part in kernels.slices(len(q), len(low)):
            wanted = kernels.box_gap(q[part], low, high, p, far=False) <= limit[part]
            wanted &= number[None, :] != home[part]
            found.append(kernels.ragged(np.broadcast_to(number, wanted.shape), wanted, pa.int64()))
        return pa.concat_arrays(found)

    queries = stored(_queries(query, space).withColumn("_box", home("_qx")), "queries")
    first = stored(_top_k(queries.withColumn("_visits", F.array("_box")), "_visits", boxes, space, k), "first")
    reach = F.when(F.size("_hits") >= k, F.get("_hits", F.lit(k - 1))["distance"])
    bounded = queries.join(first, "_qid", "left").withColumn(
        "_reach", F.coalesce(reach, F.lit(float("inf")))
    )
    asked = stored(bounded.select("_qid", "_qx", "_qtag", "_reach", others("_qx", "_box", "_reach").alias("_visits")), "asked")
    second = _top_k(asked, "_visits", boxes, space, k)
    both = first.unionByName(second).groupBy("_qid").agg(
        F.flatten(F.collect_list("_hits")).alias("_hits")
    )
    hits = F.col("_hits")
    nn = F.struct(
        F.transform(hits, lambda h: h["distance"]).alias("distance"),
        F.transform(hits, lambda h: h["id"]).alias("id"),
        F.transform(hits, lambda h: h["value"]).alias("value"),
    )
    return _merge(both, k).select(F.col("_qid").alias(ROW), nn.alias("_nn"))


def bagged_search(
    asked: DataFrame, table: DataFrame, names: list[str], places: list[list[int]], k: int, p: float, weights: str, out: str
) -> DataFrame:
    """(ROW, out): for every query row the array of the bags' answers, from one search through one box index.

    `asked` has ROW and the features `names`; `table` (_row, y, _bags, features) says how often
    each bag drew a row. A bag measures distance on its own features, those at `places`; boxes
    are bounded in all of them. A query's nearest box gives the reach of each of its bags; then
    it visits every box that lies within reach of some bag, and all bags are answered there.
    """
    width, bags = len(names), len(places)
    space = Space(names, p)
    rows = stored(
        table.select(
            col("_row").alias("_id"), space.vector().alias("_x"), col("y").alias("_y"), "_bags", F.lit(None).cast("string").alias("_tag")
        ).withColumn("_number", F.monotonically_increasing_id()),
        "base",
    )
    boxes = _boxes(rows, width)
    bounds = asked.sparkSession.sparkContext.broadcast((boxes.number, boxes.low, boxes.high))
    entry = "array<struct<bag int, distance double, id bigint, value double>>"

    @F.arrow_udf("bigint")
    def home(x: pa.Array) -> pa.Array:
        number, low, high = bounds.value
        q = kernels.matrix(x, width)
        parts = kernels.slices(len(q), len(low))
        nearest = [kernels.box_gap(q[part], low, high, p, far=False).argmin(axis=1) for part in parts]
        return pa.array(number[np.concatenate(nearest)])

    def best(hits: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest of each bag (row * bags + bag) among a row's entries: group, distance, value, in order."""
        entries = hits.flatten()
        bag, distance, ident, value = (entries.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        owner = np.repeat(np.arange(len(hits)), np.diff(hits.offsets.to_numpy())) * bags + bag
        order = np.lexsort((ident, distance, owner))
        owner = owner[order]
        kept = np.arange(len(owner)) - np.searchsorted(owner, owner) < k
        return owner[kept], distance[order][kept], value[order][kept]

    @F.arrow_udf("array<double>")
    def reaches(hits: pa.Array) -> pa.Array:
        """The k-th distance of each bag; infinite where there are fewer."""
        owner, distance, _ = best(hits)
        reach = np.full(len(hits) * bags, np.inf)
        last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) if len(owner) else np.zeros(0, np.int64)
        full = last[last - np.searchsorted(owner, owner[last]) == k - 1] if len(last) else last
        reach[owner[full]] = distance[full]
        reach = reach.reshape(len(hits), bags)
        return kernels.ragged(reach, np.ones(reach.shape, dtype=bool), pa.float64())

    @F.arrow_udf("array<bigint>")
    def others(x: pa.Array, seen: pa.Array, reach: pa.Array) -> pa.Array:
        number, low, high = bounds.value
        q = kernels.matrix(x, width)
        # rounding must not lose a box that only just reaches
        reach = kernels.matrix(reach, bags) * (1 + 1e-9)
        home = seen.to_numpy(zero_copy_only=False)[:, None]
        found = []
        for part in kernels.slices(len(q), len(low)):
            wanted = np.zeros((part.stop - part.start, len(low)), bool)
            for b, place in enumerate(places):
                wanted |= kernels.box_gap(q[part][:, place], low[:, place], high[:, place], p, far=False) <= reach[part, b, None]
            wanted &= number[None, :] != home[part]
            found.append(kernels.ragged(np.broadcast_to(number, wanted.shape), wanted, pa.int64()))
        return pa.concat_arrays(found)

    @F.arrow_udf("array<double>")
    def answer(hits: pa.Array) -> pa.Array:
        owner, distance, value = best(hits)
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        d, y = np.full((len(hits) * bags, k), np.inf), np.zeros((len(hits) * bags, k))
        d[owner, rank], y[owner, rank] = distance, value
        found = kernels.neighbour_mean(d, y, weights).reshape(len(hits), bags)
        return kernels.ragged(found, np.ones(found.shape, dtype=bool), pa.float64())

    def sought(q: pd.DataFrame) -> tuple:
        reach = points(q["_reach"], bags) if "_reach" in q.columns else np.full((len(q), bags), np.inf)
        return q["_qid"].to_numpy(), points(q["_qx"], width), reach

    def known(b: pd.DataFrame) -> tuple:
        b = b.sort_values("_id", kind="stable")
        drawn = np.array(b["_bags"].tolist(), dtype=np.int64).reshape(-1, bags)
        return b["_id"].to_numpy(), b["_y"].to_numpy(dtype=np.float64), points(b["_x"], width), drawn

    def compare(q: tuple, b: tuple) -> pd.DataFrame:
        (who, x, reach), (ids, y, base_points, drawn) = q, b
        parts = []
        for bag, place in enumerate(places):
            copies = np.repeat(np.arange(len(ids)), drawn[:, bag])
            position, distance = kernels.nearest(x[:, place], base_points[copies][:, place], k, p, within=reach[:, bag])
            kept = np.isfinite(distance)
            at = copies[position[kept]]
            parts.append((np.repeat(who, kept.sum(axis=1)), np.full(len(at), bag, np.int32), distance[kept], ids[at], y[at]))
        columns = [np.concatenate(c) for c in zip(*parts)]
        return pd.DataFrame(dict(zip(("_qid", "bag", "distance", "id", "value"), columns)))

    def hits(visiting: DataFrame) -> DataFrame:
        schema = "_qid bigint, bag int, distance double, id bigint, value double"
        meeting = Meeting(schema, sought, known, compare, lambda found: least(found, ["_qid", "bag"], k))
        found = _compare(visiting, "_visits", boxes, space.row_bytes + 8 * bags, meeting)
        return found.groupBy("_qid").agg(F.collect_list(F.struct("bag", "distance", "id", "value")).cast(entry).alias("_hits"))

    queries = asked.select(F.col(ROW).alias("_qid"), space.vector().alias("_qx"), F.lit(None).cast("string").alias("_qtag"))
    queries = stored(queries.withColumn("_box", home("_qx")), "queries")
    first = stored(hits(queries.withColumn("_visits", F.array("_box"))), "first")
    bounded = queries.join(first, "_qid", "left").withColumn("_hits", F.coalesce("_hits", F.array().cast(entry)))
    bounded = bounded.withColumn("_reach", reaches("_hits"))
    visiting = stored(bounded.select("_qid", "_qx", "_qtag", "_reach", others("_qx", "_box", "_reach").alias("_visits")), "asked")
    both = first.unionByName(hits(visiting)).groupBy("_qid").agg(F.flatten(F.collect_list("_hits")).alias("_hits"))
    return both.select(F.col("_qid").alias(ROW), answer("_hits").alias(out))


# --- sums and counts over pairs ---------------------------------------------------------


def distance_sums(
    query: DataFrame, base: DataFrame, space: Space, limit: int = BROADCAST_BYTES, shared=None
) -> tuple[float, int, int]:
    """(sum of distances, number of positive ones, number of pairs) over all allowed pairs.

    A mean over pairs needs every pair once; each task adds up its own and emits one row.
    """
    width, p, tagged = space.width, space.p, space.exclude is not None
    schema = "total double, positive bigint, pairs bigint"

    def add_up(q, q_tag, b, b_tag):
        found = kernels.summary(q, b, p, q_tag, b_tag, wanted=(kernels.TOTAL, kernels.POSITIVE))
        names = {"total": found[kernels.TOTAL], "positive": found[kernels.POSITIVE].astype(np.int64), "pairs": found[kernels.COUNT].astype(np.int64)}
        return pd.DataFrame({name: [values.sum()] for name, values in names.items()})

    queries = packed(query, space, None, None)
    shared = shared or local_base(base.withColumn("_one", F.lit(0)), space, "_one", None, limit)
    if shared is not None:

        def per_batch(batches):
            _, _, base_points, tags = shared.value
            for rows in batches:
                tag = rows["_tag"].to_numpy(dtype=object) if tagged else None
                yield add_up(points(rows["_x"], width), tag, base_points, tags if tagged else None)

        sums = dealt(queries.select("_x", "_tag"), len(shared.value[0])).mapInPandas(per_batch, schema)
    else:
        rows = packed(base, space, None, None)
        if p == 1:
            return _axis_sums(queries, rows, width, tagged)
        rows = stored(rows.select("_x", "_tag", F.monotonically_increasing_id().alias("_n")), "pairs")
        size, count = max(BLOCK_ROWS, limit // space.row_bytes), rows.count()
        queries = stored(dealt(queries.select("_x", "_tag"), count), "pairs")
        blocks = max(1, -(-count // size))

        def with_block(b):
            """Sums over one block of the base, which is sent to the query rows where they lie."""
            part = rows.where(F.pmod(F.xxhash64("_n"), F.lit(blocks)) == b).toArrow().to_pandas()
            sent = query.sparkSession.sparkContext.broadcast((points(part["_x"], width), part["_tag"].to_numpy(dtype=object)))

            def per_batch(batches):
                block, tags = sent.value
                for q in batches:
                    tag = q["_tag"].to_numpy(dtype=object) if tagged else None
                    yield add_up(points(q["_x"], width), tag, block, tags if tagged else None)

            found = queries.mapInPandas(per_batch, schema).agg(F.sum("total"), F.sum("positive"), F.sum("pairs")).first()
            sent.unpersist()
            return found

        # one block at a time: the driver and the tasks hold no more than that
        found = [with_block(b) for b in range(blocks)]
        return sum(float(r[0] or 0.0) for r in found), sum(int(r[1] or 0) for r in found), sum(int(r[2] or 0) for r in found)
    row = sums.agg(F.sum("total"), F.sum("positive"), F.sum("pairs")).first()
    return float(row[0] or 0.0), int(row[1] or 0), int(row[2] or 0)


def _axis_sums(queries: DataFrame, rows: DataFrame, width: int, tagged: bool) -> tuple[float, int, int]:
    """distance_sums for power 1, without comparing pairs: each axis is sorted once.

    A value's gaps to all base values follow from how many lie below it and their sum. The
    values of an axis are counted first; cut points by quantile make ranges, within which a
    window runs, and sums of ranges carry over. Pairs of equal tags are taken off again, as
    sums within each tag.
    """
    own, other = (F.lit(1).alias("q"), F.lit(0).alias("b")), (F.lit(0).alias("q"), F.lit(1).alias("b"))
    tag = F.coalesce(F.col("_tag"), F.lit("")).alias("_tag")  # null tags equal nothing and are left out within tags
    both = queries.select("_x", tag, F.col("_tag").isNull().alias("_none"), *own).unionByName(
        rows.select("_x", tag, F.col("_tag").isNull().alias("_none"), *other)
    )
    both = stored(both, "axes")
    counts = both.agg(F.sum("q"), F.sum("b")).first()
    if not counts[0] or not counts[1]:
        return 0.0, 0, 0

    def gaps(points: DataFrame, by: list[str]) -> float:
        values = points.select(*by, "q", "b", F.posexplode("_x").alias("axis", "v"))
        values = stored(values.groupBy(*by, "axis", "v").agg(F.sum("q").alias("q"), F.sum("b").alias("b")), "axis")
        n = max(2, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        cuts = values.groupBy("axis").agg(F.percentile_approx("v", [i / n for i in range(1, n)], 100 * n).alias("cuts"))
        values = values.join(F.broadcast(cuts), "axis")  # one row per feature
        values = values.withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
        group = [*by, "axis"]
        ranges = values.groupBy(*group, "range").agg(F.sum("b").alias("n"), F.sum(F.col("b") * F.col("v")).alias("s"))
        whole, below = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.select(
            *group, "range", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("n_below"), F.coalesce(F.sum("s").over(below), F.lit(0.0)).alias("s_below"),
            F.sum("n").over(whole).alias("n_all"), F.sum("s").over(whole).alias("s_all"),
        )
        inside = Window.partitionBy(*group, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        values = values.withColumn("n_in", F.sum("b").over(inside)).withColumn("s_in", F.sum(F.col("b") * F.col("v")).over(inside))
        values = values.join(ranges, [*group, "range"])
        n_low, s_low = F.col("n_below") + F.col("n_in"), F.col("s_below") + F.col("s_in")
        gap = F.col("v") * n_low - s_low + (F.col("s_all") - s_low) - F.col("v") * (F.col("n_all") - n_low)
        return float(values.agg(F.sum(F.col("q") * gap)).first()[0] or 0.0)

    def equal(points: DataFrame, by: list[str]) -> int:
        same = points.groupBy(*by).agg(F.sum("q").alias("q"), F.sum("b").alias("b"))
        return int(same.agg(F.sum(F.col("q") * F.col("b"))).first()[0] or 0)

    total, pairs = gaps(both, []), int(counts[0]) * int(counts[1])
    positive = pairs - equal(both, ["_x"])
    if tagged:
        within = both.where(~F.col("_none"))
        inner = equal(within, ["_tag"])
        total, pairs = total - gaps(within, ["_tag"]), pairs - inner
        positive -= inner - equal(within, ["_tag", "_x"])
    return total, positive, pairs


def with_summary(query: DataFrame, shared, space: Space, out: str, radius: float = -1.0, wanted=(kernels.NEAR, kernels.TOTAL, kernels.POSITIVE, kernels.WITHIN)) -> DataFrame:
    """Add struct `out` about the allowed base rows, from one comparison with a broadcast base.

    near: distance of the nearest; total, positive, pairs: sum of distances, number of
    positive ones, number of all; within: number nearer than `radius`. Null for query rows
    with a missing feature, near also without any base row. Only what is `wanted` and pairs
    are sure to be found.
    """
    p, width, tagged = space.p, space.width, space.exclude is not None

    @F.arrow_udf("struct<near double, total double, positive bigint, pairs bigint, within bigint>")
    def summary(x: pa.Array, tag: pa.Array) -> pa.Array:
        _, _, points, tags = shared.value
        q = kernels.matrix(x, width)
        q_tag = np.array(tag.to_pylist(), dtype=object) if tagged else None
        found = kernels.summary(q, points, p, q_tag, tags if tagged else None, radius, wanted)
        near = pa.array(found[0], mask=~np.isfinite(found[0]))
        counts = [pa.array(row.astype(np.int64)) for row in found[2:]]
        return pa.StructArray.from_arrays(
            [near, pa.array(found[1]), *counts], ["near", "total", "positive", "pairs", "within"]
        )

    whole = F.lit(True)
    for f in space.features:
        whole = whole & col(f).isNotNull()
    point = space.vector(0.0)
    return query.withColumn(out, F.when(whole, summary(point, space.tag() if tagged else F.lit(""))))


def with_count_within(
    query: DataFrame,
    base: DataFrame,
    space: Space,
    radius: float,
    query_id: str,
    out: str,
    limit: int = BROADCAST_BYTES,
    shared=None,
) -> DataFrame:
    """Add the number of base rows nearer than `radius`; null for incomplete query rows."""
    width, p = space.width, space.p
    whole = F.lit(True)
    for f in space.features:
        whole = whole & col(f).isNotNull()
    shared = shared or local_base(base.withColumn("_one", F.lit(0)), space, "_one", None, limit)
    if shared is not None:

        @F.arrow_udf("bigint")
        def count(x: pa.Array) -> pa.Array:
            q = kernels.matrix(x, width)
            return pa.array(kernels.summary(q, shared.value[2], p, radius=radius, wanted=(kernels.WITHIN,))[kernels.WITHIN].astype(np.int64))

        point = space.vector(0.0)
        return dealt(query, len(shared.value[0])).withColumn(out, F.when(whole, count(point)))

    rows = numbered(query)
    boxes = _boxes(_base(base, space, None, None), width)
    bounds = query.sparkSession.sparkContext.broadcast(
        (boxes.number, boxes.count, boxes.low, boxes.high)
    )

    @F.arrow_udf("struct<inside bigint, partly array<bigint>>")
    def route(x: pa.Array) -> pa.Array:
        number, size, low, high = bounds.value
        q = kernels.matrix(x, width)
        margin = 1e-9 * radius
        found = []
        for part in kernels.slices(len(q), len(low)):
            inside = kernels.box_gap(q[part], low, high, p, far=True) < radius - margin
            partly = ~inside & (kernels.box_gap(q[part], low, high, p, far=False) <= radius + margin)
            lists = kernels.ragged(np.broadcast_to(number, partly.shape), partly, pa.int64())
            counts = pa.array((inside * size).sum(axis=1))
            found.append(pa.StructArray.from_arrays([counts, lists], ["inside", "partly"]))
        return pa.concat_arrays(found)

    def compare(q: tuple, b: tuple) -> pd.DataFrame:
        counts = kernels.summary(q[1], b[2], p, radius=radius, wanted=(kernels.WITHIN,))[kernels.WITHIN]
        return pd.DataFrame({"_qid": q[0], "n": counts.astype(np.int64)})

    def asked(q: pd.DataFrame) -> tuple:
        return q["_qid"].to_numpy(), points(q["_qx"], width)

    queries = stored(_queries(rows, space).withColumn("_route", route("_qx")), "queries")
    visiting = queries.select("_qid", "_qx", "_qtag", F.col("_route.partly").alias("_visits"))

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        return found.groupby("_qid", as_index=False)["n"].sum()

    meeting = Meeting("_qid bigint, n bigint", asked, lambda b: local_arrays(b, width, False), compare, merge)
    near = _compare(visiting, "_visits", boxes, space.row_bytes, meeting)
    counts = (
        queries.select("_qid", F.col("_route.inside").alias("n"))
        .unionByName(near)
        .groupBy(F.col("_qid").alias(ROW))
        .agg(F.sum("n").alias(out))
    )
    rows = with_answers(rows, counts, out, 16)
    return rows if ROW in query.columns else rows.drop(ROW)
