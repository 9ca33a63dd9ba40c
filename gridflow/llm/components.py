"""Connected components of a distributed graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridflow.llm.common import hot_join, stored
from gridflow.session import release, written

SALTS = 256


class Forest:
    """Union-find over the nodes that a task has linked; gives each joining link once."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the larger (or smaller) neighbours of each node to the least node among them and itself.

    Rounds are many, so their joins are merges: broadcasts of each would pile up in the driver.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = hot_join(both, least, ["a"], F.pmod(F.xxhash64("b"), F.lit(SALTS)), strategy="merge")
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node `a` or `b` of `edges` that is not itself a root: root is the least node reachable.

    Nodes are bigints. Each round ties larger neighbours, then smaller ones, to the least
    neighbour and writes the edges; it ends when every node hangs on one root. Hub nodes are
    spread over SALTS tasks. Nothing but two sums per round reaches the driver.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = stored(edges, "edges"), None
    path = written()[-1]
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now.n == 0 or (now.n, now.s) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = (now.n, now.s)
        edges = stored(star(star(edges, True), False), "edges")
        release(edges.sparkSession, [path])
        path = written()[-1]
