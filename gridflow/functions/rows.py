"""Row-wise functions across columns or over a per-row array of members."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from gridflow.functions.columns import ln_or_minus_inf


def sum_skipping_nulls(cols: list[Column]) -> Column:
    """Sum that counts null as zero; zero when every value is null."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])


def sum_or_null(cols: list[Column]) -> Column:
    """Sum of the non-null values; null when every value is null."""
    return F.when(F.coalesce(*cols).isNotNull(), sum_skipping_nulls(cols))


def total_and_log(cols: list[Column]) -> tuple[Column, Column]:
    total = sum_skipping_nulls(cols)
    return total, ln_or_minus_inf(total)


def shannon(cols: list[Column], base: float | None = None) -> Column:
    """Shannon diversity of the row; null for an all-zero row."""
    total = sum_skipping_nulls(cols)

    def term(c):
        share = c / F.nullif(total, F.lit(0.0))
        return F.when(c > 0, -share * F.ln(share)).otherwise(F.lit(0.0))

    entropy = reduce(lambda a, b: a + b, [term(c) for c in cols])
    if base is not None:
        entropy = entropy / F.ln(F.lit(float(base)))
    return F.when(total > 0, entropy)


def weighted_mean(pairs: list[tuple[Column, float]]) -> Column:
    """Sum(weight_value * x) / Sum(x) for (x, trait value) pairs; null when Sum(x) is zero."""
    top = reduce(lambda a, b: a + b, [x * F.lit(float(t)) for x, t in pairs])
    bottom = reduce(lambda a, b: a + b, [x for x, _ in pairs])
    return F.try_divide(top, F.nullif(bottom, F.lit(0.0)))


def _at(sorted_values: Column, q: float) -> Column:
    """Linear interpolation at position q * (n - 1) of a sorted array without nulls."""
    pos = F.lit(float(q)) * (F.size(sorted_values) - 1)
    low = F.floor(pos).cast("int")
    below = F.get(sorted_values, low)
    above = F.coalesce(F.get(sorted_values, low + 1), below)
    return below + (pos - low) * (above - below)


def ordered(values: Column) -> Column:
    """The non-null values of a per-row array, ascending."""
    return F.sort_array(F.filter(values, lambda v: v.isNotNull()))


def quantiles_of_ordered(values: Column, qs: list[float]) -> list[Column]:
    """Linear quantiles of an array made by `ordered`; keep that array in a column of its own."""
    return [_at(values, q) for q in qs]


def row_quantiles(values: Column, qs: list[float]) -> list[Column]:
    """Linear quantiles of a per-row array, skipping nulls."""
    return quantiles_of_ordered(ordered(values), qs)


def row_quantile(values: Column, q: float) -> Column:
    return row_quantiles(values, [q])[0]


def row_mean(values: Column) -> Column:
    kept = F.filter(values, lambda v: v.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(total, F.nullif(F.size(kept), F.lit(0)))


def row_stddev(values: Column) -> Column:
    """Sample standard deviation (n - 1) of a per-row array, skipping nulls."""
    kept = F.filter(values, lambda v: v.isNotNull())
    n = F.size(kept)
    mean = row_mean(values)
    squares = F.aggregate(kept, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
    return F.when(n > 1, F.sqrt(squares / F.nullif(n - 1, F.lit(0))))


def weighted_quantile(values: Column, weights: Column, q: float) -> Column:
    """Smallest value whose cumulative weight reaches the share `q` of all weight."""
    if not 0 <= q <= 1:
        raise ValueError("quantile must lie between 0 and 1")
    pairs = F.zip_with(values, weights, lambda v, w: F.struct(v.alias("v"), w.alias("w")))
    ordered = F.array_sort(pairs)
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("hit"))

    def step(state, item):
        cum = state["cum"] + item["w"]
        reached = state["hit"].isNull() & (cum / total >= F.lit(float(q)))
        return F.struct(
            cum.alias("cum"), F.when(reached, item["v"]).otherwise(state["hit"]).alias("hit")
        )

    return F.aggregate(ordered, start, step, lambda state: state["hit"])
