"""Shards that all hold the same mixture of sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridflow.llm.common import bucket_bits, numbered, pinned, place_of, running, stored

SEED = 20240


def assign_shards(
    df: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    seed: int = SEED, uid: str | None = None,
) -> DataFrame:
    """One row per row of `df`: doc_id, size, text_crc32, shard, slot, `_uid`.

    Rows of a source are shuffled by a seeded hash of their id and ranked; rank r of n gets
    the fraction (r + u) / n, u in 0..1 fixed by the source. Rows sorted by fraction
    interleave the sources in proportion, and equal cuts of that order give shards whose
    sizes in rows differ by at most one and whose mixtures agree within one row a source.
    Size is the UTF-8 bytes of the text plus one, a null text having none; null text has
    the CRC of the empty text. Null sources are one source. Null ids are shuffled by row
    number (a column `uid` may give it); ties in the hash go by id, then row number. Other columns are ignored and an
    empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = F.col(source_col).cast("string")
    rows = stored(
        numbered(df, uid).select(
            "_uid", F.col(id_col).alias("doc_id"),
            F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("_source"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(
                F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("row"), F.col("_uid")))
            ).alias("_hash"),
        ),
        "shards",
    )
    n = rows.count()
    bits = bucket_bits(n)
    high = F.shiftrightunsigned("_hash", 1)
    rows = rows.withColumn("_bucket", F.shiftright(high, 63 - bits))
    order = [high, F.col("doc_id"), F.col("_uid")]
    ranked = running(rows, ["_source"], "_bucket", order, F.lit(1), "_rank")
    sums = rows.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    totals = sums.groupBy("_source").agg(F.sum("_n").alias("_source_rows"))
    totals = sums.select("_source", "_bucket").join(totals, "_source")
    offset = (F.pmod(F.xxhash64(F.lit(seed), "_source"), F.lit(1 << 20)) + 0.5) / (1 << 20)
    fraction = (F.col("_rank") + offset) / F.col("_source_rows")
    ranked = stored(
        ranked.join(totals, ["_source", "_bucket"]).select(
            "_uid", "doc_id", "size", "text_crc32", "_source", fraction.alias("_fraction")
        ),
        "fractions",
    )
    ranked = ranked.withColumn("_bucket", F.floor(F.col("_fraction") * (1 << bits)).cast("bigint"))
    placed = running(ranked, [], "_bucket", [F.col("_fraction"), F.col("_source"), F.col("_uid")], F.lit(1), "_place")
    shard = F.expr(f"cast(_place * {n_shards} div {max(n, 1)} as int)")
    first = F.expr(f"(cast(_place * {n_shards} div {max(n, 1)} as bigint) * {n} + {n_shards - 1}) div {n_shards}")
    return placed.select(
        "doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("_place") - first).alias("slot"), "_uid"
    )


def write_shards(
    df: DataFrame, path: str, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", seed: int = SEED,
) -> None:
    """Write `df` in folders shard=0, shard=1, ...; rows of a shard stand in slot order.

    Columns are unchanged, but for one named shard, which the folder replaces.
    """
    frame, names = pinned(df)
    placed = assign_shards(frame, n_shards, *place_of(df, id_col, text_col, source_col), seed, "_uid")
    rows = frame.join(placed.select("_uid", "shard", "slot"), "_uid")
    rows = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    names = [name for c, name in zip(df.columns, names) if c.lower() != "shard"]
    rows.select(*names, "shard").write.partitionBy("shard").mode("errorifexists").parquet(path)
