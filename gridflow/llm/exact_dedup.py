"""Exact duplicates by a tree merge of sorted digest runs (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridflow.llm.common import BLANKS, hot_join, numbered, pinned, place_of, run_of, stored

KEY = ["_digest", "_bytes", "_check"]
FAN_IN = 16


def digests(df: DataFrame, id_col: str, text_col: str, uid: str | None = None) -> DataFrame:
    """Row number, id and identity of the normalised text of every row, written once."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), BLANKS, " ")
    rows = numbered(df, uid).select("_uid", F.col(id_col).alias("_id"), text.alias("_text"))
    return stored(
        rows.select(
            "_uid", "_id", run_of(F.col("_uid")).alias("_run"), F.unhex(F.sha2("_text", 256)).alias("_digest"),
            F.octet_length("_text").alias("_bytes"), F.xxhash64("_text").alias("_check"),
        ),
        "digests",
    )


def merge_runs(runs: DataFrame, n_runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merge sorted runs in rounds of `fan_in` until one run is left, held in digest ranges.

    Each round keeps, per digest, the smallest identifier and the number of rows, so a
    group of copies is at most `fan_in` rows wherever two runs meet.
    """
    while n_runs > 1:
        n_runs = -(-n_runs // fan_in)
        runs = (
            runs.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int"))
            .groupBy("_run", *KEY)
            .agg(F.min("_first").alias("_first"), F.sum("_n").alias("_n"))
        )
    return runs


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN, uid: str | None = None
) -> DataFrame:
    """One row per row of `df`: doc_id, keep_id, group_size, kept, text_sha256, and `_uid`.

    Texts are equal when equal after each run of ASCII white space is one space: same
    SHA-256, verified by byte length and a second hash. Every input partition makes a
    run of digests; runs are merged upwards in a tree and the result goes down again by
    (run, digest), so no task ever holds a whole group of copies.

    Null text counts as empty. Null ids sort last. Of rows that repeat an id and a text,
    the one with the smallest row number stays; `uid` may name a column of row numbers. Other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    rows = digests(df, id_col, text_col, uid)
    n_runs = (rows.agg(F.max("_run").alias("m")).first().m or 0) + 1
    first = F.struct(F.col("_id").isNull().alias("late"), F.col("_id").alias("id"), F.col("_uid").alias("uid"))
    runs = rows.groupBy("_run", *KEY).agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("_n"))
    groups = merge_runs(runs, n_runs, fan_in).drop("_run")
    return hot_join(rows, groups, KEY, F.col("_run")).select(
        F.col("_id").alias("doc_id"),
        F.col("_first.id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_first.uid") == F.col("_uid")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
        "_uid",
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` without exact copies, columns unchanged."""
    frame, names = pinned(df)
    kept = exact_dedup(frame, *place_of(df, id_col, text_col), uid="_uid").filter("kept").select("_uid")
    return frame.join(kept, "_uid", "left_semi").select(*names)
