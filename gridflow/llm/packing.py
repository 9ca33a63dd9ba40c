"""Token ids packed into fixed rows by best-fit decreasing, with a segment tree over free capacity."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridflow.llm.common import numbered

ROW_TOKENS = 2048
#: Tokens that are packed together in one task.
GROUP_TOKENS = 1 << 21
BATCH = 256
KINDS = (
    "group bigint, row int, n_tokens int, n_segments int, input_ids binary, cu_seqlens array<int>, resets array<int>, "
    "doc_ids array<bigint>, chunks array<int>"
)


def encoder(rank_file: str, pattern: str):
    """Byte-level BPE of a public vocabulary of ranks (base64 token, rank on each line)."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Capacities:
    """A segment tree over free capacities 0..size: how many open rows have each."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, need: int) -> int:
        """Smallest capacity of at least `need` that an open row has, or -1."""
        at, count = need + self.leaves, self.count
        if count[at]:
            return need
        while at > 1:  # up to the first right sibling with rows, then down its left side
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of segment numbers: longest first, each into the fullest row that still holds it."""
    tree, rows, open_rows, free = Capacities(size), [], {}, []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        room = tree.least(lengths[k])
        if room < 0:
            row, room = len(rows), size
            rows.append([])
            free.append(size)
        else:
            row = open_rows[room].pop()
            tree.add(room, -1)
        rows[row].append(k)
        free[row] = room - lengths[k]
        open_rows.setdefault(free[row], []).append(row)
        tree.add(free[row], 1)
    return rows


def token_chunks(df: DataFrame, rank_file: str, pattern: str, id_col: str, text_col: str, size: int, groups: int) -> DataFrame:
    """(group, uid, doc_id, chunk, n, ids): every text's ids as little-endian uint16 or uint32, cut at `size` ids."""
    rows = numbered(df).select("_uid", F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(rank_file, pattern)
        kind = "<u2" if code.max_token_value < 1 << 16 else "<u4"
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                out: list[tuple] = []
                for uid, doc, text in zip(*(c.to_pylist() for c in part.columns)):
                    ids = np.array(code.encode_ordinary(text), kind) if text else np.zeros(0, kind)
                    for chunk, start in enumerate(range(0, len(ids), size)):
                        piece = ids[start : start + size]
                        out.append(((uid * 0x9E3779B1 + chunk * 0x85EBCA77 >> 13) % groups, uid, doc, chunk, len(piece), piece.tobytes()))
                if out:
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), types)], names=["group", "uid", "doc_id", "chunk", "n", "ids"]
                    )

    return rows.mapInArrow(run, "group bigint, uid bigint, doc_id bigint, chunk int, n int, ids binary")


def pack_tokens(
    df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = ROW_TOKENS,
    pad: int = 0, group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """Rows of a packed id matrix: group, row, n_tokens, n_segments, input_ids, cu_seqlens, resets, doc_ids, chunks.

    `input_ids` holds `size` little-endian ids (2 bytes each, or 4 for a vocabulary beyond
    65,536), `pad` after the last segment. `cu_seqlens` are the cumulative segment lengths
    from 0, `resets` the offsets where position ids start again at 0 (the padding starts
    again too). Segment k is chunk `chunks[k]` of document `doc_ids[k]`: texts beyond
    `size` ids are cut into chunks of `size`, so joining a document's chunks in order gives
    its ids back. Groups of about `group_tokens` ids, dealt by a hash of row number and
    chunk, are packed on their own, so a very long text is spread over many groups.

    Null and empty texts have no ids and are in no row. Null ids stay null in `doc_ids`;
    repeated rows are packed each. Other columns are ignored; an empty table gives none.
    """
    size_of = df.agg(F.sum(F.octet_length(text_col)).alias("b")).first().b or 0
    groups = max(1, -(-size_of // (3 * group_tokens)))
    chunks = token_chunks(df, rank_file, pattern, id_col, text_col, size, groups)

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("uid", "ascending"), ("chunk", "ascending")])
        lengths = table.column("n").to_pylist()
        ids, doc, chunk = (table.column(c).to_pylist() for c in ("ids", "doc_id", "chunk"))
        wide = len(ids[0]) // lengths[0]
        blank = np.array([pad], f"<u{wide}").tobytes()
        group = table.column("group")[0].as_py()
        out = []
        for number, row in enumerate(best_fit(lengths, size)):
            ends = np.cumsum([0, *(lengths[k] for k in row)]).tolist()
            line = b"".join([ids[k] for k in row]) + blank * (size - ends[-1])
            resets = ends[:-1] + ([ends[-1]] if ends[-1] < size else [])
            out.append((group, number, ends[-1], len(row), line, ends, resets, [doc[k] for k in row], [chunk[k] for k in row]))
        ints = pa.list_(pa.int32())
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), ints, ints, pa.list_(pa.int64()), ints]
        names = [part.split()[0] for part in KINDS.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    # at least a partition for each group: a task's share does not grow with the input
    n = max(groups, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return chunks.repartition(n, "group").groupBy("group").applyInArrow(pack, KINDS)


def write_packed(df: DataFrame, path: str, **options) -> DataFrame:
    """Write the packed matrix as Parquet and give it back as written."""
    pack_tokens(df, **options).write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def unpack_tokens(packed: DataFrame, id_bytes: int = 2) -> DataFrame:
    """(doc_id, chunk, n, ids) of every segment of a packed matrix whose ids take `id_bytes` bytes."""
    segment = F.transform(
        F.sequence(F.lit(0), F.col("n_segments") - 1),
        lambda k: F.struct(
            F.get("doc_ids", k).alias("doc_id"), F.get("chunks", k).alias("chunk"), F.get("cu_seqlens", k).alias("start"),
            (F.get("cu_seqlens", k + 1) - F.get("cu_seqlens", k)).alias("n"),
        ),
    )
    rows = packed.filter("n_segments > 0").select("input_ids", F.explode(segment).alias("s"))
    ids = F.substring("input_ids", F.col("s.start") * id_bytes + 1, F.col("s.n") * id_bytes)
    return rows.select("s.doc_id", "s.chunk", "s.n", ids.alias("ids"))
