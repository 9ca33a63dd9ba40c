"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import re

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from gridflow.llm import chat, exact_dedup, importance, language, mixing, packing, pieces, sharding, simhash, topk

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Names that the operators use themselves.
CLASHES = [
    "_uid", "_id", "_text", "_run", "_n", "_c0", "_copy", "_size", "_noise", "kept", "size", "target", "shard", "slot",
    "fp", "log_weight", "key", "n_tokens", "lang_pred", "score", "_order", "copies", "group",
]
LONG = "word " * 60_000
ROWS = [
    (1, "the cat  sat", "en", "a"), (2, "the cat\tsat", "en", "a"), (2, "the cat\tsat", "en", "a"), (3, None, "de", None),
    (4, "", None, "b"), (None, "the cat sat", "de", "b"), (None, None, None, None), (5, LONG, "en", "a"),
    (6, " ", "de", "a"), (7, "das ist ein Satz", "de", ""), (8, "123 !!!", "en", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string")
    for k, name in enumerate(CLASHES):
        df = df.withColumn(name, F.lit(f"x{k}"))
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 1, None), (8, 0, 0), (None, 1, 1), (9, None, 0)], "doc_id bigint, quality int, toxic int")


def test_exact_dedup(docs, none):
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == len(ROWS)
    cats = [r for r in rows if r.group_size == 4]
    assert len(cats) == 4 and {r.keep_id for r in cats} == {1} and [r.doc_id for r in cats if r.kept] == [1]
    blank = [r for r in rows if r.group_size == 3]  # null, empty and a null id; " " is one space, not empty
    assert {r.keep_id for r in blank} == {3} and sum(r.kept for r in blank) == 1
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == 6
    assert {r["_uid"] for r in kept.collect()} == {"x0"}
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(5, "a b")] * 7 + [(None, "c")] * 3, "doc_id bigint, text string").repartition(5)
    rows = exact_dedup.exact_dedup(df.select("doc_id", "text")).collect()
    assert sum(r.kept for r in rows) == 2 and {(r.keep_id, r.group_size) for r in rows} == {(5, 7), (None, 3)}


def test_simhash(docs, none):
    rows = simhash.near_components(docs).collect()
    assert len(rows) == len(ROWS)
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {3} and sum(r.first for r in zero) == 1
    cats = [r for r in rows if r.component_id == 1]
    assert len(cats) == 4
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.component_id for r in rows})
    assert simhash.near_components(none).count() == 0


def test_language(docs, none):
    rows = language.predict(docs, language.fit(docs, F.lit(True))).collect()
    found = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert found[7].lang_pred == "de" and found[5].lang_pred == "en"
    for k in (3, 4, 6, 8):
        assert found[k].lang_pred == "und" and found[k].score == 0
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    nothing = language.fit(none, F.lit(True))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(none, nothing).count() == 0


def test_quality(docs, none, labels, spark):
    rows = importance.resample(docs, labels)[0].collect()
    assert len(rows) == len(ROWS) and not any(r.kept for r in rows if r.doc_id in (3, 4, 6))
    assert importance.resample(docs, labels, rows=len(ROWS))[0].filter("kept").count() == len(ROWS)
    assert importance.resample(docs, labels, rows=0)[0].filter("kept").count() == 0
    kept = importance.keep_sample(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)
    assert {r["_noise"] for r in kept.collect()} == {f"x{CLASHES.index('_noise')}"}
    unlabelled = importance.keep_sample(docs, labels.limit(0))
    assert unlabelled.count() == sum(bool(r[1] and r[1].strip()) for r in ROWS)
    assert importance.resample(none, labels)[0].count() == 0 and importance.keep_sample(none, labels).count() == 0


def test_pieces(docs, none):
    ids = pieces.encode_texts(docs, MODEL)
    assert ids.columns[-1] == "token_ids" and ids.filter("text is not null").count() == 0 if "text" in ids.columns else True
    texts = sorted((r.decoded for r in pieces.decode_ids(ids, MODEL).collect()))
    assert texts == sorted((r[1] or "") for r in ROWS)
    digests = pieces.digest_texts(docs, MODEL).collect()
    assert len(digests) == len(ROWS) and sum(r.n_tokens == 0 for r in digests) == 3
    assert pieces.digest_texts(none, MODEL).count() == 0


def test_packing(docs, none):
    packed = packing.pack_tokens(docs, RANKS, public_tokenizers.PATTERN, size=64, group_tokens=4096)
    rows = packed.collect()
    assert all(len(r.input_ids) == 128 and r.n_tokens <= 64 and r.cu_seqlens[-1] == r.n_tokens for r in rows)
    parts = packing.unpack_tokens(packed).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in parts} == {None, 1, 2, 5, 6, 7, 8}
    assert packing.pack_tokens(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_sharding(docs, none, tmp_path):
    rows = sharding.assign_shards(docs, 4).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(4) for k in range(3 if s != 3 else 2)]
    assert sorted(r["size"] for r in rows if r.doc_id in (3, 4)) == [1, 1]
    assert sharding.assign_shards(none).count() == 0
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ROWS) and {r["_uid"] for r in back.collect()} == {"x0"}


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert {r.source_size for r in rows if r.doc_id == 3} == {0} and {r.target for r in rows if r.doc_id == 3} == {0.0}
    order = mixing.training_order(docs)
    assert order.columns == docs.columns
    words = sum(len(r.text.split()) for r in order.collect())
    assert words == sum(r.taken for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.training_order(none).count() == 0


def test_top_products(spark):
    data = [
        (0, [1.0, 0.0]), (50, [0.5]), (1, [2.0, None]), (2, [float("nan"), 1.0]), (3, [float("inf"), 0.0]), (4, None),
        (None, [9.0, 9.0]), (5, []), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (0, [1.0, 0.0]), (8, [1e300, 0.0]),
    ]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumn("length", F.lit("x")).withColumn("v", F.lit(1))
    rows = topk.top_products(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    first = [(r.vec_id, r.score) for r in rows if r.query_id == 0]
    assert first == [(8, (1 << 63) - 1), (None, 589824), (6, 65536), (7, 65536), (7, 65536)]
    assert [r.vec_id for r in rows if r.query_id == 50][:4] == [8, None, 0, 0]
    assert topk.top_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_chat_events(spark):
    events = [
        (1, 0, 0, "delta", "user", "Hi"), (1, 1, 1, "delta", "assistant", "Hel"), (1, 2, 1, "delta", None, "lo"),
        (1, 3, 1, "regenerate", None, "Good "), (1, 4, 1, "delta", None, "day"), (1, 5, 2, "delta", "user", "lost"),
        (1, 6, 0, "edit", None, "Hey"), (1, 7, 1, "delta", "assistant", "Yes <|im_end|> \\<|x<\\|y"),
        (2, None, None, None, None, None), (None, 0, 0, "delta", "a\nb%", "t<"), (None, 1, 2000, "delta", "assistant", "|z"),
    ]
    log = spark.createDataFrame(
        [(c, s, t, 0, k, r, x, "extra") for c, s, t, k, r, x in events],
        "conv_id bigint, seq bigint, turn bigint, msg bigint, kind string, role string, text string, _log string",
    )
    out = {r.conv_id: [(t.role, t.text, t.loss) for t in r.turns] for r in chat.read_back(chat.format_chats(log)).collect()}
    assert out == {
        1: [("user", "Hey", False), ("assistant", "Yes <|im_end|> \\<|x<\\|y", True)],
        2: [("", "", False)],
        None: [("a\nb%", "t<", False), ("assistant", "|z", True)],
    }
    shown = chat.format_chats(log).collect()
    plain = lambda x: re.sub(r"<\\(\\*)\|", r"<\1|", x)
    texts = {r.conv_id: r.loss_text for r in chat.read_back(chat.format_chats(log)).collect()}
    for r in shown:
        marked = [plain(r.formatted[s.start : s.end]) for s in r.spans if s.loss]
        assert marked == [t[1] for t in out[r.conv_id] if t[2]] and "".join(marked) == texts[r.conv_id]
    # the mask decides: without its places no text is under it
    nowhere = F.transform("spans", lambda s: F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"), s["loss"].alias("loss")))
    blank = chat.read_back(chat.format_chats(log).withColumn("spans", nowhere)).collect()
    assert {r.loss_text for r in blank} == {""}
    assert chat.format_chats(log.limit(0)).count() == 0
