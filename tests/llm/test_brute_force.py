"""Results of the queries against plain Python, on whole small tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import regex
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
import public_tokenizers
from gridflow.llm import chat, exact_dedup, importance, language, mixing, packing, pieces, simhash, topk
from gridflow.llm.components import components
from gridflow.llm.pieces import PieceCodec
from gridflow.llm.queries import QUERIES
from test_near_copies import survivors

SF = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(MODEL)


def test_pack_is_lossless_and_tight(spark, docs):
    packed = QUERIES["op1_pack"](spark, SF)
    rows = packed.collect()
    code = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = {d[0]: code.encode_ordinary(d[1]) for d in docs}
    got = defaultdict(list)
    for r in packing.unpack_tokens(packed).orderBy("doc_id", "chunk").collect():
        got[r.doc_id].extend(np.frombuffer(r.ids, "<u2").tolist())
    assert got == {k: v for k, v in want.items() if v}
    for r in rows:
        assert np.diff([*r.cu_seqlens]).min() > 0 and r.resets[0] == 0
        assert (np.frombuffer(r.input_ids, "<u2")[r.n_tokens :] == 0).all()
    for group, n in Counter(r.group for r in rows).items():
        assert n <= 1.05 * sum(r.n_tokens for r in rows if r.group == group) / packing.ROW_TOKENS + 1


@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_takes_the_fullest_row(lengths):
    rows, free = [], []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fit = [f for f in free if f >= lengths[k]]
        if fit:
            free[free.index(min(fit))] -= lengths[k]
        else:
            free.append(50 - lengths[k])
    rows = packing.best_fit(lengths, 50)
    assert sorted(k for r in rows for k in r) == list(range(len(lengths)))
    assert sorted(50 - sum(lengths[k] for k in r) for r in rows) == sorted(free)


def test_language_held_out(spark, docs):
    lang = {d[0]: d[2] for d in docs}
    rows = QUERIES["op3_language"](spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) >= 0.98


def test_quality_parts_good_from_bad(spark):
    quality = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    rows = {r.doc_id: r for r in QUERIES["op5_quality"](spark, SF).collect()}
    good = [rows[k].kept for k, q in quality.items() if q == 1]
    bad = [rows[k].kept for k, q in quality.items() if q == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.02
    cut = sorted((r.key for r in rows.values()), reverse=True)[sum(r.kept for r in rows.values()) - 1]
    assert all(r.kept == (r.key >= cut) for r in rows.values())


def plain_grams(text):
    """Buckets of the n-grams of a text, order by order, one n-gram at a time."""
    words = [w[k : k + 64] for w in (text or "").split() for k in range(0, len(w), 64)]
    forms, plain, before = [], [], None
    for w in words:
        bare = w.rstrip(".,")
        if bare.isalpha() and len(bare) >= len(w) - 1:
            form, letters = importance.shape(bare) + w[len(bare) :], bare
            form = "Aa" + w[len(bare) :] if bare.istitle() and not bare.isupper() else form
        else:
            form, letters = importance.shape(w), "".join(c for c in w if c.isalnum()) or w
        letters = zlib.crc32(letters.lower().encode()) >> 1
        forms.append(zlib.crc32(form.encode()) + (1 << 33 if letters == before else 0))
        plain.append(letters)
        before = letters
    out = []
    for units, sizes in ((forms, importance.FORM_BITS), (plain, importance.WORD_BITS)):
        for order, bits in enumerate(sizes, 1):
            found = []
            for at in range(len(units) - order + 1):
                h = 0
                for k in range(order):
                    h = (h ^ (units[at + k] + k + 1)) * importance.MIX[k] % (1 << 64)
                    h ^= h >> 29
                found.append(h >> 64 - bits)
            out.append(found)
    return out


def test_quality_models_equal_plain_counts(spark, docs):
    """Both n-gram models and the weights, counted one n-gram at a time in plain Python."""
    some = [(d[0], d[1]) for d in docs[:150] if len(d[1]) < 4000] + [(-1, ""), (-2, None), (-3, "one"), (-4, "one one"), (-5, "x{1}=" * 40)]
    good = {k for k, _ in some if k % 3 == 0}
    frame = spark.createDataFrame(some, "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(k, int(k in good)) for k, _ in some if k >= 0], "doc_id bigint, quality int")
    ratios = importance.fit(frame, labels, "doc_id", "text", 1000)
    raw, target = ([Counter() for _ in importance.BITS] for _ in range(2))
    for k, text in some:
        for order, found in enumerate(plain_grams(text)):
            raw[order].update(found)
            target[order].update(found if k in good and k >= 0 else [])
    want = []
    for order, bits in enumerate(importance.BITS):
        smooth = 500.0 + (4.0 * len(raw[order]) if order >= 3 else 0)
        whole, size = sum(target[order].values()), sum(raw[order].values())
        p = lambda b, o=order, n=size, m=1 << bits: (raw[o][b] + 1e-9) / (n + 1e-9 * m)
        want.append({b: np.log((target[order][b] + smooth * p(b)) / (whole + smooth)) - np.log(p(b)) for b in raw[order]})
        assert np.allclose([ratios[order][b] for b in raw[order]], [want[order][b] for b in raw[order]])
    got = {r.doc_id: r.log_weight for r in importance.weighted(frame, "text", ratios).collect()}
    for k, text in some:
        grams = plain_grams(text)
        mean = sum(np.mean([want[o][b] for b in found]) for o, found in enumerate(grams) if found)
        assert got[k] == pytest.approx(importance.EVIDENCE * mean if grams[0] else importance.NO_WORDS)


def test_inclusion_follows_the_weights(spark):
    """Rates of inclusion of rows of equal weight, for several seeds and sizes, against 1 - exp(-exp(w - cut))."""
    from pyspark.sql import functions as F

    rows = spark.range(24_000).select(F.col("id"), (-(F.col("id") % 4) * 1.5).alias("w"))
    taken = {}
    for seed, size in ((1, 6000), (2, 6000), (3, 12_000)):
        keyed = importance.stored(rows.withColumn("key", F.col("w") + importance.gumbel("id", seed)), "test")
        cut = importance.kth_largest(keyed, "key", size)
        taken[seed] = {r.id for r in keyed.filter(F.col("key") >= cut).collect()}
        assert len(taken[seed]) == size
        for k in range(4):
            rate = sum(i % 4 == k for i in taken[seed]) / 6000
            assert abs(rate - (1 - np.exp(-np.exp(-1.5 * k - cut)))) < 0.025
    assert len(taken[1] & taken[2]) < 5000


def test_noise_takes_part(spark):
    """On documents some rows are taken against a plain cut of the weights, and few of those labelled good are lost."""
    rows = QUERIES["op5_quality"](spark, "/root/testdata/sf0.1").collect()
    plain = sorted((r.log_weight for r in rows), reverse=True)[sum(r.kept for r in rows) - 1]
    changed = sum(r.kept != (r.log_weight >= plain) for r in rows)
    assert 0 < changed < 0.01 * len(rows)


def plain_language_model(rows, lengths):
    """Word and n-gram counts of (text, lang) rows by language, in plain Python."""
    langs = sorted({lang for _, lang in rows})
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for text, lang in rows:
        for w in regex.findall(r"\p{L}+", text.lower()):
            words[lang][w] += 1
            for n in lengths:
                for k in range(len(w) + 3 - n):
                    if (g := f" {w} "[k : k + n]).strip():
                        grams[lang, n][g] += 1
    return langs, words, grams


def test_language_scores(spark):
    """Every score against plain counts, backing off one word at a time; the tables hold all entries here."""
    rows = duckdb.sql("select doc_id, text, lang from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    held = {k: zlib.crc32(str(k).encode()) % 5 == 0 for k, _, _ in rows}
    langs, words, grams = plain_language_model([(t, lang) for k, t, lang in rows if not held[k] and t and lang], language.LENGTHS)
    assert max(len(set().union(*words.values())), 0) < language.WORDS
    cut = {}
    for n in language.LENGTHS:  # the entries with the largest shares, as many as the model holds
        total = {lang: sum(grams[lang, n].values()) for lang in langs}
        share = Counter()
        for lang in langs:
            for g, c in grams[lang, n].items():
                share[g] += c / total[lang]
        order = sorted(share, key=lambda g: (-share[g], g.encode()))
        cut[n] = set(order[: language.GRAMS])
    kept = {n: {lang: sum(c for g, c in grams[lang, n].items()) for lang in langs} for n in language.LENGTHS}

    def log(count, total, size):
        return np.log((count + 0.5) / (total + 0.5 * size))

    def score(w):
        if any(w in words[lang] for lang in langs):
            return np.array([log(words[lang][w], sum(words[lang].values()), language.WORDS) for lang in langs])
        for n in language.LENGTHS:
            found = [g for k in range(len(w) + 3 - n) if (g := f" {w} "[k : k + n]) in cut[n]]
            if found:
                return np.mean([[log(grams[lang, n][g], kept[n][lang], language.GRAMS) for lang in langs] for g in found], axis=0)
        return np.zeros(len(langs))

    got = {r.doc_id: r for r in QUERIES["op3_language"](spark, "/root/testdata/sf0.001").collect()}
    for k, text, _ in rows[:60]:
        found = regex.findall(r"\p{L}+", (text or "").lower())
        if not found:
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
            continue
        total = sum(score(w) for w in found)
        p = np.exp(total - total.max())
        assert got[k].lang_pred == langs[int(total.argmax())] and got[k].score == pytest.approx(1 / p.sum(), abs=1e-6)


@pytest.mark.parametrize("text", ["½ ² ①", "Ⅷ ⅻ", "123 _ !", "\u0301"])
def test_numbers_are_no_letters(text):
    assert language.words_of(text) == []


@given(st.text(st.sampled_from("aB ½²①Ⅷé日_1-ßİ"), max_size=30))
def test_words_are_runs_of_letters(text):
    assert language.words_of(text) == regex.findall(r"\p{L}+", text.lower())


@given(st.lists(st.floats(-1e3, 1e3), min_size=1, max_size=50), st.integers(1, 50))
@settings(max_examples=8, deadline=None)
def test_kth_largest(spark, values, k):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert importance.kth_largest(df, "x", k) == sorted(values, reverse=True)[min(k, len(values)) - 1]


def test_pieces_equal_the_library(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = {r.doc_id: r for r in QUERIES["op7_pieces"](spark, SF).collect()}
    for doc_id, text, _, _ in docs:
        ids, r = sp.encode(text), rows[doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


@given(st.text(st.sampled_from("ab▁ \n\t0<>x/é日\x00﻿\U0001f600theionr"), max_size=60))
@settings(max_examples=500, deadline=None)
def test_pieces_of_any_text(codec, text):
    sp = LIBRARY
    assert codec.encode(text) == sp.encode(text) and codec.decode(sp.encode(text)) == sp.decode(sp.encode(text))


@given(st.lists(st.one_of(st.integers(0, 260), st.integers(0, 31999)), max_size=12))
@settings(max_examples=500, deadline=None)
def test_decoding_any_ids(codec, ids):
    assert codec.decode(ids) == LIBRARY.decode(ids)


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_long_words(codec):
    for text in ("the" * 5000, "a" * 20_000, " " * 3000, "ATATTTTA" * 900):
        assert codec.encode(text) == LIBRARY.encode(text)


def test_shards(spark, docs):
    rows = QUERIES["op8_shards"](spark, SF).collect()
    text, source = {d[0]: d[1] for d in docs}, {d[0]: d[3] for d in docs}
    assert len(rows) == len(docs) and {r.law for r in rows} == {"rows"}
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for r in rows:
        data = text[r.doc_id].encode()
        assert r["size"] == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
    for name, n in Counter(source.values()).items():
        held = [sum(source[r.doc_id] == name for r in rows if r.shard == s) for s in counts]
        assert max(held) <= n / 16 + 1 and min(held) >= n / 16 - 1


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles))


def reach(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def near_pairs(fps, distance=4):
    fps = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= distance) + i + 1:
            yield i, int(j)


def test_simhash(spark, docs):
    rows = {r.doc_id: r for r in QUERIES["op9_simhash"](spark, SF).collect()}
    ids = sorted(rows)
    text = {d[0]: d[1] for d in docs}
    for k in ids[::4]:
        assert int(rows[k].fingerprint, 16) == plain_fingerprint(text[k])
    roots = reach(len(ids), near_pairs([int(rows[k].fingerprint, 16) for k in ids]))
    assert [rows[k].component_id for k in ids] == [ids[r] for r in roots]


@pytest.mark.parametrize("tile", [16, 4096])
def test_simhash_dense_and_chained(spark, tile):
    """Large near-copy groups, chains of links at four bits, and tiles of crowded cells."""
    rng = np.random.default_rng(tile)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 300)]
    for base in fps[:3]:
        for _ in range(200):
            fps.append(base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)))
    chain = fps[10]
    for _ in range(40):
        chain ^= sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        fps.append(chain)
    fps = sorted(set(fps))
    signed = [simhash.signed(x) for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), tile=tile).collect()
    at = {x: k for k, x in enumerate(signed)}
    assert reach(len(fps), [(at[r.a], at[r.b]) for r in found]) == reach(len(fps), near_pairs(fps))


@given(st.integers(0, (1 << 64) - 1), st.integers(0, (1 << 64) - 1))
def test_counts_bound_the_distance(a, b):
    codes = simhash.code_of(np.array([a, b], np.uint64))
    count = lambda x: np.array([bin(x >> k & 3).count("1") for k in range(0, 64, 2)])
    manhattan = int(np.abs(count(a) - count(b)).sum())
    assert manhattan == int(np.bitwise_count(codes[0] ^ codes[1])) <= bin(a ^ b).count("1")


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(k, k + 1) for k in range(300, 420)] + [(0, k) for k in range(1, 200)] + rng.integers(500, 900, (250, 2)).tolist()
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "a bigint, b bigint")
    want = reach(900, pairs)
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {k: want[k] for k in range(900) if want[k] != k}
    assert components(edges.limit(0)).count() == 0


def test_mix_follows_targets_and_schedule(spark, docs):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(df).collect()
    source = {d[0]: d[3] for d in docs}
    taken, target = Counter(), {}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    total = sum(r["size"] for r in rows)
    assert abs(sum(target.values()) - 1.5 * total) < 1e-3
    places = [c.position for r in rows for c in r.copies if c.words]
    assert min(places) >= 0 and max(places) <= 1
    names = sorted(target)
    shown = {r.doc_id: (r.position_micro, r.repeat_position_micro) for r in QUERIES["op10_mix"](spark, SF).collect()}
    for r in rows:
        assert shown[r.doc_id] == tuple(int(c.position * 1e6) if c.words else None for c in r.copies)
    heavy, light = names[0::3], names[2::3]
    half = lambda group: np.mean([c.position < 0.5 for r in rows if source[r.doc_id] in group for c in r.copies if c.words])
    assert half(heavy) < 0.5 < half(light)  # heavy sources rise over time, light ones fall


@given(st.integers(0, 2), st.integers(0, 1000))
@settings(max_examples=30, deadline=None)
def test_position_inverts_the_schedule(spark, place, share):
    from pyspark.sql import functions as F

    share /= 1000
    time = spark.range(1).select(mixing.position(F.lit(share), F.lit(place)).alias("t")).first().t
    knots = mixing.SCHEDULES[place]
    t = np.linspace(0, 1, 20_001)
    w = np.interp(t, *zip(*knots))
    area = np.r_[0, np.cumsum((w[1:] + w[:-1]) / 2)] / ((w[1:] + w[:-1]) / 2).sum()
    assert abs(np.interp(time, t, area) - share) < 1e-3


@pytest.mark.parametrize("block_bytes", [512 * 3, 16 << 20])
def test_top_products(spark, block_bytes):
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    v = {k: np.floor(256 * np.array(e, float)).astype(int) for k, e in data}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_products(df, F.col("vec_id") % 50 == 0, block_bytes=block_bytes).collect()}
    want = {}
    for q in (k for k in v if k % 50 == 0):
        best = sorted(((-int(v[q] @ v[k]), k) for k in v if k != q))[:5]
        want |= {(q, n): (k, -s) for n, (s, k) in enumerate(best, 1)}
    assert got == want


@pytest.mark.parametrize("bits", [24, 27, 30, 31])
def test_large_components(spark, bits):
    """Whole-number components up to 2**bits against Python integers: scores that doubles round, with close ones and ties."""
    rng = np.random.default_rng(bits)
    data = [(k, [int(x) for x in rng.integers((1 << bits) - 40, 1 << bits, 6)]) for k in range(120)]
    data += [(200 + k, data[k][1]) for k in range(20)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in data], "vec_id bigint, embedding array<double>").repartition(6)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_products(df, F.col("vec_id") % 50 == 0, scale=1).collect()}
    want = {}
    for q, a in data:
        if q % 50 == 0:
            best = sorted((-min(sum(x * y for x, y in zip(a, b)), (1 << 63) - 1), k) for k, b in data if k != q)[:5]
            want |= {(q, n): (k, -s) for n, (s, k) in enumerate(best, 1)}
    assert got == want


@pytest.mark.parametrize("fan_in", [2, 16])
def test_many_rounds_of_runs(spark, fan_in):
    """Forty runs, so that binary merges take six rounds, with groups in many runs."""
    rng = np.random.default_rng(fan_in)
    rows = [(int(k), f"text {int(x)}") for k, x in enumerate(rng.zipf(1.3, 3000) % 400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(40)
    groups = defaultdict(list)
    for k, t in rows:
        groups[t].append(k)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df, fan_in=fan_in).collect()}
    assert got == {k: (min(groups[t]), len(groups[t]), k == min(groups[t])) for k, t in rows}


def test_neighbouring_pieces(codec, docs, monkeypatch):
    """Undoing merges tells what merging anew tells, so that texts are encoded without merging any pair."""
    split = [codec.split(w) for w in {w for d in docs[:60] for w in codec.cut(d[1] or "")}]
    found = [p for parts in split for p in zip(parts, parts[1:])]
    rng = np.random.default_rng(3)
    known = [p for p in codec.score if len(p) == 1 or p in codec.halves]
    short = [p for p in known if len(p) <= 3]
    some = [(a, b) for n in (known, short) for a, b in zip(rng.choice(n, 3000), rng.choice(n, 3000))]
    for a, b in [*found[:3000], *some, *((a, a) for a in short[:1000])]:
        assert codec.parted(a, b) == (codec.merged(a + b) == [a, b])
    fresh = PieceCodec(MODEL)
    monkeypatch.setattr(fresh, "merged", None)
    for d in docs[:60]:
        assert fresh.encode(d[1]) == LIBRARY.encode(d[1])


def test_decoded_text_comes_from_the_ids(codec, monkeypatch):
    """A decoder that is broken shows in the digests of every text."""
    make = pieces.PieceCodec(MODEL)
    make.text_of = lambda ids: "broken"
    assert make.shown("▁the") == (",".join(map(str, make.ids(make.split("▁the")))), "broken")
    assert codec.shown("▁a")[1] == " a"


@given(st.text(st.sampled_from("<|\\ai\n"), max_size=12))
@settings(max_examples=25, deadline=None)
def test_escapes_are_reversible(spark, text):
    from pyspark.sql import functions as F

    row = spark.range(1).select(chat.escape(F.lit(text)).alias("e"), chat.unescape(chat.escape(F.lit(text))).alias("u"),
                                chat.unescape_role(chat.escape_role(F.lit(text + "%0A"))).alias("r")).first()
    assert "<|" not in row.e and row.u == text and row.r == text + "%0A"


def test_pipeline(spark, docs):
    """Each stage against what plain Python makes of its input."""
    stage, frame = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, function in corpus_pipeline.STAGES:
        frame = corpus_pipeline.stored(function(spark, frame, SF), "test")
        stage[name] = frame.collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    quality, exact, near, mixed, tokens = (stage[n] for n in names)
    kept = {r.doc_id for r in QUERIES["op5_quality"](spark, SF).filter("kept").collect()}
    assert {r.doc_id for r in quality} == kept
    first = {}
    for r in sorted(quality, key=lambda r: r.doc_id):
        first.setdefault(normal(r.text), r.doc_id)
    assert {r.doc_id for r in exact} == set(first.values())
    text = {r.doc_id: r.text for r in exact}
    assert {r.doc_id for r in near} == survivors(list(text.items()))
    sizes, source = {r.doc_id: len(r.text.encode().split()) for r in near}, {r.doc_id: r.source for r in near}
    words = Counter()
    for r in mixed:
        words[r.doc_id] += len(r.text.encode().split())
        assert text[r.doc_id] == r.text or sizes[r.doc_id] > len(r.text.encode().split())
    assert all(words[k] <= 2 * sizes[k] for k in words) and abs(sum(words.values()) - 1.5 * sum(sizes.values())) <= len(set(source.values()))
    count = Counter()
    for r in mixed:
        count[r.doc_id, hashlib.sha256(LIBRARY.decode(LIBRARY.encode(r.text)).encode()).hexdigest(), len(LIBRARY.encode(r.text))] += 1
    assert count == Counter((r.doc_id, r.decoded_sha256, r.n_tokens) for r in tokens)


def normal(text):
    out, blank = [], False
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            if not blank:
                out.append(" ")
            blank = True
        else:
            out.append(c)
            blank = False
    return "".join(out)
