from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gridflow.llm import mixing
from gridflow.llm.queries import QUERIES


def test_time_is_the_share_of_words_read(spark):
    """Against the words themselves: what lies before a copy in reading order, over all words of the mix."""
    rng = np.random.default_rng(4)
    sources = ["a"] * 900 + ["b"] * 400 + ["c"] * 300 + ["d"] * 50 + [None] * 20
    rows = [(k, s, " ".join("w" * int(n))) for k, (s, n) in enumerate(zip(sources, rng.integers(1, 30, len(sources))))]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    copies = sorted((c.position, c.words, c.time) for r in mixing.mix(df).collect() for c in r.copies if c.words)
    position, words, time = (np.array(x, float) for x in zip(*copies))
    read = np.cumsum(words) - words / 2
    assert np.abs(time - read / words.sum()).max() < 0.01
    assert (np.diff(time) >= -1e-12).all() and np.abs(time - position).max() > 0.05


def test_shares_of_the_sources_change_over_time(spark):
    """In every part of training the sources' words are near target times scheduled weight, which add up to the part."""
    rows = [(k, "ab"[k % 2], "w " * 10) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    found = mixing.mix(df).collect()
    target = {"ab"[r.doc_id % 2]: r.target for r in found}
    time = np.array([c.time for r in found for c in r.copies if c.words])
    words = np.array([c.words for r in found for c in r.copies if c.words])
    own = np.array([r.doc_id % 2 == 0 for r in found for c in r.copies if c.words])
    assert np.allclose(np.histogram(time, 10, (0, 1), weights=words)[0] / words.sum(), 0.1, atol=0.01)
    first, last = (words[own & part].sum() / words[part].sum() for part in (time < 0.1, time >= 0.9))
    assert first < target["a"] / sum(target.values()) < last
    assert mixing.mix(df.limit(0)).count() == 0


ODD = [
    (k, None if k % 7 == 0 else "ab"[k % 2], None if k % 11 == 0 else "" if k % 13 == 0 else " \t".join(f"w{j}" for j in range(1 + k % 9)) + "\n")
    for k in range(90)
] + [(None, "a", "one two three")]


def test_result_of_the_mix_is_read_from_the_mix(spark):
    """Words of every copy, and words before it, against the rows of the training order one by one."""
    df = spark.createDataFrame(ODD, "doc_id bigint, source string, text string").repartition(3)
    read, before, words = {}, 0, []
    for r in mixing.training_order(df).collect():
        words.append(len(r.text.split()))
        read.setdefault(r.doc_id, []).append((words[-1], before))
        before += words[-1]
    rows = mixing.mix(df).collect()
    assert len(rows) == len(ODD) and len(words) > len(ODD)
    assert {r.doc_id: [(c.words, c.before) for c in r.copies if c.words] for r in rows if r.taken} == read
    assert all(r.taken == sum(c.words for c in r.copies) and len(r.copies) == 2 for r in rows)
    assert all(c.before is None for r in rows for c in r.copies if not c.words)
    own = mixing.mix(df.withColumn("own", F.coalesce("doc_id", F.lit(1000))), uid="own").collect()
    assert sorted((r._uid, r.taken) for r in own) == sorted((1000 if r.doc_id is None else r.doc_id, r.taken) for r in rows)


def test_op10_mix_makes_the_mix(spark, tmp_path, monkeypatch):
    """The query's words are those of the texts that training reads, not of the plan."""
    df = spark.createDataFrame(ODD[:-1], "doc_id bigint, source string, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    right = {r.doc_id: r.taken for r in QUERIES["op10_mix"](spark, str(tmp_path)).collect()}
    copies = Counter(r.doc_id for r in mixing.training_order(df).collect())
    assert sum(right.values()) > sum(copies.values()) > 0
    real = mixing.as_read
    monkeypatch.setattr(mixing, "as_read", lambda *a: real(*a).withColumn("_read", F.lit("one")))
    found = QUERIES["op10_mix"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.taken for r in found} == {k: copies[k] for k in right}
