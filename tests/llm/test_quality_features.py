"""Quality weights see the words themselves, and whole tokens."""

import numpy as np

from gridflow.llm import importance


def sample(spark, texts, labelled):
    """Kept ids; of `texts` ((text, good), ...) every row but each third is labelled."""
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(texts[k][1])) for k in labelled], "doc_id bigint, quality int")
    rows = importance.resample(docs, labels)[0].collect()
    assert {r.doc_id for r in importance.keep_sample(docs, labels).collect()} == {r.doc_id for r in rows if r.kept}
    return {r.doc_id for r in rows if r.kept}


def test_bad_rows_that_differ_by_words_only(spark):
    """Plain lower-case sentences of equal length, punctuation and repetition; unlabelled rows are judged alike."""
    rng = np.random.default_rng(3)
    vocabulary = [[f"{a}{b}{c}" for a in first for b in "aeiou" for c in "lmn"] for first in ("bcd", "fgh")]
    texts = []
    for k in range(240):
        words = rng.permutation(vocabulary[k % 2])[:40]
        texts.append((" ".join(words) + ".", k % 2 == 0))
    kept = sample(spark, texts, [k for k in range(240) if k % 3])
    assert kept == {k for k in range(240) if texts[k][1]}


def test_whole_tokens_are_judged():
    """Texts without spaces that differ behind their first 64 characters only."""
    rng = np.random.default_rng(4)
    ratios = [rng.normal(size=1 << b) for b in importance.BITS]
    weigh = lambda *texts: importance.log_weights(list(texts), ratios, importance.Features())
    start = "x{1}=" * 13
    for a, b in ((start + "a;b;" * 50, start + "7-7-" * 50), ("。漢字" * 30 + "、仮名" * 30, "。漢字" * 30 + "!1?2" * 30)):
        assert len(set(weigh(a, b, a[:64]))) == 3
    pieces = [start[k : k + importance.PIECE] for k in range(0, len(start), importance.PIECE)]
    assert weigh(start) == weigh(" ".join(pieces))
    assert importance.shape("aB1" * 40 + "#") == "aA0" * 40 + "#"
