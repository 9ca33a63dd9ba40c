"""Language identification by word frequencies, backing off to shorter and shorter n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridflow.llm.common import stored
from gridflow.session import in_threads

#: Labelled rows per language that the model is fitted on, at most about; a model parameter.
TRAIN_ROWS = 1500
#: Entries of the model, the most frequent over all languages: words, and n-grams of each length.
WORDS, GRAMS = 40_000, 20_000
#: Lengths of n-grams, longest first; words are padded with one space on each side.
LENGTHS = (5, 4, 3, 2, 1)
#: Languages a model may have.
LANGUAGES = 200
UNKNOWN = "und"
#: Word characters but digits and underscores: letters, and number signs such as superscripts, which `words_of` parts.
LETTERS = re.compile(r"[^\W\d_]+")
JAVA_LETTERS = r"\p{L}+"
BATCH = 256
#: Words whose scores a task remembers, and words of a text that are summed at a time.
KNOWN, PIECE = 150_000, 20_000
SEED = 5


def words_of(text: str | None) -> list[str]:
    """Runs of letters (all of Unicode's L classes, as in training) of a lowered text."""
    words = LETTERS.findall(text.lower()) if text else []
    if words and not "".join(words).isalpha():
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return words


class Model(dict):
    """Log frequencies per language of known words and n-grams.

    As a dictionary it gives the row of `scores` that holds a word's score; row 0, zero for
    every language, stands for words without known n-grams. It forgets all words when full.
    """

    def __init__(self, languages: list[str], tables: list[dict[str, np.ndarray]], lengths=LENGTHS):
        super().__init__()
        self.languages, self.tables, self.lengths = languages, tables, lengths
        self.scores = np.zeros((KNOWN + 1, max(1, len(languages))))

    def __missing__(self, word: str) -> int:
        found = self.score(word)
        row = 0
        if found is not None:
            row = len(self) + 1
            self.scores[row] = found
        self[word] = row
        return row

    def score(self, word: str) -> np.ndarray | None:
        """A word's own log frequencies, or the mean over its known n-grams of the longest length that has any."""
        found = self.tables[0].get(word)
        if found is not None:
            return found
        padded = f" {word} "
        for n, table in zip(self.lengths, self.tables[1:]):
            grams = [g for k in range(len(padded) - n + 1) if (g := table.get(padded[k : k + n])) is not None]
            if grams:
                return sum(grams) / len(grams)
        return None

    def total(self, words: list[str]) -> np.ndarray:
        """Sum of the words' scores, a piece at a time, so that any text finds room."""
        total = np.zeros(len(self.languages))
        for at in range(0, len(words), PIECE):
            part = words[at : at + PIECE]
            if len(self) + len(part) > KNOWN:
                self.clear()
            rows = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            total += self.scores[rows].sum(axis=0)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its probability: und and 0 without letters or without a learned language."""
        words = words_of(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0
        total = self.total(words)
        total -= total.max()
        return self.languages[int(total.argmax())], float(1.0 / np.exp(total).sum())


def training_rows(
    df: DataFrame, id_col: str, text_col: str, lang_col: str, train: Column, bound: int
) -> tuple[DataFrame, list[str]]:
    """About `bound` rows of each language, chosen by a hash of the id, all of a smaller one; and the languages."""
    rows = df.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")
    )
    counts = {r._lang: r.n for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    h = F.pmod(F.xxhash64(F.lit(SEED), "_id"), F.lit(1 << 30))
    chosen = F.lit(False)
    for lang, n in counts.items():
        chosen = chosen | ((F.col("_lang") == lang) & (h < min(1.0, bound / n) * (1 << 30)))
    return rows.filter(chosen), sorted(counts)


def frequencies(counts: DataFrame, length: int, size: int, n_langs: int) -> dict[str, np.ndarray]:
    """Log frequencies of the `size` entries of a length with the largest shares, with add-one-half smoothing.

    `counts` has one row per entry (_length, _e) and its count c0, c1, ... in each language.
    Shares, not counts: a language with fewer rows keeps its words.
    """
    entries, names = counts.filter(F.col("_length") == length), [f"c{k}" for k in range(n_langs)]
    totals = [float(x or 0) for x in entries.agg(*[F.sum(c) for c in names]).first()]
    share = reduce(lambda a, b: a + b, [F.col(c) / (t or 1.0) for c, t in zip(names, totals)])
    top = entries.select("_e", *names, share.alias("_share")).orderBy(F.col("_share").desc(), "_e").limit(size).toArrow()
    found = np.array([top.column(c).to_numpy() for c in names], float).T.reshape(-1, n_langs)
    return dict(zip(top.column("_e").to_pylist(), np.log((found + 0.5) / (np.array(totals) + 0.5 * size))))


def fit(
    df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    rows: int = TRAIN_ROWS, words: int = WORDS, grams: int = GRAMS, lengths=LENGTHS,
) -> Model:
    """A model of the languages of `df` where `train` holds: whole texts of about `rows` rows a language.

    Only text and language are learned from. Null texts and languages teach nothing.
    """
    sample, languages = training_rows(df, id_col, text_col, lang_col, train, rows)
    if not languages:
        return Model([], [], lengths)
    names = [f"c{k}" for k in range(len(languages))]
    letters = F.regexp_extract_all(F.lower("_text"), F.lit(JAVA_LETTERS), F.lit(0))
    each = [F.count_if(F.col("_lang") == lang).alias(c) for lang, c in zip(languages, names)]
    counted = sample.select("_lang", F.explode(letters).alias("_e")).groupBy("_e").agg(*each)
    counted = stored(counted.withColumn("_length", F.lit(0)), "words")
    padded, none = F.concat(F.lit(" "), F.col("_e"), F.lit(" ")), F.array().cast("array<string>")
    cut = [
        F.when(
            F.length(padded) >= n,
            F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda k, n=n: F.substring(padded, k, F.lit(n))),
        ).otherwise(none)
        for n in lengths
    ]
    pieces = counted.select(F.explode(F.flatten(F.array(*cut))).alias("_e"), *names).filter(F.trim("_e") != "")
    pieces = pieces.groupBy("_e").agg(*[F.sum(c).alias(c) for c in names])
    pieces = stored(pieces.withColumn("_length", F.length("_e")), "grams")
    jobs = [lambda: frequencies(counted, 0, words, len(languages))]
    jobs += [lambda n=n: frequencies(pieces, n, grams, len(languages)) for n in lengths]
    return Model(languages, in_threads(jobs, len(jobs)), lengths)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: list[Column] | None = None) -> DataFrame:
    """doc_id, `extra` columns, lang_pred and score of every row; whole texts.

    Null texts and texts without letters give `und` and score 0, as does a model without
    languages. Texts whose words all lack known n-grams take the first language by name.
    Other columns are ignored; repeated rows get equal results.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), *(extra or []), F.col(text_col).alias("_text"))
    names = rows.columns[:-1]
    # names and one matrix per table: bounded by WORDS and GRAMS, and quick to load in a task
    tables = [(list(t), np.array(list(t.values()))) for t in model.tables]
    shared = df.sparkSession.sparkContext.broadcast((model.languages, tables, model.lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, tables, lengths = shared.value
        model = Model(languages, [dict(zip(entries, matrix)) for entries, matrix in tables], lengths)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                found = [model.predict(t.as_py()) for t in part.column(len(names))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(names)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=[*names, "lang_pred", "score"],
                )

    kinds = ", ".join([*(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names), "lang_pred string, score double"])
    return rows.mapInArrow(run, kinds)
