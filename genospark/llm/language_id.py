"""Language ID by word-first backoff.

A word that the model knows scores by its log frequency in each language.  An unseen word falls back to its character
n-grams, longest first: the longest order of which any n-gram is known decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_hash, kept, slices, texts_of

#: A run of letters and of number signs that are no digits; ``words_of`` takes the latter out.
_WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Labelled documents per language that the model is fitted on, at about most (by hash of the id).  The model has all
#: words and n-grams that they hold twice or more, so this also bounds what is broadcast.
MAX_DOCS = 4000
ORDERS = (5, 4, 3, 2, 1)
#: Words that the posterior weighs at most: more of them add no certainty.
CERTAIN_WORDS = 25
#: Unseen words whose scores a worker remembers, and letters of such a word at most.
_REMEMBER, _LONGEST = 100_000, 40


def words_of(text: str) -> Counter:
    """The runs of letters of a text, lower-cased, and how often each occurs."""
    found = Counter(_WORD.findall(text.lower()))
    if not text.isascii():
        for word in [w for w in found if not w.isalpha()]:  # ½, ², Ⅷ and their like
            n = found.pop(word)
            for part in "".join(c if c.isalpha() else " " for c in word).split():
                found[part] += n
    return found


@dataclass
class Model:
    """Log frequencies by language: a row of ``words`` or ``grams`` for each known entry."""

    languages: list[str]
    word_row: dict[str, int]
    words: np.ndarray
    gram_row: dict[str, int]
    grams: np.ndarray


def grams_of(word: str, order: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of ``docs``, summed within a partition before they shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("language_id")
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(held)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string())]
            return pa.record_batch([*columns, pa.array(list(held.values()), pa.int64())], names=["lang", "word", "n"])

        for batch in slices(batches):
            for text, lang in zip(texts_of(batch), batch.column("lang").to_pylist(), strict=True):
                for word, n in words_of(text).items():
                    held[lang, word] += n
            if len(held) > 300_000:
                yield flush()
                held.clear()
        yield flush()

    found = docs.select("text", "lang").mapInArrow(count, "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _gram_counts(words: DataFrame) -> DataFrame:
    marked = F.concat(F.lit("<"), "word", F.lit(">"))
    of_order = [
        F.when(
            F.length(marked) >= k,
            F.transform(F.sequence(F.lit(1), F.length(marked) - k + 1), lambda i, k=k: F.substr(marked, i, F.lit(k))),
        ).otherwise(F.array().cast("array<string>"))
        for k in ORDERS
    ]
    grams = words.select("lang", "n", F.explode(F.flatten(F.array(*of_order))).alias("word"))
    return grams.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _table(counts: DataFrame, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Rows of log frequencies of the entries that occur twice or more; unseen pairs get half a count."""
    per = counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()  # a row per language
    totals = {r["lang"]: r["n"] for r in per}
    by_language = [F.coalesce(F.sum(F.when(F.col("lang") == k, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, k in enumerate(languages)]
    found = counts.groupBy("word").agg(F.sum("n").alias("all"), *by_language).where("all > 1").drop("all").toArrow()
    found = found.sort_by("word")
    table = np.stack([found[f"n{i}"].to_numpy() for i in range(len(languages))], 1) + 0.5
    size = np.array([totals.get(lang, 0) for lang in languages]) + 0.5 * (len(table) + 1)
    return {w: i for i, w in enumerate(found["word"].to_pylist())}, np.log(table / size).astype(np.float32)


def fit(labelled: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """A model from (doc_id, text, lang); rows with null text or lang teach nothing."""
    there = labelled.where("text is not null and lang is not null")
    per = {r["lang"]: r["n"] for r in there.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(per)
    if not languages:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    scale = 1 << 20
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, max_docs / per[k]) * scale))])
    sample = there.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(scale)) < F.element_at(share, F.col("lang")))
    words = _counts(sample).persist()
    word_row, word_table = _table(words, languages)
    gram_row, gram_table = _table(_gram_counts(words), languages)
    words.unpersist()
    return Model(languages, word_row, word_table, gram_row, gram_table)


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        self.flat = np.zeros(len(model.languages), np.float32)
        self.unseen: dict[str, np.ndarray] = {}

    def back_off(self, word: str) -> np.ndarray:
        """The mean log frequency of the word's known n-grams of the longest order that has any."""
        for order in ORDERS:
            rows = [r for g in grams_of(word, order) if (r := self.m.gram_row.get(g)) is not None]
            if rows:
                return self.m.grams[rows].mean(0)
        return self.flat

    def score(self, text: str) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.m.languages:
            return UNDETERMINED, 0.0
        known, known_n, total, n = [], [], np.zeros(len(self.m.languages)), 0
        for word, k in words.items():
            n += k
            row = self.m.word_row.get(word)
            if row is not None:
                known.append(row)
                known_n.append(k)
                continue
            if (found := self.unseen.get(word)) is None:
                found = self.back_off(word)
                if len(word) <= _LONGEST:
                    if len(self.unseen) >= _REMEMBER:
                        self.unseen.clear()
                    self.unseen[word] = found
            total += k * found
        if known:
            total += np.asarray(known_n, np.float32) @ self.m.words[known]
        total *= min(1.0, CERTAIN_WORDS / n)
        odds = np.exp(total - total.max())
        best = int(total.argmax())
        return self.m.languages[best], float(odds[best] / odds.sum())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of the predicted language.

    Null text, empty text and text without a letter are ``und`` with score 0.  Ties go to the first language by
    name.  Without any labelled row all texts are ``und``.  Repeated rows are scored alike; other columns pass
    through untouched, and columns that are already called lang_pred or score are replaced.
    """
    bound_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("language_id")
        scorer = Scorer(told.value)
        for batch in slices(batches):
            found = [scorer.score(t) for t in texts_of(batch, text_col)]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.record_batch([*batch.columns, *more], names=[*names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Learns from the labelled rows of ``docs`` outside the held-out quarter and predicts all rows.

    Adds ``held_out``: crc32 of the id as text leaves 2 modulo 4; null ids are not held out.  Texts that are null or have
    no letter are ``und``, as is every text where nothing is labelled.  Whole texts are read; repeated rows get the same
    prediction; of languages that score alike the first by name is taken.  An empty table gives an empty result.
    """
    held_out = F.coalesce(F.pmod(id_hash(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    model = fit(docs.where(~held_out).select("doc_id", "text", "lang"), max_docs)
    return predict(docs.withColumn("held_out", held_out), model)
