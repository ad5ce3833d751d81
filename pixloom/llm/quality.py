"""Per-document text statistics, and the kind of each document (prose, list, table, junk) by trees trained on them.

Gradient-boosted trees see the statistics of whole documents (text_statistics) and nothing else. They are trained on a bounded
sample of documents that weak_labels calls prose, list, table or junk by the structure of their lines; hand labels are never trained
on, they are the holdout on which the probabilities are calibrated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixloom.llm import boosting
from pixloom.llm.text_statistics import STATISTICS, Lexicon, statistics
from pixloom.llm.weak_labels import KINDS, weak_label
from pixloom.session import materialise, spread

WEAK_BOUND = 6_000
HAND_BOUND = 8_000
COMMON_BOUND = 100_000
PARTS = 1_000_000


def _common(common_words: DataFrame) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """The words of each language, sorted. The list is a parameter of some hundred words; one beyond COMMON_BOUND is refused."""
    rows = common_words.where("word is not null").select(F.coalesce("lang", F.lit("")).alias("lang"), F.lower("word").alias("word")).distinct().limit(COMMON_BOUND + 1).collect()
    if len(rows) > COMMON_BOUND:
        raise ValueError(f"a list of more than {COMMON_BOUND} common words is not sent to the tasks")
    by_lang: dict[str, set[str]] = {}
    for r in rows:
        by_lang.setdefault(r.lang, set()).add(r.word)
    return tuple((lang, tuple(sorted(words))) for lang, words in sorted(by_lang.items()))


@lru_cache(4)
def _prepared(common: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[dict[str, frozenset[str]], Lexicon]:
    """Once per Python worker, whatever the number of batches."""
    words = {lang: frozenset(own) for lang, own in common}
    return words, Lexicon(words)


def _read(docs: DataFrame, common_words: DataFrame, id_col: str, text_col: str, labelled: int) -> DataFrame:
    """(id, _s, _weak): the statistics of each document, and the weak label of about `labelled` of them, drawn by a hash of their id."""
    fixed = docs.sparkSession.sparkContext.broadcast(_common(common_words))
    share = min(PARTS, PARTS * labelled // max(1, docs.count())) if labelled else 0

    @F.pandas_udf("s array<double>, weak string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        words, lexicon = _prepared(fixed.value)
        for texts, drawn in batches:
            found = statistics(texts.tolist(), lexicon)
            yield pd.DataFrame({"s": list(found), "weak": [weak_label(t, words) if d else None for t, d in zip(texts, drawn)]})

    drawn = F.pmod(F.xxhash64(id_col), F.lit(PARTS)) < share
    texts = spread(docs.select(id_col, text_col))
    return texts.select(id_col, read(F.coalesce(F.col(text_col), F.lit("")), drawn).alias("_r")).select(id_col, F.col("_r.s").alias("_s"), F.col("_r.weak").alias("_weak"))


def _named(id_col: str) -> list:
    return [F.col(id_col), *[F.get("_s", F.lit(i)).alias(s) for i, s in enumerate(STATISTICS)]]


def document_statistics(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one DOUBLE column for each of STATISTICS): counts are logarithms of one more, the others rates and shares.

    Null, empty and blank texts have all statistics 0. Nothing is shuffled but tables of fewer partitions than cores.
    common_words(lang, word) is a fixed list of a few hundred words and is sent to the tasks; one of more than COMMON_BOUND is refused.
    """
    return _read(docs, common_words, id_col, text_col, 0).select(*_named(id_col))


def clean_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, kind): the kind most raters gave, in plain spelling; documents whose raters are split evenly have none."""
    kind = F.lower(F.trim("kind"))
    votes = labels.where(kind.isin(*KINDS)).groupBy(id_col, kind.alias("kind")).agg(F.count_distinct(F.coalesce("rater", F.lit(""))).alias("n"))
    best = votes.groupBy(id_col).agg(F.max("n").alias("m"), F.max_by("kind", "n").alias("kind"))
    ties = votes.join(best.select(id_col, "m"), id_col).where("n = m").groupBy(id_col).agg(F.count("*").alias("k")).where("k = 1")
    return best.join(ties, id_col, "left_semi").select(id_col, "kind")


def _bounded(df: DataFrame, id_col: str, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, kinds) of at most `bound` rows of df(id, kind, _s), drawn by a hash of the id."""
    rows = df.select("kind", "_s", id_col).orderBy(F.xxhash64(id_col), id_col).limit(bound).toPandas()
    return np.array(rows["_s"].tolist(), dtype=float).reshape(-1, len(STATISTICS)), rows["kind"].map(KINDS.index).to_numpy(int)


def train(read: DataFrame, labels: DataFrame, id_col: str = "doc_id", weak_bound: int = WEAK_BOUND, hand_bound: int = HAND_BOUND) -> boosting.Forest | None:
    """Trees on weakly labelled documents, calibrated on the hand labels; None if no document could be labelled weakly.

    Documented bounds: about weak_bound documents are labelled weakly and trained on, hand_bound hand labels calibrate.
    """
    x, y = _bounded(read.where("_weak is not null").withColumnRenamed("_weak", "kind"), id_col, weak_bound + weak_bound // 10)
    if not len(y):
        return None
    forest = boosting.fit(x, y, len(KINDS))
    held = clean_labels(labels, id_col).join(read.where(F.get("_s", F.lit(STATISTICS.index("chars"))) > 0), id_col)
    return boosting.calibrate(forest, *_bounded(held, id_col, hand_bound))


def document_kinds(docs: DataFrame, labels: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, STATISTICS, p_prose, p_list, p_table, p_junk, kind): the calibrated probabilities and the likeliest kind of each document.

    kind is null for null, empty and blank texts (and for all where no document could be trained on); repeated rows get equal
    rows. Other columns are ignored.
    """
    read = materialise(_read(docs, common_words, id_col, text_col, WEAK_BOUND), "statistics")
    forest = train(read, labels, id_col)
    if forest is None:
        empty = [F.lit(None).cast("double").alias(f"p_{k}") for k in KINDS]
        return read.select(*_named(id_col), *empty, F.lit(None).cast("string").alias("kind"))
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(list(sent.value.probabilities(np.stack(rows.to_numpy()))), index=rows.index) if len(rows) else rows

    scored = read.withColumn("_p", score("_s"))
    best = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.array_position("_p", F.array_max("_p")).cast("int"))
    return scored.select(*_named(id_col), *[F.get("_p", F.lit(i)).alias(f"p_{k}") for i, k in enumerate(KINDS)], F.when(F.get("_s", F.lit(STATISTICS.index("chars"))) > 0, best).alias("kind"))
