"""Answer quality: accuracy and recall against gold answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.functions import text as tx
from corpusql.functions.binding import let

COVERED = 0.8


def verdict(gold: Column, judged: Column) -> Column:
    """Default yes/no verdict: equal after normalisation. NULL counts as no."""
    same = tx.normalize_answer(gold) == tx.normalize_answer(judged)
    return F.coalesce(same, F.lit(False))


def model_verdict(content: Column) -> Column:
    """Verdict out of a model reply: yes when the reply starts with the word."""
    return F.coalesce(content.rlike(r"(?i)\A\s*yes\b"), F.lit(False))


def answer_accuracy(
    answers: DataFrame,
    keys: Sequence[str] = (),
    gold: str = "gold_answer",
    judged: str = "judged_answer",
    correct: Column | None = None,
) -> DataFrame:
    hit = verdict(F.col(gold), F.col(judged)) if correct is None else correct
    return answers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("answers"),
        F.count_if(hit).alias("correct"),
        F.avg(hit.cast("double")).alias("accuracy"),
    )


def answer_recall(
    answers: DataFrame,
    id_col: str = "query_id",
    gold: str = "gold_answer",
    judged: str = "judged_answer",
    covered_share: float = COVERED,
) -> DataFrame:
    """Per answer: claims of the gold answer, how many the judged one covers, recall.

    A claim is a sentence; it is covered when the share of its distinct words
    found in the judged answer reaches ``covered_share``. All work stays on the
    answer's own row: no explode and no shuffle.
    """
    def words(text: Column) -> Column:
        return F.array_distinct(
            F.filter(F.split(tx.normalize_answer(text), " "), lambda w: F.length(w) > 0)
        )

    def is_covered(claim: Column) -> Column:
        def enough(mine: Column) -> Column:
            shared = F.size(F.array_intersect(mine, F.col("_said")))
            return (F.size(mine) > 0) & (shared >= F.size(mine) * covered_share)

        return let(words(claim), enough)

    def counts(claims: Column) -> Column:
        return F.struct(F.size(claims).alias("total"), F.size(F.filter(claims, is_covered)).alias("covered"))

    said = answers.withColumn("_said", words(F.coalesce(F.col(judged), F.lit(""))))
    counted = said.withColumn("_n", let(tx.sentences(F.col(gold)), counts)).select(
        id_col, F.col("_n.total").alias("total_claims"), F.col("_n.covered").alias("covered_claims")
    )
    return counted.withColumn(
        "recall", F.try_divide(F.col("covered_claims"), F.col("total_claims"))
    )


def mean_recall(recalls: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Recall over all claims: covered claims divided by claims."""
    return recalls.groupBy(*keys).agg(
        F.sum("total_claims").alias("total_claims"),
        F.sum("covered_claims").alias("covered_claims"),
        F.try_divide(F.sum("covered_claims"), F.sum("total_claims")).alias("recall"),
    )
