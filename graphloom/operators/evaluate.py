"""Answers judged case by case."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.shipping import ship

METRICS = ("faithfulness", "answer_relevance", "context_recall", "context_precision")


def judged(cases: DataFrame, answer: Callable[[str], tuple[str, list[str]]], judge: Callable[[str, str, list[str], str], dict[str, float]], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(number, question, answer, contexts, one column for each metric, ragas_score, error) of cases(number, question, ground_truth).

    answer makes a question's (answer, contexts), judge the metrics of (question, answer, contexts, ground_truth); both run on
    the executors. A metric that is missing or isn't a number is null, the score is the mean of the others, 0 without any. A case
    that fails scores 0 with its error, and the others go on."""
    ship(cases.sparkSession)

    def one(question: str, truth: str) -> tuple:
        try:
            said, contexts = answer(question)
            found = judge(question, said, list(contexts), truth)
            scores = [None if found.get(m) is None or found[m] != found[m] else float(found[m]) for m in metrics]
            some = [x for x in scores if x is not None]
            return said, list(contexts), *scores, sum(some) / len(some) if some else 0.0, None
        except Exception as e:  # a case that fails is a row, not the end of the run
            return None, [], *[None for _ in metrics], 0.0, f"{type(e).__name__}: {e}"

    names = ["answer", "contexts", *metrics, "score", "error"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = pd.DataFrame([one(q, t) for q, t in zip(part["question"], part["ground_truth"], strict=True)], columns=names, dtype=object)
            yield pd.concat([part[["number", "question"]].reset_index(drop=True), made], axis=1)

    schema = f"number bigint, question string, answer string, contexts array<string>, {', '.join(f'{m} double' for m in metrics)}, score double, error string"
    return cases.select("number", "question", "ground_truth").mapInPandas(run, schema)


def report(rows: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row: cases, successes, failures, the mean of each metric over the cases that have it, and the mean, least and greatest score of
    successes; means are null without any."""
    good = F.col("error").isNull()
    score = F.when(good, F.col("score"))
    return rows.agg(
        F.count("*").alias("n"), F.count_if(good).alias("n_good"), F.count_if(~good).alias("n_failed"), *[F.round(F.avg(m), 4).alias(m) for m in metrics],
        F.round(F.avg(score), 4).alias("mean_score"), F.min(score).alias("least_score"), F.max(score).alias("greatest_score"),
    )
