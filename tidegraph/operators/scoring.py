"""Pluggable scorers and judges in Arrow batches."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions import text as T

from . import posts


#: Characters that a batch of texts takes when all are padded to its longest.
AREA = 64 * 4096


class Resource:
    """A scorer or judge that ``factory`` makes, such as by loading a model, once in each Python worker however many tasks run there.

    It stays until the worker ends.  Pass it where a batch function is asked for.
    """

    def __init__(self, factory: Callable[[], Callable]):
        self.factory, self.name = factory, uuid.uuid4().hex

    def __call__(self, rows):
        opened = sys.__dict__.setdefault("_opened_resources", {})  # this class travels by value, so its own module is no place to keep things
        if self.name not in opened:
            opened[self.name] = self.factory()
        return opened[self.name](rows)


def by_area(lengths: list[int], rows: int, area: int) -> Iterator[slice]:
    """Batches of texts in order of length: at most ``rows``, and with padding at most ``area`` characters (a longer text goes alone)."""
    start, longest = 0, 0
    for i, n in enumerate(lengths):
        longest = max(longest, n)
        if i > start and (i - start == rows or (i - start + 1) * longest > area):
            yield slice(start, i)
            start, longest = i, n
    if start < len(lengths):
        yield slice(start, len(lengths))


def score_texts(texts: DataFrame, scorer: Callable[[pd.Series], pd.Series], batch: int = 64, lang: str | None = None, partitions: int | None = None, area: int = AREA) -> DataFrame:
    """(id, score) by a user's batch function; texts of like length go together, so that padding is small.

    A call has at most ``batch`` texts and ``area`` characters with padding.  Other languages than ``lang`` get a null score.
    """
    rows = texts.select("id", "text", (F.lit(True) if lang is None else F.coalesce(F.col("lang") == lang, F.lit(False))).alias("wanted"), F.length("text").alias("n"))
    ranged = rows.repartitionByRange(partitions, "n", "id") if partitions else rows.repartitionByRange("n", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.Series(float("nan"), index=b.index, dtype=float)
            some = b.index[b["wanted"] & b["text"].notna()]
            for piece in by_area(b.loc[some, "n"].tolist(), batch, area):
                at = some[piece]
                out.loc[at] = pd.Series(list(scorer(b.loc[at, "text"])), index=at, dtype=float)
            yield pd.DataFrame({"key": b["key"], "score": out.astype(object).where(out.notna(), None)})

    scored = ranged.select(F.to_json(F.struct("id")).alias("key"), "text", "wanted", "n", "id").sortWithinPartitions("n", "id").drop("id").mapInPandas(run, "key string, score double")
    return scored.select(whole_id(texts), "score")


def whole_id(rows: DataFrame) -> Column:
    """The id of a row from its JSON ``key``: as text it passes through pandas untouched, even beside nulls."""
    return F.from_json("key", f"id {rows.schema['id'].dataType.simpleString()}")["id"].alias("id")


def mock_scorer(texts: pd.Series) -> pd.Series:
    """T10 as a batch function."""
    n = texts.str.split().str.len()
    return (1.1 - n / 400.0).clip(0.4, 1.2)


def judge_claims(claims: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], batch: int | None = None, at_once: int = 1) -> DataFrame:
    """Verdict, confidence and reasoning of (id, text, date, evidence) rows by a user's batch function; veracity follows (T5).

    A judge that waits for an answer can have ``at_once`` calls of ``batch`` rows open in a task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                step = batch or max(1, len(b))
                pieces = [b.iloc[i : i + step] for i in range(0, len(b), step)]
                for piece, out in zip(pieces, pool.map(judge, pieces), strict=True):
                    yield pd.DataFrame({"key": piece["key"], "verdict": out["verdict"], "confidence": out["confidence"], "reasoning": out["reasoning"]})

    keyed = claims.select(F.to_json(F.struct("id")).alias("key"), "text", "date", "evidence")
    done = keyed.mapInPandas(run, "key string, verdict string, confidence double, reasoning string")
    done = done.select(whole_id(claims), "verdict", "confidence", "reasoning")
    verdict = T.normalize_verdict(F.col("verdict"))
    return done.withColumn("verdict", verdict).withColumn("veracity", T.veracity_of(F.col("verdict")))


def checkworthiness(texts: DataFrame, done: DataFrame | None, scorer: Callable[[pd.Series], pd.Series], threshold: float = 0.6) -> DataFrame:
    """Scores of texts that have none yet, with the flag for those above the threshold."""
    todo = texts if done is None else posts.not_done(texts, done)
    return score_texts(todo, scorer).withColumn("checkworthy", F.col("score") > threshold)


def claim_pipeline(texts: DataFrame, lang: str, worthy: DataFrame, done: DataFrame, evidence: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Texts of a language that aren't done and are check-worthy, judged with their evidence; and how many were not worthy."""
    todo = posts.not_done(texts.where(F.col("lang") == lang), done)
    some = posts.by_ids(todo, posts.checkworthy(worthy, threshold))
    claims = posts.claims_with_evidence(some.withColumn("date", F.lit(T.NO_DATE)), evidence)
    dropped = todo.agg(F.count("*").alias("__a")).crossJoin(some.agg(F.count("*").alias("__b"))).select((F.col("__a") - F.col("__b")).alias("discarded"))
    return judge_claims(claims, judge), dropped
