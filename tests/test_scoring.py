"""Scorers with resources, batches by area, judges that wait."""

import time

import pandas as pd
from pyspark.sql import functions as F

from tidegraph.operators import scoring


def test_batches_by_area():
    assert [(s.start, s.stop) for s in scoring.by_area([1, 1, 1, 4, 4, 50, 60], 3, 10)] == [(0, 3), (3, 5), (5, 6), (6, 7)]
    assert list(scoring.by_area([], 3, 10)) == [] and [(s.start, s.stop) for s in scoring.by_area([0, 0, 0], 2, 10)] == [(0, 2), (2, 3)]


def test_a_resource_is_opened_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: texts.str.len().astype(float)

    texts = spark.range(400).select("id", F.repeat(F.lit("x"), F.col("id").cast("int") % 50).alias("text"), F.lit("en").alias("lang"))
    got = scoring.score_texts(texts, scoring.Resource(factory), partitions=16)
    assert {r.id: r.score for r in got.collect()} == {i: float(i % 50) for i in range(400)}
    workers = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert workers and len(workers) == len(set(workers)) < 16


def test_padding_is_small(spark):
    texts = spark.range(2000).select("id", F.repeat(F.lit("x"), (F.col("id") * 7919 % 1000 + 1).cast("int")).alias("text"), F.lit("en").alias("lang"))
    padded = lambda some: pd.Series([float(some.str.len().max())] * len(some))
    total = scoring.score_texts(texts, padded, partitions=4).agg(F.sum("score")).first()[0]
    assert 1 - texts.agg(F.sum(F.length("text"))).first()[0] / total < 0.1
    area = 5000
    sizes = scoring.score_texts(texts, lambda some: pd.Series([float(len(some) * some.str.len().max())] * len(some)), partitions=4, area=area)
    assert sizes.agg(F.max("score")).first()[0] <= area


def test_judges_wait_together(spark):
    def judge(claims):
        time.sleep(0.2)
        return pd.DataFrame({"verdict": claims["text"].map({"a": "vera"}).fillna("falsa"), "confidence": 0.5, "reasoning": claims["id_"] if "id_" in claims else "r"}, index=claims.index)

    claims = spark.createDataFrame([(i, "a" if i % 2 else "b", "d", "e") for i in range(41)], "id long, text string, date string, evidence string").coalesce(1)
    started = time.time()
    rows = {r.id: r.verdict for r in scoring.judge_claims(claims, judge, batch=1, at_once=16).collect()}
    assert rows == {i: "vero" if i % 2 else "falso" for i in range(41)} and time.time() - started < 41 * 0.2
    assert scoring.judge_claims(claims.limit(0), judge, batch=2, at_once=2).count() == 0
