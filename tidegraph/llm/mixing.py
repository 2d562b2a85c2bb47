"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic.  Raking scales the cells' token
weights to the target marginals, one margin after the other, for a fixed number of sweeps.  A
share ``keep`` of all tokens is to be kept; a cell can't give more tokens than it has, so no
weight is raked beyond what its documents hold, and what such a cell lacks goes to the others of
its margins: the volume doesn't hang on the rarest cell.  A document is sampled with its cell's
calibrated weight per observed token, so the kept tokens have the target shares in expectation
as far as the documents allow (``attained`` reports them), and no document is ever taken twice.
The draw is a hash of the id, the same on every run.

Topics: the texts at hand have no subject, so the default topic is the form of the text
(tabular, or prose by length); any column expression can take its place.

Defined cases: null source, language or text count as '' (and 'short'); targets for
categories that no document has are left out and the rest rescaled; categories without a
target get probability 0; documents without a word are in their cell and add no tokens (a
cell without tokens has probability 1); repeated rows are drawn alike, rows without an id by
their text; ties can't occur; very long texts count by all their words; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators.iterate import cut

from . import common

MARGINS = ("source", "lang", "topic")
SWEEPS = 40
#: Share of all tokens that is kept.
KEEP = 0.5
#: Default targets flatten the observed token shares by this power.
FLATTEN = 0.8
#: Up to this many cells the raking runs on collected cells, beyond it as Spark jobs.
COLLECTED_CELLS = 100_000


def n_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def form(text: Column, tokens: Column) -> Column:
    """The default topic: a text's form."""
    return F.when(F.coalesce(text, F.lit("")).contains(" | "), "table").when(tokens >= 1000, "long").when(tokens >= 200, "medium").otherwise("short")


def cells_of(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, u) of each document; ``u`` is its draw."""
    counted = docs.select("doc_id", draw(F.col("doc_id"), F.col("text")).alias("u"), "text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in MARGINS[:2]], n_tokens(F.col("text")).alias("n_tokens"))
    return counted.select("doc_id", "source", "lang", (form(F.col("text"), F.col("n_tokens")) if topic is None else topic).alias("topic"), "n_tokens", "u")


def flattened(sizes: dict[str, float], power: float = FLATTEN) -> dict[str, float]:
    """Target shares: observed shares to a power below 1, which lifts the small ones."""
    up = {k: v**power for k, v in sorted(sizes.items()) if v > 0}
    total = sum(up.values())
    return {k: v / total for k, v in up.items()}


def rake(index: list[np.ndarray], observed: np.ndarray, targets: list[np.ndarray], sweeps: int = SWEEPS, keep: float = KEEP) -> np.ndarray:
    """Weights of cells with the target marginals: each step scales one margin to its target, no cell beyond what it has."""
    w = observed / max(observed.sum(), 1e-300)
    most = w / keep
    for _ in range(sweeps):
        for at, goal in zip(index, targets, strict=True):
            have = np.bincount(at, weights=w, minlength=len(goal))
            w = np.minimum(w * np.where(have > 0, goal / np.where(have > 0, have, 1), 0)[at], most)
    return w


def calibrated(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS, keep: float = KEEP) -> DataFrame:
    """(source, lang, topic, probability) of (source, lang, topic, tokens) cells."""
    spark = cells.sparkSession
    if cells.count() > COLLECTED_CELLS:
        return _calibrated_by_jobs(cells, targets, sweeps, keep)
    got = cells.orderBy(*MARGINS).toPandas()
    index, goals = [], []
    for c in MARGINS:
        names = sorted(set(got[c]))
        place = {x: i for i, x in enumerate(names)}
        at = np.array([place[x] for x in got[c]], np.int64)
        have = dict(zip(names, np.bincount(at, weights=got["tokens"].to_numpy(float), minlength=len(names)), strict=True))
        goal = (targets or {}).get(c) or flattened(have)
        total = sum(goal.get(n, 0.0) for n in names if have[n] > 0) or 1.0
        index.append(at)
        goals.append(np.array([goal.get(n, 0.0) / total if have[n] > 0 else 0.0 for n in names]))
    tokens = got["tokens"].to_numpy(float)
    w = rake(index, tokens, goals, sweeps, keep)
    got["probability"] = np.where(tokens > 0, keep * tokens.sum() * w / np.maximum(tokens, 1), 1.0)
    schema = ", ".join(f"{c} string" for c in MARGINS) + ", probability double"
    return spark.createDataFrame(list(got[[*MARGINS, "probability"]].itertuples(index=False, name=None)), schema)


def _calibrated_by_jobs(cells: DataFrame, targets: dict[str, dict[str, float]] | None, sweeps: int, keep: float = KEEP) -> DataFrame:
    """The same raking for any number of cells: each step is a grouped sum and a join."""
    spark = cells.sparkSession
    w = cut(cells.crossJoin(cells.agg(F.sum("tokens").alias("all"))).withColumn("w", F.col("tokens") / F.col("all")))
    goals = {}
    for c in MARGINS:
        have = cells.groupBy(c).agg(F.sum("tokens").alias("t")).where("t > 0")
        if targets and targets.get(c):
            given = spark.createDataFrame(list(targets[c].items()), f"{c} string, goal double")
            have = have.join(given, c).select(c, "goal")
        else:
            have = have.select(c, F.pow("t", F.lit(FLATTEN)).alias("goal"))
        goals[c] = cut(have.crossJoin(have.agg(F.sum("goal").alias("all"))).select(c, (F.col("goal") / F.col("all")).alias("goal")))
    for _ in range(sweeps):
        for c in MARGINS:
            have = w.groupBy(c).agg(F.sum("w").alias("have")).join(goals[c], c, "left")
            scale = have.select(c, F.when(F.col("have") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("have")).otherwise(0.0).alias("scale"))
            w = w.join(scale, c).withColumn("w", F.least(F.col("w") * F.col("scale"), F.col("tokens") / F.col("all") / keep)).drop("scale")
        w = cut(w)
    return w.select(*MARGINS, F.when(F.col("tokens") > 0, keep * F.col("all") * F.col("w") / F.col("tokens")).otherwise(1.0).alias("probability"))


def attained(cells: DataFrame, p: DataFrame) -> DataFrame:
    """(margin, category, observed, expected): the share of each category in all tokens and, in expectation, in those kept."""
    rows = cells.join(p, list(MARGINS))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("margin"), F.col(c).alias("category")) for c in MARGINS])).alias("x")
    sums = rows.select(each, "tokens", (F.col("tokens") * F.col("probability")).alias("kept")).groupBy("x.margin", "x.category").agg(F.sum("tokens").alias("t"), F.sum("kept").alias("k"))
    all_ = rows.agg(F.sum("tokens").alias("all_t"), F.sum(F.col("tokens") * F.col("probability")).alias("all_k"))
    return sums.crossJoin(all_).select("margin", "category", (F.col("t") / F.col("all_t")).alias("observed"), (F.col("k") / F.col("all_k")).alias("expected"))


def draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from a hash of the id (of the text where there is no id)."""
    hexed = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))), 1, 8)
    return F.conv(hexed, 16, 10).cast("double") / 4294967296.0


def sampled(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, sweeps: int = SWEEPS, keep: float = KEEP) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, kept) of every document."""
    rows = cells_of(docs, topic)
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    p = calibrated(cells, targets, sweeps, keep)
    out = rows.join(p, list(MARGINS))  # AQE broadcasts the cells where they are few
    return out.withColumn("kept", F.col("u") < F.col("probability")).select("doc_id", *MARGINS, "n_tokens", "probability", "kept")


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP) -> DataFrame:
    """The sampled documents, columns unchanged."""
    named = {c: f"__tg_{c}" for c in MARGINS}
    tokens = n_tokens(F.col("text"))
    keyed = docs.withColumns({named["source"]: F.coalesce(F.col("source").cast("string"), F.lit("")), named["lang"]: F.coalesce(F.col("lang").cast("string"), F.lit("")), named["topic"]: form(F.col("text"), tokens)})
    cells = cut(keyed.groupBy(*[F.col(named[c]).alias(c) for c in MARGINS]).agg(F.sum(n_tokens(F.col("text"))).alias("tokens")))
    p = calibrated(cells, targets, keep=keep).select(*[F.col(c).alias(named[c]) for c in MARGINS], F.col("probability").alias("__tg_p"))
    out = keyed.join(p, list(named.values())).where(draw(F.col("doc_id"), F.col("text")) < F.col("__tg_p"))
    return out.select(*docs.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrated probability of every document, and whether it is drawn."""
    return sampled(common.table(spark, sf_dir, "documents"))


def raking_sql(docs: str = "documents", sweeps: int = SWEEPS, power: float = FLATTEN, keep: float = KEEP) -> str:
    """DuckDB SQL for ``sampled``: the raking as a recursive query, one margin a step."""
    word = r"len([x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''])"
    goals = ", ".join(
        f"g_{c} AS (SELECT {c}, pow(t, {power}) / sum(pow(t, {power})) OVER () AS goal_{c} FROM (SELECT {c}, cast(sum(tokens) AS double) AS t FROM cells GROUP BY {c}) WHERE t > 0)" for c in MARGINS
    )
    scale = " ".join(
        f"WHEN {i} THEN CASE WHEN sum(w) OVER (PARTITION BY k, {c}) > 0 THEN coalesce(goal_{c}, 0) / sum(w) OVER (PARTITION BY k, {c}) ELSE 0 END" for i, c in enumerate(MARGINS)
    )
    return rf"""
WITH RECURSIVE docs_n AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, text, cast({word} AS bigint) AS n_tokens FROM {docs}
), placed AS (
  SELECT doc_id, source, lang, CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN n_tokens >= 1000 THEN 'long' WHEN n_tokens >= 200 THEN 'medium' ELSE 'short' END AS topic, n_tokens, text FROM docs_n
), cells AS (
  SELECT source, lang, topic, cast(sum(n_tokens) AS bigint) AS tokens FROM placed GROUP BY ALL
), {goals}, start AS (
  SELECT source, lang, topic, tokens, goal_source, goal_lang, goal_topic FROM cells LEFT JOIN g_source USING (source) LEFT JOIN g_lang USING (lang) LEFT JOIN g_topic USING (topic)
), raked AS (
  SELECT 0 AS k, *, cast(tokens AS double) / sum(cast(tokens AS double)) OVER () / {keep} AS most, cast(tokens AS double) / sum(cast(tokens AS double)) OVER () AS w FROM start
  UNION ALL
  SELECT k + 1, source, lang, topic, tokens, goal_source, goal_lang, goal_topic, most, least(w * CASE k % 3 {scale} END, most) FROM raked WHERE k < {3 * sweeps}
), p AS (
  SELECT source, lang, topic, CASE WHEN tokens > 0 THEN {keep} * sum(cast(tokens AS double)) OVER () * w / tokens ELSE 1 END AS probability FROM raked WHERE k = {3 * sweeps}
)
SELECT doc_id, source, lang, topic, n_tokens, probability,
  cast(cast('0x' || substr(md5(coalesce(cast(doc_id AS varchar), md5(coalesce(text, '')))), 1, 8) AS bigint) AS double) / 4294967296.0 < probability AS kept
FROM placed JOIN p USING (source, lang, topic)
"""


ORACLE = raking_sql()
