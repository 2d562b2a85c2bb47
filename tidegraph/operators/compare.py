"""Comparing the labels of any number of detectors."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions import scores as S


def joined(detectors: dict[str, DataFrame]) -> DataFrame:
    """All ids of any detector with the probability of each (frames of id and probability, unique ids)."""
    out = None
    for name, scores in detectors.items():
        part = scores.select("id", S.present(F.col("probability")).alias(name))
        out = part if out is None else out.join(part, "id", "full_outer")
    return out


def labels(rows: DataFrame, names: list[str], threshold: float, inclusive: bool) -> DataFrame:
    """A label column ``<name>_ai`` for each detector, null where it has no score."""
    return rows.select("*", *[((F.col(n) >= threshold) if inclusive else (F.col(n) > threshold)).alias(f"{n}_ai") for n in names])


def votes(names: list[str]) -> Column:
    """How many detectors say AI; an absent one doesn't."""
    return sum((F.coalesce(F.col(f"{n}_ai"), F.lit(False)).cast("int") for n in names), F.lit(0))


def comparison(detectors: dict[str, DataFrame], threshold: float = 0.5, inclusive: bool = True, count_unscored: bool = False) -> DataFrame:
    """C1 (exclusive threshold, unscored ids count as no votes) and C2 (inclusive, unscored ids left out): one row of counts."""
    names = list(detectors)
    rows = labels(joined(detectors), names, threshold, inclusive)
    ai = [F.col(f"{n}_ai") for n in names]
    any_there = F.greatest(*[a.isNotNull() for a in ai])
    every = F.least(*[a.isNotNull() for a in ai])
    voted = F.lit(True) if count_unscored else any_there
    aggs = [F.count("*").alias("ids"), F.count_if(every).alias("in_all")]
    aggs += [F.count_if(voted & (votes(names) == k)).alias(f"votes_{k}") for k in range(len(names) + 1)]
    aggs += [F.count_if(F.col(f"{a}_ai") == F.col(f"{b}_ai")).alias(f"agree_{a}_{b}") for a, b in combinations(names, 2)]
    aggs += [F.count_if(every & ((votes(names) == 0) | (votes(names) == len(names)))).alias("all_agree")]
    aggs += [F.count(n).alias(f"scored_{n}") for n in names]
    return rows.agg(*aggs)


def agreement(detectors: dict[str, DataFrame], threshold: float = 0.5) -> DataFrame:
    """C4: the share of ids with both scores on which each pair of detectors agrees."""
    names = list(detectors)
    rows = labels(joined(detectors), names, threshold, True)
    pairs = list(combinations(names, 2))
    both = [(F.col(f"{a}_ai").isNotNull() & F.col(f"{b}_ai").isNotNull()) for a, b in pairs]
    same = [F.col(f"{a}_ai") == F.col(f"{b}_ai") for a, b in pairs]
    one = rows.agg(*[F.count_if(x).alias(f"n{i}") for i, x in enumerate(both)], *[F.count_if(x).alias(f"s{i}") for i, x in enumerate(same)])
    parts = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), F.col(f"n{i}").alias("both_scored"), F.col(f"s{i}").alias("agree")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(parts).alias("x")).select("x.*").withColumn("pct", F.when(F.col("both_scored") > 0, 100.0 * F.col("agree") / F.col("both_scored")).otherwise(0.0))


def compared_posts(detectors: dict[str, DataFrame], texts: list[DataFrame], threshold: float = 0.5) -> DataFrame:
    """Each id with its probabilities, votes, and the text of the first source that has one."""
    names = list(detectors)
    rows = labels(joined(detectors), names, threshold, True).withColumn("votes", votes(names))
    for i, t in enumerate(texts):
        rows = rows.join(t.select("id", F.col("text").alias(f"__t{i}")), "id", "left")
    return rows.withColumn("text", F.coalesce(*[f"__t{i}" for i in range(len(texts))])).drop(*[f"__t{i}" for i in range(len(texts))])


def vote_filter(rows: DataFrame, names: list[str], kind: str, bots: DataFrame | None = None) -> DataFrame:
    """unanimous_ai, exactly_3, exactly_2, exactly_1, unanimous_human, ``<name>_only`` or bots_only; unscored is not AI."""
    n = votes(names)
    if kind == "bots_only":
        return rows.join(bots.select("id"), "id", "left_semi")
    if kind.endswith("_only"):
        return rows.where(F.coalesce(F.col(f"{kind[:-5]}_ai"), F.lit(False)) & (n == 1))
    at = {"unanimous_ai": len(names), "unanimous_human": 0, "exactly_1": 1, "exactly_2": 2, "exactly_3": 3}[kind]
    return rows.where(n == at)


def long_form(detectors: dict[str, DataFrame]) -> DataFrame:
    """(id, detector, probability) of all scores that are present."""
    return joined(detectors).unpivot("id", list(detectors), "detector", "probability").where("probability IS NOT NULL")


def detector_summary(detectors: dict[str, DataFrame], threshold: float = 0.5) -> DataFrame:
    """Scored ids, AI ids and their share by detector."""
    n = long_form(detectors).groupBy("detector").agg(F.count("*").alias("scored"), F.count_if(F.col("probability") >= threshold).alias("ai"))
    return n.withColumn("pct", 100.0 * F.col("ai") / F.col("scored"))


def detector_by_bot(detectors: dict[str, DataFrame], posts: DataFrame, accounts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """AI rate of bots' and humans' posts by detector, computed from the scores."""
    who = posts.select("id", "account_id").join(accounts.select(F.col("id").alias("account_id"), "bot"), "account_id").select("id", "bot")
    n = long_form(detectors).join(who, "id").groupBy("detector", "bot").agg(F.count("*").alias("scored"), F.count_if(F.col("probability") >= threshold).alias("ai"))
    return n.withColumn("pct", 100.0 * F.col("ai") / F.col("scored"))
