"""Detector scores: the NaN rule, scales, bins and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUARTILES = ("0-25", "25-50", "50-75", "75-100")
AI_LABEL, HUMAN_LABEL, EMPTY_LABEL = "Most likely AI-Generated", "Most likely human-generated", "skipped_empty"


def present(p: Column) -> Column:
    """NaN is an absent score: both engines would sort it above every number."""
    p = p.cast("double")
    return F.when(~F.isnan(p), p)


def ai_percentage(score: Column, threshold: float = 0.9, steepness: float = 25.0) -> Column:
    """A logistic percentage of a score that falls as text gets likelier machine-made (two decimals, half even)."""
    return F.bround(100.0 / (1.0 + F.exp(F.lit(steepness) * (score - F.lit(threshold)))), 2)


def quartile(p: Column) -> Column:
    """The quarter of a probability."""
    return F.element_at(F.array(*map(F.lit, QUARTILES)), bin_of(p, 4) + 1)


def bin_of(p: Column, bins: int) -> Column:
    """The bin of a probability; 1 belongs to the last."""
    return F.when(p.isNotNull(), F.least(F.floor(p * bins), F.lit(bins - 1))).cast("int")  # least() skips nulls


def to_unit(v: Column) -> Column:
    """Values above 1 are percentages."""
    v = v.try_cast("double")
    return present(F.when(v > 1, v / 100.0).otherwise(v))


def percent_probability(v: Column) -> Column:
    """A percentage as a probability, whatever its size."""
    return present(v.try_cast("double") / 100.0)


def first_probability(raw: Column, fields: tuple[str, ...] = ("probability", "ai_probability", "prob", "score", "ai_probability_pct")) -> Column:
    """The first field that a JSON document has, as a probability (null where that one is null or no number)."""
    names, out = F.json_object_keys(raw), F.lit(None).cast("double")
    for f in reversed(fields):
        out = F.when(F.array_contains(names, f), to_unit(F.get_json_object(raw, f"$.{f}"))).otherwise(out)
    return out


def word_count(text: Column) -> Column:
    """Words between white space."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def detector_label(score: Column, text: Column, threshold: float = 0.9) -> Column:
    """Low scores are machine-made; empty texts are skipped."""
    empty = F.trim(F.coalesce(text, F.lit(""))) == ""
    return F.when(empty, EMPTY_LABEL).when(score < threshold, AI_LABEL).otherwise(HUMAN_LABEL)


def mock_score(text: Column) -> Column:
    """A deterministic stand-in for a detector, from the text's length."""
    return F.greatest(F.lit(0.4), F.least(F.lit(1.2), F.lit(1.1) - word_count(text) / F.lit(400.0)))
