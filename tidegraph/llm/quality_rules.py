"""Quality rules: a learned decision list over text statistics.

Per-text statistics are computed by an Arrow-batched function.  Sequential covering
(grow a conjunction of thresholds by information gain, prune it on held-back rows,
remove what it covers, repeat) turns labelled statistics into an ordered list of
interpretable rules, which is emitted as one Spark ``CASE WHEN`` expression.

Defined cases: a null or blank text has no words (all counts 0) and fails the base
rule; repeated rows are judged alike; a table without labels, or with labels of one
class only, gives an empty list, so that only the base rule rejects; rows with a null id are
judged like others, labels without an id teach nothing, of contradicting labels of one id the
smallest counts, and of an id's rows the first by text; ties between tests go to the feature that
is listed first and the smallest threshold; very long texts are read whole; an empty table gives
no rows; further columns are passed through, one named like ``into`` is replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\r\x0b\x0c"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
PUNCTUATION = b".,;:!?"

STATS_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_unique_words long, n_upper long, n_digits long, n_punct long"
)
#: What the rules may test: each is a ratio, so that long and short texts compare.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "unique_word_share": ("n_unique_words", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "punct_per_word": ("n_punct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _less(raw: bytes, drop: bytes) -> int:
    return len(raw) - len(raw.translate(None, drop))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice, first finds included."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    windows = h[:-2] * MIX[0] + (h[1:-1] ^ (h[1:-1] >> np.uint64(29))) * MIX[1] + (h[2:] ^ (h[2:] >> np.uint64(31))) * MIX[2]
    _, where, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = count[where] > 1
    if not again.any():
        return 0
    inside = np.zeros(n, bool)
    inside[:-2] |= again
    inside[1:-1] |= again
    inside[2:] |= again
    return int(inside.sum())


def stats_of(text: str | None) -> tuple[int, ...]:
    """The statistics of one text, in the order of ``STATS_SCHEMA``."""
    if not text:
        return (0,) * 10
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # splits bytes at exactly the white space \x20 \x09-\x0D
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return (
        len(words),
        len(text) - _less(raw, WHITE),
        _less(raw, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        _less(raw, UPPER),
        _less(raw, DIGITS),
        _less(raw, PUNCTUATION),
    )


def _stats_udf():
    @F.pandas_udf(STATS_SCHEMA)
    def text_stats(texts: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in STATS_SCHEMA.split(", ")]
        return pd.DataFrame([stats_of(t) for t in texts], columns=names, dtype="int64")

    return text_stats.asNondeterministic()  # evaluated once, never again in a pushed-down filter


def with_stats(docs: DataFrame, into: str = "stats", text_col: str = "text") -> DataFrame:
    """``docs`` with the struct column ``into`` of text statistics."""
    return docs.withColumn(into, _stats_udf()(F.col(text_col)))


@dataclass(frozen=True)
class Test:
    """One threshold: ``feature <= at`` or ``feature > at``."""

    feature: str
    above: bool
    at: float

    def holds(self, x: pd.DataFrame) -> np.ndarray:
        v = x[self.feature].to_numpy()
        return v > self.at if self.above else v <= self.at

    def column(self, stats: str) -> Column:
        top, bottom = (F.col(f"{stats}.{c}").cast("double") for c in FEATURES[self.feature])
        ratio = F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
        return ratio > self.at if self.above else ratio <= self.at

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.at:.6g}"


@dataclass(frozen=True)
class Rule:
    """Texts for which all tests hold are rejected."""

    tests: tuple[Test, ...]

    def holds(self, x: pd.DataFrame) -> np.ndarray:
        return np.logical_and.reduce([t.holds(x) for t in self.tests])

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests))


def features(stats: pd.DataFrame) -> pd.DataFrame:
    """The ratios of ``FEATURES`` for collected statistics."""
    out = {}
    for name, (top, bottom) in FEATURES.items():
        b = stats[bottom].to_numpy(float)
        out[name] = np.where(b > 0, stats[top].to_numpy(float) / np.maximum(b, 1), 0.0)
    return pd.DataFrame(out)


def _grow(x: pd.DataFrame, bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> Rule | None:
    inside, tests = np.ones(len(x), bool), []
    while len(tests) < most:
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for name, at in cuts.items():
            v = x[name].to_numpy()[inside]
            b = bad[inside]
            order = np.argsort(v, kind="stable")
            k = np.searchsorted(v[order], at, side="right")
            p_low = np.concatenate([[0], np.cumsum(b[order])])[k]
            for above in (False, True):
                p = p0 - p_low if above else p_low
                n = (len(v) - k - p) if above else (k - p)
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0)
                i = int(np.argmax(g))
                if g[i] > gain:
                    best, gain = Test(name, above, float(at[i])), g[i]
        if best is None:
            break
        tests.append(best)
        inside &= best.holds(x)
    return Rule(tuple(tests)) if tests else None


def _worth(rule: Rule, x: pd.DataFrame, bad: np.ndarray) -> float:
    hit = rule.holds(x)
    return (bad[hit].sum() - (~bad[hit]).sum()) / hit.sum() if hit.any() else -1.0


def learn(stats: pd.DataFrame, good: np.ndarray, most_rules: int = 12, most_tests: int = 3, precision: float = 0.95) -> list[Rule]:
    """Sequential covering: rules for ``~good`` rows, in the order in which they were found.

    Two thirds of the rows grow a rule, the rest prune it; a rule stays in the list
    while at least ``precision`` of the rows that it covers, in either part, are bad.
    """
    x, bad = features(stats), ~np.asarray(good, bool)
    part = np.arange(len(x)) % 3 == 2
    left, rules = np.ones(len(x), bool), []
    cuts = {}
    for c in x:
        v = np.unique(x[c].to_numpy())
        mid = (v[1:] + v[:-1]) / 2
        cuts[c] = mid if len(mid) <= 256 else np.unique(np.quantile(mid, np.linspace(0, 1, 256)))
    cuts = {c: at for c, at in cuts.items() if len(at)}
    while len(rules) < most_rules and cuts:
        g, p = left & ~part, left & part
        if bad[g].sum() < 2:
            break
        rule = _grow(x[g], bad[g], cuts, most_tests)
        if rule is None:
            break
        shorter = [Rule(rule.tests[:k]) for k in range(1, len(rule.tests) + 1)]
        rule = max(shorter, key=lambda r: _worth(r, x[p], bad[p]))
        hit = rule.holds(x) & left
        if bad[hit].sum() < 2 or bad[hit].mean() < precision or (hit & p).any() and bad[hit & p].mean() < precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rule_column(rules: list[Rule], stats: str) -> Column:
    """The number (from 1) of the first rule that rejects a text, null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        hit = F.lit(True)
        for t in rule.tests:
            hit = hit & t.column(stats)
        out = F.when(hit, F.lit(i)).otherwise(out)
    return out


def base_failed(stats: str) -> Column:
    """Too short, or mostly repeated three-word windows."""
    n, again = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 50) | (100 * again > 50 * n)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, **how) -> list[Rule]:
    """Learn the list from at most ``sample`` labelled documents (taken in md5 order of the id).

    Only statistics of that bounded sample reach the driver.  Documents that the base
    rule rejects, and null labels, teach nothing.
    """
    some = common.one_label(labels).orderBy(common.stable_order("doc_id"), "doc_id").limit(sample)
    one = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    seen = with_stats(one)
    got = seen.where(~base_failed("stats")).select("doc_id", "quality", "stats.*").toPandas()
    got = got.sort_values(["doc_id", "n_words"], kind="stable")
    got = got.iloc[np.argsort([hash_order(i) for i in got["doc_id"]], kind="stable")].reset_index(drop=True)
    return learn(got, got["quality"].to_numpy() == 1, **how) if got["quality"].nunique() > 1 else []


def hash_order(i: int | str) -> int:
    """A fixed shuffle of ids for the split into growing and pruning rows."""
    return zlib.crc32(i.encode()) if isinstance(i, str) else (int(i) * 0x9E3779B97F4A7C15 >> 7) & 0xFFFFFFFF


def apply(docs: DataFrame, rules: list[Rule], into: str = "verdict") -> DataFrame:
    """``docs`` with a struct ``into`` (in the place of a column of that name): the statistics, ``base_failed``, ``rule`` and ``kept``."""
    seen = with_stats(docs, into)
    fields = [F.col(f"{into}.{x.split()[0]}").alias(x.split()[0]) for x in STATS_SCHEMA.split(", ")]
    failed, rule = base_failed(into), rule_column(rules, into)
    return seen.withColumn(into, F.struct(*fields, failed.alias("base_failed"), rule.alias("rule"), (~failed & rule.isNull()).alias("kept")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    judged = apply(docs.select("doc_id", "text"), fit(docs, labels))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"]
    return judged.select("doc_id", *[F.col(f"verdict.{n}").alias(n) for n in names])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that neither the base rule nor a learned rule rejects, columns unchanged."""
    judged = apply(docs, fit(docs, labels), "__tg_verdict")
    return judged.where(F.col("__tg_verdict.kept")).drop("__tg_verdict")
