"""Periodic runs of words: stretches that repeat themselves three times or more.

A run is a maximal stretch of consecutive words with smallest period q and a length of at least
``max(MIN_WORDS, CYCLES * q)``.  On the diagonal of lag q (word i against word i - q) it is a row of
at least ``GRAM`` matches.  The table of diagonals is sparse: going through the words in order, the
earlier occurrences of a word open or lengthen the match of their lag, and a lag that is not met
again ends, which emits its run at once.

Two facts keep the table small without losing a run.  A run's diagonal holds a match of g words in a
row wherever g <= 2q, so an occurrence counts only where g words agree; and for q <= g <= 2q, the
nearest earlier occurrence of such g words lies exactly q back (any nearer one would give the
stretch a smaller period).  So for g = 16, 32, 64, ... each place has one lag at most, the nearest
earlier place of its g words, kept if it is in (g/2, g] (up to 16 for the first).  Ids of g words
come from pairs of ids of g/2 words, exactly, without hashing; doubling ends where no g words
repeat.  A text of n words takes O(n log n) for each doubling, a constant text too.

Defined cases: null, empty and short texts have no run; repeated rows give equal results; runs that
overlap are all reported, by start, then period; very long texts are taken whole, one at a time
(about 60 bytes a word); an empty table gives no rows; only the text is read and the two columns
``runs`` and ``collapsed`` replace columns of these names, others pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 24
CYCLES = 3
#: Matches in a row on the diagonal of any run: 24 - q for q up to 8, and 2q from there on.
GRAM = 16

_word = re.compile(r"[^\x20\x09-\x0D]+")


def word_ids(words: list[str]) -> np.ndarray:
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def pair_ids(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Ids of the pairs (a[i], b[i]), the nearest earlier place of the same pair (-1: none), and whether any repeats."""
    key = a * (int(b.max()) + 1) + b
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    ids, before = np.empty(len(key), np.int64), np.full(len(key), -1, np.int64)
    ids[order] = np.cumsum(~same)
    at = np.flatnonzero(same)
    before[order[at]] = order[at - 1]
    return ids, before, bool(len(at))


def occurrences(ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(g, place, lag): that the g words from a place on are those a lag earlier, in order of place for each g."""
    g, n = 1, len(ids)
    while n >= 2 * g and (g < GRAM or CYCLES * g < n):
        ids, before, repeats = pair_ids(ids[:-g], ids[g:])
        g *= 2
        if not repeats:
            return
        if g >= GRAM:
            lag = np.arange(len(before)) - before
            met = np.flatnonzero((before >= 0) & (lag <= g) & (lag > (g // 2 if g > GRAM else 0)))
            for place, q in zip(met.tolist(), lag[met].tolist(), strict=True):
                yield g, place, q


def runs_of(ids: np.ndarray, min_words: int = MIN_WORDS, cycles: int = CYCLES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n, found = len(ids), []
    if n < min_words:
        return found

    def ended(g: int, q: int, first: int, last: int) -> None:
        start, end = first - q, last + g
        maximal = (start == 0 or ids[start - 1] != ids[start - 1 + q]) and (end == n or ids[end] != ids[end - q])
        if maximal and end - start >= max(min_words, cycles * q):
            found.append((start, end - start, q))

    level, active = 0, (0, 0, -1)  # the lag that is being met, with the first and last place of its match
    for g, place, q in occurrences(ids):
        lag, first, last = active
        if g == level and q == lag and place == last + 1:
            active = (lag, first, place)
            continue
        if last >= 0:
            ended(level, lag, first, last)
        level, active = g, (q, place, place)
    if active[2] >= 0:
        ended(level, *active)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return " ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return " ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def with_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (start, length, period of each) and ``collapsed``, the text without what its runs repeat."""

    @F.pandas_udf("runs array<struct<start: long, length: long, period: long>>, collapsed string")
    def detect(texts: pd.Series) -> pd.DataFrame:
        out: dict[str, list] = {"runs": [], "collapsed": []}
        for text in texts:
            words = _word.findall(text or "")
            runs = runs_of(word_ids(words))
            out["runs"].append([{"start": s, "length": m, "period": q} for s, m, q in runs])
            out["collapsed"].append(collapse(words, runs))
        return pd.DataFrame(out)

    rest = docs.drop("runs", "collapsed")
    return rest.withColumn("__tg", detect.asNondeterministic()(F.col(text_col))).select(*[F.col(f"`{c}`") for c in rest.columns], "__tg.runs", "__tg.collapsed")


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of one document in ten, the words from some place on repeat a period; the checksum of the id says which and where."""

    @F.pandas_udf("string")
    def repeat(texts: pd.Series, sums: pd.Series) -> pd.Series:
        out = []
        for text, h in zip(texts, sums.tolist(), strict=True):
            if h % 10 == 0 and (words := _word.findall(text or "")):
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                text = " ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])
            out.append(text)
        return pd.Series(out, dtype=object)

    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("doc_id", repeat.asNondeterministic()("text", h).alias("text"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document (one in ten with a planted loop): count, the most repetitive, and digests."""
    docs = common.table(spark, sf_dir, "documents")
    found = with_runs(looped(docs))
    more = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    top = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda a, r: F.when(more(a, r), r).otherwise(a))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.array_join(lines, "").alias("listed"), "collapsed")
    return found.select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period", F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
