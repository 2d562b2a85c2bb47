"""Line dedup by pairwise alignment.

Lines are compared by hash.  A line alone may be common, so documents are found through rarer
hashes: that of a line with the lines after it up to ``MIN_WORDS`` words (a run).  Two documents
that hold a passage of so many words hold its runs.  A run belongs to the first document that
holds it (by id), so each later holder is linked to that one and links grow with the lines, not
with the square of the holders.  For each document and owner the lines of their common runs are
aligned with patience diff and aligned common blocks of at least ``MIN_WORDS`` words are deleted
from the later document; runs that the alignment leaves over, because passages stand in another
order, are aligned one by one.  So every passage of that length that an earlier document holds
goes, and every deleted line stays in an earlier document.

Defined cases: null texts stay null, empty texts stay as they are; blank lines are no
lines and don't part a block (inside a deleted block they go with it); white space at
either end, runs of white space and letter case make no difference; rows with a null id
neither own nor lose lines; repeated rows (equal id and text) are one document and are cut alike;
rows with one id and different texts don't cut each other; an empty table gives no rows.  Ids
may be of any type that can be ordered.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
#: The odd base of the running polynomial.
BASE = 0x9E3779B97F4A7C15
#: White space as the line hashes see it.
WHITE = " \t\n\r\x0b\x0c"


def lines_of(text: Column) -> Column:
    """The lines of a text as (h, n), hash and words, in order; blank lines are left out."""
    normal = F.transform(F.split(F.lower(text), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    full = F.filter(normal, lambda x: x != "")
    return F.transform(full, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n")))


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places of two sequences: lines that are unique in both anchor the alignment, gaps are aligned again.

    Where a gap has no unique common line, the k-th occurrences in either are paired.
    """
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = defaultdict(list), defaultdict(list)
        for i in range(a0, a1):
            in_a[a[i]].append(i)
        for j in range(b0, b1):
            in_b[b[j]].append(j)
        pairs = [(x[0], in_b[k][0]) for k, x in in_a.items() if len(x) == 1 and len(in_b.get(k, ())) == 1]
        if not pairs:
            pairs = [(i, j) for k, x in in_a.items() for i, j in zip(x, in_b.get(k, ()), strict=False)]
        if not pairs:
            continue
        pairs.sort()
        tops, back, at = [], [], []  # longest increasing run of places in b
        for k, (_, j) in enumerate(pairs):
            r = bisect_left(tops, j)
            tops[r:r + 1] = [j]
            at[r:r + 1] = [k]
            back.append(at[r - 1] if r else -1)
        k, chain = at[-1], []
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        chain.reverse()
        out += chain
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        gaps += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def common_blocks(a: list[tuple], b: list[tuple], least: int) -> list[int]:
    """Places in ``b`` of aligned common blocks of at least ``least`` words; both are lists of (p, h, n).

    What is deleted is taken out and the rest aligned again, so that a passage that the later
    document repeats goes each time.
    """
    gone, left = [], b
    while left:
        matched = patience([x[1] for x in a], [x[1] for x in left])
        found, block = [], []
        for i, j in matched:
            if block and not (a[i][0] == a[block[-1][0]][0] + 1 and left[j][0] == left[block[-1][1]][0] + 1):
                found.append(block)
                block = []
            block.append((i, j))
        found.append(block)
        drop = {j for block in found if sum(left[j][2] for _, j in block) >= least for _, j in block}
        if not drop:
            break
        gone += [left[j][0] for j in drop]
        left = [x for j, x in enumerate(left) if j not in drop]
    return sorted(gone)


def run_ends(n: np.ndarray, least: int) -> np.ndarray:
    """For each line the end of the shortest run from it with at least ``least`` words (one past it), for the lines that have one."""
    total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    ends = np.searchsorted(total, total[:-1] + least, "left")
    return ends[: np.searchsorted(ends, len(total), "left")]


def run_hashes(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the lines of each run: differences of one running polynomial."""
    base, back = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
    powers = lambda x: np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), x)]))
    upto = np.concatenate([[np.uint64(0)], np.cumsum(h.view(np.uint64) * powers(base)[:-1])])
    start = np.arange(len(ends))
    # scaled back to where the run starts, so that it has one hash wherever it stands
    return ((upto[ends] - upto[start]) * powers(back)[start] + (ends - start).astype(np.uint64)).view(np.int64)


def runs_of(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, t, p, r): the runs of each text; ``t`` tells texts of one id apart."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("t"), lines_of(F.col("text")).alias("x"))
    lists = texts.select("doc_id", "t", F.transform("x", lambda x: x["h"]).alias("h"), F.transform("x", lambda x: x["n"]).alias("n"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, hashes = [], [], []
            for i, (h, n) in enumerate(zip(common.lists(batch["h"]), common.lists(batch["n"]), strict=True)):
                ends = run_ends(n, least)
                rows.append(np.full(len(ends), i))
                places.append(np.arange(len(ends), dtype=np.int32))
                hashes.append(run_hashes(h, ends))
            if rows:
                at = pa.array(np.concatenate(rows))
                columns = [batch["doc_id"].take(at), batch["t"].take(at), pa.array(np.concatenate(places)), pa.array(np.concatenate(hashes))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "p", "r"])

    return lists.mapInArrow(runs, f"doc_id {ids}, t long, p int, r long")


def links(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, t, p, owner, at): for each text the places of its runs that an earlier document owns, that one (hashed) and the place there."""
    runs = common.cut(runs_of(docs, min_words))
    owner = runs.groupBy("r").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
    seen = common.cut(runs.join(owner.drop("last"), "r"))
    at = seen.where("doc_id = owner").groupBy("r").agg(F.min(F.struct("t", "p")).alias("x"))
    held = seen.where("doc_id > owner").join(at, "r").select("doc_id", "t", F.struct("p", F.xxhash64("owner", "x.t").alias("owner"), F.col("x.p").alias("at")).alias("x"))
    every = held.groupBy("doc_id", "t").agg(F.array_sort(F.collect_list("x")).alias("x"))
    part = lambda c: F.transform("x", lambda x: x[c]).alias(c)
    return every.select("doc_id", "t", part("p"), part("owner"), part("at"))


def removed_places(h: np.ndarray, n: np.ndarray, p: np.ndarray, owner: np.ndarray, at: np.ndarray, least: int = MIN_WORDS) -> set[int]:
    """Places of the lines that a text (line hashes and words) loses by its links, one owner after the other."""
    ends, gone, by_owner = run_ends(n, least), set(), defaultdict(list)
    for start, o, there in zip(p.tolist(), owner.tolist(), at.tolist(), strict=True):
        by_owner[o].append((start, int(ends[start]), there))
    line = lambda place, i: (place, int(h[i]), int(n[i]))
    for runs in by_owner.values():
        own = {i: line(i, i) for a, b, _ in runs for i in range(a, b)}
        their = {there + i - a: line(there + i - a, i) for a, b, there in runs for i in range(a, b)}
        gone.update(common_blocks([their[i] for i in sorted(their)], [own[i] for i in sorted(own)], least))
        for a, b, there in runs:
            if any(i not in gone for i in range(a, b)):
                gone.update(common_blocks([line(there + i - a, i) for i in range(a, b)], [line(i, i) for i in range(a, b)], least))
    return gone


def cut_text(text: str, gone: set[int]) -> str:
    """A text without the lines at the named places; blank lines inside a deleted block go with it."""
    kept, p, last_gone = [], -1, False
    blank: list[str] = []
    for line in text.split("\n"):
        if not line.strip(WHITE):
            blank.append(line)
            continue
        p += 1
        now = p in gone
        if not (now and last_gone):
            kept += blank
        blank = []
        if not now:
            kept.append(line)
        last_gone = now
    return "\n".join(kept + blank)


def deduped(docs: DataFrame, min_words: int = MIN_WORDS, into: str = "removed") -> DataFrame:
    """``docs`` with shorter texts and a struct ``into`` of the lines and words that went (in the place of a column of that name)."""
    found = links(docs, min_words)
    found = found.select(F.col("doc_id").alias("__tg_id"), F.col("t").alias("__tg_t"), "p", "owner", "at").toDF("__tg_id", "__tg_t", "__tg_p", "__tg_owner", "__tg_at")
    keyed = docs.withColumns({"__tg_doc": F.col("doc_id"), "__tg_hash": F.when(F.col("text").isNotNull(), F.xxhash64("text"))})
    both = keyed.join(found, (F.col("__tg_doc") == F.col("__tg_id")) & (F.col("__tg_hash") == F.col("__tg_t")), "left")
    both = both.withColumn("__tg_lines", F.when(F.col("__tg_p").isNotNull(), lines_of(F.col("text"))))
    both = both.withColumns({"__tg_h": F.transform("__tg_lines", lambda x: x["h"]), "__tg_n": F.transform("__tg_lines", lambda x: x["n"])})

    @F.pandas_udf("text string, n_lines int, n_words int")
    def shorten(texts: pd.Series, h: pd.Series, n: pd.Series, p: pd.Series, owner: pd.Series, at: pd.Series) -> pd.DataFrame:
        rows = []
        for text, *own in zip(texts, h, n, p, owner, at, strict=True):
            gone = set() if text is None or own[2] is None else removed_places(*map(np.asarray, own), min_words)
            short = cut_text(text, gone) if gone else text
            rows.append((short, len(gone), len(text.split()) - len(short.split()) if gone else 0))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_words"])

    both = both.withColumn("__tg_new", shorten.asNondeterministic()("text", "__tg_h", "__tg_n", "__tg_p", "__tg_owner", "__tg_at"))
    out = [F.col("__tg_new.text").alias("text") if c == "text" else F.col(c) for c in docs.columns if c != into]
    return both.select(*out, F.struct("__tg_new.n_lines", "__tg_new.n_words").alias(into))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the blocks that an earlier one holds."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = deduped(docs)
    return out.select("doc_id", "text", F.col("removed.n_lines").alias("n_removed_lines"), F.col("removed.n_words").alias("n_removed_words"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with shorter texts, columns unchanged; documents that lose all their words go.

    A column ``n_chars`` follows the text.
    """
    out = deduped(docs, min_words, "__tg_removed").where((F.col("__tg_removed.n_lines") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__tg_removed.n_lines") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
