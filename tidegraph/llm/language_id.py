"""Language identification of mixed-language text.

Each word (run of letters) gets a score per language from character n-gram tables; the
scripts of its letters narrow the languages that may score at all.  A Viterbi pass with a
penalty for switching labels every word, which gives language spans; the language with the
most letters is the prediction and its share of the letters the score.

Defined cases: null texts and texts without a letter are ``und`` with score 0; with no
training rows everything is ``und``; a word in a script that no learned language uses is
open to all languages; ties go to the language that sorts first; repeated rows are labelled alike
(and count each in training), rows with a null id are labelled but not trained on; very long texts
are labelled whole; an empty table gives no rows; only the text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: First and last code point of the scripts that are told apart.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
NAMES = tuple(dict.fromkeys(s[0] for s in SCRIPTS)) + ("other",)
BITS = 16
ORDERS = (1, 2, 3)

_tables: dict[str, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """For each code point 0 if it is no letter, else 1 + the number of its script."""
    if "letters" not in _tables:
        t = np.zeros(0x110000, np.uint8)
        t[[i for i in range(0x110000) if chr(i).isalpha()]] = len(NAMES)
        for name, a, b in SCRIPTS:
            part = t[a : b + 1]
            part[part > 0] = 1 + NAMES.index(name)
        _tables["letters"] = t
    return _tables["letters"]


def lowered(text: str) -> str:
    """Lower case that keeps every code point in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(lowered(text).encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(cp: np.ndarray, letters: np.ndarray) -> list[np.ndarray]:
    """For each position the hashed n-gram of each order that ends there; what is no letter is a blank."""
    c = np.where(letters > 0, cp, 32).astype(np.uint32)
    one, two = np.roll(c, 1), np.roll(c, 2)
    one[:1], two[:2] = 32, 32
    shift, out = np.uint32(32 - BITS), []
    h1 = c * np.uint32(2654435761)
    h2 = (h1 ^ (one * np.uint32(2246822519))) * np.uint32(3266489917)
    h3 = (h2 ^ (two * np.uint32(668265263))) * np.uint32(374761393)
    for h in (h1, h2, h3):
        out.append((h >> shift).astype(np.int32))
    return out


@dataclass
class Model:
    """Log probabilities of hashed n-grams by order, n-gram and language; which scripts a language uses."""

    langs: list[str]
    tables: np.ndarray  # [len(ORDERS), 2**BITS, languages], float32
    uses: np.ndarray  # [len(NAMES) + 1, languages], bool
    switch: float = 12.0


def pieces(texts: list[str | None], most: int = 1 << 20) -> Iterator[list[int]]:
    """Row numbers in groups of bounded total length (a longer text is a group of its own)."""
    group, size = [], 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if group and size + n > most:
            yield group
            group, size = [], 0
        group.append(i)
        size += n + 1
    if group:
        yield group


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, with a blank after each; and where each starts."""
    sizes = np.array([len(t) + 1 for t in texts])
    return code_points("\n".join(texts) + "\n"), np.concatenate([[0], np.cumsum(sizes)])


def viterbi(emit: np.ndarray, n_words: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word; the texts' words lie one after the other in ``emit``."""
    langs, labels = emit.shape[1], np.zeros(len(emit), np.int8)
    if langs == 1:
        return labels
    order = np.argsort(-n_words, kind="stable")
    order = order[n_words[order] > 0]
    at = 0
    while at < len(order):
        # texts of like length go together; a padded group holds at most about a million words
        longest = n_words[order[at]]
        some = order[at : at + max(1, int(1_000_000 // longest))]
        some = some[n_words[some] * 4 >= longest] if longest > 64 else some
        at += len(some)
        base, n = first[some], n_words[some]
        best = np.zeros((len(some), langs), np.float32)
        moved = np.zeros((longest, len(some), langs), bool)
        top = np.zeros((longest, len(some)), np.int8)
        live = len(some)
        rows = np.arange(len(some))
        for t in range(longest):
            while n[live - 1] <= t:
                live -= 1
            now = best[:live]
            if t:
                top[t, :live] = k = now.argmax(1)
                jump = now[rows[:live], k] - switch
                moved[t, :live] = m = now < jump[:, None]
                now = np.where(m, jump[:, None], now)
            best[:live] = now + emit[base[:live] + t]
        lang = best.argmax(1).astype(np.int8)
        for t in range(longest - 1, -1, -1):
            k = int(np.searchsorted(-n, -t, side="left"))  # texts with more than t words
            labels[base[:k] + t] = lang[:k]
            if t:
                lang[:k] = np.where(moved[t, rows[:k], lang[:k]], top[t, :k], lang[:k])
    return labels


def label(texts: list[str], model: Model) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text with letters: row number, start and end of its words, and their languages."""
    table = letter_table()
    for group in pieces(texts):
        own = [texts[i] or "" for i in group]
        cp, starts = joined(own)
        letters = table[cp]
        is_letter = letters > 0
        if not is_letter.any():
            continue
        edge = np.diff(is_letter.astype(np.int8), prepend=0, append=0)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros((len(cp), len(model.langs)), np.float32)
        for k, g in enumerate(grams(cp, letters)):
            total += model.tables[k][g]
        total[~is_letter] = 0
        emit = np.add.reduceat(total, a, axis=0)
        script = letters[a]
        allowed = model.uses[script]
        emit = np.where(allowed, emit, -1e6).astype(np.float32)
        lo, hi = np.searchsorted(a, starts[:-1]), np.searchsorted(a, starts[1:])
        labels = viterbi(emit, hi - lo, lo, model.switch)
        for j, i in enumerate(group):
            if hi[j] > lo[j]:
                yield i, a[lo[j] : hi[j]] - starts[j], b[lo[j] : hi[j]] - starts[j], labels[lo[j] : hi[j]]


def fit(docs: DataFrame, lang_col: str = "lang", per_lang: int = 4000, switch: float = 12.0) -> Model | None:
    """N-gram tables from at most ``per_lang`` documents of each language (in md5 order of the id).

    Texts are counted where they lie; only the counts of 2**16 n-gram classes by order and
    language, and of letters by script, reach the driver.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col("text").isNotNull())
    langs = sorted(r[0] for r in rows.select(lang_col).distinct().collect())
    if not langs:
        return None
    ids = None
    for x in langs:
        part = rows.where(F.col(lang_col) == x).select("doc_id").orderBy(common.stable_order("doc_id"), "doc_id").limit(per_lang)
        ids = part if ids is None else ids.unionByName(part)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, sums = letter_table(), {}
        for batch in batches:
            for x, part in batch.groupby("lang"):
                texts = list(part["text"])
                into = sums.setdefault(x, [np.zeros(1 << BITS, np.int64) for _ in ORDERS] + [np.zeros(len(NAMES) + 1, np.int64)])
                for group in pieces(texts):
                    cp, _ = joined([texts[i] for i in group])
                    letters = table[cp]
                    for k, g in enumerate(grams(cp, letters)):
                        into[k] += np.bincount(g[letters > 0], minlength=1 << BITS)
                    into[-1] += np.bincount(letters, minlength=len(NAMES) + 1)
        for x, arrays in sums.items():
            for k, v in enumerate(arrays):
                at = np.flatnonzero(v)
                yield pd.DataFrame({"lang": x, "k": k, "gram": at, "n": v[at]})

    some = rows.join(F.broadcast(ids), "doc_id", "left_semi").select(F.col(lang_col).alias("lang"), "text")
    counted = some.mapInPandas(count, "lang string, k int, gram int, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    return model_of(counted.toPandas(), langs, switch)


def model_of(counted: pd.DataFrame, langs: list[str], switch: float) -> Model:
    """Smoothed log probabilities; the orders' weights add up to 1."""
    where = {x: i for i, x in enumerate(langs)}
    tables = np.zeros((len(ORDERS), 1 << BITS, len(langs)))
    letters = np.zeros((len(NAMES) + 1, len(langs)))
    for k, part in counted.groupby("k"):
        (tables[k] if k < len(ORDERS) else letters)[part["gram"], part["lang"].map(where)] = part["n"]
    tables += 0.5
    tables = np.log(tables / tables.sum(1, keepdims=True)) * np.array([0.1, 0.3, 0.6])[:, None, None]
    share = letters / np.maximum(letters[1:].sum(0), 1)
    uses = share > 1e-3
    uses[~uses.any(1)] = True
    return Model(langs, tables.astype(np.float32), uses, switch)


def predict(texts: list[str | None], model: Model | None) -> pd.DataFrame:
    """Language, score and spans (start, end, language) of each text."""
    pred, score, spans = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
    if model is not None:
        for i, a, b, labels in label(texts, model):
            weight = np.bincount(labels, weights=b - a, minlength=len(model.langs))
            k = int(weight.argmax())
            pred[i], score[i] = model.langs[k], weight[k] / weight.sum()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]])
            spans[i] = [{"start": int(a[x]), "end": int(b[y - 1]), "lang": model.langs[labels[x]]} for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return pd.DataFrame({"lang_pred": pred, "score": score, "spans": spans})


def identified(docs: DataFrame, model: Model | None, text_col: str = "text"):
    """A struct column with the language, its score, and the spans of each text."""

    @F.pandas_udf("lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>")
    def language(texts: pd.Series) -> pd.DataFrame:
        return predict(list(texts), model)

    return language.asNondeterministic()(docs[text_col])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; the held-out fold is never trained on."""
    docs = common.table(spark, sf_dir, "documents")
    held = common.fold("doc_id", 5) == 0
    model = fit(docs.select("doc_id", "text", "lang").where(~held))
    found = docs.select("doc_id", held.alias("held_out"), identified(docs, model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", F.size("found.spans").alias("n_spans"))
