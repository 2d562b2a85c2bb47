"""Quality classifier: text is compressed with two zstandard dictionaries.

One dictionary is trained on good, one on bad labelled text.  A text that the good
dictionary makes smaller is likelier good: the difference of the two compressed sizes,
normalised by their sum, goes through a logistic calibration fitted on labelled texts
that were not used for the dictionaries.  The calibration also sees the compressed size
per byte, without which the difference means little for highly repetitive texts.

Defined cases: null and empty texts have difference 0 and size 1 and get the score that
the calibration gives there; without labels of both classes every score is the share of
good labels (0.5 if there are none); repeated rows get equal scores, rows with a null id are
scored like others; labels without an id teach nothing, of contradicting labels of one id the
smallest counts, and of an id's rows the first by text; equal sizes are no tie to break; very long
texts are compressed whole (those that exceed the sample's size are passed over in fitting only);
an empty table gives no rows; only the text column is read, whatever else there is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass
class Model:
    """Two dictionaries (raw bytes) and the calibration's weights."""

    good: bytes
    bad: bytes
    weights: np.ndarray
    level: int = 3


def train_dictionary(texts: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; texts too few to train on become a raw-content dictionary."""
    texts = [t for t in texts if t]
    try:
        return zstandard.train_dictionary(size, [t[i : i + 65536] for t in texts for i in range(0, len(t), 65536)]).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:]


class Sizer:
    """Compressed sizes with either dictionary."""

    def __init__(self, model: Model):
        self.by = []
        for raw in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=model.level)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def inputs(self, texts) -> np.ndarray:
        """For each text: normalised difference, log size per byte, log length."""
        out = np.zeros((len(texts), 3))
        for i, t in enumerate(texts):
            raw = t.encode("utf-8", "surrogatepass") if t else b""
            if raw:
                g, b = (len(c.compress(raw)) for c in self.by)
                out[i] = (b - g) / (b + g), np.log((g + b) / 2 / len(raw)), np.log(len(raw))
        return out


def design(x: np.ndarray) -> np.ndarray:
    """Calibration inputs: intercept, difference, size per byte, and the length's effect on them."""
    d, r, n = x[:, 0] * 10, x[:, 1], (x[:, 2] - 7) / 2
    return np.column_stack([np.ones(len(x)), d, r, d * np.maximum(n, -2), np.maximum(-1.5 - r, 0), n])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    beta, pen = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pen[0] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        grad = x.T @ (w * (y - p)) - pen * beta
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(pen), grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, chars: int = 20_000_000, dict_bytes: int = 112_640, level: int = 3) -> Model | float:
    """Fit on at most ``per_class`` labelled documents of each class (in md5 order of the id) with at most ``chars`` characters a class.

    Half of each class trains its dictionary, the other half the calibration, whose rows are
    weighted back to the shares of the classes among all labels.  Returns the share of good
    labels where there is only one class.
    """
    known = common.one_label(labels)
    count = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect() if r["quality"] in (0, 1)}
    total = sum(count.values())
    if len(count) < 2:
        return count.get(1, 0) / total if total else 0.5
    parts = [known.where(F.col("quality") == q).orderBy(common.stable_order("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    ids = parts[0].unionByName(parts[1])
    got = common.bounded_texts(docs, ids, chars, ("quality",)).toPandas().sort_values("doc_id", kind="stable")
    got = got[got["text"].fillna("") != ""]
    texts = {q: [t.encode("utf-8", "surrogatepass") for t in got.loc[got["quality"] == q, "text"]] for q in (0, 1)}
    if min(map(len, texts.values())) < 2:
        return count[1] / total
    model = Model(train_dictionary(texts[1][::2], dict_bytes), train_dictionary(texts[0][::2], dict_bytes), np.zeros(6), level)
    held = [(t.decode("utf-8", "surrogatepass"), q) for q in (0, 1) for t in texts[q][1::2]]
    y = np.array([q for _, q in held], float)
    w = np.array([count[q] / total * len(held) / max(1, (y == q).sum()) for _, q in held])
    model.weights = logistic(design(Sizer(model).inputs([t for t, _ in held])), y, w)
    return model


def scores(docs: DataFrame, model: Model | float, text_col: str = "text"):
    """A column with the score (0 to 1) of each text."""
    if isinstance(model, float):
        return F.lit(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(sigmoid(design(Sizer(model).inputs(list(texts))) @ model.weights))

    return score.asNondeterministic()(docs[text_col])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of the held-out fold are never read for the fit."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(common.fold("doc_id", 4) != 2))
    scored = docs.select("doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), scores(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
