"""From raw documents to a training mixture: five stages, each a written table.

Every stage takes the documents that its predecessor kept and returns documents with the
same columns, so each can be run again from the table before it.  Order: quality rules,
line dedup, near-duplicate removal, benchmark decontamination, mixing.

Defined cases, for every stage: further columns pass through whatever their names; an empty table
gives an empty table; very long texts are read whole; rows without an id are judged by their text.

* quality: null, blank and short texts go; repeated rows are judged alike; of contradicting labels
  of one id the smallest counts.
* lines: null and empty texts stay; rows without an id neither own nor lose lines; repeated rows are
  cut alike; a document that loses all its words goes; ``n_chars`` follows the text.
* near_duplicates: the smallest id of a class stays, one row of it (that of the smallest text); texts
  without words are copies of each other; rows without an id all stay.
* decontamination: every row whose own text holds an item goes; items of fewer than five words match nothing.
* mixture: null source and language count as ''; repeated rows are drawn alike, rows without an id by
  their text; no ties can occur.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm import common, decontaminate, line_dedup, minhash, mixing, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    return quality_rules.keep_good(docs, common.table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without blocks of lines that an earlier document holds."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class."""
    return minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target shares of sources, languages and topics."""
    return mixing.mixed(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
]

#: The learned rules, the alignment and the sketches have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    folder = f"{common.shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs, last = common.table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            common.drop_folder(spark, last)
        last = path
    return docs
