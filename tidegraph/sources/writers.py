"""Sinks: corpora, bundles, graphs, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.iterate import cut
from tidegraph.functions.scores import percent_probability
from tidegraph.operators.compare import joined


def corpus(posts: DataFrame, path: str) -> None:
    """The cleaned posts as JSON lines."""
    posts.select("id", F.col("language").alias("lang"), "text", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at")).write.json(path)


def bundle(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Each table as JSON lines (gzip) below ``path``, and its rows (counted as they are written)."""
    from pyspark.sql import Observation

    counts = {}
    for name, df in tables.items():
        seen = Observation(f"rows_{name}")
        df.observe(seen, F.count("*").alias("n")).write.option("compression", "gzip").json(f"{path}/{name}")
        counts[name] = seen.get["n"]
    return counts


def graph(nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Nodes and edges, times as ISO text."""
    iso = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if t == "timestamp" else F.col(c) for c, t in edges.dtypes]
    nodes.write.format(fmt).save(f"{path}/nodes")
    edges.select(*iso).write.format(fmt).save(f"{path}/edges")


def typed_rows(rows: DataFrame) -> DataFrame:
    """Text rows (id, lang, text, ai_probability) with typed id and probability; bad numbers are null."""
    return rows.select(F.col("id").try_cast("bigint").alias("id"), "lang", "text", F.col("ai_probability").try_cast("double").alias("ai_probability"))


def csv_to_json(rows: DataFrame, path: str) -> None:
    """A CSV frame as JSON lines."""
    typed_rows(rows).write.json(path)


def corrected_scores(rows: DataFrame, percent: str = "ai_probability_pct") -> DataFrame:
    """Detector rows with a ``probability`` from 0 to 1 beside their percentage."""
    return rows.withColumn("probability", percent_probability(F.col(percent)))


def merged_scores(detectors: dict[str, DataFrame], path: str) -> None:
    """Every id of any detector with the probability of each, as JSON lines."""
    rows = joined(detectors)
    rows.select("id", *[F.col(n).alias(f"probability_{n}") for n in detectors]).write.json(path)


def check_report(checks: DataFrame) -> DataFrame:
    """Checks with the addresses of their evidence joined by '; ' (evidence: array of structs with ``url``)."""
    urls = F.filter(F.transform("evidence", lambda e: e["url"]), lambda u: u.isNotNull())
    return checks.withColumn("evidence_urls", F.concat_ws("; ", urls)).drop("evidence")


def _table_line(columns: list[str]):
    """A row of a Markdown table."""
    return lambda x: F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(x[c].cast("string"), F.lit("-")) for c in columns]), F.lit(" |"))


def write_report(totals: DataFrame, sections: dict[str, DataFrame], path: str, title: str) -> DataFrame:
    """A report of one row of totals and small tables (bins, languages, extremes).

    Written as one JSON object in ``path``/json, each table an array of objects, and as Markdown
    lines in ``path``/md; the lines (place, value) come back.
    """
    one = totals
    for name, rows in sections.items():
        one = one.crossJoin(rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(name)))
    one = cut(one)
    one.coalesce(1).write.json(f"{path}/json")
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    lines = [F.lit(f"# {title}"), F.lit(""), F.lit("| figure | value |"), F.lit("| --- | --- |"), *[F.concat(F.lit(f"| {c} | "), cell(c), F.lit(" |")) for c in totals.columns]]
    whole = F.array(*lines)
    for name, rows in sections.items():
        head = [F.lit(""), F.lit(f"## {name}"), F.lit(""), F.lit(f"| {' | '.join(rows.columns)} |"), F.lit("|" + " --- |" * len(rows.columns))]
        whole = F.concat(whole, F.array(*head), F.transform(name, _table_line(rows.columns)))
    out = one.select(F.posexplode(whole).alias("place", "value"))
    out.coalesce(1).sortWithinPartitions("place").select("value").write.text(f"{path}/md")
    return out
