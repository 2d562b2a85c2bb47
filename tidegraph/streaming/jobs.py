"""Incremental jobs as Structured Streaming queries over append-only drops of JSON lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegraph.functions import scores as S
from tidegraph.operators.merge import live_upsert
from tidegraph.operators.scoring import score_texts
from tidegraph.operators.stored import Stored, delete, exists, path_of


def drops(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over a folder to which files are only added; the query's checkpoint is the cursor."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def collect(stream: DataFrame, target: str, checkpoint: str, key: list[str], first: list[str], last: list[str], order: list[str]) -> StreamingQuery:
    """Rows by natural key, first-seen and last-seen columns, as a log of what each batch says.

    A batch is reduced to one row for each key and written to a folder of its own, so its cost
    follows its size and a batch that is run again replaces its folder; ``collected`` merges.
    """

    def append(batch: DataFrame, n: int) -> None:
        by = F.struct(*order)
        out = batch.groupBy(*key).agg(
            *[F.min_by(c, by).alias(c) for c in first], *[F.max_by(c, by).alias(c) for c in last], F.min(by).alias("__first"), F.max(by).alias("__last")
        )
        out.write.mode("overwrite").parquet(f"{target}/batch={n}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected(spark: SparkSession, target: str, key: list[str], first: list[str], last: list[str]) -> DataFrame:
    """The table that the batches of ``collect`` add up to: the newest folded part and the batches after it."""
    return _added_up(_log(spark, target)[0], key, first, last).drop("__first", "__last")


def fold(spark: SparkSession, target: str, key: list[str], first: list[str], last: list[str], keep: int = 16) -> bool:
    """Fold a log of more than ``keep`` batches into one part, so that reading it doesn't slow down with its age; between two runs of ``collect``.

    The part is whole before what it replaces goes; an interrupted fold leaves the log as it was, or folders that are no longer read.
    """
    rows, upto, batches, old = _log(spark, target)
    if len(batches) <= keep:
        return False
    _added_up(rows, key, first, last).write.mode("overwrite").parquet(f"{target}/folded={upto}")
    for name in [f"batch={n}" for n in batches] + [f"folded={n}" for n in old if n != upto]:
        delete(spark, f"{target}/{name}")
    return True


def _added_up(rows: DataFrame, key: list[str], first: list[str], last: list[str]) -> DataFrame:
    values = [F.min_by(c, "__first").alias(c) for c in first] + [F.max_by(c, "__last").alias(c) for c in last]
    return rows.groupBy(*key).agg(*values, F.min("__first").alias("__first"), F.max("__last").alias("__last"))


def _log(spark: SparkSession, target: str) -> tuple[DataFrame, int, list[int], list[int]]:
    """(rows, last batch, unfolded batches, folded parts) of the log; folders without a success mark don't count."""
    fs, path = path_of(spark, target)
    found: dict[str, list[int]] = {"batch": [], "folded": []}
    for entry in fs.listStatus(path):
        name, _, n = entry.getPath().getName().partition("=")
        if name in found and exists(spark, f"{target}/{name}={n}/_SUCCESS"):
            found[name].append(int(n))
    base = max(found["folded"], default=-1)
    batches = sorted(n for n in found["batch"] if n > base)
    parts = [f"{target}/folded={base}"] * (base >= 0) + [f"{target}/batch={n}" for n in batches]
    return spark.read.parquet(*parts), max([base, *batches]), batches, found["folded"]


def append_log(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """The rows of each batch in files, exactly once."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Groups that the keys of a cursor are dealt to; each is looked at in one go and holds the cursors of its keys.
CURSOR_GROUPS = 1024


def since_cursor(stream: DataFrame, key: list[str], newest: str) -> DataFrame:
    """Rows beyond the cursor of their key, the greatest ``newest`` (a long) that earlier batches had.

    The cursor is state of the query, one number a key however many rows were seen; a batch without rows
    of a key leaves its cursor as it is, and a restart goes on from it.  Repeats inside a batch come once;
    rows without ``newest`` can't be placed and are left out; null keys are keys.  Keys are dealt to
    ``CURSOR_GROUPS`` groups, so that there is no call of Python for each key.
    """
    rows = stream.where(F.col(newest).isNotNull())
    schema = rows.schema
    keyed = rows.select(F.to_json(F.struct(*key)).alias("key"), F.col(newest).alias("at"), F.to_json(F.struct(*rows.columns)).alias("row"))
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(CURSOR_GROUPS)))

    def beyond(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, tops = state.get if state.exists else ([], [])
        cursor = pd.Series(list(tops), index=pd.Index(list(names), dtype=object), dtype="int64")
        seen: pd.DataFrame | None = None
        for b in batches:
            place = cursor.index.get_indexer(b["key"])
            known = place >= 0
            fresh = ~known
            if known.any():
                fresh[known] = b["at"].to_numpy()[known] > cursor.to_numpy()[place[known]]
            b = b[fresh].drop_duplicates(["key", "at"])
            if seen is not None and len(b):
                both = pd.concat([seen, b[["key", "at"]]], ignore_index=True)
                b = b[~both.duplicated().to_numpy()[len(seen) :]]
            if len(b):
                seen = b[["key", "at"]] if seen is None else pd.concat([seen, b[["key", "at"]]], ignore_index=True)
                yield b[["row"]]
        if seen is not None:
            new = seen.groupby("key")["at"].max()  # beyond the cursors that there were
            cursor = pd.concat([cursor[~cursor.index.isin(new.index)], new])
        state.update((cursor.index.tolist(), cursor.tolist()))

    out = keyed.groupBy("bucket").applyInPandasWithState(beyond, "row string", "names array<string>, tops array<long>", "append", GroupStateTimeout.NoTimeout)
    return out.select(F.from_json("row", schema).alias("r")).select("r.*")


def score(stream: DataFrame, scorer: Callable[[pd.Series], pd.Series], target: str, checkpoint: str, lang: str | None = None) -> StreamingQuery:
    """Each text is scored once, texts of like length together; the checkpoint makes a batch's folder exactly once."""

    def append(batch: DataFrame, n: int) -> None:
        score_texts(batch, scorer, lang=lang).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_counts(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Texts by language and bin, kept up to date in a stored table (language '??' for none, bin -1 for no score).

    A batch sends the totals that it changed, with its number; a batch that is run again finds its own and changes nothing.
    """
    lang = F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("??"))
    bins = F.coalesce(S.bin_of(S.present(F.col("probability")), 5), F.lit(-1))
    out = stream.select(lang.alias("lang"), bins.alias("bin")).groupBy("lang", "bin").agg(F.count("*").alias("n"))
    table = _counts(target)
    if not exists(stream.sparkSession, target):
        table.create(stream.sparkSession.createDataFrame([], COUNTS))

    def put(batch: DataFrame, n: int) -> None:
        table.upsert(batch.withColumn("epoch", F.lit(n).cast("bigint")), ["epoch"])

    return out.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


COUNTS = "lang string, bin int, n bigint, epoch bigint"


def _counts(target: str) -> Stored:
    return Stored(target, COUNTS, ("lang", "bin"), buckets=4)


def counted(spark: SparkSession, target: str) -> DataFrame:
    """The counts that ``live_counts`` keeps, with the batch that changed each last."""
    return _counts(target).read(spark)


def due(stream: DataFrame, days: int, target: str, checkpoint: str) -> StreamingQuery:
    """Posts to enrich again, each once, when posts created ``days`` days later have come by.

    ``stream`` has interactions (id, created_at, raw, seen_at) with posts, in any order and any number of
    times; a post goes out with its newest counters.  Only posts of the last ``days`` days are held, and
    interactions with a post that went out come too late and are dropped.  Posts without a time never fall due.
    """
    held = stream.withWatermark("created_at", f"{days} days").groupBy("id", "created_at")
    out = held.agg(F.max_by("raw", F.struct("seen_at", "raw")).alias("raw"), F.max("seen_at").alias("seen_at"))
    return append_log(out, target, checkpoint)


def re_enrich(posts: DataFrame, stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """A scheduled run: the counters (id, raw, seen_at) that arrived since the last run are collected, then merged into the posts (id, raw, seen_at, ...)."""
    collect(stream, target, checkpoint, ["id"], [], ["raw", "seen_at"], ["seen_at"]).awaitTermination()
    return enrich(posts, collected(posts.sparkSession, target, ["id"], [], ["raw", "seen_at"]))


def enrich(posts: DataFrame, fresh: DataFrame) -> DataFrame:
    """Posts with the newest counters (id, raw, seen_at); what else they have stays as first seen."""
    both = posts.withColumn("seen_at", F.lit(None).cast("timestamp")).unionByName(fresh.select("id", "raw", "seen_at"), allowMissingColumns=True)
    kept = [c for c in posts.columns if c not in ("id", "raw")]
    merged = live_upsert(both, ["id"], [], ["raw"], ["seen_at"])
    return posts.select("id", *kept).join(merged, "id").select(*posts.columns)
