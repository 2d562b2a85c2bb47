"""WARC archives: writing, reading back, and a merged capture index.

Archives are written by Spark's text writer, so they go to whatever file system the shared
folder is on, and a lost executor's files are written again.  Each record is a gzip member of
its own (the writer's separator is an empty member), so a record can be read from its offset.
Equal payloads are stored once: the record with the smallest id is a ``response``, the
others are ``revisit`` records that name it.

Reading parses each archive member by member and yields that archive's captures as a run sorted
by (URL key, timestamp, id).  The merge is external: every run is cut at sampled range bounds
into pieces that stay in order, the pieces travel whole to the task of their range, which spools
them to a file of its own and merges all runs with a loser tree that holds one piece of each.
That gives one globally ordered capture history (range number, then place in it).

Defined cases: a null html is an empty payload; empty payloads are equal to each other;
a null url gets the target ``urn:tidegraph:none`` and reads back as null; a null id sorts
last and reads back as null; blanks and control characters in a url are percent-encoded in the record's header, the url itself
is carried beside it; an empty table gives no archives and no captures; repeated rows
are separate records (of equal ids the payload is stored for each); captures with equal keys are
ordered by archive and offset; ids are whole numbers or texts; a very long page is one record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import tempfile
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the WARC format.
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

NO_URL = "urn:tidegraph:none"
#: Columns of a capture; ``id`` is the type of the ids.
CAPTURES = (
    "url_key string, captured_at string, page_id id, url string, archive string, offset bigint, "
    "payload_bytes bigint, payload_digest string, record_type string, refers_to id"
)
#: An empty gzip member: what the writer puts between records.
EMPTY = gzip.compress(b"", mtime=0)
#: Bytes of uncompressed records that an archive holds on average, and captures in a piece of a run.
ARCHIVE_BYTES, PIECE = 64_000_000, 1000
WHOLE = ("tinyint", "smallint", "int", "bigint")


def id_type(pages: DataFrame) -> str:
    """``bigint`` for ids that are whole numbers, else ``string``."""
    return "bigint" if pages.schema["page_id"].dataType.simpleString() in WHOLE else "string"


def captures_schema(ids: str) -> str:
    return CAPTURES.replace(" id,", f" {ids},").replace("refers_to id", f"refers_to {ids}")


def arrow_schema(ids: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in captures_schema(ids).split(", "))])


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a string's UTF-8 bytes: five hex digits are four base32 digits."""
    hexed = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def marked(pages: DataFrame) -> DataFrame:
    """Pages with payload, its digest, and ``refers_to``: the first record with an equal payload.

    Only ids and digests are grouped; AQE splits or broadcasts the join of a digest that
    very many pages share.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    shared = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).where("n > 1")
    out = rows.join(shared.drop("n"), "digest", "left")
    return out.withColumn("refers_to", F.when(F.col("first") != F.col("page_id"), F.col("first")).when(F.col("page_id").isNull(), F.col("first"))).drop("first")


def record_id(page_id: Column) -> Column:
    """The record's URN, from the id."""
    hashed = F.md5(F.concat(F.lit("tidegraph-page-"), F.coalesce(page_id.cast("string"), F.lit("-"))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(hashed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def capture_date(page_id: Column, ids: str) -> Column:
    """The pages carry no time: seconds from 2024 on, by the id."""
    number = page_id.cast("bigint") if ids == "bigint" else F.crc32(page_id.cast("string"))
    seconds = F.pmod(F.coalesce(number, F.lit(0)), F.lit(1_000_000_000))
    return F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def safe_url(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit(NO_URL)), r"[\x00-\x20\x7F]", "%20")


def record(ids: str = "bigint") -> Column:
    """The whole WARC record of a row of ``marked``, its closing blank lines included."""
    revisit = F.col("refers_to").isNotNull()
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length("payload").cast("string"), F.lit(CRLF + CRLF),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    safe = safe_url(F.col("url"))
    lines = [
        F.lit("WARC/1.1"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", record_id(F.col("page_id"))),
        field("WARC-Date", capture_date(F.col("page_id"), ids)),
        field("WARC-Target-URI", safe),
        F.when(F.col("url").isNotNull() & (safe != F.col("url")), field("X-Target-URI-Base64", F.translate(F.base64(F.col("url").cast("binary")), CRLF, ""))),
        F.when(F.col("page_id").isNotNull(), field("X-Page-Id", F.base64(F.col("page_id").cast("string").cast("binary")))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(revisit, field("WARC-Refers-To", record_id(F.col("refers_to")))),
        F.when(revisit, field("WARC-Refers-To-Target-URI", safe_url(F.col("first_url")))),
        F.when(revisit, field("WARC-Refers-To-Date", capture_date(F.col("refers_to"), ids))),
        F.when(revisit, field("X-Refers-To-Page-Id", F.base64(F.col("refers_to").cast("string").cast("binary")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        field("Content-Length", F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block, F.lit(CRLF + CRLF))


def write_archives(pages: DataFrame, path: str, records_per_file: int | None = None) -> None:
    """Write all pages as WARC files, each record a gzip member; files hold some ``ARCHIVE_BYTES`` of records on average."""
    if records_per_file is None:
        mean = pages.agg(F.avg(F.octet_length("html"))).collect()[0][0] or 0
        records_per_file = max(1, int(ARCHIVE_BYTES / (mean + 600)))

    @F.pandas_udf("binary")
    def member(records: pd.Series) -> pd.Series:
        return records.map(lambda x: gzip.compress(x, mtime=0))

    out = marked(pages).select(member.asNondeterministic()(record(id_type(pages)).cast("binary")).cast("string").alias("value"))
    # the bytes of a member go out as they are; latin-1 makes those of the separator
    writer = out.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records_per_file)
    writer.text(path)


def members(content: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the gzip members of an archive from an offset on; empty ones are passed over."""
    view = memoryview(content)
    while at < len(view):
        d, start, parts = zlib.decompressobj(31), at, []
        while not d.eof:
            if at >= len(view):
                raise ValueError("archive ends inside a record")
            step = view[at : at + 16_384]
            parts.append(d.decompress(step))
            at += len(step) - len(d.unused_data)
        if data := b"".join(parts):
            yield start, data


def parse(content: bytes, at: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, content block) of each record of one archive from an offset on."""
    for start, data in members(content, at):
        end = data.index(b"\r\n\r\n")
        head = data[:end].decode("utf-8").split(CRLF)
        if head[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {start}")
        fields = dict(x.split(": ", 1) for x in head[1:])
        size = int(fields["Content-Length"])
        if len(data) != end + 8 + size or data[-4:] != b"\r\n\r\n":
            raise ValueError(f"the record at {start} has not its stated length")
        yield start, fields, data[end + 4 : end + 4 + size]


def url_key(url: str | None) -> str:
    """A sortable URL key: host labels reversed, then port and path, in lower case."""
    if url is None:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0].lower()
    cut = min([i for i in (rest.find(c) for c in "/?") if i >= 0], default=len(rest))
    host, _, port = rest[:cut].rpartition("@")[2].partition(":")
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (rest[cut:] or "/")


def _key(row: tuple) -> tuple:
    """URL key, time, id (null last), then archive and offset, so that no two captures tie."""
    return row[0], row[1], row[2] is None, 0 if row[2] is None else row[2], *row[4:6]


def captures_of(archive: str, content: bytes, ids: str = "bigint") -> list[tuple]:
    """The run of one archive: its captures sorted by URL key, time and id."""
    plain = lambda x: None if x is None else base64.b64decode(x).decode("utf-8")
    number = lambda x: x if x is None or ids == "string" else int(x)
    run = []
    for at, fields, block in parse(content):
        split = block.index(b"\r\n\r\n")
        http, payload = block[:split].decode("utf-8").split(CRLF), block[split + 4 :]
        stated = int(next(x.split(": ", 1)[1] for x in http if x.startswith("Content-Length: ")))
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = fields["WARC-Type"]
        if kind == "response":
            stated = len(payload)
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if found != digest:
                raise ValueError(f"payload of the record at {at} in {archive} is damaged")
        url = plain(fields.get("X-Target-URI-Base64")) or fields["WARC-Target-URI"]
        url = None if url == NO_URL else url
        page_id, refers = (number(plain(fields.get(x))) for x in ("X-Page-Id", "X-Refers-To-Page-Id"))
        run.append((url_key(url), fields["WARC-Date"], page_id, url, archive, at, stated, digest, kind, refers))
    run.sort(key=_key)
    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in batch.columns], strict=True)


def read_runs(spark: SparkSession, path: str, ids: str = "bigint") -> DataFrame:
    """The captures of all archives below ``path``, each archive's run in order."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ids)
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                run = captures_of(name.as_py().rsplit("/", 1)[-1], content.as_buffer(), ids)
                for i in range(0, len(run), 10_000):
                    yield _batch(run[i : i + 10_000], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(runs, captures_schema(ids))


class LoserTree:
    """Merges k sorted iterators; each inner node remembers the loser of its match."""

    def __init__(self, runs: list[Iterator[tuple]], key=_key):
        self.key, self.runs, self.k = key, runs, len(runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i, start=True)

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), i, row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and x[:2] < y[:2]

    def _play(self, i: int, start: bool = False) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and start:
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.losers[0]] is not None:
            i = self.losers[0]
            yield self.heads[i][2]
            self.heads[i] = self._next(i)
            self._play(i)


def range_bounds(runs: DataFrame, ranges: int) -> list[tuple]:
    """Keys that cut all captures into ranges of about one size, from some twenty keys a range."""
    every = max(1, runs.count() // (20 * ranges))
    some = runs.where(F.pmod(F.xxhash64("archive", "offset"), F.lit(every)) == 0).select("url_key", "captured_at", "page_id", F.lit(None), "archive", "offset")
    keys = sorted(_key(tuple(r)) for r in some.collect())
    return [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []


def pieces_of(runs: DataFrame, bounds: list[tuple], ids: str) -> DataFrame:
    """(range_no, run, no, piece): the runs, stretches in key order of one archive, cut at the bounds into pieces of at most ``PIECE`` captures, each as bytes."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here, run, no, last = TaskContext.get().partitionId() << 32, 0, 0, None
        for batch in batches:
            starts, where = [], []
            for i, row in enumerate(_rows(batch)):
                key = _key(row)
                if last is not None and (row[4] != last[0] or key < last[1]):
                    run += 1
                at = (bisect_right(bounds, key), run)
                if not where or where[-1] != at or i - starts[-1] >= PIECE:
                    starts.append(i)
                    where.append(at)
                last = (row[4], key)
            out = []
            for (range_no, run_no), i, j in zip(where, starts, [*starts[1:], len(batch)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as writer:
                    writer.write_batch(batch.slice(i, j - i))
                out.append((range_no, here + run_no, no, sink.getvalue().to_pybytes()))
                no += 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            columns = zip(*out, strict=True) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["range_no", "run", "no", "piece"])

    return runs.mapInArrow(cut_up, "range_no int, run long, no long, piece binary")


def merge_runs(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """All captures in one global order of URL key, time and id, with ``range_no`` and ``place``.

    Ranges are of the whole sort key, so that a host with a third of all captures is spread over
    ranges like any other.
    """
    n = ranges or int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = common.cut(runs)
    ids = runs.schema["page_id"].dataType.simpleString()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ids)
        pieces = (row for batch in batches for row in _rows(batch))
        for range_no, own in groupby(pieces, key=itemgetter(0)):
            with tempfile.TemporaryFile() as spool:  # this task's own; a task that is run again spools again
                where: dict[int, list[tuple[int, int]]] = {}
                for _, run, _, piece in own:
                    where.setdefault(run, []).append((spool.tell(), len(piece)))
                    spool.write(piece)

                def cursor(places: list[tuple[int, int]], spool=spool) -> Iterator[tuple]:
                    for at, size in places:
                        spool.seek(at)
                        with pa.ipc.open_stream(spool.read(size)) as reader:
                            for batch in reader:
                                yield from _rows(batch)

                out, place = [], 0
                for row in LoserTree([cursor(x) for x in where.values()]):
                    out.append((*row, range_no, place))
                    place += 1
                    if len(out) == 10_000:
                        yield _batch(out, wide(schema))
                        out = []
                yield _batch(out, wide(schema))

    wide = lambda schema: schema.append(pa.field("range_no", pa.int32())).append(pa.field("place", pa.int64()))
    dealt = pieces_of(runs, range_bounds(runs, n), ids).repartition(n, "range_no").sortWithinPartitions("range_no", "run", "no")
    return dealt.mapInArrow(merged, f"{captures_schema(ids)}, range_no int, place long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC archives, read them back, merge the runs of the index."""
    pages = common.table(spark, sf_dir, "pages")
    path, ids = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}", id_type(pages)
    write_archives(pages, path)
    runs = common.cut(read_runs(spark, path, ids))
    common.drop_folder(spark, path)
    own = pages.schema["page_id"].dataType
    history = merge_runs(runs)
    return history.select(F.col("page_id").cast(own), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(own), "url_key", "captured_at")


ORACLE = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, url, strlen(payload) AS payload_bytes, sha1(payload) AS h FROM p
), b AS (
  SELECT page_id, url, payload_bytes, (
    SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(h, 1 + 5 * (k // 4), 5) AS bigint) >> (15 - 5 * (k % 4))) & 31 AS int), 1), '' ORDER BY k)
    FROM range(32) r(k)) AS payload_digest
  FROM d
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM b
), u AS (
  SELECT *, lower(split_part(regexp_replace(url, '^[^:/]*://', ''), '#', 1)) AS rest FROM f
)
SELECT page_id, cast(payload_bytes AS bigint) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
  array_to_string(list_reverse(string_split(regexp_replace(regexp_extract(rest, '^[^/?]*'), '^www\\.', ''), '.')), ',') || ')'
    || CASE WHEN regexp_extract(rest, '^[^/?]*(.*)$', 1) = '' THEN '/' ELSE regexp_extract(rest, '^[^/?]*(.*)$', 1) END AS url_key,
  strftime(make_timestamp((1704067200 + page_id % 1000000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
FROM u
"""
