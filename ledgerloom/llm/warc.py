"""WARC archives written and read by Spark, and their index merged by loser trees.

Writing: equal payloads are stored once, as a response; every other capture of them is a revisit record.
Files are written by Spark's text writer (so to any file system that Spark reaches), gzip by default.
Every record starts with the WARC version line and an extension field that holds a mark made afresh for
each archive; a payload written before the mark existed cannot hold it, so reading splits on exactly those
two lines, and Content-Length is checked for each record.
Each file is one capture run, sorted by URL key and time.  The runs' indexes are range-partitioned by
(URL key, time, id) and k-way merged by a loser tree in each range, so captures come out in global order
and a hot URL spreads over several ranges.  Each entry names its file and where the record stands in it (offset and
length in bytes of the file as it is without compression).

Defined results: a null payload is an empty one; rows that share the largest id of a payload are all
responses; times are written in UTC with microseconds, a null one as an empty date; a null URL has an empty key; line breaks in a URL are percent-encoded; a null id never becomes
the response of a payload that also has an id; captures of one URL and time are ordered by id, and rows equal in all of
these come in any order; repeated rows are records of their own; a page of any length is one record; other columns,
whatever their names, are not read; an empty table gives an empty archive.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, salted_join, written

#: RFC 4648's alphabet, and the profile's name in the WARC standard.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = "WARC/1.1"
RECORD_URN = "urn:capture:"
ROWS_PER_RANGE = 500_000


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: each five hex digits are four characters."""
    hexa = F.sha1(payload.cast("binary"))
    out = []
    for i in range(8):
        bits = F.conv(F.substring(hexa, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def url_key(url: Column) -> Column:
    """Host parts reversed, then path and query in lower case: com,example,www)/a?b."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))
    return F.coalesce(F.when(host != "", key).otherwise(F.lower(url)), F.lit(""))


def _plan_records(captures: DataFrame, least_bytes: int) -> DataFrame:
    """captures (_id, _url, _ts, _payload) with digest, bytes and the id of the response they refer to."""
    marked = captures.withColumn("_digest", payload_digest(F.col("_payload"))).withColumn("_bytes", F.octet_length("_payload").cast("long"))
    newest = written(marked.groupBy("_digest").agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_n")), "warc-payloads")
    total = newest.agg(F.sum("_n")).first()[0] or 0
    joined = salted_join(marked, newest, ["_digest"], "_n", total, F.struct("_id", "_url"))
    original = (F.col("_bytes") < least_bytes) | F.col("_first").isNull() | F.col("_id").eqNullSafe(F.col("_first"))
    return joined.withColumn("_refers", F.when(~original, F.col("_first")))


def utc_text(ts: Column) -> Column:
    """ISO 8601 in UTC with microseconds, whatever the session's time zone; empty for null."""
    us = F.unix_micros(ts.cast("timestamp"))
    two = lambda unit, most: F.lpad(F.pmod(F.floor(us / unit), F.lit(most)).cast("string"), 2, "0")
    day = F.date_from_unix_date(F.floor(us / 86_400_000_000).cast("int")).cast("string")
    return F.coalesce(F.concat(day, F.lit("T"), two(3_600_000_000, 24), F.lit(":"), two(60_000_000, 60), F.lit(":"), two(1_000_000, 60), F.lit("."), F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("Z")), F.lit(""))


def _record(mark: str) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("_refers").isNotNull()
    url = F.regexp_replace(F.regexp_replace(F.coalesce("_url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    ident = lambda c: F.concat(F.lit(f"<{RECORD_URN}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("_bytes").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("_payload")))
    return F.concat(
        F.lit(f"{VERSION}\r\nWARC-Mark: {mark}\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", ident(F.col("_id"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", utc_text(F.col("_ts"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", ident(F.col("_refers"))), F.lit(f"WARC-Profile: {SAME_PAYLOAD}\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit("\r\n"),  # the writer's line end is the second one
    )


def write_warc(captures: DataFrame, path: str, id_col: str, url_col: str, payload_col: str, ts: Column, least_bytes: int = 0, compression: str = "gzip") -> str:
    """Write a record per row; returns the archive's mark.  Equal payloads of least_bytes or more are stored once."""
    base = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), ts.alias("_ts"), F.coalesce(F.col(payload_col), F.lit("")).alias("_payload"))
    mark = uuid.uuid4().hex
    runs = _plan_records(base, least_bytes).withColumn("_key", url_key(F.col("_url"))).sortWithinPartitions("_key", "_ts", "_id")
    runs.select(_record(mark).alias("value")).write.option("lineSep", "\r\n").option("compression", compression).text(path)
    return mark


def read_warc(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """Records: run, turn (their order in it), record_length, id, url, ts, type, digest, payload_bytes, payload (null for revisits), refers_to, whole."""
    raw = spark.read.option("lineSep", f"{VERSION}\r\nWARC-Mark: {mark}\r\n").text(path).select("value", F.col("_metadata.file_name").alias("run"), F.monotonically_increasing_id().alias("turn")).where(F.col("value") != "")
    head = F.substring_index("value", "\r\n\r\n", 1)
    split = raw.withColumn("head", head).withColumn("block", F.expr("substr(value, length(head) + 5, length(value) - length(head) - 8)"))
    split = split.withColumn("http", F.concat(F.substring_index("block", "\r\n\r\n", 1), F.lit("\r\n\r\n")))
    field = lambda name, of="head": F.regexp_extract(of, rf"(?m)^{name}: ([^\r\n]*)", 1)
    ident = lambda name: F.nullif(F.regexp_extract(field(name), rf"^<{RECORD_URN}(.*)>$", 1), F.lit("")).cast("long")
    return split.select(
        "run",
        "turn",
        (F.octet_length("value") + len(f"{VERSION}\r\nWARC-Mark: {mark}\r\n")).cast("long").alias("record_length"),
        ident("WARC-Record-ID").alias("id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Date").try_cast("timestamp").alias("ts"),
        field("WARC-Type").alias("type"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        field("Content-Length", "http").cast("long").alias("payload_bytes"),
        F.when(field("WARC-Type") == "response", F.expr("substr(block, length(http) + 1)")).alias("payload"),
        ident("WARC-Refers-To").alias("refers_to"),
        ((F.octet_length("block") == field("Content-Length").cast("long")) & F.col("value").endswith("\r\n\r\n")).alias("whole"),
    )


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the root's winner is the next item."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # its match waits for the second player
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while self.k and self.heads[w := self.losers[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self._replay(w)


def merge_index(index: DataFrame, ranges: int | None = None, key: str = "url_key", ts: str = "capture_ts", ident: str = "page_id", run: str = "run") -> DataFrame:
    """index rows in the global order of (key, ts, ident); ranges of rows are merged from their sorted runs."""
    if ranges is None:
        ranges = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), index.count() // ROWS_PER_RANGE)
    order = [key, ts, ident]

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        starts = rows.index[rows[run].ne(rows[run].shift())].tolist()
        cols = [rows[key].tolist(), rows[ts].astype("int64").tolist(), rows[ident].fillna(-(2**63)).astype("int64").tolist()]
        runs = [zip(*(c[a:b] for c in cols), range(a, b)) for a, b in zip(starts, [*starts[1:], len(rows)])]
        yield rows.iloc[[x[-1] for x in LoserTree(runs)]]

    return index.repartitionByRange(ranges, *order).sortWithinPartitions(run, *order).mapInPandas(merge, index.schema)


def located(records: DataFrame) -> DataFrame:
    """records with record_offset: the bytes before each in its file."""
    before = Window.partitionBy("run").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("record_offset", F.coalesce(F.sum("record_length").over(before), F.lit(0)))


def archive_pages(pages: DataFrame, ts: Column, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write pages as an archive in the shared folder, read it back, and return its merged capture index.

    The digest and size of a response are taken from the payload that was read; a revisit has its own
    record's digest and the size its HTTP header states.
    """
    path = new_path(pages.sparkSession, "warc")
    mark = write_warc(pages, path, id_col, url_col, payload_col, ts, least_bytes)
    back = read_warc(pages.sparkSession, path, mark)
    response = F.col("type") == "response"
    index = back.select(
        F.col("id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, payload_digest(F.col("payload"))).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
        url_key(F.col("url")).alias("url_key"),
        F.col("ts").alias("capture_ts"),
        "run",
        "turn",
        "record_length",
        (F.col("whole") & (~response | (payload_digest(F.col("payload")) == F.col("digest")))).alias("intact"),
    )
    return merge_index(located(written(index, "warc-index")).drop("turn"))
