"""The tail of growing logs as a streaming source, and a sink that writes several tables under one manifest.

The source's offset names, for each file, a generation and how many bytes of it are taken; only whole lines are.  A file that
shrank, or whose first or last taken bytes changed, was truncated or replaced: it starts a new generation from its first
byte.  What an offset was planned from is kept in a folder beside the checkpoint, as generations must survive a restart.  Large ranges are
read in pieces, small ones together, each by one task.

The sink writes a micro-batch's tables in folders of the batch, overwriting what a failed attempt left, and then the batch's manifest.  Readers
take batches with a manifest only, so a batch shows in all tables or in none, however often it is repeated, and the stream's
offset moves after that.  Of each file its last generation counts.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LINES = "file string, generation int, ordinal long, value string"
#: Bytes that a task reads, rows of a batch, bytes that tell a generation, and bytes searched at a time for the last line end.
PIECE, ROWS, MARK, BLOCK = 64 << 20, 1_000, 256, 1 << 16


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (pafs.LocalFileSystem(), path)


def _bytes(fs: pafs.FileSystem, path: str, start: int, size: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(size, start) if size > 0 else b""


def _mark(fs: pafs.FileSystem, path: str, end: int) -> str:
    """What tells the first `end` bytes of a file from others: the first and the last of them."""
    size = min(MARK, end)
    return hashlib.sha256(_bytes(fs, path, 0, size) + _bytes(fs, path, end - size, size)).hexdigest()[:32]


def _line_end(fs: pafs.FileSystem, path: str, start: int, end: int) -> int:
    """The end of the last whole line in [start, end), or start."""
    while end > start:
        size = min(BLOCK, end - start)
        at = _bytes(fs, path, end - size, size).rfind(b"\n")
        if at >= 0:
            return end - size + at + 1
        end -= size
    return start


class Pieces(InputPartition):
    """What a task reads: (file, generation, from, to, first byte of the range, its end, mark of the range's end)."""

    def __init__(self, pieces: list[tuple]):
        self.pieces = pieces


class LogTailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.planned = options["path"], options["planned"]
        self.fs, self.root = _opened(self.path)

    def initialOffset(self) -> dict:
        return {}

    def _seen(self) -> dict:
        fs, folder = _opened(self.planned)
        name = f"{folder}/planned.json"
        return json.loads(_bytes(fs, name, 0, i.size)) if (i := fs.get_file_info(name)).is_file else {}

    def _keep(self, offset: dict) -> None:
        fs, folder = _opened(self.planned)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/planned.new") as f:
            f.write(json.dumps(offset).encode())
        fs.move(f"{folder}/planned.new", f"{folder}/planned.json")

    def latestOffset(self) -> dict:
        seen = self._seen()
        now = dict(seen)
        for info in self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            name = info.path[len(self.root) :].lstrip("/")
            if not info.is_file or name.rpartition("/")[2].startswith(("_", ".")):
                continue
            before = seen.get(name, {"generation": 0, "size": 0, "mark": _mark(self.fs, info.path, 0), "length": -1, "changed": -1})
            changed = info.mtime_ns or 0
            if (info.size, changed) == (before["length"], before["changed"]):
                continue
            generation, start = before["generation"], before["size"]
            if info.size < start or _mark(self.fs, info.path, start) != before["mark"]:
                generation, start = generation + 1, 0
            end = _line_end(self.fs, info.path, start, info.size)
            now[name] = {"generation": generation, "size": end, "mark": _mark(self.fs, info.path, end), "length": info.size, "changed": changed}
        if now != seen:
            self._keep(now)
        return {name: {k: e[k] for k in ("generation", "size", "mark")} for name, e in now.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out, held, room = [], [], PIECE
        for name, e in sorted(end.items()):
            s = start.get(name, {"generation": -1, "size": 0})
            first = s["size"] if s["generation"] == e["generation"] else 0
            if s["generation"] == e["generation"] and first >= e["size"]:
                continue
            for a in range(first, max(e["size"], first + 1), PIECE):
                b = min(a + PIECE, e["size"])
                held.append((name, e["generation"], a, b, first, e["size"], e["mark"]))
                room -= max(b - a, 1)
                if room <= 0:
                    out.append(Pieces(held))
                    held, room = [], PIECE
        return [*out, Pieces(held)] if held else out

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("generation", pa.int32()), ("ordinal", pa.int64()), ("value", pa.string())])
        for name, generation, a, b, first, end, mark in partition.pieces:
            path = f"{self.root}/{name}"
            info = self.fs.get_file_info(path)
            if not info.is_file or info.size < end or _mark(self.fs, path, end) != mark:
                continue  # replaced since: the next offset has its new generation
            rows = [(-1, None)] if a == 0 else []  # a generation shows even while it has no whole line
            with io.BufferedReader(self.fs.open_input_file(path), 1 << 20) as f:
                at = a
                if a > first:  # a line belongs to the piece in which it starts
                    f.seek(a - 1)
                    at += len(f.readline()) - 1
                f.seek(at)
                while at < b:
                    line = f.readline()
                    rows.append((at, line.rstrip(b"\r\n").decode("utf-8", "replace")))
                    at += len(line)
                    if len(rows) == ROWS:
                        yield self._batch(schema, name, generation, rows)
                        rows = []
            if rows:
                yield self._batch(schema, name, generation, rows)

    @staticmethod
    def _batch(schema: pa.Schema, name: str, generation: int, rows: list[tuple]) -> pa.RecordBatch:
        at, values = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([generation] * len(rows), pa.int32()), pa.array(at, pa.int64()), pa.array(values, pa.string())], schema=schema)

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """spark.readStream.format("log_tail").option("path", folder).option("planned", folder of its own)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> LogTailReader:
        return LogTailReader(self.options)


def stream_tail(spark: SparkSession, path: str, planned: str) -> DataFrame:
    """Lines that growing logs gain.  `ordinal` is the byte at which a line starts; a row with ordinal -1 and no value opens a generation."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("path", path).option("planned", planned).load()


def write_together(path: str, tables: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each table of a batch in a folder of its own, then the batch's manifest.

    The opened generations of the batch's files are a table `generations` beside them."""

    def batch(df: DataFrame, epoch: int) -> None:
        df = df.persist()
        try:
            for name, make in tables.items():
                make(df.where("ordinal >= 0")).write.mode("overwrite").parquet(f"{path}/{name}/batch={epoch}")
            df.where("ordinal < 0").select("file", "generation").write.mode("overwrite").parquet(f"{path}/generations/batch={epoch}")
            df.sparkSession.range(1).select(F.lit(epoch).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{path}/manifest/{epoch}")
        finally:
            df.unpersist()

    return batch


def committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table that write_together() wrote: rows of batches with a manifest, of each file's last generation; with file and generation."""
    batches = F.broadcast(spark.read.parquet(f"{path}/manifest/*").distinct())  # a number a batch
    within = lambda table: spark.read.parquet(f"{path}/{table}").withColumn("batch", F.col("batch").cast("long")).join(batches, "batch", "left_semi").drop("batch")
    last = within("generations").groupBy("file").agg(F.max("generation").alias("generation"))
    return within(name).join(last, ["file", "generation"], "left_semi")
