"""Files of lines read by ranges of bytes: the ends of transcripts, and logs that grow.

Spark's text source reads files whole. Here a partition is a range of bytes: `file_tails` reads no more of a file than its
last bytes, and `growing_lines` no more than what a stream has not had yet. Paths are those that pyarrow's file systems open.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import variants as V

TAIL_BYTES, TAIL_LINES = 32_768, 20  # of a transcript
FILES, RANGE, STEP = 64, 64 << 20, 1 << 16  # files or bytes of a partition; bytes read at once where an end is looked for


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder, or of one file; none where it is missing. Names with a leading dot or
    underscore are not data."""
    fs, inner = opened(path)
    own = fs.get_file_info(inner)
    infos = [own] if own.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(inner, recursive=True)) if own.type == pafs.FileType.Directory else []
    return sorted((i.path, i.size) for i in infos if i.type == pafs.FileType.File and (i is own or i.base_name[0] not in "._"))


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


# --- ends of files


class TailReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.bytes, self.lines = options["path"], int(options.get("bytes", TAIL_BYTES)), int(options.get("lines", TAIL_LINES))

    def partitions(self) -> list[InputPartition]:
        files = listed(self.path)
        return [Files(files[k : k + FILES]) for k in range(0, len(files), FILES)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        for path, size in getattr(partition, "files", []):
            with fs.open_input_file(path) as f:
                f.seek(max(0, size - self.bytes))
                data = f.read(min(size, self.bytes))
            lines = data.decode("utf-8", "replace").strip().splitlines()
            for place, line in enumerate(lines[-self.lines :]):
                yield path, size, len(data), place, line


class FileTails(DataSource):
    """The last lines of each file of a folder. Options: path, bytes, lines."""

    @classmethod
    def name(cls) -> str:
        return "file_tails"

    def schema(self) -> str:
        return "path string, size long, bytes_read long, place int, value string"

    def reader(self, schema) -> DataSourceReader:
        return TailReader(self.options)


def read_tails(spark: SparkSession, path: str, most_bytes: int = TAIL_BYTES, lines: int = TAIL_LINES) -> DataFrame:
    """(path, size, bytes_read, place, value): at most so many lines from at most so many bytes of each file's end; the first
    one may have lost its beginning."""
    spark.dataSource.register(FileTails)
    return spark.read.format("file_tails").option("path", path).option("bytes", str(most_bytes)).option("lines", str(lines)).load()


def content_text(content: Column) -> Column:
    """A message's text: itself, or its text blocks joined by a space."""
    blocks = F.coalesce(F.when(V.kind(content).startswith("ARRAY<"), F.try_variant_get(content, "$", "array<variant>")), F.array().cast("array<variant>"))
    texts = F.transform(F.filter(blocks, lambda b: V.is_object(b) & F.coalesce(V.text(b, "type") == "text", F.lit(False))), lambda b: V.text(b, "text"))
    return F.when(V.kind(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(F.array_join(F.array_compact(texts), " "))


def last_responses(tails: DataFrame) -> DataFrame:
    """(path, said): the newest assistant entry of each transcript's tail. A line that is no JSON, or whose entry has no
    message, does not count. Its role is `type`, or `role` where that is missing or null."""
    e = tails.select("path", "place", V.parse("value").alias("v")).where(V.is_object(F.col("v")))
    kind = V.kind(V.member(F.col("v"), "type"))
    role = F.when(kind.isNull() | (kind == "VOID"), V.text(F.col("v"), "role")).otherwise(V.text(F.col("v"), "type"))
    message = V.member(F.col("v"), "message")
    e = e.where((role == "assistant") & V.is_object(message)).select("path", "place", content_text(V.member(message, "content")).alias("said"))
    return e.groupBy("path").agg(F.max_by("said", "place").alias("said"))  # a tail's lines at most


# --- files that grow


def line_end(f, size: int) -> int:
    """Where the last whole line of the first `size` bytes ends. It reads back from there, no further than that line's end."""
    at = size
    while at > 0:
        begin = max(0, at - STEP)
        f.seek(begin)
        cut = f.read(at - begin).rfind(b"\n")
        if cut >= 0:
            return begin + cut + 1
        at = begin
    return 0


def lines_of(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in a range; the last one is read to its end, wherever that is."""
    at = start
    if start:
        f.seek(start - 1)
        if f.read(1) != b"\n":  # a line that began before
            at = start + len(_to_end(f))
    f.seek(at)
    rest, base = b"", at
    while base < end:
        data = f.read(min(STEP, end - base - len(rest))) if base + len(rest) < end else b""
        if not data:
            if rest:
                yield base, (rest + _to_end(f)).rstrip(b"\r\n")
            return
        rest += data
        *whole, rest = rest.split(b"\n")
        for line in whole:
            yield base, line.rstrip(b"\r")
            base += len(line) + 1


def _to_end(f) -> bytes:
    """From here to the end of the line, with it."""
    parts = []
    while data := f.read(STEP):
        cut = data.find(b"\n")
        if cut >= 0:
            return b"".join([*parts, data[: cut + 1]])
        parts.append(data)
    return b"".join(parts)


class GrowingReader(DataSourceStreamReader):
    """Offsets are the bytes of each file that are behind: ends of lines, so a line that is still written is left for later."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.range = int(options.get("range", RANGE))
        self.ends: dict[str, tuple[int, int]] = {}  # by file: size when looked at, end of its last line

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        fs, _ = opened(self.path)
        for path, size in listed(self.path):
            if self.ends.get(path, (-1, 0))[0] != size:
                with fs.open_input_file(path) as f:
                    self.ends[path] = (size, line_end(f, size))
        return {"files": json.dumps({p: end for p, (_, end) in sorted(self.ends.items())})}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        return [Range(p, a, min(a + self.range, new[p])) for p in sorted(new) for a in range(old.get(p, 0), new[p], self.range)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        with fs.open_input_file(partition.path) as f:
            for offset, line in lines_of(f, partition.start, partition.end):
                yield partition.path, offset, line.decode("utf-8", "replace")


class GrowingLines(DataSource):
    """Lines added to the files of a folder, as a stream. Options: path, range (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "path string, offset long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(self.options)


def follow_lines(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """A stream of (path, offset, value): each whole line once, with its place in its file."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("path", path).option("range", str(range_bytes)).load()
