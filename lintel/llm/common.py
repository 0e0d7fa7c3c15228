"""What the training-data operators share: tables, shared folders, and Arrow text as flat numpy bytes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


ROWS = 2000  # rows of text that go to a Python worker at once; a session's smaller setting stands


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting, "10000")) <= ROWS:
        spark.conf.set(setting, str(ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not kept.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = kept.get() if kept.isDefined() else tempfile.mkdtemp(prefix="lintel-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def made() -> int:
    """How many paths this driver has made so far; see released()."""
    return len(_made)


def released(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Deletes what was made in the shared folder since then, but for the tables given. Only for those who know that nothing
    else that is still to run reads it: a lazy result reads its operator's tables."""
    kept = {name for df in keep for x in df.inputFiles() for name in x.split("/")}
    for path in _made[since:]:
        if path.rsplit("/", 1)[1] not in kept:
            delete(spark, path)
            _made.remove(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path of the shared folder, for workers, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table made by written(), once nothing reads it any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        delete(df.sparkSession, f)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def one_row_each(docs: DataFrame, kept: DataFrame, group: str, id_col: str, digest: Column) -> DataFrame:
    """The rows of docs that stay when of each group one does. kept: (doc_id, h, group) of the rows that may stay, h being
    `digest` of a row. Of several a group has that with the smallest h; of rows that repeat id and h one is taken."""
    keep_id, keep_h, many, own = (fresh(docs, x) for x in ("keep_id", "keep_h", "many", "own_h"))
    one = kept.groupBy(group).agg(F.min(F.struct("h", "doc_id")).alias("k"), F.count(F.lit(1)).alias("n"))
    one = one.select(F.col("k.doc_id").alias(keep_id), F.col("k.h").alias(keep_h), (F.col("n") > 1).alias(many))
    met = docs.withColumn(own, digest).join(one, F.col(id_col).cast("long").eqNullSafe(F.col(keep_id)) & F.col(own).eqNullSafe(F.col(keep_h)))
    rows = met.where(~F.col(many)).unionByName(met.where(many).dropDuplicates([keep_id, keep_h]))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


BITS, PIECES = 1 << 26, 64


def bit_of(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BITS - 1)).astype(np.int64)


def bitmap(ids: DataFrame) -> dict[int, bytes]:
    """ids (id: hashes) -> bits by which most others are told apart: 8 MB whatever their number, in compressed pieces, each
    filled by one task. A bit that is not set proves that a hash is not among them."""
    size = BITS // PIECES

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            at = bit_of(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            for p in np.unique(at // size).tolist():
                own = pieces.setdefault(p, np.zeros(size, bool))
                own[at[at // size == p] % size] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), pa.array([zlib.compress(np.packbits(v, bitorder="little").tobytes(), 1) for v in pieces.values()], pa.binary())], names=["piece", "bits"])

    dealt = ids.select("id", F.floor(F.col("id").bitwiseAND(BITS - 1) / size).alias("piece")).repartition(PIECES, "piece")
    return {r.piece: bytes(r.bits) for r in dealt.select("id").mapInArrow(fill, "piece int, bits binary").collect()}


def unpacked(pieces: dict[int, bytes]) -> np.ndarray:
    out, size = np.zeros(BITS // 8, np.uint8), BITS // 8 // PIECES
    for piece, bits in pieces.items():
        out[piece * size : (piece + 1) * size] = np.frombuffer(zlib.decompress(bits), np.uint8)
    return out


def marked(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set in an unpacked bitmap."""
    at = bit_of(h)
    return (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def digests(data: memoryview, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(n x 2 int64) XXH3 digests of 128 bits of data[start:end]."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def stretches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Rows sorted by their first column, a long, in stretches of about so many rows that cut no value of it."""
    kept: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        if n >= rows:
            now = pa.Table.from_batches(kept)
            key = now.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield now.slice(0, cut)
            kept, n = now.slice(cut).to_batches(), now.num_rows - cut
    if n:
        yield pa.Table.from_batches(kept)


def trimmed() -> None:
    """Gives the memory that a worker no longer uses back to its machine: workers live on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(c: Column) -> Column:
    """A-Z only, as the contracts say."""
    return F.translate(c, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows holding about `most` bytes of text each, so a task's memory follows neither batch nor table."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    a = pc.fill_null(texts, "") if texts.null_count else texts
    a = a.cast(pa.large_binary())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], (off - off[0]).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(mul)
    return x ^ (x >> np.uint64(31))


_R = 0x9E3779B97F4A7C15 | 1
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("r", ())) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for key, base in (("r", _R), ("i", pow(_R, -1, 1 << 64))):
            p = np.full(size, np.uint64(base), np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["r"][:n], _powers["i"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums P with hash(data[a:b]) = mix((P[b] - P[a]) * R^-a); see span_hash. Strings of 1,024 bytes can be made that
    collide whatever R is, so this groups what is compared later; see digests() for what stands for its bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power(len(data) or 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends], equal for equal bytes wherever they stand."""
    inv = _power(len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, ink: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` (or of runs of ink) in flat text, never across texts, and words per text."""
    ink = ~_SPACE[data] if ink is None else ink
    first = np.zeros(len(data) + 1, bool)
    last = np.zeros(len(data) + 1, bool)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first[:-1] = ink
    first[1:-1] &= ~ink[:-1] | edge[1:-1]
    last[1:] = ink
    last[1:-1] &= ~ink[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def fold(data: np.ndarray) -> np.ndarray:
    return _FOLD[data]


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in row) of every element of a ragged array with these row lengths."""
    row = np.repeat(np.arange(len(counts)), counts)
    begin = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, np.int64)
    return row, np.arange(len(row)) - begin[row] if len(row) else np.zeros(0, np.int64)
