"""Token ids as ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt to files by ranges of their id and written in ascending order of it, their ids followed by an end id.
A long document is cut in rows of `PIECE` ids, so neither a row nor a stripe follows the longest text. Every row holds its
document's place in its file, so the place in the whole corpus is that plus the ids of the files before, which one small
row a file gives. Readers take stripes in parallel; a filter on doc_id is answered by the statistics of files, stripes and
groups of 1,000 rows and by the Bloom filters, without reading ids.

A text is encoded with the tokenizers library. White space that follows something else always begins a pre-token of byte-level
BPE, so a text is cut before each single space, and a worker encodes each distinct chunk once. A special token's text is the
special id, as in the library's own default; such texts go to the library whole.

Null counts as empty; an empty text has the end id only. Null ids come first. Rows that repeat an id are documents of their
own, in an order of their texts' hashes. Texts of any length are encoded whole. Other columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PRETOKEN, byte_chars, vocabulary_path
from .common import partitions, ragged, scratch, table

PIECE = 1 << 16  # ids in a row
KEPT, SHORT = 400_000, 64  # chunks and pre-tokens of up to so many characters that a worker keeps the ids of
ROW = "doc_id long, part int, at long, n_tokens long, after long, ids array<int>"  # after: ids of the document in the rows that follow


class Encoder:
    """Ids of whole texts by the library, each distinct chunk once."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.printable = str.maketrans(dict(enumerate(byte_chars())))
        self.pretokens: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def pretoken(self, p: str) -> bytes:
        got = self.pretokens.get(p)
        if got is None:
            got = array("i", [t.id for t in self.library.model.tokenize(p.encode().decode("latin-1").translate(self.printable))]).tobytes()
            if len(self.pretokens) < KEPT and len(p) <= SHORT:
                self.pretokens[p] = got
        return got

    def alone(self, chunk: str) -> bytes:
        if any(s in chunk for s in self.special):
            return array("i", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.pretoken, PRETOKEN.findall(chunk)))

    def encoded(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk. New ones that begin with a space and end in something else are cut in one go."""
        out = list(map(self.chunks.get, chunks))
        new = [i for i, x in enumerate(out) if x is None]
        joined = [i for i in new if chunks[i][0] == " " and not chunks[i][-1].isspace()]
        text = "".join([chunks[i] for i in joined])
        if any(s in text for s in self.special):
            joined, text = [], ""
        at, found, ids = 0, PRETOKEN.findall(text), self.pretoken
        for i in joined:
            left, parts = len(chunks[i]), []
            while left:
                left -= len(found[at])
                parts.append(ids(found[at]))
                at += 1
            out[i] = b"".join(parts)
        for i in new:
            if out[i] is None:
                out[i] = self.alone(chunks[i])
            if len(self.chunks) < KEPT and len(chunks[i]) <= SHORT:
                self.chunks[chunks[i]] = out[i]
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text) of texts without nulls."""
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        own = {i: self.alone(texts[i].as_py()) for i in np.flatnonzero(whole).tolist()}
        if own:
            texts = pc.if_else(pa.array(whole), "", texts)
        split = pc.split_pattern(texts, " ")
        per = np.diff(split.offsets.to_numpy())
        coded = split.values.dictionary_encode() if len(split.values) else pa.array([], pa.string()).dictionary_encode()
        piece, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        n, begin = len(known), np.cumsum(per) - per
        first = np.zeros(len(piece), bool)
        first[begin] = True
        chunks = [f" {w}" for w in known]
        unit = piece.copy()
        opening = list(dict.fromkeys(piece[begin].tolist()))
        place = np.zeros(n, np.int64)
        place[opening] = np.arange(len(opening))
        unit[begin] = n + place[piece[begin]]
        chunks += [known[i] for i in opening]
        # a space after white space or at the beginning of a text does not begin a chunk: it is joined with what stands before
        open_end = np.array([not w or w[-1].isspace() for w in known], bool)
        held = np.zeros(len(piece), bool)
        held[1:] = open_end[piece[:-1]] & ~first[1:]
        if held.any():
            heads = np.flatnonzero(~held)
            sizes = np.diff(np.append(heads, len(piece)))
            unit, more = unit[heads], {}
            for g in np.flatnonzero(sizes > 1).tolist():
                a = int(heads[g])
                chunk = " " * (not first[a]) + " ".join([known[i] for i in piece[a : a + int(sizes[g])].tolist()])
                unit[g] = more.setdefault(chunk, len(chunks) + len(more))
            chunks += list(more)
            per = np.add.reduceat(~held, begin).astype(np.int64) if len(begin) else per
        used = np.zeros(len(chunks), bool)
        used[unit] = True
        used &= np.array([c != "" for c in chunks], bool)
        which = np.flatnonzero(used)
        ids = self.encoded([chunks[i] for i in which.tolist()])
        counts = np.zeros(len(chunks), np.int64)
        counts[which] = [len(x) // 4 for x in ids]
        offsets, store = np.cumsum(counts) - counts, np.frombuffer(b"".join(ids), np.int32)
        row, at = ragged(counts[unit])
        out = store[offsets[unit][row] + at]
        tokens = np.diff(np.concatenate(([0], np.cumsum(counts[unit])))[np.concatenate(([0], np.cumsum(per)))])
        if own:
            parts = np.split(out, np.cumsum(tokens)[:-1])
            for i, x in own.items():
                parts[i] = np.frombuffer(x, np.int32)
                tokens[i] = len(parts[i])
            out = np.concatenate(parts)
        return out, tokens


@cache
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches together up to about so many bytes; what is equal in them is encoded once."""
    kept, size = [], 0
    for b in batches:
        if kept and size + b.nbytes > most:
            yield pa.Table.from_batches(kept)
            kept, size = [], 0
        kept.append(b)
        size += b.nbytes
    if kept:
        yield pa.Table.from_batches(kept)


def write_ids(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, piece: int = PIECE, slice_bytes: int = 16 << 20) -> None:
    """The files. vocabulary: path of a byte-level BPE file that every worker has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, encode = 0, TaskContext.get().partitionId(), encoder(vocabulary)
        for t in gathered(batches, slice_bytes):
            texts = t.column("text").combine_chunks().fill_null("")
            ids, tokens = encode(texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks))
            n = tokens + 1
            stream = np.full(n.sum(), end_id, np.int32)
            body = np.ones(len(stream), bool)
            body[np.cumsum(n) - 1] = False
            stream[body] = ids
            rows = -(-n // piece)
            doc, k = ragged(rows)
            cuts = np.append((np.cumsum(n) - n)[doc] + k * piece, len(stream))
            before = at + np.cumsum(n) - n
            for a in range(0, len(doc), 4096):
                b = min(a + 4096, len(doc))
                d, own = doc[a:b], cuts[a : b + 1]
                yield pa.RecordBatch.from_arrays(
                    [t.column("doc_id").combine_chunks().take(pa.array(d)), pa.array(np.full(b - a, part, np.int32)), pa.array(before[d]), pa.array(n[d]), pa.array(n[d] - np.minimum((k[a:b] + 1) * piece, n[d])), pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), pa.array(stream[own[0] : own[-1]]))],
                    names=["doc_id", "part", "at", "n_tokens", "after", "ids"],
                )
            at += int(n.sum())

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("i", F.monotonically_increasing_id())  # one id may have many rows
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "h", "i").sortWithinPartitions("doc_id", "h", "i")
    out = rows.select("doc_id", "text").mapInArrow(run, ROW)
    out.write.option("orc.bloom.filter.columns", "doc_id").option("orc.row.index.stride", "1000").option("orc.compress", "zstd").orc(path)


def read_ids(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """The rows of the files (a document of more than a piece has several), or of a few documents: only the stripes and
    groups of rows that may hold them are read."""
    rows = spark.read.schema(ROW).orc(path)
    return rows if ids is None else rows.where(F.col("doc_id").isin(ids))


def shifted(crc: int, n: int) -> int:
    """What a CRC-32 adds to that of a text in which n bytes follow: crc times x^8n, modulo the polynomial."""

    def times(a: int, b: int) -> int:
        out = 0
        for bit in range(31, -1, -1):
            if a >> bit & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    power = 1 << 23  # x^8; the highest bit is x^0
    while n:
        if n & 1:
            crc = times(power, crc)
        power, n = times(power, power), n >> 1
    return crc


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, after = b.column("ids"), b.column("after").to_pylist()
            data = memoryview(lists.flatten().to_numpy().astype("<i4", copy=False)).cast("B")
            ends = (np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))) * 4).tolist()
            crc = [shifted(zlib.crc32(data[x:y]), 4 * n) if n else zlib.crc32(data[x:y]) for x, y, n in zip(ends[:-1], ends[1:], after, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "part", "at", "n_tokens")), pa.array(crc, pa.int64())], names=["doc_id", "part", "at", "n_tokens", "crc"])

    rows = read_ids(spark, path).mapInArrow(run, "doc_id long, part int, at long, n_tokens long, crc long")
    return rows.groupBy("part", "at").agg(F.min("doc_id").alias("doc_id"), F.min("n_tokens").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32")).join(F.broadcast(starts(spark, path)), "part").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, start): the ids in the files before each one. One row a file."""
    files = read_ids(spark, path).groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("n")).orderBy("part").collect()
    begin = np.concatenate(([0], np.cumsum([r.n for r in files]))).tolist()
    return spark.createDataFrame([(r.part, b) for r, b in zip(files, begin, strict=False)], "part int, start long")


def op12_token_files(spark, sf_dir):
    path = scratch(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), path, vocabulary_path())
    return documents(spark, path)
