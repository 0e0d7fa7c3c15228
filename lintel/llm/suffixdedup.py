"""Suffix-array dedup: bytes covered by a string of `length` bytes that starts at two places or more go.

Equal windows of `length` bytes have equal minimizers at the same offset. So the windows of a text are cut in runs that
share a minimizer, and these in pieces by the offset (windows.py); a piece is known by the bytes that all its windows
share. A first pass counts minimizers; a second one makes the pieces of those seen twice. Pieces that are equal as a whole
(a digest of 128 bits) are folded, and the different pieces of a group form a collection of documents aligned at the
minimizer, for which a Burrows-Wheeler order is built column by column from the right: each round puts one symbol before
every document's suffix, re-sorts the suffixes stably by it and updates the common prefixes of neighbours by range minima.
Symbols lie column-wise in an external file of the shared folder that the rounds read once, from its end to its start.
Neighbours that share `length` symbols are repeats. A group of more than `crowd` different pieces is cut in narrower cells
of offsets, down to single windows if need be, so no task holds an unbounded collection.

Equal windows always stand in the same column, so only suffixes of one column are ordered against each other. The
plain construction orders all suffixes of the collection in every round, which costs rounds x collection.

Null counts as empty. Shorter texts lose nothing; texts of any length are read whole, in overlapping parts of 2 MB. Rows
that repeat an id and text count as places of their own. Texts are cut at bytes; what stays need not be UTF-8 and is given
as binary. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, digests, dropped, filesystem, flat, marked, partitions, scratch, slices, stretches, table, unpacked, written
from .windows import pieces, runs


def range_minima(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(a[lo:hi]) of each pair, lo < hi."""
    if not len(lo):
        return a[:0]
    return np.minimum.reduceat(np.append(a, a[-1]), np.stack([lo, hi], 1).ravel())[::2]


class Columns:
    """The symbols of aligned strings (a byte and one; 0 where a string has none) as a file of the shared folder: blocks of
    `block` strings one after the other, column by column in each."""

    def __init__(self, folder: str, strings: list[bytes], first: np.ndarray, columns: int, block: int = 2048, panel: int = 32) -> None:
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.n, self.columns, self.block, self.panel = f"{base}/{uuid.uuid4().hex}", len(strings), columns, block, panel
        with self.fs.open_output_stream(self.path) as out:
            for lo in range(0, self.n, block):
                part = np.zeros((columns, min(block, self.n - lo)), np.uint16)
                for i in range(part.shape[1]):
                    s = np.frombuffer(strings[lo + i], np.uint8)
                    part[first[lo + i] : first[lo + i] + len(s), i] = s
                    part[first[lo + i] : first[lo + i] + len(s), i] += 1
                out.write(part.tobytes())

    def backwards(self) -> Iterator[tuple[int, np.ndarray]]:
        """(column, its symbols) from the last to the first."""
        with self.fs.open_input_file(self.path) as f:
            for hi in range(self.columns, 0, -self.panel):
                lo = max(0, hi - self.panel)
                held = []
                for at in range(0, self.n, self.block):
                    rows = min(self.block, self.n - at)
                    held.append(np.frombuffer(f.read_at((hi - lo) * rows * 2, (at * self.columns + lo * rows) * 2), np.uint16).reshape(hi - lo, rows))
                panel = np.concatenate(held, 1)
                for c in range(hi - 1, lo - 1, -1):
                    yield c, panel[c - lo]

    def remove(self) -> None:
        self.fs.delete_file(self.path)


def repeated_windows(group: np.ndarray, strings: list[bytes], anchor: np.ndarray, length: int, folder: str) -> list[np.ndarray]:
    """For each string the starts of its windows that another string of its group has at the same place.

    anchor: place of the minimizer in each string, by which the strings of a group are aligned."""
    n = len(strings)
    size = np.array([len(s) for s in strings])
    first = anchor.max(initial=0) - anchor  # column of each string's first symbol
    out: list[list[np.ndarray]] = [[], []]
    _, number = np.unique(group, return_inverse=True)
    order = np.argsort(number, kind="stable")
    base = number.astype(np.int64) * 512
    shared = np.zeros(n, np.int32)  # symbols that each suffix shares with the one before it
    symbols = Columns(folder, strings, first, int((first + size).max(initial=0)))
    try:
        for c, column in symbols.backwards():
            key = (base + column)[order]
            step = np.argsort(key, kind="stable")
            same = np.flatnonzero((key[step[1:]] == key[step[:-1]]) & (column[order[step[1:]]] > 0)) + 1
            new = np.zeros(n, np.int32)
            new[same] = np.minimum(range_minima(shared, step[same - 1] + 1, step[same] + 1) + 1, length)
            order, shared = order[step], new
            hit = np.flatnonzero(shared >= length)
            if len(hit):
                who = np.unique(np.concatenate([order[hit], order[hit - 1]]))
                out[0].append(who)
                out[1].append(c - first[who])
    finally:
        symbols.remove()
    who = np.concatenate(out[0]) if out[0] else np.zeros(0, np.int64)
    at = np.concatenate(out[1]) if out[1] else np.zeros(0, np.int64)
    order = np.lexsort((at, who))
    cut = np.searchsorted(who[order], np.arange(n + 1))
    return [at[order[a:b]] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def spans_of(at: np.ndarray) -> tuple[list[int], list[int]]:
    """Sorted places as stretches [from, to)."""
    if not len(at):
        return [], []
    brk = np.flatnonzero(np.diff(at) > 1)
    return at[np.concatenate(([0], brk + 1))].tolist(), (at[np.concatenate((brk, [len(at) - 1]))] + 1).tolist()


KEY = ["g", "s1", "s2"]  # group and digest of a piece


def marks_of(rows: DataFrame, one: list[str]) -> DataFrame:
    """rows (g, s1, s2, ...) -> (g, s1, s2, seen, kinds, columns `one` of one such row) of pieces that others meet."""
    each = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("seen"), F.min(F.struct(*one)).alias("one"))
    crowd = each.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"))
    return written(each.join(crowd, "g").where("seen > 1 OR kinds > 1").select(*KEY, "seen", "kinds", "one.*"), "marks")


def repeats_in(strings: DataFrame, length: int, folder: str) -> DataFrame:
    """strings (g, s1, s2, anchor, string), different in a group -> (g, s1, s2, a, b): stretches of repeated windows."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in stretches(batches, 16384):
            group, s1, s2, anchor = (part.column(i).to_numpy() for i in range(4))
            found = [spans_of(w) for w in repeated_windows(group, part.column("string").to_pylist(), anchor, length, folder)]
            at = np.array([i for i, (a, _) in enumerate(found) if a], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (group, s1, s2)] + [pa.array([found[i][j] for i in at.tolist()], pa.list_(pa.int32())) for j in (0, 1)], names=[*KEY, "a", "b"])

    dealt = strings.select(*KEY, "anchor", "string").repartition(4 * partitions(strings.sparkSession), "g").sortWithinPartitions("g")
    return dealt.mapInArrow(search, "g long, s1 long, s2 long, a array<int>, b array<int>")


def narrower(rows: DataFrame, length: int, gram: int, bits: int) -> DataFrame:
    """rows (og, os1, os2, shift, n, anchor, string) -> the same with g, s1, s2: their pieces by cells of 2^bits offsets.

    og, os1, os2 and shift: which piece of a text a string is from, and where it begins there."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "string", 1 << 20):
                data, off = flat(part.column("string"))
                raw = memoryview(data.tobytes())
                n, anchor, shift = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "anchor", "shift"))
                run, start, count, group = pieces(raw, off[:-1], n, off[:-1] + anchor, length, gram, bits)
                own = digests(raw, start, start + count + length - 1)
                moved = start - off[run]
                at = pa.array(run)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("og", "os1", "os2")), pa.array((shift[run] + moved).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array((anchor[run] - moved).astype(np.int32)), pa.array([raw[a:b].tobytes() for a, b in zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)], pa.binary()), pa.array(group.view(np.int64)), pa.array(own[:, 0]), pa.array(own[:, 1])], names=["og", "os1", "os2", "shift", "n", "anchor", "string", *KEY])

    made = rows.select("og", "os1", "os2", "shift", "n", "anchor", "string").mapInArrow(cut, "og long, os1 long, os2 long, shift int, n int, anchor int, string binary, g long, s1 long, s2 long")
    return written(made, "narrower")


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = 24, text_col: str = "text", slice_bytes: int = 1_900_000, crowd: int = 4096) -> DataFrame:
    """docs (doc_id, h, text) -> (doc_id, h, begins, ends): byte spans of repeated windows, unmerged, of documents that have
    any. h: a hash of the text, by which rows of one id are told apart."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "h", F.col(text_col).alias("text"))
    widest = max(0, (length // 4).bit_length() - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                yield pa.RecordBatch.from_arrays([pa.array(runs(*flat(part.column("text")), length, gram)[3].view(np.int64))], names=["id"])

    seen = texts.select("text").mapInArrow(count, "id long").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    marks = spark.sparkContext.broadcast(bitmap(seen))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unpacked(marks.value)
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                data, off = flat(part.column("text"))
                text, begin, count, m, place = runs(data, off, length, gram)
                ok = marked(known, m)
                text, begin, count, place = text[ok], begin[ok], count[ok], place[ok]
                raw = memoryview(data.tobytes())
                run, start, n, group = pieces(raw, begin, count, place, length, gram, widest)
                own, text = digests(raw, start, start + n + length - 1), text[run]
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("h").take(at), *(pa.array(x.astype(np.int32)) for x in (start - off[text], n, place[run] - start)), pa.array(group.view(np.int64)), pa.array(own[:, 0]), pa.array(own[:, 1])], names=["doc_id", "h", "start", "n", "anchor", *KEY])

    made = written(texts.mapInArrow(cut, "doc_id long, h long, start int, n int, anchor int, g long, s1 long, s2 long"), "pieces")
    marks0 = marks_of(made, ["doc_id", "h", "start", "n", "anchor"])
    temporary, folder = [made, marks0], scratch(spark, "columns")

    asked = marks0.where("kinds > 1").groupBy("doc_id", "h").agg(F.collect_list(F.struct(*KEY, "kinds", "start", "n", "anchor")).alias("asked"))
    of = picked(texts, asked).withColumnsRenamed({"doc_id": "id", "h": "hash"})
    strings = of.join(asked, of.id.eqNullSafe(asked.doc_id) & (of.hash == asked.h)).select(F.col("text").cast("binary").alias("bytes"), F.explode("asked").alias("a"))
    strings = strings.select("a.*", F.substring("bytes", F.col("a.start") + 1, F.col("a.n") + (length - 1)).alias("string")).dropDuplicates(KEY)
    over = marks0.where(F.col("kinds") > crowd).limit(1).count() > 0
    if over:
        strings = written(strings, "strings")
        temporary.append(strings)

    def found_in(marks_: DataFrame, strings_: DataFrame) -> DataFrame:
        """(g, s1, s2, a, b) of the pieces of groups that are not crowded, and of all that are seen twice as a whole."""
        whole = marks_.where("seen > 1").select(*KEY, F.array(F.lit(0)).alias("a"), F.array("n").alias("b"))
        part = repeats_in(strings_.where(F.col("kinds") <= crowd), length, folder)
        return whole.unionByName(part.join(marks_.where("seen > 1").select(*KEY), KEY, "left_anti"))

    found = found_in(marks0, strings)
    rows = strings.where(F.col("kinds") > crowd).select(F.col("g").alias("og"), F.col("s1").alias("os1"), F.col("s2").alias("os2"), F.lit(0).alias("shift"), "n", "anchor", "string")
    for bits in range(widest - 3, -3, -3) if over else ():
        split = narrower(rows, length, gram, max(0, bits))
        marks1 = marks_of(split, ["n", "anchor", "string"])
        temporary += [split, marks1]
        own = split.join(found_in(marks1, marks1.where("kinds > 1")), KEY)
        found = found.unionByName(own.select(F.col("og").alias("g"), F.col("os1").alias("s1"), F.col("os2").alias("s2"), F.transform("a", lambda x: x + F.col("shift")).alias("a"), F.transform("b", lambda x: x + F.col("shift")).alias("b")))
        rows = split.join(marks1.where(F.col("kinds") > crowd).select("g").distinct(), "g", "left_semi")
        if bits <= 0 or not rows.limit(1).count():
            break
    hit = made.join(found, KEY).select("doc_id", "h", F.transform("a", lambda x: x + F.col("start")).alias("a"), F.transform("b", lambda x: x + F.col("start") + (length - 1)).alias("b"))
    spans = written(hit.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("a")).alias("begins"), F.flatten(F.collect_list("b")).alias("ends")), "spans")
    for t in temporary:
        dropped(t)
    return spans


def picked(docs: DataFrame, keys: DataFrame, rest: bool = False) -> DataFrame:
    """The rows of docs (doc_id, h, text) that keys (h) may name, by a bitmap of fixed size; with `rest` all others."""
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(keys.select(F.col("h").alias("id")).distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unpacked(marks.value)
        for batch in batches:
            yield batch.filter(pa.array(marked(known, batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)) != rest))

    return docs.mapInArrow(run, docs.schema)


def merged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of overlapping or touching ones."""
    order = np.argsort(begins, kind="stable")
    a, b = begins[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    return a[first], b[np.append(first[1:] - 1, len(a) - 1)]


def suffix_dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", crowd: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, begins, ends (of the removed runs) and kept (binary)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    spans = repeated_spans(keyed, length, crowd=crowd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 22):
                rows: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "begins", "ends", "kept")}
                for t, a, b in zip(*(part.column(c).to_pylist() for c in ("text", "begins", "ends")), strict=True):
                    t = t.encode()
                    a, b = merged(np.array(a), np.array(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    a, b = a.tolist(), b.tolist()
                    for k, v in (("n_bytes", len(t)), ("n_removed", sum(b) - sum(a)), ("begins", a), ("ends", b), ("kept", b"".join(t[x:y] for x, y in zip([0, *b], [*a, len(t)], strict=True)))):
                        rows[k].append(v)
                kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "begins": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()), "kept": pa.binary()}
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(rows[k], kinds[k]) for k in rows)], names=["doc_id", *rows])

    of = picked(keyed, spans).withColumnsRenamed({"doc_id": "id", "h": "hash"})
    some = of.join(spans, of.id.eqNullSafe(spans.doc_id) & (of.hash == spans.h), "left").select(F.col("id").alias("doc_id"), "text", "begins", "ends")
    none = F.array().cast("array<int>")
    others = picked(keyed, spans, rest=True).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), none.alias("begins"), none.alias("ends"), F.col("text").cast("binary").alias("kept"))
    return some.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, begins array<int>, ends array<int>, kept binary").unionByName(others)


def op10_suffix_dedup(spark, sf_dir):
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("begins").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("removed"))
