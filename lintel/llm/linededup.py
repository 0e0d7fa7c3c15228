"""Line dedup by a segment-partition edit join.

Lines within `edits` byte edits of each other are linked, and a class is what links reach. A line of length n is cut in
edits + 1 segments, which are its index entries; a line probes the entries of lengths n - edits to n with those of its
own substrings that can match in a pair within the threshold (segment i moves by at most i - 1 from the left and by
what is left from the right). Keys that only one line has end there. Lines that meet are compared by a banded
bit-parallel edit distance, breadth first and only with what is not yet reached, so that a bucket gives a forest of
links, not its pairs. Crowded buckets are cut in blocks, a task for each pair of blocks.

A line is known by a digest of 128 bits. Keys that different lines share are found by a count that folds before it
shuffles, and only their entries are made again and dealt. Texts of lines are fetched only for lines that met another under some key, by a
second scan with a bitmap of fixed size.

The first line of a class stays: the smallest doc_id, in it the first. Lines shorter than `least` bytes are linked only if
they are equal; empty lines are left alone. Lines of any length are compared whole, over a band of 64 rows. Null counts as empty, and an empty text has one empty line. Rows that repeat a doc_id are one document for the
choice of what stays. Other columns are not read, or come back as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bitmap, digests, flat, fresh, marked, mix, partitions, prefix_hash, ragged, slices, span_hash, table, unpacked, written
from .components import components


M64 = (1 << 64) - 1


def small_distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def distance(a: bytes, b: bytes, most: int) -> int:
    """Edit distance of a and b, most + 1 if it is larger; most up to 31.

    Bit-parallel columns over a band of 64 rows whose lowest row, bit 63, is `most` below the diagonal. The score is
    followed down that row's diagonal until it meets the end of a, then along the end of a."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = common(a, b)
    a, b = a[n:], b[n:]
    n = common(a[::-1], b[::-1])
    a, b = a[: len(a) - n], b[: len(b) - n]
    if min(len(a), len(b)) <= 2 * most:
        return min(small_distance(a, b), most + 1) if max(len(a), len(b)) <= 4 * most + 4 else most + 1
    # of each symbol its last 64 rows and the column they were read in; row j + most enters the band with column j
    seen: dict[int, tuple[int, int]] = {}
    for i in range(min(most, len(a))):
        bits, last = seen.get(a[i], (0, 0))
        seen[a[i]] = bits | 1 << (63 - most + i), 0
    vp, vn, score, low = M64 << (63 - most) & M64, 0, most, 1 << 62
    turn = len(a) - most
    for j, y in enumerate(b):
        if j + most < len(a):
            bits, last = seen.get(a[j + most], (0, 0))
            seen[a[j + most]] = (bits >> min(64, j - last) | 1 << 63), j
        bits, last = seen.get(y, (0, 0))
        match = bits >> min(64, j - last)
        d0 = (((match & vp) + vp & M64) ^ vp) | match | vn
        hp = (vn | ~(d0 | vp)) & M64
        hn = d0 & vp
        if j < turn:
            score += not d0 >> 63
            if score > 2 * most + len(b) - len(a) + most:
                return most + 1
        else:
            score += bool(hp & low) - bool(hn & low)
            low >>= 1
        vp = (hn | ~(d0 >> 1 | hp)) & M64
        vn = d0 >> 1 & hp
    return min(score, most + 1)


def cuts(n: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, length) of the edits + 1 segments of lines of length n; the last segments take the rest."""
    size, extra = n // (edits + 1), n % (edits + 1)
    out, at = [], np.zeros_like(n)
    for i in range(edits + 1):
        length = size + (i > edits - extra)
        out.append((at, length))
        at = at + length
    return out


def join_keys(data: np.ndarray, start: np.ndarray, n: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, 1 for an index entry or 0 for a probe) of lines data[start:start + n]."""
    prefix = prefix_hash(data)
    keys, rows, kinds = [], [], []

    def add(which: np.ndarray, at: np.ndarray, length: np.ndarray, of: np.ndarray, segment: int, kind: int) -> None:
        label = (of * (edits + 1) + segment).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        keys.append(mix(span_hash(prefix, start[which] + at, start[which] + at + length) ^ label))
        rows.append(which)
        kinds.append(np.full(len(which), kind, np.int8))

    every = np.arange(len(n))
    for i, (at, length) in enumerate(cuts(n, edits)):
        add(every, at, length, n, i, 1)
    for d in range(edits + 1):
        short = n - d
        for i, (at, length) in enumerate(cuts(short, edits)):
            for move in range(max(-i, d - (edits - i)), min(i, d + edits - i) + 1):
                ok = np.flatnonzero((short > edits) & (at + move >= 0) & (at + move + length <= n))
                add(ok, at[ok] + move, length[ok], short[ok], i, 0)
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(kinds)


def histograms(lines: list[bytes]) -> np.ndarray:
    """How often each byte, folded to 64 values, stands in each line."""
    data = np.frombuffer(b"".join(lines), np.uint8).astype(np.int64) & 63
    row = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    return np.bincount(row * 64 + data, minlength=64 * len(lines)).reshape(-1, 64).astype(np.int32)


def forest(ids: list[str], lines: list[bytes], edits: int) -> list[tuple[str, str]]:
    """Links of a spanning forest of "within `edits` edits" over the lines of a bucket. An edit changes at most two counts of
    a line's bytes by one, so only lines whose counts are that near are compared."""
    held = histograms(lines)
    out, rest = [], np.arange(len(ids))
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = int(stack.pop())
            near = np.flatnonzero(np.abs(held[rest] - held[x]).sum(1) <= 2 * edits)
            hit = [n for n in near.tolist() if distance(lines[x], lines[rest[n]], edits) <= edits]
            if hit:
                got = rest[hit]
                out += [(ids[x], ids[y]) for y in got.tolist()]
                stack += got.tolist()
                rest = np.delete(rest, hit)
    return out


def lines_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, text, number in the text, start, length) of all lines; a text has one more than it has line feeds."""
    data, off = flat(texts)
    feeds = np.flatnonzero(data == 10)
    per = np.diff(np.searchsorted(feeds, off)) + 1
    text, pos = ragged(per)
    last = np.cumsum(per) - 1
    ends = np.empty(len(text), np.int64)
    ends[last] = off[1:]
    inner = np.ones(len(text), bool)
    inner[last] = False
    ends[inner] = feeds
    starts = np.empty(len(text), np.int64)
    starts[1:] = ends[:-1] + 1
    starts[last - per + 1] = off[:-1]
    return data, text, pos, starts, ends - starts


def hashed_lines(texts: pa.Array, least: int):
    """(bytes, text, number, start, length, h1, h2) of the lines of at least `least` bytes; h1, h2: a digest of 128 bits."""
    data, text, pos, start, n = lines_of(texts)
    ok = n >= least
    text, pos, start, n = text[ok], pos[ok], start[ok], n[ok]
    own = digests(memoryview(data.tobytes()), start, start + n).view(np.uint64)
    return data, text, pos, start, n, own[:, 0], own[:, 1]


SLICE = 1_900_000


def occurrences(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(doc_id, pos, h1, h2) of all lines of at least `least` bytes; 128 bits of hash stand for a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                _, text, pos, _, _, h1, h2 = hashed_lines(part.column("text"), least)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(text)), pa.array(pos, pa.int32()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["doc_id", "pos", "h1", "h2"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, pos int, h1 long, h2 long")


def line_links(docs: DataFrame, text_col: str, edits: int, least: int, heavy: int) -> DataFrame:
    """(a, b): links of a spanning forest of each class, lines by the hexadecimal form of their hashes."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))

    def emit(marks) -> DataFrame:
        """(key, id, kind) of all keys of lines, or only of keys that have their bit in marks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = unpacked(marks.value) if marks else None
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    data, _, _, start, n, h1, _ = hashed_lines(part.column("text"), least)
                    _, one = np.unique(h1, return_index=True)
                    for lo in range(0, len(one), 8192):
                        at = one[lo : lo + 8192]
                        keys, rows, kinds = join_keys(data, start[at], n[at], edits)
                        if known is not None:
                            ok = marked(known, keys)
                            keys, rows, kinds = keys[ok], rows[ok], kinds[ok]
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(h1[at][rows].view(np.int64)), pa.array(kinds)], names=["key", "id", "kind"])

        return texts.mapInArrow(run, "key long, id long, kind byte")

    # keys under which different lines meet: folded before the shuffle, so a hot key is a few rows
    def meeting(keyed: DataFrame) -> DataFrame:
        by = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("kind").alias("held"), F.count(F.lit(1)).alias("n"))
        return by.where("lo <> hi AND held = 1").select("key", "n")

    marks = spark.sparkContext.broadcast(bitmap(meeting(emit(None)).select(F.col("key").alias("id"))))
    some = written(emit(marks).distinct(), "keys")
    met = written(some.join(meeting(some), "key").select("key", "id", "n").distinct(), "met")
    marks = spark.sparkContext.broadcast(bitmap(met.select("id").distinct()))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unpacked(marks.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, _, _, start, n, h1, h2 = hashed_lines(part.column("text"), least)
                ok = np.flatnonzero(marked(known, h1))
                ok = ok[np.unique(h1[ok], return_index=True)[1]] if len(ok) else ok
                raw = data.tobytes() if len(ok) else b""
                yield pa.RecordBatch.from_arrays([pa.array(h1[ok].view(np.int64)), pa.array(h2[ok].view(np.int64)), pa.array([raw[a : a + m] for a, m in zip(start[ok].tolist(), n[ok].tolist(), strict=True)], pa.binary())], names=["id", "h2", "line"])

    found = texts.mapInArrow(fetch, "id long, h2 long, line binary").dropDuplicates(["id", "h2"])
    blocks = F.ceil(F.col("n") / heavy)
    own = F.pmod(F.xxhash64("id"), blocks)
    each = F.when(blocks <= 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda o: F.greatest(o, own) * blocks + F.least(o, own)))
    dealt = met.select("id", "key", F.explode(each).alias("block")).join(found, "id").select("key", "block", F.concat(F.lpad(F.hex("id"), 16, "0"), F.lpad(F.hex("h2"), 16, "0")).alias("id"), "line")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        ids: list[str] = []
        texts: list[bytes] = []

        def found() -> pa.RecordBatch:
            links = forest(ids, texts, edits)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.string()), pa.array([b for _, b in links], pa.string())], names=["a", "b"])

        for batch in batches:  # sorted by bucket
            for key, block, id_, line in zip(*(batch.column(c).to_pylist() for c in ("key", "block", "id", "line")), strict=True):
                if (key, block) != held:
                    if len(ids) > 1:
                        yield found()
                    held, ids, texts = (key, block), [], []
                ids.append(id_)
                texts.append(line)
        if len(ids) > 1:
            yield found()

    return dealt.repartition(4 * partitions(spark), "key", "block").sortWithinPartitions("key", "block").mapInArrow(search, "a string, b string")


def line_classes(docs: DataFrame, rows: DataFrame, text_col: str = "text", edits: int = 2, least: int = 24, heavy: int = 8192) -> DataFrame:
    """(h1, h2, root, first_doc): lines that are not alone in their class, and its first document. rows: occurrences(docs)."""
    lines = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))
    lines = lines.withColumn("v", F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0")))
    roots = components(line_links(docs, text_col, edits, least, heavy))
    named = roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct())
    rooted = lines.join(named, "v", "left").where("n > 1 OR root IS NOT NULL").select("h1", "h2", F.coalesce("root", "v").alias("root"), "first_doc")
    firsts = rooted.groupBy("root").agg(F.min("first_doc").alias("first"))
    return rooted.join(firsts, "root").select("h1", "h2", "root", F.col("first").alias("first_doc"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, least: int = 24, heavy: int = 8192) -> DataFrame:
    """(doc_id, n_dropped, dropped): the 0-based numbers of the lines that go, for documents that lose any."""
    made = written(occurrences(docs, id_col, text_col, 1), "occurrences")
    classes = line_classes(docs, made, text_col, edits, least, heavy)
    rows = made.join(classes, ["h1", "h2"]).select("doc_id", "pos", "root", "first_doc")
    gone = rows.withColumn("at", F.min("pos").over(W.partitionBy("doc_id", "root"))).where(~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("pos") == F.col("at"))))
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("dropped")).select("doc_id", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, least: int = 24) -> DataFrame:
    """docs with the lines that go taken out of their texts; all columns stay."""
    own, lost = fresh(docs, "own_id"), fresh(docs, "lost_lines")
    gone = dropped_lines(docs, id_col, text_col, edits, least).select(F.col("doc_id").alias(own), F.col("dropped").alias(lost))
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(lost, i)), "\n")
    out = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(own)), "left")
    return out.withColumn(text_col, F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(kept)).select(docs.columns)


def op6_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    gone = dropped_lines(docs)
    lines = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    return lines.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))
