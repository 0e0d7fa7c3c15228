"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counting: one pass over all training documents hashes words and word pairs to 64 bits, adds up what a slice holds and
deals the sums by segments of the hash range; each segment's task adds up its share and quantises counts to levels
(1 + floor(log2 count)). Every n-gram is kept, those seen once too. There are more segments where there is more text.

Filter: an n-gram of level q is put in under levels 1 to q, so a level is read by membership probes that go up until one
fails. Every segment fills a bit array of its own (`BITS` bits an entry); the filter is their concatenation and holds every
level at any size. Up to `most_bytes` it is a file of the shared folder that workers memory-map; a larger one stays a table,
and the distinct n-grams of some million tokens at a time are asked of their segments' tasks, which look in the same bits, so
both ways score alike.

Probability of a word after another: a mixture of pair and word estimates from the quantised counts, the mixture's
weight being the one that gives the training documents, each token and pair taken out once, the highest probability. A
score itself takes nothing out: equal texts score equal, trained or held out.

Base score: exact counts. The most frequent words' counts (at most `dictionary` of them) go to every worker; the rest
are asked of their segment's task, which adds up each document's share.

Null counts as empty; an empty text is its end token alone. Texts of any length are scored whole, a slice of rows at a time.
A word is known by 64 bits of hash, those of more than 64 bytes by a digest. Repeated rows are scored one by one, and count as
training rows of their own. Without training rows all counts are zero. Null ids train. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow.fs import LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filesystem, flat, fold, mix, partitions, prefix_hash, scratch, slices, span_hash, table, words, written

END = np.uint64(0x5851F42D4C957F2D)
PROBES, BITS = 6, 9
LONG = 64
WEIGHTS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8)
LEVELS = 48
SEGMENT = 1 << 30  # bytes of training text a segment's task counts, where there are that many


def training(c: Column, fold_: int = 7, at: int = 2) -> Column:
    return F.coalesce(F.crc32(c.cast("string")) % fold_ != at, F.lit(True))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, tokens per text): a text's words, then its end."""
    data, offsets = flat(texts)
    data = fold(data)
    starts, ends, per = words(data, offsets)
    own = span_hash(prefix_hash(data), starts, ends)
    long = np.flatnonzero(ends - starts > LONG)  # beyond that words can be made that collide under the fast hash
    if len(long):
        raw = memoryview(data.tobytes())
        own[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    out = np.full(len(starts) + len(per), END)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(per)), per)] = own
    return out, per + 1


def pair_keys(tok: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Key of each token with the one before it; a text starts after an end."""
    before = np.concatenate(([END], tok[:-1])) if len(tok) else tok
    return mix(before * np.uint64(0x9FB21C651E98DF25) + tok)


def segments(keys: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the n hash ranges in sorted keys."""
    return np.searchsorted(keys, np.array([-(-(i << 32) // n) << 32 for i in range(n)], np.uint64)).tolist() + [len(keys)]


def segment(keys: np.ndarray, n: int) -> np.ndarray:
    """The hash range of each key: its upper half scaled to n."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(counts, begin) if len(begin) else counts


class Folded:
    """Sums of (keys, counts) blobs; what waits to be added up is bounded, whatever their number."""

    def __init__(self, most: int = 1 << 21) -> None:
        self.keys, self.counts, self.waiting, self.n, self.most = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0, most

    def add(self, keys: bytes, counts: bytes) -> None:
        self.waiting.append((np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint32)))
        self.n += len(self.waiting[-1][0])
        if self.n >= max(self.most, len(self.keys)):
            self.sums()

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            self.keys, self.counts = summed(np.concatenate([self.keys, *(x for x, _ in self.waiting)]), np.concatenate([self.counts, *(x for _, x in self.waiting)]))
            self.waiting, self.n = [], 0
        return self.keys, self.counts


def middle(level: np.ndarray) -> np.ndarray:
    """The mean of the counts of a level, 0 for level 0."""
    top = 2.0 ** np.asarray(level, np.float64)
    return np.where(np.asarray(level) > 0, (top / 2 + top - 1) / 2, 0.0)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log2(np.maximum(counts, 1))), LEVELS - 1).astype(np.uint8)


def chunks(batches: Iterator[pa.RecordBatch], slice_bytes: int, most_tokens: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Rows with their tokens, some million tokens at a time."""
    rows, toks, pers, n = [], [], [], 0
    for batch in batches:
        for part in slices(batch, "text", slice_bytes):
            t, p = tokens(part.column("text"))
            rows.append(part)
            toks.append(t)
            pers.append(p)
            n += len(t)
            if n >= most_tokens:
                yield rows, np.concatenate(toks), np.concatenate(pers)
                rows, toks, pers, n = [], [], [], 0
    if rows:
        yield rows, np.concatenate(toks), np.concatenate(pers)


def count_table(docs: DataFrame, n_segments: int, slice_bytes: int = 1_900_000, most_tokens: int = 2_000_000) -> DataFrame:
    """docs (text) -> (seg, words, word_n, pairs, pair_level, n, v, word_hist, pair_hist), one row per segment."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tok, per in chunks(batches, slice_bytes, most_tokens):
            w, wn = np.unique(tok, return_counts=True)
            b, bn = np.unique(pair_keys(tok, per), return_counts=True)
            wb, bb = segments(w, n_segments), segments(b, n_segments)
            cut = lambda a, to, i, kind: a[to[i] : to[i + 1]].astype(kind).tobytes()
            every = range(n_segments)
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.int32())] + [pa.array([cut(a, to, i, kind) for i in every], pa.binary()) for a, to, kind in ((w, wb, np.uint64), (wn, wb, np.uint32), (b, bb, np.uint64), (bn, bb, np.uint32))], names=["seg", "w", "wn", "b", "bn"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words_, pairs = None, Folded(), Folded()

        def done() -> pa.RecordBatch:
            (w, wn), (b, bn) = words_.sums(), pairs.sums()
            bl, wl = levels(bn), levels(wn)
            hist = lambda x: np.bincount(x, minlength=LEVELS).tolist()
            return pa.RecordBatch.from_pylist([{"seg": at, "words": w.tobytes(), "word_n": wn.tobytes(), "pairs": b.tobytes(), "pair_level": bl.tobytes(), "n": int(wn.sum()), "v": len(w), "word_hist": hist(wl), "pair_hist": hist(bl)}], schema=schema)

        for batch in batches:  # sorted by segment
            for i in range(batch.num_rows):
                seg, w, wn, b, bn = (batch.column(k)[i].as_py() for k in range(5))
                if at is not None and seg != at:
                    yield done()
                    words_, pairs = Folded(), Folded()
                at = seg
                words_.add(w, wn)
                pairs.add(b, bn)
        if at is not None:
            yield done()

    schema = pa.schema([("seg", pa.int32()), ("words", pa.binary()), ("word_n", pa.binary()), ("pairs", pa.binary()), ("pair_level", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("word_hist", pa.list_(pa.int64())), ("pair_hist", pa.list_(pa.int64()))])
    parts = docs.mapInArrow(local, "seg int, w binary, wn binary, b binary, bn binary").repartition(n_segments, "seg").sortWithinPartitions("seg")
    return written(parts.mapInArrow(total, "seg int, words binary, word_n binary, pairs binary, pair_level binary, n long, v long, word_hist array<long>, pair_hist array<long>"), "ngrams")


def places(keys: np.ndarray, level: int, size: np.ndarray) -> Iterator[np.ndarray]:
    """Bit places of keys at a level, one array for each probe, in bit arrays of these sizes."""
    h = mix(keys + np.uint64(level * 0xA0761D6478BD642F & (1 << 64) - 1))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((h + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)) * size >> np.uint64(32)


def word_key(tok: np.ndarray) -> np.ndarray:
    return mix(tok + np.uint64(0x2545F4914F6CDD1D))


_files: dict[str, np.ndarray] = {}


def file_bytes(path: str) -> np.ndarray:
    """A file of the shared folder, memory-mapped where the folder is mounted, else read."""
    if path not in _files:
        fs, own = filesystem(path)
        if fs.get_file_info(own).size == 0:
            got = np.zeros(0, np.uint8)
        elif isinstance(fs, LocalFileSystem):
            got = np.memmap(own, np.uint8, "r")
        else:
            with fs.open_input_file(own) as f:
                got = np.frombuffer(f.read(), np.uint8)
        _files.clear()
        _files[path] = got
    return _files[path]


class Filter:
    """Bit arrays of all segments, one after the other: where each begins, in bits, and its size."""

    def __init__(self, bits: np.ndarray | str, size: np.ndarray) -> None:
        self.held, self.size = bits, size.astype(np.uint64)  # held: the bytes, or the path of a file that has them
        self.begin = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.uint64)

    @property
    def bits(self) -> np.ndarray:
        return file_bytes(self.held) if isinstance(self.held, str) else self.held

    def level(self, keys: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Level of each key by probes that go up until one fails; 0 if there is none. home: what its segment goes by."""
        if not len(self.size):
            return np.zeros(len(keys), np.int64)
        seg = segment(home, len(self.size))
        out, live, bits = np.zeros(len(keys), np.int64), np.arange(len(keys)), self.bits
        live = live[self.size[seg] > 0]
        for q in range(1, LEVELS):
            for i in range(PROBES):  # most misses end at the first probe
                own = seg[live]
                for k, place in enumerate(places(keys[live], q, self.size[own])):
                    if k == i:
                        break
                bit = self.begin[own] + place
                live = live[(bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            out[live] = q
            if not len(live):
                break
        return out


def segment_bits(words_: np.ndarray, word_level: np.ndarray, pairs: np.ndarray, pair_level: np.ndarray) -> tuple[bytes, int]:
    """One segment's bit array and its size."""
    entries = [(word_key(words_), word_level), (pairs, pair_level)]
    size = -(-sum(int(lv.astype(np.int64).sum()) for _, lv in entries) * BITS // 64) * 64
    bits = np.zeros(size, bool)
    for keys, lv in entries:
        for q in range(1, int(lv.max(initial=0)) + 1):
            for place in places(keys[lv >= q], q, np.uint64(size)):
                bits[place.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes(), size


class Model:
    """What the workers get: the filter (None: its segments are in the count table), the frequent words' exact counts, N and V."""

    def __init__(self, filter_: Filter | None, frequent: np.ndarray, counts: np.ndarray, n: int, v: int, weight: float) -> None:
        self.filter, self.frequent, self.counts, self.n, self.v = filter_, frequent, counts, n, v
        self.weight = weight  # of all words, each at the middle of its level
        self.best: int | None = None  # which of WEIGHTS the training texts chose

    def exact(self, tok: np.ndarray) -> np.ndarray:
        """Count of each token among the frequent words, -1 if it is none."""
        if not len(self.frequent):
            return np.full(len(tok), -1)
        at = np.minimum(np.searchsorted(self.frequent, tok), len(self.frequent) - 1)
        return np.where(self.frequent[at] == tok, self.counts[at], -1)

    def log_probs(self, tok: np.ndarray, per: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """See both_ways()."""
        distinct, at = np.unique(tok, return_inverse=True)
        keys, pat = np.unique(pair_keys(tok, per), return_inverse=True)
        return self.both_ways(self.filter.level(word_key(distinct), distinct)[at], self.filter.level(keys, keys)[pat], per, own)

    def both_ways(self, lv: np.ndarray, pl: np.ndarray, per: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """((weights x texts) log10 probabilities, their sums over texts that the counts hold (own 1) when each token and
        pair of such a text is taken out once). The sums choose the weight; a text's score does not know where it is from."""
        if not len(per):
            return np.zeros((len(WEIGHTS), 0)), np.zeros(len(WEIGHTS))
        less = self.mixture(lv, pl, per, own)[:, own == 1].sum(1) if own.any() else np.zeros(len(WEIGHTS))
        return self.mixture(lv, pl, per, np.zeros_like(own)), less

    def mixture(self, lv: np.ndarray, pl: np.ndarray, per: np.ndarray, own: np.ndarray) -> np.ndarray:
        """(weights x texts) from the levels of the tokens and of their pairs, for one text at least; own: taken out so often."""
        # words at the middle of their level, over the sum of all middles: a distribution. Pairs at the bottom of
        # theirs, over the top of their first word's: the followers of a word never add up to more than 1.
        begin, once = np.cumsum(per) - per, np.repeat(own, per)
        context = np.concatenate(([0], lv[:-1]))
        context[begin] = lv[-1]  # the last token is an end
        one = (np.maximum(middle(lv) - once, 0) + 1) / (self.weight + self.v + 1)
        below = 2.0**context - 1 - once
        two = np.where(pl > 0, np.maximum(2.0 ** (pl - 1) - once, 0), 0) / np.maximum(below, 1)
        two = np.minimum(two, 1)
        return np.stack([np.add.reduceat(np.log10(np.where(below > 0, w * two + (1 - w) * one, one)), begin) for w in WEIGHTS])


def fit(docs: DataFrame, text_col: str = "text", n_segments: int | None = None, most_bytes: int = 1 << 30, dictionary: int = 1 << 19, choose: bool = True) -> tuple[Model, DataFrame]:
    """(model, count table) of training documents; the table has the filter's segments too if the model has no filter.

    choose: False leaves the mixture weight to the first score() of a table that holds all training documents, which then needs
    no pass of its own."""
    spark, texts = docs.sparkSession, docs.select(F.col(text_col).alias("text"))
    if n_segments is None:
        n_segments = max(4 * partitions(spark), -(-int(texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // SEGMENT))
    table_ = count_table(texts, n_segments)
    hist = table_.agg(F.sum("n"), F.sum("v"), *(F.sum(F.col(c)[i]) for c in ("word_hist", "pair_hist") for i in range(LEVELS))).first()
    n, v, *hists = (int(x or 0) for x in hist)
    word_hist, pair_hist = hists[:LEVELS], hists[LEVELS:]
    sent = sum(q * (a + b) for q, (a, b) in enumerate(zip(word_hist, pair_hist, strict=True))) * BITS / 8 <= most_bytes
    floor_ = next((q for q in range(1, LEVELS) if sum(word_hist[q:]) <= dictionary), LEVELS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, w, wn, b, bl in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                w, wn = np.frombuffer(w, np.uint64), np.frombuffer(wn, np.int64)
                lv = levels(wn)
                bits, size = segment_bits(w, lv, np.frombuffer(b, np.uint64), np.frombuffer(bl, np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([bits]), pa.array([size]), pa.array([w[lv >= floor_].tobytes()]), pa.array([wn[lv >= floor_].tobytes()])], names=["seg", "bits", "size", "w", "wn"])

    built = table_.select("seg", "words", "word_n", "pairs", "pair_level").mapInArrow(build, "seg int, bits binary, size long, w binary, wn binary")
    built, path = written(built, "filter"), scratch(spark, "filter-bits")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, own = filesystem(path)
        with fs.open_output_stream(own) as out:  # a second attempt writes the same again
            for batch in batches:
                for bits in batch.column("bits"):
                    out.write(bits.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])

    if sent:
        built.select("seg", "bits").repartition(1).sortWithinPartitions("seg").mapInArrow(write, "n long").collect()
    else:
        table_ = table_.join(built.select("seg", "bits", "size"), "seg")
    rows = built.select("seg", "size", "w", "wn").orderBy("seg").collect()
    join = lambda k, kind: np.frombuffer(b"".join(bytes(r[k]) for r in rows), kind)
    filter_ = Filter(path if rows else np.zeros(0, np.uint8), np.array([r["size"] for r in rows], np.int64)) if sent else None
    model = Model(filter_, join("w", np.uint64), join("wn", np.int64), n, v, float(np.dot(middle(np.arange(LEVELS)), word_hist)))
    if choose:
        score(texts.select(F.lit(None).cast("long").alias("doc_id"), "text"), model, table_, F.lit(True))
    return model, table_


def score(docs: DataFrame, model: Model, table_: DataFrame, trained: Column, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 1_900_000, most_tokens: int = 1_000_000) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    n_segments = max(1, len(model.filter.size) if model.filter else table_.count())

    def blobs(base: int, seg: list, keys: list[bytes], at: list[bytes], kind: str) -> pa.RecordBatch:
        k = len(seg)
        return pa.RecordBatch.from_arrays([pa.array([base] * k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), *(pa.nulls(k, pa.int64()) for _ in range(2)), pa.nulls(k, pa.float64()), pa.nulls(k, pa.list_(pa.float64())), pa.array(seg, pa.int32()), pa.array(keys, pa.binary()), pa.array(at, pa.binary()), pa.array([kind] * k, pa.string())], names=names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        base = TaskContext.get().partitionId() << 40
        for rows, tok, per in chunks(batches, slice_bytes, most_tokens):
            own = np.concatenate([r.column("trained").to_numpy(zero_copy_only=False) for r in rows]).astype(np.int64)
            size = len(per)
            logs, less = m.log_probs(tok, per, own) if m.filter else (np.zeros((len(WEIGHTS), size)), np.zeros(len(WEIGHTS)))
            c = m.exact(tok)
            row = np.repeat(np.arange(len(per)), per)
            ids = pa.chunked_array([r.column("doc_id") for r in rows]).combine_chunks()
            yield pa.RecordBatch.from_arrays([
                pa.array(base + np.arange(size)), ids, pa.array(own == 1), pa.array(per), pa.array(np.bincount(row, c > 0, size).astype(np.int64)), pa.array(np.bincount(row, np.log10(np.maximum(c, 0) + 1.0), size)),
                pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * len(WEIGHTS), pa.int32()), pa.array(logs.T.ravel())), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary()), pa.nulls(size, pa.binary()), pa.array(["text"] * size, pa.string()),
            ], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([base]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), *(pa.nulls(1, pa.int64()) for _ in range(2)), pa.nulls(1, pa.float64()), pa.array([less], pa.list_(pa.float64())), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array(["fit"])], names=names)
            rare = np.flatnonzero(c < 0)
            rare = rare[np.argsort(tok[rare], kind="stable")]
            cut = segments(tok[rare], n_segments)
            asked = [i for i in range(n_segments) if cut[i] < cut[i + 1]]
            yield blobs(base, asked, *([a[cut[i] : cut[i + 1]].tobytes() for i in asked] for a in (tok[rare], row[rare].astype(np.uint32))), "rare")
            if not m.filter:
                w, at = np.unique(tok, return_inverse=True)
                b, pat = np.unique(pair_keys(tok, per), return_inverse=True)
                wb, bb = segments(w, n_segments), segments(b, n_segments)
                every = [i for i in range(n_segments) if wb[i] < wb[i + 1] or bb[i] < bb[i + 1]]
                yield blobs(base, every, *([a[to[i] : to[i + 1]].tobytes() for i in every] for a, to in ((w, wb), (b, bb))), "probe")
                yield blobs(base, [None], [np.stack([at, pat]).astype(np.int32).tobytes()], [np.stack([per, own]).astype(np.int64).tobytes()], "body")
            base += 1 << 22

    names = ["row", "doc_id", "trained", "n_tokens", "known", "logs", "scores", "seg", "keys", "at", "kind"]
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), trained.alias("trained"))
    made = written(kept.mapInArrow(local, "row long, doc_id long, trained boolean, n_tokens long, known long, logs double, scores array<double>, seg int, keys binary, at binary, kind string"), "lm-rows")

    def answer(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"row": [], "known": [], "logs": []}).astype({"row": "int64", "known": "int64", "logs": "float64"})
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in asked["keys"]])
        row = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + r for x, r in zip(asked["at"], asked["row"], strict=True)])
        c = np.zeros(len(keys))
        if len(held):
            w, wn = np.frombuffer(held["words"][0], np.uint64), np.frombuffer(held["word_n"][0], np.int64)
            if len(w):
                at = np.minimum(np.searchsorted(w, keys), len(w) - 1)
                c = np.where(w[at] == keys, wn[at], 0)
        rows, at = np.unique(row[c > 0], return_inverse=True)
        return pd.DataFrame({"row": rows, "known": np.bincount(at, minlength=len(rows)), "logs": np.bincount(at, np.log10(c[c > 0] + 1.0), len(rows))})

    def probe(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        f = Filter(np.frombuffer(held["bits"][0], np.uint8), np.array([held["size"][0]])) if len(held) else Filter(np.zeros(0, np.uint8), np.zeros(0, np.int64))
        w, b = ([np.frombuffer(x, np.uint64) for x in asked[c]] for c in ("keys", "at"))
        told = [(f.level(word_key(x), x), f.level(y, y)) for x, y in zip(w, b, strict=True)]
        return pd.DataFrame({"row": asked["row"], "seg": asked["seg"], **{c: [t[i].astype(np.uint8).tobytes() for t in told] for i, c in enumerate(("w", "b"))}})

    def mixed(body: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values("seg")
        lw, lb = (np.frombuffer(b"".join(told[c]), np.uint8).astype(np.int64) for c in ("w", "b"))
        out: dict[str, list] = {"row": [], "scores": [], "kind": []}
        for base, keys, at in zip(body["row"], body["keys"], body["at"], strict=True):
            (w, b), (per, own) = np.frombuffer(keys, np.int32).reshape(2, -1), np.frombuffer(at, np.int64).reshape(2, -1)
            logs, less = sent.value.both_ways(lw[w], lb[b], per, own)
            out["scores"] += [*logs.T.tolist(), less.tolist()]
            out["row"] += [*(base + np.arange(len(per))).tolist(), base]
            out["kind"] += ["text"] * len(per) + ["fit"]
        return pd.DataFrame(out)

    asked = made.where("kind = 'rare'").select("seg", "row", "keys", "at")
    told = asked.groupBy("seg").cogroup(table_.select("seg", "words", "word_n").groupBy("seg")).applyInPandas(answer, "row long, known long, logs double")
    told = told.groupBy("row").agg(F.sum("known").alias("more"), F.sum("logs").alias("more_logs"))
    rows = made.where("kind = 'text'")
    if not model.filter:
        level = made.where("kind = 'probe'").select("seg", "row", "keys", "at").groupBy("seg").cogroup(table_.select("seg", "bits", "size").groupBy("seg")).applyInPandas(probe, "row long, seg int, w binary, b binary")
        got = made.where("kind = 'body'").select("row", "keys", "at").groupBy("row").cogroup(level.groupBy("row")).applyInPandas(mixed, "row long, scores array<double>, kind string")
        got = written(got, "lm-scores")
        rows = rows.drop("scores").join(got.where("kind = 'text'").drop("kind"), "row")
    if model.best is None:  # by leave-one-out over the training documents
        sums = (made if model.filter else got).where("kind = 'fit'").agg(*(F.sum(F.col("scores")[i]) for i in range(len(WEIGHTS)))).first()
        model.best = max(range(len(WEIGHTS)), key=lambda i: sums[i] if sums[i] is not None else 0.0)
    below = float(np.log10(model.n + model.v + 1))
    known, logs = F.col("known") + F.coalesce("more", F.lit(0)), F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return rows.join(told, "row", "left").select("doc_id", "trained", "n_tokens", known.alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * below).alias("base_score"), F.col("scores")[model.best].alias("score"))


def op3_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    learned = training(F.col("doc_id"))
    out = score(docs, *fit(docs.where(learned), choose=False), learned)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
