"""Byte-level BPE encoding and decoding with a lexicon of frequent words in a minimal acyclic transducer.

The corpus's words are counted over all documents; the most frequent `lexicon_words` are encoded once and compiled
into the transducer, whose image (a bounded size) is a file of the shared folder that the workers memory-map. A slice of text is cut
into pre-tokens, its distinct pre-tokens are walked through the transducer together, and those it does not hold are
merged exactly, all at once: each round finds every word's lowest-ranked pair and merges it. The lexicon only saves
work; no result depends on it.

The special token's text is the special id, as in the tokenizer's own default. Null counts as empty; an empty text
has no ids. Texts of any length are encoded whole. Repeated rows are encoded one by one, other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, filesystem, flat, ragged, scratch, slices, table, trimmed, written
from .transducer import Transducer, compile_words, mapped

PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
NONE = 1 << 40
LONG = 64  # bytes from which a word is merged by a heap of its own


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in the vocabulary file: itself if printable, else the next free one from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in kept else next(others)) for b in range(256)]


class Merges:
    """A vocabulary file's tables: bytes of every id, the first id of every byte, and pairs with their rank and result."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        vocab = j["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.tokens[i] = bytes(byte_of[c] for c in t)
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        self.first = np.array([vocab[c] for c in byte_chars()], np.int64)
        pairs = {}
        for rank, m in enumerate(j["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        self.pairs = pairs
        order = sorted(pairs)
        self.key = np.array(order, np.int64)
        self.rank = np.array([pairs[k][0] for k in order], np.int64)
        self.result = np.array([pairs[k][1] for k in order], np.int64)
        self.table = pa.array(self.tokens, pa.large_binary())


@cache
def merges(path: str) -> Merges:
    return Merges(path)


def merge_long(m: Merges, word: bytes) -> list[int]:
    """One word by a heap of pairs: lowest rank first, leftmost first."""
    ids = [int(m.first[b]) for b in word]
    nxt, prv = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < len(ids) and (p := m.pairs.get(ids[i] << 20 | ids[j])):
            heappush(heap, (p[0], i, ids[i], ids[j]))

    for i in range(len(ids) - 1):
        offer(i)
    while heap:
        _, i, a, b = heappop(heap)
        j = nxt[i]
        if ids[i] != a or j >= len(ids) or ids[j] != b:
            continue
        ids[i], ids[j] = m.pairs[a << 20 | b][1], -1
        nxt[i] = nxt[j]
        if nxt[j] < len(ids):
            prv[nxt[j]] = i
        if prv[i] >= 0:
            offer(prv[i])
        offer(i)
    return [i for i in ids if i >= 0]


def merge_batch(m: Merges, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, ids per word) of words data[start:end]."""
    counts = ends - starts
    word, place = ragged(counts)
    sym = m.first[data[starts[word] + place]]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(sym):
        rank = np.full(len(sym), NONE)
        key = sym[:-1] << 20 | sym[1:]
        at = np.minimum(np.searchsorted(m.key, key), len(m.key) - 1)
        good = np.flatnonzero((m.key[at] == key) & (word[1:] == word[:-1]))
        rank[good] = m.rank[at[good]]
        begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        size = np.diff(np.append(begin, len(sym)))
        least = np.repeat(np.minimum.reduceat(rank, begin), size)
        over = least == NONE
        if over.any():
            done.append((word[over], sym[over]))
        pick = (rank == least) & ~over
        where = np.flatnonzero(pick)
        if not len(where):
            break
        run = np.concatenate(([True], where[1:] != where[:-1] + 1))  # "aaa": every other place of a run
        lead = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
        where = where[(np.arange(len(where)) - lead) % 2 == 0]
        sym[where] = m.result[at[where]]
        keep = ~over
        keep[where + 1] = False
        sym, word = sym[keep], word[keep]
    if not done:
        return np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    words_, syms = np.concatenate([a for a, _ in done]), np.concatenate([b for _, b in done])
    order = np.argsort(words_, kind="stable")
    return syms[order], np.bincount(words_, minlength=len(starts))


def pretokens(m: Merges, text: str) -> list[str]:
    """Pre-tokens; a special token's text is one of its own."""
    for special in m.special:
        if special in text:
            head, *rest = text.split(special)
            return pretokens(m, head) + [x for r in rest for x in (special, *pretokens(m, r))]
    return PRETOKEN.findall(text)


def encode_batch(m: Merges, lexicon: Transducer, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(pre-token number of every pre-token, pre-tokens per text, distinct pre-tokens, flat ids of those, offsets, counts)."""
    found, per = [], []
    for t in texts:
        w = pretokens(m, t)
        per.append(len(w))
        found += w
    coded = pa.array(found, pa.string()).dictionary_encode()
    distinct = coded.dictionary
    data, off = flat(distinct)
    starts, ends = off[:-1], off[1:]
    number = lexicon.lookup(data, starts, ends)
    counts = np.zeros(len(distinct), np.int64)
    known = np.flatnonzero(number >= 0)
    counts[known] = lexicon.id_offsets[number[known] + 1] - lexicon.id_offsets[number[known]]
    rest = np.flatnonzero((number < 0) & (ends - starts < LONG))
    ids, n = merge_batch(m, data, starts[rest], ends[rest])
    counts[rest] = n
    alone = {}
    raw = None
    for i in np.flatnonzero((number < 0) & (ends - starts >= LONG)).tolist():
        raw = data.tobytes() if raw is None else raw
        alone[i] = merge_long(m, raw[starts[i] : ends[i]])
        counts[i] = len(alone[i])
    for special, sid in m.special.items():
        at = pc.index(distinct, special).as_py()
        if at >= 0:
            alone[at], counts[at] = [sid], 1
            drop = np.repeat(rest, n) != at
            ids, n = ids[drop], np.where(rest == at, 0, n)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(offsets[-1], np.int64)
    row, place = ragged(counts[known])
    out[offsets[known][row] + place] = lexicon.ids[lexicon.id_offsets[number[known]][row] + place]
    row, place = ragged(n)
    out[offsets[rest][row] + place] = ids
    for i, x in alone.items():
        out[offsets[i] : offsets[i + 1]] = x
    return coded.indices.to_numpy(), np.array(per, np.int64), distinct, out, offsets, counts


def frequent_words(docs: DataFrame, text_col: str = "text", lexicon_words: int = 1 << 16, least: int = 8) -> list[str]:
    """The corpus's most frequent words of letters, counted over all documents: at most lexicon_words, those with the
    highest counts, all words of a count or none. Only they reach the driver."""
    split = docs.select(F.explode(F.split(F.col(text_col), "[ \n]")).alias("w"))
    counts = written(split.groupBy("w").count().where((F.col("count") >= least) & F.col("w").rlike(r"^\p{L}{1,40}$")), "word-counts")
    below = lambda c: F.floor(F.log2(F.col(c)) * 16)
    room, floor_ = lexicon_words, None
    for r in counts.groupBy(below("count").alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        room -= r.n
        if room < 0:
            break
        floor_ = r.step
    out = [] if floor_ is None else [r.w for r in counts.where(below("count") >= floor_).select("w").collect()]
    dropped(counts)
    return out


def build_lexicon(m: Merges, words_: list[str]) -> bytes:
    """The transducer's image for words as they stand after a space."""
    texts = [f" {w}".encode() for w in words_]
    texts = [t for t in dict.fromkeys(texts) if len(t) < LONG]
    joined = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts]).astype(np.int64) if texts else np.zeros(0, np.int64)
    ids, n = merge_batch(m, joined, ends - np.diff(np.concatenate(([0], ends))), ends)
    cuts = np.split(ids, np.cumsum(n)[:-1]) if len(n) else []
    return compile_words({t: x.tolist() for t, x in zip(texts, cuts, strict=True)})


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 1 << 16, digests: bool = False, slice_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, ids array<int>, text decoded from them), or with `digests` (doc_id, n_tokens, ids_sha256, decoded_sha256).

    vocabulary: path of a byte-level BPE file that every worker has; it is opened there, never shipped."""
    spark = docs.sparkSession
    lexicon_file = scratch(spark, "lexicon")
    fs, path = filesystem(lexicon_file)
    with fs.open_output_stream(path) as out:
        out.write(build_lexicon(merges(vocabulary), frequent_words(docs, text_col, lexicon_words)))

    def encoded(part: pa.RecordBatch) -> pa.RecordBatch:  # on its own, so that a slice's arrays are gone before the next one's
        m = merges(vocabulary)
        texts = part.column("text").fill_null("").to_pylist()
        which, per, _, ids, offsets, counts = encode_batch(m, mapped(lexicon_file), texts)
        lens = counts[which]
        ends = np.concatenate(([0], np.cumsum(per)))
        tokens = np.concatenate(([0], np.cumsum(lens)))[ends]
        row, place = ragged(lens)
        stream = ids[offsets[which][row] + place]
        del row, place
        decoded = decode_batch(m, stream, tokens)
        if not digests:
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(tokens, pa.int32()), pa.array(stream, pa.int32())), pa.array(decoded)], names=["doc_id", "ids", "decoded"])
        del stream
        decoded_sha = [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
        del decoded
        each = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids).cast(pa.string())), ",")  # each distinct pre-token once
        listed = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each.take(pa.array(which))), ",")
        ids_sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in listed]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(tokens)), pa.array(ids_sha), pa.array(decoded_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                yield encoded(part)
        trimmed()

    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, shape)


def decode_batch(m: Merges, stream: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Texts of ids stream[bounds[i]:bounds[i + 1]]; bytes that are no UTF-8 become U+FFFD."""
    pieces = m.table.take(pa.array(stream))
    data, off = flat(pieces)
    raw = data.tobytes()
    cut = off[bounds]
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of a table of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(vocabulary)
        for batch in batches:
            lists = batch.column(1)
            lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decode_batch(m, lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lens)))))], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), vocabulary_path(), digests=True)
