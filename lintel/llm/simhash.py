"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to a 23-bit word. Two fingerprints that
differ in at most 4 bits differ in at most 2 bits in two of the three segments (two segments with 3 errors each would
make 6), and words within 2 bits share a codeword key (golay.py). So the pairs of keys of two segments are join keys
that miss no link.

Rounds. First every fingerprint is dealt by its nearest codewords only (3 keys), which joins most members of large
groups. Then it is dealt by all its keys (about 85) with the label of its group so far: a bucket compares only members
of different labels, and what a task finds in a stretch of sorted buckets is folded into one link a label. Keys that have
their first codeword in common are a group, and a fingerprint travels once for each of its groups (about 10), not for each
key: the task that gets a group makes its keys, a stretch of sorted groups at a time, and of a large group some of the keys at
a time, so a task's memory follows neither the table nor its share. A group much larger than others is cut in shares of
its keys. A bucket of more than `heavy` members is cut in blocks, a task for each pair of blocks.

With `far` (the pipeline's stage) a second fingerprint of the same shingles, by an independent hash, is dealt along with
the first. Pairs within `far` bits of either are candidates whose five-word shingles are compared. Each fingerprint carries
an odd sketch of its set (Mitzenmacher, Pagh, Pham 2014: a bit is the parity of the shingles that fall on it). Sketches differ
in no more bits than sets do in members, so a pair whose sketches differ in more than its similarity allows is no link and no
candidate; every other pair is one. A stretch gives a spanning forest of its candidates and, for each tree, the fingerprints
of those it did not give. Once the forest is verified, trees that links have joined whole are settled; the fingerprints of the
others are dealt once more, for every pair that is not joined. Sketches have 128 bits, then 256; sets of some 300 members, then
600, and more fill them: only their sizes tell then.

Null and empty texts, and texts of white space only, have fingerprint zero and link like any other. Texts of any length
are read whole, a few MB at a time. Repeated rows get equal answers. A null doc_id never names a component unless all of
the component's ids are null; a group of null ids only is not compared beyond `most` bits. Only the id and text columns are
read, so other names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import golay
from .common import ascii_lower, flat, fold, mix, one_row_each, partitions, ragged, slices, stretches, table, trimmed, words, written
from .components import components

SKETCH, SHORT = 4, 2  # words of 64 bits: of all sketches, and of those that are dealt with every fingerprint
SKETCHED = ["n", *(f"sketch{k}" for k in range(SKETCH))]
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))


def bits_of(h: np.ndarray, begins: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Majority bits of the hashes of each text; h[begins[i]:begins[i] + count[i]] are those of text i, one at least."""
    bits = np.zeros((len(begins), 64), np.int64)
    for lo in range(0, len(h), 1 << 16):  # unpacked bits take 64 bytes a shingle
        part = h[lo : lo + (1 << 16)]
        cut = np.unique(np.concatenate(([0], begins[(begins > lo) & (begins < lo + len(part))] - lo)))
        sums = np.add.reduceat(np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64), cut, axis=0, dtype=np.int64)
        bits[np.searchsorted(begins, cut + lo, "right") - 1] += sums
    return ((2 * bits > count[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def shingle_hashes(texts: pa.Array, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of all shingles in order, how many each text has)."""
    ended = pc.binary_join_element_wise(pc.fill_null(texts, ""), "", "\n")  # a space after every word
    data, offsets = flat(ended)
    data = fold(data)
    starts, ends, per = words(data, offsets)
    count = np.where(per == 0, 0, np.maximum(per - shingle + 1, 1))
    if not len(starts):
        return np.zeros(0, np.uint64), count
    keep = np.zeros(len(data) + 1, np.int8)
    keep[starts] += 1
    keep[ends + 1] -= 1
    keep = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)  # each word and the byte after it
    data[ends] = 32
    at = np.cumsum(keep, dtype=np.int32)
    joined = memoryview(data[keep].tobytes())
    a, b = at[starts] - 1, at[ends] - 1
    del data, keep, at, starts, ends
    row, place = ragged(count)
    first = (np.cumsum(per) - per)[row] + place
    last = first + np.minimum(per, shingle)[row] - 1
    out, digest = np.empty(len(first), np.uint64), xxhash.xxh64_intdigest
    for lo in range(0, len(first), 1 << 15):  # as numbers of Python a few at a time
        part = slice(lo, lo + (1 << 15))
        out[part] = [digest(joined[x:y], seed) for x, y in zip(a[first[part]].tolist(), b[last[part]].tolist(), strict=True)]
    return out, count


def fingerprints(texts: pa.Array, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """uint64 fingerprints of texts. The texts of one call should be a few MB at most."""
    return both_fingerprints(texts, shingle, seed)[0]


def both_fingerprints(texts: pa.Array, shingle: int = 4, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, fingerprints by an independent hash, numbers of distinct pairs of shingles that follow each other, odd
    sketches of these pairs in SHORT words). A text of one shingle has that one as its only member."""
    h, count = shingle_hashes(texts, shingle, seed)
    one, two, sets = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64), np.minimum(count, 1)
    sketch = np.zeros((len(texts), SHORT), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        begins = (np.cumsum(count) - count)[some]
        one[some] = bits_of(h, begins, count[some])
        two[some] = bits_of(mix(h ^ np.uint64(0x2545F4914F6CDD1D)), begins, count[some])
        inner = np.ones(len(h), bool)
        inner[np.append(begins[1:], len(h)) - 1] = False  # a text's last shingle begins no pair
        at = np.flatnonzero(inner)
        row = np.repeat(np.arange(len(texts)), count)[at]
        pair = mix(h[at] * np.uint64(0x9FB21C651E98DF25) + h[at + 1])
        order = np.lexsort((pair, row))
        row, pair = row[order], pair[order]
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (pair[1:] != pair[:-1]))) if len(row) else np.zeros(0, bool)
        sets = np.maximum(sets, np.bincount(row[new], minlength=len(texts)))
        alone = np.flatnonzero(count == 1)
        row, pair = np.concatenate((row[new], alone)), np.concatenate((pair[new], mix(h[(np.cumsum(count) - count)[alone]])))
        np.bitwise_xor.at(sketch.reshape(-1), row * SHORT + (pair >> np.uint64(6) & np.uint64(SHORT - 1)).astype(np.int64), np.uint64(1) << (pair & np.uint64(63)))
    return one, two, sets, sketch


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, slice_bytes: int = 1 << 21) -> DataFrame:
    """(doc_id, h, fp, other, n, sketch0, ...): a hash of the text, both fingerprints as signed longs, the size of its set of longer
    shingles and the SHORT words of the set's odd sketch."""
    names = ["doc_id", "h", "fp", "other", *SKETCHED[: 1 + SHORT]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                one, two, n, sketch = both_fingerprints(part.column("text"), shingle)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(n), *(pa.array(w.view(np.int64)) for w in sketch.T.copy())], names=names)
        trimmed()

    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).mapInArrow(run, ", ".join(f"{c} long" for c in names))


OTHER = 1 << 26  # marks the keys of the second fingerprint; the first ones are less


def codewords(fps: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    shift, width = SEGMENTS[segment]
    return golay.keys((fps >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1))


GROUPS = 1 << 14  # a bit for the second fingerprint, one for the segment, 12 for its codeword


def groups_of(fps: np.ndarray, second: np.ndarray, nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(groups, index of the fingerprint of each). nearest: by the nearest codewords only."""
    groups, rows = [], []
    for x in (0, 1):
        k, n = codewords(fps, x)
        for s in range(1 if nearest else 6):
            at = np.flatnonzero(s < n)
            groups.append(second[at].astype(np.int64) << 13 | x << 12 | k[at, s])
            rows.append(at)
    return np.concatenate(groups), np.concatenate(rows)


def turn_of(codeword: np.ndarray, turns: int) -> np.ndarray:
    return (codeword * 40503 >> 7) % turns


def keys_in(group: np.ndarray, fps: np.ndarray, nearest: bool = False, turn: int = 0, turns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row of each) of fingerprints in one group each: OTHER, two bits for the pair of segments, 12 for each of the two
    codewords. Of several turns each makes the keys of other second codewords."""
    keys, rows = [], []
    for i, (x, y) in enumerate(PAIRS):
        own = np.flatnonzero(group >> 12 & 1 == x)
        k, n = codewords(fps[own], y)
        base = (group[own] >> 13) * OTHER | i << 24 | (group[own] & 4095) << 12
        for t in range(1 if nearest else 6):
            at = np.flatnonzero((t < n) & (turn_of(k[:, t], turns) == turn))
            keys.append(base[at] | k[at, t])
            rows.append(own[at])
    return np.concatenate(keys), np.concatenate(rows)


def key_pairs(fps: np.ndarray, nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(keys, index of the fingerprint of each) of first fingerprints."""
    group, at = groups_of(fps, np.zeros(len(fps), bool), nearest)
    keys, row = keys_in(group, fps[at], nearest)
    return keys, at[row]


def packed(fps: np.ndarray, second: np.ndarray, cut: np.ndarray, nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(keys to deal by, index of the fingerprint of each): less than 0 for a group or one of its cut[group] shares, by the
    second codeword; keys themselves of groups whose cut is 0."""
    group, at = groups_of(fps, second, nearest)
    whole, more = np.flatnonzero(cut[group] == 1), np.flatnonzero(cut[group] != 1)
    if not len(more):
        return -1 - group, at
    key, row = keys_in(group[more], fps[at[more]], nearest)
    own, row = group[more[row]], at[more[row]]
    key = np.where(cut[own] == 0, key, -1 - ((key & 4095) % np.maximum(cut[own], 1) << 14 | own))
    one = one_each(row, key)
    return np.concatenate((-1 - group[whole], key[one])), np.concatenate((at[whole], row[one]))


def unpacked(key: np.ndarray, fps: np.ndarray, cut: np.ndarray, nearest: bool = False, turn: int = 0, turns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row of each) of what packed() gave."""
    alone, rows = np.flatnonzero((key >= 0) & (turn_of(key & 4095, turns) == turn)), np.flatnonzero(key < 0)
    code = -1 - key[rows]
    group, share = code & (GROUPS - 1), code >> 14
    own, row = keys_in(group, fps[rows], nearest, turn, turns)
    ok = (own & 4095) % np.maximum(cut[group[row]], 1) == share[row]
    return np.concatenate((key[alone], own[ok])), np.concatenate((alone, rows[row[ok]]))


def cuts(members: np.ndarray, heavy: int) -> np.ndarray:
    """Shares to cut each group in: 1, but for those that have four times the members of others, or more than a task should hold."""
    most = min(max(4 * members.sum() / max(1, np.count_nonzero(members)), min(heavy, 1 << 12)), 1 << 17)
    return np.clip(np.ceil(members / most), 1, 4096).astype(np.int64)


def parts_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest vertex reachable from each of n vertices under the links (a, b)."""
    part = np.arange(n)
    while True:
        low = np.minimum(part[a], part[b])
        new = part.copy()
        for at in (a, b, part[a], part[b]):
            np.minimum.at(new, at, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == part).all():
            return part
        part = new


def near_pairs(key: np.ndarray, bits: np.ndarray, label: np.ndarray, limit: int, cells: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, differing bits) of the pairs of a bucket that have different labels and differ in `limit` bits at most. Rows
    are sorted by key and label."""
    if not len(key):
        return
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    length = np.diff(np.append(begin, len(key)))
    mixed = label[begin] != label[begin + length - 1]
    few = np.repeat(mixed & (length <= 16), length)
    for d in range(1, 16):
        at = np.flatnonzero(few[d:] & (key[d:] == key[:-d]) & (label[d:] != label[:-d]))
        if len(at):
            gap = np.bitwise_count(bits[at] ^ bits[at + d])
            ok = gap <= limit
            yield at[ok], at[ok] + d, gap[ok]
    for lo, n in zip(begin[mixed & (length > 16)].tolist(), length[mixed & (length > 16)].tolist(), strict=True):
        hi, step = lo + n, max(1, cells // n)
        for x in range(lo, hi, step):
            y = min(x + step, hi)
            after = x if label[x] != label[y - 1] else int(np.searchsorted(label[x:hi], label[x], "right")) + x
            if after >= hi:
                continue
            gap = np.bitwise_count(bits[x:y, None] ^ bits[None, after:hi])
            i, j = np.nonzero((gap <= limit) & (label[x:y, None] < label[None, after:hi]))
            yield x + i, after + j, gap[i, j]


def one_each(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the first of each distinct pair (a, b)."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    return order[np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))] if len(order) else order


def sure_parts(key: np.ndarray, bits: np.ndarray, label: np.ndarray, n: int, most: int) -> np.ndarray:
    """Part of each of n labels under the pairs of the first fingerprint within `most` bits."""
    links = [np.zeros((2, 0), np.int64)]
    first = key & OTHER == 0
    for i, j, _ in near_pairs(key[first], bits[first], label[first], most):
        x, y = label[first][i], label[first][j]
        one = one_each(x, y)
        links.append(np.stack([x[one], y[one]]))
    return parts_of(n, *np.concatenate(links, 1))


def candidates(key: np.ndarray, bits: np.ndarray, part: np.ndarray, far: int, every: bool, sketch: list[np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(i, j, tree, False): pairs of rows within `far` bits and of different parts that can be that similar by their sketches. All
    with `every`, else the edges of a spanning forest over the parts and then, with True, the rows (twice) of the pairs that
    were not given. tree: a part that stands for the tree, -1 with `every`."""
    order = np.lexsort((part, key))
    root = list(range(int(part.max(initial=-1)) + 1))
    held, edges = np.zeros(len(key), bool), [np.zeros((2, 0), np.int64)]
    for i, j, _ in near_pairs(key[order], bits[order], part[order], far):
        i, j = order[i], order[j]
        if sketch:
            ok = may_be_alike(sketch, i, j, similarity)
            i, j = i[ok], j[ok]
        if every:
            yield i, j, np.full(len(i), -1), False
            continue
        chosen = np.zeros(len(i), bool)
        for n in one_each(np.minimum(part[i], part[j]), np.maximum(part[i], part[j])).tolist():
            u, v = int(part[i[n]]), int(part[j[n]])
            while root[u] != u:
                root[u] = u = root[root[u]]
            while root[v] != v:
                root[v] = v = root[root[v]]
            if u != v:
                root[max(u, v)] = min(u, v)
                chosen[n] = True
        edges.append(np.stack([i[chosen], j[chosen]]))
        held[i[~chosen]] = held[j[~chosen]] = True
    if not every:
        tree = np.array(root, np.int64)
        while (tree[tree] != tree).any():
            tree = tree[tree]
        i, j = np.concatenate(edges, 1)
        rest = np.flatnonzero(held)
        yield i, j, tree[part[i]], False
        yield rest, rest, tree[part[rest]], True


FOUND = "a long, b long, kind int, tree long, held array<long>"
CROWDED = 1 << 16  # keys that are broadcast at most
SURE, FIRST, SECOND = 0, 1, 2  # kinds: a link of two labels; candidates by the first and by the second fingerprint


def odd_sketch(s: str) -> list[Column]:
    """Columns SKETCHED of an array of hashes: its size and, bit by bit, the parity of the hashes that fall on a bit."""
    word = lambda k: F.expr(f"aggregate({s}, 0L, (acc, x) -> acc ^ if(shiftright(x, 6) & {SKETCH - 1} = {k}, shiftleft(1L, cast(x & 63 AS int)), 0L))")
    return [F.size(s).cast("long").alias("n"), *(word(k).alias(f"sketch{k}") for k in range(SKETCH))]


def may_be_alike(of: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets of rows i and j, by their columns SKETCHED, can have that Jaccard similarity: never false if they have."""
    n, words_ = of[0], [x.view(np.uint64) for x in of[1:]]
    apart = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words_)
    least, greatest = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    return (least >= similarity * greatest - 1e-6) & (apart * (1 + similarity) <= (1 - similarity) * (least + greatest) + 1e-6)


def search(nodes: DataFrame, most: int, far: int = 0, nearest: bool = False, every: bool = False, heavy: int = 1 << 18, rows: int = 1 << 18, similarity: float = 0.0) -> DataFrame:
    """nodes (bits, second: which fingerprint they are of, label) -> FOUND: links of two labels, candidates (lower first), and in
    rows of their own the fingerprints some of whose candidates are not given, unless with `every` all are. tree: a number for
    the candidates of a tree and what is held with it; two trees may have the same by chance.

    With a similarity, nodes also have the columns SKETCHED or the first of them, and pairs that cannot be that similar are no
    candidates."""
    spark = nodes.sparkSession
    parts = partitions(spark)
    sketched = [c for c in SKETCHED if c in nodes.columns] if similarity else []

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(GROUPS, np.int64)
        for batch in batches:
            own, second = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            n += np.bincount(groups_of(own.view(np.uint64), second, nearest)[0], minlength=GROUPS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["g", "n"])

    def dealt(cut: np.ndarray) -> DataFrame:
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    part = batch.slice(lo, 4096)
                    own, second, label, *sketch = (c.to_numpy(zero_copy_only=False) for c in part.columns)
                    keys, at = packed(own.view(np.uint64), second, cut, nearest)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(x[at]) for x in (own, label, *sketch))], names=["key", "bits", "label", *sketched])

        columns = ", ".join(f"{c} long" for c in ("key", "bits", "label", *sketched))
        return nodes.select("bits", "second", "label", *sketched).repartition(parts).mapInArrow(emit, columns)

    members = np.zeros(GROUPS, np.int64)
    for r in nodes.select("bits", "second").mapInArrow(counts, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        members[r.g] = r.n
    cut = cuts(members, heavy)
    crowd = None
    if (members > heavy).any():  # no bucket has more members than its group
        crowd = dealt(np.where(members > heavy, 0, 1)).where("key >= 0").groupBy("key").count().where(F.col("count") > heavy).select("key", F.ceil(F.col("count") / heavy).cast("int").alias("blocks"))
        crowd = written(crowd, "crowded-keys")
        of = F.expr("shiftleft(shiftright(key, 26), 13) + (shiftright(key, 13) & 4096) + (shiftright(key, 12) & 4095)")
        cut[[r.g for r in crowd.select(of.alias("g")).distinct().collect()]] = 0

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """The columns of whole buckets sorted by key and label, about `rows` rows at a time."""
        for part in stretches(batches, max(1, rows // 8)):
            turns = 1 + part.num_rows // max(1, rows // 4)
            own, *rest = (c.to_numpy() for c in part.columns)
            for turn in range(turns):
                key, row = unpacked(own, rest[0].view(np.uint64), cut, nearest, turn, turns)
                order = np.lexsort((rest[1][row], key))
                if len(order):
                    yield [key[order], *(x[row[order]] for x in rest)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray, kind: np.ndarray, tree: np.ndarray | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(kind.astype(np.int32)), pa.nulls(len(a), pa.int64()) if tree is None else pa.array(tree), pa.nulls(len(a), pa.list_(pa.int64()))], names=names)

        names = ["a", "b", "kind", "tree", "held"]
        for key, own, label, *sketch in buckets(batches):
            bits = own.view(np.uint64)
            known, at = np.unique(label, return_inverse=True)
            root = sure_parts(key, bits, at, len(known), most)
            moved = np.flatnonzero(root != np.arange(len(known)))
            yield out(known[moved], known[root[moved]], np.full(len(moved), SURE))
            for i, j, tree, rest in candidates(key, bits, root[at], far, every, sketch, similarity) if far > most else ():
                kind = np.where(key[i] & OTHER, SECOND, FIRST)
                tree = mix(tree.astype(np.uint64) + np.uint64(int(key[0]) * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64)  # a key is of one stretch only
                if not rest:
                    x, y = np.minimum(bits[i], bits[j]), np.maximum(bits[i], bits[j])
                    one = one_each(x ^ kind.astype(np.uint64), y)  # a pair may meet in several buckets
                    yield out(x[one], y[one], kind[one], None if every else tree[one])
                    continue
                order = np.lexsort((own[i], kind, tree))
                tree, kind, some = tree[order], kind[order], own[i[order]]
                new = np.concatenate(([True], (tree[1:] != tree[:-1]) | (kind[1:] != kind[:-1])))[: len(some)]
                first = new | np.concatenate(([True], some[1:] != some[:-1]))[: len(some)]
                tree, kind, some, new = tree[first], kind[first], some[first], new[first]
                begin = np.flatnonzero(new)
                begin = np.flatnonzero(new | ((np.arange(len(some)) - np.repeat(begin, np.diff(np.append(begin, len(some))))) % (1 << 16) == 0))
                none = pa.nulls(len(begin), pa.int64())
                held = pa.ListArray.from_arrays(pa.array(np.append(begin, len(some)).astype(np.int32)), pa.array(some))
                yield pa.RecordBatch.from_arrays([none, none, pa.array(kind[begin].astype(np.int32)), pa.array(tree[begin]), held], names=names)

    keyed = dealt(cut)
    if not cut.all():
        if crowd.count() <= CROWDED:
            crowd = F.broadcast(crowd)
        keyed = keyed.join(crowd, "key", "left")
        own = F.pmod(F.xxhash64("bits"), "blocks").cast("int")
        each = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.greatest(o, own) * F.col("blocks") + F.least(o, own)))
        keyed = keyed.select(F.explode(each).alias("block"), "key", "bits", "label", *sketched).select((F.col("block").cast("long") * F.lit(1 << 27) + F.col("key")).alias("key"), "bits", "label", *sketched)
    return keyed.repartition(4 * parts, "key").sortWithinPartitions("key").mapInArrow(find, FOUND)


def shingle_set(text: Column, shingle: int) -> Column:
    """array<long>: hashes of a text's distinct shingles of so many words; of all its words if they are fewer."""
    words_ = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+", -1), lambda w: w != "")
    each = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - shingle, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, F.lit(shingle)), " ")))
    return F.transform(F.array(words_), lambda w: F.array_distinct(each(w)))[0]  # names the words, so they are split once


def sets_of(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, th: hash of a text, several: whether other texts have the id too, s: the text's set of shingles) of documents with
    these ids (repeated ones count once), as a table."""
    texts = docs.join(ids.distinct(), "id").withColumn("th", F.xxhash64("text")).dropDuplicates(["id", "th"])
    sets = written(texts.select("id", "th", shingle_set(F.col("text"), shingle).alias("s")), "shingles")
    return sets.join(sets.groupBy("id").agg((F.min("th") < F.max("th")).alias("several")), "id")


def own_text(rep: str, h: str, id_: str = "id", th: str = "th", several: str = "several") -> Column:
    """Joins a document, by its id and the hash of its text, to its row of sets_of()."""
    return (F.col(rep) == F.col(id_)) & (~F.col(several) | (F.col(h) == F.col(th)))


def alike(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b, ra, rb: ids of documents, ha, hb: hashes of their texts) whose sets, as sets_of() gives them, have at least
    that Jaccard similarity -> (a, b). Of the texts of an id that several have, the one with that hash counts."""
    side = lambda k: sets.select(F.col("id").alias(f"i{k}"), F.col("th").alias(f"t{k}"), F.col("several").alias(f"several_{k}"), F.col("s").alias(f"s{k}"))
    of = lambda k: own_text(f"r{k}", f"h{k}", f"i{k}", f"t{k}", f"several_{k}")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(side("a"), of("a")).join(side("b"), of("b")).where(both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4, heavy: int = 1 << 18, far: int = 0, similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id, h (a hash of its text), group (a number), fingerprint (16 hex digits), component_id.

    With `far`, documents link too that are up to so many bits apart by either fingerprint, share a key of it and are that
    similar by their sets of shingles one word longer. Keys guarantee a meeting up to 5 bits; beyond that a share of such
    pairs does not meet under one fingerprint, and fewer under neither."""
    own = written(fingerprint_table(docs, id_col, text_col, shingle), "fingerprints")
    if far > most:
        sketch = [c for c in SKETCHED if c in own.columns]
        first = own.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "other", *sketch)).alias("m"))
        nodes = first.select("fp", F.col("m.doc_id").alias("rep"), F.col("m.h").alias("text_h"), *(f"m.{c}" for c in ("other", *sketch)))
    else:
        nodes = own.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    nodes = written(nodes, "nodes")
    links = written(search(nodes.select(F.col("fp").alias("bits"), F.lit(False).alias("second"), F.col("fp").alias("label")), most, nearest=True, heavy=heavy).select("a", "b").distinct(), "links")

    def labelled(edges: DataFrame) -> DataFrame:
        roots = components(edges)
        return nodes.join(roots, nodes.fp == roots.v, "left").withColumn("label", F.coalesce("root", "fp")).drop("v", "root")

    now = labelled(links)
    entries = now.select(F.col("fp").alias("bits"), F.lit(False).alias("second"), "label")
    if far > most:
        now = written(now, "labels")
        # one node stands for a second fingerprint; others that have it are candidates with that one
        seconds = written(nodes.groupBy("other").agg(F.min(F.struct("fp", "rep", "text_h", *sketch)).alias("m")).select("other", "m.*"), "seconds")
        named = now.select("fp", "label")
        entries = now.select(F.col("fp").alias("bits"), F.lit(False).alias("second"), "label", *sketch).unionByName(seconds.join(named, "fp").select(F.col("other").alias("bits"), F.lit(True).alias("second"), "label", *sketch))
    found = search(entries, most, far, heavy=heavy, similarity=similarity if far > most else 0.0)
    if far > most:
        found = written(found, "found")
    links = links.unionByName(found.where("kind = 0").select("a", "b"))
    if far > most:
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

        def compared(pairs: DataFrame, known: DataFrame | None = None, sets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
            """(the pairs of nodes that candidates stand for, those of them that are alike). sets: those of all their documents."""
            met, pairs = None, written(pairs.distinct(), "candidates")  # a pair meets in several buckets
            for kind, bits in ((FIRST, "fp"), (SECOND, "other")):
                side = lambda k: (nodes if kind == FIRST else seconds).select(F.col(bits).alias(k), F.col("fp").alias(f"f{k}"), F.col("rep").alias(f"r{k}"), F.col("text_h").alias(f"h{k}"), F.col("n").alias(f"n{k}"))  # noqa: B023, E731
                part = pairs.where(F.col("kind") == kind).join(side("a"), "a").join(side("b"), "b").where(f"fa <> fb AND least(na, nb) >= {similarity} * greatest(na, nb)")
                swap = lambda x, y: F.when(F.col("fa") < F.col("fb"), F.col(x)).otherwise(F.col(y))
                part = part.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"), swap("ra", "rb").alias("ra"), swap("rb", "ra").alias("rb"), swap("ha", "hb").alias("ha"), swap("hb", "ha").alias("hb"))
                met = part if met is None else met.unionByName(part)
            met = written((met if known is None else met.join(known.select("a", "b"), ["a", "b"], "left_anti")).distinct(), "met")
            if sets is None:
                sets = sets_of(texts, met.select(F.col("ra").alias("id")).unionByName(met.select(F.col("rb").alias("id"))), shingle + 1)
            return met, alike(sets, met, similarity)

        one = seconds.select("other", F.col("fp").alias("b")).join(named.select(F.col("fp").alias("b"), F.col("label").alias("with")), "b")
        stars = now.join(one, "other").where(F.col("label") != F.col("with")).select(F.col("fp").alias("a"), "b", F.lit(FIRST).alias("kind"))
        tried, same = compared(found.where("kind > 0 AND held IS NULL").select("a", "b", "kind").unionByName(stars))
        links = written(links.unionByName(same), "links")
        if found.where("held IS NOT NULL").limit(1).count():
            now = written(labelled(links), "labels")
            marked = now.select(F.lit(FIRST).alias("kind"), F.col("fp").alias("bits"), "label", "rep", "text_h")
            marked = marked.unionByName(seconds.select(F.lit(SECOND).alias("kind"), F.col("other").alias("bits"), "fp", "rep", "text_h").join(now.select("fp", "label"), "fp").drop("fp"))
            marked = written(marked, "labels")
            side = lambda k: marked.select("kind", F.col("bits").alias(k), F.col("label").alias(f"label_{k}"))
            edges = found.where("kind > 0 AND held IS NULL").join(side("a"), ["kind", "a"]).join(side("b"), ["kind", "b"])
            torn = edges.where("label_a <> label_b").select("tree").distinct()  # all others are joined as a whole
            left = found.where("held IS NOT NULL").select("kind", "tree", "held").join(torn, "tree", "left_semi").select("kind", F.explode("held").alias("bits")).distinct()
            again = left.join(marked, ["kind", "bits"]).select("bits", (F.col("kind") == SECOND).alias("second"), "label", "rep", "text_h")
            again = written(again, "held")
            sets = sets_of(texts, again.select(F.col("rep").alias("id")), shingle + 1)
            sketches = sets.select("id", "th", "several", *odd_sketch("s"))
            again = written(again.join(sketches, own_text("rep", "text_h")).select("bits", "second", "label", *SKETCHED), "sketches")
            rest = search(again, most, far, every=True, heavy=heavy, similarity=similarity)
            links = links.unionByName(compared(rest.where("kind > 0").select("a", "b", "kind"), tried, sets)[1])
    named = labelled(links)
    named = named.join(named.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("fp", "label", "component_id")
    return own.join(named, "fp").select("doc_id", "h", F.col("label").alias("group"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", far: int = 11) -> DataFrame:
    """One row of each group, with its own columns: one that has the group's smallest id.

    Groups are linked as in simhash_components(), and beyond its 4 bits where five-word shingles are at least 0.8 alike."""
    groups = simhash_components(docs, id_col, text_col, far=far).select("doc_id", "h", "group", "component_id")
    return one_row_each(docs, groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))), "group", id_col, F.xxhash64(F.col(text_col)))


def op4_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents")).drop("h", "group")
