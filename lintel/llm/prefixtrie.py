"""The trie of conversation prefixes, its subtree totals found by peeling leaves.

Turns are sorted by ranges of (conv_id, turn), numbered, and given the hash of what precedes them: a sum of the turns' SHA-256
digests times powers of a base, modulo 2^127 - 1. Sums of a range are added to those of the next one, so no conversation
needs a task of its own, and a conversation that begins with turns of another gets its hashes from that one's. A node is
one such hash and a depth.

Leaf peeling: each node holds the number of children that have not reported. A node without any is complete, sends its
subtree's totals to its parent and is done; the parent counts down. Rounds go on until the root is complete. Nodes of a
single conversation need no round: below them there is one leaf and nothing is saved. Runs of nodes with one unreported
child each are contracted before by doubling pointers, so a copied conversation of any length takes a logarithm of rounds.

Null roles and texts are empty. A null turn comes first; equal turns are in the order of their digests. Rows of equal turn, role
and text are turns of their own. Rows without a conv_id belong to no conversation. Texts of any length only reach the scan.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, partitions, table, written

PRIME, BASE = (1 << 127) - 1, 0x5851F42D4C957F2D14057B7EF767814F % ((1 << 127) - 1)
HEAD = 5  # a conversation begins with up to so many turns of another
BLOCK = 100  # whose id is the next lower multiple of this
NONE = bytes(16)
CHUNK = 1 << 15  # bytes of joined ids in a row


def packed(values: list[int]) -> pa.Array:
    return pa.array([v.to_bytes(16, "little") for v in values], pa.binary())


def number(b: bytes) -> int:
    return int.from_bytes(b, "little")


def sorted_turns(turns: DataFrame) -> DataFrame:
    """(part, conv_id, i, before, hash, chars): i and the hashes before and after the turn count from the first turn that a
    range of the sorted turns holds of its conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, i, power, total = TaskContext.get().partitionId(), None, 0, 1, 0
        for b in batches:
            at, before, after = [], [], []
            for c, d in zip(b.column("conv_id").to_pylist(), b.column("digest").to_pylist(), strict=True):
                if c != conv:
                    conv, i, power, total = c, 0, 1, 0
                i += 1
                at.append(i)
                before.append(total)
                total = (total + number(d[:16]) * power) % PRIME
                power = power * BASE % PRIME
                after.append(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), b.column("conv_id"), pa.array(at, pa.int64()), packed(before), packed(after), b.column("chars")], names=["part", "conv_id", "i", "before", "hash", "chars"])

    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # one conversation, and one turn of it, may have many rows
    rows = rows.repartitionByRange(partitions(turns.sparkSession), "conv_id", "turn", "digest", "row").sortWithinPartitions("conv_id", "turn", "digest", "row")
    return rows.select("conv_id", "digest", "chars").mapInArrow(run, "part int, conv_id long, i long, before binary, hash binary, chars long")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, i, before, hash, chars) of all turns, from a conversation's first one on."""
    local = written(sorted_turns(turns), "turns")
    last = F.max_by(F.struct("i", "hash"), F.struct("conv_id", "i"))
    parts = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), last.alias("end")).orderBy("part").collect()  # a row a range
    carry: dict[int, tuple[int, int, int]] = {}
    conv, n, total = None, 0, 0
    for p in parts:
        if p.first == conv:
            carry[p.part] = (conv, n, total)
        went_on = p.first == conv and p.first == p.last
        n0, total0 = (n, total) if went_on else (0, 0)
        conv, n, total = p.last, n0 + p.end.i, (total0 + pow(BASE, n0, PRIME) * number(p.end.hash)) % PRIME

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, conv, i = (b.column(c).to_numpy() for c in ("part", "conv_id", "i"))
            hashes = {c: b.column(c).to_pylist() for c in ("before", "hash")}
            i = i.copy()
            for p in np.unique(part).tolist():
                if p in carry:
                    own, n, total = carry[p]
                    power = pow(BASE, n, PRIME)
                    for k in np.flatnonzero((part == p) & (conv == own)).tolist():
                        i[k] += n
                        for c in hashes:
                            hashes[c][k] = ((total + power * number(hashes[c][k])) % PRIME).to_bytes(16, "little")
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(i), *(pa.array(hashes[c], pa.binary()) for c in ("before", "hash")), b.column("chars")], names=["conv_id", "i", "before", "hash", "chars"])

    return local.mapInArrow(run, "conv_id long, i long, before binary, hash binary, chars long")


def taken_over(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its block."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEAD + 1))


def node(hash_: Column, depth: Column) -> Column:
    return F.concat(hash_, F.unhex(F.lpad(F.hex(depth), 16, "0")))


ROOT = NONE + bytes(8)


def members(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, parent, depth, chars, conv_id, ends) for each turn of each rebuilt conversation; (conv_id, length) of those."""
    rows = written(numbered_turns(turns), "numbered-turns")
    head = F.struct("i", "before", "hash", "chars")
    convs = rows.groupBy("conv_id").agg(F.max("i").alias("n"), F.sort_array(F.collect_list(F.when(F.col("i") <= HEAD, head))).alias("own"))  # at most HEAD of a conversation
    convs = written(convs, "conversations")
    base = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("lent"))
    c = convs.withColumn("h", taken_over(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(BLOCK)))
    c = c.join(base, "base", "left").withColumn("lent", F.slice(F.coalesce("lent", F.expr("array()").cast(convs.schema["own"].dataType)), F.lit(1), F.col("h").cast("int")))
    c = c.withColumn("m", F.size("lent").cast("long")).withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    at = lambda list_, k: F.when(k > 0, F.try_element_at(list_, k.cast("int"))["hash"]).otherwise(F.lit(NONE))
    c = c.select("conv_id", "n", "h", "m", "length", "lent", at(F.col("own"), F.col("h")).alias("cut"), at(F.col("lent"), F.col("m")).alias("under"))
    c = written(c, "rebuilt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [pow(BASE, -k, PRIME) for k in range(HEAD + 1)]
        for b in batches:
            h, m, cut, under = (b.column(x).to_pylist() for x in ("h", "m", "cut", "under"))
            moved = lambda x: packed([(number(u) + powers[p - q] * (number(v) - number(w))) % PRIME for v, w, u, p, q in zip(b.column(x).to_pylist(), cut, under, h, m, strict=True)])  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("depth"), moved("before"), moved("hash"), b.column("chars"), b.column("length")], names=["conv_id", "depth", "before", "hash", "chars", "length"])

    own = rows.where(F.col("i") > taken_over(F.col("conv_id"))).join(c.where("n > h").drop("lent", "n"), "conv_id")
    own = own.select("conv_id", (F.col("m") + F.col("i") - F.col("h")).alias("depth"), "before", "hash", "chars", "h", "m", "cut", "under", "length").mapInArrow(run, "conv_id long, depth long, before binary, hash binary, chars long, length long")
    lent = c.select("conv_id", "length", F.explode("lent").alias("t")).select("conv_id", F.col("t.i").alias("depth"), "t.before", "t.hash", "t.chars", "length")
    out = own.unionByName(lent)
    out = out.select(node(F.col("hash"), F.col("depth")).alias("node"), node(F.col("before"), F.col("depth") - 1).alias("parent"), "depth", "chars", "conv_id", (F.col("depth") == F.col("length")).alias("ends"))
    return out, c.select("conv_id", "length")


def trie(turns: DataFrame) -> DataFrame:
    """(node, parent, depth, conv_id, n_convs, n_ends, n_children, n_single, parent_conv_id, saved, ends_sha256): all nodes. n_single:
    children of a single conversation."""
    rows, convs = members(turns)
    rows = written(rows, "members")
    end = lambda ends: (F.count_if(ends).alias("n_ends"), F.min(F.when(ends, F.col("conv_id"))).alias("end"))
    nodes = rows.groupBy("node", "parent", "depth").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("chars").alias("chars"), *end(F.col("ends")))
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), *end(F.col("length") == 0)).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "n_convs", "conv_id", F.lit(0).cast("long").alias("chars"), "n_ends", "end")
    nodes = written(nodes.unionByName(root), "nodes")
    kids = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("n_single"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ended = rows.where("ends").select("node", "conv_id").unionByName(convs.where("length = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
    many = joined_ids(ended.join(nodes.where("n_ends > 1").select("node"), "node", "left_semi"))
    out = nodes.join(kids, "node", "left").join(above, "parent", "left").join(many, "node", "left")
    sha = F.when(F.col("n_ends") > 1, F.col("sha256")).otherwise(F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")), 256))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
    return out.select("node", "parent", "depth", "conv_id", "n_convs", "n_ends", zero("n_children"), zero("n_single"), "parent_conv_id", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), sha.alias("ends_sha256"))


def joined_ids(ended: DataFrame) -> DataFrame:
    """(node, sha256) of each node's conv_ids, ascending and joined by commas. Ids are joined in rows of some bytes where they
    are sorted; the digest takes one after the other, so only these rows meet."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, held, size = None, 0, [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)])], names=["node", "first", "ids"])
        for b in batches:
            for n, c in zip(b.column("node").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if n != own or size > CHUNK:
                    if held:
                        yield row()
                    own, first, held, size = n, c, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array([sha.hexdigest()])], names=["node", "sha256"])
        for b in batches:
            for n, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if n != own:
                    if own is not None:
                        yield row()
                    own, sha = n, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
        if own is not None:
            yield row()

    n = partitions(ended.sparkSession)
    rows = ended.select("node", "conv_id").repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(join, "node binary, first long, ids string")
    return rows.repartition(n, "node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(digest, "node binary, sha256 string")


def contracted(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """shared: (node, parent, waits, leaves, saved), waits: children that have not reported. Of each node with exactly one
    of those, (node, bottom, leaves, saved): the nearest node below that has another number of them, and sums down to it.
    And of the others (node, up, leaves, saved, waits, up_leaves, up_saved): the node that waits for it, across the nodes with
    one child in between, whose sums are up_*."""
    runs = shared.where("waits = 1").select(F.col("node").alias("parent"), "leaves", "saved")
    runs = written(runs.join(shared.select("parent", F.col("node").alias("bottom")), "parent").withColumnRenamed("parent", "node"), "runs")
    tops = None
    if not runs.isEmpty():
        while True:
            below = runs.select(F.col("node").alias("bottom"), F.col("bottom").alias("next"), F.col("leaves").alias("l"), F.col("saved").alias("s"))
            zero = lambda x: F.coalesce(F.col(x), F.lit(0))
            longer = runs.join(below, "bottom", "left").select("node", F.coalesce("next", "bottom").alias("bottom"), (F.col("leaves") + zero("l")).alias("leaves"), (F.col("saved") + zero("s")).alias("saved"), F.col("next").isNotNull().alias("moved"))
            longer = written(longer, "runs")
            dropped(runs)
            runs, moved = longer.drop("moved"), not longer.where("moved").isEmpty()
            if not moved:
                break
        inner = shared.where("waits = 1").select(F.col("node").alias("parent"), F.lit(True).alias("inner"))
        tops = shared.select("node", "parent").join(runs, "node").join(inner, "parent", "left").where("inner is null")
        tops = tops.select(F.col("bottom").alias("node"), F.col("parent").alias("top_parent"), F.col("leaves").alias("up_leaves"), F.col("saved").alias("up_saved"), F.lit(True).alias("run"))
    rest = shared.where("waits <> 1")
    if tops is None:
        return runs, rest.select("node", F.col("parent").alias("up"), "leaves", "saved", "waits", F.lit(0).cast("long").alias("up_leaves"), F.lit(0).cast("long").alias("up_saved"))
    rest = rest.join(tops, "node", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
    return runs, rest.select("node", F.when(F.col("run"), F.col("top_parent")).otherwise(F.col("parent")).alias("up"), "leaves", "saved", "waits", zero("up_leaves"), zero("up_saved"))


def peeled(shared: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) of shared nodes."""
    runs, rest = contracted(shared)
    state, done = written(rest, "peeling"), None
    while not state.isEmpty():
        complete = state.where("waits = 0")
        total = complete.select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
        total = written(total, "peeled")
        done = total if done is None else done.unionByName(total)
        sent = complete.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("node")).agg(F.sum(F.col("leaves") + F.col("up_leaves")).alias("l"), F.sum(F.col("saved") + F.col("up_saved")).alias("s"), F.count(F.lit(1)).alias("k"))
        zero = lambda x: F.coalesce(F.col(x), F.lit(0))
        waiting = state.where("waits > 0").join(sent, "node", "left")
        waiting = waiting.select("node", "up", (F.col("leaves") + zero("l")).alias("leaves"), (F.col("saved") + zero("s")).alias("saved"), (F.col("waits") - zero("k")).alias("waits"), "up_leaves", "up_saved")
        waiting = written(waiting, "peeling")
        dropped(state)
        state = waiting
    if done is None:
        return shared.select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    ends = done.select(F.col("node").alias("bottom"), "n_leaves", "saved_tokens")
    inner = runs.join(ends, "bottom").select("node", (F.col("leaves") + F.col("n_leaves")).alias("n_leaves"), (F.col("saved") + F.col("saved_tokens")).alias("saved_tokens"))
    return done.unionByName(inner)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The contract's columns, a row a node."""
    nodes = written(trie(turns), "trie")
    many = (F.col("n_convs") > 1) | (F.col("depth") == 0)
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_single"))  # of those known without a round
    shared = nodes.where(many).select("node", "parent", (F.col("n_children") - F.col("n_single")).alias("waits"), leaves.cast("long").alias("leaves"), "saved")
    totals = peeled(written(shared, "shared"))
    out = nodes.join(totals, "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"), "ends_sha256")


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
b AS (SELECT *, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS bytes FROM t),
c AS (SELECT conv_id, own, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1))))) % 6 AS h FROM b),
r AS (SELECT c.conv_id, list_concat(coalesce(f.own, [])[1:c.h], c.own[c.h + 1:]) AS turns FROM c LEFT JOIN t f ON f.conv_id = c.conv_id - c.conv_id % 100),
m AS (SELECT conv_id, d AS depth, turns[1:d] AS prefix, len(turns) = d AS ends FROM r, unnest(range(0, len(turns) + 1)) x(d)),
n AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY prefix, depth),
k AS (SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * length(n.prefix[n.depth].text) END AS saved FROM n LEFT JOIN k ON n.depth = k.depth AND n.prefix = k.prefix),
s AS (SELECT a.prefix, a.depth, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves, sum(x.saved)::BIGINT AS saved_tokens FROM f a JOIN f x ON x.depth >= a.depth AND x.prefix[1:a.depth] = a.prefix GROUP BY ALL)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN s ON f.depth = s.depth AND f.prefix = s.prefix LEFT JOIN n p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.prefix = f.prefix[1:f.depth - 1]
"""
