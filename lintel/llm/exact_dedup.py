"""Exact dedup by an extendible-hash index on shared files. DataFrame operations only.

The owner task of a hash value gathers the texts that have it in a chain, comparing whole texts byte by byte: equal
texts are one entry, which the map side has folded before, texts that only share the hash are entries of their own. A
directory over the top bits of the hash doubles until no bucket holds more than `bucket_rows` hashes; each bucket's entries
are written by its owner as files of the shared folder. Documents are resolved against those files: by the hash where
its chain has one entry (all texts of that hash are equal then, as the owner saw), else by comparing their bytes with each
entry of the chain.

Nulls count as the empty text. Texts of any length are compared whole. Rows that repeat a doc_id are counted as rows of
their own; they all carry kept if their id is the largest, and exact_dedup() leaves one of them. A null id loses to any
other; a group of null ids only keeps them. Other columns are not read, so their names cannot clash. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, one_row_each, partitions, scratch, table, written


def directory(prefixes: dict[int, int], bits: int, bucket_rows: int) -> list[int]:
    """Bucket number of every directory slot. prefixes: entries by the top `bits` bits of the hash."""
    depth, total = 0, [sum(prefixes.values())]
    while depth < bits and max(total) > bucket_rows:  # doubling: each slot splits in two
        depth += 1
        total = [0] * (1 << depth)
        for p, n in prefixes.items():
            total[p >> (bits - depth)] += n
    slots, bucket, at = [0] * (1 << depth), 0, 0
    while at < len(slots):  # slots that share a bucket: the widest aligned run that still fits
        width = 1
        while at % (width * 2) == 0 and at + width * 2 <= len(slots) and sum(total[at : at + width * 2]) <= bucket_rows:
            width *= 2
        slots[at : at + width] = [bucket] * width
        at, bucket = at + width, bucket + 1
    return slots


def hashed(norm: Column) -> Column:
    return F.xxhash64(norm)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 1 << 14, bits: int = 16, hash_of=hashed) -> DataFrame:
    """Writes the index; returns its entries (h, pos, norm where a chain has several, text_sha256, keep_id, group_size, bucket).

    bits bounds the directory (2^bits slots), and so what reaches the driver; a slot that is still too full there splits on by
    the bits that follow, by as many as its own count needs."""
    spark = docs.sparkSession
    norm = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm")).withColumn("h", hash_of(F.col("norm")))
    top = F.shiftrightunsigned("h", 64 - bits)
    seen = {r.p: r.n for r in norm.select("h").distinct().groupBy(top.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = directory(seen, bits, bucket_rows)
    depth = len(slots).bit_length() - 1
    held: dict[int, int] = {}
    for p, n in seen.items():
        held[slots[p >> (bits - depth)]] = held.get(slots[p >> (bits - depth)], 0) + n
    more = [max(0, -(-held.get(b, 0) // bucket_rows) - 1).bit_length() for b in range(max(slots) + 1)]
    split = max(more)
    # the owner of a hash chains the texts that have it: a set, into which a text goes if no other has the same bytes
    chains = norm.groupBy("h").agg(F.collect_set("norm").alias("chain"), F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).withColumn("single", F.size("chain") == 1)
    slot_of = F.shiftrightunsigned("h", 64 - depth).cast("int") if depth else F.lit(0)
    owners = spark.sql("SELECT pos AS slot, CAST(split_part(col, ':', 1) AS INT) AS owner, CAST(split_part(col, ':', 2) AS INT) AS more FROM (SELECT posexplode(split('{}', ',')))".format(",".join(f"{b}:{more[b]}" for b in slots)))
    rest = F.shiftrightunsigned("h", 64 - depth - split).bitwiseAND((1 << split) - 1) if split else F.lit(0).cast("long")
    bucket = F.col("owner").cast("long") * (1 << split) + F.expr(f"shiftrightunsigned(rest, {split} - more)")
    entries = chains.select("h", "single", "keep_id", "group_size", slot_of.alias("slot"), rest.alias("rest"), F.posexplode("chain").alias("pos", "norm"))
    entries = entries.select("h", "pos", F.when(~F.col("single"), F.col("norm")).alias("norm"), F.sha2("norm", 256).alias("text_sha256"), F.when(F.col("single"), F.col("keep_id")).alias("keep_id"), F.when(F.col("single"), F.col("group_size")).alias("group_size"), "slot", "rest")
    path, count = scratch(spark, "hash-index"), len({(b, k) for b in set(slots) for k in range(1 << more[b])})
    entries = entries.join(F.broadcast(owners), "slot").withColumn("bucket", bucket).drop("slot", "rest", "owner", "more")
    entries.repartition(min(count, 4 * partitions(spark)), "bucket").sortWithinPartitions("bucket", "h", "pos").write.partitionBy("bucket").parquet(path)
    return spark.read.schema("h long, pos int, norm string, text_sha256 string, keep_id long, group_size long, bucket long").parquet(path)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 1 << 14, hash_of=hashed) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = build_index(docs, id_col, text_col, bucket_rows, hash_of=hash_of).drop("bucket")
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(F.col(id_col).alias("doc_id"), norm.alias("own"))
    # a chain of one: its owner has compared all texts of that hash, so the hash alone finds the entry
    one = keyed.select("doc_id", hash_of(F.col("own")).alias("h")).join(index.where("norm IS NULL").drop("norm", "pos"), "h").drop("h")
    longer = index.where("norm IS NOT NULL").select("h", "pos", "norm", "text_sha256")
    if not longer.head(1):
        found = one
    else:  # texts of different bytes under one hash: the documents are compared with the entries of the chain
        met = written(keyed.withColumn("h", hash_of(F.col("own"))).join(longer, "h").where("own = norm").select("doc_id", "h", "pos", "text_sha256"), "chained")
        sums = met.groupBy("h", "pos").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = one.unionByName(met.join(sums, ["h", "pos"]).drop("h", "pos"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with its own columns: one that has the group's largest id."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select("doc_id", F.col("text_sha256").alias("h"), F.col("text_sha256").alias("group"))
    return one_row_each(docs, kept, "group", id_col, F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))


def op9_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g USING (norm)
"""
