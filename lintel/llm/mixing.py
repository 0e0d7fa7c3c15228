"""Mixing sources to target weights by Poisson replication. DataFrame operations only.

Every source gets a mean repetition rate (target share x output size / its documents). A document's count is the
inverse Poisson distribution at uniforms hashed from (seed, doc_id, part): a rate above 16 is cut into equal parts
whose counts add up, so any rate works. Each document is exploded by its count and the copies are dealt to
partitions and sorted there by a hash of (seed, doc_id, copy), which is a global shuffle that a rerun repeats. The
rates of up to `SOURCES` sources go to every worker, so that the documents are shuffled once; those of more are
joined by shuffle, where skewed sources are split at run time.

A null source is a source of its own. Where no source of the table has a weight above 0 the result is empty; negative weights
raise. Texts of any length are carried whole. An empty table gives an empty result. Rows that repeat a doc_id get equal counts. Documents with null ids share one
uniform. The input's columns come back as they were; ours begin with `prefix` and do not clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, partitions, table, written

PART, TERMS, SOURCES = 16.0, 81, 10_000  # P(count > 80 | mean 16) < 2^-52, the grain of a uniform


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, source_col: str = "source") -> DataFrame:
    """(src, rate, parts, cdf) by source. weights: target shares (default: equal); size: output rows over input rows."""
    if any(not 0 <= v < float("inf") for v in (weights or {}).values()):
        raise ValueError("weights must be finite and not negative")
    n = docs.groupBy(F.col(source_col).alias("src")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        share = F.lit(1.0)
    else:
        share = F.lit(0.0)
        for k, v in weights.items():
            share = F.when(F.col("src") == k, float(v)).otherwise(share)
    n = n.withColumn("share", share)
    total = n.agg(F.sum("n").alias("rows"), F.sum("share").alias("shares"))
    rate = F.when(F.col("shares") > 0, F.col("share") / F.nullif("shares", F.lit(0.0)) * F.col("rows") * float(size) / F.col("n")).otherwise(0.0)
    one = n.join(F.broadcast(total)).select("src", rate.alias("rate"), F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int").alias("parts")).withColumn("mean", F.col("rate") / F.col("parts"))
    step = lambda a, k: F.struct((a.p * F.col("mean") / k).alias("p"), F.concat(a.cdf, F.array(F.element_at(a.cdf, -1) + a.p * F.col("mean") / k)).alias("cdf"))
    first = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))
    return one.select("src", "rate", "parts", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), first, step, lambda a: a.cdf).alias("cdf"))


def uniform(*parts: Column) -> Column:
    """52 bits of a digest, in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", prefix: str = "mix_") -> DataFrame:
    """docs' columns plus {prefix}copy (from 1), {prefix}copies, {prefix}rate, {prefix}key; in shuffled order. A name that docs
    has gets underscores after it until it is new."""
    c = lambda x: fresh(docs, f"{prefix}{x}")
    rates = source_rates(docs, weights, size, source_col).select(*(F.col(x).alias(c(x)) for x in ("src", "rate", "parts", "cdf")))
    rates = written(rates, "rates")
    if rates.count() <= SOURCES:  # a checked size: about 700 bytes a source
        rates = F.broadcast(rates)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    drawn = F.transform(F.sequence(F.lit(1), F.col(c("parts"))), lambda i: uniform(F.lit(str(seed)), ident, i.cast("string")))  # each digest once
    count = F.aggregate(F.transform(drawn, lambda u: F.size(F.filter(F.col(c("cdf")), lambda x: x <= u))), F.lit(0), lambda a, x: a + x)
    out = docs.join(rates, F.col(source_col).eqNullSafe(F.col(c("src")))).withColumn(c("copies"), count).where(F.col(c("copies")) > 0)
    out = out.withColumn(c("copy"), F.explode(F.sequence(F.lit(1), F.col(c("copies")))))
    out = out.withColumn(c("key"), F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), ident, F.col(c("copy")).cast("string"))))
    out = out.select(*(F.col(f"`{x}`") for x in docs.columns), *(F.col(c(x)) for x in ("copy", "copies", "rate", "key")))
    return out.repartition(partitions(docs.sparkSession), c("key")).sortWithinPartitions(c("key"))


def op8_source_mixing(spark, sf_dir):
    out = poisson_mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", F.col("mix_copy").alias("copy"), F.col("mix_copies").alias("copies"), F.round("mix_rate", 9).alias("rate"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.col("mix_key").alias("shuffle_key"))


SQL = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM n) * 1.0 / (SELECT count(*) FROM n) / n AS rate FROM n),
m AS (SELECT source, rate, greatest(ceil(rate / 16), 1)::INT AS parts, rate / greatest(ceil(rate / 16), 1) AS mean FROM r),
c AS (SELECT m.source, rate, parts, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY m.source ORDER BY k) AS cdf FROM m, range(0, 81) t(k)),
l AS (SELECT source, any_value(rate) AS rate, any_value(parts) AS parts, list(cdf) AS cdf FROM c GROUP BY source),
u AS (SELECT d.doc_id, d.text, l.source, rate, cdf, ('0x' || substr(md5('7:' || d.doc_id || ':' || i), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source, unnest(range(1, l.parts + 1)) t(i)),
k AS (SELECT doc_id, text, source, rate, sum(len(list_filter(cdf, lambda x: x <= u))) AS copies FROM u GROUP BY ALL)
SELECT doc_id, source, x.copy::INT AS copy, copies::INT AS copies, round(rate, 9) AS rate, sha256(coalesce(text, '')) AS text_sha256, md5('7/order:' || doc_id || ':' || x.copy) AS shuffle_key
FROM k, unnest(range(1, copies::BIGINT + 1)) x(copy)
"""
