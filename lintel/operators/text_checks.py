"""Checks over rows of text that need no syntax tree: lines, runs, repeats, literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import splitlines


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no from 1, line)."""
    return docs.select(key, F.posexplode(splitlines(F.col(text))).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_no"), "line")


def long_lines(rows: DataFrame, limit: int) -> DataFrame:
    """Lines over the limit, without comments and lines that hold a URL."""
    return rows.where((F.length("line") > limit) & ~F.ltrim("line").startswith("#") & ~F.col("line").rlike("https?://")).select("*", F.length("line").alias("length"))


def worst_line(rows: DataFrame, key: str) -> DataFrame:
    """The longest line of each key, the first of equals."""
    best = F.min_by(F.struct("line_no", F.length("line").alias("length")), F.struct(-F.length("line"), "line_no"))
    return rows.groupBy(key).agg(best.alias("w")).select(key, "w.line_no", "w.length")


def outside_quotes(rows: DataFrame, key: str, mark: str = '"""') -> DataFrame:
    """Lines with whether they lie outside quoted blocks: an even number of marks up to the line before."""
    marks = (F.length("line") - F.length(F.replace("line", F.lit(mark), F.lit("")))) / len(mark)
    before = F.coalesce(F.sum(marks.cast("long")).over(W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("outside", before % 2 == 0)


def repeated_blocks(rows: DataFrame, key: str, size: int = 3) -> DataFrame:
    """(hash, n, first_key, first_line): windows of `size` consecutive lines, white space aside, that occur twice or more."""
    w = W.partitionBy(key).orderBy("line_no")
    squeezed = F.regexp_replace(F.trim("line"), r"\s+", " ")
    parts = rows.withColumn("s", squeezed).where("s <> ''")
    parts = parts.select(key, "line_no", F.concat_ws("\n", *(F.lead("s", i).over(w) for i in range(size))).alias("block"), F.lead("s", size - 1).over(w).isNotNull().alias("whole"))
    hashed = parts.where("whole").select(F.left(F.sha2("block", 256), F.lit(16)).alias("hash"), key, "line_no")
    return hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(key, "line_no")).alias("f")).where("n >= 2").select("hash", "n", F.col(f"f.{key}").alias("first_key"), F.col("f.line_no").alias("first_line"))


def repeated_literals(docs: DataFrame, key: str, pattern: str, more_than: int, allowed: list[str], text: str = "text") -> DataFrame:
    """(literal, n): literals that stand in more than so many different keys. One row per key and literal is shuffled."""
    each = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("literal"))
    rows = each.where(~F.col("literal").isin(*allowed)) if allowed else each
    return rows.groupBy("literal").agg(F.count_distinct(key).alias("n")).where(F.col("n") > more_than)


def groups_of(rows: DataFrame, hash_: str, key: str, examples: int = 3) -> DataFrame:
    """(key, hash, n, others): members of every group of two or more, each with the first few other members.

    The first few are found by an aggregation and joined back, so a large group is never gathered."""
    ranked = rows.selectExpr(hash_, key, f"row_number() OVER (PARTITION BY `{hash_}` ORDER BY `{key}`) AS nth").where(F.col("nth") <= examples + 1)
    heads = ranked.groupBy(hash_).agg(F.array_sort(F.collect_list(key)).alias("heads"))
    sizes = rows.groupBy(hash_).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    out = rows.join(sizes, hash_).join(heads, hash_)
    return out.select(key, hash_, "n", F.slice(F.filter("heads", lambda h: h != F.col(key)), 1, examples).alias("others"))


def longest_runs(rows: DataFrame, key: str, order: str, hit: Column) -> DataFrame:
    """(key, run): the longest stretch of consecutive rows for which `hit` holds; keys without any are left out."""
    w = W.partitionBy(key).orderBy(order)
    marked = rows.withColumn("hit", hit)
    islands = marked.withColumn("island", F.row_number().over(w) - F.sum(F.col("hit").cast("int")).over(w)).where("hit")
    return islands.groupBy(key, "island").agg(F.count(F.lit(1)).alias("run")).groupBy(key).agg(F.max("run").alias("run"))


def share_of_top(rows: DataFrame, key: str, item: str, least: int, share: float) -> DataFrame:
    """(key, item, n, total): the most frequent item of a key (ties: the smaller) where it has over `share` of at least `least`."""
    per = rows.groupBy(key, item).agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy(key).agg(F.sum("n").alias("total"), F.min_by(F.struct(item, "n"), F.struct(-F.col("n"), F.col(item))).alias("t"))
    return top.where((F.col("total") >= least) & (F.col("t.n") / F.col("total") > share)).select(key, f"t.{item}", "t.n", "total")
