"""Joins of the indexer: enclosing spans, last container, token chains, bounded pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a bucket of the range join.
BUCKET = 64


def enclosing(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """call_id and symbol_id: the shortest span of the call's file that holds its line.

    A span is copied into each bucket of lines that it touches, so the range join is an equi-join on file and bucket.
    """
    spans = symbols.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("line_start") / BUCKET), F.floor(F.col("line_end") / BUCKET))))
    met = calls.withColumn("bucket", F.floor(F.col("line") / BUCKET)).join(spans, ["file_id", "bucket"]).filter(F.col("line").between(F.col("line_start"), F.col("line_end")))
    best = met.groupBy("call_id").agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "line_start", "id")).alias("b"))
    return best.select("call_id", F.col("b.id").alias("symbol_id"))


def last_container(symbols: DataFrame, kinds: list[str]) -> DataFrame:
    """Adds container: the last symbol of these kinds at or before a symbol, in the order of its file."""
    w = Window.partitionBy("file_id").orderBy("line_start", "id").rowsBetween(Window.unboundedPreceding, 0)
    return symbols.withColumn("container", F.last(F.when(F.col("kind").isin(kinds), F.col("id")), ignorenulls=True).over(w))


def token_chains(tokens: DataFrame, least: int, most: int) -> DataFrame:
    """id, next, token and weight: each symbol linked with the next one that has the token, for tokens of least to most symbols."""
    n = tokens.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n").between(least, most))
    total = tokens.agg(F.count_distinct("id").alias("all"))
    chained = tokens.join(n, "token").withColumn("next", F.lead("id").over(Window.partitionBy("token").orderBy("id"))).filter("next IS NOT NULL")
    weight = F.least(0.15 * F.greatest(F.log(F.col("all") / F.col("n")), F.lit(0.1)), F.lit(0.40))
    return chained.crossJoin(F.broadcast(total)).select("id", "next", "token", weight.alias("weight"))


def bounded_pairs(members: DataFrame, most: int) -> DataFrame:
    """literal, a, b: the first `most` pairs (by a, then b) of the symbols that share a literal; part of the operator's meaning.

    Only the first members can be in these pairs, so a group is cut to most + 1 rows before it is joined with itself.
    """
    place = F.row_number().over(Window.partitionBy("literal").orderBy("id"))
    m = members.withColumn("p", place).filter(F.col("p") <= most + 1)
    pairs = m.select("literal", F.col("id").alias("a")).join(m.select("literal", F.col("id").alias("b")), "literal").filter("a < b")
    return pairs.withColumn("r", F.row_number().over(Window.partitionBy("literal").orderBy("a", "b"))).filter(F.col("r") <= most).drop("r")


def path_similarity(a: Column, b: Column) -> Column:
    """Leading components in common, as a share of the longer path."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    common = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, v: F.struct((s["n"] + (s["go"] & v).cast("int")).alias("n"), (s["go"] & v).alias("go")), lambda s: s["n"])
    return common / F.greatest(F.size(x), F.size(y))


def resolve(calls: DataFrame, names: DataFrame) -> DataFrame:
    """caller, target, local: each call's first symbol of that name in its file, else anywhere; self-calls go."""
    own = names.groupBy("callee", "file_id").agg(F.min("id").alias("own"))
    any_ = names.groupBy("callee").agg(F.min("id").alias("any"))
    out = calls.join(own, ["callee", "file_id"], "left").join(any_, "callee", "left")
    return out.select("caller", F.coalesce("own", "any").alias("target"), F.col("own").isNotNull().alias("local")).filter("target <> caller")


def directory_key(path: Column) -> Column:
    """The parent directory, or its parent where the directory is deeper than two slashes."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.array_join(F.slice(parts, F.lit(1), F.when(n - 2 <= 2, n - 1).otherwise(n - 2)), "/")
