"""Ranked text search over tables of queries: postings, weighted BM25, seeds, substring baseline, scoring, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Rows of a table of query terms that are broadcast.
BROADCAST_TERMS = 100_000
# Weights of the text columns for names and for questions.
NAME_WEIGHTS = {"name": 10.0, "name_decomposed": 8.0, "qualified_name": 6.0, "signature": 4.0, "source": 1.0, "doc_comment": 3.0, "file_path": 3.5, "kind": 0.5, "language": 0.5, "search_hints": 5.0}
QUESTION_WEIGHTS = {"name": 3.0, "name_decomposed": 4.0, "qualified_name": 2.0, "signature": 5.0, "source": 8.0, "doc_comment": 6.0, "file_path": 4.0, "kind": 0.5, "language": 0.5, "search_hints": 10.0}


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def postings(docs: DataFrame, columns: dict[str, float]) -> DataFrame:
    """id, term and weighted term frequency of the documents (id and text columns)."""
    parts = [docs.select("id", F.explode(terms(F.col(c))).alias("term"), F.lit(w).alias("w")) for c, w in columns.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("id", "term").agg(F.sum("w").alias("tf"))


def bm25(post: DataFrame, queries: DataFrame, n_docs: DataFrame, k: int) -> DataFrame:
    """query_id, id, score and rank: the k best documents of each query (query_id, term); n_docs: one row n.

    Only postings of the queries' terms are scored; lengths come from one aggregate of all postings.
    """
    length = post.groupBy("id").agg(F.sum("tf").alias("len"))
    mean = length.agg(F.avg("len").alias("mean"))
    asked = queries.select("query_id", "term").distinct()
    hits = post.join(asked.select("term").distinct(), "term")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(n_docs)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = hits.join(length, "id").join(idf, "term").crossJoin(F.broadcast(mean))
    part = part.withColumn("part", F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean"))))
    scored = part.join(asked, "term").groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def inverse_frequency(sets: DataFrame) -> DataFrame:
    """term and ln(1 + n / (df + 1)) of sets (id, term)."""
    n = sets.agg(F.count_distinct("id").alias("n"))
    return sets.groupBy("term").agg(F.count_distinct("id").alias("df")).crossJoin(F.broadcast(n)).select("term", "df", F.log(1 + F.col("n") / (F.col("df") + 1)).alias("idf"))


def top_terms(sets: DataFrame, k: int = 30) -> DataFrame:
    """The k terms of highest tf * idf of each id of (id, term, tf); tf stays as it is."""
    weighted = sets.join(inverse_frequency(sets), "term")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round(F.col("tf") * F.col("idf"), 9)), "term"))
    return weighted.withColumn("place", place).filter(F.col("place") <= k)


def substring_search(symbols: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The baseline: for each term of two bytes or more 3 for an equal name, 2.5 for a name that starts with it, 2 for one that holds it and 1 for one
    that holds its parts between underscores in this order; and 0.5 for each of its words of two bytes or more that the source holds."""
    asked = queries.select("query_id", F.lower("term").alias("t")).filter(F.octet_length("t") >= 2)
    parts = F.filter(F.split("t", "_"), lambda x: x != "")
    quoted = F.transform(parts, lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E")))
    asked = asked.withColumn("pattern", F.concat(F.lit("(?s)"), F.array_join(quoted, ".*")))
    words = F.filter(F.split("t", r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) >= 2)
    asked = F.broadcast(asked.withColumn("words", words)) if asked.count() <= BROADCAST_TERMS else asked.withColumn("words", words)
    t, n, text = F.col("t"), F.lower("name"), F.lower("source")
    in_name = F.when(n == t, 3.0).when(F.startswith(n, t), 2.5).when(F.contains(n, t), 2.0).when(F.regexp_like(n, F.col("pattern")), 1.0).otherwise(0.0)
    in_source = 0.5 * F.size(F.filter("words", lambda w: F.contains(text, w)))
    hits = symbols.select("id", "name", "source").join(asked, (in_name + in_source) > 0).withColumn("s", in_name + in_source)
    out = hits.groupBy("query_id", "id").agg(F.sum("s").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def lock_first(scored: DataFrame, seeds: DataFrame, query_terms: DataFrame, gap: float = 1.2, lift: float = 1e6) -> DataFrame:
    """scored (query_id, id, name, score) with rank: where the best seed (query_id, id, score) is more than `gap` times as good as the second and its
    name holds a term of the query, it comes first with its score lifted, unless it is first anyway."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    two = seeds.withColumns({"_place": F.row_number().over(order), "_next": F.lead("score").over(order)})
    sure = two.filter((F.col("_place") == 1) & (F.col("score") / F.greatest("_next", F.lit(1e-10)) > gap)).select("query_id", F.col("id").alias("_lock"))
    ranked = scored.withColumn("_at", F.row_number().over(order))
    locked = ranked.join(sure, ["query_id"]).filter((F.col("id") == F.col("_lock")) & (F.col("_at") > 1))
    named = locked.join(query_terms, "query_id").filter(F.contains(F.lower("name"), F.col("term"))).select("query_id", "id").distinct().withColumn("_lifted", F.lit(True))
    out = ranked.join(named, ["query_id", "id"], "left").withColumn("score", F.col("score") + F.when(F.col("_lifted"), lift).otherwise(0.0))
    return out.withColumn("rank", F.row_number().over(order)).drop("_at", "_lifted")


def promote_exact(scored: DataFrame, asked: DataFrame) -> DataFrame:
    """scored (query_id, id, name, score) with rank: names equal to the query (query_id, query) in any case come first, with the best one's score plus 1, or 10."""
    rows = scored.join(asked, "query_id").withColumn("_exact", F.lower("name") == F.lower("query"))
    best = F.max(F.when(F.col("_exact"), F.col("score"))).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("score", F.when(F.col("_exact"), F.greatest(F.col("score"), best + 1, F.lit(10.0))).otherwise(F.col("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_exact"), F.desc("score"), "id"))
    return rows.withColumn("rank", rank).drop("_exact", "query")


def first_stage(hits: DataFrame) -> DataFrame:
    """query_id, id, stage and score: of the seeds of several stages (query_id, stage, id, score), those of the first stage that found an id, at their best."""
    return hits.groupBy("query_id", "id").agg(F.min("stage").alias("stage"), F.min_by("score", F.struct("stage", -F.col("score"))).alias("score"))


def merge_tracks(hits: DataFrame) -> DataFrame:
    """query_id, id and score of the hits of several tracks (query_id, track, id, score): the best, 1 + 0.3 (c - 1) times for c >= 2 hits, 0.85 times
    for one of four tracks or more; with five tracks or more, two hits are needed."""
    tracks = hits.groupBy("query_id").agg(F.count_distinct("track").alias("tracks"))
    found = hits.groupBy("query_id", "id").agg(F.max("score").alias("s"), F.count("*").alias("c")).join(F.broadcast(tracks) if tracks.count() <= BROADCAST_TERMS else tracks, "query_id")
    c, few = F.col("c"), F.col("tracks") >= 4
    factor = F.when(c >= 2, 1 + 0.3 * (c - 1)).when(few, 0.85).otherwise(1.0)
    return found.filter((c >= 2) | (F.col("tracks") < 5)).select("query_id", "id", (F.col("s") * factor).alias("score"))


def cap_per_file(scored: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id", "file_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("in_file", place).filter(F.col("in_file") <= most)


def dampen(scored: DataFrame, factor: float = 0.85) -> DataFrame:
    """Scores times factor for each better result of the same file."""
    place = F.row_number().over(Window.partitionBy("query_id", "file_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("damped", F.col("score") * F.pow(F.lit(factor), place - 1))


def ndcg(ranked: DataFrame, relevance: DataFrame, k: int, first_undiscounted: bool = False) -> DataFrame:
    """query_id and ndcg of ranked (query_id, id, rank from 1) against relevance (query_id, id, grade)."""
    discount = lambda r: F.when(r == 1, 1.0).otherwise(F.log2(r)) if first_undiscounted else F.log2(r + 1)
    dcg = ranked.filter(F.col("rank") <= k).join(relevance, ["query_id", "id"]).groupBy("query_id").agg(F.sum(F.col("grade") / discount(F.col("rank"))).alias("dcg"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "id"))
    ideal = relevance.withColumn("place", best).filter(F.col("place") <= k).groupBy("query_id").agg(F.sum(F.col("grade") / discount(F.col("place"))).alias("ideal"))
    return ideal.join(dcg, "query_id", "left").select("query_id", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def reciprocal_rank(ranked: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """query_id, rr, hit1 and precision at k."""
    good = relevance.filter("grade > 0").select("query_id", "id", F.lit(1).alias("good"))
    first = ranked.filter(F.col("rank") <= k).join(good, ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("first"), F.count("*").alias("found"))
    return ranked.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), F.coalesce((F.col("first") == 1).cast("int"), F.lit(0)).cast("long").alias("hit1"), (F.coalesce("found", F.lit(0)) / F.lit(float(k))).alias("precision"))
