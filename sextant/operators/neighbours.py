"""What a symbol's neighbours say: walks from seeds, terms and signatures of neighbours, bridging, counts of paths. Where a neighbourhood is bounded, the
neighbours come in the order of their ids and kinds of edges, outgoing ones first, so that results are the same in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.model import WALK_WEIGHT, lookup
from sextant.operators import graph


def numbered(edges: DataFrame) -> DataFrame:
    """id, other, kind, way (0: out, 1: in) and nth of the ends of all edges, numbered for each id and way."""
    out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "kind", F.lit(0).alias("way"))
    back = edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "kind", F.lit(1).alias("way"))
    return out.unionByName(back).withColumn("nth", F.row_number().over(Window.partitionBy("id", "way").orderBy("other", "kind")))


def gated(asked: DataFrame, scores: DataFrame) -> DataFrame:
    """query_id, id and covered (sum of the scores) of the ids that hold a term of at least the upper median idf of their query."""
    middle = asked.groupBy("query_id").agg(F.sort_array(F.collect_list("idf")).alias("i")).select("query_id", F.get("i", F.floor(F.size("i") / 2).cast("int")).alias("least"))
    special = F.bool_or(F.col("idf") >= F.col("least"))
    met = scores.join(asked.select("query_id", "place", "idf"), ["query_id", "place"]).join(middle, "query_id").groupBy("query_id", "id")
    return met.agg(F.sum("score").alias("covered"), special.alias("special")).filter("special").drop("special")


def walk(edges: DataFrame, seeds: DataFrame, asked: DataFrame, scores: DataFrame, starts: int = 8, each: int = 10, onward: int = 6, most: int = 25) -> DataFrame:
    """query_id, id, evidence and from_seeds: what two hops from the first `starts` seeds (query_id, id, by id) reach.

    asked: query_id, place, idf; scores: query_id, place, id, score of term_scores. A node counts where a term of at least the query's upper median idf occurs
    in it; its evidence is its coverage times a half for each hop times the least weight of the edges. The first hop takes `each` edges out and
    in, the second the first `onward` of a node, each node is met once from a seed, and the first `most` nodes of a seed count.
    """
    able = gated(asked, scores)
    start = seeds.select("query_id", "id").distinct().withColumn("_s", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).filter(F.col("_s") <= starts).select("query_id", F.col("id").alias("seed"))
    links = numbered(edges).withColumn("weight", lookup(WALK_WEIGHT, F.col("kind"), 0.5)).drop("kind")
    from_seed = ["query_id", "seed"]

    def first_met(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_m", F.row_number().over(Window.partitionBy(*from_seed, "id").orderBy("at"))).filter("_m = 1").drop("_m")

    one = start.join(links.filter(F.col("nth") <= each), F.col("seed") == F.col("id")).select(*from_seed, F.col("other").alias("id"), "weight", F.struct(F.lit(1).alias("hop"), F.col("way").alias("a"), F.col("nth").alias("b"), F.lit(0).alias("c")).alias("at"))
    one = first_met(one.filter("id <> seed"))
    good = one.join(able, ["query_id", "id"])
    place = F.row_number().over(Window.partitionBy(*from_seed).orderBy("at"))
    onwards = numbered(edges).withColumns({"weight": lookup(WALK_WEIGHT, F.col("kind"), 0.5), "n": F.row_number().over(Window.partitionBy("id").orderBy("way", "nth"))}).filter(F.col("n") <= onward)
    parents = good.select(*from_seed, F.col("id").alias("_p"), F.col("weight").alias("_w"), place.alias("_at"))
    two = parents.join(onwards.select(F.col("id").alias("_p"), F.col("other").alias("id"), "weight", "n"), "_p").filter("id <> seed").join(one.select(*from_seed, "id"), [*from_seed, "id"], "left_anti")
    two = first_met(two.select(*from_seed, "id", F.least("weight", "_w").alias("weight"), F.struct(F.lit(2).alias("hop"), F.col("_at").alias("a"), F.col("n").alias("b"), F.lit(0).alias("c")).alias("at")))
    met = good.unionByName(two.join(able, ["query_id", "id"])).withColumn("_n", place).filter(F.col("_n") <= most)
    evidence = F.col("covered") * F.pow(F.lit(0.5), F.col("at.hop")) * F.col("weight")
    return met.groupBy("query_id", "id").agg(F.sum(evidence).alias("evidence"), F.count("*").alias("from_seeds"))


def neighbour_terms(edges: DataFrame, sets: DataFrame, each: int = 30, terms: int = 10) -> DataFrame:
    """id and term: the first `terms` terms (in order) of the first `each` neighbours out and in; sets: id, term."""
    some = sets.select(F.col("id").alias("other"), "term").withColumn("_t", F.row_number().over(Window.partitionBy("other").orderBy("term"))).filter(F.col("_t") <= terms)
    return numbered(edges).filter(F.col("nth") <= each).join(some, "other").select("id", "term").distinct()


def bridging(edges: DataFrame, sets: DataFrame, each: int = 20) -> DataFrame:
    """id and potential of the sources of edges: the share of the terms of the first `each` targets that aren't its own, times 1 + 0.3 ln(2 + targets)."""
    own = sets.select("id", "term", F.lit(1).alias("_own"))
    out = numbered(edges).filter("way = 0")
    met = out.filter(F.col("nth") <= each).join(sets.select(F.col("id").alias("other"), "term"), "other").join(own, ["id", "term"], "left")
    share = met.groupBy("id").agg((1 - F.count("_own") / F.count("*")).alias("_share"))
    n = out.groupBy("id").agg(F.count("*").alias("_n"))
    return n.join(share, "id", "left").select("id", (F.coalesce("_share", F.lit(0.0)) * (1 + 0.3 * F.log(2 + F.col("_n")))).alias("potential"))


def signatures(edges: DataFrame, words: DataFrame, n: DataFrame, each: int = 12, most: int = 15) -> DataFrame:
    """id and signature: the words of three bytes or more of the first `each` neighbours out and in with the largest sums of ln(1 + n / (df + 1)), without those of
    30 in 100 names or more; words: id, word (repeated where it is); n: one row with the number of symbols n."""
    df = words.distinct().groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).filter(F.col("df") < F.floor(F.col("n") * 0.3))
    known = words.filter(F.octet_length("word") >= 3).join(df.select("word", F.log(1 + F.col("n") / (F.col("df") + 1)).alias("idf")), "word").withColumnRenamed("id", "other")
    sums = numbered(edges).filter(F.col("nth") <= each).join(known, "other").groupBy("id", "word").agg(F.round(F.sum("idf"), 6).alias("s"))
    top = sums.withColumn("p", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "word"))).filter(F.col("p") <= most)
    return top.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "word"))), lambda x: x["word"]), " ").alias("signature"))


def path_counts(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """start, id and paths: how often an edge from a node nearer than depth leads from each start (id) to another node."""
    near = graph.bounded_bfs(edges, starts, depth - 1).select("start", "id", "distance") if depth > 1 else None
    origin = starts.select(F.col("id").alias("start"), "id").distinct()
    inner = origin if near is None else origin.unionByName(near.select("start", "id").distinct())
    step = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("_to"))
    return inner.join(step, "id").filter("_to <> start").groupBy("start", F.col("_to").alias("id")).agg(F.count("*").alias("paths"))
