"""Scores of candidates for tables of queries: term matches, families' weights, the unified score, expansion and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import lexical
from sextant.model import KIND_BOOST, lookup
from sextant.operators.text import BROADCAST_TERMS, ndcg

# The weights of the unified score, whether walks, overlaps of names and specificity count, and the results of a file, by family.
WEIGHT_NAMES = ["bm25_w", "cov_w", "name_w", "walk_w", "overlap_gate", "overlap_w", "walks", "by_overlap", "specific", "per_file"]
FAMILY_WEIGHTS = {
    "symbol-exact": (5.0, 0.8, 1.0, 0.5, 0.4, 1.5, False, True, False, 3),
    "symbol-partial": (4.5, 1.0, 1.2, 0.8, 0.3, 1.8, True, True, False, 3),
    "file-path": (3.0, 1.5, 0.8, 0.3, 0.5, 1.0, False, False, False, 5),
    "error-debug": (3.5, 1.5, 1.5, 1.2, 0.25, 2.0, True, True, True, 3),
    "nl-descriptive": (3.0, 1.5, 2.0, 1.0, 0.25, 2.0, True, True, True, 3),
    "nl-abstract": (2.5, 2.0, 1.5, 1.5, 0.2, 2.0, True, True, True, 2),
    "cross-cutting": (2.0, 2.0, 1.0, 1.5, 0.3, 1.5, True, False, True, 1),
    "relationship": (3.0, 1.5, 1.0, 2.0, 0.3, 1.5, True, False, True, 3),
}
# Kinds of edges that seeds follow, the families that take further seeds, and the factors of 0 to 5 channels that agree.
SEED_KINDS = {"error-debug": ["shares_error_type"], "cross-cutting": ["shares_type", "shares_data_shape"], "nl-abstract": ["shares_error_type", "shares_type", "shares_data_shape"], "nl-descriptive": ["shares_error_type", "shares_type", "shares_data_shape"], "relationship": ["shares_type", "shares_error_type"]}
SEED_FAMILIES = ["nl-abstract", "nl-descriptive", "error-debug", "cross-cutting"]
AGREEMENT = [0.9, 0.95, 1.05, 1.12, 1.18, 1.22]
# Tags of an edge's direction and kind.
MIX_TAGS = {"out_calls": "caller-of", "in_calls": "called-by", "out_contains": "contains", "in_contains": "contained-in", "out_references": "refs", "in_references": "refd-by", "out_implements": "implements", "in_implements": "impld-by", "out_extends": "extends", "in_extends": "extended-by", "out_imports": "imports", "in_imports": "imported-by", "out_tests": "tests", "out_shares_type": "shares-type", "out_shares_error_type": "shares-err-type", "out_shares_data_shape": "shares-data"}


def query_terms(queries: DataFrame, idf: DataFrame) -> DataFrame:
    """query_id, place, term, variants and idf (1 for unknown terms) of queries (query_id, query); a term that occurs again counts again."""
    terms = queries.select("query_id", F.posexplode(lexical.extract_terms(F.col("query"))).alias("place", "term"))
    found = terms.join(idf.select("term", "idf"), "term", "left")
    return found.select("query_id", "place", "term", lexical.variants(F.col("term")).alias("variants"), F.coalesce("idf", F.lit(1.0)).alias("idf"))


def term_matches(asked: DataFrame, words: DataFrame) -> DataFrame:
    """query_id, place, nth (of the variant), idf, term and ratio: the distinct terms of words that equal a variant (1), hold it or lie in it (the shorter
    length by the longer). Only distinct terms are looked at, with the variants broadcast in blocks of some BROADCAST_TERMS."""
    variants = asked.select("query_id", "place", "idf", F.posexplode("variants").alias("nth", "variant"))
    blocks = -(-variants.count() // BROADCAST_TERMS) or 1
    vocabulary = words.select("term").distinct()
    held = F.contains("term", F.col("variant")) | F.contains("variant", F.col("term"))
    parts = [vocabulary.join(F.broadcast(variants.filter(F.pmod(F.xxhash64("variant"), F.lit(blocks)) == i)), held) for i in range(blocks)]
    a, b = F.octet_length("term"), F.octet_length("variant")
    return reduce(DataFrame.unionByName, parts).select("query_id", "place", "nth", "idf", "term", (F.least(a, b) / F.greatest(a, b)).alias("ratio"))


def term_scores(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """query_id, place, id and score: idf times the best weight times ratio that a query's term has in a set of (id, term, w)."""
    best = F.max(F.col("w") * F.col("ratio")) * F.first("idf")
    return sets.join(term_matches(asked, sets), "term").groupBy("query_id", "place", "id").agg(best.alias("score")).filter("score > 0")


def coverage(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """query_id, id, score (sum over the query's terms) and matched terms."""
    return term_scores(asked, sets).groupBy("query_id", "id").agg(F.sum("score").alias("score"), F.count("*").alias("matched"))


def name_scores(asked: DataFrame, names: DataFrame, equal: float = 3.0, held: float = 2.0, several: float = 1.0) -> DataFrame:
    """query_id, id, score and matched of names (id, term): for each term its variants in order, up to the first that a name has: equal * idf for that, held * idf
    * the best ratio for those before it. With two matches or more the score is multiplied by several."""
    each = names.select("id", "term").distinct().join(term_matches(asked, names), "term").groupBy("query_id", "place", "id", "nth").agg(F.max("ratio").alias("ratio"), F.first("idf").alias("idf"))
    until = F.min(F.when(F.col("ratio") == 1, F.col("nth"))).over(Window.partitionBy("query_id", "place", "id"))
    counted = each.withColumn("_until", until).filter("_until IS NULL OR nth <= _until")
    part = F.col("idf") * F.when(F.col("ratio") == 1, equal).otherwise(held * F.col("ratio"))
    out = counted.groupBy("query_id", "id").agg(F.sum(part).alias("score"), F.count("*").alias("matched"))
    return out.withColumn("score", F.col("score") * F.when(F.col("matched") >= 2, several).otherwise(1.0))


def alias_scores(asked: DataFrame, aliases: DataFrame, collisions: DataFrame) -> DataFrame:
    """name_scores with 2 and 1 and half as much again for two matches, of the ids in collisions only."""
    return name_scores(asked, aliases.join(collisions.select("id").distinct(), "id", "left_semi"), 2.0, 1.0, 1.5)


def neighbour_scores(asked: DataFrame, neighbours: DataFrame) -> DataFrame:
    """query_id, id and score: idf once for each term of which a neighbour's term (id, term) equals a variant."""
    variants = asked.select("query_id", "place", "idf", F.explode("variants").alias("term"))
    hits = neighbours.select("id", "term").distinct().join(variants, "term").groupBy("query_id", "place", "id").agg(F.first("idf").alias("idf"))
    return hits.groupBy("query_id", "id").agg(F.sum("idf").alias("score"))


def test_penalty(path: Column) -> Column:
    return F.when(lexical.any_of(F.lower(path), ["/test", "_test.", "/benches/", "/spec/"]), 0.3).otherwise(1.0)


def family_weights(family: Column) -> list[Column]:
    """The parameters of a family, as columns."""
    return [lookup({k: v[i] for k, v in FAMILY_WEIGHTS.items()}, family, FAMILY_WEIGHTS["nl-descriptive"][i]).alias(n) for i, n in enumerate(WEIGHT_NAMES)]


def unified_score(candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, id, score and rank of candidates (query_id, family, id, kind, path, is_seed, walked, bm25, coverage, covered, name_score, walk, overlap,
    neighbour, alias); rows that are no seeds and weren't walked to, or have no positive score, go."""
    of_query = asked.groupBy("query_id").agg(F.sum("idf").alias("_idf"), F.count("*").alias("_n"), F.avg((F.col("idf") > 1).cast("double")).alias("_special"))
    rows = candidates.filter("is_seed OR walked").join(of_query, "query_id", "left").na.fill({"_idf": 0.0, "_n": 0, "_special": 0.0})
    rows = rows.select("*", *family_weights(F.col("family")))
    share = lambda c: F.when(F.col("_idf") > 0, F.col(c) / F.col("_idf")).otherwise(0.0)
    boost = lambda c, least, by: F.when(F.col(c) / F.greatest("_idf", F.lit(1e-10)) > least, by * F.col(c) / F.greatest("_idf", F.lit(1e-10))).otherwise(0.0)
    adjust = lambda w, by: F.col(w) * F.when(F.col("specific"), 1 + by * F.col("_special")).otherwise(1.0)
    seed = adjust("bm25_w", -0.3) * F.col("bm25") + adjust("cov_w", 0.5) * F.least(share("coverage"), F.lit(0.4)) + F.col("name_w") * F.least(share("name_score"), F.lit(0.5))
    base = F.when(F.col("is_seed"), seed).otherwise(1.5 * share("coverage") + 2.0 * share("name_score") + F.col("walk_w") * share("walk"))
    excess = (F.col("overlap") - F.col("overlap_gate")) / (1 - F.col("overlap_gate"))
    overlap = F.when(F.col("by_overlap") & (F.col("overlap") > F.col("overlap_gate")), F.col("overlap_w") * F.col("_special") * excess).otherwise(0.0)
    near = F.when(F.col("walks"), boost("neighbour", 0.1, 0.5)).otherwise(0.0)
    covered = F.pow(F.when(F.col("_n") > 0, F.col("covered") / F.col("_n")).otherwise(0.0), F.lit(0.3))
    score = (base + overlap + near + boost("alias", 0.15, 1.0)) * covered * F.when(F.col("is_seed"), 1.15).otherwise(1.0) * lookup(KIND_BOOST, F.col("kind"), 1.0) * test_penalty(F.col("path"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return rows.select("query_id", "id", F.round(score, 9).alias("score")).filter("score > 0").withColumn("rank", rank)


def seed_gates(family: Column) -> list[Column]:
    """Whether a family takes seeds by term, by edge, by number and by source scan."""
    further = family.isin(SEED_FAMILIES)
    return [further.alias("by_term"), further.alias("by_edge"), further.alias("by_number"), (family == "error-debug").alias("by_source")]


def edge_seeds(seeds: DataFrame, edges: DataFrame, first: int = 30, each: int = 30, most: int = 50) -> DataFrame:
    """query_id, id, score and rank: what the `first` best seeds (query_id, family, id, score) lead to by their family's kinds, `each` edges a seed
    (lowest targets first), without seeds; weights of 0.1 at least are summed."""
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    kinds = lookup({k: ",".join(v) for k, v in SEED_KINDS.items()}, F.col("family"), "")
    start = seeds.withColumns({"_place": best, "_kinds": F.split(kinds, ",")}).filter(F.col("_place") <= first).select("query_id", F.col("id").alias("source_id"), F.explode("_kinds").alias("kind"))
    met = start.join(edges.select("source_id", "target_id", "kind", "weight"), ["source_id", "kind"])
    order = F.row_number().over(Window.partitionBy("query_id", "source_id").orderBy("target_id", "kind"))
    met = met.withColumn("_nth", order).filter(F.col("_nth") <= each).select("query_id", F.col("target_id").alias("id"), F.greatest("weight", F.lit(0.1)).alias("w"))
    new = met.join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti").groupBy("query_id", "id").agg(F.round(F.sum("w"), 9).alias("score"))
    return new.withColumn("rank", best).filter(F.col("rank") <= most)


def with_fallback(every: DataFrame, some: DataFrame, content: DataFrame, most: int) -> DataFrame:
    """query_id, id, score and rank: the hits with every term; where they are fewer than 30 (three content tokens or more) or 10, also those with some
    term that aren't among them. All are (query_id, id, score); content: query_id, tokens."""
    few = content.join(every.groupBy("query_id").agg(F.count("*").alias("_n")), "query_id", "left").filter(F.coalesce("_n", F.lit(0)) < F.when(F.col("tokens") >= 3, 30).otherwise(10))
    more = some.join(few.select("query_id"), "query_id", "left_semi").join(every.select("query_id", "id"), ["query_id", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return every.select("query_id", "id", "score").unionByName(more.select("query_id", "id", "score")).withColumn("rank", rank).filter(F.col("rank") <= most)


def agreement(*channels: Column) -> Column:
    """The factor by the number of channels that found a result (null: not found)."""
    n = reduce(lambda a, b: a + b, [F.coalesce(c.cast("int"), F.lit(0)) for c in channels])
    return F.element_at(F.array(*map(F.lit, AGREEMENT)), F.least(n, F.lit(5)) + 1)


def confidence(seed: Column, channels: Column, covered: Column, named: Column, linked: Column) -> Column:
    """0.3 of the seed's strength, 0.2 of five channels, 0.2 of the coverage, and 0.15 each for a name and a path; 1 at most."""
    bonus = F.when(named, 0.15).otherwise(0.0) + F.when(linked, 0.15).otherwise(0.0)
    return F.least(seed * 0.3 + F.least(channels / 5, F.lit(1.0)) * 0.2 + covered * 0.2 + bonus, F.lit(1.0))


def negentropy(channels: Column) -> Column:
    """ln n less the entropy of an array's shares, and 0.3 times its excess kurtosis where that is positive."""
    n = F.size(channels)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    whole = F.greatest(total(channels), F.lit(1e-15))
    entropy = total(F.transform(channels, lambda x: F.when(x / whole > 1e-15, -(x / whole) * F.log(x / whole)).otherwise(0.0)))
    mean = whole / n
    variance = total(F.transform(channels, lambda x: F.pow(x - mean, 2))) / n
    kurtosis = F.when(variance > 1e-15, total(F.transform(channels, lambda x: F.pow((x - mean) / F.sqrt(variance), 4))) / n - 3).otherwise(0.0)
    return F.log(n) - entropy + 0.3 * F.greatest(kurtosis, F.lit(0.0))


def result_roles(edges: DataFrame) -> DataFrame:
    """id, callers, callees, members and role of the ends of edges."""
    one = lambda side, kind, name: edges.filter(F.col("kind") == kind).groupBy(F.col(side).alias("id")).agg(F.count("*").alias(name))
    counts = one("target_id", "calls", "callers").join(one("source_id", "calls", "callees"), "id", "full").join(one("source_id", "contains", "members"), "id", "full").na.fill(0)
    i, o = F.col("callers"), F.col("callees")
    role = F.when(i >= 10, "hub").when((i >= 3) & (o >= 3), "bridge").when((i > 0) & (o > 0), "connector").when(F.col("members") > 0, "container").otherwise("")
    return counts.withColumn("role", role)


def edge_mix(edges: DataFrame, most: int = 4) -> DataFrame:
    """id and tags: the most frequent directions and kinds of a symbol's edges (ties by label), with -heavy beyond three edges and -xN beyond one."""
    side = lambda name, way: edges.groupBy(F.col(name).alias("id"), F.concat(F.lit(way), "kind").alias("label")).agg(F.count("*").alias("n"))
    counts = side("source_id", "out_").unionByName(side("target_id", "in_"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "label"))
    short = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), MIX_TAGS.items(), F.col("label"))
    tag = F.when(F.col("n") > 3, F.concat(short, F.lit("-heavy"))).when(F.col("n") > 1, F.concat(short, F.lit("-x"), F.col("n").cast("string"))).otherwise(short)
    top = counts.withColumn("place", place).filter(F.col("place") <= most).withColumn("tag", tag)
    return top.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "tag"))), lambda x: x["tag"]), " ").alias("tags"))


def ideal_relevance(relevance: DataFrame, symbols: DataFrame) -> DataFrame:
    """query_id, place (from 1) and grade: each grade of (query_id, name, grade) once for each symbol of that name, best first."""
    n = symbols.groupBy("name").agg(F.count("*").cast("int").alias("_n"))
    rows = relevance.join(n, "name").select("query_id", "grade", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return rows.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"))).alias("place"), "grade")


def ndcg_report(ranked: DataFrame, relevance: DataFrame, categories: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """category, queries and the mean NDCG at each k; categories: query_id, category."""
    out = categories
    for k in ks:
        out = out.join(ndcg(ranked, relevance, k).withColumnRenamed("ndcg", f"ndcg{k}"), "query_id", "left")
    return out.groupBy("category").agg(F.count("*").alias("queries"), *[F.avg(F.coalesce(f"ndcg{k}", F.lit(0.0))).alias(f"ndcg{k}") for k in ks])
