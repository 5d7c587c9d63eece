"""Queries of the scores of candidates, seeds and reports, with the DuckDB SQL of the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sextant import model
from sextant.functions import lexical
from sextant.model import read
from sextant.operators import neighbours, scoring, text
from sextant.plans.lookups import _PART_SQL, _parts
from sextant.plans.registry import _REL_SQL, _S, _frames, _ranked, _relevance, _values, _values_sql, query

ASKED = [(0, "smallRings and red widgets"), (1, "the widgeting of promo parts"), (2, "economy brand brand#17"), (3, "standards green"), (4, "unknown_thing medium rod"), (5, "large"), (6, "")]
FAMILIES = list(scoring.FAMILY_WEIGHTS)
_FAMILY_OF = {i: FAMILIES[(i + 3) % len(FAMILIES)] for i, _ in ASKED}
_STOPS = "[" + ", ".join(f"'{w}'" for w in lexical.STOP_WORDS) + "]"


def _terms_sql(q: str) -> str:
    spaced = f"regexp_replace(regexp_replace(regexp_replace({q}, '[^A-Za-z0-9]+', ' ', 'g'), '([a-z][0-9]*)([A-Z])', '\\1 \\2', 'g'), '([A-Z0-9])([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_filter(regexp_split_to_array(lower({q}), '\\s+') || string_split(trim(regexp_replace(lower({spaced}), ' +', ' ', 'g')), ' '), lambda t: strlen(t) >= 2 AND NOT list_contains({_STOPS}, t))"


def _variants_sql(t: str) -> str:
    cut = lambda end, least, more: f"CASE WHEN ends_with({t}, '{end}') AND length({t}) > {least} THEN left({t}, length({t}) - {len(end)}) || '{more}' END"
    plural = f"CASE WHEN ends_with({t}, 'ies') AND length({t}) > 4 THEN left({t}, length({t}) - 3) || 'y' WHEN ends_with({t}, 'es') AND length({t}) > 3 THEN left({t}, length({t}) - 2) WHEN ends_with({t}, 's') AND length({t}) > 3 THEN left({t}, length({t}) - 1) END"
    more = [plural, cut("ing", 5, ""), cut("ing", 5, "e"), cut("ed", 4, ""), cut("tion", 3, "te"), cut("ment", 5, "")]
    return f"list_sort(list_distinct(list_filter([{t}, {', '.join(more)}], lambda x: x IS NOT NULL)))"


def _asked_sql(queries: list[tuple]) -> str:
    """idfs, qt (terms of the queries) and vs (their variants), by the table sets."""
    return f""", idfs AS (SELECT term, ln(1 + (SELECT count(DISTINCT id) FROM sets) / (count(*) + 1)) AS idf FROM sets GROUP BY term),
ask AS (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS place FROM (SELECT query_id, {_terms_sql('query')} AS ts FROM {_values_sql('query_id, query', queries)})),
qt AS (SELECT query_id, place, term, {_variants_sql('ask.term')} AS variants, coalesce(idf, 1.0)::DOUBLE AS idf FROM ask LEFT JOIN idfs USING (term)),
qv AS (SELECT query_id, place, idf, unnest(variants) AS v, generate_subscripts(variants, 1) AS nth FROM qt),
vs AS (SELECT *, strlen(v) AS n FROM qv)"""


_SETS_SQL = f""", names AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(lower(p_name), ' ')) AS term FROM part),
near AS (SELECT p_partkey AS id, lower(p_type) AS term FROM part),
sets AS (SELECT id, term, max(w) AS w FROM (SELECT id, term, 3.0::DOUBLE AS w FROM names UNION ALL SELECT id, term, 2.0 FROM near UNION ALL SELECT p_partkey, lower(p_brand), 1.0 FROM part) GROUP BY ALL)""" + _asked_sql(ASKED)


def _held_sql(table: str) -> str:
    return f"FROM {table} s JOIN vs ON contains(s.term, v) OR contains(v, s.term)"


_RATIO = "least(n, strlen(s.term)) / greatest(n, strlen(s.term))"
_TERM_SQL = f", ts AS (SELECT query_id, place, id, max(w * {_RATIO}) * any_value(idf) AS score {_held_sql('sets')} GROUP BY ALL)"
_COVER_SQL = _TERM_SQL + ", cover AS (SELECT query_id, id, sum(score) AS score, count(*) AS matched FROM ts GROUP BY ALL)"


def _names_sql(table: str, equal: float, held: float, out: str) -> str:
    return f""", {out}_e AS (SELECT query_id, place, id, nth, any_value(idf) AS idf, max({_RATIO}) AS ratio {_held_sql(table)} GROUP BY ALL),
{out}_f AS (SELECT query_id, place, id, min(nth) AS upto FROM {out}_e WHERE ratio = 1 GROUP BY ALL),
{out} AS (SELECT query_id, id, sum(e.idf * CASE WHEN ratio = 1 THEN {equal} ELSE {held} * ratio END) AS score, count(*) AS matched FROM {out}_e e LEFT JOIN {out}_f f USING (query_id, place, id) WHERE upto IS NULL OR nth <= upto GROUP BY ALL)"""


def _asked(spark, sf_dir):
    """Terms of the searches, and sets, names and neighbours' terms of the parts."""
    p = read(spark, sf_dir, "part")
    names = p.select(F.col("p_partkey").alias("id"), F.explode(F.split(F.lower("p_name"), " ")).alias("term")).distinct()
    one = lambda c: p.select(F.col("p_partkey").alias("id"), F.lower(c).alias("term"))
    rows = names.withColumn("w", F.lit(3.0)).unionByName(one("p_type").withColumn("w", F.lit(2.0))).unionByName(one("p_brand").withColumn("w", F.lit(1.0)))
    sets = rows.groupBy("id", "term").agg(F.max("w").alias("w"))
    asked = scoring.query_terms(_values(spark, "query_id, query", ASKED), text.inverse_frequency(sets.select("id", "term")))
    return asked, sets, names, one("p_type")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"SELECT doc_id, len(ts) AS n_terms, md5(array_to_string(ts, ' ')) AS digest FROM (SELECT doc_id, {_terms_sql('text')} AS ts FROM documents)", False)
def sf02_extract_terms(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("doc_id", lexical.extract_terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(_SETS_SQL + " SELECT query_id, place::INT AS place, term, array_to_string(variants, ' ') AS variants, round(idf, 6) AS idf FROM qt")
def tx22_query_terms(spark, sf_dir):
    return _rounded(_asked(spark, sf_dir)[0], "idf").withColumn("variants", F.array_join("variants", " "))


@query(_SETS_SQL + _COVER_SQL + " SELECT query_id, id, round(score, 6) AS score, matched FROM cover")
def tx24_coverage(spark, sf_dir):
    asked, sets, *_ = _asked(spark, sf_dir)
    return _rounded(scoring.coverage(asked, sets), "score")


@query(_SETS_SQL + _names_sql("names", 3.0, 2.0, "nm") + " SELECT query_id, id, round(score, 6) AS score, matched FROM nm")
def tx25_name_coverage(spark, sf_dir):
    asked, _, names, _ = _asked(spark, sf_dir)
    return _rounded(scoring.name_scores(asked, names), "score")


@query(_SETS_SQL + " SELECT query_id, id, round(sum(idf), 6) AS score FROM (SELECT DISTINCT query_id, place, id, idf FROM near JOIN qv ON v = near.term) GROUP BY ALL")
def tx26_neighbour_match(spark, sf_dir):
    asked, _, _, near = _asked(spark, sf_dir)
    return _rounded(scoring.neighbour_scores(asked, near), "score")


@query(_SETS_SQL + ", al AS (SELECT * FROM names WHERE id IN (SELECT p_partkey FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) >= 3)))" + _names_sql("al", 2.0, 1.0, "am") + " SELECT query_id, id, round(score * CASE WHEN matched >= 2 THEN 1.5 ELSE 1 END, 6) AS score, matched FROM am")
def tx27_alias_match(spark, sf_dir):
    asked, _, names, _ = _asked(spark, sf_dir)
    p = read(spark, sf_dir, "part")
    often = p.groupBy("p_name").agg(F.count("*").alias("n")).filter("n >= 3")
    return _rounded(scoring.alias_scores(asked, names, p.join(often, "p_name", "left_semi").select(F.col("p_partkey").alias("id"))), "score")


@query(_SETS_SQL + _TERM_SQL + " SELECT query_id, place::INT AS place, id, round(score, 6) AS score FROM ts")
def tx28_term_match(spark, sf_dir):
    asked, sets, *_ = _asked(spark, sf_dir)
    return _rounded(scoring.term_scores(asked, sets), "score")


_FAMILY_SQL = "CASE c.query_id " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in _FAMILY_OF.items()) + " END"
_WEIGHTS_SQL = _values_sql("family, " + ", ".join(scoring.WEIGHT_NAMES), [(k, *map(float, v)) for k, v in scoring.FAMILY_WEIGHTS.items()])


@query(_SETS_SQL + _COVER_SQL + _names_sql("names", 3.0, 2.0, "nm") + f"""
, ca AS (SELECT c.query_id, c.id, {_FAMILY_SQL} AS family, c.score AS cov, c.matched, coalesce(m.score, 0) AS nm, c.id % 3 <> 0 AS seed, c.id % 5 <> 0 AS walked, (c.id % 17) / 17 AS bm, (c.id % 5) / 4 AS walk, (c.id % 11) / 10 AS ov, (c.id % 4) / 2 AS nb, (c.id % 6) / 3 AS al,
  CASE c.id % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'struct' ELSE 'macro' END AS kind, CASE c.id % 7 WHEN 0 THEN 'src/test/a.rs' ELSE 'src/a.rs' END AS path FROM cover c LEFT JOIN nm m USING (query_id, id)),
s AS (SELECT query_id, sum(idf) AS si, count(*) AS n, avg((idf > 1)::INT) AS sp FROM qt GROUP BY 1),
j AS (SELECT * FROM ca JOIN s USING (query_id) JOIN {_WEIGHTS_SQL} w USING (family) WHERE seed OR walked),
b AS (SELECT query_id, id, matched, n, seed, kind, path,
  CASE WHEN seed THEN bm25_w * (1 - 0.3 * specific * sp) * bm + cov_w * (1 + 0.5 * specific * sp) * least(cov / si, 0.4) + name_w * least(nm / si, 0.5) ELSE 1.5 * cov / si + 2 * nm / si + walk_w * walk / si END
  + CASE WHEN by_overlap = 1 AND ov > overlap_gate THEN overlap_w * sp * (ov - overlap_gate) / (1 - overlap_gate) ELSE 0 END + CASE WHEN walks = 1 AND nb / si > 0.1 THEN 0.5 * nb / si ELSE 0 END + CASE WHEN al / si > 0.15 THEN al / si ELSE 0 END AS base FROM j),
r AS (SELECT query_id, id, base * pow(matched / n, 0.3) * CASE WHEN seed THEN 1.15 ELSE 1 END * CASE kind WHEN 'function' THEN 1.3 WHEN 'struct' THEN 1.2 ELSE 1 END * CASE WHEN contains(path, '/test') THEN 0.3 ELSE 1 END AS score FROM b)
SELECT query_id, id, round(score, 6)::DOUBLE AS score FROM r WHERE score > 0""")
def tx31_unified_score(spark, sf_dir):
    """All candidates of the searches; evidence other than coverage and names is made from ids."""
    asked, sets, names, _ = _asked(spark, sf_dir)
    n = scoring.name_scores(asked, names).select("query_id", "id", F.col("score").alias("name_score"))
    c = scoring.coverage(asked, sets).select("query_id", "id", F.col("score").alias("coverage"), F.col("matched").alias("covered")).join(n, ["query_id", "id"], "left").na.fill(0.0, ["name_score"])
    of = lambda m, d: (F.col("id") % m) / d
    rest = {"family": model.lookup(_FAMILY_OF, F.col("query_id"), "nl-descriptive"), "is_seed": F.col("id") % 3 != 0, "walked": F.col("id") % 5 != 0, "bm25": of(17, 17), "walk": of(5, 4), "overlap": of(11, 10), "neighbour": of(4, 2), "alias": of(6, 3)}
    rest |= {"kind": F.element_at(F.array(F.lit("function"), F.lit("struct"), F.lit("macro")), (F.col("id") % 3 + 1).cast("int")), "path": F.when(F.col("id") % 7 == 0, "src/test/a.rs").otherwise("src/a.rs")}
    return _rounded(scoring.unified_score(c.withColumns(rest), asked), "score").drop("rank")


@query(_PART_SQL + " SELECT id, CASE WHEN regexp_matches(lower(path), '/test|_test[.]|/benches/|/spec/') THEN 0.3 ELSE 1.0 END::DOUBLE AS penalty FROM pt")
def tx34_test_penalty(spark, sf_dir):
    return _parts(spark, sf_dir).select("id", scoring.test_penalty(F.col("path")).alias("penalty"))


_SEED_SQL = f", se AS (SELECT c_nationkey AS query_id, ({FAMILIES})[c_nationkey % 8 + 1] AS family, 3000000 + c_custkey AS id, c_acctbal AS score FROM customer)"
_SHARES = {"references": "shares_type", "implements": "shares_error_type", "extends": "shares_data_shape"}


def _seeds(spark, sf_dir):
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("c_nationkey") % 8 + 1).cast("int"))
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query_id"), family.alias("family"), (F.col("c_custkey") + 3_000_000).alias("id"), F.col("c_acctbal").alias("score"))


_KINDS_SQL = " UNION ALL ".join(f"SELECT '{f}' AS family, '{k}' AS kind" for f, ks in scoring.SEED_KINDS.items() for k in ks)


@query(_SEED_SQL + f""", ed AS (SELECT source_id, target_id, {model.sql_case(_SHARES, 'kind', 'kind')} AS kind, weight FROM edges),
st AS (SELECT * FROM se QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 30),
hit AS (SELECT st.query_id, e.target_id AS id, greatest(e.weight, 0.1) AS w FROM st JOIN ({_KINDS_SQL}) k USING (family) JOIN ed e ON e.source_id = st.id AND e.kind = k.kind QUALIFY row_number() OVER (PARTITION BY st.query_id, e.source_id ORDER BY e.target_id, e.kind) <= 30),
g AS (SELECT query_id, id, round(sum(w), 9) AS score FROM hit ANTI JOIN se USING (query_id, id) GROUP BY ALL)
SELECT query_id, id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM g QUALIFY rank <= 50""")
def tx12_edge_seeds(spark, sf_dir):
    edges = _frames(spark, sf_dir)[2].withColumn("kind", F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in _SHARES.items()], F.col("kind")))
    return _rounded(scoring.edge_seeds(_seeds(spark, sf_dir), edges), "score")


@query(_SEED_SQL + " SELECT id, family, family IN ('nl-abstract', 'nl-descriptive', 'error-debug', 'cross-cutting') AS by_term, family IN ('nl-abstract', 'nl-descriptive', 'error-debug', 'cross-cutting') AS by_edge, family IN ('nl-abstract', 'nl-descriptive', 'error-debug', 'cross-cutting') AS by_number, family = 'error-debug' AS by_source FROM se")
def tx13_seed_gates(spark, sf_dir):
    return _seeds(spark, sf_dir).select("id", "family", *scoring.seed_gates(F.col("family")))


@query(_SEED_SQL + """, ev AS (SELECT * FROM se WHERE score > 100 * (50 + query_id * 3)), ct AS (SELECT DISTINCT query_id, 2 + query_id % 2 AS tokens FROM se),
fw AS (SELECT ct.query_id FROM ct LEFT JOIN ev USING (query_id) GROUP BY ct.query_id, tokens HAVING count(ev.id) < CASE WHEN tokens >= 3 THEN 30 ELSE 10 END),
al AS (SELECT query_id, id, score FROM ev UNION ALL SELECT query_id, id, score / 2 FROM se SEMI JOIN fw USING (query_id) ANTI JOIN ev USING (query_id, id) WHERE score > 0)
SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM al QUALIFY rank <= 200""")
def st02_and_or_merge(spark, sf_dir):
    s = _seeds(spark, sf_dir)
    content = s.select("query_id", (F.col("query_id") % 2 + 2).alias("tokens")).distinct()
    some = s.filter("score > 0").withColumn("score", F.col("score") / 2)
    return scoring.with_fallback(s.filter("score > 100 * (50 + query_id * 3)"), some, content, 200)


@query("SELECT c_custkey AS id, ([0.9, 0.95, 1.05, 1.12, 1.18, 1.22])[((c_custkey & 1) + (c_custkey >> 1 & 1) + (c_custkey >> 2 & 1) + (c_custkey >> 3 & 1) + (c_custkey >> 4 & 1))::INT + 1]::DOUBLE AS factor FROM customer", False)
def tx37_channel_agreement(spark, sf_dir):
    bits = [F.shiftright("c_custkey", i).bitwiseAND(F.lit(1)) == 1 for i in range(5)]
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), scoring.agreement(*bits).alias("factor"))


@query(r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: t <> '') AS ts FROM conversations)
SELECT conv_id, turn, len(ts) >= 3 AND len(list_filter(ts, lambda t: (contains(t, '_') AND strlen(t) > 4) OR contains(t, '::') OR regexp_matches(t, '\p{Lu}.*\p{Lu}'))) = 0 AND len(list_filter(ts, lambda t: strlen(t) <= 3)) / greatest(len(ts), 1) < 0.5 AS is_question FROM t""", False)
def tx38_question_test(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", lexical.is_question(F.col("text")).alias("is_question"))


@query("SELECT c_custkey AS id, round(least(0.3 * (c_custkey % 10) / 9 + 0.2 * least((c_custkey % 7) / 5, 1) + 0.2 * (c_custkey % 4) / 3 + CASE WHEN c_nationkey % 2 = 0 THEN 0.15 ELSE 0 END + CASE WHEN c_nationkey % 3 = 0 THEN 0.15 ELSE 0 END, 1), 6)::DOUBLE AS confidence FROM customer", False)
def sv17_confidence(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return read(spark, sf_dir, "customer").select(k.alias("id"), F.round(scoring.confidence(k % 10 / 9, k % 7, k % 4 / 3, n % 2 == 0, n % 3 == 0), 6).alias("confidence"))


_CHANNELS = "[" + ", ".join(f"((p_partkey * {i + 3} + p_size) % {7 + 4 * i})::DOUBLE" for i in range(7)) + "]"


@query(f"""WITH c AS (SELECT p_partkey AS id, {_CHANNELS} AS x FROM part), s AS (SELECT id, x, greatest(list_sum(x), 1e-15) AS t FROM c),
u AS (SELECT id, t, unnest(x) AS v FROM s), m AS (SELECT id, sum(CASE WHEN v / t > 1e-15 THEN -(v / t) * ln(v / t) ELSE 0 END) AS h, sum(pow(v - t / 7, 2)) / 7 AS va, sum(pow(v - t / 7, 4)) / 7 AS q FROM u GROUP BY id)
SELECT id, round(ln(7) - h + 0.3 * greatest(CASE WHEN va > 1e-15 THEN q / (va * va) - 3 ELSE 0 END, 0), 5) AS negentropy FROM m""", False)
def gr31_negentropy(spark, sf_dir):
    x = F.array(*[((F.col("p_partkey") * (i + 3) + F.col("p_size")) % (7 + 4 * i)).cast("double") for i in range(7)])
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(scoring.negentropy(x), 5).alias("negentropy"))


@query(", i AS (SELECT target_id AS id, count(*) AS n FROM edges WHERE kind = 'calls' GROUP BY 1), o AS (SELECT source_id AS id, count(*) AS n FROM edges WHERE kind = 'calls' GROUP BY 1), m AS (SELECT source_id AS id, count(*) AS n FROM edges WHERE kind = 'contains' GROUP BY 1), k AS (SELECT id FROM i UNION SELECT id FROM o UNION SELECT id FROM m), c AS (SELECT k.id, coalesce(i.n, 0) AS callers, coalesce(o.n, 0) AS callees, coalesce(m.n, 0) AS members FROM k LEFT JOIN i USING (id) LEFT JOIN o USING (id) LEFT JOIN m USING (id)) SELECT *, CASE WHEN callers >= 10 THEN 'hub' WHEN callers >= 3 AND callees >= 3 THEN 'bridge' WHEN callers > 0 AND callees > 0 THEN 'connector' WHEN members > 0 THEN 'container' ELSE '' END AS role FROM c")
def tx51_result_roles(spark, sf_dir):
    return scoring.result_roles(_frames(spark, sf_dir)[2])


_MIX = reduce(lambda c, kv: f"replace({c}, '{kv[0]}', '{kv[1]}')", scoring.MIX_TAGS.items(), "label")


@query(f", l AS (SELECT source_id AS id, 'out_' || kind AS label FROM edges UNION ALL SELECT target_id, 'in_' || kind FROM edges), g AS (SELECT id, label, count(*) AS n FROM l GROUP BY ALL), p AS (SELECT id, n, {_MIX} AS short, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS place FROM g QUALIFY place <= 4) SELECT id, string_agg(CASE WHEN n > 3 THEN short || '-heavy' WHEN n > 1 THEN short || '-x' || n ELSE short END, ' ' ORDER BY place) AS tags FROM p GROUP BY id")
def gr22_edge_mix(spark, sf_dir):
    return scoring.edge_mix(_frames(spark, sf_dir)[2])


@query(", r AS (SELECT DISTINCT p_size % 5 AS query_id, p_name AS name, (length(p_name) % 4)::BIGINT AS grade FROM part) SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY grade DESC))::INT AS place, grade FROM r JOIN symbols s ON s.name = r.name")
def tx55_ideal_relevance(spark, sf_dir):
    r = read(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("query_id"), F.col("p_name").alias("name"), (F.length("p_name") % 4).cast("long").alias("grade")).distinct()
    return scoring.ideal_relevance(r, _frames(spark, sf_dir)[1])


@query(_REL_SQL + ", rd AS (SELECT query_id, k, sum(grade / log2(rank + 1)) AS dcg FROM ranked JOIN rel USING (query_id, id), (VALUES (3), (5), (10)) t(k) WHERE rank <= k GROUP BY ALL), ri AS (SELECT query_id, k, sum(grade / log2(p + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS p FROM rel), (VALUES (3), (5), (10)) t(k) WHERE p <= k GROUP BY ALL), v AS (SELECT query_id, k, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END AS x FROM ri LEFT JOIN rd USING (query_id, k))" + f" SELECT 'group ' || (q.query_id % 2) AS category, count(DISTINCT q.query_id) AS queries, round(avg(coalesce(x, 0)) FILTER (k = 3), 6) AS ndcg3, round(avg(coalesce(x, 0)) FILTER (k = 5), 6) AS ndcg5, round(avg(coalesce(x, 0)) FILTER (k = 10), 6) AS ndcg10 FROM (SELECT DISTINCT query_id FROM {_S}) q JOIN v USING (query_id) GROUP BY 1")
def tx48_ndcg_report(spark, sf_dir):
    rel = _relevance(spark, sf_dir)
    groups = rel.select("query_id").distinct().withColumn("category", F.concat(F.lit("group "), (F.col("query_id") % 2).cast("string")))
    return _rounded(scoring.ndcg_report(_ranked(spark, sf_dir), rel, groups), "ndcg3", "ndcg5", "ndcg10")


_NUMBERED_SQL = """, lk AS (SELECT source_id AS id, target_id AS other, kind, 0 AS way FROM edges UNION ALL SELECT target_id, source_id, kind, 1 FROM edges),
nb AS (SELECT *, row_number() OVER (PARTITION BY id, way ORDER BY other, kind) AS nth FROM lk), nt AS (SELECT DISTINCT id, unnest(string_split(lower(name), ' ')) AS term FROM symbols)"""


def _name_words(spark, sf_dir):
    return _frames(spark, sf_dir)[1].select("id", F.explode(F.split(F.lower("name"), " ")).alias("term"))


@query(_NUMBERED_SQL + ", t10 AS (SELECT * FROM nt QUALIFY row_number() OVER (PARTITION BY id ORDER BY term) <= 10) SELECT DISTINCT nb.id, term FROM nb JOIN t10 ON t10.id = other WHERE nth <= 30")
def ag15_neighbour_terms(spark, sf_dir):
    return neighbours.neighbour_terms(_frames(spark, sf_dir)[2], _name_words(spark, sf_dir).distinct())


@query(_NUMBERED_SQL + ", m AS (SELECT nb.id, avg((o.id IS NULL)::INT) AS share FROM nb JOIN nt ON nt.id = other LEFT JOIN nt o ON o.id = nb.id AND o.term = nt.term WHERE way = 0 AND nth <= 20 GROUP BY nb.id) SELECT id, round(coalesce(share, 0) * (1 + 0.3 * ln(2 + n)), 6) AS potential FROM (SELECT id, count(*) AS n FROM nb WHERE way = 0 GROUP BY id) LEFT JOIN m USING (id)")
def ag14_bridging(spark, sf_dir):
    return _rounded(neighbours.bridging(_frames(spark, sf_dir)[2], _name_words(spark, sf_dir).distinct()), "potential")


@query(_NUMBERED_SQL + """, fr AS (SELECT term, count(*) AS df FROM nt GROUP BY term HAVING count(*) < floor((SELECT count(*) FROM symbols) * 0.3)), iw AS (SELECT term, ln(1 + (SELECT count(*) FROM symbols) / (df + 1)) AS idf FROM fr WHERE strlen(term) >= 3),
wd AS (SELECT id, unnest(string_split(lower(name), ' ')) AS term FROM symbols), sm AS (SELECT nb.id, term, round(sum(idf), 6) AS s FROM nb JOIN wd ON wd.id = other JOIN iw USING (term) WHERE nth <= 12 GROUP BY ALL),
tp AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, term) AS p FROM sm QUALIFY p <= 15) SELECT id, string_agg(term, ' ' ORDER BY p) AS signature FROM tp GROUP BY id""")
def gr23_signatures(spark, sf_dir):
    _, s, e = _frames(spark, sf_dir)
    return neighbours.signatures(e, _name_words(spark, sf_dir).withColumnRenamed("term", "word"), s.agg(F.count("*").alias("n")))


@query(", st AS (SELECT (n_nationkey + 100)::BIGINT AS start FROM nation), inn AS (SELECT start, start AS id FROM st UNION SELECT start, target_id FROM st JOIN edges ON source_id = start) SELECT start, target_id AS id, count(*) AS paths FROM inn JOIN edges ON source_id = inn.id WHERE target_id <> start GROUP BY ALL")
def ag17_path_counts(spark, sf_dir):
    starts = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"))
    return neighbours.path_counts(_frames(spark, sf_dir)[2], starts, 2)


WALKED = [(0, "small household"), (1, "promo machinery rings"), (2, "suppliers of widgets"), (3, "customer building rod"), (4, "large")]


@query(", sets AS (SELECT DISTINCT id, unnest(list_filter(string_split(lower(name || ' ' || source), ' '), lambda x: x <> '')) AS term, 1.0::DOUBLE AS w FROM symbols)" + _asked_sql(WALKED) + _TERM_SQL + _NUMBERED_SQL + f""", md AS (SELECT query_id, list_sort(list(idf))[(count(*) // 2)::INT + 1] AS lo FROM qt GROUP BY 1),
ab AS (SELECT query_id, id, sum(score) AS covered FROM ts JOIN qt USING (query_id, place) JOIN md USING (query_id) GROUP BY ALL HAVING bool_or(idf >= lo)),
sd AS (SELECT query_id, id AS seed FROM (SELECT DISTINCT query_id, id FROM ab) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 8),
wl AS (SELECT id, other, way, nth, {model.sql_case(model.WALK_WEIGHT, 'kind', '0.5')}::DOUBLE AS w, row_number() OVER (PARTITION BY id ORDER BY way, nth) AS n FROM nb),
h1 AS (SELECT query_id, seed, other AS id, w, way, nth FROM sd JOIN wl ON wl.id = seed WHERE nth <= 10 AND other <> seed QUALIFY row_number() OVER (PARTITION BY query_id, seed, other ORDER BY way, nth) = 1),
g1 AS (SELECT h1.*, covered, row_number() OVER (PARTITION BY query_id, seed ORDER BY way, nth) AS pos FROM h1 JOIN ab USING (query_id, id)),
h2 AS (SELECT query_id, seed, other AS id, least(g1.w, wl.w) AS w, pos, n FROM g1 JOIN wl ON wl.id = g1.id WHERE n <= 6 AND other <> seed), h2b AS (SELECT * FROM h2 ANTI JOIN h1 USING (query_id, seed, id) QUALIFY row_number() OVER (PARTITION BY query_id, seed, id ORDER BY pos, n) = 1),
al AS (SELECT query_id, seed, id, covered * 0.5 * w AS e, 1 AS hop, 0 AS a, pos AS b FROM g1 UNION ALL SELECT query_id, seed, id, covered * 0.25 * w, 2, pos, n FROM h2b JOIN ab USING (query_id, id)),
tk AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY query_id, seed ORDER BY hop, a, b) <= 25) SELECT query_id, id, round(sum(e), 6) AS evidence, count(*) AS from_seeds FROM tk GROUP BY ALL""")
def tx30_walk(spark, sf_dir):
    """Walks from the first symbols that hold a special term of a search, over all symbols' words."""
    _, s, e = _frames(spark, sf_dir)
    words = F.filter(F.split(F.lower(F.concat_ws(" ", "name", "source")), " "), lambda x: x != "")
    sets = s.select("id", F.explode(F.array_distinct(words)).alias("term"), F.lit(1.0).alias("w"))
    asked = scoring.query_terms(_values(spark, "query_id, query", WALKED), text.inverse_frequency(sets.select("id", "term")))
    scores = scoring.term_scores(asked, sets)
    return _rounded(neighbours.walk(e, neighbours.gated(asked, scores).select("query_id", "id"), asked, scores), "evidence")
