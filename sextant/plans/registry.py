"""The queries of the search and graph operators, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant import model
from sextant.functions import lexical
from sextant.model import read
from sextant.operators import graph, text

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None, with_model: bool = True):
    """Registers a function (spark, sf_dir) under its name, with the SQL of its rows; the model's tables come before the SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {model.MODEL_SQL}{sql}" if with_model else sql
        return f

    return put


def _frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return model.files(spark, sf_dir), model.symbols(spark, sf_dir), model.edges(spark, sf_dir)


def _values(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A small fixed table, as a SQL VALUES list."""
    text_of = lambda v: str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(map(text_of, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def _values_sql(names: str, rows: list[tuple]) -> str:
    text_of = lambda v: str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text_of, r)) + ")" for r in rows) + f") AS t({names}))"


SEARCHES = [(0, "then"), (0, "thing"), (1, "and"), (1, "ereing"), (2, "leeau"), (2, "queeau"), (3, "schen"), (3, "in"), (3, "heer")]
_S = _values_sql("query_id, term", SEARCHES)
_BM25_SQL = f"""
, toks AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: length(t) >= 2)) AS term, 8.0 AS w FROM documents
  UNION ALL SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(source || ' ' || lang), '[^a-z0-9]+'), lambda t: length(t) >= 2)), 4.0 FROM documents),
post AS (SELECT id, term, sum(w)::DOUBLE AS tf FROM toks GROUP BY ALL),
len AS (SELECT id, sum(tf) AS len FROM post GROUP BY id),
idf AS (SELECT term, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term),
scored AS (SELECT q.query_id, p.id, round(sum(idf.idf * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * len.len / (SELECT avg(len) FROM len)))), 6) AS score
  FROM post p JOIN {_S} q ON q.term = p.term JOIN len ON len.id = p.id JOIN idf ON idf.term = p.term GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 20)
"""


def _ranked(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.concat_ws(" ", "source", "lang").alias("label"))
    post = text.postings(docs, {"text": text.QUESTION_WEIGHTS["source"], "label": text.QUESTION_WEIGHTS["file_path"]})
    return text.bm25(post, _values(spark, "query_id, term", SEARCHES), docs.agg(F.count("*").alias("n")), k)


@query(_BM25_SQL + "SELECT query_id, id, score, rank::INT AS rank FROM ranked")
def tx01_bm25(spark, sf_dir):
    return _ranked(spark, sf_dir).select("query_id", "id", "score", "rank")


_REL_SQL = _BM25_SQL + f""", rel AS (SELECT q.query_id, l.doc_id AS id, l.quality AS grade FROM labels l CROSS JOIN (SELECT DISTINCT query_id FROM {_S}) q)"""


def _relevance(spark, sf_dir):
    q = _values(spark, "query_id, term", SEARCHES).select("query_id").distinct()
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("grade")).crossJoin(F.broadcast(q))


@query(_REL_SQL + """, d AS (SELECT query_id, sum(grade / log2(rank + 1)) AS dcg FROM ranked JOIN rel USING (query_id, id) WHERE rank <= 10 GROUP BY 1),
i AS (SELECT query_id, sum(grade / log2(p + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS p FROM rel) WHERE p <= 10 GROUP BY 1)
SELECT query_id, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END, 6) AS ndcg FROM i LEFT JOIN d USING (query_id)""")
def tx47_ndcg(spark, sf_dir):
    return text.ndcg(_ranked(spark, sf_dir), _relevance(spark, sf_dir), 10).withColumn("ndcg", F.round("ndcg", 6))


@query(_REL_SQL + """, d AS (SELECT query_id, sum(grade / CASE WHEN rank = 1 THEN 1 ELSE log2(rank) END) AS dcg FROM ranked JOIN rel USING (query_id, id) WHERE rank <= 10 GROUP BY 1),
i AS (SELECT query_id, sum(grade / CASE WHEN p = 1 THEN 1 ELSE log2(p) END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS p FROM rel) WHERE p <= 10 GROUP BY 1)
SELECT query_id, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END, 6) AS ndcg FROM i LEFT JOIN d USING (query_id)""")
def tx50_ndcg_undiscounted(spark, sf_dir):
    return text.ndcg(_ranked(spark, sf_dir), _relevance(spark, sf_dir), 10, True).withColumn("ndcg", F.round("ndcg", 6))


@query(_REL_SQL + """, f AS (SELECT query_id, min(rank) AS first, count(*) AS found FROM ranked JOIN rel USING (query_id, id) WHERE grade > 0 AND rank <= 10 GROUP BY 1)
SELECT query_id, round(coalesce(1.0 / first, 0), 6) AS rr, coalesce((first = 1)::BIGINT, 0) AS hit1, coalesce(found, 0) / 10.0::DOUBLE AS precision FROM (SELECT DISTINCT query_id FROM ranked) LEFT JOIN f USING (query_id)""")
def tx49_mrr(spark, sf_dir):
    return text.reciprocal_rank(_ranked(spark, sf_dir), _relevance(spark, sf_dir), 10).withColumn("rr", F.round("rr", 6))


FAMILY_CASES = [(0, "RateLimiter"), (1, "embedding"), (2, "predictor.rs"), (3, "panic in thread pool"), (4, "what determines the eviction policy"), (5, "all memory lifecycle operations"), (6, "callers of RateLimiter"), (7, ""), (8, "src/core lib"), (9, "GraphDb::open path_of"), (10, "how does the cache connect to disk"), (11, "remove dead rules"), (12, "list all handlers"), (13, "db"), (14, "parse config file quickly")]
FAMILIES = ["symbol-exact", "nl-descriptive", "file-path", "error-debug", "nl-abstract", "cross-cutting", "relationship", "symbol-partial", "file-path", "symbol-exact", "relationship", "nl-descriptive", "cross-cutting", "symbol-exact", "nl-descriptive"]


@query(f"SELECT * FROM {_values_sql('case_id, query, family', [(i, q, f) for (i, q), f in zip(FAMILY_CASES, FAMILIES, strict=True)])}", False)
def tx14_query_family(spark, sf_dir):
    return _values(spark, "case_id, query", FAMILY_CASES).withColumn("family", lexical.query_family(F.col("query")))


@query(", t AS (SELECT id, unnest(string_split(lower(name), ' ')) AS term FROM symbols WHERE kind = 'function'), s AS (SELECT DISTINCT * FROM t) SELECT term, count(*) AS df, round(ln(1 + (SELECT count(DISTINCT id) FROM s) / (count(*) + 1)), 6) AS idf FROM s GROUP BY term")
def ag07_idf(spark, sf_dir):
    s = model.symbols(spark, sf_dir).filter("kind = 'function'").select("id", F.explode(F.split(F.lower("name"), " ")).alias("term")).distinct()
    return text.inverse_frequency(s).withColumn("idf", F.round("idf", 6))


_SETS_SQL = """, t AS (SELECT doc_id AS id, unnest(string_split(lower(text), ' ')) AS term FROM documents), s AS (SELECT id, term, count(*) AS tf FROM t WHERE term <> '' GROUP BY ALL),
i AS (SELECT term, ln(1 + (SELECT count(DISTINCT id) FROM s) / (count(*) + 1)) AS idf FROM s GROUP BY term)"""


def _sets(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split(F.lower("text"), " ")).alias("term")).filter("term <> ''").groupBy("id", "term").agg(F.count("*").alias("tf"))


@query(_SETS_SQL + " SELECT id, term, tf, (row_number() OVER (PARTITION BY id ORDER BY round(tf * idf, 9) DESC, term))::INT AS place FROM s JOIN i USING (term) QUALIFY place <= 30")
def ag09_top_terms(spark, sf_dir):
    return text.top_terms(_sets(spark, sf_dir)).select("id", "term", "tf", "place")


@query(_SETS_SQL + " SELECT id, term, tf, round(tf / sum(tf) OVER (PARTITION BY id), 9) AS share FROM s")
def ag08_term_frequency(spark, sf_dir):
    return _sets(spark, sf_dir).withColumn("share", F.round(F.col("tf") / F.sum("tf").over(Window.partitionBy("id")), 9))


_GREP = [(0, "small"), (0, "brand#1"), (1, "part#"), (1, "3"), (2, "building"), (3, "cust_er"), (4, "supplier#000000001"), (5, "x")]


@query(f""", q AS (SELECT query_id, lower(term) AS t FROM {_values_sql('query_id, term', _GREP)} WHERE strlen(term) >= 2),
a AS (SELECT query_id, id, CASE WHEN lower(name) = t THEN 3.0 WHEN starts_with(lower(name), t) THEN 2.5 WHEN contains(lower(name), t) THEN 2.0 ELSE 1.0 END AS s FROM symbols JOIN q ON lower(name) LIKE '%' || replace(t, '_', '%') || '%'),
w AS (SELECT query_id, unnest(list_filter(regexp_split_to_array(t, '[^a-z0-9]+'), lambda x: strlen(x) >= 2)) AS w FROM q), b AS (SELECT query_id, id, 0.5 AS s FROM symbols JOIN w ON lower(source) LIKE '%' || w || '%'),
h AS (SELECT query_id, id, sum(s)::DOUBLE AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM h QUALIFY rank <= 10""")
def tx46_substring_baseline(spark, sf_dir):
    return text.substring_search(model.symbols(spark, sf_dir), _values(spark, "query_id, term", _GREP), 10)


_LINES_SQL = ", r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS file_id, l_orderkey % 50 AS query_id, l_extendedprice AS score FROM lineitem)"


def _scored(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("file_id"), (F.col("l_orderkey") % 50).alias("query_id"), F.col("l_extendedprice").alias("score"))


@query(_LINES_SQL + " SELECT query_id, file_id, id, score, (row_number() OVER (PARTITION BY query_id, file_id ORDER BY score DESC, id))::INT AS in_file FROM r QUALIFY in_file <= 3")
def wn01_cap_per_file(spark, sf_dir):
    return text.cap_per_file(_scored(spark, sf_dir), 3)


@query(_LINES_SQL + " SELECT query_id, file_id, id, score, round(score * pow(0.85, row_number() OVER (PARTITION BY query_id, file_id ORDER BY score DESC, id) - 1) + 0.0000003, 4) AS damped FROM r")
def wn02_dampen(spark, sf_dir):
    return text.dampen(_scored(spark, sf_dir)).withColumn("damped", F.round(F.col("damped") + 0.0000003, 4))


@query(_LINES_SQL + " SELECT query_id, list_extract(list_sort(list(score)), (count(*) // 2)::INT + 1) AS median FROM r GROUP BY query_id")
def wn04_upper_median(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("query_id").agg(F.sort_array(F.collect_list("score")).alias("s")).select("query_id", F.element_at("s", F.floor(F.size("s") / 2).cast("int") + 1).alias("median"))


@query(_LINES_SQL + " SELECT query_id, quantile_disc(score, 0.5) AS p50, quantile_disc(score, 0.95) AS p95, quantile_disc(score, 0.99) AS p99 FROM r GROUP BY query_id")
def wn07_percentiles(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("query_id").agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY score)").alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])


_LOCK_SQL = """, sc AS (SELECT c_nationkey AS query_id, 3000000 + c_custkey AS id, c_name AS name, c_acctbal AS score FROM customer),
sd AS (SELECT query_id, id, score * (1 + (id % 7 = 3)::INT) AS score FROM sc WHERE score > 0), tm AS (SELECT n_nationkey AS query_id, (n_nationkey % 10)::VARCHAR AS term FROM nation)"""


def _customers(spark, sf_dir):
    """Scored symbols, seeds of another order, and terms of the queries."""
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query_id"), (F.col("c_custkey") + 3_000_000).alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"))
    seeds = c.filter("score > 0").select("query_id", "id", (F.col("score") * (1 + (F.col("id") % 7 == 3).cast("int"))).alias("score"))
    return c, seeds, read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), (F.col("n_nationkey") % 10).cast("string").alias("term"))


@query(_LOCK_SQL + """, two AS (SELECT *, row_number() OVER w AS p, lead(score) OVER w AS nx FROM sd WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id)),
ods AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS p FROM sc),
lk AS (SELECT a.query_id, a.id FROM two t JOIN ods a USING (query_id, id) WHERE t.p = 1 AND t.score / greatest(t.nx, 1e-10) > 1.2 AND a.p > 1 AND EXISTS (SELECT 1 FROM tm WHERE tm.query_id = a.query_id AND contains(lower(a.name), term))),
o AS (SELECT query_id, id, round(score + CASE WHEN lk.id IS NOT NULL THEN 1e6 ELSE 0 END, 4)::DOUBLE AS score FROM sc LEFT JOIN lk USING (query_id, id))
SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM o""")
def wn03_lock_gap(spark, sf_dir):
    """Customers of a nation by balance; seeds double some of them, so that some locks move a result to the front."""
    return text.lock_first(*_customers(spark, sf_dir)).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


@query(_LOCK_SQL + """, qs AS (SELECT c_nationkey AS query_id, lower(min(c_name)) AS query FROM customer GROUP BY 1), x AS (SELECT sc.*, lower(name) = query AS ex FROM sc JOIN qs USING (query_id)),
y AS (SELECT query_id, id, ex, round(CASE WHEN ex THEN greatest(score, max(score) FILTER (ex) OVER (PARTITION BY query_id) + 1, 10) ELSE score END, 4)::DOUBLE AS score FROM x)
SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY ex DESC, score DESC, id))::INT AS rank FROM y""")
def so04_exact_promotion(spark, sf_dir):
    c = _customers(spark, sf_dir)[0]
    asked = c.groupBy("query_id").agg(F.lower(F.min("name")).alias("query"))
    return text.promote_exact(c, asked).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


# sources and sinks


@query("SELECT doc_id, sha256(text) AS content_hash, len(string_split(text, chr(10)))::INT AS line_count, octet_length(encode(text))::INT AS size FROM documents", False)
def sc05_file_rows(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("content_hash"), F.size(F.split("text", "\n")).alias("line_count"), F.octet_length("text").alias("size"))


@query("WITH old AS (SELECT doc_id AS path, sha256(text) AS hash FROM documents WHERE source <> 'src3'), new AS (SELECT doc_id AS path, sha256(CASE WHEN lang = 'fr' THEN text || '!' ELSE text END) AS hash FROM documents) SELECT n.path, CASE WHEN o.path IS NULL THEN 'new' ELSE 'changed' END AS status FROM new n LEFT JOIN old o ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash", False)
def sc06_incremental_skip(spark, sf_dir):
    from sextant.sources.listing import changed_files

    d = read(spark, sf_dir, "documents")
    old = d.filter("source <> 'src3'").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("content_hash"))
    new = d.select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return changed_files(new, old).select("path", "status")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, (n - 1) // 50 AS chunk, min(n) AS first, max(n) AS last, string_agg(line, chr(10) ORDER BY n) AS source FROM l GROUP BY ALL", False)
def sc10_line_chunks(spark, sf_dir):
    from sextant.sources.listing import line_chunks

    return line_chunks(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 50)


@query(" SELECT source_id, target_id, kind, max(seq) AS seq FROM raw_edges GROUP BY ALL")
def sc23_upsert_edge(spark, sf_dir):
    w = Window.partitionBy("source_id", "target_id", "kind").orderBy(F.desc("seq"))
    return model.raw_edges(spark, sf_dir).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


@query(" SELECT source_id, target_id, kind, min(seq) AS seq FROM raw_edges GROUP BY ALL")
def sc24_insert_or_ignore(spark, sf_dir):
    return model.raw_edges(spark, sf_dir).groupBy("source_id", "target_id", "kind").agg(F.min("seq").alias("seq"))


@query(" SELECT e.source_id, e.target_id, e.kind FROM edges e WHERE source_id NOT IN (SELECT id FROM symbols WHERE file_id = 3) AND target_id NOT IN (SELECT id FROM symbols WHERE file_id = 3)")
def sc27_delete_edges_of_file(spark, sf_dir):
    _, s, e = _frames(spark, sf_dir)
    gone = s.filter("file_id = 3").select("id")
    e = e.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return e.select("source_id", "target_id", "kind")


# projections and predicates


@query(" SELECT id, name, line_start FROM symbols WHERE file_id = 7")
def pr03_symbols_of_file(spark, sf_dir):
    return model.symbols(spark, sf_dir).filter("file_id = 7").select("id", "name", "line_start")


@query(f" SELECT s.id, s.name, round({model.sql_case(model.DEFAULT_IMPORTANCE, 's.kind', '0.5')}::DOUBLE, 6) AS importance FROM symbols s JOIN files f ON s.file_id = f.id WHERE f.path LIKE 'src/a%' AND visibility = 'public' AND s.kind IN ('function', 'class') ORDER BY importance DESC, s.id LIMIT 100")
def pr04_path_prefix(spark, sf_dir):
    f, s, _ = _frames(spark, sf_dir)
    j = s.join(f.select(F.col("id").alias("file_id"), "path"), "file_id").filter(F.startswith("path", F.lit("src/a")) & (F.col("visibility") == "public") & F.col("kind").isin("function", "class"))
    return j.select("id", "name", model.lookup(model.DEFAULT_IMPORTANCE, F.col("kind"), 0.5).alias("importance")).orderBy(F.desc("importance"), "id").limit(100)


@query(" SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, 2), '/') AS prefix FROM files")
def pr05_path_prefixes(spark, sf_dir):
    return model.files(spark, sf_dir).select(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("prefix")).distinct()


@query(" SELECT id, name FROM symbols WHERE lower(name) = lower('CUSTOMER#000000042') OR lower(name) = 'germany'")
def pr08_exact_name(spark, sf_dir):
    return model.symbols(spark, sf_dir).filter(F.lower("name").isin("customer#000000042", "germany")).select("id", "name")


@query(" SELECT id FROM symbols WHERE contains(lower(source), 'brand#1') ORDER BY id LIMIT 50")
def pr11_source_scan(spark, sf_dir):
    return model.symbols(spark, sf_dir).filter(F.contains(F.lower("source"), F.lit("brand#1"))).orderBy("id").limit(50).select("id")


PATHS = [(0, "src/lib.rs"), (1, "app/tests/test_a.py"), (2, "web/Index.ts"), (3, "pkg/cli/main.go"), (4, "a/b/c_test.go"), (5, "x/bench/bench.rs"), (6, "README"), (7, "src/main.rs"), (8, "lib/mod.rs"), (9, "a/spec/x.RB")]
PATH_FACTS = [(0, "rust", False, True, "library module"), (1, "python", True, False, "test file"), (2, "typescript", False, True, "entry point"), (3, "go", False, True, "cli command"), (4, "go", True, False, "test file"), (5, "rust", False, False, "benchmark"), (6, "unknown", False, False, ""), (7, "rust", False, True, "entry point"), (8, "rust", False, True, "library module"), (9, "ruby", True, False, "")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p}', '{f[1]}', {str(f[2]).lower()}, {str(f[3]).lower()}, '{f[4]}')" for (i, p), f in zip(PATHS, PATH_FACTS, strict=True)) + ") AS t(case_id, path, language, is_test, is_entry, role)", False)
def pr14_path_predicates(spark, sf_dir):
    p = F.col("path")
    role = F.when(p == "src/lib.rs", "library module").otherwise(F.coalesce(lexical.file_role(F.concat(F.lit("/"), p)), F.lit("")))
    return _values(spark, "case_id, path", PATHS).select("case_id", "path", lexical.language(p).alias("language"), lexical.is_test_file(p).alias("is_test"), lexical.is_entry_point(p).alias("is_entry"), role.alias("role"))


# joins


@query(" SELECT source_id, count(*) AS n, string_agg(e.kind || ':' || s.name, ',' ORDER BY e.kind, s.name, target_id) AS targets FROM edges e JOIN symbols s ON target_id = s.id GROUP BY source_id")
def jn03_outgoing_grouped(spark, sf_dir):
    _, s, e = _frames(spark, sf_dir)
    j = e.join(s.select(F.col("id").alias("target_id"), "name"), "target_id")
    g = j.groupBy("source_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("kind", "name", "target_id"))).alias("t"))
    return g.select("source_id", "n", F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["kind"], x["name"])), ",").alias("targets"))


@query(" SELECT s.id, s.name, count(DISTINCT e.source_id) AS sources FROM symbols s LEFT JOIN edges e ON e.target_id = s.id WHERE s.kind = 'class' GROUP BY ALL")
def jn05_left_join_degree(spark, sf_dir):
    _, s, e = _frames(spark, sf_dir)
    n = e.groupBy("target_id").agg(F.count_distinct("source_id").alias("sources"))
    return s.filter("kind = 'class'").join(n, F.col("id") == F.col("target_id"), "left").select("id", "name", F.coalesce("sources", F.lit(0)).alias("sources"))


@query(" SELECT id FROM symbols WHERE id IN (SELECT target_id FROM edges WHERE kind = 'calls') AND id NOT IN (SELECT target_id FROM edges WHERE kind = 'tests')")
def jn06_semi_anti(spark, sf_dir):
    _, s, e = _frames(spark, sf_dir)
    t = lambda k: e.filter(F.col("kind") == k).select(F.col("target_id").alias("id"))
    return s.select("id").join(t("calls"), "id", "left_semi").join(t("tests"), "id", "left_anti")


_DEGREE_SQL = " LEFT JOIN (SELECT source_id, count(*) AS o FROM edges GROUP BY 1) a ON a.source_id = s.id LEFT JOIN (SELECT target_id, count(*) AS i FROM edges GROUP BY 1) b ON b.target_id = s.id"


@query(f" SELECT s.id, coalesce(i, 0) AS n_in, coalesce(o, 0) AS n_out FROM symbols s{_DEGREE_SQL} ORDER BY coalesce(i, 0) + coalesce(o, 0) DESC, s.id LIMIT 28")
def jn08_ranked_symbols(spark, sf_dir):
    _, s, e = _frames(spark, sf_dir)
    d = graph.degrees(e).select("id", F.col("all_in").alias("n_in"), F.col("all_out").alias("n_out"))
    j = s.select("id").join(d, "id", "left").na.fill(0)
    return j.orderBy(F.desc(F.col("n_in") + F.col("n_out")), "id").limit(28)


@query(" SELECT e.source_id, a.name AS source_name, e.target_id, b.name AS target_name, e.kind FROM edges e JOIN symbols a ON a.id = e.source_id JOIN symbols b ON b.id = e.target_id ORDER BY e.weight DESC, e.source_id, e.target_id, e.kind LIMIT 60")
def jn09_edge_snapshot(spark, sf_dir):
    _, s, e = _frames(spark, sf_dir)
    n = lambda side: s.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"))
    return e.join(n("source"), "source_id").join(n("target"), "target_id").orderBy(F.desc("weight"), "source_id", "target_id", "kind").limit(60).select("source_id", "source_name", "target_id", "target_name", "kind")


@query(" SELECT f.path, count(DISTINCT s.id) AS symbols, count(DISTINCT e.target_id) AS targets FROM files f LEFT JOIN symbols s ON s.file_id = f.id LEFT JOIN edges e ON e.source_id = s.id GROUP BY f.path")
def jn10_file_tree(spark, sf_dir):
    """Distinct symbols and targets by path: an id counts once, whatever rows and files of the path have it."""
    f, s, e = _frames(spark, sf_dir)
    f = f.select(F.col("id").alias("file_id"), "path", F.min("id").over(Window.partitionBy("path")).alias("tree"))
    own = F.broadcast(f.select("file_id", "tree")).join(s.select("file_id", F.col("id").alias("source_id")), "file_id").select("tree", "source_id").distinct()  # a file for each nation
    targets = own.join(e, "source_id").groupBy("tree").agg(F.count_distinct("target_id").alias("targets"))
    n = own.groupBy("tree").agg(F.count("source_id").alias("symbols")).join(targets, "tree", "left")
    return f.select("path", "tree").distinct().join(n, "tree", "left").select("path", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("targets", F.lit(0)).alias("targets"))


@query(" SELECT name, min(id) AS id FROM symbols GROUP BY name HAVING count(*) > 1")
def jn11_first_by_name(spark, sf_dir):
    return model.symbols(spark, sf_dir).groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n > 1").drop("n")


@query(" , c AS (SELECT p_partkey AS call_id, (p_partkey % 25)::BIGINT AS file_id, (p_partkey * 7) % 997 AS line FROM part) SELECT call_id, id AS symbol_id FROM c JOIN symbols s ON s.file_id = c.file_id AND line BETWEEN line_start AND line_end QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY line_end - line_start, line_start, id) = 1")
def jn16_enclosing_symbol(spark, sf_dir):
    from sextant.operators.joins import enclosing

    calls = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("call_id"), (F.col("p_partkey") % 25).cast("long").alias("file_id"), (F.col("p_partkey") * 7 % 997).alias("line"))
    return enclosing(calls, model.symbols(spark, sf_dir).select("id", "file_id", "line_start", "line_end"))


@query(" SELECT id, coalesce(last_value(CASE WHEN kind = 'class' THEN id END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_start, id), -1) AS container FROM symbols WHERE file_id IS NOT NULL")
def jn17_containing_class(spark, sf_dir):
    from sextant.operators.joins import last_container

    return last_container(model.symbols(spark, sf_dir).filter("file_id IS NOT NULL"), ["class"]).select("id", F.coalesce("container", F.lit(-1)).alias("container"))


_TOKENS_SQL = ", t AS (SELECT DISTINCT id, unnest(string_split(lower(source), ' ')) AS token FROM symbols WHERE kind = 'function'), c AS (SELECT *, count(*) OVER (PARTITION BY token) AS n FROM t)"


def _tokens(spark, sf_dir):
    return model.symbols(spark, sf_dir).filter("kind = 'function'").select("id", F.explode(F.split(F.lower("source"), " ")).alias("token")).distinct()


@query(_TOKENS_SQL + " , l AS (SELECT token, id, lead(id) OVER (PARTITION BY token ORDER BY id) AS next, n FROM c WHERE n BETWEEN 2 AND 150) SELECT id, next, token, round(least(0.15 * greatest(ln((SELECT count(DISTINCT id) FROM t) / n), 0.1), 0.40), 6) AS weight FROM l WHERE next IS NOT NULL")
def wn05_token_chains(spark, sf_dir):
    from sextant.operators.joins import token_chains

    return token_chains(_tokens(spark, sf_dir), 2, 150).withColumn("weight", F.round("weight", 6))


@query(" , m AS (SELECT source, id FROM symbols WHERE kind = 'function' AND source <> '') SELECT a.source AS literal, a.id AS a, b.id AS b FROM m a JOIN m b ON a.source = b.source AND a.id < b.id QUALIFY row_number() OVER (PARTITION BY a.source ORDER BY a.id, b.id) <= 50")
def jn20_bounded_pairs(spark, sf_dir):
    from sextant.operators.joins import bounded_pairs

    return bounded_pairs(model.symbols(spark, sf_dir).filter("kind = 'function' AND source <> ''").select(F.col("source").alias("literal"), "id"), 50)


@query(" SELECT e.target_id AS id, min_by(s.id, s.id) AS container_id, min_by(s.name, s.id) AS container_name FROM edges e JOIN symbols s ON s.id = e.source_id WHERE e.kind = 'contains' GROUP BY 1")
def jn21_container(spark, sf_dir):
    _, s, e = _frames(spark, sf_dir)
    return e.filter("kind = 'contains'").join(s.select(F.col("id").alias("source_id"), "name"), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.min("source_id").alias("container_id"), F.min_by("name", "source_id").alias("container_name"))


# aggregates


@query(" SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges, '1' AS schema_version")
def ag02_stats(spark, sf_dir):
    f, s, e = (x.agg(F.count("*").alias(n)) for x, n in zip(_frames(spark, sf_dir), ("files", "symbols", "edges"), strict=True))
    return f.crossJoin(s).crossJoin(e).withColumn("schema_version", F.lit("1"))


_KINDS_SQL = ("calls", "contains", "imports", "implements", "extends", "tests", "references")
_D_SQL = ", d AS (SELECT s.id, s.kind, s.file_id" + "".join(f", coalesce(o.{k}, 0) AS {k}_out, coalesce(i.{k}, 0) AS {k}_in" for k in _KINDS_SQL) + " FROM symbols s" + "".join(
    f" LEFT JOIN (SELECT {c} AS k, " + ", ".join(f'count(*) FILTER (kind = \'{k}\') AS "{k}"' for k in _KINDS_SQL) + f" FROM edges GROUP BY 1) {a} ON {a}.k = s.id" for c, a in (("source_id", "o"), ("target_id", "i"))
) + ")"
_D_SQL = _D_SQL.replace("o.references", 'o."references"').replace("i.references", 'i."references"')


@query(_D_SQL + """, m AS (SELECT greatest(max(calls_in), 1) AS mi, greatest(max(calls_out), 1) AS mo, greatest(max(contains_out), 1) AS mc, greatest(max(imports_in), 1) AS mm FROM d)
SELECT id, round(least(1.0, 0.35 * sqrt(calls_in) / sqrt(mi) + 0.20 * sqrt(calls_out) / sqrt(mo) + 0.20 * sqrt(contains_out) / sqrt(mc) + 0.15 * imports_in / mm + CASE WHEN calls_in > 0 AND calls_out > 0 THEN 0.10 ELSE 0 END), 6)::DOUBLE AS importance FROM d, m""")
def ag03_importance(spark, sf_dir):
    _, s, e = _frames(spark, sf_dir)
    return graph.importance(s, e).withColumn("importance", F.round("importance", 6))


@query(" SELECT 'symbol' AS what, kind, count(*) AS n FROM symbols GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind")
def ag04_group_counts(spark, sf_dir):
    _, s, e = _frames(spark, sf_dir)
    n = lambda df, w: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(w).alias("what"), "kind", "n")
    return n(s, "symbol").unionByName(n(e, "edge"))


@query(" SELECT lower(name) AS name, count(*) AS n, min(id) AS first FROM symbols GROUP BY 1 HAVING count(*) >= 3")
def ag10_collisions(spark, sf_dir):
    return model.symbols(spark, sf_dir).groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n >= 3")


@query(" SELECT source_id, count(*) AS n, string_agg(target_id::VARCHAR, ',' ORDER BY target_id) AS targets, round(sum(w), 6) AS weight FROM (SELECT source_id, target_id, max(weight) AS w FROM edges GROUP BY ALL) GROUP BY source_id")
def ag12_adjacency(spark, sf_dir):
    e = model.edges(spark, sf_dir).groupBy("source_id", "target_id").agg(F.max("weight").alias("w"))
    return e.groupBy("source_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("target_id")), lambda x: x.cast("string")), ",").alias("targets"), F.round(F.sum("w"), 6).alias("weight"))


@query(""", t AS (SELECT target_id AS id FROM edges WHERE kind IN ('calls', 'references', 'overrides', 'extends', 'implements', 'tests', 'contains'))
SELECT path, count(*) AS n, sum(greatest(line_end - line_start, 1))::BIGINT AS lines, string_agg(name, ',' ORDER BY name) AS names FROM symbols s JOIN files f ON f.id = s.file_id
WHERE s.id NOT IN (SELECT id FROM t) AND visibility <> 'public' AND kind NOT IN ('trait', 'interface', 'constructor') AND lower(name) NOT IN ('new', 'init', 'drop', 'default') GROUP BY path""")
def ag19_dead_code(spark, sf_dir):
    f, s, e = _frames(spark, sf_dir)
    return graph.dead_code(s, f, e)


@query(" , m AS (SELECT id, unnest(regexp_extract_all(source, '[0-9]+')) AS literal FROM symbols WHERE visibility = 'public') SELECT literal, count(*) AS n, round(ln((SELECT count(*) FROM symbols) / count(*)), 6) AS rarity FROM (SELECT DISTINCT * FROM m) GROUP BY literal HAVING count(*) >= 2")
def ag20_shared_constants(spark, sf_dir):
    s = model.symbols(spark, sf_dir)
    m = s.filter("visibility = 'public'").select("id", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit("([0-9]+)"), 1))).alias("literal"))
    return m.groupBy("literal").agg(F.count("*").alias("n")).filter("n >= 2").crossJoin(F.broadcast(s.agg(F.count("*").alias("all")))).select("literal", "n", F.round(F.log(F.col("all") / F.col("n")), 6).alias("rarity"))


@query(" SELECT kind, target_id AS id, count(*) AS n FROM edges WHERE kind IN ('calls', 'imports') GROUP BY kind, target_id QUALIFY row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, target_id) <= 5")
def ag25_top_signals(spark, sf_dir):
    n = model.edges(spark, sf_dir).filter(F.col("kind").isin("calls", "imports")).groupBy("kind", F.col("target_id").alias("id")).agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "id"))).filter("r <= 5").drop("r")


# graph

_START_SQL = " , st AS (SELECT 1000000 + s_suppkey AS id FROM supplier)"


def _starts(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000).cast("long").alias("id"))


def _walk_sql(name: str, a: str, b: str, kinds: list[str], depth: int) -> str:
    k = ", ".join(f"'{x}'" for x in kinds)
    return f" , {name} AS (SELECT id AS start, id, 0 AS distance FROM st UNION SELECT w.start, e.{b}, w.distance + 1 FROM {name} w JOIN edges e ON e.{a} = w.id AND e.kind IN ({k}) WHERE w.distance < {depth})"


@query(_START_SQL + _walk_sql("w", "source_id", "target_id", model.DEPENDENCY_KINDS, 2) + " SELECT start, id, min(distance)::INT AS distance FROM w GROUP BY start, id HAVING min(distance) > 0")
def gr01_bfs(spark, sf_dir):
    return graph.bounded_bfs(model.edges(spark, sf_dir), _starts(spark, sf_dir), 2, "out", model.DEPENDENCY_KINDS)


@query(_START_SQL + _walk_sql("w", "source_id", "target_id", model.DEPENDENCY_KINDS, 2) + _walk_sql("v", "target_id", "source_id", model.DEPENDENCY_KINDS, 2) + " SELECT start, id, min(distance)::INT AS distance, 'forward' AS direction FROM w GROUP BY start, id HAVING min(distance) > 0 UNION ALL SELECT start, id, min(distance)::INT, 'backward' FROM v GROUP BY start, id HAVING min(distance) > 0")
def gr02_blast_radius(spark, sf_dir):
    return graph.blast_radius(model.edges(spark, sf_dir), _starts(spark, sf_dir), 2)


_STEPS = ", ".join(f"{n} AS (SELECT DISTINCT {b} AS id, kind AS k1 FROM edges JOIN st ON st.id = {a} WHERE kind <> 'overrides'), {n}2 AS (SELECT DISTINCT {b} AS id, k1, kind AS k2 FROM edges JOIN {n} p ON p.id = {a} WHERE kind <> 'overrides')" for n, a, b in (("o", "source_id", "target_id"), ("i", "target_id", "source_id")))
_W1, _W2 = (model.sql_case(model.PATH_WEIGHT, k, "0.5") for k in ("k1", "k2"))


@query(f""", st AS (SELECT id, 10.0 / id * 100 AS score FROM symbols WHERE kind = 'namespace'), {_STEPS},
s AS (SELECT id, 0.5 * {_W1} AS x FROM o UNION ALL SELECT id, 0.5 * {_W1} FROM i UNION ALL SELECT id, 0.25 * least({_W1}, {_W2}) FROM o2 UNION ALL SELECT id, 0.25 * least({_W1}, {_W2}) FROM i2),
g AS (SELECT id, max(x) AS x, count(*) AS n FROM s WHERE id NOT IN (SELECT id FROM st) GROUP BY id)
SELECT id, round((SELECT max(score) FROM st) * x + 0.05 * CASE WHEN n <= 4 THEN n * (n - 1) / 2 ELSE 6 + 3 * (n - 4) END, 6)::DOUBLE AS score, n AS paths FROM g""")
def gr04_structural_expansion(spark, sf_dir):
    seeds = model.symbols(spark, sf_dir).filter("kind = 'namespace'").select("id", (10.0 / F.col("id") * 100).alias("score"))
    return graph.expand(model.edges(spark, sf_dir), seeds, 2).withColumn("score", F.round("score", 6))


_MOTIF_SQL = """, dg AS (SELECT id, coalesce(co, 0) AS co, coalesce(ct, 0) AS ct, coalesce(im, 0) AS im, coalesce(ci, 0) AS ci FROM
  (SELECT source_id AS id, count(*) FILTER (kind = 'calls') AS co, count(*) FILTER (kind = 'contains') AS ct, count(*) FILTER (kind = 'implements') AS im FROM edges GROUP BY 1)
  FULL JOIN (SELECT target_id AS id, count(*) AS ci FROM edges WHERE kind = 'calls' GROUP BY 1) USING (id)),
mm AS (SELECT id, array_to_string(list_filter([CASE WHEN co >= 5 AND ci <= 2 THEN 'orchestrator' END, CASE WHEN ct >= 3 THEN 'hub' END, CASE WHEN ci >= 5 AND co <= 2 THEN 'sink' END,
  CASE WHEN co BETWEEN 1 AND 3 AND ci BETWEEN 1 AND 3 THEN 'connector' END, CASE WHEN im >= 1 AND co <= 1 THEN 'leaf' END], lambda v: v IS NOT NULL), ',') AS motifs FROM dg)"""


@query(_MOTIF_SQL + " SELECT id, motifs FROM mm WHERE motifs <> ''")
def ag18_motif_members(spark, sf_dir):
    return graph.motif_members(model.edges(spark, sf_dir)).withColumn("motifs", F.array_join("motifs", ","))


@query(_MOTIF_SQL + """, p AS (SELECT source_id, target_id, 2 * count(*) AS m FROM edges GROUP BY ALL), mo AS (SELECT id FROM mm WHERE motifs <> ''),
x AS (SELECT e.source_id IN (FROM mo) OR e.target_id IN (FROM mo) AS hm, e.source_id, e.target_id, e.kind, m, a.file_id IS DISTINCT FROM b.file_id AS xm, (a.visibility || '>' || b.visibility) IN ('public>private', 'public>protected', 'private>public') AS xv
  FROM edges e JOIN p USING (source_id, target_id) JOIN symbols a ON a.id = e.source_id JOIN symbols b ON b.id = e.target_id)
SELECT source_id, target_id, kind, m AS multiplicity, xm AS cross_module, xv AS cross_visibility, hm AS has_motif, CASE
  WHEN kind IN ('implements', 'extends') THEN CASE WHEN xv OR xm THEN 'boundary' ELSE 'direct' END
  WHEN kind IN ('calls', 'contains', 'imports') THEN CASE WHEN m >= 3 THEN 'reinforcing' WHEN hm THEN 'structural' WHEN xm OR xv THEN 'boundary' ELSE 'direct' END
  WHEN kind = 'tests' THEN 'direct' WHEN kind = 'overrides' THEN CASE WHEN xv THEN 'boundary' ELSE 'direct' END
  WHEN kind = 'references' THEN CASE WHEN m >= 3 THEN 'reinforcing' WHEN xm THEN 'structural' ELSE 'incidental' END END AS evidence FROM x""")
def gr08_evidence(spark, sf_dir):
    _, s, e = _frames(spark, sf_dir)
    return graph.evidence(s, e)


@query(_D_SQL + """ SELECT id, array_to_string(list_slice(list_filter([CASE WHEN calls_in >= 3 AND calls_out >= 3 THEN 'hub' END, CASE WHEN calls_in > 0 AND calls_out > 0 THEN 'connector' END, CASE WHEN calls_out >= 3 AND calls_in > 0 THEN 'orchestrator' END,
CASE WHEN calls_in >= 2 AND calls_out = 0 THEN 'sink' END, CASE WHEN calls_out >= 2 AND calls_in = 0 THEN 'source' END, CASE WHEN calls_in = 0 AND calls_out = 0 AND kind NOT IN ('module', 'namespace', 'class') THEN 'leaf' END,
CASE WHEN implements_out > 0 OR extends_out > 0 THEN 'transform' END, CASE WHEN tests_in > 0 AND calls_in > 0 THEN 'guard' END], lambda v: v IS NOT NULL), 1, 4), ',') AS motifs FROM d""")
def gr20_motifs(spark, sf_dir):
    _, s, e = _frames(spark, sf_dir)
    return graph.motifs(s, e, ["module", "namespace", "class"]).withColumn("motifs", F.array_join("motifs", ","))


_ROUND_SQL = """, l AS (SELECT id, file_id AS label FROM symbols WHERE file_id IS NOT NULL), k AS (SELECT source_id AS a, target_id AS b, weight AS w FROM edges UNION ALL SELECT target_id, source_id, weight FROM edges),
v AS (SELECT a AS id, label, round(sum(w), 6) AS w FROM k JOIN l ON l.id = k.b WHERE a IN (SELECT id FROM l) GROUP BY ALL), n AS (SELECT id, label FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1),
lab AS (SELECT l.id, coalesce(n.label, l.label) AS label FROM l LEFT JOIN n ON n.id = l.id)"""


def _one_round(spark, sf_dir):
    _, s, e = _frames(spark, sf_dir)
    nodes = s.filter("file_id IS NOT NULL").select("id", F.col("file_id").alias("label"))
    links = graph.oriented(e, "both").select("a", "b", F.col("weight").alias("w"))
    links = links.join(nodes.select(F.col("id").alias("a")), "a", "left_semi")
    votes = links.join(nodes.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id"), "label").agg(F.round(F.sum("w"), 6).alias("w"))
    best = votes.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("nw"), "label")).alias("v")).select("id", F.col("v.label").alias("new"))
    return nodes.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label")), e


@query(_ROUND_SQL + " SELECT id, label FROM lab")
def gr14_propagation_round(spark, sf_dir):
    return _one_round(spark, sf_dir)[0]


@query(_ROUND_SQL + """, x AS (SELECT a.label AS la, b.label AS lb FROM edges e JOIN lab a ON a.id = e.source_id JOIN lab b ON b.id = e.target_id),
y AS (SELECT la AS label, la = lb AS same FROM x UNION ALL SELECT lb, false FROM x WHERE la <> lb), c AS (SELECT label, count(*) FILTER (same) AS internal, count(*) FILTER (NOT same) AS boundary FROM y GROUP BY 1)
SELECT l.label, coalesce(internal, 0) AS internal, coalesce(boundary, 0) AS boundary, round(CASE WHEN coalesce(internal + boundary, 0) = 0 THEN 1 ELSE internal / (internal + boundary) END, 6)::DOUBLE AS cohesion FROM (SELECT DISTINCT label FROM lab) l LEFT JOIN c USING (label)""")
def ag22_cohesion(spark, sf_dir):
    labels, e = _one_round(spark, sf_dir)
    return graph.cohesion(labels, e).withColumn("cohesion", F.round("cohesion", 6))


@query(None)
def gr14_subsystems(spark, sf_dir):
    """Label propagation until nothing changes, or for 50 rounds as in the reference; no SQL."""
    from sextant.sources.listing import ensure_checkpoints

    ensure_checkpoints(spark)
    _, s, e = _frames(spark, sf_dir)
    nodes = s.filter("file_id IS NOT NULL").select("id", F.col("file_id").alias("label"))
    links = graph.oriented(e, "both").select("a", "b", F.col("weight").alias("w"))
    return graph.label_propagation(nodes, links)


@query(" SELECT a.path AS a, b.path AS b, round(list_count(list_filter(range(1, 4), lambda i: list_slice(string_split(a.path, '/'), 1, i) = list_slice(string_split(b.path, '/'), 1, i))) / 3.0, 6)::DOUBLE AS similarity FROM files a JOIN files b ON a.id < b.id")
def gr16_path_similarity(spark, sf_dir):
    from sextant.operators.joins import path_similarity

    f = model.files(spark, sf_dir)
    j = f.alias("x").join(F.broadcast(f.alias("y")), F.col("x.id") < F.col("y.id")).select(F.col("x.path").alias("a"), F.col("y.path").alias("b"))  # a row for each nation
    return j.withColumn("similarity", F.round(path_similarity(F.col("a"), F.col("b")), 6))


# scalar functions

IDENTIFIERS = [("HTTPClient", "http client"), ("sha256Hash", "sha256 hash"), ("getHTTPResponse_code", "get http response code"), ("jQuery$element", "j query element"), ("_", ""), ("rateLimitMiddleware", "rate limit middleware"), ("a.b::cDe", "a b c de")]
VARIANTS = [("queries", "queries,query"), ("boxes", "box,boxes"), ("running", "runn,runne,running"), ("handled", "handl,handled"), ("action", "acte,action"), ("movement", "move,movement"), ("is", "is")]
LITERALS = [("x = 30.0; y=0x1F z 7_000 a1 3.5", "0x1f,3.5,30,7000"), ("none", ""), ("v2 10 10", "10")]


@query("SELECT * FROM " + _values_sql("name, split", IDENTIFIERS), False)
def sf01_identifier_split(spark, sf_dir):
    return _values(spark, "name, split_", IDENTIFIERS).select("name", lexical.split_identifier(F.col("name")).alias("split"))


@query("SELECT * FROM " + _values_sql("term, variants", VARIANTS), False)
def tx23_variants(spark, sf_dir):
    return _values(spark, "term, v", VARIANTS).select("term", F.array_join(lexical.variants(F.col("term")), ",").alias("variants"))


@query("SELECT * FROM " + _values_sql("source, literals", LITERALS), False)
def sf11_numeric_literals(spark, sf_dir):
    return _values(spark, "source, v", LITERALS).select("source", F.array_join(lexical.numeric_literals(F.col("source")), ",").alias("literals"))


@query("SELECT a.vec_id, round(CASE WHEN list_dot_product(a.embedding, a.embedding) = 0 THEN 0 ELSE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END, 5) AS cosine FROM embeddings a CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) b", False)
def sf25_cosine(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("asked"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(lexical.cosine(F.col("embedding"), F.col("asked")), 5).alias("cosine"))


@query(f" SELECT id, {model.sql_case(model.DEFAULT_IMPORTANCE, 'kind', '0.5')}::DOUBLE AS importance, {model.sql_case(model.KIND_BOOST, 'kind', '1.0')}::DOUBLE AS boost, {model.sql_case(model.KIND_HINT, 'kind', 'NULL')} AS hint FROM symbols")
def sf32_kind_tables(spark, sf_dir):
    k = F.col("kind")
    return model.symbols(spark, sf_dir).select("id", model.lookup(model.DEFAULT_IMPORTANCE, k, 0.5).alias("importance"), model.lookup(model.KIND_BOOST, k, 1.0).alias("boost"), model.lookup(model.KIND_HINT, k, None).alias("hint"))


# streaming


@query(""", e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, event_id, n, t AS kept, true AS keep FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.t - w.kept >= 86400000000 THEN e.t ELSE w.kept END, e.t - w.kept >= 86400000000 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id FROM w WHERE keep""")
def sm02_debounce(spark, sf_dir):
    from sextant.streaming.watch import debounce

    return debounce(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 86_400)


@query(" SELECT 'symbols' AS artifact, (SELECT count(*) FROM symbols) AS now, 100::BIGINT AS then, (SELECT count(*) FROM symbols) <> 100 AS stale UNION ALL SELECT 'edges', (SELECT count(*) FROM edges), (SELECT count(*) FROM edges), false")
def sv11_freshness(spark, sf_dir):
    _, s, e = _frames(spark, sf_dir)
    n = s.agg(F.count("*").alias("now")).select(F.lit("symbols").alias("artifact"), "now", F.lit(100).cast("long").alias("then"))
    m = e.agg(F.count("*").alias("now")).select(F.lit("edges").alias("artifact"), "now", F.col("now").alias("then"))
    return n.unionByName(m).withColumn("stale", F.col("now") != F.col("then"))


# more lookups, counts and fixed tables


@query(" SELECT target_id AS id, count(*) AS n FROM edges WHERE kind = 'implements' GROUP BY 1")
def ag05_implements_count(spark, sf_dir):
    return model.edges(spark, sf_dir).filter("kind = 'implements'").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n"))


@query(" SELECT DISTINCT target_id AS id FROM edges WHERE kind = 'tests'")
def ag06_tested(spark, sf_dir):
    return model.edges(spark, sf_dir).filter("kind = 'tests'").select(F.col("target_id").alias("id")).distinct()


@query(" SELECT lower(name) AS name, string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM symbols GROUP BY 1 HAVING count(*) >= 3")
def ag11_collision_members(spark, sf_dir):
    g = model.symbols(spark, sf_dir).groupBy(F.lower("name").alias("name")).agg(F.sort_array(F.collect_list("id")).alias("m")).filter(F.size("m") >= 3)
    return g.select("name", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"))


@query(f" SELECT s.id, round(ln(1 + coalesce(i, 0) + coalesce(o, 0)), 6) AS degree FROM symbols s{_DEGREE_SQL}")
def ag13_structural_degree(spark, sf_dir):
    _, s, e = _frames(spark, sf_dir)
    d = s.select("id").join(graph.degrees(e).select("id", "all_in", "all_out"), "id", "left").na.fill(0)
    return d.select("id", F.round(F.log1p(F.col("all_in") + F.col("all_out")), 6).alias("degree"))


@query(" SELECT 'from' AS side, source_id, target_id, kind FROM edges WHERE source_id = 1000002 UNION ALL SELECT 'to', source_id, target_id, kind FROM edges WHERE target_id = 2000002")
def pr06_edges_of_symbol(spark, sf_dir):
    e = model.edges(spark, sf_dir)
    side = lambda name, rows: rows.select(F.lit(name).alias("side"), "source_id", "target_id", "kind")
    return side("from", e.filter("source_id = 1000002")).unionByName(side("to", e.filter("target_id = 2000002")))


@query(" SELECT source_id, target_id FROM edges WHERE kind = 'calls' ORDER BY source_id, target_id LIMIT 200")
def pr07_edges_by_kind(spark, sf_dir):
    return model.edges(spark, sf_dir).filter("kind = 'calls'").orderBy("source_id", "target_id").limit(200).select("source_id", "target_id")


@query(" SELECT s.id, s.name FROM symbols s JOIN files f ON f.id = s.file_id WHERE visibility = 'public' AND kind = 'function' AND s.id NOT IN (SELECT 2000000 + vec_id FROM embeddings)")
def pr21_embedding_candidates(spark, sf_dir):
    f, s, _ = _frames(spark, sf_dir)
    had = read(spark, sf_dir, "embeddings").select((F.col("vec_id") + 2_000_000).alias("id"))
    wanted = s.filter("visibility = 'public' AND kind = 'function'").join(f.filter(~lexical.is_test_file(F.col("path"))).select(F.col("id").alias("file_id")), "file_id")
    return wanted.join(had, "id", "left_anti").select("id", "name")


@query(" SELECT s.id, f.path FROM symbols s JOIN files f ON s.file_id = f.id")
def jn01_symbols_with_path(spark, sf_dir):
    f, s, _ = _frames(spark, sf_dir)
    return s.select("id", "file_id").join(f.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "path")


@query(""", c AS (SELECT id AS caller, file_id, source AS callee FROM symbols WHERE kind = 'function' AND source <> ''), n AS (SELECT source AS callee, file_id, min(id) AS id FROM symbols GROUP BY ALL), g AS (SELECT source AS callee, min(id) AS id FROM symbols GROUP BY 1)
SELECT caller, coalesce(n.id, g.id) AS target, n.id IS NOT NULL AS local FROM c LEFT JOIN n ON n.callee = c.callee AND n.file_id = c.file_id LEFT JOIN g ON g.callee = c.callee WHERE coalesce(n.id, g.id) <> caller""")
def jn12_file_scope_first(spark, sf_dir):
    from sextant.operators.joins import resolve

    s = model.symbols(spark, sf_dir)
    calls = s.filter("kind = 'function' AND source <> ''").select(F.col("id").alias("caller"), "file_id", F.col("source").alias("callee"))
    return resolve(calls, s.select("id", "file_id", F.col("source").alias("callee")))


@query(f" SELECT id, {model.sql_case(model.DEFAULT_IMPORTANCE, 'kind', '0.5')}::DOUBLE AS importance FROM symbols ORDER BY importance DESC, id LIMIT 500")
def so05_prewarm(spark, sf_dir):
    s = model.symbols(spark, sf_dir).select("id", model.lookup(model.DEFAULT_IMPORTANCE, F.col("kind"), 0.5).alias("importance"))
    return s.orderBy(F.desc("importance"), "id").limit(500)


@query(" SELECT file_id, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, file_id))::INT AS place FROM symbols WHERE file_id IS NOT NULL GROUP BY file_id")
def so08_cluster_order(spark, sf_dir):
    n = model.symbols(spark, sf_dir).filter("file_id IS NOT NULL").groupBy("file_id").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "file_id")))  # a row for each cluster


_HITS_SQL = ", h AS (SELECT l_orderkey % 50 AS query_id, l_linenumber % (2 + l_orderkey % 5) AS track, l_partkey AS id, l_extendedprice AS score FROM lineitem)"


def _hits(spark, sf_dir):
    """All line items as hits of a query's tracks, of which it has two to six."""
    track = (F.col("l_linenumber") % (2 + F.col("l_orderkey") % 5)).alias("track")
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("query_id"), track, F.col("l_partkey").alias("id"), F.col("l_extendedprice").alias("score"))


@query(_HITS_SQL + " SELECT query_id, id, min(track) AS stage, min_by(score, struct_pack(t := track, s := -score)) AS score FROM h GROUP BY ALL")
def st03_first_stage_wins(spark, sf_dir):
    return text.first_stage(_hits(spark, sf_dir).withColumnRenamed("track", "stage"))


@query(_HITS_SQL + ", t AS (SELECT query_id, count(DISTINCT track) AS n FROM h GROUP BY 1), g AS (SELECT query_id, id, max(score) AS s, count(*) AS c FROM h GROUP BY ALL) SELECT query_id, id, round(s * CASE WHEN c >= 2 THEN 1 + 0.3 * (c - 1) WHEN n >= 4 THEN 0.85 ELSE 1 END, 4)::DOUBLE AS score FROM g JOIN t USING (query_id) WHERE c >= 2 OR n < 5")
def st07_evidence_merge(spark, sf_dir):
    return text.merge_tracks(_hits(spark, sf_dir)).withColumn("score", F.round("score", 4))


@query(" SELECT kind, " + model.sql_case(model.PATH_WEIGHT, "kind", "0.5") + "::DOUBLE AS path_weight, " + model.sql_case(model.WALK_WEIGHT, "kind", "0.5") + "::DOUBLE AS walk_weight, kind IN ('calls', 'imports', 'references', 'contains') AS dependency FROM (SELECT DISTINCT kind FROM edges)")
def gr06_edge_weights(spark, sf_dir):
    k = F.col("kind")
    return model.edges(spark, sf_dir).select("kind").distinct().select("kind", model.lookup(model.PATH_WEIGHT, k, 0.5).alias("path_weight"), model.lookup(model.WALK_WEIGHT, k, 0.5).alias("walk_weight"), k.isin(model.DEPENDENCY_KINDS).alias("dependency"))


@query(" SELECT id, path, CASE WHEN len(string_split(path, '/')) - 2 <= 2 THEN array_to_string(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), '/') ELSE array_to_string(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 2), '/') END AS cluster, array_to_string(list_slice(string_split(path, '/'), -2, -1), '/') AS dominant FROM files")
def gr15_directory_key(spark, sf_dir):
    from sextant.operators.joins import directory_key

    return model.files(spark, sf_dir).select("id", "path", directory_key(F.col("path")).alias("cluster"), F.substring_index("path", "/", -2).alias("dominant"))


STEMS = [("queries", "queri"), ("boxes", "boxe"), ("handled", "handl"), ("running", "runn"), ("action", "act"), ("movement", "move"), ("kindness", "kind"), ("cats", "cats"), ("readable", "read"), ("parser", "pars"), ("quickly", "quick"), ("city", "citi"), ("play", "play"), ("rating", "rate"), ("go", "go"), ("formal", "form")]


@query("SELECT * FROM " + _values_sql("word, stem", STEMS), False)
def sf04_stem(spark, sf_dir):
    return _values(spark, "word, s", STEMS).select("word", lexical.stem(F.col("word")).alias("stem"))
