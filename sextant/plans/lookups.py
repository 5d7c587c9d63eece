"""Queries of the store, the point lookups and the predicates, with the DuckDB SQL of the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sextant import model
from sextant.functions import lexical
from sextant.model import read
from sextant.operators import graph, store
from sextant.plans.registry import _MOTIF_SQL, _ROUND_SQL, ORACLES, _frames, _one_round, query

# paths and kinds for each part, so that every rule has cases that it takes and others

_STEMS = ["index", "mod", "lib", "main", "public", "Index", "test_a", "a_test", "b.spec", "cli", "bench", "util", "server", "app", "Public"]
_KINDS = list(model.DEFAULT_IMPORTANCE)
_PART_SQL = ", pt AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'src' WHEN 1 THEN 'pkg/tests' ELSE 'web' END || '/' || (" + repr(_STEMS) + f")[(p_partkey % {len(_STEMS)})::INT + 1] || '.rs' AS path, (" + repr(_KINDS) + f")[(p_partkey % {len(_KINDS)})::INT + 1] AS kind FROM part)"


def _parts(spark, sf_dir):
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    k = F.col("p_partkey") % 3
    folder = F.when(k == 0, "src").when(k == 1, "pkg/tests").otherwise("web")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(folder, F.lit("/"), pick(_STEMS), F.lit(".rs")).alias("path"), pick(_KINDS).alias("kind"))


@query(" SELECT * FROM symbols WHERE id = 2000007")
def pr01_symbol_by_id(spark, sf_dir):
    return model.symbols(spark, sf_dir).filter("id = 2000007")


@query(" SELECT id, name, kind FROM symbols WHERE name = 'GERMANY' ORDER BY id")
def pr02_symbols_by_name(spark, sf_dir):
    return model.symbols(spark, sf_dir).filter("name = 'GERMANY'").orderBy("id").select("id", "name", "kind")


@query(" SELECT s.id, f.path FROM symbols s JOIN files f ON f.id = s.file_id WHERE contains(f.path, 'asia/')")
def pr09_file_filter(spark, sf_dir):
    f, s, _ = _frames(spark, sf_dir)
    return s.join(f.filter(F.contains("path", F.lit("asia/"))).select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "path")


@query("WITH m AS (SELECT o_orderkey AS id, '{\"literal\":\"' || o_custkey || '\",\"n\":' || o_orderkey || '}' AS metadata FROM orders) SELECT id, metadata FROM m WHERE metadata LIKE '%\"literal\":\"12%'", False)
def pr10_literal_in_metadata(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(F.col("o_custkey").cast("string").alias("literal"), F.col("o_orderkey").alias("n"))).alias("metadata"))
    return o.filter(F.startswith(F.get_json_object("metadata", "$.literal"), F.lit("12")))


@query(_PART_SQL + " SELECT id, lower(path) LIKE '%test%' OR lower(path) LIKE '%spec%' AS is_test, regexp_matches(lower(path), '/(index|mod|lib|main|public)[.]') AS is_public FROM pt")
def pr13_public_api_files(spark, sf_dir):
    p = F.col("path")
    return _parts(spark, sf_dir).select("id", lexical.is_dead_code_test_file(p).alias("is_test"), lexical.is_public_api_file(p).alias("is_public"))


@query(_PART_SQL + ", l AS (SELECT *, '/' || lower(path) AS p FROM pt) SELECT id, contains(p, '/main.') OR contains(p, '/index.') OR contains(p, '/app.') OR contains(p, '/server.') OR contains(p, '/mod.') OR contains(p, '/lib.') AS is_entry, list_count(list_filter(['/test', '/tests/', '/__tests__/', '/spec/', '_test.', '_spec.', '.test.', '.spec.', 'test_', '/benches/', '/benchmark/'], lambda x: contains(p, x))) > 0 AS is_test FROM l")
def pr15_entry_points(spark, sf_dir):
    p = F.concat(F.lit("/"), "path")
    return _parts(spark, sf_dir).select("id", lexical.is_entry_point(p).alias("is_entry"), lexical.is_test_file(p).alias("is_test"))


@query(_PART_SQL + " SELECT id, kind, kind IN ('module', 'namespace', 'section', 'import') AS container, kind IN ('struct', 'class', 'enum', 'interface', 'trait') AS definition, kind IN ('class', 'struct', 'interface', 'trait', 'enum', 'module', 'namespace') AS indexed_container FROM pt")
def pr16_kind_predicates(spark, sf_dir):
    k = F.col("kind")
    return _parts(spark, sf_dir).select("id", "kind", k.isin(lexical.CONTAINERS).alias("container"), k.isin(lexical.DEFINITIONS).alias("definition"), k.isin(lexical.INDEXED_CONTAINERS).alias("indexed_container"))


@query("WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents), l AS (SELECT word, lower(word) AS x FROM w) SELECT word FROM l WHERE contains(x, 'error') OR contains(x, 'exception') OR contains(x, 'fault') OR x LIKE 'err%' OR x LIKE '%err'", False)
def pr19_error_types(spark, sf_dir):
    w = read(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).filter(lexical.is_error_type(F.col("word")))
    return w.distinct()


@query("SELECT doc_id, list_count(list_filter(['error', 'panic', 'invalid', 'timeout', 'shutdown', 'closed', 'refused', 'unauthorized', 'forbidden', 'not found', 'already', 'overflow', 'deadlock'], lambda x: contains(lower(text), x))) > 0 AS is_error FROM documents", False)
def pr20_error_literals(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", lexical.is_error_literal(F.col("text")).alias("is_error"))


@query(" SELECT 'path' AS by_what, id, path FROM files WHERE path = 'src/asia/china.rs' UNION ALL SELECT 'id', id, path FROM files WHERE id = 7")
def pr23_file_lookup(spark, sf_dir):
    f = model.files(spark, sf_dir).select("id", "path")
    side = lambda name, rows: rows.select(F.lit(name).alias("by_what"), "id", "path")
    return side("path", f.filter("path = 'src/asia/china.rs'")).unionByName(side("id", f.filter("id = 7")))


@query(" SELECT path FROM files WHERE id = 3")
def pr24_path_of_file(spark, sf_dir):
    return model.files(spark, sf_dir).filter("id = 3").select("path")


@query(" SELECT id, path FROM files")
def pr25_file_paths(spark, sf_dir):
    return model.files(spark, sf_dir).select("id", "path")


# joins


@query(" , t AS (SELECT DISTINCT id, unnest(string_split(lower(source), ' ')) AS term FROM symbols WHERE source <> '') SELECT t.term, s.id, s.name FROM t JOIN symbols s ON s.id = t.id WHERE t.term IN ('small', 'building', 'brand#13')")
def jn02_hits_with_symbols(spark, sf_dir):
    s = model.symbols(spark, sf_dir)
    hits = s.filter("source <> ''").select("id", F.explode(F.split(F.lower("source"), " ")).alias("term")).filter(F.col("term").isin("small", "building", "brand#13")).distinct()
    return hits.join(s.select("id", "name"), "id").select("term", "id", "name")


@query(" SELECT target_id, e.kind, count(*) AS n, min(s.name) AS first_name, max(s.name) AS last_name FROM edges e JOIN symbols s ON source_id = s.id GROUP BY ALL")
def jn04_incoming_grouped(spark, sf_dir):
    _, s, e = _frames(spark, sf_dir)
    j = e.join(s.select(F.col("id").alias("source_id"), "name"), "source_id")
    return j.groupBy("target_id", "kind").agg(F.count("*").alias("n"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


@query("WITH c AS (SELECT p_size AS value, min_by(p_name, p_partkey) AS name FROM part GROUP BY 1) SELECT l_orderkey, l_linenumber, coalesce(c.name, '') AS constant FROM lineitem LEFT JOIN c ON c.value = l_quantity", False)
def jn22_literal_to_constant(spark, sf_dir):
    constants = read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("value")).agg(F.min_by("p_name", "p_partkey").alias("name"))
    used = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("value"))
    return used.join(constants, "value", "left").select("l_orderkey", "l_linenumber", F.coalesce("name", F.lit("")).alias("constant"))


# the store


@query(" , nw AS (SELECT path, 'v2' AS hash FROM files WHERE path LIKE '%asia%' UNION ALL SELECT 'src/new/' || r_regionkey || '.rs', 'v2' FROM region) SELECT path, 'v1' AS hash FROM files WHERE path NOT IN (SELECT path FROM nw) UNION ALL SELECT * FROM nw")
def sc21_upsert_files(spark, sf_dir):
    f = model.files(spark, sf_dir)
    old, again = f.select("path", F.lit("v1").alias("hash")), f.filter("path LIKE '%asia%'").select("path", F.lit("v2").alias("hash"))
    more = read(spark, sf_dir, "region").select(F.concat(F.lit("src/new/"), F.col("r_regionkey").cast("string"), F.lit(".rs")).alias("path"), F.lit("v2").alias("hash"))
    return store.upsert(old, again.unionByName(more), ["path"])


_FILE_EDGES_SQL = " , fe AS (SELECT a.file_id AS s, b.file_id AS t, e.kind FROM edges e JOIN symbols a ON a.id = source_id JOIN symbols b ON b.id = target_id WHERE a.file_id <> b.file_id)"


@query(_FILE_EDGES_SQL + " SELECT DISTINCT s AS source_file_id, t AS target_file_id, kind FROM fe")
def sc25_file_edges(spark, sf_dir):
    _, s, e = _frames(spark, sf_dir)
    for side in ("source", "target"):
        e = e.join(s.select(F.col("id").alias(f"{side}_id"), F.col("file_id").alias(f"{side}_file_id")), f"{side}_id")
    return e.filter("source_file_id <> target_file_id").select("source_file_id", "target_file_id", "kind").distinct()


_GONE_SQL = " , gs AS (SELECT s.id FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.path LIKE 'src/asia/%')"


@query(_GONE_SQL + " SELECT id FROM symbols WHERE id NOT IN (FROM gs)")
def sc26_delete_symbols_of_files(spark, sf_dir):
    f, s, e = _frames(spark, sf_dir)
    rest = store.delete_files(f, s.filter("file_id IS NOT NULL"), e, f.filter("path LIKE 'src/asia/%'"))[1]
    return rest.select("id").unionByName(s.filter("file_id IS NULL").select("id"))


@query(_GONE_SQL + " SELECT 'file' AS what, id AS a, 0::BIGINT AS b, '' AS kind FROM files WHERE path NOT LIKE 'src/asia/%' UNION ALL SELECT 'edge', source_id, target_id, kind FROM edges WHERE source_id NOT IN (FROM gs) AND target_id NOT IN (FROM gs)")
def sc28_delete_files(spark, sf_dir):
    f, s, e = _frames(spark, sf_dir)
    files, _, edges = store.delete_files(f, s, e, f.filter("path LIKE 'src/asia/%'"))
    left = files.select(F.lit("file").alias("what"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit("").alias("kind"))
    return left.unionByName(edges.select(F.lit("edge").alias("what"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), "kind"))


@query("SELECT o_custkey AS key, max_by(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1", False)
def sc30_key_value(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max_by("o_totalprice", "o_orderkey").alias("value"))


@query(" SELECT id, CASE WHEN kind = 'class' THEN 'role ' || lower(name) ELSE '' END AS search_hints FROM symbols")
def sc32_update_hints(spark, sf_dir):
    s = model.symbols(spark, sf_dir)
    hints = s.filter("kind = 'class'").select("id", F.concat(F.lit("role "), F.lower("name")).alias("search_hints"))
    return store.upsert(s.select("id", F.lit("").alias("search_hints")), hints, ["id"])


@query("SELECT vec_id, len(embedding)::INT AS dimension, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings", False)
def sc34_embedding_scan(spark, sf_dir):
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dimension"), F.round(total, 4).alias("total"))


@query("SELECT vec_id, embedding[1]::DOUBLE AS first FROM embeddings WHERE vec_id IN (SELECT n_nationkey FROM nation)", False)
def sc35_embedding_batch(spark, sf_dir):
    ids = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("vec_id"))
    return read(spark, sf_dir, "embeddings").join(ids, "vec_id", "left_semi").select("vec_id", F.element_at("embedding", 1).cast("double").alias("first"))


@query(" SELECT vec_id FROM embeddings WHERE vec_id + 2000000 NOT IN (SELECT id FROM symbols WHERE file_id = 4)")
def sc39_delete_embeddings_of_file(spark, sf_dir):
    gone = model.symbols(spark, sf_dir).filter("file_id = 4").select((F.col("id") - 2_000_000).alias("vec_id"))
    return read(spark, sf_dir, "embeddings").join(gone, "vec_id", "left_anti").select("vec_id")


@query(" SELECT 1 AS version, (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols")
def sc36_manifest(spark, sf_dir):
    """Written beside the store and read again."""
    from sextant.sources.listing import ensure_checkpoints

    ensure_checkpoints(spark)
    f, s, _ = _frames(spark, sf_dir)
    manifest = f.agg(F.count("*").alias("files")).crossJoin(s.agg(F.count("*").alias("symbols"))).select(F.lit(1).alias("version"), "files", "symbols")
    at = f"{spark.sparkContext.getCheckpointDir()}/manifest-{uuid.uuid4().hex}"
    store.write_manifest(manifest, at)
    return store.read_manifest(spark, at, "version int, files long, symbols long")


@query(f" SELECT id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS name_decomposed, sha256(source) AS content_hash, {model.sql_case(model.DEFAULT_IMPORTANCE, 'kind', '0.5')}::DOUBLE AS importance FROM symbols")
def sc42_symbol_rows(spark, sf_dir):
    return store.built_symbols(model.symbols(spark, sf_dir)).select("id", "name_decomposed", "content_hash", "importance")


# sets and orders


@query(" , f1 AS (SELECT DISTINCT l_orderkey % 50 AS query_id, l_partkey AS id FROM lineitem), f2 AS (SELECT DISTINCT o_orderkey % 50 AS query_id, o_custkey AS id FROM orders) SELECT * FROM f2 EXCEPT SELECT * FROM f1")
def st05_difference(spark, sf_dir):
    found = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("query_id"), F.col("l_partkey").alias("id"))
    asked = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("query_id"), F.col("o_custkey").alias("id")).distinct()
    return asked.join(found.distinct(), ["query_id", "id"], "left_anti")


@query("WITH p AS (SELECT p_partkey AS id, list_distinct(string_split(lower(p_type), ' ')) AS a, list_distinct(string_split(lower(p_name), ' ')) AS b FROM part) SELECT id, round(len(list_intersect(a, b)) / least(len(a), len(b)), 6)::DOUBLE AS overlap FROM p", False)
def st06_overlap(spark, sf_dir):
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(lexical.overlap(words("p_type"), words("p_name")), 6).alias("overlap"))


@query(_ROUND_SQL + """, dg AS (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1), lt AS (SELECT label, sum(n)::BIGINT AS total FROM lab JOIN dg USING (id) GROUP BY 1)
SELECT id, label, total FROM lab JOIN lt USING (label) ORDER BY total DESC, id LIMIT 20""")
def so06_hubs(spark, sf_dir):
    """Twenty symbols by the edges of their whole cluster."""
    labels, e = _one_round(spark, sf_dir)
    both = graph.oriented(e, "both").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
    total = labels.join(both, "id").groupBy("label").agg(F.sum("n").alias("total"))
    return labels.join(total, "label").orderBy(F.desc("total"), "id").limit(20).select("id", "label", "total")


_EVIDENCE_SQL = ORACLES["gr08_evidence"].removeprefix(f"WITH RECURSIVE {model.MODEL_SQL}")
_BEFORE, _CASES = _EVIDENCE_SQL.rsplit("SELECT source_id, target_id, kind, m AS multiplicity", 1)
_EV_SQL = _BEFORE + ", ev AS (SELECT source_id, target_id, kind, m AS multiplicity" + _CASES + ")"


@query(_EV_SQL + " SELECT id, evidence, count(*) AS n FROM (SELECT source_id AS id, evidence FROM ev UNION ALL SELECT target_id, evidence FROM ev) GROUP BY ALL")
def ag23_evidence_histogram(spark, sf_dir):
    _, s, e = _frames(spark, sf_dir)
    ev = graph.evidence(s, e)
    return ev.select(F.explode(F.array("source_id", "target_id")).alias("id"), "evidence").groupBy("id", "evidence").agg(F.count("*").alias("n"))


def _weights(query_name: str, table: dict):
    sql = _EV_SQL + f" SELECT source_id, target_id, kind, {model.sql_case(table, 'evidence', '1.0')}::DOUBLE AS weight FROM ev"

    def run(spark, sf_dir):
        _, s, e = _frames(spark, sf_dir)
        return graph.evidence(s, e).select("source_id", "target_id", "kind", model.lookup(table, F.col("evidence"), 1.0).alias("weight"))

    run.__name__ = query_name
    return query(sql)(run)


gr17_cluster_weights = _weights("gr17_cluster_weights", model.CLUSTER_WEIGHT)
gr33_retrieval_weights = _weights("gr33_retrieval_weights", model.RETRIEVAL_WEIGHT)


@query(_MOTIF_SQL + " SELECT t.motif, count(*) AS n FROM (SELECT unnest(string_split(motifs, ',')) AS motif FROM mm WHERE motifs <> '') t GROUP BY 1")
def ag18_motif_counts(spark, sf_dir):
    return graph.motif_members(model.edges(spark, sf_dir)).select(F.explode("motifs").alias("motif")).groupBy("motif").agg(F.count("*").alias("n"))


@query(" SELECT id, '{\"kind\":\"' || kind || '\",\"file\":' || coalesce(file_id::VARCHAR, '0') || '}' AS metadata, kind AS read_back FROM symbols")
def sf23_json(spark, sf_dir):
    """Metadata as JSON, and a field read back from it."""
    s = model.symbols(spark, sf_dir).select("id", F.to_json(F.struct("kind", F.coalesce("file_id", F.lit(0)).alias("file"))).alias("metadata"))
    return s.withColumn("read_back", F.get_json_object("metadata", "$.kind"))


@query(_ROUND_SQL + " , rt AS (SELECT label, count(*) AS members FROM lab GROUP BY 1) SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM rt) AS clusters, (SELECT max(members) FROM rt) AS largest")
def sv09_status(spark, sf_dir):
    f, s, e = _frames(spark, sf_dir)
    clusters = _one_round(spark, sf_dir)[0].groupBy("label").agg(F.count("*").alias("members")).agg(F.count("*").alias("clusters"), F.max("members").alias("largest"))
    counts = [x.agg(F.count("*").alias(n)) for x, n in ((f, "files"), (s, "symbols"), (e, "edges"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2]).crossJoin(clusters)  # one row each


@query(" , h AS (SELECT source_id, target_id, kind, row_number() OVER (PARTITION BY source_id ORDER BY kind, target_id) AS place FROM edges WHERE source_id BETWEEN 1000000 AND 1999999) SELECT source_id, kind, count(*) AS n, count(*) FILTER (place <= 20) AS listed FROM h GROUP BY ALL")
def sv04_context_counts(spark, sf_dir):
    """Outgoing edges of each class by kind, and how many of them a context of 20 lists."""
    e = model.edges(spark, sf_dir).filter("source_id BETWEEN 1000000 AND 1999999")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("kind", "target_id"))
    return e.withColumn("place", place).groupBy("source_id", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("place") <= 20).alias("listed"))
