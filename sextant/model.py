"""The property graph of a corpus: fixed value tables, schemas, and its reading from the driver's tables.

files(id, path, language), symbols(id, file_id, name, kind, visibility, line_start, line_end, signature, source) and
edges(source_id, target_id, kind, weight). MODEL_SQL is the same reading as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# They must equal those of the format that is read.
PATH_WEIGHT = {"calls": 1.00, "contains": 0.90, "implements": 0.80, "extends": 0.80, "overrides": 0.75, "references_constant": 0.60, "shares_error_type": 0.55, "tests": 0.55, "imports": 0.50, "re_exports": 0.45, "shares_type": 0.40, "references": 0.40, "shares_data_shape": 0.35, "shares_constant": 0.30}
WALK_WEIGHT = {"calls": 1.0, "references": 0.8, "imports": 0.6, "contains": 0.7, "extends": 0.9, "implements": 0.9, "tests": 0.3}
DEPENDENCY_KINDS = ["calls", "imports", "references", "contains"]
RETRIEVAL_WEIGHT = {"direct": 1.0, "boundary": 1.0, "reinforcing": 0.85, "structural": 0.7, "incidental": 0.3}
CLUSTER_WEIGHT = {"direct": 1.5, "boundary": 1.2, "reinforcing": 1.0, "structural": 0.8, "incidental": 0.1}
DEFAULT_IMPORTANCE = {"function": 0.9, "method": 0.85, "constructor": 0.85, "destructor": 0.7, "class": 0.85, "interface": 0.85, "struct": 0.8, "enum": 0.75, "enum_variant": 0.6, "trait": 0.85, "type_alias": 0.65, "module": 0.5, "namespace": 0.5, "constant": 0.7, "field": 0.6, "property": 0.65, "macro": 0.7, "import": 0.3, "export": 0.4, "section": 0.2}
KIND_BOOST = {"function": 1.3, "method": 1.3, "constructor": 1.3, "class": 1.2, "struct": 1.2, "interface": 1.2, "trait": 1.2, "enum": 1.1, "type_alias": 1.1, "constant": 0.9, "field": 0.9, "property": 0.9, "module": 0.7, "section": 0.7}
KIND_HINT = {"function": "function", "method": "method", "class": "class", "struct": "struct", "interface": "interface", "trait": "trait definition", "enum": "enum", "module": "module"}
LANGUAGE_OF = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "rs": "rust", "py": "python", "pyi": "python", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "qml": "qml", "rb": "ruby", "md": "markdown", "mdx": "markdown", "json": "json", "jsonc": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml", "html": "html", "htm": "html", "css": "css", "less": "css", "scss": "scss", "sass": "scss", "sh": "shell", "bash": "shell", "zsh": "shell", "fish": "shell", "sql": "sql", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "cs": "csharp", "php": "php", "lua": "lua", "dart": "dart", "scala": "scala", "sc": "scala", "hs": "haskell", "ex": "elixir", "exs": "elixir", "zig": "zig", "xml": "xml", "svg": "xml", "xsl": "xml", "xslt": "xml", "graphql": "graphql", "gql": "graphql", "proto": "protobuf"}
#: Kind of an edge by l_linenumber, for the driver's tables.
KIND_OF_LINE = ["calls", "references", "imports", "implements", "extends", "tests", "overrides"]


def lookup(table: dict, key: Column, default) -> Column:
    """A value by key, as one map literal."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def sql_case(table: dict, key: str, default: str) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in table.items()) + f" ELSE {default} END"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    path = F.concat(F.lit("src/"), F.lower("r_name"), F.lit("/"), F.lower("n_name"), F.lit(".rs"))
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").cast("long").alias("id"), path.alias("path"), F.lit("rust").alias("language"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(table: str, base: int, key: str, file: Column, name: str, kind: str, source: Column) -> DataFrame:
        return read(spark, sf_dir, table).select((F.col(key).cast("long") + base).alias("id"), file.cast("long").alias("file_id"), F.col(name).alias("name"), F.lit(kind).alias("kind"), source.alias("source"))

    none = F.lit("")
    size = F.concat_ws(" ", "p_type", "p_brand", F.col("p_size").cast("string"))
    parts = [
        rows("region", 0, "r_regionkey", F.lit(None), "r_name", "module", none),
        rows("nation", 100, "n_nationkey", F.col("n_nationkey"), "n_name", "namespace", none),
        rows("supplier", 1_000_000, "s_suppkey", F.col("s_nationkey"), "s_name", "class", none),
        rows("part", 2_000_000, "p_partkey", F.col("p_partkey") % 25, "p_name", "function", size),
        rows("customer", 3_000_000, "c_custkey", F.col("c_nationkey"), "c_name", "function", F.col("c_mktsegment")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    third = F.col("id") % 3
    return out.select(
        "*",
        F.when(third == 0, "private").when(third == 1, "public").otherwise("protected").alias("visibility"),
        (F.col("id") % 997 + 1).alias("line_start"),
        (F.col("id") % 997 + 1 + F.col("id") % 13).alias("line_end"),
        F.concat(F.lit("fn "), F.col("name")).alias("signature"),
    )


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, target_id, kind and seq (order of writing), with repetitions."""
    r = lambda t: read(spark, sf_dir, t)
    line = r("lineitem")
    kind = F.element_at(F.array(*map(F.lit, KIND_OF_LINE)), F.col("l_linenumber"))
    edge = lambda df, a, b, k, s: df.select(a.cast("long").alias("source_id"), b.cast("long").alias("target_id"), k.alias("kind"), s.cast("long").alias("seq"))
    contains, zero = F.lit("contains"), F.lit(0)
    bought = line.join(r("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return (
        edge(r("nation"), F.col("n_regionkey"), F.col("n_nationkey") + 100, contains, zero)
        .unionByName(edge(r("supplier"), F.col("s_nationkey") + 100, F.col("s_suppkey") + 1_000_000, contains, zero))
        .unionByName(edge(r("customer"), F.col("c_nationkey") + 100, F.col("c_custkey") + 3_000_000, contains, zero))
        .unionByName(edge(line, F.col("l_suppkey") + 1_000_000, F.col("l_partkey") + 2_000_000, kind, F.col("l_orderkey")))
        .unionByName(edge(bought, F.col("o_custkey") + 3_000_000, F.col("l_partkey") + 2_000_000, kind, F.col("l_orderkey")))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge for each source, target and kind, with its path weight."""
    keys = ["source_id", "target_id", "kind"]
    return raw_edges(spark, sf_dir).select(*keys).distinct().withColumn("weight", lookup(PATH_WEIGHT, F.col("kind"), 0.5))


_KIND_SQL = "CASE l_linenumber " + " ".join(f"WHEN {i + 1} THEN '{k}'" for i, k in enumerate(KIND_OF_LINE)) + " END"
MODEL_SQL = f"""
files AS (SELECT n_nationkey::BIGINT AS id, 'src/' || lower(r_name) || '/' || lower(n_name) || '.rs' AS path, 'rust' AS language
  FROM nation JOIN region ON n_regionkey = r_regionkey),
symbols0 AS (
  SELECT r_regionkey::BIGINT AS id, NULL::BIGINT AS file_id, r_name AS name, 'module' AS kind, '' AS source FROM region
  UNION ALL SELECT 100 + n_nationkey, n_nationkey, n_name, 'namespace', '' FROM nation
  UNION ALL SELECT 1000000 + s_suppkey, s_nationkey, s_name, 'class', '' FROM supplier
  UNION ALL SELECT 2000000 + p_partkey, p_partkey % 25, p_name, 'function', p_type || ' ' || p_brand || ' ' || p_size FROM part
  UNION ALL SELECT 3000000 + c_custkey, c_nationkey, c_name, 'function', c_mktsegment FROM customer),
symbols AS (SELECT *, CASE id % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'public' ELSE 'protected' END AS visibility,
  id % 997 + 1 AS line_start, id % 997 + 1 + id % 13 AS line_end, 'fn ' || name AS signature FROM symbols0),
raw_edges AS (
  SELECT n_regionkey::BIGINT AS source_id, (n_nationkey + 100)::BIGINT AS target_id, 'contains' AS kind, 0::BIGINT AS seq FROM nation
  UNION ALL SELECT s_nationkey + 100, s_suppkey + 1000000, 'contains', 0 FROM supplier
  UNION ALL SELECT c_nationkey + 100, c_custkey + 3000000, 'contains', 0 FROM customer
  UNION ALL SELECT l_suppkey + 1000000, l_partkey + 2000000, {_KIND_SQL}, l_orderkey FROM lineitem
  UNION ALL SELECT o_custkey + 3000000, l_partkey + 2000000, {_KIND_SQL}, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS (SELECT DISTINCT source_id, target_id, kind, {sql_case(PATH_WEIGHT, "kind", "0.5")}::DOUBLE AS weight FROM raw_edges)
"""
