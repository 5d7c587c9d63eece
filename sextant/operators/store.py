"""The store as whole tables: upserts, inserts, deletions with what depends on them, key-value metadata, manifests.

Every operator returns the table after the change; writing it beside the old one and switching the folder makes it one transaction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions.lexical import split_identifier
from sextant.model import DEFAULT_IMPORTANCE, lookup


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old's rows whose keys new doesn't have, and new's."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """old, and the first row by order of each of new's keys that old doesn't have."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(*keys).distinct(), keys, "left_anti"))


def delete_files(files: DataFrame, symbols: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the files (path) in gone, their symbols, and the edges of these."""
    ids = files.join(gone.select("path"), "path", "left_semi").select(F.col("id").alias("file_id"))
    lost = symbols.join(ids, "file_id", "left_semi").select("id")
    edges = edges.join(lost.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(lost.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return files.join(gone.select("path"), "path", "left_anti"), symbols.join(ids, "file_id", "left_anti"), edges


def built_symbols(symbols: DataFrame) -> DataFrame:
    """symbols with the words of the name, the hash of the source and the kind's importance."""
    importance = lookup(DEFAULT_IMPORTANCE, F.col("kind"), 0.5)
    return symbols.withColumns({"name_decomposed": split_identifier(F.col("name")), "content_hash": F.sha2("source", 256), "importance": importance})


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("overwrite").json(path)  # one row


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The manifest, or None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
