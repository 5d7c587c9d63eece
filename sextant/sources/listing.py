"""Files as rows: listing, hashes, changes, chunks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.lexical import language

# Directories that are never indexed.
SKIPPED = ["node_modules", ".git", "target", "dist", "build", "vendor", "__pycache__", ".venv", "venv", ".next", ".cache", "coverage"]


def ensure_checkpoints(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; where it is unset, a local master gets a folder of its own and a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sextant-"))


def project_files(spark: SparkSession, root: str) -> DataFrame:
    """path, language, content_hash, mtime_ms, line_count and text of the source files below root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    skipped = "/(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + r")/|-bundle|\.min\."
    text = F.col("content").cast("string")
    rows = found.filter(~F.col("path").rlike(skipped)).select(
        "path",
        language(F.col("path")).alias("language"),
        F.sha2("content", 256).alias("content_hash"),
        F.unix_millis("modificationTime").alias("mtime_ms"),
        F.size(F.split(text, "\n")).alias("line_count"),
        text.alias("text"),
    )
    return rows.filter("language <> 'unknown'")


def changed_files(new: DataFrame, old: DataFrame) -> DataFrame:
    """new's rows whose content isn't in old under the same path, with status new or changed."""
    had = old.select("path", F.col("content_hash").alias("_old"))
    out = new.join(had, "path", "left").filter(~F.col("content_hash").eqNullSafe(F.col("_old")))
    return out.withColumn("status", F.when(F.col("_old").isNull(), "new").otherwise("changed")).drop("_old")


def line_chunks(texts: DataFrame, key: str, most: int = 50) -> DataFrame:
    """key, chunk, first, last (lines from 1) and source: each text in parts of at most `most` lines."""
    lines = F.split("text", "\n", -1)
    starts = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / most))
    parts = F.transform(starts, lambda c: F.struct(c.alias("chunk"), F.slice(lines, (c * most + 1).cast("int"), F.lit(most)).alias("l")))
    c = texts.select(key, F.explode(parts).alias("p"))
    first = F.col("p.chunk") * most + 1
    return c.select(key, F.col("p.chunk").alias("chunk"), first.alias("first"), (first + F.size("p.l") - 1).alias("last"), F.array_join("p.l", "\n").alias("source"))
