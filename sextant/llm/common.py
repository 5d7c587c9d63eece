"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that separates words: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
#: Whether the files of a query's shuffles go when its action ends.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder of spark.checkpoint.dir. Where none is set, a local master gets a folder of its own, and a cluster an error,
    since its executors share no local folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sextant-"))


_collected = [0.0]


def collect_garbage(spark: SparkSession, every_s: float = 5.0) -> None:
    """Has the driver drop plans, broadcasts and classes of finished queries, which else fill its heap to the limit and lie beside it."""
    if time.monotonic() - _collected[0] >= every_s:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage; a lost executor doesn't lose it.

    The shuffles that made df are of no more use then, and their files are removed at once rather than when the driver collects garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(REMOVE_SHUFFLES)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query of its own, so that df can still be run by itself
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)
        collect_garbage(spark)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared checkpoint folder, read again: compressed, and without lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    at = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(df: DataFrame, more: str) -> T.StructType:
    """df's schema and the fields of a DDL string."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of df is called so (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def identity(*columns: str) -> Column:
    """Two 64-bit hashes of the columns' values with nulls apart from all others; equal only for equal rows, but for a chance of 2 ** -128 a pair."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c).cast("string"))]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


#: Rows of a table with a row for each group that are broadcast without more ado.
BROADCAST_GROUPS = 20_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: str, how: str = "inner", broadcast_groups: int = BROADCAST_GROUPS, part: int = 500) -> DataFrame:
    """rows joined on key with groups, which has one row for each group and the group's size in column n.

    Few groups are broadcast. Otherwise the groups that hold more than a part-th of all rows, of which there are fewer than `part`, are
    broadcast, so that no hot key is shuffled, and the rest is joined by a shuffle.
    """
    size = groups.agg(F.count("*"), F.coalesce(F.sum(n), F.lit(0))).first()
    if size[0] <= broadcast_groups:
        return rows.join(F.broadcast(groups), key, how)
    limit = max(100, size[1] // part)
    hot = groups.filter(F.col(n) > limit)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(F.col(n) <= limit), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, whatever the optimizer does with projections."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order; null gives none."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5)
    return F.filter(F.split(flat, " "), lambda w: w != "")


def chunks(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with about max_bytes of text each (one row at least), and the texts as UTF-8."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(texts):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            part = batch.slice(start, stop - start)
            yield part, texts.slice(start, stop - start).cast(pa.large_binary()).to_pylist()
            start = stop
