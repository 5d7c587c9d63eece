"""Sharding: a uniform shuffle into shards whose sizes are exact, by a hypergeometric communication matrix.

Rows fall into blocks by a hash. How many rows each block sends to each shard is drawn from the law that a uniform random
permutation would give (multivariate hypergeometric, row sums: the blocks' counts, column sums: the shards' sizes). Each block
is permuted locally and cut into runs of those lengths, the runs are exchanged, and each shard is permuted again.

The draw is deterministic for a seed, so recomputed tasks agree. Only the blocks' counts reach the driver, and the matrix has max_cells
numbers at most: in a larger table blocks have more rows than rows_per_block (each is sorted by one task, which spills). A number is
drawn in a steady number of steps, some 10 microseconds. Edge cases: rows with a null id or text and repeated rows are dealt like any others (rows that
are equal in all columns can change places without a difference); an empty table gives no rows; other columns are ignored, and the
given ones are kept whatever they are called (shard and slot get underscores in front where the table has such columns).
"""

from __future__ import annotations

import itertools
import json
import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import fresh, materialize, table


def _by_inversion(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Inversion outwards from the mode; takes as many steps as the law is wide."""
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    up = lambda k: (good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1))  # noqa: E731  p(k + 1) / p(k)
    weights, k, w = {mode: 1.0}, mode, 1.0
    while k < high and w > 1e-18:
        w *= up(k)
        k += 1
        weights[k] = w
    k, w = mode, 1.0
    while k > low and w > 1e-18:
        w /= up(k - 1)
        k -= 1
        weights[k] = w
    u, last = rng.random() * math.fsum(weights.values()), mode
    for last, w in weights.items():
        u -= w
        if u < 0:
            break
    return last


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """The number of good ones among draws without replacement: by inversion where the law is narrow, else by ratio of uniforms (a steady number of steps)."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    n = good + bad
    spread = math.sqrt(draws * (good / n) * (bad / n) * (n - draws) / max(1, n - 1))
    if spread < 20:
        return _by_inversion(rng, good, bad, draws)
    mean, mode = draws * good / n, (draws + 1) * (good + 1) // (n + 2)
    log_p = lambda k: -math.lgamma(k + 1) - math.lgamma(good - k + 1) - math.lgamma(draws - k + 1) - math.lgamma(bad - draws + k + 1)
    top, width = log_p(mode), 2 * math.sqrt(2 / math.e) * math.sqrt(spread * spread + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log_p(k) - top:
            return k


def communication_matrix(rows: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Counts by block and shard with these margins, as a uniform permutation gives them."""
    rng, left, out = random.Random(seed), list(sizes), []
    for n in rows:
        line, rest = [], sum(left)
        for m in left:
            k = hypergeometric(rng, m, rest - m, n)
            line.append(k)
            rest -= m
            n -= k
        left = [a - b for a, b in zip(left, line, strict=True)]
        out.append(line)
    return out


def shuffle_into_shards(df: DataFrame, columns: list[str], n_shards: int, seed: int = 0, rows_per_block: int = 1_000_000, min_blocks: int = 64, max_cells: int = 1_000_000) -> DataFrame:
    """The given columns with shard (int, from 0) and slot (long, gapless from 0 in each shard); shard sizes differ by one at most."""
    chosen = df.select(*columns)
    shard, slot = fresh(chosen, "shard", "slot")
    key = chosen.select(F.struct(*columns).alias("_row"), F.xxhash64(F.lit(seed), *columns).alias("_k"))
    total = key.count()
    n_blocks = max(1, min(max_cells // n_shards, max(min_blocks, -(-total // rows_per_block))))
    key = key.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + 1), "_k"), F.lit(n_blocks)).cast("int"))
    found = {r["_block"]: r["n"] for r in key.groupBy("_block").agg(F.count("*").alias("n")).collect()}  # n_blocks rows at most
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([found.get(b, 0) for b in range(n_blocks)], sizes, seed)
    ends = [list(itertools.accumulate(line)) for line in matrix]
    cuts = F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>")
    rank = F.row_number().over(Window.partitionBy("_block").orderBy("_k", "_row"))
    dealt = key.withColumn("_rank", rank).withColumn("_shard", F.size(F.filter(F.element_at(cuts, F.col("_block") + 1), lambda end: end < F.col("_rank"))))
    n_parts = max(1, -(-max(sizes, default=0) // rows_per_block))
    second = F.xxhash64(F.lit(seed + 2), "_k")
    dealt = dealt.select("_row", "_shard", second.alias("_k"), F.pmod(F.shiftright(second, 17), F.lit(n_parts)).alias("_part"))
    place = F.row_number().over(Window.partitionBy("_shard", "_part").orderBy("_k", "_row")).cast("long") - 1
    out = lambda rows, at: rows.select("_row.*", F.col("_shard").alias(shard), at.alias(slot))
    if n_parts == 1:
        return out(dealt.withColumn("_slot", place), F.col("_slot"))
    dealt = materialize(dealt)
    counts = dealt.groupBy("_shard", "_part").agg(F.count("*").alias("_n"))  # a row for each rows_per_block rows
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_shard", "_part", before.alias("_before"))
    return out(dealt.withColumn("_slot", place).join(offsets, ["_shard", "_part"]), F.col("_slot") + F.col("_before"))


def op9_shard(spark: SparkSession, sf_dir: str, n_shards: int = 40) -> DataFrame:
    """All documents in 40 shards with equal counts of rows."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffle_into_shards(docs, ["doc_id", "size", "text_crc32"], n_shards, seed=9)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
