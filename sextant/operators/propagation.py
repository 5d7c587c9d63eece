"""Label propagation with the nodes' labels in memory and the links packed once in the shared checkpoint folder.

The links are numbered, dealt out by their node and packed to arrays of whole nodes once; a round then is one job without a shuffle, in which
each task gets all labels (four bytes a node, broadcast), counts the votes of its packs and sends the changed labels to the driver.
Weights are counted in millionths, so sums are exact in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes whose labels are held in memory; above it rounds are joins.
MAX_NODES = 10_000_000
#: Links of a pack, but for a node with more, and nodes of a task, about.
PACK_LINKS, TASK_NODES = 1_000_000, 16_384
PACKS = "nodes binary, degrees binary, others binary, codes binary, weights binary"


def micro(w: str):
    """A weight in millionths."""
    return F.coalesce(F.round(F.col(w) * 1e6), F.lit(0)).cast("long")


def pack(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> Iterator[dict[str, bytes]]:
    """Packs of the links a, b (places of nodes) and w, each with all links of its nodes."""
    order = np.argsort(a, kind="stable")
    a, b, w = a[order], b[order], w[order]
    starts = np.flatnonzero(np.diff(a, prepend=-1))
    for at in np.split(starts, np.flatnonzero(np.diff(starts // PACK_LINKS)) + 1):
        if not len(at):
            continue
        after = starts[np.searchsorted(starts, at[-1]) + 1 :][:1]
        stop = int(after[0]) if len(after) else len(a)
        weights, codes = np.unique(w[at[0] : stop], return_inverse=True)
        codes = codes.astype(np.uint16 if len(weights) <= 1 << 16 else np.uint32)
        yield {
            "nodes": a[at].astype(np.int32).tobytes(),
            "degrees": np.diff(at, append=stop).astype(np.int32).tobytes(),
            "others": b[at[0] : stop].astype(np.int32).tobytes(),
            "codes": codes.tobytes(),
            "weights": weights.astype(np.int64).tobytes(),
        }


def vote(row: dict[str, bytes], labels: np.ndarray, n_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """A pack's nodes and their labels of the most weight, the smallest of equal ones."""
    nodes, degrees, others = (np.frombuffer(row[c], np.int32) for c in ("nodes", "degrees", "others"))
    weights = np.frombuffer(row["weights"], np.int64)
    codes = np.frombuffer(row["codes"], np.uint16 if len(weights) <= 1 << 16 else np.uint32)
    key = np.repeat(np.arange(len(nodes), dtype=np.int64) * n_labels, degrees) + labels[others]
    w = weights[codes]
    if weights.min() > 0 and len(nodes) * n_labels <= 4 * len(key) + 1000:
        return nodes, np.bincount(key, w, len(nodes) * n_labels).reshape(-1, n_labels).argmax(axis=1).astype(np.int32)
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    total, key = np.add.reduceat(w[order], starts), key[order][starts]
    best = np.lexsort((key, -total, key // n_labels))
    return nodes, (key[best[np.flatnonzero(np.diff(key[best] // n_labels, prepend=-1))]] % n_labels).astype(np.int32)


def propagate(nodes: DataFrame, links: DataFrame, rounds: int) -> DataFrame:
    """As graph.label_propagation, for MAX_NODES nodes at most."""
    spark = nodes.sparkSession
    sc = spark.sparkContext
    got = nodes.filter("id IS NOT NULL").select(F.col("id").cast("long"), "label").toArrow()
    ids, (names, labels) = got.column(0).to_numpy(), np.unique(got.column(1).to_numpy(), return_inverse=True)
    del got
    order = np.lexsort((labels, ids))
    ids, labels = ids[order], labels[order].astype(np.int32)  # a row each, so that an id with more rows votes with each
    if not len(ids):
        return nodes
    unique, first, rows = np.unique(ids, return_index=True, return_counts=True)
    sent = sc.broadcast((unique, first.astype(np.int32), rows.astype(np.int32)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unique, first, rows = sent.value
        for batch in batches:
            a, b, w = (batch.column(i).to_numpy() for i in range(3))
            at, to = (np.minimum(np.searchsorted(unique, x), len(unique) - 1) for x in (a, b))
            both = np.flatnonzero((unique[at] == a) & (unique[to] == b))
            at, to, w = first[at[both]], to[both], w[both]
            n, to = rows[to], first[to]
            if len(n) and n.max() > 1:
                more = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at, to, w = np.repeat(at, n), (np.repeat(to, n) + more).astype(np.int32), np.repeat(w, n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(to), pa.array(w)], ["a", "b", "w"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(batch.column(i).to_numpy() for i in range(3)) for batch in batches]
        if parts:
            for row in pack(*(np.concatenate(x) for x in zip(*parts, strict=True))):
                yield pa.RecordBatch.from_pylist([row], pa.schema([(c, pa.binary()) for c in row]))

    numbers = links.filter("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("long"), F.col("b").cast("long"), micro("w").alias("w"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(ids) // TASK_NODES)
    packs = numbers.mapInArrow(place, "a int, b int, w long").repartition(parts, "a").mapInArrow(packed, PACKS).checkpoint()
    n_labels, spread = len(names), np.repeat(np.arange(len(unique)), rows)
    voted, before = np.zeros(len(unique), bool), None
    for i in range(rounds):
        now = sc.broadcast(labels)

        def count(batches: Iterator[pa.RecordBatch], now=now, every=i == 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    at, new = vote(row, now.value, n_labels)
                    some = np.flatnonzero(every | (new != now.value[at]))  # all once: an id may have rows of other labels
                    yield pa.RecordBatch.from_arrays([pa.array(at[some]), pa.array(new[some])], ["a", "new"])

        moved = packs.mapInArrow(count, "a int, new int").toArrow()
        now.destroy()
        earlier, before, labels = before, labels, labels.copy()
        labels[moved.column(0).to_numpy()] = moved.column(1).to_numpy()
        if i == 0:
            voted[np.searchsorted(unique, ids[moved.column(0).to_numpy()])] = True
        labels = np.where(voted[spread], labels[first[spread]], labels)
        if (labels == before).all():
            break
        if i > 1 and (labels == earlier).all():  # from here on rounds alternate: the last one is known
            labels = before if (rounds - 1 - i) % 2 else labels
            break
    last = sc.broadcast((unique, voted, names[labels[first]]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unique, voted, final = last.value
        for batch in batches:
            key = batch.column(0).fill_null(0).to_numpy()
            at = np.minimum(np.searchsorted(unique, key), len(unique) - 1)
            mine = voted[at] & (unique[at] == key) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            new = pc.if_else(pa.array(mine), pa.array(final[at], batch.column(1).type), batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), new], ["id", "label"])

    return nodes.select("id", "label").mapInArrow(label, nodes.select("id", "label").schema)
