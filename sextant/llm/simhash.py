"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a Hamming radius through vantage-point trees.

Fingerprints are reduced to the distinct ones first, so a group of copies is one point. A vantage-point tree over a bounded sample
(tree_sample points) splits the space of fingerprints into shards: at each node a point is inside or outside a ball around
the vantage point. Every fingerprint is stored in its own shard, and asks all shards that its ball of the radius may reach by
the triangle inequality and that are numbered above its own, so each close pair meets in exactly one shard. The first tree has
MAX_SHARDS shards at most; a shard that holds too many points then is split again by a tree made in a task from a sample of its own, in the
same way. A shard is searched by a tree over all its points, pruned alike. Found pairs are joined in a forest, so a shard sends no more
links than it has points. Components come from alternating star joins in Spark, where nodes with very many links are joined by a
broadcast; no links or fingerprints but the samples' trees reach the driver.

Documents of a word-shingle similarity of 0.8 lie 4 to 14 of 64 bits apart, and unrelated ones 32 with a deviation of 4, so no
triangle bound prunes at that radius. near_duplicates therefore serves the radius of a fingerprint contract, and
similar_documents serves a similarity: fingerprints of WIDE bits, sharded by the documents' smallest shingle hashes (two
documents of similarity s share one of the `keys_per_doc` smallest but for about (1 - s) ** keys_per_doc of the pairs), linked
within each shard through a vantage-point tree over its points. There the points of clusters of near copies lie far from the others, so balls
around them are cut off; where no ball saves a tenth of the comparisons, all points are compared. That only finds candidates, with a reach well beyond the mean of the similarity. The sets of shingle hashes of
documents with a candidate are then made again and compared within each component of candidates; a link is a pair whose
Jaccard similarity, counted exactly, is high enough. Shards and components above block_rows (or block_shingles) are cut into blocks,
and each pair of blocks is a group of its own.

Edge cases: a null or empty text has no words and fingerprint zero, linked like any other; fewer words than a shingle make one
shingle; null ids take part and never become a component's id unless all its ids are null; repeated rows get the same result;
an empty table gives no rows; other columns are ignored by fingerprints and kept by drop_near_duplicates, whatever they are called.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import chunks, identity, join_groups, materialize, table, with_fields

SHINGLE = 3
SEED = 42
#: Points of a shard's part that are compared all with all.
LEAF = 256
#: Shards of the first tree, and of each tree of the second level, at most.
MAX_SHARDS, MAX_PARTS = 2048, 512


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """As a signed 64-bit integer."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)], np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, keys: list[str], shingle: int = SHINGLE) -> DataFrame:
    """keys and fingerprint (long) of (keys, text)."""
    out = df.select(*keys, "text")
    schema = with_fields(out.drop("text"), "fingerprint long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches, "text"):
            prints = pa.array([fingerprint(t, shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keys)], prints], [*keys, "fingerprint"])

    return out.mapInArrow(run, schema)


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64)).astype(np.int16)


class VantageTree:
    """Shards of the fingerprints' space, from a sample."""

    def __init__(self, sample: np.ndarray, n_leaves: int, seed: int = 0):
        self.nodes: list[tuple[np.int64, int, int, int]] = []  # vantage point, radius, inside, outside: nodes, or ~shard
        self.n_leaves = 0
        rng = np.random.default_rng(seed)

        def grow(points: np.ndarray, leaves: int) -> int:
            split = _split(points, rng) if leaves > 1 else None
            if split is None:
                self.n_leaves += 1
                return ~(self.n_leaves - 1)
            vantage, radius, d = split
            at = len(self.nodes)
            self.nodes.append((vantage, radius, 0, 0))
            inside = grow(points[d <= radius], leaves // 2)
            outside = grow(points[d > radius], leaves - leaves // 2)
            self.nodes[at] = (vantage, radius, inside, outside)
            return at

        self.root = grow(np.asarray(sample, np.int64), n_leaves)
        self.nodes = np.array(self.nodes, [("vantage", np.int64), ("radius", np.int16), ("inside", np.int32), ("outside", np.int32)])

    def place(self, points: np.ndarray, reach: int, guests: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The point's index, a shard, and if it's the point's own; of the shards within reach those above its own are given, and all to guests, which own none."""
        found: list[tuple[np.ndarray, int, np.ndarray]] = []

        def walk(node: int, at: np.ndarray, own: np.ndarray) -> None:
            if not len(at):
                return
            if node < 0:
                found.append((at, ~node, own))
                return
            vantage, radius, inside, outside = self.nodes[node]
            d = distance(points[at], vantage)
            near, far = d - reach <= radius, d + reach > radius
            walk(inside, at[near], (own & (d <= radius))[near])
            walk(outside, at[far], (own & (d > radius))[far])

        walk(self.root, np.arange(len(points)), np.ones(len(points), bool))
        at = np.concatenate([a for a, _, _ in found]) if found else np.zeros(0, np.int64)
        shard = np.concatenate([np.full(len(a), s, np.int64) for a, s, _ in found]) if found else np.zeros(0, np.int64)
        own = np.concatenate([o for _, _, o in found]) if found else np.zeros(0, bool)
        if guests:
            return at, shard, np.zeros(len(at), bool)
        home = np.zeros(len(points), np.int64)
        home[at[own]] = shard[own]
        keep = own | (shard > home[at])
        return at[keep], shard[keep], own[keep]


def _split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.int64, int, np.ndarray] | None:
    """A vantage point with the widest spread of distances, the median distance and the distances; None if nothing splits."""
    if len(points) < 2:
        return None
    best = None
    some = points if len(points) <= 2000 else points[rng.integers(0, len(points), 2000)]
    for vantage in points[rng.integers(0, len(points), 5)]:
        spread = distance(some, vantage).std()
        if best is None or spread > best[0]:
            best = (spread, vantage)
    d = distance(points, best[1])
    radius = int(np.median(d))
    if (d <= radius).all():
        radius -= 1
    return None if not 0 < (d <= radius).sum() < len(d) else (best[1], radius, d)


def close_pairs(stored: np.ndarray, asking: np.ndarray, reach: int, leaf: int = LEAF, seed: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (asking, stored) of all pairs within reach, by a tree over the stored points."""
    rng = np.random.default_rng(seed)
    stack = [(np.arange(len(stored)), np.arange(len(asking)))]
    while stack:
        s, a = stack.pop()
        if not len(s) or not len(a):
            continue
        split = _split(stored[s], rng) if len(s) > leaf else None
        if split is not None:
            vantage, radius, d = split
            q = distance(asking[a], vantage)
            near, far = a[q - reach <= radius], a[q + reach > radius]
            if len(near) + len(far) < 1.9 * len(a):  # else nothing is pruned: compare all
                stack += [(s[d <= radius], near), (s[d > radius], far)]
                continue
        step = max(1, 2_000_000 // len(s))
        for i in range(0, len(a), step):
            part = a[i : i + step]
            x, y = np.nonzero(distance(asking[part][:, None], stored[s][None, :]) <= reach)
            yield part[x], s[y]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index linked with each of n indices."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for xs, ys in pairs:
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(n)], np.int64)


PLACED = "shard long, fingerprint long, own boolean"


def _split_again(placed: DataFrame, reach: int, shard_points: int, sample: int = 16_384) -> DataFrame:
    """placed with shards above 8 * shard_points points split by trees of their own, one a shard, made in tasks."""
    sizes = placed.filter("own").groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > 8 * shard_points)
    sizes = materialize(sizes)  # MAX_SHARDS rows at most
    some = placed.filter("own").join(F.broadcast(sizes), "shard").filter(F.pmod(F.xxhash64(F.lit(3), "fingerprint"), F.col("n")) < sample)

    def grow(group: pa.Table) -> pa.Table:
        n = group.column("n")[0].as_py()
        tree = VantageTree(np.sort(group.column("fingerprint").to_numpy()), min(MAX_PARTS, -(-n // shard_points)))
        return pa.table({"shard": group.column("shard").slice(0, 1), "tree": [pickle.dumps(tree)]})

    grown = some.select("shard", "fingerprint", "n").groupBy("shard").applyInArrow(grow, "shard long, tree binary")
    trees = {r["shard"]: pickle.loads(r["tree"]) for r in grown.collect()}  # MAX_SHARDS trees of MAX_PARTS nodes at most, 20 bytes a node
    sent = placed.sparkSession.sparkContext.broadcast(trees)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, prints, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for one in np.unique(shard):
                tree = sent.value.get(int(one))
                for home in (True, False):
                    at = np.flatnonzero((shard == one) & (own == home))
                    if not len(at):
                        continue
                    which, part, mine = (at, np.zeros(len(at), np.int64), own[at]) if tree is None else tree.place(prints[at], reach, not home)
                    which = at if tree is None else at[which]
                    yield pa.RecordBatch.from_arrays([pa.array(one * MAX_PARTS + part), pa.array(prints[which]), pa.array(mine)], ["shard", "fingerprint", "own"])

    return placed.repartition("shard").sortWithinPartitions("shard").mapInArrow(place, PLACED)


def links(points: DataFrame, reach: int = 2, shard_points: int = 512, tree_sample: int = 65_536, max_shards: int = MAX_SHARDS) -> DataFrame:
    """a, b (fingerprints, a > b): a forest in each shard that connects all distinct fingerprints within reach; points: fingerprint."""
    n = points.count()
    rows = points.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(tree_sample).collect()  # bounded
    leaves = max(1, min(-(-n // shard_points), max_shards))
    tree = VantageTree(np.array([r["fingerprint"] for r in rows], np.int64), leaves)
    sent = points.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy()
            at, shard, own = sent.value.place(prints, reach)
            for i in range(0, len(at), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(shard[part]), pa.array(prints[at[part]]), pa.array(own[part])], ["shard", "fingerprint", "own"])

    def search(group: pa.Table) -> pa.Table:
        prints, own = group.column("fingerprint").to_numpy(), group.column("own").to_numpy()
        stored, asking = np.flatnonzero(own), np.arange(len(prints))
        pairs = ((asking[x], stored[y]) for x, y in close_pairs(prints[stored], prints, reach))
        top = forest(len(prints), pairs)
        linked = np.flatnonzero(top != np.arange(len(prints)))
        x, y = prints[linked], prints[top[linked]]
        return pa.table({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    placed = materialize(points.select("fingerprint").mapInArrow(place, PLACED))
    return _split_again(placed, reach, shard_points).groupBy("shard").applyInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node linked) of the nodes of edges (a > b) that aren't roots, by alternating star joins."""

    def checked(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = materialize(df.distinct())
        return df, tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())

    def met(rows: DataFrame, least: DataFrame, limit: int) -> DataFrame:
        """rows with the least of their a; the few nodes with more than limit links are broadcast."""
        hot = least.filter(F.col("n") > limit)
        rest = rows.join(F.broadcast(hot.select("a")), "a", "left_anti").join(least.filter(F.col("n") <= limit), "a")
        return rows.join(F.broadcast(hot), "a").unionByName(rest)

    edges, before = checked(edges.select("a", "b").filter("a <> b"))
    while True:
        limit = max(100, before[0] // 500)  # 1,000 nodes at most have more links
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        large = met(both.filter("b > a"), least, limit).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small_least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = met(large, small_least, limit).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b"))).filter("a <> b")
        edges, after = checked(small)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def near_duplicates(df: DataFrame, keys: list[str], id_column: str = "doc_id", reach: int = 2, shingle: int = SHINGLE) -> DataFrame:
    """keys, fingerprint and component_id (smallest id of the component) of (keys, text); keys include the id."""
    prints = materialize(fingerprints(df, keys, shingle))
    points = materialize(prints.groupBy("fingerprint").agg(F.min(id_column).alias("_least"), F.count("*").alias("_n")))
    roots = components(links(points, reach))
    rooted = points.join(roots, points["fingerprint"] == roots["node"], "left").select("fingerprint", "_least", "_n", F.coalesce("root", "fingerprint").alias("_root"))
    rooted = materialize(rooted)
    least = materialize(rooted.groupBy("_root").agg(F.min("_least").alias("component_id"), F.count("*").alias("_members")))
    found = materialize(join_groups(rooted, least, "_root", "_members").select("fingerprint", "component_id", "_n"))
    return join_groups(prints, found, "fingerprint", "_n").drop("_n")


WIDE = 512
#: Odd multipliers that turn one hash into WIDE / 64 streams: multiples of a fixed odd number.
STREAMS = (np.arange(WIDE // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """The distinct shingles' hashes in order; zero stands for a text without words."""
    import xxhash

    words = (text or b"").lower().split()
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)] if words else [0], np.uint64))


def wide_fingerprint(h: np.ndarray) -> bytes:
    """A fingerprint of WIDE bits over the distinct shingles' hashes."""
    ones = np.zeros(WIDE, np.int64)
    for i in range(0, len(h), 4096):
        mixed = h[i : i + 4096, None] * STREAMS[None, :]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes()


def wide_reach(similarity: float, slack: float = 0.1) -> int:
    """Differing bits of WIDE of candidates: the mean of pairs of a similarity (Jaccard; equal sizes, which differ most), and six deviations."""
    cosine = 2 * similarity / (1 + similarity)
    return int(WIDE * (np.arccos(cosine) / np.pi + slack))


def _wide_close(x: np.ndarray, y: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and y (rows of words) of all pairs within reach."""
    d = np.zeros((len(x), len(y)), np.uint16)
    for k in range(x.shape[1]):
        d += np.bitwise_count(x[:, k][:, None] ^ y[:, k][None, :])
    return np.nonzero(d <= reach)


def _wide_split(bits: np.ndarray, at: np.ndarray, reach: int, rng: np.random.Generator) -> tuple[np.ndarray, ...] | None:
    """Points inside and outside a ball around a vantage point, and those of each that the triangle inequality lets have a pair on the other side.

    The radius is the one that leaves the fewest comparisons; None if a tenth of them can't be saved.
    """
    best, n = None, len(at)
    for vantage in at[rng.integers(0, n, 5)]:
        d = np.bitwise_count(bits[at] ^ bits[vantage]).sum(axis=1, dtype=np.int64)
        up_to = np.cumsum(np.bincount(d, minlength=WIDE + 1))
        r = np.arange(WIDE + 1)
        below = np.where(r >= reach, up_to[np.maximum(r - reach, 0)], 0)
        inside, low, high = up_to, up_to - below, up_to[np.minimum(r + reach, WIDE)] - up_to
        cost = np.where((inside > 0) & (inside < n), inside**2 / 2 + (n - inside) ** 2 / 2 + low * high, np.inf)
        if best is None or cost.min() < best[0]:
            best = (cost.min(), int(cost.argmin()), d)
    cost, radius, d = best
    if cost > 0.9 * n**2 / 2:
        return None
    return at[d <= radius], at[d > radius], at[(d <= radius) & (d > radius - reach)], at[(d > radius) & (d <= radius + reach)]


def wide_pairs(wide: list[bytes], reach: int, leaf: int = LEAF, seed: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of all pairs within reach, each once, by a vantage-point tree over the points."""
    bits = np.frombuffer(b"".join(wide), np.uint64).reshape(len(wide), -1)
    rng = np.random.default_rng(seed)
    stack: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(wide)), None)]
    while stack:
        at, other = stack.pop()
        split = _wide_split(bits, at, reach, rng) if other is None and len(at) > leaf else None
        if split is not None:
            inside, outside, low, high = split
            stack += [(low, high), (outside, None), (inside, None)]
            continue
        step = max(1, 500_000 // max(1, len(at) if other is None else len(other)))
        for i in range(0, len(at), step):
            to = at[i:] if other is None else other
            x, y = _wide_close(bits[at[i : i + step]], bits[to], reach)
            once = x < y if other is None else slice(None)
            yield at[i : i + step][x[once]], to[y[once]]


def verified_forest(wide: list[bytes], sets: list[np.ndarray], reach: int, similarity: float, batch: int = 64) -> np.ndarray:
    """The smallest index linked with each set by pairs within reach whose Jaccard similarity, counted exactly, is high enough."""
    size = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(size)
    distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(ids, ends[:-1])
    top, marked = np.arange(len(sets)), np.zeros(len(distinct), bool)
    for xs, ys in wide_pairs(wide, reach):
        enough = np.minimum(size[xs], size[ys]) >= similarity * np.maximum(size[xs], size[ys]) - 1e-6
        xs, ys = xs[enough], ys[enough]
        if not len(xs):
            continue
        starts = np.flatnonzero(np.diff(xs, prepend=-1))
        for x, asked in zip(xs[starts].tolist(), np.split(ys, starts[1:]), strict=True):
            marked[own[x]] = True
            while len(asked := asked[top[asked] != top[x]]):  # linked ones needn't be counted
                part, asked = asked[:batch], asked[batch:]
                both = np.add.reduceat(marked[np.concatenate([own[y] for y in part])], np.cumsum(size[part]) - size[part], dtype=np.int64)
                for y in part[both >= similarity * (size[x] + size[part] - both) - 1e-6].tolist():
                    a, b = top[x], top[y]
                    if a != b:
                        top[top == max(a, b)] = min(a, b)
            marked[own[x]] = False
    return top


ROW_BITS = 24


def row_bitmap(rows: DataFrame) -> np.ndarray:
    """A bit for each value of _row, in a map of fixed size that is put together in Spark by word of 32 bits."""
    bit = rows.select(F.shiftrightunsigned("_row", 64 - ROW_BITS).alias("b"))
    got = bit.groupBy(F.shiftright("b", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(b & 31 AS INT)))").alias("v")).toArrow()
    out = np.zeros(1 << (ROW_BITS - 5), np.uint32)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().astype(np.uint32)
    return out


def _block_pairs(rows: DataFrame) -> DataFrame:
    """A row for each pair of blocks (_met) of its group in which a row (node, _blocks) takes part."""
    own = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("_blocks")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda b: F.struct(F.least(b, own).alias("i"), F.greatest(b, own).alias("j")))
    return rows.withColumn("_met", F.explode(met)).drop("_blocks")


def _as_links(nodes: np.ndarray, top: np.ndarray) -> pa.Table:
    linked = np.flatnonzero(top != np.arange(len(nodes)))
    x, y = nodes[linked], nodes[top[linked]]
    return pa.table({"a": np.maximum(x, y), "b": np.minimum(x, y)})


def similar_documents(df: DataFrame, keys: list[str], similarity: float = 0.8, shingle: int = 5, keys_per_doc: int = 6, block_rows: int = 4096, block_shingles: int = 2_000_000) -> DataFrame:
    """keys, node (long, the same for equal sets of shingles) and root (the smallest node of the component) of (keys, text)."""
    import xxhash

    source = df.select(*keys, "text", F.xxhash64(*keys).alias("_row"))
    schema = with_fields(source.drop("text"), "wide binary, smallest array<long>, n_shingles long, node long")
    node_of = lambda h: np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64).item()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches, "text"):
            made = []
            for t in texts:
                h = shingle_hashes(t, shingle)
                made.append((wide_fingerprint(h), h[:keys_per_doc].view(np.int64).tolist(), len(h), node_of(h)))
            wide, smallest, n, node = zip(*made, strict=True)
            more = [pa.array(wide, pa.binary()), pa.array(smallest, pa.list_(pa.int64())), pa.array(n, pa.int64()), pa.array(node, pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keys)], rows.column(len(keys) + 1), *more], schema.names)

    prints = materialize(source.mapInArrow(run, schema))
    some = [F.first(c).alias(c) for c in ("wide", "smallest", "n_shingles")]
    points = materialize(prints.groupBy("node").agg(*some, F.min("_row").alias("_row")))
    rows = points.select("node", "wide", F.explode("smallest").alias("shard"))
    sizes = rows.groupBy("shard").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_blocks"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    reach = wide_reach(similarity)

    def search(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_numpy()
        return _as_links(nodes, forest(len(nodes), wide_pairs(group.column("wide").to_pylist(), reach)))

    def verify(group: pa.Table) -> pa.Table:
        nodes, at = np.unique(group.column("node").to_numpy(), return_index=True)
        group = group.take(pa.array(at))
        sets = [np.frombuffer(b, np.uint64) for b in group.column("hashes").to_pylist()]
        return _as_links(nodes, verified_forest(group.column("wide").to_pylist(), sets, reach, similarity))

    shards = _block_pairs(rows.join(sizes, "shard"))
    found = components(shards.groupBy("shard", "_met").applyInArrow(search, "a long, b long"))
    members = found.select("node", F.col("root").alias("candidates")).unionByName(found.select(F.col("root").alias("node"), F.col("root").alias("candidates")).distinct())
    members = materialize(members.join(points.select("node", "wide", "n_shingles", "_row"), "node"))
    sent = df.sparkSession.sparkContext.broadcast(row_bitmap(members))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in batches:
            b = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - ROW_BITS)).astype(np.int64)
            hit = np.flatnonzero((bitmap[b >> 5] >> (b & 31).astype(np.uint32)) & 1)
            if len(hit):
                for _, texts in chunks([batch.take(pa.array(hit))], "text"):
                    sets = [shingle_hashes(t, shingle) for t in texts]
                    yield pa.RecordBatch.from_arrays([pa.array([node_of(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["_node", "hashes"])

    sets = source.select("_row", "text").mapInArrow(hashes, "_node long, hashes binary")
    blocks = F.ceil(F.greatest(F.count("*") / block_rows, F.sum("n_shingles") / block_shingles)).cast("int")
    groups = members.groupBy("candidates").agg(blocks.alias("_blocks"))
    whole = members.select("node", "candidates", "wide").join(groups, "candidates").join(sets, F.col("node") == F.col("_node")).drop("_node")
    exact = _block_pairs(whole).groupBy("candidates", "_met").applyInArrow(verify, "a long, b long")
    roots = components(exact)
    joined = prints.select(*keys, "node").join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    return joined.select(*keys, "node", F.coalesce("root", "node").alias("root"))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """docs with one document of each group of similar ones (the smallest id), all columns kept."""
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_user"), F.col("doc_id").alias("_id"), identity("doc_id", "text").alias("_key"))
    found = similar_documents(keyed.select("_id", "_key", F.col("_user.text").alias("text")), ["_id", "_key"], similarity, shingle)
    stay = found.groupBy("root").agg(F.min(F.struct("_id", "_key")).alias("w")).select(F.col("w._key").alias("_key"))
    kept = keyed.join(stay, "_key", "left_semi")  # repeated rows of a document that stays are told apart by nothing but their other columns
    return kept.groupBy("_key").agg(F.first("_user").alias("_user")).select("_user.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents")
    found = near_duplicates(docs, ["doc_id"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
