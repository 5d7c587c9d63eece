"""Operators over edges: bounded traversal, blast radius, evidence, motifs, clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.model import DEPENDENCY_KINDS, PATH_WEIGHT, lookup
from sextant.operators import propagation
from sextant.sources.listing import ensure_checkpoints


def oriented(edges: DataFrame, direction: str = "out", kinds: list[str] | None = None) -> DataFrame:
    """a, b, kind and weight of the edges to follow."""
    e = edges.filter(F.col("kind").isin(kinds)) if kinds else edges
    out = e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "kind", "weight")
    back = e.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), "kind", "weight")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def bounded_bfs(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out", kinds: list[str] | None = None, paths: str = "shortest") -> DataFrame:
    """start, id, distance (and with paths="all" the kinds passed) of what starts (id) reach in at most depth steps.

    "shortest" keeps each node once for each start, by a frontier that leaves visited nodes out; "all" has a row for each distinct path
    of kinds and walks cycles up to the depth, so its rows can grow with a power of the degree.
    """
    step = oriented(edges, direction, kinds)
    if paths == "all":
        rows = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("distance"), F.array().cast("array<string>").alias("path"))
        parts = []
        for d in range(1, depth + 1):
            rows = rows.join(step, F.col("id") == F.col("a")).select("start", F.col("b").alias("id"), F.lit(d).alias("distance"), F.concat("path", F.array("kind")).alias("path")).distinct()
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts)
    links = step.select("a", "b").distinct()
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("distance"))
    frontier = seen
    for d in range(1, depth + 1):
        new = frontier.join(links, F.col("id") == F.col("a")).select("start", F.col("b").alias("id")).distinct()
        frontier = new.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("distance", F.lit(d))
        if d > 2 or depth > 3:  # deeper walks are cut into plans of one step each
            ensure_checkpoints(edges.sparkSession)
            frontier = frontier.checkpoint()
        seen = seen.unionByName(frontier)
    return seen.filter("distance > 0")


def blast_radius(edges: DataFrame, starts: DataFrame, depth: int = 2, kinds: list[str] | None = None) -> DataFrame:
    """What starts depend on (forward: without tests and implements) and what depends on them (backward), with distances."""
    kinds = kinds or DEPENDENCY_KINDS
    forward = bounded_bfs(edges, starts, depth, "out", [k for k in kinds if k not in ("tests", "implements")])
    backward = bounded_bfs(edges, starts, depth, "in", kinds)
    return forward.withColumn("direction", F.lit("forward")).unionByName(backward.withColumn("direction", F.lit("backward")))


def decay(distance: Column) -> Column:
    return F.when(distance == 0, 1.0).when(distance == 1, 0.5).when(distance == 2, 0.25).otherwise(0.1)


#: The kinds that expansion follows.
EXPANSION_KINDS = ["calls", "contains", "implements", "extends", "imports", "references", "tests"]


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """id, score and paths of what seeds (id, score) reach outwards or inwards: the best seed score times decay times the least path weight, and a
    bonus of 0.05 for the second, 0.10 for the third and 0.15 for each further path.

    A path is a distinct row of edge kinds, whatever nodes it passes, so a node has a bounded number of paths for a given depth.
    """
    found = None
    for direction in ("out", "in"):
        step = oriented(edges, direction, EXPANSION_KINDS).select("a", "b", "kind").distinct()
        rows = seeds.select("id", F.array().cast("array<string>").alias("path"))
        for d in range(1, depth + 1):
            rows = rows.join(step, F.col("id") == F.col("a")).select(F.col("b").alias("id"), F.concat("path", F.array("kind")).alias("path")).distinct()
            part = rows.withColumn("distance", F.lit(d))
            found = part if found is None else found.unionByName(part)
    best = seeds.agg(F.greatest(F.max("score"), F.lit(0.0)).alias("best"))
    least = F.array_min(F.transform("path", lambda k: lookup(PATH_WEIGHT, k, 0.5)))
    scored = found.join(seeds.select("id"), "id", "left_anti").withColumn("s", decay(F.col("distance")) * least)
    n = F.col("paths")
    bonus = 0.05 * F.when(n <= 4, n * (n - 1) / 2).otherwise(6 + 3 * (n - 4))
    total = scored.groupBy("id").agg(F.max("s").alias("s"), F.count("*").alias("paths")).crossJoin(F.broadcast(best))  # one row
    return total.select("id", (F.col("best") * F.col("s") + bonus).alias("score"), "paths")


def degrees(edges: DataFrame) -> DataFrame:
    """id with calls, references, contains and other counts in and out."""
    def side(column: str, way: str) -> DataFrame:
        kinds = ("calls", "contains", "imports", "implements", "extends", "tests", "references")
        return edges.groupBy(F.col(column).alias("id")).agg(*[F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"{k}_{way}") for k in kinds], F.count("*").alias(f"all_{way}"))

    joined = side("source_id", "out").join(side("target_id", "in"), "id", "full")
    return joined.na.fill(0)


def importance(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """id and importance: weighted roots of relative call and contain degrees, relative imports, and a bonus for both call degrees."""
    d = symbols.select("id").join(degrees(edges), "id", "left").na.fill(0)
    top = d.agg(F.greatest(F.max("calls_in"), F.lit(1)).alias("mi"), F.greatest(F.max("calls_out"), F.lit(1)).alias("mo"), F.greatest(F.max("contains_out"), F.lit(1)).alias("mc"), F.greatest(F.max("imports_in"), F.lit(1)).alias("mm"))
    ratio = lambda a, b: F.sqrt(a) / F.sqrt(b)
    score = 0.35 * ratio("calls_in", "mi") + 0.20 * ratio("calls_out", "mo") + 0.20 * ratio("contains_out", "mc") + 0.15 * F.col("imports_in") / F.col("mm") + F.when((F.col("calls_in") > 0) & (F.col("calls_out") > 0), 0.10).otherwise(0.0)
    return d.crossJoin(F.broadcast(top)).select("id", F.least(F.lit(1.0), score).alias("importance"))


def motifs(symbols: DataFrame, edges: DataFrame, containers: list[str]) -> DataFrame:
    """id and up to four motifs, in the order of the rules."""
    d = symbols.select("id", "kind").join(degrees(edges), "id", "left").na.fill(0)
    i, o, c = F.col("calls_in"), F.col("calls_out"), F.col("kind").isin(containers)
    rules = [("hub", (i >= 3) & (o >= 3)), ("connector", (i > 0) & (o > 0)), ("orchestrator", (o >= 3) & (i > 0)), ("sink", (i >= 2) & (o == 0)), ("source", (o >= 2) & (i == 0)), ("leaf", (i == 0) & (o == 0) & ~c), ("transform", (F.col("implements_out") > 0) | (F.col("extends_out") > 0)), ("guard", (F.col("tests_in") > 0) & (i > 0))]
    return d.select("id", F.slice(F.array_compact(F.array(*[F.when(r, n) for n, r in rules])), 1, 4).alias("motifs"))


def motif_members(edges: DataFrame) -> DataFrame:
    """id and motifs (array) of the symbols that their call, containment and implementation degrees put in one."""
    out = edges.groupBy(F.col("source_id").alias("id")).agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("calls", "co"), ("contains", "ct"), ("implements", "im"))])
    into = edges.filter("kind = 'calls'").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("ci"))
    d = out.join(into, "id", "full").na.fill(0)
    co, ci, ct, im = (F.col(c) for c in ("co", "ci", "ct", "im"))
    rules = [("orchestrator", (co >= 5) & (ci <= 2)), ("hub", ct >= 3), ("sink", (ci >= 5) & (co <= 2)), ("connector", co.between(1, 3) & ci.between(1, 3)), ("leaf", (im >= 1) & (co <= 1))]
    return d.select("id", F.array_compact(F.array(*[F.when(r, n) for n, r in rules])).alias("motifs")).filter(F.size("motifs") > 0)


def evidence(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge with multiplicity (each edge counts from both sides), cross_module, cross_visibility, has_motif and evidence."""
    member = motif_members(edges).select("id", F.lit(True).alias("in_motif"))
    s = symbols.select("id", "file_id", "visibility").join(member, "id", "left").withColumn("in_motif", F.coalesce("in_motif", F.lit(False)))
    pair = edges.groupBy("source_id", "target_id").agg((2 * F.count("*")).alias("multiplicity"))
    e = edges.join(pair, ["source_id", "target_id"])
    for side in ("source", "target"):
        e = e.join(s.select(F.col("id").alias(f"{side}_id"), F.col("file_id").alias(f"{side}_file"), F.col("visibility").alias(f"{side}_vis"), F.col("in_motif").alias(f"{side}_motif")), f"{side}_id")
    xm = ~F.col("source_file").eqNullSafe(F.col("target_file"))
    pairs = F.concat_ws(">", "source_vis", "target_vis")
    motif = F.col("source_motif") | F.col("target_motif")
    xv, m, k = pairs.isin("public>private", "public>protected", "private>public"), F.col("multiplicity"), F.col("kind")
    kind = (
        F.when(k.isin("implements", "extends"), F.when(xv | xm, "boundary").otherwise("direct"))
        .when(k.isin("calls", "contains", "imports"), F.when(m >= 3, "reinforcing").when(motif, "structural").when(xm | xv, "boundary").otherwise("direct"))
        .when(k == "tests", "direct")
        .when(k == "overrides", F.when(xv, "boundary").otherwise("direct"))
        .when(k.isin("references", "shares_constant"), F.when(m >= 3, "reinforcing").when(xm, "structural").otherwise("incidental"))
        .when(k == "re_exports", F.when(xm, "boundary").otherwise("direct"))
        .when(k == "references_constant", F.when(xm, "structural").otherwise("direct"))
        .when(k == "shares_type", F.when(xm, "structural").otherwise("incidental"))
        .when(k == "shares_error_type", F.when(xm, "boundary").otherwise("structural"))
        .otherwise(F.when(m >= 3, "reinforcing").otherwise("incidental"))
    )
    return e.select("source_id", "target_id", "kind", "multiplicity", xm.alias("cross_module"), xv.alias("cross_visibility"), motif.alias("has_motif"), kind.alias("evidence"))


def label_propagation(nodes: DataFrame, links: DataFrame, rounds: int = 50) -> DataFrame:
    """id and label: synchronous weighted propagation from nodes (id, label) over links (a, b, w), ties to the smallest label.

    Links of other ids than the nodes' don't count. It ends when nothing changes or after `rounds`. The links are written to the checkpoint
    folder once and labels kept in memory (see propagation); above MAX_NODES nodes each round is a join, written to that folder.
    """
    ensure_checkpoints(nodes.sparkSession)
    labels = nodes.select("id", "label")
    if labels.count() <= propagation.MAX_NODES:
        return propagation.propagate(labels, links, rounds)
    links = links.join(labels.select(F.col("id").alias("a")).distinct(), "a", "left_semi").select("a", "b", propagation.micro("w").alias("w")).checkpoint()
    for _ in range(rounds):
        votes = links.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id"), "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("nw"), "label")).alias("v")).select("id", F.col("v.label").alias("new"))
        moved = labels.join(best, "id", "left").select("id", "label", F.coalesce("new", "label").alias("new"))
        moved = moved.checkpoint()
        done = moved.filter("new <> label").isEmpty()
        labels = moved.select("id", F.col("new").alias("label"))
        if done:
            break
    return labels


def cohesion(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """label, internal and boundary edges, and their ratio (1 without edges)."""
    a, b = labels.select(F.col("id").alias("source_id"), F.col("label").alias("la")), labels.select(F.col("id").alias("target_id"), F.col("label").alias("lb"))
    e = edges.join(a, "source_id").join(b, "target_id")
    same = F.col("la") == F.col("lb")
    sides = e.select(F.explode(F.when(same, F.array("la")).otherwise(F.array("la", "lb"))).alias("label"), same.alias("same"))
    counts = sides.groupBy("label").agg(F.sum(F.when(F.col("same"), 1).otherwise(0)).alias("internal"), F.sum(F.when(~F.col("same"), 1).otherwise(0)).alias("boundary"))
    out = labels.select("label").distinct().join(counts, "label", "left").na.fill(0)
    total = F.col("internal") + F.col("boundary")
    return out.withColumn("cohesion", F.when(total == 0, 1.0).otherwise(F.col("internal") / total))


def dead_code(symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols without incoming calls, references or overrides that no rule exempts, by file."""
    targets = lambda *kinds: edges.filter(F.col("kind").isin(*kinds)).select(F.col("target_id").alias("id"))
    free = symbols.join(targets("calls", "references", "overrides", "extends", "implements", "tests", "contains").distinct(), "id", "left_anti")
    fixed = F.col("kind").isin("trait", "interface", "constructor") | F.lower("name").isin("new", "init", "drop", "default")
    f = files.select(F.col("id").alias("file_id"), "path")
    joined = free.filter(~fixed).join(f, "file_id")
    test = F.lower("path").rlike("test|spec")
    public = ~test & (F.col("visibility") == "public") & ~F.col("kind").isin("field", "constant")
    return joined.filter(~public).groupBy("path").agg(F.count("*").alias("n"), F.sum(F.greatest(F.col("line_end") - F.col("line_start"), F.lit(1))).alias("lines"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))
