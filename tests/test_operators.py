"""Operators on small graphs and texts."""

from pyspark.sql import functions as F

from sextant.functions import lexical
from sextant.operators import graph, text
from sextant.sources.listing import line_chunks, project_files
from sextant.streaming.watch import debounce, debounce_stream


def edges(spark, rows):
    return spark.createDataFrame([(a, b, k, 1.0) for a, b, k in rows], "source_id long, target_id long, kind string, weight double")


def test_bfs_depth_direction_and_cycles(spark):
    e = edges(spark, [(1, 2, "calls"), (2, 3, "calls"), (3, 1, "calls")])
    one = spark.createDataFrame([(1,)], "id long")
    got = lambda **k: sorted((r["id"], r["distance"]) for r in graph.bounded_bfs(e, one, **k).collect())
    assert got(depth=1) == [(2, 1)]
    assert got(depth=5) == [(2, 1), (3, 2)]
    assert got(depth=1, direction="in") == [(3, 1)]
    assert got(depth=4, paths="all") == [(1, 3), (2, 1), (2, 4), (3, 2)]
    assert graph.bounded_bfs(e.limit(0), one, 2).count() == 0


def test_blast_leaves_tests_out_forwards(spark):
    e = edges(spark, [(1, 2, "contains"), (2, 3, "calls"), (4, 2, "calls"), (1, 9, "tests")])
    got = {(r["direction"], r["id"]) for r in graph.blast_radius(e, spark.createDataFrame([(2,)], "id long")).collect()}
    assert got == {("forward", 3), ("backward", 1), ("backward", 4)}


def test_label_propagation_finds_two_groups(spark):
    from sextant.sources.listing import ensure_checkpoints

    ensure_checkpoints(spark)
    pairs = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]
    links = spark.createDataFrame([(a, b, 1.0) for x, y in pairs for a, b in ((x, y), (y, x))], "a long, b long, w double")
    nodes = spark.createDataFrame([(i, i) for i in range(1, 7)], "id long, label long")
    labels = {r["id"]: r["label"] for r in graph.label_propagation(nodes, links, 10).collect()}
    assert len(labels) == 6


def test_ndcg_is_one_for_the_ideal_order(spark):
    rel = spark.createDataFrame([(0, 1, 3), (0, 2, 2), (0, 3, 0)], "query_id int, id long, grade int")
    ranked = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "query_id int, id long, rank int")
    assert text.ndcg(ranked, rel, 10).first()["ndcg"] == 1.0
    assert text.reciprocal_rank(ranked, rel, 10).first()["rr"] == 1.0


def test_queries_of_any_kind_are_classified(spark):
    odd = ["", " ", "!!", "é ü", "x " * 1000, "the a of", "123 456", "a/b"]
    got = spark.createDataFrame([(q,) for q in odd], "q string").select(lexical.query_family(F.col("q")).alias("f")).collect()
    assert all(r["f"] for r in got)


def test_files_and_chunks(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n" * 120)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.js").write_text("x")
    (tmp_path / "c.unknown").write_text("x")
    files = project_files(spark, str(tmp_path))
    assert [(r["language"], r["line_count"]) for r in files.collect()] == [("python", 121)]
    assert [(r["first"], r["last"]) for r in line_chunks(files, "path").orderBy("first").collect()] == [(1, 50), (51, 100), (101, 121)]


def test_debounce_batch_and_stream(spark, tmp_path):
    rows = [(1, i, t) for i, t in enumerate([0.0, 1.0, 1.9, 2.0, 3.5, 4.0, 9.0])]
    df = spark.createDataFrame(rows, "user long, event long, s double").select("user", "event", F.timestamp_seconds("s").alias("ts"))
    want = [0, 3, 5, 6]
    assert sorted(r["event"] for r in debounce(df, "user", "ts", "event", 2).collect()) == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = debounce_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "user", "ts", "event", 2)
    q = stream.writeStream.format("memory").queryName("kept").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["event"] for r in spark.sql("SELECT event FROM kept").collect()) == want


def test_subsystems_take_more_than_twenty_rounds(spark, monkeypatch):
    from sextant.plans import registry

    n = 30
    symbols = spark.createDataFrame([(i, 0 if i < 3 else i) for i in range(n)], "id long, file_id long")
    rows = [(i, i - 1, "calls", 100.0 - i) for i in range(3, n)] + [(0, 1, "calls", 1000.0), (1, 2, "calls", 1000.0), (2, 0, "calls", 1000.0)]
    e = spark.createDataFrame(rows, "source_id long, target_id long, kind string, weight double")
    monkeypatch.setattr(registry, "_frames", lambda spark, sf_dir: (None, symbols, e))
    assert {(r["id"], r["label"]) for r in registry.gr14_subsystems(spark, "").collect()} == {(i, 0) for i in range(n)}


def test_expansion_gives_a_bonus_for_each_further_path(spark):
    e = edges(spark, [(1, 2, "calls"), (1, 2, "imports"), (1, 3, "contains"), (3, 2, "calls"), (4, 1, "tests"), (1, 9, "overrides")])
    seeds = spark.createDataFrame([(1, 2.0)], "id long, score double")
    got = {r["id"]: (round(r["score"], 6), r["paths"]) for r in graph.expand(e, seeds, 2).collect()}
    assert got == {2: (1.15, 3), 3: (0.9, 1), 4: (0.55, 1)}  # 1.15: 1.0 and bonuses of 0.05 and 0.10


def test_evidence_of_motif_members_is_structural(spark):
    symbols = spark.createDataFrame([(i, 1, "public") for i in range(1, 9)], "id long, file_id long, visibility string")
    e = edges(spark, [(1, i, "contains") for i in (2, 3, 4)] + [(5, 6, "imports"), (7, 8, "imports"), (7, 8, "references")])
    got = {(r["source_id"], r["target_id"], r["kind"]): (r["has_motif"], r["evidence"]) for r in graph.evidence(symbols, e).collect()}
    assert got[(1, 2, "contains")] == (True, "structural") and got[(5, 6, "imports")] == (False, "direct")
    assert got[(7, 8, "references")] == (False, "reinforcing")


def test_substring_weights_and_wildcards(spark):
    symbols = spark.createDataFrame([(1, "rate_limit", "x"), (2, "rate limit all", "the rate"), (3, "rateXlimit", ""), (4, "a rate_limit", "limit rate")], "id long, name string, source string")
    asked = spark.createDataFrame([(0, "Rate_Limit"), (0, "x")], "query_id int, term string")
    got = {r["id"]: r["score"] for r in text.substring_search(symbols, asked, 10).collect()}
    assert got == {1: 3.0, 2: 1.5, 3: 1.0, 4: 3.0}


def test_tracks_need_two_hits_where_there_are_five(spark):
    rows = [(0, t, 1, 1.0) for t in range(5)] + [(0, 0, 2, 9.0)] + [(1, t, 1, 1.0) for t in range(4)] + [(1, 0, 2, 2.0)] + [(2, 0, 5, 3.0)]
    got = {(r["query_id"], r["id"]): round(r["score"], 6) for r in text.merge_tracks(spark.createDataFrame(rows, "query_id int, track int, id long, score double")).collect()}
    assert got == {(0, 1): 2.2, (1, 1): 1.9, (1, 2): 1.7, (2, 5): 3.0}


def test_deep_walks_end(spark):
    e = edges(spark, [(i, i + 1, "calls") for i in range(20)])
    got = graph.bounded_bfs(e, spark.createDataFrame([(0,)], "id long"), 10).collect()
    assert sorted((r["id"], r["distance"]) for r in got) == [(i, i) for i in range(1, 11)]


def test_file_tree_counts_an_id_once(spark, monkeypatch):
    from sextant.plans import registry

    files = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, path string")
    symbols = spark.createDataFrame([(10, 1), (10, 1), (10, 2), (11, 2), (11, 3), (12, None)], "id long, file_id long")
    e = edges(spark, [(10, 11, "calls"), (10, 11, "tests"), (10, 12, "calls"), (11, 12, "calls"), (12, 99, "calls")])
    monkeypatch.setattr(registry, "_frames", lambda spark, sf_dir: (files, symbols, e))
    got = {r["path"]: (r["symbols"], r["targets"]) for r in registry.jn10_file_tree(spark, "").collect()}
    assert got == {"a": (2, 2), "b": (1, 1), None: (0, 0)}


def test_propagation_in_memory_equals_joins(spark, monkeypatch):
    import random

    from sextant.operators import propagation

    rng = random.Random(7)
    rows = [(i, i % 6) for i in range(120)] + [(i, 9) for i in range(0, 120, 7)] + [(500, 3), (500, 4)]  # some ids twice, one without links
    nodes = spark.createDataFrame(rows, "id long, label long")
    pairs = [(rng.randrange(130), rng.randrange(130), rng.choice([0.1, 0.2, 0.3, 1.0])) for _ in range(400)]
    links = spark.createDataFrame([x for a, b, w in pairs for x in ((a, b, w), (b, a, w))], "a long, b long, w double")

    def plain(rounds):
        at = list(rows)
        for _ in range(rounds):
            votes = {}
            for a, b, w in [x for a, b, w in pairs for x in ((a, b, w), (b, a, w))]:
                for i, l in at:
                    if i == b:
                        votes.setdefault(a, {}).setdefault(l, 0)
                        votes[a][l] += round(w * 1e6)
            at = [(i, min(votes[i].items(), key=lambda v: (-v[1], v[0]))[0] if i in votes else l) for i, l in at]
        return sorted(at)

    got = lambda rounds: sorted((r["id"], r["label"]) for r in graph.label_propagation(nodes, links, rounds).collect())
    assert got(1) == plain(1)
    assert got(6) == plain(6)
    monkeypatch.setattr(propagation, "MAX_NODES", 10)
    assert got(6) == plain(6)


def test_packs_hold_whole_nodes(monkeypatch):
    import numpy as np

    from sextant.operators import propagation

    monkeypatch.setattr(propagation, "PACK_LINKS", 16)
    rng = np.random.default_rng(3)
    a, b, w = rng.integers(0, 60, 500), rng.integers(0, 60, 500), rng.integers(1, 4, 500) * 100_000
    labels = rng.integers(0, 5, 60).astype(np.int32)
    got = {}
    for row in propagation.pack(a, b, w):
        nodes, new = propagation.vote(row, labels, 5)
        assert not got.keys() & set(nodes.tolist())
        got |= dict(zip(nodes.tolist(), new.tolist(), strict=True))
    want = {n: int(np.bincount(labels[b[a == n]], w[a == n], 5).argmax()) for n in np.unique(a).tolist()}
    assert got == want
