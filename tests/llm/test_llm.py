"""The training-data operators against brute force, round trips, and odd input."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sextant.llm import bpe, chat, decontaminate, language, line_dedup, lm_score, quality, sharding, simhash, token_count
from sextant.llm.common import join_groups

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None, "en", "s", 0, "x"), (2, "", "en", None, 0, "x"), (2, "", "en", None, 0, "x"), (None, "One two three four.", None, "s", 19, "x"), (5, " \n\t ", "fr", "s", 4, "x"), (6, "a" * 20000 + " é中😀", "fr", "s", 20004, "x")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def docs(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf_dir}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if k.startswith("op")))
def test_query_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), c.sql(entry.oracle_sql()[name]).df()
    key = [got.columns[0]]
    columns = sorted(got.columns)
    assert got.sort_values(key)[columns].values.tolist() == want.sort_values(key)[columns].values.tolist()


def test_lines_within_one_edit(spark):
    random.seed(3)
    lines = []
    for _ in range(25):
        b = "".join(random.choice("abc") for _ in range(random.choice([20, 22, 63, 64, 65, 66, 127, 128, 129, 200])))
        lines.append(b)
        for _ in range(3):
            k, x = random.randrange(len(b)), b
            x = random.choice([b[:k] + "c" + b[k:], b[:k] + b[k + 1 :], b[:k] + "b" + b[k + 1 :], b[:k] + "xx" + b[k + 1 :]])
            lines.append(x)
    random.shuffle(lines)

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 20:
            return False
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        s = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
        return p + s >= max(len(a), len(b)) - 1

    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    for r in line_dedup.dedup_lines(df).collect():
        i = r["doc_id"]
        exact = any(lines[j] == lines[i] for j in range(i))
        assert (r["n_dropped_exact"], r["n_dropped_near"]) == (exact, not exact and any(near(lines[j], lines[i]) for j in range(i)))


def test_fingerprints_and_components(spark, docs):
    import xxhash

    for _, t, _ in docs[:40]:
        w = words((t or "").translate(LOWER))
        shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
        assert simhash.fingerprint((t or "").encode()) & (2**64 - 1) == want
    rng = np.random.default_rng(0)
    base = rng.integers(-(2**63), 2**63, 300)
    near = base[rng.integers(0, 300, 600)] ^ (np.int64(1) << rng.integers(0, 63, 600)) ^ (np.int64(1) << rng.integers(0, 63, 600))
    points = np.unique(np.concatenate([base, near]))
    df = spark.createDataFrame([(int(p),) for p in points], "fingerprint long")
    for per_shard, most in ((16, 2048), (10_000, 2048), (16, 3)):  # many shards, one, and three that are split again
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 2, per_shard, 4096, most)).collect()}
        pairs = iter([np.nonzero(np.bitwise_count((points[:, None] ^ points[None, :]).view(np.uint64)) <= 2)])
        top = simhash.forest(len(points), pairs)
        assert all(roots.get(int(p), int(p)) == int(points[t]) for p, t in zip(points, top))


def test_similar_documents_keep_one_of_each_group(spark):
    random.seed(1)
    make = lambda n: [random.choice("abcdefgh") * random.randint(1, 4) + str(random.randint(0, 999)) for _ in range(n)]
    base = [make(300) for _ in range(20)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        x = list(b)
        for k in (50, 150, 250):
            x[k] = "changed"
        rows += [(100 + i, " ".join(x)), (200 + i, " ".join(b))]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(20))


def test_similar_documents_are_exactly_those_by_shingle_sets(spark):
    rng = random.Random(7)
    rows, want = [], set()
    shingles = lambda ws: {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}
    for i in range(300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([40, 150, 400]))]
        near = list(base)
        while True:
            x = list(near)
            x[rng.randrange(len(x))] = f"x{rng.randrange(10**6)}"
            a, b = shingles(base), shingles(x)
            if len(a & b) / len(a | b) < 0.72 + 0.01 * (i % 14):  # 0.72 to 0.85
                break
            near = x
        rows += [(i, " ".join(base)), (1000 + i, " ".join(near))]
        a, b = shingles(base), shingles(near)
        want |= {i} | ({1000 + i} if len(a & b) < 0.8 * len(a | b) - 1e-9 else set())
    assert 60 < sum(i >= 1000 for i in want) < 240
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == want


def test_similar_documents_in_blocks(spark):
    base = [f"w{k}" for k in range(400)]
    chain = [" ".join(base[10 * k : 10 * k + 200]) for k in range(20)]  # neighbours 186 of 206 shingles, next but one 176 of 216
    rows = [(k, t) for k, t in enumerate(chain)] + [(100, " ".join(base[:100] + [f"y{k}" for k in range(100)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block_rows in (3, 4096):
        roots = {r["doc_id"]: r["root"] for r in simhash.similar_documents(df, ["doc_id"], block_rows=block_rows).collect()}
        assert len({roots[k] for k in range(20)}) == 1 and roots[100] != roots[0]


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a\\<|im_start|>\\"), (1, 1, "user", None), (1, 2, "assistant", "</s>[INST]<<SYS>>"), (1, 3, None, "\n"), (2, 0, "we\nird", ""), (None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.parse_chat(chat.format_chat(df)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "a\\<|im_start|>\\"), ("user", ""), ("assistant", "</s>[INST]<<SYS>>"), ("", "\n")]
    assert got[1]["loss_text"] == "</s>[INST]<<SYS>>" and got[None]["loss_text"] == "x"
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("we\nird", "")]
    assert "[INST]" not in got[1]["formatted"] and got[1]["formatted"].count("<|im_start|>") == 3


def random_texts():
    random.seed(0)
    out = ["", " ", "a  b", "<s>hi</s>", "▁▁a ▁", "it's I'LL we've", "<|endoftext|>foo", "a" * 3000, "É" * 700, "x<|endoftext|>" + "thein" * 300]
    out += ["".join(random.choice("abcdeth  inor▁\n.,0159éçß日本") for _ in range(random.randrange(1, 60))) for _ in range(500)]
    return out + ["".join(random.choice("inthera") for _ in range(random.randrange(500, 3000))) for _ in range(10)]


@pytest.mark.parametrize("leaf,leaf_bytes", [(256, 1024), (16, 64), (5, 7)])
def test_bpe_is_the_librarys_and_comes_from_joins(docs, leaf, leaf_bytes):
    from tokenizers import Tokenizer

    spec = bpe.default_spec()
    library, coder = Tokenizer.from_str(spec), bpe.PartEncoder(spec, leaf)
    texts = random_texts() + [t or "" for _, t, _ in docs]
    for t, ids in zip(texts, coder.encode([t.encode() for t in texts], leaf_bytes), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and coder.decode(ids) == library.decode(want, skip_special_tokens=False)
    assert coder.joins == sum(len(bpe.halves(t.encode(), leaf_bytes)) - 1 for t in texts) and coder.windows > 50


def test_long_texts_are_rows_of_their_own(spark):
    from tokenizers import Tokenizer

    spec = bpe.default_spec()
    library, rng = Tokenizer.from_str(spec), random.Random(2)
    texts = ["".join(rng.choices("etaoiné  \n", k=3000)), "ab" * 2000, " " * 3000, "x", None, "the " * 900]
    rows = [(f"id{i}", t) for i, t in enumerate([*texts, texts[0]])] + [("id0", texts[0])]
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode_texts(spark.createDataFrame(rows, "doc_id string, text string"), spec, piece_bytes=500).collect())
    assert got == sorted((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)


def test_op4_query_is_the_library_on_all_rows(spark, sf_dir, docs):
    import hashlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_str(bpe.default_spec())
    got = {r["doc_id"]: r for r in bpe.op4_bpe(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, t, _ in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_counts_are_the_librarys(spark, sf_dir, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, counter = sentencepiece.SentencePieceProcessor(model_file=path), token_count.Counter(token_count.piece_table(path))
    rng = random.Random(4)
    for t in [*random_texts(), "".join(rng.choices("etaoinshrdlu", k=20_000)), *["".join(rng.choices(["the", "in", "er", "a", "ab", "re"], k=200)) for _ in range(100)]]:
        w = token_count.pretokens(t)
        counter.learn(set(w))
        assert sum(counter.cache[x] for x in w) == len(sp.encode(t))
    got = {r["doc_id"]: r for r in token_count.op5_token_count(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, t, _ in docs:
        n = len(sp.encode(t or ""))
        assert tuple(got[i])[1:] == (len((t or "").encode()), n, n > 4096)


def test_quality_counts(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in quality.op6_quality(spark, sf_dir).collect()}
    for i, t, _ in docs:
        w = words(t)
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {k + d for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len(repeated))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and not (r["kept"] and r["base_failed"])


def test_small_groups_are_judged_by_their_whole_language_or_all_rows(spark):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 120)))
    odd = " ".join("".join(rng.choices("abcdefghij", k=60)) for _ in range(80))
    rows = [(i, text(), "en", "large") for i in range(150)]
    rows += [(1000 + i, text(), "en", "small") for i in range(8)] + [(1100, odd, "en", "small")]
    rows += [(2000 + i, text(), "fr", "rare") for i in range(8)] + [(2100, odd, "fr", "rare"), (2200, text(), None, None), (2300, "short", "en", "large")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.quality_verdicts(df, ["doc_id"]).collect()}
    assert len(got) == len(rows) and all(r["distance2"] is not None for r in got.values())
    assert {i for i, r in got.items() if not r["kept"]} == {1100, 2100, 2300}
    # the estimate of a whole language is that of the same rows as one source
    one = {r["doc_id"]: r for r in quality.quality_verdicts(df.filter("lang = 'en'").withColumn("source", F.lit("one")), ["doc_id"]).collect()}
    assert all(math.isclose(got[i]["distance2"], one[i]["distance2"], rel_tol=1e-6) for i in (1000, 1007, 1100))


def test_least_determinant_is_that_of_a_search_of_all_subsets(spark):
    import itertools

    rng = np.random.default_rng(5)
    names, floor = ["x", "y"], [0.05, 0.05]
    rows = {}
    for g in range(6):
        body = rng.multivariate_normal([1, 2], [[1, 0.8], [0.8, 1]], 9)
        rows[f"g{g}"] = np.concatenate([body, rng.normal([6, -4], 0.3, (3, 2))])
    df = spark.createDataFrame([(g, float(a), float(b)) for g, xs in rows.items() for a, b in xs], "grp string, x double, y double")
    for broadcast_groups in (1000, 0):
        got = {r["grp"]: r for r in quality.least_determinants(df, names, floor, 0.75, 30, broadcast_groups).collect()}
        for g, xs in rows.items():
            h, log_det = got[g]["h"], lambda x: np.log(np.linalg.det(np.cov(x.T, bias=True) + np.diag(np.square(floor))))
            assert h == 9
            best = min(itertools.combinations(range(12), h), key=lambda s: log_det(xs[list(s)]))
            assert set(best) == set(range(9)) and math.isclose(got[g]["log_det"], log_det(xs[:9]), rel_tol=1e-6)
            assert np.allclose(got[g]["m"], xs[:9].mean(axis=0))


def test_clashing_columns_are_kept(spark):
    names = "_id _doc _key _row _user exact near n_lines n_dropped_exact _k _block _rank shard slot _part _shard root node wide _r _text window k place _rows grp n at _n _c fits _fine".split()
    texts = ["one line of twenty or more\nanother line of that length", "one line of twenty or more\nsomething else here", "short", None]
    rows = [(i, t, "en", "s", *[f"{c}{i}" for c in names]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in names))
    items = spark.createDataFrame([(1, "not in any of the texts at all")], "item_id long, text string")
    own = lambda out: {r["doc_id"]: tuple(r[c] for c in names) for r in out.select("doc_id", *names).collect()}
    whole = {r[0]: tuple(r[4:]) for r in rows}
    cleaned = line_dedup.dedup_lines(df)
    assert own(cleaned) == whole and cleaned.columns == [*df.columns, "_n_lines", "_n_dropped_exact", "n_dropped_near"]
    assert {r["doc_id"]: r["text"] for r in cleaned.collect()} == {0: texts[0], 1: "something else here", 2: "short", 3: None}
    assert own(simhash.drop_near_duplicates(df)) == whole
    assert own(decontaminate.drop_contaminated(df, items)) == whole
    assert quality.drop_low_quality(df).columns == df.columns and quality.drop_low_quality(df).count() == 0
    dealt = sharding.shuffle_into_shards(df, df.columns, 3)
    assert own(dealt) == whole and dealt.columns == [*df.columns, "__shard", "_slot"]


def test_text_ids_are_kept(spark):
    df = spark.createDataFrame([("a", "one two three", "en"), (None, "four five six seven", "en")], "doc_id string, text string, lang string")
    items = spark.createDataFrame([("q1", "four five six seven")], "item_id string, text string")
    ids = lambda out: sorted(str(r["doc_id"]) for r in out.collect())
    pieces = token_count.piece_table(public_tokenizers.path("piece_bpe_32k.model"))
    for out in (bpe.encode_texts(df, bpe.default_spec()), token_count.count_tokens(df, pieces), language.predict_language(df, None), lm_score.lm_scores(df)):
        assert ids(out) == ["None", "a"]
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, items, ["doc_id"]).collect()] == [(None, "q1")]


def test_short_items_are_found_word_for_word(spark):
    items = {1: "What is 12 + 7?", 2: "Name the capital city", 3: "Compute 12 * 7 - 3 + 44 / 2 - 91 * 8 + 6"}
    docs = [(i, f"Some words before. {t} And some behind.") for i, t in items.items()] + [(9, "What is 13 + 7? Name the capital of it. Compute 1 * 7 - 3 + 4 / 2 - 9 * 8 + 6")]
    frame = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for broadcast_windows in (1000, 0):
        got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), frame, ["doc_id"], broadcast_windows=broadcast_windows)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 1), (2, 2), (3, 3)}


def test_hot_groups_are_joined_alike(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("g"), "id")
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.max("id").alias("top")).filter("g <> 2500")
    for how in ("inner", "left"):
        a, b = ({tuple(r) for r in join_groups(rows, groups, "g", "n", how, broadcast_groups=k).select("g", "id", "top").collect()} for k in (0, 10_000))
        assert a == b and len(a) == 3000 - (how == "inner")


def test_long_conversations_and_lines(spark):
    n = 20_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<| \\ "), "id").alias("text"))
    read = chat.parse_chat(chat.format_chat(turns)).first()
    assert [(t["role"], t["text"]) for t in read["turns"]] == [("assistant" if i % 3 else "user", f"<| \\ {i}") for i in range(n)]
    assert read["loss_text"] == "".join(f"<| \\ {i}" for i in range(n) if i % 3)
    line = "".join(random.Random(1).choices("abcdefgh é", k=100_000))
    rows = [(1, line), (2, line[:50_000] + "x" + line[50_000:]), (3, line[:99_999] + "y"), (4, line[:30_000] + "yy" + line[30_002:])]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["n_dropped_near"] for r in got.collect()} == {1: 0, 2: 1, 3: 1, 4: 0}


def test_chi_squared():
    assert abs(quality.chi2_quantile(0.95, 1) - 3.841459) < 1e-5 and abs(quality.chi2_quantile(0.99, 6) - 16.811894) < 1e-5


def test_language_on_held_out(spark, sf_dir, docs):
    true = {i: lang for i, _, lang in docs}
    got = language.op7_language(spark, sf_dir).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in held) >= 0.95 * len(held)


def kneser_ney(text, order, size):
    """Probability of a symbol behind a row of symbols in a model of one text (a row of symbols), by the definition."""
    row = [0] * (order - 1) + text
    top = Counter(tuple(row[i - order + 1 : i + 1]) for i in range(order - 1, len(row)))
    levels = [top]
    for _ in range(order - 1):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    spread = []
    for c in levels:
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        spread.append(one / (one + 2 * two) if one and two else 0.5)

    def p(before, symbol, n):
        if n == 0:
            return 1 / size
        context = tuple(before[len(before) - n + 1 :]) if n > 1 else ()
        seen = [v for g, v in levels[n - 1].items() if g[:-1] == context]
        low = p(before, symbol, n - 1)
        if not seen:
            return low
        return max(levels[n - 1][(*context, symbol)] - spread[n - 1], 0) / sum(seen) + spread[n - 1] * len(seen) / sum(seen) * low

    return lambda before, symbol: p(before, symbol, order)


def test_kneser_ney_is_the_definitions():
    learnt = {"a": "abc abd abe hello abab", "b": "xyz héé zyx zzy", "zh": "汉字很多 的语言 汉语"}
    m = language.fit(list(learnt.items()))
    row = lambda t: [int(x) for x in m.alphabet.symbols(f"\n{t}\n")]
    for i, (_, t) in enumerate(sorted(learnt.items())):
        law = kneser_ney(row(t)[1:], language.ORDER, language.SIZE)
        asked = [0] * (language.ORDER - 1) + row("abel xyh 汉多q")[1:]
        want = [math.log(law(asked[k - 4 : k], asked[k])) for k in range(4, len(asked))]
        keys, _ = m.alphabet.keys(["abel xyh 汉多q"])
        assert np.allclose(m.predict(keys)[:, i], want, atol=1e-4)
        key = int(keys[3]) >> language.BITS << language.BITS
        p = np.exp(m.predict(np.array([key | k for k in range(m.alphabet.size)], np.int64))).sum(axis=0)
        assert np.allclose(p, 1, atol=1e-3)


def test_letters_beyond_the_common_ones_and_slices():
    rare = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 3000))
    m = language.fit([("zh", rare), ("en", "plain words")])
    assert len({tuple(m.alphabet.symbols(c)) for c in rare}) == 3000
    texts = ["plain words  and 汉字", "", " .. ", rare]
    whole, n = m.entropies(texts)
    for size in (1, 2, 7):
        part, k = m.entropies(texts, size)
        assert np.allclose(whole, part) and (n == k).all()


def test_languages_of_long_documents_are_learnt(spark):
    rows = [(3 * i, "the cat sat on the mat " * 3, "en") for i in range(30)] + [(1000 + i, "le chat est assis sur le tapis " * 300, "fr") for i in range(30)]
    sample = language.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 5, 10_000)
    n = Counter(lang for lang, _ in sample)
    assert n["en"] == 5 and n["fr"] == 1
    assert language.labelled_sample(spark.createDataFrame([], "doc_id long, text string, lang string"), 5, 10) == []


def test_benchmark_items_are_found(spark, sf_dir, docs):
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op8_decontaminate(spark, sf_dir).collect()}
    assert got == {(i, j) for i, t, _ in docs for j, x in items if x in t}


def test_templates_need_consistent_slots(spark):
    item = "If Anna buys 12 apples for 3 dollars and sells 12 of them later then how much did Anna pay in total?"
    items = spark.createDataFrame([(1, item), (2, None), (3, "short one"), (4, "Only six words are here now")], "item_id long, text string")
    docs = [(1, "Intro. If Bob buys 45 apples for 7 dollars and sells 45 of them later then how much did Bob pay in total? End."), (2, "If Bob buys 45 apples for 7 dollars and sells 46 of them later then how much did Carl pay in total?"), (3, None), (4, "x only six words are here now y"), (None, item)]
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), items, ["doc_id"]).collect()
    assert {(r["doc_id"], r["item_id"], r["changed"]) for r in got} == {(1, 1, 3), (4, 4, 0), (None, 1, 0)}


def test_verbatim_copies_are_found_whatever_their_placeholders(spark):
    numbers = "12 + 7 = 19 , 30 - 4 = 26 , 5 kg 300 g and 18 cm , 41 + 8 = 49 , 77 - 6 = 71"
    names = "Reigning monarchs were Anna Boleyn Carl Diaz Emma Frost Gina Hale Ivan Jones and then Kate Lund"
    short = "Name the Capital City of Northern France"
    long = "When Anna met her cousin at the old station she carried a heavy bag of books and later that day Anna walked home alone while it rained so hard that nobody else in town would go out before Anna had told them all how warm it was"
    twice = "2 apples and 2 pears lie in the basket that was put on the kitchen table by my aunt before she went out for a walk with her dog"
    texts = {1: numbers, 2: names, 3: short, 4: long, 5: twice}
    items = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    docs = [(1, f"Here it is: {numbers} and so on"), (2, f"it is said that {names.lower()} and so on"), (3, f"A Heading Line\n{short}\nmore"), (4, "Well, " + long.replace("day Anna", "day Ana")), (5, twice.replace("2 apples and 2", "3 apples and 4"))]
    docs += [(6, numbers.replace("1", "2").replace("7", "9")), (7, "nothing of all that is in this text, be it long or short, and so it stays")]
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), items, ["doc_id"]).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in texts}
    covered = {r["item_id"]: (r["covered"], r["n_words"]) for r in got}
    assert all(covered[i][0] == covered[i][1] for i in (1, 2, 3)) and covered[4][0] < covered[4][1]


def test_shards(spark, sf_dir, docs):
    rows = sharding.op9_shard(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _, _ in docs)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    many = sharding.shuffle_into_shards(spark.range(5000).withColumnRenamed("id", "doc_id"), ["doc_id"], 7, rows_per_block=100, min_blocks=4)
    slots = {}
    for r in many.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 5000


def test_hypergeometric_law():
    rng = random.Random(1)
    n = Counter(sharding.hypergeometric(rng, 5, 7, 4) for _ in range(20_000))
    for k in range(5):
        assert abs(n[k] / 20_000 - math.comb(5, k) * math.comb(7, 4 - k) / math.comb(12, 4)) < 0.015
    m = sharding.communication_matrix([30, 0, 70], [50, 25, 25], 3)
    assert [sum(r) for r in m] == [30, 0, 70] and [sum(c) for c in zip(*m)] == [50, 25, 25]


def test_scores(spark, sf_dir, docs):
    tokens = {i: [*words((t or "").translate(LOWER)), "\n"] for i, t, _ in docs}
    train = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    for head in (1_000_000, 50):
        for r in lm_score.lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), head_words=head).collect():
            ws = tokens[r["doc_id"]]
            assert math.isclose(r["base_score"], sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in train for w in ws), n)


def ppm(texts, order):
    """Log10 probability of a symbol behind a row of symbols, by the definition: method C with exclusion."""
    counts = defaultdict(Counter)
    for t in texts:
        row = [lm_score.START] * order + list(t) + [lm_score.END]
        for i in range(order, len(row)):
            for j in range(order + 1):
                counts[tuple(row[i - j : i])][row[i]] += 1

    def log_p(before, symbol):
        gone, out = set(), 0.0
        for j in range(order, -1, -1):
            context = counts.get(tuple(before[len(before) - j :]))
            left = {s: n for s, n in (context or {}).items() if s not in gone}
            whole = sum(left.values()) + len(left)
            if symbol in left:
                return out + math.log10(left[symbol] / whole)
            if context:
                out += math.log10(len(left) / whole) if left else 0.0
                gone |= set(context)
        return out - math.log10(lm_score.SYMBOLS - len(gone))

    return log_p


@pytest.mark.parametrize("order", [0, 1, 3, 5])
@pytest.mark.parametrize("texts", [[b"abracadabra", b"banana band", b""], []])
@pytest.mark.parametrize("rows", [1, 500_000])
def test_prices_are_a_probability_law_and_agree_with_brute_force(spark, order, texts, rows):
    keys, n = np.unique(lm_score.grams(lm_score.symbols(texts, order), order), return_counts=True)
    learnt, law = dict(zip(keys.tolist(), n.tolist(), strict=True)), ppm(texts, order)
    contexts = {k >> lm_score.BITS for t in (b"abra", b"zzzzz", b"an") for k in lm_score.grams(lm_score.symbols([t], order), order).tolist()}
    asked = {c << lm_score.BITS | s for c in contexts for s in range(lm_score.SYMBOLS)} | set(learnt)
    strings = spark.createDataFrame([(k, learnt.get(k, 0)) for k in asked], "key long, n long")
    got = {r["key"]: r["price"] for r in lm_score.prices(strings, order, rows=rows).collect()}
    assert got.keys() == asked
    for c in contexts:
        assert abs(sum(10 ** got[c << lm_score.BITS | s] for s in range(lm_score.SYMBOLS)) - 1) < 1e-9
    for k in asked:
        row = [k >> lm_score.BITS * i & 511 for i in range(order, -1, -1)]
        assert math.isclose(got[k], law(row[:-1], row[-1]), abs_tol=1e-9)


@pytest.mark.parametrize("block_bytes", [100, 1 << 20])
def test_lm_scores_are_brute_force_code_lengths(spark, block_bytes):
    rows = [(i, t) for i, t in enumerate(["One two Three.", "one two two", None, "", "é 中 three", "four one two three", "one two Three.", "xyz" * 60, "two"] * 2)]
    texts = [(t or "").translate(LOWER).encode() for _, t in rows]
    law = ppm([b for (i, _), b in zip(rows, texts, strict=True) if not lm_score.held_out(i)], 5)
    want = {}
    for (i, _), b in zip(rows, texts, strict=True):
        row = [lm_score.START] * 5 + list(b) + [lm_score.END]
        want[i] = sum(law(row[k - 5 : k], row[k]) for k in range(5, len(row)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm_score.lm_scores(df, block_bytes=block_bytes).collect()}
    assert got.keys() == want.keys() and any(lm_score.held_out(i) for i in want)
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_odd_rows_and_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "five words or more here")], "item_id long, text string")
    spec, pieces = bpe.default_spec(), token_count.piece_table(public_tokenizers.path("piece_bpe_32k.model"))
    for df, n in ((odd, len(ODD)), (odd.limit(0), 0)):
        assert line_dedup.dedup_lines(df).count() == n
        assert simhash.near_duplicates(df, ["doc_id"]).count() == n
        assert simhash.drop_near_duplicates(df).count() == (n and 3)
        assert bpe.encode_texts(df, spec).count() == n
        assert token_count.count_tokens(df, pieces).count() == n
        assert quality.quality_verdicts(df, ["doc_id"]).count() == n
        assert language.predict_language(df, language.fit(language.labelled_sample(df, 10, 100_000))).count() == n
        assert decontaminate.drop_contaminated(df, items).count() == n
        assert decontaminate.drop_contaminated(df, items.limit(0)).count() == n
        assert sharding.shuffle_into_shards(df, ["doc_id", "text"], 4).count() == n
        assert lm_score.lm_scores(df).count() == n
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.parse_chat(chat.format_chat(empty)).count() == 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    verdict = {r["doc_id"] for r in quality.op6_quality(spark, sf_dir).collect() if r["kept"]}
    assert {r["doc_id"] for r in kept.collect()} == verdict
    cleaned = corpus_pipeline.dedup_lines(spark, docs, sf_dir)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in out} <= verdict and all(len(r["ids"]) == r["n_tokens"] for r in out)


def test_wide_pairs_go_through_a_vantage_point_tree(monkeypatch):
    import numpy as np

    from sextant.llm import simhash

    rng = np.random.default_rng(5)
    hubs = rng.integers(0, 2, (4, simhash.WIDE), np.uint8)
    points = np.concatenate([h ^ (rng.random((200, simhash.WIDE)) < 0.12) for h in hubs] + [rng.integers(0, 2, (300, simhash.WIDE), np.uint8)])
    wide = [np.packbits(p.astype(np.uint8)).tobytes() for p in points[rng.permutation(len(points))]]
    reach, compared, close = simhash.wide_reach(0.8), [], simhash._wide_close
    bits = np.frombuffer(b"".join(wide), np.uint64).reshape(len(wide), -1)
    x, y = close(bits, bits, reach)
    want = set(zip(x[x < y].tolist(), y[x < y].tolist(), strict=True))
    monkeypatch.setattr(simhash, "_wide_close", lambda x, y, reach: compared.append(len(x) * len(y)) or close(x, y, reach))
    got = [(min(a, b), max(a, b)) for xs, ys in simhash.wide_pairs(wide, reach) for a, b in zip(xs.tolist(), ys.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want
    by_tree = sum(compared)
    compared.clear()
    list(simhash.wide_pairs(wide, reach, leaf=len(wide)))
    assert by_tree < 0.7 * sum(compared)


def test_the_driver_collects_garbage_now_and_then(monkeypatch):
    from types import SimpleNamespace

    from sextant.llm import common

    calls, now = [], [100.0]
    fake = SimpleNamespace(sparkContext=SimpleNamespace(_jvm=SimpleNamespace(System=SimpleNamespace(gc=lambda: calls.append(now[0])))))
    monkeypatch.setattr(common, "_collected", [0.0])
    monkeypatch.setattr(common, "time", SimpleNamespace(monotonic=lambda: now[0]))
    for now[0] in (100.0, 101.0, 104.9, 105.0, 120.0):
        common.collect_garbage(fake)
    assert calls == [100.0, 105.0, 120.0]
