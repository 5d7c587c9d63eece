"""Line dedup: of equal or nearly equal lines (Levenshtein distance 1 at most) only the earliest stays.

Order: doc_id (null first), the document's hash, the line's place. A line is a \\n-split part of a text; lines without a word
are left alone. A line is dropped if an equal line comes earlier, or if both have min_near_chars characters or more and an
earlier line is within one inserted, deleted or replaced character. (An earlier line counts even if it is dropped itself.)

Near lines are found by a deletion-neighbourhood join over the distinct lines: each line emits all its variants with one
character deleted as hashed keys; two lines that share a variant at the same place differ by a replacement, and a line
that equals another's variant differs by an insertion. Groups of equal variants are aggregated to their earliest line, never
expanded into pairs, and each link is verified on the lines themselves: without the place of the edit they must be equal. A variant is hashed from three parts, the characters before
its block of BLOCK, the block, and the characters behind it; the first and last of these are folded from the blocks' hashes, so
that work is linear in a line's length. Before that, lines that can have no partner are set aside without loss: of two lines within one edit, the first half
or the second half is equal, and all of the line but one eighth; lines that share no half (by length class), or then no such rest,
with another line emit no variants.

Edge cases: a null text stays null and an empty one empty; repeated rows (same doc_id and text) are
one document and get the same result; null ids sort first; an empty table gives no rows; extra columns are kept by dedup_lines,
whatever they are called (a count gets underscores in front of its name where the table has a column of that name). Lines and
documents are compared by two 64-bit hashes. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import fresh, identity, let, materialize, table

BLOCK = 64
#: A set of line hashes of this many rows at most is broadcast (16 bytes a row); a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def _position() -> Column:
    return F.struct("_id", "_doc", "_at")


def _halves(line: Column) -> Column:
    """Four keys; two lines within one edit share one, if hashes don't lie."""
    n = F.length(line)

    def keys(length: Column) -> list[Column]:
        h = F.floor(length / 2).cast("int")
        return [F.xxhash64(length, F.lit(0), F.substring(line, F.lit(1), h)), F.xxhash64(length, F.lit(1), F.substring(line, n - (length - h) + 1, length - h))]

    return F.array(*keys(n), *keys(n - 1))


def _all_but_a_part(line: Column, parts: int = 8) -> Column:
    """2 * parts keys of all of a line but one part; two lines within one edit share one."""
    n = F.length(line)

    def keys(length: Column) -> list[Column]:
        cut = [F.floor(length * j / parts).cast("int") for j in range(parts + 1)]
        behind = [length - cut[j + 1] for j in range(parts)]
        return [F.xxhash64(length, F.lit(j), F.substring(line, F.lit(1), cut[j]), F.substring(line, n - behind[j] + 1, behind[j])) for j in range(parts)]

    return F.array(*keys(n), *keys(n - 1))


#: Lines of as many blocks are looked at as one array; longer ones by a window over their blocks.
ARRAY_BLOCKS = 64


def _cut(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _blocks(lines: DataFrame) -> DataFrame:
    """_h1, block, before, whole, behind, longer, behind_longer for each block of BLOCK characters of each line.

    A line is cut into blocks once as it is and once without its first character. The characters before or behind a block are
    hashed as the exclusive or of their blocks' hashes, each with its number. Lines of up to ARRAY_BLOCKS blocks need no shuffle for that; of a longer
    one a window gives it for all blocks in one pass.
    """
    short = F.length("line") <= ARRAY_BLOCKS * BLOCK
    return _blocks_in_arrays(lines.filter(short)).unionByName(_blocks_by_window(lines.filter(~short)))


def _blocks_in_arrays(lines: DataFrame) -> DataFrame:
    folded = lambda hashes: F.aggregate(hashes, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    hashed = lambda parts: F.transform(parts, lambda c, i: F.xxhash64(i, c))

    def rows(parts: Column) -> Column:
        return let(F.struct(hashed(parts).alias("own"), hashed(_cut(F.substring("line", 2, 2**31 - 1))).alias("moved")), lambda h: F.transform(parts, lambda c, i: F.struct(
            i.alias("block"),
            folded(F.slice(h["own"], F.lit(1), i)).alias("before"),
            c.alias("whole"),
            folded(F.slice(h["own"], i + 2, F.lit(ARRAY_BLOCKS))).alias("behind"),
            F.concat(c, F.coalesce(F.substring(F.get(parts, i + 1), 1, 1), F.lit(""))).alias("longer"),
            folded(F.slice(h["moved"], i + 2, F.lit(ARRAY_BLOCKS))).alias("behind_longer"),
        )))

    return lines.select("_h1", F.explode(let(_cut(F.col("line")), rows)).alias("b")).select("_h1", "b.*")


def _blocks_by_window(lines: DataFrame) -> DataFrame:
    both = F.arrays_zip(_cut(F.col("line")).alias("whole"), _cut(F.substring("line", 2, 2**31 - 1)).alias("moved"))
    rows = lines.select("_h1", F.posexplode(both).alias("block", "c")).select("_h1", "block", "c.*")
    hashed = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.xxhash64("block", c))
    line = Window.partitionBy("_h1")
    so_far = line.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_own": hashed("whole"), "_moved": hashed("moved")})
    rows = rows.withColumns({"_own_to": F.bit_xor("_own").over(so_far), "_moved_to": F.bit_xor("_moved").over(so_far), "_own_all": F.bit_xor("_own").over(line), "_moved_all": F.bit_xor("_moved").over(line), "_next": F.lead("whole").over(line.orderBy("block"))})
    return rows.select(
        "_h1",
        "block",
        F.col("_own_to").bitwiseXOR(F.col("_own")).alias("before"),
        "whole",
        F.col("_own_all").bitwiseXOR(F.col("_own_to")).alias("behind"),
        F.concat("whole", F.coalesce(F.substring("_next", 1, 1), F.lit(""))).alias("longer"),
        F.col("_moved_all").bitwiseXOR(F.col("_moved_to")).alias("behind_longer"),
    )


def near_links(lines: DataFrame) -> DataFrame:
    """_h1, _h2 of the distinct lines that have an earlier line within one edit; lines: _h1, _h2, _first, line."""
    cut = _blocks(lines)
    own = cut.select(F.xxhash64("block", "before", "whole", "behind").alias("_v"), F.lit(-1).alias("_p"), "_h1")
    drop = lambda s, i: F.concat(F.substring(s, F.lit(1), i), F.substring(s, i + 2, F.lit(2**31 - 1)))
    at = cut.select("*", F.explode(F.sequence(F.lit(0), F.length("longer") - 1)).alias("_i"))
    deleted = at.select(F.xxhash64("block", "before", drop(F.col("longer"), F.col("_i")), "behind_longer").alias("_v"), (F.col("block") * BLOCK + F.col("_i")).alias("_p"), "_h1")
    variants = deleted.unionByName(own)
    # variants that occur once are left out first, while rows are narrow
    shared = variants.groupBy("_v").agg(F.count("*").alias("_n")).filter("_n > 1").select("_v")
    who = F.struct("_first", "_h1")
    met = materialize(variants.join(shared, "_v", "left_semi").join(lines.select("_h1", "_first"), "_h1").select("_v", "_p", who.alias("_l")))
    # replaced characters: the same variant with the same place deleted; the group's earliest line stands for all
    same = met.filter("_p >= 0").groupBy("_v", "_p").agg(F.min("_l").alias("_w"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    replaced = met.join(same, ["_v", "_p"]).filter(F.col("_w._first") < F.col("_l._first")).select("_l", "_w", "_p", F.lit(True).alias("_both"))
    # inserted characters: a line equals another's variant; the later of the two goes
    whole = met.filter("_p < 0").select("_v", F.col("_l").alias("_w"))
    inserted = met.filter("_p >= 0").select("_v", "_l", "_p").join(whole, "_v").filter(F.col("_l._first") != F.col("_w._first")).select("_l", "_w", "_p", F.lit(False).alias("_both"))
    links = replaced.unionByName(inserted).groupBy(F.col("_l._h1").alias("_a"), F.col("_w._h1").alias("_b"), "_both").agg(F.min("_p").alias("_p"))
    text = lambda name: lines.select(F.col("_h1").alias(name), F.struct("_first", "_h1", "_h2", "line").alias(f"{name}_line"))
    links = links.join(text("_a"), "_a").join(text("_b"), "_b")
    # the distance is 1 if the lines are equal without that place; levenshtein() seeks each character from the start
    x, y = F.col("_a_line.line"), F.col("_b_line.line")
    links = links.filter(drop(x, F.col("_p")) == F.when(F.col("_both"), drop(y, F.col("_p"))).otherwise(y))
    return links.select(F.greatest("_a_line", "_b_line").alias("l")).select("l._h1", "l._h2").distinct()


def dropped_lines(docs: DataFrame, min_near_chars: int = 20, max_edits: int = 1) -> DataFrame:
    """_id, _doc, _n_lines, exact (places of lines dropped as equal) and near (as nearly equal) of each distinct document of (_id, _doc, text)."""
    lines = docs.select("_id", "_doc", F.posexplode(F.split("text", "\n", -1)).alias("_at", "line")).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    hashed = lines.withColumns({"_h1": F.xxhash64("line"), "_h2": F.xxhash64(F.lit(7), F.col("line")), "_near": F.length("line") >= min_near_chars})
    keyed = hashed.withColumn("_k", F.when(F.col("_near"), _halves(F.col("line"))))
    halves = [F.col("_k")[i].alias(f"_k{i}") for i in range(4)]
    firsts = keyed.select("_h1", "_h2", _position().alias("_p"), *halves).groupBy("_h1", "_h2").agg(F.min("_p").alias("_first"), *[F.first(f"_k{i}").alias(f"_k{i}") for i in range(4)])
    firsts = materialize(firsts)
    placed = hashed.select("_id", "_doc", "_at", "_h1", "_h2").join(firsts.select("_h1", "_h2", "_first"), ["_h1", "_h2"])
    marked = placed.withColumns({"_equal": _position() != F.col("_first"), "_close": F.lit(False)})
    if max_edits:
        by_half = firsts.filter("_k0 IS NOT NULL").select("_h1", "_h2", F.explode(F.array(*[f"_k{i}" for i in range(4)])).alias("_k"))
        shared = by_half.groupBy("_k").agg(F.count("*").alias("_n")).filter("_n > 1").select("_k")
        able = materialize(by_half.join(shared, "_k", "left_semi").select("_h1", "_h2").distinct())
        few = able.count() <= BROADCAST_ROWS
        texts = hashed.filter("_near").select("_h1", "_h2", "line").join(F.broadcast(able) if few else able, ["_h1", "_h2"], "left_semi").groupBy("_h1", "_h2").agg(F.first("line").alias("line"))
        able = materialize(texts.join(firsts.select("_h1", "_h2", "_first"), ["_h1", "_h2"]))
        by_part = able.select("_h1", "_h2", F.explode(_all_but_a_part(F.col("line"))).alias("_k"))
        shared = by_part.groupBy("_k").agg(F.count("*").alias("_n")).filter("_n > 1").select("_k")
        able = materialize(able.join(by_part.join(shared, "_k", "left_semi").select("_h1", "_h2").distinct(), ["_h1", "_h2"], "left_semi"))
        near = materialize(near_links(able))
        few = near.count() <= BROADCAST_ROWS
        near = near.withColumn("_is_near", F.lit(True))
        marked = placed.join(F.broadcast(near) if few else near, ["_h1", "_h2"], "left")
        marked = marked.withColumns({"_equal": _position() != F.col("_first"), "_close": F.coalesce("_is_near", F.lit(False))})
    gone = marked.filter("_equal OR _close").groupBy("_id", "_doc")
    return gone.agg(F.collect_list(F.when(F.col("_equal"), F.col("_at"))).alias("exact"), F.collect_list(F.when(~F.col("_equal"), F.col("_at"))).alias("near"))


def dedup_lines(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_near_chars: int = 20, max_edits: int = 1) -> DataFrame:
    """df with later copies of lines taken out of the text, and n_lines (lines with a word), n_dropped_exact and n_dropped_near."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    names = fresh(df, "n_lines", "n_dropped_exact", "n_dropped_near")
    kept = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), F.col(id_column).alias("_id"), identity(id_column, text_column).alias("_doc"))
    gone = dropped_lines(kept.select("_id", "_doc", F.col(f"_row.`{text_column}`").alias("text")), min_near_chars, max_edits)
    joined = kept.join(gone.select("_doc", "exact", "near"), "_doc", "left")
    text, none = F.col(f"_row.`{text_column}`"), F.array().cast("array<int>")

    def result(lines: Column) -> Column:
        with_word = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(r"[^\x20\x09-\x0D]"))
        exact, near = F.array_distinct(F.coalesce("exact", none)), F.array_distinct(F.coalesce("near", none))
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.concat(exact, near))
        cleaned = F.when(F.size(exact) + F.size(near) == 0, text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
        size = lambda a: F.size(a).cast("long")
        return F.struct(cleaned.alias("text"), size(with_word).alias("n_lines"), size(exact).alias("n_dropped_exact"), size(near).alias("n_dropped_near"))

    out = joined.withColumn("_r", F.when(text.isNotNull(), let(F.split(text, "\n", -1), result)))
    columns = [(F.col("_r.text") if c == text_column else F.col(f"_row.`{c}`")).alias(c) for c in df.columns]
    counts = [F.coalesce(F.col(f"_r.{c}"), F.lit(0).cast("long")).alias(name) for c, name in zip(("n_lines", "n_dropped_exact", "n_dropped_near"), names, strict=True)]
    return out.select(*columns, *counts)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_dropped_exact", "n_dropped_near")


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
w AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS has_word FROM l),
f AS (SELECT line, min(doc_id * 10000000 + place) AS p FROM w WHERE has_word GROUP BY line),
e AS (SELECT * FROM f WHERE length(line) >= 20),
n AS (
  SELECT b.line FROM e a JOIN e b ON a.line[:10] = b.line[:10] AND a.p < b.p AND abs(length(a.line) - length(b.line)) <= 1
    WHERE levenshtein(a.line, b.line) <= 1
  UNION SELECT b.line FROM e a JOIN e b ON a.line[-10:] = b.line[-10:] AND a.p < b.p AND abs(length(a.line) - length(b.line)) <= 1
    WHERE levenshtein(a.line, b.line) <= 1),
m AS (
  SELECT w.doc_id, w.place, w.line, w.has_word,
    w.has_word AND f.p <> w.doc_id * 10000000 + w.place AS equal_one,
    w.has_word AND f.p = w.doc_id * 10000000 + w.place AND n.line IS NOT NULL AS near_one
  FROM w LEFT JOIN f ON w.has_word AND f.line = w.line LEFT JOIN n ON n.line = w.line)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT coalesce(equal_one, false) AND NOT coalesce(near_one, false)), '') AS text,
  count(*) FILTER (has_word) AS n_lines, count(*) FILTER (equal_one) AS n_dropped_exact, count(*) FILTER (near_one) AS n_dropped_near
FROM m GROUP BY doc_id
"""
