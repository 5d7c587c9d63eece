"""Benchmark decontamination by templates: questions are found even with other numbers, names and units.

Words are reduced to templates: a number becomes <num>, a unit behind a number <unit>, a number with its unit <num><unit>, a
capitalised word inside a sentence <name>; the others are lower-cased and lose punctuation at their ends. Windows of `window`
template words (a shorter item is one window of its own length) with at least `least_words` words that are no placeholders are
hashed and joined with those of the benchmark. All windows of the lower-cased words themselves, whatever they hold, are joined
too, so that a verbatim copy doesn't depend on case, on the words before it or on how many placeholders it has, and items of fewer
than `least_words` words are found as a whole, word for word. For each document, item and alignment (the difference of the two
places), the values in the placeholders must correspond: a template window that holds a value of the item which has several values in
the document, or a name of the document that stands for several of the item, is left out. (Two numbers of an item may become one.) An
item is found in a document if the other windows cover `least_covered` of its words, or `least_share` of them where it is shorter.

A bitmap of 2 ** 24 bits, whatever the benchmark's size, tells which windows of a document can be in the benchmark; only those become rows.
They are joined by a broadcast of the benchmark's windows where these are counted to be few, else by a salted shuffle, since a window may be in
very many documents. Words are compared by 64-bit hashes.

Edge cases: null and empty texts and items have no windows; an item of fewer than `least_item` words isn't looked for (one or two words
are no question); rows with equal id and text count as one document; ids may be of any type and null, which is an id of its own; empty
tables give no rows; extra columns are kept by drop_contaminated, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import chunks, identity, materialize, table, with_fields

WINDOW, LEAST_WORDS, LEAST_COVERED, LEAST_SHARE, LEAST_ITEM = 8, 5, 13, 0.8, 3
BITMAP_BITS = 24
#: Windows of the benchmark that are broadcast, some 100 bytes each; more are joined by a shuffle with SALTS parts.
BROADCAST_WINDOWS, SALTS = 200_000, 16
UNITS = frozenset("mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent % dollar dollars $ euro euros cent cents degree degrees °c °f w kw v hz mb gb tb sekunde sekunden minuten stunde stunden tag tage woche wochen monat monate jahr jahre meter pfund tonne tonnen seconde secondes heure heures jour jours semaine semaines mois an ans mètre mètres livre livres tonnes segundo segundos minuto minutos hora horas día días semana semanas mes meses año años metro metros kilo kilos libra libras litro litros kilomètres kilómetros prozent".split())
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
NUMBER_UNIT = re.compile(r"([+-]?\d[\d.,]*)([a-z%°$€£]+)")
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig hundert tausend deux trois quatre cinq sept huit neuf dix onze douze vingt trente cent mille dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cien mil".split())
EDGE = re.compile(r"^[^\w$€£%°+-]+|[^\w$€£%°]+$")
PLAIN, NUM, NUM_UNIT, UNIT = 0, 1, 2, 3
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
CACHE_ENTRIES = 150_000


class Templates:
    """Words to template hashes; properties of each distinct word are found once."""

    def __init__(self):
        import xxhash

        self.digest = xxhash.xxh64_intdigest
        self.mark = np.array([self.digest(b"\x00" + x) for x in (b"num", b"num unit", b"unit", b"name")], np.uint64)
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.hash, self.kind, self.capital, self.ends, self.value = [], [], [], [], []

    def _learn(self, word: bytes) -> int:
        raw = word.decode("utf-8", "replace")
        core = EDGE.sub("", raw)
        low = core.lower()
        kind = PLAIN
        if NUMBER.fullmatch(low) or low in NUMBER_WORDS:
            kind = NUM
        elif NUMBER_UNIT.fullmatch(low) and NUMBER_UNIT.fullmatch(low)[2] in UNITS:
            kind = NUM_UNIT
        elif low in UNITS:
            kind = UNIT
        at = self.place[word] = len(self.hash)
        self.hash.append(self.digest(low.encode()) if low else 0)
        self.kind.append(kind)
        self.capital.append(core[:1].isupper())
        self.ends.append(raw.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":", ";"))
        self.value.append(low)
        return at

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all words of the texts: the text's index, the template hash, if it's a placeholder, the word's index, the word's own hash, and if it's a name."""
        if len(self.hash) > CACHE_ENTRIES:
            self.clear()
        split = [t.split() for t in texts]
        get, learn = self.place.get, self._learn
        index = np.array([p if (p := get(w)) is not None else learn(w) for ws in split for w in ws], np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
        h, kind = np.array(self.hash, np.uint64), np.array(self.kind, np.int8)
        capital, ends = np.array(self.capital, bool), np.array(self.ends, bool)
        if not len(index):
            return owner, np.zeros(0, np.uint64), np.zeros(0, bool), index, np.zeros(0, np.uint64), np.zeros(0, bool)
        first = np.concatenate([[True], (owner[1:] != owner[:-1]) | ends[index[:-1]]])
        real = h[index] != 0  # punctuation alone is no word
        index, owner, first = index[real], owner[real], first[real]
        k = kind[index]
        after = np.concatenate([[False], (k[:-1] == NUM) & (owner[1:] == owner[:-1])]) if len(index) else np.zeros(0, bool)
        out, hole = h[index], np.ones(len(index), bool)
        name = (k == PLAIN) & capital[index] & ~first
        unit = (k == UNIT) & after
        for m, which in zip(self.mark, (k == NUM, k == NUM_UNIT, unit, name), strict=True):
            out[which] = m
        hole = (k == NUM) | (k == NUM_UNIT) | unit | name
        return owner, out, hole, index, h[index], name


def windows(owner: np.ndarray, hashes: np.ndarray, hole: np.ndarray, own: np.ndarray, size: int, least_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Starts and hashes of the windows of `size` words of one text: of templates with enough words, and of the words themselves (True) where a template differs."""
    n = len(hashes) - size + 1
    if n <= 0:
        return
    filled = np.concatenate([[0], np.cumsum(~hole)])
    filled = filled[size:] - filled[:n]
    inside = owner[:n] == owner[size - 1 :]
    for of, good, raw in ((hashes, filled >= min(least_words, size), False), (own, filled < size, True)):
        at = np.flatnonzero(inside & good)
        key = np.full(len(at), np.uint64(size))
        with np.errstate(over="ignore"):
            for k in range(size):
                key = (key ^ of[at + k]) * MULTIPLIER
                key ^= key >> np.uint64(31)
        yield at, key, raw


ROWS = "window long, size int, place int, slots array<string>"


class Found:
    """Columns of windows, and the row each belongs to."""

    def __init__(self):
        self.row, self.window, self.size, self.place, self.slots = [], [], [], [], []

    def add(self, t: Templates, size: int, raw: bool, row: np.ndarray, key: np.ndarray, at: np.ndarray, place: np.ndarray, hole: np.ndarray, index: np.ndarray, name: np.ndarray) -> None:
        self.row.append(row)
        self.window.append(key.view(np.int64))
        self.size.append(np.full(len(at), size, np.int32))
        self.place.append(place.astype(np.int32))
        one = lambda i: "@" + t.value[index[i]] if name[i] else t.value[index[i]]
        self.slots += [[] if raw else [one(i) for i in range(a, a + size) if hole[i]] for a in at.tolist()]

    def columns(self) -> list[pa.Array]:
        joined = [pa.array(np.concatenate(x)) for x in (self.window, self.size, self.place)]
        return [*joined, pa.array(self.slots, pa.list_(pa.string()))]


def _item_rows(items: DataFrame, window: int, least_words: int, least_item: int) -> DataFrame:
    """item_id, n_words and the windows of (item_id, text)."""
    source = items.select("item_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates()
        for rows, texts in chunks(batches, "text"):
            found, n_words = Found(), []
            for i, text in enumerate(texts):
                owner, h, hole, index, words, name = t.words([text or b""])
                n_words.append(len(h))
                size = min(window, len(h))
                if size >= least_item:
                    for at, key, raw in windows(owner, h, hole, words, size, least_words):
                        found.add(t, size, raw, np.full(len(at), i), key, at, at, hole, index, name)
            if found.row:
                own = pa.array(np.concatenate(found.row))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(own), pa.array(n_words, pa.int32()).take(own), *found.columns()], ["item_id", "n_words", "window", "size", "place", "slots"])

    return source.mapInArrow(run, with_fields(source.drop("text"), f"n_words int, {ROWS}"))


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> np.uint64(64 - BITMAP_BITS)).astype(np.int64), (keys & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)


def bitmap_of(item_rows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Two bits for each window of the benchmark, in two maps of fixed size, put together in Spark by word of 32 bits; and the windows' sizes."""
    mask = (1 << BITMAP_BITS) - 1
    high = F.shiftrightunsigned("window", 64 - BITMAP_BITS)
    low = F.col("window").bitwiseAND(F.lit(mask)) + F.lit(1 << BITMAP_BITS)
    bit = item_rows.select("size", F.explode(F.array(high, low)).alias("b"))
    word = bit.groupBy(F.shiftright("b", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(b & 31 AS INT)))").alias("v"))
    out = np.zeros(1 << (BITMAP_BITS - 4), np.uint32)  # 4 MB
    got = word.toArrow()  # at most as many rows as the map has words
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().astype(np.uint32)
    return out, sorted(r["size"] for r in bit.select("size").distinct().collect())


def matches(docs: DataFrame, items: DataFrame, keys: list[str], window: int = WINDOW, least_words: int = LEAST_WORDS, least_covered: int = LEAST_COVERED, least_share: float = LEAST_SHARE, least_item: int = LEAST_ITEM, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """keys, item_id, covered (words of the item), n_words, changed (slots with another value) of documents (keys, text) and items (item_id, text)."""
    import xxhash

    item_rows = materialize(_item_rows(items, window, least_words, least_item))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap_of(item_rows))
    own = [f"_key{i}" for i in range(len(keys))]
    source = docs.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, (bitmap, sizes) = Templates(), sent.value
        test = lambda b: (bitmap[b >> 5] >> (b & 31).astype(np.uint32)) & 1 == 1
        for rows, texts in chunks(batches, "text"):
            owner, h, hole, index, words, name = t.words([x or b"" for x in texts])
            start, found = np.searchsorted(owner, np.arange(len(texts))), Found()
            for size in sizes:
                for at, key, raw in windows(owner, h, hole, words, size, least_words):
                    high, low = _bits(key)
                    hit = test(high)
                    hit[hit] = test(low[hit] + (1 << BITMAP_BITS))
                    if hit.any():
                        a = at[hit]
                        found.add(t, size, raw, owner[a], key[hit], a, a - start[owner[a]], hole, index, name)
            if found.row:
                row = np.concatenate(found.row)
                digest = {i: xxhash.xxh64_intdigest(texts[i]) for i in np.unique(row).tolist()}
                text_hash = pa.array(np.array([digest[i] for i in row.tolist()], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in rows.columns[: len(keys)]], text_hash, *found.columns()], [*own, "_text", "window", "size", "place", "slots"])

    found = source.mapInArrow(run, with_fields(source.drop("text"), f"_text long, {ROWS}"))
    item = item_rows.select("item_id", "n_words", "window", "size", F.col("place").alias("_place"), F.col("slots").alias("_slots"))
    if item.count() <= broadcast_windows:
        met = found.join(F.broadcast(item), ["window", "size"])
    else:
        salt = F.pmod(F.xxhash64("_text", "place"), F.lit(SALTS)).cast("int")
        met = found.withColumn("_salt", salt).join(item.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["window", "size", "_salt"])
    met = met.filter(F.size("slots") == F.size("_slots"))
    pairs = F.zip_with("_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # an alignment has two rows for each window of the item at most, so what is collected is bounded by the item
    aligned = F.collect_set(F.struct(F.col("_place").alias("at"), pairs.alias("pairs"))).alias("_met")
    one = met.groupBy(*own, "_text", "item_id", "n_words", "size", (F.col("place") - F.col("_place")).alias("_shift")).agg(aligned)
    side = lambda pairs, of: F.transform(pairs, lambda p: p[of])
    twice = lambda values: F.array_distinct(F.filter(values, lambda v, i: F.coalesce(v == F.get(values, i + 1), F.lit(False))))
    one = one.withColumn("_pairs", F.array_distinct(F.flatten(F.transform("_met", lambda w: w["pairs"]))))
    one = one.withColumns({"_asked": F.array_sort(side(F.col("_pairs"), "a")), "_named": F.array_sort(F.filter(side(F.col("_pairs"), "b"), lambda v: F.startswith(v, F.lit("@"))))})
    one = one.withColumns({"_torn": twice(F.col("_asked")), "_torn_names": twice(F.col("_named"))})
    whole = F.filter("_met", lambda w: ~F.arrays_overlap(side(w["pairs"], "a"), F.col("_torn")) & ~F.arrays_overlap(side(w["pairs"], "b"), F.col("_torn_names")))
    good = one.withColumn("_met", whole).filter(F.size("_met") > 0)
    changed = F.size(F.filter(F.array_distinct(F.flatten(F.transform("_met", lambda w: w["pairs"]))), lambda p: p["a"] != p["b"]))
    good = good.withColumns({"_changed": changed, "_words": F.flatten(F.transform("_met", lambda w: F.sequence(w["at"], w["at"] + F.col("size") - 1)))})
    per_item = good.groupBy(*own, "_text", "item_id", "n_words").agg(F.size(F.array_distinct(F.flatten(F.collect_set("_words")))).alias("covered"), F.min("_changed").alias("changed"))
    enough = per_item.filter(F.col("covered") >= F.least(F.lit(float(least_covered)), F.ceil(F.col("n_words") * least_share)))
    return enough.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], "item_id", "covered", "n_words", "changed")


def drop_contaminated(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """docs without those in which an item is found, all columns kept."""
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_user"), identity("doc_id", "text").alias("_key"))
    bad = matches(keyed.select("_key", F.col("_user.text").alias("text")), items, ["_key"], **parameters).select("_key").distinct()
    return keyed.join(bad, "_key", "left_anti").select("_user.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that is found in it."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "item_id", F.col("covered").cast("long").alias("covered_words"), F.col("n_words").cast("long").alias("item_words"), F.col("changed").cast("long").alias("changed_slots"))
