"""LM scoring: prediction by partial matching over bytes, pretrained on the corpus, beside a smoothed unigram of words.

The byte-context trie is held as counts of byte strings of max_order + 1 symbols; each text is padded in front by `max_order` start
symbols and closed by an end symbol, so that the counts of all shorter contexts are sums of these. A symbol is predicted in the
longest context that occurred; a context with total T and d different symbols gives c / (T + d), and d / (T + d) to an escape
to the next shorter one (method C). Symbols seen in the context that was left are excluded there, from the counts and from the
escape estimate alike. Behind the empty context all symbols not seen at all are equally likely. The log10 probabilities add up
over a text: its code length in decimal digits.

Counts are of all training documents (crc32 of the id as text, mod 7, is not 2), summed in Spark by key. The trie has no bound: it
is a table of counted strings, distributed by the last symbols of their contexts, so that a group holds all that prices its strings. It
is never sent to executors. Documents are put into blocks of block_bytes; each block's distinct strings are priced by a join, and a
block's prices, bounded by its text, meet its texts by block. Word counts have no bound either: the most frequent words,
head_words at most, are sent to the executors, the rest is joined by a shuffle.

Edge cases: a null text is an empty one (end symbol only); a null id has the crc32 of the empty string; rows with equal ids are
scored each by itself; an empty table gives no rows, and without training documents every symbol is equally likely; other
columns are ignored. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.llm.common import chunks, table, with_fields, written

BITS, END, START, SYMBOLS = 9, 256, 257, 257
GRAM, WORD = 0, 1
EMPTY = np.int64(-1)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def symbols(texts: list[bytes], order: int) -> np.ndarray:
    """The texts' symbols in one row: start symbols, bytes and the end symbol of each."""
    pad, end = np.full(order, START, np.int16), np.array([END], np.int16)
    return np.concatenate([x for t in texts for x in (pad, np.frombuffer(t, np.uint8).astype(np.int16), end)]) if texts else np.zeros(0, np.int16)


def grams(row: np.ndarray, order: int) -> np.ndarray:
    """The keys of the strings that end at each byte and end symbol, in order: context first, last symbol in the low bits."""
    key = np.zeros(max(0, len(row) - order), np.int64)
    for k in range(order + 1):
        key <<= BITS
        key |= row[k : len(row) - order + k]
    return key[row[order:] != START]


class Table:
    """Open addressing from distinct keys to values, built and read with whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.keys = np.full(1 << self.bits, EMPTY, np.int64)
        self.values = np.zeros(1 << self.bits)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == EMPTY
            slot, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot], self.values[slot] = keys[left[put]], values[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys, -1 where there is none."""
        at = self._slot(keys)
        got = self.keys[at]
        out = np.where(got == keys, at, -1)
        open_ = np.flatnonzero((got != keys) & (got != EMPTY))
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.keys[at]
            hit = got == keys[open_]
            out[open_[hit]] = at[hit]
            go = ~hit & (got != EMPTY)
            open_, at = open_[go], at[go]
        return out


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.argsort(keys, kind="stable")
    keys, counts = keys[at], counts[at]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(counts, start) if len(keys) else counts


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words, and the end token, which no word can be."""
    return [*text.lower().split(), b"\n"]


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64).view(np.int64)


class _Gathered:
    """Counts of keys, merged now and then so that memory follows the number of different keys."""

    def __init__(self, most: int = 2_000_000):
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > 2 * self.most:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return _summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))


def in_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """block, row, doc_id and text of (doc_id, text), written: blocks of about block_bytes of text, or of one longer document.

    Small partitions are joined to half a block or so of text: each block asks for its own distinct strings, which are far fewer than
    those of many small blocks together.
    """
    total = docs.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    tasks = max(1, -(-2 * total // block_bytes))
    if tasks < docs.rdd.getNumPartitions():
        docs = docs.coalesce(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        block, size = row, 0
        for rows, texts in chunks(batches, "text"):
            place = []
            for t in texts:
                own = len(t or b"") + 64
                if size and size + own > block_bytes:
                    block, size = row + len(place), 0
                size += own
                place.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(np.arange(row, row + len(texts))), rows.column(0), rows.column(1)], ["block", "row", "doc_id", "text"])
            row += len(texts)

    return written(docs.mapInArrow(run, T.StructType([*T.StructType.fromDDL("block long, row long").fields, *docs.schema.fields])))


def corpus_counts(stored: DataFrame, order: int) -> DataFrame:
    """kind, block, key and n of (block, doc_id, text), written: each block's strings of order + 1 symbols (GRAM; n counts training documents and may be 0), and the training words (WORD)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, words, block = _Gathered(), _Gathered(), 0

        def out(kind: int, got: _Gathered) -> Iterator[pa.RecordBatch]:
            keys, counts = got.merged()
            for i in range(0, len(keys), 200_000):
                k, n = keys[i : i + 200_000], counts[i : i + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(np.full(len(k), block if kind == GRAM else 0, np.int64)), pa.array(k), pa.array(n)], ["kind", "block", "key", "n"])
            got.parts, got.size = [], 0

        for rows, texts in chunks(batches, "text"):
            blocks = rows.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            learnt = [not held_out(d) for d in rows.column(1).to_pylist()]
            lowered = [(t or b"").lower() for t in texts]
            for i, j in zip(cuts, cuts[1:]):
                if blocks[i] != block:
                    yield from out(GRAM, strings)
                    block = int(blocks[i])
                for which in (True, False):
                    own = [t for t, known in zip(lowered[i:j], learnt[i:j], strict=True) if known is which]
                    if own:
                        keys, n = np.unique(grams(symbols(own, order), order), return_counts=True)
                        strings.add(keys, n if which else np.zeros_like(n))
            found = Counter()
            for t, known in zip(lowered, learnt, strict=True):
                if known:
                    found.update(words_of(t))
            words.add(word_hashes(list(found)), np.fromiter(found.values(), np.int64, len(found)))
            for kind, got in ((GRAM, strings), (WORD, words)):
                if len(got.parts) == 1 and got.size > got.most:  # still too many when merged
                    yield from out(kind, got)
        yield from out(GRAM, strings)
        yield from out(WORD, words)

    return written(stored.select("block", "doc_id", "text").mapInArrow(run, "kind int, block long, key long, n long"))


def _mask(length: int) -> int:
    """Takes the last `length` symbols of a key."""
    return (1 << BITS * length) - 1


class Level:
    """Counted strings of j + 1 symbols of whole contexts, and what each context gives its symbols and its escapes.

    Of each context: whole, different (log10 of T + d and of d), and, with the symbols seen in it excluded one order below, `below`
    (log10 of the denominator there) and `escape` (log10 of the escape there).
    """

    def __init__(self, j: int, keys: np.ndarray, n: np.ndarray, lower: Level | None):
        self.keys, self.n = keys, n
        context = keys >> BITS
        start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.contexts = context[start]
        self.d = np.diff(np.append(start, len(keys)))
        self.t = np.add.reduceat(n, start) if len(keys) else n
        self.whole, self.different = np.log10(self.t + self.d), np.log10(self.d)
        if lower is None:
            self.below, self.escape = np.log10(np.maximum(SYMBOLS - self.d, 1)), np.zeros(len(start))
            return
        same = lower.n[np.searchsorted(lower.keys, keys & _mask(j))]  # what occurs in a context occurs in shorter ones
        under = np.searchsorted(lower.contexts, self.contexts & _mask(j - 1))
        fewer = lower.d[under] - self.d
        rest = lower.t[under] - (np.add.reduceat(same, start) if len(keys) else same)
        self.below = np.log10(np.maximum(rest + fewer, 1))
        self.escape = np.log10(np.maximum(fewer, 1)) - self.below


def _place(row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys stand in a sorted row, and whether they do."""
    if not len(row):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(row, keys), len(row) - 1)
    return at, row[at] == keys


def price_of(asked: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 of the probability of the last symbols of strings, whose contexts are whole in levels."""
    known, seen = np.full(len(asked), -1), np.full(len(asked), -1)  # longest known string and context
    hit, below, escapes, whole, different = (np.zeros(len(asked)) for _ in range(5))
    for j, level in enumerate(levels):
        string = asked & _mask(j + 1)
        at, has = _place(level.keys, string)
        known[has], hit[has] = j, np.log10(level.n[at[has]])
        at, has_context = _place(level.contexts, string >> BITS)
        next_, far = has_context & (known == j - 1), has_context & (known < j - 1)
        below[next_] = level.below[at[next_]]
        escapes[far] += level.escape[at[far]]
        seen[has_context], whole[has_context], different[has_context] = j, level.whole[at[has_context]], level.different[at[has_context]]
    escaped = np.where(known < seen, different + escapes - below, 0.0)
    return np.where(seen < 0, -np.log10(SYMBOLS), hit - whole + escaped)


def prices(strings: DataFrame, order: int, rows: int = 500_000) -> DataFrame:
    """key and price (log10 of the probability of the last symbol) of all distinct strings (key, n) of order + 1 symbols; n: 0 if not learnt.

    Strings meet by the last three symbols of their contexts, which makes all longer contexts whole; a group has 257 ** 3 strings at
    most for order 5 and is priced together with others until there are `rows`. Contexts of two symbols are added to the groups that
    end with them (257 rows at most for each), shorter ones are sent to all: 67,000 strings at most by their law of formation.
    """
    group, top = min(3, order), min(1, order)
    learnt = strings.filter("n > 0")

    def counted(length: int) -> DataFrame:
        return learnt.groupBy(F.col("key").bitwiseAND(F.lit(_mask(length))).alias("key")).agg(F.sum("n").alias("n"))

    short, n = _arrays(counted(top + 1))
    low = [_summed(short & _mask(j + 1), n) for j in range(top + 1)]
    sent = strings.sparkSession.sparkContext.broadcast(low)
    rest = strings.select(F.shiftright("key", BITS).bitwiseAND(F.lit(_mask(group))).alias("g"), F.lit(order).alias("j"), "key", "n")
    if order > 2:
        ends = rest.select("g").distinct().withColumn("_end", F.col("g").bitwiseAND(F.lit(_mask(2))))
        two = counted(3).withColumn("_end", F.shiftright("key", BITS))
        rest = rest.unionByName(ends.join(two, "_end").select("g", F.lit(2).alias("j"), "key", "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest: list[Level] = []
        for j, (keys, n) in enumerate(sent.value):
            lowest.append(Level(j, keys, n, lowest[-1] if lowest else None))

        def priced(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            _, j, key, n = part
            own, levels = j == order, list(lowest)
            asked, n_asked = key[own], n[own]
            seen = n_asked > 0
            for k in range(len(levels), order + 1):
                strings = _summed(asked[seen] & _mask(k + 1), n_asked[seen])
                if k == 2 and order > 2:
                    keys, first = np.unique(key[~own], return_index=True)
                    strings = keys, n[~own][first]
                levels.append(Level(k, *strings, levels[-1]))
            price = price_of(asked, levels)
            for i in range(0, len(asked), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(asked[i : i + 200_000]), pa.array(price[i : i + 200_000])], ["key", "price"])

        held, size = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(4)])
            size += batch.num_rows
            if size >= rows:
                part = [np.concatenate(x) for x in zip(*held, strict=True)]
                whole = int(np.searchsorted(part[0], part[0][-1]))  # the last group may go on
                if whole:
                    yield from priced([x[:whole] for x in part])
                held, size = [[x[whole:] for x in part]], len(part[0]) - whole
        if size:
            yield from priced([np.concatenate(x) for x in zip(*held, strict=True)])

    return rest.repartition("g").sortWithinPartitions("g").mapInArrow(run, "key long, price double")


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = df.select("key", "n").toArrow()
    return got.column(0).to_numpy(), got.column(1).to_numpy()


def frequent_words(words: DataFrame, head_words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes (sorted) and counts of all words with a count of `least` or more, head_words at most; and least."""
    by = words.groupBy(F.floor(F.log2(F.col("n") + 0.5)).alias("b")).agg(F.count("*").alias("words")).collect()  # 64 rows at most
    total, least = 0, 1 << 62
    for b, n in sorted(((r["b"], r["words"]) for r in by), reverse=True):
        total += n
        if total > head_words:
            break
        least = 1 << b
    keys, counts = _arrays(words.filter(F.col("n") >= least))
    at = np.argsort(keys)
    return keys[at], counts[at], least


SCORED = "held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<key:long,n:long>>"


def _scored(rows: pa.RecordBatch, lowered: list[bytes], score: np.ndarray, head: np.ndarray, logs: np.ndarray) -> pa.RecordBatch:
    """The rows' scores and sums over frequent words (sorted hashes and logs of counts); rare words are left as hashes and counts."""
    ids = rows.column("doc_id")
    split = [words_of(t) for t in lowered]
    n = np.array([len(ws) for ws in split], np.int64)
    starts = np.cumsum(n) - n  # each text has its end token, so no run is empty
    flat = [w for ws in split for w in ws]
    distinct = list(dict.fromkeys(flat))
    place = dict(zip(distinct, range(len(distinct)), strict=True))
    index = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
    hashes = word_hashes(distinct)
    at = np.minimum(np.searchsorted(head, hashes), max(0, len(head) - 1))
    known = head[at] == hashes if len(head) else np.zeros(len(hashes), bool)
    log = np.where(known, logs[at], 0.0) if len(head) else np.zeros(len(hashes))
    n_known, base = np.add.reduceat(known[index].astype(np.int64), starts), np.add.reduceat(log[index], starts)
    left = np.flatnonzero(~known[index])
    pair, times = np.unique(np.repeat(np.arange(len(n)), n)[left] * len(distinct) + index[left], return_counts=True)
    ends = np.searchsorted(pair, np.arange(len(n) + 1) * len(distinct)).astype(np.int32)
    rare = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(hashes[pair % len(distinct)]), pa.array(times)], ["key", "n"]))
    return pa.RecordBatch.from_arrays(
        [
            rows.column("row"), ids, pa.array([held_out(d) for d in ids.to_pylist()]), pa.array(n),
            pa.array(n_known), pa.array(base), pa.array(score), rare,
        ],
        ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"],
    )


def lm_scores(df: DataFrame, max_order: int = 5, head_words: int = 1_000_000, block_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of (doc_id, text)."""
    stored = in_blocks(df.select("doc_id", "text"), block_bytes)
    counts = corpus_counts(stored, max_order)
    words = written(counts.filter(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("n")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count("*").alias("V")).first()
    n_all, n_words = total["N"], total["V"]
    asked = counts.filter(F.col("kind") == GRAM).select("block", "key")
    strings = written(counts.filter(F.col("kind") == GRAM).groupBy("key").agg(F.sum("n").alias("n")))
    priced = prices(strings, max_order)
    head, head_counts, least = frequent_words(words, head_words)
    sent = df.sparkSession.sparkContext.broadcast((head, np.log10(head_counts + 1.0)))

    def run(group: pa.Table, prices: pa.Table) -> pa.Table:
        head, logs = sent.value
        keys, first = np.unique(prices.column("key").to_numpy(), return_index=True)
        price, out = Table(keys, prices.column("price").to_numpy()[first]), []
        for rows, texts in chunks(group.to_batches(), "text", 1 << 20):
            lowered = [(t or b"").lower() for t in texts]
            place = price.find(grams(symbols(lowered, max_order), max_order))
            ends = np.cumsum([len(t) + 1 for t in lowered])
            score = np.add.reduceat(price.values[place], np.concatenate([[0], ends[:-1]]))
            out.append(_scored(rows, lowered, score, head, logs))
        return pa.Table.from_batches(out)

    dictionary = asked.join(priced, "key").select("block", "key", "price")
    scored = written(stored.groupBy("block").cogroup(dictionary.groupBy("block")).applyInArrow(run, with_fields(stored.select("row", "doc_id"), SCORED)))
    out = scored.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score")
    if least > 1:  # words that aren't among the frequent ones
        rare = scored.select("row", F.explode("rare").alias("w")).select("row", F.col("w.key").alias("key"), F.col("w.n").alias("m"))
        found = rare.join(words.filter(F.col("n") < least).select("key", "n"), "key")
        found = found.groupBy("row").agg(F.sum("m").alias("_known"), F.sum(F.col("m") * F.log10(F.col("n") + 1.0)).alias("_base"))
        out = out.join(found, "row", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("_known", F.lit(0)), "base": F.col("base") + F.coalesce("_base", F.lit(0.0))})
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(n_all + n_words + 1)))).alias("base_score"), "score",
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from those whose remainder isn't 2."""
    return lm_scores(table(spark, sf_dir, "documents"))


ORACLE_SQL = None
