"""Language identification by interpolated Kneser-Ney character models, one for each language.

Texts are lower-cased, runs of other characters than letters become one boundary, and each character is predicted from the
ORDER - 1 before it. Each language's model has absolute discounting with its own discount at each order, continuation counts below
the highest order, and interpolation down to the uniform law. The models are held together in sorted arrays of keys, with a
row of log probabilities (one for each language) for each string that any of them knows, and a row of back-off weights for
each context; a string that none knows is looked up one order below. The language of the lowest cross-entropy per character is
predicted. Rejection is calibrated: a text is rejected if its cross-entropy is above the `quantile` of what the model gives to
held-back labelled texts of the predicted language.

The models are fitted on a bounded sample of labelled rows: max_docs whole documents of each language (those of smallest hash), as
long as they have no more than the language's share of max_sample_chars together; of a language whose first document is longer than
that, its shortest document is taken, so that every language is learnt. Prediction uses the whole text, slice by slice, and nothing
else. The COMMON most frequent letters are a symbol each; any other letter is two symbols (its code point in two parts), so that no
letter is lost in scripts of many letters.

Edge cases: a null text and one without letters is `und` with score 0; so is every text if nothing was learnt; bytes that aren't
UTF-8 are read as U+FFFD; rows with equal ids are predicted each by itself, and ids may be of any type and null; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import BROADCAST_GROUPS, chunks, identity, join_groups, materialize, table, with_fields

ORDER, BITS, BOUNDARY = 5, 12, 0
#: Symbols: 0, the common letters, and the upper and lower parts of the code points of other letters.
COMMON, LOWER_BITS = 1900, 10
UPPER_FROM = 1 + COMMON
LOWER_FROM = UPPER_FROM + (0x110000 >> LOWER_BITS)
SIZE = LOWER_FROM + (1 << LOWER_BITS)
#: Characters that are looked at in one piece.
SLICE = 1 << 20


class Alphabet:
    """Symbols of texts: 0 between words, one for a common letter and two for another one."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        found, n = np.unique(codes, return_counts=True)
        letters = [int(c) for c in found[np.argsort(-n, kind="stable")] if chr(int(c)).isalpha()]
        self.symbol = {c: i + 1 for i, c in enumerate(sorted(letters[:COMMON]))}
        self.size = SIZE
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return {"symbol": self.symbol, "size": self.size, "_table": None}

    def table(self) -> np.ndarray:
        """By code point: 0, the symbol, or minus the (lower-case) code point of a letter of two symbols."""
        if self._table is None:
            out = np.zeros(0x110000, np.int64)
            for c in range(0x110000):
                s = chr(c)
                if s.isalpha():
                    low = s.lower()
                    code = ord(low) if len(low) == 1 else c
                    out[c] = self.symbol.get(code, -code)
            self._table = out
        return self._table

    def symbols(self, text: str) -> np.ndarray:
        """Runs of boundaries are one, also at the ends."""
        sym = self.table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        rare = sym < 0
        if rare.any():
            parts = np.stack([np.where(rare, UPPER_FROM + (-sym >> LOWER_BITS), sym), np.where(rare, LOWER_FROM + (-sym & ((1 << LOWER_BITS) - 1)), -1)], axis=1).ravel()
            sym = parts[parts >= 0]
        keep = np.ones(len(sym), bool)
        keep[1:] = (sym[1:] != BOUNDARY) | (sym[:-1] != BOUNDARY)
        return sym[keep]

    def pieces(self, text: str, size: int = SLICE) -> Iterator[tuple[np.ndarray, int]]:
        """Symbols of one slice of a text after the other, with the last ORDER - 1 before it in front, and how many these are.

        A boundary is in front of each text and behind it.
        """
        before = np.zeros(1, np.int64)
        for at in range(0, len(text) + 1, size):
            sym = self.symbols(text[at : at + size] + ("" if at + size <= len(text) else "\n"))
            if len(sym) and sym[0] == BOUNDARY and before[-1] == BOUNDARY:
                sym = sym[1:]
            joined = np.concatenate([before, sym])
            yield joined, len(before)
            before = joined[-(ORDER - 1) :]

    def keys(self, texts: list[str], size: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the strings of ORDER symbols that end at each symbol of each text, and how many each text has. Symbols before a text are boundaries."""
        rows, n = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            for sym, before in self.pieces(text, size):
                rows += [np.zeros(ORDER - 1 - before, np.int64), sym]
                n[i] += len(sym) - before
        if not rows:
            return np.zeros(0, np.int64), n
        sym = np.concatenate(rows)
        key = np.zeros(max(0, len(sym) - ORDER + 1), np.int64)
        for back in range(ORDER - 1, -1, -1):
            key = key << BITS | sym[ORDER - 1 - back : len(sym) - back]
        # a piece's first ORDER - 1 symbols, whatever they are, end no key
        lengths = np.array([len(a) + len(b) for a, b in zip(rows[::2], rows[1::2], strict=True)])
        starts = np.cumsum(lengths) - lengths
        own = np.ones(len(sym), bool)
        own[(starts[:, None] + np.arange(ORDER - 1)).ravel()] = False
        return key[own[ORDER - 1 :]], n


def _levels(keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For orders 1 to ORDER: strings, and their counts (highest) or the number of different symbols in front (below)."""
    out = [np.unique(keys, return_counts=True)]
    for n in range(ORDER - 1, 0, -1):
        out.append(np.unique(out[-1][0] & ((1 << BITS * n) - 1), return_counts=True))
    return out[::-1]


class Models:
    """The languages' models in shared sorted arrays."""

    def __init__(self, alphabet: Alphabet, texts: dict[str, list[str]]):
        self.alphabet, self.languages = alphabet, sorted(texts)
        width = len(self.languages)
        levels = [_levels(alphabet.keys(texts[lang])[0]) for lang in self.languages]
        self.strings: list[np.ndarray] = []
        self.log_p: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.log_back: list[np.ndarray] = []
        below = None
        for n in range(1, ORDER + 1):
            strings = np.unique(np.concatenate([x[n - 1][0] for x in levels]))
            contexts = np.unique(strings >> BITS)
            p, back = np.zeros((len(strings), width)), np.ones((len(contexts), width))
            for i, x in enumerate(levels):
                own, c = x[n - 1]
                if not len(own):
                    continue
                one, two = (c == 1).sum(), (c == 2).sum()
                discount = float(one / (one + 2 * two)) if one and two else 0.5
                at = np.searchsorted(contexts, own >> BITS)
                total, different = np.bincount(at, c, len(contexts)), np.bincount(at, minlength=len(contexts))
                seen = total > 0
                back[seen, i] = discount * different[seen] / total[seen]
                p[np.searchsorted(strings, own), i] = np.maximum(c - discount, 0) / total[at]
            low = np.full((len(strings), width), 1 / alphabet.size) if below is None else np.exp(below(strings))
            p += back[np.searchsorted(contexts, strings >> BITS)] * low
            self.strings.append(strings)
            self.contexts.append(contexts)
            self.log_p.append(np.log(np.maximum(p, 1e-12)).astype(np.float32))
            self.log_back.append(np.log(np.maximum(back, 1e-12)).astype(np.float32))
            below = lambda keys, n=n: self.predict(keys, n)
        self.limits = np.full(width, np.inf)

    def predict(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probabilities by language of the last symbol of each key."""
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        left = np.arange(len(keys))
        for n in range(order, 0, -1):
            own = keys[left] & ((1 << BITS * n) - 1)
            at = np.minimum(np.searchsorted(self.strings[n - 1], own), len(self.strings[n - 1]) - 1)
            hit = self.strings[n - 1][at] == own
            out[left[hit]] += self.log_p[n - 1][at[hit]]
            left, own = left[~hit], own[~hit]
            if not len(left):
                return out
            at = np.minimum(np.searchsorted(self.contexts[n - 1], own >> BITS), len(self.contexts[n - 1]) - 1)
            known = self.contexts[n - 1][at] == own >> BITS
            out[left[known]] += self.log_back[n - 1][at[known]]
        out[left] -= np.log(self.alphabet.size)
        return out

    def entropies(self, texts: list[str], size: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol by text and language, and the number of symbols of each text (boundaries alone: 0)."""
        sums, n, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)

        def add(which: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
            some = counts > 0
            if not some.any():
                return
            starts = (np.cumsum(counts) - counts)[some]
            np.subtract.at(sums, which[some], np.add.reduceat(self.predict(keys).astype(np.float64), starts, axis=0))
            np.logical_or.at(letters, which[some], np.logical_or.reduceat((keys & ((1 << BITS) - 1)) != BOUNDARY, starts))
            np.add.at(n, which, counts)

        short = [i for i, t in enumerate(texts) if len(t) <= size]
        add(np.array(short, np.int64), *self.alphabet.keys([texts[i] for i in short], size))
        for i, text in enumerate(texts):
            if len(text) > size:
                for sym, before in self.alphabet.pieces(text, size):
                    sym = np.concatenate([np.zeros(ORDER - 1 - before, np.int64), sym])
                    key = np.zeros(len(sym) - ORDER + 1, np.int64)
                    for back in range(ORDER - 1, -1, -1):
                        key = key << BITS | sym[ORDER - 1 - back : len(sym) - back]
                    add(np.array([i]), key, np.array([len(key)]))
        return sums / np.maximum(n, 1)[:, None], np.where(letters, n, 0)


def fit(sample: list[tuple[str, str]], quantile: float = 0.995) -> Models | None:
    """From pairs (language, text); every fifth text of a language is held back for the limits of rejection."""
    texts: dict[str, list[str]] = {}
    for lang, text in sample:
        if any(c.isalpha() for c in text):
            texts.setdefault(lang, []).append(text)
    if not texts:
        return None
    learn = {lang: [t for i, t in enumerate(ts) if i % 5 or len(ts) < 10] for lang, ts in texts.items()}
    models = Models(Alphabet([t for ts in learn.values() for t in ts]), learn)
    for i, lang in enumerate(models.languages):
        held = [t for j, t in enumerate(texts[lang]) if j % 5 == 0 and len(texts[lang]) >= 10]
        if held:
            entropy, n = models.entropies(held)
            if (n > 0).any():
                models.limits[i] = np.quantile(entropy[n > 0, i], quantile)
    return models


def labelled_sample(df: DataFrame, max_docs: int, max_sample_chars: int) -> list[tuple[str, str]]:
    """(lang, text) of whole documents of (doc_id, text, lang): max_docs rows of smallest hash of each language within its share of
    max_sample_chars, or its shortest where that is longer."""
    learnt = F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 != 1)
    rows = df.filter(learnt).select("lang", identity("doc_id", "text").alias("k"), F.length("text").cast("long").alias("n"))
    stats = materialize(rows.groupBy("lang").agg(F.count("*").alias("rows"), F.min_by("k", F.struct("n", "k")).alias("shortest")))
    languages = stats.count()
    share = max_sample_chars // max(1, languages)
    # of a frequent language only hashes in the range of about twice the rows wanted are sorted
    in_range = F.pmod(F.col("k.a"), F.lit(1_000_000)) < 1_000_000 * (2 * max_docs + 100) / F.col("rows")
    few = join_groups(rows, stats.select("lang", "rows"), "lang", "rows").filter(in_range)
    order = Window.partitionBy("lang").orderBy("k")
    few = few.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_docs)
    few = few.withColumn("chars", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("chars") <= share).select("lang", "k")
    chosen = few.unionByName(stats.select("lang", F.col("shortest").alias("k")).join(few.select("lang").distinct(), "lang", "left_anti"))
    chosen = F.broadcast(chosen) if max_docs * languages <= 100 * BROADCAST_GROUPS else chosen
    texts = df.filter(learnt).select("lang", identity("doc_id", "text").alias("k"), "text").join(chosen, ["lang", "k"], "left_semi")
    return [(r["lang"], r["text"]) for r in texts.groupBy("lang", "k").agg(F.first("text").alias("text")).orderBy("lang", "k").collect()]


def predict_language(df: DataFrame, models: Models | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior of the prediction over up to 100 symbols), cross_entropy and rejected of (doc_id, text)."""
    sent = df.sparkSession.sparkContext.broadcast(models)
    source = df.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for rows, raw in chunks(batches, "text", 1 << 20):
            ids = rows.column(0).to_pylist()
            names, score, entropy, rejected = ["und"] * len(raw), np.zeros(len(raw)), [None] * len(raw), [False] * len(raw)
            if m is not None:
                h, n = m.entropies([(t or b"").decode("utf-8", "replace") for t in raw])
                best = h.argmin(axis=1)
                gap = np.exp(-(h - h.min(axis=1)[:, None]) * np.minimum(n, 100)[:, None])
                for i in np.flatnonzero(n):
                    names[i], entropy[i] = m.languages[best[i]], float(h[i, best[i]])
                    rejected[i] = bool(h[i, best[i]] > m.limits[best[i]])
                    score[i] = 1 / gap[i].sum()
            out = [zlib.crc32(b"" if d is None else str(d).encode()) % 3 == 1 for d in ids]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(out), pa.array(names), pa.array(score), pa.array(entropy, pa.float64()), pa.array(rejected)],
                ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    return source.mapInArrow(run, with_fields(source.drop("text"), "held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"))


def op7_language(spark: SparkSession, sf_dir: str, max_docs: int = 400, max_sample_chars: int = 8_000_000) -> DataFrame:
    """The language of every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    return predict_language(docs, fit(labelled_sample(docs, max_docs, max_sample_chars)))
