"""Token counts by rank-synchronous array merging, for a piece vocabulary with byte fallback.

Pre-tokens of a batch are held as one ragged array of symbol numbers. In each round every sequence merges its pair of
lowest rank, all sequences at once; a sequence without a known pair is done. All places of that pair are merged in one round, from the left and
without overlap, up to the first one whose merged symbol makes a pair of as low a rank with a neighbour, which has to come before the
others. So a long sequence takes about as many rounds as it uses ranks and not as it has merges. What is left is counted: a
symbol that is a piece is one token, any other one is as many as it has UTF-8 bytes. Sequences are cut where no piece has the two
characters next to each other, which can't change the result. Distinct pre-tokens are counted once (a bounded cache keeps them).

Edge cases: null and empty texts have no tokens; special strings in texts are ordinary text; rows with equal ids are
counted each by itself, and ids may be of any type and null; bytes that aren't UTF-8 are read as U+FFFD; an empty table gives no rows; other
columns are ignored. Texts are never cut off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sextant.llm.common import chunks, table, with_fields

MARK = "▁"
NONE = np.iinfo(np.int32).max
CACHE_ENTRIES = 400_000


class PieceTable:
    """What merging needs from a vocabulary: pieces with a score, higher first. Its size doesn't depend on the input."""

    def __init__(self, pieces: list[tuple[str, float]]):
        score = dict(pieces)
        symbols = sorted({c for p in score for c in p} | set(score))
        number = {s: i for i, s in enumerate(symbols)}
        self.m = len(symbols)
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = sorted((number[p[:i]] * self.m + number[p[i:]], ranks[v], number[p]) for p, v in score.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        self.keys = np.array([k for k, _, _ in pairs], np.int64)
        self.ranks = np.array([r for _, r, _ in pairs], np.int32)
        self.merged = np.array([n for _, _, n in pairs], np.int32)
        self.cost = np.array([1 if s in score else len(s.encode()) for s in symbols], np.int64)
        self.chars = {ord(s): n for s, n in number.items() if len(s) == 1}
        self.bigrams = np.unique(np.array([ord(a) << 21 | ord(b) for p in score for a, b in zip(p, p[1:])], np.int64))

    def code_points(self) -> np.ndarray:
        """Symbol by code point, -1 where there is none."""
        out = np.full(0x110000, -1, np.int32)
        for c, n in self.chars.items():
            out[c] = n
        return out


class Counter:
    def __init__(self, pieces: PieceTable):
        self.t, self.symbol_of = pieces, pieces.code_points()
        self.cache: dict[str, int] = {}

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no such pair) and the pair's place in the table."""
        t = self.t
        key = left.astype(np.int64) * t.m + right
        at = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
        found = (t.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, t.ranks[at], NONE), at

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each of the words, none empty."""
        t = self.t
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        total = np.zeros(len(words), np.int64)
        sym = self.symbol_of[codes]
        unknown = sym < 0
        if unknown.any():
            c = codes[unknown]
            np.add.at(total, word[unknown], 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))
        key = codes[:-1] << 21 | codes[1:]
        at = np.minimum(np.searchsorted(t.bigrams, key), len(t.bigrams) - 1)
        joined = (t.bigrams[at] == key) & (word[:-1] == word[1:])
        seq = np.concatenate([[0], np.cumsum(~joined)])
        lengths = np.bincount(seq)
        done = lengths == 1
        alone = done[seq] & ~unknown
        np.add.at(total, word[alone], t.cost[sym[alone]])
        go = ~done[seq]
        sym, seq, word = sym[go], seq[go], word[go]
        rank = np.full(len(sym), NONE, np.int32)
        made = np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            rank[:-1], made[:-1] = self._pair(sym[:-1], sym[1:])
            rank[:-1][seq[:-1] != seq[1:]] = NONE
        while len(sym):
            start = np.concatenate([[True], seq[1:] != seq[:-1]])
            first = np.flatnonzero(start)
            least = np.minimum.reduceat(rank, first)
            own = np.cumsum(start) - 1
            over = least[own] == NONE
            if over.any():
                np.add.at(total, word[over], t.cost[sym[over]])
                live = ~over
                sym, seq, word, rank, made = sym[live], seq[live], word[live], rank[live], made[live]
                continue
            hit = np.flatnonzero(rank == least[own])
            in_run = np.arange(len(hit))
            in_run -= np.maximum.accumulate(np.where(np.concatenate([[True], hit[1:] != hit[:-1] + 1]), in_run, 0))
            hit = hit[in_run % 2 == 0]
            new, low = t.merged[made[hit]], rank[hit]
            close = np.concatenate([[False], hit[1:] == hit[:-1] + 2])  # the symbol to the left is merged, too
            left = np.where(close, np.roll(new, 1), sym[hit - 1])
            right = sym[np.minimum(hit + 2, len(sym) - 1)]
            inside = (hit > 0) & (seq[hit - 1] == seq[hit])
            early = inside & (self._pair(left, new)[0] <= low)
            inside = (hit + 2 < len(sym)) & (seq[np.minimum(hit + 2, len(sym) - 1)] == seq[hit])
            early |= inside & (self._pair(new, right)[0] <= low)
            if early.any():  # of its sequence, the places up to the first of these
                n_early = np.cumsum(early) - early
                head = np.concatenate([[True], seq[hit[1:]] != seq[hit[:-1]]])
                hit = hit[n_early == n_early[head][np.cumsum(head) - 1]]
                new = t.merged[made[hit]]
            sym = sym.copy()
            sym[hit] = new
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # places after the right halves are gone
            sym, seq, word, rank, made = sym[keep], seq[keep], word[keep], rank[keep], made[keep]
            for p in (at, at[at > 0] - 1):  # pairs to the right of the new symbol and to its left
                inside = p[p + 1 < len(sym)]
                r, n = self._pair(sym[inside], sym[inside + 1])
                same = seq[inside] == seq[inside + 1]
                rank[inside], made[inside] = np.where(same, r, NONE), n
                rank[p[p + 1 >= len(sym)]] = NONE
        return total

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            self.cache.clear()
            new = list(words)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.cache.update(zip(part, self.count(part).tolist(), strict=True))


#: A run of spaces and the word behind it. No piece of the vocabulary has a space mark behind another character. The mark itself is a space, too.
PRETOKEN = re.compile(" *[^ ]+| +")


def pretokens(text: str) -> list[str]:
    return PRETOKEN.findall(" " + text.replace(MARK, " ")) if text else []


def piece_table(path: str) -> PieceTable:
    """Reads a vocabulary on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    pieces = [(sp.id_to_piece(i).replace(MARK, " "), sp.get_score(i)) for i in ids]
    if any(" " in p.lstrip(" ") for p, _ in pieces):
        raise ValueError("a piece has a space inside")
    return PieceTable(pieces)


def count_tokens(df: DataFrame, pieces: PieceTable, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of (doc_id, text)."""
    sent = df.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for rows, texts in chunks(batches, "text"):
            counter = counter or Counter(sent.value)
            split = [pretokens((t or b"").decode("utf-8", "replace")) for t in texts]
            counter.learn({w for ws in split for w in ws})
            n = [sum(map(counter.cache.__getitem__, ws)) for ws in split]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    source = df.select("doc_id", "text")
    return source.mapInArrow(run, with_fields(source.drop("text"), "n_bytes long, n_tokens long, over_limit boolean"))


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of documents."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), piece_table(public_tokenizers.path("piece_bpe_32k.model")))
