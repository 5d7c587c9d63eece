"""BPE encoding and decoding of whole texts with a word-end BPE vocabulary, by tree concatenation.

A text is halved until its pieces have LEAF_BYTES at most, wherever that cuts it. The pieces are encoded, and neighbours are
joined level by level, the joins of a level for all texts at hand at once. At a join inside a word, both sides have a fragment that isn't
encoded yet: the window of the joined word and one word on each side is encoded anew, and grows until its first and last words get the
tokens that the sides have themselves. The tokenizer never joins across ASCII white space, so such a join is exact. Words are encoded
once each (a bounded cache keeps them). A word longer than LEAF characters is a tree of its own, joined token by token: the last tokens of
the left side and the first of the right side are encoded anew as one window, which grows until its first token is the left side's own and
its last token is the right side's own. BPE is determined by its adjacent pairs of tokens, so a join on which both sides agree is
exact, however long the text is. Texts above PIECE_BYTES are halved to rows of their own, which are encoded in parallel tasks and joined
by text.

Edge cases: null and empty texts have no tokens and decode to the empty string; special tokens inside texts are found as the
library finds them; bytes that aren't UTF-8 are read as U+FFFD; rows with equal ids are encoded each by itself (equal rows of very long texts
once for all), and ids may be of any type and null; an empty table gives no rows; other columns are ignored by encode_texts. No text is
cut off.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import chunks, identity, table, with_fields

LEAF, LEAF_BYTES, PIECE_BYTES = 256, 1024, 1 << 20
SPACES = b" \t\n\r\x0b\x0c"
#: Parts of a generation of the cache; two generations are kept, and what is used again moves to the newer one.
CACHE_ENTRIES = 350_000


class TreeEncoder:
    """Encodes one long pre-token by tree concatenation."""

    def __init__(self, spec: dict, leaf: int = LEAF):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["merges"]]
        self.leaf, self.suffix = leaf, spec.get("end_of_word_suffix") or ""
        self.inner = Tokenizer(BPE(vocab=spec["vocab"], merges=merges))
        self.last = Tokenizer(BPE(vocab=spec["vocab"], merges=merges, end_of_word_suffix=self.suffix or None))
        self.length = {i: len(t) for t, i in spec["vocab"].items()}
        if self.suffix:
            self.length |= {i: len(t) - len(self.suffix) for t, i in spec["vocab"].items() if t.endswith(self.suffix)}

    def _join(self, text: str, at: int, mid: int, end: int, left: list[int], right: list[int], is_last: bool) -> list[int]:
        """The tokens of text[at:end], from those of text[at:mid] and text[mid:end]."""
        k = 1
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            start = mid - sum(self.length[i] for i in left[len(left) - a :])
            stop = mid + sum(self.length[i] for i in right[:b])
            coder = self.last if is_last and b == len(right) else self.inner
            window = coder.encode(text[start:stop], add_special_tokens=False).ids
            agree_left = a == len(left) or window[0] == left[len(left) - a]
            agree_right = b == len(right) or window[-1] == right[b - 1]
            if agree_left and agree_right:
                return left[: len(left) - a] + window + right[b:]
            k *= 2

    def encode(self, text: str) -> list[int]:
        cuts = [*range(0, len(text), self.leaf), len(text)]
        leaves = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        parts = [e.ids for e in self.inner.encode_batch(leaves[:-1], add_special_tokens=False)] if len(leaves) > 1 else []
        parts.append(self.last.encode(leaves[-1], add_special_tokens=False).ids)
        spans = list(zip(cuts, cuts[1:]))
        while len(parts) > 1:
            joined, over = [], []
            for i in range(0, len(parts) - 1, 2):
                (at, mid), (_, end) = spans[i], spans[i + 1]
                joined.append(self._join(text, at, mid, end, parts[i], parts[i + 1], end == len(text)))
                over.append((at, end))
            if len(parts) % 2:
                joined.append(parts[-1])
                over.append(spans[-1])
            parts, spans = joined, over
        return parts[0]


def halves(text: bytes, size: int) -> list[bytes]:
    """The text in pieces of `size` bytes at most, cut in halves between characters."""
    if len(text) <= size:
        return [text]
    mid = len(text) // 2
    while mid < len(text) and text[mid] & 0xC0 == 0x80 and len(text) // 2 + 4 > mid:
        mid += 1
    return [*halves(text[:mid], size), *halves(text[mid:], size)]


class Node:
    """A piece of text: fragments of words at its ends, and between them whole words, each with its tokens (little-endian).

    solid is a piece inside one word. A word is None where its string isn't at hand.
    """

    __slots__ = ("head", "solid", "tail", "tokens", "words")

    def __init__(self, solid: bytes | None, head: bytes = b"", tail: bytes = b"", words: list[bytes | None] | None = None, tokens: list[bytes] | None = None):
        self.solid, self.head, self.tail, self.words, self.tokens = solid, head, tail, words or [], tokens or []


class PartEncoder:
    """Texts to ids (as little-endian unsigned 32-bit integers) and decoded text, by parts without white space."""

    def __init__(self, spec_json: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.spec_json, self.leaf = spec_json, leaf
        self.library = Tokenizer.from_str(spec_json)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(spec_json)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # without a decoder the library puts a space between tokens
        self.tokens = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size())] if spec.get("decoder") is None else None
        self.inside: TreeEncoder | None = None
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.joins = self.windows = 0

    def _long(self, part: str) -> list[int]:
        self.inside = self.inside or TreeEncoder(json.loads(self.spec_json)["model"], self.leaf)
        out: list[int] = []
        for piece in self.cut.split(part) if self.cut else [part]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                for token, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece)):
                    out += [t.id for t in self.library.model.tokenize(token)] if len(token) <= self.leaf else self.inside.encode(token)
        return out

    def learn(self, parts: set[bytes]) -> None:
        """Puts the parts into the cache."""
        new = [p for p in parts if p not in self.cache]
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            self.cache, self.older = {}, self.cache
            new = list(parts)
        unknown = []
        for p in new:
            ids = self.older.get(p)
            if ids is None:
                unknown.append(p)
            else:
                self.cache[p] = ids
        strings = [p.decode("utf-8", "replace") for p in unknown]
        short = [i for i, s in enumerate(strings) if len(s) <= self.leaf]
        found = dict(zip(short, self.library.encode_batch_fast([strings[i] for i in short], add_special_tokens=False), strict=True))
        for i, s in enumerate(strings):
            self.cache[unknown[i]] = np.array(found[i].ids if i in found else self._long(s), "<u4").tobytes()

    def leaves(self, pieces: list[bytes]) -> list[Node]:
        """Nodes of pieces of a text, their whole words encoded."""
        split = [p.split() for p in pieces]
        ends = []
        for piece, words in zip(pieces, split, strict=True):
            if len(words) == 1 and len(words[0]) == len(piece):
                ends.append((words.pop(), b"", b""))
                continue
            head = words.pop(0) if words and piece[0] not in SPACES else b""
            tail = words.pop() if words and piece[-1] not in SPACES else b""
            ends.append((None if piece else b"", head, tail))
        self.learn({w for words in split for w in words})
        get = self.cache.__getitem__
        return [Node(solid, head, tail, words, list(map(get, words))) for (solid, head, tail), words in zip(ends, split, strict=True)]

    def join(self, pairs: list[tuple[Node, Node]]) -> list[Node]:
        """The joined nodes. Windows are encoded in one batch; a long word is a tree of its own."""
        out, open_words = [], []
        self.joins += len(pairs)
        for a, b in pairs:
            if a.solid is not None and b.solid is not None:
                out.append(Node(a.solid + b.solid))
            elif a.solid is not None:
                out.append(Node(None, a.solid + b.head, b.tail, b.words, b.tokens))
            elif b.solid is not None:
                out.append(Node(None, a.head, a.tail + b.solid, a.words, a.tokens))
            elif mid := a.tail + b.head:
                out.append(Node(None, a.head, b.tail, [*a.words, mid, *b.words], [*a.tokens, b"", *b.tokens]))
                open_words.append((out[-1], len(a.words)))
            else:  # white space at the cut: both sides' tokens are final
                out.append(Node(None, a.head, b.tail, a.words + b.words, a.tokens + b.tokens))
        grow = 1
        while open_words:
            left = []
            spans = [(node, at, max(0, at - grow), min(len(node.words), at + grow + 1)) for node, at in open_words if len(node.words[at]) <= self.leaf]
            found = self.library.encode_batch_fast([b" ".join(node.words[a:b]).decode("utf-8", "replace") for node, _, a, b in spans], add_special_tokens=False)
            self.windows += len(spans)
            for (node, at, a, b), window in zip(spans, found, strict=True):
                ids = np.array(window.ids, "<u4").tobytes()
                before, after = b"".join(node.tokens[a:at]), b"".join(node.tokens[at + 1 : b])
                # grown by one word on each side, the window must begin and end with those words' own tokens
                if ids.startswith(before) and ids.endswith(after) and len(ids) >= len(before) + len(after):
                    node.tokens[at] = ids[len(before) : len(ids) - len(after)]
                elif (a, b) == (0, len(node.words)):
                    raise ValueError("the tokenizer joins words across white space")
                else:
                    left.append((node, at))
            for node, at in open_words:
                if len(node.words[at]) > self.leaf:
                    node.tokens[at] = np.array(self._long(node.words[at].decode("utf-8", "replace")), "<u4").tobytes()
            open_words, grow = left, grow * 2
        return out

    def encode(self, texts: list[bytes], leaf_bytes: int = LEAF_BYTES) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        pieces = [halves(t, leaf_bytes) for t in texts]
        flat = iter(self.leaves([p for ps in pieces for p in ps]))
        return self.closed(self.tree([[next(flat) for _ in ps] for ps in pieces]))

    def tree(self, rows: list[list[Node]]) -> list[Node]:
        """One node of each row, its nodes joined by neighbours."""
        while any(len(r) > 1 for r in rows):
            joined = iter(self.join([(r[i], r[i + 1]) for r in rows for i in range(0, len(r) - 1, 2)]))
            rows = [[next(joined) for _ in range(len(r) // 2)] + r[len(r) - len(r) % 2 :] for r in rows]
        return [r[0] for r in rows]

    def closed(self, nodes: list[Node]) -> list[bytes]:
        """The ids of nodes that are whole texts."""
        self.learn({w for n in nodes for w in (n.solid, n.head, n.tail) if w})
        own = lambda w: self.cache[w] if w else b""
        return [own(n.solid) if n.solid is not None else own(n.head) + b"".join(n.tokens) + own(n.tail) for n in nodes]

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        return " ".join([self.tokens[i] for i in numbers]) if self.tokens else self.library.decode(numbers, skip_special_tokens=False)


#: The encoder of this Python worker, kept from task to task.
_CODER: list[PartEncoder] = []


def _coder(spec_json: str, leaf: int) -> PartEncoder:
    if not _CODER or (_CODER[0].spec_json, _CODER[0].leaf) != (spec_json, leaf):
        _CODER[:] = [PartEncoder(spec_json, leaf)]
    return _CODER[0]


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"
NODE = "at long, solid binary, head binary, tail binary, body binary, first binary, last binary"


def tokenizer_spec(path: str) -> str:
    """The tokenizer's JSON, read on the driver; it is sent to the executors, a few MB whatever the input."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_texts(df: DataFrame, spec_json: str, with_ids: bool = True, leaf: int = LEAF, leaf_bytes: int = LEAF_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """doc_id, n_tokens, digests, and with with_ids the ids and the decoded text, of (doc_id, text)."""
    sent = df.sparkSession.sparkContext.broadcast(spec_json)
    source = df.select("doc_id", "text")
    schema = with_fields(source.drop("text"), SCHEMA + (", ids array<int>, decoded string" if with_ids else ""))

    def result(coder: PartEncoder, ids: pa.Array, encoded: list[bytes]) -> pa.RecordBatch:
        decoded = [coder.decode(i) for i in encoded]
        columns = [ids, pa.array([len(i) // 4 for i in encoded], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in encoded]), pa.array([hashlib.sha256(s.encode()).hexdigest() for s in decoded])]
        if with_ids:
            columns += [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in encoded], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value, leaf)
        for rows, texts in chunks(batches, "text"):
            yield result(coder, rows.column(0), coder.encode([t or b"" for t in texts], leaf_bytes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                for at, piece in enumerate(halves(batch.column(3)[i].as_py().encode(), piece_bytes)):
                    yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in batch.columns[:3]], pa.array([at], pa.int64()), pa.array([piece], pa.binary())], ["doc_id", "copies", "k", "at", "piece"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value, leaf)
        for batch in batches:
            for i in range(len(batch)):
                node = coder.tree([coder.leaves(halves(batch.column(4)[i].as_py(), leaf_bytes))])[0]
                first, last = (node.words[0], node.words[-1]) if node.words else (None, None)
                fields = [[node.solid], [node.head], [node.tail], [b"".join(node.tokens)], [first], [last]]
                yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in batch.columns[:4]], *[pa.array(f, pa.binary()) for f in fields]], [*batch.schema.names[:4], "solid", "head", "tail", "body", "first", "last"])

    def put_together(group: pa.Table) -> pa.Table:
        coder, nodes = _coder(sent.value, leaf), []
        for r in sorted(group.select(["at", "solid", "head", "tail", "body", "first", "last"]).to_pylist(), key=lambda r: r["at"]):
            ends = [r["first"], r["last"]] if r["first"] else []
            coder.learn(set(ends))
            own = [coder.cache[w] for w in ends]
            if ends and r["body"] == own[0]:
                words, tokens = ends[:1], own[:1]
            else:  # between the first and the last word, what isn't needed for joins is one entry
                words, tokens = ([ends[0], None, ends[1]], [own[0], r["body"][len(own[0]) : len(r["body"]) - len(own[1])], own[1]]) if ends else ([], [])
            nodes.append(Node(r["solid"], r["head"], r["tail"], words, tokens))
        one = result(coder, group.column("doc_id").slice(0, 1).combine_chunks(), coder.closed(coder.tree([nodes])))
        return pa.Table.from_batches([one]).take(pa.array([0] * group.column("copies")[0].as_py()))

    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = source.filter(size <= piece_bytes).mapInArrow(run, schema)
    long = source.filter(size > piece_bytes).withColumn("k", identity("doc_id", "text")).groupBy("k").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("text").alias("text"))
    long = long.select("doc_id", "copies", F.to_json("k").alias("k"), "text")
    pieces = long.mapInArrow(cut, with_fields(long.drop("text"), "at long, piece binary")).repartition("k", "at")
    nodes = pieces.mapInArrow(encode, with_fields(long.drop("text"), NODE))
    return short.unionByName(nodes.groupBy("k").applyInArrow(put_together, schema))


def default_spec() -> str:
    import public_tokenizers

    return tokenizer_spec(public_tokenizers.path("word_bpe_49k.json"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text of documents."""
    return encode_texts(table(spark, sf_dir, "documents"), default_spec(), with_ids=False)
