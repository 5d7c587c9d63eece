"""Chat formatting: conversations become one marked-up string with a loss mask, by Spark expressions only.

Turn structs of a conversation are collected and sorted, adjacent turns of one role are merged with array functions (a block starts
where a role differs from the one before), and the blocks are concatenated. Control strings inside texts and roles are escaped: a backslash is doubled, and a backslash is
put behind the first character of each control string, so that no control string is left and the original can be read back.

Edge cases: a null text or role is an empty one; a null turn sorts first; ties in turn are ordered by role and text; a null
conv_id is a conversation of its own; repeated rows are turns of their own; an empty table gives an empty result; other columns are
ignored. Work is near linear in a conversation's turns and characters. A conversation is one string in the end, so Spark's limit of
2 GB for a value bounds it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import let, table


@dataclass(frozen=True)
class ChatTemplate:
    """start role newline text (sep text)* end, for each block of adjacent turns of one role."""

    start: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    end: str = "<|im_end|>\n"
    newline_in_role: str = "<|im_nl|>"
    loss_role: str = "assistant"
    #: Strings that must not appear in a text as they are; each is at least two characters long and has no backslash.
    reserved: tuple[str, ...] = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")

    def escape(self, text: Column) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for s in self.reserved:
            out = F.replace(out, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}"))
        return out

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"\\([\s\S])", "$1")


#: Parts whose places are counted together, and characters of a piece that spans are read from.
RUN, PIECE = 256, 4096


def _merge(turns: Column) -> Column:
    """array<struct<role, texts>>: adjacent turns of one role in one block."""

    def blocks(ts: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (i == 0) | (F.get(ts, i)["role"] != F.get(ts, i - 1)["role"]))
        spans = let(first, lambda at: F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.struct(a.alias("a"), F.coalesce(b, F.size(ts)).alias("b"))))
        return F.transform(spans, lambda x: F.struct(F.get(ts, x["a"])["role"].alias("role"), F.transform(F.slice(ts, x["a"] + 1, x["b"] - x["a"]), lambda t: t["text"]).alias("texts")))

    return let(turns, blocks)


def _spans(parts: Column) -> Column:
    """array<struct<start, length>> of the parts under the loss: places are counted in runs of RUN parts, then the runs are put behind each other."""
    kind = "struct<pos:bigint,spans:array<struct<start:bigint,length:bigint>>>"
    none = F.from_json(F.lit('{"pos":0,"spans":[]}'), kind)

    def add(acc: Column, p: Column) -> Column:
        n = F.length(p["s"]).cast("long")
        span = F.array(F.struct(acc["pos"].alias("start"), n.alias("length")))
        return F.struct((acc["pos"] + n).alias("pos"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def counted(ps: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / RUN).cast("int")), lambda k: F.aggregate(F.slice(ps, k * RUN + 1, F.lit(RUN)), none, add))
        ends = lambda rs: F.aggregate(rs, F.array(F.lit(0).cast("long")), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["pos"])))
        moved = lambda r, before: F.transform(r["spans"], lambda x: F.struct((x["start"] + before).alias("start"), x["length"].alias("length")))
        return let(runs, lambda rs: F.flatten(F.zip_with(rs, F.slice(ends(rs), 1, F.size(rs)), moved)))

    return let(parts, counted)


def _read(text: Column, spans: Column) -> Column:
    """The strings of text at the spans; text is cut into pieces first, so that no span is sought from its start."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def one(ps: Column, x: Column) -> Column:
        at, off = F.floor(x["start"] / PIECE).cast("int"), (x["start"] % PIECE).cast("int")
        over = F.floor((off + x["length"]) / PIECE).cast("int") + 1
        return F.substring(F.array_join(F.slice(ps, at + 1, over), ""), off + 1, x["length"].cast("int"))

    return let(pieces, lambda ps: F.transform(spans, lambda x: one(ps, x)))


def format_chat(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """conv_id, n_turns, formatted and loss_spans (array of start and length in characters, start from 0) of each conversation."""
    t = template or ChatTemplate()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    merged = (
        conversations.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"), _merge(F.col("turns")).alias("blocks"))
    )

    def pieces(b: Column) -> Column:
        piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
        no, loss = F.lit(False), b["role"] == t.loss_role
        head = F.concat(F.lit(t.start), F.replace(t.escape(b["role"]), F.lit("\n"), F.lit(t.newline_in_role)), F.lit("\n"))
        texts = F.flatten(F.transform(b["texts"], lambda x, i: F.array(piece(F.when(i > 0, F.lit(t.sep)).otherwise(F.lit("")), no), piece(t.escape(x), loss))))
        return F.concat(F.array(piece(head, no)), texts, F.array(piece(F.lit(t.end), no)))

    parts = merged.select("conv_id", "n_turns", F.flatten(F.transform("blocks", pieces)).alias("parts"))
    return parts.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("formatted"),
        _spans(F.col("parts")).alias("loss_spans"),
    )


def parse_chat(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Reads format_chat's output back: its columns, turns (array of role and text) and loss_text."""
    t = template or ChatTemplate()
    quote = lambda s: re.sub(r"([^\w\n])", r"\\\1", s)

    def block(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        role = t.unescape(F.replace(head, F.lit(t.newline_in_role), F.lit("\n")))
        body = F.substring(b, F.length(head) + 2, F.length(b) - F.length(head) - 1 - len(t.end))
        return F.transform(F.split(body, quote(t.sep), -1), lambda x: F.struct(role.alias("role"), t.unescape(x).alias("text")))

    blocks = F.split("formatted", quote(t.start), -1)
    masked = F.transform(_read(F.col("formatted"), F.col("loss_spans")), t.unescape)
    return formatted.withColumns({"turns": F.flatten(F.transform(F.slice(blocks, 2, F.size(blocks)), block)), "loss_text": F.array_join(masked, "")})


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one whose texts are control strings, as read back from the formatted string."""
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L conv_id, t turn, r role, '{tricky}' text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = parse_chat(format_chat(rows))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(expr: str) -> str:
    out = f"replace({expr}, '\\', '\\\\')"
    for s in ChatTemplate().reserved:
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return out


ORACLE_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_sql_escaped("text")}) + CASE WHEN before = role THEN 10 ELSE 12 + length({_sql_escaped("role")}) + 1 + 11 END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""
