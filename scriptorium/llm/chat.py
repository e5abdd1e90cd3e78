"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role are
merged into one message, and messages are concatenated:

    <|turn|>role<|text|>text<|next|>text of the next turn of the same role<|end|>

Control strings inside roles and texts are made harmless by a backslash after their first
character, backslashes are doubled, so the format can be read back exactly (``read_turns``).
The loss mask lists the spans of assistant texts in code points of the formatted string.

Edge cases: null texts and roles are empty; rows of equal turn are ordered by role and text, null
turns come first; repeated rows are turns of their own; rows of a null conversation id form one
conversation; an empty table gives no rows; extra columns are ignored. A conversation is one output
value, so it is gathered in one task and bounded by what a string may hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .quality_rules import let

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: Control strings of this and of common other templates, and their escapes.
ESCAPES = (("\\", "\\\\"), ("<|", "<\\|"), ("<s>", "<\\s>"), ("</s>", "<\\/s>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]"))
BLOCK = 512


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _starts(lengths: Column) -> Column:
    """The sum of all earlier lengths for each, block by block so that long arrays stay linear."""
    append = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))

    def of(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x))
        heads = F.aggregate(sums, F.array(F.lit(0).cast("long")), append)
        return F.flatten(F.zip_with(blocks, F.slice(heads, F.lit(1), F.size(blocks)), lambda b, h: F.slice(F.aggregate(b, F.array(h), append), F.lit(1), F.size(b))))

    cuts = F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(BLOCK))
    return let(F.transform(cuts, lambda k: F.slice(lengths, k + 1, F.lit(BLOCK))), of)


def _messages(turns: Column) -> Column:
    """Runs of adjacent turns of one role, as (role, texts)."""
    heads = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))

    def run(h: Column) -> Column:
        size = lambda k, i: F.coalesce(F.get(h, k + 1), F.size(turns)) - i
        return F.transform(h, lambda i, k: F.struct(F.get(turns, i)["role"].alias("role"), F.transform(F.slice(turns, i + 1, size(k, i)), lambda t: t["text"]).alias("texts")))

    return let(heads, run)


def _formatted(messages: Column) -> Column:
    """The string, and the spans of assistant texts in it."""
    head = lambda m: F.concat(F.lit(TURN), m["role"], F.lit(TEXT))
    pieces = F.flatten(
        F.transform(
            messages,
            lambda m: F.transform(
                m["texts"],
                lambda t, k: F.struct(
                    F.when(k == 0, head(m)).otherwise(F.lit(NEXT)).alias("before"), t.alias("text"),
                    F.when(k == F.size(m["texts"]) - 1, F.lit(END)).otherwise(F.lit("")).alias("after"), (m["role"] == "assistant").alias("loss"),
                ),
            ),
        )
    )

    def of(p: Column) -> Column:
        length = F.transform(p, lambda x: (F.length(x["before"]) + F.length(x["text"]) + F.length(x["after"])).cast("long"))
        spans = F.zip_with(p, let(length, _starts), lambda x, s: F.struct((s + F.length(x["before"])).alias("first"), F.length(x["text"]).cast("long").alias("length"), x["loss"].alias("loss")))
        text = F.array_join(F.transform(p, lambda x: F.concat(x["before"], x["text"], x["after"])), "")
        loss = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["first"].alias("first"), s["length"].alias("length")))
        return F.struct(text.alias("formatted"), loss.alias("loss_spans"))

    return let(pieces, of)


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) from (conv_id, turn, role, text) rows."""
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    turns = turns.withColumn("turns", F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))))
    return turns.select("conv_id", let(F.col("turns"), lambda t: let(_messages(t), _formatted)).alias("f")).select("conv_id", "f.*")


def read_turns(formatted: Column) -> Column:
    """The original (role, text) turns of a formatted conversation."""
    inner = F.regexp_extract_all(formatted, F.lit(r"(?s)<\|turn\|>(.*?)<\|end\|>"), F.lit(1))
    parts = F.transform(inner, lambda m: F.split(m, r"<\|text\|>"))
    return F.flatten(F.transform(parts, lambda p: F.transform(F.split(F.get(p, F.lit(1)), r"<\|next\|>"), lambda t: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(t).alias("text")))))


def loss_text(formatted: Column, spans: Column) -> Column:
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(formatted, s["first"].cast("int") + 1, s["length"].cast("int"))), ""))


def query(spark, sf_dir):
    both = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{both}'), (-1L, 1L, 'assistant', '{both}') AS t(conv_id, turn, role, text)")
    out = format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own))
    out = out.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = "{0}"
for _raw, _safe in ESCAPES:
    _ESCAPED = f"replace({_ESCAPED}, '{_raw}', '{_safe}')"
SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w IS DISTINCT FROM role AS head
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_ESCAPED.format("text")}) + CASE WHEN head THEN {len(TURN + TEXT + END)} + length({_ESCAPED.format("role")}) ELSE {len(NEXT)} END) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
