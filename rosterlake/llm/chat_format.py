"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as
context, and only that reply trainable. Turns stand between marks; a mark's
string inside a text is escaped, so that an example can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opening and closing marks of the named roles. Others stand as [ROLE]name[/ROLE]text[/TURN].
MARKS: dict[str, tuple[str, str]] = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
TARGET = "assistant"
#: What follows the first sign of a mark's string; backslashes between the two are levels of escape.
_REST = r"\\*/?(?:s>|(?:INST|SYS|ROLE|TURN)\])"
_PLAIN = rf"([<\[])({_REST})"
_ESCAPED = rf"([<\[])\\({_REST})"
_TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|\[SYS\].*?\[/SYS\]|\[ROLE\].*?\[/TURN\]"
#: Turns of the conversation that the query adds: texts made of marks.
MARKED = "</s>[INST] ok [/INST]"


def escaped(text: Column) -> Column:
    """One backslash more in every string that is a mark, or would be one without its backslashes."""
    return F.regexp_replace(text, _PLAIN, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def _between(s: Column, head: Column | int, tail: int) -> Column:
    return F.substring(s, F.lit(head) + 1, F.greatest(F.char_length(s) - head - tail, F.lit(0)))


def _formatted(role: Column, text: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1]), escaped(text), F.lit(OTHER[2]))
    for name, (head, tail) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(head), escaped(text), F.lit(tail))).otherwise(out)
    return out


def turns_of(example: Column) -> Column:
    """The turns of a formatted text, array of (role, text)."""

    def read(s: Column) -> Column:
        name = F.char_length(F.substring_index(s, OTHER[1], 1))
        role = _between(F.substring_index(s, OTHER[1], 1), len(OTHER[0]), 0)
        text = _between(s, name + len(OTHER[1]), len(OTHER[2]))
        for known, (head, tail) in MARKS.items():
            role = F.when(s.startswith(head), F.lit(known)).otherwise(role)
            text = F.when(s.startswith(head), _between(s, len(head), len(tail))).otherwise(text)
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(F.regexp_extract_all(example, F.lit(_TURN), F.lit(0)), read)


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """(conv_id, lone_row, n_turns, text, loss_start, loss_chars): the examples of conversations (conv_id, turn, role, text).

    One for each assistant turn, ending with it; loss_start and loss_chars (code
    points) mark the reply inside its marks. Where turns follow the last
    assistant turn, or there is none, one more example holds the whole
    conversation with nothing trainable (loss_chars 0), so that no turn is lost.
    Turns go by turn (null first), ties by role and text; repeated rows are
    turns of their own. Null text and null role count as empty. A row without
    conv_id is a conversation of its own, told apart by lone_row. Other columns
    are ignored. Empty table: no rows.

    A conversation is one row here, since the example of its last reply is as
    large; its examples are made one by one.
    """
    # a number for rows without an id only: all others meet by their id
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.withColumn("lone_row", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    whole = rows.groupBy("conv_id", "lone_row").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("turns", i)["role"] == TARGET) | (i == n))
    made = whole.select("conv_id", "lone_row", F.transform("turns", lambda t: _formatted(t["role"], t["text"])).alias("parts"), F.transform("turns", lambda t: t["role"] == TARGET).alias("target"), ends.alias("ends"))
    each = made.select("conv_id", "lone_row", "parts", "target", F.explode("ends").alias("n_turns"))
    head, tail = map(len, MARKS[TARGET])
    last, trained = F.char_length(F.element_at("parts", F.col("n_turns"))), F.element_at("target", F.col("n_turns"))
    each = each.select("conv_id", "lone_row", F.col("n_turns").cast("long"), F.array_join(F.slice("parts", 1, F.col("n_turns")), "").alias("text"), last.alias("last"), trained.alias("trained"))
    return each.select(
        "conv_id", "lone_row", "n_turns", "text",
        F.when(F.col("trained"), F.char_length("text") - F.col("last") + head).otherwise(F.char_length("text")).cast("long").alias("loss_start"),
        F.when(F.col("trained"), F.col("last") - head - tail).otherwise(0).cast("long").alias("loss_chars"),
    )


def conversation_digests(examples: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the examples of each conversation."""
    loss = unescaped(F.substring("text", F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int")))
    by = examples.withColumn("loss", loss).groupBy("conv_id", "lone_row").agg(F.max_by("text", "n_turns").alias("longest"), F.sort_array(F.collect_list(F.struct("n_turns", "loss"))).alias("losses"), F.sum(F.char_length("text")).alias("formatted_chars"))
    read = by.select("conv_id", turns_of(F.col("longest")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_marked(conversations: DataFrame) -> DataFrame:
    """conversations and conversation -7, whose texts are marks."""
    spark = conversations.sparkSession
    extra = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, TARGET, MARKED)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


_ESCAPE = rf"regexp_replace({{}}, '{_PLAIN}', '\1\\\2', 'g')"
ORACLE_SQL = rf"""
WITH c AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS k, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{MARKED}'), (-7, 1, 'assistant', '{MARKED}'))),
f AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, k ORDER BY turn NULLS FIRST, role, text) AS pos, count(*) OVER (PARTITION BY conv_id, k) AS n,
    length({_ESCAPE.format("text")}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 11 ELSE 20 + length({_ESCAPE.format("role")}) END AS chars
  FROM c),
g AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id, k ORDER BY pos) AS upto FROM f)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR pos = n)::BIGINT AS formatted_chars
FROM g GROUP BY conv_id, k
"""
