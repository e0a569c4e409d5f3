"""Chat formatting against a plain expansion, and the way back."""

from __future__ import annotations

import hashlib

import duckdb
import pytest

from rosterlake.llm import chat_format
from rosterlake.llm.queries import ORACLE, QUERIES

CHAT = "conv_id long, turn long, role string, text string, n_turns int, parts string, lone_row string"
TEXTS = [None, "", " ", chat_format.MARKED, "<s>", "<\\s>", "<\\\\/s>", "[INST] [/INST]", "[/SYS][SYS]", "[ROLE]x[/ROLE]y[/TURN]", "[\\/TURN]", "a\n$1\\2", "<", "[", "[INST", "</s", "日本🙂", "x" * 50_000, "\\", "<<s>>", "[[INST]]"]


def odd_rows():
    rows = [(k, t, role, x, 5, "p", "q") for k, role in enumerate(["user", "assistant", "system", "tool", "", "[INST] ", "<s>"]) for t, x in enumerate(TEXTS)]
    rows += [(100, t, ("user", "assistant")[t % 2], TEXTS[t], 0, "", "") for t in range(len(TEXTS))]
    rows += [(101, 1, "assistant", "same", 0, "", "")] * 3 + [(101, None, "user", "first", 0, "", ""), (101, None, None, None, 0, "", "")]
    rows += [(102, 0, "user", "no reply", 0, "", "")]
    rows += [(None, 0, "assistant", "lone", 0, "", "")] * 2 + [(None, 1, "user", None, 0, "", ""), (None, None, None, None, 0, "", "")]
    return rows


def plain(rows):
    """conv -> sorted turns of (role, text)."""
    by = {}
    for k, (conv, turn, role, text, *_) in enumerate(rows):
        by.setdefault((conv, k if conv is None else None), []).append((turn is not None, turn or 0, role or "", text or ""))
    return [(conv, [t[2:] for t in sorted(turns)]) for (conv, _), turns in by.items()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_examples_and_digests(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, CHAT).repartition(4)
    examples = chat_format.prefix_targets(df)
    got = examples.withColumn("turns", chat_format.turns_of(examples.text)).collect()
    want = []
    for conv, turns in plain(rows):
        ends = [i for i, (role, _) in enumerate(turns, 1) if role == "assistant" or i == len(turns)]
        want += [(conv, i, tuple(turns[:i]), turns[i - 1][1] if turns[i - 1][0] == "assistant" else None) for i in ends]
    for r in got:
        reply = r.text[r.loss_start : r.loss_start + r.loss_chars]
        turns = tuple((t.role, t.text) for t in r.turns)
        trained = turns[-1][0] == "assistant"
        assert (r.conv_id, r.n_turns, turns, turns[-1][1] if trained else None) in want
        assert not trained or r.text.endswith(f"<s>{reply}</s>") and (r.loss_chars or turns[-1][1] == "")
    assert len(got) == len(want)
    digests = [tuple(r) for r in chat_format.conversation_digests(examples).drop("formatted_chars").collect()]
    told = [(conv, len(ts), sha("".join(f"{r}\n{x}\n" for r, x in ts)), sum(len(x) for r, x in ts if r == "assistant"), sha("".join(x for r, x in ts if r == "assistant"))) for conv, ts in plain(rows)]
    assert sorted(digests, key=str) == sorted(told, key=str)


def test_marks_never_stand_in_texts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if t], "t string")
    for r in df.select("t", chat_format.escaped(df.t).alias("e"), chat_format.unescaped(chat_format.escaped(df.t)).alias("u")).collect():
        assert r.u == r.t
        assert not any(m in r.e for m in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[/TURN]"))


def test_sql_on_odd_rows(spark, tmp_path):
    spark.createDataFrame(odd_rows(), CHAT).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df = QUERIES["op11_chat_format"](spark, str(tmp_path))
    cursor = con.execute(ORACLE["op11_chat_format"])
    names = [d[0] for d in cursor.description]
    want = [tuple(r[names.index(c)] for c in df.columns) for r in cursor.fetchall()]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_empty(spark):
    df = spark.createDataFrame([], CHAT)
    assert chat_format.conversation_digests(chat_format.prefix_targets(df)).collect() == []
    assert chat_format.conversation_digests(chat_format.prefix_targets(chat_format.with_marked(df))).count() == 1


@pytest.mark.parametrize("word", ["Python", "Arrow", "Pandas"])
def test_plan_is_native_with_one_exchange(spark, word):
    df = QUERIES["op11_chat_format"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert word not in plan
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
