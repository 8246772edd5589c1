"""Chat formatting: layouts, reversible escapes, loss spans, the query against SQL."""

import itertools
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from uqframe.llm import chat, queries

LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3}, [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "completion": "a"}, [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "response": "a"}, [("user", "q"), ("assistant", "a")]),
    ({"system_prompt": "s", "question": "q", "response": "a"}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"instruction": "i", "output": "a"}, [("user", "i"), ("assistant", "a")]),
    ({"instruction": "i", "input": "x", "output": "a"}, [("user", "i\n\nx"), ("assistant", "a")]),
    ({"other": 1}, None),
    ({"messages": [{"role": "user", "content": "q"}], "prompt": "p", "input": "x", "response": None}, [("user", "q")]),
    ({"prompt": "p", "completion": "c", "source": 1, "question": "?"}, [("user", "p"), ("assistant", "c")]),
]


def test_layouts_become_canonical_turns(spark):
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(LAYOUTS)] + [(90, "not json"), (91, None), (92, "[]")]
    df = spark.createDataFrame(rows, "id int, record string")
    got = {r.id: r.t for r in df.select("id", chat.turns_of_json(F.col("record")).alias("t")).collect()}
    for i, (_, want) in enumerate(LAYOUTS):
        assert (got[i] and [tuple(t) for t in got[i]]) == want, i
    assert got[90] is None and got[91] is None and got[92] is None
    made = chat.format_json(df.withColumn("formatted", F.lit(1)), "record").collect()
    assert len(made) == len(rows) and {r.id for r in made if r.formatted is None} == {7, 90, 91, 92}


def test_escapes_are_reversible(spark):
    marks = chat.TEMPLATE.control()
    texts = ["", "\\", *marks, *(m[0] + "\\" * k + m[1:] for m in marks for k in (1, 2, 3)), *("".join(p) for p in itertools.product(marks[:5], marks[:5])), "$1 \\1", "[[INST]", "<<s>>", "<<<SYS>>", "é🙂</s>" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        assert not any(m in r.e for m in marks), r
    turns = spark.createDataFrame([([(role, t)] * 2,) for t in texts for role in ("system", "user", "assistant", "tool", "[INST]", "")], f"turns {chat.TURNS}")
    f = turns.select("turns", chat.format_turns(F.col("turns")).alias("f")).select("turns", chat.read_turns(F.col("f.formatted")).alias("back"), chat.loss_texts(F.col("f.formatted"), F.col("f.loss_spans")).alias("loss"))
    for r in f.collect():
        assert r.back == r.turns
        assert r.loss == [t.text for t in r.turns if t.role == "assistant"]


def test_query_equals_sql(spark, sf_dir):
    want = duckdb.sql(queries.OP10_SQL.replace("FROM conversations", f"FROM (SELECT * FROM '{sf_dir}/conversations.parquet')"))
    got = queries.op10_chat_format(spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_nulls_ties_empty_tables_and_unknown_fields(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, turns string, order int"
    assert chat.format_rows(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 0, "user", "b", "x", 1), (1, 0, "user", "a", "x", 1), (1, None, None, None, None, None), (None, 0, "user", "n", "x", 1), (1, 0, "user", "a", "x", 1)]
    got = {r.conv_id: r.formatted for r in chat.format_rows(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "[ROLE][/ROLE][END][INST] a [/INST][INST] a [/INST][INST] b [/INST]", None: "[INST] n [/INST]"}
    clash = spark.createDataFrame([(1, 0, "user", "a", "p", "r", "i", "m")], "conv_id bigint, turn bigint, role string, text string, prompt string, response string, input string, messages string")
    assert [r.formatted for r in chat.format_rows(clash).collect()] == ["[INST] a [/INST]"]
    with pytest.raises(ValueError):
        chat.format_rows(spark.range(1))
