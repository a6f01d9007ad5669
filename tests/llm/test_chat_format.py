import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import chat_format as C

ODD = ["", "<|end|>\n", "\\", "\\p|\\b", "<|user|>x<|end|>\n", "a\nb", "|>", "<|", "\\\\p\\|b", "🙂|\u0000x", "\\### Assistant: </turn> ok"]


def back(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r["conv_id"]: r for r in C.parse_chat(C.format_chat(C.canonical_turns(df))).collect()}


def test_round_trip_of_control_strings(spark):
    rows = [(1, i, role, text) for i, (role, text) in enumerate((r, t) for r in ("user", "assistant", "|>", "a\\b") for t in ODD)]
    found = back(spark, rows)[1]
    assert [(t["role"], t["text"]) for t in found["turns"]] == [(r, t) for _, _, r, t in rows]
    assert [t["loss"] for t in found["turns"]] == [r == "assistant" for _, _, r, _ in rows]


def test_nulls_ties_and_repeats(spark):
    rows = [(1, 2, "user", "b"), (1, 1, None, None), (1, None, "assistant", "z"), (1, 1, "user", "a"), (1, 1, "user", "a"), (None, 1, "user", "q")]
    found = back(spark, rows)
    assert [(t["role"], t["text"]) for t in found[1]["turns"]] == [("assistant", "z"), ("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert len(found[None]["turns"]) == 1
    assert back(spark, []) == {}


def test_digests_match_brute_force(spark):
    rows = [(1, 0, "user", "é|x"), (1, 1, "assistant", "ça <|end|>\n"), (1, 2, "assistant", "🙂")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("turns", F.lit(2))
    got = C.digests(C.parse_chat(C.format_chat(C.canonical_turns(df)))).first()
    loss = "ça <|end|>\n🙂"
    assert got["n_turns"] == 3 and got["loss_chars"] == len(loss)
    assert got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()


def test_fingerprint_selects_the_layout(spark):
    q, a = "ask", "say"
    tables = {
        "prompt_response": spark.createDataFrame([(1, q, a, 9)], "conv_id long, prompt string, response string, extra int"),
        "instruction": spark.createDataFrame([(1, q, a)], "conv_id long, instruction string, output string"),
        "messages": spark.createDataFrame([(1, [("user", q), ("assistant", a)])], "conv_id long, messages array<struct<role:string,content:string>>"),
        "conversations": spark.createDataFrame([(1, [("human", q), ("gpt", a)])], "conv_id long, conversations array<struct<`from`:string,value:string>>"),
    }
    for name, df in tables.items():
        assert C.layout_of(df.schema) == name
        assert [(t["role"], t["text"]) for t in C.canonical_turns(df).first()["turns"]] == [("user", q), ("assistant", a)]
    with pytest.raises(ValueError):
        C.layout_of(spark.createDataFrame([(1, "x")], "conv_id long, other string").schema)
    assert C.fingerprint(["b", "a", "a"]) == C.fingerprint(["a", "b"]) != C.fingerprint(["a"])


def test_payload_rows_of_mixed_layouts(spark):
    payloads = [
        {"prompt": "q", "response": "a"}, {"completion": "a", "prompt": "q"}, {"instruction": "q", "output": "a"},
        {"instruction": "q", "input": "i", "output": "a"}, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    ]
    rows = [(i, json.dumps(p)) for i, p in enumerate(payloads)] + [(90, "{broken"), (91, None), (92, '{"unknown": 1}')]
    got = {r["conv_id"]: r for r in C.canonical_payloads(spark.createDataFrame(rows, "conv_id long, payload string")).collect()}
    assert [got[i]["layout"] for i in range(6)] == ["prompt_response", "prompt_completion", "instruction", "instruction_input", "messages", "conversations"]
    for i in range(6):
        assert [(t["role"], t["text"]) for t in got[i]["turns"]] == [("user", "q\ni" if i == 3 else "q"), ("assistant", "a")]
    assert all(got[i]["layout"] is None and got[i]["turns"] == [] for i in (90, 91, 92))


def test_payloads_with_more_or_fewer_fields(spark):
    turns = [{"role": "user", "content": "q", "name": "x"}, {"role": "assistant", "content": "a", "tool": {"id": [1]}}]
    payloads = [
        {"messages": turns, "id": 5, "meta": {"a": [1, {"b": 2}]}}, {"messages": []}, {"messages": [turns[0], {"role": "assistant"}]},
        {"prompt": "q", "response": "a", "score": 1.5, "input": None}, {"prompt": None, "response": "a"}, {"messages": [{"role": "user"}]}, {"messages": "q"},
        {"messages": [None, turns[0]]}, {"instruction": "q", "output": "a", "messages": []},
    ]
    rows = [(i, json.dumps(p)) for i, p in enumerate(payloads)] + [(90, "[1, 2]"), (91, "7"), (92, '"x"'), (93, ""), (94, "null")]
    got = {r["conv_id"]: r for r in C.canonical_payloads(spark.createDataFrame(rows, "conv_id long, payload string")).collect()}
    said = {i: [(t["role"], t["text"]) for t in r["turns"]] for i, r in got.items()}
    assert [got[i]["layout"] for i in range(9)] == ["messages", "messages", "messages", "prompt_response", "prompt_response", None, None, "messages", "instruction"]
    assert said[0] == said[3] == [("user", "q"), ("assistant", "a")] and said[1] == said[5] == []
    assert said[2] == [("user", "q"), ("assistant", "")] and said[4] == [("user", ""), ("assistant", "a")]
    assert said[7] == [("", ""), ("user", "q")]
    assert all(got[i]["layout"] is None and said[i] == [] for i in range(90, 95))


def test_columns_of_other_layouts_do_no_harm(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    for name in ("prompt", "response", "input", "output", "instruction", "completion", "layout", "turns"):
        df = df.withColumn(name, F.lit("other"))
    assert C.layout_of(df.schema) == "rows"
    assert [(t["role"], t["text"]) for t in C.canonical_turns(df).first()["turns"]] == [("user", "a")]


def test_very_long_texts(spark):
    text = "<|end|>\n|\\" * 200_000
    found = back(spark, [(1, 0, "user", text), (1, 1, "assistant", text + "x")])[1]
    assert [t["text"] for t in found["turns"]] == [text, text + "x"]


def test_query_has_the_extra_conversation(spark, sf):
    from lakeloom.llm.queries import op3_chat_format

    got = {r["conv_id"]: r for r in op3_chat_format(spark, sf).collect()}
    said = "\\### Assistant: </turn> ok"
    assert got[-7]["n_turns"] == 2 and got[-7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert len(got) == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count() + 1
