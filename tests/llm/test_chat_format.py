"""Chat formatting of request payloads against a plain reader of the same layouts, and exact round trips."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from deckloom.llm.chat_format import MAPPINGS, before_each, escape, format_chats, layouts, learned_text, read_turns, unescape

ODD = ["", " ", "</s>[INST] ok [/INST]", "<s>", "[INST]", "[\\INST]", "<\\\\/s>", "<<s>", "[[/INST]]", "\\", "<\\", "line\nbreak\ttab", "漢字 💡 é", "\"q\"", "$1 \\2",
       "a</s", "s>", " \u0085", "<S>", "\x01"]


def parts(*texts):
    return [{"type": "input_text", "text": t} for t in texts]


#: Payload, layout and turns.
CASES = [
    ({"prompt": "Hi"}, "prompt", [("user", "Hi")]),
    ({"completion": "Yes", "prompt": "Hi", "temperature": 0.5}, "prompt_completion", [("user", "Hi"), ("assistant", "Yes")]),
    ({"instructions": "Be brief", "input": "Hi"}, "instructions_input", [("system", "Be brief"), ("user", "Hi")]),
    ({"instructions": "Be brief", "input": "Hi", "output": "Yes"}, "instructions_input_output",
     [("system", "Be brief"), ("user", "Hi"), ("assistant", "Yes")]),
    ({"input": "Hi", "output": None}, "input_output", [("user", "Hi"), ("assistant", "")]),
    ({"system_text": "S", "user_text": "U", "schema_name": "deck"}, "call_texts", [("system", "S"), ("user", "U")]),
    ({"model": "m", "store": False, "reasoning": {"effort": "high"}, "input": [
        {"role": "system", "content": parts("S")},
        {"role": "user", "content": [*parts("look", "here"), {"type": "input_image", "image_url": "data:", "detail": "high"}]}]},
     "input_messages", [("system", "S"), ("user", "look\nhere")]),
    ({"instructions": "S", "input": [{"role": "user", "content": "U", "id": "1"}]}, "instructions_messages", [("system", "S"), ("user", "U")]),
    ({"messages": [{"role": "user", "content": "Hi", "name": "n"}, {"role": "assistant", "content": None}, {"role": None, "content": 7}]},
     "messages", [("user", "Hi"), ("assistant", ""), ("", "7")]),
    ({"messages": [{"role": "user", "content": "Hi"}, {"role": "assistant", "content": parts("a", "b")}]}, "messages",
     [("user", "Hi"), ("assistant", "a\nb")]),
    ({"messages": []}, "messages", []),
    ({"conversations": [{"from": "human", "value": "Hi"}, {"from": "gpt", "value": "Yes"}, {"from": "tool", "value": "t"}]}, "speakers",
     [("user", "Hi"), ("assistant", "Yes"), ("tool", "t")]),
]


@pytest.fixture
def requests(spark):
    return lambda texts: spark.createDataFrame([(i, t, "kept", 3) for i, t in enumerate(texts)],
                                               "trace_id bigint, payload_json string, chat string, _row int")


def read(df):
    back = df.select("trace_id", "chat.*", read_turns(F.col("chat.formatted")).alias("turns"),
                     learned_text(F.col("chat.formatted"), F.col("chat.loss_mask")).alias("learned"))
    return {r["trace_id"]: r for r in back.collect()}


def test_layouts(requests):
    done = format_chats(requests([json.dumps(c[0], ensure_ascii=bool(i % 2)) for i, c in enumerate(CASES)]))
    assert done.columns == ["trace_id", "payload_json", "_row", "chat"]
    got = read(done)
    assert len({r["fingerprint"] for r in got.values()}) >= len(MAPPINGS)
    for i, (_, layout, turns) in enumerate(CASES):
        assert (got[i]["layout"], got[i]["reason"]) == (layout, None)
        assert [tuple(t) for t in got[i]["turns"]] == turns
        assert got[i]["learned"] == "".join(t for r, t in turns if r == "assistant")
        plain = "<s>" + "".join(f"[INST]{r}[/INST]{t}</s>" for r, t in turns)
        assert got[i]["formatted"] == plain
        assert [plain[s["start"]:s["end"]] for s in got[i]["loss_mask"]] == [t for r, t in turns if r == "assistant"]


def test_order_of_fields_does_not_matter(requests):
    got = read(format_chats(requests(['{"prompt":"a","completion":"b"}', '{"x":{"y":[1]},"completion":"b","prompt":"a"}'])))
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[0]["formatted"] == got[1]["formatted"]


def test_what_no_layout_fits(requests):
    got = read(format_chats(requests([None, "", "{", "[1]", '"text"', "{}", '{"prompt":{"text":"a"}}', '{"messages":[{"text":"a"}]}',
                                      '{"output":"x"}', '{"prompt":"a","prompt":"b"}'])))
    assert [got[i]["reason"] for i in range(10)] == ["not_json"] * 3 + ["unknown_layout"] * 6 + ["not_json"]
    assert all(r["formatted"] is None and r["loss_mask"] is None for r in got.values())


def test_odd_texts_come_back(requests):
    rng = random.Random(4)
    chats = [[(rng.choice(["user", "assistant", "system", *ODD]), "".join(rng.choices(ODD, k=rng.randrange(4)))) for _ in range(rng.randrange(9))]
             for _ in range(200)]
    got = read(format_chats(requests([json.dumps({"messages": [{"role": r, "content": t} for r, t in c]}) for c in chats])))
    for i, turns in enumerate(chats):
        assert [tuple(t) for t in got[i]["turns"]] == turns
        assert got[i]["learned"] == "".join(t for r, t in turns if r == "assistant")
        body = got[i]["formatted"]
        assert len(re.findall(r"</s>", body)) == len(turns) == len(re.findall(r"\[INST\]", body))


def test_escapes(spark):
    rows = spark.createDataFrame([(a + b,) for a in ODD for b in ODD], "t string")
    back = rows.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(r["u"] == r["t"] and not re.search(r"</?s>|\[/?INST\]", r["e"]) for r in back)
    assert len({r["e"] for r in back}) == len({r["t"] for r in back})


def test_sums_before_each(spark):
    for n in (0, 1, 2, 3, 4, 5, 16, 17, 100):
        got = spark.range(1).select(before_each(F.array(*[F.lit(i * 3 + 1) for i in range(n)]).cast("array<bigint>")).alias("s")).first()[0]
        assert got == [sum(j * 3 + 1 for j in range(i)) for i in range(n)]


def test_long_chats(requests):
    many = [(["user", "assistant"][i % 2], f"é{i}") for i in range(20_000)]
    long = [("user", "x" * 3_000_000), ("assistant", "é</s>" * 400_000)]
    got = read(format_chats(requests([json.dumps({"messages": [{"role": r, "content": t} for r, t in c]}) for c in (many, long)])))
    for i, turns in enumerate((many, long)):
        assert [tuple(t) for t in got[i]["turns"]] == turns
        assert got[i]["learned"] == "".join(t for r, t in turns if r == "assistant")


def test_empty_table(requests):
    assert format_chats(requests([])).count() == 0


def test_layouts_are_told_apart():
    assert set(layouts().values()) == set(MAPPINGS)
    # The same paths never stand for two mappings.
    assert sum(len(layouts({k: v})) for k, v in MAPPINGS.items()) == len(layouts())
