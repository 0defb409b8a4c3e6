import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import chat
from corpusloom.llm.queries import INJECTED


def test_layouts_have_distinct_fingerprints():
    seen = {}
    for m in chat.REGISTRY:
        for f in m.fingerprints():
            assert f not in seen, (m.name, seen.get(f))
            seen[f] = m.name


def test_layouts_become_canonical_turns():
    c = chat.Canonicaliser(chat.REGISTRY)
    want = [("user", "hi"), ("assistant", "ho")]
    for record in (
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}]},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "ho"}]},
        {"prompt": "hi", "completion": "ho"}, {"prompt": "hi", "response": "ho", "extra": {"a": 1}},
        {"instruction": "hi", "output": "ho"}, {"instruction": "hi", "input": "", "output": "ho"}, {"question": "hi", "answer": "ho"},
    ):
        assert c(json.dumps(record))[3] == want, record
    assert c(json.dumps({"system": "s", "prompt": "hi", "completion": "ho"}))[3] == [("system", "s"), *want]
    assert c(json.dumps({"strange": 1}))[1] is None and c("no json")[1] is None and c(None)[1] is None
    assert c(json.dumps({"messages": []}))[1:] == ("messages", 0, [], ())


def test_fields_of_other_layouts_and_content_parts():
    c = chat.Canonicaliser(chat.REGISTRY)
    want = [("user", "hi"), ("assistant", "ho")]
    two = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}]
    assert c(json.dumps({"prompt": "hi", "completion": "ho", "input": "more"}))[1:] == ("prompt_completion", 0, want, ("input",))
    assert c(json.dumps({"messages": two, "system": "s"}))[1:] == ("messages", 0, [("system", "s"), *want], ())
    assert c(json.dumps({"messages": two, "turn": 3, "id": 5}))[1:] == ("messages", 0, want, ("id", "turn"))
    parts = [{"role": "user", "content": [{"type": "text", "text": "h"}, {"type": "text", "text": "i"}]}, {"role": "assistant", "content": "ho"}]
    assert c(json.dumps({"messages": parts}))[1:] == ("messages", 0, want, ())
    assert c(json.dumps({"prompt": "hi", "completion": {"a": 1}}))[3] == [("user", "hi"), ("assistant", '{"a": 1}')]
    image = [{"role": "user", "content": [{"type": "image", "url": "u"}]}]
    assert json.loads(c(json.dumps({"messages": image}))[3][0][1]) == image[0]["content"]  # nothing is lost
    # of two mappings that both fit, the one with more required paths, then the first
    assert c(json.dumps({"turn": 1, "role": "user", "text": "x", "prompt": "p", "completion": "q"}))[1] == "turn_row"
    assert c(json.dumps({"prompt": "p", "completion": "q", "response": "r"}))[1:] == ("prompt_completion", 0, [("user", "p"), ("assistant", "q")], ("response",))
    assert c(json.dumps({"strange": {"a": [1]}}))[4] == ("strange.a[]",)


def test_every_layout_through_the_operator(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}], "system": "s"}), (2, {"prompt": "hi", "completion": "ho", "input": "x"}),
        (3, {"strange": 1}), (4, {"messages": []}),
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in records], "conv_id long, record string")
    turns = chat.canonical_turns(df, "conv_id", "record")
    got = {r["conv_id"]: r for r in chat.conversation_digest(chat.format_turns(turns), "conv_id").collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {1: (3, 2), 2: (2, 2), 3: (0, 0), 4: (0, 0)}
    assert {r["conv_id"]: (r["mapping"], r["unused"]) for r in turns.select("conv_id", "mapping", "unused").distinct().collect()} == {
        1: ("messages", []), 2: ("prompt_completion", ["input"]), 3: (None, ["strange"]), 4: ("messages", [])}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.text("ab\\\n<|>", max_size=6), st.text("ab\\\n<|>im_endstart", max_size=20)), min_size=1, max_size=5))
def test_escape_is_reversible_in_python(turns):
    def escape(t):
        import re

        return re.sub(r"<(\\*)\|", r"<\1\\|", t)

    formatted = "".join(chat.START + escape(r.replace("\\", "\\\\").replace("\n", "\\n")) + "\n" + escape(t) + chat.END + "\n" for r, t in turns)
    assert chat.parse(formatted) == turns


def test_injected_markers_survive(spark):
    turns = [("user", INJECTED), ("assistant", INJECTED + "<\\|"), ("a\\n\nb", "<|<\\\\|")]
    df = chat.format_turns(chat.canonical_turns(chat.message_records(spark, [(7, turns)]), "conv_id", "record"))
    rows = df.orderBy("part").collect()
    assert chat.parse("".join(r["formatted"] for r in rows)) == turns
    r = chat.conversation_digest(df, "conv_id").first()
    assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert r["loss_sha256"] == hashlib.sha256((INJECTED + "<\\|").encode()).hexdigest()
    assert r["formatted_chars"] == sum(len(x["formatted"]) for x in rows)


def test_query_equals_sql(spark, oracle):
    oracle(spark, "op1_chat_formatting")
