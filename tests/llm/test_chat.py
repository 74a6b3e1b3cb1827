"""Chat formatting: prefixes go, copies collapse, turns are put in order."""

from tablegauge.llm.chat import format_conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string, h1 string, at string, last string, said string, p1 string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "u", "v") for r in rows], SCHEMA).repartition(3)


def talk(conv_id, *said):
    return [(conv_id, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(said)]


def test_prefixes_and_copies(spark):
    rows = talk(1, "a", "b") + talk(2, "a", "b", "c") + talk(3, "a", "b", "c") + talk(4, "a", "x") + talk(5, "a") + talk(6, "b", "a") + talk(7, "abc")
    got = {r.conv_id: r for r in format_conversations(frame(spark, rows)).collect()}
    assert set(got) == {2, 4, 6, 7}
    assert got[2].n_copies == 2 and got[2].n_turns == 3
    assert got[2].text == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nc<|end|>\n"


def test_odd_rows(spark):
    rows = [(1, 5, "user", "late"), (1, None, None, "first"), (1, 2, "user", None), (1, 2, "user", None), (None, 0, "user", "nobody"),
            (2, 0, "user", "two"), (2, 0, "assistant", "at once"), (3, 0, "user", "")]
    got = {r.conv_id: r for r in format_conversations(frame(spark, rows)).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].text == "<|unknown|>\nfirst<|end|>\n<|user|>\n<|end|>\n<|user|>\nlate<|end|>\n"
    assert got[2].n_turns == 2 and got[3].text == "<|user|>\n<|end|>\n"
    assert format_conversations(frame(spark, [])).collect() == []


def test_long_conversation_and_its_snapshots(spark):
    said = [f"turn {i}" * 5 for i in range(120)]
    rows = [r for n in range(1, 121, 7) for r in talk(n, *said[:n])] + talk(900, *said[:60], "other")
    got = {r.conv_id: r.n_turns for r in format_conversations(frame(spark, rows), opening="[{role}] ", closing="\n").collect()}
    assert got == {120: 120, 900: 61}
