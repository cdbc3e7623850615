"""Transcript parsing: the decoder against all state sequences, markers, odd transcripts, the registered query."""

import itertools
import random
import re

import numpy as np
import pytest
from gridloom.llm import chat, queries
from gridloom.storage import store


def test_viterbi_finds_the_likeliest_of_all_sequences():
    rng = np.random.default_rng(6)
    model = chat.fit([c + rng.random(c.shape) for c in chat.prior()])
    for _ in range(5):
        seen = np.stack([rng.integers(0, n, 5) for n in chat.SIZES], axis=1)

        def score(states):
            total = model.start[states[0]] + sum(model.step[a, b] for a, b in zip(states, states[1:]))
            return total + sum(e[s, seen[i, f]] for i, s in enumerate(states) for f, e in enumerate(model.emit))

        best = max(itertools.product(range(chat.N_STATES), repeat=5), key=score)
        assert tuple(chat.viterbi(seen, model)) == best


@pytest.mark.parametrize(
    "line, kind, rest",
    [
        ("User: hi", 1, "hi"), ("Assistant: yes", 2, "yes"), ("**Bot**: yes", 2, "yes"), ("[system] be kind", 3, "be kind"),
        ("### Human:", 1, ""), ("<|assistant|>", 2, ""), ("Q: why?", 1, "why?"), ("Alice: hello", 4, "hello"),
        ("A user can do this: that", 0, None), ("Note that: x", 0, None), ("the ai said", 0, None), ("", 0, None),
        ("http://user", 0, None), ("- item", 0, None),
    ],
)
def test_markers(line, kind, rest):
    found, cut = chat.find_marker(line)
    assert found == kind and (rest is None or line[cut:] == rest)


def test_turns_and_rendering_without_training():
    model = chat.fit(chat.prior())
    text = "System: Be kind.\nUser: Hi there\nmore of it\n\nAssistant: Hello <|x|>\n- one\n- two\n\nUser: Bye"
    roles, turns = chat.parse(text, model)
    assert [t["role"] for t in turns] == ["system", "user", "assistant", "user"]
    assert turns[1]["content"] == "Hi there\nmore of it" and turns[2]["content"] == "Hello <|x|>\n- one\n- two"
    assert len(roles) == len(text.split("\n"))
    assert chat.render(turns[:1]) == "<|im_start|>system\nBe kind.<|im_end|>\n" and "<\\|x|>" in chat.render(turns)


def test_odd_transcripts(spark):
    rows = [(1, None, 5), (None, "", 5), (2, " \n ", 5), (3, "no marker at all", 5), (3, "no marker at all", 5), (4, "x\n" * 30000, 5)]
    table = spark.createDataFrame(rows, "conv_id long, text string, turns int")
    model = chat.train(table.selectExpr("text", "array(0) AS states"), "text", "states")
    found = chat.parse_transcripts(table, "conv_id", "text", model).collect()
    got = sorted((r.conv_id or 0, len(r.turns), r.rendered == "") for r in found)
    assert got[:5] == [(0, 0, True), (1, 0, True), (2, 0, True), (3, 1, False), (3, 1, False)] and got[5][1] >= 1
    assert chat.parse_transcripts(table.limit(0), "conv_id", "text", model).count() == 0


def test_query_recovers_roles(spark):
    found = queries.op3_chat(spark, "/root/testdata/sf0.01").collect()
    total = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert sum(r.n_turns for r in found) == total.count()
    held = [r for r in found if r.held_out]
    assert len(held) > 10 and sum(r.n_right for r in held) >= 0.98 * sum(r.n_lines for r in held)


def test_query_on_hot_and_odd_conversations(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "PART_TURNS", 16)
    monkeypatch.setattr(chat, "FAN", 2)
    rng = random.Random(3)
    rows = [(7, i, ("user", "assistant")[i % 2], f"some words {rng.random()} here", 1) for i in range(100)]
    rows += [(8, 0, None, "what", 1), (None, None, "user", None, 1), (9, 0, "robot", "beep", 1), (9, 0, "robot", "beep", 1)]
    columns = "conv_id long, turn long, role string, text string, part int"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op3_chat(spark, str(tmp_path)).collect()
    parts = sorted((r.part, r.n_turns) for r in found if r.conv_id == 7)
    assert parts == [(i, 16) for i in range(6)] + [(6, 4)]
    assert sum(r.n_turns for r in found) == len(rows)
    assert sum(r.n_right for r in found if r.conv_id != 7) <= 2
    hot = [r for r in found if r.conv_id == 7]
    assert sum(r.n_right for r in hot) >= 0.9 * sum(r.n_lines for r in hot)


def some_parts(rng, n):
    says = ["User: ", "Assistant: ", "", "System: "]
    turn = lambda: f"{rng.choice(says)}word {rng.random()}{rng.choice(['', chr(10) + '- more', '?'])}\n"
    return ["\n".join(turn() for _ in range(rng.randint(1, 5))) for _ in range(n)]


def test_borders_lie_on_the_likeliest_way():
    rng, model = random.Random(4), chat.fit(chat.prior())
    for n in (1, 2, 7):
        parts = some_parts(rng, n)
        whole = chat.viterbi(chat.line_features("\n".join(parts).split("\n"))[0], model)
        seen = [chat.line_features(p.split("\n"), i == 0)[0] for i, p in enumerate(parts)]
        around = chat.borders([chat.ways_through(s, model, i == 0) for i, s in enumerate(seen)], 0)
        enter = [None, *(e for e, _ in around[1:])]
        assert np.concatenate([chat.viterbi(s, model, e, a[1]) for s, e, a in zip(seen, enter, around)]).tolist() == whole.tolist()


def test_parts_are_parsed_like_the_whole(spark, monkeypatch):
    monkeypatch.setattr(chat, "FAN", 3)
    rng, model = random.Random(5), chat.fit(chat.prior())
    texts = {k: some_parts(rng, n) for k, n in ((1, 1), (2, 2), (3, 30), (None, 9))}
    rows = [(p, 10 + i, k, i) for k, parts in texts.items() for i, p in enumerate(parts)]
    table = spark.createDataFrame(rows, "_text string, `_0` int, conv_id long, at int").repartition(3)
    found = chat.parse_parts(store(table, "given"), "conv_id", "_0", "_text", model, ("at",)).collect()
    assert len(found) == len(rows) and any(r.goes_on for r in found)
    for k, parts in texts.items():
        mine = sorted((r for r in found if r.conv_id == k), key=lambda r: r["_0"])
        assert [r.at for r in mine] == list(range(len(parts)))
        roles, turns = chat.parse("\n".join(parts), model)
        assert sum((r.line_roles for r in mine), []) == roles
        assert sum(len(r.turns) - r.goes_on for r in mine) == len(turns)
        squeeze = lambda t: re.sub(r"\n+", "\n", t)
        assert squeeze("".join(r.rendered for r in mine)) == squeeze(chat.render(turns))


def test_odd_parts(spark):
    model = chat.fit(chat.prior())
    rows = [(1, 0, None), (1, 1, "User: a\n"), (1, 1, "User: a\n"), (2, None, "Bot: x\n"), (2, 5, ""), (3, 0, "User: a"), (3, 0, "User: a"), (4, None, None)]
    table = store(spark.createDataFrame(rows, "k long, part long, text string"), "odd")
    found = chat.parse_parts(table, "k", "part", "text", model).collect()
    assert sorted(r.k for r in found) == sorted(r[0] for r in rows)
    assert [r.rendered for r in found if r.k == 3] == ["<|im_start|>user\na<|im_end|>\n"] * 2
    assert [r.turns for r in found if r.k == 4] == [[]]
    assert chat.parse_parts(table.limit(0), "k", "part", "text", model).count() == 0
