"""Long transcripts and conversations without an id."""

from __future__ import annotations

import random

import numpy as np
from test_edges import prose

from corvane.llm import chat


def test_a_turn_of_many_lines_is_one_turn():
    roles = ["assistant", "user"]
    samples = []
    for k in range(40):
        lines = ["User: " + prose(6, k) + "?", "", "Assistant: " + prose(20, 100 + k), *(prose(20, 200 + 9 * k + j) for j in range(8))]
        samples.append((chat.looks(lines), chat.labels(roles, ["user", "assistant"], [1, 9])))
    model = chat.Model(roles, samples)
    log = [prose(20, j % 50) for j in range(9000)]
    turns, states = model.turns("\n".join(["User: what is this?", "", "Assistant: here", *log]))
    assert [r for r, _ in turns] == ["user", "assistant"] and turns[1][1] == "\n".join(["here", *log])
    assert states.tolist() == [2, 0, *[1] * 9000]


def test_conversations_without_an_id_stay(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], prose(9, 10 * (c or 0) + t)) for c in (1, 2, None) for t in range(4)]
    labelled = chat.transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    model = chat.fit(labelled)
    out = {r.conv_id: r for r in chat.agreement(chat.format_chats(labelled, model), labelled, model.roles).collect()}
    lines = {r.conv_id: sum(r.n) for r in labelled.collect()}  # some styles put markers on lines of their own
    assert {c: r.n_lines for c, r in out.items()} == lines and set(out) == {1, 2, None} and all((r.n_right is None) != r.held_out for r in out.values())


def learnt() -> chat.Model:
    roles = ["assistant", "user"]
    samples = []
    for k in range(60):
        lines = ["User: " + prose(6, k) + "?", *(prose(9, 700 + 9 * k + j) for j in range(k % 3)), "", ("Assistant: " if k % 4 else "") + prose(20, 100 + k), *(prose(20, 200 + 9 * k + j) for j in range(k % 5))]
        samples.append((chat.looks(lines), chat.labels(roles, ["user", "assistant"], [1 + k % 3, 1 + k % 5])))
    return chat.Model(roles, samples)


def plain_path(model: chat.Model, x) -> tuple:
    """The best of all paths, by trying each."""
    import itertools

    score, n = model.scores(x), len(model.start)
    total = lambda p: model.start[p[0]] + score[0, p[0]] + sum(model.step[a, b] + score[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:])))
    return max(itertools.product(range(n), repeat=len(x)), key=total)


def test_parts_have_the_path_of_the_whole():
    model, r = learnt(), random.Random(7)
    for _ in range(150):
        x = np.array([[r.randrange(k) for k in chat._LOOKS] for _ in range(r.randint(1, 7))])
        whole = model.path(x)
        assert tuple(whole) == plain_path(model, x)
        cuts = sorted(r.randint(0, len(x)) for _ in range(3))
        pieces = [x[a:b] for a, b in zip([0, *cuts], [*cuts, len(x)])]
        found = model.borders([model.fold(p) if len(p) else None for p in pieces])
        got = np.concatenate([model.path(p, e, z) for p, (e, z, _, _) in zip(pieces, found)])
        assert got.tolist() == whole.tolist()
        for p, (e, z, within, after) in zip(pieces, found):
            if len(p):
                assert within == (model.path(p, e, z)[0] % 2 == 1 and e < len(model.start))


def test_parts_are_rendered_as_the_whole(spark, monkeypatch):
    model, r = learnt(), random.Random(8)
    rows = []
    for c in range(6):
        blocks = []
        for t in range(r.randint(1, 40)):
            mark = r.choice(["User: ", "Assistant: ", "", "", "\t"])
            blocks.append(mark + r.choice([prose(r.randint(1, 30), 50 * c + t), "", " \t", "a\n\n\nb", prose(4, t) + "?"]))
        rows += [(c, k, "\n\n".join(blocks[k * 5 : k * 5 + 5])) for k in range(-(-len(blocks) // 5))]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, part long, transcript string").repartition(3), model).collect()
    assert len(out) == len(rows)
    for c in range(6):
        mine = sorted((x for x in out if x.conv_id == c), key=lambda x: x.part)
        turns, states = model.turns("\n\n".join(t for i, _, t in rows if i == c))
        assert "".join(x.rendered for x in mine) == chat.canonical(turns)
        assert [s for x in mine for s in x.states] == states.tolist() and sum(x.n_turns for x in mine) == len(turns)
        assert [y for x in mine for y in x.roles.split(",") if y] == [y for y, _ in turns]


def test_turns_without_numbers_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 8)
    rows = [(1, None, "user", "same")] * 50 + [(None, 3, None, f"t{k % 5}") for k in range(30)] + [(2, k, "user", "\t") for k in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    out = chat.transcripts(df).collect()
    assert all(len(r.roles) <= 8 for r in out) and sum(len(r.roles) for r in out) == len(rows)
    assert [len([r for r in out if r.conv_id == c]) for c in (1, None, 2)] == [7, 4, 1]
    for r in out:
        assert sum(r.n) == len(chat.looks(r.transcript.split("\n")))
    assert chat.transcripts(df.limit(0)).count() == 0
