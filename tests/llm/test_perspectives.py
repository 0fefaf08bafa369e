from __future__ import annotations

import collections
import random

from orrery.llm import perspectives as D


def brute(rows):
    """rows: (conv, turn, speaker, text) without ties."""
    talks = collections.defaultdict(list)
    for r in rows:
        talks[r[0]].append(r)
    out = {}
    for conv, turns in talks.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1]))
        name = lambda s: (s or "").strip() or None
        for me in {name(r[2]) for r in turns} - {None, "system"}:
            at = 0
            for seq, (_, turn, who, text) in enumerate(turns):
                who = name(who)
                role = "system" if who == "system" else "assistant" if who == me else "user"
                head = f"<|im_start|>{role}" + (f" name={'_'.join(who.split())}" if role == "user" and who else "") + "\n"
                body = head + (text or "").replace("<|im_", "<| im_") + "<|im_end|>\n"
                end = at + len(body)
                loss = (at + len(head), end - 1) if role == "assistant" else (end, end)
                out[conv, me, seq] = (turn, role, body, at, end, *loss)
                at = end
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["ann", "bob smith", " cyd ", "system", "", None]), rng.choice([None, "", "hi é 漢", "<|im_start|>x", "a\nb"])) for c in [*range(12), None] for t in range(rng.randint(1, 9))]
    rows += [(50, t, rng.choice(["ann", "bob"]), f"t{t}") for t in range(300)] + [(51, None, "ann", "first"), (51, 0, "bob", "second"), (52, 0, "system", "alone")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, perspective string")
    got = {(r.conv_id, r.perspective, r.seq): (r.turn, r.role, r.rendered, r.char_start, r.char_end, r.loss_start, r.loss_end) for r in D.rotate(df).collect()}
    assert got == brute(rows)


def test_ties_and_repeated_rows_keep_all_turns(spark):
    rows = [(1, 0, "a", "x")] * 50 + [(1, 0, "b", f"y{i}") for i in range(50)]
    got = D.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for me in ("a", "b"):
        mine = sorted((r for r in got if r.perspective == me), key=lambda r: r.seq)
        assert [r.seq for r in mine] == list(range(100)) and mine[0].char_start == 0
        assert all(x.char_end == y.char_start for x, y in zip(mine, mine[1:], strict=False))


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "a", "x")], "conv_id long, turn long, role string, text string")
    plan = D.rotate(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_empty_table(spark):
    assert D.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_names_that_come_out_alike_are_told_apart(spark, monkeypatch):
    speakers = ["A B", "A_B", "A\tB", "A_B#2", "A_B#", "A_B##2", "c"]
    rows = [(k, i, s, f"t{i}") for k in (1, None) for i, s in enumerate(speakers)] + [(2, 0, "A_B", "x"), (2, 1, "c", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for few in (10_000, 0):
        monkeypatch.setattr(D, "FEW", few)
        got = D.rotate(df).filter("perspective = 'c' AND name IS NOT NULL").collect()
        for k in (1, None):
            names = [r.name for r in got if r.conv_id == k]
            assert len(names) == 6 == len(set(names))
        assert [r.name for r in got if r.conv_id == 2] == ["A_B"]


def test_very_long_texts(spark):
    df = spark.createDataFrame([(1, 0, "a", "x" * 3_000_000), (1, 1, "b", "y")], "conv_id long, turn long, role string, text string")
    rows = sorted(D.rotate(df).select("perspective", "seq", "char_start", "char_end").collect())
    assert rows[1].char_start == rows[0].char_end > 3_000_000
