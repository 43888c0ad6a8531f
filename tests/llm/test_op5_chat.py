import random

from frameloom.llm import chat


def brute(rows):
    turns = {}
    for conv, turn, role, text in set(rows):
        turns.setdefault(conv, []).append((turn, role, text))
    key = lambda t: tuple((x is not None, x if x is not None else 0) if i == 0 else (x is not None, x or "") for i, x in enumerate(t))
    convs = {c: tuple(sorted(t, key=key)) for c, t in turns.items()}
    prefixes = {v[:k] for v in convs.values() for k in range(1, len(v))}
    best = {}
    for c, v in convs.items():
        if v not in prefixes:
            best[v] = min(best.get(v, c), c)
    return {c: "".join(f"<|{r or ''}|>\n{t or ''}\n<|end|>\n" for _, r, t in v) for v, c in best.items()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for c in range(120):
        n = rng.randint(1, 6)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice("ab") if t else "hi") for t in range(n)]
    rows += rows[:20]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r.chat for r in chat.collapse_and_render(df).collect()}
    assert got == brute(rows)


def test_long_conversations_have_parts(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(600)] + [(2, t, "user", f"t{t}") for t in range(599)] + [(3, t, "user", f"t{t}") for t in range(600)] + [(4, 0, "user", "other")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.collapse_and_render(df).orderBy("conv_id", "part").collect()
    assert [(r.conv_id, r.part, r.n_turns, r.copies) for r in got] == [(1, 0, 600, 2), (1, 1, 600, 2), (1, 2, 600, 2), (4, 0, 1, 1)]
    assert "".join(r.chat for r in got if r.conv_id == 1) == brute(rows)[1]


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.collapse_and_render(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, 0, None, None), (1, None, "user", ""), (2, 0, "user", None), (3, 0, "user", ""), (3, 1, "x", "y" * 200_000)]
    got = {r.conv_id: r.chat for r in chat.collapse_and_render(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {None, 1, 2, 3}
    assert got[None] == "<||>\n\n<|end|>\n" and len(got[3]) > 200_000


def test_turns_without_a_conversation(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "user", "b"), (None, 0, "user", "hi"), (7, 0, "user", "hi"), (7, 1, "user", "more"), (8, 5, "user", "x"), (None, 5, "user", "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, key string")
    got = sorted((str(r.conv_id), r.n_turns, r.copies, r.chat) for r in chat.collapse_and_render(df).collect())
    one = lambda t: f"<|user|>\n{t}\n<|end|>\n"
    assert got == [("7", 2, 1, one("hi") + one("more")), ("8", 1, 2, one("x")), ("None", 1, 1, one("a")), ("None", 1, 1, one("b"))]


def test_crowds_are_dealt_out(spark, monkeypatch):
    """Many turns without an id, and many different turns under one number, null too: no group grows with them."""
    monkeypatch.setattr(chat, "CROWD", 50)
    rows = [(None, 0, "user", f"t{i}") for i in range(3000)] + [(1, 0, "user", f"t{i}") for i in range(1000)] + [(2, None, "user", f"t{i}") for i in range(400)] + [(2, 1, "user", "end")]
    df = spark.createDataFrame(rows + rows[:50], "conv_id long, turn long, role string, text string")
    got = chat.collapse_and_render(df).collect()
    assert sum(r.conv_id is None for r in got) == 3000
    for c, n in ((1, 1000), (2, 401)):
        own = [r for r in got if r.conv_id == c]
        assert {r.n_turns for r in own} == {n} and len({(r.part, r.piece) for r in own}) == len(own)
        assert max(r.chat.count("<|end|>") for r in own) < 100 and sum(r.chat.count("<|end|>") for r in own) == n


def test_texts_are_shuffled_once(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    found = chat.collapse_and_render(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in line and "buf" in line for line in plan.splitlines()) <= 1
    assert found.count() == 1
