import random
import re
from collections import Counter

from pyspark.sql import functions as F

from frameloom.llm import rules


def brute(text):
    text = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    counts = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    rejected = 10 * counts[2] > 3 * len(w) or (dup >= 5 and 100 * dup > 30 * len(text.split("\n"))) or counts[1] > 15 * len(w) or counts[1] < 2 * len(w) or 10 * sum(c.isupper() for c in text) > 5 * counts[1] or 10 * text.count("!") > 2 * len(w)
    return (*counts, failed, not failed and not rejected)


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t", "a b c a b c a b c", "x " * 80, "a\nb\na\n \n \nb\x0bq", "a b", " é# <b>| a\x0cb ", "  a b \x1c c", "w " * 100_000]
    for _ in range(120):
        words = [rng.choice(["the", "of", "AND!", "##", "é", "longerword", "b|", "c!"]) if rng.random() < 0.6 else f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 130))]
        out.append("".join(x + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for x in words))
    out += ["\n".join(["same line of words here"] * 30), "\n".join(f"line {i} of some words" for i in range(40)), " ".join(f"u{i} v{i} w{i} u{i} v{i} w{i}" for i in range(60))]
    return out


def test_counts_and_verdicts(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows] + [(None, "a b", 1, "x")], "doc_id long, text string, n_words int, kept string")
    cascade = rules.plan(df.select("doc_id", "text"))
    assert sorted(r.name for r in cascade.rules) == sorted(r.name for r in rules.RULES)
    out = rules.judge(df, cascade, keep=["doc_id"])
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    assert got[None][:2] == (2, 2)
    for i, t in rows:
        assert got[i] == brute(t), t
    shuffled = rules.judge(df, rules.Cascade(tuple(reversed(rules.RULES)), {}, {}), keep=["doc_id"])
    assert {r[0]: tuple(r)[1:] for r in shuffled.collect()} == got


def test_the_order_is_stable(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(rules, "MOST_COPIES", 64)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plans = [rules.plan(docs) for _ in range(10)]
    assert len({tuple(r.name for r in p.rules) for p in plans}) == 1
    first = plans[0]
    assert set(first.cost) == set(first.rejected) == {r.name for r in rules.RULES} | set(rules.BASE)
    assert first.cost["symbols"] < first.cost["marks"] < first.cost["capitals"] < first.cost[rules.BASE[1]]


def test_both_forms_of_repeats(spark, monkeypatch):
    """Few repeated windows are looked up in a list, many are sorted: the same counts whichever form is taken."""
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for listed in (0, 2, 10**6):
        monkeypatch.setattr(rules, "_LISTED", listed)
        got = {r.doc_id: r.n_repeat_words for r in rules.with_counts(df, "text", ["doc_id"]).collect()}
        assert got == {i: brute(t)[4] for i, t in rows}


def test_native_and_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    cascade = rules.plan(df)
    assert cascade.rules == rules.RULES and rules.judge(df, cascade, keep=["doc_id"]).count() == 0
    plan = rules.judge(df, cascade, keep=["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_order_is_by_rejections_per_cost(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    some = (rules.QualityRule("none", lambda t: F.lit(False)), rules.QualityRule("all", lambda t: F.length(t) > 0))
    assert [r.name for r in rules.plan(df, some).rules] == ["all", "none"]
