import random

import numpy as np
import pytest

from parapet.operators import blocktable

LETTERS = "abcé漢😀 .İß"


def every_bit():
    return np.ones(blocktable.BITS, bool)


@pytest.mark.parametrize("seed", range(5))
def test_a_contained_entry_shares_its_key(seed):
    rng = random.Random(seed)
    for _ in range(300):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 60)))
        at = rng.randrange(len(text))
        entry = text[at:at + rng.randrange(1, 30)]
        keys = blocktable.text_keys(text, [min(len(entry), blocktable.LONG)], every_bit())
        assert blocktable.entry_key(entry) in keys


def test_like_comparing_everything(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gämma", "漢字", "o", "straße", "x1", "İstanbul", "the", "  "]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(400)]
    rows = [(i, i % 3, t) for i, t in enumerate(texts)] + [(1000, 0, None), (1001, 0, ""), (1002, 0, "y" * 50_000 + "needle in here")]
    entries = [t[a:a + rng.randrange(1, 25)] for t in texts[:60] for a in (3, 30)] + ["NEEDLE in", None, "", "absent entry", "o", "zz", "o"]
    df = spark.createDataFrame(rows, "id long, part int, body string")
    table = spark.createDataFrame([(e,) for e in entries], "entry string")
    got = {(r["id"], r["part"], r["entry"]) for r in blocktable.hits(df, ["id", "part"], "body", table, "entry").collect()}
    lower = {r[0]: r[1] for r in df.selectExpr("id", "lower(body)").collect()}
    known = {r[0] for r in table.selectExpr("lower(entry)").collect() if r[0]}
    assert got == {(i, p, e) for i, p, _ in rows if lower[i] is not None for e in known if e in lower[i]}
    out = blocktable.screen_by_table(df, ["id", "part"], "body", table, "entry").collect()
    assert {r["id"] for r in out if r["blocked"]} == {i for i, _, _ in got} and len(out) == len(rows)
    assert {r["reason"] for r in out} == {None, "Prompt blocked: matches forbidden pattern."}
    assert blocktable.hits(df, ["id", "part"], "body", table.limit(0), "entry").count() == 0


def test_ten_thousand_entries_and_no_pairing_with_all_texts(spark):
    rng = random.Random(9)
    made = ["".join(rng.choice("abcdefghij ") for _ in range(14)) for _ in range(10_000)]
    texts = [" ".join(rng.choice(made) if rng.random() < 0.02 else "".join(rng.choice("klmnop") for _ in range(9)) for _ in range(30))
             for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    table = spark.createDataFrame([(e,) for e in made], "entry string")
    found = blocktable.hits(df, ["id"], "body", table, "entry")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r["id"] for r in found.collect()} == {i for i, t in enumerate(texts) if any(e in t for e in made)}


@pytest.mark.parametrize("common", [0, 3, 4096])
def test_verdicts_do_not_hang_on_where_entries_are_looked_up(spark, monkeypatch, common):
    monkeypatch.setattr(blocktable, "COMMON", common)
    rng = random.Random(11)
    words = ["alpha", "Beta", "gämma", "漢字", "o", "straße", "x1", "İstanbul", "the", "  "]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for _ in range(300)] + [None, "", "z" * 40 + "Q" * 60 + "end"]
    entries = [t[a:a + rng.randrange(2, 45)] for t in texts[:40] for a in (2, 9)] + ["z" * 9 + "q" * 60 + "END", "q" * 61, None, "", "zo"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    table = spark.createDataFrame([(e,) for e in entries], "entry string")
    lower = {r[0]: r[1] for r in df.selectExpr("id", "lower(body)").collect()}
    known = {r[0] for r in table.selectExpr("lower(entry)").collect() if r[0]}
    got = {r["id"]: r["blocked"] for r in blocktable.screen_by_table(df, ["id"], "body", table, "entry").collect()}
    assert got == {i: t is not None and any(e in t for e in known) for i, t in lower.items()} and 0 < sum(got.values()) < len(got)


def test_a_verdict_moves_no_row_for_every_entry_of_a_text(spark, monkeypatch):
    """300 texts with 200 entries each: 60,000 pairs that the verdicts do not need."""
    made = [f"{i:04}" for i in range(0, 10_000, 50)]
    df = spark.createDataFrame([(i, " ".join(made) + f" text {i}") for i in range(300)] + [(1000, "none of them")], "id long, body string")
    kept = []
    monkeypatch.setattr(blocktable, "cut", lambda df, own=blocktable.cut: kept.append(own(df)) or kept[-1])
    out = blocktable.screen_by_table(df, ["id"], "body", spark.createDataFrame([(e,) for e in made], "entry string"), "entry")
    assert {r["id"] for r in out.collect() if r["blocked"]} == set(range(300))
    assert [k.count() for k in kept] == [200, 300]  # the list, and a row per text
