import re

import pytest
from pyspark.sql import functions as F

from faultline.llm import quality as Q
from tests.llm.conftest import EDGES


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen, cover = {}, set()
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                cover |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), len(lines))


def test_measures_against_brute_force(edges):
    got = Q.evaluate(edges).select("doc_id", *Q.MEASURES).collect()
    want = [(k, *measures(t)) for k, t in EDGES]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_clashing_columns_are_replaced(edges):
    out = Q.evaluate(edges)
    assert dict(out.dtypes)["fail_bits"] == "bigint" and [c for c in out.columns if c.lower() == "n_words"] == ["n_words"]


def test_empty_table(nothing):
    assert Q.apply_policy(Q.evaluate(nothing), Q.STRICT).count() == 0
    assert Q.ablation(Q.evaluate(nothing), [Q.STRICT]).count() == 0


def test_policies_read_the_ledger_alone(spark):
    ledger = spark.createDataFrame([(0,), (1,), (4,), (4,), (5,), (8,)], "fail_bits long")
    kept = lambda p: [r.kept for r in Q.apply_policy(ledger, p).collect()]
    assert kept(Q.BASE) == [True, False, True, True, False, True]
    assert kept(Q.Policy("symbols", ("symbols",))) == [True, False, False, False, False, True]


def test_ablation(spark):
    ledger = spark.createDataFrame([(0,), (1,), (4,), (4,), (5,), (8,)], "fail_bits long")
    policy = Q.Policy("two", ("few_words", "symbols"))
    rows = {r.rule: (r.n_rows, r.n_rejected, r.n_failing, r.n_by_this_alone) for r in Q.ablation(ledger, [policy]).collect()}
    assert rows == {"few_words": (6, 4, 2, 1), "symbols": (6, 4, 3, 2)}


def test_no_python_in_the_plan(edges):
    plan = Q.apply_policy(Q.evaluate(edges), Q.STRICT)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_filter_on_the_ledger_ends(spark):
    long = spark.createDataFrame([(1, " ".join(f"w{i % 700}" for i in range(5000)))], "doc_id long, text string")
    assert Q.apply_policy(Q.evaluate(long), Q.STRICT).where("kept OR NOT kept").select("n_words").first()[0] == 5000


@pytest.mark.parametrize("rule,text", [("symbols", "a|b | c *** d ### " * 30), ("few_words", "a b c"), ("long_words", "x" * 40 + " y")])
def test_rules(spark, rule, text):
    row = Q.evaluate(spark.createDataFrame([(text,)], "text string")).select((F.col("fail_bits").bitwiseAND(Q.BIT[rule]) > 0).alias("x")).first()
    assert row.x
