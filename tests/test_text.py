from pyspark.sql import functions as F

from faultline.functions import text as T


def _clean(spark, s):
    return spark.createDataFrame([(s,)], "t string").select(T.clean_tokens("t").alias("x")).first().x


def test_punctuation_substring_rule(spark):
    # (), <= and ./ are substrings of the punctuation string; --, ... and == are not.
    assert _clean(spark, "() <= ./ -- ... ==") == ["--", "...", "=="]


def test_non_ascii_and_stop_words(spark):
    assert _clean(spark, "résumé LGTM thanks The fixes") == ["fix"]


def test_lemma_rules(spark):
    toks = _clean(spark, "fixes fixed typos classes boxes policies status process children axes buses")
    assert toks == ["fix", "fixed", "typo", "class", "box", "policy", "status", "process", "child",
                    "axis", "buse"]


def test_empty_and_null(spark):
    df = spark.createDataFrame([("",), (None,)], "t string")
    out = [r.x for r in df.select(T.clean_tokens("t").alias("x")).collect()]
    assert out == [[], None]


def test_inner_punctuation_kept_in_words(spark):
    assert _clean(spark, "Bump to 2.0 in src/a.ts, well-known files.") == ["bump", "2.0", "src/a.ts",
                                                                           "well-known", "file"]


def test_contractions_split(spark):
    assert _clean(spark, "don't won't") == []


def test_fix_title_filter(spark):
    df = spark.createDataFrame([("Fixes crash",), ("fix typos",), ("Fixed crash",), ("prefix",)], "t string")
    kept = [r.t for r in df.where(T.is_fix_title(T.clean_tokens("t"))).collect()]
    assert kept == ["Fixes crash"]


def test_bot_comment_pairs(spark):
    df = spark.createDataFrame([("alpha beta",), ("alpha",), (None,)], "p string")
    flags = [r.b for r in df.select(T.is_bot_comment(F.col("p"), [("alpha", "beta")]).alias("b")).collect()]
    assert flags == [True, False, False]


def test_symbols_step_is_switchable(spark):
    df = spark.createDataFrame([(["©", "a", "$$"],)], "t array<string>")
    assert df.select(T.drop_symbols("t").alias("x")).first().x == ["a", "$$"]
