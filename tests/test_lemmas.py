"""Lemmas from a lexicon."""

from faultline.operators import lemmas as L

LEXICON = ["bus", "bias", "box", "church", "dish", "wolf", "leaf", "leave", "woman", "man", "city", "glass", "class", "gas", "news", "new", "lens", "axis", "index",
           "mouse", "series", "quiz", "fix", "fish", "child", "data", "boss", "bosses"]
IRREGULAR = [("mice", "mouse"), ("children", "child"), ("indices", "index"), ("indices", "indicis"), ("axes", "axis"), ("axes", "ax"), ("data", "datum")]
#: Irregular, regular and rejected forms.
CASES = {
    "buses": "bus", "bias": "bias", "boxes": "box", "churches": "church", "dishes": "dish", "wolves": "wolf", "women": "woman", "men": "man", "cities": "city",
    "glasses": "glass", "class": "class", "gas": "gas", "gases": "gas", "lens": "lens", "news": "new", "quizzes": "quizzes", "fixes": "fix", "fish": "fish",
    "mice": "mouse", "children": "child", "indices": "index", "axes": "axis", "data": "data", "series": "series",
    # both 'leaf' and 'leave' are held: the shorter one
    "leaves": "leaf",
    # no stem is held
    "chaos": "chaos", "kubernetes": "kubernetes", "s": "s", "": "", "2.0s": "2.0s", "über": "über",
    # a stem of a stem
    "busess": "bus", "bosses": "boss",
}


def test_lexicon_decides(spark):
    vocabulary = spark.createDataFrame([(w,) for w in list(CASES) * 2 + [None]], "token string")
    table = L.lemma_table(vocabulary, spark.createDataFrame([(w,) for w in LEXICON + ["bus", None]], "word string"),
                          spark.createDataFrame(IRREGULAR + [(None, "x")], "form string, lemma string"))
    rows = table.collect()
    assert {r.token: r.lemma for r in rows} == CASES and len(rows) == len(CASES)


def test_other_lexicons(spark):
    vocabulary = spark.createDataFrame([("boxes",), ("mice",)], "token string")
    none = spark.createDataFrame([], "word string")
    assert {r.token: r.lemma for r in L.lemma_table(vocabulary, none).collect()} == {"boxes": "boxes", "mice": "mice"}
    assert {r.token: r.lemma for r in L.lemma_table(vocabulary, spark.createDataFrame([("boxe",)], "word string")).collect()} == {"boxes": "boxe", "mice": "mice"}


def test_mapped_back_by_token(spark, monkeypatch):
    docs = [(1, ["boxes", "of", "mice", "boxes"]), (1, ["fish"]), (2, []), (3, None), (None, ["dishes"])]
    df = spark.createDataFrame(docs, "id long, toks array<string>")
    table = spark.createDataFrame([("boxes", "box"), ("mice", "mouse"), ("of", "of"), ("dishes", "dish")], "token string, lemma string")
    want = [(1, ["box", "of", "mouse", "box"]), (1, ["fish"]), (2, []), (3, None), (None, ["dish"])]
    for most in (100, 0):  # broadcast, shuffled
        monkeypatch.setattr(L, "MAX_BROADCAST", most)
        assert sorted(map(repr, ((r.id, r.toks) for r in L.with_lemmas(df, "id", "toks", table).collect()))) == sorted(map(repr, want))
