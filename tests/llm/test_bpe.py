import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultline.llm import bpe as B, queries as Q
from tests.llm.conftest import EDGES, SMALL

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def both(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def mine(text):
    v = B.vocabulary(PATH)
    ids = v.encode([text.encode()])[0]
    return np.frombuffer(ids, "<u4").tolist(), B.names(PATH).decode(ids)


ODD = ["It's we'll don't 'sharp 's", "ΣΑΣ Οδυσσεύς", "İstanbul ﬁne ſharp Kelvin", "a b c\x1cd", "<|endoftext|>x <|startoftext|>y<|endoftext|>", "café ÀÉÎ ñ ẞ",
       "x1y2 3.14 !!?! a.b,c ...end", "word.\x00word", "漢字かな 🙂🙂", "😍" * 9 + "é" * 9, "a" * 300, "ha" * 400, "!" * 700, " \n\t ", "", "</w> a</w>b"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert mine(text) == both(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aabcdeehinorst'é🙂 .", max_size=60))
def test_any_text(text):
    assert mine(text) == both(text)


def test_a_shared_prefix_is_encoded_once(monkeypatch):
    merges, end = B.vocabulary(PATH).merges, lambda w: w[:-1] + chr(ord(w[-1]) + B.ENDS)
    words = sorted(map(end, ("translate", "translated", "translation", "transfer")))
    alone = {w: list(merges.encode([w]))[0][1] for w in words}

    class Count(list):
        reads = 0

        def __getitem__(self, i):
            Count.reads += 1
            return list.__getitem__(self, i)
    monkeypatch.setattr(merges, "longest", Count(merges.longest))
    assert dict(merges.encode(words)) == alone
    assert Count.reads == len({w[:i] for w in words for i in range(1, len(w) + 1)})


def test_merges_whose_parts_meet_again():
    """Equal neighbours merge from the left; a token that its own spelling does not give is never used."""
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "a|", "b|", "c|", "aa", "bc", "ab", "abc", "aaa|", "aa|"])}
    m = B.Merges(vocab, [("a", "a"), ("b", "c"), ("a", "b"), ("ab", "c"), ("aa", "a|"), ("a", "a|")], "|")
    assert "abc" not in m.token
    read = lambda w: [next(k for k, v in vocab.items() if v == t) for t in dict(m.encode([w[:-1] + chr(ord(w[-1]) + B.ENDS)])).popitem()[1]]
    assert read("aaa") == ["aaa|"] and read("aaaa") == ["aa", "aa|"] and read("abcc") == ["a", "bc", "c|"] and read("ab") == ["a", "b|"]


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError):
        B.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_known_words_are_bounded(monkeypatch):
    monkeypatch.setattr(B, "WORDS", 5)
    monkeypatch.setattr(B, "KNOWN", 5)
    v = B.Vocabulary(PATH)
    for text in ("one two three four five six", "seven eight one", "two " + "x" * 999):
        assert np.frombuffer(v.encode([text.encode()])[0], "<u4").tolist() == both(text)[0]
    assert len(v.known) < 12 and len(v.heads) < 14 and not any(len(w) > B.LONG for w in [*v.known, *v.heads])


def test_edges(edges):
    clash = edges.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2)).withColumn("a.b", F.lit(3))
    rows = B.decode(B.encode(clash, PATH), PATH).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, B.encode(clash, PATH, decoded=True).drop("ids").collect()))
    assert set(rows[0].asDict()) == {"doc_id", "N_WORDS", "fail_bits", "items", "a.b", "n_tokens", "decoded"}
    want = [(k, len(both(t or "")[0]), both(t or "")[1]) for k, t in EDGES]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_tokens, r.decoded)) for r in rows)


def test_empty(nothing):
    assert B.decode(B.encode(nothing, PATH), PATH).count() == 0


def test_query_against_the_library(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = Q.op11_bpe_codec(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, text = both(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
