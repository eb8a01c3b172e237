from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultline.llm import license as L
from faultline.llm import warc
from tests.llm.conftest import EDGES

RECORD = "record_id long, url string, date timestamp, kind string, etag string, last_modified string, headers map<string,string>, canonical int, part string"


def records(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], RECORD).repartition(3)


def day(d):
    return datetime(2024, 1, d)


def resolve(spark, rows):
    return {r.record_id: r for r in warc.resolve(records(spark, rows)).collect()}


@pytest.mark.parametrize("url,want", [
    ("HTTP://WWW.Example.COM:80/a/?b=2&utm_source=x&a=1#f", "example.com/a?a=1&b=2"), ("https://example.com:8080/", "example.com:8080"),
    ("http://user:pw@example.com", "example.com"), ("https://example.com/a?ref=1", "example.com/a"), ("ftp://example.com/", None), (None, None), ("", None)])
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u")).alias("c")).first().c == want


def test_latest_earlier_response_and_validators(spark):
    rows = [
        (1, "http://a.com/x", day(1), "response", "e1", None, {"etag": "e1", "content-length": "5", "date": "1"}),
        (2, "http://www.a.com/x/", day(3), "response", 'W/"e2"', "m2", None),
        (3, "https://a.com/x#f", day(2), "revisit", "W/e1", None, {"date": "2", "content-length": "0"}),
        (4, "http://a.com/x", day(4), "revisit", '"e2"', None, {"expires": "never"}),
        (5, "http://a.com/x", day(4), "revisit", "e1", None, None),
        (6, "http://a.com/x", day(4), "revisit", None, "m2", None),
        (7, "http://a.com/x", day(4), "revisit", None, "m1", None),
        (8, "http://a.com/x", day(4), "revisit", None, None, None),
        (9, "http://a.com/x", datetime(2023, 1, 1), "revisit", "e1", None, None),
        (10, None, day(4), "revisit", "e1", None, None), (11, "http://a.com/x", None, "revisit", "e1", None, None),
        (12, "http://a.com/x", day(3), "revisit", "W/\"e2\"", None, None), (13, "http://a.com/x", day(9), "request", None, None, None),
        (14, "http://a.com/x", None, "response", "e9", None, None),
    ]
    got = resolve(spark, rows)
    assert {k: (v.status, v.refers_to) for k, v in got.items()} == {
        3: ("resolved", 1), 4: ("resolved", 2), 5: ("mismatch", None), 6: ("resolved", 2), 7: ("mismatch", None), 8: ("resolved", 2),
        9: ("unmatched", None), 10: ("unmatched", None), 11: ("unmatched", None), 12: ("resolved", 2)}
    assert got[3].headers == {"etag": "e1", "content-length": "5", "date": "2"} and got[4].headers == {"expires": "never"}
    assert got[5].headers is None


def test_a_hot_url_over_many_partitions(spark):
    """All records of one URL, in tied and untied dates; few of them responses."""
    rows = [(i, "http://hot.com/", datetime(2024, 1, 1 + i // 40 % 28, i % 24), "response" if i % 97 == 0 else "revisit", "e", None, None) for i in range(1000)]
    rows += [(5000 + i, f"http://cold.com/{i % 50}", day(1 + i % 9), "response" if i % 3 else "revisit", "e", None, None) for i in range(300)]
    got = resolve(spark, rows)
    for k, u, d, kind, *_ in rows:
        if kind == "revisit":
            before = [(x[2], x[0]) for x in rows if x[3] == "response" and x[1] == u and x[2] <= d]
            assert got[k].refers_to == (max(before)[1] if before else None)


def test_records_empty_and_repeated(spark):
    assert warc.resolve(records(spark, []).where("false")).count() == 0
    row = (1, "http://a.com", day(2), "revisit", None, None, None)
    assert [r.status for r in warc.resolve(records(spark, [row, row])).collect()] == ["unmatched"] * 2


# -------------------------------------------------------------- licenses

def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j] + 1 if x == y else 0, row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(20))
def test_patience_is_a_common_subsequence(seed):
    import random
    r = random.Random(seed)
    a = [r.randrange(8) for _ in range(r.randrange(30))]
    b = [r.randrange(8) for _ in range(r.randrange(30))]
    pairs = L.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(pairs) <= lcs(a, b)


def test_patience_recurses_into_gaps():
    a, b = "the x the y the z".split(), "the x a the y the z".split()
    assert len(L.patience(a, b)) == 6


def test_longest_increasing_subsequence():
    assert L.increasing([(0, 3), (1, 1), (2, 2), (3, 5), (4, 4)]) in ([(1, 1), (2, 2), (3, 5)], [(1, 1), (2, 2), (4, 4)])


def test_scan(spark):
    mit = L.TEMPLATES["mit"]
    some = mit.split()
    rows = [(1, "x y z " + mit + " more words"), (2, "Intro.\nRELEASED under the mit license!\nend"), (3, "released the hounds under the bridge, license mit"),
            (4, " ".join(w for i, w in enumerate(some) if i % 9)), (5, " ".join(w for i, w in enumerate(some) if i % 3)),
            (6, "All rights reserved. " * 50), (7, "all the rights were long ago reserved"), (8, "word " * 20000 + L.TEMPLATES["gpl-3.0-header"]),
            (None, "All rights reserved"), (10, None), (11, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = sorted(((r.doc_id, r.license, r.first_word, r.end_word - r.first_word) for r in L.scan(docs).collect()), key=repr)
    found = {(k, n) for k, n, *_ in got}
    assert found == {(1, "mit"), (2, "mit-notice"), (4, "mit"), (6, "all-rights-reserved"), (8, "gpl-3.0-header"), (None, "all-rights-reserved")}
    assert (1, "mit", 3, len(L.Scanner(L.TEMPLATES, 0.8, 0.6).words[L.Scanner(L.TEMPLATES, 0.8, 0.6).names.index("mit")])) in got
    assert next(g for g in got if g[0] == 8)[2] == 20000


def test_scan_edges(edges, nothing):
    assert L.scan(nothing).count() == 0
    assert L.scan(edges).count() == 0 and len(EDGES) > 0


def notices(text, templates=None):
    scanner = L.Scanner(templates or L.TEMPLATES, 0.8, 0.6)
    data = text.encode()
    return [x[1:] for x in scanner.block(L.np.array([0, len(data)]), L.np.frombuffer(data, L.np.uint8))]


@pytest.mark.parametrize("name", sorted(L.TEMPLATES))
@pytest.mark.parametrize("part", [0.25, 0.5, 0.75])
def test_a_gapped_notice_is_found_as_by_plain_alignment(name, part):
    words = "".join(c.lower() if c.isalnum() else " " for c in L.TEMPLATES[name]).split()
    gap, at = int(len(words) / 0.6) - len(words), max(1, int(part * len(words)))
    text = ["before"] * 300 + words[:at] + [f"gap{i}" for i in range(gap)] + words[at:] + ["after"] * 300
    pairs = L.patience(text, words)
    assert len(pairs) == len(words)
    got = [x for x in notices(" ".join(text)) if x[0] == name]
    assert got == [(name, len(words), len(words), pairs[0][0], pairs[-1][0] + 1)]


def test_each_disjoint_notice_of_a_text():
    mit = L.TEMPLATES["mit"]
    got = [x for x in notices(" ".join(["one", mit, "two three", mit + " " + mit, "word " * 500, mit])) if x[0] == "mit"]
    m = got[0][2]
    assert [x[3] for x in got] == [1, m + 3, 2 * m + 3, 3 * m + 503] and all(x[1] == m for x in got)
    assert len(notices("All rights reserved. " * 50)) == 50


@pytest.mark.parametrize("seed", range(12))
def test_notices_against_all_stretches(seed):
    """A text has a notice where, and only where, some stretch reaches both thresholds."""
    import random
    r = random.Random(seed)
    template = [f"t{r.randrange(6)}" for _ in range(8)]
    text = [f"t{r.randrange(6)}" if r.random() < 0.8 else "x" for _ in range(60)]
    reaches = lambda a, b: (n := lcs(text[a:b], template)) >= 0.8 * 8 and n >= 0.6 * (b - a)
    whole = {(a, b) for a in range(60) for b in range(a + 1, min(61, a + 14)) if reaches(a, b)}
    got = [(a, b, n) for _, n, _, a, b in notices(" ".join(text), {"t": " ".join(template)})]
    assert all((a, b) in whole and n == lcs(text[a:b], template) for a, b, n in got)
    assert all(b <= c for (_, b, _), (c, _, _) in zip(got, got[1:]))
    assert all(any(a < d and c < b for c, d, _ in got) for a, b in whole)


def planted(seed):
    """Prose of template words with damaged notices in it: words lost, put in and swapped."""
    import random
    r = random.Random(seed)
    names = sorted(L.TEMPLATES)
    common = " ".join(L.TEMPLATES.values()).lower().split()
    text = []
    for _ in range(6):
        text += [r.choice(common) if r.random() < 0.3 else f"w{r.randrange(50)}" for _ in range(r.randrange(60))]
        for w in L.TEMPLATES[r.choice(names)].split():
            roll = r.random()
            text += [] if roll < 0.06 else [w, r.choice(common)] if roll < 0.2 else [w]
    return " ".join(text)


@pytest.mark.parametrize("seed", range(40))
def test_patience_finds_what_exact_alignment_finds(seed, monkeypatch):
    """Damaged notices among template words, as by exact alignment without anchors."""
    text = planted(seed)
    got = notices(text)
    monkeypatch.setattr(L.Scanner, "anchored", lambda *a: None)
    want = notices(text)
    assert sum(x[1] for x in got) >= 0.98 * sum(x[1] for x in want)
    for name, n, m, a, b in want:
        assert any(x[0] == name and x[3] < b and a < x[4] for x in got)
    for name, n, m, a, b in got:
        assert n >= 0.8 * m and n >= 0.6 * (b - a)
        assert any(x[0] == name and x[3] < b and a < x[4] for x in want)


def test_a_text_of_many_notices_is_read_once():
    import time
    start = time.time()
    assert len(notices("All rights reserved. " * 5000)) == 5000
    assert time.time() - start < 20


def test_license_query_against_exact_alignment(spark, monkeypatch):
    """The registered query on whole sf0.001, and the exact alignment of every text."""
    from faultline.llm.queries import op5_license_scan
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in op5_license_scan(spark, sf).collect())
    monkeypatch.setattr(L.Scanner, "anchored", lambda *a: None)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d.doc_id, *n) for d in docs if d.text for n in notices(d.text))
    assert got == want and got
