import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from faultline.llm import queries as Q, spelling as S
from tests.llm.conftest import EDGES, SMALL


def counted(rows):
    count = Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 3}


def brute(count):
    """By the words that are left when a letter goes."""
    holes, near = defaultdict(list), defaultdict(set)
    for w in count:
        for i in range(len(w)):
            holes[i, w[:i] + w[i + 1:]].append(w)
            if (less := w[:i] + w[i + 1:]) in count:
                near[w].add(less)
                near[less].add(w)
    for group in holes.values():
        for a in group:
            near[a] |= set(group) - {a}
    form = {}
    for w in count:
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        if best and count[best] >= 2 * count[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, count[w], len(near[w]), form.get(w, ""), count[form[w]] if w in form else 0, root(w)) for w in count)


def rows(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in df.collect())


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert rows(Q.op12_spelling_variants(spark, SMALL)) == brute(counted([(r.doc_id, r.text) for r in docs]))


def variants_of(rng, n):
    letters = "abcdeéßz×÷"
    seeds = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(n // 8)]
    out = set(seeds)
    while len(out) < n:
        w = rng.choice(seeds)
        i = rng.randrange(len(w))
        out.add(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], "".join(rng.sample(w, len(w)))]))
    return {w: rng.randint(3, 60) for w in out if len(w) >= 5}


def test_many_boxes_and_a_small_sample(spark):
    """The cuts change the balance only; anagrams share a point."""
    count = variants_of(random.Random(3), 1500)
    count |= {w: 4 for w in {"".join(random.Random(i).sample("abcdefg", 7)) for i in range(300)}}
    table = spark.createDataFrame(list(count.items()), "word string, n long").repartition(5)
    want = [x[:3] for x in brute(count) if x[2]]
    for size, sample in ((40, 100), (40, 100_000), (10_000, 1), (3, 500)):
        assert sorted((r.word, r.n, r.n_near) for r in S.near_words(table, size, sample).collect()) == want


def test_search_finds_all_in_range():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (400, S.DIMS)) * (rng.random((400, S.DIMS)) < .05)
    x = x.astype(np.int32)
    tree = S.Tree(x, 8)
    for up, down in ((0, 0), (1, 0), (1, 1)):
        found = {(int(q), int(p)) for _, ps, qs in tree.search(x, up, down) for q in qs for p in ps}
        above, below = np.maximum(x[None] - x[:, None], 0).sum(2), np.maximum(x[:, None] - x[None], 0).sum(2)
        assert {(int(q), int(p)) for q, p in zip(*np.nonzero((above <= up) & (below <= down)))} <= found
    assert len(found) < 400 * 400 / 2  # branches were pruned


def test_signatures_never_exceed_the_distance():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, (200, S.DIMS)).astype(np.int32)
    y = x + (rng.random(x.shape) < .02)
    bits = np.bitwise_count(S.signature(x) ^ S.signature(y.astype(np.int32))).astype(int).sum(axis=1)
    assert (bits <= np.abs(x - y).sum(axis=1)).all()


def test_letters_in_order():
    code = lambda w: S.letters(pa.array([w]), len(w))
    assert S.one_replaced(code("abcde"), code("abxde")).all() and not S.one_replaced(code("abcde"), code("abced")).any()
    for long in ("xabcde", "abxcde", "abcdex", "aabcde"):
        assert S.one_inserted(code("abcde"), code(long)).all()
    assert not S.one_inserted(code("abcde"), code("abxced")).any()


def test_chains_end_at_the_last_form(spark):
    chain = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(40)]
    found = {r.word: r.root for r in S.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert found == {w: "w40" for w, _ in chain}


def test_edges(spark, edges):
    more = [(None, "Wörter wörter WÖRTER worter words Words WORDS word's swords"), (None, "x" * 5000 + " " + "x" * 5001), (20, ("x" * 5000 + " ") * 3 + ("x" * 5001 + " ") * 7)]
    both = edges.select("doc_id", "text", "N_WORDS", "fail_bits").unionByName(
        spark.createDataFrame([(k, t, "n", 7) for k, t in more], "doc_id long, text string, N_WORDS string, fail_bits int"))
    want = brute(counted(EDGES + more))
    assert rows(S.variants(both)) == want and any(x[5] != x[0] for x in want)


def test_empty(nothing):
    assert S.variants(nothing).count() == 0
