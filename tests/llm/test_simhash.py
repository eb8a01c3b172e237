import random
import re

import numpy as np
import pytest
import xxhash

from faultline.llm import simhash as S
from faultline.llm.components import components
from tests.llm.conftest import EDGES


def fingerprint(text, shingle=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values, linked):
    up = list(range(len(values)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_edges_against_brute_force(edges):
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in S.near_duplicates(edges).collect()), key=repr)
    fps = [fingerprint(t) for _, t in EDGES]
    at = roots(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (k, _), r in zip(EDGES, at):
        if k is not None:
            least[r] = min(least.get(r, k), k)
    assert got == sorted(((k, f, least.get(r)) for (k, _), f, r in zip(EDGES, fps, at)), key=repr)


def test_empty(nothing):
    assert S.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("distance", range(8))
def test_posting_positions_meet(distance):
    """Any pair with the guaranteed number of shared bytes meets in a list."""
    from itertools import combinations
    sets = [set(c) for c in S.posting_positions(distance)]
    for shared in combinations(range(8), 8 - distance):
        assert any(s <= set(shared) for s in sets)


@pytest.mark.parametrize("size", [4, 64, 2048])
def test_dense_cluster_is_linked_whole(spark, size):
    """Hundreds of fingerprints around a few centres; lists are split at every size."""
    r = random.Random(3)
    fps = set()
    for _ in range(4):
        c = r.getrandbits(64)
        fps |= {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(150)}
    fps |= {r.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = S.links(nodes, 3, size).collect()
    assert all(((x.a ^ x.b) & (1 << 64) - 1).bit_count() <= 3 for x in found)
    at = {signed(f): i for i, f in enumerate(fps)}
    pairs = {(at[x.a], at[x.b]) for x in found} | {(at[x.b], at[x.a]) for x in found}
    assert roots(range(len(fps)), lambda a, b: (a, b) in pairs) == roots(fps, lambda a, b: (a ^ b).bit_count() <= 3)


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(1, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(7, 7), (5000, 5001), (5001, 5000), (5001, 5000)]
    links += [(r.randrange(9000, 9200), r.randrange(9000, 9200)) for _ in range(150)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    names = sorted({n for a, b in links if a != b for n in (a, b)})
    both = {(a, b) for a, b in links} | {(b, a) for a, b in links}
    want = roots(names, lambda a, b: (a, b) in both)
    groups = {}
    for n, w in zip(names, want):
        groups.setdefault(w, set()).add(got[n])
    assert set(got) == set(names) and all(len(g) == 1 for g in groups.values()) and len(set(got.values())) == len(groups)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bits_are_a_strict_majority():
    off, data = np.array([0, 11]), np.frombuffer(b"A b c d e f", np.uint8)
    assert int(S.fingerprints_of(off, data, 3)[0]) == fingerprint("a B c d e f")
