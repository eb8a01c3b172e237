"""The pipeline against brute force, and the registered queries against their oracles."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline as C
from faultline.llm import linededup
from faultline.llm import quality as Q
from faultline.llm import registry
from tests.llm import test_decontam as decontam
from tests.llm import test_quality as quality
from tests.llm import test_repeats as repeats
from tests.llm import test_simhash as simhash
from tests.llm.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in registry.queries()} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and set(registry.queries()) <= set(names) and set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    res = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    want = sorted(map(repr, res.fetchall()))
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def test_bytes_query(spark):
    got = registry.queries()["op3_suffix_array_dedup"](spark, SMALL)
    assert repeats.multiset(repeats.bytes_got(got)) == repeats.multiset(repeats.bytes_brute(documents(spark), 400))


def test_lines_query(spark):
    got = registry.queries()["op4_line_dedup"](spark, SMALL)
    assert repeats.multiset(repeats.lines_got(got)) == repeats.multiset(repeats.passages_brute(documents(spark), 3, 50))


def test_lines_of_the_table_by_runs_of_three(spark):
    got = linededup.dedup_report(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert repeats.multiset(repeats.lines_got(got)) == repeats.multiset(repeats.lines_brute(documents(spark), 3))


def test_simhash_query(spark):
    rows = documents(spark)
    fps = [simhash.fingerprint(t) for _, t in rows]
    roots = simhash.roots(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (k, _), r in zip(rows, roots):
        least[r] = min(least.get(r, k), k)
    got = registry.queries()["op7_simhash_near_dedup"](spark, SMALL).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((k, f"{f:016x}", least[r]) for (k, _), f, r in zip(rows, fps, roots))


def test_pipeline_against_brute_force(spark):
    rows = documents(spark)

    def fine(text):
        n, chars, symbols, lines, again, of = quality.measures(text)
        return not (n < 50 or 2 * again > n or 10 * symbols > 3 * n or 2 * lines > of or chars < 2 * n or chars > 15 * n)
    rows = [(k, t) for k, t in rows if fine(t)]
    gone = {k: set(g) for k, _, g, _ in repeats.passages_brute(rows, 3, 50)}
    rows = [(k, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k])) for k, t in rows]
    rows = [(k, t) for k, t in rows if t.split()]
    fps = [simhash.fingerprint(t) for _, t in rows]
    roots = simhash.roots(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (k, _), r in zip(rows, roots):
        least[r] = min(least.get(r, k), k)
    rows = [(k, t) for (k, t), r in zip(rows, roots) if least[r] == k]
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    for (name, step), want in zip(C.STAGES[:3], [None, None, rows]):
        d = C.stage(step(spark, d, SMALL))
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id, r.text) for r in d.collect()) == sorted(rows)
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = C.benchmark_decontamination(spark, d, SMALL)
    left = {r.doc_id: r.text for r in clean.collect()}
    hits = [eval(x) for x in decontam.brute(rows, items)]
    for k, n, hit, _ in hits:
        assert (left.get(k) or "") == dict(rows)[k] if hit == 0 else len(decontam.words(left.get(k))) == n - hit
    packed = C.run(spark, SMALL).collect()
    assert {r.doc_id for r in packed} == set(left)
    from tests.llm.test_packing import whole
    whole(packed, 2048)


def test_groups_without_ids_and_with_one_id_stay_apart(spark):
    """Three texts without an id, two more with one id, copies of some, and an edit
    of a text that has a named document."""
    text = lambda i: " ".join(f"group{i} word{i * 1000 + j}" for j in range(200))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (5, text(4)), (5, text(5)), (5, text(5)), (6, text(5)),
            (9, text(6)), (None, text(6)), (4, text(6))]
    got = C.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SMALL)
    want = [(None, text(1)), (None, text(2)), (None, text(3)), (5, text(4)), (5, text(5)), (4, text(6))]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_stages_on_edges(spark, edges, nothing):
    for name, step in C.STAGES[:-1]:
        assert step(spark, nothing, SMALL).columns == nothing.columns and step(spark, nothing, SMALL).count() == 0
        assert step(spark, edges, SMALL).columns == edges.columns
        step(spark, edges, SMALL).collect()
    assert Q.STRICT.mask & Q.BASE.mask == Q.BASE.mask
