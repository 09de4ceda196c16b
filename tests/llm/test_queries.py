"""The registered queries against their SQL, and the pipeline stage by stage."""

import collections
import os

import duckdb
import pytest

from scanloom.llm import queries as llm

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{t}')")
    return c


def plain(v):
    return None if v is None or str(v) in ("<NA>", "nan") else round(float(v), 6) if not isinstance(v, (str, bool)) else v


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_gives_what_sql_gives(spark, con, name):
    out = llm.queries()[name](spark, DATA)
    columns = sorted(out.columns)
    found, wanted = out.toPandas()[columns], con.execute(llm.oracle_sql()[name]).fetchdf()[columns]
    rows = lambda f: collections.Counter(tuple(map(plain, r)) for r in f.itertuples(index=False, name=None))
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_query_has_a_row_for_each_row(spark, name):
    table = "pages" if "html" in name else "documents"
    assert llm.queries()[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [docs.count()]
    for _, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA).cache()
        assert after.columns == docs.columns and after.join(docs, "doc_id", "left_anti").isEmpty()
        kept.append(after.count())
        docs = after
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.3 * kept[0]
    out = pipeline.run(spark, DATA)
    assert out.columns == [*docs.columns, "copies"] and 0 < out.count() <= kept[-1]


def test_stages_against_brute_force(spark):
    """Each stage that follows the classifier, on what the one before kept."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_operators import ascii_lower, brute_components, brute_contamination, brute_fingerprint

    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    stages, rows = dict(pipeline.STAGES), docs.select("doc_id", "text").collect()
    last = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        last[ascii_lower(r["text"] or "")] = r["doc_id"]
    assert {r["doc_id"] for r in stages["exact_copies"](spark, docs, DATA).collect()} == set(last.values())
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    roots = brute_components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], i), i)
    assert {r["doc_id"] for r in stages["near_copies"](spark, docs, DATA).collect()} == set(least.values())
    # where no word of an item's window is, there is no window: most documents need no search
    clean = set()
    for r in rows:
        words = set(ascii_lower(r["text"] or "").split())
        near = [(k, t) for k, t in items if len(words & set(ascii_lower(t).split())) >= 5]
        if not near or not brute_contamination(r["text"], near)[1]:
            clean.add(r["doc_id"])
    assert {r["doc_id"] for r in stages["benchmark_passages"](spark, docs, DATA).collect()} == clean


def test_stages_with_odd_rows(spark):
    """Null ids, texts and sources, repeated rows, empty texts, a very long text, and columns with the names that stages use."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(k, f"this is document {k} of a few " * 5, "en", "s", 5) for k in range(12)]
    rows += [rows[3], (None, "a null id", None, None, None), (None, None, None, None, None), (20, "", "en", "s", 0), (21, None, "en", None, 0), (3, "the same id again", "en", "s", 4), (22, "word " * 300_000, "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    docs = docs.selectExpr("*", "1 as copies", "'x' as sha", "2 as fp", "3 as row", "'k' as keep_id", "4 as size", "5 as u")
    for frame in (docs, docs.limit(0)):
        now = frame
        for name, stage in pipeline.STAGES:
            after = stage(spark, now, DATA)
            assert after.columns[: len(docs.columns)] == docs.columns, name
            found = after.collect()
            assert len(found) <= max(1, now.count())
            now = spark.createDataFrame(found, after.schema) if name != "source_mix" else after
        assert now.columns == [*docs.columns, "_copies"]
