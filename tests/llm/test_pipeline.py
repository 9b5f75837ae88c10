import pytest

import corpus_pipeline as cp
from sluiceway.llm.decontam import find_leaks
from sluiceway.llm.mixing import mix_sources
from sluiceway.llm.near_dup import near_duplicates
from sluiceway.llm.pii import DEMO_KEY, pseudonymise
from sluiceway.llm.toxicity import score_toxicity


def test_stages_against_their_operators(spark, sf):
    """Each stage keeps what its operator's own result says, row by row."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").persist()
    columns = docs.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    bench, labels = spark.read.parquet(f"{sf}/benchmark.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = cp.toxicity(spark, docs, sf).persist()
    assert out.columns == columns and ids(out) == ids(score_toxicity(docs, labels).filter("predicted = 0"))
    docs, out = out, cp.near_duplicates(spark, out, sf).persist()
    assert out.columns == columns and ids(out) == ids(near_duplicates(docs).filter("doc_id = class_id"))
    docs, out = out, cp.decontamination(spark, out, sf).persist()
    leaks = set(ids(find_leaks(docs, bench)))
    assert out.columns == columns and ids(out) == [k for k in ids(docs) if k not in leaks]
    docs, out = out, cp.pseudonyms(spark, out, sf).persist()
    want = {r.doc_id: r.text for r in pseudonymise(docs, DEMO_KEY).collect()}
    assert out.columns == columns and {r.doc_id: r.text for r in out.collect()} == want
    docs, out = out, cp.mixture(spark, out, sf)
    assert {(r.doc_id, r.taken) for r in out.collect()} == {(r.doc_id, r.taken) for r in mix_sources(docs).collect() if r.taken}
    whole = cp.run(spark, sf)
    assert sorted(map(str, whole.collect())) == sorted(map(str, out.collect()))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, _row string, n_found string, class_id int, `my col` string, `a.b` int, `a-b` string, `t``k` string"
LONG = " ".join(f"w{k}" for k in range(30_000))
ODD = [
    (1, None, None, None, None, 1, "a", None, 1), (2, "", "en", "s", 0, 1, None, "x", None), (None, "no id here", "en", "s", 10, None, "b", "y", 2),
    (3, "the same words in both of the rows", "en", "s", 34, 1, "c", "z", 3), (3, "the same words in both of the rows", "en", "s", 34, 1, "c", "z", 3), (4, LONG, "en", "t", len(LONG), 1, "d", None, 4),
    (5, "mail a.b@example.com now please", "en", None, 31, 1, "e", None, 5),
]


ODD = [(*r, "m", 1, None, "q") for r in ODD]


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_odd_rows(spark, sf, name, stage):
    """Nulls, an empty and a very long text, repeated rows and columns with clashing names; and an empty table."""
    docs = spark.createDataFrame(ODD, SCHEMA)
    out = stage(spark, docs, sf)
    rows = out.collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    every = sorted((r[0] is None, r[0] or 0) for r in ODD)
    if name == "mixture":
        assert [c for c in out.columns if c not in ("size", "target", "taken")] == [c for c in docs.columns if c != "size"]
        assert {k for _, k in ids} == {0, 3, 4, 5} and sum(r.taken for r in rows) > 0
    else:
        assert out.columns == docs.columns
        assert ids == (sorted({*every}) if name == "near_duplicates" else every)
        assert all(r._row == next(x[6] for x in ODD if x[0] == r.doc_id) for r in rows)
    assert stage(spark, docs.limit(0), sf).collect() == []


def test_run_on_odd_rows(spark, sf, tmp_path):
    """The whole pipeline over nulls, repeats, a long text and odd names, and over an empty table."""
    for rows, name in ((ODD, "odd"), ([], "none")):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{table}.parquet").write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    out = cp.run(spark, f"{tmp_path}/odd").collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 3, 4, 5] and all(r["a.b"] == 1 and r["my col"] == "m" for r in out)
    assert cp.run(spark, f"{tmp_path}/none").collect() == []
