import os

import pytest
from cases import documents, frame

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_texts import bag, classes, words  # noqa: E402

from tallyloom.llm import queries, stages  # noqa: E402

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    known = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in items if w for k in range(max(1, len(w) - 9))}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs.collect()
        docs = corpus_pipeline.materialize(spark, stage(spark, docs, SF), "test")
        assert docs.columns == columns
        left = {r.doc_id for r in docs.collect()}
        ids = {r.doc_id for r in before}
        assert left <= ids
        if name == "quality":
            wrong = sum((i in left) != bool(known[i].quality) for i in ids if i in known)
            assert wrong <= 0.1 * len([i for i in ids if i in known])
        elif name == "exact_dedup":
            first = {}
            for r in sorted(before, key=lambda r: r.doc_id):
                first.setdefault(" ".join(__import__("re").split(r"[\x20\x09-\x0D]+", r.text or "")), r.doc_id)
            assert left == set(first.values())
        elif name == "near_dedup":
            assert left == {c[0] for c in classes([(r.doc_id, r.text) for r in before])}
        else:
            clean = set()
            for r in before:
                w = words(r.text)
                if not any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1)):
                    clean.add(r.doc_id)
            assert left == clean
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == left
    assert {(p.doc_id, p.start, p.length) for p in pieces} == {(r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, SF).collect()}


def test_stages_take_odd_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (documents(), []):
        df = frame(spark, rows)
        for stage in (stages.exact, stages.near, stages.clean):
            out = stage(spark, df, str(tmp_path))
            assert out.columns == df.columns and out.count() <= len(rows)
        stages.quality(spark, df, str(tmp_path)).count()
        stages.pack(spark, df, str(tmp_path)).count()
    assert bag("")  == {}


def test_queries_are_registered():
    names = sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{n}" for n in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5
