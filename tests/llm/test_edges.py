"""Every operator and stage on odd rows and on empty tables."""

import pytest

import corpus_pipeline
from lumenframe.llm import entry
from lumenframe.llm.common import table

QUERIES = entry.queries()
ROWS = 21


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_edge_rows(spark, edge_dir, name):
    rows = QUERIES[name](spark, edge_dir).collect()
    if name.startswith(("op4", "op7")):
        assert len({r["doc_id"] for r in rows}) == 18 and len(rows) >= ROWS
    elif name.startswith("op2"):
        assert len(rows) == 6
    else:
        assert len(rows) == ROWS  # each row comes back


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_edges(spark, edge_dir, empty_dir, name, stage):
    for d in (edge_dir, empty_dir):
        docs = table(spark, d, "documents")
        out = stage(spark, docs, d)
        if name != "best-fit packing":
            assert out.columns == docs.columns
        rows = out.collect()
        assert not rows or d == edge_dir
        if name == "MinHash near-dedup" and rows:
            ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
            assert len(ids) == len(set(ids)) and 4 in ids and 5 not in ids and 6 not in ids


def test_pipeline_runs(spark, edge_dir, empty_dir):
    assert corpus_pipeline.run(spark, edge_dir).count() > 0
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
