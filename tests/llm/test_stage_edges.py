from __future__ import annotations

import corpus_pipeline as cp
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _tag string, _doc int, _nth int, copies string, row string, h long, size long"


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize(("name", "stage"), cp.STAGES)
def test_empty_tables(spark, folder, name, stage):
    out = stage(spark, spark.createDataFrame([], SCHEMA), folder)
    assert out.collect() == [] and {"doc_id", "text", "lang", "source", "n_chars"} <= set(out.columns)


@pytest.mark.parametrize(("name", "stage"), cp.STAGES)
def test_clashing_names_nulls_and_ties(spark, folder, name, stage):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(i, t, "en", "s", 1, "tag", i, 7, "mine", "r", 3, 4) for i, t in [(1, text), (2, text + "\n" + text), (2, None), (3, ""), (3, "other"), (None, text), (None, None), (1, text)]]
    out = stage(spark, spark.createDataFrame(rows, SCHEMA), folder)
    want = [c for c in SCHEMA.replace(", ", ",").split(",")]
    assert sorted(out.columns) == sorted(c.split(" ")[0] for c in want)
    for r in out.collect():
        assert (r._tag, r._nth, r.row, r.h) == ("tag", 7, "r", 3)
        assert name == "mixing" or r.copies == "mine"
