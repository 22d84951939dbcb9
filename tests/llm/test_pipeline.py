"""Registered queries against their statements, and the pipeline's stages one after the other."""

import duckdb
import pytest

import corpus_pipeline
from bidstream.llm import near_dedup
from bidstream.llm.queries import QUERIES, STATEMENTS
from check import TABLES, normalised

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(STATEMENTS))
def test_equals_statement(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    expected = duck.sql(STATEMENTS[name])
    order = [list(expected.columns).index(c) for c in columns]
    assert normalised(frame.select(*columns).collect()) == normalised([tuple(r[i] for i in order) for r in expected.fetchall()])


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(str(tmp_path / name))
        before, docs = docs.count(), spark.read.parquet(str(tmp_path / name))
        if name in ("toxicity", "near_dedup"):
            assert 0 < docs.count() < before
        if name == "suffix_dedup":
            assert docs.count() == before
    assert docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 1024


def test_near_copies_from_80_per_cent_on_are_dropped(spark):
    # A substitution inside 100 words replaces 5 of 96 shingles: (96 - 5k) / (96 + 5k) is 0.811 for 2, 0.730 for 3.
    rows = []
    for group in range(40):
        base = [f"g{group}w{i}" for i in range(100)]
        for k in (0, 2, 3):
            copy = list(base)
            for at in range(k):
                copy[10 + 30 * at] = f"g{group}k{k}e{at}"
            rows.append((10 * group + k, " ".join(copy), "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(10 * g + k for g in range(40) for k in (0, 3))


def test_bands_miss_no_more_at_a_lower_threshold():
    missed = [(1 - t ** near_dedup.ROWS) ** near_dedup.bands_of(round(100 * t)) for t in (0.85, 0.8, 0.7)]
    assert near_dedup.bands_of(85) == near_dedup.BANDS and max(missed[1:]) <= missed[0] < 8e-7
