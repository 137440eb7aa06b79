"""Registered corpus queries against their SQL, and the pipeline's stages."""

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_mix_sources", "op3_line_dedup", "op5_exact_topk", "op9_warc", "op11_language",
                                  "op12_ranked_search", "op13_vector_codes"])
def test_query_equals_sql(spark, name):
    import __spark_entry__ as entry
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    rows = want.fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, SF).select(*cols).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, rows))


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    rows = [docs.count()]
    for name, stage in p.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        rows.append(docs.count())
        if name != "tokens":
            assert docs.columns == before.columns
            assert docs.join(before, before.columns, "left_anti").count() == 0
        if name == "quality":
            kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in good) > 0.9 * len(good)
        if name == "near_dedup":
            assert docs.groupBy("text").count().where("count > 1").count() == 0
    assert rows[0] > rows[1] >= rows[2] >= rows[3]
    assert rows[4] == rows[5]
    assert docs.where(F.col("n_tokens") < 1).count() == 0
    assert p.run(spark, SF).count() == rows[5]


def test_pipeline_of_odd_and_empty_tables(spark):
    """Clashing and dotted column names, nulls, repeated rows; then no row at all."""
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    odd = spark.createDataFrame([(None, None), (7001, None), (7002, ""), (7003, "one two"), (7003, "one two"), (7003, "three four"), (None, "five")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    for name in ("score", "_score", "_text_scored", "_text_scanned", "_mix_key", "_mix_source", "drop", "key", "copy", "of", "a.b"):
        docs = docs.withColumn(name, F.lit(name))
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in p.STAGES:
            now = stage(spark, now, SF).cache()
            if name != "tokens":
                assert now.columns == docs.columns
                assert now.where("`a.b` <> 'a.b' OR _score <> '_score' OR key <> 'key' OR copy <> 'copy'").count() == 0
        assert (now.count() > 0) == (start is docs)
