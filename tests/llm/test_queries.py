"""Registered queries on the smallest tables: SQL definitions, stages against brute force, no driver-side loss."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strictpast.llm import exact_dedup, langid, queries, simhash
from strictpast.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    a, b = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    a, b = (x[sorted(x.columns)].astype(str).sort_values(sorted(x.columns)).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"pipeline"}))
def test_rows(spark, name):
    found = queries.QUERIES[name](spark, SF)
    wanted = {"op1": {"query_id", "rank", "vec_id", "score"}, "op2": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}, "op3": {"doc_id", "held_out", "lang_pred", "score"}, "op4": {"doc_id", "fingerprint", "component_id"}, "op5": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}, "op6": {"doc_id", "held_out", "score", "predicted"}, "op7": {"doc_id", "rate"}, "op8": {"page_id", "url", "text", "n_chars"}}[name.split("_")[0]]
    assert wanted <= set(found.columns)
    rows = found.toPandas()
    source = {"op1": None, "op8": "pages"}.get(name.split("_")[0], "documents")
    if source:
        key = "page_id" if source == "pages" else "doc_id"
        assert set(rows[key]) == {r[0] for r in table(spark, SF, source).select(key).collect()}
    if name.startswith("op3"):
        langs = table(spark, SF, "documents").select("doc_id", "lang").toPandas().merge(rows, on="doc_id")
        held = langs[langs["held_out"]]
        assert (held["lang"] == held["lang_pred"]).mean() > 0.8


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == names
        kept[name] = {r[0] for r in docs.select("doc_id").collect()}
    source = table(spark, SF, "documents")
    letters = {r.doc_id for r in source.collect() if r.text and any(map(str.isalpha, r.text))}
    assert kept["language_id"] == {r.doc_id for r in langid.keep_identified(source).collect()} <= letters and len(kept["language_id"]) > 0.97 * len(letters)
    first = source.where(source.doc_id.isin(sorted(kept["language_id"])))
    assert kept["exact_dedup"] == {r.doc_id for r in exact_dedup.exact_dedup(first).where("kept").collect()}
    second = source.where(source.doc_id.isin(sorted(kept["exact_dedup"])))
    assert kept["simhash"] == {r.component_id for r in simhash.near_components(second).collect()}
    assert kept["mixing"] == kept["simhash"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed["doc_id"]) == kept["mixing"] and (packed.groupby("sequence_id")["length"].sum() <= 4096).all()
    assert (packed[packed["piece"] == 0].groupby("doc_id").size() == docs.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].reindex(sorted(kept["mixing"]))).all()


def test_stages_keep_any_column(spark):
    """Column names that stages use inside, or that hold a dot, pass through all stages with their values."""
    names = ["__turn", "__id", "__copies", "__stay", "__lang", "a.b", "row", "key", "stay", "copies", "id", "turn", "slot", "domain", "tokens", "digest"]
    plain = table(spark, SF, "documents")
    odd = plain.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names])
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == odd.columns
    rows = docs.collect()
    source = {r["doc_id"]: r for r in plain.collect()}
    assert rows
    for r in rows:
        assert [r[n] for n in names] == [f"{n}:{r['doc_id']}" for n in names]
        assert all(r[c] == source[r["doc_id"]][c] for c in plain.columns)
    assert set(corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()["doc_id"]) == {r["doc_id"] for r in rows}
