"""The pipeline's stages, each on its predecessor's rows, and the registered queries."""
import random

import duckdb
import pandas as pd
import pytest
from test_operators import text  # noqa: E402

import corpus_pipeline
from scrubline.llm import decontamination, near_dedup
from scrubline.llm.queries import LLM_ORACLES, LLM_QUERIES
from scrubline.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_stages_on_planted_documents(spark, tmp_path):
    rng = random.Random(9)
    good = [(i, text(rng, 80, 4000), "en", f"s{i % 3}", 1) for i in range(120)]
    passage = text(rng, 30, 4000)
    toxic = [(200 + i, text(rng, 60, 4000) + " vileword nastyword vileword", "en", "s0", 1) for i in range(40)]
    near = [(300 + i, t.replace(t.split()[40], "altered"), "en", "s1", 1) for i, (_, t, *_r) in enumerate(good[:10])]
    leak = [(400 + i, text(rng, 40, 4000) + " " + passage, "en", "s2", 1) for i in range(5)]
    docs = spark.createDataFrame(good + toxic + near + leak, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60)] + [(200 + i, 1, 1) for i in range(20)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"] for r in at.select("doc_id").collect()}
    assert not seen["quality"] & set(range(200, 240)) and len(seen["quality"] & set(range(120))) >= 118
    assert not seen["near_dedup"] & set(range(300, 310))
    assert not seen["decontamination"] & set(range(400, 405)) and len(seen["decontamination"] & set(range(120))) >= 118
    assert seen["mixing"] <= seen["decontamination"]
    tokens = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path))
    assert tokens.count() == at.count()


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))
    assert set(LLM_ORACLES) <= set(LLM_QUERIES)


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_query_covers_its_table(spark, name):
    table = {"op4_warc": "pages", "op12_vector_codes": "embeddings"}.get(name, "documents")
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    want = 600 * rows.select("source").distinct().count() if name == "op11_filter_audit" else rows.count()
    assert LLM_QUERIES[name](spark, SF).count() == want


def _canon(df):
    cols = sorted(df.columns)
    norm = lambda v: round(v, 9) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return cols, sorted(tuple(None if pd.isna(x) else norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = _canon(LLM_QUERIES[name](spark, SF).toPandas()), _canon(con.execute(LLM_ORACLES[name]).df())
    assert got[0] == want[0] and sorted(map(str, got[1])) == sorted(map(str, want[1]))


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
