"""The registered queries: those with SQL against it, the others whole, on the smallest tables."""

import hashlib

import duckdb
import pytest

from prospector.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op2_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op3_embedding_near_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op9_line_dedup": ["doc_id", "n_lines", "n_removed", "removed"],
    "op10_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    out = QUERIES[name](spark, SF)
    want = con.execute(SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in out.columns]
    same = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    got = sorted(map(same, out.collect()))
    assert got == sorted(same([r[k] for k in at]) for r in want.fetchall()) and len(got) > 10


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_whole_tables(spark, name):
    out = QUERIES[name](spark, SF)
    assert out.columns == COLUMNS[name]
    source = "embeddings" if name.startswith("op3") else "documents"
    docs = spark.read.parquet(f"{SF}/{source}.parquet")
    rows = out.collect()
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in docs.collect())
    if name.startswith("op1_"):
        text = {r["doc_id"]: r["text"] for r in docs.collect()}
        whole = [r for r in rows if not r["n_removed"]]
        assert whole and all(r["kept_sha256"] == hashlib.sha256(b" ".join((text[r["doc_id"]] or "").encode().split())).hexdigest() for r in whole)
