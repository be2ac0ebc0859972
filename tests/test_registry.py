"""Every named query that has SQL gives the same rows as that SQL in DuckDB, on the smallest test tables."""

from pathlib import Path

import duckdb
import pytest

from tarnwick.plans import registry

SF = Path("/root/testdata/sf0.001")
TABLES = "events documents embeddings chunks search_hits retrieval_results golden_set ablation_runs collections mix_targets".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


tables = pytest.mark.skipif(not SF.exists(), reason="no test tables")
HELD = sorted(registry.oracle_sql())
#: Queries that SQL can't well express; their operators have tests of their own.
OTHERS = {
    "ablation": {"config", "n", "recall", "precision", "hit", "rr", "ndcg"}, "ablation_hits": {"config", "qid", "chunk_id", "score", "rerank_score", "final_rank"}, "html_blocks": {"doc_id", "block_no", "tag", "block"},
    "html_markdown": {"doc_id", "markdown"}, "structural_chunks": {"chunk_id", "text", "section_path"}, "semantic_chunks": {"chunk_id", "text", "token_count"}, "ann_topk": {"qid", "chunk_id", "score", "rank"}, "token_bucket": {"user_id", "event_id", "allowed", "tokens"},
}


@tables
@pytest.mark.parametrize("name", HELD)
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert rows == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())


@tables
@pytest.mark.parametrize("name", sorted(OTHERS))
def test_query_without_sql(spark, name):
    df = registry.queries()[name](spark, str(SF))
    assert set(df.columns) >= OTHERS[name]
    rows = df.collect()
    assert rows and len(set(map(repr, rows))) == len(rows)


def test_every_query_is_tested():
    assert set(HELD) | set(OTHERS) == set(registry.queries())


def test_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
