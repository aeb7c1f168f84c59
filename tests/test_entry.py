import re
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
TABLES = Path("/root/testdata/sf0.001")
NAMES = ["ann_mixed_scl", "ann_untyped", "chain_edges", "edge_segments", "border_pair_sp", "edges_between_nodes", "read_merged_objects", "read_metis", "generate_filled", "has_edges", "word_count"]


def test_names():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(NAMES) <= set(sql) <= set(queries)


def test_nothing_else_imports_the_optional_package():
    for p in ROOT.rglob("*.py"):
        inside = p.relative_to(ROOT).parts
        if p.name == "corpus_pipeline.py" or "llm" in inside or ".git" in inside:
            continue
        assert not re.search(r"^\s*(from|import)\s+(nearway\.llm|corpus_pipeline)", p.read_text(), re.M), p


@pytest.mark.skipif(not TABLES.is_dir(), reason="the star-schema tables aren't here")
@pytest.mark.parametrize("name", NAMES)
def test_rows_are_those_of_sql(spark, name):
    import duckdb

    import __spark_entry__

    con = duckdb.connect()
    assert name in __spark_entry__.oracle_sql()
    for t in ("supplier", "customer", "part", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    rel = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    found = __spark_entry__.queries()[name](spark, str(TABLES))
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, rel.fetchall()))
