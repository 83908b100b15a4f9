"""The registered queries: twins in DuckDB where SQL can express them, and the shape of the rest."""

import os
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from auditlark.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are absent")


def test_entry_offers_every_query():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = QUERIES[name](spark, SF_DIR)
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    nulls_last = lambda row: [(x is None, x) for x in row]
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall()), key=nulls_last)
    assert sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=nulls_last) == want


def test_neighbours_of_the_table(spark):
    """Every query has its 5 results, with exact scores, and nine in ten are the nearest."""
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect() if r.embedding is not None}
    unit = {i: v / np.sqrt((v * v).sum()) for i, v in rows.items() if len(v) and np.isfinite(v).all() and (v != 0).any()}
    found, hits, wanted = QUERIES["op11_neighbours"](spark, SF_DIR).collect(), 0, 0
    for q in (i for i in unit if i % 50 == 0):
        own = {r.vec_id: r.score for r in found if r.query_id == q}
        best = sorted(((-float(unit[q] @ v), i) for i, v in unit.items() if i != q))[:5]
        assert len(own) == len(best)
        assert all(abs(score - unit[q] @ unit[i]) < 1e-12 for i, score in own.items())
        hits, wanted = hits + len(own.keys() & {i for _, i in best}), wanted + len(best)
    assert wanted and hits >= 0.9 * wanted
