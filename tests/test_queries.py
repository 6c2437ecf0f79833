"""Every query of the core library against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from cliploom.plans import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _rows(frame):
    columns = sorted(frame.columns)
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted((tuple(r) for r in clean.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, db, name):
    assert _rows(registry.QUERIES[name](spark, str(DATA)).toPandas()) == _rows(db.sql(registry.ORACLES[name]).df())


def test_every_query_is_checked():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"chain_logits", "experiment_sets", "fused_places", "trained_chain", "trained_head", "unit_head"}


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert {r["split"] for r in rows} == {"train", "val", "test"}
