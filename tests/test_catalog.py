"""Every query of the library's own operators against its SQL."""

import decimal
import os

import pandas as pd
import pytest

from tidemark import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        return float(v) if isinstance(v, (float, decimal.Decimal)) else v.isoformat() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v

    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def against_sql(spark, folder, name: str) -> None:
    """A query on a table of events of its own."""
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS FROM '{folder}/events.parquet'")
    got, want = catalog.queries()[name](spark, str(folder)).toPandas(), c.sql(catalog.oracle_sql()[name]).df()
    assert len(want) and rows(got) == rows(want)


def test_purchases_of_one_time_all_tick(spark, duck, tmp_path):
    duck.sql(f"COPY (SELECT event_id + 1000000 * k AS event_id, ts, user_id + 100000 * k AS user_id, event_type, value, props FROM events, range(3) t(k)) TO '{tmp_path}/events.parquet'")
    against_sql(spark, tmp_path, "src_adapter_subscribe")


def test_division_by_zero_and_large_quotients(spark, tmp_path):
    import duckdb

    pairs = [(3.0, 50.0), (-3.0, 50.0), (0.0, 50.0), (9e15, 50.001), (-9e15, 50.001), (7.0, 50.0000000000001), (4503599627.370497, 51.0), (1.0, 53.0), (1e308, 50.0001)]
    listed = ", ".join(f"({2 * k + i}, TIMESTAMP '2024-01-01' + INTERVAL {2 * k + i} SECOND, {k}, '{kind}', {v!r}::DOUBLE)" for k, pair in enumerate(pairs) for i, (kind, v) in enumerate(zip(("click", "view"), pair)))
    duckdb.connect().sql(f"COPY (SELECT * FROM (VALUES {listed}) t(event_id, ts, user_id, event_type, value)) TO '{tmp_path}/events.parquet'")
    against_sql(spark, tmp_path, "op_div")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_without_the_training_data_part():
    import pathlib

    root = pathlib.Path(catalog.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p
