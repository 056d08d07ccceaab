import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from civiclink.plans.registry import TABLES

DATA = "/root/testdata/sf0.001"
# A cross-section; tools/compare.py runs all of them.
SAMPLE = ["place_ladder_lookups", "audit_events_wide", "places_from_pages", "manifest_upsert", "document_chunks"]


def test_every_query_is_documented_and_every_twin_has_a_query():
    readme = (Path(entry.__file__).parent / "README.md").read_text()
    words = set(re.findall(r"[a-z0-9_]+", readme))
    assert not set(entry.queries()) - words
    assert not set(entry.oracle_sql()) - set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 200 and "match_method" in df.columns


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, result.fetchall()))
