"""Every core query runs; those with SQL match DuckDB; none breaks on empty tables."""

from __future__ import annotations

import pytest
from comparing import same

from kontor import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.SQL:
        same(df, duck, catalog.SQL[name])
    else:
        assert df.count() > 0


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in ("dedup_entries", "web_entries", "poi_elements", "jsonld_orgs", "address_results", "scrape_final", "site_pages", "scrape_resolve", "documents", "canon_values", "placeholder_values", "events"):
        spark.read.parquet(f"{sf}/{t}.parquet").where("false").write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_empty_tables(spark, empty, name):
    assert catalog.QUERIES[name](spark, empty).count() == 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
