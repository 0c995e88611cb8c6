"""The queries over whole tables: every row counts, compared with brute force on the smallest tables."""

import duckdb
import numpy as np
import pytest

from aerolith.plans import scenes

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def distances():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet'")
    o = con.sql(f"SELECT * FROM {scenes.OBS}").df()
    at = o[["x", "y", "z"]].to_numpy(float)
    d2 = sum((at[:, None, k] - at[None, :, k]) ** 2 for k in range(3))
    np.fill_diagonal(d2, np.inf)
    return o[scenes.KEY].to_numpy(np.int64).tolist(), d2


def test_radius_outliers_of_all_rows(spark, distances):
    keys, d2 = distances
    n = (d2 <= 9).sum(1)
    want = sorted((*k, int(c)) for k, c in zip(keys, n, strict=True) if c >= 2)
    assert sorted(map(tuple, scenes.radius_outliers(spark, DATA).collect())) == want


def test_statistical_outliers_of_all_rows(spark, distances):
    keys, d2 = distances
    mean = np.sqrt(np.partition(d2, 5, axis=1)[:, :5]).mean(1)
    kept = mean <= mean.mean() + 2 * mean.std()
    got = sorted(map(tuple, scenes.statistical_outliers(spark, DATA).collect()))
    want = sorted((*k, m) for k, m, ok in zip(keys, mean.tolist(), kept, strict=True) if ok)
    assert [g[:4] for g in got] == [w[:4] for w in want] and [g[4] for g in got] == pytest.approx([w[4] for w in want], abs=1e-6)


def test_all_cells_boxes_and_descriptors_count(spark):
    con = duckdb.connect()
    for name in ("lineitem", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    cells = con.sql("SELECT count(DISTINCT (l_orderkey % 97, l_partkey % 89)) FROM lineitem").fetchall()[0][0]
    assert scenes.raster_metadata(spark, DATA).first()["valid"] == cells
    assert scenes.void_fill(spark, DATA).filter("not filled").count() == cells
    overlaps = scenes.box_overlaps(spark, DATA)
    assert overlaps.filter("a_linenumber <> b_linenumber").count() > 0
    assert scenes.descriptor_matches(spark, DATA).filter("a % 5 <> 0").count() > 0
