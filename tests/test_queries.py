"""Every query of the catalogue against its SQL twin, and against itself under other partitionings."""

import pytest
from compare import differences, norm

from kinograph.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) - set(ORACLES) == {"marching_fill"}  # an ordered front: tests/test_marching.py


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", ["overlay_threshold_sweep", "coverage_reach", "alpha_matte_fit", "robust_z_outliers", "segment_plan", "emergency_order", "latest_job_state"])
def test_partitions_change_nothing(spark, name):
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(tuple(norm(v) for v in r) for r in QUERIES[name](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
