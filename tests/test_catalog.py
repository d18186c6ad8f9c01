import pytest

from paths import SF, SF_ORACLE
from oracle import assert_same
from spanforge.plans import analyses, catalog

ANALYSES = sorted(n for n in analyses.ORACLE_SQL if analyses.QUERIES[n].__module__ == analyses.__name__)
REST = sorted(set(analyses.ORACLE_SQL) - set(ANALYSES))


@pytest.mark.parametrize("name", REST)
def test_query_against_sql(spark, name):
    assert_same(catalog.QUERIES[name](spark, SF_ORACLE), catalog.ORACLE_SQL[name], SF_ORACLE)


@pytest.fixture(scope="module")
def small_plans(spark):
    """The analyses' plans are large, and take a fraction of the time on small tables without compiled code and runtime replanning."""
    settings = {"spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", ANALYSES)
def test_analysis_against_sql(spark, small_plans, name):
    assert_same(analyses.QUERIES[name](spark, SF), analyses.ORACLE_SQL[name], SF)


def test_lanes_never_hold_overlapping_reads(spark):
    rows = catalog.QUERIES["q_lane_packing"](spark, SF).collect()
    lanes = {}
    for r in sorted(rows, key=lambda r: r["xmin"]):
        key = (r["sample"], r["pack_lane"])
        assert lanes.get(key, -1) < r["xmin"]
        lanes[key] = r["xmax"]
    assert rows


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
