"""Queries whose pairs grow with the square of their tables make no more rows than the tables do."""

import duckdb
import pytest

from oracle import assert_same
from paths import SF, SF_ORACLE
from spanforge.plans import analyses, catalog

COPIES = 30
#: Shifts of keys that leave chromosomes and strands as they are.
KEYS = {"orders": {"o_orderkey": 1500, "o_custkey": 200}, "lineitem": {"l_orderkey": 1500, "l_partkey": 200, "l_suppkey": 50}}
NAMES = ["q_best_per_group", "q_interval_overlap", "q_strand_blind_single", "q_symmetric_minus"]


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    to = tmp_path_factory.mktemp("grown")
    for name, keys in KEYS.items():
        shifted = ", ".join(f"CAST({k} + i * {by} AS BIGINT) AS {k}" for k, by in keys.items())
        duckdb.sql(f"COPY (SELECT * REPLACE ({shifted}) FROM '{SF}/{name}.parquet', range({COPIES}) r(i)) TO '{to}/{name}.parquet'")
    return str(to)


def joined(plan) -> list[int]:
    """Rows that come out of each join of a plan that was run, cached ones too."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return joined(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return joined(plan.plan())
    if kind == "InMemoryTableScanExec":
        return joined(plan.relation().cachedPlan())
    children = plan.children()
    below = [n for i in range(children.size()) for n in joined(children.apply(i))]
    return below + ([plan.metrics().apply("numOutputRows").value()] if "Join" in kind else [])


@pytest.mark.parametrize("name", NAMES)
def test_pairs_are_not_made(spark, grown, name):
    df = catalog.QUERIES[name](spark, grown)
    assert_same(df, catalog.ORACLE_SQL[name], grown)
    rows = joined(df._jdf.queryExecution().executedPlan())
    assert rows and max(rows) <= 2 * spark.read.parquet(f"{grown}/lineitem.parquet").count(), rows


def shuffled(plan, seen: dict) -> int:
    """Rows written by all shuffles of a plan that was run, cached ones too, each once."""
    kind = plan.getClass().getSimpleName()
    if plan.id() in seen:
        return 0
    seen[plan.id()] = kind
    if kind == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan(), seen)
    if kind.endswith("QueryStageExec"):
        return shuffled(plan.plan(), seen)
    if kind == "InMemoryTableScanExec":
        return shuffled(plan.relation().cachedPlan(), seen)
    if kind == "ReusedExchangeExec":
        return 0
    children = plan.children()
    below = sum(shuffled(children.apply(i), seen) for i in range(children.size()))
    return below + (plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0)


@pytest.mark.parametrize("name", ["q_long_deletions", "q_long_area", "q_long_diagnostics"])
def test_long_reads_are_dealt_once(spark, name):
    spark.catalog.clearCache()
    df = analyses.QUERIES[name](spark, SF_ORACLE)
    assert_same(df, analyses.ORACLE_SQL[name], SF_ORACLE)
    lines, orders = (spark.read.parquet(f"{SF_ORACLE}/{t}.parquet").count() for t in ("lineitem", "orders"))
    # reads meet small tables here, and never each other
    assert shuffled(df._jdf.queryExecution().executedPlan(), {}) <= lines + orders
    spark.catalog.clearCache()
