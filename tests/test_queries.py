"""Registry: SQL counterparts agree on the smallest tables, the flagship runs, names match."""
import pytest
from check_oracle import compare, duck

import __spark_entry__ as entrypoint

FAST = ("student_metrics_by_network", "composite_network_rollup", "deduplicated_students", "rate_by_state", "lag_coverage", "ranking_metrics",
        "capacity_curve", "lift_by_decile", "average_rank", "equal_frequency_bins", "score_distribution_shape", "shrinkage_parameters", "goal_state_flags", "semi_anti_coverage")


def test_registry():
    queries, oracle = entrypoint.queries(), entrypoint.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 150


def test_flagship(spark, folder):
    df = entrypoint.entry(spark)
    assert df.count() > 0 and "posicao_por_taxa" in df.columns


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, folder, name):
    got = entrypoint.queries()[name](spark, folder).toPandas()
    assert compare(got, duck(folder).execute(entrypoint.oracle_sql()[name]).df()) == ""


def test_plans_stay_on_the_jvm(spark, folder):
    for name in ("student_metrics_by_network", "gold_analysis_table", "deduplicated_students", "rate_by_state"):
        plan = entrypoint.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name
