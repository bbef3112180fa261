import pytest

from millrace.operators import clean
from millrace.plans import catalog
from millrace.plans.model import CleanRules, Mapping, Template, TemplateColumn


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_against_sql(name, same, spark, sf_dir):
    sql = catalog.oracle_sql().get(name)
    if sql:
        same(catalog.queries()[name], sql)
    else:
        assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1500
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    """Cleaning keeps a filter on a source column and the narrow set of columns within the scan."""
    own = clean.apply_rules(spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 0"), Template((TemplateColumn("n"),)), [Mapping("n", "c_name", "exact", 100.0)], CleanRules(normalize_unicode=False), row_idx="c_custkey")
    plan = own.select("row_idx", "n")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,0.0)]" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_acctbal:double>" in plan
    assert "Exchange" not in plan and "Python" not in plan
