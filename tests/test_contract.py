"""Every registered query beside its SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__ as contract
from assaylake.plans.catalog import QUERIES

ORACLE = contract.oracle_sql()
MODELS = {
    "rf_predict", "gbt_predict", "mlp_predict", "ensemble", "model_eval", "success_eval",
    "model_recommend", "param_importance", "predict_parameters",
}


@pytest.fixture(scope="module")
def con(data):
    return compare.database(data)


def test_every_query_has_sql_but_the_models():
    assert set(QUERIES) - set(ORACLE) == MODELS
    assert set(ORACLE) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, data, name):
    df = contract.queries()[name](spark, data)
    got, expected = compare.spark_rows(df), compare.sql_rows(con, ORACLE[name])
    assert compare.difference(got, expected) == ""
    assert compare.type_difference(df, con, ORACLE[name]) == ""
    assert got[1]


def test_entry(spark, data):
    df = contract.entry(spark)
    assert df.columns == ["seq", "username", "user_id", "ok", "status"]
    assert df.count() == 1000
