import __spark_entry__ as E
from pairgram.plans import registry

NO_ORACLE = {"edit_distance_char", "gbt_predict", "gbt_regress", "split_importance", "features_wide", "tokens_porter2"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["conv_id", "turn", "family", "jaccard"]
    assert df.count() > 0


def test_every_query_has_an_oracle_or_a_reason():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(registry.QUERIES) - set(o) == NO_ORACLE
