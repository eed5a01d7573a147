"""Registered queries against their SQL twins on the smallest tables, and plan shape."""

import duckdb
import pytest

import __spark_entry__ as entry
from boutlens.operators import odds as OD
from tools.check import TABLES, rows

SAMPLE = ["score_bouts", "pit_form", "feature_vector", "dedup_first", "upsert_fights", "training_sample", "weights_update", "pair_constraints",
          "champion_challenger", "resolve_id", "name_variants", "odds_match", "fuzzy_topk_lev", "payment_match_day", "ledger_fold", "asof_enrich", "gradient_step"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_twin(spark, sf, con, name):
    assert rows(entry.queries()[name](spark, sf).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).df())


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.catalog.QUERIES) - set(entry.catalog.ORACLES) == {"fit_model", "fuzzy_topk_ratio", "odds_match_ratio"}


@pytest.mark.parametrize("name", ["score_bouts", "odds_match", "name_variants", "payment_match", "dedup_first", "fuzzy_topk_lev"])
def test_no_cross_join(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_containment_needs_five_letters(spark):
    v = spark.createDataFrame([("n", "anna"), ("m", "annabel"), ("k", "longannabelname")], "name string, variant string")
    teams = spark.createDataFrame([("Annabel",), ("Anna Marie",)], "team string")
    got = {(r["name"], r["team"]) for r in OD.match_names(v, teams).collect()}
    assert got == {("m", "Annabel"), ("k", "Annabel")}
