"""Filling gaps as of the day before a bout, and the training batch made of filled rows."""

import datetime as dt

from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.operators import records as R
from boutlens.plans import flows, training
from boutlens.sources import tables

DAY = dt.date(2020, 5, 10)
SIDES = "bout_id long, bout_date date, fid long, exp int, dob date, dob_quality int, camp_name string, reach_cm int, height_cm int, wins int"


def test_gaps_are_filled_with_their_origin(spark):
    full = (1, DAY, 7, 5, dt.date(1990, 1, 1), 1, "c", 180, 175, 0)
    rows = spark.createDataFrame([
        full, (2, DAY, 7, None, None, 0, None, 0, None, 0), (3, DAY, 8, 0, None, 1, "c", 180, 175, 3), (4, DAY, 9, 0, None, 1, "c", 180, 175, 3), (2, DAY, 7, None, None, 0, None, 0, None, 0)], SIDES)
    snaps = spark.createDataFrame([
        (7, dt.date(2020, 5, 10), 99, 99), (7, dt.date(2020, 5, 9), 12, 4), (7, dt.date(2020, 5, 9), 11, 4), (7, dt.date(2020, 1, 1), 1, 1), (8, dt.date(2020, 5, 9), None, 6)],
        "fid long, day date, exp int, wins int").withColumns({"reach_cm": F.lit(201), "height_cm": F.lit(190), "camp_name": F.lit("gym"), "dob_quality": F.lit(2), "dob": F.lit("1991-02-03").cast("date")})
    got = sorted(R.impute_rows(rows, R.from_snapshots(snaps)).collect())
    assert tuple(got[0])[:10] == full and got[0].filled == [] and got[0].filled_as_of is None
    assert got[1] == got[2] and tuple(got[1])[3:10] == (12, dt.date(1991, 2, 3), 2, "gym", 201, 190, 4)
    assert got[1].filled == [*K.IMPUTE_KEYS, "wins"] and got[1].filled_as_of == dt.date(2020, 5, 9)
    assert got[3].exp == 0 and got[3].filled == ["dob"] and got[4].dob is None and got[4].filled == []


def test_any_source_can_stand_in(spark):
    rows = spark.createDataFrame([(1, DAY, 7, 0, None, 1, "c", 180, 175, 0)], SIDES)
    asked = []

    def source(ask):
        asked.append(ask)
        return ask.withColumn("exp", F.lit(3))

    got = R.impute_rows(rows, source).first()
    assert got.exp == 3 and got.filled == ["exp"] and got.filled_as_of is None and asked[0].columns == ["fid", "bout_date"]
    assert R.impute_rows(rows.limit(0), source).count() == 0


def test_a_batch_takes_features_from_filled_rows(spark, sf):
    feats = flows.bout_features(spark, sf)
    plain = {r.bout_id: r for r in training.training_batch(feats, feats.limit(0), 20).collect()}
    enrich = R.from_snapshots(tables.profiles(spark, sf))
    rows = training.training_batch(feats, feats.limit(0), 20, enrich=enrich).collect()
    assert {r.bout_id for r in rows} == set(plain)
    changed = 0
    for r in rows:
        before = plain[r.bout_id]
        for s in "ab":
            now, then = r[f"stats_{s}"], before[f"stats_{s}"]
            for k in K.IMPUTE_KEYS:
                assert now[k] == then[k] if k not in now.filled else then[k] in (None, 0)
            assert r[f"{s}_exp"] == float(now.exp) and r[f"{s}_reach_cm"] == now.reach_cm / 200
            if "dob_quality" in now.filled and now.dob_quality > 0:
                assert r[f"{s}_mystic_factor"] == float(now.mystic_factor) and before[f"{s}_mystic_factor"] == 0.5
                changed += 1
        assert (r.label, r.sample_weight) == (before.label, before.sample_weight)
    assert changed > 3
