"""What is stored and shuffled is what does not follow from other columns."""

from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.plans import flows, training
from boutlens.session import forget


def test_history_is_stored_without_what_follows_from_it(spark, sf):
    forget()
    past, feats = flows.bout_past(spark, sf), flows.bout_features(spark, sf)
    assert set(past.columns) == {"bout_id", "bout_date", "priority", "stats_a", "stats_b"}
    assert past.schema["stats_a"].dataType.names == flows.PAST
    assert set(feats.inputFiles()) - {f for f in feats.inputFiles() if "supplier" in f} == set(past.inputFiles())
    # no exchange but the one that makes names unique before they are broadcast
    plan = feats.select("bout_id", *K.FEATURE_NAMES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(fid") == plan.count("Exchange hashpartitioning") and feats.count() == past.count()


def test_batch_takes_whole_rows_after_the_draw(spark):
    rows = [(i % 40, f"2020-01-{1 + i % 28:02d}", f"k{i % 40}", "1-URGENT", i % 2) for i in range(400)]
    feats = spark.createDataFrame(rows, "bout_id long, day string, fight_key string, priority string, a int").select("*", F.to_date("day").alias("bout_date"))
    drawn = spark.createDataFrame([(3, "2020-01-04", "new", 1, 1)] * 2 + [(3, "2020-01-04", "new", 2, 1), (5, "2020-01-06", "historical", None, 0)], "bout_id long, day string, stratum string, from_end int, is_fresh int")
    got = training.rows_of(drawn.select("bout_id", F.to_date("day").alias("bout_date"), "stratum", "from_end", "is_fresh"), feats).collect()
    assert sorted((r.bout_id, r.fight_key, r.stratum, r.from_end or 0, r.is_fresh) for r in got) == [(3, "k3", "new", 1, 1), (3, "k3", "new", 1, 1), (3, "k3", "new", 2, 1), (5, "k5", "historical", 0, 0)]
