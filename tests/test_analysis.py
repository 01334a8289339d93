from __future__ import annotations

import hashlib
import math
import os
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from cohortlens import schema, session
from cohortlens.functions.features import add_features, feature_names, feature_set
from cohortlens.models import ensembles, members
from cohortlens.operators import encoding, metrics, monitoring, profiling, ranking, splitting
from cohortlens.operators.lookup import attach


def scores(spark, pairs):
    return spark.createDataFrame(pairs, "y int, s double")


def test_step_sum_precision_not_trapezoid(spark):
    df = scores(spark, [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)])
    row = metrics.binary_metrics(df, "s", "y").first()
    assert row["roc_auc"] == pytest.approx(0.75) and row["pr_auc"] == pytest.approx(5 / 6)
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (2, 0, 1, 1)


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_auc_with_ties_keys_and_many_slices(spark):
    source = random.Random(1)
    pairs = [(int(source.random() < 0.4), 0.5 if i % 3 == 0 else source.random()) for i in range(600)]
    rows = [(i % 2, y, s) for i, (y, s) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "g int, y int, s double")
    with_slices = {r["g"]: r["roc_auc"] for r in metrics.binary_metrics(df, "s", "y", keys=("g",)).collect()}
    for g in (0, 1):
        assert with_slices[g] == pytest.approx(brute_auc([(y, s) for k, y, s in rows if k == g]))


def test_one_class_and_empty(spark):
    row = metrics.binary_metrics(scores(spark, [(1, 0.2), (1, 0.9)]), "s", "y").first()
    assert row["roc_auc"] is None and row["pr_auc"] is None and row["recall"] == 0.5
    none = metrics.binary_metrics(scores(spark, []), "s", "y").first()
    assert none["rows"] == 0 and none["f1"] == 0.0
    cells = metrics.confusion_matrix(scores(spark, [(1, 0.2), (1, 0.9)]), "s", "y").first()
    assert tuple(cells) == (0, 0, 0, 0)


def loop_screening(pairs, grid, target=0.995):
    best, kept, score = 0.5, -1.0, -1.0
    for t in grid:
        tp = sum(y == 1 and s >= t for y, s in pairs)
        fp = sum(y == 0 and s >= t for y, s in pairs)
        fn = sum(y == 1 and s < t for y, s in pairs)
        precision = tp / (tp + fp) if tp + fp else 0.0
        recall = tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        mix = 0.5 * recall + 0.3 * precision + 0.2 * f1
        if recall >= target:
            if precision > kept:
                best, kept, score = t, precision, mix
        elif mix > score:
            best, score = t, mix
    return best


@pytest.mark.parametrize("seed", range(4))
def test_screening_threshold_equals_sequential_rule(spark, seed):
    source = random.Random(seed)
    pairs = []
    for _ in range(300):
        y = int(source.random() < 0.5)
        pairs.append((y, min(1.0, max(0.0, source.gauss(0.25 + 0.15 * y * (seed + 1), 0.12)))))
    curve = metrics.threshold_curve(scores(spark, pairs), "s", "y", metrics.SCREENING_GRID)
    got = metrics.screening_threshold(curve).first()["threshold"]
    assert got == loop_screening(pairs, metrics.SCREENING_GRID)


def test_nan_scores_are_never_predicted(spark):
    df = scores(spark, [(1, float("nan")), (1, 0.9), (0, 0.1)])
    row = metrics.threshold_curve(df, "s", "y", [0.5]).first()
    assert (row["tp"], row["fn"], row["tn"]) == (1, 1, 1)


def test_no_scores_gives_the_default(spark):
    empty = metrics.threshold_curve(scores(spark, []), "s", "y", metrics.F1_GRID)
    assert metrics.max_f1(empty).first()["threshold"] == 0.5
    # The running rule starts below zero, so its first threshold always counts.
    assert metrics.screening_threshold(empty).first()["threshold"] == loop_screening([], metrics.SCREENING_GRID)


def test_quantiles(spark):
    source = random.Random(2)
    values = [source.choice([1.0, 2.5, source.random() * 9]) for _ in range(501)]
    df = spark.createDataFrame([(v, None, 4.0) for v in values] + [(None, None, 4.0)], "x double, e double, c double")
    rows = {r["feature"]: r for r in ranking.quantiles(df, ["x", "e", "c"], {"a": 0.25, "m": 0.5}).collect()}
    quarters = statistics.quantiles(values, n=4, method="inclusive")
    assert rows["x"]["a"] == pytest.approx(quarters[0]) and rows["x"]["m"] == pytest.approx(quarters[1])
    assert rows["x"]["n"] == 501 and rows["c"]["m"] == 4.0 and "e" not in rows
    assert ranking.medians(df, ["e", "c"]) == {"e": 0.0, "c": 4.0}


def test_no_window_or_exchange_takes_all_rows(spark):
    df = spark.range(1000).selectExpr("id % 2 AS y", "rand(1) AS s")
    ranked = ranking.running_totals(df, "s", {"n": F.count(F.lit(1))}, descending=True)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    alone = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert len(alone) == 1  # the per-slice totals
    below = plan[plan.index("SinglePartition"):]
    assert "keys=[slice" in below


@pytest.mark.parametrize("shares", splitting.SHARES.values())
def test_split_quota(spark, shares):
    df = spark.range(997).selectExpr("id", "int(id % 3 = 0) AS y")
    split = splitting.stratified_split(df, "id", "y", shares)
    assert split.count() == 997 and split.select("id").distinct().count() == 997
    totals = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    for r in split.groupBy("y", "split").count().collect():
        if r["split"] in shares:
            assert abs(r["count"] - shares[r["split"]] * totals[r["y"]]) <= 1
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan


def test_split_works_out_its_input_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(0, 5000, 1, 4).selectExpr("id", "int(id % 7) AS y").mapInArrow(counted, "id bigint, y int")
    assert abs(splitting.stratified_split(df, "id", "y").filter("split = 'test'").count() - 1000) < 7
    assert seen.value <= 2 * 5000


@pytest.mark.parametrize("few", [1, 40, 20_000])
def test_split_equals_the_order_of_hashes(spark, monkeypatch, few):
    """Whatever the depth of the count tree; one class has a third of the rows, one a single row."""
    monkeypatch.setattr(splitting, "FEW", few)
    rows = [(i, 0 if i % 3 == 0 else 1 + i % 4, ) for i in range(4000)] + [(9999, 77)]
    df = spark.createDataFrame(rows, "id bigint, c int").repartition(3)
    got = {r["id"]: (r["c"], r["split"]) for r in splitting.stratified_split(df, "id", "c", {"test": 0.2, "val": 0.3}).collect()}
    for c in {c for _, c in rows}:
        own = sorted((i for i, x in rows if x == c), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        cuts = [math.floor(s * len(own) + 0.5) for s in (0.2, 0.5)]
        want = ["test"] * cuts[0] + ["val"] * (cuts[1] - cuts[0]) + ["train"] * (len(own) - cuts[1])
        assert [got[i] for i in own] == [(c, w) for w in want]


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_folds_are_exact_per_class(spark, k):
    df = spark.range(1009).selectExpr("id", "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 3 = 0 THEN 1 ELSE 0 END AS y")
    folded = splitting.folds(df, "id", "y", k)
    sizes = {}
    for r in splitting.fold_report(folded, "y").collect():
        sizes.setdefault(r["class"], []).append(r["n"])
    assert sum(map(sum, sizes.values())) == df.filter("y IS NOT NULL").count() == folded.select("id").distinct().count()
    assert all(len(n) == k and max(n) - min(n) <= 1 for n in sizes.values())


def test_hash_split_is_a_partition(spark):
    split = splitting.hash_split(spark.range(4000), "id", {"test": 0.2})
    share = split.filter("split = 'test'").count() / 4000
    assert 0.17 < share < 0.23


def test_attach_paths_agree(spark):
    rows = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 0, id % 500) AS k")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("v")).filter("k % 7 <> 1")
    small = attach(rows, table, "k")
    salted = attach(rows, table, "k", broadcast_rows=10, salts=4)
    plain = attach(rows, table, "k", broadcast_rows=10)
    want = sorted(map(str, small.select("id", "k", "v").collect()))
    assert len(want) == 3000
    for other in (salted, plain):
        assert sorted(map(str, other.select("id", "k", "v").collect())) == want


def test_attach_spreads_null_and_unseen_keys(spark):
    """Half of the rows have no key and a quarter one that the table lacks; no join task gets a hot share."""
    rows = spark.range(40_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN NULL WHEN id % 4 = 1 THEN -1 ELSE id % 3000 END AS k")
    table = spark.range(3000).selectExpr("id AS k", "id * 2 AS v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = attach(rows, table, "k", broadcast_rows=10)
        assert joined.count() == 40_000 and joined.filter("v IS NOT NULL").count() == 10_000
        keyed = joined.filter("k IS NOT NULL").groupBy(F.spark_partition_id()).count().collect()
        sizes = [r["count"] for r in keyed]
        assert max(sizes) < 2 * sum(sizes) / len(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_materialized_tables_are_removed(spark):
    kept = session.materialize(spark.range(10).selectExpr("id", "id * 2 AS twice"))
    folder = os.path.dirname(kept.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(folder) and "ReadSchema: struct<twice:bigint>" in kept.select("twice")._jdf.queryExecution().executedPlan().toString()
    assert session.release(spark, kept) == 1 and not os.path.exists(folder)
    assert session.release(spark, kept) == 0


def test_split_takes_many_classes(spark):
    rows = spark.range(6000).selectExpr("id", "id % 2000 AS c")
    counts = splitting.stratified_split(rows, "id", "c", {"test": 0.34}).filter("split = 'test'").groupBy("c").count()
    assert {r["count"] for r in counts.collect()} == {1} and counts.count() == 2000


def test_target_encoding_of_unseen_and_null(spark):
    fit = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), (None, 1)], "c string, y int")
    new = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    got = {r["c"]: r["c_encoded"] for r in encoding.target_encode(new, "c", "y", fit_on=fit).collect()}
    mean = 0.75
    assert got["a"] == pytest.approx((1 + 10 * mean) / 12)
    assert got["z"] == got[None] == pytest.approx(mean)


def test_scaling_of_a_constant(spark):
    df = spark.createDataFrame([(float(i), 3.0) for i in range(1, 6)], "x double, c double")
    rows = encoding.scale_standard(df, ["x", "c"]).collect()
    assert rows[0]["x"] == pytest.approx(-(2**0.5)) and {r["c"] for r in rows} == {0.0}
    assert {r["c"] for r in encoding.scale_robust(df, ["c"]).collect()} == {0.0}


def test_correlation_with_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (2.0, 2.0, 1), (3.0, 2.0, 1)], "x double, c double, y int")
    got = {r["feature"]: r["correlation"] for r in profiling.correlation_row(df, ["x", "c"], "y").collect()}
    assert got["c"] == 0.0 and got["x"] == pytest.approx(0.8660254)


def test_top_values_limit_before_the_exchange(spark):
    df = spark.range(2000).selectExpr("CAST(id % 700 AS STRING) AS a", "'x' AS b")
    got = profiling.categorical_top(df)
    assert got.filter("feature = 'a'").count() == 5 and got.filter("feature = 'b'").first()["n"] == 2000
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_stage_a_has_no_symptom(spark):
    assert not set(schema.STAGE_A_FEATURES) & set(schema.STAGE_A_FORBIDDEN)
    assert set(schema.SYMPTOMS) <= set(schema.STAGE_B_FEATURES)
    with pytest.raises(ValueError, match="symptom_score"):
        encoding.check_features([*schema.STAGE_A_FEATURES, "symptom_score"], "A")
    wide = spark.createDataFrame([], ", ".join(f"{c} double" for c in schema.STAGE_B_FEATURES))
    for name in ("base", "medical", "safe", "quick", "wide"):
        inputs = {i for needs, _ in feature_set(name, "A").values() for i in needs}
        assert not inputs & set(schema.STAGE_A_FORBIDDEN)
        assert set(feature_names(wide, name)) == set(feature_set(name, "B"))


def test_features_need_their_inputs(spark):
    df = spark.createDataFrame([(30, 25.0)], "age int, bmi double")
    out = add_features(df, "base")
    assert out.columns == ["age", "bmi", "bmi_age"] and out.first()["bmi_age"] == 750.0


def test_safe_features_are_in_the_wide_set():
    names = {"map", "pulse_pressure", "bmi_squared", "average_screen_time_x_stress_level",
             "sleep_duration_x_sleep_quality", "symptom_sum"}
    assert names <= set(feature_set("wide"))


def test_drift_of_equal_snapshots_is_zero(spark):
    base = spark.range(500).selectExpr("'base' AS snap", "double(id % 50) AS v")
    same = base.selectExpr("'current' AS snap", "v")
    moved = base.selectExpr("'current' AS snap", "v + 20 AS v")
    assert monitoring.drift(base.union(same), "snap", ["v"]).first()["psi"] == pytest.approx(0.0)
    assert monitoring.drift(base.union(moved), "snap", ["v"]).first()["psi"] > 0.25


def small_training_set(spark, n=400):
    df = spark.range(n).selectExpr(
        "id", "double(id % 17) AS a", "double((id * 7) % 13) AS b", "int((id % 17) + (id * 7) % 13 > 13) AS y"
    )
    return members.assemble(df, ["a", "b"]).select("id", "y", "features")


def test_vote_is_the_mean(spark):
    data = small_training_set(spark)
    models = [members.logistic("y").fit(data), members.forest("y", numTrees=3, maxDepth=3).fit(data)]
    voted = ensembles.soft_vote(models, data)
    one = members.scored(models[1], members.scored(models[0], data, "p0"), "p1")
    both = voted.join(one.select("id", "p0", "p1"), "id")
    assert both.filter("abs(vote - (p0 + p1) / 2) > 1e-12").count() == 0


def test_out_of_fold_scores_every_row_once(spark):
    data = small_training_set(spark)
    oof = ensembles.out_of_fold(data, [members.logistic("y")], "id", "y", k=3)
    assert oof.count() == 400 and oof.select("id").distinct().count() == 400


def test_calibrated_scores_are_probabilities(spark):
    data = small_training_set(spark)
    out = ensembles.fit_calibrated(data, members.forest("y", numTrees=3, maxDepth=3), "id", "y").transform(data)
    assert out.filter("calibrated < 0 OR calibrated > 1").count() == 0 and out.count() == 400


def test_candidates_are_seeded_and_in_range():
    first, again = (ensembles.draw_candidates("B", 5) for _ in range(2))
    assert first == again
    for c in first:
        for name, (low, high) in ensembles.RANGES["B"].items():
            if name in c:
                assert low <= c[name] <= high


def test_search_ranks_like_an_exhaustive_run(spark):
    """Rungs find the winner of the full run, fit losers for fewer folds, and give the same means where all folds were fitted."""
    data = small_training_set(spark)
    learner = members.logistic("y")
    tried = [{"regParam": r, "elasticNetParam": 1.0} for r in (0.0, 0.01, 0.3, 5.0)]
    best, found = ensembles.search(data, learner, tried, "id", "y", k=3)
    _, full = ensembles.search(data, learner, tried, "id", "y", k=3, keep=1.0)
    assert [f for _, f, _ in full] == [3] * 4 and sorted(f for _, f, _ in found) == [1, 1, 2, 3]
    winner = max(full, key=lambda c: c[2])[0]
    assert found[winner][1] == 3 and found[winner][2] == pytest.approx(full[winner][2])
    assert best.getRegParam() == tried[winner]["regParam"]
    assert ensembles.candidates("A", 2)[:3] == ensembles.PRESETS["A"] and len(ensembles.candidates("A", 2)) == 5


def test_library_stays_on_dataframes():
    import pathlib

    text = "\n".join(p.read_text() for p in pathlib.Path("cohortlens").rglob("*.py"))
    assert not re.search(r"crossJoin|localCheckpoint|toPandas|\.rdd\b|pandas_udf|@udf", text)


def test_fits_at_a_time_come_back_in_order(spark):
    data = members.assemble(spark.range(60).selectExpr("int(id % 2) AS y", "double(id % 7) AS a", "double(id % 3) AS b"), ["a", "b"])
    sizes = [3, 1, 2]
    models = members.fitted([(members.forest("y", numTrees=n, maxDepth=2), data) for n in sizes], 2)
    assert [len(m.trees) for m in models] == sizes and members.forest("y").getCacheNodeIds()


def test_shallow_baseline_forest_keeps_no_node_of_each_row(spark):
    data = small_training_set(spark)
    small = {**members.BASELINE_FOREST, "numTrees": 5}
    shallow, cached = (members.forest("y", **{**small, **more}) for more in ({}, {"cacheNodeIds": True}))
    assert not shallow.getCacheNodeIds() and cached.getCacheNodeIds()
    trees = [[t.toDebugString.split("\n", 1)[1] for t in one.fit(data).trees] for one in (shallow, cached)]  # without their uids
    assert trees[0] == trees[1]
