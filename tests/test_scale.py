"""Steps that have to stay bounded however large the log: partitions, copies of the bootstrap, joined tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from throughline import session
from throughline.llm import frames, pieces
from throughline.llm.queries import PIECE_BPE
from throughline.operators import falsify, history, metrics, models, ope, policy, predictability, views
from throughline.plans import model_queries, study
from throughline.plans.common import HELD_OUT, STUDY, TRAIN, table
from throughline.sources.adapter import pitch_log

ROWS = "count_state string, family string, outcome string, reward double, pitcher long, game_pk long"


def test_partitions_follow_from_the_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 1000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        per = pitch_log(spark, sf).groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("game_pk").alias("g"), F.count("*").alias("n")).collect()
        games = pitch_log(spark, sf).select("game_pk").distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(per) > 1 and sum(r.g for r in per) == games and sum(r.n for r in per) == 6000


def test_written_rows_are_not_moved_by_season(spark, sf, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(study, "_built", {})
    monkeypatch.setattr(study, "stage", lambda df, name, *by, **kw: made.append((name, kw)) or session.stage(df, name, *by, **kw))
    rows = study.study_rows(spark, sf)
    assert ("decisions", {"moved": False}) in made
    mix = history.feasible_mask(history.repertoire_mix(table(spark, sf), STUDY.window_days), STUDY.min_count, STUDY.min_share)
    want = table(spark, sf).join(mix, ["pitcher", "game_date"], "left").select("row_id", "hist_n", "feasible")
    got = rows.select("row_id", "hist_n", "feasible")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_across_games_readies_every_table(spark, sf):
    seen = []
    decisions = table(spark, sf)
    views.across_games(views.in_game(decisions), decisions, STUDY, side=lambda t: seen.append(t) or t)
    assert len(seen) == 6


def test_bootstrap_draws_once_per_cluster(spark):
    rows = spark.createDataFrame([(c, p, g, float(p + g)) for p in range(3) for g in range(4) for c in ("0-0", "1-1", None)] + [("0-0", None, 1, 2.0)],
                                 "c string, pitcher long, game_pk long, x double")
    got = metrics.bootstrap(rows, ["pitcher", "game_pk"], {"n": F.lit(1.0), "s": F.col("x")}, ["c"], 6, 7)
    assert "_four" in got._jdf.queryExecution().analyzed().toString()
    found = {(r.c, r.replicate): (r.n, r.s) for r in got.collect()}
    assert {k[1] for k in found} == set(range(7)) and len(found) == 21
    assert found[(None, 0)] == (12.0, sum(float(p + g) for p in range(3) for g in range(4))) and found[("0-0", 0)][0] == 13.0
    assert all(found[("1-1", i)] == found[(None, i)] for i in range(7))
    alone = metrics.bootstrap(rows, ["pitcher", "game_pk"], {"n": F.lit(1.0)}, ["pitcher"], 6, 7)
    assert alone.count() == 28


def test_arm_replicates_are_those_of_all_sums(spark):
    rows = spark.createDataFrame(
        [(s, f, o, r, p, g) for i, (s, f, o, r) in enumerate([("0-0", "FF", "ball", 0.5), ("0-0", "SL", "whiff", -0.25), ("0-0", "FF", "ball", None),
                                                           ("1-0", "CH", "foul", 1.0), ("1-0", "CH", "other", 1.0), ("2-0", "FF", "other", 3.0)])
         for p in (1, 2, None) for g in range(2 + i % 2)], ROWS)
    cluster, state = ["pitcher", "game_pk"], ["count_state"]
    want = metrics.bootstrap(rows, cluster, predictability._arm_sums(predictability.PITCH), state, 9, 3).filter("replicate > 0")
    got = predictability.arm_replicates(rows, cluster, state, 9, 3)
    assert {tuple(sorted(r.asDict().items())) for r in got.collect()} == {tuple(sorted(r.asDict().items())) for r in want.collect()}


def test_pieces_work_in_thin_slices(spark, monkeypatch):
    limits = []
    monkeypatch.setattr(pieces, "append", lambda df, new, start, keep=None, limit=frames.SLICE: limits.append(limit) or df)
    docs = spark.createDataFrame([(1, "a b", b"")], "doc_id long, text string, ids binary")
    pieces.encode(docs, PIECE_BPE, packed=True)
    pieces.decode(docs, PIECE_BPE)
    assert limits == [frames.THIN, frames.THIN]


def test_fits_of_the_same_rows_share_one_written_array(spark, sf, monkeypatch):
    """No fit assembles its features anew or keeps rows that the learner keeps as well; the forecasts are those of single columns."""
    rows, shared = model_queries.model_rows(spark, sf), model_queries.value_rows(spark, sf)
    how = ("O", "logistic", 3, views.MECHANISMS["type"])
    want = {r.row_id: r.action_probs for r in models.fit_behavior(rows.filter(TRAIN), *how).predict(rows.filter(HELD_OUT)).collect()}

    def never(*args, **kw):
        raise AssertionError("assembled or kept anew")

    monkeypatch.setattr(models, "VectorAssembler", never)
    monkeypatch.setattr(type(rows), "persist", never)
    got = models.fit_behavior(shared.filter(TRAIN), *how).predict(shared.filter(HELD_OUT)).collect()
    assert len(got) == len(want) and want
    assert all(abs(p - q) < 1e-6 for r in got for p, q in zip(r.action_probs, want[r.row_id], strict=True))
    assert {r.dropped for r in model_queries.mechanism_refit(spark, sf).collect()} == set(views.MECHANISMS)


def test_rounds_are_summed_in_generated_code(spark):
    """Rows times rounds go through no lambda, which would be interpreted, but for strata with a null: those add nothing to a sum, as before."""
    rows = spark.sql("SELECT id AS row_id, id % 3 AS k, 2 AS pitch_number, CAST(id AS DOUBLE) AS x, IF(id = 5, NULL, CAST(id * id AS DOUBLE)) AS y FROM range(10)")
    sums = falsify.shifted_sums(rows, ["x"], ["y"], {"s": lambda own, donor: own["x"] * donor["y"]}, 4, 9, ["k"])
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    counted = plan[plan.index("Union"):].split("Aggregate", 1)[1].split("Generate", 1)[0]
    assert "x" in counted and "lambda" not in counted
    got = {r["round"]: r for r in sums.collect()}
    assert set(got) == set(range(5)) and all(r.n == 10 for r in got.values())
    assert got[0].s == sum(float(i) ** 3 for i in range(10) if i % 3 != 5 % 3)


def test_rows_move_once_to_their_donor(spark, monkeypatch):
    """Only the ends of the buckets of a large stratum are moved twice; donors are the same, nulls in the strata included."""
    rows = spark.sql("SELECT id AS row_id, IF(id % 4 = 0, NULL, id % 4) AS k, 2 AS pitch_number, CAST(id AS STRING) AS t FROM range(400)")

    def donors(limit):
        monkeypatch.setattr(falsify, "LARGE", limit)
        p = falsify.permute_history(rows, ["t"], 5, 1, ["k"])
        plan = p._jdf.queryExecution().executedPlan().toString()
        assert "_large" not in p.columns and "_next" not in p.columns
        return plan, {r.row_id: (r.donor_id, r.donor_t) for r in p.collect()}

    plans, found = zip(*[donors(n) for n in (1000, 99, 10)], strict=True)
    assert plans[0].count("Exchange hashpartitioning") == 1 and plans[2].count("Exchange hashpartitioning") > 1
    assert found[0] == found[1] == found[2] and len(found[0]) == 400
    for k in range(4):
        hashed = sorted((hashlib.md5(f"5|{i}".encode()).hexdigest(), i) for i in range(k, 400, 4))
        assert all(found[0][i] == (j, str(j)) for (_, i), (_, j) in zip(hashed, hashed[1:] + hashed[:1], strict=True))


def test_mixtures_move_a_decision_once(spark):
    """All mixtures come from one exchange of uncopied rows and equal the estimates of rows copied for each; a missing model stays missing."""
    flat = [0.125] * 8
    rows = spark.createDataFrame(
        [(p, i // 3, i % 3 + 1, a, r, None if i == 4 else flat, [0.0] * 7 + [1.0] if i % 2 else [0.5, 0.5] + [0.0] * 6, [0.1 * j * i for j in range(8)])
         for p in ("x", "y") for i, (a, r) in enumerate([("FF", 0.5), ("XX", None), ("SI", -1.0), ("XX", 0.25), ("FF", 1.0), ("FF", 0.75), ("XX", None)])],
        "policy string, pa_id long, pitch_number int, family string, reward double, mu array<double>, target array<double>, q array<double>")
    got = ope.mixture_episodes(rows, (0.0, 0.25, 1.0), policy.mix_policy, ["policy"], 3.0)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(policy, pa_id") <= 1
    copies = rows.withColumn("alpha", F.explode(F.array(F.lit(0.0), F.lit(0.25), F.lit(1.0)))).withColumn(
        "pi", policy.mix_policy(F.col("mu"), F.col("target"), F.col("alpha")))
    by, copies = ["policy", "alpha"], ope.logged(copies, 3.0)
    want = ope.myopic_vs_full(ope.episode_estimates(copies, by), ope.stepwise_dr(copies, by), by)
    found = {(r.policy, r.alpha): r for r in got.collect()}
    for r in want.collect():
        assert all(abs(r[x] - found[r.policy, r.alpha][x]) < 1e-12 for x in ("observed", "dm", "dr", "n_episodes", "stepwise_dr"))
    assert len(found) == 6
