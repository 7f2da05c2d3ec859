import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doseframe.operators import episodes as P
from doseframe.operators.episodes import default_turns
from doseframe.streaming import jobs

LOG = (
    "episode long, ts timestamp, event_id long, action string, drug string, concentration double, cell_line string, "
    "restricted boolean, known_names boolean, declares_done boolean, score double, note string"
)
START = dt.datetime(2024, 1, 1)
SHORT = {"h": "hypothesis", "x": "experiment", "i": "interpretation", "k": "knowledge", "l": "lookup", "R": "experiment", "U": "experiment", "D": "knowledge"}


def rows(episode, letters, first=0):
    """R is a held-out experiment, U one with unknown names, D a knowledge update that ends the episode."""
    return [
        (episode, START + dt.timedelta(seconds=first + n), first + n, SHORT[c], f"d{n}", 5.0, "c", c == "R", c != "U", c == "D", n / 10, f"n{n}")
        for n, c in enumerate(letters)
    ]


def play(spark, letters, **kw):
    out = P.replay_episodes(spark.createDataFrame(rows(1, letters), LOG), **kw).orderBy("event_id").collect()
    return [r.reason or ("done" if r.done else "ok") for r in out], out


def test_order_of_actions(spark):
    reasons, out = play(spark, "xihhixxikl")
    assert reasons == ["no_hypothesis", "no_experiment", "ok", "hypothesis_pending", "no_experiment", "ok", "ok", "ok", "ok", "ok"]
    assert [r.step for r in out] == [0, 0, 1, 1, 1, 1, 1, 1, 1, 1]
    # A second experiment before the interpretation costs budget too.
    assert out[-1].experiments_run == 2


def test_budget_ends_the_episode(spark):
    reasons, out = play(spark, "hxihx", budget=1)
    assert reasons == ["ok", "done", "episode_over", "episode_over", "episode_over"]
    assert out[2].step is None and out[1].experiments_run == 1


def test_refused_experiments_cost_nothing(spark):
    reasons, out = play(spark, "hRUx", budget=1)
    assert reasons == ["ok", "held_out", "unknown_name", "done"]
    assert [r.experiments_run for r in out] == [0, 0, 0, 1]


def test_declared_end(spark):
    assert play(spark, "kDh")[0] == ["ok", "done", "episode_over"]


def test_turn_limit(spark):
    reasons, _ = play(spark, "llllhh", budget=10, max_turns=5)
    assert reasons == ["ok"] * 5 + ["episode_over"]
    assert P.default_turns(10) == 50


def test_scores_and_reward(spark):
    log = spark.createDataFrame(rows(1, "hxihxik") + rows(2, "hxiD") + rows(3, "ll"), LOG)
    replay = P.replay_episodes(log)
    accepted = P.accepted_actions(log, replay)
    scores = P.step_scores(accepted)
    got = {(r.episode, r.step): round(r.step_score, 6) for r in scores.collect()}
    assert got == {(1, 1): 0.1, (1, 2): 0.4, (2, 1): 0.1}
    by = {r.episode: r for r in P.episode_score(replay, scores).collect()}
    assert by[1].s_process == pytest.approx(0.25) and by[1].s_process_sum == pytest.approx(0.5)
    assert by[1].total_reward == pytest.approx(0.5) and by[2].total_reward == 1.0
    assert (by[3].s_process, by[3].experiments_run, by[3].steps_completed) == (0.0, 0, 0)
    paths = {r.episode: r for r in P.trajectory(accepted).collect()}
    assert [s.step for s in paths[1].trajectory] == [1, 2]
    assert paths[1].trajectory[1].experiment.drug == "d4" and paths[1].learned_knowledge == "n6"
    assert paths[3].trajectory is None


def test_last_experiment_of_a_step_counts_and_open_steps_have_no_score(spark):
    log = spark.createDataFrame(rows(1, "hxx"), LOG)
    step = P.steps(P.accepted_actions(log, P.replay_episodes(log))).first()
    assert step.experiment.drug == "d2" and step.interpretation is None and step.hypothesis_score is None


def test_worked_progress_example(spark):
    correct = {0: 4, 1: 5, 2: 5, 3: 6, 4: 8}
    data = [(1, t, i < n, True) for t, n in correct.items() for i in range(8)]
    progress = P.episode_progress(spark.createDataFrame(data, "episode int, t int, prediction boolean, ground_truth boolean"))
    assert {r.t: r.accuracy for r in progress.collect()} == {0: 0.5, 1: 0.625, 2: 0.625, 3: 0.75, 4: 1.0}
    assert {r.s_progress for r in progress.collect()} == {0.5}


def test_evaluation_summary(spark):
    episodes = spark.createDataFrame([(0.6, 0.0, 0.6, 2), (0.8, 0.0, 0.8, 4)], "s_process double, s_progress double, s_episode double, experiments_run int")
    row = P.evaluation_summary(episodes).first()
    assert row.mean_s_process == pytest.approx(0.7) and row.mean_s_episode == pytest.approx(0.7)
    assert (row.total_episodes, row.total_experiments) == (2, 6)
    assert tuple(P.evaluation_summary(episodes.limit(0)).first()) == (0.0, 0.0, 0.0, 0, 0)


def skewed(spark):
    """One episode holds most of the log, far beyond its turn limit."""
    import random

    rng = random.Random(5)
    data = rows(1, "".join(rng.choice("hxikl") for _ in range(3000)))
    for e in range(2, 30):
        data += rows(e, "".join(rng.choice("hhxxiiklRUD") for _ in range(40)), first=10_000 * e)
    return spark.createDataFrame(data, LOG)


def outcome(df):
    return sorted(tuple(r) for r in df.fillna({"reason": "", "step": -1, "experiments_run": -1}).select(*P.REPLAY_COLUMNS).collect())


def test_every_action_has_one_outcome(spark):
    log = skewed(spark)
    assert P.replay_episodes(log, 3).select("event_id").distinct().count() == P.replay_episodes(log, 3).count() == log.count()


def test_long_episodes_are_cut_before_the_shuffle(spark):
    plan = P.replay_episodes(skewed(spark), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_stream_in_pieces_equals_batch(spark, tmp_path):
    log = skewed(spark).cache()
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    stream = lambda: spark.readStream.schema(LOG).parquet(source)
    # Each arrival brings every episode's next actions.
    part = F.when(F.col("event_id") % 10000 < 15, 0).when(F.col("event_id") % 10000 < 20, 1).otherwise(2)
    for n in range(3):
        log.where(part == n).repartition(3).write.mode("append").parquet(source)
        jobs.stream_replay(stream(), out, checkpoint, 3)
    assert outcome(spark.read.parquet(out)) == outcome(P.replay_episodes(log, 3))


def test_a_hot_episode_meets_in_no_task(spark, tmp_path):
    """100,000 actions of one episode: each task hands its state the earliest few, and the outcome stays that of the batch."""
    import random

    from doseframe.streaming.protocol import early_actions

    rng = random.Random(6)
    hot = spark.range(100_000).selectExpr("1L episode", "id event_id")
    # The rows of ``rows`` for a long episode, made by Spark.
    kinds = spark.createDataFrame(rows(1, "hxikl"), LOG).drop("episode", "event_id", "ts").withColumn("k", F.monotonically_increasing_id())
    few = spark.createDataFrame(rows(2, "".join(rng.choice("hxikl") for _ in range(50)), first=200_000), LOG)
    ordered = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("event_id"))
    kinds = kinds.withColumn("k", F.row_number().over(Window.orderBy("k")) - 1)
    log = hot.withColumn("k", F.pmod(F.xxhash64("event_id"), F.lit(5)).cast("int")).join(kinds, "k").withColumn("ts", ordered).select(*few.columns)
    log = log.unionByName(few).repartition(6).cache()
    turns = default_turns(3)
    lanes = early_actions(log, turns)
    assert lanes.count() == log.count() and lanes.where("lane = 0 AND episode = 1").count() <= turns * 6
    assert lanes.groupBy("episode", "lane").count().where("lane > 0").agg(F.max("count")).first()[0] < 20_000
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    log.write.parquet(source)
    jobs.stream_replay(spark.readStream.schema(log.schema).parquet(source), out, str(tmp_path / "checkpoint"), 3)
    got, want = spark.read.parquet(out).select(*P.REPLAY_COLUMNS), P.replay_episodes(log, 3).select(*P.REPLAY_COLUMNS)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_held_rows_are_bounded(spark, monkeypatch):
    """Handing on early changes who refuses, not what is kept at least."""
    from doseframe.streaming import protocol

    monkeypatch.setattr(protocol, "HELD_ROWS", 10)
    lanes = protocol.early_actions(skewed(spark).coalesce(1), 5)
    first = skewed(spark).withColumn("n", F.row_number().over(Window.partitionBy("episode").orderBy("ts", "event_id"))).where("n <= 5")
    assert first.select("event_id").join(lanes.where("lane = 0"), "event_id").count() == first.count()


def test_late_actions_are_named_and_cost_no_turn(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    data = rows(1, "hxihxi")
    for part in ([0, 1, 4], [2, 3, 5]):
        spark.createDataFrame([data[i] for i in part], LOG).write.mode("append").parquet(source)
        jobs.stream_replay(spark.readStream.schema(LOG).parquet(source), out, checkpoint, 5)
    got = {r.event_id: (r.accepted, r.reason) for r in spark.read.parquet(out).collect()}
    assert got == {0: (True, None), 1: (True, None), 4: (True, None), 2: (False, "out_of_order"), 3: (False, "out_of_order"), 5: (True, None)}


def test_experiments_without_results_are_marked(spark, tmp_path):
    log = spark.createDataFrame(rows(1, "hxxi"), LOG).withColumn("has_results", F.col("event_id") == 1)
    want = {0: None, 1: True, 2: False, 3: None}
    assert {r.event_id: r.found for r in P.replay_episodes(log, 5).collect()} == want
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    log.write.parquet(source)
    jobs.stream_replay(spark.readStream.schema(log.schema).parquet(source), out, str(tmp_path / "checkpoint"), 5)
    assert {r.event_id: r.found for r in spark.read.parquet(out).collect()} == want
    assert P.replay_episodes(log.drop("has_results"), 5).where("found IS NOT NULL").count() == 0


def test_one_pass_gives_the_same_scores(spark):
    log = skewed(spark)
    replay = P.replay_episodes(log, 3, carry=P.DETAILS)
    apart = P.episode_score(replay, P.step_scores(P.accepted_actions(log, replay)))
    order = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.collect())
    assert order(P.episode_score(replay)) == order(apart)
