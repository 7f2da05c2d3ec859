"""Replay and scoring of logged experiment episodes.

Protocol of an episode, one action per turn:

* a hypothesis is accepted when none is pending, and opens the next step;
* an experiment needs a pending hypothesis, budget left, a treatment outside
  the held-out set and known names; a second one before the interpretation
  replaces the step's experiment and costs budget as well;
* an interpretation needs an experiment in the step and closes it;
* knowledge updates and lookups are always accepted;
* the episode is over when the budget is used, when a knowledge update says
  so, or after ``max_turns`` turns. Later actions are refused.

A log has columns episode, ts, event_id, action, drug, concentration,
cell_line, restricted, known_names, declares_done, score and note. With a column
has_results, an accepted experiment is marked as ``found`` or not: one without
stored results costs budget too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACTIONS = ("hypothesis", "experiment", "interpretation", "knowledge", "lookup")

# What the pending step has so far.
NOTHING, HYPOTHESIS, EXPERIMENT = 0, 1, 2

OVER = "episode_over"

REPLAY_COLUMNS = ["episode", "ts", "event_id", "action", "accepted", "reason", "step", "experiments_run", "done"]


def default_turns(budget: int) -> int:
    return budget * 5


def _fold(actions: Column, budget: int) -> Column:
    """Fold ordered actions into an array of outcomes."""
    outcome = "array<struct<event_id:bigint,accepted:boolean,reason:string,step:int,experiments_run:int,done:boolean>>"
    start = F.struct(
        F.lit(NOTHING).alias("phase"),
        F.lit(0).alias("step"),
        F.lit(0).alias("used"),
        F.lit(False).alias("ended"),
        F.array().cast(outcome).alias("out"),
    )

    def advance(s: Column, e: Column) -> Column:
        hypothesis, experiment = e.action == "hypothesis", e.action == "experiment"
        interpretation = e.action == "interpretation"
        reason = (
            F.when(s.ended, F.lit(OVER))
            .when(hypothesis & (s.phase != NOTHING), F.lit("hypothesis_pending"))
            .when(experiment & (s.phase == NOTHING), F.lit("no_hypothesis"))
            .when(experiment & (s.used >= budget), F.lit("budget_exhausted"))
            .when(experiment & e.restricted, F.lit("held_out"))
            .when(experiment & ~e.known_names, F.lit("unknown_name"))
            .when(interpretation & (s.phase != EXPERIMENT), F.lit("no_experiment"))
        )
        taken = reason.isNull()
        step = s.step + (taken & hypothesis).cast("int")
        used = s.used + (taken & experiment).cast("int")
        phase = (
            F.when(taken & hypothesis, F.lit(HYPOTHESIS))
            .when(taken & experiment, F.lit(EXPERIMENT))
            .when(taken & interpretation, F.lit(NOTHING))
            .otherwise(s.phase)
        )
        over = s.ended | (taken & experiment & (used >= budget)) | (taken & (e.action == "knowledge") & e.declares_done)
        row = F.struct(
            e.event_id.alias("event_id"),
            taken.alias("accepted"),
            reason.alias("reason"),
            F.when(~s.ended, step).alias("step"),
            F.when(~s.ended, used).alias("experiments_run"),
            over.alias("done"),
        )
        return F.struct(
            phase.alias("phase"),
            step.alias("step"),
            used.alias("used"),
            over.alias("ended"),
            F.array_append(s.out, row).alias("out"),
        )

    return F.aggregate(actions, start, advance, lambda s: s.out)


#: What the log says about an action, for ``carry``.
DETAILS = ("drug", "concentration", "cell_line", "score", "note")


def replay_episodes(log: DataFrame, budget: int = 10, max_turns: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Outcome of every logged action, with the columns in ``carry`` of all but those beyond the turn limit.

    Only the first ``max_turns`` actions of an episode are folded: the rank
    filter prunes each task's rows before the shuffle, so an episode brings at
    most that many rows to one task. All later actions are refused by a join
    with the episode's last turn.
    """
    turns = max_turns or default_turns(budget)
    order = Window.partitionBy("episode").orderBy("ts", "event_id")
    told = "has_results" in log.columns
    used = ["ts", "event_id", "action", "restricted", "known_names", "declares_done", *["has_results"] * told, *carry]
    head = log.select("episode", *used).withColumn("_turn", F.row_number().over(order)).where(F.col("_turn") <= turns)
    folded = head.groupBy("episode").agg(
        F.array_sort(F.collect_list(F.struct(*used))).alias("_actions"),
        F.max(F.struct("ts", "event_id")).alias("_last"),
        F.count(F.lit(1)).alias("_turns"),
    )
    outcomes = folded.select("episode", F.explode(F.arrays_zip("_actions", _fold(F.col("_actions"), budget).alias("_out"))).alias("_p"))
    played = outcomes.select(
        "episode", "_p._actions.ts", "_p._actions.event_id", "_p._actions.action", "_p._out.accepted",
        "_p._out.reason", "_p._out.step", "_p._out.experiments_run", "_p._out.done",
        F.when(
            F.col("_p._out.accepted") & (F.col("_p._actions.action") == "experiment"),
            F.col("_p._actions.has_results") if told else F.lit(None).cast("boolean"),
        ).alias("found"),
        *[F.col(f"_p._actions.{c}").alias(c) for c in carry],
    )
    cut = folded.where(F.col("_turns") == turns).select("episode", "_last")
    beyond = (
        log.select("episode", "ts", "event_id", "action")
        .join(cut, "episode")
        .where(F.struct("ts", "event_id") > F.col("_last"))
        .select(
            "episode",
            "ts",
            "event_id",
            "action",
            F.lit(False).alias("accepted"),
            F.lit(OVER).alias("reason"),
            F.lit(None).cast("int").alias("step"),
            F.lit(None).cast("int").alias("experiments_run"),
            F.lit(True).alias("done"),
        )
    )
    return played.unionByName(beyond, allowMissingColumns=True)


def accepted_actions(log: DataFrame, replay: DataFrame) -> DataFrame:
    """Accepted actions with what the log says about them."""
    taken = replay.where("accepted").select("episode", "event_id", "step", "experiments_run")
    return log.join(taken, ["episode", "event_id"])


def step_scores(accepted: DataFrame, hypothesis_weight: float = 0.5, interpretation_weight: float = 0.5) -> DataFrame:
    """Score per closed step: weighted hypothesis and interpretation score.

    A step has one accepted hypothesis and at most one accepted interpretation.
    """
    hypothesis = F.max(F.when(F.col("action") == "hypothesis", F.col("score")))
    interpretation = F.max(F.when(F.col("action") == "interpretation", F.col("score")))
    return (
        accepted.where(F.col("action").isin("hypothesis", "interpretation"))
        .groupBy("episode", "step")
        .agg(hypothesis.alias("hypothesis_score"), interpretation.alias("interpretation_score"))
        .where("interpretation_score IS NOT NULL")
        .withColumn(
            "step_score",
            hypothesis_weight * F.col("hypothesis_score") + interpretation_weight * F.col("interpretation_score"),
        )
    )


def steps(accepted: DataFrame) -> DataFrame:
    """One row per step: hypothesis, last experiment, interpretation and their scores."""

    def only(action: str, value: Column) -> Column:
        return F.max(F.when(F.col("action") == action, value))

    ran = F.when(F.col("action") == "experiment", F.struct("ts", "event_id"))
    return (
        accepted.where(F.col("action").isin("hypothesis", "experiment", "interpretation"))
        .groupBy("episode", "step")
        .agg(
            only("hypothesis", F.col("note")).alias("hypothesis"),
            only("hypothesis", F.col("score")).alias("hypothesis_score"),
            F.max_by(F.struct("drug", "concentration", "cell_line"), ran).alias("experiment"),
            only("interpretation", F.col("note")).alias("interpretation"),
            only("interpretation", F.col("score")).alias("interpretation_score"),
        )
        .withColumn(
            "hypothesis_score", F.when(F.col("interpretation_score").isNotNull(), F.col("hypothesis_score"))
        )
    )


def trajectory(accepted: DataFrame) -> DataFrame:
    """Ordered steps of each episode and its last knowledge note.

    An episode has at most one step per turn, so the list is bounded.
    """
    entry = F.struct(
        "step", "hypothesis", "hypothesis_score", "experiment", "interpretation", "interpretation_score"
    )
    listed = steps(accepted).groupBy("episode").agg(F.array_sort(F.collect_list(entry)).alias("trajectory"))
    updates = F.when(F.col("action") == "knowledge", F.struct("ts", "event_id"))
    knowledge = accepted.groupBy("episode").agg(
        F.max_by("note", updates).alias("learned_knowledge"),
        F.max_by("step", updates).alias("knowledge_version"),
    )
    return knowledge.join(listed, "episode", "left")


def episode_progress(predictions: DataFrame, keys: tuple[str, ...] = ("episode",)) -> DataFrame:
    """Accuracy per checkpoint ``t`` and its gain from the first to the last checkpoint."""
    at = predictions.groupBy(*keys, "t").agg(
        F.avg((F.col("prediction") == F.col("ground_truth")).cast("int")).alias("accuracy")
    )
    whole = at.groupBy(*keys).agg(
        (F.max_by("accuracy", "t") - F.min_by("accuracy", "t")).alias("s_progress")
    )
    return at.join(whole, list(keys))


def episode_score(replay: DataFrame, scores: DataFrame | None = None, progress: DataFrame | None = None, lam: float = 1.0) -> DataFrame:
    """Per episode: process score (mean and sum over steps), progress and their combination.

    Without ``scores`` (``step_scores``) the replay must carry the log's score, and is read once for everything.

    ``s_episode_sum`` adds step scores, ``s_episode`` averages them. The
    reward adds step scores too, but declaring the episode done resets it to 1.
    """
    declared = F.col("accepted") & (F.col("action") == "knowledge") & F.col("done")
    totals = [
        F.coalesce(F.max("step"), F.lit(0)).alias("steps_completed"),
        F.coalesce(F.max("experiments_run"), F.lit(0)).alias("experiments_run"),
    ]
    if scores is None:
        def scored(action: str) -> Column:
            return F.max(F.when(F.col("accepted") & (F.col("action") == action), F.col("score")))

        by_step = replay.groupBy("episode", "step").agg(
            F.max("experiments_run").alias("experiments_run"),
            F.bool_or(declared).alias("declared_done"),
            ((scored("hypothesis") + scored("interpretation")) / 2).alias("step_score"),
        )
        joined = by_step.groupBy("episode").agg(
            *totals, F.bool_or("declared_done").alias("declared_done"), F.avg("step_score").alias("_mean"), F.sum("step_score").alias("_sum")
        )
    else:
        run = replay.groupBy("episode").agg(*totals, F.bool_or(declared).alias("declared_done"))
        process = scores.groupBy("episode").agg(F.avg("step_score").alias("_mean"), F.sum("step_score").alias("_sum"))
        joined = run.join(process, "episode", "left")
    gain = F.lit(0.0)
    if progress is not None:
        joined = joined.join(progress.select("episode", "s_progress").distinct(), "episode", "left")
        gain = F.coalesce("s_progress", F.lit(0.0))
    mean, total = F.coalesce("_mean", F.lit(0.0)), F.coalesce("_sum", F.lit(0.0))
    return joined.select(
        "episode",
        "steps_completed",
        "experiments_run",
        mean.alias("s_process"),
        total.alias("s_process_sum"),
        gain.alias("s_progress"),
        (mean + lam * gain).alias("s_episode"),
        (total + lam * gain).alias("s_episode_sum"),
        F.when(F.col("declared_done"), F.lit(1.0)).otherwise(total).alias("total_reward"),
    )


def evaluation_summary(episodes: DataFrame) -> DataFrame:
    """Means and totals over all episodes; zero when there are none."""

    def mean(col: str) -> Column:
        return F.coalesce(F.avg(col), F.lit(0.0))

    return episodes.agg(
        mean("s_process").alias("mean_s_process"),
        mean("s_progress").alias("mean_s_progress"),
        mean("s_episode").alias("mean_s_episode"),
        F.count(F.lit(1)).alias("total_episodes"),
        F.coalesce(F.sum("experiments_run"), F.lit(0)).cast("bigint").alias("total_experiments"),
    )
