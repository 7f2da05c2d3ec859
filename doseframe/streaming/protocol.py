"""The episode protocol as a stateful processor, for logs that arrive as a stream.

An episode uses its first ``max_turns`` actions and refuses the rest. So before the
shuffle each task of a batch picks the earliest actions of every episode it reads
(``early_actions``); only those go to the episode's state, in lane 0. All others are
refused without state in lanes of their own, one per task, so an episode of any
length meets in no task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from doseframe.operators.episodes import EXPERIMENT, HYPOTHESIS, NOTHING, OVER

REPLAY_SCHEMA = T.StructType(
    [
        T.StructField("episode", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("accepted", T.BooleanType()),
        T.StructField("reason", T.StringType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("experiments_run", T.IntegerType()),
        T.StructField("done", T.BooleanType()),
        T.StructField("found", T.BooleanType()),
    ]
)

STATE_SCHEMA = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("turns", "phase", "step", "used")]
    + [T.StructField("over", T.BooleanType())]
    + [T.StructField(n, T.LongType()) for n in ("last_us", "last_id")]
)
OUT_OF_ORDER = "out_of_order"
ORDER = ["ts", "event_id"]
STATE_KEY = ["state_of", "lane"]

#: Rows that a task holds back while it picks the earliest of each episode; beyond, those picked so far go on.
HELD_ROWS = 100_000
BEFORE_ALL = -(2**63)


def early_actions(log: DataFrame, max_turns: int) -> DataFrame:
    """Actions with their lane: 0 for the earliest ``max_turns`` of an episode in each task, the task's own for the rest.

    ``state_of`` is the episode in lane 0 and nothing but 0 in others, which take all episodes of their task.
    A task that reads more than ``HELD_ROWS`` such actions hands them on and picks anew,
    so what it holds is bounded.
    """
    schema = T.StructType([*log.schema.fields, T.StructField("state_of", T.LongType()), T.StructField("lane", T.IntegerType())])

    def in_lane(rows: pa.Table, lane: int) -> list[pa.RecordBatch]:
        episode = rows["episode"] if lane == 0 else pa.array([0] * rows.num_rows, pa.int64())
        lanes = pa.array([lane] * rows.num_rows, pa.int32())
        return rows.append_column("state_of", episode).append_column("lane", lanes).combine_chunks().to_batches()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, TaskContext.get().partitionId() + 1
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            keys = held.select(["episode", *ORDER]).to_pandas().sort_values(["episode", *ORDER], kind="stable")
            early = keys.groupby("episode", dropna=False, sort=False).cumcount() < max_turns
            yield from in_lane(held.take(keys.index[~early].to_numpy()), own)
            held = held.take(keys.index[early].to_numpy())
            if held.num_rows > HELD_ROWS:
                yield from in_lane(held, 0)
                held = None
        if held is not None:
            yield from in_lane(held, 0)

    return log.mapInArrow(pick, schema)


class EpisodeProtocol(StatefulProcessor):
    def __init__(self, budget: int, max_turns: int):
        self.budget = budget
        self.max_turns = max_turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("episode_state", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Play the earliest actions that turns are left for; refuse the rest at once.

        At most ``max_turns`` rows are held, however many the batch brings. The key is
        an episode and a lane; lanes other than 0 have no state.
        """
        if key[1]:
            for part in rows:
                yield self._refused(part, OVER, True)
            return
        known = self.state.exists()
        turns, phase, step, used, over, *seen = self.state.get() if known else (0, NOTHING, 0, 0, False, BEFORE_ALL, BEFORE_ALL)
        room = 0 if over else self.max_turns - turns
        held, last = None, tuple(seen)
        for part in rows:
            us, ids = part["ts"].astype("datetime64[us]").astype("int64"), part["event_id"]
            late = (us < seen[0]) | ((us == seen[0]) & (ids < seen[1]))
            if late.any():
                yield self._refused(part[late], OUT_OF_ORDER, over)
                part, us, ids = part[~late], us[~late], ids[~late]
            if part.empty:
                continue
            last = max(last, (int(us.max()), int(ids[us == us.max()].max())))
            held = part if held is None else pd.concat([held, part])
            held = held.sort_values(["ts", "event_id"])
            if len(held) > room:
                yield self._refused(held.iloc[room:], OVER, True)
                held = held.iloc[:room]
        if held is None or held.empty:
            self.state.update((turns, phase, step, used, over, *last))
            return
        outcomes = []
        for e in held.itertuples(index=False):
            was_over = over
            reason = OVER if over else self._objection(e, phase, used)
            if reason is None:
                if e.action == "hypothesis":
                    phase, step = HYPOTHESIS, step + 1
                elif e.action == "experiment":
                    phase, used = EXPERIMENT, used + 1
                    over = used >= self.budget
                elif e.action == "interpretation":
                    phase = NOTHING
                elif e.action == "knowledge":
                    over = bool(e.declares_done)
            shown = (None, None) if was_over else (step, used)
            found = getattr(e, "has_results", None) if reason is None and e.action == "experiment" else None
            outcomes.append((e.episode, e.ts, e.event_id, e.action, reason is None, reason, *shown, over, found))
        self.state.update((turns + len(held), phase, step, used, over, *last))
        yield self._frame(outcomes)

    def close(self) -> None:
        pass

    def _objection(self, e, phase: int, used: int) -> str | None:
        if e.action == "hypothesis" and phase != NOTHING:
            return "hypothesis_pending"
        if e.action == "interpretation" and phase != EXPERIMENT:
            return "no_experiment"
        if e.action != "experiment":
            return None
        if phase == NOTHING:
            return "no_hypothesis"
        if used >= self.budget:
            return "budget_exhausted"
        if e.restricted:
            return "held_out"
        return None if e.known_names else "unknown_name"

    @staticmethod
    def _refused(rows: pd.DataFrame, reason: str, done: bool) -> pd.DataFrame:
        nothing = pd.array([pd.NA] * len(rows), dtype="Int32")
        refused = rows[["episode", "ts", "event_id", "action"]].assign(
            accepted=False, reason=reason, step=nothing, experiments_run=nothing, done=done, found=nothing.astype("boolean")
        )
        return refused[REPLAY_SCHEMA.fieldNames()]

    @staticmethod
    def _frame(outcomes: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(outcomes, columns=REPLAY_SCHEMA.fieldNames())
        return frame.astype({"step": "Int32", "experiments_run": "Int32", "found": "boolean"})
