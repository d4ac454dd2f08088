"""Order of states: runs of any length checked against a transition table, no run gathered."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lekhya import fixed_values as fv
from lekhya.operators.scale import scan_in_order, segmented

Transitions = dict[tuple[str, str], str]   # (state, symbol) to the next state
ILLEGAL = "ILLEGAL"


def orchestration() -> Transitions:
    """One pass over the stages of a request: a request that cannot be authenticated fails, and
    the audit ends it as completed or abstained.  A finished session may take its next request."""
    *stages, completed, abstained, failed = fv.AGENT_STATES
    steps = {(a, b): b for a, b in zip(["NEW", *stages], stages)}
    steps[stages[0], failed] = failed
    for end in (completed, abstained):
        steps[stages[-1], end] = end
    for end in (completed, abstained, failed):
        steps[end, stages[0]] = stages[0]
    return steps


class _Table:
    """Transitions over state numbers; the last state is the one no symbol leaves."""

    def __init__(self, transitions: Transitions, start: str) -> None:
        if ILLEGAL in {start, *transitions.values(), *(s for s, _ in transitions)}:
            raise ValueError(f"{ILLEGAL} stands for runs that left the table")
        self.states = sorted({start, *transitions.values(), *(s for s, _ in transitions)})
        number = {s: i for i, s in enumerate(self.states)}
        self.start, self.dead = number[start], len(self.states)
        self.states.append(ILLEGAL)
        self.nowhere = [self.dead] * len(self.states)
        self.steps: dict[str, list[int]] = {}
        for (state, symbol), then in transitions.items():
            self.steps.setdefault(symbol, list(self.nowhere))[number[state]] = number[then]

    def step(self, symbol: str | None) -> list[int]:
        return self.steps.get(symbol, self.nowhere)


def _composed(seg: DataFrame, keys: list[str], order: list[str], symbol: str,
              table: _Table) -> DataFrame:
    """For each segment and key, the state after its rows for every state before them."""
    group = ["_segment", *keys]
    ordered = (seg.repartition(*group).sortWithinPartitions(*group, *order)
               .select(*group, symbol))
    schema = ", ".join(f"`{c}` {seg.schema[c].dataType.simpleString()}" for c in group)

    def run(batches):
        current, reached = None, None
        for pdf in batches:
            done = []
            for *at, sign in pdf[[*group, symbol]].itertuples(index=False, name=None):
                if at != current:
                    if current is not None:
                        done.append((*current, reached))
                    current, reached = at, list(range(len(table.states)))
                step = table.step(sign)
                reached = [step[s] for s in reached]
            yield pd.DataFrame(done, columns=[*group, "_map"])
        if current is not None:
            yield pd.DataFrame([(*current, reached)], columns=[*group, "_map"])

    return ordered.mapInPandas(run, f"{schema}, _map array<int>")


def _entered(maps: DataFrame, keys: list[str], table: _Table) -> DataFrame:
    """The key that a segment takes over from the one before, and the state it is in.

    One row a segment: only the last key of a segment goes on, and it fills all segments between.
    Their maps are composed on the driver, which sees the numbers of one row a segment.
    """
    tails = (maps.groupBy("_segment").agg(F.max_by(F.struct("_map", F.struct(*keys).alias("_key")),
                                                   F.struct(*keys)).alias("_t"))
             .select("_segment", "_t.*"))
    w = Window.orderBy("_segment")    # one row a segment
    before = tails.withColumn("_from", F.lag("_key").over(w)).withColumn(
        "_same", F.col("_from").eqNullSafe(F.col("_key")))
    state, rows = table.start, []
    for r in before.select("_segment", "_same", "_map").orderBy("_segment").collect():
        rows.append((r["_segment"], state))
        state = r["_map"][state if r["_same"] else table.start]
    entered = maps.sparkSession.createDataFrame(rows, "_segment int, _state int")
    return before.select("_segment", "_from").join(F.broadcast(entered), "_segment")


def checked_runs(rows: DataFrame, keys: list[str], order: list[str], symbol: str,
                 transitions: Transitions, start: str,
                 segments: int | None = None) -> DataFrame:
    """Keys and order of each row with the state ``before`` and ``after`` it, and ``legal``.

    A symbol that the state has no transition for, null included, leads to ``ILLEGAL``, which no
    symbol leaves; ``legal`` is false from there on.  ``order`` should be unique in a run, equal
    rows come in any order; rows without a key belong to no run and have nulls.

    Rows are range-partitioned by (keys, order) into segments, however long a run is.  A segment
    composes the transitions of its rows to one map of states; composition is associative, so
    the maps of whole segments give the state each one begins in, and all run at once.
    """
    table = _Table(transitions, start)
    named = [*keys, *order]
    slim = rows.select(*dict.fromkeys([*named, symbol]))
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    seg = segmented(slim.filter(keyed), keys, order, segments)
    entered = _entered(_composed(seg, keys, order, symbol, table), keys, table)
    taken_over = F.col("_from").eqNullSafe(F.struct(*keys))
    ready = seg.join(F.broadcast(entered), "_segment").withColumn(
        "_state", F.when(taken_over, F.col("_state")).otherwise(table.start)).drop("_from")

    def step(state, sign, entry):
        state = int(entry) if state is None else state
        then = table.step(sign)[state]
        return then, table.states[state], table.states[then], then != table.dead

    stepped = scan_in_order(ready, ["_segment", *keys], order, named, [symbol, "_state"],
                            lambda: None, step, "before string, after string, legal boolean")
    none = F.lit(None).cast("string")
    return stepped.unionByName(slim.filter(~keyed).select(
        *named, none.alias("before"), none.alias("after"),
        F.lit(None).cast("boolean").alias("legal")))


def run_audits(rows: DataFrame, keys: list[str], order: list[str], symbol: str,
               transitions: Transitions, start: str) -> DataFrame:
    """One row a run: its steps, the state it ends in, and the first illegal step, if any.

    ``first_illegal`` holds the order's columns of that step and the ``state`` it was tried in.
    """
    runs = checked_runs(rows, keys, order, symbol, transitions, start)
    at = F.struct(*order)
    wrong = F.when(~F.col("legal"), F.struct(*order, F.col("before").alias("state")))
    return runs.filter("legal IS NOT NULL").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("steps"), F.max_by("after", at).alias("final_state"),
        F.min(wrong).alias("first_illegal"))
