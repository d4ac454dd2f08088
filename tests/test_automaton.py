"""Checked runs against a plain walk, one run over many segments included."""

import random

import pytest

from lekhya.operators import automaton

STEPS = {("even", "flip"): "odd", ("odd", "flip"): "even", ("even", "stay"): "even",
         ("odd", "stay"): "odd", ("odd", "stop"): "end"}


def plain(rows, steps, start):
    state, out = {}, []
    for key, at, sign in sorted(rows, key=lambda r: (r[0], r[1])):
        before = state.get(key, start)
        after = steps.get((before, sign), automaton.ILLEGAL)
        state[key] = after
        out.append((key, at, before, after, after != automaton.ILLEGAL))
    return out


@pytest.mark.parametrize("stops", [0.0, 0.01])
def test_one_run_holds_most_rows(spark, stops):
    rng = random.Random(3)
    rows = [(5 if i < 700 else rng.randrange(10), i,
             "stop" if rng.random() < stops else rng.choice(["flip", "stay"])) for i in range(900)]
    df = spark.createDataFrame(rows, "run int, at int, sign string").repartition(3)
    got = automaton.checked_runs(df, ["run"], ["at"], "sign", STEPS, "even", segments=12)
    assert sorted(map(tuple, got.collect())) == plain(rows, STEPS, "even")


def test_audits_name_the_first_illegal_step(spark):
    stages = ["AUTHENTICATE", "CLASSIFY_REQUEST", "RETRIEVE", "EVIDENCE_CURRENCY_CHECKS",
              "GENERATE_OR_ABSTAIN", "VALIDATE_CITATIONS", "AUDIT"]
    runs = {1: [*stages, "COMPLETED"], 2: [*stages[:3], "RETRIEVE", "AUDIT"], 3: stages[:1] + ["FAILED"],
            4: stages[1:2], 5: [stages[0], None], 6: [*stages, "ABSTAINED", *stages[:2]]}
    rows = [(r, i, s) for r, signs in runs.items() for i, s in enumerate(signs)] + [(None, 0, "AUDIT")]
    df = spark.createDataFrame(rows, "run int, at int, sign string")
    got = {r["run"]: (r["steps"], r["final_state"], r["first_illegal"] and tuple(r["first_illegal"]))
           for r in automaton.run_audits(df, ["run"], ["at"], "sign", automaton.orchestration(), "NEW").collect()}
    assert got == {1: (8, "COMPLETED", None), 2: (5, "ILLEGAL", (3, "RETRIEVE")), 3: (2, "FAILED", None),
                   4: (1, "ILLEGAL", (0, "NEW")), 5: (2, "ILLEGAL", (1, "AUTHENTICATE")),
                   6: (10, "CLASSIFY_REQUEST", None)}
    every = automaton.checked_runs(df, ["run"], ["at"], "sign", automaton.orchestration(), "NEW")
    assert every.count() == len(rows) and every.filter("legal IS NULL").count() == 1
    assert automaton.run_audits(df.limit(0), ["run"], ["at"], "sign", STEPS, "even").count() == 0
