"""The fold of an operation log against plain Python objects, conformance cases by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wakeline.operators import oplog

SCHEMA = "key string, at long, op string, content string, refs array<string>, within boolean"


def plain(log):
    """One key's log, operation by operation, by four stores with a state each."""
    out = []
    there, successes, first, revision, strict = False, 0, None, 0, 0
    for n, (op, content, _, within) in enumerate(log, 1):
        if op == "success" or op == "update":
            mutable, there = "changed" if there else "stored", True
        elif op == "delete":
            mutable, there = "removed" if there else "ignored", False
        else:
            mutable = "lost" if op == "failure" else "changed" if op == "late" and there else "ignored"
        revision += op == "late" and successes > 0
        appends = {"success": "appended", "failure": "lost", "update": "rejected", "delete": "rejected"}.get(op, "ignored")
        plainly = "replaced" if op == "late" and successes else appends
        silent = "successor" if op == "late" and successes else appends
        if op in ("success", "failure"):
            last = "stored" if first is None else "idempotent" if first == (op, content) else "rejected"
            first = first or (op, content)
        elif op == "late":
            last = "rejected" if first is None or first[0] == "failure" else "successor" if within else "late_record"
            strict += last == "successor"
        else:
            last = "rejected" if op in ("update", "delete") else "ignored"
        successes += op == "success"
        out += [(n, "mutable", mutable, 0), (n, "noncanonical", plainly, revision), (n, "silent", silent, revision), (n, "append_only", last, strict)]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_objects(spark, seed):
    rnd = random.Random(seed)
    logs = {k: [] for k in ["hot", "a", "b", None, ""]}
    for _ in range(400):
        k = rnd.choice(["hot"] * 5 + ["a", "b", None, ""])
        op = rnd.choice(["success", "failure", "late", "late", "update", "delete", "other", None])
        logs[k].append((op, rnd.choice(["x", "y", None]), rnd.choice([["r", "s"], ["r"], [], None]), rnd.choice([True, False, None])))
    rows = [(k, at, *o) for k, log in logs.items() for at, o in enumerate(log)]
    rnd.shuffle(rows)
    got = oplog.fold_log(spark.createDataFrame(rows, SCHEMA), ["key"], ["at"], F.floor(F.col("at") / 20)).collect()
    want = {(k, *r) for k, log in logs.items() for r in plain(log)}
    assert len(got) == 4 * len(rows) and {(r["key"], r["n"], r["variant"], r["outcome"], r["revision"]) for r in got} == want
    for r in got:
        assert (r["record_digest"] is None) == (r["outcome"] not in {*oplog.LEAVES, "changed", "replaced"})
        two = len(logs[r["key"]][r["n"] - 1][2] or []) == 2
        assert r["replays"] is None or r["replays"] == (r["variant"] != "noncanonical" or not two)


def outcomes(spark, *ops, variant="append_only"):
    rows = [("k", i, op, content, ["b", "a"], within) for i, (op, content, within) in enumerate(ops)]
    got = oplog.fold_log(spark.createDataFrame(rows, SCHEMA), ["key"], ["at"], F.col("at")).filter(F.col("variant") == variant)
    return [r["outcome"] for r in got.orderBy("n").collect()], got


def test_conformance_by_hand(spark):
    """A failure bars a later success; the same success again is idempotent; update and delete never act; evidence beyond the horizon is a record."""
    assert outcomes(spark, ("failure", "f", None), ("success", "s", None), ("late", "e", True))[0] == ["stored", "rejected", "rejected"]
    assert outcomes(spark, ("success", "s", None), ("success", "s", None), ("success", "t", None), ("failure", "f", None))[0] == ["stored", "idempotent", "rejected", "rejected"]
    assert outcomes(spark, ("success", "s", None), ("update", "t", None), ("delete", None, None))[0] == ["stored", "rejected", "rejected"]
    done, rows = outcomes(spark, ("late", "e", True), ("success", "s", None), ("late", "e", True), ("late", "e", False), ("late", "g", True))
    assert done == ["rejected", "stored", "successor", "late_record", "successor"] and [r["revision"] for r in rows.orderBy("n").collect()] == [0, 0, 1, 1, 2]


def test_properties(spark):
    ops = [("success", "s", None), ("late", "e", True), ("failure", "f", None), ("update", "t", None), ("delete", None, None)]
    rows = [("k", i, op, c, ["b", "a"], w) for i, (op, c, w) in enumerate(ops)]
    folded = oplog.fold_log(spark.createDataFrame(rows, SCHEMA), ["key"], ["at"], F.col("at"))
    names = ["immutable_under_late", "byte_identical_replay", "explicit_failure", "append_only"]
    got = {r["variant"]: tuple(r[n] for n in names) for r in oplog.store_properties(folded).collect()}
    assert got == {"mutable": (False, True, False, False), "noncanonical": (False, False, False, True), "silent": (True, True, False, True), "append_only": (True, True, True, True)}
    state = {r["variant"]: r for r in oplog.store_state(folded, ["key"]).collect()}
    assert (state["mutable"]["records"], state["mutable"]["altered"], state["mutable"]["lost"]) == (1, 3, 1)
    assert (state["append_only"]["records"], state["append_only"]["rejected"], state["append_only"]["revision"]) == (2, 3, 1)


def test_empty(spark):
    folded = oplog.fold_log(spark.createDataFrame([], SCHEMA), ["key"], ["at"], F.col("at"))
    assert folded.count() == 0 and oplog.store_properties(folded).count() == 0 and oplog.store_state(folded, ["key"]).count() == 0
