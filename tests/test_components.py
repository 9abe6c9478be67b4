from __future__ import annotations

import random

import pytest

from wakeline.operators.builders import entity_components

MEMBER = "run_id string, episode_no int, event_id string, subject string, object string"


def test_a_chain_of_hundreds_is_one_component(spark):
    order = list(range(400))
    random.Random(2).shuffle(order)
    chain = [("r", 0, f"e{order[i]:03}", f"x{i}", f"x{i + 1}") for i in range(400)]
    rows = [*chain, ("r", 1, "e900", "x0", "x1"), ("s", 0, "e901", "x0", "x0"), ("s", 0, "e902", "x0", None), ("s", 0, "e903", None, None)]
    got = {(r["run_id"], r["episode_no"], r["event_id"]): r["component"] for r in entity_components(spark.createDataFrame(rows, MEMBER), ["run_id", "episode_no"]).collect()}
    assert len(got) == len(rows)
    assert {c for (run, no, _), c in got.items() if (run, no) == ("r", 0)} == {"e000"}
    assert got["r", 1, "e900"] == "e900" and got["s", 0, "e902"] == "e901" and got["s", 0, "e903"] == "e903"


def test_unfinished_components_raise(spark):
    with pytest.raises(RuntimeError, match="not come to rest"):
        entity_components(spark.createDataFrame([("r", 0, f"e{(i * 37) % 101:03}", f"x{i}", f"x{i + 1}") for i in range(101)], MEMBER), ["run_id", "episode_no"], bound=1)
