"""Hand-computed cases: matching, labels and assignment, addresses, lines, the firewall, pointers, seeds of replay children."""

from __future__ import annotations

import hashlib
import hmac
import itertools
import random

import pytest
from pyspark.sql import functions as F

from wakeline.operators import detectors, evaluation, firewall, formation, replay, support
from wakeline.sources import sinks

VIEWS = "run_id string, episode_no long, start_us long, end_us long, entities array<string>, tokens array<string>"
TRUTH = "run_id string, group_id string, start_us long, end_us long, entities array<string>, required_tokens array<string>"


def matched(spark):
    views = [
        ("r", 1, 0, 100, ["a", "b"], ["x", "y", "network.flow"]),  # holds both tokens of g1, one of two entities in common
        ("r", 2, 0, 100, ["a"], ["x"]),
        ("r", 3, 500, 600, ["q"], ["network.flow"]),
        ("r", 4, 500, 600, ["q"], ["z"]),
        ("s", 1, 0, 100, ["a"], ["x"]),
    ]
    truth = [("r", "g1", 0, 100, ["a", "b", "c"], ["x", "y"]), ("r", "g2", 50, 150, ["a"], ["x"]), ("s", "g1", 0, 100, ["a"], ["x"])]
    views, truth = spark.createDataFrame(views, VIEWS), spark.createDataFrame(truth, TRUTH)
    return views, truth, evaluation.match_edges(views, truth)


def test_edges_by_hand(spark):
    edges = {(r["run_id"], r["episode_no"], r["group_id"]): r for r in matched(spark)[2].collect()}
    one = edges["r", 1, "g1"]
    assert one["coverage"] == 1 and one["jaccard"] == pytest.approx(2 / 3) and one["iou"] == 1 and one["weight"] == pytest.approx(0.5 + 0.2 + 0.2)
    two = edges["r", 2, "g2"]
    assert two["coverage"] == 1 and two["jaccard"] == 1 and two["iou"] == pytest.approx(50 / 150) and two["weight"] == pytest.approx(0.8 + 0.2 / 3)
    assert ("r", 2, "g1") not in edges  # one entity of three in common
    assert set(edges) == {("r", 1, "g1"), ("r", 1, "g2"), ("r", 2, "g2"), ("s", 1, "g1")}


def test_labels_and_contamination_by_hand(spark):
    views, truth, edges = matched(spark)
    conflicts = spark.createDataFrame([("s",)], "run_id string")
    got = {(r["run_id"], r["episode_no"]): (r["label"], r["group_id"], r["coverage"], r["contamination"]) for r in evaluation.episode_labels(views, edges, conflicts).collect()}
    # Episode 1: both its edges cover all; g1 weighs more. Benign: network.flow; attack: x, y. One of three.
    assert got["r", 1] == ("mixed", "g1", 1.0, pytest.approx(1 / 3))
    assert got["r", 2] == ("positive", "g2", 1.0, 0.0)
    assert got["r", 3] == ("negative", None, 0.0, None)
    assert got["r", 4] == ("ambiguous", None, 0.0, None)
    assert got["s", 1] == ("ambiguous", None, 0.0, None)  # its run's truth contradicts itself
    metrics = {r["run_id"]: r for r in evaluation.assignment_metrics(evaluation.formation_metrics(views, truth, edges), evaluation.assignment(edges)).collect()}
    r = metrics["r"]
    assert (r["n_episodes"], r["n_groups"], r["n_assigned"]) == (4, 2, 2)
    assert (r["precision"], r["recall"], r["f1"]) == (0.5, 1.0, pytest.approx(2 / 3))
    assert r["fragmentation"] == 0.5 and r["over_merge"] == 0.25 and r["contamination"] == pytest.approx((1 / 3 + 0) / 2)


@pytest.mark.parametrize("seed", range(12))
def test_assignment_against_all_permutations(seed):
    import pandas as pd

    rng = random.Random(seed)
    rows = [("r", e, f"g{g}", round(rng.random(), 3), round(rng.random(), 3), rng.randrange(10**9)) for e in range(rng.randrange(1, 6)) for g in range(rng.randrange(1, 6)) if rng.random() < 0.6]
    if not rows:
        return
    pdf = pd.DataFrame(rows, columns=["run_id", "episode_no", "group_id", "weight", "jaccard", "apart_us"])
    worth = {(e, g): w + 1e-12 * (j - a / 1e15) for _, e, g, w, j, a in rows}
    episodes, groups = sorted({e for e, _ in worth}), sorted({g for _, g in worth})
    best = (-1, 0.0)
    for k in range(min(len(episodes), len(groups)) + 1):
        for some in itertools.combinations(episodes, k):
            for order in itertools.permutations(groups, k):
                if all(p in worth for p in zip(some, order, strict=True)):
                    best = max(best, (k, sum(worth[p] for p in zip(some, order, strict=True))))
    got = [(r.episode_no, r.group_id) for r in evaluation._assign(pdf).itertuples()]
    assert len({e for e, _ in got}) == len({g for _, g in got}) == len(got) == best[0]
    assert sum(worth[p] for p in got) == pytest.approx(best[1], abs=1e-9)


def test_addresses(spark):
    private = ["10.1.2.3", "172.16.0.1", "172.31.255.255", "192.168.9.9", "127.0.0.1", "169.254.1.1", "0.0.0.1", "192.0.2.5", "198.18.0.1", "198.19.255.1", "198.51.100.7", "203.0.113.1", "240.0.0.1", "255.255.255.255", "::1", "::", "fc00::1", "fd12:3456::1", "fe80::1", "febf::1", "2001:db8::1", "FE80::2"]
    public = ["9.255.255.255", "11.0.0.0", "172.15.0.1", "172.32.0.1", "192.169.0.1", "8.8.8.8", "198.20.0.1", "203.0.114.1", "223.255.255.255", "2606:4700::1", "fec0::1", "2a00:1450::5"]
    rows = spark.createDataFrame([(a,) for a in [*private, *public, "host", "1.2.3", "1.2.3.256", "01.2.3.4", None]], "a string").select("a", detectors.private_address(F.col("a")).alias("p")).collect()
    got = {r["a"]: r["p"] for r in rows}
    assert all(got[a] is True for a in private), [a for a in private if got[a] is not True]
    assert all(got[a] is False for a in public), [a for a in public if got[a] is not False]
    assert all(got[a] is None for a in ("host", "1.2.3", "1.2.3.256", "01.2.3.4", None))


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    want = {}
    for name, n in (("a", 3000), ("b", 1), ("c", 0)):
        lines = ["" if i % 7 == 3 else f'{{"n": {i}}}' for i in range(n)]
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
        want |= {(name, i + 1): x for i, x in enumerate(lines)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in sinks.read_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def test_line_status(spark):
    cases = {"": "blank", "  ": "blank", "{": "invalid", "[1]": "not_object", "7": "not_object", '{"a": NaN}': "invalid", '{"a": -Infinity}': "invalid", '{"a": "NaN"}': "ok", '{"a": 9007199254740991}': "ok", '{"a": 9007199254740992}': "range", '{"a": -9007199254740993}': "range", '{"a": 1e400}': "range", '{"a": 1e300}': "ok", '{"a": "\\"NaN 99999999999999999999"}': "ok"}
    got = {r["value"]: r["s"] for r in spark.createDataFrame([(c,) for c in cases], "value string").select("value", sinks.line_status(F.col("value")).alias("s")).collect()}
    assert got == cases


def test_firewall_by_hand(spark):
    docs = [(1, '{"a": {"Label": 1, "b": [{"marker_id": "x"}, "bad"]}, "ok": "fine"}'), (2, '{"a": [[["bad"]]]}'), (3, '{"a": 1}'), (4, "no json")]
    rows = firewall.findings(spark.createDataFrame(docs, "id long, doc string"), "id", "doc", ["label", "marker_id"], ["bad"]).collect()
    assert sorted((r["id"], r["path"], r["kind"], r["found"]) for r in rows) == [(1, "a.Label", "key", "Label"), (1, "a.b[0].marker_id", "key", "marker_id"), (1, "a.b[1]", "value", "bad"), (2, "a[0][0][0]", "value", "bad")]


def test_numbers_that_are_none(spark):
    frame = spark.createDataFrame([(1.5, True), (0.0, False)], "x double, y boolean")
    assert firewall.assert_finite(frame).count() == 2
    for bad in (float("nan"), float("inf"), -0.0):
        with pytest.raises(Exception, match="x is not a finite number"):
            firewall.assert_finite(spark.createDataFrame([(bad, True)], "x double, y boolean")).collect()


def test_a_registry_of_another_length_fails(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("a", "sealed"), ("b", "open")], "run_id string, status string"), str(tmp_path / "r"))
    schema = "run_id string, status string"
    assert [r["run_id"] for r in sinks.read_registry(spark, str(tmp_path / "r"), schema, "status = 'sealed'", 1).collect()] == ["a"]
    with pytest.raises(ValueError, match="1 rows where 2"):
        sinks.read_registry(spark, str(tmp_path / "r"), schema, "status = 'sealed'", 2)


def test_port_22_is_a_session(spark):
    schema = "run_id string, event_id string, event_us long, ingest_us long, source_family string, source_instance string, subject string, object string, dependency_group string, command_family string, protocol string, action string, dest_port int"
    rows = [("r", str(p), 0, 0, "NDR", "x", "a", "b", "g", None, None, "network.flow", p) for p in (22, 80, None)]
    assert {r["event_id"]: r["session_like"] for r in formation.formation_input(spark.createDataFrame(rows, schema)).collect()} == {"22": True, "80": False, "None": False}


def test_support_branches(spark):
    base = {"eligible_count": 1, "edr_mask": 1, "ndr_mask": 1, "edr_observation": "detected", "ndr_observation": "detected", **{f"{p}_{c}": v for p in "en" for c, v in (("missing", False), ("health", "healthy"), ("parser_valid", True), ("transport_live", True))}, "ok": True, "cal": True, "grp": None}
    cases = [({}, "eligible", "supported_global"), ({"grp": "g"}, "eligible", "supported_group"), ({"eligible_count": 0, "ok": False}, "no_eligible_detector_value", None), ({"ok": False, "ndr_mask": 0}, "version_out_of_support", None), ({"ndr_mask": 0, "e_parser_valid": False}, "source_out_of_support", None),
             ({"e_parser_valid": False, "n_health": "down"}, "parser_out_of_support", None), ({"n_health": "down", "cal": False}, "source_out_of_support", None), ({"cal": False, "e_transport_live": False}, "calibration_out_of_support", None), ({"e_transport_live": False}, "source_out_of_support", None)]
    names = list(base)
    schema = ", ".join(f"{n} {'int' if n.endswith(('mask', 'count')) else 'boolean' if isinstance(base[n], bool) else 'string'}" for n in names) + ", i int"
    df = spark.createDataFrame([tuple({**base, **change}[n] for n in names) + (i,) for i, (change, _, _) in enumerate(cases)], schema)
    got = {r["i"]: (r["reason"], r["kappa"]) for r in support.decide_support(df, F.col("ok"), F.col("cal"), F.col("grp")).collect()}
    assert got == {i: (reason, kappa or "out_of_support") for i, (_, reason, kappa) in enumerate(cases)}


def test_a_child_has_a_seed_of_its_own(spark):
    rows = spark.createDataFrame([("r1", "e1"), ("r2", "e1")], "run_id string, event_id string")
    for level in (0.05, 0.25):
        for r in replay.drawn(rows, "drop", "EDR", level, "drop", F.col("event_id")).collect():
            seed = hmac.new(bytes.fromhex(replay.SEED), f"{r['run_id']}\x1fdrop\x1fEDR\x1f{level}".encode(), hashlib.sha256).digest()
            want = int.from_bytes(hmac.new(seed, b"drop\x1fe1", hashlib.sha256).digest()[:8], "big") / 2**64
            assert r["u"] == pytest.approx(want, abs=1e-12)


def test_lateral_sessions_know_all_addresses(spark):
    """Reserved blocks and IPv6 count as private; public addresses, names and nulls do not."""
    schema = "event_id int, source_family string, command_family string, protocol string, eve_event_type string, severity double, subject string, object string"
    pairs = [("ip:10.0.0.1", "ip:100.64.0.1"), ("ip:198.18.0.1", "ip:fe80::1"), ("ip:fd00::1", "ip:::1"), ("ip:192.0.2.7", "ip:10.0.0.1"), ("ip:8.8.8.8", "ip:10.0.0.1"), ("ip:10.0.0.1", "host:a"), ("ip:10.0.0.1", None), ("ip:10.0.0.300", "ip:10.0.0.1")]
    rows = [(i, "NDR", None, "ssh", "flow", 0.1, a, b) for i, (a, b) in enumerate(pairs)]
    found = detectors.detector_values(spark.createDataFrame(rows, schema)).filter("detector_id = 'ndr.lateral_session.v1'")
    import ipaddress

    def private(entity):
        try:
            return ipaddress.ip_address(entity.partition(":")[2]).is_private
        except (ValueError, AttributeError):
            return False

    assert sorted(r["event_id"] for r in found.collect()) == [i for i, (a, b) in enumerate(pairs) if private(a) and private(b)]


def test_findings_read_records_once(spark):
    """However deep they are, and whatever is found at each level."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    docs = [(i, '{"a": {"b": [{"c": {"label": "bad"}}]}, "label": 1}') for i in range(20)]
    rows = spark.createDataFrame(docs, "id long, doc string").mapInPandas(counted, "id long, doc string")
    found = firewall.findings(rows, "id", "doc", ["label"], ["bad"])
    before = read.value
    assert found.count() == 60 and read.value - before == 20
