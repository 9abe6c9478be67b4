"""Terminal records: every code, their precedence, odd inputs, against plain Python."""

from __future__ import annotations

import hashlib
import random

from wakeline.operators import assembly

REVISIONS = "id string, revision_digest string, elapsed_us long"
INPUTS = "id string, input_type string, valid boolean, revision_digest string, content string, stated_digest string, version string"
VERSIONS = {t: "v1" for t in assembly.INPUTS[1:]}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def whole(i, skip=()):
    return [[i, t, True, f"d{i}", f"{t}{i}", sha(f"{t}{i}"), "v1"] for t in assembly.INPUTS if t not in skip]


FAULTS = {
    "schema_invalid": lambda rows: rows[2].__setitem__(2, False),
    "key_mismatch": lambda rows: rows[3].__setitem__(3, "other"),
    "conflicting_duplicate": lambda rows: rows.append([*rows[1][:4], "else", sha("else"), "v1"]),
    "digest_mismatch": lambda rows: rows[4].__setitem__(5, sha("x")),
    "version_mismatch": lambda rows: rows[5].__setitem__(6, "v0"),
    "missing_input": lambda rows: rows.pop(6),
    "assembly_timeout": lambda rows: None,
}


def run(spark, revisions, inputs):
    got = assembly.assemble(spark.createDataFrame(revisions, REVISIONS), spark.createDataFrame([tuple(r) for r in inputs], INPUTS), ["id"], VERSIONS, 1000)
    return {r["id"]: (r["outcome"], r["failure_code"], r["observed"], r["n_inputs"]) for r in got.collect()}


def test_each_code_and_precedence(spark):
    """Every fault alone, and each with all of lower rank."""
    revisions, inputs, want = [("clean", "dclean", 1000)], whole("clean"), {"clean": None}
    for rank, code in enumerate(assembly.CODES):
        for name, faults in ((code, [code]), (f"{code}+", assembly.CODES[rank:])):
            rows = whole(name)
            for fault in faults:
                FAULTS[fault](rows)
            inputs += rows
            revisions.append((name, f"d{name}", 1001 if "assembly_timeout" in faults else None))
            want[name] = code
    got = run(spark, revisions, inputs)
    assert {k: v[1] for k, v in got.items()} == want
    assert all((v[0] == "success") == (v[1] is None) for v in got.values())
    assert got["missing_input"][2] == assembly.INPUTS[:6] and got["clean"][2:] == (assembly.INPUTS, 7)


def test_odd_inputs(spark):
    copies = whole("copies") * 40
    unknown = [*whole("unknown"), ["unknown", "Gossip", True, "dunknown", "x", sha("x"), "v1"]]
    nulls = whole("nulls")
    nulls[0][1] = None
    unversioned, valid, keyless, empty = whole("unversioned"), whole("valid"), whole("keyless"), whole("empty")
    unversioned[3][6], valid[1][2], keyless[2][3] = None, None, None
    unversioned[0][6] = "any"
    empty[1][4] = None  # a digest over nothing is no digest
    rows = [*copies, *unknown, *nulls, *unversioned, *valid, *keyless, *empty, *whole("nobody")]
    ids = ["copies", "unknown", "nulls", "unversioned", "valid", "keyless", "empty", "bare"]
    random.Random(3).shuffle(rows)
    got = run(spark, [(i, f"d{i}", 0) for i in ids], rows)
    assert set(got) == set(ids) and got["copies"] == ("success", None, assembly.INPUTS, 280)
    assert {i: got[i][1] for i in ids[1:]} == {
        "unknown": "schema_invalid", "nulls": "schema_invalid", "unversioned": "version_mismatch", "valid": "schema_invalid", "keyless": "key_mismatch", "empty": "digest_mismatch", "bare": "missing_input",
    }
    assert got["bare"][2:] == ([], 0)


def test_empty(spark):
    assert run(spark, [], whole("x")) == {} and run(spark, [("a", None, None)], [])["a"][1] == "missing_input"
