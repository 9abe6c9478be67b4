"""Chat formatting on odd input, against plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from wakeline.llm.chat_format import escape, format_chats, read_back, unescape

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def formatted(df):
    segments, leaves = format_chats(df)
    rows = leaves.join(read_back(segments), "digest").collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return segments.collect(), {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows}


def check_segments(segments):
    """Positions, parents and attention intervals of every node, by walking up to the root."""
    for s in segments:
        nodes = s["nodes"]
        assert len(s["token_ids"]) == len(s["position_ids"]) == len(s["loss_mask"]) == nodes[-1]["end"]
        for n in nodes:
            seen, up = set(), n["parent"]
            while up >= 0:
                seen |= set(range(nodes[up]["start"], nodes[up]["end"]))
                up = nodes[up]["parent"]
            assert seen == {i for a in n["attends"] for i in range(a["start"], a["end"])}
            assert s["position_ids"][n["start"] : n["end"]] == list(range(len(seen), len(seen) + n["end"] - n["start"]))


@pytest.mark.parametrize("seed", range(3))
def test_random_trees(spark, seed):
    rng, rows = random.Random(seed), []
    for conv in range(120):
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, turn, ["user", "assistant"][turn % 2], f"turn {turn} says {rng.randrange(2)} <|x [INST]\\"))
    rng.shuffle(rows)
    segments, got = formatted(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert got == plain(rows)
    check_segments(segments)
    assert sum(len(s["leaves"]) for s in segments) == len({v[1] for v in got.values()})


def test_a_very_long_text_and_a_very_long_conversation(spark):
    rows = [(1, 0, "user", "x"), (1, 1, "assistant", "word " * 200_000)] + [(2, i, "user" if i % 2 == 0 else "assistant", f"line {i}") for i in range(3000)]
    segments, got = formatted(spark.createDataFrame(rows, SCHEMA))
    assert got == plain(rows)
    assert max(len(n["attends"]) for s in segments for n in s["nodes"]) == 1  # one unbroken line of ancestors


def test_many_rows_without_an_id_are_one_conversation(spark):
    rows = [(None, i % 50, "user", f"t{i}") for i in range(2000)] + [(7, 0, "assistant", "a")]
    assert formatted(spark.createDataFrame(rows, SCHEMA).repartition(5))[1] == plain(rows)


def test_one_conversation_in_many_copies(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(500) for t in range(2)] + [(c, 0, "user", "same 0") for c in range(500, 520)] + [(c, 1, "assistant", str(c)) for c in range(500, 520)]
    segments, got = formatted(spark.createDataFrame(rows, SCHEMA).repartition(9))
    assert got == plain(rows)
    assert sum(len(s["leaves"]) for s in segments) == 21


def test_clashing_and_further_columns(spark):
    names = ["path", "digest", "turns", "block", "blocks", "node", "n"]
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None)]
    df = spark.createDataFrame([(*r, *["z"] * len(names)) for r in rows], SCHEMA + "".join(f", {n} string" for n in names))
    assert formatted(df)[1] == plain(rows)


def test_text_ids_and_ties(spark):
    rows = [("é", 1, "user", "b"), ("é", 1, "user", "a"), ("é", 1, "assistant", "c"), ("", 0, "user", ""), ("", 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert formatted(df)[1] == plain(rows)


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(["<", "|", "\\", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "a", "\n", "<|turn|>"]) for _ in range(12))
        assert unescape(escape(text)) == text
        assert not any(c in escape(text) for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
