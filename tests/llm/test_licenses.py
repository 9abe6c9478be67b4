"""Every rule on its own text, and the resolver against a naive one."""

from __future__ import annotations

import random
import re

import pytest

from wakeline.llm.license_rules import BASE_PHRASES, rules
from wakeline.llm.license_scan import NORMAL, Scanner

RULES = rules()


def normal(text):
    return f" {b' '.join(text.encode().translate(NORMAL).split()).decode()} "


@pytest.mark.parametrize("i", range(len(RULES)))
def test_a_rule_finds_its_text_and_needs_its_keyword(i):
    rule, text = RULES[i], normal(RULES[i].example)
    assert f" {rule.keyword} " in text
    assert re.search(rule.pattern, text)
    assert not re.search(rule.pattern, re.sub(rf"(?<= ){rule.keyword} ", "", text))
    assert rule.label in {d[2] for d in Scanner(BASE_PHRASES, [rule]).scan(rule.example)[5]}


def test_there_are_hundreds_and_none_twice():
    assert len(RULES) > 240 and len({r.pattern for r in RULES}) == len(RULES)


def naive(text, signatures):
    """All matches of all rules, no gate; then each is dropped that lies within one taken before it, compared one by one."""
    n = normal(text)
    found = sorted((-r.priority, m.start() - m.end(), i, m.start(), m.end()) for i, r in enumerate(signatures) if f" {r.keyword} " in n for m in re.finditer(r.pattern, n, re.DOTALL))
    taken = []
    for _, _, i, start, end in found:
        if not any(s <= start and end <= e for s, e, _ in taken):
            taken.append((start, end, signatures[i].label))
    return sorted((n[:s].count(" ") - 1, n[:e].count(" "), label) for s, e, label in taken)


@pytest.mark.parametrize("seed", range(20))
def test_overlaps_are_resolved_as_by_a_naive_resolver(seed):
    rng, scanner = random.Random(seed), Scanner(BASE_PHRASES, RULES)
    for _ in range(10):
        words = [w for _ in range(rng.randrange(1, 12)) for w in (rng.choice(RULES).example if rng.random() < 0.7 else rng.choice(["the", "gnu", "license", "version 2", "or later", "under"])).split()]
        for _ in range(rng.randrange(3)):
            words.pop(rng.randrange(len(words))) if len(words) > 1 else None
        text = " ".join(words)
        assert [d[:3] for d in scanner.scan(text)[5]] == naive(text, RULES)


def test_plain_prose_has_no_license():
    scanner = Scanner(BASE_PHRASES, RULES)
    for text in ("The apache helicopter landed in the open field.", "She got a license to drive in 2019, version two of her dream.", "An artistic person under a mozilla tree", "They mit the deadline", "", "copy right of way", "boost your business with a common distribution"):
        assert scanner.scan(text)[5] == [], text
