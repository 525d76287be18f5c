"""Variants of a statement that mean the same to an engine: a control must judge each as it judges the original."""

from __future__ import annotations

import random
import re
from collections.abc import Callable


def _words(text: str, change: Callable[[str], str]) -> str:
    """Applies a change outside string literals."""
    return "".join(p if p[:1] == "'" else change(p) for p in re.split(r"('(?:[^']|'')*')", text))


def upper(text: str, _: random.Random) -> str:
    return _words(text, lambda p: re.sub(r"\b(select|from|where|group|by|order|limit|join|on|and|or|union|all|with|as|delete|offset)\b", lambda m: m[0].upper(), p, flags=re.I))


def lower(text: str, _: random.Random) -> str:
    return _words(text, lambda p: re.sub(r"\b(SELECT|FROM|WHERE|GROUP|BY|ORDER|LIMIT|JOIN|ON|AND|OR|UNION|ALL|WITH|AS|DELETE|OFFSET)\b", lambda m: m[0].lower(), p))


def mixed(text: str, r: random.Random) -> str:
    return _words(text, lambda p: "".join(c.upper() if r.random() < 0.5 else c.lower() for c in p) if "`" not in p else p)


def spaced(text: str, r: random.Random) -> str:
    return _words(text, lambda p: re.sub(r" ", lambda _: r.choice([" ", "  ", "\n", "\t"]), p))


def block_comment(text: str, _: random.Random) -> str:
    return _words(text, lambda p: re.sub(r"(?<=\w) (?=\w)", " /* x */ ", p, count=1))


def line_comment(text: str, _: random.Random) -> str:
    return text.rstrip("; \n") + " -- done"


def semicolon(text: str, _: random.Random) -> str:
    return text.rstrip("; \n") + ";"


def derived(text: str, _: random.Random) -> str:
    return f"SELECT * FROM ({text.rstrip('; ')}) AS m" if re.match(r"\s*select\b", text, re.I) else text


def common(text: str, _: random.Random) -> str:
    return f"WITH m AS ({text.rstrip('; ')}) SELECT * FROM m" if re.match(r"\s*select\b", text, re.I) else text


MUTATIONS = (upper, lower, mixed, spaced, block_comment, line_comment, semicolon, derived, common)


def mutants(texts: list[str], seed: int, rounds: int = 2) -> list[str]:
    """Each text under each mutation, then under ``rounds`` of random chains of them; the same for the same seed."""
    r = random.Random(seed)
    out = {m(t, r) for t in texts for m in MUTATIONS}
    for _ in range(rounds):
        for t in texts:
            for m in r.sample(MUTATIONS, 3):
                t = m(t, r)
            out.add(t)
    return sorted(out.difference(texts))


def recovery(seeds: list[tuple[str, str, str]], seed: int, rounds: int = 1) -> list[tuple[str, str, str]]:
    """A corpus for loops that must recover from a refusal, from (question, refused statement, right statement) seeds: every
    seed with every variant of its refused statement, each once, in an order that depends on ``seed`` alone."""
    found = {(q, m, right): None for q, wrong, right in seeds for m in [wrong, *mutants([wrong], seed, rounds)]}
    out = list(found)
    random.Random(seed).shuffle(out)
    return out
