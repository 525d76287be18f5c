"""From a question to an admitted statement: generate, validate, and try again with the reasons, twice at most."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from sluice.governance import policy
from sluice.governance.gateway import Gateway, Refused
from sluice.governance.model import Reason, Validated

ATTEMPTS = 3
Provider = Callable[[str], str]


@dataclass
class Asked:
    admitted: Validated | None
    attempts: list[tuple[str, tuple[Reason, ...]]] = field(default_factory=list)


def clean(question: str, most: int = 2000) -> str:
    """One line of visible characters, without fences that could close the prompt's own."""
    return re.sub(r"\s+", " ", "".join(c if c.isprintable() else " " for c in question)).replace("```", "'''").strip()[:most]


def _mentions(question: str, term: str) -> bool:
    """Whether a question has a term of the glossary, in the singular or with an s."""
    return re.search(rf"(?<!\w){re.escape(term)}s?(?!\w)", clean(question), re.I) is not None


def prompt(gateway: Gateway, question: str, reasons: tuple[Reason, ...] = (), before: str = "") -> str:
    tables = []
    for t in gateway.tables():
        columns = ", ".join(f"{c.name} {c.family}" for c in gateway.catalog.columns[t] if c.published)
        tables.append(f"{t}({columns})")
    terms = [f"{term}: {meaning}" for term, meaning in sorted(policy.GLOSSARY.items()) if _mentions(question, term)]
    parts = ["Answer with one SQL query over these tables, and nothing else.", *tables, *(["Terms:", *terms] if terms else []), f"Question: ```{clean(question)}```"]
    if reasons:
        parts += [f"Refused: {before}", *[f"{r.rule}: {r.message} {r.suggestion}".strip() for r in reasons]]
    return "\n".join(parts)


def extract(answer: str) -> str:
    """The first fenced block, or else the text from its first SELECT or WITH."""
    if m := re.search(r"```(?:sql)?\s*\n?(.*?)```", answer, re.S | re.I):
        return m[1].strip().rstrip(";")
    m = re.search(r"\b(select|with)\b.*", answer, re.S | re.I)
    return (m[0] if m else answer).strip().rstrip(";")


def ask(gateway: Gateway, question: str, provider: Provider, attempts: int = ATTEMPTS) -> Asked:
    out, reasons, text = Asked(None), (), ""
    for _ in range(attempts):
        text = extract(provider(prompt(gateway, question, reasons, text)))
        try:
            out.admitted, _ = gateway.validate(text)
            out.attempts.append((text, ()))
            return out
        except Refused as e:
            reasons = e.reasons
            out.attempts.append((text, reasons))
            if not all(r.retryable for r in reasons):
                return out
    return out


def scripted(answers: list[str]) -> Provider:
    """Gives the answers in turn, the last one for ever."""
    left = list(answers)
    return lambda _: left.pop(0) if len(left) > 1 else left[0]


def cache_key(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def recorded(answers: dict[str, str], fallback: Provider | None = None) -> Provider:
    """Answers by the prompt's hash; what the fallback says is kept."""

    def answer(text: str) -> str:
        k = cache_key(text)
        if k not in answers:
            if fallback is None:
                raise KeyError("no answer is recorded for this prompt")
            answers[k] = fallback(text)
        return answers[k]

    return answer
