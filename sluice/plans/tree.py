"""Catalyst plans as plain trees, from one JSON dump each, so a walk costs no call into the JVM."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class Node:
    """A plan or expression node. ``parts``: the trees in its fields, by field name; children aren't among them."""

    name: str
    fields: dict
    children: list[Node] = field(default_factory=list)
    parts: list[tuple[str, Node]] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        yield self
        for x in self.children:
            yield from x.walk()
        for _, x in self.parts:
            yield from x.walk()

    def part(self, name: str) -> list[Node]:
        return [x for n, x in self.parts if n == name]

    @property
    def id(self) -> int | None:
        """The expression id that an attribute or alias carries."""
        found = self.fields.get("exprId")
        return found.get("id") if isinstance(found, dict) else None


def _is_tree(x) -> bool:
    return isinstance(x, list) and bool(x) and isinstance(x[0], dict) and "class" in x[0] and "num-children" in x[0]


def _trees(x) -> Iterator[list]:
    if _is_tree(x):
        yield x
    elif isinstance(x, list):
        for y in x:
            yield from _trees(y)
    elif isinstance(x, dict) and "product-class" in x:
        for y in x.values():
            yield from _trees(y)


def read(dump: list[dict]) -> Node:
    at = 0

    def build() -> Node:
        nonlocal at
        raw = dump[at]
        at += 1
        node = Node(raw["class"].rpartition(".")[2].strip("$").rpartition("$")[2], {k: v for k, v in raw.items() if k not in ("class", "num-children")})
        node.children = [build() for _ in range(raw["num-children"])]
        for k, v in node.fields.items():
            node.parts += [(k, read(x)) for x in _trees(v)]
        if node.name == "Between" and all(map(node.part, ("input", "lower", "upper"))):
            # Its own replacement hides the input behind a reference.
            (value,), (low,), (high,) = map(node.part, ("input", "lower", "upper"))
            return Node("And", {}, [Node("GreaterThanOrEqual", {}, [value, low]), Node("LessThanOrEqual", {}, [value, high])])
        return node

    return build()


def parsed(spark: SparkSession, text: str) -> Node:
    """The tree of a statement before analysis: nothing is looked up. Raises ParseException."""
    return read(json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toJSON()))


def analyzed(df) -> Node:
    return read(json.loads(df._jdf.queryExecution().analyzed().toJSON()))


def name_parts(x) -> list[str]:
    """Dumps write a list of names as ``[a, b]``."""
    return [p.strip() for p in x.strip("[]").split(",")] if isinstance(x, str) else list(x or ())
