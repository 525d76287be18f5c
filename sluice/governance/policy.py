"""Who may see which column, where in a statement, and how much a role may read."""

from __future__ import annotations

from dataclasses import dataclass

from sluice.governance.model import Decision, Level, Position

ROLES = ("analyst", "operations", "finance", "admin")
A, M, D = Level.ALLOW, Level.MASK, Level.DENY


@dataclass(frozen=True)
class Rule:
    """Levels by role in the order of ROLES; how the column is masked; whether it identifies a person."""

    levels: tuple[Level, ...]
    mask: str = ""
    argument: str = ""
    identifies: bool = False


COLUMNS: dict[str, Rule] = {
    "customer.c_name": Rule((M, M, M, A), "redact", identifies=True),
    "customer.c_acctbal": Rule((M, D, A, A), "keep_last", "2"),
    "customer.c_custkey": Rule((A, A, A, A), identifies=True),
    "orders.o_custkey": Rule((A, A, A, A), identifies=True),
    "supplier.s_name": Rule((M, A, M, A), "hash"),
    "supplier.s_acctbal": Rule((D, D, A, A), "redact"),
    "events.user_id": Rule((M, A, M, A), "hash", identifies=True),
    "events.props": Rule((M, M, M, A), "generalise", "event_type"),
    "documents.text": Rule((D, D, D, D), "redact"),
    "conversations.text": Rule((D, D, D, A), "redact"),
    "pages.html": Rule((D, A, D, A), "redact"),
}
#: What the words of questions mean, in terms of the tables.
GLOSSARY: dict[str, str] = {
    "order value": "o_totalprice of orders; an order has several lines, so never summed after a join with lineitem",
    "line value": "l_extendedprice of lineitem, before discount and tax",
    "buyer": "a customer with at least one order; customers without orders are no buyers",
    "active user": "a distinct user_id of events that are not errors",
    "month": "the calendar month of the event's own date, never of today",
}
#: Where a masked column must not stand: there its raw values would decide the result.
FORBIDDEN = frozenset(Position) - {Position.PROJECTION}
SMALLEST_GROUP = 5


def level(role: str, column: str) -> Level:
    """Columns without a rule are allowed."""
    rule = COLUMNS.get(column)
    return rule.levels[ROLES.index(role)] if rule else A


def permitted(role: str, column: str, position: Position) -> bool:
    found = level(role, column)
    return found is A or found is M and position not in FORBIDDEN


def identifies(column: str) -> bool:
    return column in COLUMNS and COLUMNS[column].identifies


@dataclass(frozen=True)
class Budget:
    soft_bytes: int
    hard_bytes: int
    max_rows: int

    def decide(self, size: int) -> Decision:
        """Up to the soft limit it runs, up to the hard one it asks, from there on it is refused."""
        return Decision.EXECUTE if size <= self.soft_bytes else Decision.CONFIRM if size < self.hard_bytes else Decision.REJECT


GB = 1_000_000_000
BUDGETS = {
    "analyst": Budget(300_000_000, 600_000_000, 50_000),
    "operations": Budget(20_000_000, 50_000_000, 2_000),
    "finance": Budget(400_000_000, 800_000_000, 100_000),
    "admin": Budget(750_000_000, 1_500_000_000, 250_000),
}
