"""What passes between the controls: reasons, estimates, verdicts and results."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Level(str, Enum):
    ALLOW = "allow"
    MASK = "mask"
    DENY = "deny"


class Position(str, Enum):
    WHERE = "where"
    HAVING = "having"
    QUALIFY = "qualify"
    GROUP_BY = "group_by"
    JOIN_ON = "join_on"
    WINDOW_PARTITION = "window_partition"
    ORDER_BY = "order_by"
    FUNCTION_ARGUMENT = "function_argument"
    PROJECTION = "projection"


class Decision(str, Enum):
    EXECUTE = "execute"
    CONFIRM = "confirm"
    REJECT = "reject"


@dataclass(frozen=True)
class Principal:
    role: str
    name: str = "anonymous"


@dataclass(frozen=True)
class Reason:
    rule: str
    code: str
    message: str
    suggestion: str = ""
    subject: str = ""
    position: str = ""
    retryable: bool = True
    stage: str = "guard"


@dataclass(frozen=True)
class CostEstimate:
    bytes: int
    rows: int
    files: int
    detail: tuple = ()


@dataclass(frozen=True)
class Validated:
    """An admitted statement: its text, who asks, what it reads, and the cap on its rows."""

    sql: str
    principal: Principal
    tables: tuple[str, ...]
    columns: tuple[str, ...]
    masked: tuple[str, ...]
    cap: int


@dataclass
class Outcome:
    status: str
    reasons: tuple[Reason, ...] = ()
    cost: CostEstimate | None = None
    columns: tuple[str, ...] = ()
    rows: list[tuple] = field(default_factory=list)
    truncated: bool = False
    masked: tuple[str, ...] = ()
    duration_ms: float = 0.0


@dataclass(frozen=True)
class ResultSet:
    columns: tuple[str, ...]
    rows: tuple[tuple, ...]
    truncated: bool = False

    def __post_init__(self):
        if any(len(r) != len(self.columns) for r in self.rows):
            raise ValueError("a row has another width than the columns")
