"""Policy contracts as data: written by people, compiled to one canonical JSON text, checked, signed by a digest and put in force.

A contract has roles; columns, each with a level a role, a mask and whether it identifies a person; budgets a role; and a
glossary of the terms in which questions are asked.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from sluice.governance import policy
from sluice.governance.catalog import Catalog
from sluice.governance.model import Level

MASKS = {"redact": (), "keep_last": ("text", "integer", "float", "decimal"), "hash": (), "generalise": ()}


class Invalid(ValueError):
    def __init__(self, faults: list[str]):
        super().__init__("; ".join(faults))
        self.faults = faults


@dataclass(frozen=True)
class Contract:
    text: str

    @property
    def digest(self) -> str:
        return hashlib.sha256(self.text.encode()).hexdigest()

    @property
    def content(self) -> dict:
        return json.loads(self.text)


def current() -> dict:
    """The policy in force, as a contract's source."""
    return {
        "roles": list(policy.ROLES),
        "columns": {name: {"levels": dict(zip(policy.ROLES, (x.value for x in r.levels), strict=True)), "mask": r.mask, "argument": r.argument, "identifies": r.identifies} for name, r in policy.COLUMNS.items()},
        "budgets": {role: {"soft_bytes": b.soft_bytes, "hard_bytes": b.hard_bytes, "max_rows": b.max_rows} for role, b in policy.BUDGETS.items()},
        "glossary": dict(policy.GLOSSARY),
    }


def compiled(source: dict, catalog: Catalog | None = None) -> Contract:
    """The contract of a source: all defaults written out, keys in order. Raises Invalid with every fault that it has.
    ``catalog``: the columns that there are; a column that no table has, or a mask that its type can't take, is a fault."""
    faults: list[str] = []
    roles = source.get("roles") or []
    if not roles or len(set(roles)) != len(roles):
        faults.append("roles must be named, each once")
    levels = {x.value for x in Level}
    known = {f"{t}.{c.name}": c for t, cs in catalog.columns.items() for c in cs} if catalog else {}
    columns = {}
    for name, rule in sorted((source.get("columns") or {}).items()):
        own = rule.get("levels") or {}
        if set(own) != set(roles) or not set(own.values()) <= levels:
            faults.append(f"{name}: a level of {', '.join(sorted(levels))} for each role, and no other")
        mask, argument = rule.get("mask", ""), str(rule.get("argument", ""))
        if "mask" in own.values() and mask not in MASKS:
            faults.append(f"{name}: masked, but not by any of {', '.join(MASKS)}")
        if mask == "keep_last" and not argument.isdigit():
            faults.append(f"{name}: keep_last needs a number")
        if catalog and name not in known:
            faults.append(f"{name}: there is no such column")
        elif catalog and mask in MASKS and MASKS[mask] and known[name].family not in MASKS[mask]:
            faults.append(f"{name}: {mask} can't mask a {known[name].family}")
        if catalog and mask == "generalise" and f"{name.partition('.')[0]}.{argument}" not in known:
            faults.append(f"{name}: there is no column {argument} to generalise to")
        columns[name] = {"levels": {r: own.get(r) for r in roles}, "mask": mask, "argument": argument, "identifies": bool(rule.get("identifies", False))}
    budgets = {}
    for role in roles:
        b = (source.get("budgets") or {}).get(role) or {}
        limits = [b.get(k) for k in ("soft_bytes", "hard_bytes", "max_rows")]
        if not all(isinstance(x, int) and x > 0 for x in limits) or limits[0] > limits[1]:
            faults.append(f"{role}: a budget needs soft_bytes up to hard_bytes, and max_rows")
        budgets[role] = dict(zip(("soft_bytes", "hard_bytes", "max_rows"), limits, strict=True))
    glossary = {str(k): str(v) for k, v in sorted((source.get("glossary") or {}).items())}
    if faults:
        raise Invalid(faults)
    return Contract(json.dumps({"roles": roles, "columns": columns, "budgets": budgets, "glossary": glossary}, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def signed(text: str, digest: str) -> Contract:
    """A compiled contract whose digest was agreed on. Raises Invalid if it was changed since."""
    found = Contract(text)
    if found.digest != digest:
        raise Invalid(["the contract isn't the one that was signed"])
    return found


def enforce(contract: Contract) -> None:
    """Puts the contract in force in this process, all of it or nothing. Roles are fixed when the process starts."""
    content = contract.content
    if tuple(content["roles"]) != policy.ROLES:
        raise Invalid([f"roles must be {', '.join(policy.ROLES)}"])
    columns = {n: policy.Rule(tuple(Level(r["levels"][x]) for x in policy.ROLES), r["mask"], r["argument"], r["identifies"]) for n, r in content["columns"].items()}
    budgets = {r: policy.Budget(**b) for r, b in content["budgets"].items()}
    for target, new in ((policy.COLUMNS, columns), (policy.BUDGETS, budgets), (policy.GLOSSARY, content["glossary"])):
        target.clear()
        target.update(new)
