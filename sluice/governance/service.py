"""The gateway's operations as tools, for callers over any transport: descriptions, dispatch, and confirmation of costly calls.

A caller never says who it is: the role belongs to the gateway, and arguments that try to set one are refused as such. A
refusal is an answer like any other, so it comes back as a result with its reasons; errors are for calls that are malformed.

``respond`` answers HTTP-shaped requests and ``message`` JSON-RPC ones; both are plain functions, and ``serve`` reads the
latter line by line from a stream. No socket is opened here.
"""

from __future__ import annotations

import hmac
import json
import re
import secrets
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any, TextIO

from sluice.governance.gateway import Gateway
from sluice.governance.model import Outcome
from sluice.governance.telemetry import Telemetry

_TEXT = {"type": "string", "minLength": 1}
#: Name: what it does, the arguments it takes, and the ones it needs.
TOOLS: dict[str, tuple[str, dict[str, dict], tuple[str, ...]]] = {
    "run_query": ("Runs one SELECT statement under the role's policy and budget.", {"sql": _TEXT, "question": {"type": "string"}, "confirmation": {"type": "string"}}, ("sql",)),
    "decide": ("Says whether a statement would run, ask or be refused; runs nothing.", {"sql": _TEXT}, ("sql",)),
    "explain_cost": ("Prices a statement from file statistics; runs nothing.", {"sql": _TEXT}, ("sql",)),
    "sample_table": ("The first rows of a table.", {"table": _TEXT, "n": {"type": "integer", "minimum": 1, "maximum": 100}}, ("table",)),
    "describe_table": ("Columns, types and levels of a table.", {"table": _TEXT}, ("table",)),
    "list_tables": ("The tables that may be asked about.", {}, ()),
}
#: Arguments by which a caller could claim to be another.
CLAIMS = {"role", "principal", "user", "identity", "as", "actor", "impersonate", "on_behalf_of", "authorization", "token"}
_TRACE = re.compile(r"([0-9a-f]{2})-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})(-.*)?")


class BadCall(Exception):
    """A call that is malformed, as against a statement that is refused."""


def traceparent(header: str | None) -> tuple[str, str, bool] | None:
    """(trace id, parent id, sampled) of a W3C traceparent header; None for any that isn't valid."""
    m = _TRACE.fullmatch((header or "").strip().lower())
    if not m or m[1] == "ff" or m[1] == "00" and m[5] or not m[2].strip("0") or not m[3].strip("0"):
        return None
    return m[2], m[3], bool(int(m[4], 16) & 1)


def specifications() -> list[dict]:
    return [{"name": n, "description": what, "inputSchema": {"type": "object", "properties": args, "required": list(needs), "additionalProperties": False}} for n, (what, args, needs) in TOOLS.items()]


def checked(name: str, arguments: Any) -> dict:
    """The arguments, if they are what the tool takes. Raises BadCall."""
    if name not in TOOLS:
        raise BadCall(f"there is no tool {name}")
    if not isinstance(arguments, dict):
        raise BadCall("arguments must be an object")
    _, known, needs = TOOLS[name]
    if claims := sorted(k for k in arguments if k.lower().replace("-", "_") in CLAIMS):
        raise BadCall(f"{', '.join(claims)}: who asks is not the caller's to say")
    if odd := sorted(arguments.keys() - known.keys()):
        raise BadCall(f"{name} takes no {', '.join(odd)}")
    if missing := [k for k in needs if k not in arguments]:
        raise BadCall(f"{name} needs {', '.join(missing)}")
    for k, v in arguments.items():
        kind = known[k]["type"]
        right = isinstance(v, str) if kind == "string" else isinstance(v, int) and not isinstance(v, bool)
        if not right or kind == "string" and len(v) < known[k].get("minLength", 0) or kind == "integer" and not known[k]["minimum"] <= v <= known[k]["maximum"]:
            raise BadCall(f"{k} is no valid {kind}")
    return arguments


@dataclass
class Service:
    gateway: Gateway
    telemetry: Telemetry = field(default_factory=Telemetry)
    #: Statements that await a confirmation, by the word that confirms them; each word holds once, for its statement alone.
    pending: dict[str, str] = field(default_factory=dict)

    def call(self, name: str, arguments: Any = None, header: str | None = None) -> dict:
        """The tool's answer. Raises BadCall."""
        arguments = checked(name, {} if arguments is None else arguments)
        parsed = traceparent(header)
        trace = parsed[0] if parsed else ""
        with self.telemetry.span("tool", trace, **{"tool.name": name}) as span:
            found = getattr(self, "_" + name)(trace, **arguments)
            span["status"] = found.get("status", "executed")
        return found | ({"trace": trace} if trace else {})

    def _run_query(self, trace: str, sql: str, question: str = "", confirmation: str = "") -> dict:
        wanted = self.pending.pop(confirmation, None) if confirmation else None
        if confirmation and (wanted is None or not hmac.compare_digest(wanted.encode(), sql.encode())):
            raise BadCall("the confirmation isn't for this statement, or was used before")
        outcome = self.gateway.run(sql, question, confirmed=bool(confirmation), trace=trace)
        found = shown(outcome)
        if any(r.code == "NEEDS_CONFIRMATION" for r in outcome.reasons):
            found["confirmation"] = word = secrets.token_urlsafe(16)
            self.pending[word] = sql
            while len(self.pending) > 1000:
                self.pending.pop(next(iter(self.pending)))
        return found

    def _decide(self, trace: str, sql: str) -> dict:
        return shown(self.gateway.decide(sql))

    def _explain_cost(self, trace: str, sql: str) -> dict:
        return shown(self.gateway.explain(sql))

    def _sample_table(self, trace: str, table: str, n: int = 10) -> dict:
        return shown(self.gateway.sample(table, n))

    def _describe_table(self, trace: str, table: str) -> dict:
        if table not in self.gateway.tables():
            return {"status": "rejected", "reasons": [{"rule": "R004", "code": "UNKNOWN_TABLE", "message": f"There is no table {table}."}]}
        return {"status": "executed", "columns": [r.asDict() for r in self.gateway.describe(table).collect()]}

    def _list_tables(self, trace: str) -> dict:
        return {"status": "executed", "tables": self.gateway.tables()}

    # HTTP-shaped.

    def respond(self, method: str, path: str, body: str = "", headers: dict[str, str] | None = None) -> tuple[int, dict]:
        """(status, answer). A refused statement is a 200 with its reasons."""
        headers = {k.lower(): v for k, v in (headers or {}).items()}
        routes: list[tuple[str, str, Callable[..., tuple[str, dict]]]] = [
            ("GET", "/health", lambda: ("", {})), ("GET", "/tables", lambda: ("list_tables", {})), ("GET", "/tables/([A-Za-z0-9_]+)", lambda t: ("describe_table", {"table": t})),
            ("POST", "/query", lambda: ("run_query", self._object(body))), ("POST", "/decide", lambda: ("decide", self._object(body))), ("POST", "/explain", lambda: ("explain_cost", self._object(body))),
            ("POST", "/tables/([A-Za-z0-9_]+)/sample", lambda t: ("sample_table", self._object(body or "{}") | {"table": t})),
        ]
        matching = [(verb, m, make) for verb, pattern, make in routes if (m := re.fullmatch(pattern, path))]
        if not matching:
            return 404, {"error": f"there is nothing at {path}"}
        for verb, m, make in matching:
            if verb == method:
                try:
                    name, arguments = make(*m.groups())
                    return (200, self.call(name, arguments, headers.get("traceparent"))) if name else (200, {"status": "up", "catalog": self.gateway.catalog.digest()})
                except BadCall as e:
                    return 400, {"error": str(e)}
        return 405, {"error": f"{path} takes {', '.join(sorted({v for v, _, _ in matching}))}"}

    @staticmethod
    def _object(body: str) -> dict:
        try:
            found = json.loads(body)
        except ValueError:
            raise BadCall("the body is no JSON") from None
        if not isinstance(found, dict):
            raise BadCall("the body is no object")
        return found

    # JSON-RPC.

    def message(self, text: str) -> dict | None:
        """The answer to one message; None for a notification."""
        try:
            asked = json.loads(text)
        except ValueError:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        if not isinstance(asked, dict) or not isinstance(asked.get("method"), str) or not isinstance(asked.get("params", {}), dict):
            return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no request"}}
        if "id" not in asked:
            return None
        out, params = {"jsonrpc": "2.0", "id": asked["id"]}, asked.get("params", {})
        if asked["method"] == "initialize":
            return out | {"result": {"capabilities": {"tools": {}}, "serverInfo": {"name": "sluice"}}}
        if asked["method"] == "tools/list":
            return out | {"result": {"tools": specifications()}}
        if asked["method"] != "tools/call":
            return out | {"error": {"code": -32601, "message": f"there is no method {asked['method']}"}}
        try:
            found = self.call(str(params.get("name")), params.get("arguments"), (params.get("_meta") or {}).get("traceparent"))
        except BadCall as e:
            return out | {"error": {"code": -32602, "message": str(e)}}
        content = [{"type": "text", "text": json.dumps(found, default=str)}]
        return out | {"result": {"content": content, "isError": found["status"] != "executed", "structuredContent": json.loads(content[0]["text"])}}

    def serve(self, lines: Iterable[str], out: TextIO) -> None:
        """Answers messages line by line until the stream ends."""
        for line in lines:
            if line.strip() and (found := self.message(line)) is not None:
                out.write(json.dumps(found, default=str) + "\n")
                out.flush()


def shown(outcome: Outcome) -> dict:
    """An outcome as plain data."""
    return {
        "status": outcome.status, "reasons": [r.__dict__ for r in outcome.reasons], "cost": outcome.cost and {"bytes": outcome.cost.bytes, "rows": outcome.cost.rows, "files": outcome.cost.files},
        "columns": list(outcome.columns), "rows": [list(r) for r in outcome.rows], "truncated": outcome.truncated, "masked": list(outcome.masked), "duration_ms": outcome.duration_ms,
    }
