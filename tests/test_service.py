"""The durable log, tools over transports, contracts, telemetry, and what the catalog checks about views."""

import io
import json
import sqlite3

import pytest

from sluice.governance import ask, audit, catalog, contracts, gateway, mutate, policy, service, telemetry
from sluice.governance.model import Level, Principal
from sluice.governance.store import FIELDS, Store
from sluice.operators.governed import PEPPER
from sluice.plans import lineage


@pytest.fixture(scope="module")
def own(spark, data):
    return catalog.of_folder(spark, data, ("nation", "customer", "orders", "lineitem", "supplier"))


@pytest.fixture
def store(tmp_path):
    found = Store(str(tmp_path / "log.db"))
    yield found
    found.close()


@pytest.fixture
def tools(own, store):
    return service.Service(gateway.Gateway(own, Principal("analyst"), PEPPER, store))


def test_the_log_survives_and_takes_no_change(spark, store, tmp_path):
    for i in range(5):
        store.append(operation="run", status="executed", sql=f"SELECT {i}")
    seq, digest = store.anchor()
    again = Store(store.path)
    again.append(operation="decide", status="rejected", sql="x")
    assert again.anchor()[0] == 6 and again.holds(seq, digest) and not again.holds(seq, "0" * 64) and store.counts() == {"executed": 5, "rejected": 1, "over_budget": 0, "failed": 0}
    for change in ("UPDATE audit SET body = '{}'", "DELETE FROM audit", "INSERT OR REPLACE INTO audit SELECT 3, status, prev, 'f', body FROM audit WHERE seq = 3", "INSERT INTO audit VALUES (9, 'executed', 'a', 'b', '{}')", "INSERT INTO audit VALUES (7, 'executed', 'a', 'b', '{}')"):
        with pytest.raises(sqlite3.IntegrityError):
            store.db.execute(change)
    assert store.export(str(tmp_path / "log.json")) == 6 and audit.faults(audit.read(spark, f"file://{tmp_path}/log.json")).count() == 0
    rows = [list(r) for r in store]
    rows[2][4] = rows[2][4].replace("SELECT 2", "SELECT 9")
    assert [tuple(r) for r in audit.faults(spark.createDataFrame(rows, audit.SCHEMA)).collect()] == [(3, "content")]
    with pytest.raises(ValueError):
        store.append(status="executed", nonsense=1)
    assert len(json.loads(rows[0][4])) == len(FIELDS) + 1  # and its number


def test_the_log_agrees_with_the_executor(tools, store):
    for text in ("SELECT n_name FROM nation", "SELECT nope FROM nation", "SELECT count(*) AS n FROM orders"):
        tools.call("run_query", {"sql": text})
    tools.call("explain_cost", {"sql": "SELECT n_name FROM nation"})
    assert store.reconcile(tools.gateway.executions) == {"logged": 2, "executed": 2, "equal": True} and not store.reconcile(3)["equal"]
    last = json.loads(list(store)[2][4])
    assert last["tables"] == ["orders"] and last["decision"] == "execute" and last["catalog"] == tools.gateway.catalog.digest()


def test_tools(tools):
    assert {t["name"] for t in service.specifications()} == set(service.TOOLS) and all(t["inputSchema"]["additionalProperties"] is False for t in service.specifications())
    assert tools.call("list_tables")["tables"] == ["customer", "lineitem", "nation", "orders", "supplier"]
    assert tools.call("describe_table", {"table": "nope"})["status"] == "rejected" and tools.call("sample_table", {"table": "nation", "n": 2})["rows"][1][0] == 1
    for name, arguments in (("nope", {}), ("decide", {}), ("decide", {"sql": 3}), ("decide", {"sql": ""}), ("decide", []), ("decide", {"sql": "SELECT 1 AS a", "x": 1}), ("sample_table", {"table": "nation", "n": 101}), ("sample_table", {"table": "nation", "n": True})):
        with pytest.raises(service.BadCall):
            tools.call(name, arguments)
    for claim in ("role", "Role", "on-behalf-of", "principal"):
        with pytest.raises(service.BadCall, match="caller"):
            tools.call("run_query", {"sql": "SELECT 1 AS a", claim: "admin"})


def test_costly_statements_ask_once(tools, monkeypatch):
    monkeypatch.setitem(policy.BUDGETS, "analyst", policy.Budget(10, 1_000_000_000, 50))
    text = "SELECT l_orderkey FROM lineitem"
    asked = tools.call("run_query", {"sql": text})
    assert asked["status"] == "over_budget" and tools.gateway.executions == 0
    with pytest.raises(service.BadCall):
        tools.call("run_query", {"sql": "SELECT l_partkey FROM lineitem", "confirmation": asked["confirmation"]})
    asked = tools.call("run_query", {"sql": text})
    assert tools.call("run_query", {"sql": text, "confirmation": asked["confirmation"]})["status"] == "executed"
    with pytest.raises(service.BadCall):
        tools.call("run_query", {"sql": text, "confirmation": asked["confirmation"]})
    assert tools.call("run_query", {"sql": text})["status"] == "over_budget" and tools.gateway.executions == 1


def test_transports_say_the_same(tools):
    header = "00-" + "a" * 32 + "-" + "b" * 16 + "-01"
    status, http = tools.respond("POST", "/query", json.dumps({"sql": "SELECT n_nationkey FROM nation LIMIT 3"}), {"Traceparent": header})
    rpc = tools.message(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "run_query", "arguments": {"sql": "SELECT n_nationkey FROM nation LIMIT 3"}, "_meta": {"traceparent": header}}}))
    assert status == 200 and http["trace"] == "a" * 32 and {k: v for k, v in http.items() if k != "duration_ms"} == {k: v for k, v in rpc["result"]["structuredContent"].items() if k != "duration_ms"}
    assert tools.respond("POST", "/query", json.dumps({"sql": "DROP TABLE nation"}))[1]["reasons"][0]["rule"] == "R010"
    want = {("GET", "/health"): 200, ("GET", "/tables"): 200, ("GET", "/tables/nation"): 200, ("POST", "/tables/nation/sample"): 200, ("GET", "/query"): 405, ("GET", "/nowhere"): 404, ("POST", "/query"): 400}
    assert {k: tools.respond(*k)[0] for k in want} == want
    out = io.StringIO()
    tools.serve(["not json\n", "\n", '{"jsonrpc": "2.0", "method": "notifications/initialized"}', '{"id": 1, "method": "initialize"}', '{"id": 2, "method": "tools/list"}', '{"id": 3, "method": "nope"}', '{"id": 4, "method": "tools/call", "params": {"name": "run_query", "arguments": {"sql": "SELECT 1 AS a", "role": "admin"}}}', "[]"], out)
    found = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x.get("error", {}).get("code") for x in found] == [-32700, None, None, -32601, -32602, -32600]


@pytest.mark.parametrize("header, want", [
    ("00-" + "a" * 32 + "-" + "b" * 16 + "-01", ("a" * 32, "b" * 16, True)), ("00-" + "a" * 32 + "-" + "b" * 16 + "-00", ("a" * 32, "b" * 16, False)), ("cc-" + "a" * 32 + "-" + "b" * 16 + "-01-more", ("a" * 32, "b" * 16, True)),
    ("00-" + "a" * 32 + "-" + "b" * 16 + "-01-more", None), ("ff-" + "a" * 32 + "-" + "b" * 16 + "-01", None), ("00-" + "0" * 32 + "-" + "b" * 16 + "-01", None), ("00-" + "a" * 32 + "-" + "0" * 16 + "-01", None), ("", None), (None, None), ("00-xyz", None),
])
def test_traceparent(header, want):
    assert service.traceparent(header) == want


def test_telemetry_drops_rather_than_waits():
    t = telemetry.Telemetry(most=2)
    answer = t.model(lambda p: p.upper(), "echo", "t" * 32)
    assert [answer(x) for x in "abc"] == ["A", "B", "C"]
    with pytest.raises(KeyError), t.span("tool"):
        raise KeyError("x")
    spans, lost = t.drain()
    assert len(spans) == 2 and lost == 2 and spans[0]["attributes"] == {"model.name": "echo", "prompt.chars": 1, "answer.chars": 1} and t.drain() == ([], 0)
    with pytest.raises(KeyError), t.span("tool"):
        raise KeyError("x")
    assert t.drain()[0][0]["attributes"] == {"error.type": "KeyError"}


def test_contracts(own, monkeypatch):
    for name in ("COLUMNS", "BUDGETS", "GLOSSARY"):
        monkeypatch.setattr(policy, name, dict(getattr(policy, name)))
    source = contracts.current()
    source["columns"] = {k: v for k, v in source["columns"].items() if k.partition(".")[0] in own.columns}
    first = contracts.compiled(source, own)
    assert contracts.compiled(json.loads(json.dumps(source)), own).digest == first.digest == contracts.signed(first.text, first.digest).digest
    with pytest.raises(contracts.Invalid):
        contracts.signed(first.text + " ", first.digest)
    bad = json.loads(json.dumps(source))
    bad["columns"]["customer.nope"] = bad["columns"]["customer.c_name"]
    bad["columns"]["orders.o_orderdate"] = {"levels": dict.fromkeys(policy.ROLES, "mask"), "mask": "keep_last", "argument": "x"}
    bad["columns"]["orders.o_orderkey"] = {"levels": {"analyst": "often"}}
    bad["budgets"]["admin"]["soft_bytes"] = 10**12
    with pytest.raises(contracts.Invalid) as e:
        contracts.compiled(bad, own)
    assert len(e.value.faults) == 5
    source["columns"]["nation.n_name"] = {"levels": dict.fromkeys(policy.ROLES, "mask"), "mask": "redact"}
    contracts.enforce(contracts.compiled(source, own))
    assert {r[0] for r in gateway.Gateway(own, Principal("admin"), PEPPER).run("SELECT n_name FROM nation").rows} == {"***"}


def test_glossary_terms_of_the_question_are_in_the_prompt(own):
    g = gateway.Gateway(own, Principal("analyst"), PEPPER)
    found = ask.prompt(g, "How many buyers and what order value?")
    assert "buyer: " in found and "order value: " in found and "active user" not in found and "Terms" not in ask.prompt(g, "How many nations?")


def test_views_in_any_order_and_what_they_loosen(spark, data, monkeypatch):
    paths = {"customer": f"{data}/customer.parquet"}
    own = catalog.of_statements(spark, paths, {"a_last": "SELECT loud FROM z_first", "z_first": "SELECT upper(c_name) AS loud FROM customer"})
    assert own.columns["a_last"][0].lineage == ("customer.c_name",) and own.violations() == []
    monkeypatch.setitem(policy.COLUMNS, "a_last.loud", policy.Rule((Level.ALLOW, Level.MASK, Level.DENY, Level.ALLOW), "redact"))
    assert own.violations() == [("a_last.loud", "customer.c_name", "analyst")]
    with pytest.raises(ValueError, match="a, b"):
        catalog.of_statements(spark, paths, {"a": "SELECT 1 AS x FROM b", "b": "SELECT 1 AS x FROM a"})
    assert lineage.order({"c": {"b"}, "b": {"a", "table"}, "a": set(), "x": {"y"}, "y": {"x"}, "z": {"x"}}) == (["a", "b", "c"], ["x", "y", "z"])


def test_recovery_corpus():
    seeds = [("q", "SELECT c_name FROM customer WHERE c_name = 'x'", "SELECT c_name FROM customer")]
    found = mutate.recovery(seeds, 5)
    assert found == mutate.recovery(seeds, 5) and len(set(found)) == len(found) > 8 and seeds[0] in found and all(q == "q" and right == seeds[0][2] for q, _, right in found)


def test_plans_of_the_bank_hold_no_unbounded_broadcast(spark, data):
    from sluice import bank

    plan = lambda name: bank.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    for name in (n for n in bank.QUERIES if n.startswith("check_")):
        assert "isNullAwareAntiJoin" not in plan(name) and ", true" not in "".join(x for x in plan(name).splitlines() if "LeftAnti" in x), name
    assert "Window" not in plan("business_day_roll") and "Window" not in plan("share_of_total") and "PushedAggregation: [COUNT(*)" in plan("metadata_count") and "Python" not in plan("mask_hash")
