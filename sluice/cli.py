"""Command line: ``python -m sluice.cli catalog|run|decide|explain|sample|describe|serve|verify|reconcile|anchor|contract``.

``--log`` names the audit store, an SQLite file. ``serve`` answers JSON-RPC messages line by line from standard input.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "labels")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sluice")
    p.add_argument("command", choices=("catalog", "run", "decide", "explain", "sample", "describe", "serve", "verify", "reconcile", "anchor", "contract"))
    p.add_argument("what", nargs="?", default="", help="a statement, a table, a count of executions, or an anchor as number:hash")
    p.add_argument("--folder", default=".", help="folder of the tables")
    p.add_argument("--role", default="analyst")
    p.add_argument("--log", help="file of the audit store")
    p.add_argument("-n", type=int, default=10)
    args = p.parse_args(argv)

    from sluice.governance.store import Store

    if args.command in ("verify", "reconcile", "anchor") and not (args.log and os.path.exists(args.log)):
        p.error("--log must name the audit store")
    if args.command == "reconcile":
        found = Store(args.log).reconcile(int(args.what))
        print(json.dumps(found))
        return int(not found["equal"])
    if args.command == "anchor":
        store = Store(args.log)
        if args.what:
            seq, _, digest = args.what.partition(":")
            stands = store.holds(int(seq), digest)
            print(json.dumps({"stands": stands}))
            return int(not stands)
        print(":".join(map(str, store.anchor())))
        return 0

    from pyspark.sql import SparkSession

    from sluice.governance import audit, catalog, contracts, gateway, masks, service
    from sluice.governance.model import Principal

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "verify":
        store = Store(args.log)
        with tempfile.TemporaryDirectory() as folder:
            n = store.export(f"{folder}/log.json")
            faults = audit.faults(audit.read(spark, f"file://{folder}/log.json")).orderBy("seq").limit(100).collect()
        print(json.dumps({"records": n, "faults": [[f.seq, f.fault] for f in faults], "anchor": store.anchor()}))
        return int(bool(faults))
    own = catalog.of_folder(spark, args.folder, tuple(t for t in TABLES if os.path.exists(f"{args.folder}/{t}.parquet")))
    if args.command == "catalog":
        print(own.canonical() if args.what == "full" else own.digest())
        return 0
    if args.command == "contract":
        found = contracts.compiled(contracts.current())
        print(found.text if args.what == "full" else found.digest)
        return 0
    g = gateway.Gateway(own, Principal(args.role), masks.pepper_from_environment(), Store(args.log) if args.log else None)
    if args.command == "serve":
        service.Service(g).serve(sys.stdin, sys.stdout)
        return 0
    if args.command == "describe":
        g.describe(args.what or None).show(1000, False)
        return 0
    found = g.sample(args.what, args.n) if args.command == "sample" else getattr(g, args.command)(args.what)
    print(json.dumps(service.shown(found), default=str, indent=1))
    return int(found.status != "executed")


if __name__ == "__main__":
    sys.exit(main())
