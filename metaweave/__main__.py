"""python -m metaweave: ingest, snapshot, audit, orgs, tool."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession

from . import ingest
from .operators import audit, diff
from .plans import tools
from .store import GraphStore


def _plain(value):
    if isinstance(value, DataFrame):
        return [r.asDict(recursive=True) for r in value.limit(1000).collect()]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


def snapshot(store: GraphStore, o: argparse.Namespace):
    """list, create, diff, prune and delete."""
    if o.action == "create":
        return store.create_snapshot(o.org, o.names[0] if o.names else "manual")
    if o.action == "diff":
        return {t: f(store.snapshot(o.names[0], t, o.org), store.snapshot((o.names + ["current"])[1], t, o.org)) for t, f in (("nodes", diff.diff_nodes), ("edges", diff.diff_edges))}
    if o.action == "prune":
        return store.prune(o.org, o.days, int(time.time() * 1000))
    if o.action == "delete":
        return store.delete_snapshot(o.names[0])
    return store.snapshots(o.org)


def check(store: GraphStore, o: argparse.Namespace):
    """Dangling edges in all, by relation and by prefix; they are deleted only if asked and confirmed."""
    n, e = tools._tables(store, o.org)
    out = {"total": audit.dangling(e, n).count(), "by_relation": audit.dangling_by(e, n, "rel_type"), "by_prefix": audit.dangling_by(e, n, "prefix"), "sample": audit.dangling(e, n).orderBy("src", "dst").limit(max(0, o.sample))}
    out = _plain(out)
    if o.delete_dangling:
        if not o.yes:
            raise SystemExit("--delete-dangling needs --yes")
        out["deleted"] = store.delete_dangling(o.org)
    return out


def main(args: list[str] | None = None):
    p = argparse.ArgumentParser(prog="metaweave", description=__doc__)
    p.add_argument("--store", required=True)
    p.add_argument("--org", default="org1")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("ingest")
    ingest.add_options(c)
    c.add_argument("--rebuild", action="store_true")
    c = sub.add_parser("snapshot")
    c.add_argument("action", choices=["list", "create", "diff", "prune", "delete"])
    c.add_argument("names", nargs="*")
    c.add_argument("--days", type=int, default=30)
    c = sub.add_parser("audit")
    c.add_argument("--sample", type=int, default=25)
    c.add_argument("--delete-dangling", action="store_true")
    c.add_argument("--yes", action="store_true")
    sub.add_parser("orgs")
    c = sub.add_parser("tool")
    c.add_argument("name")
    c.add_argument("inputs", nargs="?", default="{}", help="JSON")
    o = p.parse_args(args)
    store = GraphStore(SparkSession.builder.appName("metaweave").getOrCreate(), o.store)
    if o.command == "ingest":
        if o.rebuild:
            store.rebuild()
        for org, report in ingest.run(store, o.org, o).items():
            print(org, report)
        return None
    if o.command == "tool":
        r = tools.dispatch(o.name, store, **json.loads(o.inputs))
        out = {"summary": r.summary, "data": _plain(r.data), "follow_up_tools": r.follow_up_tools}
    else:
        out = _plain({"snapshot": snapshot, "audit": check, "orgs": lambda s, _: s.list_orgs()}[o.command](store, o))
    print(json.dumps(out, indent=2, default=str))
    return out


if __name__ == "__main__":
    main()
