"""Command line: each command prints a JSON summary."""

from __future__ import annotations

import argparse
import importlib
import json

from litmill import pipeline
from litmill.session import session

#: Clients that a workspace takes; the others are search commands and probes.
SERVICES = ("enricher", "embed", "fetcher", "links", "searches")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="litmill", description=__doc__)
    p.add_argument("--workspace", required=True, help="folder of the workspace's tables")
    p.add_argument("--clients", help="module:function that returns the clients of services by name")
    sub = p.add_subparsers(dest="command", required=True)
    for name in (*pipeline.STAGES, "assist-stage2-llm", "run-all", "check-api-access"):
        sub.add_parser(name)
    for name in ("search-pubmed", "search-wos", "search-psycinfo"):
        sub.add_parser(name).add_argument("--query-key", default="operational")
    return p


def named_clients(place: str) -> dict:
    """The result of a function that is named as module:function."""
    module, _, function = place.partition(":")
    return getattr(importlib.import_module(module), function or "clients")()


def main(args: list[str] | None = None, clients: dict | None = None) -> dict:
    """``clients`` maps search commands to functions of a workspace and a query key, probes to callables by service, and
    the names in SERVICES to what a workspace takes under them."""
    a = parser().parse_args(args)
    clients = clients or (named_clients(a.clients) if a.clients else {})
    if a.command == "check-api-access":
        from litmill.sources.services import access

        out = access(clients.get("probes", {}))
    else:
        w = pipeline.Workspace(session(), a.workspace, **{s: clients[s] for s in SERVICES if s in clients})

        def search(command: str, key: str):
            return lambda: clients[command](w, key)

        if a.command.startswith("search-"):
            out = pipeline.safely(search(a.command, a.query_key))
        elif a.command == "assist-stage2-llm":
            out = pipeline.safely(lambda: pipeline.assist(w))
        elif a.command == "run-all":
            out = pipeline.run_all(w, {c: search(c, "operational") for c in clients if c.startswith("search-")})
        else:
            out = pipeline.STAGES[a.command](w)
    print(json.dumps(out, default=str, ensure_ascii=False, indent=2))
    return out


if __name__ == "__main__":
    main()
