"""Command line: ``python -m quern index|stats|search ROOT STORE [QUERY]``."""

from __future__ import annotations

import argparse
import json

from quern.plans.indexer import Indexer, as_dict
from quern.plans.tools import TOOLS
from quern.runtime import get_spark


def main() -> None:
    parser = argparse.ArgumentParser(prog="quern")
    parser.add_argument("command", choices=["index", "stats", "search"])
    parser.add_argument("root")
    parser.add_argument("store")
    parser.add_argument("query", nargs="?", default="")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--tool", default="hybrid_search_v2", choices=list(TOOLS))
    args = parser.parse_args()
    index = Indexer(get_spark("quern"), args.root, args.store)
    if args.command == "index":
        print(json.dumps(as_dict(index.index(args.force))))
    elif args.command == "stats":
        print(json.dumps(index.stats()))
    else:
        for row in TOOLS[args.tool](index, args.query):
            print(json.dumps(row, default=str))


if __name__ == "__main__":
    main()
