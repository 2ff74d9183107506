"""python -m symbolary.cli build|overview|vocab|query: a map of a folder from the command line."""

from __future__ import annotations

import argparse
import sys


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="symbolary")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="scan, parse, resolve and group a folder")
    b.add_argument("path")
    b.add_argument("--out", help="default: symbolary-out/map below the current folder; never inside the corpus")
    for name, text in (("overview", "groups and most connected symbols"), ("vocab", "names or words that can be asked for"), ("query", "answer a question")):
        s = sub.add_parser(name, help=text)
        s.add_argument("--map", default="symbolary-out/map")
        if name == "overview":
            s.add_argument("--top", type=int, default=10)
        elif name == "vocab":
            s.add_argument("--contains", default="")
            s.add_argument("--limit", type=int, default=60)
            s.add_argument("--words", action="store_true")
        else:
            s.add_argument("terms", nargs="+")
            s.add_argument("--budget", type=int, default=2000)
            s.add_argument("--per-node", type=int, default=10)
    args = p.parse_args(argv)

    from pyspark.sql import SparkSession

    from symbolary.session import Map
    from symbolary.sources.asks import out_path

    spark = SparkSession.builder.appName("symbolary").getOrCreate()
    try:
        if args.command == "build":
            built = Map.build(spark, args.path)
            built.save(out_path(args.path, args.out))
            for r in built.report().orderBy("what", "value").collect():
                print(f"{r.what} {r.value}: {r.n}")
            for r in built.failed.orderBy("path").limit(50).collect():
                print(f"{r.row}: {r.path} ({r.name})")
            return 0
        held = Map.open(spark, args.map)
        if args.command == "overview":
            groups, gods = held.overview(args.top)
            for r in groups.collect():
                print(f"{r.name} ({r.size})")
            for r in gods.limit(args.top).collect():
                print(f"{r.label} {r.file}:L{r.line} {r.connections}")
        elif args.command == "vocab":
            for r in held.vocabulary(args.contains, args.limit, args.words).collect():
                print(*r)
        else:
            print(held.answer(" ".join(args.terms), args.budget, args.per_node))
    except (FileNotFoundError, ValueError) as e:
        sys.exit(f"symbolary: {e}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
