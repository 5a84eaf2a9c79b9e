"""Commands: page weights of a link file, and the dump of a store.

    python -m weftline.cli pageweight [-g] [-n NORM] [-r REDIRECTS] [-i ITERATIONS] [--inlinks] LINKS OUT
    python -m weftline.cli dump STORE OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from weftline import __version__
from weftline.operators import pageweight
from weftline.sources import dump, linkfile
from weftline.sources.store import VectorStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("-V", "--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    w = sub.add_parser("pageweight", help="weights of the pages of a link file")
    w.add_argument("-g", "--log", action="store_true", help="logarithmic scale")
    w.add_argument("-n", "--norm", type=int, help="integers up to this value")
    w.add_argument("-r", "--redirects", help="write redirects of undefined pages to this folder")
    w.add_argument("-i", "--iterations", type=int, default=pageweight.ITERATIONS)
    w.add_argument("--inlinks", action="store_true", help="in-link weights instead of PageRank")
    w.add_argument("links")
    w.add_argument("out")
    d = sub.add_parser("dump", help="text of a store")
    d.add_argument("store")
    d.add_argument("out")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "dump":
        dump.write_dump(dump.store_lines(VectorStore.open(spark, args.store)), args.out)
        return
    pages, edges, moved = linkfile.graph(linkfile.rule_targets(linkfile.read_rules(spark, args.links)))
    if args.redirects:
        linkfile.write_redirects(pageweight.redirect_lines(pages, moved), args.redirects)
    weights = pageweight.page_weights(edges, pages, moved, rank=not args.inlinks, iterations=args.iterations, log=args.log, norm=args.norm)
    linkfile.write_weights(weights, args.out)


if __name__ == "__main__":
    main()
