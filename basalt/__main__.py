"""Commands over an indexed project: python -m basalt <command> --store FOLDER.

index ROOT | sync ROOT --from FOLDER | stats | search QUERY | node ID | callers ID | callees ID | blast ID |
path FROM TO | dead | hubs | primer | architecture | export. Results are JSON lines.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.operators import packets, scan, search, snapshots, structure, traversal
from basalt.plans.index import Store, index, texts
from basalt.sources import files, git

#: Rows that a command without a limit of its own prints.
MOST_ROWS = 1000


def found(spark: SparkSession, root: str) -> DataFrame:
    """Files of a folder, without those that git or the ignore files leave out."""
    scanned = texts(files.scan(spark, root))
    listed = git.listed_files(spark, root)
    return git.not_ignored(scanned, git.ignore_rules(root)) if listed is None else scanned.join(listed.select("path"), "path", "left_semi")


def _live(s: Store) -> DataFrame:
    return scan.live(s.nodes)


COMMANDS: dict[str, Callable[[Store, argparse.Namespace], DataFrame]] = {
    "stats": lambda s, a: traversal.stats(s.nodes, s.edges),
    "search": lambda s, a: search.facade(_live(s).where("kind <> 'file'"), s.tags, s.edges, a.words[0], a.limit),
    "node": lambda s, a: scan.by_id(s.nodes, a.words[0]),
    "callers": lambda s, a: traversal.callers(_live(s), s.edges.where("kind = 'CALLS'"), a.words[0], limit=a.limit),
    "callees": lambda s, a: traversal.callees(_live(s), s.edges.where("kind = 'CALLS'"), a.words[0], a.limit),
    "blast": lambda s, a: traversal.blast_radius(_live(s), s.edges.where("kind = 'CALLS'"), a.words[0], a.depth),
    "path": lambda s, a: traversal.shortest_path(s.edges, a.words[0], a.words[1]),
    "dead": lambda s, a: structure.dead_code(s.nodes, s.edges, s.tags),
    "hubs": lambda s, a: structure.hubs(s.edges),
    "primer": lambda s, a: packets.primer(_live(s), s.edges),
    "architecture": lambda s, a: structure.architecture(_live(s), s.edges),
    "export": lambda s, a: snapshots.export_graph(s.nodes, s.edges),
}


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    """The rows of a command."""
    p = argparse.ArgumentParser(prog="basalt", description=__doc__)
    p.add_argument("command", choices=["index", "sync", *COMMANDS])
    p.add_argument("words", nargs="*")
    p.add_argument("--store", required=True)
    p.add_argument("--from", dest="last")
    p.add_argument("--project", default="project")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--depth", type=int, default=3)
    a = p.parse_args(argv)
    need = {"search": 1, "node": 1, "callers": 1, "callees": 1, "blast": 1, "path": 2, "index": 1, "sync": 1}.get(a.command, 0)
    if len(a.words) != need or (a.command == "sync") != (a.last is not None):
        p.error(f"{a.command} takes {need} words" + (" and --from" if a.command == "sync" else ""))
    if a.command not in COMMANDS:
        old = Store(spark, a.last) if a.last else None
        store = index(found(spark, a.words[0]), a.store, a.project, int(time.time()), old)
        return traversal.stats(store.nodes, store.edges)
    return COMMANDS[a.command](Store(spark, a.store), a)


def main() -> None:
    spark = SparkSession.builder.appName("basalt").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    rows = run(spark, sys.argv[1:])
    for r in rows.select(F.to_json(F.struct("*")).alias("j")).limit(MOST_ROWS).collect():
        print(r["j"])


if __name__ == "__main__":
    main()
