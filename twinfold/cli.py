"""``python -m twinfold -s SOURCES -t TARGETS``: find and, if told so, delete target files whose content is archived."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from twinfold.config import Deletion, Hashing, Scan, admitted
from twinfold.operators import report
from twinfold.plans import scan


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="twinfold", description=__doc__)
    p.add_argument("-s", "--source", action="append", default=[], help="directory with archives (repeatable)")
    p.add_argument("-t", "--target", action="append", default=[], help="directory with files (repeatable)")
    p.add_argument("--db-path", default="twinfold-store", help="folder of the snapshots")
    p.add_argument("--no-keep-db", action="store_true", help="clear the snapshots at the end")
    p.add_argument("--recheck", action="store_true", help="unpack all archives again")
    p.add_argument("--recheck-targets", action="store_true", help="hash all targets again")
    p.add_argument("--search-archives", action="store_true", help="match members of archives among the targets too")
    p.add_argument("--delete", action="store_true", help="delete what is planned; without it nothing is changed")
    p.add_argument("--dry-run", action="store_true", help="change nothing (the default)")
    p.add_argument("--auto", action="store_true", help="accepted; there is no other mode")
    p.add_argument("--delete-method", choices=("trash", "permanent"), default="trash")
    p.add_argument("--no-auto-select", action="store_true", help="select only what the store says")
    p.add_argument("--min-size", type=int, default=0)
    p.add_argument("--partial-threshold", type=int, default=1 << 20)
    p.add_argument("--prefix-size", type=int, default=8 << 10)
    p.add_argument("--workers", type=int, help="tasks at a time (local sessions)")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--trust-folders", action="store_true", help="pass over folders of targets whose time did not change (files rewritten in place are not seen)")
    p.add_argument("--progress", action="store_true", help="say every second how far the scan is")
    return p


def config_of(a: argparse.Namespace) -> Scan:
    return Scan(
        archives_in=tuple(a.source),
        files_in=tuple(a.target),
        store=a.db_path,
        forget=a.no_keep_db,
        least_bytes=a.min_size,
        afresh=frozenset(what for what, told in (("archives", a.recheck), ("files", a.recheck_targets)) if told),
        trust_folders=a.trust_folders,
        look_inside=a.search_archives,
        hashing=Hashing(large=a.partial_threshold, prefix=a.prefix_size),
        deletion=Deletion(carried_out=a.delete and not a.dry_run, way=a.delete_method, unless_stored=not a.no_auto_select),
    )


def directories(given: list[str]) -> tuple[list[str], list[str]]:
    """Those that are admitted, and what is wrong with the others."""
    good, bad = [], []
    for text in given:
        try:
            good.append(admitted(text, good))
        except ValueError as why:
            bad.append(f"{text}: {why}")
    return good, bad


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, filename="twinfold.log")
    (a.source, bad_sources), (a.target, bad_targets) = directories(a.source), directories(a.target)
    config = config_of(a)
    if faults := [*bad_sources, *bad_targets, *config.faults()]:
        print("\n".join(faults), file=sys.stderr)
        return 1
    builder = SparkSession.builder.appName("twinfold")
    if a.workers:
        builder = builder.master(f"local[{a.workers}]")
    told = (lambda now: print(f"{now['phase']}: {now['archives_done']} of {now['archives_found'] or 0} archives, {now['members_done']} members, {now['targets_done']} targets", file=sys.stderr)) if a.progress else None
    done = scan.run(builder.getOrCreate(), config, told)
    print(", ".join(f"{name}: {n}" for name, n in done.counters.items()))
    if unread := done.unread.count():
        print(f"could not be read: {unread}")
        done.unread.orderBy("source_archive", "path_in_archive").show(50, truncate=False)
    done.by_archive.orderBy("source_archive").show(50, truncate=False)
    done.summary.show(truncate=False)
    report.outcome_counts(done.outcomes).show(truncate=False)
    return 0
