"""Command line: python -m pixloom.cli organise|verify|similar|fix-extensions|re-folder ..."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import functions as F

from pixloom.functions import dates as D
from pixloom.operators import neardup, verify
from pixloom.plans import tools
from pixloom.plans.pipeline import Options, below, run
from pixloom.session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pixloom")
    sub = p.add_subparsers(dest="what", required=True)
    o = sub.add_parser("organise", help="scan a tree and build a library")
    o.add_argument("--source", required=True)
    o.add_argument("--output", required=True)
    o.add_argument("--min-year", type=int, default=Options.min_year)
    o.add_argument("--no-extension-fix", action="store_true")
    o.add_argument("--live-motion", choices=("archive", "drop", "keep", "errors"), default="archive")
    o.add_argument("--include-undated", action="store_true")
    o.add_argument("--albums", choices=("link", "copy", "manifest", "none"), default="link")
    o.add_argument("--near-dupes", choices=("scan", "defer", "off"), default="defer", help="groups of similar pictures: now, when reviewed, or not")
    o.add_argument("--rescan", action="store_true", help="read the source again, not as the last run saw it")
    o.add_argument("--dry-run", action="store_true")
    v = sub.add_parser("verify", help="check a library against its list of done contents")
    v.add_argument("--inventory", required=True, help="parquet with sha256")
    v.add_argument("--done", required=True, help="parquet with sha256")
    v.add_argument("--final", required=True)
    s = sub.add_parser("similar", help="groups of similar pictures in a folder")
    s.add_argument("--dir", required=True)
    s.add_argument("--distance", type=int, default=neardup.MAX_DISTANCE)
    s.add_argument("--color-distance", type=int, default=neardup.MAX_COLOR)
    s.add_argument("--groups", help="groups that were saved, instead of looking at the pictures")
    s.add_argument("--save", help="where to save the groups")
    s.add_argument("--selection", help="text file of paths to remove, one a line")
    s.add_argument("--removed", help="where removed files are kept (beside the folder by default)")
    f = sub.add_parser("fix-extensions", help="rename files whose extension is not that of their content")
    f.add_argument("--dir", required=True)
    r = sub.add_parser("re-folder", help="move files out of unknown by their embedded date")
    r.add_argument("--final", required=True)
    r.add_argument("--min-year", type=int, default=D.MIN_YEAR)
    for changing in (s, f, r):
        changing.add_argument("--dry-run", action="store_true", help="report what would change, change nothing")
        changing.add_argument("--yes", "-y", action="store_true", help="do not ask")
    return p


def agreed(a: argparse.Namespace, what: str) -> bool:
    """Whether files may be changed where they lie: never in a dry run, at once with --yes, else if the answer is yes."""
    if a.dry_run:
        print("dry run: nothing changed")
        return False
    if a.yes:
        return True
    try:
        answer = input(f"{what} This cannot be undone. Type yes to go on: ")
    except EOFError:
        answer = ""
    if answer.strip().lower() in ("y", "yes"):
        return True
    print("cancelled: nothing changed")
    return False


def _folder(path: str) -> str:
    if not os.path.isdir(path):
        raise SystemExit(f"no such folder: {path}")
    return os.path.abspath(path)


def _moved(moves, root: str) -> int:  # noqa: ANN001 - DataFrame
    done = tools.apply_moves(moves, root)
    done.groupBy(F.substring_index("outcome", ":", 1).alias("outcome")).count().show(truncate=False)
    return 0 if done.where("startswith(outcome, 'failed')").isEmpty() else 2


def main(argv: list[str] | None = None) -> int:
    """0 if all is well, 2 if a check failed."""
    a = parser().parse_args(argv)
    spark = build_session()
    if a.what == "organise":
        options = Options(
            min_year=a.min_year, fix_extensions=not a.no_extension_fix, motion=a.live_motion, include_undated=a.include_undated, albums=a.albums, near_dupes=a.near_dupes
        )
        out = run(spark, _folder(a.source), a.output, options, a.dry_run, a.rescan)
        out["summary"].show(truncate=False)
        if a.dry_run:
            return 0
        out["checks"].show(truncate=False)
        return 0 if out["verdict"].first().safe else 2
    if a.what == "verify":
        files = below(spark, _folder(a.final)).select("rel_path")
        checks = verify.count_checks(spark.read.parquet(a.inventory), spark.read.parquet(a.done), files).unionByName(verify.undated_check(files))
        checks.show(truncate=False)
        return 0 if verify.verdict(checks).first().safe else 2
    if a.what == "fix-extensions":
        moves = tools.extension_moves(spark, _folder(a.dir)).cache()
        moves.groupBy("was", "want").count().orderBy(F.desc("count")).show(truncate=False)
        n = moves.count()
        return _moved(moves, a.dir) if n and agreed(a, f"{n} files in {a.dir} will be renamed.") else 0
    if a.what == "re-folder":
        moves, left = tools.undated_moves(spark, _folder(a.final), a.min_year)
        moves = moves.cache()
        moves.groupBy("year").count().orderBy("year").show()
        n = moves.count()
        print(f"without a usable date: {left.count()}")
        return _moved(moves, a.final) if n and agreed(a, f"{n} files in {a.final} will be moved.") else 0
    root = _folder(a.dir)
    groups = tools.load_groups(spark, a.groups, root) if a.groups else tools.look_alikes(spark, root, a.distance, a.color_distance)
    neardup.group_sizes(groups).orderBy("size").show()
    groups.orderBy("group_id", "rank_no").show(truncate=False)
    if a.save:
        tools.save_groups(groups, root, a.save)
    if a.selection:
        removed = a.removed or os.path.join(os.path.dirname(root), "near-dup-removed")
        moves = tools.removal_moves(groups, spark.read.text(a.selection).select(F.col("value").alias("path")), removed).cache()
        n = moves.count()
        return _moved(moves, removed) if n and agreed(a, f"{n} files will be moved to {removed}.") else 0
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
