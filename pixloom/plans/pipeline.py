"""From a scanned tree to a library: every decision as a table, then the effects of that table."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixloom.effects import carry_out, files_in, hashed
from pixloom.functions import dates as D
from pixloom.functions import filetypes as T
from pixloom.functions import paths as P
from pixloom.functions import sidecar_names as S
from pixloom.functions.records import ref_id
from pixloom.operators import motion, placement, tags, verify
from pixloom.operators.albums import album_names
from pixloom.operators.winners import album_manifest, dedup_summary, select_winners
from pixloom.plans import tools
from pixloom.session import materialise
from pixloom.sources.files import listing, scan
from pixloom.sources.probe import probe

# Fixed value: where a library keeps what runs leave for one another.
STATE = "pixloom-state"


@dataclass(frozen=True)
class Options:
    min_year: int = D.MIN_YEAR
    max_year: int | None = None
    fix_extensions: bool = True
    motion: str = "archive"  # archive, drop, keep, errors
    include_undated: bool = False
    albums: str = "link"  # link, copy, manifest, none
    near_dupes: str = "off"  # scan, defer, off


def outcomes(
    copies: DataFrame, orphans: DataFrame, docs: DataFrame, embedded: DataFrame, options: Options = Options(), chosen: DataFrame | None = None, root: str = "/"
) -> DataFrame:
    """One row per content: outcome, reason, folder, out_name, sidecar, source (a record id) and what it was decided from.

    embedded(path, original, created, duration) holds what the files themselves say, by record id.
    chosen is what select_winners gives, if that is at hand. Files in error are mirrored below `errors` by their place below root.
    """
    chosen = select_winners(copies, orphans, docs) if chosen is None else chosen
    types = copies.where("sha256 is not null").groupBy(F.lower("sha256").alias("sha256")).agg(F.max("true_ext").alias("true_ext"))
    texts = docs.select(ref_id("ref").alias("sidecar"), "raw")
    rows = chosen.join(types, "sha256", "left").join(texts, "sidecar", "left").join(embedded.withColumnRenamed("path", "place"), "place", "left")
    rows = motion.is_motion(rows)
    clip = motion.disposition(F.col("motion"), F.col("sidecar").isNotNull(), options.motion)
    day = D.date_waterfall(
        D.sidecar_date(F.col("raw"), options.min_year, options.max_year),
        D.embedded_date(D.embedded_text(F.col("original"), F.col("created")), options.min_year, options.max_year),
        F.col("sidecar").isNotNull(),
        options.include_undated,
    )
    rows = rows.withColumn("clip", clip).withColumn("day", day)
    name = T.corrected_name(F.col("name"), F.col("true_ext")) if options.fix_extensions else F.col("name")
    outcome = (
        F.when(F.col("clip").isNotNull(), F.when(F.col("clip") == "errors", "errored").otherwise("motion"))
        .when(F.col("day.outcome") == "error", "errored")
        .when(F.col("bucket") == "archive", "archived")
        .when(F.col("bucket") == "trash", "trashed")
        .otherwise("placed")
    )
    reason = F.when(F.col("clip") == "errors", F.lit("motion clip of a still")).when(F.col("day.outcome") == "error", F.lit("no sidecar and no embedded date"))
    rows = rows.withColumn("outcome", outcome).withColumn("out_name", F.when(F.col("outcome") == "errored", F.col("name")).otherwise(name))
    packed = F.contains("place", F.lit("::"))
    inside = F.substring_index("place", "::", 1)
    mirrored = P.errors_path(F.when(packed, "zip").otherwise("dir"), F.col("place"), inside, F.substr("place", F.length(inside) + 3), root)
    folder = (
        F.when(F.col("outcome") == "errored", F.concat_ws("/", F.lit("errors"), F.nullif(P.folder_of(mirrored), F.lit(""))))
        .when(F.col("clip") == "drop", F.lit(None))
        .when(F.col("outcome") == "motion", F.lit("motion"))
        .otherwise(placement.dest_folder(F.col("bucket"), F.col("out_name"), F.col("day.year"), F.col("day.month")))
    )
    return rows.withColumn("folder", folder).select(
        "sha256", "scan_ord", "outcome", F.when(F.col("outcome") == "errored", reason).alias("reason"), "folder", "out_name", F.col("place").alias("source"), "sidecar", "recovered", "albums", "n_copies", "raw"
    )


def beside(rows: DataFrame, output: str, order: list[str], name: str) -> DataFrame:
    """rows(folder, name, sha256, ...) with final_name and present, with regard to the files that lie in the folders of output already."""
    files = materialise(files_in(rows, output), "files")
    hashes = materialise(hashed(placement.may_be_reused(rows, files, name), output), "hashes")
    return placement.number_beside(rows, files, hashes, order, name)


def effects(rows: DataFrame, output: str) -> DataFrame:
    """(rel_path, outcome) of rows(source, rel_path, action, present): what is present is left alone, the others are carried out."""
    return carry_out(rows.where("not present"), output).unionByName(rows.where("present").select("rel_path", F.lit("present").alias("outcome")))


def undated(chosen: DataFrame, docs: DataFrame, options: Options = Options()) -> DataFrame:
    """(path): the record ids of the winners without a plausible date in a sidecar, own or recovered, which the files must tell."""
    dated = docs.where(D.sidecar_date(F.col("raw"), options.min_year, options.max_year).isNotNull()).select(ref_id("ref").alias("sidecar"))
    return chosen.join(dated, "sidecar", "left_anti").select(F.col("place").alias("path")).distinct()


def inventory(spark: SparkSession, source: str, output: str, rescan: bool, keep: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(copies, orphans, docs, errors) of the source: scanned, or as an earlier scan of it left them in the library."""
    names = ("copies", "orphans", "docs", "errors")
    at = f"{output}/{STATE}/scan-{hashlib.sha256(source.encode()).hexdigest()[:16]}"
    if not rescan and os.path.exists(f"{at}/errors/_SUCCESS"):
        return tuple(spark.read.parquet(f"{at}/{n}") for n in names)
    tables = [materialise(df, n) for n, df in zip(names, scan(spark, source))]
    if keep:
        for n, df in zip(names, tables):  # errors last: it tells that all are whole
            df.write.mode("overwrite").parquet(f"{at}/{n}")
    return tuple(tables)


def finished(spark: SparkSession, output: str) -> DataFrame:
    """(sha256, rel_path): contents that earlier runs brought to an end, whose file still lies there with its length."""
    at = f"{output}/{STATE}/done"
    schema = "sha256 string, outcome string, rel_path string, length bigint"
    if not os.path.isdir(at):
        return spark.createDataFrame([], schema).select("sha256", "rel_path")
    done = spark.read.schema(schema).parquet(*[f"{at}/{n}" for n in os.listdir(at) if os.path.exists(f"{at}/{n}/_SUCCESS")])
    there = below(spark, output).select("rel_path", "length")
    held = done.where("rel_path is not null").join(there, ["rel_path", "length"], "left_semi")
    return held.groupBy("sha256").agg(F.min("rel_path").alias("rel_path"))


def below(spark: SparkSession, output: str) -> DataFrame:
    """(rel_path, length) of the media files in the library."""
    rel = F.substr("path", F.lit(len(output.rstrip("/")) + 2))
    return listing(spark, output).select(rel.alias("rel_path"), "length").where(T.is_media(P.base_name(F.col("rel_path"))))


def sidecar_moves(plan: DataFrame) -> DataFrame:
    """(source, rel_path, action, media): the sidecar of each content beside its file, unless something is there already."""
    name = S.sidecar_dest(P.base_name(F.col("rel_path")), P.base_name(F.col("sidecar")))
    rows = plan.where("sidecar is not null and outcome in ('placed', 'archived', 'trashed')")
    return rows.select(F.col("sidecar").alias("source"), F.concat_ws("/", P.folder_of(F.col("rel_path")), name).alias("rel_path"), F.lit("keep").alias("action"), F.col("rel_path").alias("media"))


def report_lines(checks: DataFrame, verdict: DataFrame, counts: DataFrame) -> DataFrame:
    """(line) of the report: the checks, what failed by category, and the verdict; as many rows as there are checks."""
    line = lambda df, rank, text: df.select(F.lit(rank).alias("o"), text.alias("line"))
    parts = [
        line(checks, 1, F.format_string("[%s] %s: %s = %d", F.upper("status"), "section", "metric", "value")),
        line(counts, 2, F.format_string("errors of category %s: %d", "category", "n")),
        line(verdict, 3, F.when(F.col("safe"), F.lit("All checks passed.")).otherwise(F.format_string("%d check(s) failed: keep the source.", "n_failed"))),
    ]
    return reduce(DataFrame.unionByName, parts).coalesce(1).sortWithinPartitions("o", "line").select("line")


def run(spark: SparkSession, source: str, output: str, options: Options = Options(), dry_run: bool = False, rescan: bool = True) -> dict[str, DataFrame]:
    """Scan source, decide, place under output and check. dry_run stops after the decisions and writes nothing. source is never written.

    What a run has brought to an end is kept in output/pixloom-state and not done again, as long as its file is there; a run that
    was interrupted is taken up where it stopped: files that it had placed are found by their content. rescan=False takes the
    source as the last run saw it.
    """
    source, output = os.path.abspath(source), os.path.abspath(output)
    copies, orphans, docs, scan_errors = inventory(spark, source, output, rescan, keep=not dry_run)
    chosen = materialise(select_winners(copies, orphans, docs), "winners")
    wanted = materialise(undated(chosen, docs, options), "undated")
    embedded = materialise(probe(wanted), "probe")
    decided = materialise(outcomes(copies, orphans, docs, embedded, options, chosen, source), "outcomes")
    kept = materialise(decided.join(finished(spark, output), "sha256"), "kept")
    fresh = beside(decided.join(kept.select("sha256"), "sha256", "left_anti"), output, ["scan_ord"], "out_name")
    fresh = materialise(fresh.withColumn("rel_path", F.concat("folder", F.lit("/"), "final_name")), "fresh")
    plan = fresh.unionByName(kept.withColumn("final_name", P.base_name(F.col("rel_path"))).withColumn("present", F.lit(True)))
    summary = dedup_summary(chosen)
    missing = plan.where("outcome = 'errored'").select(F.lit("missing_sidecar").alias("category"), F.col("source").alias("ident"), F.col("reason").alias("detail"))
    out = {"plan": plan, "summary": summary, "errors": scan_errors.unionByName(missing), "tags": tags.tag_plan(plan.select(F.col("sha256").alias("id"), F.col("out_name").alias("name"), "raw"), options.min_year)}
    if dry_run:
        return out
    os.makedirs(output, exist_ok=True)
    moves = fresh.where("folder is not null").select("source", "rel_path", F.lit("copy").alias("action"), "present")
    new = materialise(effects(moves, output), "effects")
    out["effects"] = new.unionByName(kept.where("rel_path is not null").select("rel_path", F.lit("present").alias("outcome")))
    ended = materialise(fresh.join(new.where("not startswith(outcome, 'failed')").select("rel_path"), "rel_path", "left_semi"), "ended")
    sidecars = materialise(sidecar_moves(ended), "sidecars")
    out["sidecar_effects"] = materialise(carry_out(sidecars, output), "sidecar_effects")
    bare = sidecars.join(out["sidecar_effects"].where("startswith(outcome, 'failed')"), "rel_path").select(F.col("media").alias("rel_path"))
    failed = fresh.select("source", "rel_path").join(new.where("startswith(outcome, 'failed')"), "rel_path").select(F.lit("extract_error").alias("category"), F.col("source").alias("ident"), F.col("outcome").alias("detail"))
    beside_failed = out["sidecar_effects"].where("startswith(outcome, 'failed')").select(F.lit("sidecar_error").alias("category"), F.col("rel_path").alias("ident"), F.col("outcome").alias("detail"))
    out["errors"] = materialise(out["errors"].unionByName(failed).unionByName(beside_failed), "errors")
    # what lies there now, by its own length, not by what was planned
    there = materialise(below(spark, output), "there")
    ended.select("sha256", "outcome", "rel_path").join(there, "rel_path").join(bare, "rel_path", "left_anti").write.parquet(f"{output}/{STATE}/done/{_next(f'{output}/{STATE}/done')}")
    placed = plan.where("outcome = 'placed'")
    files = there.join(out["effects"].where("not startswith(outcome, 'failed')").select("rel_path"), "rel_path", "left_semi").join(placed.select("rel_path"), "rel_path", "left_semi").select("rel_path")
    out["checks"] = materialise(verify.count_checks(copies, placed, files).unionByName(verify.undated_check(files)).unionByName(verify.errors_check(plan.where("outcome = 'errored'"))), "checks")
    out["verdict"] = verify.verdict(out["checks"])
    if options.albums in ("link", "copy"):
        links = materialise(beside(materialise(album_names(placed, output), "names"), output, ["sha256"], "name"), "links")
        links = links.select("source", F.concat_ws("/", "folder", "final_name").alias("rel_path"), F.lit(options.albums).alias("action"), "present")
        out["album_effects"] = materialise(effects(links, output), "album_effects")
    if options.albums != "none":
        out["albums"] = album_manifest(placed.select("albums", F.col("rel_path").alias("place")))
        if options.albums == "manifest":
            out["albums"].write.mode("overwrite").json(f"{output}/{STATE}/albums")
    if options.near_dupes != "off":
        out["near_dupes"] = tools.prepare_review(spark, output, options.near_dupes == "scan")
    out["errors"].write.mode("overwrite").json(f"{output}/{STATE}/errors")
    report_lines(out["checks"], out["verdict"], verify.error_counts(out["errors"])).write.mode("overwrite").text(f"{output}/{STATE}/report")
    return out


def _next(folder: str) -> int:
    """The next free number of a folder of numbered tables."""
    return 1 + max((int(n) for n in os.listdir(folder) if n.isdigit()), default=-1) if os.path.isdir(folder) else 0
