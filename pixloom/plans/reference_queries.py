"""Driver queries of the media-library operators over the domain tables. Their SQL is in reference_sql."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixloom.functions import bits as B
from pixloom.functions import dates as D
from pixloom.functions import filetypes as T
from pixloom.functions import paths as P
from pixloom.functions import sidecar_names as S
from pixloom.functions import tool_log as L
from pixloom.functions.records import clean_hash, record_id, ref_id
from pixloom.operators import motion, neardup, placement, review, tags, verify, winners
from pixloom.operators.components import components
from pixloom.operators.dedup import keep_first
from pixloom.operators.matching import choose_sidecar, match_anywhere, match_in_folder, orphan_sidecars
from pixloom.plans.reference_sql import SQL  # noqa: F401 - the entry point reads it here

# Parameters that the queries and their SQL share.
MAX_YEAR = 2027
NOW = 1_767_225_600
ROOT = "/srv/import"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "copies")
    return rows.withColumn("place", P.place()).withColumn("container", F.when(F.col("src") == "dir", F.lit("")).otherwise(F.col("zip")))


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).select(F.concat_ws("::", "container", P.folder_of(F.col("place"))).alias("folder"), "name")


def _sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "sidecar_docs")
    at = F.when(F.col("ref.kind") == "dir", F.col("ref.path")).otherwise(F.col("ref.entry"))
    return docs.select(F.concat_ws("::", F.when(F.col("ref.kind") == "dir", F.lit("")).otherwise(F.col("ref.zip")), P.folder_of(at)).alias("folder"), P.base_name(at).alias("json"))


def exact_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts: the first document of each and the number of copies."""
    docs = table(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "doc_id")
    return keep_first(docs, ["hash"], ["doc_id"]).select("hash", F.col("doc_id").alias("first_doc"), "n_copies")


def copies_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first copy of each content."""
    rows = table(spark, sf_dir, "copies").where("sha256 is not null").select(F.lower("sha256").alias("sha256"), "scan_ord", "name")
    return keep_first(rows, ["sha256"], ["scan_ord"]).select("sha256", "scan_ord", "name", "n_copies")


def winner_prefers_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first copy with a sidecar, else the first copy."""
    rows = table(spark, sf_dir, "copies").where("sha256 is not null").select(F.lower("sha256").alias("sha256"), "scan_ord", F.col("sidecar").isNotNull().alias("has_sidecar"))
    return keep_first(rows, ["sha256"], [~F.col("has_sidecar"), F.col("scan_ord")]).select("sha256", "scan_ord", "has_sidecar", "n_copies")


def content_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bucket of each content, from the folders of its copies."""
    rows = _copies(spark, sf_dir).where("sha256 is not null").select(F.lower("sha256").alias("sha256"), P.path_bucket(F.col("place")).alias("bucket"))
    return rows.groupBy("sha256").agg(winners.content_bucket(F.col("bucket")).alias("bucket"))


def albums_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted albums of each content that is in any."""
    rows = _copies(spark, sf_dir).where("sha256 is not null").select(F.lower("sha256").alias("sha256"), "place")
    return rows.groupBy("sha256").agg(winners.albums_of(F.col("place")).alias("albums")).where(F.size("albums") > 0)


def albums_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The albums of each content, with its first place."""
    rows = _copies(spark, sf_dir).where("sha256 is not null").select(F.lower("sha256").alias("sha256"), "place", "scan_ord")
    per = rows.groupBy("sha256").agg(winners.albums_of(F.col("place")).alias("albums"), F.min_by("place", "scan_ord").alias("place"))
    return winners.album_manifest(per)


def sidecar_local_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_in_folder(_media(spark, sf_dir), _sidecars(spark, sf_dir)).select("folder", "name", "sidecar")


def sidecar_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_sidecars(_media(spark, sf_dir), _sidecars(spark, sf_dir))


def sidecar_global_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orphans' inner names that the names of copies without sidecar belong to."""
    return match_anywhere(table(spark, sf_dir, "copies").where("sidecar is null"), table(spark, sf_dir, "orphans")).select("name", "inner")


def sidecar_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the orphans of each inner name."""
    refs = table(spark, sf_dir, "orphans").select("inner_name", ref_id("ref").alias("ref_id"))
    docs = table(spark, sf_dir, "sidecar_docs").select(ref_id("ref").alias("ref_id"), "raw")
    return choose_sidecar(refs, docs, ["inner_name"], max_year=MAX_YEAR)


def content_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One copy per content with its sidecar, own or recovered, bucket and albums."""
    return winners.select_winners(*[table(spark, sf_dir, t) for t in ("copies", "orphans", "sidecar_docs")])


def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winners.dedup_summary(content_winners(spark, sf_dir))


def sidecar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inner name of each sidecar, and its name beside a placed file."""
    rows = _sidecars(spark, sf_dir).select("json").distinct().withColumn("inner", S.inner_name(F.col("json")))
    return rows.withColumn("dest", S.sidecar_dest(F.col("inner"), F.col("json")))


def sidecar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month of each sidecar document, if it has a plausible one."""
    rows = table(spark, sf_dir, "sidecar_docs").select("sidecar_id", D.sidecar_date(F.col("raw"), max_year=MAX_YEAR).alias("d"))
    return rows.where("d is not null").select("sidecar_id", "d.year", "d.month")


def exif_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month that the tags of each file name, if plausible."""
    text = D.embedded_text(F.col("datetimeoriginal"), F.col("createdate"))
    return table(spark, sf_dir, "exif").select("rec_id", D.embedded_date(text, max_year=MAX_YEAR).alias("d")).where("d is not null").select("rec_id", "d.year", "d.month")


def date_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the date of each copy comes from."""
    rows = _copies(spark, sf_dir).select("scan_ord", record_id().alias("id"), ref_id("sidecar").alias("ref"))
    docs = table(spark, sf_dir, "sidecar_docs").select(ref_id("ref").alias("ref"), D.sidecar_date(F.col("raw"), max_year=MAX_YEAR).alias("s"))
    tags_ = table(spark, sf_dir, "exif").groupBy(F.col("source_file").alias("id")).agg(F.min("rec_id").alias("rec_id"), F.min_by(F.struct("datetimeoriginal", "createdate"), "rec_id").alias("t"))
    tags_ = tags_.select("id", D.embedded_date(D.embedded_text(F.col("t.datetimeoriginal"), F.col("t.createdate")), max_year=MAX_YEAR).alias("e"))
    day = D.date_waterfall(F.col("s"), F.col("e"), F.col("ref").isNotNull())
    return rows.join(docs, "ref", "left").join(tags_, "id", "left").select("scan_ord", day.alias("d")).select("scan_ord", "d.outcome", "d.year", "d.month")


def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type by signature, kind and corrected name of each copy."""
    found = T.sniff_type(F.col("head"))
    return table(spark, sf_dir, "copies").select("scan_ord", found.alias("sniffed"), T.media_kind(P.suffix(F.col("name"))).alias("kind"), T.canon_ext(P.suffix(F.col("name"))).alias("ext"), T.corrected_name(F.col("name"), found).alias("corrected"))


def extension_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media_types(spark, sf_dir).where("sniffed is not null").withColumn("want", T.canon_ext(F.col("sniffed")))
    return rows.where("ext <> want").groupBy("ext", "want").agg(F.count("*").alias("n"))


def motion_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips that belong to a still, and what becomes of those without sidecar."""
    seconds = table(spark, sf_dir, "exif").groupBy(F.col("source_file").alias("id")).agg(F.max("duration").alias("duration"))
    rows = _copies(spark, sf_dir).select("scan_ord", "name", record_id().alias("id"), F.col("sidecar").isNotNull().alias("has")).join(seconds, "id", "left")
    found = motion.is_motion(rows).where("motion")
    return found.select("scan_ord", "name", motion.disposition(F.col("motion"), F.col("has"), "archive").alias("disposition"))


def placement_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder of each copy by bucket, kind of its corrected name, and month of its sidecar or tags."""
    rows = _copies(spark, sf_dir).select("scan_ord", P.path_bucket(F.col("place")).alias("bucket"), T.corrected_name(F.col("name"), T.sniff_type(F.col("head"))).alias("name"))
    days = date_waterfall(spark, sf_dir).select("scan_ord", "year", "month")
    return rows.join(days, "scan_ord").select("scan_ord", placement.dest_folder(F.col("bucket"), F.col("name"), F.col("year"), F.col("month")).alias("folder"))


def collision_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names for all copies that would lie in one folder by kind and bucket (sequential semantics; no SQL)."""
    rows = _copies(spark, sf_dir).select("scan_ord", "name", placement.dest_folder(P.path_bucket(F.col("place")), F.col("name"), F.lit(None), F.lit(None)).alias("folder"))
    return placement.number_names(rows, ["scan_ord"])


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents that extracted does not list at all."""
    rows = table(spark, sf_dir, "copies").where("sha256 is not null").select(clean_hash(F.col("sha256")).alias("sha256")).distinct()
    return placement.pending(rows, table(spark, sf_dir, "extracted").select(clean_hash(F.col("hash")).alias("sha256")))


def outcome_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "extracted").groupBy("outcome").agg(F.count("*").alias("n"), F.count_distinct(clean_hash(F.col("hash"))).alias("n_contents"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many contents are done or diverted, both, and done but no longer in the inventory."""
    e = table(spark, sf_dir, "extracted").select(clean_hash(F.col("hash")).alias("h"), "outcome").where("h is not null")
    done, diverted = e.where("outcome = 'placed'").select("h"), e.where("outcome in ('archived', 'trashed', 'motion')").select("h")
    inventory = table(spark, sf_dir, "copies").select(clean_hash(F.col("sha256")).alias("h")).where("h is not null")
    one = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return one("either", done.union(diverted).distinct()).unionByName(one("both", done.intersect(diverted))).unionByName(one("stale", done.subtract(inventory)))


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    color = F.transform(F.slice(v, 1, 8), lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127.5).cast("int"))))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array(B.difference_hash(v, 64, 63)).alias("words"), color.alias("color"))


def neardup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(_prints(spark, sf_dir), 16, 120, 63)


def neardup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_groups(_prints(spark, sf_dir), 16, 120, 63)


def neardup_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group_sizes(neardup_groups(spark, sf_dir))


def pair_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "near_pairs"), "left_ord", "right_ord")


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "dup_groups").groupBy("group_id", "scan_ord").agg(F.max(F.struct("reviewed_at", "path", "size_bytes")).alias("r"))
    return rows.select("group_id", "scan_ord", "r.path", F.col("r.size_bytes").alias("size"))


def keep_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members ranked by size; the largest is suggested."""
    return review.registry(_reviewed(spark, sf_dir)).select("group_id", "scan_ord", "rank_no", "suggest_keep")


def groups_still_there(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members whose file the inventory lists under the same path, in groups with two or more left."""
    there = _copies(spark, sf_dir).select(record_id().alias("path"))
    return review.present_groups(_reviewed(spark, sf_dir), there).select("group_id", "scan_ord")


def removal_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moves for the members that are marked not to be kept."""
    members = _reviewed(spark, sf_dir).select(F.concat_ws("-", "group_id", "scan_ord").alias("id"), "path")
    chosen = table(spark, sf_dir, "dup_groups").where("not suggest_keep").select(F.concat_ws("-", "group_id", "scan_ord").alias("id"))
    return review.selected_moves(members, chosen, "/srv/removed")


def _library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    copies = _copies(spark, sf_dir)
    done = table(spark, sf_dir, "extracted").where("outcome = 'placed'").select(clean_hash(F.col("hash")).alias("sha256"))
    return copies, done, copies.where("src = 'dir'").select(F.regexp_replace("path", f"^{ROOT}/", "").alias("rel_path")).distinct()


def verify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory, done, files = _library(spark, sf_dir)
    return verify.count_checks(inventory, done, files).unionByName(verify.undated_check(files))


def verify_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.verdict(verify_counts(spark, sf_dir))


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.coalesce("ref.path", "ref.entry")
    rows = table(spark, sf_dir, "sidecar_docs").select(F.col("sidecar_id").alias("id"), S.inner_name(P.base_name(at)).alias("name"), "raw")
    return tags.tag_plan(rows, now=NOW)


def tag_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags that each sidecar document puts into its file, without those of places, which are in gps_tags."""
    return _tags(spark, sf_dir).where("not startswith(tag, 'GPS')")


def gps_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of places that each sidecar document puts into its file, as numbers: the same number may be written in several ways."""
    return _tags(spark, sf_dir).where("startswith(tag, 'GPS')").select("id", "tag", F.col("value").try_cast("double").alias("value"))


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Album folder names and error paths of the copies."""
    rows = _copies(spark, sf_dir)
    return rows.select("scan_ord", P.safe_album(P.album_of(F.col("place"))).alias("album_folder"), P.errors_path(F.col("src"), F.col("path"), F.col("zip"), F.col("entry"), ROOT).alias("error_path"))


def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dup_groups").select("size_bytes").distinct().select("size_bytes", P.human_size(F.col("size_bytes")).alias("shown"))


def warning_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of tool lines (here: one per document, from its text)."""
    line = F.concat(F.when(F.col("doc_id") % 2 == 0, "Error: ").otherwise("Warning: "), F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "documents").select(L.warning_category(line).alias("category")).where("category is not null")
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def refolder_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many copies without a date in their sidecar, which lie in `unknown` until their tags are read, have one there, by year."""
    return date_waterfall(spark, sf_dir).where("outcome = 'embedded'").groupBy("year").agg(F.count("*").alias("n"))


def sample_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of dated files, and whether their tags have a date (a sampling operator)."""
    _, _, files = _library(spark, sf_dir)
    read = table(spark, sf_dir, "exif").select(F.regexp_replace("source_file", f"^{ROOT}/", "").alias("rel_path"), D.embedded_text(F.col("datetimeoriginal"), F.col("createdate")).alias("text"))
    return verify.sample_dated(files, read)


QUERIES = {
    f.__name__: f
    for f in (
        exact_dedup_keep_first, copies_keep_first, winner_prefers_sidecar, content_buckets, albums_rollup, albums_manifest, sidecar_local_match,
        sidecar_orphans, sidecar_global_match, sidecar_choice, content_winners, dedup_summary, sidecar_names, sidecar_dates, exif_dates, date_waterfall,
        media_types, extension_mismatches, motion_clips, placement_paths, collision_numbers, resume_pending, outcome_counters, set_operations,
        neardup_pairs, neardup_groups, neardup_histogram, pair_components, keep_suggestions, groups_still_there, removal_moves, verify_counts,
        verify_verdict, tag_plan, gps_tags, path_functions, human_sizes, warning_tally, refolder_by_year, sample_50,
    )
}
