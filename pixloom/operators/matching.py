"""Media files and their sidecars: within a folder, and across folders for what is left over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixloom.functions import dates as D
from pixloom.functions import paths as P
from pixloom.functions import sidecar_names as S


def _cut_prefixes(stem):  # noqa: ANN001, ANN202 - Column -> Column
    """Every beginning of a stem that is long enough to be a cut name; none for shorter stems."""
    n = F.length(stem)
    return F.when(n >= S.MIN_CUT_STEM, F.transform(F.sequence(F.lit(S.MIN_CUT_STEM), F.greatest(n, F.lit(S.MIN_CUT_STEM))), lambda k: F.left(stem, k)))


def match_in_folder(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(folder, name, sidecar, tier): the sidecar of each media file of media(folder, name) among sidecars(folder, json).

    Tiers, first hit wins: names and counters in the order of their lookup; a cut name (the longest, then the first by name); the
    original of an -edited copy, with its extension in lower case. Equal joins only: sidecar names are read backwards, and cut
    names meet the beginnings of media stems. Several files may share a sidecar. Files without match, null names and folders give
    no row; repeated rows give one; other columns are ignored.
    """
    m = media.select("folder", "name").where("folder is not null and name is not null").distinct()
    s = sidecars.select("folder", "json").where("folder is not null and json is not null").distinct()
    stem, ext = P.stem(F.col("name")), P.suffix(F.col("name"))
    looked_up = m.select("folder", "name", F.lit(S.PLAIN).alias("tier"), F.col("name").alias("media")).unionByName(
        m.where(stem.endswith("-edited")).select(
            "folder", "name", F.lit(S.EDITED).alias("tier"), F.concat(F.left(stem, F.length(stem) - len("-edited")), F.lower(ext)).alias("media")
        )
    )
    named = s.select("folder", "json", F.inline(S.named_media(F.col("json"))))
    direct = looked_up.join(named, ["folder", "media"]).select("folder", "name", "json", (F.col("tier") + F.col("rank")).alias("tier"), F.lit(0).alias("length"))
    inner = s.select("folder", "json", S.inner_name(F.col("json")).alias("inner"))
    inner = inner.select("folder", "json", P.stem(F.col("inner")).alias("cut"), F.lower(P.suffix(F.col("inner"))).alias("ext")).where(F.length("cut") >= S.MIN_CUT_STEM)
    begun = m.select("folder", "name", F.lower(ext).alias("ext"), F.explode(_cut_prefixes(stem)).alias("cut"))
    cut = begun.join(inner, ["folder", "ext", "cut"]).select("folder", "name", "json", F.lit(S.CUT).alias("tier"), (-F.length("cut")).alias("length"))
    best = F.min(F.struct("tier", "length", "json"))
    return direct.unionByName(cut).groupBy("folder", "name").agg(best.alias("b")).select("folder", "name", F.col("b.json").alias("sidecar"), F.col("b.tier").alias("tier"))


def orphan_sidecars(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(folder, json, inner): sidecars that no media file of their folder claims, with the name they are for."""
    claimed = match_in_folder(media, sidecars).select("folder", F.col("sidecar").alias("json")).distinct()
    return sidecars.select("folder", "json").distinct().join(claimed, ["folder", "json"], "left_anti").select("folder", "json", S.inner_name(F.col("json")).alias("inner")).where("inner <> ''")


def match_anywhere(names: DataFrame, orphans: DataFrame) -> DataFrame:
    """(name, inner, tier): for each distinct name, the inner name among orphans(inner_name) that it belongs to.

    Order: the name, the name with its counter moved behind, then the same for the name without one -edited after another
    (letter case kept), then cut names, those of the most stripped name first, longest first. Nulls match nothing.
    """
    n = names.select("name").where("name is not null").distinct()
    edits = F.length(F.regexp_extract(P.stem(F.col("name")), r"((?:-edited)*)$", 1)) / len("-edited")
    levels = n.withColumn("level", F.explode(F.sequence(F.lit(0), edits.cast("int")))).withColumn("ext", P.suffix(F.col("name")))
    base = P.stem(F.col("name"))
    levels = levels.withColumn("stem", F.left(base, F.length(base) - F.col("level") * len("-edited")))
    plain = F.concat("stem", "ext")
    counted = r"(?s)^(.*)(\(\d+\))(\.[^.]+)$"
    asked = F.array(
        F.struct(plain.alias("inner"), (F.col("level") * 2).alias("tier")),
        F.struct(F.when(plain.rlike(counted), F.regexp_replace(plain, counted, "$1$3$2")).alias("inner"), (F.col("level") * 2 + 1).alias("tier")),
    )
    keys = orphans.select(F.col("inner_name").alias("inner")).where("inner is not null").distinct()
    direct = levels.select("name", F.inline(asked)).where("inner is not null").join(keys, "inner").select("name", "inner", "tier", F.lit(0).alias("length"))
    cuts = keys.select("inner", P.stem(F.col("inner")).alias("cut"), F.lower(P.suffix(F.col("inner"))).alias("low")).where(F.length("cut") >= S.MIN_CUT_STEM)
    begun = levels.select("name", "level", F.lower("ext").alias("low"), F.explode(_cut_prefixes(F.col("stem"))).alias("cut"))
    cut = begun.join(cuts, ["low", "cut"]).select("name", "inner", (F.lit(S.CUT) - F.col("level")).alias("tier"), (-F.length("cut")).alias("length"))
    best = F.min(F.struct("tier", "length", "inner"))
    return direct.unionByName(cut).groupBy("name").agg(best.alias("b")).select("name", "b.inner", "b.tier")


def choose_sidecar(refs: DataFrame, docs: DataFrame, keys: list[str], min_year: int = D.MIN_YEAR, max_year: int | None = None) -> DataFrame:
    """keys + (ref_id): of several sidecars of one key, the first (by name, then path) with a plausible photoTakenTime, else the first.

    refs has the keys and ref_id; docs(ref_id, raw) is read only for keys with more than one.
    """
    r = refs.select(*keys, "ref_id").distinct()
    counted = r.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ref_id").alias("only"))
    single = counted.where("n = 1").select(*keys, F.col("only").alias("ref_id"))
    many = r.join(counted.where("n > 1").select(*keys), keys, "left_semi")
    dated = docs.join(many.select("ref_id").distinct(), "ref_id", "left_semi").groupBy("ref_id").agg(
        F.max(D.plausible_ts(D.sidecar_ts(F.col("raw"), "photoTakenTime"), min_year, max_year)).alias("ok")
    )
    order = F.struct((~F.coalesce("ok", F.lit(False))).alias("bad"), P.base_name(F.col("ref_id")).alias("base"), "ref_id")
    chosen = many.join(dated, "ref_id", "left").groupBy(*keys).agg(F.min(order).alias("o")).select(*keys, "o.ref_id")
    return single.unionByName(chosen)
