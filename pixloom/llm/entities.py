"""Matching entities across sources without keys: photographs that lost their sidecar, and sidecars that lost their photograph.

A deterministic cascade. Each rule is an exact join on fewer or weaker attributes than the one before (library, folder, name,
counter, edit mark, capture instant); records resolved by a rule are anti-joined away before the next. Records whose sidecar is
known take part in every join, resolved or not, and the share of right pairs among all that a rule finds for them, smoothed, is the
confidence of its pairs. Rules for renamed sidecars are judged there with all names hidden, since known sidecars have their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixloom.functions.records import clean_hash, record_id, ref_id
from pixloom.operators.timestamps import exif_values, sidecar_values, stated_instants
from pixloom.session import materialise

LABELLED_BOUND = 20_000
QUARTER = 900

# Words that programs add to the name of an edited or exported copy.
EDIT_WORDS = "edited effects collage bearbeitet modifie editado modificato kopie copy copie copia web small resized hdr cropped animation"


def fold(text: Column) -> Column:
    """Lower case without accents (composed or not), percent codes decoded, blanks and underscores as one blank."""
    plain = F.coalesce(F.try_url_decode(F.when(text.contains("%"), F.replace(text, F.lit("+"), F.lit("%2B")))), text)
    plain = F.translate(F.lower(plain), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\p{M}+", ""), r"[\s_]+", " "))


def with_name_parts(df: DataFrame, name: Column, counter: Column | None = None) -> DataFrame:
    """Adds core, ext, cnt and edit of a file name; counter is one written elsewhere, which comes first if the name lacks it."""
    tail = r"((?:(?: - | ?-| )(?:" + EDIT_WORDS.replace(" ", "|") + r")|~\d+| ?\(\d+\))+)$"
    df = df.withColumn("_n", fold(name))
    df = df.withColumn("_s", F.regexp_replace(F.regexp_replace("_n", r"\.[a-z0-9]{2,4}$", ""), r"^(?:\(\d{1,4}\) ?|\d{1,4}(?: - | ))(?=.)", ""))
    df = df.withColumn("_t", F.regexp_extract("_s", "(?<=.)" + tail, 1))
    own = F.array_join(F.regexp_extract_all("_t", F.lit(r"\((\d+)\)"), 1), ",")
    if counter is not None:
        written = F.coalesce(counter, F.lit(""))
        own = F.when((written == "") | F.concat(F.lit(","), own, F.lit(",")).contains(F.concat(F.lit(","), written, F.lit(","))), own).otherwise(
            F.concat_ws(",", written, F.nullif(own, F.lit("")))
        )
    return (
        df.withColumn("cnt", own)
        .withColumn("edit", F.trim(F.regexp_replace("_t", r"\(\d+\)", "")))
        .withColumn("core", F.expr("trim(left(_s, length(_s) - length(_t)))"))
        .withColumn("ext", F.regexp_extract("_n", r"\.([a-z0-9]{2,4})$", 1))
        .drop("_n", "_s", "_t")
    )


def with_place_parts(df: DataFrame, place: Column) -> DataFrame:
    """Adds lib (the first three parts of the path) and folder (the folder's letters and digits, without a copy number)."""
    inside = F.regexp_replace(place, r"^.*::", "")
    # a folder named by digits only was made by whoever collected the file; the one above it has the name
    parent = F.regexp_extract(inside, r"([^/]+)/(?:\d+/)?[^/]*$", 1)
    bare = F.regexp_replace(F.regexp_replace(fold(parent), r"(?:\(\d+\))+$", ""), r"[^\p{L}\p{N}]+", "")
    return df.withColumn("lib", F.regexp_extract(place, r"^((?:/?[^/]+){1,3})", 1)).withColumn("folder", bare)


def _video(ext: Column) -> Column:
    return ext.isin("mp4", "mov", "m4v", "avi", "3gp", "mkv", "mpg")


# ---- evidence of one media row (m) and one sidecar row (o) in a joined table; o's columns are prefixed with o_


def _near(a: Column, b: Column, seconds: int = 1) -> Column:
    return F.coalesce(F.abs(a - b) <= seconds, F.lit(False))


def _same_time() -> Column:
    """The document's capture second is one that the file states, or lies whole quarter hours from its zoneless reading."""
    taken = F.col("o_taken")
    stated = _near(F.col("t_min"), taken) | _near(F.col("t_max"), taken)
    off = F.abs(F.col("l_min") - taken)
    zoneless = F.col("t_min").isNull() & F.coalesce((off <= 14 * 3600 + 1) & ((off % QUARTER <= 1) | (off % QUARTER >= QUARTER - 1)), F.lit(False))
    return stated | zoneless


def _contradicts() -> Column:
    """The file states a time and it is another. An hour's difference is no contradiction (a clock that was set back)."""
    taken = F.col("o_taken")
    known = F.coalesce("t_min", "l_min", "c_min", "cl_min").isNotNull() & taken.isNotNull()
    hour = _near(F.abs(F.col("t_min") - taken), F.lit(3600))
    late = F.col("c_min") - taken
    local_late = F.col("cl_min") - taken
    digitised = F.coalesce("t_min", "l_min").isNull() & (
        F.coalesce(late.between(-2, 1900), F.lit(False)) | F.coalesce(F.col("c_min").isNull() & local_late.between(-15 * 3600, 15 * 3600), F.lit(False))
    )
    return known & ~(_same_time() | hour | digitised)


@dataclass(frozen=True)
class Pass:
    """One exact join and what may hold of its pairs, strongest first; a record takes the strongest that any of its pairs has."""

    keys: tuple[str, ...]
    rules: tuple[tuple[str, Any], ...]  # (name, () -> Column over the joined row)


def _alike() -> Column:
    return F.col("edit") == F.col("o_edit")


def _plain_of_edit() -> Column:
    return (F.col("o_edit") == "") & (F.col("edit") != "")


def _one_starts_other(a: str, b: str, least: int) -> Column:
    return (F.least(F.length(a), F.length(b)) >= least) & (F.startswith(F.col(a), F.col(b)) | F.startswith(F.col(b), F.col(a)))


def _renamed() -> Column:
    """Another name; of labelled records any name, so that the rule is judged as if all of them had been renamed."""
    return (F.col("o_edit") == "") & ((F.col("pop") == "labelled") | (F.col("core") != F.col("o_core"))) & (_video(F.col("ext")) == _video(F.col("o_ext")))


def _folders_alike() -> Column:
    return (F.col("folder") == F.col("o_folder")) | _one_starts_other("folder", "o_folder", 8)


CASCADE = (
    Pass(("lib", "folder", "core", "cnt"), (
        ("name, folder and time", lambda: _alike() & _same_time()),
        ("name and folder", lambda: _alike() & ~_contradicts()),
        ("original's name, folder and time", lambda: _plain_of_edit() & _same_time()),
        ("original's name and folder", lambda: _plain_of_edit() & ~_contradicts()),
    )),
    Pass(("lib", "core", "cnt"), (
        ("name and time", lambda: _alike() & _same_time()),
        ("original's name and time", lambda: _plain_of_edit() & _same_time()),
        ("name and cut folder", lambda: _alike() & ~_contradicts() & _folders_alike()),
        ("original's name and cut folder", lambda: _plain_of_edit() & ~_contradicts() & _folders_alike()),
    )),
    Pass(("core", "cnt", "phase"), (  # the phase of the quarter hour is the same whatever the zone, so names of all libraries need not meet
        ("name, folder and time, library unknown", lambda: _alike() & _same_time() & _folders_alike()),
        ("original's name, folder and time, library unknown", lambda: _plain_of_edit() & _same_time() & _folders_alike()),
    )),
    Pass(("lib", "folder", "core24"), (
        ("cut name and folder", lambda: (F.col("cnt") == F.col("o_cnt")) & _alike() & ~_contradicts() & _one_starts_other("core", "o_core", 24)),
    )),
    Pass(("lib", "second"), (
        ("renamed: folder and time", lambda: _renamed() & (F.col("folder") == F.col("o_folder"))),
        ("renamed: time", _renamed),
    )),
    Pass(("folder", "second"), (("renamed: folder and time, library unknown", _renamed),)),
)
RULES = tuple(name for p in CASCADE for name, _ in p.rules)
ORIGINAL_RULES = tuple(i for i, name in enumerate(RULES) if name.startswith("original's"))
ORIGINALS = "orphan of the original"


def _weak_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("core24", F.when(F.length("core") >= 24, F.left("core", F.lit(24))))


def _media(copies: DataFrame, exif: DataFrame, bound: int) -> DataFrame:
    """One row per content, name and place that is open (no copy has a sidecar) or in the labelled sample, with its times.

    pop is `open` or `labelled`; second holds an instant for joins by time alone. The labelled sample keeps whole names.
    """
    rows = copies.select(clean_hash(F.col("sha256")).alias("hash"), record_id().alias("place"), "name", ref_id("sidecar").alias("ref")).where("hash is not null and place is not null")
    owned = rows.groupBy("hash").agg(F.max(F.col("ref").isNotNull()).alias("owned"))
    owned = materialise(owned, "owned")
    n = max(1, owned.where("owned").count())
    share = min(1_000_000, 1_000_000 * bound // n)
    kept = with_place_parts(with_name_parts(rows.join(owned, "hash"), F.col("name")), F.col("place")).where(
        ~F.col("owned") | (F.pmod(F.xxhash64("core"), F.lit(1_000_000)) < share)
    )
    kept = materialise(kept.withColumn("pop", F.when(F.col("owned"), "labelled").otherwise("open")).drop("owned", "name").distinct(), "media")
    places = kept.select(F.col("place").alias("source_file")).distinct()
    probed = stated_instants(exif_values(exif.join(places, "source_file", "left_semi")))
    probed = materialise(probed, "probed").where("local_us is not null or epoch_us is not null")
    second = lambda c: F.floor(F.col(c) / 1_000_000)
    taken = F.col("field") == "DateTimeOriginal"
    zoneless = F.col("epoch_us").isNull() & F.col("zone_source").isNull()  # not a local time that was skipped
    times = kept.select("hash", "place").distinct().join(probed, "place").groupBy("hash").agg(
        F.min(F.when(taken, second("epoch_us"))).alias("t_min"),
        F.max(F.when(taken, second("epoch_us"))).alias("t_max"),
        F.min(F.when(taken & zoneless, second("local_us"))).alias("l_min"),
        F.min(F.when(~taken, second("epoch_us"))).alias("c_min"),
        F.min(F.when(~taken & zoneless, second("local_us"))).alias("cl_min"),
    )
    out = kept.drop("place").distinct().join(times, "hash", "left")
    phases = F.array_distinct(F.transform(F.array_compact(F.array("t_min", "t_max", F.when(F.col("t_min").isNull(), F.col("l_min")))), lambda t: F.pmod(t, F.lit(QUARTER))))
    out = out.withColumn("phase", F.explode_outer(phases))
    return _weak_keys(out).withColumn("second", F.explode_outer(F.array_distinct(F.array_compact(F.array("t_min", "t_max")))))


def _sidecars(orphans: DataFrame, docs: DataFrame, media: DataFrame) -> DataFrame:
    """Orphans for both populations, and the sidecars of the labelled records as if they were orphans; name, place and time of each."""
    loose = orphans.where("scan_ord is not null").select(F.col("scan_ord").alias("orphan_ord"), "inner_name", ref_id("ref").alias("at"), F.lit(None).cast("string").alias("owner"))
    claimed = media.where("pop = 'labelled' and ref is not null").select(F.lit(None).cast("bigint").alias("orphan_ord"), F.element_at(F.split("ref", "/"), -1).alias("inner_name"), F.col("ref").alias("at"), F.col("hash").alias("owner")).distinct()
    wanted = materialise(loose.unionByName(claimed).where("at is not null"), "sidecars")
    mine = docs.withColumn("_at", ref_id("ref")).join(wanted.select(F.col("at").alias("_at")).distinct(), "_at", "left_semi")
    title = F.try_variant_get(F.try_parse_json(F.col("raw")), "$.title", "string")
    read = stated_instants(sidecar_values(mine)).where("field = 'photoTakenTime'").groupBy("rec_id").agg(F.min("epoch_us").alias("taken_us"))
    facts = mine.select(F.col("_at").alias("at"), title.alias("title"), F.col("sidecar_id").alias("rec_id")).join(read, "rec_id", "left").drop("rec_id")
    found = wanted.join(facts, "at", "left")
    numbered = r"^(.*?\.[A-Za-z0-9]{2,4})(?:\.s[a-z-]*)?\((\d+)\)(?:\.json)?$"
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("inner_name", numbered, "$1"), r"\.json$", ""), r"(\.[A-Za-z0-9]{2,4})\.s[a-z-]*$", "$1")
    out = with_name_parts(found, F.coalesce(F.nullif(F.trim("title"), F.lit("")), bare), F.regexp_extract("inner_name", numbered, 2))
    out = _weak_keys(with_place_parts(out, F.col("at")).withColumn("taken", F.floor(F.col("taken_us") / 1_000_000)).withColumn("second", F.col("taken")))
    # a second's difference is the same instant, so a sidecar is looked for at three places of the quarter hour
    out = out.withColumn("phases", F.when(F.col("taken").isNotNull(), F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: F.pmod(F.col("taken") + k, F.lit(QUARTER)))))
    out = out.select("orphan_ord", "at", "owner", "lib", "folder", "phases", "core", "core24", "cnt", "edit", "ext", "taken", "second")
    pops = F.when(F.col("owner").isNotNull(), F.array(F.lit("labelled"))).otherwise(F.array(F.lit("open"), F.lit("labelled")))
    return out.withColumn("pop", F.explode(pops))


def match_orphans(copies: DataFrame, orphans: DataFrame, sidecar_docs: DataFrame, exif: DataFrame, labelled_bound: int = LABELLED_BOUND) -> DataFrame:
    """(hash, orphan_ord, rule, confidence, judged): the orphan sidecars of every content that no copy has a sidecar for.

    A content may get several orphans (a sidecar delivered twice) and an orphan several contents (a photograph and its edited
    copies); repeated rows give one pair. Names and folders are compared without letter case, accents, percent codes, copy
    prefixes and edit marks; a document that cannot be read leaves name and place as evidence. Contents without readable hash
    and records without place have no match, orphans without number or place match nothing; empty tables give none. Other columns are ignored.

    confidence is (right + 1) / (judged + 2) of the pairs that the rule finds for records whose sidecar is known, judged their
    number; a pair whose sidecar may be another's, or of which that is not known, is not right. labelled_bound: about how many
    contents with known sidecars are judged (all, if there are fewer). Matching itself always covers all records.
    """
    media = materialise(_media(copies, exif, labelled_bound), "matchable")
    cards = materialise(_sidecars(orphans, sidecar_docs, media), "cards")
    everything = media.drop("ref").distinct()
    rest = everything
    number = 0
    for step in CASCADE:
        keys = ["pop", *step.keys]
        own_keys = [F.explode("phases").alias("phase") if k == "phase" else F.col(k) for k in keys]
        other = cards.select(*own_keys, *[F.col(c).alias(f"o_{c}") for c in ("orphan_ord", "at", "owner", "folder", "core", "cnt", "edit", "ext", "taken")])
        rule = F.coalesce(*[F.when(holds(), F.lit(number + i)) for i, (_, holds) in enumerate(step.rules)])
        number += len(step.rules)
        pairs = rest.where(F.col(step.keys[-1]).isNotNull()).join(other, keys).select("pop", "hash", F.col("o_orphan_ord").alias("orphan_ord"), F.col("o_at").alias("at"), F.col("o_owner").alias("owner"), rule.alias("rule"))
        pairs = pairs.where("rule is not null").distinct()
        # several sidecars of one content are kept if the same rule finds them; an edited copy takes its own and its original's
        pairs = pairs.withColumn("_original", F.col("rule").isin(*ORIGINAL_RULES))
        pairs = pairs.withColumn("_best", F.min("rule").over(Window.partitionBy("pop", "hash", "_original"))).where("pop = 'labelled' or rule = _best").drop("_best", "_original")
        pairs = materialise(pairs, f"pass{number}")
        done = pairs if step is CASCADE[0] else done.unionByName(pairs)
        rest = rest.join(pairs.where("pop = 'open'").select("pop", "hash").distinct(), ["pop", "hash"], "left_anti")
    # an edited copy without evidence of its own takes what its original, in the same folder, was given; of labelled ones all are judged
    original = media.where("edit = ''").join(done, ["pop", "hash"]).select("pop", "lib", "folder", "core", "cnt", "orphan_ord", "at", "owner").distinct()
    copies_left = rest.where("edit <> '' and (pop = 'labelled' or (t_min is null and l_min is null))").select("pop", "hash", "lib", "folder", "core", "cnt").distinct()
    taken_over = copies_left.join(original, ["pop", "lib", "folder", "core", "cnt"]).select("pop", "hash", "orphan_ord", "at", "owner", F.lit(len(RULES)).alias("rule")).distinct()
    done = done.unionByName(materialise(taken_over, "taken_over"))
    # a sidecar delivered twice: all with the same name and the same instant, wherever they lie, come with one of them
    twin = ["core", "cnt", "edit", "taken"]
    known = cards.where("pop = 'open' and taken is not null").select("orphan_ord", *twin).distinct()
    open_pairs = done.where("pop = 'open'").select("hash", "orphan_ord", "rule")
    of_name = open_pairs.join(known, "orphan_ord").groupBy("hash", *twin).agg(F.min("rule").alias("rule"))
    found = open_pairs.unionByName(of_name.join(known, twin).select("hash", "orphan_ord", "rule")).groupBy("hash", "orphan_ord").agg(F.min("rule").alias("rule"))
    return found.join(F.broadcast(_precision(done, media, cards)), "rule", "left").select(  # one row a rule
        "hash",
        "orphan_ord",
        F.element_at(F.array(*[F.lit(r) for r in RULES], F.lit(ORIGINALS)), F.col("rule") + 1).alias("rule"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
        F.coalesce("judged", F.lit(0)).alias("judged"),
    )


def _precision(done: DataFrame, media: DataFrame, cards: DataFrame) -> DataFrame:
    """(rule, confidence, judged) from the labelled pairs: right if the sidecar is the content's own, or one of the same name and
    instant as its own (the same sidecar delivered again, or that of its original). What else there is, unknown ones too, is not."""
    facts = ["core", "taken"]
    mine = cards.where("pop = 'labelled'")
    own = mine.where("owner is not null and taken is not null").select(F.col("owner").alias("hash"), *facts).distinct().withColumn("_same", F.lit(True))
    its = mine.groupBy("at").agg(*[F.min(c).alias(c) for c in facts])
    judged = done.where("pop = 'labelled'").join(its, "at", "left").join(own, ["hash", *facts], "left")
    right = F.coalesce((F.col("owner") == F.col("hash")) | F.col("_same"), F.lit(False))
    per = judged.groupBy("rule", "hash", "at").agg(F.max(right).alias("right"))
    return per.groupBy("rule").agg(((F.sum(F.col("right").cast("int")) + 1) / (F.count("*") + 2)).alias("confidence"), F.count("*").alias("judged"))
