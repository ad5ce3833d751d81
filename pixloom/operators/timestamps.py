"""Mixed time notations and zones: every time text of sidecar documents and image tags to one instant in UTC.

The operator reads each value once, settles its zone by a fixed precedence (inside the value, the field's own offset column, the
record's zone), and estimates a zone where none is stated, by the nearest evidence there is:

1. document: the other record of the same file names an instant that lies whole quarter hours from the reading;
2. neighbour: in the sequence of its source's readings, one within NEAR_US states its offset;
3. history: the zones of its source over the months, chosen so that observations are violated least. Candidates are the zones that
   the data name and those that change between two offsets observed, with their daylight-saving rules, and the offsets observed
   themselves; a reading that would lie after its own ingestion under
   a zone counts against it; each change of zone has a price. A source is a camera of a library; where a zone of a
   camera rests on fewer than LEAST_SEEN observations, its library's history counts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixloom.functions import instants as I
from pixloom.session import materialise

SIDECAR_FIELDS = ("photoTakenTime", "creationTime")
EXIF_FIELDS = (("DateTimeOriginal", "datetimeoriginal", "offsettimeoriginal"), ("CreateDate", "createdate", "offsettimedigitized"))
STEP_MIN = 15
STEP_US = STEP_MIN * 60_000_000
HOUR_US = 3_600_000_000
BUCKET_US = 30 * I.DAY_US
NEAR_US = 6 * HOUR_US
WEEK_US = 8 * I.DAY_US
CHANGE_PRICE = 6.0
FIRST_DAY, LAST_DAY = -36_525, 47_482  # 1870 to 2100
# Zones with daylight saving, by their two offsets in minutes; looked at where both are observed.
SAVING_ZONES = {
    (-600, -540): ("America/Adak",),
    (-540, -480): ("America/Anchorage",),
    (-480, -420): ("America/Los_Angeles",),
    (-420, -360): ("America/Denver",),
    (-360, -300): ("America/Chicago", "America/Mexico_City"),
    (-300, -240): ("America/New_York", "America/Havana"),
    (-240, -180): ("America/Halifax", "America/Santiago"),
    (-210, -150): ("America/St_Johns",),
    (-180, -120): ("America/Sao_Paulo",),
    (-60, 0): ("Atlantic/Azores",),
    (0, 60): ("Europe/London",),
    (60, 120): ("Europe/Berlin",),
    (120, 180): ("Europe/Athens", "Asia/Jerusalem", "Asia/Beirut", "Africa/Cairo"),
    (180, 240): ("Europe/Moscow",),
    (210, 270): ("Asia/Tehran",),
    (570, 630): ("Australia/Adelaide",),
    (600, 660): ("Australia/Sydney",),
    (630, 660): ("Australia/Lord_Howe",),
    (720, 780): ("Pacific/Auckland",),
}
RARITY_PRICE = 0.5
LEAST_SEEN = 10
SEEN, LEAST, ASKED = 0, 1, 2  # kinds of votes


def _json_object(raw: Column) -> Column:
    """The parsed document if it is a JSON object, else null."""
    bare = F.btrim(raw, F.lit(" \t\n\x0b\f\r"))  # a pattern over whole documents would cost ten times what parsing them does
    return F.try_parse_json(F.when(F.startswith(bare, F.lit("{")) & F.endswith(bare, F.lit("}")), raw))


def sidecar_values(docs: DataFrame) -> DataFrame:
    """(origin, rec_id, field, raw, spare, hint, place, container): one row per time field that a sidecar document has.

    raw is the value itself or its `timestamp`, spare its `formatted`. place is the path the document belongs to, without its own
    ending, for aligning with image tags. Documents that are null, cut off or no objects give no row.
    """
    at = F.when(F.col("ref.kind") == "zip", F.concat_ws("::", "ref.zip", "ref.entry")).otherwise(F.col("ref.path"))

    def rows(doc: Column) -> Column:
        got = lambda path: F.try_variant_get(doc, path, "string")
        field = lambda f: F.struct(
            F.lit(f).alias("field"),
            F.coalesce(got(f"$.{f}.timestamp"), F.when(~F.startswith(got(f"$.{f}"), F.lit("{")), got(f"$.{f}"))).alias("raw"),
            got(f"$.{f}.formatted").alias("spare"),
            got("$.timeZone").alias("hint"),
        )
        return F.array(*[field(f) for f in SIDECAR_FIELDS])

    return (
        docs.select(
            F.lit("sidecar_docs").alias("origin"),
            F.col("sidecar_id").alias("rec_id"),
            F.regexp_replace(at, r"(\.[^./]+)\.[^./]*\.json$|\.json$", "$1").alias("place"),
            F.inline(_let(_json_object(F.col("raw")), rows)),  # a document is parsed once, for all its fields
        )
        .where("raw is not null or spare is not null")
        .select("origin", "rec_id", "field", "raw", "spare", F.lit(None).cast("string").alias("own"), "hint", "place")
    )


def exif_values(exif: DataFrame) -> DataFrame:
    """The two date tags of each probed file, in the columns of sidecar_values; own is the field's own offset column."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(v).alias("raw"), F.col(o).alias("own")) for f, v, o in EXIF_FIELDS])
    return (
        exif.select(F.lit("exif").alias("origin"), "rec_id", F.col("tz").alias("hint"), F.col("source_file").alias("place"), F.inline(rows))
        .where("raw is not null")
        .select("origin", "rec_id", "field", "raw", F.lit(None).cast("string").alias("spare"), "own", "hint", "place")
    )


def _let(value: Column, body) -> Column:
    """body(value), with value computed once. Being a lambda it also stays out of whole-stage code, whose one large method for
    all the notations would exceed what the JVM compiles."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def resolve(text: Column, own: Column, hint: Column, short_counts: Column) -> Column:
    """STRUCT<epoch, local, source, zone> of one time text, zone the name of the zone if it is a named one; own and hint are texts of zones, in this order of precedence."""
    none = F.struct(F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("off"), F.lit(None).cast("string").alias("name"))
    zone = lambda z, source: F.struct(F.lit(source).alias("source"), z["off"].alias("off"), z["name"].alias("name"))
    has = lambda z: z["off"].isNotNull() | z["name"].isNotNull()
    out = lambda epoch, local, source, zone: F.struct(epoch.alias("epoch"), local.alias("local"), source.alias("source"), zone.alias("zone"))

    def outer(parts: Column) -> Column:
        fallback = _let(I.parse_zone(own), lambda o: F.when(has(o), zone(o, "own")).otherwise(_let(I.parse_zone(hint), lambda h: F.when(has(h), zone(h, "record")).otherwise(none))))
        inside = lambda w: F.when(w == "", fallback).otherwise(
            _let(I.parse_zone(w), lambda z: F.when(has(z), zone(z, "value")).otherwise(F.struct(F.lit("unreadable").alias("source"), none["off"].alias("off"), none["name"].alias("name"))))
        )
        reading = _let(
            I.local_us(parts),
            lambda local: F.when(local.isNotNull(), _let(inside(parts[8]), lambda z: out(I.to_utc_us(local, z["off"], z["name"]), local, z["source"], z["name"]))),
        )
        count = out(I.count_us(F.get(parts, F.lit(0))), F.lit(None).cast("bigint"), F.lit("count"), none["name"])
        return F.when(F.size(parts) == 1, count).when(F.size(parts) > 1, reading)

    return _let(I.tidy(text), lambda t: _let(I.split_time(t, short_counts), outer))


def stated_instants(values: DataFrame) -> DataFrame:
    """(origin, rec_id, field, place, local_us, epoch_us, zone_source, zone): the reading of each value, both numbers null if it has none.

    epoch_us is null too where the value states a local time and nothing names a zone (zone_source null), where the local time was
    skipped, or where what follows the time is unreadable.
    """
    read = lambda text: resolve(F.col(text), F.col("own"), F.col("hint"), F.col("origin") == "sidecar_docs")
    best = _let(
        read("raw"),
        lambda a: F.when(a["epoch"].isNotNull() | F.col("spare").isNull(), a).otherwise(
            _let(read("spare"), lambda b: F.when(b["epoch"].isNotNull() | F.coalesce(a["local"], a["epoch"]).isNull(), b).otherwise(a))
        ),
    )
    return (
        values.withColumn("_v", best)
        .select("origin", "rec_id", "field", "place", F.col("_v.local").alias("local_us"), F.col("_v.epoch").alias("epoch_us"), F.col("_v.source").alias("zone_source"), F.col("_v.zone").alias("zone"))
    )


@lru_cache(1024)
def _zone_steps(zone: str) -> tuple[np.ndarray, np.ndarray]:
    """The hours of a named zone's own clock (since 1970, over its known rules) from which on an offset in minutes holds: looked for
    by days, then by the hours of the days in which it changes. Of a time that occurs twice the earlier counts."""

    def offsets(hours: np.ndarray) -> np.ndarray:
        walls = pd.DatetimeIndex(hours * 3_600_000_000_000)
        utc = walls.tz_localize(zone, ambiguous=np.ones(len(walls), dtype=bool), nonexistent="shift_forward").tz_convert("UTC").tz_localize(None)
        return np.round((walls - utc).to_numpy().astype("timedelta64[s]").astype(np.int64) / 60 / STEP_MIN).astype(np.int64) * STEP_MIN

    days = np.arange(FIRST_DAY, LAST_DAY) * 24
    changed = days[:-1][np.diff(offsets(days)) != 0]
    hours = np.unique(np.concatenate([days[:1], (changed[:, None] + np.arange(25)).ravel()]))
    found = offsets(hours)
    kept = np.concatenate([[True], np.diff(found) != 0])
    return hours[kept], found[kept]


def _zone_offsets(steps: tuple[np.ndarray, np.ndarray], hours: np.ndarray) -> np.ndarray:
    begin, off = steps
    return off[np.maximum(np.searchsorted(begin, hours, side="right") - 1, 0)]


def _best_history(hour: np.ndarray, kind: np.ndarray, off: np.ndarray, zone: np.ndarray, n: np.ndarray, zones: list[str], steps: dict[str, tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, str | None, int | None]]:
    """(bucket, observations of the months around it that have the same zone, zone, offset), for the months that are asked for, of the
    history that violates the fewest observations. What comes in is bounded by hours, offsets and zones, not by rows."""
    seen, least = kind == SEEN, kind == LEAST
    if not seen.any():
        return []
    month = hour * HOUR_US // BUCKET_US
    asked = np.unique(month[kind == ASKED])
    told = seen | least
    hour, kind, off, zone, n, month, seen, least = (x[told] for x in (hour, kind, off, zone, n, month, seen, least))
    buckets, at = np.unique(month, return_inverse=True)
    offs, which = np.unique(off[seen], return_inverse=True)
    there = set(offs.tolist())
    zones = [*zones, *(z for pair, names in SAVING_ZONES.items() if there.issuperset(pair) for z in names if z not in zones)]
    named = zone >= 0
    counted = np.bincount(zone[named], n[named], len(zones) + len(offs))
    share = counted / max(1, counted.sum())
    cost = np.zeros((len(buckets), len(zones) + len(offs)))
    # a reading lies after its own ingestion under any offset smaller than `least`
    for z, name in enumerate(zones):
        own = _zone_offsets(steps[name], hour)
        cost[:, z] = np.bincount(at, n * (seen & (own != off) | least & (own < off)), len(buckets))
    held = np.zeros((len(buckets), len(offs)))
    np.add.at(held, (at[seen], which), n[seen])
    cost[:, len(zones) :] = held.sum(axis=1, keepdims=True) - held
    for k, o in enumerate(offs):
        if least.any():
            cost[:, len(zones) + k] += np.bincount(at, n * (least & (o < off)), len(buckets))
    start = RARITY_PRICE * (1 - share)
    total, back = cost[0] + start, np.zeros(cost.shape, dtype=int)
    for i in range(1, len(buckets)):
        leap = total.min() + CHANGE_PRICE + start
        back[i] = np.where(total <= leap, np.arange(cost.shape[1]), total.argmin())
        total = np.minimum(total, leap) + cost[i]
    path = [int(total.argmin())]
    for i in range(len(buckets) - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    path = np.array(path[::-1])
    run = np.cumsum(np.concatenate([[False], np.diff(path) != 0]))
    counts = np.bincount(run, held.sum(axis=1))[run]
    near = np.maximum(np.searchsorted(buckets, asked, side="right") - 1, 0)  # a month without observations is as the one before
    return [(int(b), int(c), zones[z] if z < len(zones) else None, None if z < len(zones) else int(offs[z - len(zones)])) for b, c, z in zip(asked, counts[near], path[near])]


def zone_histories(votes: DataFrame, zones: list[str]) -> DataFrame:
    """(library, source, bucket, seen, est_zone, est_off): for every source and month of local time, the zone, or else the offset in minutes,
    of the least-violating history of votes(library, source, hour, kind, off, zone, n), and how many observations the run of months with
    that zone has; and those of each library, with source null."""
    columns = ["library", "source", "bucket", "seen", "est_zone", "est_off"]
    # some hundred steps a zone, found once and not by every task
    steps = {z: _zone_steps(z) for z in {*zones, *(z for names in SAVING_ZONES.values() for z in names)}}

    def history(key: tuple, mine: pd.DataFrame) -> pd.DataFrame:
        arrays = [mine[c].to_numpy() for c in ("hour", "kind", "off", "zone", "n")]
        return pd.DataFrame([(*key, *r) for r in _best_history(*arrays, zones, steps)], columns=columns, dtype="object")

    # a group is a source or a library, counted by hour, so its size is bounded by hours, offsets and zones
    counted = votes.withColumn("source", F.explode(F.array("source", F.lit(None)))).groupBy("library", "source", "hour", "kind", "off", "zone").agg(F.sum("n").alias("n"))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n"))).over(Window.partitionBy("library", "source"))
    used = counted.withColumn("_seen", of(SEEN)).withColumn("_asked", of(ASKED)).where("_asked > 0 and (source is null or _seen >= %d)" % LEAST_SEEN).drop("_seen", "_asked")
    return used.groupBy("library", "source").applyInPandas(history, "library string, source string, bucket bigint, seen bigint, est_zone string, est_off int")


def _whole_quarters(gap: Column) -> Column:
    """A gap that is whole quarter hours of a possible offset, give or take two seconds; else null."""
    near = F.round(gap / STEP_US).cast("bigint") * STEP_US
    return F.when((F.abs(gap - near) <= 2_000_000) & near.between(-12 * 4 * STEP_US, 14 * 4 * STEP_US), near)


def _with_anchors(asked: DataFrame, stated: DataFrame) -> DataFrame:
    """The readings without zone, with aligned (their offset, if the other record of the same file names an instant that fits) and
    uploaded (when the file's document says it came in). Joined by a hash of the place first: places are long and begin alike."""
    key = F.xxhash64("place").alias("_key")
    known = stated.where("place is not null and epoch_us is not null").select(key, "place", "origin", "field", "epoch_us").groupBy("_key", "place").agg(
        F.min(F.when((F.col("origin") == "sidecar_docs") & (F.col("field") == "photoTakenTime"), F.col("epoch_us"))).alias("_doc"),
        F.min(F.when((F.col("origin") == "exif") & (F.col("field") == "DateTimeOriginal"), F.col("epoch_us"))).alias("_tag"),
        F.min(F.when(F.col("field") == "creationTime", F.col("epoch_us"))).alias("uploaded"),
    )
    taken = F.when(F.col("origin") == "exif", F.col("_doc")).when(F.col("field") == "photoTakenTime", F.col("_tag"))
    joined = asked.withColumn("_key", F.xxhash64("place")).join(known, ["_key", "place"], "left")
    return joined.withColumn("aligned", _whole_quarters(F.col("local_us") - taken)).drop("_key", "_doc", "_tag")


def _votes(rows: DataFrame, zones: list[str]) -> DataFrame:
    """(source, library, hour, kind, off, zone, n): observations SEEN, bounds LEAST, and the readings ASKED for, counted before anything
    is gathered. zone is the place in zones of the zone that an observation names, or -1."""
    number = F.when(F.col("epoch_us").isNotNull() & F.col("zone").isNotNull(), F.array_position(F.array(*[F.lit(z) for z in zones]), F.col("zone")).cast("int") - 1).otherwise(-1) if zones else F.lit(-1)
    seen = F.coalesce(F.col("local_us") - F.col("epoch_us"), F.col("aligned"))
    least = F.ceil((F.col("local_us") - F.col("uploaded")) / STEP_US).cast("bigint") * STEP_US
    least = F.when(seen.isNull() & (F.col("origin") == "exif") & least.between(-12 * 4 * STEP_US, 14 * 4 * STEP_US), least)
    kinds = F.array(
        F.struct(F.lit(SEEN).alias("kind"), seen.alias("us"), number.alias("zone")),
        F.struct(F.lit(LEAST).alias("kind"), least.alias("us"), F.lit(-1).alias("zone")),
        F.struct(F.lit(ASKED).alias("kind"), F.when(seen.isNull(), F.lit(0)).cast("bigint").alias("us"), F.lit(-1).alias("zone")),
    )
    return (
        rows.select("source", "library", F.floor(F.col("local_us") / HOUR_US).alias("hour"), F.inline(kinds))
        .where("us is not null")
        .groupBy("source", "library", "hour", "kind", (F.col("us") / 60_000_000).cast("int").alias("off"), "zone")
        .agg(F.count("*").alias("n"))
    )


def _with_neighbours(rows: DataFrame) -> DataFrame:
    """Adds near: the offset of the nearest reading that states one, within NEAR_US before or after in the sequence of its source.

    Sequences are cut into weeks, so that no source is one task however large.
    """
    at = Window.partitionBy("source", "_week").orderBy("local_us", "off", "origin", "rec_id", "field")
    offset = F.when(F.col("off").isNotNull(), F.struct("local_us", "off"))
    rows = rows.withColumn("off", F.coalesce(F.col("local_us") - F.col("epoch_us"), F.col("aligned"))).withColumn("_week", F.floor(F.col("local_us") / WEEK_US))
    rows = rows.withColumn("_b", F.last(offset, True).over(at.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_a", F.first(offset, True).over(at.rowsBetween(1, Window.unboundedFollowing)))
    before, after = F.col("local_us") - F.col("_b.local_us"), F.col("_a.local_us") - F.col("local_us")
    far = F.lit(NEAR_US + 1)
    nearer = F.when(F.coalesce(before, far) <= F.coalesce(after, far), F.struct(before.alias("d"), F.col("_b.off").alias("off"))).otherwise(F.struct(after.alias("d"), F.col("_a.off").alias("off")))
    return rows.withColumn("_n", nearer).withColumn("near", F.when(F.col("_n.d") <= NEAR_US, F.col("_n.off"))).drop("_b", "_a", "_n", "_week", "off")


def normalise_times(sidecar_docs: DataFrame, exif: DataFrame, source: Column | None = None) -> DataFrame:
    """(origin, rec_id, field, epoch_us, zone_source, evidence): every readable time as one instant.

    zone_source says where the zone came from: count (a count since 1970), value, own (the field's offset column), record (tz or
    timeZone), estimated, or null (no zone, and none could be estimated: epoch_us null). evidence says by what an estimated zone was
    found: document, neighbour, camera or library (their histories); null for all others.
    Null, empty and unreadable texts, dates without time of day and impossible dates give no row; a skipped local time gives a
    row without instant. Repeated rows give repeated results; empty tables give none. Other columns of the inputs are ignored.

    source: groups the files whose clocks were set alike; by default the first three parts of their path and the letters that their
    names begin with, which differ between cameras.
    """
    # Written once: it is read twice, and a filter pushed below the parsing would repeat the expressions of every step.
    parsed = materialise(stated_instants(sidecar_values(sidecar_docs).unionByName(exif_values(exif))), "stated")
    stated = parsed.where("local_us is not null or epoch_us is not null")
    name = F.substring_index("place", "/", -1)
    library = F.substring_index(F.left(F.col("place"), F.length("place") - F.length(name)), "/", 4)
    camera = F.lower(F.regexp_extract(name, "^[A-Za-z]*", 0))
    missing = F.col("epoch_us").isNull() & F.col("zone_source").isNull() & F.col("local_us").isNotNull()
    # readings alone can be asked for or tell an offset; counts since 1970 only anchor others
    rows = stated.where("local_us is not null").withColumn("library", library).withColumn("source", F.concat_ws("|", "library", camera) if source is None else source)
    none = F.lit(None).cast("bigint")
    told = rows.where("epoch_us is not null").withColumn("uploaded", none).withColumn("aligned", none)
    local = told.unionByName(_with_anchors(rows.where(missing), stated)).drop("place")
    local = materialise(_with_neighbours(local), "readings")
    zones = sorted(r.zone for r in local.where("zone is not null and epoch_us is not null").select("zone").distinct().collect())  # names of the public zone list
    history = zone_histories(_votes(local, zones), zones)
    history = materialise(history, "histories")
    of_camera = history.where(F.col("source").isNotNull() & (F.col("seen") >= LEAST_SEEN)).select("source", F.col("bucket").alias("_bucket"), F.col("est_zone").alias("cz"), F.col("est_off").alias("co"))
    of_library = history.where("source is null").select("library", F.col("bucket").alias("_bucket"), F.col("est_zone").alias("lz"), F.col("est_off").alias("lo"))
    asked = local.where(missing).withColumn("_bucket", F.floor(F.col("local_us") / BUCKET_US))
    asked = asked.join(of_camera.hint("merge"), ["source", "_bucket"], "left").join(of_library.hint("merge"), ["library", "_bucket"], "left")
    by_zone = lambda off, zone: I.to_utc_us(F.col("local_us"), F.col(off), F.col(zone))
    evidence = (
        F.when(F.col("aligned").isNotNull(), "document")
        .when(F.col("near").isNotNull(), "neighbour")
        .when(F.coalesce("cz", F.col("co").cast("string")).isNotNull(), "camera")
        .when(F.coalesce("lz", F.col("lo").cast("string")).isNotNull(), "library")
    )
    guess = asked.withColumn("evidence", evidence).select(
        "origin",
        "rec_id",
        "field",
        F.when(F.col("evidence").isin("document", "neighbour"), F.col("local_us") - F.coalesce("aligned", "near"))
        .when(F.col("evidence") == "camera", by_zone("co", "cz"))
        .when(F.col("evidence") == "library", by_zone("lo", "lz"))
        .alias("epoch_us"),
        F.when(F.col("evidence").isNotNull(), F.lit("estimated")).alias("zone_source"),
        "evidence",
    )
    return stated.where(~missing).select("origin", "rec_id", "field", "epoch_us", "zone_source", F.lit(None).cast("string").alias("evidence")).unionByName(guess)


def named_instants(times: DataFrame) -> DataFrame:
    """The rows of normalise_times whose instant is stated, not estimated: (origin, rec_id, field, epoch_us)."""
    return times.where("epoch_us is not null and zone_source <> 'estimated'").select("origin", "rec_id", "field", "epoch_us")
