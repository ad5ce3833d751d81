"""Where each content goes, and under which name."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixloom.functions import filetypes as T
from pixloom.functions import paths as P
from pixloom.session import materialise


def dest_folder(bucket: Column, name: Column, year: Column, month: Column) -> Column:
    """root/kind/YYYY/MM, or root/kind/unknown without date; root is final, Archive or Trash by bucket, kind photos or videos."""
    root = F.when(bucket == "archive", "Archive").when(bucket == "trash", "Trash").otherwise("final")
    kind = T.media_kind(P.suffix(name))
    when = F.when(year.isNull() | month.isNull(), F.lit("unknown")).otherwise(F.concat_ws("/", year.cast("string"), F.lpad(month.cast("string"), 2, "0")))
    return F.concat_ws("/", root, kind, when)


def number_names(plan: DataFrame, order: list[str], folder: str = "folder", name: str = "name") -> DataFrame:
    """plan with final_name: names in a folder made distinct by _1, _2, ... in the order given, as if placed one after another.

    A generated name may meet a real one (a_1.jpg), which then moves on itself. Only names that come from one another by adding
    _number, through names that are all there, can meet: they form a family. Families of one row keep their name, families with
    one distinct name are numbered by a window (which spills, however often the name occurs), and only families in which a
    numbered name also occurs as a real one are settled one after another in Python, in sorted batches.
    """
    stem, ext = P.stem(F.col(name)), P.suffix(F.col(name))
    real = plan.select(folder, name).distinct()
    depth = F.size(F.split(F.regexp_extract(stem, r"(?<=.)((?:_\d+)+)$", 1), "_")) - 1
    cut = F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda k: F.struct(k.alias("depth"), F.concat(F.array_join(F.slice(F.split(stem, "_"), 1, F.size(F.split(stem, "_")) - k), "_"), ext).alias("up")))
    ups = real.where(depth >= 1).select(folder, name, F.inline(cut)).join(real.select(F.col(folder), F.col(name).alias("up")), [folder, "up"])
    steps = ups.groupBy(folder, name).agg(F.array_sort(F.collect_set("depth")).alias("_d"))
    steps = steps.select(folder, name, F.size(F.filter("_d", lambda x, i: x == i + 1)).alias("_k"))
    rows = plan.join(steps, [folder, name], "left")
    pieces = F.split(stem, "_")
    rows = rows.withColumn("_family", F.concat(F.array_join(F.slice(pieces, 1, F.size(pieces) - F.coalesce("_k", F.lit(0))), "_"), ext)).drop("_k").select(*plan.columns, "_family")
    sizes = rows.groupBy(folder, "_family").agg(F.count("*").alias("_n"), (F.min(name) == F.max(name)).alias("_one"))
    rows = materialise(rows.join(sizes, [folder, "_family"], "left").select(*plan.columns, "_family", "_n", "_one"), "families")
    alone = rows.where("_n = 1 or _n is null").withColumn("final_name", F.col(name)).drop("_family", "_n", "_one")
    k = F.row_number().over(Window.partitionBy(folder, "_family").orderBy(*order)) - 1
    repeated = rows.where("_n > 1 and _one").withColumn("_k", k)
    repeated = repeated.withColumn("final_name", F.when(F.col("_k") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("_k").cast("string"), ext)))
    shared = rows.where("_n > 1 and not _one").drop("_n", "_one")
    columns = alone.columns

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by family and order; of the family at hand only its names are kept, not its rows."""
        family, taken, following = None, set(), {}
        for batch in batches:
            out = []
            for at, group, own in zip(batch[folder], batch["_family"], batch[name]):
                if (at, group) != family:
                    family, taken, following = (at, group), set(), {}
                dot = own.rfind(".")
                s, e = (own[:dot], own[dot:]) if 0 < dot < len(own) - 1 else (own, "")
                picked, k = own, following.get(own, 1)
                while picked in taken:
                    picked, k = f"{s}_{k}{e}", k + 1
                following[own] = k
                taken.add(picked)
                out.append(picked)
            yield batch.assign(final_name=out)[columns]

    ordered = shared.repartition(folder, "_family").sortWithinPartitions(folder, "_family", *order)
    return alone.unionByName(repeated.drop("_family", "_n", "_one", "_k")).unionByName(ordered.mapInPandas(settle, alone.schema))


def _numbered(names: DataFrame) -> DataFrame:
    """names(folder, name) with parent and k: each name as itself, and as what it is the number k of, if it ends in a number."""
    stem, ext = P.stem(F.col("name")), P.suffix(F.col("name"))
    k = F.regexp_extract(stem, r"(?s)^.+_([1-9]\d*)$", 1)
    itself = F.struct(F.col("name").alias("parent"), F.lit("").alias("k"))
    of = F.struct(F.concat(F.left(stem, F.length(stem) - F.length(k) - 1), ext).alias("parent"), k.alias("k"))
    return names.select("*", F.inline(F.when(k == "", F.array(itself)).otherwise(F.array(itself, of))))


def may_be_reused(plan: DataFrame, files: DataFrame, name: str = "name") -> DataFrame:
    """The rows of files(folder, name) that have the name of a row of plan(folder, name) or a number of it: only these need hashing."""
    wanted = plan.select("folder", F.col(name).alias("parent")).distinct()
    return _numbered(files).join(wanted, ["folder", "parent"], "left_semi").select("folder", "name").distinct()


def number_beside(plan: DataFrame, files: DataFrame, hashes: DataFrame, order: list[str], name: str = "name") -> DataFrame:
    """plan(folder, name, sha256, ...) with final_name and present, beside files(folder, name) that are there already.

    A content that lies in its folder under its own name or a number of it keeps that name and is present (hashes(folder, name,
    sha256) holds what may_be_reused picks; the lowest number is taken). The others are numbered as by number_names, as if
    placed after all files, so none gets a name that is taken. Rows without folder keep their name. (folder, name, sha256) must be a key of plan.
    """
    family = lambda n: F.concat(F.regexp_replace(P.stem(n), r"(?<=.)(?:_\d+)+$", ""), P.suffix(n))
    slim = plan.where("folder is not null").select("folder", F.col(name).alias("name"), F.lower("sha256").alias("sha256"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    held = _numbered(hashes.where("sha256 is not null")).groupBy("folder", "parent", "sha256").agg(F.min(F.struct(F.length("k"), "k", "name"))["name"].alias("there"))
    slim = materialise(slim.join(held.withColumnRenamed("parent", "name"), ["folder", "name", "sha256"], "left"), "beside")
    new = slim.where("there is null").drop("there").withColumn("_late", F.lit(1))
    met = new.select("folder", family(F.col("name")).alias("_f")).distinct()
    old = files.withColumn("_f", family(F.col("name"))).join(met, ["folder", "_f"], "left_semi")
    old = old.select("folder", "name", F.lit("").alias("sha256"), *[F.lit(0).cast(new.schema[f"_o{i}"].dataType).alias(f"_o{i}") for i in range(len(order))], F.lit(0).alias("_late"))
    numbered = number_names(old.unionByName(new), ["_late", *[f"_o{i}" for i in range(len(order))]]).where("_late = 1").select("folder", "name", "sha256", "final_name", F.lit(False).alias("present"))
    kept = slim.where("there is not null").select("folder", "name", "sha256", F.col("there").alias("final_name"), F.lit(True).alias("present"))
    found = numbered.unionByName(kept).select("folder", F.col("name").alias(name), F.col("sha256").alias("_h"), "final_name", "present")
    rows = plan.withColumn("_h", F.lower("sha256")).join(found, ["folder", name, "_h"], "left")
    return rows.select(*plan.columns, F.coalesce("final_name", name).alias("final_name"), F.coalesce("present", F.lit(False)).alias("present"))


def pending(plan: DataFrame, done: DataFrame, key: str = "sha256") -> DataFrame:
    """The rows of plan whose key done does not hold: what a resumed run has still to do."""
    return plan.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def reuse_present(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """plan(folder, final_name, sha256, ...) with present: whether existing(path, sha256) holds this content at that place already."""
    there = existing.select(F.col("path").alias("_path"), F.lower("sha256").alias("sha256")).distinct().withColumn("_there", F.lit(True))
    return plan.withColumn("_path", F.concat_ws("/", "folder", "final_name")).join(there, ["_path", "sha256"], "left").withColumn("present", F.col("_there").isNotNull()).drop("_path", "_there")
