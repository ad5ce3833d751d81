"""A lasting inventory of scanned places: each scan appends only what is new or changed, with offsets that are never given again.

    root/log/<n>    the rows of append n, in the columns of the scan, with scan_ord and scanned_at
    root/state      the state of the change capture over that log (place -> its latest content)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixloom.functions.records import clean_hash, record_id
from pixloom.operators.capture import ChangeCapture
from pixloom.session import remove_dir
from pixloom.sources.files import number_rows


class Inventory:
    """The log of one library in `root`, a folder that all executors reach. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.capture = ChangeCapture(spark, f"{self.root}/state", "place", "scanned_at", "scan_ord", ["hash"])

    def _appends(self) -> list[int]:
        """Whole appends; what a scan that was interrupted left behind is not one."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.root}/log")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(where) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def log(self) -> DataFrame | None:
        """All rows that were ever appended, in the columns of `copies`; None before the first scan."""
        parts = [f"{self.root}/log/{n}" for n in self._appends()]
        return self.spark.read.parquet(*parts) if parts else None

    def places(self) -> DataFrame | None:
        """(place, hash, scan_ord, scanned_at): the latest content of each place. Only rows appended since the last call are read for it."""
        log = self.log()
        if log is None:
            return None
        return self.capture.run(log.select(record_id().alias("place"), clean_hash(F.col("sha256")).alias("hash"), "scanned_at", "scan_ord").where("hash is not null"))

    def append(self, scanned: DataFrame) -> int:
        """Append the rows of a scan whose place is new or holds another content than before; how many there were.

        They get scan_ord above all earlier ones, in the order of the scan's own numbers, and this run's time as scanned_at. Rows
        whose content could not be read (null sha256), or without place, are not appended.
        """
        done = self._appends()
        known = self.places()
        fresh = scanned.withColumn("_place", record_id()).withColumn("_hash", clean_hash(F.col("sha256"))).where("_place is not null and _hash is not null")
        if known is not None:
            fresh = fresh.join(known.select(F.col("place").alias("_place"), F.col("hash").alias("_hash")), ["_place", "_hash"], "left_anti")
        last = self.log().agg(F.max("scan_ord")).first()[0] if done else 0
        target = f"{self.root}/log/{done[-1] + 1 if done else 0}"
        columns = [c for c in scanned.columns if c not in ("scan_ord", "scanned_at")]
        numbered = number_rows(fresh.select(F.col("scan_ord").alias("_old"), *columns), ["_old"])
        numbered.select((F.col("scan_ord") + F.lit(last)).alias("scan_ord"), *columns, F.current_timestamp().alias("scanned_at")).write.mode("overwrite").parquet(target)
        added = self.spark.read.parquet(target).count()
        if done and not added:
            remove_dir(self.spark, target)
        return added

    def current(self) -> DataFrame | None:
        """The rows of the log that hold the latest content of their place: what `copies` is for the operators."""
        places = self.places()
        return None if places is None else self.log().join(places.select("scan_ord"), "scan_ord", "left_semi")
