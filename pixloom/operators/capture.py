"""Processing only new or changed records: change capture from a log with per-partition offsets.

A run (1) replays the batch plan that an interrupted run left behind, or else plans all rows above the committed offsets,
(2) writes that plan down before anything is processed, (3) reduces exactly the planned rows to one row per key, the one with the
latest version and offset, and adds them to the sink as a part of their own, and (4) commits the list of parts. Whatever fails in
between, the next run repeats the same plan and writes the same part, so no record is skipped or counted twice.

What a run costs goes with the new rows, not with the log or the sink: the scan of the log has a filter on the offset that reaches
the files (rows are appended in the order of their offsets, so old files and row groups are skipped), and parts of the sink are only
merged when FAN of them are of one level, so a row is written again as often as the logarithm of the number of runs.

    root/plan/<n>   (part, low, high): the offsets each log partition contributes to batch n
    root/sink/<n>   the rows of batch n, one per key; root/sink/<n>-<level> what batch n merged
    root/done/<n>   (part, level) of the sink after batch n; written last: batch n is committed
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixloom.functions.records import clean_hash, record_id
from pixloom.session import remove_dir

# The outcomes that finish a content.
FINISHED = ("placed", "archived", "trashed", "motion")
LOG_PARTITIONS = 64
FAN = 8


class ChangeCapture:
    """Incremental state of one log in `root` (a folder all executors reach); see the module's description.

    key, version, offset and payload name columns of the log. Log partitions are hashes of the key. offset must be unique within
    the log, and grow as rows are appended to a log partition; rows whose version is old but which are appended late have a new
    offset and are captured. (A log that renumbers its rows is none: see sources.inventory, which gives scans such offsets.)
    Rows without key or offset are no records. A null version loses against any other; of equal versions the larger offset wins.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, version: str, offset: str, payload: list[str], partitions: int = LOG_PARTITIONS):
        self.spark, self.root, self.key, self.version, self.offset, self.payload, self.partitions = spark, root.rstrip("/"), key, version, offset, payload, partitions

    def _names(self, what: str, finished: bool = False) -> list[str]:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{what}")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        found = [s.getPath() for s in fs.listStatus(where)]
        return [p.getName() for p in found if not finished or fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def _batches(self, what: str) -> list[int]:
        return sorted(map(int, self._names(what, finished=True)))

    def _read(self, what: str, batch: int | str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{what}/{batch}")

    def _ends(self, batch: int) -> dict[int, tuple[int | None, int | None]]:
        """part -> (low, high) of a plan: one row per log partition, so it is small whatever the log."""
        return {r.part: (r.low, r.high) for r in self._read("plan", batch).collect()}

    def _positions(self, log: DataFrame, above: int | None, up_to: int | None = None) -> DataFrame:
        """The records of the log with their log partition. Bounds are literals, so that they reach the scan."""
        if above is not None:
            log = log.where(F.col(self.offset) > F.lit(above))
        if up_to is not None:
            log = log.where(F.col(self.offset) <= F.lit(up_to))
        part = F.pmod(F.xxhash64(self.key), F.lit(self.partitions)).cast("int")
        return log.where(F.col(self.key).isNotNull() & F.col(self.offset).isNotNull()).select(
            part.alias("part"), F.col(self.offset).alias("offset"), F.col(self.key).alias("key"), F.col(self.version).alias("version"), *[F.col(c).alias(f"_{c}") for c in self.payload]
        )

    def _least(self, ends: list[int | None]) -> int | None:
        """The offset that every log partition has committed; null while one has none."""
        return min(ends) if len(ends) == self.partitions and None not in ends else None

    def plan(self, log: DataFrame) -> int | None:
        """The number of the batch to run: the one left unfinished, or a new one that is written down first; None if nothing is new."""
        planned, done = self._batches("plan"), self._batches("done")
        if planned and planned[-1] not in done:
            return planned[-1]
        before = {part: high for part, (_, high) in self._ends(done[-1]).items()} if done else {}
        least = self._least(list(before.values()))
        ends = {r.part: r.high for r in self._positions(log, least).groupBy("part").agg(F.max("offset").alias("high")).collect()}
        rows = [(p, before.get(p), max(x for x in (before.get(p), ends.get(p)) if x is not None)) for p in sorted({*before, *ends})]
        if done and all(low == high for _, low, high in rows):
            return None
        batch = planned[-1] + 1 if planned else 0
        self.spark.createDataFrame(rows, "part int, low bigint, high bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/plan/{batch}")
        return batch

    def rows(self, log: DataFrame, batch: int) -> DataFrame:
        """Exactly the log rows that the batch's plan names. The plan has one row per log partition, so it is broadcast."""
        ends = list(self._ends(batch).values())
        highest = max((high for _, high in ends if high is not None), default=None)
        found = self._positions(log, self._least([low for low, _ in ends]), highest)
        return found.join(F.broadcast(self._read("plan", batch)), "part").where("(low is null or offset > low) and offset <= high").drop("part", "low", "high")

    def _latest(self, rows: DataFrame) -> DataFrame:
        value = F.struct("version", "offset", *[f"_{c}" for c in self.payload])
        return rows.groupBy("key").agg(F.max(value).alias("v")).select("key", "v.*")

    def _parts(self, batch: int) -> list[tuple[str, int]]:
        return [(r.part, r.level) for r in self._read("done", batch).collect()]

    def apply(self, log: DataFrame, batch: int) -> None:
        """Add the batch to the sink (by key, latest version, then offset) and commit it. Repeating it changes nothing."""
        done = [n for n in self._batches("done") if n < batch]
        before = self._parts(done[-1]) if done else []
        self._latest(self.rows(log, batch)).write.mode("overwrite").parquet(f"{self.root}/sink/{batch}")
        parts, level = [*before, (str(batch), 0)], 0
        while len(same := [p for p, k in parts if k == level]) >= FAN:
            merged = f"{batch}-{level + 1}"
            self._latest(reduce(DataFrame.unionByName, [self._read("sink", p) for p in same])).write.mode("overwrite").parquet(f"{self.root}/sink/{merged}")
            parts = [x for x in parts if x[1] != level] + [(merged, level + 1)]
            level += 1
        self.spark.createDataFrame(parts, "part string, level int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/done/{batch}")
        # parts that this batch replaced stay for its readers until the next one commits; nobody reads the others
        used = {p for p, _ in parts} | {p for p, _ in before} | {str(batch)}
        for part in self._names("sink"):
            if part not in used:
                remove_dir(self.spark, f"{self.root}/sink/{part}")

    def run(self, log: DataFrame) -> DataFrame | None:
        """One run: replay or plan, process, commit. The sink as it is then: (key, version, offset, payload); None if there is none."""
        left = self._batches("plan")
        interrupted = bool(left) and left[-1] not in self._batches("done")
        batch = self.plan(log)
        if batch is not None:
            self.apply(log, batch)
        if interrupted:  # what was appended since the interrupted run planned
            batch = self.plan(log)
            if batch is not None:
                self.apply(log, batch)
        return self.sink()

    def _named(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col("key").alias(self.key), F.col("version").alias(self.version), F.col("offset").alias(self.offset), *[F.col(f"_{c}").alias(c) for c in self.payload])

    def changes(self) -> DataFrame | None:
        """What the last committed run brought, one row per key, with the log's names: what a consumer of changes has to read."""
        done = self._batches("done")
        return self._named(self._read("sink", done[-1])) if done else None

    def sink(self) -> DataFrame | None:
        """The committed sink, with the log's names for key, version and payload."""
        done = self._batches("done")
        if not done:
            return None
        parts = [self._read("sink", p) for p, _ in self._parts(done[-1])]
        return self._named(parts[0] if len(parts) == 1 else self._latest(reduce(DataFrame.unionByName, parts)))


def finished_hashes(extracted: DataFrame, hash_col: str = "hash", outcome: Column | None = None) -> DataFrame:
    """(hash): every content that some run finished, however its hash is written."""
    outcome = F.lower(F.trim("outcome")) if outcome is None else outcome
    return extracted.where(outcome.isin(*FINISHED)).select(clean_hash(F.col(hash_col)).alias("hash")).where("hash is not null").distinct()


def pending_contents(copies: DataFrame, extracted: DataFrame, root: str) -> DataFrame:
    """(hash): the contents that a run has to take up.

    One capture run over copies (key: the record's place, version: scanned_at, offset: scan_ord) brings the sink in root up to
    date; pending is the current content of any place that extracted does not show as finished. Rows without a readable hash
    leave the earlier content of their place in force; rows without place are ignored. Nulls, repeated rows and empty tables
    are allowed; further columns are ignored. A finished content that a place gets back is not pending.
    """
    log = copies.select(record_id().alias("place"), clean_hash(F.col("sha256")).alias("hash"), "scanned_at", "scan_ord").where("hash is not null")
    capture = ChangeCapture(copies.sparkSession, root, "place", "scanned_at", "scan_ord", ["hash"])
    sink = capture.run(log)
    if sink is None:
        return log.select("hash").limit(0)
    return sink.select("hash").distinct().join(finished_hashes(extracted), "hash", "left_anti")
