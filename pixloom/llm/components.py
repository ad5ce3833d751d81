"""Consolidating pairwise matches into groups: connected components over billions of pairs.

1. The component of the highest-degree vertex (the giant one, where there is one) is peeled by breadth-first joins: each round
   joins only the frontier with the edges. If the search is not exhausted after `bfs_rounds` rounds, the part that it reached is
   contracted to its start, so nothing is lost on graphs that are long rather than wide.
2. The peeled component is anti-joined away.
3. What remains is labelled by minimum propagation. Plain propagation needs as many rounds as the longest shortest path, and
   chains grow with the data, so each round also re-links: every vertex links its larger neighbours to the smallest vertex it
   knows, then its smaller ones, until all links are stars around the minimum. The number of rounds grows with the logarithm
   of the component's length.

Every round is written to the shared folder. Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixloom.session import remove_dir, work_dir

BFS_ROUNDS = 6


class _Store:
    """Rounds written to numbered folders of one work folder; what is no longer read is removed, and all of it at the end."""

    def __init__(self, df: DataFrame, what: str):
        self.spark, self.root, self.n = df.sparkSession, work_dir(df.sparkSession, what), 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._pixloom_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_pixloom_path", None)
        if path:
            remove_dir(self.spark, path)

    def close(self, result: DataFrame) -> DataFrame:
        """The result, written beside the work folder, which is removed."""
        path = f"{self.root}-result"
        result.write.parquet(path)
        remove_dir(self.spark, self.root)
        return self.spark.read.schema(result.schema).parquet(path)


def _links(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(u, v), u > v, once each; pairs with a missing end and self pairs are no links."""
    return (
        pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .distinct()
    )


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.inline(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))))


def _peel(store: _Store, links: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """((node, root) of what was reached from the highest-degree vertex, the links that are left)."""
    both = _both_ways(links)
    # a frontier is a written table: Spark broadcasts it where its size on disk says that it is small, and joins by sorting beyond
    top = both.groupBy("a").count().orderBy(F.desc("count"), "a").limit(1).select(F.col("a").alias("node"), F.col("a").alias("root"))
    reached = frontier = store.put(top, "front")
    ended = False
    for _ in range(rounds):
        step = both.join(frontier.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "root").distinct()
        step = store.put(step.join(reached, "node", "left_anti"), "front")
        if step.isEmpty():
            ended = True
            break
        frontier, reached = step, reached.unionByName(step)
    if ended:
        rest = links.join(reached.select(F.col("node").alias("u")), "u", "left_anti")
    else:
        for side in ("u", "v"):
            links = links.join(reached.withColumnRenamed("node", side), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
        rest = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    return reached, rest


def _star_round(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link the larger neighbours of every vertex to the smallest vertex it knows, then do so for its smaller ones."""
    both = _both_ways(links)
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
    return large, least


def connected_groups(pairs: DataFrame, left: str = "left_ord", right: str = "right_ord", bfs_rounds: int = BFS_ROUNDS) -> DataFrame:
    """(node, group_id): for every end of a link, the smallest node it is linked to, directly or through others.

    Pairs with a null end and self pairs are no links; repeated and reversed pairs count once. An empty table gives no rows.
    Other columns are ignored. bfs_rounds bounds the frontier joins of the peeling, not what is labelled.
    """
    store = _Store(pairs, "groups")
    links = store.put(_links(pairs, left, right), "links")
    if links.isEmpty():
        return store.close(links.select(F.col("u").alias("node"), F.col("v").alias("group_id")))
    inside, rest = _peel(store, links, bfs_rounds)
    inside = store.put(inside, "inside")
    now = store.put(rest, "round")
    before = None
    while True:
        large = store.put(_star_round(now)[0], "large")
        # after the first half every vertex knows only smaller ones: link them all to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = store.put(small.where("u <> v").distinct(), "round")
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        store.drop(large)
        store.drop(now)
        now = after
        if (state.n, state.h) == before:
            break
        before = (state.n, state.h)
    # now: stars around the smallest vertex of each component, where the peeled part is one vertex
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("group"))
    peeled = inside.join(labels.select(F.col("node").alias("root"), "group"), "root", "left").select("node", F.coalesce("group", "root").alias("star"))
    centres = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("group"))
    rest_labels = labels.unionByName(centres).select("node", F.col("group").alias("star"))
    # the peeled vertices may hold the smallest number of their component
    least = peeled.groupBy("star").agg(F.min("node").alias("m"))
    all_labels = peeled.unionByName(rest_labels.join(peeled.select("node"), "node", "left_anti"))
    return store.close(all_labels.join(least, "star", "left").select("node", F.least(F.coalesce("m", "star"), "star").alias("group_id")))
