"""Trees, chains and graphs over parent columns and links."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, in local mode a temporary folder that becomes its value, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster sees")
        folder = "file://" + tempfile.mkdtemp(prefix="keepsake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def held(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that loops have no growing lineage and lost executors lose nothing."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tree(df: DataFrame, node: str, parent: str, name: str | None = None, separator: str = "/") -> DataFrame:
    """node, root, depth (0 at a root), and with a name path: of all nodes that a root reaches. A null or unknown parent makes a root; nodes are unique.

    Pointers of pointers: a round doubles the way that each node knows, so that a chain costs the logarithm of its length. The rounds
    end when no node has come to a root, as a deeper one would have nodes above it that had. Cycles have no root and are left out.
    """
    rows = df.select(F.col(node).alias("node"), F.col(parent).alias("parent"), *([F.col(name).cast("string").alias("path")] if name else []))
    known = rows.select(F.col("node").alias("parent"), F.lit(True).alias("_known"))
    at = held(rows.join(known, "parent", "left").select("node", F.when(F.col("_known"), F.col("parent")).alias("to"), F.when(F.col("_known"), 1).otherwise(0).alias("depth"), *rows.columns[2:]))
    path = [F.concat_ws(separator, "above.path", "path").alias("path")] if name else []
    out = held(at.where("to IS NULL").withColumn("root", F.col("node")).select("node", "root", "depth", *rows.columns[2:]))
    open_ = at.where("to IS NOT NULL")
    for _ in range(open_.count().bit_length()):  # no way is longer than there are nodes on it
        far = out.withColumn("far", F.lit(None).cast(at.schema["to"].dataType)).unionByName(open_.withColumn("root", F.lit(None).cast(at.schema["node"].dataType)).withColumnRenamed("to", "far"))
        far = far.select(F.col("node").alias("to"), F.struct("far", "root", "depth", *rows.columns[2:]).alias("above"))
        step = held(open_.join(far, "to").select("node", F.col("above.far").alias("to"), F.col("above.root").alias("root"), (F.col("depth") + F.col("above.depth")).alias("depth"), *path))
        ended, open_ = step.where("to IS NULL").drop("to"), step.where("to IS NOT NULL").drop("root")
        if ended.isEmpty():
            break
        out = out.unionByName(ended)
    return out


def subtree_totals(paths: DataFrame, counts: DataFrame, node: str, value: str, separator: str = "/") -> DataFrame:
    """path and total: what counts (node, value) has at or below each path; from tree()'s node and path."""
    own = paths.join(counts.withColumnRenamed(node, "node"), "node", "left").select("path", F.coalesce(value, F.lit(0)).alias("_v"))
    parts = F.split("path", separator)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))
    return own.select(F.explode(above).alias("path"), "_v").groupBy("path").agg(F.sum("_v").alias("total"))


def canonical(df: DataFrame, node: str, merged_into: str) -> DataFrame:
    """node and canonical: the end of each chain of merges, by following pointers of pointers. A chain that runs into a cycle ends at its least node."""
    own = df.select(F.col(node).alias("node"), F.coalesce(merged_into, node).alias("to"))
    known = own.select(F.col("node").alias("to"), F.lit(True).alias("_known"))
    at = held(own.join(known, "to", "left").select("node", "to", (F.col("_known").isNull() | F.col("node").eqNullSafe(F.col("to"))).alias("ended")))
    done, first = at.where("ended"), at.where("NOT ended")
    open_ = first
    for _ in range(first.count().bit_length()):
        far = done.union(open_).select(F.col("node").alias("to"), F.col("to").alias("far"), "ended")
        step = held(open_.drop("ended").join(far, "to").select("node", F.col("far").alias("to"), "ended"))
        ended, open_ = step.where("ended"), step.where("NOT ended")
        if ended.isEmpty():
            break
        done = done.unionByName(ended)
    out = done.select("node", F.col("to").alias("canonical"))
    rings = open_.count()
    if not rings:
        return out
    # what is left leads into a cycle: after as many steps as there are nodes, each has gone round, and knows the least node on its way
    ring = held(first.join(open_.select("node"), "node", "left_semi").select("node", "to", F.col("to").alias("least")))
    for _ in range(rings.bit_length()):
        far = ring.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("least").alias("low"))
        ring = held(ring.join(far, "to").select("node", F.col("far").alias("to"), F.least("least", "low").alias("least")))
    ends = ring.select(F.col("node").alias("to"), F.col("least").alias("canonical"))
    return out.unionByName(ring.select("node", "to").join(ends, "to").select("node", "canonical"))


def symmetric(links: DataFrame, both: list[str]) -> DataFrame:
    """links (source, target, link_type) with the reverse of those whose type is in both; each once."""
    back = links.where(F.col("link_type").isin(both)).select(F.col("target").alias("source"), F.col("source").alias("target"), "link_type")
    return links.select("source", "target", "link_type").unionByName(back).distinct()


def within_hops(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """node and hops: nodes that edges (source, target, both ways) reach from starts (node), with the least number of hops.

    Only the frontier meets the edges, once in each direction; what it finds is made unique, not the edges.
    """
    found = starts.select("node", F.lit(0).alias("hops"))
    frontier = found
    for h in range(1, hops + 1):
        ahead = [frontier.join(edges, F.col("node") == F.col(a)).select(F.col(b).alias("node")) for a, b in (("source", "target"), ("target", "source"))]
        frontier = held(ahead[0].union(ahead[1]).distinct().join(found, "node", "left_anti").withColumn("hops", F.lit(h)))
        found = found.unionByName(frontier)
    return found


def connected(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of all nodes of edges (source, target).

    Every label takes the least label next to it; links between labels shrink until none is left.
    """
    rest = held(edges.select(F.col("source").alias("u"), F.col("target").alias("v")).distinct())
    labels = held(rest.select(F.col("u").alias("node")).union(rest.select("v")).distinct().withColumn("component", F.col("node")))
    rest = rest.where("u <> v")
    while not rest.isEmpty():
        both = rest.union(rest.select("v", "u"))
        to = held(both.groupBy(F.col("u").alias("old")).agg(F.min("v").alias("v")).select("old", F.least("old", "v").alias("new")))
        far = to.select(F.col("old").alias("new"), F.col("new").alias("far"))
        to = held(to.join(far, "new", "left").select("old", F.coalesce("far", "new").alias("new")))
        labels = held(labels.join(to, labels["component"] == to["old"], "left").select("node", F.coalesce("new", "component").alias("component")))
        u, v = to.select(F.col("old").alias("u"), F.col("new").alias("x")), to.select(F.col("old").alias("v"), F.col("new").alias("y"))
        rest = held(rest.join(u, "u").join(v, "v").where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct())
    return labels
