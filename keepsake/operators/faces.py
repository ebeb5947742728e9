"""People by faces: clusters of face encodings, a person for each cluster by majority, and links of media to people.

A face is a core if enough others lie within the distance of it; cores that lie within it are one cluster, and a face that is no core
belongs to that of its nearest core (density-based clustering: a chain of doubtful faces joins nothing). Encodings meet by cells of vectors,
so that most of them never do; copies count with their number and are never spelled out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.operators import graph, vectors
from keepsake.operators.graph import held

#: Least cosine of two encodings of one person, and faces (itself among them) that make a core.
LIKE, CORE = 0.9, 3


def clusters(faces: DataFrame, key: str = "id", encoding: str = "encoding", like: float = LIKE, core: int = CORE) -> DataFrame:
    """id, cluster (the smallest id of its cores; null for noise) of all faces with a usable encoding (see vectors.usable()); ids are whole numbers and unique.

    Of cores that are equally near to a face that is none, the one with the smallest id counts. Faces whose encodings are all alike are one class of copies.
    """
    members, pairs = (held(x) for x in vectors.similar_classes(faces, like, key, encoding))
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"))
    both = pairs.select("a", "b", "similarity").union(pairs.select("b", "a", "similarity"))
    around = both.join(sizes.withColumnRenamed("class_id", "b"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("copies").alias("others"))
    cores = held(sizes.join(around, "class_id", "left").where(F.col("copies") + F.coalesce("others", F.lit(0)) >= core).select(F.col("class_id").alias("core")))
    edges = pairs.join(cores.withColumnRenamed("core", "a"), "a").join(cores.withColumnRenamed("core", "b"), "b").select(F.col("a").alias("source"), F.col("b").alias("target"))
    found = held(graph.connected(edges.union(cores.select(F.col("core").alias("source"), F.col("core").alias("target")))).select(F.col("node").alias("core"), F.col("component").alias("cluster")))
    near = both.join(cores.withColumnRenamed("core", "b"), "b").join(cores.select(F.col("core").alias("a")), "a", "left_anti")
    near = near.groupBy(F.col("a").alias("class_id")).agg(F.max_by("b", F.struct("similarity", -F.col("b"))).alias("core")).join(found, "core").select("class_id", "cluster")
    return members.join(found.withColumnRenamed("core", "class_id").union(near), "class_id", "left").select("id", "cluster")


def people(faces: DataFrame, clustered: DataFrame, key: str = "id", person: str = "person_id") -> DataFrame:
    """cluster, person, faces, confidence: the person whom most labelled faces of a cluster name (the smaller one where two are named as often), how many do, and their share.

    A cluster without a labelled face has no row.
    """
    named = clustered.where("cluster IS NOT NULL").join(faces.where(F.col(person).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(person).alias("person")), "id")
    counts = named.groupBy("cluster", "person").agg(F.count(F.lit(1)).alias("faces"))
    most = counts.groupBy("cluster").agg(F.min(F.struct((-F.col("faces")).alias("least"), "person")).alias("m"), F.sum("faces").alias("all"))
    return most.select("cluster", F.col("m.person").alias("person"), (-F.col("m.least")).alias("faces"), (-F.col("m.least") / F.col("all")).alias("confidence"))


def by_faces(faces: DataFrame, key: str = "id", media: str = "media_id", person: str = "person_id", encoding: str = "encoding", like: float = LIKE, core: int = CORE) -> DataFrame:
    """media, person, confidence: who is in which medium. A labelled face is its person with confidence 1; any other is that of its cluster, with the cluster's confidence; of several faces the surest counts."""
    clustered = held(clusters(faces, key, encoding, like, core))
    known = people(faces, clustered, key, person)
    own = faces.select(F.col(key).cast("long").alias("id"), F.col(media).alias("media"), F.col(person).alias("_said"))
    rows = own.join(clustered, "id", "left").join(known.select("cluster", "person", "confidence"), "cluster", "left")
    named = rows.select("media", F.coalesce("_said", "person").alias("person"), F.when(F.col("_said").isNotNull(), F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"))
    return named.where("media IS NOT NULL AND person IS NOT NULL").groupBy("media", "person").agg(F.max("confidence").alias("confidence"))
