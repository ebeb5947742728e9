"""One view of all entities: timeline, look-ups, statistics, person and place searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EntityNotFoundError(LookupError):
    def __init__(self, entity_type: str, entity_id: object):
        super().__init__(f"{entity_type} {entity_id!r} was not found")
        self.entity_type, self.entity_id = entity_type, entity_id


def entity_rows(df: DataFrame, entity_type: str, entity_id: str, at: str | None = None, **more: Column) -> DataFrame:
    """entity_type, entity_id (text), occurred_at, and more columns, of one kind of entity."""
    when = F.col(at).cast("timestamp_ntz") if at else F.lit(None).cast("timestamp_ntz")
    return df.select(F.lit(entity_type).alias("entity_type"), F.col(entity_id).cast("string").alias("entity_id"), when.alias("occurred_at"), *(c.alias(n) for n, c in more.items()))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All parts as one view; a filter on it reaches the scan of every part."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def timeline(entities: DataFrame, *spans: tuple[str, str]) -> DataFrame:
    """Entities of the half-open ranges [start, end), all in one order of time."""
    at = F.col("occurred_at")
    inside = reduce(lambda a, b: a | b, ((at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz")) for start, end in spans))
    return entities.where(inside).orderBy(F.asc_nulls_last("occurred_at"), "entity_type", "entity_id")


def lookup(entities: DataFrame, entity_type: str, entity_id: object) -> DataFrame:
    return entities.where((F.col("entity_type") == entity_type) & (F.col("entity_id") == str(entity_id)))


def lookup_in(df: DataFrame, id_column: str, entity_id: object) -> DataFrame:
    """Rows of one kind of entity by their own id: the literal takes the column's type, so that the comparison reaches the scan. An id that
    isn't of that type has no row."""
    return df.where(F.col(id_column) == F.lit(str(entity_id)).try_cast(df.schema[id_column].dataType))


def get_entity(entities: DataFrame, entity_type: str, entity_id: object) -> DataFrame:
    """lookup() that raises EntityNotFoundError where there is none."""
    found = lookup(entities, entity_type, entity_id)
    if found.isEmpty():
        raise EntityNotFoundError(entity_type, entity_id)
    return found


def statistics(entities: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per entity type, and over all (entity_type null): count, first and last time. by names more columns, such as the source: then per type and
    each of them, per type, and over all."""
    return entities.rollup("entity_type", *(by or [])).agg(F.count(F.lit(1)).alias("entities"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))


def of_person(edges: DataFrame, person: Column) -> DataFrame:
    """Entities of one person from (person_id, role, entity_type, entity_id, occurred_at) rows, each once with its sorted roles."""
    return edges.where(F.col("person_id") == person).groupBy("entity_type", "entity_id", "occurred_at").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
