"""Ingest: defaults, validation with quarantine, hashes, deduplication, upsert and run counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake import schema
from keepsake.functions import times


#: Rows of a repeated key that are spelled out at a time.
PIECE = 1 << 14


def fill_defaults(df: DataFrame, table: str) -> DataFrame:
    """Declared defaults where a column is missing or null; missing columns without one become null."""
    out = df
    for c in schema.columns(table):
        value = F.lit(c.default).cast(c.type) if c.default is not None else F.lit(None).cast(c.type)
        out = out.withColumn(c.name, F.coalesce(F.col(c.name), value) if c.name in df.columns and c.default is not None else F.col(c.name) if c.name in df.columns else value)
    return out.select(*(c.name for c in schema.columns(table)))


def normalise_times(df: DataFrame, table: str) -> DataFrame:
    """UTC by the field rule for every timestamp of the table."""
    own = [c.name for c in schema.columns(table) if c.kind == "timestamp" and c.name in df.columns]
    return df.withColumns({c: times.to_utc_field(F.col(c)) for c in own})


def stamp(df: DataFrame, now: Column) -> DataFrame:
    """created_at where it is missing, updated_at always."""
    created = F.coalesce(F.col("created_at"), now) if "created_at" in df.columns else now
    return df.withColumn("created_at", created.cast("timestamp_ntz")).withColumn("updated_at", now.cast("timestamp_ntz"))


def rules(table: str, present: list[str]) -> dict[str, Column]:
    """name -> condition that a row violates."""
    out: dict[str, Column] = {}
    for c in schema.columns(table):
        if c.name not in present:
            continue
        col = F.col(c.name)
        if c.required:
            out[f"{c.name}:required"] = col.isNull()
        if span := schema.range_of(table, c.name):
            out[f"{c.name}:range"] = ~col.between(*span)
        if values := schema.enum_of(table, c.name):
            out[f"{c.name}:enum"] = ~col.isin(*values)
        if c.name == "source_timezone":
            out[f"{c.name}:zone"] = col.isNotNull() & ~times.is_zone(col)
        if c.length:
            out[f"{c.name}:length"] = F.size(col) != c.length
    return out


def with_violations(df: DataFrame, checks: dict[str, Column], column: str = "violations") -> DataFrame:
    """column: names of violated rules, in their order. A comparison with null violates nothing."""
    found = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()]
    return df.withColumn(column, F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>"))


def validate(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined); the latter with its violations. Together they are all rows."""
    judged = with_violations(df, rules(table, df.columns))
    return judged.where(F.size("violations") == 0).drop("violations"), judged.where(F.size("violations") > 0)


def parse_json(df: DataFrame, table: str) -> DataFrame:
    """The table's JSON text columns as arrays, maps and structs; null where the text can't be read. Open-ended ones stay text."""
    own = {key.partition(".")[2]: kind for key, kind in schema.JSON.items() if key.startswith(f"{table}.")}
    return df.withColumns({c: F.from_json(c, kind) for c, kind in own.items() if c in df.columns})


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by order; rows with a null key all stay."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return df.where(known).withColumn("_rank", rank).where("_rank = 1").drop("_rank").unionByName(df.where(~known))


def only_new(batch: DataFrame, existing: DataFrame, key: str = "content_hash") -> DataFrame:
    """Rows of batch whose key existing doesn't have."""
    return batch.join(existing.select(key).distinct(), key, "left_anti")


def one_per_key(batch: DataFrame, keys: list[str], order: list[Column], repeats: str = "_repeats") -> DataFrame:
    """The first row by order of each key, and how many more had it. A partial aggregate, so that a key with many rows gathers nowhere."""
    first = F.min_by(F.struct(*(F.col(f"`{c}`") for c in batch.columns)), F.struct(*order))
    own = batch.groupBy(*keys).agg(first.alias("_first"), (F.count(F.lit(1)) - 1).alias(repeats))
    return own.select("_first.*", repeats)


def classify_upsert(batch: DataFrame, existing: DataFrame, keys: list[str], hash_column: str, order: list[Column] | None = None) -> DataFrame:
    """keys and action of every row of batch: created, updated, skipped (same hash) or failed (a null in the key).

    Of rows that repeat a key the first by order (by hash, if none is given) counts, the others are skipped. Rows that only exist are absent.
    """
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    new = one_per_key(batch.where(known), keys, order or [F.col(hash_column)]).select(*keys, F.col(hash_column).alias("_new"), "_repeats")
    old = existing.select(*keys, F.col(hash_column).alias("_old"), F.lit(True).alias("_known"))
    action = F.when(F.col("_known").isNull(), "created").when(F.col("_new").eqNullSafe(F.col("_old")), "skipped").otherwise("updated")
    every = F.col("_repeats") + 1
    pieces = new.join(old, keys, "left").select(*keys, "_repeats", action.alias("_first"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((every - 1) / PIECE))).alias("_piece"))
    rows = pieces.select(*keys, "_first", "_piece", F.posexplode(F.array_repeat(F.lit("skipped"), F.least(F.lit(PIECE), every - F.col("_piece") * PIECE).cast("int"))).alias("_at", "_rest"))
    done = rows.select(*keys, F.when((F.col("_piece") == 0) & (F.col("_at") == 0), F.col("_first")).otherwise(F.col("_rest")).alias("action"))
    return done.unionByName(batch.where(~known).select(*keys, F.lit("failed").alias("action")))


def upsert(batch: DataFrame, existing: DataFrame, keys: list[str], hash_column: str = "content_hash", order: list[Column] | None = None) -> DataFrame:
    """existing after batch: rows of batch replace those of the same key whose hash differs. Keys stay unique: of rows that
    repeat a key the first by order (by hash, if none is given) is taken; rows with a null in the key fail and are not stored."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    new = one_per_key(batch.where(known), keys, order or [F.col(hash_column)]).drop("_repeats")
    old = existing.select(*keys, F.col(hash_column).alias("_old"), F.lit(True).alias("_known"))
    changed = new.join(old, keys, "left").where(F.col("_known").isNull() | ~F.col("_old").eqNullSafe(F.col(hash_column))).select(*batch.columns)
    return existing.join(changed.select(*keys), keys, "left_anti").unionByName(changed, allowMissingColumns=True)


def is_merged(merged_into: Column) -> Column:
    """Whether a person was merged into another one."""
    return merged_into.isNotNull()


def counters(actions: DataFrame) -> DataFrame:
    names = ("created", "updated", "skipped", "failed")
    return actions.agg(F.count(F.lit(1)).alias("found"), *(F.count_if(F.col("action") == a).alias(a) for a in names))


def run_progress(current: Column, total: Column) -> Column:
    """Percent; null without a total or with a total of 0."""
    return F.when(total != 0, current / total * 100)


def run_is_running(status: Column) -> Column:
    return status == "running"


def run_is_finished(status: Column) -> Column:
    return status.isin("completed", "failed", "cancelled")
