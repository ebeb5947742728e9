"""Running sums, last values and rows before, over keys of any size: a prefix scan across ranges of one total order.

A window over a key sorts all of its rows in one task. Here the rows are dealt to ranges of (key, order) instead, so that a key with half of
all rows is many ranges; each range has its own windows, and what the ranges before it leave behind is carried into it. A boundary
between two ranges splits one key at most, so there are no more carries than ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.operators.graph import held

PART, TIE = "_part", "_tie"
_Named = dict[str, Column] | None


def laid_out(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """df as a table in the shared folder, with the number of each row's range (_part) and a hash that settles ties (_tie).

    Ranges are as many as the session has shuffle partitions, or fewer where the rows are few. Rows that agree in group, order and all that can be
    hashed lie in one range.
    """
    known = [f"`{f.name}`" for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = df.withColumn(TIE, F.xxhash64(*known) if known else F.lit(0))
    keys = [*(F.asc(c) for c in group), *order, F.asc(TIE)]
    return held(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(PART, F.spark_partition_id()))


def carried(rows: DataFrame, group: list[str], order: list[Column], sums: _Named = None, lasts: _Named = None, before: _Named = None) -> DataFrame:
    """rows of laid_out() with more columns: sums up to each row, the last value up to each row that isn't null, and values of the row before (null for a key's first)."""
    sums, lasts, before = sums or {}, lasts or {}, before or {}
    own = Window.partitionBy(*group, PART).orderBy(*order, F.asc(TIE))
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({
        **{f"_s_{n}": F.sum(c).over(upto) for n, c in sums.items()},
        **{f"_l_{n}": F.last(c, ignorenulls=True).over(upto) for n, c in lasts.items()},
        **{f"_b_{n}": F.lag(F.struct(c.alias("v"))).over(own) for n, c in before.items()},
        **{f"_o_{n}": F.struct(c.alias("v")) for n, c in before.items()},
        "_end": F.lead(F.lit(True)).over(own).isNull(),
    })
    ends = local.where("_end").select(*group, PART, *(f"_s_{n}" for n in sums), *(f"_l_{n}" for n in lasts), *(f"_o_{n}" for n in before))
    turn = Window.partitionBy(*group).orderBy(PART)
    past = turn.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col(PART).alias("_p"), F.row_number().over(turn).alias("_n"),
        *(F.sum(f"_s_{n}").over(past).alias(f"_cs_{n}") for n in sums), *(F.last(f"_l_{n}", ignorenulls=True).over(past).alias(f"_cl_{n}") for n in lasts), *(F.lag(f"_o_{n}").over(turn).alias(f"_cb_{n}") for n in before),
    ).where("_n > 1")
    same = reduce(lambda a, b: a & b, [local[g].eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col(PART) == F.col("_p"))
    met = local.join(F.broadcast(carry), same, "left")  # no more rows than ranges

    def added(n: str) -> Column:
        a, b = F.col(f"_s_{n}"), F.col(f"_cs_{n}")
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)

    made = [*(added(n).alias(n) for n in sums), *(F.coalesce(f"_l_{n}", f"_cl_{n}").alias(n) for n in lasts), *(F.coalesce(f"_b_{n}", f"_cb_{n}")["v"].alias(n) for n in before)]
    return met.select(*(local[c] for c in rows.columns if c not in {*sums, *lasts, *before}), *made)


def scanned(df: DataFrame, group: list[str], order: list[Column], sums: _Named = None, lasts: _Named = None, before: _Named = None) -> DataFrame:
    """df with the columns of carried(). Rows with the same order are taken by a hash of their contents."""
    return carried(laid_out(df, group, order), group, order, sums, lasts, before).drop(PART, TIE)


def span_counts(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(points with spans_around, spans with points_inside): how many half-open spans [start, end) of its key each point lies in, and how many points each span holds.

    One sweep over starts, ends and points in order of time, with running counts: output and work follow the rows, not the pairs. A null end is
    open; a span without a start or that ends where it starts, and one that has a null in its key, holds nothing, and such a point lies in nothing.
    """
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in on), F.lit(True))
    own = held(spans.withColumn("_span", F.monotonically_increasing_id()))
    live = own.where(known & F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
    kind = points.schema[at].dataType.simpleString()
    none = F.lit(None).cast(points.select(F.struct(*points.columns).alias("r")).schema["r"].dataType)

    def edge(rows: DataFrame, late: Column, time: Column, delta: int) -> DataFrame:
        return rows.select(*on, late.cast("int").alias("_late"), time.cast(kind).alias("_at"), F.lit(delta).alias("_delta"), F.lit(0).alias("_is"), F.col("_span"), none.alias("_row"))

    marks = edge(live, F.lit(0), F.col(start), 1).unionByName(edge(live, F.col(end).isNull(), F.coalesce(F.col(end), F.col(start)), -1))
    seen = points.where(known & F.col(at).isNotNull())
    marks = marks.unionByName(seen.select(*on, F.lit(0).alias("_late"), F.col(at).alias("_at"), F.lit(0).alias("_delta"), F.lit(1).alias("_is"), F.lit(None).cast("long").alias("_span"), F.struct(*points.columns).alias("_row")))
    order = [F.asc("_late"), F.asc("_at"), F.asc("_is")]  # at the same time edges come before points
    swept = held(scanned(marks, on, order, sums={"_around": F.col("_delta"), "_passed": F.col("_is")}))
    around = swept.where("_is = 1").select("_row.*", F.col("_around").cast("bigint").alias("spans_around"))
    rest = points.where(~(known & F.col(at).isNotNull())).withColumn("spans_around", F.lit(0).cast("bigint"))
    edges = swept.where("_is = 0").groupBy("_span").agg((F.max("_passed") - F.min("_passed")).cast("bigint").alias("points_inside"))
    inside = own.join(edges, "_span", "left").withColumn("points_inside", F.coalesce("points_inside", F.lit(0)))
    return around.unionByName(rest), inside.drop("_span")
