"""Aggregates and windows: threads, budgets, accounts, visits, sessions, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.operators import scan


def thread_rollup(messages: DataFrame, thread: str, at: str, sender: str) -> DataFrame:
    """message_count, first_message_at, last_message_at and participant_count of each thread."""
    return messages.groupBy(thread).agg(F.count(F.lit(1)).alias("message_count"), F.min(at).alias("first_message_at"), F.max(at).alias("last_message_at"), F.count_distinct(sender).alias("participant_count"))


def mail_thread_rollup(mails: DataFrame, thread: str, at: str, people: list[Column], is_read: Column) -> DataFrame:
    """email_count, first and last, sorted different participants, and is_read where all mails are."""
    everyone = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.array(*people))))))
    return mails.groupBy(thread).agg(F.count(F.lit(1)).alias("email_count"), F.min(at).alias("first_email_at"), F.max(at).alias("last_email_at"), everyone.alias("participants"), F.bool_and(is_read).alias("is_read"))


def child_counts(parents: DataFrame, key: str, children: DataFrame, ref: str, name: str) -> DataFrame:
    """parents with how many children each has (0 without), and has_<name>."""
    counts = children.where(F.col(ref).isNotNull()).groupBy(F.col(ref).alias(key)).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0))).withColumn(f"has_{name}", F.col(name) > 0)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def running_sum(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of value up to each row of its group."""
    return scan.scanned(df, group, order, sums={name: value})


def spent_by_month(transactions: DataFrame, at: str, amount: str, kind: str, category: str) -> DataFrame:
    """year, month, category, spent: expenses as positive numbers; transfers and income don't count."""
    own = transactions.where(F.col(kind) == "expense")
    return own.groupBy(F.year(at).alias("year"), F.month(at).alias("month"), F.col(category).alias("category")).agg((-F.sum(amount)).alias("spent"))


def budget_carryover(budgets: DataFrame) -> DataFrame:
    """From category, year, month, budgeted, spent: carryover (what the months before left) and available."""
    left = F.col("budgeted") - F.col("spent")
    order = Window.partitionBy("category").orderBy("year", "month")
    before = F.coalesce(F.sum(left).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return budgets.withColumn("carryover", before).withColumn("available", left + before)


def balances(transactions: DataFrame, account: str, amount: str) -> DataFrame:
    return transactions.groupBy(account).agg(F.sum(amount).alias("balance"), F.count(F.lit(1)).alias("transactions"))


def sessions(df: DataFrame, user: str, at: Column, gap: int) -> DataFrame:
    """user, session, started, ended, visits: a new session begins when more than gap has passed since the last visit. at is a number."""
    rows = scan.laid_out(df.select(F.col(user), at.alias("_at")), [user], [F.asc("_at")])
    seen = scan.carried(rows, [user], [F.asc("_at")], before={"_last": F.col("_at")})
    new = F.coalesce(F.col("_at") - F.col("_last") > gap, F.lit(True)).cast("int")
    numbered = scan.carried(seen.withColumn("_new", new), [user], [F.asc("_at")], sums={"session": F.col("_new")})
    return numbered.groupBy(user, "session").agg(F.min("_at").alias("started"), F.max("_at").alias("ended"), F.count(F.lit(1)).alias("visits"))


def since_previous(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """The value's growth since the row before in its group; null for the first."""
    return scan.scanned(df, group, order, before={name: value}).withColumn(name, value - F.col(name))


def explode_json_map(df: DataFrame, column: str, keep: list[str], key: str, value: str, kind: str = "map<string,array<string>>") -> DataFrame:
    """A row for each entry of a JSON map; text that can't be read gives none."""
    return df.select(*keep, F.explode(F.from_json(column, kind)).alias(key, value))


def counts_with_totals(df: DataFrame, dims: list[str], value: Column) -> DataFrame:
    """rows and total by all dims, by the first alone, and over everything; in one pass of grouping sets."""
    sets = [tuple(dims), (dims[0],), ()]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in dims)).agg(F.count(F.lit(1)).alias("rows"), value.alias("total"))
