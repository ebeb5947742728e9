"""Audit of filters that run one after another: what each step of any order takes, and what is a filter's own doing.

Every row gets a mask with a bit for each filter that it fails. All that an order can ask for follows from the masks'
counts by part: a subset-zeta transform sums them over the subsets of every mask, which gives the rows that survive any set of
filters. A step of an order is the difference between two neighbouring sets, and so are the labelled rows that it loses;
a Shapley value is a weighted sum of such differences. The texts are read once, whatever the number of orders.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Mapping, Sequence
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm._shared import written

GAP = r"[\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, r"[#$%&*|]"
#: A filter of a text: of (text, its words) to a Column that is true where it fails.
Filter = Callable[[Column, Column], Column]
#: Filters by their letter; that for repeated texts (REPEATED) needs the whole table and comes last.
FILTERS: dict[str, Filter] = {
    "A": lambda text, words: F.size(words) < MIN_WORDS,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
    "C": lambda text, words: 100 * (F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))) > MAX_CAPITAL_PERCENT * F.length(text),
    "D": lambda text, words: text.rlike(SYMBOLS),
}
REPEATED = "E"
#: A table of 2 ** MOST_FILTERS sums a part; beyond, the transform is no longer a few numbers.
MOST_FILTERS = 12


def masks(docs: DataFrame, filters: Mapping[str, Filter], part: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, part, mask (bit i: the i-th filter fails), digest of the text; one row per row of docs, from one pass over the texts.

    A null text is empty and a null part is the empty string. Texts of any length are judged whole.
    """
    rows = docs.select(docs[key].alias("key"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text], F.lit("")).alias("body"))
    rows = rows.select("key", "part", "body", F.array_remove(F.split("body", GAP), "").alias("words"))
    mask = F.lit(0)
    for bit, fails in enumerate(filters.values()):
        mask = mask + F.when(fails(F.col("body"), F.col("words")), F.lit(1 << bit)).otherwise(0)
    return rows.select("key", "part", mask.alias("mask"), F.unhex(F.sha2("body", 256)).alias("digest"))


def with_repeats(rows: DataFrame, bit: int) -> DataFrame:
    """rows of masks() with the bit set where a smaller key has the same text, anywhere in the table.

    The least key of each text is found by partial sums, so a text that a third of all rows share gathers nowhere; it then meets its rows by
    (digest, key), where only rows that repeat both share a place. A null key is smaller than none and has none that is smaller.
    """
    first = rows.groupBy("digest").agg(F.min("key").alias("key")).where("key IS NOT NULL").withColumn("first", F.lit(True))
    repeated = F.col("key").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["digest", "key"], "left").select("key", "part", (F.col("mask") + F.when(repeated, F.lit(1 << bit)).otherwise(0)).alias("mask"))


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: rows with that mask, and those of them whose key a label calls good (quality = 1) or toxic (toxic = 1).

    A key labelled more than once is good if one of its labels says so, and toxic likewise; a null key has no label.
    """
    own = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("key"))
    own = own.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    return rows.join(own, "key", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(x) for x in ("good", "toxic")))


def survivors(counts: DataFrame, many: int) -> DataFrame:
    """part and three arrays (n, good, toxic) indexed by set of filters: how many rows of the part none of the set rejects.

    The subset-zeta transform: for each bit in turn, a mask that has it adds the sum of its neighbour without it. What survives a set is the
    sum over the subsets of its complement. A part brings at most 2 ** many counts.
    """
    full = (1 << many) - 1
    table = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))
    rows = counts.groupBy("part").agg(table.alias("table"))
    bits = F.array(*(F.lit(1 << b) for b in range(many)))

    def zeta(field: str) -> Column:
        start = F.transform(F.sequence(F.lit(0), F.lit(full)), lambda m: F.coalesce(F.try_element_at(F.col("table"), m)[field], F.lit(0).cast("bigint")))
        summed = F.aggregate(bits, start, lambda sums, bit: F.transform(sums, lambda x, m: x + F.when(m.bitwiseAND(bit) != 0, F.get(sums, m - bit)).otherwise(F.lit(0).cast("bigint"))))
        return F.reverse(summed)  # place s holds the subsets of (full - s)

    return rows.select("part", *(zeta(x).alias(x) for x in ("n", "good", "toxic")))


def shapley(surviving: Column, bit: int, many: int) -> Column:
    """What the filter removes, summed over all orders of all filters, from the array n of survivors()."""
    weights = F.array(*(F.lit(factorial(size) * factorial(many - 1 - size)).cast("bigint") for size in range(many)))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit((1 << many) - 1)),
        F.lit(0).cast("bigint"),
        lambda total, s: total + F.when(s.bitwiseAND(F.lit(1 << bit)) == 0, F.get(weights, F.bit_count(s)) * (F.get(surviving, s) - F.get(surviving, s + (1 << bit)))).otherwise(F.lit(0).cast("bigint")),
    )


def order_steps(sets: DataFrame, names: str, orders: Sequence[str] | None = None) -> DataFrame:
    """A row for each part, order and step, from survivors(): all orders of the filters, or those given."""
    many, full = len(names), (1 << len(names)) - 1
    steps = []
    for order in orders if orders is not None else map("".join, itertools.permutations(names)):
        before = 0
        for k, name in enumerate(order):
            steps.append({"filter_order": order, "step": k + 1, "bit": names.index(name), "before": before, "after": before | 1 << names.index(name)})
            before = steps[-1]["after"]
    literal = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int, after: int>>")
    rows = sets.select("part", "n", "good", "toxic", F.array(*(shapley(F.col("n"), b, many) for b in range(many))).alias("shapley"), F.explode(literal).alias("s"))
    lost = lambda x, low, high: F.get(x, low) - F.get(x, high)
    own = F.expr("shiftleft(1, s.bit)")
    return rows.select(
        "part", "s.filter_order", "s.step",
        F.get("n", F.col("s.after")).alias("kept"), lost("n", F.col("s.before"), F.col("s.after")).alias("removed"),
        (lost("n", F.lit(0), own) - lost("n", F.col("s.before"), F.col("s.after"))).alias("redundant"),
        lost("n", F.lit(full) - own, F.lit(full)).alias("unique_fails"),
        lost("good", F.col("s.before"), F.col("s.after")).alias("good_lost"), lost("toxic", F.col("s.before"), F.col("s.after")).alias("toxic_lost"),
        F.get("shapley", F.col("s.bit")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Filter] = FILTERS, repeated: str | None = REPEATED, orders: Sequence[str] | None = None, part: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part for five filters.

    filters are named by one letter each; repeated names one more for texts that a smaller key has, None for no such filter. A part has all of its steps
    even where no row fails; an empty table has no part. Repeated rows count each by itself (of rows with the same text, those with the least key
    are the first). Null texts, parts and keys: see masks() and with_repeats(). Columns of other names are ignored. What is known of a row
    (key, part, mask, digest) goes to a table in the shared folder, from which both uses are read; only sums by part and mask are gathered.
    """
    names = "".join(filters) + (repeated or "")
    if len(set(names)) != len(filters) + bool(repeated) or not 0 < len(names) <= MOST_FILTERS:
        raise ValueError(f"one to {MOST_FILTERS} filters, each named by a letter of its own")
    rows = masks(docs, filters, part, key, text)
    rows = with_repeats(written(rows, "masks"), len(filters)) if repeated else rows
    return order_steps(survivors(mask_counts(rows, labels), len(names)), names, orders)


def oracle() -> str:
    """The same rows in DuckDB for FILTERS, by counting rows for every step."""
    letters = [*FILTERS, REPEATED]
    held = lambda at: " | ".join(f"(1 << (instr('{''.join(letters)}', substr(filter_order, {k}, 1)) - 1))" for k in at)
    steps = " UNION ALL ".join(f"SELECT filter_order, {k} AS step, {held(range(1, k)) or '0'} AS before, {held([k])} AS own FROM perms" for k in range(1, len(letters) + 1))
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < {MIN_WORDS} THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > {MAX_CAPITAL_PERCENT} * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '{SYMBOLS}') THEN 8 ELSE 0 END
    + CASE WHEN coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) THEN 16 ELSE 0 END AS mask
  FROM d),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest({letters!r}) AS x),
perms AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS ({steps}),
r AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (mask & (before | own) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost
  FROM m, steps GROUP BY part, filter_order, step, own, before)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r"""
