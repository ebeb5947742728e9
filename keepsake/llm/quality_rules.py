"""Quality rules whose cutoffs carry a guarantee.

Each rule rejects a document when one of its figures is above a cutoff. The cutoffs come from labelled holdouts: for a
stratum with n good labelled documents, of which a cutoff would reject x, the exact binomial tail
P(Bin(n, alpha) <= x) is the p-value of "this cutoff rejects more than a share alpha of good documents". A rule takes
its strictest cutoff whose p-value is at most delta / (strata * rules). Cutoffs of one rule are nested, so they
are tested from the laxest on and the first failure ends the sequence; across strata and rules Bonferroni's
correction holds. With probability 1 - delta no rule in any stratum rejects more than alpha of the good documents, and
so all rules together no more than rules * alpha. A stratum with too few labels has no cutoff and loses nothing.

The cutoffs on offer are fixed numbers, so that every label counts as a holdout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm._shared import SPACES, written

GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: rule -> (part, whole, cutoffs in thousandths of the whole, laxest first).
RULES: dict[str, tuple[str, str, tuple[int, ...]]] = {
    "symbols": ("n_symbols", "n_words", (3000, 2000, 1500, 1000, 700, 500, 300, 200, 100, 50)),
    "repeats": ("n_repeat_words", "n_words", (450, 400, 350, 300, 250, 200, 150, 100, 70, 50)),
    "lines": ("n_dup_lines", "n_words", (100, 80, 60, 50, 40, 30, 20, 15, 10, 5)),
    "capitals": ("n_capitals", "word_chars", (900, 800, 700, 600, 500, 400, 300, 250, 200, 150)),
}
ALPHA, DELTA = 0.01, 0.05
#: Certified strata up to which their cutoffs are broadcast; beyond, copies of each for a salted join.
BROADCAST_STRATA, SALTS = 1000, 16
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals"]


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def figures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """keep and the figures (long) of every whole text; null and empty texts have zeros.

    A repeated three-word window is found by sorting the text's window hashes with their places (64 bits: of the
    windows of one text two different ones agree with a chance below n^2 / 2^65); neighbours that agree are repeats.
    """
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(*keep, body.alias("body"))
    rows = rows.select(
        *keep,
        F.when(F.btrim("body", F.lit(SPACES)) == "", F.array().cast("array<string>")).otherwise(F.split(F.btrim("body", F.lit(SPACES)), GAP)).alias("words"),
        F.filter(F.split("body", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
        F.length(F.translate("body", SPACES, "")).cast("bigint").alias("word_chars"),
        _without(F.col("body"), SYMBOLS).cast("bigint").alias("n_symbols"),
        _without(F.col("body"), CAPITALS).cast("bigint").alias("n_capitals"),
    )
    rows = rows.select(
        *keep, "word_chars", "n_symbols", "n_capitals",
        F.size("words").cast("bigint").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("words") >= 3, F.expr("transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))")).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    others = [*keep, "word_chars", "n_symbols", "n_capitals", "n_words", "n_dup_lines"]
    rows = rows.select(*others, F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN array_sort(transform(windows, (h, i) -> named_struct('h', h, 'i', i))) ELSE cast(array() AS array<struct<h: bigint, i: int>>) END").alias("sorted"))
    rows = rows.select(*others, F.expr("array_sort(filter(transform(sorted, (s, j) -> if(s.h = get(sorted, j - 1).h OR s.h = get(sorted, j + 1).h, s.i, null)), p -> p IS NOT NULL))").alias("places"))
    return rows.select(*others, F.expr("aggregate(transform(places, (p, j) -> least(3, coalesce(get(places, j + 1), p + 3) - p)), 0L, (a, x) -> a + x)").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _above(rule: str, cutoff: Column) -> Column:
    part, whole, _ = RULES[rule]
    return 1000 * F.col(part) > cutoff * F.col(whole)


def binomial_tail(n: str, x: str, alpha: float) -> Column:
    """P(Bin(n, alpha) <= x), exact up to rounding: the terms follow one another in logarithms, their sum is scaled by the largest."""
    step = f"s.t + ln((({n}) - i + 1) / i) + {math.log(alpha / (1 - alpha))!r}D"
    start = f"named_struct('t', ({n}) * {math.log1p(-alpha)!r}D, 'top', ({n}) * {math.log1p(-alpha)!r}D, 'sum', 1D)"
    merge = f"named_struct('t', {step}, 'top', greatest(s.top, {step}), 'sum', s.sum * exp(s.top - greatest(s.top, {step})) + exp({step} - greatest(s.top, {step})))"
    return F.expr(f"CASE WHEN ({x}) >= ({n}) THEN 1D WHEN ({x}) = 0 THEN exp(({n}) * {math.log1p(-alpha)!r}D) ELSE aggregate(sequence(1L, ({x})), {start}, (s, i) -> {merge}, s -> least(1D, exp(s.top) * s.sum)) END")


def cutoffs(labelled: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """labelled has figures and a stratum for every good labelled document that passes the base rules. Returns one row
    per certified stratum: stratum, then each rule's strictest certified cutoff or null.
    """
    sums = [F.sum(F.when(_above(rule, F.lit(c)), 1).otherwise(0)).alias(f"{rule}_{c}") for rule, (_, _, grid) in RULES.items() for c in grid]
    strata = written(labelled.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *sums), "strata")
    tests = ", ".join(f"named_struct('rule', '{rule}', 'cutoff', {c}, 'x', {rule}_{c})" for rule, (_, _, grid) in RULES.items() for c in grid)
    rows = strata.withColumn("strata", F.lit(max(1, strata.count()))).select("stratum", "n", "strata", F.expr(f"inline(array({tests}))"))
    rows = rows.where(F.col("x") <= F.col("n") * alpha).withColumn("p", binomial_tail("n", "x", alpha)).where(F.col("p") <= F.lit(delta) / (F.col("strata") * len(RULES)))
    return rows.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in RULES))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per row of docs: doc_id, the figures, base_failed, kept.

    Texts of any length are judged whole; a row's arrays of words and windows grow with its text. Columns other than doc_id, text and the stratum are ignored.
    labels: doc_id, quality (1: good); a doc_id labelled twice counts once, as good if all its labels say so; null
    labels don't count. Null strata form one stratum. A null doc_id has no label. Repeated rows are judged each by
    itself. No labels or an empty table: the base rules alone decide. The texts are read once: their figures, a few
    numbers a row, go to a table in the shared folder that the fit and the verdict both read.
    """
    held = written(figures(docs, keep=("doc_id", stratum)).withColumn("base_failed", base_failed()), "figures")
    good = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    cuts = written(cutoffs(held.where(~F.col("base_failed")).join(good, "doc_id", "left_semi"), stratum, alpha, delta), "cutoffs")
    if cuts.count() <= BROADCAST_STRATA:
        rows = held.join(F.broadcast(cuts), held[stratum].eqNullSafe(cuts["stratum"]), "left")
    else:  # rows of a frequent stratum go to several tasks
        salted = cuts.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = held.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
        rows = dealt.join(salted, dealt[stratum].eqNullSafe(salted["stratum"]) & (dealt["_salt"] == salted["_copy"]), "left")
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(_above(rule, F.col(f"cut_{rule}")), F.lit(False))
    return rows.select("doc_id", *FIGURES, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), *(F.col(f"cut_{rule}").cast("int").alias(f"cut_{rule}") for rule in RULES))


def oracle(alpha: float = ALPHA, delta: float = DELTA) -> str:
    sums = ", ".join(f"count(*) FILTER (WHERE 1000 * {part} > {c} * {whole}) AS {rule}_{c}" for rule, (part, whole, grid) in RULES.items() for c in grid)
    tests = " UNION ALL ".join(f"SELECT stratum, n, strata, '{rule}' AS rule, {c} AS cutoff, {rule}_{c} AS x FROM counted" for rule, (_, _, grid) in RULES.items() for c in grid)
    cuts = ", ".join(f"min(cutoff) FILTER (WHERE rule = '{rule}') AS cut_{rule}" for rule in RULES)
    above = " OR ".join(f"coalesce(1000 * {part} > cut_{rule} * {whole}, false)" for rule, (part, whole, _) in RULES.items())
    spaces = " || ".join(f"chr({ord(c)})" for c in SPACES)
    return f"""
WITH words AS (
  SELECT doc_id, lang, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM words, unnest(range(1, greatest(len(words) - 1, 1))) AS r(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS o(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM words) WHERE trim(line, {spaces}) <> '' GROUP BY doc_id),
figures AS (
  SELECT doc_id, lang, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(body, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id)),
based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM figures),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
strata AS (SELECT lang AS stratum, count(*) AS n, {sums} FROM based WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY lang),
counted AS (SELECT *, count(*) OVER () AS strata FROM strata),
tests AS ({tests}),
tails AS (
  SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln({1 - alpha}))) FROM range(x + 1) AS r(i)) AS p
  FROM tests WHERE x <= n * {alpha}),
cuts AS (SELECT stratum, {cuts} FROM tails WHERE p <= {delta} / (strata * {len(RULES)}) GROUP BY stratum)
SELECT doc_id, {", ".join(FIGURES)}, base_failed, NOT base_failed AND NOT ({above}) AS kept, {", ".join(f"cut_{rule}::INT AS cut_{rule}" for rule in RULES)}
FROM based LEFT JOIN cuts ON lang IS NOT DISTINCT FROM stratum"""
