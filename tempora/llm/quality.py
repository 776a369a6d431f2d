"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Fixed base rules reject by length and repetition. Beyond them each signal gets
a cutoff per stratum (language): the lowest value such that rejecting from
there upwards wrongly rejects at most `ALPHA / number of signals` of the good
documents, with confidence 1 - DELTA for all strata and signals together. The
proof is the exact binomial tail on labelled documents: a cutoff may reject at
most the largest k good ones of n for which P(Bin(n, alpha) <= k) is at most
DELTA / (strata * signals) (Bonferroni). A stratum with too few labels for any
such k has no cutoff and rejects nothing.

Labelled values are pre-aggregated to a grid (steps of 1e-4), so what is
ordered per stratum and signal is bounded however many labels there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_RE, staged, table

ALPHA, DELTA = 0.01, 0.05
SIGNALS = ("symbol_share", "dup_line_share", "repeat_share", "word_length")
GRID = 10_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Cutoff rows that may be broadcast; a row is about 60 bytes.
BROADCAST_ROWS = 10_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _repeat_words(words: str = "_words") -> tuple[dict[str, Column], Column]:
    """Columns to add one after the other, and the count of words in a 3-word window that the text holds twice.

    Windows are sorted as longs of hash bits above position bits; neighbours
    with equal hash bits are compared word by word.
    """
    low = F.expr(f"shiftleft(1L, cast(ceil(log2(size({words}) + 2)) as int)) - 1L")
    codes = F.expr(f"transform(slice({words}, 1, greatest(size({words}) - 2, 0)), (w, i) -> (xxhash64(w, {words}[i + 1], {words}[i + 2]) & ~_low) | cast(i as bigint))")
    same = "(((x ^ {o}) & ~_low) = 0L and " + " and ".join(f"{words}[cast(x & _low as int) + {j}] = {words}[cast({{o}} & _low as int) + {j}]" for j in range(3)) + ")"
    pick = f"case when {same.format(o='get(_codes, k - 1)')} or {same.format(o='get(_codes, k + 1)')} then cast(x & _low as int) else -1 end"
    found = F.expr(f"sort_array(array_remove(transform(_codes, (x, k) -> {pick}), -1))")
    count = F.expr("cast(aggregate(transform(_found, (p, k) -> if(k = 0, 3, least(3, p - _found[k - 1]))), 0, (a, b) -> a + b) as bigint)")
    return {"_low": low, "_codes": F.sort_array(codes), "_found": found}, count


def measures(docs: DataFrame, keep: list[Column] | None = None) -> DataFrame:
    """doc_id, the kept columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of every whole text; a null text counts as empty."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(keep or []), F.coalesce("text", F.lit("")).alias("_text"))
    names = [c for c in df.columns if c != "_text"]
    df = df.withColumns({"_words": words_of(F.col("_text")), "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD_RE))})
    steps, repeats = _repeat_words()
    for name, column in steps.items():
        df = df.withColumn(name, column)
    return df.select(
        *names,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def signals() -> dict[str, Column]:
    """Signals on the grid, as whole steps: more is worse."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a) * GRID, F.col(b)).cast("long"), F.lit(0).cast("long"))
    return {
        "symbol_share": F.least(share("n_symbols", "word_chars"), F.lit(GRID)),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": F.least(F.coalesce(F.try_divide(F.col("word_chars") * 100, F.col("n_words")).cast("long"), F.lit(0).cast("long")), F.lit(GRID)),
    }


def allowed_rejections(n: Column, alpha: float, confidence: float) -> Column:
    """The largest k with P(Bin(n, alpha) <= k) <= confidence, exactly; -1 if even k = 0 is too many."""
    first = n * math.log1p(-alpha)
    odds = math.log(alpha) - math.log1p(-alpha)
    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("total"), F.when(first <= math.log(confidence), 0).otherwise(-1).cast("long").alias("k"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(term, acc["total"])
        total = top + F.log(F.exp(term - top) + F.exp(acc["total"] - top))
        return F.struct(term.alias("term"), total.alias("total"), F.when((acc["k"] == i - 1) & (total <= math.log(confidence)), i).otherwise(acc["k"]).alias("k"))

    upto = F.sequence(F.lit(1).cast("long"), F.greatest(F.floor(n * alpha), F.lit(1)).cast("long"))
    return F.aggregate(upto, start, step, lambda acc: acc["k"])


def cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, signal, cutoff): reject from the cutoff upwards.

    `labelled` has stratum, good (boolean) and the signals. Of the risk-controlled
    cutoffs the lowest that some bad document has is taken, so a signal that
    tells nothing rejects nothing.
    """
    long_form = labelled.select("stratum", "good", F.explode(F.create_map(*[x for s in SIGNALS for x in (F.lit(s), F.col(s))])).alias("signal", "value"))
    hist = staged(long_form.groupBy("stratum", "signal", "value").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")), "quality")
    tests = max(1, hist.select("stratum").distinct().count() * len(SIGNALS))
    group = Window.partitionBy("stratum", "signal")
    down = group.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.select("stratum", "signal", "value", "bad", F.sum("good").over(down).alias("above"), F.sum("good").over(group).alias("n"))
    totals = hist.groupBy("stratum", "signal").agg(F.sum("good").alias("n")).select("stratum", "signal", allowed_rejections(F.col("n"), alpha / len(SIGNALS), delta / tests).alias("k"))
    return ranked.join(totals, ["stratum", "signal"]).where("bad > 0 and k >= 0 and above <= k").groupBy("stratum", "signal").agg(F.min("value").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of `docs`.

    A null text has no words (and so fails the base rules); a null language is a
    stratum of its own; null labels are skipped, and a document labelled both
    ways is a bad one; repeated rows are judged alike; without labels only the
    base rules reject. The bounds take labelled documents as independent draws:
    copies among them make the statement weaker than its figures.
    """
    measured = staged(measures(docs, [F.coalesce(F.col("lang"), F.lit("")).alias("stratum")]), "measures")
    judged = measured.select("*", base_failed().alias("base_failed")).withColumns(signals())
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good")).where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    found = staged(cutoffs(judged.where("not base_failed").join(marks, "doc_id"), alpha, delta), "cutoffs")
    wide = found.groupBy("stratum").agg(*[F.max(F.when(F.col("signal") == s, F.col("cutoff"))).alias(f"_{s}") for s in SIGNALS])
    wide = F.broadcast(wide) if found.count() <= BROADCAST_ROWS else wide
    rejected = F.lit(False)
    for s in SIGNALS:
        rejected = rejected | F.coalesce(F.col(s) >= F.col(f"_{s}"), F.lit(False))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.join(wide, "stratum", "left").select(*cols, (~F.col("base_failed") & ~rejected).alias("kept"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP2_SQL = r"""
with d as (
  select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from documents),
w as (select doc_id, i, words[i] as a, words[i + 1] as b, words[i + 2] as c from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from d)),
g as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from w) where n > 1),
r as (select doc_id, count(distinct i + j) as n_repeat_words from g, (values (0), (1), (2)) as t(j) group by doc_id),
m as (
  select d.doc_id, stratum, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(lines) as n_lines
  from d left join r using (doc_id)),
j as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         coalesce(least(n_symbols * 10000 // nullif(word_chars, 0), 10000), 0) as symbol_share, coalesce(n_dup_lines * 10000 // nullif(n_lines, 0), 0) as dup_line_share,
         coalesce(n_repeat_words * 10000 // nullif(n_words, 0), 0) as repeat_share, coalesce(least(word_chars * 100 // nullif(n_words, 0), 10000), 0) as word_length
  from m),
l as (select doc_id, bool_and(quality = 1) as good from labels where doc_id is not null and quality is not null group by 1),
h as (
  select stratum, signal, value, count(*) filter (where good) as good, count(*) filter (where not good) as bad
  from (select stratum, good, unnest([{'s': 'symbol_share', 'v': symbol_share}, {'s': 'dup_line_share', 'v': dup_line_share}, {'s': 'repeat_share', 'v': repeat_share}, {'s': 'word_length', 'v': word_length}]) as x
        from j join l using (doc_id) where not base_failed) as y, lateral (select x.s as signal, x.v as value) group by all),
n as (select stratum, signal, sum(good) as n, ln(0.05 / (4 * (select count(distinct stratum) from h))) as bound from h group by all),
k as (
  select stratum, signal, max(i) as k from (
    select stratum, signal, bound, i, ln(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.0025) + (n - i) * ln(0.9975))) over (partition by stratum, signal order by i)) as p
    from n, lateral (select unnest(range(0, greatest(floor(n * 0.0025)::bigint, 1) + 1)) as i where n > 0) as u where i <= n)
  where p <= bound group by all),
c as (
  select stratum, signal, min(value) as cutoff
  from (select stratum, signal, value, bad, sum(good) over (partition by stratum, signal order by value desc) as above from h) join k using (stratum, signal)
  where bad > 0 and above <= k group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not exists (
         select 1 from c where c.stratum = j.stratum and cutoff <= case signal when 'symbol_share' then symbol_share when 'dup_line_share' then dup_line_share when 'repeat_share' then repeat_share else word_length end) as kept
from j
"""
