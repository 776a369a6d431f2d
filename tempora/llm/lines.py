"""Deduplication of repeated line runs, in DataFrame functions only.

A document is the sequence of its lines that hold a word, each named by 128 bits
of hash, which the first round turns into ranks.
A suffix array over these sequences is built by distributed prefix doubling:
suffixes are ranked by their first h lines, pairs (rank at i, rank at i + h) are
sorted by range partitioning, and the order-preserving row number of a pair is
the rank at 2h. Suffixes whose rank nobody shares drop out after each round, so
the rounds work on repeated lines alone. At depth `min_lines` the suffixes of
one rank are one longest-common-prefix interval of at least that height; all
but its first suffix (by document, then line) start a later copy. Later copies
that overlap or touch make up the maximal repeated runs, which are deleted.
Sorting any deeper would not change which lines are covered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_RE, salted_join, staged, table

MIN_LINES = 2


def all_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def lines_of(text: Column) -> Column:
    return F.filter(all_lines(text), lambda x: x.rlike(WORD_RE))


def _key(docs: DataFrame) -> Column:
    """Names a row by 128 bits of its id and text; rows that agree in both are one document."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))))


def _ranked(suffixes: DataFrame, pair: list[str]) -> DataFrame:
    """Suffixes whose `pair` occurs more than once, with its place in the order of all such pairs as rank.

    Counts combine before the shuffle; a common pair is split over tasks when its rank goes back to the suffixes.
    """
    often = suffixes.groupBy(*pair).count().where("count > 1").select(*pair)
    ordered = often.repartitionByRange(*pair).sortWithinPartitions(*pair).select(*pair, F.monotonically_increasing_id().alias("_rank"))
    joined = salted_join(suffixes, staged(ordered, "ranks"), pair, "key", salts=8)
    return joined.select("doc_id", "key", "pos", F.col("_rank").alias("rank"))


def suffix_ranks(suffixes: DataFrame, depth: int) -> DataFrame:
    """(doc_id, key, pos, rank): suffixes that share their first `depth` lines with another one, ranked in suffix order.

    `suffixes` has doc_id, key, pos, high and low, the line's name. A suffix
    shorter than `depth` shares nothing.
    """
    h = 1
    current = _ranked(suffixes, ["high", "low"])
    while h < depth:
        step = min(h, depth - h)
        ahead = Window.partitionBy("key").orderBy("pos").rangeBetween(step, step)
        current = staged(current.withColumn("next", F.max("rank").over(ahead)).where("next is not null"), "suffixes")
        current = _ranked(current, ["rank", "next"])
        h += step
    return current


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(key, starts): for each document with any, the sorted line numbers at which a run of `min_lines` starts that an earlier place has too."""
    exploded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(docs).alias("key"), F.posexplode(F.transform(lines_of(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("high"), F.xxhash64(F.lit(1), x).alias("low")))).alias("pos", "line"))
    ranked = staged(suffix_ranks(exploded.select("doc_id", "key", "pos", "line.*"), min_lines), "ranked")
    place = F.struct("doc_id", "key", "pos")
    first = ranked.groupBy("rank").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    later = salted_join(ranked, first.select("rank", "first"), "rank", "key", salts=8).where(place > F.col("first"))
    return later.groupBy("key").agg(F.sort_array(F.collect_set("pos")).alias("starts"))  # no more than a document's own lines


def _gone(min_lines: int) -> Column:
    """Numbers, among all lines, of the lines inside the runs that `starts` begin; `at` numbers the lines with a word."""
    m = min_lines
    opens = f"filter(starts, (x, k) -> k = 0 or x > starts[k - 1] + {m})"
    closes = f"transform(filter(starts, (x, k) -> k = size(starts) - 1 or starts[k + 1] > x + {m}), x -> x + {m})"
    return F.expr(f"flatten(transform(arrays_zip({opens}, {closes}), r -> slice(at, r['0'] + 1, r['1'] - r['0'])))")


def deduplicated_rows(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(row, n_lines, n_removed, n_runs): each row of `docs` as a struct, its text without later copies of repeated line runs.

    Lines without a word are no part of a run and stay. A text that loses
    nothing stays as it is (null stays null). The first place of a run, by
    doc_id (null first), then text, then line, keeps it. Rows with equal id and
    text are one document. No documents, or none that repeat, give no
    deletions. Columns may have any names.
    """
    names = docs.columns
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), _key(docs).alias("key"))
    work = work.join(later_copies(docs, min_lines), "key", "left").withColumn("lines", all_lines(F.col("row.text")))
    work = work.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.col("lines")[i].rlike(WORD_RE)))
    work = work.withColumn("gone", F.when(F.col("starts").isNotNull(), _gone(min_lines)))
    between = F.expr("flatten(transform(arrays_zip(concat(array(-1), gone), concat(gone, array(size(lines)))), r -> slice(lines, r['0'] + 2, r['1'] - r['0'] - 1)))")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(between, "\n"))
    runs = F.coalesce(F.expr(f"size(filter(starts, (x, k) -> k = 0 or x > starts[k - 1] + {min_lines}))"), F.lit(0))
    counts = [F.size("at"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")), F.when(F.col("starts").isNull(), 0).otherwise(runs)]
    row = F.struct(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in names])
    return work.select(row.alias("row"), *[c.cast("long").alias(n) for c, n in zip(counts, ("n_lines", "n_removed", "n_runs"), strict=True)])


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """As `deduplicated_rows`, with the row's columns beside the counts; of columns of one name, the input's goes."""
    counts = ("n_lines", "n_removed", "n_runs")
    return deduplicated_rows(docs, min_lines).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in counts], *counts)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines with a word, lines and runs removed, and the SHA-256 of the text that stays."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP3_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as lines from documents),
a as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as ln from d),
l as (select doc_id, line, ln, row_number() over (partition by doc_id order by ln) as pos from a where regexp_matches(line, '[^\x20\x09-\x0D]')),
w as (select doc_id, pos, line, lead(line) over (partition by doc_id order by pos) as line2 from l),
f as (select doc_id, pos from (select doc_id, pos, row_number() over (partition by line, line2 order by doc_id, pos) as n from w where line2 is not null) where n > 1),
c as (select distinct doc_id, pos + j as pos from f, (values (0), (1)) as t(j)),
runs as (select doc_id, count(*) as n_runs from (select doc_id, pos, lag(pos) over (partition by doc_id order by pos) as before from c) where before is null or pos > before + 1 group by doc_id),
g as (select c.doc_id, l.ln from c join l on l.doc_id = c.doc_id and l.pos = c.pos),
k as (select a.doc_id, string_agg(line, chr(10) order by a.ln) filter (where g.ln is null) as text, count(g.ln) as n_removed from a left join g on a.doc_id = g.doc_id and a.ln = g.ln group by a.doc_id),
n as (select doc_id, count(*) as n_lines from l group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_runs, 0)::bigint as n_runs,
       sha256(case when coalesce(n_removed, 0) = 0 then d.text else coalesce(k.text, '') end) as text_sha256
from d left join k using (doc_id) left join runs using (doc_id) left join n using (doc_id)
"""
