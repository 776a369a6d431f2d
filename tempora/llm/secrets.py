"""Secret scans: fixed patterns, and guess cost of what stands where a credential stands.

The patterns find assignments, access keys and long hex strings. Beyond them, a
value in credential context (a credential word, a separator, a value) counts as
a secret when guessing it is dear: the cheapest segmentation of the value into
common words, dates, repeats, keyboard walks and brute-force spans, found by
dynamic programming, must cost at least `MIN_BITS`. Common are a few password
words and what the corpus itself counts as such.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import doc_texts, mapped_rows, table

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Words after which a value is a credential, wider than the assignment pattern's. A scheme word after "authorization" is not the value yet.
CONTEXT = re.compile(
    r"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|credentials?|(?P<auth>auth(?:orization)?)|bearer)["']?\x20{0,8}(?::=|=>|[:=])\x20{0,8}["'`]?(?(auth)(?:(?i:bearer|basic)\x20{1,8})?)(?P<value>[^\s"'`,;<>]{6,})""",
    re.ASCII,
)
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "api", "access", "private", "credential", "auth", "bearer")
MIN_BITS = 34.0
#: Common password words, most common first.
COMMON = tuple(
    "password love admin welcome login master dragon monkey sunshine princess shadow baseball football letmein superman secret trust hello freedom whatever computer internet summer winter spring autumn monday friday london paris test guest user root system server default changeme access flower ginger cookie pepper silver golden orange purple"
    " michael jordan hunter ranger charlie thomas daniel jessica ashley token example sample".split()
)
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("430157$@!", "aeoistsai")
MAX_SPAN = 32
#: Size of the word table counted from the corpus, and the documents that must hold a word of it.
WORDS, MIN_DOCUMENTS = 20_000, 20
_WALKS = {row[i : i + n] for r in ROWS for row in (r, r[::-1]) for n in range(3, len(r) + 1) for i in range(len(row) - n + 1)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:0?[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)")


def _char_bits(c: str) -> float:
    return math.log2(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 1000)


class Guesser:
    """Guess costs under a word table: words from the most common one, whose ranks (after `COMMON`) set their cost."""

    def __init__(self, words: tuple[str, ...] | list[str] = ()):
        self.word_bits: dict[str, float] = {}
        for w in (*COMMON, *words):
            self.word_bits.setdefault(w, math.log2(len(self.word_bits) + 2))
        self.span_bits, self.block_bits = lru_cache(maxsize=10_000)(self._span_bits), lru_cache(maxsize=10_000)(self._block_bits)

    def _span_bits(self, s: str) -> float | None:
        """Bits to guess s as one word, date or keyboard walk; None if it is none of them."""
        low = s.lower()
        case = 0.0 if low == s else 1.0 if s[1:] == low[1:] or s.isupper() else float(sum(c.isupper() for c in s) + 1)
        found = []
        if low in self.word_bits:
            found.append(self.word_bits[low] + case)
        elif (plain := low.translate(LEET)) in self.word_bits:
            found.append(self.word_bits[plain] + case + 2)
        if low in _WALKS:
            found.append(math.log2(47) + math.log2(len(s)) + case)
        if 4 <= len(s) <= 10 and _DATE.fullmatch(s):
            found.append(math.log2(365 * 120) if len(s) > 4 else math.log2(120))
        return min(found, default=None)

    def _block_bits(self, s: str) -> float:
        one = sum(map(_char_bits, s))
        known = self.span_bits(s) if len(s) > 2 else None
        return one if known is None else min(one, known)

    def bits(self, value: str, enough: float = math.inf) -> float:
        """Least bits over all segmentations; a segment beyond the first costs one bit more (where to cut).

        Words, and blocks that repeat, are up to `MAX_SPAN` characters long.
        Ends early once the bits are certain to reach `enough`.
        """
        n = len(value)
        best = [0.0] + [math.inf] * n
        run = [0] * (MAX_SPAN + 1)  # by size: how many characters up to here equal the one `size` before them
        for j in range(1, n + 1):
            # Words are no longer than MAX_SPAN and repeats can end after any block, so some MAX_SPAN neighbours hold a cut that costs no more than the whole.
            if j % MAX_SPAN == 0 and min(best[j - MAX_SPAN : j]) >= enough:
                return min(best[j - MAX_SPAN : j])
            best[j] = best[j - 1] + _char_bits(value[j - 1])  # brute force
            for i in range(max(0, j - MAX_SPAN), j - 2):
                cost = self.span_bits(value[i:j])
                if cost is not None:
                    best[j] = min(best[j], best[i] + cost + (1 if i else 0))
            for size in range(1, min(MAX_SPAN, j - 1) + 1):  # value[j - size : j] repeated back to back
                run[size] = run[size] + 1 if value[j - 1] == value[j - 1 - size] else 0
                times = run[size] // size + 1
                if times > 1 and times * size > 2:
                    block = value[j - size : j]
                    start = j - times * size
                    best[j] = min(best[j], best[start] + self.block_bits(block) + math.log2(times) + (1 if start else 0))
        return best[n]


_PLAIN = Guesser()
guess_bits = _PLAIN.bits


def common_words(docs: DataFrame, most: int = WORDS) -> list[str]:
    """The words that the most documents hold, most common first, over all documents: the dictionary of a guesser.

    Stretches of 3 to 20 ASCII letters without regard to case, in at least
    `MIN_DOCUMENTS` documents (equal in count: by letter); at most `most`, which
    bounds what reaches the driver and goes out with the tasks.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z0-9])[a-z]{3,20}(?![a-z0-9])"), F.lit(0)))
    counted = doc_texts(docs).select(F.explode(words).alias("w")).groupBy("w").count().where(F.col("count") >= MIN_DOCUMENTS)
    return [r["w"] for r in counted.orderBy(F.desc("count"), "w").limit(most).collect()]


def find(text: str, min_bits: float = MIN_BITS, guesser: Guesser = _PLAIN) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, where the secret itself starts), by start, then kind; offsets in code points."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    if any(w in low for w in CONTEXT_WORDS) and (":" in text or "=" in text):
        base = list(out)
        for m in CONTEXT.finditer(text):
            start, end = m.span("value")
            if not any(s <= start and end <= b for _, _, b, s in base) and guesser.bits(m["value"], min_bits) >= min_bits:
                out.append(("guess", start, end, start))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def redact(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with each secret (of an assignment, its value) replaced by `mark`."""
    out, at = [], 0
    for a, b in sorted((s, e) for _, _, e, s in spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


SPANS = ArrayType(StructType([StructField("kind", StringType())] + [StructField(c, IntegerType()) for c in ("start", "end", "value_start")]))
_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32())]))


def _spans(found: list) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end", "value_start"), s, strict=True)) for s in f] for f in found], _KIND)


def scan(docs: DataFrame, min_bits: float = MIN_BITS, words: list[str] | None = None) -> DataFrame:
    """(doc_id, spans) of every whole text in one pass; `words` is the guesser's table, counted from `docs` where None.

    A null or empty text has no spans; ids may be null, rows may repeat.
    """
    words = common_words(docs) if words is None else words

    def run(batches):
        guesser = Guesser(words)
        for batch in batches:
            found = [find(t, min_bits, guesser) if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _spans(found)], names=["doc_id", "spans"])

    return doc_texts(docs).mapInArrow(run, StructType([StructField("doc_id", LongType()), StructField("spans", SPANS)]))


def redacted_rows(docs: DataFrame, min_bits: float = MIN_BITS, words: list[str] | None = None) -> DataFrame:
    """(row, result): each row of `docs` as a struct, its text redacted (a null one stays null), and its spans."""
    words = common_words(docs) if words is None else words

    def run():
        guesser = Guesser(words)

        def step(texts):
            found = [find(t, min_bits, guesser) if t else [] for t in texts]
            return [redact(t, f) if f else t for t, f in zip(texts, found, strict=True)], _spans(found)

        return step

    return mapped_rows(docs, run, StructField("result", SPANS), rewrite=True)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, the digest of the base spans, and all spans as kind:start:end joined by commas."""
    found = scan(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
