"""Text: formats, edits, chunks, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title(c: Column) -> Column:
    return F.initcap(c)


def formalise(c: Column) -> Column:
    """snake_case to Words, later letters as they are."""
    words = F.split(F.replace(c, F.lit("_"), F.lit(" ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def equals_ignore_case(a: Column, b: Column, trim: bool = False) -> Column:
    a, b = (F.trim(x) if trim else x for x in (a, b))
    return F.lower(a) == F.lower(b)


def list_text(a: Column) -> Column:
    """"a", "a and b", "a, b, and c"."""
    n = F.size(a)
    many = F.concat(F.array_join(F.slice(a, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.get(a, n - 1))
    return F.when(n == 0, "").when(n == 1, F.get(a, F.lit(0))).when(n == 2, F.array_join(a, " and ")).otherwise(many)


def yes_no(c: Column) -> Column:
    return F.when(c, "Yes").otherwise("No")


def duration(seconds: Column) -> Column:
    """"1d 2h 3m 4s", leading zero parts left out."""
    s = seconds.cast("bigint")
    parts = [(F.floor(s / 86400), "d"), (F.floor(s % 86400 / 3600), "h"), (F.floor(s % 3600 / 60), "m")]
    texts = [F.when(s >= size, F.concat(v.cast("string"), F.lit(u))) for (v, u), size in zip(parts, (86400, 3600, 60), strict=True)]
    return F.concat_ws(" ", *texts, F.concat((s % 60).cast("string"), F.lit("s")))


def map_text(m: Column) -> Column:
    """"k: v, k: v", or None when empty."""
    return F.when(F.size(m) > 0, F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(": ", e["key"], e["value"].cast("string"))), ", ")).otherwise("None")


def nesting(c: Column) -> Column:
    """Depth of a "-" bullet: half its leading spaces, rounded up; 0 for others."""
    return F.when(c.rlike("^ *-"), F.ceil(F.length(F.regexp_extract(c, "^( *)-", 1)) / 2)).otherwise(0).cast("bigint")


def column_name(n: Column) -> Column:
    """1 to A, 27 to AA (up to three letters)."""
    letter = lambda v: F.chr(v + 65)
    one, two = n - 1, n - 27
    three = n - 703
    return (
        F.when(n <= 26, letter(one))
        .when(n <= 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def cell_name(x: Column, y: Column) -> Column:
    return F.concat(column_name(x), y.cast("string"))


def rolling_hash(c: Column) -> Column:
    """32-bit h * 31 + code of each character, as the absolute value in hex."""
    folded = F.aggregate(F.filter(F.split(c, ""), lambda s: s != ""), F.lit(0).cast("bigint"), lambda h, s: F.pmod(h * 31 + F.ascii(s), F.lit(1 << 32)))
    signed = F.when(folded >= 1 << 31, folded - (1 << 32)).otherwise(folded)
    return F.lower(F.hex(F.abs(signed)))


def is_image(c: Column) -> Column:
    return F.lower(c).rlike(r"^https?://\S+\.(png|jpe?g|gif|webp|svg|bmp)(\?\S*)?$")


def is_url(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+\S*$")


def european_number(c: Column) -> Column:
    """"1.234,5" to 1234.5."""
    bare = F.replace(F.regexp_replace(c, r"[^0-9.,-]", ""), F.lit("."), F.lit(""))
    point = F.regexp_replace(bare, r",([^,]*)$", ".$1")
    return F.regexp_extract(point, r"^-?\d*\.?\d+", 0).try_cast("double")


def ellipsis(c: Column, n: int = 120, mark: str = " ...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def chunks(c: Column, n: int) -> Column:
    return F.regexp_extract_all(c, F.lit(f"(?s)(.{{1,{n}}})"), F.lit(1))


def split_at(c: Column, i: int) -> Column:
    return F.array(F.substring(c, 1, i), F.substr(c, F.lit(i + 1)))


def strip_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"__|\*\*", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy.MM.dd")


def add_line(c: Column, text: str, prepend: bool = False, whole_line: bool = False, separator: str = "\n") -> Column:
    """Text added after (or before), unless it is there already as a part or as a whole line."""
    there = F.array_contains(F.split(c, separator), text) if whole_line else c.contains(text)
    joined = F.concat(F.lit(text + separator), c) if prepend else F.concat(c, F.lit(separator + text))
    return F.when(there, c).when(c == "", F.lit(text)).otherwise(joined)


def replace_text(c: Column, find: str, by: str, which: str = "all", whole_line: bool = False) -> Column:
    """first, last or all occurrences; whole lines only with `whole_line`."""
    if whole_line:
        return F.array_join(F.transform(F.split(c, "\n"), lambda s: F.when(s == find, F.lit(by)).otherwise(s)), "\n")
    if which == "all":
        return F.replace(c, F.lit(find), F.lit(by))
    head = F.substring_index(c, find, 1 if which == "first" else -1)
    n = len(find)
    if which == "first":
        return F.when(c.contains(find), F.concat(head, F.lit(by), F.substr(c, F.length(head) + n + 1))).otherwise(c)
    return F.when(c.contains(find), F.concat(F.substr(c, F.lit(1), F.length(c) - F.length(head) - n), F.lit(by), head)).otherwise(c)


def strip_html(c: Column) -> Column:
    """Text without script, style and tags; lines trimmed, blank ones dropped; the common entities decoded."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "\n"), r"(?s)<[^>]*>", "\n")
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(code), F.lit(sign))
    return F.array_join(F.filter(F.transform(F.split(bare, "\n"), lambda s: F.trim(s)), lambda s: s != ""), "\n")


def escape_html(c: Column) -> Column:
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(code))
    return c


def links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1)))


def pack_lines(c: Column, limit: int = 1024) -> Column:
    """Lines packed greedily into chunks of at most `limit` characters; a longer line is a chunk of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(s: Column, line: Column) -> Column:
        fits = F.length(s["open"]) + 1 + F.length(line) <= limit
        done = F.when(s["open"].isNull() | fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        return F.struct(done.alias("done"), F.when(s["open"].isNull(), line).when(fits, F.concat(s["open"], F.lit("\n"), line)).otherwise(line).alias("open"))

    return F.aggregate(F.split(c, "\n"), start, step, lambda s: F.concat(s["done"], F.array(s["open"])))


def localise(key: Column, texts: dict[str, str], *args: Column) -> Column:
    """A text by key, its {0}, {1} … filled in; the key itself where there is none."""
    out = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]), key), key)
    for i, a in enumerate(args):
        out = F.replace(out, F.lit(f"{{{i}}}"), a.cast("string"))
    return out


def printed_tokens(text: Column) -> Column:
    """Tokens of printed output such as `[1] 1.5 "a b" TRUE`: index marks go, quotes go, order stays; each with its kind."""
    tokens = F.regexp_extract_all(F.regexp_replace(text, r"(?m)^\s*\[\d+\]", ""), F.lit(r'"(?:[^"]*)"|\S+'), F.lit(0))
    bare = lambda v: F.regexp_replace(v, '^"|"$', "")
    kind = lambda v: F.when(v.startswith('"'), "string").when(v.isin("TRUE", "FALSE"), "boolean").when(v.isin("NA", "NULL"), "null").when(v.try_cast("double").isNotNull(), "number").otherwise("string")
    return F.transform(tokens, lambda v: F.struct(kind(v).alias("kind"), bare(v).alias("text")))
