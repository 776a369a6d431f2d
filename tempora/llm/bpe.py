"""BPE encoding and decoding by tree concatenation.

A unit is a stretch between ASCII white space, over which the pre-tokenizer
never reaches, so units are encoded by themselves. A unit longer than
`leaf_chars` is unsplit text: it is cut in halves, again and again, wherever the
middle falls. The leaves are encoded independently (all leaves of a unit in one
call); then each join is mended from the bottom up: the text around it is
encoded anew in a window that doubles until, on either side of the join, two
neighbouring tokens of the window are tokens of that side too, at the same
places. What stands before the first of them on the left and after the second
on the right is kept. A token sequence is the encoding of its text when every
pair of neighbours is the encoding of its own text, and each pair of the result
comes from one correct encoding, so the result is the encoding of the whole.

Units repeat heavily in any corpus, so leaves are encoded through a bounded
cache of units; unknown units of a batch go to the tokenizer in one call.

Where only ids are wanted (`encode_bytes`), many texts are cut at once on their
bytes, and for the tokenizer files whose rules are `SPLITS` and `NORMALIZES`
further than at white space: wherever two ASCII signs stand on a border that
the pre-tokenizer always makes. The distinct pieces alone come to Python.
"""

from __future__ import annotations

import hashlib
import json
import os
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import doc_texts, table, uncollected

LEAF_CHARS = 1 << 12
FIRST_WINDOW = 32
CACHE_UNITS = 300_000
#: Texts are tokenized in groups of about this many characters, to bound a worker's memory.
GROUP_CHARS = 1 << 20
#: The same for `encode_bytes`, in bytes.
GROUP_BYTES = 1 << 21
#: The units kept in the cache are at most this long; longer ones hardly repeat.
CACHED_UNIT_CHARS = 48
#: Latin words that go to the tokenizer as one text.
RUN_WORDS = 256

#: Rules under which `_PAIRS` are borders: letters, single digits and runs of other signs are split, but for contractions.
SPLITS = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
NORMALIZES = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}

_SOLID = np.ones(256, bool)
_SOLID[[0x20, 0x09, 0x0A, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Kinds of bytes: letter, digit, apostrophe, other visible ASCII sign; 0 for the rest, beside which nothing is cut.
_KINDS = np.array([1 if chr(i).isalpha() else 2 if chr(i).isdigit() else 3 if i == 0x27 else 4 if 0x20 < i < 0x7F else 0 for i in range(128)] + [0] * 128, np.uint8)
#: Whether a border stands between two kinds, at 5 * first + second. A letter after an apostrophe may be a contraction.
_PAIRS = np.array([a * b > 0 and (a == 2 or b == 2 or (a == 1) != (b == 1) and (a, b) != (3, 1)) for a in range(5) for b in range(5)])


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Codec:
    """Exact encoder for one tokenizer file. `form` turns the ids of a unit into what is kept and returned for it."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, first_window: int = FIRST_WINDOW, cache_units: int = CACHE_UNITS, form: Callable = tuple):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf_chars, self.first_window, self.cache_units, self.form = max(2, leaf_chars), max(1, first_window), cache_units, form
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        spec = json.loads(self.tok.to_str().partition(',"model":')[0] + "}")  # all but the vocabulary and its merges
        #: No window starts inside an added token that crosses the join.
        self.longest_added = max((len(t["content"]) for t in spec["added_tokens"]), default=0) + 4
        self.window_chars = 0  # characters that trees have encoded, leaves and windows
        self.suffix = getattr(self.tok.model, "end_of_word_suffix", None) or ""
        #: Ids that end a word, where the file marks word ends and splits letters from other signs; else None.
        self.ends = {i for t, i in self.tok.get_vocab().items() if t.endswith(self.suffix)} if self.suffix and "\\p{L}" in json.dumps(spec["pre_tokenizer"]) and "ByteLevel" in json.dumps(spec["pre_tokenizer"]) else None
        self.lowers = "Lowercase" in json.dumps(spec["normalizer"])
        self.plain = None
        if self.ends is not None:  # the same model, for units that normalizing leaves as they are
            from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

            self.plain = Tokenizer(self.tok.model)
            self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        marked = all("<|" in t["content"] for t in spec["added_tokens"])  # texts without that hold no added token
        self.cuts = self.ends is not None and marked and spec["pre_tokenizer"] == SPLITS and spec["normalizer"] == NORMALIZES
        self.is_end = np.isin(np.arange(self.tok.get_vocab_size()), list(self.ends or ()))

    def units(self, text: str) -> list[str]:
        """Stretches between ASCII space, tab, line feed and carriage return; A-Z lowered where the file lowers all letters."""
        if self.lowers and "<|" not in text:  # added tokens are looked for before lowering
            text = text.encode().lower().decode()
        for c in "\n\t\r":
            if c in text:
                text = text.replace(c, " ")
        return [u for u in text.split(" ") if u] if "  " in text or text[:1] == " " or text[-1:] == " " or not text else text.split(" ")

    def _encode(self, texts: list[str], tok=None) -> list[list[int]]:
        return [e.ids for e in (tok or self.tok).encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of units that are Latin small letters only, many to a call: each ends with an end-of-word id."""
        runs = [words[i : i + 64] for i in range(0, len(words), 64)]
        out = {}
        for run, ids in zip(runs, self._encode([" ".join(r) for r in runs], self.plain), strict=True):
            cut = [i + 1 for i, x in enumerate(ids) if x in self.ends]
            if len(cut) == len(run):
                out.update((w, ids[a:b]) for w, a, b in zip(run, [0, *cut], cut, strict=False))
            else:
                out.update(zip(run, self._encode(run), strict=True))
        return out

    def _learn(self, new: set[str]) -> dict[str, object]:
        """Values of units that the young cache lacks, the old one's among them. A unit of letters and closing signs is put together from both."""
        found, parts, whole = {}, {}, []
        for u in new:
            if (v := self.old.get(u)) is not None:
                found[u] = v
            elif len(u) > self.leaf_chars:
                found[u] = self.form(self.tree_ids(u))
            elif self.ends is None:
                whole.append(u)
            else:
                stem = u.rstrip(".,;:!?")
                if stem.isalpha() and (stem.islower() if stem.isascii() else max(stem) < "\u0250" and stem == stem.lower()):
                    parts[u] = stem
                else:
                    whole.append(u)
        tails = {u: u[len(s) :] for u, s in parts.items()}
        words = self._word_ids(list(set(parts.values())))
        signs = list({t for t in tails.values() if t})
        sign_ids = dict(zip(signs, self._encode(signs), strict=True))
        found.update((u, self.form([*words[s], *sign_ids.get(tails[u], ())])) for u, s in parts.items())
        found.update((u, self.form(ids)) for u, ids in zip(whole, self._encode(whole), strict=True))
        return found

    def _values(self, lists: list[list[str]]) -> list[list]:
        if len(self.young) > self.cache_units:
            self.old, self.young = self.young, {}
        new = set(chain.from_iterable(lists)).difference(self.young)
        if new:
            self.young.update(self._learn(new))
        got = [list(map(self.young.__getitem__, units)) for units in lists]
        for u in [u for u in new if len(u) > CACHED_UNIT_CHARS]:
            del self.young[u]
        return got

    def leaves(self, text: str) -> list[tuple[int, int]]:
        """Ends of the leaves of the halving tree, left to right."""
        out, todo = [], [(0, len(text))]
        while todo:
            a, b = todo.pop()
            if b - a <= self.leaf_chars:
                out.append((a, b))
            else:
                m = (a + b) // 2
                todo += [(m, b), (a, m)]
        return out

    def encode_units(self, texts: list[str]) -> list[list]:
        """For each text, the values of its units in order (joined, their ids are the encoding)."""
        return self._values([self.units(t) for t in texts])

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Pieces whose ids joined are those of the texts data[bounds[i]:bounds[i + 1]], and the number of the first one of each text (and of all)."""
        solid, first = _SOLID[data], np.zeros(len(data) + 1, bool)
        first[bounds] = True
        begins, text = first[:-1].copy(), data
        begins[1:] |= ~solid[:-1]
        if self.lowers:
            text = _LOWER[data]
        if self.cuts:
            kinds = _KINDS[data]
            begins[1:] |= _PAIRS[kinds[:-1] * np.uint8(5) + kinds[1:]]
        marks = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))  # "<|": added tokens are looked for before lowering
        for i in np.unique(np.searchsorted(bounds, marks, "right") - 1):
            a, b = bounds[i], bounds[i + 1]
            begins[a + 1 : b] = ~solid[a : b - 1]
            text[a:b] = data[a:b]
        begins &= solid
        body = text[solid]
        offsets = np.append(np.flatnonzero(begins[solid]), len(body)).astype(np.int32)
        before = np.searchsorted(np.flatnonzero(begins), bounds)
        return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(body)]), before

    def _learn_bytes(self, new: list[str]) -> list[bytes]:
        """Ids of pieces as little-endian uint32; runs of Latin words are cut up at the ids that end a word."""
        found, latin = {}, []
        if self.ends is not None:
            latin = [u for u in new if u.isalpha() and (u.islower() if u.isascii() else max(u) < "\u0250" and u == u.lower()) and len(u) <= self.leaf_chars]
        runs = [latin[i : i + RUN_WORDS] for i in range(0, len(latin), RUN_WORDS)]
        for run, ids in zip(runs, self._encode([" ".join(r) for r in runs], self.plain), strict=True):
            ids = np.array(ids, "<u4")
            cut = (4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()
            if len(cut) == len(run):
                coded = ids.tobytes()
                found.update(zip(run, [coded[a:b] for a, b in zip([0, *cut], cut, strict=False)], strict=True))
        rest = [u for u in new if u not in found]
        found.update((u, self.tree_ids(u)) for u in rest if len(u) > self.leaf_chars)
        rest = [u for u in rest if len(u) <= self.leaf_chars]
        found.update(zip(rest, self._encode(rest), strict=True))
        return [v if isinstance(v := found[u], bytes) else np.array(v, "<u4").tobytes() for u in new]

    def encode_bytes(self, texts: pa.Array) -> Iterator[bytes]:
        """For each text (none is null) its ids as little-endian uint32. Uses the caches by itself, not together with `encode_units`."""
        raw = texts.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
        data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(raw):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, "right")) - 1)
            pieces, before = self._pieces(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            coded = pieces.dictionary_encode()
            taken = pa.array(self._bytes_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
            ends = np.frombuffer(taken.buffers()[1], np.int64)[before].tolist() if len(taken) else [0] * len(before)
            ids = taken.buffers()[2].to_pybytes() if len(taken) and taken.buffers()[2] is not None else b""
            for a, b in zip(ends, ends[1:], strict=False):
                yield ids[a:b]
            at = to

    def _bytes_of(self, pieces: list[str]) -> list[bytes]:
        if len(self.young) > self.cache_units:
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, pieces))
        for at in (missing := [i for i, v in enumerate(found) if v is None]):
            found[at] = self.old.get(pieces[at])
        new = [i for i in missing if found[i] is None]
        for at, v in zip(new, self._learn_bytes([pieces[i] for i in new]), strict=True):
            found[at] = v
        self.young.update((pieces[i], found[i]) for i in missing if len(pieces[i]) <= CACHED_UNIT_CHARS)
        return found

    def _placed(self, unit: str, spans: list[tuple[int, int]]) -> list[list[tuple[int, int, int]]]:
        """Tokens of unit[a:b] for each span as (id, start, end) in the unit."""
        self.window_chars += sum(b - a for a, b in spans)
        coded = self.tok.encode_batch([unit[a:b] for a, b in spans], add_special_tokens=False)
        return [[(i, a + x, a + y) for i, (x, y) in zip(e.ids, e.offsets, strict=True)] for e, (a, _) in zip(coded, spans, strict=True)]

    def tree_ids(self, unit: str) -> list[int]:
        """Ids of an unsplit unit by its halving tree, joined level by level."""
        spans = self.leaves(unit)
        coded = self._placed(unit, spans)
        while len(coded) > 1:
            joined, over = [], []
            for i in range(0, len(coded) - 1, 2):
                joined.append(self._join(unit, spans[i], spans[i + 1], coded[i], coded[i + 1]))
                over.append((spans[i][0], spans[i + 1][1]))
            if len(coded) % 2:
                joined.append(coded[-1])
                over.append(spans[-1])
            coded, spans = joined, over
        return [t[0] for t in coded[0]]

    def _join(self, unit: str, left_span: tuple[int, int], right_span: tuple[int, int], left: list, right: list) -> list:
        (lo, cut), (_, hi) = left_span, right_span
        reach = max(self.first_window, self.longest_added)
        while True:
            a, b = max(lo, cut - reach), min(hi, cut + reach)
            mid = self._placed(unit, [(a, b)])[0]
            near_left = left[bisect_left(left, a, key=lambda t: t[1]) :]
            near_right = right[: bisect_right(right, b, key=lambda t: t[2])]
            before = (0, 0) if a == lo else _meeting(mid, near_left, lambda t: t[2] <= cut)
            after = (len(mid), len(near_right)) if b == hi else _meeting(mid, near_right, lambda t: t[1] >= cut)
            if before and after:
                kept = left[: len(left) - len(near_left) + before[1]] if a > lo else []
                rest = right[after[1] :] if b < hi else []
                return kept + mid[before[0] : after[0]] + rest
            reach *= 2

    def token_text(self, ids: Iterable[int]) -> str:
        return self.tok.decode(list(ids), skip_special_tokens=False)


def _meeting(mid: list, side: list, where: Callable) -> tuple[int, int] | None:
    """The first places (in `mid`, in `side`) of a token that both hold there with the token after it; the window's own ends do not count."""
    at = {}
    for j, t in enumerate(side):
        at[t] = None if t in at else j  # bytes of one character may repeat
    for i in range(1, len(mid) - 2):
        j = at.get(mid[i])
        if j is not None and where(mid[i]) and where(mid[i + 1]) and j + 1 < len(side) and side[j + 1] == mid[i + 1]:
            return i, j
    return None


def grouped(texts: list[str], limit: int = GROUP_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) in runs of about `limit` characters."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit:
            yield start, texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def encode(docs: DataFrame, path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text.

    A null or empty text has no ids; a null doc_id is kept; repeated rows give
    repeated rows. One pass over the rows, no shuffle.
    """
    path = path or default_tokenizer_path()

    def run(batches):
        codec = Codec(path, leaf_chars)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at, group in grouped(texts):
                ids = [[i for unit in units for i in unit] for units in codec.encode_units(group)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(group)), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text): the library's decoding of `ids`; null ids decode as none."""
    path = path or default_tokenizer_path()

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            texts = [codec.token_text(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def roundtrip_digest(docs: DataFrame, path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, in one pass.

    The same tree encoder as `encode`; hashing beside it keeps the ids out of
    the JVM. Decoding is the tokenizer's own per id: a file without a decoder
    joins the tokens with one space, any other one goes through decode().
    """
    path = path or default_tokenizer_path()

    def run(batches):
        codec = Codec(path, leaf_chars)
        plain, token, sha = codec.tok.decoder is None, codec.tok.id_to_token, hashlib.sha256
        codec.form = lambda ids: (len(ids), " ".join(map(str, ids)), " ".join(map(token, ids)) if plain else tuple(ids))
        for batch in batches:
            for at, group in grouped(batch.column("text").to_pylist()):
                n, ids_sha, text_sha = [], [], []
                for units in codec.encode_units(group):
                    units = [u for u in units if u[0]]
                    n.append(sum([u[0] for u in units]))
                    ids_sha.append(sha(" ".join([u[1] for u in units]).encode()).hexdigest())
                    decoded = " ".join([u[2] for u in units]) if plain else codec.token_text(i for u in units for i in u[2])
                    text_sha.append(sha(decoded.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(group)), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return doc_texts(docs).mapInArrow(uncollected(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip_digest(table(spark, sf_dir, "documents"))
