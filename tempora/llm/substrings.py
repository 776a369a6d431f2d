"""Removal of repeated strings of 50 bytes, with column-wise Burrows-Wheeler construction.

1. Texts are UTF-8 bytes. Equal texts (by sha256) are one class; only the row
   with the least doc_id of a class is looked at further, its copies are covered
   whole. Classes go by short names; those that share a name send all anchors on.
2. Every 50-byte string holds a winnowed anchor (see `anchors`), the same one
   wherever the string occurs. Anchor hashes are dealt by hash, packed many to
   a row; a hash that one task sees in several classes is sent once, so a hot
   passage costs a row per task and not one per document. Hashes of a single
   class are dropped.
3. Around each shared anchor a document is cut to the segment (80 bytes) that
   holds all 50-byte strings containing it. Segments are dealt by anchor; equal
   ones are collapsed before and after the shuffle onto their least doc_id,
   which keeps all places where it holds the segment. An anchor of very many
   texts is split by the bytes beside it: for each of four ranges of its place
   in the string, segments are dealt by the 43 or 44 bytes that all strings of
   the range share, so a string's holders still meet.
4. The distinct segments of a bucket, in collections of bounded size, go
   through the column-wise construction: in each round one symbol of every
   segment is inserted, right to left, and the transform's symbols, sorted
   stably, give the next suffix order. The columns of a round are read and
   written front to back, as the external files of the disk-based method are;
   bounded collections let them stay in memory. Neighbours with a common prefix
   of 50 bytes form the intervals; in each, the least doc_id keeps its string.
5. Covered spans are united by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import anchors, prefix_sums
from .common import staged, table
from .shingles import mix

SPAN, K = 50, 20
GROUP_BYTES = 1 << 20
#: A task sends its anchors after about this many bytes of text.
SEND_BYTES = 16 << 20
#: A bucket gets the anchors of about this many bytes of text.
BUCKET_BYTES = 4 << 20
#: An anchor that more classes hold is split by the bytes beside it; at most so many anchors (8 bytes each) are, those of most classes.
HOT_CLASSES, MOST_HOT = 20_000, 1 << 18
#: Places of an anchor in a string of SPAN bytes, in ranges that a split anchor is dealt by.
RANGES = ((0, 7), (8, 15), (16, 23), (24, SPAN - K))
#: Buckets that one task works through.
TASK_BUCKETS = 8
#: Segments that a task holds before it sends them.
CUT_SEGMENTS = 75_000
#: Segments in one construction (one anchor's segments stay together).
COLLECTION = 4096
#: Bits in the name of a class (at most 48); classes may share a name.
NAME_BITS = 48
#: Ids that may be broadcast to keep untouched texts out of a shuffle.
BROADCAST_IDS = 1 << 20


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.shiftrightunsigned(F.xxhash64(text), 64 - NAME_BITS), F.lit(1)).alias("cls"), text.alias("text"))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string column."""
    raw = column.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    body = raw.buffers()[2]
    return np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8), offsets


def _runs(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


def _anchors_of(column: pa.Array) -> Iterator[tuple]:
    """(bytes, bounds, first text, anchor places, anchor hashes of 48 bits, prefix sums, inverse powers) for runs of texts."""
    body, offsets = _bytes_of(column)
    for a, b in _runs(offsets, GROUP_BYTES):
        data, bounds = body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        sums, down = prefix_sums(data)
        yield data, bounds, a, *anchors(data, bounds, K, SPAN, sums, down), sums, down


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unsix(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows by bucket; the number of tasks grows with that of the buckets."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // TASK_BUCKETS))
    return rows.repartition(tasks, "bucket").sortWithinPartitions("bucket")


def shared_anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """(cls, anchor) for each anchor hash that several classes hold."""

    def send(batches):
        held, size = [], 0
        for batch in batches:
            cls = batch.column("cls").to_numpy().astype(np.uint64)
            for data, bounds, first, places, hashes, _, _ in _anchors_of(batch.column("text")):
                held.append((hashes, cls[np.searchsorted(bounds, places, "right") - 1 + first]))
                size += len(data)
                if size >= SEND_BYTES:
                    yield _blobs(held)
                    held, size = [], 0
        if held:
            yield _blobs(held)

    def _blobs(held):
        h, c = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        order = np.lexsort((c, h, h % np.uint64(buckets)))
        h, c = h[order], c[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, bool)
        h, c = h[new], c[new]
        # Seen in several classes here already: known to be shared; one row stands for all in the bucket.
        head = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        group = np.cumsum(head) - 1
        several = (np.bincount(group) > 1)[group] if len(h) else np.zeros(0, bool)
        sent = ~several | head
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        rows = []
        for b, e in _slices(bucket):
            s, k = sent[b:e], several[b:e]
            rows.append((int(bucket[b]), _six(h[b:e][s]), _six(np.where(k, 0, c[b:e])[s]), _six(h[b:e][k]), _six(c[b:e][k])))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(x, pa.binary()) for x in cols[1:])], names=["bucket", "h", "c", "known_h", "known_c"])

    def meet(batches):
        for rows in _by_bucket(batches):
            for r in rows:
                if r["known_h"]:
                    yield _pairs(_unsix(r["known_c"]), _unsix(r["known_h"]))
            h, c = (np.concatenate([_unsix(r[k]) for r in rows]) for k in ("h", "c"))
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            head = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
            differs = np.zeros(len(h), bool)
            differs[1:] = ~head[1:] & (c[1:] != c[:-1])
            group = np.cumsum(head) - 1
            shared = (np.bincount(group, weights=differs | (c == 0)) > 0)[group] & (c != 0) if len(h) else differs
            yield _pairs(c[shared], h[shared])

    def _pairs(c, h):
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)), pa.array(h.astype(np.int64))], names=["cls", "anchor"])

    blobs = texts.select("cls", "text").mapInArrow(send, "bucket long, h binary, c binary, known_h binary, known_c binary")
    return _dealt(blobs, buckets).mapInArrow(meet, "cls long, anchor long")


def all_anchors(texts: DataFrame) -> DataFrame:
    """(cls, anchor) of every anchor."""

    def run(batches):
        for batch in batches:
            cls = batch.column("cls").to_numpy()
            for _, bounds, first, places, hashes, _, _ in _anchors_of(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(cls[np.searchsorted(bounds, places, "right") - 1 + first]), pa.array(hashes.astype(np.int64))], names=["cls", "anchor"])

    return texts.select("cls", "text").mapInArrow(run, "cls long, anchor long")


def _slices(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(keys):
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _by_bucket(batches) -> Iterator[list[dict]]:
    current, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] != current and held:
                yield held
                held = []
            current = r["bucket"]
            held.append(r)
    if held:
        yield held


def _places(size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the entries of the chosen rows lie, if row i has size[i] entries, back to back."""
    begin = np.cumsum(size) - size
    n = size[rows]
    return np.arange(int(n.sum()), dtype=np.int64) + np.repeat(begin[rows] - (np.cumsum(n) - n), n)


def _joined_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Spans (doc, start, end) that meet or overlap, as one."""
    if not len(doc):
        return [np.zeros(0, np.int64)] * 3
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    base = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]) * (int(end.max()) + 1)  # sets documents apart
    reach = np.maximum.accumulate(end + base)
    opens = np.concatenate([[True], (start + base)[1:] > reach[:-1]])
    closes = np.append(opens[1:], True)
    return [doc[opens], start[opens], (reach - base)[closes]]


class Segments:
    """Segments in columns: anchor, hash of the bytes, doc_id, number of places in the text, length; the places, and the bytes, back to back."""

    FIELDS = ("anchor", "code", "doc", "times", "size")

    def __init__(self, columns: list[np.ndarray], starts: np.ndarray, body: np.ndarray):
        self.columns, self.starts, self.body = columns, starts, body

    @classmethod
    def joined(cls, parts: list[Segments]) -> Segments:
        return cls([np.concatenate([p.columns[i] for p in parts]) for i in range(5)], np.concatenate([p.starts for p in parts]), np.concatenate([p.body for p in parts]))

    def __len__(self) -> int:
        return len(self.columns[0])

    def collapsed(self) -> tuple[Segments, list[np.ndarray]]:
        """Of equal segments the one of the least doc_id, with all its places there, and the spans (doc, start, end) that the others cover whole; in order of anchor."""
        anchor, code, doc, times, size = self.columns
        order = np.lexsort((doc, code, anchor))
        same = np.zeros(len(order), bool)
        same[1:] = (anchor[order][1:] == anchor[order][:-1]) & (code[order][1:] == code[order][:-1])
        head = np.flatnonzero(~same)
        least = doc[order][head][np.cumsum(~same) - 1] if len(order) else doc
        other = doc[order] > least
        lost, own = order[other], order[~other]
        out = self.taken(order[head])
        if len(own):
            out.columns[3] = np.add.reduceat(times[own], np.flatnonzero(~same[~other]))
            out.starts = self.starts[_places(times, own)]
        start = self.starts[_places(times, lost)]
        return out, _joined_spans(np.repeat(doc[lost], times[lost]), start, start + np.repeat(size[lost], times[lost]))

    def taken(self, rows: np.ndarray) -> Segments:
        return Segments([c[rows] for c in self.columns], self.starts[_places(self.columns[3], rows)], self.body[_places(self.columns[4], rows)])

    def texts(self) -> list[bytes]:
        ends = np.cumsum(self.columns[4])
        body = self.body.tobytes()
        return [body[e - n : e] for e, n in zip(ends.tolist(), self.columns[4].tolist(), strict=True)]


def suffix_order(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of all non-empty suffixes in lexicographic order (a prefix before what it begins).

    Round by round, each segment's next symbol to the left is inserted; the
    stable order of the transform's symbols is the order of the longer suffixes.
    """
    m, width = len(segments), max(map(len, segments))
    text = np.zeros((m, width + 1), np.uint16)  # column s holds the symbol before offset s, 0 at the front
    for i, s in enumerate(segments):
        text[i, 1 : len(s) + 1] = np.frombuffer(s, np.uint8).astype(np.uint16) + 1
    flat = text.ravel()
    ends = np.arange(m, dtype=np.int64) * (width + 1) + np.array([len(s) for s in segments])
    order = ends  # the empty suffixes
    for _ in range(width):
        symbols = flat[order]
        by_symbol = np.argsort(symbols, kind="stable")
        by_symbol = by_symbol[np.count_nonzero(symbols == 0) :]
        order = np.concatenate([ends, order[by_symbol] - 1])
    order = order[m:]
    return order // (width + 1), order % (width + 1)


def _intervals(distinct: Segments) -> list[np.ndarray]:
    """Covered spans (doc, start, end) of distinct segments, at all their places: in each interval of common prefixes of at least SPAN bytes, all documents but the least lose the string."""
    segments, docs, times = distinct.texts(), distinct.columns[2], distinct.columns[3]
    which, offset = suffix_order(segments)
    lengths = np.array([len(s) for s in segments])
    fits = lengths[which] - offset >= SPAN
    # Shorter suffixes between two that fit would end their common prefix before SPAN, so leaving them out is safe.
    which, offset = which[fits], offset[fits]
    if len(which) < 2:
        return [np.zeros(0, np.int64)] * 3
    joined = np.frombuffer(b"".join(segments), np.uint8)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])[which] + offset
    windows = np.lib.stride_tricks.sliding_window_view(joined, SPAN)
    same = np.concatenate([(windows[begin[i + 1 : i + 20001]] == windows[begin[i : i + 20000][: len(begin[i + 1 : i + 20001])]]).all(axis=1) for i in range(0, len(begin) - 1, 20000)])
    group = np.concatenate([[0], np.cumsum(~same)])
    heads = np.concatenate([[0], np.flatnonzero(~same) + 1])
    lost = docs[which] > np.minimum.reduceat(docs[which], heads)[group]
    which, offset = which[lost], offset[lost]
    order = np.lexsort((offset, which))
    which, offset = which[order], offset[order]
    opens = np.ones(len(which), bool)
    opens[1:] = (which[1:] != which[:-1]) | (offset[1:] > offset[:-1] + SPAN)
    closes = np.append(opens[1:], True)[: len(opens)]
    i = which[opens]
    start = distinct.starts[_places(times, i)]
    return _joined_spans(np.repeat(docs[i], times[i]), start + np.repeat(offset[opens], times[i]), start + np.repeat(offset[closes] + SPAN, times[i]))


SENT = "bucket long, anchor binary, code binary, doc binary, times binary, size binary, starts binary, body binary"


def covered_spans(located: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """(doc_id, start, end), unmerged, from (doc_id, text, shared), `shared` being a text's shared anchor hashes; `hot` anchors are split."""

    def cut(batches):
        # Segments go packed to their bucket; the spans that local copies settle at once go along in the same columns, without bytes.
        held, count = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            shared = batch.column("shared")
            for data, bounds, first, places, hashes, sums, down in _anchors_of(batch.column("text")):
                doc = np.searchsorted(bounds, places, "right") - 1
                lists = shared.slice(first, len(bounds) - 1)
                wanted = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
                sizes = np.diff(lists.offsets.to_numpy())
                mark = lambda h, d: h | (d.astype(np.uint64) << np.uint64(48))  # noqa: E731 - a run has fewer than 2^16 texts of 50 bytes
                hit = np.isin(mark(hashes, doc), mark(wanted, np.repeat(np.arange(len(sizes)), sizes)))
                if not hit.any():
                    continue
                doc, p, h = doc[hit], places[hit], hashes[hit]
                hashed = lambda a, b: mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))  # noqa: B023, E731 - used in this round
                split, begin, end = np.isin(h, hot), bounds[doc], bounds[doc + 1]
                cold = np.flatnonzero(~split)
                parts = [(cold, p[cold] - (SPAN - K), p[cold] + SPAN, h[cold])]
                for lo, hi in RANGES if split.any() else ():
                    ok = np.flatnonzero(split & (p - lo >= begin) & (p + SPAN - hi <= end))
                    parts.append((ok, p[ok] - hi, p[ok] + SPAN - lo, mix(h[ok] ^ hashed(p[ok] - lo, p[ok] + SPAN - hi)) >> np.uint64(16)))
                at, a, b, h = (np.concatenate([x[i] for x in parts]) for i in range(4))
                doc, a, b = doc[at], np.maximum(begin[at], a), np.minimum(end[at], b)
                code = hashed(a, b)
                size = b - a
                gather = np.arange(int(size.sum()), dtype=np.int64) + np.repeat(a - (np.cumsum(size) - size), size)
                held.append(Segments([h.astype(np.int64), code.view(np.int64), ids[first + doc], np.ones(len(h), np.int64), size], a - bounds[doc], data[gather]))
                count += len(h)
                if count >= CUT_SEGMENTS:
                    yield _sent(held)
                    held, count = [], 0
        if held:
            yield _sent(held)

    def _sent(held):
        segments, spans = Segments.joined(held).collapsed()
        bucket = segments.columns[0] % buckets
        segments = segments.taken(np.argsort(bucket, kind="stable"))
        bucket = segments.columns[0] % buckets
        places, ends = (np.concatenate([[0], np.cumsum(c)]) for c in segments.columns[3:])
        rows = []
        for a, b in _slices(bucket):
            starts, body = segments.starts[places[a] : places[b]], segments.body[ends[a] : ends[b]]
            rows.append((int(bucket[a]), *(np.ascontiguousarray(c[a:b]).tobytes() for c in segments.columns), starts.tobytes(), body.tobytes()))
        if len(spans[0]):
            rows.append((int(spans[0][0] % buckets), None, None, *(x.astype(np.int64).tobytes() for x in spans), None, None))
        cols = list(zip(*rows, strict=True)) or [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=[x.split()[0] for x in SENT.split(", ")])

    def build(batches):
        numbers = lambda x: np.frombuffer(x, np.int64)
        for rows in _by_bucket(batches):
            parts = []
            for r in rows:
                columns = [numbers(r[c]) for c in Segments.FIELDS if r[c] is not None]
                if r["anchor"] is None:
                    yield _rows(columns)
                else:
                    parts.append(Segments(columns, numbers(r["starts"]), np.frombuffer(r["body"], np.uint8)))
            if not parts:
                continue
            segments, spans = Segments.joined(parts).collapsed()
            yield _rows(spans)
            anchor = segments.columns[0]
            cuts = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]])
            several = np.flatnonzero(np.diff(cuts) > 1)
            pool, count = [], 0
            for i in several.tolist():
                pool.append(np.arange(cuts[i], cuts[i + 1]))
                count += len(pool[-1])
                if i == several[-1] or count >= COLLECTION:
                    yield _rows(_intervals(segments.taken(np.concatenate(pool))))
                    pool, count = [], 0

    def _rows(spans):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in spans], names=["doc_id", "start", "end"])

    return _dealt(located.mapInArrow(cut, SENT), buckets).mapInArrow(build, "doc_id long, start long, end long")


def _united(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((s["start"], s["end"]) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, keep_bytes: bool = True, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with `keep_bytes`, the remaining bytes as `kept`, for every row.

    A null text is empty. Rows with equal doc_id never remove anything from
    each other; a row without doc_id neither loses nor removes anything. Texts
    under 50 bytes lose nothing. No documents give no rows.
    """
    texts = _texts(docs)
    base = staged(texts.select("doc_id", "cls", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    total = base.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(96, total // BUCKET_BYTES)
    first = base.where("doc_id is not null").groupBy("cls", "sha").agg(F.min("doc_id").alias("doc_id"))
    anchored = shared_anchors(texts.where("doc_id is not null"), buckets)
    # What only texts of one name share would seem to be of a single class.
    clashes = staged(first.groupBy("cls").count().where("count > 1").select("cls"), "clashes")
    if clashing := clashes.count():
        anchored = anchored.unionByName(all_anchors(texts.where("doc_id is not null").join(F.broadcast(clashes) if clashing <= BROADCAST_IDS else clashes, "cls", "left_semi")))
    shared = staged(anchored, "anchors")
    lists = shared.groupBy("cls").agg(F.collect_set("anchor").alias("shared")).join(first.select("cls", "doc_id").distinct(), "cls")
    located = texts.join(lists, ["doc_id", "cls"]).select("doc_id", "text", "shared")
    hot = shared.groupBy("anchor").count().where(F.col("count") > hot_classes).orderBy(F.desc("count"), "anchor").limit(MOST_HOT).collect()
    spans = staged(covered_spans(located, buckets, np.array([r["anchor"] for r in hot], np.uint64)), "spans")
    touched = staged(spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "touched")
    held = base.join(first.withColumnRenamed("doc_id", "first"), ["cls", "sha"], "left")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= SPAN)
    whole = held.where(F.coalesce(copy, F.lit(False))).select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    rest = held.where(~F.coalesce(copy, F.lit(False)))
    ids = touched.select("doc_id")
    clean = rest.join(ids, "doc_id", "left_anti").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    few = touched.count() <= BROADCAST_IDS
    near = texts.join(F.broadcast(ids), "doc_id", "left_semi") if few else texts
    owned = near.join(touched, "doc_id").withColumn("sha", F.sha2("text", 256)).join(first.withColumnRenamed("doc_id", "first"), ["cls", "sha"]).where("doc_id <= first").select("doc_id", "text", "spans")

    def apply(batches):
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data, at, out = text.encode(), 0, []
                cuts = _united(spans)
                for a, b in cuts:
                    out.append(data[at:a])
                    at = b
                kept = b"".join([*out, data[at:]])
                rows.append((doc_id, len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    cut = owned.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if not keep_bytes:
        return cut.drop("kept").unionByName(whole).unionByName(clean)
    empty = whole.withColumn("kept", F.lit(b"").cast("binary"))
    own = texts.select("doc_id", F.sha2("text", 256).alias("kept_sha256"), F.encode("text", "UTF-8").alias("kept")).dropDuplicates(["doc_id", "kept_sha256"])
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("kept_sha256") == F.col("_sha"))
    kept = clean.join(own.select(F.col("doc_id").alias("_id"), F.col("kept_sha256").alias("_sha"), "kept"), same).drop("_id", "_sha")
    return cut.unionByName(empty).unionByName(kept)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)


OP6_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n_bytes from documents),
w as (select doc_id, p, substr(h, 2 * p + 1, 100) as s from (select doc_id, h, unnest(range(0, n_bytes - 49)) as p from d where n_bytes >= 50)),
f as (select s, min(doc_id) as first from w group by s having count(*) > 1),
l as (select doc_id, p, lag(p) over (partition by doc_id order by p) as before from w join f using (s) where doc_id > first),
g as (select doc_id, p, sum(case when before is null or p > before + 50 then 1 else 0 end) over (partition by doc_id order by p) as span from l),
r as (select doc_id, span, min(p) as a, max(p) + 50 as b from g group by 1, 2),
k as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as last from r),
t as (select k.doc_id, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as kept from k join d using (doc_id) group by 1)
select d.doc_id, n_bytes::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join t using (doc_id)
"""
