"""Bounded-space online packing of tokenized documents into fixed windows.

Each partition keeps at most `open_windows` windows open. A document's last
piece goes to the open window that it fits best; when none fits and no more may
be opened, the fullest is filled up with the head of the piece and emitted. At
a partition's end its open windows are merged into full ones, which leaves one
partly filled window; those tails are merged over groups of `merge_fan`
partitions, so the padding is less than one window for each group.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import LEAF_CHARS, Codec, default_tokenizer_path
from .common import doc_texts, staged, table, uncollected

WINDOW = 2048
OPEN_WINDOWS = 32
MERGE_FAN = 256
END_ID = 1

PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, open boolean, tail_group long, ids binary"


class Windows:
    """The open windows of one partition. Pieces are (doc_id, start, doc_tokens, ids as little-endian uint32 bytes)."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next_id = size, most, first_id
        self.open: list[list] = []  # [tokens held, pieces]
        self.done: list[tuple] = []  # (piece, sequence_id, offset)

    def _emit(self, pieces) -> None:
        at = 0
        for p in pieces:
            self.done.append((p, self.next_id, at))
            at += len(p[3]) // 4
        self.next_id += 1

    def add(self, doc_id, start, total, ids) -> None:
        size = self.size
        whole = len(ids) // 4 // size * size
        for at in range(0, whole, size):
            self._emit([(doc_id, start + at, total, ids[4 * at : 4 * (at + size)])])
        start, ids = start + whole, ids[4 * whole :]
        while n := len(ids) // 4:
            best = None
            for w in self.open:
                if w[0] + n <= size and (best is None or w[0] > best[0]):
                    best = w
            if best is None and len(self.open) < self.most:
                self.open.append(best := [0, []])
            if best is not None:
                best[0] += n
                best[1].append((doc_id, start, total, ids))
                if best[0] == size:
                    self.open.remove(best)
                    self._emit(best[1])
                return
            full = max(self.open, key=lambda w: w[0])
            room = size - full[0]
            self.open.remove(full)
            self._emit([*full[1], (doc_id, start, total, ids[: 4 * room])])
            start, ids = start + room, ids[4 * room :]

    def merge(self) -> tuple[int, list]:
        """Empty the open windows into full ones, in order; what is left for the last window."""
        held, pieces = 0, []
        for w in self.open:
            for doc_id, start, total, ids in w[1]:
                while len(ids) // 4 >= self.size - held:
                    room = self.size - held
                    self._emit([*pieces, (doc_id, start, total, ids[: 4 * room])])
                    held, pieces, start, ids = 0, [], start + room, ids[4 * room :]
                if ids:
                    held += len(ids) // 4
                    pieces.append((doc_id, start, total, ids))
        self.open = []
        return held, pieces


def _rows(done, tail_group, is_open) -> pa.RecordBatch:
    cols = list(zip(*((p[0], p[1], len(p[3]) // 4, p[2], seq, at, is_open, tail_group, p[3]) for p, seq, at in done), strict=True)) or [[]] * 9
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECE.split(", ")])


def pack_partitions(docs: DataFrame, path: str | None = None, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID, merge_fan: int = MERGE_FAN, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Pieces (columns of PIECE, ids as little-endian uint32) with each partition packed by itself.

    `open` marks the pieces of the partition's last window, to be merged by
    `merge_tails`. Stage the result before using it twice: a partition's
    numbering depends on its row order. A null or empty text is the end id
    alone; repeated rows are packed again; no rows give no pieces.
    """
    path = path or default_tokenizer_path()

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        codec = Codec(path, leaf_chars)
        end = struct.pack("<I", end_id)
        windows = Windows(window, open_windows, part << 32)

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, coded in zip(ids, codec.encode_bytes(batch.column("text")), strict=True):
                coded += end
                windows.add(doc_id, 0, len(coded) // 4, coded)
                if len(windows.done) >= 1000:
                    yield _rows(windows.done, None, False)
                    windows.done = []
        _, pieces = windows.merge()
        yield _rows(windows.done, None, False)
        windows.done = []
        if pieces:
            windows._emit(pieces)
            yield _rows(windows.done, part // merge_fan, True)

    return doc_texts(docs).mapInArrow(uncollected(run), PIECE)


def merge_tails(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Repack the `open` pieces of each group of partitions; a group has less than merge_fan * window tokens."""

    def run(key, batch):
        rows = sorted(batch.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        seqs = list(dict.fromkeys(r["sequence_id"] for r in rows))
        w = Windows(window, 1, 0)
        w.open = [[0, [(r["doc_id"], r["start"], r["doc_tokens"], r["ids"]) for r in rows]]]
        _, rest = w.merge()
        if rest:
            w._emit(rest)
        # No more windows come out than went in, so the old numbers suffice and stay unique.
        return pa.Table.from_batches([_rows([(p, seqs[s], at) for p, s, at in w.done], key[0].as_py(), False)])

    return pieces.groupBy("tail_group").applyInArrow(run, PIECE)


def pack(docs: DataFrame, **options) -> DataFrame:
    """Pieces with their ids: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32)."""
    merge_options = {"window": options["window"]} if "window" in options else {}
    local = staged(pack_partitions(docs, **options), "pack")
    return local.where("not open").unionByName(merge_tails(local.where("open"), **merge_options)).drop("open", "tail_group")


def pack_digest(docs: DataFrame, **options) -> DataFrame:
    """As `pack`, with ids_crc32 in place of the ids, which are then stored for the tails alone."""
    merge_options = {"window": options["window"]} if "window" in options else {}
    crc = F.crc32("ids").alias("ids_crc32")
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    local = staged(pack_partitions(docs, **options).select("*", crc).withColumn("ids", F.when(F.col("open"), F.col("ids"))), "pack")
    tails = merge_tails(local.where("open").drop("ids_crc32"), **merge_options).select("*", crc)
    return local.where("not open").select(*cols).unionByName(tails.select(*cols))


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_digest(table(spark, sf_dir, "documents"))
