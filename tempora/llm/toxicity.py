"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on what
toxic text adds to it. A window of text, put between carriers that both
dictionaries hold (so that even one short word makes a compressible block), is
compressed with either; the bytes that the toxic dictionary saves are the
window's gain. Thresholds on the gain are calibrated for each window length so
that windows of ordinary training documents hardly ever reach them, and a
logistic curve turns a document's hits into its score.

The fit uses a bounded sample of labelled documents (`MAX_TOXIC`,
`MAX_ORDINARY`, `MAX_TRAIN_CHARS`), in one task on an executor; the model is a
few dozen KB, whatever the size of the corpus. Scoring covers every whole text
in one pass without a shuffle.
"""

from __future__ import annotations

import json
import math
import random
from collections import Counter, defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from .common import doc_texts, mapped_rows, table, uncollected

#: The labelled rows fitted on: so many of each class, those with the smallest hash of doc_id.
MAX_TOXIC, MAX_ORDINARY = 4000, 8000
#: Longer documents are left out of the fit (never out of scoring).
MAX_TRAIN_CHARS = 20_000
WINDOW_WORDS = 1
LEVEL = 12
BASE_BYTES, TOXIC_BYTES = 32_768, 32_768
#: A word goes into the toxic dictionary when it is this much likelier in toxic documents, in this many different contexts.
MIN_RATIO, MIN_CONTEXTS = 20, 5
#: Of ordinary windows, at most this share may reach a threshold.
MAX_WINDOW_RATE = 2e-5
CUTOFF = 0.7
CACHE_WINDOWS = 300_000
#: What surrounds a window; zstandard looks for no match that starts in the last 8 bytes.
HEAD, TAIL = bytes(range(1, 9)), bytes(range(14, 32))
EDGE = ".,;:!?\"'()[]{}"


def windows_of(text: str, size: int = WINDOW_WORDS) -> list[str]:
    """Runs of `size` words of the lower-cased text; the last may be shorter."""
    words = text.lower().split()
    return words if size == 1 else [" ".join(words[i : i + size]) for i in range(0, len(words), size)]


class Scorer:
    """Gains, hits and scores under one model (a dict as `fit` makes it)."""

    def __init__(self, model: dict):
        import zstandard as zstd

        def compressor(content: bytes):
            d = zstd.ZstdCompressionDict(content + HEAD + TAIL, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=model["level"])
            return zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        # The toxic content stands in front, so ordinary text finds its matches at the same distances in both.
        self.ordinary, self.toxic = compressor(model["base"]), compressor(model["added"] + model["base"])
        self.model, self.young, self.old = model, {}, {}

    def gain(self, window: str) -> tuple[int, int]:
        """(length in bytes, bytes saved by the toxic dictionary)."""
        core = b" " + window.strip(EDGE).encode() + b" "
        block = HEAD + core + TAIL
        return len(core) - 2, len(self.ordinary(block)) - len(self.toxic(block))

    def hit(self, window: str) -> int:
        n, gain = self.gain(window)
        limits = self.model["limits"]
        return int(gain >= limits[min(n, len(limits) - 1)])

    def hits(self, text: str) -> tuple[int, int]:
        """(windows that reach their threshold, windows)."""
        windows = windows_of(text, self.model["window_words"])
        got = list(map(self.young.get, windows))
        if None in got:
            for i, v in enumerate(got):
                if v is None:
                    w = windows[i]
                    v = self.young.get(w)
                    if v is None:
                        if len(self.young) > CACHE_WINDOWS:
                            self.old, self.young = self.young, {}
                        v = self.old.get(w)
                        v = self.young[w] = self.hit(w) if v is None else v
                    got[i] = v
        return sum(got), len(got)

    def score(self, text: str) -> float:
        a, b, c = self.model["curve"]
        hits, n = self.hits(text)
        z = a + b * math.log1p(hits) + c * math.log1p(100 * hits / max(1, n))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _logistic(rows: list[tuple[float, float, int]]) -> list[float]:
    """Weights of a ridge-regularised logistic curve over two features, by Newton steps."""
    import numpy as np

    x = np.array([[1.0, a, b] for a, b, _ in rows])
    y = np.array([r[2] for r in rows], float)
    w, ridge = np.zeros(3), np.diag([1e-6, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def _train_dictionary(samples: list[bytes], size: int) -> bytes:
    import zstandard as zstd

    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:  # too few samples to train on: their own text is the dictionary
        return b" ".join(samples)[-size:]


def fit(rows: list[tuple[str, int]], window_words: int = WINDOW_WORDS) -> dict | None:
    """Model from (text, label) rows; None where a class is missing. Copies count once, in any order of the rows."""
    rows = sorted(set(rows))
    n = [sum(1 for _, y in rows if y == k) for k in (0, 1)]
    if not min(n):
        return None
    seen = [Counter(), Counter()]
    for text, y in rows:
        seen[y].update({w.strip(EDGE) for w in text.lower().split()})
    likelier = {w for w, a in seen[1].items() if w and a / n[1] > MIN_RATIO * seen[0][w] / n[0]}
    contexts: dict[str, set] = defaultdict(set)  # near copies repeat a word in one context, the vocabulary of a class in many
    for text, y in rows:
        if y:
            words = ["", *(w.strip(EDGE) for w in text.lower().split()), ""]
            for before, w, after in zip(words, words[1:], words[2:], strict=False):
                if w in likelier:
                    contexts[w].add((before, after))
    telling = sorted((len(c), w) for w, c in contexts.items() if len(c) >= MIN_CONTEXTS)
    added = b"  ".join([b"", *(w.encode() for _, w in telling), b""])[-TOXIC_BYTES:]
    rng = random.Random(17)
    ordinary = [text for text, y in rows if not y]
    pool = [w.encode() for t in rng.sample(ordinary, min(len(ordinary), 3000)) for w in windows_of(t, 8)]
    base = _train_dictionary(rng.sample(pool, min(len(pool), 50_000)), BASE_BYTES)
    model = {"base": base, "added": added, "level": LEVEL, "window_words": window_words, "limits": [99], "curve": [0.0, 0.0, 0.0]}
    scorer = Scorer(model)
    # For each window length: the least gain that at most MAX_WINDOW_RATE of all ordinary windows reach.
    counts = Counter(w for t in ordinary for w in windows_of(t, window_words))
    gains: dict[int, Counter] = defaultdict(Counter)
    for w, c in counts.items():
        size, g = scorer.gain(w)
        gains[min(size, 64)][g] += c
    total, share = sum(counts.values()), MAX_WINDOW_RATE / 16
    limits = []
    for size in range(65):
        above, limit = 0, 99
        for g in sorted(gains[size], reverse=True):
            above += gains[size][g]
            if above > share * total:
                break
            limit = g
        # nothing ordinary reaches it: then what the toxic dictionary holds whole saves at least half of the window
        limits.append(max(2, min(limit, max([g for g in gains[size]], default=0) + 1), (size + 1) // 2))
    model["limits"] = limits
    scorer = Scorer(model)
    features = [(scorer.hits(t), y) for t, y in rows]
    model["curve"] = _logistic([(math.log1p(h), math.log1p(100 * h / max(1, m)), y) for (h, m), y in features])
    return model


def train(docs: DataFrame, labels: DataFrame, hold_out: bool = True, window_words: int = WINDOW_WORDS) -> dict | None:
    """Fit on labelled documents whose crc32(doc_id) mod 3 is not 1 (with `hold_out`).

    Null labels and ids are skipped, repeated label rows count once, and a
    document labelled both ways is toxic; None without documents of both classes.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if hold_out:
        ids = ids.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = ids.where("toxic = 1").orderBy(*by_hash).limit(MAX_TOXIC).unionByName(ids.where("toxic = 0").orderBy(*by_hash).limit(MAX_ORDINARY))
    sample = doc_texts(docs).where(F.length("text") <= MAX_TRAIN_CHARS).join(F.broadcast(chosen), "doc_id")  # at most MAX_TOXIC + MAX_ORDINARY rows

    def fit_all(pdf: pd.DataFrame) -> pd.DataFrame:
        model = fit(list(zip(pdf["text"], pdf["toxic"].astype(int), strict=True)))
        if model is None:
            return pd.DataFrame({"base": [b""], "added": [b""], "rest": [""]})
        rest = {k: v for k, v in model.items() if k not in ("base", "added")}
        return pd.DataFrame({"base": [model["base"]], "added": [model["added"]], "rest": [json.dumps(rest)]})

    found = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit_all, "base binary, added binary, rest string").collect()  # one row
    return {"base": bytes(found[0]["base"]), "added": bytes(found[0]["added"]), **json.loads(found[0]["rest"])} if found and found[0]["rest"] else None


def _scores(model: dict | None):
    scorer = Scorer(model) if model else None
    return lambda texts: pa.array([scorer.score(t or "") if scorer else 0.0 for t in texts], pa.float64())


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score) of every row; a null or empty text has the score of a text without hits, and without a model all have 0."""

    def run(batches):
        scores = _scores(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores(batch.column("text").to_pylist())], names=["doc_id", "score"])

    return doc_texts(docs).mapInArrow(uncollected(run), "doc_id long, score double")


def score_rows(docs: DataFrame, model: dict | None) -> DataFrame:
    """(row, result): each row of `docs` as a struct and its score, in one pass without a join."""

    def run():
        scores = _scores(model)
        return lambda texts: (texts, scores(texts))

    return mapped_rows(docs, run, StructField("result", DoubleType()))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= CUTOFF, 1).otherwise(0).cast("int").alias("predicted"))
