"""Near-duplicate groups by HyperMinHash.

1. Each text becomes its set of hashed 5-word shingles (whole text). Texts with
   equal sets (by a 128-bit digest) are one class from here on, so exact copies
   cost one row each; a class goes by a number, which shuffles in few bytes.
2. Sketch of a class: 128 buckets by the top bits of a shingle hash; a bucket
   keeps its least remaining hash as a leading-zero count and mantissa bits, in
   32 bits. Registers are banded by fours; 32 bands miss a pair at similarity
   0.75 with a probability of 5e-6. Bands without any register are not used.
3. Classes that share a band are a group. Near copies share many bands, so of
   the groups with the very same members only the one of the least key is kept;
   a pair is looked at in the group of its least common key, which is never one
   of those left out. A group beyond `BLOCK` members (or `BLOCK_SHINGLES`) is hot
   and dealt to shards; a class enters at most `HOT_GROUPS` of its hot groups,
   one shard each, so rows stay proportional to the members. Registers are
   fetched for the classes in a group only. In a group or shard, the
   collision-corrected estimate from the registers drops pairs that lie `SIGMAS`
   standard errors below the limit, and members without any passing partner leave.
4. The full sets of the others meet there and come out as links of a spanning
   forest, each verified; what is connected already is not compared again. Two
   dealings to random shards connect a cluster of near copies of any size.
5. Hot groups that still hold several components are compared block by block,
   large components against each other and against the rest, never within one
   component. So no link is lost, whatever the dealings left open.
6. Connected components over the verified links, by label propagation with
   pointer jumping, staged after every round.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_texts, maybe_among, salted_join, staged, table
from .shingles import mix, shingle_sets

BUCKET_BITS, MANTISSA_BITS, ROWS = 7, 26, 4
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // ROWS
#: Most members, and most shingles over all members, that one shard of a group may hold (one member may be larger).
BLOCK = 512
BLOCK_SHINGLES = 1 << 22
HOT_GROUPS = 2
SIGMAS = 5.0
#: Similarity limit as a fraction: link when PART * union <= WHOLE * intersection.
PART, WHOLE = 75, 100
#: This many wanted classes with name and doc_id, about 100 bytes each in a broadcast, may be sent whole; beyond it a filter of bounded size goes ahead of a shuffle.
BROADCAST_ROWS = 1 << 16


def registers(codes: np.ndarray) -> np.ndarray:
    """128 registers (uint32, 0: empty bucket) of a sorted set of hashes: 6 bits of leading zeros, then the mantissa."""
    out = np.zeros(BUCKETS, np.uint32)
    if len(codes):
        bucket = (codes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))  # the least hash of each bucket
        rest = (codes[first] << np.uint64(BUCKET_BITS)) >> np.uint64(11)  # 53 bits, exact as a float
        fraction, exponent = np.frexp(rest.astype(np.float64))
        zeros = np.where(rest == 0, 54, 53 - exponent).astype(np.uint32)
        mantissa = np.where(rest == 0, 0, (fraction * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.uint32)
        out[bucket[first]] = ((zeros + 1) << np.uint32(MANTISSA_BITS)) | mantissa  # never 0
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """For each row of registers its band keys (0: no register in the band)."""
    grouped = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(regs), BANDS))
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, j])
    return np.where(grouped.any(axis=2), key | np.uint64(1), np.uint64(0))


def class_of(codes: np.ndarray) -> bytes:
    """A 128-bit name for a sorted set of hashes; empty for the empty set."""
    return blake2b(codes.tobytes(), digest_size=16).digest() if len(codes) else b""


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, name, regs, bands) of every whole text; an empty name, no registers and no bands without words."""

    def run(batches):
        for batch in batches:
            n, name, regs = [], [], []
            for codes in shingle_sets(batch.column("text")):
                n.append(len(codes))
                name.append(class_of(codes))
                regs.append(registers(codes))
            if not n:
                continue
            keys = band_keys(np.array(regs)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(name, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary()), pa.array([k[k != 0] for k in keys], pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "name", "regs", "bands"],
            )

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_shingles long, name binary, regs binary, bands array<long>")


def _pass(regs: np.ndarray, filled: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    """Those of the members `js` whose estimated similarity to member i is not clearly below the limit."""
    accident = 2.0**-MANTISSA_BITS / 3
    limit = PART / WHOLE
    used = (filled[js] | filled[i]).sum(axis=1)
    equal = ((regs[js] == regs[i]) & filled[i]).sum(axis=1)
    estimate = (equal / used - accident) / (1 - accident)
    return js[estimate >= limit - SIGMAS * np.sqrt(limit * (1 - limit) / used)]


def _first_here(keys: np.ndarray, band: int, i: int, js: np.ndarray) -> np.ndarray:
    """Those of `js` that share `band` with member i as the least of their common band keys, so that a pair is looked at in one group."""
    same = (keys[js] == keys[i]) & (keys[i] != 0)
    return js[np.where(same, keys[i], np.iinfo(np.int64).max).min(axis=1) == band]


def _groups(batches, columns: list[str]) -> Iterator[tuple[int, dict[str, list]]]:
    """Rows in runs of equal `grp`, over batch borders."""
    held: dict[str, list] = {c: [] for c in columns}
    current = None
    for batch in batches:
        grp = batch.column("grp").to_numpy(zero_copy_only=False)
        data = {c: batch.column(c).to_pylist() for c in columns}
        cuts = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1], [True]])) if len(grp) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if grp[a] != current:
                if current is not None:
                    yield current, held
                current, held = grp[a], {c: [] for c in columns}
            for c in columns:
                held[c] += data[c][a:b]
    if current is not None:
        yield current, held


def partners(members: DataFrame) -> DataFrame:
    """(grp, band, side, every, label, cls): the members of each group that pass the estimate with another one of another label.

    `members` has grp, band, side, every, label, cls, regs. Where a group has
    both sides, only members of different sides are compared. A pair counts in
    the least of its common bands only, unless the group is for `every` pair. A member known to have a partner
    is compared only with members not known to have one, so groups of near
    copies take time in proportion to their size.
    """

    def run(batches):
        for grp, g in _groups(batches, ["band", "side", "every", "label", "cls", "regs"]):
            n = len(g["cls"])
            regs = np.frombuffer(b"".join(g["regs"]), np.uint32).reshape(n, BUCKETS)
            filled, keys = regs != 0, band_keys(regs).view(np.int64)
            side, label, has = np.array(g["side"], bool), np.array(g["label"], np.int64), np.zeros(n, bool)
            apart = side.any() and not side.all()
            for i in range(n - 1):
                js = np.arange(i + 1, n)
                if has[i]:
                    js = js[~has[i + 1 :]]
                js = js[label[js] != label[i]]
                if apart:
                    js = js[side[js] != side[i]]
                if len(js) and not g["every"][0]:
                    js = _first_here(keys, g["band"][0], i, js)
                if len(js):
                    js = _pass(regs, filled, i, js)
                    has[js] = True
                    has[i] |= len(js) > 0
            at = np.flatnonzero(has)
            if len(at):
                columns = [pa.array([grp] * len(at), pa.int64()), pa.array([g["band"][0]] * len(at), pa.int64()), pa.array(side[at]), pa.array([g["every"][0]] * len(at)), pa.array(label[at]), pa.array([g["cls"][i] for i in at], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["grp", "band", "side", "every", "label", "cls"])

    return members.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "grp long, band long, side boolean, every boolean, label long, cls long")


def forest(members: DataFrame) -> DataFrame:
    """(a, b): verified links that connect, within each group, whatever is linked and not yet of one label.

    `members` has grp, band, side, every, label, cls, codes; pairs are those of `partners`.
    """

    def run(batches):
        for _, g in _groups(batches, ["band", "side", "every", "label", "cls", "codes"]):
            sets = [np.frombuffer(x, np.uint64) for x in g["codes"]]
            n, sizes = len(sets), np.array([len(s) for s in sets])
            regs = np.array([registers(s) for s in sets])
            filled, keys = regs != 0, band_keys(regs).view(np.int64)
            side, of, links = np.array(g["side"], bool), np.array(g["label"], np.int64), []
            apart = side.any() and not side.all()
            for i in range(n - 1):
                js = np.arange(i + 1, n)
                js = js[(of[js] != of[i]) & (WHOLE * sizes[js] >= PART * sizes[i]) & (WHOLE * sizes[i] >= PART * sizes[js])]
                if apart:
                    js = js[side[js] != side[i]]
                if len(js) and not g["every"][0]:
                    js = _first_here(keys, g["band"][0], i, js)
                if len(js):
                    js = _pass(regs, filled, i, js)
                for j in js:
                    if of[j] == of[i]:
                        continue
                    s, t = (sets[i], sets[j]) if sizes[i] >= sizes[j] else (sets[j], sets[i])
                    common = int((s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t).sum())
                    if WHOLE * common >= PART * (len(s) + len(t) - common):
                        of[of == of[j]] = of[i]
                        links.append((g["cls"][i], g["cls"][j]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return members.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, codes) of the wanted (cls, name, doc_id) rows, hashed anew from the texts; without a doc_id, texts are found by their name."""
    n = wanted.count()
    few = n <= BROADCAST_ROWS
    texts = doc_texts(docs)
    chosen = (texts.join(F.broadcast(wanted), "doc_id") if few else maybe_among(texts, wanted, n).join(wanted.hint("merge"), "doc_id")).select("cls", "name", "text")

    def run(batches):
        for batch in batches:
            found = [(c, s) for c, name, s in zip(batch.column("cls").to_pylist(), batch.column("name").to_pylist(), shingle_sets(batch.column("text")), strict=True) if class_of(s) == name]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["cls", "codes"])

    def every(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["name", "codes"])

    found = chosen.mapInArrow(run, "cls long, codes binary")
    without = wanted.where("doc_id is null").select("cls", "name")
    if not without.isEmpty():
        sets = texts.where("doc_id is null").select("text").mapInArrow(every, "name binary, codes binary")
        found = found.unionByName(sets.join(F.broadcast(without) if few else without, "name").select("cls", "codes"))
    return found.dropDuplicates(["cls"])


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of `links` (a, b) can reach.

    A round takes the least label among a node and its neighbours, then follows
    labels once, so long chains shrink geometrically.
    """
    edges = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        after = staged(salted_join(lower, jump, "new", "node").select("node", "label", F.least("new", "far").alias("new")), "labels")
        changed = not after.where("new <> label").isEmpty()
        labels = after.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def registers_of(sketch: DataFrame, members: DataFrame) -> DataFrame:
    """(name, regs) of the classes of `members`; of the other rows of `sketch` a bounded filter lets few be shuffled."""
    names = members.select("name").distinct()
    return maybe_among(sketch.select("name", "regs"), names, names.count(), "name").groupBy("name").agg(F.first("regs").alias("regs"))


def _once(members: DataFrame, block: int) -> DataFrame:
    """(key, shards): the groups of `members`, but only the least key of those that have one shard and the same members (by 128 bits)."""
    rows, shingles = F.count("*"), F.sum("n_shingles")
    shards = F.greatest(F.ceil(rows / block), F.when(rows > 1, F.ceil(shingles / BLOCK_SHINGLES)))
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "cls")).alias(f"mark{i}") for i in (0, 1)]
    groups = members.groupBy("key").agg(rows.alias("n"), shards.alias("shards"), *marks)
    hot = F.when(F.col("shards") > 1, F.col("key")).alias("hot")
    return groups.groupBy("n", "mark0", "mark1", "shards", hot).agg(F.min("key").alias("key")).select("key", "shards")


def _dealt(members: DataFrame) -> DataFrame:
    """Members (key, cls, shards, label, regs) as rows of one group or shard each."""
    hot = F.col("shards") > 1
    shard = F.when(hot, F.pmod(F.xxhash64("cls", "key"), "shards"))
    return members.select(F.xxhash64("key", shard).alias("grp"), F.col("key").alias("band"), F.lit(False).alias("side"), hot.alias("every"), "label", "cls", "regs")


def _blocks_apart(members: DataFrame, block: int) -> DataFrame:
    """Members as rows of pairs of blocks, such that any two of different labels meet in one pair.

    A label of at least a block has blocks of its own; the others share theirs.
    Pairs of blocks of one large label are left out.
    """
    size = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    labels = members.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("n_shingles"), size.alias("own"))
    large = (F.col("n") >= block) | (F.col("n_shingles") >= BLOCK_SHINGLES)
    rest = labels.where(~large).groupBy("key").agg(F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("shared"))
    plan = labels.join(rest, "key", "left").select("key", "label", F.when(large, F.col("label")).alias("sole"), F.when(large, F.col("own")).otherwise(F.col("shared")).alias("blocks"))
    plan = staged(plan, "plan")
    at = F.pmod(F.xxhash64("cls", F.lit(-1)), "blocks")
    placed = salted_join(members.withColumn("name", F.xxhash64("key", "label")), plan.withColumn("name", F.xxhash64("key", "label")).drop("key", "label"), "name", "cls")
    placed = staged(placed.select("key", "cls", "label", "regs", F.xxhash64("sole", at).alias("own"), F.col("sole")), "blocks")
    blocks = placed.groupBy("key", "own").agg(F.first("sole").alias("sole"))
    other = blocks.select("key", F.col("own").alias("other"), F.col("sole").alias("other_sole"))
    meets = blocks.join(other, "key").where("sole is null or other_sole is null or sole <> other_sole").select("key", "own", "other")
    low, high = F.least("own", "other"), F.greatest("own", "other")
    met = placed.join(meets, ["key", "own"])
    return met.select(F.xxhash64("key", low, high).alias("grp"), F.col("key").alias("band"), (F.col("own") > F.col("other")).alias("side"), F.lit(False).alias("every"), "label", "cls", "regs")


def _links(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), staged: verified links between `members` of a group."""
    met = staged(partners(members), "met")
    wanted = staged(classes.join(met.select("cls").distinct(), "cls").select("cls", "name", "doc_id"), "wanted")
    return staged(forest(met.join(full_sets(docs, wanted), "cls")), "links")


def linked(docs: DataFrame, classes: DataFrame, members: DataFrame, sketch: DataFrame, block: int) -> DataFrame:
    """(node, label) of the classes that are linked with any other; `members` has key, cls, n_shingles."""
    members = staged(salted_join(members, _once(members, block), "key", "cls").join(classes.select("cls", "name"), "cls"), "sized")
    hot = members.where("shards > 1")
    few = Window.partitionBy("cls").orderBy(F.xxhash64("key"), "key")  # 32 rows at most
    some = hot.withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= HOT_GROUPS).drop("nth")
    first = members.where("shards = 1").unionByName(some)
    labels = components(_links(docs, classes, _dealt(first.withColumn("label", F.col("cls")).join(registers_of(sketch, first), "name"))))
    now = staged(hot.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls")), "labelled")
    several = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    rest = staged(salted_join(now, several, "key", "cls"), "open")
    if rest.isEmpty():
        return labels
    links = _links(docs, classes, _blocks_apart(rest.join(registers_of(sketch, rest), "name"), block))
    for end in ("a", "b"):
        names = labels.select(F.col("node").alias(end), F.col("label").alias("to"))
        links = links.join(names, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    more = components(links.where("a <> b")).select(F.col("node").alias("label"), F.col("label").alias("top"))
    joined = salted_join(labels, more, "label", "node", "left").select("node", F.coalesce("top", "label").alias("label"))
    new = more.select(F.col("label").alias("node"), F.col("top").alias("label")).join(labels, "node", "left_anti")
    return staged(joined.unionByName(new), "labels")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`.

    A null text counts as empty; texts without words are linked with nothing.
    Equal texts share a component, whatever their number; component_id is the
    least doc_id reachable. Rows that agree in doc_id and text come out alike; a
    null doc_id takes part but never names a component that has other ids (a
    row whose component has none is kept). No documents give no rows. Columns
    other than doc_id and text are not read.
    """
    sketch = staged(sketches(docs), "sketches")
    kept = [F.first(c).alias(c) for c in ("n_shingles", "bands")]
    named = sketch.where("n_shingles > 0").groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *kept)
    one = staged(named.withColumn("cls", F.monotonically_increasing_id()), "classes")  # a number stays once it is written
    classes = one.select("cls", "name", "doc_id", "copies")
    banded = one.select("cls", F.explode("bands").alias("key"))
    groups = banded.groupBy("key").count().where("count > 1").select("key")
    members = salted_join(banded, groups, "key", "cls").join(one.select("cls", "n_shingles"), "cls")
    labels = linked(docs, classes, members, sketch, block)
    # From the least class reachable to the least doc_id reachable.
    of = classes.join(labels.withColumnRenamed("node", "cls"), "cls").select("cls", "label", "doc_id")
    least = of.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = salted_join(of, least, "label", "cls").select("cls", "component_id")
    # Only classes of several rows or links differ from their own doc_id.
    differ = classes.join(named, "cls", "left").where("copies > 1 or component_id is not null").select("name", F.coalesce("component_id", "doc_id").alias("component_id"), F.lit(True).alias("joined"))
    out = salted_join(sketch.select("doc_id", "n_shingles", "name"), staged(differ, "named"), "name", "doc_id", how="left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("joined"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
i as (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as shingle from i),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 75 * (a.n + b.n - shared)),
u as (select x, y from e union all select y, x from e),
r as (select doc_id as x, doc_id as y from documents union select r.x, u.y from r join u on u.x = r.y),
c as (select x as doc_id, min(y) as component_id from r group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from c left join n using (doc_id)
"""
