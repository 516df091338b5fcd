"""SimHash near-duplicates: fingerprints of word shingles, linked by meet-in-the-middle ball hashing.

The query links fingerprints a few bits apart; the pipeline verifies the similarity of candidates.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, slices, stored
from .graph import components
from .learning import shared

_SEED = 42
_CHUNK = 1 << 16  # hashes whose bits are counted at a time


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """A bit is 1 if over half of the hashes of the word shingles (repeats included) have it."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z only, and white space as the contract has it
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    last = ends[shingle - 1 :] or ends[-1:]
    hashes = np.array([xxh64_intdigest(joined[a : b - 1], _SEED) for a, b in zip(starts, last)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, slice_bytes: int = 4 << 20) -> DataFrame:
    """``(id, fp BIGINT)``: the bits of the fingerprint as a signed number, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", slice_bytes):
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_numpy(zero_copy_only=False)
            found = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found)], names=["id", "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"id {id_type}, fp long").withColumnRenamed("id", id_col)


def ball_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """``(src, dst)``: links that join all of the distinct ``fps (fp)`` at most ``radius`` bits apart.

    Every fingerprint emits all its variants within half the radius. Fingerprints that meet on a
    variant lie within the radius of each other, so a link of each to the smallest among them joins
    them all; a variant is met by as many fingerprints at most as there are variants of one.
    """
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("the radius is 0, 2 or 4")
    masks = [sum(1 << b for b in bits) for n in range(radius // 2 + 1) for bits in combinations(range(64), n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    variants = fps.select("fp", F.explode(F.lit(signed)).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.withColumn("first", F.min("fp").over(Window.partitionBy("variant"))).where("first < fp")
    return met.select(F.col("first").alias("src"), F.col("fp").alias("dst")).distinct().where(F.bit_count(F.expr("src ^ dst")) <= radius)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row; the component's smallest id stands for it.

    Texts without words (null, empty, white space) have the fingerprint zero and are linked like
    others; repeated rows give a row each. A null id gets its component like others, but never
    names one (a component of null ids only is null). Other columns are not read.
    """
    marked = stored(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle).withColumnRenamed(id_col, "id"), "fingerprints")
    # Exact copies meet here: a group becomes one row before anything else is shuffled.
    each = marked.groupBy("fp").agg(F.min("id").alias("first_id"), F.count("*").alias("rows"))
    roots = components(ball_links(each.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = roots.join(each, "fp")
    named = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    shares = 16
    named = named.withColumn("share", F.explode(F.lit(list(range(shares)))))
    linked = linked.withColumn("share", F.pmod(F.xxhash64("fp"), F.lit(shares)).cast("int")).join(named, ["root", "share"])
    ids = each.join(linked.select("fp", "component_id"), "fp", "left").select("fp", "rows", F.coalesce("component_id", "first_id").alias("component_id"))
    # A third of all rows may share a fingerprint. Those that a ten-thousandth of all rows have are
    # ten thousand at most: these are broadcast, and the rows of all others are shuffled.
    ids = stored(ids, "ids")
    n_rows = ids.agg(F.sum("rows")).first()[0] or 0
    common = F.col("rows") >= max(2, n_rows // 10_000 + 1)
    hot = marked.join(F.broadcast(ids.where(common).drop("rows").withColumn("hot", F.lit(True))), "fp", "left")
    cold = hot.where("hot is null").select("id", "fp").join(ids.where(~common).drop("rows"), "fp")
    out = hot.where("hot").select("id", "fp", "component_id").union(cold.select("id", "fp", "component_id"))
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Bit blocks of the wide fingerprint, their bits, and the weakest bits that vary in each block's ball.
_BLOCKS, _BLOCK_BITS, _WEAK_BITS = 16, 32, 4
#: Counters of shingles by their hashes, which put a set's rare ones first, and the parts they are summed in.
_COUNTERS, _PARTS = 1 << 20, 64
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_SUBSETS = np.array([[m >> b & 1 for b in range(_WEAK_BITS)] for m in range(1 << _WEAK_BITS)], dtype=np.uint64)


def shingle_set(words: list[bytes], shingle: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of all word shingles; fewer words than a shingle are one."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    last = ends[shingle - 1 :] or ends[-1:]
    return np.unique(np.array([xxh64_intdigest(joined[a : b - 1], _SEED) for a, b in zip([0, *ends[:-1]], last)], dtype=np.uint64))


def block_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of the wide fingerprint of a set: for each bit block, the block and its ball.

    A block's ball holds it with every choice of its weakest bits flipped, those whose counts are
    nearest to a half: texts that differ in few shingles differ there first.
    """
    counts = np.zeros((_BLOCKS * _BLOCK_BITS // 8, 8))
    for lane in range(_BLOCKS * _BLOCK_BITS // 64):
        mixed = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (lane + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(32)
        at = mixed.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
        counts[lane * 8 : lane * 8 + 8] = np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    margins = (2 * counts - len(hashes)).reshape(_BLOCKS, _BLOCK_BITS)
    powers = np.uint64(1) << np.arange(_BLOCK_BITS, dtype=np.uint64)
    blocks = ((margins > 0) * powers).sum(axis=1, dtype=np.uint64)
    weak = powers[np.argsort(np.abs(margins), axis=1, kind="stable")[:, :_WEAK_BITS]]
    flips = weak @ _SUBSETS.T
    return ((blocks[:, None] ^ flips) | (np.arange(_BLOCKS, dtype=np.uint64) << np.uint64(_BLOCK_BITS))[:, None]).ravel().view(np.int64)


def _text_marks(docs: DataFrame, shingle: int, slice_bytes: int) -> DataFrame:
    """``(id, text_hash, node, size, keys)`` of ``docs (id, text, text_hash)``.

    Node is a hash of all words; the keys and the number of shingles go with its first row in a task.
    Rows without a node hold how often the task met shingles: counters by their hashes' last bits, in
    blocks that ``size`` numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        met = np.zeros(_COUNTERS, dtype=np.int64)
        batch = None
        for batch in slices(batches, "text", slice_bytes):
            nodes, sizes, keys = [], [], []
            for text in pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_numpy(zero_copy_only=False):
                words = text.lower().split()
                node = int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)
                found = shingle_set(words if node not in seen else [], shingle)
                keys.append(block_keys(found) if len(found) else [])
                met[(found % np.uint64(_COUNTERS)).astype(np.intp)] += 1
                sizes.append(len(found))
                seen.add(node)
                nodes.append(node)
            columns = [batch.column("id"), batch.column("text_hash"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "node", "size", "keys"])
        if batch is not None:
            blocks = pa.FixedSizeListArray.from_arrays(pa.array(met), _COUNTERS // _PARTS).cast(pa.list_(pa.int64()))
            columns = [pa.nulls(_PARTS, batch.column("id").type), pa.nulls(_PARTS, pa.int64()), pa.nulls(_PARTS, pa.int64()), pa.array(range(_PARTS), pa.int32()), blocks]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "node", "size", "keys"])

    return map_arrow(docs.select("id", "text", "text_hash"), run, f"id {docs.schema['id'].dataType.simpleString()}, text_hash long, node long, size int, keys array<long>")


def _text_sets(docs: DataFrame, shingle: int, slice_bytes: int) -> DataFrame:
    """``(node, shingles)`` of ``docs (text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", slice_bytes):
            nodes, sets = [], []
            for text in pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_numpy(zero_copy_only=False):
                words = text.lower().split()
                nodes.append(int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True))
                sets.append(shingle_set(words, shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return map_arrow(docs.select("text"), run, "node long, shingles array<long>")


def _levels(blocks: DataFrame) -> np.ndarray:
    """The logarithm of how often shingles come, by their hashes' last bits, from counters ``(size, keys)`` of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("size").to_pylist(), batch.column("keys")):
                sums[block] = sums.get(block, 0) + counts.values.to_numpy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.log2(x + 1).astype(np.uint8).tobytes() for x in sums.values()], pa.binary())], names=["size", "levels"])

    found = np.zeros(_COUNTERS, dtype=np.uint8)
    for r in map_arrow(blocks.repartition(_PARTS, "size"), run, "size int, levels binary").collect():  # a byte a counter
        found[r.size * (_COUNTERS // _PARTS) :][: _COUNTERS // _PARTS] = np.frombuffer(r.levels, np.uint8)
    return found


def least_shared(size: int, similarity: float) -> int:
    """Shingles that a set of ``size`` has in common at least with any that reaches the similarity."""
    return math.ceil(similarity * size - 1e-9)


def parities(hashes: np.ndarray) -> np.ndarray:
    """512 bits, each the parity of the number of hashes that fall on it: two sets differ in as many hashes at least as in bits."""
    at = ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)).astype(np.intp)
    return np.packbits((np.bincount(at, minlength=512) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _text_prefixes(docs: DataFrame, levels: np.ndarray, shingle: int, similarity: float, slice_bytes: int) -> DataFrame:
    """``(node, size, parity, prefix)`` of ``docs (text)``: of the shingles, rare ones first, so many that similar sets share one of them."""
    given = shared(docs.sparkSession, levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = given.value
        for batch in slices(batches, "text", slice_bytes):
            nodes, sizes, bits, prefixes = [], [], [], []
            for text in pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_numpy(zero_copy_only=False):
                words = text.lower().split()
                found = shingle_set(words, shingle)
                if not len(found):
                    continue
                nodes.append(int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True))
                sizes.append(len(found))
                bits.append(parities(found))
                order = np.argsort(level[(found % np.uint64(_COUNTERS)).astype(np.intp)], kind="stable")
                prefixes.append(found[order[: len(found) - least_shared(len(found), similarity) + 1]].view(np.int64))
            arrays = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "size", "parity", "prefix"])

    return map_arrow(docs.select("text"), run, "node long, size int, parity array<long>, prefix array<long>")


def _other_pairs(prefixes: DataFrame, roots: DataFrame, similarity: float, block: int = 1024) -> DataFrame:
    """``(src, dst)``: all nodes of different groups that share enough shingles of their prefixes and may be similar.

    Similar sets share one, so none is missed. Sizes that lie too far apart, parities that differ
    in too many bits and too few shared shingles leave a pair out: none can be so for similar sets.
    All prefixes have one order, so what two sets have in common lies at most as far back in either
    as it has shingles of its own: both prefixes hold all of it but that many. Long texts that share
    a passage alone go by this count. The texts of a shingle meet in blocks of about ``block``, so
    that no task has to pair all of a common one.
    """
    grouped = stored(prefixes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "prefixes")
    whole = Window.partitionBy("shingle")
    met = grouped.select("node", "root", F.explode("prefix").alias("shingle"))
    met = met.select("shingle", "node", F.min("root").over(whole).alias("low"), F.max("root").over(whole).alias("high"), F.count("*").over(whole).alias("n"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    met = met.where("low < high").select("shingle", "node", blocks.alias("of"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"))
    spare = (F.size("prefix") - F.col("size")).alias("spare")
    marks = grouped.select("node", F.struct("node", "root", "size", spare, *(F.col("parity")[i].alias(f"p{i}") for i in range(8))).alias("x"))
    met = stored(met.join(marks, "node").drop("node"), "met")
    a = met.select("shingle", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("of") - 1)).alias("j"), F.col("x").alias("a"))
    b = met.select("shingle", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("x").alias("b"))
    sizes = F.col("a.size") + F.col("b.size")
    bits = sum((F.bit_count(F.col(f"a.p{i}").bitwiseXOR(F.col(f"b.p{i}"))) for i in range(8)), F.lit(0))
    may = (F.least("a.size", "b.size") >= F.lit(similarity) * F.greatest("a.size", "b.size")) & (bits <= sizes * ((1 - similarity) / (1 + similarity)) + 1e-6)
    once = (a["i"] < a["j"]) | (F.col("a.node") < F.col("b.node"))
    pairs = a.join(b, (a["shingle"] == b["shingle"]) & (a["i"] == b["i"]) & (a["j"] == b["j"]) & once & (F.col("a.root") != F.col("b.root")) & may)
    # A pair meets once for each shingle that both prefixes hold.
    need = F.ceil(sizes * (similarity / (1 + similarity)) - 1e-6) + F.least("a.spare", "b.spare")
    pairs = pairs.select(F.least("a.node", "b.node").alias("src"), F.greatest("a.node", "b.node").alias("dst"), need.alias("need"))
    return pairs.groupBy("src", "dst", "need").agg(F.count("*").alias("n")).where("n >= need").select("src", "dst")


def _similar(pairs: DataFrame, each: DataFrame, rows: DataFrame, *, shingle: int, similarity: float, slice_bytes: int) -> DataFrame:
    """Those of the node ``pairs (src, dst)`` whose sets of shingles reach the Jaccard ``similarity``."""
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    wanted = each.join(ends, "node").select("first.id", "first.text_hash").distinct()
    sets = _text_sets(rows.join(wanted, ["id", "text_hash"], "left_semi"), shingle, slice_bytes)
    sets = stored(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "shingles")
    both = pairs.join(sets.select(F.col("node").alias("src"), F.col("shingles").alias("a")), "src").join(sets.select(F.col("node").alias("dst"), F.col("shingles").alias("b")), "dst")
    both = both.withColumn("common", F.size(F.array_intersect("a", "b")))
    return both.where(F.col("common") >= F.lit(similarity) * (F.size("a") + F.size("b") - F.col("common"))).select("src", "dst")


def keep_one_of_similar(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, slice_bytes: int = 1 << 20
) -> DataFrame:
    """One row of ``docs`` from each group that word shingles of a Jaccard ``similarity`` or more link.

    Texts that meet in the ball of a bit block of their wide fingerprints are candidates; a link is
    made only where the Jaccard similarity of the two sets of shingles reaches the bound. Each text
    is first compared with the likeliest of its partners, the smallest and the largest text of each
    of its keys: the one that it meets on most keys. Then each key brings two partners that no
    links lead to yet: the text with most links so far (without any: the largest) and the smallest
    one of the smallest group. Last, texts that are not yet of one group are compared by the prefixes
    of their sets, rare shingles first: similar sets share a shingle there, so every link between
    groups is found, and the groups are those of all links. A group keeps the row of its smallest
    id (of repeated ids the one with the smallest hash of its text; different texts that are not
    similar both stay). Texts without words (null, empty, white space) are equal; equal rows are
    one. Rows without an id can't be told apart and stay as they are. An empty table gives none;
    other columns are kept and not read.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    marks = stored(_text_marks(rows, shingle, slice_bytes), "marks")
    marked = marks.where("node is not null")
    each = stored(marked.groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("first"), F.max("size").alias("size")), "texts")
    # One shuffle of all keys; those that one text alone has go there. A text brings a key once (once
    # a task for copies); the rows of a common key meet in one window, which spills.
    by_key = Window.partitionBy("key")
    keyed = marked.select("node", F.explode("keys").alias("key"))
    common = stored(keyed.select("node", "key", F.min("node").over(by_key).alias("low"), F.max("node").over(by_key).alias("high")).where("low < high"), "common")
    met = common.select("node", F.explode(F.array("low", "high")).alias("other")).where("node <> other")
    met = met.groupBy(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst")).agg(F.count("*").alias("times"))
    best = F.max(F.struct("times", "src", "dst")).alias("pair")
    likely = met.select("src", "dst", "times", F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(best)
    likely = stored(likely.select("pair.src", "pair.dst").distinct(), "candidates")
    options = {"shingle": shingle, "similarity": similarity, "slice_bytes": slice_bytes}
    links = stored(_similar(likely, each, rows, **options), "links")
    degrees = links.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    grouped = components(links).join(degrees, "node")
    info = each.select("node", "size").join(grouped, "node", "left")
    info = info.select("node", F.struct("node", "size").alias("text"), F.coalesce("root", "node").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"))
    tagged = stored(common.select("key", "node").join(info, "node").drop("node"), "tagged")
    # Pivots by key and root first: of a large group the texts that meet pivots of their own only are
    # left out as one row a key, before any of them is joined.
    per_root = tagged.groupBy("key", "root").agg(F.min("text").alias("first"), F.max(F.struct("degree", "text")).alias("most"))
    per_root = stored(per_root, "roots")
    pivots = per_root.groupBy("key").agg(F.min(F.struct("root", "first")).alias("low"), F.max(F.struct("most", "root")).alias("hub"), F.max("root").alias("last"))
    pivots = pivots.where("low.root < last").select(
        "key",
        F.array(
            F.struct(F.col("low.first").alias("other"), F.col("low.root").alias("of")),
            F.struct(F.col("hub.most.text").alias("other"), F.col("hub.root").alias("of")),
        ).alias("pivots"),
    )
    foreign = F.filter("pivots", lambda p: p["of"] != F.col("root"))
    asked = per_root.select("key", "root").join(pivots, "key").select("key", "root", foreign.alias("pivots")).where(F.size("pivots") > 0)
    # Sets whose sizes lie too far apart can't be similar.
    alike = F.least("text.size", "other.size") >= F.lit(similarity) * F.greatest("text.size", "other.size")
    pair = [F.least("text.node", "other.node").alias("src"), F.greatest("text.node", "other.node").alias("dst")]
    met = tagged.join(asked, ["key", "root"]).select("text", F.inline("pivots")).where(alike).select(*pair).distinct()
    rest = stored(met.join(likely, ["src", "dst"], "left_anti"), "candidates")
    links = stored(links.union(_similar(rest, each, rows, **options)), "links")
    firsts = rows.join(each.where("size > 0").select("first.id", "first.text_hash"), ["id", "text_hash"], "left_semi")
    prefixes = _text_prefixes(firsts, _levels(marks.where("node is null").select("size", "keys")), shingle, similarity, slice_bytes).dropDuplicates(["node"])
    last = stored(_other_pairs(prefixes, components(links), similarity), "candidates")
    roots = components(links.union(_similar(last, each, rows, **options)))
    group = each.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    kept = group.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"))
    mark = "text_hash"
    while mark in docs.columns:
        mark += "_"
    # Marked by the hash, so that equal rows meet where the join has put them.
    named = docs.withColumn(mark, F.xxhash64(text_col)).join(kept.select(F.col("kept_id").alias(id_col), F.col("kept_hash").alias(mark)), [id_col, mark], "left_semi")
    return named.dropDuplicates([id_col, mark]).select(*docs.columns).union(docs.where(F.col(id_col).isNull()))
