"""Sharding by balanced label propagation, in DataFrame operations only.

Documents that share a link key (equal texts, unless another key is given) are linked. The
documents of a key are first summed up by a hash of their id, so a key that holds a third of all
rows is a bounded number of weighted nodes and never one group. Rounds of joins move nodes to the
shard where most of their key lies, under quotas that no shard's capacity is passed by. In the end
every shard holds its exact number of rows: linked documents stay up to the capacity, documents
without links (and what linked ones there are beyond it) fill the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Quotas are granted by buckets of nodes; so many for each shard.
_BUCKETS = 1024


def _choose(index: Column, values: list[int]) -> Column:
    """``values[index]`` for a short list."""
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), index.cast("int") + 1)


def _most_whole(n: int, shards: int) -> int:
    """Keys up to this weight move as a whole."""
    return max(32, n // (64 * shards))


def _propagated(nodes: DataFrame, capacity: list[int], rounds: int) -> DataFrame:
    """``nodes (key, part, weight, of_key, shard)`` after rounds of moves towards their key's shards."""
    shards = len(capacity)
    most_whole = _most_whole(sum(capacity), shards)
    full = [0] * shards  # of each shard, the room that was too small for any bucket
    for turn in range(rounds):
        load = dict(nodes.groupBy("shard").agg(F.sum("weight")).collect())  # a number for each shard
        # An eighth beyond the capacity may pass through, so that full shards can exchange; the last ranking evens it out.
        room = [max(0, capacity[s] + capacity[s] // 8 - (load.get(s) or 0)) for s in range(shards)]
        room = [0 if r <= full[s] else r for s, r in enumerate(room)]
        by_key = Window.partitionBy("key")
        here = F.sum("weight").over(Window.partitionBy("key", "shard"))
        lean = nodes.withColumn("lean", F.struct(here.alias("weight"), F.xxhash64("key", "shard").alias("tie"), "shard"))
        lean = lean.withColumn("best", F.max(F.when(_choose(F.col("shard"), room) > 0, F.col("lean"))).over(by_key))
        moving = F.col("best").isNotNull() & (F.col("best") > F.col("lean"))
        bucket = F.pmod(F.when(F.col("of_key") <= most_whole, F.xxhash64("key", F.lit(turn))).otherwise(F.xxhash64("key", "part", F.lit(turn))), F.lit(_BUCKETS))
        lean = lean.withColumn("target", F.when(moving, F.col("best.shard"))).withColumn("bucket", F.when(moving, bucket.cast("int"))).drop("lean", "best")
        lean = stored(lean, "leaning")
        wanted = lean.where("target is not null").groupBy("target", "bucket").agg(F.sum("weight").alias("wanted"))
        taken = F.sum("wanted").over(Window.partitionBy("target").orderBy("bucket"))
        granted = wanted.withColumn("granted", taken <= _choose(F.col("target"), room))
        granted = stored(granted.select("target", "bucket", "granted"), "granted")
        some = dict(granted.groupBy("target").agg(F.bool_or("granted")).collect())  # a flag for each shard
        if not some:
            break
        full = [room[s] if some.get(s) is False else full[s] for s in range(shards)]
        # At most shards * _BUCKETS rows, whatever the input's size.
        moved = lean.join(F.broadcast(granted), ["target", "bucket"], "left")
        nodes = moved.select("key", "part", "weight", "of_key", F.when(F.col("granted"), F.col("target")).otherwise(F.col("shard")).alias("shard"))
        nodes = stored(nodes, "nodes")
    return nodes


def balanced_shards(
    docs: DataFrame,
    shards: int = 8,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    link_key: Column | None = None,
    rounds: int = 30,
    parts: int = 64,
    bucket_rows: int = 20_000,
) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)``: law ``rows``, counts at most one apart.

    Documents with the same ``link_key`` (default: equal texts; null and empty texts are equal)
    share a shard: a key of up to a 64th of a shard's rows (or 32) begins and moves as a whole, a larger one in
    up to ``parts`` parts. Where a shard is over its count, linked documents leave it key by key, so
    that of the keys of up to ``bucket_rows`` rows only those at the ends of shards are cut. Size is the UTF-8 length plus 1 (null: 1);
    ``slot`` numbers a shard's rows from 0 without gaps. Repeated rows and null ids are rows like
    others; an empty table gives none. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.sha2(text, 256)) if link_key is None else link_key
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        key.alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "row"), F.lit(parts)).cast("int"))
    rows = stored(rows, "rows")
    nodes = rows.groupBy("key", "part").agg(F.count("*").alias("weight"))
    nodes = stored(nodes.withColumn("of_key", F.sum("weight").over(Window.partitionBy("key"))), "nodes")
    n = nodes.agg(F.sum("weight")).first()[0] or 0
    # What moves as a whole begins in one shard.
    whole = F.col("of_key") <= _most_whole(n, shards)
    nodes = nodes.withColumn("shard", F.pmod(F.when(whole, F.xxhash64("key")).otherwise(F.xxhash64("key", "part")), F.lit(shards)).cast("int"))
    capacity = [n // shards + (s < n % shards) for s in range(shards)]
    placed = _propagated(nodes.where("of_key > 1 and key is not null"), capacity, rounds).select("key", "part", "of_key", F.col("shard").alias("home"))

    # Ranks within a home come in two steps, by buckets of bounded size; home ``shards`` is the pool of the unlinked.
    # The rows of a key lie in one bucket, one after the other, unless they would fill it.
    n_buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // bucket_rows))
    homed = rows.join(placed, ["key", "part"], "left").withColumn("home", F.coalesce("home", F.lit(shards)))
    together = F.col("of_key") <= bucket_rows
    homed = homed.withColumn("group", F.when(together, F.xxhash64("key"))).withColumn("bucket", F.coalesce("group", F.xxhash64("row")))
    homed = homed.withColumn("bucket", F.pmod("bucket", F.lit(n_buckets)).cast("int")).drop("key", "part", "of_key")
    homed = stored(homed, "homed")
    sizes = homed.groupBy("home", "bucket").agg(F.count("*").alias("rows"))
    total = dict(sizes.groupBy("home").agg(F.sum("rows")).collect())  # a number for each home
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("home").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("before", before).drop("rows")
    within = F.row_number().over(Window.partitionBy("home", "bucket").orderBy("group", "id", "text_crc32", "size", "row"))
    ranked = homed.withColumn("within", within).join(offsets, ["home", "bucket"]).withColumn("rank", F.col("before") + F.col("within") - 1)

    stay = [min(total.get(s) or 0, capacity[s]) for s in range(shards)]
    over, beyond = total.get(shards) or 0, []
    for s in range(shards):  # places in the pool: the unlinked first, then what each home has beyond its capacity
        beyond.append(over - stay[s])
        over += (total.get(s) or 0) - stay[s]
    pool = F.when(F.col("home") == shards, F.col("rank")).when(F.col("rank") >= _choose(F.col("home"), [*stay, 0]), F.col("rank") + _choose(F.col("home"), [*beyond, 0]))
    ranked = ranked.withColumn("pool", pool)
    shard, slot, start = F.col("home"), F.col("rank"), 0
    for s in range(shards):
        fits = (F.col("pool") >= start) & (F.col("pool") < start + capacity[s] - stay[s])
        shard = F.when(fits, F.lit(s)).otherwise(shard)
        slot = F.when(fits, F.col("pool") - start + stay[s]).otherwise(slot)
        start += capacity[s] - stay[s]
    return ranked.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
