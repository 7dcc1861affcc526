"""Operator 12, sharding by balanced label propagation.

Documents are linked through groups they share (by default those of equal texts), so a group of n has n links to its hub
and not n * n among its members. In each round a group's hub takes the label of the shard that could gather most of its
members, given the room that shards have; members elsewhere ask to move there, and quotas between every two shards let in
no more than there is room for, those that gain most first. Documents without links have no wish and fill what is left, so
all shards end with the same number of rows, at most one apart. A group larger than a shard has as many home shards as it
needs. What a round joins are the linked documents with their groups' counts by shard; the driver sees shards by shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.common import TABLES, cut, discard, meet, numbered, stored

#: Rounds at most; a round that scatters groups more than the one before is the last and isn't kept.
ROUNDS = 12


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard."""
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def flows(wanted: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many may move from shard i to shard j of the wanted[c, i, j] that ask for it with gains of class c.

    Higher classes come first. What two shards exchange takes no room; of the rest each shard takes what it has room for,
    the largest flows first.
    """
    allowed, room = np.zeros_like(wanted[0]), room.copy()
    for asked in wanted[::-1]:
        exchanged = np.minimum(asked, asked.T)
        allowed += exchanged
        rest = asked - exchanged
        for j in range(len(room)):
            for i in np.lexsort((np.arange(len(room)), -rest[:, j])).tolist():
                taken = min(room[j], rest[i, j])
                allowed[i, j] += taken
                room[j] -= taken
    return allowed


def pick(values: list[int], at: Column) -> Column:
    """values[at] for a short list."""
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), at.cast("int") + 1)


def homes(cells: DataFrame, room: list[int], capacity: int) -> DataFrame:
    """For each group of cells (group, shard, n): its size, its home shards, and for its shards the members there and how
    many the shard could gather.
    """
    own = Window.partitionBy("group")
    size = F.sum("n").over(own)
    gathers = F.col("n") + F.least(pick(room, F.col("shard")), F.col("size") - F.col("n"))
    ranked = cells.withColumn("size", size).withColumn("gathers", gathers)
    ranked = ranked.withColumn("place", F.row_number().over(own.orderBy(F.desc("gathers"), F.desc("n"), F.xxhash64("group", "shard"))))
    home = F.when(F.col("place") <= F.ceil(F.col("size") / capacity), F.col("shard"))
    counts = F.map_from_entries(F.collect_list(F.struct("shard", F.struct("n", "gathers")))).alias("counts")
    return ranked.groupBy("group").agg(F.max("size").alias("size"), F.collect_list(home).alias("homes"), counts)


def movers(state: DataFrame, groups: DataFrame, members: int, turn: int) -> DataFrame:
    """node, shard, to, gain, group for the nodes of state (node, group, shard) that would rather be with their neighbours."""
    rows = meet(state, groups, "group", "size", members)
    home = F.element_at("homes", (F.pmod(F.xxhash64("node", F.lit(turn)), F.size("homes").cast("long")) + 1).cast("int"))
    to = F.when(F.array_contains("homes", F.col("shard")), F.col("shard")).otherwise(home)
    at = lambda shard, what: F.element_at("counts", F.col(shard))[what]
    votes = rows.withColumn("to", to).select("node", "group", "shard", "to", at("to", "n").alias("to_n"), at("to", "gathers").alias("to_gathers"), (at("shard", "n") - 1).alias("own_n"), at("shard", "gathers").alias("own_gathers"))
    sums = votes.groupBy("node", "shard", "to").agg(*[F.sum(c).alias(c) for c in ("to_n", "to_gathers", "own_n", "own_gathers")], F.min("group").alias("group"))
    own = Window.partitionBy("node")
    gain = F.greatest(F.col("to_n") - F.sum("own_n").over(own), F.col("to_gathers") - F.sum("own_gathers").over(own))
    options = sums.withColumn("gain", gain).filter((F.col("to") != F.col("shard")) & (F.col("gain") > 0))
    best = F.row_number().over(own.orderBy(F.desc("gain"), "to"))
    return options.withColumn("best", best).filter("best = 1").select("node", "shard", "to", "gain", "group")


def settled(state: DataFrame, limit: list[int], rounds: int) -> DataFrame:
    """state (node, group, shard), after rounds of label propagation; no shard ever holds more nodes than its limit."""
    shards, capacity, members, before = len(limit), max(1, *limit), state.count(), None
    for turn in range(rounds + 1):
        held = np.zeros(shards, np.int64)
        for shard, n in state.groupBy("shard").agg(F.count_distinct("node").alias("n")).collect():
            held[shard] = n
        room = np.array(limit) - held
        cells = cut(state.groupBy("group", "shard").agg(F.count("*").alias("n")))
        # members that aren't in their group's largest shards, of as many as it needs
        ranked = cells.withColumn("size", F.sum("n").over(Window.partitionBy("group"))).withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"))))
        scattered = ranked.filter(F.col("place") > F.ceil(F.col("size") / capacity)).agg(F.sum("n")).first()[0] or 0
        if before is not None and scattered >= before[0]:
            return before[1]
        if scattered == 0 or turn == rounds:
            return state
        before = scattered, state
        moving = stored(movers(state, cut(homes(cells, room.tolist(), capacity)), members, turn))
        wanted = np.zeros((64, shards, shards), np.int64)
        for i, j, gain, n in moving.groupBy("shard", "to", F.floor(F.log2("gain")).cast("int")).agg(F.count("*")).collect():
            wanted[gain, i, j] = n
        allowed = flows(wanted, room)
        most = pick(allowed.ravel().tolist(), F.col("shard") * shards + F.col("to"))
        whole = pick((allowed == wanted.sum(0)).ravel().tolist(), F.col("shard") * shards + F.col("to")) == 1
        some = numbered(stored(moving.filter(~whole)), ["shard", "to"], [F.desc("gain"), "group", "node"], "place").filter(F.col("place") < most)
        moved = moving.filter(whole).select("node", "to").unionByName(some.select("node", "to"))
        state = stored(state.join(moved, "node", "left").select("node", "group", F.coalesce("to", "shard").alias("shard")))
    return state


def sharded(docs: DataFrame, shards: int = 40, links: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, size (bytes of the text, and 16), text_crc32, law ('rows': shards differ by one row
    at most), shard, slot (from 0 in each shard, without gaps), grown_shard (null under this law).

    links (doc_id, group) says which documents belong together: those of a group go to one shard where the quotas let them. A
    document may have several groups; it follows those that draw it most, so chains of groups may break. Without it, documents of equal texts are linked. Null and empty texts are equal
    and have no bytes. Rows that repeat a doc_id, and rows without one, are rows of their own (without one, links don't reach
    them). With fewer rows than shards, the last shards are empty; an empty table gives no row. Other columns are ignored.
    """
    spark, done = docs.sparkSession, len(TABLES)
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("group"))
    base = stored(base.withColumn("node", F.monotonically_increasing_id()))
    rows = base.count()
    if links is None:
        pairs = base.select("node", "group")
    else:
        pairs = base.select("node", "doc_id").join(links.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("group").alias("group")), "doc_id").select("node", "group").distinct()
    several = cut(pairs.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1"))
    members = stored(meet(pairs, several, "group", "n", rows).select("node", "group"))
    limit = quotas(rows, shards)
    nodes = numbered(stored(members.select("node").distinct()), [], [F.xxhash64("node"), "node"], "place")
    first = stored(members.join(nodes.select("node", F.pmod("place", F.lit(shards)).cast("int").alias("shard")), "node"))
    state = settled(first, limit, rounds)
    linked = stored(base.join(state.select("node", "shard").distinct(), "node").select("doc_id", "size", "text_crc32", "shard", "node"))
    rest = stored(base.join(members.select("node").distinct(), "node", "left_anti"))
    # the rest fills the shards one after the other, behind what they hold
    held = dict(linked.groupBy("shard").count().collect())
    ends = np.cumsum([n - held.get(k, 0) for k, n in enumerate(limit)]).tolist()
    rest = numbered(rest, [], ["doc_id", "node"], "place").withColumn("shard", F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("place"))))
    rest = rest.withColumn("slot", F.col("place") + pick([held.get(k, 0) - (ends[k - 1] if k else 0) for k in range(shards)], F.col("shard")))
    placed = numbered(linked, ["shard"], ["doc_id", "node"], "slot")
    columns = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    out = stored(placed.select(*columns).unionByName(rest.select(*columns)))
    discard(spark, TABLES[done:-1])
    return out
