"""Sharding by balanced label propagation.

Documents are nodes, a link group is a set of documents that should share a shard. Each
round every group votes for the shard that already holds most of it, the driver solves a
shards x shards quota table (never data), and at most so many documents move along each
shard pair. A last round restores the exact sizes with documents whose move cuts nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import durable, gapless

GAIN_LEVELS = 16


def grant(demand: dict[tuple[int, int, int], int], sizes: list[int], free: list[int]) -> dict[tuple[int, int, int], int]:
    """Quotas by (from, to, gain level): a shard may grow only by what it can evict for nothing."""
    room = list(free)
    given: dict[tuple[int, int, int], int] = {}
    left = dict(demand)
    # swaps first: equal numbers in both directions change no size
    for (i, j, g) in sorted(left, key=lambda x: (-x[2], x[0], x[1])):
        if i >= j:
            continue
        for h in range(GAIN_LEVELS, -1, -1):
            n = min(left.get((i, j, g), 0), left.get((j, i, h), 0))
            if n:
                for k in ((i, j, g), (j, i, h)):
                    given[k] = given.get(k, 0) + n
                    left[k] -= n
    for (i, j, g) in sorted(left, key=lambda x: (-x[2], x[0], x[1])):
        n = min(left[i, j, g], max(0, room[j]))
        if n:
            given[i, j, g] = given.get((i, j, g), 0) + n
            room[j] -= n
            room[i] += n
    return given


def balanced_label_propagation(nodes: DataFrame, total: int, n_shards: int = 16, rounds: int = 24) -> DataFrame:
    """Assign ``nodes(uid, grp, ...)`` to shards whose row counts differ by at most one.

    ``uid`` is unique; documents with the same non-null ``grp`` are linked. Null groups and
    groups of one are free to go anywhere. Returns the input columns with ``shard`` and
    ``slot`` (0, 1, 2 ... within the shard). Rounds end when the rows away from their group's
    shard no longer become fewer by a fiftieth (or after ``rounds``).
    """
    many = nodes.where("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    state = nodes.join(many.select("grp", F.lit(True).alias("_linked")), "grp", "left").withColumn("_linked", F.coalesce("_linked", F.lit(False)))
    state = gapless(state.withColumn("_all", F.lit(0)), ["_all"], "uid", "_pos", total)
    state = durable(state.withColumn("shard", (F.col("_pos") % n_shards).cast("int")).drop("_all", "_pos"))
    want_size = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]

    away = float("inf")
    for _ in range(rounds):
        counted = {(r.shard, r._linked): r.n for r in state.groupBy("shard", "_linked").agg(F.count(F.lit(1)).alias("n")).collect()}
        sizes = [counted.get((s, True), 0) + counted.get((s, False), 0) for s in range(n_shards)]
        # what a shard can take in: the room below its size, and the free rows it can send off later
        free = [counted.get((s, False), 0) + want_size[s] - sizes[s] for s in range(n_shards)]
        held = state.where("_linked").groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n"))
        # ties go to shards by a hash, or all groups would want the same ones
        best = held.groupBy("grp").agg(F.max(F.struct("n", F.xxhash64("grp", "shard").alias("h"), "shard")).alias("b")).select("grp", F.col("b.shard").alias("_to"), F.col("b.n").alias("_top"))
        offers = held.join(best, "grp").where("shard <> _to").select("grp", "shard", "_to", F.least(F.floor(F.log2((F.col("_top") - F.col("n") + 1).cast("double"))), F.lit(GAIN_LEVELS)).cast("int").alias("_gain"), "n")
        demand = {(r.shard, r._to, r._gain): r.n for r in offers.groupBy("shard", "_to", "_gain").agg(F.sum("n").alias("n")).collect()}
        given = {k: n for k, n in grant(demand, sizes, free).items() if n}
        if not given or sum(demand.values()) > 0.98 * away:
            break
        away = sum(demand.values())
        session = state.sparkSession
        quota = session.createDataFrame([(*k, n) for k, n in given.items()], "shard int, _to int, _gain int, _quota long")
        movers = state.where("_linked").join(offers.drop("n"), ["grp", "shard"]).select("uid", "shard", "_to", "_gain")
        movers = gapless(movers, ["shard", "_to", "_gain"], "uid", "_rank", total).join(F.broadcast(quota), ["shard", "_to", "_gain"]).where("_rank < _quota")
        state = durable(state.join(movers.select("uid", "_to"), "uid", "left").withColumn("shard", F.coalesce("_to", "shard")).drop("_to"))

    return _level(state, total, n_shards, want_size)


def _level(state: DataFrame, total: int, n_shards: int, want: list[int]) -> DataFrame:
    """Move the surplus of full shards to the others, free rows first, and number the slots."""
    counted = {(r.shard, r._linked): r.n for r in state.groupBy("shard", "_linked").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [counted.get((s, True), 0) + counted.get((s, False), 0) for s in range(n_shards)]
    surplus = [[s, sizes[s] - want[s]] for s in range(n_shards) if sizes[s] > want[s]]
    lack = [[s, want[s] - sizes[s]] for s in range(n_shards) if sizes[s] < want[s]]
    flows, sent = [], dict.fromkeys(range(n_shards), 0)
    while surplus and lack:
        n = min(surplus[-1][1], lack[-1][1])
        s, t = surplus[-1][0], lack[-1][0]
        flows.append((s, sent[s], sent[s] + n, t))
        sent[s] += n
        for side in (surplus, lack):
            side[-1][1] -= n
            if not side[-1][1]:
                side.pop()
    if flows:
        ranked = gapless(state, ["shard", "_linked"], "uid", "_rank", total)
        lead = F.lit(0)
        for s in range(n_shards):
            lead = F.when(F.col("_linked") & (F.col("shard") == s), counted.get((s, False), 0)).otherwise(lead)
        ranked = ranked.withColumn("_rank", F.col("_rank") + lead)
        to = F.col("shard")
        for s, lo, hi, t in flows:
            to = F.when((F.col("shard") == s) & (F.col("_rank") >= lo) & (F.col("_rank") < hi), F.lit(t)).otherwise(to)
        state = durable(ranked.withColumn("shard", to).drop("_rank"))
    return gapless(state, ["shard"], "uid", "slot", total).drop("_linked")


def shard_documents(docs: DataFrame, n_shards: int = 16, rounds: int = 24) -> DataFrame:
    """Put every row of ``docs`` into a shard; documents with equal texts are linked.

    The law is ``rows``: shard counts are at most one apart, whatever the texts' sizes. A
    null text has size 1 (no bytes plus 1), the checksum of the empty text, and links with
    nothing; empty texts link with each other. Repeated rows and ids each get a slot of
    their own; an empty table gives an empty result; further columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    nodes = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.unhex(F.md5("text"))).alias("grp"),
    )
    nodes = durable(nodes)
    placed = balanced_label_propagation(nodes, nodes.count(), n_shards, rounds)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_links(placed: DataFrame, group: str) -> int:
    """Link groups' cut edges: shards each group touches beyond its first, summed."""
    per = placed.where(F.col(group).isNotNull()).groupBy(group).agg((F.countDistinct("shard") - 1).alias("c"))
    return per.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
