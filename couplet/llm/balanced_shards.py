"""Sharding by balanced label propagation.

Linked documents move round by round to the shard where most of their neighbours are, as far as the
shards have room: aggregates count the votes of every link, each document proposes its best shard, and
quotas per pair of shards accept the proposals, links in one order, until no document moves. Documents that nothing links fill the
gaps at the end, so row counts differ by at most one and no link is cut for the sake of balance
unless its shard is full.

A link with more documents than ``PART`` (or a quarter of a shard) is split into parts by id hash
first; there are few such links for a given number of rows, so only they are broadcast. Votes are
counts per (link, shard), never pairs of documents.

Nulls and edges: a null text has no bytes and links with nothing. Rows without an id are placed like
unlinked rows. Repeated rows are separate members. Fewer rows than shards leave shards empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from couplet.operators.shared import materialise

PART = 200_000
ROWS_PER_CELL = 50_000   # rows numbered within one window


def _numbered(rows: DataFrame, group: list[str], order: list[Column], cells: int) -> DataFrame:
    """Add ``number``: gapless from 0 per group, by hash cells so that no group fills one window."""
    cell = F.pmod(F.xxhash64(*order), F.lit(cells))
    rows = rows.withColumn("__cell", cell)
    counts = rows.groupBy(*group, "__cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(counts.select(*group, "__cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before")))
    within = Window.partitionBy(*group, "__cell").orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(within) - 1).join(offsets, [*group, "__cell"]) \
        .withColumn("number", F.col("__rank") + F.col("__before")).drop("__cell", "__rank", "__before")


def move_quotas(wishes: list[list[int]], free: list[int]) -> list[list[int]]:
    """How many of ``wishes[i][j]`` may move from shard i to j, given the ``free`` places of each shard.

    Departures make room for arrivals of the same round. Afterwards no shard that has room left, and
    no cycle of full shards, has wishes left over.
    """
    asked = np.array(wishes, dtype=np.int64)
    room, q = np.array(free, dtype=np.int64), asked.copy()
    np.fill_diagonal(q, 0)
    asked = q.copy()
    while True:                                # shrink what overfills a shard, evenly over where it comes from
        over = q.sum(axis=0) - q.sum(axis=1) - room
        j = int(over.argmax())
        if over[j] <= 0:
            break
        q[:, j] = q[:, j] * (q[:, j].sum() - over[j]) // q[:, j].sum()
    moved = True
    while moved:                               # fill places that rounding or later departures left
        moved = False
        for j in range(len(room)):
            for i in range(len(room)):
                more = min(asked[i, j] - q[i, j], room[j] + q[j].sum() - q[:, j].sum())
                if more > 0:
                    q[i, j] += more
                    moved = True
    while cycle := _cycle(asked - q):          # full shards swap
        more = min(asked[i, j] - q[i, j] for i, j in cycle)
        for i, j in cycle:
            q[i, j] += more
    return q.tolist()


def _cycle(left: np.ndarray) -> list[tuple[int, int]]:
    """Edges of some cycle of positive entries; empty if there is none."""
    done: set[int] = set()
    for start in range(len(left)):
        path, turns = [start], [iter(np.flatnonzero(left[start] > 0).tolist())]
        while path:
            j = next(turns[-1], None)
            if j is None:
                done.add(path.pop())
                turns.pop()
            elif j in path:
                ring = path[path.index(j):]
                return list(zip(ring, [*ring[1:], j]))
            elif j not in done:
                path.append(j)
                turns.append(iter(np.flatnonzero(left[j] > 0).tolist()))
    return []


def _gathered(units: DataFrame, free: list[int]) -> DataFrame:
    """Moves ``(home, shard, to, n, take)`` that bring cut links together in a shard with room for what it lacks."""
    room = F.array(*[F.lit(x) for x in free])
    total = units.groupBy("home").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    widest = F.lit(free.index(max(free)))                  # of the shards without a member only this one counts
    options = units.select("home", F.col("shard").alias("to"), F.col("n").alias("held")) \
        .unionByName(total.select("home", widest.alias("to"), F.lit(0).cast("long").alias("held"))) \
        .groupBy("home", "to").agg(F.max("held").alias("held")).join(total, "home") \
        .withColumn("lacks", F.col("total") - F.col("held")).where(F.col("lacks") <= room[F.col("to")])
    best = options.groupBy("home").agg(F.max(F.struct("held", F.xxhash64("home", "to").alias("turn"), "to", "lacks")).alias("w")) \
        .select("home", "w.to", "w.lacks")
    upto = Window.partitionBy("to").orderBy("lacks", F.xxhash64("home"), "home")   # smallest first: none that fits is passed over
    fits = best.withColumn("sum", F.sum("lacks").over(upto)).where(F.col("sum") <= room[F.col("to")])
    return materialise(units.join(fits.select("home", "to"), "home").where(F.col("shard") != F.col("to"))
                       .select("home", "shard", "to", "n", F.col("n").alias("take")))


def propagate(members: DataFrame, shards: int, capacity: int, rounds: int | None = None) -> DataFrame:
    """``(node, shard)`` of the nodes of ``members (node, link)`` when no node moves any more.

    Nodes start at a hash of their id and move to the shard that most members of their links are in,
    while it holds fewer than ``capacity`` nodes or others leave it in the same round. When none can,
    links that are cut move as a whole to where they fit, and at last nodes to the best shard that has
    room. ``rounds`` ends this earlier.
    """
    # Nodes with the same links vote alike, so votes and wishes are counts per (set of links, shard).
    sets = members.groupBy("node").agg(F.sort_array(F.collect_set("link")).alias("links"))
    home = materialise(sets.withColumn("home", F.when(F.size("links") == 1, F.col("links")[0]).otherwise(F.xxhash64("links")))
                       .withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")))
    several = bool(home.where(F.size("links") > 1).limit(1).count())
    of = materialise(home.where(F.size("links") > 1).select("home", F.explode("links").alias("link")).distinct()) if several else None
    before, last, score, done = None, home.select("node", "home", "shard"), -1, 0
    while rounds is None or done < rounds:
        state, done = last, done + 1
        units = materialise(state.groupBy("home", "shard").agg(F.count(F.lit(1)).alias("n")))
        votes = units
        if several:
            # Every set of links meets the counts of each of its links; a set of one link is that link.
            links = of.unionByName(units.join(of, "home", "left_anti").select("home", F.col("home").alias("link")).distinct())
            tally = materialise(units.join(links, "home").groupBy("link", "shard").agg(F.sum("n").alias("n")))
            now = tally.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
            if now <= score and before is not None:            # nodes of several links can swing; the last gain stays
                last = before
                break
            before, score = state, now
            votes = materialise(links.join(tally, "link").groupBy("home", "shard").agg(F.sum("n").alias("n")))
        load = {r["shard"]: r["n"] for r in units.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        free = [max(0, capacity - load.get(s, 0)) for s in range(shards)]      # one number per shard
        room = F.array(*[F.lit(x) for x in free])
        # Ties go to the shard that comes first for the whole link, else pairs would swap places for ever.
        rated = votes.select("home", "shard", F.struct("n", F.xxhash64("home", "shard").alias("turn"), "shard").alias("vote"))
        granted = None
        for target in (rated, None, rated.where(room[F.col("shard")] > 0)):
            if target is None:
                granted = _gathered(units, free)
                if granted.limit(1).count():
                    break
                granted = None
                continue
            best = target.groupBy("home").agg(F.max("vote").alias("best"))
            wish = materialise(units.join(rated, ["home", "shard"]).join(best, "home").where("best > vote")
                               .select("home", "shard", F.col("best.shard").alias("to"), "n"))
            asked = [[0] * shards for _ in range(shards)]
            for r in wish.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect():   # one number per pair of shards
                asked[r["shard"]][r["to"]] = r["n"]
            if target is rated and not any(map(any, asked)):       # every node is where it wants to be
                break
            quota = move_quotas(asked, free)
            if any(map(any, quota)):
                # Links in one order everywhere, so that the first move whole; the last one of a pair of shards in part.
                order = Window.partitionBy("shard", "to").orderBy(F.xxhash64("home"), "home")
                allowed = F.array(*[F.array(*[F.lit(x) for x in row]) for row in quota])[F.col("shard")][F.col("to")]
                ahead = F.sum("n").over(order) - F.col("n")
                granted = wish.select("home", "shard", "to", "n", F.least("n", allowed - ahead).alias("take")).where("take > 0")
                break
        if granted is None:
            break
        granted = materialise(granted)
        whole = state.join(granted.where("take = n"), ["home", "shard"]).select("node", F.col("to").alias("moved"))
        rank = F.row_number().over(Window.partitionBy("home", "shard").orderBy(F.xxhash64("node"), "node"))
        cut = state.join(granted.where("take < n"), ["home", "shard"]).withColumn("rank", rank).where("rank <= take") \
            .select("node", F.col("to").alias("moved"))         # at most one set of links per pair of shards
        last = materialise(state.join(whole.unionByName(cut), "node", "left").select(
            "node", "home", F.coalesce("moved", "shard").alias("shard")))
    return last.select("node", "shard")


def balanced_shards(docs: DataFrame, shards: int = 40, id: str = "doc_id", text: str = "text",
                    rounds: int | None = None, part: int = PART) -> DataFrame:
    """``(id, size, text_crc32, link_size, shard, slot)``; equal texts are linked.

    ``slot`` numbers the rows of a shard from 0 without gaps; row counts differ by at most one.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = materialise(docs.select(
        F.col(f"`{id}`").alias("id"), (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.when(F.col(f"`{text}`").isNotNull() & F.col(f"`{id}`").isNotNull(), F.xxhash64(body)).alias("link")))
    total = rows.count()
    capacity, rest = divmod(total, shards)

    limit = max(1, min(part, capacity // 4))
    groups = materialise(rows.where("link is not null").groupBy("link").agg(F.count(F.lit(1)).alias("link_size"))
                         .where("link_size > 1"))
    large = groups.where(F.col("link_size") > limit)              # at most total / limit rows of 16 bytes
    small = groups.where(F.col("link_size") <= limit)
    parts = F.ceil(F.col("big") / F.lit(limit))
    split = rows.join(F.broadcast(large.withColumnRenamed("link_size", "big")), "link", "left").withColumn(
        "link", F.when(F.col("big").isNotNull(), F.xxhash64("link", F.pmod(F.xxhash64("id"), parts))).otherwise(F.col("link")))
    known = split.join(small, "link", "left").withColumn("link_size", F.coalesce("big", "link_size"))
    linked = materialise(known.select("id", "size", "text_crc32", "link", F.coalesce("link_size", F.lit(1)).alias("link_size")))
    members = linked.where("link_size > 1").select(F.col("id").alias("node"), "link").distinct()
    at = propagate(materialise(members), shards, capacity, rounds) if capacity else None
    placed = linked.withColumn("shard", F.lit(None).cast("int")) if at is None else \
        linked.join(at.withColumnRenamed("node", "id"), "id", "left")

    # Linked rows keep their shard up to its quota; all other rows fill what is left, in hash order.
    quota = [capacity + (s < rest) for s in range(shards)]
    wanted = F.array(*[F.lit(q) for q in quota])
    cells = max(1, -(-total // (shards * ROWS_PER_CELL)))
    order = [F.xxhash64("link"), F.xxhash64("id", "text_crc32", "size"), F.col("id")]
    placed = materialise(placed)
    numbered = _numbered(placed.where("shard is not null"), ["shard"], order, cells)
    numbered = materialise(numbered)
    stay = numbered.where(F.col("number") < wanted[F.col("shard")])
    spill = numbered.where(F.col("number") >= wanted[F.col("shard")]).drop("number", "shard")
    held = {r["shard"]: r["n"] for r in stay.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, first = [], 0
    for s in range(shards):
        starts.append(first)
        first += quota[s] - held.get(s, 0)
    pool = spill.unionByName(placed.where("shard is null").drop("shard"))
    order = [F.xxhash64("id", "text_crc32", "size"), F.col("id")]
    pool = _numbered(pool, [], order, max(1, -(-total // ROWS_PER_CELL))) if total else pool.withColumn("number", F.lit(0).cast("long"))
    open_at = F.array(*[F.lit(x) for x in starts])
    target = F.lit(0)
    for s in range(1, shards):                                     # shards borders, the last one that is not above
        target = F.when((F.col("number") >= starts[s]) & F.lit(quota[s] > held.get(s, 0)), F.lit(s)).otherwise(target)
    kept = F.array(*[F.lit(held.get(s, 0)) for s in range(shards)])
    filled = pool.withColumn("shard", target.cast("int")).withColumn(
        "slot", F.col("number") - open_at[F.col("shard")] + kept[F.col("shard")])
    columns = [F.col("id").alias(id), "size", "text_crc32", "link_size", F.col("shard").cast("int").alias("shard")]
    return stay.select(*columns, F.col("number").cast("long").alias("slot")) \
        .unionByName(filled.select(*columns, F.col("slot").cast("long").alias("slot")))
