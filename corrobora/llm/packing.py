"""Containers of fixed capacity filled with texts by a grouping genetic algorithm.

A solution is a list of containers. Crossover injects well-filled containers of one parent into the other, takes out
the other's containers that hold a document twice, and brings the displaced documents back: containers still open
exchange items for displaced ones that fill them better, the rest goes in by best fit. Documents are dealt to shards by
hash, bounded in containers and in items whatever the sources; every shard is solved by several islands, each a task
with its own population. Between epochs the best solution of an island migrates to the next one. What lies in badly
filled containers of all shards is dealt and solved once more, so that a shard's last container costs nothing.

Texts much smaller than a container are first joined to bundles of at most an eighth of it, which are packed as one
item, so that a shard of so many items still fills many containers.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut

ISLANDS, EPOCHS, POPULATION, GENERATIONS = 3, 3, 4, 8
#: Islands to a task, once there are enough for all cores.
TASK_ISLANDS = 16
#: A shard holds about so many containers and items at most.
SHARD_CONTAINERS, SHARD_ITEMS = 800, 4000
#: Texts of less than this share of a container are bundled, at most MEMBERS to a bundle; so many lie in a bucket.
SMALL, MEMBERS, BUCKET = 16, 256, 4000
#: Containers with more than this share of room are dissolved for the second pass.
OPEN = 0.02
MOST_CAPACITIES = 1000


def best_fit(items, sizes, bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Puts the items, in order, each into the fullest container that takes it, or into a new one."""
    at: dict[int, list[int]] = {}
    for b, r in enumerate(room):
        if r > 0:
            at.setdefault(r, []).append(b)
    levels = sorted(at)
    for it in items:
        s = sizes[it]
        k = bisect_left(levels, s)
        if k < len(levels):
            r = levels[k]
            b = at[r].pop()
            if not at[r]:
                del at[r], levels[k]
            bins[b].append(it)
            room[b] = r = r - s
        else:
            b, r = len(bins), capacity - s
            bins.append([it])
            room.append(r)
        if r > 0:
            if r in at:
                at[r].append(b)
            else:
                at[r] = [b]
                insort(levels, r)


def _fitness(room: list[int], capacity: int) -> tuple[int, float]:
    """Fewer containers first, then uneven filling: the emptier the last ones, the nearer they are to going."""
    fill = 1 - np.array(room, float) / capacity
    return -len(room), float((fill * fill).sum())


def exchange(displaced: list[int], sizes: list[int], bins: list[list[int]], room: list[int]) -> list[int]:
    """Lets every open container, the fullest first, give one or two of its items for the displaced one that fills it
    best, as long as one does. Returns what is displaced then, largest first."""
    free = sorted((sizes[i], i) for i in displaced)
    for b in sorted((b for b, r in enumerate(room) if r > 0), key=room.__getitem__):
        while room[b] > 0 and free:
            own, gain, deal = bins[b], 0, None
            for away in [(i,) for i in own] + [(i, j) for n, i in enumerate(own) for j in own[:n] if len(own) <= FEW_ITEMS]:
                given = sum(sizes[i] for i in away)
                at = bisect_right(free, (given + room[b], len(sizes))) - 1
                if at >= 0 and free[at][0] - given > gain:
                    gain, deal = free[at][0] - given, (away, at)
            if deal is None:
                break
            bins[b] = [i for i in own if i not in deal[0]] + [free.pop(deal[1])[1]]
            room[b] -= gain
            for i in deal[0]:
                insort(free, (sizes[i], i))
    return [i for _, i in reversed(free)]


#: Containers of more items than this take no part in exchanges of two items.
FEW_ITEMS = 8


def fewest(sizes: list[int], capacity: int) -> int:
    """A number of containers no solution can do without: the sum of sizes, or, for every small size k, items over half
    a container take one each, and those of at least k must fit beside the ones they fit beside at all."""
    s = np.sort(np.array(sizes, np.int64))[::-1]
    total = np.concatenate(([0], np.cumsum(s)))
    least = -(-int(total[-1]) // capacity)
    k = np.unique(s[(s > 0) & (s <= capacity // 2)])
    alone, large, some = (np.searchsorted(-s, x, side) for x, side in ((-(capacity - k), "left"), (-(capacity // 2), "left"), (-k, "right")))
    over = (total[some] - total[large]) - ((large - alone) * capacity - (total[large] - total[alone]))
    return max([least, int((s > capacity // 2).sum()), *(large + np.maximum(0, -(-over // capacity))).tolist()])


def crossover(one, two, sizes: list[int], capacity: int, rng: np.random.Generator):
    """A child: the better-filled containers of `one`, then what can stay of `two`, then the displaced by best fit."""
    bins1, room1 = one
    bins2, room2 = two
    edge = np.quantile(room1, rng.uniform(0.3, 0.7)) if room1 else 0
    chosen = [b for b, r in enumerate(room1) if r <= edge and rng.random() < 0.9]
    placed = bytearray(len(sizes))
    bins, room = [], []
    for b in chosen:
        bins.append(list(bins1[b]))
        room.append(room1[b])
        for it in bins1[b]:
            placed[it] = 1
    displaced = []
    worst = np.quantile(room2, 0.9) if room2 else 0
    for b, r in zip(bins2, room2):
        twice = any(placed[it] for it in b)
        if twice or r > worst or r > 0 and rng.random() < 0.1:  # a few others are opened, as mutation
            displaced.extend(it for it in b if not placed[it])
        else:
            bins.append(list(b))
            room.append(r)
    best_fit(exchange(displaced, sizes, bins, room), sizes, bins, room, capacity)
    return bins, room


def evolve(sizes: list[int], capacity: int, seeds: list, seed: int, population: int = POPULATION, generations: int = GENERATIONS):
    """The best solution found: (containers as lists of item numbers, room left in each). Ends as soon as no solution can
    have fewer containers."""
    rng = np.random.default_rng(seed)
    least = max(1, fewest(sizes, capacity)) if sizes else 0
    people = [(s, _fitness(s[1], capacity)) for s in seeds]
    order = np.argsort(-np.array(sizes, float), kind="stable").tolist()
    while len(people) < (len(seeds) or population) and not any(f[0] == -least for _, f in people):
        bins: list[list[int]] = []
        room: list[int] = []
        best_fit(order, sizes, bins, room, capacity)
        people.append(((bins, room), _fitness(room, capacity)))
        order = np.argsort(-np.array(sizes) * rng.uniform(0.85, 1.15, len(sizes))).tolist()
    for _ in range(generations):
        people.sort(key=lambda p: p[1], reverse=True)
        if people[0][1][0] == -least:
            break
        a, b = (min(rng.integers(len(people), size=2)) for _ in range(2))
        if a == b:
            b = (a + 1) % len(people)
        child = crossover(people[a][0], people[b][0], sizes, capacity, rng)
        people.append((child, _fitness(child[1], capacity)))
        people.sort(key=lambda p: p[1], reverse=True)
        del people[population:]
    return max(people, key=lambda p: p[1])[0]


def run_islands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row is one island of a shard: its sizes and, after the first epoch, the assignments it starts from. Document
    ids and members stay outside."""
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            sizes, capacity, seeds = row.sizes.tolist(), int(row.capacity), []
            for of in row.seeds:
                bins: list[list[int]] = [[] for _ in range(int(of.max()) + 1)]
                for item, b in enumerate(of.tolist()):
                    bins[b].append(item)
                seeds.append((bins, [capacity - sum(sizes[i] for i in b) for b in bins]))
            bins, room = evolve(sizes, capacity, seeds, row.shard * 1009 + row.island * 31 + len(seeds))
            of, left = np.empty(len(sizes), np.int32), np.empty(len(sizes), np.int32)
            for b, items in enumerate(bins):
                of[items], left[items] = b, room[b]
            few, fit = _fitness(room, capacity)
            out.append((row.capacity_id, row.capacity, row.shard, row.island, of, left, few, fit, len(bins) == fewest(sizes, capacity)))
        yield pd.DataFrame(out, columns=["capacity_id", "capacity", "shard", "island", "bins", "rooms", "few", "fit", "done"])


def bundled(loose: DataFrame) -> DataFrame:
    """(capacity_id, capacity, doc_id, piece, size, members): pieces, and bundles of small ones under the id of their first member. Buckets
    and bundles are bounded, so that none meets whole in a task."""
    small = F.col("size") * SMALL < F.col("capacity")
    counted = loose.where(small).groupBy("capacity_id").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("buckets"))
    few = loose.where(small).join(counted, "capacity_id").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets")).cast("int"))
    # the running size of a bucket, every member with a little weight of its own, cut at equal steps
    ahead = F.sum(F.col("size") + F.col("capacity") / (SMALL * MEMBERS)).over(Window.partitionBy("capacity_id", "bucket").orderBy("doc_id", "piece"))
    few = few.withColumn("bundle", F.floor(ahead * SMALL / F.col("capacity")).cast("int"))
    made = few.groupBy("capacity_id", "capacity", "bucket", "bundle").agg(F.sort_array(F.collect_list(F.struct("doc_id", "piece", "size"))).alias("members"), F.sum("size").cast("int").alias("size"))
    made = made.select("capacity_id", "capacity", F.col("members")[0]["doc_id"].alias("doc_id"), F.col("members")[0]["piece"].alias("piece"), "size", "members")
    return loose.where(~small).withColumn("members", F.lit(None).cast(made.schema["members"].dataType)).unionByName(made)


def solved(items: DataFrame) -> DataFrame:
    """The items with `shard`, `bin` and the `room` left in the bin, of the best solution found for their shard. A shard
    whose fewest possible containers are reached takes no part in further epochs."""
    totals = items.groupBy("capacity_id", "capacity").agg(F.sum(F.col("size").cast("long")).alias("t"), F.count("*").alias("n")).collect()  # a row per capacity
    shards = {r.capacity_id: max(1, -(-r.t // (r.capacity * SHARD_CONTAINERS)), -(-r.n // SHARD_ITEMS)) for r in totals}
    count = F.create_map(*[F.lit(x) for pair in (shards or {0: 1}).items() for x in pair])[F.col("capacity_id")]
    one = F.struct("doc_id", "piece", "size", "members")
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), count).cast("int"))
    held = cut(dealt.groupBy("capacity_id", "capacity", "shard").agg(F.sort_array(F.collect_list(one)).alias("items")))
    islands = sum(shards.values()) * ISLANDS
    tasks = max(1, min(islands, max(items.sparkSession.sparkContext.defaultParallelism, islands // TASK_ISLANDS)))
    run = lambda df: cut(df.repartition(tasks).mapInPandas(run_islands, "capacity_id int, capacity int, shard int, island int, bins array<int>, rooms array<int>, few int, fit double, done boolean"))
    sizes = held.select("capacity_id", "capacity", "shard", F.transform("items", lambda x: x["size"]).alias("sizes"))
    every = sizes.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    now = run(every.withColumn("seeds", F.array().cast("array<array<int>>")))
    found = now
    for _ in range(EPOCHS - 1):
        open_ = now.groupBy("capacity_id", "shard").agg(F.bool_or("done").alias("done"), F.map_from_entries(F.collect_list(F.struct("island", "bins"))).alias("by")).where("not done").drop("done")
        mine = F.array(F.col("by")[F.col("island")], F.col("by")[F.pmod(F.col("island") + 1, F.lit(ISLANDS))])  # own best and the neighbour's
        now = run(every.join(open_, ["capacity_id", "shard"]).withColumn("seeds", mine).drop("by"))
        found = found.unionByName(now)
    best = found.groupBy("capacity_id", "shard").agg(F.max_by(F.struct("bins", "rooms"), F.struct("few", "fit", "island")).alias("b"))
    zipped = F.zip_with("items", F.zip_with("b.bins", "b.rooms", lambda b, r: F.struct(b.alias("bin"), r.alias("room"))), lambda x, y: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["size"].alias("size"), x["members"].alias("members"), y["bin"].alias("bin"), y["room"].alias("room")))
    return held.join(best, ["capacity_id", "shard"]).select("capacity_id", "capacity", "shard", F.inline(zipped))


def packed(sizes: DataFrame, capacities: DataFrame, doc_id: str = "doc_id", n_tokens: str = "n_tokens") -> DataFrame:
    """(capacity_id, container_id, doc_id, piece, start_token, n_tokens): a container for every document under every
    capacity. Only a document larger than the capacity is divided: into full containers and a rest.

    Documents with a null id or size and capacities that are null or below 1 are left out; more than MOST_CAPACITIES of
    these are refused; an empty text takes a place
    of size 0; a repeated document is taken once. No container is ever overfull.
    """
    docs = cut(sizes.select(F.col(doc_id).alias("doc_id"), F.col(n_tokens).cast("long").alias("n")).where("doc_id is not null and n is not null").distinct())
    caps = capacities.select(F.col("capacity_id").cast("int").alias("capacity_id"), F.col("capacity_tokens").cast("int").alias("capacity")).where("capacity >= 1 and capacity_id is not null").distinct()
    listed = [(r.capacity_id, r.capacity) for r in caps.limit(MOST_CAPACITIES + 1).collect()]
    if len(listed) > MOST_CAPACITIES:
        raise ValueError(f"capacities are a list of at most {MOST_CAPACITIES}")
    if not listed:
        docs = docs.limit(0)
    each = F.array(*[F.struct(F.lit(i).cast("int").alias("capacity_id"), F.lit(c).cast("int").alias("capacity")) for i, c in listed or [(0, 1)]])
    tried = docs.select("doc_id", "n", F.inline(each))
    pieces = tried.select("capacity_id", "capacity", "doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / F.col("capacity")) - 1, F.lit(0)).cast("int"))).alias("piece"))
    pieces = pieces.withColumn("size", F.least(F.col("capacity"), F.col("n") - F.col("piece").cast("long") * F.col("capacity")).cast("int")).drop("n")
    full = pieces.where("size = capacity").select("capacity_id", "capacity", F.concat_ws("-", "capacity_id", F.lit("full"), "doc_id", "piece").alias("container_id"), "doc_id", "piece", "size")
    once = cut(solved(bundled(pieces.where("size < capacity"))))
    open_ = F.col("room") > OPEN * F.col("capacity")
    again = solved(once.where(open_).select("capacity_id", "capacity", "doc_id", "piece", "size", "members"))
    name = lambda mark: F.concat_ws("-", "capacity_id", *mark, "shard", "bin").alias("container_id")
    rows = once.where(~open_).select("*", name([])).unionByName(again.select("*", name([F.lit("again")])))
    alone = F.array(F.struct("doc_id", "piece", "size"))
    each_one = rows.select("capacity_id", "capacity", "container_id", F.inline(F.coalesce("members", alone)))
    return each_one.unionByName(full).select("capacity_id", "container_id", "doc_id", "piece", (F.col("piece").cast("long") * F.col("capacity")).alias("start_token"), F.col("size").alias("n_tokens"))


def fill_report(assigned: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, capacity_tokens, n_containers, n_tokens, unused_share, fewest_possible) per capacity."""
    per = assigned.groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("t")).groupBy("capacity_id").agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"))
    cap = F.col("capacity_tokens")
    return per.join(capacities.select(F.col("capacity_id").cast("int").alias("capacity_id"), "capacity_tokens"), "capacity_id").select("capacity_id", "capacity_tokens", "n_containers", "n_tokens", (1 - F.col("n_tokens") / (F.col("n_containers") * cap)).alias("unused_share"), F.ceil(F.col("n_tokens") / cap).alias("fewest_possible"))
