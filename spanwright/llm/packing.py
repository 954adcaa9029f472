"""Filling containers of a fixed capacity with whole items, at target proportions of their sources.

Items are dealt to lanes by a hash of their id, so that a source holding a third of all items is
spread over all lanes; a lane's bounded inventory is packed by one task. Sums by lane and source,
accumulated over the lanes in two levels, give each lane the deficits with which it starts: what every
source should have got of all tokens before it, less what it had. Within the lane every container is
filled by deficit round-robin over the source queues: each source is granted its share of the capacity,
gives in turn the largest item that fits while its deficit pays for it, and carries what is left of its
deficit to the next container. Room that no deficit pays for goes to the source owed most. One or two
items that fill the room exactly are preferred where the inventory has them. An item larger than the
capacity is the only one that is divided: into containers of its own, and a rest that is packed like an item.

Defined results: items of null or no size take no part; a null source is a source of its own; items
of one id are kept apart (repeated rows are packed as often as they come); an empty table gives no
rows; other columns are left out. Every other item is in exactly one container.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwright.runtime import materialize, sorted_groups

OUT_SCHEMA = "container_id bigint, position int, item_id bigint, part int, start_token bigint, n_tokens bigint, source string"


LANES_A_BLOCK = 1024


def _before(rows: DataFrame, key: str | None, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the lanes before, of each ``key``.

    Lanes are summed in blocks of 1,024 and the blocks in order, so no window holds more than 1,024 lanes or
    their 1,024th part, a few thousand rows for millions of lanes.
    """
    keys = [key] if key else []
    block = F.floor(F.col("lane") / LANES_A_BLOCK).cast("int")
    placed = rows.withColumn("block", block)
    ahead = Window.partitionBy(*keys or [F.lit(0)]).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy(*keys, "block").agg(F.sum(value).alias("s")).select(*keys, "block", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("above"))
    inside = Window.partitionBy(*keys, "block").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("own", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(blocks, [*keys, "block"]).withColumn(name, F.col("above") + F.col("own")).drop("own", "above", "block")


def pack(items: DataFrame, capacity: int = 2048, lane_tokens: int = 4_000_000, lane_items: int = 20_000, target_shares: DataFrame | None = None) -> DataFrame:
    """Containers of ``items`` (item_id BIGINT, source STRING, n_tokens BIGINT), a row per piece in a container.

    ``lane_tokens`` and ``lane_items`` bound what one task packs. ``target_shares`` (source STRING,
    share DOUBLE) sets the mixture that containers aim at while their sources last; without it, and
    for sources that it leaves out, a source's share is that of all tokens.
    """
    # a source as a key that is never null
    keyed = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("queue")
    sized = materialize(items.where(F.col("n_tokens") > 0).select(F.col("item_id").cast("bigint").alias("item_id"), keyed, F.col("n_tokens").cast("bigint").alias("n_tokens")), "sizes")
    total = sized.agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).first()
    lanes = max(1, math.ceil((total.t or 0) / lane_tokens), math.ceil(total.n / lane_items))
    dealt = sized.withColumn("lane", F.pmod(F.xxhash64("item_id", "n_tokens"), F.lit(lanes)).cast("int"))

    by_lane = dealt.groupBy("lane", "queue").agg(F.sum("n_tokens").alias("tokens"))
    shares = by_lane.groupBy("queue").agg((F.sum("tokens") / F.lit(float(total.t or 1))).alias("share"))
    if target_shares is not None:
        wanted = target_shares.where(F.col("share") > 0).groupBy(keyed).agg(F.max("share").alias("t_share"))
        shares = shares.join(wanted, "queue", "left").select("queue", F.coalesce("t_share", "share").alias("share"))
    all_before = _before(by_lane.groupBy("lane").agg(F.sum("tokens").alias("of_lane")), None, "of_lane", "before").select("lane", "before")
    carried = (
        _before(by_lane, "queue", "tokens", "had").join(all_before, "lane").join(shares, "queue").select("lane", "queue", "share", (F.col("share") * F.col("before") - F.col("had")).alias("deficit"))
    )
    rows = carried.withColumn("head", F.lit(0)).unionByName(dealt.withColumn("head", F.lit(1)), allowMissingColumns=True)
    # a number of partitions that isn't merged by size: few bytes of sizes are much work
    tasks = min(lanes, int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartition(tasks, "lane").sortWithinPartitions("lane", "head", "queue", "n_tokens", "item_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a call may hold several lanes; each is packed by itself
        yield from sorted_groups(batches, ["lane"], lambda table: _pack_lanes(table, capacity), rows=1)

    return ordered.mapInArrow(work, OUT_SCHEMA)


def _pack_lanes(table: pa.Table, capacity: int) -> Iterator[pa.Table]:
    lanes = table.column("lane").to_numpy()
    starts = np.flatnonzero(np.r_[True, lanes[1:] != lanes[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], lanes.size]):
        yield _Lane(table.slice(a, b - a), capacity).packed(int(lanes[a]) << 32)


def _top(sizes: int) -> int:
    """The largest size of a set that has the bit of each of its sizes; 0 if it has none."""
    return max(sizes.bit_length() - 1, 0)


class _Lane:
    """The inventory of one lane: the items of each source by size, and the deficit of each source."""

    def __init__(self, table: pa.Table, capacity: int):
        heads = table.column("head").to_pylist()
        queues, self.ids, self.full = (table.column(c).to_pylist() for c in ("queue", "item_id", "n_tokens"))
        self.capacity = capacity
        place = {q: k for k, q in enumerate(queues[: heads.index(1) if 1 in heads else len(heads)])}
        self.names = [q[1:] if q[0] == "=" else None for q in place]
        k = len(place)
        self.share = np.maximum(np.array(table.column("share").to_pylist()[:k], float), 1e-12)
        self.deficit = np.array(table.column("deficit").to_pylist()[:k], float)
        self.items: list[dict[int, list[tuple[int, int, int]]]] = [{} for _ in place]
        self.sizes = [0] * k  # a set of sizes for each source, as bits
        self.count: dict[int, int] = {}
        self.all = self.mirror = 0  # all sizes at hand; the same with the bit ``capacity - size``
        for at in range(k, len(heads)):
            q, n, part, start = place[queues[at]], self.full[at], 0, 0
            while n - start > capacity or (part and n - start == capacity):
                self._add(q, capacity, (self.ids[at], part, start))
                part, start = part + 1, start + capacity
            if n > start:
                self._add(q, n - start, (self.ids[at], part, start))

    def _add(self, q: int, size: int, item: tuple[int, int, int]) -> None:
        self.items[q].setdefault(size, []).append(item)
        self.sizes[q] |= 1 << size
        self.count[size] = self.count.get(size, 0) + 1
        self.all |= 1 << size
        self.mirror |= 1 << (self.capacity - size)

    def _take(self, q: int, size: int) -> tuple[int, int, int]:
        held = self.items[q][size]
        item = held.pop()
        if not held:
            del self.items[q][size]
            self.sizes[q] &= ~(1 << size)
        self.count[size] -= 1
        if not self.count[size]:
            del self.count[size]
            self.all &= ~(1 << size)
            self.mirror &= ~(1 << (self.capacity - size))
        self.deficit[q] -= size
        return item

    def _exact(self, own: int, space: int) -> int:
        """The largest size of ``own`` that fills the space alone or with one more item at hand; 0 if none does."""
        if own >> space & 1:
            return space
        pairs = own & (self.mirror >> (self.capacity - space)) & ((1 << space) - 1)
        if not space & 1 and pairs >> (space // 2) & 1 and self.count.get(space // 2, 0) < 2:
            pairs &= ~(1 << (space // 2))
        return _top(pairs)

    def packed(self, container: int) -> pa.Table:
        rows: list[tuple] = []
        turn, k = 0, len(self.names)
        active = np.array([bool(x) for x in self.sizes])
        while self.all:
            self.deficit[active] += self.capacity * self.share[active] / self.share[active].sum()
            space, position, fits = self.capacity, 0, (1 << (self.capacity + 1)) - 1

            def serve(q: int, size: int) -> None:
                nonlocal space, position, fits
                item, part, start = self._take(q, size)
                rows.append((container, position, item, part, start, size, self.names[q]))
                position, space = position + 1, space - size
                fits = (1 << (space + 1)) - 1
                active[q] = bool(self.sizes[q])

            # round robin: each source in turn is served while its deficit pays for an item that fits
            ring = np.flatnonzero(active & (self.deficit >= 1))
            ring = np.r_[ring[ring >= turn], ring[ring < turn]]
            for q in ring.tolist():
                while space:
                    size = _top(self.sizes[q] & fits)
                    if not size or self.deficit[q] < size:
                        break
                    serve(q, self._exact(self.sizes[q] & fits, space) or size)
                if not space:
                    break
            turn = turn + 1 if turn + 1 < k else 0
            # the rest of the room goes to the sources that are owed most, exactly filled where that can be
            while space and self.all & fits:
                order = np.flatnonzero(active)
                order = order[np.argsort(-self.deficit[order], kind="stable")].tolist()
                best = next(q for q in order if self.sizes[q] & fits)
                exact = next((q for q in order if self._exact(self.sizes[q] & fits, space)), None)
                if exact is not None:
                    serve(exact, self._exact(self.sizes[exact] & fits, space))
                else:
                    serve(best, _top(self.sizes[best] & fits))
            container += 1
        names = ["container_id", "position", "item_id", "part", "start_token", "n_tokens", "source"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds)})
