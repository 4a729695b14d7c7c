"""Sharding by minimax contiguous partition.

Equal texts form atomic groups, ordered by text hash. The smallest shard capacity for which
a greedy walk over that order needs no more than the given number of shards is found by
binary search, and the order is cut there. The driver never holds all groups: it holds sums
of hash ranges, and finer sums only of those ranges in which a cut of any capacity still in
question can fall. With ranges as atoms an upper bound on the capacity is known, the mean is
a lower bound; between the two, cut k lies within [total - (shards - k) * high, k * high],
which shrinks as the ranges do.

A group larger than an even share of what is left (copies that hold a third of all rows,
say) can't be evened out: it gets a shard of its own, and the others are evened among
themselves.

A null text counts as empty: size 8, crc32 0. Null or repeated ids don't matter to the cut.
An empty table gives an empty result. Names starting with ``_sh_`` are reserved.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import stored

SHARDS = 24
#: First level: ranges by the top bits of the hash. Each further level splits the ranges that
#: are still in question, some hundreds, by a few bits more.
BITS, STEP = 12, 4
#: Levels stop when the ranges in question hold no more groups than this, and these are read.
MOST_GROUPS = 100_000
#: Rows that one task numbers, about.
SLOT_ROWS = 20_000


def _greedy(sizes: list[int], ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Where the greedy walk cuts (counts of atoms before each cut), or None if it needs more."""
    cuts, at, start = [], 0, 0
    while at < len(sizes):
        to = bisect_right(ends, start + capacity, at)
        if to == at:
            return None
        at, start = to, ends[to - 1]
        cuts.append(at)
        if len(cuts) > shards:
            return None
    return cuts[:-1]


def smallest_capacity(sizes: list[int], shards: int, low: int = 0) -> int:
    """The least capacity that the greedy walk over ``sizes`` meets with ``shards`` shards."""
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append(total)
    low, high = max(low, -(-total // shards), max(sizes, default=0)), max(total, 1)
    while low < high:
        middle = (low + high) // 2
        if _greedy(sizes, ends, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _low_bits(level: int) -> int:
    """Bits of the hash below those that name a level's ranges."""
    return 64 - (BITS + STEP * (level - 1))


def _key(level: int) -> Column:
    """The range's number in the unsigned order of hashes."""
    return F.shiftrightunsigned(F.col("g"), _low_bits(level))


def find_cuts(groups: DataFrame, shards: int = SHARDS, most_groups: int = MOST_GROUPS) -> tuple[list[int], list[int]]:
    """``groups``: a row per group, ``g`` (hash) and ``bytes``. Gives the hashes of the groups
    with shards of their own, and the hashes at which each later shard begins (unsigned order).
    """
    # groups over an even share: at most shards - 1 of them matter, the largest first
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = [(r["bytes"], r["g"]) for r in groups.where(F.col("bytes") * shards > total).orderBy(F.desc("bytes"), "g").limit(shards - 1).collect()]
    alone, left, rest = [], shards, total
    for b, g in large:
        if left < 2 or b * left <= rest:
            break
        alone.append(g)
        left, rest = left - 1, rest - b
    groups = groups.where(~F.col("g").isin(alone)) if alone else groups

    def read(level: int, parents: list[int] | None) -> list[tuple[int, int, int]]:
        """(key at this level, sum, groups) of the ranges under ``parents``, in order."""
        g = groups if parents is None else groups.where(_key(level - 1).isin(parents))
        rows = g.groupBy(_key(level).alias("k")).agg(F.sum("bytes").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("k")
        return [(r["k"], r["s"], r["n"]) for r in rows.collect()]

    level = 1
    # atoms in order: (level, key, size, groups); level 0 marks a single group, its key the hash
    atoms = [(1, k, s, n) for k, s, n in read(1, None)]
    while True:
        sizes = [a[2] for a in atoms]
        high = smallest_capacity(sizes, left)
        low = -(-sum(sizes) // left)
        start, ask = 0, []
        for i, (at, _, s, _n) in enumerate(atoms):
            end = start + s
            # can a cut of some capacity in [low, high] fall inside this atom?
            inside = any(start < k * high and end > rest - (left - k) * high for k in range(1, left))
            if at and (inside or s > low):
                ask.append(i)
            start = end
        if not ask or low == high and all(atoms[i][2] <= low for i in ask):
            break
        if sum(atoms[i][3] for i in ask) <= most_groups or _low_bits(level) <= STEP:
            keys = [atoms[i][1] for i in ask]
            rows = groups.where(_key(level).isin(keys)).select("g", "bytes", _key(level).alias("k")).collect()
            fine: dict[int, list] = {}
            for r in sorted(rows, key=lambda r: r["g"] & (2**64 - 1)):
                fine.setdefault(r["k"], []).append((0, r["g"], r["bytes"], 1))
            ask_set = set(ask)
            atoms = [x for i, a in enumerate(atoms) for x in (fine[a[1]] if i in ask_set else [a])]
            break
        keys = [atoms[i][1] for i in ask]
        fine = {}
        for k, s, n in read(level + 1, keys):
            fine.setdefault(k >> STEP, []).append((level + 1, k, s, n))
        ask_set = set(ask)
        # ranges that no cut can reach stay as they are
        atoms = [x for i, a in enumerate(atoms) for x in (fine[a[1]] if i in ask_set else [(-abs(a[0]), *a[1:])])]
        atoms = [(0 if a[0] < 0 else a[0], (a[1] << _low_bits(-a[0])) if a[0] < 0 else a[1], *a[2:]) for a in atoms]
        level += 1
    sizes = [a[2] for a in atoms]
    capacity = smallest_capacity(sizes, left)
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append(total)
    cuts = _greedy(sizes, ends, capacity, left) if sizes else []
    begin = [a[1] if a[0] == 0 else a[1] << _low_bits(a[0]) for a in (atoms[c] for c in cuts)]
    return alone, [(b & (2**64 - 1)) - 2**63 for b in begin]


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"))
    d = stored(d, "shard-rows")
    groups = stored(d.groupBy("g").agg(F.sum("size").alias("bytes")), "shard-groups")
    alone, begins = find_cuts(groups, shards)
    # the unsigned order of hashes is the signed order of hashes with the top bit flipped
    order = F.col("g").bitwiseXOR(F.lit(-(2**63)))
    shard = F.lit(0)
    for b in begins:
        shard = shard + F.when(order >= F.lit(b), 1).otherwise(0)
    for i, g in enumerate(alone):
        shard = F.when(F.col("g") == F.lit(g), shards - 1 - i).otherwise(shard)
    d = d.withColumn("shard", shard.cast("int"))
    # slots: rows are numbered within bins of a shard, and the bins' counts give offsets
    rows = d.count()
    bins = max(1, -(-rows // SLOT_ROWS // shards) * 2)
    d = d.withColumn("_sh_bin", F.pmod(F.xxhash64("doc_id", "g"), F.lit(bins)).cast("int"))
    counts = d.groupBy("shard", "_sh_bin").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("_sh_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_sh_bin", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_sh_offset"))
    own = F.row_number().over(Window.partitionBy("shard", "_sh_bin").orderBy("g", "doc_id")) - 1
    d = d.withColumn("_sh_own", own).join(offsets, ["shard", "_sh_bin"])
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_sh_offset") + F.col("_sh_own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
