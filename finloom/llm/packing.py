"""Items into containers of fixed capacity, by shortest-pack-first over the histogram of lengths.

The histogram of a group has at most ``capacity`` rows, whatever the number of items. Lengths are placed longest first,
all items of a length at once: into the packs with most space left, while any has enough, else into new ones. A pack is
a pattern of lengths with a count. The finished patterns are runs of ranks within a length that go to as many containers
in a row; the items are joined to the runs by their rank, block of ranks by block, so no task ever holds a group's items.

The same histogram is also packed fullest-pack-first; of the two results the one with fewer containers stands.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CAPACITY = 600
#: Parts by which the items of one length are ranked in parallel.
SALTS = 1024
#: Ranks of a block, on which items and runs are joined.
BLOCK = 4096


def pack_histogram(counts: dict[int, int], capacity: int, fullest: bool = False) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a container, number of such containers), in order of placing.

    Shortest pack first; with ``fullest``, the pack with least sufficient space is taken instead.
    """
    by_space: list[Counter] = [Counter() for _ in range(capacity + 1)]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        spaces = range(length, capacity + 1) if fullest else range(capacity, length - 1, -1)
        placed: list[tuple[int, tuple[int, ...], int]] = []
        while left:
            space = next((s for s in spaces if by_space[s]), None)
            if space is None:
                # One new pack after another takes as many items of the length as it can hold.
                fit = capacity // length
                whole, rest = divmod(left, fit)
                placed += [(capacity - k * length, (length,) * k, n) for k, n in ((fit, whole), (rest, 1)) if k and n]
                left = 0
            else:
                pattern = next(iter(by_space[space]))
                n = min(left, by_space[space][pattern])
                by_space[space][pattern] -= n
                if not by_space[space][pattern]:
                    del by_space[space][pattern]
                placed.append((space - length, (*pattern, length), n))
                left -= n
            for s, p, n in placed:
                by_space[s][p] += n
            placed.clear()
    return [(p, n) for packs in by_space for p, n in packs.items()]


def pack_items(items: DataFrame, group: list[str], item: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """``items`` with ``piece_no`` (from 1), ``piece_size`` and ``container_no`` (from 1 in each group).

    ``item`` must be unique. An item larger than the capacity, and no other, is cut: into full containers and a rest
    that is packed like an item. Null, zero and negative sizes count as 0 and go to the group's first container. Null
    group values form groups of their own. The order of equal sizes is that of a hash of ``item``; extra columns are
    kept, whatever their names (but for those three, which are written anew). Per group both placing rules are tried on the histogram and the one with fewer containers stands,
    shortest-pack-first where they tie.
    """
    gs = [f"_g{i}" for i in range(len(group))]
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    row = F.struct(*[F.col(c) for c in items.columns if c not in ("piece_no", "piece_size", "container_no")])
    base = items.select(row.alias("_row"), F.col(item).alias("_item"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("int").alias("_size"), *[text(c).alias(g) for g, c in zip(gs, group, strict=True)])
    full = F.floor(F.greatest(F.col("_size") - 1, F.lit(0)) / capacity).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), full), lambda k: F.struct((k + 1).cast("int").alias("no"), F.least(F.lit(capacity), F.col("_size") - k * capacity).cast("int").alias("size")))
    pieces = base.withColumn("_p", F.explode_outer(cuts)).withColumns({"piece_no": F.col("_p.no"), "piece_size": F.col("_p.size"), "_salt": F.pmod(F.xxhash64(F.col("_item").cast("string"), F.col("_p.no")), F.lit(SALTS)).cast("int")}).drop("_p", "_size")

    count = pieces.groupBy(*gs, "piece_size", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    lengths = count.filter("piece_size > 0").groupBy(*gs, "piece_size").agg(F.sum("_n").alias("_n"))

    def run(hist: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(hist["piece_size"].tolist(), hist["_n"].tolist(), strict=True))
        packs = min((pack_histogram(counts, capacity, best) for best in (False, True)), key=lambda ps: sum(n for _, n in ps))
        out, start, rank = [], 0, Counter()
        for pattern, n in packs:
            for length in pattern:
                out.append((length, rank[length], start, n))
                rank[length] += n
            start += n
        return pd.DataFrame([(*(hist[g].iloc[0] for g in gs), *x) for x in out], columns=[*gs, "piece_size", "_rank", "_start", "_n"])

    kinds = ", ".join([f"{g} string" for g in gs] + ["piece_size int", "_rank bigint", "_start bigint", "_n bigint"])
    runs = lengths.groupBy(*gs).applyInPandas(run, kinds)
    # A run meets the items in the blocks of ranks that it reaches into; their number is that of its containers / BLOCK.
    reach = F.sequence(F.floor(F.col("_rank") / BLOCK), F.floor((F.col("_rank") + F.col("_n") - 1) / BLOCK))
    slots = runs.select(*gs, "piece_size", F.col("_rank").alias("_from"), "_start", "_n", F.explode(reach).alias("_block"))

    # A rank without one long sort: the number of the item in its salt after the items of the salts before it.
    before = count.withColumn("_before", F.sum("_n").over(Window.partitionBy(*gs, "piece_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).select(*gs, "piece_size", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = pieces.withColumn("_no", F.row_number().over(Window.partitionBy(*gs, "piece_size", "_salt").orderBy("_item", "piece_no")))
    ranked = ranked.join(before, [*gs, "piece_size", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_no") - 1)
    ranked = ranked.withColumn("_block", F.floor(F.col("_rank") / BLOCK))
    items = {c: ranked[c] for c in (*gs, "piece_size", "_block")}
    mine = [items[c] == slots[c] for c in items] + [ranked["_rank"] >= slots["_from"], ranked["_rank"] < slots["_from"] + slots["_n"]]
    return ranked.join(slots, mine, "left").select("_row.*", ranked["piece_no"], ranked["piece_size"], F.coalesce(slots["_start"] + ranked["_rank"] - slots["_from"] + 1, F.lit(1).cast("bigint")).alias("container_no"))
