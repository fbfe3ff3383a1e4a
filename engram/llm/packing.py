"""Filling fixed-capacity containers: minimum bin slack over blocks of items.

Items meet in blocks of about ``block`` items, spread by hash. In a block each bin starts with the largest
item left; a bitset subset-sum over the lengths at hand finds the fullest feasible rest, which is removed.
Bins that stay emptier than ``full`` are opened again and packed in a second round of larger blocks. Only an
item longer than the capacity is split, into full bins and one rest. Items without length (null and empty
texts) join the first bin of their block; every item comes out for every capacity.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.session import cut

PLACED = "container_id int, capacity_tokens int, bin_id string, doc_id bigint, part int, start bigint, n_tokens bigint, slack bigint"


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The lengths (with repeats) whose sum is the largest that fits into ``room``."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        if n > room:
            continue
        for _ in range(min(counts[n], room // n)):
            more = (reach | (reach << n)) & mask
            if more == reach:
                break
            steps.append((n, reach))
            reach = more
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(n)
            total -= n
    return chosen


def pack(items: list[tuple[int, object]], capacity: int) -> list[tuple[list[object], int]]:
    """Bins [(items, slack)] of (length, item) pairs, no length above the capacity."""
    stock: dict[int, list] = defaultdict(list)
    for n, item in items:
        stock[n].append(item)
    empty, bins = stock.pop(0, []), []
    lengths = sorted(stock, reverse=True)
    while lengths:
        top = lengths[0]
        taken = [top]
        counts = {n: len(stock[n]) - (n == top) for n in lengths}
        taken += fullest(lengths, counts, capacity - top)
        bins.append(([stock[n].pop() for n in taken], capacity - sum(taken)))
        lengths = [n for n in lengths if stock[n]]
    if empty:
        if not bins:
            bins.append(([], capacity))
        bins[0][0].extend(empty)
    return bins


def pack_blocks(pieces: DataFrame, tag: str) -> DataFrame:
    """One round over pieces (container_id, capacity_tokens, block, doc_id, part, start, n_tokens)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        capacity, rows = int(pdf["capacity_tokens"].iloc[0]), []
        pdf = pdf.sort_values(["doc_id", "part"])
        items = list(zip(pdf["n_tokens"].astype(int), zip(pdf["doc_id"], pdf["part"], pdf["start"], pdf["n_tokens"])))
        for i, (members, slack) in enumerate(pack(items, capacity)):
            rows += [(key[0], capacity, f"{tag}-{key[1]}-{i}", *m, slack) for m in members]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in PLACED.split(", ")])

    return pieces.groupBy("container_id", "block").applyInPandas(run, PLACED)


def fill(sizes: DataFrame, containers: DataFrame, block: int = 2_000, full: float = 0.98) -> DataFrame:
    """Assignment of items (doc_id, n_tokens) to bins of every container's capacity; at most 1,000 of these."""
    n = max(1, sizes.count() // block)
    capacities = [(r[0], r[1]) for r in containers.select("container_id", "capacity_tokens").where("capacity_tokens > 0").distinct().limit(1_001).collect()]
    if len(capacities) > 1_000:
        raise ValueError("more than 1,000 containers")
    if not capacities:
        return sizes.sparkSession.createDataFrame([], PLACED)
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("container_id"), F.lit(c).alias("capacity_tokens")) for i, c in capacities]))
    items = sizes.select("doc_id", "n_tokens", kinds.alias("c")).select("doc_id", "n_tokens", "c.*")
    cap = F.col("capacity_tokens").cast("bigint")
    last = F.greatest(F.ceil(F.col("n_tokens") / cap) - 1, F.lit(0)).cast("int")
    parts = items.withColumn("part", F.explode(F.sequence(F.lit(0), last))).withColumn("start", F.col("part") * cap)
    parts = parts.withColumn("n_tokens", F.least(cap, F.col("n_tokens") - F.col("start")))
    # Full parts are bins of their own and never meet a block.
    whole = parts.where(F.col("n_tokens") == cap)
    alone = whole.select("container_id", "capacity_tokens", F.concat_ws("-", F.lit("w"), "doc_id", "part").alias("bin_id"), "doc_id", "part", "start", "n_tokens", F.lit(0).cast("bigint").alias("slack"))
    loose = parts.where(F.col("n_tokens") < cap).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n)))
    first = cut(pack_blocks(loose, "a"))
    poor = F.col("slack") > F.col("capacity_tokens") * (1 - full)
    again = first.where(poor).drop("bin_id", "slack").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // 16))))
    return first.where(~poor).unionByName(pack_blocks(again, "b")).unionByName(alone)
