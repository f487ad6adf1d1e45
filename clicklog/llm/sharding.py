"""Sharding by Karmarkar-Karp differencing: groups of equal texts are dealt whole, byte sums come out near equal.

Differencing runs in cells of a bounded number of groups. A cell yields a partial partition, one byte sum for
each shard; partial partitions are differenced again, a bounded number at a time, until one is left. Both levels
always combine the two with the largest spread, one in descending and one in ascending order.

Nulls: null texts are one group of size 1 each row; a null doc_id is kept. Empty texts have size 1. Repeated rows
are equal texts and stay together; groups of equal size are dealt in the order of their digests. An empty table gives an
empty result. Other columns, whatever their names, are dropped by ``shards``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicklog.llm.store import gapless, saved, scratch

CELL = 20_000
FAN_IN = 2_000


def difference(partials: list[list[int]], k: int) -> list[list[int]]:
    """For each partial partition (``k`` sums), the part of the common partition that each of its sums joins."""
    heap, parts = [], {}
    for i, sums in enumerate(partials):
        order = sorted(range(k), key=lambda j: -sums[j])
        now = [sums[j] for j in order]
        parts[i] = (now, order)
        heap.append((now[-1] - now[0], i))
    heapq.heapify(heap)
    merges, top = [], len(partials)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        (x, _), (y, _) = parts[a], parts[b]
        joint = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(k), key=lambda j: -joint[j])
        now = [joint[j] for j in order]
        parts[top] = (now, order)
        x.clear(), y.clear()
        merges.append((a, b, top))
        heapq.heappush(heap, (now[-1] - now[0], top))
        top += 1
    # from the last merge back: which final part each sorted place of a partial partition went to
    goes = {heap[0][1]: list(range(k))} if heap else {}
    for a, b, both in reversed(merges):
        to, (_, order) = goes.pop(both), parts[both]
        joint = [0] * k
        for place, j in enumerate(order):
            joint[j] = to[place]
        goes[a], goes[b] = joint, joint[::-1]
    out = []
    for i in range(len(partials)):
        row = [0] * k
        for place, j in enumerate(parts[i][1]):
            row[j] = goes[i][place]
        out.append(row)
    return out


def shards(docs: DataFrame, k: int = 16, cell: int = CELL, fan_in: int = FAN_IN) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs`` (doc_id, text)."""
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.sha2("text", 256).alias("digest"),
    )

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "digest"], na_position="first", ignore_index=True)
        parts = difference([[b] + [0] * (k - 1) for b in pdf["bytes"].tolist()], k)
        return pdf.assign(part=[p[0] for p in parts])

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="cell", columns="part", values="bytes", aggfunc="sum", fill_value=0)
        wide = wide.reindex(columns=range(k), fill_value=0).sort_index()
        parts = difference([[int(x) for x in r] for r in wide.to_numpy()], k)
        moves = [(int(c) // fan_in, int(c), j, p[j], int(wide.loc[c, j])) for c, p in zip(wide.index, parts, strict=True) for j in range(k)]
        return pd.DataFrame(moves, columns=["up", "cell", "part", "to", "bytes"])

    with scratch() as kept:
        # numbered where they are read, so that slots are given by parts of the input, not by groups of equal texts
        rows = saved(rows.withColumn("nth", F.monotonically_increasing_id()), "rows")
        groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
        cells = max(1, -(-groups.count() // cell))
        groups = groups.withColumn("cell", F.pmod(F.xxhash64("digest"), F.lit(cells)))
        dealt = saved(groups.groupBy("cell").applyInPandas(deal, "digest string, bytes long, cell long, part int"), "dealt")
        level = dealt.groupBy("cell", "part").agg(F.sum("bytes").alias("bytes"))
        while cells > 1:
            up = (F.col("cell") / fan_in).cast("long").alias("up")
            moved = saved(level.groupBy(up).applyInPandas(combine, "up long, cell long, part int, to int, bytes long"), "level")
            dealt = dealt.join(moved.select("cell", "part", "up", "to"), ["cell", "part"])
            dealt = dealt.select("digest", "bytes", F.col("up").alias("cell"), F.col("to").alias("part"))
            level = moved.groupBy(F.col("up").alias("cell"), F.col("to").alias("part")).agg(F.sum("bytes").alias("bytes"))
            cells = -(-cells // fan_in)
        places = dealt.select(F.col("digest").alias("of"), F.col("part").alias("shard"))
        placed = rows.join(places, F.col("digest").eqNullSafe(F.col("of"))).drop("digest", "of")
        placed = saved(placed, "placed")
        kept.append(placed)
    out = gapless(placed, "shard", "nth", "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
