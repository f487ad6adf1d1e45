"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the key ``-ln(u) / weight`` (``u`` from a hash of its id and text; the weight is its quality, half
and half the share of letters in its text). A source whose target is ``e`` full epochs and a rest gives every document
``e`` times; the rest takes documents by ascending key until the budget is met, and the last one in part, so that a
source's words meet its target to within one word.

Nulls: a null text has size 0; a null source is a source of its own, last in order. Empty texts are taken 0 words. Rows
with equal doc_id and text share a draw and are taken one after the other. An empty table gives an empty result. Other
columns of the input are kept, whatever their names; those that share a name with a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicklog.llm import words
from clicklog.llm.store import gapless, in_order, saved, scratch

MOST_EPOCHS = 3
#: A table with a row for each source is broadcast up to so many sources, else the rows are shuffled by source.
BROADCAST_MOST = 100_000
_LETTER = np.zeros(256, dtype=np.int64)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``text`` becomes ``size`` (its words) and ``weight`` (0.5 to 1: half, and half the share of letters)."""
    for batch in batches:
        sizes, weights = [], []
        for _, data, offsets in words.chunks(batch.column("text")):
            _, rows = words.word_starts(data, offsets)
            sizes.append(np.diff(rows))
            ink = words.sums(~words.SPACE[data], offsets)
            weights.append(0.5 + 0.5 * words.sums(_LETTER[data], offsets) / np.maximum(ink, 1))
        more = [np.concatenate(x) if x else np.zeros(0) for x in (sizes, weights)]
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(more[0].astype(np.int64)), pa.array(more[1].astype(float))], [*kept, "size", "weight"])


def targets(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), epochs: float = MOST_EPOCHS) -> DataFrame:
    """``source, source_size`` with ``target``: all words by weight, none above ``epochs`` times its size.

    Weights repeat over the sources in order, null last. The excess of sources above their limit is shared anew, until
    none is above. A source is at its limit when a share for weight 1 is above ``limit``, and shares only grow: the
    state of the rounds is one number.
    """
    place = F.pmod(F.col("place"), F.lit(len(weights)))
    numbered = in_order(sources, [F.col("source").isNull(), F.col("source")], "place")
    most = F.lit(float(epochs)) * F.col("source_size")
    sized = numbered.withColumn("w", F.array(*map(F.lit, weights))[place.cast("int")]).withColumn("limit", most / F.col("w"))
    total = float(sized.agg(F.sum("source_size").alias("s")).first()["s"] or 0)
    share, level = (0.0, 1.0), -1.0
    while True:
        full: Column = F.col("limit") < level
        got = sized.agg(F.sum(F.when(full, most).otherwise(0.0)).alias("at_limit"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("free")).first()
        share = total - (got["at_limit"] or 0.0), got["free"] or 1.0
        if share[0] / share[1] <= level:
            break
        level = share[0] / share[1]
    return sized.select("source", "source_size", F.when(F.col("limit") < level, most).otherwise(F.lit(share[0]) * F.col("w") / F.lit(share[1])).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), seed: int = 17, buckets: int = 4096) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) without text, with ``size``, ``source_size``, ``target`` and ``taken``.

    A source's prefix sums come from a histogram of its keys: buckets before the boundary are taken whole, and
    only the boundary bucket is sorted, by its different (doc_id, text), so a hot source is never gathered in one task.
    """
    results = ["size", "source_size", "target", "taken"]
    own = [c for c in docs.columns if c.lower() not in (*results, "text")]
    # the input's columns ride in one struct, so that no name in it can meet one used here
    sized = docs.select(F.struct(*(docs[c] for c in own)).alias("row"), F.col("source").alias("source"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"), F.xxhash64("doc_id", F.lit(seed), "text").alias("tie"), "text")
    sized = sized.mapInArrow(counted, sized.drop("text").schema.add("size", "long").add("weight", "double"))
    # (53 bits + 1/2) / 2^53 is in (0, 1); 1 - exp(-key) then falls evenly, a monotone map of the key to a bucket
    u = (F.shiftrightunsigned("draw", 11).cast("double") + 0.5) / float(1 << 53)
    key = -F.log(u) / F.col("weight")
    sized = sized.select("row", "source", "tie", "size", key.alias("key"), F.floor((1 - F.exp(-key)) * buckets).cast("int").alias("bucket"))
    with scratch() as kept:
        sized = saved(sized.withColumn("nth", F.monotonically_increasing_id()), "mix")
        by_source = saved(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "sources")
        epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
        table = by_source.withColumn("epochs", epochs).withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
        # the bucket in which each source's budget ends
        sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.select(F.col("source").alias("of"), "bucket", (F.sum("words").over(upto) - F.col("words")).alias("before"))
        cut = table.join(sums, F.col("source").eqNullSafe(F.col("of"))).where("before <= budget")
        cut = cut.groupBy(F.col("of")).agg(F.max_by(F.struct("bucket", "before", "source_size", "target", "epochs", "budget"), "bucket").alias("x"))
        cut = saved(cut.select("of", F.col("x.bucket").alias("at"), *(f"x.{c}" for c in ("before", "source_size", "target", "epochs", "budget"))), "cuts")
        few = cut.count() <= BROADCAST_MOST
        joined = sized.join(F.broadcast(cut) if few else cut, F.col("source").eqNullSafe(F.col("of")))
        # the boundary bucket by its groups of rows that share a draw
        edge = joined.where("bucket = at").groupBy("of", "key", "tie").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.min("budget").alias("budget"), F.min("before").alias("before"))
        order = Window.partitionBy("of").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, 0)
        left = F.col("budget") - F.col("before") - (F.sum("words").over(order) - F.col("words"))
        edge = saved(edge.withColumn("left", F.greatest(F.lit(0), F.least(F.col("words"), left))).select("key", "tie", F.col("of").alias("src"), "n", "words", "left"), "edge")
        # only the group in which the budget ends is taken row by row
        ends = edge.where("0 < left and left < words").select("src", "key", "tie")
        last = sized.join(F.broadcast(ends) if few else ends, F.col("source").eqNullSafe(F.col("src")) & (sized["key"] == ends["key"]) & (sized["tie"] == ends["tie"]), "left_semi")
        last = saved(last.select("nth", "source", F.struct("source", "key", "tie").alias("group")), "last")
        order_in = gapless(last, "group", "nth", "place").select(F.col("nth").alias("row_nth"), "place")
        kept += [sized, cut, edge, last]
    columns = ["row", "size", "source_size", "target", "epochs"]
    whole = joined.where("bucket <> at").select(*columns, F.when(F.col("bucket") < F.col("at"), F.col("size")).otherwise(0).alias("part"))
    some = joined.where("bucket = at")
    some = some.join(edge, some["of"].eqNullSafe(edge["src"]) & (some["key"] == edge["key"]) & (some["tie"] == edge["tie"])).select(*columns, "nth", "left", "words")
    some = some.join(order_in, F.col("nth") == F.col("row_nth"), "left")
    rest = F.least(F.col("size"), F.greatest(F.lit(0), F.col("left") - F.col("place") * F.col("size")))
    found = whole.union(some.select(*columns, F.when(F.col("place").isNotNull(), rest).when(F.col("left") > 0, F.col("size")).otherwise(0).alias("part")))
    return found.select(*(F.col("row")[c].alias(c) for c in own), "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))
