"""N-gram Jaccard self-join by multiple-global-order filtering.

A document's set holds the hashes of its distinct five-word shingles. Two sets with Jaccard similarity of at least
0.8 share a token among the first ``n - ceil(0.8 n) + 1`` under *any* global order of the tokens. Three orders are
used; all put tokens that were seen to be frequent last, and differ in the hash that orders the rest. The first
order's prefixes are indexed; a pair that shares one of its tokens must also share a prefix token under the two
other orders before its whole sets are compared.

Links are only needed to build components, so no group is expanded into all its pairs: equal sets are one class;
then each document is compared with two leaders, those of most of its index tokens, and in ROUNDS rounds with
the most typical document of those tokens; only documents that are not connected after that are all compared with each
other, if they share enough index tokens for their sizes.

Nulls: a null or empty text, or one without words, has an empty set and is linked with nothing. A text of one to
four words has one shingle, the whole sequence. A row without doc_id links like any other, equal texts as one document; a
component is named by its smallest doc_id, and has none if all its rows lack one. Beside such rows doc_ids are below 2 ** 62.
Rows with equal doc_id are one document in several rows: each row has its own text's set size, and the component is what
the links of all its texts reach. Very long texts are read whole; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicklog.llm import words
from clicklog.llm.store import components, dropped, saved, scratch

WIDTH = 5
#: Similarity 80 / 100.
NUM, DEN = 80, 100
#: A token this often among FLUSH tokens read together counts as frequent; the most frequent HOT_MOST are broadcast.
HOT_LEAST, HOT_MOST, FLUSH = 4, 1 << 19, 1 << 22
#: Documents of a token that are seen to be frequent are led in groups of about SPLIT.
SPLIT = 1_000
#: Up to so many classes of equal sets, the largest ones of more than SPLIT documents, are joined by broadcast.
CLASSES_MOST = 100_000
#: Rounds in which documents are compared with the most typical document of another part.
ROUNDS = 1
#: So many ids of documents that share a token are broadcast; more are joined by a shuffle of the texts.
BROADCAST_MOST = 1_000_000
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_ORDERS = (0, 0x51ED270B7A2F3C15, 0x2545F4914F6CDD1D)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles."""
    hashes, rows = words.word_hashes(data, offsets)
    if len(hashes) >= width:
        whole = sum((hashes[j : len(hashes) - width + 1 + j] * _C[j % 5] ** np.uint64(1 + j // 5) for j in range(width)), np.uint64(0))
        whole = words.mix(whole)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                short = words.mix(short * _C[1] + h, 0x5BD1E995)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    """Tokens of which one at least is shared with any set that is similar enough."""
    return n - -(-num * n // den) + 1 if n else 0


@dataclass
class Orders:
    """The global orders: by frequency class, then by hash. ``tokens`` (sorted) are frequent, with their ``counts``."""

    tokens: np.ndarray
    counts: np.ndarray

    def classes(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(tokens), np.uint64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.counts[at], 0).astype(np.uint64)

    @staticmethod
    def prefix(tokens: np.ndarray, classes: np.ndarray, order: int, length: int) -> np.ndarray:
        """The first ``length`` of ``tokens`` (sorted, so ties fall by value)."""
        if length >= len(tokens):
            return tokens
        keys = words.mix(tokens, _ORDERS[order]) >> np.uint64(1)
        hot = classes > 0
        if hot.any():
            keys[hot] = (np.uint64(1) << np.uint64(63)) | (np.minimum(classes[hot], np.uint64((1 << 31) - 1)) << np.uint64(32)) | (keys[hot] >> np.uint64(31))
        least = np.argpartition(keys, length - 1)[:length]
        edge = keys[least].max()
        if (keys == edge).sum() == 1:
            return tokens[np.sort(least)]
        return tokens[np.sort(np.argsort(keys, kind="stable")[:length])]


def _fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return np.stack([words.sums(words.mix(flat, salt), bounds) for salt in (0x1234567, 0x7654321)], axis=1)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (its set's size and 128-bit fingerprint), and rows of tokens seen HOT_LEAST times together."""
    names, pending, held = ["id", "n", "f1", "f2"], [], 0

    def frequent() -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(pending), return_counts=True)
        tokens, counts = tokens[counts >= HOT_LEAST], counts[counts >= HOT_LEAST]
        none = pa.nulls(len(tokens), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(-counts.astype(np.int64)), none, none], names)

    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        for row, data, offsets in words.chunks(batch.column("text")):
            sets = shingle_sets(data, offsets)
            prints = _fingerprints(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids.slice(row, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy())], names)
            pending += sets
            held += sum(map(len, sets))
            if held >= FLUSH:
                yield frequent()
                pending, held = [], 0
    if pending:
        yield frequent()


def _index(orders, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, doc_id, set size, groups that the token's documents are led in) for the prefixes under the first order; of
    equal sets in one task only the first is indexed."""
    order, seen = orders.value, set()
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        for row, data, offsets in words.chunks(batch.column("text")):
            sets = shingle_sets(data, offsets)
            prints = _fingerprints(sets)
            classes = np.split(order.classes(np.concatenate(sets)), np.cumsum([len(s) for s in sets])[:-1])
            tokens, lengths, sizes = [], [], []
            for s, c, p in zip(sets, classes, prints, strict=True):
                if (key := p.tobytes()) in seen:
                    lengths.append(0)
                    continue
                seen.add(key)
                tokens.append(order.prefix(s, c, 0, prefix_length(len(s))))
                lengths.append(len(tokens[-1]))
                sizes.append(np.full(lengths[-1], len(s), np.int32))
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            docs = np.repeat(ids.slice(row, len(sets)).to_numpy(zero_copy_only=False), lengths)
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int32)
            groups = 1 + (order.classes(flat) // np.uint64(SPLIT)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(docs.astype(np.int64)), pa.array(n), pa.array(groups)], ["tok", "doc", "n", "groups"])


def _sets(orders, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document its sorted set and the (sorted, 32-bit) prefixes under the other orders."""
    order = orders.value
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        for row, data, offsets in words.chunks(batch.column("text")):
            sets = shingle_sets(data, offsets)
            classes = np.split(order.classes(np.concatenate(sets)), np.cumsum([len(s) for s in sets])[:-1])
            short = [[np.unique(order.prefix(s, c, o, prefix_length(len(s))).astype(np.uint32)).tobytes() for s, c in zip(sets, classes, strict=True)] for o in (1, 2)]
            yield pa.RecordBatch.from_arrays([ids.slice(row, len(sets)), pa.array(short[0], pa.binary()), pa.array(short[1], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "p1", "p2", "tokens"])


def _share(a: bytes, b: bytes, kind: type) -> int:
    return len(np.intersect1d(np.frombuffer(a, kind), np.frombuffer(b, kind), assume_unique=True))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that share a prefix token under the other orders too, and whose whole sets are similar enough."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            if passed := _share(a["p1"], b["p1"], np.uint32) and _share(a["p2"], b["p2"], np.uint32):
                same = _share(a["tokens"], b["tokens"], np.uint64)
                passed = DEN * same >= NUM * ((len(a["tokens"]) + len(b["tokens"])) // 8 - same)
            keep.append(bool(passed))
        yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, texts: DataFrame, orders) -> DataFrame:
    """The pairs ``(x, y)`` of documents that pass the other orders' filters and then the comparison of whole sets.

    Sets are made only for documents in pairs. Their ids are broadcast if they are BROADCAST_MOST at most, else the
    texts are shuffled.
    """
    pairs = saved(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_MOST else wanted
    sets = saved(texts.join(wanted, "doc_id", "left_semi").mapInArrow(lambda b: _sets(orders, b), "id long, p1 binary, p2 binary, tokens binary"), "sets")
    whole = F.struct("p1", "p2", "tokens")
    a, b = sets.select(F.col("id").alias("x"), whole.alias("a")), sets.select(F.col("id").alias("y"), whole.alias("b"))
    out = saved(pairs.join(a, "x").join(b, "y").select("x", "y", "a", "b").mapInArrow(_similar, "x long, y long"), "edges")
    dropped(pairs, sets)
    return out


def close_in_size(n, m):
    """Sets of these sizes can be similar enough."""
    return DEN * F.least(n, m) >= NUM * F.greatest(n, m)


def needed(n, m):
    """How many index tokens sets of sizes n and m must share to be similar enough.

    Up to the nearer end of the two prefixes all common tokens are indexed; beyond it at most all of the rest of
    the set that ends there is common. Similar sets have at least NUM / (NUM + DEN) * (n + m) tokens in common.
    """
    rest = F.greatest(*(F.ceil(NUM * k / DEN) - 1 for k in (n, m)))
    return F.greatest(F.lit(1), F.ceil(NUM * (n + m) / (NUM + DEN)) - rest)


def by_class(rows: DataFrame, classes: DataFrame, keys: list[str], value: str, large: DataFrame) -> DataFrame:
    """``rows`` with ``value`` of their class (null without one). The ``large`` classes (CLASSES_MOST at most, with their
    keys and value) are broadcast, so that no task gets all rows of one."""
    known = rows.join(F.broadcast(large.withColumnRenamed(value, "of_large")), keys, "left")
    done = known.where("of_large is not null").withColumnRenamed("of_large", value)
    rest = known.where("of_large is null").drop("of_large").join(classes, keys, "left")
    return done.unionByName(rest)


def led_pairs(posted: DataFrame, leader: str) -> DataFrame:
    """``(x, y)``: each document with the one that leads most of its tokens, if they share enough for their sizes."""
    led = posted.where(F.col(f"{leader}.doc") != F.col("doc")).groupBy("doc", "n", F.col(f"{leader}.doc").alias("to"), F.col(f"{leader}.n").alias("m")).agg(F.count("*").alias("c"))
    led = led.groupBy("doc", "n").agg(F.max(F.struct("c", "to", "m")).alias("most"))
    led = led.where(close_in_size(F.col("n"), F.col("most.m")) & (F.col("most.c") >= needed(F.col("n"), F.col("most.m"))))
    return led.select(F.least("doc", "most.to").alias("x"), F.greatest("doc", "most.to").alias("y"))


def link_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, links, large)``: every document's set size and class (least doc_id of an equal set), links ``(u, v)`` that
    connect similar documents, and the largest classes."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = saved(texts.mapInArrow(_describe, "id long, n long, f1 long, f2 long"), "described")
    docs_seen = seen.where("n >= 0")
    hot = seen.where("n < 0").groupBy("id").agg(F.sum(-F.col("n")).alias("c")).orderBy(F.desc("c"), "id").limit(HOT_MOST).toPandas()
    hot = hot.assign(id=hot["id"].to_numpy(np.int64).view(np.uint64)).sort_values("id")
    orders = spark.sparkContext.broadcast(Orders(hot["id"].to_numpy(np.uint64), hot["c"].to_numpy(np.uint64)))  # HOT_MOST tokens at most
    equal_sets = ["f1", "f2", "n"]
    classes = docs_seen.where("n > 0 and id is not null").groupBy(*equal_sets).agg(F.min("id").alias("cls"), F.count("*").alias("k"))
    large = saved(classes.where(F.col("k") > SPLIT).orderBy(F.desc("k"), "cls").limit(CLASSES_MOST).drop("k"), "large")
    rows = by_class(docs_seen, classes.drop("k"), equal_sets, "cls", large)
    rows = saved(rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("cls", "id")).alias("cls")), "rows")
    dropped(seen)
    # the index; tokens that one document alone has are dropped at once. A frequent token's documents are led in groups
    index = texts.where("doc_id is not null").mapInArrow(lambda b: _index(orders, b), "tok long, doc long, n int, groups int")
    own, me = Window.partitionBy("tok", "part"), F.struct("doc", "n")
    posted = index.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("groups")).cast("int"))
    posted = posted.select("tok", "doc", "n", "groups", F.min(me).over(own).alias("l1"), F.max(me).over(own).alias("l2")).where("groups > 1 or l1.doc < l2.doc")
    posted = saved(posted, "posted")
    # each document with the two that lead most of its tokens, and each group's leader with the first one of its token
    leads = posted.where("groups > 1 and doc = l1.doc").select("tok", "doc", "n")
    first = leads.groupBy("tok").agg(F.min(me).alias("first"))
    heads = leads.join(first, "tok").where(close_in_size(F.col("n"), F.col("first.n"))).where("doc <> first.doc").select(F.col("first.doc").alias("x"), F.col("doc").alias("y"))
    first = verified(led_pairs(posted, "l1").union(led_pairs(posted, "l2")).union(heads).distinct(), texts, orders)
    # how much of a document's index is shared: near 1 for the text that a group's copies were made from
    typical = saved(posted.groupBy("doc", "n").agg(F.count("*").alias("k")).select("doc", (F.col("k") / (F.col("n") - F.ceil(NUM * F.col("n") / DEN) + 1)).alias("typical")), "typical")
    # of equal sets only those in the index (one for each task) need a link to their class
    equal = rows.where("n_shingles > 0 and doc_id != cls").join(typical, F.col("doc_id") == F.col("doc"), "left_semi").select(F.col("doc_id").alias("u"), F.col("cls").alias("v"))
    links = saved(first.select(F.col("x").alias("u"), F.col("y").alias("v")).union(equal), "links")
    placed = posted.select("tok", "doc", "n")
    for round_ in range(ROUNDS + 1):
        near = saved(components(links), "near")
        known = typical.join(near.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "typical", F.coalesce("component", "doc").alias("part"))
        placed = saved(placed.select("tok", "doc", "n").join(known, "doc"), "placed")
        apart = placed.groupBy("tok").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("tok")
        placed = saved(placed.join(apart, "tok"), "placed")
        if round_ == ROUNDS:
            break
        # each document with the most typical one of most of its tokens, where that is in another part
        best = placed.groupBy("tok").agg(F.max(F.struct("typical", F.xxhash64(F.lit(round_), "doc").alias("h"), "doc", "n", "part")).alias("o"))
        some = placed.join(best, "tok").where((F.col("o.part") != F.col("part")) & close_in_size(F.col("n"), F.col("o.n")))
        some = some.groupBy("doc", "n", F.col("o.doc").alias("to"), F.col("o.n").alias("m")).agg(F.count("*").alias("c"))
        some = some.groupBy("doc", "n").agg(F.max(F.struct("c", "to", "m")).alias("most")).where((F.col("most.c") >= needed(F.col("n"), F.col("most.m"))))
        more = verified(some.select(F.least("doc", "most.to").alias("x"), F.greatest("doc", "most.to").alias("y")).distinct(), texts, orders)
        links = saved(near.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more.select(F.col("x").alias("u"), F.col("y").alias("v"))), "links")
    # documents that are still apart. Of a document's k tokens here (rarest first), one that is followed by fewer than
    # the needed number can be shared only if an earlier one is: pairs are found by the tokens before those, then
    # their tokens are counted
    of_doc = Window.partitionBy("doc")
    placed = placed.join(placed.groupBy("tok").agg(F.count("*").alias("df")), "tok")
    placed = placed.withColumn("i", F.row_number().over(of_doc.orderBy("df", "tok")) - 1).withColumn("k", F.count("*").over(of_doc))
    placed = saved(placed.select("tok", "doc", "n", "part", "i", "k"), "placed")
    other = placed.select("tok", F.col("doc").alias("y"), F.col("n").alias("m"), F.col("part").alias("q"), F.col("i").alias("j"), F.col("k").alias("l"))
    least = needed(F.col("n"), F.col("m"))
    can = close_in_size(F.col("n"), F.col("m")) & (F.col("i") + least <= F.col("k")) & (F.col("j") + least <= F.col("l"))
    apart = placed.withColumnRenamed("doc", "x").join(other, "tok").where((F.col("part") != F.col("q")) & (F.col("x") < F.col("y")) & can)
    apart = apart.select("x", "y", "n", "m").distinct()
    tokens = placed.groupBy("doc").agg(F.collect_list("tok").alias("t"))  # of one document's prefix
    apart = apart.join(tokens.select(F.col("doc").alias("x"), F.col("t").alias("a")), "x").join(tokens.select(F.col("doc").alias("y"), F.col("t").alias("b")), "y")
    apart = apart.where(F.size(F.array_intersect("a", "b")) >= least).select("x", "y")
    second = verified(apart, texts, orders)
    return rows, near.select(F.col("node").alias("u"), F.col("component").alias("v")).union(second.select(F.col("x").alias("u"), F.col("y").alias("v"))), large


#: Rows without doc_id have numbers from here on, by their text, while they are joined.
NAMELESS = 1 << 62


def join_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document: the least doc_id that links reach."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = docs.agg(F.count("*").alias("rows"), F.count("doc_id").alias("named"), F.max("doc_id").alias("most")).first()
    nameless = seen["named"] < seen["rows"]
    if nameless:
        if (seen["most"] or 0) >= NAMELESS:
            raise ValueError("doc_ids beside rows that lack one must be below 2 ** 62")
        docs = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NAMELESS) + F.pmod(F.xxhash64("text"), F.lit(NAMELESS // 2))))
    with scratch() as kept:
        rows, links, large = link_classes(docs)
        found = saved(components(links).withColumnRenamed("node", "cls"), "found")
        of_large = large.select("cls").join(found, "cls").select("cls", "component")
        out = by_class(rows, found, ["cls"], "component", of_large)
        out = saved(out.select("doc_id", "n_shingles", F.coalesce("component", "cls").alias("component_id")), "joined")
        kept.append(out)
    name = lambda c: F.when(F.col(c) < NAMELESS, F.col(c)).alias(c) if nameless else F.col(c)
    return out.select(name("doc_id"), "n_shingles", name("component_id"))
