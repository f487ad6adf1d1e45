"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

A hash draws three random sign flips, each followed by a Hadamard transform, and takes the largest coordinate and
its sign; a bucket's key joins several of them (more for more vectors, so that chance company in a bucket stays rare).
Each table gives a vector its own bucket and PROBES more, each with the least certain of its hashes replaced by the second
best. How many tables there are follows from the share of simulated pairs at the link threshold that a table brings
together, so that the same RECALL is met for every number of joined hashes and every vector length. Vectors that share a
bucket are candidates, and each candidate pair's cosine is computed in double precision, once: in the first bucket
they share.

Equal vectors are one class, compared once and counted as many. No group is expanded into pairs of rows. First every
class is compared with one leader of each bucket; components of these links have centres, and classes within half the
link angle of a centre (its core) are linked to one another by the triangle inequality, so they are counted, not
compared. Other pairs are compared block by block within a bucket and only counts and connecting links leave a block.

Nulls: vectors that are null, zero, empty, or hold a null or non-finite component link with nothing; vectors of different
lengths do not link with each other. Each row is a vector of its own, whatever its vec_id: rows are numbered where they are
read, and names come back at the end. Equal vectors link, also under one vec_id or none. A component is named by its
smallest vec_id, and has none if all its rows lack one; a row without vec_id is not kept. An empty table gives an empty
result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicklog.llm import words
from clicklog.llm.store import components, saved, scratch

PROBES, LEAST_JOINED = 2, 3
#: Vector lengths whose tables are planned on the driver.
SHAPES = 16
COSINE = 0.9
#: Share of the pairs at the threshold that come together in a bucket. Fewer hashes are joined where more tables would be
#: needed than MOST_TABLES (short vectors, which have many neighbours anyhow).
RECALL, MOST_TABLES = 0.995, 64
#: Shorter vectors are rotated among so many coordinates, as few coordinates have few rotations.
LEAST_WIDTH = 16
BLOCK = 512


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows of ``x`` (a power of two wide) under three random sign flips, each followed by a Hadamard transform."""
    n = x.shape[1]
    for k in range(3):
        bits = words.mix(np.arange(n, dtype=np.uint64) + np.uint64(n * (3 * seed + k)), 0xC0FFEE)
        x = x * np.where(bits & np.uint64(1), 1.0, -1.0)
        h = 1
        while h < n:
            x = x.reshape(len(x), n // (2 * h), 2, h)
            x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(len(x), n)
            h *= 2
    return x


def keys(x: np.ndarray, tables: int, joined: int) -> np.ndarray:
    """``tables * (1 + PROBES)`` bucket keys for each row; the last columns of a table are its probes."""
    width = 1 << math.ceil(math.log2(max(x.shape[1], LEAST_WIDTH)))
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    out = np.zeros((len(x), tables, 1 + PROBES), np.uint64)
    rows = np.arange(len(x))
    for t in range(tables):
        best, second, margin = (np.zeros((len(x), joined), k) for k in (np.int64, np.int64, float))
        for j in range(joined):
            y = rotate(x, t * joined + j)
            size = np.abs(y)
            top = size.argmax(1)
            most = size[rows, top]
            best[:, j] = 2 * top + (y[rows, top] < 0)
            size[rows, top] = -1
            next_ = size.argmax(1)
            second[:, j] = 2 * next_ + (y[rows, next_] < 0)
            margin[:, j] = most - size[rows, next_]
        order = margin.argsort(1, kind="stable")
        for p in range(1 + PROBES):
            code = best.copy()
            if 0 < p <= joined:
                code[rows, order[:, p - 1]] = second[rows, order[:, p - 1]]
            h = np.full(len(x), t + 1, np.uint64)
            for j in range(joined):
                h = words.mix(h + code[:, j].astype(np.uint64), 0xABCD)
            out[:, t, p] = h
    return out.reshape(len(x), -1)


def tables_for(width: int, joined: int, trials: int = 1024, seed: int = 4) -> int:
    """Tables that bring RECALL of the pairs at the threshold together, by simulated pairs."""
    if width < 2:
        return 1
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=(trials, width)), rng.normal(size=(trials, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = COSINE * x + math.sqrt(1 - COSINE**2) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    a, b = (keys(v, 2, joined).reshape(trials, 2, -1) for v in (x, y))
    p = float((a[:, :, :, None] == b[:, :, None, :]).any((2, 3)).mean())
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(max(1 - p, 1e-9)))) if p > 0 else MOST_TABLES + 1


@lru_cache(maxsize=1024)
def shape(width: int, n: int) -> tuple[int, int]:
    """``(tables, joined)`` for ``n`` vectors of ``width`` components."""
    joined = max(LEAST_JOINED, math.ceil(math.log(max(n, 2)) / math.log(2 * max(width, LEAST_WIDTH))))
    joined = min(joined, max(1, width // 3))  # a few coordinates cannot tell so many buckets apart
    while (tables := tables_for(width, joined)) > MOST_TABLES and joined > 1:
        joined -= 1
    return tables, joined


def _vectors(column: pa.Array) -> np.ndarray:
    """The unit vectors of a binary column, all of one length."""
    if not len(column):
        return np.zeros((0, 1))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float64).reshape(len(column), -1)


def _by_width(table: pa.RecordBatch, column: str, most: int = 2048) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose binary ``column`` has one length."""
    if not table.num_rows:
        return
    length = np.diff(np.frombuffer(table.column(column).buffers()[1], np.int32)[table.column(column).offset : table.column(column).offset + table.num_rows + 1])
    for w in np.unique(length):
        part = table if (length == w).all() else table.filter(pa.array(length == w))
        for at in range(0, part.num_rows, most):
            yield part.slice(at, most)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id``, the unit vector ``v`` (null if there is none) and its digest ``d``."""
    for batch in batches:
        column = batch.column("embedding")
        offsets = np.asarray(column.offsets)
        values = column.values.cast(pa.float64())
        x = values.fill_null(np.nan).to_numpy(zero_copy_only=False) if values.null_count else values.to_numpy()
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        units: list[bytes | None] = [None] * len(column)
        for w in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == w)
            m = x[offsets[rows][:, None] + np.arange(w)]
            rows, m = rows[np.isfinite(m).all(1)], m[np.isfinite(m).all(1)]
            with np.errstate(over="ignore"):
                length = np.sqrt((m * m).sum(1))
            far = ~np.isfinite(length) | (length < 1e-150)  # squares beyond the range of doubles
            m[far] /= np.maximum(np.abs(m[far]).max(1, keepdims=True), 5e-324)
            length[far] = np.sqrt((m[far] * m[far]).sum(1))
            for row, v, z in zip(rows.tolist(), m, length, strict=True):
                units[row] = (v / z).tobytes() if z > 0 else None
        digests = [u and hashlib.blake2b(u, digest_size=16).digest() for u in units]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array(units, pa.binary()), pa.array(digests, pa.binary())], ["id", "v", "d"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _by_width(batch, "a"):
            same = np.einsum("ij,ij->i", _vectors(part.column("a")), _vectors(part.column("b")))
            yield part.select(["x", "y"]).filter(pa.array(same >= COSINE))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the links ``(i, j)`` connect."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a0, b0 = top(a), top(b)
        if a0 != b0:
            up[max(a0, b0)] = min(a0, b0)
            out.append((a, b))
    return out


def _compare(n: int, shapes: dict[int, tuple[int, int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, left, right): count and connect the linked pairs of each bucket's pair of blocks."""
    held: pa.Table | None = None

    def ready(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, many, cores, sides = (table.column(c).to_numpy() for c in ("id", "m", "core", "block"))
        x = _vectors(table.column("v"))
        tables, joined = shapes.get(x.shape[1]) or shape(x.shape[1], n)
        bucket, left, right = (table.column(c).to_numpy() for c in ("bucket", "left", "right"))
        new = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
        first, second = [], []
        for a, b in zip(new, np.append(new[1:], len(ids)), strict=True):
            if b - a < 2:
                continue
            sim = x[a:b] @ x[a:b].T >= COSINE
            sim &= (cores[a:b, None] != cores[None, a:b]) | (cores[a:b, None] < 0)
            if left[a] != right[a]:
                sim &= sides[a:b, None] != sides[None, a:b]
            i, j = np.nonzero(np.triu(sim, 1))
            first.append(a + i), second.append(a + j)
        i, j = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (first, second))
        # a pair counts in the least of the buckets that both are in
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        own = np.concatenate([keys(x[used[k : k + 2048]], tables, joined) for k in range(0, len(used), 2048)]) if len(used) else np.zeros((0, 1), np.uint64)
        keep = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 16):
            p, q = own[at[: len(i)][k : k + (1 << 16)]], own[at[len(i) :][k : k + (1 << 16)]]
            least = np.full(len(p), 2**64 - 1, np.uint64)
            for t in range(0, p.shape[1], 1 + PROBES):
                for one in range(t, t + 1 + PROBES):
                    for two in range(t, t + 1 + PROBES):
                        least = np.where(p[:, one] == q[:, two], np.minimum(least, p[:, one]), least)
            keep[k : k + (1 << 16)] = least == bucket[i[k : k + (1 << 16)]].view(np.uint64)
        i, j = i[keep], j[keep]
        names, at = np.unique(ids[np.concatenate([i, j])], return_inverse=True)
        times = np.zeros(len(names), np.int64)
        np.add.at(times, at, many[np.concatenate([j, i])])
        links = _forest(len(names), at[: len(i)], at[len(i) :])
        u = np.concatenate([names, np.array([names[p] for p, _ in links], np.int64)]).astype(np.int64)
        v = pa.array([None] * len(names) + [int(names[q]) for _, q in links], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(u), v, pa.array(np.append(times, np.zeros(len(links), np.int64)).astype(np.int64))], ["u", "v", "c"])

    def parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in table.combine_chunks().to_batches():
            for part in _by_width(batch, "v", batch.num_rows):
                yield from ready(part)

    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks() if held is not None else pa.Table.from_batches([batch])
        last = held.slice(held.num_rows - 1).to_pylist()[0]
        same = (held.column("bucket").to_numpy() == last["bucket"]) & (held.column("left").to_numpy() == last["left"]) & (held.column("right").to_numpy() == last["right"])
        cut = int(np.argmax(same))
        if cut:
            yield from parts(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None:
        yield from parts(held)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _by_width(batch, "v", batch.num_rows):
            of, at = np.unique(part.column("component").to_numpy(), return_inverse=True)
            x = _vectors(part.column("v"))
            total = np.zeros((len(of), x.shape[1]))
            np.add.at(total, at, x)
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array([t.tobytes() for t in total], pa.binary())], ["component", "s"])


def _added(table: pa.Table) -> pa.Table:
    """One row for each task's part of a component becomes one."""
    total = sum(np.frombuffer(s) for s in table.column("s").to_pylist())
    return pa.table({"component": table.column("component")[:1], "s": pa.array([total.tobytes()], pa.binary())})


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    half = math.cos(math.acos(COSINE) / 2) + 1e-9
    for batch in batches:
        for part in _by_width(batch, "v"):
            centre = _vectors(part.column("s"))
            centre = centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-300)
            yield part.select(["id", "m", "component"]).filter(pa.array(np.einsum("ij,ij->i", centre, _vectors(part.column("v"))) >= half))


def near_duplicates(embeddings: DataFrame, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``embeddings`` (vec_id, embedding)."""
    with scratch() as kept:
        units = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_unit, "id long, v binary, d binary")
        units = saved(units.withColumnRenamed("id", "vec_id").withColumn("id", F.monotonically_increasing_id()), "units")
        good = units.where("v is not null").select("id", "v", "d")
        alike = saved(good.groupBy("d").agg(F.min("id").alias("cls"), F.count("*").alias("m")), "alike")
        vectors = saved(good.join(alike.select(F.col("cls").alias("id"), "m"), "id").select("id", "v", "m"), "vectors")
        n = vectors.count()
        # the shapes of the most frequent lengths are found once; others, where they occur
        common = vectors.groupBy((F.octet_length("v") / 8).cast("int").alias("w")).count().orderBy(F.desc("count"), "w").limit(SHAPES).collect()
        shapes = {r["w"]: shape(r["w"], n) for r in common}

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _by_width(batch, "v"):
                    x = _vectors(part.column("v"))
                    found = keys(x, *(shapes.get(x.shape[1]) or shape(x.shape[1], n)))
                    ids = np.repeat(part.column("id").to_numpy(), found.shape[1])
                    # a length has buckets of its own
                    yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), pa.array(np.full(len(ids), x.shape[1], np.int32)), pa.array(ids)], ["bucket", "w", "id"])

        buckets = ["bucket", "w"]
        everything = saved(vectors.select("id", "v").mapInArrow(hashed, "bucket long, w int, id long").distinct(), "hashed")
        shared = everything.groupBy(*buckets).agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select(*buckets, "low")
        put = saved(everything.join(shared, buckets).select(*buckets, "id", "low"), "buckets")
        a, b = vectors.select(F.col("id").alias("x"), F.col("v").alias("a")), vectors.select(F.col("id").alias("y"), F.col("v").alias("b"))
        to_leader = put.where("id != low").select(F.col("low").alias("x"), F.col("id").alias("y")).distinct()
        first = to_leader.join(a, "x").join(b, "y").select("x", "y", "a", "b").mapInArrow(_close, "x long, y long")
        near = saved(components(first.select(F.col("x").alias("u"), F.col("y").alias("v"))), "near")

        # cores: members within half the link angle of their component's centre
        grouped = vectors.join(near, vectors["id"] == near["node"]).select("id", "m", "component", "v")
        centres = grouped.select("component", "v").mapInArrow(_summed, "component long, s binary").groupBy("component").applyInArrow(_added, "component long, s binary")
        core = saved(grouped.join(centres, "component").select("id", "m", "component", "v", "s").mapInArrow(_inside, "id long, m long, core long"), "cores")
        sizes = core.groupBy("core").agg(F.sum("m").alias("size"), F.min("id").alias("head"))
        # blocks of a bucket: small buckets are one block; in large ones core members have blocks of their own
        placed = put.select(*buckets, "id").join(core.select("id", "core"), "id", "left").select(*buckets, "id", F.coalesce("core", F.lit(-1)).alias("core"))
        counts = placed.groupBy(*buckets, "core").agg(F.count("*").alias("k"))
        own = Window.partitionBy(*buckets)  # of a bucket's cores
        counts = counts.withColumn("all", F.sum("k").over(own)).withColumn("some", F.count("*").over(own)).where("some > 1 or core < 0")  # one core alone has nothing to compare
        counts = counts.withColumn("parts", F.when(F.col("all") <= 2 * block, F.lit(0)).otherwise(F.ceil(F.col("k") / block)))
        placed = placed.join(counts.select(*buckets, "core", "parts"), [*buckets, "core"])
        placed = placed.withColumn("block", F.when(F.col("parts") == 0, F.lit(0)).otherwise(F.xxhash64("core", F.pmod(F.xxhash64("id"), F.col("parts")))))
        parts = placed.groupBy(*buckets, "block").agg(F.min("core").alias("core"), F.max("core").alias("top"))
        left = parts.select(*buckets, F.col("block").alias("left"), F.col("core").alias("c1"), F.col("top").alias("t1"))
        right = parts.select(*buckets, F.col("block").alias("right"), F.col("core").alias("c2"), F.col("top").alias("t2"))
        tasks = left.join(right, buckets).where("left <= right and not (c1 >= 0 and c1 = t1 and c1 = c2 and c2 = t2)").select(*buckets, "left", "right")
        sides = tasks.select(*buckets, "left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
        work = placed.select(*buckets, "block", "core", "id").join(sides, [*buckets, "block"]).join(vectors, "id").select("bucket", "left", "right", "block", "core", "id", "m", "v")
        work = work.repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right", "id")
        found = saved(work.mapInArrow(lambda rows: _compare(n, shapes, rows), "u long, v long, c long"), "found")

        other = found.where("v is null").groupBy(F.col("u").alias("cls")).agg(F.sum("c").alias("more"))
        inner = core.join(sizes, "core").select(F.col("id").alias("cls"), (F.col("size") - F.col("m")).alias("inner"), "head")
        links = found.where("v is not null").select("u", "v").union(inner.select(F.col("cls").alias("u"), F.col("head").alias("v")))
        whole = components(links).withColumnRenamed("node", "cls")
        of_class = alike.select("d", "cls", "m").join(other, "cls", "left").join(inner, "cls", "left").join(whole, "cls", "left")
        of_class = of_class.select("d", (F.coalesce("more", F.lit(0)) + F.coalesce("inner", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("component", "cls").alias("component"))
        known = saved(good.select("id", "d").join(of_class, "d").select("id", "links", "component"), "known")
        named = units.select("vec_id", "id").join(known, "id", "left")
        named = saved(named.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("part")), "named")
        kept.append(named)
    least = named.where("n_links > 0").groupBy("part").agg(F.min("vec_id").alias("least"))
    out = named.join(least, "part", "left")
    component = F.when(F.col("n_links") > 0, F.col("least")).otherwise(F.col("vec_id"))
    return out.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
