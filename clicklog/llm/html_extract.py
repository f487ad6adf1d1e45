"""Main text of web pages by wrapper induction over the pages of a host.

Each page becomes a tree of its block elements, aligned with its host's reference tree (that of the host's page of
least page_id) by simple tree matching; see :mod:`clicklog.llm.html_tree`. A block's slot is the reference node that it
matches, or its label under its parent's slot.

Over all pages of a host, a slot is template if it has few different texts for the number of different pages that
fill it, and content if its texts vary. A host's own name within a text is no difference. Pages are told apart by
their three longest blocks, so that copies of a page count once. The ratio of texts to pages leans on that of the
same tag path over all hosts, which itself leans on 1, each by the weight of PRIOR pages: a slot of many pages is judged
by its own texts, one of few pages by the path's, and one that was hardly ever seen is content.

Blocks in content slots are the text, in page order, with the template blocks inside the page's article: headings and
lines that a host's articles have in common are text of each. Tags that say so (scripts, styles, navigation, footers, asides,
buttons, headers outside an article) are never content. Names (class, id, role, label) are a prior against an element
that the wrapper found to vary: they drop it outside the page's article; inside, only adverts, forms and reader
comments go by name. A name does not hold for an element with most of the page's varying text, nor for one around
the only article.

Nulls: a null html is empty and has empty text; a null url, or one without ``://``, has the empty host; hosts whose
pages all lack an id align with an empty tree. Very long, deep and broken pages are read whole, in linear time.
Repeated rows get equal texts. An empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicklog.llm import html_tree
from clicklog.llm.store import saved, scratch
from clicklog.llm.url_filter import host_of

#: A slot with fewer different texts than this share of its pages is template.
VARIES = 0.5
PRIOR = 8
#: Tables with a row for each host are broadcast up to so many bytes, so that pages stay where they were read; larger
#: ones are joined by a shuffle of the pages by host, in which Spark splits hot hosts.
BROADCAST_MOST = 32_000_000
_EMPTY = "0 . "
_READ = "page_id long, url string, host string, page long, parent array<int>, flags array<int>, node array<int>, slot array<long>, path array<long>, text array<string>"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            tree = html_tree.Reference.written(html_tree.Page(batch.column("html")[i].as_py() or ""))
            yield pa.RecordBatch.from_arrays([batch.column("host").slice(i, 1), pa.array([tree], pa.string())], ["host", "tree"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's elements that hold text, and its blocks that no tag bars, with their slots and tag paths."""
    trees: dict[str, html_tree.Reference] = {}
    kinds = [pa.list_(pa.int32())] * 3 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.string())]
    names = ["page", "parent", "flags", "node", "slot", "path", "text"]
    for batch in batches:
        for first in range(0, batch.num_rows, 64):
            part = batch.slice(first, 64)
            rows: list[tuple] = []
            for host, page, written in zip(*(part.column(c).to_pylist() for c in ("host", "html", "tree")), strict=True):
                if host not in trees:
                    if len(trees) > 256:
                        trees.clear()
                    trees[host] = html_tree.Reference(written)
                tree = html_tree.Page(page or "")
                slot, path = html_tree.align(tree, trees[host]), html_tree.paths(tree)
                blocks = [(n, t) for n, t in tree.blocks if not tree.flags[n] & html_tree.BARRED]
                kept = {0}
                for n, _ in blocks:
                    while n not in kept:
                        kept.add(n)
                        n = tree.parent[n]
                order = sorted(kept)
                at = {n: i for i, n in enumerate(order)}
                sign = 0
                for t in sorted((t for _, t in blocks), key=len, reverse=True)[:3]:
                    sign = html_tree.joint(sign, html_tree.text_hash(t))
                rows.append((_signed(sign), [at[tree.parent[n]] for n in order], [tree.flags[n] for n in order], [at[n] for n, _ in blocks],
                             [_signed(slot[n]) for n, _ in blocks], [_signed(path[n]) for n, _ in blocks], [t for _, t in blocks]))
            columns = zip(*rows, strict=True)
            arrays = [pa.array(list(c), k) for c, k in zip(columns, [pa.int64(), *kinds], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("host"), *arrays], ["page_id", "url", "host", *names])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, held = [], (None, frozenset())
        for template, parent, flags, node, slot, text in zip(*(batch.column(c).to_pylist() for c in ("template", "parent", "flags", "node", "slot", "text")), strict=True):
            if template != held[0]:
                held = template, frozenset(template or ())
            keep = html_tree.article(parent, flags, node, [len(t) for t in text], [s in held[1] for s in slot])
            texts.append("\n".join(t for t, k in zip(text, keep, strict=True) if k))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def by_size(table: DataFrame, size) -> DataFrame:
    """``table`` (written, a row for each host) marked for broadcast if ``size``, summed, is BROADCAST_MOST bytes at most."""
    total = table.agg(F.sum(size + 64)).first()[0] or 0
    return F.broadcast(table) if total <= BROADCAST_MOST else table


def templates(read: DataFrame) -> DataFrame:
    """``(host, template)``: the slots that are template on a host's pages.

    ``read`` has ``page`` (the page's sign) and, for each block, slot, tag path and a hash of the text (``hash``).
    """
    seen = read.select("host", "page", F.explode(F.arrays_zip("slot", "path", "hash")).alias("b")).select("host", "page", "b.slot", "b.path", F.col("b.hash").alias("text"))
    counts = seen.groupBy("host", "slot", "path").agg(F.countDistinct("text").alias("texts"), F.countDistinct("page").alias("pages"))
    anywhere = seen.groupBy("path").agg(F.countDistinct("text").alias("all_texts"), F.countDistinct("page").alias("all_pages"))
    usual = F.least(F.lit(1.0), (F.col("all_texts") + PRIOR) / (F.col("all_pages") + PRIOR))
    fixed = counts.join(anywhere, "path").where((F.col("texts") + PRIOR * usual) / (F.col("pages") + PRIOR) < VARIES)
    return fixed.groupBy("host").agg(F.collect_set("slot").alias("template"))  # slots of one host's reference tree


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    with scratch() as kept:
        first = saved(pages.groupBy("host").agg(F.min("page_id").alias("page_id")), "first")
        reference = pages.join(by_size(first, F.length("host")), ["host", "page_id"]).select("host", "html").mapInArrow(_trees, "host string, tree string")
        # a host whose pages all lack an id takes the empty tree; equal ids in a host: the least tree
        reference = first.select("host").join(reference.groupBy("host").agg(F.min("tree").alias("tree")), "host", "left").select("host", F.coalesce("tree", F.lit(_EMPTY)).alias("tree"))
        reference = saved(reference, "references")
        read = pages.join(by_size(reference, F.length("tree") + F.length("host")), "host").select("page_id", "url", "host", "html", "tree").mapInArrow(_read, _READ)
        # a host's own name in a text is no difference
        read = saved(read.withColumn("hash", F.transform("text", lambda t: F.xxhash64(F.when(F.col("host") == "", t).otherwise(F.replace(t, F.col("host"), F.lit("")))))), "read")
        fixed = saved(templates(read), "templates")
        kept += [read, fixed]
        fixed = by_size(fixed, 8 * F.size("template"))
    chosen = read.join(fixed, "host", "left").select("page_id", "url", "template", "parent", "flags", "node", "slot", "text")
    return chosen.mapInArrow(_choose, "page_id long, url string, text string, n_chars long")
