"""The training-data operators against brute force, on small fixtures with nulls, empties, ties and clashing names."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clicklog.llm import decontaminate, embedding_dedup, html_extract, language_id, mixing, ngram_join, quality, sharding, store, toxicity, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd(spark):
    """Nulls, empty and long texts, repeated rows, and a column whose name clashes with results."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None, None, "x"), (2, "", "a", "x"), (3, "  \n ", "a", "x"), (4, "one two", "b", "x"), (4, "one two", "b", "x"), (None, "one two three four five six", None, "x"), (7, long, "b", "x"), (8, "ONE  two", "a", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def empty(df):
    return df.where("1 = 0")


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [tuple(map(int, rng.integers(0, 400, 2))) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)]
    nodes = {x for p in links for x in p}
    want = components(nodes, links)
    got = {r.node: r.component for r in store.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == want


def test_sharding_balances_whole_groups(spark, docs):
    out = sharding.shards(docs, cell=16, fan_in=3).join(docs.select("doc_id", "text"), "doc_id").toPandas()
    assert len(out) == docs.count() and set(out["shard"]) <= set(range(16))
    assert out.groupby("text")["shard"].nunique().max() == 1
    assert (out["text_crc32"] == [zlib.crc32(t.encode()) for t in out["text"]]).all()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    load, largest = out.groupby("shard")["size"].sum(), out.groupby("text")["size"].sum().max()
    assert load.max() <= max(1.2 * load.mean(), largest)


def test_differencing_is_near_even():
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(1, 5000, 400)]
    parts = sharding.difference([[s] + [0] * 7 for s in sizes], 8)
    load = np.bincount([p[0] for p in parts], sizes, 8)
    assert load.max() - load.min() <= 5
    assert all(sorted(p) == list(range(8)) for p in parts)


def test_sharding_of_odd_rows(spark):
    out = sharding.shards(odd(spark)).toPandas()
    assert len(out) == 8 and out.loc[out["doc_id"] == 1, "size"].item() == 1
    assert sharding.shards(empty(odd(spark))).count() == 0


@pytest.mark.parametrize("url,host,path,rule", [
    ("http://a.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/"), ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/"),
    ("https://x.org/fr/", "x.org", "/fr/", "org/fr/"), ("http://b.net", "b.net", "", None), ("http://b.net/", "b.net", "/", "net/"),
    ("nothing", "", "", None), (None, "", "", None), ("a://b://c/d", "b:", "//c/d", None), ("http://xnet/", "xnet", "/", None), ("http://h#x/y", "h", "", None),
])
def test_url_rules(spark, url, host, path, rule):
    out = url_filter.filter_urls(spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")).first()
    assert (out.host, out.path, out.rule) == (host, path, rule)
    assert out.verdict == ({"example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow", "net/": "block"}.get(rule) or ("block" if out.block_score >= 0.5 else "allow"))


def test_url_model_tells_its_own_labels(spark):
    rows = [(i, u) for i, (u, _) in enumerate(url_filter.LABELLED)]
    out = {r.page_id: r.block_score for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=[]).collect()}
    assert np.mean([(out[i] >= 0.5) == bool(y) for i, (_, y) in enumerate(url_filter.LABELLED)]) > 0.95
    assert url_filter.filter_urls(empty(spark.createDataFrame(rows, "page_id long, url string"))).count() == 0


def test_decontamination_finds_exact_and_paraphrased_items(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("mor", "lin", "tas", "vek", "dun", "zil")]
    word = lambda n: [str(x) for x in rng.choice(vocabulary, n)]
    items = [word(30) for _ in range(12)]
    altered = items[1].copy()
    for k in range(0, 20, 5):
        altered[k] = "other"
    rows = [(1, word(400) + items[0] + word(100)), (2, word(50) + altered + word(80)), (3, word(600)), (4, items[2]), (5, [])]
    texts = [(i, " ".join(w)) for i, w in rows] + [(6, None), (7, " ".join(items[3]).upper())]
    out = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(99, None)], "item_id long, text string"), items_a_block=7)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == {(1, 0), (2, 1), (4, 2), (7, 3)}
    kept = decontaminate.clean(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(0, " ".join(items[0]))], "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {2, 3, 4, 5, 6, 7}


def test_decontamination_against_brute_force(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split())
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if f" {plain(b.text)} " in f" {plain(d.text)} "}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert want <= got and len(got - want) <= 1
    assert decontaminate.contaminated(empty(docs), bench).count() == 0
    assert decontaminate.contaminated(docs, empty(bench)).count() == 0


def part_of(rng, item, share, last=0):
    """``share`` of the item's words in their order, the ``last`` ones among them, with other words between."""
    n = -(-len(item) * share // 100)
    keep = {*range(len(item) - last, len(item)), *rng.choice(len(item) - last, max(0, n - last), replace=False).tolist()}
    return [w for i, w in enumerate(item) for w in ([w] if i in keep else ["between"])]


@pytest.mark.parametrize(("n", "rank"), [(1000, 192), (5000, 192), (300, 16)])
def test_decontamination_of_benchmarks_of_any_size(spark, n, rank):
    rng = np.random.default_rng(n)
    vocabulary = np.array([f"{a}{b}{c}" for a in ("bor", "cal", "dem", "fin", "gus", "hav", "jel", "kir", "lom", "mun") for b in "aeiou" for c in ("mor", "lin", "tas", "vek", "dun", "zil", "par", "quo", "ster", "wix", "yon", "zum")])
    chance = 1 / np.arange(1, len(vocabulary) + 1)
    word = lambda k: rng.choice(vocabulary, k, p=chance / chance.sum()).tolist()
    items = [word(int(k)) for k in rng.integers(15, 60, n - 4)] + [word(600) for _ in range(4)]
    used = [*rng.choice(n - 4, 60, replace=False).tolist(), *range(n - 4, n)]
    rows = []
    for at, j in enumerate(used):
        held = [items[j], part_of(rng, items[j], 80), part_of(rng, items[j], 50, 8)]
        rows += [(3 * at + k, " ".join(word(70) + h + word(50))) for k, h in enumerate(held)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.lcs, r.answer) for r in decontaminate.contaminated(docs, bench, rank=rank).collect()}
    assert not [(i, j) for at, j in enumerate(used) for i in range(3 * at, 3 * at + 3) if (i, j) not in found]
    assert all(c >= 0.8 or c >= 0.5 and a >= 0.8 for c, a in found.values())
    # of a few documents, all items that some stretch of text holds by the rule
    for i in rng.choice(len(rows), 2, replace=False).tolist():
        text = rows[i][1].split()
        code = {w: k for k, w in enumerate(dict.fromkeys([*vocabulary.tolist(), "between"]))}
        for j in range(min(n, 400)):
            a = np.array([code[w] for w in items[j]])
            b = np.array([code[w] for w in text])
            held = max(decontaminate.common_subsequence(a, b[s : s + len(a)]) for s in range(0, max(1, len(b) - len(a) + 1), 5)) / len(a)
            assert held < 0.8 or (i, j) in found
    assert decontaminate.clean(docs, bench, rank=rank).count() == 0


def test_decontamination_of_long_and_halved_passages(spark):
    rng = np.random.default_rng(21)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 4000, k)]
    items = [word(k) for k in (15, 16, 20, 30, 700, 1500)]
    rows = [(10 * j + k, " ".join(word(60) + h + word(60))) for j, item in enumerate(items) for k, h in enumerate([item, part_of(rng, item, 80), part_of(rng, item, 50, 8), part_of(rng, item, 30)])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(10 * j + k, j) for j in range(len(items)) for k in range(3)}


def test_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(30):
        a, b = rng.integers(0, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(0, 30))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.common_subsequence(a, b) == t[-1, -1]


def test_toxicity_finds_marked_documents(spark):
    rng = np.random.default_rng(6)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 300, n))
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [(i, ((f"{word(20)} vilething " if i % 4 == 0 else "") + word(60)).translate(letters)) for i in range(400)] + [(900, None), (901, "")]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 > 0 and 1 or 0, int(i % 4 == 0)) for i in range(300)] + [(5, None, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.is_toxic for r in toxicity.judge(table.withColumn("p_toxic", F.lit("x")), toxicity.train(table, labels)).collect()}
    assert len(out) == 402 and not out[900] and not out[901]
    assert np.mean([out[i] == (i % 4 == 0) for i in range(300, 400)]) > 0.95
    assert toxicity.judge(table, toxicity.train(table, empty(labels))).where("is_toxic").count() == 0


def test_ngram_join_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    base = " ".join(f"t{i}" for i in range(120)).split()
    for k in range(25):
        copy = base.copy()
        for j in range(k % 4):
            copy[(k * 13 + j * 41) % 120] = f"edit{k}"
        rows.append((5000 + k, " ".join(copy)))
    rows += [(6000, None), (6001, ""), (6002, "a b"), (6003, "A  b"), (6004, "b a")]
    want_sets = {i: sets(t) for i, t in rows}
    links = [(i, j) for n, (i, x) in enumerate(want_sets.items()) for j, y in list(want_sets.items())[n + 1 :] if x and y and 5 * len(x & y) >= 4 * len(x | y)]
    want = components(want_sets, links)
    got = {r.doc_id: r for r in ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i].n_shingles for i in want} == {i: len(s) for i, s in want_sets.items()}
    assert {i: got[i].component_id for i in want} == want


def test_ngram_join_of_odd_rows(spark):
    out = ngram_join.join_components(odd(spark)).collect()
    assert len(out) == 8
    by = {(r.doc_id): r for r in out}
    assert by[1].n_shingles == 0 and by[1].component_id == 1 and by[8].component_id == 4 and by[None].component_id is None
    assert ngram_join.join_components(empty(odd(spark))).count() == 0


def test_mixing_meets_targets(spark, docs):
    out = mixing.mix(docs.select("doc_id", "text", "source")).toPandas()
    assert (out["size"] == [len(t.encode().split()) for t in out.merge(docs.select("doc_id", "text").toPandas(), on="doc_id")["text"]]).all()
    by = out.groupby("source").agg(s=("size", "sum"), t=("target", "first"), k=("taken", "sum"))
    assert (abs(by["t"] - by["k"]) <= 1).all() and (out["taken"] <= 3 * out["size"]).all()
    again = mixing.mix(docs.select("doc_id", "text", "source").repartition(3)).toPandas()
    assert dict(zip(out["doc_id"], out["taken"], strict=True)) == dict(zip(again["doc_id"], again["taken"], strict=True))


def test_mixing_of_odd_rows(spark):
    out = mixing.mix(odd(spark)).toPandas()
    assert len(out) == 8 and out["taken"].sum() > 0
    assert out[out["source"].isna()]["source_size"].iloc[0] == 6
    assert mixing.mix(empty(odd(spark))).count() == 0


def shared_out(sizes, weights=(1, 2, 3), epochs=3):
    """Targets of sources in order, by rounds over a list."""
    total, full = sum(sizes), set()
    while True:
        rest, free = total - sum(epochs * sizes[i] for i in full), sum(weights[i % 3] for i in range(len(sizes)) if i not in full)
        out = [epochs * s if i in full else rest * weights[i % 3] / free for i, s in enumerate(sizes)]
        above = {i for i in range(len(sizes)) if i not in full and out[i] > epochs * sizes[i]}
        if not above:
            return out
        full |= above


def test_targets_share_excess(spark):
    rng = np.random.default_rng(9)
    for sizes in ([10, 1, 89, 0], [5], [0, 0], [int(2 ** rng.uniform(0, 16)) for _ in range(60)]):
        names = [f"s{i:03d}" for i in range(len(sizes) - 1)] + [None]
        got = mixing.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long").repartition(3)).collect()
        by = {r.source: r.target for r in got}
        assert [by[n] for n in names] == pytest.approx(shared_out(sizes))


def test_language_id(spark, docs):
    model = language_id.train(language_id.learnable(docs))
    out = language_id.identify(docs, model).withColumn("h", language_id.held_out()).toPandas()
    held = out[out["h"] & out["lang"].notna()]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert out["rejected"].mean() < 0.02
    odd_out = {(r.doc_id): r for r in language_id.identify(odd(spark), model).collect()}
    assert odd_out[1].lang_pred == odd_out[2].lang_pred == odd_out[3].lang_pred == "und" and odd_out[4].lang_pred in model.langs
    assert language_id.identify(docs, language_id.train(empty(docs))).where("lang_pred <> 'und'").count() == 0


def test_quality(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ranking = quality.train(docs, labels)
    out = quality.rank(docs.join(labels, "doc_id").withColumn("score", F.lit("x")), ranking).where(quality.held_out()).toPandas()
    good, bad = out[out["quality"] == 1]["score"].to_numpy(), out[out["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97 and out["score"].between(0, 1).all()
    assert quality.rank(odd(spark), ranking).count() == 8
    assert quality.rank(odd(spark), quality.train(docs, empty(labels))).where("score <> 0.5").count() == 0


PAGE = """<html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>{n}</a><li>{n} two</ul></nav>
<div class="ad">{n} buy</div><header>Site</header><article><h1>{t}</h1><p><b>{t} one&amp;two<br><p>more   {t}
text</p></article><div class="comments"><p>nice {t}</div><footer>&copy; {n}</footer></body></html>"""


def test_html_extraction(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(n="menu", t=f"title {i}")) for i in range(40)]
    rows += [(100, None, None), (101, "http://h0.example/", ""), (102, "no scheme", "just text"), (103, "http://solo.example/", PAGE.format(n="m", t="alone"))]
    out = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == len(rows)
    assert all(out[i].text == f"title {i}\ntitle {i} one&two\nmore title {i} text" for i in range(40))
    assert out[100].text == out[101].text == "" and out[102].text == "just text" and out[103].text == "alone\nalone one&two\nmore alone text"
    assert out[0].n_chars == len(out[0].text)
    assert html_extract.extract(empty(spark.createDataFrame(rows, "page_id long, url string, html string"))).count() == 0


def test_wrapper_drops_constant_slots_without_telling_names(spark):
    page = "<body><div><div>Menu of the site</div><div><p>{t} first</p><p>{t} second words</p></div><div>Bottom line</div></div></body>"
    rows = [(i, f"http://w.example/{i}", page.format(t=f"story {i}")) for i in range(30)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"story {r.page_id} first\nstory {r.page_id} second words" for r in out)


def test_names_that_only_mention_something_else_keep_the_article(spark):
    inner = "<article><h1>{t}</h1><p>{t} has a long text of its own</p></article>"
    bare = "<div><p>{t} has a long text of its own</p></div>"
    keep = [f'<div class="{c}">{inner}</div>' for c in ("layout with-sidebar", "has-sidebar", "post no-comments", "social-science", "legal-text", "sidebar")]
    keep += [f'<div id="header-and-content">{inner}</div>', f'<div class="search">{bare}</div>', f'<div class="social-science">{bare}</div>', f'<div class="layout with-sidebar"><div class="left-sidebar"><p>see {{t}}</p></div>{inner}</div>']
    drop = [f'<div>{inner}</div><div class="{c}"><p>see {{t}}</p></div>' for c in ("sidebar", "left-sidebar", "comment-list", "comments-area", "ad-300x250", "related-posts", "sidebar2")]
    drop += [f'<div>{inner}</div><div role="complementary"><article class="teaser"><p>see {{t}}</p></article></div>', f'<div>{inner}</div><div aria-label="Site navigation"><p>see {{t}}</p></div>']
    pages = [(100 * h + i, f"http://h{h}.example/{i}", f"<body>{p.format(t=f'title {h} {i}')}</body>") for h, p in enumerate(keep + drop) for i in range(10)]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    wrong = {h for h in range(len(keep + drop)) for i in range(10) if out[100 * h + i] != ("" if h in (7, 8) else f"title {h} {i}\n") + f"title {h} {i} has a long text of its own"}
    assert len(out) == len(pages) and not wrong


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    hub = unit(rng.normal(size=32))
    x = np.concatenate([rng.normal(size=(200, 32)), hub + 0.04 * rng.normal(size=(150, 32)), hub + 0.07 * rng.normal(size=(40, 32)), np.repeat(rng.normal(size=(1, 32)), 20, 0)])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    extra = [(900, None), (901, [0.0] * 32), (902, [None] * 32), (903, [float("nan")] * 32), (904, [1.0]), (905, []), (None, [1.0] * 32)]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>"), block=32).toPandas()
    assert len(out) == len(rows) + len(extra)
    y = unit(x)
    same = y @ y.T >= 0.9
    np.fill_diagonal(same, False)
    got = out[out["vec_id"] < len(rows)].sort_values("vec_id")
    found = got["n_links"].to_numpy()
    assert (found <= same.sum(1)).all() and found.sum() >= 0.95 * same.sum()
    want = components(range(len(rows)), list(zip(*np.nonzero(np.triu(same)), strict=True)))
    assert np.mean(got["component_id"].to_numpy() == [want[i] for i in range(len(rows))]) > 0.95
    assert (out[out["vec_id"] >= 900]["n_links"] == 0).all()
    assert embedding_dedup.near_duplicates(empty(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).count() == 0


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = set(out["doc_id"])
    shingles = {i: sets(texts[i]) for i in kept}
    ids = sorted(kept)
    assert not [(i, j) for n, i in enumerate(ids) for j in ids[n + 1 :] if 5 * len(shingles[i] & shingles[j]) >= 4 * len(shingles[i] | shingles[j]) and shingles[i]]
    assert len(kept) > 0.5 * len(texts) and set(out["shard"]) == set(range(16))
    leaks = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert not kept & leaks


def test_near_copies_go_by_text_and_not_by_id(spark):
    import corpus_pipeline

    text = lambda name, last="end": " ".join([f"{name}{i}" for i in range(60)] + [last])
    rows = [(1, text("a")), (1, text("a")), (1, text("b")), (2, text("a", "stop")), (3, text("c")), (3, text("c", "stop")), (None, text("d")), (None, text("d")), (None, text("e")), (None, text("c")), (4, text("e"))]
    out = corpus_pipeline.without_near_copies(spark, spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string"), "").collect()
    got = sorted((r.doc_id or 0, r.text.split()[0]) for r in out)
    assert got == [(0, "d0"), (1, "a0"), (1, "b0"), (3, "c0"), (4, "e0")]
