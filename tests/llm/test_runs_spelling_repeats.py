"""Periodic runs, spelling variants and repeated passages against brute force; odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clicklog.llm import periodic_runs, queries, spelling, substring_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^ \t-\r]+")
SCHEMA = "doc_id long, text string"


# ---- periodic runs


def brute_runs(ids, least=12):
    n, seen = len(ids), {}
    for q in range(1, n // 2 + 1):
        k = 0
        while k + q < n:
            start = k
            while k + q < n and ids[k] == ids[k + q]:
                k += 1
            if k > start and k + q - start >= max(least, 2 * q):
                seen.setdefault((start, k + q), q)
            k += k == start
    return sorted(((s, e, q) for (s, e), q in seen.items()), key=lambda r: (r[0], r[2]))


def test_cover_reaches_every_difference():
    assert {(a - b) % periodic_runs.MODULUS for a in periodic_runs.COVER for b in periodic_runs.COVER} == set(range(periodic_runs.MODULUS))


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_are_those_of_brute_force(letters):
    rng = np.random.default_rng(letters)
    for trial in range(150):
        n = int(rng.integers(0, 300))
        ids = rng.integers(0, letters, n)
        if trial % 3 == 0 and n:
            start = int(rng.integers(0, n))
            period = 1 + (n - start) // int(rng.integers(3, 11))
            ids = ids[np.where(np.arange(n) < start, np.arange(n), start + (np.arange(n) - start) % period)]
        assert [tuple(r) for r in periodic_runs.runs_of(ids).tolist()] == brute_runs(ids.tolist())


def test_extensions_in_a_text_beyond_the_small_grid():
    rng = np.random.default_rng(9)
    part = rng.integers(0, 1000, 4000)
    ids = np.concatenate([part, part, part[:1000], rng.integers(0, 1000, 3000)])
    assert periodic_runs.runs_of(ids).tolist() == [[0, 9000, 4000]]
    ext = periodic_runs.Extensions(ids)
    i = rng.integers(0, 5000, 300)
    assert (ext.extend(i, i + 4000) == np.maximum(9000 - i - 4000, 0) + (i + 4000 >= 9000) * 0).all()


def test_query_rows_follow_from_the_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got.values()) > 10
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        runs = brute_runs(words)
        dropped = {i for s, e, q in runs for i in range(s + q, e)}
        best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
        r = got[doc_id]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == ((best[0], best[1] - best[0], best[2]) if best else (None,) * 3)
        assert r.exponent_milli == (1000 * (best[1] - best[0]) // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest()


# ---- spelling variants


def brute_variants(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    n = {w: k for w, k in n.items() if k >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, count = {}, {}
    for w in n:
        of = [x for x in n if near(w, x)]
        best = min(of, key=lambda x: (-n[x], x), default=None)
        form[w], count[w] = best if best and n[best] >= 10 * n[w] else None, len(of)
    root = {}
    for w in n:
        root[w] = w
        while form[root[w]]:
            root[w] = form[root[w]]
    return {(w, form[w], root[w], n[w], count[w], n.get(form[w])) for w in n}


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeiénlrstÀ×ÿ") for _ in range(rng.randint(7, 11))) for _ in range(60)] + ["abcdefg" * 12]

    def edited(w):
        k, c = rng.randrange(len(w)), rng.choice("abeié")
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])

    pool = base + [edited(w) for w in base for _ in range(4)]
    pool += [edited(w) for w in pool[:100]]
    docs = [(i if i % 17 else None, " ".join(rng.choice(base if rng.random() < 0.8 else pool) for _ in range(rng.randint(0, 150)))) for i in range(120)]
    return docs + [(5, None), (6, ""), docs[3], docs[3]]


@pytest.mark.parametrize("most", [20_000, 20, 1])
def test_variants_are_those_of_brute_force_at_any_cut(spark, misspelt, most):
    docs = spark.createDataFrame(misspelt, SCHEMA).withColumns({c: F.lit(c) for c in ("word", "n", "subtree", "half")})
    got = [tuple(r) for r in spelling.variants(docs, most=most).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants(misspelt)
    assert sum(g[1] is not None for g in got) > 50


def test_no_words_no_rows(spark):
    assert spelling.variants(spark.createDataFrame([(1, None), (2, ""), (3, "short ones only")], SCHEMA)).count() == 0
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0


# ---- repeated passages


def brute_repeats(docs, width=13):
    first = {}
    for doc_id, text in docs:
        words = WORD.findall(text or "")
        for i in range(len(words) - width + 1):
            if doc_id is not None:
                key = tuple(words[i : i + width])
                first[key] = min(doc_id, first.get(key, doc_id))
    out = []
    for doc_id, text in docs:
        words = WORD.findall(text or "")
        gone = {j for i in range(len(words) - width + 1) for j in range(i, i + width) if doc_id is not None and first[tuple(words[i : i + width])] < doc_id}
        out.append((doc_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def copied():
    rng = random.Random(4)
    letters = ["a", "B", "b", "cé", "dd", "e-f", " x", "z"]

    def text(n, k=8):
        return "".join(rng.choice(letters[:k]) + rng.choice([" ", "\n", " \t"]) for _ in range(n))

    passages = [text(rng.randint(10, 40)) for _ in range(12)]
    docs = []
    for i in range(150):
        parts = [text(rng.randint(0, 25), rng.choice([8, 8, 2, 1])) if rng.random() < 0.5 else rng.choice(passages) for _ in range(rng.randint(0, 8))]
        docs.append((i * 3 % 71 if i % 9 else None, " ".join(parts) if i % 13 else None))
    return docs + [docs[3], docs[4], (999, docs[5][1]), (1000, docs[5][1]), (7, ""), (8, " \n "), (9, "word " * 20_000)]


@pytest.mark.parametrize("cut", [{}, {"shard": 50, "hot": 3}, {"shard": 500, "hot": 0}])
def test_repeats_are_those_of_brute_force_at_any_cut(spark, copied, cut):
    docs = spark.createDataFrame(copied, SCHEMA).withColumns({c: F.lit(c) for c in ("doc", "t", "h", "hs", "starts", "words")})
    got = sorted((tuple(r) for r in substring_dedup.without_repeats(docs, **cut).collect()), key=str)
    assert got == brute_repeats(copied)
    assert sum(r[2] for r in got) > 1000


def test_automaton_names_the_first_document_of_a_window():
    rng = random.Random(1)
    texts = [[rng.choice("abc") for _ in range(rng.randint(0, 30))] for _ in range(60)]
    automaton = substring_dedup.Automaton()
    for k, words in enumerate(texts):
        automaton.add(words, k)
    for words in [*texts, *([rng.choice("abcd") for _ in range(30)] for _ in range(30))]:
        want = [next((k for k, t in enumerate(texts) if any(t[j : j + 5] == words[i : i + 5] for j in range(len(t) - 4))), None) for i in range(len(words) - 4)]
        assert automaton.firsts(words, 5) == want


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.without_repeats(none).count() == 0 and periodic_runs.periodic_runs(none).count() == 0
    few = spark.createDataFrame([(1, None), (None, "a b"), (2, "")], SCHEMA)
    assert sorted((r.n_words, r.n_removed) for r in substring_dedup.without_repeats(few).collect()) == [(0, 0), (0, 0), (2, 0)]
    odd = periodic_runs.periodic_runs(few.withColumns({c: F.lit(c) for c in ("runs", "n_words", "collapsed")})).collect()
    assert sorted((r.n_words, r.runs, r.collapsed) for r in odd) == [(0, [], ""), (0, [], ""), (2, [], "a b")]


@pytest.mark.parametrize("name", ["op12_spelling", "op13_substring_dedup"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    key = want.columns[0]
    got, want = (x.sort_values(key, ignore_index=True).astype(object) for x in (got, want))
    got, want = (x.where(x.notna(), None) for x in (got, want))
    assert len(want) > 100 and got.equals(want)
