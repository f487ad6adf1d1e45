"""Cross-polytope hashing: the same recall for every number of joined hashes, and odd vectors."""

import numpy as np
import pytest

from clicklog.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<double>"


@pytest.mark.parametrize(("width", "joined"), [(2, 1), (3, 1), (8, 2), (32, 3), (64, 3), (64, 4), (64, 5), (256, 3), (256, 4)])
def test_recall_at_the_threshold_does_not_depend_on_the_joined_hashes(width, joined):
    rng = np.random.default_rng(width + joined)
    x, z = rng.normal(size=(2, 400, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
    tables = embedding_dedup.tables_for(width, joined)
    a, b = (embedding_dedup.keys(v, tables, joined).reshape(400, tables, -1) for v in (x, y))
    assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean() > 0.95


@pytest.mark.parametrize("width", [1, 2, 5, 64, 768])
def test_tables_stay_bounded_at_any_size(width):
    for n in (1, 10**4, 10**7, 10**10):
        tables, joined = embedding_dedup.shape(width, n)
        assert 1 <= tables <= embedding_dedup.MOST_TABLES and joined >= 1


def test_lengths_link_apart_and_equal_vectors_count_as_many(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(40)]
    rows += [(100 + i, [1.0, 2.0, 3.0]) for i in range(4)] + [(110, [1.0, 2.0, 3.3]), (111, [-1.0, 0.0, 1.0])] + [(200 + i, [5.0]) for i in range(3)] + [(210, [-5.0])]
    rows += [(300, [1e300, 1e300]), (301, [1e-300, 1e-300]), (302, [2.0, 2.0])] + [(400 + i, [0.0] * 63 + [1.0]) for i in range(900)]
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == len(rows) and all(out[i] == (0, i, True) for i in range(40))
    assert all(out[i] == (4, 100, i == 100) for i in (100, 101, 102, 103, 110)) and out[111] == (0, 111, True)
    assert all(out[i] == (2, 200, i == 200) for i in (200, 201, 202)) and out[210] == (0, 210, True)
    assert [out[i][:2] for i in (300, 301, 302)] == [(2, 300)] * 3
    assert all(out[400 + i] == (899, 400, i == 0) for i in range(900))


def test_repeated_ids_ties_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0, 0.0], 7, "x"), (1, [0.0, 1.0, 0.0], 7, "x"), (2, [0.0, 1.0, 0.0], 7, "x"), (3, [9.0, 4.0, 1.0], 7, "x"), (None, [0.0, 1.0, 0.0], 7, "x"), (5, None, 7, "x")]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id int, embedding array<float>, id long, bucket string"))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    # (1, 0, 0) links with (9, 4, 1); the three equal vectors with one another, under whatever id
    want = [(0, 2, 1, False), (1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (5, 0, 5, True)]
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in out.collect()) == want


def test_rows_of_one_id_or_none_link_like_any_others(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 16))
    rows = [(None if i % 3 == 0 else i // 4, (base[i % 12] + rng.normal(0, 0.05, 16) * (i % 2)).tolist()) for i in range(90)]
    rows += [(None, [5.0] * 16), (None, [5.0] * 16), (None, rng.normal(size=16).tolist())]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    part = np.arange(len(rows))
    for _ in rows:
        part = np.array([min(part[i], *part[near[i]]) if near[i].any() else part[i] for i in range(len(rows))])
    want = []
    for i, (vec_id, _) in enumerate(rows):
        least = min((rows[k][0] for k in np.flatnonzero(part == part[i]) if rows[k][0] is not None), default=None)
        want.append((vec_id, int(near[i].sum()), least, vec_id is not None and vec_id == least))
    got = [tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(w[1] for w in want) > 200
