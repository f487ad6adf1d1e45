"""Click models against direct recursions, identities, gradients by finite differences, and recovery."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clicklog.functions import exprs
from clicklog.operators import fit, metrics, models
from clicklog.operators.params import Param, constant

DOCS = 12


def logit(p):
    return math.log(p / (1 - p))


ALPHA = {d: (1 + d % 7) / 9 for d in range(DOCS)}
SIGMA = {d: (1 + d % 5) / 7 for d in range(DOCS)}
GO = {k: 0.9 / k for k in range(1, 14)}


def param(spark, name, table, key):
    rows = [(int(k), float(logit(v))) for k, v in table.items()]
    return Param(name, (key,), spark.createDataFrame(rows, f"{key} long, logit double"))


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(4)
    rows = []
    for s in range(60):
        n = rng.randint(1, 8)
        for k in range(1, n + 1):
            click = {0: 0, 1: 1}.get(s, int(rng.random() < 0.35))
            rows.append((s, k, rng.randrange(DOCS), click, n, 1.0 / n))
    return spark.createDataFrame(rows, "session_id long, position int, query_doc_id long, click int, n int, w double").cache()


def sessions(log):
    out = {}
    for r in sorted(log.collect(), key=lambda r: (r.session_id, r.position)):
        out.setdefault(r.session_id, []).append(r)
    return out


def chain(rows, after_click, after_skip, alpha):
    """Examination by the recursion over ranks."""
    e, out = 1.0, []
    for r in rows:
        a = alpha[r.query_doc_id]
        out.append(math.log(e * a))
        e = after_click(r) if r.click else (1 - a) * e * after_skip / (1 - a * e)
    return out


def built(spark, kind):
    a = param(spark, "attraction", ALPHA, "query_doc_id")
    if kind == "dcm":
        return models.DependentClick(a, param(spark, "continuation", GO, "position")), lambda r: GO[r.position], 1.0
    if kind == "ccm":
        return models.ClickChain(a), lambda r: ALPHA[r.query_doc_id] * 0.3 + (1 - ALPHA[r.query_doc_id]) * 0.6, 0.8
    going = 1.0 if kind == "sdbn" else 0.9
    return models.DynamicBayesian(a, param(spark, "satisfaction", SIGMA, "query_doc_id"), going), lambda r: going * (1 - SIGMA[r.query_doc_id]), going


@pytest.mark.parametrize("kind", ["dcm", "ccm", "dbn", "sdbn"])
def test_conditional_is_the_recursion(spark, log, kind):
    model, click, skip = built(spark, kind)
    got = {(r.session_id, r.position): r.cond_log_prob for r in model.score(log, ("cond_log_prob",)).collect()}
    for rows in sessions(log).values():
        for r, want in zip(rows, chain(rows, click, skip, ALPHA), strict=True):
            assert got[r.session_id, r.position] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("kind", ["dcm", "ccm", "dbn"])
def test_unconditional_sums_over_histories(spark, kind):
    rows = [(0, k, d, 0) for k, d in enumerate((3, 5, 8), 1)]
    one = spark.createDataFrame(rows, "session_id long, position int, query_doc_id long, click int")
    model, click, skip = built(spark, kind)
    got = [math.exp(r.log_prob) for r in model.score(one, ("log_prob",)).orderBy("position").collect()]

    class R:
        def __init__(self, row, c):
            self.position, self.query_doc_id, self.click = row[1], row[2], c

    want = [0.0] * 3
    for bits in range(8):
        seen = [R(r, bits >> i & 1) for i, r in enumerate(rows)]
        p = 1.0
        for r, lp in zip(seen, chain(seen, click, skip, ALPHA), strict=True):
            p *= math.exp(lp) if r.click else 1 - math.exp(lp)
        for i in range(3):
            want[i] += p * seen[i].click
    assert got == pytest.approx(want, abs=1e-9)


def test_ubm_without_history_is_pbm(spark, log):
    a = param(spark, "attraction", ALPHA, "query_doc_id")
    theta = {k: 1 / (k + 1) for k in range(1, 9)}
    grid = spark.createDataFrame([(k, j, logit(v)) for k, v in theta.items() for j in range(k)], "position int, last_pos int, logit double")
    ubm = models.UserBrowsing(a, Param("history", ("position", "last_pos"), grid)).score(log)
    pbm = models.PositionBased(a, param(spark, "examination", theta, "position")).score(log)
    key = lambda df: {(r.session_id, r.position): (r.cond_log_prob, r.log_prob) for r in df.collect()}
    one, two = key(ubm), key(pbm)
    assert all(one[k] == pytest.approx(two[k], abs=1e-9) for k in two) and len(one) == len(two)


def test_mixture_of_one_model_is_that_model(spark, log):
    model, _, _ = built(spark, "dbn")
    mixed = models.Mixture({"m": model}, {"m": 1.0}).score(log).orderBy("session_id", "position").collect()
    alone = model.score(log).orderBy("session_id", "position").collect()
    for x, y in zip(mixed, alone, strict=True):
        assert (x.cond_log_prob, x.log_prob, x.relevance) == pytest.approx((y.cond_log_prob, y.log_prob, y.relevance), abs=1e-9)


def loss(model, log):
    return model.score(log, ("cond_log_prob",)).agg(F.sum(F.col("w") * exprs.bce_log(F.col("click"), F.col("cond_log_prob")))).first()[0]


@pytest.mark.parametrize("kind", ["dbn", "ccm", "dcm", "cm"])
def test_gradients_by_finite_differences(spark, log, kind):
    tables = {"a": dict(ALPHA), "s": dict(SIGMA), "c": dict(GO)}

    def make(shift=None):
        t = {n: {k: logit(v) for k, v in x.items()} for n, x in tables.items()}
        if shift:
            t[shift[0]][shift[1]] += shift[2]
        p = {n: param(spark, f"p{n}", {k: 1 / (1 + math.exp(-v)) for k, v in t[n].items()}, "position" if n == "c" else "query_doc_id") for n in t}
        return {"dbn": lambda: models.DynamicBayesian(p["a"], p["s"], 0.9), "ccm": lambda: models.ClickChain(p["a"]), "dcm": lambda: models.DependentClick(p["a"], p["c"]), "cm": lambda: models.Cascade(p["a"])}[kind]()

    def slope(table, key):
        h = 1e-4
        return (loss(make((table, key, h)), log) - loss(make((table, key, -h)), log)) / (2 * h)

    if kind == "dbn":
        g = {r.query_doc_id: r for r in fit.dbn_gradients(log, make()).collect()}
        assert g[4].g_attraction == pytest.approx(slope("a", 4), abs=1e-5)
        assert g[4].g_satisfaction == pytest.approx(slope("s", 4), abs=1e-5)
    elif kind == "dcm":
        by_doc, by_pos = fit.dcm_gradients(log, make())
        assert {r.query_doc_id: r.g_attraction for r in by_doc.collect()}[4] == pytest.approx(slope("a", 4), abs=1e-5)
        assert {r.position: r.g_continuation for r in by_pos.collect()}[2] == pytest.approx(slope("c", 2), abs=1e-5)
    elif kind == "ccm":
        assert {r.query_doc_id: r.g_attraction for r in fit.ccm_gradients(log, make()).collect()}[4] == pytest.approx(slope("a", 4), abs=1e-5)
    else:
        assert {r.query_doc_id: r.g_attraction for r in fit.cascade_gradients(log, make()).collect()}[4] == pytest.approx(slope("a", 4), abs=1e-5)


def test_em_never_raises_the_loss_and_recovers_products(spark):
    theta = {k: 1 / k for k in range(1, 6)}
    rng = np.random.default_rng(0)
    rows = [(s, k, int(d), int(rng.random() < theta[k] * ALPHA[int(d)]), 5, 0.2) for s in range(4000) for k, d in enumerate(rng.integers(0, 6, 5), 1)]
    log = spark.createDataFrame(rows, "session_id long, position int, query_doc_id long, click int, n int, w double")
    a, t, losses = fit.fit_product(fit.cells(log, ["query_doc_id", "position"]), ["position"], 15, 0.0)
    assert all(x >= y - 1e-9 for x, y in zip(losses, losses[1:], strict=False))
    a, t = {r[0]: r[1] for r in a.collect()}, {r[0]: r[1] for r in t.collect()}
    for d in range(6):
        assert a[d] * t[1] == pytest.approx(ALPHA[d], abs=0.06)


def test_samples_follow_the_model(spark):
    rows = [(s, k, k % DOCS) for s in range(5000) for k in range(1, 5)]
    log = spark.createDataFrame(rows, "session_id long, position int, query_doc_id long").withColumn("click", F.lit(0))
    for kind in ("dcm", "ccm", "dbn"):
        model, _, _ = built(spark, kind)
        seen = {r[0]: r[1] for r in model.sample(log).groupBy("position").agg(F.avg("sim_click")).collect()}
        want = {r.position: math.exp(r.log_prob) for r in model.score(log.where("session_id = 0"), ("log_prob",)).collect()}
        assert all(abs(seen[k] - want[k]) < 0.05 for k in want)


def test_metrics_of_the_worked_case(spark):
    rows = [(1, 1, 1, -0.01), (1, 2, 0, -10.0), (1, 3, 1, -0.7)]
    log = spark.createDataFrame(rows, "session_id long, position int, click int, cond_log_prob double").withColumn("log_prob", F.col("cond_log_prob"))
    assert metrics.log_likelihood(log).first().ll == pytest.approx(-0.236682, abs=1e-5)
    assert metrics.perplexity(log).first().ppl == pytest.approx(1.341283, abs=1e-5)
    ranks = {r.position: r.ppl for r in metrics.perplexity_per_rank(log).collect()}
    assert [ranks[k] for k in (1, 2, 3)] == pytest.approx([1.010050, 1.000045, 2.013753], abs=1e-5)


def test_ranking_without_relevant_documents_is_zero(spark):
    rows = [(1, 1, 0, 0.3), (1, 2, 0, 0.9), (2, 1, 2, 0.1), (2, 2, 0, 0.5)]
    out = metrics.ranking(spark.createDataFrame(rows, "query_id long, doc_ord int, label int, score double"), "mrr", (10,)).first()
    assert out.mrr_10 == pytest.approx(0.25)


def test_unseen_keys_take_the_baseline(spark):
    rows = spark.createDataFrame([(1, 1, 99)], "session_id long, position int, query_doc_id long")
    p = Param("attraction", ("query_doc_id",), spark.createDataFrame([(1, 0.0)], "query_doc_id long, logit double"), baseline=logit(0.25))
    assert math.exp(models.RateModel(p).score(rows.withColumn("click", F.lit(0))).first().log_prob) == pytest.approx(0.25)
    assert math.exp(models.RateModel(constant("g", 0.3)).score(rows.withColumn("click", F.lit(0))).first().log_prob) == pytest.approx(0.3)


def test_binned_metrics_merge_and_come_near_their_exact_values(spark):
    rng = np.random.default_rng(5)
    p = rng.random(3000)
    rows = [(i, 1, int(rng.random() < q), 1.0, float(np.log(q)), float(np.log(q))) for i, q in enumerate(p)]
    scored = spark.createDataFrame(rows, "session_id long, position int, click int, w double, cond_log_prob double, log_prob double")
    click = np.array([r[2] for r in rows])
    exact = (p[click == 1][:, None] > p[click == 0][None, :]).mean()
    prob = F.exp("log_prob")
    auc, error = metrics.auc(prob), metrics.calibration_error(prob)
    out = metrics.evaluate_clicks(scored, states={"auc": auc, "error": error}).first()
    assert out.test_auc == pytest.approx(exact, abs=1e-3) and out.test_error < 0.05
    for metric, value in ((auc, out.test_auc), (error, out.test_error)):
        parts = [metrics.state(scored.where(F.col("session_id") % 4 == k), metric) for k in range(4)]
        assert metrics.finished(metrics.merged(parts), metric, "x").first().x == pytest.approx(value, abs=1e-12)
    one = scored.where("click = 1").limit(5)
    assert metrics.finished(metrics.state(one, auc), auc, "x").first().x is None  # no skip to compare with
