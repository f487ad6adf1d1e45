"""Gradients and training of feature networks, alone and inside click models, compressed parameters, and mixtures fitted anew."""

from decimal import Decimal, localcontext
from functools import cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clicklog.functions import exprs
from clicklog.operators import compressed, features, fit, joint, metrics, models
from clicklog.operators.params import Param
from clicklog.plans import parameter_queries

NETWORKS = [features.Deep.seeded(5, (4, 3), 1), features.DeepCross(5, 2, (4, 3), True, 2), features.DeepCross(5, 2, (4, 3), False, 3)]


def by_differences(f, params, k, at, step=1e-5):
    """The slope of ``f`` (of a list of arrays) by one number."""
    ends = []
    for d in (step, -step):
        moved = [p.astype(float).copy() for p in params]
        moved[k][at] += d
        ends.append(f(moved))
    return (ends[0] - ends[1]) / (2 * step)


@pytest.mark.parametrize("network", [*NETWORKS, features.Linear(np.arange(5) / 5, 0.1), features.Attention.seeded(5, 3, 4)], ids=["deep", "stacked", "parallel", "linear", "attention"])
def test_network_gradients_by_finite_differences(network):
    rng = np.random.default_rng(9)
    x, slope, bounds = rng.normal(size=(7, 5)), rng.normal(size=7), np.array([0, 3, 4, 7])
    params = [p + rng.normal(0, 0.1, p.shape) for p in network.parameters()]
    grads = network.rebuilt(params).back(x, lambda z: slope + 2 * z, bounds)
    assert [g.shape for g in grads] == [p.shape for p in params]

    def value(moved):
        z = network.rebuilt(moved).logits(x, bounds)
        return float((slope * z + z * z).sum())

    for k, g in enumerate(grads):
        for at in [tuple(rng.integers(0, n) for n in g.shape) for _ in range(4)]:
            assert by_differences(value, params, k, at) == pytest.approx(g[at], abs=1e-6)


@pytest.mark.parametrize("network", NETWORKS, ids=["deep", "stacked", "parallel"])
def test_training_lowers_the_loss_and_scores_with_it(spark, network):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(60, 5))
    rows = spark.createDataFrame([([*map(float, v)], int(v[0] > v[1]), 1.0) for v in x], "features array<double>, click int, w double").repartition(3)
    fitted, losses = features.fit_deep(rows, network, epochs=12, rate=0.05)
    assert losses[-1] < 0.8 * losses[0]
    got = features.score(rows, fitted).toPandas()
    assert np.allclose(got["logit"], fitted.logits(np.array(got["features"].tolist())))
    assert features.score(rows.where("1 = 0"), fitted).count() == 0


def test_mixture_fitted_anew_is_no_worse(spark):
    rng = np.random.default_rng(11)
    # half of the sessions click by document, half by rank
    rows = [(s, k, int(d), int(rng.random() < ((0.9 if d % 2 else 0.1) if s % 2 else 0.8 / k)), 0.25) for s in range(300) for k, d in enumerate(rng.integers(0, 10, 4), 1)]
    log = spark.createDataFrame(rows, "session_id long, position int, query_doc_id long, click int, w double")
    table = lambda key: log.select(key).distinct().withColumn("logit", F.lit(0.0))
    flat = lambda name, key: Param(name, (key,), table(key))
    start = models.Mixture({"d": models.RateModel(flat("d", "query_doc_id")), "p": models.PositionBased(flat("a", "query_doc_id"), flat("t", "position"))}, {"d": 0.5, "p": 0.5})
    refit = {"d": fit.refit_rates, "p": fit.refit_position_based}
    whole, _ = fit.fit_mixture(start, log, 3, refit)
    prior_only, _ = fit.fit_mixture(start, log, 3)
    ll = lambda m: metrics.log_likelihood(m.score(log, ("cond_log_prob",))).first()["ll"]
    assert sum(whole.prior.values()) == pytest.approx(1) and ll(whole) > ll(prior_only) + 0.05


def test_signed_gradient_by_finite_differences(spark):
    log = spark.createDataFrame([(s, 1, s % 7, int(s % 3 == 0), 1.0) for s in range(60)], "session_id long, position int, query_doc_id long, click int, w double")

    def model(logits):
        from clicklog.operators.params import hashed

        return models.RateModel(hashed("r", F.col("query_doc_id"), 7, spark.createDataFrame(list(enumerate(logits)), "bucket long, logit double"), ratio=3))

    logits = [0.3, -0.4, 0.2]
    got = {r.bucket: r.g for r in fit.rate_gradients(log, model(logits)).collect()}
    loss = lambda x: -60 * metrics.log_likelihood(model(x).score(log, ("cond_log_prob",))).first()["ll"]
    for k, g in got.items():
        step = [1e-4 if i == k else 0.0 for i in range(3)]
        diff = (loss([a + b for a, b in zip(logits, step, strict=True)]) - loss([a - b for a, b in zip(logits, step, strict=True)])) / 2e-4
        assert diff == pytest.approx(g, abs=1e-5)


@pytest.fixture(scope="module")
def feature_log(spark):
    rng = np.random.default_rng(12)
    rows = [(s, p, int(rng.random() < 0.35), 1.0 / n, rng.normal(size=5).tolist(), rng.normal(size=3).tolist()) for s in range(40) for n in (int(rng.integers(1, 7)),) for p in range(1, n + 1)]
    log = spark.createDataFrame(rows, "session_id long, position int, click int, w double, features array<double>, bias_features array<double>")
    return features.by_session(log.repartition(3)).persist()


def whole_loss(scored):
    return scored.agg(F.sum(F.col("w") * exprs.bce_log(F.col("click"), F.col("cond_log_prob"))).alias("l")).first()["l"]


INSIDE = [features.Linear(np.arange(5) / 5, 0.1), features.Deep.seeded(5, (4,)), features.Attention.seeded(5, 3)]


@pytest.mark.parametrize("network", INSIDE, ids=["linear", "deep", "attention"])
def test_two_tower_gradients_are_those_of_the_scored_loss(feature_log, network):
    params, n = [*network.parameters(), np.linspace(-0.4, 0.6, 6)], len(network.parameters())
    model = joint.TwoTower(network, params[-1])
    grads, by_rank, loss, seen = joint.two_tower_gradient(feature_log, model)
    assert loss == pytest.approx(whole_loss(model.scored(feature_log))) and seen == pytest.approx(40)
    f = lambda p: whole_loss(joint.TwoTower(network.rebuilt(p[:n]), p[-1]).scored(feature_log, ("cond_log_prob",)))
    first = (0,) * params[0].ndim
    assert by_differences(f, params, 0, first) == pytest.approx(grads[0][first], abs=1e-6)
    assert by_differences(f, params, n, (2,)) == pytest.approx(by_rank[2], abs=1e-6)


def test_two_towers_of_features_learn_together(feature_log):
    model = joint.TwoTower(features.Deep.seeded(5, (4,)), bias=features.Linear(np.zeros(3)))
    fitted, losses = joint.fit_two_tower(feature_log, model, epochs=6, rate=0.05)
    assert losses[-1] < losses[0] - 0.03 and np.abs(fitted.bias.weights).max() > 0
    assert joint.fit_two_tower(feature_log.where("1 = 0"), model, epochs=1)[1] == [0.0]


@pytest.mark.parametrize(("kind", "other"), [("ccm", []), ("dbn", [0.2]), ("sdbn", [-0.2]), ("dcm", [-0.5, -0.3, -0.1, 0.1, 0.3, 0.5])])
def test_chain_gradients_by_features_are_those_of_the_scored_loss(feature_log, kind, other):
    for network in INSIDE[:2] if kind != "dbn" else INSIDE:
        params, n = [*network.parameters(), np.array(other)], len(network.parameters())
        grads, by_other = joint.chain_feature_gradient(feature_log, joint.FeatureChain(kind, network, params[-1]))
        f = lambda p: whole_loss(joint.FeatureChain(kind, network.rebuilt(p[:n]), p[-1]).scored(feature_log, ("cond_log_prob",)))
        first = (0,) * params[0].ndim
        assert by_differences(f, params, 0, first) == pytest.approx(grads[0][first], abs=1e-5)
        if other:
            assert by_differences(f, params, n, (0,)) == pytest.approx(by_other[0], abs=1e-5)


def test_chain_fit_by_features_lowers_the_loss(feature_log):
    _, losses = joint.fit_feature_chain(feature_log, joint.FeatureChain("dbn", features.Deep.seeded(5, (4,)), np.array([0.2])), epochs=3, rate=0.05)
    assert losses[-1] < losses[0] - 0.02


def test_sessions_are_cut_at_their_borders_whatever_the_batches(spark, feature_log):
    network = features.Attention.seeded(5, 3)
    whole = {(r.session_id, r.position): r.logit for r in features.score(feature_log, network).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        small = {(r.session_id, r.position): r.logit for r in features.score(feature_log, network).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small.keys() == whole.keys() and all(small[k] == pytest.approx(whole[k], abs=1e-12) for k in whole)
    plan = features.by_session(spark.range(5).selectExpr("id session_id", "1 position"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_vectors_of_many_tasks_are_added_in_a_tree(spark):
    rows = spark.range(0, 6000, 1, 150).selectExpr("array(cast(id as double), 1.0) features", "0 click", "1.0 w")
    grads, more = features.gradients(rows, features.Linear(np.zeros(2)), lambda batch, z: (np.ones(len(z)), np.array([len(z)])), 1)
    assert grads[1][0] == 6000 and more[0] == 6000


def compressed_params(spark, n=40):
    def table(name, size, f, salt):
        return compressed.stored(spark.range(size).select(F.col("id").alias("k"), F.col("id").alias(name)), name, F.transform(F.sequence(F.lit(0), F.lit(f - 1)), lambda i: F.sin(F.col(name) * 1.3 + i + salt)))

    common = {"name": "attraction", "size": n, "baseline": -0.3}
    two = common | {"ratio": 5, "features": 2, "weights": (0.7, -0.4), "quotients": table("quotient", 8, 2, 0), "remainders": table("remainder", 5, 2, 1)}
    return {
        "signed": compressed.Signed(**common, ratio=4, buckets=table("bucket", 10, 1, 2)),
        "product": compressed.QuotientRemainder(**two, how="product"),
        "sum": compressed.QuotientRemainder(**two, how="sum"),
        "concat": compressed.QuotientRemainder(**two, how="concat", projection=[[0.5, -0.2, 0.3, 0.1], [-0.1, 0.4, 0.2, -0.3]]),
        "array": compressed.SharedArray(**common, ratio=6, features=4, weights=(0.5, -0.5, 0.25, 1.0), block=8, blocks=table("block", 4, 8, 3)),
    }


STORED = {"signed": ["buckets"], "product": ["quotients", "remainders"], "sum": ["quotients"], "concat": ["quotients", "remainders"], "array": ["blocks"]}


@pytest.mark.parametrize("kind", list(STORED))
def test_compressed_gradients_by_finite_differences_and_fit(spark, kind):
    from dataclasses import replace

    rng = np.random.default_rng(13)
    rows = [(d, p, float(c), float(c + rng.integers(1, 5))) for d in range(40) for p in (1, 2, 3) for c in (rng.integers(0, 3) + d % 2,)]
    cells = spark.createDataFrame(rows, "query_doc_id long, position int, clicks double, views double").persist()
    param, ranks = compressed_params(spark)[kind], np.array([0.3, 0.0, -0.4])
    loss = lambda p: compressed.cell_gradients(cells, p, ranks).agg(F.sum("loss").alias("l")).first()["l"]
    grads = param.gradients(compressed.cell_gradients(cells, param, ranks).select("query_doc_id", F.col("g_z").alias("g")))
    for name in STORED[kind]:
        table = getattr(param, name)
        key = table.columns[0]
        found = {r[0]: r["g"] for r in grads[name].collect()}
        for code, i in ((1, 0), (3, len(found[1]) - 1)):
            ends = []
            for d in (1e-5, -1e-5):
                moved = F.expr(f"transform(values, (x, j) -> if(j = {i}, x + {d}D, x))")
                ends.append(loss(replace(param, **{name: table.withColumn("values", F.when(F.col(key) == code, moved).otherwise(F.col("values")))})))
            assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(found[code][i], abs=1e-5)
    _, fitted, losses = compressed.fit_compressed(cells, param, ranks, iterations=4, rate=0.1)
    assert len(fitted) == 3 and losses[-1] < losses[0]


def test_compressed_parameters_serve_any_model_slot(spark):
    log = spark.createDataFrame([(s, p, s * 3 % 40 + p, int((s + p) % 3 == 0), 0.5) for s in range(30) for p in (1, 2)], "session_id long, position int, query_doc_id long, click int, w double")
    for param in compressed_params(spark).values():
        scored = models.PositionBased(param, Param("examination", fixed=joint.by_rank(np.array([0.3, 0.0])))).score(log)
        assert scored.count() == 60 and scored.where("cond_log_prob < 0 and relevance < 0").count() == 60


def test_tied_mixture_raises_the_likelihood_and_shares_one_table(spark):
    rng = np.random.default_rng(21)
    # half of the sessions click by document, half by document and rank
    rows = [(s, k, int(d), int(rng.random() < (0.8 if d % 2 else 0.2) * (1 if s % 2 else 1 / k)), 0.25) for s in range(300) for k, d in enumerate(rng.integers(0, 10, 4), 1)]
    log = spark.createDataFrame(rows, "session_id long, position int, query_doc_id long, click int, w double").persist()
    tables = {n: ((k,), fit.start(log, [k], F.lit(0.5) + 0 * F.sum("click"))) for n, k in (("attraction", "query_doc_id"), ("examination", "position"))}
    build = lambda p: {"d": models.RateModel(p["attraction"]), "p": models.PositionBased(p["attraction"], p["examination"])}
    ll = lambda m: metrics.log_likelihood(m.score(log, ("cond_log_prob",))).first()["ll"]
    first, _, _ = fit.fit_tied_mixture(build, tables, {"d": 0.5, "p": 0.5}, log, 1, 0.3)
    last, found, history = fit.fit_tied_mixture(build, tables, {"d": 0.5, "p": 0.5}, log, 6, 0.3)
    assert ll(last) > ll(first) + 0.01 and len(history) == 6 and sum(last.prior.values()) == pytest.approx(1)
    assert set(found) == {"attraction", "examination"} and last.models["d"].rate.table is last.models["p"].attraction.table


@pytest.mark.parametrize("kind", ["rate", "pbm", "ccm", "dcm", "dbn"])
def test_impression_gradients_are_those_of_the_scored_loss(spark, kind):
    log = spark.createDataFrame([(s, k, (s * 3 + k) % 4, int((s * k) % 3 == 1), 1 / 3) for s in range(20) for k in (1, 2, 3)], "session_id long, position int, query_doc_id long, click int, w double")

    def model(logits):
        table = lambda name, key, values: Param(name, (key,), spark.createDataFrame([(i + (key == "position"), float(v)) for i, v in enumerate(values)], f"{key} long, logit double"))
        a, b = table("attraction", "query_doc_id", logits[:4]), logits[4:]
        return {
            "rate": lambda: models.RateModel(a), "pbm": lambda: models.PositionBased(a, table("other", "position", b)), "ccm": lambda: models.ClickChain(a),
            "dcm": lambda: models.DependentClick(a, table("other", "position", b)), "dbn": lambda: models.DynamicBayesian(a, table("other", "query_doc_id", [*b, 0.1]), going=0.9),
        }[kind]()

    logits = [0.3, -0.4, 0.2, 0.6, 0.5, -0.2, 0.1]
    g = fit.impression_gradients(model(logits), log)
    got = {("attraction", r[0]): r[1] for r in g.groupBy("query_doc_id").agg(F.sum("g_attraction")).collect()}
    at = {("attraction", k): k for k in range(4)}
    if kind in ("pbm", "dcm", "dbn"):
        key = "query_doc_id" if kind == "dbn" else "position"
        got |= {("other", r[0]): r[1] for r in g.groupBy(key).agg(F.sum("g_other")).collect()}
        at |= {("other", k + (key == "position")): 4 + k for k in range(3)}
    for name in [("attraction", 1), ("other", 1)]:
        if name in at:
            f = lambda moved: whole_loss(model(list(moved[0])).score(log, ("cond_log_prob",)))
            assert by_differences(f, [np.array(logits)], 0, (at[name],)) == pytest.approx(got[name], abs=1e-5)


@cache
def exact_sigmoid(z):
    return 1 / (1 + (-z).exp())


def exact_loss(kind, logits, clicks, other):
    """A session's loss, rank by rank, in decimals of the context's digits."""
    loss, seen, c = Decimal(0), Decimal(1), exact_sigmoid(other)
    go = {"dcm": Decimal(1), "sdbn": Decimal(1), "dbn": Decimal(0.9), "ccm": Decimal(0.8)}[kind]
    for z, click in zip(logits, clicks, strict=True):
        a = exact_sigmoid(z)
        if click:
            loss -= (seen * a).ln()
            seen = {"dcm": c, "sdbn": 1 - c, "dbn": go * (1 - c), "ccm": a * Decimal(0.3) + (1 - a) * Decimal(0.6)}[kind]
        else:
            loss -= (1 - seen * a).ln()
            seen = seen * (1 - a) * go / (1 - seen * a)
    return loss


@pytest.mark.parametrize("kind", ["dcm", "sdbn", "dbn", "ccm"])
def test_chain_gradients_where_a_run_leaves_next_to_nothing(spark, kind):
    # 1e-15 left, then less than a double holds, then a start after a click
    sessions = [([3.5] * 10, [0] * 10), ([60.0] * 13, [0] * 13), ([40.0, -1.0, 3.0, 45.0, 30.0, 2.0], [0, 1, 0, 0, 0, 0])]
    rows = [(s, i, c, 1.0, z) for s, (logits, clicks) in enumerate(sessions) for i, (z, c) in enumerate(zip(logits, clicks, strict=True), 1)]
    log = spark.createDataFrame(rows, "session_id long, position int, click int, w double, z double")
    a, other = Param("attraction", fixed=F.col("z")), Param("other", fixed=F.lit(0.2))
    model = {"dcm": lambda: models.DependentClick(a, other), "ccm": lambda: models.ClickChain(a)}.get(kind, lambda: models.DynamicBayesian(a, other, going=1.0 if kind == "sdbn" else 0.9))()
    got = fit.impression_gradients(model, log).toPandas().set_index(["session_id", "position"]).sort_index()
    with localcontext(prec=100):
        step = Decimal("1e-40")
        slope = lambda f: float((f(step) - f(-step)) / (2 * step))
        for s, (logits, clicks) in enumerate(sessions):
            z, c = [Decimal(x) for x in logits], Decimal(0.2)
            for i in range(len(z)):
                want = slope(lambda d, i=i, z=z, clicks=clicks, c=c: exact_loss(kind, [*z[:i], z[i] + d, *z[i + 1 :]], clicks, c))
                assert got.loc[(s, i + 1), "g_attraction"] == pytest.approx(want, abs=1e-9), (s, i)
            if kind != "ccm":
                assert got.loc[s, "g_other"].sum() == pytest.approx(slope(lambda d, z=z, clicks=clicks, c=c: exact_loss(kind, z, clicks, c + d)), abs=1e-9)


@pytest.mark.parametrize("kind", ["dcm", "sdbn"])
def test_feature_gradient_steps_are_those_of_sql_where_a_run_leaves_little(spark, tmp_path, kind):
    # sessions without a click that leave about 1e-11, of which SQL keeps five digits; others with clicks
    rng = np.random.default_rng(14)
    weights = np.array(parameter_queries.W64)
    weights -= weights.mean()
    aim = weights / np.linalg.norm(weights)
    rows = []
    for i in range(60):
        logit, click = (rng.uniform(2.1, 2.8), 0) if i < 30 else (rng.normal(), int(rng.random() < 0.4))
        side = rng.normal(size=64)
        side -= side.mean() + aim * (side @ aim)
        along = (logit + 0.5) / (8 * np.linalg.norm(weights))
        rows.append((i, (along * aim + np.sqrt(1 - along**2) * side / np.linalg.norm(side)).tolist(), 9 if click else 0))
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    name = f"{kind}_feature_grad_step"
    want = con.execute(parameter_queries.ORACLES[name]).df().set_index(["kind", "k"])["g"]
    got = parameter_queries.QUERIES[name](spark, str(tmp_path)).toPandas().set_index(["kind", "k"])["g"]
    assert len(got) == len(want) and (got - want).abs().max() < 1e-4


def test_merged_sketches_estimate_what_exact_profiles_count(spark):
    from clicklog.functions import keys
    from clicklog.operators import keysets

    ids = spark.range(40_000).select((F.col("id") % 30_000).alias("id")).withColumn("fine", keys.universal_hash(50, F.col("id")))
    sketches = keysets.key_sketches(ids, "id", F.col("fine"))
    found = {(r.factor, r.bucket): (r.rows, r.ids) for r in keysets.compression_sweep(sketches, [1, 5, 50]).collect()}
    assert len(found) == 50 + 10 + 1
    for factor in (1, 5, 50):
        for r in keysets.compression_profile(ids, "id", F.expr(f"fine div {factor}")).collect():
            rows, estimate = found[factor, r.bucket]
            assert rows == r.rows and abs(estimate - r.ids) <= 0.05 * r.ids
