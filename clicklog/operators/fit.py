"""Parameter estimation by repeated aggregation.

All estimators minimise the mean over sessions of a session's mean loss: an impression weighs w = 1 / n.
Iterations work on sufficient statistics where the model allows it, and cut lineage by ``checkpoint``.
"""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clicklog.functions import exprs
from clicklog.operators import metrics, models
from clicklog.operators.params import Param, constant


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset, on one machine."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` from files in the checkpoint folder of the cluster."""
    spark: SparkSession = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def weight(weighting: str) -> Column:
    return F.col("w") if weighting == "session" else F.lit(1.0)


def rates(rows: DataFrame, keys: list[str], weighting: str = "session", clicks: float = 0.0, views: float = 0.0) -> DataFrame:
    """Closed form of click-through rates: weighted clicks over weighted views, with additive smoothing."""
    w = weight(weighting)
    rate = (F.sum(w * F.col("click")) + clicks) / (F.sum(w) + views)
    return rows.groupBy(*keys).agg(rate.alias("rate"), F.count("*").alias("views"))


def cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sufficient statistics of a model whose loss depends on an impression through ``keys`` and the click only."""
    return rows.groupBy(*keys).agg(F.sum(F.col("w") * F.col("click")).alias("clicks"), F.sum("w").alias("views"))


def with_last_position(rows: DataFrame) -> DataFrame:
    return rows.withColumn("last_pos", models.last_click_position().cast("int"))


def em_step(table: DataFrame, attraction: DataFrame, examination: DataFrame, exam_keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """One EM iteration of a product model on its cells: posterior shares, then two weighted rates.

    ``attraction`` (query_doc_id, alpha), ``examination`` (keys, theta). Without a click the posterior of attraction is
    alpha (1 - theta) / (1 - alpha theta), that of examination theta (1 - alpha) / (1 - alpha theta).
    """
    both = table.join(attraction, "query_doc_id").join(F.broadcast(examination), exam_keys)  # exam_keys: ranks, or pairs of ranks
    a, t = F.col("alpha"), F.col("theta")
    none = F.col("views") - F.col("clicks")
    both = both.withColumn("_pa", F.col("clicks") + none * a * (1 - t) / (1 - a * t)).withColumn("_pt", F.col("clicks") + none * t * (1 - a) / (1 - a * t))
    clip = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
    new_a = both.groupBy("query_doc_id").agg(clip(F.sum("_pa") / F.sum("views")).alias("alpha"))
    new_t = both.groupBy(*exam_keys).agg(clip(F.sum("_pt") / F.sum("views")).alias("theta"))
    return new_a, new_t


def cell_loss(table: DataFrame, attraction: DataFrame, examination: DataFrame, exam_keys: list[str]) -> float:
    both = table.join(attraction, "query_doc_id").join(F.broadcast(examination), exam_keys)
    p = F.col("alpha") * F.col("theta")
    nll = -(F.col("clicks") * F.log(p) + (F.col("views") - F.col("clicks")) * F.log1p(-p))
    return both.agg((F.sum(nll) / F.sum("views")).alias("l")).first()["l"]


def fit_product(table: DataFrame, exam_keys: list[str], iterations: int = 10, tolerance: float = 1e-5, alpha: float = 0.5, theta: float = 0.5) -> tuple[DataFrame, DataFrame, list[float]]:
    """EM of the position-based or user-browsing model on cells, until the loss falls by less than ``tolerance``."""
    table = checkpointed(table)
    attraction = table.select("query_doc_id").distinct().withColumn("alpha", F.lit(alpha))
    examination = table.select(*exam_keys).distinct().withColumn("theta", F.lit(theta))
    losses: list[float] = []
    for _ in range(iterations):
        attraction, examination = (checkpointed(x) for x in em_step(table, attraction, examination, exam_keys))
        losses.append(cell_loss(table, attraction, examination, exam_keys))
        if len(losses) > 1 and losses[-2] - losses[-1] < tolerance:
            break
    return attraction, examination, losses


def chain_gradient(rows: DataFrame, model: models.ChainModel) -> DataFrame:
    """Impressions with the gradient of the session-mean loss by the attraction logit (``g_attraction``), the
    probability of going on after a click (``g_click``) and the log-probability of going on after a skip (``g_skip``).

    A session's loss falls apart by runs (stretches that end with a click). With N the weight of "examined, nothing
    clicked yet" and D what is left of 1: a clicked run costs -log(N a) at its click, the tail costs -log(D) after
    its last rank. Gradients are window sums over a run.

    D is added up from what leaves a run without a click: 1 - start before it, N (1 - a) (1 - go) after each skip, and all of
    N (1 - a) after the last one. 1 - sum(N a) is the same, but loses all digits where a session is long or its documents are
    attractive. Parts are kept over the run's largest one, so that none of them is too small for a double.
    """
    rows = model.prepare(rows)
    a, skip, go_on = model.attraction.prob(), exprs.sigmoid(-model.attraction.logit()), model.go_after_skip()
    rows = models.examination_after_history(rows, model.attraction.log_complement(), go_on, model.go_after_click(), a)
    # sums over a run are taken in its order too, so that they share a pass with those from a rank on
    run = Window.partitionBy("session_id", "_run").orderBy("position")
    whole, onwards = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), run.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({"_ended": F.max("click").over(whole), "_len": F.count("*").over(whole), "_i": F.row_number().over(run) - 1})
    rows = rows.withColumn("_leaves", F.when(F.col("_i") == F.col("_len") - 1, 1.0).otherwise(1 - F.exp(go_on)))
    rows = rows.withColumn("_log_left", F.when(F.col("_leaves") > 0, F.col("_passed") + model.attraction.log_complement())).withColumn("_top", F.max("_log_left").over(whole))
    rows = rows.withColumn("_left", F.when(F.col("_leaves") > 0, F.col("_leaves") * F.exp(F.col("_log_left") - F.col("_top"))).otherwise(0.0))
    moment = F.sum(F.col("_i") * F.col("_n") * F.col("_a")).over(whole)
    rows = rows.withColumns({"_all": F.sum("_left").over(whole), "_later": F.sum("_left").over(onwards), "_moment": moment})
    start, left, ended = F.col("_start"), F.col("_all"), F.col("_ended") == 1
    over_top = F.when(start < 1, (1 - start) * F.exp(-F.col("_top"))).otherwise(0.0) + start * left
    by_logit = F.when(ended, F.when(F.col("click") == 1, -skip).otherwise(a)).otherwise(a * start * F.col("_later") / over_top)
    # by the logarithm of the run's start value and of going on after a skip, told once for each run
    rows = rows.withColumn("_end_d", F.greatest(1 - start + start * F.exp("_top") * left, F.lit(sys.float_info.min)))
    d_start = F.when(ended, F.lit(-1.0)).otherwise((1 - F.col("_end_d")) / F.col("_end_d"))
    d_skip = F.when(ended, -(F.col("_len") - 1.0)).otherwise(F.col("_moment") / F.col("_end_d"))
    first = F.col("_i") == 0
    # a run that follows a click starts with the value of the clicked rank, the row before it
    rows = rows.withColumn("_ds", F.when(first, d_start)).withColumn("_dk", F.when(first, d_skip).otherwise(0.0))
    rows = rows.withColumn("_dclick", F.when(F.col("click") == 1, F.lead("_ds").over(models.session())))
    go = model.go_after_click()
    return rows.withColumn("g_attraction", by_logit * F.col("w")).withColumn("g_click", F.coalesce(F.col("_dclick") / F.greatest(go, F.lit(exprs.EPS)), F.lit(0.0)) * F.col("w")).withColumn("g_skip", F.col("_dk") * F.col("w"))


def dbn_gradients(rows: DataFrame, model: models.DynamicBayesian) -> DataFrame:
    """For each document the gradient by its attraction and satisfaction logits (sums over impressions)."""
    g = chain_gradient(rows, model)
    s = model.satisfaction.prob()
    g = g.withColumn("_gs", -F.col("g_click") * model.going * s * (1 - s))
    return g.groupBy("query_doc_id").agg(F.sum("g_attraction").alias("g_attraction"), F.sum("_gs").alias("g_satisfaction"))


def dcm_gradients(rows: DataFrame, model: models.DependentClick) -> tuple[DataFrame, DataFrame]:
    """Gradients by document (attraction logit) and by position (continuation logit)."""
    g = chain_gradient(rows, model)
    c = model.continuation.prob()
    g = g.withColumn("_gc", F.col("g_click") * c * (1 - c))
    return g.groupBy("query_doc_id").agg(F.sum("g_attraction").alias("g_attraction")), g.groupBy("position").agg(F.sum("_gc").alias("g_continuation"))


def ccm_gradients(rows: DataFrame, model: models.ClickChain) -> DataFrame:
    """Gradient by the attraction logit, which also drives going on after a click."""
    g = chain_gradient(rows, model)
    a = model.attraction.prob()
    g = g.withColumn("_ga", F.col("g_attraction") + F.col("g_click") * (model.tau3 - model.tau2) * a * (1 - a))
    return g.groupBy("query_doc_id").agg(F.sum("_ga").alias("g_attraction"))


def cascade_gradients(rows: DataFrame, model: models.Cascade) -> DataFrame:
    """Gradient by the attraction logit of the cascade model: ranks up to the first click count.

    The predicted click log-probability at rank k is log a_k + sum of log(1 - a_i) over earlier ranks.
    """
    rows = model.conditional(model.prepare(rows))
    rows = rows.withColumn("_open", models.clicks_before() == 0)
    p = F.exp(F.col("cond_log_prob"))
    # d loss / d log p: -1 for a click, p / (1 - p) for none; ranks after a click are constant
    by_log = F.when(~F.col("_open"), 0.0).when(F.col("click") == 1, F.lit(-1.0)).otherwise(p / (1 - F.least(p, F.lit(1 - exprs.EPS))))
    rows = rows.withColumn("_b", by_log)
    after = models.session().rowsBetween(1, Window.unboundedFollowing)
    a = model.attraction.prob()
    rows = rows.withColumn("_ga", F.col("w") * (F.col("_b") * (1 - a) - F.coalesce(F.sum("_b").over(after), F.lit(0.0)) * a))
    return rows.groupBy("query_doc_id").agg(F.sum("_ga").alias("g_attraction"))


def textbook_cascade(rows: DataFrame) -> DataFrame:
    """Closed form: weighted rates over the ranks up to the first click."""
    seen = rows.withColumn("_open", models.clicks_before() == 0).where("_open")
    return seen.groupBy("query_doc_id").agg((F.sum(F.col("w") * F.col("click")) / F.sum("w")).alias("rate"))


def adam(state: DataFrame, gradient: DataFrame, key: list[str], step: int, rate: float, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8) -> DataFrame:
    """One step of Adam with its state as columns: (key, logit, m, v) and (key, g)."""
    both = state.join(gradient, key, "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    both = both.withColumn("m", beta1 * F.col("m") + (1 - beta1) * F.col("g")).withColumn("v", beta2 * F.col("v") + (1 - beta2) * F.col("g") * F.col("g"))
    move = rate * (F.col("m") / (1 - beta1**step)) / (F.sqrt(F.col("v") / (1 - beta2**step)) + eps)
    return both.select(*key, (F.col("logit") - move).alias("logit"), "m", "v")


def start(rows: DataFrame, key: list[str], rate: Column) -> DataFrame:
    """Logits of smoothed rates with an empty Adam state."""
    return rows.groupBy(*key).agg(exprs.logit(rate).alias("logit")).withColumn("m", F.lit(0.0)).withColumn("v", F.lit(0.0))


def fit_chain(kind: str, rows: DataFrame, validation: DataFrame | None = None, epochs: int = 5, rate: float = 0.05, patience: int = 0, min_delta: float = 1e-5, going: float = 0.9, bucketed: bool = False) -> tuple[models.ChainModel, list[dict]]:
    """Fit ``dbn``, ``sdbn``, ``dcm`` or ``ccm`` by Adam on whole-data gradients, with early stopping on the validation loss.

    A log that is ``bucketed`` by session is read as it is in each epoch; other rows are dealt by session and kept once."""
    sessions = rows.agg(F.sum("w").alias("s")).first()["s"] or 1.0
    if not bucketed:
        rows = rows.repartition("session_id").persist()
    doc = ["query_doc_id"]
    smooth = (F.sum("click") + 1.0) / (F.count("*") + 2.0)
    states = {"attraction": (doc, checkpointed(start(rows, doc, smooth)))}
    if kind in ("dbn", "sdbn"):
        states["satisfaction"] = (doc, checkpointed(start(rows, doc, F.lit(0.5) + 0 * F.sum("click"))))
    if kind == "dcm":
        states["continuation"] = (["position"], checkpointed(start(rows, ["position"], F.lit(0.5) + 0 * F.sum("click"))))

    def built(tables: dict) -> models.ChainModel:
        p = {name: Param(name, tuple(key), table) for name, (key, table) in tables.items()}
        if kind == "dcm":
            return models.DependentClick(p["attraction"], p["continuation"])
        if kind == "ccm":
            return models.ClickChain(p["attraction"])
        return models.DynamicBayesian(p["attraction"], p["satisfaction"], going=1.0 if kind == "sdbn" else going)

    def loss(data: DataFrame, model: models.ChainModel) -> float:
        scored = model.score(data, ("cond_log_prob",))
        return metrics.session_mean(scored, exprs.bce_log(F.col("click"), F.col("cond_log_prob"))).first()["loss"]

    best, log, waited = dict(states), [], 0
    try:
        for epoch in range(1, epochs + 1):
            model = built(states)
            if kind == "dcm":
                by_doc, by_pos = dcm_gradients(rows, model)
                found = {"attraction": by_doc.withColumnRenamed("g_attraction", "g"), "continuation": by_pos.withColumnRenamed("g_continuation", "g")}
            elif kind == "ccm":
                found = {"attraction": ccm_gradients(rows, model).withColumnRenamed("g_attraction", "g")}
            else:
                both = checkpointed(dbn_gradients(rows, model))
                found = {n: both.select("query_doc_id", F.col(f"g_{n}").alias("g")) for n in ("attraction", "satisfaction")}
            states = {n: (key, checkpointed(adam(table, found[n].withColumn("g", F.col("g") / sessions), key, epoch, rate))) for n, (key, table) in states.items()}
            now = loss(validation if validation is not None else rows, built(states))
            improved = not log or min(x["val_loss"] for x in log) - now > min_delta
            log.append({"epoch": epoch, "val_loss": now, "best": improved})
            if improved:
                best, waited = dict(states), 0
            else:
                waited += 1
                if waited > patience:
                    break
    finally:
        if not bucketed:
            rows.unpersist()
    return built(best), log


def rate_gradients(rows: DataFrame, model: models.RateModel) -> DataFrame:
    """``g`` for each key of the rates' table: the gradient of the loss by its logit. Under the hash trick a key's sign
    turns the logit that it shares, and so its part of the gradient."""
    p = model.rate
    rows = p.lookup(rows).withColumns(p.computed or {})
    part = F.col("w") * (p.prob() - F.col("click"))
    return rows.groupBy(*p.keys).agg(F.sum(part if p.sign is None else p.sign * part).alias("g"))


def _responsibility(post: DataFrame, names: list[str]) -> DataFrame:
    """``model, prior``: the mean posteriors."""
    means = post.agg(*(F.avg(F.exp(F.col(f"post_{m}"))).alias(m) for m in names))
    return means.select(F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("prior")) for m in names))).alias("x")).select("x.*")


def mixture_step(model: models.Mixture, rows: DataFrame, temperature: float = 1.0) -> DataFrame:
    """One EM step of the prior: a model's mean responsibility over sessions."""
    return _responsibility(model.posterior(rows, temperature), list(model.models))


def refit_rates(model: models.RateModel, rows: DataFrame) -> models.RateModel:
    """Smoothed rates of impressions as they weigh in ``w``."""
    p = model.rate
    found = rates(rows, list(p.keys), clicks=1.0, views=2.0)
    if not p.keys:
        return models.RateModel(constant(p.name, found.first()["rate"]))
    return models.RateModel(replace(p, table=checkpointed(found.select(*p.keys, exprs.logit(F.col("rate")).alias("logit"))), column="logit"))


def refit_position_based(model: models.PositionBased, rows: DataFrame) -> models.PositionBased:
    """One EM step on cells from the model's own parameters."""
    table = checkpointed(cells(rows, ["query_doc_id", "position"]))
    a, t = model.attraction, model.examination
    alpha = a.lookup(table.select("query_doc_id").distinct()).select("query_doc_id", a.prob().alias("alpha"))
    theta = t.lookup(table.select("position").distinct()).select("position", t.prob().alias("theta"))
    new_a, new_t = em_step(table, alpha, theta, ["position"])
    new_a = checkpointed(new_a.select("query_doc_id", exprs.logit(F.col("alpha")).alias("logit")))
    new_t = checkpointed(new_t.select("position", exprs.logit(F.col("theta")).alias("logit")))
    return models.PositionBased(replace(a, table=new_a, column="logit"), replace(t, table=new_t, column="logit"))


#: Fits a model of a mixture anew to impressions whose ``w`` holds its share of their sessions.
Refit = Callable[[models.ClickModel, DataFrame], models.ClickModel]


def fit_mixture(model: models.Mixture, rows: DataFrame, iterations: int = 3, refit: dict[str, Refit] | None = None) -> tuple[models.Mixture, list[dict[str, float]]]:
    """EM of a mixture: the prior weights and, of the models named in ``refit``, the parameters; others stay as they are."""
    history = []
    for _ in range(iterations):
        post = model.posterior(rows, model.temperature)
        post = checkpointed(post) if refit else post
        prior = {r["model"]: max(r["prior"], 1e-12) for r in _responsibility(post, list(model.models)).collect()}  # a row for each model
        inner = dict(model.models)
        for name, fitted in (refit or {}).items():
            share = post.select("session_id", F.exp(f"post_{name}").alias("_share"))
            inner[name] = fitted(inner[name], rows.join(share, "session_id").withColumn("w", F.col("w") * F.col("_share")).drop("_share"))
        model = models.Mixture(inner, prior, model.temperature)
        history.append(prior)
    return model, history


def impression_gradients(model: models.ClickModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``g_<name>``: the gradient of the session-mean loss by the logit of each parameter of a rate, position-based
    or chain model."""
    if isinstance(model, models.RateModel):
        p = model.rate
        return p.lookup(rows).withColumn(f"g_{p.name}", F.col("w") * (p.prob() - F.col("click")))
    if isinstance(model, models.PositionBased):
        rows = model.prepare(rows)
        a, t = model.attraction.prob(), model.examination.prob()
        odds = a * t / (1 - F.least(a * t, F.lit(1 - exprs.EPS)))
        by = lambda x: F.col("w") * F.when(F.col("click") == 1, x - 1).otherwise(odds * (1 - x))
        return rows.withColumns({f"g_{model.attraction.name}": by(a), f"g_{model.examination.name}": by(t)})
    g = chain_gradient(rows, model)
    a, by_a = model.attraction.prob(), F.col("g_attraction")
    if isinstance(model, models.ClickChain):
        return g.withColumn(f"g_{model.attraction.name}", by_a + F.col("g_click") * (model.tau3 - model.tau2) * a * (1 - a))
    g = g.withColumn(f"g_{model.attraction.name}", by_a)
    if isinstance(model, models.DependentClick):
        c = model.continuation.prob()
        return g.withColumn(f"g_{model.continuation.name}", F.col("g_click") * c * (1 - c))
    if isinstance(model, models.DynamicBayesian):
        s = model.satisfaction.prob()
        return g.withColumn(f"g_{model.satisfaction.name}", -F.col("g_click") * model.going * s * (1 - s))
    raise TypeError(f"no gradients for {type(model).__name__}")


#: Builds a mixture's models from the parameters by name; models that use one name share its table.
Build = Callable[[dict[str, Param]], dict[str, models.ClickModel]]


def fit_tied_mixture(
    build: Build, tables: dict[str, tuple[tuple[str, ...], DataFrame]], prior: dict[str, float], rows: DataFrame, iterations: int = 3, rate: float = 0.05, temperature: float = 1.0
) -> tuple[models.Mixture, dict[str, DataFrame], list[dict[str, float]]]:
    """Generalised EM of a mixture whose models may share parameters.

    ``tables`` has keys and a table (keys, logit, m, v) for each parameter, as :func:`start` gives it. In each iteration the
    prior becomes the mean posterior; then every model's gradients, with its sessions weighing as much as its posterior, are
    added up by parameter and key, whichever models they come from, and each table takes one step of Adam.
    """
    sessions = rows.agg(F.sum("w").alias("s")).first()["s"] or 1.0
    tables, history = dict(tables), []

    def built() -> models.Mixture:
        return models.Mixture(build({name: Param(name, tuple(key), table) for name, (key, table) in tables.items()}), prior, temperature)

    for step in range(1, iterations + 1):
        model = built()
        post = checkpointed(model.posterior(rows, temperature))
        parts: dict[str, list[DataFrame]] = {}
        for name, inner in model.models.items():
            share = post.select("session_id", F.exp(f"post_{name}").alias("_share"))
            g = impression_gradients(inner, rows.join(share, "session_id").withColumn("w", F.col("w") * F.col("_share")).drop("_share"))
            for p in inner.params:
                if p.name in tables:
                    parts.setdefault(p.name, []).append(g.groupBy(*tables[p.name][0]).agg(F.sum(f"g_{p.name}").alias("g")))
        for name, found in parts.items():
            key, table = tables[name]
            whole = found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).groupBy(*key).agg(F.sum("g").alias("g"))
            tables[name] = key, checkpointed(adam(table, whole.withColumn("g", F.col("g") / sessions), list(key), step, rate))
        prior = {r["model"]: max(r["prior"], 1e-12) for r in _responsibility(post, list(model.models)).collect()}  # a row for each model
        history.append(prior)
    return built(), {name: table for name, (_, table) in tables.items()}, history
