"""Registered queries of feature parameters fitted inside click models, attention over sessions, and compressed parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clicklog.functions import exprs, keys
from clicklog.operators import compressed, features, fit, joint, keysets, models, reports
from clicklog.operators.params import Param
from clicklog.plans import data, fit_sql
from clicklog.plans.catalog import ANN, BUCKET, FSUM, NORMED, W64, WEIGHTS, N, _feature_sessions, _h, _h2, _lists, ids, lg, n_docs, rd
from clicklog.plans.catalog import ORACLES as ORACLES_OF
from clicklog.plans.data import Log
from clicklog.plans.oracle import LOG, bce, chain_cond, r
from clicklog.sources import sessions as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# ---- networks inside click models -----------------------------------------------------------------------------


def feature_log(s: SparkSession, d: str) -> DataFrame:
    """Sessions of ten neighbouring vectors: a vector is a document with features, in the order of vec_id."""
    rows = data.table(s, d, "embeddings").select(
        F.expr("vec_id div 10").alias("session_id"), (F.col("vec_id") % 10 + 1).cast("int").alias("position"), lg("vec_id"),
        (F.col("label") >= 7).cast("int").alias("click"), F.col("embedding").cast("array<double>").alias("features"),
    )
    return rows.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("session_id")))


LINEAR = features.Linear(np.array(W64), -0.5)
RANKS = np.round(0.5 - 0.1 * np.arange(10), 1)
FL = f"""WITH {NORMED}, {WEIGHTS}, fl0 AS (SELECT vec_id, vec_id // 10 AS session_id, vec_id % 10 + 1 AS position, CASE WHEN label >= 7 THEN 1 ELSE 0 END AS click,
  1::DOUBLE / count(*) OVER (PARTITION BY vec_id // 10) AS w FROM embeddings),
fl AS (SELECT fl0.*, z AS x, 1 / (1 + exp(-(list_sum(list_transform(range(1, 65), lambda i: z[i] * ws[i])) - 0.5::DOUBLE))) AS a,
  1 / (1 + exp(-(0.6::DOUBLE - 0.1::DOUBLE * position))) AS t, 0.4::DOUBLE AS s, 0.5::DOUBLE AS c FROM fl0 JOIN ln_ ON ln_.vec_id = fl0.vec_id CROSS JOIN wt)"""
#: Gradients by the weights and the bias from ``g`` (x, gz).
BY_WEIGHT = f"SELECT 'weight' AS kind, nth::BIGINT AS k, {r('sum(gz * x[nth])', 'g', 5)} FROM g, unnest(range(1, 65)) u(nth) GROUP BY nth UNION ALL SELECT 'bias', 0::BIGINT, {r('sum(gz)', 'g', 5)} FROM g"


def _rows(s: SparkSession, grads: list[np.ndarray], other: np.ndarray, name: str) -> DataFrame:
    """A row for each weight of a linear parameter and each other logit."""
    found = [("weight", i + 1, float(g)) for i, g in enumerate(grads[0])] + [("bias", 0, float(grads[1][0]))] + [(name, i + 1, float(g)) for i, g in enumerate(other)]
    return s.createDataFrame(found, "kind string, k long, g double").select("kind", "k", rd("g", "g", 5))


def _two_tower_step(s: SparkSession, d: str) -> DataFrame:
    grads, by_rank, _, _ = joint.two_tower_gradient(feature_log(s, d), joint.TwoTower(LINEAR, RANKS))
    return _rows(s, grads, by_rank, "rank")


register(
    "pbm_feature_grad_step",
    _two_tower_step,
    FL + f""", g AS (SELECT *, w * CASE WHEN click = 1 THEN a - 1 ELSE a * t / (1 - a * t) * (1 - a) END AS gz, w * CASE WHEN click = 1 THEN t - 1 ELSE a * t / (1 - a * t) * (1 - t) END AS ge FROM fl)
{BY_WEIGHT} UNION ALL SELECT 'rank', position::BIGINT, {r('sum(ge)', 'g', 5)} FROM g GROUP BY position""",
)


def _chain_step(kind: str, other: np.ndarray, name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        grads, more = joint.chain_feature_gradient(feature_log(s, d), joint.FeatureChain(kind, LINEAR, other))
        return _rows(s, grads, more, name)

    return run


_SATISFIED = np.array([np.log(0.4 / 0.6)])
for _kind, _other, _name, _more in (
    ("dbn", _SATISFIED, "satisfaction", fit_sql.BY_SATISFACTION["dbn"]), ("sdbn", _SATISFIED, "satisfaction", fit_sql.BY_SATISFACTION["sdbn"]),
    ("ccm", np.zeros(0), "", None), ("dcm", np.zeros(10), "continuation", fit_sql.BY_CONTINUATION["dcm"]),
):
    _sql = FL + chain_cond(_kind, "fl") + fit_sql.gradients(_kind) + f", g AS (SELECT *, {fit_sql.BY_ATTRACTION[_kind]} AS gz FROM gr) " + BY_WEIGHT
    if _more:
        _place = "position" if _kind == "dcm" else "1"
        _sql += f" UNION ALL SELECT '{_name}', {_place}::BIGINT, {r(f'sum({_more})', 'g', 5)} FROM gr" + (" GROUP BY position" if _kind == "dcm" else "")
    register(f"{_kind}_feature_grad_step", _chain_step(_kind, _other, _name), _sql)


def _losses(s: SparkSession, losses: list[float]) -> DataFrame:
    return s.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "step long, loss double")  # a row for each step


def _towers(network: features.Network, bias: features.Network | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """Losses of a jointly fitted position-based model; a bias tower sees the first 16 features."""

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = feature_log(s, d).withColumn("bias_features", F.slice("features", 1, 16))
        rows = features.by_session(rows) if getattr(network, "by_session", False) else rows
        return _losses(s, joint.fit_two_tower(rows, joint.TwoTower(network, np.zeros(10), bias), epochs=3)[1])

    return run


register("fit_pbm_deepcross", _towers(features.DeepCross(64, hidden=(16,))))
register("fit_pbm_two_tower", _towers(features.Deep.seeded(64), features.Linear(np.zeros(16))))
register("fit_pbm_attention", _towers(features.Attention.seeded(64)))
register("fit_dbn_deep", lambda s, d: _losses(s, joint.fit_feature_chain(feature_log(s, d), joint.FeatureChain("dbn", features.Deep.seeded(64), _SATISFIED), epochs=2)[1]))

ATTENTION = features.Attention.seeded(64)


def _attention_sql() -> str:
    """Scores of a session's documents as list arithmetic over pairs of them."""
    (wq, _), (wk, _), (wv, _) = ATTENTION.qkv
    product = fit_sql._product
    return f"""WITH e AS (SELECT vec_id, vec_id // 10 AS session_id, list_transform(embedding, lambda x: x::DOUBLE) AS h FROM embeddings),
p AS (SELECT vec_id, session_id, {product('h', wq)} AS q, {product('h', wk)} AS k, {product('h', wv)} AS v FROM e),
s AS (SELECT a.vec_id, b.v, list_inner_product(a.q, b.k) / sqrt(8::DOUBLE) AS s FROM p a JOIN p b USING (session_id)),
m AS (SELECT vec_id, v, exp(s - max(s) OVER (PARTITION BY vec_id)) AS x FROM s), n AS (SELECT vec_id, v, x / sum(x) OVER (PARTITION BY vec_id) AS share FROM m),
o AS (SELECT vec_id, [{', '.join(f'sum(share * v[{i}])' for i in range(1, 9))}] AS mixed FROM n GROUP BY 1)
SELECT vec_id::BIGINT AS vec_id, {r(f"list_inner_product({product('mixed', ATTENTION.out[0])}, {fit_sql._numbers(ATTENTION.top[0][:, 0])})", 'logit')} FROM o"""


register("attention_attraction", lambda s, d: features.score(features.by_session(feature_log(s, d)), ATTENTION).select("vec_id", rd("logit", "logit")), _attention_sql())

# ---- compressed parameters ------------------------------------------------------------------------------------

WEIGHED, BASE = (0.7, -0.4), -0.5
#: A projection of two vectors of two numbers to one.
PROJECTION = [[0.5, -0.2, 0.3, 0.1], [-0.1, 0.4, 0.2, -0.3]]
ROBE, BLOCK, ROBE_RATIO = (0.5, -0.5, 0.25, 1.0), 16, 100


def first_values(code: str, features_: int, salt: int):
    """Reproducible first values of a code: (37 code + 11 i + 5 salt) mod 101, scaled to [-0.3, 0.7)."""
    return F.array(*(F.expr(f"double(({code} * 37 + {11 * i + 5 * salt}) % 101) / 101 - double(0.3)") for i in range(features_)))


def _first(code: str, i: int, salt: int) -> str:
    return f"((({code}) * 37 + {11 * i + 5 * salt}) % 101)::DOUBLE / 101 - 0.3::DOUBLE"


def quotient_remainder(s: SparkSession, d: str, how: str, n: int = 2) -> compressed.QuotientRemainder:
    size = n_docs(s, d)
    quotients = s.range(-(-size // 10)).select(F.col("id").alias("quotient"))
    remainders = s.range(10).select(F.col("id").alias("remainder"))
    return compressed.QuotientRemainder(
        "attraction", size=size, features=n, weights=WEIGHED[:n], baseline=BASE, how=how, projection=PROJECTION if how == "concat" else [],
        quotients=compressed.stored(quotients, "quotient", first_values("quotient", n, 1)), remainders=compressed.stored(remainders, "remainder", first_values("remainder", n, 2)),
    )


def shared_array(s: SparkSession, d: str) -> compressed.SharedArray:
    param = compressed.SharedArray("attraction", size=n_docs(s, d), ratio=ROBE_RATIO, features=4, weights=ROBE, baseline=BASE, block=BLOCK)
    values = F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: ((F.col("block") * BLOCK + i) * 37 % 101).cast("double") / 101 - 0.3)
    return compressed.SharedArray(**(vars(param) | {"blocks": compressed.stored(s.range(-(-param.slots // BLOCK)).select(F.col("id").alias("block")), "block", values)}))


def _score(param: Callable[[SparkSession, str], compressed.Shared]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: models.RateModel(param(s, d)).score(data.impressions(s, d), ("log_prob",)).select(*ids(), rd("log_prob", "log_prob"))


CODE = _h("query_doc_id", N)
QR = f"{CODE} // 10 AS quotient, {CODE} % 10 AS remainder"
_q, _r = [_first("quotient", i, 1) for i in range(2)], [_first("remainder", i, 2) for i in range(2)]
_project = [sum(w * row[i] for w, row in zip(WEIGHED, PROJECTION, strict=True)) for i in range(4)]
QR_LOGIT = {
    "product": " + ".join(f"{w}::DOUBLE * ({a}) * ({b})" for w, a, b in zip(WEIGHED, _q, _r, strict=True)),
    "sum": " + ".join(f"{w}::DOUBLE * (({a}) + ({b}))" for w, a, b in zip(WEIGHED, _q, _r, strict=True)),
    "concat": " + ".join(f"({w!r})::DOUBLE * ({x})" for w, x in zip(_project, [*_q, *_r], strict=True)),
}
#: By how much the logit rises with each number of the quotient's and of the remainder's vector.
QR_SLOPE = {
    "product": ([f"{w}::DOUBLE * ({b})" for w, b in zip(WEIGHED, _r, strict=True)], [f"{w}::DOUBLE * ({a})" for w, a in zip(WEIGHED, _q, strict=True)]),
    "sum": ([f"{w}::DOUBLE" for w in WEIGHED],) * 2,
    "concat": ([f"({w!r})::DOUBLE" for w in _project[:2]], [f"({w!r})::DOUBLE" for w in _project[2:]]),
}


def _log_prob(logit: str) -> str:
    return f"-ln(1 + exp(-({logit} + {BASE}::DOUBLE)))"


def _gradient(param: Callable[[SparkSession, str], compressed.Shared], keys_: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    """Gradients of each stored table on the train part's cells."""

    def run(s: SparkSession, d: str) -> DataFrame:
        p = param(s, d)
        rows = compressed.cell_gradients(fit.cells(Log(s, d).train, ["query_doc_id"]), p)
        found, out = p.gradients(rows.select("query_doc_id", F.col("g_z").alias("g"))), None
        for name, key in keys_.items():
            part = found[name].select(F.lit(key).alias("kind"), lg(key, "k"), F.posexplode("g").alias("i", "g")).select("kind", "k", lg("i"), rd("g", "g"))
            out = part if out is None else out.union(part)
        return out

    return run


CELLS = LOG + ", cl AS (SELECT query_doc_id, sum(w * click) AS c, sum(w) AS v FROM tr GROUP BY 1)"
for _how, _suffix in (("product", ""), ("sum", "_sum"), ("concat", "_concat")):
    register(f"dctr_qr{_suffix}_score", _score(lambda s, d, how=_how: quotient_remainder(s, d, how)), LOG + f", k AS (SELECT *, {QR} FROM imp) SELECT session_id::BIGINT AS session_id, position::BIGINT AS position, {r(_log_prob(QR_LOGIT[_how]), 'log_prob')} FROM k")
    _g = CELLS + f", k AS (SELECT *, {QR} FROM cl), z AS (SELECT *, 1 / (1 + exp(-({QR_LOGIT[_how]} + {BASE}::DOUBLE))) AS p FROM k), gs AS (SELECT *, (v - c) * p - c * (1 - p) AS g FROM z) "
    _parts = [(code, i, QR_SLOPE[_how][j][i]) for j, code in enumerate(("quotient", "remainder")) for i in range(2)]
    register(
        f"dctr_qr{_suffix}_grad_step",
        _gradient(lambda s, d, how=_how: quotient_remainder(s, d, how), {"quotients": "quotient", "remainders": "remainder"}),
        _g + " UNION ALL ".join(f"SELECT '{code}' AS kind, {code}::BIGINT AS k, {i}::BIGINT AS i, {r(f'sum(g * ({slope}))', 'g')} FROM gs GROUP BY {code}" for code, i, slope in _parts),
    )

#: Each key's four places in the shared array with their coefficients.
PLACES = f"""sl AS (SELECT greatest(1, {N} * 4 // {ROBE_RATIO}) AS slots),
pl AS (SELECT query_doc_id, ({_h('query_doc_id', 'slots')} + o) % slots AS slot, (2 * {_h2('query_doc_id', 'o', 2)} - 1) * {list(ROBE)}[o + 1]::DOUBLE AS f FROM (SELECT DISTINCT query_doc_id FROM imp), sl, unnest(range(0, 4)) u(o)),
zl AS (SELECT query_doc_id, sum(f * ((slot * 37 % 101)::DOUBLE / 101 - 0.3::DOUBLE)) AS z FROM pl GROUP BY 1)"""
register("dctr_robe_score", _score(shared_array), LOG + f", {PLACES} SELECT session_id::BIGINT AS session_id, position::BIGINT AS position, {r(_log_prob('z'), 'log_prob')} FROM imp JOIN zl USING (query_doc_id)")
register(
    "dctr_robe_grad_step",
    lambda s, d: _gradient(shared_array, {"blocks": "block"})(s, d).select((F.col("k") * BLOCK + F.col("i")).alias("slot"), "g").where("g <> 0"),
    CELLS + f", {PLACES}, p AS (SELECT cl.*, 1 / (1 + exp(-(z + {BASE}::DOUBLE))) AS p FROM cl JOIN zl USING (query_doc_id)), gs AS (SELECT slot::BIGINT AS slot, {r('sum(((v - c) * p - c * (1 - p)) * f)', 'g')} FROM p JOIN pl USING (query_doc_id) GROUP BY pl.slot) SELECT slot, g FROM gs WHERE g <> 0",
)

# ---- fits on compressed keys


def signed(s: SparkSession, d: str) -> compressed.Signed:
    size = n_docs(s, d)
    buckets = s.range(-(-size // 10)).select(F.col("id").alias("bucket"))
    return compressed.Signed("attraction", size=size, baseline=BASE, buckets=compressed.stored(buckets, "bucket", first_values("bucket", 1, 1)))


def _fit_signed(s: SparkSession, d: str) -> DataFrame:
    param, _, _ = compressed.fit_compressed(fit.cells(Log(s, d).train, ["query_doc_id"]), signed(s, d), iterations=3, tolerance=-1.0)
    return param.buckets.select(lg("bucket"), rd(F.col("values")[0], "value"))


def _fit_signed_sql(iterations: int = 3) -> str:
    out = CELLS + f""", k AS MATERIALIZED (SELECT *, {BUCKET} AS bucket, 2 * {_h2('query_doc_id', '0', 2)} - 1 AS sign FROM cl), tot AS (SELECT sum(v) AS total FROM cl),
b0 AS (SELECT i AS bucket, {_first('i', 0, 1)} AS x, 0::DOUBLE AS m, 0::DOUBLE AS s FROM range(({N} + 9) // 10) u(i))"""
    for i in range(1, iterations + 1):
        out += f""", p{i} AS (SELECT k.*, 1 / (1 + exp(-(sign * x + {BASE}::DOUBLE))) AS p FROM k JOIN b{i - 1} USING (bucket)),
g{i} AS (SELECT bucket, sum(sign * ((v - c) * p - c * (1 - p))) / min(total) AS g FROM p{i}, tot GROUP BY 1),
b{i} AS MATERIALIZED (SELECT o.bucket, {fit_sql._adam('o', 'coalesce(g, 0)', i, 0.1, ('x', 'm', 's'))} FROM b{i - 1} o LEFT JOIN g{i} USING (bucket))"""
    return out + f" SELECT bucket::BIGINT AS bucket, {r('x', 'value')} FROM b{iterations}"


register("fit_dctr_signed", _fit_signed, _fit_signed_sql())


def _fit_pbm_qr(s: SparkSession, d: str) -> DataFrame:
    param, ranks, losses = compressed.fit_compressed(fit.cells(Log(s, d).train, ["query_doc_id", "position"]), quotient_remainder(s, d, "product", 1), np.zeros(data.MOST), 2, tolerance=-1.0)
    out = s.createDataFrame([("rank", i + 1, float(x)) for i, x in enumerate(ranks)] + [("loss", i + 1, x) for i, x in enumerate(losses)], "kind string, k long, value double")  # a row for each rank and step
    for name, table in (("quotient", param.quotients), ("remainder", param.remainders)):
        out = out.union(table.select(F.lit(name).alias("kind"), lg(name, "k"), F.col("values")[0].alias("value")))
    return out.select("kind", "k", rd("value", "value"))


def _fit_pbm_qr_sql(iterations: int = 2) -> str:
    zero = "0::DOUBLE AS m, 0::DOUBLE AS s"
    out = LOG + f""", cl AS MATERIALIZED (SELECT query_doc_id, position, sum(w * click) AS c, sum(w) AS v, {QR} FROM tr GROUP BY query_doc_id, position), tot AS (SELECT sum(v) AS total FROM cl),
q0 AS (SELECT i AS quotient, {_first('i', 0, 1)} AS x, {zero} FROM range(({N} + 9) // 10) u(i)), r0 AS (SELECT i AS remainder, {_first('i', 0, 2)} AS x, {zero} FROM range(10) u(i)), e0 AS (SELECT i AS position, 0::DOUBLE AS x, {zero} FROM range(1, 11) u(i))"""
    for i in range(1, iterations + 1):
        j = i - 1
        out += f""", z{i} AS (SELECT cl.*, q.x AS q, r.x AS r, 1 / (1 + exp(-({WEIGHED[0]}::DOUBLE * q.x * r.x + {BASE}::DOUBLE))) AS a, 1 / (1 + exp(-e.x)) AS t
  FROM cl JOIN q{j} q USING (quotient) JOIN r{j} r USING (remainder) JOIN e{j} e USING (position)),
g{i} AS MATERIALIZED (SELECT *, ((v - c) * a * t / (1 - a * t) - c) * (1 - a) / total AS gz, ((v - c) * a * t / (1 - a * t) - c) * (1 - t) / total AS ge, -(c * ln(a * t) + (v - c) * ln(1 - a * t)) / total AS l FROM z{i}, tot)"""
        for name, code, g in (("q", "quotient", f"{WEIGHED[0]}::DOUBLE * gz * r"), ("r", "remainder", f"{WEIGHED[0]}::DOUBLE * gz * q"), ("e", "position", "ge")):
            out += f", {name}{i} AS MATERIALIZED (SELECT o.{code}, {fit_sql._adam('o', 'coalesce(g, 0)', i, 0.1, ('x', 'm', 's'))} FROM {name}{j} o LEFT JOIN (SELECT {code}, sum({g}) AS g FROM g{i} GROUP BY 1) d USING ({code}))"
    n = iterations
    losses = " UNION ALL ".join(f"SELECT 'loss', {i}::BIGINT, {r('sum(l)', 'value')} FROM g{i}" for i in range(1, n + 1))
    return out + f" SELECT 'quotient' AS kind, quotient::BIGINT AS k, {r('x', 'value')} FROM q{n} UNION ALL SELECT 'remainder', remainder::BIGINT, {r('x', 'value')} FROM r{n} UNION ALL SELECT 'rank', position::BIGINT, {r('x', 'value')} FROM e{n} UNION ALL {losses}"


register("fit_pbm_qr", _fit_pbm_qr, _fit_pbm_qr_sql())


def _fit_robe(s: SparkSession, d: str) -> DataFrame:
    return _losses(s, compressed.fit_compressed(fit.cells(Log(s, d).train, ["query_doc_id"]), shared_array(s, d), iterations=4)[2])


register("fit_dctr_robe", _fit_robe)

# ---- mixtures with shared parameters --------------------------------------------------------------------------


def _tied(names: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    """Prior, attraction and rank logits of a mixture whose models share the documents' attraction."""

    def build(p: dict[str, Param]) -> dict[str, models.ClickModel]:
        made = {
            "dctr": lambda: models.RateModel(p["attraction"]), "pbm": lambda: models.PositionBased(p["attraction"], p["examination"]),
            "dbn": lambda: models.DynamicBayesian(p["attraction"], Param("satisfaction", baseline=float(_SATISFIED[0])), data.GOING),
        }
        return {n: made[n]() for n in names}

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = Log(s, d).train
        smooth = (F.sum("click") + 1.0) / (F.count("*") + 2.0)
        tables = {n: ((k,), fit.start(rows, [k], smooth)) for n, k in (("attraction", "query_doc_id"), ("examination", "position"))}
        model, tables, _ = fit.fit_tied_mixture(build, tables, {n: 1 / len(names) for n in names}, rows, iterations=2)
        out = s.createDataFrame([("prior", i + 1, float(model.prior[n])) for i, n in enumerate(names)], "kind string, k long, value double")  # a row for each model
        for name, key in (("attraction", "query_doc_id"), ("examination", "position")):
            out = out.union(tables[name].select(F.lit(name).alias("kind"), lg(key, "k"), F.col("logit").alias("value")))
        return out.select("kind", "k", rd("value", "value"))

    return run


def _tied_sql(with_dbn: bool, iterations: int = 2) -> str:
    zero = "0::DOUBLE AS m, 0::DOUBLE AS s"
    rate = "(sum(click) + 1)::DOUBLE / (count(*) + 2)"
    k, names = (3, ("dctr", "pbm", "dbn")) if with_dbn else (2, ("dctr", "pbm"))
    out = LOG + f""", tot AS (SELECT sum(w) AS total FROM tr), a0 AS (SELECT query_doc_id, ln({rate} / (1 - {rate})) AS x, {zero} FROM tr GROUP BY 1), e0 AS (SELECT position, ln({rate} / (1 - {rate})) AS x, {zero} FROM tr GROUP BY 1),
w0 AS (SELECT {', '.join(f'{1 / k!r}::DOUBLE AS w{i}' for i in range(1, k + 1))})"""
    for i in range(1, iterations + 1):
        j = i - 1
        out += f", v{i} AS MATERIALIZED (SELECT tr.*, 1 / (1 + exp(-a{j}.x)) AS a, 1 / (1 + exp(-e{j}.x)) AS t, 0.4::DOUBLE AS s, 0.5::DOUBLE AS c FROM tr JOIN a{j} USING (query_doc_id) JOIN e{j} ON e{j}.position = tr.position)"
        if with_dbn:
            out += chain_cond("dbn", f"v{i}", f"d{i}") + fit_sql.gradients("dbn", f"d{i}")
        rows, lps = (f"grd{i}", ("ln(a)", "ln(t) + ln(a)", "lp")) if with_dbn else (f"v{i}", ("ln(a)", "ln(t) + ln(a)"))
        losses = [f"sum({bce(lp)})" for lp in lps]
        out += f""", n{i} AS (SELECT session_id, {', '.join(f'ln(w{q + 1}) - ll{q + 1} AS z{q + 1}' for q in range(k))} FROM (SELECT session_id, {', '.join(f'{x} AS ll{q + 1}' for q, x in enumerate(losses))} FROM {rows} GROUP BY 1), w{j}),
p{i} AS MATERIALIZED (SELECT session_id, {', '.join(f"1 / ({' + '.join(f'exp(z{o} - z{q})' for o in range(1, k + 1))}) AS p{q}" for q in range(1, k + 1))} FROM n{i}),
w{i} AS (SELECT {', '.join(f'avg(p{q}) AS w{q}' for q in range(1, k + 1))} FROM p{i}),
g{i} AS MATERIALIZED (SELECT r.query_doc_id, r.position, (p1 * w * (a - click) + p2 * w * CASE WHEN click = 1 THEN a - 1 ELSE a * t / (1 - a * t) * (1 - a) END{' + p3 * (' + fit_sql.BY_ATTRACTION['dbn'] + ')' if with_dbn else ''}) / total AS ga,
  p2 * w * CASE WHEN click = 1 THEN t - 1 ELSE a * t / (1 - a * t) * (1 - t) END / total AS ge FROM {rows} r JOIN p{i} USING (session_id), tot)"""
        for name, key, g in (("a", "query_doc_id", "ga"), ("e", "position", "ge")):
            out += f", {name}{i} AS MATERIALIZED (SELECT o.{key}, {fit_sql._adam('o', 'coalesce(g, 0)', i, 0.05, ('x', 'm', 's'))} FROM {name}{j} o LEFT JOIN (SELECT {key}, sum({g}) AS g FROM g{i} GROUP BY 1) z USING ({key}))"
    n = iterations
    priors = " UNION ALL ".join(f"SELECT 'prior' AS kind, {q}::BIGINT AS k, {r(f'w{q}', 'value')} FROM w{n}" for q in range(1, k + 1))
    return out + f" {priors} UNION ALL SELECT 'attraction', query_doc_id::BIGINT, {r('x', 'value')} FROM a{n} UNION ALL SELECT 'examination', position::BIGINT, {r('x', 'value')} FROM e{n}"


register("fit_mixture_tied", _tied(("dctr", "pbm")), _tied_sql(False))
register("fit_mixture_tied_chain", _tied(("dctr", "pbm", "dbn")), _tied_sql(True))

# ---- key sketches, readers and result files -------------------------------------------------------------------

FINE, FACTORS = 100, [1, 2, 5, 10, 50]


def _sweep(s: SparkSession, d: str) -> DataFrame:
    """Rows of each bucket at each setting, and whether the estimated ids are within a twentieth of the exact ones."""
    ids_ = data.impressions(s, d).select("query_doc_id", keys.universal_hash(FINE, F.col("query_doc_id")).alias("fine"))
    found = keysets.compression_sweep(keysets.key_sketches(ids_, "query_doc_id", F.col("fine")), FACTORS)
    each = ids_.distinct().select("fine", F.explode(F.array(*map(F.lit, FACTORS))).alias("factor"))
    exact = each.groupBy("factor", F.expr("fine div factor").alias("bucket")).agg(F.count("*").alias("exact"))
    near = F.abs(F.col("ids") - F.col("exact")) <= 0.05 * F.col("exact")
    return found.join(exact, ["factor", "bucket"]).select(lg("factor"), lg("bucket"), lg("rows"), near.alias("near"))


register(
    "compression_sweep",
    _sweep,
    LOG + f", f AS (SELECT {_h('query_doc_id', FINE)} AS fine FROM imp) SELECT factor::BIGINT AS factor, (fine // factor)::BIGINT AS bucket, count(*)::BIGINT AS rows, true AS near FROM f, unnest({FACTORS}) u(factor) GROUP BY 1, 2",
)


def _written(rows: DataFrame, columns: list[str]) -> str:
    """A folder of the shared place with the rows as session files of a layout."""
    path = f"{fit.shared_dir(rows.sparkSession)}/layout-{uuid.uuid4().hex}"
    rows.select(*columns).write.parquet(path)
    return f"{path}/*.parquet"


def _read_queries(s: SparkSession, d: str) -> DataFrame:
    x = S.read_query_sessions(s, _written(data.session_rows(s, d), ["query_id", "query_doc_ids", "clicks"]), 5)
    return x.select(lg("query_id"), *_lists(x, "query_doc_ids", "positions", "clicks"))


def _read_ids(s: SparkSession, d: str) -> DataFrame:
    x = S.read_id_sessions(s, _written(data.session_rows(s, d), ["query_doc_ids", "clicks"]))
    return x.select(*_lists(x, "query_doc_ids", "positions", "clicks"))


def _feature_files(s: SparkSession, d: str) -> DataFrame:
    x = _feature_sessions(s, d)
    return x.withColumn("labels", F.col("labels").cast("array<double>")).withColumn("positions", F.col("positions").cast("array<int>"))


def _feature_sum(c: str):
    return rd(exprs.total(F.transform(c, lambda x: x.cast("double"))), "feature_sum", 5)


def _read_features(s: SparkSession, d: str) -> DataFrame:
    x = S.read_feature_sessions(s, _written(_feature_files(s, d), ["query_doc_features", "positions", "clicks"]), 6)
    return S.explode(x, {"query_doc_features": "f", "positions": "p", "clicks": "click"}, []).select(lg("p", "position"), lg("click"), _feature_sum("f"))


def _read_annotations(s: SparkSession, d: str) -> DataFrame:
    x = S.read_annotations(s, _written(_feature_files(s, d), ["query_doc_features", "labels"]))
    return S.explode(x, {"query_doc_features": "f", "labels": "label"}, []).select(lg("position"), lg("label"), _feature_sum("f"))


_CUT = "list_transform(range(1, least(len(docs), 5) + 1), lambda i: {})"
register("read_query_sessions", _read_queries, LOG + f" SELECT query_id::BIGINT AS query_id, array_to_string({_CUT.format('docs[i]')}, ',') AS query_doc_ids, array_to_string({_CUT.format('i')}, ',') AS positions, array_to_string({_CUT.format('clicks[i]')}, ',') AS clicks FROM ses")
register("read_id_sessions", _read_ids, ORACLES_OF["layout_id_sessions"])
register("read_feature_sessions", _read_features, ANN + f" SELECT doc_ord::BIGINT AS position, click::BIGINT AS click, {r(FSUM, 'feature_sum', 5)} FROM ann WHERE doc_ord <= 6")
register("read_annotations", _read_annotations, ANN + f" SELECT doc_ord::BIGINT AS position, label::BIGINT AS label, {r(FSUM, 'feature_sum', 5)} FROM ann")


def _result_files(s: SparkSession, d: str) -> DataFrame:
    """Mean loss of two models on each split of the log by session, written as result files and read back with their tags."""
    log, path = Log(s, d), f"{fit.shared_dir(s)}/results-{uuid.uuid4().hex}"
    for name in ("dctr", "rctr"):
        scored = log.model(name).score(log.test, ("cond_log_prob",))
        for seed in (0, 1):
            loss = exprs.bce_log(F.col("click"), F.col("cond_log_prob"))
            part = scored.where(F.col("session_id") % 2 == seed).agg(F.round(F.avg(loss), 9).alias("loss"))
            reports.write_results(part.select("loss", F.lit(f"splits_method=rate_ratio=1_seed={seed}").alias("experiment"), F.lit(name).alias("model")), path)
    found = reports.read_results(s, f"{path}/*/*", "loss double")
    return found.select("experiment", "model", "method", lg("ratio"), lg("seed"), rd("loss", "loss"))


register(
    "result_files",
    _result_files,
    LOG + f", x AS (SELECT session_id % 2 AS seed, {bce('ln(a)')} AS dctr, {bce('ln(t)')} AS rctr FROM ev) "
    + " UNION ALL ".join(f"SELECT 'splits_method=rate_ratio=1_seed=' || seed AS experiment, '{m}' AS model, 'rate' AS method, 1::BIGINT AS ratio, seed::BIGINT AS seed, {r(f'avg({m})', 'loss')} FROM x GROUP BY seed" for m in ("dctr", "rctr")),
)

# ---- one gradient of the networks' own fits -------------------------------------------------------------------


def _linear_step(s: SparkSession, d: str) -> DataFrame:
    """The gradient of a linear click-through rate by its weights."""
    grads, _ = features.gradients(feature_log(s, d).select("features", "click", "w"), LINEAR, features.cross_entropy, 2)
    return _rows(s, grads, np.zeros(0), "")


register("linear_ctr_grad_step", _linear_step, FL + f", g AS (SELECT *, w * (a - click) AS gz FROM fl) {BY_WEIGHT}")
#: A network of one hidden layer with few units, whose gradient SQL writes out.
SMALL = features.Deep.seeded(64, (3,), 7)


def _deep_step(s: SparkSession, d: str) -> DataFrame:
    """The gradient by the weights of both layers, each as a row."""
    grads, _ = features.gradients(feature_log(s, d).select("features", "click", "w"), SMALL, features.cross_entropy, 2)
    found = [("hidden", i * 3 + j, float(grads[0][i, j])) for i in range(64) for j in range(3)] + [("hidden_bias", j, float(g)) for j, g in enumerate(grads[1])]
    found += [("top", j, float(g)) for j, g in enumerate(grads[2][:, 0])] + [("top_bias", 0, float(grads[3][0]))]
    return s.createDataFrame(found, "kind string, k long, g double").select("kind", "k", rd("g", "g", 5))


_top = fit_sql._numbers(SMALL.layers[1][0][:, 0])
register(
    "deep_ctr_grad_step",
    _deep_step,
    FL + f""", h AS (SELECT *, list_transform({fit_sql._product('x', SMALL.layers[0][0])}, lambda v: CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END) AS h FROM fl),
g AS (SELECT *, w * (1 / (1 + exp(-list_inner_product(h, {_top}))) - click) AS gz FROM h),
b AS (SELECT *, list_transform(range(1, 4), lambda j: gz * {_top}[j] * CASE WHEN h[j] > 0 THEN 1 ELSE h[j] + 1 END) AS back FROM g)
SELECT 'hidden' AS kind, ((o - 1) * 3 + q - 1)::BIGINT AS k, {r('sum(x[o] * back[q])', 'g', 5)} FROM b, unnest(range(1, 65)) u(o), unnest(range(1, 4)) y(q) GROUP BY o, q
UNION ALL SELECT 'hidden_bias', (q - 1)::BIGINT, {r('sum(back[q])', 'g', 5)} FROM b, unnest(range(1, 4)) y(q) GROUP BY q UNION ALL SELECT 'top', (q - 1)::BIGINT, {r('sum(gz * h[q])', 'g', 5)} FROM b, unnest(range(1, 4)) y(q) GROUP BY q UNION ALL SELECT 'top_bias', 0::BIGINT, {r('sum(gz)', 'g', 5)} FROM b""",
)
