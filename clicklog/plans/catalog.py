"""Registered queries, each with the SQL that must give the same rows (where SQL can)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clicklog.functions import exprs, keys
from clicklog.operators import features, fit, keysets, metrics, models, reports
from clicklog.operators.params import Param, from_rates, hashed
from clicklog.plans import data, fit_sql
from clicklog.plans.data import Log
from clicklog.plans.oracle import BACK, IDS, LOG, LOG_ALL, LOG_TRAIN, RATE, P, bce, chain_cond, chain_uncond, r, u, ubm_uncond
from clicklog.sources import sessions as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def rd(c: Column | str, name: str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c.cast("double"), digits) + 0.0).alias(name)


def lg(c: Column | str, name: str | None = None) -> Column:
    out = (F.col(c) if isinstance(c, str) else c).cast("long")
    return out.alias(name or c)



def ids() -> list[Column]:
    return [lg("session_id"), lg("position")]


# ---- sources, slices, projections -----------------------------------------------------------------------------


def _lists(df: DataFrame, *cols: str) -> list[Column]:
    return [F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) for c in cols]


register(
    "scan_sessions",
    lambda s, d: S.scan(s, f"{d}/orders.parquet", "o_orderkey bigint, o_custkey bigint").select(lg("o_orderkey", "session_id"), lg("o_custkey", "query_id")),
    "SELECT o_orderkey::BIGINT AS session_id, o_custkey::BIGINT AS query_id FROM orders",
)
register(
    "session_range_slice",
    lambda s, d: S.session_range(s, f"{d}/orders.parquet", 100, 1100).select(lg("o_orderkey", "session_id"), lg("ordinal")),
    "SELECT session_id, ordinal FROM (SELECT o_orderkey::BIGINT AS session_id, (row_number() OVER () - 1)::BIGINT AS ordinal FROM orders) WHERE ordinal >= 100 AND ordinal < 1100",
)
register(
    "session_count",
    lambda s, d: s.createDataFrame([(S.session_count(s, f"{d}/orders.parquet", 100, 1100),)], "sessions long"),
    "SELECT least(greatest(count(*) - 100, 0), 1000)::BIGINT AS sessions FROM orders",
)
register(
    "layout_query_sessions",
    lambda s, d: (x := data.session_rows(s, d)).select(lg("query_id"), F.size("query_doc_ids").cast("long").alias("n"), *_lists(x, "query_doc_ids", "clicks")),
    LOG + " SELECT query_id::BIGINT AS query_id, len(docs)::BIGINT AS n, array_to_string(docs, ',') AS query_doc_ids, array_to_string(clicks, ',') AS clicks FROM ses",
)
register(
    "layout_id_sessions",
    lambda s, d: (x := data.session_rows(s, d)).select(*_lists(x, "query_doc_ids", "positions", "clicks")),
    LOG + " SELECT array_to_string(docs, ',') AS query_doc_ids, array_to_string(positions, ',') AS positions, array_to_string(clicks, ',') AS clicks FROM ses",
)


def _feature_sessions(s: SparkSession, d: str) -> DataFrame:
    rows = data.annotations(s, d)
    item = F.struct("doc_ord", "click", "label", "embedding")
    whole = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("i"))
    return whole.select("query_id", F.col("i.embedding").alias("query_doc_features"), F.col("i.doc_ord").alias("positions"), F.col("i.click").alias("clicks"), F.col("i.label").alias("labels"))


ANN = """WITH ann AS (SELECT vec_id % 25 AS query_id, vec_id, embedding, label % 5 AS label, CASE WHEN label >= 7 THEN 1 ELSE 0 END AS click,
  row_number() OVER (PARTITION BY vec_id % 25 ORDER BY vec_id) AS doc_ord FROM embeddings)"""
FSUM = "list_sum(list_transform(embedding, lambda x: x::DOUBLE))"
register(
    "layout_feature_sessions",
    lambda s, d: S.explode(_feature_sessions(s, d), {"query_doc_features": "f", "positions": "p", "clicks": "click"}, ["query_id"]).select(lg("query_id"), lg("p", "position"), lg("click"), rd(exprs.total(F.transform("f", lambda x: x.cast("double"))), "feature_sum", 5)),
    ANN + f" SELECT query_id::BIGINT AS query_id, doc_ord::BIGINT AS position, click::BIGINT AS click, {r(FSUM, 'feature_sum', 5)} FROM ann",
)
register(
    "layout_annotations",
    lambda s, d: S.explode(_feature_sessions(s, d), {"query_doc_features": "f", "labels": "label"}, ["query_id"]).select(lg("query_id"), lg("position"), lg("label"), rd(exprs.total(F.transform("f", lambda x: x.cast("double"))), "feature_sum", 5)),
    ANN + f" SELECT query_id::BIGINT AS query_id, doc_ord::BIGINT AS position, label::BIGINT AS label, {r(FSUM, 'feature_sum', 5)} FROM ann",
)
register(
    "explode_impressions",
    lambda s, d: S.explode(data.session_rows(s, d), {"query_doc_ids": "query_doc_id", "clicks": "click"}, ["session_id"]).select(*ids(), lg("query_doc_id"), lg("click")),
    LOG + f" SELECT {IDS}, query_doc_id::BIGINT AS query_doc_id, click::BIGINT AS click FROM imp0",
)
register(
    "truncate_positions",
    lambda s, d: S.explode(data.session_rows(s, d), {"query_doc_ids": "query_doc_id", "clicks": "click"}, ["session_id"], 3).select(*ids(), lg("query_doc_id"), lg("click")),
    LOG + f" SELECT {IDS}, query_doc_id::BIGINT AS query_doc_id, click::BIGINT AS click FROM imp0 WHERE position <= 3",
)
# positions in the order of the document ids, so that they do not ascend
register(
    "truncate_by_position_value",
    lambda s, d: S.truncate_by_value(
        data.raw_impressions(s, d).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("query_doc_id", "position", "click"))).alias("i")).select("session_id", F.col("i.position").alias("positions"), F.col("i.click").alias("clicks")), "positions", ["clicks"], 3
    ).select(lg("session_id"), *_lists(None, "positions", "clicks")),
    LOG + ", o AS (SELECT session_id, list(position ORDER BY query_doc_id, position) AS ps, list(click ORDER BY query_doc_id, position) AS cs FROM imp0 GROUP BY 1), q AS (SELECT *, len(list_filter(ps, lambda x: x <= 3)) AS k FROM o) SELECT session_id::BIGINT AS session_id, array_to_string(ps[1:k], ',') AS positions, array_to_string(cs[1:k], ',') AS clicks FROM q",
)
register(
    "frequent_queries",
    lambda s, d: S.frequent(Log(s, d).train.select("session_id", "query_id").distinct(), "query_id", 3).select(lg("query_id"), lg("sessions")),
    LOG + " SELECT query_id::BIGINT AS query_id, count(DISTINCT session_id)::BIGINT AS sessions FROM tr GROUP BY 1 HAVING count(DISTINCT session_id) >= 3",
)


def _filter_frequent(s: SparkSession, d: str) -> DataFrame:
    log = Log(s, d)
    often = S.frequent(log.train.select("session_id", "query_id").distinct(), "query_id", 10)
    return S.keep_frequent(log.test, often, "query_id").select(*ids(), lg("query_id"))


register("filter_frequent_queries", _filter_frequent, LOG + f" SELECT {IDS}, query_id::BIGINT AS query_id FROM te WHERE query_id IN (SELECT query_id FROM tr GROUP BY 1 HAVING count(DISTINCT session_id) >= 10)")
register(
    "pad_sessions",
    lambda s, d: (x := data.session_rows(s, d)).select(lg("session_id"), S.pad(F.col("query_doc_ids"), 10, F.lit(0).cast("long")).alias("query_doc_ids"), S.mask(F.col("clicks"), 10).alias("mask")).select("session_id", *_lists(x, "query_doc_ids", "mask")),
    LOG + " SELECT session_id::BIGINT AS session_id, array_to_string(list_concat(docs, [0,0,0,0,0,0,0,0,0,0])[1:10], ',') AS query_doc_ids, array_to_string(list_transform(range(1, 11), lambda i: CASE WHEN i <= len(docs) THEN 'true' ELSE 'false' END), ',') AS mask FROM ses",
)


def _rolling(s: SparkSession, d: str) -> DataFrame:
    rows = data.table(s, d, "orders").select(F.col("o_orderkey").alias("session_id"))
    size = rows.agg(F.max("session_id").alias("m")).first()["m"]
    return S.rolling_splits(rows, F.col("session_id"), size).select(lg("session_id"), lg("fold"), "split")


register(
    "rolling_splits",
    _rolling,
    "WITH m AS (SELECT max(o_orderkey) AS z FROM orders), x AS (SELECT o_orderkey::BIGINT AS session_id, f::BIGINT AS fold, o_orderkey - floor(z * 0.125 * f)::BIGINT AS nth, z FROM orders, m, range(0, 3) t(f)) SELECT * FROM (SELECT session_id, fold, CASE WHEN nth < 0 THEN NULL WHEN nth < floor(z * 0.5) THEN 'train' WHEN nth < floor(z * 0.625) THEN 'val' WHEN nth < floor(z * 0.75) THEN 'test' END AS split FROM x) WHERE split IS NOT NULL",
)

# ---- joins ----------------------------------------------------------------------------------------------------


def _param_lookup(s: SparkSession, d: str) -> DataFrame:
    log = Log(s, d)
    p = log.attraction
    return p.lookup(log.rows).select(*ids(), rd(p.prob(), "alpha"))


register("param_lookup", _param_lookup, LOG_ALL + f" SELECT {IDS}, {r('a', 'alpha')} FROM ev")
register("cold_start_docs", lambda s, d: keysets.cold_start((x := Log(s, d)).test, x.known, "query_doc_id").select(lg("query_doc_id")), LOG + " SELECT DISTINCT query_doc_id::BIGINT AS query_doc_id FROM te WHERE query_doc_id NOT IN (SELECT query_doc_id FROM seen)")
register(
    "ubm_rank_pairs",
    lambda s, d: keysets.rank_pairs(data.impressions(s, d)).select(*ids(), lg("earlier")),
    LOG_ALL + " SELECT k.session_id::BIGINT AS session_id, k.position::BIGINT AS position, i.position::BIGINT AS earlier FROM te k JOIN te i ON k.session_id = i.session_id AND i.position < k.position UNION ALL SELECT session_id::BIGINT, position::BIGINT, 0::BIGINT FROM te",
)

# ---- windows --------------------------------------------------------------------------------------------------
register("no_clicks_before", lambda s, d: data.impressions(s, d).withColumn("open", (models.clicks_before() == 0).cast("long")).select(*ids(), "open"), LOG + f" SELECT {IDS}, (coalesce(sum(click) OVER ({BACK}), 0) = 0)::BIGINT AS open FROM imp")
register("last_click_position", lambda s, d: data.impressions(s, d).withColumn("last_pos", models.last_click_position()).select(*ids(), lg("last_pos")), LOG + f" SELECT {IDS}, coalesce(max(CASE WHEN click = 1 THEN position END) OVER ({BACK}), 0)::BIGINT AS last_pos FROM imp")


def _exam_prefix(s: SparkSession, d: str) -> DataFrame:
    log = Log(s, d)
    p = log.attraction
    return p.lookup(log.rows).withColumn("x", models.prefix(p.log_complement())).select(*ids(), rd("x", "exam"))


register("exam_prefix", _exam_prefix, LOG_ALL + f" SELECT {IDS}, {r(f'coalesce(sum(ln(1 - a)) OVER ({BACK}), 0)', 'exam')} FROM ev")


def _scored_annotations(s: SparkSession, d: str) -> DataFrame:
    weights = features.fixed_weights(64)
    return data.annotations(s, d).withColumn("score", F.round(exprs.linear_score(F.col("embedding"), F.array(*map(F.lit, weights))), 9))


SCORE = "round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ws[i])), 9)"
ANN_SCORED = ANN + f""", wt AS (SELECT list((((12345 + 1103515245 * i) % {P})::DOUBLE / {P} * 2 - 1) ORDER BY i) AS ws FROM range(1, 65) t(i)),
sc AS (SELECT ann.*, {SCORE} AS score FROM ann, wt), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_ord) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY label DESC, doc_ord) AS ideal_rank FROM sc)"""
register("rank_documents", lambda s, d: metrics.ranked(_scored_annotations(s, d)).select(lg("query_id"), lg("doc_ord"), lg("rank")), ANN_SCORED + " SELECT query_id::BIGINT AS query_id, doc_ord::BIGINT AS doc_ord, rank::BIGINT AS rank FROM rk")
register("topn_documents", lambda s, d: metrics.ranked(_scored_annotations(s, d)).where("rank <= 5").select(lg("query_id"), lg("doc_ord"), lg("rank")), ANN_SCORED + " SELECT query_id::BIGINT AS query_id, doc_ord::BIGINT AS doc_ord, rank::BIGINT AS rank FROM rk WHERE rank <= 5")

# ---- scalar functions, over a column of the line items --------------------------------------------------------
X = "(l_quantity::DOUBLE - 25) / 3"


def _fn(make: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = data.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_quantity").cast("double") - 25) / 3).alias("x"))
        return rows.select(lg("l_orderkey", "session_id"), lg("l_linenumber", "line"), rd(make(F.col("x")), "y"))

    return run


def _fn_sql(expression: str) -> str:
    return f"SELECT l_orderkey::BIGINT AS session_id, l_linenumber::BIGINT AS line, {r(expression, 'y')} FROM (SELECT *, {X} AS x FROM lineitem)"


register("fn_log_sigmoid", _fn(exprs.log_sigmoid), _fn_sql("-ln(1 + exp(-x))"))
register("fn_log_sigmoid_complement", _fn(exprs.log_sigmoid_complement), _fn_sql("-ln(1 + exp(x))"))
register("fn_clipped_log", _fn(lambda x: exprs.clipped_log(x / 5)), _fn_sql("ln(greatest(least(x / 5, 1), 1e-10))"))
register("fn_log1mexp", _fn(lambda x: exprs.log1mexp(-F.abs(x) - 0.01)), _fn_sql("ln(1 - exp(-abs(x) - 0.01::DOUBLE))"))
register("fn_logaddexp", _fn(lambda x: exprs.logaddexp(x, F.lit(0.5) - x)), _fn_sql("ln(exp(x) + exp(0.5::DOUBLE - x))"))
register("fn_logsumexp", _fn(lambda x: exprs.logsumexp(F.array(x, F.lit(0.5) - x, F.lit(1.0)))), _fn_sql("ln(exp(x) + exp(0.5::DOUBLE - x) + exp(1::DOUBLE))"))


def _embedding(make: Callable[[Column], Column], digits: int = 5) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: data.table(s, d, "embeddings").select(lg("vec_id"), rd(make(F.col("embedding")), "y", digits))


MEAN = "list_avg(list_transform(embedding, lambda x: x::DOUBLE))"
NORMED = f"""nm AS (SELECT *, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding) AS mu FROM embeddings),
ln_ AS (SELECT *, list_transform(embedding, lambda x: (x::DOUBLE - mu) / sqrt(list_sum(list_transform(embedding, lambda z: (z::DOUBLE - mu) * (z::DOUBLE - mu))) / len(embedding) + 1e-6::DOUBLE)) AS z FROM nm)"""
WEIGHTS = f"wt AS (SELECT list((((12345 + 1103515245 * i) % {P})::DOUBLE / {P} * 2 - 1) ORDER BY i) AS ws FROM range(1, 65) t(i))"
W64 = features.fixed_weights(64)
register("fn_layer_norm", _embedding(lambda e: exprs.total(F.transform(exprs.layer_norm(e), lambda v: v * v * v))), f"WITH {NORMED} SELECT vec_id::BIGINT AS vec_id, {r('list_sum(list_transform(z, lambda v: v * v * v))', 'y', 5)} FROM ln_")
register("fn_linear_score", _embedding(lambda e: exprs.linear_score(e, F.array(*map(F.lit, W64)), 0.25)), f"WITH {WEIGHTS} SELECT vec_id::BIGINT AS vec_id, {r('list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ws[i])) + 0.25::DOUBLE', 'y', 5)} FROM embeddings, wt")
register("embedding_projection", _embedding(lambda e: exprs.linear_score(e, F.array(*map(F.lit, W64)))), f"WITH {WEIGHTS} SELECT vec_id::BIGINT AS vec_id, {r('list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ws[i]))', 'y', 5)} FROM embeddings, wt")
register("linear_attraction", _embedding(lambda e: exprs.log_sigmoid(exprs.linear_score(exprs.layer_norm(e), F.array(*map(F.lit, W64)), -0.5))), f"WITH {NORMED}, {WEIGHTS} SELECT vec_id::BIGINT AS vec_id, {r('-ln(1 + exp(-(list_sum(list_transform(range(1, 65), lambda i: z[i] * ws[i])) - 0.5::DOUBLE)))', 'y', 5)} FROM ln_, wt")


def _network(network: object) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: features.score(data.table(s, d, "embeddings").select(lg("vec_id"), F.col("embedding").alias("features")), network).select("vec_id", rd("logit", "logit"))


for _n, _net in (("deep", features.Deep.seeded(64)), ("deepcross", features.DeepCross(64)), ("deepcross_parallel", features.DeepCross(64, stacked=False))):
    register(f"{_n}_attraction", _network(_net), fit_sql.network(_net, NORMED))


def _pbm_by_features(s: SparkSession, d: str) -> DataFrame:
    """The position-based model with attraction by features, on the annotated lists (their order is the rank)."""
    rows = data.annotations(s, d).withColumn("position", F.col("doc_ord")).withColumn("w", F.lit(1.0))
    t = from_rates("examination", fit.rates(rows, ["position"], clicks=1.0, views=2.0), ("position",), "rate", 0.5)
    a = Param("attraction", fixed=features.linear_logit("embedding", W64, -0.5))
    return models.PositionBased(a, t).score(rows, ("log_prob",)).select(lg("vec_id"), rd("log_prob", "log_prob", 5))


LINEAR_SQL = "list_sum(list_transform(range(1, 65), lambda i: z[i] * ws[i])) - 0.5::DOUBLE"
register(
    "pbm_feature_attraction",
    _pbm_by_features,
    ANN + f""", {NORMED}, {WEIGHTS}, ex AS (SELECT doc_ord, (sum(click) + 1)::DOUBLE / (count(*) + 2) AS t FROM ann GROUP BY 1)
SELECT ann.vec_id::BIGINT AS vec_id, {r(f'ln(t) - ln(1 + exp(-({LINEAR_SQL})))', 'log_prob', 5)} FROM ann JOIN ex USING (doc_ord) JOIN ln_ ON ann.vec_id = ln_.vec_id CROSS JOIN wt""",
)


def _bce(from_log: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        log = Log(s, d)
        p = log.attraction
        loss = exprs.bce_log(F.col("click"), p.log_prob()) if from_log else exprs.bce_prob(F.col("click"), p.prob())
        return p.lookup(log.rows).select(*ids(), rd(loss, "loss"))

    return run


register("bce_log", _bce(True), LOG_ALL + f" SELECT {IDS}, {r(bce('ln(a)'), 'loss')} FROM ev")
register("bce_prob", _bce(False), LOG_ALL + f" SELECT {IDS}, {r('-(CASE WHEN click = 1 THEN ln(a) ELSE ln(1 - a) END)', 'loss')} FROM ev")

# ---- compressed keys ------------------------------------------------------------------------------------------
#: The number of document ids, in SQL.
N = "(SELECT max(p_partkey) + 1 FROM part)"


def n_docs(s: SparkSession, d: str) -> int:
    return data.table(s, d, "part").agg((F.max("p_partkey") + 1).cast("long").alias("n")).first()["n"]


def _h(x: str, size: int | str) -> str:
    return f"floor(((12345 + (1103515245 * {x}) % {P}) % {P})::DOUBLE / {P} * {size})::BIGINT"


def _h2(x: str, o: str, size: int) -> str:
    return f"floor(((12345 + (1103515245 * {x}) % {P} + (69069 * {o}) % {P}) % {P})::DOUBLE / {P} * {size})::BIGINT"


def _parts(make: Callable[[Column, int], list[Column]]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: data.table(s, d, "part").select(lg("p_partkey", "query_doc_id"), *make(F.col("p_partkey"), n_docs(s, d)))


KEY_SQL = "SELECT p_partkey::BIGINT AS query_doc_id, "
register("universal_hash", _parts(lambda k, _: [keys.universal_hash(1000, k).alias("bucket")]), KEY_SQL + f"{_h('p_partkey', 1000)} AS bucket FROM part")
register("hash_trick_keys", _parts(lambda k, size: [c.alias(n) for c, n in zip(keys.hash_trick(k, size), ("bucket", "sign"), strict=True)]), KEY_SQL + f"{_h('p_partkey', f'(({N} + 9) // 10)')} AS bucket, (2 * {_h2('p_partkey', '0', 2)} - 1)::BIGINT AS sign FROM part")
register("qr_keys", _parts(lambda k, size: [c.alias(n) for c, n in zip(keys.quotient_remainder(k, size), ("quotient", "remainder"), strict=True)]), KEY_SQL + f"({_h('p_partkey', N)} // 10)::BIGINT AS quotient, ({_h('p_partkey', N)} % 10)::BIGINT AS remainder FROM part")
register(
    "robe_keys",
    _parts(lambda k, size: [F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(n) for c, n in zip(keys.robe(k, size, 4), ("slots", "signs"), strict=True)]),
    KEY_SQL + f"array_to_string(list_transform(range(0, 4), lambda o: ({_h('p_partkey', 'slots')} + o) % slots), ',') AS slots, array_to_string(list_transform(range(0, 4), lambda o: 2 * {_h2('p_partkey', 'o', 2)} - 1), ',') AS signs FROM part, (SELECT greatest(1, (max(p_partkey) + 1) * 4 // 1000) AS slots FROM part) z",
)
register("compression_profile", lambda s, d: keysets.compression_profile(data.impressions(s, d), "query_doc_id", keys.hash_trick(F.col("query_doc_id"), n_docs(s, d), 100)[0]).select(lg("bucket"), lg("rows"), lg("ids")), LOG + f" SELECT {_h('query_doc_id', f'(({N} + 99) // 100)')} AS bucket, count(*)::BIGINT AS rows, count(DISTINCT query_doc_id)::BIGINT AS ids FROM imp GROUP BY 1")

# ---- click models ---------------------------------------------------------------------------------------------


def _score(model: str, *only: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        log = Log(s, d)
        return log.model(model).score(log.rows, only).select(*ids(), *(rd(c, c) for c in only))

    return run


ALL = ("cond_log_prob", "log_prob", "relevance")
for _m, _p in (("gctr", "ln(rho)"), ("rctr", "ln(t)"), ("dctr", "ln(a)"), ("drctr", "ln(d)")):
    register(f"{_m}_score", _score(_m, *ALL), LOG_ALL + f" SELECT {IDS}, {', '.join(r(_p, c) for c in ALL)} FROM ev")
register("pbm_score", _score("pbm", *ALL), LOG_ALL + f" SELECT {IDS}, {r('ln(t) + ln(a)', 'cond_log_prob')}, {r('ln(t) + ln(a)', 'log_prob')}, {r('ln(a)', 'relevance')} FROM ev")
register("ubm_cond", _score("ubm", "cond_log_prob"), LOG_ALL + f" SELECT ev.session_id::BIGINT AS session_id, ev.position::BIGINT AS position, {r('ln(coalesce(pu.theta, rho)) + ln(a)', 'cond_log_prob')} FROM ev LEFT JOIN pu ON ev.position = pu.position AND ev.last_pos = pu.last_pos")
register("ubm_uncond", _score("ubm", "log_prob"), LOG_ALL + ubm_uncond() + f" SELECT {IDS}, {r('ln(p)', 'log_prob')} FROM uncond")
CM_UN = f"ln(a) + coalesce(sum(ln(1 - a)) OVER ({BACK}), 0)"
register("cm_uncond", _score("cm", "log_prob"), LOG_ALL + f" SELECT {IDS}, {r(CM_UN, 'log_prob')} FROM ev")
register("cm_cond", _score("cm", "cond_log_prob"), LOG_ALL + f", x AS (SELECT *, coalesce(sum(click) OVER ({BACK}), 0) AS k, {CM_UN} AS lp FROM ev) SELECT {IDS}, {r('CASE WHEN k = 0 THEN lp ELSE ln(1e-8::DOUBLE) END', 'cond_log_prob')} FROM x")
for _m in ("dcm", "ccm", "dbn", "sdbn"):
    register(f"{_m}_cond", _score(_m, "cond_log_prob"), LOG_ALL + chain_cond(_m) + f" SELECT {IDS}, {r('lp', 'cond_log_prob')} FROM cond")
    register(f"{_m}_uncond", _score(_m, "log_prob"), LOG_ALL + chain_uncond(_m) + f" SELECT {IDS}, {r('lp', 'log_prob')} FROM uncond")
register("dbn_relevance", _score("dbn", "relevance"), LOG_ALL + f" SELECT {IDS}, {r('ln(a) + ln(s)', 'relevance')} FROM ev")
register("dbn_global_satisfaction", _score("dbn_global", "cond_log_prob"), LOG_ALL + chain_cond("dbn_global") + f" SELECT {IDS}, {r('lp', 'cond_log_prob')} FROM cond")

MIX = chain_cond("dbn") + f""", mx AS (SELECT *, ln(a) AS l1, ln(t) + ln(a) AS l2, lp AS l3 FROM cond),
nll AS (SELECT session_id, sum({bce('l1')}) AS n1, sum({bce('l2')}) AS n2, sum({bce('l3')}) AS n3 FROM mx GROUP BY 1),
lo AS (SELECT *, least(n1, n2, n3) AS b FROM nll), po AS (SELECT *, exp(b - n1) + exp(b - n2) + exp(b - n3) AS z FROM lo),
post AS (SELECT session_id, b - n1 - ln(z) AS p1, b - n2 - ln(z) AS p2, b - n3 - ln(z) AS p3 FROM po)"""
register("mixture_cond", _score("mixture", "cond_log_prob"), LOG_ALL + MIX + f" SELECT mx.session_id::BIGINT AS session_id, position::BIGINT AS position, {r('ln(exp(l1 + p1) + exp(l2 + p2) + exp(l3 + p3))', 'cond_log_prob')} FROM mx JOIN post USING (session_id)")
register("mixture_uncond", _score("mixture", "log_prob"), LOG_ALL + chain_uncond("dbn") + f" SELECT {IDS}, {r('ln((a + t * a + exp(lp)) / 3)', 'log_prob')} FROM uncond")
register("mixture_posterior", lambda s, d: (x := Log(s, d)).model("mixture").posterior(x.rows).select(lg("session_id"), *(rd(f"post_{m}", f"post_{m}") for m in ("dctr", "pbm", "dbn"))), LOG_ALL + MIX + f" SELECT session_id::BIGINT AS session_id, {r('p1', 'post_dctr')}, {r('p2', 'post_pbm')}, {r('p3', 'post_dbn')} FROM post")
register("mixture_session_nll", lambda s, d: (x := Log(s, d)).model("mixture").session_nll(x.rows).select(lg("session_id"), *(rd(f"nll_{m}", f"nll_{m}") for m in ("dctr", "pbm", "dbn"))), LOG_ALL + MIX + f" SELECT session_id::BIGINT AS session_id, {r('n1', 'nll_dctr')}, {r('n2', 'nll_pbm')}, {r('n3', 'nll_dbn')} FROM nll")

# ---- metrics --------------------------------------------------------------------------------------------------
PBM = LOG + f", sc AS (SELECT *, ln(t) + ln(a) AS lp FROM ev), ob AS (SELECT *, -{bce('lp')} AS o FROM sc)"


def _pbm(s: SparkSession, d: str) -> DataFrame:
    log = Log(s, d)
    return log.model("pbm").score(log.test)


def _dbn(s: SparkSession, d: str) -> DataFrame:
    log = Log(s, d)
    return log.model("dbn").score(log.test)




def loss() -> Column:
    return exprs.bce_log(F.col("click"), F.col("cond_log_prob"))


register("session_mean_loss", lambda s, d: metrics.session_mean(_pbm(s, d), loss()).select(rd("loss", "loss")), PBM + f" SELECT {r('avg(x)', 'loss')} FROM (SELECT avg(-o) AS x FROM ob GROUP BY session_id)")
register("rank_average", lambda s, d: metrics.rank_average(_pbm(s, d), loss()).select(lg("position"), rd("total", "total", 4), lg("n"), rd("mean", "mean")), PBM + f" SELECT position::BIGINT AS position, {r('sum(-o)', 'total', 4)}, count(*)::BIGINT AS n, {r('avg(-o)', 'mean')} FROM ob GROUP BY ROLLUP (position)")
register("average_metric", lambda s, d: metrics.average(_pbm(s, d), F.exp("log_prob")).select(rd("value", "value")), PBM + f" SELECT {r('avg(exp(lp))', 'value')} FROM ob")
register("multi_metric", lambda s, d: _pbm(s, d).agg(rd(F.avg(loss()), "val_loss"), rd(F.avg(F.exp("log_prob")), "val_rate"), rd(F.avg("click"), "val_ctr")), PBM + f" SELECT {r('avg(-o)', 'val_loss')}, {r('avg(exp(lp))', 'val_rate')}, {r('avg(click)', 'val_ctr')} FROM ob")
register("log_likelihood", lambda s, d: metrics.log_likelihood(_pbm(s, d)).select(rd("ll", "ll")), PBM + f" SELECT {r('avg(o)', 'll')} FROM ob")
register("log_likelihood_per_rank", lambda s, d: metrics.log_likelihood_per_rank(_pbm(s, d)).select(lg("position"), rd("ll", "ll")), PBM + f" SELECT position::BIGINT AS position, {r('avg(o)', 'll')} FROM ob GROUP BY 1")
DBN = LOG + chain_cond("dbn") + f""", two AS (SELECT *, ln(a) + coalesce(sum(ln(a * 0.9::DOUBLE * (1 - s) + (1 - a) * 0.9::DOUBLE)) OVER ({BACK}), 0) AS ul FROM cond),
ob AS (SELECT *, -{bce('lp')} AS o, -{bce('ul')} AS uo FROM two), pr AS (SELECT position, pow(2, -avg(o) / ln(2)) AS cp, pow(2, -avg(uo) / ln(2)) AS up FROM ob GROUP BY 1)"""
register("cond_perplexity_per_rank", lambda s, d: metrics.perplexity_per_rank(_dbn(s, d), "cond_log_prob", "cond_ppl").select(lg("position"), rd("cond_ppl", "cond_ppl")), DBN + f" SELECT position::BIGINT AS position, {r('cp', 'cond_ppl')} FROM pr")
register("cond_perplexity", lambda s, d: metrics.perplexity(_dbn(s, d), "cond_log_prob", "cond_ppl").select(rd("cond_ppl", "cond_ppl")), DBN + f" SELECT {r('avg(cp)', 'cond_ppl')} FROM pr")
register("perplexity_per_rank", lambda s, d: metrics.perplexity_per_rank(_dbn(s, d)).select(lg("position"), rd("ppl", "ppl")), DBN + f" SELECT position::BIGINT AS position, {r('up', 'ppl')} FROM pr")
register("perplexity", lambda s, d: metrics.perplexity(_dbn(s, d)).select(rd("ppl", "ppl")), DBN + f" SELECT {r('avg(up)', 'ppl')} FROM pr")
EVAL = ("ll", "ppl", "cond_ppl", "loss")
register(
    "evaluate_clicks",
    lambda s, d: metrics.evaluate_clicks(_pbm(s, d)).select(*(rd(f"test_{c}", f"test_{c}") for c in EVAL)),
    PBM + f", pr AS (SELECT pow(2, -avg(o) / ln(2)) AS p FROM ob GROUP BY position) SELECT {r('(SELECT avg(o) FROM ob)', 'test_ll')}, {r('(SELECT avg(p) FROM pr)', 'test_ppl')}, {r('(SELECT avg(p) FROM pr)', 'test_cond_ppl')}, {r('(SELECT avg(x) FROM (SELECT avg(-o) AS x FROM ob GROUP BY session_id))', 'test_loss')}",
)
register(
    "evaluate_clicks_custom",
    lambda s, d: metrics.evaluate_clicks(_pbm(s, d), more={"brier": F.pow(F.col("click") - F.exp("log_prob"), 2)}).select(rd("test_ll", "test_ll"), rd("test_brier", "test_brier")),
    PBM + f" SELECT {r('avg(o)', 'test_ll')}, {r('avg((click - exp(lp)) * (click - exp(lp)))', 'test_brier')} FROM ob",
)
register(
    "evaluate_clicks_binned",
    lambda s, d: metrics.evaluate_clicks(_pbm(s, d), states={"auc": metrics.auc(F.exp("log_prob"), 997), "calibration": metrics.calibration_error(F.exp("log_prob"), 19)}).select(*(rd(f"test_{c}", f"test_{c}") for c in ("ll", "loss", "auc", "calibration"))),
    PBM + f""", b AS (SELECT click, exp(lp) AS p, floor(exp(lp) * 997) AS fine, floor(exp(lp) * 19) AS rough FROM ob), h AS (SELECT fine, sum(click) AS hit, count(*) - sum(click) AS miss FROM b GROUP BY 1),
c AS (SELECT *, coalesce(sum(miss) OVER (ORDER BY fine ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h), e AS (SELECT rough, abs(sum(p) - sum(click)) AS gap FROM b GROUP BY 1)
SELECT {r('(SELECT avg(o) FROM ob)', 'test_ll')}, {r('(SELECT avg(x) FROM (SELECT avg(-o) AS x FROM ob GROUP BY session_id))', 'test_loss')}, {r('(SELECT sum(hit * (below + miss / 2.0)) / (sum(hit) * sum(miss)) FROM c)', 'test_auc')}, {r('(SELECT sum(gap) FROM e) / (SELECT count(*) FROM b)', 'test_calibration')}""",
)


def _merged_states(s: SparkSession, d: str) -> DataFrame:
    """A metric of three parts of the log that were looked at apart, from their states."""
    rows, metric = _pbm(s, d), metrics.auc(F.exp("log_prob"), 997)
    parts = [metrics.state(rows.where(F.col("session_id") % 3 == k), metric) for k in range(3)]
    return metrics.finished(metrics.merged(parts), metric, "auc").select(rd("auc", "auc"))


register("merged_metric_states", _merged_states, ORACLES["evaluate_clicks_binned"].split("\nSELECT")[0] + f" SELECT {r('sum(hit * (below + miss / 2.0)) / (sum(hit) * sum(miss))', 'auc')} FROM c")
CUTS = (1, 3, 5, 10)
GAINS = {n: f"sum(CASE WHEN rank <= {n} THEN (pow(2, label) - 1) / log2(rank + 1) ELSE 0 END)" for n in CUTS}
BEST = {n: GAINS[n].replace("rank", "ideal_rank") for n in CUTS}
MRR = {n: f"coalesce(max(CASE WHEN label >= 1 AND rank <= {n} THEN 1::DOUBLE / rank END), 0)" for n in CUTS}
RANK_SQL = {
    "dcg": GAINS, "mrr": MRR, "ndcg": {n: f"CASE WHEN {BEST[n]} > 0 THEN {GAINS[n]} / {BEST[n]} ELSE 0 END" for n in CUTS},
    "precision": {n: f"sum(CASE WHEN label >= 1 AND rank <= {n} THEN 1::DOUBLE ELSE 0 END) / {n}" for n in CUTS},
}
for _m, _sql in RANK_SQL.items():
    register(
        f"{_m}_at_n",
        lambda s, d, m=_m: metrics.ranking(_scored_annotations(s, d), m, CUTS).select(*(rd(f"{m}_{n}", f"{m}_{n}") for n in CUTS)),
        ANN_SCORED + f", q AS (SELECT query_id, {', '.join(f'{_sql[n]} AS v{n}' for n in CUTS)} FROM rk GROUP BY 1) SELECT {', '.join(r(f'avg(v{n})', f'{_m}_{n}') for n in CUTS)} FROM q",
    )
register(
    "evaluate_ranking",
    lambda s, d: metrics.evaluate_ranking(_scored_annotations(s, d)).select(*(rd(f"test_dcg_{n}", f"test_dcg_{n}") for n in CUTS), rd("test_mrr_10", "test_mrr_10")),
    ANN_SCORED + f", q AS (SELECT query_id, {', '.join(f'{GAINS[n]} AS v{n}' for n in CUTS)}, {MRR[10]} AS m FROM rk GROUP BY 1) SELECT {', '.join(r(f'avg(v{n})', f'test_dcg_{n}') for n in CUTS)}, {r('avg(m)', 'test_mrr_10')} FROM q",
)

# ---- estimation -----------------------------------------------------------------------------------------------
WRATE = "sum(w * click) / sum(w)"
for _m, _keys in (("gctr", []), ("rctr", ["position"]), ("dctr", ["query_doc_id"]), ("drctr", ["query_doc_id", "position"])):
    register(
        f"fit_{_m}",
        lambda s, d, k=_keys: fit.rates(Log(s, d).train, k).select(*(lg(c) for c in k), rd("rate", "rate"), lg("views")),
        LOG + f" SELECT {''.join(f'{c}::BIGINT AS {c}, ' for c in _keys)}{r(WRATE, 'rate')}, count(*)::BIGINT AS views FROM tr" + (f" GROUP BY {', '.join(_keys)}" if _keys else ""),
    )
register("fit_dctr_hashed", lambda s, d: fit.rates(Log(s, d).train.withColumn("bucket", keys.hash_trick(F.col("query_doc_id"), n_docs(s, d), 100)[0]), ["bucket"]).select(lg("bucket"), rd("rate", "rate"), lg("views")), LOG + f" SELECT {_h('query_doc_id', f'(({N} + 99) // 100)')} AS bucket, {r(WRATE, 'rate')}, count(*)::BIGINT AS views FROM tr GROUP BY 1")
CELL = f"{r('sum(w * click)', 'clicks')}, {r('sum(w)', 'views')}"
register("pbm_cells", lambda s, d: fit.cells(Log(s, d).train, ["query_doc_id", "position"]).select(lg("query_doc_id"), lg("position"), rd("clicks", "clicks"), rd("views", "views")), LOG + f" SELECT query_doc_id::BIGINT AS query_doc_id, position::BIGINT AS position, {CELL} FROM tr GROUP BY query_doc_id, position")
register("ubm_cells", lambda s, d: fit.cells(fit.with_last_position(Log(s, d).train), ["query_doc_id", "position", "last_pos"]).select(lg("query_doc_id"), lg("position"), lg("last_pos"), rd("clicks", "clicks"), rd("views", "views")), LOG + f" SELECT query_doc_id::BIGINT AS query_doc_id, position::BIGINT AS position, last_pos::BIGINT AS last_pos, {CELL} FROM trl GROUP BY query_doc_id, position, last_pos")


def _em(exam_keys: list[str], ratio: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = Log(s, d).train
        if ratio:
            rows = rows.withColumn("query_doc_id", keys.hash_trick(F.col("query_doc_id"), n_docs(s, d), ratio)[0])
        table = fit.cells(fit.with_last_position(rows) if len(exam_keys) > 1 else rows, ["query_doc_id", *exam_keys])
        a = table.select("query_doc_id").distinct().withColumn("alpha", F.lit(0.4))
        t = table.select(*exam_keys).distinct().withColumn("theta", 1.0 / F.col("position"))
        new_a, new_t = fit.em_step(table, a, t, exam_keys)
        out = new_a.select(F.lit("attraction").alias("kind"), lg("query_doc_id", "k1"), F.lit(0).cast("long").alias("k2"), rd("alpha", "p"))
        k2 = lg("last_pos", "k2") if len(exam_keys) > 1 else F.lit(0).cast("long").alias("k2")
        return out.union(new_t.select(F.lit("examination").alias("kind"), lg("position", "k1"), k2, rd("theta", "p")))

    return run


def _em_sql(second: str, doc: str = "query_doc_id") -> str:
    two = second != "0"
    return LOG + f""", cl AS (SELECT {doc} AS query_doc_id, position, {second} AS k2, sum(w * click) AS c, sum(w) AS v, 0.4::DOUBLE AS x, 1::DOUBLE / position AS y FROM trl GROUP BY 1, 2, 3),
e AS (SELECT *, c + (v - c) * x * (1 - y) / (1 - x * y) AS ga, c + (v - c) * y * (1 - x) / (1 - x * y) AS gt FROM cl)
SELECT 'attraction' AS kind, query_doc_id::BIGINT AS k1, 0::BIGINT AS k2, {r('least(greatest(sum(ga) / sum(v), 1e-6), 1 - 1e-6)', 'p')} FROM e GROUP BY query_doc_id
UNION ALL SELECT 'examination', position::BIGINT, {'k2::BIGINT' if two else '0::BIGINT'}, {r('least(greatest(sum(gt) / sum(v), 1e-6), 1 - 1e-6)', 'p')} FROM e GROUP BY position{', k2' if two else ''}"""


register("pbm_em_step", _em(["position"]), _em_sql("0"))
register("ubm_em_step", _em(["position", "last_pos"]), _em_sql("last_pos"))
BUCKET = _h("query_doc_id", f"(({N} + 9) // 10)")
register("pbm_em_step_hashed", _em(["position"], 10), _em_sql("0", BUCKET))


def _signed_gradient(s: SparkSession, d: str) -> DataFrame:
    """The document rates' gradient by the logits of signed buckets, which start from the buckets' smoothed rates."""
    log, size = Log(s, d), n_docs(s, d)
    bucket, _ = keys.hash_trick(F.col("query_doc_id"), size)
    start = fit.rates(log.train.withColumn("bucket", bucket), ["bucket"], "impression", 1.0, 2.0).select("bucket", exprs.logit(F.col("rate")).alias("logit"))
    model = models.RateModel(hashed("attraction", F.col("query_doc_id"), size, start))
    return fit.rate_gradients(log.train, model).select(lg("bucket"), rd("g", "g"))


register(
    "dctr_grad_step_signed",
    _signed_gradient,
    LOG + f""", b AS (SELECT *, {BUCKET} AS bucket, 2 * {_h2('query_doc_id', '0', 2)} - 1 AS sign FROM tr), p0 AS (SELECT bucket, {RATE} AS p FROM b GROUP BY 1)
SELECT bucket::BIGINT AS bucket, {r('sum(w * sign * (1 / (1 + exp(-sign * ln(p / (1 - p)))) - click))', 'g')} FROM b JOIN p0 USING (bucket) GROUP BY 1""",
)


def _fit_product(exam_keys: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = Log(s, d).train
        table = fit.cells(fit.with_last_position(rows) if len(exam_keys) > 1 else rows, ["query_doc_id", *exam_keys])
        a, _, _ = fit.fit_product(table, exam_keys, 3)
        return a.select(lg("query_doc_id"), rd("alpha", "alpha"))

    return run


register("fit_pbm", _fit_product(["position"]), fit_sql.product(False))
register("fit_ubm", _fit_product(["position", "last_pos"]), fit_sql.product(True))
register("fit_cm_textbook", lambda s, d: fit.textbook_cascade(Log(s, d).train).select(lg("query_doc_id"), rd("rate", "rate")), LOG + f", x AS (SELECT *, coalesce(sum(click) OVER ({BACK}), 0) AS k FROM tr) SELECT query_doc_id::BIGINT AS query_doc_id, {r(WRATE, 'rate')} FROM x WHERE k = 0 GROUP BY 1")


def _chain_grad_sql(model: str) -> str:
    """CTEs ending in ``gr``: rows of the train part with gradients by the attraction probability and the click continuation."""
    return LOG_TRAIN + chain_cond(model) + fit_sql.gradients(model)


GA = "sum(w * da * a * (1 - a))"
register("dbn_grad_step", lambda s, d: fit.dbn_gradients((x := Log(s, d)).train, x.model("dbn")).select(lg("query_doc_id"), rd("g_attraction", "g_attraction"), rd("g_satisfaction", "g_satisfaction")), _chain_grad_sql("dbn") + f" SELECT query_doc_id::BIGINT AS query_doc_id, {r(GA, 'g_attraction')}, {r('sum(-w * dc * 0.9::DOUBLE * s * (1 - s))', 'g_satisfaction')} FROM gr GROUP BY 1")
register("ccm_grad_step", lambda s, d: fit.ccm_gradients((x := Log(s, d)).train, x.model("ccm")).select(lg("query_doc_id"), rd("g_attraction", "g_attraction")), _chain_grad_sql("ccm") + f" SELECT query_doc_id::BIGINT AS query_doc_id, {r('sum(w * (da + dc * (0.3::DOUBLE - 0.6::DOUBLE)) * a * (1 - a))', 'g_attraction')} FROM gr GROUP BY 1")


def _dcm_grad(s: SparkSession, d: str) -> DataFrame:
    log = Log(s, d)
    by_doc, by_pos = fit.dcm_gradients(log.train, log.model("dcm"))
    return by_doc.select(F.lit("attraction").alias("kind"), lg("query_doc_id", "k"), rd("g_attraction", "g")).union(by_pos.select(F.lit("continuation").alias("kind"), lg("position", "k"), rd("g_continuation", "g")))


register("dcm_grad_step", _dcm_grad, _chain_grad_sql("dcm") + f" SELECT 'attraction' AS kind, query_doc_id::BIGINT AS k, {r(GA, 'g')} FROM gr GROUP BY query_doc_id UNION ALL SELECT 'continuation', position::BIGINT, {r('sum(w * dc * c * (1 - c))', 'g')} FROM gr GROUP BY position")
register(
    "cm_grad_step",
    lambda s, d: fit.cascade_gradients((x := Log(s, d)).train, x.model("cm")).select(lg("query_doc_id"), rd("g_attraction", "g_attraction")),
    LOG_TRAIN + f""", x AS (SELECT *, coalesce(sum(click) OVER ({BACK}), 0) AS k, exp({CM_UN}) AS p FROM ev),
b AS (SELECT *, CASE WHEN k > 0 THEN 0 WHEN click = 1 THEN -1 ELSE p / (1 - p) END AS bb FROM x),
z AS (SELECT *, coalesce(sum(bb) OVER (PARTITION BY session_id ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM b)
SELECT query_doc_id::BIGINT AS query_doc_id, {r('sum(w * (bb * (1 - a) - later * a))', 'g_attraction')} FROM z GROUP BY 1""",
)


def _fit_chain(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        log = Log(s, d)
        model, _ = fit.fit_chain(kind, log.train, epochs=2, bucketed=True)
        p = model.attraction
        return p.table.select(lg("query_doc_id"), rd(exprs.sigmoid(F.col("logit")), "alpha"))

    return run


for _m in ("dbn", "sdbn", "dcm", "ccm"):
    register(f"fit_{_m}", _fit_chain(_m), fit_sql.chain(_m))


def _training_log(s: SparkSession, d: str) -> DataFrame:
    log = Log(s, d)
    _, epochs = fit.fit_chain("ccm", log.train, log.validation, epochs=3, bucketed=True)
    return s.createDataFrame([(e["epoch"], float(e["val_loss"]), e["best"]) for e in epochs], "epoch long, val_loss double, best boolean").select("epoch", rd("val_loss", "val_loss"), "best")  # a row for each epoch


register("training_log", _training_log, fit_sql.training_log())
register("mixture_em_step", lambda s, d: fit.mixture_step((x := Log(s, d)).model("mixture"), x.train).select("model", rd("prior", "prior")), LOG_TRAIN + MIX + f" SELECT 'dctr' AS model, {r('avg(exp(p1))', 'prior')} FROM post UNION ALL SELECT 'pbm', {r('avg(exp(p2))', 'prior')} FROM post UNION ALL SELECT 'dbn', {r('avg(exp(p3))', 'prior')} FROM post")


def _fit_mixture(s: SparkSession, d: str) -> DataFrame:
    log = Log(s, d)
    model, _ = fit.fit_mixture(log.model("mixture"), log.train, 2)
    return s.createDataFrame(sorted(model.prior.items()), "model string, prior double").select("model", rd("prior", "prior"))  # a row for each model


register("fit_mixture", _fit_mixture, fit_sql.mixture(MIX))


def _fit_mixture_refit(s: SparkSession, d: str) -> DataFrame:
    """A mixture of document and rank rates whose models are fitted anew in each iteration."""
    log = Log(s, d)
    start = models.Mixture({m: log.model(m) for m in ("dctr", "rctr")}, {"dctr": 0.5, "rctr": 0.5})
    model, _ = fit.fit_mixture(start, log.train, 2, {"dctr": fit.refit_rates, "rctr": fit.refit_rates})
    out = s.createDataFrame([("prior", k, float(model.prior[m])) for k, m in ((1, "dctr"), (2, "rctr"))], "kind string, k long, p double")  # a row for each model
    for name in ("dctr", "rctr"):
        p = model.models[name].rate
        out = out.union(p.table.select(F.lit(name).alias("kind"), lg(p.keys[0], "k"), exprs.sigmoid(F.col("logit")).alias("p")))
    return out.select("kind", "k", rd("p", "p"))


register("fit_mixture_refit", _fit_mixture_refit, fit_sql.mixture_refit())


def _feature_clicks(s: SparkSession, d: str) -> DataFrame:
    rows = data.annotations(s, d)
    return rows.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("query_id"))).select("vec_id", F.col("embedding").alias("features"), "click", "w")


def _fit_linear(s: SparkSession, d: str) -> DataFrame:
    model = features.fit_linear(_feature_clicks(s, d))
    values = [*model.coefficients.toArray().tolist(), model.intercept]
    return s.createDataFrame(list(enumerate(values)), "feature long, weight double")  # a row for each feature


def _fit_network(network: object) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        _, losses = features.fit_deep(_feature_clicks(s, d), network, epochs=3)
        return s.createDataFrame([(i + 1, x) for i, x in enumerate(losses)], "epoch long, loss double")  # a row for each epoch

    return run


register("fit_linear_ctr", _fit_linear)
register("fit_deep_ctr", _fit_network(features.Deep.seeded(64)))
register("fit_deepcross_ctr", _fit_network(features.DeepCross(64)))

# ---- synthetic clicks -----------------------------------------------------------------------------------------


def _simulate(model: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        log = Log(s, d)
        out = log.model(model).sample(log.rows, 1)
        return out.select(*ids(), *(lg(F.col(c).cast("int"), c) for c in out.columns if c.startswith("sim_")))

    return run


ONE = "{0}::BIGINT AS {0}"
register("simulate_ctr", _simulate("dctr"), LOG_ALL + f" SELECT {IDS}, ({u(1)} < a)::BIGINT AS sim_click FROM ev")
register("simulate_pbm", _simulate("pbm"), LOG_ALL + f" SELECT {IDS}, ({u(1)} < t)::BIGINT AS sim_exam, ({u(2)} < a)::BIGINT AS sim_attr, ({u(1)} < t AND {u(2)} < a)::BIGINT AS sim_click FROM ev")
register("simulate_cm", _simulate("cm"), LOG_ALL + f", x AS (SELECT *, ({u(1)} < a)::BIGINT AS sim_attr FROM ev), y AS (SELECT *, (coalesce(sum(sim_attr) OVER ({BACK}), 0) = 0)::BIGINT AS sim_exam FROM x) SELECT {IDS}, sim_exam, sim_attr, sim_exam * sim_attr AS sim_click FROM y")
STAYS = {
    "dcm": ("FALSE", f"NOT att OR {u(3)} < c"),
    "ccm": (f"{u(2)} < a", f"{u(3)} < CASE WHEN NOT att THEN 0.8::DOUBLE WHEN sat THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END"),
    "dbn": (f"{u(2)} < s", f"(NOT att OR NOT sat) AND {u(3)} < 0.9::DOUBLE"),
    "sdbn": (f"{u(2)} < s", "NOT att OR NOT sat"),
}
for _m, (_sat, _stay) in STAYS.items():
    register(
        f"simulate_{_m}",
        _simulate(_m),
        LOG_ALL + f""", x AS (SELECT *, {u(1)} < a AS att, {_sat} AS sat FROM ev), y AS (SELECT *, CASE WHEN {_stay} THEN 1 ELSE 0 END AS go FROM x),
z AS (SELECT *, coalesce(min(go) OVER ({BACK}), 1) AS ex, max(position) OVER (PARTITION BY session_id) AS last FROM y)
SELECT {IDS}, ex::BIGINT AS sim_exam, att::BIGINT AS sim_attr, (ex = 1 AND att AND sat AND position < last)::BIGINT AS sim_sat, (ex = 1 AND att)::BIGINT AS sim_click FROM z""",
    )


def _simulate_ubm_sql() -> str:
    out = ", l0 AS (SELECT DISTINCT session_id, 0::BIGINT AS last FROM ev)"
    for k in range(1, 11):
        out += f""", e{k} AS (SELECT ev.session_id, ev.position, l.last, {u(2, 'ev.position').replace('session_id', 'ev.session_id')} < coalesce(pu.theta, rho) AS ex, {u(1, 'ev.position').replace('session_id', 'ev.session_id')} < a AS att FROM ev JOIN l{k - 1} l ON ev.session_id = l.session_id AND ev.position = {k} LEFT JOIN pu ON pu.position = {k} AND pu.last_pos = l.last),
l{k} AS (SELECT session_id, CASE WHEN ex AND att THEN {k} ELSE last END AS last FROM e{k})"""
    return LOG_ALL + out + ", e AS (" + " UNION ALL ".join(f"SELECT * FROM e{k}" for k in range(1, 11)) + f") SELECT {IDS}, ex::BIGINT AS sim_exam, att::BIGINT AS sim_attr, (ex AND att)::BIGINT AS sim_click FROM e"


register("simulate_ubm", _simulate("ubm"), _simulate_ubm_sql())
register(
    "simulate_mixture",
    _simulate("mixture"),
    LOG_ALL + f""", x AS (SELECT *, {u(1)} < a AS m1, {u(1)} < t AND {u(2)} < a AS m2, {u(1)} < a AS att, {u(2)} < s AS sat, {u(98, '0')} AS um FROM ev),
y AS (SELECT *, CASE WHEN (NOT att OR NOT sat) AND {u(3)} < 0.9::DOUBLE THEN 1 ELSE 0 END AS go FROM x), z AS (SELECT *, coalesce(min(go) OVER ({BACK}), 1) = 1 AND att AS m3, CASE WHEN um < 1::DOUBLE / 3 THEN 0 WHEN um < 1::DOUBLE / 3 + 1::DOUBLE / 3 THEN 1 ELSE 2 END AS k FROM y)
SELECT {IDS}, k::BIGINT AS sim_model, (CASE k WHEN 0 THEN m1 WHEN 1 THEN m2 ELSE m3 END)::BIGINT AS sim_click FROM z""",
)

# ---- reports over result tables -------------------------------------------------------------------------------
RUNS = ("gctr", "rctr", "dctr", "pbm")


def _results(s: SparkSession, d: str) -> DataFrame:
    """A result table: the loss of four models on five slices of the test sessions (the seeds)."""
    log = Log(s, d)
    parts = []
    for m in RUNS:
        scored = log.model(m).score(log.test, ("cond_log_prob",)).withColumn("seed", F.col("session_id") % 5)
        parts.append(scored.groupBy("seed", "session_id").agg(F.avg(loss()).alias("x")).groupBy("seed").agg(F.avg("x").alias("loss")).withColumn("model", F.lit(m)))
    return reports.union_results(*parts)


RES = LOG + ", res AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, seed, avg(x) AS loss FROM (SELECT session_id % 5 AS seed, session_id, avg({bce(p)}) AS x FROM ev GROUP BY 1, 2) GROUP BY 1, 2" for m, p in zip(RUNS, ("ln(rho)", "ln(t)", "ln(a)", "ln(t) + ln(a)"), strict=True)) + ")"
register("union_results", lambda s, d: _results(s, d).select("model", lg("seed"), rd("loss", "loss")), RES + f" SELECT model, seed::BIGINT AS seed, {r('loss', 'loss')} FROM res")
register("model_leaderboard", lambda s, d: reports.leaderboard(_results(s, d), "loss").select("model", rd("loss", "loss")), RES + f" SELECT model, {r('avg(loss)', 'loss')} FROM res GROUP BY 1")
register("report_model_means", lambda s, d: reports.model_means(_results(s, d), "loss").select("model", rd("mean", "mean"), rd("sd", "sd"), lg("runs"), rd("ci", "ci")), RES + f" SELECT model, {r('avg(loss)', 'mean')}, {r('stddev(loss)', 'sd')}, count(*)::BIGINT AS runs, {r('1.96::DOUBLE * stddev(loss) / sqrt(count(*))', 'ci')} FROM res GROUP BY 1")


#: Settings of the compressed-key reports: the model's name stands for a multiple of the id universe, hashed down by a ratio.
RATIOS = [(name, times, ratio) for ratio in (1, 10, 100) for name, times in (("a", 1), ("b", 2), ("c", 4))]


def _ratios(s: SparkSession, d: str) -> DataFrame:
    """Losses of the document-rate model with compressed keys, by hash size, ratio and seed.

    One pass over documents: their clicks and views in the train part become bucket rates for all settings at once, and
    the test part is counted by seed, document and click before it meets them.
    """
    log, size = Log(s, d), n_docs(s, d)
    setting = F.explode(F.array(*(F.struct(F.lit(n).alias("model"), F.lit(r).alias("ratio"), keys.hash_trick(F.col("query_doc_id"), t * size, r)[0].alias("bucket")) for n, t, r in RATIOS))).alias("k")
    known = log.train.groupBy("query_doc_id").agg(F.sum("click").alias("c"), F.count("*").alias("v"))
    rates = known.select("c", "v", setting).groupBy("k").agg(((F.sum("c") + 1) / (F.sum("v") + 2)).alias("p"))
    seen = log.test.groupBy((F.col("session_id") % 3).alias("seed"), "query_doc_id", "click").agg(F.count("*").alias("n"))
    both = seen.select("seed", "click", "n", setting).join(rates, "k", "left").withColumn("p", F.coalesce("p", F.lit(log.rho)))
    whole = both.groupBy("seed", "k.model", "k.ratio").agg((F.sum(F.col("n") * exprs.bce_prob(F.col("click"), F.col("p"))) / F.sum("n")).alias("loss"))
    return whole.select("model", "ratio", "seed", "loss")


def _ratio_bucket(x: str, times: int, ratio: int) -> str:
    return _h(x, f"(({times} * {N} + {ratio - 1}) // {ratio})")


RATIO_SQL = LOG + ", rat AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS model, {ratio} AS ratio, session_id % 3 AS seed, avg(-(CASE WHEN click = 1 THEN ln(p) ELSE ln(1 - p) END)) AS loss FROM (SELECT te.*, coalesce(k.p, rho) AS p FROM te CROSS JOIN g LEFT JOIN (SELECT {_ratio_bucket('query_doc_id', times, ratio)} AS bucket, {RATE} AS p FROM tr GROUP BY 1) k ON {_ratio_bucket('te.query_doc_id', times, ratio)} = k.bucket) GROUP BY 3"
    for name, times, ratio in RATIOS
) + ")"
register("report_ratio_pivot", lambda s, d: reports.pivot_ratio(_ratios(s, d), "loss", [1, 10, 100]).select("model", *(rd(str(k), f"ratio_{k}") for k in (1, 10, 100))), RATIO_SQL + f" SELECT model, {', '.join(r(f'avg(CASE WHEN ratio = {k} THEN loss END)', f'ratio_{k}') for k in (1, 10, 100))} FROM rat GROUP BY 1")
register(
    "report_rank_correlation",
    lambda s, d: reports.rank_correlation(_ratios(s, d), "loss", 1, ["seed"]).select(lg("seed"), lg("ratio"), rd("tau", "tau")),
    RATIO_SQL + f""", y AS (SELECT r.seed, r.ratio, r.model, round(r.loss, 9) AS y, round(b.loss, 9) AS x FROM rat r JOIN rat b ON b.ratio = 1 AND r.ratio <> 1 AND b.seed = r.seed AND b.model = r.model),
pr AS (SELECT p.seed, p.ratio, sign(p.x - q.x) AS dx, sign(p.y - q.y) AS dy FROM y p JOIN y q ON p.seed = q.seed AND p.ratio = q.ratio AND p.model < q.model)
SELECT seed::BIGINT AS seed, ratio::BIGINT AS ratio, {r('CASE WHEN sum(abs(dx)) * sum(abs(dy)) > 0 THEN sum(dx * dy) / sqrt(sum(abs(dx)) * sum(abs(dy))) END', 'tau')} FROM pr GROUP BY seed, ratio""",
)


def _methods(s: SparkSession, d: str) -> DataFrame:
    """The position-based model with smoothed rates against the one after an EM step, as a leaderboard of two methods."""
    log = Log(s, d)
    table = fit.cells(log.train, ["query_doc_id", "position"])
    a = table.select("query_doc_id").distinct().withColumn("alpha", F.lit(0.4))
    t = table.select("position").distinct().withColumn("theta", 1.0 / F.col("position"))
    new_a, new_t = fit.em_step(table, a, t, ["position"])
    em = log.test.join(new_a, "query_doc_id", "left").join(F.broadcast(new_t), "position", "left").withColumn("p", F.coalesce("alpha", F.lit(log.rho)) * F.coalesce("theta", F.lit(log.rho)))
    em = em.agg(F.avg(exprs.bce_prob(F.col("click"), F.col("p"))).alias("loss")).withColumn("model", F.lit("em"))
    smooth = log.model("pbm").score(log.test, ("cond_log_prob",)).agg(F.avg(loss()).alias("loss")).withColumn("model", F.lit("rates"))
    return reports.leaderboard(reports.union_results(em, smooth), "loss").select("model", rd("loss", "loss"))


register(
    "report_method_comparison",
    _methods,
    LOG + f""", cl AS (SELECT query_doc_id, position, sum(w * click) AS c, sum(w) AS v, 0.4::DOUBLE AS x, 1::DOUBLE / position AS y FROM tr GROUP BY 1, 2),
e AS (SELECT *, c + (v - c) * x * (1 - y) / (1 - x * y) AS ga, c + (v - c) * y * (1 - x) / (1 - x * y) AS gt FROM cl),
na AS (SELECT query_doc_id, least(greatest(sum(ga) / sum(v), 1e-6), 1 - 1e-6) AS al FROM e GROUP BY 1), nt AS (SELECT position, least(greatest(sum(gt) / sum(v), 1e-6), 1 - 1e-6) AS th FROM e GROUP BY 1),
pe AS (SELECT click, coalesce(al, rho) * coalesce(th, rho) AS p FROM te CROSS JOIN g LEFT JOIN na USING (query_doc_id) LEFT JOIN nt ON te.position = nt.position)
SELECT 'em' AS model, {r('avg(-(CASE WHEN click = 1 THEN ln(p) ELSE ln(1 - p) END))', 'loss')} FROM pe UNION ALL SELECT 'rates', {r(f"avg({bce('ln(t) + ln(a)')})", 'loss')} FROM ev""",
)
