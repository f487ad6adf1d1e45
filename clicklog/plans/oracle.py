"""SQL building blocks of the oracle queries: the same log, parameters and recursions as plain SQL for DuckDB."""

from __future__ import annotations

P = 2**31 - 1
BACK = "PARTITION BY session_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
RUN = "PARTITION BY session_id, run ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
RATE = "(sum(click) + 1)::DOUBLE / (count(*) + 2)"

LOG = f"""WITH imp0 AS (
  SELECT l_orderkey AS session_id, o_custkey AS query_id, l_partkey AS query_doc_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS position,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS click
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
imp AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, 1::DOUBLE / count(*) OVER (PARTITION BY session_id) AS w FROM imp0 WHERE position <= 10),
ses AS (SELECT session_id, query_id, list(query_doc_id ORDER BY position) AS docs, list(position ORDER BY position) AS positions, list(click ORDER BY position) AS clicks FROM imp0 GROUP BY 1, 2),
rng AS (SELECT max(o_orderkey) AS r FROM orders),
tr AS (SELECT imp.* FROM imp, rng WHERE session_id < 0.5 * r),
te AS (SELECT imp.* FROM imp, rng WHERE session_id >= 0.75 * r),
seen AS (SELECT * FROM tr WHERE query_doc_id % 7 <> 0),
trl AS (SELECT *, coalesce(max(CASE WHEN click = 1 THEN position END) OVER ({BACK}), 0) AS last_pos,
  CASE WHEN click = 1 AND position = max(CASE WHEN click = 1 THEN position END) OVER (PARTITION BY session_id) THEN 1 ELSE 0 END AS is_last FROM tr),
pa AS (SELECT query_doc_id, {RATE} AS alpha FROM seen GROUP BY 1),
pt AS (SELECT position, {RATE} AS theta FROM tr GROUP BY 1),
pd AS (SELECT query_doc_id, position, {RATE} AS delta FROM seen GROUP BY 1, 2),
pu AS (SELECT position, last_pos, {RATE} AS theta FROM trl GROUP BY 1, 2),
ps AS (SELECT query_doc_id, (sum(is_last) + 1)::DOUBLE / (sum(click) + 2) AS sigma FROM trl WHERE query_doc_id % 7 <> 0 GROUP BY 1),
pc AS (SELECT position, 1 - (sum(is_last) + 1)::DOUBLE / (sum(click) + 2) AS lam FROM trl GROUP BY 1),
g AS (SELECT avg(click) AS rho FROM tr),
ev AS (SELECT te.*, rho, coalesce(pa.alpha, rho) AS a, coalesce(pt.theta, rho) AS t, coalesce(pd.delta, rho) AS d, coalesce(ps.sigma, rho) AS s, coalesce(pc.lam, rho) AS c,
    coalesce(max(CASE WHEN click = 1 THEN te.position END) OVER (PARTITION BY session_id ORDER BY te.position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last_pos
  FROM te CROSS JOIN g LEFT JOIN pa USING (query_doc_id) LEFT JOIN pt ON te.position = pt.position LEFT JOIN pd ON te.query_doc_id = pd.query_doc_id AND te.position = pd.position
    LEFT JOIN ps ON te.query_doc_id = ps.query_doc_id LEFT JOIN pc ON te.position = pc.position)"""


_TEST = "te AS (SELECT imp.* FROM imp, rng WHERE session_id >= 0.75 * r)"
#: The same with all sessions, or those of the train part, in the place of the test part.
LOG_ALL = LOG.replace(_TEST, "te AS (SELECT * FROM imp)")
LOG_TRAIN = LOG.replace(_TEST, "te AS (SELECT * FROM tr)")


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round(({expression})::DOUBLE, {digits}) + 0.0::DOUBLE AS {name}"


IDS = "session_id::BIGINT AS session_id, position::BIGINT AS position"


def bce(lp: str) -> str:
    """Loss of a click log-probability."""
    return f"(-(CASE WHEN click = 1 THEN {lp} ELSE ln(1 - exp(least({lp}, -1e-10))) END))"


#: model -> (attraction, log skip continuation, click continuation)
CHAINS = {
    "dcm": ("0.0::DOUBLE", "c"),
    "ccm": ("ln(0.8::DOUBLE)", "(a * 0.3::DOUBLE + (1 - a) * 0.6::DOUBLE)"),
    "dbn": ("ln(0.9::DOUBLE)", "(0.9::DOUBLE * (1 - s))"),
    "sdbn": ("0.0::DOUBLE", "(1 - s)"),
    "dbn_global": ("ln(0.9::DOUBLE)", "(0.9::DOUBLE * (1 - 0.4::DOUBLE))"),
}


def chain_cond(model: str, source: str = "ev", tag: str = "") -> str:
    """CTEs ending in ``cond{tag}``: the source's rows with ``lp``."""
    skip, click = CHAINS[model]
    return f""", runs{tag} AS (SELECT *, coalesce(sum(click) OVER ({BACK}), 0) AS run, ln(1 - a) + {skip} AS step, lag({click}) OVER (PARTITION BY session_id ORDER BY position) AS came FROM {source}),
en{tag} AS (SELECT *, (CASE WHEN run = 0 THEN 1::DOUBLE ELSE first_value(came) OVER (PARTITION BY session_id, run ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END) * exp(coalesce(sum(step) OVER ({RUN}), 0)) AS nn FROM runs{tag}),
ed{tag} AS (SELECT *, 1 - coalesce(sum(nn * a) OVER ({RUN}), 0) AS dd FROM en{tag}),
cond{tag} AS (SELECT *, ln(least(greatest(nn / greatest(dd, 1e-10), 1e-10), 1)) + ln(a) AS lp FROM ed{tag})"""


def chain_uncond(model: str) -> str:
    skip, click = CHAINS[model]
    return f", uncond AS (SELECT *, ln(a) + coalesce(sum(ln(a * {click} + (1 - a) * exp({skip}))) OVER ({BACK}), 0) AS lp FROM ev)"


def ubm_uncond() -> str:
    """Unrolled over ten ranks: the probability that the last click so far is at each rank."""
    out = ", s0 AS (SELECT DISTINCT session_id, 0 AS pl, 1::DOUBLE AS p FROM ev)"
    for k in range(1, 11):
        out += f""", h{k} AS (SELECT s.session_id, s.pl, s.p, s.p * coalesce(pu.theta, ev.rho) * ev.a AS hit FROM s{k - 1} s JOIN ev ON ev.session_id = s.session_id AND ev.position = {k} LEFT JOIN pu ON pu.position = {k} AND pu.last_pos = s.pl),
p{k} AS (SELECT session_id, {k} AS position, sum(hit) AS p FROM h{k} GROUP BY 1),
s{k} AS (SELECT session_id, pl, p - hit AS p FROM h{k} UNION ALL SELECT session_id, {k} AS pl, p FROM p{k})"""
    return out + ", uncond AS (" + " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(1, 11)) + ")"


def u(salt: int, position: str = "position") -> str:
    z = f"((12345 + (1103515245 * session_id) % {P} + (69069 * {position}) % {P} + {1664525 * salt % P}) % {P})"
    for add in (12345, 1013904223):
        z = f"(({z} * {z} + {add}) % {P})"
    return f"({z}::DOUBLE / {P})"
