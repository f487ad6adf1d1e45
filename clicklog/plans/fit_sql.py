"""SQL of the estimation queries: iterations as chains of common table expressions, and networks as list arithmetic."""

from __future__ import annotations

import numpy as np

from clicklog.operators.features import Deep, DeepCross
from clicklog.plans.oracle import CHAINS, LOG, LOG_TRAIN, bce, chain_cond, r


def _clip(x: str) -> str:
    return f"least(greatest({x}, 1e-6), 1 - 1e-6)"


def _sigmoid(x: str) -> str:
    return f"1 / (1 + exp(-({x})))"


def product(by_history: bool, iterations: int = 3) -> str:
    """EM of the position-based or user-browsing model on cells, from 0.5 everywhere."""
    out = LOG + f""", cl AS MATERIALIZED (SELECT query_doc_id, position, {'last_pos' if by_history else '0'} AS k2, sum(w * click) AS c, sum(w) AS v FROM trl GROUP BY 1, 2, 3),
a0 AS (SELECT DISTINCT query_doc_id, 0.5::DOUBLE AS x FROM cl), t0 AS (SELECT DISTINCT position, k2, 0.5::DOUBLE AS y FROM cl)"""
    for i in range(1, iterations + 1):
        out += f""", e{i} AS MATERIALIZED (SELECT cl.*, c + (v - c) * x * (1 - y) / (1 - x * y) AS ga, c + (v - c) * y * (1 - x) / (1 - x * y) AS gt
  FROM cl JOIN a{i - 1} USING (query_doc_id) JOIN t{i - 1} USING (position, k2)),
a{i} AS (SELECT query_doc_id, {_clip('sum(ga) / sum(v)')} AS x FROM e{i} GROUP BY 1),
t{i} AS (SELECT position, k2, {_clip('sum(gt) / sum(v)')} AS y FROM e{i} GROUP BY 1, 2)"""
    return out + f" SELECT query_doc_id::BIGINT AS query_doc_id, {r('x', 'alpha')} FROM a{iterations}"


def mixture(mix: str, iterations: int = 2) -> str:
    """Prior weights of three models as mean posteriors; ``mix`` ends in ``nll`` (n1, n2, n3 for each session)."""
    out = LOG_TRAIN + mix + ", w0 AS (SELECT 1::DOUBLE / 3 AS w1, 1::DOUBLE / 3 AS w2, 1::DOUBLE / 3 AS w3)"
    for i in range(1, iterations + 1):
        out += f""", b{i} AS (SELECT ln(w1) - n1 AS x1, ln(w2) - n2 AS x2, ln(w3) - n3 AS x3 FROM nll, w{i - 1}),
m{i} AS (SELECT *, greatest(x1, x2, x3) AS m FROM b{i}),
z{i} AS (SELECT *, m + ln(exp(x1 - m) + exp(x2 - m) + exp(x3 - m)) AS z FROM m{i}),
w{i} AS (SELECT {', '.join(f'greatest(avg(exp(x{k} - z)), 1e-12) AS w{k}' for k in (1, 2, 3))} FROM z{i})"""
    return out + " " + " UNION ALL ".join(f"SELECT '{m}' AS model, {r(f'w{k}', 'prior')} FROM w{iterations}" for k, m in ((1, "dctr"), (2, "pbm"), (3, "dbn")))


def mixture_refit(iterations: int = 2) -> str:
    """A mixture of document and rank rates, each fitted anew to sessions as they weigh in its posterior."""
    out = LOG_TRAIN + ", v0 AS (SELECT *, a AS x, t AS y FROM ev), w0 AS (SELECT 0.5::DOUBLE AS w1, 0.5::DOUBLE AS w2)"
    for i in range(1, iterations + 1):
        out += f""", n{i} AS (SELECT session_id, sum({bce('ln(x)')}) AS n1, sum({bce('ln(y)')}) AS n2 FROM v{i - 1} GROUP BY 1),
p{i} AS MATERIALIZED (SELECT session_id, 1 / (1 + exp((ln(w2) - n2) - (ln(w1) - n1))) AS p1, 1 / (1 + exp((ln(w1) - n1) - (ln(w2) - n2))) AS p2 FROM n{i}, w{i - 1}),
w{i} AS (SELECT avg(p1) AS w1, avg(p2) AS w2 FROM p{i}),
a{i} AS (SELECT query_doc_id, (sum(w * p1 * click) + 1) / (sum(w * p1) + 2) AS x FROM tr JOIN p{i} USING (session_id) GROUP BY 1),
t{i} AS (SELECT position, (sum(w * p2 * click) + 1) / (sum(w * p2) + 2) AS y FROM tr JOIN p{i} USING (session_id) GROUP BY 1),
v{i} AS (SELECT tr.*, x, y FROM tr JOIN a{i} USING (query_doc_id) JOIN t{i} USING (position))"""
    n = iterations
    return out + f""" SELECT 'prior' AS kind, 1::BIGINT AS k, {r('w1', 'p')} FROM w{n} UNION ALL SELECT 'prior', 2::BIGINT, {r('w2', 'p')} FROM w{n}
UNION ALL SELECT 'dctr', query_doc_id::BIGINT, {r('x', 'p')} FROM a{n} UNION ALL SELECT 'rctr', position::BIGINT, {r('y', 'p')} FROM t{n}"""


def gradients(model: str, tag: str = "") -> str:
    """CTEs from ``cond{tag}`` to ``gr{tag}``: gradients by the attraction probability (da) and the click continuation (dc)."""
    run = "PARTITION BY session_id, run"
    later = f"coalesce(sum(qq) OVER ({run} ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)"
    return f""", q{tag} AS (SELECT *, least(greatest(nn * a, 0), 1) AS qq, max(click) OVER ({run}) AS ended FROM cond{tag}),
qs{tag} AS (SELECT *, 1 - sum(qq) OVER ({run}) AS de, {later} AS later, row_number() OVER ({run} ORDER BY position) AS i FROM q{tag}),
qd{tag} AS (SELECT *, CASE WHEN ended = 1 THEN CASE WHEN click = 1 THEN -1 / a ELSE 1 / (1 - a) END ELSE (nn - later / (1 - a)) / de END AS da,
  CASE WHEN i = 1 THEN CASE WHEN ended = 1 THEN -1::DOUBLE ELSE (1 - de) / de END END AS ds FROM qs{tag}),
gr{tag} AS (SELECT *, CASE WHEN click = 1 THEN coalesce(lead(ds) OVER (PARTITION BY session_id ORDER BY position), 0) / {CHAINS[model][1]} ELSE 0 END AS dc FROM qd{tag})"""


#: What a document's gradient by its attraction and satisfaction logits sums, and a rank's by its continuation logit.
BY_ATTRACTION = {m: "w * da * a * (1 - a)" for m in ("dbn", "sdbn", "dcm")} | {"ccm": "w * (da + dc * (0.3::DOUBLE - 0.6::DOUBLE)) * a * (1 - a)"}
BY_SATISFACTION = {"dbn": "-w * dc * 0.9::DOUBLE * s * (1 - s)", "sdbn": "-w * dc * s * (1 - s)"}
BY_CONTINUATION = {"dcm": "w * dc * c * (1 - c)"}


def _adam(old: str, g: str, step: int, rate: float, names: tuple[str, str, str]) -> str:
    """Logit, first and second moment after a step, as select items."""
    logit, first, second = (f"{old}.{n}" for n in names)
    m, v = f"(0.9::DOUBLE * {first} + 0.1::DOUBLE * {g})", f"(0.999::DOUBLE * {second} + 0.001::DOUBLE * {g} * {g})"
    move = f"{rate}::DOUBLE * ({m} / {1 - 0.9**step!r}::DOUBLE) / (sqrt({v} / {1 - 0.999**step!r}::DOUBLE) + 1e-8)"
    return f"{logit} - {move} AS {names[0]}, {m} AS {names[1]}, {v} AS {names[2]}"


def _chain_epochs(model: str, epochs: int, rate: float = 0.05) -> str:
    """CTEs ``d{i}`` (la, ls for each document) and ``c{i}`` (lc for each rank) after each epoch of Adam on the train part."""
    zero = "0::DOUBLE AS {0}, 0::DOUBLE AS m{0}, 0::DOUBLE AS v{0}"
    out = LOG + f""", total AS (SELECT sum(w) AS sessions FROM tr),
d0 AS (SELECT query_doc_id, ln(x / (1 - x)) AS la, 0::DOUBLE AS mla, 0::DOUBLE AS vla, {zero.format('ls')} FROM (SELECT query_doc_id, (sum(click) + 1)::DOUBLE / (count(*) + 2) AS x FROM tr GROUP BY 1)),
c0 AS (SELECT DISTINCT position, {zero.format('lc')} FROM tr)"""
    for i in range(1, epochs + 1):
        e, known = f"e{i}", f"k{i}"
        out += f", {known} AS (SELECT tr.*, {_sigmoid('la')} AS a, {_sigmoid('ls')} AS s, {_sigmoid('lc')} AS c FROM tr JOIN d{i - 1} USING (query_doc_id) JOIN c{i - 1} USING (position))"
        out += chain_cond(model, known, e) + gradients(model, e)
        out += f""", gs{i} AS MATERIALIZED (SELECT * FROM gr{e}, total),
gd{i} AS (SELECT query_doc_id, sum({BY_ATTRACTION[model]}) / min(sessions) AS ga, sum({BY_SATISFACTION.get(model, '0::DOUBLE')}) / min(sessions) AS gs FROM gs{i} GROUP BY 1),
gc{i} AS (SELECT position, sum({BY_CONTINUATION.get(model, '0::DOUBLE')}) / min(sessions) AS gc FROM gs{i} GROUP BY 1),
d{i} AS MATERIALIZED (SELECT query_doc_id, {_adam('o', 'ga', i, rate, ('la', 'mla', 'vla'))}, {_adam('o', 'gs', i, rate, ('ls', 'mls', 'vls'))} FROM d{i - 1} o JOIN gd{i} USING (query_doc_id)),
c{i} AS MATERIALIZED (SELECT position, {_adam('o', 'gc', i, rate, ('lc', 'mlc', 'vlc'))} FROM c{i - 1} o JOIN gc{i} USING (position))"""
    return out


def chain(model: str, epochs: int = 2) -> str:
    """Attraction after the epochs (each of which lowers the loss)."""
    return _chain_epochs(model, epochs) + f" SELECT query_doc_id::BIGINT AS query_doc_id, {r(_sigmoid('la'), 'alpha')} FROM d{epochs}"


def training_log(model: str = "ccm", epochs: int = 3) -> str:
    """The validation loss after each epoch, up to the first that does not lower it."""
    out = _chain_epochs(model, epochs) + ", va AS (SELECT imp.* FROM imp, rng WHERE session_id >= 0.5 * r AND session_id < 0.75 * r)"
    for i in range(1, epochs + 1):
        out += f", va{i} AS (SELECT va.*, {_sigmoid('coalesce(la, 0)')} AS a FROM va LEFT JOIN d{i} USING (query_doc_id))" + chain_cond(model, f"va{i}", f"v{i}")
        out += f", l{i} AS (SELECT {i} AS epoch, avg(x) AS val_loss FROM (SELECT avg({bce('lp')}) AS x FROM condv{i} GROUP BY session_id))"
    whole = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(1, epochs + 1))
    return out + f""", every AS ({whole}),
marked AS (SELECT *, coalesce(min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - val_loss > 1e-5, TRUE) AS best FROM every),
kept AS (SELECT *, coalesce(bool_and(best) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS reached FROM marked)
SELECT epoch::BIGINT AS epoch, {r('val_loss', 'val_loss')}, best FROM kept WHERE reached"""


def _numbers(values: np.ndarray) -> str:
    return "[" + ", ".join(f"{v:.17e}" for v in values) + "]"


def _product(h: str, w: np.ndarray) -> str:
    """h W; the seeded networks' biases are 0."""
    return f"list_transform([{', '.join(_numbers(c) for c in w.T)}], lambda c: list_inner_product({h}, c))"


def network(net: Deep | DeepCross, normed: str) -> str:
    """The logit of every vector; ``normed`` is CTEs ending in ``ln_`` (vec_id, z)."""
    elu = "list_transform({}, lambda v: CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END)"
    out, steps = f"WITH {normed}, h0 AS (SELECT vec_id, z AS x0, z AS crossed, z AS h FROM ln_)", 0

    def add(items: str) -> None:
        nonlocal out, steps
        steps += 1
        out += f", h{steps} AS (SELECT vec_id, x0, {items} FROM h{steps - 1})"

    if isinstance(net, Deep):
        for w, _ in net.layers[:-1]:
            add(f"crossed, {elu.format(_product('h', w))} AS h")
        top = net.layers[-1][0][:, 0]
    else:
        for w, _ in net.cross:
            add(f"crossed, {_product('crossed', w)} AS h")
            add("list_transform(range(1, len(x0) + 1), lambda i: x0[i] * h[i] + crossed[i]) AS crossed, x0 AS h")
        if net.stacked:
            add("crossed, crossed AS h")
        for w, _ in net.deep:
            add(f"crossed, {elu.format(_product('h', w))} AS h")
        if not net.stacked:
            add("crossed, list_concat(crossed, h) AS h")
        top = net.top
    return out + f" SELECT vec_id::BIGINT AS vec_id, {r(f'list_inner_product(h, {_numbers(top)})', 'logit')} FROM h{steps}"
