"""Click models as column-appending operators over impressions (session_id, position, query_doc_id, click, ...).

``score`` adds ``cond_log_prob`` (given the session's earlier clicks), ``log_prob`` (before any click is seen) and
``relevance``. Parameters are looked up first; all recursions over ranks are window sums by session, so the log is
dealt by session once. Custom models subclass :class:`ClickModel`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicklog.functions import exprs, keys
from clicklog.operators.params import Param

#: Log-probability of a click after the first one in the cascade model.
NEVER = math.log(1e-8)


def session():
    """Ranks of a session in order."""
    return Window.partitionBy("session_id").orderBy("position")


def before():
    """The ranks of a session before each one."""
    return session().rowsBetween(Window.unboundedPreceding, -1)


def clicks_before() -> Column:
    return F.coalesce(F.sum("click").over(before()), F.lit(0))


def last_click_position() -> Column:
    """The position of the last click before each rank, 0 if there is none."""
    return F.coalesce(F.max(F.when(F.col("click") == 1, F.col("position"))).over(before()), F.lit(0))


def prefix(step: Column) -> Column:
    """The sum of ``step`` over earlier ranks."""
    return F.coalesce(F.sum(step).over(before()), F.lit(0.0))


def examination_after_history(rows: DataFrame, log_skip: Column, log_go: Column, restart: Column, attraction: Column) -> DataFrame:
    """Add ``_exam``: the probability that a rank is examined, given the clicks before it.

    A run is a stretch between clicks. From its start value e, the weight N of "examined, nothing clicked" at a rank
    is e times the product of (skip * go) over the run's earlier ranks, and the examination probability is N over
    1 minus the sum of the earlier N * attraction. ``restart`` is a clicked rank's start value for the next run.
    """
    rows = rows.withColumn("_run", clicks_before()).withColumn("_step", log_skip + log_go).withColumn("_a", attraction)
    rows = rows.withColumn("_from", F.lag(restart, 1).over(session()))
    run = Window.partitionBy("session_id", "_run").orderBy("position")
    earlier = run.rowsBetween(Window.unboundedPreceding, -1)
    start = F.when(F.col("_run") == 0, F.lit(1.0)).otherwise(F.first("_from").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_start", start).withColumn("_passed", F.coalesce(F.sum("_step").over(earlier), F.lit(0.0))).withColumn("_n", F.col("_start") * F.exp("_passed"))
    rows = rows.withColumn("_d", 1 - F.coalesce(F.sum(F.col("_n") * F.col("_a")).over(earlier), F.lit(0.0)))
    exam = F.col("_n") / F.greatest(F.col("_d"), F.lit(exprs.EPS))
    return rows.withColumn("_exam", F.least(F.greatest(exam, F.lit(exprs.EPS)), F.lit(1.0)))


class ClickModel:
    """Subclasses give ``params`` and the three predictions; ``sample`` draws reproducible clicks."""

    params: list[Param]

    def prepare(self, impressions: DataFrame) -> DataFrame:
        for p in self.params:
            impressions = p.lookup(impressions)
        return impressions

    def score(self, impressions: DataFrame, only: tuple[str, ...] = ("cond_log_prob", "log_prob", "relevance")) -> DataFrame:
        own = impressions.columns
        rows = self.prepare(impressions)
        if "cond_log_prob" in only:
            rows = self.conditional(rows)
        if "log_prob" in only:
            rows = self.unconditional(rows)
        if "relevance" in only:
            rows = rows.withColumn("relevance", self.relevance())
        return rows.select(*own, *only)

    def conditional(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def unconditional(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def relevance(self) -> Column:
        raise NotImplementedError

    def sample(self, impressions: DataFrame, salt: int = 0) -> DataFrame:
        raise NotImplementedError


def draw(salt: int) -> Column:
    return keys.uniform(F.col("session_id"), F.col("position"), F.lit(salt))


@dataclass
class RateModel(ClickModel):
    """Click-through rates: one global, or one for each rank, document, or both, by the parameter's keys."""

    rate: Param

    @property
    def params(self) -> list[Param]:
        return [self.rate]

    def conditional(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("cond_log_prob", self.rate.log_prob())

    def unconditional(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("log_prob", self.rate.log_prob())

    def relevance(self) -> Column:
        return self.rate.log_prob()

    def sample(self, impressions: DataFrame, salt: int = 0) -> DataFrame:
        return self.prepare(impressions).withColumn("sim_click", (draw(salt) < self.rate.prob()).cast("int")).select(*impressions.columns, "sim_click")


@dataclass
class PositionBased(ClickModel):
    attraction: Param
    examination: Param

    @property
    def params(self) -> list[Param]:
        return [self.attraction, self.examination]

    def conditional(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("cond_log_prob", self.examination.log_prob() + self.attraction.log_prob())

    def unconditional(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("log_prob", self.examination.log_prob() + self.attraction.log_prob())

    def relevance(self) -> Column:
        return self.attraction.log_prob()

    def sample(self, impressions: DataFrame, salt: int = 0) -> DataFrame:
        rows = self.prepare(impressions)
        rows = rows.withColumn("sim_exam", draw(salt) < self.examination.prob()).withColumn("sim_attr", draw(salt + 1) < self.attraction.prob())
        return rows.withColumn("sim_click", (F.col("sim_exam") & F.col("sim_attr")).cast("int")).select(*impressions.columns, "sim_exam", "sim_attr", "sim_click")


@dataclass
class UserBrowsing(ClickModel):
    """``examination`` is keyed by (position, last_pos); ``grid`` is its table as a map for the unconditional form."""

    attraction: Param
    examination: Param

    @property
    def params(self) -> list[Param]:
        return [self.attraction]

    def conditional(self, rows: DataFrame) -> DataFrame:
        rows = self.examination.lookup(rows.withColumn("last_pos", last_click_position().cast("int")))
        return rows.withColumn("cond_log_prob", self.examination.log_prob() + self.attraction.log_prob()).drop("last_pos")

    def _by_rank(self, rows: DataFrame) -> DataFrame:
        """Add ``_theta``: for each rank the examination probabilities by last clicked position (a small map)."""
        table = self.examination.table.groupBy("position").agg(F.map_from_entries(F.collect_list(F.struct("last_pos", exprs.sigmoid(F.col(self.examination.column)).alias("theta")))).alias("_theta"))
        return rows.join(F.broadcast(table), "position", "left")  # a row for each rank

    def _theta(self, item: Column, last: Column) -> Column:
        unseen = 1 / (1 + math.exp(-self.examination.baseline))
        return F.coalesce(F.element_at(item["t"], last), F.lit(unseen))

    def unconditional(self, rows: DataFrame) -> DataFrame:
        """One fold over a session's ranks, which carry their rows along. The state holds P(the last click so far is at i) for i
        = none, 1, 2, ..."""
        item = F.struct(F.col("position").cast("int").alias("position"), self.attraction.prob().alias("a"), F.col("_theta").alias("t"), F.struct(*rows.columns).alias("row"))
        whole = self._by_rank(rows).groupBy("session_id").agg(F.array_sort(F.collect_list(item), lambda x, y: x["position"] - y["position"]).alias("_items"))
        kind = "array<struct<at:int,s:double>>"

        def step(state: Column, item: Column) -> Column:
            hit = lambda x: x["s"] * self._theta(item, x["at"]) * item["a"]
            p = exprs.total(F.transform(state["s"], hit))
            kept = F.transform(state["s"], lambda x: F.struct(x["at"].alias("at"), (x["s"] - hit(x)).alias("s")))
            return F.struct(F.concat(kept, F.array(F.struct(item["position"].alias("at"), p.alias("s")))).alias("s"), F.concat(state["p"], F.array(p)).alias("p"))

        zero = F.struct(F.array(F.struct(F.lit(0).alias("at"), F.lit(1.0).alias("s"))).cast(kind).alias("s"), F.array().cast("array<double>").alias("p"))
        found = whole.select("_items", F.aggregate("_items", zero, step, lambda s: s["p"]).alias("_p"))
        found = found.select(F.explode(F.zip_with("_items", "_p", lambda x, p: F.struct(x["row"].alias("row"), p.alias("p")))).alias("_z"))
        return found.select("_z.row.*", exprs.clipped_log(F.col("_z.p")).alias("log_prob"))

    def relevance(self) -> Column:
        return self.attraction.log_prob()

    def sample(self, impressions: DataFrame, salt: int = 0) -> DataFrame:
        rows = self._by_rank(self.prepare(impressions).withColumn("position", F.col("position").cast("int")))
        item = F.struct("position", (draw(salt) < self.attraction.prob()).alias("a"), F.col("_theta").alias("t"), draw(salt + 1).alias("u"))
        sessions = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(item), lambda x, y: x["position"] - y["position"]).alias("_items"))
        one = "array<struct<position:int,sim_exam:boolean,sim_attr:boolean,sim_click:int>>"
        zero = F.struct(F.lit(0).alias("last"), F.array().cast(one).alias("out"))

        def step(state: Column, item: Column) -> Column:
            exam = item["u"] < self._theta(item, state["last"])
            click = exam & item["a"]
            done = F.struct(item["position"].alias("position"), exam.alias("sim_exam"), item["a"].alias("sim_attr"), click.cast("int").alias("sim_click"))
            return F.struct(F.when(click, item["position"]).otherwise(state["last"]).alias("last"), F.concat(state["out"], F.array(done)).alias("out"))

        out = sessions.select("session_id", F.explode(F.aggregate("_items", zero, step, lambda s: s["out"])).alias("_o")).select("session_id", "_o.*")
        return impressions.join(out, ["session_id", "position"])


@dataclass
class Cascade(ClickModel):
    """``textbook``: a rank before the first click has conditional log-probability log(attraction)."""

    attraction: Param
    textbook: bool = False

    @property
    def params(self) -> list[Param]:
        return [self.attraction]

    def conditional(self, rows: DataFrame) -> DataFrame:
        first = self.attraction.log_prob() if self.textbook else self.attraction.log_prob() + prefix(self.attraction.log_complement())
        return rows.withColumn("cond_log_prob", F.when(clicks_before() == 0, first).otherwise(F.lit(NEVER)))

    def unconditional(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("log_prob", self.attraction.log_prob() + prefix(self.attraction.log_complement()))

    def relevance(self) -> Column:
        return self.attraction.log_prob()

    def sample(self, impressions: DataFrame, salt: int = 0) -> DataFrame:
        rows = self.prepare(impressions).withColumn("sim_attr", draw(salt) < self.attraction.prob())
        rows = rows.withColumn("sim_exam", F.coalesce(F.sum(F.col("sim_attr").cast("int")).over(before()), F.lit(0)) == 0)
        return rows.withColumn("sim_click", (F.col("sim_exam") & F.col("sim_attr")).cast("int")).select(*impressions.columns, "sim_exam", "sim_attr", "sim_click")


@dataclass
class ChainModel(ClickModel):
    """Models in which a user walks down the list: what differs is how a click and a skip continue."""

    attraction: Param

    def go_after_skip(self) -> Column:
        """log P(next rank examined | examined, no click)."""
        raise NotImplementedError

    def go_after_click(self) -> Column:
        """P(next rank examined | clicked)."""
        raise NotImplementedError

    def log_step(self) -> Column:
        """log P(next rank examined | examined)."""
        a = self.attraction.prob()
        return F.log(a * self.go_after_click() + (1 - a) * F.exp(self.go_after_skip()))

    def conditional(self, rows: DataFrame) -> DataFrame:
        rows = examination_after_history(rows, self.attraction.log_complement(), self.go_after_skip(), self.go_after_click(), self.attraction.prob())
        return rows.withColumn("cond_log_prob", F.log(F.col("_exam")) + self.attraction.log_prob())

    def unconditional(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("log_prob", self.attraction.log_prob() + prefix(self.log_step()))

    def relevance(self) -> Column:
        return self.attraction.log_prob()

    def satisfied(self, salt: int) -> Column:
        """Would a click at this rank satisfy?"""
        return F.lit(False)

    def stays(self, salt: int) -> Column:
        """Would the user go on from this rank, by its own draws (``sim_attr`` and ``_sat`` are there)?"""
        raise NotImplementedError

    def sample(self, impressions: DataFrame, salt: int = 0) -> DataFrame:
        """Going on depends on a rank's own draws only: a rank is examined if all earlier ones would go on."""
        rows = self.prepare(impressions).withColumn("sim_attr", draw(salt) < self.attraction.prob()).withColumn("_sat", self.satisfied(salt + 1))
        rows = rows.withColumn("_stays", self.stays(salt + 2))
        rows = rows.withColumn("sim_exam", F.coalesce(F.min("_stays").over(before()), F.lit(True)))
        rows = rows.withColumn("sim_click", (F.col("sim_exam") & F.col("sim_attr")).cast("int"))
        last = F.max("position").over(Window.partitionBy("session_id"))
        rows = rows.withColumn("sim_sat", (F.col("sim_click") == 1) & F.col("_sat") & (F.col("position") < last))
        return rows.select(*impressions.columns, "sim_exam", "sim_attr", "sim_sat", "sim_click")


@dataclass
class DependentClick(ChainModel):
    continuation: Param = field(default=None)

    @property
    def params(self) -> list[Param]:
        return [self.attraction, self.continuation]

    def go_after_skip(self) -> Column:
        return F.lit(0.0)

    def go_after_click(self) -> Column:
        return self.continuation.prob()

    def stays(self, salt: int) -> Column:
        return ~F.col("sim_attr") | (draw(salt) < self.continuation.prob())


@dataclass
class ClickChain(ChainModel):
    """One parameter is attraction and satisfaction."""

    tau1: float = 0.8
    tau2: float = 0.6
    tau3: float = 0.3

    @property
    def params(self) -> list[Param]:
        return [self.attraction]

    def go_after_skip(self) -> Column:
        return F.lit(math.log(self.tau1))

    def go_after_click(self) -> Column:
        a = self.attraction.prob()
        return a * self.tau3 + (1 - a) * self.tau2

    def satisfied(self, salt: int) -> Column:
        return draw(salt) < self.attraction.prob()

    def stays(self, salt: int) -> Column:
        p = F.when(~F.col("sim_attr"), self.tau1).when(F.col("_sat"), self.tau3).otherwise(self.tau2)
        return draw(salt) < p


@dataclass
class DynamicBayesian(ChainModel):
    """``going`` is the continuation probability; 1 gives the simplified model."""

    satisfaction: Param = field(default=None)
    going: float = 1.0

    @property
    def params(self) -> list[Param]:
        return [self.attraction, self.satisfaction]

    def go_after_skip(self) -> Column:
        return F.lit(math.log(self.going))

    def go_after_click(self) -> Column:
        return self.going * (1 - self.satisfaction.prob())

    def relevance(self) -> Column:
        return self.attraction.log_prob() + self.satisfaction.log_prob()

    def satisfied(self, salt: int) -> Column:
        return draw(salt) < self.satisfaction.prob()

    def stays(self, salt: int) -> Column:
        return (~F.col("sim_attr") | ~F.col("_sat")) & (draw(salt) < self.going)


@dataclass
class Mixture(ClickModel):
    """A prior over models; a session's posterior comes from its whole conditional likelihood."""

    models: dict[str, ClickModel]
    prior: dict[str, float]
    temperature: float = 1.0

    def _all(self, impressions: DataFrame, only: str) -> tuple[DataFrame, list[str]]:
        rows, own, names = impressions, list(impressions.columns), []
        for name, model in self.models.items():
            rows = model.score(rows, (only,)).withColumnRenamed(only, f"_m_{name}")
            names.append(f"_m_{name}")
        return rows.select(*own, *names), names

    def session_nll(self, impressions: DataFrame) -> DataFrame:
        """``session_id`` and each model's summed conditional negative log-likelihood."""
        rows, names = self._all(impressions, "cond_log_prob")
        return rows.groupBy("session_id").agg(*(F.sum(exprs.bce_log(F.col("click"), F.col(c))).alias(f"nll_{m}") for m, c in zip(self.models, names, strict=True)))

    def posterior(self, impressions: DataFrame, temperature: float = 1.0) -> DataFrame:
        """``session_id`` and ``post_<model>``, the log-posteriors; the conditional prediction takes temperature 1."""
        nll = self.session_nll(impressions)
        logs = [math.log(self.prior[m]) - temperature * F.col(f"nll_{m}") for m in self.models]
        whole = exprs.logsumexp(F.array(*logs))
        return nll.select("session_id", *((x - whole).alias(f"post_{m}") for m, x in zip(self.models, logs, strict=True)))

    def score(self, impressions: DataFrame, only: tuple[str, ...] = ("cond_log_prob", "log_prob", "relevance")) -> DataFrame:
        """Each model is scored once; a session's likelihoods are window sums over the rows that are scored."""
        out, whole = impressions, Window.partitionBy("session_id")
        for column in only:
            rows, names = self._all(out, column)
            if column == "cond_log_prob":
                logs = [math.log(self.prior[m]) - F.sum(exprs.bce_log(F.col("click"), F.col(c))).over(whole) for m, c in zip(self.models, names, strict=True)]
                rows = rows.withColumn("_logs", F.array(*logs))
                terms = [F.col(c) + F.col("_logs")[i] - exprs.logsumexp(F.col("_logs")) for i, c in enumerate(names)]
            else:
                terms = [F.col(c) + math.log(self.prior[m]) for m, c in zip(self.models, names, strict=True)]
            out = rows.withColumn(column, exprs.logsumexp(F.array(*terms))).select(*out.columns, column)
        return out

    def sample(self, impressions: DataFrame, salt: int = 0) -> DataFrame:
        u, upto, chosen = keys.uniform(F.col("session_id"), F.lit(0), F.lit(salt + 97)), 0.0, None
        names = list(self.models)
        for i, m in enumerate(names[:-1]):
            upto += self.prior[m]
            chosen = F.when(u < upto, i) if chosen is None else chosen.when(u < upto, i)
        chosen = F.lit(0) if chosen is None else chosen.otherwise(len(names) - 1)
        rows = impressions
        for m, model in self.models.items():
            rows = model.sample(rows, salt).select(*rows.columns, F.col("sim_click").alias(f"_s_{m}"))
        rows = rows.withColumn("sim_model", chosen)
        return rows.withColumn("sim_click", F.array(*(f"_s_{m}" for m in names))[F.col("sim_model")]).select(*impressions.columns, "sim_model", "sim_click")
