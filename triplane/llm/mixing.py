"""Sources mixed to target shares of the total size, with capped repetition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

#: Most cells (source x language x topic that occur together), times mixes, raked on the driver at some 100 bytes each;
#: more is an error, not a silent cut. It bounds what the driver holds, whatever the number of documents.
MAX_CELLS = 2_000_000
#: Up to so many rates are sent to every task; beyond that they are joined as Spark sees fit.
BROADCAST_RATES = 100_000
#: Rounds of fitting at most, and the change of a weight, as a part of its cap, at which it has settled.
ROUNDS = 200
SETTLED = 1e-9
#: Classes into which a source's draws are cut to find where its budget ends.
STEPS = 1 << 16


def water_fill(weights: np.ndarray, size: np.ndarray, cap: float, goal: float) -> np.ndarray:
    """``min(cap, f * weights)`` with the factor f that makes ``sum(size * result)`` the goal, or all at the cap."""
    if goal >= cap * size.sum():
        return np.full(len(size), float(cap))
    if goal <= 0 or not len(size):
        return np.zeros(len(size))
    order = np.argsort(-weights)
    w, t = weights[order], size[order]
    capped = np.concatenate([[0.0], np.cumsum(t)]) * cap  # size of the first k at the cap
    open_ = (w * t)[::-1].cumsum()[::-1]
    for k in range(len(w)):
        f = (goal - capped[k]) / open_[k] if open_[k] > 0 else np.inf
        if f * w[k] <= cap * (1 + 1e-12):
            got = np.empty(len(w))
            got[order] = np.minimum(cap, f * w)
            return got
    return np.full(len(size), float(cap))


def rake(cells: dict[str, np.ndarray], size: np.ndarray, goals: dict[str, dict], cap: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, int, float]:
    """Iterative proportional fitting of repeats per cell, at most ``cap`` each; with the rounds and the last change.

    ``cells`` has a label per cell in each dimension, ``goals`` the size each label should reach. The first dimension
    is met exactly (it is fitted last in each round, and its goals must be within the caps); the others as nearly as
    the caps and the first allow. A last change above SETTLED says that the goals contradict each other.
    """
    weights = np.ones(len(size))
    groups = {}
    for d in goals:
        labels, number = np.unique(cells[d].astype(str), return_inverse=True)
        order = np.argsort(number, kind="stable")
        parts = dict(zip(labels.tolist(), np.split(order, np.cumsum(np.bincount(number))[:-1]), strict=True)) if len(size) else {}
        groups[d] = [(parts[label], goal) for label, goal in goals[d].items() if label in parts]
    dims = list(goals)
    change = 0.0
    for n in range(1, rounds + 1):
        was = weights.copy()
        for d in [*dims[1:], dims[0]]:
            for at, goal in groups[d]:
                weights[at] = water_fill(np.maximum(weights[at], 1e-12), size[at], float(cap[at].max()), goal)
        change = float(np.abs(weights - was).max(initial=0))
        if change < SETTLED:
            break
    return weights, n, change


def fit(docs: DataFrame, targets: DataFrame, marginals: dict[str, dict[str, float]] | None = None):  # noqa: ANN201
    """The plan of :func:`mix`: repeats per mix and cell, the marginals wanted and planned, and how the fitting went.

    Three pandas tables: ``mix_id, source, lang, topic, rate, goal``; ``mix_id, dimension, label, target_share,
    planned_share``; ``mix_id, rounds, last_change``. ``marginals`` has target shares by label for ``lang``, ``topic``
    or both; labels not named get nothing. A dimension not given keeps its shares among the documents of the mix's
    sources. Shares of labels that occur are scaled to 1.
    """
    import pandas as pd

    named = targets.where("mix_id IS NOT NULL AND source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
    # Targets are a table of settings: one row per mix and source.
    wanted = named.groupBy("mix_id", "source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).limit(MAX_CELLS + 1).toPandas()
    cells = _cells(docs, "doc IS NOT NULL").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).limit(MAX_CELLS + 1).toPandas()
    if len(cells) * max(1, wanted["mix_id"].nunique()) > MAX_CELLS or len(wanted) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic times mixes, or targets")
    rates, reached_, how = [], [], []
    for mix_id in sorted(set(wanted["mix_id"])):
        mine = wanted[wanted["mix_id"] == mix_id]
        share, caps = dict(zip(mine["source"], mine["share"], strict=True)), dict(zip(mine["source"], mine["cap"].astype(float), strict=True))
        part = cells[cells["source"].isin(share)]
        if part.empty:
            continue
        label = {k: part[k].to_numpy(object) for k in ("source", "lang", "topic")}
        size = part["tokens"].to_numpy(float)
        of = part.groupby("source")["tokens"].sum().astype(float).to_dict()
        total = min(caps[s] * t / share[s] for s, t in of.items())
        goals = {"source": {s: share[s] * total for s in of}}
        reached = sum(goals["source"].values())
        for k in ("lang", "topic"):
            has = part.groupby(k)["tokens"].sum().astype(float)
            to = has if k not in (marginals or {}) else pd.Series({x: marginals[k].get(x, 0.0) for x in has.index})
            if not to.sum() > 0:
                raise ValueError(f"no target of {k} has documents in mix {mix_id}")
            goals[k] = (to / to.sum() * reached).to_dict()
        cap = part["source"].map(caps).to_numpy(float)
        # Caps differ between the cells of a label: weights are fitted as parts of the cap.
        scaled, rounds, change = rake(label, size * cap, goals, np.ones(len(size)))
        weights = np.minimum(scaled, 1.0) * cap
        rates.append(part.drop(columns="tokens").assign(mix_id=mix_id, rate=weights, goal=part["source"].map(goals["source"]).to_numpy(float)))
        for k, to in goals.items():
            planned = pd.Series(weights * size).groupby(label[k]).sum()
            reached_ += [(mix_id, k, x, goal / reached, planned[x] / planned.sum()) for x, goal in to.items()]
        how.append((mix_id, rounds, change))
    columns = ["mix_id", "source", "lang", "topic", "rate", "goal"]
    rate = pd.concat(rates)[columns] if rates else pd.DataFrame(columns=columns)
    return rate, pd.DataFrame(reached_, columns=["mix_id", "dimension", "label", "target_share", "planned_share"]), pd.DataFrame(how, columns=["mix_id", "rounds", "last_change"])


def _cells(docs: DataFrame, where: str, doc: str = "doc") -> DataFrame:
    lang, topic = F.coalesce("lang", F.lit("")), F.coalesce("topic", F.lit(""))
    d = docs.select(*([F.col(doc).alias("doc")] if doc in docs.columns else [F.lit(0).alias("doc")]), "source", lang.alias("lang"), topic.alias("topic"), F.col("tokens").cast("long").alias("tokens"))
    return d.where(f"{where} AND source IS NOT NULL AND tokens > 0")


def mix(docs: DataFrame, targets: DataFrame, doc: str, seed: int = 0, marginals: dict[str, dict[str, float]] | None = None, cells: bool = False) -> DataFrame:
    """``mix_id, doc, source, tokens, repeats``: the documents drawn for each mix, and how often each is used; with ``cells``
    their ``lang`` and ``topic`` too.

    ``docs`` has ``doc, source, lang, topic, tokens``; ``targets`` has ``mix_id, source, target_share, max_repeats``.
    The total of a mix is the largest at which every source that has documents reaches its share within its cap, so
    the scarcest source is used up. A target without documents can't be reached: the others keep their proportions
    and :func:`shares` reports what came of each. Documents of sources with share 0, of sources not named (or NULL),
    and without tokens are never drawn. NULL languages and topics are labels like any other, written ''. ``doc`` must
    be unique.

    Tokens are summed per cell of source, language and topic. The cells are raked: sources to their target shares,
    languages and topics to ``marginals`` (see :func:`fit`, which also says how well the fitting went), every cell's
    repeats within the cap. Each document is used floor(repeats) times, and once more with the probability that is
    left. These draws are ordered by u / probability, u a hash of seed, mix and document, and taken in that order until
    the source's size is met (sequential Poisson sampling), so a share misses its target by less than one document. The
    order is cut into STEPS classes whose sizes are added up map-side; only the class in which the budget ends is put
    in order, which holds 1/STEPS of a source, so a source with most of the rows costs no task more than others.
    """
    spark = docs.sparkSession
    rates, _, _ = fit(docs.withColumn("doc", F.col(doc)), targets, marginals)
    d = _cells(docs, "doc IS NOT NULL", doc)
    mix_type = dict(targets.dtypes)["mix_id"]
    rate = spark.createDataFrame(list(rates.itertuples(index=False)), f"mix_id {mix_type}, source string, lang string, topic string, rate double, goal double")
    u = (F.xxhash64(F.lit(seed), "mix_id", "doc") / F.lit(2.0**64) + 0.5).cast("double")
    rate = F.broadcast(rate) if len(rates) <= BROADCAST_RATES else rate
    drawn = d.join(rate, ["source", "lang", "topic"]).withColumn("sure", F.floor(F.col("rate") + 1e-9)).withColumn("chance", F.greatest(F.col("rate") - F.col("sure"), F.lit(0.0)))
    xi = F.when(F.col("chance") > 1e-9, u / F.col("chance"))
    # u / chance grows without bound as chances fall; x / (1 + x) keeps the order and lies below 1.
    step = F.floor(xi / (1 + xi) * STEPS).cast("int")
    drawn = materialize(drawn.select("mix_id", "doc", "source", "lang", "topic", "tokens", "sure", "goal", xi.alias("xi"), step.alias("step")), "draws")
    key = ["mix_id", "source"]
    sizes = drawn.groupBy(*key, "step").agg(F.sum(F.when(F.col("step").isNotNull(), F.col("tokens")).otherwise(0)).alias("more"), F.sum(F.col("sure") * F.col("tokens")).alias("sure"), F.max("goal").alias("goal"))
    left = sizes.groupBy(*key).agg((F.max("goal") - F.sum("sure")).alias("budget"))
    run = Window.partitionBy(*key).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = sizes.where("step IS NOT NULL").withColumn("upto", F.sum("more").over(run)).join(left, key)
    ends = upto.where("upto > budget").groupBy(*key).agg(F.min_by(F.struct("step", (F.col("upto") - F.col("more")).alias("before")), "step").alias("e"), F.max("budget").alias("budget")).select(*key, F.col("e.step").alias("end"), F.col("e.before").alias("before"), "budget")
    marked = drawn.join(F.broadcast(ends), key, "left")
    # In the class where the budget ends, a document is taken when half of it still fits.
    inside = Window.partitionBy(*key).orderBy("xi", "doc").rowsBetween(Window.unboundedPreceding, -1)
    last = marked.where("step = end").withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).withColumn("extra", (F.col("start") + F.col("tokens") / 2 <= F.col("budget")).cast("int"))
    rest = marked.where("step IS NULL OR end IS NULL OR step <> end").withColumn("extra", F.when(F.col("step").isNotNull() & (F.col("end").isNull() | (F.col("step") < F.col("end"))), 1).otherwise(0))
    out = ["mix_id", "doc", "source", *(["lang", "topic"] if cells else []), "tokens", (F.col("sure") + F.col("extra")).cast("long").alias("repeats")]
    return rest.select(*out).unionByName(last.select(*out)).where("repeats > 0").withColumnRenamed("doc", doc)


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target its share of the drawn tokens, the documents used and the greatest repeat. Unreached targets have 0."""
    got = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    total = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy("mix_id"))
    return (
        targets.join(got, ["mix_id", "source"], "left")
        .select("mix_id", "source", "target_share", F.round(F.coalesce("tokens", F.lit(0)) / F.when(total > 0, total), 6).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats")
    )


def marginal_shares(drawn: DataFrame, planned) -> DataFrame:  # noqa: ANN001
    """``mix_id, dimension, label, target_share, planned_share, actual_share`` for source, language and topic.

    ``drawn`` comes from :func:`mix` with ``cells``.
    ``planned`` is the second table of :func:`fit`. Where caps and sources leave no room for a target of a language or
    topic, the planned share shows it.
    """
    spark = drawn.sparkSession
    kind = dict(drawn.dtypes)["mix_id"]
    plan = spark.createDataFrame(list(planned.itertuples(index=False)), f"mix_id {kind}, dimension string, label string, target_share double, planned_share double")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).alias("label")) for k in ("source", "lang", "topic")]))
    got = drawn.select("mix_id", each.alias("e"), (F.col("tokens") * F.col("repeats")).alias("t")).groupBy("mix_id", "e.dimension", "e.label").agg(F.sum("t").alias("tokens"))
    total = drawn.groupBy("mix_id").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("total"))
    actual = F.coalesce(F.col("tokens"), F.lit(0)) / F.col("total")
    return plan.join(got, ["mix_id", "dimension", "label"], "left").join(total, "mix_id").select("mix_id", "dimension", "label", F.round("target_share", 6).alias("target_share"), F.round("planned_share", 6).alias("planned_share"), F.round(actual, 6).alias("actual_share"))
