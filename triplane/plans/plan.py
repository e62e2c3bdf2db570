"""Typed question plans and their compilation to the query algebra."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import TYPE, Rel, text_of
from ..sources.turtle import Term
from .algebra import Compiler
from .expressions import Scope, evaluate
from .sparql import Bgp, Graph, Group, Triple, Values, Var

#: The shapes of a question, those compiled here, comparisons, aggregates, orders, ways to read a result.
SHAPES = ("lookup", "path", "count", "aggregate", "list", "superlative", "compare", "boolean", "unsupported")
COMPILED = SHAPES[:-1]
COMPARISONS = {"eq": "=", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}
AGGREGATES = ("sum", "avg", "min", "max")
ORDERS = ("desc", "asc")
READINGS = ("column", "scalar", "ask", "extreme", "compare_max", "compare_min", "table")


class PlanError(ValueError):
    """The plan lacks what its shape needs."""


@dataclass(frozen=True)
class Step:
    """One property, followed or turned around, in one graph (None: any)."""

    prop: str
    inverse: bool = False
    graph: str | None = None


@dataclass(frozen=True)
class Literal:
    """A value in a question: kind string, number, year, date or date_range; ``low`` and ``high`` bound a period."""

    kind: str
    value: Any = None
    low: dt.date | None = None
    high: dt.date | None = None


@dataclass(frozen=True)
class Link:
    """The target reaches the anchor along the path."""

    path: tuple[Step, ...]
    anchor: str


@dataclass(frozen=True)
class Filter:
    """A value at the end of the path compares so with the literal. ``temporal``: that value is a date or time."""

    path: tuple[Step, ...]
    op: str
    literal: Literal
    temporal: bool = False


@dataclass(frozen=True)
class QueryPlan:
    shape: str
    classes: tuple[str, ...] = ()  # the target class and all below it
    graph: str | None = None
    subject: str | None = None
    compare: tuple[str, ...] = ()
    links: tuple[Link, ...] = ()
    filters: tuple[Filter, ...] = ()
    path: tuple[Step, ...] = ()  # to the answer, or to the measure
    agg: str | None = None
    order: str = "desc"
    confidences: dict[str, float] = field(default_factory=dict, hash=False)

    @property
    def confidence(self) -> float:
        return min(self.confidences.values(), default=1.0)


@dataclass
class Answer:
    """A compiled plan: a DataFrame and how to read it."""

    df: DataFrame
    reading: str


class PlanCompiler:
    """Plans over a store as DataFrames. A plan becomes one logical plan; Catalyst orders and prunes it."""

    def __init__(self, store: Any) -> None:
        self.store, self.algebra, self.n = store, Compiler(store, merged=False), 0

    def supports(self, plan: QueryPlan) -> str | None:
        """What the plan lacks, or None."""
        if plan.shape not in COMPILED:
            return f"shape {plan.shape!r} has no template"
        if plan.shape in ("lookup", "path") and not (plan.subject and plan.path):
            return "a lookup needs a subject and a path"
        if plan.shape in ("aggregate", "superlative", "compare") and not plan.path:
            return "a measure needs a path"
        if plan.shape == "aggregate" and plan.agg not in AGGREGATES:
            return f"unknown aggregate {plan.agg!r}"
        if plan.shape == "boolean" and not plan.subject:
            return "a yes-or-no question needs a subject"
        return None

    def compile(self, plan: QueryPlan) -> Answer:
        lack = self.supports(plan)
        if lack:
            raise PlanError(lack)
        return getattr(self, f"_{'lookup' if plan.shape == 'path' else plan.shape}")(plan)

    def relaxed_count(self, plan: QueryPlan) -> DataFrame:
        """How many targets there are without the value filters; tells an empty answer from a wrong path."""
        return self._count(replace(plan, shape="count", filters=())).df

    # -- parts
    def _var(self) -> Var:
        self.n += 1
        return Var(f"v{self.n}")

    def _chain(self, start: Any, path: tuple[Step, ...], end: Any) -> list[Any]:
        """Patterns from ``start`` along ``path`` to ``end``, in their graphs."""
        parts, at = [], start
        for i, step in enumerate(path):
            to = end if i == len(path) - 1 else self._var()
            s, o = (to, at) if step.inverse else (at, to)
            bgp = Bgp([Triple(s, step.prop, o)])
            parts.append(Graph(Term(0, step.graph), Group([bgp])) if step.graph else bgp)
            at = to
        return parts

    def _target(self, plan: QueryPlan, x: Any, typed: bool = True) -> Group:
        parts: list[Any] = []
        if typed:
            if len(plan.classes) == 1:
                bgp = Bgp([Triple(x, TYPE, Term(0, plan.classes[0]))])
                parts.append(Graph(Term(0, plan.graph), Group([bgp])) if plan.graph else bgp)
            else:
                t = self._var()
                bgp = Bgp([Triple(x, TYPE, t)])
                parts.append(Values([t.name], [[Term(0, c)] for c in plan.classes]))
                parts.append(Graph(Term(0, plan.graph), Group([bgp])) if plan.graph else bgp)
        filters = []
        for link in plan.links:
            parts += self._chain(x, link.path, Term(0, link.anchor))
        for f in plan.filters:
            v = self._var()
            parts += self._chain(x, f.path, v)
            filters.append((v.name, f))
        return _merged(Group(parts, [_Test(name, f) for name, f in filters]))

    def _solve(self, group: Group) -> Rel:
        tests = [f for f in group.filters if isinstance(f, _Test)]
        rel = self.algebra._group(Group(group.parts, [f for f in group.filters if not isinstance(f, _Test)]), None)
        for t in tests:
            rel = Rel(rel.df.where(t.column(rel)), rel.info)
        return rel

    def _x(self, plan: QueryPlan) -> Rel:
        rel = self._solve(self._target(plan, Var("x"))).select(["x"])
        return Rel(rel.df.distinct(), rel.info)

    def _measured(self, plan: QueryPlan) -> Rel:
        """Distinct pairs of target and measure: a target with two equal values counts once, with two others twice."""
        group = self._target(plan, Var("x"))
        group.parts += self._chain(Var("x"), plan.path, Var("m"))
        rel = self._solve(_merged(group)).select(["x", "m"])
        return Rel(rel.df.distinct(), rel.info)

    def _number(self, rel: Rel, name: str = "m") -> Column:
        return evaluate(Var(name), Scope(rel)).num()

    # -- shapes
    def _lookup(self, plan: QueryPlan) -> Answer:
        start = self._var()
        group = Group([Values([start.name], [[Term(0, plan.subject)]]), *self._chain(start, plan.path, Var("answer"))])
        rel = self._solve(_merged(group)).select(["answer"])
        return Answer(_shown(Rel(rel.df.distinct(), rel.info)), "column")

    def _list(self, plan: QueryPlan) -> Answer:
        rel = self._x(plan)
        return Answer(_shown(Rel(rel.df.withColumnRenamed("x", "answer"), {"answer": rel.info["x"]})), "column")

    def _count(self, plan: QueryPlan) -> Answer:
        rel = self._x(plan)
        return Answer(rel.df.agg(F.count(F.lit(1)).alias("answer")), "scalar")

    def _aggregate(self, plan: QueryPlan) -> Answer:
        """``answer`` is NULL when there was nothing to aggregate; ``n`` tells how much there was."""
        rel = self._measured(plan)
        m = self._number(rel)
        return Answer(rel.df.agg(getattr(F, plan.agg)(m).alias("answer"), F.count(m).alias("n")), "scalar")

    def _superlative(self, plan: QueryPlan) -> Answer:
        """Every target that shares the extreme measure, however many tie."""
        rel = self._measured(plan)
        m = self._number(rel)
        extreme = rel.df.agg((F.max if plan.order == "desc" else F.min)(m).alias("_top"))
        tied = rel.df.join(F.broadcast(extreme), m == F.col("_top"))  # one row
        return Answer(tied.select(text_of(rel.info["x"], F.col("x")).alias("answer"), m.alias("measure")).distinct(), "extreme")

    def _compare(self, plan: QueryPlan) -> Answer:
        group = Group([Values(["x"], [[Term(0, e)] for e in plan.compare]), *self._chain(Var("x"), plan.path, Var("m"))])
        rel = self._solve(_merged(group))
        best = F.max if plan.order == "desc" else F.min
        per = rel.df.groupBy(text_of(rel.info["x"], F.col("x")).alias("answer")).agg(best(self._number(rel)).alias("measure"))
        order = F.col("measure").desc_nulls_last() if plan.order == "desc" else F.col("measure").asc_nulls_last()
        # As many rows as there are entities named in the plan.
        return Answer(per.withColumn("rank", F.rank().over(Window.orderBy(order))).where("rank = 1 AND measure IS NOT NULL").drop("rank"), "compare_max" if plan.order == "desc" else "compare_min")

    def _boolean(self, plan: QueryPlan) -> Answer:
        """Whether the subject meets the constraints; its class isn't tested."""
        group = self._target(plan, Var("x"), typed=False)
        group.parts.insert(0, Values(["x"], [[Term(0, plan.subject)]]))
        rel = self._solve(_merged(group))
        return Answer(rel.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer")), "ask")


@dataclass
class _Test:
    """A value filter on a variable."""

    name: str
    filter: Filter

    def column(self, rel: Rel) -> Column:
        f, lit = self.filter, self.filter.literal
        v = evaluate(Var(self.name), Scope(rel))
        if lit.kind == "string":
            return v.text() == str(lit.value)
        if lit.low is not None and (f.temporal or lit.kind != "year"):
            low, after = F.lit(lit.low).cast("timestamp_ntz"), F.lit(lit.high + dt.timedelta(days=1)).cast("timestamp_ntz")
            t = v.time().cast("timestamp_ntz")
            return {"eq": (t >= low) & (t < after), "gt": t >= after, "ge": t >= low, "lt": t < low, "le": t < after}[f.op]
        c = v.num()
        return {"eq": c == lit.value, "gt": c > lit.value, "ge": c >= lit.value, "lt": c < lit.value, "le": c <= lit.value}[f.op]


def _merged(group: Group) -> Group:
    """Patterns of one graph put together, so that one scan can serve several; inline tables stay first."""
    loose, by, rest = Bgp([]), {}, []
    for p in group.parts:
        if isinstance(p, Bgp):
            loose.triples += p.triples
        elif isinstance(p, Graph) and all(isinstance(q, Bgp) for q in p.group.parts):
            by.setdefault(p.name.text, []).extend(t for q in p.group.parts for t in q.triples)
        else:
            rest.append(p)
    graphs = [Graph(Term(0, g), Group([Bgp(ts)])) for g, ts in by.items()]
    return Group([*rest, *([loose] if loose.triples else []), *graphs], group.filters)


def _shown(rel: Rel) -> DataFrame:
    return rel.df.select(*[(text_of(i, F.col(n)) if i.kind == "iri" else F.col(n)).alias(n) for n, i in rel.info.items()])


def year(value: int) -> Literal:
    return Literal("year", value, dt.date(value, 1, 1), dt.date(value, 12, 31))


def read(answer: Answer, cap: int = 10_000) -> dict[str, Any]:
    """Values of an answer on the driver, at most ``cap``, with whether there were more."""
    rows = answer.df.limit(cap + 1).collect()
    truncated, rows = len(rows) > cap, rows[:cap]
    if answer.reading == "ask":
        return {"values": [bool(rows[0]["answer"])], "empty": False, "truncated": False}
    if answer.reading == "scalar":
        value = rows[0]["answer"] if rows else None
        guard = rows[0]["n"] if rows and "n" in rows[0] else None
        values = [] if value is None or guard == 0 else [value]
        return {"values": values, "empty": not values or guard is None and value == 0, "truncated": False}
    if answer.reading == "table":
        return {"values": [tuple(r) for r in rows], "empty": not rows, "truncated": truncated}
    values = list(dict.fromkeys(r["answer"] for r in rows if r["answer"] is not None))
    return {"values": values, "empty": not values, "truncated": truncated}

