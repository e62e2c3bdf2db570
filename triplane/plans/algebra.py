"""SPARQL algebra as DataFrames: patterns become scans and joins, everything else built-in operators."""

from __future__ import annotations

import threading
import uuid
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import PARTS, TYPE, Info, Rel, constant, key_in, text_of, union, widened
from ..sources.turtle import XSD, Term
from .expressions import Scope, aggregate, evaluate, truth
from .factored import factored
from .sparql import AGGREGATES, Bgp, Bind, Call, Graph, Group, Minus, Optional, Path, Query, SparqlError, Triple, Union, Values, Var, parse, walk

#: Rounds of a path's closure after which its pairs are written as one table again.
ROUNDS_A_TABLE = 16
#: Shared variables that may be unbound by which a join is split, each doubling its parts; more are compared as they are.
MAX_SPLIT = 3


class Compiler:
    """Compiles queries over a store. ``merged``: patterns outside of GRAPH read the union of all graphs as one set;
    otherwise they read every graph as it is (a statement in two graphs matches twice)."""

    def __init__(self, store: Any, prefixes: dict[str, str] | None = None, merged: bool = True) -> None:
        self.store, self.prefixes, self.merged, self.fresh = store, prefixes or {}, merged, 0

    # -- entry points
    def rel(self, query: Query | str) -> Rel:
        query = parse(query, self.prefixes) if isinstance(query, str) else query
        return self._select(query, None)

    def select(self, query: Query | str, typed: bool = True) -> DataFrame:
        """A DataFrame with one column per selected variable: IRIs in full, literals in their type (text for quads)."""
        rel = self.rel(query)
        return rel.df.select(*[(text_of(i, F.col(n)) if i.kind == "iri" or not typed else F.col(n)).alias(n) for n, i in rel.info.items()])

    def ask(self, query: Query | str, seconds: float | None = None) -> bool:
        """Whether the query has a solution; within ``seconds`` if they are given."""
        query = parse(query, self.prefixes) if isinstance(query, str) else query
        return bool(rows_within(self._group(query.where, None).df.limit(1), seconds))

    def rows(self, query: Query | str, seconds: float | None = None) -> list:
        """The solutions of a SELECT, on the driver; within ``seconds`` if they are given."""
        return rows_within(self.select(query), seconds)

    def construct(self, query: Query | str) -> DataFrame:
        """Quads without graph, one set. Triples with an unbound part or a literal subject are left out."""
        query = parse(query, self.prefixes) if isinstance(query, str) else query
        base = self._modified(query, self._group(query.where, None))
        out = []
        for t in query.template:
            rel, parts = base, []
            for place in (t.s, t.p, t.o):
                if isinstance(place, Var) and place.name in rel.info:
                    rel = widened(rel, place.name)
                    n = place.name
                    parts.append((F.col(n), F.col(f"{n}__k"), F.col(f"{n}__dt"), F.col(f"{n}__l")))
                elif isinstance(place, Var):
                    parts.append(tuple(F.lit(None).cast(k) for k in ("string", "int", "string", "string")))
                else:
                    term = Term(0, place) if isinstance(place, str) else place
                    parts.append((F.lit(term.text), F.lit(term.kind), F.lit(term.datatype).cast("string"), F.lit(term.lang).cast("string")))
            (s, sk, _, _), (p, _, _, _), (o, ok, odt, ol) = parts
            out.append(rel.df.select(s.alias("s"), p.alias("p"), o.alias("o"), ok.alias("o_kind"), odt.alias("o_dt"), ol.alias("o_lang"), sk.alias("sk")).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND sk <> 1").drop("sk"))
        return reduce(lambda a, b: a.unionByName(b), out).distinct() if out else base.df.limit(0)

    # -- patterns
    def _group(self, g: Group, graph: Any) -> Rel:
        rel: Rel | None = None
        bgp: list[Triple] = []
        for part in [*g.parts, None]:
            if isinstance(part, Bgp):
                bgp += part.triples
                continue
            if bgp:
                rel = self._bgp(bgp, graph, rel)
                bgp = []
            if part is None:
                break
            if isinstance(part, Optional):
                rel = self._left(rel, part.group, graph)
            elif isinstance(part, Minus):
                rel = self._minus(rel or self._unit(), self._group(part.group, graph))
            elif isinstance(part, Graph):
                rel = self._join(rel, self._group(part.group, part.name))
            elif isinstance(part, Union):
                rel = self._join(rel, reduce(union, [self._group(x, graph) for x in part.groups]))
            elif isinstance(part, Values):
                rel = self._join(rel, self._values(part))
            elif isinstance(part, Bind):
                rel = self._bind(rel or self._unit(), part.name, part.expr)
            elif isinstance(part, Query):
                rel = self._join(rel, self._select(part, graph))
            else:
                rel = self._join(rel, self._group(part, graph))
        rel = rel or self._unit()
        for f in g.filters:
            rel = self._filter(rel, f, graph)
        return rel

    def _unit(self) -> Rel:
        return Rel(self.store.spark.range(1).select(F.lit(1).alias("_unit")).select(), {})

    def _values(self, v: Values) -> Rel:
        """An inline table. Columns of one kind keep it; others hold any term. UNDEF is unbound."""
        spark, columns, info, schema = self.store.spark, [], {}, []
        rows = [[] for _ in v.rows]
        for i, n in enumerate(v.names):
            terms = [r[i] for r in v.rows]
            held = [t for t in terms if t]
            undef = len(held) < len(terms)
            if all(t.kind == 0 for t in held):
                info[n] = Info("iri", maybe_null=undef)
                schema.append(f"`{n}` string")
                for row, t in zip(rows, terms, strict=True):
                    row.append(t and t.text)
            else:
                info[n] = Info("any", maybe_null=undef)
                schema += [f"`{n}` string", *(f"`{n}__{p}` {'string' if p in 'tb' else k}" for p, k in PARTS.items())]
                for row, t in zip(rows, terms, strict=True):
                    number = _float(t.text) if t and t.datatype and t.datatype.removeprefix(XSD) in ("integer", "decimal", "double", "float", "int", "long", "gYear") else None
                    stamp = t.text if t and t.datatype in (XSD + "date", XSD + "dateTime") else None
                    row += [t and t.text, t and t.kind, t and t.datatype, t and t.lang, number, stamp, t.text if t and t.datatype == XSD + "boolean" else None]
        df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(schema))
        for n in v.names:
            if info[n].kind == "any":
                df = df.withColumns({f"{n}__t": F.col(f"{n}__t").try_cast("timestamp_ntz"), f"{n}__b": F.col(f"{n}__b").try_cast("boolean")})
        columns = [c for n in v.names for c in Rel(df, info).columns(n)]
        return Rel(df.select(*columns), info)

    def _bgp(self, triples: list[Triple], graph: Any, rel: Rel | None = None) -> Rel:
        """Join of patterns with the solutions so far. Subjects' single-valued columns of one table are read in one scan;
        then each next pattern is one that shares a variable with those before, so that patterns that only meet through
        what stands before them are no cross product: those with a variable that is surely bound first, then those with
        constants. Paths come when an end of theirs is bound, if one ever is."""
        known: dict[str, str] = {}
        if rel is not None:
            _learn(known, rel)
        rels: list[tuple[int, Rel | Triple, set[str]]] = [(c, r, set(r.info)) for c, r in self._stars([t for t in triples if not isinstance(t.p, Path)], graph, known)]
        rels += [(0, t, {x.name for x in (t.s, t.o) if isinstance(x, Var)}) for t in triples if isinstance(t.p, Path)]
        rels.sort(key=lambda x: (isinstance(x[1], Triple), -x[0], len(x[2])))

        def after(x: tuple[int, Rel | Triple, set[str]]) -> tuple:
            shared = x[2] & set(rel.info)
            return (not shared and bool(rel.info), not any(not rel.info[n].maybe_null for n in shared))

        while rels:
            at = 0 if rel is None else min(range(len(rels)), key=lambda i: (after(rels[i]), i))
            part = rels.pop(at)[1]
            rel = self._join(rel, self._path(part, graph, rel) if isinstance(part, Triple) else part)
        return rel

    def _stars(self, triples: list[Triple], graph: Any, known: dict[str, str]) -> list[tuple[int, Rel]]:
        """Relations for the patterns, each with the number of constants in it. ``known``: templates of variables."""
        out, left = [], list(triples)
        name = graph.text if isinstance(graph, Term) else None
        if not isinstance(graph, Var):
            by: dict[str, list[Triple]] = {}
            for t in triples:
                if isinstance(t.s, Var) and isinstance(t.p, str):
                    by.setdefault(t.s.name, []).append(t)
            todo = list(by.items())
            while todo:
                # subjects whose template is known come first: it may tell tables apart
                todo.sort(key=lambda x: x[0] not in known)
                subject, group = todo.pop(0)
                types = [t.o.text for t in group if t.p == TYPE and isinstance(t.o, Term)]
                valued = [t for t in group if t.p != TYPE]
                names = [t.p for t in valued]
                # A repeated predicate or a variable used twice needs a join of its own.
                if len(set(names)) < len(names) or len(group) < 2:
                    continue
                got = self.store.star(name, names, types, known.get(subject))
                if got is None:
                    continue
                rel = Rel(got.df.withColumnRenamed("s", f"{subject}"), {subject: got.info["s"]})
                constants = len(types)
                for i, t in enumerate(valued):
                    rel.info[f"o{i}"] = got.info[f"o{i}"]
                for i, t in enumerate(valued):
                    rel, c = self._placed(rel, f"o{i}", t.o)
                    constants += c
                _learn(known, rel)
                out.append((constants, rel))
                for t in [*valued, *(t for t in group if t.p == TYPE and isinstance(t.o, Term))]:
                    left.remove(t)
        while left:
            t = min(left, key=lambda t: (not (isinstance(t.s, Var) and t.s.name in known), self.store.holders(name, t.p if isinstance(t.p, str) else None), left.index(t)))
            left.remove(t)
            rel = self._pattern(t, graph, known)
            out.append((sum(isinstance(x, Term) for x in (t.s, t.o)), rel))
            _learn(known, rel)
        return out

    def _placed(self, rel: Rel, column: str, place: Any) -> tuple[Rel, int]:
        """The column as a variable, or compared with a constant and dropped."""
        if isinstance(place, Var):
            n = place.name
            if n in rel.info and n != column:
                rel = Rel(rel.df.where(_equal(rel, column, n)).drop(*rel.columns(column)), {k: v for k, v in rel.info.items() if k != column})
                return rel, 0
            moved = {c: n + c[len(column) :] for c in rel.columns(column)}
            return Rel(rel.df.withColumnsRenamed(moved), {(n if k == column else k): v for k, v in rel.info.items()}), 0
        term = Term(0, place) if isinstance(place, str) else place
        rel2 = Rel(rel.df.where(_is_term(rel, column, term)).drop(*rel.columns(column)), {k: v for k, v in rel.info.items() if k != column})
        return rel2, 1

    def _pattern(self, t: Triple, graph: Any, known: dict[str, str] | None = None) -> Rel:
        name = graph.text if isinstance(graph, Term) else None
        template = (known or {}).get(t.s.name) if isinstance(t.s, Var) else None
        predicate = t.p if isinstance(t.p, str) else t.p.text if isinstance(t.p, Term) else None
        rel = self.store.scan(name, predicate, {"s": template} if template else None, merge=graph is None and self.merged)
        if "g" in rel.info and not isinstance(graph, Var):
            rel = Rel(rel.df.drop("g"), {k: v for k, v in rel.info.items() if k != "g"})
        tag = self._fresh()
        moved = {c: f"{tag}{c}" for n in rel.info for c in rel.columns(n)}
        rel = Rel(rel.df.withColumnsRenamed(moved), {f"{tag}{n}": v for n, v in rel.info.items()})
        for column, place in (("s", t.s), ("p", t.p), ("o", t.o), ("g", graph)):
            if f"{tag}{column}" in rel.info:
                rel, _ = self._placed(rel, f"{tag}{column}", place)
        return rel

    def _fresh(self) -> str:
        self.fresh += 1
        return f"_{self.fresh}_"

    def _path(self, t: Triple, graph: Any, before: Rel | None = None) -> Rel:
        """The pairs of a path. One without bounds on its length begins at a constant end, or at the nodes that the
        solutions ``before`` have for one, and follows the graph from there only."""
        start, end = (self._ends(x, before) for x in (t.s, t.o))
        rel = self._pairs(t.p, graph, start, end)
        rel, _ = self._placed(rel, "_from", t.s)
        rel, _ = self._placed(rel, "_to", t.o)
        return rel

    def _ends(self, place: Any, before: Rel | None) -> Rel | None:
        """The nodes a path may begin or end at, as ``_at``; None if they are not known."""
        if not isinstance(place, Var):
            term = Term(0, place) if isinstance(place, str) else place
            if term.kind == 1:
                return None
            return Rel(self.store.spark.createDataFrame([(term.text,)], "_at string"), {"_at": Info("iri")})
        if before is None or place.name not in before.info or before.info[place.name].maybe_null:
            return None
        return _distinct(_renamed(before.select([place.name]), {place.name: "_at"}))

    def _pairs(self, path: Any, graph: Any, start: Rel | None = None, end: Rel | None = None) -> Rel:
        """The pairs ``_from``, ``_to`` a path connects: all of them, or at least those from ``start`` to ``end``."""
        a, b = Var("_from"), Var("_to")
        if isinstance(path, str):
            return self._pattern(Triple(a, path, b), graph).select(["_from", "_to"])
        if path.op == "inv":
            got = self._pairs(path.parts[0], graph, end, start)
            return _renamed(got, {"_from": "_to", "_to": "_from"}).select(["_from", "_to"])
        if path.op == "seq":
            rel = self._pairs(path.parts[0], graph, start)
            for i, part in enumerate(path.parts[1:], 2):
                middle = self._fresh() + "m"
                left = _renamed(rel, {"_to": middle})
                met = None if left.info[middle].maybe_null or isinstance(part, str) else _distinct(_renamed(left.select([middle]), {middle: "_at"}))
                rel = self._join(left, _renamed(self._pairs(part, graph, met, end if i == len(path.parts) else None), {"_from": middle})).select(["_from", "_to"])
            return rel
        if path.op == "alt":
            return reduce(union, [self._pairs(p, graph, start, end) for p in path.parts])
        step = self._pairs(path.parts[0], graph)
        x, y = step.info["_from"], step.info["_to"]
        if not (x.kind == y.kind == "iri" and x.template == y.template):
            step = widened(widened(step, "_from"), "_to")
        steps = _distinct(step) if path.op == "opt" else self._closure(step, start, end)
        if path.op == "plus":
            return steps
        ends = start or end
        return _distinct(union(steps, _loops(ends, "_at") if ends else self._nodes(graph)))

    def _nodes(self, graph: Any) -> Rel:
        """Every node of the graph with itself: what a path of no steps connects."""
        name = graph.text if isinstance(graph, Term) else None
        all_ = self.store.scan(name, None, None, merge=graph is None and self.merged)
        all_ = widened(widened(all_, "s"), "o")
        s = _renamed(all_.select(["s"]), {"s": "_from"})
        o = _renamed(all_.select(["o"]), {"o": "_from"})
        return _loops(_distinct(union(s, o)), "_from")

    def _closure(self, step: Rel, start: Rel | None = None, end: Rel | None = None) -> Rel:
        """Pairs connected by one or more steps: the frontier is joined with the steps until nothing new comes.

        It begins at ``start``, or goes back from ``end``, where they are known. Each round's pairs are written to shared
        storage, so plans stay short and survive lost executors; there are as many rounds as the longest way has steps.
        """
        from ..runtime import materialize

        if start is None and end is not None:
            back = self._closure(_renamed(step, {"_from": "_to", "_to": "_from"}).select(["_from", "_to"]), end)
            return _renamed(back, {"_from": "_to", "_to": "_from"}).select(["_from", "_to"])
        if start is not None and (start.info["_at"].kind, start.info["_at"].template) != (step.info["_from"].kind, step.info["_from"].template):
            step = widened(widened(step, "_from"), "_to")
        steps = Rel(materialize(_distinct(step).df, "steps"), step.info)
        first = steps if start is None else self._join(steps, _renamed(start, {"_at": "_from"}), "left_semi").select(["_from", "_to"])
        seen = frontier = Rel(materialize(first.df.select(*steps.df.columns), "path"), steps.info)
        rounds = 0
        while not frontier.df.isEmpty():
            grown = self._join(_renamed(frontier, {"_to": "_mid"}), _renamed(steps, {"_from": "_mid"})).select(["_from", "_to"])
            new = _distinct(grown).df.join(seen.df, ["_from", "_to"], "left_anti")
            frontier = Rel(materialize(new.select(*steps.df.columns), "path"), step.info)
            seen = Rel(seen.df.unionByName(frontier.df), step.info)
            rounds += 1
            if rounds % ROUNDS_A_TABLE == 0:
                seen = Rel(materialize(seen.df, "path"), step.info)
        return seen

    # -- combination
    def _join(self, a: Rel | None, b: Rel, how: str = "inner", condition: Any = None) -> Rel:
        """Join on compatible solutions. Where a shared variable may be unbound it matches anything."""
        if a is None:
            return b
        shared = [n for n in b.info if n in a.info]
        # Rows that have a variable, and rows that lack it, each join in their own way: by equality, or without it.
        for side, other in ((a, b), (b, a)):
            loose = [n for n in shared if side.info[n].maybe_null][:MAX_SPLIT]
            if condition is None and loose and (side is a or how == "inner"):
                parts = _by_bound(side, loose)
                joined = [self._join(x, other, how) if side is a else self._join(other, x) for x in parts]
                return replace(reduce(union, joined), parts=joined)
        for n in shared:
            a, b = _aligned(a, b, n)
        tag = self._fresh()
        right = _renamed(b, {n: f"{tag}{n}" for n in shared})
        on: list[Column] = []
        for n in shared:
            same = _same(a, n, f"{tag}{n}", right)
            for side, x in ((a, n), (right, f"{tag}{n}")):
                if side.info[x].maybe_null:
                    same = same | F.col(x).isNull()
            on.append(same)
        if condition is not None:
            both = Rel(a.df.crossJoin(right.df), {**a.info, **right.info})  # for its schema; never run
            on.append(condition(both, tag, shared))
        on_all = reduce(lambda x, y: x & y, on) if on else None
        df = a.df.join(right.df, on_all, how) if on else a.df.crossJoin(right.df) if how == "inner" else a.df.join(right.df, F.lit(True), how)
        if how in ("left_semi", "left_anti"):
            return Rel(df, a.info)
        info = dict(a.info)
        for n in shared:
            if a.info[n].maybe_null:
                df = df.withColumns({c: F.coalesce(F.col(c), F.col(tag + c)) for c in a.columns(n)})
                info[n] = replace(a.info[n], maybe_null=how == "left" or right.info[f"{tag}{n}"].maybe_null)
            df = df.drop(*[tag + c for c in b.columns(n)])
        for n, i in b.info.items():
            if n not in shared:
                info[n] = i.unbound if how == "left" else i
        return Rel(df, info, product=None if on else (a, b, how))

    def _left(self, rel: Rel | None, group: Group, graph: Any) -> Rel:
        """OPTIONAL: a left join; the group's filters are part of its condition, so they may see both sides."""
        plain = [f for f in group.filters if not any(isinstance(x, Call) and "exists" in x.name for x in walk(f))]
        inner = self._group(Group(group.parts, [f for f in group.filters if f not in plain]), graph)
        if rel is None:
            rel = self._unit()
        if not plain:
            return self._join(rel, inner, "left")

        def condition(both: Rel, tag: str, shared: list[str]) -> Column:  # noqa: ARG001
            return reduce(lambda a, b: a & b, [F.coalesce(truth(evaluate(f, Scope(both, self))), F.lit(False)) for f in plain])

        return self._join(rel, inner, "left", condition)

    def _minus(self, a: Rel, b: Rel) -> Rel:
        """Solutions of ``a`` that no solution of ``b`` agrees with on a shared bound variable; nothing shared, all stay."""
        shared = [n for n in b.info if n in a.info]
        if not shared:
            return a
        kept = []
        others = _by_bound(_distinct(b.select(shared)), [n for n in shared if b.info[n].maybe_null])
        for rows in _by_bound(a, [n for n in shared if a.info[n].maybe_null]):
            for other in others:
                if set(other.info) & set(rows.info):
                    rows = self._join(rows, other, "left_anti")  # noqa: PLW2901
            kept.append(rows)
        return reduce(union, kept)

    def _filter(self, rel: Rel, f: Any, graph: Any) -> Rel:
        if isinstance(f, Call) and f.name == "and":
            return self._filter(self._filter(rel, f.args[0], graph), f.args[1], graph)
        if isinstance(f, Call) and f.name == "not" and isinstance(f.args[0], Call) and f.args[0].name in ("exists", "not exists"):
            flipped = {"exists": "not exists", "not exists": "exists"}[f.args[0].name]
            return self._filter(rel, Call(flipped, [], extra=f.args[0].extra), graph)
        if isinstance(f, Call) and f.name in ("exists", "not exists"):
            inner = self._group(f.extra, graph)
            shared = [n for n in inner.info if n in rel.info]
            how = "left_semi" if f.name == "exists" else "left_anti"
            if not shared:
                found = not inner.df.limit(1).isEmpty()
                return rel if found == (f.name == "exists") else Rel(rel.df.where(F.lit(False)), rel.info)
            return self._join(rel, _distinct(inner.select(shared)), how)
        return Rel(rel.df.where(truth(evaluate(f, Scope(rel, self)))), rel.info)

    def _bind(self, rel: Rel, name: str, expr: Any) -> Rel:
        value = evaluate(expr, Scope(rel, self))
        return value.bound_to(rel, name)

    # -- SELECT
    def _select(self, q: Query, graph: Any) -> Rel:
        rel = self._group(q.where, graph)
        grouped = bool(q.group_by) or any(isinstance(x, Call) and x.name in AGGREGATES for x in walk([e for _, e in q.items or []] + q.having + [e for e, _ in q.order]))
        if grouped:
            rel = self._grouped(q, rel)
        else:
            for name, expr in q.items or []:
                if expr is not None:
                    rel = self._bind(rel, name, expr)
        return self._modified(q, rel, grouped)

    def _modified(self, q: Query, rel: Rel, grouped: bool = False) -> Rel:  # noqa: ARG002
        names = [n for n in rel.info if not n.startswith("_")] if q.items is None else [n for n, _ in q.items]
        order = []
        for expr, down in q.order:
            value = evaluate(expr, Scope(rel, self))
            order += [c.desc_nulls_last() if down else c.asc_nulls_first() for c in value.order()]
        df, info = rel.df, rel.info
        for n in names:
            if n not in info:
                df, info = df.withColumn(n, F.lit(None).cast("string")), {**info, n: Info("iri", maybe_null=True)}
        rel = Rel(df, info)
        if q.distinct:
            rel = _distinct(rel.select(names))
            if order:
                order = []
                for expr, down in q.order:
                    order += [c.desc_nulls_last() if down else c.asc_nulls_first() for c in evaluate(expr, Scope(rel, self)).order()]
        df = rel.df
        if order:
            df = df.orderBy(*order)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Rel(df, rel.info).select(names)

    def _grouped(self, q: Query, rel: Rel) -> Rel:
        keys: list[str] = []
        for name, expr in q.group_by:
            if expr is not None:
                rel = self._bind(rel, name, expr)
            keys.append(name)
        made: dict[str, tuple[Column, Info | None]] = {}
        calls: dict[str, Call] = {}

        def lifted(e: Any) -> Any:
            """Aggregates inside an expression become variables of the grouped relation."""
            if isinstance(e, Call) and e.name in AGGREGATES:
                name = f"_a{len(made)}"
                made[name], calls[name] = aggregate(e, Scope(rel, self)), e
                return Var(name)
            if isinstance(e, Call):
                return Call(e.name, [lifted(a) for a in e.args], e.distinct, e.extra)
            return e

        items = [(n, lifted(e)) for n, e in q.items or []]
        having = [lifted(h) for h in q.having]
        q.order = [(lifted(e), d) for e, d in q.order]
        columns = [c for k in keys for c in rel.columns(k)]
        aggs = [c.alias(n) for n, (c, _) in made.items()] or [F.count(F.lit(1)).alias("_n")]
        df = factored(rel, keys, calls)
        if df is None:
            df = rel.df.groupBy(*columns).agg(*aggs) if columns else rel.df.agg(*aggs)
        out = Rel(df, {**{k: rel.info[k] for k in keys}, **{n: i or Info("lit", maybe_null=True) for n, (_, i) in made.items()}})
        for h in having:
            out = Rel(out.df.where(truth(evaluate(h, Scope(out, self)))), out.info)
        for n, e in items:
            if e is not None:
                out = self._bind(out, n, e)
        return out


def rows_within(df: DataFrame, seconds: float | None) -> list:
    """The rows of a DataFrame. Its jobs are cancelled after ``seconds``, which raises TimeoutError."""
    if seconds is None:
        return df.collect()
    context, tag, late = df.sparkSession.sparkContext, f"within-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"no answer within {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def _learn(known: dict[str, str], rel: Rel) -> None:
    """Templates that variables are now known to be of."""
    for n, i in rel.info.items():
        if i.kind == "iri" and i.template and not i.maybe_null:
            known.setdefault(n, i.template)


def _float(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _renamed(rel: Rel, names: dict[str, str]) -> Rel:
    moved = {c: names[n] + c[len(n) :] for n in rel.info if n in names for c in rel.columns(n)}
    df = rel.df.select(*[F.col(c).alias(moved.get(c, c)) for n in rel.info for c in rel.columns(n)])
    return Rel(df, {names.get(n, n): i for n, i in rel.info.items()})


def _by_bound(rel: Rel, names: list[str]) -> list[Rel]:
    """The solutions in parts that have the same of ``names`` bound: there they are surely bound, elsewhere left out."""
    parts = [rel]
    for n in names:
        halves = []
        for p in parts:
            halves.append(Rel(p.df.where(F.col(n).isNotNull()), {**p.info, n: replace(p.info[n], maybe_null=False)}))
            halves.append(Rel(p.df.where(F.col(n).isNull()).drop(*p.columns(n)), {k: i for k, i in p.info.items() if k != n}))
        parts = halves
    return parts


def _loops(nodes: Rel, name: str) -> Rel:
    """Each node of a column with itself, as ``_from`` and ``_to``."""
    one = _renamed(nodes, {name: "_from"})
    df = one.df
    for c in one.columns("_from"):
        df = df.withColumn(c.replace("_from", "_to", 1), F.col(c))
    return Rel(df, {"_from": one.info["_from"], "_to": one.info["_from"]})


def _distinct(rel: Rel) -> Rel:
    return Rel(rel.df.distinct(), rel.info)


def _aligned(a: Rel, b: Rel, n: str) -> tuple[Rel, Rel]:
    """A shared variable in forms that compare without loss: keys of one template stay keys."""
    x, y = a.info[n], b.info[n]
    if x.kind == y.kind == "iri":
        if x.template == y.template:
            return a, b
        return tuple(Rel(r.df.withColumn(n, text_of(r.info[n], F.col(n))), {**r.info, n: replace(r.info[n], template=None)}) if r.info[n].template else r for r in (a, b))
    if x.kind == y.kind == "lit" and (dict(a.df.dtypes)[n] == "string") == (dict(b.df.dtypes)[n] == "string"):
        return a, b
    if {x.kind, y.kind} == {"any", "iri"}:
        return tuple(Rel(r.df.withColumn(n, text_of(r.info[n], F.col(n))), {**r.info, n: replace(r.info[n], template=None)}) if r.info[n].template else r for r in (a, b))
    return widened(a, n), widened(b, n)


def _same(a: Rel, n: str, m: str, right: Rel) -> Column:
    x, y = a.info[n], right.info[m]
    same = F.col(n) == F.col(m)
    if x.kind == y.kind == "any":
        return same & (F.col(f"{n}__k") == F.col(f"{m}__k")) & F.col(f"{n}__dt").eqNullSafe(F.col(f"{m}__dt")) & F.col(f"{n}__l").eqNullSafe(F.col(f"{m}__l"))
    if x.kind == "any":
        return same & (F.col(f"{n}__k") != 1)
    if y.kind == "any":
        return same & (F.col(f"{m}__k") != 1)
    return same


def _equal(rel: Rel, a: str, b: str) -> Column:
    x, y = rel.info[a], rel.info[b]
    if x.kind == y.kind == "iri" and x.template == y.template or x.kind == y.kind == "lit":
        return F.col(a) == F.col(b)
    return text_of(x, F.col(a)) == text_of(y, F.col(b))


def _is_term(rel: Rel, column: str, term: Term) -> Column:
    """Whether a column holds exactly the term."""
    info, c = rel.info[column], F.col(column)
    if info.kind == "any":
        same = (c == term.text) & (F.col(f"{column}__k") == term.kind)
        if term.kind == 1:
            same = same & (F.col(f"{column}__dt") == term.datatype) & F.col(f"{column}__l").eqNullSafe(F.lit(term.lang).cast("string"))
        return same
    if info.kind == "iri":
        if term.kind == 1:
            return F.lit(False)
        if info.template is None:
            return c == term.text
        key = key_in(info.template, term.text)
        return F.lit(False) if key is None else c == F.lit(key).try_cast(rel.df.schema[column].dataType.simpleString())
    if term.kind != 1:
        return F.lit(False)
    return c == constant(term)[1]
