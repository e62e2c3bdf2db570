"""SPARQL expressions as columns. An error is NULL, and a filter that is NULL drops its row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.store import Info, Rel, constant, datatype_of, text_of
from ..sources.turtle import XSD, Term
from .sparql import Call, SparqlError, Var

_NONE = lambda kind: F.lit(None).cast(kind)


@dataclass
class Scope:
    """The relation whose variables an expression sees."""

    rel: Rel
    compiler: Any = None


@dataclass
class Value:
    """A column with what is known of its kind: num, str, bool, time, iri, or any with companions ``parts``."""

    column: Column
    kind: str
    parts: dict[str, Column] | None = None
    info: Info | None = None
    name: str | None = None
    sql: str | None = None

    def num(self) -> Column:
        return self.column if self.kind == "num" else self.parts["n"] if self.kind == "any" else _NONE("double")

    def time(self) -> Column:
        return self.column if self.kind == "time" else self.parts["t"] if self.kind == "any" else _NONE("timestamp_ntz")

    def text(self) -> Column:
        if self.kind == "iri":
            return text_of(self.info or Info("iri"), self.column)
        return self.column if self.kind in ("str", "any") else self.column.cast("string")

    def string(self) -> Column:
        """The value of a string literal; an error for other terms."""
        if self.kind == "any":
            return F.when(self.parts["k"] == 1, self.column)
        return self.text() if self.kind != "iri" else _NONE("string")

    def bool(self) -> Column:
        if self.kind == "bool":
            return self.column
        if self.kind == "num":
            return self.column != 0
        if self.kind == "str":
            return F.length(self.column) > 0
        if self.kind == "any":
            return F.coalesce(self.parts["b"], self.parts["n"] != 0, F.when(self.parts["dt"] == XSD + "string", F.length(self.column) > 0))
        return _NONE("boolean")

    def order(self) -> list[Column]:
        """Keys that sort numbers as numbers, times as times, the rest as text."""
        if self.kind == "any":
            return [self.parts["n"], self.parts["t"], self.column]
        return [self.text() if self.kind == "iri" else self.column]

    def bound_to(self, rel: Rel, name: str) -> Rel:
        if self.kind == "any":
            made = {name: self.column, **{f"{name}__{p}": c for p, c in self.parts.items()}}
            return Rel(rel.df.withColumns(made), {**rel.info, name: Info("any", maybe_null=True)})
        if self.kind == "iri":
            info = self.info or Info("iri")
            return Rel(rel.df.withColumn(name, self.column), {**rel.info, name: info.unbound})
        return Rel(rel.df.withColumn(name, self.column), {**rel.info, name: Info("lit", maybe_null=True)})


def truth(v: Value) -> Column:
    return v.bool()


def variable(name: str, scope: Scope) -> Value:
    rel = scope.rel
    if name not in rel.info:
        return Value(_NONE("string"), "str")
    info, c = rel.info[name], F.col(name)
    if info.kind == "any":
        return Value(c, "any", {p: F.col(f"{name}__{p}") for p in ("k", "dt", "l", "n", "t", "b")}, name=name)
    if info.kind == "iri":
        return Value(c, "iri", info=info, name=name)
    sql = dict(rel.df.dtypes).get(name, "string")
    return Value(c, _kind(sql), name=name, sql=sql)


def _kind(sql: str) -> str:
    if sql == "string":
        return "str"
    if sql == "boolean":
        return "bool"
    return "time" if sql in ("date", "timestamp", "timestamp_ntz") else "num"


def evaluate(e: Any, scope: Scope) -> Value:
    if isinstance(e, Var):
        return variable(e.name, scope)
    if isinstance(e, Term):
        _, c = constant(e)
        if e.kind != 1:
            return Value(c, "iri")
        kind = (e.datatype or "").removeprefix(XSD)
        return Value(c, "num" if kind in ("integer", "int", "long", "decimal", "double", "float", "gYear") else "bool" if kind == "boolean" else "time" if kind in ("date", "dateTime") else "str")
    if not isinstance(e, Call):
        raise SparqlError(f"no expression: {e!r}")
    if e.name in ("exists", "not exists"):
        raise SparqlError("EXISTS is read as a filter of its own or joined by &&")
    if e.name == "bound":
        return Value(F.col(e.args[0].name).isNotNull() if e.args[0].name in scope.rel.info else F.lit(False), "bool")
    if e.name == "cast":
        return _cast(evaluate(e.args[0], scope), e.args[1])
    args = [evaluate(a, scope) for a in e.args]
    if e.name in _FUNCTIONS:
        return _FUNCTIONS[e.name](*args)
    raise SparqlError(f"unknown function {e.name!r}")


def _cast(v: Value, kind: str) -> Value:
    sql, of = {"integer": ("bigint", "num"), "int": ("bigint", "num"), "decimal": ("decimal(38,10)", "num"), "double": ("double", "num"), "float": ("double", "num"), "string": ("string", "str"), "boolean": ("boolean", "bool"), "date": ("date", "time"), "dateTime": ("timestamp_ntz", "time")}.get(kind.removeprefix(XSD), (None, None))
    if sql is None:
        raise SparqlError(f"unknown cast {kind!r}")
    if v.kind == "num" and of == "num":
        return Value(v.column.cast(sql), of)
    return Value(v.text().try_cast(sql) if sql != "string" else v.text(), of)


def compare(a: Value, b: Value, op: str) -> Column:
    """Comparison by value. Numbers with numbers, times with times, texts with texts; other pairs are errors, but for
    (in)equality, where terms of different kinds differ."""
    ops = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    f, kinds = ops[op], {a.kind, b.kind}
    if "num" in kinds:
        return f(a.num(), b.num())
    if "time" in kinds:
        return f(a.time(), b.time())
    if "bool" in kinds:
        x = [v.column if v.kind == "bool" else v.parts["b"] if v.kind == "any" else _NONE("boolean") for v in (a, b)]
        return f(*x)
    if "iri" in kinds:
        if kinds == {"iri", "str"}:
            return F.lit(op == "!=") if op in ("=", "!=") else _NONE("boolean")
        if a.kind == b.kind == "iri" and a.info and b.info and a.info.template == b.info.template:
            return f(a.column, b.column)
        node = [v.parts["k"] != 1 for v in (a, b) if v.kind == "any"]
        same = a.text() == b.text()
        for n in node:
            same = same & n
        return same if op == "=" else ~same if op == "!=" else f(a.text(), b.text())
    if "any" not in kinds:
        return f(a.column, b.column)
    if kinds == {"any"}:
        both = (a.parts["k"] == 1) & (b.parts["k"] == 1)
        value = F.coalesce(f(a.num(), b.num()), f(a.time(), b.time()), F.when(both & (a.parts["dt"] == b.parts["dt"]) & a.parts["l"].eqNullSafe(b.parts["l"]), f(a.column, b.column)))
        if op in ("=", "!="):
            nodes = F.when((a.parts["k"] != 1) | (b.parts["k"] != 1), F.lit(op == "=") == ((a.column == b.column) & (a.parts["k"] == b.parts["k"])))
            return F.coalesce(nodes, value)
        return value
    v, s = (a, b) if a.kind == "any" else (b, a)
    plain = (v.parts["k"] == 1) & (v.parts["dt"].isin(XSD + "string"))
    if op in ("=", "!="):
        return F.when(v.column.isNotNull(), (plain & (v.column == s.column)) == F.lit(op == "="))
    return F.when(plain, f(a.column, b.column))


def _arithmetic(op: str):  # noqa: ANN202
    def apply(a: Value, b: Value) -> Value:
        x, y = a.num(), b.num()
        return Value({"+": lambda: F.try_add(x, y), "-": lambda: F.try_subtract(x, y), "*": lambda: F.try_multiply(x, y), "/": lambda: F.try_divide(x, y)}[op](), "num")

    return apply


def _datatype(v: Value) -> Value:
    if v.kind == "any":
        return Value(F.when(v.parts["k"] == 1, v.parts["dt"]), "iri")
    if v.kind == "iri":
        return Value(_NONE("string"), "iri")
    return Value(F.lit(datatype_of(v.sql)) if v.sql else F.lit({"num": XSD + "decimal", "str": XSD + "string", "bool": XSD + "boolean", "time": XSD + "dateTime"}[v.kind]), "iri")


def _kind_is(v: Value, kind: int) -> Value:
    if v.kind == "any":
        return Value(v.parts["k"] == kind, "bool")
    if v.kind == "iri":
        blank = F.startswith(v.text(), F.lit("_:"))
        return Value({0: ~blank, 1: F.lit(False), 2: blank}[kind], "bool")
    return Value(F.lit(kind == 1), "bool")


def _lang_matches(a: Value, b: Value) -> Value:
    tag, of = F.lower(a.text()), F.lower(b.text())
    return Value(F.when(of == "*", F.length(tag) > 0).otherwise((tag == of) | F.startswith(tag, F.concat(of, F.lit("-")))), "bool")


def _regex(text: Value, pattern: Value, flags: Value | None = None) -> Value:
    p = pattern.text() if flags is None else F.concat(F.lit("(?"), flags.text(), F.lit(")"), pattern.text())
    return Value(F.rlike(text.string(), p), "bool")


def _replace(text: Value, pattern: Value, to: Value, flags: Value | None = None) -> Value:
    p = pattern.text() if flags is None else F.concat(F.lit("(?"), flags.text(), F.lit(")"), pattern.text())
    return Value(F.regexp_replace(text.string(), p, to.text()), "str")


def _coalesce(*vs: Value) -> Value:
    kinds = {v.kind for v in vs}
    if len(kinds) == 1 and vs[0].kind != "any" and (vs[0].kind != "iri" or len({v.info for v in vs}) == 1):
        return Value(F.coalesce(*[v.column for v in vs]), vs[0].kind, info=vs[0].info)
    if kinds <= {"num", "any"} and "num" in kinds:
        return Value(F.coalesce(*[v.num() for v in vs]), "num")
    return Value(F.coalesce(*[v.text() for v in vs]), "str")


def _if(test: Value, yes: Value, no: Value) -> Value:
    t = test.bool()
    pick = lambda a, b: F.when(t, a).when(~t, b)
    if yes.kind == no.kind and yes.kind not in ("any", "iri"):
        return Value(pick(yes.column, no.column), yes.kind)
    if {yes.kind, no.kind} == {"num", "any"}:
        return Value(pick(yes.num(), no.num()), "num")
    return Value(pick(yes.text(), no.text()), "iri" if yes.kind == no.kind == "iri" else "str")


def _text(f):  # noqa: ANN001, ANN202
    return lambda *vs: Value(f(*[v.text() for v in vs]), "str")


def _test(f):  # noqa: ANN001, ANN202
    return lambda *vs: Value(f(vs[0].string(), *[v.text() for v in vs[1:]]), "bool")


def _date_part(f):  # noqa: ANN001, ANN202
    return lambda v: Value(f(v.time()).cast("bigint"), "num")


def _substr(v: Value, start: Value, length: Value | None = None) -> Value:
    return Value(F.substr(v.string(), start.num().cast("int"), length.num().cast("int")) if length else F.substr(v.string(), start.num().cast("int")), "str")


_FUNCTIONS = {
    "or": lambda a, b: Value(a.bool() | b.bool(), "bool"),
    "and": lambda a, b: Value(a.bool() & b.bool(), "bool"),
    "not": lambda a: Value(~a.bool(), "bool"),
    "in": lambda a, *bs: Value(reduce(lambda x, y: x | y, [compare(a, b, "=") for b in bs]) if bs else F.lit(False), "bool"),
    **{op: (lambda op: lambda a, b: Value(compare(a, b, op), "bool"))(op) for op in ("=", "!=", "<", "<=", ">", ">=")},
    **{op: _arithmetic(op) for op in "+-*/"},
    "negate": lambda a: Value(-a.num(), "num"),
    "str": lambda v: Value(v.text(), "str"),
    "lang": lambda v: Value(F.when(v.parts["k"] == 1, F.coalesce(v.parts["l"], F.lit(""))) if v.kind == "any" else _NONE("string") if v.kind == "iri" else F.lit(""), "str"),
    "langmatches": _lang_matches,
    "datatype": _datatype,
    "isiri": lambda v: _kind_is(v, 0),
    "isuri": lambda v: _kind_is(v, 0),
    "isliteral": lambda v: _kind_is(v, 1),
    "isblank": lambda v: _kind_is(v, 2),
    "isnumeric": lambda v: Value(v.num().isNotNull() if v.kind == "any" else F.lit(v.kind == "num"), "bool"),
    "sameterm": lambda a, b: Value(compare(a, b, "="), "bool"),
    "iri": lambda v: Value(v.text(), "iri"),
    "uri": lambda v: Value(v.text(), "iri"),
    "strlen": lambda v: Value(F.length(v.string()).cast("bigint"), "num"),
    "ucase": lambda v: Value(F.upper(v.string()), "str"),
    "lcase": lambda v: Value(F.lower(v.string()), "str"),
    "substr": _substr,
    "contains": _test(F.contains),
    "strstarts": _test(F.startswith),
    "strends": _test(F.endswith),
    "strbefore": lambda a, b: Value(F.when(F.contains(a.string(), b.text()), F.element_at(F.split(a.string(), F.concat(F.lit("\\Q"), b.text(), F.lit("\\E")), 2), 1)).otherwise(F.when(a.string().isNotNull(), F.lit(""))), "str"),
    "strafter": lambda a, b: Value(F.coalesce(F.try_element_at(F.split(a.string(), F.concat(F.lit("\\Q"), b.text(), F.lit("\\E")), 2), F.lit(2)), F.lit("")), "str"),
    "concat": _text(F.concat),
    "regex": _regex,
    "replace": _replace,
    "encode_for_uri": lambda v: Value(F.replace(F.url_encode(v.string()), F.lit("+"), F.lit("%20")), "str"),
    "abs": lambda v: Value(F.abs(v.num()), "num"),
    "ceil": lambda v: Value(F.ceil(v.num()), "num"),
    "floor": lambda v: Value(F.floor(v.num()), "num"),
    "round": lambda v: Value(F.floor(v.num() + 0.5), "num"),
    "year": _date_part(F.year),
    "month": _date_part(F.month),
    "day": _date_part(F.dayofmonth),
    "hours": _date_part(F.hour),
    "minutes": _date_part(F.minute),
    "seconds": _date_part(F.second),
    "coalesce": _coalesce,
    "if": _if,
    "md5": _text(F.md5),
    "sha1": _text(F.sha1),
    "sha256": _text(lambda c: F.sha2(c, 256)),
}


def aggregate(e: Call, scope: Scope) -> tuple[Column, Info | None]:
    """An aggregate as a column, and the kind of its result where it isn't a plain literal.

    Errors and unbound values are left out. SUM and AVG of nothing are unbound here, so that "no rows" and "adds up
    to zero" stay apart; COUNT of nothing is 0.
    """
    if e.args == ["*"]:
        columns = [c for n in scope.rel.info for c in scope.rel.columns(n)]
        return (F.count_distinct(F.struct(*columns)) if e.distinct else F.count(F.lit(1))), None
    v = evaluate(e.args[0], scope)
    if e.name == "count":
        if not e.distinct:
            return F.count(v.column), None
        parts = [v.column] if v.kind != "any" else [v.column, v.parts["k"], F.coalesce(v.parts["dt"], F.lit("")), F.coalesce(v.parts["l"], F.lit(""))]
        return F.count_distinct(*parts), None
    if e.name in ("sum", "avg"):
        exact = v.num()
        return {("sum", False): F.sum, ("sum", True): F.sum_distinct, ("avg", False): F.avg, ("avg", True): lambda c: F.sum_distinct(c) / F.count_distinct(c)}[e.name, e.distinct](exact), None
    if e.name == "group_concat":
        # In order, so that results repeat.
        texts = F.sort_array((F.collect_set if e.distinct else F.collect_list)(v.text()))
        return F.when(F.size(texts) > 0, F.array_join(texts, " " if e.extra is None else e.extra)), None
    pick = F.max if e.name == "max" else F.min  # SAMPLE: the least, so that results repeat
    if v.kind == "any":
        if e.name == "sample":
            return F.min(v.column), None
        by = F.max_by if e.name == "max" else F.min_by
        return F.coalesce(by(v.column, v.num()), by(v.column, v.time()), pick(v.column)), None
    if v.kind == "iri":
        return pick(v.column), (v.info or Info("iri")).unbound
    return pick(v.column), None

