"""Two backings of a graph with one face: a quads table, or relational tables read through a mapping."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .turtle import RDF, XSD, Term

TYPE = RDF + "type"
#: Companion columns of a variable of unknown kind: kind, datatype, language, number, time, truth.
PARTS = {"k": "int", "dt": "string", "l": "string", "n": "double", "t": "timestamp_ntz", "b": "boolean"}


@dataclass(frozen=True)
class Info:
    """What is known of a variable's column.

    ``any``: the text of a term, with companion columns ``<name>__k`` and so on. ``iri``: a node; with a ``template``
    the column holds the key that completes it (``http://…/{}``), else the whole IRI. ``lit``: a literal in its own
    SQL type.
    """

    kind: str
    template: str | None = None
    maybe_null: bool = False

    @property
    def unbound(self) -> Info:
        return replace(self, maybe_null=True)


@dataclass
class Rel:
    """Solutions: a DataFrame with a column per variable, NULL where unbound.

    ``parts``: relations this one is the union of. ``product``: two relations without a common variable that it pairs,
    all with all, and how (``inner`` or ``left``). Both only until anything else is done with it.
    """

    df: DataFrame
    info: dict[str, Info] = field(default_factory=dict)
    parts: list[Rel] | None = None
    product: tuple[Rel, Rel, str] | None = None

    def columns(self, name: str) -> list[str]:
        return [name, *(f"{name}__{p}" for p in PARTS)] if self.info[name].kind == "any" else [name]

    def select(self, names: list[str]) -> Rel:
        return Rel(self.df.select(*[c for n in names for c in self.columns(n)]), {n: self.info[n] for n in names})


def text_of(info: Info, column: Column) -> Column:
    """The term's text: an IRI in full, a literal's lexical form."""
    if info.kind == "iri" and info.template is not None:
        head, _, tail = info.template.partition("{}")
        return F.concat(F.lit(head), column.cast("string"), F.lit(tail))
    return column if info.kind in ("any", "iri") else lexical(column)


def lexical(column: Column) -> Column:
    return column.cast("string")


def key_in(template: str, iri: str) -> str | None:
    """The key that completes a template to an IRI, if one does."""
    head, _, tail = template.partition("{}")
    return iri[len(head) : len(iri) - len(tail)] if iri.startswith(head) and iri.endswith(tail) and len(iri) > len(head) + len(tail) else None


#: SQL types and the datatypes their values stand for.
_DATATYPES = {"bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "double": "double", "float": "float", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "boolean": "boolean", "string": "string"}


def datatype_of(sql: str) -> str:
    return XSD + ("decimal" if sql.startswith("decimal") else _DATATYPES.get(sql, "string"))


def widened(rel: Rel, name: str) -> Rel:
    """The variable as kind ``any``, its companions made from what it was."""
    info = rel.info[name]
    if info.kind == "any":
        return rel
    c, df = F.col(name), rel.df
    if info.kind == "iri":
        text = text_of(info, c)
        parts = {"k": F.when(c.isNull(), None).when(F.startswith(text, F.lit("_:")), 2).otherwise(0), "dt": None, "l": None, "n": None, "t": None, "b": None}
    else:
        sql = dict(df.dtypes)[name]
        number = sql.startswith("decimal") or _DATATYPES.get(sql) in ("integer", "double", "float")
        text = lexical(c)
        parts = {"k": F.when(c.isNotNull(), 1), "dt": F.when(c.isNotNull(), datatype_of(sql)), "l": None, "n": c if number else None, "t": c if sql in ("date", "timestamp", "timestamp_ntz") else None, "b": c if sql == "boolean" else None}
    made = {f"{name}__{p}": F.lit(None).cast(PARTS[p]) if v is None else v.cast(PARTS[p]) for p, v in parts.items()}
    return Rel(df.withColumns({**made, name: text}), {**rel.info, name: replace(info, kind="any", template=None)})


class QuadStore:
    """A DataFrame of typed quads. Filters on graph and predicate prune partitions of the stored layout."""

    def __init__(self, quads: DataFrame) -> None:
        self.quads, self.spark = quads, quads.sparkSession

    def holders(self, graph: str | None, predicate: str | None) -> int:  # noqa: ARG002
        return 1

    def graphs(self) -> list[str]:
        return sorted(r["g"] for r in self.quads.select("g").distinct().collect() if r["g"] is not None)

    def scan(self, graph: str | None, predicate: str | None, types: dict[str, str] | None = None, merge: bool = False) -> Rel:  # noqa: ARG002
        """Columns ``s``, ``o``, and ``p`` and ``g`` unless given. ``merge``: the union of all graphs as one set."""
        q = self.quads
        if graph is not None:
            q = q.where(F.col("g") == graph)
        if predicate is not None:
            q = q.where(F.col("p") == predicate)
        o = {"o": "o", "o__k": "o_kind", "o__dt": "o_dt", "o__l": "o_lang", "o__n": "o_num", "o__t": "o_ts", "o__b": "o_bool"}
        keep = ["s", *([] if predicate is not None else ["p"]), *([] if graph is not None else ["g"])]
        df = q.select(*keep, *[F.col(c).alias(a) for a, c in o.items()])
        if merge:
            df = df.drop("g").dropDuplicates([c for c in ("s", "p", "o", "o__k", "o__dt", "o__l") if c in df.columns])
            keep = [c for c in keep if c != "g"]
        return Rel(df, {**{c: Info("iri") for c in keep}, "o": Info("any")})

    def star(self, graph: str | None, predicates: list[str], types: list[str], template: str | None = None) -> None:  # noqa: ARG002
        """Quads hold one predicate a row: nothing to read at once."""
        return None


@dataclass(frozen=True)
class Property:
    """A column read as a property of a table's class; ``target`` is the template of the nodes it points at."""

    iri: str
    column: str
    target: str | None = None


@dataclass
class Entity:
    """A table read as a class: ``key`` completes ``template``. ``unique``: no key repeats."""

    graph: str
    cls: str
    table: DataFrame
    key: str
    template: str
    properties: list[Property]
    unique: bool = True
    where: str | None = None

    @property
    def rows(self) -> DataFrame:
        return self.table.where(self.where) if self.where else self.table


class MappedStore:
    """Relational tables as a graph. Patterns become column reads; keys stay in their SQL type until they are shown.

    Different templates must make different IRIs: a variable known to be of one is looked for in no other's tables.
    """

    def __init__(self, entities: list[Entity]) -> None:
        self.entities = entities
        self.spark = entities[0].table.sparkSession

    def graphs(self) -> list[str]:
        return sorted({e.graph for e in self.entities})

    def _fitting(self, graph: str | None, template: str | None) -> list[Entity]:
        return [e for e in self.entities if graph in (None, e.graph) and template in (None, e.template)]

    def scan(self, graph: str | None, predicate: str | None, types: dict[str, str] | None = None, merge: bool = False) -> Rel:
        """As :meth:`QuadStore.scan`; ``types`` has the template the subject is known to have."""
        parts: list[Rel] = []
        for e in self._fitting(graph, (types or {}).get("s")):
            for p in [Property(TYPE, ""), *e.properties]:
                if predicate not in (None, p.iri):
                    continue
                if p.column:
                    rows = e.rows.select(F.col(e.key).alias("s"), F.col(p.column).alias("o")).where("s IS NOT NULL AND o IS NOT NULL")
                    o = Info("iri", p.target) if p.target else Info("lit")
                else:
                    rows = e.rows.select(F.col(e.key).alias("s"), F.lit(e.cls).alias("o")).where("s IS NOT NULL")
                    o = Info("iri")
                info = {"s": Info("iri", e.template), "o": o}
                if predicate is None:
                    rows, info = rows.withColumn("p", F.lit(p.iri)), {**info, "p": Info("iri")}
                if graph is None:
                    rows, info = rows.withColumn("g", F.lit(e.graph)), {**info, "g": Info("iri")}
                if not e.unique or not p.column:
                    rows = rows.distinct() if not e.unique else rows
                parts.append(Rel(rows, info))
        if not parts:
            empty = self.spark.createDataFrame([], "s string, o string, p string, g string")
            keep = ["s", "o", *([] if predicate is not None else ["p"]), *([] if graph is not None else ["g"])]
            return Rel(empty.select(*keep), {k: Info("iri") for k in keep})
        rel = parts[0] if len(parts) == 1 else reduce(union, parts)
        if merge and "g" in rel.info:
            rel = Rel(rel.df.drop("g").distinct() if len(parts) > 1 else rel.df.drop("g"), {k: v for k, v in rel.info.items() if k != "g"})
        return rel

    def holders(self, graph: str | None, predicate: str | None) -> int:
        """How many tables a predicate is read from."""
        return sum(predicate in (None, TYPE) or any(p.iri == predicate for p in e.properties) for e in self._fitting(graph, None))

    def star(self, graph: str | None, predicates: list[str], types: list[str], template: str | None = None) -> Rel | None:
        """All of ``predicates`` of one subject from one scan: columns ``s`` and ``o0``, ``o1``, … Subjects lacking one
        fall out. None unless exactly one table has them all (and the classes ``types``), once per key."""
        fits = [e for e in self._fitting(graph, template) if all(t == e.cls for t in types) and all(any(p.iri == i for p in e.properties) for i in predicates)]
        if len(fits) != 1 or not fits[0].unique:
            return None
        # Other tables may hold some of these predicates for other subjects, but no other holds all of them.
        e = fits[0]
        if not types and any(sum(any(p.iri == i for p in x.properties) for i in predicates) and x.template == e.template for x in self._fitting(graph, None) if x is not e):
            return None
        props = [next(p for p in e.properties if p.iri == i) for i in predicates]
        rows = e.rows.select(F.col(e.key).alias("s"), *[F.col(p.column).alias(f"o{i}") for i, p in enumerate(props)])
        bound = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in rows.columns])
        return Rel(rows.where(bound), {"s": Info("iri", e.template), **{f"o{i}": Info("iri", p.target) if p.target else Info("lit") for i, p in enumerate(props)}})

    def quads(self) -> DataFrame:
        """The graph written out as typed quads."""
        from .quads import typed

        rel = widened(self.scan(None, None), "o")
        text = {n: text_of(rel.info[n], F.col(n)) for n in ("s", "p", "g")}
        stamp = F.when(F.col("o__dt") == XSD + "dateTime", F.replace(F.col("o"), F.lit(" "), F.lit("T"))).otherwise(F.col("o"))
        return typed(rel.df.select(text["g"].alias("g"), text["s"].alias("s"), text["p"].alias("p"), stamp.alias("o"), F.col("o__k").alias("o_kind"), F.col("o__dt").alias("o_dt"), F.col("o__l").alias("o_lang")).distinct())


def union(a: Rel, b: Rel) -> Rel:
    """All solutions of both; variables one lacks are unbound there."""
    names = list(dict.fromkeys([*a.info, *b.info]))
    for n in names:
        if n in a.info and n in b.info:
            x, y = a.info[n], b.info[n]
            same = (x.kind, x.template) == (y.kind, y.template) and (x.kind == "any" or dict(a.df.dtypes)[n] == dict(b.df.dtypes)[n])
            if not same:
                if x.kind == y.kind == "iri":
                    a = Rel(a.df.withColumn(n, text_of(x, F.col(n))), {**a.info, n: replace(x, template=None)})
                    b = Rel(b.df.withColumn(n, text_of(y, F.col(n))), {**b.info, n: replace(y, template=None)})
                else:
                    a, b = widened(a, n), widened(b, n)
    info = {n: (a.info.get(n) or b.info[n]) if n in a.info and n in b.info and not (a.info[n].maybe_null or b.info[n].maybe_null) else (a.info.get(n) or b.info[n]).unbound for n in names}
    return Rel(a.df.unionByName(b.df, allowMissingColumns=True), info)


def constant(term: Term) -> tuple[Info, Column]:
    """A term as a column."""
    if term.kind != 1:
        return Info("iri"), F.lit(term.text)
    kind = (term.datatype or "").removeprefix(XSD)
    casts = {"integer": "bigint", "int": "bigint", "long": "bigint", "decimal": "decimal(38,10)", "double": "double", "float": "double", "boolean": "boolean", "date": "date", "gYear": "bigint"}
    if kind in casts:
        return Info("lit"), F.lit(term.text).try_cast(casts[kind])
    if kind == "dateTime":
        return Info("lit"), F.lit(term.text.removesuffix("Z")).try_cast("timestamp_ntz")
    return Info("lit"), F.lit(term.text)
