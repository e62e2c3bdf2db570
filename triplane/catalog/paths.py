"""Ways from one class to another, and slices of a schema that fit a budget."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from ..functions.text import approx_tokens
from ..plans.plan import Step
from ..sources.turtle import XSD
from .cards import Catalog, PropertyCard

# Datatypes of numbers and of times.
NUMBERS = {XSD + t for t in ("integer", "int", "long", "short", "decimal", "double", "float", "nonNegativeInteger", "positiveInteger", "gYear")}
TIMES = {XSD + t for t in ("date", "dateTime", "gYear", "gYearMonth")}


@dataclass(frozen=True)
class Edge:
    """One hop between classes: ``kind`` object, inverse, join (two steps over a shared identifier) or attribute."""

    steps: tuple[Step, ...]
    src: str
    dst: str | None
    kind: str
    prop: str
    datatype: str | None = None


@dataclass(frozen=True)
class SchemaPath:
    edges: tuple[Edge, ...]

    @property
    def steps(self) -> tuple[Step, ...]:
        return tuple(s for e in self.edges for s in e.steps)

    @property
    def datatype(self) -> str | None:
        return self.edges[-1].datatype

    @property
    def temporal(self) -> bool:
        return self.datatype in TIMES - NUMBERS

    def describe(self, cat: Catalog) -> str:
        """In words: every hop with the labels of what it joins."""
        said = [cat.label(self.edges[0].src)]
        for e in self.edges:
            arrow = {"inverse": f"<- {cat.label(e.prop)} -", "join": f"= {cat.label(e.prop)} ="}.get(e.kind, f"- {cat.label(e.prop)} ->")
            said += [arrow, cat.label(e.dst) if e.dst else "value"]
        return " ".join(said)


class SchemaGraph:
    def __init__(self, cat: Catalog) -> None:
        self.cat = cat

    def _domains(self, p: PropertyCard) -> list[str]:
        return [d for d in p.domains if d in self.cat.classes]

    def edges(self, cls: str) -> list[Edge]:
        """All hops from a class; inherited properties included."""
        cat, out = self.cat, []
        for p in cat.properties_of(cls):
            module = cat.module_for(p.iri, cls)
            if p.kind == "literal":
                out.append(Edge((Step(p.iri, False, module),), cls, None, "attribute", p.iri, p.datatype or XSD + "string"))
                for j in cat.joins:
                    if p.iri in (j.a, j.b):
                        other = cat.properties[j.b if p.iri == j.a else j.a]
                        out += [Edge((Step(p.iri, False, module), Step(other.iri, True, other.module)), cls, d, "join", p.iri) for d in self._domains(other)]
            else:
                out += [Edge((Step(p.iri, False, module),), cls, r, "object", p.iri) for r in p.ranges if r in cat.classes]
        for p in cat.incoming(cls):
            out += [Edge((Step(p.iri, True, cat.module_for(p.iri, d)),), cls, d, "inverse", p.iri) for d in self._domains(p)]
        return out

    def compatible(self, a: str, b: str) -> bool:
        return self.cat.is_a(a, b) or self.cat.is_a(b, a)

    def paths_between(self, src: str, dst: str, most: int = 3) -> list[SchemaPath]:
        """All ways of at most ``most`` hops without a class twice, ending at the first compatible class; short ones first."""
        out, todo = [], deque([((), src, (src,))])
        while todo:
            edges, at, seen = todo.popleft()
            for e in self.edges(at):
                back = edges and e.prop == edges[-1].prop and {e.kind, edges[-1].kind} == {"object", "inverse"}
                if e.dst is None or e.dst in seen or back:
                    continue
                path = (*edges, e)
                if self.compatible(e.dst, dst):
                    out.append(SchemaPath(path))
                elif len(path) < most:
                    todo.append((path, e.dst, (*seen, e.dst)))
        return sorted(out, key=lambda p: len(p.edges))

    def value_paths(self, src: str, most: int = 3, want: str | None = None) -> list[SchemaPath]:
        """Ways to attributes: any, or only ``numeric`` or ``temporal`` ones; short ones first."""
        allowed = {"numeric": NUMBERS, "temporal": TIMES}.get(want)
        out, todo = [], deque([((), src, (src,))])
        while todo:
            edges, at, seen = todo.popleft()
            for e in self.edges(at):
                if e.dst is None:
                    if allowed is None or e.datatype in allowed:
                        out.append(SchemaPath((*edges, e)))
                elif e.dst not in seen and len(edges) + 1 < most:
                    todo.append(((*edges, e), e.dst, (*seen, e.dst)))
        return sorted(out, key=lambda p: len(p.edges))


class Slicer:
    """Text of the part of a schema around some classes, within a budget of tokens."""

    def __init__(self, cat: Catalog) -> None:
        self.cat, self.graph = cat, SchemaGraph(cat)

    def card(self, cls: str, detail: int = 2) -> str:
        """A class in text: its label and properties; with less ``detail``, fewer of them."""
        c = self.cat.classes[cls]
        props = self.cat.properties_of(cls)[: (4, 12, 1000)[detail]]
        lines = [f"{c.label} <{cls}> ({self.cat.instance_count(cls)})" + (f": {c.comment}" if c.comment and detail == 2 else "")]
        for p in props:
            to = ", ".join(self.cat.label(r) for r in p.ranges) if p.kind == "object" else p.datatype or "text"
            lines.append(f"  {p.label} <{p.iri}> -> {to}" + (f" e.g. {'; '.join(p.samples[:2])}" if detail == 2 and p.samples else ""))
        return "\n".join(lines)

    def neighbourhood(self, seeds: list[str], hops: int) -> list[str]:
        seen = dict.fromkeys(s for s in seeds if s in self.cat.classes)
        edge = list(seen)
        for _ in range(hops):
            edge = [e.dst for c in edge for e in self.graph.edges(c) if e.dst and e.dst not in seen]
            seen.update(dict.fromkeys(edge))
        return list(seen)

    def slice(self, seeds: list[str], budget: int = 1500) -> tuple[str, set[str]]:
        """The text, and the IRIs that may be used with it. The widest neighbourhood in the fullest detail that fits; else
        as many whole lines of the seeds in the least detail as fit; what the seeds have may be used all the same."""
        for hops, detail in ((2, 2), (1, 2), (1, 1), (0, 1)):
            classes = self.neighbourhood(seeds, hops)
            text = "\n".join(self.card(c, detail) for c in classes)
            if approx_tokens(text) <= budget:
                return text, self.allowed(classes)
        lines: list[str] = []
        seeds = self.neighbourhood(seeds, 0)
        for line in (line for c in seeds for line in self.card(c, 0).split("\n")):
            if approx_tokens("\n".join([*lines, line])) > budget:
                break
            lines.append(line)
        return "\n".join(lines), self.allowed(seeds)

    def allowed(self, classes: list[str]) -> set[str]:
        props = {p.iri for c in classes for p in [*self.cat.properties_of(c), *self.cat.incoming(c)]}
        joined = {x for j in self.cat.joins for x in (j.a, j.b) if {j.a, j.b} & props}
        return {*classes, *(d for c in classes for d in self.cat.descendants(c)), *props, *joined}

    def overview(self) -> str:
        return "\n".join(f"{g}: {m['triples']} statements; " + ", ".join(self.cat.label(c) for c in m["classes"][:8]) for g, m in self.cat.modules.items())

