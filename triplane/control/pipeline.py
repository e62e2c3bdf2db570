"""Questions answered: link names, choose a shape and paths, compile, run, verify, repair, or fall back."""

from __future__ import annotations

import json
import math
import re
import time
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import functions as F

from ..catalog.cards import Catalog
from ..catalog.paths import SchemaGraph, SchemaPath, Slicer
from ..functions.literals import Found, extract_literals
from ..functions.terms import local_name
from ..functions.text import normalize, split_camel, stem, stems
from ..linking.index import EntityIndex
from ..operators.retrieval import B, K1
from ..plans.algebra import Compiler, rows_within
from ..plans.plan import Filter, Link, Literal, PlanCompiler, PlanError, QueryPlan, read
from ..plans.sparql import AGGREGATES, Bgp, Call, Query, SparqlError, Triple, Var, check_syntax, parse, used_iris, walk
from ..runtime import write_text
from .decisions import Choice, Controller, LexicalController, choose_among_many
from .models import ModelUnavailable
from .verify import Verifier, explain

# The least confidence to go on, the least chance of a repair, and how often one is tried.
GATES = {"class": 0.35, "entity": 0.5, "plan": 0.35, "module": 0.35}
# Nodes offered for a name, the score from which a lone node is taken as it is, the chance that a word is no
# name (written with a capital; a word of the schema or with weak nodes only; else), routes kept and the least chance of one.
MOST_NODES, SCORE_SURE = 8, 0.9
NO_NAME = {"capital": 0.15, "word": 0.8, "plain": 0.3}
BEAM, BEAM_LEAST = 3, 0.1
#: What a reply is cut to.
MOST_VALUES = 10_000
REPAIR_LEAST, MAX_REPAIRS = 0.02, 2
# Words that give a shape, an aggregate, an order or a comparison away.
CUES = {
    "aggregate": {"average": "avg", "mean": "avg", "total": "sum", "sum": "sum", "maximum": "max", "minimum": "min", "highest": "max", "lowest": "min"},
    "most": ("most", "largest", "biggest", "highest", "latest", "newest", "longest", "strongest", "fastest", "last"),
    "least": ("least", "smallest", "lowest", "earliest", "oldest", "shortest", "cheapest", "slowest", "first", "fewest"),
    "ge": ("at least", "no less than", "from", "since"),
    "le": ("at most", "no more than", "up to", "until"),
    "gt": ("more than", "over", "above", "after", "greater than", "exceeds", "exceeding", "more expensive than", "later than"),
    "lt": ("less than", "under", "below", "before", "fewer than", "cheaper than", "earlier than"),
}
OPENERS = ("is", "are", "was", "were", "does", "do", "did", "has", "have", "can")


class TextModel(Protocol):
    """A language model: text in, text out. None by default."""

    def complete(self, prompt: str) -> str: ...


@dataclass
class Mention:
    """A name in a question and the node it was linked to."""

    text: str
    start: int
    end: int
    iri: str
    label: str
    types: list[str]
    value_of: str | None
    score: float
    candidates: list[dict] = field(default_factory=list)
    confidence: float = 1.0


@dataclass
class Route:
    """A class a question may be about, its module, and how likely."""

    module: str | None
    cls: str
    chance: float


@dataclass
class Trace:
    """What happened, in order, with times."""

    stages: dict[str, float] = field(default_factory=dict)
    decisions: list[dict] = field(default_factory=list)
    events: list[str] = field(default_factory=list)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.stages[name] = self.stages.get(name, 0.0) + time.perf_counter() - began

    def gate(self, name: str, choice: str, confidence: float, least: float, passed: bool | None = None) -> bool:
        """Note a decision and whether it is sure enough to go on."""
        ok = confidence >= least if passed is None else passed
        self.decisions.append({"name": name, "choice": choice, "confidence": confidence, "threshold": least, "passed": ok})
        return ok

    def json(self) -> str:
        return json.dumps({"stages": self.stages, "decisions": self.decisions, "events": self.events}, ensure_ascii=False, default=str)


@dataclass
class Result:
    question: str
    status: str  # answered, no_data, fallback, unanswered, error
    values: list = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    confidence: float = 0.0
    plan: QueryPlan | None = None
    sparql: str | None = None
    truncated: bool = False
    trace: Trace = field(default_factory=Trace)

    def text(self) -> str:
        return ", ".join(self.labels) if self.labels else self.status


class Pipeline:
    """``store`` answers patterns, ``catalog`` and ``index`` describe it; the controller decides among given options."""

    def __init__(self, store: Any, catalog: Catalog, index: EntityIndex, controller: Controller | None = None, model: TextModel | None = None, queue: str | None = None, prefixes: dict[str, str] | None = None, seconds: float | None = None, arm: str = "C") -> None:
        """``seconds`` bounds each query of a model; ``arm``: A one query of the model over the schema it names, B the
        model with the plan as a hint, C plans compiled."""
        self.store, self.catalog, self.index, self.model, self.queue = store, catalog, index, model, queue
        self.controller = controller or LexicalController()
        self.prefixes, self.seconds, self.arm = prefixes or {}, seconds, arm
        self.graph, self.compiler = SchemaGraph(catalog), PlanCompiler(store)
        self.verifier = Verifier(store, catalog, self.controller, shown, seconds=seconds)

    # -- the whole way
    def ask(self, question: str) -> Result:
        """An answer, whatever happens: errors of one question end in its status."""
        out = Result(question, "unanswered")
        mentions: list[Mention] = []
        try:
            with out.trace.stage("link"):
                mentions = self.disambiguate(question, self.link(question), out.trace)
                literals = extract_literals(question, [(m.start, m.end) for m in mentions])
            if self.arm == "A":
                return self.fall_back(question, out, mentions, attempts=1)
            if self.unsupported(question):
                out.trace.events.append("no shape fits: the model writes the query")
                return self.fall_back(question, out, mentions)
            with out.trace.stage("plan"):
                plans = self.plans(question, mentions, literals, out.trace)
            if self.arm == "B":
                return self.fall_back(question, out, mentions, hint=plans[0] if plans else None)
            skip: set[str] = set()
            tried = 0
            for plan in plans:
                if tried > MAX_REPAIRS or plan.classes and plan.classes[0] in skip:
                    continue
                if not out.trace.gate("plan", plan.shape, plan.confidence, 0.0):
                    continue
                with out.trace.stage("execute"):
                    got = read(self.compiler.compile(plan), MOST_VALUES)
                with out.trace.stage("verify"):
                    verdict = self.verifier.verify(question, plan, got["values"], got["empty"], got["truncated"])
                out.trace.events.append(f"{verdict.action}: {verdict.reason}; {verdict.checks}")
                if verdict.action == "accept" or verdict.action == "no_data" and tried == 0:
                    out.status = "answered" if verdict.action == "accept" else "no_data"
                    out.values, out.plan, out.truncated = got["values"], plan, got["truncated"]
                    # an answer is as sure as the least sure decision behind it
                    out.confidence = min([plan.confidence, verdict.sure, *(m.confidence for m in mentions)])
                    out.labels = self.labels(out.values)
                    if verdict.action == "accept" or plan.shape == "count":
                        return out
                if verdict.action == "next_route" and plan.classes:
                    skip.add(plan.classes[0])
                if verdict.action == "fall_back":
                    break
                tried += 1
            if out.status == "no_data":
                return out
        except (PlanError, SparqlError, ValueError, TimeoutError) as wrong:
            out.status = "error"
            out.trace.events.append(str(wrong))
        return self.fall_back(question, out, mentions)

    # -- links
    def link(self, question: str) -> list[Mention]:
        """Names in the question, the longest first, without overlap; one lookup for all its word groups."""
        words = [(m.start(), m.end()) for m in re.finditer(r"[\w.&'’-]+", question)]
        spans: dict[str, list[tuple[int, int]]] = {}
        for i in range(len(words)):
            for j in range(i, min(i + 8, len(words))):
                a, b = words[i][0], words[j][1]
                norm = normalize(question[a:b])
                for form in {norm, norm.removesuffix("s")}:
                    if form:
                        spans.setdefault(form, []).append((a, b))
        schema = {normalize(n) for c in [*self.catalog.classes.values(), *self.catalog.properties.values()] for n in (c.label, *c.aliases)}
        rows = self.index.exact(list(spans), MOST_NODES).select("norm", "rank", "iri", "label", "types", "module", "value_of", "score").orderBy("norm", "rank").collect()
        nodes: dict[str, list[dict]] = {}
        for r in rows:
            nodes.setdefault(r["norm"], []).append(r.asDict())
        found = [_mention(question, a, b, held) for norm, held in nodes.items() for a, b in spans[norm]]
        out: list[Mention] = []
        for m in sorted(found, key=lambda m: (m.start - m.end, -m.score)):
            word = {normalize(m.text), normalize(m.text).removesuffix("s")}
            plain = not m.text[:1].isupper() and m.value_of is None
            if (word & schema and not m.text[:1].isupper()) or plain and len(m.text) < 4 or any(m.start < o.end and o.start < m.end for o in out):
                continue
            out.append(m)
        # Capitalised runs that no name covers may be names written wrongly.
        for run in re.finditer(r"[A-Z][\w.-]*(?:\s+(?:[A-Z][\w.-]*|\w*\d\w*))*", question):
            if run.start() == 0 or any(run.start() < o.end and o.start < run.end() for o in out) or normalize(run[0]) in schema:
                continue
            near = [r.asDict() for r in self.index.fuzzy(run[0], k=MOST_NODES).select("iri", "label", "types", "module", "value_of", "score").collect()] or self.index.nearest(run[0])
            if near:
                out.append(_mention(question, run.start(), run.end(), near))
        return sorted(out, key=lambda m: m.start)

    def disambiguate(self, question: str, mentions: list[Mention], trace: Trace) -> list[Mention]:
        """Which node each name means, or that it is no name. Names with one sure node are taken as they are.

        The controller is asked for all names at once. A node that isn't sure enough stays, as leaving it out would
        answer another question; its low chance bounds the answer's confidence.
        """
        schema = {normalize(n) for c in [*self.catalog.classes.values(), *self.catalog.properties.values()] for n in (c.label, *c.aliases)}
        asked, held = {}, {}
        for i, m in enumerate(mentions):
            word = normalize(m.text) in schema
            if len(m.candidates) < 2 and m.score >= SCORE_SURE and not word:
                continue
            capital = m.text[:1].isupper() and m.start > 0 or any(c.isdigit() for c in m.text)
            none = NO_NAME["capital" if capital else "word" if word or m.score < SCORE_SURE else "plain"]
            top = max(c["score"] for c in m.candidates)
            options = {str(k): self._node_text(c) for k, c in enumerate(m.candidates)} | {"none": f"{m.text} is a word here and no name"}
            priors = {str(k): (1 - none) * min(1.0, c["score"] / top) for k, c in enumerate(m.candidates)} | {"none": none}
            asked[str(i)], held[str(i)] = Choice(f"What does {m.text} mean?", options, priors), m
        if not asked:
            return mentions
        got = self.controller.ask(question, asked)
        out = list(mentions)
        for key, m in held.items():
            d = got[key]
            best, chance = max(((k, p) for k, p in d.probabilities.items() if k != "none"), key=lambda x: (x[1], -int(x[0])))
            named = d.choice != "none" or d.confidence < GATES["entity"]
            trace.gate(f"entity {m.text}", d.choice, d.confidence, GATES["entity"], named and chance >= GATES["entity"])
            if not named:
                out.remove(m)
                continue
            c = m.candidates[int(best)]
            m.iri, m.label, m.types, m.value_of, m.score, m.confidence = c["iri"], c["label"], list(c["types"] or []), c["value_of"], c["score"], chance
        return out

    def _node_text(self, c: dict) -> str:
        kinds = f"value of {self.catalog.label(c['value_of'])}" if c["value_of"] else ", ".join(self.catalog.label(t) for t in c["types"] or []) or "a node"
        return f"{c['label']}: {kinds} in {c['module']}"

    # -- routes
    def routes(self, question: str, mentions: list[Mention]) -> list[Route]:
        """Classes the question may be about, best first: a beam over modules, then over the classes of each.

        One call asks for the module and the class. A class's chance is its own times its module's; within a module the
        descent goes from a class to one below it while that is sure enough.
        """
        by_module: dict[str, list[str]] = {}
        for c in self.catalog.classes.values():
            by_module.setdefault(c.module or "", []).append(c.iri)
        if not by_module:
            return []
        said = {m: " ; ".join([m, *(self.catalog.label(c) for c in cs)]) for m, cs in by_module.items()}
        owners = {self.catalog.classes[d].module for x in mentions if x.value_of in self.catalog.properties for d in self.catalog.properties[x.value_of].domains if d in self.catalog.classes}
        text = {c.iri: " ; ".join([c.label, *c.aliases]) for c in self.catalog.classes.values()}
        modules = Choice("Which module holds the answer?", {**said, "other": "none of these"}, {m: 0.75 if m in owners else 0.25 for m in said} if owners else {})
        module = self.controller.ask(question, {"module": modules})["module"]
        kind = choose_among_many(self.controller, question, Choice("Which kind of thing is asked for?", {**text, "other": "none of these"}))
        mass = {m: module.probabilities.get(m, 0.0) * (sum(kind.probabilities.get(c, 0.0) for c in cs) + 1e-6) for m, cs in by_module.items()}
        total = sum(mass.values()) or 1.0
        out = []
        for m, share in sorted(((m, v / total) for m, v in mass.items()), key=lambda x: (-x[1], x[0]))[:BEAM]:
            inside = sum(kind.probabilities.get(c, 0.0) for c in by_module[m]) or 1.0
            for c in by_module[m]:
                chance = share * kind.probabilities.get(c, 0.0) / inside
                if share >= BEAM_LEAST and chance >= BEAM_LEAST:
                    out.append(Route(m or None, c, chance))
        return sorted(out, key=lambda r: (-r.chance, r.cls))[: 2 * BEAM]

    @staticmethod
    def unsupported(question: str) -> bool:
        """Whether the question wants groups, ratios or changes, which no plan has."""
        return bool(re.search(r"\b(per|for each|for every|by each|grouped by|broken down|breakdown|percentage|percent|ratio|trend|growth|change over)\b", question.lower()))

    # -- plans
    def shape(self, question: str, mentions: list[Mention]) -> str:
        q, words = question.lower(), normalize(question).split()
        if q.startswith("how many"):
            return "count"
        if words and words[0] in OPENERS:
            return "boolean"
        nodes = [m for m in mentions if m.value_of is None]
        if len(nodes) > 1 and " or " in q:
            return "compare"
        if any(w in CUES["aggregate"] for w in words):
            return "aggregate"
        extremes = {*CUES["most"], *CUES["least"]}
        if any(w in extremes or w.endswith("est") and len(w) > 5 and w not in ("latest", "interest", "northwest", "northeast") for w in words) and not nodes:
            return "superlative"
        if words and words[0] in ("list", "show", "give") or re.match(r"which \w+( \w+)? (are|launched|have|work|cost|were)\b", q) and self._classes(question) and self._plural(question):
            return "list"
        return "lookup"

    def _plural(self, question: str) -> bool:
        m = re.match(r"(?:which|what) ([\w ]+?) (?:are|launched|have|work|cost|were)\b", question.lower())
        return bool(m and m[1].split()[-1].endswith("s"))

    def _classes(self, question: str) -> list[tuple[int, str]]:
        """Classes named in the question with the places of their names."""
        q = " " + " ".join(stem(w) for w in normalize(question).split()) + " "
        out = {}
        for c in self.catalog.classes.values():
            for rank, n in enumerate((c.label, *c.aliases)):
                name = " " + " ".join(stem(w) for w in normalize(split_camel(n)).split()) + " "
                if name.strip() and name in q:
                    at = (q.index(name), -len(name), rank > 0)
                    out[c.iri] = min(out.get(c.iri, at), at)
        return [(v[0], k) for k, v in sorted(out.items(), key=lambda kv: kv[1])]

    def plans(self, question: str, mentions: list[Mention], literals: list[Found], trace: Trace) -> list[QueryPlan]:
        """Plans in order of trust; the first is the answer's, the others its repairs."""
        shape = self.shape(question, mentions)
        nodes, values = [m for m in mentions if m.value_of is None and m.types], [m for m in mentions if m.value_of]
        trace.events.append(f"shape {shape}; nodes {[m.label for m in nodes]}; values {[m.label for m in values]}")
        if shape in ("lookup", "compare", "boolean"):
            if not nodes:
                return []
            subject = nodes[0]
            cls = self._most_specific(subject.types)
            if shape == "lookup":
                options = [p for p in [*self.graph.value_paths(cls), *self._object_paths(cls)] if self._met(question, p, mentions)]
                return [QueryPlan("lookup", subject=subject.iri, path=p.steps, confidences={"path": c}) for p, c in self._choose(question, options, mentions, trace)]
            if shape == "compare":
                order = "asc" if re.search(r"\b(less|cheaper|older|earlier|fewer|smaller)\b", question.lower()) else "desc"
                options = self.graph.value_paths(cls, want="numeric")
                return [QueryPlan("compare", compare=tuple(m.iri for m in nodes), path=p.steps, order=order, confidences={"path": c}) for p, c in self._choose(question, options, mentions, trace)]
            links, filters, conf = self._constraints(question, cls, nodes[1:], values, literals, mentions, trace)
            return [QueryPlan("boolean", subject=subject.iri, links=links, filters=filters, confidences=conf)] if links or filters else []
        # a value named alone asks for what has it: "How many Sales Managers"
        named = self._classes(masked(question, values)) or [(0, d) for m in values for d in self.catalog.properties[m.value_of].domains if m.value_of in self.catalog.properties]
        if not named:
            routes = self.routes(question, mentions)
            if not routes or not trace.gate("class", routes[0].cls, routes[0].chance, GATES["class"]):
                return []
            named = [(0, r.cls) for r in routes]
        target = named[0][1]
        words = normalize(question).split()
        if shape in ("aggregate", "superlative"):
            # the class whose measure is said best, and nearest
            def nearest(cls: str) -> tuple[int, int]:
                return min(((-self._met(question, p, mentions, cls), len(p.edges)) for p in self.graph.value_paths(cls, want="numeric")), default=(1, 9))

            target = min((c for _, c in named), key=nearest)
        links, filters, conf = self._constraints(question, target, nodes, values, literals, mentions, trace)
        base = QueryPlan(shape, self.catalog.closure(target), None, links=links, filters=filters, confidences=conf)
        if shape in ("count", "list"):
            return [base]
        options = self.graph.value_paths(target, want="numeric")
        if shape == "aggregate":
            base = replace(base, agg=next(CUES["aggregate"][w] for w in words if w in CUES["aggregate"]))
        else:
            base = replace(base, order="asc" if any(w in CUES["least"] for w in words) else "desc")
        ranked = self._choose(question, options, mentions, trace, target)
        return [replace(base, path=p.steps, confidences={**conf, "path": c}) for p, c in ranked]

    def _most_specific(self, types: list[str]) -> str:
        known = [t for t in types if t in self.catalog.classes]
        return max(known, key=lambda t: len(self.catalog.ancestors(t)), default=types[0] if types else "")

    def _object_paths(self, cls: str, most: int = 2) -> list[SchemaPath]:
        out = []
        for e in self.graph.edges(cls):
            if e.dst:
                out.append(SchemaPath((e,)))
                if most > 1:
                    out += [SchemaPath((e, f)) for f in self.graph.edges(e.dst) if f.dst and f.dst != cls]
        return out

    def _said(self, p: SchemaPath) -> str:
        """What a path says: its properties and their other names, and the class it ends in."""
        names = []
        for e in p.edges:
            card = self.catalog.properties[e.prop]
            names += [card.label, *card.aliases]
        last = p.edges[-1].dst
        return " ; ".join([*names, self.catalog.label(last) if last else ""])

    def _wanted(self, question: str, mentions: list[Mention], cls: str | None = None) -> set[str]:
        """The words of a question that may say a path: names aside, and the class asked for."""
        own = self.catalog.classes.get(cls or "")
        return set(stems(masked(question, mentions), keep_stopwords=True)) - set(stems(own.label) if own else [])

    def _met(self, question: str, p: SchemaPath, mentions: list[Mention], cls: str | None = None) -> int:
        """How many words with a meaning a question shares with what a path says."""
        return len(self._wanted(question, mentions, cls) & set(stems(self._said(p))))

    def _choose(self, question: str, options: list[SchemaPath], mentions: list[Mention], trace: Trace, cls: str | None = None, most: int = 60) -> list[tuple[SchemaPath, float]]:
        """Paths by how well the question says them, shorter ones first."""
        wanted = self._wanted(question, mentions, cls)
        scored = sorted(options, key=lambda p: (-len(wanted & set(stems(self._said(p), keep_stopwords=True))), len(p.edges)))[:most]
        if not scored:
            return []
        priors = {str(i): 0.6 ** (len(p.edges) - 1) for i, p in enumerate(scored)}
        d = self.controller.ask(" ".join(sorted(wanted)), {"path": Choice("Which path does the question mean?", {str(i): self._said(p) for i, p in enumerate(scored)}, priors)})["path"]
        trace.decisions.append({"name": "path", "choice": scored[int(d.choice)].describe(self.catalog), "confidence": d.confidence})
        return [(scored[int(k)], c) for k, c in d.ranked() if c >= REPAIR_LEAST]

    def _constraints(self, question: str, cls: str, nodes: list[Mention], values: list[Mention], literals: list[Found], mentions: list[Mention], trace: Trace) -> tuple[tuple[Link, ...], tuple[Filter, ...], dict[str, float]]:
        links, filters, conf = [], [], {}
        for m in nodes:
            options = self.graph.paths_between(cls, self._most_specific(m.types))
            if not options:
                continue
            path, c = self._choose(question, options, mentions, trace)[0]
            links.append(Link(path.steps, m.iri))
            conf[f"link {m.label}"] = c
        for m in values:
            options = [p for p in self.graph.value_paths(cls) if p.edges[-1].prop == m.value_of]
            if options:
                filters.append(Filter(options[0].steps, "eq", Literal("string", m.label)))
        for lit in literals:
            want = "temporal" if lit.kind in ("date", "date_range") else "numeric" if lit.kind == "number" else None
            options = [p for p in self.graph.value_paths(cls, want=want) if want or p.datatype and ("year" in local_name(p.edges[-1].prop).lower() or p.temporal)]
            ranked = self._choose(question, options, mentions, trace)
            if ranked:
                path, c = ranked[0]
                filters.append(Filter(path.steps, self._operator(question, lit), Literal("date_range" if lit.kind == "date" else lit.kind, lit.value, lit.low, lit.high), path.temporal))
                conf[f"filter {lit.text}"] = c
        return tuple(links), tuple(filters), conf

    @staticmethod
    def _operator(question: str, lit: Found) -> str:
        before = question[: lit.start].lower().rstrip(" $")
        fits = [(len(w), op) for op in ("ge", "le", "gt", "lt") for w in CUES[op] if before.endswith(w)]
        return max(fits)[1] if fits else "eq"

    # -- showing
    def labels(self, values: list) -> list[str]:
        nodes = [v for v in values if isinstance(v, str) and "://" in v]
        known = {r["iri"]: r["label"] for r in self.index.records.where(F.col("iri").isin(nodes)).select("iri", "label").collect()} if nodes else {}
        return [known.get(v, self.catalog.label(v)) if v in nodes else shown(v) for v in values]

    # -- without a plan
    def fall_back(self, question: str, out: Result, mentions: list[Mention] | None = None, attempts: int = 3, hint: QueryPlan | None = None) -> Result:
        """A query by the language model over a slice of the schema, checked before it runs; else a person's queue.

        The slice is that of classes the question names, of the nodes in it, or of those that say its words best. A
        query that is rejected goes back with the reason; one that comes again ends the attempts.
        """
        mentions = mentions or []
        if self.model is not None:
            named = [c for _, c in self._classes(question)] + [t for m in mentions for t in m.types if t in self.catalog.classes]
            text, allowed = Slicer(self.catalog).slice(list(dict.fromkeys(named)) or self.closest_classes(question))
            allowed |= {m.iri for m in mentions}
            nodes = "".join(f"{m.text} is <{m.iri}>\n" for m in mentions if not m.value_of)
            note, seen = f"A plan that may help: {explain(hint, self.catalog)}\n" if hint else "", set()
            try:
                for _ in range(attempts):
                    query = with_prefixes(code_of(self.model.complete(f"Schema:\n{text}\n\n{nodes}Question: {question}\n{note}Write one SPARQL query.")), self.prefixes)
                    if " ".join(query.split()) in seen:
                        out.trace.events.append("the same query came again")
                        break
                    seen.add(" ".join(query.split()))
                    wrong = validate(query, allowed)
                    if wrong is None:
                        values, truncated = self.run(query)
                        verdict = self.verifier.verify(question, None, values, not values, truncated)
                        if verdict.action == "accept" or attempts == 1:
                            out.status, out.sparql, out.values, out.truncated = "answered" if self.arm == "A" else "fallback", query, values, truncated
                            out.confidence = min([verdict.sure, *(m.confidence for m in mentions)])
                            out.labels = [shown(v) for v in out.values]
                            return out
                        wrong = verdict.reason
                    note = f"The last query was rejected: {wrong}\n"
                    out.trace.events.append(f"rejected: {wrong}")
            except (ModelUnavailable, SparqlError, TimeoutError) as failed:
                out.trace.events.append(str(failed))
        if self.queue:
            write_text(str(self.queue), json.dumps({"question": question, "events": out.trace.events}) + "\n", append=True)
        return out

    def run(self, query: str) -> tuple[list, bool]:
        """The values of a written query, as its projection says, and whether there were more than MOST_VALUES."""
        compiler = Compiler(self.store, self.prefixes)
        how, column = projection(parse(query, self.prefixes))
        if how == "ask":
            return [compiler.ask(query, self.seconds)], False
        rows = rows_within(compiler.select(query).limit(MOST_VALUES + 1), self.seconds)
        values = [tuple(r) if how == "table" else r[column] for r in rows]
        return [v for v in values[:MOST_VALUES] if v is not None], len(rows) > MOST_VALUES

    def closest_classes(self, question: str, most: int = 3) -> list[str]:
        """Classes whose names and properties say the question's words best, by BM25."""
        docs = {c.iri: stems(" ".join([c.label, *c.aliases, c.comment, *(f"{p.label} {' '.join(p.aliases)}" for p in self.catalog.properties_of(c.iri))])) for c in self.catalog.classes.values()}
        held_by = Counter(w for d in docs.values() for w in set(d))
        mean = sum(map(len, docs.values())) / max(1, len(docs)) or 1.0

        def score(words: list[str]) -> float:
            tf = Counter(words)
            return sum(math.log(1 + (len(docs) - held_by[w] + 0.5) / (held_by[w] + 0.5)) * tf[w] * (K1 + 1) / (tf[w] + K1 * (1 - B + B * len(words) / mean)) for w in sorted(set(stems(question)) & set(words)))

        return sorted(docs, key=lambda c: (-score(docs[c]), -self.catalog.instance_count(c), c))[:most]


def _mention(question: str, start: int, end: int, nodes: list[dict]) -> Mention:
    best = nodes[0]
    return Mention(question[start:end], start, end, best["iri"], best["label"], list(best["types"] or []), best["value_of"], best["score"], nodes)


def projection(q: Query) -> tuple[str, str | None]:
    """How a query's rows are an answer: ``ask``, ``scalar`` (one aggregate), ``column`` or ``table``; and the column.

    A variable named answer is it; else the first that is computed, else the first.
    """
    if q.form == "ask":
        return "ask", None
    items = q.items or [(n, None) for n in dict.fromkeys(x.name for t in _triples(q.where) for x in (t.s, t.p, t.o) if isinstance(x, Var))]
    names = [n for n, _ in items]
    made = [n for n, e in items if e is not None]
    column = "answer" if "answer" in names else made[0] if made else names[0] if names else None
    if len(names) > 1:
        return "table", column
    return "scalar" if made and any(isinstance(x, Call) and x.name in AGGREGATES for x in walk([e for _, e in items if e is not None])) else "column", column


def _triples(group: Any) -> Iterator[Triple]:
    for part in getattr(group, "parts", []):
        if isinstance(part, Bgp):
            yield from part.triples
        else:
            for inner in getattr(part, "groups", [getattr(part, "group", part)]):
                if inner is not group:
                    yield from _triples(inner)


def with_prefixes(query: str, prefixes: dict[str, str]) -> str:
    """The query with declarations of known prefixes that it uses and doesn't declare."""
    plain = re.sub(r"<[^<>\s]*>|\"(?:[^\"\\\\]|\\\\.)*\"|'(?:[^'\\\\]|\\\\.)*'", " ", query)
    declared = {p for p in re.findall(r"(?i)\bprefix\s+([\w-]*)\s*:", plain)}
    used = set(re.findall(r"(?<![\w?$:])([A-Za-z][\w-]*):[A-Za-z_]", plain))
    return "".join(f"PREFIX {p}: <{prefixes[p]}>\n" for p in sorted(used - declared) if p in prefixes) + query


def masked(question: str, mentions: list[Mention]) -> str:
    """The question without the names in it."""
    for m in sorted(mentions, key=lambda m: -m.start):
        question = question[: m.start] + " " + question[m.end :]
    return question


def validate(query: str, allowed: set[str]) -> str | None:
    """Why a query may not run: it can't be read, isn't a SELECT or ASK, or names what isn't in the schema."""
    wrong = check_syntax(query)
    if wrong:
        return wrong
    q = parse(query)
    if q.form == "construct":
        return "only SELECT and ASK"
    strange = {i for i in used_iris(q) - allowed if not i.startswith(("http://www.w3.org/",))}
    if strange:
        near = {i: sorted((a for a in allowed if local_name(a).lower() == local_name(i).lower()), key=len)[:1] for i in strange}
        return "; ".join(f"unknown {i}" + (f", perhaps {near[i][0]}" if near[i] else "") for i in sorted(strange))
    return None


def code_of(text: str) -> str:
    """The query in a reply: its fenced block, or all of it."""
    m = re.search(r"```(?:sparql)?\s*(.*?)```", text, re.DOTALL)
    return (m[1] if m else text).strip()


def shown(value: Any) -> str:
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float):
        return f"{value:,.2f}".rstrip("0").rstrip(".")
    if isinstance(value, tuple):
        return ": ".join([shown(value[0]), ", ".join(map(shown, value[1:]))])
    return str(value)
