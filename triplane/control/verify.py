"""Whether a result answers the question, and what to do if it doesn't."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from ..catalog.cards import Catalog, PropertyCard
from ..catalog.paths import NUMBERS, TIMES
from ..plans.algebra import Compiler
from ..plans.plan import PlanCompiler, QueryPlan, Step
from ..plans.sparql import SparqlError
from .decisions import Choice, Controller, YesNo

# How sure a result must be, what is believed of one beforehand, and why a result may be empty.
SURE = 0.5
BELIEF = {"fine": 0.85, "cut": 0.5, "empty": 0.25, "wrong": 0.15}
WHY_EMPTY = {
    "wrong_property": "the relation or property used is not the one that is meant",
    "wrong_graph": "the question is about another kind of thing or another module",
    "no_data": "the query is right and nothing matches, so the answer is none",
}
EMPTY_BELIEF = {
    "relation_missing": {"wrong_property": 0.7, "wrong_graph": 0.2, "no_data": 0.1},
    "filters_only": {"wrong_property": 0.15, "wrong_graph": 0.05, "no_data": 0.8},
    "open": {"wrong_property": 0.4, "wrong_graph": 0.2, "no_data": 0.4},
}


@dataclass
class Verdict:
    """``accept``, ``no_data``, ``repair``, ``next_route`` or ``fall_back``; the part of the plan that is doubted."""

    action: str
    reason: str
    sure: float = 0.0
    suspect: str | None = None
    checks: dict[str, Any] = field(default_factory=dict)


def explain(plan: QueryPlan, cat: Catalog) -> str:
    """A plan in words."""
    way = lambda steps: " then ".join(("what has it as " if s.inverse else "") + cat.label(s.prop) for s in steps)
    parts = [plan.shape]
    if plan.agg:
        parts.append(plan.agg)
    if plan.path:
        parts.append(f"of {way(plan.path)}")
    if plan.classes:
        parts.append(f"over {cat.label(plan.classes[0])}")
    if plan.subject:
        parts.append(f"of <{plan.subject}>")
    parts += [f"linked by {way(x.path)} to <{x.anchor}>" for x in plan.links]
    parts += [f"where {way(f.path)} {f.op} {f.literal.value if f.literal.value is not None else (f.literal.low, f.literal.high)}" for f in plan.filters]
    return ", ".join(parts)


class Verifier:
    """``labeler`` writes a value for the controller; ``relax`` counts what a plan matches without its filters."""

    def __init__(self, store: Any, cat: Catalog, controller: Controller, labeler: Callable[[Any], str] = str, relax: Callable[[QueryPlan], int] | None = None, seconds: float | None = None) -> None:
        self.store, self.cat, self.controller, self.labeler, self.seconds = store, cat, controller, labeler, seconds
        self.compiler = PlanCompiler(store)
        self.relax = relax or (lambda plan: self.compiler.relaxed_count(plan).first()["answer"])

    # -- what the schema says of a result
    def _asked(self, plan: QueryPlan) -> PropertyCard | None:
        return self.cat.properties.get(plan.path[-1].prop) if plan.path and plan.shape in ("lookup", "path") else None

    def type_fits(self, plan: QueryPlan, values: list) -> bool | None:
        """Whether values are of the kind the last property of the path has; None where the schema doesn't say."""
        card = self._asked(plan)
        if card is None or not values:
            return None
        if plan.path[-1].inverse or card.kind == "object":
            return all(isinstance(v, str) and ("://" in v or v.startswith(("_:", "urn:"))) for v in values)
        if card.datatype in NUMBERS:
            return all(isinstance(v, (int, float)) and not isinstance(v, bool) or _number(v) for v in values)
        if card.datatype in TIMES:
            return all(isinstance(v, (dt.date, int)) or isinstance(v, str) and v[:4].isdigit() for v in values)
        return True

    def number_fits(self, plan: QueryPlan, values: list) -> bool | None:
        """Whether a property that has one value at most gave no more; None where more may be."""
        card = self._asked(plan)
        if card is None or card.max_count != 1 or len(plan.path) > 1 or plan.path[0].inverse:
            return None
        return len(values) <= 1

    # -- small questions to the data
    def _has(self, node: str, step: Step, at_end: bool) -> bool:
        """Whether a node has a step: from it, or ``at_end`` to it."""
        towards = step.inverse != at_end
        pattern = f"?x <{step.prop}> <{node}>" if towards else f"<{node}> <{step.prop}> ?x"
        return Compiler(self.store).ask(f"ASK {{ {f'GRAPH <{step.graph}> {{ {pattern} }}' if step.graph else pattern} }}", self.seconds)

    def empty_at(self, plan: QueryPlan) -> str | None:
        """The first link or filter that leaves nothing, as its kind and place."""
        if not plan.classes:
            return None
        for i in range(len(plan.links) + len(plan.filters)):
            n = len(plan.links)
            part = replace(plan, shape="count", path=(), agg=None, links=plan.links[: i + 1], filters=plan.filters[: max(0, i + 1 - n)])
            if not self.compiler.compile(part).df.first()[0]:
                return f"link {i}" if i < n else f"filter {i - n}"
        return None

    def probe(self, plan: QueryPlan) -> dict[str, Any]:
        """Evidence on an empty result."""
        found: dict[str, Any] = {}
        try:
            for i, link in enumerate(plan.links):
                found[f"link {i} is there"] = self._has(link.anchor, link.path[-1], at_end=True)
            if plan.subject and plan.path:
                found["subject has it"] = self._has(plan.subject, plan.path[0], at_end=False)
            if plan.filters and plan.shape in ("count", "list", "aggregate"):
                found["without filters"] = self.relax(plan)
            if not found.get("without filters"):
                found["empty at"] = self.empty_at(plan)
        except (SparqlError, TimeoutError, ValueError) as wrong:
            found["failed"] = str(wrong)
        return found

    # -- the verdict
    def verify(self, question: str, plan: QueryPlan | None, values: list, empty: bool, truncated: bool = False) -> Verdict:
        checks: dict[str, Any] = {"values": len(values), "truncated": truncated}
        belief = "empty" if empty else "cut" if truncated else "fine"
        if plan is not None:
            checks |= {"type": self.type_fits(plan, values), "number": self.number_fits(plan, values)}
            if checks["type"] is False or checks["number"] is False:
                belief = "wrong"
        asked: dict[str, Any] = {"answers": YesNo("Does the result have what the question asks for: the right node, relation and kind of value?", BELIEF[belief])}
        if empty and plan is not None:
            evidence = self.probe(plan)
            checks |= evidence
            missing = any(v is False for v in evidence.values())
            known = "relation_missing" if missing else "filters_only" if evidence.get("without filters") or plan.shape == "count" and not plan.filters else "open"
            asked["why"] = Choice("Why is the result empty?", WHY_EMPTY, EMPTY_BELIEF[known])
        said = "; ".join([question, explain(plan, self.cat) if plan else "a written query", ", ".join(map(self.labeler, values[:20]))])
        got = self.controller.ask(said, asked)
        sure = got["answers"].yes
        if "why" in got:
            why = got["why"]
            if why.choice == "no_data" and why.confidence >= SURE:
                return Verdict("no_data", "nothing matches", why.confidence, None, checks)
            if why.choice == "wrong_graph":
                return Verdict("next_route", "another class or module may be meant", sure, None, checks)
            return Verdict("repair", "another property may be meant", sure, checks.get("empty at") or ("path" if plan.path else weakest(plan)), checks)
        if sure >= SURE:
            return Verdict("accept", "as asked", sure, None, checks)
        return Verdict("repair" if plan is not None else "fall_back", "not what is asked for", sure, weakest(plan) if plan else None, checks)


def weakest(plan: QueryPlan) -> str | None:
    """The decision of a plan that was least sure."""
    return min(plan.confidences, key=plan.confidences.get, default=None)


def _number(v: Any) -> bool:
    try:
        float(v)
    except (TypeError, ValueError):
        return False
    return True
