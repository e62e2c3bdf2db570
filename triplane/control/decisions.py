"""Typed decisions, who makes them, and how they are recorded."""

from __future__ import annotations

import hashlib
import importlib
import json
import math
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from itertools import chain
from pathlib import Path
from typing import Any, Protocol

from ..functions.text import bigrams, softmax, stems
from ..runtime import read_text, write_text

# Options that abstain, the temperature of a choice, what abstaining scores beside options that share a
# word with the question and beside none, the weight of a prior and the least one, the weight of a pair of words, what a
# word of an option costs it, the most options a controller takes at once, and how many of a group go on.
ABSTAIN = ("other", "none", "none_of_the_above", "unknown")
TEMPERATURE, ABSTAIN_SCORE, ABSTAIN_ALONE = 0.6, 0.35, 2.0
PRIOR_WEIGHT, LEAST_PRIOR, PAIR_WEIGHT, WORD_COST = 2.0, 1e-6, 0.75, 0.05
MOST_OPTIONS, ADVANCE = 255, 3
#: Up to this chance of yes, or of no, the answer is unknown.
UNSURE = 0.6


@dataclass
class Choice:
    """One of several options: key to description. ``priors`` are chances known beforehand."""

    prompt: str
    options: dict[str, str]
    priors: dict[str, float] = field(default_factory=dict)


@dataclass
class YesNo:
    """Whether something holds; ``prior`` is its chance known beforehand. Near a half the answer is unknown."""

    prompt: str
    prior: float | None = None


@dataclass
class Scale:
    """One of several levels in order, given by their descriptions."""

    prompt: str
    levels: list[str]
    prior: float | None = None


@dataclass
class Decision:
    choice: str
    probabilities: dict[str, float]

    @property
    def yes(self) -> float:
        """The chance of yes, for a :class:`YesNo`."""
        return self.probabilities.get("yes", 0.0)

    @property
    def score(self) -> float:
        """The mean level, for a :class:`Scale`."""
        return sum(int(k) * p for k, p in self.probabilities.items())

    def verdict(self, sure: float = UNSURE) -> str:
        """``yes``, ``no`` or, where neither is likelier than ``sure``, ``unknown``."""
        return "yes" if self.yes > sure else "no" if 1 - self.yes > sure else "unknown"

    @property
    def confidence(self) -> float:
        return self.probabilities.get(self.choice, 0.0)

    def ranked(self) -> list[tuple[str, float]]:
        return sorted(self.probabilities.items(), key=lambda kv: (-kv[1], kv[0]))


class Controller(Protocol):
    def ask(self, state: str, choices: dict[str, Choice | YesNo | Scale]) -> dict[str, Decision]: ...


def overlap(asked: list[str], options: dict[str, list[str]]) -> dict[str, float]:
    """How much each option, a list of words, has in common with what is asked.

    An option's features are its words and its pairs of neighbouring words. Those it shares with the question add up: a
    word by its rarity among the n options, log((n + 1) / (options with it + 1/2)), a pair by PAIR_WEIGHT. The sum is
    divided by sqrt(1 + WORD_COST * words), as long options share more by chance.
    """
    features = {k: {*words, *bigrams(words)} for k, words in options.items()}
    held_by = Counter(chain.from_iterable(features.values()))
    weight = {f: PAIR_WEIGHT if isinstance(f, tuple) else math.log((len(options) + 1) / (n + 0.5)) for f, n in held_by.items()}
    wanted = {*asked, *bigrams(asked)}
    return {k: math.fsum(weight[f] for f in features[k] & wanted) / math.sqrt(1 + WORD_COST * len(options[k])) for k in options}


class LexicalController:
    """Chooses by :func:`overlap` of stems. Works offline and repeats exactly."""

    def ask(self, state: str, choices: dict[str, Choice]) -> dict[str, Decision]:
        asked = stems(state)
        return {name: self._answered(asked, c) for name, c in choices.items()}

    def _answered(self, asked: list[str], c: Choice | YesNo | Scale) -> Decision:
        if isinstance(c, YesNo):
            # Words alone tell no yes from a no: what is known beforehand stands.
            yes = 0.5 if c.prior is None else min(max(c.prior, 0.0), 1.0)
            return Decision("yes" if yes >= 0.5 else "no", {"yes": yes, "no": 1 - yes})
        if isinstance(c, Scale):
            c = Choice(c.prompt, {str(i): x for i, x in enumerate(c.levels)}, {} if c.prior is None else {str(min(max(round(c.prior), 0), len(c.levels) - 1)): 1.0})
        return self._decided(c, overlap(asked, {k: stems(v) for k, v in c.options.items()}))

    @staticmethod
    def _decided(c: Choice, scores: dict[str, float]) -> Decision:
        abstain = ABSTAIN_SCORE if any(s > 0 for k, s in scores.items() if k not in ABSTAIN) else ABSTAIN_ALONE
        prior = {k: PRIOR_WEIGHT * TEMPERATURE * math.log(max(p, LEAST_PRIOR)) for k, p in c.priors.items()}
        raised = [(abstain if k in ABSTAIN else s) + prior.get(k, 0.0) for k, s in scores.items()]
        chances = dict(zip(scores, softmax(raised, TEMPERATURE), strict=True))
        return Decision(max(chances, key=lambda k: (chances[k], k)), chances)


def choose_among_many(controller: Controller, state: str, c: Choice, group: int = MOST_OPTIONS - 1, advance: int = ADVANCE) -> Decision:
    """One choice of any number of options. While they are more than a controller takes, they are asked for in groups,
    all in one call, and the best of each group stay; those that fell out have no chance in the answer."""
    left = list(c.options)

    def among(keys: list[str]) -> Choice:
        return Choice(c.prompt, {k: c.options[k] for k in keys}, {k: p for k, p in c.priors.items() if k in set(keys)})

    while len(left) > MOST_OPTIONS:
        groups = {str(at): among(left[at : at + group]) for at in range(0, len(left), group)}
        left = [k for d in controller.ask(state, groups).values() for k, _ in d.ranked()[:advance]]
    last = controller.ask(state, {"choice": among(left)})["choice"]
    return last if len(left) == len(c.options) else Decision(last.choice, {**dict.fromkeys(c.options, 0.0), **last.probabilities})


def request_key(*parts: Any) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


class RecordingController:
    """Hands questions on and keeps what was asked and decided, with the time it took."""

    def __init__(self, inner: Controller) -> None:
        self.inner, self.records = inner, []

    def ask(self, state: str, choices: dict[str, Any]) -> dict[str, Decision]:
        began = time.perf_counter()
        got = self.inner.ask(state, choices)
        self.records.append({"state": state, "questions": {k: asdict(c) for k, c in choices.items()}, "decisions": {k: asdict(d) for k, d in got.items()}, "seconds": time.perf_counter() - began})
        return got


class CachingController:
    """Answers repeated requests from an append-only log, read again at the start."""

    def __init__(self, inner: Controller, path: str | Path) -> None:
        self.inner, self.path, self.calls = inner, str(path), 0
        self.known = {r["key"]: r["decisions"] for r in map(json.loads, read_text(self.path, "").splitlines())}

    def ask(self, state: str, choices: dict[str, Choice]) -> dict[str, Decision]:
        key = request_key(state, {k: asdict(c) for k, c in choices.items()})
        if key not in self.known:
            self.calls += 1
            self.known[key] = {k: asdict(d) for k, d in self.inner.ask(state, choices).items()}
            write_text(self.path, json.dumps({"key": key, "decisions": self.known[key]}) + "\n", append=True)
        return {k: Decision(**d) for k, d in self.known[key].items()}


def make(spec: str, default: Callable[[], Any]) -> Any:
    """A plug-in by name: ``python:module:factory``, or the default for ``lexical`` and ``none``."""
    if spec in ("lexical", "none"):
        return default()
    _, module, factory = spec.split(":", 2)
    return getattr(importlib.import_module(module), factory)()
