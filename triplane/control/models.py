"""Language models and remote deciders: what may be plugged in where the lexical controller stands by default."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import asdict
from typing import Any

from ..runtime import read_text, write_text
from .decisions import Choice, Decision, Scale, YesNo, request_key

#: Statuses worth another try.
TRY_AGAIN = (408, 409, 429, 500, 502, 503, 504)
#: Takes a URL, headers, a JSON body and a timeout; gives status and body. Replaced in tests.
Send = Callable[[str, dict[str, str], dict[str, Any], float], tuple[int, str]]


class ModelUnavailable(RuntimeError):
    """There is no model, or it gave no answer in time."""


def send_json(url: str, headers: dict[str, str], body: dict[str, Any], timeout: float) -> tuple[int, str]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.status, reply.read().decode()
    except urllib.error.HTTPError as wrong:
        return wrong.code, wrong.read().decode(errors="replace")
    except (urllib.error.URLError, TimeoutError) as gone:
        return 503, str(gone)


class NullModel:
    """No model: every question is refused."""

    def complete(self, prompt: str) -> str:  # noqa: ARG002
        raise ModelUnavailable("no language model is set up")


class ScriptedModel:
    """Replies given beforehand, in order; ``prompts`` has what it was asked."""

    def __init__(self, replies: Iterable[str]) -> None:
        self.replies, self.prompts = list(replies), []

    def complete(self, prompt: str) -> str:
        self.prompts.append(prompt)
        if not self.replies:
            raise ModelUnavailable("the script has ended")
        return self.replies.pop(0)


def post_within(url: str, headers: dict[str, str], body: dict[str, Any], seconds: float, send: Send, wait: float, sleep: Callable[[float], None]) -> str:
    """The reply to a request, tried again with growing pauses while there is time."""
    end, pause, last = time.monotonic() + seconds, wait, "no time"
    while (left := end - time.monotonic()) > 0:
        status, text = send(url, headers, body, left)
        if status < 400:
            return text
        last = f"{status}: {text[:200]}"
        if status not in TRY_AGAIN:
            raise ModelUnavailable(last)
        if time.monotonic() + pause >= end:
            break
        sleep(pause)
        pause *= 2
    raise ModelUnavailable(last)


class HttpModel:
    """A chat endpoint that takes ``{"model", "messages"}`` and replies with ``choices[0].message.content``.

    All tries together end within ``seconds``. The key is read from the environment variable ``key_name`` when it is used.
    """

    def __init__(self, url: str, model: str, key_name: str = "MODEL_API_KEY", seconds: float = 60.0, send: Send = send_json, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> None:
        self.url, self.model, self.key_name, self.seconds, self.send, self.wait, self.sleep = url, model, key_name, seconds, send, wait, sleep

    def complete(self, prompt: str) -> str:
        key = os.environ.get(self.key_name)
        body = {"model": self.model, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}
        text = post_within(self.url, {"Authorization": f"Bearer {key}"} if key else {}, body, self.seconds, self.send, self.wait, self.sleep)
        try:
            return json.loads(text)["choices"][0]["message"]["content"] or ""
        except (ValueError, KeyError, IndexError, TypeError) as odd:
            raise ModelUnavailable(f"a reply without a message: {text[:200]}") from odd


class CachedModel:
    """Replies kept in an append-only log, read again at the start."""

    def __init__(self, inner: Any, path: str) -> None:
        self.inner, self.path, self.calls = inner, str(path), 0
        self.known = {r["key"]: r["text"] for r in map(json.loads, read_text(self.path, "").splitlines())}

    def complete(self, prompt: str) -> str:
        key = request_key(getattr(self.inner, "model", type(self.inner).__name__), prompt)
        if key not in self.known:
            self.calls += 1
            self.known[key] = self.inner.complete(prompt)
            write_text(self.path, json.dumps({"key": key, "text": self.known[key]}) + "\n", append=True)
        return self.known[key]


# ---------------------------------------------------------------- deciding by a model
def first_object(text: str) -> dict[str, Any]:
    """The first JSON object in a text, whatever stands around it; empty if there is none."""
    reader = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            value, _ = reader.raw_decode(text, at)
            if isinstance(value, dict):
                return value
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return {}


def chances(said: Any, options: list[str]) -> dict[str, float]:
    """What was said as chances of the options: unknown options and what are no numbers left out, each from 0 to 1, all
    adding up to 1. A lone option is sure; nothing usable makes all alike."""
    if isinstance(said, str):
        said = {said: 1.0}
    given = {}
    for k, v in said.items() if isinstance(said, dict) else ():
        if k in options and isinstance(v, (int, float)) and not isinstance(v, bool) and v == v:
            given[k] = min(max(float(v), 0.0), 1.0)
    total = sum(given.values())
    return {k: given.get(k, 0.0) / total for k in options} if total > 0 else dict.fromkeys(options, 1 / len(options))


def options_of(question: Choice | YesNo | Scale) -> dict[str, str]:
    if isinstance(question, Choice):
        return question.options
    return {"yes": question.prompt, "no": "not so"} if isinstance(question, YesNo) else {str(i): x for i, x in enumerate(question.levels)}


class ModelController:
    """Asks a language model for chances of all options of all questions, in one call."""

    def __init__(self, model: Any) -> None:
        self.model = model

    def ask(self, state: str, choices: dict[str, Any]) -> dict[str, Decision]:
        asked = {name: {"question": c.prompt, "options": options_of(c)} for name, c in choices.items()}
        said = first_object(self.model.complete(f"Text: {state}\nQuestions: {json.dumps(asked, ensure_ascii=False)}\nReply with one JSON object: for each question's name an object from option to probability."))
        return {name: decided(chances(said.get(name), list(a["options"]))) for name, a in asked.items()}


class RemoteController:
    """A service that takes ``{"state", "questions"}`` and replies ``{"answers": {name: {option: probability}}}``."""

    def __init__(self, url: str, key_name: str = "DECISION_API_KEY", seconds: float = 30.0, send: Send = send_json, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> None:
        self.url, self.key_name, self.seconds, self.send, self.wait, self.sleep = url, key_name, seconds, send, wait, sleep

    def ask(self, state: str, choices: dict[str, Any]) -> dict[str, Decision]:
        key = os.environ.get(self.key_name)
        body = {"state": state, "questions": {k: {"kind": type(c).__name__, **asdict(c), "options": options_of(c)} for k, c in choices.items()}}
        said = first_object(post_within(self.url, {"Authorization": f"Bearer {key}"} if key else {}, body, self.seconds, self.send, self.wait, self.sleep)).get("answers", {})
        return {name: decided(chances(said.get(name), list(options_of(c)))) for name, c in choices.items()}


def decided(probabilities: dict[str, float]) -> Decision:
    return Decision(max(probabilities, key=lambda k: (probabilities[k], k)), probabilities)
