"""Canonical form of short questions and SPARQL texts, for finding records that differ in form only."""

from __future__ import annotations

import re
import unicodedata

_PREFIX = re.compile(r"\s*prefix\s+([^\s:]*)\s*:\s*(<[^>]*>)", re.IGNORECASE)
#: Signs of a pattern that must stay whole: strings, IRIs, numbers and names with dots inside them; white space in runs.
_WHOLE = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|<[^<>\s]*>|[?$]?[\w:-]+(?:\.[\w:-]+)*|\s+|.', re.DOTALL)


def question_form(text: str | None) -> str | None:
    """The letters and digits of a text in order, case aside. NULL stays NULL; a text without any gives ''."""
    if text is None:
        return None
    if text.isascii():
        return "".join(filter(str.isalnum, text)).lower()
    return "".join(ch for ch in _same_case(unicodedata.normalize("NFC", text)) if unicodedata.category(ch)[0] in "LN")


def _same_case(text: str) -> str:
    """Case taken off letter by letter: one letter never becomes two, so a sharp s stays apart from a double s."""
    return text.lower() if text.isascii() else "".join(f if len(f := ch.casefold()) == 1 else low if len(low := ch.lower()) == 1 else ch for ch in text)


def _squeeze(text: str) -> str:
    return _same_case("".join(text.split()))


def _patterns(body: str) -> list[str]:
    """The patterns of a group: the parts between dots outside of strings, IRIs, names, numbers, ( ) and { }."""
    parts, now, depth = [], [], 0
    for sign in _WHOLE.findall(body):
        depth += (sign in "({") - (sign in ")}")
        if sign == "." and depth == 0:
            parts.append("".join(now))
            now = []
        else:
            now.append(sign)
    parts.append("".join(now))
    return sorted(filter(None, map(_squeeze, parts)))


def sparql_form(text: str | None) -> str | None:
    """Prefixes in order, the head, and the patterns within the outer braces in order; case and white space aside.

    NULL stays NULL. A text without braces is its head. What follows the closing brace is kept after the patterns.
    """
    if text is None:
        return None
    prefixes, at = [], 0
    while m := _PREFIX.match(text, at):
        prefixes.append(_squeeze(m[1] + ":" + m[2]))
        at = m.end()
    rest = text[at:]
    opening = _outside(rest, "{")
    if opening < 0:
        return "\x1f".join([*sorted(prefixes), "\x1e", _squeeze(rest)])
    closing = rest.rfind("}")
    body, tail = (rest[opening + 1 : closing], rest[closing + 1 :]) if closing > opening else (rest[opening + 1 :], "\x1d")
    return "\x1f".join([*sorted(prefixes), "\x1e", _squeeze(rest[:opening]), "\x1e", *_patterns(body), "\x1e", _squeeze(tail)])


def _outside(text: str, sign: str) -> int:
    at = 0
    for x in _WHOLE.findall(text):
        if x == sign:
            return at
        at += len(x)
    return -1


def record_form(question: str | None, sparql: str | None) -> str:
    """One key for a record: NULL parts equal NULL parts only."""
    mark = lambda x: "\x00" if x is None else "\x01" + x
    return mark(question_form(question)) + "\x1c" + mark(sparql_form(sparql))
