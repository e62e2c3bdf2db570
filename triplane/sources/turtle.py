"""Reading of RDF texts: Turtle, TriG and RDF/XML, one document at a time."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urljoin

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"


class Term(NamedTuple):
    """An RDF term: ``kind`` 0 IRI, 1 literal, 2 blank node."""

    kind: int
    text: str
    datatype: str | None = None
    lang: str | None = None


class Quad(NamedTuple):
    g: str | None
    s: Term
    p: str
    o: Term


class RdfSyntaxError(ValueError):
    pass


_TOKEN = re.compile(
    r"""(?P<space>(?:\s|\#[^\n]*)+)
      | (?P<iri><[^<>"{}|^`\s]*>)
      | (?P<long>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
      | (?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
      | (?P<directive>@prefix\b|@base\b)
      | (?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
      | (?P<hats>\^\^)
      | (?P<bnode>_:[\w](?:[\w.\-·]*[\w\-·])?)
      | (?P<number>[+-]?(?:\d+\.\d+(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:\.?[eE][+-]?\d+)?))(?![\w:])
      | (?P<name>(?:[^\W\d_][\w\-]*(?:\.[\w\-]+)*)?:(?:(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
      | (?P<word>[a-zA-Z]+)
      | (?P<sign>[.;,\[\](){}])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_SIMPLE = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _SIMPLE.get(m[3], m[3]), text)


class TurtleReader:
    """Recursive reader of Turtle and TriG. ``graph`` names the graph of triples outside of graph blocks."""

    def __init__(self, text: str, graph: str | None = None, base: str = "", scope: str = "") -> None:
        self.graph, self.default, self.base, self.scope = graph, graph, base, scope
        self.prefixes: dict[str, str] = {}
        self.quads: list[Quad] = []
        self.fresh = 0
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise RdfSyntaxError(f"unreadable at {at}: {text[at:at + 40]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def take(self, sign: str) -> bool:
        if self.peek()[1] == sign and self.peek()[0] in ("sign", "word"):
            self.at += 1
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise RdfSyntaxError(f"expected {sign!r}, got {self.peek()[1]!r}")

    def read(self) -> list[Quad]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if kind == "directive" or kind == "word" and text.lower() in ("prefix", "base"):
                self._directive()
            elif kind == "word" and text.lower() == "graph":
                self.next()
                self._block(self._iri_or_bnode())
            elif text == "{":
                self._block(None)
            else:
                self._statement()
        return self.quads

    def _directive(self) -> None:
        kind, text = self.next()
        if text.lower().lstrip("@") == "prefix":
            name = self.next()[1]
            self.prefixes[name[:-1]] = self._iri(self.next())
        else:
            self.base = self._iri(self.next())
        if kind == "directive":
            self.need(".")

    def _block(self, name: Term | None) -> None:
        self.need("{")
        self.graph = name.text if name else self.default
        while not self.take("}"):
            self._triples()
            if not self.take("."):
                self.need("}")
                break
        self.graph = self.default

    def _statement(self) -> None:
        start = self.at
        if self.peek()[0] in ("iri", "name", "bnode"):
            term = self._iri_or_bnode()
            if self.peek()[1] == "{":
                self._block(term)
                return
            self.at = start
        self._triples()
        self.need(".")

    def _triples(self) -> None:
        if self.peek()[1] == "[":
            subject = self._node()
            if self.peek()[1] in (".", "}"):
                return
        else:
            subject = self._node()
        self._predicates(subject)

    def _predicates(self, subject: Term) -> None:
        while True:
            kind, text = self.peek()
            if text == "a" and kind == "word":
                self.next()
                predicate = RDF + "type"
            else:
                predicate = self._iri_or_bnode().text
            while True:
                self._add(subject, predicate, self._node())
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.peek()[1] in (".", "]", "}"):
                return

    def _add(self, s: Term, p: str, o: Term) -> None:
        self.quads.append(Quad(self.graph, s, p, o))

    def _blank(self) -> Term:
        self.fresh += 1
        return Term(2, f"_:{self.scope}b{self.fresh}")

    def _iri(self, token: tuple[str, str]) -> str:
        kind, text = token
        if kind == "iri":
            iri = unescape(text[1:-1])
            return urljoin(self.base, iri) if self.base and not re.match(r"[A-Za-z][\w+.-]*:", iri) else iri
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise RdfSyntaxError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise RdfSyntaxError(f"expected an IRI, got {text!r}")

    def _iri_or_bnode(self) -> Term:
        token = self.next()
        return Term(2, f"_:{self.scope}{token[1][2:]}") if token[0] == "bnode" else Term(0, self._iri(token))

    def _node(self) -> Term:
        kind, text = self.peek()
        if text == "[" and kind == "sign":
            self.next()
            node = self._blank()
            if not self.take("]"):
                self._predicates(node)
                self.need("]")
            return node
        if text == "(" and kind == "sign":
            self.next()
            return self._collection()
        if kind in ("string", "long"):
            self.next()
            body = unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek()[0] == "lang":
                return Term(1, body, RDF + "langString", self.next()[1][1:])
            if self.peek()[0] == "hats":
                self.next()
                return Term(1, body, self._iri(self.next()))
            return Term(1, body, XSD + "string")
        if kind == "number":
            self.next()
            return Term(1, text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if kind == "word" and text in ("true", "false"):
            self.next()
            return Term(1, text, XSD + "boolean")
        return self._iri_or_bnode()

    def _collection(self) -> Term:
        items = []
        while not self.take(")"):
            items.append(self._node())
        head = Term(0, RDF + "nil")
        for item in reversed(items):
            node = self._blank()
            self._add(node, RDF + "first", item)
            self._add(node, RDF + "rest", head)
            head = node
        return head


def read_rdfxml(text: str, graph: str | None, scope: str = "") -> Iterator[Quad]:
    """RDF/XML: typed nodes, property elements and attributes, resources, literals, nested nodes, collections aside."""
    root = ET.fromstring(text)
    count = 0
    rdf, lang_key = f"{{{RDF}}}", "{http://www.w3.org/XML/1998/namespace}lang"

    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def blank() -> Term:
        nonlocal count
        count += 1
        return Term(2, f"_:{scope}x{count}")

    def node(e: ET.Element, lang: str | None) -> Iterator[Quad | Term]:
        lang = e.get(lang_key, lang)
        if e.get(rdf + "about") is not None:
            subject = Term(0, e.get(rdf + "about"))
        elif e.get(rdf + "ID") is not None:
            subject = Term(0, "#" + e.get(rdf + "ID"))
        elif e.get(rdf + "nodeID") is not None:
            subject = Term(2, f"_:{scope}{e.get(rdf + 'nodeID')}")
        else:
            subject = blank()
        yield subject
        if e.tag != rdf + "Description":
            yield Quad(graph, subject, RDF + "type", Term(0, name(e.tag)))
        for key, value in e.attrib.items():
            if not key.startswith(rdf) and key != lang_key and key.startswith("{"):
                yield Quad(graph, subject, name(key), Term(1, value, RDF + "langString" if lang else XSD + "string", lang))
        for child in e:
            here = child.get(lang_key, lang)
            predicate = name(child.tag)
            if child.get(rdf + "resource") is not None:
                yield Quad(graph, subject, predicate, Term(0, child.get(rdf + "resource")))
            elif child.get(rdf + "nodeID") is not None:
                yield Quad(graph, subject, predicate, Term(2, f"_:{scope}{child.get(rdf + 'nodeID')}"))
            elif child.get(rdf + "parseType") == "Resource":
                inner = blank()
                yield Quad(graph, subject, predicate, inner)
                wrapped = ET.Element(rdf + "Description", {rdf + "nodeID": inner.text[2 + len(scope) :]})
                wrapped.extend(list(child))
                yield from (q for q in node(wrapped, here) if isinstance(q, Quad))
            elif len(child):
                for inner_node in child:
                    parts = node(inner_node, here)
                    yield Quad(graph, subject, predicate, next(parts))
                    yield from parts
            else:
                kind = child.get(rdf + "datatype")
                tag = None if kind else here
                yield Quad(graph, subject, predicate, Term(1, child.text or "", kind or (RDF + "langString" if tag else XSD + "string"), tag))

    for e in root if root.tag == rdf + "RDF" else [root]:
        yield from (q for q in node(e, root.get(lang_key)) if isinstance(q, Quad))
