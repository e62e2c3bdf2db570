"""Settings from a TOML file and the environment."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from .catalog.cards import LABELS
from .sources.store import TYPE


@dataclass
class Module:
    """A named graph: its files, and the predicates that type and name its nodes."""

    name: str
    graph: str
    files: list[str] = field(default_factory=list)
    description: str = ""
    type_predicate: str = TYPE
    label_predicates: list[str] = field(default_factory=lambda: list(LABELS))


@dataclass
class Config:
    root: Path
    modules: list[Module]
    store: str = "work/quads"
    catalog: str = "work/catalog.json"
    index: str = "work/index"
    queue: str = "work/review.jsonl"
    ontology: list[str] = field(default_factory=list)
    shapes: list[str] = field(default_factory=list)
    controller: str = "lexical"
    controller_url: str = ""
    model: str = "none"
    model_url: str = ""
    model_name: str = ""
    model_cache: str = "work/replies.jsonl"
    seconds: float | None = None
    prefixes: dict[str, str] = field(default_factory=dict)

    def path(self, name: str) -> str:
        return str(self.root / name)


def load_config(path: str | Path) -> Config:
    """Settings of a file; paths in it are relative to its folder."""
    path = Path(path)
    d = tomllib.loads(path.read_text())
    plain = {k: v for k, v in d.items() if k not in ("modules", "store", "schema", "controller", "llm", "limits", "prefixes")}
    store, schema = d.get("store", {}), d.get("schema", {})
    given = {
        "store": store.get("path"), "ontology": _list(schema.get("ontology")), "shapes": _list(schema.get("shapes")),
        "controller": d.get("controller", {}).get("kind"), "controller_url": d.get("controller", {}).get("url"), "prefixes": d.get("prefixes"),
        "model": d.get("llm", {}).get("kind"), "model_url": d.get("llm", {}).get("url"), "model_name": d.get("llm", {}).get("model"), "model_cache": d.get("llm", {}).get("cache"),
        "seconds": d.get("limits", {}).get("query_seconds"),
    }
    names = Config.__dataclass_fields__
    return Config(path.parent, [Module(**{k: v for k, v in m.items() if k in Module.__dataclass_fields__}) for m in d.get("modules", [])], **{k: v for k, v in given.items() if v}, **{k: v for k, v in plain.items() if k in names and k not in given})


def _list(value: str | list[str] | None) -> list[str]:
    return [value] if isinstance(value, str) else list(value or [])


def load_env(path: str | Path) -> None:
    """``NAME=value`` lines of a file into the environment; what is set already stays."""
    if Path(path).exists():
        for line in Path(path).read_text().splitlines():
            name, found, value = line.partition("=")
            if found and not line.lstrip().startswith("#"):
                os.environ.setdefault(name.strip(), value.strip().strip("\"'"))
