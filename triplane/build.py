"""From files to a store, a catalog and an index; built once, then read."""

from __future__ import annotations

from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .catalog.cards import Catalog, build_catalog
from .config import Config
from .control.decisions import LexicalController, make
from .control.models import CachedModel, HttpModel, ModelController, NullModel, RemoteController
from .control.pipeline import Pipeline
from .linking.index import EntityIndex, entity_records
from .sources.quads import load_quads, read_rdf, save_quads, store_is_empty
from .sources.store import QuadStore


def load_data(spark: SparkSession, cfg: Config) -> None:
    """Every module's files into its graph; what the graphs held before is replaced."""
    parts = [read_rdf(spark, cfg.path(f), m.graph) for m in cfg.modules for f in m.files]
    save_quads(reduce(DataFrame.unionByName, parts), cfg.path(cfg.store))


def _graph(spark: SparkSession, cfg: Config, files: list[str]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, [read_rdf(spark, cfg.path(f)) for f in files]) if files else None


def build_all(spark: SparkSession, cfg: Config, load: bool = True) -> tuple[QuadStore, Catalog, EntityIndex]:
    if load:
        load_data(spark, cfg)
    quads = load_quads(spark, cfg.path(cfg.store))
    cat = build_catalog(quads, _graph(spark, cfg, cfg.ontology), _graph(spark, cfg, cfg.shapes))
    cat.save(cfg.path(cfg.catalog))
    predicates = list(dict.fromkeys(p for m in cfg.modules for p in m.label_predicates))
    EntityIndex(entity_records(quads, predicates)).save(cfg.path(cfg.index))
    return QuadStore(quads), cat, EntityIndex.load(spark, cfg.path(cfg.index))


def load_or_build(spark: SparkSession, cfg: Config) -> tuple[QuadStore, Catalog, EntityIndex]:
    if store_is_empty(spark, cfg.path(cfg.store)):
        return build_all(spark, cfg)
    if not Path(cfg.path(cfg.catalog)).exists():
        return build_all(spark, cfg, load=False)
    return QuadStore(load_quads(spark, cfg.path(cfg.store))), Catalog.load(cfg.path(cfg.catalog)), EntityIndex.load(spark, cfg.path(cfg.index))


def model_of(cfg: Config) -> Any:
    """The language model of the settings: ``none``, ``http`` with ``url`` and ``model``, or a plug-in; replies are cached."""
    if cfg.model == "none":
        return None
    if cfg.model == "http":
        inner: Any = HttpModel(cfg.model_url, cfg.model_name)
        return CachedModel(inner, cfg.path(cfg.model_cache)) if cfg.model_cache else inner
    return make(cfg.model, lambda: None)


def controller_of(cfg: Config, model: Any) -> Any:
    """The controller of the settings: ``lexical``, ``model`` (the language model decides), ``remote`` or a plug-in."""
    if cfg.controller == "model":
        return ModelController(model or NullModel())
    if cfg.controller == "remote":
        return RemoteController(cfg.controller_url)
    return make(cfg.controller, LexicalController)


def pipeline(spark: SparkSession, cfg: Config, arm: str = "C") -> Pipeline:
    store, cat, index = load_or_build(spark, cfg)
    model = model_of(cfg)
    return Pipeline(store, cat, index, controller_of(cfg, model), model, cfg.path(cfg.queue), cfg.prefixes, cfg.seconds, arm)
