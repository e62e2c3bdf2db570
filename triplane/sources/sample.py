"""A small graph made from a seed: the same statements every time, in three modules."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

from .quads import quads_from_text, typed

BASE = "http://sample.example/"
COLOURS, TOWNS = ("red", "green", "blue", "grey"), ("Aldwick", "Brenham", "Corby", "Dunmore", "Elgin")


def sample_turtle(orders: int = 120, seed: int = 42) -> dict[str, str]:
    """Turtle texts by module: ``catalog`` (models and makers), ``people`` (shops and staff), ``sales`` (orders of a model
    code from a shop). Codes join sales with the catalog; some models have no order and some staff no shop."""
    rng = random.Random(seed)
    head = f"@prefix o: <{BASE}onto#> . @prefix d: <{BASE}id/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"
    makers = [f"Maker {chr(65 + i)}" for i in range(4)]
    catalog = [f'd:maker{i} a o:Maker ; rdfs:label "{m}" .' for i, m in enumerate(makers)]
    for i in range(24):
        catalog.append(f'd:model{i} a o:{"Van" if i % 3 else "Car"} ; rdfs:label "Model {i}" ; o:code "M-{i:03}" ; o:madeBy d:maker{rng.randrange(4)} ; o:colour "{rng.choice(COLOURS)}" ; o:price {rng.randrange(90, 600) * 100} .')
    people = [f'd:shop{i} a o:Shop ; rdfs:label "{t} Motors" ; o:town "{t}" .' for i, t in enumerate(TOWNS)]
    for i in range(30):
        works = f" ; o:worksAt d:shop{rng.randrange(len(TOWNS))}" if i % 10 else ""
        people.append(f'd:person{i} a o:Person ; rdfs:label "Person {i}" ; o:hired "{2010 + rng.randrange(15)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}"^^xsd:date{works} .')
    sales = []
    for i in range(orders):
        sales.append(f'd:order{i} a o:Order ; o:modelCode "M-{rng.randrange(20):03}" ; o:soldBy d:shop{rng.randrange(len(TOWNS))} ; o:pieces {rng.randrange(1, 6)} ; o:day "{rng.choice((2023, 2024, 2025))}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}"^^xsd:date .')
    return {name: head + "\n".join(lines) + "\n" for name, lines in (("catalog", catalog), ("people", people), ("sales", sales))}


def sample_quads(spark: SparkSession, orders: int = 120, seed: int = 42) -> DataFrame:
    """:func:`sample_turtle` as typed quads, each module a graph."""
    parts = [quads_from_text(spark, text, f"{BASE}graph/{name}") for name, text in sample_turtle(orders, seed).items()]
    return typed(parts[0].unionByName(parts[1]).unionByName(parts[2]))
