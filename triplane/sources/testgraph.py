"""The test tables read as graphs."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..runtime import read_table
from .store import Entity, MappedStore, Property

ID, ONTO, GRAPH = "http://tables.example/id/", "http://tables.example/onto#", "http://tables.example/graph/"
PREFIXES = {"t": ONTO, "id": ID, "g": GRAPH, "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "xsd": "http://www.w3.org/2001/XMLSchema#"}

#: Per table its graph, class, key, and columns (``column: property`` or ``column: property > target class``).
TABLES = {
    "region": ("geo", "Region", "r_regionkey", "r_name: name"),
    "nation": ("geo", "Nation", "n_nationkey", "n_name: name, n_regionkey: inRegion > Region"),
    "customer": ("party", "Customer", "c_custkey", "c_name: name, c_nationkey: locatedIn > Nation, c_acctbal: acctbal, c_mktsegment: segment"),
    "supplier": ("party", "Supplier", "s_suppkey", "s_name: name, s_nationkey: locatedIn > Nation, s_acctbal: acctbal"),
    "part": ("catalog", "Part", "p_partkey", "p_name: name, p_brand: brand, p_type: partType, p_size: size, p_retailprice: price, p_partkey: partCode"),
    "orders": ("sales", "Order", "o_orderkey", "o_custkey: placedBy > Customer, o_orderstatus: status, o_totalprice: total, o_orderdate: date, o_orderpriority: priority"),
    "lineitem": ("sales", "Line", "line_id", "l_orderkey: ofOrder > Order, l_partkey: forPartCode, l_suppkey: suppliedBy > Supplier, l_quantity: quantity, l_extendedprice: extended, l_discount: discount, l_shipdate: shipped"),
    "events": ("activity", "Event", "event_id", "ts: at, user_id: byUser > Customer, event_type: eventType, value: value"),
    "documents": ("corpus", "Document", "doc_id", "title: title, lang: lang, source: source, rating: rating, n_chars: chars, item: aboutCode"),
}
#: Classes below others, fixed values.
SUBCLASSES = {"Customer": "Party", "Supplier": "Party", "Order": "Record", "Line": "Record", "Event": "Record"}


def template(cls: str) -> str:
    return f"{ID}{cls.lower()}/{{}}"


def node(cls: str, key: object) -> str:
    return template(cls).replace("{}", str(key))


def store(spark: SparkSession, d: str, *names: str) -> MappedStore:
    """The named tables (all unless any are named) as one store."""
    entities = []
    for table in names or TABLES:
        graph, cls, key, columns = TABLES[table]
        df = read_table(spark, d, table)
        if table == "lineitem":
            # Its own numbering repeats; a whole row is what is unique.
            df = df.withColumn("line_id", F.xxhash64(*[F.col(c) for c in df.columns]))
        props = []
        for text in columns.split(", "):
            column, _, rest = text.partition(": ")
            name, _, target = rest.partition(" > ")
            props.append(Property(ONTO + name, column, template(target) if target else None))
        entities.append(Entity(GRAPH + graph, ONTO + cls, df, key, template(cls), props))
    return MappedStore(entities)


def below(cls: str) -> tuple[str, ...]:
    """The class and the classes below it."""
    return (ONTO + cls, *(ONTO + c for c, up in SUBCLASSES.items() if up == cls))
