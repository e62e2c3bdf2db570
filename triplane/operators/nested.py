"""Deeply nested records as flat node tables, with interval labels that keep the tree."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from json.decoder import scanstring
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and characters of paths and values turned into a batch at once, which bounds a task's memory.
ROWS_AT_ONCE = 50_000
CHARS_AT_ONCE = 16_000_000

#: Columns of a node table. ``pre`` and ``post`` number the nodes of one record in pre-order and post-order from 0;
#: the root is node 0 with ``path`` and ``kind`` empty. A node B lies inside A when A.pre < B.pre and B.post < A.post.
#: ``post`` is always ``pre`` + the number of nodes below - ``depth``.
NODE_SCHEMA = "kind string, path string, pre int, post int, depth int, parent_pre int, pos int, name string, value string"
NODE_COLUMNS = ["kind", "path", "pre", "post", "depth", "parent_pre", "pos", "name", "value"]


# ---------------------------------------------------------------- reading JSON of any depth
def parse_json(text: str | None) -> Any:
    """The value of a JSON text; a text that is itself a JSON string is read once more. None when it isn't valid."""
    if text is None:
        return None
    try:
        value = _load(text)
        return _load(value) if isinstance(value, str) else value
    except ValueError:
        return None


def _load(text: str) -> Any:
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return _load_deep(text)
    except ValueError as e:
        # Valid JSON may have integers longer than Python turns into numbers by default.
        if "integer string conversion" in str(e):
            return _load_deep(text)
        raise


def _no_constant(_: str) -> Any:
    raise ValueError("NaN and Infinity are no JSON")


_BLANK = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?|true|false|null")
_WORDS = {"true": True, "false": False, "null": None}
_LONG_NUMBER = 4000


def _load_deep(text: str) -> Any:
    """What ``json.loads`` gives, by a stack of open objects and lists instead of calls, so that depth has no limit.

    Integers of more than 4000 digits are kept as their text.
    """
    open_: list[Any] = []
    names: list[str | None] = []
    at = _BLANK.match(text, 0).end()
    while True:
        # a value begins here
        sign = text[at : at + 1]
        done = True
        if sign in ("{", "["):
            value: Any = {} if sign == "{" else []
            at = _BLANK.match(text, at + 1).end()
            if text[at : at + 1] == ("}" if sign == "{" else "]"):
                at += 1
            else:
                open_.append(value)
                names.append(None)
                done = False
        elif sign == '"':
            value, at = scanstring(text, at + 1, True)
        else:
            m = _SCALAR.match(text, at)
            if not m:
                raise ValueError(f"no JSON value at {at}")
            at = m.end()
            if m[0] in _WORDS:
                value = _WORDS[m[0]]
            elif m[2] or m[3]:
                value = float(m[0])
            else:
                value = int(m[0]) if len(m[0]) < _LONG_NUMBER else m[0]
        while done:
            at = _BLANK.match(text, at).end()
            if not open_:
                if at != len(text):
                    raise ValueError(f"more than one JSON value at {at}")
                return value
            holder = open_[-1]
            if isinstance(holder, list):
                holder.append(value)
            else:
                holder[names[-1]] = value
            sign, at = text[at : at + 1], at + 1
            if sign == ",":
                at = _BLANK.match(text, at).end()
                done = False
            elif sign == ("]" if isinstance(holder, list) else "}"):
                value = open_.pop()
                names.pop()
            else:
                raise ValueError(f"no end of a JSON value at {at}")
        if isinstance(open_[-1], dict):
            if text[at : at + 1] != '"':
                raise ValueError(f"no name at {at}")
            names[-1], at = scanstring(text, at + 1, True)
            at = _BLANK.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            at = _BLANK.match(text, at + 1).end()


# ---------------------------------------------------------------- labels of JSON texts
def _scalars(value: list) -> list | None:
    """A list with NULL for each object, at any depth; None if it holds nothing but objects and NULLs beside them."""
    out: list = []
    todo: list[tuple[list, list]] = [(value, out)]
    objects = others = False
    while todo:
        source, target = todo.pop()
        for x in source:
            if isinstance(x, dict):
                objects = True
                target.append(None)
            elif isinstance(x, list):
                target.append([])
                todo.append((x, target[-1]))
            else:
                others = others or x is not None
                target.append(x)
    return None if objects and not others else out


def _dump(fields: dict) -> str:
    try:
        return json.dumps(fields, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        parts = []
        for name, value in fields.items():
            text, todo = [], [value]
            while todo:
                x = todo.pop()
                if isinstance(x, list):
                    todo.append(_Raw("]"))
                    for i, y in enumerate(reversed(x)):
                        todo.extend([_Raw(","), y] if i else [y])
                    text.append("[")
                else:
                    text.append(x.text if isinstance(x, _Raw) else json.dumps(x, ensure_ascii=False))
            parts.append(f"{json.dumps(name, ensure_ascii=False)}:{''.join(text)}")
        return "{" + ",".join(parts) + "}"


class _Raw:
    def __init__(self, text: str) -> None:
        self.text = text


def _elements(values: list, path: str) -> Iterator[tuple[dict, str, int]]:
    """The objects of a list, lists in lists included, in order, with their paths and positions; nulls count."""
    stack = [(v, f"{path}[{i}]", i) for i, v in reversed(list(enumerate(values)))]
    while stack:
        v, p, i = stack.pop()
        if isinstance(v, dict):
            yield v, p, i
        elif isinstance(v, list):
            stack.extend((x, f"{p}[{j}]", j) for j, x in reversed(list(enumerate(v))))


def walk_json(root: Any, name: str, list_fields: frozenset[str]) -> Iterator[tuple]:
    """``kind, path, depth, parent, pos, field, value`` of every object of a JSON value, in pre-order.

    ``parent`` is the number of the parent in this order, -1 for the root; the value is the JSON of the object's own
    scalars and lists of scalars, so the nodes together hold the whole record. A root that is a list is the list of an
    object without a name. Objects wait on a stack, so depth is bounded by memory only; each is handed out once.
    """
    if isinstance(root, list):
        root = {"": root}
    todo: list[tuple] = [(root, name, name, 1, -1, None, None)]
    inside: dict[str, str] = {}
    n = 0
    while todo:
        obj, kind, path, depth, parent, pos, field = todo.pop()
        own, below = {}, []
        for f, v in obj.items():
            if isinstance(v, dict):
                at = f"{path}.{f}" if f else path
                kind_f = inside.get(f) or inside.setdefault(f, f"{name}.{f}")
                below.append((v, kind_f, f"{at}[0]", depth + 1, n, 0, f) if f in list_fields else (v, kind_f, at, depth + 1, n, None, f))
            elif isinstance(v, list):
                kind_f = inside.get(f) or inside.setdefault(f, f"{name}.{f}")
                found = [(o, kind_f, p, depth + 1, n, i, f) for o, p, i in _elements(v, f"{path}.{f}" if f else path)]
                below.extend(found)
                rest = _scalars(v) if found else v
                if rest is not None:
                    own[f] = rest
            else:
                own[f] = v
        yield kind, path, depth, parent, pos, field, _dump(own)
        n += 1
        below.reverse()
        todo.extend(below)


def label_json(df: DataFrame, key: str, column: str, name: str, list_fields: Iterable[str] = (), before: Column | None = None) -> DataFrame:
    """One row per record, its root, and one per JSON object in ``column``: ``key`` and :data:`NODE_SCHEMA`.

    ``name`` begins the paths, and is the kind of the topmost object; an object in a field ``f`` is of kind ``name.f``.
    An object alone in one of ``list_fields`` is element 0. ``before`` counts nodes of the record that come before these
    and are labelled elsewhere. Texts that are NULL, no valid JSON or no object or list have the root row only.

    One pass over Arrow batches without a shuffle. A record is labelled by one task; it is handed on in batches of
    bounded size, however large it is. Characters that are no Unicode text (lone halves of pairs) become U+FFFD.
    """
    fields = frozenset(list_fields)
    schema = StructType([df.schema[key], *StructType.fromDDL(NODE_SCHEMA)])
    arrow = to_arrow_schema(schema)

    def labelled(key_: Any, text: str | None, offset: int) -> Iterator[tuple]:
        root = parse_json(text)
        if not isinstance(root, (dict, list)):
            yield (key_, "", "", 0, offset, 0, -1, None, None, None)
            return
        found = list(walk_json(root, name, fields))
        below = [0] * len(found)
        for i in range(len(found) - 1, 0, -1):
            below[found[i][3]] += below[i] + 1
        yield (key_, "", "", 0, offset + len(found), 0, -1, None, None, None)
        for i, (kind, path, depth, parent, pos, field, value) in enumerate(found):
            pre = i + 1 + offset
            yield (key_, kind, path, pre, pre + below[i] - depth, depth, 0 if parent < 0 else parent + 1 + offset, pos, field, value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in labelled(*record):
                    rows.append(row)
                    held += len(row[2]) + len(row[9] or "")
                    if len(rows) >= ROWS_AT_ONCE or held >= CHARS_AT_ONCE:
                        yield _batch(rows, arrow)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, arrow)

    return df.select(key, column, F.coalesce(before.cast("int") if before is not None else F.lit(0), F.lit(0)).alias("before")).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for values, f in zip(zip(*rows, strict=True), schema, strict=True):
        try:
            arrays.append(pa.array(values, f.type))
        except UnicodeEncodeError:
            arrays.append(pa.array([v if v is None else v.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") for v in values], f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


# ---------------------------------------------------------------- labels of typed columns
_NO_ENTRIES = "CAST(map() AS map<string, double>)"


def _node(kind: str, path: Column, depth: int, up: Column, pos: Column, name: Column, below: Column, number: Column, item: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), path.alias("path"), F.lit(depth).alias("depth"), up.cast("int").alias("up"), pos.cast("int").alias("pos"), name.alias("name"), below.cast("int").alias("below"), number.alias("number"), item.alias("item"))


def _entry_nodes(entries: Column, item_type: str, kind: str, path: Column, depth: int) -> Column:
    def node(e: Column, i: Column) -> Column:
        return _node(kind, F.concat(path, F.lit("["), e["key"], F.lit("]")), depth, i + 1, F.lit(None), e["key"], F.lit(0), e["value"], F.lit(None).cast(item_type))

    return F.transform(F.array_sort(F.map_entries(entries)), node)


def entry_nodes(entries: str, item_type: str) -> Column:
    """The nodes of a ``map<string, double>`` column, one per entry in the order of names; for :func:`label_columns`."""
    return _entry_nodes(F.col(entries), item_type, entries, F.lit(entries), 1)


def element_nodes(elements: str, fields: Iterable[str], entries: str, item_type: str) -> Column:
    """The nodes of an array of structs: each element that is not NULL, then the entries of its map ``entries``.

    ``fields`` of an element are kept as its item, of ``item_type``. Positions count NULL elements.
    """

    def nodes(e: Column, i: Column) -> Column:
        at = F.concat(F.lit(f"{elements}["), i.cast("string"), F.lit("]"))
        item = F.struct(*[e[f].alias(f) for f in fields]).cast(item_type)
        own = _node(elements, at, 1, F.lit(0), i, F.lit(None).cast("string"), F.coalesce(F.greatest(F.size(e[entries]), F.lit(0)), F.lit(0)), F.lit(None).cast("double"), item)
        below = _entry_nodes(F.coalesce(e[entries], F.expr(_NO_ENTRIES)), item_type, f"{elements}.{entries}", F.concat(at, F.lit(f".{entries}")), 2)
        return F.when(e.isNotNull(), F.concat(F.array(own), below))

    return F.flatten(F.filter(F.transform(F.col(elements), nodes), lambda x: x.isNotNull()))


def label_columns(df: DataFrame, key: str, parts: list[Column]) -> DataFrame:
    """The nodes of typed columns: ``key``, :data:`NODE_SCHEMA`, and their own ``number`` and ``item``.

    ``parts`` are arrays of nodes in pre-order from :func:`entry_nodes` and :func:`element_nodes`; a NULL column has
    none. Place in the array is pre-order, and a node's place, depth and number of nodes below give the rest, so no
    row leaves the JVM and nothing is shuffled. The record's root is node 0; its row comes from :func:`label_json`.
    """
    nodes = F.flatten(F.filter(F.array(*parts), lambda p: p.isNotNull()))
    n = df.select(key, F.posexplode(nodes).alias("at", "n")).select(key, "n.*", (F.col("at") + 1).alias("pre"))
    value = F.coalesce(F.col("number").cast("string"), F.to_json("item", {"ignoreNullFields": "false"}))
    parent = F.when(F.col("depth") == 1, 0).otherwise(F.col("pre") - F.col("up"))
    return n.select(key, "kind", "path", "pre", (F.col("pre") + F.col("below") - F.col("depth")).alias("post"), "depth", parent.alias("parent_pre"), "pos", "name", value.alias("value"), "number", "item")


# ---------------------------------------------------------------- node tables
def node_table(nodes: DataFrame, key: str, kinds: Column) -> DataFrame:
    """The nodes of some kinds as a table of their own, with the place of each in its parent."""
    return nodes.where(kinds).select(key, "path", "pre", "post", "depth", "parent_pre", "pos", "name", "value")


def write_node_tables(nodes: DataFrame, path: str) -> None:
    """All node tables at once, in one pass over the records: a folder of Parquet files for each ``kind``."""
    nodes.select("kind", *[c for c in nodes.columns if c != "kind"]).where("kind <> ''").write.partitionBy("kind").mode("overwrite").parquet(path)


def contained(outer: DataFrame, inner: DataFrame, key: str) -> DataFrame:
    """Pairs (outer, inner) of nodes of one record where the second lies inside the first, by interval containment.

    The nodes of a record are swept in pre-order with a stack of those whose interval is open, so each costs only the
    outer nodes it lies in, not all of the record. Both sides have ``key, path, pre, post``.
    """
    both = outer.select(key, "path", "pre", "post", F.lit(True).alias("outer")).unionByName(inner.select(key, "path", "pre", "post", F.lit(False).alias("outer")))
    schema = StructType([outer.schema[key], *StructType.fromDDL("outer_path string, inner_path string")])
    arrow = to_arrow_schema(schema)

    def sweep(record: tuple, nodes: pa.Table) -> pa.Table:
        rows = sorted(zip(*(nodes[c].to_pylist() for c in ("pre", "outer", "post", "path")), strict=True))
        stack: list[tuple] = []
        outers, inners = [], []
        for pre, is_outer, post, path in rows:
            # Open nodes began before; they hold this one if they end after it.
            while stack and stack[-1][1] <= post and stack[-1][0] != pre:
                stack.pop()
            if is_outer:
                stack.append((pre, post, path))
            else:
                holds = [p for b, e, p in stack if b < pre and post < e]
                outers.extend(holds)
                inners.extend([path] * len(holds))
        return pa.table([pa.array([record[0].as_py()] * len(outers), arrow.field(0).type), pa.array(outers, pa.string()), pa.array(inners, pa.string())], schema=arrow)

    return both.groupBy(key).applyInArrow(sweep, schema)
