"""Quads as a DataFrame: reading RDF files, typed companions, layout on disk, writing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .turtle import XSD, TurtleReader, read_rdfxml

#: One row per statement: graph, subject, predicate, object, object's kind (0 IRI, 1 literal, 2 blank), datatype, language.
QUADS = "g string, s string, p string, o string, o_kind int, o_dt string, o_lang string"
#: Companions of the object, NULL where it isn't of the type.
COMPANIONS = ("o_num", "o_ts", "o_bool")

#: Datatypes read as numbers, and as points or periods of time.
NUMERIC = tuple(XSD + t for t in ("integer", "int", "long", "short", "nonNegativeInteger", "positiveInteger", "decimal", "double", "float", "gYear"))
TEMPORAL = tuple(XSD + t for t in ("date", "dateTime", "gYear", "gYearMonth"))

_NODE = r"(?:<([^>]*)>|(_:\S+))"
_LINE = rf'^\s*{_NODE}\s*<([^>]*)>\s*(?:<([^>]*)>|(_:[^\s<]+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^>]*)>)?)\s*(?:<([^>]*)>|(_:\S+))?\s*\.\s*(?:#.*)?$'


def _unescaped(text: Column) -> Column:
    """N-Triples escapes are those of JSON strings but for \\' and \\U; read by the JSON reader where there are any."""
    eight = F.regexp_replace(F.regexp_replace(text, r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1"), r"\\'", "'")
    return F.when(~F.contains(text, F.lit("\\")), text).otherwise(F.coalesce(F.from_json(F.concat(F.lit('{"v":"'), eight, F.lit('"}')), "v string")["v"], text))


def read_nquads(spark: SparkSession, path: str | list[str], graph: str | None = None, strict: bool = False) -> DataFrame:
    """N-Triples or N-Quads files as quads. Files are split and parsed by built-in functions.

    A line's own graph wins over ``graph``. Empty lines and comments are left out; another line that can't be read is
    left out too, and :func:`rejected_lines` has it, or it fails the job with ``strict``. IRIs are taken as they are.
    """
    return parse_lines(spark.read.text(path), graph, strict)


def rejected_lines(lines: DataFrame) -> DataFrame:
    """The lines, in column ``value``, that :func:`parse_lines` leaves out although they say something."""
    return lines.where(F.col("value").isNotNull() & ~F.col("value").rlike(r"^\s*(#.*)?$") & ~F.col("value").rlike(_LINE))


def parse_lines(lines: DataFrame, graph: str | None = None, strict: bool = False) -> DataFrame:
    """Lines of N-Triples or N-Quads, in column ``value``, as quads."""
    lines = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda i: F.nullif(F.regexp_extract("value", _LINE, i), F.lit(""))
    if strict:
        lines = lines.where(F.col("value").rlike(_LINE) | F.raise_error(F.concat(F.lit("unreadable line: "), F.col("value"))).cast("boolean"))
    else:
        lines = lines.where(F.col("value").rlike(_LINE))
    literal = part(4).isNull() & part(5).isNull()
    lang, kind = part(7), part(8)
    return lines.select(
        F.coalesce(part(9), part(10), F.lit(graph)).alias("g"),
        F.coalesce(_unescaped(part(1)), part(2)).alias("s"),
        _unescaped(part(3)).alias("p"),
        F.when(literal, _unescaped(F.regexp_extract("value", _LINE, 6))).otherwise(F.coalesce(_unescaped(part(4)), part(5))).alias("o"),
        F.when(literal, 1).when(part(4).isNotNull(), 0).otherwise(2).alias("o_kind"),
        F.when(literal, F.when(lang.isNotNull(), "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString").otherwise(F.coalesce(kind, F.lit(XSD + "string")))).alias("o_dt"),
        F.lower(lang).alias("o_lang"),
    )


def read_documents(spark: SparkSession, path: str | list[str], graph: str | None = None) -> DataFrame:
    """Turtle, TriG and RDF/XML files (by suffix) as quads. Such files can't be split: a task reads each whole."""
    schema = StructType.fromDDL(QUADS)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, scope = content.decode("utf-8-sig"), f"{zlib.crc32(file.encode()):08x}"
                xml = file.endswith((".rdf", ".owl", ".xml"))
                quads = read_rdfxml(text, graph, scope) if xml else TurtleReader(text, graph, scope=scope).read()
                rows = [(q.g, q.s.text, q.p, q.o.text, q.o.kind, q.o.datatype, q.o.lang and q.o.lang.lower()) for q in quads]
                columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def read_rdf(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """One RDF file or folder as quads, its format by suffix."""
    return read_nquads(spark, path, graph) if path.endswith((".nt", ".nq", ".nt.gz", ".nq.gz")) else read_documents(spark, path, graph)


def quads_from_text(spark: SparkSession, turtle: str, graph: str | None = None) -> DataFrame:
    """Quads of a short Turtle or TriG text."""
    quads = TurtleReader(turtle, graph).read()
    return spark.createDataFrame([(q.g, q.s.text, q.p, q.o.text, q.o.kind, q.o.datatype, q.o.lang and q.o.lang.lower()) for q in quads], QUADS)


def typed(quads: DataFrame) -> DataFrame:
    """Quads with companions. A literal that isn't of its datatype has none, it stays text and fails every comparison."""
    dt, o = F.col("o_dt"), F.col("o")
    day = F.when(dt == XSD + "gYear", F.concat(o, F.lit("-01-01"))).when(dt == XSD + "gYearMonth", F.concat(o, F.lit("-01"))).otherwise(F.regexp_replace(o, "Z$", ""))
    return quads.withColumns(
        {
            "o_num": F.when(dt.isin(*NUMERIC), F.expr("try_cast(o AS double)")),
            "o_ts": F.when(dt.isin(*TEMPORAL), day.try_cast("timestamp_ntz")),
            "o_bool": F.when(dt == XSD + "boolean", F.when(o.isin("true", "1"), True).when(o.isin("false", "0"), False)),
        }
    )


def distinct_quads(quads: DataFrame) -> DataFrame:
    """A store is a set of quads: repeated statements count once."""
    return quads.dropDuplicates(["g", "s", "p", "o", "o_kind", "o_dt", "o_lang"])


#: Statements of one graph and predicate that one task writes into one file.
ROWS_A_FILE = 5_000_000


def save_quads(quads: DataFrame, path: str, replace: bool = True) -> None:
    """Write graphs as Parquet by graph and predicate. ``replace`` drops what the written graphs held before.

    Statements are counted per graph and predicate first; a predicate with many is spread over as many tasks as it
    fills files, by a hash of its subjects, so that one in most statements is no task's alone.
    """
    out = typed(distinct_quads(quads))
    files = quads.groupBy("g", "p").agg(F.ceil(F.count(F.lit(1)) / ROWS_A_FILE).cast("int").alias("files"))
    place = F.pmod(F.xxhash64("s"), F.coalesce("files", F.lit(1))).cast("int")
    # Graphs and predicates are a schema's, so one row for each is a small table.
    out = out.join(files, (out["g"].eqNullSafe(files["g"])) & (out["p"] == files["p"]), "left").select(*[out[c] for c in out.columns], place.alias("file")).repartition("g", "p", "file").drop("file")
    spark = quads.sparkSession
    _recover(spark, path)
    if replace and not store_is_empty(spark, path):
        fresh = [r["g"] for r in quads.select("g").distinct().collect()]  # graphs are modules: few by their nature
        kept = spark.read.parquet(path).where(~F.col("g").isin(fresh))
        staged = path.rstrip("/") + "__next"
        out.unionByName(kept).write.option("maxRecordsPerFile", ROWS_A_FILE).mode("overwrite").partitionBy("g", "p").parquet(staged)
        _swap(spark, staged, path)
    else:
        out.write.option("maxRecordsPerFile", ROWS_A_FILE).mode("append").partitionBy("g", "p").parquet(path)


def _files(spark: SparkSession, path: str) -> tuple:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda end: jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end)
    return at(""), at("__next"), at("__last"), at("").getFileSystem(conf)


def _swap(spark: SparkSession, new: str, old: str) -> None:  # noqa: ARG001
    """The new store in place of the old, which is moved aside first: at every moment one of them is whole."""
    here, fresh, last, fs = _files(spark, old)
    fs.delete(last, True)
    fs.rename(here, last)
    fs.rename(fresh, here)
    fs.delete(last, True)


def _recover(spark: SparkSession, path: str) -> None:
    """Put back a store that was moved aside when the job that replaced it ended."""
    here, _, last, fs = _files(spark, path)
    if not fs.exists(here) and fs.exists(last):
        fs.rename(last, here)


def load_quads(spark: SparkSession, path: str) -> DataFrame:
    _recover(spark, path)
    return spark.read.parquet(path)


def store_is_empty(spark: SparkSession, path: str) -> bool:
    """Whether there is no store at ``path`` or none with a quad in it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return not p.getFileSystem(conf).exists(p) or spark.read.parquet(path).isEmpty()


def graph_counts(quads: DataFrame) -> DataFrame:
    return quads.groupBy("g").agg(F.count(F.lit(1)).alias("triples"))


def _escaped(text: Column) -> Column:
    for sign, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def to_lines(quads: DataFrame, with_graph: bool = False) -> DataFrame:
    """N-Triples (or N-Quads) lines, column ``value``, ready for ``write.text``."""
    node = lambda c, kind: F.when(kind == 2, c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    s_kind = F.when(F.startswith(F.col("s"), F.lit("_:")), 2).otherwise(0)
    plain = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_dt").isNull() | (F.col("o_dt") == XSD + "string"), "").otherwise(F.concat(F.lit("^^<"), F.col("o_dt"), F.lit(">")))
    o = F.when(F.col("o_kind") == 1, F.concat(plain, tail)).otherwise(node(F.col("o"), F.col("o_kind")))
    g = F.when(F.col("g").isNotNull(), F.concat(F.lit("<"), F.col("g"), F.lit("> "))).otherwise("") if with_graph else F.lit("")
    return quads.select(F.concat(node(F.col("s"), s_kind), F.lit(" <"), F.col("p"), F.lit("> "), o, F.lit(" "), g, F.lit(".")).alias("value"))


def normalize_lines(lines: DataFrame, datatypes: dict[str, str]) -> DataFrame:
    """N-Triples lines with datatypes rewritten and repeated lines dropped, first places kept (column ``value``)."""
    value = F.col("value")
    for old, new in datatypes.items():
        value = F.replace(value, F.lit(f"^^<{old}>"), F.lit(f"^^<{new}>"))
    numbered = lines.select(value.alias("value"), F.monotonically_increasing_id().alias("at"))
    return numbered.groupBy("value").agg(F.min("at").alias("at")).orderBy("at").select("value")
