import pytest
from graphs import FLEET, RACES, TURTLE
from pyspark.sql import functions as F

from conftest import rows
from triplane.functions.terms import IRI, Prefixes, local_name, local_name_of, sparql_term
from triplane.sources import quads as q
from triplane.sources.turtle import RdfSyntaxError, TurtleReader, read_rdfxml


def test_turtle_forms():
    text = """@base <http://x/> . @prefix p: <http://p/> .
    <a> p:b 1, 2.5, 1e3, true, "t\\u00e9\\n", '''long "q" text'''@EN ; p:c [ p:d "x"^^p:t ], _:n ; a p:K . # comment
    <list> p:items ( 1 <two> ) ."""
    got = TurtleReader(text, "g").read()
    assert {(x.p.removeprefix("http://p/"), x.o.text, (x.o.datatype or "").rpartition("#")[2] or x.o.datatype) for x in got if x.p == "http://p/b"} == {
        ("b", "1", "integer"), ("b", "2.5", "decimal"), ("b", "1e3", "double"), ("b", "true", "boolean"), ("b", "té\n", "string"), ("b", 'long "q" text', "langString")}
    assert sum(x.p.endswith("first") for x in got) == 2 and sum(x.o.kind == 2 for x in got if x.p == "http://p/c") == 2


def test_trig_blocks_keep_graphs():
    got = TurtleReader("@prefix p: <http://p/> . p:g { p:a p:b p:c . p:d p:b p:e } GRAPH <h> { p:a p:b 1 } p:x p:y p:z .", "dflt").read()
    assert [x.g for x in got] == ["http://p/g", "http://p/g", "h", "dflt"]


@pytest.mark.parametrize("bad", ["<a> <b> .", "<a> p:b 1 .", '<a> <b> "open .', "<a> <b> <c>"])
def test_bad_turtle_is_an_error(bad):
    with pytest.raises(RdfSyntaxError):
        TurtleReader(bad).read()


def test_rdfxml():
    text = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><e:Boat rdf:about="http://b/1" e:name="Gull">
      <e:size rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">9</e:size><e:yard rdf:resource="http://y/1"/><e:part><e:Sail/></e:part></e:Boat></rdf:RDF>"""
    got = list(read_rdfxml(text, "g"))
    assert {(x.p, x.o.text) for x in got if x.o.kind != 2 and x.s.kind == 0} == {("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://e/Boat"), ("http://e/name", "Gull"), ("http://e/size", "9"), ("http://e/yard", "http://y/1")}


def test_nquads_lines(spark, tmp_path):
    (tmp_path / "a.nq").write_text('<http://a> <http://p> "x\\"\\u00e9\\\\"@EN-gb <http://g> .\n_:b <http://p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> . # c\n# comment\n\nno statement\n<http://a> <http://p> _:b .\n')
    got = q.typed(q.read_rdf(spark, str(tmp_path / "a.nq"), "d"))
    assert rows(got, "g", "o", "o_kind", "o_lang", "o_num") == sorted([("d", "5", 1, None, 5.0), ("d", "_:b", 2, None, None), ("http://g", 'x"é\\', 1, "en-gb", None)], key=str)
    with pytest.raises(Exception, match="unreadable"):
        q.read_nquads(spark, str(tmp_path / "a.nq"), strict=True).collect()


def test_files_round_trip_and_graph_replacement(spark, tmp_path):
    (tmp_path / "f.ttl").write_text(TURTLE)
    (tmp_path / "r.ttl").write_text(RACES)
    store = str(tmp_path / "store")
    assert q.store_is_empty(spark, store)
    first = q.read_rdf(spark, str(tmp_path / "f.ttl"), FLEET)
    q.save_quads(first.unionByName(q.read_rdf(spark, str(tmp_path / "r.ttl"), "old")), store)
    q.save_quads(q.read_rdf(spark, str(tmp_path / "r.ttl"), "old").limit(3), store)
    counts = dict(rows(q.graph_counts(q.load_quads(spark, store))))
    assert counts == {FLEET: first.count(), "old": 3}
    lines = q.to_lines(q.load_quads(spark, store).where(F.col("g") == FLEET))
    lines.write.text(str(tmp_path / "out.nt"))
    back = q.read_rdf(spark, str(tmp_path / "out.nt"), FLEET)
    assert rows(back, "s", "p", "o") == rows(first, "s", "p", "o")


def test_lines_are_normalised(spark):
    lines = spark.createDataFrame([('<a> <b> "1"^^<old> .',), ("<c> <d> <e> .",), ('<a> <b> "1"^^<old> .',)], "value string")
    assert [r[0] for r in q.normalize_lines(lines.coalesce(1), {"old": "new"}).collect()] == ['<a> <b> "1"^^<new> .', "<c> <d> <e> ."]


def test_bad_literals_stay_text(spark):
    got = q.typed(q.quads_from_text(spark, '@prefix x: <http://www.w3.org/2001/XMLSchema#> . <a> <b> "x"^^x:integer, "2020-13-01"^^x:date, "2020"^^x:gYear, "1"^^x:boolean .'))
    assert rows(got, "o", "o_num", "o_ts", "o_bool")[0][0] == "1" and {r[0] for r in rows(got, "o", "o_num") if r[1] is None} == {"x", "2020-13-01", "1"}


def test_streamed_files_are_added_once(spark, tmp_path):
    from triplane.streaming.ingest import stream_into

    inbox, store = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()
    for n, text in enumerate(("<a> <b> <c> .\n<a> <b> <d> .\n", "<a> <b> <d> .\n<a> <b> <e> .\n")):
        (inbox / f"{n}.nt").write_text(text)
        stream_into(spark, str(inbox), "g", store, str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r["o"] for r in q.load_quads(spark, store).collect()) == ["c", "d", "e"]


def test_names_and_terms(spark):
    p = Prefixes(a="http://a/", ab="http://a/b#")
    assert p.compact("http://a/b#c") == "ab:c" and p.compact("http://z/1") == "<http://z/1>" and p.expand("ab:c") == "http://a/b#c"
    assert [local_name(x) for x in ("http://a/b#c", "http://a/b", "urn:x:y", "plain")] == ["c", "b", "y", "plain"]
    df = spark.createDataFrame([("http://a/b#c",), ("http://a/b",), ("urn:x:y",)], "i string")
    assert rows(df.select(local_name_of(F.col("i")))) == [("b",), ("c",), ("y",)]
    assert rows(p.compact_all(df, "i", "c"), "c") == [("<urn:x:y>",), ("a:b",), ("ab:c",)]
    assert [sparql_term(v) for v in (IRI("http://a"), True, 3, 'x"\n')] == ["<http://a>", "true", "3", '"x\\"\\n"']


def test_rejected_lines_and_a_store_moved_aside(spark, tmp_path, monkeypatch):
    lines = spark.createDataFrame([(x,) for x in ("<a:s> <a:p> <a:o> .", "<a:s> <a:p> no .", "# note", "", None, "<a:s> 'x' .")], "value string")
    assert rows(q.rejected_lines(lines)) == [("<a:s> 'x' .",), ("<a:s> <a:p> no .",)] and q.parse_lines(lines).count() == 1
    monkeypatch.setattr(q, "ROWS_A_FILE", 100)
    many = spark.range(1000).select(F.lit("g").alias("g"), F.concat(F.lit("a:"), F.col("id").cast("string")).alias("s"), F.lit("a:type").alias("p"), F.lit("a:C").alias("o"), F.lit(0).alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    store = str(tmp_path / "store")
    q.save_quads(many, store)
    assert len(list((tmp_path / "store/g=g/p=a%3Atype").glob("*.parquet"))) > 1 and q.load_quads(spark, store).count() == 1000
    (tmp_path / "store").rename(tmp_path / "store__last")
    assert q.load_quads(spark, store).count() == 1000


def test_small_files_on_any_storage(spark, tmp_path):
    from triplane.runtime import read_text, write_text

    for path in (f"{tmp_path}/a/x.txt", f"file://{tmp_path}/b/x.txt"):
        assert read_text(path, "none") == "none"
        write_text(path, "ä\n")
        write_text(path, "b\n", append=True)
        assert read_text(path) == "ä\nb\n"
