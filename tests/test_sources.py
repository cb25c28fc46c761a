from conceptflow.sources import readers, writers
from conceptflow.streaming import arrivals


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_paragraph_offsets(spark):
    text = "first one\n\n  second\nline \n \nthird"
    found = readers.paragraphs(spark.createDataFrame([(1, text)], "id int, text string"), "id").orderBy("ordinal").collect()
    assert [r["text"] for r in found] == ["first one", "second\nline", "third"]
    assert all(text[r["start"] : r["stop"]] == r["text"] for r in found)


def test_obo(spark, tmp_path):
    (tmp_path / "a.obo").write_text('format-version: 1.2\n\n[Term]\nid: CL:1\nname: cell\ndef: "A unit." [x]\nsynonym: "unit" EXACT []\n\n[Term]\nid: CL:2\nname: old\nis_obsolete: true\n\n[Typedef]\nid: p\nname: part of\n')
    assert rows(readers.obo(spark, str(tmp_path / "a.obo"))) == [("CL:1", "cell", "A unit.", ["unit"])]


def test_annotations(spark, tmp_path):
    (tmp_path / "a.ann").write_text("T1\tCL:1 0 4\tcell\nT2\tCL:1 0 4;8 9\tx\nR1\tpart Arg1:T1\n")
    assert rows(readers.brat(spark, str(tmp_path / "a.ann"))) == [("T1", "CL:1", 0, 4, "cell")]
    (tmp_path / "a.xml").write_text(
        '<annotations><annotation><mention id="m1"/><span start="0" end="4"/><spannedText>cell</spannedText></annotation>'
        '<annotation><mention id="m2"/><span start="0" end="1"/><span start="3" end="4"/><spannedText>c l</spannedText></annotation>'
        '<classMention id="m1"><mentionClass id="CL:1">cell</mentionClass></classMention></annotations>'
    )
    assert rows(readers.knowtator(spark, str(tmp_path / "a.xml"))) == [("m1", "CL:1", 0, 4, "cell")]
    (tmp_path / "a.tsv").write_text("1-1\t0-4\tstem\tCell[1]\n1-2\t5-9\tcell\tCell[1]\n1-3\t10-12\tis\t_\n")
    assert [r[1:] for r in rows(readers.webanno(spark, str(tmp_path / "a.tsv")))] == [("Cell", 0, 9)]


def test_triples_and_lines(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<a> <p> "x y" .\n# note\n_:b <p> <c> .\n')
    found = readers.ntriples(spark, str(tmp_path / "a.nt"))
    assert rows(found) == [("<a>", "<p>", '"x y"'), ("_:b", "<p>", "<c>")]
    writers.write_lines(writers.nquads(found.selectExpr("s", "p", "o", "'<g>' as g")), str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['<a> <p> "x y" <g> .', "_:b <p> <c> <g> ."]


def test_files_and_first_definition(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.TXT").write_text("día")
    (tmp_path / "b.bin").write_text("x")
    assert [r["text"] for r in readers.plain_text(readers.discover(spark, str(tmp_path))).collect()] == ["día"]
    parts = [spark.createDataFrame([("a", x)], "iri string, label string") for x in ("first", "second")]
    assert rows(readers.first_definition(parts)) == [("a", "first")]


def test_arrivals_append_once(spark, tmp_path):
    target, source = str(tmp_path / "t"), tmp_path / "s"
    spark.range(3).write.parquet(target)
    spark.range(2, 6).write.parquet(str(source))
    query = arrivals.append_new(spark, spark.readStream.schema("id bigint").parquet(str(source)), target, ["id"])
    query.awaitTermination()
    assert [r["id"] for r in spark.read.schema("id bigint").parquet(target).orderBy("id").collect()] == [0, 1, 2, 3, 4, 5]
