import pytest

from scholia.registry import XML
from scholia.sources.bibliography import parse_record, read_bibliography, records
from scholia.sources.config import parse_suite
from scholia.sources.sinks import details, export


def scan(data, chunk):
    out = []
    for a in range(0, len(data), chunk):
        out += records(lambda x, y: data[x:y], a, min(len(data), a + chunk), len(data))
    return out


@pytest.mark.parametrize("chunk", [*range(1, 120), 400, 10_000])
def test_any_split_gives_the_same_records(chunk):
    data = XML.encode()
    whole = scan(data, len(data))
    assert len(whole) == 4 and scan(data, chunk) == whole


HIDDEN = """<d><!-- <article><title>ghost</title></article> --><article><title>one <![CDATA[see </article> <article> tag]]></title><year>2001</year></article>
<![CDATA[<www><title>no</title></www>]]><!-- a --><!-- b <![CDATA[ --><www><title>two</title><!-- </www> <year>1</year> --><year>2002</year></www><book><title>x <!-- y</title></book>"""


@pytest.mark.parametrize("chunk", [*range(1, 90), 400])
def test_comments_and_cdata_hide_tags(chunk):
    data = HIDDEN.encode()
    got = scan(data, chunk)
    assert [(r["title"], r["year"]) for r in got] == [("one see </article> <article> tag", "2001"), ("two", "2002")]


def test_fields():
    first, second, third, fourth = scan(XML.encode(), 1 << 20)
    assert first["authors"] == ["A B", "C D 0001"] and first["title"] == "Deep Graph nets." and first["journal"] == "J &lt; K" and first["ee"] == "two"
    assert second["title"] == "x<y M&#233;thodes" and second["year"] == "-5"
    assert third["authors"] == ["M&uuml;ller", "A B", "A B"] and third["title"] == "" and third["journal"] == "V"
    assert fourth["title"] == "A & B" and fourth["year"] == "abc"
    assert parse_record(b"<title>a<year>2000</year>")["title"] == "a"


def test_reader(spark, tmp_path):
    path = tmp_path / "d.xml"
    path.write_text(XML)
    docs = read_bibliography(spark, str(path), 50).orderBy("doc_id").collect()
    assert [d["doc_id"] for d in docs] == [0, 1, 2, 3] and [d["year"] for d in docs] == [2020, -5, 0, 0]
    assert [d["doc_length"] for d in docs] == [3, 3, 0, 2]
    (tmp_path / "e.xml").write_text("")
    assert read_bibliography(spark, str(tmp_path / "e.xml")).count() == 0
    assert "authors: A B| C D 0001" in details(docs[0]) and "title" not in details(docs[2]) and "year: 0" in details(docs[2])
    export(read_bibliography(spark, str(path)), str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 4


def test_suite_lines():
    assert parse_suite(["# c", "", "a|b|c d | e", "x|y", "||"]) == [("a", "b", "c d | e")]


def test_stream(spark, tmp_path):
    from scholia.streaming.ingest import index_stream, yearly

    src = str(tmp_path / "in")
    schema = "doc_id long, title string, journal string, year int"
    spark.createDataFrame([(0, "deep graphs", "", 2020)], schema).write.parquet(src)
    spark.createDataFrame([(1, "graphs", "", 2020)], schema).write.mode("append").parquet(src)
    index_stream(spark.readStream.schema(schema).parquet(src), str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    assert {(r["term"], r["freq"]) for r in yearly(spark, str(tmp_path / "ix")).collect()} == {("deep", 1), ("graphs", 2)}
