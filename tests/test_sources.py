from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from topicloom.plans.reduce import reduce_dtm
from topicloom.sources.corpus import decisions_to_corpus, duplicate_ids
from topicloom.sources.decisions import (
    ReadReport,
    delete_first_star,
    file_kinds,
    latin1_or_null,
    read_decisions,
    read_reported,
    scan_decisions,
    with_unique_ids,
)
from topicloom.sources.exports import export_corpus
from topicloom.operators.dtm import corpus_to_dtm

XML = """<?xml version="1.0" encoding="UTF-8"?>
<root>
<other tipoprov="S" anno="1999"><testo>ignored</testo><dispositivo>x</dispositivo></other>
<snintegrale tipoprov="S" anno="2013" numdec="11" nsz="L">
 <sic anno_nrg="2010" nrg="5" anno_prov="n.d." num_provv="7" autorita="CDA" localita="ROMA" materia="*a*b"/>
 <testo>Corpo &amp; testo
della decisione</testo>
 <dispositivo>rigetta</dispositivo>
</snintegrale>
<snintegrale tipoprov="O" anno="2013" numdec="12" nsz="L"><tes>t</tes><dis>d</dis></snintegrale>
<snintegrale tipoprov="S" anno="2013" numdec="13" nsz="1">
 <sic anno_nrg="2011" nrg="6"><x>1</x></sic><testo>senza dispositivo</testo>
</snintegrale>
<snintegrale tipoprov="S" anno="2012" numdec="14" nsz="1"><tes>corto</tes><dis/></snintegrale>
<snintegrale tipoprov="S" anno="2012" numdec="15" nsz="2">
 <sic anno_nrg="2009" nrg="8" materia="c"><x>1</x></sic><tes>prezzo €</tes><dis>accoglie</dis>
</snintegrale>
<snintegrale anno="2012" numdec="16" nsz="2"><tes>senza tipo</tes><dis>d</dis></snintegrale>
</root>
"""


@pytest.fixture(scope="module")
def xml_path(tmp_path_factory):
    path = tmp_path_factory.mktemp("xml") / "decisions.xml"
    path.write_text(XML, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("split_files", [True, False])
def test_decisions_from_xml(spark, xml_path, split_files):
    rows = read_decisions(spark, xml_path, split_files=split_files).collect()
    assert len(rows) == 4 and len({r.doc_id for r in rows}) == 4
    empty = [r for r in rows if r.tipo_prov is None]
    assert len(empty) == 2
    assert all(v is None for r in empty for name, v in r.asDict().items() if name != "doc_id")
    first = next(r for r in rows if r.num_dec == 11)
    assert first.anno_dec == 2013 and first.num_sez == "L" and first.anno_nrg_sic == 2010
    assert first.anno_prov_orig is None and first.num_prov_orig == "7"
    assert first.testo == "Corpo & testo\ndella decisione" and first.dispositivo == "rigetta"
    assert first.materia == "a*b" and first.id_materia == 1
    last = next(r for r in rows if r.num_dec == 15)
    assert last.testo == "prezzo €" and last.nrg_sic == "8" and last.id_materia == 2


def test_small_splits_do_not_cut_records(spark, tmp_path):
    """One file read by many tasks gives the same records as read by one."""
    record = (
        '<snintegrale tipoprov="S" anno="2013" numdec="{i}" nsz="L"><testo>{t}</testo>'
        "<dispositivo>d</dispositivo></snintegrale>"
    )
    body = "\n".join(record.format(i=i, t="parola " * (i % 50)) for i in range(400))
    path = tmp_path / "big.xml"
    path.write_text(f"<root>\n{body}\n</root>\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        split = scan_decisions(spark, str(path))
        assert split.rdd.getNumPartitions() > 8
        whole = scan_decisions(spark, str(path), split_files=False)
        assert sorted(split.collect()) == sorted(whole.collect())
        assert split.count() == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


RECORD = (
    '<snintegrale tipoprov="S" anno="2013" numdec="{n}" nsz="L"><testo>{t}</testo>'
    "<dispositivo>d</dispositivo></snintegrale>"
)


def _three(middle: str) -> str:
    return "<root>\n" + RECORD.format(n=1, t="uno") + middle + RECORD.format(n=3, t="tre") + "\n</root>"


@pytest.mark.parametrize(
    ("middle", "encoding", "texts"),
    [
        (RECORD.format(n=2, t="due").replace("</snintegrale>", "</snintegrale >"), None, ["due", "tre", "uno"]),
        ("<!-- " + RECORD.format(n=2, t="due") + " -->", None, ["tre", "uno"]),
        (RECORD.format(n=2, t="<![CDATA[due </snintegrale>]]>"), None, ["due </snintegrale>", "tre", "uno"]),
        (RECORD.format(n=2, t="città"), "ISO-8859-1", ["città", "tre", "uno"]),
        (RECORD.format(n=2, t="città"), "utf-8", ["città", "tre", "uno"]),
        (RECORD.format(n=2, t="città €"), "windows-1252", ["città €", "tre", "uno"]),
        (RECORD.format(n=2, t="prima<!-- </snintegrale> --> dopo"), "ISO-8859-1", ["prima dopo", "tre", "uno"]),
        (RECORD.format(n=2, t="due"), "utf-16", ["due", "tre", "uno"]),
    ],
)
def test_no_record_is_lost_by_cutting(spark, tmp_path, middle, encoding, texts):
    head = f'<?xml version="1.0" encoding="{encoding}"?>\n' if encoding else ""
    (tmp_path / "a.xml").write_text(head + _three(middle), encoding=encoding or "utf-8")
    (tmp_path / "b.xml").write_text(_three(""), encoding="utf-8")
    expected = sorted(texts + ["uno", "tre"])
    assert sorted(r.testo for r in scan_decisions(spark, str(tmp_path)).collect()) == expected
    whole = scan_decisions(spark, str(tmp_path), split_files=False)
    assert sorted(r.testo for r in whole.collect()) == expected


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("encoding", ["utf-8", "ISO-8859-1"])
def test_comments_and_cdata_across_splits(spark, tmp_path, small_splits, encoding):
    """One file, in many tasks, with comments and CDATA sections longer than a split that hold closing tags."""
    decoy = RECORD.format(n=0, t="no")
    texts, body = [], []
    for i in range(300):
        text = f"città {i} " + "parola " * (i % 40)
        if i % 7 == 0:
            body.append("<!-- " + decoy * (60 if i % 70 == 0 else 1) + " -->")
        if i % 11 == 0:
            inside = "x </snintegrale> & y " * (400 if i % 110 == 0 else 1)
            body.append(RECORD.format(n=i, t=f"{text}<![CDATA[{inside}]]>"))
            text += inside
        else:
            body.append(RECORD.format(n=i, t=text).replace("</snintegrale>", "</snintegrale\n>" if i % 5 else "</snintegrale>"))
        texts.append((i, text))
    head = f'<?xml version="1.0" encoding="{encoding}"?>\n<?note <!-- ?>\n<root>\n'
    path = tmp_path / "one.xml"
    path.write_bytes((head + "\n".join(body) + "\n</root>").encode(encoding))
    kinds = file_kinds(spark, str(path))
    assert kinds.plain == kinds.whole == [] and list(kinds.lexed) == [encoding.lower()]
    assert spark.read.option("lineSep", "</snintegrale").text(str(path)).rdd.getNumPartitions() > 8
    assert sorted((r.num_dec, r.testo) for r in scan_decisions(spark, str(path)).collect()) == texts


def test_a_file_that_cannot_be_cut_is_read_whole(spark, tmp_path):
    (tmp_path / "type.xml").write_text("<!DOCTYPE root>" + _three(""))
    (tmp_path / "nested.xml").write_text("<root><!-- x --><snintegrale><snintegrale/>" + RECORD.format(n=9, t="in") + "</snintegrale></root>")
    (tmp_path / "plain.xml").write_text(_three(""))
    kinds = file_kinds(spark, str(tmp_path))
    assert [len(kinds.plain), len(kinds.whole)] == [1, 1] and list(kinds.lexed) == ["utf-8"]
    whole = scan_decisions(spark, str(tmp_path), split_files=False)
    assert sorted(scan_decisions(spark, str(tmp_path)).collect()) == sorted(whole.collect())


def test_ids_are_unique_and_survive_a_move(spark, tmp_path):
    same = RECORD.format(n=1, t="uno") + RECORD.format(n=1, t="due") + RECORD.format(n=1, t="due")
    found = []
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.xml").write_text(f"<root>{same}</root>", encoding="utf-8")
        rows = read_decisions(spark, str(tmp_path / folder)).collect()
        assert len({r.doc_id for r in rows}) == 3
        found.append(sorted((r.doc_id, r.testo) for r in rows))
    assert found[0] == found[1]


def test_a_report_of_the_reading(spark, xml_path):
    decisions, report = read_reported(spark, xml_path)
    assert decisions.count() == 4
    assert report == ReadReport(records=6, other_types=1, untyped=1, without_ruling=2, unlabelled=2, repeated_ids=0)


def test_many_copies_of_a_row(spark, monkeypatch):
    monkeypatch.setattr("topicloom.sources.decisions.COPIES", 3)
    rows = [(1, "a", None)] * 10 + [(1, "b", "x")] * 2 + [(2, None, "y")]
    found = with_unique_ids(spark.createDataFrame(rows, "doc_id long, testo string, materia string")).collect()
    assert len({r.doc_id for r in found}) == 13 and {1, 2} <= {r.doc_id for r in found}
    assert sorted(str(tuple(r)[1:]) for r in found) == sorted(str(r[1:]) for r in rows)


def test_star_and_latin1(spark):
    rows = [("*a*b",), ("a*b",), ("ab",), (None,)]
    df = spark.createDataFrame(rows, "v string").select(delete_first_star(F.col("v")))
    assert [r[0] for r in df.collect()] == ["a*b", "ab", "ab", None]
    df = spark.createDataFrame([("caffè",), ("prezzo €",)], "v string").select(latin1_or_null(F.col("v")))
    assert [r[0] for r in df.collect()] == ["caffè", None]


def test_corpus_metadata(spark, xml_path):
    corpus = decisions_to_corpus(read_decisions(spark, xml_path))
    row = corpus.where(F.col("NumeroDecisione") == 11).first()
    assert row.lang == "it" and row.heading == row.Materia == "a*b" and row.Dispositivo == "rigetta"
    assert row.Id_doc == row.doc_id
    assert duplicate_ids(corpus).count() == 0
    own = decisions_to_corpus(read_decisions(spark, xml_path), {"anno": "anno_dec"}, language="la")
    assert own.columns == ["doc_id", "text", "lang", "anno"]
    with pytest.raises(ValueError, match="lacks column"):
        decisions_to_corpus(spark.range(1).withColumnRenamed("id", "doc_id"))


def test_corpus_export(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "uno\ndue"), (2, None)], "doc_id long, text string")
    export_corpus(corpus, str(tmp_path / "text"))
    files = list((tmp_path / "text" / "doc_id=1").glob("*.txt"))
    assert [f.read_text() for f in files] == ["uno\ndue\n"]
    export_corpus(corpus, str(tmp_path / "parquet"), as_text=False)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2


def test_corpus_export_writes_nothing_but_texts(spark, tmp_path):
    """One file a document and none beside it; odd ids come back, and equal ids keep a file each."""
    rows = [("a/b=c %", "uno"), ("x", "due"), ("x", "tre\n"), (None, "quattro"), ("y[1]", None)]
    out = tmp_path / "text"
    export_corpus(spark.createDataFrame(rows, "doc_id string, text string").coalesce(1), str(out))
    files = [f for f in out.rglob("*") if f.is_file() and f.parent != out]
    assert len(files) == len(rows) and {f.suffix for f in files} == {".txt"}
    back = spark.read.schema("value string, doc_id string").text(str(out), wholetext=True)
    assert {(r.doc_id, r.value) for r in back.collect()} == {(key, f"{text or ''}\n") for key, text in rows}
    with pytest.raises(FileExistsError):
        export_corpus(spark.createDataFrame(rows, "doc_id string, text string"), str(out))


def test_reduction_export(spark, tmp_path):
    words = "alfa beta gamma delta kappa lambda sigma omega".split()
    rows = [(i, " ".join(words[: 1 + i % len(words)] * (1 + i % 3))) for i in range(40)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string")
    made = corpus_to_dtm(corpus)
    found = reduce_dtm(made, "tfidf", out_dir=str(tmp_path))
    assert found.call["method"] == "tfidf"
    kept = [r.value for r in spark.read.text(str(tmp_path / "tfidf" / "vocabulary")).collect()]
    gone = [r.value for r in spark.read.text(str(tmp_path / "tfidf" / "discarded_terms")).collect()]
    assert kept and sorted(kept + gone) == sorted(r.term for r in made.vocabulary.collect())
    entries = spark.read.parquet(str(tmp_path / "tfidf" / "entries"))
    assert sorted(entries.collect()) == sorted(found.reduced.entries.collect())
    with pytest.raises(ValueError, match="needs classes"):
        reduce_dtm(made, "lognet")
    with pytest.raises(ValueError, match="method must be"):
        reduce_dtm(made, "other")


def test_streamed_decisions_equal_the_batch(spark, xml_path, tmp_path):
    from pathlib import Path

    from topicloom.streaming.decisions import stream_decisions

    folder = str(Path(xml_path).parent)
    query = (
        stream_decisions(spark, folder)
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = scan_decisions(spark, folder)
    key = ["doc_id"]
    assert streamed.orderBy(key).collect() == batch.orderBy(key).collect()


def test_texts_are_read_without_a_list_of_files_on_the_driver(spark, tmp_path):
    from topicloom.sources.exports import export_corpus, read_texts

    rows = [(1, "a\nb\n"), (2, ""), (3, None), (None, "none"), (-4, "\u00e9 \u4e2d")]
    path = str(tmp_path / "corpus")
    export_corpus(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path)
    (tmp_path / "corpus" / "doc_id=1" / ".part-draft").write_bytes(b"half")
    found = read_texts(spark, path)
    assert found.inputFiles() == []
    got = {(r.doc_id, r.text) for r in found.collect()}
    assert got == {("1", "a\nb\n"), ("2", ""), ("3", ""), ("__HIVE_DEFAULT_PARTITION__", "none"), ("-4", "\u00e9 \u4e2d")}
