"""Court decisions in XML to the decision table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from topicloom.operators.levels import level_index
from topicloom.schema import DECISIONS
from topicloom.sources.lexer import record_texts
from topicloom.stash import broadcast_if_small, row_count, stash

# Names in the XML documents.
ROW_TAG = "snintegrale"
FINAL_DECISION = "S"


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


# One element per decision; "_" marks an attribute. `sic` may hold children or attributes
# only, which the same struct covers. The leaves occur under a long and a short name.
XML_RECORD = T.StructType(
    _strings("_tipoprov", "_anno", "_numdec", "_nsz")
    + [
        T.StructField(
            "sic",
            T.StructType(
                _strings(
                    "_anno_nrg", "_nrg", "_anno_prov", "_num_provv", "_autorita", "_localita", "_materia"
                )
            ),
        )
    ]
    + _strings("testo", "tes", "dispositivo", "dis")
)

# Encodings whose every byte is a character and whose first half is ASCII.
SINGLE_BYTE = ["us-ascii"] + [f"iso-8859-{n}" for n in range(1, 17) if n != 12] + [f"windows-{n}" for n in range(1250, 1259)]

# Marks of a file, in chunks cut before its closing tags. One with a document type, a longer tag name or bytes
# that are no text is read by one task; one with comments, CDATA sections or blanks in closing tags is lexed.
WHOLE_PATTERN = r"(?s)<!(?!--|\[CDATA\[)|\A[-\w.:]|\x{00}"
LEXED_PATTERN = r"<!--|<!\[CDATA\[|\A\s+>"
ENCODING_PATTERN = r"\A\x{FEFF}?<\?xml[^>]*\sencoding\s*=\s*[\"']([^\"']+)"
OPENING_PATTERN = rf"<{ROW_TAG}(?:\s[^>]*)?(?<!/)>"

# An empty element, or an opening tag up to the end of the chunk it was cut from.
RECORD_PATTERN = rf"(?s)<{ROW_TAG}(?:\s[^>]*)?/>|<{ROW_TAG}(?:\s[^>]*)?>.*?</{ROW_TAG}>"

# Equal rows that one task writes out again.
COPIES = 10_000

XML_OPTIONS = {"ignoreSurroundingSpaces": "false"}


def delete_first_star(text: Column) -> Column:
    """Remove the first literal ``*``."""
    return F.regexp_replace(text, r"^([^*]*)\*", "$1")


def latin1_or_null(text: Column) -> Column:
    """The text, or null when a character has no latin1 form."""
    return F.when(~text.rlike(r"[^\x{00}-\x{FF}]"), text)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def repeated_ids(decisions: DataFrame) -> DataFrame:
    """``(doc_id, n)`` of ids under which there are several rows."""
    many = decisions.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    return stash(many, "repeated-ids")


def with_unique_ids(decisions: DataFrame, many: DataFrame | None = None) -> DataFrame:
    """``decisions`` with ids that occur once; ``many`` are their repeated ids, where these are known.

    Of rows under one natural id the first in the order of their hashed content keeps it; the others
    get an id hashed from it, their content and their place among equal rows. Equal rows are counted and written out
    again, ``COPIES`` to a stretch, so no task holds all rows of an id or all copies of a row.
    """
    many = repeated_ids(decisions) if many is None else many
    if not row_count(many):
        return decisions
    ids = broadcast_if_small(many.select("doc_id"))
    single = decisions.join(ids, "doc_id", "left_anti")
    content = [c for c in decisions.columns if c != "doc_id"]
    code = F.xxhash64(*[x for c in content for x in (F.col(c).isNull(), F.col(c))])
    kinds = decisions.join(ids, "doc_id", "left_semi").groupBy("doc_id", *content).agg(F.count("*").alias("n"))
    kinds = stash(kinds.withColumn("content", code), "repeated-rows")
    least = stash(kinds.groupBy("doc_id").agg(F.min("content").alias("least")), "first-rows")
    stretch = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES).cast("int")))
    stretches = kinds.withColumn("stretch", stretch).repartition("doc_id", "content", "stretch")
    copy = F.explode(F.sequence(F.col("stretch") * COPIES + 1, F.least(F.col("n"), (F.col("stretch") + 1) * COPIES)))
    placed = stretches.withColumn("copy", copy).join(broadcast_if_small(least), "doc_id")
    first = (F.col("content") == F.col("least")) & (F.col("copy") == 1)
    fresh = F.when(first, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "content", "copy"))
    return single.unionByName(placed.withColumn("doc_id", fresh).select(*decisions.columns))


def final_decisions(records: DataFrame) -> DataFrame:
    """Records whose type is a final decision; a record without type is dropped."""
    return records.where(F.col("_tipoprov") == FINAL_DECISION)


def ruling_of() -> Column:
    return F.coalesce("dispositivo", "dis")


def has_ruling() -> Column:
    return F.nullif(F.trim(ruling_of()), F.lit("")).isNotNull()


def flatten_decisions(records: DataFrame, file_name: Column, latin1: bool = False) -> DataFrame:
    """Decision columns (without ``id_materia``) of parsed records, one row per record.

    A record without a ruling keeps its row and ``doc_id`` but every other column is null.
    ``doc_id`` hashes the raw year, number, section and file name without its folder.
    """
    ruling, ruled = ruling_of(), has_ruling()
    body = F.coalesce("testo", "tes")
    if latin1:
        body, ruling = latin1_or_null(body), latin1_or_null(ruling)

    def attribute(name: str) -> Column:
        return F.col(f"sic._{name}")

    values = {
        "tipo_prov": F.col("_tipoprov"),
        "anno_dec": F.col("_anno"),
        "num_dec": F.col("_numdec"),
        "num_sez": F.col("_nsz"),
        "testo": body,
        "dispositivo": ruling,
        "anno_nrg_sic": attribute("anno_nrg"),
        "nrg_sic": attribute("nrg"),
        "anno_prov_orig": attribute("anno_prov"),
        "num_prov_orig": attribute("num_provv"),
        "autorita": attribute("autorita"),
        "localita": attribute("localita"),
        "materia": delete_first_star(attribute("materia")),
    }
    columns = [F.xxhash64("_anno", "_numdec", "_nsz", base_name(file_name)).alias("doc_id")]
    for name, value in values.items():
        typed = value.try_cast(DECISIONS[name].dataType)
        columns.append(F.when(ruled, typed).alias(name))
    return records.select(*columns)


def with_subject_index(decisions: DataFrame) -> DataFrame:
    """Add ``id_materia``: position of ``materia`` among the sorted distinct subjects, from 1."""
    levels = level_index(decisions, "materia").select(
        "materia", (F.col("ix") + 1).cast("int").alias("id_materia")
    )
    return decisions.join(broadcast_if_small(levels), "materia", "left").select(
        *DECISIONS.fieldNames()
    )


def parse_decisions(rows: DataFrame, xml: str, latin1: bool = False) -> DataFrame:
    """Decision columns from a string column that holds one record per row."""
    parsed = rows.select(F.from_xml(F.col(xml), XML_RECORD.simpleString(), XML_OPTIONS).alias("r"))
    return flatten_decisions(final_decisions(parsed.select("r.*")), F.lit(""), latin1)


def _records_by_file(spark: SparkSession, path: str | list[str]) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", ROW_TAG).options(**XML_OPTIONS)
    records = reader.schema(XML_RECORD).load(path)
    return records.select("*", F.col("_metadata.file_path").alias("file"))


@dataclass(frozen=True)
class FileKinds:
    """Files that may be cut at the closing tag, files to lex by their encoding, files that one task must read."""

    plain: list[str]
    lexed: dict[str, list[str]]
    whole: list[str]


def file_kinds(spark: SparkSession, path: str) -> FileKinds:
    """How each file under ``path`` can be read.

    One pass over the text, cut before closing tags, looks for anything that makes a cut there differ from what
    an XML parser reads, and counts opening against closing tags. The driver gets file
    names only, which Spark's own file index holds there anyway.
    """
    chunks = spark.read.option("lineSep", f"</{ROW_TAG}").text(path)
    opened = F.size(F.regexp_extract_all("value", F.lit(OPENING_PATTERN), F.lit(0)))
    marks = chunks.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("value").rlike(WHOLE_PATTERN).alias("whole"),
        F.col("value").rlike(LEXED_PATTERN).alias("lexed"),
        F.lower(F.regexp_extract("value", ENCODING_PATTERN, 1)).alias("encoding"),
        opened.alias("opened"),
    )
    files = marks.groupBy("file").agg(*[F.max(c).alias(c) for c in ("whole", "lexed", "encoding", "opened")]).collect()
    plain, lexed, whole = [], {}, []
    for file, odd, marked, declared, most in sorted(files):
        encoding = declared or "utf-8"
        utf8 = encoding in ("utf-8", "utf8")
        if odd or not (utf8 or encoding in SINGLE_BYTE) or (most > 1 and not marked and utf8):
            whole.append(file)
        elif marked or not utf8:
            lexed.setdefault(encoding, []).append(file)
        else:
            plain.append(file)
    return FileKinds(plain, lexed, whole)


def _elements(texts: DataFrame, text: Column) -> DataFrame:
    """Parsed records of ``(file, text)`` rows."""
    elements = F.regexp_extract_all(text, F.lit(RECORD_PATTERN), F.lit(0))
    element = texts.select(F.explode_outer(elements).alias("xml"), "file").where(F.col("xml").isNotNull())
    record = F.from_xml("xml", XML_RECORD.simpleString(), XML_OPTIONS)
    return element.select(record.alias("r"), "file").select("r.*", "file")


def lexed_records(spark: SparkSession, files: dict[str, list[str]]) -> tuple[DataFrame, list[str]]:
    """Records of the files to lex, and those of them, left out of it, that hold a record within a record."""
    texts = [record_texts(spark, names, ROW_TAG, encoding) for encoding, names in files.items()]
    texts = reduce(DataFrame.unionByName, texts)
    opened = F.size(F.regexp_extract_all("text", F.lit(OPENING_PATTERN), F.lit(0)))
    nested = sorted(r[0] for r in texts.where(opened > 1).select("file").distinct().collect())
    if nested:
        texts = texts.where(~F.col("file").isin(nested))
    return _elements(texts, F.col("text")), nested


def split_records(reader: DataFrameReader | DataStreamReader, path: str | list[str]) -> DataFrame:
    """Records of UTF-8 files, cut at the closing tag so that a file spreads over many tasks."""
    chunks = reader.option("lineSep", f"</{ROW_TAG}>").text(path)
    texts = chunks.select("value", F.col("_metadata.file_path").alias("file"))
    return _elements(texts, F.concat("value", F.lit(f"</{ROW_TAG}>")))


def scan_decisions(
    spark: SparkSession,
    path: str,
    latin1: bool = False,
    split_files: bool = True,
    seen: Observation | None = None,
) -> DataFrame:
    """Decision columns of the XML files under ``path``.

    With ``split_files`` one file may be read by many tasks, so a single huge file is no
    bottleneck. A pass over the text tells how: plain files are cut at the closing tag; files with comments, CDATA
    sections or a declared single-byte encoding are lexed by splits (``sources/lexer.py``). Only files with a
    document type, records within records or another encoding are read by the XML source, one task
    each. Without it all files are read that way. The rows are the same.
    ``seen`` observes the records as they pass by (see ``ReadReport``).
    """
    if split_files:
        kinds = file_kinds(spark, path)
        found, whole = [], kinds.whole
        if kinds.plain:
            found.append(split_records(spark.read, kinds.plain))
        if kinds.lexed:
            lexed, nested = lexed_records(spark, kinds.lexed)
            found.append(lexed)
            whole = whole + nested
        if whole or not found:
            found.append(_records_by_file(spark, whole or path))
        records = reduce(DataFrame.unionByName, found)
    else:
        records = _records_by_file(spark, path)
    if seen is not None:
        records = records.observe(seen, *facts_of_records())
    return flatten_decisions(final_decisions(records), F.col("file"), latin1)


@dataclass(frozen=True)
class ReadReport:
    """What a reading found, dropped and left empty.

    All but ``repeated_ids`` is observed in the one pass that parses the records and writes them down.
    """

    records: int
    other_types: int
    untyped: int
    without_ruling: int
    unlabelled: int
    repeated_ids: int


def facts_of_records() -> list[Column]:
    """Counts over raw records: those of a ``ReadReport`` that one pass can tell."""
    final = F.col("_tipoprov") == FINAL_DECISION
    return [
        F.count(F.lit(1)).alias("records"),
        F.count_if(~final).alias("other_types"),
        F.count_if(F.col("_tipoprov").isNull()).alias("untyped"),
        F.count_if(final & ~has_ruling()).alias("without_ruling"),
        F.count_if(final & (~has_ruling() | F.col("sic._materia").isNull())).alias("unlabelled"),
    ]


def read_reported(
    spark: SparkSession, path: str, latin1: bool = False, split_files: bool = True
) -> tuple[DataFrame, ReadReport]:
    """The full decision table of the XML files under ``path``, and a report of the reading.

    The files are parsed once, into the shared folder; numbering the subjects reads one
    column of that table, and so does counting repeated ids. ``unlabelled`` are final decisions without a subject,
    which no later step can classify; ``repeated_ids`` are rows that got an id of their own.
    """
    seen = Observation()
    scanned = stash(scan_decisions(spark, path, latin1, split_files, seen), "decisions")
    many = repeated_ids(scanned)
    again = many.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
    report = ReadReport(**seen.get, repeated_ids=again)
    return with_subject_index(with_unique_ids(scanned, many)), report


def read_decisions(
    spark: SparkSession, path: str, latin1: bool = False, split_files: bool = True
) -> DataFrame:
    """The full decision table of the XML files under ``path``; see ``read_reported``."""
    return read_reported(spark, path, latin1, split_files)[0]
