"""Sinks: corpus texts, vocabularies, reductions and sweeps under a caller's folder.

A reduction or sweep is many tables. Its manifest is written last, in one job, so a result without one is half
written; ``sources/saved.py`` reads complete ones back.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


MANIFEST = "manifest"

# Reading tasks per core, and folder names and bytes of texts that a task sends on at a time.
READERS, NAMES, READ_BYTES = 4, 10_000, 16 << 20

# What Spark writes in the name of a partition's folder: nulls and empty texts, and characters that are escaped.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


def publish(spark: SparkSession, out_dir: str, what: str, kind: str, tables: list[str], facts: dict) -> None:
    """Write the manifest: what the folder holds, its parquet tables, and facts as texts."""
    row = [(what, kind, tables, {k: str(v) for k, v in facts.items() if v is not None})]
    schema = "what string, kind string, tables array<string>, facts map<string, string>"
    spark.createDataFrame(row, schema).coalesce(1).write.json(f"{out_dir}/{MANIFEST}")


def export_corpus(corpus: DataFrame, out_dir: str, as_text: bool = True) -> None:
    """Write one text file per document, or with ``as_text`` off the whole table as parquet.

    As text, each document lands in its own ``doc_id=...`` folder, closed by a line end. That
    suits people and small corpora; parquet suits large ones. The caller chooses. On a file system that is
    mounted as ``file:``, tasks write the files themselves: there Spark's writer starts processes for every file
    to set its mode, and its driver then moves the folders one by one.
    """
    if not as_text:
        corpus.write.parquet(out_dir)
        return
    texts = corpus.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = corpus.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(out_dir)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getUri().getScheme() != "file":
        texts.write.partitionBy("doc_id").text(out_dir)
        return
    if files.exists(where):
        raise FileExistsError(f"{out_dir} exists already")
    files.mkdirs(where)
    ordered = texts.select(F.col("doc_id").cast("string"), F.col("text").cast("binary")).sortWithinPartitions("doc_id")
    ordered.mapInArrow(file_writer(files.makeQualified(where).toUri().getPath()), "n long").agg(F.sum("n")).collect()
    files.create(files.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(out_dir, "_SUCCESS"))).close()


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, text)`` from the files of a text export, ids as written in the names of their folders.

    On a file system mounted as ``file:``, a task lists the folders and sends their names on, and tasks read the files:
    Spark's reader holds the status of every file on the driver. It is used under other schemes.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getUri().getScheme() != "file":
        texts = spark.read.schema("value string").option("recursiveFileLookup", True).text(folder, wholetext=True)
        doc_id = F.regexp_extract("_metadata.file_path", "/doc_id=([^/]*)/[^/]*$", 1)
        return texts.select(doc_id.alias("doc_id"), closed("value").alias("text"))
    if not files.exists(where):
        raise FileNotFoundError(folder)
    path = files.makeQualified(where).toUri().getPath()
    names = spark.range(1, numPartitions=1).mapInArrow(folder_lister(path), "name string")
    spread = names.repartition(READERS * spark.sparkContext.defaultParallelism)
    texts = spread.mapInArrow(file_reader(path), "doc_id string, value binary")
    return texts.select("doc_id", closed(F.col("value").cast("string")).alias("text"))


def closed(text: Column | str) -> Column:
    """A file's text without the line end that closes it."""
    return F.regexp_replace(text, r"\n\z", "")


def folder_lister(path: str):
    """A function that sends the names of the folders below the mounted ``path`` as it comes upon them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):
                with os.scandir(path) as entries:
                    names = (entry.name for entry in entries if entry.name.startswith("doc_id="))
                    while part := list(itertools.islice(names, NAMES)):
                        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["name"])

    return run


def file_reader(path: str):
    """A function that reads the files of batches of folder names below the mounted ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for file in sorted(os.listdir(f"{path}/{name}")):
                    if file[0] in "._":
                        continue
                    with open(f"{path}/{name}/{file}", "rb") as text:
                        texts.append(text.read())
                    ids.append(name.removeprefix("doc_id="))
                    size += len(texts[-1])
                    if size > READ_BYTES or len(ids) >= NAMES:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary())], ["doc_id", "value"])
                        ids, texts, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary())], ["doc_id", "value"])

    return run


def folder_name(doc_id: str | None) -> str:
    """``doc_id=...`` as Spark names the folder of a partition."""
    value = ESCAPED.sub(lambda found: f"%{ord(found[0]):02X}", doc_id) if doc_id else NO_VALUE
    return f"doc_id={value}"


def file_writer(folder: str):
    """A function that writes batches of ``(doc_id, text)``, sorted by id, below the mounted ``folder``.

    A file has the name of its task's partition and appears whole or not at all, so a task that is tried again
    replaces its own files. Texts of one id are files of one folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        before, nth = None, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = folder_name(doc_id)
                nth = nth + 1 if name == before else 0
                before, own = name, f"{folder}/{name}"
                draft = f"{own}/.part-{task.partitionId():05d}-{nth}-{task.taskAttemptId()}"
                os.makedirs(own, exist_ok=True)
                with open(draft, "wb") as file:
                    file.write(text.as_py() + b"\n")
                os.replace(draft, f"{own}/part-{task.partitionId():05d}-{nth}.txt")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return run


def export_terms(terms: DataFrame, out_dir: str) -> None:
    """One term per line, sorted; range-partitioned files keep the order across files."""
    terms.select("term").orderBy("term").write.text(out_dir)


MATRIX = ("docs", "matrix_vocabulary", "entries")


def export_dtm(dtm, out_dir: str) -> None:
    dtm.docs.write.parquet(f"{out_dir}/docs")
    dtm.vocabulary.write.parquet(f"{out_dir}/matrix_vocabulary")
    dtm.entries.write.parquet(f"{out_dir}/entries")


def export_reduction(result, out_dir: str) -> None:
    """Kept and discarded terms as text, the matrix and the method's tables as parquet."""
    export_terms(result.reduced.vocabulary, f"{out_dir}/vocabulary")
    export_terms(result.discarded, f"{out_dir}/discarded_terms")
    export_dtm(result.reduced, out_dir)
    if hasattr(result, "term_tfidf"):
        result.term_tfidf.write.parquet(f"{out_dir}/term_tfidf")
        spark = result.term_tfidf.sparkSession
        spark.createDataFrame([result.thresholds]).write.json(f"{out_dir}/thresholds")
        publish(spark, out_dir, "reduction", result.reduced.kind, [*MATRIX, "term_tfidf"], {})
        return
    result.split.write.parquet(f"{out_dir}/split")
    result.terms_by_class.write.parquet(f"{out_dir}/terms_by_class")
    result.fit.table.write.parquet(f"{out_dir}/path")
    result.confusion.write.parquet(f"{out_dir}/confusion")
    result.fit.model.intercepts().write.parquet(f"{out_dir}/intercepts")
    row = [(result.fit.chosen, result.err_train, result.err_test, result.seed)]
    schema = "lambda double, err_train double, err_test double, seed long"
    spark = result.split.sparkSession
    spark.createDataFrame(row, schema).write.json(f"{out_dir}/errors")
    facts = dict(zip(("lambda", "err_train", "err_test", "seed"), row[0]))
    facts |= {"passes": result.fit.passes, "converged": result.fit.converged}
    tables = [*MATRIX, "split", "terms_by_class", "path", "confusion", "intercepts"]
    publish(spark, out_dir, "reduction", result.reduced.kind, tables, facts)


def export_sweep(sweep, out_dir: str) -> None:
    """Run record, split, left-out documents, and for each k its tables and model."""
    sweep.runs.write.parquet(f"{out_dir}/runs")
    sweep.split.write.parquet(f"{out_dir}/split")
    sweep.empty_docs.write.parquet(f"{out_dir}/empty_docs")
    sweep.top_topic.write.parquet(f"{out_dir}/best/top_topic")
    sweep.top_terms.write.parquet(f"{out_dir}/best/top_terms")
    for k, model in sweep.models.items():
        folder = f"{out_dir}/k={k}"
        model.posteriors.write.parquet(f"{folder}/posteriors")
        model.phi.write.parquet(f"{folder}/phi")
        if model.model is not None:
            model.model.write().save(f"{folder}/model")
        for name, table in sweep.errors[k].confusion.items():
            table.write.parquet(f"{folder}/{name}")
    names = ["runs", "split", "empty_docs", "best/top_topic", "best/top_terms"]
    for k in sweep.models:
        names += [f"k={k}/{name}" for name in ("posteriors", "phi", *sweep.errors[k].confusion)]
    publish(sweep.runs.sparkSession, out_dir, "sweep", sweep.kind, names, {"method": sweep.method, "best_k": sweep.best.k})
