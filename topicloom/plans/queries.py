"""Named queries over the given tables, one per operator of the engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.functions import text as text_fn
from topicloom.operators import dtm as dtm_ops
from topicloom.operators import evaluate, lasso, split, topics
from topicloom.operators.classify import classify_compositions
from topicloom.operators.lasso import PathOptions
from topicloom.operators.lda import LdaOptions, fit_lda, fit_together, prepare
from topicloom.operators.levels import level_index
from topicloom.operators.quantiles import exact_quantiles
from topicloom.operators.reduce_tfidf import reduce_by_tfidf, term_scores
from topicloom.operators.weights import tfidf_diagnostics, tfidf_weights
from topicloom.plans.reduce import reduce_dtm
from topicloom.plans.sweep import sweep_topics
from topicloom.sources.corpus import METADATA, decisions_to_corpus
from topicloom.sources.decisions import ROW_TAG, parse_decisions, read_decisions, read_reported, scan_decisions
from topicloom.sources.exports import export_corpus, read_texts
from topicloom.sources.saved import load_reduction, load_sweep
from topicloom.stash import broadcast_if_small, new_path, stash

STOPWORD_LANGUAGES = ("english", "german", "french", "spanish", "italian")
PLACES = 8

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column: Column | str) -> Column:
    return F.round(column, PLACES)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def lang_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"))


def base(spark: SparkSession, sf_dir: str, stop: bool = True) -> dtm_ops.Dtm:
    words = text_fn.stopwords(*STOPWORD_LANGUAGES) if stop else ()
    return dtm_ops.corpus_to_dtm(corpus(spark, sf_dir), words)


# --- XML and corpus -----------------------------------------------------------------------


def xml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision record per document; German ones are not final, Spanish ones lack a ruling."""
    d = table(spark, sf_dir, "documents")
    spanish = F.col("lang") == "es"
    return d.select(
        F.when(F.col("lang") == "de", "O").otherwise("S").alias("_tipoprov"),
        F.col("n_chars").alias("_anno"),
        F.col("doc_id").alias("_numdec"),
        F.col("source").alias("_nsz"),
        F.struct(
            F.col("n_chars").alias("_anno_nrg"),
            F.col("lang").alias("_nrg"),
            F.col("source").alias("_anno_prov"),
            F.col("doc_id").alias("_num_provv"),
            F.col("source").alias("_autorita"),
            F.col("lang").alias("_localita"),
            F.concat(F.lit("*"), "source", F.lit("*")).alias("_materia"),
        ).alias("sic"),
        F.col("text").alias("testo"),
        F.when(~spanish, F.col("source")).alias("dispositivo"),
        F.when(spanish, "").alias("dis"),
    )


def xml_files(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "xml")
    writer = xml_records(spark, sf_dir).write.format("xml")
    writer.option("rootTag", "decisions").option("rowTag", ROW_TAG).save(path)
    return path


def xml_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = xml_records(spark, sf_dir)
    return records.select(F.to_xml(F.struct(*records.columns), {"rowTag": ROW_TAG}).alias("value"))


def xml_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_decisions(spark, xml_files(spark, sf_dir)).drop("doc_id")


def xml_file_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_decisions(spark, xml_files(spark, sf_dir), split_files=False).drop("doc_id")


def xml_column_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_decisions(xml_strings(spark, sf_dir), "value", latin1=True).drop("doc_id")


def in_root(batches):
    """The lines of a task between the tags of a root element, as one task writes one file."""
    for part in ([pa.record_batch([["<decisions>"]], ["value"])], batches, [pa.record_batch([["</decisions>"]], ["value"])]):
        yield from part


def xml_mixed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records in files of three kinds: plain, closing tags with a blank, comments that
    hold a record, in equal shares by id."""
    path = new_path(spark, "xml-mixed")
    text = xml_strings(spark, sf_dir).select("value", F.xxhash64("value").alias("key"))
    decoy = f'<!-- <{ROW_TAG} tipoprov="S"><testo>no</testo><dis>no</dis></{ROW_TAG}> -->'
    blank = F.regexp_replace("value", f"</{ROW_TAG}>", f"</{ROW_TAG} >")
    kinds = (F.col("value"), blank, F.concat(F.lit(decoy), "value"))
    for k, value in enumerate(kinds):
        part = text.where(F.pmod("key", F.lit(len(kinds))) == k)
        part.select(value.alias("value")).mapInArrow(in_root, "value string").write.mode("append").text(path)
    return scan_decisions(spark, path).drop("doc_id")


def unique_decision_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that share year, number and section by tens still get ids of their own."""
    records = xml_records(spark, sf_dir)
    few = records.withColumn("_anno", F.lit(2013)).withColumn("_numdec", F.col("_numdec") % 10)
    path = new_path(spark, "xml-ids")
    few.write.format("xml").option("rootTag", "decisions").option("rowTag", ROW_TAG).save(path)
    return read_decisions(spark, path).agg(
        F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_ids")
    )


def decision_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading the records found and dropped; French ones have no type here."""
    path = new_path(spark, "xml-report")
    records = xml_records(spark, sf_dir)
    records = records.withColumn("_tipoprov", F.when(~F.col("sic._nrg").eqNullSafe("fr"), F.col("_tipoprov")))
    records.write.format("xml").option("rootTag", "decisions").option("rowTag", ROW_TAG).save(path)
    facts = asdict(read_reported(spark, path)[1])
    del facts["repeated_ids"]  # depends on how many files there are
    return spark.createDataFrame([tuple(facts.values())], ", ".join(f"{name} long" for name in facts))


def decisions_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = read_decisions(spark, xml_files(spark, sf_dir))
    made = decisions_to_corpus(decisions, METADATA)
    return made.drop("doc_id", "Id_doc")


def top_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label"))
    return split.largest_classes(labels, 10)


def kept_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label"))
    return split.keep_largest_classes(labels, 10)


def class_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_index(table(spark, sf_dir, "documents"), "source")


# --- document-term matrix -----------------------------------------------------------------


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dtm_ops.clean_corpus(corpus(spark, sf_dir))


def clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dtm_ops.count_terms(corpus(spark, sf_dir))


def stopword_table_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stopwords as a table: every term found in the short benchmark texts."""
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    words = dtm_ops.count_terms(bench).select(F.col("term").alias("word"))
    return dtm_ops.count_terms(corpus(spark, sf_dir), words)


def base_dtm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).entries


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).vocabulary


def doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dtm_ops.document_length(base(spark, sf_dir).entries)


def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dtm_ops.document_frequency(base(spark, sf_dir, stop=False).entries)


def empty_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).without_empty_docs()[1]


def nonempty_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).without_empty_docs()[0].docs


# --- weights and the tf-idf band ----------------------------------------------------------


def tfidf_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = tfidf_weights(base(spark, sf_dir), normalize=False)
    return weights.withColumn("weight", rounded("weight"))


def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf_weights(base(spark, sf_dir)).withColumn("weight", rounded("weight"))


def tfidf_diagnostics_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of the full vocabulary on the documents that carry a label."""
    full = base(spark, sf_dir)
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    part = dtm_ops.Dtm(
        docs=full.docs.join(labelled, "doc_id", "left_semi"),
        vocabulary=full.vocabulary,
        entries=full.entries.join(labelled, "doc_id", "left_semi"),
    )
    unreferenced, empty = tfidf_diagnostics(part)
    return unreferenced.select(F.lit("unreferenced term").alias("problem"), F.col("term").alias("name")).unionByName(
        empty.select(
            F.lit("empty document").alias("problem"), F.col("doc_id").cast("string").alias("name")
        )
    )


def tfidf_term_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_scores(base(spark, sf_dir)).withColumn("score", rounded("score"))


def tfidf_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = stash(term_scores(base(spark, sf_dir)), "scores")
    low, high = exact_quantiles(scores, "score", (0.25, 0.75))
    return scores.agg(F.count("*").alias("n_terms")).select(
        rounded(F.lit(low)).alias("inf"), rounded(F.lit(high)).alias("sup"), "n_terms"
    )


def tfidf_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce_by_tfidf(base(spark, sf_dir)).reduced.entries


def tfidf_kept_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce_by_tfidf(base(spark, sf_dir)).term_tfidf.withColumn("score", rounded("score"))


def tfidf_discarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce_by_tfidf(base(spark, sf_dir)).discarded


# --- split, evaluation, selection rules ---------------------------------------------------


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(lang_labels(spark, sf_dir), 123)


def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.class_histogram(lang_labels(spark, sf_dir))


def toxic_from_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed rule to evaluate: a document of low quality is predicted toxic."""
    return table(spark, sf_dir, "labels").select(
        (F.lit(1) - F.col("quality")).alias("pred"), F.col("toxic").alias("truth")
    )


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_table(toxic_from_quality(spark, sf_dir))


def misclassification(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.misclassification(toxic_from_quality(spark, sf_dir))
    return out.select("n", rounded("accuracy").alias("accuracy"), rounded("error").alias("error"))


def class_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.class_stats(evaluate.confusion_cells(toxic_from_quality(spark, sf_dir)))
    return out.select("label", *[rounded(c).alias(c) for c in out.columns if c != "label"])


def overall_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.overall_stats(evaluate.confusion_cells(toxic_from_quality(spark, sf_dir)))
    return out.select("n", *[rounded(c).alias(c) for c in out.columns if c != "n"])


def fold_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of cross-validation shape: discount as lambda, line number as fold."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(
        F.col("l_discount").alias("lambda"), F.col("l_linenumber").alias("fold")
    ).agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("error"))


def cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.cv_summary(fold_errors(spark, sf_dir))
    return out.select("lambda", rounded("cvm").alias("cvm"), rounded("cvsd").alias("cvsd"))


def lambda_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.lambda_rules(evaluate.cv_summary(fold_errors(spark, sf_dir)))
    return out.select(
        "lambda_min", "lambda_1se", rounded("cvm_min").alias("cvm_min"), rounded("cvsd_min").alias("cvsd_min")
    )


def status_from_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of path shape: line status predicted from the return flag, discount as lambda."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_discount").alias("lambda"),
        F.when(F.col("l_returnflag") == "N", "O").otherwise("F").alias("pred"),
        F.col("l_linestatus").alias("truth"),
    )


def path_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.accuracy_by_lambda(status_from_flag(spark, sf_dir))
    return out.select("lambda", rounded("accuracy").alias("accuracy"))


def train_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_train_lambda(path_accuracy(spark, sf_dir))


def best_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of sweep shape: quantity as k; a k with few returned lines counts as failed."""
    returned = F.sum((F.col("l_returnflag") == "R").cast("long"))
    opened = F.sum((F.col("l_linestatus") == "O").cast("long"))
    sweep = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_quantity").cast("int").alias("k"))
        .agg(F.count("*").alias("n"), returned.alias("r"), opened.alias("o"))
        .select(
            "k",
            rounded(F.col("o") / F.col("n")).alias("e1_test"),
            F.when(F.col("r") * 4 < F.col("n"), "too few returned").alias("error"),
        )
    )
    return evaluate.best_k(sweep).select("k", "e1_test")


# --- compositions and topics --------------------------------------------------------------


def embedding_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive parts of a composition from each embedding."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.transform("embedding", lambda x: F.exp(x.cast("double"))).alias("p"),
    )


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = topics.close_compositions(embedding_parts(spark, sf_dir))
    return closed.select("doc_id", F.posexplode("p").alias("topic", "p")).withColumn("p", rounded("p"))


def ilr(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = topics.ilr_coordinates(embedding_parts(spark, sf_dir))
    return z.select("doc_id", F.posexplode("z").alias("coord", "z")).withColumn("z", rounded("z"))


def top_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = topics.top_topic(topics.close_compositions(embedding_parts(spark, sf_dir)))
    return best.withColumn("p", rounded("p"))


def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term shares per language stand in for topic rows."""
    matrix = base(spark, sf_dir)
    by_lang = (
        matrix.entries.join(lang_labels(spark, sf_dir), "doc_id")
        .groupBy(F.col("label").alias("topic"), "term")
        .agg(F.sum("tf").alias("tf"))
    )
    by_lang = stash(by_lang, "language-terms")
    totals = by_lang.groupBy("topic").agg(F.sum("tf").alias("total"))
    phi = by_lang.join(broadcast_if_small(totals), "topic").select(
        "topic", "term", (F.col("tf") / F.col("total")).alias("phi")
    )
    return topics.top_terms(phi).withColumn("phi", rounded("phi"))


# --- models -------------------------------------------------------------------------------

# Compositions of many classes need nearly every coordinate of every class, so their paths are the slow ones.
COMPOSITION_PATH = PathOptions(n_lambda=4, folds=3)
# Chains have their full length: 1000 sweeps, then ten draws over 1000 more.
CHAIN = LdaOptions()


def lambda_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = tfidf_weights(base(spark, sf_dir, stop=False))
    best = lasso.lambda_max(weights, lang_labels(spark, sf_dir))
    return best.withColumn("lambda_max", rounded("lambda_max"))


def lasso_reduction(spark: SparkSession, sf_dir: str, method: str):
    return reduce_dtm(
        base(spark, sf_dir).stashed(), method, classes=lang_labels(spark, sf_dir), rule="lambda_1se", seed=123
    ).result


def lasso_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms per class from the best train error over the whole path."""
    return lasso_reduction(spark, sf_dir, "lognet").terms_by_class


def lasso_cv_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms per class by ten-fold cross-validation over the whole path."""
    return lasso_reduction(spark, sf_dir, "lognet_cv").terms_by_class


def lasso_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class: terms that vary over the train rows, and how many break the optimality condition of the chosen fit.

    Recomputed from the coefficients as a user gets them, in built-in functions: probabilities from joined sums, then the
    gradient of every term, which at zero may not exceed the penalty and elsewhere must equal it.
    """
    matrix, labels = base(spark, sf_dir).stashed(), lang_labels(spark, sf_dir)
    found = reduce_dtm(matrix, "lognet", classes=labels, seed=123).result
    train = stash(found.split.where("is_train").select("doc_id", "label"), "train")
    weights = stash(tfidf_weights(matrix).join(train.select("doc_id"), "doc_id"), "train-weights")
    bases = stash(found.fit.model.intercepts(), "intercepts")
    n = train.count()

    terms = found.terms_by_class.withColumnRenamed("label", "class")
    scores = weights.join(broadcast_if_small(stash(terms, "coefficients")), "term")
    scores = scores.groupBy("doc_id", "class").agg(F.sum(F.col("weight") * F.col("coef")).alias("score"))
    grid = train.select("doc_id", "label", F.lit(1).alias("one")).join(
        F.broadcast(bases.select(F.col("label").alias("class"), "intercept", F.lit(1).alias("one"))), "one"
    )
    raised = grid.join(scores, ["doc_id", "class"], "left").select(
        "doc_id", "label", "class", F.exp(F.col("intercept") + F.coalesce("score", F.lit(0.0))).alias("e")
    )
    share = F.col("e") / F.sum("e").over(Window.partitionBy("doc_id"))
    rest = raised.select("doc_id", "class", (share - (F.col("label") == F.col("class")).cast("double")).alias("rest"))
    rest = stash(rest, "rests")

    moments = lasso.column_moments(weights, train, "term", "weight").select("term", "sd")
    slopes = weights.join(rest, "doc_id").groupBy("term", "class").agg(
        (F.sum(F.col("weight") * F.col("rest")) / F.lit(float(n))).alias("slope")
    )
    joined = slopes.join(moments, "term").join(terms, ["term", "class"], "left")
    penalty = found.fit.chosen
    slope, coef = F.col("slope") / F.col("sd"), F.coalesce("coef", F.lit(0.0))
    slack = 1e-3 * penalty
    broken = F.when(coef == 0, F.abs(slope) > penalty + slack).otherwise(F.abs(slope + F.signum(coef) * penalty) > slack)
    return joined.groupBy(F.col("class").alias("label")).agg(
        F.count("*").alias("n_terms"), F.count_if(broken).alias("broken"), F.max((coef != 0).cast("int")).alias("any_kept")
    )


def lda_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = prepare(base(spark, sf_dir))
    return topics.top_terms(fit_lda(data, 4, "VEM").phi)


def lda_fixed_alpha_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = prepare(base(spark, sf_dir))
    return topics.top_terms(fit_lda(data, 4, "VEM_fixed").phi)


def lda_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per method: whether the fit converged, and iterations whose bound on the log-likelihood fell."""
    data, rows = prepare(base(spark, sf_dir)), []
    for method in ("VEM", "VEM_fixed"):
        record = fit_lda(data, 4, method).record
        rows += [(method, record.converged, *step) for step in record.iterations]
    steps = spark.createDataFrame(rows, "method string, converged boolean, iteration int, bound double, alpha double")
    before = F.lag("bound").over(Window.partitionBy("method").orderBy("iteration"))
    fell = F.col("bound") < before - 1e-6 * F.abs(before)
    return steps.withColumn("fell", fell).groupBy("method", "converged").agg(
        F.count_if("fell").alias("n_fell"), (F.count("*") > 1).alias("several")
    )


def lda_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per k and document: whether fits that share their passes, stopped after two iterations and resumed, give what a fit alone gives."""
    data, ks, folder = prepare(base(spark, sf_dir)), (2, 4), new_path(spark, "fits")
    fit_together(data, ks, "VEM", options=LdaOptions(max_iter=2, resume_dir=folder))
    shared = fit_together(data, ks, "VEM", options=LdaOptions(resume_dir=folder))
    compared = []
    for k, model in shared.items():
        alone = fit_lda(data, k, "VEM").posteriors.select("doc_id", F.col("p").alias("q"))
        far = F.array_max(F.zip_with("p", "q", lambda x, y: F.abs(x - y)))
        both = stash(model.posteriors, "posteriors").join(stash(alone, "posteriors"), "doc_id")
        facts = F.lit(k).alias("k"), F.lit(model.record.resumed).alias("resumed"), F.lit(model.record.converged).alias("converged")
        compared.append(both.select("doc_id", *facts, (far < 1e-4).alias("same")))
    return reduce(DataFrame.unionByName, compared)


def posterior_sums(posteriors: DataFrame) -> DataFrame:
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return posteriors.select("doc_id", F.round(total, 6).alias("total"))


def lda_posterior_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a word has topic shares that add up to 1."""
    return posterior_sums(fit_lda(prepare(base(spark, sf_dir)), 4, "VEM").posteriors)


def gibbs_posterior_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posterior_sums(fit_lda(prepare(base(spark, sf_dir)), 4, "Gibbs", options=CHAIN).posteriors)


def lda_phi_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every topic covers the vocabulary and its shares add up to 1."""
    phi = fit_lda(prepare(base(spark, sf_dir)), 4, "VEM_fixed").phi
    return phi.groupBy("topic").agg(F.count("*").alias("n_terms"), F.round(F.sum("phi"), 6).alias("total"))


def lasso_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that the lasso keeps and terms that it discards, together the vocabulary it was given."""
    found = lasso_reduction(spark, sf_dir, "lognet")
    return found.reduced.vocabulary.select("term").unionByName(found.discarded.select("term"))


def own_steps_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts under the caller's own cleaning steps: digits stay, the letter z goes."""
    steps = (text_fn.lower_case, text_fn.separators_to_space, lambda text: F.regexp_replace(text, "z", ""))
    return dtm_ops.count_terms(corpus(spark, sf_dir), steps=steps)


def gibbs_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = prepare(base(spark, sf_dir))
    return topics.top_topic(fit_lda(data, 4, "Gibbs", options=CHAIN).posteriors)


def lda_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sweep_topics(base(spark, sf_dir), lang_labels(spark, sf_dir), (2, 3, 4), options=COMPOSITION_PATH)
    return found.runs.drop("fit_seconds")


def saved_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per k of a sweep that was saved and loaded: how its run ended, whether it won, documents with topic shares.

    One k fails at once, another counts the matrix again and again until its deadline.
    """

    def fit(data, k, method, options):
        if k == 3:
            raise ArithmeticError("no fit of this k")
        while k == 4:
            data.cells.agg(F.sum(F.size("cells"))).collect()
        return fit_lda(data, k, method, options=options)

    path = new_path(spark, "sweep")
    sweep_topics(
        base(spark, sf_dir), lang_labels(spark, sf_dir), (2, 3, 4), options=COMPOSITION_PATH, out_dir=path, fit=fit, deadlines={4: 2.0}
    )
    saved = load_sweep(spark, f"{path}/VEM/base")
    outcome = F.when(F.col("error").isNull(), "done").when(F.col("error").startswith("TimeoutError"), "overran").otherwise("failed")
    runs = saved.tables["runs"].select("k", outcome.alias("outcome"), (F.col("k") == saved.best_k).alias("best"))
    docs = saved.posteriors().agg(F.count("*").alias("n_docs"))
    return runs.join(docs.withColumn("k", F.lit(saved.best_k)), "k", "left")


def embedding_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return split.stratified_split(labels, 123)


def composition_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify_compositions(
        embedding_parts(spark, sf_dir), embedding_split(spark, sf_dir), options=COMPOSITION_PATH
    )
    rows = [(name, error) for name, error in found.errors.items()]
    return spark.createDataFrame(rows, "name string, error double")


# --- sinks, read back ---------------------------------------------------------------------


def exported_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "corpus")
    export_corpus(corpus(spark, sf_dir), path, as_text=False)
    return spark.read.parquet(path)


def exported_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "corpus")
    export_corpus(corpus(spark, sf_dir), path)
    return read_texts(spark, path).withColumn("doc_id", F.col("doc_id").try_cast("long"))


def exported_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary and discarded terms as the export of a tf-idf reduction wrote them."""
    path = new_path(spark, "export")
    reduce_dtm(base(spark, sf_dir), "tfidf", out_dir=path)
    kept = spark.read.text(f"{path}/tfidf/vocabulary").select(F.lit("kept").alias("list"), "value")
    gone = spark.read.text(f"{path}/tfidf/discarded_terms")
    return kept.unionByName(gone.select(F.lit("discarded").alias("list"), "value")).withColumnRenamed(
        "value", "term"
    )


def saved_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of a tf-idf reduction, saved and loaded."""
    path = new_path(spark, "saved")
    reduce_dtm(base(spark, sf_dir), "tfidf", out_dir=path)
    return load_reduction(spark, f"{path}/tfidf").reduced.entries


def saved_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test documents per class, and how many a saved model predicts as the one in memory did."""
    path = new_path(spark, "saved")
    matrix = base(spark, sf_dir).stashed()
    found = reduce_dtm(matrix, "lognet", classes=lang_labels(spark, sf_dir), seed=123, out_dir=path).result
    fresh = stash(found.fit.model.predictions(found.fit.model.data.test), "predictions")
    test = found.split.where(~F.col("is_train"))
    loaded = load_reduction(spark, f"{path}/lognet").predict(tfidf_weights(matrix), test)
    both = fresh.withColumnRenamed("pred", "fresh").join(loaded, "doc_id")
    return both.groupBy(F.col("truth").alias("label")).agg(
        F.count("*").alias("n"), F.count_if(F.col("fresh") == F.col("pred")).alias("n_same")
    )


QUERIES: dict[str, Query] = {
    "xml_decisions": xml_decisions,
    "xml_file_decisions": xml_file_decisions,
    "xml_column_decisions": xml_column_decisions,
    "xml_mixed_decisions": xml_mixed_decisions,
    "unique_decision_ids": unique_decision_ids,
    "decision_report": decision_report,
    "decisions_corpus": decisions_corpus,
    "top_classes": top_classes,
    "kept_classes": kept_classes,
    "class_levels": class_levels,
    "clean_text": clean_text,
    "clean_tokens": clean_tokens,
    "stopword_table_tokens": stopword_table_tokens,
    "base_dtm": base_dtm,
    "vocabulary": vocabulary,
    "doc_length": doc_length,
    "doc_freq": doc_freq,
    "empty_docs": empty_docs,
    "nonempty_docs": nonempty_docs,
    "tfidf_raw": tfidf_raw,
    "tfidf_cosine": tfidf_cosine,
    "tfidf_diagnostics": tfidf_diagnostics_labelled,
    "tfidf_term_score": tfidf_term_score,
    "tfidf_thresholds": tfidf_thresholds,
    "tfidf_reduced": tfidf_reduced,
    "tfidf_kept_scores": tfidf_kept_scores,
    "tfidf_discarded": tfidf_discarded,
    "stratified_split": stratified_split,
    "class_histogram": class_histogram,
    "confusion": confusion,
    "misclassification": misclassification,
    "class_stats": class_stats,
    "overall_stats": overall_stats,
    "cv_summary": cv_summary,
    "lambda_rules": lambda_rules,
    "path_accuracy": path_accuracy,
    "train_lambda": train_lambda,
    "best_k": best_k,
    "closure": closure,
    "ilr": ilr,
    "top_topic": top_topic,
    "top_terms": top_terms,
    "lambda_max": lambda_max,
    "lasso_terms": lasso_terms,
    "lasso_cv_terms": lasso_cv_terms,
    "lasso_optimality": lasso_optimality,
    "lda_topics": lda_topics,
    "lda_fixed_alpha_topics": lda_fixed_alpha_topics,
    "lda_bounds": lda_bounds,
    "lda_grid": lda_grid,
    "gibbs_topics": gibbs_topics,
    "lda_posterior_docs": lda_posterior_docs,
    "gibbs_posterior_docs": gibbs_posterior_docs,
    "lda_phi_terms": lda_phi_terms,
    "lasso_union": lasso_union,
    "own_steps_tokens": own_steps_tokens,
    "lda_sweep": lda_sweep,
    "composition_errors": composition_errors,
    "exported_corpus": exported_corpus,
    "exported_table": exported_table,
    "exported_terms": exported_terms,
    "saved_reduction": saved_reduction,
    "saved_predictions": saved_predictions,
    "saved_sweep": saved_sweep,
}
