"""The same queries in SQL, for DuckDB on the same parquet tables."""

from __future__ import annotations

from topicloom.functions.text import stopwords
from topicloom.plans.queries import STOPWORD_LANGUAGES


def stopword_rows() -> str:
    """The stopword lists as SQL rows; they are text files of this package."""
    return ", ".join("('" + w.replace("'", "''") + "')" for w in stopwords(*STOPWORD_LANGUAGES))


CLEAN = (
    r"trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '', 'g'), "
    r"'[\p{P}\p{S}\p{Z}\p{Cc}]+', ' ', 'g'))"
)


def tokens_cte(source: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key} AS doc_id, unnest(string_split({CLEAN}, ' ')) AS term FROM {source}"


def base_ctes(stop: bool = True) -> str:
    """cnt: all counts; voc: terms with df >= 5; ent: the base matrix."""
    words = f"stop(word) AS (VALUES {stopword_rows()}), " if stop else ""
    keep = "AND term NOT IN (SELECT word FROM stop)" if stop else ""
    return f"""WITH {words}tok AS ({tokens_cte()}),
    cnt AS (SELECT doc_id, term, count(*) AS tf FROM tok
            WHERE length(term) >= 3 {keep} GROUP BY doc_id, term),
    voc AS (SELECT term, count(*) AS df FROM cnt GROUP BY term HAVING count(*) >= 5),
    ent AS (SELECT cnt.doc_id, cnt.term, cnt.tf FROM cnt JOIN voc ON cnt.term = voc.term)"""


WEIGHT_CTES = """, n AS (SELECT count(*) AS n FROM documents),
    raw AS (SELECT e.doc_id, e.term, e.tf * log2(n.n / v.df) AS w
            FROM ent e JOIN voc v ON e.term = v.term, n)"""

SCORE_CTES = """, n AS (SELECT count(*) AS n FROM documents),
    len AS (SELECT doc_id, sum(tf) AS len FROM ent GROUP BY doc_id),
    score AS (SELECT e.term, count(*) AS df,
                     avg(e.tf / l.len) * log2(any_value(n.n) / count(*)) AS score
              FROM ent e JOIN len l ON e.doc_id = l.doc_id, n GROUP BY e.term),
    band AS (SELECT quantile_cont(score, 0.25) AS lo, quantile_cont(score, 0.75) AS hi FROM score)"""

FOLDS = """WITH cell AS (SELECT l_discount AS "lambda", l_linenumber AS fold,
        avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS error
        FROM lineitem GROUP BY l_discount, l_linenumber),
    cv AS (SELECT "lambda", avg(error) AS cvm, stddev_samp(error) / sqrt(count(*)) AS cvsd
           FROM cell GROUP BY "lambda")"""

ACCURACY = """SELECT l_discount AS "lambda", round(avg(CASE WHEN
        (CASE WHEN l_returnflag = 'N' THEN 'O' ELSE 'F' END) = l_linestatus THEN 1.0 ELSE 0.0 END), 8)
        AS accuracy FROM lineitem GROUP BY l_discount"""

CONFUSION = """WITH lab AS (SELECT 1 - quality AS pred, toxic AS truth FROM labels),
    lev AS (SELECT DISTINCT v FROM (SELECT pred AS v FROM lab UNION ALL SELECT truth FROM lab)),
    cm AS (SELECT p.v AS pred, t.v AS truth,
                  (SELECT count(*) FROM lab WHERE lab.pred = p.v AND lab.truth = t.v) AS n
           FROM lev p, lev t)"""

PARTS = """WITH part AS (SELECT vec_id AS doc_id, unnest(range(len(embedding))) AS topic,
        unnest(embedding) AS x FROM embeddings),
    ex AS (SELECT doc_id, topic, exp(x::DOUBLE) AS e FROM part),
    comp AS (SELECT doc_id, topic, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM ex)"""

XML_COLUMNS = {
    "tipo_prov": "'S'",
    "anno_dec": "n_chars::INTEGER",
    "num_dec": "doc_id::INTEGER",
    "num_sez": "source",
    "testo": "text",
    "dispositivo": "source",
    "anno_nrg_sic": "n_chars::INTEGER",
    "nrg_sic": "lang",
    "anno_prov_orig": "try_cast(source AS INTEGER)",
    "num_prov_orig": "doc_id::VARCHAR",
    "autorita": "source",
    "localita": "lang",
    "materia": "source || '*'",
}


def decisions_sql(latin1: bool = False) -> str:
    columns = dict(XML_COLUMNS)
    if latin1:
        columns["testo"] = r"CASE WHEN NOT regexp_matches(text, '[^\x{00}-\x{FF}]') THEN text END"
    shown = ", ".join(
        f"CASE WHEN lang <> 'es' THEN {value} END AS {name}" for name, value in columns.items()
    )
    return f"SELECT {shown} FROM documents WHERE lang <> 'de'"


CORPUS = f"""WITH dec AS ({decisions_sql()}),
    lev AS (SELECT materia, dense_rank() OVER (ORDER BY materia)::INTEGER AS id FROM
            (SELECT DISTINCT materia FROM dec WHERE materia IS NOT NULL))
    SELECT testo AS text, 'it' AS lang, dec.materia AS heading, tipo_prov AS "TipoProvvedimento",
        anno_dec AS "AnnoDecisione", num_dec AS "NumeroDecisione", num_sez AS "NumeroSezione",
        anno_nrg_sic AS "AnnoNrgSic", nrg_sic AS "NrgSic", anno_prov_orig AS "AnnoProvOriginale",
        num_prov_orig AS "NumProvOriginale", autorita AS "Autorita", localita AS "Localita",
        dec.materia AS "Materia", lev.id AS "Id_materia", dispositivo AS "Dispositivo"
    FROM dec LEFT JOIN lev ON dec.materia = lev.materia"""

TOP_SOURCES = """SELECT source AS label, count(*) AS n FROM documents GROUP BY source
    ORDER BY n DESC, label LIMIT 10"""


def oracle() -> dict[str, str]:
    base, plain = base_ctes(), base_ctes(stop=False)
    band = "JOIN score s ON ent.term = s.term JOIN band b ON s.score BETWEEN b.lo AND b.hi"
    return {
        "xml_decisions": decisions_sql(),
        "xml_file_decisions": decisions_sql(),
        "xml_column_decisions": decisions_sql(latin1=True),
        "xml_mixed_decisions": decisions_sql(),
        "unique_decision_ids": "SELECT count(*) AS n, count(*) AS n_ids FROM documents WHERE lang <> 'de'",
        "decision_report": """SELECT count(*) AS records, count_if(lang = 'de') AS other_types,
                count_if(lang = 'fr') AS untyped, count_if(lang = 'es') AS without_ruling,
                count_if(lang = 'es' OR (coalesce(lang, '') NOT IN ('de', 'fr') AND source IS NULL)) AS unlabelled
            FROM documents""",
        "decisions_corpus": CORPUS,
        "top_classes": TOP_SOURCES,
        "kept_classes": f"""WITH top AS ({TOP_SOURCES}) SELECT doc_id, source AS label
            FROM documents WHERE source IN (SELECT label FROM top)""",
        "class_levels": """SELECT source, (dense_rank() OVER (ORDER BY source) - 1)::INTEGER AS ix
            FROM (SELECT DISTINCT source FROM documents)""",
        "clean_text": f"SELECT doc_id, {CLEAN} AS clean FROM documents",
        "clean_tokens": plain + " SELECT doc_id, term, tf FROM cnt",
        "stopword_table_tokens": plain
        + f""", word AS (SELECT DISTINCT term FROM ({tokens_cte('benchmark', 'item_id')}))
            SELECT doc_id, term, tf FROM cnt WHERE term NOT IN (SELECT term FROM word)""",
        "base_dtm": base + " SELECT doc_id, term, tf FROM ent",
        "vocabulary": base + " SELECT term, df FROM voc",
        "doc_length": base
        + " SELECT doc_id, sum(tf)::BIGINT AS length FROM ent GROUP BY doc_id",
        "doc_freq": plain + " SELECT term, count(*) AS df FROM ent GROUP BY term",
        "empty_docs": base
        + " SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ent)",
        "nonempty_docs": base
        + " SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM ent)",
        "tfidf_raw": base + WEIGHT_CTES + " SELECT doc_id, term, round(w, 8) AS weight FROM raw",
        "tfidf_cosine": base
        + WEIGHT_CTES
        + """, sq AS (SELECT doc_id, sum(w * w) AS s FROM raw GROUP BY doc_id)
            SELECT raw.doc_id, term,
                   round(CASE WHEN s > 0 THEN w / sqrt(s) ELSE 0 END, 8) AS weight
            FROM raw JOIN sq ON raw.doc_id = sq.doc_id""",
        "tfidf_diagnostics": base
        + """, part AS (SELECT * FROM ent WHERE doc_id IN (SELECT doc_id FROM labels)),
            docs AS (SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
            pdf AS (SELECT term, count(*) AS df FROM part GROUP BY term)
            SELECT 'unreferenced term' AS problem, term AS name FROM voc
            WHERE term NOT IN (SELECT term FROM pdf)
            UNION ALL
            SELECT 'empty document', doc_id::VARCHAR FROM docs WHERE doc_id NOT IN
                (SELECT doc_id FROM part JOIN pdf ON part.term = pdf.term
                 WHERE pdf.df < (SELECT count(*) FROM docs))""",
        "tfidf_term_score": base
        + SCORE_CTES
        + " SELECT term, df, round(score, 8) AS score FROM score",
        "tfidf_thresholds": base
        + SCORE_CTES
        + """ SELECT round(lo, 8) AS inf, round(hi, 8) AS sup,
            (SELECT count(*) FROM score) AS n_terms FROM band""",
        "tfidf_reduced": base + SCORE_CTES + f" SELECT ent.doc_id, ent.term, ent.tf FROM ent {band}",
        "saved_reduction": base + SCORE_CTES + f" SELECT ent.doc_id, ent.term, ent.tf FROM ent {band}",
        "saved_sweep": base
        + """ SELECT k, outcome, k = 2 AS best,
                CASE WHEN k = 2 THEN (SELECT count(DISTINCT doc_id) FROM ent) END AS n_docs
            FROM (VALUES (2, 'done'), (3, 'failed'), (4, 'overran')) run(k, outcome)""",
        "saved_predictions": """WITH rk AS (SELECT lang, row_number() OVER (PARTITION BY lang
                ORDER BY md5('123:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
            SELECT lang AS label, count(*) AS n, count(*) AS n_same FROM rk WHERE r > ceil(0.75 * n) GROUP BY lang""",
        "tfidf_kept_scores": base
        + SCORE_CTES
        + """ SELECT term, round(score, 8) AS score FROM score, band
            WHERE score BETWEEN lo AND hi""",
        "tfidf_discarded": base
        + SCORE_CTES
        + " SELECT term FROM score, band WHERE score < lo OR score > hi",
        "stratified_split": """SELECT doc_id, lang AS label,
            row_number() OVER (PARTITION BY lang ORDER BY md5('123:' || doc_id), doc_id)
              <= ceil(0.75 * count(*) OVER (PARTITION BY lang)) AS is_train FROM documents""",
        "class_histogram": "SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang",
        "confusion": CONFUSION + " SELECT pred, truth, n FROM cm",
        "misclassification": CONFUSION
        + """ SELECT count(*) AS n,
            round(avg(CASE WHEN pred = truth THEN 1.0 ELSE 0.0 END), 8) AS accuracy,
            round(1.0 - avg(CASE WHEN pred = truth THEN 1.0 ELSE 0.0 END), 8) AS error FROM lab""",
        "class_stats": CONFUSION
        + """, t AS (SELECT sum(n)::DOUBLE AS total FROM cm),
            c AS (SELECT v AS label,
                (SELECT sum(n) FROM cm WHERE truth = v)::DOUBLE AS act,
                (SELECT sum(n) FROM cm WHERE pred = v)::DOUBLE AS prd,
                (SELECT sum(n) FROM cm WHERE pred = v AND truth = v)::DOUBLE AS hit FROM lev)
            SELECT label, round(hit / act, 8) AS sensitivity,
                round((total - act - prd + hit) / (total - act), 8) AS specificity,
                round(hit / prd, 8) AS pos_pred_value,
                round((total - act - prd + hit) / (total - prd), 8) AS neg_pred_value,
                round(act / total, 8) AS prevalence, round(hit / total, 8) AS detection_rate,
                round(prd / total, 8) AS detection_prevalence,
                round((hit / act + (total - act - prd + hit) / (total - act)) / 2, 8)
                    AS balanced_accuracy FROM c, t""",
        "overall_stats": CONFUSION
        + """, t AS (SELECT sum(n)::DOUBLE AS total, sum(CASE WHEN pred = truth THEN n ELSE 0 END)::DOUBLE AS hits
                     FROM cm),
            m AS (SELECT (SELECT sum(n) FROM cm WHERE truth = v)::DOUBLE AS act,
                         (SELECT sum(n) FROM cm WHERE pred = v)::DOUBLE AS prd FROM lev),
            e AS (SELECT sum(act * prd) AS cross_sum, max(act) AS largest FROM m)
            SELECT total::BIGINT AS n, round(hits / total, 8) AS accuracy,
                round(1 - hits / total, 8) AS error,
                round(largest / total, 8) AS no_information_rate,
                round((hits / total - cross_sum / (total * total)) / (1 - cross_sum / (total * total)), 8)
                    AS kappa FROM t, e""",
        "cv_summary": FOLDS
        + ' SELECT "lambda", round(cvm, 8) AS cvm, round(cvsd, 8) AS cvsd FROM cv',
        "lambda_rules": FOLDS
        + """, best AS (SELECT * FROM cv ORDER BY cvm, "lambda" DESC LIMIT 1)
            SELECT any_value(best."lambda") AS lambda_min, max(cv."lambda") AS lambda_1se,
                round(any_value(best.cvm), 8) AS cvm_min, round(any_value(best.cvsd), 8) AS cvsd_min
            FROM cv, best WHERE cv.cvm <= best.cvm + best.cvsd""",
        "path_accuracy": ACCURACY,
        "train_lambda": f'SELECT * FROM ({ACCURACY}) ORDER BY accuracy DESC, "lambda" DESC LIMIT 1',
        "best_k": """WITH sweep AS (SELECT l_quantity::INTEGER AS k, count(*) AS n,
                sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r,
                sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS o
                FROM lineitem GROUP BY l_quantity::INTEGER)
            SELECT k, round(o / n, 8) AS e1_test FROM sweep WHERE r * 4 >= n
            ORDER BY round(o / n, 8), k LIMIT 1""",
        "closure": PARTS + " SELECT doc_id, topic::INTEGER AS topic, round(p, 8) AS p FROM comp",
        "ilr": PARTS
        + """, m AS (SELECT doc_id, topic, ln(p) AS x, avg(ln(p)) OVER (PARTITION BY doc_id
                ORDER BY topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM comp)
            SELECT doc_id, (topic - 1)::INTEGER AS coord,
                round(sqrt(topic / (topic + 1)) * (x - before), 8) AS z FROM m WHERE topic > 0""",
        "top_topic": PARTS
        + """ SELECT doc_id, topic::INTEGER AS topic, round(p, 8) AS p FROM comp QUALIFY
            row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, topic) = 1""",
        "top_terms": base
        + """, lt AS (SELECT d.lang AS topic, e.term, sum(e.tf) AS tf FROM ent e
                JOIN documents d ON e.doc_id = d.doc_id GROUP BY d.lang, e.term),
            phi AS (SELECT topic, term, tf / sum(tf) OVER (PARTITION BY topic) AS phi FROM lt),
            rk AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY phi DESC, term)::INTEGER
                AS rank, term, phi FROM phi)
            SELECT topic, rank, term, round(phi, 8) AS phi FROM rk WHERE rank <= 10""",
        "lambda_max": plain
        + WEIGHT_CTES
        + """, sq AS (SELECT doc_id, sum(w * w) AS s FROM raw GROUP BY doc_id),
            x AS (SELECT raw.doc_id, term, CASE WHEN s > 0 THEN w / sqrt(s) ELSE 0 END AS x
                  FROM raw JOIN sq ON raw.doc_id = sq.doc_id),
            tot AS (SELECT x.term, sum(x) AS s,
                sqrt((sum(x * x) - sum(x) * sum(x) / any_value(n.n)) / (any_value(n.n) - 1)) AS sd
                FROM x, n GROUP BY x.term),
            part AS (SELECT x.term, d.lang, sum(x) AS s FROM x JOIN documents d
                ON x.doc_id = d.doc_id GROUP BY x.term, d.lang),
            cls AS (SELECT lang, count(*) / any_value(n.n) AS share FROM documents, n GROUP BY lang),
            g AS (SELECT tot.term, cls.lang,
                abs(coalesce(part.s, 0) - share * tot.s) / (n.n * tot.sd) AS g
                FROM tot CROSS JOIN cls CROSS JOIN n
                LEFT JOIN part ON part.term = tot.term AND part.lang = cls.lang
                WHERE tot.sd > 1e-9)
            SELECT round(g, 8) AS lambda_max, term, lang AS label FROM g
            ORDER BY g DESC, term, label LIMIT 1""",
        "exported_corpus": "SELECT doc_id, text FROM documents",
        "lda_posterior_docs": base
        + " SELECT doc_id, 1.0::DOUBLE AS total FROM documents WHERE doc_id IN (SELECT doc_id FROM ent)",
        "gibbs_posterior_docs": base
        + " SELECT doc_id, 1.0::DOUBLE AS total FROM documents WHERE doc_id IN (SELECT doc_id FROM ent)",
        "lda_phi_terms": base
        + """ SELECT t::INTEGER AS topic, (SELECT count(*) FROM voc) AS n_terms, 1.0::DOUBLE AS total
            FROM range(4) r(t)""",
        "lda_bounds": """SELECT method, true AS converged, 0::BIGINT AS n_fell, true AS several
            FROM (VALUES ('VEM'), ('VEM_fixed')) v(method)""",
        "lda_grid": base
        + """ SELECT doc_id, k::INTEGER AS k, 2::INTEGER AS resumed, true AS converged, true AS same
            FROM (SELECT DISTINCT doc_id FROM ent) d, (VALUES (2), (4)) v(k)""",
        "lasso_union": base + " SELECT term FROM voc",
        # Terms that vary over the train rows, none of which may break the condition.
        "lasso_optimality": base
        + """, rk AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang
                ORDER BY md5('123:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents),
            train AS (SELECT doc_id, lang FROM rk WHERE r <= ceil(0.75 * n)),
            seen AS (SELECT DISTINCT term FROM ent WHERE doc_id IN (SELECT doc_id FROM train))
            SELECT lang AS label, (SELECT count(*) FROM seen) AS n_terms, 0::BIGINT AS broken, 1 AS any_kept
            FROM train GROUP BY lang""",
        "own_steps_tokens": r"""SELECT doc_id, term, count(*) AS tf FROM (
            SELECT doc_id, unnest(string_split(trim(replace(regexp_replace(lower(text),
                '[\p{P}\p{S}\p{Z}\p{Cc}]+', ' ', 'g'), 'z', '')), ' ')) AS term FROM documents)
            WHERE length(term) >= 3 GROUP BY doc_id, term""",
        "exported_table": "SELECT doc_id, text FROM documents",
        "exported_terms": base
        + SCORE_CTES
        + """ SELECT CASE WHEN score BETWEEN lo AND hi THEN 'kept' ELSE 'discarded' END AS list, term
            FROM score, band""",
    }
