"""The pipeline on a small folder, against the same decisions taken by hand."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.test_operators import LANGUAGES, components_by_hand


def words(rng, lang, n):
    return [rng.choice(LANGUAGES[lang]) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(n)]


def low(text):
    return text.encode().lower().decode()


def test_pipeline_keeps_what_a_plain_loop_keeps(spark, tmp_path):
    rng = random.Random(12)
    items = [(k, " ".join(words(rng, "en", 30))) for k in range(10)]
    rows, foreign, leaks = [], set(), set()
    for k in range(300):
        lang = rng.choice(list(LANGUAGES))
        text = words(rng, lang, rng.randrange(60, 120))
        if k % 29 == 0:
            text, lang = ["ΑΒΓΔΕ", "ζηθικ", "λμνξο"] * 20 + [str(k)], None
            foreign.add(k)
        elif k % 23 == 0:
            text[20:20] = items[k % 10][1].split()
            leaks.add(k)
        rows.append((k, " ".join(text), lang, f"www.{lang}.{lang}" if lang else None))
    plain = [r for r in rows if r[0] not in foreign | leaks]
    for k, (_, text, lang, source) in enumerate(rng.sample(plain, 40)):  # exact copies, by letter case
        rows.append((400 + k, text.upper() if text.isascii() and k % 2 else text, lang, source))
    for k, (_, text, lang, source) in enumerate(rng.sample(plain, 40)):  # near copies, one word changed
        copy = text.split()
        copy[rng.randrange(len(copy))] = "anders"
        rows.append((500 + k, " ".join(copy), lang, source))
    table = [(*r, len(r[1])) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(table, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(i, t) for i, t, *_ in rows if i not in foreign]
    last = {low(t): i for i, t in sorted(left)}
    left = [(i, t) for i, t in left if last[low(t)] == i]
    first = {i for i, _, _, kept in components_by_hand(left, 5) if kept}
    expected = {i for i, _ in left if i in first and i not in leaks}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(expected)
    assert all(r.round_trip and r.n_pieces == len(r.ids) > 0 for r in got)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"
    ]
