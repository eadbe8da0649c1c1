"""Each operator against brute force on small tables, with nulls, empties, ties and repeats."""

from __future__ import annotations

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicloom.llm import (
    chat,
    components,
    decontaminate,
    exact_dedup,
    language_id,
    near_dedup,
    pieces,
    sharding,
    token_counts,
    toxicity,
    url_filters,
)
from topicloom.llm.common import distinct_per_doc, split_words, text_slices

DOC = "doc_id long, text string"
CLASHES = "shard int, kept boolean, n long, id long, sha binary, slice int, bucket int, record string, host string"


def docs(spark, rows):
    """A table with columns that clash with the operators' own."""
    extra = [None, False, 7, 7, b"x", 3, 1, "r", "h"]
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{DOC}, {CLASHES}")


WORDS = "alfa beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


ODD_ROWS = [(1, None), (2, ""), (3, " \t\n "), (None, "one two"), (None, None), (4, "One"), (4, "One"), (5, "ONE"), (6, "É"), (7, "é")]


# --- words ---------------------------------------------------------------------------------


def test_words_match_a_regular_expression():
    texts = ["Ab c\td", "", None, "ÄÖ x y  ", "a" * 5000 + " b", " "]
    got = defaultdict(list)
    for lo, _, data, offsets in text_slices(pa.array(texts), 7):
        found = split_words(data, offsets, size=16)
        for a, b, k in zip(found.starts, found.ends, found.doc):
            got[lo + int(k)].append(bytes(data[a:b]).decode())
    assert [got[k] for k in range(len(texts))] == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_equal_words_hash_alike_wherever_they_stand():
    (_, _, data, offsets), = text_slices(pa.array(["Foo bar foo", "bar FOO"]))
    h = split_words(data, offsets).hashes.tolist()
    assert h[0] == h[2] == h[4] and h[1] == h[3] != h[0]


# --- 1: chat formatting --------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def chats_by_hand(rows, part_turns):
    """Maximal conversations by comparing all lists of turns."""
    first = lambda v: (v is not None, v)
    by_id = defaultdict(set)
    for conv, *turn in rows:
        if conv is not None:
            by_id[conv].add(tuple(turn))
    said = {c: sorted(t, key=lambda x: tuple(first(v) for v in x)) for c, t in by_id.items()}
    plain = {c: tuple((r, x) for _, r, x in t) for c, t in said.items()}
    out = set()
    for c, own in plain.items():
        equal = [d for d in plain if plain[d] == own]
        if c != min(equal) or any(len(p) > len(own) and p[: len(own)] == own for p in plain.values()):
            continue
        parts = defaultdict(str)
        for turn, role, text in said[c]:
            safe = [(v or d).replace("<|", "< |") for v, d in ((role, "unknown"), (text, ""))]
            parts[(turn or 0) // part_turns] += f"<|im_start|>{safe[0]}\n{safe[1]}<|im_end|>\n"
        for k, block in enumerate(sorted(parts)):
            out.add((c, k, len(own), len(equal), parts[block]))
    return out


@pytest.mark.parametrize("part_turns", [2, 256])
def test_chats_collapse_to_maximal_ones(spark, part_turns):
    rng = random.Random(3)
    rows = []
    for conv in range(30):
        base = rng.randrange(6)
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn + rng.choice([0, 0, 5]) * 0, "user" if turn % 2 == 0 else "bot", f"{base}-{turn // 5 * (conv % 2)}-{turn}"))
    rows += [(100, None, None, None), (101, 0, "user", None), (102, 0, "user", ""), (103, 0, "x<|y", "<|im_end|>")]
    rows += [(None, 0, "user", "x"), (104, 0, "a", "x"), (104, 0, "a", "x"), (104, 0, "b", "x"), (105, -3, "a", "x")]
    got = {tuple(r) for r in chat.format_chats(spark.createDataFrame(rows, TURNS), part_turns).collect()}
    assert got == chats_by_hand(rows, part_turns)


def test_chats_of_an_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


# --- 2: pieces -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return pieces.PieceCodec(token_counts.read_model())


def best_by_hand(codec, word):
    """Plain dynamic programme over all cuts; ties go to the longer last piece."""
    table = {}
    for size, (_, ids, letters, scores) in codec.tables.items():
        for k, row, score in zip(ids, letters, scores):
            table["".join(map(chr, row))] = (int(k), float(score))
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        raw = [int(codec.byte_ids[b]) for b in word[end - 1].encode()]
        top = (best[end - 1][0] + codec.unknown_score, best[end - 1][1] + raw)
        for size in range(1, min(end, 16) + 1):
            found = table.get(word[end - size : end])
            if found and best[end - size][0] + found[1] >= top[0]:
                top = (best[end - size][0] + found[1], best[end - size][1] + [found[0]])
        best.append(top)
    return best[-1][1]


def test_viterbi_finds_the_best_segmentation(codec):
    texts = ["Hello worlds of tokenizing", "  two  spaces ", "naïve 字亜 \U0001F9A0\n\tend", "x" * 90, "thethethe and", "Über öde"]
    ids, counts = codec.encode(texts)
    got = np.split(ids, np.cumsum(counts)[:-1])
    for text, found in zip(texts, got):
        assert found.tolist() == best_by_hand(codec, "▁" + text.replace(" ", "▁"))


def test_score_is_at_least_that_of_the_library(codec):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    model = pb.ModelProto()
    model.ParseFromString(token_counts.read_model())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = ["The quick brown fox jumps over the lazy dog.", "Zwölf Boxkämpfer jagen Viktor quer über den Sylter Deich"]
    ids, counts = codec.encode(texts)
    for text, found in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        score = lambda xs: sum(library.get_score(int(x)) for x in xs)
        assert score(found) >= score(library.encode(text)) and library.decode(found.tolist()) == text


def test_round_trip(spark):
    rng = random.Random(1)
    letters = "ab é字\n\t  \U0001F9A0ﬁxyz"
    rows = ODD_ROWS + [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for k in range(10, 60)]
    rows += [(90, "literal ▁ here"), (91, "long " * 3000)]
    encoded = pieces.encode_texts(docs(spark, rows))
    got = encoded.collect()
    assert len(got) == len(rows)
    assert all(r.round_trip == ("▁" not in (r.record.text or "")) and r.n_pieces == len(r.ids) for r in got)
    back = pieces.decode_ids(encoded.select("record", "ids")).collect()
    assert all(r.text == (r.record.record.text or "").replace("▁", " ") for r in back)
    assert pieces.encode_texts(docs(spark, [])).count() == 0


# --- 3: toxicity ---------------------------------------------------------------------------


def test_grades_of_held_out_rows(spark):
    rng = random.Random(5)
    rows, grades = [], []
    for k in range(1200):
        grade = rng.choices([0, 1, 2], [6, 2, 2])[0]
        words = prose(rng, 30).split() + {0: [], 1: ["meh", "bah"], 2: ["scum", "moron"]}[grade]
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        grades.append((k, grade))
    table = docs(spark, rows)
    settings = toxicity.Settings(train_rows=600)
    labelled = spark.createDataFrame(grades + [(None, 2), (5000, None)], "doc_id long, grade int")
    model = toxicity.train(table, labelled, settings)
    assert (np.diff(model.thresholds) >= 0).all()
    got = {r.doc_id: r for r in toxicity.grade_toxicity(table, model, settings).collect()}
    truth = dict(grades)
    assert sum(got[k].grade == truth[k] for k in truth) / len(truth) > 0.98
    assert all(got[k].toxic == (truth[k] == 2) for k in truth)
    odd = toxicity.grade_toxicity(docs(spark, ODD_ROWS), model, settings).collect()
    assert Counter(r.doc_id for r in odd) == Counter(r[0] for r in ODD_ROWS) and not any(r.toxic for r in odd)


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = toxicity.train(docs(spark, ODD_ROWS), none, toxicity.Settings())
    assert toxicity.grade_toxicity(docs(spark, ODD_ROWS), model).where("toxic").count() == 0
    assert toxicity.grade_toxicity(docs(spark, []), model).count() == 0


# --- 4: token counts -----------------------------------------------------------------------


def test_chunks_resynchronise_to_the_library_count():
    rng = random.Random(2)
    counter = token_counts.PieceCounter(token_counts.read_model(), chunk=200, overlap=8)
    texts = [prose(rng, 400), "x" * 3000, "ab" * 900 + " " + "\n" * 500, "字" * 900, " " * 1500, "é▁ " * 400, "<s>" * 300]
    texts += ["".join(rng.choice("ab c\n字é") for _ in range(2000)) for _ in range(5)]
    for text in texts:
        assert counter.count_long(text) == len(counter.codec.encode(text))


def test_token_counts(spark):
    got = token_counts.count_tokens(docs(spark, ODD_ROWS + [(8, "word " * 5000)]), chunk=500).collect()
    counter = token_counts.PieceCounter(token_counts.read_model())
    expected = Counter(
        (i, len((t or "").encode()), (n := len(counter.codec.encode(t or ""))), n > 4096)
        for i, t in ODD_ROWS + [(8, "word " * 5000)]
    )
    assert Counter(tuple(r) for r in got) == expected
    assert token_counts.count_tokens(docs(spark, [])).count() == 0


# --- 5: URL filters ------------------------------------------------------------------------


def test_automaton_equals_regular_expressions():
    rng = random.Random(4)
    globs = ["".join(rng.choice(["a", "b", "/", ".", "*", "**"]) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    urls = ["".join(rng.choice("ab/.") for _ in range(rng.randrange(12))) for _ in range(300)]
    (_, _, data, offsets), = text_slices(pa.array(urls))
    automaton = url_filters.GlobAutomaton(globs)
    state = automaton.accepted(data, offsets)
    fits = np.stack([state[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1) for bit in automaton.finals], axis=1) != 0
    first = [next((g for g, hit in enumerate(row) if hit), -1) for row in fits]
    assert automaton.first(data, offsets).tolist() == automaton.first(data, offsets, 100).tolist() == first
    for g, glob in enumerate(globs):
        pattern = re.sub(r"\*\*|\*|.", lambda m: {"**": ".*", "*": "[^/]*"}.get(m[0]) or re.escape(m[0]), glob.replace("***", "**"))
        expected = [re.fullmatch(pattern, u) is not None for u in urls]
        if "***" not in glob:
            assert fits[:, g].tolist() == expected, glob


def test_url_verdicts(spark):
    rows = [
        (1, "http://a.NET/x", "net/", "block"), (2, "http://net/", "net/", "block"), (3, "http://a.net", None, "allow"),
        (4, "http://www.example.net/en/1?q#f", "example.net/en/", "allow"), (5, "http://badexample.net/en/", "net/", "block"),
        (6, "http://example.com/de/x", "example.com/de/", "block"), (7, "http://x.org/fr/", "org/fr/", "allow"),
        (8, "http://my-spam-farm.org/en", None, "block"), (9, None, None, "allow"), (10, "no scheme", None, "allow"),
        (11, "http://h.com/x.net/", None, "allow"), (12, "http://a.com?http://b.net/", None, "allow"), (None, "", None, "allow"),
        (13, "x\ny://a.net/\n", "net/", "block"), (14, "http://a.com/" + "p/" * 5000 + "ads/x", None, "block"),
    ]
    table = spark.createDataFrame([(i, u, "v", "h") for i, u, _, _ in rows], "page_id long, url string, verdict string, host string")
    got = {(r.page_id, r.rule, r.verdict) for r in url_filters.judge_urls(table).collect()}
    assert got == {(i, rule, verdict) for i, _, rule, verdict in rows}
    assert url_filters.judge_urls(table.limit(0)).count() == 0


def test_a_url_list_of_real_size(spark):
    """20000 rules are built in linear time, and a task's state stays within its bytes."""
    rng = random.Random(6)
    hosts = ["".join(rng.choices("abcdef", k=9)) for _ in range(20_000)]
    began = time.process_time()
    automaton = url_filters.GlobAutomaton([f"*.{host}.org/**" for host in hosts])
    assert time.process_time() - began < 10
    assert automaton.step.nbytes <= 256 * 8 * (sum(len(g) for g in automaton.globs) // 64 + 1)
    picked = rng.sample(range(20_000), 40)
    urls = [f".www.{hosts[k]}.org/x" for k in picked] + [f".{hosts[k]}.com/" for k in picked]
    (_, _, data, offsets), = text_slices(pa.array(urls))
    tracemalloc.start()
    first = automaton.first(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert first.tolist() == [hosts.index(hosts[k]) for k in picked] + [-1] * 40
    assert peak < 6 * url_filters.STATE_BYTES
    table = spark.createDataFrame([(k, f"http://{hosts[k]}.org/a") for k in picked], "page_id long, url string")
    got = url_filters.judge_urls(table, (), automaton.globs).collect()
    assert {(r.page_id, r.verdict, r["glob"]) for r in got} == {(k, "block", f"*.{hosts[k]}.org/**") for k in picked}


# --- 6: sharding ---------------------------------------------------------------------------


@pytest.mark.parametrize("extra", [[], ODD_ROWS + [(1, "same")] * 500])
def test_shards_are_a_gapless_permutation(spark, extra):
    rows = [(k, f"text {k} " * (k % 7)) for k in range(1000)] + extra
    table = spark.createDataFrame(rows, DOC)
    placed = sharding.shuffle_into_shards(table, n_shards=7, bucket_bytes=4000)
    got = placed.select("record.*", "shard", "slot").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    if not extra:
        again = sharding.shuffle_into_shards(table.repartition(3), n_shards=7, bucket_bytes=4000)
        assert {(r.doc_id, r.shard, r.slot) for r in got} == {tuple(r) for r in again.select("record.doc_id", "shard", "slot").collect()}
        order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
        assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.15


def test_shards_of_nothing_and_of_little(spark, tmp_path):
    assert sharding.shuffle_into_shards(spark.createDataFrame([], DOC)).count() == 0
    sharding.write_shards(spark.createDataFrame([(1, "a"), (2, None)], DOC), str(tmp_path / "out"), n_shards=40)
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_ordinal_fit_is_the_penalised_optimum():
    """No cap on features, and a stationary point: every slope of the likelihood is matched by its penalty."""
    rng = np.random.default_rng(3)
    grade = rng.integers(0, 3, 900)
    x = rng.random((900, 700)) < np.where(np.arange(700) < 600, 0.05 + 0.25 * (grade[:, None] == 2), 0.1)
    row, feature = np.nonzero(x)
    settings = toxicity.Settings(ridge=1e-3)
    chosen = toxicity.choose_features(row, feature, grade, settings)
    assert chosen.size > 512
    model = toxicity.fit_ordinal(row, feature, grade, settings)
    above = np.concatenate((np.ones((900, 1)), model.at_least(x.astype(float) @ model.weights[:700]), np.zeros((900, 1))), axis=1)
    rest = 1 - above[np.arange(900), grade] - above[np.arange(900), grade + 1]
    slope = x[:, chosen].T @ rest / 900 - settings.ridge * model.weights[chosen]
    assert np.abs(slope).max() < 1e-3


# --- 7: decontamination --------------------------------------------------------------------


def test_leaks_are_found_and_clean_rows_left(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, rng.randrange(15, 60))) for k in range(60)]
    rows, leaks = [], {}
    for k in range(400):
        words = prose(rng, rng.randrange(20, 300)).split()
        if k % 8 == 0:
            item, text = rng.choice(items)
            part = text.split()
            if k % 16 == 0:  # a paraphrase: some words gone, some replaced
                part = [w if rng.random() > 0.12 else rng.choice(WORDS) for w in part if rng.random() > 0.04]
            at = rng.randrange(len(words))
            words = words[:at] + part + words[at:]
            leaks[k] = item
        text = " ".join(words)
        rows.append((k, text.upper() if k % 24 == 0 else text))
    table = docs(spark, rows + [(1000, None), (1001, ""), (None, items[3][1]), (None, items[3][1])])
    bench = spark.createDataFrame(items + [(500, None), (501, "too short"), (None, None)], "item_id long, text string")
    for block in (2000, 25):
        got = decontaminate.find_contamination(table, bench, decontaminate.Settings(block=block)).collect()
        assert len(got) == len(rows) + 4
        found = {r.record.doc_id: r.item_id for r in got if r.contaminated and r.record.doc_id is not None}
        assert found == leaks
        assert all(r.contaminated and r.item_id == 3 for r in got if r.record.doc_id is None)


def test_empty_benchmark_and_empty_table(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.find_contamination(docs(spark, ODD_ROWS), bench).collect()
    assert len(got) == len(ODD_ROWS) and not any(r.contaminated for r in got)
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    assert decontaminate.find_contamination(docs(spark, []), bench).count() == 0


def test_short_items_are_matched_word_for_word(spark):
    items = [(1, "What is the capital of France?"), (2, "capital of Spain"), (3, "yes"), (4, "capital of france"), (5, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, "Quiz: what is the CAPITAL of france, please"),
        (2, "the capital, of: Spain"),
        (3, "yes"),
        (4, "yes indeed"),
        (5, "what is the best capital of large france"),
        (6, "capital of"),
        (7, "spain capital of"),
        (8, "no " * 30 + "capital of france"),
    ]
    got = decontaminate.find_contamination(docs(spark, rows), bench).collect()
    found = {r.record.doc_id: (r.item_id, r.share, r.cosine) for r in got if r.contaminated}
    assert {k: v[0] for k, v in found.items()} == {1: 1, 2: 2, 3: 3, 8: 4}
    assert {v[1:] for v in found.values()} == {(1.0, 1.0)}


def test_equal_shares_go_to_the_first_item(spark):
    rng = random.Random(9)
    long, short = prose(rng, 60), prose(rng, 12)
    rows = [(1, f"{long} {prose(rng, 40)} {short}"), (2, f"{short} {prose(rng, 40)} {long}"), (3, prose(rng, 90))]
    for order in ([(1, long), (2, short)], [(1, short), (2, long)]):
        bench = spark.createDataFrame(order + [(k, prose(rng, 30)) for k in range(10, 40)], "item_id long, text string")
        for block in (1, 2000):
            got = decontaminate.find_contamination(docs(spark, rows), bench, decontaminate.Settings(block=block)).collect()
            assert {r.record.doc_id: (r.item_id, r.share) for r in got if r.contaminated} == {1: (1, 1.0), 2: (1, 1.0)}


def test_verdicts_and_recall_do_not_depend_on_blocks(spark):
    """Paraphrases with a share of their words replaced; the whole benchmark gives one basis."""
    rng = random.Random(10)
    items = [(k, prose(rng, rng.randrange(20, 60))) for k in range(80)]
    rows, shares = [], {}
    for k in range(240):
        words = prose(rng, rng.randrange(30, 200)).split()
        if k % 4:
            share = (0.1, 0.2, 0.3)[k % 4 - 1]
            part = [w if rng.random() > share else rng.choice(WORDS) for w in rng.choice(items)[1].split()]
            at = rng.randrange(len(words))
            words, shares[k] = words[:at] + part + words[at:], share
        rows.append((k, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    seen = []
    for block in (10, 2000):
        got = decontaminate.find_contamination(docs(spark, rows), bench, decontaminate.Settings(block=block)).collect()
        seen.append(sorted((r.record.doc_id, r.item_id or -1, r.share or 0.0, r.cosine or 0.0) for r in got))
    assert [r[:3] for r in seen[0]] == [r[:3] for r in seen[1]]
    assert np.allclose([r[3] for r in seen[0]], [r[3] for r in seen[1]], atol=1e-4)  # single precision
    found = {doc for doc, item, *_ in seen[0] if item >= 0}
    assert not {k for k in found if k % 4 == 0}
    for share, least in ((0.1, 0.95), (0.2, 0.9)):
        planted = {k for k, v in shares.items() if v == share}
        assert len(found & planted) >= least * len(planted)


def test_a_benchmark_beyond_its_bound_is_refused(spark):
    bench = spark.createDataFrame([(1, "word " * 50)], "item_id long, text string")
    with pytest.raises(ValueError, match="at most 100"):
        decontaminate.find_contamination(docs(spark, []), bench, decontaminate.Settings(max_bytes=100))


def test_common_subsequence_equals_the_table():
    rng = random.Random(8)
    items = decontaminate.Items([0], [np.array([rng.randrange(6) for _ in range(70)], np.uint64)], np.arange(6, dtype=np.uint64))
    judge = decontaminate.Judge(items, np.ones(7), np.eye(6, dtype=np.float32), decontaminate.Settings())
    for _ in range(20):
        window = [rng.randrange(8) for _ in range(rng.randrange(90))]
        row = [0] * 71
        for x in window:
            new = [0]
            for k, y in enumerate(items.words[0].tolist()):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
            row = new
        assert judge.common(0, window) == row[-1]


# --- 8: exact dedup ------------------------------------------------------------------------


@pytest.mark.parametrize("fan", [2, 8])
def test_exact_duplicates(spark, fan):
    rng = random.Random(9)
    rows = [(k, rng.choice(["Hot", "HOT", f"t{rng.randrange(50)}", "x" * 2000])) for k in range(20, 600)] + ODD_ROWS
    norm = lambda t: (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    expected = Counter()
    for i, t in rows:
        ids = groups[norm(t)]
        keep = max((x for x in ids if x is not None), default=None)
        expected[(i, keep, len(ids), i == keep, hashlib.sha256(norm(t)).hexdigest())] += 1
    table = docs(spark, rows).repartition(9)
    assert Counter(tuple(r) for r in exact_dedup.exact_duplicates(table, fan).collect()) == expected
    kept = exact_dedup.distinct_texts(table, fan)
    assert kept.columns == table.columns
    assert Counter(norm(r.text) for r in kept.collect()) == Counter(groups.keys())


def test_exact_duplicates_of_nothing(spark):
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0
    assert exact_dedup.distinct_texts(docs(spark, [])).count() == 0


# --- 9: near dedup -------------------------------------------------------------------------


def components_by_hand(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        low = (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
        w = re.findall(rb"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize(("width", "block"), [(4, 256), (5, 8)])
def test_near_duplicates(spark, width, block):
    rng = random.Random(10)
    rows = [(1, None), (2, ""), (3, " "), (4, "one"), (5, "One"), (6, "a b c"), (7, "A  b c"), (8, "a b c d e f")]
    for family in range(12):
        base = prose(rng, rng.randrange(30, 150)).split()
        for k in range(rng.choice([1, 2, 5, 40])):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append((1000 * (family + 1) + k, "  ".join(copy)))
    settings = near_dedup.Settings(width=width, block=block)
    table = docs(spark, rows)
    got = near_dedup.near_duplicates(table, settings)
    assert {tuple(r) for r in got.collect()} == components_by_hand(rows, width)
    kept = near_dedup.distinct_documents(table, settings)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in components_by_hand(rows, width) if r[3]}


def test_near_duplicates_of_odd_rows(spark):
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs(spark, ODD_ROWS)).collect()}
    assert got == {(1, 1, True), (2, 2, True), (3, 3, True), (None, None, True), (4, 4, True), (5, 4, False), (6, 6, True), (7, 7, True)}
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(0)
    settings = near_dedup.Settings()
    far, near = [], []
    for _ in range(40):
        values = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        for share, into in ((0.9, near), (0.3, far)):
            swapped = int(round(1000 * (1 - share) / (1 + share)))
            other = np.concatenate((values[swapped:], rng.integers(0, 2**63, swapped, dtype=np.uint64)))
            samples = near_dedup.min_samples(np.concatenate((values, other)), np.array([0, 1000]), settings.samples)
            a, b = near_dedup.odd_sketches(samples, settings.bits)
            into.append(int(np.bitwise_count(a ^ b).sum()))
    assert max(near) <= settings.most_bits < min(far)


def test_components_of_chains_and_hubs(spark):
    rows = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)] + [(201, 200)] * 3
    got = components.components(spark.createDataFrame(rows, "u long, v long"), "links")
    expected = {(k, 1) for k in range(2, 41)} | {(k, 100) for k in range(101, 160)} | {(201, 200)}
    assert {tuple(r) for r in got.collect()} == expected


# --- 10: language ID -----------------------------------------------------------------------

LANGUAGES = {
    "en": "the of and to in is that for with was this from they have which".split(),
    "de": "der die und das nicht ist mit den sich auf eine für über zwischen".split(),
    "fr": "le la les des est dans que une pour pas avec sur être très".split(),
}


def test_language_is_read_from_text_and_context(spark):
    rng = random.Random(11)
    rows = []
    for k in range(600):
        lang = rng.choice(list(LANGUAGES))
        text = " ".join(rng.choice(LANGUAGES[lang]) for _ in range(40))
        declared = lang if rng.random() < 0.9 else rng.choice([None, "en", "XX-yy"])
        rows.append((k, text, declared, f"www.{lang}{rng.randrange(3)}.{lang}", lang))
    rows += [(900, None, "de", "www.de1.de", "de"), (901, "", "fr-CA", "www.fr2.fr", "fr"), (None, None, None, None, None)]
    rows += [(902, "ΑΒΓΔΕ ζηθικ λμνξο πρστυ φχψω " * 20, None, None, "und"), (902, rows[0][1], rows[0][2], None, rows[0][4])]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, predicted string")
    got = language_id.identify_languages(table).collect()
    assert len(got) == len(rows)
    wrong = [r for r in got if r.record.predicted is not None and r.record.predicted != r.predicted]
    assert not wrong
    assert all(r.accepted == (r.predicted != "und") and 0 < r.posterior <= 1 for r in got if r.record.doc_id is not None)


def test_language_of_few_rows_keeps_its_model(spark):
    """Seven rows of Dutch are 0.2 % of the corpus; a made-up code of as many rows gets no model."""
    rng = random.Random(13)
    dutch = "het een van niet zijn voor maar ook wij hebben naar deze uit wordt gewoon schrijven".split()

    def said(words, n=40):
        return " ".join(rng.choice(words) for _ in range(n))

    rows = []
    for k in range(3500):
        lang = rng.choice(list(LANGUAGES))
        rows.append((k, said(LANGUAGES[lang]), lang, f"www.{lang}{k % 3}.{lang}", lang))
    rows += [(4000 + k, said(dutch), "nl" if k < 7 else None, "www.nl1.nl", "nl") for k in range(8)]
    rows += [(4100 + k, said(LANGUAGES["en"]), "qqx", "www.en1.en", "en") for k in range(7)]
    rows += [(4200 + k, said("ΑΒΓΔΕ ζηθικ λμνξο πρστυ φχψω".split()), None, None, "und") for k in range(8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, predicted string")
    got = language_id.identify_languages(table).collect()
    assert len(got) == len(rows)
    assert not [r for r in got if r.record.predicted != r.predicted or r.accepted != (r.predicted != "und")]


def test_language_without_labels_or_rows(spark):
    schema = "doc_id long, text string, lang string, source string"
    got = language_id.identify_languages(spark.createDataFrame([(1, "abc", None, None)], schema)).collect()
    assert [(r.predicted, r.accepted) for r in got] == [("und", False)]
    assert language_id.identify_languages(spark.createDataFrame([], schema)).count() == 0


def test_checksums_are_those_of_zlib(spark):
    rows = spark.createDataFrame([("é",), ("",)], "t string").select(F.crc32(F.col("t").cast("binary")))
    assert [r[0] for r in rows.collect()] == [zlib.crc32("é".encode()), 0]
