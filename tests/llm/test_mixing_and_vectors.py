"""Source mixing, whitening and vector codes against brute force, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import codes, mixing, whitening
from topicloom.llm.vectors import whole_rows

DOCS = "doc_id long, text string, source string, size int, target string, copies date, record int"


def documents(spark, rows):
    """``(doc_id, text, source)`` with columns that clash with the operator's own."""
    return spark.createDataFrame([(*r, 1, "t", None, 2) for r in rows], DOCS)


def corpus(rng, n=900, sources=("a", "b", "Z", "é", None)):
    """One source holds a third of all rows; sizes from nothing to thousands of words."""
    rows = []
    for k in range(n):
        source = "hot" if k % 3 == 0 else sources[k % len(sources)]
        size = int(rng.pareto(1.1) * 20) if k % 97 else 4000
        rows.append((k, "w " * min(size, 5000), source))
    return rows


# --- 11: source mixing ---------------------------------------------------------------------


def targets_by_hand(sizes, most, weights=(1, 2, 3)):
    """Share out, cut at the cap, share the excess of the cut ones again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    left = float(total)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        target |= {s: float(most * sizes[s]) for s in over}
        free -= over
        left = total - sum(target.values())
    return target


def planned(spark, rows, settings=mixing.Settings()):
    plan = mixing.plan_copies(mixing.prepare(documents(spark, rows), settings), settings)
    return plan.select("record.*", *[F.col(c).alias(f"my_{c}") for c in plan.columns if c != "record"]).collect()


def test_targets_and_taken_words(spark):
    rows = corpus(np.random.default_rng(1))
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        sizes[source] += n
        largest[source] = max(largest[source], n)
    want = targets_by_hand(sizes, 3)
    got = planned(spark, rows)
    taken = defaultdict(int)
    for r in got:
        assert r.my_size == len(r.text.split()) and r.my_taken == r.my_size * r.my_copies and 0 <= r.my_copies <= 3
        assert r.my_source_size == sizes[r.source]
        assert r.my_target == pytest.approx(want[r.source], rel=1e-12)
        taken[r.source] += r.my_taken
        # Never further from what is expected than the next integers.
        assert math.floor(r.my_expected) <= r.my_copies <= math.ceil(r.my_expected)
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(0.01 * target, 40), source
    assert Counter((r.doc_id, r.source) for r in got) == Counter((d, s) for d, _, s in rows)


def test_caps_reshare_until_none_is_above(spark):
    # b has weight 2 and hardly any words, c then gets more than three times its own.
    rows = [(1, "w " * 900, "a"), (2, "w " * 3, "b"), (3, "w " * 100, "c"), (4, "w " * 50, "d")]
    got = {r.source: r.my_target for r in planned(spark, rows)}
    want = targets_by_hand({"a": 900, "b": 3, "c": 100, "d": 50}, 3)
    assert got == pytest.approx(want) and got["b"] == 9 and got["c"] == 300


def test_mix_does_not_depend_on_partitions_or_cells(spark):
    rows = corpus(np.random.default_rng(2), 600)
    settings = mixing.Settings(rows_per_cell=7)

    def taken(df, s):
        plan = mixing.plan_copies(mixing.prepare(df, s), s)
        return sorted(plan.select("record.doc_id", "copies").collect())

    df = documents(spark, rows)
    one = taken(df.coalesce(1), settings)
    assert one == taken(df.repartition(13), settings) == taken(df.orderBy(F.desc("doc_id")), settings)
    # Small cells give up a little of the order of sizes, not the target.
    words = dict((d, len(t.split())) for d, t, _ in rows)
    total = sum(words.values())
    assert abs(sum(words[d] * c for d, c in one) - total) < 0.02 * total


def test_every_document_comes_up_as_often_as_expected(spark):
    rows = [(k, "w " * (5 + k % 4), "ab"[k % 2]) for k in range(40)]
    counts, expected = Counter(), None
    for seed in range(30):
        got = planned(spark, rows, mixing.Settings(seed=seed, phases=()))
        counts.update({r.doc_id: r.my_copies for r in got})
        expected = {r.doc_id: r.my_expected for r in got}
    assert np.mean([abs(counts[d] / 30 - e) for d, e in expected.items()]) < 0.15


def test_emitted_rows_are_whole_and_odd_rows_have_a_place(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", "a"), (None, "x y", "a"), (4, "One two three", None), (4, "One", None), (5, "q " * 30, "b")]
    out = mixing.mix_sources(documents(spark, rows))
    assert out.columns == ["record", "copy"] and out.select("record.*").columns == DOCS.replace(",", "").split()[::2]
    plan = planned(spark, rows)
    emitted = Counter((r.record.doc_id, r.record.text, r.record.source) for r in out.collect())
    assert emitted == +Counter({k: sum(r.my_copies for r in plan if (r.doc_id, r.text, r.source) == k) for k in set(rows)})
    assert {r.my_size for r in plan if r.text in (None, "")} == {0}
    assert {(r.text, r.my_size) for r in plan if r.source is None} == {("One two three", 2), ("One", 1)}


def test_no_words_and_no_rows(spark):
    assert planned(spark, []) == [] and mixing.mix_sources(documents(spark, [])).count() == 0
    assert [(r.my_target, r.my_taken) for r in planned(spark, [(1, None, None), (2, " ", "a")])] == [(0.0, 0)] * 2
    assert [(r.my_target, r.my_copies) for r in planned(spark, [(1, "a b", None), (2, "c", None)])] == [(3.0, 1)] * 2


# --- vectors -------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, code string, error int, whitened string, record int"
ODD = [None, [1.0, None, 2.0, 3.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], [1.0, 1.0, 1.0, float("-inf")]]


def vectors(spark, rows, schema=VECTORS):
    return spark.createDataFrame([(i, v, label, "c", 1, "w", 0) for i, v, label in rows], schema)


def random_rows(rng, n, size, odd=()):
    x = rng.standard_normal((n, size)).round(2)
    x[n // 2 :: 7] = x[0]  # ties and equal vectors
    rows = [(int(k), v.tolist(), None if k % 5 == 0 else int(k % 3)) for k, v in enumerate(x)]
    return rows + [(10_000 + k, v, 1) for k, v in enumerate(odd)]


def test_whole_rows_have_numbers_only(spark):
    rows = [(k, v, 0) for k, v in enumerate(ODD + [[], [0.0, -0.0, 1.0, 2.0]])]
    assert {r.vec_id for r in whole_rows(vectors(spark, rows), "embedding").collect()} == {5, 6}


# --- 12: whitening -------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 3, 7, 40])
@pytest.mark.parametrize("kind", ["random", "steep", "repeated", "equal", "zero"])
def test_spectrum_matches_a_dense_solver(size, kind):
    rng = np.random.default_rng(size)
    q, _ = np.linalg.qr(rng.standard_normal((size, size)))
    values = {
        "random": rng.random(size),
        "steep": 10.0 ** (-np.arange(size) / 3),
        "repeated": np.round(rng.random(size) * 2),
        "equal": np.ones(size),
        "zero": np.zeros(size),
    }[kind]
    a = (q * values) @ q.T
    got, basis = whitening.spectrum((a + a.T) / 2)
    assert np.allclose(got, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-13)
    assert np.allclose(basis.T @ basis, np.eye(size), rtol=0, atol=1e-13)
    assert np.allclose(a @ basis, basis * got, rtol=0, atol=1e-13)


def test_polar_factor_is_orthogonal():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((9, 9))
    a = a + a.T
    values, basis = np.linalg.eigh(a)
    assert np.allclose(whitening.polar_factor(a), (basis * np.sign(values)) @ basis.T, rtol=0, atol=1e-13)


def whitened_by_hand(kept, components):
    x = np.floor(np.array(kept, np.float32).astype(np.float64) * 64).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = (n * x - total) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    return (centred @ basis) / np.sqrt(values), values, ((n * x - total) ** 2).sum(axis=1), np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("size,components", [(4, 4), (40, 32)])
def test_whitening_matches_a_dense_solver(spark, size, components):
    odd = ODD if size == 4 else ODD[:1]
    rows = random_rows(np.random.default_rng(4), 300, size, odd)
    got = whitening.whitened_components(vectors(spark, rows).repartition(5)).toPandas().sort_values(["vec_id", "component"])
    want, values, deviation, trace = whitened_by_hand([v for _, v, _ in rows[:300]], components)
    mine = got.whitened.to_numpy().reshape(300, components)
    assert np.allclose(mine * np.sign((mine * want).sum(axis=0)), want, rtol=0, atol=1e-8)
    assert (got.deviation.to_numpy().reshape(300, -1) == deviation[:, None]).all()
    assert np.allclose(got.explained.to_numpy()[:components], values / trace, rtol=1e-10)
    assert set(got.n) == {300} and got.identity_error.max() < 1e-10
    assert got.component.to_list()[:components] == list(range(1, components + 1))


def test_whitening_keeps_rows_and_says_where_nothing_varies(spark):
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [3.0, 2.0], None)]
    df = vectors(spark, rows)
    model = whitening.fit_whitening(df)
    out = whitening.whiten(df, model)
    assert out.columns == ["record", "whitened", "deviation"] and out.select("record.*").columns == df.columns
    found = sorted(out.select("record.vec_id", "whitened").collect(), key=str)
    assert [r.whitened[1] for r in found] == [None] * 3  # the second entry is constant
    assert sorted(abs(r.whitened[0]) for r in found) == pytest.approx([2**-0.5, 2**-0.5, 2**0.5])
    assert model.explained == [1.0, 0.0]
    alone = whitening.whitened_components(vectors(spark, rows[:1])).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in alone] == [(None, None, 0, 0.0)] * 2
    for none in ([], [(1, None, 0)], [(1, [], 0)]):
        assert whitening.whitened_components(vectors(spark, none)).count() == 0
    with pytest.raises(ValueError, match="different lengths"):
        whitening.fit_whitening(vectors(spark, [(1, [1.0], 0), (2, [1.0, 2.0], 0)]).repartition(2, "vec_id"))


def test_deviation_beyond_64_bits_is_null(spark):
    far = [(k, [float(2**20 * (k % 2)), 0.0], 0) for k in range(400)]
    got = whitening.whitened_components(vectors(spark, far)).where("component = 1")
    assert {r.deviation for r in got.collect()} == {None}
    near = [(k, [float(2**10 * (k % 2)), 0.0], 0) for k in range(400)]
    got = whitening.whitened_components(vectors(spark, near)).where("component = 1")
    assert {r.deviation for r in got.collect()} == {(400 * 2**15) ** 2}


# --- 13: vector codes ----------------------------------------------------------------------


def codes_by_hand(rows, parts, n_entries, rounds):
    kept = sorted(((i, v) for i, v in rows), key=lambda r: (r[0] is None, r))
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v in kept]
    width = len(x[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in x]
    books = [[cut[k][p] for k in range(min(n_entries, len(cut)))] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), k) for k, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for v in cut:
                groups[nearest(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(c) for c in zip(*groups[k])] if groups[k] else e for k, e in enumerate(books[p])]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out = [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, _), f in zip(kept, found)]
    return out, sha


@pytest.mark.parametrize("width", [1, 2, 3, 5])
def test_walsh_keeps_scaled_distances(width):
    rng = np.random.default_rng(width)
    a, b = rng.integers(-500, 500, (6, width)), rng.integers(-500, 500, (4, width))
    n = codes.walsh(a).shape[1]
    apart = ((codes.walsh(a)[:, None] - codes.walsh(b)[None]) ** 2).sum(axis=2)
    assert (apart == n * ((a[:, None] - b[None]) ** 2).sum(axis=2)).all()
    # The first coefficient is the sum, and sign changes grow.
    rows = codes.walsh(np.eye(n, dtype=np.int64)).T
    assert ((rows[:, 1:] != rows[:, :-1]).sum(axis=1) == np.arange(n)).all()


@pytest.mark.parametrize("width", [1, 3, 4, 8, 13])
def test_nearest_is_exact_with_ties_to_the_lower_number(width):
    rng = np.random.default_rng(width)
    parts, entries = rng.integers(-3, 4, (400, width)), rng.integers(-3, 4, (30, width))
    entries[20:] = entries[:10]
    number, distance = codes.nearest(codes.walsh(parts), codes.walsh(entries))
    every = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


@pytest.mark.parametrize("size,parts,n", [(32, 16, 200), (12, 4, 90), (4, 2, 5), (8, 8, 1)])
def test_codes_match_brute_force(spark, size, parts, n):
    rows = random_rows(np.random.default_rng(5), n, size, ODD if size == 4 else ODD[:1])
    settings = codes.Settings(parts=parts, entries=16)
    want, sha = codes_by_hand([(i, v) for i, v, _ in rows[:n]], parts, 16, 2)
    got = codes.compress_vectors(vectors(spark, rows).repartition(5), settings=settings).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted(want)
    labels = {i: label for i, _, label in rows}
    sums = Counter()
    for i, _, error in want:
        sums[labels[i]] += error
    assert all(r.label_error == sums[labels[r.vec_id]] and r.codebooks_sha256 == sha for r in got)


def test_codes_of_odd_tables(spark):
    assert codes.compress_vectors(vectors(spark, [])).collect() == []
    assert codes.compress_vectors(vectors(spark, [(1, None, 0)])).collect() == []
    twice = [(1, [0.5] * 16, None), (1, [0.5] * 16, None), (None, [9.0] * 16, None)]
    df = vectors(spark, twice)
    got = codes.encode_vectors(df, codes.fit_codebooks(df))
    assert got.columns == ["record", "code", "error"] and got.select("record.*").columns == df.columns
    # Equal entries: ties go to the first, the second is used by none and stays.
    assert sorted((r.code, r.error) for r in got.collect()) == [("00" * 16, 0), ("00" * 16, 0), ("02" * 16, 0)]
    with pytest.raises(ValueError, match="equal parts"):
        codes.fit_codebooks(vectors(spark, [(1, [1.0] * 17, 0)]))
    with pytest.raises(Exception, match="vectors of"):
        codes.compress_vectors(vectors(spark, [(1, [1.0] * 16, 0), (2, [1.0] * 32, 0)])).collect()
