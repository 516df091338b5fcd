"""Spelling variants, language model scores and whitening against plain versions of themselves."""

import random
import re
import sys
import zlib
from collections import Counter
from math import log10
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

from refillspark.llm import language_model, spelling, whitening  # noqa: E402

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """Documents with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x") for i, t in rows], "doc_id long, text string, word string, n string, id string, held_out string, row string")


# ---- spelling -----------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def grouped(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abcéÿ") for _ in range(rng.randint(1, 7))) for _ in range(n)}
    long = "".join(rng.choice("abÖ") for _ in range(64))
    words |= {long, long[:-1], long + "z", long[:9] + "q" + long[10:], long + "zz", "a" * 3000, "a" * 3001, "a" * 1500 + "b" + "a" * 1499, ""}
    return {w: rng.choice((1, 2, 5, 7, 25, 40, 200, 1000)) for w in words}


@pytest.mark.parametrize("symbols", [1, 3, 6])
def test_variants_equal_all_pairs(spark, symbols):
    counts = vocabulary(symbols)
    words = spark.createDataFrame([(w, n, "x", "x") for w, n in counts.items()] + [(None, 3, "x", "x")], "word string, n long, near string, key string")
    got = [tuple(r) for r in spelling.spelling_variants(words, symbols=symbols).collect()]
    assert len(got) == len(set(got)) and set(got) == grouped(counts)
    assert any(len(w) > 64 and k for w, *_, k, _ in got) and any(r != f for _, f, r, *_ in got if f)


def test_every_variant_comes_once():
    for word in ("aab", "abcabc", "a", "ééz" * 5):
        reduced = spelling.Reduced([word], 4)
        form = [int(s) for s in reduced.forms[0]]
        want = {tuple(form)}
        for i in range(len(form)):
            want |= {tuple(form[:i] + form[i + 1 :])} | {tuple(form[:i] + [a] + form[i + 1 :]) for a in range(4)}
        for i in range(len(form) + 1):
            want |= {tuple(form[:i] + [a] + form[i:]) for a in range(4)}
        whole = [k for _, keys in reduced.variants(0, len(word) + 1) for k in keys.tolist()]
        pieces = [k for a in range(0, len(word) + 1, 2) for _, keys in reduced.variants(a, a + 2) for k in keys.tolist()]
        assert len(whole) == len(set(whole)) == len(want) and sorted(whole) == sorted(pieces)


def test_words_are_counted_with_dropped_letters(spark):
    rng = random.Random(5)
    stems = ["Wanderer", "ÉCOLE", "straße", "naïveté", "x-ray", "İstanbul", "abcdefgh", "Ṽerylong"]
    rows = [(i, " ".join(rng.choice(stems) + rng.choice(("", "s", "S.", "_")) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows += [(3, rows[3][1]), (None, "Wanderer wanderer " * 9), (81, None), (82, ""), (83, "Ab" * 70_000)]
    counts = Counter()
    for i, text in rows:
        for run in RUNS.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 7 == 0 else run] += 1
    got = {r.word: r.n for r in spelling.word_counts(frame(spark, rows), drop_every=7).collect()}
    assert got == {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5} and len(got) > 8
    assert spelling.spelling_variants(spelling.word_counts(frame(spark, []))).count() == 0


# ---- language model -----------------------------------------------------------------------------


def corpus():
    rng = random.Random(9)
    grammar = {"the": ["cat", "dog", "Ünit"], "a": ["cat", "bird"], "cat": ["sat", "ran", "the"], "dog": ["ran", "a"], "Ünit": ["sat"], "bird": ["sang", "a"]}
    rows = []
    for i in range(400):
        word, text = "the", []
        for _ in range(rng.randint(1, 80)):
            text.append(word if rng.random() < 0.9 else word.upper())
            word = rng.choice(grammar.get(word, ["the", "a"])) if rng.random() < 0.95 else f"rare{rng.randint(0, 500)}"
        rows.append((i, rng.choice((" ", "\t", "\n")).join(text)))
    return rows + [(7, rows[7][1]), (7, rows[7][1]), (None, "the cat"), (401, None), (402, ""), (403, " \x0b"), (404, "the cat \x1c a\x85b"), (405, "cat " * 40_000)]


def learns(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 != 2


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w] + ["\n"]


@pytest.mark.parametrize("most_known", [10, 65_536])
def test_scores_of_plain_counts(spark, most_known):
    rows = corpus()
    c = Counter(w for i, t in rows if learns(i) for w in words_of(t))
    n, v = sum(c.values()), len(c)
    want = sorted(
        ((i is None, i or 0, i is not None and not learns(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, t in rows for ws in [words_of(t)])
    )
    got = language_model.language_model_scores(frame(spark, rows), most_known=most_known, slice_bytes=3000).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held) and all(r.score < 0 for r in got)
    again = {r.doc_id: r.score for r in got if r.doc_id == 7}
    assert len(again) == 1 and len({r.score for r in got if r.doc_id == 7}) == 1


def test_all_words_together_have_probability_one(spark):
    shape = language_model.Shape(classes=6, heads=4, bits=8)
    rows = frame(spark, corpus()).selectExpr("doc_id AS id", "text", "crc32(cast(cast(doc_id AS string) AS binary)) AS fold", "doc_id IS NOT NULL AS learns")
    model, counts, _, _ = language_model.fit(rows, shape=shape, most_known=20, rounds=2, rate=0.3, share_tokens=10_000, slice_bytes=10_000)
    c = {r.word.encode(): r.learnt for r in counts.collect()}
    unknown = {language_model.class_of(w, 6): w for w in (f"zzz{k}".encode() for k in range(2000)) if w not in c}
    assert len(unknown) == 6
    steps = language_model.Steps(model)
    assert any(np.abs(t).max() > 0.5 for t in model.tables)
    for context in ([b"the", b"cat"], [b"nothing", b"known"], [b"\n", b"dog"]):
        every = [*c, *unknown.values()]
        numbers = np.array([steps.words[w] for last in every for w in (*context, last)])
        logs = steps.run(numbers, np.tile(np.arange(3), len(every)))[2::3]
        assert sum((c.get(w, 0) + 1) * np.exp(x) for w, x in zip(every, logs)) == pytest.approx(1, abs=1e-4)


def test_steps_raise_the_likelihood():
    texts = [t for _, t in corpus()[:300]]
    c = Counter(w for t in texts for w in language_model.tokens(t))
    mass = np.ones(4)
    for w, n in c.items():
        mass[language_model.class_of(w, 4)] += n + 1
    model = language_model.Model(language_model.Shape(4, 4, 10), list(c.items()), mass)
    steps = language_model.Steps(model)
    numbers, places, _ = steps.encoded(texts)
    before = steps.run(numbers, places).sum()
    # The gradient is that of the log likelihood: a small step along it gains its squared length.
    steps.run(numbers[:50], places[:50], 1e-3)
    moved = [t.copy() for t in model.tables]
    assert any(np.abs(t).sum() for t in moved)
    for _ in range(3):
        steps.run(numbers, places, 0.2)
    assert steps.run(numbers, places).sum() > before + 0.1 * len(numbers)


# words beyond the 16 most frequent of a class had the share of their counts in it, whatever came before.
def test_all_known_words_follow_their_context():
    words = [f"w{k:02d}zz" for k in range(60)]  # one class
    texts = [" ".join(f"c{k}x {w}" for k, w in enumerate(words))] * 40
    c = Counter(w for t in texts for w in language_model.tokens(t))
    shape = language_model.Shape()
    mass = np.ones(shape.classes)
    for w, n in c.items():
        mass[language_model.class_of(w, shape.classes)] += n + 1
    steps = language_model.Steps(language_model.Model(shape, list(c.items()), mass))
    numbers, places, _ = steps.encoded(texts)
    for _ in range(3):
        steps.run(numbers, places, 0.5)
    pairs = np.array([steps.words[x.encode()] for before in range(60) for w in words for x in (f"c{before}x", w)])
    logs = steps.run(pairs, np.tile(np.arange(2), 3600))[1::2].reshape(60, 60)
    own = np.diag(logs)
    assert (own > (logs.sum(axis=0) - own) / 59 + 0.5).all()


def test_texts_are_split_as_their_tokens_are():
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \t\n\x0b\x0c\rABcd\x1c\x85\u2003\u3000ÉİñZ\x00") for _ in range(rng.randint(0, 30))) for _ in range(2000)] + [None, "", "  ", "\x0b"]
    words, sizes = language_model.split(pa.array(texts, pa.string()))
    words, ends = [w.encode() for w in words.to_pylist()], np.cumsum(sizes)
    assert [[*words[b - n : b], b"\n"] for b, n in zip(ends, sizes)] == [language_model.tokens(t) for t in texts]


def test_nothing_to_learn_from(spark):
    assert language_model.language_model_scores(frame(spark, [])).count() == 0
    held = next(i for i in range(99) if not learns(i))
    (r,) = language_model.language_model_scores(frame(spark, [(held, "one two")])).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and r.score < 0


# ---- whitening ----------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], "vec_id long, embedding array<double>, x string, id string, component string")


def plain(rows, k=16):
    x = [(i, np.floor(64 * np.array(v)).astype(object) + 1_000_000) for i, v in rows]
    fit = np.array(sorted({tuple(v) for _, v in x}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = np.array((fit * n - s), dtype=float) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    keep = e > 1e-12 * e[0]
    e, q = e[keep], q[:, keep]
    trace = np.trace(centred.T @ centred / n)
    out = []
    for i, v in x:
        off = v * n - s
        y = (np.array(off, dtype=float) / n) @ q / np.sqrt(e)
        out += [(i, c + 1, n, int((off * off).sum()), abs(y[c]), e[c] / trace) for c in range(len(e))]
    return out


@pytest.mark.parametrize("d", [3, 24])
def test_whitening_equals_the_dense_solution(spark, d):
    rng = np.random.default_rng(d)
    mix = rng.standard_normal((d, d)) * np.linspace(3, 0.2, d)[:, None]
    rows = [(int(i), (rng.standard_normal(d) @ mix).tolist()) for i in range(300)]
    rows += [(5, rows[5][1])] * 40 + [(5, rows[6][1]), (None, rows[7][1])]
    bad = [(900, None), (901, [None] + rows[0][1][1:]), (902, [float("nan")] * d), (903, [float("inf")] * d), (904, rows[0][1][:-1]), (905, [])]
    got = sorted((r.vec_id is None, r.vec_id or 0, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in whitening.whiten(vectors(spark, rows + bad)).collect())
    want = sorted((i is None, i or 0, *r) for i, *r in plain(rows))
    assert len(got) == len(want) == len(rows) * min(d, 16)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-6, abs=1e-7)
    whitened = whitening.whiten(vectors(spark, rows))
    assert whitened.agg({"identity_error": "max"}).first()[0] < 1e-9
    assert {round(r.v, 9) for r in whitened.groupBy("vec_id").agg({"identity_error": "max"}).withColumnRenamed("max(identity_error)", "v").collect()} == {round(whitened.first().identity_error, 9)}


def test_whitening_of_awkward_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # one distinct vector
    flat = [(i, [float(i), 5.0, float(-i)]) for i in range(10)]  # one direction only
    assert {r.component for r in whitening.whiten(vectors(spark, flat)).collect()} == {1}
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(vectors(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0])])).collect()
    with pytest.raises(Exception, match=r"int64|too large|overflow|Overflow|bigger"):
        whitening.whiten(vectors(spark, [(1, [1e11, 0.0]), (2, [0.0, 1.0])])).collect()


@pytest.mark.parametrize("kind", ["random", "clusters", "diagonal", "equal", "wide"])
def test_leading_pairs(kind):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    e = {"random": rng.random(40), "clusters": np.repeat([5.0, 5.0 - 1e-9, 1.0, 0.0], 10), "diagonal": np.arange(40.0), "equal": np.ones(40), "wide": 10.0 ** -np.arange(40)}[kind]
    a = np.diag(e) if kind in ("diagonal", "equal") else (q * e) @ q.T
    a = (a + a.T) / 2
    values, found = whitening.leading_pairs(a, 16)
    assert values == pytest.approx(np.sort(np.linalg.eigvalsh(a))[::-1][:16], abs=1e-13 * max(1, e.max()))
    assert found.T @ found == pytest.approx(np.eye(16), abs=1e-12)
    assert a @ found == pytest.approx(found * values, abs=1e-11 * max(1, e.max()))
    diagonal, off, basis = whitening.tridiagonal(a)
    assert (basis @ (np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)) @ basis.T) == pytest.approx(a, abs=1e-12 * max(1, e.max()))
    assert whitening.leading_pairs(np.zeros((3, 3)), 2)[0].tolist() == [0, 0]


def test_scores_beyond_64_bits_are_refused(spark):
    from refillspark.llm import topk

    for far in (1e300, -1e308, 3e6):
        vectors = spark.createDataFrame([(0, [far, 1.0]), (1, [far, 2.0])], "vec_id long, embedding array<double>")
        with pytest.raises(ValueError, match="64 bits"):
            topk.top_k(vectors)
    vectors = spark.createDataFrame([(0, [1e6, 1.0]), (1, [1e6, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(vectors).collect()] == [(0, 1, 1, 1024_000_000**2 + 2 * 1024 * 1024)]
