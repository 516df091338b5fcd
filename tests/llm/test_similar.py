"""The pipeline's near-duplicates stage against brute force."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import corpus_pipeline  # noqa: E402

from refillspark.llm import simhash  # noqa: E402


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stage_keeps_one_of_each_group_of_similar_texts(spark):
    rng = random.Random(3)
    rows = []
    for g in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(80, 200))]
        rows.append((g * 10, " ".join(words)))
        for k in (1, 2):  # few words differ: similar, but their fingerprints lie apart
            other = list(words)
            for at in rng.sample(range(10, len(words) - 10), k):
                other[at] = f"x{rng.randrange(5000)}"
            rows.append((g * 10 + k, " ".join(other)))
        far = [w if i % 4 else f"y{rng.randrange(5000)}" for i, w in enumerate(words)]
        rows.append((g * 10 + 3, " ".join(far)))
    rows += [(900, ""), (901, None), (902, "A  b"), (903, "a B"), (903, "a B"), (3, "another text of a repeated id"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates_stage(spark, docs, "").collect()
    root = {(i, t): (i, t) for i, t in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            x, y = shingles(a[1]), shingles(b[1])
            if a != b and (x == y or len(x & y) >= 0.8 * len(x | y)):
                p, q = sorted((find(a), find(b)), key=lambda r: (r[0], r[1] or ""))
                root[q] = p
    want = sorted((i, t or "") for i, t in root if find((i, t)) == (i, t))
    assert sorted((r.doc_id, r.text or "") for r in kept if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in kept) == 2 and len(want) < len(rows) - 70
    assert simhash.keep_one_of_similar(docs.limit(0)).count() == 0


# two partners a key missed 188 of 3,000 such pairs.
def test_no_similar_pair_is_missed(spark):
    rng = random.Random(11)
    rows = []
    for g in range(600):
        words = [f"w{rng.randrange(100_000)}" for _ in range(100)]
        other = list(words)
        for at in (rng.randrange(10, 40), rng.randrange(55, 90)):  # 86 of 106 shingles are common
            other[at] = f"x{rng.randrange(100_000)}"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
    kept = simhash.keep_one_of_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(0, 1200, 2))


def test_blocks_pair_all_texts_of_other_groups(spark):
    rows = [(i, 100 + i % 9, [1, 2, 3, 4, 5, 6, 7, 8], [7, 50 + i % 3]) for i in range(60)]
    prefixes = spark.createDataFrame(rows, "node long, size int, parity array<long>, prefix array<long>")
    roots = spark.createDataFrame([(i, i % 5) for i in range(40)], "node long, root long")
    root = {i: i % 5 if i < 40 else i for i in range(60)}
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if root[a] != root[b]}
    got = [tuple(r) for r in simhash._other_pairs(prefixes, roots, 0.8, block=8).collect()]
    assert len(got) == len(set(got)) and set(got) == want


# Long texts that share a passage were all compared in full: on 0.51 GB their sets took over 1 GB of shuffle.
def test_only_pairs_that_share_enough_of_their_prefixes_are_compared(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(1500)] + passage for _ in range(12)]
    for words in texts[:6]:  # 25 to 33 changes of five shingles each: similarities of 0.80 to 0.85
        other = list(words)
        for at in rng.sample(range(5, 1495, 10), rng.randint(25, 33)):
            other[at] = f"x{rng.randrange(10**6)}"
        texts.append(other)
    short = [f"s{rng.randrange(50)}" for _ in range(9)]
    texts += [short, short[1:], short[:-1], [*short, "t1"], ["t2", *short], short[:5], short[:6]]
    rows = spark.createDataFrame([(" ".join(t),) for t in texts], "text string")
    sets = [set(simhash.shingle_set(" ".join(t).encode().split()).tolist()) for t in texts]
    levels = simhash.np.zeros(simhash._COUNTERS, dtype=simhash.np.uint8)
    prefixes = simhash._text_prefixes(rows, levels, 5, 0.8, 1 << 20)
    number = {n.node: i for i, n in enumerate(simhash._text_sets(rows, 5, 1 << 20).collect())}
    assert len(number) == len(texts)
    got = {tuple(sorted((number[r.src], number[r.dst]))) for r in simhash._other_pairs(prefixes, spark.createDataFrame([], "node long, root long"), 0.8).collect()}
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))]
    want = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want <= got and len(want) >= 8
    assert not {(a, b) for a, b in got if b < 18 and b != a + 12}
