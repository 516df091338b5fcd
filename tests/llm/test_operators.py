"""The corpus operators against brute force, on small fixtures with awkward rows."""

import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

from refillspark.llm import bpe, decontam, graph, pii, quality, sharding, simhash, substring, tokens, topk, toxicity  # noqa: E402

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, id string, chunk string, score string, label string"


def frame(spark, rows):
    """Documents with null columns and with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), "x", "x", "x", "x", "x") for i, t in rows], SHAPE)


def sample(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("the", "ing", "Ör", "stu", "12", "x'") for b in ("", "re", "ed.", ",", "é")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))) for _ in range(n)]
    texts += [texts[3], texts[3], texts[5] + " more", None, "", " \n\t ", "a" * 5000, "  double  spaces \n here ", "word " * 3000, "<|endoftext|> x <|endoftext|>", "\x1c\x85　 odd  space"]
    return [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "no id at all")]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, sample())


def texts_by_row(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.public_vocabulary("byte_bpe_50k.json"))
    want = sorted(((i is None, i or 0, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in texts_by_row(docs)))
    got = tokens.count_tokens(docs, batch_bytes=500).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got) and any(r.over_limit for r in got)
    assert tokens.count_tokens(docs.limit(0)).count() == 0


def test_token_counts_with_other_libraries(spark, docs):
    import sentencepiece

    path = tokens.public_vocabulary("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    few = docs.where("doc_id < 20")
    assert sorted(r.n_tokens for r in tokens.count_tokens(few, path).collect()) == sorted(len(p.encode(x or "")) for _, x in texts_by_row(few))


def test_bpe_equals_tiktoken_and_round_trips(spark, docs):
    import tiktoken

    ranks = bpe.read_ranks(bpe.public_vocabulary("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=bpe.split_pattern(), mergeable_ranks=ranks, special_tokens={})
    want = sorted(
        (str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest())
        for i, x in texts_by_row(docs)
        for ids in [enc.encode_ordinary(x or "")]
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_texts(docs, slice_bytes=700).collect()) == want
    whole = bpe.encode_texts(docs.where("doc_id = 7"), keep="ids").first()
    assert whole.ids == enc.encode_ordinary(dict(texts_by_row(docs))[7]) and whole.decoded == dict(texts_by_row(docs))[7]


# Pipeline, encoding: the memos were cut between slices only, and kept words that never came again.
def test_bpe_remembers_a_bounded_number_of_repeated_words():
    worker = bpe._Worker(bpe.public_vocabulary("byte_bpe_50k.tiktoken"), bpe.split_pattern())
    once, twice = " ".join(f"only{i}x" for i in range(300)), " ".join(f"again{i}y," for i in range(300))
    texts = pa.array([f"a {once} {twice}", f"b {twice}"])
    got = [(n, ids, decoded.decode()) for n, ids, decoded in bpe._coded(texts, worker, 50)]
    assert [d for _, _, d in got] == texts.to_pylist()
    assert [ids for _, ids, _ in got] == [" ".join(map(str, worker.ids(t))) for t in texts.to_pylist()]
    assert 0 < len(worker.seen) <= 50 and 0 < len(worker.of_piece) <= 50
    assert not [w for w in (*worker.seen, *worker.of_piece) if "only" in w]


def test_bpe_on_random_bytes_and_long_runs():
    import tiktoken

    ranks = bpe.read_ranks(bpe.public_vocabulary("byte_bpe_50k.tiktoken"))
    coder = bpe.BytePairCoder(ranks)
    enc = tiktoken.Encoding("own", pat_str=bpe.split_pattern(), mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    for piece in ["a" * 3000, "ab" * 2000, " " * 700, *("".join(rng.choice("abcdeinst") for _ in range(rng.randint(1, 60))) for _ in range(2000))]:
        for part in re.findall(r" +|[a-z]+", piece):
            assert coder.encode(part.encode()) == enc.encode_ordinary(part)


def test_fingerprints_and_components_equal_brute_force(spark, docs):
    import xxhash

    def fp(text):
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0

    rows = [(i, fp(t)) for i, t in texts_by_row(docs)]
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{f:016x}") for i, f in rows)
    group = {f: {f} for _, f in rows}
    for a in list(group):
        for b in list(group):
            if (a ^ b).bit_count() <= 2 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    least = lambda f: min((i for i, g in rows if g in group[f] and i is not None), default=None)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(i), str(least(f))) for i, f in rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_ball_links_join_all_close_fingerprints(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(8):
        centre = rng.getrandbits(64)
        fps |= {centre} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(20)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.ball_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"))
    roots = {r.node: r.root for r in graph.components(links).collect()}
    for a in fps:
        for b in fps:
            if a != b and (a ^ b).bit_count() <= 2:
                assert roots[signed(a)] == roots[signed(b)]


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(5, 5), (900, 901), (901, 900)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {found[i] for i in range(100, 161)} == {100} and {found[i] for i in range(7, 60)} == {7} and found[901] == 900 and 5 not in found
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


PERSONAL = "Write to a.b@c.example.com_d@e.fr or x@y, call +1 (017) 555-7713 or +12 34; 4111 1111 1111 1111 and 4111 1111 1111 1112, 1.2.3.4.5.6.7.8 but 999.1.1.1. IBAN: DE89 3704 0044 0532 0130 00, token = \"a1b2c3d4e5f6a7b8c9d0e1f2\", DE00 3704 0044 0532 0130 00. é +33 1 23 45 67 89"


def plain_spans(text):
    luhn = lambda d: sum((lambda n: n - 9 if n > 9 else n)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m.group())]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(6)
    texts = [PERSONAL, ""] + ["".join(rng.choice("ab1234567890.@+-_ ()%é") for _ in range(120)) for _ in range(1500)]
    assert any(k == "card" for t in texts for k, _, _ in plain_spans(t))
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t)


def test_personal_data_rows_and_masks(spark):
    df = frame(spark, [(1, PERSONAL), (2, None), (3, ""), (4, "clean text"), (4, "clean text"), (None, "x@y.zz")])
    rows = pii.find_personal_data(df).collect()
    [r] = [r for r in rows if r.doc_id == 1]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in plain_spans(PERSONAL)) for k in pii.BASE)
    assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(PERSONAL)).encode()).hexdigest()
    kinds = [s.split(":")[0] for s in r.spans.split(",")]
    assert kinds.count("iban") == 1 and "secret" in kinds
    assert len(rows) == 6 and {x.spans for x in rows if x.doc_id in (2, 3, 4)} == {""}
    masked = {x.doc_id: x for x in pii.mask_personal_data(df).collect()}
    assert masked[4].text == "clean text" and masked[2].text is None and masked[None].text == "<email>"
    assert "4111 1111 1111 1111" not in masked[1].text and masked[1].n_chars == len(masked[1].text)
    assert pii.mask_personal_data(df).columns == df.columns


def labelled(spark, n=400):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [rng.choice(["tree", "river", "mountain", "walks", "slowly", "green"]) for _ in range(rng.randint(5, 60))]
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["awfulslur", "nastyword"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(bad)))
    return frame(spark, rows + [(1000, None), (1001, ""), (None, "tree awfulslur")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("scores, label, folds, fold", [(toxicity.toxicity_scores, "toxic", 3, 1), (quality.quality_scores, "quality", 5, 0)])
def test_classifiers_on_held_out_rows(spark, scores, label, folds, fold):
    docs, labels = labelled(spark)
    got = scores(docs, labels).collect()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    assert len(got) == 403 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum((r.score >= 0.5) == (truth[r.doc_id] == 1) for r in held) / len(held) > 0.9
    assert {r.score for r in scores(docs, labels.limit(0)).collect()} == {0.5}
    flipped = labels.withColumn(label, 1 - labels[label]).where(f"crc32(cast(cast(doc_id as string) as binary)) % {folds} = {fold}")
    unlearnt = labels.where(f"crc32(cast(cast(doc_id as string) as binary)) % {folds} <> {fold}")
    again = {(r.doc_id): r.score for r in scores(docs, unlearnt.union(flipped)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)


def test_toxic_rows_go_and_clean_ones_stay(spark):
    docs, labels = labelled(spark)
    kept = toxicity.keep_civil(docs, labels)
    ids = {r.doc_id for r in kept.collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert kept.columns == docs.columns and {1000, 1001} <= ids
    assert sum(truth[i] == 0 for i in ids if i in truth) / sum(v == 0 for v in truth.values()) > 0.98
    assert sum(truth[i] for i in ids if i in truth) / sum(truth.values()) < 0.1


@pytest.mark.parametrize("rows", [[(i, "same" if i % 3 == 0 else f"t{i // 2}") for i in range(1000)], [(i, None if i % 2 else "") for i in range(11)], sample(), []])
def test_shards_are_even_and_slots_gapless(spark, rows):
    got = sharding.balanced_shards(frame(spark, rows), bucket_rows=50).collect()
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {(r.law, r.grown_shard) for r in got} <= {("rows", None)}


def test_linked_documents_share_a_shard_where_they_fit(spark):
    rows = [(i, f"pair {i // 2}" if i < 200 else f"single {i}") for i in range(1600)]
    got = {r.doc_id: r.shard for r in sharding.balanced_shards(frame(spark, rows)).collect()}
    assert sum(got[i] != got[i + 1] for i in range(0, 200, 2)) <= 2


@pytest.mark.parametrize("size", [2, 4, 10])
def test_few_groups_are_cut_where_all_rows_are_linked(spark, size):
    rows = [(i, f"group {i // size}") for i in range(4000)] + [(None, "no id")] * 40
    got = sharding.balanced_shards(frame(spark, rows), bucket_rows=100).collect()
    by, counts = {}, [0] * 8
    for r in got:
        counts[r.shard] += 1
        if r.doc_id is not None:
            by.setdefault(r.doc_id // size, set()).add(r.shard)
    assert max(counts) - min(counts) <= 1
    assert sum(len(s) > 1 for s in by.values()) <= 16


def test_cut_edges_go_down_by_propagation(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"t{i}") for i in range(2000)]  # groups too large to move as a whole, by another key
    got = sharding.balanced_shards(frame(spark, rows), link_key=F.expr("doc_id % 5"), parts=16).collect()
    sizes = {}
    for r in got:
        sizes[r.doc_id % 5, r.shard] = sizes.get((r.doc_id % 5, r.shard), 0) + 1
    together = sum(n * (n - 1) for n in sizes.values()) / (5 * 400 * 399)
    assert together > 0.3 and max(sum(n for (_, s), n in sizes.items() if s == x) for x in range(8)) == 250  # by chance: 0.125; at most 0.53 fit


QUESTION = "If Alice buys 12 kg of apples and sells 5 kg of them to Bob, how many kg of apples does she still have at home?"


def test_contamination_by_templates(spark):
    rows = [
        (1, "Intro words. " + QUESTION + " And more."),
        (2, "Once. " + QUESTION.replace("Alice", "Carol").replace("12 kg", "30 lb").replace("5 kg", "7 lb").replace("many kg", "many lb").replace("Bob", "Dave")),
        (3, "Apples are sold at home by many people who still have them."),
        (4, None), (5, ""), (6, QUESTION.upper()), (7, "tiny item here"), (1, "again, another row"), (None, QUESTION),
    ]
    docs = frame(spark, rows)
    bench = spark.createDataFrame([(1, QUESTION, None), (2, "tiny item", None), (3, None, "x"), (4, "...", "x")], "item_id long, text string, hash string")
    found = {(r.doc_id, r.item_id): r for r in decontam.contamination(docs, bench).collect()}
    assert {(1, 1), (2, 1), (7, 2)} <= set(found) and not {k for k in found if k[0] in (3, 4, 5)}
    assert found[1, 1].kind == "exact" and found[1, 1].containment == 1.0
    assert found[2, 1].kind == "reparameterised" and found[2, 1].slot_agreement == 1.0
    kept = [r.doc_id for r in decontam.keep_uncontaminated(docs, bench).collect()]
    assert {3, 4, 5, None} <= set(kept) and not {1, 2, 7} & set(kept)
    assert decontam.contamination(docs, bench.limit(0)).count() == 0
    numbers = spark.createDataFrame([(9, "1 2 3 4 5 6 7 8", None)], "item_id long, text string, hash string")
    assert [r.doc_id for r in decontam.contamination(frame(spark, [(1, "1 2 3 4 5 6 7 8"), (2, "9 9 9 9 9 9 9 9")]), numbers).collect()] == [1]


def test_top_k_equals_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([0.0, rng.uniform(-1, 1)]) for _ in range(8)]) for i in range(250)]
    rows += [(300, rows[5][1]), (400, rows[5][1]), (500, None), (501, [None] * 8), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (None, rows[1][1]), (7, rows[7][1]), (8, [1.0] * 8), (100, [0.5] * 8)]
    df = spark.createDataFrame([(i, v, "x", "x") for i, v in rows], "vec_id long, embedding array<double>, id string, block string")
    import math

    vectors = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for own, (q, w) in enumerate(vectors):
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(w, v)), i) for at, (i, v) in enumerate(vectors) if at != own)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = topk.top_k(df, candidate_block=40, query_block=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame([(100, [1.0, 0.0]), (7, [0.1, 0.0]), (7, [0.9, 0.1]), (7, [0.1, 0.0]), (8, [0.2, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(few).orderBy("rank").collect()] == [(7, 1024 * 921), (8, 1024 * 204), (7, 1024 * 102), (7, 1024 * 102)]


def plain_removal(rows, window=20):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        w, gone = WORDS.findall(t or ""), set()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if g in seen:
                gone |= set(range(k, k + window))
            seen.add(g)
        out.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("chunk_bytes", [300, 1 << 20])
def test_removed_words_equal_brute_force(spark, chunk_bytes):
    rng = random.Random(10)
    shared = " ".join(f"w{k}" for k in range(60))
    rows = sample() + [(100 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 120)))) for i in range(30)]
    rows += [(200 + i, f"start{i} {shared} end{i}") for i in range(6)] + [(300, shared), (301, "x " + shared[:90]), (302, "q " * 50), (303, "q " * 45)]
    got = substring.remove_repeats(frame(spark, rows), chunk_bytes=chunk_bytes).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_removal(rows)
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def test_a_window_is_filed_by_its_own_words():
    rng = random.Random(11)
    for letters in ("ab", "abcdefgh", "a", [f"w{i}" for i in range(4)]):
        texts = [" ".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(40)]
        chunk = substring.Chunk(list(range(42)), [*texts, texts[3] + " " + texts[5], texts[7]], 20)
        key, at = chunk.filed(chunk.span_names(0))
        words = [w for t in chunk.texts for w in t.split()]
        filed = {}
        for i, p in enumerate(chunk.windows):
            assert filed.setdefault(tuple(words[p : p + 20]), (key[i], at[i] - p)) == (key[i], at[i] - p)


def test_words_whose_plain_sums_collide_are_told_apart(spark):
    def thue_morse(first, second, rounds=10):
        word = first
        for _ in range(rounds):
            word, first, second = word + second, first + second, second + first
        return word

    a, b = thue_morse("a", "b"), thue_morse("b", "a")
    assert len(a) == 1024 and a != b
    tail = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (None, "only one"), (None, None), (None, " ".join([tail, "z"])), (None, " ".join([tail, "z"]))]
    got = substring.remove_repeats(frame(spark, rows), chunk_bytes=500).collect()
    assert sorted(r.n_removed for r in got if r.doc_id is not None) == [0, 0]
    assert sorted(r.n_removed for r in got if r.doc_id is None) == [0, 0, 0, 20]


def doubled(run, sizes):
    """Seconds by size."""
    import time

    out = []
    for n in sizes:
        start = time.perf_counter()
        run(n)
        out.append(time.perf_counter() - start)
    return out


def test_work_on_one_long_piece_is_linear():
    import tiktoken

    ranks = bpe.read_ranks(bpe.public_vocabulary("byte_bpe_50k.tiktoken"))
    coder, rng = bpe.BytePairCoder(ranks), random.Random(12)
    piece = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4 << 20)).encode()
    coder.encode(piece[: 1 << 20])  # fills the memos
    one, two, four = doubled(lambda n: coder.encode(piece[: n << 20]), (1, 2, 4))
    assert two < 3.5 * one and four < 3.5 * two
    ids = coder.encode(piece)
    assert coder.decode(ids) == piece
    enc = tiktoken.Encoding("own", pat_str=bpe.split_pattern(), mergeable_ranks=ranks, special_tokens={})
    assert coder.encode(piece[:40_000]) == enc.encode_ordinary(piece[:40_000].decode())


def test_work_on_many_spans_is_linear():
    unit = "call 555-123-4567 or 1.2.3.4, token a1b2c3d4e5f6a7b8c9d0e1f2 x@y.zz; "
    pii.all_spans(unit * 100, pii.Rules())
    one, two, four = doubled(lambda n: pii.all_spans(unit * (n * (1 << 20) // len(unit)), pii.Rules()), (1, 2, 4))
    assert two < 3.5 * one and four < 3.5 * two
    base, every = pii.all_spans(unit * 3, pii.Rules())
    assert [k for k, _, _ in every] == ["local_phone", "ip", "secret", "email"] * 3
    assert base == plain_spans(unit * 3) and pii.base_spans("0" * 5000 + ".1.2.3") == [("ip", 0, 5006)]


def test_of_repeated_ids_the_least_text_is_learnt_from(spark):
    from refillspark.llm.learning import sampled_labels
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, None, 1), (2, "z", 1), (3, "c", 3)], "id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 7)], "doc_id long, toxic int")
    got = sampled_labels(rows, labels, id_col="doc_id", label_col="toxic", learn=F.lit(True), most_rows=9).collect()
    assert sorted((r.id, r.text, r.n_chars, r.label) for r in got) == [(1, "a", 9, 1), (2, None, 1, 0)]


def test_log_count_ratios_and_scores_equal_plain_sums():
    import math

    import numpy as np

    texts = ["böse wörter hier", "gute wörter", "bad BAD words", "good words there", "日本語の文章です", ""]
    labels = np.array([1, 0, 1, 0, 1, 0])

    def plain(text):  # of code points, A-Z as a-z
        padded = " " + "".join(c.lower() if "A" <= c <= "Z" else " " if c in " \t\n\x0b\x0c\r" else c for c in text) + " "
        return {padded[i : i + n] for n in (4, 5) for i in range(len(padded) - n + 1)}

    model = toxicity.RatioClassifier.fit([toxicity.grams(t) for t in texts], labels, least=1)
    sets = [plain(t) for t in texts]
    for t, s in zip(texts, sets):
        assert len(toxicity.grams(t)) == len(s)
    ratio = {g: math.log((sum(g in s for s, y in zip(sets, labels) if y) + 1) / 5) - math.log((sum(g in s for s, y in zip(sets, labels) if not y) + 1) / 5) for g in set().union(*sets)}
    for t, s in zip(texts, sets):
        assert math.isclose(math.sqrt(sum(ratio[g] ** 2 for g in s)), math.sqrt(model.squared[toxicity.grams(t)].sum()), rel_tol=1e-5)
        found = toxicity.grams(t)
        length = math.sqrt(sum(float(model.squared[i]) for i in found))
        margin = model.bias + (sum(float(model.scaled[i]) for i in found) / length if length else 0)
        assert math.isclose(model.score(t), 1 / (1 + math.exp(-margin)), rel_tol=1e-6)


def test_factorisation_score_equals_the_sum_over_pairs():
    import numpy as np

    rng = np.random.default_rng(1)
    n = (1 << quality._BITS) + quality._N_STATS
    model = quality.FactorisationMachine(0.3, rng.standard_normal(n), rng.standard_normal((n, quality._RANK)))
    for text in ("Some words, and MORE words | here!", "", "a b c " * 40):
        index, value = quality.features(text, None)
        pairs = sum(float(model.vectors[index[i]] @ model.vectors[index[j]]) * value[i] * value[j] for i in range(len(index)) for j in range(i + 1, len(index)))
        margin = 0.3 + sum(float(model.weights[i]) * v for i, v in zip(index, value)) + pairs
        assert abs(model.margin(index, value) - margin) < 1e-9
        assert abs(model.score(text, None) - 1 / (1 + np.exp(-np.clip(margin, -30, 30)))) < 1e-9


@pytest.mark.parametrize("operator", [
    lambda d, l, b: toxicity.toxicity_scores(d, l), lambda d, l, b: toxicity.keep_civil(d, l), lambda d, l, b: quality.quality_scores(d, l),
    lambda d, l, b: pii.find_personal_data(d), lambda d, l, b: pii.mask_personal_data(d), lambda d, l, b: bpe.encode_texts(d),
    lambda d, l, b: decontam.contamination(d, b), lambda d, l, b: decontam.keep_uncontaminated(d, b),
])
def test_empty_documents_give_no_rows(spark, operator):
    _, labels = labelled(spark, 40)
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    assert operator(frame(spark, []), labels, bench).count() == 0


def test_queries_are_not_gathered_in_the_driver(spark, tmp_path):
    rng = random.Random(3)
    spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(500)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/v")
    best = topk.top_k(spark.read.parquet(f"{tmp_path}/v"), candidate_block=10, query_block=2)
    assert len(best.collect()) == 50
    assert "Broadcast" not in best._jdf.queryExecution().executedPlan().toString()  # the plan that ran
