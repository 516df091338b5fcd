"""Contamination judged by occurrence."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

from refillspark.llm import decontam  # noqa: E402

ASKED = "If Alice buys 12 kg of apples and sells 5 kg of them to Bob, how many kg of apples does she still have at home?"


def found(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_an_exact_copy_among_variants_is_found(spark):
    variants = [ASKED.replace("Alice", a).replace("Bob", b).replace("12", n).replace("5 kg", f"{m} kg") for a, b, n, m in [("Carol", "Dave", "30", "7"), ("Erin", "Frank", "44", "9"), ("Grace", "Heidi", "61", "3"), ("Ivan", "Judy", "78", "2")]]
    words = ASKED.split()
    scattered = " filler text between. ".join(" ".join(words[i : i + 6]) for i in range(0, 16, 2))
    got = found(spark, [(1, " ".join([*variants[:2], ASKED, *variants[2:]])), (2, " ".join(variants)), (3, scattered)], [(1, ASKED)])
    assert got[1, 1].kind == "exact" and got[1, 1].containment == 1.0 and got[1, 1].slot_agreement == 1.0
    assert got[2, 1].kind == "reparameterised" and got[2, 1].slot_agreement == 1.0
    assert (3, 1) not in got  # no thirteen consecutive words of it


def test_an_item_with_words_put_in_is_still_found(spark):
    words = ASKED.split()
    got = found(spark, [(1, " ".join([*words[:12], "well then", *words[12:]])), (2, " ".join([*words[:13], *("page break " * 20).split(), *words[13:]]))], [(1, ASKED)])
    assert (1, 1) in got


TRAIN = "A train travels 120 km in 3 hours. How far does it travel in 5 hours?"
SHOP = "Maria walks to the shop near the old mill. Maria pays there. Then Peter carries the bread home and eats it."


def test_dense_questions_with_other_values_are_found(spark):
    docs = [
        (1, TRAIN.replace("120", "95").replace("3 hours", "2 days").replace("5 hours", "7 days")),
        (2, "Well. " + SHOP.replace("Maria", "Ingrid").replace("Peter", "Olaf")),
        (3, "A train travels fast. How far does it travel in 5 hours? Nobody knows."),
        (4, "The bread is carried home. Then it is eaten near the old mill."),
        (5, "A list: " + " ".join(f"{i} km in {i} hours" for i in range(40))),
    ]
    got = found(spark, docs, [(1, TRAIN), (2, SHOP), (3, "1 2 3 4 5 6 7 8")])
    assert set(got) == {(1, 1), (2, 2)}
    assert got[1, 1].containment == 1.0 and got[1, 1].longest_passage == 16 and got[1, 1].kind == "reparameterised"
    assert got[2, 2].containment == 1.0 and got[2, 2].kind == "reparameterised"


MIX = "Mix 3 kg of flour, 2 kg of sugar, 5 kg of butter and 7 eggs in a large bowl for 4 minutes."
PAID = "Alice paid 12 dollars and 30 cents, Bob paid 5 dollars and 7 cents, so how much did Alice and Bob pay together?"


def test_values_are_mapped_one_to_one(spark):
    other = PAID.replace("Alice", "Erin").replace("Bob", "Ivan").replace("12", "45").replace("30", "61").replace(" 5 ", " 8 ").replace(" 7 ", " 9 ")
    merged = PAID.replace("Alice", "Carol").replace("Bob", "Carol").replace("12", "8").replace("30", "8").replace(" 5 ", " 8 ").replace(" 7 ", " 8 ")
    mixed = MIX.replace("3", "11").replace("2", "12").replace("5", "13").replace("7", "14").replace("4", "15")
    got = found(spark, [(1, other), (2, merged), (3, mixed), (4, PAID), (None, PAID), (5, None), (5, "")], [(1, PAID), (2, MIX)])
    assert set(got) == {(1, 1), (3, 2), (4, 1)}
    assert got[1, 1].slot_agreement == 1.0 and got[1, 1].kind == "reparameterised" and got[4, 1].kind == "exact"


def test_recall_of_planted_questions_with_other_values(spark):
    import random

    rng = random.Random(5)
    names, things = ["Alice", "Bob", "Carol", "Dave", "Erin", "Frank", "Grace", "Heidi"], ["apples", "stones", "cups", "lamps", "chairs", "ropes"]
    forms = [
        "{a} has {x} {t} and gives {y} of them to {b}, who already owns {z} {t}; how many {t} do both of them hold now?",
        "A pump fills {x} litres in {y} minutes. How many litres does it fill in {z} hours if nothing is lost?",
        "When {a} walks {x} km and {b} walks {y} km on the same long road, {a} needs {z} minutes more than expected. How fast is {b}?",
    ]
    value = lambda: dict(zip("xyz", map(str, rng.sample(range(2, 900), 3)))) | dict(zip("ab", rng.sample(names, 2))) | {"t": rng.choice(things)}
    items, docs = [], []
    for i in range(60):
        v = value()
        form = forms[i % 3] + f" Think about case word{i} before you answer it in full."
        items.append((i, form.format(**v)))
        w = value() | {"t": v["t"]}
        filler = " ".join(rng.choice(["green", "river", "walks", "over", "quiet", "hills"]) for _ in range(80))
        docs += [(i, f"{filler}. {form.format(**w)} {filler}"), (1000 + i, f"{filler}. {filler}")]
    got = found(spark, docs, items)
    assert sum((i, i) in got for i in range(60)) >= 54  # recall of 0.9
    assert not [k for k in got if k[0] >= 1000]


def test_containment_equals_brute_force_without_placeholders(spark):
    import random

    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randrange(300)}x" for _ in range(rng.randint(6, 30)))) for i in range(30)]
    items = [(i, t.translate(str.maketrans("0123456789", "abcdefghij"))) for i, t in items]
    docs = []
    for d in range(60):
        words = items[rng.randrange(30)][1].split()
        cut = words[: rng.randint(3, len(words))]
        docs.append((d, " ".join(["lorem"] * rng.randint(0, 5) + cut + ["ipsum"] * 3)))
    want = {}
    for d, text in docs:
        w = text.split()
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for i, item in items:
            q = item.split()
            each = [tuple(q[k : k + 5]) for k in range(len(q) - 4)]
            runs = [n for k in range(len(q)) for n in range(1, len(q) - k + 1) if any(w[j : j + n] == q[k : k + n] for j in range(len(w) - n + 1))]
            covered = sum(x in own for x in each) / len(each)
            if covered >= 0.8 or max(runs, default=0) >= 13:
                want[d, i] = covered
    got = found(spark, docs, items)
    assert {k: r.containment for k, r in got.items()} == want and want


def test_the_sieve_keeps_all_that_the_judgement_accepts(spark, monkeypatch):
    import random

    rng = random.Random(8)
    items = [MIX, PAID, TRAIN, SHOP, ASKED, "Walk. Turn left. Go on. Stop there. Open it. Look in. Write down all.", "1 2 3 4 5 6 7 8", "Add 3kg and 5 kg", "Anne-Marie's well-known brother O'Neill met Tom at 10:30 in Rome. 12 of them came by train, 3rd class."]
    docs, cases = [], [str, str.upper, str.lower, str.title]
    for k, item in enumerate(items):
        other = item
        for a, b in [("Alice", "Jean-Luc"), ("Bob", "Olaf"), ("Maria", "Ingrid"), ("Peter", "Sven"), ("Tom", "Mary-Ann"), ("Rome", "Oslo"), ("kg", "lb"), ("km", "miles"), ("hours", "days")]:
            other = other.replace(a, b)
        numbers = "".join(str((int(c) * 7 + 3) % 10) if c.isdigit() else c for c in other)
        for text in (item, other, numbers, numbers.replace(" lb", "lb"), item.replace(".", " -- ").replace(",", ";"), item.replace(" ", "  ("), " ".join(w for w in item.split() if rng.random() > 0.07)):
            docs += [(len(docs) + i, f"{'quiet river ' * 9}. {case(text)} {'green hills ' * 9}") for i, case in enumerate(cases)]
    docs += [(10_000, "MIX 11 KG OF FLOUR, 12 KG OF SUGAR, 13 KG OF BUTTER AND 14 EGGS IN A LARGE BOWL FOR 15 MINUTES.")]
    benchmark = list(enumerate(items))
    got = found(spark, docs, benchmark)
    sieve = decontam._sieved

    def all_pairs(rows, asked, *options):
        assert sieve(rows, asked, *options).count() < rows.count() * asked.count() / 4
        return rows.select("id").distinct().crossJoin(asked.select(asked.id.alias("item")))

    monkeypatch.setattr(decontam, "_sieved", all_pairs)
    assert set(found(spark, docs, benchmark)) == set(got)
    assert (10_000, 0) in got and len({i for _, i in got}) == len(items)


def test_numbers_that_begin_a_sentence_are_placeholders(spark):
    asked = "We count the boxes in the yard. 14 boxes are red there. 9 of those are full of old paper."
    assert set(found(spark, [(1, asked.replace("14", "31").replace("9", "8"))], [(1, asked)])) == {(1, 1)}


def test_no_join_is_planned_by_the_size_of_stored_files(spark, monkeypatch):
    plans, real = [], decontam.stored
    monkeypatch.setattr(decontam, "stored", lambda df, what: plans.append(df) or real(df, what))
    docs = spark.createDataFrame([(1, f"so {ASKED}"), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ASKED)], "item_id long, text string")
    assert [r.doc_id for r in decontam.keep_uncontaminated(docs, bench).collect()] == [2]
    plans.append(decontam.keep_uncontaminated(docs, bench))
    joins = [line for df in plans for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if " Join " in f" {line.lstrip(' :+-')}"]
    assert len(joins) > 10 and all("strategy=" in line for line in joins)


def test_pairs_are_the_same_without_broadcasts(spark, monkeypatch):
    docs = [(1, f"so {ASKED}"), (2, "nothing of it"), (3, TRAIN.replace("120", "95")), (4, f"{SHOP} {TRAIN}")]
    items = [(1, ASKED), (2, TRAIN), (3, SHOP)]
    broadcast = found(spark, docs, items)
    monkeypatch.setattr(decontam, "MOST_BROADCAST", 0)
    assert found(spark, docs, items) == broadcast and {(1, 1), (4, 2), (4, 3)} <= broadcast.keys()
