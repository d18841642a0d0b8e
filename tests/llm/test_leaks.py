"""Benchmark decontamination: what must not be reported, short items, and recall on re-parameterised questions."""

import random

from pyspark.sql import functions as F

from replistat.llm import decontam

PROBLEMS = [
    "A farmer called {n0} sells {a} apples to {n1} and keeps {b} kg of pears for the winter. How many more apples does {n0} have to sell?",
    "On a trip of {a} miles the driver {n0} stops after {b} minutes for coffee. What was the mean speed of the car until then?",
    "The shop owned by {n0} and {n1} gives {a} percent off every coat. If a coat cost {b} dollars before, what must a buyer pay now?",
    "While {n0} fills a tank of {a} liters at a steady rate, a leak takes away {b} liters each hour. When is the tank full at last?",
    "In the town library {n0} counted {a} books on the lower shelf and {b} on the upper one. How many did both shelves hold together?",
    "Every morning before school {n0} runs {a} km and then walks {b} km with {n1}. How far do they go in one week without Sunday?",
    "The sum of two whole numbers is {a} and their difference is {b}, said {n0} to the class. Which is the larger number of the two?",
    "At the station {n0} waits {a} minutes for a train that comes {b} minutes late. How long would the wait have been on a better day?",
]
NAMES = ["Maria", "Ahmed", "Joan", "Piotr", "Chen", "Olga", "Kofi", "Rosa", "Lars", "Mina"]
FILLER = "plain words about weather and gardens that nobody would ever ask in a test because they say very little of note".split()


def ask(i, rnd):
    n = rnd.sample(NAMES, 2)
    return PROBLEMS[i].format(n0=n[0], n1=n[1], a=rnd.randrange(2, 400), b=rnd.randrange(2, 90))


def around(text, rnd):
    side = lambda: " ".join(rnd.choice(FILLER) for _ in range(rnd.randrange(0, 60)))
    return f"{side()} {text} {side()}"


def find(spark, docs, items, key=None):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return d, b, decontam.find_leaks(d, b, F.col("doc_id") if key is None else key)


def test_recall_and_precision_on_changed_parameters(spark):
    rnd = random.Random(4)
    items = [(i, ask(i, rnd)) for i in range(len(PROBLEMS))]
    docs = [(100 * i + k, around(ask(i, rnd), rnd)) for i in range(len(PROBLEMS)) for k in range(12)]
    clean = [(10_000 + k, around("", rnd) + " " + " ".join(str(rnd.randrange(500)) for _ in range(rnd.randrange(40)))) for k in range(40)]
    clean += [(20_000 + k, f"Then {rnd.choice(NAMES)} gave {rnd.randrange(99)} apples and {rnd.randrange(99)} pears to {rnd.choice(NAMES)} in the town, and {around('', rnd)}") for k in range(40)]
    got = {(r["id"], r["item_id"]) for r in find(spark, docs + clean, items)[2].collect()}
    want = {(d, d // 100) for d, _ in docs}
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_tables_of_other_numbers_are_no_leak(spark):
    item = [(1, " ".join(str(n) for n in range(100, 116)))]
    docs = [(1, "values: " + " ".join(str(n) for n in range(700, 716))), (2, "see " + item[0][1] + " there"), (3, "Anna 3 kg Bert 4 kg Carl 5 kg Dora 6 kg")]
    assert {r["id"] for r in find(spark, docs, item)[2].collect()} == {2}


def test_null_ids_are_documents_of_their_own(spark):
    words = [f"w{i}" for i in range(40)]
    item = [(1, " ".join(words))]
    docs = [(None, " ".join(words[i:i + 8])) for i in range(0, 30, 2)] + [(None, "before " + " ".join(words) + " after"), (None, None)]
    d, b, _ = find(spark, docs, item)
    left = decontam.drop_leaks(d, b).collect()
    assert len(left) == len(docs) - 1 and not any(r["text"] and "before" in r["text"] for r in left)


def test_short_items_match_whole_documents_only(spark):
    items = [(1, "forty two"), (2, "Yes."), (3, "42"), (4, "")]
    docs = [(1, "Forty, two!"), (2, "they counted forty two sheep"), (3, "yes"), (4, "yes and no"), (5, "42"), (6, "43"), (7, ""), (8, None)]
    assert {(r["id"], r["item_id"]) for r in find(spark, docs, items)[2].collect()} == {(1, 1), (3, 2), (5, 3)}
