"""Leaked test items: against all windows of words, and removal."""

import random

from lodestrata.llm import leakage


def brute(docs, items, k):
    grams = lambda t: {tuple(w[i : i + k]) for w in [leakage.words(t)] for i in range(len(w) - k + 1)}
    return {(d, i) for d, t in docs for i, s in items if grams(t) & grams(s)}


def test_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["Ünï", "x1"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(1, 30))) for i in range(25)] + [(98, None), (99, "")]
    docs = [(100 + i, say(rng.randint(0, 25)) + rng.choice([" ", ", ", "\n-- "]) + " ".join(leakage.words(items[i % 25][1])[: rng.randint(0, 20)]).upper() + " " + say(5)) for i in range(120)] + [(1, None), (2, "")]
    d = spark.createDataFrame(docs + docs[:3], "doc_id bigint, text string")
    i = spark.createDataFrame(items + items[:2], "item_id bigint, text string")
    for k in (3, 5, 12):
        got = {tuple(r) for r in leakage.leaks(d, i, min_words=k).collect()}
        assert got == brute([x for x in docs if x[1]], [x for x in items if x[1]], k)
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_blocks_of_items_change_nothing(spark):
    """Many blocks, also with a bit table that is full, so that all documents pass it, and one item in most documents."""
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(20))) for i in range(30)]
    docs = [(i, "x y " + items[0][1] + " z " + (items[i % 30][1] if i % 3 else "")) for i in range(90)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items, 6)
    for block_words, bits in ((100, 1 << 28), (100, 1 << 16), (10_000, 1 << 16)):
        assert {tuple(r) for r in leakage.leaks(d, i, min_words=6, block_words=block_words, most_bits=bits).collect()} == want
    whole = sorted(tuple(r) for r in leakage.leaked_spans(d, i, min_words=6).collect())
    assert whole == sorted(tuple(r) for r in leakage.leaked_spans(d, i, min_words=6, block_words=60).collect())


def test_the_bit_table_has_every_window():
    import numpy as np

    text = " ".join(f"w{i}" for i in range(100))
    h = leakage.window_hashes([text], 12)[0]
    assert len(h) == 89 and len(np.unique(h)) == 89 and np.array_equal(h[5:], leakage.window_hashes([" ".join(f"W{i}," for i in range(5, 100))], 12)[0])
    assert len(leakage.window_hashes(["a b", None, "", "c"], 3)[0]) == 0
    many, of = leakage.window_hashes(["a b c", None, text, "x"], 3)
    assert of.tolist() == [0] + [2] * 98 and many[0] == leakage.window_hashes(["A, B; c"], 3)[0][0]
    for s in ("Ünï x1 2½ ²", "a_b-c 9"):
        assert leakage.words(s) == leakage._word.findall(s.lower())


def test_removal_keeps_the_rest(spark):
    items = spark.createDataFrame([(1, "one two three four")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "Keep this. One, two -- THREE four! And that, please, too."), (2, "one two three four"), (3, "clean"), (4, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in leakage.remove_leaks(docs, items, min_words=4, max_coverage=0.5).collect()}
    assert "three" not in got[1].text.lower() and got[1].text.startswith("Keep this.") and got[1].text.endswith("too.")
    assert got[2].text is None and got[3].text == "clean" and got[4].text is None and got[3].coverage == 0
