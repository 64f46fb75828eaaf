"""Languages: held-out sentences, mixed texts, labels, edge cases."""

import os
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import language as L

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_labels_name_languages(spark):
    cases = {"en": "en", "EN-us": "en", "eng": "en", "Deutsch": "de", "de_AT": "de", "français": "fr", "日本語": "ja", "русский": "ru", "und": None, "": None, None: None, "xx": None, "n/a": None}
    rows = spark.createDataFrame([(k,) for k in cases], "label string").select("label", L.language_of_label(F.col("label")).alias("code")).collect()
    assert {r.label: r.code for r in rows} == cases


def test_prose_leaves_code_out():
    text = "# Title\n\nSee `fooBar` now.\n```py\nde la casa\n```\nIt calls http://x.y/z and snake_case 42 times.\n~~~\nund der\n"
    words = [w for ws, _ in L.sentences(text) for w in ws]
    assert words == ["title", "see", "now", "it", "calls", "and", "times"]
    assert L.sentences(None) == [] and L.sentences(" \n ") == [] and L.sentences("12 0xff a1b2") == []


def test_spans_are_those_of_viterbi_over_words():
    """A change inside a sentence that replaces the changes to its neighbours; random scores against all words as units."""
    rng = np.random.default_rng(3)
    model = L.Frozen(["de", "en", "it"], {}, {}, {})
    vocabulary = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    score = {w: -np.round(rng.uniform(0, 4, 3), 3) for w in vocabulary}
    score |= {"aa": np.array([0.0, -3.0, -9.0]), "bb": np.array([-3.0, 0.0, -9.0])}
    model.scores = lambda words: np.array([score[w] for w in words])

    def total(path, sentence, words):
        changes = sum(0 if a == b else L.INSIDE if s == t else L.BETWEEN for a, b, s, t in zip(path, path[1:], sentence, sentence[1:]))
        return sum(score[w][i] for w, i in zip(words, path)) - changes

    def best(sentence, words):
        at = score[words[0]].copy()
        for i in range(1, len(words)):
            at = np.maximum(at, at.max() - (L.INSIDE if sentence[i] == sentence[i - 1] else L.BETWEEN)) + score[words[i]]
        return at.max()

    model.label_all = L.Frozen.label_all.__get__(model)
    texts = ["aa aa aa aa aa aa. aa aa aa aa bb bb bb bb. bb bb bb bb bb bb."]
    for _ in range(300):
        texts.append(" ".join(" ".join(rng.choice(vocabulary, rng.integers(2, 9))) + "." for _ in range(rng.integers(1, 6))))
    for text in texts:
        parts = L.sentences(text)
        words = [w for ws, _ in parts for w in ws]
        sentence = [k for k, (ws, _) in enumerate(parts) for _ in ws]
        path = [lang for lang, n, _, _ in model.label(text) for _ in range(n)]
        assert len(path) == len(words) and abs(total(path, sentence, words) - best(sentence, words)) < 1e-6
    assert [(lang, n) for lang, n, _, _ in model.label(texts[0])] == [(0, 6), (0, 4), (1, 4), (1, 6)]


def test_places_and_decomposed_letters():
    text = "# Titel\r\n\r\nDas ist de\u0301ja\u0300 vu. `code` Und <b> so weiter.\n```\nx y\n```\n日本語です。次の文。 Ende"
    words = [w for ws, _ in L.sentences(text) for w in ws]
    places = L.word_places(text)
    assert len(words) == len(places) and [unicodedata.normalize("NFC", text[a:b]).lower() for a, b in places] == words


def test_scripts_come_from_the_samples_and_long_words_are_read_whole():
    kinds = L.scripts_of([("uk", "їжак"), ("ru", "ёжик"), ("sr", "jež јеж")])
    assert kinds == {"uk": {"cyrillic"}, "ru": {"cyrillic"}, "sr": {"latin", "cyrillic"}}
    model = L.Model(["ru", "uk"])
    model.add("uk", L.Counter(["їжак", "ґава"]))
    model.add("ru", L.Counter(["ёжик", "ыть"]))
    frozen = model.freeze({"ru": {"cyrillic"}, "uk": {"cyrillic"}})
    assert frozen.score("їжачок").argmax() == 1 and frozen.score("бытьё").argmax() == 0
    assert np.array_equal(frozen.score("word"), [0, 0])
    assert frozen.score("бюб" * 20 + "ыть" * 20).argmax() == 0 and frozen.score("бюб" * 20 + "ґава" * 20).argmax() == 1  # the ends decide


@needs_data
def test_confidence_is_calibrated(spark):
    samples = spark.read.parquet(f"{DATA}/lang_samples.parquet")
    model = L.fit(samples.where("sample_id % 2 = 0"), text="text", rows=0)
    groups = {}
    for r in samples.where("sample_id % 2 = 1").collect():
        words = [w for ws, _ in L.sentences(r.text) for w in ws]
        for i in range(len(words) - 1):
            total = model.scores(words[i : i + 2]).sum(axis=0)
            a, b = np.sort(total)[-2:]
            p = model.confidence(b - a)
            groups.setdefault(min(9, int(p * 10)), []).append((p, model.langs[int(total.argmax())] == r.lang))
    for g in groups.values():
        if len(g) >= 100:
            assert abs(np.mean([p for p, _ in g]) - np.mean([y for _, y in g])) < 0.12
    assert len(groups) >= 3


@needs_data
def test_held_out_samples_and_mixtures(spark):
    samples = spark.read.parquet(f"{DATA}/lang_samples.parquet")
    model = L.fit(samples.where("sample_id % 2 = 0"), text="text", rows=0)
    rest = samples.where("sample_id % 2 = 1").select(F.col("sample_id").alias("doc_id"), "text", "lang")
    found = {r.doc_id: r.lang for r in L.label_documents(rest, model).collect()}
    truth = {r.doc_id: r.lang for r in rest.collect()}
    assert sum(found[i] == truth[i] for i in truth) / len(truth) >= 0.97
    one = {r.lang: r.text for r in rest.collect()}
    mixed = spark.createDataFrame([(1, one["de"] + " " + one["it"], "de"), (2, one["fr"], "fr-CA"), (3, one["ru"], None), (4, "```\nx\n```", "en"), (5, None, None), (6, "", "en"), (7, one["ja"], "Japanese")], "doc_id bigint, text string, lang string")
    got = sorted(tuple(r) for r in L.mislabelled(mixed.unionByName(mixed.limit(2)), model).collect())
    assert got == [(1, "de"), (1, "it"), (3, "ru")]
    assert [r.lang for r in L.segments(mixed.where("doc_id = 1"), model).orderBy("segment_no").collect()] == ["de", "it"]
    labels = {r.doc_id: (r.lang, r.confidence) for r in L.label_documents(mixed, model).collect()}
    assert labels[5] == (None, 0.0) and labels[4] == (None, 0.0) and labels[2][0] == "fr" and labels[2][1] > 0.9
    assert L.mislabelled(mixed.limit(0), model).count() == 0
