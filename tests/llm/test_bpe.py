"""Tokenizer automaton: against the public library, by round trip, and edge cases."""

import random

import pytest

from lodestrata.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def automaton():
    return bpe.Automaton(bpe.read_ranks(bpe.vocabulary_path()))


def reference(automaton):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=automaton.ids, special_tokens={})


def test_equals_the_library(automaton):
    enc, rng = reference(automaton), random.Random(3)
    texts = ["", " ", "\n\n  x", "<|endoftext|>", "it's We'LL don't", "naïve café 日本語 😀 é", "a" * 300, "\t\tif (x) {\r\n}", "0x3f 1234567", "ﬀ ½ ²"]
    texts += ["".join(rng.choice("abehlost 'T<|>éß日😀\n\r0_") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    kept = {}
    for text in texts:
        ids = bpe.encode_text(text, automaton, kept)
        assert ids == enc.encode_ordinary(text)
        assert automaton.decode(ids).decode("utf-8") == text


def test_null_empty_and_clashing_columns(spark):
    rows = [(1, None, 7, "x"), (2, "", 8, "y"), (3, "hello hello", 9, "z"), (3, "hello hello", 9, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int, value string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode(df, bpe.vocabulary_path()).collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and len(got[2][1]) == 2
    back = bpe.decode(bpe.encode(df, bpe.vocabulary_path()), bpe.vocabulary_path()).collect()
    assert sorted(r.text for r in back) == ["", "", "hello hello", "hello hello"]
    assert bpe.encode(df.limit(0), bpe.vocabulary_path()).count() == 0


@pytest.mark.parametrize("kind", ["int", "smallint", "string", "decimal(12,2)", "date", "bigint"])
def test_ids_of_any_type(spark, kind):
    df = spark.range(3).selectExpr(f"cast({'date_from_unix_date(cast(id as int))' if kind == 'date' else 'id'} as {kind}) as doc_id", "'hello' as text")
    got = bpe.encode(df, bpe.vocabulary_path())
    assert got.dtypes[0] == ("doc_id", kind) and sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(map(str, (r.doc_id for r in df.collect())))


def test_tables_are_bounded(automaton, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_ARCS", 50)
    automaton.table.clear()
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice("abcdefghijklmnop") for _ in range(30))
        assert automaton.decode(automaton.encode_word(text.encode())).decode() == text
        assert len(automaton.table) <= 50
