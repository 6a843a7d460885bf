import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import lexicon, tokens

PATH = os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY)
RANKS = tokens.read_ranks(PATH)
HARD = ["", " ", "\n\n  a", "<|endoftext|> hi", "I'LL don't 're", "a" * 5000, "½ ² Ⅷ ٣", "  tab\t\t x  ", "a\x1cb \x1f", "é́ñ 你好，世界。", "🚧️ ok", "​⁠x", "\r\n\r\n x", "x\x85 y z"]


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def ours(texts, words=()):
    e = tokens.Encoder(RANKS, lexicon.Lexicon(lexicon.build((w.encode(), tokens.merge(w.encode(), RANKS)) for w in set(words))))
    ids, ends = e.encode(texts)
    assert e.sizes(texts).sum() == len(ids)
    return [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def test_hard_texts():
    want = reference()(HARD)
    assert ours(HARD) == want
    assert ours(HARD, ["a" * 48, " x", "I", "你好"]) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_any_text(texts):
    assert ours(texts, [" the", "a", "ab"]) == reference()(texts)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 50_000), min_size=1, max_size=3), max_size=40), st.lists(st.binary(max_size=7), max_size=10))
def test_transducer_round_trip(entries, others):
    x = lexicon.Lexicon(lexicon.build(entries.items()))
    words = [*entries, *others]
    for w, n in zip(words, x.numbers(words).tolist() if words else [], strict=True):
        if w in entries:
            assert x.ids[x.offsets[n] : x.offsets[n + 1]].tolist() == entries[w]
        else:
            assert n == -1


def test_suffixes_are_shared():
    x = lexicon.Lexicon(lexicon.build((a + b"ing", [1]) for a in (b"a", b"b", b"c", b"d")))
    assert x.n_states == 5


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(docs).collect()}
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert got == dict(zip((d for d, _ in texts), reference()([t for _, t in texts]), strict=True))


def test_nulls_empty_table_and_clashing_columns(spark, clash):
    d = clash(spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b")], "doc_id bigint, text string"))
    got = tokens.encode(d).collect()
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in got) == [(0, [64, 275]), (1, []), (2, []), (2, [])]
    assert tokens.encode(d.limit(0)).count() == 0
    assert sum(r["n_tokens"] for r in tokens.token_counts(d).collect()) == 2
    assert sorted(r["text"] for r in tokens.decode(tokens.encode(d)).collect()) == ["", "", "", "a b"]


def test_lexicon_of_a_folder_that_is_not_mounted():
    file = lexicon.build([(b"ab", [1, 2])])
    e = tokens._encoder("/nowhere/lexicon-x.bin", file, RANKS)
    assert e.words.numbers([b"ab", b"b"]).tolist() == [0, -1]


@pytest.mark.parametrize("chunk", [1, 10_000])
def test_chunks_do_not_matter(monkeypatch, chunk):
    monkeypatch.setattr(tokens, "CHUNK_CHARS", chunk)
    e = tokens.Encoder(RANKS, lexicon.Lexicon(lexicon.build([])))
    assert [t for group in e.chunks(HARD) for t in group] == HARD
