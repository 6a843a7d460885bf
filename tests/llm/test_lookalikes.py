from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import lookalikes as la

CHARS = [*"aeiou AZ09.-_\n\t", *map(chr, (0x301, 0x308, 0x327, 0x200B, 0x435, 0x451, 0xE9, 0x1100, 0x1161, 0x11A8, 0xAC00, 0xFF21, 0xFF76, 0xFF9E, 0x212B, 0x3B1, 0x323, 0x1E69, 0x34F, 0xB5, 0x344, 0x958, 0x93C, 0x915, 0x2460, 0xB2, 0x3000, 0xA0, 0xFE0F))]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(CHARS), max_size=12) | st.text(max_size=12))
def test_spliced_form_is_the_whole_form(text):
    got = la.form(text)
    assert got == la.whole_form(text)
    assert la.form(got) == got


def test_same_looks():
    for a, b in (("ＡＢ＿１", "AB_1"), ("café", "café"), ("ѕсоре", "scope"), ("би́", "би́"), ("a​b­", "ab"), ("a b　c", "a b c"), ("K", "K"), ("ё", "ë"), ("biе́n", "bién"), ("µ", "μ"), ("ГПФ", "ΓΠΦ"), ("a∖b∣", "a\\b|")):
        assert la.form(a) == la.form(b), (a, b)


def test_other_looks():
    for a, b in (("a", "A"), ("é", "e"), ("1", "²"), ("1", "①"), ("a b", "a  b"), ("a\tb", "a b"), ("a,b", "a.b"), ("0", "O"), ("l", "1"), ("ß", "ss"), ("и", "й")):
        assert la.form(a) != la.form(b), (a, b)


def test_pairs(spark, clash):
    rows = [(1, "scope"), (2, "ѕcope"), (3, "scope"), (3, "scope"), (4, "ｓcope"), (5, ""), (6, None), (7, " ​"), (8, " "), (9, "Scope"), (None, "scopе")]
    df = clash(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, la.found(df).collect())) == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert la.found(df.limit(0)).count() == 0
    assert {tuple(r) for r in la.groups(df).collect()} == {(i, 1, 4, 3) for i in (1, 2, 3, 4)}
    assert {r["doc_id"]: r["canonical"] for r in la.canonical_texts(df).collect()}[6] is None


def test_hot_looks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(la.blocks, "BLOCK", 3)
    spellings = ["scope", "ѕcope", "ｓcope", "ѕсope", "ѕсоpe"]
    rows = [(i, spellings[i % 7] if i % 7 < 5 else f"other {i}") for i in range(60)]
    want = {(a, b) for a, s in rows for b, t in rows if a < b and s != t and s in spellings and t in spellings}
    got = list(map(tuple, la.found(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    assert len(got) == len(want) and set(got) == want


def test_long_text():
    text = "е́ x" * 200_000
    assert la.form(text) == "é x" * 200_000
