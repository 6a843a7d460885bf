"""Problem 9: texts that look alike but are written with other characters.

The consistent form of a text: characters that show nothing are dropped, spaces of any kind become
the ordinary space one for one, full-width and half-width forms become the ordinary ones, letters and
signs drawn like those of another alphabet become one of them, and accents are composed.

Most of a text is already in that form.  From the normalisation quick-check properties a class of
unstable characters is derived: whatever the form would change, and whatever may combine with its
neighbour.  A text without any is returned as it is; in others only the runs of unstable characters,
each with the stable character before it as context, are normalised and spliced into the rest.

Defined results: a null text has a null form.  Case, accents, digits, punctuation, raised and circled
forms stay apart.  Texts whose form has nothing visible are in no pair.  Control characters are kept,
and count as nothing visible.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.process import once
from loomspan.llm import blocks
from loomspan.runtime import cut, spread

# Letters of other alphabets drawn like Latin ones, and signs drawn like others, each
# followed by what it becomes.
LOOKALIKES = """
А A  В B  Е E  Ѕ S  І I  Ј J  К K  М M  Н H  О O  Р P  С C  Т T  У Y  Х X  Ү Y  Ԍ G  Ԛ Q  Ԝ W  Ѵ V  Ӏ I
а a  е e  ѕ s  і i  ј j  о o  р p  с c  у y  х x  ү y  һ h  ԁ d  ԛ q  ԝ w  ѵ v  ӏ l
Α A  Β B  Ε E  Ζ Z  Η H  Ι I  Κ K  Μ M  Ν N  Ο O  Ρ P  Τ T  Υ Y  Χ X  Ϲ C  Ϳ J
α a  ι i  ν v  ο o  ρ p  υ u  ϲ c  ϳ j
Տ S  Լ L  Օ O  Ս U  հ h  ո n  ս u  ց g  օ o  զ q
Ꭺ A  Ᏼ B  Ꮯ C  Ꭼ E  Ꮐ G  Ꮋ H  Ꭻ J  Ꮶ K  Ꮮ L  Ꮇ M  Ꮲ P  Ꭱ R  Ꮪ S  Ꭲ T  Ꮩ V  Ꮃ W  Ꮓ Z
Г Γ  П Π  Ф Φ
ɑ a  ɡ g  µ μ  ∆ Δ  ∑ Σ  ∏ Π  ∕ /  ⁄ /  ∶ :  ‐ -  ‑ -  − -  ∗ *  ․ .  ∣ |  ǀ |  ꞉ :  ։ :  ǃ !  ∖ \\  ⋅ ·  ∼ ~
"""


def _points() -> Iterator[int]:
    """The planes that hold characters, without Hangul syllables, surrogates and private use."""
    yield from range(0xAC00)
    yield from range(0xF900, 0x32400)
    yield from range(0xE0000, 0xE0200)


def fold() -> dict[int, str]:
    """Code point -> what it becomes before accents are composed; '' for what shows nothing."""
    return once("lookalikes.fold", _fold)


def _fold() -> dict[int, str]:
    table: dict[int, str] = {}
    for c in _points():
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Zs":
            table[c] = " "
        elif (kind == "Cf" and not 0x600 <= c <= 0x605 and c not in (0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD)) or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or c in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0):
            table[c] = ""
        elif unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")):
            table[c] = unicodedata.normalize("NFKC", ch)
    del table[0x20]
    pairs = LOOKALIKES.split()
    table.update((ord(a), b) for a, b in zip(pairs[::2], pairs[1::2], strict=True))
    return table


def whole_form(text: str) -> str:
    """The form of a text taken as a whole: decomposed, folded, composed."""
    t = fold()
    once = unicodedata.normalize("NFD", text).translate(t)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", once).translate(t))


def unstable() -> np.ndarray:
    """Per code point, whether it is unstable: what the form of the character alone changes, and what
    can combine with what stands before it - combining marks and second halves of compositions
    (quick check Maybe)."""
    return once("lookalikes.unstable", _unstable)


def _unstable() -> np.ndarray:
    flags = np.zeros(0x110000, dtype=bool)
    flags[list(fold())] = True
    flags[0x1161:0x1176] = flags[0x11A8:0x11C3] = True
    for c in _points():
        ch = chr(c)
        if unicodedata.combining(ch):
            flags[c] = True
        elif (parts := unicodedata.decomposition(ch)) and not parts.startswith("<"):
            flags[[int(x, 16) for x in parts.split()[1:]]] = True
            flags[c] |= whole_form(ch) != ch
    return flags


def _segment(text: str, known: dict[str, str]) -> str:
    """Short segments are remembered, up to a bound."""
    if len(text) > 63:
        return whole_form(text)
    if (done := known.get(text)) is None:
        if len(known) > 50_000:
            known.clear()
        done = known[text] = whole_form(text)
    return done


def form(text: str) -> str:
    """The consistent form: unstable segments normalised and spliced into the unchanged text."""
    if text.isascii():
        return text
    at = np.flatnonzero(unstable()[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)])
    if not len(at):
        return text
    gap = np.flatnonzero(np.diff(at) > 1)
    starts, ends = np.maximum(at[np.r_[0, gap + 1]] - 1, 0), at[np.r_[gap, len(at) - 1]] + 1
    out, last, known = [], 0, once("lookalikes.segments", dict)
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        out += (text[last:s], _segment(text[s:e], known))
        last = e
    return "".join(out) + text[last:]


def is_visible(canonical: str) -> bool:
    return any(not ch.isspace() and unicodedata.category(ch) != "Cc" for ch in canonical)


def canonical_texts(documents: DataFrame) -> DataFrame:
    """doc_id, text in its consistent form."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else form(t) for t in s], dtype=object)

    return spread(documents.select("doc_id", "text")).select("doc_id", F.pandas_udf(run, "string")("text").alias("canonical"))


def hashed(documents: DataFrame) -> DataFrame:
    """doc_id with 128-bit hashes of the form (look) and of the text as written (own); texts with
    nothing visible left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if is_visible(canonical := form(text)):
                    rows.append((doc_id, *(hashlib.blake2b(x.encode(), digest_size=16).digest() for x in (canonical, text))))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["doc_id", "look", "own"])

    return spread(documents.select("doc_id", "text")).where("doc_id is not null and text is not null").mapInArrow(run, "doc_id bigint, look binary, own binary")


def classes(rows: DataFrame) -> DataFrame:
    """Spellings of looks that have more than one: look, own, n_docs, n_spellings."""
    spelled = rows.groupBy("look", "own").agg(F.count_distinct("doc_id").alias("n_docs"))
    several = spelled.groupBy("look").agg(F.count("*").alias("n_spellings")).where("n_spellings > 1")
    return spelled.join(several, "look")


def found(documents: DataFrame) -> DataFrame:
    """p9_found: doc_a, doc_b.  Pairs are made of spellings first, then of their documents, so a look
    with a third of all documents in one spelling is never compared with itself; spellings of a look and
    documents of a spelling meet block by block, so none of them is one task's work."""
    rows = cut(hashed(documents).distinct())
    spelled = cut(classes(rows).select("look", "own"))
    pairs = blocks.within(spelled, "look", "own")
    of = rows.join(spelled, ["look", "own"], "left_semi").select("doc_id", "own")
    return blocks.between(pairs, "x", "y", of, "own", "doc_id").select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b"))


def groups(documents: DataFrame) -> DataFrame:
    """Per document of a look with several spellings: the look's smallest doc_id and its sizes."""
    rows = cut(hashed(documents).distinct())
    several = classes(rows).select("look", "n_spellings").distinct()
    sizes = rows.groupBy("look").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_docs")).join(several, "look")
    return rows.join(sizes, "look").select("doc_id", "first_id", "n_docs", "n_spellings")
