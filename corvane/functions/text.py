"""Normalized text and index words, in generated code wherever Spark has the operation.

Spark has no Unicode normal forms. Composing (NFC) and the few letters whose accent-free form has several characters run
in Arrow batches: a plain regular expression tells which texts need it, and the others go there as nulls, so no text is
sent that needs neither and the rows are read once.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that are not indexed.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that",
    "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
# The ranges of combining marks that index words lose.
MARK_RANGES = (
    (0x0300, 0x036F), (0x0483, 0x0489), (0x0591, 0x05BD), (0x05BF, 0x05BF), (0x05C1, 0x05C2), (0x05C4, 0x05C5), (0x05C7, 0x05C7), (0x0610, 0x061A),
    (0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06DC), (0x06DF, 0x06E4), (0x06E7, 0x06E8), (0x06EA, 0x06ED), (0x0711, 0x0711), (0x0730, 0x074A),
    (0x07A6, 0x07B0), (0x0816, 0x0819), (0x081B, 0x0823), (0x0825, 0x0827), (0x0829, 0x082D), (0xFE20, 0xFE2F),
)
SPACE = r"\p{IsWhite_Space}"
NOT_WORD = r"[^\p{IsAlphabetic}\p{N}]+"

def _is_mark(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in MARK_RANGES)


def plain(text: str) -> str:
    """Decomposed, without the listed marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not _is_mark(c))


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str, str]:
    """Letters with a one-character plain form, these forms, and a pattern of ranges around the other letters that change."""
    one, other = [], []
    for n in (*range(0xA0, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)):
        c = chr(n)
        p = plain(c)
        if p != c and not _is_mark(c):
            (one if len(p) == 1 else other).append(c)
    ranges: list[list[int]] = []
    for n in sorted(map(ord, other)):
        if ranges and n - ranges[-1][1] < 512:  # few and wide, as every letter of every text is held against them
            ranges[-1][1] = n
        else:
            ranges.append([n, n])
    pattern = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"
    return "".join(one), "".join(map(plain, one)), pattern


def several_letters() -> str:
    """A pattern of letters whose plain form has several characters (Hangul syllables and the like), and of some near them."""
    return _accents()[2]


_MARKS = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in MARK_RANGES) + "]+"


def plain_letters(text: Column) -> Column:
    """Without accents; exact for texts without `several_letters`."""
    one, forms, _ = _accents()
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(text, one, forms), _MARKS, "")).otherwise(text)


def _lowered(text: Column) -> Column:
    """Runs of letters and digits in lower case with one blank between them. One pass each over the whole text: its words
    are separate before accents go, so nothing has to run word by word."""
    return F.lower(F.regexp_replace(text, NOT_WORD, " "))


def _kept(words: Column) -> Column:
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def tokenize(text: Column) -> Column:
    """array<string>: the index words of a text in order, repeated ones too: runs of letters and digits, lower case, without
    accents and stop words. All in the JVM; exact for texts without `several_letters`."""
    return _kept(F.split(plain_letters(_lowered(text)), " "))


def with_words(df: DataFrame, text: Column, out: str = "words") -> DataFrame:
    """`df` with the index words of `text`, exact for every text. One pass: to Python go the texts with `several_letters`, the
    others as nulls."""
    lowered = F.col("_lowered_text")
    rare = F.coalesce(lowered.rlike(several_letters()), F.lit(False))

    @F.arrow_udf("string")
    def plain_text(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None else plain(t) for t in texts.to_pylist()], pa.string())

    plain_form = F.when(rare, plain_text(F.when(rare, lowered))).otherwise(plain_letters(lowered))
    return df.withColumn("_lowered_text", _lowered(text)).withColumn(out, _kept(F.split(plain_form, " "))).drop("_lowered_text")


def tokenize_text(text: str) -> list[str]:
    """The same for one text on the driver, as for a search string."""
    out, word = [], []
    for c in [*text, " "]:
        if c.isalnum() or (c.isalpha() or unicodedata.category(c) in ("Nl", "No")):
            word.append(c)
        elif word:
            w = plain("".join(word).lower())
            if w and w not in STOP_WORDS:
                out.append(w)
            word = []
    return out


def _collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def normalize_text(text: Column) -> Column:
    """Without byte order marks, composed, runs of white space as one blank, none at the ends; null stays null. Every text
    goes through Python; `normalized` spares those that need not."""

    @F.arrow_udf("string")
    def composed(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    return _collapsed(composed(F.translate(text, "\ufeff", "")))


#: Marks and letters that composing can change or join to what stands before them.
_COMPOSES = (
    r"[\p{M}\x{0374}\x{037E}\x{0387}\x{1100}-\x{11FF}\x{1F71}-\x{1FFD}\x{2000}-\x{2001}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{2ADC}"
    r"\x{0958}-\x{095F}\x{09DC}-\x{09DF}\x{0A33}-\x{0A5E}\x{0B5C}-\x{0B5D}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4F}\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1D}]"
)


def may_compose(text: Column) -> Column:
    """Whether composing could change the text; false for null."""
    return F.coalesce(text.rlike(_COMPOSES), F.lit(False))


def normalize_composed(text: Column) -> Column:
    """`normalize_text` of texts that `may_compose` is false for, in the JVM."""
    return _collapsed(F.translate(text, "\ufeff", ""))


def normalize_sparing(text: Column) -> Column:
    """`normalize_text`, to which texts that composing cannot change go as nulls."""
    needs = may_compose(text)
    return F.when(needs, normalize_text(F.when(needs, text))).otherwise(normalize_composed(text))


def normalized(df: DataFrame, *cols: str) -> DataFrame:
    """`df` with these columns normalized, in one pass: only texts that composing can change go to Python."""
    return df.withColumns({c: normalize_sparing(F.col(c)) for c in cols})


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def first_bytes(text: Column, n: int) -> Column:
    """At most `n` bytes of UTF-8, cut before a character that would not fit whole."""
    raw = text.cast("binary")
    lead = lambda k: F.hex(F.substring(raw, n + 1 - k, 1)).between("80", "BF")  # noqa: E731  byte after the cut continues a character
    end = F.when(~lead(0), n).when(~lead(1), n - 1).when(~lead(2), n - 2).otherwise(n - 3)
    cut = F.decode(raw.substr(F.lit(1), end), "UTF-8")
    return F.when(F.octet_length(text) <= n, text).otherwise(cut)
