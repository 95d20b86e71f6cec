"""One consistent form of text, so that texts that look the same also compare and hash the same.

A mapping from code point sequences to their plain form is built by rule once per process, checked for conflicts and
compiled into a longest-match transducer (`Transducer`), which runs over the grapheme clusters of a text in one pass:

* full-width, half-width, font and joined forms go to the ordinary characters (by their compatibility decomposition);
* base letters with combining accents go to the composed letter, whatever look-alike or width the base had;
* look-alike letters of other scripts go to the Latin letter (`LOOK_ALIKES`);
* Hangul letters that join go to their syllable, and one that stands alone to the letter on its own;
* characters that show nothing vanish, also between a letter and its accent. A joiner stays where it shows: between pictographs,
  after a virama, between letters of scripts that join; so does a variation selector that changes how a pictograph is drawn, and
  the tags of a flag;
* every run of blanks becomes one blank, and none stays at the ends.

Not mapped, as a reader sees them: letter case, accents, digits for letters, raised and lowered figures, fractions,
circled and squared signs.

Defined results: null and empty texts have the empty form; texts of blanks or invisible characters too. Texts of any length
are taken whole. The form of a form is itself. Copies and ties need no choice; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

# Letters of other scripts that look like a Latin letter in common fonts.
LOOK_ALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y",
    "ο": "o", "ν": "v", "ϳ": "j", "ι": "i", "α": "a", "ρ": "p", "υ": "u", "ϲ": "c",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ա": "w", "ս": "u", "օ": "o", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "ք": "p", "յ": "j", "Օ": "O", "Տ": "S", "Լ": "L",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L",
    "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P",
    "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "ɑ": "a", "ɡ": "g", "ı": "i",
}
_WIDTHS = {"<wide>", "<narrow>", "<font>", "<compat>"}
_BLANK = "\t\n\x0b\x0c\r\x1c-\x1f \x85\\p{Z}"
#: Format characters and others without a glyph, except the few of category Cf that are drawn.
_NOTHING = "[[\\p{Cf}\\p{Variation_Selector}͏ᅟᅠ឴឵᠋-᠏ㅤﾠ]--[؀-؅۝܏࢐࢑࣢\U000110bd\U000110cd]]"
_JOINING = "[\\p{Arabic}\\p{Syriac}\\p{Mandaic}\\p{Nko}\\p{Mongolian}\\p{Phags_Pa}\\p{Adlam}]"
#: Where such a character shows after all.
_SHOWS = (
    "(?<=\\p{Extended_Pictographic}\\p{Emoji_Modifier}?\ufe0f?)\u200d(?=\\p{Extended_Pictographic})|(?<=\\p{Canonical_Combining_Class=9})[\u200c\u200d]"
    f"|(?<=[{_JOINING}&&\\p{{L}}]\\p{{M}}*)[\u200c\u200d](?=[{_JOINING}&&\\p{{L}}])|(?<=[\\p{{Extended_Pictographic}}--\\p{{Emoji_Presentation}}])\ufe0f|(?<=\\p{{Emoji_Presentation}})\ufe0e"
    "|(?<=[0-9#*])\ufe0f(?=\u20e3)|(?<=\U0001f3f4[\U000e0020-\U000e007f]*)[\U000e0020-\U000e007f]|(?<=\\p{Mongolian})[\u180b-\u180d\u180f]"
)
#: Hangul letters that stand for themselves; their decompositions join with neighbours.
_LETTERS = range(0x3131, 0x318F)
#: Where characters with another form lie.
_MAPPED = ((0xA0, 0xD800), (0xF900, 0x20000), (0x2F800, 0x2FA1E))


def plain_form(c: str) -> str:
    """What one code point looks like: its compatibility decomposition where that is only a matter of width, font or joining."""
    for _ in range(4):
        if ord(c) in _LETTERS:
            break
        tag, _, codes = unicodedata.decomposition(c).partition(" ")
        if tag in _WIDTHS and codes:
            out = "".join(chr(int(x, 16)) for x in codes.split())
            if tag == "<compat>" and not all(unicodedata.category(x)[0] == "L" for x in out):
                return c
            if len(out) > 1:
                return "".join(map(plain_form, out))
            c = out
        else:
            break
    return LOOK_ALIKES.get(c, c)


def mapping() -> dict[str, str]:
    """Every sequence that isn't its own plain form. Raises ValueError on a conflict."""
    forms = {c: f for c in map(chr, [n for a, b in _MAPPED for n in range(a, b)]) if (f := plain_form(c)) != c}
    like: dict[str, list[str]] = {}
    for c, f in forms.items():
        like.setdefault(f, []).append(c)
    out = dict(forms)
    for c in map(chr, [n for a, b in _MAPPED for n in range(a, b) if not 0xAC00 <= n < 0xD800]):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) < 2:
            if parts != c:
                out[c] = plain_form(parts)
            continue
        base = plain_form(parts[0])
        if len(base) != 1:
            continue
        composed = unicodedata.normalize("NFC", base + parts[1:])
        if composed != c:
            out[c] = composed
        marks = [[m, *(x for x in like.get(m, []) if len(x) == 1)] for m in parts[1:]]
        tails = [""]
        for m in marks:
            tails = [t + x for t in tails for x in m]
        for b in {parts[0], base, *like.get(base, []), *like.get(parts[0], [])}:
            for t in tails:
                out[b + t] = composed
    check(out)
    return out


def check(m: dict[str, str]) -> None:
    """A mapping must have final forms (no form is mapped again) and may never turn what a reader can tell apart into one."""
    for source, form in m.items():
        if m.get(form, form) != form or any(m.get(c, c) != c for c in form):
            raise ValueError(f"the form {form!r} of {source!r} has another form")
        a, b = ("".join(x for x in unicodedata.normalize("NFKC", s) if not unicodedata.combining(x)) for s in (source, form))
        if sum(x.isnumeric() for x in a) != sum(x.isnumeric() for x in b) and not any(unicodedata.category(x) == "Nl" for x in source):
            raise ValueError(f"{source!r} and {form!r} differ in a digit")
        if len(a) == len(b) == 1 and a.isupper() != b.isupper() and a.islower() != b.islower() and a not in "ӀꓲᎪ":
            raise ValueError(f"{source!r} and {form!r} differ in letter case")


class Transducer:
    """Longest match over the code points of a grapheme cluster; code points that show nothing are left out before."""

    def __init__(self, m: dict[str, str]):
        self.root: dict = {}
        for source, form in m.items():
            node = self.root
            for c in source:
                node = node.setdefault(c, {})
            node[""] = form
        self.nothing = regex.compile(rf"(?V1)(?!{_SHOWS}){_NOTHING}")
        self.invisible = regex.compile(rf"(?V1){_NOTHING}")
        self.clusters = regex.compile(r"(?V1)\X")
        self.blanks = regex.compile(rf"(?V1)[\s{_BLANK}]+")
        #: Hangul letters alone, by the joining letters that look like them.
        self.letters = {chr(int(d.split()[1], 16)): chr(n) for n in reversed(_LETTERS) if len((d := unicodedata.decomposition(chr(n))).split()) == 2}
        self.known: dict[str, str] = {}

    def cluster(self, shown: str) -> str:
        if len(shown) == 1 and shown in self.letters:
            return self.letters[shown]
        if len(shown) > 2:  # accents in the canonical order
            shown = shown[0] + unicodedata.normalize("NFD", shown[1:])
        out, i = [], 0
        while i < len(shown):
            node, form, j, end = self.root, shown[i], i, i + 1
            while j < len(shown) and (node := node.get(shown[j])) is not None:
                j += 1
                if "" in node:
                    form, end = node[""], j
            out.append(form)
            i = end
        form = "".join(out)
        return form if len(form) < 2 else unicodedata.normalize("NFC", form)

    def __call__(self, text: str | None) -> str:
        if not text:
            return ""
        if "  " not in text and (text.isprintable() if text.isascii() else not irregular().search(text)):
            return text.strip(" ")
        if self.invisible.search(text):
            text = self.nothing.sub("", text)
        text = self.blanks.sub(" ", text).strip(" ")
        known, out = self.known, []
        for c in self.clusters.findall(text):
            form = known.get(c)
            if form is None:
                form = self.cluster(c)
                if len(c) < 8 and len(known) < 100_000:
                    known[c] = form
            out.append(form)
        return "".join(out)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer(mapping())


def _ranges(found: set[str], near: int = 0x1000) -> str:
    """The characters as ranges of a class. Beyond U+FFFF ones no further apart than `near` are joined, as few ranges of these are
    tested fast."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, found)):
        if ranges and c - ranges[-1][1] <= (1 if c < 0x10000 or ranges[-1][1] < 0x10000 else near):
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@lru_cache(maxsize=1)
def _altered() -> set[str]:
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    return {c for k in mapping() for c in (k[1:] or k) if not c.isascii()} | {*regex.findall(rf"(?V1){_NOTHING}", every)} | {*map(chr, range(0x1100, 0x1200))}


@lru_cache(maxsize=1)
def altered() -> re.Pattern:
    """Finds the characters whose presence can make a text differ from its form in more than blanks: those mapped alone or after
    a base, Hangul letters that join, and those that show nothing."""
    return re.compile(f"[{_ranges(_altered())}]")


@lru_cache(maxsize=1)
def irregular() -> re.Pattern:
    """The same and further marks and all blanks but the ordinary one: a text without them, and without two blanks in a row,
    differs from its form in outer blanks at most."""
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    return re.compile(f"[\\x00-\\x1f{_ranges(_altered() | {*regex.findall(rf'(?V1)[{{_BLANK}}\\p{{{{M}}}}\\u1160-\\u11ff\\ua960-\\ua97f\\ud7b0-\\ud7ff]'.format(_BLANK=_BLANK), every)})}]")


def consistent_form(text: Column) -> Column:
    @F.arrow_udf("string")
    def form(texts: pa.Array) -> pa.Array:
        t = transducer()
        return pa.array([t(x) for x in texts.to_pylist()], pa.string())

    return form(text)


def metadata_hash(*texts: Column) -> Column:
    """binary(32): SHA-256 over the texts, each preceded by its length in bytes as eight bytes, high byte first."""
    parts = [p for t in texts for p in (F.unhex(F.lpad(F.hex(F.octet_length(t)), 16, "0")), t.cast("binary"))]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def consistent_records(df: DataFrame, key: str, *texts: str) -> DataFrame:
    """(key, the texts in their consistent form, metadata_hash over these)."""
    formed = df.select(key, *[consistent_form(F.col(t)).alias(t) for t in texts])
    return formed.withColumn("metadata_hash", metadata_hash(*[F.col(t) for t in texts]))


def _alike(df: DataFrame, key: str, *texts: str) -> DataFrame:
    """(form, raw, id), written, of records whose texts have the same forms as other records' but are not equal to them as they
    stand; forms and texts as digests of 128 bits. The transducer runs once over each record; what it gives is written
    too, as it is read for the choice of forms and for their records."""
    digest = lambda cols: F.substring(F.unhex(F.sha2(F.concat_ws("\x00", *cols), 256)), 1, 16)
    raw = [F.coalesce(F.col(t), F.lit("")) for t in texts]
    rows = materialize(df.select(digest([consistent_form(F.col(t)) for t in texts]).alias("form"), digest(raw).alias("raw"), F.col(key).alias("id")))
    several = rows.groupBy("form").agg(F.min("raw").alias("first"), F.max("raw").alias("last")).where("first <> last").select("form")
    out = materialize(rows.join(several, "form", "left_semi"))
    discard(rows)
    return out


def look_alikes(df: DataFrame, key: str, *texts: str) -> DataFrame:
    """(id_a, id_b): pairs of records whose texts have equal forms but are not equal as they stand, smaller id first.

    Records with equal texts make one class. Only classes are paired, by the digest of their forms; members join them
    afterwards, so a text that a third of all records share costs no comparison with itself."""
    members = _alike(df, key, *texts)
    classes = members.select("form", "raw").distinct()
    pairs = classes.withColumnRenamed("raw", "raw_a").join(classes.withColumnRenamed("raw", "raw_b"), "form").where("raw_a < raw_b")
    a = members.select("form", F.col("raw").alias("raw_a"), F.col("id").alias("a"))
    b = members.select("form", F.col("raw").alias("raw_b"), F.col("id").alias("b"))
    found = pairs.join(a, ["form", "raw_a"]).join(b, ["form", "raw_b"])
    return found.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def look_alike_groups(df: DataFrame, key: str, *texts: str) -> DataFrame:
    """(id, class_id, group_id), one row per record that looks like another one with other characters: the smallest ids of the records
    with its very texts and of those that look like it."""
    members = _alike(df, key, *texts)
    classes = members.groupBy("form", "raw").agg(F.min("id").alias("class_id"))
    groups = classes.groupBy("form").agg(F.min("class_id").alias("group_id"))
    return members.join(classes, ["form", "raw"]).join(groups, "form").select("id", "class_id", "group_id")
