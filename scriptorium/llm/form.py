"""One consistent character form for text (problem 2).

The form of a text is its NFC form in which, besides,

* full-width and half-width characters have their ordinary shape,
* ligature characters are spelt out,
* invisible characters are gone (format and default-ignorable characters, controls),
* every blank is the ordinary blank (tab and line ends stay),
* a word whose letters mix scripts is written in one script, where look-alikes exist.

Typographic quotes and dashes, superscripts, letter case and whole words in another script stay.

Method: the normalization quick-check properties (``NFC_QC``, decomposition types, default-ignorable)
locate the unstable characters. Each run of them, widened to the character before it and the
marks behind it (the boundary context), is normalised on its own and spliced into the unchanged rest.
ASCII text without controls is never touched, and most other text only at a few segments.

Null stays null, the empty text stays empty. Nothing depends on the length of the text.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import ship_package

KINDS = ("width", "ligature", "compose", "invisible", "blank", "script")
"""What can be wrong with a value; each is a case of p2_found."""

_INVISIBLE = r"[[\p{Cf}\p{Default_Ignorable_Code_Point}\x00-\x08\x0E-\x1F\x7F-\x84\x86-\x9F]--[\p{Zs}]]"
_BLANK = r"[\p{Zs}--[ ]]"
_WIDTH = r"[\p{dt=wide}\p{dt=narrow}]"
_LIGATURE = r"[Ĳĳﬀ-ﬆﬓ-ﬗﭏﯪ-ﯻﰀ-ﴽﵐ-ﷇﷰ-ﷻﻵ-ﻼ]"
_QUICK = r"[\p{NFC_QC=N}\p{NFC_QC=M}]"
_V = regex.V1 | regex.DOTALL
_SEGMENT = regex.compile(f".?(?:{_INVISIBLE}|{_BLANK}|{_WIDTH}|{_LIGATURE}|{_QUICK}|\\p{{M}})+", _V)
_INV, _BLK, _WID, _LIG = (regex.compile(x, _V) for x in (_INVISIBLE, _BLANK, _WIDTH, _LIGATURE))
_LATIN_RANGE, _EXOTIC_RANGE = "A-Za-z\u00c0-\u024f\u1e00-\u1eff", "\u0370-\u058f\u1f00-\u1fff"
_BETWEEN = "[0-9\u0300-\u036f]*"
# letters of two scripts with nothing but digits and marks between them: some word may be mixed
_MIXED = re.compile(f"[{_LATIN_RANGE}]{_BETWEEN}[{_EXOTIC_RANGE}]|[{_EXOTIC_RANGE}]{_BETWEEN}[{_LATIN_RANGE}]|[\u0370-\u03ff\u1f00-\u1fff]{_BETWEEN}[\u0400-\u058f]|[\u0400-\u058f]{_BETWEEN}[\u0370-\u03ff\u1f00-\u1fff]")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
_EXOTIC_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]*[\p{Cyrillic}\p{Greek}\p{Armenian}][\p{L}\p{N}\p{M}]*")
_SCRIPTS = {x: regex.compile(rf"[\p{{L}}&&\p{{{x}}}]", regex.V1) for x in ("Latin", "Cyrillic", "Greek", "Armenian")}



def _members(pattern: str) -> frozenset[str]:
    """The characters of a set, to be met with a text's own set of characters: much faster than a search for few of many."""
    return frozenset(regex.findall(pattern, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE1000)])), _V))


_UNSTABLE = _members(f"(?:{_INVISIBLE}|{_BLANK}|{_WIDTH}|{_LIGATURE}|{_QUICK})")
_EXOTIC = _members(f"[{_EXOTIC_RANGE}]")

# Letters of one script that look like a letter of another.
LATIN_OF = {
    "Cyrillic": dict(zip("аеорсухіјѕһԁԛԝѵкАВЕКМНОРСТУХІЈЅҺԀԚԜѴ", "aeopcyxijshdqwvkABEKMHOPCTYXIJSHDQWV", strict=True)),
    "Greek": dict(zip("ανορυικτγηωχΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ", "avopuiktynwxABEZHIKMNOPTYXcj", strict=True)),
    "Armenian": dict(zip("օոսցհյզքՕՍ", "onughjqpOU", strict=True)),
}
_TO: dict[tuple[str, str], dict[str, str]] = {}
for _s, _m in LATIN_OF.items():
    _TO[_s, "Latin"] = _m
    _TO["Latin", _s] = {v: k for k, v in _m.items()}
for _s in LATIN_OF:
    for _t in LATIN_OF:
        if _s != _t:
            _back = _TO["Latin", _t]
            _TO[_s, _t] = {k: _back[v] for k, v in LATIN_OF[_s].items() if v in _back}


def _fold_word(word: str) -> str:
    """A word with letters of several scripts in the script that can write all of it, else the most of it."""
    counts = {s: len(r.findall(word)) for s, r in _SCRIPTS.items()}
    have = [s for s, n in counts.items() if n]
    if len(have) < 2:
        return word
    best = None
    for target in have:
        out, left = [], 0
        for ch in word:
            own = next((s for s in have if s != target and _SCRIPTS[s].match(ch)), None)
            to = _TO[own, target].get(ch) if own else ch
            left += to is None
            out.append(ch if to is None else to)
        fits = left == 0 and (target != "Greek" or counts["Greek"] > counts["Latin"])  # a formula's letter pulls no Latin one
        rank = (fits, counts[target], target == "Latin")
        if best is None or rank > best[0]:
            best = (rank, "".join(out))
    return best[1]


def _splice(match, kinds: set[str]) -> str:
    raw = match.group()
    text = raw
    if _INV.search(text):
        kinds.add("invisible")
        text = _INV.sub("", text)
    if _BLK.search(text):
        kinds.add("blank")
        text = _BLK.sub(" ", text)
    for kind, rx in (("width", _WID), ("ligature", _LIG)):
        if rx.search(text):
            kinds.add(kind)
            text = rx.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    out = unicodedata.normalize("NFC", text)
    if len(out) < len(text):
        kinds.add("compose")
    return out


def to_form(text: str | None) -> tuple[str | None, tuple[str, ...]]:
    """The form of one text, and the kinds of change it needed."""
    if text is None:
        return None, ()
    kinds: set[str] = set()
    if not text.isascii():
        chars = set(text)
        if not chars.isdisjoint(_UNSTABLE):
            text = _SEGMENT.sub(lambda m: _splice(m, kinds), text)
            if not unicodedata.is_normalized("NFC", text):  # a segment's neighbour became composable
                text = unicodedata.normalize("NFC", text)
            chars = set(text)
        if not chars.isdisjoint(_EXOTIC) and _MIXED.search(text):
            folded = _EXOTIC_WORD.sub(lambda m: _fold_word(m.group()), text)
            if folded != text:
                kinds.add("script")
                text = folded
    elif _CONTROL.search(text):
        kinds.add("invisible")
        text = _INV.sub("", text)
    return text, tuple(k for k in KINDS if k in kinds)


_NEEDS = r"[^\x09-\x0D\x20-\x7E]"


def normalise_column(df: DataFrame, column: str, form: str = "form", kinds: str = "form_kinds") -> DataFrame:
    """``df`` with the form of ``column`` and the list of changes it needed.

    Only values with a character outside printable ASCII cross to Python; the others are their own
    form. Null gives null and an empty list. Columns of ``df`` named like the new ones are replaced.
    """
    ship_package(df.sparkSession)
    # only the doubtful values cross into Python
    doubtful = F.when(F.col(f"`{column}`").rlike(_NEEDS), F.col(f"`{column}`"))
    done = _form_udf()(doubtful)
    out = df.withColumn("__form", done)
    return (
        out.withColumn(form, F.coalesce(F.col("__form.form"), F.col(f"`{column}`")))
        .withColumn(kinds, F.coalesce(F.col("__form.kinds"), F.array().cast("array<string>")))
        .drop("__form")
    )


def _form_udf():
    @F.arrow_udf("struct<form:string,kinds:array<string>>")
    def run(values: pa.Array) -> pa.Array:
        forms, kinds = [], []
        for v in values.to_pylist():
            if v is None:
                forms.append(None)
                kinds.append(None)
            else:
                f, k = to_form(v)
                forms.append(f)
                kinds.append(list(k))
        return pa.StructArray.from_arrays([pa.array(forms, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=["form", "kinds"])

    return run


def changed_values(df: DataFrame, fields: list[str], id_column: str = "sample_id") -> DataFrame:
    """One row ``field, id`` for each value of ``fields`` that had one of the listed faults; rows are distinct.

    One scan: the fields of a row stand in an array of structs, of which only the doubtful ones are
    exploded before the form is computed.
    """
    pairs = [
        F.when(F.col(f"`{c}`").rlike(_NEEDS), F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("value")))
        for c in fields
    ]
    doubtful = df.select(F.col(f"`{id_column}`").alias("__id"), F.explode(F.array_compact(F.array(*pairs))).alias("v"))
    found = normalise_column(doubtful.select("__id", "v.field", "v.value"), "value")
    return found.where(F.size("form_kinds") > 0).select("field", F.col("__id").alias(id_column)).distinct()


