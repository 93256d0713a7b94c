"""Records that differ only in formatting (problem 1).

The record of a text is what is left of its form (see ``form``) without letter case, white space and
punctuation: its words in order. A field list (two or more ``name: value`` lines and no other, with or without bullets, after
headings; names of any length) or a flat JSON object is a set of fields instead, whose order does not count: its record is
the multiset of its fields, each the words of the name and the words of the value, and the headings.

Method: every distinct text of a batch is canonicalised once (the batch is dictionary-encoded); each
field gets an integer identifier, so that a record becomes a sorted tuple of integers, and only the
tuples are shuffled and grouped. An identifier is the 128-bit digest of the field, as two 64-bit
integers: the same in every task, so that no dictionary has to be built, joined or broadcast, and wide
enough for no two fields ever to meet (at 10^12 distinct fields the odds are about 10^-15).

Null texts and texts without letter or digit have no record. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b
from unicodedata import category

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HOT, met_with_one
from ..shared import cut, ship_package, spread
from .form import to_form

_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*")
_PLAIN_WORD = re.compile(r"[^\W_]+")
_MARKS = frozenset(c for c in map(chr, range(0x300, 0x1F000)) if category(c)[0] == "M")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_FIELD_LINE = re.compile(r"\s*(?:(?:[-*+•·‣]|\d{1,3}[.)])\s+)?(?P<name>[^:\n]+):(?P<value>.*)", re.DOTALL)
_JSON_STRING = r'"((?:[^"\\]|\\.)*)"'
_JSON_VALUE = rf'(?:{_JSON_STRING}|(-?[\w.+-]+))'
_JSON_OBJECT = re.compile(rf"\s*\{{\s*(?:{_JSON_STRING}\s*:\s*{_JSON_VALUE}\s*,?\s*)+\}}\s*", re.DOTALL)
_JSON_MEMBER = re.compile(rf"{_JSON_STRING}\s*:\s*{_JSON_VALUE}", re.DOTALL)
_ESCAPE = re.compile(r'\\(u[0-9a-fA-F]{4}|.)', re.DOTALL)
_PLAIN_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": " ", "f": " "}


def words_of(form: str) -> list[str]:
    """The words of a text in form: unbroken runs of letters and digits, case folded."""
    folded = form.casefold()
    if folded.isascii():
        return _ASCII_WORD.findall(folded)
    return (_PLAIN_WORD if _MARKS.isdisjoint(set(folded)) else _WORD).findall(folded)


def _unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _PLAIN_ESCAPES.get(m[1], m[1]), text)


def fields_of(form: str) -> list[tuple[str, str]] | None:
    """The fields of a flat JSON object or a field list as (name, value) words, headings as ('', words).

    None for other text, and for a single field, which has no order and is its words.
    """
    text = form.strip()
    if text[:1] == "{" and text[-1:] == "}" and _JSON_OBJECT.fullmatch(text):
        members = [(" ".join(words_of(_unescape(n))), " ".join(words_of(_unescape(a or b)))) for n, a, b in _JSON_MEMBER.findall(text)]
        return members if len(members) > 1 else None
    if ":" not in text:
        return None
    fields: list[tuple[str, str]] = []
    names = 0
    for line in text.splitlines():
        if not line.strip():
            continue
        if line.lstrip().startswith("#"):
            if names:
                return None
            fields.append(("", " ".join(words_of(line))))
            continue
        m = _FIELD_LINE.fullmatch(line)
        name = words_of(m["name"]) if m else []
        if not name:
            return None
        names += 1
        fields.append((" ".join(name), " ".join(words_of(m["value"]))))
    return fields if names > 1 else None


def _halves(text: str) -> tuple[int, int]:
    d = blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def record_tuple(text: str | None) -> list[int] | None:
    """The sorted integer tuple of a text's record, two integers to a field; None where it has no record."""
    if text is None:
        return None
    form, _ = to_form(text)
    fields = fields_of(form)
    if fields is None:
        words = words_of(form)
        return list(_halves(" ".join(words))) if words else None
    if not any(n or v for n, v in fields):
        return None
    ids = sorted(_halves(f"{n}\x1f{v}" if n else v) for n, v in fields if n or v)
    return [x for pair in ids for x in pair]


def once_each(values: pa.Array, function: Callable) -> list:
    """``function`` of every value, computed once for each distinct value of the batch."""
    encoded = values.dictionary_encode()
    done = [function(v) for v in encoded.dictionary.to_pylist()]
    return [None if i is None else done[i] for i in encoded.indices.to_pylist()]


def record_tuples(df: DataFrame, text: str = "canonical_target", id_column: str = "sample_id") -> DataFrame:
    """``id, record``: the integer tuple of each row that has a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array(once_each(b.column(1), record_tuple), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), got], names=["id", "record"])

    ship_package(df.sparkSession)
    kind = dict(df.dtypes)[id_column]
    rows = df.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{id_column}`").isNotNull())
    return spread(rows.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))).mapInArrow(run, f"id {kind}, record array<bigint>").where("record is not null")


def collapse_records(df: DataFrame, text: str = "canonical_target", id_column: str = "sample_id") -> DataFrame:
    """One row per record: ``record, first_id, copies`` with its smallest id and its number of distinct ids.

    Counting runs in two steps, both combined before the shuffle: rows are first made distinct by
    record and id (which spreads a record that holds a third of all rows over every task), then counted.
    """
    members = record_tuples(df, text, id_column).distinct()
    return members.groupBy("record").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def record_members(df: DataFrame, text: str = "canonical_target", id_column: str = "sample_id", hot: int = HOT) -> DataFrame:
    """``first_id, id`` for every member but the smallest of each record with two or more ids.

    The members meet their record's smallest id: a record with more than ``hot`` copies over as many tasks as it takes.
    """
    members = cut(record_tuples(df, text, id_column).distinct(), "records")
    groups = members.groupBy("record").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return met_with_one(members, groups, ["record"], spread=F.col("id"), count="copies", hot=hot).where("id > first_id").select("first_id", "id")
