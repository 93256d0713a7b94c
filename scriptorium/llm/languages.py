"""Missing or wrong document language labels (problem 9).

Each document is cut into segments (sentences of its running text, and table cells that hold sentences); every
segment gets a language with a confidence; neighbouring segments of one language are one stretch.
A language is in a document if at least ``MIN_WORDS`` words of its running text stand in segments of it.
Headings, captions, formulas, code, links, short cells and quoted passages of up to ``QUOTE_WORDS`` words are no
running text. Names and numbers are no words of a language: they decide nothing.

Method: language-bitmask n-gram filters. The filters are bit-sliced Bloom filters: one table whose slot holds
a bit per language; the AND of an n-gram's slots is the mask of all languages that contain it. A segment's
n-grams (parts of its words, and the words themselves) vote with their masks; each language's popcount is corrected for
its filter's false positives, and the highest decides. The confidence is the share of the winner's n-grams that the
second best lacks, 0 for no evidence. Where a document's n-grams of a language that wins are known to it at a rate below ``OTHER_RATE`` (texts of fitted
languages have 0.35 and more, of others 0.2 and less), the language is none of the fitted ones: ``other``.

The filters are fitted to labelled documents, at most ``rows_per_language`` rows of each language (those with the smallest hashed ids) of at
most ``max_chars`` characters; this bounds the sample. The languages are those that the labels name: every one with two rows and ``least_share`` of all
labelled rows. Ids are chosen by their hashes where they are read, so that no text is shuffled or ranked but a small multiple of the sample. Labels may be
wrong and documents mixed, so the fit is repeated on the segments that the first filters place.
Everything else covers all documents and whole texts.

Defined cases: null, empty and wordless texts have no language (``language`` null,
confidence 0), documents without running text neither unless ``loose`` takes their headings, captions and cells instead; repeated ids are told apart by their rows where they are read; a label that names no known language counts as
missing; with no labelled document at all no language is ever found.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import ship_package, spread
from .form import to_form

# Two-letter codes and their three-letter ones; other two-letter codes stand for themselves.
CODES = {
    "en": ("eng",), "de": ("deu", "ger"), "fr": ("fra", "fre"), "es": ("spa",), "it": ("ita",), "pt": ("por",), "nl": ("nld", "dut"), "ru": ("rus",),
    "pl": ("pol",), "sv": ("swe",), "da": ("dan",), "fi": ("fin",), "cs": ("ces", "cze"), "el": ("ell", "gre"), "tr": ("tur",), "uk": ("ukr",), "ro": ("ron", "rum"), "hu": ("hun",),
}
OTHER, OTHER_RATE = "other", 0.27
MIN_WORDS, QUOTE_WORDS, CELL_WORDS, SLOTS, HASHES = 30, 25, 5, 1 << 20, 3

_LETTERS = re.compile(r"[^\W\d_]+")
_MATH = re.compile(r"\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\$[^$\n]+\$|```.*?```|`[^`\n]*`|https?://\S+|<\|[^|\n]*\|>|<[^<>\n]{1,40}>", re.DOTALL)
_QUOTE = re.compile(r"“[^”]*”|«[^»]*»|„[^“”]*[“”]|\"[^\"\n]*\"")
_QUOTES = frozenset("“«„\"")
_SENTENCE = re.compile(r"[.!?…][”\")»]*\s+(?![a-zß-öø-ÿа-яё])")
_CAPTION = re.compile(r"\s*\**[^\W\d_]+\**\s*(?:\d+\s*)?:\s")
_BLOCK = re.compile(r"\n\s*\n")
_LINE_END = re.compile(r"[\r\n]+")
_RULE = re.compile(r"^[\s|:\-=*_~]+$")


def label_code(column: Column) -> Column:
    """The two-letter code that a label names, whatever its case, region and blanks; null where it names none."""
    base = F.split(F.regexp_replace(F.lower(column), r"[\s\p{Z}]+", ""), "[-_]")[0]
    out = F.when(base.rlike("^[a-z]{2}$"), base)
    for two, threes in CODES.items():
        out = out.when(base.isin(*threes), two)
    return out


def loose_segments(text: str) -> list[str]:
    """The lines of a text without formulas, whatever they are: for texts without running text."""
    return [x for x in _LINE_END.split(_MATH.sub(" ", to_form(text)[0])) if x.strip()]


def segments_of(text: str) -> list[str]:
    """The sentences of a text's running text, in order."""
    form = to_form(text)[0]
    if "\r" in form:
        form = form.replace("\r\n", "\n").replace("\r", "\n")
    if "$" in form or "\\" in form or "`" in form or "<" in form or "http" in form:
        form = _MATH.sub(" ", form)
    out: list[str] = []
    for block in _BLOCK.split(form):
        prose: list[str] = []
        for line in block.split("\n"):
            bare = line.strip()
            if not bare or bare.startswith("#") or _RULE.match(bare):
                continue
            if bare.startswith("|") or bare.endswith("|") and bare.count("|") > 1:
                for cell in bare.strip("|").split("|"):
                    if len(_LETTERS.findall(cell)) >= CELL_WORDS:
                        out += _SENTENCE.split(cell.strip())
                continue
            prose.append(bare)
        joined = " ".join(prose)
        if _CAPTION.match(joined) and len(prose) == 1 and len(joined) < 120:
            continue
        if joined:
            if not _QUOTES.isdisjoint(joined):
                joined = _QUOTE.sub(lambda m: " " if len(_LETTERS.findall(m.group())) <= QUOTE_WORDS else m.group(), joined)
            out += [s for s in _SENTENCE.split(joined) if s]
    return out


def grams_of(word: str) -> list[str]:
    """The n-grams of a word: its runs of three and four characters with its borders, and itself."""
    p = f"_{word}_"
    return [p[i : i + n] for n in (3, 4) for i in range(len(p) - n + 1)] + [p + "="]


_HASH = xxhash.xxh64_intdigest


def _slots(h: np.ndarray) -> list[np.ndarray]:
    """The slots of n-grams by their hashes, one array per hash function."""
    a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return [(a + np.uint64(k) * b) % np.uint64(SLOTS) for k in range(HASHES)]


class Filters:
    """Bit-sliced Bloom filters of the languages' n-grams, a bit per language in as many bytes as it takes; ``fill`` is each filter's rate of false positives."""

    def __init__(self, table: np.ndarray, languages: tuple[str, ...]) -> None:
        self.table, self.languages = table, languages
        self.fill = np.array([np.mean(table[:, k >> 3] >> (k & 7) & 1) for k in range(len(languages))]) ** HASHES
        self.places: dict[str, int] = {}
        self.size = 0
        self.votes = np.zeros((1024, 2 * len(languages) + 1))

    def _learn(self, words: list[str]) -> None:
        """Look up new words: per language the corrected number of n-grams, and whether it knows the whole word; at last how many n-grams there are."""
        if self.size + len(words) > 400_000:
            self.places.clear()
            self.size = 0
        while self.size + len(words) > len(self.votes):
            self.votes = np.concatenate([self.votes, np.zeros_like(self.votes)])
        grams = [grams_of(w) for w in words]
        sizes = np.array([len(g) for g in grams])
        h = np.array([_HASH(x, 7) for g in grams for x in g], np.uint64)
        mask = np.bitwise_and.reduce([self.table[at] for at in _slots(h)])
        n = len(self.languages)
        bits = np.unpackbits(mask, axis=1, count=n, bitorder="little").astype(np.float64)
        last = np.cumsum(sizes) - 1
        # a word that a language knows as such weighs as much as all its parts
        hits = np.add.reduceat(bits, last - sizes + 1, axis=0) + bits[last] * (sizes - 1)[:, None]
        votes = np.maximum(0.0, hits - (2 * sizes - 1)[:, None] * self.fill) / (1.0 - np.minimum(self.fill, 0.999))
        self.votes[self.size : self.size + len(words), :n] = votes
        self.votes[self.size : self.size + len(words), n : 2 * n] = bits[last]
        self.votes[self.size : self.size + len(words), 2 * n] = 2 * sizes - 1
        for k, w in enumerate(words):
            self.places[w] = self.size + k
        self.size += len(words)

    def segments(self, parts: list[list[str]]) -> list[tuple[int | None, float, int, float, float]]:
        """Language, confidence, words that the language knows, its n-grams and all n-grams, of each list of words (none is empty)."""
        if not parts or not self.languages:
            return [(None, 0.0, 0, 0.0, 0.0)] * len(parts)
        flat = list(chain.from_iterable(parts))
        rows = list(map(self.places.get, flat))
        if None in rows:
            self._learn(list(dict.fromkeys(w for w, r in zip(flat, rows, strict=True) if r is None)))
            rows = list(map(self.places.get, flat))
            if None in rows:  # the store was emptied on the way
                self._learn(list(dict.fromkeys(w for w, r in zip(flat, rows, strict=True) if r is None)))
                rows = list(map(self.places.get, flat))
        starts = np.cumsum([0, *(len(ws) for ws in parts[:-1])])
        votes = np.add.reduceat(self.votes[rows], starts, axis=0)
        # columns: a language's corrected n-grams, then whether it knows the word
        n = len(self.languages)
        each = np.arange(len(parts))
        best = votes[:, :n].argmax(axis=1)
        top = votes[each, best]
        second = np.partition(votes[:, :n], n - 2, axis=1)[:, n - 2] if n > 1 else np.zeros(len(parts))
        sure = np.where(top > 0, (top - second) / np.maximum(top, 1e-12), 0.0)
        rows = zip(best.tolist(), sure.tolist(), votes[each, n + best].tolist(), top.tolist(), votes[:, 2 * n].tolist(), strict=True)
        return [(b if t > 0 else None, c, int(k), t, g) for b, c, k, t, g in rows]

    def documents(self, texts: list[str | None], loose: bool = False, with_text: bool = False) -> list[list[dict]]:
        """For each text its stretches of one language: language, confidence, words, words known, first and last segment (of ``segments_of``, from 0)."""
        per, cuts = [], []
        for t in texts:
            cut = [] if t is None else segments_of(t)
            parts = [(at, ws) for at, ws in enumerate(_LETTERS.findall(x.casefold()) for x in cut) if ws]
            if loose and t and not parts:
                cut = loose_segments(t)
                parts = [(at, ws) for at, ws in enumerate(_LETTERS.findall(x.casefold()) for x in cut) if ws]
            per.append(parts)
            cuts.append(cut)
        got = iter(self.segments([ws for parts in per for _, ws in parts]))
        out = []
        for parts, cut in zip(per, cuts, strict=True):
            placed = []
            evidence: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
            for at, ws in parts:
                lang, sure, known, grams, size = next(got)
                if lang is not None:
                    placed.append((lang, sure, known, len(ws), at))
                    evidence[lang][0] += grams
                    evidence[lang][1] += size
            name = {k: self.languages[k] if g >= OTHER_RATE * n else OTHER for k, (g, n) in evidence.items()}
            runs: list[dict] = []
            for lang, sure, known, n, at in placed:
                if runs and runs[-1]["language"] == name[lang]:
                    last = runs[-1]
                    last["confidence"] = (last["confidence"] * last["words"] + sure * n) / (last["words"] + n)
                    last["words"] += n
                    last["known"] += known
                    last["last"] = at
                else:
                    runs.append({"language": name[lang], "confidence": sure, "words": n, "known": known, "first": at, "last": at})
            if with_text:
                for r in runs:
                    r["text"] = " ".join(x.strip() for x in cut[r["first"] : r["last"] + 1])
            out.append(runs)
        return out


def _fit(places: list[tuple[str, list[str]]], languages: tuple[str, ...], ratio: float, least: int) -> Filters:
    """Filters of (language, words) segments; an n-gram is of every language whose rate of it is ``ratio`` of the highest."""
    index = {x: k for k, x in enumerate(languages)}
    words: list[Counter] = [Counter() for _ in languages]
    for lang, ws in places:
        words[index[lang]].update(ws)
    counts: dict[str, list[int]] = defaultdict(lambda: [0] * len(languages))
    for k, c in enumerate(words):
        for w, n in c.items():
            for g in grams_of(w):
                counts[g][k] += n
    table = np.zeros((SLOTS, max(1, -(-len(languages) // 8))), np.uint8)
    if counts:
        grams = list(counts)
        seen = np.array([counts[g] for g in grams], np.float64)
        rate = seen / np.maximum([c.total() for c in words], 1)
        holds = (seen >= least) & (rate >= ratio * rate.max(axis=1, keepdims=True))
        masks = np.packbits(holds, axis=1, bitorder="little")
        h = np.array([_HASH(g, 7) for g in grams], np.uint64)
        for at in _slots(h):
            np.bitwise_or.at(table, at, masks)
    return Filters(table, languages)


def fit_filters(documents: DataFrame, *, text: str = "text", id_column: str = "doc_id", label: str = "lang", rows_per_language: int = 300, max_chars: int = 20_000, least_share: float = 0.002) -> Filters:
    """Filters fitted to a bounded sample of labelled documents."""
    known = documents.select(F.col(f"`{text}`").alias("text"), label_code(F.col(f"`{label}`")).alias("code"), F.xxhash64(F.col(f"`{id_column}`")).alias("h")).where("code is not null")
    # codes have two letters: at most 676 rows
    counts = {r["code"]: r["n"] for r in known.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    named = {k: n for k, n in counts.items() if n >= max(2, least_share * sum(counts.values()))}
    if not named:
        return _fit([], (), 0.3, 2)
    languages = tuple(sorted(named, key=lambda k: (-named[k], k)))
    # ids below a hash that lets half as many again as needed pass are few: only their texts are moved and ranked
    below = F.lit(None).cast("bigint")
    for k, n in named.items():
        share = min(1.0, (1.5 * rows_per_language + 50) / n)
        below = F.when(F.col("code") == k, F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))).otherwise(below)
    few = known.where(F.col("h") <= below).where(f"text is not null and length(text) between 200 and {int(max_chars)}")
    ranked = few.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy("h", "text"))).where(F.col("k") <= rows_per_language)
    sample = [(r["code"], [ws for ws in (_LETTERS.findall(s.casefold()) for s in segments_of(r["text"])) if ws]) for r in ranked.select("code", "text").collect()]
    filters = _fit([(c, ws) for c, parts in sample for ws in parts], languages, 0.3, 2)
    for _ in range(2):
        placed = [(languages[k], ws) for _, parts in sample for ws, (k, sure, *_) in zip(parts, filters.segments(parts), strict=True) if k is not None and sure > 0.1]
        filters = _fit(placed, languages, 0.1, 2)
    return filters


_FILTERS: dict[str, Filters] = {}


def _filters(sent: tuple, key: str) -> Filters:
    if key not in _FILTERS:
        _FILTERS.clear()
        _FILTERS[key] = Filters(*sent)
    return _FILTERS[key]


_STRETCH = [("language", "string"), ("confidence", "double"), ("words", "int"), ("known", "int"), ("first", "int"), ("last", "int")]
_ARROW = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}


def language_stretches(documents: DataFrame, filters: Filters | None = None, *, text: str = "text", id_column: str = "doc_id", label: str = "lang", loose: bool = False, with_text: bool = False) -> DataFrame:
    """``id, label, stretches``: each document with the code its label names and its stretches (language, confidence, words, known, first and last segment, and with ``with_text`` their text)."""
    spark = documents.sparkSession
    ship_package(spark)
    filters = filters or fit_filters(documents, text=text, id_column=id_column, label=label)
    sent = spark.sparkContext.broadcast((filters.table, filters.languages))
    key = xxhash.xxh64_hexdigest(filters.table.tobytes() + " ".join(filters.languages).encode())
    kind = dict(documents.dtypes)[id_column]
    fields = [*_STRETCH, *([("text", "string")] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _filters(sent.value, key)
        item = pa.list_(pa.struct([(n, _ARROW[t]) for n, t in fields]))
        for b in batches:
            got: list = []
            texts = b.column(2).to_pylist()
            for i in range(0, len(texts), 200):
                got += f.documents(texts[i : i + 200], loose, with_text)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, item)], names=["id", "label", "stretches"])

    rows = documents.select(F.col(f"`{id_column}`").alias("id"), label_code(F.col(f"`{label}`")).alias("label"), F.col(f"`{text}`").alias("text"))
    return spread(rows).mapInArrow(run, f"id {kind}, label string, stretches array<struct<{','.join(f'{n}:{t}' for n, t in fields)}>>")


def document_languages(stretches: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``id, label, languages`` with the languages of each document (language, words, confidence), most words first."""
    per = F.transform(
        F.array_distinct(F.transform("stretches", lambda s: s["language"])),
        lambda lang: F.aggregate(
            F.filter("stretches", lambda s: s["language"] == lang),
            F.struct(F.lit(0).alias("words"), lang.alias("language"), F.lit(0.0).alias("confidence")),
            lambda acc, s: F.struct((acc["words"] + s["words"]).alias("words"), acc["language"].alias("language"), (acc["confidence"] + s["confidence"] * s["words"]).alias("confidence")),
        ),
    )
    kept = F.reverse(F.array_sort(F.filter(per, lambda x: x["words"] >= min_words)))
    return stretches.select("id", "label", F.transform(kept, lambda x: F.struct(x["language"].alias("language"), x["words"].alias("words"), (x["confidence"] / x["words"]).alias("confidence"))).alias("languages"))


def wrong_labels(documents: DataFrame, **options) -> DataFrame:
    """``id, language``: each language of the documents that have several, or one that their label does not name."""
    per = document_languages(language_stretches(documents, **options)).withColumn("languages", F.filter("languages", lambda x: x["language"] != OTHER))
    case = (F.size("languages") > 1) | ((F.size("languages") == 1) & ~F.coalesce(F.col("label") == F.col("languages")[0]["language"], F.lit(False)))
    return per.where(case).select("id", F.explode("languages.language").alias("language")).distinct()
