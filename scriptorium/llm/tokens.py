"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 7).

``encode_documents`` gives every row of a table its list of token ids, without special tokens: strings of
special tokens are ordinary text. An empty and a null text both give an empty list.

Method: tree concatenation. A text of more than ``leaf_chars`` characters is halved until no part is longer; the parts are
encoded in parallel (``threads``; the tokenizer works outside the interpreter's lock), and neighbours are joined pairwise, level by
level. Only a window around each join is encoded again. It grows to both sides until each edge is a place where
the two sides' tokens are certain to agree, or the side ends. What is outside the window stays as it was encoded.

Why the result is exact: the tokenizer first splits text into chunks by a pattern, and merges bytes within chunks only. A place between a
character that is no white space and a blank or line feed is a boundary of chunks whatever stands around it: no chunk holds white space behind
anything else, and what follows is split without regard to what went before. In a text that has no such place for ``RUN`` characters on
both sides of a join the chunks themselves are compared: chunks of the left side that end ``LOOK`` characters before its end cannot be moved by
what follows, and once the window's chunks end where a chunk of the right side ends, both continue alike. Within
one long unsplit chunk tokens are compared: a sequence of BPE tokens is the encoding of
its bytes exactly if every two neighbours are the encoding of theirs, which is tested at the window's edges.

One scan, without a shuffle: short and long texts are encoded in the batch they are read in.

The vocabulary file is a parameter; its bytes (under a megabyte) go to the executors with the task, and no
executor needs the file.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import ship_package, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public split pattern of this tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOOK, RUN, LEAF_CHARS = 4, 4096, 2048

_CERTAIN = re.compile(r"\S(?=[ \n])")
_CODERS: dict[str, Coder] = {}


class Coder:
    """A byte-level BPE over chunks of a split pattern, with its parts at hand."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        # the same split; the blanks are spelt out since the two engines' own sets of them differ
        self.split = regex.compile(pattern.replace("\\S", r"\P{White_Space}").replace("\\s", r"\p{White_Space}"))
        self.word = {v: k for k, v in self.ranks.items()}

    def ids(self, text: str) -> list[int]:
        return self.bpe.encode_ordinary(text)

    def leaves(self, parts: list[str], threads: int) -> list[list[int]]:
        """The ids of each part; from eight parts on by several threads, which wait for no interpreter lock."""
        return self.bpe.encode_ordinary_batch(parts, num_threads=threads) if threads > 1 and len(parts) >= 8 else [self.ids(p) for p in parts]

    def merged(self, raw: bytes) -> list[int]:
        """The ids of a few bytes within one chunk, which need not be whole characters: the lowest pair merges first."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], len(self.ranks)))
            both = parts[best] + parts[best + 1]
            if both not in self.ranks:
                break
            parts[best : best + 2] = [both]
        return [self.ranks[p] for p in parts]


def coder(vocabulary: bytes) -> Coder:
    key = hashlib.sha1(vocabulary).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = Coder(vocabulary)
    return _CODERS[key]


@dataclass
class Node:
    """An encoded stretch of text."""

    text: str
    ids: list[int]


@dataclass
class Run:
    """A stretch without a certain place: its ids, where its chunks end, and how many ids stand before each end."""

    text: str
    ids: list[int]
    ends: list[int]
    counts: list[int]


def chunked(c: Coder, text: str, ids: list[int]) -> Run:
    """The chunks of an encoded stretch; the ids fall to them by their bytes."""
    ends, counts, k = [], [], 0
    for m in c.split.finditer(text):
        left = len(m.group().encode("utf-8", "replace"))
        while left > 0:
            left -= len(c.word[ids[k]])
            k += 1
        ends.append(m.end())
        counts.append(k)
    return Run(text, ids, ends, counts)


def join_chunk(c: Coder, left: list[int], right: list[int], window: int = 8) -> list[int]:
    """The ids of an unsplit chunk from those of its two halves."""

    def agree(a: int, b: int) -> bool:
        return c.merged(c.word[a] + c.word[b]) == [a, b]

    def inside(k: int, side: list[int]) -> bool:
        return 0 < k < len(side) and 0x80 <= c.word[side[k]][0] < 0xC0  # in the middle of a character

    while True:
        i, j = max(0, len(left) - window), min(len(right), window)
        while inside(i, left):
            i -= 1
        while inside(j, right):
            j += 1
        raw = b"".join(c.word[x] for x in left[i:] + right[:j])
        mid = c.ids(raw.decode("utf-8", "replace"))  # a part of a chunk is one chunk as well
        if (i == 0 or agree(left[i - 1], mid[0])) and (j == len(right) or agree(mid[-1], right[j])):
            return left[:i] + mid + right[j:]
        window *= 2


def join_runs(c: Coder, left: Run, right: Run) -> list[int]:
    """The ids of two neighbours, chunk by chunk from where the left one's are certain until both agree."""
    a, b = left.text, right.text
    text = a + b
    k = bisect_right(left.ends, len(a) - LOOK)  # the chunks of the left side that nothing behind it can move
    start, kept = (left.ends[k - 1], left.counts[k - 1]) if k else (0, 0)
    ids = left.ids[:kept]
    known = {e: i for i, e in enumerate(right.ends)}
    for m in c.split.finditer(text, start):  # the window grows by a chunk until both sides agree
        e = m.end() - len(a)
        if k == len(left.ends) - 1 and m.start() == start and e == right.ends[0]:  # one chunk over both
            ids = ids + join_chunk(c, left.ids[kept:], right.ids[: right.counts[0]])
        else:
            ids = ids + c.ids(m.group())
        if e in known:
            return ids + right.ids[right.counts[known[e]] :]
    return ids


def _last_certain(text: str) -> int:
    """The last certain place of a text, 0 without any: looked for in windows that grow to the left."""
    size = 64
    while True:
        at = max(0, len(text) - size)
        found = [m.end() for m in _CERTAIN.finditer(text, at)]
        if found or at == 0:
            return found[-1] if found else 0
        size *= 4


def _ids_of(c: Coder, ids: list[int], size: int, step: int) -> int:
    """How many ids at one end (from the front or, with step -1, from the back) make up so many bytes."""
    k, n = 0, len(ids)
    while size > 0:
        size -= len(c.word[ids[k if step > 0 else n - 1 - k]])
        k += 1
    return k


def join_nodes(c: Coder, left: Node, right: Node) -> Node:
    """Two neighbours as one: the window between the certain places around the join is encoded again."""
    if not left.text or not right.text:
        return right if not left.text else left
    at = _last_certain(left.text)
    m = _CERTAIN.search(right.text)
    a, b = left.text[at:], right.text[: m.end() if m else len(right.text)]
    i = len(left.ids) - _ids_of(c, left.ids, len(a.encode("utf-8", "replace")), -1)
    j = _ids_of(c, right.ids, len(b.encode("utf-8", "replace")), 1)
    if len(a) + len(b) <= RUN:
        mid = c.ids(a + b)
    else:
        mid = join_runs(c, chunked(c, a, left.ids[i:]), chunked(c, b, right.ids[:j]))
    return Node(left.text + right.text, left.ids[:i] + mid + right.ids[j:])


def join_tree(c: Coder, nodes: list[Node]) -> Node:
    """Neighbours joined pairwise, level by level."""
    while len(nodes) > 1:
        nodes = [join_nodes(c, nodes[i], nodes[i + 1]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0]


def tree_ids(c: Coder, text: str, leaf_chars: int = LEAF_CHARS, threads: int = 2) -> list[int]:
    """The ids of one text: its parts encoded in parallel, then joined as a tree."""
    if len(text) <= leaf_chars:
        return c.ids(text)
    parts = 1 << (-(-len(text) // leaf_chars) - 1).bit_length()
    size = -(-len(text) // parts)
    pieces = [text[i : i + size] for i in range(0, len(text), size)]
    return join_tree(c, [Node(t, ids) for t, ids in zip(pieces, c.leaves(pieces, threads), strict=True)]).ids


def encode_documents(df: DataFrame, *, text: str = "text", id_column: str = "doc_id", vocabulary: str = VOCABULARY, leaf_chars: int = LEAF_CHARS, threads: int = 2) -> DataFrame:
    """``id_column, ids`` for every row of ``df``, in one scan; the ids of a null or empty text are an empty list."""
    spark = df.sparkSession
    ship_package(spark)
    raw = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    kind = dict(df.dtypes)[id_column]
    rows = spread(df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(raw.value)
        for b in batches:
            got = [tree_ids(c, t, leaf_chars, threads) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], names=["id", "ids"])

    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def decode_documents(df: DataFrame, *, ids: str = "ids", id_column: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """The texts of lists of ids: ``id_column, text``; the inverse of ``encode_documents`` but for null."""
    spark = df.sparkSession
    ship_package(spark)
    raw = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    kind = dict(df.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = coder(raw.value).word
        for b in batches:
            got = [None if x is None else b"".join(word[i] for i in x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], names=["id", "text"])

    return df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{ids}`").alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_column)
