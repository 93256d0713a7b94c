"""Same or near-same records across splits (problem 6).

A train sample and a validation or test sample overlap if they are the same record (see ``records``), or if
both have at least ``min_words`` words and their word sequences differ by at most ``share`` of the longer
one's words (inserted, deleted or replaced).

Method: a weighted cosine join between the splits. A text's vector has a term for every pair of adjacent words at every place, weighted by
how rare the pair is among the evaluation texts: w = 1 / log2(2 + n) for a pair that occurs n times. One edit changes at most two terms. Of two
sequences within d = floor(share * longest) edits each therefore keeps a dot product of at least its squared norm less its 2 d largest squared
weights: a bound on the cosine of the pair, for any weights, so that no true pair is lost. The inverted lists are pruned

* by maximum weight: a term that no evaluation text has contributes nothing, and is not listed for a train text,
* by residual norm: of a vector's terms, heaviest first, only so many are listed that the squared norm of the rest falls
  below the least dot product of any partner (``listed_terms``: 2 d + 1 for the budget of a text one word longer); the first kept term is among them on both sides,
* by place: kept terms move by at most d places,
* by signature: the words' parity in 126 hashed bits differs in at most two bits for each edit.

Candidates get their exact dot product, and those that reach the bound of both sides their exact word distance (Myers' bit-parallel
recurrence). Nothing is capped or dropped.

The weights come from a count over all evaluation texts in ``buckets`` hashed counters, whose size is fixed: this table alone is
broadcast (pairs that share a counter weigh the same). A term with more than ``hot`` occurrences is salted: its evaluation entries are spread over as many
lists as it takes, its train entries stand in each. Groups of the same record or words are salted likewise by their counted size where pairs are spelt out.

Texts with equal word sequences are one class and are compared once; ``near_classes`` gives the links
between classes, ``overlap_members`` the classes of the samples. ``overlapping_pairs`` spells the pairs out.

Defined cases: null targets and ids, unknown splits and targets without words take no part; a sample
delivered twice counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut, ship_package, spread
from .form import normalise_column, to_form
from .records import _halves, fields_of, once_each, words_of
from .splits import split_name

MIN_WORDS, SHARE = 20, 0.15


def _encode(text: str | None, min_words: int) -> tuple | None:
    """Digest of the record, digest of the words, number of words, the words; the last only for long texts."""
    if text is None:
        return None
    form, _ = to_form(text)
    words = words_of(form)
    if not words:
        return None
    line = " ".join(words)
    w = _halves(line)
    fields = fields_of(form)
    if fields is None:
        r = w
    else:
        ids = sorted(f"{n}\x1f{v}" if n else v for n, v in fields if n or v)
        d = blake2b("\x1e".join(ids).encode(), digest_size=16).digest()
        r = int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
    return (*r, *w, len(words), line if len(words) >= min_words else None)


_CLASSES = ("r1", "r2", "w1", "w2")
_ENCODED = "id string, split string, carried string, r1 bigint, r2 bigint, w1 bigint, w2 bigint, n int, words string"


def overlap_members(samples: DataFrame, *, text: str = "canonical_target", id_column: str = "sample_id", split: str = "split_assignment", carried: str | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """``id, split, carried, r1, r2, w1, w2, n, words``: each sample with its record class (r) and word class (w), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = once_each(b.column(3), lambda t: _encode(t, min_words))
            keep = [g is not None for g in got]
            cols = list(zip(*(g for g in got if g is not None), strict=True)) or [[]] * 6
            ids = [c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:3]]
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "split", "carried", "r1", "r2", "w1", "w2", "n", "words"])

    ship_package(samples.sparkSession)
    extra = F.col(carried).cast("string") if carried else F.lit(None).cast("string")
    rows = samples.select(F.col(id_column).cast("string").alias("id"), split_name(F.col(split)).alias("split"), extra.alias("carried"), F.col(text).alias("text"))
    return cut(spread(rows.where("id is not null and split is not null and text is not null")).mapInArrow(run, _ENCODED), "members")


def word_distance(a: list[str], b: list[str], most: int) -> int:
    """Edits that turn one word sequence into the other (Myers); most + 1 as soon as there are more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    m = len(a)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, left = mask, 0, m, len(b)
    for w in b:
        eq = places.get(w, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        hp = down | ~(diag | up) & mask
        hn = up & diag
        score += bool(hp & high) - bool(hn & high)
        left -= 1
        if score - left > most:
            return most + 1
        hp = (hp << 1 | 1) & mask
        up = (hn << 1 | ~((diag | eq | down) | hp)) & mask
        down = hp & (diag | eq | down)
    return score


class Terms:
    """The terms of a batch of texts as arrays: hash, text, place of each, and the texts' signatures."""

    _known: dict[str, int] = {}

    def __init__(self, lines: list[str]) -> None:
        known = Terms._known
        if len(known) > _CACHE_WORDS:
            known.clear()
        parts = [line.split(" ") for line in lines]
        hashes: list[int] = []
        for ws in parts:
            for w in ws:
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42)
                hashes.append(h)
        words = np.array(hashes, np.uint64)
        self.n = np.array([len(ws) for ws in parts], np.int64)
        starts = np.cumsum(self.n) - self.n
        text = np.repeat(np.arange(len(parts)), self.n)
        place = np.arange(len(words)) - starts[text]
        bit = (words >> np.uint64(24)) % np.uint64(SIGNATURE_BITS)
        one = np.uint64(1)
        low = np.where(bit < 63, one << np.minimum(bit, np.uint64(62)), np.uint64(0))
        high = np.where(bit >= 63, one << (np.maximum(bit, np.uint64(63)) - np.uint64(63)), np.uint64(0))
        self.low = np.bitwise_xor.reduceat(low, starts).astype(np.int64) if len(parts) else np.zeros(0, np.int64)
        self.high = np.bitwise_xor.reduceat(high, starts).astype(np.int64) if len(parts) else np.zeros(0, np.int64)
        pair = (words[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (words[1:] + np.uint64(0x632BE59BD9B4E019))
        pair ^= pair >> np.uint64(29)
        inside = text[:-1] == text[1:]
        self.hash, self.text, self.place = pair[inside], text[:-1][inside], place[:-1][inside]


def rarity_table(evaluation: DataFrame, buckets: int) -> np.ndarray:
    """How often the terms of each hashed bucket occur in the evaluation texts; exactly ``buckets`` counters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount((Terms(b.column(0).to_pylist()).hash % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    got = evaluation.select("words").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(buckets, np.uint32)
    table[got.column("bucket").to_numpy()] = np.minimum(got.column("n").to_numpy(), 2**32 - 1)
    return table


_CACHE_WORDS, SIGNATURE_BITS = 200_000, 126


def listed_terms(n: np.ndarray, share: float) -> np.ndarray:
    """How many terms of texts of n words are listed, so that one that any partner within its budget keeps is among them.

    The budget d of a pair is that of its longer text. The shorter one, by g words, loses up to 2 d - g terms: more than its own budget
    tells only if d steps up within one word, since a larger gap outweighs further steps (shares up to a half).
    """
    return 2 * np.floor((n + 1) * share + 1e-9).astype(np.int64) + 1


def squared_weights(rarity: np.ndarray) -> np.ndarray:
    """The squared weight of terms by how often they occur in the evaluation texts."""
    return 1.0 / np.log2(2.0 + rarity) ** 2


def _bounds(text: np.ndarray, weight: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """For each text (terms in order of text): its squared norm less its ``lost`` largest squared weights."""
    order = np.lexsort((-weight, text))
    t, w = text[order], weight[order]
    rank = np.arange(len(t)) - np.searchsorted(t, t)
    return np.bincount(t, np.where(rank < lost[t], 0.0, w), len(lost))


def dot_products(a: Terms, b: Terms, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The exact dot product of each text of ``a`` with that of ``b`` at the same place, and the weights of either side's terms."""
    buckets = np.uint64(len(rarity))
    wa, wb = (squared_weights(rarity[x.hash % buckets].astype(np.float64)) for x in (a, b))

    def numbered(x: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # equal terms of one text are told apart by their number, so that each meets one of the other side
        order = np.lexsort((x.place, x.hash, x.text))
        t, h = x.text[order], x.hash[order]
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(t)), 0))
        return order, t, (h + (np.arange(len(t)) - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (t.astype(np.uint64) << np.uint64(40))

    oa, ta, ka = numbered(a)
    _, _, kb = numbered(b)
    shared = np.isin(ka, kb)
    return np.bincount(ta[shared], wa[oa][shared], len(a.n)), wa, wb


def near_classes(members: DataFrame, *, share: float = SHARE, buckets: int = 1 << 21, hot: int = 5000) -> DataFrame:
    """``a1, a2, b1, b2, distance``: links from evaluation classes (a) to different train classes (b), rows distinct."""
    spark = members.sparkSession
    ship_package(spark)
    long = members.where("words is not null")
    grouped = long.groupBy("w1", "w2").agg(F.first("n").alias("n"), F.first("words").alias("words"), F.max(F.col("split") == "train").alias("in_train"), F.max(F.col("split") != "train").alias("in_eval"))
    classes = cut(grouped.withColumn("c", F.monotonically_increasing_id()), "classes")
    table = spark.sparkContext.broadcast(rarity_table(classes.where("in_eval"), buckets))

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = table.value
        for b in batches:
            t = Terms(b.column(2).to_pylist())
            rare = rarity[t.hash % np.uint64(buckets)]
            order = np.lexsort((t.place, t.hash, rare, t.text))
            text = t.text[order]
            rank = np.arange(len(text)) - np.searchsorted(text, text)
            listed = b.column(4).to_numpy(zero_copy_only=False)
            first = order[rank < listed_terms(t.n[text], share)]
            first = first[(rare[first] > 0) | listed[t.text[first]]]
            at = t.text[first]
            rows = pa.array(at, pa.int64())
            own = [b.column(c).take(rows) for c in (0, 1, 3, 4)]
            made = [pa.array(t.hash[first].astype(np.int64)), pa.array(t.place[first], pa.int32()), pa.array(t.low[at]), pa.array(t.high[at]), pa.array(1 + rare[first] // hot, pa.int32())]
            yield pa.RecordBatch.from_arrays([*own, *made], names=["c", "n", "in_train", "in_eval", "key", "place", "low", "high", "salts"])

    lists = cut(classes.select("c", "n", "words", "in_train", "in_eval").mapInArrow(listing, "c bigint, n int, in_train boolean, in_eval boolean, key bigint, place int, low bigint, high bigint, salts int"), "lists")
    fields = ("c", "n", "place", "low", "high")
    # only a hot term has more than one salt: an evaluation entry takes one of them, a train entry all
    one, every = F.pmod(F.xxhash64("c"), F.col("salts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    a, b = (lists.where(side).select("key", salt.alias("salt"), *[F.col(x).alias(f"{p}_{x}") for x in fields]) for p, side, salt in (("a", "in_eval", one), ("b", "in_train", every)))
    budget = F.floor(F.greatest("a_n", "b_n") * F.lit(share) + F.lit(1e-9))
    gap = F.abs(F.col("a_n") - F.col("b_n"))
    flips = F.bit_count(F.col("a_low").bitwiseXOR(F.col("b_low"))) + F.bit_count(F.col("a_high").bitwiseXOR(F.col("b_high")))
    near = (gap <= budget) & (F.abs(F.col("a_place") - F.col("b_place")) <= budget) & (flips <= 2 * budget - gap) & (F.col("a_c") != F.col("b_c"))
    pairs = a.join(b, ["key", "salt"]).where(near).select("a_c", "b_c").distinct()
    texts = classes.select("c", "w1", "w2", "words")
    for p in "ab":
        pairs = pairs.join(texts.select(*[F.col(x).alias(f"{p}_{x}") for x in texts.columns]), f"{p}_c")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = table.value
        for batch in batches:
            left, right = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            a, b = Terms(left), Terms(right)
            most = np.floor(np.maximum(a.n, b.n) * share + 1e-9).astype(np.int64)
            dot, wa, wb = dot_products(a, b, rarity)
            least = np.maximum(_bounds(a.text, wa, 2 * most), _bounds(b.text, wb, 2 * most))
            got: list[int | None] = [None] * len(left)
            for i in np.flatnonzero(dot >= least - 1e-9).tolist():
                d = word_distance(left[i].split(" "), right[i].split(" "), int(most[i]))
                if d <= most[i]:
                    got[i] = d
            keep = pa.array([g is not None for g in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in range(4)), pa.array([g for g in got if g is not None], pa.int32())], names=["a1", "a2", "b1", "b2", "distance"])

    return pairs.select(*[F.col(f"{p}_w{k}").alias(f"{p}{k}") for p in "ab" for k in (1, 2)], "a_words", "b_words").mapInArrow(verify, "a1 bigint, a2 bigint, b1 bigint, b2 bigint, distance int")


def _met(e: DataFrame, t: DataFrame, keys: list[str], *, hot: int) -> DataFrame:
    """The evaluation rows ``e`` with the train rows ``t`` of equal ``keys``.

    A key with more than ``hot`` train rows is salted: its train rows are spread, its evaluation rows stand with each part. The sizes are
    counted first, combined where the rows are; keys below have no salt, and nothing of theirs is repeated.
    """
    sizes = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select(*keys, F.ceil(F.col("_n") / F.lit(hot)).cast("int").alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    one = F.pmod(F.xxhash64("train_id"), salts).cast("int")
    left = e.join(sizes, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    right = t.join(sizes, keys, "left").withColumn("_salt", one).drop("_salts")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def overlapping_pairs(samples: DataFrame, *, share: float = SHARE, min_words: int = MIN_WORDS, hot: int = 100_000, **columns: str) -> DataFrame:
    """``eval_id, train_id, distance`` of all overlapping pairs; distance is 0 for the same record."""
    members = overlap_members(samples, min_words=min_words, **columns)
    links = cut(near_classes(members, share=share), "links")
    e, t = members.where("split <> 'train'"), members.where("split = 'train'")

    def side(rows: DataFrame, p: str, *kept: str) -> DataFrame:
        return rows.select(F.col("id").alias(f"{p}_id"), *kept).distinct()

    same = _met(side(e, "eval", "r1", "r2"), side(t, "train", "r1", "r2"), ["r1", "r2"], hot=hot).select("eval_id", "train_id", F.lit(0).alias("distance"))
    # equal words, of which one is a set of fields and the other running text
    long_e, long_t = e.where("words is not null"), t.where("words is not null")
    equal = (
        _met(side(long_e, "eval", "w1", "w2", F.col("r1").alias("e1")), side(long_t, "train", "w1", "w2", F.col("r1").alias("t1")), ["w1", "w2"], hot=hot)
        .where("e1 <> t1")
        .select("eval_id", "train_id", F.lit(0).alias("distance"))
    )
    # the linked classes are few: the members are met class by class, the links first
    met = links.join(side(long_e, "eval", F.col("w1").alias("a1"), F.col("w2").alias("a2")), ["a1", "a2"])
    near = _met(met.select("eval_id", "b1", "b2", "distance"), side(long_t, "train", F.col("w1").alias("b1"), F.col("w2").alias("b2")), ["b1", "b2"], hot=hot).select("eval_id", "train_id", "distance")
    return same.unionByName(equal).unionByName(near).groupBy("eval_id", "train_id").agg(F.min("distance").alias("distance"))


def overlap_counts(samples: DataFrame, *, source: str = "source_id", share: float = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """Per evaluation split and source (in form, trimmed, lower case): samples, samples that overlap with train, their pairs.

    Pairs are counted, not spelt out: a sample's pairs are the train samples of its record, and those of near word classes with another
    record. Groups of copies are rows with a number from the first aggregation on. Samples without words count as samples.
    """
    known = samples.select("sample_id", "split_assignment", "canonical_target", F.col(source).alias("source_id")).where("sample_id is not null")
    clean = normalise_column(known, "source_id", "_form", "_kinds").withColumn("_source", F.coalesce(F.lower(F.regexp_replace("_form", r"^\s+|\s+$", "")), F.lit("")))
    members = overlap_members(clean, carried="_source", min_words=min_words)
    links = cut(near_classes(members, share=share), "links")
    once = members.select("id", "split", "carried", *_CLASSES, F.col("words").isNotNull().alias("long")).distinct()
    classes = cut(once.groupBy("split", "carried", *_CLASSES, "long").agg(F.count(F.lit(1)).alias("k")), "classes")
    train, evaluation = classes.where("split = 'train'"), classes.where("split <> 'train'")
    same = train.groupBy("r1", "r2").agg(F.sum("k").alias("same"))
    listed = train.where("long").groupBy(*_CLASSES).agg(F.sum("k").alias("k")).select(F.col("r1").alias("t1"), F.col("r2").alias("t2"), F.col("w1").alias("b1"), F.col("w2").alias("b2"), "k")
    own = evaluation.where("long").select(*_CLASSES).distinct()
    alike = own.select(F.col("w1").alias("a1"), F.col("w2").alias("a2"), F.col("w1").alias("b1"), F.col("w2").alias("b2")).distinct()
    reach = links.select("a1", "a2", "b1", "b2").unionByName(alike)
    met = own.join(reach, (F.col("w1") == F.col("a1")) & (F.col("w2") == F.col("a2"))).join(listed, ["b1", "b2"]).where("r1 <> t1 or r2 <> t2")
    near = met.groupBy(*_CLASSES).agg(F.sum("k").alias("near"))
    counted = evaluation.join(same, ["r1", "r2"], "left").join(near, list(_CLASSES), "left")
    counted = counted.select("split", F.col("carried").alias("source_id"), "k", F.coalesce("same", F.lit(0)).alias("same"), F.coalesce("near", F.lit(0)).alias("near"))
    found = counted.groupBy("split", "source_id").agg(
        F.sum(F.when(F.col("same") + F.col("near") > 0, F.col("k")).otherwise(0)).alias("leaked"), F.sum(F.col("k") * (F.col("same") + F.col("near"))).alias("pairs"), F.sum(F.col("k") * F.col("same")).alias("same_record_pairs")
    )
    named = clean.select("sample_id", split_name(F.col("split_assignment")).alias("split"), F.col("_source").alias("source_id")).where("split in ('validation', 'test')").distinct()
    totals = named.groupBy("split", "source_id").agg(F.count_distinct("sample_id").alias("samples"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("leaked", "pairs", "same_record_pairs")]
    return totals.join(found, ["split", "source_id"], "left").select("split", "source_id", "samples", *zero)
