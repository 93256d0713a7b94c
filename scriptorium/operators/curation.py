"""Curation: duplicates, leakage screens, quality gates, holdouts, mixtures by class, weighted scores, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind, strip, unescaped_dollars


def first_by_key(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of every non-null key (rows without key all stay): an aggregate, so copies combine before the shuffle."""
    names = rows.columns
    keyed = rows.withColumn("_key", key)
    best = keyed.where("_key is not null").groupBy("_key").agg(F.min_by(F.struct(*names), F.struct(*order)).alias("r")).select("r.*")
    return best.unionByName(keyed.where("_key is null").drop("_key"))


def exact_duplicates(rows: DataFrame, text: Column, id_column: str) -> DataFrame:
    """``first_id, copies`` for each normalised text that several rows share."""
    keyed = rows.select(F.sha2(text, 256).alias("h"), F.col(id_column).alias("id")).where("h is not null")
    return keyed.groupBy("h").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("first_id", "copies")


def word_key(text: Column) -> Column:
    """A text's letters, marks and digits of any script, lower case, with one blank between words; null for wordless texts."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " ")), F.lit(""))


def document_identity(title: Column, identifier: Column, url: Column) -> Column:
    """The strongest of a document's identities: its identifier, else its title's letters, else its address without scheme and query."""
    ident = F.lower(F.regexp_replace(identifier, r"(?i)^(?:https?://)?(?:dx\.)?(?:doi\.org/|arxiv\.org/abs/)|^(?:doi|arxiv|pmc):?|v\d+$", ""))
    name = F.lower(F.regexp_replace(title, r"[^\p{L}\p{N}]+", " "))
    address = F.regexp_replace(F.regexp_replace(F.lower(url), r"^https?://(?:www\.)?", ""), r"/*(?:[?#].*)?$", "")
    return F.coalesce(F.when(ident != "", F.concat(F.lit("id:"), ident)), F.when(F.length(F.trim(name)) >= 12, F.concat(F.lit("title:"), F.trim(name))), F.when(address != "", F.concat(F.lit("url:"), address)))


def formula_hash(c: Column) -> Column:
    from ..functions.text import normalize_latex

    return F.sha2(normalize_latex(c), 256)


def table_topology(c: Column) -> Column:
    """Hash of a table's shape: the numbers of cells of its rows, whatever they hold."""
    rows = F.filter(F.split(c, "\n"), lambda x: F.startswith(F.trim(x), F.lit("|")))
    return F.when(F.size(rows) > 0, F.sha2(F.array_join(F.transform(rows, lambda r: (F.length(r) - F.length(F.replace(r, F.lit("|"), F.lit("")))).cast("string")), ","), 256))


def shingles(c: Column, n: int) -> Column:
    """Distinct runs of n words (letters and digits, lower case) as hashes; shorter texts are one run."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def runs(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, n), " ")))
        return F.when(F.size(w) > 0, F.array_distinct(hashed))

    return bind(words, runs)


def quality_gates(c: Column) -> dict[str, Column]:
    """One boolean per gate that needs only the text."""
    t = F.coalesce(c, F.lit(""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    return {
        "gate_not_empty": F.length(F.trim(t)) > 0,
        "gate_letters": letters * 4 >= F.length(t),
        "gate_fences": (F.length(t) - F.length(F.replace(t, F.lit("```"), F.lit("")))) % 6 == 0,
        "gate_math": unescaped_dollars(t) % 2 == 0,
        "gate_encoding": ~F.contains(t, F.lit("�")),
        "gate_length": F.length(t) <= 200_000,
    }


def leakage_checks(rows: DataFrame, held: DataFrame, *, id_column: str, family: str, text: str, words: int = 8, share: float = 0.8) -> DataFrame:
    """``id, checks, action`` for every row: which of five checks against held-out rows it fails, and what follows.

    ``identifier``: its family is a held-out one; ``title``: its heading is; ``target``: its words are; ``near_target``: at least ``share`` of its runs of
    ``words`` words stand in held-out texts; ``family``: another row of its family failed one of the three before. Held-out sides are distinct values and
    hashes, met by equality. The strongest check decides: identifiers and targets exclude, titles and near targets are held for review, families are demoted.
    """
    heading = F.substring_index(F.ltrim(F.col(text)), "\n", 1)
    title = F.when(F.startswith(heading, F.lit("#")), word_key(heading))

    def keyed(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_column).alias("id"), F.col(family).alias("fam"), F.xxhash64(title).alias("t"), title.isNotNull().alias("has_t"), F.xxhash64(word_key(F.col(text))).alias("k"), word_key(F.col(text)).isNotNull().alias("has_k"), shingles(F.col(text), words).alias("sh"))

    own, other = keyed(rows), keyed(held)
    seen = F.lit(True)
    known = {
        "identifier": (other.where("fam is not null").select("fam").distinct(), "fam", F.lit(True)),
        "title": (other.where("has_t").select("t").distinct(), "t", F.col("has_t")),
        "target": (other.where("has_k").select("k").distinct(), "k", F.col("has_k")),
    }
    made = own
    for name, (values, key, there) in known.items():
        made = made.join(values.withColumn(f"_{name}", seen), key, "left").withColumn(name, F.coalesce(f"_{name}", F.lit(False)) & there).drop(f"_{name}")
    runs = other.select(F.explode("sh").alias("s")).distinct()
    met = own.select("id", F.explode("sh").alias("s")).distinct().join(runs, "s", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("met"))
    made = made.join(met, "id", "left").withColumn("near_target", F.coalesce(F.col("met") >= F.size("sh") * F.lit(share), F.lit(False)) & F.col("sh").isNotNull())
    failed = made.where("fam is not null").groupBy("fam").agg(F.count_if(F.col("title") | F.col("target") | F.col("near_target")).alias("failed"))
    made = made.join(failed, "fam", "left").withColumn("family", F.coalesce(F.col("failed") - F.when(F.col("title") | F.col("target") | F.col("near_target"), 1).otherwise(0), F.lit(0)) > 0)
    names = ("identifier", "title", "target", "near_target", "family")
    action = F.when(F.col("identifier") | F.col("target"), "exclude").when(F.col("title") | F.col("near_target"), "hold_for_review").when(F.col("family"), "keep_but_demote").otherwise("keep")
    return made.select("id", F.array_compact(F.array(*[F.when(F.col(n), n) for n in names])).alias("checks"), action.alias("action"))


def sample_gates(known_source: Column, action: Column) -> dict[str, Column]:
    """One boolean per gate over the columns of a sample: source and lineage, target, Markdown, LaTeX, picture, length, difficulty, leakage."""
    t = F.coalesce(F.col("canonical_target"), F.lit(""))
    page = F.regexp_replace("page_id", r"(?s):[^:]*$", "")
    structured = F.coalesce(F.col("has_display_math") | F.col("has_gfm_table"), F.lit(False))

    def pieces(piece: str) -> Column:
        return F.length(t) - F.length(F.replace(t, F.lit(piece), F.lit("")))

    return {
        "source": known_source & (F.col("page_id").isNull() | F.col("doc_id").isNull() | (page == F.col("doc_id"))),
        "target": (strip(t) != "") & F.col("target_type").isNotNull(),
        "markdown": pieces("```") % 6 == 0,
        "latex": (unescaped_dollars(t) % 2 == 0) & (pieces("{") == pieces("}")),
        "picture": F.col("page_id").isNull() | F.coalesce(F.exists("asset_media_types", lambda m: F.startswith(m, F.lit("image/"))), F.lit(False)),
        "length": F.coalesce((F.col("target_char_count") == F.length(t)) & F.col("target_char_count").between(1, 200_000), F.lit(False)),
        "difficulty": F.col("difficulty_tier").isNotNull() & (~structured | (F.size(F.coalesce("slice_tags", F.array().cast("array<string>"))) > 0)),
        "leakage": F.coalesce(action, F.lit("keep")).isin("keep", "keep_but_demote"),
    }


def reject_reasons(gates: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~g, name) for name, g in gates.items()]))


def promotion(reasons: Column, data_class: Column) -> Column:
    return F.when(F.size(reasons) > 1, "reject").when(F.size(reasons) == 1, "hold").when(data_class == "exact_pair", "gold_exact").when(data_class.isin("synthetic_exact", "multilingual"), "silver_exact").otherwise("aux")


def torn_families(rows: DataFrame, family: str, split: str) -> DataFrame:
    """Families whose rows stand in several splits, with the splits."""
    return rows.where(F.col(split).isNotNull() & F.col(family).isNotNull()).groupBy(family).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits")).where(F.contains("splits", F.lit(",")))


def without_holdout(rows: DataFrame, holdout: DataFrame, key: str) -> DataFrame:
    return rows.join(holdout.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def first_by_hash(rows: DataFrame, *, by: str, id_column: str, quota: Column) -> DataFrame:
    """The rows of each class with the smallest hashes, as many as its quota, with their number ``_k`` from 1; exact, without a window over a class.

    Hashes fall into 65,536 ranges. Their sizes per class, summed up, tell the ranges that are needed; only rows of those move, and
    a task ranks the rows of one range.
    """
    h = F.sha2(F.col(id_column).cast("string"), 256)
    hashed = rows.withColumns({"_h": h, "_range": F.substring(h, 1, 4)})
    sizes = hashed.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(by).orderBy("_range")) - F.col("_n")).drop("_n")
    near = hashed.join(before, [by, "_range"]).where(F.col("_before") < quota)
    inside = F.row_number().over(Window.partitionBy(by, "_range").orderBy("_h", id_column))
    return near.withColumn("_k", F.col("_before") + inside).where(F.col("_k") <= quota).drop("_h", "_range", "_before")


def class_sample(rows: DataFrame, shares: DataFrame, *, by: str, id_column: str, total: int) -> DataFrame:
    """The rows of each class with the smallest hashes, up to its share of ``total``."""
    return first_by_hash(rows.join(shares, by), by=by, id_column=id_column, quota=F.floor(F.col("share") * total)).drop("_k")


def anchor_draws(rows: DataFrame, *, anchor: Column, id_column: str, draws: int, anchor_share: float) -> DataFrame:
    """Draws with replacement: each side's rows in hashed order, repeated until its part of the draws is full."""
    sides = rows.withColumn("side", F.when(anchor, "anchor").otherwise("primary"))
    # no side needs more rows than there are draws
    numbered = first_by_hash(sides, by="side", id_column=id_column, quota=F.lit(int(draws))).withColumn("_n", F.col("_k") - 1)
    sizes = sides.groupBy("side").agg(F.count(F.lit(1)).alias("_size"))
    part = F.when(F.col("side") == "anchor", F.lit(int(draws * anchor_share))).otherwise(F.lit(draws - int(draws * anchor_share)))
    times = F.ceil((part - F.col("_n")) / F.col("_size")).cast("int")
    return numbered.join(sizes, "side").withColumn("_times", times).where("_times > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("side", id_column, "draw")


def weighted_score(parts: dict[str, float]) -> Column:
    """Weighted sum of dimensions; a missing one leaves the score missing."""
    return reduce(lambda a, b: a + b, (F.col(c) * F.lit(w) for c, w in parts.items()))


def by_grade(rows: DataFrame, grade: str, value: str) -> DataFrame:
    """Averages per evidence grade: values of different grades are never averaged together."""
    return rows.groupBy(grade).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count and order-free checksum of a table, to compare what was published with what was built."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*columns)).alias("checksum"))


def slice_rollup(rows: DataFrame, *by: str) -> DataFrame:
    return rows.rollup(*by).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))

