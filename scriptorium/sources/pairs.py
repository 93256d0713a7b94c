"""Sources of which a sample is a pair of archive members, or a package of files: pictures with targets, structures, articles.

Members come as rows (archive, pos, member, content); contents are only joined for the members that were chosen, so that no
content is shuffled in order to be dropped. Limits keep the first samples in order of their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions.text import archive_stem, normalize_target, split_of_member, standalone_formula, strip
from ..operators.layout import main_file

IMAGES, TARGETS, LABELS = r"(?i)\.(png|jpe?g|tiff?|bmp|webp)$", r"(?i)\.(xml|txt|gt)$", r"(?i)\.(txt|tex|latex)$"


def text_target(member: Column, content: Column) -> Column:
    """The target that a member's bytes hold: PAGE XML by its suffix, else text."""
    t = F.decode(content, "UTF-8")
    return F.when(F.lower(member).rlike(r"\.xml$"), M.pagexml_markdown(F.when(F.lower(member).rlike(r"\.xml$"), t))).otherwise(normalize_target(t))


def page_rank(member: Column, *, page_dir: bool = False, xml: bool = False) -> Column:
    """Smaller is better: members in a page folder, then XML, where either is preferred."""
    low = F.lower(member)
    return F.struct(*[F.when(cond, 0).otherwise(1) if on else F.lit(0) for on, cond in ((page_dir, F.contains(low, F.lit("/page/"))), (xml, F.endswith(low, F.lit(".xml"))))])


def _limited(rows: DataFrame, order: str, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.orderBy(order).limit(limit)


def archive_pairs(members: DataFrame, *, page_dir: bool = False, split_from_path: bool = False, limit: int | None = None) -> DataFrame:
    """``stem, image_member, target_member, canonical_target, split_assignment``: the best picture and the best target of each stem, over all archives.

    Ranks decide, then the archive's and the member's place. Pairs without a target text are left out, and a stem without either side.
    """
    m, at = F.col("member"), F.struct("archive", "pos")
    named = members.select("archive", "pos", "member", archive_stem(m).alias("stem"))
    image = named.where(m.rlike(IMAGES)).groupBy("stem").agg(F.min_by("member", F.struct(page_rank(m, page_dir=page_dir), at)).alias("image_member"))
    target = named.where(m.rlike(TARGETS)).groupBy("stem").agg(F.min_by(F.struct("archive", "pos", "member"), F.struct(page_rank(m, page_dir=page_dir, xml=True), at)).alias("t"))
    chosen = image.join(target, "stem").select("stem", "image_member", F.col("t.archive").alias("archive"), F.col("t.pos").alias("pos"), F.col("t.member").alias("target_member"))
    read = chosen.join(members.select("archive", "pos", "content"), ["archive", "pos"])
    made = read.select("stem", "image_member", "target_member", text_target(F.col("target_member"), F.col("content")).alias("canonical_target"))
    split = split_of_member(F.col("target_member")) if split_from_path else F.lit("train")
    return _limited(made.where("canonical_target <> ''").withColumn("split_assignment", split), "stem", limit)


def manifest_and_stems(members: DataFrame, pairs: DataFrame, *, limit: int | None = None) -> DataFrame:
    """``sample_id, image_member, canonical_target, by``: formulas that manifests pair with pictures, then those that names pair and no manifest had.

    ``pairs`` (archive, image, label, id) are the manifests' rows; a picture that is not there leaves its row out. Of several pictures or labels of one name the last counts.
    """
    m = F.col("member")
    pictures = members.select("archive", F.col("member").alias("image_member"))
    own = F.coalesce("id", archive_stem(F.col("image")))
    listed = pairs.join(pictures, (pairs["archive"] == pictures["archive"]) & (pairs["image"] == pictures["image_member"])).select(own.alias("sample_id"), "image_member", "label", F.lit("manifest").alias("by"))
    stems = members.select("archive", "pos", "member", archive_stem(F.regexp_replace(m, r"(?i)\.(webp|tex|latex)$", ".txt")).alias("sample_id"))
    last = F.struct("archive", "pos")
    image = stems.where(m.rlike(IMAGES)).groupBy("sample_id").agg(F.max_by("member", last).alias("image_member"))
    label = stems.where(m.rlike(LABELS)).groupBy("sample_id").agg(F.max(F.struct("archive", "pos")).alias("l"))
    named = image.join(label, "sample_id").join(listed.select("sample_id"), "sample_id", "left_anti").select("sample_id", "image_member", "l.archive", "l.pos")
    read = named.join(members.select("archive", "pos", "content"), ["archive", "pos"]).select("sample_id", "image_member", strip(F.decode("content", "UTF-8")).alias("label"), F.lit("stem").alias("by"))
    made = listed.unionByName(read).where("label <> ''").select("sample_id", "image_member", standalone_formula(F.col("label")).alias("canonical_target"), "by")
    return made if limit is None else made.orderBy("by", "sample_id").limit(limit)


def structure_pairs(members: DataFrame, *, limit: int | None = None) -> DataFrame:
    """``stem, image_member, canonical_target``: table structures (structure/*.json) with the first picture (img/) of their name."""
    m = F.col("member")
    named = members.withColumn("stem", archive_stem(m))
    structure = named.where(m.rlike(r"(^|/)structure/[^/]+\.json$")).select("stem", "content")
    image = named.where(m.rlike(r"(^|/)img/[^/]+$") & m.rlike(r"(?i)\.(png|jpe?g)$")).groupBy("stem").agg(F.min("member").alias("image_member"))
    return _limited(structure.join(image, "stem").select("stem", "image_member", normalize_target(F.decode("content", "UTF-8")).alias("canonical_target")), "stem", limit)


def annotated_pairs(images: DataFrame, annotations: DataFrame, read: Callable[[Column], Column]) -> DataFrame:
    """``stem, image_member, canonical_target``: every annotation whose picture is there; pictures are names only, contents of annotations move."""
    pictures = images.select(archive_stem(F.col("member")).alias("stem"), "member").groupBy("stem").agg(F.max("member").alias("image_member"))
    return annotations.select(archive_stem(F.col("member")).alias("stem"), "content").join(pictures, "stem").select("stem", "image_member", read(F.decode("content", "UTF-8")).alias("canonical_target"))


def article_samples(markdown: DataFrame, pages: DataFrame, *, source_id: str, documents: bool = True, page_rows: bool = True, max_pages: int = 12, page_budget: int | None = None) -> DataFrame:
    """Samples of articles: a row per document, a row per page that has a target, or both; what nobody wants is not made.

    ``markdown`` has doc_id and canonical_target (articles without text are left out), ``pages`` doc_id and the texts of its pages in order. A page's target
    is the part of the document that stands on it; at most ``max_pages`` of a document and ``page_budget`` of all, in order of document and page, are taken.
    """
    known = markdown.where("canonical_target <> ''")
    none = F.lit(None).cast("string")
    parts = []
    if documents:
        parts.append(known.select(F.concat_ws("-", F.lit(source_id), "doc_id", F.lit("document")).alias("sample_id"), "doc_id", none.alias("page_id"), F.lit("document_markdown").alias("target_type"), "canonical_target"))
    if page_rows:
        cut = known.join(pages, "doc_id").select("doc_id", F.posexplode(M.projected_pages("canonical_target", F.slice("pages", 1, max_pages))).alias("i", "canonical_target")).where("canonical_target <> ''")
        cut = cut if page_budget is None else cut.orderBy("doc_id", "i").limit(page_budget)
        number = (F.col("i") + 1).cast("string")
        parts.append(
            cut.select(
                F.concat(F.lit(f"{source_id}-"), "doc_id", F.lit("-page-"), F.lpad(number, 4, "0")).alias("sample_id"), "doc_id", F.concat_ws(":", "doc_id", number).alias("page_id"), F.lit("page_markdown_projection").alias("target_type"), "canonical_target"
            )
        )
    if not parts:
        raise ValueError("neither documents nor pages are wanted")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def tex_articles(files: DataFrame) -> DataFrame:
    """``doc_id, canonical_target`` of packages of TeX files (doc_id, path, text): their main file as Markdown."""
    best = main_file(files, key="doc_id").select("doc_id", "path")
    return files.join(best, ["doc_id", "path"]).select("doc_id", M.tex_markdown("text").alias("canonical_target"))


def jats_articles(files: DataFrame) -> DataFrame:
    """``doc_id, canonical_target`` of packages (doc_id, path, text) that hold an XML and a PDF file: the first XML file as Markdown."""
    low = F.lower("path")
    both = files.groupBy("doc_id").agg(F.min(F.when(low.rlike(r"\.n?xml$"), F.col("path"))).alias("path"), F.bool_or(low.rlike(r"\.pdf$")).alias("pdf")).where("pdf and path is not null").select("doc_id", "path")
    return files.join(both, ["doc_id", "path"]).select("doc_id", M.jats_markdown("text").alias("canonical_target"))
