"""Queries of the archive and article sources: members and packages made from the tables, read as samples, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..sources import pairs as P
from ..shared import table
from .formats import _text


def _members(spark: SparkSession, d: str, *members: Callable[[Column, Column], tuple[Column, Column]]) -> DataFrame:
    """Members of one archive per nation, made from the customers: for each of ``members`` a name and a text (null: none)."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    made = [F.struct(name.alias("member"), text.cast("binary").alias("content")) for name, text in (m(F.col("c_custkey"), F.col("c_mktsegment")) for m in members)]
    rows = c.select(F.concat(F.lit("n"), "c_nationkey").alias("archive"), F.col("c_custkey").cast("int").alias("key"), F.posexplode(F.array(*made)).alias("k", "m"))
    return rows.where("m.content is not null").select("archive", (F.col("key") * 10 + F.col("k")).alias("pos"), "m.member", "m.content")


def archive_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pictures and targets of the same name in several archives: XML goes before text, an empty text is none."""
    members = _members(
        spark, d,
        lambda k, s: (_text("scans/c", k, ".jpg"), F.when(k % 5 != 0, F.lit("x"))),
        lambda k, s: (_text(F.when(k % 3 == 0, "gt/val/c").when(k % 3 == 1, "gt/test/c").otherwise("gt/c"), k, ".txt"), F.when(k % 7 == 0, F.lit(" ")).otherwise(_text("plain  ", s, " \n\n\n", k))),
        lambda k, s: (_text("gt/c", k, ".xml"), F.when(k % 2 == 0, _text("<P><TextRegion><TextLine><Unicode>", s, "</Unicode></TextLine></TextRegion></P>"))),
    )
    return P.archive_pairs(members, split_from_path=True)


def manifest_and_stems(spark: SparkSession, d: str) -> DataFrame:
    """Formulas by a manifest, then by name."""
    members = _members(
        spark, d,
        lambda k, s: (_text("images/f", k, ".png"), F.when(k % 4 != 0, F.lit("x"))),
        lambda k, s: (_text("labels/f", k, ".tex"), F.when(k % 3 != 0, _text(" x _ { ", k, " } "))),
    )
    c = table(spark, d, "customer").where("c_custkey % 2 = 0")
    listed = c.select(F.concat(F.lit("n"), "c_nationkey").alias("archive"), _text("images/f", F.col("c_custkey"), ".png").alias("image"), _text("y^{", F.col("c_custkey"), "}").alias("label"), F.lit(None).cast("string").alias("id"))
    return P.manifest_and_stems(members, listed)


def structure_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Table structures with the first picture of their name."""
    members = _members(
        spark, d,
        lambda k, s: (_text("T/structure/t", k, ".json"), _text('{"cells":  ', k, "}")),
        lambda k, s: (_text("T/img/t", k, ".png"), F.when(k % 3 != 1, F.lit("x"))),
        lambda k, s: (_text("T/img/t", k, ".jpg"), F.when(k % 3 == 2, F.lit("x"))),
        lambda k, s: (_text("T/img/t", k, ".gif"), F.lit("x")),
    )
    return P.structure_pairs(members)


def annotated_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of one archive with the pictures of another."""
    images = _members(spark, d, lambda k, s: (_text("img/p", k, ".jpg"), F.when(k % 3 != 0, F.lit("x"))))
    notes = _members(spark, d, lambda k, s: (_text("xml/p", k, ".xml"), F.when(k % 2 == 0, _text("<a><object><name>", s, "</name><bndbox><xmin>", k, "</xmin></bndbox></object></a>"))))
    return P.annotated_pairs(images, notes, M.voc_markdown)


def tex_articles(spark: SparkSession, d: str) -> DataFrame:
    """Orders as packages of TeX files: a row for every document, and for its one page."""
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("doc_id"), "o_orderkey", "o_orderpriority")
    main = _text("\\documentclass{article}\\begin{document}\\title{Order ", F.col("o_orderkey"), "}\\section{", F.col("o_orderpriority"), "}Body of the order.\\end{document}")
    files = o.select("doc_id", F.explode(F.array(F.struct(F.lit("a.tex").alias("path"), F.lit("\\section{Appendix}").alias("text")), F.struct(F.lit("z.tex").alias("path"), main.alias("text")))).alias("f")).select("doc_id", "f.*")
    pages = o.select("doc_id", F.array(_text("Order ", F.col("o_orderkey"))).alias("pages"))
    return P.article_samples(P.tex_articles(files), pages, source_id="tex")


def jats_articles(spark: SparkSession, d: str) -> DataFrame:
    """Orders as packages of XML and PDF; those without PDF are left out."""
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("doc_id"), "o_orderkey", "o_orderstatus")
    xml = _text("<article><front><article-title>Order ", F.col("o_orderkey"), "</article-title></front><body><sec><title>State</title><p>It is ", F.col("o_orderstatus"), ".</p></sec></body></article>")
    files = o.select("doc_id", F.explode(F.array_compact(F.array(F.struct(F.lit("a.nxml").alias("path"), xml.alias("text")), F.when(F.col("o_orderkey") % 4 != 0, F.struct(F.lit("a.pdf").alias("path"), F.lit("").alias("text")))))).alias("f")).select("doc_id", "f.*")
    pages = o.select("doc_id", F.array(F.lit("x")).alias("pages"))
    return P.article_samples(P.jats_articles(files), pages, source_id="jats", page_rows=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (archive_pairs, manifest_and_stems, structure_pairs, annotated_pairs, tex_articles, jats_articles)}

_C = "(SELECT c_custkey AS k, c_mktsegment AS s FROM customer)"
_NL = "chr(10)"
_DD = "chr(36) || chr(36)"
SQL: dict[str, str] = {
    "archive_pairs": f"""SELECT 'c' || k AS stem, 'scans/c' || k || '.jpg' AS image_member, m AS target_member, t AS canonical_target, CASE WHEN contains(m, '/val/') THEN 'validation' WHEN contains(m, '/test/') THEN 'test' ELSE 'train' END AS split_assignment
 FROM (SELECT k, CASE WHEN k % 2 = 0 THEN 'gt/c' || k || '.xml' ELSE CASE k % 3 WHEN 0 THEN 'gt/val/c' WHEN 1 THEN 'gt/test/c' ELSE 'gt/c' END || k || '.txt' END AS m, CASE WHEN k % 2 = 0 THEN s WHEN k % 7 = 0 THEN '' ELSE 'plain ' || s || {_NL} || {_NL} || k END AS t FROM {_C} WHERE k % 5 <> 0) WHERE t <> ''""",
    "manifest_and_stems": f"""SELECT 'f' || k AS sample_id, 'images/f' || k || '.png' AS image_member, CASE WHEN k % 2 = 0 THEN {_DD} || {_NL} || 'y^{{' || k || '}}' || {_NL} || {_DD} ELSE {_DD} || {_NL} || 'x_{{' || k || '}}' || {_NL} || {_DD} END AS canonical_target,
 CASE WHEN k % 2 = 0 THEN 'manifest' ELSE 'stem' END AS "by" FROM {_C} WHERE k % 4 <> 0 AND (k % 2 = 0 OR k % 3 <> 0)""",
    "structure_pairs": f"SELECT 't' || k AS stem, 'T/img/t' || k || CASE WHEN k % 3 = 2 THEN '.jpg' ELSE '.png' END AS image_member, '{{\"cells\": ' || k || '}}' AS canonical_target FROM {_C} WHERE k % 3 <> 1",
    "annotated_pairs": f"SELECT 'p' || k AS stem, 'img/p' || k || '.jpg' AS image_member, '## Table Regions' || {_NL} || '- ' || s || ': xmin=' || k AS canonical_target FROM {_C} WHERE k % 6 IN (2, 4)",
    "tex_articles": f"""WITH a AS (SELECT o_orderkey AS k, 'Order ' || o_orderkey || {_NL} || {_NL} || '## ' || o_orderpriority || {_NL} || {_NL} || 'Body of the order' AS t FROM orders)
 SELECT 'tex-o' || k || '-document' AS sample_id, 'o' || k AS doc_id, NULL AS page_id, 'document_markdown' AS target_type, '# ' || t || '.' AS canonical_target FROM a
 UNION ALL SELECT 'tex-o' || k || '-page-0001', 'o' || k, 'o' || k || ':1', 'page_markdown_projection', t FROM a""",
    "jats_articles": f"SELECT 'jats-o' || o_orderkey || '-document' AS sample_id, 'o' || o_orderkey AS doc_id, NULL AS page_id, 'document_markdown' AS target_type, '# Order ' || o_orderkey || {_NL} || {_NL} || '## State' || {_NL} || {_NL} || 'It is ' || o_orderstatus || '.' AS canonical_target FROM orders WHERE o_orderkey % 4 <> 0",
}
