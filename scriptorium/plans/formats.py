"""Queries of the source formats: documents written from the order tables in each format and read as Markdown, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions.text import chart_block
from ..shared import table


def _text(*parts: Column | str) -> Column:
    """Literals and values as one text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """``l_orderkey, items``: the lines of every order in order of their numbers."""
    item = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("quantity"), F.concat("l_returnflag", "l_linestatus").alias("flag")).alias("i"))
    return item.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("i")).alias("items"))


def _each(make: Callable[[Column], Column], between: str = "") -> Column:
    return F.array_join(F.transform("items", make), between)


def _read(rows: DataFrame, key: str, source: Column, read: Callable) -> DataFrame:
    return rows.select(key, source.alias("source")).select(key, read(F.col("source")).alias("markdown"))


def voc_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """An object per line of the order; the first one has no name."""

    def item(i: Column) -> Column:
        name = F.when(i["l_linenumber"] > 1, _text("<name>", i["flag"], "</name>")).otherwise("")
        box = [_text(f"<{k}>", v, f"</{k}>") for k, v in (("xmin", i["l_linenumber"]), ("ymin", i["quantity"]), ("xmax", i["l_linenumber"] + i["quantity"]), ("ymax", i["l_partkey"]))]
        return _text("<object>", name, "<bndbox>", *box, "</bndbox></object>")

    return _read(_orders(spark, d), "l_orderkey", _text("<annotation>", _each(item), "</annotation>"), M.voc_markdown)


def pagexml_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """A region per line of the order: its flag, and its quantity as a second text line."""

    def item(i: Column) -> Column:
        line = [_text("<TextLine><TextEquiv><Unicode>", t, "</Unicode></TextEquiv></TextLine>") for t in (_text("flag ", i["flag"]), _text(i["quantity"], "  pieces "))]
        return _text("<TextRegion>", *line, "</TextRegion>")

    return _read(_orders(spark, d), "l_orderkey", _text("<PcGts><Page>", _each(item), "</Page></PcGts>"), M.pagexml_markdown)


def jats_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Customers as articles: a section with text, a formula and a table of all orders."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("items"))
    rows = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    text = _each(lambda i: _text("<p>Order <bold>", i["o_orderkey"], "</bold> is <inline-formula><tex-math>s_{", i["o_orderstatus"], "}</tex-math></inline-formula>.</p>"))
    lines = _each(lambda i: _text("<tr><td>", i["o_orderkey"], "</td><td>", i["o_orderpriority"], "</td></tr>"))
    source = _text(
        "<article><front><article-title>", F.col("c_name"), "</article-title><abstract><p>Of ", F.col("c_mktsegment"), ".</p></abstract></front><body><sec><title>Orders</title>",
        text, "<table-wrap><caption><p>All orders</p></caption><table><tr><th>key</th><th>priority</th></tr>", lines, "</table></table-wrap></sec></body></article>",
    )
    return _read(rows, "c_custkey", source, M.jats_markdown)


def tex_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Orders as papers: a section with a formula for every line, and a table of all."""
    sections = _each(lambda i: _text("\\section{Part ", i["l_partkey"], "}Flag \\textbf{", i["flag"], "} and $q_{", i["l_linenumber"], "}$. % not seen\n\\[\nq_{", i["l_linenumber"], "}=", i["quantity"], "\n\\]\n"))
    lines = _each(lambda i: _text(i["l_partkey"], " & ", i["quantity"], " \\\\ "))
    source = _text("\\documentclass{article}\\begin{document}\\title{Order ", F.col("l_orderkey"), "}", sections, "\\begin{table}\\caption{Lines}\\begin{tabular}{lr}part & pieces \\\\ \\hline ", lines, "\\end{tabular}\\end{table}\\end{document}")
    return _read(_orders(spark, d), "l_orderkey", source, M.tex_markdown)


def plotqa_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Orders as charts: quantities, flags and boxes."""
    box = _each(lambda i: _text("<s_x>", i["l_linenumber"], "</s_x><s_y>", i["quantity"], "</s_y><s_w> 4 </s_w>"), "<sep/>")
    source = _text("<s_pieces>", _each(lambda i: i["quantity"].cast("string"), "<sep/>"), "</s_pieces><s_flag>", _each(lambda i: i["flag"], " <sep/>"), "</s_flag><s_bboxes>", box, "</s_bboxes>")
    return _read(_orders(spark, d), "l_orderkey", source, chart_block)


def funsd_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Orders as forms: a word and a tag for every line."""
    source = F.to_json(F.struct(F.transform("items", lambda i: _text(i["flag"], i["quantity"])).alias("words"), F.transform("items", lambda i: i["l_linenumber"] % 7).alias("ner_tags")))
    return _read(_orders(spark, d), "l_orderkey", source, M.form_markdown)


def cord_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Orders as receipts: nested fields, and words in groups."""
    menu = F.transform("items", lambda i: F.struct(_text("part ", i["l_partkey"]).alias("nm"), i["quantity"].cast("string").alias("cnt")))
    lines = F.transform("items", lambda i: F.struct((i["l_linenumber"] % 2).alias("group_id"), F.array(F.struct(i["flag"].alias("text")), F.struct(i["quantity"].cast("string").alias("text"))).alias("words")))
    source = F.to_json(F.struct(F.struct(F.struct(F.size("items").cast("string").alias("lines")).alias("total"), menu.alias("menu")).alias("gt_parse"), lines.alias("valid_line")))
    return _read(_orders(spark, d), "l_orderkey", source, M.receipt_markdown)


def fintabnet_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tables of cells in one flat list, each cell a list of characters."""
    head = F.array(F.lit("part"), F.lit("pieces"), F.lit("flag"))
    flat = F.concat(head, F.flatten(F.transform("items", lambda i: F.array(i["l_partkey"].cast("string"), i["quantity"].cast("string"), i["flag"]))))
    cells = F.array(F.transform(flat, lambda c: F.struct(F.split(c, "(?!^)").alias("tokens"))))
    source = F.to_json(F.struct(_text("order ", F.col("l_orderkey")).alias("filename"), F.lit(3).alias("cols"), cells.alias("cells")))
    return _read(_orders(spark, d), "l_orderkey", source, M.table_markdown)


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """Nested event properties as field lists."""
    e = table(spark, d, "events").where("props is not null")
    return e.select("event_id", M.fields_markdown("props").alias("markdown"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (tex_to_markdown, jats_to_markdown, pagexml_to_markdown, voc_to_markdown, plotqa_to_markdown, funsd_to_markdown, cord_to_markdown, fintabnet_to_markdown, json_fields)
}

_I = "i AS (SELECT l_orderkey, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS INT) AS q, l_returnflag || l_linestatus AS f FROM lineitem)"
_BY = "ORDER BY n, p, s, q, f"
_NL = "chr(10)"
_2 = "chr(10) || chr(10)"


def _runs(label: str, text: str, apart: str) -> str:
    """Neighbours of one label as one row; ``apart`` says which rows only part others."""
    return f"""{_I}, w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey {_BY}) AS k, {label} AS label, {text} AS t FROM i), c AS (SELECT *, CASE WHEN lag(label) OVER o IS DISTINCT FROM label THEN 1 ELSE 0 END AS new FROM w WINDOW o AS (PARTITION BY l_orderkey ORDER BY k)),
 g AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY k) AS run FROM c), r AS (SELECT l_orderkey, run, any_value(label) AS label, string_agg(t, ' ' ORDER BY k) AS t FROM g WHERE NOT ({apart}) GROUP BY 1, 2)"""


SQL: dict[str, str] = {
    "json_fields": f"SELECT event_id, '## Fields' || {_NL} || (SELECT string_agg('- ' || k || ': ' || json_extract_string(props, '$.' || k), {_NL}) FROM (SELECT unnest(json_keys(props)) AS k)) AS markdown FROM events WHERE props IS NOT NULL",
    "voc_to_markdown": f"WITH {_I} SELECT l_orderkey, '## Table Regions' || {_NL} || string_agg(format('- {{}}: xmin={{}}, ymin={{}}, xmax={{}}, ymax={{}}', CASE WHEN n > 1 THEN f ELSE 'region' END, n, q, n + q, p), {_NL} {_BY}) AS markdown FROM i GROUP BY 1",
    "pagexml_to_markdown": f"WITH {_I} SELECT l_orderkey, string_agg('flag ' || f || {_NL} || q || ' pieces', {_2} {_BY}) AS markdown FROM i GROUP BY 1",
    "jats_to_markdown": f"""SELECT c_custkey, '# ' || any_value(c_name) || {_2} || '## Abstract' || {_2} || 'Of ' || any_value(c_mktsegment) || '.' || {_2} || '## Orders' || {_2}
 || string_agg('Order ' || o_orderkey || ' is $s_{{' || o_orderstatus || '}}$.', {_2} ORDER BY o_orderkey) || {_2} || 'Table: All orders' || {_2} || '| key | priority |' || {_NL} || '| :--- | :--- |' || {_NL}
 || string_agg('| ' || o_orderkey || ' | ' || o_orderpriority || ' |', {_NL} ORDER BY o_orderkey) AS markdown FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1""",
    "tex_to_markdown": f"""WITH {_I} SELECT l_orderkey, '# Order ' || l_orderkey || {_2} || string_agg('## Part ' || p || {_2} || 'Flag ' || f || ' and $q_{{' || n || '}}$.' || {_2} || '$$' || {_NL} || 'q_{{' || n || '}}=' || q || {_NL} || '$$', {_2} {_BY})
 || {_2} || 'Table: Lines' || {_2} || '| part | pieces |' || {_NL} || '| :--- | :--- |' || {_NL} || string_agg('| ' || p || ' | ' || q || ' |', {_NL} {_BY}) AS markdown FROM i GROUP BY 1""",
    "plotqa_to_markdown": f"""WITH {_I} SELECT l_orderkey, '```chart' || {_NL} || 'pieces: ' || string_agg(q, ' | ' {_BY}) || {_NL} || 'flag: ' || string_agg(f, ' | ' {_BY}) || {_NL} || 'bboxes: ' || string_agg(format('(x={{}}, y={{}}, w= 4, h=)', n, q), ' | ' {_BY}) || {_NL} || '```' AS markdown FROM i GROUP BY 1""",
    "funsd_to_markdown": f"""WITH {_runs("CASE n % 7 WHEN 0 THEN 'other' WHEN 1 THEN 'header' WHEN 2 THEN 'header' WHEN 3 THEN 'question' WHEN 4 THEN 'question' ELSE 'answer' END", "f || q", "label = 'other'")}
 SELECT l_orderkey, coalesce(m, '') AS markdown FROM (SELECT DISTINCT l_orderkey FROM i) LEFT JOIN (SELECT l_orderkey, '## Form Fields' || {_NL} || string_agg('- ' || label || ': ' || t, {_NL} ORDER BY run) AS m FROM r GROUP BY 1) USING (l_orderkey)""",
    "cord_to_markdown": f"""WITH {_runs("n % 2", "f || ' ' || q", "false")}, o AS (SELECT l_orderkey, string_agg(t, {_NL} ORDER BY run) AS ocr FROM r GROUP BY 1)
 SELECT l_orderkey, '## Receipt Fields' || {_NL} || '- total.lines: ' || count(*) || {_NL} || string_agg(format('- menu[{{0}}].nm: part {{1}}', k - 1, p) || {_NL} || format('- menu[{{0}}].cnt: {{1}}', k - 1, q), {_NL} ORDER BY k) || {_2} || '## Receipt OCR' || {_NL} || any_value(ocr) AS markdown FROM w JOIN o USING (l_orderkey) GROUP BY 1""",
    "fintabnet_to_markdown": f"WITH {_I} SELECT l_orderkey, 'Table: order ' || l_orderkey || {_2} || '| part | pieces | flag |' || {_NL} || '| :--- | :--- | :--- |' || {_NL} || string_agg('| ' || p || ' | ' || q || ' | ' || f || ' |', {_NL} {_BY}) AS markdown FROM i GROUP BY 1",
}
