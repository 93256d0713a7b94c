"""Text functions against plain Python, and the readers on literal inputs."""

import json
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import markup as M
from scriptorium.functions import text as T
from scriptorium.functions.similarity import levenshtein_ratio, with_edit_similarity
from scriptorium.operators import pages as P

TEXTS = [
    "", " ", "a", "### Harbour tides\n\nfigure: the outer mole\n\n  | hour | level |\n  | --- | --- |\n  | six | low |  \n\nwith $h_0$ at noon\n\n```table\nrows: 3\n```", "a\r\nb\rc\n\n\n\nd  e\t f ", "```sh\n  ls  -a\n\n\nend", "#NoBlank\n##  Two  words  ", "* one\n+ two\n - three",
    "\\(a\\) and \\[b\\]", "a|b | c\n|x|", "$1 and \\$2 and $3", "$$a$$ $b$", "x y z", "tab\tin\n\t\tindent  x", "\n\n\nlead and trail\n\n", "\\\\$ x", "one $ two",
]


def column(spark, make, values=TEXTS):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("t"))).collect()]


def test_features(spark):
    f = T.target_features(F.col("t"))
    row = spark.createDataFrame([(TEXTS[3],)], "t string").select(*[c.alias(n) for n, c in f.items()]).first()
    assert all(row[k] for k in ("has_heading", "has_figure_caption", "has_gfm_table", "has_table_block", "has_inline_math"))
    assert not row["has_display_math"] and not row["has_list"] and row["target_char_count"] == len(TEXTS[3])


@pytest.mark.parametrize("pattern", [r"(?<!\$)\$(?!\$).+?(?<!\$)\$(?!\$)"])
def test_inline_math_is_two_lone_dollars(spark, pattern):
    got = column(spark, lambda c: T.target_features(c)["has_inline_math"])
    assert got == [bool(re.search(pattern, t, re.DOTALL)) for t in TEXTS]


def test_normalize_target_is_clean(spark):
    assert column(spark, T.normalize_target) == [M.clean(t) for t in TEXTS]


def test_nulls_stay_null(spark):
    for f in (T.normalize_target, T.normalize_markdown, T.normalize_latex, T.unescaped_dollars, T.chart_block, T.standalone_formula):
        assert column(spark, f, [None]) == [None]


def test_unescaped_dollars(spark):
    def plain(t):
        n, skip = 0, False
        for ch in t:
            if skip:
                skip = False
            elif ch == "\\":
                skip = True
            else:
                n += ch == "$"
        return n

    assert column(spark, T.unescaped_dollars) == [plain(t) for t in TEXTS]


def test_lines(spark):
    values = ["", "a", "a\n", "a\n\nb", "a\r\nb\rc", "\n"]
    assert column(spark, T.lines, values) == [v.splitlines() for v in values]


def test_markdown_normalisation_examples(spark):
    assert column(spark, T.normalize_markdown, ["##   Ferry  times \n\n\n\n+ north pier\n|  six |seven  |", "speed \\(v\\) and \\[v^2\\]"]) == ["## Ferry  times\n\n- north pier\n|six|seven|".replace("  ", " "), "speed $v$ and $$v^2$$"]
    assert column(spark, T.normalize_latex, ["\tk \\, m\n n "]) == ["k   m n"]


def test_tables_boxes_and_names(spark):
    row = spark.range(1).select(
        T.markdown_table(F.expr("array(array('Berth','Ship'), array('1|west'), array('2','Kestrel','late'))")).alias("t"), T.markdown_table(F.expr("array(array('Berth','Ship'))")).alias("h"),
        T.box_line(F.lit("crane"), F.array(*map(F.lit, (7, 8, 90, 5)))).alias("b"), T.archive_stem(F.lit("scans/may/leaf_07.page.xml")).alias("s"),
        T.parse_hub_uri(F.lit("hf://tidewatch/logs/2021/")).alias("u"), T.parse_hub_uri(F.lit("hf://tidewatch")).alias("v"),
    ).first()
    assert row["t"] == "| Berth | Ship |\n| :--- | :--- |\n| 1\\|west |  |\n| 2 | Kestrel |"
    assert row["h"] == "| Berth | Ship |\n| :--- | :--- |\n|  |  |"
    assert row["b"] == "- crane: x=7, y=8, w=90, h=5" and row["s"] == "leaf_07"
    assert tuple(row["u"]) == ("tidewatch", "logs/2021") and tuple(row["v"]) == ("tidewatch", "")
    for fault in ("s3://tidewatch/x", "hf://", "hf:///"):
        with pytest.raises(Exception, match="address"):
            spark.range(1).select(T.parse_hub_uri(F.lit(fault))).collect()


def test_charts(spark):
    values = ["<s_month>May<sep/>  June</s_month><s_rain>3</s_rain>", "no  tags\n\n\nat all", "<s_bboxes><s_x>4</s_x><s_y>5</s_y><s_w>60</s_w><s_h>7</s_h><sep/> <sep/><s_y>9</s_y><sep/>odd</s_bboxes>", "<s_a>x</s_b>", None]
    assert column(spark, T.chart_block, values) == ["```chart\nmonth: May | June\nrain: 3\n```", "no tags\n\nat all", "```chart\nbboxes: (x=4, y=5, w=60, h=7) | (x=, y=9, w=, h=)\n```", "<s_a>x</s_b>", None]


def test_formulas(spark):
    values = ["a _ { i }  + b ^ { 2 }", "$ f ( x ) , y ; . . .$", "$$p=q$$", "", " \n", "3 x + 4 ab", "\\frac{ 1 }{ n }", None]
    assert column(spark, T.standalone_formula, values) == ["$$\na_{i} + b^{2}\n$$", "$$\nf (x), y; \\dots\n$$", "$$p=q$$", "", "", "$$\n3x + 4 ab\n$$", "$$\n\\frac{1}{n}\n$$", None]


def test_damaged_blocks(spark):
    values = ["intro\n| six | low |\n|---|---|\n$$x$$", "see $$ \\alpha\n+1 $$ and $$b$$", "one\n\ntwo\nthree\nfour", "##  Only   this", " \n ", None]
    assert column(spark, T.corrupt_block, values) == [
        ("  six   low  \n --- --- ", "| six | low |\n|---|---|", "table_delimiter_drop"), ("$alpha\n+1$", "$$\\alpha\n+1$$", "display_math_break"),
        ("three\ntwo\none", "one\ntwo\nthree", "reading_order_swap"), (" Only this", "##  Only   this", "header_flatten"), (" \n ", " \n ", "identity"), None,
    ]


def test_splits_of_paths(spark):
    assert column(spark, T.split_of_path, ["data/train-0.parquet", "x/validation.parquet", "dev/a", "a/test/b", "odd", "y/myval.parquet", None]) == ["train", "validation", "validation", "test", "train", "validation", None]
    assert column(spark, lambda c: T.split_of_path(c, "crohme"), ["set/2016-part.parquet", "set/2011-part.parquet", "val/2016.parquet"]) == ["test", "train", "validation"]
    assert column(spark, T.split_of_path, ["set/2016-part.parquet"]) == ["train"]
    assert column(spark, T.split_of_member, ["scans/val/a.xml", "scans/Test/b.xml", "val.xml", "scans/validation/c", None]) == ["validation", "test", "train", "validation", None]


def test_similarity(spark):
    rows = spark.createDataFrame([("abcd", "bcde"), ("", ""), ("x", None)], "a string, b string")
    got = [r["similarity"] for r in with_edit_similarity(rows, "a", "b").collect()]
    assert got == [SequenceMatcher(a="abcd", b="bcde").ratio(), 1.0, None]
    assert [r[0] for r in rows.limit(2).select(levenshtein_ratio(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0]


def test_validation(spark):
    rows = spark.createDataFrame([("```python\nx",), ("$$a",), ("| a |\n| b | c |\n\n| d |",), ("<TABLE>",), ("fine",)], "t string")
    got = [(r["error_count"], r["warning_count"], r["valid"]) for r in P.validate(rows, "t").collect()]
    assert got == [(1, 0, False), (1, 0, False), (0, 1, True), (0, 0, True), (0, 0, True)]
    assert [r["error_count"] for r in P.validate(rows, "t", html_tables=False).collect()] == [1, 1, 0, 1, 0]


def test_routing_of_a_dense_page(spark):
    signals = dict(visual_density=0.7, formula_density=0.2, table_density=0.02, handwriting=0.0, chart=0.0, tiny_text=0.2, photo=0.0, orientation=0.0)
    row = P.route(spark.range(1), {k: F.lit(v) for k, v in signals.items()}, F.lit(31)).first()
    assert "formula" in row["hints"] and "formula_density" in row["reasons"]


def test_assembly(spark):
    pages = [("log", 3, "Port of Lund\n\nWind from the west.\n\nkept by hand"), ("log", 1, "Port of Lund\n\n## May\n\nNo ships.\n\nkept by hand"), ("slip", 1, "one leaf"), ("slip", 2, "\t"), ("twin", 4, "same\nsame")]
    got = {r["doc"]: r["text"] for r in P.assemble(spark.createDataFrame(pages, "doc string, n int, t string"), key="doc", number="n", text="t").collect()}
    assert got == {"log": "## May\n\nNo ships.\n\nWind from the west.", "slip": "one leaf", "twin": "same\nsame"}


def test_assembly_against_plain(spark):
    import random

    rng = random.Random(11)
    line = lambda: rng.choice(["Head", " Head", "Foot", "x", "y", "", "  "])
    pages = [(f"d{rng.randrange(6)}", i, "\n".join(line() for _ in range(rng.randrange(6)))) for i in range(60)]

    def plain(own):
        firsts, lasts = [], []
        for _, t in own:
            full = [x.strip() for x in t.splitlines() if x.strip()]
            firsts += full[:1]
            lasts += full[-1:]
        out = []
        for _, t in sorted(own):
            ls = t.splitlines()
            full = [x.strip() for x in ls if x.strip()]
            if full and firsts.count(full[0]) >= 2:
                del ls[[x.strip() for x in ls].index(full[0])]
            full = [x.strip() for x in ls if x.strip()]
            if full and lasts.count(full[-1]) >= 2:
                del ls[len(ls) - 1 - [x.strip() for x in ls][::-1].index(full[-1])]
            out.append("\n".join(ls).strip())
        return "\n\n".join(filter(None, out))

    got = {r["d"]: r["text"] for r in P.assemble(spark.createDataFrame(pages, "d string, n int, t string"), key="d", number="n", text="t").collect()}
    assert got == {d: plain([(n, t) for k, n, t in pages if k == d]) for d in {p[0] for p in pages}}


def test_tex(spark):
    paper = r"""\documentclass{report}
\newcommand{\river}{Orla}
\begin{document}
\title{Floods of the North}
\begin{abstract}Levels of the \river{} since $t_0$.\end{abstract}
\section{Gauges}
We read \emph{three} gauges; % by hand
see \[h = k\sqrt{q}\]
\begin{equation}q = v A\end{equation}
\end{document}"""
    out = M.tex_to_markdown(paper)
    assert out.startswith("# Floods of the North") and "## Abstract\n\nLevels of the Orla" in out and "$t_0$" in out
    assert "## Gauges" in out and "three gauges;" in out and "by hand" not in out and "newcommand" not in out
    assert "$$\nh = k\\sqrt{q}\n$$" in out and "$$\nq = v A\n$$" in out
    for broken in ("\\", "{", "\\begin{table}", "$", "\\section", "\\multirow{2}{*}{x", "\\def\\abc"):
        M.tex_to_markdown(broken)


def test_tex_tables():
    out = M.tex_to_markdown(r"\begin{table}\caption{Levels}\begin{tabular}{lr}Gauge & Level \\ \hline North & 12 \\ South & \end{tabular}\end{table}")
    assert "Table: Levels\n\n| Gauge | Level |\n| :--- | :--- |\n| North | 12 |\n| South | |" in out
    span = M.tex_to_markdown(r"\begin{table}\begin{tabular}{lr}\multicolumn{2}{c}{All gauges} \\ n & s\end{tabular}\end{table}")
    assert span == '```table\ncolumns: 2\ncells:\n  - [0, 0, 0, 1, "All gauges"]\n  - [1, 0, 1, 0, "n"]\n  - [1, 1, 1, 1, "s"]\n```'


def test_xml_readers():
    jats = "<article><front><article-title>Silt</article-title><abstract><p>Grain sizes.</p></abstract></front><body><sec><title>Sieving</title><p>Mass <inline-formula><tex-math>m_k</tex-math></inline-formula> per sieve.</p><table-wrap><caption><title>Sieves</title></caption><table><tr><th>Mesh</th><th>Mass</th></tr><tr><td>fine</td><td>7</td></tr></table></table-wrap></sec></body></article>"
    out = M.jats_to_markdown(jats)
    assert out.startswith("# Silt\n\n## Abstract\n\nGrain sizes.\n\n## Sieving\n\nMass $m_k$ per sieve.") and "Table: Sieves\n\n| Mesh | Mass |" in out
    page = '<Doc xmlns="urn:p"><TextRegion><TextLine><Unicode>to the</Unicode></TextLine><TextLine><Unicode>harbour master</Unicode></TextLine></TextRegion><TextRegion><TextLine><Unicode>in haste</Unicode></TextLine></TextRegion></Doc>'
    assert M.pagexml_to_markdown(page) == "to the\nharbour master\n\nin haste"
    voc = "<annotation><object><name>seal</name><bndbox><xmin>31</xmin><ymin>5</ymin><xmax>62</xmax><ymax>44</ymax></bndbox></object></annotation>"
    assert M.voc_to_markdown(voc) == "## Table Regions\n- seal: xmin=31, ymin=5, xmax=62, ymax=44"
    assert M.jats_to_markdown("<broken") == M.pagexml_to_markdown("<broken") == M.voc_to_markdown("<broken") == "<broken"


def test_nested_rows():
    assert M.form_fields(["Ship", "name", "-", "Kestrel"], [3, 4, 0, 6]) == "## Form Fields\n- question: Ship name\n- answer: Kestrel"
    cells = [[{"tokens": list(w)} for w in ("Hour", "Tide", "six", "low")]]
    assert "| Hour | Tide |\n| :--- | :--- |\n| six | low |" in M.token_table({"filename": "tides", "cols": 2, "cells": cells})
    lines = {"valid_line": [{"group_id": g, "words": [{"text": w}]} for g, w in ((5, "rope"), (5, "20m"), (3, "paid"))]}
    assert M.receipt_lines(lines) == "## Receipt OCR\nrope 20m\npaid"
    assert M.mapping_to_markdown("Log", {"wind": {"from": ["w", "nw"]}, "ships": [{"name": "Kestrel"}]}) == "## Log\n- wind.from: w, nw\n- ships[0].name: Kestrel"
    assert json.loads(M.json_target({"raw": b"abc", "page": {"bytes": b"z", "no": 4}, "image": 1})) == {"page": {"no": 4}, "raw": {"bytes_len": 3}}


def test_page_projection():
    body = " ".join(f"leaf{i}" for i in range(60))
    two = M.project_pages(body, [body[:200], "7 running head " + body[200:]])
    assert two[0] and two[1] and (two[0] + two[1]).replace(" ", "") == body.replace(" ", "")
    half = M.project_pages("## North\n\nmud and reeds here\n\n## South\n\nstone quay there now", ["mud and reeds here", "stone quay there now"])
    assert len(half) == 2 and "reeds" in half[0] and "quay there" in half[1]
    assert M.project_pages("x", []) == ["x"] and M.project_pages("...", ["a", "b"]) == ["...", "..."]
