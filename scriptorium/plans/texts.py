"""Queries of text normalisation, validation, routing and assembly over documents, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import levenshtein_ratio, with_edit_similarity
from ..operators import pages as P
from ..operators.curation import exact_duplicates
from ..shared import spread, table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "source"))


def normalize_markdown(spark: SparkSession, d: str) -> DataFrame:
    t = T.normalize_markdown(F.col("text"))
    return _docs(spark, d).select("doc_id", F.sha2(t, 256).alias("normal_hash"), F.length(t).alias("normal_chars"))


def normalize_target_text(spark: SparkSession, d: str) -> DataFrame:
    t = T.normalize_target(F.col("text"))
    return _docs(spark, d).select("doc_id", F.sha2(t, 256).alias("normal_hash"), F.length(t).alias("normal_chars"))


def latex_exact_match(spark: SparkSession, d: str) -> DataFrame:
    """Each document's first two formulas against each other."""
    f = F.regexp_extract_all("text", F.lit(r"\$\$([^$]+)\$\$"), F.lit(1))
    return _docs(spark, d).select("doc_id", F.get(f, 0).alias("a"), F.get(f, 1).alias("b")).select("doc_id", T.latex_match(F.col("a"), F.col("b")).alias("match"), F.length(T.normalize_latex(F.col("a"))).alias("latex_chars"))


def validate_markdown(spark: SparkSession, d: str) -> DataFrame:
    rows = P.validate(_docs(spark, d).where("text is not null"), "text")
    return rows.select("doc_id", "error_count", "warning_count", "valid", "repair_required", F.array_join(F.transform("findings", lambda x: x["code"]), ",").alias("codes"))


def markdown_validity(spark: SparkSession, d: str) -> DataFrame:
    """1 for every document whose Markdown has no error, else 0."""
    rows = P.validate(_docs(spark, d).where("text is not null"), "text")
    return rows.select("doc_id", F.when(F.col("valid"), 1.0).otherwise(0.0).alias("markdown_validity"))


def _signals() -> dict:
    n = F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("double")
    t = F.coalesce(F.col("text"), F.lit(""))

    def share(piece: str, weight: float):
        return F.regexp_count(t, F.lit(piece)) * F.lit(weight) / n

    return {
        "visual_density": F.least(n / 4000.0, F.lit(1.5)),
        "formula_density": share(r"\\", 2.0),
        "table_density": share(r"\|", 2.0),
        "handwriting": share(r"[0-9]", 4.0),
        "chart": share("#", 20.0),
        "tiny_text": share("[(]", 20.0),
        "photo": share("[,]", 10.0),
        "orientation": share("[:]", 10.0),
    }


def route_pages(spark: SparkSession, d: str) -> DataFrame:
    blocks = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n\n")) + 1
    rows = P.route(_docs(spark, d), _signals(), blocks)
    return rows.select("doc_id", F.round("complexity_score", 6).alias("complexity_score"), "mode", F.array_join("reasons", ",").alias("reasons"), F.array_join("hints", ",").alias("hints"), "repair_budget", "visual_token_budget")


def assemble_document(spark: SparkSession, d: str) -> DataFrame:
    """The pages of every document of the samples, assembled in order of their page numbers."""
    s = table(spark, d, "canonical_samples").where("page_id is not null and canonical_target is not null").select("sample_id", "page_id", "canonical_target").distinct()
    pages = s.select("sample_id", F.regexp_replace("page_id", r"(?s):[^:]*$", "").alias("doc"), F.struct(F.substring_index("page_id", ":", -1).cast("int").alias("page"), "sample_id").alias("number"), "canonical_target")
    done = P.assemble(pages, key="doc", number="number", text="canonical_target", marker="<!-- page-break -->")
    return done.select("doc", F.sha2("text", 256).alias("text_hash"), F.length("text").alias("chars"))


def repeated_edge_lines(spark: SparkSession, d: str) -> DataFrame:
    """First lines that several samples of a document share."""
    s = table(spark, d, "canonical_samples").where("doc_id is not null").select("sample_id", "doc_id", "canonical_target").distinct()
    bare = F.filter(F.transform(T.lines(F.col("canonical_target")), T.strip), lambda x: x != "")
    return s.select("doc_id", F.get(bare, 0).alias("line")).where("line is not null").groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def edit_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Targets of adjacent pages of a document: matching ratio of their normalised texts."""
    s = table(spark, d, "canonical_samples").where("page_id is not null").select("page_id", "canonical_target", "sample_id").groupBy("page_id").agg(F.min_by("canonical_target", "sample_id").alias("t"))
    p = s.select(F.regexp_replace("page_id", r"(?s):[^:]*$", "").alias("doc"), F.substring_index("page_id", ":", -1).cast("int").alias("page"), "t")
    nxt = p.select("doc", (F.col("page") - 1).alias("page"), F.col("t").alias("u"))
    return with_edit_similarity(p.join(nxt, ["doc", "page"]), "t", "u").select("doc", "page", F.round("similarity", 6).alias("similarity"))


def edit_ratio_native(spark: SparkSession, d: str) -> DataFrame:
    """Titles of sources against their ids: the native edit ratio."""
    r = table(spark, d, "source_registry").where("source_name is not null")
    return r.select("source_id", "source_name", "registered_at", F.round(levenshtein_ratio(F.replace("source_id", F.lit("_"), F.lit(" ")), F.lower("source_name")), 6).alias("ratio"))


def formula_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Formula targets as standalone display blocks."""
    s = table(spark, d, "canonical_samples").where("target_type = 'latex_formula'").select("sample_id", "canonical_target").distinct()
    return s.select("sample_id", F.sha2(T.standalone_formula(F.col("canonical_target")), 256).alias("block_hash"))


def target_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Samples whose canonical target texts are the same."""
    s = table(spark, d, "canonical_samples").where("sample_id is not null").select("sample_id", T.normalize_target(F.col("canonical_target")).alias("t")).distinct()
    return exact_duplicates(s, F.col("t"), "sample_id")


def corrupt_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The block of every document that was damaged, whole and damaged."""
    rows = _docs(spark, d).where("text is not null").select("doc_id", T.corrupt_block(F.col("text")).alias("c"))
    return rows.select("doc_id", "c.kind", F.sha2("c.target", 256).alias("target_hash"), F.sha2("c.text", 256).alias("damaged_hash"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        normalize_markdown, normalize_target_text, latex_exact_match, validate_markdown, route_pages, assemble_document, repeated_edge_lines,
        edit_similarity_pairs, edit_ratio_native, formula_blocks, corrupt_blocks, target_dedup, markdown_validity,
    )
}

_B = r"[\s\x0b\x1c-\x1f\x85\pZ]"
_LE = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_B}+|{_B}+$', '', 'g')"


def _rstrip(c: str) -> str:
    return f"regexp_replace({c}, '{_B}+$', '')"


def _lines(c: str) -> str:
    return f"string_split_regex(regexp_replace({c}, '({_LE})$', ''), '{_LE}')"


def _ws(c: str) -> str:
    return _strip(f"regexp_replace(regexp_replace(replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', '\n\n', 'g')")


def _heading(x: str) -> str:
    s = _strip(x)
    return f"CASE WHEN starts_with({s}, '#') THEN {_rstrip(f'''regexp_extract({s}, '^[^ ]*') || ' ' || {_strip(f'''substr({s}, length(regexp_extract({s}, '^[^ ]*')) + 2)''')}''')} ELSE {_rstrip(x)} END"


def _cells(x: str) -> str:
    cell = _strip("c")
    return f"CASE WHEN contains({x}, '|') THEN array_to_string(list_transform(string_split({x}, '|'), lambda c: {cell}), '|') ELSE {_rstrip(x)} END"


_HEADED = f"array_to_string(list_transform({_lines('w')}, lambda x: {_heading('x')}), chr(10))"
_MATH = "replace(replace(replace(replace(b, '\\(', '$'), '\\)', '$'), '\\[', '$$'), '\\]', '$$')"
_TABLED = f"array_to_string(list_transform({_lines('m')}, lambda x: {_cells('x')}), chr(10))"
_MD = f"""WITH a AS (SELECT doc_id, {_ws('text')} AS w FROM documents), h AS (SELECT doc_id, {_HEADED} AS h FROM a),
 b AS (SELECT doc_id, regexp_replace(h, '(?m)^[*+]{_B}+', '- ', 'g') AS b FROM h), m AS (SELECT doc_id, {_MATH} AS m FROM b), t AS (SELECT doc_id, {_TABLED} AS t FROM m)
 SELECT doc_id, sha256({_ws('t')}) AS normal_hash, length({_ws('t')}) AS normal_chars FROM t"""


def _count(c: str, piece: str) -> str:
    return f"((length({c}) - length(replace({c}, '{piece}', ''))) // {len(piece)})"


_UNEVEN = f"""(SELECT count(*) FROM (SELECT min(k) AS lo, max(k) AS hi, count(*) AS n FROM (SELECT k, pos - row_number() OVER (ORDER BY pos) AS g FROM (SELECT unnest(list_transform({_lines('text')}, lambda x: {_count('x', '|')})) AS k, generate_subscripts({_lines('text')}, 1) AS pos) WHERE k > 0) GROUP BY g) WHERE n >= 2 AND lo <> hi)"""


def _share(piece: str, weight: float) -> str:
    return f"len(regexp_extract_all(t, '{piece}')) * {weight} / n"


_SIGNALS = {
    "visual_density": "least(n / 4000.0, 1.5)", "formula_density": _share(r"\\", 2.0), "table_density": _share(r"\|", 2.0), "handwriting": _share("[0-9]", 4.0),
    "chart": _share("#", 20.0), "tiny_text": _share("[(]", 20.0), "photo": _share("[,]", 10.0), "orientation": _share("[:]", 10.0),
}
_SCORE = " + ".join(f"{w} * least(1.0, greatest(0.0, {s}))" for s, w in P.WEIGHTS.items())
_REASONS = ", ".join(f"CASE WHEN {s} >= {t} THEN '{r}' END" for s, t, r, _ in P.HARD_REASONS)
_HINTS = ", ".join(f"CASE WHEN {s} >= {t} THEN '{h}' END" for s, t, _, h in P.HARD_REASONS if h)

_UNIX = "replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def _target_sql(name: str, source: str, key: str, text: str) -> str:
    """Common tables that give ``name`` (key, t): the canonical target text of ``text``, line by line."""
    return f"""{name}_l AS (SELECT {key}, i, line, {_strip('line')} AS s FROM (SELECT {key}, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT {key}, string_split({_UNIX.format(text)}, chr(10)) AS l FROM {source} WHERE {text} IS NOT NULL))),
 {name}_f AS (SELECT *, coalesce(sum(CASE WHEN starts_with(s, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced FROM {name}_l),
 {name}_r AS (SELECT *, s = '' AND NOT fenced AS blank, CASE WHEN starts_with(s, '```') THEN s WHEN fenced THEN {_rstrip('line')} WHEN s = '' THEN '' ELSE replace(regexp_extract({_rstrip('line')}, '^{_B}*'), chr(9), '  ') || regexp_replace(s, '[ \t]+', ' ', 'g') END AS r FROM {name}_f),
 {name}_k AS (SELECT *, coalesce(lag(r) OVER (PARTITION BY {key} ORDER BY i), '') = '' AS after_blank FROM {name}_r),
 {name} AS (SELECT {key}, regexp_replace(coalesce(string_agg(r, chr(10) ORDER BY i) FILTER (NOT (blank AND after_blank)), ''), '^\n+|\n+$', '', 'g') AS t FROM {name}_k GROUP BY {key})"""


def _spaced_sql(c: str) -> str:
    for pattern, put in T.FORMULA_SPACING[:-1]:
        c = f"regexp_replace({c}, '{pattern.replace(chr(92) + 's', _B)}', '{put}', 'g')"
    for _ in "12":  # a letter that ends one match may begin the next
        c = f"regexp_replace({c}, '(\\pN){_B}+([A-Za-z])([^A-Za-z]|$)', '\\1\\2\\3', 'g')"
    return c


_SOME = f"(SELECT doc_id, text, list_filter(string_split_regex(text, '{_LE}'), lambda x: {_strip('x')} <> '') AS r FROM documents WHERE text IS NOT NULL)"
_DAMAGED = f"""b AS (SELECT *, list_filter(r, lambda x: starts_with({_strip('x')}, '|') AND ends_with({_strip('x')}, '|'))[1:6] AS tab, regexp_extract(text, '(?s)\\$\\$(.+?)\\$\\$', 1) AS math FROM {_SOME}),
 k AS (SELECT *, '$$' || {_strip('math')} || '$$' AS f, CASE WHEN len(r) = 0 THEN 'identity' WHEN len(tab) > 0 THEN 'table_delimiter_drop' WHEN math <> '' THEN 'display_math_break' WHEN len(r) >= 2 THEN 'reading_order_swap' ELSE 'header_flatten' END AS kind FROM b)"""

SQL: dict[str, str] = {
    "target_dedup": f"WITH s AS (SELECT DISTINCT sample_id, canonical_target FROM canonical_samples WHERE sample_id IS NOT NULL), {_target_sql('n', 's', 'sample_id', 'canonical_target')} SELECT min(sample_id) AS first_id, count(*) AS copies FROM n GROUP BY t HAVING count(*) > 1",
    "normalize_target_text": f"WITH {_target_sql('n', 'documents', 'doc_id', 'text')} SELECT doc_id, sha256(t) AS normal_hash, length(t) AS normal_chars FROM documents LEFT JOIN n USING (doc_id)",
    "formula_blocks": f"""WITH s AS (SELECT DISTINCT sample_id, canonical_target FROM canonical_samples WHERE target_type = 'latex_formula'), {_target_sql('n', 's', 'sample_id', 'canonical_target')}, p AS (SELECT sample_id, {_spaced_sql('t')} AS x FROM n), {_target_sql('m', 'p', 'sample_id', 'x')},
 w AS (SELECT sample_id, t, chr(36) || chr(36) || chr(10) || CASE WHEN starts_with(t, '$') AND ends_with(t, '$') THEN {_strip("trim(t, '$')")} ELSE t END || chr(10) || chr(36) || chr(36) AS y FROM m), {_target_sql('o', 'w', 'sample_id', 'y')}
 SELECT sample_id, sha256(CASE WHEN w.t = '' OR starts_with(w.t, '$$') AND ends_with(w.t, '$$') THEN w.t ELSE o.t END) AS block_hash FROM s LEFT JOIN w USING (sample_id) LEFT JOIN o USING (sample_id)""",
    "corrupt_blocks": f"""WITH {_DAMAGED} SELECT doc_id, kind,
  sha256(CASE kind WHEN 'identity' THEN text WHEN 'table_delimiter_drop' THEN array_to_string(tab, chr(10)) WHEN 'display_math_break' THEN f WHEN 'reading_order_swap' THEN array_to_string(r[1:3], chr(10)) ELSE r[1] END) AS target_hash,
  sha256(CASE kind WHEN 'identity' THEN text WHEN 'table_delimiter_drop' THEN replace(array_to_string(tab, chr(10)), '|', ' ') WHEN 'display_math_break' THEN replace(replace(f, chr(92), ''), '$$', '$') WHEN 'reading_order_swap' THEN array_to_string(list_reverse(r[1:3]), chr(10)) ELSE replace(regexp_replace(r[1], '{_B}+', ' ', 'g'), '#', '') END) AS damaged_hash FROM k""",
    "assemble_document": f"""WITH p AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT sample_id, regexp_replace(page_id, ':[^:]*$', '') AS doc, CAST(regexp_extract(page_id, '([^:]*)$', 1) AS INT) AS page, canonical_target AS t FROM canonical_samples WHERE page_id IS NOT NULL AND canonical_target IS NOT NULL)),
 l AS (SELECT id, doc, page, sample_id, i, line, {_strip('line')} AS s FROM (SELECT *, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT *, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM (SELECT *, string_split_regex(t, '{_LE}') AS ls FROM p)))),
 e AS (SELECT id, any_value(doc) AS doc, arg_min(s, i) AS head, arg_max(s, i) AS foot FROM l WHERE s <> '' GROUP BY id),
 heads AS (SELECT doc, head FROM e GROUP BY 1, 2 HAVING count(*) >= 2), feet AS (SELECT doc, foot FROM e GROUP BY 1, 2 HAVING count(*) >= 2),
 h AS (SELECT l.* FROM l LEFT JOIN (SELECT l.id, min(i) AS gone FROM l JOIN e USING (id) JOIN heads ON heads.doc = e.doc AND heads.head = e.head WHERE s = e.head GROUP BY 1) g ON l.id = g.id WHERE g.gone IS NULL OR l.i <> g.gone),
 last AS (SELECT id, any_value(doc) AS doc, arg_max(s, i) AS foot, max(i) AS gone FROM h WHERE s <> '' GROUP BY id),
 f AS (SELECT h.* FROM h LEFT JOIN (SELECT id, gone FROM last JOIN feet USING (doc, foot)) g ON h.id = g.id WHERE g.gone IS NULL OR h.i <> g.gone),
 t AS (SELECT id, any_value(doc) AS doc, any_value(page) AS page, any_value(sample_id) AS sample_id, {_strip('string_agg(line, chr(10) ORDER BY i)')} AS t FROM f GROUP BY id)
 SELECT doc, sha256(coalesce(x, '')) AS text_hash, length(coalesce(x, '')) AS chars FROM (SELECT DISTINCT doc FROM p) LEFT JOIN (SELECT doc, string_agg(t, chr(10) || chr(10) || '<!-- page-break -->' || chr(10) || chr(10) ORDER BY page, sample_id) AS x FROM t WHERE t <> '' GROUP BY doc) USING (doc)""",
    "normalize_markdown": _MD,
    "latex_exact_match": f"""SELECT doc_id, CASE WHEN na = nb THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS match, length(na) AS latex_chars FROM (SELECT doc_id, {_strip(f"replace(regexp_replace({_strip('f[1]')}, '{_B}+', ' ', 'g'), '\\,', ' ')")} AS na, {_strip(f"replace(regexp_replace({_strip('f[2]')}, '{_B}+', ' ', 'g'), '\\,', ' ')")} AS nb
 FROM (SELECT doc_id, regexp_extract_all(text, '\\$\\$([^$]+)\\$\\$', 1) AS f FROM documents))""",
    "route_pages": f"""WITH x AS (SELECT doc_id, coalesce(text, '') AS t, greatest(coalesce(length(text), 0), 1)::DOUBLE AS n FROM documents),
 s AS (SELECT doc_id, {', '.join(f'{e} AS {k}' for k, e in _SIGNALS.items())}, len(regexp_extract_all(t, '\\n\\n')) + 1 AS blocks FROM x),
 q AS (SELECT *, least(1.0, greatest(0.0, 0.1 * least(1.0, blocks / 24.0) + {_SCORE})) AS score, list_filter([{_REASONS}], lambda r: r IS NOT NULL) AS reasons0, list_filter([{_HINTS}], lambda r: r IS NOT NULL) AS hints0 FROM s),
 m AS (SELECT *, CASE WHEN len(reasons0) > 0 OR score >= 0.62 THEN 'hard' WHEN score >= 0.34 THEN 'standard' ELSE 'fast' END AS mode FROM q)
 SELECT doc_id, round(score, 6) AS complexity_score, mode, CASE WHEN len(reasons0) > 0 THEN array_to_string(reasons0, ',') ELSE 'low_complexity' END AS reasons,
 array_to_string(list_sort(list_distinct(list_concat(hints0, CASE mode WHEN 'hard' THEN ['formula', 'handwriting', 'table'] WHEN 'standard' THEN ['table'] ELSE CAST([] AS VARCHAR[]) END))), ',') AS hints,
 CASE mode WHEN 'hard' THEN 2 WHEN 'standard' THEN 1 ELSE 0 END AS repair_budget, CASE mode WHEN 'hard' THEN 256 WHEN 'standard' THEN 160 ELSE 96 END AS visual_token_budget FROM m""",
    "repeated_edge_lines": f"""SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, list_filter(list_transform({_lines('canonical_target')}, lambda x: {_strip('x')}), lambda x: x <> '')[1] AS line
 FROM (SELECT DISTINCT sample_id, doc_id, canonical_target FROM canonical_samples WHERE doc_id IS NOT NULL)) WHERE line IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2""",
    "edit_ratio_native": """SELECT source_id, source_name, registered_at, round(CASE WHEN greatest(length(source_id), length(source_name)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(replace(source_id, '_', ' '), lower(source_name)) / greatest(length(source_id), length(source_name)) END, 6) AS ratio FROM source_registry WHERE source_name IS NOT NULL""",
    "validate_markdown": f"""WITH v AS (SELECT doc_id, {_count('text', '```')} % 2 <> 0 AS e1, {_count('text', '$$')} % 2 <> 0 AS e2, {_count("regexp_replace(replace(text, '$$', ''), '\\\\.', '', 'gs')", '$')} % 2 <> 0 AS w1 , text FROM documents WHERE text IS NOT NULL),
 ln AS (SELECT doc_id, pos, {_count('x', '|')} AS k FROM (SELECT doc_id, unnest({_lines('text')}) AS x, generate_subscripts({_lines('text')}, 1) AS pos FROM v)),
 isl AS (SELECT doc_id, g, min(k) AS lo, max(k) AS hi, count(*) AS c FROM (SELECT doc_id, k, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM ln WHERE k > 0) GROUP BY 1, 2),
 bad AS (SELECT doc_id, count(*) AS b FROM isl WHERE c >= 2 AND lo <> hi GROUP BY 1),
 r AS (SELECT v.doc_id, e1, e2, w1, coalesce(b, 0) AS b FROM v LEFT JOIN bad USING (doc_id))
 SELECT doc_id, CAST(e1 AS INT) + CAST(e2 AS INT) AS error_count, CAST(CAST(w1 AS INT) + b AS INT) AS warning_count, NOT (e1 OR e2) AS valid, (e1 OR e2) AS repair_required,
 array_to_string(list_concat(list_filter([CASE WHEN e1 THEN 'unbalanced_code_fence' END, CASE WHEN e2 THEN 'unbalanced_display_math' END, CASE WHEN w1 THEN 'unbalanced_inline_math' END], lambda x: x IS NOT NULL), list_transform(range(b), lambda i: 'table_shape_inconsistent')), ',') AS codes FROM r""",
}
SQL["markdown_validity"] = f"SELECT doc_id, CASE WHEN valid THEN 1.0 ELSE 0.0 END::DOUBLE AS markdown_validity FROM ({SQL['validate_markdown']})"
