"""Text scalars as native columns: everything here stays in whole-stage code generation.

Blank means Unicode white space throughout (the engine's own ``trim`` only knows the space), and lines end where Unicode
says they do. All functions give null for null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
BLANKS = "".join(filter(str.isspace, map(chr, range(0x3001))))
"""The same characters one by one: trimming a set of characters is much cheaper than a pattern at either end."""
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def bind(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands in the result."""
    return F.get(F.transform(F.array(c), use), 0)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def lines(c: Column) -> Column:
    """The lines of a text, without an empty last one; an empty text has none."""
    return bind(F.split(c, LINE_END), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def filled(c: Column) -> Column:
    """A value, with blank text counted as missing."""
    return F.when(strip(c) != "", c)


def first_filled(*cs: Column) -> Column:
    return F.coalesce(*[filled(c) for c in cs])


def split_pipe(c: Column) -> Column:
    """The elements of a pipe list, without empty ones (null: an empty list)."""
    return F.coalesce(F.filter(F.split(c, r"\|"), lambda x: x != ""), F.array().cast("array<string>"))


def count_of(c: Column, piece: str) -> Column:
    """How often a fixed piece occurs, not overlapping."""
    return (F.length(c) - F.length(F.replace(c, F.lit(piece), F.lit("")))) / F.lit(len(piece))


# --- features of a canonical target -------------------------------------------------------------


def target_features(c: Column) -> dict[str, Column]:
    """Length and the seven structural features of a canonical target."""
    # inline math needs two lone dollars; runs of dollars are set aside first
    lone = F.regexp_count(F.regexp_replace(c, r"\${2,}", "#"), F.lit(r"\$"))
    return {
        "target_char_count": F.length(c),
        "has_display_math": F.contains(c, F.lit("$$")),
        "has_inline_math": lone >= 2,
        "has_gfm_table": F.exists(F.transform(lines(c), strip), lambda x: F.startswith(x, F.lit("|")) & F.endswith(x, F.lit("|"))),
        "has_table_block": F.contains(c, F.lit("```table")),
        "has_figure_caption": c.rlike(f"(?i)(?:^|\\n)figure:{BLANK}"),
        "has_heading": c.rlike(f"(?:^|\\n)#{{1,6}}{BLANK}"),
        "has_list": c.rlike(f"(?:^|\\n){BLANK}*[-*]{BLANK}"),
    }


def stable_hash(c: Column) -> Column:
    return F.sha2(c, 256)


# --- markdown and latex normalisation -------------------------------------------------------------


def unix_lines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(unix_lines(c), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def normalize_headings(c: Column) -> Column:
    def heading(s: Column) -> Column:
        at = F.instr(s, " ")
        return rstrip(F.concat(F.substring_index(s, " ", 1), F.lit(" "), F.when(at > 0, strip(F.substring(s, at + 1, F.length(s)))).otherwise("")))

    def line(raw: Column) -> Column:
        return bind(strip(raw), lambda s: F.when(F.startswith(s, F.lit("#")), heading(s)).otherwise(rstrip(raw)))

    return F.array_join(F.transform(lines(c), line), "\n")


def normalize_bullets(c: Column) -> Column:
    return F.regexp_replace(c, f"(?m)^[*+]{BLANK}+", "- ")


def normalize_math_delimiters(c: Column) -> Column:
    for old, new in (("\\(", "$"), ("\\)", "$"), ("\\[", "$$"), ("\\]", "$$")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def canonicalize_tables(c: Column) -> Column:
    def line(raw: Column) -> Column:
        cells = F.array_join(F.transform(F.split(raw, r"\|"), strip), "|")
        return F.when(F.contains(raw, F.lit("|")), cells).otherwise(rstrip(raw))

    return F.array_join(F.transform(lines(c), line), "\n")


def normalize_markdown(c: Column) -> Column:
    for step in (normalize_whitespace, normalize_headings, normalize_bullets, normalize_math_delimiters, canonicalize_tables, normalize_whitespace):
        c = step(c)
    return c


def normalize_latex(c: Column) -> Column:
    return strip(F.replace(F.regexp_replace(strip(c), f"{BLANK}+", " "), F.lit("\\,"), F.lit(" ")))


def latex_match(prediction: Column, reference: Column) -> Column:
    """1 where both formulas are there and equal, else 0 (a missing one counts as wrong)."""
    return F.when(normalize_latex(prediction) == normalize_latex(reference), 1.0).otherwise(0.0)


def normalize_target(c: Column) -> Column:
    """Canonical target text: trimmed lines, single blanks, no blank runs; fenced lines keep their blanks.

    One fold over the lines carries the state (inside a fence, last line was blank).
    """
    state = "struct<fence:boolean,out:array<string>>"

    def step(acc: Column, raw: Column) -> Column:
        line = rstrip(raw)
        s = strip(raw)
        out = acc["out"]
        indent = F.replace(F.regexp_extract(line, f"^{BLANK}*", 0), F.lit("\t"), F.lit("  "))
        last_blank = (F.size(out) == 0) | (F.element_at(out, -1) == "")
        added = (
            F.when(F.startswith(s, F.lit("```")), F.array(s))
            .when(acc["fence"], F.array(line))
            .when(s == "", F.when(last_blank, F.array().cast("array<string>")).otherwise(F.array(F.lit(""))))
            .otherwise(F.array(F.concat(indent, F.regexp_replace(s, r"[ \t]+", " "))))
        )
        fence = F.when(F.startswith(s, F.lit("```")), ~acc["fence"]).otherwise(acc["fence"])
        return F.struct(fence.alias("fence"), F.concat(out, added).alias("out"))

    start = F.struct(F.lit(False).alias("fence"), F.array().cast("array<string>").alias("out")).cast(state)
    kept = F.aggregate(F.split(unix_lines(c), "\n"), start, step, lambda acc: acc["out"])
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\n+|\n+$", "")


def unescaped_dollars(c: Column) -> Column:
    """Dollars that no backslash precedes; a backslash takes the character behind it along."""
    return F.regexp_count(F.regexp_replace(c, r"(?s)\\.", ""), F.lit(r"\$"))


# --- pieces of rendered markdown -------------------------------------------------------------


def escape_cell(c: Column) -> Column:
    return F.replace(normalize_target(c), F.lit("|"), F.lit("\\|"))


def markdown_table(rows: Column) -> Column:
    """A pipe table of an array of rows (arrays of cells); short rows are padded and long ones cut to the header."""
    header = F.get(rows, 0)
    width = F.size(header)
    body = F.when(F.size(rows) > 1, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(F.array(F.transform(header, lambda _: F.lit(""))))

    def row(cells: Column) -> Column:
        padded = F.slice(F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0)))), 1, width)
        return F.concat(F.lit("| "), F.array_join(F.transform(padded, escape_cell), " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.transform(header, lambda _: F.lit(":---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(row(header), rule), F.transform(body, row)), "\n")


def box_line(label: Column, box: Column) -> Column:
    """``- label: x=.., y=.., w=.., h=..`` of an array of four numbers."""
    return F.format_string("- %s: x=%s, y=%s, w=%s, h=%s", label, *[F.get(box, i).cast("string") for i in range(4)])


# How a formula's blanks are set, in this order (patterns and what takes their place).
FORMULA_SPACING = (
    (r"\.\s*\.\s*\.", r"\\dots"),
    (r"\s*_\s*\{\s*", "_{"),
    (r"\s*\^\s*\{\s*", "^{"),
    (r"\{\s*", "{"),
    (r"\s*\}", "}"),
    (r"\(\s*", "("),
    (r"\s*\)", ")"),
    (r"\s+,", ","),
    (r"\s+;", ";"),
    (r"(?<=\d)\s+(?=[A-Za-z](?![A-Za-z]))", ""),
)


def standalone_formula(c: Column) -> Column:
    """One formula, whatever its delimiters, with its blanks set, as a display block; one that is such a block stays, an empty one is empty."""
    spaced = normalize_target(c)
    for pattern, put in FORMULA_SPACING:
        spaced = F.regexp_replace(spaced, "(?U)" + pattern, put)

    def block(t: Column) -> Column:
        inline = F.startswith(t, F.lit("$")) & F.endswith(t, F.lit("$"))
        inner = F.when(inline, strip(F.btrim(t, F.lit("$")))).otherwise(t)
        return (
            F.when((t == "") | (F.startswith(t, F.lit("$$")) & F.endswith(t, F.lit("$$"))), t)
            .when(t.isNotNull(), normalize_target(F.concat(F.lit("$$\n"), inner, F.lit("\n$$"))))
        )

    return bind(normalize_target(spaced), block)


_TAGGED = r"(?s)<s_([^>]+)>(.*?)</s_\1>"


def _tagged(c: Column) -> Column:
    """The tagged values ``<s_name>value</s_name>`` of a text as an array of (name, value); the back-reference closes each tag."""
    names, values = (F.regexp_extract_all(c, F.lit(_TAGGED), F.lit(i)) for i in (1, 2))
    return F.arrays_zip(names.alias("name"), values.alias("value"))


def chart_block(c: Column) -> Column:
    """The tagged values of a chart string as a fenced block, a line each; boxes as their four numbers. Text without tags is only normalised."""

    def box(entry: Column) -> Column:
        def side(k: str) -> Column:
            own = F.filter(_tagged(entry), lambda t: t["name"] == k)
            return F.concat(F.lit(f"{k}="), F.coalesce(normalize_target(F.try_element_at(own, F.lit(-1))["value"]), F.lit("")))

        return F.when(F.size(_tagged(entry)) > 0, F.concat(F.lit("("), F.concat_ws(", ", *map(side, "xywh")), F.lit(")")))

    def line(t: Column) -> Column:
        boxes = F.array_join(F.array_compact(F.transform(F.filter(F.split(t["value"], "<sep/>"), lambda e: strip(e) != ""), box)), " | ")
        value = F.when(t["name"] == "bboxes", boxes).otherwise(normalize_target(F.replace(t["value"], F.lit("<sep/>"), F.lit(" | "))))
        return F.concat(t["name"], F.lit(": "), value)

    fenced = F.concat(F.lit("```chart\n"), F.array_join(F.transform(_tagged(c), line), "\n"), F.lit("\n```"))
    return F.when(F.size(_tagged(c)) > 0, fenced).otherwise(normalize_target(c))


def archive_stem(c: Column) -> Column:
    """The name of an archive member without folders and suffixes."""
    name = F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.regexp_replace(name, r"(?i)(?:\.gt|\.page)?\.(?:xml|txt|json|png|jpe?g|tiff?|bmp|gz)$", "")


def local_name(c: Column) -> Column:
    return F.regexp_replace(c, r"^\{[^}]*\}", "")


def parse_hub_uri(c: Column) -> Column:
    """Repository and prefix of ``hf://repository/prefix``; another scheme and a missing repository raise."""
    path = F.btrim(F.regexp_replace(c, "^hf://", ""), F.lit("/"))
    at = F.instr(path, "/")
    parts = F.struct(F.when(at > 0, F.substring(path, F.lit(1), at - 1)).otherwise(path).alias("repo"), F.when(at > 0, F.substring(path, at + 1, F.length(path))).otherwise("").alias("prefix"))
    fault = F.when(F.startswith(c, F.lit("hf://")), F.lit("no repository in the address: ")).otherwise(F.lit("unknown kind of address: "))
    good = F.startswith(c, F.lit("hf://")) & (path != "")
    return F.when(good, parts).when(c.isNotNull(), F.raise_error(F.concat(fault, c)).cast("struct<repo:string,prefix:string>"))


# The years of handwritten formulas that are test material.
TEST_YEARS = ("/2014", "2014-", "/2016", "2016-", "/2019", "2019-", "/2023", "2023-")


def split_of_path(c: Column, source: str | None = None) -> Column:
    """The split a file's path tells, train where it tells none. ``dev`` means validation as well; of ``crohme`` the test years are told by their folders or names."""
    low = F.lower(c)
    held = low.rlike(r"validation|/val|val\.parquet$|(^|[^a-z])(dev|val|valid)([^a-z]|$)")
    test = F.contains(low, F.lit("test"))
    if source == "crohme":
        test = reduce(lambda a, b: a | b, (F.contains(low, F.lit(y)) for y in TEST_YEARS), test)
    return F.when(held, "validation").when(test, "test").when(c.isNotNull(), "train")


def split_of_member(c: Column) -> Column:
    """The split that a folder of an archive member tells, train where none does."""
    low = F.lower(c)
    return F.when(low.rlike("/(validation|val)/"), "validation").when(F.contains(low, F.lit("/test/")), "test").when(c.isNotNull(), "train")


def shell_quote(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def corrupt_block(c: Column) -> Column:
    """``text, target, kind``: the first structure of a text that can be damaged, damaged and whole, and what was done to it.

    In this order: the first six table rows lose their bars, the first display formula its backslashes and a dollar at either end, the first
    three lines their order, a lone line its marks; a blank text stays.
    """
    some = F.filter(lines(c), lambda x: strip(x) != "")
    math = F.regexp_extract(c, r"(?s)\$\$(.+?)\$\$", 1)

    def kinds(rows: Column) -> Column:
        table = F.slice(F.filter(rows, lambda x: F.startswith(strip(x), F.lit("|")) & F.endswith(strip(x), F.lit("|"))), 1, 6)
        first = F.slice(rows, 1, 3)
        formula = F.concat(F.lit("$$"), strip(math), F.lit("$$"))

        def made(text: Column, target: Column, kind: str) -> Column:
            return F.struct(text.alias("text"), target.alias("target"), F.lit(kind).alias("kind"))

        return (
            F.when(F.size(rows) == 0, made(c, c, "identity"))
            .when(F.size(table) > 0, made(F.replace(F.array_join(table, "\n"), F.lit("|"), F.lit(" ")), F.array_join(table, "\n"), "table_delimiter_drop"))
            .when(math != "", made(F.replace(F.replace(formula, F.lit("\\"), F.lit("")), F.lit("$$"), F.lit("$")), formula, "display_math_break"))
            .when(F.size(rows) >= 2, made(F.array_join(F.reverse(first), "\n"), F.array_join(first, "\n"), "reading_order_swap"))
            .otherwise(made(F.replace(F.regexp_replace(F.get(rows, 0), f"{BLANK}+", " "), F.lit("#"), F.lit("")), F.get(rows, 0), "header_flatten"))
        )

    return F.when(c.isNotNull(), bind(some, kinds))
