"""Character forms (problem 2) and records (problem 1)."""

import unicodedata
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm.form import changed_values, normalise_column, to_form
from scriptorium.llm.records import collapse_records, fields_of, record_members, record_tuple, words_of

CASES = [
    ("Ｆull １", "Full 1", "width"), ("oﬃce", "office", "ligature"), ("café", "café", "compose"), ("so­ft", "soft", "invisible"), ("a​b﻿", "ab", "invisible"), ("a b c", "a b c", "blank"),
    ("quеuе", "queue", "script"), ("мотoр", "мотор", "script"), ("Νina", "Nina", "script"), ("a\u0000b", "ab", "invisible"), ("ﾊﾟ", "パ", "width"),
]
CLEAN = ["", "plain", "café", "тест", "λόγος", "α + β", "β-γ", "“quote” – dash…", "tab\tand\r\nline\u0085", "x²", "𝑥𝑦", "日本語テキスト", "Δ", "naïve œuvre"]


@pytest.mark.parametrize(("raw", "form", "kind"), CASES)
def test_faults_are_found_and_mended(raw, form, kind):
    got, kinds = to_form(raw)
    assert got == form and kind in kinds
    assert to_form(f"Some text before. {raw} and after") == (f"Some text before. {form} and after", kinds)


@pytest.mark.parametrize("text", CLEAN)
def test_good_text_stays(text):
    assert to_form(text) == (text, ())


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_form_is_stable_and_composed(text):
    form, _ = to_form(text)
    assert to_form(form)[0] == form and unicodedata.is_normalized("NFC", form)


def test_columns(spark):
    rows = spark.createDataFrame([("s1", "oﬃce", "  Src", "x"), ("s1", "oﬃce", "  Src", "y"), ("s2", "fine", None, "x"), ("s3", None, "src", "x"), ("s4", "long " * 50_000 + "​", "", "x")], "sample_id string, canonical_target string, source_id string, form string")
    got = sorted((r["field"], r["sample_id"]) for r in changed_values(rows, ["canonical_target", "source_id"]).collect())
    assert got == [("canonical_target", "s1"), ("canonical_target", "s4"), ("source_id", "s1")]
    out = {r["sample_id"]: (r["form"], r["form_kinds"]) for r in normalise_column(rows, "source_id").collect()}
    assert out["s1"] == ("  Src", ["blank"]) and out["s2"] == (None, []) and out["s4"] == ("", [])
    assert changed_values(rows.where("false"), ["source_id"]).count() == 0


LIST = "## Receipt Fields\n\n- total: 12.50\n- item: Ärger Box\n- item: Other"
SAME = [
    "## receipt fields\n\n* ITEM: other\n* item: ärger, box\n* Total: 12.50", "  ## RECEIPT FIELDS\r\n\r\n\r\n- **item:**  Other \r\n- **total:** 12.50\r\n- **item:** ÄRGER Box\r\n", "## Receipt Fields\ntotal: 12.50\nitem: Other\nitem: Ärger Box",
]
OTHER = ["## Receipt Fields\n\n- total: Ärger Box\n- item: 12.50\n- item: Other", "## Receipt Fields\n\n- total: 12.50\n- item: Ärger Box", "## Receipt Fields total: 12.50 item: Other item: Ärger Box", "- total: 12.50\n- item: Ärger Box\n- item: Other"]


def test_fields_in_any_order():
    assert {tuple(record_tuple(t)) for t in [LIST, *SAME]} == {tuple(record_tuple(LIST))}
    assert not {tuple(record_tuple(t)) for t in OTHER} & {tuple(record_tuple(LIST))}
    obj = '{"a b": "x", "c": 5, "d": "q\\"uo\\u0074e"}'
    assert record_tuple(obj) == record_tuple('{ "c" : "5",\n "D.": "Q uote,", "a-b": "X" }') != record_tuple('{"a b": "5", "c": "x", "d": "q uote"}')
    assert record_tuple(obj) == record_tuple("- c: 5\n- a b: x\n- d: q uote")
    # names have no bound
    assert record_tuple("Name of the person in charge: Ann\nCity: Rome") == record_tuple("City: Rome\nName of the person in charge: Ann")
    assert record_tuple(f"{'very long ' * 20}name: 1\nother: x") == record_tuple(f"other: x\n{'very long ' * 20}name: 1")
    assert fields_of("A line without a field\nother: x") is None and fields_of('{"a": {"b": "c"}}') is None and fields_of("one: field") is None


def test_words_and_order_count():
    assert record_tuple("One  two,\nTHREE!") == record_tuple("one two three") != record_tuple("two one three")
    assert record_tuple("Straße") == record_tuple("STRASSE")
    assert record_tuple("First para.\n\nSecond para.") != record_tuple("Second para.\n\nFirst para.")
    assert [record_tuple(t) for t in (None, "", " \n", "---", "$$\n\n$$")] == [None] * 5
    assert words_of("x_16+Y 3.5") == ["x", "16", "y", "3", "5"]


def test_groups_against_brute_force(spark):
    texts = [LIST, *SAME, *OTHER, "one two", "One, two", "one  two", None, "", "--", "x" * 300_000, "X" * 300_000]
    rows = [(f"s{i:02}", t, "clash") for i, t in enumerate(texts)] + [("s00", LIST, "again"), (None, LIST, "no id")]
    df = spark.createDataFrame(rows, "sample_id string, canonical_target string, record string")
    groups = defaultdict(set)
    for i, t, _ in rows:
        if i and record_tuple(t):
            groups[tuple(record_tuple(t))].add(i)
    want = {(min(g), m) for g in groups.values() for m in g if m != min(g)}
    assert {(r["first_id"], r["id"]) for r in record_members(df, hot=2).collect()} == want
    assert sorted((r["first_id"], r["copies"]) for r in collapse_records(df).collect()) == sorted((min(g), len(g)) for g in groups.values())
    assert record_members(df.where("false")).count() == 0
