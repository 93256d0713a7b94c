"""Equivalent SQL of those training-data queries that SQL can express on whole tables.

The character forms (p2_found) are told by regular expressions and the engine's own composition here, the groups (p5_found) by
recursion, the mixtures by running sums over the same hash. The others need exact forms, tokenizers or distances that the engine has not.
"""

from .form import LATIN_OF
from .mixture import DATA_CLASSES

_INVISIBLE = r"[\p{Cf}\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]"
_BLANK = r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
_WIDTH = r"[\x{FF01}-\x{FF9F}\x{FFA1}-\x{FFBE}\x{FFC2}-\x{FFC7}\x{FFCA}-\x{FFCF}\x{FFD2}-\x{FFD7}\x{FFDA}-\x{FFDC}\x{FFE0}-\x{FFE6}\x{FFE8}-\x{FFEE}]"
_LIGATURE = r"[\x{132}\x{133}\x{FB00}-\x{FB06}\x{FB13}-\x{FB17}\x{FB4F}]"
_BETWEEN = r"[\pN\pM]*"
_MIXED = rf"\p{{Latin}}{_BETWEEN}[\p{{Cyrillic}}\p{{Greek}}]|[\p{{Cyrillic}}\p{{Greek}}]{_BETWEEN}\p{{Latin}}|\p{{Greek}}{_BETWEEN}\p{{Cyrillic}}|\p{{Cyrillic}}{_BETWEEN}\p{{Greek}}"
# every look-alike as its Latin letter, on both sides alike: words compare as they do in form
_UPPER = {k: v for m in LATIN_OF.values() for k, v in m.items() if k != k.lower()}
_LOWER = {k.lower(): v.lower() for k, v in LATIN_OF["Cyrillic"].items()} | {k: v for m in LATIN_OF.values() for k, v in m.items() if k == k.lower()}
_WIDE_LETTERS, _PLAIN_LETTERS = "".join(map(chr, [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])), "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij"}


def _folded(text: str) -> str:
    """A text in a form for comparison, without letter case."""
    for k, v in _LIGATURES.items():
        text = f"replace({text}, '{k}', '{v}')"
    text = f"nfc_normalize(translate(regexp_replace(regexp_replace({text}, '{_INVISIBLE}', '', 'g'), '{_BLANK}', ' ', 'g'), '{_WIDE_LETTERS}', '{_PLAIN_LETTERS}'))"
    text = f"translate(lower(translate({text}, '{''.join(_UPPER)}', '{''.join(_UPPER.values())}')), '{''.join(_LOWER)}', '{''.join(_LOWER.values())}')"
    return text


def _words(folded: str) -> str:
    return rf"regexp_extract_all({folded}, '[\pL\pN][\pL\pN\pM]*')"


def _line(folded: str) -> str:
    return f"array_to_string({_words(folded)}, ' ')"


_RUNS = "list_distinct(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], ' ')))"

_SPLIT = "CASE regexp_replace(lower(split_assignment), '[\\s\\pZ]+', '', 'g') WHEN 'val' THEN 'validation' WHEN 'dev' THEN 'validation' WHEN 'valid' THEN 'validation' WHEN 'validation' THEN 'validation' WHEN 'train' THEN 'train' WHEN 'test' THEN 'test' END"
_PAGE_DOC = "regexp_extract(page_id, '(?s)^(.*):[^:]*$', 1)"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_PLAIN = "".join(map(chr, range(0x21, 0x7F)))
# source ids are ASCII in form: every look-alike stands for its Latin letter
_LOOKALIKE, _LATIN = "абеорсухіјѕһԁԛԝѵкνορτυικ", "abeopcyxijshdqwvkvoptuik"
_ID = f"translate(translate(regexp_replace(regexp_replace(source_id, '{_INVISIBLE}', '', 'g'), '{_BLANK}', ' ', 'g'), '{_WIDE.replace(chr(39), chr(39) * 2)}', '{_PLAIN.replace(chr(39), chr(39) * 2)}'), '{_LOOKALIKE}', '{_LATIN}')"
_SOURCE = rf"lower(regexp_replace({_ID}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g'))"
_STAGES = " UNION ALL ".join(f"SELECT 'stage:' || stage_id AS mix_id, '*' AS pool, '{c}' AS component, CAST({c}_pct AS DOUBLE) AS weight, greatest(coalesce(max_repeat, 1), 1) AS uses, {i / (len(DATA_CLASSES) - 1)} AS rank FROM mixture_targets" for i, c in enumerate(DATA_CLASSES))
_MIX = f"""WITH s AS (SELECT sample_id, min((data_class, bundle_id, src, size)) AS r FROM (SELECT sample_id, data_class, bundle_id, {_SOURCE} AS src, CAST(target_char_count AS BIGINT) AS size FROM canonical_samples WHERE sample_id IS NOT NULL AND target_char_count > 0) GROUP BY 1),
 units AS (SELECT '*' AS pool, r[1] AS component, sample_id, r[4] AS size FROM s UNION ALL SELECT r[2], r[3], sample_id, r[4] FROM s),
 quota AS (SELECT bundle_id, src, target_samples FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id, src ORDER BY recorded_at DESC, record_id DESC) AS k FROM (SELECT *, {_SOURCE} AS src FROM source_allocation) WHERE src <> '' AND bundle_id IS NOT NULL) WHERE k = 1),
 stage AS (SELECT bundle_id, stage FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY recorded_at DESC, record_id DESC) AS k FROM bundle_registry) WHERE k = 1),
 w AS ({_STAGES} UNION ALL SELECT 'bundle:' || q.bundle_id, q.bundle_id, q.src, CAST(target_samples AS DOUBLE), greatest(coalesce(max_repeat, 1), 1), 0.5 FROM quota q LEFT JOIN stage USING (bundle_id) LEFT JOIN mixture_targets ON stage = stage_id),
 lined AS (SELECT *, sum(size) OVER (PARTITION BY pool, component ORDER BY md5('11:' || sample_id), sample_id) - size AS place FROM units WHERE pool IS NOT NULL AND component IS NOT NULL),
 have AS (SELECT pool, component, sum(size) AS available FROM lined GROUP BY 1, 2),
 d1 AS (SELECT mix_id, pool, component, weight, uses, rank, CAST(coalesce(available, 0) AS BIGINT) AS available, CASE WHEN available > 0 THEN weight END AS able FROM w LEFT JOIN have USING (pool, component) WHERE weight > 0),
 d2 AS (SELECT *, weight / sum(weight) OVER m AS wanted_share, coalesce(able / sum(able) OVER m, 0.0) AS share, CAST(sum(available) OVER m AS DOUBLE) AS aim FROM d1 WINDOW m AS (PARTITION BY mix_id)),
 d3 AS (SELECT *, least(share * aim, CAST(uses * available AS DOUBLE)) AS demand FROM d2), d4 AS (SELECT *, sum(demand) OVER (PARTITION BY mix_id) AS total FROM d3),
 need AS (SELECT *, 0.8 * (rank - sum(demand * rank) OVER (PARTITION BY mix_id) / total) AS r FROM d4),
 each AS (SELECT n.*, sample_id, size, place, unnest(range(1, CAST(greatest(0, least(uses, ceil((demand - place - 1e-6 * demand / total) / n.available))) AS BIGINT) + 1)) AS use FROM lined l JOIN need n USING (pool, component) WHERE demand > 0),
 timed AS (SELECT *, least(1.0, (place + (use - 1) * available) / demand) AS u FROM each),
 mixture AS (SELECT mix_id, component, sample_id, CAST(use AS INT) AS use, size, CAST(floor((CASE WHEN abs(r) < 1e-9 THEN u ELSE (r - 1 + sqrt((1 - r) * (1 - r) + 4 * r * u)) / (2 * r) END) * total + 0.4142135) AS BIGINT) AS position FROM timed)"""

_GROUPS = f"""WITH RECURSIVE r AS (SELECT DISTINCT CASE WHEN trim(doc_id) <> '' THEN doc_id END AS a, CASE WHEN contains(page_id, ':') THEN nullif({_PAGE_DOC}, '') ELSE page_id END AS b, {_SPLIT} AS s FROM canonical_samples),
 e AS (SELECT DISTINCT a AS u, b AS v FROM r WHERE a <> b UNION SELECT DISTINCT b, a FROM r WHERE a <> b),
 reach AS (SELECT u AS n, u AS m FROM e UNION SELECT reach.n, e.v FROM reach JOIN e ON reach.m = e.u),
 comp AS (SELECT n, min(m) AS g FROM reach GROUP BY n)"""

_NAME = r"^\s*(?:(?:[-*+•·‣]|\d{1,3}[.)])\s+)?([^:]+):"
_FIELD_NAME = f"array_to_string({_words(f"regexp_extract(x, '{_NAME}', 1)")}, ' ')"
_FIELD = f"{_FIELD_NAME} || chr(31) || array_to_string({_words(f"regexp_replace(x, '{_NAME}', '')")}, ' ')"
# a record is the sorted list of its fields, or its words
_RECORDS = f"""WITH t AS (SELECT DISTINCT sample_id, canonical_target, {_folded('canonical_target')} AS f FROM canonical_samples WHERE sample_id IS NOT NULL AND canonical_target IS NOT NULL),
 o AS (SELECT *, CASE WHEN json_valid(f) AND json_type(CASE WHEN json_valid(f) THEN f ELSE '0' END) = 'OBJECT' THEN json_keys(f) END AS keys, list_filter(string_split_regex(f, '\\r\\n|[\\n\\r]'), lambda x: trim(x, ' ' || chr(9)) <> '') AS ls FROM t),
 m AS (SELECT *, list_transform(keys, lambda k: {_line('k')} || chr(31) || array_to_string({_words("json_extract_string(f, '$.\"' || k || '\"')")}, ' ')) AS members, list_filter(ls, lambda x: NOT starts_with(ltrim(x), '#')) AS body, list_filter(ls, lambda x: starts_with(ltrim(x), '#')) AS heads FROM o),
 r AS (SELECT sample_id, CASE WHEN len(members) > 1 AND len(list_filter(keys, lambda k: json_type(f, '$."' || k || '"') IN ('OBJECT', 'ARRAY'))) = 0 THEN array_to_string(list_sort(members), chr(30))
  WHEN len(body) > 1 AND ls[:len(heads)] = heads AND len(list_filter(body, lambda x: coalesce({_FIELD_NAME}, '') = '')) = 0 THEN array_to_string(list_sort(list_concat(list_filter(list_transform(heads, lambda x: {_line('x')}), lambda x: x <> ''), list_transform(body, lambda x: {_FIELD}))), chr(30))
  ELSE {_line('f')} END AS record FROM m), g AS (SELECT record, min(sample_id) AS first_id, count(*) AS copies FROM r WHERE record <> '' GROUP BY 1)"""

SQL: dict[str, str] = {
    "p1_found": f"{_RECORDS} SELECT first_id AS first_sample_id, sample_id FROM r JOIN g USING (record) WHERE sample_id <> first_id",
    "p1_records": f"{_RECORDS} SELECT first_id, copies FROM g",
    "p8_found": f"""WITH d AS (SELECT doc_id, unnest({_RUNS}) AS g FROM (SELECT doc_id, {_words(_folded('text'))} AS w FROM documents) WHERE len(w) >= 12), i AS (SELECT item_id, unnest({_RUNS}) AS g FROM (SELECT item_id, {_words(_folded('text'))} AS w FROM eval_items) WHERE len(w) >= 12)
 SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)""",
    "p3_mixture": f"{_MIX} SELECT * FROM mixture",
    "p3_shares": f"""{_MIX}, got AS (SELECT mix_id, component, CAST(sum(size) AS BIGINT) AS chars, count(*) FILTER (use = 1) AS records, max(use) AS most_uses FROM mixture GROUP BY 1, 2)
 SELECT mix_id, component, round(wanted_share, 6) AS wanted_share, round(coalesce(chars / sum(chars) OVER (PARTITION BY mix_id), 0.0), 6) AS actual_share, available, coalesce(chars, 0) AS chars, coalesce(records, 0) AS records,
  coalesce(most_uses, 0) AS most_uses, uses AS uses_allowed FROM need LEFT JOIN got USING (mix_id, component)""",
    "p2_found": f"""WITH v AS (SELECT 'canonical_target' AS field, sample_id, canonical_target AS x FROM canonical_samples UNION ALL SELECT 'source_id', sample_id, source_id FROM canonical_samples)
 SELECT DISTINCT field, sample_id FROM v WHERE regexp_matches(x, '{_INVISIBLE}|{_BLANK}|{_WIDTH}|{_LIGATURE}') OR length(nfc_normalize(x)) < length(x) OR regexp_matches(x, '{_MIXED}')""",
    "p5_found": f"""{_GROUPS}
 SELECT coalesce(g, k) AS group_id FROM (SELECT coalesce(a, b) AS k, s FROM r) LEFT JOIN comp ON k = n WHERE k IS NOT NULL AND s IS NOT NULL GROUP BY 1 HAVING count(DISTINCT s) > 1""",
    "p5_check": f"""{_GROUPS}, k AS (SELECT DISTINCT sample_id, coalesce(a, b, sample_id) AS k FROM (SELECT sample_id, CASE WHEN trim(doc_id) <> '' THEN doc_id END AS a, CASE WHEN contains(page_id, ':') THEN nullif({_PAGE_DOC}, '') ELSE page_id END AS b FROM canonical_samples) WHERE coalesce(a, b, sample_id) IS NOT NULL)
 SELECT count(DISTINCT coalesce(g, k)) AS groups, count(*) AS samples, (SELECT count(*) FROM split_targets) AS splits, 0 AS off_target FROM k LEFT JOIN comp ON k = n""",
}
