"""SQL that gives the same rows as a query of this package, over whole tables."""

from __future__ import annotations

from ..functions.text import ASCII_DIGITS, OTHER_DIGITS

_BLANK = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200b}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _key(c: str) -> str:
    return f"nullif(upper(regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g')), '')"


def _alnum(c: str) -> str:
    return f"regexp_replace(lower(translate({c}, '{OTHER_DIGITS}', '{ASCII_DIGITS}')), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')"


P1_GROUPS = f"""
WITH RECURSIVE links AS (
  SELECT {_key("a")} AS u, {_key("b")} AS v FROM contact_matches
), pairs AS (
  SELECT u, v FROM links WHERE u IS NOT NULL AND v IS NOT NULL
  UNION SELECT v, u FROM links WHERE u IS NOT NULL AND v IS NOT NULL
), reach(id, other) AS (
  SELECT u, u FROM pairs
  UNION SELECT r.id, p.v FROM reach r JOIN pairs p ON p.u = r.other
), groups AS (
  SELECT id, min(other) AS group_id FROM reach GROUP BY id
)
"""

P1_FOUND = P1_GROUPS + f"""
, spelled AS (SELECT {_key("id")} AS k, min(id) AS as_is FROM contacts GROUP BY 1)
, named AS (SELECT group_id, coalesce(as_is, id) AS id FROM groups LEFT JOIN spelled ON k = id)
, least_of AS (SELECT group_id, min(id) AS first_id FROM named GROUP BY group_id)
SELECT first_id AS group_id, id FROM named JOIN least_of USING (group_id) WHERE id <> first_id
"""

_COPIES = f"""
WITH split AS (
  SELECT value_id, coalesce({_alnum("kind")}, '') AS k, coalesce({_alnum("label")}, '') AS l,
    list_sort([{_alnum("x")} FOR x IN regexp_split_to_array(coalesce(value, ''), '[;|/]') IF {_alnum("x")} <> '']) AS parts
  FROM labeled_values WHERE value_id IS NOT NULL
), firsts AS (
  SELECT value_id, min(value_id) OVER (PARTITION BY k, l, parts) AS first_id FROM split WHERE len(parts) > 0
)
"""

P2_FOUND = _COPIES + "SELECT DISTINCT first_id, value_id FROM firsts WHERE value_id <> first_id"

P2_RECORDS = _COPIES + "SELECT first_id AS value_id, count(DISTINCT value_id) AS copies FROM firsts GROUP BY first_id"

_FILLED = lambda c: f"CASE WHEN {_alnum(c)} <> '' AND regexp_replace(lower({c}), '[^\\p{{L}}]+', '', 'g') NOT IN ('unknown', 'na', 'none') THEN {c} END"

P3_FOUND = f"""
WITH stated AS (SELECT DISTINCT id, given, family, organization, phones, emails, store_id, updated FROM contacts)
, members AS (SELECT DISTINCT group_id, unnest(member_ids) AS id FROM contact_groups)
, logged AS (
  SELECT group_id, field, id, arg_max(v, (length({_alnum("v")}), v)) AS v FROM (
    SELECT group_id, field, destination_id AS id, {_FILLED("kept")} AS v FROM merge_conflicts
    UNION ALL SELECT group_id, field, source_id, {_FILLED("not_copied")} FROM merge_conflicts
  ) WHERE v IS NOT NULL AND id IS NOT NULL GROUP BY ALL
), names AS (
  SELECT m.group_id, f.field, m.id, updated, store_id, coalesce({_FILLED("f.value")}, l.v) AS value
  FROM members m JOIN stated s USING (id)
  CROSS JOIN LATERAL (VALUES ('given', given), ('family', family), ('organization', organization)) f(field, value)
  LEFT JOIN logged l ON l.group_id = m.group_id AND l.field = f.field AND l.id = m.id
), filled AS (
  SELECT group_id, field, id, updated, store_id, length({_alnum("value")}) AS complete FROM names WHERE value IS NOT NULL
  UNION ALL
  SELECT group_id, field, id, updated, store_id, len(list_distinct([x.normalized FOR x IN v IF x.normalized IS NOT NULL]))
  FROM (SELECT m.group_id, 'phones' AS field, m.id, updated, store_id, phones AS v FROM members m JOIN stated USING (id)
        UNION ALL SELECT m.group_id, 'emails', m.id, updated, store_id, emails FROM members m JOIN stated USING (id))
), judged AS (
  SELECT group_id, field, id, complete, coalesce(updated, TIMESTAMP '0001-01-01') AS updated, coalesce(trust_rank, 2147483647) AS trust
  FROM filled LEFT JOIN stores USING (store_id) WHERE complete > 0
)
SELECT group_id, field, id AS contact_id FROM judged a WHERE NOT EXISTS (
  SELECT 1 FROM judged b WHERE b.group_id = a.group_id AND b.field = a.field AND b.id <> a.id
    AND NOT (a.complete > b.complete AND a.updated > b.updated AND a.trust < b.trust))
"""

P5_FOUND = """
WITH m AS (SELECT DISTINCT asset_id, bits FROM phash_entries WHERE bits IS NOT NULL AND asset_id IS NOT NULL)
SELECT DISTINCT a.asset_id AS asset_a, b.asset_id AS asset_b FROM m a JOIN m b
ON a.asset_id < b.asset_id AND bit_count(xor(a.bits, b.bits)) <= 6
"""

P5_CLASSES = """
WITH m AS (SELECT DISTINCT asset_id AS asset, bits AS class_bits FROM phash_entries WHERE bits IS NOT NULL AND asset_id IS NOT NULL),
p AS (SELECT DISTINCT class_bits FROM m),
l AS (SELECT a.class_bits, count(*) AS n FROM p a JOIN p b ON a.class_bits <> b.class_bits AND bit_count(xor(a.class_bits, b.class_bits)) <= 6 GROUP BY 1)
SELECT asset, class_bits, coalesce(n, 0) AS n_links FROM m LEFT JOIN l USING (class_bits)
"""

P5_TEXTS = """
WITH words AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{Nd}]+') IF x <> ''] AS w FROM documents WHERE doc_id IS NOT NULL),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END)) AS s FROM words WHERE len(w) > 0),
classes AS (SELECT s, min(doc_id) AS class_id, len(s) AS n FROM sets GROUP BY s),
tokens AS (SELECT class_id, n, unnest(s) AS token FROM classes),
shared AS (SELECT a.class_id AS x, b.class_id AS y, count(*) AS c, any_value(a.n) AS nx, any_value(b.n) AS ny FROM tokens a JOIN tokens b ON a.token = b.token AND a.class_id <> b.class_id GROUP BY 1, 2),
links AS (SELECT x, count(*) AS k FROM shared WHERE c >= 0.8 * (nx + ny - c) - 1e-9 GROUP BY x)
SELECT DISTINCT doc_id, class_id, coalesce(k, 0) AS n_links FROM sets JOIN classes USING (s) LEFT JOIN links ON x = class_id
"""

# The sources out of reach are the same for any usual way of counting tokens; here runs of letters, digits and single marks.
P7_FOUND = """
WITH sized AS (
  SELECT source, len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{M}]{1,4}|\\p{Nd}|[^\\s\\p{L}\\p{M}\\p{Nd}]')) AS n FROM documents
), whole AS (SELECT sum(n) AS total FROM sized)
, had AS (SELECT source, sum(n) AS n FROM sized GROUP BY source)
SELECT t.source FROM mix_targets t CROSS JOIN whole LEFT JOIN had h ON h.source = t.source
WHERE t.target_share * total > coalesce(h.n, 0) * t.max_repeats
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND,
        "p1_groups": P1_GROUPS + "SELECT group_id, count(*) AS members FROM groups GROUP BY group_id",
        "p2_found": P2_FOUND,
        "p2_records": P2_RECORDS,
        "p3_found": P3_FOUND,
        "p5_found": P5_FOUND,
        "p5_classes": P5_CLASSES,
        "p5_texts": P5_TEXTS,
        "p7_found": P7_FOUND,
    }
