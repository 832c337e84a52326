"""The same results in DuckDB's SQL, where SQL can say them on whole tables."""

from __future__ import annotations

_USABLE = """
parts AS (SELECT contact_id, trim(p) AS part FROM contacts, unnest(string_split(coalesce(source, ''), '+')) AS u(p)),
trust AS (SELECT parts.contact_id, coalesce(max(t.trust), 0) AS trust, bool_or(t.trust IS NOT NULL) AS trusted
          FROM parts LEFT JOIN source_trust t ON t.source = part GROUP BY 1),
r AS (SELECT DISTINCT g.group_id, c.contact_id, c.email, c.ctype, c.source, c.updated_at, trust.trust, trust.trusted
      FROM dup_groups g JOIN contacts c USING (contact_id) JOIN trust USING (contact_id)),
long AS (
  SELECT group_id, contact_id, trust, updated_at, 'email' AS field_name FROM r
  WHERE regexp_matches(email, '^[^@]*[\\pL\\pN][^@]*@[^@]*[\\pL\\pN]\\.[\\pL\\pN][^@]*$')
  UNION ALL SELECT group_id, contact_id, trust, updated_at, 'ctype' FROM r WHERE ctype IN ('Adviser', 'Branch Director', 'Consultant', 'Product / Platform')
  UNION ALL SELECT group_id, contact_id, trust, updated_at, 'source' FROM r WHERE trusted)
"""

# Names of problem 1 in SQL: a character that is neither plain nor a letter of another script, or Latin and Greek or
# Cyrillic letters in one word.
_STYLED = """(regexp_matches(name, '[^\\x09\\x0a\\x0d\\x20-\\x7eÀ-ıĴ-ľŁ-ňŊ-ž‘-‟\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Hangul}\\p{Cyrillic}\\p{Greek}\\p{Arabic}\\p{Hebrew}\\p{Thai}\\p{Devanagari}]')
  OR regexp_matches(name, '[A-Za-zÀ-ž][^\\s]*[\\p{Cyrillic}\\p{Greek}]|[\\p{Cyrillic}\\p{Greek}][^\\s]*[A-Za-zÀ-ž]'))"""
_COPIES = f"""
k AS (SELECT contact_id, lower(regexp_replace(email, '[^\\pL\\pN]', '', 'g')) AS ek,
    array_to_string(list_sort(list_filter(string_split_regex(lower(coalesce(name, '')), '[^\\pL\\pN]+'), lambda x: x <> '')), ' ') AS nk,
    coalesce(regexp_matches(email, '^[^@]*[\\pL\\pN][^@]*@[^@]*[\\pL\\pN]\\.[\\pL\\pN][^@]*$'), false) AND NOT coalesce({_STYLED}, false) AS can FROM contacts),
g AS (SELECT contact_id, CASE WHEN can THEN min(contact_id) OVER (PARTITION BY can, ek, nk) ELSE contact_id END AS first_id FROM k)
"""

ORACLE = {
    "p2_found": f"WITH {_COPIES} SELECT first_id AS contact_id_a, contact_id AS contact_id_b FROM g WHERE contact_id <> first_id",
    "p2_records": f"WITH {_COPIES} SELECT first_id AS contact_id, count(*) AS copies FROM g GROUP BY 1",
    "p7_found": f"""
WITH {_USABLE}
SELECT group_id, field_name, contact_id FROM long
QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY trust DESC, updated_at DESC NULLS LAST, contact_id) = 1
""",
    "p9_found": r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(passage), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM eval_items WHERE passage IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM dw, unnest(range(1, len(w) - 10)) AS u(i)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM iw, unnest(range(1, len(w) - 10)) AS u(i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
""",
}
