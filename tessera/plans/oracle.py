"""The core queries in DuckDB's SQL."""

from __future__ import annotations

from ..functions.emails import DISPOSABLE, FREE_MAIL, PLACEHOLDER_DOMAINS, PLACEHOLDER_LOCALS, ROLES
from ..functions.extract import PROSE, SUFFIXES
from ..functions.names import HONORIFICS, SURNAMES


def _list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_E = "[e1, e2, e3, e4, e5]"
_C = f"""
c AS (
  SELECT *, len(list_filter({_E}, lambda s: s IS NOT NULL AND s NOT IN ('', 'Not Invited'))) AS n_invited,
    len(list_filter({_E}, lambda s: s = 'Attended')) AS n_attended, coalesce(nullif(trim(firm), ''), 'Unknown') AS f
  FROM contacts WHERE name IS NOT NULL AND trim(name) <> ''),
d AS (
  SELECT *, CASE WHEN n_attended > 0 THEN 'Event attendee' WHEN met = 'Yes' THEN 'Met (no event)' WHEN n_invited > 0 THEN 'Invited only'
    WHEN mailsent = 'Yes' OR linkedin = 'Yes' THEN 'Contacted only' ELSE 'Not yet contacted' END AS engagement,
    date_diff('day', lastmtg, DATE '2026-08-15') AS days
  FROM c),
n AS (
  SELECT d.*, nullif(concat_ws(', ', CASE WHEN e1 = 'Attended' THEN (SELECT short_name FROM event_slots WHERE slot = 1) END,
    CASE WHEN e2 = 'Attended' THEN (SELECT short_name FROM event_slots WHERE slot = 2) END,
    CASE WHEN e3 = 'Attended' THEN (SELECT short_name FROM event_slots WHERE slot = 3) END,
    CASE WHEN e4 = 'Attended' THEN (SELECT short_name FROM event_slots WHERE slot = 4) END,
    CASE WHEN e5 = 'Attended' THEN (SELECT short_name FROM event_slots WHERE slot = 5) END), '') AS attended_events
  FROM d)
"""
_LONG = "SELECT contact_id, u.slot, [e1, e2, e3, e4, e5][u.slot] AS status FROM c, (SELECT unnest([1, 2, 3, 4, 5]) AS slot) u"


def _strip(c: str) -> str:
    return f"nullif(regexp_replace(translate({c}, chr(160), ' '), '^\\s+|\\s+$', '', 'g'), '')"


_SHEETS = f"""
ml0 AS (SELECT {', '.join(f'{_strip(x)} AS {x}' for x in ('name', 'email', 'firm', 'oct_event', 'met', 'invested', 'invited', 'accepted', 'invited_alt'))}, last_meeting, src_rank, row_no FROM meeting_list),
ml1 AS (SELECT *, CASE WHEN accepted IN ('Declined', 'Not Available') THEN 'Declined' WHEN accepted = 'Bounced back' THEN 'No Reply'
    WHEN invited = '1' OR invited_alt = '1' THEN 'No Reply' ELSE 'Not Invited' END AS x2, CASE WHEN met = 'yes' THEN 'Yes' ELSE met END AS m
  FROM ml0 WHERE name IS NOT NULL AND NOT starts_with(lower(name), 'total')),
ml AS (SELECT src_rank, row_no, name, CASE WHEN lower(email) NOT IN ('n/a', 'na') THEN email END AS email, coalesce(firm, 'Unknown') AS firm, m AS met, last_meeting AS lastmtg,
    CASE WHEN m = 'Yes' THEN 1 ELSE 0 END AS mtgs, CASE WHEN invested = '?' THEN 'TBC' ELSE invested END AS invested, CAST(NULL AS VARCHAR) AS mailsent,
    CASE oct_event WHEN 'Yes' THEN 'Attended' WHEN 'No' THEN 'No Reply' WHEN 'Not Available' THEN 'Declined' ELSE 'Not Invited' END AS e1,
    CASE WHEN invited = 'Macro Lunch' AND x2 = 'No Reply' THEN 'Not Invited' WHEN invited = 'Overseas' THEN 'Declined' WHEN invited = 'TBC' THEN 'Invited' ELSE x2 END AS e2,
    CASE WHEN invited = 'Macro Lunch' THEN 'Invited' ELSE 'Not Invited' END AS e3,
    nullif(concat_ws('; ', CASE WHEN accepted = 'Not Available' THEN 'not available' END, CASE WHEN accepted = 'Bounced back' THEN 'email bounced back' END, CASE WHEN invited = 'Overseas' THEN 'Overseas' END), '') AS notes,
    'Meeting List' AS source
  FROM ml1),
me AS (SELECT src_rank, row_no, {_strip('name')} AS name, {_strip('email')} AS email, coalesce({_strip('firm')}, 'Unknown') AS firm, CASE WHEN meeting_date IS NOT NULL THEN 'Yes' END AS met,
    meeting_date AS lastmtg, CASE WHEN meeting_date IS NOT NULL THEN 1 ELSE 0 END AS mtgs, CAST(NULL AS VARCHAR) AS invested,
    CASE WHEN starts_with({_strip('sent')}, 'Yes') THEN 'Yes' ELSE 'No' END AS mailsent, 'Not Invited' AS e1, 'Not Invited' AS e2, 'Not Invited' AS e3,
    CASE WHEN {_strip('replied')} = 'Yes' THEN 'Replied to mass email' END AS notes, 'Mass Email' AS source
  FROM mass_email WHERE {_strip('name')} IS NOT NULL AND NOT starts_with(lower({_strip('name')}), 'total')),
u AS (SELECT *, src_rank::BIGINT * 1000000000000 + row_no AS ord FROM (SELECT * FROM ml UNION ALL SELECT * FROM me)),
k AS (SELECT *, coalesce(nullif(regexp_replace(lower(name), '[^a-z]', '', 'g'), ''), 'row ' || ord) AS key FROM u),
cl AS (SELECT *, CASE WHEN firm = 'Unknown' OR t_u IS NULL OR first_f < t_u THEN firm ELSE 'Unknown' END AS cluster_firm
  FROM (SELECT *, min(ord) OVER (PARTITION BY key, firm) AS first_f, min(CASE WHEN firm = 'Unknown' THEN ord END) OVER (PARTITION BY key) AS t_u FROM k))
"""

_TITLES, _SURNAMES, _FREE, _ROLES = (_list(x) for x in (HONORIFICS, SURNAMES, FREE_MAIL, ROLES))


def _fold(c: str) -> str:
    """Accents off; wide, mathematical and circled letters by their places in the code; wide blanks as blanks; the rest off."""
    u = "unicode(ch)"
    one = f"""CASE WHEN {u} BETWEEN 65281 AND 65374 THEN chr({u} - 65248) WHEN {u} BETWEEN 119808 AND 120483 THEN chr((65 + ({u} - 119808) % 52 + CASE WHEN ({u} - 119808) % 52 >= 26 THEN 6 ELSE 0 END)::INT)
  WHEN {u} BETWEEN 9398 AND 9423 THEN chr({u} - 9333) WHEN {u} BETWEEN 9424 AND 9449 THEN chr({u} - 9327) WHEN {u} IN (160, 8239, 8287, 12288) OR {u} BETWEEN 8192 AND 8202 THEN ' ' ELSE ch END"""
    return f"regexp_replace(array_to_string(list_transform(string_split(strip_accents({c}), ''), lambda ch: {one}), ''), '[^\\x00-\\x7f]', '', 'g')"


def _tokens(c: str) -> str:
    text = _fold(f"regexp_replace(coalesce({c}, ''), '[(\\[\"“].*?[)\\]\"”]', ' ', 'g')")
    return f"list_filter(list_transform(string_split_regex({text}, '[^A-Za-z]+'), lambda x: lower(x)), lambda x: x <> '' AND x NOT IN {_TITLES})"


_NAMES = f"""
t AS (SELECT contact_id, contact_id AS id, name, firm, ctype, email, {_tokens('name')} AS toks FROM contacts),
s0 AS (SELECT *, len(toks) AS n, coalesce(nullif(list_position(list_transform(toks, lambda x: x IN {_SURNAMES}), true), 0), len(toks)) AS sp FROM t),
s AS (SELECT *, CASE WHEN n >= 2 THEN toks[sp] END AS sur, CASE WHEN n >= 2 THEN list_concat(toks[1:sp - 1], toks[sp + 1:]) END AS given FROM s0)
"""
_MADE = """
v AS (SELECT *, toks[1] AS a, toks[-1] AS z, toks[2] AS b, given[1] AS g1, array_to_string(given, '') AS gg FROM s),
w AS (SELECT *, n >= 2 AND a <> z AS two, n >= 2 AND a <> b AS mid, n >= 2 AS many FROM v),
p AS (SELECT * EXCLUDE (made), made.p AS pattern, made.l AS local FROM (SELECT *, unnest([
  {'p': 'first.last', 'l': CASE WHEN two THEN a || '.' || z END}, {'p': 'firstlast', 'l': CASE WHEN two THEN a || z END},
  {'p': 'first_last', 'l': CASE WHEN two THEN a || '_' || z END}, {'p': 'first-last', 'l': CASE WHEN two THEN a || '-' || z END},
  {'p': 'f.last', 'l': CASE WHEN two THEN a[1] || '.' || z END}, {'p': 'flast', 'l': CASE WHEN two THEN a[1] || z END},
  {'p': 'first.l', 'l': CASE WHEN two THEN a || '.' || z[1] END}, {'p': 'firstl', 'l': CASE WHEN two THEN a || z[1] END},
  {'p': 'fl', 'l': CASE WHEN two THEN a[1] || z[1] END}, {'p': 'last.first', 'l': CASE WHEN two THEN z || '.' || a END},
  {'p': 'lastfirst', 'l': CASE WHEN two THEN z || a END}, {'p': 'lastf', 'l': CASE WHEN two THEN z || a[1] END},
  {'p': 'first.mid', 'l': CASE WHEN mid THEN a || '.' || b END}, {'p': 'firstmid', 'l': CASE WHEN mid THEN a || b END},
  {'p': 'given.sur', 'l': CASE WHEN many THEN g1 || '.' || sur END}, {'p': 'givensur', 'l': CASE WHEN many THEN g1 || sur END},
  {'p': 'allgiven.sur', 'l': CASE WHEN many THEN gg || '.' || sur END}, {'p': 'allgivensur', 'l': CASE WHEN many THEN gg || sur END},
  {'p': 'sur.allgiven', 'l': CASE WHEN many THEN sur || '.' || gg END}, {'p': 'surallgiven', 'l': CASE WHEN many THEN sur || gg END},
  {'p': 'f.sur', 'l': CASE WHEN many THEN g1[1] || '.' || sur END}, {'p': 'fsur', 'l': CASE WHEN many THEN g1[1] || sur END},
  {'p': 'first', 'l': a}, {'p': 'last', 'l': z},
  {'p': 'alltokens', 'l': CASE WHEN many THEN array_to_string(toks, '') END}, {'p': 'alltokens.', 'l': CASE WHEN many THEN array_to_string(toks, '.') END},
  {'p': 'initials+last', 'l': CASE WHEN many THEN array_to_string(list_transform(toks[1:n - 1], lambda x: x[1]), '') || z END}]) AS made FROM w) WHERE made.l IS NOT NULL)
"""
_TIDY = "lower(regexp_replace(email, '^\\s+|\\s+$', '', 'g'))"
_AWARE = "pattern IN ('given.sur', 'givensur', 'allgiven.sur', 'allgivensur', 'sur.allgiven', 'surallgiven', 'f.sur', 'fsur')"
# personal addresses: what stands after the first @ is the domain
_LEARN = f"""
{_NAMES}, {_MADE},
m0 AS (SELECT id, {_TIDY} AS e FROM t WHERE contains(email, '@')),
m AS (SELECT id, split_part(e, '@', 1) AS actual, regexp_extract(e, '@(.*)$', 1) AS domain FROM m0),
r AS (SELECT m.*, s.toks, s.n AS nt FROM m JOIN s USING (id) WHERE domain NOT IN {_FREE} AND NOT (lower(actual) IN {_ROLES} OR string_split_regex(lower(actual), '[.\\-_+]')[1] IN {_ROLES})),
dn AS (SELECT domain, count(*) AS n FROM r GROUP BY 1),
sc AS (SELECT r.domain, p.pattern, count(*) AS attempts, count(*) FILTER (p.local = r.actual) AS hits, any_value(dn.n) AS n FROM r JOIN p USING (id) JOIN dn ON dn.domain = r.domain GROUP BY 1, 2),
sf AS (SELECT domain, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS suffix_rate FROM (
  SELECT domain, (starts_with(actual, array_to_string(toks, '')) AND regexp_full_match(substr(actual, length(array_to_string(toks, '')) + 1), '[a-z]{{0,4}}'))
    OR (nt >= 3 AND starts_with(actual, toks[1] || toks[-1]) AND regexp_full_match(substr(actual, length(toks[1] || toks[-1]) + 1), '[a-z]{{0,4}}')) AS hit
  FROM r WHERE nt >= 2) GROUP BY 1),
rk AS (SELECT *, hits::DOUBLE / attempts AS rate, row_number() OVER (PARTITION BY domain ORDER BY hits::DOUBLE / attempts DESC, {_AWARE} DESC, pattern) AS rank FROM sc WHERE attempts >= greatest(1, n // 2)),
md AS (SELECT dn.domain, dn.n AS samples, max(pattern) FILTER (rank = 1 AND rate > 0) AS pattern, max(rate) FILTER (rank = 1) AS rate,
    string_agg(pattern, ',' ORDER BY rank) FILTER (rank BETWEEN 2 AND 5 AND rate > 0) AS runners_up
  FROM dn LEFT JOIN rk ON rk.domain = dn.domain GROUP BY 1, 2),
mo AS (SELECT domain, pattern, CASE WHEN odd THEN sx ELSE rx END AS confidence, samples, NOT odd AS predictable, coalesce(runners_up, '') AS runners_up FROM (
  SELECT md.*, coalesce(rate, 0.0) AS rx, coalesce(suffix_rate, 0.0) AS sx, samples >= 3 AND coalesce(suffix_rate, 0.0) >= 0.6 AND coalesce(suffix_rate, 0.0) > coalesce(rate, 0.0) AS odd
  FROM md LEFT JOIN sf ON sf.domain = md.domain))
"""
_VERDICT = "CASE WHEN NOT predictable THEN 'needs-full-name' WHEN pattern IS NULL OR coalesce(samples, 0) < 2 THEN 'insufficient-evidence' WHEN confidence >= 0.7 THEN 'predict' ELSE 'ambiguous' END"
_LOO = f"""
{_LEARN},
lo AS (SELECT r.id, r.domain, sc.pattern, sc.attempts - (p.local IS NOT NULL)::INT AS a, sc.hits - coalesce((p.local = r.actual)::INT, 0) AS h, coalesce(p.local = r.actual, false) AS hit, sc.n
  FROM r JOIN sc ON sc.domain = r.domain AND sc.n >= 3 LEFT JOIN p ON p.id = r.id AND p.pattern = sc.pattern),
ch AS (SELECT * FROM lo WHERE a >= greatest(1, (n - 1) // 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY h::DOUBLE / a DESC, {_AWARE} DESC, pattern) = 1),
ok AS (SELECT domain, count(*) FILTER (h > 0 AND hit) AS correct FROM ch GROUP BY 1),
cv AS (SELECT dn.domain, dn.n, CASE WHEN dn.n >= 3 THEN coalesce(correct, 0) END AS correct FROM dn LEFT JOIN ok ON ok.domain = dn.domain)
"""
_FIRMS = f"""
fd AS (SELECT firm, domain FROM (SELECT trim(firm) AS firm, regexp_extract({_TIDY}, '@(.*)$', 1) AS domain, count(*) AS n, min(contact_id) AS first
    FROM contacts WHERE contains(email, '@') AND firm IS NOT NULL AND trim(firm) <> '' GROUP BY 1, 2) WHERE domain NOT IN {_FREE}
  QUALIFY row_number() OVER (PARTITION BY firm ORDER BY n DESC, first) = 1)
"""
_GUESS = f"""
{_LEARN}, {_FIRMS},
pm AS (SELECT id, map_from_entries(list((pattern, local))) AS made FROM p GROUP BY 1),
g0 AS (SELECT s.id, s.name, trim(s.firm) AS firm, s.toks, s.n AS nt, fd.domain, mo.pattern, mo.confidence, mo.samples, mo.predictable, mo.runners_up, pm.made
  FROM s LEFT JOIN fd ON fd.firm = trim(s.firm) LEFT JOIN mo ON mo.domain = fd.domain LEFT JOIN pm ON pm.id = s.id
  WHERE NOT coalesce(contains(s.email, '@'), false) AND s.name IS NOT NULL),
g1 AS (SELECT *, made[pattern] || '@' || domain AS guess, {_VERDICT} AS verdict, coalesce(confidence, 0.0) * CASE WHEN nt <= 2 THEN 1.0 ELSE 0.33 END AS rc,
    list_concat(CASE WHEN coalesce(runners_up, '') = '' THEN [] ELSE string_split(runners_up, ',') END, CASE WHEN nt >= 3 THEN ['given.sur', 'allgiven.sur', 'givensur', 'allgivensur'] ELSE [] END) AS tried FROM g0),
g2 AS (SELECT *, list_filter(list_transform(tried, lambda q: made[q] || '@' || domain), lambda e: e IS NOT NULL AND (guess IS NULL OR e <> guess)) AS oth FROM g1),
g AS (SELECT *, list_filter(oth, lambda e, i: list_position(oth, e) = i)[1:3] AS alternatives,
    CASE WHEN domain IS NULL THEN 'no known domain for this firm' WHEN guess IS NULL AND pattern IS NOT NULL THEN 'name too short to apply the format' WHEN verdict <> 'predict' THEN verdict
      WHEN rc < 0.7 THEN CASE WHEN nt > 2 THEN 'multi-part name' ELSE 'below confidence threshold' END END AS why FROM g2)
"""
_PREDICT = "SELECT id, name, firm, guess AS predicted_email, pattern, round_even(rc * 100, 0)::INT AS confidence_pct, samples AS evidence, nullif(array_to_string(alternatives[1:2], ' | '), '') AS alternatives, 'unverified prediction' AS status FROM g WHERE why IS NULL"


_DIRECTORS = f"""
dd0 AS (SELECT {', '.join(f"{_strip(c)} AS {n}" for c, n in (('firm', 'f0'), ('source', 'branch'), ('linkedin', 'li0'), ('notes', 'note'), ('mailsent', 'msg'), ('email', 'email'), ('met', 'note2'), ('name', 'nm')))}, ctype, contact_id FROM contacts),
dd1 AS (SELECT *, CASE WHEN contact_id % 3 = 0 THEN f0 END AS typed FROM dd0),
dd2 AS (SELECT *, last_value(CASE WHEN typed <> 'deg' THEN typed END IGNORE NULLS) OVER (ORDER BY contact_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM dd1),
dd3 AS (SELECT *, coalesce(msg = 'already in CRM', false) AS crm, CASE WHEN li0 = 'Can''t find LinkedIn' THEN 'No LinkedIn found' ELSE li0 END AS li FROM dd2 WHERE coalesce(typed, '') <> 'deg' AND nm IS NOT NULL),
dd AS (SELECT 8 AS src_rank, contact_id AS row_no, nm AS name, CASE WHEN ctype = 'Branch Director' THEN email END AS email, coalesce(f, 'Unknown') AS firm, ctype,
    CASE WHEN ctype = 'Branch Director' THEN CASE WHEN (crm OR coalesce(msg = 'Yes', false)) AND coalesce(li, 'No') = 'No' THEN 'Yes' ELSE li END END AS linkedin,
    CASE WHEN ctype = 'Branch Director' THEN nullif(concat_ws(' | ', 'Branch: ' || branch, note, CASE WHEN crm THEN 'Already in CRM' END, note2), '') ELSE 'Branch: ' || branch END AS notes
  FROM dd3 WHERE ctype IN ('Branch Director', 'Consultant')),
as0 AS (SELECT {_strip('name')} AS name, {_strip('firm')} AS f, {_strip("coalesce(aum::VARCHAR, nullif(invested, ''))")} AS raw, contact_id FROM contacts),
asl AS (SELECT 7 AS src_rank, contact_id AS row_no, name, coalesce(f, 'Unknown') AS firm, try_cast(raw AS DOUBLE) AS aum, CASE WHEN try_cast(raw AS DOUBLE) IS NULL THEN 'AUM: ' || raw END AS notes
  FROM as0 WHERE name IS NOT NULL AND NOT starts_with(lower(name), 'total'))
"""
_ALIASES = """
al0 AS (SELECT lower(regexp_replace(firm_name, ' \\S+$', '')) AS alias, firm_name FROM firm_ref),
al AS (SELECT alias, min(firm_name) AS canonical FROM al0 GROUP BY 1 HAVING min(firm_name) = max(firm_name)),
tk AS (SELECT key, max_by(e2, row_no) = 'Attended' AS ticked FROM (SELECT nullif(regexp_replace(lower(name), '[^a-z]', '', 'g'), '') AS key, row_no, e2 FROM contacts WHERE e2 IN ('Attended', 'No Show')) WHERE key IS NOT NULL GROUP BY 1)
"""

_ENDS = "|".join(x.replace(".", "\\.") for x in SUFFIXES)
_AFTER = "(?:$|[^A-Za-z0-9.\\-]|\\.$|\\.[^A-Za-z0-9\\-])"


def _addresses(text: str) -> str:
    """No look-around: what stands before and after is matched too, and stands twice, so that neighbours share none of it."""
    twice = f"regexp_replace({text}, '([^A-Za-z0-9._%+@\\-])', '\\1\\1', 'g')"
    return f"regexp_extract_all({twice}, '(?i)(?:^|[^A-Za-z0-9._%+\\-])([A-Za-z0-9._%+\\-]{{2,64}}@(?:[A-Za-z0-9\\-]+\\.)+?(?:{_ENDS})){_AFTER}', 1)"


def _spelled(text: str) -> str:
    twice = f"regexp_replace({text}, '(\\s)', '\\1\\1', 'g')"
    pattern = f"(?i)(?:^|[^A-Za-z0-9._%+\\-])([A-Za-z0-9._%+\\-]{{2,64}})\\s*[\\[({{]\\s*(?:at|@)\\s*[\\])}}]\\s*((?:[A-Za-z0-9\\-]+\\.)*?[A-Za-z0-9\\-]+)\\s*(?:[\\[({{]\\s*dot\\s*[\\])}}]|\\.)\\s*({_ENDS}){_AFTER}"
    return f"list_transform(regexp_extract_all({twice}, '{pattern}', 0), lambda m: regexp_replace(m, '{pattern}', '\\1@\\2.\\3'))"


def _accepted(e: str, trusted: bool) -> str:
    local, domain = f"split_part({e}, '@', 1)", f"regexp_extract({e}, '@(.*)$', 1)"
    ok = f"contains({e}, '@') AND contains({domain}, '.') AND length({local}) <= 64 AND length({domain}) <= 253 AND NOT regexp_matches({e}, '(?i)\\.(pdf|jpe?g|png|gif|svg|webp|zip|docx?|xlsx?|pptx?|mp4|mp3|ico|css|js)$')"
    ok += f" AND {domain} NOT IN {_list(PLACEHOLDER_DOMAINS)} AND {local} NOT IN {_list(PLACEHOLDER_LOCALS)}"
    return ok if trusted else ok + f" AND {local} NOT IN {_list(PROSE)}"


_WORTH = "(?i)(team|about|adviser|advisor|consultant|people|staff|leader|management|contact|branch|office|our-|meet|profile|directory|partner)"
_FILE = "(?i)\\.(pdf|jpe?g|png|gif|svg|webp|zip|docx?|xlsx?|pptx?|mp4|mp3|ico|css|js)$"


def _registrable(host: str) -> str:
    p = f"string_split(lower({host}), '.')"
    return f"CASE WHEN len({p}) >= 3 AND {p}[-2] IN ('com', 'net', 'org', 'edu', 'gov', 'co') AND length({p}[-1]) = 2 THEN array_to_string({p}[-3:], '.') WHEN len({p}) >= 2 THEN array_to_string({p}[-2:], '.') ELSE {host} END"


_CLASS = f"""
h0 AS (SELECT *, {_TIDY} AS e FROM hits),
h1 AS (SELECT h0.*, regexp_full_match(e, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}') AS ok, regexp_extract(e, '@(.*)$', 1) AS dm, split_part(e, '@', 1) AS lp FROM h0),
h2 AS (SELECT h1.*, x.has_mx AS has FROM h1 LEFT JOIN (SELECT DISTINCT ON (lower(domain)) lower(domain) AS d, has_mx FROM domain_mx) x ON ok AND x.d = dm),
h AS (SELECT *, CASE WHEN NOT ok THEN 'malformed' WHEN dm IN {_list(DISPOSABLE)} THEN 'disposable domain'
    WHEN NOT has THEN 'domain accepts no mail' WHEN has IS NULL THEN 'MX lookup failed' WHEN lp IN {_ROLES} OR string_split_regex(lp, '[.\\-_+]')[1] IN {_ROLES} THEN 'role account (a desk, not a person)'
    WHEN dm IN {_FREE} THEN 'personal free mailbox' ELSE 'ok' END AS note FROM h2)
"""

ORACLE: dict[str, str] = {
    "q01_firm_rollup": f"""
WITH {_C}
SELECT CASE WHEN grouping(f) = 1 THEN 'TOTAL' ELSE f END AS firm, grouping(f)::INT AS is_total, count(*) AS contacts, round(count(*)::DOUBLE / (SELECT count(*) FROM c), 6) AS share_of_db,
  count(*) FILTER (met = 'Yes') AS met, round(count(*) FILTER (met = 'Yes')::DOUBLE / count(*), 6) AS share_met, coalesce(sum(mtgs), 0)::BIGINT AS meetings, count(*) FILTER (n_invited > 0) AS invited,
  count(*) FILTER (n_attended > 0) AS attended, count(*) FILTER (invested = 'Yes') AS investors, round(coalesce(sum(aum), 0) / 1e6, 4) AS aum_m
FROM c GROUP BY GROUPING SETS ((f), ())""",
    "q02_kpis": f"""
WITH {_C}, x AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT lower(nullif(trim(firm), '')))::DOUBLE AS firms, count(*) FILTER (met = 'Yes')::DOUBLE AS met, coalesce(sum(mtgs), 0)::DOUBLE AS mtgs,
  count(*) FILTER (n_invited > 0)::DOUBLE AS inv, count(*) FILTER (n_attended > 0)::DOUBLE AS att, count(*) FILTER (lastmtg >= DATE '2026-05-17')::DOUBLE AS d90, count(*) FILTER (lastmtg >= DATE '2026-07-16')::DOUBLE AS d30,
  count(*) FILTER (days > 120)::DOUBLE AS late, count(*) FILTER (engagement = 'Not yet contacted')::DOUBLE AS never, count(*) FILTER (invested = 'Yes')::DOUBLE AS investors, coalesce(sum(aum), 0) / 1e6 AS aum,
  date_diff('day', DATE '1970-01-01', min(lastmtg))::DOUBLE AS d0, date_diff('day', DATE '1970-01-01', max(lastmtg))::DOUBLE AS d1 FROM d)
SELECT unnest(['total_contacts', 'firms_covered', 'contacts_met', 'meeting_coverage', 'total_meetings', 'invited', 'attended', 'attendance_rate', 'met_last_90', 'met_last_30', 'overdue', 'never_contacted', 'investors', 'aum_m',
  'meetings_per_met', 'first_meeting_day', 'last_meeting_day']) AS kpi,
  unnest([n, firms, met, round(CASE WHEN n > 0 THEN met / n ELSE 0 END, 4), mtgs, inv, att, round(CASE WHEN inv > 0 THEN att / inv ELSE 0 END, 4), d90, d30, late, never, investors, round(aum, 4),
  round(CASE WHEN met > 0 THEN mtgs / met ELSE 0 END, 4), d0, d1]) AS value FROM x""",
    "q03_control_check": f"WITH {_C} SELECT count(*) AS n_missing FROM c WHERE lower(f) NOT IN (SELECT lower(firm_name) FROM firm_ref)",
    "q04_event_funnel": f"""
WITH {_C}, l AS ({_LONG}), g AS (SELECT slot, count(*) AS invited, count(*) FILTER (status = 'Attended') AS attended, count(*) FILTER (status = 'No Show') AS no_show, count(*) FILTER (status = 'Declined') AS declined,
  count(*) FILTER (status = 'No Reply') AS no_reply, count(*) FILTER (status IN ('Invited', 'Accepted')) AS pending FROM l WHERE status IN ('Attended', 'No Show', 'Accepted', 'Invited', 'No Reply', 'Declined') GROUP BY 1)
SELECT slot, coalesce(full_name, '(free slot ' || slot || ')') AS event, event_date, coalesce(invited, 0) AS invited, coalesce(attended, 0) AS attended, coalesce(no_show, 0) AS no_show, coalesce(declined, 0) AS declined,
  coalesce(no_reply, 0) AS no_reply, coalesce(pending, 0) AS pending, round(attended::DOUBLE / nullif(invited, 0), 6) AS rate FROM event_slots LEFT JOIN g USING (slot)""",
    "q04b_status_pivot": f"""
WITH {_C}, l AS ({_LONG}) SELECT slot, {', '.join(f"count(*) FILTER (status = '{s}') AS {s.lower().replace(' ', '_')}" for s in ('Attended', 'No Show', 'Accepted', 'Invited', 'No Reply', 'Declined', 'Not Invited'))}
FROM l GROUP BY 1""",
    "q05_engagement_mix": f"""
WITH {_C}, s AS (SELECT unnest(['Event attendee', 'Met (no event)', 'Invited only', 'Contacted only', 'Not yet contacted']) AS stage), g AS (SELECT engagement AS stage, count(*) AS n FROM d GROUP BY 1)
SELECT stage, coalesce(n, 0) AS contacts, round(coalesce(n, 0)::DOUBLE / (SELECT count(*) FROM d), 6) AS share FROM s LEFT JOIN g USING (stage)""",
    "q06_source_membership": f"""
WITH {_C}, p AS (SELECT DISTINCT contact_id, trim(u) AS source FROM c, unnest(string_split(source, '+')) AS x(u))
SELECT source, count(*) AS contacts, round(count(*)::DOUBLE / (SELECT count(*) FROM c), 6) AS share FROM p WHERE source <> '' GROUP BY 1""",
    "q07_derived": f"WITH {_C} SELECT contact_id, n_invited, n_attended, days AS days_since, engagement, coalesce(days > 120, false)::INT AS overdue FROM d",
    "q08_monthly_activity": f"""
WITH {_C}, s AS (SELECT unnest(generate_series(DATE '2025-03-01', DATE '2026-08-01', INTERVAL 1 MONTH))::DATE AS month), g AS (SELECT date_trunc('month', lastmtg)::DATE AS month, count(*) AS n FROM c WHERE lastmtg IS NOT NULL GROUP BY 1)
SELECT month, coalesce(n, 0) AS contacts, sum(coalesce(n, 0)) OVER (ORDER BY month)::BIGINT AS cumulative FROM s LEFT JOIN g USING (month)""",
    "q09_firm_coverage": f"""
WITH {_C} SELECT f AS firm, count(*) AS contacts, count(*) FILTER (met = 'Yes') AS met, coalesce(sum(mtgs), 0)::BIGINT AS meetings, max(lastmtg) AS last_meeting, count(*) FILTER (n_attended > 0) AS attended,
  round(count(*) FILTER (met = 'Yes')::DOUBLE / count(*), 6) AS coverage, date_diff('day', max(lastmtg), DATE '2026-08-15') AS days_since FROM c GROUP BY 1""",
    "q10_followup_top15": f"""
WITH {_C} SELECT row_number() OVER (ORDER BY lastmtg, row_no, contact_id) AS place, contact_id, name, firm, lastmtg, days AS days_since, attended_events, invested, email FROM n WHERE met = 'Yes' AND lastmtg IS NOT NULL
ORDER BY place LIMIT 15""",
    "q10b_followup_all": f"WITH {_C} SELECT row_number() OVER (ORDER BY lastmtg, row_no, contact_id) AS place, contact_id, days AS days_since FROM d WHERE met = 'Yes' AND lastmtg IS NOT NULL",
    "q11_sort_rank": f"WITH {_C} SELECT contact_id, row_number() OVER (ORDER BY lower(coalesce(firm, '')), lower(name), row_no, contact_id) AS sort_place FROM c",
    "q12_running_id": f"WITH {_C} SELECT contact_id, row_number() OVER (ORDER BY row_no, contact_id) AS running_id FROM c",
    "q13_directory_filter": f"""
WITH {_C} SELECT row_number() OVER (ORDER BY lower(coalesce(firm, '')), lower(name), row_no, contact_id) AS seq, contact_id, name, firm, attended_events FROM n
WHERE lower(met) = 'yes' AND lower(engagement) = 'event attendee' AND contains(lower(attended_events), 'autumn')
  AND contains(lower(name || ' ' || coalesce(email, '') || ' ' || coalesce(firm, '') || ' ' || coalesce(notes, '')), 'wealth')""",
    "q14_attended_names": f"WITH {_C} SELECT contact_id, attended_events FROM n WHERE attended_events IS NOT NULL",
    "q15_entity_resolve": f"""
WITH {_SHEETS},
nt AS (SELECT key, cluster_firm, string_agg(notes, '; ' ORDER BY o) AS notes FROM (SELECT key, cluster_firm, notes, min(ord) AS o FROM cl WHERE notes IS NOT NULL GROUP BY ALL) GROUP BY ALL),
so AS (SELECT key, cluster_firm, string_agg(source, ' + ' ORDER BY o) AS source FROM (SELECT key, cluster_firm, source, min(ord) AS o FROM cl GROUP BY ALL) GROUP BY ALL),
r AS (SELECT key, cluster_firm, {', '.join(f"min_by({x}, ord) FILTER ({x} IS NOT NULL AND {x}::VARCHAR <> '') AS {x}" for x in ('name', 'email', 'met', 'lastmtg', 'invested', 'mailsent'))},
  coalesce(min_by(mtgs, ord) FILTER (mtgs <> 0), 0) AS mtgs, {', '.join(f"coalesce(min_by({x}, ord) FILTER ({x} <> 'Not Invited'), 'Not Invited') AS {x}" for x in ('e1', 'e2', 'e3'))}, count(*) AS n_rows FROM cl GROUP BY 1, 2)
SELECT key, cluster_firm AS firm, name, email, met, lastmtg, mtgs, invested, mailsent, e1, e2, e3, notes, source, n_rows FROM r LEFT JOIN nt USING (key, cluster_firm) LEFT JOIN so USING (key, cluster_firm)""",
    "q15b_clusters": f"WITH {_SHEETS} SELECT src_rank, row_no, key, cluster_firm FROM cl",
    "q16_fill_down": "SELECT row_no, last_value(nullif(firm, '') IGNORE NULLS) OVER (ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS firm FROM meeting_list",
    "q17_meeting_sheet": f"WITH {_SHEETS} SELECT row_no, name, email, firm, met, mtgs, invested, e1, e2, e3, notes FROM ml",
    "q17b_mail_sheet": f"WITH {_SHEETS} SELECT row_no, name, email, firm, mailsent, met, lastmtg, mtgs, notes FROM me",
    "q18_tidy": """
SELECT contact_id, m AS met, CASE WHEN m = 'Yes' AND coalesce(mtgs, 0) = 0 THEN 1 ELSE coalesce(mtgs, 0) END AS mtgs, coalesce(nullif(invested, ''), 'No') AS invested,
  coalesce(nullif(mailsent, ''), CASE WHEN starts_with(source, 'Mass Email') THEN 'Yes' END) AS mailsent
FROM (SELECT *, CASE WHEN lastmtg IS NOT NULL OR coalesce(mtgs, 0) > 0 THEN 'Yes' ELSE coalesce(nullif(met, ''), 'No') END AS m FROM contacts)""",
    "q19_attendance_lookup": """
WITH a AS (SELECT key, max_by(e2, row_no) AS e2 FROM (SELECT nullif(regexp_replace(lower(name), '[^a-z]', '', 'g'), '') AS key, row_no, e2 FROM contacts WHERE e2 IN ('Attended', 'No Show')) WHERE key IS NOT NULL GROUP BY 1),
m AS (SELECT row_no, nullif(regexp_replace(lower(name), '[^a-z]', '', 'g'), '') AS key FROM meeting_list)
SELECT row_no, key, coalesce(e2, 'not listed') AS status FROM m LEFT JOIN a USING (key) WHERE key IS NOT NULL""",
    "q20_duplicate_names": f"""
WITH {_C}, k AS (SELECT contact_id, row_no, regexp_replace(lower(name), '\\s', '', 'g') AS k FROM c)
SELECT contact_id, row_no, first_row FROM (SELECT *, min(row_no) OVER (PARTITION BY k) AS first_row FROM k) WHERE row_no > first_row""",
    "q21_profile_frequency": "SELECT column_name, value, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{x}' AS column_name, coalesce({x}, '') AS value FROM contacts" for x in ("firm", "met", "e1", "e2", "ctype", "source"))
    + ") GROUP BY 1, 2",
    "q22_top10_firms": f"WITH {_C} SELECT f AS firm, count(*) AS contacts FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "q23_off_list": "SELECT ctype AS value, count(*) AS n FROM contacts WHERE ctype <> '' AND ctype NOT IN ('Adviser', 'Branch Director', 'Consultant', 'Product / Platform', 'Other') GROUP BY 1",
    "q24_minmax_scale": f"""
WITH {_C}, g AS (SELECT f AS firm, count(*) AS contacts, count(*) FILTER (met = 'Yes') AS met FROM c GROUP BY 1)
SELECT firm, contacts, round(contacts::DOUBLE / max(contacts) OVER (), 6) AS bar, round(met::DOUBLE / contacts, 6) AS colour FROM g""",
    "q25_filter_lists": f"""
WITH {_C} SELECT DISTINCT 'firm' AS list_name, f AS value FROM c UNION ALL SELECT DISTINCT 'event', short_name FROM event_slots WHERE short_name IS NOT NULL
UNION ALL SELECT 'met', unnest(['Yes', 'No', 'TBC']) UNION ALL SELECT 'engagement', unnest(['Event attendee', 'Met (no event)', 'Invited only', 'Contacted only', 'Not yet contacted'])
UNION ALL SELECT unnest(['firm', 'event', 'met', 'engagement']), '(All)'""",
    "q26_raw_passthrough": "SELECT "
    + ", ".join(f"CASE WHEN starts_with({x}, '#') THEN NULL ELSE {x} END AS {x}" for x in ("name", "email", "firm", "oct_event", "met", "invested", "invited", "accepted", "invited_alt"))
    + ", last_meeting, src_rank, row_no FROM meeting_list",
    "q27_event_long": f"WITH {_C} {_LONG}",
    "q28_add_contact": "SELECT count(*) + 1 AS n_rows, 1::BIGINT AS n_new, 1::BIGINT AS n_default, 0 AS was_there FROM contacts",
    "q30_name_tokens": f"SELECT contact_id, array_to_string({_tokens('name')}, ' ') AS tokens FROM contacts",
    "q31_split_name": f"WITH {_NAMES} SELECT contact_id, array_to_string(given, ' ') AS given, sur FROM s",
    "q32_pattern_candidates": f"WITH {_NAMES}, {_MADE} SELECT contact_id, pattern, local FROM p",
    "q33_domain_model": f"WITH {_LEARN} SELECT domain, pattern, round(confidence, 6) AS confidence, samples, predictable::INT AS predictable, runners_up, {_VERDICT} AS verdict FROM mo",
    "q34_suffix_style": f"WITH {_LEARN} SELECT domain, round(suffix_rate, 6) AS suffix_rate FROM sf",
    "q35_leave_one_out": f"WITH {_LOO} SELECT domain, n, correct, round(correct::DOUBLE / n, 6) AS accuracy FROM cv",
    "q36_firm_domain": f"WITH {_FIRMS} SELECT firm, domain FROM fd",
    "q37_predict": f"WITH {_GUESS} {_PREDICT}",
    "q38_needs_manual": f"""
WITH {_GUESS}, sh AS (SELECT *, list_filter(list_concat([guess], alternatives), lambda e: e IS NOT NULL)[1:3] AS shown FROM g WHERE why IS NOT NULL)
SELECT id, name, firm, CASE WHEN domain IS NULL OR len(shown) = 0 THEN why ELSE why || ' (candidates: ' || array_to_string(shown, ', ') || ')' END AS why FROM sh""",
    "q39_pooled_accuracy": f"WITH {_LOO} SELECT coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(correct), 0)::BIGINT AS correct, round(sum(correct)::DOUBLE / sum(n), 6) AS accuracy FROM cv WHERE n >= 3",
    "q42_hex_decode": "SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS code_no, unnest(['mia.stone@acme.test', 'info@bolt.test', 'abc@def.test', NULL, NULL, NULL, NULL, NULL]) AS email",
    "q43_registrable_domain": f"SELECT hit_id, {_registrable('host')} AS site FROM (SELECT hit_id, regexp_extract(source_url, '^[a-z]+://([^/]+)', 1) AS host FROM hits)",
    "q44_link_frontier": f"""
WITH l AS (SELECT DISTINCT doc_id, domain, unnest(regexp_extract_all(text, 'https?://[A-Za-z0-9.\\-]+(?:/[A-Za-z0-9._~%/\\-]*)?')) AS url FROM documents),
p AS (SELECT *, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+(.*)$', 1) AS path FROM l)
SELECT doc_id, url, regexp_matches(path, '{_WORTH}')::INT AS worth,
  coalesce({_registrable('host')} = {_registrable('domain')}, false)::INT AS own_site FROM p WHERE NOT regexp_matches(path, '(?i)\\.(pdf|jpe?g|png|gif|svg|webp|zip|docx?|xlsx?|pptx?|mp4|mp3|ico|css|js)$')""",
    "q45_classify": f"WITH {_CLASS} SELECT hit_id, e AS email, ok::INT AS syntax_ok, (ok AND coalesce(has, false) AND note <> 'disposable domain')::INT AS sendable, note FROM h",
    "q46_dedupe_hits": f"""
SELECT e AS email, hit_id, nearby_name FROM (SELECT *, {_TIDY} AS e FROM hits) QUALIFY row_number() OVER (PARTITION BY e ORDER BY coalesce(nearby_name, '') = '', hit_id) = 1""",
    "q47_import_set": f"""
WITH {_GUESS}, {_CLASS},
pr AS ({_PREDICT}),
k1 AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY e ORDER BY coalesce(nearby_name, '') = '', hit_id) = 1),
al AS (SELECT 0 AS rank, id, name, firm, predicted_email AS email, 'Pattern prediction; confidence ' || confidence_pct || '%' AS notes, 'Pattern prediction' AS source FROM pr
  UNION ALL SELECT 1, hit_id, nearby_name, NULL, e, 'Website: ' || coalesce(source_url, ''), 'Website' FROM k1 WHERE note = 'ok'),
nw AS (SELECT * FROM al WHERE email NOT IN (SELECT lower(email) FROM contacts WHERE contains(email, '@')) QUALIFY row_number() OVER (PARTITION BY email ORDER BY rank, id) = 1),
nk AS (SELECT *, nullif(array_to_string({_tokens('name')}, ''), '') AS k FROM nw),
pe AS (SELECT nullif(array_to_string(toks, ''), '') AS k, firm AS hf, ctype AS hc, true AS there FROM t QUALIFY row_number() OVER (PARTITION BY array_to_string(toks, '') ORDER BY id DESC) = 1)
SELECT coalesce(nullif(name, ''), split_part(email, '@', 1)) AS name, email, coalesce(nullif(firm, ''), hf) AS firm, coalesce(hc, 'Adviser') AS ctype, source, 'No' AS met, 'No' AS invested, substr(notes, 1, 250) AS notes,
  CASE WHEN there THEN 'yes - fills a blank email' ELSE 'no - new contact' END AS already_held FROM nk LEFT JOIN pe USING (k)""",
    "q48_crawl_counters": "SELECT domain, count(DISTINCT source_url) AS pages, count(*) AS hits, count(*) FILTER (NOT is_role) AS personal FROM hits GROUP BY 1",
    "q50_events_filled": f"WITH {_C} SELECT n_attended, count(*) AS contacts FROM c GROUP BY 1",
    "q07b_rule_flags": f"""
WITH {_C} SELECT contact_id, coalesce(met = 'Yes', false)::INT AS is_met, coalesce(days > 120, false)::INT AS is_late,
  {', '.join(f"CASE e{k} WHEN 'Attended' THEN 'good' WHEN 'No Show' THEN 'warn' WHEN 'Declined' THEN 'bad' WHEN 'Not Invited' THEN 'dim' END AS e{k}_mark" for k in range(1, 6))},
  (coalesce(met = 'Yes', false) AND coalesce(mtgs, 0) = 0)::INT AS met_without_meeting, (coalesce(mtgs, 0) > 0 AND lastmtg IS NULL)::INT AS meeting_without_date FROM d""",
    "q09b_all_firms": f"""
WITH {_C}, g AS (SELECT f AS firm, count(*) AS contacts, count(*) FILTER (met = 'Yes') AS met, coalesce(sum(mtgs), 0)::BIGINT AS meetings, max(lastmtg) AS last_meeting, count(*) FILTER (n_attended > 0) AS attended FROM c GROUP BY 1),
a AS (SELECT firm, coalesce(contacts, 0) AS contacts, coalesce(met, 0) AS met, coalesce(meetings, 0) AS meetings, last_meeting, coalesce(attended, 0) AS attended FROM (SELECT DISTINCT firm_name AS firm FROM firm_ref) FULL JOIN g USING (firm))
SELECT *, CASE WHEN contacts > 0 THEN round(met::DOUBLE / contacts, 6) ELSE 0 END AS coverage, date_diff('day', last_meeting, DATE '2026-08-15') AS days_since, row_number() OVER (ORDER BY meetings DESC, firm) AS place FROM a""",
    "q17c_ticked_sheet": f"""
WITH {_ALIASES}, {_SHEETS},
rw AS (SELECT row_no, {_strip('firm')} AS f, {_strip('invited')} AS invited, {_strip('accepted')} AS accepted FROM meeting_list)
SELECT ml.row_no, ml.name, coalesce(al.canonical, ml.firm) AS firm,
  CASE WHEN rw.invited = 'Overseas' THEN 'Declined' WHEN rw.invited = 'TBC' THEN 'Invited' WHEN ticked THEN 'Attended' WHEN NOT ticked THEN 'No Show' ELSE ml.e2 END AS e2,
  nullif(concat_ws('; ', CASE WHEN ticked IS NULL AND rw.accepted = 'Not Available' THEN 'not available' END, CASE WHEN ticked IS NULL AND rw.accepted = 'Bounced back' THEN 'email bounced back' END, CASE WHEN rw.invited = 'Overseas' THEN 'Overseas' END), '') AS notes
FROM ml JOIN rw USING (row_no) LEFT JOIN al ON al.alias = lower(rw.f) LEFT JOIN tk ON tk.key = nullif(regexp_replace(lower(ml.name), '[^a-z]', '', 'g'), '')""",
    "q17d_asset_sheet": f"WITH {_DIRECTORS} SELECT row_no::INT AS row_no, name, firm, aum, notes FROM asl",
    "q17e_director_sheet": f"WITH {_DIRECTORS} SELECT row_no::INT AS row_no, name, email, firm, ctype, linkedin, notes FROM dd",
    "q15c_all_sheets": f"""
WITH {_SHEETS}, {_DIRECTORS},
u4 AS (SELECT *, 'Adviser' AS ctype, NULL::DOUBLE AS aum, NULL AS linkedin FROM u
  UNION ALL BY NAME SELECT src_rank, row_no, name, firm, 'Adviser' AS ctype, aum, notes, 'AUM Data' AS source, 'Not Invited' AS e1, 'Not Invited' AS e2, 'Not Invited' AS e3, src_rank::BIGINT * 1000000000000 + row_no AS ord FROM asl
  UNION ALL BY NAME SELECT src_rank, row_no, name, email, firm, ctype, linkedin, notes, 'Branch Directors' AS source, 'Not Invited' AS e1, 'Not Invited' AS e2, 'Not Invited' AS e3, src_rank::BIGINT * 1000000000000 + row_no AS ord FROM dd),
k4 AS (SELECT *, coalesce(nullif(regexp_replace(lower(name), '[^a-z]', '', 'g'), ''), 'row ' || ord) AS key FROM u4),
c4 AS (SELECT *, CASE WHEN firm = 'Unknown' OR t_u IS NULL OR first_f < t_u THEN firm ELSE 'Unknown' END AS cluster_firm
  FROM (SELECT *, min(ord) OVER (PARTITION BY key, firm) AS first_f, min(CASE WHEN firm = 'Unknown' THEN ord END) OVER (PARTITION BY key) AS t_u FROM k4)),
{', '.join(f"""{t} AS (SELECT key, cluster_firm, list_reduce(list({x} ORDER BY o), lambda a, n: CASE WHEN contains(a, n) THEN a ELSE a || '{sep}' || n END) AS {x}
  FROM (SELECT key, cluster_firm, {x}, min(ord) AS o FROM c4 WHERE {x} <> '' GROUP BY ALL) GROUP BY ALL)""" for t, x, sep in (('n4', 'notes', '; '), ('s4', 'source', ' + ')))},
r4 AS (SELECT key, cluster_firm, {', '.join(f"min_by({x}, ord) FILTER ({x} IS NOT NULL AND {x}::VARCHAR <> '') AS {x}" for x in ('name', 'email', 'ctype', 'met', 'lastmtg', 'invested', 'aum', 'mailsent', 'linkedin'))},
  coalesce(min_by(mtgs, ord) FILTER (mtgs <> 0), 0) AS mtgs, {', '.join(f"coalesce(min_by({x}, ord) FILTER ({x} <> 'Not Invited'), 'Not Invited') AS {x}" for x in ('e1', 'e2', 'e3'))}, count(*) AS n_rows FROM c4 GROUP BY 1, 2)
SELECT key, cluster_firm AS firm, name, email, ctype, met, lastmtg, mtgs, invested, aum, mailsent, linkedin, e1, e2, e3, notes, source, n_rows FROM r4 LEFT JOIN n4 USING (key, cluster_firm) LEFT JOIN s4 USING (key, cluster_firm)""",
    "q22b_ranked_firms": f"WITH {_C}, g AS (SELECT f AS firm, count(*) AS contacts FROM c GROUP BY 1) SELECT *, row_number() OVER (ORDER BY contacts DESC, firm) AS place FROM g",
    "q37b_placed_predictions": f"WITH {_GUESS}, pr AS ({_PREDICT}) SELECT row_number() OVER (ORDER BY confidence_pct DESC, firm, name, id) AS place, id, confidence_pct, firm, name FROM pr",
    "q37c_predicted_domains": f"WITH {_GUESS}, pr AS ({_PREDICT}) SELECT split_part(predicted_email, '@', 2) AS domain, count(*) AS predictions FROM pr GROUP BY 1",
    "q39b_format_report": f"""
WITH {_LOO} SELECT row_number() OVER (ORDER BY samples DESC, domain) AS place, domain, samples, pattern, round(confidence, 6) AS confidence, correct, round(correct::DOUBLE / n, 6) AS accuracy, {_VERDICT} AS verdict
FROM mo JOIN cv USING (domain)""",
    "q40_extract_emails": f"WITH f AS (SELECT doc_id, lower(unnest({_addresses('text')})) AS email FROM documents) SELECT DISTINCT doc_id, email FROM f WHERE {_accepted('email', False)}",
    "q41_spelled_emails": f"WITH f AS (SELECT doc_id, trim(lower(unnest({_spelled('text')}))) AS email FROM documents) SELECT DISTINCT doc_id, email FROM f WHERE {_accepted('email', False)}",
    "q44b_frontier": f"""
WITH l AS (SELECT doc_id, {_registrable('domain')} AS site, regexp_extract_all(text, 'https?://[A-Za-z0-9.\\-]+(?:/[A-Za-z0-9._~%/\\-]*)?') AS us FROM documents),
u AS (SELECT DISTINCT doc_id, site, unnest(us) AS url, us FROM l),
o AS (SELECT doc_id, site, url, list_position(us, url) AS n, NOT regexp_matches(regexp_extract(url, '^https?://[^/]+(.*)$', 1), '{_WORTH}') AS plain FROM u
  WHERE {_registrable("regexp_extract(url, '^https?://([^/]+)', 1)")} = site AND NOT regexp_matches(regexp_extract(url, '^https?://[^/]+(.*)$', 1), '{_FILE}')),
f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY doc_id, n) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY site, doc_id, plain ORDER BY n, url) AS k FROM f QUALIFY NOT plain OR k <= 10)
SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY doc_id, plain, n, url) AS place FROM k QUALIFY place <= 40""",
    "q46b_ordered_hits": f"""
WITH k AS (SELECT e AS email, coalesce(is_role, false) AS r FROM (SELECT *, {_TIDY} AS e FROM hits) QUALIFY row_number() OVER (PARTITION BY e ORDER BY coalesce(nearby_name, '') = '', hit_id) = 1)
SELECT row_number() OVER (ORDER BY r, email NULLS FIRST) AS place, email, r::INT AS is_role FROM k""",
    "q48b_page_counters": "SELECT domain, count(*) AS pages, count(*) FILTER (regexp_matches(source_url, '^[a-z]+://[^/?#]+/(directory|branch)')) AS blocked FROM (SELECT DISTINCT domain, source_url FROM hits WHERE source_url IS NOT NULL) GROUP BY 1",
    "q49_page_hits": f"""
WITH h0 AS (SELECT hit_id, coalesce(nearby_name, '') AS nm, email AS raw, CASE WHEN hit_id % 3 = 0 THEN 0 WHEN hit_id % 3 = 1 AND regexp_full_match(email, '[\\x20-\\x7e]+') THEN 1 ELSE 2 END AS turn FROM hits WHERE email IS NOT NULL),
e AS (SELECT hit_id, nm, turn, regexp_replace(lower(CASE WHEN turn = 0 THEN url_decode(split_part(raw, '?', 1)) ELSE raw END), '^[\\s.,;:]+|[\\s.,;:]+$', '', 'g') AS email FROM h0 WHERE turn < 2),
t AS (SELECT hit_id, '' AS nm, 2 AS turn, regexp_replace(lower(unnest(list_concat({_addresses("'Write to ' || raw || ' today'")}, {_spelled("'Write to ' || raw || ' today'")}))), '^[\\s.,;:]+|[\\s.,;:]+$', '', 'g') AS email FROM h0 WHERE turn = 2),
a AS (SELECT * FROM e WHERE {_accepted('email', True)} UNION SELECT * FROM t WHERE {_accepted('email', False)})
SELECT hit_id AS page_id, email, regexp_extract(email, '@(.*)$', 1) AS domain, CASE WHEN turn = 0 THEN nullif(regexp_extract(nm || ' write', '(?:^|[^\\pL\\pN_])([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){{1,3}})(?:$|[^\\pL\\pN_])', 1), '') END AS nearby_name,
  split_part(email, '@', 1) IN {_ROLES} OR string_split_regex(split_part(email, '@', 1), '[.\\-_+]')[1] IN {_ROLES} AS is_role FROM a""",
    "q54_json_round_trip": "SELECT " + ", ".join(x if x in ("lastmtg", "mtgs", "aum") else f"nullif({x}, '') AS {x}" for x in ("name", "email", "firm", "ctype", "source", "met", "lastmtg", "mtgs", "invested", "aum", "mailsent", "linkedin", "e1", "e2", "e3", "e4", "e5", "notes")) + " FROM contacts",
    "q55_csv_round_trip": "SELECT row_no::VARCHAR AS row_no, " + ", ".join(f"nullif({x}, '') AS {x}" for x in ("name", "email", "firm", "met", "invested")) + " FROM meeting_list",
    "q56_address_book": f"SELECT * FROM (SELECT {', '.join(f'{_strip(x)} AS {x}' for x in ('name', 'email', 'firm', 'ctype', 'source'))} FROM contacts) WHERE name IS NOT NULL",
}
