"""DuckDB SQL for the registered queries: the same questions, asked of the tables directly."""

from __future__ import annotations

from tideline.functions.text import COMPANY_SUFFIXES, LOCATION_ALIASES, STOPWORDS
from tideline.functions.urls import SYSTEM_HOSTS
from tideline.operators import gates
from tideline.operators.pages import BLOCKS, MOST_CHARS
from tideline.operators.publish import MAIL_ITEMS
from tideline.operators.snapshot import ACTIONS
from tideline.plans.views import AS_OF, CURRENCIES, CYCLE_DAYS, CYCLES, FEED, PERIODS, START, SUFFIXES, TITLES, cycle_days
from tideline.plans.queries import LATE_AGE, LATE_BY, OLDER_DAYS, SECOND_POS
from tideline.schemas import USER_FLAGS
from tideline.sources.boards import MAPPERS

K = FEED.keywords


def _q(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def _pick(values, index: str) -> str:
    return f"(CASE ({index}) % {len(values)} " + " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values)) + " END)"


POSTINGS = f"""firms AS (SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT doc_id AS pos, source, doc_id::VARCHAR AS source_native_id, {_pick(TITLES, "doc_id // 10")} AS title, coalesce(s_name, 'Independent') || coalesce({_pick(SUFFIXES, "doc_id")}, '') AS company,
 CASE WHEN doc_id % 6 = 0 THEN 'Bangalore' WHEN doc_id % 6 = 1 THEN 'Remote, WFH' WHEN doc_id % 6 = 2 THEN NULL ELSE n_name END AS location,
 CASE doc_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_remote, 'https://jobs.example.com/p/' || doc_id || '?a=1&b=2' AS url,
 (CASE doc_id % 9 WHEN 0 THEN 'Needs 3+ years of experience. ' WHEN 1 THEN '2 years experience; ' ELSE '' END) || coalesce(text, '') AS description,
 CASE WHEN doc_id % 7 <> 0 THEN n_chars * 13 + 500 END AS salary_min, CASE WHEN doc_id % 11 <> 0 THEN n_chars * 17 + 900 END AS salary_max,
 {_pick(CURRENCIES, "doc_id")} AS salary_currency, {_pick(PERIODS, "doc_id")} AS salary_period,
 CASE WHEN doc_id % 13 <> 0 THEN TIMESTAMP '{START}' + to_hours(CAST(doc_id % 1000 AS INTEGER)) END AS posted_at, coalesce(try_cast(regexp_extract(source, '(\\d+)$', 1) AS INTEGER), 1073741824) AS ord
 FROM documents LEFT JOIN firms ON doc_id % (SELECT count(*) FROM supplier) = s_suppkey)"""


def _spaced(x: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"


_company = _spaced("coalesce(company, '')")
_short = f"regexp_replace({_company}, '((^| )({'|'.join(COMPANY_SUFFIXES)}))+$', '')"
NORM_COMPANY = f"(CASE WHEN {_short} = '' THEN {_company} ELSE {_short} END)"
NORM_TITLE = _spaced("coalesce(title, '')")
_alias = "CASE t " + " ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in LOCATION_ALIASES.items()) + " ELSE t END"
_place = _spaced("coalesce(location, '')")
NORM_LOCATION = f"array_to_string([{_alias} FOR t IN string_split({_place}, ' ') IF t <> ''], ' ')"
IDENTITY = f"i AS (SELECT *, {NORM_COMPANY} AS norm_company, {NORM_TITLE} AS norm_title, {NORM_LOCATION} AS norm_location FROM p),\nu AS (SELECT *, sha256(norm_company || '|' || norm_title || '|' || norm_location) AS job_uid FROM i)"


def _fx(c: str) -> str:
    return f"(CASE upper({c}) WHEN 'INR' THEN 1.0::DOUBLE " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in FEED.pay.rates.items()) + " END)"


def _month(c: str) -> str:
    return f"(CASE lower({c}) WHEN 'year' THEN 1.0::DOUBLE/12 WHEN 'week' THEN 52.0::DOUBLE/12 WHEN 'day' THEN 260.0::DOUBLE/12 WHEN 'hour' THEN 2080.0::DOUBLE/12 ELSE 1.0::DOUBLE END)"


def _converted(v: str, c: str, per: str) -> str:
    return f"CASE WHEN {per} IS NOT NULL AND {_fx(c)} IS NOT NULL THEN round_even({v}::DOUBLE * {_fx(c)} * {_month(per)}, 0)::BIGINT ELSE {v} END"


def _word(text: str, *keywords: str) -> str:
    import re

    words = "|".join(re.escape(k).replace("\\ ", " ") for k in keywords)
    return f"regexp_matches({text}, '(^|[^a-z0-9])({words})([^a-z0-9]|$)')"


def _matched(text: str, keywords) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_word(text, k)} THEN {_q(k)} END" for k in keywords) + "], lambda x: x IS NOT NULL)"


ENRICHED = f"""{POSTINGS}, {IDENTITY},
m AS (SELECT * REPLACE ({_converted("salary_min", "salary_currency", "salary_period")} AS salary_min, {_converted("salary_max", "salary_currency", "salary_period")} AS salary_max,
   CASE WHEN {_fx("salary_currency")} IS NOT NULL AND salary_period IS NOT NULL AND coalesce(salary_min, salary_max) IS NOT NULL THEN 'INR' ELSE salary_currency END AS salary_currency,
   CASE WHEN {_fx("salary_currency")} IS NOT NULL AND salary_period IS NOT NULL AND coalesce(salary_min, salary_max) IS NOT NULL THEN 'month' ELSE salary_period END AS salary_period),
   {_fx("salary_currency")} IS NOT NULL AND salary_period IS NOT NULL AND coalesce(salary_min, salary_max) IS NOT NULL AS salary_parsed, coalesce(is_remote, FALSE) AS remote,
   regexp_matches(lower(title), '(^|[^a-z0-9])(intern|interns|internship|internships|trainee|apprentice|apprenticeship)([^a-z0-9]|$)') AS is_internship FROM u),
e AS (SELECT *, CASE WHEN NOT salary_parsed THEN 'unknown' WHEN coalesce(salary_max, salary_min) >= (CASE WHEN is_internship THEN {FEED.pay.min_internship} WHEN remote THEN {FEED.pay.min_remote} ELSE {FEED.pay.min_in_office} END) THEN 'pass' ELSE 'fail' END AS salary_bucket FROM m)"""
JUDGED = f"""{ENRICHED},
t0 AS (SELECT *, lower(title) AS tl, lower(description) AS dl, lower(title) || chr(10) || lower(description) AS hay FROM e),
t1 AS (SELECT *, {_matched("tl", K.roles)} AS title_roles, {_matched("dl", K.roles)} AS all_desc, {_word("hay", *K.must_have)} AS anchored, {_matched("hay", K.bonus)} AS bonus, {_matched("tl", K.exclude)} AS excluded,
   CASE pos % 9 WHEN 0 THEN 3 WHEN 1 THEN 2 END AS years FROM t0),
t2 AS (SELECT *, list_filter(all_desc, lambda x: NOT list_contains(title_roles, x)) AS desc_roles FROM t1),
t3 AS (SELECT *, CASE WHEN len(excluded) > 0 THEN 'excluded:' || excluded[1] WHEN NOT {_word("hay", *K.level_required)} THEN 'no_level'
   WHEN len(title_roles) + len(desc_roles) = 0 AND NOT (is_internship AND anchored) THEN 'no_role_match' WHEN NOT anchored THEN 'no_relevant_skill'
   WHEN NOT is_internship AND years > {K.max_experience_years} THEN 'experience:' || years || 'y'
   WHEN NOT (remote OR norm_location = '' OR list_contains(string_split(norm_location, ' '), 'bengaluru')) THEN 'location_mismatch' WHEN salary_bucket = 'fail' THEN 'salary_below_floor' END AS drop_reason FROM t2),
j AS (SELECT *, drop_reason IS NULL AS keep, CASE WHEN drop_reason IS NULL THEN greatest(0, 10 * least(len(title_roles), 3) + 3 * least(len(desc_roles), 3) + 4 * least(len(bonus), 5)
   + CASE WHEN is_internship THEN 25 ELSE 0 END + CASE WHEN remote THEN 5 ELSE 0 END + CASE WHEN salary_bucket = 'pass' THEN 6 ELSE 0 END - CASE WHEN salary_bucket = 'unknown' AND NOT remote THEN 5 ELSE 0 END) ELSE 0 END::DOUBLE AS match_score,
   CASE WHEN drop_reason IS NULL THEN array_to_string(list_concat(list_filter([CASE WHEN is_internship THEN 'internship' END, CASE WHEN salary_bucket = 'unknown' AND NOT remote THEN 'salary_unknown_flagged' END], lambda x: x IS NOT NULL),
     list_concat(list_transform(title_roles, lambda x: 'role_title:' || x), list_transform(desc_roles, lambda x: 'role_desc:' || x))), '|') ELSE drop_reason END AS reasons FROM t3)"""
_mut = "title, company, location, is_remote, description, salary_min, salary_max, salary_currency, salary_period, salary_parsed, salary_bucket, match_score, is_internship, posted_at"


def _cycle(n: int, condition: str) -> str:
    """First and last rows of each uid among a cycle's kept postings."""
    rank = "row_number() OVER (PARTITION BY job_uid ORDER BY ord, pos)"
    back = "row_number() OVER (PARTITION BY job_uid ORDER BY ord DESC, pos DESC)"
    return f"""c{n} AS (SELECT *, {rank} AS up, {back} AS down, count(*) OVER (PARTITION BY job_uid) AS times FROM j WHERE keep AND {condition}),
b{n} AS (SELECT l.* EXCLUDE (source, url), f.source, f.url FROM c{n} l JOIN c{n} f ON l.job_uid = f.job_uid AND l.down = 1 AND f.up = 1)"""


JOBS = f"""{JUDGED}, {_cycle(1, "pos % 4 < 2")}, {_cycle(2, "pos % 4 > 1")},
jobs AS (SELECT coalesce(b1.job_uid, b2.job_uid) AS job_uid, coalesce(b1.source, b2.source) AS source, coalesce(b1.url, b2.url) AS url,
  {", ".join(f"CASE WHEN b2.job_uid IS NOT NULL THEN b2.{c} ELSE b1.{c} END AS {c}" for c in _mut.split(", "))},
  CASE WHEN b1.job_uid IS NOT NULL THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-02' END AS first_seen_at, CASE WHEN b2.job_uid IS NOT NULL THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2024-01-01' END AS last_seen_at,
  CASE WHEN b2.job_uid IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS last_seen_cycle,
  CASE WHEN b2.job_uid IS NULL THEN CASE WHEN b1.times > 1 THEN 'active' ELSE 'new' END WHEN b1.job_uid IS NOT NULL THEN 'active' WHEN b2.times > 1 THEN 'active' ELSE 'new' END AS status
  FROM b1 FULL OUTER JOIN b2 ON b1.job_uid = b2.job_uid)"""
DAYS = "ev AS (SELECT *, date_diff('day', DATE '2024-01-01', ts::DATE) + 1 AS day FROM events)"
OUTCOMES = f"""{DAYS}, oc AS (SELECT day AS run_id, event_type AS source, count(*) FILTER (user_id % 23 = 0 AND event_type = 'error') = 0 AS succeeded, min(value) < 5 AS exhaustive, count(*)::INTEGER AS n_fetched,
  max(CASE WHEN user_id % 23 = 0 AND event_type = 'error' THEN 'status ' || user_id END) AS error FROM ev GROUP BY 1, 2)"""
METRICS = f"""{OUTCOMES}, mt AS (SELECT run_id, count(*) FILTER (succeeded) AS n_sources_ok, count(*) FILTER (NOT succeeded) AS n_sources_err, sum(n_fetched)::BIGINT AS n_fetched,
  coalesce(string_agg(CASE WHEN NOT succeeded THEN source || ': ' || coalesce(error, 'unknown error') END, '; ' ORDER BY source), '') AS error,
  list_filter(list(CASE WHEN NOT succeeded THEN source END ORDER BY source), lambda x: x IS NOT NULL) AS failed FROM oc GROUP BY 1),
ms AS (SELECT *, CASE WHEN n_sources_ok + n_sources_err = 0 THEN 'success' WHEN n_sources_ok = 0 THEN 'failed' WHEN n_sources_err > 0 THEN 'partial' ELSE 'success' END AS status FROM mt)"""
RUNS = f"""{METRICS}, rn AS (SELECT run_id, TIMESTAMP '{START}' + to_days(CAST(run_id - 1 AS INTEGER)) AS started_at, CASE WHEN run_id % 10 = 0 THEN 'running' ELSE status END AS status,
  CASE WHEN run_id % 10 <> 0 THEN TIMESTAMP '{START}' + to_days(CAST(run_id - 1 AS INTEGER)) + to_hours(CAST(n_fetched % 30 AS INTEGER)) END AS finished_at, error FROM ms)"""


def _event_cycle(n: int, condition: str) -> str:
    return f"""s{n} AS (SELECT user_id::VARCHAR AS job_uid, arg_min(event_type, event_id) AS source, arg_max('t' || event_id, event_id) AS title, arg_max(round(value * 100)::BIGINT, event_id) AS salary_max, arg_max(ts, event_id) AS posted_at, count(*) AS times
  FROM ev WHERE {condition} GROUP BY 1)"""


FIRST, SECOND = "(user_id % 4 = 0 OR user_id % 4 > 1 AND day < 16)", "(user_id % 4 = 1 OR user_id % 4 > 1 AND day >= 16)"
TWO = f"""{DAYS}, {_event_cycle(1, FIRST)}, {_event_cycle(2, SECOND)},
tw AS (SELECT coalesce(s1.job_uid, s2.job_uid) AS job_uid, coalesce(s1.source, s2.source) AS source, coalesce(s2.title, s1.title) AS title, coalesce(s2.salary_max, s1.salary_max) AS salary_max, coalesce(s2.posted_at, s1.posted_at) AS posted_at,
  CASE WHEN s1.job_uid IS NOT NULL THEN TIMESTAMP '2024-01-16' ELSE TIMESTAMP '2024-01-31' END AS first_seen_at, CASE WHEN s2.job_uid IS NOT NULL THEN TIMESTAMP '2024-01-31' ELSE TIMESTAMP '2024-01-16' END AS last_seen_at,
  CASE WHEN s2.job_uid IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS last_seen_cycle,
  CASE WHEN s2.job_uid IS NULL THEN CASE WHEN s1.times > 1 THEN 'active' ELSE 'new' END WHEN s1.job_uid IS NOT NULL OR s2.times > 1 THEN 'active' ELSE 'new' END AS status
  FROM s1 FULL OUTER JOIN s2 ON s1.job_uid = s2.job_uid)"""
def _streamed() -> str:
    """Each cycle's events merged into the rows before and aged, as one chain of tables."""
    parts, before = [DAYS], None
    for n in range(1, CYCLES + 1):
        low, high = cycle_days(n - 1)
        condition, as_of = f"day >= {low} AND day < {high}", f"(TIMESTAMP '{START}' + to_days({CYCLE_DAYS * n}))"
        parts += [_event_cycle(n, condition), f"ok{n} AS (SELECT DISTINCT event_type AS src, event_type <> 'click' AS whole FROM ev WHERE {condition} AND event_type <> 'error')"]
        old = before or "(SELECT job_uid, source, title, posted_at, NULL::TIMESTAMP AS first_seen_at, NULL::TIMESTAMP AS last_seen_at, 0::BIGINT AS last_seen_cycle, '' AS status FROM s1 WHERE FALSE)"
        parts.append(f"""m{n} AS (SELECT coalesce(o.job_uid, s.job_uid) AS job_uid, coalesce(o.source, s.source) AS source, coalesce(s.title, o.title) AS title, coalesce(s.posted_at, o.posted_at) AS posted_at, coalesce(o.first_seen_at, {as_of}) AS first_seen_at,
  CASE WHEN s.job_uid IS NOT NULL THEN {as_of} ELSE o.last_seen_at END AS last_seen_at, CASE WHEN s.job_uid IS NOT NULL THEN {n}::BIGINT ELSE o.last_seen_cycle END AS last_seen_cycle,
  CASE WHEN s.job_uid IS NULL THEN o.status WHEN o.job_uid IS NOT NULL OR s.times > 1 THEN 'active' ELSE 'new' END AS status FROM {old} o FULL OUTER JOIN s{n} s ON o.job_uid = s.job_uid)""")
        parts.append(f"""g{n} AS (SELECT m.*, src IS NOT NULL AS looked, src IS NOT NULL AND last_seen_cycle < {n} AND status IN ('new', 'active') AND (whole OR coalesce(posted_at, first_seen_at) < {as_of} - to_days({FEED.retire_days})) AS went FROM m{n} m LEFT JOIN ok{n} ON source = src),
r{n} AS (SELECT * EXCLUDE (looked, went) REPLACE (CASE WHEN looked AND (went OR status = 'stale') AND last_seen_at < {as_of} - to_days({FEED.grace_days}) THEN 'deleted' WHEN went THEN 'stale' ELSE status END AS status) FROM g{n})""")
        before = f"r{n}"
    return ",\n".join(parts)


AGED = f"""{TWO}, ok AS (SELECT * FROM (VALUES ('view', TRUE), ('click', FALSE), ('signup', TRUE)) v(src, whole)),
a1 AS (SELECT tw.*, src IS NOT NULL AND last_seen_cycle < 3 AND status IN ('new', 'active') AND (whole OR coalesce(posted_at, first_seen_at) < TIMESTAMP '2024-02-06 12:00:00' - to_days({FEED.retire_days})) AS went_stale, src FROM tw LEFT JOIN ok ON source = src),
a2 AS (SELECT *, src IS NOT NULL AND (went_stale OR status = 'stale') AND last_seen_at < TIMESTAMP '2024-02-06 12:00:00' - to_days({FEED.grace_days}) AS went_deleted FROM a1),
ag AS (SELECT job_uid, source, CASE WHEN went_deleted THEN 'deleted' WHEN went_stale THEN 'stale' ELSE status END AS status, went_stale, went_deleted FROM a2)"""
_as_of = f"(TIMESTAMP '{START}' + to_days(CAST({{}} AS INTEGER)))"
INTERVALS = f"""{OUTCOMES}, sg AS (SELECT user_id || '-' || event_id % 20 AS uid, event_type AS source, day AS cycle, CASE WHEN event_id % 13 <> 0 THEN ts END AS posted, event_id AS ord FROM ev),
sn AS (SELECT uid, cycle, count(*) AS times, max(CASE WHEN is_last THEN posted END) AS posted FROM (SELECT *, ord = max(ord) OVER (PARTITION BY uid, cycle) AS is_last FROM sg) GROUP BY 1, 2),
ow AS (SELECT uid, min(cycle) AS first, arg_min(source, (cycle, ord)) AS source FROM sg GROUP BY 1),
gr AS (SELECT uid, source, first, c.cycle, (SELECT max(sn.cycle) FROM sn WHERE sn.uid = ow.uid AND sn.cycle <= c.cycle) AS seen FROM ow JOIN (SELECT DISTINCT day AS cycle FROM ev) c ON c.cycle >= first),
gs AS (SELECT gr.*, times, coalesce(posted, {_as_of.format("first")}) AS posted FROM gr JOIN sn ON sn.uid = gr.uid AND sn.cycle = seen),
st AS (SELECT gs.uid, gs.cycle, any_value(gs.source) AS source, any_value(seen) AS seen, any_value(first) AS first, any_value(times) AS times,
  min(run_id) FILTER (exhaustive OR posted < {_as_of.format("run_id")} - to_days(8)) AS stale, max(run_id) AS latest_pass FROM gs LEFT JOIN oc ON oc.source = gs.source AND succeeded AND run_id > seen AND run_id <= gs.cycle GROUP BY 1, 2),
ss AS (SELECT uid, source, cycle, CASE WHEN stale IS NULL THEN CASE WHEN seen = first AND times = 1 THEN 'new' ELSE 'active' END
  WHEN {_as_of.format("seen")} < {_as_of.format("latest_pass")} - to_days({FEED.grace_days}) THEN 'deleted' ELSE 'stale' END AS status FROM st),
il AS (SELECT *, cycle - row_number() OVER (PARTITION BY uid, status ORDER BY cycle) AS island FROM ss)
SELECT uid, any_value(source) AS source, status, min(cycle) AS from_cycle, max(cycle) AS to_cycle FROM il GROUP BY uid, status, island"""
_names = "CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'bookmark' WHEN 'signup' THEN 'hide' WHEN 'purchase' THEN 'apply' ELSE 'unbookmark' END"
FLAGS = f"""fe AS (SELECT user_id::VARCHAR AS job_uid, CASE WHEN event_id % 4 = 0 THEN 'unseen' ELSE {_names} END AS action, ts FROM events),
fs AS (SELECT job_uid, CASE action {" ".join(f"WHEN '{a}' THEN '{f}'" for a, (f, _) in ACTIONS.items())} END AS field, CASE action {" ".join(f"WHEN '{a}' THEN {v}" for a, (_, v) in ACTIONS.items())} END AS value, ts, action FROM fe),
fl AS (SELECT job_uid, field, value FROM (SELECT *, row_number() OVER (PARTITION BY job_uid, field ORDER BY ts DESC, action DESC) AS r FROM fs WHERE field IS NOT NULL) WHERE r = 1)"""
CHANGES = """ch AS (SELECT user_id::VARCHAR AS job_uid, event_id, ts, CASE event_id % 5 WHEN 0 THEN 'notes' WHEN 1 THEN 'hidden' WHEN 2 THEN 'extra_context' WHEN 3 THEN 'applied' ELSE 'status' END AS field,
  CASE WHEN event_id % 5 IN (1, 3) THEN CASE WHEN value < 20 THEN 'false' ELSE '1' END ELSE '  ' || event_type || ' ' END AS value FROM events)"""
_money = lambda v: f"format('{{:,}}', {v})"
PAY_TEXT = f"""(CASE WHEN salary_parsed AND coalesce(salary_min, salary_max) IS NOT NULL THEN coalesce(nullif(salary_currency, ''), 'INR') || ' ' || (CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL AND salary_min <> salary_max
  THEN {_money("salary_min")} || '-' || {_money("salary_max")} ELSE {_money("coalesce(salary_max, salary_min)")} END) || '/' || coalesce(nullif(salary_period, ''), 'month') END)"""
META = f"concat_ws(' · ', nullif(CASE WHEN coalesce(is_remote, FALSE) THEN 'Remote' ELSE coalesce(location, '') END, ''), {PAY_TEXT}, nullif(source, ''))"


def _esc(x: str, quotes: bool = False) -> str:
    out = f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"replace(replace({out}, '\"', '&quot;'), chr(39), '&#x27;')" if quotes else out


def _rfc(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"


TOP = "ORDER BY match_score DESC NULLS LAST, posted_at DESC NULLS LAST, job_uid"
ENTRY = f"""concat_ws(chr(10), '  <entry>', '    <id>urn:jobuid:' || job_uid || '</id>', '    <title>' || {_esc("title || ' — ' || company", True)} || '</title>',
  '    <updated>' || {_rfc(f"coalesce(posted_at, TIMESTAMP '{AS_OF}')")} || '</updated>', '    <published>' || {_rfc("posted_at")} || '</published>', '    <link rel="alternate" href="' || {_esc("url", True)} || '"/>',
  '    <category term="' || {_esc("source", True)} || '"/>', CASE WHEN coalesce(is_remote, FALSE) THEN '    <category term="remote"/>' END, '    <category term="salary:' || salary_bucket || '"/>', '    <summary>' || {_esc(META, True)} || '</summary>', '  </entry>')"""
_fold = lambda c: f"lower({c})"
_numbers = lambda c: f"list_distinct(list_transform(regexp_extract_all({c}, '\\d[\\d,]*\\.?\\d*'), lambda x: regexp_replace(replace(x, ',', ''), '\\.+$', '')))"
REWRITES = """cv AS (SELECT conv_id, turn, concat_ws(' ', text, 'Cut cost by ' || (conv_id % 5 + turn % 2) || '% over 1,000 runs.') AS text FROM conversations),
rw AS (SELECT a.conv_id, a.turn, a.text AS source_text, b.text AS new_text FROM cv a JOIN cv b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1)"""
_stop = ", ".join(map(_q, STOPWORDS))
_words = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9+#.]+'), lambda x: length(x) >= 2 AND NOT list_contains([{_stop}], x)))"
_canon_pairs = "list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]*=.') AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|mc_cid|mc_eid|ref|referrer|source|src|trk|trackingid|refid|originalsubdomain|position|pagenum)=')))"
_host = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
_path = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(.)/+$', '\\1')"
_domain = f"array_to_string(list_slice(string_split({_host}, '.'), -2, -1), '.')"
_canonical = f"regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_host} || {_path} || CASE WHEN len({_canon_pairs}) > 0 THEN '?' || array_to_string({_canon_pairs}, '&') ELSE '' END"
_system = "CASE " + " ".join(f"WHEN {_host} LIKE '%{mark}%' THEN '{name}'" for name, marks in SYSTEM_HOSTS for mark in marks) + " END"


_key, _filled = "'k' || (pos % 3)", "nullif(location, '')"
#: What each board's mapper makes of its payloads: source, company, location, remote, low, high, currency, period, description, url, and which it keeps.
BOARDS = [
    ("'remoteok'", "company", f"coalesce({_filled}, 'Remote')", "TRUE", "salary_min", "salary_max", "'USD'", "NULL", "description", "url", "TRUE"),
    ("'himalayas'", "company", "location", "TRUE", "salary_min", "salary_max", "salary_currency", "'year'", "description", "url", "TRUE"),
    ("'jobicy'", "company", f"coalesce({_filled}, 'Remote')", "TRUE", "salary_min", "salary_max", "salary_currency", "'month'", "description", "url", "NOT older"),
    ("'adzuna'", "company", "location", "NULL", "salary_min", "salary_max", "'INR'", "'year'", "description", "url", "TRUE"),
    ("'jooble'", "company", "location", "NULL", "NULL", "NULL", "NULL", "NULL", "description", "url", "TRUE"),
    ("'unstop'", "company", f"CASE WHEN pos % 2 = 1 THEN {_filled} END", "CASE WHEN pos % 2 = 0 THEN TRUE END", "CASE WHEN pos % 2 = 1 THEN salary_min END", "CASE WHEN pos % 2 = 1 THEN salary_max END", "CASE WHEN pos % 2 = 1 THEN 'INR' END",
     "CASE WHEN pos % 2 = 1 THEN 'month' END", "concat_ws(chr(10), nullif(trim(description), ''), 'Skills: SQL')", "'https://unstop.com/o/' || pos", f"pos % 5 <> 0 AND (posted_at IS NULL OR posted_at >= TIMESTAMP '{AS_OF}' - to_days(35))"),
    (f"'greenhouse_' || {_key}", f"CASE WHEN pos % 2 = 0 THEN company ELSE {_key} END", _filled, "CASE WHEN lower(location) LIKE '%remote%' THEN TRUE END", "NULL", "NULL", "NULL", "NULL", "'<p>R&D ' || description", "url", "TRUE"),
    (f"'lever_' || {_key}", _key, "location", "CASE pos % 4 WHEN 0 THEN TRUE WHEN 3 THEN NULL ELSE FALSE END", "salary_min", "salary_max", "'USD'", "'year'", "description", "url", "pos % 10 <> 0"),
    (f"'ashby_' || {_key}", _key, "location", "coalesce(is_remote, FALSE)", "salary_min", "salary_max", "'EUR'", "'hour'", "description", "url", "pos % 4 <> 0"),
    (f"'smartrecruiters_' || {_key}", "company", f"concat_ws(', ', {_filled}, 'in')", "coalesce(is_remote, FALSE)", "NULL", "NULL", "NULL", "NULL", "NULL", "url", "TRUE"),
]
MAPPED = f"""{POSTINGS}, p2 AS (SELECT * EXCLUDE (pos, source_native_id, title, posted_at), pos, source_native_id, title, posted_at, FALSE AS older FROM p
  UNION ALL SELECT * EXCLUDE (pos, source_native_id, title, posted_at), pos + {SECOND_POS}, (pos + {SECOND_POS})::VARCHAR, title || ' II', posted_at - to_days({OLDER_DAYS}), TRUE FROM p), x AS (""" + " UNION ALL ".join(
    f"""SELECT {source} AS source, source_native_id, {company} AS company, title, {location} AS location, {remote}::BOOLEAN AS is_remote, ({low})::BIGINT AS salary_min, ({high})::BIGINT AS salary_max, ({currency})::VARCHAR AS salary_currency,
  ({period})::VARCHAR AS salary_period, posted_at, md5(({description})::VARCHAR) AS description_md5, {url} AS url FROM p2 WHERE {keep}"""
    for source, company, location, remote, low, high, currency, period, description, url, keep in BOARDS
) + f"), {IDENTITY.replace('FROM p)', 'FROM x)')}"
_scraped_period = "CASE lower(per) WHEN 'yearly' THEN 'year' WHEN 'monthly' THEN 'month' WHEN 'hourly' THEN 'hour' END"
_scraped_known = f"(({_scraped_period}) IS NOT NULL AND {_fx('c')} IS NOT NULL)"
SCRAPED = f"""f AS (SELECT o_orderkey AS k, 'jobspy_' || CASE WHEN o_orderkey % 2 = 0 THEN 'indeed' ELSE 'naukri' END AS source, 'Engineer ' || (o_orderkey % 9) AS title, c_name AS company, o_orderpriority AS location, 'https://x.example.com/' || o_orderkey AS url,
  CASE o_orderkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_remote, CASE WHEN o_orderkey % 4 <> 0 THEN round_even(o_totalprice, 0) END AS lo, round_even(o_totalprice * 2, 0) AS hi, nullif({_pick(["usd", "INR", "", "JPY"], "o_orderkey")}, '') AS c,
  {_pick(["yearly", "Monthly", "hourly", "daily", None], "o_orderkey")} AS per, o_orderdate AS posted_at FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 11 <> 0), {IDENTITY.replace("FROM p)", "FROM f)")}"""
LISTED = f"""f AS (SELECT page_id::VARCHAR AS source_native_id, 'Python Development Internship' AS title, 'Acme ' || (page_id % 5) AS company, CASE WHEN page_id % 3 <> 0 THEN 'Pune' END AS location, CASE WHEN page_id % 3 = 0 THEN TRUE END AS is_remote,
  'https://internshala.com/d/' || page_id AS url, 'Internshala listing: python dev.' AS description, page_id * 100 + 1000 AS salary_min, CASE WHEN page_id % 2 = 0 THEN 90000 ELSE page_id * 100 + 1000 END AS salary_max,
  TIMESTAMP '{AS_OF}' - to_days(CAST(page_id % 9 + 1 AS INTEGER)) AS posted_at FROM pages), {IDENTITY.replace("FROM p)", "FROM f)")}"""


def _years() -> str:
    """Each mention of years with the characters beside it, from the pieces between mentions."""

    def cut(pattern: str) -> str:
        return f"string_split_regex(t, '{pattern}') AS b, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', 1) AS n"

    rest = f"left(b[i + 1], {gates.BESIDE}) || array_to_string(list_transform(range(i + 1, least(i + {gates.FURTHER}, len(m)) + 1), lambda j: m[j] || left(b[j + 1], {gates.BESIDE})), '')"
    return f""", tx AS (SELECT 'd' || doc_id AS key, lower(text) AS t FROM documents UNION ALL SELECT 'c-' || conv_id || '-' || turn, lower(text) FROM conversations UNION ALL SELECT 'p' || pos, lower(description) FROM p),
  ra AS (SELECT key, {cut(gates.YEARS_OR_RANGE)} FROM tx WHERE regexp_matches(t, '{gates.YEARS}')), af AS (SELECT key, {cut(gates.YEARS)} FROM tx WHERE regexp_matches(t, '{gates.YEARS}')),
  hit AS (SELECT key, n[i]::INTEGER AS y FROM ra, unnest(range(1, len(m) + 1)) u(i) WHERE regexp_matches(left({rest}, {gates.BESIDE}), '{gates.NAMED_NEXT}')
    UNION ALL SELECT key, n[i]::INTEGER FROM af, unnest(range(1, len(m) + 1)) u(i) WHERE regexp_matches(right(b[i], {gates.BESIDE}), '{gates.NAMED_BEFORE}')),
  yr AS (SELECT key, max(y) AS years FROM hit GROUP BY key)"""


def oracle_sql() -> dict[str, str]:
    board_names = "[" + ", ".join(map(_q, MAPPERS)) + "]"
    w = "WITH "
    walks = f"""{w}{DAYS}, pg AS (SELECT event_type AS source, day AS walk, (event_id % 300) // 50 + 1 AS page, count(*) * 3 AS n_items, min(value) > 0.35 AS ok FROM ev GROUP BY 1, 2, 3),
          en AS (SELECT source, walk, min(page) FILTER (page <= 5 AND NOT ok) AS bad, min(page) FILTER (page <= 5 AND ok AND n_items < 24) AS short FROM pg GROUP BY 1, 2)
          SELECT source, walk, count(*) FILTER (page <= least(coalesce(bad - 1, 5), coalesce(short, 5))) AS n_pages, coalesce(sum(n_items) FILTER (page <= least(coalesce(bad - 1, 5), coalesce(short, 5))), 0)::BIGINT AS n_items, coalesce(any_value(bad) = 1, FALSE) AS failed,
          coalesce(any_value(short) < coalesce(any_value(bad), 6), FALSE) AS exhausted FROM pg JOIN en USING (source, walk) GROUP BY 1, 2"""
    views = {
        "all": "TRUE", "remote": "coalesce(is_remote, FALSE) AND status <> 'deleted'", "not_remote": "NOT coalesce(is_remote, FALSE) AND status <> 'deleted'", "not_remote_strict": "is_remote = FALSE AND status <> 'deleted'",
        "intern": "is_internship AND status <> 'deleted'", "none": "FALSE", "wild": "(lower(title) LIKE '%b_ck%eng%' OR lower(company) LIKE '%b_ck%eng%') AND status <> 'deleted'", "pass": "salary_bucket = 'pass' AND status <> 'deleted'",
    }
    line = f"n || '. <a href=\"' || {_esc('url', True)} || '\">' || {_esc('title')} || '</a> — ' || {_esc('company')} || coalesce(chr(10) || '   ' || nullif({_esc(META)}, ''), '')"
    return {
        "match_score_topk": f"{w}{JUDGED} SELECT pos, job_uid, match_score, posted_at, reasons FROM j WHERE keep ORDER BY match_score DESC, posted_at DESC NULLS LAST, pos LIMIT 50",
        "posting_identity": f"{w}{POSTINGS}, {IDENTITY} SELECT pos, norm_company, norm_title, norm_location, job_uid, title AS clean_title FROM u",
        "dedup_first_seen": f"""{w}{POSTINGS}, {IDENTITY}, r AS (SELECT *, row_number() OVER (PARTITION BY job_uid ORDER BY ord, pos) AS up, row_number() OVER (PARTITION BY job_uid ORDER BY ord DESC, pos DESC) AS down, count(*) OVER (PARTITION BY job_uid) AS times FROM u)
          SELECT f.job_uid, f.source, f.pos AS first_pos, l.pos AS last_pos, l.salary_max, f.times FROM r f JOIN r l ON f.job_uid = l.job_uid AND f.up = 1 AND l.down = 1""",
        "canonical_urls": f"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_host} || {_path} || CASE WHEN len({_canon_pairs}) > 0 THEN '?' || array_to_string({_canon_pairs}, '&') ELSE '' END AS canonical, {_domain} AS domain, FALSE AS private, TRUE AS safe FROM pages",
        "posting_urls": f"""{w}h AS (SELECT page_id, page_id % 7 AS k FROM pages), v AS (SELECT page_id, CASE k WHEN 0 THEN 'https://boards.greenhouse.io/acme/jobs/' || page_id WHEN 1 THEN 'https://jobs.lever.co/acme/' || page_id WHEN 2 THEN 'https://jobs.ashbyhq.com/acme/' || page_id
          WHEN 3 THEN 'https://careers.smartrecruiters.com/acme/' || page_id WHEN 4 THEN 'https://jobs.lever.co.greenhouse.io/x/' || page_id WHEN 5 THEN 'https://www.example.com/jobs/' || page_id ELSE 'https://example.org/to/greenhouse.io/' || page_id END AS canonical, k FROM h)
          SELECT page_id, 'made' AS kind, canonical, CASE k WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 3 THEN 'smartrecruiters' WHEN 4 THEN 'greenhouse' END AS system, k = 5 AS own FROM v
          UNION ALL SELECT page_id, 'own', {_canonical}, {_system}, {_host} = 'example.com' OR {_host} LIKE '%.example.com' FROM pages""",
        "pages_by_site": f"SELECT {_domain} AS site, count(*) AS n_pages, min(page_id) AS first_page FROM pages GROUP BY 1",
        "keyword_gates": f"{w}{JUDGED} SELECT pos, is_internship, salary_bucket, keep, coalesce(drop_reason, '') AS drop_reason FROM j",
        "scores": f"{w}{JUDGED} SELECT pos, match_score, reasons FROM j",
        "page_text": f"""WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<!--.*?-->|<!doctype[^>]*>|<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', '', 'gis') AS t FROM pages),
          b AS (SELECT page_id, regexp_replace(regexp_replace(t, '<br[^>]*>|</({"|".join(sorted(BLOCKS))})>', chr(10), 'gi'), '<[^>]*>', '', 'g') AS t FROM a),
          c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM b)
          SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(160))), lambda x: x <> ''), chr(10)) AS page_text FROM c""",
        "required_years": f"{w}{POSTINGS}{_years()} SELECT key, years FROM yr WHERE years IS NOT NULL",
        "pay_normalise": f"""{w}o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN round_even(o_totalprice, 0)::BIGINT END AS lo, CASE WHEN o_orderkey % 5 <> 0 THEN round_even(o_totalprice, 0)::BIGINT * 2 END AS hi, {_pick(CURRENCIES, "o_orderkey")} AS c, {_pick(PERIODS, "o_orderkey")} AS per FROM orders)
          SELECT o_orderkey, {_converted("lo", "c", "per")} AS low, {_converted("hi", "c", "per")} AS high, per IS NOT NULL AND {_fx("c")} IS NOT NULL AND coalesce(lo, hi) IS NOT NULL AS parsed,
          coalesce({_converted("hi", "c", "per")}, {_converted("lo", "c", "per")}) AS shown, c || ' ' || CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo || '-' || hi ELSE coalesce(lo, hi)::VARCHAR END || coalesce('/' || per, '') AS raw FROM o""",
        "salary_buckets": f"{w}{ENRICHED} SELECT is_internship, remote, salary_bucket, count(*) AS n, sum(salary_max)::BIGINT AS sum_max FROM e GROUP BY 1, 2, 3",
        "drop_funnel": f"""{w}{JUDGED}, d AS (SELECT source, string_split(coalesce(drop_reason, 'kept'), ':')[1] AS reason FROM j), c AS (SELECT source, reason, count(*) AS n, grouping_id(source, reason) AS level FROM d GROUP BY ROLLUP (source, reason))
          SELECT coalesce(c.source, '(all)') AS source, coalesce(c.reason, '(all)') AS reason, c.n, round(c.n::DOUBLE / x.n, 9) AS share FROM c JOIN c x ON c.source IS NOT DISTINCT FROM x.source AND x.level = CASE WHEN c.level = 3 THEN 3 ELSE 1 END""",
        "feed_page": f"{w}{JOBS} SELECT job_uid, title, company, match_score, posted_at, status FROM jobs WHERE (lower(title) LIKE '%engineer%' OR lower(company) LIKE '%engineer%') AND NOT coalesce(is_remote, FALSE) AND status IN ('new', 'active') ORDER BY posted_at DESC NULLS LAST, match_score DESC NULLS LAST, job_uid LIMIT 40 OFFSET 5",
        "feed_count": f"{w}{JOBS} " + " UNION ALL ".join(f"SELECT '{n}' AS view, count(*) AS total FROM jobs WHERE {c}" for n, c in views.items()),
        "status_counts": f"{w}{JOBS} SELECT status, count(*) AS n FROM jobs GROUP BY 1",
        "distinct_sources": f"{w}{JOBS} SELECT DISTINCT source FROM jobs ORDER BY 1",
        "new_in_run": f"{w}{JOBS} SELECT job_uid, match_score, source FROM jobs WHERE status = 'new' AND last_seen_cycle = 2",
        "recent_active": f"{w}{JOBS} SELECT job_uid, posted_at, last_seen_at, status FROM jobs WHERE status IN ('new', 'active') ORDER BY posted_at DESC NULLS LAST, last_seen_at DESC, job_uid LIMIT 100",
        "run_outcomes": f"{w}{OUTCOMES} SELECT run_id, source, succeeded, exhaustive, n_fetched, error FROM oc",
        "run_status": f"{w}{METRICS} SELECT run_id, n_sources_ok, n_sources_err, n_fetched, status, error FROM ms",
        "last_outcomes": f"{w}{DAYS} SELECT run_id, source, event_id, value FROM (SELECT day AS run_id, event_type AS source, event_id, value, row_number() OVER (PARTITION BY day, event_type ORDER BY ts DESC, event_id DESC) AS r FROM ev) WHERE r = 1",
        "upsert_merge": f"{w}{TWO} SELECT job_uid, source, title, salary_max, first_seen_at, last_seen_at, last_seen_cycle, status, FALSE AS applied FROM tw",
        "upsert_metrics": f"""{w}{DAYS}, {_event_cycle(1, FIRST)}, b AS (SELECT user_id::VARCHAR AS job_uid, event_id % 5 <> 0 AS keep FROM ev WHERE {SECOND}), k AS (SELECT b.*, s1.job_uid IS NOT NULL AS known FROM b LEFT JOIN s1 USING (job_uid))
          SELECT count(DISTINCT CASE WHEN keep AND NOT known THEN job_uid END) AS n_new, count(*) FILTER (keep) - count(DISTINCT CASE WHEN keep AND NOT known THEN job_uid END) AS n_updated, count(*) FILTER (NOT keep) AS n_filtered FROM k""",
        "age_out": f"{w}{AGED} SELECT * FROM ag",
        "expired_count": f"{w}{AGED} SELECT count(*) FILTER (went_stale) + count(*) FILTER (went_deleted) AS n_expired FROM ag",
        "lifecycle_replay": f"""{w}{OUTCOMES}, sg AS (SELECT user_id AS uid, day AS cycle, min(event_type) AS source FROM ev GROUP BY 1, 2), ow AS (SELECT uid, arg_min(source, cycle) AS source, min(cycle) AS first_cycle FROM sg GROUP BY 1),
          g AS (SELECT ow.uid, oc.run_id AS cycle, ow.source, first_cycle, oc.succeeded, sg.uid IS NOT NULL AS seen FROM ow JOIN oc ON oc.source = ow.source AND oc.run_id >= first_cycle LEFT JOIN sg ON sg.uid = ow.uid AND sg.cycle = oc.run_id),
          z AS (SELECT *, max(CASE WHEN seen THEN cycle END) OVER (PARTITION BY uid ORDER BY cycle) AS last_seen_cycle, max(CASE WHEN NOT seen AND succeeded THEN cycle END) OVER (PARTITION BY uid ORDER BY cycle) AS missed FROM g)
          SELECT uid, cycle, source, last_seen_cycle, CASE WHEN cycle = first_cycle THEN 'new' WHEN seen THEN 'active' WHEN coalesce(missed - last_seen_cycle, 0) <= 0 THEN CASE WHEN last_seen_cycle = first_cycle THEN 'new' ELSE 'active' END WHEN missed - last_seen_cycle > 3 THEN 'deleted' ELSE 'stale' END AS status FROM z""",
        "orphan_runs": f"{w}{RUNS} SELECT run_id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' THEN TIMESTAMP '{AS_OF}' ELSE finished_at END AS finished_at, CASE WHEN status = 'running' AND error = '' THEN 'interrupted' ELSE error END AS error FROM rn",
        "latest_runs": f"{w}{RUNS} SELECT coalesce(max(run_id) FILTER (status = 'running'), max(run_id)) AS current_run, max(run_id) FILTER (status = 'success') AS last_success, max(run_id) FILTER (status IN ('success', 'partial')) AS last_completed FROM rn",
        "overdue_cycles": f"""{w}{RUNS}, dn AS (SELECT run_id, finished_at, lag(finished_at) OVER (ORDER BY finished_at, run_id) AS previous, lead(finished_at) OVER (ORDER BY finished_at, run_id) AS following FROM rn WHERE status IN ('success', 'partial'))
          SELECT run_id, finished_at, previous, coalesce(finished_at - previous > INTERVAL 24 HOUR, FALSE) AS late, following IS NULL AND TIMESTAMP '{AS_OF}' - finished_at >= INTERVAL 24 HOUR AS due FROM dn""",
        "run_history": f"{w}{RUNS} SELECT run_id, status FROM rn ORDER BY run_id DESC LIMIT 20",
        "run_summaries": f"""{w}{METRICS} SELECT run_id, concat_ws(chr(10), (CASE status WHEN 'success' THEN '🟢' WHEN 'partial' THEN '🟠' ELSE '🔴' END) || ' <b>Run #' || run_id || '</b> [' || status || '] · scheduled', 'new 1 · updated ' || n_fetched || ' · expired 0 · filtered 2',
          'sources ok ' || n_sources_ok || ' / err ' || n_sources_err, CASE WHEN len(failed) > 0 THEN 'failed: ' || array_to_string(failed[1:6], ', ') END,
          CASE WHEN run_id % 2 = 0 THEN 'Dashboard: http://192.168.1.5:8770/' ELSE '<a href="https://feed.example.com/?a=1&amp;b=2">Open dashboard →</a>' END) AS text FROM ms""",
        "orphan_cycles": f"{w}{TWO}, {RUNS.removeprefix(DAYS + ', ')} SELECT job_uid, last_seen_cycle FROM tw WHERE last_seen_cycle NOT IN (SELECT run_id FROM rn WHERE status = 'success')",
        "flag_latest": f"{w}{FLAGS} SELECT job_uid, field, value FROM fl",
        "flags_applied": f"""{w}{TWO}, {FLAGS}, pv AS (SELECT tw.job_uid, {", ".join(f"coalesce(bool_or(value) FILTER (field = '{c}'), FALSE) AS {c}" for c in USER_FLAGS)} FROM tw LEFT JOIN fl ON tw.job_uid = fl.job_uid GROUP BY 1)
          SELECT {", ".join(USER_FLAGS)}, count(*) AS n FROM pv GROUP BY ALL""",
        "flags_unmatched": f"{w}{TWO}, {FLAGS} SELECT job_uid, count(*) AS n FROM fe WHERE job_uid NOT IN (SELECT job_uid FROM tw WHERE last_seen_cycle = 2) GROUP BY 1",
        "row_decode": f"{w}{JOBS} SELECT job_uid, source, title, is_remote, salary_min, salary_parsed, salary_bucket, is_internship, posted_at FROM jobs",
        "fields_set": f"""{w}{TWO}, {CHANGES}, lc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_uid, field ORDER BY ts DESC, event_id DESC) AS r FROM ch) WHERE r = 1)
          SELECT tw.job_uid, coalesce(bool_or(value <> 'false') FILTER (field = 'applied'), FALSE) AS applied, coalesce(bool_or(value <> 'false') FILTER (field = 'hidden'), FALSE) AS hidden, max(trim(value)) FILTER (field = 'notes') AS notes, max(trim(value)) FILTER (field = 'extra_context') AS extra_context
          FROM tw LEFT JOIN lc ON tw.job_uid = lc.job_uid GROUP BY 1""",
        "fields_refused": f"""{w}{TWO}, {CHANGES}, rf AS (SELECT field, CASE WHEN field = 'status' THEN 'unknown field' WHEN job_uid NOT IN (SELECT job_uid FROM tw WHERE last_seen_cycle = 2) THEN 'no such posting' END AS why FROM ch)
          SELECT field, why, count(*) AS n FROM rf WHERE why IS NOT NULL GROUP BY 1, 2""",
        "postings_of_succeeded": f"{w}{POSTINGS} SELECT source, count(*) AS n, min(pos) AS first_pos FROM p GROUP BY 1 HAVING count(*) % 3 <> 0",
        "succeeded_sources": f"{w}{OUTCOMES} SELECT run_id, source, exhaustive FROM oc WHERE succeeded",
        "run_view": f"{w}{RUNS} SELECT run_id, rn.status, (SELECT string_agg(concat_ws(':', source, succeeded::VARCHAR, n_fetched::VARCHAR, oc.error), ';' ORDER BY source) FROM oc WHERE oc.run_id = rn.run_id) AS outcomes FROM rn",
        "run_rows": f"""{w}{RUNS} SELECT rn.run_id, started_at, finished_at, rn.status, 'scheduled' AS trigger, n_sources_ok, n_sources_err FROM rn JOIN ms USING (run_id)
          UNION ALL SELECT 1000, TIMESTAMP '{AS_OF}', TIMESTAMP '2024-02-01 01:00:00', 'partial', 'manual', 3, 1""",
        "details_filled": f"{w}{JOBS} SELECT job_uid, md5(CASE WHEN job_uid < '8' THEN 'All of: ' || title ELSE description END) AS digest, regexp_matches(source, '[12]$') AND NOT job_uid < '8' AS is_preview FROM jobs",
        "internships_backfilled": f"{w}{JOBS} SELECT job_uid, is_internship FROM jobs",
        "lists_split": "SELECT p_partkey, p_name || '|' || p_type || '|' || p_brand AS items FROM part",
        "skill_groups": f"""{w}n AS (SELECT DISTINCT p_brand, p_type, p_name, string_split({_pick(["red ring", "blue bolt hot", "old widget"], "length(p_brand) + ascii(right(p_brand, 1))")}, ' ') AS keywords FROM part),
          g AS (SELECT p_brand, p_type, count(*) FILTER (list_has_any(string_split(p_name, ' '), keywords)) AS hits FROM n GROUP BY 1, 2) SELECT p_brand, string_agg(p_type, ',' ORDER BY hits DESC, p_type) AS ranked FROM g GROUP BY 1""",
        "candidate_pools": f"""{w}ju AS (SELECT conv_id || '-' || turn AS job_uid, {_words("concat_ws(' ', text, " + _pick(["red ring", "blue bolt standard", "green widget large", "economy"], "turn") + ")")} AS words FROM conversations),
          pr AS (SELECT p_brand || ' ' || p_type AS project, min(p_partkey) AS ord, {_words("string_agg(DISTINCT p_name || ' ' || p_type, ' ')")} AS terms FROM part GROUP BY 1), al AS (SELECT job_uid, project, ord, len(list_intersect(words, terms)) AS score FROM ju CROSS JOIN pr),
          rk AS (SELECT *, row_number() OVER (PARTITION BY job_uid ORDER BY score DESC, ord, project) AS rank FROM al) SELECT job_uid, count(*) AS n, sum(score)::BIGINT AS score, arg_max(project, rank) AS last FROM rk WHERE rank <= 40 GROUP BY 1""",
        "source_catalogue": f"""WITH b AS (SELECT unnest({board_names}) AS source, unnest(range({len(MAPPERS)})) AS i), n AS (SELECT s_nationkey, count(*) FILTER (s_suppkey % 2 = 0) AS n FROM supplier GROUP BY 1)
          SELECT s_suppkey::VARCHAR AS feed, source, (i + 1)::INTEGER AS ord, (s_suppkey + i) % 3 <> 0 AND (source NOT IN ('adzuna', 'jooble') OR (s_suppkey + i) % 4 <> 0)
            AND (source NOT IN ('greenhouse', 'lever', 'ashby', 'smartrecruiters') OR source = 'lever' OR source = 'ashby' AND n > 0) AS enabled FROM supplier JOIN n USING (s_nationkey), b""",
        "profiles_read": """SELECT p_brand AS person, min(p_name) OVER (PARTITION BY p_brand) AS name, count(*) OVER (PARTITION BY p_brand) AS n_projects, 'P-' || p_partkey AS project, p_type AS tagline, replace(p_name, ' ', '+') AS tech, 'Size ' || p_size AS bullets, 0 AS n_skills FROM part""",
        "rewrites_parsed": r"""WITH c AS (SELECT conv_id || '-' || turn AS key, 'P' || turn % 3 AS project, trim(regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g')) AS t FROM conversations)
          SELECT key, 1 AS section, project, md5(CASE WHEN t = '' THEN '-' ELSE t END) AS bullet FROM c UNION ALL SELECT key, 1, project, md5('kept') FROM c UNION ALL SELECT key, 2, 'Q', md5('last') FROM c""",
        "tailored": f"""{w}dj AS (SELECT doc_id, unnest({_words("concat_ws(' ', " + _pick(["red ring", "blue bolt"], "doc_id") + ", text)")}) AS word FROM documents),
          pr AS (SELECT p_brand AS project, min(p_partkey) AS ord, string_agg(DISTINCT p_name, ' ') AS text, count(*) AS n FROM part GROUP BY 1), pt AS (SELECT project, ord, unnest({_words("text")}) AS word FROM pr),
          sc AS (SELECT doc_id, project, count(*) AS score FROM dj JOIN pt USING (word) GROUP BY 1, 2), al AS (SELECT d.doc_id, pr.project, pr.ord, coalesce(score, 0) AS score FROM documents d CROSS JOIN pr LEFT JOIN sc ON sc.doc_id = d.doc_id AND sc.project = pr.project),
          tp AS (SELECT doc_id, string_agg(project, ',' ORDER BY score DESC, ord, project) AS projects FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord, project) AS rank FROM al) WHERE rank <= 2 GROUP BY 1),
          rw AS (SELECT doc_id, n, doc_id % 2 * 7 AS said FROM documents, pr WHERE project = 'Brand#2' AND doc_id % 3 = 0)
          SELECT tp.doc_id::VARCHAR AS job_uid, CASE WHEN rw.doc_id IS NOT NULL THEN 'Brand#2' ELSE projects END AS projects, 1.0::DOUBLE AS preservation,
            CASE WHEN said <> n THEN 'Brand#2: rejected a rewrite with unsupported facts;Brand#2: kept the original bullets' ELSE '' END AS flags, rw.doc_id IS NOT NULL AS used_rewrites FROM tp LEFT JOIN rw USING (doc_id)""",
        "posting_texts": f"""{w}{JOBS} SELECT job_uid, coalesce(title, '') || chr(10) || left(array_to_string(list_filter(list_transform(string_split(coalesce(description, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(160))), lambda x: x <> ''), chr(10)), {MOST_CHARS})
          || chr(10) || chr(10) || 'Additional context:' || chr(10) || 'see ' || source AS text FROM jobs""",
        "published": f"""{w}{JOBS} SELECT 'chat' AS sink, least(count(*), 20) AS n_items FROM jobs WHERE status = 'new' UNION ALL SELECT 'mail', count(*) FROM jobs WHERE status = 'new' UNION ALL SELECT 'feed', least(count(*), 100) FROM jobs WHERE status IN ('new', 'active')""",
        "values_coerced": f"""SELECT event_id, CASE WHEN event_id % 6 = 5 THEN CASE WHEN event_id % 4 IN (1, 2) AND user_id <= 18 THEN power(10, user_id)::BIGINT END WHEN event_id % 6 IN (0, 1, 4) AND event_id % 4 <> 3 AND user_id > 0 THEN user_id END AS whole,
          CASE WHEN event_id % 9 < 3 THEN TRUE WHEN event_id % 9 < 6 THEN FALSE END AS flag, nullif(trim({_pick(["true", " YES ", "1", "no", "False", "0", "maybe", "", None], "event_id")}), '') AS filled,
          CASE WHEN user_id % 5 <> 0 THEN user_id * 100 END AS low, CASE WHEN user_id % 5 <> 0 THEN CASE WHEN user_id % 2 = 0 THEN user_id * 200 ELSE user_id * 100 END END AS high,
          {_pick(["year", "month", "week", "hour", None], "user_id")} AS period, {_pick(["INR", "USD", "INR", None], "user_id")} AS currency, {_pick([None, "month", "week", "hour", None], "user_id")} AS unit FROM events""",
        "walk_completeness": walks,
        "source_outcomes": f"{w}{JUDGED} SELECT source, TRUE AS succeeded, count(*) FILTER (keep) AS n_fetched FROM j GROUP BY 1 UNION ALL SELECT DISTINCT source || '-empty', FALSE, 0 FROM j",
        "company_outcomes": f"""{w}{DAYS}, pc AS (SELECT event_type AS source, 'co' || (user_id % 4) AS company, max(value) < 300 AND event_type <> 'error' AS succeeded, count(*) AS n_fetched FROM ev GROUP BY event_type, user_id % 4),
          wh AS (SELECT source, bool_or(succeeded) AS any_ok, string_agg(CASE WHEN NOT succeeded THEN company || ': not found' END, '; ' ORDER BY company) AS errors FROM pc GROUP BY 1)
          SELECT source || '_' || company AS source, succeeded, n_fetched, CASE WHEN NOT succeeded THEN errors END AS error FROM pc JOIN wh USING (source) WHERE any_ok UNION ALL SELECT source, FALSE, 0, errors FROM wh WHERE NOT any_ok""",
        "site_stats": f"{w}{DAYS} SELECT event_type AS site, count(*) AS calls, count(*) FILTER (event_id % 17 = 0) AS errors, sum(day)::BIGINT AS n_rows, sum(user_id % 3)::BIGINT AS n_jobs, 'e' || max(CASE WHEN event_id % 17 = 0 THEN event_id END) AS last_error, sum(user_id % 3) > 0 AS succeeded FROM ev GROUP BY 1",
        "digest_text": f"""{w}{JOBS}, nw AS (SELECT *, row_number() OVER ({TOP}) AS n FROM jobs WHERE status = 'new'), tx AS (SELECT '<b>' || count(*) || ' new job' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || '</b>' || chr(10) || coalesce(chr(10) || (SELECT string_agg({line}, chr(10) ORDER BY n) FROM nw WHERE n <= 20), '')
          || CASE WHEN count(*) > 20 THEN chr(10) || chr(10) || '…and ' || (count(*) - 20) || ' more.' ELSE '' END AS text FROM nw) SELECT CASE WHEN length(text) > 4096 THEN substr(text, 1, 4095) || '…' ELSE text END AS text FROM tx""",
        "mail_text": f"""{w}{JOBS}, nw AS (SELECT *, row_number() OVER ({TOP}) AS n, count(*) OVER () AS total FROM jobs WHERE status = 'new')
          SELECT (n - 1) // {MAIL_ITEMS} + 1 AS mail, '[feed] ' || any_value(total) || ' new job' || CASE WHEN any_value(total) = 1 THEN '' ELSE 's' END || CASE WHEN any_value(total) > {MAIL_ITEMS} THEN ' (' || ((any_value(n) - 1) // {MAIL_ITEMS} + 1) || '/' || ((any_value(total) - 1) // {MAIL_ITEMS} + 1) || ')' ELSE '' END AS subject,
          string_agg(concat_ws(chr(10), n || '. ' || title || ' — ' || company, '   ' || nullif({META}, ''), '   ' || url), chr(10) || chr(10) ORDER BY n) || chr(10) AS body FROM nw GROUP BY 1""",
        "feed_entries": f"{w}{JOBS} SELECT job_uid, {ENTRY} AS entry FROM jobs",
        "atom_feed": f"""{w}{JOBS}, lt AS (SELECT *, row_number() OVER (ORDER BY posted_at DESC NULLS LAST, last_seen_at DESC NULLS LAST, job_uid) AS n FROM jobs), tx AS (SELECT *, {ENTRY} AS entry FROM lt WHERE n <= 100)
          SELECT '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<feed xmlns="http://www.w3.org/2005/Atom">' || chr(10) || '  <id>urn:feed</id>' || chr(10) || '  <title>Postings</title>' || chr(10) || '  <updated>' || {_rfc(f"TIMESTAMP '{AS_OF}'")} || '</updated>' || chr(10)
          || '  <author><name>Postings</name></author>' || chr(10) || '  <link rel="alternate" href="http://localhost/"/>' || chr(10) || coalesce(string_agg(entry, chr(10) ORDER BY posted_at DESC NULLS LAST, job_uid) || chr(10), '') || '</feed>' AS xml FROM tx""",
        "listing_cards": f"""SELECT page_id, 0 AS pos, page_id::VARCHAR AS id, '/d/' || page_id AS href, 'Python Development' AS title, 'Acme ' || (page_id % 5) AS company, '₹ ' || {_money("page_id * 100 + 1000")} || CASE WHEN page_id % 2 = 0 THEN ' - 90,000' ELSE '' END || ' /month' AS stipend,
          CASE WHEN page_id % 3 = 0 THEN 'Work From Home' ELSE 'Pune' END AS location, (page_id % 9 + 1) || ' days ago' AS ago FROM pages""",
        "keyword_overlap_topk": f"""{w}dj AS (SELECT doc_id::VARCHAR AS job_uid, unnest({_words("concat_ws(' ', text, " + _pick(["red small ring", "blue bolt promo", "green widget large", "economy standard ring"], "doc_id") + ")")}) AS word FROM documents),
          ju AS (SELECT doc_id::VARCHAR AS job_uid FROM documents), pr AS (SELECT p_brand AS project, min(p_partkey) AS ord, string_agg(DISTINCT p_name || ' ' || p_type, ' ') AS text FROM part GROUP BY 1), pt AS (SELECT project, ord, unnest({_words("text")}) AS word FROM pr),
          sc AS (SELECT job_uid, project, ord, count(*) AS score FROM dj JOIN pt USING (word) GROUP BY 1, 2, 3), al AS (SELECT ju.job_uid, pr.project, pr.ord, coalesce(score, 0) AS score FROM ju CROSS JOIN pr LEFT JOIN sc ON sc.job_uid = ju.job_uid AND sc.project = pr.project)
          SELECT job_uid, project, ord, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_uid ORDER BY score DESC, ord, project) AS rank FROM al) WHERE rank <= 3""",
        "profiles_ranked": f"""{w}dj AS (SELECT doc_id::VARCHAR AS job_uid, unnest({_words("text")}) AS word FROM documents), pr AS (SELECT conv_id || '-' || turn AS project, conv_id * 1000 + turn AS ord, text FROM conversations), pt AS (SELECT project, ord, unnest({_words("text")}) AS word FROM pr),
          sc AS (SELECT job_uid, project, ord, count(*) AS score FROM dj JOIN pt USING (word) GROUP BY 1, 2, 3), f AS (SELECT project, ord FROM pr ORDER BY ord, project LIMIT 3),
          al AS (SELECT * FROM sc UNION ALL SELECT doc_id::VARCHAR, project, ord, 0 FROM documents, f WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.job_uid = doc_id::VARCHAR AND sc.project = f.project))
          SELECT job_uid, project, ord, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_uid ORDER BY score DESC, ord, project) AS rank FROM al) WHERE rank <= 3""",
        "number_guard": f"{w}{REWRITES}, nn AS (SELECT *, {_numbers('source_text')} AS a, {_numbers('new_text')} AS b FROM rw) SELECT conv_id, turn, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS ok, array_to_string(list_sort(b), ',') AS numbers FROM nn",
        "fact_preservation": f"{w}{REWRITES}, nn AS (SELECT *, {_numbers('source_text')} AS a, {_numbers('new_text')} AS b FROM rw), sh AS (SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(a, lambda x: list_contains(b, x)))::DOUBLE / len(a) END AS share FROM nn) SELECT conv_id, turn, round(share, 9) AS share, share < 0.8 AS flagged FROM sh",
        "source_mappers": f"{w}{MAPPED} SELECT source, source_native_id, job_uid, is_remote, salary_min, salary_max, salary_currency, salary_period, posted_at, description_md5, url FROM u",
        "board_pages": f"""{w}{POSTINGS}, b AS (SELECT unnest(['lever', 'jobicy', 'unstop']) AS board, pos, {_key} AS company_key FROM p), k AS (SELECT *, board <> 'lever' OR pos % 10 <> 0 AS ok FROM b)
          SELECT board, company_key, ok, count(*) AS n_pages, sum(CASE WHEN ok THEN 2 ELSE 0 END)::BIGINT AS n_items FROM k GROUP BY ALL""",
        "scraped_frame": f"""{w}{SCRAPED} SELECT source, job_uid, url, is_remote, CASE WHEN {_scraped_known} THEN round_even(lo * {_fx("c")} * {_month(_scraped_period)}, 0)::BIGINT END AS salary_min, CASE WHEN {_scraped_known} THEN round_even(hi * {_fx("c")} * {_month(_scraped_period)}, 0)::BIGINT END AS salary_max,
          {_scraped_known} AS salary_parsed, coalesce(c || ' ', '') || coalesce(lo::BIGINT || '-', '') || hi::BIGINT || coalesce('/' || per, '') AS salary_raw, posted_at FROM u""",
        "listing_postings": f"{w}{LISTED} SELECT job_uid, source_native_id, title, company, location, is_remote, url, description, salary_min, salary_max, posted_at FROM u",
        "json_props": "SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN event_id % 4 < 3 THEN (event_id % 4) || '= v' ELSE '' END AS plan FROM events",
        "transcript_last_event": """WITH l AS (SELECT conv_id AS key, turn, role, turn % 2 = 1 AS hit FROM conversations), g AS (SELECT key, bool_or(hit) AS found, max(CASE WHEN hit THEN turn END) AS t, string_agg(coalesce(role, ''), chr(10) ORDER BY turn) AS whole FROM l GROUP BY 1)
          SELECT key, found AND key % 2 = 0 AS is_error, found, CASE WHEN found THEN 'a' || t ELSE '' END AS filled, found AS needs_login, CASE WHEN found THEN '' ELSE 'agent report unparsed; raw tail: ' || right(trim(whole), 300) END AS notes FROM g""",
        "source_dedup": f"""{w}{POSTINGS}, x AS (SELECT source, CASE WHEN pos % 5 = 0 THEN '' ELSE company || title END AS key, pos FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY pos) AS n FROM x) SELECT source, key, pos FROM r WHERE n = 1 OR key = ''""",
        "dates_parsed": f"""SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2) THEN date_trunc('second', ts) WHEN event_id % 6 = 3 THEN date_trunc('day', ts) WHEN event_id % 6 = 4 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE END AS parsed,
          CASE event_id % 5 WHEN 0 THEN TIMESTAMP '{AS_OF}' - to_days(CAST(user_id % 9 AS INTEGER)) WHEN 1 THEN TIMESTAMP '{AS_OF}' - to_days(CAST(user_id % 9 * 7 AS INTEGER)) WHEN 2 THEN TIMESTAMP '{AS_OF}' WHEN 3 THEN TIMESTAMP '{AS_OF}' - to_days(CAST(user_id % 9 * 30 AS INTEGER)) END AS posted FROM events""",
        "stream_writes": f"{w}{_streamed()} SELECT last_seen_cycle, count(*) AS n_rows, count(*) FILTER (status = 'active') AS n_active FROM r{CYCLES} GROUP BY 1",
        "stream_recent": f"""{w}{DAYS}, l AS (SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN ts END AS posted, least(greatest((day - 1) // {CYCLE_DAYS}, 0), {CYCLES - 1}) + CASE WHEN event_id % 10 = 3 THEN {LATE_BY} ELSE 0 END AS landed FROM ev),
          a AS (SELECT * FROM l UNION ALL SELECT event_id, posted, landed + 1 FROM l WHERE event_id % 7 = 0), b AS (SELECT landed, max(posted) AS newest FROM a GROUP BY 1),
          m AS (SELECT landed, max(newest) OVER (ORDER BY landed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - to_days({LATE_AGE}) AS mark FROM b)
          SELECT event_id::VARCHAR AS job_uid, min(landed) AS landed FROM a JOIN m USING (landed) WHERE posted IS NULL OR mark IS NULL OR posted > mark GROUP BY 1""",
        "stream_walks": walks,
        "lifecycle_intervals": f"{w}{INTERVALS}",
        "stream_ingest_equals_batch": f"{w}{_streamed()} SELECT job_uid, source, title, first_seen_at, last_seen_at, last_seen_cycle, status FROM r{CYCLES}",
    }
