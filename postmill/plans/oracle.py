"""The registered queries in plain SQL (DuckDB dialect), written from the rules, not from the plans.

Tagging runs every regular expression on every text here, deduplication uses window
functions and the store uses full joins, so each side checks the other.
"""

from __future__ import annotations

import re

from postmill.functions import vocabulary as V
from postmill.functions.dates import POLICIES
from postmill.functions.jobtype import FROM_STORE, TO_STORE
from postmill.functions.urls import BASE_URLS
from postmill.plans import posting_view as P

SPACE = r"[ \t\n\r\f\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
AS_OF = f"TIMESTAMP '{P.AS_OF}'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]" if values else "[]::VARCHAR[]"


def sql_map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in table.items()) + "}"


def ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def joined(expr: str) -> str:
    return f"coalesce(array_to_string({expr}, '|'), '')"


def ordered_distinct(expr: str) -> str:
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def collapse(expr: str) -> str:
    return f"regexp_replace({expr}, '{SPACE}+', ' ', 'g')"


def trim(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def clean(expr: str) -> str:
    return trim(f"regexp_replace(replace({collapse(expr)}, '…', ''), '(?i)\\bnew([0-9])', '\\1')")


def norm(expr: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({expr}), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def signature(title: str, company: str) -> str:
    words = f"list_filter(string_split({norm(title)}, ' '), lambda w: length(w) > 2)"
    return f"array_to_string({words}[1:3], ' ') || '::' || {norm(company)}"


def matches(expr: str, regex: str) -> str:
    return f"regexp_matches({expr}, {q(regex)})"


def _no_continuation(expr: str, phrase: str, after: str) -> str:
    """`phrase` occurs somewhere without `after` behind it, for an engine without look-ahead."""
    return matches(f"regexp_replace({expr}, {q(phrase + after)}, '~', 'g')", phrase)


def skills(expr: str) -> str:
    """K1 as a list, `expr` being the folded text."""
    items, seen = [], {}
    for s in V.SKILLS:
        alternatives = [V.phrase_regex(p) for p in s.words + s.tags] + [r for _, r in s.regexes]
        tests = [matches(expr, "|".join(alternatives))] if alternatives else []
        for word, after in s.unless:
            if after == r"\s":
                tests.append(matches(expr, rf"\b{word}([^\w\s]|$)"))
            else:
                tests.append(_no_continuation(expr, rf"\b{word}\b", after))
        test = "(" + " OR ".join(tests) + ")"
        if s.name in seen:
            items.append(f"CASE WHEN {test} AND NOT {seen[s.name]} THEN {q(s.name)} END")
        else:
            seen[s.name] = test
            items.append(f"CASE WHEN {test} THEN {q(s.name)} END")
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


def fold(expr: str) -> str:
    return f"regexp_replace(lower(coalesce({expr}, '')), '[^\\w\\s.+#-]', ' ', 'g')"


def _phrases(phrases) -> str:
    return "|".join(V.phrase_regex(p, literal=False) for p in phrases)


def seniority(lower_title: str) -> str:
    return (
        f"CASE WHEN {matches(lower_title, _phrases(V.SENIOR_MARKERS))} THEN 'senior' "
        f"WHEN {matches(lower_title, _phrases(V.JUNIOR_MARKERS))} THEN 'junior' ELSE 'mid' END"
    )


def role_test(lower_title: str, role: V.Role) -> str:
    tests = [matches(lower_title, _phrases(role.phrases))]
    for phrase, words in role.followed:
        tests.append(matches(lower_title, V.phrase_regex(phrase, literal=False) + rf"\s*({'|'.join(words)})"))
    for phrase, words in role.unless:
        tests.append(
            _no_continuation(lower_title, V.phrase_regex(phrase, literal=False), rf"\s*({'|'.join(words)})")
        )
    return "(" + " OR ".join(tests) + ")"


def roles(lower_title: str) -> str:
    items = [f"CASE WHEN {role_test(lower_title, r)} THEN {q(r.name)} END" for r in V.ROLES]
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


def normalized(expr: str) -> str:
    return f"list_transform({expr}, lambda s: coalesce({sql_map(V.alias_dictionary())}[lower(trim(s))], trim(s)))"


def implied_raw(role_list: str, level: str) -> str:
    """Skills of each detected role up to the level, in order."""
    parts = []
    for role, levels in V.ROLE_SKILLS.items():
        steps = [array(dict.fromkeys(n for lv in V.LEVELS[: i + 1] for n in levels[lv])) for i in range(3)]
        upto = f"CASE {level} WHEN 'junior' THEN {steps[0]} WHEN 'mid' THEN {steps[1]} ELSE {steps[2]} END"
        parts.append(f"CASE WHEN list_contains({role_list}, {q(role)}) THEN {upto} ELSE []::VARCHAR[] END")
    return "flatten([" + ", ".join(parts) + "])"


def merged_ci(expr: str) -> str:
    low = f"list_transform({expr}, lambda y: lower(y))"
    return f"list_filter({expr}, lambda x, i: list_position({low}, lower(x)) = i)"


def job_type(expr: str) -> str:
    t = f"lower({expr})"
    has = lambda *n: "(" + " OR ".join(f"contains({t}, {q(x)})" for x in n) + ")"
    intern = (
        f"({matches(t, r'\binternship\b|\bgraduate\s+role\b|\bstudent\s+position\b')}"
        f" OR {_no_continuation(t, r'\bintern\b', r'\s*ational')})"
    )
    senior = matches(
        t, r"\b(senior|staff|lead|principal|architect|manager|director|years\s+(of\s+)?experience)\b"
    )
    return (
        f"CASE WHEN {intern} THEN CASE WHEN {senior} THEN 'full-time' ELSE 'internship' END "
        f"WHEN {has('contract', 'freelance', 'consultant')} THEN 'contract' "
        f"WHEN {has('part-time', 'part time')} THEN 'part-time' "
        f"WHEN {has('remote', 'work from home')} THEN 'remote' ELSE 'full-time' END"
    )


def location(expr: str, kind: str) -> str:
    bare = f"trim(regexp_replace({clean(expr)}, '(?i)\\bremote\\b', '', 'g'))"
    cut = f"trim(regexp_replace({bare}, '^[,-]', ''))"
    return f"CASE WHEN {kind} = 'remote' THEN coalesce(nullif({cut}, ''), 'Remote') ELSE {clean(expr)} END"


def to_store(expr: str) -> str:
    return f"coalesce({sql_map(TO_STORE)}[lower({expr})], 'FULL_TIME')"


def from_store(expr: str) -> str:
    return f"coalesce({sql_map(FROM_STORE)}[{expr}], 'full-time')"


def canonical(url: str, source: str) -> str:
    bare = f"string_split({url}, '?')[1]"
    absolute = lambda u, b: f"CASE WHEN starts_with({u}, 'http') THEN {u} ELSE {q(BASE_URLS[b])} || {u} END"
    slug = f"regexp_replace(trim({bare}), '\\s+', '-', 'g')"
    jk = f"nullif(regexp_extract({url}, '[?&]jk=([a-zA-Z0-9]+)', 1), '')"
    return (
        f"CASE {source} WHEN 'LinkedIn' THEN {bare} WHEN 'Wuzzuf' THEN {absolute(slug, 'Wuzzuf')} "
        f"WHEN 'Indeed' THEN 'https://www.indeed.com/viewjob?jk=' || {jk} "
        f"WHEN 'Glassdoor' THEN {absolute(url, 'Glassdoor')} WHEN 'Bayt' THEN {absolute(url, 'Bayt')} ELSE {url} END"
    )


# --- relative dates -------------------------------------------------------------------------


def _n(t: str, regex: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({t}, {q(regex)}, 1), '') AS INTEGER)"


def _minus(n: str, unit: str) -> str:
    fn = {"minute": "to_minutes", "hour": "to_hours", "day": "to_days", "week": "to_weeks"}
    if unit == "month30":
        return f"({AS_OF} - to_days({n} * 30))"
    return f"({AS_OF} - {fn[unit]}({n}))"


def _ago(t: str, regex: str, unit: str) -> str:
    return _minus(_n(t, regex), unit)


def _iso(expr: str) -> str:
    return f"CASE WHEN regexp_matches({expr}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST({expr} AS TIMESTAMP) END"


def _if(t: str, needle: str, value: str) -> str:
    return f"CASE WHEN contains({t}, {q(needle)}) THEN {value} END"


def parsed(source: str, expr: str) -> str:
    t = f"lower(trim({expr}))"
    now, day = AS_OF, f"({AS_OF} - to_days(1))"
    if source == "LinkedIn":
        unit = f"regexp_extract({t}, '([0-9]+)\\s*(minute|hour|day|week)', 2)"
        n = _n(t, r"([0-9]+)\s*(minute|hour|day|week)")
        french = f"regexp_extract({t}, 'il y a ([0-9]+)\\s*(minute|heure|jour|semaine)', 2)"
        m = _n(t, r"il y a ([0-9]+)\s*(minute|heure|jour|semaine)")
        cases = [f"CASE {unit} " + " ".join(f"WHEN '{u}' THEN {_minus(n, u)}" for u in ("minute", "hour", "day", "week")) + " END"]
        words = {"minute": "minute", "heure": "hour", "jour": "day", "semaine": "week"}
        cases += [f"CASE {french} " + " ".join(f"WHEN '{w}' THEN {_minus(m, u)}" for w, u in words.items()) + " END"]
        cases += [_iso(expr)]
    elif source == "Wuzzuf":
        cases = [
            _if(t, "today", now), _if(t, "yesterday", day),
            _ago(t, r"([0-9]+)\s*hours?\s*ago", "hour"), _ago(t, r"([0-9]+)\s*days?\s*ago", "day"),
            _ago(t, r"([0-9]+)\s*weeks?\s*ago", "week"), _ago(t, r"([0-9]+)\s*months?\s*ago", "month30"),
            _if(t, "اليوم", now), _if(t, "أمس", day),
            _ago(t, r"منذ\s*([0-9]+)\s*(يوم|أيام)", "day"), _ago(t, r"منذ\s*([0-9]+)\s*(أسبوع|أسابيع)", "week"),
            _ago(t, r"منذ\s*([0-9]+)\s*(شهر|أشهر)", "month30"), _iso(expr),
        ]
    elif source == "Bayt":
        months = _n(t, r"([0-9]+)\s*months?\s*ago")
        run_over = f"(date_trunc('month', {AS_OF}) - to_months({months}) + ({AS_OF} - date_trunc('month', {AS_OF})))"
        cases = [
            _if(t, "yesterday", day), _if(t, "today", now), _if(t, "just posted", now),
            _ago(t, r"([0-9]+)\s*days?\s*ago", "day"), _ago(t, r"([0-9]+)\s*hours?\s*ago", "hour"),
            _ago(t, r"([0-9]+)\s*weeks?\s*ago", "week"), run_over,
        ]
    elif source == "Indeed":
        cases = [
            _if(t, "just posted", now), _if(t, "today", now),
            _ago(t, r"([0-9]+)\s*hours?\s*ago", "hour"), _ago(t, r"([0-9]+)\s*days?\s*ago", "day"),
            _ago(t, r"([0-9]+)\+\s*days?\s*ago", "day"), _ago(t, r"([0-9]+)\s*weeks?\s*ago", "week"), _iso(expr),
        ]
    else:
        cases = [_if(t, "today", now), _if(t, "just posted", now), _if(t, "yesterday", day)]
        for letter, word, unit in (("h", "hour", "hour"), ("d", "day", "day"), ("w", "week", "week"), ("m", "month", "month30")):
            cases += [_ago(t, f"^([0-9]+){letter}$", unit), _ago(t, rf"([0-9]+)\s*{word}s?\s*ago", unit)]
        cases += [_ago(t, r"^([0-9]+)d\+$", "day"), _ago(t, r"([0-9]+)\+\s*days?\s*ago", "day"), _iso(expr)]
    return "coalesce(" + ", ".join(cases) + ")"


def with_policy(source: str, expr: str) -> str:
    fallback = {"now": AS_OF, "minus_3d": f"({AS_OF} - to_days(3))", "drop": "NULL"}[POLICIES[source].on_null]
    return f"coalesce({expr}, {fallback})"


def by_source(fn) -> str:
    return "CASE source " + " ".join(f"WHEN '{s}' THEN {fn(s)}" for s in POLICIES) + " END"


def fresh(posted: str) -> str:
    tests = []
    for name, policy in POLICIES.items():
        test = f"source = '{name}' AND {posted} >= {AS_OF} - to_days({policy.max_age_days})"
        tests.append(f"({test}" + ("" if policy.future_ok else f" AND {posted} <= {AS_OF}") + ")")
    return "(" + " OR ".join(tests) + ")"


# --- the posting view -----------------------------------------------------------------------


def _pick(values, index: str) -> str:
    return f"({array(values)})[{index} % {len(values)} + 1]"


VIEW = f"""
raw AS (
  SELECT doc_id AS posting_no, doc_id AS arrival, d.source AS feed,
    {_pick(P.TITLES, 'doc_id')} AS title,
    c.c_name AS company,
    CASE WHEN doc_id % 7 = 3 THEN 'Remote, ' || n_name ELSE n_name END AS location,
    d.text || ' ' || {_pick(P.TAILS, '(doc_id // 3)')} AS description,
    p.url AS url,
    {_pick(P.SOURCES, 'doc_id')} AS source,
    {_pick(P.PHRASES, '(doc_id // 5)')} AS date_text,
    CASE doc_id % 3 WHEN 1 THEN 'Competitive' WHEN 2 THEN '$' || (50 + doc_id % 100) || 'k' END AS salary,
    {_pick(P.TYPE_TEXTS, 'doc_id')} AS type_text
  FROM documents d
  JOIN customer c ON c.c_custkey = (doc_id * 7) % (SELECT count(*) FROM customer)
  JOIN nation n ON n.n_nationkey = doc_id % 25
  JOIN pages p ON p.page_id = doc_id % (SELECT count(*) FROM pages)
)"""

_KIND = job_type("title || ' ' || type_text")
TAGGED = f"""{VIEW},
folded AS (SELECT *, {fold('title')} AS ft, {fold('description')} AS fd, {_KIND} AS job_type,
           {by_source(lambda s: parsed(s, 'date_text'))} AS posted_at FROM raw),
tags AS (SELECT *, {skills('ft')} AS kt, {skills('fd')} AS kd FROM folded),
tagged AS (
  SELECT posting_no, arrival, feed,
    lower(source) || '_' || md5(url || '-' || title) AS posting_id,
    {clean('title')} AS title, company, {location('location', 'job_type')} AS location, description, url,
    CASE WHEN regexp_matches(salary, '[0-9]') THEN {clean('salary')} END AS salary,
    {ordered_distinct('list_concat(kt, kd)')} AS skills, job_type, source, posted_at
  FROM tags
)"""

ENHANCED = f"""{TAGGED},
leveled AS (SELECT *, {roles('lower(title)')} AS roles, {seniority('lower(title)')} AS level FROM tagged),
parts AS (SELECT *, {normalized('skills')} AS ext, {normalized(implied_raw('roles', 'level'))} AS imp_all FROM leveled),
imps AS (SELECT *, {implied_raw('roles', 'level')} AS imp_raw FROM parts),
enhanced AS (SELECT *, list_concat(ext, imp_all) AS every FROM imps)"""

# W1 with window functions. `run` is the posting set of a run, `stored` the urls of the store.
DEDUP = """
sig AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY arrival) AS sig_rn FROM run),
lead AS (SELECT arrival, url, url IN (SELECT url FROM stored) AS in_store,
         row_number() OVER (PARTITION BY url ORDER BY arrival) AS url_rn FROM sig WHERE sig_rn = 1),
judged AS (
  SELECT s.*, CASE WHEN s.sig_rn > 1 THEN 'signature' WHEN l.in_store OR l.url_rn > 1 THEN 'url' END AS reason
  FROM sig s LEFT JOIN lead l USING (arrival)
),
status AS (SELECT *, CASE WHEN reason IS NULL THEN 'saved' ELSE 'duplicate' END AS status FROM judged)"""

RUN = f"""{VIEW},
run AS (SELECT *, {signature('title', 'company')} AS signature FROM raw WHERE feed >= 'src15'),
stored AS (SELECT DISTINCT url FROM raw WHERE feed < 'src15'),{DEDUP}"""

# The store after two batches: first the feeds before src15, then the others.
STORE = f"""{TAGGED},
b1 AS (SELECT * FROM tagged WHERE feed < 'src15'),
b2 AS (SELECT * FROM tagged WHERE feed >= 'src15'),
first_row AS (SELECT url, arg_min(source, (CASE WHEN feed < 'src15' THEN 0 ELSE 1 END, arrival)) AS source,
              min(CASE WHEN feed < 'src15' THEN 1 ELSE 2 END) AS created FROM tagged GROUP BY url),
last_row AS (SELECT * FROM (SELECT *, CASE WHEN feed < 'src15' THEN 1 ELSE 2 END AS batch,
              row_number() OVER (PARTITION BY url ORDER BY CASE WHEN feed < 'src15' THEN 1 ELSE 2 END DESC, arrival DESC) AS rn
              FROM tagged) WHERE rn = 1),
s_postings AS (SELECT md5(l.url) AS posting_id, l.url, f.source, title, company AS company_name, location, description, salary,
              {to_store('job_type')} AS job_type, posted_at, f.created, l.batch AS updated
              FROM last_row l JOIN first_row f USING (url)),
s_links AS (SELECT md5(url) AS posting_id, trim(name) AS name, min(batch) AS created, max(batch) AS touched
            FROM (SELECT url, CASE WHEN feed < 'src15' THEN 1 ELSE 2 END AS batch, unnest(skills) AS name FROM tagged)
            WHERE trim(name) <> '' GROUP BY ALL),
s_skills AS (SELECT md5(name) AS skill_id, name, min(created) AS created, max(touched) AS updated FROM s_links GROUP BY name)"""

NEWEST = "ORDER BY posted_at DESC NULLS FIRST, posting_id"

# What an extraction must find on the pages of `plans.board_pages`.
_POSITION = "title || ' position at ' || company"
_GLASSDOOR_PAGE = trim(
    "title || CASE WHEN odd THEN '' ELSE c_name END || place || description || pay || CASE WHEN odd THEN 'Posted ' ELSE '' END || date_shown"
)
_WUZZUF_PAGE = trim(
    "'Menu' || title || c_name || place || ' · 51-200 Employees' || description || 'posted ' || date_shown || pay || 'Team workExcelx' || feed"
)
_BAYT_TEXT = collapse("CASE WHEN odd THEN description || ' Easy Apply now' ELSE description END")
_BAYT_CUT = f"trim(regexp_replace({_BAYT_TEXT}, '(?is)(?:Get contacted by recruiters|Easy Apply).*$', ''))"
BOARD = f"""{VIEW},
shown AS (SELECT *, (posting_no // 5) % 2 = 1 AS odd, {trim('description')} AS body, coalesce(salary, '') AS pay,
  company AS c_name, location AS place, date_text AS date_shown FROM raw),
named AS (SELECT * EXCLUDE (company, location, salary, date_text),
  CASE WHEN odd AND source = 'Glassdoor' THEN 'Unknown Company' WHEN odd AND source = 'Wuzzuf' THEN 'Wuzzuf Company' ELSE c_name END AS company,
  CASE WHEN source = 'LinkedIn' THEN c_name || ' ' || place WHEN odd AND source = 'Bayt' THEN 'Maadi, Cairo' ELSE place END AS location,
  CASE WHEN source <> 'LinkedIn' AND regexp_matches(pay, '[0-9]') THEN pay END AS salary,
  CASE source WHEN 'LinkedIn' THEN date_shown WHEN 'Bayt' THEN '' WHEN 'Wuzzuf' THEN 'posted ' || date_shown
    WHEN 'Glassdoor' THEN CASE WHEN odd THEN 'Posted ' ELSE '' END || date_shown
    ELSE CASE WHEN regexp_matches(date_shown, '^[0-9]+[+]? (day|hour|week)s? ago$') OR lower(date_shown) IN ('today', 'just posted')
      THEN 'Posted ' || date_shown ELSE '' END END AS date_text,
  CASE WHEN source = 'Wuzzuf' THEN [feed, 'Team work', 'Excel'] ELSE []::VARCHAR[] END AS page_tags
  FROM shown),
texts AS (SELECT * EXCLUDE (description), CASE source
  WHEN 'LinkedIn' THEN body
  WHEN 'Wuzzuf' THEN CASE WHEN odd OR length(body) >= 100 THEN body ELSE {_WUZZUF_PAGE} END
  WHEN 'Indeed' THEN trim({collapse('body')})
  WHEN 'Glassdoor' THEN CASE WHEN length(body) >= 200 THEN trim({collapse('body')}) ELSE trim({collapse(_GLASSDOOR_PAGE)}) END
  ELSE {_BAYT_CUT} END AS found FROM named),
fields AS (SELECT * EXCLUDE (found), posting_no AS page_id, CASE WHEN length(found) >= 50 OR source IN ('LinkedIn', 'Wuzzuf') THEN found
  WHEN source = 'Bayt' THEN {_POSITION} || ' in ' || location || '. Join our team!'
  ELSE {_POSITION} || '. Tech job opportunity.' END AS description FROM texts),
dated AS (SELECT *, CASE WHEN source = 'Bayt' THEN {AS_OF} ELSE {by_source(lambda s: with_policy(s, parsed(s, 'date_text')))} END AS posted FROM fields),
young AS (SELECT * FROM dated WHERE posted IS NOT NULL AND {fresh('posted')})"""


def names_cleaned(name: str) -> str:
    return f"CASE WHEN source = 'Bayt' THEN {name} ELSE {clean(name)} END"


def made(rows: str) -> str:
    """The postings of extracted rows, as CTEs that end in `made`; `rows` has the columns of `young`."""
    low = "lower(title)"
    return f"""
mf AS (SELECT *, {fold('title')} AS ft, {fold('description')} AS fd, {fold('company')} AS fc, {fold('salary')} AS fs,
  {roles(low)} AS roles, {seniority(low)} AS level, CASE WHEN source = 'Bayt' THEN 'full-time' ELSE {job_type("title || ' ' || description")} END AS kind FROM {rows}),
mk AS (SELECT *, {skills('ft')} AS kt, {skills('fd')} AS kd, {skills('fc')} AS kc, {skills('fs')} AS ks FROM mf),
me AS (SELECT *, list_concat({normalized(ordered_distinct('list_concat(list_concat(kt, kd), kc)'))}, {normalized(implied_raw('roles', 'level'))}) AS every FROM mk),
ma AS (SELECT *, {ordered_distinct('every')} AS whole FROM me),
made AS (SELECT *, lower(source) || '_' || md5(url || '-' || title) AS made_id, {names_cleaned('title')} AS made_title,
  {names_cleaned('company')} AS made_company, CASE WHEN source = 'Bayt' THEN location ELSE {location('location', 'kind')} END AS made_location,
  {names_cleaned('description')} AS made_description, {names_cleaned('salary')} AS made_salary, kind AS made_kind, CASE source
    WHEN 'LinkedIn' THEN whole
    WHEN 'Indeed' THEN {merged_ci('list_concat(list_concat(list_concat(whole, kt), kd), ks)')}
    WHEN 'Wuzzuf' THEN {ordered_distinct('list_concat(list_concat(page_tags, kt), kd)')}
    WHEN 'Bayt' THEN {ordered_distinct('list_concat(list_concat(kt, kd), kc)')}
    ELSE {ordered_distinct('list_concat(kt, kd)')} END AS made_skills FROM ma)"""


_STORED_SKILLS = "list_sort(list_distinct(list_filter(list_transform(made_skills, lambda x: trim(x)), lambda x: x <> '')))"
MADE_STATE = f"""SELECT md5(url) AS posting_id, made_title AS title, made_company AS company, coalesce(made_location, '') AS location,
  md5(coalesce(made_description, '')) AS description, url, made_salary AS salary, {joined(_STORED_SKILLS)} AS skills,
  {from_store(to_store('made_kind'))} AS job_type, source, {ts('posted')} AS posted_at FROM made"""


def page_runs(batches: list[str]) -> str:
    """CTEs of page runs one after the other: pages of new urls, then W1; `saved0`, `saved1` and so on."""
    steps, known = [], "SELECT NULL::VARCHAR AS url WHERE false"
    identity = signature(names_cleaned("title"), names_cleaned("company"))
    for k, condition in enumerate(batches):
        steps.append(f"""came{k} AS (SELECT url, min(page_id) AS page_id, count(*) AS n FROM dated WHERE {condition} GROUP BY url),
new{k} AS (SELECT page_id FROM came{k} WHERE url NOT IN ({known})),
rows{k} AS (SELECT * FROM young WHERE page_id IN (SELECT page_id FROM new{k})),
head{k} AS (SELECT * FROM rows{k} QUALIFY row_number() OVER (PARTITION BY {identity} ORDER BY page_id) = 1),
saved{k} AS (SELECT * FROM head{k} QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1)""")
        known += f" UNION ALL SELECT url FROM saved{k}"
    return ",\n".join(steps)


STREAMED = ["feed < 'src05'", *[f"feed >= 'src05' AND page_id % 3 = {k}" for k in range(3)]]

OBS = """
obs AS (SELECT user_id AS "user", event_type AS task, CASE WHEN value < 100 THEN 'C' WHEN value < 200 THEN 'P' ELSE 'F' END AS status,
        CAST(floor(value / 50) + 1 AS BIGINT) AS clicks, event_id % 4 AS wrong, least(CAST(floor(value / 20) + 1 AS BIGINT), 5) AS score
        FROM events)"""
RATE = "CAST(floor(100.0 * completed / total + 0.5) AS BIGINT)"


def _band(names=("top", "middle", "low")) -> str:
    return f"CASE WHEN rate >= 80 THEN '{names[0]}' WHEN rate >= 60 THEN '{names[1]}' ELSE '{names[2]}' END"


TITLE_SQL = r"regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')"


def decoded(expr: str) -> str:
    """Character references as the test pages use them."""
    for reference, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        expr = f"replace({expr}, {q(reference)}, {q(char)})"
    return expr


def _dates(source: str) -> str:
    p = parsed(source, "date_text")
    posted = with_policy(source, p)
    return f"""WITH {VIEW}, x AS (SELECT posting_no, date_text, {p} AS parsed, {posted} AS posted FROM raw)
SELECT posting_no, date_text, {ts('parsed')} AS parsed, {ts('posted')} AS posted,
  round(epoch({AS_OF} - posted) / 86400.0, 6) AS age_days FROM x"""


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    doc_tags = f"WITH f AS (SELECT *, {fold('text')} AS c FROM documents), t AS (SELECT *, {skills('c')} AS skills FROM f) "
    out["skill_tags"] = doc_tags + f"SELECT doc_id, {joined('skills')} AS skills FROM t"
    out["skill_tag_counts"] = doc_tags + "SELECT skill, count(*) AS n FROM (SELECT unnest(skills) AS skill FROM t) GROUP BY skill"
    out["skill_tags_by_source"] = (
        doc_tags + "SELECT source, skill, count(*) AS n FROM (SELECT source, unnest(skills) AS skill FROM t) GROUP BY ALL"
    )
    out["clean_text"] = f"SELECT doc_id, {clean('text')} AS cleaned FROM documents"
    out["norm_text"] = f"SELECT doc_id, {norm('text')} AS normalized FROM documents"
    out["signature"] = f"WITH {VIEW} SELECT posting_no, {signature('title', 'company')} AS signature FROM raw"
    out["posting_ids"] = (
        f"WITH {VIEW} SELECT posting_no, lower(source) || '_' || md5(url || '-' || title) AS posting_id FROM raw"
    )
    links = ", ".join(
        f"{canonical(e, q(s))} AS {n}"
        for n, s, e in (
            ("linkedin", "LinkedIn", "url"),
            ("wuzzuf", "Wuzzuf", "('/jobs/p/' || page_id || ' role?o=1')"),
            ("indeed", "Indeed", "('/rc/clk?jk=' || md5(url) || '&from=x')"),
            ("indeed_plain", "Indeed", "url"),
            ("glassdoor", "Glassdoor", "('/job-listing/' || page_id || '?jl=' || page_id)"),
            ("bayt", "Bayt", "url"),
        )
    )
    out["canonical_urls"] = f"SELECT page_id, {links} FROM pages"
    out["url_dedup"] = f"""WITH {VIEW}, u AS (SELECT posting_no, source, {canonical('url', q('LinkedIn'))} AS url, arrival FROM raw)
SELECT posting_no, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY arrival) AS rn FROM u) WHERE rn = 1"""
    full = "title || ' ' || type_text || ' ' || description"
    out["job_types"] = f"WITH {VIEW} SELECT posting_no, {job_type(full)} AS job_type, {_KIND} AS short_type FROM raw"
    out["job_type_roundtrip"] = f"""WITH {VIEW}, k AS (SELECT posting_no, {_KIND} AS job_type FROM raw),
s AS (SELECT *, {to_store('job_type')} AS stored FROM k)
SELECT posting_no, job_type, stored, {from_store('stored')} AS back FROM s"""
    out["remote_location"] = f"""WITH {VIEW}, k AS (SELECT *, {_KIND} AS job_type FROM raw)
SELECT posting_no, job_type, {location('location', 'job_type')} AS location FROM k"""
    name = "c_name || ' / ' || c_mktsegment"
    part = lambda i: f"nullif(trim(string_split({name}, '/')[{i}]), '')"
    out["company_and_place_cleanup"] = f"""SELECT c_custkey, coalesce({part(2)}, {part(1)}) AS bilingual,
  regexp_replace(regexp_replace('Work at Review for ' || c_name, '^Work at ', ''), '^Review for ', '') AS stripped,
  'City ' || c_nationkey AS place,
  CASE WHEN regexp_matches(CAST(c_acctbal AS VARCHAR) || ' EGP', '[0-9]') THEN CAST(c_acctbal AS VARCHAR) || ' EGP' END AS salary
FROM customer"""
    out["description_cut"] = (
        f"SELECT doc_id, trim({collapse('text')}) AS cut, trim({collapse('text')}) AS cut_last FROM documents"
    )
    for source in POLICIES:
        out[f"relative_dates_{source.lower()}"] = _dates(source)
    out["fresh_only"] = f"""WITH {VIEW}, x AS (SELECT posting_no, source, {by_source(lambda s: with_policy(s, parsed(s, 'date_text')))} AS posted FROM raw)
SELECT posting_no, source, {ts('posted')} AS posted FROM x WHERE {fresh('posted')}"""
    low = "lower(title)"
    out["seniority"] = f"WITH {VIEW} SELECT posting_no, {seniority(low)} AS seniority FROM raw"
    out["roles"] = f"WITH {VIEW} SELECT posting_no, {joined(roles(low))} AS roles FROM raw"
    values = ", ".join(f"({q(r)}, {q(lv)}, {k}, {p}, {q(s)})" for r, lv, k, p, s in V.role_skill_rows())
    out["implied_skills"] = f"""WITH {VIEW}, dict(role, level, level_rank, pos, skill) AS (VALUES {values}),
t AS (SELECT posting_no, {seniority(low)} AS level, unnest({roles(low)}) AS role FROM raw)
SELECT posting_no, t.role, t.level, d.skill, min(d.level_rank) AS level_rank, arg_min(d.pos, d.level_rank * 1000000 + d.pos) AS pos FROM t JOIN dict d ON d.role = t.role
 AND d.level_rank <= CASE t.level WHEN 'junior' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END GROUP BY ALL"""
    out["enhanced_skills"] = f"""WITH {ENHANCED} SELECT posting_no, {joined('roles')} AS roles, level AS seniority,
  {joined('ext')} AS extracted, {joined(ordered_distinct('every'))} AS final FROM enhanced"""
    out["enhancement_report"] = f"""WITH {ENHANCED} SELECT posting_no, len(skills) AS n_extracted, len(ext) AS n_normalized,
  len(imp_raw) AS n_implied, len({ordered_distinct('every')}) AS n_final,
  array_to_string(({ordered_distinct('every')})[1:20], ', ') AS preview, array_to_string(roles, ', ') AS roles, level AS seniority FROM enhanced"""
    out["source_policy"] = f"""WITH {VIEW},
f AS (SELECT *, {fold('title')} AS ft, {fold('description')} AS fd, {fold('company')} AS fc, {fold('salary')} AS fs,
      {roles(low)} AS roles, {seniority(low)} AS level FROM raw),
k AS (SELECT *, {skills('ft')} AS kt, {skills('fd')} AS kd, {skills('fc')} AS kc, {skills('fs')} AS ks FROM f),
e AS (SELECT *, list_concat({normalized(ordered_distinct('list_concat(list_concat(kt, kd), kc)'))}, {normalized(implied_raw('roles', 'level'))}) AS every FROM k),
a AS (SELECT *, {ordered_distinct('every')} AS whole FROM e)
SELECT posting_no, source, {joined(f'''CASE source WHEN 'LinkedIn' THEN whole
  WHEN 'Indeed' THEN {merged_ci('list_concat(list_concat(list_concat(whole, kt), kd), ks)')}
  WHEN 'Bayt' THEN {ordered_distinct('list_concat(list_concat(kt, kd), kc)')}
  ELSE {ordered_distinct('list_concat(kt, kd)')} END''')} AS skills FROM a"""
    pairs = ", ".join(f"({q(a)}, {q(c)})" for a, c in V.alias_dictionary().items())
    known = array(r.name for r in V.ROLES)
    spelt = "p_brand || '-' || p_size % 7"
    out["enhanced_by_tables"] = f"""WITH {TAGGED}, t AS (SELECT posting_no, skills, {roles(low)} AS roles, {seniority(low)} AS level FROM tagged),
dict AS (SELECT coalesce(({known})[p_partkey % 400 + 1], 'role ' || p_partkey % 400) AS role, p_size % 3 AS r, p_partkey AS pos, {spelt} AS skill FROM part),
al(alias, canonical) AS (SELECT lower({spelt}), min(p_type) FROM part WHERE p_size % 2 = 0 GROUP BY 1 UNION ALL SELECT * FROM (VALUES {pairs})),
lists AS (SELECT role, l.r AS upto, skill, min(row(d.r, pos)) AS place FROM dict d JOIN (VALUES (0), (1), (2)) l(r) ON d.r <= l.r GROUP BY ALL),
ext AS (SELECT posting_no, generate_subscripts(skills, 1) AS i, unnest(skills) AS s FROM t),
ex AS (SELECT posting_no, list(coalesce(canonical, trim(s)) ORDER BY i) AS names FROM ext LEFT JOIN al ON alias = lower(trim(s)) GROUP BY posting_no),
rl AS (SELECT posting_no, level, generate_subscripts(roles, 1) AS i, unnest(roles) AS role FROM t),
im AS (SELECT posting_no, list(coalesce(canonical, trim(skill)) ORDER BY i, place) AS names FROM rl JOIN lists ON lists.role = rl.role
  AND upto = CASE level WHEN 'junior' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END LEFT JOIN al ON alias = lower(trim(skill)) GROUP BY posting_no),
j AS (SELECT t.*, coalesce(ex.names, []) AS e, coalesce(im.names, []) AS m FROM t LEFT JOIN ex USING (posting_no) LEFT JOIN im USING (posting_no)),
w AS (SELECT *, list_concat(e, m) AS every FROM j)
SELECT posting_no, {joined('roles')} AS roles, level AS seniority, {joined('e')} AS extracted, {joined('m')} AS implied,
  {joined(ordered_distinct('every'))} AS final FROM w"""
    token = r"\.?[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)*[+#]*"
    phrases = ", ".join(
        f"({q(s.name)}, {i}, {q(p)})" for i, s in enumerate(V.SKILLS) for p in (*s.words, *s.tags, *[w for w, _ in s.unless])
    )
    split = lambda e: f"regexp_extract_all(lower({e}), {q(token)})"
    out["skills_by_phrases"] = f"""WITH {VIEW}, dict(skill, rank, phrase) AS (SELECT * FROM (VALUES {phrases})
  UNION ALL SELECT 'Place ' || n_name, n_nationkey + 1000, lower(n_name) FROM nation),
d AS (SELECT skill, rank, array_to_string({split('phrase')}, ' ') AS gram, len({split('phrase')}) AS n FROM dict),
t AS (SELECT posting_no, {split("title || chr(10) || location || chr(10) || description")} AS w FROM raw),
p AS (SELECT posting_no, unnest(range(len(w))) AS place, w FROM t),
g AS (SELECT posting_no, place, k AS n, array_to_string(w[place + 1 : place + k], ' ') AS gram FROM p, (VALUES (1), (2), (3), (4)) x(k) WHERE place + k <= len(w)),
m AS (SELECT posting_no, place, g.n, skill, rank FROM g JOIN d ON d.gram = g.gram AND d.n = g.n),
free AS (SELECT DISTINCT posting_no, skill, rank FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.posting_no = m.posting_no
  AND o.place <= m.place AND o.place + o.n >= m.place + m.n AND o.n > m.n)),
best AS (SELECT posting_no, skill, min(rank) AS rank FROM free GROUP BY ALL)
SELECT t.posting_no, coalesce(string_agg(skill, '|' ORDER BY rank), '') AS skills FROM t LEFT JOIN best USING (posting_no) GROUP BY t.posting_no"""
    wanted = ("React", "SQL", "AWS", "Docker", "Node.js", "Java", "C++", "Kubernetes", "REST API", "GraphQL", "Machine Learning", "TypeScript", "Big Data")
    heavy = ", ".join(f"({q(name)}, {1 + i % 4})" for i, name in enumerate(wanted))
    out["match_topk"] = f"""WITH {TAGGED}, w(skill, w) AS (VALUES {heavy}),
s AS (SELECT c_custkey AS seeker, list_distinct(list_transform(range(c_custkey % 6 + 3), lambda i: ({array(wanted)})[(c_custkey * 5 + i * (c_custkey % 3 + 1)) % {len(wanted)} + 1])) AS has FROM customer),
q AS (SELECT posting_no, unnest(list_distinct(skills)) AS skill FROM tagged),
v AS (SELECT q.*, coalesce(w, 1) AS w FROM q LEFT JOIN w USING (skill)),
total AS (SELECT posting_no, sum(w) AS total FROM v GROUP BY posting_no),
e AS (SELECT seeker, unnest(has) AS skill FROM s),
pair AS (SELECT seeker, posting_no, sum(w) AS shared FROM e JOIN v USING (skill) GROUP BY ALL),
r AS (SELECT seeker, posting_no, CAST(floor(10000 * shared / total) AS BIGINT) AS points FROM pair JOIN total USING (posting_no) WHERE 100 * shared >= 60 * total),
k AS (SELECT *, row_number() OVER (PARTITION BY seeker ORDER BY points DESC, posting_no) AS rank FROM r)
SELECT seeker, rank, posting_no, CAST(CAST(points / 100 AS DECIMAL(5, 2)) AS VARCHAR) AS score FROM k WHERE rank <= 5"""
    aliases = ", ".join(f"({q(a)}, {q(c)})" for a, c in V.alias_dictionary().items())
    out["alias_lookup"] = f"""WITH {VIEW}, dict(alias, canonical) AS (VALUES {aliases}),
w AS (SELECT posting_no, unnest(string_split({norm('title')}, ' ')) AS word FROM raw)
SELECT posting_no, word, coalesce(d.canonical, word) AS canonical, count(*) AS n FROM w LEFT JOIN dict d ON d.alias = lower(word) GROUP BY ALL"""
    out["dedup_run"] = f"WITH {RUN} SELECT posting_no, signature, url, status, coalesce(reason, '') AS reason FROM status"
    out["run_counters"] = f"""WITH {RUN}, b AS (SELECT unnest({array((*P.SOURCES, 'Silent'))}) AS source) SELECT b.source, count(status) AS fetched,
  count(*) FILTER (status = 'saved') AS saved, count(*) FILTER (status = 'duplicate') AS duplicates,
  CASE WHEN b.source IN ('Wuzzuf', 'Indeed', 'Glassdoor') THEN count(status) > 0 ELSE b.source <> 'Bayt' END AS success
FROM b LEFT JOIN (SELECT * FROM status WHERE source <> 'Glassdoor') status ON status.source = b.source GROUP BY b.source"""
    out["run_totals"] = f"""WITH {RUN} SELECT count(*) AS fetched, count(*) FILTER (status = 'saved') AS saved,
  count(*) FILTER (status = 'duplicate') AS duplicates FROM status"""
    out["new_and_known_urls"] = f"""WITH {VIEW}, stored AS (SELECT DISTINCT url FROM raw WHERE feed < 'src15')
SELECT posting_no, CASE WHEN url IN (SELECT url FROM stored) THEN 'known' ELSE 'new' END AS state FROM raw WHERE feed >= 'src15'"""
    out["upsert_star_postings"] = f"""WITH {STORE} SELECT posting_id, url, source, title, company_name, location, salary, job_type,
  md5(description) AS description, {ts('posted_at')} AS posted_at, created, updated FROM s_postings"""
    out["upsert_star_skills"] = f"WITH {STORE} SELECT skill_id, name, created, updated FROM s_skills"
    out["upsert_star_links"] = f"WITH {STORE} SELECT posting_id, md5(name) AS skill_id, created FROM s_links"
    out["star_readback"] = f"""WITH {STORE}, n AS (SELECT posting_id, array_to_string(list_sort(list(name)), '|') AS skills FROM s_links GROUP BY posting_id)
SELECT posting_id, title, company_name AS company, location, url, salary, coalesce(skills, '') AS skills, {from_store('job_type')} AS job_type,
  source, {ts(f'coalesce(posted_at, {AS_OF})')} AS posted_at FROM s_postings LEFT JOIN n USING (posting_id)"""
    out["search_star"] = f"""WITH {STORE}, hits AS (SELECT * FROM s_links WHERE name ILIKE '%react%' OR name ILIKE '%sql%'),
n AS (SELECT posting_id, array_to_string(list_sort(list(name)), '|') AS skills FROM hits GROUP BY posting_id)
SELECT posting_id, title, skills, {ts(f'coalesce(posted_at, {AS_OF})')} AS posted_at FROM s_postings s JOIN n USING (posting_id)
ORDER BY s.posted_at DESC NULLS FIRST, posting_id LIMIT 100"""
    # Later rows delete earlier ones with their id or their url; the store's rows come first.
    out["replace_flat"] = f"""WITH {TAGGED},
old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY arrival DESC) AS rn FROM tagged WHERE feed < 'src15') WHERE rn = 1),
new AS (SELECT * FROM tagged WHERE feed >= 'src15'),
kept AS (
  SELECT posting_id, url, title, skills FROM new a WHERE NOT EXISTS (SELECT 1 FROM new b WHERE b.arrival > a.arrival AND b.posting_id = a.posting_id)
    AND NOT EXISTS (SELECT 1 FROM new b WHERE b.arrival > a.arrival AND b.url = a.url)
  UNION ALL
  SELECT posting_id, url, title, skills FROM old a WHERE NOT EXISTS (SELECT 1 FROM new b WHERE b.posting_id = a.posting_id)
    AND NOT EXISTS (SELECT 1 FROM new b WHERE b.url = a.url))
SELECT posting_id, url, title, {joined('skills')} AS skills FROM kept"""
    out["flat_roundtrip"] = f"WITH {TAGGED} SELECT posting_id, {joined('skills')} AS skills, {ts('posted_at')} AS posted_at FROM tagged"
    urls = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in BASE_URLS.items())
    registry = "source AS name, CASE source " + urls + " END AS url, true AS is_active"
    out["source_registry"] = f"""WITH {VIEW}, a AS (SELECT {registry}, count(*) AS total FROM raw WHERE feed < 'src15' GROUP BY source),
b AS (SELECT {registry}, count(*) AS total FROM raw WHERE feed >= 'src15' GROUP BY source)
SELECT * FROM b UNION ALL SELECT * FROM a WHERE name NOT IN (SELECT name FROM b)"""
    cols = f"posting_id, posting_no, title, {ts('posted_at')} AS posted_at"
    out["by_skills_substring"] = f"""WITH {TAGGED}, h AS (SELECT *, list_filter(skills, lambda s: s ILIKE '%react%' OR s ILIKE '%sql%') AS hits FROM tagged)
SELECT {cols}, {joined('hits')} AS skills FROM h WHERE len(hits) > 0 {NEWEST}, posting_no LIMIT 100"""
    out["by_skills_keep_all"] = f"""WITH {TAGGED}, h AS (SELECT *, list_filter(skills, lambda s: s ILIKE '%java%') AS hits FROM tagged)
SELECT {cols}, {joined('skills')} AS skills FROM h WHERE len(hits) > 0 {NEWEST}, posting_no LIMIT 100"""
    out["by_skills_element"] = f"""WITH {TAGGED} SELECT {cols}, {joined('skills')} AS skills FROM tagged
WHERE len(list_filter(skills, lambda s: lower(s) IN ('java', 'aws'))) > 0 ORDER BY posted_at DESC NULLS LAST, posting_id, posting_no LIMIT 100"""
    out["search_default"] = f"WITH {TAGGED} SELECT {cols} FROM tagged {NEWEST}, posting_no LIMIT 100"
    out["search_filters"] = f"""WITH {TAGGED}, s AS (SELECT *, TRY_CAST(regexp_extract(salary, '([0-9]+)', 1) AS DOUBLE) * 1000 AS amount FROM tagged)
SELECT {cols} FROM s WHERE contains(lower(location), 'nation') AND contains(lower(company), 'customer') AND job_type = 'full-time'
  AND amount >= 60000 AND amount <= 120000 AND posted_at >= {AS_OF} - to_days(30) {NEWEST}, posting_no LIMIT 100"""
    out["recent_postings"] = f"WITH {TAGGED} SELECT {cols} FROM tagged ORDER BY posted_at DESC NULLS LAST, posting_id, posting_no LIMIT 1000"
    out["recent_nulls_first"] = """SELECT o_orderkey, strftime(posted_at, '%Y-%m-%d') AS posted_at FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS posted_at FROM orders)
ORDER BY posted_at DESC NULLS FIRST, o_orderkey LIMIT 1000"""
    out["random_sample"] = "SELECT doc_id, source FROM documents ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50"
    out["stats"] = "SELECT source, count(*) AS n FROM documents GROUP BY source"
    out["stats_total"] = "SELECT count(*) AS total FROM documents"
    out["stats_map"] = """SELECT CAST(sum(n) AS BIGINT) AS total, string_agg(source || '=' || n, '|' ORDER BY source) AS by_source
FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)"""
    out["vocabulary"] = f"""WITH {TAGGED}, r AS (SELECT skills FROM tagged {NEWEST}, posting_no LIMIT 1000)
SELECT DISTINCT unnest(skills) AS skill FROM r"""
    out["distinct_skills"] = f"WITH {TAGGED} SELECT DISTINCT unnest(skills) AS skill FROM tagged"
    out["envelope"] = """SELECT '{"success":true,"count":' || count(*) || ',"sources":[' ||
  string_agg('{"source":"' || source || '","n":' || n || '}', ',' ORDER BY source) || ']}' AS body
FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)"""
    since = "TIMESTAMP '2024-01-10 00:00:00'"
    out["window_handoff"] = f"""SELECT event_id, event_type FROM events WHERE ts >= {since} - to_minutes(4320) AND ts < {since}"""
    out["hourly_counts"] = (
        "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"
    )
    out["source_append"] = f"""WITH {VIEW} SELECT source, count(*) AS n, count(DISTINCT url) AS urls FROM raw GROUP BY source"""
    out["url_union"] = f"WITH {VIEW} SELECT DISTINCT url FROM raw"
    out["skill_difference"] = f"""WITH {ENHANCED} SELECT posting_no,
  {joined(ordered_distinct('list_filter(imp_all, lambda x: NOT list_contains(ext, x))'))} AS added FROM enhanced"""
    enc = lambda c: f"replace(replace({c}, ' ', '%20'), '#', '%23')"
    plus = lambda c: f"replace(replace({c}, ' ', '+'), '#', '%23')"
    kebab = lambda c: f"regexp_replace(lower({c}), '\\s+', '-', 'g')"
    addresses = {
        "LinkedIn": f"'https://www.linkedin.com/jobs/search?keywords=' || {plus('term')} || '&location=' || {plus('location')} || "
        "'&f_TPR=' || CASE WHEN position % 2 = 0 THEN 'r86400' ELSE 'r259200' END || '&f_JT=F&sortBy=DD'",
        "Indeed": f"'https://www.indeed.com/jobs?q=' || {enc('term')} || '&l=' || {enc('location')} || '&fromage=7&sort=date'",
        "Glassdoor": "'https://www.glassdoor.com/Job/jobs.htm?suggestCount=0&suggestChosen=false&clickSource=searchBtn&typedKeyword=' || "
        f"{enc('term')} || '&sc.keyword=' || {enc('term')} || '&locT=C&locId=&jobType=&context=Jobs&dropdown=0'",
        "Wuzzuf": f"'https://wuzzuf.net/search/jobs/?q=' || {kebab('term')}",
        "Bayt": f"'https://www.bayt.com/en/' || {kebab('location')} || '/jobs/' || {kebab('term')} || '-jobs/'",
    }
    plans = [
        f"""SELECT position, term, location, {addresses[name]} AS url, '{name}' AS source FROM (
  SELECT (tr - 1) * 2 + lr - 1 AS position, term, location FROM
    (SELECT term, row_number() OVER (ORDER BY md5('{k}:' || term), term) AS tr FROM (SELECT DISTINCT p_name AS term FROM part)),
    (SELECT location, row_number() OVER (ORDER BY md5('{k}:' || location), location) AS lr FROM (SELECT DISTINCT n_name AS location FROM nation))
  WHERE tr <= 5 AND lr <= 2)"""
        for k, name in enumerate(P.SOURCES)
    ]
    out["frontier_by_board"] = " UNION ALL ".join(plans)
    board = _pick(P.SOURCES, "page_id")
    out["page_titles"] = f"SELECT page_id, trim({decoded(TITLE_SQL)}) AS title FROM pages"
    anchors = "unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>', {}))"
    out["page_links"] = f"""WITH a AS (SELECT page_id, {anchors.format(1)} AS href, {anchors.format(2)} AS label FROM pages)
SELECT page_id, {decoded('href')} AS href, trim({decoded("regexp_replace(label, '<[^>]*>', '', 'g')")}) AS text FROM a"""
    out["page_fields"] = f"""WITH p AS (SELECT page_id, url, {board} AS source, trim({decoded(TITLE_SQL)}) AS title FROM pages)
SELECT page_id, source, url, title,
  CASE source WHEN 'Wuzzuf' THEN 'Wuzzuf Company' WHEN 'Bayt' THEN 'Bayt.com' WHEN 'Indeed' THEN 'Indeed' ELSE 'Unknown Company' END AS company,
  CASE source WHEN 'Wuzzuf' THEN 'Egypt' WHEN 'Glassdoor' THEN 'Not Specified' ELSE 'Remote' END AS location
FROM p WHERE source <> 'LinkedIn' AND title <> '' AND NOT (source = 'Bayt' AND length(title) < 3)"""
    out["page_details"] = f"""WITH {BOARD} SELECT page_id, source, url, title, company, location, md5(description) AS description, date_text, salary,
  {joined('page_tags')} AS page_tags FROM fields"""
    # Of the elements that hold a description the longest text; the first on ties.
    shown = "CASE source WHEN 'Bayt' THEN CASE WHEN odd THEN description || ' Easy Apply now' ELSE description END ELSE description END"
    below = f"CASE WHEN source = 'LinkedIn' AND NOT odd THEN '' WHEN source = 'Indeed' THEN '' ELSE {trim(shown)} END"
    out["page_longest_text"] = f"""WITH {BOARD} SELECT posting_no AS page_id, md5({below}) AS text FROM shown"""
    whole = """made_title AS title, made_company AS company, made_location AS location, md5(made_description) AS description, url,
  made_salary AS salary, made_kind AS job_type, source"""
    out["pages_to_postings"] = f"""WITH {BOARD}, {made('young')} SELECT made_id AS posting_id, page_id AS arrival, {whole},
  {joined('made_skills')} AS skills, {ts('posted')} AS posted_at FROM made"""
    out["pages_to_store"] = f"""WITH {BOARD}, {page_runs(['true'])}, {made('saved0')} {MADE_STATE}"""
    every = " UNION ALL ".join(f"SELECT * FROM saved{k}" for k in range(len(STREAMED)))
    out["stream_pages_to_store"] = f"""WITH {BOARD}, {page_runs(STREAMED)}, saved AS ({every}), {made('saved')} {MADE_STATE}"""
    out["stream_page_runs"] = f"WITH {BOARD}, {page_runs(STREAMED)} " + " UNION ALL ".join(
        f"""SELECT '{k - 1}' AS run_id, (SELECT CAST(sum(n) AS BIGINT) FROM came{k}) AS pages, (SELECT count(*) FROM new{k}) AS extracted,
  (SELECT count(*) FROM rows{k}) AS fetched, (SELECT count(*) FROM saved{k}) AS saved,
  (SELECT count(*) FROM rows{k}) - (SELECT count(*) FROM saved{k}) AS duplicates, 0 AS rejected"""
        for k in range(1, len(STREAMED))
    )
    out["rejected_rows"] = f"""WITH {TAGGED} SELECT arrival, CASE WHEN posting_no % 10 = 5 THEN '' ELSE title END AS title, company,
  CASE WHEN posting_no % 10 <> 3 THEN url END AS url, CASE WHEN posting_no % 10 = 3 THEN 'no url' ELSE 'no title' END AS reason,
  {joined('skills')} AS skills FROM tagged WHERE posting_no % 10 IN (3, 5)"""
    out["observed_counters"] = f"""WITH {TAGGED}, most AS (SELECT * EXCLUDE (url), CASE WHEN posting_no % 11 <> 4 THEN url ELSE '' END AS url
  FROM tagged WHERE source <> 'Indeed'),
run AS (SELECT *, {signature('title', 'company')} AS signature FROM most WHERE feed >= 'src15'),
stored AS (SELECT DISTINCT url FROM most WHERE feed < 'src15' AND url <> ''),{DEDUP},
b AS (SELECT unnest({array(P.SOURCES)}) AS source)
SELECT b.source, count(status) AS fetched, count(*) FILTER (status = 'saved' AND url <> '') AS saved, count(*) FILTER (status = 'duplicate') AS duplicates,
  count(*) FILTER (status = 'saved' AND url = '') AS rejected,
  CASE WHEN b.source IN ('Wuzzuf', 'Indeed', 'Glassdoor') THEN count(status) > 0 ELSE b.source <> 'LinkedIn' END AS success
FROM b LEFT JOIN status ON status.source = b.source GROUP BY b.source"""
    start = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(p_partkey % 1000 * 3000)"
    out["windows_handoff"] = f"""WITH w AS (SELECT p_partkey AS run_id, {start} AS since,
  {start} + to_minutes(CAST(CASE WHEN p_partkey % 50 = 0 THEN 20000 ELSE (p_size - 5) * 7 END AS BIGINT)) AS until FROM part)
SELECT run_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, CAST(sum(event_id) AS BIGINT) AS id_sum,
  count(DISTINCT event_type) AS types FROM w JOIN events ON ts >= since AND ts < until GROUP BY run_id"""
    out["listing_links"] = f"""WITH {VIEW}, cards AS (SELECT *, posting_no // 40 AS page, CASE source
  WHEN 'LinkedIn' THEN '/jobs/view/' || posting_no WHEN 'Indeed' THEN 'https://www.indeed.com/viewjob?jk=k' || posting_no
  WHEN 'Glassdoor' THEN 'https://www.glassdoor.com/job-listing/j?jl=' || posting_no
  WHEN 'Wuzzuf' THEN 'https://wuzzuf.net/jobs/p/' || posting_no || '-' || replace(type_text, ' ', '-')
  ELSE 'https://www.bayt.com/en/jobs/' || posting_no || '/' END AS link,
  CASE WHEN source IN ('LinkedIn', 'Indeed') OR (source = 'Wuzzuf' AND NOT regexp_matches(date_text, 'ago|منذ')) THEN '' ELSE date_text END AS named FROM raw),
listed AS (SELECT *, CASE WHEN named <> '' THEN {by_source(lambda s: with_policy(s, parsed(s, 'named')))} END AS posted FROM cards)
SELECT source, link AS url, page * 5 + list_position({array(P.SOURCES)}, source) - 1 AS page_id, named AS date_text FROM listed
WHERE coalesce({fresh('posted')}, false) OR (posted IS NULL AND source <> 'Bayt')"""
    out["listing_postings"] = f"""WITH {VIEW}, cards AS (SELECT *, (posting_no // 5) % 2 = 1 AS odd, posting_no % 4 < 2 AS listed,
  {with_policy('Glassdoor', parsed('Glassdoor', 'date_text'))} AS posted, unnest([posting_no // 40, posting_no // 40 + 1]) AS page FROM raw WHERE source = 'Glassdoor'),
placed AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY posting_no) - 1 AS pos FROM cards),
told AS (SELECT *, CASE WHEN odd THEN '' ELSE type_text END || CASE WHEN listed THEN E'\\n\\nRequired Skills: React, SQL' ELSE '' END AS text FROM placed)
SELECT page * 5 + 2 AS page_id, pos, 'https://www.glassdoor.com/job-listing/j?jl=' || posting_no AS url, title, company, location,
  CASE WHEN text <> '' THEN text ELSE title || ' position at ' || company || '. Tech job opportunity.' END AS description,
  CASE WHEN regexp_matches(salary, '[0-9]') THEN salary END AS salary, CASE WHEN listed THEN 'React, SQL' ELSE '' END AS skills_line,
  {ts('posted')} AS posted_at FROM told WHERE {fresh('posted')}"""
    out["blocked_pages"] = f"""SELECT page_id, {board} AS source, CASE {board}
  WHEN 'Indeed' THEN regexp_matches(lower(html), 'captcha|verification required|additional verification')
  WHEN 'Glassdoor' THEN contains(html, 'Job is OOO') OR contains(html, 'Access Denied') ELSE false END AS blocked FROM pages"""
    out["listing_detail_fallback"] = f"""WITH {VIEW}, detail AS (SELECT page_id, url, {TITLE_SQL} AS title FROM pages
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1)
SELECT posting_no, raw.url, CASE WHEN d.page_id IS NOT NULL THEN md5(d.title) ELSE md5(raw.title) END AS title, d.page_id IS NOT NULL AS from_detail
FROM raw LEFT JOIN detail d ON d.url = raw.url"""
    out["completion_rate_by_user"] = f"""WITH {OBS}, c AS (SELECT "user", count(*) AS total, count(*) FILTER (status = 'C') AS completed FROM obs GROUP BY 1),
r AS (SELECT *, {RATE} AS rate FROM c) SELECT *, {_band()} AS band FROM r"""
    out["completion_rate_overall"] = f"""WITH {OBS}, c AS (SELECT count(DISTINCT "user") * count(DISTINCT task) AS total, count(*) FILTER (status = 'C') AS completed FROM obs)
SELECT *, {RATE} AS rate FROM c"""
    out["completion_rate_by_task"] = f"""WITH {OBS}, c AS (SELECT task, count(*) AS total, count(*) FILTER (status = 'C') AS completed FROM obs GROUP BY 1),
r AS (SELECT *, {RATE} AS rate FROM c) SELECT *, {_band(('Pass', 'Marginal', 'Fail'))} AS verdict FROM r"""
    out["click_quality"] = f"""WITH {OBS}, c AS (SELECT task, count(*) FILTER (wrong = 0) AS excellent, count(*) FILTER (wrong = 1) AS acceptable,
  count(*) FILTER (wrong >= 2) AS unacceptable FROM obs GROUP BY 1) SELECT *, excellent >= 6 AS good, unacceptable >= 4 AS bad FROM c"""
    out["task_efficiency"] = f"""WITH {OBS}, e AS (SELECT task, max(clicks) - 1 AS expected FROM obs WHERE status = 'C' GROUP BY 1),
a AS (SELECT task, floor(avg(clicks) * 10 + 0.5) / 10 AS actual FROM obs GROUP BY 1)
SELECT a.task, expected, actual, round(actual - expected, 1) AS difference,
  CASE WHEN actual - expected <= 1 THEN 'top' WHEN actual - expected <= 2 THEN 'middle' ELSE 'low' END AS band FROM a JOIN e USING (task)"""
    tasks = ("click", "view", "purchase", "error", "signup")
    cells = lambda e: ", ".join(f"CAST({e} FILTER (task = '{t}') AS DOUBLE) AS \"{t}\"" for t in tasks)
    means = ", ".join(f"floor(avg(clicks) FILTER (task = '{t}') * 10 + 0.5) / 10" for t in tasks)
    goals = ", ".join(f"CAST(max(clicks) FILTER (task = '{t}' AND status = 'C') - 1 AS DOUBLE)" for t in tasks)
    out["pivot_clicks"] = f"""WITH {OBS} SELECT 'user ' || "user" AS line, {cells('min(clicks)')} FROM obs GROUP BY "user"
UNION ALL SELECT 'mean', {means} FROM obs UNION ALL SELECT 'expected', {goals} FROM obs"""
    out["clicks_by_task_user"] = f"""WITH {OBS}, t AS (SELECT task, floor(avg(clicks) * 10 + 0.5) / 10 AS mean_clicks,
  max(clicks) FILTER (status = 'C') - 1 AS expected FROM obs GROUP BY 1)
SELECT task, "user", min(clicks) AS clicks, mean_clicks, expected FROM obs JOIN t USING (task) GROUP BY ALL"""
    marks = ", ".join(f"min(status) FILTER (task = '{t}') AS \"{t}\"" for t in tasks)
    out["pivot_status"] = f"""WITH {OBS} SELECT "user", {marks} FROM obs GROUP BY 1"""
    out["likert"] = f"""WITH {OBS}, c AS (SELECT task, count(*) AS all_n, avg(score) AS m FROM obs GROUP BY 1),
g AS (SELECT task, i.score FROM c, (VALUES (1), (2), (3), (4), (5)) i(score)),
n AS (SELECT task, score, count(*) AS n FROM obs GROUP BY ALL)
SELECT g.task, g.score, coalesce(n.n, 0) AS n, CAST(floor(100.0 * coalesce(n.n, 0) / all_n + 0.5) AS BIGINT) AS percent,
  round(m, 1) AS mean FROM g JOIN c USING (task) LEFT JOIN n ON n.task = g.task AND n.score = g.score"""
    out["stream_dedup"] = f"""WITH {TAGGED}, run AS (SELECT *, {signature('title', 'company')} AS signature FROM tagged WHERE feed >= 'src15'
  AND url NOT IN (SELECT url FROM tagged WHERE feed < 'src15'))
SELECT arrival, signature, url, title, company, location, source, job_type, salary, md5(description) AS description, {joined('skills')} AS skills,
  {ts('posted_at')} AS posted_at FROM run QUALIFY row_number() OVER (PARTITION BY signature ORDER BY arrival % 3, arrival) = 1"""
    out["stream_late_rows"] = f"""WITH {TAGGED} SELECT arrival, url, {ts('posted_at')} AS posted_at FROM tagged WHERE posted_at >= {AS_OF} - to_days(7)"""
    out["stream_upsert"] = f"""WITH {TAGGED}, run AS (SELECT *, {signature('title', 'company')} AS signature FROM tagged),
stored AS (SELECT url FROM tagged WHERE false),{DEDUP}
SELECT md5(url) AS posting_id, url, source, title, company, location, salary, {to_store('job_type')} AS job_type, md5(description) AS description,
  {ts('posted_at')} AS posted_at, len(list_distinct(list_filter(list_transform(skills, lambda x: trim(x)), lambda x: x <> ''))) AS n_skills
FROM status WHERE status = 'saved'"""
    steps, known = [], "SELECT url FROM tagged WHERE feed < 'src15'"
    for k in range(4):
        steps.append(f"""sig{k} AS (SELECT *, row_number() OVER (PARTITION BY {signature('title', 'company')} ORDER BY arrival) AS sig_rn
  FROM tagged WHERE feed >= 'src15' AND arrival % 4 = {k}),
lead{k} AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY arrival) AS url_rn FROM sig{k} WHERE sig_rn = 1),
run{k} AS (SELECT {k + 1} AS run, url, description, skills FROM lead{k} WHERE url_rn = 1 AND url NOT IN ({known}))""")
        known += f" UNION ALL SELECT url FROM run{k}"
    runs = " UNION ALL ".join(f"SELECT * FROM run{k}" for k in range(4))
    out["stream_after_batch"] = f"""WITH {TAGGED}, {", ".join(steps)},
old AS (SELECT 0 AS run, url, arg_max(description, arrival) AS description, flatten(list(skills)) AS skills FROM tagged WHERE feed < 'src15' GROUP BY url),
every AS (SELECT * FROM old UNION ALL {runs})
SELECT md5(url) AS posting_id, url, run, md5(description) AS description,
  len(list_distinct(list_filter(list_transform(skills, lambda x: trim(x)), lambda x: x <> ''))) AS n_skills FROM every"""
    out["stream_hourly_counts"] = out["hourly_counts"]
    return {name: re.sub(r"[ \n]*\n[ \n]*", "\n", text.strip()) for name, text in out.items()}
