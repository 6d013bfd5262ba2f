"""Queries of decisions by rule: routes, paint tiers, protection evidence, alerts, turns."""

from __future__ import annotations

from pyspark.sql import functions as _functions

from ..catalog import query, scalar
from ..functions import checksums as _checksums
from ..functions import duck as D
from ..functions import masks as _masks
from ..functions import urls as _urls
from ..functions.deferred import DeferredModule
from ..operators import spans as _spans
from . import fixtures as X

F = DeferredModule(_functions)
C = DeferredModule(_checksums)
M = DeferredModule(_masks)
S = DeferredModule(_spans)
U = DeferredModule(_urls)
T = F.col("text")


def lookup(table: dict[str, str], key):
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def lookup_sql(table: dict[str, str], key: str, otherwise: str = "NULL") -> str:
    return D.case([(f"{key} = '{k}'", f"'{v}'") for k, v in table.items()], otherwise)


# --- routes -------------------------------------------------------------------
# Hosts of bare names, and other names of sites.
HOSTS = {
    "youtube": "youtube.com", "google": "google.com", "github": "github.com", "twitter": "twitter.com", "reddit": "reddit.com", "facebook": "facebook.com",
    "instagram": "instagram.com", "linkedin": "linkedin.com", "amazon": "amazon.com", "netflix": "netflix.com", "spotify": "spotify.com", "wikipedia": "wikipedia.org",
    "stackoverflow": "stackoverflow.com", "gmail": "gmail.com", "outlook": "outlook.com", "yahoo": "yahoo.com", "bing": "bing.com", "discord": "discord.com",
    "slack": "slack.com", "notion": "notion.so", "figma": "figma.com", "linear": "linear.app", "vercel": "vercel.com", "netlify": "netlify.com",
}
ALIASES = {"yt": "youtube.com", "ytube": "youtube.com", "gmail": "mail.google.com gmail.com", "mail": "mail.google.com gmail.com", "gh": "github.com", "fb": "facebook.com", "ig": "instagram.com"}
SEARCH = "https://www.google.com/search?q="
_ROUTES = "SELECT o_orderkey AS id, CASE o_orderkey % 16 WHEN 0 THEN 'gmail' WHEN 1 THEN ' www.Gmail' WHEN 2 THEN 'notion' WHEN 3 THEN 'https://gmail' WHEN 4 THEN 'https://www.youtube.com/x' WHEN 5 THEN 'nowhere' || CAST(o_orderkey AS STRING) WHEN 6 THEN 'foo.bar.com/x?y=' || CAST(o_orderkey AS STRING) WHEN 7 THEN 'www.linear' WHEN 8 THEN 'two words (and) more!' WHEN 9 THEN 'https://10.0.0.1/' WHEN 10 THEN 'http://localhost:8080' WHEN 11 THEN 'HTTPS://Figma/file?a=1' WHEN 12 THEN 'http://unknown-host' WHEN 13 THEN 'mail' WHEN 14 THEN 'yt' ELSE 'Amazon' END AS text FROM {orders}"


def canonical_host(name):
    bare = F.lower(F.regexp_replace(F.trim(name), r"^(?i)www\.", ""))
    return F.when(bare.rlike("^[A-Za-z0-9_-]+$"), lookup(HOSTS, bare))


def _canonical_sql(x):
    bare = f"lower(regexp_replace(trim({x}), '^(?i)www\\.', ''))"
    return lookup_sql(HOSTS, bare)


scalar("fil41_canonical_host", _ROUTES, host=(canonical_host(T), _canonical_sql("text")))


def encoded(c):
    """Percent encoding that leaves - _ . ! ~ * ' ( )."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def normal_url(raw):
    host = F.lower(F.regexp_extract(raw, r"^(?i)https?://([^/:?#]*)", 1))
    rest = F.regexp_extract(raw, r"^(?i)https?://[^/:?#]*(.*)$", 1)
    known = canonical_host(host)
    fixed = F.concat(F.lower(F.regexp_extract(raw, r"^(?i)(https?://)", 1)), known, F.when(rest.rlike("^/"), rest).when(rest.rlike("^:[0-9]+$"), F.concat(rest, F.lit("/"))).otherwise(F.concat(F.lit("/"), rest)))
    search = F.concat(F.lit(SEARCH), encoded(raw))
    bare = canonical_host(raw)
    return (
        F.when(raw.rlike("^(?i)https?://"), F.when(host.contains(".") | (host == "localhost"), raw).when(known.isNotNull(), fixed).otherwise(search))
        .when(raw.rlike(r"^[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+"), F.concat(F.lit("https://"), F.coalesce(bare, raw))).otherwise(search)
    )


_HOST_SQL = "lower(regexp_extract(text, '^(?i)https?://([^/:?#]*)', 1))"
_REST_SQL = "regexp_extract(text, '^(?i)https?://[^/:?#]*(.*)$', 1)"
scalar("fil38_normal_url", _ROUTES, url=(normal_url(T), D.case([
    (f"regexp_matches(text, '^(?i)https?://') AND (contains({_HOST_SQL}, '.') OR {_HOST_SQL} = 'localhost')", "text"),
    (f"regexp_matches(text, '^(?i)https?://') AND {_canonical_sql(_HOST_SQL)} IS NOT NULL", f"lower(split_part(text, '://', 1)) || '://' || {_canonical_sql(_HOST_SQL)} || CASE WHEN starts_with({_REST_SQL}, '/') THEN '' ELSE '/' END || {_REST_SQL}"),
    ("regexp_matches(text, '^(?i)https?://')", f"'{SEARCH}' || {D.encoded('text')}"),
    (r"regexp_matches(text, '^[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+')", f"'https://' || coalesce({_canonical_sql('text')}, text)"),
], f"'{SEARCH}' || {D.encoded('text')}")))
_FAILED = "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'chrome-error://chromewebdata/?error=NAME%20NOT%20' || event_type || '#x' WHEN 1 THEN 'chrome-error://chromewebdata/' WHEN 2 THEN 'https://x.example/?error=no' ELSE NULL END AS text FROM {events}"
scalar("fil40_error_page_reason", _FAILED, reason=(
    F.when(T.startswith("chrome-error://"), F.when(T.rlike("(?i)[?&]error=[^&#]"), F.url_decode(F.replace(F.regexp_extract(T, "(?i)[?&]error=([^&#]+)", 1), F.lit("+"), F.lit("%2B")))).otherwise("browser error page")),
    "CASE WHEN starts_with(text, 'chrome-error://') THEN CASE WHEN regexp_matches(text, '(?i)[?&]error=[^&#]') THEN url_decode(regexp_extract(text, '(?i)[?&]error=([^&#]+)', 1)) ELSE 'browser error page' END END"))
_GOALS = "SELECT o_orderkey AS id, CASE o_orderkey % 12 WHEN 0 THEN 'open gmail' WHEN 1 THEN 'Go to www.YouTube.com!' WHEN 2 THEN 'show me yt.' WHEN 3 THEN 'open the pod bay doors' WHEN 4 THEN 'navigate to notion' WHEN 5 THEN 'launch nothing' || CAST(o_orderkey AS STRING) WHEN 6 THEN 'visit shop.example.co.uk' WHEN 7 THEN 'goto fb' WHEN 8 THEN '' WHEN 9 THEN 'open mail' WHEN 10 THEN 'click gmail' ELSE 'open github??' END AS text, CASE o_orderkey % 5 WHEN 0 THEN 'https://mail.google.com/mail/u/0' WHEN 1 THEN 'https://www.youtube.com/' WHEN 2 THEN 'https://github.com/x' WHEN 3 THEN 'not a url' ELSE 'https://gmail.com' END AS url FROM {orders}"
# How a task asks for a site.
_VERBS = r"^(?i)(?:open|go to|goto|visit|navigate to|launch|show me)\s+(\S+)$"


def goal_site(task):
    site = F.regexp_extract(F.regexp_replace(F.trim(task), "[.!?]+$", ""), _VERBS, 1)
    return F.nullif(F.regexp_replace(F.lower(site), r"^www\.", ""), F.lit(""))


def goal_hosts(task):
    """Hosts that satisfy a task that only opens a site; null for other tasks."""
    site = goal_site(task)
    known = F.array_distinct(F.array_compact(F.concat(F.array(canonical_host(site)), F.coalesce(F.split(lookup(ALIASES, site), " "), F.array().cast("array<string>")))))
    return F.when(site.rlike(r"^[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+$"), F.array(site)).when(F.size(known) > 0, known)


_SITE_SQL = f"nullif(regexp_replace(lower(regexp_extract(regexp_replace(trim(text), '[.!?]+$', ''), '{_VERBS}', 1)), '^www\\.', ''), '')"
_GOAL_SQL = f"SELECT *, CASE WHEN regexp_matches(site, '^[A-Za-z0-9_-]+(\\.[A-Za-z0-9_-]+)+$') THEN site ELSE concat_ws(' ', {_canonical_sql('site')}, CASE WHEN site = 'gmail' THEN 'mail.google.com' ELSE {lookup_sql(ALIASES, 'site')} END) END AS hosts FROM (SELECT *, {_SITE_SQL} AS site FROM ({X.plain(_GOALS)}))"
query("fil42_bare_goal", lambda s, d: X.frame(s, d, _GOALS).select("id", F.when(goal_hosts(T).isNotNull(), goal_site(T)).alias("site"), F.array_join(goal_hosts(T), " ").alias("hosts")), f"SELECT id, CASE WHEN hosts <> '' THEN site END AS site, nullif(hosts, '') AS hosts FROM ({_GOAL_SQL})")
query("fil43_goal_satisfied", lambda s, d: X.frame(s, d, _GOALS).select("id", F.coalesce(F.array_contains(goal_hosts(T), F.regexp_replace(F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)), r"^www\.", "")), F.lit(False)).alias("satisfied")), f"SELECT id, coalesce(list_contains(string_split(hosts, ' '), regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', '')) AND hosts <> '', false) AS satisfied FROM ({_GOAL_SQL})")

# one-step tasks against the controls of a page
_TASKS = "SELECT o_orderkey AS id, o_custkey % 50 AS page_id, CASE o_orderkey % 14 WHEN 0 THEN 'Click the Search' WHEN 1 THEN 'tap \"email\"' WHEN 2 THEN 'fill full name with Anita Rao' WHEN 3 THEN 'type card number : 4111' WHEN 4 THEN 'scroll down' WHEN 5 THEN 'scroll top' WHEN 6 THEN 'go to gmail in a new tab' WHEN 7 THEN 'open youtube and search cats' WHEN 8 THEN 'visit https://gmail/inbox' WHEN 9 THEN 'press escape' WHEN 10 THEN 'navigate to shop.example.com' WHEN 11 THEN 'buy milk' WHEN 12 THEN 'enter mobile phone into x' ELSE 'open notion' END AS text FROM {orders}"
# Shapes of one-step tasks.
_CLICK, _FILL = r"""^(?:click|tap|press|hit|select)\s+(?:on\s+|the\s+)?["']?(.+?)["']?\s*$""", r"^(?:fill|type|enter|input|write)\s+(.+?)\s+(?:with|into|in|:)\s+(.+)$"
_GO, _TAB, _STEPS = r"^(?:go to|open|navigate to|visit)\s+(.+)$", r"\bin\s+(?:a\s+|another\s+|the\s+)?new\s+tab\s*$", r"\b(and|then|after|before|next|search|find|click|type|fill|read|play|watch|submit|send|post)\b"
_KEY, _URLISH = r"^(?:press|hit)\s+(enter|escape|tab|space|backspace|delete|arrowdown|arrowup|arrowleft|arrowright)$", r"^(https?://|www\.|[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+(?:/\S*)?$)"


def one_step(tasks, elements):
    """action, element_id, argument of tasks that a rule resolves; the first element by id wins, an action is null where no rule holds.

    Each wording is answered once a page, against each name and role that the page has, and the tasks take its answer.
    """
    task = F.lower(F.trim("text"))
    needle, field = F.trim(F.regexp_extract(task, _CLICK, 1)), F.trim(F.regexp_extract(task, _FILL, 1))
    rows = tasks.select("id", "page_id", task.alias("task"), needle.alias("needle"), field.alias("field"))
    name, role = F.lower(F.trim(F.coalesce("name", F.lit("")))), F.lower(F.trim(F.coalesce("role", F.lit(""))))
    els = elements.groupBy("page_id", name.alias("name"), role.alias("role")).agg(F.min("id").alias("element"))
    n, r, q, f = F.col("name"), F.col("role"), F.col("needle"), F.col("field")
    click = (q != "") & (((n != "") & (n.contains(q) | ((F.length(q) >= 3) & q.contains(n)))) | ((r != "") & ((r == q) | ((F.length(q) >= 4) & q.contains(r)))))
    fill = (f != "") & (n != "") & (n.contains(f) | ((F.length(f) >= 3) & f.contains(n))) & r.isin("textbox", "password", "combobox")
    hits = rows.drop("id").distinct().join(els, "page_id", "left").groupBy("page_id", "task").agg(F.min(F.when(click, F.col("element"))).alias("clicked"), F.min(F.when(fill, F.col("element"))).alias("filled"))
    t = F.col("task")
    raw = F.trim(F.regexp_replace(F.regexp_extract(t, _GO, 1), _TAB, ""))
    known = F.coalesce(canonical_host(raw), F.split_part(lookup(ALIASES, raw), F.lit(" "), F.lit(1)))
    goes = (raw != "") & ~raw.rlike(_STEPS) & (raw.rlike(_URLISH) | known.isNotNull())
    url = F.when(raw.rlike("^https?://"), F.when(F.regexp_extract(raw, "^https?://([^/:?#]*)", 1).contains("."), raw).otherwise(normal_url(raw))).otherwise(F.concat(F.lit("https://"), F.coalesce(known, raw)))
    way = F.regexp_extract(t, r"^scroll\s+(down|up|top|bottom)$", 1)
    hit = lambda action, element, argument: F.struct(F.lit(action).alias("action") if isinstance(action, str) else action.alias("action"), element.cast("long").alias("element_id"), argument.cast("string").alias("argument"))
    no = F.lit(None)
    out = (
        F.when(F.col("clicked").isNotNull(), hit("click", F.col("clicked"), no)).when(F.col("filled").isNotNull(), hit("type", F.col("filled"), F.trim(F.regexp_extract(t, _FILL, 2))))
        .when(way != "", hit("scroll", no, way)).when(goes, hit(F.when(F.regexp_extract(t, _GO, 1).rlike(_TAB), "open_tab").otherwise("navigate"), no, url))
        .when((F.regexp_extract(t, _GO, 1) == "") & t.rlike(_KEY), hit("key", no, F.regexp_extract(t, _KEY, 1)))
    )
    answers = hits.withColumn("out", out).select(F.col("page_id").alias("on_page"), t.alias("wording"), "out.*")
    return rows.join(answers, F.col("page_id").eqNullSafe(F.col("on_page")) & t.eqNullSafe(F.col("wording")), "left").select("id", "action", "element_id", "argument")


_Q = lambda p: p.replace("'", "''")
query("fil44_one_step", lambda s, d: one_step(X.frame(s, d, _TASKS), X.frame(s, d, X.ELEMENTS)), rf"""
WITH t AS (SELECT id, page_id, lower(trim(text)) AS task FROM ({X.plain(_TASKS)})),
e AS (SELECT page_id, id AS element, lower(trim(coalesce(name, ''))) AS name, lower(trim(coalesce(role, ''))) AS role FROM ({X.plain(X.ELEMENTS)})),
q AS (SELECT *, trim(regexp_extract(task, '{_Q(_CLICK)}', 1)) AS needle, trim(regexp_extract(task, '{_Q(_FILL)}', 1)) AS field, regexp_extract(task, '{_GO}', 1) AS whole, trim(regexp_replace(regexp_extract(task, '{_GO}', 1), '{_TAB}', '')) AS raw FROM t),
h AS (SELECT q.id, min(e.element) FILTER (needle <> '' AND ((name <> '' AND (contains(name, needle) OR (length(needle) >= 3 AND contains(needle, name)))) OR (role <> '' AND (role = needle OR (length(needle) >= 4 AND contains(needle, role)))))) AS clicked,
  min(e.element) FILTER (field <> '' AND name <> '' AND (contains(name, field) OR (length(field) >= 3 AND contains(field, name))) AND role IN ('textbox', 'password', 'combobox')) AS filled FROM q LEFT JOIN e ON e.page_id = q.page_id GROUP BY q.id),
k AS (SELECT q.*, clicked, filled, coalesce({_canonical_sql('raw')}, split_part({lookup_sql(ALIASES, 'raw')}, ' ', 1)) AS known FROM q JOIN h ON h.id = q.id),
a AS (SELECT *, CASE WHEN clicked IS NOT NULL THEN 'click' WHEN filled IS NOT NULL THEN 'type' WHEN regexp_matches(task, '^scroll\s+(down|up|top|bottom)$') THEN 'scroll'
  WHEN raw <> '' AND NOT regexp_matches(raw, '{_STEPS}') AND (regexp_matches(raw, '{_URLISH}') OR known IS NOT NULL) THEN CASE WHEN regexp_matches(whole, '{_TAB}') THEN 'open_tab' ELSE 'navigate' END
  WHEN whole = '' AND regexp_matches(task, '{_KEY}') THEN 'key' END AS action FROM k)
SELECT id, action, CASE action WHEN 'click' THEN clicked WHEN 'type' THEN filled END AS element_id,
  CASE WHEN action = 'type' THEN trim(regexp_extract(task, '{_Q(_FILL)}', 2)) WHEN action = 'scroll' THEN split_part(task, ' ', 2) WHEN action = 'key' THEN split_part(task, ' ', 2)
  WHEN action IN ('navigate', 'open_tab') THEN CASE WHEN raw = 'https://gmail/inbox' THEN 'https://gmail.com/inbox' ELSE 'https://' || coalesce(known, raw) END END AS argument FROM a""")

# Names of controls that switch apps.
SWITCHERS = [r"^google\s*apps?$", r"^apps?(\s+(menu|launcher|grid|switcher))?$", r"^(nine|3x3|3[- ]by[- ]3)[\s-]*(square|dot|dots|grid)(\s*(grid|menu))?$", r"^waffle(\s*menu)?$", r"^(menu|switcher)\s+of\s+apps$"]
_LABELS = "SELECT s.id, CASE s.id % 11 WHEN 0 THEN 'Google apps' WHEN 1 THEN ' Apps menu ' WHEN 2 THEN 'Nine-square grid' WHEN 3 THEN 'Waffle' WHEN 4 THEN 'switcher of apps' WHEN 5 THEN 'Our apps' WHEN 6 THEN '' WHEN 7 THEN repeat('apps ', 12) WHEN 8 THEN '3x3 dots menu' WHEN 9 THEN 'App' ELSE NULL END AS text, CASE WHEN s.id % 3 = 0 THEN 'https://h' || CAST(s.id AS STRING) || '.example' END AS url FROM (SELECT c_custkey AS id FROM {customer}) s"
_NAME = F.trim(F.coalesce(T, F.lit("")))
_SWITCH = F.length(_NAME).between(1, 40) & F.lower(_NAME).rlike("|".join(SWITCHERS))
_SWITCH_SQL = f"(length(trim(coalesce(text, ''))) BETWEEN 1 AND 40 AND regexp_matches(lower(trim(coalesce(text, ''))), '{'|'.join(SWITCHERS)}'))"
scalar("fil45_app_switcher", _LABELS, switcher=(_SWITCH, _SWITCH_SQL))
scalar("fil46_app_switcher_refusal", _LABELS, refusal=(F.when(_SWITCH, F.concat(F.lit("refused: go to "), F.coalesce("url", F.lit("https://youtube.com")), F.lit(" instead of "), T)), f"CASE WHEN {_SWITCH_SQL} THEN 'refused: go to ' || coalesce(url, 'https://youtube.com') || ' instead of ' || text END"))
# Tags and roles that can be clicked; actions that leave a frame as it is.
TAGS = ("a", "button", "tr", "li", "label", "summary", "option")
ROLES = ("button", "link", "menuitem", "menuitemcheckbox", "menuitemradio", "tab", "option", "row", "gridcell", "listitem", "treeitem", "switch", "checkbox")
READ_ONLY = ("find_text", "wait", "read_page", "web_search")
_NODES = "SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_partkey % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'div' WHEN 2 THEN 'span' WHEN 3 THEN 'li' WHEN 4 THEN 'input' ELSE 'p' END AS tag, CASE l_suppkey % 5 WHEN 0 THEN 'button' WHEN 1 THEN 'note' WHEN 2 THEN NULL WHEN 3 THEN 'gridcell' ELSE '' END AS role, l_linenumber % 4 = 0 AS focusable, '  Row ' || l_shipmode || '  of ' || CAST(l_orderkey AS STRING) || repeat(' x', l_linenumber * 9) AS text FROM (SELECT *, CASE l_linenumber % 2 WHEN 0 THEN 'AIR' ELSE 'Sea \"fast\"' END AS l_shipmode FROM {lineitem}) l"
scalar("fil47_clickable", _NODES, clickable=(F.col("tag").isin(*TAGS) | F.coalesce(F.col("role").isin(*ROLES), F.lit(False)) | F.col("focusable"), f"tag IN {TAGS} OR coalesce(role IN {ROLES}, false) OR focusable"))
_QUOTED = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
_QUOTED_SQL = lambda c: f"""('"' || replace(replace({c}, '\\', '\\\\'), '"', '\\"') || '"')"""
scalar("str43_describe_target", _NODES, shown=(
    F.concat(F.lit("<"), F.when(F.coalesce("role", F.lit("")) != "", F.concat("tag", F.lit(" role="), "role")).otherwise(F.col("tag")), F.lit("> "), _QUOTED(F.substring(M.normal_for_match(T), 1, 60))),
    f"'<' || CASE WHEN coalesce(role, '') <> '' THEN tag || ' role=' || role ELSE tag END || '> ' || {_QUOTED_SQL("left(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 60)")}"))
scalar("str60_describe_affordance", _NODES, shown=(F.concat(F.substring(T, 1, 200), F.lit(" ["), F.col("tag"), F.lit("]")), "left(text, 200) || ' [' || tag || ']'"))
_OPTIONS = "SELECT c_custkey AS id, ' User' || CAST(c_custkey % 9 AS STRING) || '@Mail.example ' AS email, 'Pick: USER' || CAST(c_custkey % 7 AS STRING) || '@mail.example (home)' AS dialog, CASE WHEN c_custkey % 10 = 0 THEN 'nobody' ELSE 'user' || CAST(c_custkey % 5 AS STRING) || '@mail.example' END AS o1, 'Use user' || CAST(c_custkey % 9 AS STRING) || '@mail.example' AS o2 FROM {customer}"
_WANT = F.lower(F.trim("email"))
scalar("fil49_exact_option", _OPTIONS, place=(F.when(_WANT.contains("@"), F.when(F.lower("o1").contains(_WANT), 0).when(F.lower("o2").contains(_WANT), 1).otherwise(-1)).otherwise(-1), "CASE WHEN contains(lower(o1), lower(trim(email))) THEN 0 WHEN contains(lower(o2), lower(trim(email))) THEN 1 ELSE -1 END"))
scalar("fil50_dialog_shows", _OPTIONS, shown=(_WANT.contains("@") & F.lower("dialog").contains(_WANT), "contains(lower(trim(email)), '@') AND contains(lower(dialog), lower(trim(email)))"))
_ACTIONS = "SELECT event_id AS id, CASE event_id % 13 WHEN 0 THEN 'click' WHEN 1 THEN 'find_text' WHEN 2 THEN 'wait' WHEN 3 THEN 'read_page' WHEN 4 THEN 'web_search' WHEN 5 THEN 'type' WHEN 6 THEN 'navigate' WHEN 7 THEN 'open_tab' WHEN 8 THEN 'click_text' WHEN 9 THEN 'type_text' WHEN 10 THEN 'scroll' WHEN 11 THEN 'close_tab' ELSE 'mystery' END AS name, event_id % 50 AS element, CASE WHEN event_id % 4 = 0 THEN 'because ' || event_type ELSE '' END AS reason, CASE WHEN event_id % 3 = 0 THEN repeat(event_type, 20) ELSE event_type END AS argument FROM {events}"
scalar("fil57_changes_frame", _ACTIONS, changes=(~F.col("name").isin(*READ_ONLY), f"name NOT IN {READ_ONLY}"))
_OR = lambda text: F.when(F.col("reason") != "", F.col("reason")).otherwise(text)
_CUT = lambda n: F.concat(F.lit('"'), F.substring("argument", 1, n), F.lit('"'))
_N = F.col("name")
scalar("str63_describe_intent", _ACTIONS, intent=(
    F.when(_N == "click", _OR(F.concat(F.lit("Click element "), F.col("element").cast("string")))).when(_N == "type", _OR(F.concat(F.lit("Type into element "), F.col("element").cast("string"))))
    .when(_N == "navigate", F.concat(F.lit("Go to "), "argument")).when(_N == "open_tab", F.concat(F.lit("Open "), "argument", F.lit(" in a new tab"))).when(_N == "read_page", "Read the page")
    .when(_N == "click_text", F.concat(F.lit("Click "), _CUT(60))).when(_N == "type_text", F.concat(F.lit("Type into the field named "), _CUT(60))).when(_N == "scroll", F.concat(F.lit("Scroll "), "argument"))
    .when(_N == "find_text", F.concat(F.lit("Look for "), _CUT(10_000))).when(_N == "web_search", _OR(F.concat(F.lit("Search the web for "), _CUT(80)))).otherwise(_OR(F.replace(_N, F.lit("_"), F.lit(" ")))),
    """CASE name WHEN 'click' THEN coalesce(nullif(reason, ''), 'Click element ' || element::VARCHAR) WHEN 'type' THEN coalesce(nullif(reason, ''), 'Type into element ' || element::VARCHAR) WHEN 'navigate' THEN 'Go to ' || argument WHEN 'open_tab' THEN 'Open ' || argument || ' in a new tab' WHEN 'read_page' THEN 'Read the page'
  WHEN 'click_text' THEN 'Click "' || left(argument, 60) || '"' WHEN 'type_text' THEN 'Type into the field named "' || left(argument, 60) || '"' WHEN 'scroll' THEN 'Scroll ' || argument WHEN 'find_text' THEN 'Look for "' || argument || '"' WHEN 'web_search' THEN coalesce(nullif(reason, ''), 'Search the web for "' || left(argument, 80) || '"') ELSE coalesce(nullif(reason, ''), replace(name, '_', ' ')) END"""))
_KNOWN = ("click", "type", "navigate", "read_page")
_TOOLS = "SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 'click' WHEN 1 THEN ' type ' WHEN 2 THEN 'navigate<|channel|>commentary' WHEN 3 THEN 'read_page extra words' WHEN 4 THEN '<|junk|>' WHEN 5 THEN 'unknown tool' ELSE '' END AS text FROM {events}"
_RAW = F.trim(T)
_CUTNAME = F.trim(F.regexp_extract(F.regexp_replace(_RAW, r"<\|.*$", ""), r"^(\S*)", 1))
scalar("str49_tool_name", _TOOLS, name=(F.when((_RAW == "") | _RAW.isin(*_KNOWN), _RAW).when(_CUTNAME != "", _CUTNAME).otherwise(_RAW), f"CASE WHEN trim(text) = '' OR trim(text) IN {_KNOWN} THEN trim(text) ELSE coalesce(nullif(regexp_extract(regexp_replace(trim(text), '<\\|.*$', ''), '^(\\S*)', 1), ''), trim(text)) END"))
_OWNED = "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'Anita  Rao' WHEN 1 THEN 'mail' WHEN 2 THEN 'a.b+c@x.example' WHEN 3 THEN 'gmail' WHEN 4 THEN 'order ' || CAST(o_orderkey AS STRING) ELSE NULL END AS value, CASE o_orderkey % 5 WHEN 0 THEN 'write to ANITA RAO, now' WHEN 1 THEN 'open ggmail' WHEN 2 THEN 'send a.b+c@x.example' WHEN 3 THEN 'track order ' || CAST(o_orderkey AS STRING) ELSE 'use gmail.' END AS task FROM {orders}"
_SQUEEZE = lambda c: F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s+", " "))
_V, _TASK = _SQUEEZE(F.col("value")), _SQUEEZE(F.col("task"))


def owned(value, task):
    """value (five characters and more) stands in task as whole words: each occurrence is followed by, and each rest begins after, no letter or digit."""
    parts = F.split(F.concat(F.lit(" "), task, F.lit(" ")), F.concat(F.lit(r"\Q"), value, F.lit(r"\E")), -1)
    return (F.length(value) >= 5) & (F.size(parts) > 1) & F.exists(F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0))), lambda i: F.get(parts, i).rlike("[^a-z0-9]$") & F.get(parts, i + 1).rlike("^[^a-z0-9]"))


_SQ = lambda c: f"lower(regexp_replace(trim(coalesce({c}, '')), '\\s+', ' ', 'g'))"
scalar("fil33_task_owned", _OWNED, owned=(owned(_V, _TASK), f"length({_SQ('value')}) >= 5 AND regexp_matches({_SQ('task')}, '(^|[^a-z0-9])' || regexp_escape({_SQ('value')}) || '($|[^a-z0-9])')"))

# --- paint tiers and geometry ---------------------------------------------------
# Kinds of regions.
FIELD_KINDS = ("password", "credit_card", "cvv", "otp", "api_key", "id_number", "pan_card", "credential", "credential_label", "input_field")
SPAN_KINDS = ("email_text", "phone_text", "id_text", "name_text", "api_key_text", "credential_text", "ner_text", "image_text")
KINDS = ("face", *SPAN_KINDS, *FIELD_KINDS)
TIERS = ("skip", "blur", "surrogate", "opaque")
PADDING, BLUR = 4, 6
AUDIT_LABELS = {"credential": "Credential", "id_number": "ID number", "api_key": "API key", "pii_text": "PII text", "face": "Face", "image_text": "PII in image (OCR)"}


def tier(kind, destroy_faces, mask):
    return (
        F.when(kind == "face", F.when(destroy_faces, "opaque").otherwise("skip")).when(~mask, "blur").when(kind.endswith("_text"), "opaque")
        .when(kind.isin("credential_label", "input_field"), "blur").otherwise("surrogate")
    )


def _tier_sql(kind="kind", faces="faces", mask="mask"):
    return f"CASE WHEN {kind} = 'face' THEN CASE WHEN {faces} THEN 'opaque' ELSE 'skip' END WHEN NOT {mask} THEN 'blur' WHEN ends_with({kind}, '_text') THEN 'opaque' WHEN {kind} IN ('credential_label', 'input_field') THEN 'blur' ELSE 'surrogate' END"


def _kind_of(key):
    return f"CASE {key} % {len(KINDS)} " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"


_REGIONS = f"SELECT l_orderkey AS page, l_linenumber AS n, l_orderkey * 10 + l_linenumber AS id, {_kind_of('l_partkey')} AS kind, l_orderkey % 4 <> 1 AS faces, l_orderkey % 5 <> 2 AS mask, CAST(l_partkey % 970 AS DOUBLE) - 30.5 AS x, CAST(l_suppkey % 530 AS DOUBLE) - 10 AS y, CAST(l_partkey % 410 AS DOUBLE) / 2 AS w, CAST(l_orderkey % 37 AS DOUBLE) AS h, CASE l_orderkey % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.25 ELSE 2.0 END AS scale, CASE WHEN l_orderkey % 3 = 0 THEN 120.0 ELSE 0.0 END AS offset_y, CASE WHEN l_partkey % 3 = 0 THEN CAST(4000000000000000 + l_orderkey * 7919 AS STRING) END AS value FROM {{lineitem}}"
_REGIONS = _REGIONS.replace("{{", "{").replace("}}", "}")
_KC = F.col("kind")
_TIER = tier(_KC, F.col("faces"), F.col("mask"))
scalar("mth28_tier_for_kind", _REGIONS, tier=(_TIER, _tier_sql()))
scalar("mth29_tier_badge", _REGIONS, badge=(lookup({"opaque": "opaque", "blur": "blur+escalate", "surrogate": "surrogate", "skip": "none"}, F.when(F.col("id") % 9 != 0, _TIER)), f"CASE WHEN id % 9 <> 0 THEN {lookup_sql({'opaque': 'opaque', 'blur': 'blur+escalate', 'surrogate': 'surrogate', 'skip': 'none'}, '(' + _tier_sql() + ')')} END"))
scalar("mth30_detection_kind", _REGIONS, kind_shown=(F.when(_KC.isin("credential_label", "input_field"), "credential").otherwise(_KC), "CASE WHEN kind IN ('credential_label', 'input_field') THEN 'credential' ELSE kind END"))
query("agg10_tier_sets", lambda s, d: s.sql("SELECT explode(array(" + ", ".join(f"'{k}'" for k in KINDS) + ")) AS kind").crossJoin(F.broadcast(s.sql("SELECT * FROM VALUES (true, true), (true, false), (false, true), (false, false) AS p(faces, mask)"))).groupBy("faces", "mask").agg(
    F.array_join(F.array_sort(F.collect_list(F.when(_TIER == "opaque", _KC))), ",").alias("destroyed"), F.array_join(F.array_sort(F.collect_list(F.when(_TIER != "opaque", _KC))), ",").alias("soft")),
    f"WITH k AS (SELECT unnest([{', '.join(repr(k) for k in KINDS)}]) AS kind), p AS (SELECT * FROM (VALUES (true, true), (true, false), (false, true), (false, false)) AS p(faces, mask)) SELECT faces, mask, coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (({_tier_sql()}) = 'opaque'), '') AS destroyed, coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (({_tier_sql()}) <> 'opaque'), '') AS soft FROM k, p GROUP BY faces, mask")
scalar("agg30_audit_of_detections", _REGIONS, ("id", "kind"), label=(F.coalesce(lookup(AUDIT_LABELS, _KC), _KC), lookup_sql(AUDIT_LABELS, "kind", "kind")), tier=(_TIER, _tier_sql()), confidence=(F.col("h") / 40, "h / 40"))
query("joi15_readable_regions", lambda s, d: X.frame(s, d, _REGIONS).filter(_TIER != "surrogate").select("id", "kind"), f"SELECT id, kind FROM ({X.plain(_REGIONS)}) WHERE ({_tier_sql()}) <> 'surrogate'")
_IMAGE_W, _IMAGE_H = 1440, 900


def half_up(c):
    return F.floor(c + 0.5)


def paint_rect(x, y, w, h, scale, offset):
    """x, y, width, height of the padded, scaled rectangle within the image, as columns; null where nothing is left."""
    pad = scale * PADDING
    px, py = F.greatest(F.lit(0), half_up(x * scale - pad)), F.greatest(F.lit(0), half_up(y * scale + offset - pad))
    pw, ph = F.least(_IMAGE_W - px, half_up(w * scale + pad * 2)), F.least(_IMAGE_H - py, half_up(h * scale + pad * 2))
    good = (scale > 0) & (pw > 0) & (ph > 0)
    return [F.when(good, v) for v in (px, py, pw, ph)]


_PX, _PY, _PW, _PH = paint_rect(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("scale"), F.col("offset_y"))
_RECT_SQL = f"""SELECT *, CASE WHEN scale > 0 AND pw > 0 AND ph > 0 THEN px END AS rx, CASE WHEN scale > 0 AND pw > 0 AND ph > 0 THEN py END AS ry, CASE WHEN scale > 0 AND pw > 0 AND ph > 0 THEN pw END AS rw, CASE WHEN scale > 0 AND pw > 0 AND ph > 0 THEN ph END AS rh FROM (
  SELECT *, least({_IMAGE_W} - px, floor(w * scale + 8 * scale + 0.5))::BIGINT AS pw, least({_IMAGE_H} - py, floor(h * scale + 8 * scale + 0.5))::BIGINT AS ph FROM (
  SELECT *, greatest(0, floor(x * scale - 4 * scale + 0.5))::BIGINT AS px, greatest(0, floor(y * scale + offset_y - 4 * scale + 0.5))::BIGINT AS py FROM ({X.plain(_REGIONS)})))"""
query("mth26_paint_rect", lambda s, d: X.frame(s, d, _REGIONS).select("id", _PX.alias("x"), _PY.alias("y"), _PW.alias("width"), _PH.alias("height")), f"SELECT id, rx AS x, ry AS y, rw AS width, rh AS height FROM ({_RECT_SQL})")


def region_paints(regions):
    """One operation for each region that is in the image: tier, rectangle, what is drawn, and its place in the order of paint (weakest tier first)."""
    from pyspark.sql.window import Window

    rows = regions.withColumns({"tier": _TIER, "rx": _PX, "ry": _PY, "rw": _PW, "rh": _PH}).filter("rx IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("page").orderBy(F.array_position(F.array(*(F.lit(t) for t in TIERS)), F.col("tier")), "n", "x", "y", "w", "h", "kind"))
    drawn, s = F.col("tier") == "surrogate", F.col("scale")
    return rows.select(
        "page", "n", rank.alias("nth"), "tier", F.when(F.col("tier") == "blur", s * BLUR).alias("blur_radius"), F.when(drawn, C.surrogate_for(_KC, F.col("value"))).alias("drawn"),
        F.when(drawn, F.greatest(F.lit(9), half_up(F.least(F.col("rh") * 0.5, s * 12)))).alias("font_px"), (F.col("tier") != "skip").alias("painted"), F.round(F.col("rx") / _IMAGE_W, 9).alias("box_x"))


query("top16_plan_paints", lambda s, d: region_paints(X.frame(s, d, _REGIONS)).drop("drawn"), f"""
SELECT page, n, row_number() OVER (PARTITION BY page ORDER BY list_position({list(TIERS)}, tier), n, x, y, w, h, kind) AS nth, tier, CASE WHEN tier = 'blur' THEN scale * 6 END AS blur_radius,
  CASE WHEN tier = 'surrogate' THEN greatest(9, floor(least(rh * 0.5, scale * 12) + 0.5))::BIGINT END AS font_px, tier <> 'skip' AS painted, round(rx / {_IMAGE_W}, 9) AS box_x FROM (SELECT *, {_tier_sql()} AS tier FROM ({_RECT_SQL})) WHERE rx IS NOT NULL""")
_SHOTS = "SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 0.0 WHEN 1 THEN NULL ELSE 1440.0 END AS image_w, CASE event_id % 11 WHEN 0 THEN -1.0 ELSE 900.0 END AS image_h, CASE event_id % 5 WHEN 0 THEN 2.0 WHEN 1 THEN 0.0 ELSE 1.0 END AS dpr, CASE event_id % 3 WHEN 0 THEN 720.0 ELSE 1440.0 END AS view_w, CASE event_id % 13 WHEN 0 THEN -5.0 ELSE CAST(event_id % 900 AS DOUBLE) END AS scroll_y, event_id % 4 = 0 AS full_page FROM {events}"
_GOOD = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
_IMG, _REG = _GOOD("image_w") & _GOOD("image_h"), _GOOD("dpr") & _GOOD("view_w") & F.coalesce(F.col("scroll_y") >= 0, F.lit(False))
_OFF = _IMG & _REG & ~F.col("full_page") & (F.abs(F.col("image_w") - F.col("view_w") * F.col("dpr")) > 1)
_WHY = F.array_compact(F.array(F.when(~_IMG, "capture-image-geometry-missing"), F.when(~_REG, "capture-region-geometry-missing"), F.when(_OFF, "capture-viewport-geometry-mismatch")))
_FIT = F.size(_WHY) == 0
_SCALE = F.when(_FIT, F.when(F.col("full_page"), F.col("image_w") / F.col("view_w")).otherwise(F.col("dpr"))).otherwise(1.0)
_WHY_SQL = "SELECT *, list_filter([CASE WHEN NOT (coalesce(image_w > 0, false) AND coalesce(image_h > 0, false)) THEN 'capture-image-geometry-missing' END, CASE WHEN NOT (coalesce(dpr > 0, false) AND coalesce(view_w > 0, false) AND coalesce(scroll_y >= 0, false)) THEN 'capture-region-geometry-missing' END, CASE WHEN coalesce(image_w > 0 AND image_h > 0 AND dpr > 0 AND view_w > 0 AND scroll_y >= 0 AND NOT full_page AND abs(image_w - view_w * dpr) > 1, false) THEN 'capture-viewport-geometry-mismatch' END], lambda x: x IS NOT NULL) AS why FROM (" + X.plain(_SHOTS) + ")"
query("mth25_region_mapping", lambda s, d: X.frame(s, d, _SHOTS).select("id", _FIT.alias("valid"), _SCALE.alias("scale"), F.when(_FIT & F.col("full_page"), F.col("scroll_y") * _SCALE).otherwise(0.0).alias("offset_y"), (_FIT & F.col("full_page")).alias("mapped"), F.array_join(_WHY, ",").alias("reasons")),
      f"SELECT id, len(why) = 0 AS valid, CASE WHEN len(why) > 0 THEN 1 WHEN full_page THEN image_w / view_w ELSE dpr END AS scale, CASE WHEN len(why) = 0 AND full_page THEN scroll_y * (image_w / view_w) ELSE 0 END AS offset_y, len(why) = 0 AND full_page AS mapped, array_to_string(why, ',') AS reasons FROM ({_WHY_SQL})")
_SHIFTS = "SELECT event_id AS id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'https://p' || CAST(event_id % 6 AS STRING) END AS url, 'https://p' || CAST(event_id % 6 + CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END AS STRING) AS url2, 1.0 AS dpr, CASE WHEN event_id % 23 = 0 THEN 2.0 ELSE 1.0 END AS dpr2, CAST(event_id % 40 AS DOUBLE) AS sx, CAST(event_id % 40 AS DOUBLE) AS sx2, CAST(event_id % 700 AS DOUBLE) AS sy, CAST(event_id % 3 * (event_id % 1400) AS DOUBLE) AS sy2, CAST(user_id AS DOUBLE) AS x, value AS y FROM {events}"
_DX, _DY = F.col("sx2") - F.col("sx"), F.col("sy2") - F.col("sy")
_BAD = F.when(F.col("url").isNull(), "capture-verification-missing").when(F.col("url") != F.col("url2"), "capture-document-changed").when(F.col("dpr") != F.col("dpr2"), "capture-viewport-changed").when((F.abs(_DX) > 600) | (F.abs(_DY) > 600), "capture-scrolled-too-far")
_BAD_SQL = "CASE WHEN url IS NULL THEN 'capture-verification-missing' WHEN url <> url2 THEN 'capture-document-changed' WHEN dpr <> dpr2 THEN 'capture-viewport-changed' WHEN abs(sx2 - sx) > 600 OR abs(sy2 - sy) > 600 THEN 'capture-scrolled-too-far' END"
scalar("joi14_reconcile_shift", _SHIFTS, reason=(_BAD, _BAD_SQL), shift_y=(F.when(_BAD.isNull(), _DY).otherwise(0.0), f"CASE WHEN ({_BAD_SQL}) IS NULL THEN sy2 - sy ELSE 0 END"), region_y=(F.when(_BAD.isNull(), F.col("y") + _DY).otherwise(F.col("y")), f"CASE WHEN ({_BAD_SQL}) IS NULL THEN y + (sy2 - sy) ELSE y END"))

# --- protection evidence ----------------------------------------------------------
_EVIDENCE = "SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 2 = 0 END AS faces, event_id % 3 <> 0 AS text_complete, event_id % 5 <> 0 AS mapping_valid, event_id % 4 AS residual, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN 'b' ELSE 'a,b' END AS reasons, CASE event_id % 3 WHEN 0 THEN 'b,c' ELSE '' END AS more FROM {events}"
_LIST = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
_BASE = F.when(F.col("faces").isNull(), F.array(F.lit("no protection evidence"))).otherwise(_LIST(F.col("reasons")))
scalar("agg16_missing_protection", _EVIDENCE, faces_complete=(F.lit(False), "false"), final_complete=(F.lit(False), "false"), residual_known=(F.lit(False), "false"), reason=(F.concat(F.lit("missing: "), "more"), "'missing: ' || more"))
scalar("agg17_capture_evidence", _EVIDENCE, faces_complete=(F.coalesce("faces", F.lit(False)), "coalesce(faces, false)"), text_done=(F.col("text_complete"), "text_complete"), mapping_done=(F.col("mapping_valid"), "mapping_valid"), why=(
    F.array_join(F.array_distinct(F.concat(_BASE, _LIST(F.col("more")))), ","),
    "CASE WHEN faces IS NULL THEN concat_ws(',', 'no protection evidence', nullif(more, '')) ELSE CASE WHEN more = '' THEN reasons WHEN reasons = '' THEN more WHEN contains(reasons, 'b') THEN reasons || ',c' ELSE reasons || ',' || more END END"))
scalar("agg28_empty_verification", _EVIDENCE, verified=(F.lit(True), "true"), checked=(F.lit(0), "0"), redacted=(F.lit(0), "0"), confidence=(F.lit(1.0), "1::DOUBLE"), leaked=(F.lit(""), "''"))
query("agg31_protected_frames", lambda s, d: X.frame(s, d, _EVIDENCE).filter(F.coalesce("faces", F.lit(False)) & F.col("text_complete") & F.col("mapping_valid") & (F.col("residual") == 0) & (F.size(_LIST(F.col("reasons"))) == 0)).select("id"), f"SELECT id FROM ({X.plain(_EVIDENCE)}) WHERE coalesce(faces, false) AND text_complete AND mapping_valid AND residual = 0 AND reasons = ''")
_CHAINS = "SELECT user_id AS id, CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS hashes, CASE user_id % 7 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS links, user_id % 4 = 0 AS head, CASE user_id % 6 WHEN 0 THEN 2 ELSE 0 END AS legacy, CASE WHEN user_id % 3 = 0 THEN 'seq 4 differs' END AS reason FROM (SELECT DISTINCT user_id FROM {events}) u"
_PART = F.col("head") | (F.col("legacy") > 0)
_H, _L = F.coalesce("hashes", F.lit(True)), F.coalesce("links", F.lit(True))
scalar("agg20_chain_badge", _CHAINS, badge=(F.when(~_H | ~_L, "TAMPERED").when(_PART, "INTACT*").otherwise("INTACT"), "CASE WHEN hashes = false OR links = false THEN 'TAMPERED' WHEN head OR legacy > 0 THEN 'INTACT*' ELSE 'INTACT' END"),
       class_name=(F.when(~_H | ~_L, "tampered").when(_PART, "partial").otherwise("verified"), "CASE WHEN hashes = false OR links = false THEN 'tampered' WHEN head OR legacy > 0 THEN 'partial' ELSE 'verified' END"),
       note=(F.when(~_H, F.concat(F.lit("hash: "), F.coalesce("reason", F.lit("digest differs")))).when(~_L, F.concat(F.lit("link: "), F.coalesce("reason", F.lit("entries do not join")))).when(_PART, F.coalesce("reason", F.lit("part not checked"))).otherwise("all entries match"),
             "CASE WHEN hashes = false THEN 'hash: ' || coalesce(reason, 'digest differs') WHEN links = false THEN 'link: ' || coalesce(reason, 'entries do not join') WHEN head OR legacy > 0 THEN coalesce(reason, 'part not checked') ELSE 'all entries match' END"))
_FOUND = "SELECT event_id AS id, event_id % 3 AS hits, event_id % 2 AS faces, CASE event_id % 5 WHEN 0 THEN 'Card number, SSN' WHEN 1 THEN 'SSN' ELSE '' END AS leaks, event_id % 7 % 3 AS pixels FROM {events}"
_PLURAL = lambda c, one, rest: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {one}"), F.when(F.col(c) == 1, "").otherwise("s"), F.lit(rest)))
_PARTS = F.array_compact(F.array(_PLURAL("hits", "blur", " proved recoverable"), _PLURAL("faces", "face", " not covered"), F.when(F.col("leaks") != "", F.concat(F.lit("OCR still reading "), "leaks")), _PLURAL("pixels", "region", " found unredacted")))
_PART_SQL = "list_filter([CASE WHEN hits > 0 THEN hits::VARCHAR || CASE WHEN hits = 1 THEN ' blur' ELSE ' blurs' END || ' proved recoverable' END, CASE WHEN faces > 0 THEN faces::VARCHAR || ' face not covered' END, CASE WHEN leaks <> '' THEN 'OCR still reading ' || leaks END, CASE WHEN pixels > 0 THEN pixels::VARCHAR || CASE WHEN pixels = 1 THEN ' region' ELSE ' regions' END || ' found unredacted' END], lambda x: x IS NOT NULL)"
scalar("str54_escalation_reason", _FOUND, reason=(
    F.when(F.size(_PARTS) == 0, "a redaction not accepted").when(F.size(_PARTS) == 1, F.get(_PARTS, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(_PARTS, F.lit(1), F.greatest(F.size(_PARTS) - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(_PARTS, -1))),
    f"CASE len({_PART_SQL}) WHEN 0 THEN 'a redaction not accepted' WHEN 1 THEN ({_PART_SQL})[1] ELSE array_to_string(({_PART_SQL})[:-2], ', ') || ' and ' || ({_PART_SQL})[-1] END"))

# --- what leaves: payloads and alerts ------------------------------------------------
# Shapes of what must not leave.
_CARD_RUN, _LONE = r"(?<![0-9A-Za-z])(?:[0-9][ -]*?){13,19}(?![0-9A-Za-z])", r"(?<![0-9A-Za-z]){}(?![0-9A-Za-z])"
_HINT = r"(?:aadhaar|aadhar|uidai|uid|national[ -]?id)\s*[\"':=]{0,3}\s*"
_OWN = {k: _checksums.STAND_INS[k].replace(" ", "") for k in ("card", "aadhaar")}
_MAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"


def card_shape(d):
    """Length and leading digits of a card network; a first digit of 5 needs 51 to 55."""
    n, first = F.length(d), F.substring(d, 1, 1)
    return n.between(13, 19) & (
        F.when(first == "4", n.isin(13, 16, 19)).when(first == "5", (n == 16) & d.rlike("^5[1-5]"))
        .when(first == "3", ((n == 15) & d.rlike("^3[47]")) | ((n >= 14) & d.rlike("^(30[0-5]|36|38|39)"))).when(first == "6", (n >= 16) & d.rlike("^(6011|65|64[4-9]|62|60|81|82)")).otherwise(False)
    )


def _shape_sql(d):
    return f"(length({d}) BETWEEN 13 AND 19 AND CASE left({d}, 1) WHEN '4' THEN length({d}) IN (13, 16, 19) WHEN '5' THEN length({d}) = 16 AND regexp_matches({d}, '^5[1-5]') WHEN '3' THEN (length({d}) = 15 AND regexp_matches({d}, '^3[47]')) OR (length({d}) >= 14 AND regexp_matches({d}, '^(30[0-5]|36|38|39)')) WHEN '6' THEN length({d}) >= 16 AND regexp_matches({d}, '^(6011|65|64[4-9]|62|60|81|82)') ELSE false END)"


_CARDS = "SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN '4' WHEN 1 THEN '51' WHEN 2 THEN '2221' WHEN 3 THEN '34' WHEN 4 THEN '36' WHEN 5 THEN '6011' WHEN 6 THEN '62' WHEN 7 THEN '56' ELSE '9' END || repeat('7', CAST(o_custkey % 9 + 8 AS INT)) AS text FROM {orders}"
scalar("fil23_card_shape", _CARDS, passes=(card_shape(T), _shape_sql("text")))


def payload_finding(text):
    """kind and masked sample of the first finding in a payload: a card, a named or spaced identity number, a tax number, an address."""
    first = lambda found: F.get(found, F.lit(0))
    digits = F.transform(F.regexp_extract_all(text, F.lit(_CARD_RUN), F.lit(0)), lambda m: C.digits_of(m))
    card = first(F.filter(digits, lambda d: (d != _OWN["card"]) & card_shape(d) & C.luhn_valid(d)))
    spaced = F.regexp_extract_all(text, F.lit(_LONE.format("[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}")), F.lit(0))
    named = F.regexp_extract_all(text, F.lit("(?i)" + _HINT + "(?<![0-9A-Za-z])([0-9]{12})(?![0-9A-Za-z])"), F.lit(1))
    number = first(F.filter(F.transform(F.concat(spaced, named), lambda m: C.digits_of(m)), lambda d: C.is_aadhaar(d) & (d != _OWN["aadhaar"])))
    pan = first(F.regexp_extract_all(text, F.lit(_LONE.format("[A-Z]{5}[0-9]{4}[A-Z]")), F.lit(0)))
    mail = F.when(text.contains("@"), first(F.regexp_extract_all(text, F.lit(_spans.P.java(_MAIL)), F.lit(0))))
    own = F.lit(_checksums.STAND_INS["email"])
    hit = lambda kind, *sample: F.struct(F.lit(kind).alias("kind"), F.concat(*sample).alias("sample"))
    return (
        F.when(card.isNotNull(), hit("credit_card", F.lit("•••• •••• •••• "), F.right(card, F.lit(4)))).when(number.isNotNull(), hit("aadhaar", F.lit("•••• •••• "), F.right(number, F.lit(4))))
        .when(pan != _checksums.STAND_INS["pan"], hit("pan", F.substring(pan, 1, 2), F.lit("•••••"), F.right(pan, F.lit(2))))
        .when(F.lower(mail) != own, hit("email", F.substring(F.split_part(mail, F.lit("@"), F.lit(1)), 1, 2), F.lit("•••@"), F.split_part(mail, F.lit("@"), F.lit(2))))
    )


_PAYLOADS = X.NOTES.replace("'short'", "chr(123) || '\"uid\":\"234567890124\",\"n\":1' || chr(125)").replace("'From: Anita Rao ok Mr. Raj Kumar Singh'", "'id=234567890124&x=2'").replace("'no personal data here at all '", "'pan=ABCDE1234F q '") + " UNION ALL SELECT doc_id + 100000000 AS id, text FROM {documents}"
_STOP = "(?:$|[^0-9A-Za-z])"
_FIRST_SQL = f"""SELECT id,
  list_filter(list_transform(regexp_extract_all(text, '(?:^|[^0-9A-Za-z])((?:[0-9][ -]*?){{13,19}}){_STOP}', 1), lambda m: regexp_replace(m, '[^0-9]', '', 'g')), lambda c: {_shape_sql('c')} AND {D.luhn('c')} AND c <> replace({{card}}, ' ', ''))[1] AS card,
  list_filter(list_concat(regexp_extract_all(text, '(?:^|[^0-9A-Za-z])([0-9]{{4}}[ -][0-9]{{4}}[ -][0-9]{{4}}){_STOP}', 1), regexp_extract_all(text, '(?i){_Q(_HINT)}([0-9]{{12}}){_STOP}', 1)), lambda m: {D.aadhaar('m')})[1] AS num,
  nullif(regexp_extract(text, '(?:^|[^0-9A-Za-z])([A-Z]{{5}}[0-9]{{4}}[A-Z]){_STOP}', 1), '') AS pan, nullif(regexp_extract(text, '{_MAIL}', 0), '') AS mail FROM ({X.plain(_PAYLOADS)})"""


def _payload_sql():
    from .values import _STAND

    return f"""SELECT id, CASE WHEN card IS NOT NULL THEN 'credit_card' WHEN num IS NOT NULL THEN 'aadhaar' WHEN pan <> 'ABCDE1234F' THEN 'pan' WHEN mail IS NOT NULL THEN 'email' END AS kind,
  CASE WHEN card IS NOT NULL THEN '•••• •••• •••• ' || right(card, 4) WHEN num IS NOT NULL THEN '•••• •••• ' || right(num, 4) WHEN pan <> 'ABCDE1234F' THEN left(pan, 2) || '•••••' || right(pan, 2) WHEN mail IS NOT NULL THEN left(split_part(mail, '@', 1), 2) || '•••@' || split_part(mail, '@', 2) END AS sample FROM ({_FIRST_SQL.replace('{card}', _STAND['card'])})"""


query("fil22_payload_finding", lambda s, d: X.frame(s, d, _PAYLOADS).withColumn("f", payload_finding(T)).select("id", "f.kind", "f.sample"), _payload_sql())
_ALERT_JSON = "SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'not json' ELSE chr(123) || '\"url\": \"https://h' || CAST(user_id AS STRING) || '.example\"' || CASE event_id % 3 WHEN 0 THEN ', \"method\": \"POST\"' ELSE '' END || CASE event_id % 4 WHEN 2 THEN ', \"thirdParty\": true' WHEN 3 THEN ', \"thirdParty\": \"yes\"' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN '' ELSE ', \"timestamp\": ' || CAST(event_id AS STRING) END || chr(125) END AS text FROM {events}"
_VAR = F.try_parse_json(T)
_STR = lambda k, other: F.coalesce(F.try_variant_get(_VAR, f"$.{k}", "string"), F.lit(other))
_OBJ = F.col("text").startswith("{")
scalar("str50_normal_alert", _ALERT_JSON, url=(F.when(_OBJ, _STR("url", "")), "CASE WHEN text LIKE '{%' THEN coalesce(json_extract_string(text, '$.url'), '') END"), method=(F.when(_OBJ, _STR("method", "REQUEST")), "CASE WHEN text LIKE '{%' THEN coalesce(json_extract_string(text, '$.method'), 'REQUEST') END"), pii_type=(F.when(_OBJ, _STR("piiType", "pii")), "CASE WHEN text LIKE '{%' THEN 'pii' END"),
       third=(F.when(_OBJ, F.when(F.schema_of_variant(F.try_variant_get(_VAR, "$.thirdParty", "variant")) == "BOOLEAN", F.try_variant_get(_VAR, "$.thirdParty", "boolean"))), "CASE WHEN text LIKE '{%' AND json_type(text, '$.thirdParty') = 'BOOLEAN' THEN json_extract_string(text, '$.thirdParty')::BOOLEAN END"),
       at=(F.when(_OBJ, F.try_variant_get(_VAR, "$.timestamp", "long")), "CASE WHEN text LIKE '{%' THEN json_extract_string(text, '$.timestamp')::BIGINT END"))

# --- turns of a planner --------------------------------------------------------------
_TURNS = "SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN 'ceiling' WHEN 1 THEN 'degenerate' WHEN 2 THEN 'salad' WHEN 3 THEN 'silent' WHEN 4 THEN 'unanswered' WHEN 5 THEN 'deliberation' ELSE '' END AS ended, event_id % 4 AS n, CAST(value * 1000 AS BIGINT) AS ran_ms, event_id % 5 = 0 AS proven, event_id % 7 = 0 AS answered, CASE event_id % 3 WHEN 0 THEN 'socket hang up' WHEN 1 THEN 'bad request' ELSE 'request timed out' END AS text, CASE event_id % 4 WHEN 0 THEN 'nvidia' WHEN 1 THEN 'groq' ELSE 'openai' END AS provider, CASE WHEN event_id % 6 = 0 THEN 1000 END AS given, event_id * 10 AS asked, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id * 10 + 1500 END AS headers, event_id * 10 + 14000 AS now FROM {events}"


def _retry_plan():
    from .pages import _RETRY, _WITHIN

    end, heard = F.col("ended"), F.col("proven") | F.col("answered")
    cut, stalled = end.isin("ceiling", "degenerate", "salad"), (end == "silent") & (F.col("n") > 0) & (F.col("ran_ms") >= 45_000)
    mute = (end == "unanswered") | ((end == "silent") & (F.col("n") == 0))
    retryable = T.rlike(_RETRY) & ~T.rlike(_WITHIN)
    why = F.when(cut, "cut while answering").when(stalled, F.concat(F.lit("streamed for "), half_up(F.col("ran_ms") / 1000).cast("string"), F.lit("s, then quiet"))).when(mute & ~heard, F.when(end == "unanswered", "never acknowledged").otherwise("silent endpoint")).otherwise("")
    return ~cut & ~stalled & F.when(mute, heard).otherwise(retryable), why


def _retry_sql():
    from .pages import _RETRY, _WITHIN

    mute = "(ended = 'unanswered' OR (ended = 'silent' AND n = 0))"
    stalled = "(ended = 'silent' AND n > 0 AND ran_ms >= 45000)"
    again = f"CASE WHEN ended IN ('ceiling', 'degenerate', 'salad') OR {stalled} THEN false WHEN {mute} THEN proven OR answered ELSE regexp_matches(text, {D.text(_RETRY)}) AND NOT regexp_matches(text, {D.text(_WITHIN)}) END"
    why = f"CASE WHEN ended IN ('ceiling', 'degenerate', 'salad') THEN 'cut while answering' WHEN {stalled} THEN 'streamed for ' || floor(ran_ms / 1000 + 0.5)::BIGINT::VARCHAR || 's, then quiet' WHEN {mute} AND NOT (proven OR answered) THEN CASE WHEN ended = 'unanswered' THEN 'never acknowledged' ELSE 'silent endpoint' END ELSE '' END"
    return again, why


_AGAIN_SQL, _WHY_NOT_SQL = _retry_sql()
query("stm03_retry_policy", lambda s, d: X.frame(s, d, _TURNS).select("id", _retry_plan()[0].alias("retry"), _retry_plan()[1].alias("because")), f"SELECT id, {_AGAIN_SQL} AS retry, {_WHY_NOT_SQL} AS because FROM ({X.plain(_TURNS)})")
scalar("stm04_header_budget", _TURNS, budget_ms=(F.coalesce("given", F.when(F.col("provider") == "nvidia", 60_000).otherwise(25_000)), "coalesce(given, CASE provider WHEN 'nvidia' THEN 60000 ELSE 25000 END)"))
scalar("stm08_frame_waits", _TURNS, waits=(F.col("proven") & ~F.col("answered") & (F.col("n") > 0) & (F.coalesce("given", F.lit(0)) != 1000), "proven AND NOT answered AND n > 0 AND coalesce(given, 0) <> 1000"))


def seconds(ms):
    return F.when(ms < 10_000, F.concat((half_up(ms / 100) / 10).cast("decimal(10,1)").cast("string"), F.lit("s"))).otherwise(F.concat(half_up(ms / 1000).cast("string"), F.lit("s")))


def _seconds_sql(ms):
    return f"CASE WHEN {ms} < 10000 THEN (floor(({ms}) / 100 + 0.5) / 10)::DECIMAL(10,1)::VARCHAR || 's' ELSE floor(({ms}) / 1000 + 0.5)::BIGINT::VARCHAR || 's' END"


scalar("win14_wait_cause", _TURNS, cause=(F.when(F.col("headers") <= 0, F.concat(F.lit("not answered for "), seconds(F.col("now") - F.col("asked")))).otherwise(F.concat(F.lit("accepted after "), seconds(F.col("headers") - F.col("asked")), F.lit(", quiet for "), seconds(F.col("now") - F.col("headers")))),
       f"CASE WHEN headers <= 0 THEN 'not answered for ' || ({_seconds_sql('now - asked')}) ELSE 'accepted after ' || ({_seconds_sql('headers - asked')}) || ', quiet for ' || ({_seconds_sql('now - headers')}) END"))
_SAID = {"salad": "stopped writing language", "degenerate": "went round in a loop", "deliberation": "reasoned without an action", "ceiling": "was still streaming"}
scalar("str56_turn_cut_message", _TURNS, message=(
    F.when(lookup(_SAID, F.col("ended")).isNotNull(), F.concat("provider", F.lit(" "), lookup(_SAID, F.col("ended")), F.lit(" after "), half_up(F.col("ran_ms") / 1000).cast("string"), F.lit("s")))
    .when(F.col("n") > 0, F.concat("provider", F.lit(" stopped after "), F.col("n").cast("string"), F.lit(" update(s)"))).otherwise(F.concat("provider", F.lit(" did not respond within 90s"))),
    f"CASE WHEN ended IN {tuple(_SAID)} THEN provider || ' ' || {lookup_sql(_SAID, 'ended')} || ' after ' || floor(ran_ms / 1000 + 0.5)::BIGINT::VARCHAR || 's' WHEN n > 0 THEN provider || ' stopped after ' || n::VARCHAR || ' update(s)' ELSE provider || ' did not respond within 90s' END"))
