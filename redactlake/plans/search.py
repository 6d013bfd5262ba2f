"""Queries of web search: request policy, addresses, results, settings and model lists, all over stored requests and responses."""

from __future__ import annotations

from pyspark.sql import functions as _functions

from ..catalog import query, scalar
from ..functions import duck as D
from ..functions import masks as _masks
from ..functions.deferred import DeferredModule
from ..operators import spans as _spans
from . import fixtures as X
from .policy import _QUOTED, _QUOTED_SQL
from .text import _kept_sql

F = DeferredModule(_functions)
M = DeferredModule(_masks)
S = DeferredModule(_spans)
T = F.col("text")

# Limits and kinds of the request.
MOST_QUERY, MOST_PURPOSE, MOST_PAGE, MOST_RESULTS, MOST_MINUTES = 500, 2000, 10, 20, 5_256_000
DOMAIN_TYPES = ("web", "news", "research_paper")
ENDPOINT = "https://api.search.example/v1/search"

_REQUESTS = "SELECT o_orderkey AS id, CASE o_orderkey % 12 WHEN 0 THEN '' WHEN 1 THEN repeat('long query ', 60) WHEN 2 THEN 'flights <CRED_1> and <PII_2>' WHEN 3 THEN 'mail a.b' || CAST(o_orderkey AS STRING) || '@x.example now' WHEN 4 THEN 'card 4111 1111 1111 1111 or 98765 43210 or 2345 6789 0124 or mail c@d.example' WHEN 5 THEN ' cheap flights & trains ' ELSE 'weather in town ' || CAST(o_orderkey % 97 AS STRING) END AS text, CASE o_orderkey % 5 WHEN 0 THEN 'news' WHEN 1 THEN 'images' WHEN 2 THEN ' research_paper ' ELSE '' END AS kind, CASE o_orderkey % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 99.0 WHEN 2 THEN 3.9 WHEN 3 THEN NULL ELSE 8.0 END AS wanted, CASE o_orderkey % 4 WHEN 0 THEN ' Example.ORG ,, a.b' WHEN 1 THEN ' , ' ELSE NULL END AS domains, CASE WHEN o_orderkey % 6 = 0 THEN ' find fares ' END AS purpose, CASE o_orderkey % 9 WHEN 0 THEN 11 WHEN 1 THEN 2 ELSE 0 END AS page, CASE o_orderkey % 8 WHEN 0 THEN 60 WHEN 1 THEN 0 END AS minutes, o_orderkey % 10 AS used, o_orderkey % 3 = 0 AS allowed FROM {orders}"


def domains(c):
    """Trimmed lower-case names that are not empty; null without any."""
    kept = F.filter(F.transform(F.split(c, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.when(F.size(kept) > 0, kept)


_DOMAINS_SQL = "list_filter(list_transform(string_split(domains, ','), lambda x: lower(trim(x))), lambda x: x <> '')"
scalar("pol02_domain_list", _REQUESTS, domains=(F.array_join(domains(F.col("domains")), ","), f"CASE WHEN len({_DOMAINS_SQL}) > 0 THEN array_to_string({_DOMAINS_SQL}, ',') END"))


def findings(values, shown):
    """The first three, masked, and how many more."""
    head = F.array_join(F.transform(F.slice(values, 1, 3), lambda v: F.concat(F.lit('"'), shown(v), F.lit('"'))), ", ")
    return F.concat(head, F.when(F.size(values) > 3, F.concat(F.lit(" (+"), (F.size(values) - 3).cast("string"), F.lit(" more)"))).otherwise(""))


_MASK_SQL = """CASE WHEN length(trim({v})) <= 2 THEN '••' WHEN strpos(trim({v}), '@') > 1 AND contains({v}, '.') AND length(trim({v})) > strpos(trim({v}), '@') + 1 THEN left(split_part(trim({v}), '@', 1), 2) || '•••@' || substr(trim({v}), strpos(trim({v}), '@') + 1)
  WHEN regexp_matches({v}, '[A-Za-z]') AND regexp_matches({v}, '[0-9]') AND length(regexp_replace({v}, '[^A-Za-z0-9]', '', 'g')) >= 6 AND NOT regexp_matches(trim({v}), '\\s') THEN regexp_replace(trim({v}), '[A-Za-z0-9]', '•', 'g')
  WHEN length(regexp_replace({v}, '[^0-9]', '', 'g')) >= 4 THEN regexp_replace(trim({v}), '[0-9]', '•', 'g') ELSE left(trim({v}), 2) || repeat('•', least(10, greatest(6, length(trim({v})) - 2))) END"""
_SHOWN_SQL = _kept_sql(_REQUESTS) + """, seen AS (SELECT id, list(value ORDER BY start, "end" DESC) AS found FROM kept GROUP BY id),
 described AS (SELECT id, array_to_string(list_transform(found[1:3], lambda v: '"' || """ + _MASK_SQL.format(v="v") + """ || '"'), ', ') || CASE WHEN len(found) > 3 THEN ' (+' || (len(found) - 3)::VARCHAR || ' more)' ELSE '' END AS shown FROM seen)"""
_FOUND = F.transform(S.resolved(T), lambda s: s["value"])
_SEEN = F.coalesce(F.when(F.size(_FOUND) > 0, findings(_FOUND, lambda v: M.mask_sample(v))), F.lit(""))
query("pol03_describe_findings", lambda s, d: X.frame(s, d, _REQUESTS).withColumn("shown", F.when(F.size(_FOUND) > 0, findings(_FOUND, lambda v: M.mask_sample(v)))).filter("shown IS NOT NULL").select("id", "shown"), _SHOWN_SQL + " SELECT id, shown FROM described")


def verdicts(requests):
    """ok, error and the shape of every request: an empty or long query, vault tokens and personal data are refused (the last two unless allowed), then kinds and numbers are checked."""
    q = F.trim("text")
    tokens = F.regexp_extract_all(q, F.lit("<[A-Z]+_[0-9]+>"), F.lit(0))
    kind = F.trim("kind")
    error = (
        F.when(q == "", "empty query").when(F.length(q) > MOST_QUERY, F.concat(F.lit("query of "), F.length(q).cast("string"), F.lit(" characters")))
        .when((F.size(tokens) > 0) & ~F.col("allowed"), F.concat(F.lit("private token: "), findings(tokens, lambda v: v)))
        .when((F.col("seen") != "") & ~F.col("allowed"), F.concat(F.lit("private data: "), "seen"))
        .when((kind != "") & ~kind.isin(*DOMAIN_TYPES), F.concat(F.lit("unknown kind "), kind))
    )
    rows = requests.withColumn("seen", _SEEN).withColumn("error", error)
    most = F.least(F.greatest(F.lit(1), F.floor(F.coalesce("wanted", F.lit(5.0)))), F.lit(MOST_RESULTS))
    ok = F.col("error").isNull()
    return rows.select("id", ok.alias("ok"), "error", F.when(ok, q).alias("query"), F.when(ok, F.nullif(kind, F.lit(""))).alias("kind"), F.when(ok, most).alias("most"), F.when(ok, F.array_join(domains(F.col("domains")), ",")).alias("include"), F.when(ok, F.nullif(F.trim(F.coalesce("purpose", F.lit(""))), F.lit(""))).alias("purpose"), "used")


_TOK = "regexp_extract_all(trim(text), '<[A-Z]+_[0-9]+>')"
_VERDICT_SQL = _SHOWN_SQL + f""", v AS (SELECT r.*, CASE WHEN trim(text) = '' THEN 'empty query' WHEN length(trim(text)) > {MOST_QUERY} THEN 'query of ' || length(trim(text))::VARCHAR || ' characters'
  WHEN len({_TOK}) > 0 AND NOT allowed THEN 'private token: ' || array_to_string(list_transform({_TOK}[1:3], lambda v: '"' || v || '"'), ', ') || CASE WHEN len({_TOK}) > 3 THEN ' (+' || (len({_TOK}) - 3)::VARCHAR || ' more)' ELSE '' END
  WHEN d.shown IS NOT NULL AND NOT allowed THEN 'private data: ' || d.shown WHEN trim(kind) NOT IN ('', 'web', 'news', 'research_paper') THEN 'unknown kind ' || trim(kind) END AS error FROM ({X.plain(_REQUESTS)}) r LEFT JOIN described d ON d.id = r.id)"""
_SHAPE_SQL = f"CASE WHEN error IS NULL THEN trim(text) END AS query, CASE WHEN error IS NULL THEN nullif(trim(kind), '') END AS kind, CASE WHEN error IS NULL THEN least(greatest(1, floor(coalesce(wanted, 5))), {MOST_RESULTS})::BIGINT END AS most, CASE WHEN error IS NULL AND len({_DOMAINS_SQL}) > 0 THEN array_to_string({_DOMAINS_SQL}, ',') END AS include, CASE WHEN error IS NULL THEN nullif(trim(purpose), '') END AS purpose"
query("fil63_search_verdict", lambda s, d: verdicts(X.frame(s, d, _REQUESTS)).drop("used"), _VERDICT_SQL + f" SELECT id, error IS NULL AS ok, error, {_SHAPE_SQL} FROM v")


def search_address(c):
    """The address of a request, or what is wrong with it."""
    from .policy import encoded

    q, kind = F.trim("text"), F.coalesce(F.nullif(F.trim("kind"), F.lit("")), F.lit("web"))
    purpose, include = F.nullif(F.trim(F.coalesce("purpose", F.lit(""))), F.lit("")), F.array_join(domains(F.col("domains")), ",")
    form = lambda v: F.replace(F.replace(F.replace(F.replace(F.replace(encoded(v), F.lit("%20"), F.lit("+")), F.lit("!"), F.lit("%21")), F.lit("'"), F.lit("%27")), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))
    part = lambda name, v: F.when(v.isNotNull(), F.concat(F.lit(f"{name}="), v))
    error = (
        F.when(q == "", "empty query").when(F.length(q) > MOST_QUERY, "long query").when(F.length(purpose) > MOST_PURPOSE, "long purpose").when(~F.col("page").between(0, MOST_PAGE), "page out of range")
        .when(~kind.isin(*DOMAIN_TYPES), "unknown kind").when(~F.col("minutes").between(1, MOST_MINUTES), "minutes out of range").when(F.col("minutes").isNotNull() & (kind == "research_paper"), "minutes with papers")
    )
    url = F.concat(F.lit(ENDPOINT + "?"), F.concat_ws("&", part("query", form(q)), part("purpose", form(purpose)), part("include_domains", form(include)), part("domain_type", F.when(kind != "web", kind)), part("page", F.when(F.col("page") != 0, F.col("page").cast("string"))), part("recency_minutes", F.col("minutes").cast("string"))))
    return F.when(error.isNull(), url) if c == "url" else error


_FORM = lambda x: "replace(replace(url_encode(" + x + "), '%20', '+'), '%2A', '*')"
_KIND_SQL = "coalesce(nullif(trim(kind), ''), 'web')"
_ADDRESS_ERROR = f"CASE WHEN trim(text) = '' THEN 'empty query' WHEN length(trim(text)) > {MOST_QUERY} THEN 'long query' WHEN length(trim(purpose)) > {MOST_PURPOSE} THEN 'long purpose' WHEN page NOT BETWEEN 0 AND {MOST_PAGE} THEN 'page out of range' WHEN {_KIND_SQL} NOT IN {DOMAIN_TYPES} THEN 'unknown kind' WHEN minutes NOT BETWEEN 1 AND {MOST_MINUTES} THEN 'minutes out of range' WHEN minutes IS NOT NULL AND {_KIND_SQL} = 'research_paper' THEN 'minutes with papers' END"
query("src18_search_url", lambda s, d: X.frame(s, d, _REQUESTS).select("id", search_address("error").alias("error"), F.replace(search_address("url"), F.lit("~"), F.lit("%7E")).alias("url")), f"""SELECT id, error, CASE WHEN error IS NULL THEN replace('{ENDPOINT}?' || concat_ws('&', 'query=' || {_FORM('trim(text)')}, 'purpose=' || {_FORM("nullif(trim(purpose), '')")}, CASE WHEN len({_DOMAINS_SQL}) > 0 THEN 'include_domains=' || {_FORM(f"array_to_string({_DOMAINS_SQL}, ',')")} END, CASE WHEN {_KIND_SQL} <> 'web' THEN 'domain_type=' || {_KIND_SQL} END, CASE WHEN page <> 0 THEN 'page=' || page::VARCHAR END, 'recency_minutes=' || minutes::VARCHAR), '~', '%7E') END AS url FROM (SELECT *, {_ADDRESS_ERROR} AS error FROM ({X.plain(_REQUESTS)}))""")

# responses: stored JSON of ranked results
_RESPONSES = "SELECT event_id AS id, event_id % 4 AS hits, chr(123) || '\"query\": \"q' || CAST(user_id AS STRING) || '\", \"total_results\": ' || CAST(event_id % 4 AS STRING) || ', \"page\": 0, \"results\": [' || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN chr(123) || '\"position\": 1, \"site_name\": \"S' || event_type || '\", \"title\": \"' || repeat(event_type || ' ', 30) || '\", \"snippet\": \"short\", \"url\": \"https://a.example/' || CAST(event_id AS STRING) || '\", \"year\": 2020' || chr(125) WHEN 2 THEN chr(123) || '\"title\": \"no address\"' || chr(125) || ', ' || chr(123) || '\"title\": \"T\", \"snippet\": \"' || repeat('mail b@c.example ', 20) || '\", \"url\": \"https://b.example\", \"publisher\": \"P\"' || chr(125) ELSE chr(123) || '\"position\": \"x\", \"title\": 7, \"url\": \"https://c.example\"' || chr(125) || ', ' || chr(123) || '\"position\": 5, \"url\": \"https://d.example\", \"published_at\": \"2024\"' || chr(125) || ', 17' END || ']' || chr(125) AS text FROM {events}"


def _typed(v, key, kind):
    """A field of a variant if it has the kind that is asked for."""
    there = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
    return F.when(there.isin("BIGINT", "DOUBLE", "DECIMAL") if kind == "long" else there == "STRING", F.try_variant_get(v, f"$.{key}", kind))


def results(responses):
    """A row for each result of a response that has an address, with its place in the list."""
    each = F.from_json(F.get_json_object("text", "$.results"), "array<string>")
    rows = responses.select("id", F.posexplode(each).alias("nth", "item")).withColumn("v", F.try_parse_json("item"))
    v, word = F.col("v"), lambda k: F.coalesce(_typed(F.col("v"), k, "string"), F.lit(""))
    out = rows.select("id", "nth", F.coalesce(_typed(v, "position", "long"), F.lit(0)).alias("position"), word("site_name").alias("site"), word("title").alias("title"), word("snippet").alias("snippet"), word("url").alias("url"), _typed(v, "published_at", "string").alias("published"), _typed(v, "publisher", "string").alias("publisher"), _typed(v, "year", "long").alias("year"))
    return out.filter("url <> ''")


_JS = lambda k: f"CASE WHEN json_type(item, '$.{k}') = 'VARCHAR' THEN json_extract_string(item, '$.{k}') END"
_JN = lambda k: f"CASE WHEN json_type(item, '$.{k}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN json_extract_string(item, '$.{k}')::BIGINT END"
_RESULTS_SQL = f"res AS (SELECT id, nth - 1 AS nth, coalesce({_JN('position')}, 0) AS position, coalesce({_JS('site_name')}, '') AS site, coalesce({_JS('title')}, '') AS title, coalesce({_JS('snippet')}, '') AS snippet, coalesce({_JS('url')}, '') AS url, {_JS('published_at')} AS published, {_JS('publisher')} AS publisher, {_JN('year')} AS year FROM (SELECT id, unnest(json_extract(text, '$.results[*]')) AS item, generate_subscripts(json_extract(text, '$.results[*]'), 1) AS nth FROM fx) WHERE coalesce({_JS('url')}, '') <> '')"
_WITH = f"WITH fx AS ({X.plain(_RESPONSES)}), {_RESULTS_SQL}"
query("src20_parse_results", lambda s, d: results(X.frame(s, d, _RESPONSES)), _WITH + " SELECT * FROM res")


def rendered(responses, most=8, snippet=220):
    """Text of each response: its query, then a numbered line or more for each of the first results."""
    from pyspark.sql.window import Window

    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(F.col(c))
    rows = results(responses).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("nth"))).filter(F.col("rank") <= most)
    meta = F.concat_ws(" · ", F.nullif("site", F.lit("")), "published", "publisher")
    line = F.concat(F.when(F.col("position") != 0, F.col("position")).otherwise(F.col("rank")).cast("string"), F.lit(". "), cut("title", 120), F.when(meta != "", F.concat(F.lit(" ("), meta, F.lit(")"))).otherwise(""), F.lit("\n   "), "url", F.when(F.col("snippet") != "", F.concat(F.lit("\n   "), cut("snippet", snippet))).otherwise(""))
    lines = rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"), F.count(F.lit(1)).alias("n"))
    head = F.concat(F.lit("search "), _QUOTED(F.get_json_object("text", "$.query")), F.lit(": "), F.get_json_object("text", "$.total_results"), F.lit(" results\n"))
    return responses.join(lines, "id", "left").select("id", F.concat(head, F.coalesce("lines", F.lit("(no results)"))).alias("shown"), F.coalesce("n", F.lit(0)).alias("n"))


_LINES_SQL = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY nth) AS rank FROM res), lined AS (
  SELECT id, rank, CASE WHEN position <> 0 THEN position ELSE rank END::VARCHAR || '. ' || CASE WHEN length(title) > 120 THEN left(title, 117) || '...' ELSE title END || coalesce(' (' || nullif(concat_ws(' · ', nullif(site, ''), published, publisher), '') || ')', '') || chr(10) || '   ' || url || coalesce(chr(10) || '   ' || nullif(CASE WHEN length(snippet) > 220 THEN left(snippet, 217) || '...' ELSE snippet END, ''), '') AS line FROM ranked WHERE rank <= 8
), shown AS (SELECT f.id, 'search "' || json_extract_string(text, '$.query') || '": ' || json_extract_string(text, '$.total_results') || ' results' || chr(10) || coalesce(l.lines, '(no results)') AS shown, coalesce(l.n, 0) AS n FROM fx f LEFT JOIN (SELECT id, string_agg(line, chr(10) ORDER BY rank) AS lines, count(*) AS n FROM lined GROUP BY id) l ON l.id = f.id)"""
query("src21_format_results", lambda s, d: rendered(X.frame(s, d, _RESPONSES)), _WITH + _LINES_SQL + " SELECT id, shown, n FROM shown")


def preamble(count, size):
    return F.when(count == 0, "no results: rephrase, or go to a known site").otherwise(F.concat(count.cast("string"), F.lit(" result(s), "), size.cast("string"), F.lit(" bytes: public pages, not the user's data")))


_PRE_SQL = "CASE WHEN n = 0 THEN 'no results: rephrase, or go to a known site' ELSE n::VARCHAR || ' result(s), ' || strlen(shown)::VARCHAR || ' bytes: public pages, not the user''s data' END"
query("pol05_preamble", lambda s, d: rendered(X.frame(s, d, _RESPONSES)).select("id", preamble(F.col("n"), F.octet_length("shown")).alias("preamble")), _WITH + _LINES_SQL + f" SELECT id, {_PRE_SQL} AS preamble FROM shown")


def marked(text):
    """text with every span of personal data replaced by the kind of its token: names and addresses count as credentials here."""
    kind = lambda k: F.when(k == "api_key", "<KEY>").when(k == "id_text", "<ID>").otherwise("<CRED>")
    return F.when(F.length(text) >= 6, S.spliced(text, S.resolved(text), lambda s: kind(s["kind"]))).otherwise(text)


_MARK_SQL = """ , pieces AS (SELECT id, start, "end", coalesce(max("end") OVER (PARTITION BY id ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, CASE kind WHEN 'api_key' THEN '<KEY>' WHEN 'id_text' THEN '<ID>' ELSE '<CRED>' END AS w FROM kept),
 done AS (SELECT p.id, string_agg(substr(f.text, pos + 1, greatest(start - pos, 0)) || w, '' ORDER BY start, "end" DESC) AS head, max("end") AS last FROM pieces p JOIN fx f USING (id) GROUP BY p.id),
 safe AS (SELECT a.id, CASE WHEN d.id IS NULL THEN a.text ELSE d.head || substr(a.text, d.last + 1) END AS safe FROM ({src}) a LEFT JOIN done d USING (id))"""
query("str18_mark_results", lambda s, d: X.frame(s, d, X.TEXTS).select("id", marked(T).alias("safe")), _kept_sql(X.TEXTS) + _MARK_SQL.format(src=X.plain(X.TEXTS)) + " SELECT id, safe FROM safe")


def dispatched(requests, responses, cap=8):
    """Requests under the run's cap that the policy lets through, joined with the stored response of their id: what a planner is told."""
    told = verdicts(requests).withColumn("error", F.when(F.col("used") >= cap, F.concat(F.lit("cap of "), F.lit(str(cap)), F.lit(" searches reached"))).otherwise(F.col("error")))
    answers = rendered(responses).select("id", "shown", "n", F.octet_length("shown").alias("bytes"))
    rows = told.join(answers, "id", "left")
    ok = F.col("error").isNull() & F.col("shown").isNotNull()
    content = F.concat(preamble(F.col("n"), F.col("bytes")), F.lit("\n\n"), marked(F.col("shown")))
    return rows.select("id", ok.alias("ok"), F.when(F.col("error").isNull() & F.col("shown").isNull(), "transport failed").otherwise(F.col("error")).alias("error"), F.when(ok, content).alias("content"))


_RESP = f"SELECT id, shown AS text FROM ({_WITH} {_LINES_SQL} SELECT id, shown FROM shown)"
query("pol04_dispatch_search", lambda s, d: dispatched(X.frame(s, d, _REQUESTS), X.frame(s, d, _RESPONSES)), f"""
SELECT id, error IS NULL AND safe IS NOT NULL AS ok, CASE WHEN error IS NULL AND safe IS NULL THEN 'transport failed' ELSE error END AS error, CASE WHEN error IS NULL THEN pre || chr(10) || chr(10) || safe END AS content FROM (
  SELECT v.id, CASE WHEN v.used >= 8 THEN 'cap of 8 searches reached' ELSE v.error END AS error, pre, safe FROM ({_VERDICT_SQL} SELECT id, used, error FROM v) v
  LEFT JOIN (SELECT id, {_PRE_SQL} AS pre FROM ({_WITH} {_LINES_SQL} SELECT * FROM shown)) p ON p.id = v.id
  LEFT JOIN ({_kept_sql(_RESP)} {_MARK_SQL.format(src=_RESP)} SELECT id, safe FROM safe) s ON s.id = v.id)""")
_FETCHED = _RESPONSES.replace("SELECT event_id AS id,", "SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 401 ELSE 200 END AS status, event_id % 25 AS wanted,")


def fetched(responses):
    """What a stored exchange gives: its first results (1 to 20 as wanted) and the bytes of its body, or why there is none and whether to try again."""
    ok = F.col("status") == 200
    n = results(responses.filter(ok)).groupBy("id").agg(F.count(F.lit(1)).alias("found"))
    why = F.when(F.col("status").isin(401, 403), "key refused").when(F.col("status") == 429, "rate limited").when(F.col("status") >= 500, "server error").when(~ok, "request refused")
    rows = responses.join(n, "id", "left")
    return rows.select("id", why.alias("error"), ((F.col("status") == 429) | (F.col("status") >= 500)).alias("again"), F.when(ok, F.least(F.coalesce("found", F.lit(0)), F.greatest(F.lit(1), F.least(F.lit(MOST_RESULTS), F.col("wanted"))))).alias("results"), F.octet_length("text").cast("long").alias("bytes"))


query("src19_search_web", lambda s, d: fetched(X.frame(s, d, _FETCHED)), f"""WITH fx AS ({X.plain(_FETCHED)}), {_RESULTS_SQL} SELECT f.id, CASE WHEN status IN (401, 403) THEN 'key refused' WHEN status = 429 THEN 'rate limited' WHEN status >= 500 THEN 'server error' WHEN status <> 200 THEN 'request refused' END AS error, status = 429 OR status >= 500 AS again, CASE WHEN status = 200 THEN least(coalesce(n, 0), greatest(1, least(20, wanted))) END AS results, strlen(text) AS bytes FROM fx f LEFT JOIN (SELECT id, count(*) AS n FROM res GROUP BY id) r ON r.id = f.id""")
_CHUNKS = "SELECT event_id AS id, CAST(event_id / 20 AS INT) AS run, chr(123) || '\"models\": [' || chr(123) || '\"id\": \"gpt-' || CAST(event_id % 7 AS STRING) || '\"' || chr(125) || ', ' || chr(123) || '\"id\": \"embed-' || CAST(event_id % 5 AS STRING) || '\"' || chr(125) || ', ' || chr(123) || '\"id\": \"o' || CAST(event_id % 3 AS STRING) || '-mini\"' || chr(125) || ', ' || chr(123) || '\"name\": \"x\"' || chr(125) || ']' || chr(125) AS text FROM {events} WHERE event_id % 20 = 0"
query("src29_list_models", lambda s, d: X.frame(s, d, _CHUNKS).select("id", F.array_join(F.array_sort(F.filter(F.transform(F.from_json(F.get_json_object("text", "$.models"), "array<struct<id: string>>"), lambda x: x["id"]), lambda n: n.rlike("^(gpt|o[0-9]|chatgpt)"))), ",").alias("models")), f"SELECT id, array_to_string(list_sort(list_filter(json_extract_string(text, '$.models[*].id'), lambda n: regexp_matches(n, '^(gpt|o[0-9]|chatgpt)'))), ',') AS models FROM ({X.plain(_CHUNKS)})")

# settings: stored JSON over defaults, with what older versions wrote
_SETTINGS = "SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN chr(123) || '\"server\": ' || chr(123) || '\"enabled\": true' || chr(125) || ', \"apiKey\": \"k' || CAST(c_custkey AS STRING) || '\"' || chr(125) WHEN 2 THEN chr(123) || '\"privacy\": ' || chr(123) || '\"blurFaces\": false' || chr(125) || chr(125) WHEN 3 THEN chr(123) || '\"privacy\": ' || chr(123) || '\"blurFaces\": false, \"destroyFaces\": true, \"maskCredentials\": false' || chr(125) || ', \"fastPlanner\": true' || chr(125) WHEN 4 THEN chr(123) || '\"elevenlabs\": ' || chr(123) || '\"apiKey\": \"v\"' || chr(125) || ', \"search\": ' || chr(123) || '\"maxResults\": 9' || chr(125) || chr(125) WHEN 5 THEN chr(123) || '\"vision\": ' || chr(123) || '\"enabled\": false' || chr(125) || ', \"server\": ' || chr(123) || '\"enabled\": true' || chr(125) || ', \"apiKeys\": ' || chr(123) || '\"anthropic\": \"own\"' || chr(125) || ', \"apiKey\": \"old\"' || chr(125) ELSE chr(123) || '\"elevenlabs\": ' || chr(123) || '\"apiKey\": \"v\", \"sttEnabled\": true' || chr(125) || chr(125) END AS text FROM {customer}"
_G = lambda k, kind="boolean": F.try_variant_get(F.try_parse_json(T), f"$.{k}", kind)
_VOICED = (F.coalesce(_G("elevenlabs.apiKey", "string"), F.lit("")) != "") & ~F.coalesce(_G("elevenlabs.sttEnabled"), F.lit(False)) & ~F.coalesce(_G("elevenlabs.ttsEnabled"), F.lit(False))
_B = lambda k: f"json_extract_string(text, '$.{k}')::BOOLEAN"
_VOICED_SQL = f"(coalesce(json_extract_string(text, '$.elevenlabs.apiKey'), '') <> '' AND NOT coalesce({_B('elevenlabs.sttEnabled')}, false) AND NOT coalesce({_B('elevenlabs.ttsEnabled')}, false))"
scalar("src30_normal_settings", _SETTINGS,
       vision=(F.coalesce(_G("vision.enabled"), F.coalesce(_G("server.enabled"), F.lit(False))), f"coalesce({_B('vision.enabled')}, {_B('server.enabled')}, false)"),
       destroy_faces=(F.coalesce(_G("privacy.destroyFaces"), F.coalesce(_G("privacy.blurFaces"), F.lit(True))), f"coalesce({_B('privacy.destroyFaces')}, {_B('privacy.blurFaces')}, true)"),
       mask=(F.coalesce(_G("privacy.maskCredentials"), F.lit(True)), f"coalesce({_B('privacy.maskCredentials')}, true)"), fast=(F.coalesce(_G("fastPlanner"), F.lit(False)), f"coalesce({_B('fastPlanner')}, false)"),
       key=(F.coalesce(F.nullif(_G("apiKeys.anthropic", "string"), F.lit("")), _G("apiKey", "string"), F.lit("")), "coalesce(nullif(json_extract_string(text, '$.apiKeys.anthropic'), ''), json_extract_string(text, '$.apiKey'), '')"),
       listens=(_VOICED | F.coalesce(_G("elevenlabs.sttEnabled"), F.lit(False)), f"{_VOICED_SQL} OR coalesce({_B('elevenlabs.sttEnabled')}, false)"), speaks=(_VOICED | F.coalesce(_G("elevenlabs.ttsEnabled"), F.lit(False)), f"{_VOICED_SQL} OR coalesce({_B('elevenlabs.ttsEnabled')}, false)"),
       results=(F.coalesce(_G("search.maxResults", "int"), F.lit(5)), "coalesce(json_extract_string(text, '$.search.maxResults')::INT, 5)"), searches=(F.coalesce(_G("search.maxSearchesPerRun", "int"), F.lit(3)), "coalesce(json_extract_string(text, '$.search.maxSearchesPerRun')::INT, 3)"))
