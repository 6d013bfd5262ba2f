"""Queries of prompts, snapshots and memories under a token vault."""

from __future__ import annotations

from pyspark.sql import functions as _functions
from pyspark.sql.window import Window

from ..catalog import query, scalar
from ..functions import duck as D
from ..functions import masks as _masks
from ..functions import patterns as P
from ..functions.deferred import DeferredModule
from ..operators import spans as _spans
from ..operators import vault as _vault
from . import fixtures as X
from . import pages as G
from . import reading as R
from . import text as TX
from .search import _MASK_SQL

F = DeferredModule(_functions)
M = DeferredModule(_masks)
S = DeferredModule(_spans)
V = DeferredModule(_vault)
T = F.col("text")

# --- prompts: what a user typed ------------------------------------------------------
_PROMPTS = X.NOTES.replace("'short'", "'my aadhaar number is 2345 6789 0123 and card: 4111 1111 1111 1112 ok'").replace("'no personal data here at all ' || " + X._K, "'pay 4111111111111111 for 234567890124 or 234567890125'").replace("'From: Anita Rao ok Mr. Raj Kumar Singh'", "'email Oskar Lindt the invoice and text Li Wei Chen Ping now, message the team. sent by maria lopez'").replace("'Patient: Maria Lopez met Dr. John Smith today'", "'forward this invoice to Nora Berg Holm please; vendor: Acme Traders'")
_EXTRA = " UNION ALL ".join([
    TX._tagged_sql(60, "credential", "Card number", r"\b\d{13,19}\b", where=D.luhn("value")), TX._tagged_sql(61, "id_text", "Aadhaar number", r"\b\d{12}\b", where=D.aadhaar("value")),
    TX._tagged_sql(62, "id_text", "Aadhaar number", P.CUED_AADHAAR, 1, "length(regexp_replace(value, '[^0-9]', '', 'g')) = 12"), TX._tagged_sql(63, "credential", "Card number", P.CUED_CARD, 1, "length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 13 AND 19"),
])


def _prompted(s, d):
    texts = X.frame(s, d, _PROMPTS)
    found = S.match_prompts(texts).withColumn("vault", F.expr("id div 1000"))
    entries = V.vault(found)
    return texts, found, entries, V.tokenized(texts, found, entries)


_PROMPT_SQL = TX._kept_sql(_PROMPTS, f"{TX._ALL_SQL} UNION ALL {_EXTRA}") + TX._VAULT_SQL
_SAFE_SQL = TX._TOKEN_SPLICE.format(fixture=X.plain(_PROMPTS))
query("str01_tokenize_prompt", lambda s, d: _prompted(s, d)[3], _PROMPT_SQL + _SAFE_SQL)


def leading_name(run):
    """The two or three words at the head of a run that are a name: while they have capitals, or, of small letters, up to a word that begins no name."""
    words = F.split(F.trim(run), r"\s+")
    first = F.get(words, F.lit(0))
    capital = first.rlike(r"^\p{Lu}")
    stops = lambda w: F.when(capital, ~w.rlike(r"^\p{Lu}")).otherwise(F.lower(w).isin(*P.NO_NAME))
    zero = F.struct(F.array(first).alias("kept"), F.lit(False).alias("end"))
    kept = F.aggregate(F.slice(words, 2, 2), zero, lambda acc, w: F.when(acc["end"] | stops(w), F.struct(acc["kept"].alias("kept"), F.lit(True).alias("end"))).otherwise(F.struct(F.array_append(acc["kept"], w).alias("kept"), F.lit(False).alias("end"))), lambda acc: acc["kept"])
    return F.when((F.size(kept) >= 2) & ~(~capital & F.lower(first).isin(*P.NO_NAME)), F.array_join(kept, " "))


def _leading_sql(run):
    w = f"string_split_regex(trim({run}), '\\s+')"
    stop = f"list_transform(({w})[2:3], lambda x: CASE WHEN regexp_matches(({w})[1], '^\\p{{Lu}}') THEN NOT regexp_matches(x, '^\\p{{Lu}}') ELSE lower(x) IN {P.NO_NAME} END)"
    n = f"coalesce(nullif(list_position({stop}, true), 0), len({stop}) + 1)"
    return f"CASE WHEN {n} >= 2 AND NOT (NOT regexp_matches(({w})[1], '^\\p{{Lu}}') AND lower(({w})[1]) IN {P.NO_NAME}) THEN array_to_string(({w})[1:{n}], ' ') END"


_RUNS = "SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'Oskar Lindt the invoice' WHEN 1 THEN 'the team please' WHEN 2 THEN 'maria lopez about it' WHEN 3 THEN 'Solo' WHEN 4 THEN 'Li Wei Chen Ping' WHEN 5 THEN 'Anita and Raj' WHEN 6 THEN 'ana maria o''brien' ELSE ' Émile Zola ' || CAST(o_orderkey AS STRING) END AS text FROM {orders}"
scalar("str03_leading_name", _RUNS, name=(leading_name(T), _leading_sql("text")))


def _tasks(s, d):
    """Prompts under tokens, with the names after words of address written as tokens too."""
    _, found, entries, safe = _prompted(s, d)
    told = safe.select("id", F.col("sanitized").alias("text"))
    runs = told.select("id", F.inline(S.matches(T, P.NAME_CONTEXT, 1))).withColumn("name", leading_name(F.col("value"))).filter("name IS NOT NULL")
    names = runs.select(F.expr("id div 1000").alias("vault"), "id", "start", (F.col("start") + F.length("name")).alias("end"), F.col("name").alias("value"))
    out = V.tokenized(told, names, V.extended(entries, names))
    return out.select("id", F.col("sanitized").alias("task"), F.col("n_tokens").alias("n_names"))


query("str02_tokenize_task", _tasks, f"""WITH told AS MATERIALIZED ({_PROMPT_SQL} {_SAFE_SQL}), old AS MATERIALIZED ({_PROMPT_SQL} SELECT vault, value, token, prefix FROM vault),
  tx AS (SELECT id, sanitized AS text FROM told), runs AS (SELECT id, start, {_leading_sql('value')} AS value FROM ({D.spans(P.NAME_CONTEXT.replace('(?iu)', '(?i)'), 1, 'tx')})), names AS (SELECT id // 1000 AS vault, id, start, start + length(value) AS "end", value FROM runs WHERE value IS NOT NULL),
  fresh AS (SELECT vault, value, min((id, start)) AS f FROM names n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.vault = n.vault AND o.value = n.value) GROUP BY vault, value),
  entries AS (SELECT vault, value, token FROM old UNION ALL SELECT f.vault, f.value, '<PII_' || (row_number() OVER (PARTITION BY f.vault ORDER BY f.f) + coalesce(h.had, 0))::VARCHAR || '>' FROM fresh f LEFT JOIN (SELECT vault, count(*) AS had FROM old WHERE prefix = 'PII' GROUP BY vault) h ON h.vault = f.vault),
  pieces AS (SELECT k.id, k.start, k."end", v.token AS w, coalesce(max(k."end") OVER (PARTITION BY k.id ORDER BY k.start, k."end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM names k JOIN entries v ON v.vault = k.vault AND v.value = k.value),
  done AS (SELECT p.id, string_agg(substr(f.text, pos + 1, greatest(start - pos, 0)) || w, '' ORDER BY start, "end" DESC) AS head, max("end") AS last, count(*) AS n FROM pieces p JOIN tx f USING (id) GROUP BY p.id)
  SELECT a.id, CASE WHEN d.id IS NULL THEN a.text ELSE d.head || substr(a.text, d.last + 1) END AS task, coalesce(n, 0) AS n_names FROM tx a LEFT JOIN done d USING (id)""")


def legends(found, entries, most=8):
    """For each vault the text that names its first tokens, with a masked sample and where the value came from (even ids are tasks here)."""
    first = found.groupBy("vault", "value").agg(F.min(F.struct("id", "start")).alias("f"))
    rows = entries.join(first, ["vault", "value"]).withColumn("nth", F.row_number().over(Window.partitionBy("vault").orderBy("f")))
    line = F.concat(F.lit("  "), "token", F.lit(" ("), M.mask_sample(F.col("value")), F.when(F.col("f.id") % 2 == 0, ", from your task)").otherwise(", seen on the page)"))
    out = rows.groupBy("vault").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("nth") <= most, F.struct("nth", line.alias("line"))))).alias("lines"))
    return out.select("vault", F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.when(F.col("n") > most, F.concat(F.lit("\n  (+"), (F.col("n") - most).cast("string"), F.lit(" more)"))).otherwise("")).alias("legend"))


query("agg14_token_legend", lambda s, d: legends(*_prompted(s, d)[1:3]), _PROMPT_SQL + """, l AS (SELECT v.vault, v.token, row_number() OVER (PARTITION BY v.vault ORDER BY f.id, f.start) AS nth, f.id AS fid, v.value FROM vault v JOIN firsts f ON f.vault = v.vault AND f.value = v.value)
 SELECT vault, string_agg('  ' || token || ' (' || """ + _MASK_SQL.format(v="value") + """ || CASE WHEN fid % 2 = 0 THEN ', from your task)' ELSE ', seen on the page)' END, chr(10) ORDER BY nth) FILTER (nth <= 8) || CASE WHEN count(*) > 8 THEN chr(10) || '  (+' || (count(*) - 8)::VARCHAR || ' more)' ELSE '' END AS legend FROM l GROUP BY vault""")

# --- values of a vault in what is read again -------------------------------------------
# A small vault, as it stands after a task.
_OWN = (("Anita Rao", "<PII_1>"), ("a.b@x.example", "<CRED_1>"), ("4111 1111 1111 1111", "<CRED_2>"), ("+91 98765 43210", "<CRED_3>"), ("mail", "<CRED_4>"), ("Rao", "<PII_2>"), ("Acme Trading", "<PII_3>"))
_ENTRIES = F.array(*(F.struct(F.lit(v).alias("value"), F.lit(t).alias("token")) for v, t in _OWN))
_ECHO = "SELECT o_orderkey AS id, CASE o_orderkey % 10 WHEN 0 THEN 'Anita Rao wrote to a.b@x.example' WHEN 1 THEN 'paid with 4111-1111-1111-1111.' WHEN 2 THEN 'Gmail and mail, (mail)' WHEN 3 THEN 'call 919876543210 or 91/98765-43210' WHEN 4 THEN 'Anita Raoji' WHEN 5 THEN 'Acme Trading; Acme Trading' WHEN 6 THEN 'nothing ' || CAST(o_orderkey AS STRING) WHEN 7 THEN '14111 1111 1111 11112' WHEN 8 THEN 'Rao a.b@x.examples' ELSE 'mailAnita Rao' END AS text, CASE o_orderkey % 3 WHEN 0 THEN 'Anita Rao' WHEN 1 THEN 'Gmail' END AS value, CASE o_orderkey % 4 WHEN 0 THEN 'To Acme Trading' ELSE 'Search' END AS name FROM {orders}"
_EDGE = r"[^\p{L}\p{M}]"


def _put_sql(text, value, token):
    v = value.replace("'", "''")
    if all(c.isalpha() or c == " " for c in value):
        return f"regexp_replace(regexp_replace({text}, '(^|{_EDGE}){v}($|{_EDGE})', '\\1{token}\\2', 'g'), '(^|{_EDGE}){v}($|{_EDGE})', '\\1{token}\\2', 'g')"
    return f"replace({text}, '{v}', '{token}')"


def _sweep_query(columns, digits):
    """SQL of columns swept one entry after the other."""
    out, ends = f"SELECT * FROM ({X.plain(_ECHO)})", {}
    entries = sorted((e for e in _OWN if len(e[0]) >= 4), key=lambda e: (-len(e[0]), e[0]))
    for c in columns:
        at = c
        for i, (v, t) in enumerate(entries):
            bare = "".join(x for x in v if x.isdigit())
            loose = at if not digits or len(bare) < 6 else f"regexp_replace({at}, '(^|[^0-9])" + r"[\s\-._/]?".join(bare) + r"[\s\-._/]?" + f"($|[^0-9])', '\\1{t}\\2', 'g')"
            out = f"SELECT *, CASE WHEN contains({at}, '{v}') THEN {_put_sql(at, v, t)} ELSE {loose} END AS {c}_{i} FROM ({out})"
            at = f"{c}_{i}"
        ends[c] = at
    return f"SELECT id, {', '.join(f'{e} AS {c}' for c, e in ends.items())} FROM ({out})"


query("str06_redact_values", lambda s, d: X.frame(s, d, _ECHO).select("id", V.swept(T, _ENTRIES, True).alias("text")), _sweep_query(["text"], True))
query("str07_sweep_snapshot", lambda s, d: X.frame(s, d, _ECHO).select("id", *(V.swept(F.col(c), _ENTRIES).alias(c) for c in ("text", "value", "name"))), _sweep_query(["text", "value", "name"], False))
_BOUND = "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'Anita Rao' WHEN 1 THEN 'a.b+c@x.example' WHEN 2 THEN '(x|y)*[z]' WHEN 3 THEN 'Émile' ELSE c_name END AS text FROM {customer}"
_ESCAPED = F.regexp_replace(T, r"([.*+?^$\{}()|\[\]\\])", r"\\$1")
scalar("str05_bounded_pattern", _BOUND, pattern=(F.when(V.letters_only(T), F.concat(F.lit(f"(^|{_EDGE})"), _ESCAPED, F.lit(f"(?=$|{_EDGE})"))).otherwise(_ESCAPED), f"CASE WHEN regexp_full_match(text, '[\\p{{L}}\\p{{M}} ]+') THEN '(^|{_EDGE})' ELSE '' END || regexp_replace(text, '([.*+?^$' || chr(123) || chr(125) || '()|\\[\\]\\\\])', '\\\\\\1', 'g') || CASE WHEN regexp_full_match(text, '[\\p{{L}}\\p{{M}} ]+') THEN '(?=$|{_EDGE})' ELSE '' END"))
_WE = r"[^\p{L}\p{M}0-9_]"
_MEMORY = "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Typed ANITA RAO, then anita rao.' WHEN 1 THEN 'Gmail mail_box mail' WHEN 2 THEN 'x+y (x+y)' ELSE 'no ' || CAST(o_orderkey AS STRING) END AS text, CASE o_orderkey % 5 WHEN 0 THEN 'Anita Rao' WHEN 1 THEN 'mail' ELSE 'x+y' END AS value FROM {orders}"
scalar("str20_mask_value", _MEMORY, masked=(V.mask_word(T, F.col("value"), "[typed]"), f"regexp_replace(regexp_replace(text, '(?i)(^|{_WE})' || regexp_escape(value) || '($|{_WE})', '\\1[typed]\\2', 'g'), '(?i)(^|{_WE})' || regexp_escape(value) || '($|{_WE})', '\\1[typed]\\2', 'g')"))
_STEPS = "SELECT event_id AS id, user_id AS run, CASE event_id % 4 WHEN 0 THEN 'type' WHEN 1 THEN 'type_text' WHEN 2 THEN 'click' ELSE NULL END AS action, CASE event_id % 7 WHEN 0 THEN 'Typed \"Anita Rao\" into x' WHEN 1 THEN 'Typed \"anita rao \" into y' WHEN 2 THEN 'Typed \"<CRED_1>\" z' WHEN 3 THEN 'Typed \"ab\" q' WHEN 4 THEN 'Clicked \"Anita\"' WHEN 5 THEN 'Typed \"say ' || chr(92) || '\"hi' || chr(92) || '\" ' || event_type || '\" w' ELSE 'Typed \"v' || CAST(event_id % 50 AS STRING) || ' word\"' END AS text FROM {events}"
_TYPED = r'^Typed ("(?:[^"\\]|\\.)*")'


def typed_values(steps):
    """run, value of what was typed, once in any case: the first spelling of each, three to 80 characters, no tokens."""
    quoted = F.regexp_extract("text", _TYPED, 1)
    value = F.trim(F.get_json_object(F.concat(F.lit('{"v":'), quoted, F.lit("}")), "$.v"))
    rows = steps.filter(F.col("action").isin("type", "type_text")).withColumn("value", value).filter(F.length("value").between(3, 80) & ~F.col("value").rlike(r"^<[A-Z]+_[0-9]+>$"))
    return rows.groupBy("run", F.lower("value").alias("low")).agg(F.min_by("value", "id").alias("value"), F.min("id").alias("first")).select("run", "value", "first")


query("set06_typed_values", lambda s, d: typed_values(X.frame(s, d, _STEPS)), f"""SELECT run, arg_min(value, id) AS value, min(id) AS first FROM (SELECT *, trim(json_extract_string('{{"v":' || nullif(regexp_extract(text, '{_TYPED}', 1), '') || '}}', '$.v')) AS value FROM ({X.plain(_STEPS)}) WHERE action IN ('type', 'type_text')) WHERE length(value) BETWEEN 3 AND 80 AND NOT regexp_full_match(value, '<[A-Z]+_[0-9]+>') GROUP BY run, lower(value)""")
_INPUTS = "SELECT o_orderkey AS id, k, CASE k WHEN 'text' THEN CASE o_orderkey % 4 WHEN 0 THEN '7<CRED_1>' WHEN 1 THEN 'to <PII_2> and CRED_3' WHEN 2 THEN '<KEY_9> unknown' ELSE 'plain' END WHEN 'url' THEN 'https://h/<ID_1>' ELSE CAST(o_orderkey AS STRING) END AS text FROM {orders} CROSS JOIN (SELECT 'text' AS k UNION ALL SELECT 'url' UNION ALL SELECT 'n') f WHERE o_orderkey % 20 < 4"


def resolved_inputs(inputs, entries):
    """Every field of an action with its tokens repaired and written as values."""
    rows = inputs.select(F.struct("id", "k").alias("key"), M.repair_tokens(T).alias("text"))
    return V.resolved(rows, entries, "key").select("key.id", "key.k", "text")


query("str53_resolve_fields", lambda s, d: resolved_inputs(X.frame(s, d, _INPUTS), V.small_vault(s)), f"""WITH fx AS (SELECT id, k, regexp_replace(regexp_replace(text, '(^|[^A-Za-z0-9])[0-9]+<([A-Z]+_[0-9]+)>', '\\1<\\2>', 'g'), '<([A-Z]+_[0-9]+)>[0-9]+([^A-Za-z0-9]|$)', '<\\1>\\2', 'g') AS text FROM ({X.plain(_INPUTS)})), v AS (SELECT p || '_' || i::VARCHAR AS name, lower(p) || ' value ' || i::VARCHAR AS original FROM (VALUES ('CRED'), ('PII'), ('ID'), ('KEY')) AS a(p), range(1, 5) AS b(i)),
  parts AS (SELECT *, regexp_extract_all(text, '<[A-Z]+_[0-9]+>|\\b[A-Z]+_[0-9]+\\b') AS wholes, string_split_regex(text, '<[A-Z]+_[0-9]+>|\\b[A-Z]+_[0-9]+\\b') AS gaps FROM fx), rows AS (SELECT id, k, n, gaps[n] AS gap, wholes[n] AS whole FROM (SELECT *, unnest(range(1, len(gaps) + 1)) AS n FROM parts))
  SELECT id, k, string_agg(gap || coalesce(v.original, whole, ''), '' ORDER BY n) AS text FROM rows r LEFT JOIN v ON v.name = trim(r.whole, '<>') GROUP BY id, k""")

# --- snapshots ---------------------------------------------------------------------------
_SNAPS = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Anita Rao' WHEN 1 THEN 'pin 4321' WHEN 2 THEN '<CRED_9>' ELSE NULL END AS element, CASE o_orderkey % 5 WHEN 0 THEN 'Anita Rao, Anita Raoji and 4321' WHEN 1 THEN 'key sk-1.2 here' WHEN 2 THEN '' ELSE 'Anita Rao sk-1.2 4321' END AS text, CASE o_orderkey % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'face' ELSE 'pii_text' END AS k1, CASE o_orderkey % 7 WHEN 0 THEN NULL ELSE 'Anita Rao' END AS v1, o_orderkey % 2 = 0 AS h1, CASE o_orderkey % 4 WHEN 0 THEN 'api_key' ELSE 'email' END AS k2, CASE o_orderkey % 6 WHEN 0 THEN '<ID_1>' WHEN 1 THEN '4321' ELSE 'sk-1.2' END AS v2, o_orderkey % 3 = 0 AS h2 FROM {orders}"
_FOUND = F.array(*(F.struct(F.col(f"k{i}").alias("kind"), F.col(f"v{i}").alias("value"), F.col(f"h{i}").alias("here")) for i in (1, 2)))
query("str04_write_detections", lambda s, d: X.frame(s, d, _SNAPS).withColumn("w", V.detections_written(F.col("element"), T, _FOUND)).select("id", "w.element", "w.text", "w.n"), rf"""
WITH a AS (SELECT *, coalesce(v1, '') <> '' AND k1 <> 'face' AS ok1, v2 <> '<ID_1>' AS ok2, CASE k2 WHEN 'api_key' THEN '<KEY_1>' ELSE '<CRED_1>' END AS t2 FROM ({X.plain(_SNAPS)})),
b AS (SELECT *, CASE WHEN ok1 AND h1 AND contains(element, v1) THEN regexp_replace(element, '(^|{_EDGE})Anita Rao($|{_EDGE})', '\1<PII_1>\2', 'g') ELSE element END AS e1, CASE WHEN ok1 THEN regexp_replace(text, '(^|{_EDGE})Anita Rao($|{_EDGE})', '\1<PII_1>\2', 'g') ELSE text END AS x1 FROM a),
c AS (SELECT *, CASE WHEN ok2 AND h2 AND contains(e1, v2) AND NOT regexp_full_match(e1, '<[A-Z]+_[0-9]+>') THEN replace(e1, v2, t2) ELSE e1 END AS e2, CASE WHEN ok2 THEN replace(x1, v2, t2) ELSE x1 END AS x2 FROM b)
SELECT id, e2 AS element, x2 AS text, (e1 IS DISTINCT FROM element OR x1 <> text)::INT + (e2 IS DISTINCT FROM e1 OR x2 <> x1)::INT AS n FROM c""")
_TASK_VALUE = "Dr. Maria Lopez"


def sanitised(elements, task, suppressed=("organization:contextual", "api_key:regex")):
    """A row for each control with what is shown of its value, and why.

    Findings by rule come first; findings by field only for controls that have none.
    Kinds that were learned to be false are passed over, and so are values that the
    task itself gave; what is left is written as a token, numbered by prefix in a page.
    """
    from .policy import _SQUEEZE, owned

    prefix = F.when(F.col("kind").isin("person", "organization", "address"), "PII").when(F.col("kind") == "api_key", "KEY").otherwise("CRED")
    rule = G.dom_detections(elements).select("id", "kind", F.lit("regex").alias("method"))
    field = R.contextual(elements).select("id", "kind", F.lit("contextual").alias("method"))
    told = F.concat_ws(":", "kind", "method").isin(*suppressed)
    kept = rule.filter(~told)
    every = kept.unionByName(field.filter(~told).join(kept.select("id").distinct(), "id", "left_anti"))
    first = every.groupBy("id").agg(F.min(F.struct(F.col("method") != "regex", "kind", "method")).alias("f")).select("id", "f.kind", "f.method")
    rows = elements.join(first, "id", "left").withColumn("own", F.coalesce(owned(_SQUEEZE(F.col("value")), _SQUEEZE(F.lit(task))), F.lit(False)))
    hit = F.col("kind").isNotNull() & ~F.col("own") & F.col("value").isNotNull()
    n = F.dense_rank().over(Window.partitionBy("page_id", F.when(hit, prefix)).orderBy("value"))
    return rows.select("id", "page_id", "kind", "method", "own", F.when(hit, F.concat(F.lit("<"), prefix, F.lit("_"), n.cast("string"), F.lit(">"))).otherwise(F.col("value")).alias("value"))


query("joi16_sanitise_pages", lambda s, d: sanitised(X.frame(s, d, R.CONTROLS), f"write to {_TASK_VALUE} today"), f"""
WITH rule AS (SELECT id, kind, 'regex' AS method FROM ({G._DOM_SQL.replace(X.plain(X.ELEMENTS), X.plain(R.CONTROLS))}) WHERE kind <> 'api_key'), ctx AS (SELECT id, kind, 'contextual' AS method FROM ({R._context_sql()} SELECT * FROM f) WHERE kind <> 'organization'),
e AS (SELECT * FROM rule UNION ALL SELECT * FROM ctx WHERE id NOT IN (SELECT id FROM rule)), f AS (SELECT id, min((method <> 'regex', kind, method)) AS f FROM e GROUP BY id),
r AS (SELECT x.*, f.f[2] AS kind, f.f[3] AS method, coalesce(value = '{_TASK_VALUE}', false) AS own FROM ({X.plain(R.CONTROLS)}) x LEFT JOIN f ON f.id = x.id),
p AS (SELECT *, kind IS NOT NULL AND NOT own AND value IS NOT NULL AS hit, CASE WHEN kind IN ('person', 'organization', 'address') THEN 'PII' WHEN kind = 'api_key' THEN 'KEY' ELSE 'CRED' END AS prefix FROM r)
SELECT id, page_id, kind, method, own, CASE WHEN hit THEN '<' || prefix || '_' || (dense_rank() OVER (PARTITION BY page_id, CASE WHEN hit THEN prefix END ORDER BY value NULLS FIRST))::VARCHAR || '>' ELSE value END AS value FROM p""")
