"""Queries of span extraction and of what is done with spans."""

from __future__ import annotations

from pyspark.sql import functions as _functions
from pyspark.sql.window import Window

from ..catalog import query, scalar
from ..functions import checksums as _checksums
from ..functions import duck as D
from ..functions import masks as _masks
from ..functions import patterns as P
from ..operators import spans as _spans
from ..operators import vault as _vault
from ..functions.deferred import DeferredModule
from . import fixtures as X

F = DeferredModule(_functions)
C = DeferredModule(_checksums)
M = DeferredModule(_masks)
S = DeferredModule(_spans)
V = DeferredModule(_vault)

T = F.col("text")
#: The other engine knows no lookaround: the neighbours are matched, the value is a group.
_PHONE_SQL = r"(?:^|[^0-9])((?:\+91[\s-]?)?[6-9]\d{4}[\s-]?\d{5})(?:$|[^0-9])"


def _texts(sql):
    return lambda s, d: X.frame(s, d, sql)


def _matcher(name, source, group=0, sql_source=None, sql_group=None, fixture=X.TEXTS, check=None, check_sql="true"):
    """A query of the spans of one pattern."""

    def build(s, d):
        found = S.matches(T, source, group)
        if check:
            found = F.filter(found, lambda x: check(x["value"]))
        return X.frame(s, d, fixture).select("id", F.inline(found)).select("id", "value", "start")

    query(name, build, f"WITH fx AS ({X.plain(fixture)}) SELECT id, value, start FROM ({D.spans(sql_source or source, group if sql_group is None else sql_group, 'fx')}) WHERE {check_sql}")


_matcher("fil01_email", "(?i)" + P.EMAIL)
_matcher("fil02_phone", P.PHONE, sql_source=_PHONE_SQL, sql_group=1)
_matcher("fil03_honorific_name", P.HONORIFIC_NAME)
_matcher("fil04_cue_name", P.CUE_NAME, 1)


def _union(parts):
    return " UNION ALL ".join(parts)


def _tagged_sql(ord_, kind, label, source, group=0, where="value <> ''", src="fx"):
    return f"SELECT id, {ord_} AS emit_ord, '{kind}' AS kind, '{label}' AS label, start, start + length(value) AS \"end\", value FROM ({D.spans(source, group, src)}) WHERE {where}"


_KEYS_SQL = [_tagged_sql(20 + i, "api_key", label, p) for i, (p, label) in enumerate(P.API_KEYS)]
_CHECKS = {"aadhaar": D.aadhaar("value"), "card": D.luhn("value"), None: "true"}
_IDS_SQL = [_tagged_sql(10 + i, "id_text", label, p, where=_CHECKS[c]) for i, (p, label, c) in enumerate(P.ID_SHAPES)]
_CUED_SQL = [_tagged_sql(40 + i, "credential", label, p, 1, "value <> ''" if label == "OTP code" else f"value <> '' AND {D.secret('value')}") for i, (p, label) in enumerate(P.CUED)]
_ALL_SQL = _union([
    _tagged_sql(0, "email", "Email address", "(?i)" + P.EMAIL), _tagged_sql(1, "phone", "Phone number", _PHONE_SQL, 1), _tagged_sql(2, "name_text", "Person name", P.HONORIFIC_NAME),
    *_IDS_SQL, *_KEYS_SQL, *_CUED_SQL, _tagged_sql(50, "name_text", "Person name", P.CUE_NAME, 1),
])


def _kept_sql(fixture, every=_ALL_SQL):
    return f"""WITH fx AS (SELECT id, text FROM ({X.plain(fixture)}) WHERE length(text) >= 6), every_span AS ({every}), kept AS (
  SELECT * FROM (SELECT *, max("end") OVER (PARTITION BY id ORDER BY start, "end" DESC, emit_ord, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM every_span) WHERE reach IS NULL OR "end" > reach)"""


query("fil05_api_keys", lambda s, d: X.frame(s, d, X.TEXTS).select("id", F.inline(F.concat(*(S._tagged(S.matches(T, p), "api_key", label, 20 + i) for i, (p, label) in enumerate(P.API_KEYS))))), f"WITH fx AS ({X.plain(X.TEXTS)}) {_union(_KEYS_SQL)}")
_matcher("fil06_aadhaar_shape", P.ID_SHAPES[0][0], check=C.is_aadhaar, check_sql=D.aadhaar("value"))
_matcher("fil06_card_shape", P.ID_SHAPES[4][0], check=C.is_card, check_sql=D.luhn("value"))
query("fil06_id_shapes", lambda s, d: X.frame(s, d, X.TEXTS).select("id", F.inline(F.concat(*(S._tagged(S.passing(S.matches(T, p), {"aadhaar": C.is_aadhaar, "card": C.is_card}[c]) if c else S.matches(T, p), "id_text", label, 10 + i) for i, (p, label, c) in enumerate(P.ID_SHAPES))))), f"WITH fx AS ({X.plain(X.TEXTS)}) {_union(_IDS_SQL)}")
query("fil08_cued_secrets", lambda s, d: X.frame(s, d, X.TEXTS).select("id", F.inline(S.cued_secrets(T, 40))), f"WITH fx AS ({X.plain(X.TEXTS)}) {_union(_CUED_SQL)}")
query("fil09_match_pii", lambda s, d: S.match_pii(X.frame(s, d, X.TEXTS)), _kept_sql(X.TEXTS) + ' SELECT id, emit_ord, kind, label, start, "end", value FROM kept')

# the looser value detector: checksum failures become rejected rows, contained values stay
_DETAIL = [
    *[(p, "id_number", label, c, 0) for p, label, c in P.DETAIL_IDS], *[(p, "api_key", label, None, 0) for p, label in P.API_KEYS],
    (P.HONORIFIC_NAME, "pii_text", "Person name", None, 0), (P.CUE_NAME, "pii_text", "Person name", None, 1),
    (P.DETAIL_CARD, "credential", "Card number (Luhn valid)", "card", 0), ("(?i)" + P.EMAIL, "credential", "Email address", None, 0), (P.PHONE, "credential", "Phone number", None, 0),
]


def _judged(spans, kind, label, ok):
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), x["value"].alias("value"), ok(x["value"]).alias("ok")))


def _detail(frame):
    cued = F.transform(S.cued_secrets(T), lambda x: F.struct(x["kind"].alias("kind"), x["label"].alias("label"), x["value"].alias("value"), F.lit(True).alias("ok")))
    rows = [cued]
    for p, kind, label, c, g in _DETAIL:
        ok = {"aadhaar": C.is_aadhaar, "card": C.is_card}.get(c, lambda v: F.lit(True))
        rows.append(_judged(F.filter(S.matches(T, p, g), lambda x: x["value"] != ""), kind, label, ok))
    out = frame.select("id", F.inline(F.concat(*rows)))
    return out.select("id", "kind", F.when(F.col("ok"), F.col("label")).otherwise(F.concat("label", F.lit(" lookalike (checksum failed)"))).alias("label"), "value", F.when(~F.col("ok"), 0.15).when(F.col("kind") == "credential", 0.9).otherwise(0.7).alias("confidence"), F.col("ok").alias("detected"))


def _detail_sql(fixture):
    parts = [f"SELECT id, 'credential' AS kind, label, value, true AS ok FROM ({_union(_CUED_SQL)})"]
    for p, kind, label, c, g in _DETAIL:
        p, g = (_PHONE_SQL, 1) if p == P.PHONE else (p, g)
        parts.append(f"SELECT id, '{kind}', '{label}', value, {_CHECKS[c]} FROM ({D.spans(p, g, 'fx')}) WHERE value <> ''")
    return f"WITH fx AS ({X.plain(fixture)}), r AS ({_union(parts)}) SELECT id, kind, CASE WHEN ok THEN label ELSE label || ' lookalike (checksum failed)' END AS label, value, CASE WHEN NOT ok THEN 0.15 WHEN kind = 'credential' THEN 0.9 ELSE 0.7 END AS confidence, ok AS detected FROM r"


query("fil10_detect_text", lambda s, d: _detail(X.frame(s, d, X.TEXTS)), _detail_sql(X.TEXTS))
#: Matchers over the notes, and by a second name over the notes and every document.
_OVER = (("", X.NOTES), ("_texts", X.TEXTS))
for _end, _fixture in _OVER:
    query("fil13_detections_only" + _end, lambda s, d, fx=_fixture: _detail(X.frame(s, d, fx)).filter("detected").drop("detected"), f"SELECT id, kind, label, value, confidence FROM ({_detail_sql(_fixture)}) WHERE detected")

scalar("fil25_reread_labels", X.TEXTS, labels=(
    F.concat_ws(",", *(F.when(T.rlike(P.gate(p)), F.when(T.rlike(P.java(p)), F.lit(label))) for p, label in P.VERIFY)),
    "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, {D.text(p)}) THEN '{label}' END" for p, label in P.VERIFY) + ")",
))
# Shapes of identifiers, with or without separators.
_CARDISH, _AADHAARISH, _PAN = r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)", r"(?<!\d)\d{4}[ -]?\d{4}[ -]?\d{4}(?!\d)", r"\b[A-Z]{5}\d{4}[A-Z]\b"


def identifier(text):
    """The first kind of valid identifier in text."""
    found = lambda p, ok: F.exists(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda v: ok(v))
    return F.when(found(_CARDISH, C.is_card), "Card number").when(found(_AADHAARISH, C.is_aadhaar), "Aadhaar number").when(text.rlike(P.java(_PAN)), "PAN number")


_IDENT_SQL = rf"""CASE WHEN len(list_filter(regexp_extract_all(text, '(?:^|[^0-9])((?:\d[ -]?){{12,18}}\d)(?:$|[^0-9])', 1), lambda v: {D.luhn('v')})) > 0 THEN 'Card number'
  WHEN len(list_filter(regexp_extract_all(text, '(?:^|[^0-9])(\d{{4}}[ -]?\d{{4}}[ -]?\d{{4}})(?:$|[^0-9])', 1), lambda v: {D.aadhaar('v')})) > 0 THEN 'Aadhaar number'
  WHEN regexp_matches(text, '\b[A-Z]{{5}}\d{{4}}[A-Z]\b') THEN 'PAN number' END"""
_TYPED = F.coalesce(*(F.when(T.rlike(P.java(p)), F.lit(label)) for p, label in P.TYPED_VALUES))
_TYPED_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, {D.text(p)}) THEN '{label}'" for p, label in P.TYPED_VALUES) + " END"
for _end, _fixture in _OVER:
    scalar("fil26_matched_identifier" + _end, _fixture, label=(identifier(T), _IDENT_SQL))
scalar("fil27_typed_value_shape", X.NOTES.replace("'token: ghp_'", "'ghp_'").replace("' and eyJ", "' eyJ"), label=(_TYPED, _TYPED_SQL))
scalar("fil30_refuse_typed", X.VALUES, verdict=(F.when(F.coalesce(_TYPED, identifier(T)).isNotNull(), "refuse"), f"CASE WHEN coalesce({_TYPED_SQL}, {_IDENT_SQL}) IS NOT NULL THEN 'refuse' END"), label=(F.coalesce(_TYPED, identifier(T)), f"coalesce({_TYPED_SQL}, {_IDENT_SQL})"))

# splicing: placeholders by kind, or vault tokens
# Placeholders of scrubbed memories.
PLACEHOLDERS = {"email": "[email]", "phone": "[phone]", "id_text": "[id]", "name_text": "[name]", "api_key": "[key]", "credential": "[secret]"}


def scrubbed(text):
    names = F.create_map(*(F.lit(x) for kv in PLACEHOLDERS.items() for x in kv))
    return F.when(F.length(text) >= 6, S.spliced(text, S.resolved(text), lambda s: F.element_at(names, s["kind"]))).otherwise(text)


_SPLICE = """ , pieces AS (
  SELECT id, start, "end", value, kind, label, coalesce(max("end") OVER (PARTITION BY id ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, {write} AS w FROM kept
), done AS (
  SELECT p.id, string_agg(substr(f.text, pos + 1, greatest(start - pos, 0)) || w, '' ORDER BY start, "end" DESC) AS head, max("end") AS last FROM pieces p JOIN fx f USING (id) GROUP BY p.id
) SELECT a.id, CASE WHEN d.id IS NULL THEN a.text ELSE d.head || substr(a.text, d.last + 1) END AS {name} FROM ({fixture}) a LEFT JOIN done d USING (id)"""
query("str19_scrub_memory", lambda s, d: X.frame(s, d, X.TEXTS).select("id", scrubbed(T).alias("scrubbed")), _kept_sql(X.TEXTS) + _SPLICE.format(write="CASE kind " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PLACEHOLDERS.items()) + " END", name="scrubbed", fixture=X.plain(X.TEXTS)))

# the vault: a value's first sighting fixes its kind; numbers run by prefix within a vault (here: 1000 ids)
_VAULT_SQL = """ , sights AS (
  SELECT id // 1000 AS vault, id, start, value, CASE WHEN kind = 'name_text' THEN 'PII' WHEN kind IN ('email', 'phone', 'credential') THEN 'CRED' WHEN kind = 'api_key' THEN 'KEY' WHEN regexp_matches(label, '(?i)card|ssn') THEN 'CRED' ELSE 'ID' END AS prefix FROM kept
), firsts AS (
  SELECT vault, value, prefix, id, start FROM (SELECT *, row_number() OVER (PARTITION BY vault, value ORDER BY id, start) AS r FROM sights) WHERE r = 1
), vault AS (
  SELECT vault, value, '<' || prefix || '_' || (row_number() OVER (PARTITION BY vault, prefix ORDER BY id, start))::VARCHAR || '>' AS token, prefix FROM firsts
)"""
query("win01_vault", lambda s, d: V.vault(S.match_pii(X.frame(s, d, X.TEXTS)).withColumn("vault", F.expr("id div 1000"))).select("vault", "value", "token"), _kept_sql(X.TEXTS) + _VAULT_SQL + " SELECT vault, value, token FROM vault")


def _tokenized(s, d, fixture):
    texts = X.frame(s, d, fixture)
    found = S.match_pii(texts).withColumn("vault", F.expr("id div 1000"))
    return V.tokenized(texts, found, V.vault(found))


_TOKEN_SPLICE = """ , pieces AS (
  SELECT k.id, k.start, k."end", v.token AS w, coalesce(max(k."end") OVER (PARTITION BY k.id ORDER BY k.start, k."end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM kept k JOIN vault v ON v.vault = k.id // 1000 AND v.value = k.value
), done AS (
  SELECT p.id, string_agg(substr(f.text, pos + 1, greatest(start - pos, 0)) || w, '' ORDER BY start, "end" DESC) AS head, max("end") AS last, count(*) AS n FROM pieces p JOIN fx f USING (id) GROUP BY p.id
) SELECT a.id, CASE WHEN d.id IS NULL THEN a.text ELSE d.head || substr(a.text, d.last + 1) END AS sanitized, coalesce(n, 0) AS n_tokens FROM ({fixture}) a LEFT JOIN done d USING (id)"""
query("str17_sanitize_text", lambda s, d: _tokenized(s, d, X.TEXTS), _kept_sql(X.TEXTS) + _VAULT_SQL + _TOKEN_SPLICE.format(fixture=X.plain(X.TEXTS)))
for _end, _fixture in _OVER:
    query("agg13_token_summary" + _end, lambda s, d, fx=_fixture: V.vault(S.match_pii(X.frame(s, d, fx)).withColumn("vault", F.expr("id div 1000"))).select("vault", "token", M.mask_alnum(F.col("value")).alias("sample")), _kept_sql(_fixture) + _VAULT_SQL + " SELECT vault, token, regexp_replace(value, '[A-Za-z0-9]', '•', 'g') AS sample FROM vault")
query("str09_resolve", lambda s, d: X.frame(s, d, X.TOKENED).select("id", F.explode(F.regexp_extract_all("text", F.lit("<([A-Z]+)_([0-9]+)>"), F.lit(0))).alias("token")).join(F.broadcast(V.small_vault(s)), "token", "left"), f"WITH fx AS ({X.plain(X.TOKENED)}), v AS (SELECT '<' || p || '_' || i::VARCHAR || '>' AS token, lower(p) || ' value ' || i::VARCHAR AS original FROM (VALUES ('CRED'), ('PII'), ('ID'), ('KEY')) AS a(p), range(1, 5) AS b(i)) SELECT id, f.token, original FROM (SELECT id, unnest(regexp_extract_all(text, '<[A-Z]+_[0-9]+>')) AS token FROM fx) f LEFT JOIN v ON v.token = f.token")
query("str08_resolve_all", lambda s, d: V.resolved(X.frame(s, d, X.TOKENED), V.small_vault(s)), f"""WITH fx AS ({X.plain(X.TOKENED)}), v AS (SELECT p || '_' || i::VARCHAR AS name, lower(p) || ' value ' || i::VARCHAR AS original FROM (VALUES ('CRED'), ('PII'), ('ID'), ('KEY')) AS a(p), range(1, 5) AS b(i)),
  parts AS (SELECT id, text, wholes, string_split_regex(text, '<[A-Z]+_[0-9]+>|\\b[A-Z]+_[0-9]+\\b') AS gaps FROM (SELECT id, text, regexp_extract_all(text, '<[A-Z]+_[0-9]+>|\\b[A-Z]+_[0-9]+\\b') AS wholes FROM fx)),
  rows AS (SELECT id, n, gaps[n] AS gap, wholes[n] AS whole FROM (SELECT *, unnest(range(1, len(gaps) + 1)) AS n FROM parts))
  SELECT id, string_agg(gap || coalesce(v.original, whole, ''), '' ORDER BY n) AS text FROM rows r LEFT JOIN v ON v.name = trim(r.whole, '<>') GROUP BY id""")
_ORIGINALS = "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'cred value ' || CAST(o_orderkey % 7 AS STRING) WHEN 1 THEN 'key value ' || CAST(o_orderkey % 7 AS STRING) WHEN 2 THEN 'Cred value 1' WHEN 3 THEN ' id value 2' ELSE 'pii value 3' END AS text FROM {orders}"
query("joi10_find_token", lambda s, d: X.frame(s, d, _ORIGINALS).join(F.broadcast(V.small_vault(s)), F.col("text") == F.col("original"), "left").select("id", "token"), f"WITH v AS (SELECT '<' || p || '_' || i::VARCHAR || '>' AS token, lower(p) || ' value ' || i::VARCHAR AS original FROM (VALUES ('CRED'), ('PII'), ('ID'), ('KEY')) AS a(p), range(1, 5) AS b(i)) SELECT id, token FROM ({X.plain(_ORIGINALS)}) f LEFT JOIN v ON v.original = f.text")

# leaks in what was sent: tokens are blanked, the rest is matched again
for _end, _fixture in _OVER:
    _sent = _fixture.replace("END AS text", "END || ' <CRED_1> <A1_2>' AS text")
    query("led14_scan_for_leaks" + _end, lambda s, d, fx=_sent: S.match_pii(X.frame(s, d, fx).withColumn("text", F.regexp_replace("text", P.WIRE_TOKEN, " "))).select("id", "label", M.mask_sample(F.col("value")).alias("sample")),
          _kept_sql(f"SELECT id, regexp_replace(text, '<[A-Z][A-Z0-9]*_[0-9]+>', ' ', 'g') AS text FROM ({_sent})") + """ SELECT id, label, CASE
  WHEN strpos(value, '@') > 1 AND contains(value, '.') AND length(value) > strpos(value, '@') + 1 THEN left(split_part(value, '@', 1), 2) || '•••@' || substr(value, strpos(value, '@') + 1)
  WHEN regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]') AND length(regexp_replace(value, '[^A-Za-z0-9]', '', 'g')) >= 6 AND NOT regexp_matches(value, '\\s') THEN regexp_replace(value, '[A-Za-z0-9]', '•', 'g')
  WHEN length(regexp_replace(value, '[^0-9]', '', 'g')) >= 4 THEN regexp_replace(value, '[0-9]', '•', 'g')
  ELSE left(value, 2) || repeat('•', least(10, greatest(6, length(value) - 2))) END AS sample FROM kept""")

# degenerate output
def _words(frame):
    return frame.select("id", F.posexplode(M.words_of(T)).alias("pos", "word"))


def degeneration(frame):
    """Share of four-word windows seen again within 16 words of the last time."""
    w = Window.partitionBy("id").orderBy("pos")
    grams = _words(frame).select("id", "pos", F.concat_ws(" ", "word", *(F.lead("word", i).over(w) for i in (1, 2, 3))).alias("gram"), F.lead("word", 3).over(w).alias("last")).filter("last IS NOT NULL")
    again = grams.withColumn("gap", F.col("pos") - F.lag("pos").over(Window.partitionBy("id", "gram").orderBy("pos")))
    return again.groupBy("id").agg((F.count_if(F.col("gap") <= 16) / F.count(F.lit(1))).alias("ratio"))


_WORDS_SQL = "SELECT id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM fx)"
query("win05_degeneration_ratio", lambda s, d: degeneration(X.frame(s, d, X.DOCS)), f"""WITH fx AS ({X.plain(X.DOCS)}), w AS ({_WORDS_SQL}), g AS (
  SELECT id, pos, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o) AS gram, lead(word, 3) OVER o AS last FROM w WINDOW o AS (PARTITION BY id ORDER BY pos)
), a AS (SELECT id, pos - lag(pos) OVER (PARTITION BY id, gram ORDER BY pos) AS gap FROM g WHERE last IS NOT NULL) SELECT id, count(*) FILTER (gap <= 16) / count(*) AS ratio FROM a GROUP BY id""")


def repeated_block(frame, block=40, times=3):
    """Texts of 120 words and more in which some 40 words in a row come three times."""
    words = frame.select("id", M.words_of(T).alias("w")).filter(F.size("w") >= block * times)
    blocks = words.select("id", F.explode(F.sequence(F.lit(1), F.size("w") - block + 1)).alias("i"), "w").select("id", F.xxhash64(F.slice("w", F.col("i"), block)).alias("h"))
    hit = blocks.groupBy("id", "h").count().filter(F.col("count") >= times).select("id").distinct().withColumn("hit", F.lit(True))
    return frame.select("id").join(hit, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("repeats"))


query("win06_repeated_block", lambda s, d: repeated_block(X.frame(s, d, X.DOCS)), f"""WITH fx AS ({X.plain(X.DOCS)}), w AS (SELECT id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM fx),
  b AS (SELECT id, hash(w[i:i+39]) AS h FROM (SELECT id, w, unnest(range(1, len(w) - 38)) AS i FROM w WHERE len(w) >= 120)), r AS (SELECT DISTINCT id FROM (SELECT id FROM b GROUP BY id, h HAVING count(*) >= 3)) SELECT f.id, r.id IS NOT NULL AS repeats FROM fx f LEFT JOIN r ON r.id = f.id""")
