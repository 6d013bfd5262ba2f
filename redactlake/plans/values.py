"""Queries of scalar functions on values: checksums, masks, kinds, sizes."""

from __future__ import annotations

from pyspark.sql import functions as _functions

from ..catalog import query, scalar
from ..functions import checksums as _checksums
from ..functions import duck as D
from ..functions import masks as _masks
from ..functions import patterns as P
from ..operators import spans as _spans
from ..functions.deferred import DeferredModule
from . import fixtures as X

F = DeferredModule(_functions)
C = DeferredModule(_checksums)
M = DeferredModule(_masks)
S = DeferredModule(_spans)

T = F.col("text")

scalar("mth01_luhn_valid", X.NUMBERS, valid=(C.luhn_valid(T), D.luhn("text")))
scalar("mth02_luhn_check_digit", X.NUMBERS, digit=(C.luhn_check_digit(T), f"(10 - {D.luhn_sum(D.digits('text'), 0)} % 10) % 10"))
scalar("mth03_verhoeff_valid", X.NUMBERS, valid=(C.verhoeff_valid(T), f"{D.verhoeff(D.digits('text'), 0)} = 0"))
scalar("mth04_verhoeff_check_digit", X.NUMBERS, digit=(C.verhoeff_check_digit(T), f"substr('0432156789', {D.verhoeff(D.digits('text'), 1)} + 1, 1)::INT"))
scalar("mth05_is_aadhaar", X.NUMBERS, valid=(C.is_aadhaar(T), D.aadhaar("text")))
scalar("mth06_is_card", X.NUMBERS, valid=(C.is_card(T), D.luhn("text")))
scalar("mth07_is_indian_phone", X.VALUES, valid=(C.is_indian_phone(T), f"regexp_full_match({D.digits('text')}, '[6-9][0-9]{{9}}')"))
_FNV = "list_reduce(list_prepend({seed}::BIGINT, list_transform(range(length({x})), lambda i: ord(substr({x}, i + 1, 1))::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
scalar("mth08_fnv1a", X.VALUES, hash=(C.fnv1a(T), _FNV.format(seed=C.FNV_OFFSET, x="text")))
scalar("mth18_sha256", X.VALUES, digest=(F.sha2(T, 256), "sha256(text)"))
scalar("mth20_utf8_bytes", X.DOCS, n_bytes=(F.octet_length(T).cast("long"), "strlen(text)"))
scalar("str62_utf8_bytes", X.NOTES, n_bytes=(F.octet_length(T).cast("long"), "strlen(text)"))
_B = F.col("id") * 37 % 20000
scalar("mth21_format_bytes", X.VALUES, shown=(
    F.when(_B <= 0, "0 KB").when(_B < 1024, F.concat(_B.cast("string"), F.lit(" B"))).when(_B < 10240, F.concat((F.floor(_B * 10 / 1024 + 0.5) / 10).cast("decimal(10,1)").cast("string"), F.lit(" KB"))).otherwise(F.concat(F.floor(_B / 1024 + 0.5).cast("string"), F.lit(" KB"))),
    "CASE WHEN id * 37 % 20000 <= 0 THEN '0 KB' WHEN id * 37 % 20000 < 1024 THEN (id * 37 % 20000)::VARCHAR || ' B' WHEN id * 37 % 20000 < 10240 THEN (floor((id * 37 % 20000) * 10 / 1024 + 0.5) / 10)::DECIMAL(10,1)::VARCHAR || ' KB' ELSE floor((id * 37 % 20000) / 1024 + 0.5)::BIGINT::VARCHAR || ' KB' END",
))
_MS = F.col("id") * 131 % 30000
scalar("mth48_seconds_label", X.VALUES, shown=(
    F.when(_MS < 10000, F.concat((F.floor(_MS / 100 + 0.5) / 10).cast("decimal(10,1)").cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(_MS / 1000 + 0.5).cast("string"), F.lit("s"))),
    "CASE WHEN id * 131 % 30000 < 10000 THEN (floor((id * 131 % 30000) / 100 + 0.5) / 10)::DECIMAL(10,1)::VARCHAR || 's' ELSE floor((id * 131 % 30000) / 1000 + 0.5)::BIGINT::VARCHAR || 's' END",
))
scalar("mth24_round_confidence", X.VALUES, rounded=(F.floor((F.col("id") % 997) / 997 * 1000 + 0.5) / 1000, "floor((id % 997) / 997 * 1000 + 0.5) / 1000"))

# surrogates: values that pass the checksums and belong to nobody
_NUMBERS = X.plain(X.NUMBERS)
_HASHED = f"WITH a AS (SELECT *, {D.digits('text')} AS d FROM ({{fixture}})), b AS (SELECT *, {D.fnv('d')} AS h FROM a)"
_STAND = {k: f"'{v}'" for k, v in _checksums.STAND_INS.items()}
_CARD_BODY = f"substr(d, 1, 4) || {D.hash_digits('h', '0', 'length(d) - 5', 9, 3)}"
_AADHAAR_BODY = f"'99' || {D.hash_digits('h', '2', '11', 8, 7)}"
_MADE = f"SELECT *, {_CARD_BODY} AS cb, {_AADHAAR_BODY} AS ab FROM b"
_CARD_SQL = f"CASE WHEN length(d) >= 13 THEN {D.in_fours('cb || ((10 - ' + D.luhn_sum('cb', 0) + ' % 10) % 10)::VARCHAR')} ELSE {_STAND['card']} END"
_AADHAAR_SQL = f"CASE WHEN length(d) = 12 THEN {D.in_fours('ab || substr(' + chr(39) + '0432156789' + chr(39) + ', ' + D.verhoeff('ab', 1) + ' + 1, 1)')} ELSE {_STAND['aadhaar']} END"
query("mth09_card_surrogate", lambda s, d: X.frame(s, d, X.NUMBERS).select("id", C.card_surrogate(T).alias("surrogate")), _HASHED.format(fixture=_NUMBERS) + f" SELECT id, {_CARD_SQL} AS surrogate FROM ({_MADE})")
query("mth10_aadhaar_surrogate", lambda s, d: X.frame(s, d, X.NUMBERS).select("id", C.aadhaar_surrogate(T).alias("surrogate")), _HASHED.format(fixture=_NUMBERS) + f" SELECT id, {_AADHAAR_SQL} AS surrogate FROM ({_MADE})")
_NAMED = "SELECT o_orderkey AS id, CASE o_orderkey % 14 WHEN 0 THEN 'aadhaar' WHEN 1 THEN 'id_number' WHEN 2 THEN 'Credit_Card' WHEN 3 THEN 'pan_card' WHEN 4 THEN 'company' WHEN 5 THEN 'email' WHEN 6 THEN 'mobile' WHEN 7 THEN 'person' WHEN 8 THEN 'passport' WHEN 9 THEN 'api_key' WHEN 10 THEN 'cvv' WHEN 11 THEN 'token' WHEN 12 THEN 'otp' ELSE 'name_text' END AS kind, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN CAST(4000000000000000 + o_orderkey * 7919 AS STRING) ELSE CAST(200000000000 + o_orderkey * 104729 AS STRING) END AS text FROM {orders}"
_HOLDS = lambda *names: f"regexp_matches(lower(kind), '{'|'.join(names)}')"
query("mth11_surrogate_of_kind", lambda s, d: X.frame(s, d, _NAMED).select("id", "kind", C.surrogate_for(F.col("kind"), T).alias("surrogate")), _HASHED.format(fixture=f"SELECT id, kind, coalesce(text, '') AS text FROM ({X.plain(_NAMED)})") + " SELECT id, kind, " + D.case([
    (_HOLDS("aadhaar", "id_number", "national_id"), f"CASE WHEN text <> '' THEN {_AADHAAR_SQL} ELSE {_STAND['aadhaar']} END"), (_HOLDS("card", "credit", "cvv"), f"CASE WHEN text <> '' THEN {_CARD_SQL} ELSE {_STAND['card']} END"),
    (_HOLDS("pan"), _STAND["pan"]), (_HOLDS("email"), _STAND["email"]), (_HOLDS("phone", "mobile"), _STAND["phone"]), (_HOLDS("name", "person"), _STAND["name"]), (_HOLDS("pass", "token", "cred"), _STAND["secret"]),
], _STAND["other"]) + f" AS surrogate FROM ({_MADE})")
for _id, _kind in (("mth12", "aadhaar"), ("mth13", "card"), ("mth14", "pan"), ("mth15", "email"), ("mth16", "name"), ("mth17", "phone")):
    query(f"{_id}_{_kind}_stand_in", lambda s, d, k=_kind: s.range(1).select(C.stand_in(k).alias("surrogate")), f"SELECT {_STAND[_kind]} AS surrogate")

scalar("str12_mask_sample", X.VALUES, masked=(M.mask_sample(T), """CASE WHEN length(trim(text)) <= 2 THEN '••'
  WHEN strpos(trim(text), '@') > 1 AND contains(trim(text), '.') AND length(trim(text)) > strpos(trim(text), '@') + 1 THEN left(split_part(trim(text), '@', 1), 2) || '•••@' || substr(trim(text), strpos(trim(text), '@') + 1)
  WHEN regexp_matches(text, '[A-Za-z]') AND regexp_matches(text, '[0-9]') AND length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) >= 6 AND NOT regexp_matches(trim(text), '\\s') THEN regexp_replace(trim(text), '[A-Za-z0-9]', '•', 'g')
  WHEN length(regexp_replace(text, '[^0-9]', '', 'g')) >= 4 THEN regexp_replace(trim(text), '[0-9]', '•', 'g')
  ELSE left(trim(text), 2) || repeat('•', least(10, greatest(6, length(trim(text)) - 2))) END"""))
scalar("str13_mask_digits", X.VALUES, masked=(M.mask_digits(T), "regexp_replace(text, '\\d', '•', 'g')"))
scalar("str14_mask_alnum", X.VALUES, masked=(M.mask_alnum(T), "regexp_replace(text, '[[:alnum:]]', '•', 'g')"))
scalar("fil07_looks_like_secret", X.VALUES, secret=(S.looks_like_secret(T), D.secret("text")))
scalar("str10_contains_tokens", X.TOKENED, found=(M.has_token(T), "regexp_matches(text, '<[A-Z]+_[0-9]+>')"))
scalar("fil60_contains_vault_token", X.TOKENED, found=(M.has_token(T), "regexp_matches(text, '<[A-Z]+_[0-9]+>')"))
scalar("str22_strip_vault_tokens", X.TOKENED, stripped=(M.strip_tokens(T), "regexp_replace(text, '<[A-Z]+_[0-9]+>', 'redacted', 'g')"))
scalar("set07_tokens_in", X.TOKENED, tokens=(F.array_join(M.tokens_in(T), ","), "array_to_string(list_sort(list_distinct(regexp_extract_all(text, '<[A-Z][A-Z0-9]*_[0-9]+>'))), ',')"))
scalar("str11_repair_tokens", X.TOKENED, repaired=(M.repair_tokens(T), "regexp_replace(regexp_replace(text, '(^|[^A-Za-z0-9])[0-9]+<([A-Z]+_[0-9]+)>', '\\1<\\2>', 'g'), '<([A-Z]+_[0-9]+)>[0-9]+([^A-Za-z0-9]|$)', '<\\1>\\2', 'g')"))
_SPOKEN = "left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[A-Z]+_[0-9]+>', 'redacted', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[*_`#>~]', '', 'g'), '\\s+', ' ', 'g')), 600)"
scalar("str21_speak_safe", X.TOKENED, spoken=(M.speakable(T), _SPOKEN))
scalar("str23_to_speakable", X.TOKENED, spoken=(M.speakable(T), _SPOKEN), n_tokens=(F.regexp_count(T, F.lit(P.TOKEN)), "len(regexp_extract_all(text, '<[A-Z]+_[0-9]+>'))"))
scalar("str24_normalize_for_match", X.TOKENED, normal=(M.normal_for_match(T), "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"))
_FOLD = "translate(replace(replace(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 'rn', 'm'), 'vv', 'w'), '01i582', 'ollsbz')"
scalar("str27_fold_for_ocr", X.VALUES, folded=(M.fold_for_reading(T), _FOLD))
scalar("str29_edit_budget", X.VALUES, budget=(M.edit_budget(M.fold_for_reading(T)), f"greatest(1, length({_FOLD}) // 6)"))
scalar("str51_shorten", X.ERRORS, short=(M.shorten(T), "CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <= 220 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 220) || '…' END"))
scalar("str36_tail_of", X.DOCS, tail=(F.when(F.length(T) > 4000, F.substring(T, -4000, 4000)).otherwise(T), "right(text, 4000)"))
scalar("str37_normalise_words", X.NOTES, words=(F.array_join(M.words_of(T), " "), "trim(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g'))"))
_PUN = "length(regexp_replace(text, '[\\p{L}\\p{M}\\p{N}\\s]', '', 'g'))"
scalar("str38_punctuation_density", X.DOCS, density=(F.when(F.length(T) > 0, F.length(F.regexp_replace(T, "[\\p{L}\\p{M}\\p{N}\\s]", "")) / F.length(T)).otherwise(0.0), f"CASE WHEN length(text) > 0 THEN {_PUN} / length(text) ELSE 0 END"))
_SCRIPTS = {"devanagari": "\\x{0900}-\\x{097F}", "arabic": "\\x{0600}-\\x{06FF}", "cjk": "\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}", "greek": "\\x{0370}-\\x{03FF}", "cyrillic": "\\x{0400}-\\x{04FF}"}
scalar("str39_scripts", X.DOCS, scripts=(F.concat_ws(",", *(F.when(T.rlike(f"[{r}]"), F.lit(n)) for n, r in _SCRIPTS.items())), "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '[{r}]') THEN '{n}' END" for n, r in _SCRIPTS.items()) + ")"))
scalar("str35_clamp_for_history", X.DOCS, clamped=(
    F.when(F.length(T) <= 1200, T).otherwise(F.concat(F.when(F.length(F.regexp_extract(F.substring(T, 1, 1200), r"(?s)^(.*)\s", 1)) >= 600, F.regexp_extract(F.substring(T, 1, 1200), r"(?s)^(.*)\s", 1)).otherwise(F.substring(T, 1, 1200)), F.lit(" […]"))),
    "CASE WHEN length(text) <= 1200 THEN text ELSE (CASE WHEN length(regexp_extract(left(text, 1200), '(?s)^(.*)\\s', 1)) >= 600 THEN regexp_extract(left(text, 1200), '(?s)^(.*)\\s', 1) ELSE left(text, 1200) END) || ' […]' END",
))
_KINDS = "SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_partkey % 9 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'name_text' WHEN 3 THEN 'id_text' WHEN 4 THEN 'api_key' WHEN 5 THEN 'credential' WHEN 6 THEN 'face' WHEN 7 THEN 'person' ELSE 'financial' END AS kind, CASE l_suppkey % 7 WHEN 0 THEN 'Card number' WHEN 1 THEN 'SSN' WHEN 2 THEN 'PAN card' WHEN 3 THEN 'Passport number' WHEN 4 THEN 'GitHub token' WHEN 5 THEN 'Email address' ELSE 'Person name' END AS label, l_quantity AS n FROM {lineitem}"
K, L = F.col("kind"), F.col("label")
scalar("str15_token_kind_for_match", _KINDS, vault_kind=(
    F.when(K == "name_text", "pii_text").when(K.isin("email", "phone", "credential"), "credential").when(K == "api_key", "api_key").when(L.rlike("(?i)card|ssn"), "credential").otherwise("id_number"),
    "CASE WHEN kind = 'name_text' THEN 'pii_text' WHEN kind IN ('email', 'phone', 'credential') THEN 'credential' WHEN kind = 'api_key' THEN 'api_key' WHEN regexp_matches(label, '(?i)card|ssn') THEN 'credential' ELSE 'id_number' END",
))
scalar("str47_kind_of_label", _KINDS, vault_kind=(
    F.when(L.rlike("(?i)aadhaar|pan|ssn|passport|ifsc"), "id_number").when(L.rlike("(?i)card|email|phone|otp|password|passcode|secret"), "credential").when(L.rlike("(?i)api key|jwt|github|aws|anthropic|openai|token"), "api_key").otherwise("pii_text"),
    "CASE WHEN regexp_matches(lower(label), 'aadhaar|pan|ssn|passport|ifsc') THEN 'id_number' WHEN regexp_matches(lower(label), 'card|email|phone|otp|password|passcode|secret') THEN 'credential' WHEN regexp_matches(lower(label), 'api key|jwt|github|aws|anthropic|openai|token') THEN 'api_key' ELSE 'pii_text' END",
))
# Prefixes and names of vault kinds.
PREFIXES = {"face": "FACE", "credential": "CRED", "id_number": "ID", "api_key": "KEY", "pii_text": "PII", "image_text": "IMG"}
KIND_NAMES = {"pii_text": "a name of a person, company or place", "credential": "a credential", "id_number": "an identity number", "api_key": "an API key or token", "image_text": "text read from pixels", "face": "a face"}


def kind_name(k):
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in KIND_NAMES.items() for x in kv)), k), F.lit("a sensitive value"))


scalar("str16_token_kind_label", _KINDS, described=(kind_name(K), "CASE kind " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KIND_NAMES.items()) + " ELSE 'a sensitive value' END"))
scalar("fil15_contextual_kind", _KINDS, vault_kind=(F.when(K.isin("person", "organization", "address"), "pii_text").otherwise("credential"), "CASE WHEN kind IN ('person', 'organization', 'address') THEN 'pii_text' ELSE 'credential' END"), selector=(F.concat(F.lit('[data-id="'), F.col("id").cast("string"), F.lit('"]')), "'[data-id=\"' || id::VARCHAR || '\"]'"))
_ARGS = "SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN chr(123) || '\"a\": ' || CAST(event_id AS STRING) || ', \"b\": \"' || event_type || '\"' || chr(125) WHEN 3 THEN chr(123) || '\"a\": ' WHEN 4 THEN '17' WHEN 5 THEN '[1, 2]' ELSE ' ' || chr(123) || '\"b\": null' || chr(125) END AS text FROM {events}"
_JSON = F.try_parse_json(T)
scalar("str48_parse_arguments", _ARGS, parsed=(F.coalesce(F.when(F.schema_of_variant(_JSON).rlike("^(OBJECT|ARRAY)"), F.to_json(_JSON)), F.lit("{}")), "CASE id % 7 WHEN 2 THEN '{\"a\":' || id::VARCHAR || ',\"b\":\"' || json_extract_string(text, '$.b') || '\"}' WHEN 5 THEN '[1,2]' WHEN 6 THEN '{\"b\":null}' ELSE '{}' END"),
       a=(F.try_variant_get(_JSON, "$.a", "long"), "CASE WHEN id % 7 = 2 THEN json_extract_string(text, '$.a')::BIGINT END"))
scalar("str57_error_detail", "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN chr(123) || '\"error\": ' || chr(123) || '\"code\": \"E' || CAST(event_id % 50 AS STRING) || '\", \"message\": \"' || event_type || ' failed\"' || chr(125) || chr(125) WHEN 1 THEN 'plain ' || repeat(event_type, 40) ELSE chr(123) || '\"message\": \"none\"' || chr(125) END AS text FROM {events}", detail=(
    F.when(F.get_json_object(T, "$.error.message").isNotNull(), F.substring(F.concat_ws(": ", F.get_json_object(T, "$.error.code"), F.get_json_object(T, "$.error.message")), 1, 200)).otherwise(F.substring(T, 1, 160)),
    "CASE WHEN json_valid(text) AND json_extract_string(text, '$.error.message') IS NOT NULL THEN left(concat_ws(': ', json_extract_string(text, '$.error.code'), json_extract_string(text, '$.error.message')), 200) ELSE left(text, 160) END",
))
scalar("str28_within_edits", "SELECT o_orderkey AS id, CAST(o_custkey AS STRING) AS a, CAST(o_orderkey AS STRING) AS b FROM {orders}", near=(F.levenshtein("a", "b") <= 2, "levenshtein(a, b) <= 2"))
scalar("str26_damerau1", "SELECT o_orderkey AS id, CAST(o_custkey AS STRING) AS a, CAST(o_custkey + o_orderkey % 3 * 9 AS STRING) AS b FROM {orders}", near=(
    lambda: (F.levenshtein("a", "b") <= 1) | ((F.length("a") == F.length("b")) & (F.levenshtein("a", "b") == 2) & F.exists(F.sequence(F.lit(1), F.greatest(F.length("a") - 1, F.lit(1))), lambda i: F.concat(F.substring(F.col("a"), F.lit(1), i - 1), F.substring(F.col("a"), i + 1, F.lit(1)), F.substring(F.col("a"), i, F.lit(1)), F.substring(F.col("a"), i + 2, F.length("a"))) == F.col("b"))),
    "damerau_levenshtein(a, b) <= 1",
))
