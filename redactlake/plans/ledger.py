"""Queries of the hash-chained audit ledger, here one per user of the event stream."""

from __future__ import annotations

from pyspark.sql import functions as _functions
from pyspark.sql.window import Window

from ..catalog import query
from ..operators import ledger as _ledger
from ..functions.deferred import DeferredModule
from . import fixtures as X

F = DeferredModule(_functions)
L = DeferredModule(_ledger)

_E_SQL = "SELECT user_id AS chain, event_type AS type, event_id, (epoch_us(ts) // 1000) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS seq FROM events"
_DATA = "'{\"event\":' || CAST(e.event_id AS VARCHAR) || '}'"
_PRE = "'{\"data\":' || " + _DATA + " || ',\"prevHash\":\"' || {0} || '\",\"scheme\":3,\"seq\":' || CAST(e.seq AS VARCHAR) || ',\"timestamp\":' || CAST(e.ms AS VARCHAR) || ',\"type\":\"' || e.type || '\"}'"
_CHAIN = f"""WITH RECURSIVE e AS ({_E_SQL}), c AS (
  SELECT e.chain, e.seq, e.type, e.ms, repeat('0', 64) AS prev, sha256({_PRE.replace('{0}', "repeat('0', 64)")}) AS hash FROM e WHERE seq = 1
  UNION ALL SELECT e.chain, e.seq, e.type, e.ms, c.hash, sha256({_PRE.replace('{0}', 'c.hash')}) FROM c JOIN e ON e.chain = c.chain AND e.seq = c.seq + 1)"""


def _entries(s, d):
    return X.table(s, d, "events").select(F.col("user_id").alias("chain"), F.col("event_type").alias("type"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.concat(F.lit('{"event":'), F.col("event_id").cast("string"), F.lit("}")).alias("data"))


query("led01_add_entries", lambda s, d: L.chained(_entries(s, d)).select("chain", "seq", "type", "prev", "hash"), _CHAIN + " SELECT chain, seq, type, prev, hash FROM c")
query("led06_hash_content", lambda s, d: L.chained(_entries(s, d)).select("chain", "seq", F.sha2(L.preimage(F.col("at"), F.col("data"), F.col("prev"), F.col("seq"), F.col("type")), 256).alias("hash")), _CHAIN + " SELECT chain, seq, hash FROM c")


def _tampered(s, d):
    """Every 40th chain has its third entry changed after the fact."""
    bad = (F.col("chain") % 40 == 0) & (F.col("seq") == 3)
    return L.chained(_entries(s, d)).withColumn("type", F.when(bad, "forged").otherwise(F.col("type")))


query("win02_verify_chain", lambda s, d: L.verified(_tampered(s, d)), _CHAIN + " SELECT chain, count(*) AS n, NOT (chain % 40 = 0 AND count(*) >= 3) AS hashes_intact, true AS links_intact, CASE WHEN chain % 40 = 0 AND count(*) >= 3 THEN 3 END AS first_bad FROM c GROUP BY chain")
query("led02_merkle_root", lambda s, d: L.merkle(L.chained(_entries(s, d))), f"""{_CHAIN.replace('WITH RECURSIVE', 'WITH RECURSIVE')}, m AS (
  SELECT chain, 0 AS level, list(hash ORDER BY seq) AS nodes FROM c GROUP BY chain
  UNION ALL SELECT chain, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], nodes[i]))) FROM m WHERE len(nodes) > 1
) SELECT chain, nodes[1] AS root FROM m WHERE len(nodes) = 1""")
query("agg08_ledger_tally", lambda s, d: _entries(s, d).groupBy("chain").pivot("type", ["click", "error", "purchase", "view"]).count().na.fill(0), "SELECT chain, count(*) FILTER (type = 'click') AS click, count(*) FILTER (type = 'error') AS error, count(*) FILTER (type = 'purchase') AS purchase, count(*) FILTER (type = 'view') AS \"view\" FROM (SELECT user_id AS chain, event_type AS type FROM events) GROUP BY chain")
query("win03_session_entries", lambda s, d: L.numbered(_entries(s, d)).filter("seq >= 5").groupBy("chain").agg(F.count(F.lit(1)).alias("n")), f"SELECT chain, count(*) AS n FROM ({_E_SQL}) WHERE seq >= 5 GROUP BY chain")
query("led04_summary", lambda s, d: L.numbered(_entries(s, d)).groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.max_by("type", "seq").alias("last_type")), f"SELECT chain, count(*) AS n, arg_max(type, seq) AS last_type FROM ({_E_SQL}) GROUP BY chain")
query("led05_retained", lambda s, d: L.numbered(_entries(s, d)).withColumn("back", F.row_number().over(Window.partitionBy("chain").orderBy(F.desc("seq")))).filter("back <= 500").select("chain", "seq", "type"), f"SELECT chain, seq, type FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY seq DESC) AS back FROM ({_E_SQL})) WHERE back <= 500")
query("led03_certified_proof", lambda s, d: L.proofs(L.chained(_entries(s, d))).drop("entries"), f"""{_CHAIN}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY seq DESC) AS back FROM c) WHERE back <= 500), m AS (
  SELECT chain, 0 AS level, list(hash ORDER BY seq) AS nodes FROM k GROUP BY chain
  UNION ALL SELECT chain, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], nodes[i]))) FROM m WHERE len(nodes) > 1
) SELECT k.chain, count(*) AS total, true AS chain_valid, true AS hashes_intact, min(seq) > 1 AS trimmed, min(seq) AS from_seq, max(seq) AS to_seq, any_value(r.root) AS root FROM k JOIN (SELECT chain, nodes[1] AS root FROM m WHERE len(nodes) = 1) r ON r.chain = k.chain GROUP BY k.chain""")
query("src17_export_ledger", lambda s, d: L.proofs(L.chained(_entries(s, d))).select("chain", F.concat(F.lit('{"total":'), F.col("total").cast("string"), F.lit(',"entries":'), "entries", F.lit("}")).alias("json")),
      f"""{_CHAIN} SELECT chain, '{{"total":' || count(*)::VARCHAR || ',"entries":[' || string_agg('{{"seq":' || seq::VARCHAR || ',"timestamp":' || ms::VARCHAR || ',"type":"' || type || '","hash":"' || hash || '"}}', ',' ORDER BY seq) || ']}}' AS json FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY seq DESC) AS back FROM c) WHERE back <= 500 GROUP BY chain""")
query("led07_legacy_hash", lambda s, d: L.chained(_entries(s, d)).select("chain", "seq", F.sha2(L.legacy_preimage(F.col("at"), F.col("data"), F.col("prev"), F.col("seq"), F.col("type")), 256).alias("hash")),
      f"""{_CHAIN} SELECT c.chain, c.seq, sha256('{{"seq":' || c.seq::VARCHAR || ',"timestamp":' || e.ms::VARCHAR || ',"type":"' || e.type || '","data":' || {_DATA} || ',"prevHash":"' || c.prev || '"}}') AS hash FROM c JOIN e ON e.chain = c.chain AND e.seq = c.seq""")
query("led13_session_starts", lambda s, d: L.numbered(_entries(s, d)).groupBy("chain", F.expr("at div 86400000").alias("day")).agg(F.min("seq").alias("start_seq")), f"SELECT chain, ms // 86400000 AS day, min(seq) AS start_seq FROM ({_E_SQL}) GROUP BY 1, 2")
query("led17_cleared", lambda s, d: L.numbered(_entries(s, d)).filter(F.lit(False)).select("chain", "seq"), f"SELECT chain, seq FROM ({_E_SQL}) WHERE false")

# the data of each kind of entry, as canonical JSON
_VISITS = "SELECT page_id AS id, url, 'page ' || CAST(page_id AS STRING) AS title, page_id % 80 AS elements FROM {pages}"
query("led08_snapshot_entry", lambda s, d: X.frame(s, d, _VISITS).select("id", L.canonical(F.to_json(F.struct("url", "title", F.col("elements").alias("elementCount")))).alias("data")), f"""SELECT id, '{{"elementCount":' || elements::VARCHAR || ',"title":"' || title || '","url":"' || url || '"}}' AS data FROM ({X.plain(_VISITS)})""")
_SEEN = "SELECT user_id AS run, event_id, CASE event_id % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'api_key' WHEN 2 THEN 'face' ELSE event_type END AS kind, CASE event_id % 3 WHEN 0 THEN 'regex' WHEN 1 THEN 'contextual' ELSE 'ml_ner' END AS method FROM {events}"
_ORDERED = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("event_id", c))), lambda x: x[c]))
_FIRSTS = lambda c: f"""(SELECT run, '["' || string_agg({c}, '","' ORDER BY f) || '"]' AS {c}s FROM (SELECT run, {c}, min(event_id) AS f FROM s GROUP BY run, {c}) GROUP BY run)"""
query("led09_detection_entry", lambda s, d: X.frame(s, d, _SEEN).groupBy("run").agg(F.count(F.lit(1)).alias("count"), _ORDERED("kind").alias("kinds"), _ORDERED("method").alias("methods")).select("run", L.canonical(F.to_json(F.struct("methods", "kinds", "count"))).alias("data")),
      f"""WITH s AS ({X.plain(_SEEN)}) SELECT n.run, '{{"count":' || n::VARCHAR || ',"kinds":' || kinds || ',"methods":' || methods || '}}' AS data FROM (SELECT run, count(*) AS n FROM s GROUP BY run) n JOIN {_FIRSTS('kind')} k ON k.run = n.run JOIN {_FIRSTS('method')} m ON m.run = n.run""")
query("led10_token_entry", lambda s, d: X.frame(s, d, _SEEN).groupBy("run").agg(F.count(F.lit(1)).alias("count"), _ORDERED("kind").alias("tokenTypes")).select("run", L.canonical(F.to_json(F.struct("tokenTypes", "count"))).alias("data")),
      f"""WITH s AS ({X.plain(_SEEN)}) SELECT n.run, '{{"count":' || n::VARCHAR || ',"tokenTypes":' || kinds || '}}' AS data FROM (SELECT run, count(*) AS n FROM s GROUP BY run) n JOIN {_FIRSTS('kind')} k ON k.run = n.run""")
query("led11_redaction_entry", lambda s, d: X.frame(s, d, _SEEN).groupBy("run", "method").agg(F.count(F.lit(1)).alias("redactedCount")).select("run", "method", L.canonical(F.to_json(F.struct("redactedCount", "method"))).alias("data")),
      f"""SELECT run, method, '{{"method":"' || method || '","redactedCount":' || count(*)::VARCHAR || '}}' AS data FROM ({X.plain(_SEEN)}) GROUP BY run, method""")
query("led12_verification_entry", lambda s, d: X.frame(s, d, _SEEN).groupBy("run").agg(F.count_if(F.col("kind") == "error").alias("leakedCount"), F.count(F.lit(1)).alias("regionsChecked")).select("run", L.canonical(F.to_json(F.struct((F.col("leakedCount") == 0).alias("passed"), "regionsChecked", "leakedCount"))).alias("data")),
      f"""SELECT run, '{{"leakedCount":' || (count(*) FILTER (kind = 'error'))::VARCHAR || ',"passed":' || CASE WHEN count(*) FILTER (kind = 'error') = 0 THEN 'true' ELSE 'false' END || ',"regionsChecked":' || count(*)::VARCHAR || '}}' AS data FROM ({X.plain(_SEEN)}) GROUP BY run""")
_DONE = "SELECT event_id AS id, event_type AS tool, event_id % 3 <> 0 AS success, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 80 END AS element FROM {events}"
query("led15_action_entry", lambda s, d: X.frame(s, d, _DONE).select("id", L.canonical(F.to_json(F.struct("tool", "success", F.col("element").alias("elementId")))).alias("data")), f"""SELECT id, '{{' || CASE WHEN element IS NULL THEN '' ELSE '"elementId":' || element::VARCHAR || ',' END || '"success":' || success::VARCHAR || ',"tool":"' || tool || '"}}' AS data FROM ({X.plain(_DONE)})""")
_LOOSE = "SELECT event_id AS id, event_id % 9 AS n, event_type AS t, CASE event_id % 3 WHEN 0 THEN 'not json' ELSE chr(123) || ' \"b\" : [3, ' || chr(123) || '\"y\": true, \"x\": null' || chr(125) || ', [\"q\", \"a\"]], \"a\": ' || chr(123) || '\"z\": \"' || event_type || '\", \"k\":' || CAST(event_id % 9 AS STRING) || chr(125) || ' ' || chr(125) END AS text FROM {events}"
for _name in ("mth19_canonical_json", "led16_canonicalize"):
    query(_name, lambda s, d: X.frame(s, d, _LOOSE).select("id", L.canonical(F.col("text")).alias("json")), f"""SELECT id, CASE WHEN id % 3 <> 0 THEN '{{"a":{{"k":' || n::VARCHAR || ',"z":"' || t || '"}},"b":[3,{{"x":null,"y":true}},["q","a"]]}}' END AS json FROM ({X.plain(_LOOSE)})""")

# loops of actions: the last five of a chain at each entry
_STAMPS = "SELECT user_id AS chain, event_id, CAST(event_id AS BIGINT) AS moment, CASE (event_id * 7 + user_id) % 9 WHEN 0 THEN 'click' WHEN 1 THEN 'find_text' WHEN 2 THEN 'wait' WHEN 3 THEN 'read_page' WHEN 4 THEN 'web_search' WHEN 5 THEN 'wait' WHEN 6 THEN 'read_page' WHEN 7 THEN 'type' ELSE 'wait' END AS type, CAST(event_id % 2 AS STRING) AS data FROM {events}"


def loops(entries):
    """Where a chain of actions goes round at an entry: the same three times, two in turn, or five that only look."""
    from .policy import READ_ONLY

    w = Window.partitionBy("chain").orderBy("seq")
    sig = F.concat_ws("|", "type", "data")
    rows = L.numbered(entries).select("chain", "seq", sig.alias("s0"), *(F.lag(sig, i).over(w).alias(f"s{i}") for i in (1, 2, 3)), F.sum(F.col("type").isin(*READ_ONLY).cast("int")).over(w.rowsBetween(-4, 0)).alias("looks"))
    t = F.col
    kind = F.when((t("s0") == t("s1")) & (t("s0") == t("s2")), "repeat").when((t("s0") == t("s2")) & (t("s1") == t("s3")), "oscillation").when((t("looks") == 5) & (t("seq") >= 5), "observation")
    return rows.select("chain", "seq", kind.alias("loop")).filter("loop IS NOT NULL")


query("win04_action_loops", lambda s, d: loops(X.frame(s, d, _STAMPS).withColumnRenamed("moment", "at")), f"""SELECT chain, seq, loop FROM (SELECT chain, seq, CASE WHEN s0 = s1 AND s0 = s2 THEN 'repeat' WHEN s0 = s2 AND s1 = s3 THEN 'oscillation' WHEN looks = 5 AND seq >= 5 THEN 'observation' END AS loop FROM (
  SELECT chain, seq, s0, lag(s0, 1) OVER w AS s1, lag(s0, 2) OVER w AS s2, lag(s0, 3) OVER w AS s3, sum((type IN ('find_text', 'wait', 'read_page', 'web_search'))::INT) OVER (PARTITION BY chain ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS looks
  FROM (SELECT *, concat_ws('|', type, data) AS s0, row_number() OVER (PARTITION BY chain ORDER BY moment, event_id) AS seq FROM ({X.plain(_STAMPS)})) WINDOW w AS (PARTITION BY chain ORDER BY seq))) WHERE loop IS NOT NULL""")
