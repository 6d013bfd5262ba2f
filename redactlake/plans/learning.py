"""Queries of run memory, rule mining and retention; runs are the event stream by user and day."""

from __future__ import annotations

from pyspark.sql import functions as _functions
from pyspark.sql.window import Window

from ..catalog import query, scalar
from ..functions.deferred import DeferredModule
from . import fixtures as X

F = DeferredModule(_functions)
_RUNS = """SELECT user_id, CAST(CAST(ts AS DATE) AS STRING) AS day, 's' || CAST(user_id % 12 AS STRING) || '.example' AS domain, CASE user_id % 3 WHEN 0 THEN 'form' WHEN 1 THEN 'search' ELSE 'other' END AS page_type,
  count(*) AS actions, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS good, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS detections, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS success, min(event_id) AS id
  FROM {events} GROUP BY user_id, CAST(ts AS DATE)"""
_R = X.plain(_RUNS)


def runs(s, d):
    return X.frame(s, d, _RUNS)


query("lrn15_all_runs", runs, _R)
query("agg01_memory_stats", lambda s, d: runs(s, d).agg(F.count(F.lit(1)).alias("n"), F.sum("success").alias("succeeded"), F.countDistinct("domain").alias("domains"), F.sum("detections").alias("detections"), F.sum("actions").alias("actions")), f"SELECT count(*) AS n, sum(success)::BIGINT AS succeeded, count(DISTINCT domain) AS domains, sum(detections)::BIGINT AS detections, sum(actions)::BIGINT AS actions FROM ({_R})")
query("agg02_action_success", lambda s, d: runs(s, d).select("id", F.when(F.col("actions") == 0, 1.0).otherwise(F.col("good") / F.col("actions")).alias("rate")), f"SELECT id, CASE WHEN actions = 0 THEN 1 ELSE good / actions END AS rate FROM ({_R})")
query("lrn01_keep_newest", lambda s, d: runs(s, d).orderBy(F.desc("day"), "id").limit(200).select("id", "day"), f"SELECT id, day FROM ({_R}) ORDER BY day DESC, id LIMIT 200")
query("top13_recent_runs", lambda s, d: runs(s, d).orderBy(F.desc("day"), "id").limit(10).select("id", "day"), f"SELECT id, day FROM ({_R}) ORDER BY day DESC, id LIMIT 10")
query("top14_runs_of_domain", lambda s, d: runs(s, d).filter("domain = 's3.example'").select("id", "day"), f"SELECT id, day FROM ({_R}) WHERE domain = 's3.example'")
query("top15_runs_of_page_type", lambda s, d: runs(s, d).filter("page_type = 'form'").select("id", "day"), f"SELECT id, day FROM ({_R}) WHERE page_type = 'form'")
_UPDATES = "SELECT DISTINCT event_id AS id, CASE event_id % 2 WHEN 0 THEN 1 ELSE 0 END AS outcome FROM {events} WHERE event_id % 3 = 0"
query("lrn02_update_outcome", lambda s, d: runs(s, d).join(X.frame(s, d, _UPDATES), "id", "left").select("id", F.coalesce("outcome", "success").alias("success"), F.col("outcome").isNotNull().alias("changed")), f"SELECT r.id, coalesce(u.outcome, r.success) AS success, u.id IS NOT NULL AS changed FROM ({_R}) r LEFT JOIN ({X.plain(_UPDATES)}) u ON u.id = r.id")
query("src15_sessions", lambda s, d: runs(s, d).withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day")))).filter("rn <= 5").select("user_id", "day", "rn"), f"SELECT user_id, day, rn FROM (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rn FROM ({_R})) WHERE rn <= 5")
_KEPT = lambda s, d: runs(s, d).withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day"), "id"))).filter("rn <= 50")
_KEPT_SQL = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC, id) AS rn FROM ({_R})) WHERE rn <= 50"
query("src24_read_sessions", lambda s, d: _KEPT(s, d).select("user_id", "rn", "day", "domain"), f"SELECT user_id, rn, day, domain FROM ({_KEPT_SQL})")
_GONE = "SELECT DISTINCT event_id AS id FROM {events} WHERE event_id % 7 = 0"
query("src25_delete_session", lambda s, d: _KEPT(s, d).join(X.frame(s, d, _GONE), "id", "left_anti").select("id", "user_id"), f"SELECT id, user_id FROM ({_KEPT_SQL}) WHERE id NOT IN ({X.plain(_GONE)})")
# lessons and paths: newest of each domain and overall, one of a text
query("win09_lessons", lambda s, d: runs(s, d).groupBy("domain", "page_type").agg(F.max("day").alias("day"), F.max("id").alias("id")).withColumn("rn", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("day"), "id"))).filter("rn <= 5").orderBy(F.desc("day"), "id").limit(50).select("domain", "page_type", "day"),
      f"SELECT domain, page_type, day FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY day DESC, id) AS rn FROM (SELECT domain, page_type, max(day) AS day, max(id) AS id FROM ({_R}) GROUP BY domain, page_type)) WHERE rn <= 5 ORDER BY day DESC, id LIMIT 50")
query("win10_trajectories", lambda s, d: runs(s, d).filter("success = 1").groupBy("domain", "user_id").agg(F.max("day").alias("day")).withColumn("rn", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("day"), "user_id"))).filter("rn <= 5").orderBy(F.desc("day"), "user_id").limit(30).select("domain", "user_id", "day"),
      f"SELECT domain, user_id, day FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY day DESC, user_id) AS rn FROM (SELECT domain, user_id, max(day) AS day FROM ({_R}) WHERE success = 1 GROUP BY domain, user_id)) WHERE rn <= 5 ORDER BY day DESC, user_id LIMIT 30")
for _name, _n in (("joi12_match_lessons", 3), ("joi13_match_trajectories", 2)):
    query(_name, lambda s, d, n=_n: runs(s, d).filter("domain = 's3.example'").orderBy(F.desc(F.col("page_type") == "form"), F.desc("day"), "id").limit(n).select("id", "page_type"), f"SELECT id, page_type FROM ({_R}) WHERE domain = 's3.example' ORDER BY (page_type = 'form') DESC, day DESC, id LIMIT {_n}")
# rules
_RULES = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'missed' WHEN 2 THEN 'strategy' ELSE 'site' END AS category, CASE WHEN p_partkey % 3 = 0 THEN 's' || CAST(p_partkey % 12 AS STRING) || '.example' END AS domain, CASE WHEN p_partkey % 5 = 0 THEN 'form' END AS page_type, p_size / 50.0 AS confidence, p_partkey % 45 AS age_days FROM {part}"
_RU = X.plain(_RULES)
query("joi11_applicable_rules", lambda s, d: X.frame(s, d, _RULES).filter("confidence >= 0.3").alias("r").join(F.broadcast(s.sql("SELECT 's3.example' AS want, 'form' AS kind")), (F.col("r.domain").isNull() | (F.col("r.domain") == F.col("want"))) & (F.col("r.page_type").isNull() | (F.col("r.page_type") == F.col("kind")))).select("id", "category"), f"SELECT id, category FROM ({_RU}) WHERE confidence >= 0.3 AND (domain IS NULL OR domain = 's3.example') AND (page_type IS NULL OR page_type = 'form')")
query("lrn12_rules_by_category", lambda s, d: X.frame(s, d, _RULES).filter("category = 'strategy'").select("id", "confidence"), f"SELECT id, confidence FROM ({_RU}) WHERE category = 'strategy'")
query("lrn14_rules", lambda s, d: X.frame(s, d, _RULES), _RU)
query("agg09_rules_summary", lambda s, d: X.frame(s, d, _RULES).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= 0.7).alias("sure"), F.count_if(F.col("age_days") < 1).alias("new")), f"SELECT category, count(*) AS n, count(*) FILTER (confidence >= 0.7) AS sure, count(*) FILTER (age_days < 1) AS \"new\" FROM ({_RU}) GROUP BY category")
query("agg11_suppression_keys", lambda s, d: X.frame(s, d, _RULES).filter("category = 'false_positive' AND confidence >= 0.5").select(F.concat_ws(":", F.coalesce("domain", F.lit("*")), F.coalesce("page_type", F.lit("*"))).alias("key")).distinct(), f"SELECT DISTINCT concat_ws(':', coalesce(domain, '*'), coalesce(page_type, '*')) AS key FROM ({_RU}) WHERE category = 'false_positive' AND confidence >= 0.5")
query("agg12_model_only", lambda s, d: X.frame(s, d, _RULES).groupBy("domain").agg(F.coalesce(F.bool_or((F.col("category") == "strategy") & (F.col("confidence") >= 0.5)), F.lit(False)).alias("model_only")), f"SELECT domain, coalesce(bool_or(category = 'strategy' AND confidence >= 0.5), false) AS model_only FROM ({_RU}) GROUP BY domain")
_AGED = "floor(confidence * pow(0.995, age_days) * 1000 + 0.5) / 1000"
query("mth23_rule_lifecycle", lambda s, d: X.frame(s, d, _RULES).select("id", "age_days", (F.floor(F.col("confidence") * F.pow(F.lit(0.995), "age_days") * 1000 + 0.5) / 1000).alias("confidence")).filter("confidence >= 0.1 AND NOT (age_days > 30 AND confidence < 0.6)"), f"SELECT * FROM (SELECT id, age_days, {_AGED} AS confidence FROM ({_RU})) WHERE confidence >= 0.1 AND NOT (age_days > 30 AND confidence < 0.6)")
_NEW = "SELECT s_suppkey AS n, CASE s_suppkey % 4 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'missed' WHEN 2 THEN 'strategy' ELSE 'site' END AS category, CASE WHEN s_suppkey % 3 = 0 THEN 's' || CAST(s_suppkey % 12 AS STRING) || '.example' END AS domain, CASE WHEN s_suppkey % 2 = 0 THEN 'form' END AS page_type, 0.5 AS confidence FROM {supplier}"


def applied(rules, new, confirmed, contradicted, most=500):
    """Rules after a reflection: new ones that no rule equals in category, condition and domain come in, confirmed ones rise and are fresh, contradicted ones fall, the old fade, the weak go, and at most `most` stay."""
    half = lambda c: F.floor(c * 1000 + 0.5) / 1000
    alike = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("category", "domain", "page_type")]
    once = new.groupBy("category", "domain", "page_type").agg(F.min("n").alias("n"), F.max("confidence").alias("confidence"))
    fresh = once.alias("a").join(rules.alias("b"), alike[0] & alike[1] & alike[2], "left_anti").select((-F.col("n")).alias("id"), "category", "domain", "page_type", F.col("confidence").cast("double").alias("confidence"), F.lit(0).cast("bigint").alias("age_days"))
    rows = rules.select("id", "category", "domain", "page_type", F.col("confidence").cast("double").alias("confidence"), F.col("age_days").cast("bigint").alias("age_days")).unionByName(fresh)
    rows = rows.join(confirmed.select(F.col("id").alias("cid")), F.col("id") == F.col("cid"), "left").join(contradicted.select(F.col("id").alias("xid")), F.col("id") == F.col("xid"), "left")
    up = F.when(F.col("cid").isNotNull(), half(F.least(F.lit(1.0), F.col("confidence") + 0.1))).otherwise(F.col("confidence"))
    down = F.when(F.col("xid").isNotNull(), half(F.greatest(F.lit(0.0), up - 0.2))).otherwise(up)
    rows = rows.withColumn("c", down).filter("xid IS NULL OR c >= 0.1").withColumn("age", F.when(F.col("cid").isNotNull(), F.lit(0)).otherwise(F.col("age_days")))
    rows = rows.withColumn("c", half(F.col("c") * F.pow(F.lit(0.995), "age"))).filter("c >= 0.1 AND NOT (age > 30 AND c < 0.6)")
    return rows.orderBy(F.desc("c"), "id").limit(most).select("id", F.col("c").alias("confidence"), "age")


_YES, _NO = "SELECT DISTINCT s_suppkey * 3 AS id FROM {supplier}", "SELECT DISTINCT s_suppkey * 7 AS id FROM {supplier}"
query("lrn11_apply_results", lambda s, d: applied(X.frame(s, d, _RULES), X.frame(s, d, _NEW), X.frame(s, d, _YES), X.frame(s, d, _NO)), f"""
WITH r AS ({_RU}), n AS (SELECT category, domain, page_type, min(n) AS n, max(confidence)::DOUBLE AS confidence FROM ({X.plain(_NEW)}) GROUP BY ALL), f AS (SELECT -n AS id, confidence, 0 AS age_days FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.category = n.category AND r.domain IS NOT DISTINCT FROM n.domain AND r.page_type IS NOT DISTINCT FROM n.page_type)),
e AS (SELECT id, confidence::DOUBLE AS confidence, age_days FROM r UNION ALL SELECT * FROM f), u AS (SELECT *, id IN ({X.plain(_YES)}) AS yes, id IN ({X.plain(_NO)}) AS no FROM e),
a AS (SELECT *, CASE WHEN yes THEN floor(least(1.0, confidence + 0.1) * 1000 + 0.5) / 1000 ELSE confidence END AS c1 FROM u), b AS (SELECT *, CASE WHEN no THEN floor(greatest(0.0, c1 - 0.2) * 1000 + 0.5) / 1000 ELSE c1 END AS c2, CASE WHEN yes THEN 0 ELSE age_days END AS age FROM a)
SELECT id, c AS confidence, age FROM (SELECT id, floor(c2 * pow(0.995, age) * 1000 + 0.5) / 1000 AS c, age FROM b WHERE NOT no OR c2 >= 0.1) WHERE c >= 0.1 AND NOT (age > 30 AND c < 0.6) ORDER BY c DESC, id LIMIT 500""")


def before(rows, **sums):
    """rows (domain, day, id) with sums over all earlier rows of the domain: days are summed first, so no task holds a domain's history."""
    days = rows.groupBy("domain", "day").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    w = Window.partitionBy("domain").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("domain", "day", *(F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"{n}_days") for n in sums))
    own = Window.partitionBy("domain", "day").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select("*", *(F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"{n}_day") for n, c in sums.items())).join(days, ["domain", "day"])
    return out.withColumns({n: F.col(f"{n}_days") + F.col(f"{n}_day") for n in sums})


query("lrn08_repeated_success", lambda s, d: before(runs(s, d), prior=F.col("success")).filter("success = 1 AND prior >= 1").select("id", "domain", "prior"), f"SELECT id, domain, prior FROM (SELECT *, coalesce(sum(success) OVER (PARTITION BY domain ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior FROM ({_R})) WHERE success = 1 AND prior >= 1")
query("lrn09_repeated_failure", lambda s, d: before(runs(s, d), prior=F.col("actions") - F.col("good")).filter("success = 0 AND actions > good AND prior >= 1").select("id", "domain"), f"SELECT id, domain FROM (SELECT *, coalesce(sum(actions - good) OVER (PARTITION BY domain ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM ({_R})) WHERE success = 0 AND actions > good AND prior >= 1")
query("lrn10_site_pattern", lambda s, d: before(runs(s, d), visits=F.lit(1)).filter("visits >= 1 AND detections >= 3").select("id", "domain", "detections"), f"SELECT id, domain, detections FROM (SELECT *, count(*) OVER (PARTITION BY domain ORDER BY day, id) - 1 AS visits FROM ({_R})) WHERE visits >= 1 AND detections >= 3")
query("lrn07_strategy_rules", lambda s, d: runs(s, d).groupBy("page_type").agg((F.sum("good") / F.sum("actions")).alias("rate")).select("page_type", F.when(F.col("rate") < 0.7, "use_model").otherwise("use_rules").alias("strategy"), F.lit(0.6).alias("confidence")), f"SELECT page_type, CASE WHEN sum(good) / sum(actions) < 0.7 THEN 'use_model' ELSE 'use_rules' END AS strategy, 0.6 AS confidence FROM ({_R}) GROUP BY page_type")
# wire log
query("src13_record_wire", lambda s, d: X.frame(s, d, X.CONV).withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "id", "text"))).filter("rn <= 24").select("id", "rn", F.concat(F.lit("w"), F.col("rn").cast("string")).alias("wire")), f"SELECT id, rn, 'w' || rn::VARCHAR AS wire FROM (SELECT id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, id, text) AS rn FROM ({X.plain(X.CONV)})) WHERE rn <= 24")
_WIRE = "SELECT conv_id, turn, id, CASE conv_id % 4 WHEN 0 THEN 'w' || CAST(turn * 3 AS STRING) WHEN 1 THEN 'x7' WHEN 2 THEN 'w' ELSE 'wnine' END AS wire FROM (" + X.CONV + ") c"
query("src12_load_wire", lambda s, d: X.frame(s, d, _WIRE).withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "id", "wire"))).filter("rn <= 24").groupBy("conv_id").agg(F.count(F.lit(1)).alias("kept"), F.coalesce(F.max(F.substring("wire", 2, 20).try_cast("long")), F.lit(0)).alias("sequence")), f"SELECT conv_id, count(*) AS kept, coalesce(max(try_cast(substr(wire, 2) AS BIGINT)), 0) AS sequence FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, id, wire) AS rn FROM ({X.plain(_WIRE)})) WHERE rn <= 24 GROUP BY conv_id")

# --- one run after the other: findings, corrections, reflection --------------------------------
_RUN_ID = "user_id * 1000 + CAST(event_id % 4 AS BIGINT)"
_FINDINGS = f"SELECT {_RUN_ID} AS run, event_id, 's' || CAST(user_id % 12 AS STRING) || '.example' AS domain, CASE user_id % 3 WHEN 0 THEN 'form' WHEN 1 THEN 'search' ELSE 'other' END AS page_type, CASE event_id % 6 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'pii_text' WHEN 3 THEN 'face' WHEN 4 THEN 'card' ELSE 'id_number' END AS kind, CASE event_id % 3 WHEN 0 THEN 'regex' WHEN 1 THEN 'contextual' ELSE 'learned_rule' END AS method, CASE event_type WHEN 'error' THEN 'false_positive' WHEN 'view' THEN 'missed' ELSE 'true_positive' END AS outcome FROM {{events}} WHERE event_id % 11 = 0".replace("{{", "{").replace("}}", "}")
_KNOWN = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 4 THEN 'strategy' ELSE 'pii_detection' END AS category, CASE p_partkey % 3 WHEN 0 THEN 'false_positive:' WHEN 1 THEN 'missed:' ELSE 'strategy:' END || CASE p_partkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'card' WHEN 2 THEN 'deterministic' ELSE 'phone' END || ':regex' AS condition, CASE WHEN p_partkey % 7 <> 0 THEN 's' || CAST(p_partkey % 12 AS STRING) || '.example' END AS domain FROM {part} WHERE p_partkey % 10 < 4"
_FI, _KN = X.plain(_FINDINGS), X.plain(_KNOWN)


def detection_rules(findings, known, outcome, prefix, action):
    """A rule for each finding of an outcome whose kind has none on its domain."""
    rows = findings.filter(F.col("outcome") == outcome)
    if prefix == "missed":
        rows = rows.filter(~F.col("kind").isin("pii_text", "face"))
    old = known.filter("category = 'pii_detection'").select(F.col("domain").alias("of"), F.col("condition").alias("has"))
    rows = rows.join(old, (F.col("domain") == F.col("of")) & F.contains("has", F.concat(F.lit(f"{prefix}:"), F.col("kind"))), "left_anti")
    return rows.select("run", "event_id", "domain", "page_type", F.concat_ws(":", F.lit(prefix), "kind", "method").alias("condition"), F.lit(action).alias("action"), F.lit(0.5).alias("confidence"))


def _rule_sql(outcome, prefix, action, more="true"):
    return f"SELECT run, event_id, domain, page_type, '{prefix}:' || kind || ':' || method AS condition, '{action}' AS action, 0.5::DOUBLE AS confidence FROM ({_FI}) f WHERE outcome = '{outcome}' AND {more} AND NOT EXISTS (SELECT 1 FROM ({_KN}) k WHERE k.category = 'pii_detection' AND k.domain = f.domain AND contains(k.condition, '{prefix}:' || f.kind))"


_FP_SQL = _rule_sql("false_positive", "false_positive", "reduce_confidence")
_MISS_SQL = _rule_sql("missed", "missed", "add_detection", "kind NOT IN ('pii_text', 'face')")
query("lrn05_false_positive_rules", lambda s, d: detection_rules(X.frame(s, d, _FINDINGS), X.frame(s, d, _KNOWN), "false_positive", "false_positive", "reduce_confidence"), _FP_SQL)
query("lrn06_missed_rules", lambda s, d: detection_rules(X.frame(s, d, _FINDINGS), X.frame(s, d, _KNOWN), "missed", "missed", "add_detection"), _MISS_SQL)
_CORRECTIONS = "SELECT DISTINCT user_id * 1000 + CAST(event_id % 4 AS BIGINT) AS run, CASE user_id % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'face' WHEN 2 THEN 'card' ELSE 'never_seen' END AS kind FROM {events} WHERE event_id % 3 = 0"


def corrected(findings, corrections):
    """Findings of the runs that a user corrected: the first right one of the kind becomes a false positive, or one is added."""
    rows = findings.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("event_id", "kind", "method", "outcome"))).alias("found")).join(corrections.withColumnRenamed("kind", "wrong"), "run")
    fits = lambda p: (p["kind"] == F.col("wrong")) & (p["outcome"] == "true_positive")
    rows = rows.withColumn("at", F.array_position(F.transform("found", fits), F.lit(True)))
    name = lambda k, m, o: F.concat_ws(":", k, m, o)
    changed = F.transform("found", lambda p, i: name(p["kind"], p["method"], F.when(i + 1 == F.col("at"), "false_positive").otherwise(p["outcome"])))
    return rows.select("run", F.when(F.col("at") > 0, F.array_join(changed, ",")).otherwise(F.array_join(F.array_append(changed, name(F.col("wrong"), F.lit("user"), F.lit("false_positive"))), ",")).alias("found"), F.concat(F.lit("user:false_positive:"), "wrong").alias("log"))


query("lrn03_user_correction", lambda s, d: corrected(X.frame(s, d, _FINDINGS), X.frame(s, d, _CORRECTIONS)), f"""WITH f AS (SELECT f.*, c.kind AS wrong, f.kind = c.kind AND outcome = 'true_positive' AS fits FROM ({_FI}) f JOIN ({X.plain(_CORRECTIONS)}) c ON c.run = f.run), g AS (SELECT *, min(CASE WHEN fits THEN event_id END) OVER (PARTITION BY run) AS hit FROM f)
SELECT run, string_agg(kind || ':' || method || ':' || CASE WHEN event_id = hit THEN 'false_positive' ELSE outcome END, ',' ORDER BY event_id) || CASE WHEN any_value(hit) IS NULL THEN ',' || any_value(wrong) || ':user:false_positive' ELSE '' END AS found, 'user:false_positive:' || any_value(wrong) AS log FROM g GROUP BY run""")
_ACTED = "SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS STRING) AS day, 's' || CAST(user_id % 12 AS STRING) || '.example' AS domain, CASE user_id % 3 WHEN 0 THEN 'form' WHEN 1 THEN 'search' ELSE 'other' END AS page_type, event_id % 2 = 0 AS ruled, event_type <> 'error' AS good, CASE WHEN event_type = 'error' THEN 'cause' || CAST(event_id % 3 AS STRING) END AS cause, event_type = 'purchase' AS bought FROM {events}"


def reflections(acted, known):
    """What every run teaches: strategies that worked or did not, successes and failures that repeat on a domain, and kinds that a domain keeps showing; less the rules that are known."""
    run = acted.groupBy("domain", "page_type", "user_id", "day").agg(F.min("event_id").alias("id"), F.count_if("ruled").alias("ruled"), F.count_if(~F.col("ruled")).alias("asked"), F.bool_or("bought").alias("won"), F.count_if("bought").alias("found"))
    run = before(run, visits=F.lit(1))
    fails = acted.filter("cause IS NOT NULL AND ruled").select("domain", "user_id", "day", "cause").distinct().join(run.select("domain", "user_id", "day", "id", "page_type"), ["domain", "user_id", "day"])
    # a cause counts if some earlier run of the domain failed by it
    firsts = acted.filter("cause IS NOT NULL").groupBy("domain", "cause", "user_id", "day").agg(F.lit(1).alias("one")).join(run.select("domain", "user_id", "day", "id"), ["domain", "user_id", "day"]).groupBy("domain", "cause").agg(F.min(F.struct("day", "id")).alias("first"))
    again = fails.join(firsts, ["domain", "cause"]).filter(F.col("first") < F.struct("day", "id"))
    rule = lambda rows, condition, action, sure: rows.select("id", "domain", "page_type", condition.alias("condition"), action.alias("action"), F.lit(sure).alias("confidence"))
    better = F.when((F.col("asked") > 0) & ((F.col("ruled") == 0) | (F.col("asked") >= F.col("ruled"))), "llm").otherwise("deterministic")
    out = rule(run.filter("ruled > 0 AND won"), F.lit("strategy:deterministic"), F.lit("use_deterministic"), 0.6)
    out = out.unionByName(rule(run.filter("ruled > 0 AND NOT won"), F.lit("strategy:llm"), F.lit("use_llm"), 0.6))
    out = out.unionByName(rule(run.filter("won AND visits >= 1"), F.concat(F.lit("repeated_success:"), better), F.concat(F.lit("prefer_"), better), 0.7))
    out = out.unionByName(rule(again, F.concat(F.lit("repeated_failure:"), "cause"), F.lit("use_llm"), 0.6))
    out = out.unionByName(rule(run.filter("visits >= 1 AND found >= 3"), F.lit("site_pii:purchase"), F.lit("prioritize_detection"), 0.6))
    old = known.select(F.col("domain").alias("of"), F.col("condition").alias("has"))
    return out.join(old, (F.col("domain") == F.col("of")) & (F.col("condition") == F.col("has")), "left_anti")


_RULED = "SELECT DISTINCT 's' || CAST(p_partkey % 12 AS STRING) || '.example' AS domain, CASE p_partkey % 5 WHEN 0 THEN 'strategy:llm' WHEN 1 THEN 'repeated_failure:cause1' WHEN 2 THEN 'repeated_success:llm' ELSE 'none' END AS condition FROM {part} WHERE p_partkey % 12 < 3"
_REFLECT_SQL = f"""WITH a AS ({X.plain(_ACTED)}), r AS (SELECT *, count(*) OVER (PARTITION BY domain ORDER BY day, id) - 1 AS visits FROM (SELECT domain, page_type, user_id, day, min(event_id) AS id, count(*) FILTER (ruled) AS ruled, count(*) FILTER (NOT ruled) AS asked, bool_or(bought) AS won, count(*) FILTER (bought) AS found FROM a GROUP BY ALL)),
c AS (SELECT DISTINCT r.domain, r.page_type, r.day, r.id, a.cause, a.ruled FROM a JOIN r ON r.domain = a.domain AND r.user_id = a.user_id AND r.day = a.day WHERE a.cause IS NOT NULL),
o AS (SELECT id, domain, page_type, 'strategy:deterministic' AS condition, 'use_deterministic' AS action, 0.6::DOUBLE AS confidence FROM r WHERE ruled > 0 AND won UNION ALL SELECT id, domain, page_type, 'strategy:llm', 'use_llm', 0.6 FROM r WHERE ruled > 0 AND NOT won
  UNION ALL SELECT id, domain, page_type, 'repeated_success:' || s, 'prefer_' || s, 0.7 FROM (SELECT *, CASE WHEN asked > 0 AND (ruled = 0 OR asked >= ruled) THEN 'llm' ELSE 'deterministic' END AS s FROM r WHERE won AND visits >= 1)
  UNION ALL SELECT id, domain, page_type, 'repeated_failure:' || cause, 'use_llm', 0.6 FROM c WHERE ruled AND EXISTS (SELECT 1 FROM c p WHERE p.domain = c.domain AND p.cause = c.cause AND (p.day < c.day OR (p.day = c.day AND p.id < c.id)))
  UNION ALL SELECT id, domain, page_type, 'site_pii:purchase', 'prioritize_detection', 0.6 FROM r WHERE visits >= 1 AND found >= 3)
SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM ({X.plain(_RULED)}) k WHERE k.domain = o.domain AND k.condition = o.condition)"""
query("lrn04_reflect", lambda s, d: reflections(X.frame(s, d, _ACTED), X.frame(s, d, _RULED)), _REFLECT_SQL)
_SUMMED = "SELECT user_id AS id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 AS won, CASE user_id % 3 WHEN 0 THEN 'form' ELSE 'other' END AS page_type, 's' || CAST(user_id % 12 AS STRING) || '.example' AS domain, user_id % 4 AS fp, user_id % 3 AS missed, user_id % 2 AS strategies, user_id % 5 % 2 AS sites, user_id % 7 AS rules FROM {events} GROUP BY user_id"
_IF = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {text}")))
scalar("str55_reflection_summary", _SUMMED, summary=(
    F.concat_ws(" ", F.concat(F.lit("Task "), F.when(F.col("won"), "succeeded").otherwise("failed"), F.lit(" on "), "page_type", F.lit(" page.")), _IF("fp", "false positive(s)."), _IF("missed", "missed item(s)."), _IF("strategies", "strategy note(s)."), F.when(F.col("sites") > 0, F.concat(F.lit("New pattern for "), "domain", F.lit("."))), _IF("rules", "new rule(s).")),
    "concat_ws(' ', 'Task ' || CASE WHEN won THEN 'succeeded' ELSE 'failed' END || ' on ' || page_type || ' page.', CASE WHEN fp > 0 THEN fp::VARCHAR || ' false positive(s).' END, CASE WHEN missed > 0 THEN missed::VARCHAR || ' missed item(s).' END, CASE WHEN strategies > 0 THEN strategies::VARCHAR || ' strategy note(s).' END, CASE WHEN sites > 0 THEN 'New pattern for ' || domain || '.' END, CASE WHEN rules > 0 THEN rules::VARCHAR || ' new rule(s).' END)"))
_TOLD = "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN '- Check the ' || event_type || ' first' || chr(10) || chr(10) || '2. Do not retry' || chr(10) || '  • Use search  ' || chr(10) || '4. too many' WHEN 1 THEN '' ELSE chr(10) || '***' || chr(10) || 'One line' END AS text FROM {events}"
scalar("lrn13_lesson_lines", _TOLD, lessons=(
    F.array_join(F.slice(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[-*•\s0-9.]+", ""))), lambda x: x != ""), 1, 3), "|"),
    "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^[-*•\\s0-9.]+', ''))), lambda x: x <> '')[1:3], '|')"))
_ROUTES = "SELECT user_id AS id, 's' || CAST(user_id % 12 AS STRING) || '.example' AS domain, CASE user_id % 3 WHEN 0 THEN 'form' ELSE 'other' END AS page_type, min(event_id) AS first, count(*) AS n FROM {events} GROUP BY user_id"
query("str44_trajectory_routes", lambda s, d: X.frame(s, d, _ROUTES).groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", F.concat(F.lit("On "), "domain", F.lit(" ("), "page_type", F.lit("): "), F.col("n").cast("string"), F.lit(" steps")).alias("line")))), lambda x: x["line"]), "\n").alias("routes")), f"SELECT domain, string_agg('On ' || domain || ' (' || page_type || '): ' || n::VARCHAR || ' steps', chr(10) ORDER BY first) AS routes FROM ({X.plain(_ROUTES)}) GROUP BY domain")

# --- dashboards -------------------------------------------------------------------------------
query("agg26_privacy_audit", lambda s, d: X.frame(s, d, _FINDINGS).groupBy("run").agg(F.count(F.lit(1)).alias("detections"), F.count_if(F.col("outcome") == "true_positive").alias("redacted"), F.countDistinct("kind").alias("kinds"), F.countDistinct(F.when(F.col("method") == "regex", F.concat("kind", "outcome"))).alias("tokens"), F.max_by("outcome", "event_id").alias("last")), f"SELECT run, count(*) AS detections, count(*) FILTER (outcome = 'true_positive') AS redacted, count(DISTINCT kind) AS kinds, count(DISTINCT CASE WHEN method = 'regex' THEN kind || outcome END) AS tokens, arg_max(outcome, event_id) AS last FROM ({_FI}) GROUP BY run")


def dashboard(run, rules):
    """One row: totals of the runs, of the rules, and the newest lessons."""
    stats = run.agg(F.count(F.lit(1)).alias("runs"), F.floor(F.avg("success") * 100 + 0.5).cast("long").alias("success_pct"), F.countDistinct("domain").alias("sites"))
    known = rules.agg(F.count(F.lit(1)).alias("rules"), F.count_if(F.col("confidence") >= 0.7).alias("sure"))
    newest = run.orderBy(F.desc("day"), "id").limit(5).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_date(F.col("day").cast("date"))).alias("k"), "id", "domain"))), lambda x: x["domain"]), ",").alias("newest"))
    return stats.crossJoin(F.broadcast(known)).crossJoin(F.broadcast(newest))


query("agg27_learning_stats", lambda s, d: dashboard(runs(s, d), X.frame(s, d, _RULES)), f"SELECT a.*, b.*, c.* FROM (SELECT count(*) AS runs, floor(avg(success) * 100 + 0.5)::BIGINT AS success_pct, count(DISTINCT domain) AS sites FROM ({_R})) a, (SELECT count(*) AS rules, count(*) FILTER (confidence >= 0.7) AS sure FROM ({_RU})) b, (SELECT string_agg(domain, ',' ORDER BY day DESC, id) AS newest FROM (SELECT * FROM ({_R}) ORDER BY day DESC, id LIMIT 5)) c")
_TRIED = "SELECT user_id AS run, event_id AS nth, CASE event_id % 5 WHEN 0 THEN NULL ELSE event_id % 9000 END AS headers_ms, CASE event_id % 4 WHEN 0 THEN NULL ELSE event_id % 20000 END AS first_ms, CASE event_id % 6 WHEN 0 THEN 'unanswered' WHEN 1 THEN 'silent' WHEN 2 THEN 'ceiling' ELSE 'settled' END AS ended, event_id % 30000 AS ran_ms, event_id % 7 = 0 AS busy FROM {events} WHERE event_id % 13 = 0"


def diagnostics(turns):
    """A text for each run: a line for every attempt, and how many ran beside local work."""
    from .policy import seconds

    w = Window.partitionBy("run").orderBy("nth")
    when = lambda c, none, some: F.when(F.col(c).isNull(), none).otherwise(F.concat(F.lit(some), seconds(F.col(c))))
    line = F.concat(F.col("k").cast("string"), F.lit(". "), when("headers_ms", "no headers", "headers after "), F.lit(", "), when("first_ms", "no tokens", "first token after "), F.lit(", "), "ended", F.lit(" after "), seconds(F.col("ran_ms")), F.when(F.col("busy"), " · local work").otherwise(""))
    rows = turns.withColumn("k", F.row_number().over(w))
    out = rows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("lines"), F.count_if("busy").alias("busy"))
    return out.select("run", F.concat(F.lit("attempts "), F.size("lines").cast("string"), F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\nlocal work in "), F.col("busy").cast("string")).alias("report"))


_SEC = lambda c: f"CASE WHEN {c} < 10000 THEN (floor({c} / 100 + 0.5) / 10)::DECIMAL(10,1)::VARCHAR || 's' ELSE floor({c} / 1000 + 0.5)::BIGINT::VARCHAR || 's' END"
query("agg21_planner_report", lambda s, d: diagnostics(X.frame(s, d, _TRIED)), f"SELECT run, 'attempts ' || count(*)::VARCHAR || chr(10) || string_agg(k::VARCHAR || '. ' || CASE WHEN headers_ms IS NULL THEN 'no headers' ELSE 'headers after ' || {_SEC('headers_ms')} END || ', ' || CASE WHEN first_ms IS NULL THEN 'no tokens' ELSE 'first token after ' || {_SEC('first_ms')} END || ', ' || ended || ' after ' || {_SEC('ran_ms')} || CASE WHEN busy THEN ' · local work' ELSE '' END, chr(10) ORDER BY k) || chr(10) || 'local work in ' || (count(*) FILTER (busy))::VARCHAR AS report FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY nth) AS k FROM ({X.plain(_TRIED)})) GROUP BY run")
