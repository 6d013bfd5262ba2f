"""Queries on boxes, rankings, joins between findings and regions, and run statistics."""

from __future__ import annotations

from pyspark.sql import functions as _functions
from pyspark.sql.window import Window

from ..catalog import query, scalar
from ..functions import boxes as _boxes
from ..functions import masks as _masks
from ..functions.deferred import DeferredModule
from ..operators.suppression import suppressed
from . import fixtures as X

F = DeferredModule(_functions)
M = DeferredModule(_masks)
B = DeferredModule(_boxes)

A = B.Box(F.col("ax"), F.col("ay"), F.col("aw"), F.col("ah"))
O = B.Box(F.col("bx"), F.col("by_"), F.col("bw"), F.col("bh"))
_OV = "greatest(least(ax + aw, bx + bw) - greatest(ax, bx), 0) * greatest(least(ay + ah, by_ + bh) - greatest(ay, by_), 0)"
scalar("mth22_overlap_area", X.BOXES, area=(B.overlap(A, O), _OV))
scalar("str61_box_area", X.BOXES, area=(B.area(A), "aw * ah"))
scalar("fil48_box_contains", X.BOXES, inside=(B.contains(A, O), "bx >= ax - 8 AND by_ >= ay - 8 AND bx + bw <= ax + aw + 8 AND by_ + bh <= ay + ah + 8"))
scalar("joi09_regions_overlap", X.BOXES, meet=(B.touches(A, O), "ax <= bx + bw AND bx <= ax + aw AND ay <= by_ + bh AND by_ <= ay + ah"))
U = B.union(A, O)
scalar("set05_merge_rects", X.BOXES, x=(U.x, "least(ax, bx)"), y=(U.y, "least(ay, by_)"), width=(U.width, "greatest(ax + aw, bx + bw) - least(ax, bx)"), height=(U.height, "greatest(ay + ah, by_ + bh) - least(ay, by_)"))
scalar("joi06_covers_face", X.BOXES, covered=(F.when(B.area(A) == 0, True).otherwise((B.area(O) > 0) & (B.overlap(A, O) / F.nullif(F.least(B.area(A), B.area(O)), F.lit(0.0)) >= 0.3)), f"CASE WHEN aw * ah = 0 THEN true ELSE bw * bh > 0 AND {_OV} / least(aw * ah, bw * bh) >= 0.3 END"))
scalar("mth32_offset_boxes", X.BOXES, x=(F.col("ax") + F.col("bx"), "ax + bx"), y=(F.col("ay") + F.col("by_"), "ay + by_"))
scalar("mth27_normalised_rect", X.BOXES, x=(F.col("ax") / 1440, "ax / 1440"), y=(F.col("ay") / 900, "ay / 900"), width=(F.col("aw") / 1440, "aw / 1440"), height=(F.col("ah") / 900, "ah / 900"))
scalar("fil62_clamp_region", X.BOXES, x=(F.greatest(F.lit(0.0), F.floor("ax")).cast("long"), "greatest(0, floor(ax))::BIGINT"), width=(F.when(F.least(F.lit(80.0), F.ceil(F.col("ax") + F.col("aw"))) > F.floor("ax"), F.least(F.lit(80.0), F.ceil(F.col("ax") + F.col("aw"))) - F.floor("ax")).cast("long"), "(CASE WHEN least(80, ceil(ax + aw)) > floor(ax) THEN least(80, ceil(ax + aw)) - floor(ax) END)::BIGINT"))
_PIXELS = "SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_partkey % 256 AS INT) AS r, CAST(l_suppkey * 7 % 256 AS INT) AS g, CAST(l_orderkey * 3 % 256 AS INT) AS b FROM {lineitem}"


def skin(r, g, b):
    """By any of three rules: levels, shares of the sum, or blue and red difference."""
    total = F.nullif(r + g + b, F.lit(0))
    nr, ng, nb = r / total, g / total, b / total
    cb, cr = 128 - r * 0.168736 - g * 0.331264 + b * 0.5, 128 + r * 0.5 - g * 0.418688 - b * 0.081312
    levels = (r > 95) & (g > 40) & (b > 20) & (r > g) & (r > b) & (F.abs(r - g) > 15) & (r - b > 15)
    shares = (nr > 0.28) & (nr < 0.55) & (ng > 0.18) & (ng < 0.42) & (nb > 0.08) & (nb < 0.32) & (nr > nb)
    return F.coalesce(levels | shares | ((cb >= 77) & (cb <= 135) & (cr >= 130) & (cr <= 177)), F.lit(False))


scalar("mth46_skin_colour", _PIXELS, skin=(skin(F.col("r"), F.col("g"), F.col("b")), """CASE WHEN r + g + b = 0 THEN false ELSE (r > 95 AND g > 40 AND b > 20 AND r > g AND r > b AND abs(r - g) > 15 AND r - b > 15) OR (r / (r + g + b) > 0.28 AND r / (r + g + b) < 0.55 AND g / (r + g + b) > 0.18 AND g / (r + g + b) < 0.42 AND b / (r + g + b) > 0.08 AND b / (r + g + b) < 0.32 AND r > b)
  OR (128 - r * 0.168736::DOUBLE - g * 0.331264::DOUBLE + b * 0.5::DOUBLE BETWEEN 77 AND 135 AND 128 + r * 0.5::DOUBLE - g * 0.418688::DOUBLE - b * 0.081312::DOUBLE BETWEEN 130 AND 177) END"""))

# regions (from parts) and boxes (from lines) of one page: an order is a page
_REGIONS = "SELECT l_orderkey AS page, l_linenumber AS n, CAST(l_partkey % 97 AS DOUBLE) AS x, CAST(l_suppkey % 53 AS DOUBLE) AS y, CAST(l_partkey % 41 + 5 AS DOUBLE) AS w, CAST(l_orderkey % 37 + 5 AS DOUBLE) AS h, l_linenumber % 2 AS region, l_quantity AS conf FROM {lineitem}"


def _boxes(s, d):
    return X.frame(s, d, _REGIONS)


def uncovered(boxes, regions, share):
    """Boxes of a page without a region that covers `share` of them: a theta join within pages, as an anti join."""
    b, r = boxes.alias("b"), regions.alias("r")
    w = F.greatest(F.least(F.col("b.x") + F.col("b.w"), F.col("r.x") + F.col("r.w")) - F.greatest("b.x", "r.x"), F.lit(0.0))
    h = F.greatest(F.least(F.col("b.y") + F.col("b.h"), F.col("r.y") + F.col("r.h")) - F.greatest("b.y", "r.y"), F.lit(0.0))
    return b.join(r, (F.col("b.page") == F.col("r.page")) & (w * h >= share * F.col("b.w") * F.col("b.h")), "left_anti")


_UNC = "WITH fx AS (" + X.plain(_REGIONS) + ") SELECT page, n, x, y, w, h FROM fx b WHERE region = 0 AND NOT EXISTS (SELECT 1 FROM fx r WHERE r.page = b.page AND r.region = 1 AND greatest(least(b.x + b.w, r.x + r.w) - greatest(b.x, r.x), 0) * greatest(least(b.y + b.h, r.y + r.h) - greatest(b.y, r.y), 0) >= {} * b.w * b.h)"
for _name, _share in (("joi07_drop_covered", 0.5), ("joi08_uncovered_faces", 0.5), ("mth34_secondary_detector", 0.3)):
    query(_name, lambda s, d, share=_share: uncovered(_boxes(s, d).filter("region = 0"), _boxes(s, d).filter("region = 1"), share).select("page", "n", "x", "y", "w", "h"), _UNC.format(_share))
query("agg24_union_box", lambda s, d: _boxes(s, d).groupBy("page").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h")), f"SELECT page, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM ({X.plain(_REGIONS)}) GROUP BY page")
query("agg25_line_confidence", lambda s, d: _boxes(s, d).groupBy("page").agg(F.coalesce(F.avg(F.when(F.col("region") == 1, F.col("conf"))), F.lit(100.0)).alias("confidence")), f"SELECT page, coalesce(avg(conf) FILTER (region = 1), 100) AS confidence FROM ({X.plain(_REGIONS)}) GROUP BY page")
query("top11_cap_boxes", lambda s, d: _boxes(s, d).withColumn("rn", F.row_number().over(Window.partitionBy("page").orderBy("y", "x", "n"))).groupBy("page").agg(F.count_if(F.col("rn") <= 4).alias("kept"), F.count_if(F.col("rn") > 4).alias("dropped")), f"SELECT page, count(*) FILTER (rn <= 4) AS kept, count(*) FILTER (rn > 4) AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, n) AS rn FROM ({X.plain(_REGIONS)})) GROUP BY page")
query("top12_area_then_confidence", lambda s, d: _boxes(s, d).withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy(F.desc(F.col("w") * F.col("h")), F.desc("conf"), "n"))).select("page", "n", "rank"), f"SELECT page, n, row_number() OVER (PARTITION BY page ORDER BY w * h DESC, conf DESC, n) AS rank FROM ({X.plain(_REGIONS)})")


query("set02_dedupe_boxes", lambda s, d: suppressed(_boxes(s, d)))

# ranking of texts against a query: exact, prefix, word, substring
_RUNS = "SELECT p_partkey AS id, p_name AS text, p_type AS label, p_size AS y, p_partkey % 100 AS x FROM {part}"
_Q = "co"


def score(text, q):
    t = M.normal_for_match(text)
    return F.when(t == q, 100).when(F.startswith(t, F.lit(q)), 80).when(F.array_contains(F.split(t, "[^a-z0-9]+"), q), 60).when(t.contains(q), 40)


_SC = "CASE WHEN lower(trim({0})) = '{1}' THEN 100 WHEN starts_with(lower(trim({0})), '{1}') THEN 80 WHEN list_contains(string_split_regex(lower(trim({0})), '[^a-z0-9]+'), '{1}') THEN 60 WHEN contains(lower(trim({0})), '{1}') THEN 40 END"
scalar("top01_score_text", _RUNS, score=(score(F.col("text"), "bolt"), _SC.format("text", "bolt")))
scalar("top05_score_field", _RUNS, score=(F.greatest(score(F.col("text"), "small"), score(F.col("label"), "small")), f"greatest({_SC.format('text', 'small')}, {_SC.format('label', 'small')})"))
for _name, _col, _word in (("top02_rank_texts", "text", "bolt"), ("top06_rank_fields", "label", "small"), ("top08_rank_affordances", "label", "pro")):
    query(_name, lambda s, d, c=_col, q=_word: X.frame(s, d, _RUNS).withColumn("score", score(F.col(c), q)).filter("score IS NOT NULL").orderBy(F.desc("score"), "y", "x", "id").limit(50).select("id", "score"),
          f"SELECT id, score FROM (SELECT *, {_SC.format(_col, _word)} AS score FROM ({X.plain(_RUNS)})) WHERE score IS NOT NULL ORDER BY score DESC, y, x, id LIMIT 50")
for _name, _n in (("top03_pick_text", 3), ("top04_pick_ranked", 1), ("top07_pick_field", 2)):
    query(_name, lambda s, d, n=_n: X.frame(s, d, _RUNS).withColumn("score", score(F.col("label"), "small")).filter("score IS NOT NULL").orderBy(F.desc("score"), "y", "x", "id").offset(n - 1).limit(1).select("id", "score"),
          f"SELECT id, score FROM (SELECT *, {_SC.format('label', 'small')} AS score FROM ({X.plain(_RUNS)})) WHERE score IS NOT NULL ORDER BY score DESC, y, x, id LIMIT 1 OFFSET {_n - 1}")

# findings (typed values) against regions that show them
_TARGETS = "SELECT c_custkey AS id, c_custkey % 40 AS page, CASE WHEN c_custkey % 6 = 0 THEN 'x' ELSE ' ' || c_mktsegment || CAST(c_custkey % 200 AS STRING) || ' ' END AS value, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 30 END AS selector FROM {customer}"
_SHOWN = "SELECT s_suppkey AS id, s_suppkey % 40 AS page, 'BUILDING' || CAST(s_suppkey % 200 AS STRING) AS value, s_suppkey % 17 AS selector FROM {supplier}"


def _pair(s, d):
    return X.frame(s, d, _TARGETS).withColumn("value", F.trim("value")), X.frame(s, d, _SHOWN)


_TS = f"WITH t AS (SELECT id, page, trim(value) AS value, selector FROM ({X.plain(_TARGETS)})), r AS ({X.plain(_SHOWN)})"
query("set01_pii_targets", lambda s, d: _pair(s, d)[0].filter(F.length("value").between(3, 80) | F.col("selector").isNotNull()).groupBy("value", "selector").agg(F.min("id").alias("first")).orderBy("first").limit(24), _TS + " SELECT value, selector, min(id) AS first FROM t WHERE length(value) BETWEEN 3 AND 80 OR selector IS NOT NULL GROUP BY value, selector ORDER BY first LIMIT 24")
query("joi03_unlocated_values", lambda s, d: _pair(s, d)[0].select("value").distinct().join(_pair(s, d)[1], "value", "left_anti"), _TS + " SELECT DISTINCT value FROM t WHERE value NOT IN (SELECT value FROM r)")
query("joi04_unplaced_values", lambda s, d: _pair(s, d)[0].filter("page % 2 = 0").select("page", "value").distinct().join(_pair(s, d)[1], ["page", "value"], "left_anti"), _TS + " SELECT DISTINCT page, value FROM t WHERE page % 2 = 0 AND NOT EXISTS (SELECT 1 FROM r WHERE r.page = t.page AND r.value = t.value)")


def _unverified(s, d):
    t, r = _pair(s, d)
    left = t.join(r.select("value"), "value", "left_anti").join(r.select("selector").filter("selector IS NOT NULL"), "selector", "left_anti")
    return left.select("id", F.when(F.col("selector").isNull() & (F.length("value") < 3), "unattributable").otherwise("unaccounted").alias("state"))


query("joi05_unverified_targets", _unverified, _TS + " SELECT id, CASE WHEN selector IS NULL AND length(value) < 3 THEN 'unattributable' ELSE 'unaccounted' END AS state FROM t WHERE value NOT IN (SELECT value FROM r) AND (selector IS NULL OR selector NOT IN (SELECT selector FROM r WHERE selector IS NOT NULL))")
query("src10_locate_spans", lambda s, d: X.frame(s, d, X.DOCS).join(F.broadcast(s.sql("SELECT explode(array('that', 'nicht', 'pour', 'zzz')) AS span")), F.col("text").contains(F.col("span"))).groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.min(F.instr("text", F.col("span"))).alias("first")), f"SELECT span, count(*) AS n, min(strpos(text, span)) AS first FROM ({X.plain(X.DOCS)}), (VALUES ('that'), ('nicht'), ('pour'), ('zzz')) AS v(span) WHERE contains(text, span) GROUP BY span")
query("src11_locate_elements", lambda s, d: X.frame(s, d, X.ELEMENTS).join(_pair(s, d)[0].select(F.col("selector").alias("id")).filter("id IS NOT NULL").distinct(), "id").select("id", "name", "value"), _TS + f" SELECT id, name, value FROM ({X.plain(X.ELEMENTS)}) WHERE id IN (SELECT selector FROM t WHERE selector IS NOT NULL)")
query("src28_lookup_element", lambda s, d: X.frame(s, d, X.ELEMENTS).select("page_id", "id").join(_pair(s, d)[1].select(F.col("page").alias("page_id"), F.col("id").alias("want")), "page_id", "right").groupBy("want").agg(F.max((F.col("id") == F.col("want")).cast("int")).alias("hit"), F.count("id").alias("n")).select("want", F.when(F.col("hit") == 1, "found").when(F.col("n") > 0, "stale").otherwise("missing").alias("state")), _TS + f" SELECT want, CASE WHEN max((e.id = want)::INT) = 1 THEN 'found' WHEN count(e.id) > 0 THEN 'stale' ELSE 'missing' END AS state FROM (SELECT id AS want, page FROM r) q LEFT JOIN ({X.plain(X.ELEMENTS)}) e ON e.page_id = q.page GROUP BY want")
query("joi01_redact_elements", lambda s, d: X.frame(s, d, X.ELEMENTS).select("id", F.when(F.col("name").rlike("(?i)password|card"), F.when(F.col("value").rlike("^<[A-Z]+_[0-9]+>$"), F.col("value")).otherwise(F.when(F.col("value").isNotNull(), "[REDACTED]"))).otherwise(F.col("value")).alias("value")), f"SELECT id, CASE WHEN regexp_matches(name, '(?i)password|card') THEN CASE WHEN regexp_full_match(value, '<[A-Z]+_[0-9]+>') THEN value WHEN value IS NOT NULL THEN '[REDACTED]' END ELSE value END AS value FROM ({X.plain(X.ELEMENTS)})")

# metrics
scalar("agg03_accuracy", "SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity - 5 AS tp, l_partkey % 3 - 1 AS fp, l_suppkey % 3 - 1 AS fn FROM {lineitem}",
       precision=(F.try_divide(F.greatest("tp", F.lit(0)), F.nullif(F.greatest("tp", F.lit(0)) + F.greatest(F.col("fp"), F.lit(0)), F.lit(0))), "greatest(tp, 0) / nullif(greatest(tp, 0) + greatest(fp, 0), 0)"),
       recall=(F.try_divide(F.greatest("tp", F.lit(0)), F.nullif(F.greatest("tp", F.lit(0)) + F.greatest(F.col("fn"), F.lit(0)), F.lit(0))), "greatest(tp, 0) / nullif(greatest(tp, 0) + greatest(fn, 0), 0)"))
_TALLY = "SELECT l_orderkey AS id, sum(l_quantity) AS page, sum(l_linenumber) - 4 AS frames, count(*) AS tokens FROM {lineitem} GROUP BY l_orderkey"
scalar("agg04_redaction_tally", _TALLY, page_items=(F.greatest(F.lit(0), F.floor(F.col("page") + 0.5)), "greatest(0, floor(page + 0.5))::BIGINT"), frame_regions=(F.greatest(F.lit(0), F.col("frames")), "greatest(0, frames)::BIGINT"), total=(F.greatest(F.lit(0), F.floor(F.col("page") + 0.5)) + F.greatest(F.lit(0), F.col("frames")), "(greatest(0, floor(page + 0.5)) + greatest(0, frames))::BIGINT"))
scalar("agg05_describe_tally", _TALLY, text=(F.concat(F.greatest(F.lit(0), F.col("frames")).cast("string"), F.when(F.greatest(F.lit(0), F.col("frames")) == 1, " region").otherwise(" regions"), F.lit(", "), F.col("tokens").cast("string"), F.when(F.col("tokens") == 1, " token").otherwise(" tokens")), "greatest(0, frames)::BIGINT::VARCHAR || CASE WHEN greatest(0, frames) = 1 THEN ' region' ELSE ' regions' END || ', ' || tokens::VARCHAR || CASE WHEN tokens = 1 THEN ' token' ELSE ' tokens' END"))
query("agg23_kinds_with_total", lambda s, d: X.table(s, d, "events").rollup("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("event_type", F.lit("ALL")).alias("kind"), "n"), "SELECT coalesce(event_type, 'ALL') AS kind, count(*) AS n FROM events GROUP BY ROLLUP(event_type)")
query("agg06_frame_rollup", lambda s, d: X.table(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("verified"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("value").isNull()).alias("unchecked"), F.bool_and(F.col("event_type") != "error").alias("all_verified"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds")),
      "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS verified, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value IS NULL) AS unchecked, bool_and(event_type <> 'error') AS all_verified, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY user_id")
_ALERTS = "SELECT event_id, event_type AS pii_type, 'h' || CAST(user_id % 20 AS STRING) || '.example' AS host, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 3 = 0 END AS third FROM {events}"
query("agg07_alerts_by_host", lambda s, d: X.frame(s, d, _ALERTS).groupBy("host", "pii_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("third", F.lit(True))).alias("third_party")), f"SELECT host, pii_type, count(*) AS total, count(*) FILTER (coalesce(third, true)) AS third_party FROM ({X.plain(_ALERTS)}) GROUP BY host, pii_type")
query("agg07_alert_summary", lambda s, d: X.frame(s, d, _ALERTS).groupBy("pii_type").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "pii_type"))), lambda x: F.concat(x["pii_type"], F.lit(" "), (-x["k"]).cast("string"))), ", ").alias("summary")), f"SELECT string_agg(pii_type || ' ' || n::VARCHAR, ', ' ORDER BY n DESC, pii_type) AS summary FROM (SELECT pii_type, count(*) AS n FROM ({X.plain(_ALERTS)}) GROUP BY pii_type)")
_FACTS = "SELECT event_id AS id, event_id % 2 = 0 AS faces, event_id % 3 = 0 AS final, event_id % 5 = 0 AS policy, event_id % 4 AS residual FROM {events}"
_REASONS = F.array_compact(F.array(F.when(~F.col("faces"), "no face scan"), F.when(~F.col("final"), "no final scan"), F.when(~F.col("policy"), "policy off"), F.when(F.col("residual") > 0, "residual detections")))
_REASONS_SQL = "list_filter([CASE WHEN NOT faces THEN 'no face scan' END, CASE WHEN NOT final THEN 'no final scan' END, CASE WHEN NOT policy THEN 'policy off' END, CASE WHEN residual > 0 THEN 'residual detections' END], lambda x: x IS NOT NULL)"
scalar("agg15_protection", _FACTS, reasons=(F.array_join(_REASONS, "; "), f"array_to_string({_REASONS_SQL}, '; ')"))
scalar("agg18_send_decision", _FACTS, allowed=(F.size(_REASONS) == 0, f"len({_REASONS_SQL}) = 0"), reasons=(F.array_join(F.array_distinct(_REASONS), "; "), f"array_to_string({_REASONS_SQL}, '; ')"))
scalar("agg19_escalation", _FACTS, escalate=((F.col("residual") > 1) | ~F.col("faces"), "residual > 1 OR NOT faces"))


_WAITS = "SELECT user_id, count(*) AS turns, sum(CASE WHEN value > 80 THEN 1 ELSE 0 END) AS slow, max(value) AS longest FROM {events} GROUP BY user_id"
scalar("agg22_speed_up", _WAITS, ("user_id",), switch=((F.col("slow") >= 2) | (F.col("longest") >= 200), "slow >= 2 OR longest >= 200"))
