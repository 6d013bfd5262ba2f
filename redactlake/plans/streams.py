"""Queries on parsed pages, and on turns, chunks and windows of event streams in their stored form."""

from __future__ import annotations

from pyspark.sql import functions as _functions
from pyspark.sql.window import Window

from ..catalog import query
from ..functions import masks as _masks
from ..functions.deferred import DeferredModule
from ..operators import spans as _spans
from ..sources import html as H
from ..sources import store
from ..streaming import alerts as A
from ..streaming import turns as TU
from . import fixtures as X
from . import learning as LN
from . import pages as G
from .policy import _QUOTED
from .tables import score

F = DeferredModule(_functions)
M = DeferredModule(_masks)
S = DeferredModule(_spans)


def _pages(s, d):
    return X.table(s, d, "pages")


def _snapshots(s, d):
    return H.snapshots(_pages(s, d))


#: What the generated pages lack, put at their end.
_FORM = """<form><label for="u">User name</label><input id="u" name="user" value="Anita Rao" required><label>Pass <input type="password" name="pw" value="x"></label><p>Card</p><input name="cardNumber" autocomplete="cc-number" value="4111 1111 1111 1111"><input name="q" placeholder="Search all"><input type="checkbox" checked name="agree"><button aria-expanded="true" disabled title="Send it">Send</button><select name="s"><option>One</option><option selected>Two</option></select><img src="/avatar.png" alt="profile of A"><span email="a.b@x.example">A</span><a href="https://h.example/a/path?x=1" aria-label="Account">me</a><input type="submit" value="Save all"></form><p>Mail a.b@x.example or 98765 43210</p>"""


def _forms(s, d):
    return _pages(s, d).select("page_id", "url", F.concat("html", F.lit(_FORM)).alias("html"))


query("src01_snapshots", lambda s, d: _snapshots(s, d).select("page_id", "url", "title", F.size("elements").alias("n_elements"), "text"))
query("src02_page_text", lambda s, d: _snapshots(s, d).select("page_id", "text"))
query("src03_accessible_names", lambda s, d: H.all_controls(_forms(s, d)).select("page_id", F.inline("controls")).select("page_id", "id", "name"))
query("src04_layout_labels", lambda s, d: H.all_controls(_forms(s, d)).select("page_id", F.inline("controls")).select("page_id", "id", "layout"))
query("src05_roles", lambda s, d: H.all_controls(_forms(s, d)).select("page_id", F.inline("controls")).select("page_id", "id", "role"))
query("src06_attributes", lambda s, d: H.all_controls(_forms(s, d)).select("page_id", F.inline("controls")).select("page_id", "id", F.explode("attrs").alias("name", "value")))
query("src08_sensitive_regions", lambda s, d: H.sensitive_regions(_forms(s, d)).select("page_id", F.inline("regions")))


def text_regions(pages):
    """Personal data in the first text nodes of a page; so many regions at most, in order."""
    rows = H.text_nodes(pages).select("page_id", F.posexplode(F.slice("texts", 1, H.MOST_NODES)).alias("node", "text")).filter(F.length("text") >= 6)
    found = rows.select("page_id", "node", F.inline(S.resolved(F.col("text"))))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("node", "start", F.desc("end"), "emit_ord"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= H.MOST_REGIONS).select("page_id", "nth", "node", F.concat("kind", F.lit("_text")).alias("kind"), F.concat("label", F.lit(" in text")).alias("label"), "value")


query("src09_text_regions", lambda s, d: text_regions(_forms(s, d)))


def ranked_affordances(pages, word):
    rows = H.affordance_runs(pages).select("page_id", F.inline("affordances")).withColumn("score", score(F.col("label"), word)).filter("score IS NOT NULL")
    shown = F.concat("label", F.lit(" ["), "source", F.lit("]"))
    return rows.groupBy("page_id", shown.alias("shown"), "score").agg(F.min("nth").alias("nth"))


def found_texts(pages, word, pool=24, most=5):
    """The best of the first texts that match word and of the controls so named: by how they match, then the shorter."""
    rows = H.text_nodes(pages).select("page_id", F.posexplode(F.array_distinct("texts")).alias("n", "text")).withColumn("score", score(F.col("text"), word)).filter("score IS NOT NULL")
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("n"))).filter(F.col("k") <= pool).select("page_id", F.substring("text", 1, 200).alias("text"), "score", "n")
    both = first.unionByName(ranked_affordances(pages, word).select("page_id", F.col("shown").alias("text"), "score", (F.col("nth") + 1_000_000).alias("n")))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), F.length("text"), "n"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= most).select("page_id", "rank", "text", "score")


query("top10_affordances", lambda s, d: ranked_affordances(_forms(s, d), "a").select("page_id", "shown", "score"))
query("top09_find_text", lambda s, d: found_texts(_forms(s, d), "the"))


def rendered(snapshots):
    """The text of each snapshot: a line for every element, with what is too long cut."""
    cut = lambda c, n: _QUOTED(F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c))
    attrs = lambda e: F.array_join(F.transform(F.map_entries(e["attrs"]), lambda a: F.concat(a["key"], F.lit("="), a["value"])), " ")
    line = lambda e: F.concat(F.lit("["), e["id"].cast("string"), F.lit("]"), e["role"], F.when(e["name"] != "", F.concat(F.lit(" "), cut(e["name"], 40))).otherwise(""), F.when(F.coalesce(e["value"], F.lit("")) != "", F.concat(F.lit(" ="), cut(e["value"], 30))).otherwise(""), F.when(F.size(e["attrs"]) > 0, F.concat(F.lit(" ("), attrs(e), F.lit(")"))).otherwise(""))
    return snapshots.select("page_id", F.concat(F.lit("URL: "), G.U.sanitized(F.col("url")), F.lit("\nTitle: "), "title", F.lit("\nElements:\n"), F.array_join(F.transform("elements", line), "\n"), F.lit("\nText: "), "text").alias("shown"))


query("str52_render_snapshot", lambda s, d: rendered(H.snapshots(_forms(s, d))))


def _alerts(s, d):
    return X.table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string")).alias("host"), F.col("event_type").alias("pii_type"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 3 == 0).alias("third"))


query("agg07_alert_windows", lambda s, d: A.alert_counts(_alerts(s, d)).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "host", "pii_type", "total", "third_party"),
      "SELECT strftime(ts, '%Y-%m-%d') AS day, 'h' || (user_id % 20)::VARCHAR AS host, event_type AS pii_type, count(*) AS total, count(*) FILTER (CASE WHEN event_id % 5 <> 0 THEN event_id % 3 = 0 ELSE true END) AS third_party FROM events GROUP BY 1, 2, 3")

# --- turns ---------------------------------------------------------------------------------
_OUTPUT = "SELECT CAST((event_id - event_id % 12) / 12 AS BIGINT) AS turn, event_id % 12 AS nth, CAST((event_id % 12) * (500 + (event_id - event_id % 12) % 7 * 4000) + CASE WHEN (event_id - event_id % 12) % 5 = 0 THEN 26000 ELSE 0 END AS BIGINT) AS at_ms, CASE WHEN event_id % 12 = 0 THEN 'headers' WHEN event_id % 12 = 11 THEN CASE WHEN event_id % 5 < 3 THEN 'done' ELSE 'text' END WHEN (event_id - event_id % 12) % 4 = 0 THEN 'reasoning' ELSE 'text' END AS kind, repeat(event_type || ' ', CAST(event_id % 3 * 90 AS INT)) AS text FROM {events}"


def _output(s, d):
    return X.frame(s, d, _OUTPUT).withColumnRenamed("at_ms", "at")


query("stm01_turn_budget", lambda s, d: TU.turns(_output(s, d)).drop("tail"))
query("stm02_output_tail", lambda s, d: _output(s, d).filter("kind = 'text'").groupBy("turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "").alias("all")).select("turn", F.when(F.length("all") > TU.TAIL, F.substring("all", -TU.TAIL, TU.TAIL)).otherwise(F.col("all")).alias("tail")),
      f"SELECT turn, right(string_agg(text, '' ORDER BY nth), {TU.TAIL}) AS tail FROM ({X.plain(_OUTPUT)}) WHERE kind = 'text' GROUP BY turn")
_CHANGES = "SELECT user_id AS action, CAST((event_id * 37 + event_id % 13 * 91) % 3600 AS BIGINT) AS ms FROM {events} WHERE event_id % 3 = 0"


def settled(changes, start=250, quiet=120, ceiling=3000):
    """When a page came to rest after an action: after the first quiet gap, which is longer before the first change, and at the ceiling at the latest."""
    w = Window.partitionBy("action").orderBy("ms")
    rows = changes.distinct().withColumn("next", F.lead("ms").over(w)).withColumn("n", F.row_number().over(w))
    ends = rows.withColumn("rest", F.when((F.col("n") == 1) & (F.col("ms") > start), F.lit(start)).when(F.coalesce(F.col("next") - F.col("ms") > quiet, F.lit(True)), F.col("ms") + quiet))
    return ends.groupBy("action").agg(F.least(F.min("rest"), F.lit(ceiling)).alias("settled_ms"))


query("stm05_settle", lambda s, d: settled(X.frame(s, d, _CHANGES)), f"SELECT action, least(min(CASE WHEN n = 1 AND ms > 250 THEN 250 WHEN coalesce(next - ms > 120, true) THEN ms + 120 END), 3000) AS settled_ms FROM (SELECT *, lead(ms) OVER (PARTITION BY action ORDER BY ms) AS next, row_number() OVER (PARTITION BY action ORDER BY ms) AS n FROM (SELECT DISTINCT * FROM ({X.plain(_CHANGES)}))) GROUP BY action")
_ASKED = "SELECT event_id AS id, event_id * 10 AS asked FROM {events} WHERE event_id % 2 = 0"
_GOT = "SELECT event_id AS id, event_id * 10 + event_id % 9 * 700 AS got, event_type AS evidence FROM {events} WHERE event_id % 6 <> 4"


def joined(asked, got, within=3000):
    """Evidence that came in time, or null. Over streams both sides need watermarks."""
    return asked.join(got, "id", "left").select("id", F.when(F.col("got") - F.col("asked") <= within, F.col("evidence")).alias("evidence"))


query("stm06_join_evidence", lambda s, d: joined(X.frame(s, d, _ASKED), X.frame(s, d, _GOT)), f"SELECT a.id, CASE WHEN got - asked <= 3000 THEN evidence END AS evidence FROM ({X.plain(_ASKED)}) a LEFT JOIN ({X.plain(_GOT)}) g ON g.id = a.id")
_BYTES = "SELECT user_id AS stream, event_id AS nth, CAST(event_id % 11 AS BIGINT) AS n FROM {events}"


def aligned(chunks):
    """Bytes of whole 16-bit samples that each chunk completes, with the odd byte before it, and the odd byte that it leaves."""
    w = Window.partitionBy("stream").orderBy("nth")
    total = F.sum("n").over(w)
    return chunks.select("stream", "nth", (F.col("n") + (total - F.col("n")) % 2 - total % 2).alias("aligned"), (total % 2).alias("rest"))


query("stm07_drain_aligned", lambda s, d: aligned(X.frame(s, d, _BYTES)), f"SELECT stream, nth, (n + (total - n) % 2 - total % 2)::BIGINT AS aligned, (total % 2)::BIGINT AS rest FROM (SELECT *, sum(n) OVER (PARTITION BY stream ORDER BY nth) AS total FROM ({X.plain(_BYTES)}))")
_PARTS = "SELECT CAST((event_id - event_id % 10) / 10 AS BIGINT) AS stream, event_id % 10 AS nth, CASE event_id % 5 WHEN 0 THEN chr(123) || '\"delta\": \"a' WHEN 1 THEN event_type || '\"' || chr(125) || chr(10) || 'broken ' || chr(123) WHEN 2 THEN chr(10) || chr(123) || '\"delta\": \"b\"' || chr(125) WHEN 3 THEN chr(10) || chr(10) ELSE chr(123) || '\"done\": true' || chr(125) || chr(10) END AS text FROM {events}"


def streamed_lines(parts):
    """Text of each stream from the JSON lines in its chunks: a line may run over several chunks, lines that are no JSON are passed over."""
    whole = parts.groupBy("stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "").alias("all"))
    deltas = F.transform(F.filter(F.split("all", "\n"), lambda x: x != ""), lambda x: F.try_variant_get(F.try_parse_json(x), "$.delta", "string"))
    return whole.select("stream", F.array_join(F.array_compact(deltas), "").alias("text"), F.size(F.array_compact(deltas)).alias("n"))


query("src22_stream_lines", lambda s, d: streamed_lines(X.frame(s, d, _PARTS)), f"SELECT stream, array_to_string(ds, '') AS text, len(ds) AS n FROM (SELECT stream, list_filter(list_transform(list_filter(string_split(string_agg(text, '' ORDER BY nth), chr(10)), lambda x: x <> ''), lambda x: CASE WHEN json_valid(x) THEN json_extract_string(x, '$.delta') END), lambda x: x IS NOT NULL) AS ds FROM ({X.plain(_PARTS)}) GROUP BY stream)")

# --- what is kept between runs ------------------------------------------------------------------


def _stored(s, d):
    folder = store.shared_folder(s)
    rules, runs = X.frame(s, d, LN._RULES).select("id", "category"), LN.runs(s, d).select("id", "domain")
    told = store.persisted({"rules": rules, "runs": runs}, folder)
    counts = [store.loaded(s, folder, k, "id long").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("item"), F.lit(ok).alias("written"), "n") for k, ok in told.items()]
    return counts[0].union(counts[1])


query("src16_persisted", _stored, f"SELECT 'rules' AS item, true AS written, (SELECT count(*) FROM ({LN._RU})) AS n UNION ALL SELECT 'runs', true, (SELECT count(*) FROM ({LN._R}))")
