"""Reversible token vaults: values to tokens and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKEN = r"<[A-Z]+_[0-9]+>|(?<![A-Za-z0-9_])[A-Z]+_[0-9]+(?![A-Za-z0-9_])"


def prefix_of(kind, label):
    return (
        F.when(kind == "name_text", "PII").when(kind.isin("email", "phone", "credential"), "CRED").when(kind == "api_key", "KEY")
        .when(label.rlike("(?i)card|ssn"), "CRED").otherwise("ID")
    )


def vault(spans: DataFrame) -> DataFrame:
    """vault, value, token, prefix from spans (vault, id, start, kind, label, value).

    A value has one token in a vault, of the kind of its first sighting; numbers run
    by prefix in order of first sighting. The first sightings are aggregated before
    they are numbered.
    """
    first = spans.groupBy("vault", "value").agg(F.min(F.struct("id", "start", prefix_of(F.col("kind"), F.col("label")).alias("prefix"))).alias("f"))
    rows = first.select("vault", "value", "f.*")
    n = F.row_number().over(Window.partitionBy("vault", "prefix").orderBy("id", "start"))
    return rows.select("vault", "value", F.concat(F.lit("<"), "prefix", F.lit("_"), n.cast("string"), F.lit(">")).alias("token"), "prefix")


def tokenized(texts: DataFrame, spans: DataFrame, entries: DataFrame) -> DataFrame:
    """id, sanitized, n_tokens: every span of a text replaced by its token, left to right."""
    known = spans.join(entries.select("vault", "value", "token"), ["vault", "value"])
    parts = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "token"))).alias("parts"))
    text = F.col("text")
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    done = F.aggregate("parts", zero, lambda acc, s: F.struct((-s["back"]).cast("int").alias("pos"), F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.greatest(s["start"] - acc["pos"], F.lit(0))), s["token"]).alias("out")))
    out = texts.join(parts, "id", "left").withColumn("done", F.when(F.col("parts").isNotNull(), done))
    return out.select("id", F.when(F.col("done").isNull(), text).otherwise(F.concat("done.out", F.substring(text, F.col("done.pos") + 1, F.length(text)))).alias("sanitized"), F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("n_tokens"))


def small_vault(spark: SparkSession) -> DataFrame:
    """A vault of fixed entries, for the queries."""
    return spark.sql("SELECT '<' || p || '_' || i || '>' AS token, lower(p) || ' value ' || i AS original FROM VALUES ('CRED'), ('PII'), ('ID'), ('KEY') AS t(p) CROSS JOIN (SELECT explode(sequence(1, 4)) AS i)")


def resolved(texts: DataFrame, entries: DataFrame, key: str = "id") -> DataFrame:
    """Texts with known tokens, also without their brackets, replaced by their values."""
    whole = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    parts = texts.select(key, F.split("text", TOKEN, -1).alias("gaps"), whole.alias("wholes")).select(key, "wholes", F.posexplode("gaps").alias("n", "gap"))
    rows = parts.withColumn("whole", F.get("wholes", F.col("n"))).withColumn("name", F.regexp_replace("whole", "[<>]", ""))
    known = entries.select(F.regexp_replace("token", "[<>]", "").alias("name"), "original")
    pieces = rows.join(known, "name", "left").withColumn("piece", F.concat("gap", F.coalesce("original", "whole", F.lit(""))))
    return pieces.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "").alias("text"))


#: What is no part of a word, of letters and of letters, marks and digits.
_LETTER_EDGE, _WORD_EDGE = r"[^\p{L}\p{M}]", r"[^\p{L}\p{M}0-9_]"


def quoted(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))


def letters_only(value: Column) -> Column:
    return value.rlike(r"^[\p{L}\p{M} ]+$")


def put(text: Column, value: Column, token: Column) -> Column:
    """text with value written as token: as whole words if it has letters only."""
    words = F.regexp_replace(text, F.concat(F.lit(f"(^|{_LETTER_EDGE})"), quoted(value), F.lit(f"(?=$|{_LETTER_EDGE})")), F.concat(F.lit("$1"), token))
    return F.when(letters_only(value), words).otherwise(F.replace(text, value, token))


def mask_word(text: Column, value: Column, placeholder: str) -> Column:
    """value, as whole words in any case, becomes the placeholder."""
    return F.regexp_replace(text, F.concat(F.lit(f"(?iu)(^|{_WORD_EDGE})"), quoted(value), F.lit(f"(?=$|{_WORD_EDGE})")), F.lit("$1" + placeholder))


def longest_first(entries: Column) -> Column:
    """Entries (value, token) of four characters and more."""
    return F.array_sort(F.filter(entries, lambda e: F.length(e["value"]) >= 4), lambda a, b: F.when(F.length(a["value"]) != F.length(b["value"]), F.length(b["value"]) - F.length(a["value"])).when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0))


def swept(text: Column, entries: Column, digits: bool = False) -> Column:
    """text with the values of a vault, longest first, written as tokens; with digits, six and more of them match through separators too."""

    def step(acc, e):
        bare = F.regexp_replace(e["value"], "[^0-9]", "")
        run = F.concat(F.lit("(?<![0-9])"), F.regexp_replace(bare, "([0-9])", r"$1[\\s\\-._/]?"), F.lit("(?![0-9])"))
        loose = F.when(F.length(bare) >= 6, F.regexp_replace(acc, run, e["token"])).otherwise(acc) if digits else acc
        return F.when(F.contains(acc, e["value"]), put(acc, e["value"], e["token"])).otherwise(loose)

    return F.aggregate(longest_first(entries), text, step)


def detections_written(element: Column, text: Column, found: Column) -> Column:
    """element, text, n after the detections (kind, value, here) of a snapshot are written as tokens, one after the other.

    Tokens are numbered by prefix in order of first use; a value keeps its token. Values
    of four characters and more go from the text, any from the element that has them.
    """
    prefix = lambda k: F.when(k.isin("pii_text", "person", "organization"), "PII").when(k == "id_number", "ID").when(k == "api_key", "KEY").otherwise("CRED")
    zero = F.struct(element.alias("element"), text.alias("text"), F.lit(0).alias("n"), F.array().cast("array<struct<value: string, prefix: string, token: string>>").alias("seen"))

    def write(acc, d, token, seen):
        here = F.when(d["here"] & F.contains(acc["element"], d["value"]) & ~acc["element"].rlike(r"^<[A-Z]+_[0-9]+>$"), put(acc["element"], d["value"], token)).otherwise(acc["element"])
        there = F.when((F.length(d["value"]) >= 4) & F.contains(acc["text"], d["value"]), put(acc["text"], d["value"], token)).otherwise(acc["text"])
        hit = (~here.eqNullSafe(acc["element"])) | (there != acc["text"])
        return F.struct(here.alias("element"), there.alias("text"), (acc["n"] + hit.cast("int")).alias("n"), seen.alias("seen"))

    def step(acc, d):
        known = F.get(F.filter(acc["seen"], lambda e: e["value"] == d["value"]), F.lit(0))
        name = F.concat(F.lit("<"), prefix(d["kind"]), F.lit("_"), (F.size(F.filter(acc["seen"], lambda e: e["prefix"] == prefix(d["kind"]))) + 1).cast("string"), F.lit(">"))
        token = F.coalesce(known["token"], name)
        seen = F.when(known.isNotNull(), acc["seen"]).otherwise(F.array_append(acc["seen"], F.struct(d["value"].alias("value"), prefix(d["kind"]).alias("prefix"), token.alias("token"))))
        skip = d["value"].isNull() | (d["value"] == "") | (d["kind"] == "face") | d["value"].rlike(r"^<[A-Z]+_[0-9]+>$")
        return F.when(skip, acc).otherwise(write(acc, d, token, seen))

    return F.aggregate(found, zero, step)


def extended(entries: DataFrame, names: DataFrame) -> DataFrame:
    """entries with the values of names (vault, id, start, value) that they lack, numbered on as persons."""
    new = names.join(entries.select("vault", "value"), ["vault", "value"], "left_anti").groupBy("vault", "value").agg(F.min(F.struct("id", "start")).alias("f"))
    had = entries.filter("prefix = 'PII'").groupBy("vault").agg(F.count(F.lit(1)).alias("had"))
    n = F.row_number().over(Window.partitionBy("vault").orderBy("f")) + F.coalesce("had", F.lit(0))
    more = new.join(had, "vault", "left").select("vault", "value", F.concat(F.lit("<PII_"), n.cast("string"), F.lit(">")).alias("token"), F.lit("PII").alias("prefix"))
    return entries.unionByName(more)
