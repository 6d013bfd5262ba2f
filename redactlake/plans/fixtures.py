"""Inputs of the queries, as SQL that Spark and the checking engine both run.

`{table}` names one of the generated tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_K = "lpad(CAST(c_custkey AS STRING), 6, '0')"
_NOTES = [
    f"'Write to lena.hill' || {_K} || '@example.com or tom@gmail soon'",
    f"'Call +91 98' || substr({_K}, 4, 3) || ' 1' || substr({_K}, 3, 4) || ' now'",
    "'Patient: Maria Lopez met Dr. John Smith today'",
    f"'Aadhaar 2345 67' || substr({_K}, 1, 2) || ' ' || substr({_K}, 3, 4)",
    f"'Card 4111 1111 ' || substr({_K}, 1, 4) || ' 11' || substr({_K}, 5, 2)",
    f"'PAN ABCDE' || substr({_K}, 3, 4) || 'F and IFSC HDFC0' || {_K}",
    f"'SSN 123-' || substr({_K}, 5, 2) || '-' || substr({_K}, 3, 4) || ' passport AB' || {_K} || '7'",
    f"'api_key = sk-or-v1-abcdefghij' || {_K} || 'klmnop done'",
    f"'OPENAI_API_KEY: sk-ABCDEFGHIJKLMNOPQRST' || {_K}",
    f"'password is hunter' || {_K} || ', keep it'",
    f"'Your OTP is ' || {_K}",
    f"'with password Gr4nite7x' || {_K} || ' please'",
    f"'token: ghp_' || repeat('a', 30) || {_K}",
    f"'contact:éabc' || {_K} || '@x.com ok'",
    "'From: Anita Rao ok Mr. Raj Kumar Singh'",
    f"'no personal data here at all ' || {_K}",
    f"'AKIAABCDEFGHIJ' || {_K} || ' end'",
    f"'xoxb-123-' || {_K} || ' and eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh' || {_K}",
    "'aadhar no 234567890124 and card number 4111 1111 1111 1112'",
    f"'My card number 4111111111111111 and key=' || 'x' || {_K}",
    "'1234 5678 9012 3456 and 2345-6789-0124'",
    f"'lena.work{{K}}@gmail and logo@4x and tile@2x'".replace("{K}", "") .replace("'lena.work@gmail", f"'lena.work' || {_K} || '@gmail"),
    f"'9876543210 or 98765-4' || substr({_K}, 3, 4)",
    "'short'",
]
NOTES = "SELECT c_custkey AS id, CASE c_custkey % 24 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_NOTES)) + " END AS text FROM {customer}"
#: The notes and every document, whole.
TEXTS = NOTES + " UNION ALL SELECT doc_id + 100000000 AS id, text FROM {documents}"
DOCS = "SELECT doc_id AS id, text FROM {documents}"
#: Text with vault tokens.
TOKENED = "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'send <CRED_' || CAST(o_orderkey % 9 AS STRING) || '> to <PII_2> now' WHEN 1 THEN 'no token in here' WHEN 2 THEN '12<ID_3> and <KEY_4>77 glued' WHEN 3 THEN '[see](http://x.y/z) **bold** `code` <IMG_1>' WHEN 4 THEN 'CRED_' || CAST(o_orderkey % 9 AS STRING) || ' bare and <A1_5> odd <CRED_1>' ELSE 'a  b   c' || chr(10) || ' <FACE_1> d' END AS text FROM {orders}"
#: Values a user may have typed.
VALUES = "SELECT o_orderkey AS id, CASE o_orderkey % 14 WHEN 0 THEN 'user' || CAST(o_orderkey AS STRING) || '@example.com' WHEN 1 THEN CAST(4111111111000000 + o_orderkey AS STRING) WHEN 2 THEN CAST(234567000000 + o_orderkey AS STRING) WHEN 3 THEN '' WHEN 4 THEN 'ab' WHEN 5 THEN 'Anita Rao' WHEN 6 THEN 'abc1234xyz' WHEN 7 THEN '+91 98765 4' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') WHEN 8 THEN 'secretword' WHEN 9 THEN ' pad ' WHEN 10 THEN 'Acme Trading Ltd' WHEN 11 THEN '12 Main Street, Springfield' WHEN 12 THEN '4111-1111-1111-1111' ELSE 'O' END AS text FROM {orders}"
#: Numbers as text, for checksums.
NUMBERS = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN CAST(4000000000000000 + o_orderkey * 7919 AS STRING) WHEN 1 THEN CAST(200000000000 + o_orderkey * 104729 AS STRING) ELSE '4111 1111 ' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || ' 1111' END AS text FROM {orders}"
URLS = "SELECT page_id * 4 AS id, url AS text, 'https://www.' || CAST(page_id % 7 AS STRING) || '.example.co.uk/a' AS page FROM {pages} UNION ALL SELECT page_id * 4 + 1, 'https://www.shop' || CAST(page_id % 5 AS STRING) || '.example.com:8080/cart?item=1#x', 'http://shop.example.com/' FROM {pages} UNION ALL SELECT page_id * 4 + 2, 'ftp://files.example.org/x', 'https://example.org' FROM {pages} UNION ALL SELECT page_id * 4 + 3, 'not a url?q=1', 'http://a.b.example.net' FROM {pages}"
#: Controls of pages.
ELEMENTS = "SELECT c_custkey AS id, c_custkey % 50 AS page_id, CASE c_custkey % 8 WHEN 0 THEN 'Password' WHEN 1 THEN 'Card number' WHEN 2 THEN 'Full name' WHEN 3 THEN 'Company' WHEN 4 THEN 'Billing address' WHEN 5 THEN 'Mobile phone' WHEN 6 THEN 'Email' ELSE 'Search' END AS name, CASE c_custkey % 3 WHEN 0 THEN 'textbox' WHEN 1 THEN 'password' ELSE 'button' END AS role, CASE c_custkey % 5 WHEN 0 THEN 'Anita Rao' WHEN 1 THEN '4111 1111 1111 1111' WHEN 2 THEN 'sk-ABCDEFGHIJKLMNOPQRST' || " + _K + " WHEN 3 THEN '12 Main Street, Springfield' ELSE NULL END AS value, CASE c_custkey % 4 WHEN 0 THEN 'password' WHEN 1 THEN 'text' ELSE '' END AS input_type FROM {customer}"
#: Boxes: two on each row.
BOXES = "SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_partkey % 97 AS DOUBLE) AS ax, CAST(l_suppkey % 53 AS DOUBLE) AS ay, CAST(l_partkey % 41 AS DOUBLE) AS aw, CAST(l_orderkey % 37 AS DOUBLE) AS ah, CAST(l_orderkey % 89 AS DOUBLE) AS bx, CAST(l_partkey % 59 AS DOUBLE) AS bw, CAST(l_suppkey % 47 AS DOUBLE) AS by_, CAST(l_partkey % 31 AS DOUBLE) AS bh FROM {lineitem}"
#: Failures of tools and transports.
ERRORS = "SELECT event_id AS id, event_id % 700 AS status, CASE event_id % 13 WHEN 0 THEN 'net::ERR_NAME_NOT_RESOLVED' WHEN 1 THEN 'Model did not respond within 30s' WHEN 2 THEN 'No element 12 on page' WHEN 3 THEN 'user declined' WHEN 4 THEN 'unknown tool foo' WHEN 5 THEN 'no option named x' WHEN 6 THEN 'socket hang up' WHEN 7 THEN 'The operation was aborted' WHEN 8 THEN 'model gated for this key' WHEN 9 THEN '' WHEN 10 THEN 'fetch failed   twice' || repeat(' more', 60) WHEN 11 THEN 'request timed out' ELSE event_type END AS text FROM {events}"
CONV = "SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, text FROM {conversations}"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    named = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in named})


def plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)
