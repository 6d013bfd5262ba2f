"""Pages without layout, the key-value sink, and boxes around what was read."""

import random

import pytest
from pyspark.sql import functions as F

from redactlake import catalog
from redactlake.operators import spans as S
from redactlake.operators.suppression import suppressed
from redactlake.plans import reading as R
from redactlake.sources import html as H
from redactlake.sources import store

PAGE = """<title>T</title><nav>n</nav><main>Hi <b>you</b><script>no()</script></main><a href="https://h.example/a/b?x">go</a>
<label for="u">User</label><input id="u" value=" a  b "><label>Key <input type="password" name="pw" value="abc"></label><p>Near</p><input name="">
<span id="l1">By</span><input aria-labelledby="l1 none" type="checkbox" checked required><select><option>x<option selected>y</select><img src="/avatar/1" alt="me"><div email="q@x.example">Q</div><input name="q">"""


def test_names_roles_values_and_attributes():
    got = {(c["role"], c["name"], c["value"]) for c in H.controls(PAGE)}
    assert {("link", "go", None), ("textbox", "User", "a b"), ("password", "Key", "••••••"), ("textbox", "Near", ""), ("checkbox", "By", None), ("textbox", "q", "")} <= got
    attrs = {c["name"]: dict(c["attrs"]) for c in H.controls(PAGE)}
    assert attrs["go"] == {"href": "h.example/a/b"} and attrs["By"] == {"checked": "true", "required": "true", "inputType": "checkbox"}
    title, text, found = H.parsed(PAGE)
    assert (title, text) == ("T", "Hi you") and len(found) == len(H.controls(PAGE))
    assert H.parsed(None) == ("", "", []) and H.controls("<<<>") == []


def test_regions_of_an_element_once():
    kinds = [(r["kind"], r["label"]) for r in H.sensitive(PAGE)]
    assert kinds[0] == ("password", "Key") and ("credential_label", "Label for password") in kinds and ("email_text", "Sender/contact") in kinds and ("face", "Profile/avatar image") in kinds
    assert sum(k == "input_field" for k, _ in kinds) == 2  # not the search field, nor the checkbox


def test_the_store_tells_failures(spark, tmp_path):
    rows = spark.range(3)
    (tmp_path / "file").write_text("x")
    assert store.persisted({"a": rows}, str(tmp_path / "s")) == {"a": True} and store.loaded(spark, str(tmp_path / "s"), "a", "id long").count() == 3
    assert store.persisted({"b": rows}, str(tmp_path / "file" / "x")) == {"b": False}


def test_boxes_around_what_was_read(spark):
    words = [("Mail", 0), ("a.b@x.example", 40), ("to", 80), ("Anlta", 120), ("Ra0", 160), ("soon", 200)]
    lines = spark.createDataFrame([(1, [(n, t, float(x), 10.0, 36.0, 8.0, 90.0) for n, (t, x) in enumerate(words)]), (2, [(n, t, float(x), 10.0, 36.0, 8.0, 5.0) for n, (t, x) in enumerate(words)])], "id long, words array<struct<n: int, text: string, x: double, y: double, width: double, height: double, confidence: double>>")
    got = {(r.id, r.value, r.x, r.width, r.kind) for r in R.triage_boxes(lines, (), ("Anita Rao",)).collect()}
    # the pattern only where the reader is sure; the value that was asked for on both lines, misread
    assert got == {(1, "a.b@x.example", 40, 36, "email_text"), (1, "Anlta Ra0", 120, 76, "ner_text"), (2, "Anlta Ra0", 120, 76, "ner_text")}


def test_boxes_are_suppressed_as_by_a_loop(spark):
    rng = random.Random(4)
    rows = [(p, n, float(rng.randrange(60)), float(rng.randrange(60)), float(rng.randrange(1, 30)), float(rng.randrange(1, 30)), rng.random()) for p in range(20) for n in range(25)]
    got = {(r.page, r.n) for r in suppressed(spark.createDataFrame(rows, "page long, n long, x double, y double, w double, h double, conf double")).collect()}
    want = set()
    for p in range(20):
        kept = []
        for b in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[4] * r[5], -r[6], r[1])):
            over = lambda k: max(0, min(b[2] + b[4], k[2] + k[4]) - max(b[2], k[2])) * max(0, min(b[3] + b[5], k[3] + k[5]) - max(b[3], k[3]))  # noqa: E731, B023
            if not any(over(k) > 0 and over(k) >= 0.5 * min(b[4] * b[5], k[4] * k[5]) for k in kept):
                kept.append(b)
        want |= {(b[0], b[1]) for b in kept}
    assert got == want


def test_spans_take_a_time_that_follows_the_matches(spark):
    import time

    took = []
    for n in (1000, 4000):
        df = spark.createDataFrame([(1, " ".join(f"user{i}@mail.example" for i in range(n)))], "id long, text string")
        began = time.time()
        assert S.match_pii(df).count() == n
        took.append(time.time() - began)
    assert took[1] < 10


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql()])
def test_queries_without_sql_run(spark, name):
    df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.limit(1).count() <= 1 and df.columns
    assert df.agg(F.count(F.lit(1))).first()[0] >= 0
