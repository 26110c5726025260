"""Extraction from odd pages, and hrefs of real ones against the standard library's parser."""

import os
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import extract

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def on(spark, f, html):
    return spark.createDataFrame([(html,)], "x string").select(f(F.col("x"))).first()[0]


class Hrefs(HTMLParser):
    def __init__(self, html):
        super().__init__()
        self.found = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        given = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        self.found += [given["href"]] if "href" in given else []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_hrefs_of_real_pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("html", extract.hrefs(F.col("html")).alias("found")).collect()
    assert all(r.found == Hrefs(r.html).found for r in rows) and any(r.found for r in rows)


def test_contacts(spark):
    assert on(spark, extract.phones, "a hotel:5 <p title='tel:1'> <a href='hotel:5'> <a href=' TEL:+1 (2) 3;x=y'> <a href=tel:>") == ["+1 (2) 3"]
    assert on(spark, extract.emails, "mailto:x@y <a href='MAILTO:%C3%A9@y.example?cc=z@z.example'><a href=mailto:a+b@c.example>") == ["é@y.example", "a+b@c.example"]
    assert on(spark, extract.whatsapp, "<a href=//wa.me/+12><a href='whatsapp://send?phone=34'><a href=https://wa.me.evil.example/5><a href=https://web.whatsapp.com/send/?a=1&phone=56>") == ["12", "34", "56"]
    for f in (extract.hrefs, extract.emails, extract.phones, extract.whatsapp):
        assert on(spark, f, None) == [] and on(spark, f, "") == []


def test_json_ld(spark):
    ld = lambda *blocks: "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)
    name = lambda c: extract.json_ld(c, "$.name")
    assert on(spark, name, ld('{"a": 1}', '{"name": "second"}')) == "second"
    assert on(spark, name, ld("no json", '[{"b": 2}, {"name": "listed"}]')) == "listed"
    assert on(spark, name, ld('{"@graph": [{"c": 3}, {"name": "in the graph"}]}')) == "in the graph"
    assert on(spark, name, "<!--" + ld('{"name": "x"}') + "--><script>{\"name\": 1}</script>") is None
    assert on(spark, name, ld("[]", "7", "null", '"text"')) is None and on(spark, name, None) is None
    assert on(spark, lambda c: extract.json_ld_values(c, "$.address.city", "Place"), ld('[{"@type": "Place", "address": {"city": "Huế"}}, {"@type": "Thing", "address": {"city": "x"}}]')) == ["Huế"]
