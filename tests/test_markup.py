"""The tokenizer against the standard library's parser."""

import os
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.functions.markup import attributes, tokens

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


class Plain(HTMLParser):
    def __init__(self, html):
        super().__init__()
        self.out = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        self.out.append(("open", tag, first))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.out.append(("close", tag))

    def handle_data(self, data):
        if self.out and self.out[-1][0] == "text":
            data = self.out.pop()[1] + data
        self.out.append(("text", data))


def found(html):
    out = []
    for kind, value, written in tokens(html):
        if kind == "text":
            if out and out[-1][0] == "text":
                value = out.pop()[1] + value
            out.append(("text", value))
        else:
            out.append(("open", value, attributes(written)) if kind == "open" else ("close", value))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_tokens_of_real_pages(spark):
    for (html,) in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect():
        assert found(html) == Plain(html).out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<a href=x>", "<a HREF='y&amp;z' title=\"a>b\">", "<br/>", "text ", "&lt;", "<!-- <a href=c> -->", "a < b", "<img src=/i.png alt>", "<b\n class = 'k' class=l>", "</ul >", "é"]), max_size=12))
def test_tokens_of_made_pages(parts):
    html = "".join(parts)
    assert found(html) == Plain(html).out


def test_odd_markup():
    assert found("<script>if (a<b) '<p>'</script>x") == [("open", "script", {}), ("text", "if (a<b) '<p>'"), ("close", "script"), ("text", "x")]
    assert found("<title>a &amp; <b></title>") == [("open", "title", {}), ("text", "a & <b>"), ("close", "title")]
    assert found("x<a href='cut") == [("text", "x")]
    assert found("x<!-- cut <p>y") == [("text", "x")]
    assert found("") == [] and found("<") == [("text", "<")]
    assert found("<a title=it's href=b>") == [("open", "a", {"title": "it's", "href": "b"})]
    assert list(tokens("<a " + "x='" * 50_000)) == []
