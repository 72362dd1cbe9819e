"""Token windows against a sequential reader of the same pages."""

import os
from html.parser import HTMLParser

import pytest

from marginalia.plans import registry

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


class Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts, self.now = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.now = ""

    def handle_endtag(self, tag):
        if tag == "a" and self.now is not None:
            self.texts.append(self.now)
            self.now = None

    def handle_data(self, data):
        if self.now is not None:
            self.now += data


def test_links_equal_a_sequential_reader(spark):
    parts = registry.queries()["parts_extract"](spark, SF).filter("kind = 'link'").collect()
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    want = set()
    for page in pages:
        reader = Links()
        reader.feed(page["html"])
        want |= {(page["page_id"], i, t) for i, t in enumerate(reader.texts, 1)}
    assert {(r["doc_id"], r["ordinal"], r["text"]) for r in parts} == want


def page_frame(spark, *bodies):
    return spark.createDataFrame([(i, f"http://h.example/{i}", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")


def test_user_frames(spark):
    pages = page_frame(spark, "<h1>A</h1><p>one<p>two</p>three</p><h3> </h3>", None, "", "<h2>never closed <a href='x'>a <b>b</b></a>")
    got = {(r["doc_id"], r["kind"], r["ordinal"], r["text"]) for r in registry.apply(spark, "parts_extract", pages=pages).collect()}
    assert got == {(0, "heading", 1, "A"), (0, "heading", 2, " "), (0, "paragraph", 1, "onetwo"), (3, "link", 1, "a b")}


def test_dropped_content_is_not_read(spark):
    pages = page_frame(spark, "<p>a</p><script>var t='</p><p>x</p>'</script><svg><p>y</p></svg></svg><p>b</p>")
    assert [r["text"].split() for r in registry.apply(spark, "plain_text", pages=pages).collect()] == [["a", "b"]]


def test_independent_of_partitions(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    one = registry.apply(spark, "plain_text", pages=pages.repartition(1)).collect()
    many = registry.apply(spark, "plain_text", pages=pages.repartition(17)).collect()
    assert sorted(one) == sorted(many)
