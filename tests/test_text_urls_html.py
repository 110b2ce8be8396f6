import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import html as H
from quern.functions import text as T
from quern.functions import urls as U


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def col(name="t"):
    return F.col(name)


@pytest.mark.parametrize(
    ("given_", "wanted"),
    [
        ("য়", unicodedata.normalize("NFC", "য়")),
        ("é", "é"),
        ("ক‌খ‍গ", "ক‌খ‍গ"),
        ("﻿a​b⁠c­d᠎e�f", "abcdef"),
        ("a \t 　b", "a b"),
        ("a \r\n \r b\n\n\n\nc", "a\n\nb\n\nc"),
        ("a b\x1cc", "a b\x1cc"),
        ("  \n ", ""),
        (None, ""),
    ],
)
def test_clean(spark, given_, wanted):
    assert one(spark, T.clean(col()), t=given_) == wanted


def plain_clean(text):
    text = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")
    text = "".join(c for c in text if c not in T.REMOVED)
    text = re.sub("[ \t   -   　]+", " ", text)
    return re.sub("\n{3,}", "\n\n", re.sub("[ \t]*\n[ \t]*", "\n", text)).strip()


def test_clean_against_plain_version(spark):
    import random

    rng = random.Random(1)
    parts = ["a", "e", "́", " ", "\t", "\n", "\r", " ", "​", " ", "\x1c", "\x85", "ক", "　", "\x0b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(2000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.clean(col()).alias("c"), T.words(col()).alias("w"), T.strip(col()).alias("s"))
    for r in got.collect():
        assert r["c"] == plain_clean(r["t"])
        assert r["w"] == r["t"].split()
        assert r["s"] == r["t"].strip()


@pytest.mark.parametrize(
    ("text", "heading", "wanted"),
    [("One\nbody", "One", "body"), ("One \n\nbody\n", "One", "body"), ("One\nbody", "Two", "One\nbody"), ("One", "One", ""), ("", "One", ""), ("One\nb", "", "One\nb"), ("One\nb", None, "One\nb"), ("é\nb", "é", "b"), ("One\x0bb c", "One", "b\nc")],
)
def test_strip_heading(spark, text, heading, wanted):
    assert one(spark, T.strip_headings(col(), col("h")), t=text, h=heading) == wanted


def test_chapter_then_section(spark):
    both = T.strip_headings(col(), F.lit("One"), F.lit("Two"))
    assert one(spark, both, t="One\nTwo\nbody") == "body"
    assert one(spark, both, t="Two\nOne\nbody") == "One\nbody"


def test_prefixes(spark):
    for given_, wanted in ((" a ", "query: a"), ("passage: a", "passage: a"), ("query:a", "query:a"), ("Query: a", "query: Query: a"), (None, "query: ")):
        assert one(spark, T.with_prefix(col(), "query: "), t=given_) == wanted


@pytest.mark.parametrize(
    ("url", "wanted"),
    [
        ("https://h/wiki/A_b/c", "A b/c"), ("https://h/wiki/A+b%20c", "A+b c"), ("https://h/wiki/%zz", "%zz"), ("https://h/w/index.php?title=X%2520y&a=1", "X y"),
        ("https://h/w/index.php?a=1", None), ("https://h/wiki/", None), ("https://h/wiki/_", None), ("https://h/wiki/e%CC%81", "é"), ("/wiki/A#x", "A"), (None, None), ("http://[x", None),
    ],
)
def test_titles(spark, url, wanted):
    assert one(spark, U.title_from_url(col()), t=url) == wanted


def test_canonical(spark):
    for url, base, wanted in (
        ("../c?x=1#y", "https://h/a/b/", "https://h/a/c"),
        (" /wiki/A%20b ", "https://h/q", "https://h/wiki/A b"),
        ("/wiki/a%3Ab;p%41", "https://h", "https://h/wiki/a:b;p%41"),
        ("/wiki/a&#58;b", "https://h", "https://h/wiki/a&"),  # the number sign begins a fragment
        ("//o/x", "https://h", "https://o/x"),
    ):
        assert one(spark, U.canonical_url(col(), col("b")), t=url, b=base) == wanted


def test_hosts(spark):
    for a, b, wanted in (("https://www.x.org/a", "http://x.org", True), ("https://x.org:80/", "https://x.org/", False), ("/rel", "/rel", False), ("https://wwx.org", "https://x.org", True), (None, "https://x", False)):
        assert one(spark, U.host_allowed(col(), col("b")), t=a, b=b) is wanted


def test_skip_reasons(spark):
    assert len(U.SKIPPED_NAMESPACES) == 31
    for title, url, wanted in (
        ("A", "https://h/?ACTION=edit", "edit/redlink"), ("A", "redlink=1", "edit/redlink"), (None, "u", "not a wiki title"), ("SPECIAL:x", "u", "special page"), ("বিশেষ:x", "u", "special page"),
        ("Page:1", "u", "namespace Page"), ("page:1", "u", None), ("লেখক:x", "u", "namespace লেখক"), ("A/Page:1", "u", None), ("A", None, None),
    ):
        assert one(spark, U.skip_reason(col(), col("u")), t=title, u=url) == wanted


def test_hierarchy(spark):
    for title, root, wanted in (("R", "R", True), ("R/a", "R", True), ("Ra", "R", False), ("é/a", "é", True)):
        assert one(spark, U.belongs_to(col(), col("r")), t=title, r=root) is wanted
    chapter, section = U.chapter_and_section(col(), col("r"))
    for title, root, wanted in (("R", "R", ("R", "")), ("R/a", "R", ("a", "")), ("R//a/b//c", "R", ("a", "b/c")), ("X/y", "R", ("X", "y")), ("R/", "R", ("", ""))):
        assert (one(spark, chapter, t=title, r=root), one(spark, section, t=title, r=root)) == wanted


def test_listing_url(spark):
    assert one(spark, U.prefix_listing_url(col(), col("p")), t="https://h/wiki/x", p="a b/é") == "https://h/w/index.php?title=Special:PrefixIndex&namespace=0&prefix=a%20b/%C3%A9"


PAGE = """<html><body><div id=mw-content-text><p>outer</p><div class="x mw-parser-output"><script>var a="<p>no";</script>
<h1>Head</h1><p>a <b>b</b> c<p>unclosed <i>it<p>next<br>line &amp; more<!-- c -->tail<table><tr><td>cell</table>
<div class="thumb">pic<img src=x></div><sup class="reference">1</sup><sup>2</sup><span class=pagenum>9</span>
<div class="toc"><a href="/in">in</a></div>end​﻿</div><p>after</p></div><nav><a href="/nav">nav</a></nav></body></html>"""


def test_html_text():
    assert H.main_text(PAGE) == "Head\na\nb\nc\nunclosed\nit\nnext\nline & more\ntail\n2\nend"
    assert H.main_text(PAGE.replace(" mw-parser-output", "")).startswith("outer\nHead")
    assert H.main_text("<p>no root</p>") == ""
    assert H.main_text(PAGE.replace("<h1>", '<i class="noarticletext"></i><h1>')) == ""
    assert H.main_text(None) == H.main_text("") == ""
    assert H.main_text("<article>a<div class=ad>b</div></article>", (("article",),)) == "a\nb"


def test_html_links_and_markers():
    page = H.read_page(PAGE)
    assert [(h, r) for h, r, _ in page.links] == [("/in", (1, 0)), ("/nav", ())]
    assert not page.missing and H.read_page("<p class='noarticletext'>").missing


@given(st.text(alphabet="<>/abp=\"' &;!-", max_size=60))
@settings(max_examples=200, deadline=None)
def test_html_never_fails(text):
    H.main_text("<div id=mw-content-text>" + text)
