import gzip
import hashlib
import random
import re
import time
from html.parser import HTMLParser

import pytest

from emberline.llm.html_extract import extract, extract_main_text, host_paths
from emberline.llm.warc import MAGIC, encode_record, read_warc, records, write_warc

LONG = ("Some long paragraph of plain prose goes on for a while. " * 4).strip()
SCHEMA = "page_id long, url string, html string, text string, path long"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>one<p>two<br>more", "one\n\ntwo more"),
        ("<body><nav>menu</nav><article><h1>T</h1><p>a&nbsp;<b>b</b>\n c</p><aside>x</aside></article><footer>f</footer>", "T\n\na b c"),
        ("<body><div class='content'><p>some longer text here</p><form><p>search</p></form></div><div id='comments'><p>nice, " + "very " * 40 + "nice</p></div>", "some longer text here"),
        ("<body><article class='no-sidebar'><header class='entry-header'><h1>Title</h1></header><p>text</p><div class='ad-box'>buy</div></article>", "Title\n\ntext"),
        ("<body><main><p>a<script>if (1 < 2) '</p>'</script>b</p><!-- c --><style>p{}</style></main>", "ab"),
        ("<body><article><p>cut off <b>here", "cut off here"), ("<article><p>&lt;tag&gt; &#233; &eacute; &copy</p></article>", "<tag> é é ©"),
        ("<body><main><h1>Title</h1><div class='body'><p>" + "long text " * 9 + "</p></div></main><div class='more'><p>short</p></div>", "Title\n\n" + ("long text " * 9).strip()),
        ("<div><table><tr><td>a<td>b<tr><td>c</table></div>", "a b\n\nc"),
        (f"<body><div id='page-header-wrap'><nav>x</nav><div class='post'><h1>T</h1><p>{LONG}</p></div></div>", f"T\n\n{LONG}"),
        (f"<body><div class='legal-news'><p>{LONG}</p></div>", LONG), (f"<body><div class='tag-share'><article><h1>T</h1><p>{LONG}</p></article></div>", f"T\n\n{LONG}"),
        (f"<body><article><header><h1>T</h1><p>By me, today</p></header><p>{LONG}</p><div class='comments'><p>{LONG * 3}</p></div></article>", f"T\n\n{LONG}"),
        (f"<body><div class='post'><h1>T</h1><p class='lead'>A lead.</p><div class='content'><p>{LONG}</p><p>{LONG}</p></div></div><div class='more'><a href='x'>more</a></div>", f"T\n\nA lead.\n\n{LONG}\n\n{LONG}"),
        (f"<body><div class='cookie-notice'><p>{LONG}</p></div><p>short</p>", "short"), (f"<body><div class='comments'><p>{LONG * 3}</p></div><div class='post'><p>{LONG}</p></div>", LONG),
    ],
)
def test_extract(html, text):
    assert extract(html, None)[0] == text


class Slow(HTMLParser):
    """The blocks of a page's article, tag by tag, for pages that mark one."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside = self.outside = 0
        self.blocks = [""]
        self.feed(page)
        self.text = "\n\n".join(b for b in (" ".join(x.split()) for x in self.blocks) if b)

    def handle_starttag(self, tag, attrs):
        names = set(re.findall("[a-z]+", " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()))
        self.inside += tag == "article"
        if self.inside and (self.outside or tag in ("aside", "form", "nav", "script", "style") or names & {"ad", "comments", "share", "notice"}):
            self.outside += tag not in ("br", "img", "input", "hr")
        if tag in ("p", "h1", "h2", "h3", "ul", "ol", "li", "div", "article", "blockquote", "pre", "table", "tr", "section"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "h3", "ul", "ol", "li", "div", "article", "blockquote", "pre", "table", "tr", "section"):
            self.blocks.append("")
        self.outside -= bool(self.outside)
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and not self.outside:
            self.blocks[-1] += data


def test_a_table_of_pages_equals_a_slow_reader(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    slow = {r["page_id"]: Slow(r["html"]).text for r in pages.collect()}
    found = {r["page_id"]: r["text"] for r in extract_main_text(pages).collect()}
    assert all(slow.values()) and found == slow


def test_host_consensus(spark):
    body = "This paragraph is long enough to be the article of its page, whatever its neighbours say. " * 3
    usual = f"<body><div class='main col-{{}}'><p>{body}</p><p>{body}</p></div><div class='extra'><p>short</p></div>"
    odd = f"<body><div class='main col-9'><p>Brief.</p></div><div class='extra'><p>{body * 3}</p></div>"
    rows = [(i, "https://H.example/x", usual.format(i), "clash", 1) for i in range(8)] + [(9, "http://u@h.example:80/y", odd, None, None), (10, None, odd, None, None), (11, "::", None, None, None), (None, "https://h.example/", "", None, None), (9, "http://u@h.example:80/y", odd, None, None)]
    pages = spark.createDataFrame(rows, SCHEMA)
    found = {}
    for r in extract_main_text(pages).collect():
        found.setdefault(r["page_id"], []).append(r)
    assert found[0][0]["text"] == "\n\n".join([body.strip()] * 2) and found[0][0]["path"] == "body>div.col-.main"
    assert [r["text"] for r in found[9]] == ["Brief."] * 2  # what the host's other pages say
    assert found[10][0]["text"] == (body * 3).strip()
    assert found[11][0]["text"] == found[None][0]["text"] == "" and found[11][0]["n_chars"] == 0
    assert host_paths(pages).count() == 2
    assert extract_main_text(pages.limit(0)).count() == 0


def expected_records(rows):
    first = {}
    for page_id, _, html, *_ in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and page_id is not None:
            first[raw] = min(page_id, first.get(raw, page_id))
    out = []
    for page_id, url, html, *_ in rows:
        raw = (html or "").encode()
        revisit = raw in first and first[raw] != page_id
        out.append((page_id, url, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[raw] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("range_bytes", [37, 1000, 1 << 22])
def test_warc_round_trip(spark, tmp_path, range_bytes):
    rng = random.Random(2)
    noise = lambda n: "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x2FF), 0x1F, 0x8B, 0x08])) for _ in range(n))
    big = noise(5000)
    rows = [(i, f"http://h/{i} é", noise(rng.choice([0, 5, 99, 100, 3000])), None, None) for i in range(30)]
    rows += [(40, None, big, "x", 1), (41, "u", big, None, None), (41, "u", big, None, None), (40, None, big, None, None), (50, "", None, None, None), (None, "n", big, None, None), (None, None, None, None, None), (-3, "neg", "a" * 99, None, None), (51, "a", "a" * 99, None, None)]
    files = write_warc(spark.createDataFrame(rows, SCHEMA).repartition(2), str(tmp_path / "w"))
    found = read_warc(files, range_bytes).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, found.collect()), key=repr) == expected_records(rows)


def test_warc_of_nothing(spark, tmp_path):
    assert read_warc(write_warc(spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))).count() == 0


def test_false_magic_is_no_record(tmp_path):
    record = encode_record([("WARC-Type", "response")], b"x" * 50)
    decoys = MAGIC + b"\0" * 20 + gzip.compress(b"not a record") + MAGIC
    (tmp_path / "f").write_bytes(decoys + record + record)
    assert [at for at, _ in records(str(tmp_path / "f"), 0, 10_000)] == [len(decoys), len(decoys) + len(record)]
    assert [at for at, _ in records(str(tmp_path / "f"), len(decoys) + 1, 10_000)] == [len(decoys) + len(record)]
    assert list(records(str(tmp_path / "f"), 0, len(decoys))) == []


def test_cut_record_raises(tmp_path):
    record = encode_record([("WARC-Type", "response")], random.Random(1).randbytes(500))
    (tmp_path / "f").write_bytes(record[:-20])
    with pytest.raises(ValueError, match="cut off"):
        list(records(str(tmp_path / "f"), 0, 10_000))


SENTENCE = "This is a sentence of the story that is told. "


@pytest.mark.parametrize("name", ["section id='search-engines'", "div class='rating-table'", "div class='share-price-chart'", "p id='rating-agencies'", "section id='cookie-recipes'", "div class='comments-by-critics'"])
def test_topics_in_an_article_are_not_furniture(name):
    tag = name.split()[0]
    page = f"<body><article><h1>Title</h1><p>{SENTENCE * 6}</p><{name}>Inner words here.</{tag}><p>{SENTENCE * 3}</p></article></body>"
    assert "Inner words here." in extract(page, None)[0]


@pytest.mark.parametrize("name", ["div class='share-buttons'", "div id='comments'", "section class='td-related-posts'", "div class='cookie-notice'", "div class='rating-box'", "div class='newsletter-signup wide'"])
def test_furniture_in_an_article_stays_out(name):
    tag = name.split()[0]
    page = f"<body><article><h1>Title</h1><p>{SENTENCE * 6}</p><{name}>Inner words here.</{tag}><p>{SENTENCE * 3}</p></article></body>"
    assert "Inner words here." not in extract(page, None)[0] and extract(page, None)[0].startswith("Title")


def test_a_long_section_named_like_furniture_is_text():
    page = f"<body><article><p>{SENTENCE * 20}</p><section id='ratings'><p>{'The agencies rate debts by their risk. ' * 12}</p></section><section id='comments'><p>{'I liked it. ' * 40}</p></section></article></body>"
    text = extract(page, None)[0]
    assert "agencies" in text and "I liked it" not in text


def test_siblings_of_one_kind_are_one_text():
    page = f"<body><div class='page'><div class='sec intro'><p>Intro one. {SENTENCE * 2}</p></div><div class='sec story'><p>{SENTENCE * 9}</p></div><div class='sec links'><a href='x'>{SENTENCE * 2}</a></div><div class='other'>Other</div></div></body>"
    for winners in (None, ["body>div.page>div.sec.story"]):
        text = extract(page, winners)[0]
        assert text.startswith("Intro one.") and text.count("sentence") == 11 and "Other" not in text
    columns = f"<body><div class='row'><div class='col main-text'><p>{SENTENCE * 9}</p></div><div class='col extra'><p>Something beside it.</p></div></div></body>"
    assert "beside" not in extract(columns, None)[0]


@pytest.mark.parametrize("piece", ["<div>x", "<div class='ad'>x", "<div>x</b>", "<p><span>x", "<td><p>x", "<a><b>x</i>"])
def test_deep_nesting_costs_as_much_as_it_is_long(piece):
    began = time.perf_counter()
    extract(piece * 50_000, None)
    assert time.perf_counter() - began < 12


def test_a_page_of_five_megabytes_and_a_word_of_one():
    text, _ = extract(f"<body><article><p>{'word ' * 1_000_000}</p><p>{'x' * 1_000_000}</p></article></body>", None)
    assert len(text) == 5_000_000 - 1 + 2 + 1_000_000
