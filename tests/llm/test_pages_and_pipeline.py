"""URL verdicts, page texts, and the pipeline."""

import html
import re
import time

import duckdb
import pytest

import corpus_pipeline
from tabulon.llm import html as pages_html
from tabulon.llm import urls
from tabulon.llm.queries import QUERIES, RULES, SQL
from tabulon.plans.stage import stage

FOLDER = "/root/testdata/sf0.001"

ODD_URLS = [
    None, "", "no scheme net/", "http://", "http://NET", "http://net/", "https://a.b.net/x?y#z", "http://example.net/en/",
    "http://www.EXAMPLE.net/en", "http://example.com/de/1", "http://anet/x", "http://x.org/fr/", "http://org/fr/?q", "a://b://net/c",
    "http://x.net?/en/", "http://x.example.net#/en/", "http://é.org/fr/ü", "http://.net/", "http://x..net/",
]


def expected(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups() if rest is not None else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(h, p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return (host, path, best[0] + best[1], best[2]) if best else (host, path, None, "allow")


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(ODD_URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as keys", "2 as judged0", "'x' as host")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = {r["page_id"]: tuple(r["judged"]) for r in urls.judge(df, rules).collect()}
    assert found == {i: expected(u) for i, u in rows}
    assert urls.judge(df.limit(0), rules).count() == 0
    assert {r["judged"]["verdict"] for r in urls.judge(df, rules.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(3000).selectExpr("concat('k', id) as key")
    listed = universe.where("substr(key, 2) % 7 = 0")
    levels = urls.cascade(listed, universe)
    assert len(levels) >= 2
    wrong = universe.where(urls.is_listed(universe["key"], levels) != (universe["key"].substr(2, 9).cast("int") % 7 == 0))
    assert wrong.count() == 0


def test_urls_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{FOLDER}/pages.parquet'")
    got = sorted(map(tuple, QUERIES["op9_url_filter"](spark, FOLDER).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert got == sorted(con.execute(SQL["op9_url_filter"]).fetchall())


def test_page_texts(spark):
    """The article's blocks, cut out by pattern, as the pages of the table are made."""
    rows = {r["page_id"]: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in QUERIES["op10_html_text"](spark, FOLDER).collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer|$)", rows[r["page_id"]]["html"], re.S).group(1)
        parts = (re.sub(r"<br>", " ", re.sub(r"</?b>", "", x)) for x in re.split(r"</?(?:p|h1|article)>", body))
        blocks = [" ".join(html.unescape(x).split()) for x in parts]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.fixture(scope="module")
def model(spark):
    return pages_html.train(spark.read.parquet(f"{FOLDER}/pages.parquet"))


def test_page_without_semantic_tags(model):
    s = "The quick brown fox, a nice animal, jumped over the lazy dog and went home to sleep there for a while."
    page = (
        f'<html><body><div class="top"><a href=x>Home</a> <a href=y>News</a></div><div class="wrap"><div class="post"><h2>Title'
        f"</h2><p>{s}</p><p>{s}&nbsp;x &lt;b&gt;<br>next line<script>var x='</p>'</script></p><!-- <p>no</p> --></div>"
        f'<div class="sidebar"><p>{s}</p></div><div id="comments"><p>{s}</p></div></div><form><p>Sign up {s}</p></form>'
    )
    assert pages_html.main_text(page, model) == f"Title\n{s}\n{s} x <b> next line"


def test_pages_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "<p>"), (4, "plain text of some length, really."), (5, "<" * 50), (6, "<div>" * 3000 + "deep text here.")]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "9 as text", "'u' as url")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages_html.extract(df, model).collect()}
    assert found[1] == found[2] == found[3] == ("", 0) and len(found) == 6
    assert pages_html.extract(df.limit(0), model).count() == 0
    assert pages_html.train(df.limit(0))["pair"] == [[1.0, 1.0], [1.0, 1.0]]


@pytest.mark.parametrize(
    "source",
    [
        "<head><title>T</title><p>One.</p><p>Two.",
        "<html><head><meta charset=x><style>p {}</style><div><p>One.</p><p>Two.</p></div></html>",
        "<head><template><p>no</p></template><script>'<p>no'</script><body><p>One.</p><p>Two.",
        "<head><title>T</title></head><body><p>One.</p><p>Two.</p>",
        "<body><div><svg><path d='x'></div><p>One.</p><p>Two.</p></body>",
        "<body><div><select><option>no</div><p>One.</p><section><object><p>no</p></section><p>Two.</p>",
        "<body><div><template><svg><g></div><p>One.</p><svg><svg></svg><text>no</text></svg><p>Two.</p>",
        "<head><title>T</title>One.<p>Two.",
        "<body><div><p>One.</p><template><div><p>no</p></div><br>no</template><svg><p>no</p>no</svg></div><p>Two.</p>",
        "<body><p>One.</p><svg><g></g><text>no</text></svg><p>Two.</p><template><div><p>no</p></div></template>",
    ],
)
def test_omitted_end_tags_lose_no_text(source):
    assert [text for _, text, _ in pages_html.Page(source).blocks] == ["One.", "Two."]


@pytest.mark.parametrize(
    "source",
    [
        "<" + "a" * 1_000_000,
        '<a b="' * 160_000,
        '<a b="' * 140_000 + "'>",
        "<div>" * 90_000 + "</p2>" * 90_000,
        "<a" * 500_000 + ' ">',
        "<li><ul>" + "<div>" * 60_000 + "<li></li>" * 60_000,
        "<svg>" + "<g>" * 120_000 + "</x></g>" * 60_000,
        "<b>" * 70_000 + "<div></div>" * 70_000,
        "<script>" + "</script" * 120_000,
        "<!" * 500_000,
    ],
    ids=lambda source: source[:12],
)
def test_broken_pages_take_linear_time(source, model):
    """A megabyte each; the time of a square would be hours."""
    started = time.process_time()
    page = pages_html.Page(source)
    assert time.process_time() - started < 10 and len(page.tag) == len(page.parent)


def test_pages_without_speaking_elements():
    """Menus and feet that pages share, articles of their own, in divisions without names."""
    def body(i):
        words = [f"w{i}x{j}" for j in range(60)]
        return [" ".join(words[j : j + 15]) + "." for j in range(0, 60, 15)]

    def page(i):
        menu = "".join(f"<div><a href=x>Part {j}</a></div>" for j in range(5))
        text = "".join(f"<div>{p}</div>" for p in body(i))
        foot = "<div>All of these pages belong to the same house of many pages and readers.</div>"
        return f"<body><div>{menu}</div><div>{text}</div><div>{foot}</div></body>"

    found = pages_html.fit([page(i) for i in range(40)])
    assert pages_html.main_text(page(50), found).startswith("\n".join(body(50)))
    assert "Part 1" not in pages_html.main_text(page(50), found)
    alone = pages_html.fit(["<p>One.</p>"])  # nothing to tell content by: all is
    assert pages_html.main_text("<div><p>One.</p><p>Two.</p></div>", alone) == "One.\nTwo."


def test_messages_give_exact_marginals(model):
    """Against the sum over all labellings of a small tree."""
    import itertools

    import numpy as np

    page = pages_html.Page("<body><div><p>One two, three.</p><ul><li>x</li></ul></div><footer>y</footer></body>")
    z = page.features() @ model["weights"]
    own = np.stack([1 / (1 + np.exp(z)), 1 / (1 + np.exp(-z))], axis=1)
    pair, n, total, sums = np.array(model["pair"]), len(page.tag), 0.0, np.zeros(len(page.tag))
    for labels in itertools.product((0, 1), repeat=n):
        weight = np.prod([own[i, x] for i, x in enumerate(labels)])
        weight *= np.prod([pair[labels[page.parent[i]], labels[i]] for i in range(1, n)])
        total += weight
        sums += weight * np.array(labels)
    assert pages_html.marginals(page, model) == pytest.approx(sums / total, abs=1e-9)


def test_pipeline(spark, docs):
    """Each stage's rows against its operator on the stage's own input."""
    from test_documents import near, quality_row

    kept = docs
    sizes = []
    for _, function in corpus_pipeline.STAGES:
        before, kept = kept, stage(function(spark, kept, FOLDER))
        sizes.append(kept.count())
        if function is corpus_pipeline.quality_stage:
            assert not [r for r in before.join(kept.select("doc_id"), "doc_id").collect() if quality_row(r["text"])[5]]
        if function is corpus_pipeline.near_duplicate_stage:
            groups = near({r["doc_id"]: r["text"] for r in before.collect()})
            assert {r["doc_id"] for r in kept.collect()} == {k for k, (_, c) in groups.items() if c == k}
        if function is corpus_pipeline.benchmark_stage:
            from tabulon.llm.decontaminate import contamination

            items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
            clean = {r["doc_id"] for r in contamination(before, items).where("n_hit = 0").collect()}
            same = {r["doc_id"]: r["text"] for r in before.collect()}
            after = {r["doc_id"]: r["text"] for r in kept.collect()}
            assert clean <= set(after) and all(after[k] == same[k] for k in clean)
        if function is not corpus_pipeline.encode_stage:
            assert kept.columns == corpus_pipeline.COLUMNS
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert corpus_pipeline.run(spark, FOLDER).count() == sizes[-1]


def test_near_duplicate_stage_keeps_null_ids_and_one_of_repeated_rows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a), (1, a), (2, a + " tail"), (None, b), (None, c), (None, c), (7, c + " tail"), (8, None), (9, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, FOLDER)
    assert kept.columns == corpus_pipeline.COLUMNS
    want = [(1, a), (7, c + " tail"), (8, None), (9, ""), (None, b)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_stages_on_odd_and_empty_tables(spark, odd, nothing):
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, odd, FOLDER).count() <= 13
        assert function(spark, nothing, FOLDER).count() == 0
