"""Chats, pages, neighbours and the pipeline."""

from __future__ import annotations

import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import op1_language, op4_chats, op5_html, op6_pii, op9_neighbours
from tests.llm import plain

SF = "/root/testdata/sf0.001"


# Chats


@given(st.lists(st.tuples(st.text(max_size=6), st.text(alphabet="<|>\\im_end start\nx", max_size=40)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_template_is_reversible(turns):
    formatted, spans = op4_chats.format_turns([*turns, ("assistant", "<|im_end|>\\")])
    assert op4_chats.parse(formatted) == [*turns, ("assistant", "<|im_end|>\\")]
    learned = [op4_chats.unescape(formatted[a:b]) for a, b in spans]
    assert learned == [t for r, t in turns if r == "assistant"] + ["<|im_end|>\\"]


def test_conversations_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    wanted = con.execute(op4_chats.ORACLE).fetchall()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    found = [tuple(r) for r in op4_chats.op4_chats(spark, SF).select(names).collect()]
    assert sorted(found) == sorted(wanted)


def test_branches_are_ranked_by_score(spark):
    rows = [
        (1, 1, None, "user", "a", 0.0),
        (1, 2, 1, "assistant", "b", 1.0),
        (1, 3, 1, "assistant", "c", 2.0),
        (1, 4, 3, "user", "d", -5.0),
        (1, 5, 2, "user", None, 0.0),
        (1, 6, 2, None, "f", 0.0),
        (2, 1, 99, "user", "lost parent", None),
        (None, 1, None, "user", "x", 1.0),
        (None, 2, 1, "assistant", "y", 1.0),
    ]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    found = {(r["tree"], r["path"]): op4_chats.parse(r["formatted"]) for r in op4_chats.format_paths(messages, 2).collect()}
    assert found == {
        (1, 1): [("user", "a"), ("assistant", "b"), ("user", "")],
        (1, 2): [("user", "a"), ("assistant", "b"), ("", "f")],
        (2, 1): [("user", "lost parent")],
        (None, 1): [("user", "x"), ("assistant", "y")],
    }
    assert op4_chats.format_paths(messages.where("false")).count() == 0
    circle = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "tree long, node long, parent long")
    circle = circle.withColumns({"role": F.lit("user"), "text": F.lit("t"), "score": F.lit(0.0)})
    op4_chats.ROUNDS, kept = 5, op4_chats.ROUNDS
    with pytest.raises(ValueError):
        op4_chats.format_paths(circle)
    op4_chats.ROUNDS = kept


def test_long_conversations_and_ties(spark):
    rows = [(1, k, "user", f"t{k}", 0) for k in range(300)]
    rows += [(2, 0, "user", "b", 0), (2, 0, "user", "a", 0), (2, 0, "user", "a", 0), (None, 1, None, None, 0)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int")
    found = {r["tree"]: op4_chats.parse(r["formatted"]) for r in op4_chats.format_paths(op4_chats.linear_messages(frame)).collect()}
    assert found[1] == [("user", f"t{k}") for k in range(300)]
    assert found[2] == [("user", "a"), ("user", "a"), ("user", "b")]
    assert found[None] == [("", "")]


# Pages

PARAGRAPHS = ["A long first paragraph of the article, with many plain words in it, and some more of them.", "By.", "Ünïcode &amp; <b>bold</b>\n  words   here in the third paragraph of this article."]
TEXT = "Title here\nA long first paragraph of the article, with many plain words in it, and some more of them.\nBy.\nÜnïcode & bold words here in the third paragraph of this article."
BODY = "<h1>Title here</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li>One<li>Two</ul></nav><article>{BODY}</article><footer>&copy; x</footer></body></html>",
        f"<body class='with-sidebar'><header>Site name</header><div role=navigation>menu</div><main>{BODY}<form>Your <input> name</form></main><aside>More to read, a long list of other things, that goes on.</aside>",
        f"<div id='top-banner'>Buy now</div><div class='post'>{BODY}<div class='comments'><p>{'What a nice article this is. ' * 20}</p></div></div><div class='cookie-notice'>We use cookies on this site.</div>",
        f"<script>var a='<p>x</p>'</script>{BODY}<!-- <p>no</p> --><div class=ad>An advert</div><noscript>no</noscript><p hidden>hidden</p>",
        BODY.replace("</p>", ""),
        BODY.replace("<p>", "<div>").replace("</p>", "</div>"),
    ],
)
def test_article_text(page):
    assert op5_html.main_text(page) == TEXT


def test_odd_pages(spark):
    assert op5_html.main_text(None) == op5_html.main_text("") == op5_html.main_text("<p></p>") == ""
    assert op5_html.main_text("only text &lt;here&gt; &#233;") == "only text <here> é"
    assert op5_html.main_text("<![weird <p>a</p>") .endswith("a")
    long = "<article>" + "<p>some words in a paragraph</p>" * 20_000 + "</article>"
    assert op5_html.main_text(long).count("\n") == 19_999
    assert "x" in op5_html.main_text("<div>" * 3000 + "x")
    pages = spark.createDataFrame([(1, None, None, 1), (None, "u", "<p>t", 2), (2, "u", "<p>t", 3), (2, "u", "<p>t", 3)], "page_id long, url string, html string, text int")
    got = sorted(((r["page_id"], r["text"]) for r in op5_html.extract(pages).collect()), key=str)
    assert got == [(1, ""), (2, "t"), (2, "t"), (None, "t")]
    assert op5_html.extract(pages.where("false")).count() == 0


def test_pages_without_an_article_keep_their_ends():
    body = "".join(f"<p>{'a long sentence of the text ' * (3 + k % 9)}</p>" for k in range(30))
    links = "<ul>" + "<li><a href='/x'>somewhere else</a></li>" * 5 + "</ul>"
    text = op5_html.main_text(f"<body>{links}<h1>T</h1><p>lead</p><div>{body}</div><p>end</p></body>").split("\n")
    assert "T" in text and "lead" in text and text[-1] == "end"
    inner = op5_html.main_text(f"<body>{links}<div><h1>T</h1><div>{body}</div><p>end</p></div></body>").split("\n")
    assert inner[0] == "T" and inner[-1] == "end" and len(inner) == 32
    two = op5_html.main_text(f"<body><section>{body}</section><section><p>and a few words more</p></section></body>")
    assert two.endswith("and a few words more")
    parts = "<p>six of ten parts are here</p>" * 6, "<p>four of ten parts are here</p>" * 4
    found = op5_html.main_text("<main><article>{}</article><article>{}</article></main>".format(*parts))
    assert found.count("six") == 6 and found.count("four") == 4


@pytest.mark.parametrize(
    "name", ["class='content has-sidebar'", "id='page' class='no-comments'", "class='social-science'", "class='post with-ads'", "class='comments'"]
)
def test_no_name_alone_takes_the_article(name):
    body = "<p>a sentence of the text that counts</p>" * 10
    aside = "<div class='sidebar-left'><p>elsewhere</p></div>"
    assert op5_html.main_text(f"<body><div {name}>{body}{aside}</div></body>").split("\n") == ["a sentence of the text that counts"] * 10
    if name != "class='comments'":
        parts = f"<div {name}><p>first part</p></div><div>{body}</div>"
        assert op5_html.main_text(f"<body>{parts}</body>").startswith("first part")


def test_pages_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    found = {r["page_id"]: r for r in op5_html.op5_html(spark, SF).collect()}
    for row in rows:
        text = found[row["page_id"]]["text"]
        assert len(text) == found[row["page_id"]]["n_chars"]
        inside = row["html"].partition("<article>")[2].partition("</article>")[0]
        assert "".join(text.split()) == "".join(op5_html.main_text(inside).split())


# Neighbours


def nearest(ids, vectors, queries, n):
    """Brute force in double precision, ties to the smaller id."""
    out = {}
    for q in queries:
        scores = np.array([np.einsum("ij,j->i", v[None], vectors[q])[0] for v in vectors])
        order = [k for k in np.lexsort((ids, -scores)) if ids[k] != ids[q]][:n]
        out[int(ids[q])] = [(int(ids[k]), float(scores[k])) for k in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    ids, vectors = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(float)
    wanted = nearest(ids, vectors, np.flatnonzero(ids % 20 == 0), 20)
    found: dict = {}
    for r in op9_neighbours.op9_neighbours(spark, f"/root/testdata/{sf}").collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert set(found) == set(wanted)
    hits = sum(len(set(found[q]) & {k for k, _ in w}) for q, w in wanted.items())
    assert hits >= 0.9 * sum(map(len, wanted.values()))
    for q, w in wanted.items():
        for k, score in w:
            assert k not in found[q] or found[q][k] == pytest.approx(score, abs=1e-12)


def test_neighbours_of_odd_vectors(spark):
    random = np.random.default_rng(3)
    good = [(k, random.normal(size=4).tolist(), 1) for k in range(60)]
    copies = [(k, [1.0, 2.0, 3.0, 4.0], 1) for k in range(100, 160)]
    nan, inf = float("nan"), float("inf")
    odd = [(200, None, 1), (220, [], 1), (240, [0.0] * 4, 1), (260, [1.0, None, 1.0, 1.0], 1), (280, [nan, 1.0, 1.0, 1.0], 1)]
    odd += [(300, [inf, 1.0, 1.0, 1.0], 1), (320, [1.0, 2.0], 1), (None, [1.0] * 4, 1), (5, good[5][1], 2)]
    rows = spark.createDataFrame([*good, *copies, *odd], "vec_id long, embedding array<double>, score int")
    found: dict = {}
    for r in op9_neighbours.search(rows, rows.where("vec_id % 20 = 0"), 7).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ids = np.array([k for k, *_ in [*good, *copies]])
    vectors = np.array([v for _, v, _ in [*good, *copies]])
    assert found == nearest(ids, vectors, np.flatnonzero(ids % 20 == 0), 7)
    few = rows.where("vec_id IN (0, 1, 2)")
    assert op9_neighbours.search(few, few.where("vec_id = 0")).count() == 2
    assert op9_neighbours.search(rows.where("false"), rows.where("false")).count() == 0
    assert op9_neighbours.search(rows, rows.where("false")).count() == 0


def test_recall_where_lists_are_left_out(spark):
    """Several hundred lists of vectors without clusters, under half of which are looked at."""
    vectors = np.random.default_rng(11).normal(size=(30_000, 64))
    column = pa.FixedSizeListArray.from_arrays(vectors.ravel(), 64).cast(pa.list_(pa.float64()))
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(30_000), "embedding": column}))
    found: dict = {}
    for r in op9_neighbours.search(rows, rows.where("vec_id % 250 = 0")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 30_000, 250):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        assert len(found[q]) == 20
        hits += len(found[q] & set(np.argpartition(-scores, 20)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(found)


def test_a_query_at_a_centre_looks_around():
    centres = np.random.default_rng(5).normal(size=(200, 8))
    lists = op9_neighbours.Lists(centres, op9_neighbours.neighbour_graph(centres), 9.0)
    assert len(lists.selected(centres[7])) >= op9_neighbours.LISTS_LEAST


def test_neighbours_of_repeated_ids(spark):
    vectors = np.random.default_rng(13).normal(size=(200, 8))
    query = np.ones(8)
    # Id 999 has 100 different vectors, each nearer to the query than any other.
    many = [(999, (query * (20 + k / 100)).tolist()) for k in range(100)]
    rows = [(0, query.tolist()), *[(k, v.tolist()) for k, v in enumerate(vectors, 1)]]
    single = {(r["rank"], r["vec_id"]) for r in search_of(spark, [*rows, many[-1]])}
    assert len(single) == 20 and (1, 999) in single
    assert {(r["rank"], r["vec_id"]) for r in search_of(spark, [*rows, *many])} == single
    assert {(r["rank"], r["vec_id"]) for r in search_of(spark, [*rows, *many[-1:] * 100])} == single
    assert {(r["rank"], r["vec_id"]) for r in search_of(spark, [*rows, many[-1]] * 5)} == single


def search_of(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return op9_neighbours.search(frame, frame.where("vec_id = 0")).collect()


# Pipeline


def test_pipeline_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    odd = [(10_001, "", "en", "s", 0), (10_002, None, None, None, None), (10_003, "12 34", "en", "s", 5)]
    odd += [(10_004, rows[0][1], "en", "s", 1), (None, "words without an id", "en", "s", 19)]
    docs = spark.createDataFrame([*rows, *odd], docs.schema).repartition(4)
    texts = [(r[0], r[1]) for r in [*rows, *odd]]
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, SF)
        if name == "packing":
            break
        docs = corpus_pipeline.settle(docs)
        assert docs.columns == columns
        found = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
        if name == "language":
            texts = [(k, t) for k, t in texts if any(c.isalpha() for c in t or "")]
        elif name == "exact_copies":
            best = plain.kept_exact([(-1 if k is None else k, t) for k, t in texts])
            texts = [(k, t) for k, t in texts if (-1 if k is None else k) == best[t]]
        elif name == "near_copies":
            first = plain.near_components({k: t for k, t in texts if k is not None}, 5, 80)
            texts = [(k, t) for k, t in texts if k is None or first[k] == k]
        else:
            assert [k for k, _ in found] == [k for k, _ in sorted(texts, key=lambda r: str((r[0], r[1])))]
            plainly = dict(texts)
            for k, text in found:
                assert not plain.personal(text)
                if not plain.personal(plainly[k]):
                    assert text == plainly[k]
            texts = found
        assert found == sorted(texts, key=str)
    assert {r["doc_id"] for r in docs.collect()} == {k for k, _ in texts}


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_models_are_used_by_the_stages():
    assert op1_language.UNKNOWN == "und"
    assert op6_pii.KINDS == ("email", "ip", "card", "phone")


# Html: elements round the article, depth, a second extractor

BODY = "<p>Some words of the article that go on for a while.</p>" * 6


@pytest.mark.parametrize("around", ["<form>{}</form>", "<form><fieldset>{}</fieldset></form>", "<nav><a href=x>menu</a>{}", "<button>{}", "<header>{}", "<label>{}</label>"])
@pytest.mark.parametrize("inner", ["<article><h1>T</h1>{}</article>", "<div><h1>T</h1>{}</div>"])
def test_an_element_round_the_article_is_read(around, inner):
    text = op5_html.main_text("<body>" + around.format(inner.format(BODY)) + "</body>").split("\n")
    assert text[-7:] == ["T", *["Some words of the article that go on for a while."] * 6] and len(text) <= 8


def test_elements_beside_the_article_stay_out():
    links = "<a href=x>one of many links of a menu</a> " * 40
    for page in (
        f"<nav>{links}</nav><div>{BODY}</div><footer>rights</footer>",
        f"<form>{BODY}{BODY}{BODY}</form><article>{BODY}</article>",
        f"<article>{BODY}<form>comment here</form></article><footer>{BODY}{BODY}</footer>",
    ):
        assert op5_html.main_text(f"<body>{page}</body>").split("\n") == ["Some words of the article that go on for a while."] * 6


@pytest.mark.parametrize("opening", ["<div>w ", "<div class=ad>w ", "<form>w ", "<p class=ad><b class=ad>w "])
def test_unclosed_elements_take_time_in_proportion(opening):
    times = []
    for count in (25_000, 100_000):
        started = time.process_time()
        op5_html.main_text(opening * count)
        times.append(time.process_time() - started)
    assert times[1] < 8 * times[0] + 1 and times[1] < 60
    assert op5_html.main_text("<div>" * 100_000 + "x" + "</span>" * 100_000) == "x"


def test_pages_equal_a_plain_extractor(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = {r["page_id"]: r["text"] for r in op5_html.op5_html(spark, SF).collect()}
    assert found == {k: plain.article_text(h) for k, h in pages.items()}
