"""Near-duplicate vectors (3), main text of pages (7) and licences (9)."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodfeed.llm import html, licenses, queries, vectors
from moodfeed.llm.components import connect

# --- components -------------------------------------------------------------


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(5)
    order = rng.permutation(300).tolist()
    edges = list(zip(order, order[1:]))  # a chain
    edges += [(1000, 1000 + i) for i in range(1, 200)] + [(2000, 2001), (2001, 2000), (3000, 3000)]
    found = connect(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {
        **{i: 0 for i in range(300)},
        **{1000 + i: 1000 for i in range(200)},
        2000: 2000, 2001: 2000,
    }
    assert connect(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 3 ----------------------------------------------------------------------


def planted(n, groups, size, noise, seed=1, dim=32):
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((n, dim))
    for g in range(groups):
        centre = rng.standard_normal(dim)
        rows[g * size : (g + 1) * size] = centre + noise * rng.standard_normal((size, dim))
    return rows.astype(np.float32)


def brute_links(x):
    unit = vectors.unit(x)
    hits = unit @ unit.T >= vectors.LINK
    np.fill_diagonal(hits, False)
    return hits


def brute_parts(hits):
    own = np.arange(len(hits))
    while True:
        new = np.array([min(own[i], own[h].min(initial=own[i])) for i, h in enumerate(hits)])
        if (new == own).all():
            return own
        own = new


@pytest.mark.parametrize("block", [3000, 150])
def test_links_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "SHARD", 300)
    monkeypatch.setattr(vectors, "BLOCK", block)
    x = planted(1500, 12, 40, 0.2)
    x[1400:1410] = x[1400]  # equal ones
    table = spark.createDataFrame(
        [(i, row.tolist(), i % 3) for i, row in enumerate(x)],
        "vec_id long, embedding array<float>, label int",
    )
    rows = {r.vec_id: r for r in vectors.near_vectors(table).collect()}
    hits = brute_links(x)
    got = np.array([rows[i].n_links for i in range(len(x))])
    want = hits.sum(1)
    assert (got <= want).all() and got.sum() >= 0.98 * want.sum() > 0
    parts = np.array([rows[i].component_id for i in range(len(x))])
    assert (parts == brute_parts(hits)).mean() >= 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows.values())


def test_an_id_with_several_vectors_has_the_links_of_each(spark):
    rows = [(1, [1.0, 0.0]), (5, [1.0, 0.01]), (5, [0.0, 1.0]), (9, [0.01, 1.0]), (5, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in vectors.near_vectors(table).collect())
    assert got == [
        (1, 1, 1, True), (5, 1, 1, False), (5, 2, 5, True), (5, 2, 5, True), (9, 2, 5, False),
    ]


def test_search_in_a_pruned_graph_finds_what_is_in_range():
    x = vectors.unit(planted(600, 5, 60, 0.2))
    lists = vectors.robust_prune(x, vectors.DEGREE, vectors.POOL, vectors.ALPHA)
    assert max(map(len, lists)) <= 2 * vectors.DEGREE
    graph = np.full((len(x), max(map(len, lists))), -1)
    for i, own in enumerate(lists):
        graph[i, : len(own)] = own
    hits = brute_links(x)
    outside = np.full(len(x), -1)  # searched from the medoid only, itself included
    found = sum(len(f) - 1 for _, f in vectors.range_search(x, graph, x, outside))
    assert found >= 0.9 * hits.sum()
    inside = sum(len(f) for _, f in vectors.range_search(x, graph, x, np.arange(len(x))))
    assert inside >= 0.99 * hits.sum()


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.5, 0.5, 1.0]
    rows = [
        (1, good), (2, good), (2, good), (3, [5.0, 5.0, 10.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]),
        (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [None, 0.5, 1.0]), (10, [0.5, 0.5]),
        (None, good), (11, [-0.5, -0.5, -1.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn(
        "copies", F.lit(1)
    )
    got = sorted(map(tuple, vectors.near_vectors(table).collect()), key=str)
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)]
    linked = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False)]
    assert got == sorted([*alone, *linked, (None, 0, None, True)], key=str)
    assert vectors.near_vectors(table.limit(0)).count() == 0


# --- 7 ----------------------------------------------------------------------

TREE = html.grow(*html.labelled())

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header><a href=/>Home</a></header><nav class=menu><ul><li><a href=/a>A</a></li></ul></nav>
<div class="cookie-notice">We use cookies, accept them</div>
<article><header><h1>Big   title</h1></header><p>A para with <a href=x>a link</a> &amp; caf&eacute;.
<p>Second<br>para<!-- hidden --><script>var x = "<p>no</p>";</script><aside>Related</aside>
<form><button>Go</button></form><section class="comments"><p>Nice!</p></section></article>
<div id="sidebar"><p>Popular posts</p></div><footer>&copy; me</footer></body></html>"""


def test_main_text_of_a_page():
    want = "Big title\n\nA para with a link & café.\n\nSecond para"
    assert html.main_text(PAGE, TREE) == want


def test_pages_without_an_article_element():
    long = "This paragraph is long enough to look like the text of a page and has no links at all. "
    page = f"<div><a href=1>Home</a> | <a href=2>News</a></div><div><p>{long}<p>{long}{long}</div>"
    page += "<div><a href=3>Imprint</a></div>"
    assert html.main_text(page, TREE) == f"{long.strip()}\n\n{(long * 2).strip()}"


LONG = "A paragraph of the text itself, which is long and links to nothing, as those of the body are. " * 3
TEASER = "<h2><a href=/t>Read this as well, it is new</a></h2><p>A few words of it.<p><a href=/t>Read more</a>"


@pytest.mark.parametrize("teaser", ["<article>{}</article>", "<div class=post>{}</div>", "<section class=story>{}</section>"])
def test_densities_decide_where_an_article_element_is_a_teaser(teaser):
    body = f"<div><p>{LONG}<p>{LONG}<p>{LONG}</div>"
    want = "\n\n".join([LONG.strip()] * 3)
    assert html.main_text(body + teaser.format(TEASER), TREE) == want
    assert html.main_text(teaser.format(TEASER) * 2 + body, TREE) == want
    # beside a long article, a long plain block is content and short or linked ones are not
    page = f"<article><p>{LONG}<p>{LONG}</article><div>{LONG}</div><div>All rights reserved</div>"
    linked = "".join(f"<a href=/{i}>some other page of the site {i}</a> " for i in range(12))
    assert html.main_text(page + f"<div>{linked}</div>", TREE) == want
    inside = f"<article><p>{LONG}<p>{LONG}<p>{LONG}<div>{linked}</div></article>"
    assert html.main_text(inside, TREE) == want


@pytest.mark.parametrize(
    "around",
    [
        "<article class='post comments-open'>{}</article>", "<article class='post tag-alert'>{}</article>",
        "<div class='content has-sidebar'>{}</div>", "<main id=content-related>{}</main>",
        "<div class=page-header-fixed>{}</div>", "<form action=x>{}</form>", "<div class=widget>{}</div>",
        "<form><article>{}</article></form>", "<article class=comments>{}</article>",
    ],
)
def test_a_name_or_form_around_the_page_loses_nothing(around):
    body = f"<p>{LONG}<p>{LONG}<div class=comments><p>Nice!</div>"
    page = f"<nav><a href=/>Home</a></nav>{around.format(body)}<div class=sidebar>Popular posts of the week</div>"
    assert html.main_text(page, TREE) == f"{LONG.strip()}\n\n{LONG.strip()}"
    # boilerplate beside an article stays out, also where it is longer
    other = f"<div class=comments><p>{LONG}<p>{LONG}<p>{LONG}</div>"
    assert html.main_text(f"<article><p>{LONG}</article>{other}", TREE) == LONG.strip()


@pytest.mark.parametrize(
    "page", [None, "", " ", "<", "<p", "<!--", "<script>", "</div></p>", "<a href='", "&#x110000;", "<p>&nbsp;"]
)
def test_broken_pages(page):
    assert isinstance(html.main_text(page, TREE), str)


def test_links_are_counted():
    blocks = html.cut("<p>one <a href=x>two three</a> four</p><p>five</p>")
    assert (blocks.words, blocks.links) == ([4, 1], [0.5, 0.0])


def test_anchors_without_target_or_end_lose_nothing():
    want = "\n\n".join([LONG.strip()] * 3)
    for anchor in ("<a name=top>", "<a id=x>", "<a href=#top>", "<A HREF='/x'>"):
        page = f"<article>{anchor}<p>{LONG}<p>{LONG}<p>{LONG}</article>"
        assert html.main_text(page, TREE) == want, anchor
        assert html.main_text("<nav><a href=/>Home</a></nav>" + page, TREE) == want, anchor
    # a link around blocks links all of them
    blocks = html.cut("<a href=x><h3>one two</h3><p>three</p></a><p>four</p>")
    assert (blocks.words, blocks.links) == ([2, 1, 1], [1.0, 1.0, 0.0])


@pytest.mark.parametrize(
    "name",
    ["<ol id=comment-list>", "<div class=comment-body>", "<div class=comment-list>", "<div class=site-footer>",
     "<div class=sidebar-right>", "<div class='x col-sidebar'>", "<div class=popular-posts>", "<div class=ad-slot>"],
)
def test_names_with_a_place_are_boilerplate(name):
    tag = name[1:].split()[0]
    other = f"{name}<p>{LONG}</{tag}>"
    want = f"{LONG.strip()}\n\n{LONG.strip()}"
    assert html.main_text(f"<article><p>{LONG}<p>{LONG}</article>{other}", TREE) == want
    assert html.main_text(f"<article><p>{LONG}<p>{LONG}{other}</article>", TREE) == want


def test_long_pages_take_linear_time():
    import time

    pieces = ["<p>", "<", "<!", "<a href=\"x", "<p>word ", "</p>", "<!-- ", "<div class='", "<div></b>", "<b></div>"]
    pieces += ["<span></i>", "<a href=x>", "<a href=x></p>", "<a href=x></a>", "<body>", "<div><p>"]
    for piece in pieces:
        start = time.perf_counter()
        html.main_text(piece * 20000, TREE)
        assert time.perf_counter() - start < 2, piece
    start = time.perf_counter()
    html.main_text("<div>" * 20000 + "</b>" * 20000, TREE)
    assert time.perf_counter() - start < 1


def test_articles_of_the_pages_table(spark, small):
    import html as entities

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = queries.op7_main_text(spark, small).collect()
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [re.sub(r"<[^>]+>", " ", x) for x in re.split(r"</?(?:p|h1)>", inner)]
        parts = [" ".join(entities.unescape(x).split()) for x in parts]
        assert r.text == "\n\n".join(x for x in parts if x)
        assert r.n_chars == len(r.text)


def test_awkward_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", PAGE), (2, "u", PAGE), (None, None, PAGE * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn(
        "text", F.lit("x")
    )
    got = html.extract(pages, "own")
    assert got.columns == ["page_id", "url", "html", "text", "own"] and got.count() == 5
    assert html.extract(pages.limit(0), "own").count() == 0


# --- 9 ----------------------------------------------------------------------


def plain_terms(text):
    return [t for t in re.split(r"[^\w]+|_", text.lower()) if t]


def brute_license(text, n, frequency):
    """Every window by its definition, every word by the number of texts that have it."""

    def vector(words):
        return {t: words.count(t) * (math.log((n + 1) / (frequency.get(t, 0) + 1)) + 1) for t in words}

    def size(v):
        return math.sqrt(sum(w * w for w in v.values()))

    words, places = plain_terms(text or ""), {}
    for i, (license, named, notice) in enumerate(licenses.TEMPLATES):
        named, own = plain_terms(named), plain_terms(notice)
        u = vector(own)
        for p in range(len(words)):
            if words[p] == named[0]:
                at = max(0, min(p - own.index(named[0]), len(words) - len(own)))
                window = words[at : at + len(own)]
                if set(named) <= set(window):
                    v = vector(window)
                    dot = sum(w * v.get(t, 0) for t, w in u.items())
                    score = round(dot / size(u) / size(v), 6)
                    if score >= licenses.THRESHOLD:
                        length, top, first = places.setdefault(at, {}).get(license, (0, 0, -i))
                        places[at][license] = max(length, len(own)), max(top, score), first
    longest = ((at, *max((*x, name) for name, x in here.items())) for at, here in places.items())
    best = max(((score, -at, first, name) for at, _, score, first, name in longest), default=None)
    return best and (best[3], best[0], -best[1])


def gnu_header(name, version):
    return (
        f"# This program is free software: you can redistribute it and/or modify\n"
        f"# it under the terms of the GNU {name} Public License as published by\n"
        f"# the Free Software Foundation, either version {version} of the License, or\n"
        f"# (at your option) any later version.\n\nimport os\n"
    )


NOTICES = [
    ("x\nLicensed under the Apache License, Version 2.0", "Apache-2.0"),
    ("the MIT license", "MIT"),
    ("this work is public", None),
    (None, None),
    ("", None),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3", "GPL-3.0"),
    # wrapped over lines and comment marks
    ("some code\nThis work is licensed under the GNU General\nPublic License, version 3\nand more", "GPL-3.0"),
    ("/* Licensed under the Apache License,\n * Version 2.0 */\nint main() { return 0; }", "Apache-2.0"),
    (gnu_header("General", 3), "GPL-3.0"),
    (gnu_header("General", 2), "GPL-2.0"),
    (gnu_header("Lesser General", "2.1"), "LGPL-2.1"),
    (gnu_header("Affero General", 3), "AGPL-3.0"),
    ("// SPDX-License-Identifier: MIT\n#include <stdio.h>", "MIT"),
    ("# SPDX-License-Identifier: GPL-3.0-or-later\nimport os", "GPL-3.0"),
    ("# SPDX-License-Identifier: CC-BY-NC-SA-4.0\n", "CC-BY-NC-SA-4.0"),
    ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"),
    # whole licence texts
    ("Copyright (c) 2020 A B\n\n" + licenses.NOTICES[7][2], "MIT"),
    ("Copyright (c) 2020 A B\n" + licenses.NOTICES[9][2].replace(", ", ",\n"), "BSD-2-Clause"),
    ("Copyright (c) 2020 A B\n" + licenses.NOTICES[10][2].replace(", ", ",\n"), "BSD-3-Clause"),
    (licenses.NOTICES[10][2].replace("the copyright holder", "A B"), "BSD-3-Clause"),
    # names of other licences, or no notice at all
    ("SPDX-License-Identifier: Zlib", None),
    ("Licensed under the Zlib License", None),
    ("they went mit dem Zug; at MIT, nobody asked for a driving license", None),
    ("GNU make and the general public, license plates and version 3 of a long and quite different story", None),
    ("license " * 50, None),
]


def test_declared_licences_by_brute_force(spark, small):
    docs = queries.documents(spark, small).select("doc_id", "text")
    extra = [(900000 + i, text) for i, (text, _) in enumerate(NOTICES)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    whole = [set(plain_terms(t)) for t in texts.values() if t is not None]
    every = {t: k for w in whole for t in w if (k := sum(t in x for x in whole))}
    vocabulary = sorted({t for x in licenses.TEMPLATES for t in plain_terms(x[2])})
    n, frequency = licenses.document_frequencies(docs, vocabulary)
    assert n == len(whole)
    assert frequency == {t: k for t in vocabulary if (k := every.get(t, 0))}
    rows = licenses.declared(docs, "own").select("doc_id", "own.*").collect()
    got = {r.doc_id: (r.license, r.score, r.word) if r.license else None for r in rows}
    assert got == {d: brute_license(t, n, every) for d, t in texts.items()}
    verdicts = [got[d] and got[d][0] for d, _ in extra]
    assert verdicts == [license for _, license in NOTICES]


def test_a_notice_deep_in_a_long_text_is_found(spark):
    words = "nothing to be seen here but words " * 100_000
    texts = [(1, words + "license mit\n" + "license " * 20_000 + "the MIT License (MIT) " + words), (2, words)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.own for r in licenses.declared(docs, "own").select("doc_id", "own").collect()}
    assert (got[1].license, got[1].score, got[1].word) == ("MIT", 1.0, 720_002) and got[2] is None


def test_a_line_keeps_its_verdict_when_the_table_grows(spark):
    lines = ["in released under the MIT License en", "on licensed under the Apache License, Version 2.0 that"]

    def verdicts(times):
        plain = [f"in en on that w{i}" for i in range(500 * times)]
        texts = [(x,) for x in [*lines * (2 * times), *plain]]
        docs = spark.createDataFrame(texts, "text string")
        rows = licenses.declared(docs, "own").where("own IS NOT NULL").distinct().collect()
        return {r.text: (r.own.license, r.own.score) for r in rows}

    small, large = verdicts(1), verdicts(10)
    assert {t: v[0] for t, v in small.items()} == dict(zip(lines, ("MIT", "Apache-2.0")))
    assert {t: v[0] for t, v in large.items()} == {t: v[0] for t, v in small.items()}
    assert all(abs(large[t][1] - small[t][1]) < 0.01 for t in lines)


def test_licences_are_inherited_from_the_nearest_directory(spark):
    rows = [
        ("LICENSE", "MIT", 0.9), ("a/LICENSE.txt", "GPL-3.0", 0.7), ("a/COPYING", "Apache-2.0", 0.8),
        ("a/b/c/x.py", None, None), ("a/y.py", "CC0-1.0", 0.95), ("z.py", None, None),
        ("d/e/w.py", None, None), (None, None, None), ("ab/v.py", None, None), ("a/b/licenses.py", "MIT", 1.0),
    ]
    files = spark.createDataFrame(rows, "path string, license string, score double").select(
        "path",
        F.when(F.col("license").isNotNull(), F.struct("license", "score")).alias("own"),
        F.lit("x").alias("directory"), F.lit("x").alias("nearest"), F.lit("x").alias("_nearest"),
    )
    out = licenses.inherit(files, "own", "found")
    assert out.columns == [*files.columns, "found"]
    got = {r.path: r.found and (r.found.license, r.found.origin, r.found.sources) for r in out.collect()}
    assert got == {
        "LICENSE": ("MIT", "own", "LICENSE"),
        "a/LICENSE.txt": ("GPL-3.0", "own", "a/LICENSE.txt"),
        "a/COPYING": ("Apache-2.0", "own", "a/COPYING"),
        "a/b/c/x.py": ("Apache-2.0", "inherited", "a/COPYING"),
        "a/y.py": ("CC0-1.0", "own", "a/y.py"),
        "z.py": ("MIT", "inherited", "LICENSE"),
        "d/e/w.py": ("MIT", "inherited", "LICENSE"),
        None: None,
        "ab/v.py": ("MIT", "inherited", "LICENSE"),
        "a/b/licenses.py": ("MIT", "own", "a/b/licenses.py"),
    }


def test_awkward_documents_have_licences(awkward, nothing):
    files = awkward.withColumn("path", queries.licence_path())
    out = licenses.inherit(licenses.declared(files, "own"), "own", "found2")
    assert out.count() == awkward.count()
    empty = nothing.withColumn("path", queries.licence_path())
    assert licenses.inherit(licenses.declared(empty, "own"), "own", "found2").count() == 0
