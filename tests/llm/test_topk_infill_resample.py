"""Exact top products (11), fill-in-middle (12), importance resampling (13)."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moodfeed.llm import infill, resample, topk

from .conftest import CLASHING, prose

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


# --- 11 ---------------------------------------------------------------------


def brute_top(rows, k, every):
    whole = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            # doubles beyond 64 bits are cut as Spark's floor cuts them
            whole.append((i, [max(-(2**63), min(2**63 - 1, math.floor(256 * x))) if abs(256 * x) < math.inf
                              else (2**63 - 1 if x > 0 else -(2**63)) for x in v]))
    out = []
    for a, (i, v) in enumerate(whole):
        if i is None or i % every:
            continue
        scores = []
        for b, (j, w) in enumerate(whole):
            if a != b and len(v) == len(w):
                s = max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w))))
                scores.append((-s, j is None, j or 0, j))
        scores.sort()
        out += [(i, r, j, -s) for r, (s, _, _, j) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def top(spark, rows, k=5, every=5, columns="vec_id long, embedding array<double>"):
    table = spark.createDataFrame(rows, columns)
    found = topk.top_products(table, F.col("vec_id") % every == 0, k)
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_top_products_of_awkward_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    rows += [(i, [0.5, -0.25, 0.125, 1.0, -1.0, 2.0]) for i in range(60, 90)]  # one vector, many ids
    rows += [rows[5], rows[5], (5, [9.0] * 6), (10, [0.0] * 6), (10, [0.0] * 6)]
    rows += [(None, [3.0] * 6), (None, [3.0] * 6), (100, None), (105, []), (110, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(115, [float("nan")] * 6), (120, [float("inf")] * 6), (125, [1.0, 2.0]), (126, [2.0, 2.0])]
    assert top(spark, rows) == brute_top(rows, 5, 5)
    assert top(spark, rows[:3], 5, 1) == brute_top(rows[:3], 5, 1)
    assert top(spark, rows[:1], 5, 1) == []
    assert top(spark, []) == []


def test_top_products_of_huge_components(spark):
    rows = [(0, [1e300, 1.0]), (5, [-1e300, 1e30]), (10, [4e7, 3.0]), (11, [1e17, -1e17]), (12, [1.0, 2.0])]
    assert top(spark, rows, 3) == brute_top(rows, 3, 5)


def test_top_products_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_BLOCK", 50)
    monkeypatch.setattr(topk, "LEAST_QUERIES", 7)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 8)) * rng.exponential(1.0, (900, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert top(spark, rows, 4, 10) == brute_top(rows, 4, 10)


def test_search_prunes_without_loss():
    rng = np.random.default_rng(4)
    c = np.floor(256 * rng.standard_normal((3000, 16)) * np.geomspace(4, 0.01, 16)).astype(np.int64)
    c = c[np.argsort(-np.sqrt((c.astype(float) ** 2).sum(1)), kind="stable")]
    q = c[::100]
    rotation = np.linalg.svd(c.astype(float), full_matrices=True)[2].T
    first = rng.permutation(len(c)).astype(np.int64)
    full = q @ c.T
    want = [np.lexsort((first, -row))[:6].tolist() for row in full]
    for turned in (None, rotation):
        calls = []
        plain = topk._products
        topk._products = lambda *a: calls.append(len(a[2])) or plain(*a)
        try:
            who, cand, score = topk.search(q, c, first, np.full(len(q), np.nan), turned, 6)
        finally:
            topk._products = plain
        assert [cand[who == i].tolist() for i in range(len(q))] == want
        assert (score == full[who, cand]).all()
    # the rotated partial sums leave few exact products
    assert sum(calls) < 0.3 * full.size


def test_top_products_with_other_columns(spark):
    rows = spark.range(12).select(
        F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"),
        *(F.lit(1).alias(c) for c in ("block", "place", "query", "score", "ints", "id", "length")),
    )
    found = topk.top_products(rows, F.col("vec_id") % 4 == 0, 2)
    assert found.count() == 6


# --- 12 ---------------------------------------------------------------------


def brute_infill(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.text(alphabet=st.sampled_from("abZ é😀\n\x00<PSM>0"), max_size=400), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_skip_list_reaches_every_rank(text, piece):
    whole = infill.PIECE
    infill.PIECE = piece
    try:
        units = infill.SkipList(text)
    finally:
        infill.PIECE = whole
    parts = UNIT.findall(text)
    assert units.n == len(parts)
    for rank in range(len(parts) + 1):
        assert units.cut(rank) == sum(map(len, parts[:rank]))


def test_skip_list_has_express_lanes():
    text = prose(6, 60000)
    units = infill.SkipList(text)
    assert len(units.lanes) >= 3
    for lane, above in zip(units.lanes, units.lanes[1:]):
        assert len(above.units) < len(lane.units) / 8
    for lane in units.lanes:
        assert lane.units.sum() == units.n and lane.points.sum() == len(text)
    ends = [0]
    for m in UNIT.finditer(text):
        ends.append(m.end())
    for rank in random.Random(3).sample(range(units.n + 1), 300):
        assert units.cut(rank) == ends[rank]


def check_infill(docs):
    rows = infill.transform(docs, "infilled").select(
        "doc_id", "text", "infilled.*", infill.restored(F.col("infilled.output"), F.col("infilled.form")).alias("back")
    ).collect()
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_infill(r.doc_id, r.text)
        assert r.back == (r.text or "")
    return rows


def test_infill_of_awkward_documents(awkward, nothing):
    assert len(check_infill(awkward)) == awkward.count()
    assert check_infill(nothing) == []
    assert set(infill.transform(awkward, "infilled").columns) == {*awkward.columns, "infilled"}


def test_infill_of_marks_and_strange_characters(spark):
    texts = ["<P>", "a <S> b", "<M", "<", "<P", "S>", "<<S", "P><", "é😀é", "́a", "\x00\n\r", "KK", "a" * 5000, "< >" * 700]
    rows = [(100 * i + j, t) for i in range(40) for j, t in enumerate(texts)]
    found = check_infill(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_infill_of_a_very_long_text(spark):
    rows = [(i, prose(i, 20) + " é" * 700_000 + prose(i + 1, 200_000)) for i in range(2)]
    check_infill(spark.createDataFrame(rows, "doc_id long, text string"))


# --- 13 ---------------------------------------------------------------------


def words(text):
    return [w.decode() for w in WORD.findall((text or "").encode().translate(LOWER))]


def runs(ws, longest):
    return [" ".join(ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]


def brute_resample(docs, target, percent=10, least=20, longest=1, buckets=10_000):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    own = [[bucket(f) for f in runs(words(t), longest)] for _, t in docs]
    s = Counter(b for bs in own for b in bs)
    t = Counter(bucket(f) for x in target for f in runs(words(x), longest))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {
        b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
        for b in {*s, *t}
    }
    rows = []
    for (i, text), bs in zip(docs, own):
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(bs), weight, score, None, len(words(text)) >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def resampled(docs, target, **options):
    found = resample.resample(docs, target, "drawn", **options).select(
        "doc_id", "drawn.n_features", "drawn.weight", "drawn.score", "drawn.rank"
    )
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_resampling_of_awkward_documents(spark, awkward, nothing):
    target = spark.createDataFrame([(1, prose(1, 40)), (2, None), (2, "Word wORD 123 É")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    aims = [r.text for r in target.collect()]
    for options in ({"percent": 50}, {"percent": 70, "longest": 3, "buckets": 97, "least_words": 2}, {"percent": 0}):
        want = brute_resample(docs, aims, options["percent"], options.get("least_words", 20),
                              options.get("longest", 1), options.get("buckets", 10_000))
        assert resampled(awkward, target, **options) == want
    assert resampled(awkward, target.limit(0), percent=50) == brute_resample(docs, [], 50)
    assert resampled(nothing, target) == []
    kept = resample.resample(awkward, target, "drawn")
    assert kept.columns == [*awkward.columns, "drawn"]


def test_resampling_draws_what_looks_like_the_target(spark):
    rows = [(i, " ".join(random.Random(i).choices(["alpha", "beta", "gamma"] if i % 4 else ["one", "two"], k=40)))
            for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(1, "one two two one " * 30)], "item_id long, text string")
    found = resampled(docs, target)
    assert found == brute_resample(rows, ["one two two one " * 30])
    drawn = [r for r in found if r[4] is not None]
    assert len(drawn) == 40 and sum(r[0] % 4 == 0 for r in drawn) >= 36


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_pieces_of_long_texts_lose_no_run(longest, monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 37)
    splitter = resample.Splitter()
    texts = [prose(3, 200), "x" * 300, "a " + "y" * 100 + " b " + "z" * 90, " " * 200 + "w", "é" * 80 + "." + "b c d " * 30, ""]
    for text in texts:
        n, keys, counts = resample.histogram(splitter, text, longest, 1000)
        want = Counter(zlib.crc32(f.encode()) % 1000 for f in runs(words(text), longest))
        assert n == len(words(text))
        assert dict(zip(keys.tolist(), counts.tolist())) == want


def test_splitter_is_the_pattern():
    splitter = resample.Splitter()
    for text in ("a b", "\x00x\x7f", "é.ö 12-3", "", "...", "日本 語,k", "á K"):
        got = [text[a:b] for a, b in splitter.pairs(text)]
        assert got == [w.decode() for w in WORD.findall(text.encode())]


def test_other_columns_may_clash(spark):
    docs = spark.createDataFrame([(1, "some words here", 5)], "doc_id long, text string, n_words long")
    docs = docs.select("*", *(F.lit("x").alias(c) for c in CLASHING), F.lit(1).alias("_order"))
    found = resample.resample(docs, docs, "drawn", percent=100, least_words=1)
    assert found.first().drawn.rank == 1
