"""Language ID (2), near-duplicates (4), scores (5), repeated windows (6), decontamination (10)."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moodfeed.llm import decontaminate, gru, langid, near, queries, scoring, substring
from moodfeed.llm import words as wd
from moodfeed.llm.arrow import text_bytes

from .conftest import prose

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in queries.documents(spark, sf_dir).collect()}


# --- words ------------------------------------------------------------------


def test_words_are_those_of_the_patterns():
    import pyarrow as pa

    samples = ["a b", "", None, "  É x y\t\x0bz\x1c ", "Don't-STOP 12é", "\n"]
    data, offsets = text_bytes(pa.array(samples))
    for kind, pattern in (
        ("space", rb"[^\x20\x09-\x0D]+"),
        ("ascii", rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
    ):
        words = wd.words_of(data, offsets, kind, lower=True)
        got = [bytes(words.data[a:b]) for a, b in zip(words.starts, words.ends)]
        want = [re.findall(pattern, (s or "").encode().translate(LOWER)) for s in samples]
        assert got == [w for ws in want for w in ws]
        assert words.counts().tolist() == list(map(len, want))
        by_word = {}
        for w, h in zip(got, words.hashes.tolist()):
            assert by_word.setdefault(w, h) == h
        assert len(set(by_word.values())) == len(by_word)


# --- 2 ----------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op2_language_id(spark, sf_dir)
    docs = queries.documents(spark, sf_dir).select("doc_id", "lang")
    held = rows.join(docs, "doc_id").where("held_out")
    right = held.where("lang = lang_pred").count()
    assert right >= 0.99 * held.count() > 0
    assert rows.where("score < 0 OR score > 1").count() == 0


def test_kernel_is_the_share_of_common_grams():
    a, b = langid.presence("Ab ab!".encode()), langid.presence(b"abc")
    # a, b; " a", ab, "b "; " ab", "ab ", "b a" against a, b, c; " a", ab, bc, "c "; " ab", abc, "bc "
    assert (len(a), len(b), len(np.intersect1d(a, b))) == (8, 10, 5)
    assert len(langid.presence(b"12 3!")) == 0
    model = langid.fit([("x", a), ("y", b)], 5, 1e-2)
    assert model.kernels([a])[0] == pytest.approx([1, 5 / math.sqrt(80)])


def test_all_languages_are_learnt_however_many(spark):
    import random

    rows = []
    for i in range(140):
        rng = random.Random(i)
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(8)]
        rows += [(i * 10 + j, f"l{i}", " ".join(rng.choices(words, k=30))) for j in range(3 if i < 100 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.train(docs)
    assert set(model.languages) == {f"l{i}" for i in range(140)}
    got = langid.identify(docs, model, "own").select("lang", "own.lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(rows)


def test_awkward_documents_have_languages(awkward, nothing):
    model = langid.train(awkward)
    rows = langid.identify(awkward, model, "own").select("doc_id", "text", "own.*").collect()
    assert len(rows) == awkward.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
    empty = langid.train(nothing)
    assert {r.own.lang_pred for r in langid.identify(awkward, empty, "own").collect()} == {"und"}
    assert langid.identify(nothing, model, "own").count() == 0


# --- 4 ----------------------------------------------------------------------


def shingles(text):
    words = text.encode().translate(LOWER).split()
    k, seen, out = min(5, len(words)), Counter(), set()
    for i in range(len(words) - k + 1 if words else 0):
        gram = tuple(words[i : i + k])
        out.add((gram, seen[gram]))
        seen[gram] += 1
    return out


def brute_classes(docs, threshold=0.8):
    ids = sorted(docs)
    sets = {d: shingles(docs[d]) for d in ids}
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            total = len(sets[a]) + len(sets[b]) - common
            if docs[a] == docs[b] or (total and common >= threshold * total):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def edited(text, seed, edits):
    import random

    rng = random.Random(seed)
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_classes_are_those_of_all_pairs(spark):
    docs = {}
    for g in range(12):
        base = prose(100 + g, 30 + 40 * g)
        for k in range(6):
            docs[10 * g + k] = edited(base, 10 * g + k, k // 2)
    for k in range(40):
        docs[1000 + k] = edited(prose(55, 150), k, k % 7)
        docs[2000 + k] = prose(56, 60) + " " + prose(3000 + k, 90)  # a passage in common
        docs[3000 + k] = prose(60 + k % 9, 4 + k % 5)
    docs[4000], docs[4001] = "", ""
    rows = near.near_classes(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in rows.collect()} == brute_classes(docs)


def test_clouds_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    docs = {k: edited(prose(7, 200), k, k % 4) for k in range(120)}
    rows = near.near_classes(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in rows.collect()} == brute_classes(docs)


def test_an_id_with_several_texts_has_the_class_of_each(spark):
    a, b, c = prose(201, 60), prose(202, 60), prose(203, 60)
    near_a, near_b = edited(a, 1, 1), edited(b, 2, 1)
    rows = [(1, a), (5, near_a), (5, b), (7, near_b), (8, c), (8, edited(c, 3, 1)), (8, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = sorted((r.doc_id, r.class_id, r.kept) for r in near.near_classes(docs).collect())
    assert classes == [(1, 1, True), (5, 1, False), (5, 5, True), (7, 5, False), (8, 8, False), (8, 8, True)]
    kept = sorted((r.doc_id, r.text) for r in near.keep_first(docs).collect())
    assert kept[:2] == [(1, a), (5, b)] and len(kept) == 3 and kept[2][0] == 8


def test_alignment_keeps_the_order():
    a = np.arange(10, dtype=np.uint64)
    assert near.matched(a, a) == 10
    swapped = np.concatenate([a[5:], a[:5]])
    assert near.matched(a, swapped, 0.1) == 5
    assert not near.similar(a, swapped)
    assert near.similar(a, np.concatenate([a[:5], [99], a[5:]]).astype(np.uint64))


def test_awkward_documents_have_classes(awkward, nothing):
    rows = {r.doc_id: r.class_id for r in near.near_classes(awkward).collect()}
    assert rows == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10, 11: 10}
    kept = near.keep_first(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i) == [1, 4, 5, 6, 7, 8, 9, 10] and ids.count(None) == 2
    assert near.near_classes(nothing).count() == 0
    assert near.keep_first(nothing).count() == 0


# --- 5 ----------------------------------------------------------------------


def test_gradient_is_that_of_differences():
    shape = gru.Shape(2 * gru.WIDTH, 3)
    rng = np.random.default_rng(1)
    flat = rng.standard_normal(shape.length()) * 0.3
    x, y, owner = gru.lanes([rng.integers(0, shape.symbols, n) for n in (5, 3, 9, 1)], 2, shape.head)
    fresh = owner != np.vstack([np.full((1, owner.shape[1]), -2), owner[:-1]])
    h0 = rng.standard_normal((x.shape[1], gru.HIDDEN)) * 0.1

    def loss(w):
        return gru.window_gradient(shape, shape.unpack(w), x, y, fresh, h0)[0]

    grad = gru.window_gradient(shape, shape.unpack(flat), x, y, fresh, h0)[1]
    large = np.argsort(-np.abs(grad))[:400]
    for i in [*rng.choice(large, 60, replace=False), *rng.integers(0, len(flat), 20)]:
        step = np.zeros_like(flat)
        step[i] = 1e-5
        assert grad[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-5, abs=1e-4)


def test_scores_do_not_depend_on_lanes_or_windows_and_sum_to_one():
    shape = gru.Shape(2 * gru.WIDTH, 3)
    rng = np.random.default_rng(2)
    flat = (rng.standard_normal(shape.length()) * 0.3).astype(np.float32)
    scorer = gru.Scorer(shape, flat)
    samples = [rng.integers(0, shape.symbols, n).astype(np.int32) for n in (40, 0, 7, 7, 90)]
    one = scorer.score(samples, width=1, window=1000)
    assert scorer.score(samples, width=3, window=4) == pytest.approx(one, rel=1e-4)
    assert [scorer.score([s])[0] for s in samples] == pytest.approx(one, rel=1e-4)
    # all continuations of a start, the end among them
    start = samples[2]
    whole = scorer.score([start])[0]
    state = whole - math.log(1e-300)  # only its finiteness matters
    assert np.isfinite(state)
    singles = [np.append(start, s).astype(np.int32) for s in range(shape.symbols)]
    x, y, owner = gru.lanes(singles, 1, shape.head)
    p = shape.unpack(flat.astype(np.float64))
    total = 0.0
    for s in range(shape.symbols):
        inputs = np.append(shape.head, start)[:, None]
        outputs = np.append(start, s)[:, None]
        fresh = np.zeros(inputs.shape, bool)
        before = gru.window_gradient(
            shape, p, inputs[:-1], outputs[:-1], fresh[:-1], np.zeros((1, gru.HIDDEN))
        )[0]
        after = gru.window_gradient(shape, p, inputs, outputs, fresh, np.zeros((1, gru.HIDDEN)))[0]
        total += math.exp(before - after)
    assert total == pytest.approx(1)


def test_a_long_text_beside_short_ones_takes_memory_by_its_words():
    shape = gru.Shape(2 * gru.WIDTH, 3)
    flat = shape.start(np.ones(shape.symbols))
    samples = [np.full(n, 5, np.int32) for n in (40_000, *[3] * 255)]
    scorer = gru.Scorer(shape, flat)
    tracemalloc.start()
    scored = scorer.score(samples)
    trained = gru.train(shape, flat, samples)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # a cell for each lane and step would be 40 MB for each of three tables
    assert peak < 2e7
    assert scored == pytest.approx([scorer.score([x])[0] for x in samples], rel=1e-4)
    assert np.isfinite(trained).all() and (trained != flat).any()


def test_words_are_looked_up_as_by_search():
    rng = np.random.default_rng(3)
    near = np.uint64(77 << 40) + np.arange(300, dtype=np.uint64) * np.uint64(2)  # alike in their first bits
    edges = np.array([0, 2**64 - 1], np.uint64)
    spread = rng.integers(0, 2**64, 500, np.uint64)
    for hashes in (np.concatenate([near, edges, spread]), near, spread, edges[1:], edges[:0]):
        n = np.arange(1, len(hashes) + 1)
        common = pa.table({"word": hashes.view(np.int64), "n": n, "kind": np.ones(len(n), np.int32)})
        known = scoring.Vocabulary(common, int(n.sum()), len(n), {1: (int(n.sum()), len(n))})
        asked = np.concatenate([hashes, near + np.uint64(1), edges, rng.integers(0, 2**64, 100, np.uint64)])
        at, found = known.look_up(asked)
        counts = dict(zip(hashes.tolist(), n.tolist()))
        assert found.tolist() == [h in counts for h in asked.tolist()]
        assert known.counts[at[found]].tolist() == [counts[h] for h in asked[found].tolist()]


def test_word_counts_by_brute_force(spark):
    rows = ["a b, B. a", None, "", "A longer-word! a", "b,"]
    docs = spark.createDataFrame([(x,) for x in rows], "text string")
    found = {r.word: (r.kind, r.n) for r in scoring.word_counts(docs).collect()}
    want = Counter(w for x in rows for w in (x or "").lower().split())
    words, kinds = scoring.tokens(pa.array([" ".join(want)]))
    expected = {int(h): (int(k), n) for h, k, n in zip(words.hashes.view(np.int64), kinds, want.values())}
    assert found == expected | {int(scoring.END): (-1, len(rows))}


def test_base_scores_by_brute_force_and_a_better_model(spark, small, monkeypatch):
    monkeypatch.setattr(scoring, "COMMON", 3000)  # so that words are joined as well
    rows = {r.doc_id: r for r in queries.op5_gru_scores(spark, small).collect()}
    counts, docs = Counter(), {}
    for d, text in texts(spark, small).items():
        docs[d] = [*(text or "").encode().translate(LOWER).split(), None]
        if zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update(docs[d])
    n, v = sum(counts.values()), len(counts)
    assert set(rows) == set(docs)
    for d, words in docs.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert rows[d].base_score == pytest.approx(base)
        assert rows[d].n_tokens == len(words)
        assert rows[d].n_known == sum(counts[w] > 0 for w in words)
        assert rows[d].train_tokens == n
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_all_training_documents_train(spark, monkeypatch):
    monkeypatch.setattr(scoring, "TRAINER_TOKENS", 100)  # so that averages are averaged as well
    monkeypatch.setattr(scoring, "AVERAGED", 2)
    real, staged = scoring.stage, []

    def stage(df, name):
        staged.append(real(df, name))
        return staged[-1]

    monkeypatch.setattr(scoring, "stage", stage)
    docs = spark.createDataFrame([(i, prose(i, 40)) for i in range(50)], "doc_id long, text string")
    rows = scoring.score(docs, langid.held_out(5)).collect()
    learnt = next(x for x in staged if "draw" in x.columns)
    assert learnt.count() == sum(not r.held_out for r in rows) > 0
    assert all(np.isfinite(r.score) for r in rows)


def test_awkward_documents_have_scores(awkward, nothing):
    rows = scoring.score(awkward, langid.held_out(5)).collect()
    assert len(rows) == awkward.count()
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows)
    same = [(r.base_score, r.score) for r in rows if r.doc_id == 2]
    assert same[0] == pytest.approx(same[1])
    assert scoring.score(nothing, langid.held_out(5)).count() == 0


# --- 6 ----------------------------------------------------------------------


def brute_removed(docs, window):
    words = {d: (t or "").encode().split() for d, t in docs}
    count = Counter(
        tuple(words[d][i : i + window]) for d, _ in docs for i in range(len(words[d]) - window + 1)
    )
    out = []
    for d, _ in docs:
        w, gone = words[d], set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [2048, 3])
def test_repeated_windows_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    passage, loop = prose(900, 50), " ".join(["la", "li", "lu"] * 30)
    docs = [(d, prose(d, 60)) for d in range(40)]
    docs += [(100 + d, f"{prose(d, 3)} {passage} {prose(500 + d, 5)} {prose(d, 60)}") for d in range(15)]
    docs += [(200, loop), (201, loop[:200]), (202, prose(5, 36)), (203, prose(5, 35)), (204, None)]
    docs += [(300, prose(3, 60)), (300, prose(3, 60)), (301, prose(777, 34)), (302, prose(777, 34))]
    rows = substring.remove_repeated(
        spark.createDataFrame(docs, "doc_id long, text string"), digest=True
    ).collect()
    assert sorted(map(tuple, rows), key=str) == brute_removed(docs, 35)


def test_parse_follows_a_reference_to_its_end():
    # two pieces with one anchor: windows 5 6 7 8 and 9 6 7 3
    piece, start, n = substring.parse(
        np.zeros(2, np.int64), np.ones(2, np.int64), np.array([4, 4]),
        np.array([5, 6, 7, 8, 9, 6, 7, 3]),
    )
    assert list(zip(piece, start, n)) == [(0, 1, 2), (1, 1, 2)]


def test_awkward_documents_lose_windows(awkward, nothing):
    rows = substring.remove_repeated(awkward, digest=True).collect()
    want = brute_removed([(r.doc_id, r.text) for r in awkward.collect()], 35)
    # two rows without an id have different texts
    assert sorted((tuple(r) for r in rows if r.doc_id), key=str) == [w for w in want if w[0]]
    assert len(rows) == awkward.count()
    assert substring.remove_repeated(nothing).count() == 0


# --- 10 ---------------------------------------------------------------------


def brute_verdicts(docs, items, window=13):
    def words(text):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))

    tests = []
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        tests += [(str(item), tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for item, test in tests:
            for i in range(len(w) - len(test) + 1):
                if tuple(w[i : i + len(test)]) == test:
                    hit.update(range(i, i + len(test)))
                    found.add(item)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 23, 900])
def test_verdicts_by_brute_force(spark, block_bytes):
    items = [(i, prose(i, 20)) for i in range(20)]
    items += [(20, "two words"), (21, ""), (22, None), (23, prose(3, 20)), (10, prose(60, 15))]
    docs = [(d, prose(1000 + d, 40)) for d in range(10)]
    docs += [(100 + d, f"{prose(d + 50, 9)} {prose(d, 20).upper()} {prose(d + 80, d * 20)}") for d in range(20)]
    docs += [(200, "one two words two, words"), (201, None), (202, ""), (203, prose(4, 12))]
    docs += [(204, prose(60, 15)), (204, prose(60, 15))]
    judged = decontaminate.decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        "v",
        block_bytes=block_bytes,
    )
    rows = judged.select(
        "doc_id", "v.n_words", "v.n_hit", "v.n_items", "v.items_sha256", "v.contaminated"
    ).collect()
    assert sorted(map(tuple, rows), key=str) == brute_verdicts(docs, items)


def test_longest_match_and_its_place(spark):
    docs = spark.createDataFrame([(1, "x y " + prose(1, 20) + " z")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a " + prose(1, 20) + " b")], "item_id long, text string")
    v = decontaminate.decontaminate(docs, items, "v").first().v
    assert (v.longest, v.longest_at, v.longest_item) == (20, 2, "7")


def test_awkward_documents_are_judged(awkward, nothing):
    items = awkward.where("doc_id = 10").select(F.col("doc_id").alias("item_id"), "text")
    judged = decontaminate.decontaminate(awkward, items, "own")
    assert judged.columns == [*awkward.columns, "own"]
    assert sorted(r.doc_id for r in judged.where("own.contaminated").collect()) == [10, 11]
    none = nothing.select(F.col("doc_id").alias("item_id"), "text")
    assert decontaminate.decontaminate(awkward, none, "own").where("own.contaminated").count() == 0
    assert decontaminate.decontaminate(nothing, items, "own").count() == 0
