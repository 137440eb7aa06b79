"""Language profiles, dual-tree search and vector codes: brute force and edge cases."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import codes, dual_tree, language

CLASH = "lang_pred string, score double, code string, rank int, item string, gram string, `a.b` string"
EXTRA = ("x", 9.0, "y", 7, "z", "g", "dot")

# language


def brute_counts(text):
    n = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        w = "\x01" + w + "\x01"
        for k in (1, 2, 3):
            for i in range(len(w) - k + 1):
                if w[i:i + k] != "\x01":
                    n[w[i:i + k]] += 1
    return n


def brute_profile(counts, size):
    return {g: r for r, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:size])}


SENTENCES = {
    "aa": ["the cat sat on the mat", "that is the thing with the others", "there then this", "they thought that through"],
    "bb": ["der hund und die katze", "das ist nicht der und die", "auch ich und sie sind hier", "und dann doch nicht"],
    "çç": ["éa où ça été là", "où ça là-bas été", "ça été déjà vu là", "là où ça été"],
}


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in SENTENCES.items() for t in ts)]
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], f"doc_id long, text string, lang string, {CLASH}").repartition(3).cache()


@pytest.mark.parametrize("size", [5, 40, 300])
def test_language_against_brute_force(spark, spoken, size):
    model = language.train(spoken, size=size)
    want = {lang: brute_profile(sum((brute_counts(t) for t in ts), Counter()), size) for lang, ts in SENTENCES.items()}
    assert model.names == sorted(want)
    for r in language.identify(spoken, model, columns=["doc_id", "text", "lang"]).collect():
        own = brute_profile(brute_counts(r["text"]), size)
        far = {lang: sum(abs(k - p[g]) if g in p else size for g, k in own.items()) for lang, p in want.items()}
        best = min(far, key=lambda x: (far[x], x))
        assert r["lang_pred"] == best
        assert r["score"] == pytest.approx(1 - far[best] / (len(own) * size), abs=1e-8)


def test_language_edge_cases(spark, spoken):
    model = language.train(spoken)
    odd = [(1, None), (2, ""), (3, "12 34 !?"), (None, "the cat"), (5, "the cat"), (5, "the cat"), (6, "été ça " * 400_000), (7, "x" * 3_000_000)]
    df = spark.createDataFrame([(i, t, *EXTRA) for i, t in odd], f"doc_id long, text string, {CLASH}")
    out = language.identify(df, model)
    assert out.columns == ["doc_id", "text", "code", "rank", "item", "gram", "a.b", "lang_pred", "score"]
    rows = out.collect()
    got = sorted((str(r["doc_id"]), r["lang_pred"]) for r in rows)
    assert got[:3] == [("1", "und"), ("2", "und"), ("3", "und")] and got.count(("5", "aa")) == 2
    assert dict(got)["6"] == "çç" and dict(got)["None"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in rows) and {r["score"] for r in rows if r["lang_pred"] == "und"} == {0.0}
    empty = spoken.limit(0)
    nothing = language.train(empty)
    assert nothing.names == [] and language.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in language.identify(df, nothing).collect()} == {"und"}
    # null texts and languages teach nothing; a language without a letter has no profile
    more = spoken.select("doc_id", "text", "lang").union(spark.createDataFrame([(90, None, "dd"), (91, "the", None), (92, "123", "ee")], "doc_id long, text string, lang string"))
    assert language.train(more).names == ["aa", "bb", "çç"]


def test_language_pieces_count_like_the_whole(monkeypatch):
    text = " ".join(SENTENCES["aa"] * 50)
    whole = language.counts_of([text, "und"], np.array([0, 1]), 2)
    monkeypatch.setattr(language, "SIGNS_AT_ONCE", 64)
    parts = language.counts_of([text, "und"], np.array([0, 1]), 2)
    for f in ("owner", "gram", "n", "letters"):
        assert np.array_equal(getattr(whole, f), getattr(parts, f))
    assert whole.n[whole.owner == 0].sum() == sum(brute_counts(text).values())


def test_language_counts_are_handed_on(spark, spoken, monkeypatch):
    want = sorted(map(tuple, language.profiles(spoken).collect()))
    monkeypatch.setattr(language, "HELD", 3)  # the function's globals travel with it
    assert sorted(map(tuple, language.profiles(spoken).collect())) == want


def test_language_learns_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs.where(language.learned("doc_id")))
    got = language.identify(docs, model).where(~language.learned("doc_id")).select("lang", "lang_pred").collect()
    assert len(got) > 20 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


# ranked search

def brute_terms(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_search(docs, items, k):
    counts = [(i, Counter(w), len(w)) for i, t in docs if (w := brute_terms(t))]
    total, words = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        rows = []
        for i, c, n in counts:
            m = 100 - 75 + 75 * n * total // words
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in brute_terms(text) if t in c)
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


def corpus(n, seed=0):
    r = np.random.default_rng(seed)
    vocab = [f"w{j}" for j in range(150)] + ["été", "Straße", "x_y"]
    p = 1 / np.arange(1, len(vocab) + 1)
    texts = [" ".join(r.choice(vocab, int(r.integers(1, 60)), p=p / p.sum())).replace(" w3 ", ", W3. ") for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block_words", [20, 1 << 14])
def test_search_against_brute_force(spark, block_words):
    docs = corpus(300) + [(400 + i, "w140 w141 w1") for i in range(40)] + [(None, "w140 w1"), (None, None), (7, ""), (3, "w140 w140"), (3, "w140 w140")]
    items = [(i, t) for i, t in corpus(25, 5)] + [(77, "w140 w140 w2"), (77, "w1"), (77, "w1"), (78, None), (79, "..."), (80, "nowhere"), (None, "w5 w6")]
    d = spark.createDataFrame([(i, t, *EXTRA) for i, t in docs], f"doc_id long, text string, {CLASH}").repartition(4)
    q = spark.createDataFrame([(i, t, *EXTRA) for i, t in items], f"item_id long, text string, {CLASH}")
    got = dual_tree.search(d, q, k=6, block_words=block_words)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(docs, items, 6)


def test_search_of_nothing(spark):
    d = spark.createDataFrame(corpus(5), "doc_id long, text string")
    q = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert dual_tree.search(d.limit(0), q).count() == 0
    assert dual_tree.search(d, q.limit(0)).count() == 0
    assert dual_tree.search(spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string"), q).count() == 0


def test_dual_tree_prunes_and_keeps_every_result():
    """Clusters of documents and items: whole clusters are pruned, all k best are found."""
    r = np.random.default_rng(3)
    n_terms, docs, items = 400, 2000, 40
    rows = [np.unique(r.integers(0, 40, 12) + 40 * (i % 10)) for i in range(docs)]
    values = [r.integers(1, 900_000, len(x)) for x in rows]
    nos = [np.unique(r.integers(0, 40, 8) + 40 * (i // 4)) for i in range(items)]
    weights = [r.integers(1, 9000, len(x)) for x in nos]
    start = np.r_[0, np.cumsum([len(x) for x in rows])]
    tree = dual_tree.ItemTree(0, np.arange(items), np.r_[0, np.cumsum([len(x) for x in nos])], np.concatenate(nos), np.concatenate(weights), n_terms)
    best, walk = dual_tree.Best(items, 5), dual_tree.Walk()
    for lo in range(0, docs, 500):
        s = slice(start[lo], start[lo + 500])
        chunk = dual_tree.DocTree(np.arange(lo, lo + 500), np.zeros(500, np.int64), start[lo:lo + 501] - start[lo], np.concatenate(rows)[s],
                                  np.ones(s.stop - s.start, np.int64), np.concatenate(values)[s], n_terms)
        dual_tree.dual_search(tree, chunk, best, walk)
    assert walk.scored < docs * items / 10
    dense = np.zeros((docs, n_terms), np.int64)
    for i, (x, v) in enumerate(zip(rows, values, strict=True)):
        dense[i, x] = v
    for i in range(items):
        score = dense[:, nos[i]] @ weights[i]
        want = np.lexsort((np.arange(docs), -score))[:5]
        assert best.rows[i][:, 1].tolist() == want.tolist() and best.rows[i][:, 0].tolist() == score[want].tolist()


def test_chunks_keep_blocks_apart():
    import pyarrow as pa
    rows = [(b, i) for b in (0, 0, 0, 1, 1, 2) for i in range(3)]
    batch = pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array(range(len(rows)), pa.int64()), pa.array([[1, 2]] * len(rows), pa.list_(pa.int32()))],
                                       names=["block", "id", "no"])
    got = list(dual_tree.chunks(iter([batch.slice(0, 5), batch.slice(5)])))
    assert [c.num_rows for c in got] == [9, 6, 3] and [c.column("block").unique().to_pylist() for c in got] == [[0], [1], [2]]


# vector codes

def brute_codes(rows, parts, entries, rounds):
    """rows: (vec_id, integers, label) in order of id."""
    x = np.array([v for _, v, _ in rows]).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def nearest():
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        return far.argmin(-1), far.min(-1)

    for _ in range(rounds):
        code, _ = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = x[code[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(0) // len(mine)
    code, far = nearest()
    return books, code, far.sum(1)


@pytest.mark.parametrize(("entries", "scale"), [(64, 256), (5, 256), (100, 8)])
def test_codes_against_brute_force(spark, entries, scale):
    r = np.random.default_rng(entries)
    vecs = [(i, [float(x) for x in np.round(r.normal(0, 0.3, 16), 2)], None if i % 7 == 0 else i % 3) for i in range(300)]
    vecs += [(300 + i, vecs[i][1], 1) for i in range(20)]
    bad = [(-1, None, 1), (-2, [1.0] * 15 + [float("nan")], 1), (-3, [1.0] * 15 + [None], 2), (-4, [float("-inf")] * 16, 2)]
    df = spark.createDataFrame([(*v, *EXTRA) for v in vecs + bad], f"vec_id long, embedding array<float>, label int, {CLASH}").repartition(4)
    got = {r["vec_id"]: r for r in codes.compress(df, parts=8, entries=entries, scale=scale).collect()}
    rows = [(i, np.floor(np.array(v, np.float32).astype(float) * scale).astype(int), lab) for i, v, lab in vecs]
    books, code, error = brute_codes(rows, 8, entries, 2)
    assert set(got) == {i for i, _, _ in vecs}
    sums = Counter()
    for (_, _, lab), e in zip(rows, error, strict=True):
        sums[lab] += int(e)
    for (i, _, lab), c, e in zip(rows, code, error, strict=True):
        assert got[i]["code"] == "".join(f"{x:02x}" for x in c)
        assert (got[i]["error"], got[i]["label_error"], got[i]["codebooks_sha256"]) == (e, sums[lab], codes.digest(books))


def test_slices_find_the_nearest_entry():
    r = np.random.default_rng(1)
    for width, entries, span in ((1, 3, 4), (4, 64, 20), (4, 64, 2), (3, 200, 500), (2, 1, 1 << 26)):
        book = r.integers(-span, span, (entries, width))
        points = r.integers(-2 * span, 2 * span, (500, width))
        far = ((points[:, None] - book[None]) ** 2).sum(-1)
        code, dist = codes.Slices(book).nearest(points)
        assert np.array_equal(code, far.argmin(1)) and np.array_equal(dist, far.min(1))


def test_box_is_exactly_the_entries_inside():
    r = np.random.default_rng(2)
    book, points = r.integers(-9, 9, (130, 3)), r.integers(-9, 9, (40, 3))
    mask = codes.Slices(book).box(points, np.full(40, 4))
    inside = (np.abs(points[:, None] - book[None]) <= 4).all(-1)
    for e in range(130):
        assert np.array_equal((mask[e // 64] >> np.uint64(e % 64)) & np.uint64(1), inside[:, e].astype(np.uint64))


def test_codes_edge_cases(spark):
    kind = "vec_id long, embedding array<double>, label string"
    assert codes.compress(spark.createDataFrame([], kind)).count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, "a"), (2, [float("inf")], "a")], kind)).count() == 0
    df = spark.createDataFrame([(1, [0.5, 1e300], "a"), (1, [0.5, 1e300], "a"), (None, [0.25], None), (4, [], "b"), (5, [-1e300, 0.0], "b")], kind)
    rows = codes.compress(df, parts=2).collect()
    assert len(rows) == 5 and {r["error"] for r in rows} == {0} and len({r["codebooks_sha256"] for r in rows}) == 1
    assert sorted(r["code"] for r in rows)[:2] == ["0000", "0000"]  # equal entries: the lower index


def test_codes_round_trip(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    books = codes.codebooks(df)
    out = codes.decode(codes.encode(df, books, columns=["vec_id", "embedding"]), books).collect()
    assert len(out) == 500
    for r in out:
        whole = np.floor(np.array(r["embedding"], float) * 256)
        assert ((whole - np.array(r["decoded"]) * 256) ** 2).sum() == pytest.approx(r["error"])
