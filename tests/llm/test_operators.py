"""The corpus operators on small tables: brute force, round trips, edge cases."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import (decontaminate, line_templates, mixing, paragraphs, quality, sharding, simhash, token_files,
                        topk, warc)
from quarry.llm.common import batches_of_bytes, components

DOCS = "doc_id long, text string, lang string, source string, size long, shard int, h string, rank int, score double"
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "river", "stone", "cloud", "green", "seven", "light", "paper"]


def prose(seed, n):
    r = np.random.default_rng(seed)
    out = []
    for k in range(n):
        out.append(WORDS[r.integers(len(WORDS))] + str(WORDS[r.integers(len(WORDS))]) + ("." if k % 9 == 8 else ""))
    return " ".join(out)


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, 7, 8, "x", 9, 0.5) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, ties, a repeated row, a long text."""
    rows = [(1, prose(1, 40), "a"), (2, None, "a"), (3, "", None), (None, "one two", "b"), (4, " \t\n", "b"),
            (5, prose(1, 40), None), (5, prose(1, 40), None), (6, prose(2, 4000), "c"), (7, "one two", "c")]
    return frame(spark, rows).repartition(3).cache()


def count_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


# mixing

def test_mix_targets_and_bounds(spark, odd):
    got = mixing.taken(odd).collect()
    assert len(got) == 9
    assert sorted(r["size"] for r in got) == sorted(count_words(r["text"]) for r in odd.collect())
    assert all(0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in got)
    total = sum(r["size"] for r in got)
    per = {r["source_size"]: r["target"] for r in got}
    assert sum(per.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s + 1e-6 for s, t in per.items())
    assert sum(r["taken"] for r in got) <= 1.5 * total
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(odd.repartition(5)).collect()))


def test_mix_near_target_and_documents(spark):
    docs = frame(spark, [(i, prose(i, 20 + i % 7), f"s{i % 3}") for i in range(300)])
    got = mixing.taken(docs).toPandas()
    by = got.groupby("target").agg(taken=("taken", "sum"))
    assert (abs(by.index.to_numpy() - by["taken"].to_numpy()) <= 60).all()
    mixed = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    assert sum(mixed[r.doc_id] * r.size for r in got.itertuples()) == got["taken"].sum()


def test_mixed_documents_edge_cases(spark, odd):
    rows = Counter((r["doc_id"], r["text"], r["source"]) for r in odd.collect())
    got = mixing.mixed_documents(odd)
    assert got.columns == odd.columns
    mixed = Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect())
    assert set(mixed) <= set(rows)
    assert all(n % rows[k] == 0 and n // rows[k] <= (2 if count_words(k[1]) else 1) for k, n in mixed.items())
    words = sum(n * count_words(k[1]) for k, n in mixed.items())
    assert 0 < words <= 1.5 * sum(n * count_words(k[1]) for k, n in rows.items())
    again = mixing.mixed_documents(odd.repartition(5)).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in again) == mixed


def test_mixed_documents_null_ids_of_one_source(spark):
    """A third of all rows without an id: each text is a document of its own."""
    docs = frame(spark, [(None if i % 3 == 0 else i, prose(i, 5 + i), f"s{i % 2}") for i in range(120)])
    want = {r["size"]: r["taken"] for r in mixing.taken(docs).collect()}
    mixed = Counter(count_words(r["text"]) for r in mixing.mixed_documents(docs).collect())
    total = sum(want)
    assert abs(sum(k * n for k, n in mixed.items()) - sum(want.values())) <= 125
    assert 1.5 * total - 125 <= sum(k * n for k, n in mixed.items()) <= 1.5 * total


def test_mix_empty(spark):
    none = frame(spark, [])
    assert mixing.taken(none).count() == 0
    assert mixing.mixed_documents(none).columns == none.columns


# simhash

def slow_fingerprint(t, k):
    w = [x for x in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
    if not w:
        return 0
    s = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_fingerprint_matches_definition():
    for t in ["", " ", "One", "ÉA b", "a b c d e a b c", "x\x1cy z\x0bw q", prose(3, 300)]:
        assert simhash.fingerprint(t.encode(), 3) == slow_fingerprint(t, 3)


def test_trie_links_are_all_near_pairs():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.bitwise_or.reduce([np.uint64(1) << np.uint64(b) for b in r.choice(64, k, replace=False)])
                                    for k in (1, 2, 3, 4, 6) for _ in range(6)] + [base]))
    a, b = simhash.trie_links(np.zeros(len(fps), np.int64), fps, 3)
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for x in range(len(fps)):
        for y in np.flatnonzero(np.bitwise_count(fps ^ fps[x]) <= 3).tolist():
            root[max(top(x), top(y))] = min(top(x), top(y))
    want = [top(x) for x in range(len(fps))]
    mine = list(range(len(fps)))
    mine_root = dict(zip(a.tolist(), b.tolist()))
    got = [mine_root.get(x, x) for x in mine]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_near_duplicates_against_brute_force(spark):
    texts = [prose(i // 3, 120) + (" extra" if i % 3 == 1 else "") for i in range(60)] + [None, "", "a", "A"]
    docs = frame(spark, [(100 - i, t, "s") for i, t in enumerate(texts)])
    fps = {100 - i: slow_fingerprint(t, 3) for i, t in enumerate(texts)}
    comp = {i: i for i in fps}
    for _ in range(len(fps)):
        for i in fps:
            comp[i] = min(comp[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    want = {i: (f"{f:016x}", comp[i]) for i, f in fps.items()}
    assert got == want
    kept = {r["doc_id"] for r in simhash.keep_first(docs).collect()}
    assert kept == {c for c in comp.values()}


def test_near_duplicates_edge_cases(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 9
    zero = {r["doc_id"]: r["component_id"] for r in got if r["fingerprint"] == "0" * 16}
    assert zero == {2: 2, 3: 2, 4: 2}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [7]
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.keep_first(odd).columns == odd.columns


def test_components_long_path_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}


# decontamination

def test_best_run_is_the_edit_distance():
    r = np.random.default_rng(2)
    for _ in range(30):
        item, window = r.integers(0, 5, 8), r.integers(0, 5, 20)
        best = 99
        for lo in range(21):
            for hi in range(lo, 21):
                row = list(range(hi - lo + 1))
                for i, s in enumerate(item):
                    new = [i + 1]
                    for j, w in enumerate(window[lo:hi]):
                        new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (s != w)))
                    row = new
                best = min(best, row[-1])
        assert decontaminate.best_run(item, window)[0] == best


def test_decontamination_finds_exact_and_edited(spark):
    items = [(i, prose(1000 + i, 14 + i)) for i in range(30)]
    rows, want = [], set()
    r = np.random.default_rng(3)
    for i, t in items:
        ws = t.split()
        for _ in range(int(0.2 * len(ws)) if i % 2 else 0):
            ws[r.integers(len(ws))] = "changed"
        rows.append((i, prose(2000 + i, 60) + " " + " ".join(ws).upper() + ", " + prose(3000 + i, 60), "s"))
        want.add((i, i))
        rows.append((500 + i, prose(4000 + i, 150), "s"))
    rows += [(None, None, None), (900, "", "s"), (901, prose(9, 30000) + " " + items[3][1], "s")]
    want.add((901, 3))
    docs = frame(spark, rows)
    bench = spark.createDataFrame([*items, (None, "x"), (77, None), (78, " ")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs, bench).collect()}
    assert got == want
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == len(rows) - len({d for d, _ in want})
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_decontamination_keeps_its_recall_at_every_length():
    r = np.random.default_rng(12)
    word = [b"w%d" % k for k in range(5000)]
    items, docs, want, lengths = [], [], [], [1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 16, 20, 31, 40, 90]
    for n in [*lengths, *[120] * 60]:
        for kind in ("exact", "random", "even"):
            ws = [word[k] for k in r.integers(0, 5000, n)]
            items.append((len(items), ws))
            most, y = int(0.2 * n + 1e-9), list(ws)
            for p in r.integers(0, n, most) if kind == "random" else (np.arange(most) + 1) * n // (most + 1) if kind == "even" else ():
                y[p] = b"changed"
            docs.append([b"before"] * 30 + y + [b"behind"] * 30)
    index = decontaminate.Index(items, 0.8, 0.99)
    ids = decontaminate._Ids(index.vocabulary)
    found = index.scan([np.array([ids[w] for w in d], np.int64) for d in docs])
    assert [d for d, f in enumerate(found[:3 * len(lengths)]) if d not in f] == []
    assert sum(d in f for d, f in enumerate(found)) >= 0.99 * len(found)
    # a common piece meets all its items, in any number of portions
    got = [list(map(np.ndarray.tolist, h)) for h in decontaminate.hits(np.arange(3), np.array([5, 6, 5], np.uint64), np.array([4, 5, 5], np.uint64), np.arange(3), np.arange(3))]
    assert got == [[[0, 0, 2, 2], [1, 2, 1, 2], [1, 2, 1, 2]]]


# token files

def test_tokens_round_trip(spark, odd):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(token_files.default_tokenizer())
    texts = ["It's Fine, a.b, x., é, É. é, don't!", "<|endoftext|> a<|startoftext|>B", "a b\x1cc 12,3."]
    docs = odd.union(frame(spark, [(10 + i, x, "s") for i, x in enumerate(texts)]))
    want = Counter()
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want[r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    index, manifest = token_files.write_tokens(docs)
    got = token_files.scan_tokens(spark, manifest).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    some = token_files.read_records(index.where("doc_id % 2 = 0"), False).collect()
    by = Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in got if r["doc_id"] is not None and r["doc_id"] % 2 == 0 or r["doc_id"] is None and token_files.NULL_ID % 2 == 0)
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in some) == by
    assert token_files.round_trip(frame(spark, [])).count() == 0


def test_damaged_record_is_found():
    import io
    f = bytearray(token_files.frame(b"payload!"))
    assert token_files.read_frame(io.BytesIO(bytes(f))) == b"payload!"
    f[14] ^= 1
    with pytest.raises(ValueError):
        token_files.read_frame(io.BytesIO(bytes(f)))
    with pytest.raises(ValueError):
        token_files.read_frame(io.BytesIO(token_files.frame(b"abc")[:-2]))


# quality

def test_quality_learns_and_scores_everything(spark):
    def junk(i):
        return " ".join(w.upper() + "!!" for w in prose(i, 60).split())
    rows = [(i, junk(i) if i % 4 == 0 else prose(i, 60), "s") for i in range(240)] + [(900, None, None), (901, "", "s"), (None, prose(4, 9), "s")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(240)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels.where(quality.fold("doc_id") != 1))
    got = quality.score(docs, model)
    assert got.columns == docs.columns  # a column of that name gives way to the score
    by = {r["doc_id"]: r["score"] for r in got.collect()}
    assert len(by) == 243 and all(0 <= s <= 1 for s in by.values())
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(by[i] >= 0.5) == (i % 4 != 0) for i in held]) > 0.95
    assert by[900] == by[901]
    kept = quality.score(docs, model, score_col="_s", at_least=0.5)
    assert kept.count() == sum(s >= 0.5 for s in by.values())
    none = quality.train(docs.limit(0), labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}


def test_context_vectors_cover_every_pair(spark):
    docs = frame(spark, [(1, "red blue red", "s"), (2, None, "s")])
    got = quality.unit_rows(quality.context_vectors(docs))
    pos, sign = quality.index_vectors()
    red, blue = (quality._TOKENS[w] // quality.SHAPES for w in ("red", "blue"))
    acc = np.zeros(quality.DIM)
    for other in (blue, blue, red, red):  # red's neighbours within two words
        np.add.at(acc, pos[other], sign[other])
    assert np.allclose(got[red], acc / max(1, np.sqrt((acc * acc).sum())), atol=1e-6)


# sharding

def test_differencing_is_exact_on_small_cases():
    piles = np.zeros((5, 2), np.int64)
    piles[:, -1] = [8, 7, 6, 5, 4]
    to, total = sharding.difference(piles)
    assert sorted(total) == [14, 16]
    assert [sum(v for v, t in zip([8, 7, 6, 5, 4], to[:, -1]) if t == k) for k in (0, 1)] == total.tolist()


@pytest.mark.parametrize("cell", [20_000, 7])
def test_shards_keep_groups_and_balance(spark, cell):
    rows = [(i, prose(i // 2, 30 + i % 50), "s") for i in range(400)] + [(None, None, "s"), (1000, "", "s"), (3, prose(1, 33), "s")]
    got = sharding.shard_documents(frame(spark, rows), 8, cell=cell).toPandas()
    assert len(got) == len(rows)
    assert sorted(got["size"]) == sorted(len((t or "").encode()) + 16 for _, t, _ in rows)
    assert sorted(got["text_crc32"]) == sorted(zlib.crc32((t or "").encode()) for _, t, _ in rows)
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() - sums.min() < 400
    text = {i: t for i, t, _ in rows if i is not None and i < 400}
    by = got[got["doc_id"].notna() & (got["doc_id"] < 400)].copy()
    by["t"] = by["doc_id"].map(text)
    by = by[by["doc_id"] != 3]
    assert (by.groupby("t")["shard"].nunique() == 1).all()


def test_shards_of_nothing_and_of_one_group(spark):
    assert sharding.shard_documents(frame(spark, [])).count() == 0
    got = sharding.shard_documents(frame(spark, [(i, "same", "s") for i in range(5)])).collect()
    assert len({r["shard"] for r in got}) == 1 and sorted(r["slot"] for r in got) == list(range(5))


# warc

def test_warc_round_trip(spark):
    rows = [(1, "http://a/x", "<p>é</p>"), (2, "http://a/y", "<p>é</p>"), (3, None, None), (4, "http://b/", ""), (5, "http://c/\r\nWARC-Type: fake", "a\r\n\r\nWARC/1.1\r\n"),
            (None, "http://d", "z"), (6, "u", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(got) == 7
    for i, _, h in rows:
        body = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(body), warc.digest_of(body))
    assert (got[1]["record_type"], got[1]["refers_to"]) == ("revisit", 2)
    assert (got[3]["record_type"], got[3]["refers_to"]) == ("revisit", 4)
    assert all(got[i]["record_type"] == "response" and got[i]["refers_to"] is None for i in (2, 4, 5, 6, None))
    alone = {r["page_id"]: r["record_type"] for r in warc.round_trip(pages, min_bytes=1).collect()}
    assert alone[3] == alone[4] == "response" and alone[1] == "revisit"
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_captures_are_nested_and_repeated_rows_stay(spark):
    pages = spark.createDataFrame([(1, "http://a", "x"), (1, "http://a", "x"), (2, "http://b", "y")], "page_id long, url string, html string")
    files = warc.write_archives(pages)
    caps = warc.assemble(warc.read_records(spark, files)).collect()
    assert len(caps) == 3
    assert all(c["request"]["type"] == "request" and c["metadata"]["page_id"] in (1, 2) for c in caps)
    assert sorted(c["response"]["type"] for c in caps) == ["response", "response", "revisit"]
    assert {bytes(c["response"]["payload"]) for c in caps if c["response"]["type"] == "response"} == {b"x", b"y"}


def test_metadata_that_points_at_the_request(spark):
    def rec(i, kind, to):
        return ("f", i, kind, to, None, None, None, None, 9 if kind == "metadata" else None, 0, None, None)
    rows = [rec("r", "response", None), rec("q", "request", "r"), rec("m", "metadata", "q"), rec("lost", "metadata", "nowhere"), rec("r", "response", None)]
    got = warc.assemble(spark.createDataFrame(rows, warc._RECORD)).collect()
    assert len(got) == 1 and got[0]["request"]["record_id"] == "q" and got[0]["metadata"]["record_id"] == "m"


# top-k

def test_topk_against_brute_force(spark):
    r = np.random.default_rng(4)
    vecs = r.normal(size=(300, 16)).astype(np.float32) / 4
    vecs[100:180] = vecs[0]  # a large class of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    rows += [(300, None), (350, [None] * 16), (400, [float("nan")] * 16), (450, [float("inf")] * 16), (None, vecs[1].tolist())]
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    q = np.floor(vecs.astype(np.float64) * 256).astype(np.int64)
    want = {}
    for i in range(0, 300, 50):
        s = sorted(((-int(q[i] @ q[j]), j) for j in range(300) if j != i))[:5]
        want |= {(i, k + 1): (j, -v) for k, (v, j) in enumerate(s)}
    assert got == want


def test_topk_few_rows(spark):
    kind = "vec_id long, embedding array<float>, rank int"
    two = spark.createDataFrame([(0, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (7, [0.5, 0.5], 1)], kind)
    got = sorted(map(tuple, topk.top_k(two).collect()))
    assert got == [(0, 1, 50, 65536), (0, 2, 7, 32768), (50, 1, 0, 65536), (50, 2, 7, 32768)]
    assert topk.top_k(two.limit(0)).count() == 0


def test_topk_repeated_ids(spark):
    r = np.random.default_rng(6)
    v = r.normal(size=(40, 8)).astype(np.float32)
    # id 50 six times on a vector that 51 and 52 have too, id 100 twice on a vector of its own, near copies of it
    rows = [(50, v[0])] * 6 + [(51, v[0]), (52, v[0])] + [(100, v[1])] * 2 + [(101 + i, v[1] * (0.9 - i / 100)) for i in range(4)]
    rows += [(60, v[2] + v[0])] * 2 + [(200 + i, x) for i, x in enumerate(v[3:]) if (200 + i) % 50]
    rows = [(i, x.tolist()) for i, x in rows]
    got = {}
    for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    q = [(i, np.floor(np.array(x, np.float64) * 256).astype(np.int64)) for i, x in rows]
    assert set(got) == {50, 100}
    for i, own in ((50, q[0][1]), (100, q[8][1])):
        want = sorted((-int(own @ x), j) for j, x in q if j != i)[:5]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(want)]


# lines

def test_line_templates(spark):
    shared = [f"Copyright 20{i:02d} by the {n} team of Foo" for i, n in enumerate(["red", "blue", "green", "red"])]
    rows = [(i, f"{prose(i, 12)}\nReleased 200{i} under the license v{i}.\n{shared[i]}\n\n{prose(50 + i, 11)}", "s") for i in range(4)]
    rows += [(10, None, "s"), (11, "", None), (None, "Released 2020 under the license v9.", "s"), (12, prose(1, 5000), "s")]
    docs = frame(spark, rows)
    got = line_templates.dropped_lines(docs).collect()
    assert {(r["doc_id"], r["line_no"]) for r in got} == {(i, n) for i in range(4) for n in (1, 2)} | {(None, 0)}
    assert {r["template"] for r in got} == {"Released <*> under the license <*>", "Copyright <*> by the red team of Foo"}
    clean = {r["doc_id"]: r["text"] for r in line_templates.drop_lines(docs).collect()}
    assert clean[0] == f"{prose(0, 12)}\n\n{prose(50, 11)}"
    assert clean[10] is None and clean[11] == "" and clean[None] == "" and clean[12] == prose(1, 5000)
    assert line_templates.dropped_lines(frame(spark, [])).count() == 0


def letters(k):
    return "".join(chr(97 + int(d)) for d in f"{k:04d}")


FAMILIES = ["this page was written by {} for the monthly local news", "this page was printed at {} in the quiet old town",
            "this page was written on {} with a small blue pen", "posted by user {} in {} today"]


@pytest.mark.parametrize("n_families", [1, 2, 3, 4])
def test_line_template_families(spark, n_families):
    """Families that share a leaf are found whole, however many; a common value of a field loses no line."""
    rows = [(100 * f + i, FAMILIES[f].format("zed" if i % 3 == 0 and f == 1 else letters(i), letters(500 + i)), "s") for f in range(n_families) for i in range(100)]
    rows += [(9000 + i, f"this page was {letters(900 + 7 * i)} {prose(i, 6).rstrip('.')}", "s") for i in range(40)]
    got = line_templates.dropped_lines(frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(100 * n_families))
    assert {r["template"] for r in got} >= {FAMILIES[f].format("<*>", "<*>") for f in range(n_families) if f != 1}


def test_line_templates_equal_sql_and_names(spark):
    import random
    rnd = random.Random(2)
    words = ["a", "b", "c", "d", "e1", "f"]
    rows = [(i, "\n".join(" ".join(["x", "y", rnd.choice("zw"), *rnd.choices(words, k=rnd.randint(0, 5))]) for _ in range(rnd.randint(0, 6))), "s")
            for i in range(150)] + [(200, None, "s"), (201, "", None)]
    docs = frame(spark, rows)
    got = sorted(tuple(r) for r in line_templates.dropped_lines(docs).collect())
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    assert got == sorted(con.execute(line_templates.DROPPED_SQL).fetchall())
    odd = docs.withColumn("_id", F.lit(1)).withColumn("_gone", F.lit(2)).withColumn("a.b", F.lit(3))
    out = line_templates.drop_lines(odd)
    assert out.columns == odd.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {r["doc_id"]: r["text"] for r in line_templates.drop_lines(docs).collect()}


# paragraphs

def sentence(seed, n):
    return " ".join(prose(seed, n).replace(".", "").split())


def test_repeated_passages(spark):
    passage = ". ".join(sentence(700 + k, 10) for k in range(6)) + "."
    near = passage.replace(sentence(702, 10), sentence(702, 10) + " more")
    rows = [(i, f"{sentence(i, 13)} {passage if i % 2 else near} {sentence(100 + i, 12)}.", "s") for i in range(6)]
    rows += [(20 + i, ". ".join(sentence(300 + 20 * i + k, 12) for k in range(5)), "s") for i in range(5)]
    rows += [(40, None, None), (41, "", "s"), (None, passage, "s"), (42, sentence(5, 3000), "s")]
    docs = frame(spark, rows)
    got = paragraphs.repeated(docs).collect()
    assert {r["doc_id"] for r in got} == set(range(6))
    assert {r["cluster_doc"] for r in got} == {0}
    assert {r["doc_id"] for r in got if not r["removed"]} == {0}
    text = {i: t for i, t, _ in rows}
    assert all(len(text[r["doc_id"]][r["at"]:r["upto"]].split()) == r["n_words"] for r in got)
    # a paragraph with one more word at its end is in the cluster of the others
    third = [r for r in got if sentence(702, 10) in text[r["doc_id"]][r["at"]:r["upto"]]]
    assert len(third) == 6 and len({r["cluster_paragraph"] for r in third}) == 1
    left = {r["doc_id"]: r["text"] for r in paragraphs.remove(docs).collect()}
    assert left[0] == text[0] and sentence(705, 10) not in left[1] and sentence(101, 12) in left[1]
    assert left[20] == text[20] and left[40] is None
    assert paragraphs.repeated(frame(spark, [])).count() == 0


def varied(seed, n):
    return [f"w{k}" for k in np.random.default_rng(seed).integers(0, 3000, n)]


def test_paragraphs_leave_no_word_out():
    text = "Éa\u0130 b-c, d! " + "e. " * 9 + "\n\n(f g) " + " ".join(varied(1, 400)) + " no" * 300 + " end?\n"
    for min_words in (2, 6, 9):
        words, first, offsets = paragraphs.paragraphs_of(text, min_words)
        assert b" ".join(words).decode() == " ".join(re.findall("[0-9a-z\u0080-\U0010ffff]+", text.lower()))
        sizes = np.diff(np.r_[first, len(words)])
        assert first[0] == 0 and offsets[0] == 0 and min_words <= sizes.min() and sizes.max() < 60
        pieces = [text[x:y] for x, y in zip(offsets, offsets[1:])]
        assert "".join(pieces) == text.rstrip("\n")
        assert [len(re.findall("[0-9a-z\u0080-\U0010ffff]+", p.lower())) for p in pieces] == sizes.tolist()
    assert [x.tolist() if hasattr(x, "tolist") else x for x in paragraphs.paragraphs_of(" .\n")] == [[], [], []]


def test_passages_of_any_punctuation_are_found(spark):
    w = varied(2, 80)
    by_five = " ".join(x + "." * (k % 5 == 4) for k, x in enumerate(w))
    lines = "\n".join(" ".join(w[k:k + 4]) for k in range(0, 80, 4))
    for one, two in ((by_five, by_five), (" ".join(w), lines), (" ".join(w), " ".join(w))):
        # once between sentences, once in a text without any sentence end
        rows = [(1, f"{' '.join(varied(3, 9))}. {one}. {' '.join(varied(4, 9))}.", "s"),
                (2, f"{' '.join(varied(5, 400))} {two} {' '.join(varied(6, 400))}", "s"), (3, " ".join(varied(7, 300)), "s")]
        docs = frame(spark, rows)
        got = paragraphs.repeated(docs).collect()
        assert {r["doc_id"] for r in got} == {1, 2} and {r["cluster_doc"] for r in got} == {1}
        assert all(r["passage_words"] >= 50 for r in got)
        left = {r["doc_id"]: r["text"] for r in paragraphs.remove(docs).collect()}
        assert left[1] == rows[0][1] and left[3] == rows[2][1]
        kept = left[2].split()
        # a paragraph across the passage's end goes if four fifths of its shingles are the other's
        assert kept[:396] == varied(5, 400)[:396] and kept[-396:] == varied(6, 400)[4:] and len(kept) <= 830


def test_bucket_links_blocks_compare_every_pair(spark):
    r = np.random.default_rng(8)
    sets = [sorted(set(r.integers(0, 14, 9).tolist())) for _ in range(60)]
    rows = [(1, 60, h, h, s) for h, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "key long, n long, h long, root long, s array<int>")

    def comps(edges):
        root = list(range(60))
        for _ in range(60):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root
    want = [(a, b) for a in range(60) for b in range(a) if len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]}) - 1e-9]
    for block in (1024, 7):
        got = [(x["a"], x["b"]) for x in paragraphs.bucket_links(members, 0.8, block).collect()]
        assert comps(got) == comps(want) and set(map(frozenset, got)) <= set(map(frozenset, want))


def test_batches_are_cut_by_bytes():
    b = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c"])], names=["t"])
    parts = list(batches_of_bytes(b, "t", 12))
    assert pa.Table.from_batches(parts).to_pylist() == b.to_pylist() and len(parts) > 1


def test_tokens_every_letter_before_a_stop():
    """Whole texts by the tokenizer itself, for every Unicode letter before a comma or stop."""
    import sys
    path = token_files.default_tokenizer()
    enc = token_files.Encoder(path, True, 2)
    letters = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isalpha()]
    texts = [f"ab{c}{s} {c}{s}" for c in letters for s in ",."]
    got = []
    for at in range(0, len(texts), 1000):
        got += enc.encode([t.encode() for t in texts[at:at + 1000]])
    whole = enc.tokenizer.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, g, w in zip(texts, got, whole, strict=True) if np.frombuffer(g, enc.kind).tolist() != [*w.ids, 2]]
    assert wrong == []


def test_tokens_words_in_use_survive_a_full_memory(monkeypatch):
    enc = token_files.Encoder(token_files.default_tokenizer(), True, 2)
    monkeypatch.setattr(token_files, "REMEMBERED", 4000)
    texts = [f"often word{i}, other{i}. 3{i}x é{i} often" for i in range(300)]
    want = [np.frombuffer(enc._whole([t])[0], enc.kind).tolist() + [2] for t in texts]
    asked = []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda words: asked.extend(words) or learn(words))
    got = [np.frombuffer(enc.encode([t.encode()])[0], enc.kind).tolist() for t in texts]
    assert got == want
    assert asked.count(b"often") == 1 and len(enc.young) + len(enc.old) < 100


def test_file_system_of_spark_paths(monkeypatch):
    from types import SimpleNamespace

    from quarry.llm import common
    assert common.file_system("/tmp/x")[1] == "/tmp/x" and common.file_system("file:/tmp/x")[1] == "/tmp/x"
    asked = []  # opening a bucket asks the network for its region
    monkeypatch.setattr(common, "pafs", SimpleNamespace(FileSystem=SimpleNamespace(from_uri=asked.append)))
    for uri in ("s3a://bucket/some/key", "s3n://bucket/k", "s3://bucket/k", "hdfs://host/k"):
        common.file_system(uri)
    assert asked == ["s3://bucket/some/key", "s3://bucket/k", "s3://bucket/k", "hdfs://host/k"]


def test_paragraphs_two_texts_of_one_id(spark):
    """A span found in one text is never cut from another text of the same id; odd column names stay."""
    passage = ". ".join(sentence(800 + k, 11) for k in range(6)) + "."
    other = ". ".join(sentence(900 + k, 11) for k in range(9)) + "."
    rows = [(1, f"{sentence(1, 12)}. {passage}"), (2, f"{sentence(2, 14)}. {passage}"), (2, other), (2, other)]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, _id string, spans string, `a.b` string")
    left = paragraphs.remove(docs)
    assert left.columns == docs.columns
    texts = sorted((r["doc_id"], r["text"]) for r in left.collect())
    assert texts[0] == rows[0] and texts.count((2, other)) == 2
    assert sum(sentence(803, 11) in t for _, t in texts) == 1


def test_shared_keys_and_bits_lose_no_class(spark, monkeypatch):
    """Every pair of classes with a band key in common and every class of several
    documents is found, however often a task hands its keys on."""
    rows = [(i, f"{prose(i % 40, 60)} {prose(1000 + i, 30)}") for i in range(80)] + [(7, prose(7, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    by_key, by_class = {}, {}
    for i, t in rows:
        u = paragraphs.Units([t], paragraphs.MIN_WORDS)
        keys = paragraphs.band_keys(*u.shingles(np.arange(len(u))))
        for k in range(len(u)):
            by_class.setdefault(int(u.h.view(np.int64)[k]), set()).add((i, t))
            for key in keys:
                by_key.setdefault(int(key.view(np.int64)[k]), set()).add(int(u.h.view(np.int64)[k]))
    want = {(k, min(hs), h) for k, hs in by_key.items() if len(hs) > 1 for h in hs}
    many = {(None, None, h) for h, ds in by_class.items() if len(ds) > 1}
    assert want and many
    for held in (1 << 21, 50):
        monkeypatch.setattr(paragraphs, "KEYS_HELD", held)
        found = paragraphs.shared_keys(docs)
        assert set(map(tuple, found.collect())) == want | many
    bits = paragraphs.class_bits(found, 1 << 18)
    got = {r["h"] for r in paragraphs.units(docs, bits).collect()}
    assert {h for _, _, h in want | many} <= got and len(got) < len(by_class)


def test_keep_first_drops_texts_not_ids(spark):
    a, b = prose(11, 40), prose(12, 40)
    rows = [(2, b), (5, a), (5, b), (9, a), (9, a), (None, a), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, which int, drop string, `a.b` string")
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(2, b), (5, a), (None, a), (7, None)], key=repr)
    assert simhash.keep_first(docs.limit(0)).count() == 0
