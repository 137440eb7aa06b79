"""Staged METEOR: Porter goldens, stages, chunks, brute-force alignment."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import metric_tokens, ws_tokens
from quarry.operators import alignment, metrics

STEMS = {"caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed",
         "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
         "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
         "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi",
         "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc",
         "digitizer": "digit", "radicalli": "radic", "differentli": "differ", "vileli": "vile", "vietnamization": "vietnam",
         "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
         "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl",
         "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr",
         "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer",
         "airliner": "airlin", "adjustable": "adjust", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust",
         "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ", "homologous": "homolog",
         "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
         "controll": "control", "roll": "roll", "is": "is", "écoles": "écoles", "x2s": "x2s", "generalizations": "gener",
         "oscillators": "oscil", "yes": "ye", "say": "sai", "syzygy": "syzygi"}


def test_porter_goldens():
    assert {w: alignment.porter_stem(w) for w in STEMS} == STEMS


def test_tokens(spark):
    df = spark.createDataFrame([("Hello, World! \u00e7a\u00a0va 3.5",)], "t string")
    assert df.select(alignment.word_punct_tokens("t").alias("t")).first().t == [
        "hello", ",", "world", "!", "\u00e7a", "\u00a0", "va", "3", ".", "5"]


def test_stages(spark):
    df = spark.createDataFrame([
        (1, "The cats sat quickly.", "the cat sat fast ."), (2, "a b", "c d"), (3, None, "x"), (4, "", None),
        (5, "runs running run", "run runs running")], "id long, p string, r string")
    syn = spark.createDataFrame([("quickly", "b"), ("quickly", "a"), ("fast", "a"), ("fast", None)], "word string, group string")
    out = {r.id: r for r in alignment.meteor(df, "id", "p", "r", stages=(
        alignment.exact(), alignment.stems(), alignment.synonyms(syn))).collect()}
    assert (out[1].matches, out[1].stage_matches, out[1].chunks) == (5, [3, 1, 1], 1)
    assert out[1].meteor == pytest.approx(1 - 0.5 * (1 / 5) ** 3)
    for i in (2, 3, 4):
        assert (out[i].matches, out[i].chunks, out[i].meteor) == (0, 0, 0.0)
    assert (out[5].stage_matches[:2], out[5].chunks) == ([3, 0], 2)
    stem_only = alignment.meteor(df, "id", "p", "r", stages=(alignment.stems(),)).where("id = 5").first()
    assert (stem_only.matches, stem_only.chunks) == (3, 1)


def greedy(p, r, keys):
    free_r, match = set(range(len(r))), {}
    for key in keys:
        for i in range(len(p) - 1, -1, -1):
            if i not in match:
                j = max((j for j in free_r if key(r[j]) == key(p[i])), default=None)
                if j is not None:
                    match[i] = j
                    free_r.remove(j)
    return len(match), sum(1 for i, j in match.items() if match.get(i - 1) != j - 1)


def test_alignment_equals_greedy(spark):
    rnd, words = random.Random(5), ["run", "runs", "running", "cat", "cats", "a", "b"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 14))), " ".join(rnd.choices(words, k=rnd.randint(0, 14))))
            for i in range(80)]
    df = spark.createDataFrame(rows, "id long, p string, r string").repartition(5)
    got = {r.id: (r.matches, r.chunks) for r in alignment.meteor(df, "id", "p", "r", tokenizer=ws_tokens).collect()}
    assert got == {i: greedy(p.split(), r.split(), (lambda w: w, alignment.porter_stem)) for i, p, r in rows}


def test_exact_stage_equals_meteor_exact(spark):
    df = spark.createDataFrame([(1, "a b c a b", "b a c b a"), (2, "x y z", "x y z"), (3, "q", "")], "id long, p string, r string")
    a = {r.id: (r.matches, r.chunks, round(r.meteor, 9)) for r in alignment.meteor(
        df, "id", "p", "r", tokenizer=metric_tokens, stages=(alignment.exact(),)).collect()}
    b = {r.id: (r.matches, r.chunks, round(r.meteor, 9)) for r in metrics.meteor_exact(df, "id", "p", "r").select(
        "id", "matches", "chunks", F.col("meteor")).collect()}
    assert a == b


def exchanges(df):
    """The keys of the plan's hash exchanges."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)


def test_texts_are_shuffled_not_their_tokens(spark):
    df = spark.createDataFrame([(1, "a b a", "b a")], "id long, p string, r string")
    syn = spark.createDataFrame([("a", "x")], "word string, group string")
    stages = (alignment.exact(), alignment.stems(), alignment.synonyms(syn))
    for out, most in ((metrics.meteor_exact(df, "id", "p", "r"), 2), (metrics.bleu_rouge(df, "id", "p", "r", style="library"), 4),
                      (alignment.meteor(df, "id", "p", "r", stages=stages), 3)):
        keys = [re.sub(r"#\d+L?", "", k) for k in exchanges(out)]
        # the word groups' join deals tokens out by word
        assert 0 < keys.count("id") <= most and set(keys) <= {"id", "w", "word"}, keys


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b", "a b"), (1, "a b", "a b"), (2, None, "a"), (2, "a", None), (None, "a", "a")]
    df = spark.createDataFrame(rows, "id long, p string, r string")
    got = sorted((r.id or 0, r.matches, r.chunks) for r in metrics.meteor_exact(df, "id", "p", "r").collect())
    assert got == [(0, 0, 0), (1, 4, 2), (1, 4, 2), (2, 1, 1), (2, 1, 1)]
    grams = sorted((r.id or 0, r.m1, r.m2) for r in metrics.ngram_overlap(df, "id", "p", "r").collect())
    assert grams == [(0, 0, 0), (1, 4, 2), (1, 4, 2), (2, 1, 0), (2, 1, 0)]
    split = sorted((r.id or 0, r.matches, r.chunks) for r in metrics.meteor_exact(df, "id", "p", "r", chunk=1).collect())
    assert split == got
