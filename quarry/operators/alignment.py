"""METEOR with a tokenizer and matching stages as arguments (M4).

Both texts of an id become one long table of tokens. A stage gives each token
that is still free a key; the k-th last token of a key in the prediction is
matched with the k-th last of that key in the reference, which crosses no two
matches of one key. A stage is two windows, keyed by ``(id, side, key)`` and by
``(id, key, k)``; no window is longer than one text, and windows spill. The texts
are shuffled once by id, so the windows find their tokens in place; a stage whose
keys come from a join or a Python call deals the tokens back by id, the first
column that it gets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .metrics import METEOR_ALPHA, METEOR_BETA, METEOR_GAMMA, by_id

Stage = Callable[[DataFrame], DataFrame]

# fixed values: suffix rules of Porter, "An algorithm for suffix stripping" (1980), steps 2 to 4
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able",
         "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
         "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive",
         "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
         "iti", "ous", "ive", "ize")


def word_punct_tokens(x: str | Column) -> Column:
    """Lower-cased letter/digit runs, and every other visible character as a token of its own."""
    c = F.col(x) if isinstance(x, str) else x
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+|[^ \t\n\r\f\x0B\p{L}\p{N}]"), F.lit(0))


def _shape(word: str) -> str:
    """Each letter as ``v`` (vowel, or y after a consonant) or ``c``."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=1 << 16)
def porter_stem(word: str) -> str:
    """Porter's stem of a lower-case word; words of one or two letters and
    words with other characters than a-z stay as they are."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word

    def measure(stem: str) -> int:
        return _shape(stem).count("vc")

    def short_end(stem: str) -> bool:
        return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"

    s = _longest(word, ("sses", "ies", "ss", "s"))
    if s in ("sses", "ies"):
        word = word[:-2]
    elif s == "s":
        word = word[:-1]

    s = _longest(word, ("eed", "ed", "ing"))
    if s == "eed":
        if measure(word[:-3]) > 0:
            word = word[:-1]
    elif s and "v" in _shape(word[:-len(s)]):
        word = word[:-len(s)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word[-1:] == word[-2:-1] and _shape(word).endswith("cc") and word[-1] not in "lsz":
            word = word[:-1]
        elif measure(word) == 1 and short_end(word):
            word += "e"

    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP2, STEP3):
        s = _longest(word, rules)
        if s and measure(word[:-len(s)]) > 0:
            word = word[:-len(s)] + rules[s]
    s = _longest(word, STEP4)
    if s and measure(word[:-len(s)]) > 1 and (s != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[:-len(s)]
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not short_end(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map({w: porter_stem(w) for w in words.dropna().unique()})


def _home(tokens: DataFrame, id_col: str) -> DataFrame:
    """Tokens back at their texts: after a join by word or a Python call Spark
    would deal them out anew for each window that follows, so it's done once."""
    return tokens.repartition(F.col(id_col))


def exact() -> Stage:
    """Equal tokens match."""
    return lambda free: free.withColumn("_key", F.col("w"))


def stems() -> Stage:
    """Tokens of equal Porter stems match (Arrow batches, a distinct word once a batch)."""
    return lambda free: _home(free.withColumn("_key", _stems("w")), free.columns[0])


def synonyms(table: DataFrame, word: str = "word", group: str = "group") -> Stage:
    """Words of one group of a caller's table match; a word in several groups is in the least one."""
    one = table.groupBy(F.col(word).alias("w")).agg(F.min(F.col(group).cast("string")).alias("_key"))
    return lambda free: _home(free.join(one, on="w", how="left"), free.columns[0])


def align(df: DataFrame, id_col: str, pred: str, ref: str, tokenizer: Callable[[str], Column] = word_punct_tokens,
          stages: Sequence[Stage] | None = None) -> DataFrame:
    """Every token of both texts: ``(id, side, pos, w, stage, other)``; ``side``
    is ``p`` or ``r``, ``stage`` the number of the stage (from 1) that matched
    it with position ``other`` of the other text, null if free. An id whose
    texts are both null or empty keeps one row of nulls. Ids must be unique."""
    def side(name: str, col: str) -> Column:
        return F.transform(F.coalesce(tokenizer(col), F.array().cast("array<string>")), lambda w, i: F.struct(
            F.lit(name).alias("side"), i.cast("long").alias("pos"), w.alias("w")))

    texts = by_id(df.select(F.col(id_col), F.col(pred).alias("_pred"), F.col(ref).alias("_ref")), id_col)
    out = texts.select(id_col, F.explode_outer(F.concat(side("p", "_pred"), side("r", "_ref"))).alias("_t")).select(
        id_col, "_t.side", "_t.pos", "_t.w", F.lit(None).cast("int").alias("stage"), F.lit(None).cast("long").alias("other"))
    for number, stage in enumerate(stages if stages is not None else (exact(), stems()), 1):
        out = stage(out)
        # a matched or keyless token gets a key of its own, so it meets nothing
        out = out.withColumn("_key", F.when(F.col("stage").isNull() & F.col("_key").isNotNull(), F.struct(
            F.col("_key").alias("key"), F.lit(None).cast("string").alias("side"), F.lit(None).cast("long").alias("pos"))).otherwise(
            F.struct(F.lit(None).cast("string").alias("key"), F.col("side").alias("side"), F.col("pos").alias("pos"))))
        out = out.withColumn("_k", F.row_number().over(Window.partitionBy(id_col, "_key", "side").orderBy(F.desc("pos"))))
        both = Window.partitionBy(id_col, "_key", "_k")
        p = F.max(F.when(F.col("side") == "p", F.col("pos"))).over(both)
        r = F.max(F.when(F.col("side") == "r", F.col("pos"))).over(both)
        out = out.withColumn("_p", p).withColumn("_r", r)
        met = F.col("stage").isNull() & F.col("_p").isNotNull() & F.col("_r").isNotNull()
        out = out.select(id_col, "side", "pos", "w", F.when(met, F.lit(number)).otherwise(F.col("stage")).alias("stage"),
                         F.when(met, F.when(F.col("side") == "p", F.col("_r")).otherwise(F.col("_p"))).otherwise(F.col("other")).alias("other"))
    return out


def meteor(df: DataFrame, id_col: str, pred: str, ref: str, tokenizer: Callable[[str], Column] = word_punct_tokens,
           stages: Sequence[Stage] | None = None, alpha: float = METEOR_ALPHA, beta: float = METEOR_BETA,
           gamma: float = METEOR_GAMMA) -> DataFrame:
    """``(id, matches, stage_matches, chunks, meteor)``: METEOR over the staged
    alignment, ``stage_matches`` the matches per stage in stage order. A chunk is
    a run of matches consecutive in both texts; 0 when nothing matches. The
    documents are read once; no job runs when the plan is built."""
    n_stages = len(stages) if stages is not None else 2
    a = align(df, id_col, pred, ref, tokenizer, stages)
    hit = (F.col("side") == "p") & F.col("other").isNotNull()
    # (p - 1, r - 1) lies on the same diagonal, so it is the match before on it
    a = a.withColumn("_diag", F.when(hit, F.col("pos") - F.col("other")))
    before = F.lag("pos").over(Window.partitionBy(id_col, "_diag", hit).orderBy("pos"))
    a = a.withColumn("_start", hit & (F.coalesce(before, F.lit(-2)) != F.col("pos") - 1))
    g = a.groupBy(id_col).agg(
        F.count_if(F.col("side") == "p").alias("c"), F.count_if(F.col("side") == "r").alias("r"),
        F.count_if(hit).alias("matches"), F.count_if(F.col("_start")).alias("chunks"),
        F.array(*[F.count_if(hit & (F.col("stage") == s)) for s in range(1, n_stages + 1)]).alias("stage_matches"))
    p, r = F.col("matches") / F.col("c"), F.col("matches") / F.col("r")
    score = p * r / (alpha * p + (1 - alpha) * r) * (1 - gamma * F.pow(F.col("chunks") / F.col("matches"), F.lit(beta)))
    return g.select(id_col, "matches", "stage_matches", "chunks",
                    F.when(F.col("matches") > 0, score).otherwise(F.lit(0.0)).alias("meteor"))
