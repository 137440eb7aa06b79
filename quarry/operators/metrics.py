"""Answer-quality metrics over a ``(id, prediction, reference)`` table.

Definitions follow the papers (BLEU: Papineni et al. 2002; ROUGE: Lin 2004;
METEOR: Banerjee & Lavie 2005, exact-match stage). Tokens are
``metric_tokens`` (lower-case letter/digit runs) [ours], so scores can differ
from library implementations that tokenise differently.

BLEU, ROUGE-1/2 and METEOR are plain Spark jobs: the texts are shuffled once by
id, their n-grams and token positions exploded there and matched by aggregations
keyed by ``(id, n, gram)`` / ``(id, word, k)``, which need no further shuffle. Only
ROUGE-L and ROUGE-Lsum need longest common subsequences and run in Arrow UDFs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bleu_13a_tokens, metric_tokens, rouge_ascii_tokens
from .lcs import rouge_l_score, rouge_lsum_score

# tokenisers per style: "unicode" (ours, default) or "library" (the rules of
# the public BLEU and ROUGE scorers)
_TOKENIZERS = {"unicode": (metric_tokens, metric_tokens), "library": (bleu_13a_tokens, rouge_ascii_tokens)}

MAX_N = 4
# fixed values: METEOR parameters (alpha, beta, gamma)
METEOR_ALPHA, METEOR_BETA, METEOR_GAMMA = 0.9, 3.0, 0.5


def _ngrams(toks: Column, n: int, predicted: int) -> Column:
    size = F.size(toks)
    seq = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(seq, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(toks, i, n), " ").alias("gram"),
                                               F.lit(predicted).alias("p")))


def by_id(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` dealt out by id, into as many partitions as the session's shuffles
    have: adaptive execution would merge them by the size of the texts, a
    fraction of what is exploded from them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(id_col))


def tokenized(df: DataFrame, id_col: str, pred: str, ref: str, tokenizer=metric_tokens) -> DataFrame:
    """Token arrays ``_pt`` and ``_rt``. The texts are dealt out by id first, so
    what is exploded from them later is grouped by ``(id, ...)`` where it is: the
    texts are shuffled, not their tokens or n-grams."""
    texts = by_id(df.select(id_col, F.col(pred).alias("_p"), F.col(ref).alias("_r")), id_col)
    return texts.select(id_col, tokenizer("_p").alias("_pt"), tokenizer("_r").alias("_rt"))


def ngram_overlap(df: DataFrame, id_col: str, pred: str, ref: str, max_n: int = MAX_N,
                  tokenizer=metric_tokens) -> DataFrame:
    """Clipped n-gram matches ``m1..m<max_n>`` and lengths ``c`` (prediction)
    and ``r`` (reference) per id."""
    t = tokenized(df, id_col, pred, ref, tokenizer)
    grams = F.concat(*[_ngrams(F.col(c), n, p) for n in range(1, max_n + 1) for c, p in (("_pt", 1), ("_rt", 0))])
    ex = t.select(id_col, F.explode(grams).alias("_g")).select(id_col, "_g.n", "_g.gram", "_g.p")
    both = ex.groupBy(id_col, "n", "gram").agg(F.sum("p").alias("cp"), F.sum(1 - F.col("p")).alias("cr"))
    m = both.groupBy(id_col).agg(
        *[F.sum(F.when(F.col("n") == n, F.least("cp", "cr")).otherwise(0)).alias(f"m{n}")
          for n in range(1, max_n + 1)])
    lens = t.select(id_col, F.size("_pt").alias("c"), F.size("_rt").alias("r"))
    out = lens.join(m, on=id_col, how="left")
    for n in range(1, max_n + 1):
        out = out.withColumn(f"m{n}", F.coalesce(F.col(f"m{n}"), F.lit(0)).cast("long"))
    return out


def bleu_from_overlap(max_n: int = MAX_N) -> Column:
    """BLEU-max_n, one reference, no smoothing; 0 when any precision is 0;
    null (invalid) when prediction or reference is empty."""
    c, r = F.col("c"), F.col("r")
    logs = None
    for n in range(1, max_n + 1):
        p = F.col(f"m{n}") / F.greatest(c - n + 1, F.lit(0))
        term = F.log(p)
        logs = term if logs is None else logs + term
    any_zero = None
    for n in range(1, max_n + 1):
        z = (F.col(f"m{n}") == 0) | (c - n + 1 <= 0)
        any_zero = z if any_zero is None else any_zero | z
    bp = F.when(c > r, F.lit(1.0)).otherwise(F.exp(1 - r / c))
    score = F.when(any_zero, F.lit(0.0)).otherwise(F.exp(logs / max_n) * bp)
    return F.when((c > 0) & (r > 0), score)


def rouge_n_from_overlap(n: int) -> Column:
    """ROUGE-n F1 on clipped n-gram overlap."""
    m = F.col(f"m{n}")
    pc = F.greatest(F.col("c") - n + 1, F.lit(0))
    rc = F.greatest(F.col("r") - n + 1, F.lit(0))
    p = m / F.greatest(pc, F.lit(1))
    rr = m / F.greatest(rc, F.lit(1))
    return F.when(p + rr > 0, 2 * p * rr / (p + rr)).otherwise(F.lit(0.0))


def bleu_rouge(df: DataFrame, id_col: str, pred: str, ref: str, style: str = "unicode") -> DataFrame:
    """BLEU-4 and ROUGE-1/2 F1. ``style='library'`` tokenises BLEU with the
    13a rules (case kept, punctuation tokens) and ROUGE with lower-cased
    ASCII ``[a-z0-9]`` runs; the default uses Unicode letter/digit runs for
    both (one shared n-gram table)."""
    bt, rt = _TOKENIZERS[style]
    if bt is rt:
        o = ngram_overlap(df, id_col, pred, ref, tokenizer=bt)
        return o.select(id_col, "c", "r", bleu_from_overlap().alias("bleu"),
                        rouge_n_from_overlap(1).alias("rouge1"), rouge_n_from_overlap(2).alias("rouge2"))
    b = ngram_overlap(df, id_col, pred, ref, tokenizer=bt).select(id_col, "c", "r", bleu_from_overlap().alias("bleu"))
    r = ngram_overlap(df, id_col, pred, ref, max_n=2, tokenizer=rt).select(
        id_col, rouge_n_from_overlap(1).alias("rouge1"), rouge_n_from_overlap(2).alias("rouge2"))
    return b.join(r, on=id_col, how="inner")


def _occurrence_from_end(ex: DataFrame, id_col: str, pos: str, chunk: int) -> DataFrame:
    """``k`` = 1 for the last occurrence of a word in a text, 2 for the one
    before, ... Salted by position chunks so no window holds a whole text:
    rank from the end inside (text, word, chunk) (at most ``chunk`` rows),
    plus the occurrences in later chunks, summed over a per-chunk count
    table (at most ``len / chunk`` rows per word)."""
    ex = ex.withColumn("_ch", F.floor(F.col(pos) / chunk))
    ex = ex.withColumn("_lk", F.row_number().over(Window.partitionBy(id_col, "w", "_ch").orderBy(F.desc(pos))))
    cnt = ex.groupBy(id_col, "w", "_ch").agg(F.count(F.lit(1)).alias("_c"))
    later = Window.partitionBy(id_col, "w").orderBy(F.desc("_ch")).rowsBetween(Window.unboundedPreceding, -1)
    cnt = cnt.withColumn("_after", F.coalesce(F.sum("_c").over(later), F.lit(0))).drop("_c")
    ex = ex.join(cnt, on=[id_col, "w", "_ch"], how="inner")
    return ex.withColumn("k", F.col("_after") + F.col("_lk")).drop("_ch", "_lk", "_after")


def _tokens(t: DataFrame, id_col: str) -> DataFrame:
    """``(id, p, pos, w)``: every token of both texts, ``p`` true for the prediction's."""
    def side(c: str, predicted: bool) -> Column:
        return F.coalesce(F.transform(c, lambda w, i: F.struct(F.lit(predicted).alias("p"), i.cast("int").alias("pos"), w.alias("w"))),
                          F.array().cast("array<struct<p:boolean,pos:int,w:string>>"))

    return t.select(id_col, F.explode(F.concat(side("_pt", True), side("_rt", False))).alias("_t")).select(id_col, "_t.p", "_t.pos", "_t.w")


def meteor_exact(df: DataFrame, id_col: str, pred: str, ref: str, chunk: int | None = None) -> DataFrame:
    """METEOR, exact-match stage. Alignment as in the common implementation:
    hypothesis words from last to first each take the last unmatched equal
    reference word, i.e. the k-th last occurrence of a word in the hypothesis
    pairs with its k-th last occurrence in the reference. Chunks are runs of
    matches consecutive in both texts (sorted by hypothesis position).
    ``Fmean = PR / (alpha P + (1 - alpha) R)``,
    ``penalty = gamma (chunks / matches)^beta``. 0 when nothing matches.

    The texts are shuffled once, by id; windows and counts keyed by ``(id, ...)``
    run where a text's tokens are and spill. ``chunk`` spreads the occurrences
    of texts too long for that over tasks, by parts of so many positions, at
    the price of shuffling every token."""
    t = tokenized(df, id_col, pred, ref)
    tokens = _tokens(t, id_col)
    if chunk is None:
        k = tokens.withColumn("k", F.row_number().over(Window.partitionBy(id_col, "w", "p").orderBy(F.desc("pos"))))
    else:
        k = _occurrence_from_end(tokens.where("p"), id_col, "pos", chunk).unionByName(
            _occurrence_from_end(tokens.where("NOT p"), id_col, "pos", chunk))
    m = k.groupBy(id_col, "w", "k").agg(F.max(F.when(F.col("p"), F.col("pos"))).alias("hpos"),
                                        F.max(F.when(~F.col("p"), F.col("pos"))).alias("rpos"))
    m = m.where(F.col("hpos").isNotNull() & F.col("rpos").isNotNull()).select(id_col, "hpos", (F.col("hpos") - F.col("rpos")).alias("_diag"))
    # a match (h, r) continues a chunk iff (h-1, r-1) is also a match; that lies
    # on the same diagonal, so it is the greatest position before on it (by
    # range: texts of one id can hold a match twice)
    before = F.max("hpos").over(Window.partitionBy(id_col, "_diag").orderBy("hpos").rangeBetween(Window.unboundedPreceding, -1))
    agg = m.withColumn("_start", F.coalesce(before, F.lit(-2)) != F.col("hpos") - 1).groupBy(id_col).agg(
        F.count(F.lit(1)).alias("matches"), F.count_if("_start").alias("chunks"))
    lens = t.select(id_col, F.size("_pt").alias("c"), F.size("_rt").alias("r"))
    out = lens.join(agg, on=id_col, how="left").fillna(0, subset=["matches", "chunks"])
    mm, c, r = F.col("matches"), F.col("c"), F.col("r")
    p = mm / c
    rr = mm / r
    fmean = p * rr / (METEOR_ALPHA * p + (1 - METEOR_ALPHA) * rr)
    pen = METEOR_GAMMA * F.pow(F.col("chunks") / mm, METEOR_BETA)
    score = F.when((mm > 0) & (c > 0) & (r > 0), fmean * (1 - pen)).otherwise(F.lit(0.0))
    return out.select(id_col, "matches", "chunks", "c", "r", score.alias("meteor"))


# ---------------------------------------------------------------------------
# ROUGE-L and ROUGE-Lsum: tokens made by the JVM, bit-vector LCS in Arrow batches

@F.pandas_udf(T.DoubleType())
def _rouge_l(pred: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([rouge_l_score(p, r) for p, r in zip(pred, ref)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _rouge_lsum(pred: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([rouge_lsum_score(p, r) for p, r in zip(pred, ref)], dtype="float64")


def _whole(tokens, col: str) -> Column:
    return tokens(F.coalesce(F.col(col), F.lit("")))


def _sentences(tokens, col: str) -> Column:
    return F.transform(F.split(F.coalesce(F.col(col), F.lit("")), "\n"), tokens)


def rouge_l(df: DataFrame, id_col: str, pred: str, ref: str, style: str = "unicode") -> DataFrame:
    """ROUGE-L F1 per id; 0 where a text is null or has no token."""
    tokens = _TOKENIZERS[style][1]
    return df.select(id_col, _rouge_l(_whole(tokens, pred), _whole(tokens, ref)).alias("rougeL"))


def rouge_lsum(df: DataFrame, id_col: str, pred: str, ref: str, style: str = "unicode") -> DataFrame:
    """ROUGE-Lsum F1 per id, sentences being lines; 0 where a text is null or has no token."""
    tokens = _TOKENIZERS[style][1]
    return df.select(id_col, _rouge_lsum(_sentences(tokens, pred), _sentences(tokens, ref)).alias("rougeLsum"))


def score_all(df: DataFrame, id_col: str, pred: str, ref: str, with_rouge_l: bool = True,
              style: str = "unicode") -> DataFrame:
    """All metrics per id plus ``valid`` (BLEU computable: both texts have
    tokens)."""
    br = bleu_rouge(df, id_col, pred, ref, style)
    me = meteor_exact(df, id_col, pred, ref).select(id_col, "meteor")
    out = br.join(me, on=id_col, how="inner")
    if with_rouge_l:
        tokens = _TOKENIZERS[style][1]
        both = df.select(id_col, _rouge_l(_whole(tokens, pred), _whole(tokens, ref)).alias("rougeL"),
                         _rouge_lsum(_sentences(tokens, pred), _sentences(tokens, ref)).alias("rougeLsum"))
        out = out.join(both, on=id_col, how="inner")
    return out.withColumn("valid", F.col("bleu").isNotNull())
