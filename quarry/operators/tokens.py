"""Tokenise, mask, pack and pad training examples.

The built-in tokenizer splits words, numbers and single punctuation marks and
maps them to ids through a vocabulary that is itself built by Spark (count ->
rank). A user tokenizer can be plugged in with :func:`encode_with`.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .ranks import rank_within

# fixed values of the built-in vocabulary ([ours]; the reference's model
# tokenizer is not offline)
UNK_ID, BOS_ID, EOS_ID = 0, 1, 2
FIRST_ID = 3
TOKEN_PATTERN = r"\p{L}+|\p{N}+|[^ \t\n\r\f\x0B\p{L}\p{N}]"


def text_tokens(x: str | Column) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 0)


def build_vocab(texts: DataFrame, cols: list[str]) -> DataFrame:
    """T1(b): ``(token, n, id)``; ids by descending count, then token.
    The count is a groupBy with map-side combine (hot tokens collapse early)
    and the ranking is the two-level rank (no single-partition sort)."""
    exploded = None
    for c in cols:
        part = texts.select(F.explode(text_tokens(c)).alias("token"))
        exploded = part if exploded is None else exploded.unionByName(part)
    counts = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = rank_within(counts, order=[F.col("n").desc(), F.col("token")], rank_col="_r")
    return ranked.withColumn("id", (F.col("_r") + FIRST_ID - 1).cast("int")).drop("_r")


def _vocab_join(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Token -> id. No broadcast hint: the vocabulary grows with the corpus,
    so AQE decides at run time from its measured size (broadcast under
    ``spark.sql.autoBroadcastJoinThreshold``, else a shuffle join whose skewed
    hot-token partitions AQE splits)."""
    v = vocab.select("token", "id")
    out = tokens.join(v, on="token", how="left")
    return out.withColumn("id", F.when(F.col("token").isNotNull(), F.coalesce("id", F.lit(UNK_ID))))


def encode_parts(df: DataFrame, id_col: str, parts: list[str | Column], vocab: DataFrame) -> DataFrame:
    """Encode several text parts per row; returns ``(id_col, ids_<i>...)``
    arrays in token order. One list per example is gathered (the example is
    the output record). ``posexplode_outer`` keeps rows without tokens, so no
    join back to the input is needed."""
    pieces = None
    for i, p in enumerate(parts):
        col = F.col(p) if isinstance(p, str) else p
        e = df.select(F.col(id_col), F.lit(i).alias("_part"),
                      F.posexplode_outer(text_tokens(col)).alias("_pos", "token"))
        pieces = e if pieces is None else pieces.unionByName(e)
    ided = _vocab_join(pieces, vocab)
    grouped = ided.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("_part", "_pos", "id"))).alias("_t"))
    def part_ids(i: int) -> Column:
        keep = F.filter("_t", lambda s: (s["_part"] == i) & s["id"].isNotNull())
        return F.transform(keep, lambda s: s["id"])

    out = grouped
    for i in range(len(parts)):
        out = out.withColumn(f"ids_{i}", part_ids(i))
    return out.drop("_t")


def mask_labels(prompt_ids: str, answer_ids: str) -> list[Column]:
    """BOS + prompt + answer + EOS; labels ignore the prompt (-100);
    attention mask all ones."""
    inp = F.concat(F.array(F.lit(BOS_ID)), F.col(prompt_ids), F.col(answer_ids), F.array(F.lit(EOS_ID)))
    labels = F.concat(F.array_repeat(F.lit(fixed.LABEL_IGNORE), F.size(prompt_ids) + 1),
                      F.col(answer_ids), F.array(F.lit(EOS_ID)))
    mask = F.array_repeat(F.lit(1), F.size(prompt_ids) + F.size(answer_ids) + 2)
    return [inp.alias("input_ids"), mask.alias("attention_mask"), labels.alias("labels")]


def encode_with(df: DataFrame, text: str, tokenizer_factory: Callable[[], Callable[[str], list[int]]],
                out: str = "ids") -> DataFrame:
    """T1(a): a user tokenizer in an Arrow batch UDF, built once per worker."""
    state: dict = {}

    @F.pandas_udf("array<int>")
    def enc(s: pd.Series) -> pd.Series:
        if "tok" not in state:
            state["tok"] = tokenizer_factory()
        tok = state["tok"]
        return pd.Series([None if x is None else list(tok(x)) for x in s])

    return df.withColumn(out, enc(F.col(text)))


def pack_chunks(examples: DataFrame, chunk_len: int, order: list[str], group: list[str] = (),
                cols: tuple[str, ...] = ("input_ids", "attention_mask", "labels")) -> DataFrame:
    """Concatenate examples in ``order`` (per ``group``) and cut into
    ``chunk_len`` pieces. A chunk is emitted only while the buffer holds more
    than ``chunk_len`` tokens, so ``(T - 1) div L`` chunks come out of ``T``
    tokens and the rest is dropped.

    Token offsets are exclusive prefix sums of the lengths (two-level, no
    single-partition window). Each example contributes a slice to every chunk
    it touches; a chunk gathers at most ``chunk_len`` tokens.
    """
    group = list(group)
    first = cols[0]
    ex = examples.withColumn("_len", F.size(first))
    ex = rank_within(ex, order=order, group=group, weight="_len", rank_col="_ord",
                     prefix_col="_off", total_col="_total")
    L = chunk_len
    n_chunks = F.floor((F.col("_total") - 1) / L)
    ex = ex.withColumn("_c0", F.floor(F.col("_off") / L)).withColumn(
        "_c1", F.floor((F.col("_off") + F.col("_len") - 1) / L))
    ex = ex.where(F.col("_len") > 0)
    pieces = ex.select(*group, "_off", "_len", "_total", *cols,
                       F.explode(F.sequence(F.col("_c0"), F.col("_c1"))).alias("chunk"))
    pieces = pieces.where(F.col("chunk") < n_chunks)
    start = F.greatest(F.col("chunk") * L - F.col("_off"), F.lit(0))
    end = F.least((F.col("chunk") + 1) * L - F.col("_off"), F.col("_len"))
    sl = [F.slice(F.col(c), (start + 1).cast("int"), (end - start).cast("int")).alias(c) for c in cols]
    pieces = pieces.select(*group, "chunk", "_off", *sl)
    agg = pieces.groupBy(*group, "chunk").agg(
        F.sort_array(F.collect_list(F.struct("_off", *cols))).alias("_p"))
    def field(c: str) -> Column:
        return F.flatten(F.transform("_p", lambda p: p[c])).alias(c)

    return agg.select(*group, F.col("chunk").cast("long").alias("chunk"), *[field(c) for c in cols])


def pad_batches(batched: DataFrame, batch: str = "batch", pad_id: int = EOS_ID,
                group: list[str] = ()) -> DataFrame:
    """T4: pad every example to its batch maximum (labels with -100, mask
    with 0). A batch holds ``batch_size`` rows, so the window is small."""
    from pyspark.sql import Window
    w = Window.partitionBy(*group, batch)
    out = batched.withColumn("padded_len", F.max(F.size("input_ids")).over(w))
    out = out.withColumn("n_pad", F.col("padded_len") - F.size("input_ids"))
    n_pad = F.col("n_pad")
    out = out.withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(pad_id), n_pad)))
    out = out.withColumn("labels", F.concat("labels", F.array_repeat(F.lit(fixed.LABEL_IGNORE), n_pad)))
    out = out.withColumn("attention_mask", F.concat("attention_mask", F.array_repeat(F.lit(0), n_pad)))
    return out
