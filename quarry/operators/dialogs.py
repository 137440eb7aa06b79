"""Dialog operators: QA-pair extraction, running history, chat examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from .ranks import rank_within

PAIR_ID_STRIDE = 1_000_000


def pair_id(conv: str | Column = "conv_id", turn: str | Column = "turn") -> Column:
    """One long per (conversation, turn). Turns below ``PAIR_ID_STRIDE`` of
    non-negative conversations give ``conv * stride + turn``, readable in
    results. All others give a negative id from a bijection of the pair (Cantor's,
    over the turns past the stride), so no two pairs of the two ranges can
    meet; a pair too large for a long raises an overflow instead of wrapping."""
    c = (F.col(conv) if isinstance(conv, str) else conv).cast("long")
    t = (F.col(turn) if isinstance(turn, str) else turn).cast("long")
    plain = (t >= 0) & (t < PAIR_ID_STRIDE) & (c >= 0)

    def natural(x: Column) -> Column:  # 0, 1, -1, 2, -2 ... -> 0, 1, 2, 3, 4 ...
        return F.when(x > 0, x * 2 - 1).otherwise(x * -2).cast("decimal(38,0)")

    a, b = natural(c), natural(t)
    cantor = F.floor((a + b) * (a + b + 1) / 2) + b
    return F.when(plain, c * F.lit(PAIR_ID_STRIDE) + t).otherwise((-cantor - 1).cast("long"))


def with_chapter(turns: DataFrame, n_chapters: int = 27, conv: str = "conv_id") -> DataFrame:
    """Fixture role: a conversation's chapter is ``ch{conv_id % n:02d}``."""
    return turns.withColumn("chapter", F.format_string("ch%02d", F.col(conv) % n_chapters))


def qa_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text", keep: tuple[str, ...] = ("chapter",)) -> DataFrame:
    """A ``user`` turn directly followed by an ``assistant`` turn gives one
    pair (roles compared lower-cased, texts stripped like ``str.strip``).

    ``turn`` orders the dialog and may have gaps: a conversation's turns are
    numbered densely first. Messages of one turn number are alternatives of one
    position: none follows another, and each user message there pairs with every
    assistant message of the next number. Messages without a turn are left out. The next turn is found by an equi-join on ``(conv,
    position + 1)``: both sides are hash-partitioned on the composite key, so
    one very long conversation is spread over many tasks instead of landing in
    a single window partition. Only the keys are ranked.
    """
    keep = tuple(k for k in keep if k in turns.columns)
    keys = turns.select(conv, turn).where(F.col(turn).isNotNull()).distinct()
    placed = rank_within(keys, [turn], group=[conv], rank_col="_pos").select(conv, turn, "_pos")
    users = turns.where(F.lower(F.col(role)) == "user").select(
        F.col(conv), F.col(turn), *[F.col(k) for k in keep],
        py_strip(F.col(text)).alias("input_text")).join(placed, on=[conv, turn])
    answers = turns.where(F.lower(F.col(role)) == "assistant").select(
        F.col(conv), F.col(turn), py_strip(F.col(text)).alias("target_text")).join(placed, on=[conv, turn])
    answers = answers.select(conv, (F.col("_pos") - 1).alias("_pos"), "target_text")
    out = users.join(answers, on=[conv, "_pos"], how="inner")
    return out.select(pair_id(conv, turn).alias("pair_id"), conv, turn, *keep,
                      "input_text", "target_text")


def dialog_history(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                   role: str = "role", text: str = "text", keep_history: bool = True,
                   as_array: bool = True, at_roles: tuple[str, ...] | None = ("user",)) -> DataFrame:
    """The model input when a message of ``at_roles`` is sent = all
    earlier messages of the dialog (any role: user turns and the replies
    appended after them) plus the current one; ``keep_history=False``: the
    current message only. ``at_roles=None`` emits a row for every turn.

    The output itself grows with the square of a dialog's length, so the
    window per conversation is inherent to the operator.
    """
    msg = F.struct(F.col(role).alias("role"), F.col(text).alias("content"))
    if not keep_history:
        out = turns.withColumn("n_history", F.lit(1).cast("long")).withColumn(
            "history_chars", F.char_length(text).cast("long"))
        if as_array:
            out = out.withColumn("history", F.array(msg))
    elif as_array:
        w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
        out = turns.withColumn("n_history", F.count(F.lit(1)).over(w))
        out = out.withColumn("history_chars", F.sum(F.char_length(text)).over(w))
        out = out.withColumn("history", F.collect_list(msg).over(w))
    else:
        # sizes only: a rank and a prefix sum per conversation, computed by the
        # two-level rank, so a huge conversation spans many partitions
        from .ranks import rank_within
        t = turns.withColumn("_len", F.char_length(text))
        out = rank_within(t, order=[turn], group=[conv], weight="_len", rank_col="n_history",
                          prefix_col="_before")
        out = out.withColumn("history_chars", F.col("_before") + F.coalesce(F.col("_len"), F.lit(0))) \
            .drop("_len", "_before")
    if at_roles:
        out = out.where(F.col(role).isin(*at_roles))
    return out


def chat_examples(pairs: DataFrame, system_prompt: str | Column) -> DataFrame:
    """``{"messages": [system, user, assistant]}`` per QA pair."""
    sp = F.lit(system_prompt) if isinstance(system_prompt, str) else system_prompt
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), sp.alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("input_text").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("target_text").alias("content")),
    )
    return pairs.withColumn("messages", msgs)


# [ours] template for P20; the model's own chat template is not part of the
# reference. Header/footer markers follow a common public chat format.
CHAT_TEMPLATE = ("<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>")


def chat_render(df: DataFrame, messages: str = "messages", out: str = "chat_text",
                template: tuple[str, str, str] = CHAT_TEMPLATE) -> DataFrame:
    """P20: render a message list to one string (``tokenize=False``)."""
    head, mid, tail = template
    rendered = F.array_join(F.transform(F.col(messages), lambda m: F.concat(
        F.lit(head), m["role"], F.lit(mid), m["content"], F.lit(tail))), "")
    return df.withColumn(out, rendered)


DIALOG_FILE_SCHEMA = "array<array<struct<role:string,content:string>>>"


def explode_dialog_files(files: DataFrame, path: str = "path", content: str = "value") -> DataFrame:
    """S1 parse stage: each file holds a JSON list of dialogs. Returns one row
    per message with ``(path, dialog_idx, turn, role, content)``; the order key
    is ``(path, dialog_idx, turn)``. A file is one JSON document, so one file
    is parsed by one task; nothing is collected across files."""
    parsed = files.select(F.col(path), F.from_json(F.col(content), DIALOG_FILE_SCHEMA).alias("d"))
    dialogs = parsed.select(path, F.posexplode("d").alias("dialog_idx", "dialog"))
    msgs = dialogs.select(path, "dialog_idx", F.posexplode("dialog").alias("turn", "m"))
    return msgs.select(path, "dialog_idx", "turn", F.col("m.role").alias("role"),
                       F.col("m.content").alias("content"))


def chapter_filter(df: DataFrame, chapters: list[str], path: str = "path",
                   mode: str = "substring") -> DataFrame:
    """Keep a file if any chapter string is a substring of its path
    (``mode='equal'`` compares a parsed ``chapter`` column instead, which
    prunes partitions when the data is partitioned by chapter)."""
    if not chapters:
        return df
    if mode == "equal":
        return df.where(F.col("chapter").isin(chapters))
    cond = F.lit(False)
    for ch in chapters:
        cond = cond | F.col(path).contains(ch)
    return df.where(cond)


def qa_pairs_nested(df: DataFrame, dialog: str = "dialog") -> DataFrame:
    """W1 on nested dialogs (``array<struct<role, content>>``, as read from
    dialog files): pairs from adjacent messages with array functions, no
    shuffle. Adds ``pairs: array<struct<turn, input_text, target_text>>``."""
    d = F.col(dialog)
    idx = F.when(F.size(d) > 1, F.sequence(F.lit(0), F.size(d) - 2)).otherwise(F.array().cast("array<int>"))
    cand = F.transform(idx, lambda i: F.struct(
        i.alias("turn"), F.lower(d[i]["role"]).alias("_r0"), F.lower(d[i + 1]["role"]).alias("_r1"),
        py_strip(d[i]["content"]).alias("input_text"), py_strip(d[i + 1]["content"]).alias("target_text")))
    keep = F.filter(cand, lambda s: (s["_r0"] == "user") & (s["_r1"] == "assistant"))
    return df.withColumn("pairs", F.transform(keep, lambda s: F.struct(
        s["turn"].alias("turn"), s["input_text"].alias("input_text"), s["target_text"].alias("target_text"))))


def chat_examples_nested(df: DataFrame, dialog: str, system_prompt: str | Column) -> DataFrame:
    """P8 on whole dialogs: ``{"messages": [system] + dialog}``; the system
    prompt may be a column (e.g. one prompt per agent from a joined
    dimension)."""
    sp = F.lit(system_prompt) if isinstance(system_prompt, str) else system_prompt
    head = F.array(F.struct(F.lit("system").alias("role"), sp.alias("content")))
    return df.withColumn("messages", F.concat(head, F.col(dialog)))
