"""Parsing of model output and log text (all JVM built-ins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import after_last, find_suffix, py_strip

DIALOG_SCHEMA = "array<struct<role:string,content:string>>"


def parse_completion(df: DataFrame, content: str = "content", out: str = "parsed",
                     on_error: str = "null") -> DataFrame:
    """Every lazy, dot-all ``[{ ... }]`` span is stripped and parsed as a
    JSON list of messages. Default (``on_error='null'``): if any span fails,
    the whole completion gives null; zero spans give an empty list.
    ``on_error='drop_span'`` keeps the spans that parse.

    ``allowSingleQuotes`` is off so that ``{'role': ...}`` fails like
    ``json.loads`` does.
    """
    spans = F.regexp_extract_all(F.col(content), F.lit(fixed.QA_SPAN_PATTERN), 1)
    opts = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
    # validity like json.loads: any well-formed JSON value (VARIANT parse);
    # the typed parse only extracts the dialogs
    def item(s: Column) -> Column:
        d = F.from_json(py_strip(s), DIALOG_SCHEMA, opts)
        # (the typed parse also accepts duplicate keys, as json.loads does)
        return F.struct((F.try_parse_json(py_strip(s)).isNotNull() | d.isNotNull()).alias("ok"), d.alias("d"))

    items = F.transform(spans, item)
    df = df.withColumn("_spans", items)
    if on_error == "drop_span":
        res = F.transform(F.filter(F.col("_spans"), lambda x: x["ok"]), lambda x: x["d"])
    else:
        res = F.when(F.exists(F.col("_spans"), lambda x: ~x["ok"]), F.lit(None)) \
            .otherwise(F.transform(F.col("_spans"), lambda x: x["d"]))
    return df.withColumn(out, res).drop("_spans")


def route_call(output: str | Column) -> Column:
    """Text after the last ``OUTPUT:`` (stripped) when the output
    mentions ``invoke`` (any case), else the fallback ``Invoke agent1``."""
    o = F.col(output) if isinstance(output, str) else output
    return F.when(F.lower(o).contains("invoke"), py_strip(after_last(o, fixed.ROUTER_OUTPUT_MARK))) \
        .otherwise(F.lit(fixed.ROUTER_FALLBACK))


def next_agent(call: str | Column, question: str | Column) -> Column:
    """First of agent1..agent3 named in the lower-cased call; null (END)
    when none is named or the last message (the question) is empty."""
    c = F.lower(F.col(call) if isinstance(call, str) else call)
    q = F.col(question) if isinstance(question, str) else question
    expr = F.lit(None).cast("string")
    for name in reversed(fixed.ROUTER_AGENTS):
        expr = F.when(c.contains(name), F.lit(name)).otherwise(expr)
    return F.when(F.coalesce(F.char_length(q), F.lit(0)) > 0, expr)


def tool_route(last_message: str | Column) -> Column:
    """``tools`` when the last message contains ``tool_calls``, else END."""
    m = F.col(last_message) if isinstance(last_message, str) else last_message
    return F.when(m.contains(fixed.TOOL_CALL_MARK), F.lit("tools")).otherwise(F.lit("END"))


def answer_only(response: str | Column, missing: str = "compat") -> Column:
    """Text after the first ``Answer:`` (Python ``find`` arithmetic)."""
    return find_suffix(response, fixed.ANSWER_MARK, missing)


def answer_after_query(response: str | Column, query: str | Column, missing: str = "compat") -> Column:
    """Text after the first occurrence of the query."""
    q = F.col(query) if isinstance(query, str) else query
    return find_suffix(response, q, missing)


def parse_train_log(lines: DataFrame, value: str = "value", file_name: str = "file_name",
                    line_no: str = "line_no") -> DataFrame:
    """First ``Epoch N: train_perplexity=X, train_epoch_loss=Y`` match
    per line; the run comes from the file name (first / second / else third)."""
    pat = fixed.TRAIN_LOG_PATTERN
    v = F.col(value)
    hit = F.regexp_extract(v, pat, 0) != ""
    run = (F.when(F.col(file_name).contains("first"), "first")
           .when(F.col(file_name).contains("second"), "second").otherwise("third"))
    return lines.where(hit).select(
        run.alias("run"), F.col(line_no),
        F.regexp_extract(v, pat, 1).cast("int").alias("epoch"),
        F.regexp_extract(v, pat, 2).cast("double").alias("perplexity"),
        F.regexp_extract(v, pat, 3).cast("double").alias("loss"),
    )


def train_curve(parsed: DataFrame) -> DataFrame:
    """One point per (run, epoch); a repeated epoch keeps its last
    line so that epochs and values stay aligned."""
    return parsed.groupBy("run", "epoch").agg(
        F.max_by("perplexity", "line_no").alias("perplexity"),
        F.max_by("loss", "line_no").alias("loss"),
    )
