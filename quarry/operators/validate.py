"""Chat-example validation, token estimates and dataset statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import ws_count

def _truthy(v: Column) -> Column:
    """Python truthiness of a VARIANT value, by its type: a string, list or
    object counts when it isn't empty (also "0", "false" and "null"), a number
    when it isn't zero, a boolean as it is, null never."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    return F.coalesce(
        F.when(kind == "STRING", text != "")
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "VOID", F.lit(False))
        .when(kind.startswith("OBJECT"), text != "{}")
        .when(kind.startswith("ARRAY"), text != "[]")
        .otherwise(number != 0), F.lit(False))


def format_errors(lines: DataFrame, value: str = "value", id_col: str | None = None) -> DataFrame:
    """V1-V3: per example, the list of error tags (``errors`` array).

    Examples are parsed to VARIANT so that key presence survives (a typed
    struct cannot tell a missing key from a null). ``data_type`` and
    ``missing_messages_list`` stop the checks for that example, as in the
    reference. Use :func:`count_format_errors` for the per-kind totals.
    """
    v = F.expr(f"try_parse_json({value})")
    df = lines.withColumn("_v", v)
    is_obj = F.expr("coalesce(schema_of_variant(_v) LIKE 'OBJECT%', false)")
    msgs = F.expr("try_variant_get(_v, '$.messages', 'array<variant>')")
    df = df.withColumn("_obj", is_obj).withColumn("_msgs", msgs)

    allowed_keys = F.array(*[F.lit(k) for k in fixed.ALLOWED_MESSAGE_KEYS])
    allowed_roles = list(fixed.ALLOWED_ROLES)

    def per_message(m: Column) -> Column:
        mp = F.try_variant_get(m, "$", "map<string,variant>")
        keys = F.coalesce(F.map_keys(mp), F.array().cast("array<string>"))
        role = F.try_variant_get(m, "$.role", "string")
        content_v = F.try_variant_get(m, "$.content", "variant")
        is_str = F.coalesce(F.schema_of_variant(content_v) == "STRING", F.lit(False))
        fcall_v = F.try_variant_get(m, "$.function_call", "variant")
        missing_key = ~F.array_contains(keys, "role") | ~F.array_contains(keys, "content")
        unrec_key = F.size(F.array_except(keys, allowed_keys)) > 0
        unrec_role = F.coalesce(~role.isin(*allowed_roles), F.lit(True))
        missing_content = (~_truthy(content_v) & ~_truthy(fcall_v)) | ~is_str
        tags = F.array(
            F.when(missing_key, F.lit("message_missing_key")),
            F.when(unrec_key, F.lit("message_unrecognized_key")),
            F.when(unrec_role, F.lit("unrecognized_role")),
            F.when(missing_content, F.lit("missing_content")),
        )
        return tags

    msg_tags = F.flatten(F.transform(F.col("_msgs"), per_message))
    has_assistant = F.exists(F.col("_msgs"), lambda m: F.coalesce(
        F.try_variant_get(m, "$.role", "string") == "assistant", F.lit(False)))
    example_tags = F.concat(msg_tags, F.array(F.when(~has_assistant, F.lit("example_missing_assistant_message"))))
    errors = (F.when(~F.col("_obj"), F.array(F.lit("data_type")))
              .when(F.col("_msgs").isNull() | (F.size("_msgs") == 0), F.array(F.lit("missing_messages_list")))
              .otherwise(F.filter(example_tags, lambda t: t.isNotNull())))
    out = df.withColumn("errors", errors).drop("_v", "_obj", "_msgs")
    return out


def count_format_errors(checked: DataFrame) -> DataFrame:
    """Totals per error kind (kinds with no error are absent, like a
    ``defaultdict``). Partial aggregation happens before the shuffle."""
    return checked.select(F.explode("errors").alias("kind")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"))


def message_token_estimate(role: Column, content: Column, name: Column | None = None,
                           counter=ws_count) -> Column:
    """A4 per message: 3 + tokens of every value (+1 when a ``name`` key)."""
    n = F.lit(fixed.TOKENS_PER_MESSAGE) + counter(role) + counter(F.coalesce(content, F.lit("")))
    if name is not None:
        n = n + F.when(name.isNotNull(), counter(name) + fixed.TOKENS_PER_NAME).otherwise(0)
    return n


def example_stats(turns: DataFrame, example: str = "conv_id", role: str = "role",
                  text: str = "text", counter=ws_count) -> DataFrame:
    """A3/A4/V4 per example in long form (one row per message): number of
    messages, estimated total tokens, assistant tokens, and whether a system /
    user message is present. A groupBy with partial aggregation: a very long
    example is summed in pieces on every mapper, never gathered in one list."""
    tok = message_token_estimate(F.col(role), F.col(text), counter=counter)
    return turns.groupBy(example).agg(
        F.count(F.lit(1)).alias("n_messages"),
        (F.sum(tok) + F.lit(fixed.TOKENS_PER_EXAMPLE)).alias("n_tokens"),
        F.sum(F.when(F.col(role) == "assistant", counter(F.col(text))).otherwise(0)).alias("n_assistant_tokens"),
        F.max((F.col(role) == "system").cast("int")).alias("has_system"),
        F.max((F.col(role) == "user").cast("int")).alias("has_user"),
    )


def missing_roles(stats: DataFrame) -> DataFrame:
    """V4: examples missing a system / user message."""
    return stats.agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.sum(1 - F.col("has_system")).alias("n_missing_system"),
        F.sum(1 - F.col("has_user")).alias("n_missing_user"),
    )


def distribution(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """A2: min, max, mean, median and the 0.1/0.9 quantiles (printed as
    "p5/p95" in the reference; named p10/p90 here), exact with linear
    interpolation, computed from the distributed rank (no task holds all
    values)."""
    from .quantiles import summary
    s = summary(df, col, (0.1, 0.5, 0.9))
    return s.select(F.lit(name or col).alias("metric"), "min", "max", "mean",
                    F.col("q0500").alias("median"), F.col("q0100").alias("p10"), F.col("q0900").alias("p90"))


def token_limit(stats: DataFrame, limit: int = fixed.MAX_TOKENS_PER_EXAMPLE) -> DataFrame:
    """V5: examples above the token limit."""
    return stats.agg(F.count_if(F.col("n_tokens") > limit).alias("n_over_limit"),
                     F.count(F.lit(1)).alias("n_examples"))


def epoch_plan(stats: DataFrame) -> DataFrame:
    """Default epochs from the example count, billed tokens capped per
    example at the limit, and their product."""
    agg = stats.agg(F.count(F.lit(1)).alias("n_examples"),
                    F.sum(F.least(F.col("n_tokens"), F.lit(fixed.MAX_TOKENS_PER_EXAMPLE))).alias("billing_tokens"))
    n = F.col("n_examples")
    t = fixed.TARGET_EPOCHS
    epochs = (F.when(n * t < fixed.MIN_TARGET_EXAMPLES,
                     F.least(F.lit(fixed.MAX_DEFAULT_EPOCHS), F.floor(F.lit(fixed.MIN_TARGET_EXAMPLES) / n)))
              .when(n * t > fixed.MAX_TARGET_EXAMPLES,
                    F.greatest(F.lit(fixed.MIN_DEFAULT_EPOCHS), F.floor(F.lit(fixed.MAX_TARGET_EXAMPLES) / n)))
              .otherwise(F.lit(t))).cast("long")
    return agg.withColumn("n_epochs", epochs).withColumn(
        "charged_tokens", F.col("n_epochs") * F.col("billing_tokens"))
