"""Prompt assembly (templates are parameters; constants fold in Catalyst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def generation_prompt(text: str | Column, template: str = fixed.USER_PROMPT, n_questions: int = 100) -> Column:
    """P5: fixed instructions + section text + ``\\n`` + end marker.
    ``n_questions`` has no effect with the active template (no placeholder);
    ``format`` only turns ``{{``/``}}`` into ``{``/``}``."""
    head = template.format(n_questions)
    return F.concat(F.lit(head), _c(text), F.lit("\n" + fixed.KNOWLEDGE_END))


def generation_request(text: str | Column, system_prompt: str = fixed.SYSTEM_PROMPT, **kw) -> Column:
    """Two-message request (system, user)."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
        F.struct(F.lit("user").alias("role"), generation_prompt(text, **kw).alias("content")),
    )


def answer_prompt(question: str | Column, singular: bool = False) -> Column:
    """P10: ``Answer the following questions:\\n{q}\\n---\\nAnswer:\\n``."""
    tpl = fixed.ANSWER_PROMPT_SINGULAR if singular else fixed.ANSWER_PROMPT
    head, tail = tpl.split("{question}")
    return F.concat(F.lit(head), _c(question), F.lit(tail))


def rag_prompt(context: str | Column, question: str | Column, style: str = "baseline") -> Column:
    """P11 (``style='baseline'``): preamble + ``Context:\\n`` + answers joined
    by ``\\n`` + ``\\n---\\nQuestion: q\\nAnswer:``.
    P12 (``style='agent'``): preamble + context, then the question appended
    with no separator."""
    base = F.concat(F.lit(fixed.RAG_PREAMBLE), _c(context))
    if style == "agent":
        return F.concat(base, _c(question))
    return F.concat(base, F.lit(fixed.RAG_QUESTION_SEP), _c(question), F.lit(fixed.RAG_ANSWER_TAG))


def router_prompt(question: str | Column, roles: str | Column = fixed.ROLES_TEXT) -> Column:
    """Instruction + roles + question + `` OUTPUT:``."""
    r = F.lit(roles) if isinstance(roles, str) else roles
    return F.concat(F.lit(fixed.ROUTER_PROMPT_HEAD), r, _c(question), F.lit(fixed.ROUTER_PROMPT_TAIL))


def with_answer_prompt(pairs: DataFrame, singular: bool = False) -> DataFrame:
    """``dataset.map(apply_prompt_template, remove_columns=...)``."""
    return pairs.withColumn("prompt", answer_prompt("input_text", singular)).withColumn(
        "answer", F.col("target_text")).drop("input_text", "target_text")
