"""Batch answering with a user-supplied model, and the router + specialists arm.

A model is any callable ``list[str] -> list[str]`` built by a factory that
runs once per task (weights load once per partition, not per row). Arrow
batches feed it; ``inference_time`` is the batch wall time divided by the
batch size, given to every row of the batch (like the reference's batch
loop).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from . import parse, prompts, retrieve

Model = Callable[[list[str]], list[str]]


class ContextEchoModel:
    """Offline default model [ours]: returns the prompt followed by a space
    and the first line of its ``Context:`` block (the top retrieved answer).
    Deterministic, so results can be checked; output keeps the prompt, as a
    text-generation pipeline does."""

    def __call__(self, prompts_: list[str]) -> list[str]:
        out = []
        for p in prompts_:
            if p is None:
                out.append(None)
                continue
            ctx = p.split("Context:\n", 1)[1] if "Context:\n" in p else ""
            out.append(p + " " + ctx.split("\n", 1)[0])
        return out


def batch_answer(df: DataFrame, prompt: str, model_factory: Callable[[], Model] = ContextEchoModel,
                 out: str = "response", time_col: str = "inference_time", batch_size: int = 64,
                 materialize: bool = True) -> DataFrame:
    """Run the model over ``prompt`` in batches inside ``mapInPandas``.

    Model output is the most expensive value in the pipeline, so by default
    it is written once to the checkpoint directory (``materialize``): later
    metrics, joins and retried tasks read it instead of running the model
    again."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.StringType()),
                                                    T.StructField(time_col, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for b in batches:
            resp: list = []
            times: list = []
            ps = b[prompt].tolist()
            for s in range(0, len(ps), batch_size):
                chunk = ps[s:s + batch_size]
                t0 = time.perf_counter()
                r = model(chunk)
                dt = (time.perf_counter() - t0) / max(1, len(chunk))
                resp.extend(r)
                times.extend([dt] * len(chunk))
            b = b.copy()
            b[out] = resp
            b[time_col] = times
            yield b

    out_df = df.mapInPandas(run, schema)
    return out_df.checkpoint(eager=True) if materialize else out_df


def rag_answer(queries: DataFrame, corpus: DataFrame, k: int = fixed.RETRIEVAL_K,
               model_factory: Callable[[], Model] = ContextEchoModel, q_vectors: DataFrame | None = None,
               c_vectors: DataFrame | None = None) -> DataFrame:
    """E2 baseline arm: lexical kNN over corpus questions (train), retrieval
    prompt with the neighbours' answers, model, ``answer_only``.

    ``queries``: (pair_id, input_text, target_text); ``corpus`` the same.
    """
    qv = q_vectors if q_vectors is not None else retrieve.sparse_rows(
        retrieve.term_vectors(queries, "pair_id", "input_text"), "pair_id", queries)
    cv = c_vectors if c_vectors is not None else retrieve.sparse_rows(
        retrieve.term_vectors(corpus, "pair_id", "input_text"), "pair_id", corpus)
    # neighbours are read once here (the answers are materialised next)
    nb = retrieve.knn(qv, cv, "pair_id", "pair_id", k=k, kind="sparse", materialize=False)
    ctx = retrieve.gather(nb, corpus, "pair_id", "pair_id", "target_text")
    # a question without a neighbour keeps its row, with an empty context
    q = queries.join(ctx, on="pair_id", how="left").withColumn("context", F.coalesce("context", F.lit("")))
    q = q.withColumn("prompt", prompts.rag_prompt("context", "input_text"))
    ans = batch_answer(q, "prompt", model_factory)
    return ans.withColumn("answer_only", parse.answer_only("response"))


def retrieval_router(queries: DataFrame, train: DataFrame, q_vectors: DataFrame | None = None,
                     c_vectors: DataFrame | None = None) -> DataFrame:
    """Offline default router [ours]: the agent of the nearest train question
    (lexical cosine, ties by id), written as a router completion
    ``<prompt> Invoke agentN``."""
    qv = q_vectors if q_vectors is not None else retrieve.sparse_rows(
        retrieve.term_vectors(queries, "pair_id", "input_text"), "pair_id", queries)
    cv = c_vectors if c_vectors is not None else retrieve.sparse_rows(
        retrieve.term_vectors(train, "pair_id", "input_text"), "pair_id", train)
    nb = retrieve.knn(qv, cv, "pair_id", "pair_id", k=1, kind="sparse")
    agent_of = train.select(F.col("pair_id").alias("nbr_id"), F.col("agent").alias("_ragent"))
    r = nb.join(agent_of, on="nbr_id", how="inner").select("pair_id", "_ragent")
    out = queries.join(r, on="pair_id", how="left")
    return out.withColumn("router_output", F.concat(
        prompts.router_prompt("input_text"), F.lit(" Invoke agent"), F.col("_ragent").cast("string"))).drop("_ragent")


def routed_answer(queries: DataFrame, train: DataFrame, router_outputs: DataFrame | None = None,
                  k: int = fixed.RETRIEVAL_K, model_factory: Callable[[], Model] = ContextEchoModel) -> DataFrame:
    """Router output -> route parse (P14) -> agent (P15) ->
    retrieval inside the routed agent's train split (J5) -> specialist prompt
    (P12) -> model -> final answer = last message (P21). A question routed
    to END answers with itself (the last message)."""
    qv_all = retrieve.sparse_rows(retrieve.term_vectors(queries, "pair_id", "input_text"), "pair_id", queries)
    cv_all = retrieve.sparse_rows(retrieve.term_vectors(train, "pair_id", "input_text"), "pair_id", train)
    cv = cv_all.join(train.select("pair_id", "agent"), on="pair_id")
    fused = None
    if router_outputs is None:
        # One kNN pass serves the default router and the specialists: every
        # query is scored against each agent's train rows (top-k per
        # (query, agent)). The router's nearest train question is the best
        # of the per-agent rank-1 rows (same tie-break), and the specialist
        # context is the routed agent's top-k.
        agents = F.array(*[F.lit(int(a[-1])) for a in fixed.ROUTER_AGENTS])
        qx = qv_all.withColumn("agent", F.explode(agents))
        fused = retrieve.knn(qx, cv, "pair_id", "pair_id", k=k, kind="sparse", group="agent")
        w = Window.partitionBy("pair_id").orderBy(F.round("distance", 9), "nbr_id")
        best = fused.where(F.col("rank") == 1).withColumn("_b", F.row_number().over(w)).where(F.col("_b") == 1)
        routed = queries.join(best.select("pair_id", F.col("agent").alias("_ragent")), on="pair_id", how="left")
        routed = routed.withColumn("router_output", F.concat(
            prompts.router_prompt("input_text"), F.lit(" Invoke agent"), F.col("_ragent").cast("string"))).drop("_ragent")
    else:
        routed = router_outputs
    routed = routed.withColumn("agent_call", parse.route_call("router_output"))
    routed = routed.withColumn("next_agent", parse.next_agent("agent_call", "input_text"))
    routed = routed.withColumn("route_agent", F.regexp_extract("next_agent", r"(\d+)$", 1).cast("int"))
    go = routed.where(F.col("route_agent").isNotNull())
    if fused is not None:
        nb = fused.join(go.select("pair_id", F.col("route_agent").alias("agent")), on=["pair_id", "agent"]).drop("agent")
    else:
        qv = qv_all.join(go.select("pair_id", F.col("route_agent").alias("agent")), on="pair_id")
        nb = retrieve.knn(qv, cv, "pair_id", "pair_id", k=k, kind="sparse", group="agent").drop("agent")
    ctx = retrieve.gather(nb, train, "pair_id", "pair_id", "target_text")
    # a question routed to an agent without train rows keeps its row, with an empty context
    spec = go.join(ctx, on="pair_id", how="left").withColumn("context", F.coalesce("context", F.lit("")))
    spec = spec.withColumn("prompt", prompts.rag_prompt("context", "input_text", style="agent"))
    ans = batch_answer(spec, "prompt", model_factory)
    ans = ans.withColumn("tool_route", parse.tool_route("response"))
    ended = routed.where(F.col("route_agent").isNull()).withColumn("response", F.col("input_text")) \
        .withColumn("inference_time", F.lit(0.0)).withColumn("tool_route", F.lit("END"))
    cols = ["pair_id", "input_text", "target_text", "router_output", "agent_call", "next_agent",
            "response", "inference_time", "tool_route"]
    return ans.select(*cols).unionByName(ended.select(*cols)).withColumnRenamed("response", "answer")


def generate_qa_pairs(sections: DataFrame, text: str = "text", model_factory: Callable[[], Model] | None = None,
                      system_prompt: str = fixed.SYSTEM_PROMPT) -> DataFrame:
    """Section text -> generation prompt (P5/P6) -> model (R6) -> parsed
    dialogs (P7). ``content`` keeps every completion; ``parsed`` is null
    where any span failed (see ``sinks.write_generation_outputs`` for K3).
    The model receives the user prompt; chat models wanting the system
    message can read it from ``system_prompt``."""
    if model_factory is None:
        raise ValueError("a completion model factory is required")
    df = sections.withColumn("_prompt", prompts.generation_prompt(text)) \
        .withColumn("system_prompt", F.lit(system_prompt))
    out = batch_answer(df, "_prompt", model_factory, out="content")
    return parse.parse_completion(out.drop("_prompt"))


def model_router(queries: DataFrame, model_factory: Callable[[], Model], roles: str = fixed.ROLES_TEXT) -> DataFrame:
    """R8 with a user router model: the orchestrator prompt (P13) goes
    through the model (R6); its completion becomes ``router_output`` for
    :func:`routed_answer` (pass it as ``router_outputs``)."""
    q = queries.withColumn("_router_prompt", prompts.router_prompt("input_text", roles))
    out = batch_answer(q, "_router_prompt", model_factory, out="router_output", time_col="router_time")
    return out.drop("_router_prompt")
