"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Column names and types line up with ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agents, split
from . import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


@query("qa_pairs")
def qa_pairs(spark, sf):
    return I.pairs(spark, sf).select("pair_id", "conv_id", "turn", "chapter", "input_text", "target_text")


@query("agent_assign")
def agent_assign(spark, sf):
    return I.assigned(spark, sf).select("pair_id", "chapter", F.coalesce("agent", F.lit(0)).alias("agent"))


@query("qa_count_by_agent")
def qa_count_by_agent(spark, sf):
    a = I.assigned(spark, sf).withColumn("agent", F.coalesce("agent", F.lit(0)))
    return agents.count_by_agent(a)


@query("split_random")
def split_random(spark, sf):
    return I.specialist_splits(spark, sf).select("pair_id", "agent", "split", "shuffle_rank", "split_rank")


@query("split_hash")
def split_hash(spark, sf):
    return split.split_hash(I.pairs(spark, sf)).select("pair_id", "split")


@query("split_ordered")
def split_ordered(spark, sf):
    out = split.split_ordered(I.pairs(spark, sf), order=["chapter", "conv_id", "turn", "pair_id"],
                              train_tenths=9)
    return out.select("pair_id", "pos", "split")


@query("orchestrator_union")
def orchestrator_union(spark, sf):
    return agents.orchestrator_union(I.specialist_splits(spark, sf)).select(
        "pair_id", "agent", "split", "orch_pos")


@query("orchestrator_split")
def orchestrator_split(spark, sf):
    return agents.orchestrator_split(I.specialist_splits(spark, sf)).select(
        "pair_id", "agent", "split", "orch_split", "moved")


@query("shard_assign")
def shard_assign(spark, sf):
    train = I.specialist_splits(spark, sf).where(F.col("split") == "train").select("pair_id")
    return split.shard_assign(train, num_replicas=4).select("pair_id", "shard")


@query("fixed_batches")
def fixed_batches(spark, sf):
    test = I.specialist_splits(spark, sf).where(F.col("split") == "test")
    out = split.fixed_batches(test, 4, order=["split_rank", "pair_id"], group=["agent"])
    return out.select("pair_id", "agent", "batch", "batch_pos")


# --------------------------------------------------------------------------
# validation and statistics (examples = conversations, long form)

from ..functions import fixed  # noqa: E402
from ..operators import dialogs, evalrun, extract, metrics, parse, prompts, retrieve, tokens, validate  # noqa: E402
from ..session import read_table  # noqa: E402


def _example_stats(spark, sf):
    return validate.example_stats(read_table(spark, sf, "conversations"))


@query("missing_roles")
def missing_roles(spark, sf):
    return validate.missing_roles(_example_stats(spark, sf))


@query("token_estimate")
def token_estimate(spark, sf):
    return _example_stats(spark, sf).select("conv_id", "n_messages", "n_tokens", "n_assistant_tokens")


@query("token_limit")
def token_limit(spark, sf):
    return validate.token_limit(_example_stats(spark, sf))


@query("epoch_plan")
def epoch_plan(spark, sf):
    return validate.epoch_plan(_example_stats(spark, sf))


@query("distributions")
def distributions(spark, sf):
    """A2/A3 for the three per-example counts, ranked once in long form
    (``metric`` is the group key of the exact quantiles)."""
    from ..operators.quantiles import summary
    st = _example_stats(spark, sf)
    long = st.select(F.explode(F.array(
        F.struct(F.lit("num_messages_per_example").alias("metric"), F.col("n_messages").cast("double").alias("v")),
        F.struct(F.lit("num_total_tokens_per_example").alias("metric"), F.col("n_tokens").cast("double").alias("v")),
        F.struct(F.lit("num_assistant_tokens_per_example").alias("metric"),
                 F.col("n_assistant_tokens").cast("double").alias("v")))).alias("m")).select("m.*")
    s = summary(long, "v", (0.1, 0.5, 0.9), group=["metric"])
    return s.select("metric", *[F.round(c, 6).alias(a) for c, a in (
        ("min", "min"), ("max", "max"), ("mean", "mean"), ("q0500", "median"), ("q0100", "p10"), ("q0900", "p90"))])


def chat_jsonl(spark, sf):
    """Chat examples as JSON lines, one per QA pair, with a deterministic mix
    of the malformed shapes the validator must catch (chosen by pair_id)."""
    p = I.pairs(spark, sf)
    m = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    sys_m = m("role", "system", "content", F.concat(F.lit("Chapter "), F.col("chapter")))
    user_m = m("role", "user", "content", F.col("input_text"))
    asst_m = m("role", "assistant", "content", F.col("target_text"))
    doc = lambda *msgs: F.to_json(F.struct(F.array(*msgs).alias("messages")))
    v = F.col("pair_id") % 7
    line = (F.when(v == 0, doc(sys_m, user_m, asst_m))
            .when(v == 1, doc(user_m, m("role", "assistant", "function_call", "f")))
            .when(v == 2, doc(sys_m, m("role", "user", "content", F.col("input_text"), "weight_x", "1"), asst_m))
            .when(v == 3, doc(m("role", "User", "content", ""), asst_m))
            .when(v == 4, F.lit('{"messages":[]}'))
            .when(v == 5, F.col("turn").cast("string"))
            .otherwise(doc(sys_m, user_m)))
    return p.select("pair_id", line.alias("value"))


@query("format_errors")
def format_errors(spark, sf):
    return validate.count_format_errors(validate.format_errors(chat_jsonl(spark, sf)))


# --------------------------------------------------------------------------
# dialogs, chat examples, prompts

@query("dialog_history")
def dialog_history(spark, sf):
    h = dialogs.dialog_history(read_table(spark, sf, "conversations"))
    digest = F.md5(F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\u001e"))
    return h.select("conv_id", "turn", "n_history", "history_chars", digest.alias("history_md5"))


@query("dialogs_explode")
def dialogs_explode(spark, sf):
    p = I.pairs(spark, sf)
    doc = F.to_json(F.array(F.array(
        F.struct(F.lit("user").alias("role"), F.col("input_text").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("target_text").alias("content")))))
    files = p.select(F.concat(I.chapter_path(), F.lit("#"), F.col("turn").cast("string")).alias("path"),
                     doc.alias("value"), "pair_id")
    ex = dialogs.explode_dialog_files(files)
    return ex.join(files.select("path", "pair_id"), on="path").select(
        "pair_id", F.col("dialog_idx").cast("int").alias("dialog_idx"), F.col("turn").cast("int").alias("turn"),
        "role", "content")


@query("chapter_filter")
def chapter_filter(spark, sf):
    t = I.turns(spark, sf).withColumn("path", I.chapter_path())
    return dialogs.chapter_filter(t, fixed.AGENT_CHAPTERS[2]).select("conv_id", "turn", "path")


@query("chat_format")
def chat_format(spark, sf):
    c = dialogs.chat_examples(I.pairs(spark, sf), fixed.SYSTEM_PROMPT)
    return c.select("pair_id", F.size("messages").alias("n_messages"),
                    F.col("messages")[0]["content"].alias("system_content"),
                    F.col("messages")[1]["content"].alias("user_content"),
                    F.col("messages")[2]["content"].alias("assistant_content"))


@query("chat_render")
def chat_render(spark, sf):
    c = dialogs.chat_examples(I.pairs(spark, sf), fixed.SYSTEM_PROMPT)
    return dialogs.chat_render(c).select("pair_id", "chat_text")


@query("answer_prompt")
def answer_prompt(spark, sf):
    return prompts.with_answer_prompt(I.pairs(spark, sf)).select("pair_id", "prompt", "answer")


@query("gen_prompt")
def gen_prompt(spark, sf):
    d = read_table(spark, sf, "documents")
    req = prompts.generation_request("text")
    return d.select("doc_id", F.size(req).alias("n_messages"), req[0]["content"].alias("system_prompt"),
                    req[1]["content"].alias("user_prompt"))


def completions(spark, sf):
    """Model completions derived from the QA pairs: ``FACT n:`` lines with
    JSON spans, plus broken variants (chosen by pair_id) that the parser must
    reject as a whole."""
    p = I.pairs(spark, sf)
    msg = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    span = F.to_json(F.array(msg("user", F.col("input_text")), msg("assistant", F.col("target_text"))))
    span2 = F.to_json(F.array(msg("user", F.col("target_text")), msg("assistant", F.col("input_text"))))
    head = F.concat(F.lit("FACT "), F.col("turn").cast("string"), F.lit(":\n"))
    v = (F.col("conv_id") + F.col("turn")) % 4
    content = (F.when(v == 0, F.concat(head, span))
               .when(v == 1, F.concat(head, span, F.lit("\n"), span2, F.lit("\n(more)")))
               .when(v == 2, F.concat(head, F.replace(span, F.lit('","content":"'), F.lit('","content:" "'))))
               .otherwise(F.concat(head, span, F.lit("\n[{'role':'user','content':'more'}]"))))
    return p.select("pair_id", content.alias("content"))


@query("parse_completion")
def parse_completion(spark, sf):
    c = parse.parse_completion(completions(spark, sf))
    return c.select("pair_id", F.when(F.col("parsed").isNotNull(), F.size("parsed")).otherwise(-1).alias("n_dialogs"),
                    F.col("parsed")[0][0]["content"].alias("first_question"))


# --------------------------------------------------------------------------
# pages, sections, logs

@query("page_text")
def page_text(spark, sf):
    return extract.page_text(read_table(spark, sf, "pages")).select("page_id", "text")


@query("page_text_handbook")
def page_text_handbook(spark, sf):
    """P1 with a class selector over pages of nested containers, references and open tags."""
    return extract.page_text(I.handbook_pages(spark, sf), tag="div.handbook-page").select("page_id", "text")


@query("page_text_nested")
def page_text_nested(spark, sf):
    """P1 with tags nested as written: an open paragraph holds the rest of its container."""
    pages = I.handbook_pages(spark, sf, unclosed="i = 3")
    return extract.page_text(pages, tag="div.handbook-page", nesting="nested").select("page_id", "text")


@query("toc_menus")
def toc_menus(spark, sf):
    """P2-P4 with sub-menus, class selectors and links of every form."""
    return extract.toc_links(I.menu_pages(spark, sf), menu_tag="div.handbook-container", menu="ul.toc-menu", item="li.menu-item", sub="ul.sub-menu")


@query("page_headings")
def page_headings(spark, sf):
    return extract.page_headings(read_table(spark, sf, "pages")).select("page_id", "heading")


@query("toc_links")
def toc_links(spark, sf):
    return extract.toc_links(read_table(spark, sf, "pages")).select(
        "page_id", "chapter_no", "section_no", "section_name", "url", "text_location")


@query("section_topn")
def section_topn(spark, sf):
    """Sections sorted by (folder, file), first ``max_entries``."""
    from ..sources.files import first_sections
    d = read_table(spark, sf, "documents")
    return first_sections(d, 50, folder="source", name="doc_id").select("source", "doc_id", "n_chars")


@query("chapter_concat")
def chapter_concat(spark, sf):
    """A folder's texts concatenated (newline after each) -- kept as an
    ordered table of pieces with their character offsets, never one string."""
    from ..sources.files import concat_offsets
    d = read_table(spark, sf, "documents")
    return concat_offsets(d, folder="source", order=["doc_id"], text="text").select(
        "source", "doc_id", "start_offset", "piece_len")


def train_log_lines(spark, sf):
    """Training-log lines derived from ``events``: one log file per arm, a
    metrics line per event (``error`` events give noise lines)."""
    e = read_table(spark, sf, "events")
    fname = (F.when(F.col("event_type") == "click", "finetune_output_first_agent.log")
             .when(F.col("event_type") == "view", "finetune_output_second_agent.log")
             .otherwise("finetune_output_third_agent.log"))
    ppl = 1 + F.col("value") / 10
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("ERROR step "), F.col("event_id").cast("string"))) \
        .otherwise(F.concat(F.lit("step "), F.col("event_id").cast("string"), F.lit(" Epoch "),
                            (F.col("user_id") % 50).cast("string"), F.lit(": train_perplexity="),
                            F.format_string("%.4f", ppl), F.lit(", train_epoch_loss="),
                            F.format_string("%.4f", F.log(ppl)), F.lit(" lr=3e-4")))
    return e.select(fname.alias("file_name"), F.col("event_id").alias("line_no"), line.alias("value"))


@query("train_log_parse")
def train_log_parse(spark, sf):
    return parse.parse_train_log(train_log_lines(spark, sf))


@query("train_curve")
def train_curve(spark, sf):
    return parse.train_curve(parse.parse_train_log(train_log_lines(spark, sf)))


def result_lines(spark, sf):
    """Result-file lines derived from the QA pairs: JSON records, stray
    ``Total Time`` lines and truncated records (chosen by pair_id)."""
    p = I.pairs(spark, sf)
    rec = F.to_json(F.struct(F.col("input_text").alias("query"), "target_text",
                             F.col("target_text").alias("response"),
                             (F.col("turn") / 10).alias("inference_time")))
    v = F.col("pair_id") % 6
    line = (F.when(v == 0, F.concat(F.lit("Total Time: "), F.col("turn").cast("string"), F.lit(" seconds")))
            .when(v == 1, F.expr("substring(_rec, 1, char_length(_rec) - 2)"))
            .otherwise(F.col("_rec")))
    return p.withColumn("_rec", rec).select(F.col("pair_id").alias("line_no"), line.alias("value"))


@query("eval_results_load")
def eval_results_load(spark, sf):
    good, _bad = evalrun.parse_result_lines(result_lines(spark, sf))
    return good.select(F.col("line_no").alias("pair_id"), "query", "target_text", "inference_time")


# --------------------------------------------------------------------------
# tokens

@query("vocab")
def vocab(spark, sf):
    p = I.pairs(spark, sf).withColumn("prompt", prompts.answer_prompt("input_text"))
    return tokens.build_vocab(p, ["prompt", "target_text"]).select("token", "n", "id")


def _ids(c):
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",")


@query("mask_labels")
def mask_labels(spark, sf):
    t = I.token_examples(spark, sf)
    return t.select("pair_id", F.size("input_ids").alias("n_tokens"), (F.col("_np") + 1).alias("n_prompt"),
                    _ids("input_ids").alias("input_ids"), _ids("labels").alias("labels"))


@query("pack_chunks")
def pack_chunks(spark, sf):
    t = I.token_examples(spark, sf).where(F.col("split") == "train")
    packed = tokens.pack_chunks(t, fixed.CONTEXT_LENGTH_SMALL, order=["split_rank", "pair_id"], group=["agent"])
    return packed.select("agent", "chunk", F.size("input_ids").alias("n_tokens"),
                         _ids("input_ids").alias("input_ids"), _ids("labels").alias("labels"))


def _length_batches(spark, sf):
    t = I.token_examples(spark, sf).where(F.col("split") == "train").withColumn("n_tokens", F.size("input_ids"))
    return split.length_batches(t, 4, length="n_tokens")


@query("length_batches")
def length_batches(spark, sf):
    return _length_batches(spark, sf).select("pair_id", "n_tokens", "batch", "batch_order")


@query("pad_batches")
def pad_batches(spark, sf):
    b = tokens.pad_batches(_length_batches(spark, sf))
    return b.select("pair_id", "batch", "padded_len", "n_pad",
                    F.element_at("input_ids", -1).alias("last_id"), F.element_at("labels", -1).alias("last_label"))


# --------------------------------------------------------------------------
# retrieval, answering, routing

@query("term_vectors")
def term_vectors(spark, sf):
    return retrieve.term_vectors(I.pairs(spark, sf), "pair_id", "input_text").select(
        "pair_id", "token", "tf")


@query("knn_dense")
def knn_dense(spark, sf):
    e = read_table(spark, sf, "embeddings")
    nb = retrieve.knn(e, e, "vec_id", "vec_id", k=fixed.RETRIEVAL_K, kind="dense", exclude_self=True,
                      materialize=False)
    return nb.select("vec_id", "rank", "nbr_id", F.round("distance", 6).alias("distance"))


def _orch_sets(spark, sf):
    o = I.orchestrator(spark, sf)
    q = o.where(F.col("orch_split") == "test").select("pair_id", "input_text", "target_text")
    c = o.where(F.col("orch_split") == "train").select("pair_id", "input_text", "target_text")
    return q, c


@query("knn_lexical")
def knn_lexical(spark, sf):
    q, c = _orch_sets(spark, sf)
    qv = retrieve.sparse_rows(retrieve.term_vectors(q, "pair_id", "input_text"), "pair_id", q)
    cv = retrieve.sparse_rows(retrieve.term_vectors(c, "pair_id", "input_text"), "pair_id", c)
    nb = retrieve.knn(qv, cv, "pair_id", "pair_id", k=fixed.RETRIEVAL_K, kind="sparse", materialize=False)
    return nb.select("pair_id", "rank", "nbr_id", F.round("distance", 6).alias("distance"))


@query("rag_prompt")
def rag_prompt(spark, sf):
    return I.baseline_arm(spark, sf).select("pair_id", "prompt")


@query("rag_answer")
def rag_answer(spark, sf):
    return I.baseline_arm(spark, sf).select("pair_id", "response", "answer_only")


@query("answer_only")
def answer_only(spark, sf):
    r = I.baseline_arm(spark, sf)
    return r.select("pair_id", parse.answer_only("response").alias("answer_only"),
                    parse.answer_only(F.col("target_text")).alias("answer_only_missing"))


@query("answer_after_query")
def answer_after_query(spark, sf):
    r = I.baseline_arm(spark, sf)
    return r.select("pair_id", parse.answer_after_query("response", "input_text").alias("answer"))


@query("eval_join")
def eval_join(spark, sf):
    q, _ = _orch_sets(spark, sf)
    r = I.baseline_arm(spark, sf).select("pair_id", "response")
    return evalrun.eval_join(q, r).select("pair_id", F.col("input_text").alias("query"), "target_text", "response")


def router_outputs(spark, sf):
    """Router completions in the shapes the parser meets (chosen by ids)."""
    p = I.pairs(spark, sf)
    a = F.concat(F.lit("agent"), (F.col("conv_id") % 3 + 1).cast("string"))
    v = (F.col("conv_id") + F.col("turn")) % 5
    out = (F.when(v == 0, F.concat(prompts.router_prompt("input_text"), F.lit(" Invoke "), a))
           .when(v == 1, F.concat(F.lit("Invoke "), a))
           .when(v == 2, F.concat(a, F.lit(" fits. OUTPUT: nothing")))
           .when(v == 3, F.lit("invoke OUTPUT: agent3 or agent1"))
           .otherwise(F.lit("Invoke OUTPUT: none")))
    return p.select("pair_id", "input_text", out.alias("router_output"))


@query("route")
def route(spark, sf):
    r = router_outputs(spark, sf)
    call = parse.route_call("router_output")
    return r.select("pair_id", call.alias("agent_call"),
                    F.coalesce(parse.next_agent(call, "input_text"), F.lit("END")).alias("next_agent"))


@query("routed_answer")
def routed_answer(spark, sf):
    a = I.architecture_arm(spark, sf)
    return a.select("pair_id", F.coalesce("next_agent", F.lit("END")).alias("next_agent"), "answer")


@query("tool_route")
def tool_route(spark, sf):
    return I.architecture_arm(spark, sf).select("pair_id", "tool_route")


@query("rag_prompt_agent")
def rag_prompt_agent(spark, sf):
    from ..operators import infer
    o = I.orchestrator(spark, sf)
    q = o.where(F.col("orch_split") == "test").select("pair_id", "input_text", "target_text")
    train = I.specialist_splits(spark, sf).where(F.col("split") == "train").select(
        "pair_id", "agent", "input_text", "target_text")
    routed = infer.retrieval_router(q, train)
    call = parse.route_call("router_output")
    ag = F.regexp_extract(parse.next_agent(call, "input_text"), r"(\d+)$", 1).cast("int")
    go = routed.withColumn("agent", ag).where(F.col("agent").isNotNull())
    qv = retrieve.sparse_rows(retrieve.term_vectors(go, "pair_id", "input_text"), "pair_id", go).join(
        go.select("pair_id", "agent"), on="pair_id")
    cv = retrieve.sparse_rows(retrieve.term_vectors(train, "pair_id", "input_text"), "pair_id", train).join(
        train.select("pair_id", "agent"), on="pair_id")
    nb = retrieve.knn(qv, cv, "pair_id", "pair_id", k=fixed.RETRIEVAL_K, kind="sparse", group="agent")
    ctx = retrieve.gather(nb.drop("agent"), train, "pair_id", "pair_id", "target_text")
    j = go.join(ctx, on="pair_id")
    return j.select("pair_id", "agent", prompts.rag_prompt("context", "input_text", style="agent").alias("prompt"))


# --------------------------------------------------------------------------
# metrics and evaluation summaries

def _baseline_pairs(spark, sf):
    return I.baseline_arm(spark, sf).select("pair_id", F.col("answer_only").alias("prediction"),
                                            F.col("target_text").alias("reference"))


@query("bleu")
def bleu(spark, sf):
    s = metrics.bleu_rouge(_baseline_pairs(spark, sf), "pair_id", "prediction", "reference")
    return s.select("pair_id", F.round("bleu", 6).alias("bleu"))


@query("rouge_n")
def rouge_n(spark, sf):
    s = metrics.bleu_rouge(_baseline_pairs(spark, sf), "pair_id", "prediction", "reference")
    return s.select("pair_id", F.round("rouge1", 6).alias("rouge1"), F.round("rouge2", 6).alias("rouge2"))


@query("rouge_l")
def rouge_l(spark, sf):
    s = metrics.rouge_l(_baseline_pairs(spark, sf), "pair_id", "prediction", "reference")
    return s.select("pair_id", F.round("rougeL", 6).alias("rougeL"))


@query("rouge_lsum")
def rouge_lsum(spark, sf):
    """ROUGE-Lsum (union LCS over newline-split sentences)."""
    s = metrics.rouge_lsum(_baseline_pairs(spark, sf), "pair_id", "prediction", "reference")
    return s.select("pair_id", F.round("rougeLsum", 6).alias("rougeLsum"))


@query("meteor_exact")
def meteor_exact(spark, sf):
    s = metrics.meteor_exact(_baseline_pairs(spark, sf), "pair_id", "prediction", "reference")
    return s.select("pair_id", "matches", "chunks", F.round("meteor", 6).alias("meteor"))


@query("bleu_library")
def bleu_library(spark, sf):
    """M1/M2 by the public scorers' tokens over edited answers."""
    s = metrics.bleu_rouge(I.edited_answers(spark, sf), "pair_id", "prediction", "reference", style="library")
    return s.select("pair_id", "c", "r", *[F.round(c, 6).alias(c) for c in ("bleu", "rouge1", "rouge2")])


@query("meteor_stages")
def meteor_stages(spark, sf):
    """M4 with punctuation tokens, Porter stems and a table of word groups."""
    from ..operators import alignment
    stages = (alignment.exact(), alignment.stems(), alignment.synonyms(I.word_groups(spark, sf)))
    s = alignment.meteor(I.edited_answers(spark, sf), "pair_id", "prediction", "reference", stages=stages)
    n = F.col("stage_matches")
    return s.select("pair_id", "matches", "chunks", n[0].alias("n_exact"), n[1].alias("n_stem"), n[2].alias("n_group"),
                    F.round("meteor", 6).alias("meteor"))


def _edited_scores(spark, sf):
    """Two arms over one input: the edited answer and the question itself as prediction."""
    e = I.edited_answers(spark, sf)
    arms = e.select("pair_id", "reference", F.explode(F.array(
        F.struct(F.lit("edited").alias("arm"), F.col("prediction").alias("prediction"), F.col("seconds").alias("seconds")),
        F.struct(F.lit("question").alias("arm"), F.col("question").alias("prediction"), (F.col("seconds") * 2).alias("seconds"))
    )).alias("a")).select(F.struct("a.arm", "pair_id").alias("_key"), "a.prediction", "a.seconds", "reference")
    me = metrics.meteor_exact(arms, "_key", "prediction", "reference").select(
        "_key", "meteor", ((F.col("c") > 0) & (F.col("r") > 0)).alias("valid"))
    return arms.select("_key", "seconds").join(me, on="_key").select("_key.arm", "_key.pair_id", "seconds", "meteor", "valid")


@query("eval_report")
def eval_report(spark, sf):
    """A7/A8/A13/V6 with latency: per arm the scored and invalid rows, metric and time statistics."""
    s = evalrun.eval_summary(_edited_scores(spark, sf), arm="arm", metric="meteor", time_col="seconds")
    return s.select("arm", "n_scored", "n_invalid", *[F.round(f"{m}_{f}", 6).alias(f"{m}_{f}")
                                                     for m in ("meteor", "time") for f in ("min", "max", "mean", "median")])


@query("eval_report_paired")
def eval_report_paired(spark, sf):
    s = evalrun.eval_paired_arms(_edited_scores(spark, sf), "edited", "question", metric="meteor")
    return s.select("n_common", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "mean_diff")])


def _arm_scores(spark, sf):
    """Both arms scored the way the analysis does: prediction = response
    after the query (P18), METEOR + validity. The arms are stacked first so
    the metric job runs once, keyed by ``(arm, pair_id)``."""
    b, a = I.both_arms(spark, sf)
    stacked = b.select(F.lit(0).alias("arm_no"), "pair_id", "input_text", "target_text", "response").unionByName(
        a.select(F.lit(1).alias("arm_no"), "pair_id", "input_text", "target_text", F.col("answer").alias("response")))
    d = stacked.select(F.struct("arm_no", "pair_id").alias("_key"), "arm_no", "pair_id",
                       parse.answer_after_query("response", "input_text").alias("prediction"),
                       F.col("target_text").alias("reference"))
    me = metrics.meteor_exact(d, "_key", "prediction", "reference").select(
        "_key", "meteor", ((F.col("c") > 0) & (F.col("r") > 0)).alias("valid"))
    scored = d.select("_key", "arm_no", "pair_id").join(me, on="_key")
    scored = scored.withColumn("arm", F.when(F.col("arm_no") == 0, "baseline").otherwise("architecture"))
    return scored.select("arm", "pair_id", "meteor", "valid")


@query("eval_summary")
def eval_summary(spark, sf):
    s = evalrun.eval_summary(_arm_scores(spark, sf), arm="arm", metric="meteor")
    return s.select("arm", "n_scored", "n_invalid", *[F.round(c, 6).alias(c) for c in (
        "meteor_min", "meteor_max", "meteor_mean", "meteor_median")])


@query("eval_paired")
def eval_paired(spark, sf):
    s = evalrun.eval_paired_arms(_arm_scores(spark, sf), "architecture", "baseline", metric="meteor")
    return s.select("n_common", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "mean_diff")])


@query("batch_latency")
def batch_latency(spark, sf):
    e = read_table(spark, sf, "events")
    b = evalrun.batch_latency(e, "value", order=["ts", "event_id"], batch_size=8, group=["event_type"])
    return b.select("event_id", "event_type", "batch", F.round("latency", 6).alias("latency"))


@query("arm_latency")
def arm_latency(spark, sf):
    e = read_table(spark, sf, "events")
    s = evalrun.arm_latency(e, "event_type", "value")
    return s.select(F.col("event_type").alias("arm"), "n", *[F.round(c, 6).alias(c) for c in (
        "time_mean", "time_min", "time_max")])
