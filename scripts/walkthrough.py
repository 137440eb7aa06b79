"""End-to-end use of the library on the given tables.

    python scripts/walkthrough.py /root/testdata/sf0.001 <output_dir>

E1 corpus build: pages -> section text (K1); sections -> generation prompt ->
   model -> parsed QA pairs (R7, K3); dialogs -> QA pairs -> agents -> splits
   (K4) -> tokens -> packed training chunks.
E2 baseline evaluation: test questions -> retrieval over train -> prompt ->
   model -> result records (K5) -> read back (S6) -> per-arm summary.
E3 router + specialists: the same questions through the router and the
   routed agent's train split.

The models here are the deterministic offline defaults plus a small
demonstration completion model; pass real factories in practice.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from quarry.functions import fixed  # noqa: E402
from quarry.operators import evalrun, extract, infer, metrics, parse, tokens  # noqa: E402
from quarry.plans import inputs as I  # noqa: E402
from quarry.session import get_spark, read_table  # noqa: E402
from quarry.sinks import writers  # noqa: E402
from quarry.sources import files  # noqa: E402


def demo_completion_model():
    """Turns each knowledge text's first sentence into one QA span."""
    import json

    def run(prompts):
        out = []
        for p in prompts:
            body = p.split("<knowledge_text>\n", 1)[-1].split("\n<end_knowledge_text>", 1)[0]
            first = body.strip().split(".")[0][:200]
            span = json.dumps([{"role": "user", "content": f"What does this say: {first}?"},
                               {"role": "assistant", "content": first}])
            out.append(f"FACT 1:\n{span}\n")
        return out
    return run


def main() -> None:
    sf, out = sys.argv[1], sys.argv[2]
    spark = get_spark(app="quarry-walkthrough")

    # E1 -------------------------------------------------------------------
    pages = read_table(spark, sf, "pages")
    toc = extract.toc_links(pages)
    sections = extract.page_text(pages).join(
        toc.where("chapter_no = 0").select("page_id", "text_location"), "page_id", "left").select(
        F.format_string("ch%02d", F.col("page_id") % 27).alias("chapter"),
        F.format_string("sec%02d", F.col("page_id")).alias("section"),
        F.coalesce("text_location", F.lit("")).alias("text_location"), "text")
    writers.write_sections(sections, f"{out}/sections")
    writers.write_description(toc, f"{out}/description")

    docs = read_table(spark, sf, "documents").select(F.col("source").alias("source_path"), "text")
    generated = infer.generate_qa_pairs(docs, model_factory=demo_completion_model)
    writers.write_generation_outputs(generated, f"{out}/generated")

    splits = I.specialist_splits(spark, sf)
    writers.write_splits(splits, f"{out}/splits")
    ex = I.token_examples(spark, sf).where("split = 'train'")
    packed = tokens.pack_chunks(ex, fixed.CONTEXT_LENGTH_SMALL, order=["split_rank", "pair_id"], group=["agent"])
    packed.write.mode("overwrite").parquet(f"{out}/packed")

    # E2 -------------------------------------------------------------------
    base, arch = I.both_arms(spark, sf)
    rec = evalrun.result_records(base, "answer_only")
    writers.append_results(rec.drop("pair_id"), f"{out}/results_baseline")
    good, bad = files.read_result_lines(spark, f"{out}/results_baseline")

    # E3 -------------------------------------------------------------------
    arch_pred = arch.withColumn("prediction", parse.answer_after_query("answer", "input_text"))
    rec_a = evalrun.result_records(arch_pred.withColumnRenamed("answer", "response"), "prediction",
                                   with_answer_only=False)
    writers.append_results(rec_a.drop("pair_id"), f"{out}/results_architecture")

    scored = metrics.score_all(base.select("pair_id", "answer_only", "target_text"), "pair_id",
                               "answer_only", "target_text", with_rouge_l=False).withColumn("arm", F.lit("baseline"))
    summary = evalrun.eval_summary(scored, metric="meteor")

    print("sections", spark.read.parquet(f"{out}/sections").count())
    print("generated", generated.count(), "parsed", generated.where("parsed IS NOT NULL").count())
    print("splits", splits.groupBy("split").count().orderBy("split").collect())
    print("packed chunks", spark.read.parquet(f"{out}/packed").count())
    print("baseline records", good.count(), "rejected lines", bad.count())
    print("summary", summary.collect())
    spark.stop()


if __name__ == "__main__":
    main()
