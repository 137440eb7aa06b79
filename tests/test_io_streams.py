"""Sources, sinks and stream-equals-batch checks on small temp inputs."""
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from quarry.operators import dialogs, parse
from quarry.operators.evalrun import eval_summary
from quarry.sinks import writers
from quarry.sources import files
from quarry.streaming import streams


def test_read_dialog_files(spark, tmp_path):
    d1 = tmp_path / "ch01"
    d2 = tmp_path / "ch02_old" / "x"
    d1.mkdir()
    d2.mkdir(parents=True)
    (d1 / "sec01_qa_pairs.json").write_text(json.dumps([[{"role": "user", "content": "q1"},
                                                          {"role": "assistant", "content": "a1"}],
                                                         [{"role": "user", "content": "q2"}]]))
    (d2 / "sec01_qa_pairs.json").write_text(json.dumps([[{"role": "user", "content": "q3"}]]))
    (d1 / "notes.txt").write_text("ignored")
    df = files.read_dialog_files(spark, str(tmp_path))
    rows = df.orderBy("path", "dialog_idx", "turn").select("dialog_idx", "turn", "content").collect()
    assert [r.content for r in rows] == ["q1", "a1", "q2", "q3"]
    # substring chapter match on the whole path: ch02_old matches ch02
    only = files.read_dialog_files(spark, str(tmp_path), chapters=["ch02"])
    assert [r.content for r in only.collect()] == ["q3"]


def test_jsonl_strict_and_tolerant(spark, tmp_path):
    p = tmp_path / "qa.jsonl"
    p.write_text('{"input_text": "q", "target_text": "a"}\n\n{"input_text": "q2", "target_text": "a2"}\n')
    assert files.read_jsonl_strict(spark, str(p)).count() == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"input_text": "q", "target_text": "a"}\n{broken\n')
    with pytest.raises(Exception):
        files.read_jsonl_strict(spark, str(bad)).collect()
    good, rej = files.read_jsonl_tolerant(spark, str(bad))
    assert good.count() == 1 and rej.count() == 1


def test_result_lines_skip_total_time(spark, tmp_path):
    p = tmp_path / "results.json"
    rec = {"query": "q", "target_text": "t", "response": "r", "inference_time": 0.5}
    p.write_text(json.dumps(rec) + "\nTotal Time: 3.2 seconds\n" + json.dumps(rec)[:-3] + "\n" + json.dumps(rec) + "\n")
    good, bad = files.read_result_lines(spark, str(p))
    assert good.count() == 2
    assert [r.line_no for r in bad.collect()] == [3]


def test_sections_topn_and_concat(spark, tmp_path):
    for ch, secs in (("ch00", ["sec00.txt"]), ("ch01", ["sec02.txt", "sec01.txt"])):
        (tmp_path / ch).mkdir()
        for s in secs:
            (tmp_path / ch / s).write_text(f"{ch}/{s} body")
    df = files.read_sections(spark, str(tmp_path)).withColumn("folder", F.regexp_extract("folder", r"(ch\d+)$", 1))
    top = files.first_sections(df, 2).collect()
    assert [(r.folder, r.name) for r in top] == [("ch00", "sec00.txt"), ("ch01", "sec01.txt")]
    assert files.first_sections(df, 0).count() == 3
    off = files.concat_offsets(df, "folder", ["name"], "text").where("folder = 'ch01'").orderBy("name").collect()
    whole = "".join(r.text + "\n" for r in off)
    for r in off:
        assert whole[r.start_offset:r.start_offset + r.piece_len] == r.text + "\n"


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", "q", "a"), (2, "test", "q2", "a2")],
                               "agent int, split string, input_text string, target_text string")
    writers.write_splits(df, str(tmp_path / "splits"))
    back = spark.read.json(str(tmp_path / "splits"))
    assert sorted((r.agent, r.split) for r in back.collect()) == [(1, "train"), (2, "test")]
    res = spark.createDataFrame([("q", 0.1)], "query string, inference_time double")
    writers.append_results(res, str(tmp_path / "res"))
    writers.append_results(res, str(tmp_path / "res"))
    assert spark.read.json(str(tmp_path / "res")).count() == 2


def test_stream_history_equals_batch(spark, tmp_path):
    conv = spark.read.parquet(f"{SF001}/conversations.parquet")
    src = tmp_path / "turns"
    src.mkdir()
    # two files, earlier turns first: the second micro-batch needs the state
    conv.where("turn < 2").toPandas().to_parquet(src / "a.parquet")
    conv.where("turn >= 2").toPandas().to_parquet(src / "b.parquet")
    os.utime(src / "b.parquet", (os.path.getatime(src / "a.parquet") + 5,) * 2)
    stream = streams.dialog_history_stream(streams.read_turns_stream(spark, str(src)))
    got = streams.run_to_table(stream, "hist_test").select("conv_id", "turn", "n_history", "history_chars")
    exp = dialogs.dialog_history(conv).select("conv_id", "turn", "n_history", F.col("history_chars").cast("long"))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_stream_logs_equal_batch(spark, tmp_path):
    d = tmp_path / "logs"
    d.mkdir()
    (d / "run_first.log").write_text("Epoch 1: train_perplexity=2.5, train_epoch_loss=0.9\nnoise\n")
    (d / "run_second.log").write_text("Epoch 2: train_perplexity=1.5, train_epoch_loss=0.4\n")
    got = streams.run_to_table(streams.train_log_stream(spark, str(d)), "log_test").collect()
    batch = parse.parse_train_log(files.read_lines(spark, str(d))).drop("line_no").collect()
    assert sorted(got) == sorted(batch)


def test_stream_summary_equals_batch(spark, tmp_path):
    d = tmp_path / "res"
    d.mkdir()
    recs = [{"query": "q", "target_text": "t", "response": "r", "inference_time": t, "arm": a}
            for a, t in (("base", 1.0), ("base", 3.0), ("arch", 2.0))]
    (d / "part1.json").write_text("\n".join(json.dumps(r) for r in recs[:2]) + "\n")
    (d / "part2.json").write_text(json.dumps(recs[2]) + "\n")
    got = {r.arm: (r.n, r.time_mean) for r in streams.run_to_table(
        streams.result_summary_stream(spark, str(d)), "sum_test", mode="complete").collect()}
    assert got == {"base": (2, 2.0), "arch": (1, 2.0)}


def test_replayed_batch_writes_nothing_twice(spark, tmp_path):
    out = str(tmp_path / "out")
    sink = streams.batch_sink(out)
    a, b = spark.range(3).repartition(2), spark.range(10, 12)
    for batch, n in ((a, 0), (b, 1), (b, 1), (a, 0)):
        sink(batch, n)
    assert sorted(r.id for r in streams.read_sink(spark, out, a.schema).collect()) == [0, 1, 2, 10, 11]
    assert sorted(r.id for r in streams.read_sink(spark, out, a.schema, "complete").collect()) == [10, 11]
    assert streams.read_sink(spark, str(tmp_path / "none"), a.schema).count() == 0


def test_stream_goes_on_after_restart(spark, tmp_path):
    d = tmp_path / "logs"
    d.mkdir()
    where = {"out_dir": str(tmp_path / "rows"), "checkpoint": str(tmp_path / "state")}
    (d / "run_first.log").write_text("Epoch 1: train_perplexity=2.5, train_epoch_loss=0.9\n")
    assert streams.run_to_table(streams.train_log_stream(spark, str(d)), "tail1", **where).count() == 1
    (d / "run_second.log").write_text("Epoch 2: train_perplexity=1.5, train_epoch_loss=0.4\n")
    got = streams.run_to_table(streams.train_log_stream(spark, str(d)), "tail2", **where).collect()
    assert sorted((r.run, r.epoch) for r in got) == [("first", 1), ("second", 2)]


def test_result_line_behind_no_break_space(spark):
    from quarry.operators.evalrun import parse_result_lines
    lines = spark.createDataFrame([(1, '\u00a0{"query":"a"}'), (2, "{broken"), (3, "Total Time: 1")], "line_no long, value string")
    good, bad = parse_result_lines(lines)
    assert [r.line_no for r in good.collect()] == [1] and [r.line_no for r in bad.collect()] == [2]


def test_write_sections_partitioned(spark, tmp_path):
    df = spark.createDataFrame([("ch00", "sec00", "ch00/sec00.txt", "intro"), ("ch01", "sec01", "ch01/sec01.txt", "a")],
                               "chapter string, section string, text_location string, text string")
    writers.write_sections(df, str(tmp_path / "sections"))
    assert {"chapter=ch00", "chapter=ch01"} <= set(os.listdir(tmp_path / "sections"))
    back = spark.read.parquet(str(tmp_path / "sections")).where("chapter = 'ch01'")
    assert [r.text for r in back.collect()] == ["a"]


def test_answer_text_records(spark, tmp_path):
    df = spark.createDataFrame([("yes", 1.234)], "response string, inference_time double")
    writers.append_answer_text(df, str(tmp_path / "txt"), "m1")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "txt")).collect())
    assert text == "Model Name: m1\nResponse: yes\nInference Time: 1.23 seconds\n"


def test_topn_is_sorted_for_any_limit(spark):
    from quarry.sources import files as fl
    df = spark.range(50).select(F.lit("f").alias("folder"), F.format_string("s%03d", "id").alias("name")).repartition(4)
    for n in (None, 0, 7, 20_000):
        got = [r["name"] for r in fl.first_sections(df, n).collect()]
        assert got == [f"s{i:03d}" for i in range(n or 50)][:50]
