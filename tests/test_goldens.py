"""Hand-worked mini goldens (FIXTURES.md section 3) and 2.14 quirks."""
import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import fixed
from quarry.operators import dialogs, lcs, metrics, parse, split, tokens, validate


def test_qa_pair_extraction(spark):
    rows = [(0, 0, "system", "s"), (0, 1, "User", " q1 "), (0, 2, "assistant", "a1\n"), (0, 3, "user", "q2"),
            (0, 4, "user", "q3"), (0, 5, "ASSISTANT", "a3"), (0, 6, "user", "q4")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = dialogs.qa_pairs(df).orderBy("turn").select("input_text", "target_text").collect()
    assert [tuple(r) for r in out] == [("q1", "a1"), ("q3", "a3")]


def test_qa_pairs_across_gaps_in_turn(spark):
    rows = [(0, 0, "user", "q1"), (0, 2, "assistant", "a1"), (0, 7, "user", "q2"), (0, 9, "system", "s"), (0, 10, "assistant", "a2"),
            (1, 5, "user", "q3"), (1, 50, "assistant", "a3"), (2, 1, "user", "q4")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = dialogs.qa_pairs(df).orderBy("pair_id").select("conv_id", "turn", "input_text", "target_text").collect()
    assert [tuple(r) for r in out] == [(0, 0, "q1", "a1"), (1, 5, "q3", "a3")]


def test_strip_is_unicode(spark):
    from quarry.functions.text import py_strip
    s = " \t x y \n　"
    out = spark.createDataFrame([(s,)], "t string").select(py_strip("t").alias("o")).first().o
    assert out == s.strip()


@pytest.mark.parametrize("content,expected", [
    ("none", []),
    ('a [{"role":"user","content":"q"},\n{"role":"assistant","content":"x"}] b [{"role":"assistant","content":"a"}]', 2),
    ('[{"role":"user","content":"raw\ncontrol char"}]', None),
    ('[{"role":"user","content:" "q"}]', None),
    ("[{'role':'user'}]", None),
    ('[ {"role":"user","content":"q"} ]', []),
    ('[{"role":"user","content":"see }] here"}]', None),
    ('[{"role":"user","content":"q"}] [{bad}]', None),
])
def test_completion_parse(spark, content, expected):
    df = spark.createDataFrame([(content,)], "content string")
    got = parse.parse_completion(df).first().parsed
    if expected is None:
        assert got is None
    elif expected == []:
        assert got == []
    else:
        assert len(got) == expected


@pytest.mark.parametrize("text,mark,expected", [
    ("ctx Answer: yes", "Answer:", " yes"), ("abcdefghij", "Answer:", "ghij"), ("abc", "", "abc"),
    ("a Answer: b Answer: c", "Answer:", " b Answer: c"),
])
def test_suffix_cut(spark, text, mark, expected):
    from quarry.functions.text import find_suffix
    df = spark.createDataFrame([(text, mark)], "t string, m string")
    assert df.select(find_suffix("t", F.col("m")).alias("o")).first().o == expected
    assert text[text.find(mark) + len(mark):] == expected


@pytest.mark.parametrize("out,agent", [
    ("... OUTPUT: Invoke agent2", "agent2"), ("agent3 ... OUTPUT: nothing", "agent1"),
    ("invoke OUTPUT: agent3 or agent1", "agent1"), ("Invoke OUTPUT: none", None),
])
def test_route(spark, out, agent):
    df = spark.createDataFrame([(out, "q")], "o string, q string")
    r = df.select(parse.next_agent(parse.route_call("o"), "q").alias("a")).first().a
    assert r == agent


@pytest.mark.parametrize("n,train", [(5, 4), (7, 5), (10, 8)])
def test_split_sizes(spark, n, train):
    df = spark.range(n).withColumnRenamed("id", "pair_id").withColumn("g", F.lit(1))
    out = split.split_random(df, group=["g"])
    assert out.where("split = 'train'").count() == train
    assert out.count() == n


@pytest.mark.parametrize("n,epochs", [(3, 25), (5, 20), (100, 3), (10000, 2), (30000, 1)])
def test_epoch_plan(spark, n, epochs):
    st = spark.range(n).select(F.lit(10).alias("n_tokens"))
    assert validate.epoch_plan(st).first().n_epochs == epochs


def test_token_estimate(spark):
    m = validate.message_token_estimate
    df = spark.createDataFrame([("system", "a b", None), ("user", "c", None)], "role string, content string, name string")
    assert df.select(F.sum(m(F.col("role"), F.col("content"), F.col("name")))).first()[0] + 3 == 14
    df2 = spark.createDataFrame([("system", "a b", None), ("user", "c", "x")], "role string, content string, name string")
    assert df2.select(F.sum(m(F.col("role"), F.col("content"), F.col("name")))).first()[0] + 3 == 16


def test_quantiles(spark):
    df = spark.createDataFrame([(v,) for v in (2, 3, 3, 2, 9)], "x int")
    r = validate.distribution(df, "x").first()
    assert (r.p10, r.median, r.p90) == pytest.approx((2.0, 3.0, 6.6))


def test_mask(spark):
    df = spark.createDataFrame([([5], [7])], "p array<int>, a array<int>")
    r = df.select(*tokens.mask_labels("p", "a")).first()
    assert r.input_ids == [tokens.BOS_ID, 5, 7, tokens.EOS_ID]
    assert r.labels == [-100, -100, 7, tokens.EOS_ID]
    assert r.attention_mask == [1, 1, 1, 1]


def test_pack(spark):
    ex = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5]), (2, [6, 7, 8, 9])], "pair_id long, input_ids array<int>")
    out = tokens.pack_chunks(ex, 4, order=["pair_id"], cols=("input_ids",)).orderBy("chunk").collect()
    assert [r.input_ids for r in out] == [[1, 2, 3, 4], [5, 6, 7, 8]]


def test_pack_exact_multiple_drops_last(spark):
    # the buffer only emits while it holds MORE than L tokens
    ex = spark.createDataFrame([(0, [1, 2, 3, 4]), (1, [5, 6, 7, 8])], "pair_id long, input_ids array<int>")
    out = tokens.pack_chunks(ex, 4, order=["pair_id"], cols=("input_ids",)).collect()
    assert [r.input_ids for r in out] == [[1, 2, 3, 4]]


def _scores(spark, pred, ref):
    df = spark.createDataFrame([(1, pred, ref)], "pair_id long, p string, r string")
    s = metrics.score_all(df, "pair_id", "p", "r").first()
    return s


def test_metrics_cat(spark):
    s = _scores(spark, "the cat sat on the mat", "the cat is on the mat")
    assert s.bleu == 0.0
    assert s.rouge1 == pytest.approx(5 / 6)
    assert s.rouge2 == pytest.approx(3 / 5)
    assert s.rougeL == pytest.approx(5 / 6)
    assert s.meteor == pytest.approx(0.806667, abs=1e-6)


def test_bleu_value(spark):
    s = _scores(spark, "a b c d e", "a b c d f")
    assert s.bleu == pytest.approx(0.668740, abs=1e-6)


def test_empty_prediction_invalid(spark):
    s = _scores(spark, "", "a b")
    assert s.valid is False and s.bleu is None


def test_format_errors(spark):
    lines = ["1", '{"messages":[]}', '{"messages":[{"role":"User","content":""}]}',
             '{"messages":[{"role":"assistant","function_call":"f"}]}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id long, value string")
    got = {r.id: sorted(r.errors) for r in validate.format_errors(df).collect()}
    assert got[0] == ["data_type"]
    assert got[1] == ["missing_messages_list"]
    assert got[2] == sorted(["unrecognized_role", "missing_content", "example_missing_assistant_message"])
    assert got[3] == sorted(["message_missing_key", "missing_content"])


def test_log_parse(spark):
    df = spark.createDataFrame([("first.log", 1, "x Epoch 3: train_perplexity=1.25, train_epoch_loss=0.5, y"),
                                ("first.log", 2, "nothing here")], "file_name string, line_no long, value string")
    out = parse.parse_train_log(df).collect()
    assert [(r.epoch, r.perplexity, r.loss) for r in out] == [(3, 1.25, 0.5)]


def test_generation_prompt_shape(spark):
    from quarry.operators.prompts import generation_prompt
    df = spark.createDataFrame([("TEXT",)], "t string")
    p = df.select(generation_prompt("t").alias("p")).first().p
    assert p == fixed.USER_PROMPT.format(100) + "TEXT" + "\n" + "\n<end_knowledge_text>"
    assert "{{" not in p and "{'role'" in p


def plain_bleu(p, r, max_n=4):
    from collections import Counter
    if not p or not r:
        return None
    logs = 0.0
    for n in range(1, max_n + 1):
        pc = Counter(tuple(p[i:i + n]) for i in range(len(p) - n + 1))
        rc = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
        m = sum(min(v, rc[g]) for g, v in pc.items())
        if m == 0:
            return 0.0
        logs += math.log(m / (len(p) - n + 1))
    return math.exp(logs / max_n) * (1.0 if len(p) > len(r) else math.exp(1 - len(r) / len(p)))


def table_positions(ref, can):
    n, m = len(ref), len(can)
    tab = [[0] * (m + 1) for _ in range(n + 1)]
    for a in range(1, n + 1):
        for b in range(1, m + 1):
            tab[a][b] = tab[a - 1][b - 1] + 1 if ref[a - 1] == can[b - 1] else max(tab[a - 1][b], tab[a][b - 1])
    i, j, out = n, m, []
    while i > 0 and j > 0:
        if ref[i - 1] == can[j - 1]:
            out.append(i - 1)
            i -= 1
            j -= 1
        elif tab[i][j - 1] > tab[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def test_lcs_matches_dp():
    import random
    rnd = random.Random(7)
    for _ in range(50):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                dp[i][j] = dp[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(dp[i - 1][j], dp[i][j - 1])
        assert lcs.lcs_length(a, b) == dp[-1][-1]


def test_bleu_matches_python(spark):
    pairs = [("the quick brown fox jumps", "the quick brown fox leaps"), ("a a a a b", "a a b b a a"),
             ("one two three four five six", "one two three four five six"), ("x", "y z")]
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(pairs)], "pair_id long, p string, r string")
    got = {r.pair_id: r.bleu for r in metrics.bleu_rouge(df, "pair_id", "p", "r").collect()}
    for i, (p, r) in enumerate(pairs):
        exp = plain_bleu(p.split(), r.split())
        assert (got[i] is None and exp is None) or math.isclose(got[i], exp, abs_tol=1e-12)


def test_agent_maps(spark):
    from quarry.operators import agents
    nb = agents.agent_dim(spark, fixed.AGENT_CHAPTER_NUMBERS_NOTEBOOK)
    got = {r.chapter: r.agent for r in nb.collect()}
    assert got["ch00"] == 1 and got["ch29"] == 3 and "ch02" not in got
    pairs = spark.createDataFrame([(1, "ch00"), (2, "ch02"), (3, "ch26")], "pair_id long, chapter string")
    trainer = {r.pair_id: r.agent for r in agents.assign_agents(pairs).collect()}
    assert trainer == {1: None, 2: 1, 3: 2}
    both = agents.assign_agents(pairs, agents.agent_dim(spark, {**fixed.AGENT_CHAPTERS, 4: fixed.ORCHESTRATOR_CHAPTERS}))
    assert both.where("pair_id = 2").count() == 2


def test_library_tokenizers(spark):
    from quarry.functions.text import bleu_13a_tokens, rouge_ascii_tokens
    df = spark.createDataFrame([("Hello, world. It's 3.5-4 km &amp; done!", "Été à Paris, c'est")], "a string, b string")
    r = df.select(bleu_13a_tokens("a").alias("t"), rouge_ascii_tokens("b").alias("u")).first()
    # the apostrophe is outside the 13a punctuation ranges; "-" splits after a digit
    assert r.t == ["Hello", ",", "world", ".", "It's", "3.5", "-", "4", "km", "&", "done", "!"]
    assert r.u == ["t", "paris", "c", "est"]


def test_bleu_library_style_case_sensitive(spark):
    df = spark.createDataFrame([(1, "The cat sat on the mat .", "the cat sat on the mat .")], "pair_id long, p string, r string")
    lib = metrics.bleu_rouge(df, "pair_id", "p", "r", style="library").first()
    uni = metrics.bleu_rouge(df, "pair_id", "p", "r").first()
    assert uni.bleu == pytest.approx(1.0) and lib.bleu < 1.0 and lib.rouge1 == pytest.approx(1.0)


def test_lcs_backtrack_bits_equal_table():
    import random
    rnd = random.Random(11)
    for _ in range(200):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 90))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 90))]
        assert lcs.lcs_positions(a, b) == table_positions(a, b)


def test_rouge_lsum_union(spark):
    # sentence-level union LCS: every reference token is hit, flat LCS is 3 of 4
    df = spark.createDataFrame([(1, "a b\nc d", "a c\nb d"), (2, None, "a"), (3, "a", " \n"), (4, "a a a", "a\na\nb")],
                               "pair_id long, p string, r string")
    rl = {r.pair_id: r.rougeL for r in metrics.rouge_l(df, "pair_id", "p", "r").collect()}
    rls = {r.pair_id: r.rougeLsum for r in metrics.rouge_lsum(df, "pair_id", "p", "r").collect()}
    assert rl[1] == pytest.approx(0.75) and rls[1] == pytest.approx(1.0)
    assert rl[2] == rls[2] == rl[3] == rls[3] == 0.0
    assert rl[4] == rls[4] == pytest.approx(2 / 3)


def test_completion_validity_is_json_not_schema(spark):
    # valid JSON that does not fit the dialog schema still counts as parsed
    df = spark.createDataFrame([('[{"a":1},2,{"b":1}]',), ('[{"role":"user","content":01}]',)], "content string")
    got = [r.parsed for r in parse.parse_completion(df).collect()]
    assert got[0] is not None and len(got[0]) == 1
    assert got[1] is None            # leading zero: not JSON


def test_qa_pairs_tied_turns(spark):
    rows = [(1, 0, "user", "q"), (1, 0, "assistant", "same turn"), (1, 4, "assistant", "a"), (1, 4, "assistant", "b"),
            (1, None, "user", "lost"), (2, 7, "user", "x"), (2, 7, "user", "y"), (2, 9, "assistant", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.input_text, r.target_text) for r in dialogs.qa_pairs(turns).collect())
    assert got == [(1, "q", "a"), (1, "q", "b"), (2, "x", "z"), (2, "y", "z")]
