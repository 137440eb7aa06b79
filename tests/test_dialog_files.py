"""Dialog files read in parts equal the whole-file read; bad files are reported."""

import json
import os

import pytest

from quarry.sources import dialog_files, files

GOOD = {
    "ch01/a.json": [[{"role": "user", "content": 'x "q" ] [ \\ ]'}, {"role": "assistant", "content": 'b]\\" ]'}], [{"role": "user", "content": "é]"}], []],
    "ch01/deep/b.json": [],
    "ch02/c.json": [[{"role": "u", "content": str(i) + "]" * (i % 5) + '"[' * (i % 3), "extra": [1, [2, "]"]]}, {"role": "v"}] for i in range(800)],
    "ch02/d.json": [[{"role": "u", "content": "y" * 5000 + "]" + "\\" * 3}]] * 3,
}
BAD = {
    "unclosed": '[[{"role":"u"}]', "unclosed2": '[[{"role":"u"}]\n', "more": '[[{"role":"u"}]] x', "object": '{"a":[]}', "no_comma": '[[{"role":"u"}] [{"role":"v"}]]',
    "trailing": '[[{"role":"u"},]]', "numbers": "[[1,2]]", "end_comma": '[[{"role":"u"}],]', "number": "[1]", "string": '[[{"role":"u","content":"abc]]',
    "closed_twice": '[[{"role":"u"}]]]', "cut": '[[{"role":"u"}', "deeper": '[[{"role":"u"}],[[{"role":"u"}]]]', "comma": '[,[{"role":"u"}]]',
    "mixed": '[[{"role":"u"}],3]', "text": "x", "open": "[", "close": "]", "nothing": "",
}


def messages(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.path.split("/tree/")[1], []).append((r.dialog_idx, r.turn, r.role, r.content))
    return {k: sorted(v) for k, v in got.items()}


def wanted():
    found = {k: [(i, t, m.get("role"), m.get("content")) for i, d in enumerate(v) for t, m in enumerate(d)] for k, v in GOOD.items()}
    return {k: v for k, v in found.items() if v}


@pytest.fixture
def tree(tmp_path):
    for name, value in GOOD.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(value, indent=2 if "c.json" in name else None, ensure_ascii=False) + "\n" * ("a.json" in name), encoding="utf-8")
    return tmp_path / "tree"


@pytest.mark.parametrize("split", ["128m", "1000"])
def test_parts_equal_whole_files(spark, tree, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        parts = dialog_files._records(spark, str(tree), "c.json").select("block").distinct().count()
        assert (parts > 20) == (split == "1000")
        assert messages(files.read_dialog_files(spark, str(tree))) == wanted()
        assert set(messages(files.read_dialog_files(spark, str(tree), chapters=["ch02"]))) == {"ch02/c.json", "ch02/d.json"}
        for name, text in BAD.items():
            (tree / "bad").mkdir(exist_ok=True)
            (tree / "bad" / f"{name}.json").write_text(text)
        found, rejects = dialog_files.scan_dialogs(spark, str(tree))
        assert messages(found) == wanted()
        assert sorted(os.path.basename(r.path)[:-5] for r in rejects.collect()) == sorted(BAD)
        assert messages(files.read_dialog_files(spark, str(tree), on_error="drop")) == wanted()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_bad_file_fails_the_job(spark, tree):
    (tree / "ch01" / "broken.json").write_text('[[{"role": "user"]')
    with pytest.raises(Exception, match="malformed dialog file .*broken.json"):
        files.read_dialog_files(spark, str(tree)).count()
    assert messages(files.read_dialog_files(spark, str(tree), chapters=["ch02"])).keys() == {"ch02/c.json", "ch02/d.json"}
    with pytest.raises(ValueError):
        files.read_dialog_files(spark, str(tree), on_error="ignore")
