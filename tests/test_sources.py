import json

import pytest

from corpuslens.operators.patterns import label_patterns, read_pattern_groups
from corpuslens.sources.conversations import conversation_pairs
from corpuslens.sources.export import export_csv
from corpuslens.sources.normalize import normalize_columns, renames, validate_pairs
from corpuslens.sources.readers import literal_pair, load_pairs, read_json, read_split

ODD = [("a \"quoted\"\nline", "x,y"), ("tab\there", "é ü ñ"), ("plain", "")]


@pytest.mark.parametrize(
    "columns, named, expected",
    [
        (["input", "output"], {}, {"input": "prompt", "output": "response"}),
        (["prompt", "response"], {}, {"prompt": "prompt", "response": "response"}),
        (["instruction", "input", "output"], {}, {"input": "input", "output": "response"}),
        (["instruction", "prompt", "response"], {}, {"prompt": "input", "response": "response"}),
        (["q", "a"], {"input_name": "q", "response_name": "a"}, {"q": "prompt", "a": "response"}),
        (
            ["sys", "q", "a"],
            {"instruction_name": "sys", "input_name": "q", "response_name": "a"},
            {"sys": "instruction", "q": "input", "a": "response"},
        ),
        (["input", "output"], {"input_name": "absent"}, {"input": "prompt", "output": "response"}),
        (["Prompt", "Output"], {}, {}),
        (["response", "output", "prompt"], {}, {"response": "response", "prompt": "prompt"}),
    ],
)
def test_renames(columns, named, expected):
    assert renames(columns, **named) == expected


def test_composed_prompt(spark):
    rows = [("Do", "this", "ok"), (None, "that", "no")]
    df = normalize_columns(spark.createDataFrame(rows, "instruction string, input string, output string"))
    assert [r["prompt"] for r in df.collect()] == ["Do. this", None]
    assert set(df.columns) == {"instruction", "input", "response", "prompt"}


def test_lone_prompt_becomes_input(spark):
    df = spark.createDataFrame([("Do", "this", "ok")], "instruction string, prompt string, response string")
    assert normalize_columns(df).first()["prompt"] == "Do. this"


@pytest.mark.parametrize(
    "schema", ["input string, prompt string, response string", "prompt string, PROMPT string, response string"]
)
def test_ambiguous_names_raise(spark, schema):
    with pytest.raises(ValueError):
        normalize_columns(spark.createDataFrame([("a", "b", "c")], schema))


def test_one_column_in_two_roles_raises():
    with pytest.raises(ValueError):
        renames(["a", "b"], instruction_name="a", input_name="a")


def test_validation(spark):
    with pytest.raises(ValueError, match="response"):
        validate_pairs(spark.createDataFrame([("a",)], "prompt string"))
    with pytest.raises(ValueError, match="string"):
        validate_pairs(spark.createDataFrame([(1, "a")], "prompt bigint, response string"))


@pytest.mark.parametrize("ending, sep", [("csv", ","), ("tsv", "\t")])
def test_delimited_files(spark, tmp_path, ending, sep):
    def cell(v):
        return '"' + v.replace('"', '""') + '"'

    path = tmp_path / f"pairs.{ending}"
    lines = [f"input{sep}output"] + [sep.join(map(cell, row)) for row in ODD]
    path.write_text("\n".join(lines), encoding="utf-8")
    rows = load_pairs(spark, path=str(path)).collect()
    assert [(r["prompt"], r["response"] or "") for r in rows] == ODD


def test_json_files(spark, tmp_path):
    records = [{"input": p, "output": r} for p, r in ODD]
    (tmp_path / "a.json").write_text(json.dumps(records), encoding="utf-8")
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, records)), encoding="utf-8")
    for name in ("a.json", "b.jsonl"):
        rows = load_pairs(spark, path=str(tmp_path / name)).collect()
        assert sorted((r["prompt"], r["response"]) for r in rows) == sorted(ODD)
    schema = "input string, output string"
    assert read_json(spark, str(tmp_path / "a.json"), schema=schema).count() == 3


def test_export_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame(ODD, "prompt string, response string")
    export_csv(label_patterns(pairs), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, multiLine=True, escape='"')
    assert back.columns == ["Prompt", "Response", "Prompt Patterns", "Response Patterns"]
    assert sorted((r["Prompt"], r["Response"] or "") for r in back.collect()) == sorted(ODD)


def test_split_layouts(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train"), ("b", "test")], "prompt string, split string")
    rows.write.partitionBy("split").parquet(str(tmp_path / "hive"))
    for split in ("train", "test"):
        part = rows.where(rows.split == split).select("prompt")
        part.write.parquet(str(tmp_path / "folders" / split))
        part.write.parquet(str(tmp_path / "files" / f"{split}-00000.parquet"))
        part.write.parquet(str(tmp_path / "hub" / "data" / f"{split}-00000.parquet"))
    for layout in ("hive", "folders", "files", "hub"):
        found = read_split(spark, str(tmp_path / layout))
        assert [r["prompt"] for r in found.collect()] == ["a"]
    with pytest.raises(ValueError):
        read_split(spark, str(tmp_path / "nowhere"))


def test_precedence(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prompt": "file", "response": "r"}')
    train = spark.createDataFrame([("split", "r")], "prompt string, response string")
    train.write.parquet(str(tmp_path / "set" / "train"))
    path, split_dir = str(tmp_path / "a.jsonl"), str(tmp_path / "set")

    def first(**sources):
        return load_pairs(spark, **sources).first()["prompt"]

    assert first(literal=("typed", "r"), path=path, split_dir=split_dir) == "typed"
    assert first(literal=("typed", ""), path=path, split_dir=split_dir) == "file"
    assert first(split_dir=split_dir) == "split"
    with pytest.raises(ValueError, match="No dataset provided"):
        load_pairs(spark)
    with pytest.raises(ValueError, match="Unsupported file format"):
        load_pairs(spark, path="pairs.xlsx")


def test_literal_pair(spark):
    assert literal_pair(spark, "p", "r").collect() == [("p", "r")]


def test_conversation_pairs(spark):
    turns = [
        (1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2"),
        (2, 0, "user", "x"), (2, 1, "user", "y"), (2, 2, "assistant", "z"),
    ]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    assert sorted(conversation_pairs(df).collect()) == [(1, 1, "s", "u1", "a1"), (2, 1, None, "y", "z")]


def test_pattern_file(spark, tmp_path):
    groups = [{"expressions": ["a+", "b+"], "name": "one"}, {"name": "two", "expressions": ["c"]}]
    path = tmp_path / "groups.json"
    path.write_text(json.dumps(groups, indent=2))
    assert read_pattern_groups(spark, str(path)) == [("one", "a+"), ("one", "b+"), ("two", "c")]


def test_json_lines_under_the_json_ending_are_all_read(spark, tmp_path):
    rows = [{"prompt": f"p{i}", "response": f"r{i}"} for i in range(5)]
    path = tmp_path / "rows.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    assert load_pairs(spark, path=str(path)).count() == 5
    path = tmp_path / "array.json"
    path.write_text(json.dumps(rows, indent=1))
    assert load_pairs(spark, path=str(path)).count() == 5
