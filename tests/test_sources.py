"""Readers and writers on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from strandgraph.sources import files, markdown, records


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl_and_shards(spark, tmp_path):
    put(tmp_path / "a" / "0.jsonl", '{"id": 1, "x": ["a"]}\n\n{"id": 2, "x": null}\n')
    put(tmp_path / "a" / "1.jsonl", '{"id": 3, "x": []}\n')
    df = records.read_records(spark, str(tmp_path / "a"), "id long, x array<string>")
    assert sorted(r["id"] for r in df.collect()) == [1, 2, 3]


def test_bad_line(spark, tmp_path):
    path = put(tmp_path / "b.jsonl", '{"id": 1}\nnot json\n')
    with pytest.raises(Exception):
        records.read_records(spark, path, "id long").collect()
    loose = records.read_records(spark, path, "id long", tolerant=True)
    assert records.count_corrupt(loose).first().asDict() == {"rows": 2, "corrupt": 1}
    assert [r["id"] for r in records.good_records(loose).collect()] == [1]


def test_array_and_map(spark, tmp_path):
    a = put(tmp_path / "a.json", json.dumps([{"id": 1}, {"id": 2}]))
    b = put(tmp_path / "b.json", json.dumps({"data": [{"id": 7}]}))
    m = put(tmp_path / "m.json", json.dumps({"k": ["x"], "l": []}))
    assert [r["id"] for r in records.read_records(spark, a, "id long", layout="array").collect()] == [1, 2]
    assert [r["id"] for r in records.read_records(spark, b, "id long", layout="array", field="data").collect()] == [7]
    assert {r["key"]: r["value"] for r in records.read_records(spark, m, "array<string>", layout="map").collect()} == {"k": ["x"], "l": []}


def test_strings_stay_text(spark, tmp_path):
    path = tmp_path / "m.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write("subject_id,study_id,dicom_id\n007,NA,\n")
    row = records.read_strings(spark, str(path), ["study_id", "subject_id", "dicom_id"]).first()
    assert row.asDict() == {"study_id": "NA", "subject_id": "007", "dicom_id": ""}
    tsv = put(tmp_path / "n.tsv", "a\tb\n1\t\n")
    assert records.read_strings(spark, tsv, sep="\t").first().asDict() == {"a": "1", "b": ""}


def test_report_tree(spark, tmp_path):
    put(tmp_path / "p10" / "p1000" / "s5.txt", "one\ntwo")
    put(tmp_path / "p11" / "p1100" / "s6.txt", "three")
    put(tmp_path / "p11" / "index.txt", "no report")
    got = {(r["patient_id"], r["report_id"]): r["text"] for r in files.read_reports(spark, str(tmp_path)).collect()}
    assert got == {("p1000", "s5"): "one\ntwo", ("p1100", "s6"): "three"}
    assert files.read_reports(spark, str(tmp_path), ["p1100"]).count() == 1
    wanted = spark.createDataFrame([("p1000",)], "patient_id string")
    assert files.read_reports(spark, str(tmp_path), wanted).first()["report_id"] == "s5"
    assert {r[0] for r in files.list_paths(spark, str(tmp_path)).collect()} == {"p10/p1000/s5.txt", "p11/p1100/s6.txt", "p11/index.txt"}


TABLE = """# Title
## Scores
text

| Model | Cond | A | B |
|---|---|---|---|
| **m1** | Base | 1.5 | 2/5 |
|  | Plus | **3.5** | 4/5 |
| m2 | Other | 9 | 9 |
|  | Base | 7 | -8 |
## Next
| m3 | Base | 1 | 1 |
"""


def test_markdown_table(spark, tmp_path):
    path = put(tmp_path / "r.md", TABLE)
    got = markdown.read_markdown_table(markdown.read_lines(spark, path), "## Scores", ["a", "b"], ["Base", "Plus"])
    rows = {(r["model"], r["condition"], r["metric"]): r["value"] for r in got.collect()}
    # The row of m2 has an unwanted condition, so its blank successor still belongs to m1 and replaces its base.
    assert rows == {("m1", "Base", "a"): 7.0, ("m1", "Base", "b"): -8.0, ("m1", "Plus", "a"): 3.5, ("m1", "Plus", "b"): 4.0}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "val", "b", ["t"]), (1, "train", "a", [])], "n int, split string, sentence_id string, triplets array<string>")
    out = str(tmp_path / "sorted")
    records.write_records(df.select("n", "sentence_id"), out, order_by=["n"], single=True)
    part = next((tmp_path / "sorted").glob("part-*"))
    assert [json.loads(x)["n"] for x in part.read_text().splitlines()] == [1, 2]
    records.write_split_outputs(df, str(tmp_path / "split"))
    assert (tmp_path / "split" / "rows" / "split=val").is_dir()
    again = spark.read.json(str(tmp_path / "split" / "triplets_by_id"))
    assert again.where(F.col("split") == "val").first()["triplets"] == ["t"]
    records.write_csv(df.select("n", "split"), str(tmp_path / "csv"), quote_all=True)
    body = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert '"2","val"' in body
    lines = [r["value"] for r in records.as_json_map(spark.createDataFrame([("v1_1", 'a "b"')], "key string, text string")).collect()]
    assert json.loads("{" + lines[0] + "}") == {"v1_1": 'a "b"'}


def test_json_map_with_brackets(spark):
    df = spark.createDataFrame([("a]: b", "t"), ("k", "[x]: y"), ('q"', "")], "key string, text string")
    lines = [r["value"] for r in records.as_json_map(df).collect()]
    assert json.loads("{" + ",".join(lines) + "}") == {"a]: b": "t", "k": "[x]: y", 'q"': ""}
