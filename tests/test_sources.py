import pytest
from pyspark.sql import functions as F

from basketry.operators import serving
from basketry.sources import documents, files, versions


def test_a_version_is_live_only_once_its_manifest_row_is_written(spark, tmp_path):
    root = str(tmp_path / "w")
    versions.publish(spark, {"a": spark.range(3), "b": spark.range(1)}, root)
    versions.write_tables({"a": spark.range(99)}, f"{root}/versions/half-written")   # a load that died
    assert versions.read_live(spark, root, ["a"])["a"].count() == 3
    versions.publish(spark, {"a": spark.range(5), "b": spark.range(2)}, root)
    live = versions.read_live(spark, root, ["a", "b"])
    assert (live["a"].count(), live["b"].count()) == (5, 2)


def test_parse_once(spark, tmp_path):
    calls = []

    def parse():
        calls.append(1)
        return spark.range(4)

    path = str(tmp_path / "cache")
    assert files.parse_once(spark, path, parse).count() == 4
    assert files.parse_once(spark, path, parse).count() == 4 and len(calls) == 1
    files.parse_once(spark, path, parse, refresh=True)
    assert len(calls) == 2


def label_file(tmp_path, bad=""):
    lines = ['"# HOW TO LABEL, read first"', "# second line", ",".join(files.LABEL_COLUMNS),
             'L01,q,"SELECT 1,\n2",{},a,(none),x,1,0,"multi, line"', "L02,q,s,{},a,(none),x, 0 ,1,"]
    path = tmp_path / "labels.csv"
    path.write_text("\n".join(lines + ([bad] if bad else [])) + "\n")
    return str(path)


def test_of_two_loads_from_one_parent_one_fails(spark, tmp_path):
    root = str(tmp_path / "v")
    first = versions.publish(spark, {"a": spark.range(1)}, root)
    parent = versions.newest(spark, root)
    second = versions.publish(spark, {"a": spark.range(2)}, root, parent)
    with pytest.raises(versions.Conflict):
        versions.publish(spark, {"a": spark.range(3)}, root, parent)
    assert versions.live_version(spark, root) == second and versions.read_live(spark, root, ["a"])["a"].count() == 2
    assert sorted(p.name for p in (tmp_path / "v" / "versions").iterdir()) == [first, second]
    (tmp_path / "v" / "manifest" / "000000000003.json").write_text("")  # a load that died while it wrote its manifest
    assert versions.live_version(spark, root) == second
    pinned = versions.read_version(spark, root, second, ["a"])["a"]
    versions.write_tables({"a": spark.range(9)}, f"{root}/versions/000000000002-died")
    versions.write_tables({"a": spark.range(9)}, f"{root}/versions/000000000009-running")
    for n in (4, 5):
        versions.publish(spark, {"a": spark.range(n)}, root)
    assert set(versions.clean_up(spark, root, keep=2)) == {first, "000000000002-died"}
    assert pinned.count() == 2 and versions.read_live(spark, root, ["a"])["a"].count() == 5
    versions.clean_up(spark, root, keep=0)
    assert [p.name for p in (tmp_path / "v" / "versions").iterdir() if not p.name.endswith("running")] == [versions.live_version(spark, root)]


def test_answer_lines_are_read_in_splits(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, rows array<array<string>>").schema
    (tmp_path / "long.json").write_text("".join(f'{{"id": "q{i}", "rows": [["{i}"]]}}\n' for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        found = files.read_answer_sets(spark, {"a": str(tmp_path / "long.json")}, schema)
        assert found.rdd.getNumPartitions() > 3 and found.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_labels(spark, tmp_path):
    report = str(tmp_path / "bad")
    found = {r.label_id: (r.faithful, r.citation_correct, r.notes) for r in files.checked_labels(files.read_labels(spark, label_file(tmp_path)), report).collect()}
    assert found == {"L01": (1, 0, "multi, line"), "L02": (0, 1, "")}
    many = "\n".join(f"L{i},q,s,{{}},a,(none),x,yes,," for i in range(100, 180))
    with pytest.raises(ValueError, match="160 labels"):
        files.checked_labels(files.read_labels(spark, label_file(tmp_path, many)), report)
    assert spark.read.parquet(report).count() == 160


def test_answer_files_as_arrays_and_lines(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, rows array<array<string>>").schema
    (tmp_path / "a.json").write_text('[\n  {\n    "id": "q1",\n    "rows": [["1"], ["2"]]\n  },\n  {"id": "q2", "rows": []}\n]\n')
    (tmp_path / "b.json").write_text('{"id": "q3", "rows": [["x"]]}\n{"id": "q4", "rows": null}\n')
    both = files.read_answer_sets(spark, {"a": str(tmp_path / "a.json"), "b": str(tmp_path / "b.json")}, schema)
    assert {(r.set, r.id, None if r.rows is None else len(r.rows)) for r in both.collect()} == {("a", "q1", 2), ("a", "q2", 0), ("b", "q3", 1), ("b", "q4", None)}
    (tmp_path / "c.json").write_text('[{"id": "q1", "rows": 7')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_answer_sets(spark, {"c": str(tmp_path / "c.json")}, schema).collect()


def test_documents(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    head = "---\nid: {id}\ntitle: T {id}\ndoc_type: {kind}\nowner: Finance\nlast_updated: 2011-06-20\ndeprecated: {old}\n{more}---\n# Body\n\ntext --- here\n"
    (folder / "a.md").write_text(head.format(id="a", kind="policy", old="false", more=""))
    (folder / "b.md").write_text(head.format(id="b", kind="faq", old="true", more="superseded_by: a\n"))
    (folder / "c.md").write_text(head.format(id="x", kind="poem", old="true", more="superseded_by: nowhere\n"))
    (folder / "d.md").write_text("no header")
    (folder / "README.md").write_text("about this folder")
    quoted = '---\nid: "q"\ntitle: "Sales: by \\"day\\""\ndoc_type: policy # kind\nowner: \'It\'\'s us\'\nlast_updated: 2011-06-20\ndeprecated: false\nsuperseded_by: null\n---\nBody'
    (folder / "q.md").write_text(quoted)
    parsed = documents.parse_front_matter(documents.read_documents(spark, str(folder)))
    rows = {r.file_stem: r for r in parsed.collect()}
    assert rows["b"].deprecated and rows["b"].superseded_by == "a" and str(rows["b"].last_updated) == "2011-06-20"
    assert rows["a"].body == "# Body\n\ntext --- here"
    assert (rows["q"].title, rows["q"].owner, rows["q"].doc_type, rows["q"].superseded_by) == ('Sales: by "day"', "It's us", "policy", None)
    problems = {(r.doc_id, r.problem) for r in documents.invalid_documents(parsed).collect()}
    assert problems == {
        ("x", "id does not match the file name"), ("x", "unknown doc_type"),
        ("x", "deprecated without an existing successor"), ("d", "missing front matter"), ("d", "unknown doc_type"),
    }


def test_replace_partition_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "p")
    files.replace_partition(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, "k")
    for _ in range(2):
        files.replace_partition(spark.createDataFrame([("a", 3)], "k string, v int"), path, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {("a", 3), ("b", 2)}


def test_rendered(spark):
    rows = [(False, None, [["1234.5"]]), (False, None, [["7"]]), (True, None, []), (False, "boom", []), (False, None, []), (False, None, [["1"], ["2"]])]
    df = spark.createDataFrame(rows, "abstained boolean, error string, rows array<array<string>>")
    said = serving.rendered(F.array(F.lit("total_revenue")), F.col("rows"), F.col("abstained"), F.lit("No data."), F.col("error"))
    assert [r[0] for r in df.select(said).collect()] == [
        "total revenue: 1,234.50", "total revenue: 7", "No answer is possible here. No data.",
        "No answer: the query ended in an error.", "The result is empty.", "2 rows, shown in the table."]


def test_similar_texts_in_blocks(spark, monkeypatch):
    known = spark.createDataFrame([(t,) for t in ("total revenue", "total revenues", "net revenue", "zzz")], "text string")
    asked = spark.createDataFrame([("total revenue",)], "text string")
    whole = serving.similar_texts(asked, known).orderBy("rank").collect()
    assert [r.known for r in whole] == ["total revenue", "total revenues", "net revenue"]
    monkeypatch.setattr(serving, "_KNOWN_PER_BLOCK", 2)
    assert serving.similar_texts(asked, known).orderBy("rank").collect() == whole
