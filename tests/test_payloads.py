"""Bodies under any spelling, checked writes and stamps."""

from pyspark.sql import functions as F

from studyloom.operators import grounding, payloads, tables


def test_odd_bodies_keep_their_row(spark):
    bodies = ['{"name":" A ","source":"text"}', '{"name":"A","source_text":"","source":"text"}', '{"source":"text"}', "[1]", "not json", None, '{"name":{"a":1},"source_text":5,"structured_sections":{"a":1}}', '{"id":"m","name":"A","source":"t","structured_sections":[1],"structuredSections":[1,2]}']
    df = spark.createDataFrame([(i, b, "x") for i, b in enumerate(bodies)], "n int, body string, problem_before string")
    rows = {r["n"]: r for r in payloads.module_rows(df).withColumn("k", F.size(F.variant_get("structured_sections", "$", "array<variant>"))).collect()}
    assert [rows[i]["problem"] for i in range(8)] == [None, "source_text", "name", "body", "body", "body", None, None]
    assert (rows[0]["name"], rows[0]["source_text"], rows[7]["id"], rows[7]["k"], rows[6]["k"]) == ("A", "text", "m", 1, 0)
    assert rows[6]["name"] == '{"a":1}' and rows[6]["source_text"] == "5" and rows[0]["id"].startswith("module-")
    read = payloads.module_rows(df)
    assert payloads.accepted(read).count() == 3 and payloads.refused(read).count() == 5


def test_a_write_counts_what_it_leaves_out(spark, tmp_path):
    modules = spark.createDataFrame([("m",), ("n",)], "id string")
    rows = [("1", "m", "a", 0, "[]"), ("1", "m", "b", 1, "[]"), ("2", "gone", "a", 1, "[]"), ("3", "m", "c", 9, "[]"), ("4", "n", "d", 1, '"x"'), ("5", "n", "e", None, "[]"), ("6", "n", "f", 2, "[]"), ("7", "n", "g", 2, "[]"), ("8", "n", "g", 2, "[]"), ("9", None, "h", 2, "[]")]
    df = spark.createDataFrame(rows, "id string, module_id string, normalized_stem string, correct_index int, j string")
    df = df.select("id", "module_id", "normalized_stem", "correct_index", *(F.parse_json("j").alias(c) for c in payloads.LISTS))
    counts = payloads.stored(df, modules, str(tmp_path / "bank"), F.lit("2024-01-01").cast("timestamp"))
    assert counts == {"rows": 10, "written": 1, "question key": 2, "module reference": 1, "stem unique in module": 2, "correct_index range": 1, **{f"{c} is a list": 1 for c in payloads.LISTS}, "nothing missing": 2}
    bank = spark.read.parquet(str(tmp_path / "bank"))
    assert [(r["id"], str(r["updated_at"])[:10]) for r in bank.collect()] == [("6", "2024-01-01")]
    assert {r["rule"]: r["n"] for r in payloads.violations(df, modules).collect()} == {k: v for k, v in counts.items() if k not in ("rows", "written")}


def test_changes_are_stamped(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int").withColumn("updated_at", F.lit("2020-01-01").cast("timestamp"))
    got = tables.updated(table, spark.createDataFrame([("b", 5), ("c", 6)], "id string, x int"), stamp=F.lit("2024-01-01").cast("timestamp"))
    assert sorted((r["id"], r["x"], r["updated_at"].year) for r in got.collect()) == [("a", 1, 2020), ("b", 5, 2024)]


def test_extractor_output_against_its_sources(spark):
    texts = spark.createDataFrame([("a", "One two three four."), ("b", "Five six seven eight."), ("c", None)], "id string, text string")
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "request int, source_id string")
    returned = spark.createDataFrame([(1, "a"), (1, "a"), (1, "z"), (1, None), (1, "c")], "request int, source_id string")
    chunks = spark.createDataFrame([(1, "a", "a", 1, ["One  two three", "nine ten eleven"]), (1, "a", "b", 2, []), (1, "z", "z", 3, ["not looked for here"]), (1, "c", None, 4, ["One two three"])], "request int, source_id string, chunk_source_id string, chunk_id int, quotes array<string>")
    got = sorted(map(tuple, grounding.extraction_errors(expected, returned, chunks, texts).collect()), key=repr)
    assert got == sorted([(1, "missing", "b", 1), (1, "twice", "a", 2), (1, "unknown", "z", 1), (1, "unknown", None, 1), (1, "other source", "a", 1), (1, "other source", "c", 1), (1, "not in source", "a", 1), (1, "not in source", "c", 1)], key=repr)
