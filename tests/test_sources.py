from pathlib import Path

from kelpline.sources.readers import read_eval_queries, read_jsonl_pages, read_text_docs
from kelpline.streaming.incremental import stream_documents


def test_readers(spark, tmp_path):
    Path(tmp_path, "a.jsonl").write_text('{"text": "one"}\n\n{"content": "two"}\nbroken {\n{"x": 1}\n')
    rows = sorted((r.page_number, r.text) for r in read_jsonl_pages(spark, str(tmp_path)).collect())
    assert rows == [(1, "one"), (3, "two"), (4, "broken {"), (5, '{"x": 1}')]
    assert read_text_docs(spark, str(tmp_path)).first().page_number == 1
    Path(tmp_path, "q.json").write_text('{"query": "a", "expected_tags": ["t"]}\n\n')
    assert read_eval_queries(spark, str(tmp_path / "q.json")).first().expected_tags == ["t"]


def test_stream_skips_known_files(spark, tmp_path):
    source, units, registry, check = (str(tmp_path / n) for n in ("in", "units", "registry", "check"))
    schema = "file_path string, page_number int, text string"
    for turn in range(2):
        spark.createDataFrame([("/a", 1, "same words"), (f"/b{turn}", 1, "more words")], schema).write.mode("append").parquet(source)
        stream_documents(spark, source, schema, units, registry, check).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.option("recursiveFileLookup", "true").parquet(units).collect()) == ["/a", "/b0", "/b1"]


def test_lines_are_numbered_through_the_files_of_a_folder(spark, tmp_path, monkeypatch):
    from kelpline.jobs import core_queries

    for folder in ("a", "b"):
        Path(tmp_path, "in", folder).mkdir(parents=True)
        for n in range(3):
            Path(tmp_path, "in", folder, f"part-{n}.jsonl").write_text("".join(f'{{"text": "{folder}{n}{i}"}}\n\n' for i in range(2 + n)))
    pages = read_jsonl_pages(spark, str(tmp_path / "in" / "*" / "*"), through=True)
    assert "SortMergeJoin" not in pages._jdf.queryExecution().toString()
    want = {f: [f"{f}{n}{i}" for n in range(3) for i in range(2 + n)] for f in ("a", "b")}
    assert sorted((r.text[0], r.page_number, r.text) for r in pages.collect()) == sorted((f, 2 * i + 1, t) for f, all_ in want.items() for i, t in enumerate(all_))
    monkeypatch.setattr(core_queries, "FILE_ROWS", 5)
    spark.range(100).selectExpr("id AS doc_id", "concat('t', id) AS text").write.parquet(str(tmp_path / "documents.parquet"))
    held = {}
    monkeypatch.setattr(core_queries.readers, "read_jsonl_pages", lambda s, path, through: held.update(path=path) or read_jsonl_pages(s, path, through))
    rows = sorted(map(tuple, core_queries.q_jsonl_pages(spark, str(tmp_path)).select("part", "page_number").collect()))
    assert rows == [(part, 2 * n + 1) for part in range(8) for n in range(13 if part < 4 else 12)]
    lines = [r["count"] for r in spark.read.text(held["path"]).selectExpr("_metadata.file_path AS f").groupBy("f").count().collect()]
    assert max(lines) <= 20
