import random

import pytest
from pyspark.sql import functions as F

from kelpline.operators import chunking, cleaning, merging

CJK = "安宁疗护关注症状与陪伴，"


def flags(spark, text, method="text_layer"):
    rows = spark.createDataFrame([(text, method)], "text string, parse_method string")
    row = cleaning.route_status(cleaning.quality_score(cleaning.quality_flags(rows))).first()
    return row.quality_flags, row.quality_score, row.source_status


def test_clean_pages(spark):
    rows = spark.createDataFrame([("a\n 12 \nb 第 3 页 c\n\n\n\nd ",), (None,)], "text string")
    assert [r.text for r in cleaning.clean_pages(rows).collect()] == ["a\n\nb  c\n\nd", None]


def test_quality_flags(spark):
    assert flags(spark, CJK * 4) == ([], 1.0, "main")
    assert flags(spark, CJK * 4, "ocr") == ([], 0.7, "main")
    assert flags(spark, "目录 " + CJK * 3 + "....")[0] == ["table_of_contents"]
    assert flags(spark, "目录 " + CJK * 3)[0] == []
    assert flags(spark, "ISBN 版权 " + CJK * 3) == (["copyright_page"], 0.1, "quarantined")
    assert flags(spark, CJK[:11] + CJK[:8])[0] == ["too_short"]
    assert "possible_ocr_garble" in flags(spark, "" * 10 + CJK)[0]
    assert flags(spark, "plain latin text of enough length")[0] == ["isolated_characters"]
    assert "low_information_density" in flags(spark, "，" * 30 + "安宁疗护关")[0]
    assert flags(spark, None)[0] == ["too_short"]


def test_merge_short(spark):
    rows = spark.createDataFrame([("d", 1, 0, "a" * 200), ("d", 1, 1, "b" * 50), ("d", 2, 0, "c" * 60), ("d", 3, 0, "e" * 10), ("x", 1, 0, "q")], "doc_id string, page_number int, segment_no int, text string")
    out = {(r.doc_id, r.group_no): (r.page_start, r.page_end, r.text) for r in chunking.merge_short(rows).collect()}
    assert out == {("d", 0): (1, 2, "a" * 200 + "\n" + "b" * 50 + "\n" + "c" * 60), ("d", 1): (3, 3, "e" * 10), ("x", 0): (1, 1, "q")}


def _merged(rows, min_chars):
    out, held = {}, {}
    for doc, page, _, text in sorted(rows, key=lambda r: (str(r[0]), *r[1:])):
        groups = out.setdefault(doc, [])
        if groups and held[doc] < min_chars:
            groups[-1] = (groups[-1][0], page, groups[-1][2] + "\n" + text)
            held[doc] += 1 + len(text)
        else:
            groups.append((page, page, text))
            held[doc] = len(text)
    return {(doc, i): g for doc, groups in out.items() for i, g in enumerate(groups)}


@pytest.mark.parametrize("min_chars", [0, 7, 40])
@pytest.mark.parametrize("long", [0, 20, 10**6])
def test_merge_short_equals_a_plain_fold(spark, monkeypatch, long, min_chars):
    monkeypatch.setattr(merging, "RANGE", 64)
    rng = random.Random(3)
    rows = [(d, p, i, "x" * rng.choice([0, 1, 2, 5, 9, 200])) for d in ("a", "b", "c", None) for p in range(rng.randint(1, 5)) for i in range(rng.randint(1, 12))]
    rows += [("one", 1, 0, ""), ("b", 0, 0, "xx"), ("b", 0, 0, "xx")]
    out = chunking.merge_short(spark.createDataFrame(rows, "doc_id string, page_number int, segment_no int, text string"), min_chars, long).collect()
    assert {(r.doc_id, r.group_no): (r.page_start, r.page_end, r.text) for r in out} == _merged(rows, min_chars) and len(out) == len(_merged(rows, min_chars))


def test_merge_short_of_no_rows_and_null_texts(spark):
    schema = "doc_id string, page_number int, segment_no int, text string"
    assert chunking.merge_short(spark.createDataFrame([], schema)).collect() == []
    nulls = spark.createDataFrame([("d", 1, 0, None), ("d", 1, 1, "a")], schema)
    assert [tuple(r) for r in chunking.merge_short(nulls, long=0).collect()] == [("d", 0, 1, 1, "\na")]
    assert [tuple(r) for r in chunking.merge_short(nulls).collect()] == [("d", 0, 1, 1, "\na")]


def test_split_long_glues_a_short_tail(spark):
    text = "a" * 299 + "。" + "b" * 450 + "。" + "c" * 100
    rows = spark.createDataFrame([(1, text), (2, "x" * 900)], "doc_id int, text string")
    out = {(r.doc_id, r.piece_no): r.text for r in chunking.split_long(rows).collect()}
    assert out == {(1, 0): "a" * 299 + "。", (1, 1): "b" * 450 + "。" + "c" * 100, (2, 0): "x" * 900}


def test_overlap_title_and_ids(spark):
    rows = spark.createDataFrame([("d", 0, "a" * 150), ("d", 1, "b")], "doc_id string, chunk_no int, text string")
    out = sorted(chunking.chunk_id(chunking.chunk_title(chunking.add_overlap(rows))).collect(), key=lambda r: r.chunk_no)
    assert out[1].text == "a" * 100 + "\nb" and out[0].title == "a" * 47 + "..." and len({r.id for r in out}) == 2


def test_chunks_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i, p, f"{i} {p} " + "w " * (40 * p)) for i in range(5) for p in range(6)], "doc_id int, page_number int, text string")
    a, b = (sorted(map(tuple, chunking.chunk_documents(rows.repartition(n)).drop("quality_score").collect())) for n in (1, 7))
    assert a == b and a


def test_flag_duplicates(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([("a", 1, words), ("a", 2, words + " x"), ("b", 1, words.upper()), ("b", 2, None)], "doc_id string, page_number int, text string")
    out = {(r.doc_id, r.page_number): r.d for r in cleaning.flag_duplicates(rows).select("doc_id", "page_number", F.to_json("duplicate_of").alias("d")).collect()}
    assert out == {("a", 1): None, ("a", 2): '{"doc_id":"a","page_number":1}', ("b", 1): '{"doc_id":"a","page_number":1}', ("b", 2): None}
