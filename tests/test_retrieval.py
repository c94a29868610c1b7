import math

from kelpline.operators import evaluation, fusion, indexing, recall

UNITS = "id string, text string, source_status string, quality_score double, scenario_tags array<string>, role_tags array<string>, contraindications array<string>"


def units(spark):
    rows = [
        ("u1", "pain relief pain", "main", 0.9, ["Night pain"], ["nurse"], ["delirium risk"]),
        ("u2", "relief of breath", "candidate", 0.6, ["farewell"], ["family"], []),
        ("u3", "pain", "quarantined", 0.3, ["night"], ["nurse"], ["delirium"]),
    ]
    return spark.createDataFrame(rows, UNITS)


def test_dense_recall_is_exact_with_ties(spark):
    q = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])], "query_id int, rewrite_no int, embedding array<float>")
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 2.0]), ("z", [0.0, 0.0])], "unit_id string, embedding array<float>")
    out = [(r.unit_id, r.score, r.pos) for r in sorted(recall.dense_recall(q, v, 2).collect(), key=lambda r: r.pos)]
    assert out == [("a", 1.0, 1), ("b", 1.0, 2), ("c", 2.0, 3)]


def test_bm25_and_or(spark):
    u = units(spark)
    postings, stats = indexing.text_postings(u), indexing.text_stats(u)
    q = spark.createDataFrame([(1, 0, "Pain relief pain"), (2, 0, "absent")], "query_id int, rewrite_no int, text string")
    both = recall.bm25_recall(q, postings, stats, op="and").collect()
    any_ = recall.bm25_recall(q, postings, stats, op="or").collect()
    assert [r.unit_id for r in both] == ["u1"] and {r.unit_id for r in any_} == {"u1", "u2", "u3"}
    idf, avg = 1e-6, 7 / 3
    assert math.isclose(both[0].score, round(-(2 * idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg)) + idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / avg))), 6))


def test_tags_and_safety(spark):
    q = spark.createDataFrame([("q", ["NIGHT"], ["family"], ["谵妄", "delirium"], ["x"])], "query_id string, scenario_tags array<string>, role_focus array<string>, risk_signals array<string>, contraindication_signals array<string>")
    meta = {r.unit_id: r.score for r in recall.metadata_recall(q, units(spark)).collect()}
    safe = [(r.unit_id, r.boost) for r in recall.safety_recall(q, units(spark)).collect()]
    assert meta == {"u1": 0.5, "u2": 0.4} and safe == [("u1", 0.2)]


def test_fuse_rerank_and_bundle(spark):
    hits = spark.createDataFrame(
        [("q", "u1", "dense", 0, 1, 1.0, 0.0), ("q", "u1", "safety", 3, 1, 1.0, 0.2), ("q", "u3", "safety", 3, 2, 1.0, 0.2), ("q", "gone", "sparse", 1, 1, 0.5, 0.0)],
        "query_id string, unit_id string, route string, route_ord int, pos int, score double, boost double",
    )
    fused = fusion.fuse(hits, units(spark))
    got = {r.unit_id: (r.score, r.source, r.safety_boost) for r in fused.collect()}
    assert got["u1"] == (round(0.2 + 0.09 + 0.0025 + 0.5 + 0.2, 6), "dense", 0.0)
    assert got["gone"] == (round(0.1 + 0.05 + 0.00125, 6), "sparse", 0.0) and got["u3"][2] == 0.2
    replies = spark.createDataFrame([("q", [0.0, 10.0])], "query_id string, scores array<double>")
    assert [r.unit_id for r in sorted(fusion.rerank(fused, replies).collect(), key=lambda r: r.pos)][0] == "u3" or got["u1"][0] > got["u3"][0] + 0.55
    from pyspark.sql import functions as F

    own = units(spark).withColumns({"card_targets": F.array(F.lit("healing")), "unit_type": F.lit("x"), "source_type": F.lit("s"), "title": F.lit("t"), "semantic_tags": F.array(F.lit("a"))})
    bundle = fusion.assemble_bundle(fused, own)
    assert {(r.bucket, r.unit_id) for r in bundle.collect()} == {("supporting", "u1"), ("excluded", "u3"), ("healing", "u1"), ("healing", "u3")}
    queries = spark.createDataFrame(
        [("q", "s", "high", ["u1"], ["a", "b"], [], ["healing"], ["quarantined"]), ("none", "s", "low", ["u1"], [], [], [], [])],
        "query_id string, scenario string, risk_level string, must_include_ids array<string>, expected_tags array<string>, must_include_source_types array<string>, must_include_card_targets array<string>, must_not_include_flags array<string>",
    )
    rows = {r.query_id: r for r in evaluation.evaluate(bundle, queries).collect()}
    assert (rows["q"].n_items, rows["q"].recall_at_10, rows["q"].safety_hit, rows["q"].tag_match, rows["q"].card_target_match) == (3, 1.0, 0.0, 0.5, 1.0)
    assert rows["q"].flag_check == round(1 - 1 / 3, 6) and rows["q"].noise_rate == round(1 / 3, 6)
    assert (rows["none"].recall_at_10, rows["none"].safety_hit, rows["none"].noise_rate, rows["none"].tag_match) == (0.0, 1.0, 0.0, 1.0)


def test_grams(spark):
    rows = spark.createDataFrame([("u", "Ab a")], "id string, text string")
    assert {(r.gram, r.tf) for r in indexing.char_wb_ngrams(rows).collect()} == {(" a", 2), ("ab", 1), ("b ", 1), (" ab", 1), ("ab ", 1), (" ab ", 1), ("a ", 1), (" a ", 1)}
