"""Recall and index steps whose work is to grow with the units only: sums by blocks, routes without a shuffle, grams by batches."""

import random

from pyspark.sql import functions as F

from kelpline.operators import index_store, indexing, recall, retrieval

ODD = ["Ab  a\tab", "", None, "x\x00y \x00", "😀a😀 İstanbul ß", "a" * 50, "no-break space é", "ab ab ab"]


def texts(spark, n=300, seed=5):
    rng = random.Random(seed)
    words = ["the", "pain", "relief", "night", *[f"w{i}" for i in range(60)]]
    return spark.createDataFrame([(f"u{i:04d}", " ".join(rng.choice(words[: rng.choice([4, 64])]) for _ in range(rng.choice([3, 12, 40])))) for i in range(n)], "id string, text string")


def test_sums_of_blocks_are_all_that_is_shuffled(spark, monkeypatch):
    units = texts(spark).unionByName(spark.createDataFrame([("u0001", "the pain w1 w2 w3"), ("u0001", "the the w1")], "id string, text string"))
    postings, stats = indexing.text_postings(units), indexing.text_stats(units)
    queries = spark.createDataFrame([(i, i % 2, f"the pain the w{i} w{i + 7} night") for i in range(9)] + [(9, 0, "the"), (9, 1, "nowhere"), (None, 0, "the w1")], "query_id int, rewrite_no int, text string")
    for name, value in {"UNIT_BLOCK": 70, "QUERY_BLOCK": 4, "SUMS": 50, "MOST_GAINS": 40}.items():
        monkeypatch.setattr(recall, name, value)
    q, known = recall.bm25_weights(queries, postings, stats)
    every = known.join(q, "token").groupBy("query_id", "rewrite_no", "unit_id").agg(F.sum(F.col("w") * F.col("times")).alias("s")).collect()
    want = {}
    for r in every:
        want.setdefault((r.query_id, r.rewrite_no), []).append((-round(r.s, 6), r.unit_id))
    hits, blocks = recall.or_hits(q, known, 3).collect(), q.first().blocks
    got = {}
    for r in hits:
        got.setdefault((r.query_id, r.rewrite_no), []).append((-round(r.gain, 6), r.unit_id))
    assert blocks == 5 and {k: sorted(v)[:3] for k, v in got.items()} == {k: sorted(v)[:3] for k, v in want.items()}
    assert len(hits) < len(every) / 2


def test_few_queries_meet_vectors_where_these_are(spark, monkeypatch):
    units = texts(spark)
    vocabulary, vectors = indexing.gram_index(units)
    rewrites = units.limit(5).select(F.substring("id", 2, 4).cast("int").alias("query_id"), F.lit(0).alias("rewrite_no"), "text")
    ask = lambda: retrieval.gram_recall(rewrites, {"vocabulary": vocabulary, "vectors": vectors}, 7)
    few = ask()
    assert "CoGroups" not in few._jdf.queryExecution().toString()
    monkeypatch.setattr(recall, "QUERY_BLOCK", 2)
    monkeypatch.setattr(recall, "ROW_BLOCK", 50)
    many = ask()
    assert "CoGroups" in many._jdf.queryExecution().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() == 35


def test_gram_tables_equal_all_grams(spark, monkeypatch):
    monkeypatch.setattr(indexing, "CELLS", 64)
    units = spark.createDataFrame([(f"o{i}", t) for i, t in enumerate(ODD)], "id string, text string").unionByName(texts(spark, 40))
    every = indexing.char_wb_ngrams(units).collect()
    totals, df = {}, {}
    for r in every:
        totals[r.gram] = totals.get(r.gram, 0) + r.tf
        df[r.gram] = df.get(r.gram, 0) + 1
    best = sorted(totals, key=lambda g: (-totals[g], g.encode()))[:200]
    vocabulary, vectors = indexing.gram_index(units, 200)
    assert {r.gram: (r.total, r.df) for r in vocabulary.collect()} == {g: (totals[g], df[g]) for g in best}
    names = sorted(best)
    idf = {r.gram: r.idf for r in vocabulary.collect()}
    raw = {}
    for r in every:
        if r.gram in idf:
            raw.setdefault(r.id, {})[r.gram] = r.tf * idf[r.gram]
    got = {r.id: {names[a]: w for a, w in zip(r.at, r.weight, strict=True)} for r in vectors.collect()}
    assert got.keys() == raw.keys()
    for key, own in raw.items():
        norm = sum(w * w for w in own.values()) ** 0.5
        assert own.keys() == got[key].keys() and all(abs(w / norm - got[key][g]) < 1e-9 for g, w in own.items())
    alone = {r.id: (r.at, [round(w, 9) for w in r.weight]) for r in indexing.gram_vectors(units, vocabulary).collect()}
    assert alone == {r.id: (r.at, [round(w, 9) for w in r.weight]) for r in vectors.collect()}
    assert "Exchange" not in vectors._jdf.queryExecution().toString()


def test_postings_of_ids_that_are_there_once_are_not_shuffled(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(indexing, "CELLS", 20)
    rows = indexing.unit_tokens(texts(spark, 60).unionByName(spark.createDataFrame([("none", None), ("empty", " ")], "id string, text string")))
    own = indexing.count_own_tokens(rows)
    assert "Exchange" not in own._jdf.queryExecution().toString()
    columns = ["id", "token", "len", "tf"]
    assert sorted(map(tuple, own.select(columns).collect())) == sorted(map(tuple, indexing.count_tokens(rows).select(columns).collect()))
    twice = spark.createDataFrame([("a", "x y", "main"), ("a", "x x", "main"), ("b", "x", "main")], "id string, text string, source_status string")
    posts = index_store.rebuild_index(twice, str(tmp_path / "index"))["postings"].collect()
    assert sorted((r.id, r.token, r.tf) for r in posts) == [("a", "x", 3), ("a", "y", 1), ("b", "x", 1)]


def test_texts_of_units_that_no_hit_names_end_where_they_are_read(spark):
    units = texts(spark).withColumns({"quality_score": F.lit(0.5), "source_status": F.lit("main")})
    hits = spark.createDataFrame([(1, "u0003", "sparse", 1, 1, 1.0, 0.0), (1, "gone", "sparse", 1, 2, 0.5, 0.0)], "query_id int, unit_id string, route string, route_ord int, pos int, score double, boost double")
    from kelpline.operators import fusion, matching

    for most in (1 << 20, 0):
        assert [r.id for r in matching.named_units(units, hits, most).collect()] == ["u0003"]
    assert "BroadcastHashJoin" in matching.named_units(units, hits)._jdf.queryExecution().toString()
    fused = fusion.fuse(hits, units)
    assert {(r.unit_id, r.pos) for r in fused.collect()} == {("u0003", 1), ("gone", 2)}
    asked = fusion.rerank_requests(fused, units, spark.createDataFrame([(1, "q")], "query_id int, text string"))
    assert asked.first().passages == [units.filter("id = 'u0003'").first().text, ""]


def test_index_for_requests_holds_their_postings_only(spark, monkeypatch):
    monkeypatch.setattr(indexing, "PART", 300)
    monkeypatch.setattr(indexing, "WORDS_ROW", 5)
    odd = [*ODD, "pain,relief-x²Ⅳ _pain_ ٣٤ Σας ΟΔΟΣ", " \t\x1cpain\x0b "]
    rows = spark.createDataFrame([(f"o{i}", t) for i, t in enumerate(odd)], "id string, text string").unionByName(texts(spark, 60))
    units = rows.withColumns({"title": F.substring("text", 1, 9), "summary": F.lit("pain w3"), "source_status": F.lit("main")})
    asked = spark.createDataFrame([("Pain RELIEF nowhere x²Ⅳ σας",), ("w1 ٣٤",), (None,)], "text string")
    every, few = indexing.build_index(units), indexing.asked_index(units, asked)
    columns = ["id", "token", "len", "tf"]
    names = ["pain", "relief", "x²ⅳ", "σας", "w1", "٣٤"]
    got = sorted(map(tuple, few["postings"].select(columns).collect()))
    assert got == sorted(map(tuple, every["postings"].filter(F.col("token").isin(names)).select(columns).collect()))
    assert {r[1] for r in got} == set(names)
    whole = indexing.asked_index(units, asked, most_tokens=0)["postings"]
    assert sorted(map(tuple, whole.select(columns).collect())) == sorted(map(tuple, every["postings"].select(columns).collect()))
    assert few["stats"].first() == every["stats"].first()
    for name in ("vocabulary", "vectors"):
        assert sorted(map(str, few[name].collect())) == sorted(map(str, every[name].collect()))


def test_runs_of_words_that_no_request_has_end_where_they_are_read(spark):
    import numpy as np

    from kelpline.operators import evaluation

    units = spark.createDataFrame([("a", "x a b  c\td e y"), ("b", "a b c"), ("c", "d e"), ("d", None), ("e", "a b c a b c")], "id string, text string")
    runs = evaluation._runs(spark.createDataFrame([(1, "a b c d")], "query_id int, text string"), "query_id", 3)
    asked = np.sort(runs.toArrow()["run"].to_numpy().view(np.uint64))
    near = evaluation._runs(units, "id", 3, asked)
    assert len(asked) == 2 and sorted(r.id for r in near.collect()) == ["a", "a", "b", "e"]
    assert evaluation._runs(units, "id", 3).count() == 5 + 1 + 3
    assert evaluation._runs(units, "id", 3, asked[:0]).count() == 0
