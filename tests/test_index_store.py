"""The written index: pruned reads, generations, batches that are run twice or break off."""

import pytest
from pyspark.sql import functions as F

from kelpline.operators import index_store, indexing, recall
from kelpline.streaming import incremental

WORDS = ["pain", "relief", "breath", "night", "family", "nurse", "calm", "hope"]


def unit_rows(ids, shift=0, status="main"):
    return [(f"u{i}", " ".join(WORDS[(i * k + shift) % 8] for k in range(1, 5 + i % 4)) + f" only{i}", status) for i in ids]


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame(rows, "id string, text string, source_status string")


def content(index):
    posts = sorted((r.id, r.token, r.tf, r.len) for r in index["postings"].collect())
    vectors = sorted((r.id, tuple(r.at), tuple(round(w, 9) for w in r.weight)) for r in index["vectors"].collect())
    stats = index["stats"].first()
    return posts, vectors, (stats.n_units, round(stats.avg_len, 9))


def rebuilt_with(spark, units, path, other):
    """An index of all ``units`` with the vocabulary of the one at ``path``."""
    vocabulary = index_store.open_index(spark, path)["vocabulary"]
    active = index_store.active_units(units)
    n, total = index_store._write(active, vocabulary, f"{other}/g", 16)
    posts = sorted((r.id, r.token, r.tf, r.len) for r in index_store._part(spark, f"{other}/g", "postings").collect())
    vectors = sorted((r.id, tuple(r.at), tuple(round(w, 9) for w in r.weight)) for r in spark.read.parquet(f"{other}/g/vectors").collect())
    return posts, vectors, (n, round(total / n, 9))


def test_batches_twice_and_broken_off_equal_a_rebuild(spark, table, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    first, second = unit_rows(range(20)), unit_rows(range(15, 30), 3) + unit_rows([3], 0, "quarantined")
    index_store.rebuild_index(table(first), path, 16)
    for _ in range(2):
        index = index_store.add_to_index(table(second), path, "b1")
    assert index.generations == 2
    latest = {r[0]: r for r in first} | {r[0]: r for r in second}
    assert content(index) == rebuilt_with(spark, table(list(latest.values())), path, str(tmp_path / "other"))

    def crash(*_):
        raise RuntimeError("lost")

    third = unit_rows(range(28, 40), 5)
    with monkeypatch.context() as m:
        m.setattr(index_store, "_commit", crash)
        with pytest.raises(RuntimeError):
            index_store.add_to_index(table(third), path, "b2")
    assert content(index_store.open_index(spark, path)) == content(index)
    index = index_store.add_to_index(table(third), path, "b2")
    latest |= {r[0]: r for r in third}
    assert index.generations == 3 and content(index) == rebuilt_with(spark, table(list(latest.values())), path, str(tmp_path / "third"))
    again = index_store.rebuild_index(table(list(latest.values())), path, 16)
    assert again.generations == 1 and content(again)[0] == content(index)[0] and content(again)[2] == content(index)[2]
    with pytest.raises(ValueError, match="no index"):
        index_store.open_index(spark, str(tmp_path / "nothing"))


def test_readers_list_only_the_buckets_they_ask_for(spark, table, tmp_path):
    index = index_store.rebuild_index(table(unit_rows(range(40))), str(tmp_path / "index"), 16)
    asked = spark.createDataFrame([("only7",)], "token string")
    near = indexing.in_buckets(index["postings"], asked, 16)
    plan = near._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and {r.id for r in near.filter("token = 'only7'").collect()} == {"u7"}
    assert near.select("bucket").distinct().count() == 1
    q = spark.createDataFrame([(1, 0, "only7 pain"), (2, 0, "only9")], "query_id int, rewrite_no int, text string")
    built = indexing.build_index(table(unit_rows(range(40))))
    for op in ("and", "or"):
        from_disk = recall.bm25_recall(q, index["postings"], index["stats"], op=op).collect()
        assert sorted(from_disk) == sorted(recall.bm25_recall(q, built["postings"], built["stats"], op=op).collect()) and from_disk


def test_ingest_extends_units_and_index_together(spark, tmp_path, monkeypatch):
    units, registry, index = (str(tmp_path / n) for n in ("units", "registry", "index"))
    index_store.rebuild_index(spark.createDataFrame(unit_rows(range(5)), "id string, text string, source_status string"), index, 16)
    pages = lambda names: spark.createDataFrame([(n, 1, f"words of {n}") for n in names], "file_path string, page_number int, text string")
    tokens = lambda: {r.token: r.df for r in indexing.document_frequencies(index_store.open_index(spark, index)["postings"]).collect()}
    for _ in range(2):
        incremental.ingest_batch(pages(["a", "b"]), "c#0", units, registry, index)
    assert tokens()["words"] == 2

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # after the chunks, before the index
        m.setattr(incremental, "add_to_index", crash)
        with pytest.raises(RuntimeError):
            incremental.ingest_batch(pages(["b", "c"]), "c#1", units, registry, index)
    incremental.ingest_batch(pages(["b", "c"]), "c#1", units, registry, index)
    incremental.ingest_batch(pages(["c", "a"]), "c#2", units, registry, index)
    assert tokens()["words"] == 3 and tokens()["c"] == 1
    rows = spark.read.option("recursiveFileLookup", "true").parquet(units).collect()
    assert sorted(r.doc_id for r in rows) == ["a", "b", "c"]
    assert sorted(r.file_path for r in spark.read.option("recursiveFileLookup", "true").parquet(registry).collect()) == ["a", "b", "c"]


def test_blocks_that_cannot_reach_the_best_are_left_out(spark):
    """Same rows as all postings give, of fewer posting rows."""
    import random

    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(5000)]
    units = spark.createDataFrame([(f"u{i}", " ".join(rng.choice(words) for _ in range(rng.choice([5, 20, 80])))) for i in range(3000)], "id string, text string")
    postings, stats = indexing.text_postings(units), indexing.text_stats(units)
    queries = spark.createDataFrame([(i, 0, " ".join(rng.choice(words) for _ in range(8)) + " w1 w2") for i in range(12)] + [(20, 0, "w1"), (21, 0, "nowhere")], "query_id int, rewrite_no int, text string")
    q, known = recall.bm25_weights(queries, postings, stats)
    every = known.join(q, "token").select("query_id", "rewrite_no", "unit_id", (F.col("w") * F.col("times")).alias("gain"))
    few = recall.or_hits(q, known, 5)
    assert few.count() < every.count()

    def best(hits):
        sums = {}
        for r in hits.collect():
            sums[r.query_id, r.unit_id] = sums.get((r.query_id, r.unit_id), 0.0) + r.gain
        ranked = {}
        for (query, unit), s in sums.items():
            ranked.setdefault(query, []).append((-round(s, 6), unit))
        return {query: sorted(rows)[:5] for query, rows in ranked.items()}

    assert best(few) == best(every)
