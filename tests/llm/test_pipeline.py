"""The stages of the pipeline, one after another, against brute force; and no rows."""

import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.llm import mixing, packing, quality_rules
from test_operators import SCHEMA, brute_components, robust_distances, texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.skipif(not os.environ.get("SLOW_TESTS"), reason="takes many minutes; set SLOW_TESTS to run it")
def test_pipeline_stages_equal_brute_force(spark):
    """Each stage on what the one before kept of sf0.001 and of rows with nulls and repeats."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}" if i % 7 else None, None, i, "k", "t") for i, t in enumerate(texts())]
    rows += [(None, texts()[0], "en", "src0", None, 1, "k", "t"), (3, texts()[3], "en", "src1", None, 1, "k", "t")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    first = quality_rules.stash(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000).select(COLUMNS)))
    kept = quality_rules.stash(stages["quality_rules"](spark, first, ""))
    passing = quality_rules.statistics(first).filter("NOT q_failed").select("lang", "source", "weight", *quality_rules.VECTOR, "doc_id", "text").collect()
    far = robust_distances([tuple(r)[:-2] for r in passing])
    own = lambda rows: Counter((r.doc_id, r.text) for r in rows)
    assert own(kept.collect()) == own([r for r, d in zip(passing, far, strict=True) if d <= quality_rules.TOO_FAR])

    exact = quality_rules.stash(stages["exact_dedup"](spark, kept, ""))
    best = {}
    for r in kept.collect():
        key, rank = re.sub(r"[\x20\x09-\x0d]", "", r.text), (-len(r.text), r.doc_id is None, r.doc_id or 0)
        best[key] = min(best.get(key, (rank, r)), (rank, r), key=lambda x: x[0])
    assert own(exact.collect()) == own([r for _, r in best.values()])

    near = quality_rules.stash(stages["ngram_join"](spark, exact, ""))
    left = exact.collect()
    _, least = brute_components([(r.doc_id, r.text) for r in left])
    assert own(near.collect()) == own([r for r in left if r.doc_id is None or least[r.doc_id] == r.doc_id])

    mixed = quality_rules.stash(stages["mixing"](spark, near, ""))
    con = duckdb.connect()
    con.register("documents", near.toPandas())
    epochs = Counter(r[0] for r in con.sql(f"SELECT doc_id FROM ({mixing.SQL})").fetchall())
    assert Counter(r.doc_id for r in mixed.collect()) == epochs and mixed.columns == COLUMNS

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces = stages["packing"](spark, mixed, "").collect()
    want = Counter()
    for r in mixed.collect():
        ids, start = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4"), 0
        for n in packing.piece_lengths(len(ids)):
            want[r.doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
            start += n
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces) == want
    assert len({r.sequence_id for r in pieces}) == len(pieces)


def test_pipeline_of_no_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).select(COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
