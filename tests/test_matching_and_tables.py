"""Containment by grams, tables that are updated in place, numbered lines, duplicate pages and passages."""

import os
import random
from pathlib import Path

from kelpline.operators import chunking, cleaning, evaluation, matching, recall, repository
from kelpline.sources import readers


def test_contained_equals_all_pairs(spark):
    rng = random.Random(2)
    make = lambda low, high: "".join(rng.choice("abé") for _ in range(rng.randint(low, high)))
    needles, hays = [make(0, 5) for _ in range(60)] + [None, "zzz", ""], [make(0, 12) for _ in range(80)] + [None, "abab"]
    found = matching.contained(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(h,) for h in hays], "hay string"))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(n, h) for n in needles for h in hays if n is not None and h is not None and n in h}
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_tag_search_and_manifest_meet_without_loops(spark):
    units = spark.createDataFrame([(f"u{i:03d}", "main" if i % 5 else "quarantined", ["Night pain", f"t{i % 3}"] if i % 2 else None) for i in range(60)], "id string, source_status string, tags array<string>")
    wanted = spark.createDataFrame([("a", "night"), ("b", "T1"), ("b", "PAIN"), ("c", "none"), ("d", ""), ("e", None)], "key string, tag string")
    got = {}
    found = recall.search_by_tags(wanted, units, "tags", 4)
    for r in found.collect():
        got.setdefault(r.key, []).append((r.pos, r.unit_id))
    active = [i for i in range(60) if i % 2 and i % 5]
    first = lambda ids: [(n, f"u{i:03d}") for n, i in enumerate(ids[:4], 1)]
    assert {k: sorted(v) for k, v in got.items()} == {"a": first(active), "b": first(active), "d": first(active)}
    manifest = spark.createDataFrame([(1, "t", None, "guideline", "P0", "x/One Book.pdf"), (2, "t", None, "guideline", "P0", "x\\Long name | note"), (3, "t", None, "guideline", "P0", "nowhere.pdf")], "item_id int, title string, normalized_title string, source_type_for_RAG string, priority string, local_path string")
    files = spark.createDataFrame([("One Book.pdf", "/f/1"), ("A Long name.pdf", "/f/2"), ("B Long name.pdf", "/f/3")], "file_name string, full_path string")
    plan = repository.plan_manifest(manifest, files)
    assert "NestedLoop" not in plan._jdf.queryExecution().toString()
    assert {r.item_id: r.path for r in plan.collect()} == {1: "/f/1", 2: "/f/2", 3: None}


def test_upsert_leaves_other_folders_alone(spark, tmp_path):
    path = str(tmp_path / "units")
    old = spark.createDataFrame([(f"u{i}", "old", 1) for i in range(200)], "id string, title string, updated_at int")
    repository.create_units_table(old, path, 16)
    files = lambda: {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([("u7", "newer", 3), ("u7", "new", 2), ("fresh", "new", 2)], "id string, title string, updated_at int")
    touched = repository.upsert_units_table(new, path, 16)
    names = {f"bucket={b}" for b in touched}
    assert 1 <= len(touched) <= 2 and {f for f in before if os.path.dirname(f) not in names} <= files()
    assert not {f for f in before if os.path.dirname(f) in names} & files()
    rows = {r.id: r.title for r in spark.read.parquet(path).collect()}
    assert rows == {f"u{i}": "old" for i in range(200)} | {"u7": "newer", "fresh": "new"} and spark.read.parquet(path).count() == 201


def test_lines_of_files_of_many_parts_are_numbered_through(spark, tmp_path):
    rng = random.Random(4)
    want = {}
    for name in ("a", "b", "empty"):
        lines = [rng.choice(["", " ", '{"text": "%s"}' % ("x" * rng.randint(0, 60)), "plain é %d" % i, '{"content": "c"}\r']) for i in range(0 if name == "empty" else 700)]
        Path(tmp_path, f"{name}.jsonl").write_bytes("\n".join(lines).encode())
        want[name] = {i: line for i, line in enumerate(lines, 1) if line.strip()}
    held = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        pages = readers.read_jsonl_pages(spark, str(tmp_path))
        assert readers.numbered_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 4
        got = {}
        for r in pages.collect():
            got.setdefault(Path(r.file_path).stem, {})[r.page_number] = r.text
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held[0])
        spark.conf.set("spark.sql.files.openCostInBytes", held[1])
    assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in want.items() if v}
    for name, rows in got.items():
        for number, text in rows.items():
            line = want[name][number].strip()
            assert text == (line if not line.startswith("{") else "c" if "content" in line else line[10:-2])


def test_duplicates_across_ranges_of_one_book(spark, monkeypatch):
    monkeypatch.setattr(cleaning, "PAGE_RANGE", 4)
    words = [f"w{i}" for i in range(40)]
    texts = {1: words, 2: [*words[:-1], "other"], 9: [*words[:-1], "other", "more"], 10: ["alone"], 11: ["ALONE"], 30: words, 31: ["x"]}
    pages = spark.createDataFrame([("book", n, " ".join(t)) for n, t in texts.items()] + [("b2", 1, " ".join(words)), ("b2", 5, None), ("b2", 6, "")], "doc_id string, page_number int, text string")
    got = {(r.doc_id, r.page_number): tuple(r.duplicate_of) if r.duplicate_of else None for r in cleaning.flag_duplicates(pages).collect()}
    assert {k: v for k, v in got.items() if v} == {
        ("book", 2): ("book", 1), ("book", 9): ("book", 2), ("book", 11): ("book", 10), ("book", 1): ("b2", 1), ("book", 30): ("b2", 1), ("b2", 6): ("b2", 5),
    } and len(got) == 10
    assert cleaning.flag_duplicates(pages.filter("false")).count() == 0


def test_passages_in_units(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    units = spark.createDataFrame([("a", f"before {passage} after"), ("b", passage[:20]), ("c", passage.replace(" ", "\n")), ("d", None), ("e", "p1 p2 p3 p4 p5 p6 p7 x")], "id string, text string")
    requests = spark.createDataFrame([(1, passage), (2, "short"), (3, None)], "query_id int, text string")
    for most in (1 << 20, 0):
        assert [tuple(r) for r in evaluation.passages_in_units(requests, units, most_broadcast=most).collect()] == [(1, ["a", "c"])]


def test_prompts_have_risk_and_dyadic_lines(spark):
    rows = spark.createDataFrame([(1, "p", "f", {"b": "2", "a": "1"}, {}), (2, "p", None, None, {"k": "v"})], "query_id int, patient_text string, family_text string, risk_assessment map<string,string>, dyadic_analysis map<string,string>")
    got = {r.query_id: r.prompt for r in recall.analysis_requests(rows).collect()}
    assert got == {1: "Patient: p\nFamily: f\nRisk: a=1, b=2", 2: "Patient: p\nFamily: \nDyadic: k=v"}


def test_units_have_the_least_quality_of_their_pages(spark):
    pages = spark.createDataFrame([("d", 1, "a" * 200, 0.9), ("d", 2, "b" * 200, 0.4), ("d", 3, "c" * 400, 0.7)], "doc_id string, page_number int, text string, quality_score double")
    units = chunking.chunk_documents(pages, quality="page").select("page_start", "page_end", "quality_score").collect()
    assert sorted(map(tuple, units)) == [(1, 2, 0.4), (3, 3, 0.7)]


def test_runs_are_appended(spark, tmp_path):
    path = str(tmp_path / "runs")
    details = spark.createDataFrame([(1, 0.5)], "query_id int, recall_at_10 double")
    for run in ("one", "two"):
        evaluation.append_run(details, path, run)
    assert spark.read.parquet(path).count() == 2
