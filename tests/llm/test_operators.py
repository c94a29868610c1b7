"""Operators against brute force on small tables with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.llm import bitsets, exact_dedup, html_text, language_id, mixing, ngram_join, packing, quality_rules, sharding, site_quality, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, range int, key string, _text string"


def texts():
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("on", "er", "the", "st", "x,", "Y.")]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [make(n) for n in (80, 120, 200, 60, 90)]
    passage = make(60)
    out = [*base, *base, base[0].replace(" ", "\t\n"), base[0].upper(), base[1] + " one more", base[1].replace("aon", "zzz", 1)]
    out += [f"{make(40)} {passage} {make(30)}" for _ in range(6)] + [passage, "", None, " \n", "one", "One", "a b c", "A b\x0bc", "# $ % | " * 30]
    out += [make(9000), "line one is here\n" * 40, "word " * 5, "Ünïcödé ß 日本語 🙂 " * 20, "x" * 20_000]
    out += [base[2] + f" v{i}" for i in range(8)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}" if i % 7 else None, None, i, "k", "t") for i, t in enumerate(texts())]
    rows += [(None, texts()[0], "en", "src0", None, 1, "k", "t"), (3, texts()[3], "en", "src1", None, 1, "k", "t")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def brute_components(rows):
    """The shingle sets and least reachable ids of rows (id, text) by comparing all pairs."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, parent = {}, {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower))
        if i is not None:
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
            parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return sets, {i: find(i) for i in sets}


def test_ngram_join(docs, empty):
    sets, least = brute_components(rows_of(docs))
    got = ngram_join.link_components(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), least[r.doc_id])
        else:
            assert r.component_id == 0
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(least.values()) | {None}
    odd = docs.withColumnsRenamed({"key": "row", "range": "may_go", "_text": "mark"})
    assert ngram_join.drop_near_copies(odd).columns == odd.columns
    assert ngram_join.link_components(empty).count() == 0 and ngram_join.drop_near_copies(empty).count() == 0


def test_ngram_join_of_copies_before_their_least_id(spark, monkeypatch):
    """In a filter of 64 bits all copies collide, and come first in the only task."""
    monkeypatch.setattr(ngram_join, "gather_bits", lambda keys: bitsets.gather_bits(keys, 6))
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(at + i, text(i) + more, "en", "s") for at, more in ((1000, ""), (500, " more"), (0, "")) for i in range(99, -1, -1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    got = {r.doc_id: r.component_id for r in ngram_join.link_components(table).collect()}
    assert got == {at + i: i for at in (0, 500, 1000) for i in range(100)}


def test_sets_ask_for_more_matches_when_longer_prefixes_are_cheap(spark):
    """A set of 100 with tokens at the places 10 to 17 of its prefix, each met by n sets: those of a longer prefix (from 15)
    cost as much (0) or a hundred times more (1)."""
    tokens = np.arange(100, dtype=np.uint64)
    rare = ngram_join.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    assert len(ngram_join.prefix(tokens, rare)[0]) == 25 + ngram_join.MOST_MATCHES
    rows = [(p, 0, i, (100 << 24) + p, 5 if i == 0 or p < 15 else 500) for i in (0, 1) for p in range(10, 18)]
    met = spark.createDataFrame(rows, "token long, part int, id long, facts long, n long")
    assert {(r.id, r.asks) for r in ngram_join._asking(met).collect()} == {(0, ngram_join.MOST_MATCHES), (1, 1)}


def test_ngram_join_of_crowds_that_do_not_link(spark):
    """Variants of one text, each with own words in too many places to link to the text, some of them to each other."""
    rng = random.Random(2)
    base = [f"b{k}" for k in range(150)]
    variants = []
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(150), rng.randint(2, 9)):
            words[k] = f"v{i}x{k}"
        variants.append(words)
    variants += [v[:70] + [f"z{i}"] + v[71:] for i, v in enumerate(variants[:40])]
    texts = [" ".join(v) for v in variants]
    sets = [{tuple(v[k : k + 5]) for k in range(len(v) - 4)} for v in variants]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((label[a], label[b]))
                label = [x if v == y else v for v in label]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.link_components(table).collect()}
    assert got == dict(enumerate(label)) and 10 < len(set(label)) < 150


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    pieces = defaultdict(list)
    found = packing.pack(docs, path).collect()
    for r in found:
        assert r.length == 1 << r.bucket and r.length <= 4096 and r.offset == 0
        pieces[r.doc_id].append(r)
    assert len({r.sequence_id for r in found}) == len(found)
    for i, t in rows_of(docs):
        if i not in (None, 3):
            want = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
            own = sorted(pieces[i], key=lambda r: r.start)
            got = np.concatenate([np.frombuffer(bytes(r.input_ids), "<u4") for r in own]).tolist()
            assert got == want and all(r.doc_tokens == len(want) for r in own)
            assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
    assert packing.pack(empty, path).count() == 0
    assert packing.piece_lengths(9000) == [4096, 4096, 512, 256, 32, 8]


def test_sharding(docs, empty, tmp_path):
    rows = sharding.assign_shards(docs, 4).collect()
    assert len(rows) == docs.count()
    text = dict(rows_of(docs))
    shard_of = defaultdict(set)
    slots, held = defaultdict(list), Counter()
    for r in rows:
        content = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(content) + 1, zlib.crc32(content))
        shard_of[content].add(r.shard)
        slots[r.shard].append(r.slot)
        held[r.shard] += r.size
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(empty).count() == 0
    # Bytes by shard equal those of a packing of single groups.
    sizes = Counter()
    for _, t in rows_of(docs):
        sizes[t] += len(t.encode()) + 1
    packed = sharding.into_fixed_bins(sorted(sizes.values()), [1] * len(sizes), 4)
    want = Counter()
    for size, runs in zip(sorted(sizes.values()), packed, strict=True):
        want[runs[0][0]] += size
    assert max(abs(a - b) for a, b in zip(sorted(held.values()), sorted(want.values()), strict=True)) <= max(want.values()) / 500
    odd = docs.withColumnsRenamed({"key": "size", "range": "shard"})
    sharding.write_shards(odd, str(tmp_path / "shards"), 4)
    back = docs.sparkSession.read.parquet(str(tmp_path / "shards"))
    same = ["doc_id", "text", "lang", "source", "n_chars", "size", "_text"]
    order = lambda rows: sorted(map(repr, rows))
    assert order(back.select(*same).collect()) == order(odd.select(*same).collect())


def test_shards_of_a_whole_table_are_even(spark):
    """All shards of sf0.01 are within a few bytes of each other, as small groups fill what larger ones leave."""
    rows = sharding.assign_shards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    held = [r.n for r in rows]
    assert len(held) == 16 and max(held) - min(held) < sum(held) / 16 / 1000


def test_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(50):
        sizes = sorted({rng.randint(1, 60) for _ in range(rng.randint(1, 30))})
        counts = [rng.randint(1, 5) for _ in sizes]
        runs = sharding.best_fit_decreasing(sizes, counts, 100)
        free: list[int] = []
        for at in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            found = Counter()
            for _ in range(counts[at]):
                fits = [(f, b) for b, f in enumerate(free) if f >= sizes[at]]
                b = min(fits)[1] if fits else len(free)
                if not fits:
                    free.append(100)
                free[b] -= sizes[at]
                found[b] += 1
            assert Counter({b: sum(n for x, n in runs[at] if x == b) for b, _ in runs[at]}) == found
    even = sharding.into_fixed_bins([1, 2], [1600, 800], 16)
    assert {sum(n * size for size, r in zip([1, 2], even) for b, n in r if b == k) for k in range(16)} == {200}
    assert sharding.into_fixed_bins([5, 100], [10, 1], 2) == [[(1, 10)], [(0, 1)]]


def test_site_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, 0 if t and "#" in t else 1) for i, t in enumerate(texts())] + [(None, 1), (5, None), (999, 0)], "doc_id long, quality int")
    odd = docs.withColumnsRenamed({"key": "host", "n_chars": "path", "_text": "fold", "range": "good"})
    rows = site_quality.score(odd, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.kept == (r.score >= site_quality.KEEP) for r in rows)
    assert site_quality.score(empty, labels).count() == 0
    none = site_quality.score(docs, labels.filter("false")).collect()
    assert {round(r.score, 6) for r in none} == {0.5}


def test_site_quality_on_documents_it_has_not_learned_from(spark):
    """Every labelled document is scored without its own fold: nine in ten bad ones go and one in fifty good ones at most."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = {r.doc_id: r.quality for r in labels.collect()}
    rows = site_quality.score(docs, labels).collect()
    kept = {q: [r.kept for r in rows if good.get(r.doc_id) == q] for q in (0, 1)}
    assert np.mean(kept[0]) < 0.12 and np.mean(kept[1]) > 0.98


def test_site_rates_equal_plain_ones(spark):
    """Rates of host and path with a labelled document's own label left out, by loops."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["aa", "bb", "cc"], k=5)), f"s{i % 5}", f"l{i % 2}") for i in range(200)]
    good = {i: int(rng.random() < 0.2 + 0.15 * (i % 5)) for i in range(150)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in site_quality.score(docs, spark.createDataFrame(list(good.items()), "doc_id long, quality int")).collect()}
    prior = (sum(good.values()) + 1) / (len(good) + 2)

    def strength(groups):
        more = sum(n * (g / n - p) ** 2 - p * (1 - p) for n, g, p in groups)
        each = sum(p * (1 - p) * (n - 1) for n, g, p in groups)
        return site_quality.STRONGEST if not each or more <= 0 else min(site_quality.STRONGEST, max(site_quality.WEAKEST, each / more - 1))

    def count(keep):
        own = [good[i] for i in good if keep(i)]
        return len(own), sum(own)

    hosts = {h: count(lambda i, h=h: i % 5 == h) for h in range(5)}
    host_m = strength([(n, g, prior) for n, g in hosts.values()])
    paths = {(h, p): count(lambda i, h=h, p=p: (i % 5, i % 2) == (h, p)) for h in range(5) for p in range(2)}
    path_m = strength([(n, g, (hosts[h][1] + host_m * prior) / (hosts[h][0] + host_m)) for (h, _), (n, g) in paths.items()])
    for i, *_ in rows:
        less = (1, good[i]) if i in good else (0, 0)
        rate = prior
        for m, (n, g) in ((host_m, hosts[i % 5]), (path_m, paths[i % 5, i % 2])):
            rate = (g - less[1] + m * rate) / (n - less[0] + m)
        assert abs(got[i].path_rate - rate) < 1e-9


def test_substring_dedup(docs, empty):
    first, kept = {}, {}
    words = [(i, WORD.findall(t)) for i, t in rows_of(docs)]
    for i, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    got = substring_dedup.remove_repeats(docs).collect()
    assert len(got) == docs.count()
    assert all((r.n_words, r.n_removed, r.kept_text) == kept[r.doc_id] for r in got)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_language_id(spark, docs, empty):
    def held(i):
        return zlib.crc32(str(i).encode()) % 4 == 2

    words = {"xx": ["alpha", "beta", "gamma", "delta"], "yy": ["uno", "dos", "tres", "quatro"]}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(words[w]) for _ in range(40)), w) for i, w in enumerate(["xx", "yy"] * 60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = language_id.train(table.filter(~language_id.held_out()))
    got = {r.doc_id: r for r in language_id.identify(table.drop("lang"), known).collect()}
    assert all(got[i].lang_pred == w and 0 <= got[i].score <= 1 for i, _, w in rows if held(i)) and any(held(i) for i, _, _ in rows)
    odd = {r.doc_id: r.lang_pred for r in language_id.identify(docs, known).collect()}
    for i, t in rows_of(docs):
        assert (odd[i] == "und") == (not any(c.isalpha() for c in t))
    assert language_id.identify(empty, known).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(empty)).collect()} == {"und"}


def test_quality_rules(spark, docs, empty):
    rows = {r.doc_id: r for r in quality_rules.statistics(docs).collect()}
    for i, t in rows_of(docs):
        w = WORD.findall(t)
        n, triples = len(w), Counter(zip(w, w[1:], w[2:]))
        again = {p for k in range(n - 2) if triples[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        r = rows[i]
        assert (r.q_words, r.q_chars, r.q_symbols, r.q_dup_lines, r.q_repeat) == want
        assert r.q_failed == (n < 50 or 100 * len(again) > 50 * n)
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() > 0
    assert quality_rules.filter_documents(empty).count() == 0


def robust_distances(rows):
    """Squared distances of rows (lang, source, weight, *components) by weighted concentration steps, level by level, in
    numpy."""
    v, w = np.array([r[3:] for r in rows], float), np.array([r[2] for r in rows], float)
    lang = [r[0] or "" for r in rows]
    keys = [["" for _ in rows], lang, [(r[0] or "", r[1] or "") for r in rows]]
    above = {1: lambda k: "", 2: lambda k: k[0]}
    members = [{k: np.array([i for i, x in enumerate(level) if x == k]) for k in dict.fromkeys(level)} for level in keys]
    rank = lambda x, q: np.sort(x, axis=0)[int(np.ceil(q * len(x))) - 1]

    def shrunk(raw):
        for level in (1, 2):
            for k in members[level]:
                n = len(members[level][k])
                raw[level][k] = tuple((n * x + quality_rules.SHRINK_ROWS * y) / (n + quality_rules.SHRINK_ROWS) for x, y in zip(raw[level][k], raw[level - 1][above[level](k)], strict=True))
        return raw

    def distances(at, m, c):
        x = v[at] - m
        return w[at] * np.einsum("ij,jk,ik->i", x, np.linalg.inv(c), x)

    raw = [{k: (rank(v[at], 0.5), at) for k, at in level.items()} for level in members]
    raw = [{k: (m, np.diag((1.4826 * rank(np.abs(v[at] - m) * np.sqrt(w[at])[:, None], 0.5)) ** 2)) for k, (m, at) in level.items()} for level in raw]
    now = shrunk(raw)
    dets = lambda: [np.linalg.slogdet(c)[1] for level in now for _, c in level.values()]
    for step in range(1, quality_rules.MOST_STEPS + 1):
        last, raw = dets(), []
        for level, estimates in zip(members, now, strict=True):
            raw.append({})
            for k, at in level.items():
                d = distances(at, *estimates[k])
                near = at[d <= rank(d, quality_rules.COVERED)]
                m = (w[near, None] * v[near]).sum(0) / w[near].sum()
                x = (v[near] - m) * np.sqrt(w[near])[:, None]
                raw[-1][k] = (m, x.T @ x / len(near))
        now = shrunk(raw)
        if max(abs(a - b) for a, b in zip(dets(), last, strict=True)) <= quality_rules.STEADY:
            break
    scale = shrunk([{k: (rank(distances(at, *now[x][k]), 0.5) / quality_rules.MIDDLE,) for k, at in members[x].items()} for x in range(3)])
    out = np.zeros(len(rows))
    for k, at in members[2].items():
        out[at] = distances(at, *now[2][k]) / scale[2][k][0]
    return out


def test_quality_verdicts_of_a_whole_table_equal_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = quality_rules.stash(quality_rules.statistics(docs).drop("text"))
    got = {r.doc_id: r for r in quality_rules.judge(rows, quality_rules.fit(rows)).collect()}
    passing = rows.filter("NOT q_failed").select("doc_id", "lang", "source", "weight", *quality_rules.VECTOR).collect()
    want = robust_distances([tuple(r)[1:] for r in passing])
    assert np.allclose([got[r.doc_id].q_distance for r in passing], want, rtol=1e-6)
    passes = {r.doc_id for r, d in zip(passing, want, strict=True) if d <= quality_rules.TOO_FAR}
    assert {i for i, r in got.items() if r.q_kept} == passes and 20 < len(passing) - len(passes) < 150
    assert 3.5 < np.median(want) < 5.2


def junk_table(spark, groups):
    """Prose in each group (lang, source, rows) with a few link lists and shouted or decorated texts, whose ids are 1000 on."""
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("alo", "erin", "ute", "osta", "imes")]
    prose = lambda: "".join(f"{' '.join(rng.choices(words, k=rng.randint(8, 14))).capitalize()}. " for _ in range(rng.randint(8, 20)))
    junk = [
        " | ".join(rng.choice(words).capitalize() for _ in range(150)),
        " | ".join(" ".join(rng.choices(words, k=2)).capitalize() for _ in range(60)),
        "\n".join(["read more here"] + [" ".join(rng.choices(words, k=4)) + " # % $ & *" for _ in range(40)]),
    ]
    rows = [(i, prose(), *group[:2]) for i, group in enumerate(g for g in groups for _ in range(g[2]))]
    rows += [(1000 + i, t, *groups[-1][:2]) for i, t in enumerate(junk)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


def test_quality_cut_is_a_quantile_and_takes_link_lists(spark):
    assert abs(quality_rules.chi2_quantile(0.999) - 20.515) < 1e-3 and abs(quality_rules.MIDDLE - 4.3515) < 1e-3
    table = junk_table(spark, [("en", "s", 120)])
    kept = {r.doc_id for r in quality_rules.filter_documents(table).collect()}
    assert kept == set(range(120))


def test_quality_takes_moderate_outliers(spark):
    """Menus and texts with many separators, and prose whose words stand apart from other prose in nothing but marks."""
    rng = random.Random(12)
    words = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("alo", "erin", "ute", "osta", "imes")]
    prose = lambda: "".join(f"{' '.join(rng.choices(words, k=rng.randint(8, 14))).capitalize()}. " for _ in range(rng.randint(8, 20)))
    menus = [" | ".join(" ".join(rng.choices(words, k=n)).capitalize() for _ in range(40)) for n in (3, 4, 5)]
    signs = [prose() + " # $ % &" * n for n in (8, 9)]
    rows = [(i, t, "en", "s") for i, t in enumerate([prose() for _ in range(200)] + menus + signs)]
    table = quality_rules.statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3))
    got = {r.doc_id: r for r in quality_rules.judge(table, quality_rules.fit(table)).collect()}
    assert not any(got[i].q_kept for i in range(200, 205))
    assert all(got[i].q_kept for i in range(200))


def test_quality_judges_small_groups(spark):
    """They are drawn to their language, and that to all rows."""
    large, tail = [("en", "s", 120)], [("en", "rare", 5)]
    table = junk_table(spark, large + tail)
    assert {r.doc_id for r in quality_rules.filter_documents(table).collect()} == set(range(125))
    rows = quality_rules.stash(quality_rules.statistics(junk_table(spark, [*large, ("de", "a", 3), (None, None, 2)])))
    assert {tuple(r["group"]) for r in quality_rules.fit(rows).collect()} == {("en", "s"), ("de", "a"), ("", "")}
    got = quality_rules.judge(rows, quality_rules.fit(rows)).collect()
    assert all(r.q_distance is not None and r.q_kept == (r.doc_id < 1000) for r in got)


def test_quality_of_clashing_names_and_repeats(spark, docs):
    odd = docs.withColumnsRenamed({"range": "_row", "key": "weight"}).withColumn("q_kept", F.lit("x")).withColumn("m_v_word", F.lit(1)).withColumn("group", F.lit(2))
    kept = quality_rules.filter_documents(odd.unionByName(odd))
    assert kept.columns == odd.columns
    assert kept.count() == quality_rules.filter_documents(docs.unionByName(docs)).count() > 0


def test_mixing(spark, docs, empty):
    rows = [(i, "w " * (5 + i % 4), "en" if i % 2 else "de", f"src{i % 3}") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixed = mixing.mix(table, budget_share=0.5, max_epochs=1)
    assert mixed.columns[:4] == table.columns
    taken = sum(r.mix_tokens * r.mix_epochs for r in mixed.collect())
    total = sum(5 + i % 4 for i, *_ in rows)
    assert abs(taken - total / 2) <= 8 * 6
    again = mixing.mix(table.repartition(5), budget_share=0.5, max_epochs=1)
    assert {r.doc_id for r in again.filter("mix_epochs > 0").collect()} == {r.doc_id for r in mixed.filter("mix_epochs > 0").collect()}
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(empty).count() == 0
    odd = docs.withColumnsRenamed({"key": "leaf", "range": "row", "n_chars": "cut_key"})
    assert mixing.mix(odd).columns == [*odd.columns, "mix_domain", "mix_tokens", "mix_epochs"]
    ours = {r.doc_id: (r.mix_domain, r.mix_epochs) for r in mixing.mix(docs).collect()}
    assert ours == {r.doc_id: (r.mix_domain, r.mix_epochs) for r in mixing.mix(odd).collect()}
    assert {r.mix_domain for r in mixing.mix(docs, domains={"src0": "a"}).collect()} == {"a", mixing.OTHER}


def test_leaf_budgets_pass_shortages_to_siblings_first(spark):
    leaves = spark.createDataFrame([("head", "en", "a", 10), ("head", "en", "b", 500), ("tail", "en", "c", 500)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, 500, 1, {}).collect()}
    assert got == {"a": 10, "b": 240, "c": 250}


def test_html_text(spark):
    nav = "<div id=x1><a href=/>Home</a> <a href=/b>Shop</a></div>"
    page = lambda i: f"<html><body>{nav}<div><p>Text {i} of <b>page</b><br>two &amp; three</div><script>var a='</p>';</script></body></html>"
    rows = [(i, "http://a.example/x", page(i)) for i in range(8)]
    rows += [(20, None, None), (21, "http://b.example/", "<nav>menu</nav><article><h1>T</h1><p>one<p>t<i>w</i>o<div class='ad box'>buy</div></article><footer>f</footer>"), (22, "x", "plain < text &lt; here"), (None, "http://a.example/y", page(1))]
    rows += [(30, "http://c.example/", "<article>" + "<p>word " * 60_000 + "</article>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "templates": F.lit(2), "text": F.lit(3), "_salt": F.lit(4)})
    for most in (html_text.MOST_BROADCAST, 0):
        got = {r.page_id: r.text for r in html_text.extract(table.unionByName(table.filter("page_id = 3")), most).collect()}
        assert all(got[i] == f"Text {i} of page two & three" for i in range(8))
        assert got[20] == "" and got[21] == "T one two" and got[22] == "plain < text < here" and got[None] == got[1]
        assert got[30] == " ".join(["word"] * 60_000)
    assert html_text.extract(table.unionByName(table.filter("page_id = 3"))).count() == len(rows) + 1
    assert html_text.extract(table.filter("false")).count() == 0


def test_templates_are_cut_inside_articles_and_on_small_hosts(spark):
    """A box in every article of a host and a banner on hosts of one page go; prose that recurs and an article that stands
    twice stay."""
    box, banner = "<div><a href=/join>Join us</a> today</div>", "<section><p>We use biscuits</p></section>"
    big = lambda i: f"<body><article><h1>News</h1><p>Always this line.</p>{box}<p>Story {i}</p></article></body>"
    rows = [(i, "http://big.example/", big(i)) for i in range(10)] + [(10, "http://big.example/", big(9))]
    rows += [(20 + i, f"http://h{i}.example/", f"<body>{banner}<div>Page {i} has more text</div></body>") for i in range(3)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_text.extract(table).collect()}
    assert all(got[i] == f"News Always this line. Story {min(i, 9)}" for i in range(11))
    assert all(got[20 + i] == f"Page {i} has more text" for i in range(3))
    assert html_text.main_text(big(1)) == "News Always this line. Join us today Story 1"  # without the templates


def test_copies_and_names_lose_no_story(spark):
    """Copies and near copies of a page keep its story, menus go all the same; names on what holds the story are names only."""
    nav = "<div><a href=/>Home</a> <a href=/b>Shop</a></div>"
    story = "<div>A story of some length that two pages of this host have in common.</div>"
    rows = [(i, "http://h.example/", f"<body>{nav}{story}<div>Posted {i}</div></body>") for i in range(4)]
    rows += [(10 + i, "http://h.example/", f"<body>{nav}<div>Only once</div></body>") for i in range(4)]
    rows += [(20 + i, f"http://s{i}.example/", f"<body><div>Site {i}</div>{story}</body>") for i in range(4)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i] == f"A story of some length that two pages of this host have in common. Posted {i}" for i in range(4))
    assert all(got[10 + i] == "Only once" for i in range(4))
    assert all(got[20 + i] == f"Site {i} A story of some length that two pages of this host have in common." for i in range(4))
    hello = "<article>hello</article>"
    for html in (f"<body class='has-sidebar'>{hello}", f"<body class=sidebar>{hello}", "<article class='share-price'>hello</article>", f"<div class='main-menu-page'>{hello}</div>", f"<div class=widget>{hello}</div>"):
        assert html_text.main_text(html) == "hello"
    for name in ("ad", "site-footer", "nav_menu", "box ad wide", "comments"):
        assert html_text.main_text(f"<body><div class='{name}'>gone</div><p>this is what stays here</p></body>") == "this is what stays here"


def test_templates_equal_counts_by_host(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url", "html").collect()
    of_host = defaultdict(dict)
    for url, html in rows:
        host = re.match(r"https?://([^/:?#]+)", url)[1]
        for h, rest in html_text.subtree_hashes(html).items():
            of_host[host].setdefault(h, set()).add(rest)
    hosts = Counter(h for c in of_host.values() for h in c if h)
    rests = defaultdict(set)
    for c in of_host.values():
        for h, r in c.items():
            rests[h] |= r
    many = lambda h: hosts[h] >= html_text.LEAST_HOSTS and len(rests[h]) >= html_text.LEAST_HOSTS
    want = {host: {h for h, r in c.items() if h and ((len(r) >= html_text.LEAST_PAGES and len(r) >= html_text.SHARE * len(c[0])) or many(h))} for host, c in of_host.items()}
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(html_text.host_of(F.col("url")).alias("host"), "html")
    got = {r.host: set(r.templates) for r in html_text.templates(table).collect()}
    assert got == {host: found for host, found in want.items() if found}


def test_html_text_is_the_article_of_every_page(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in table.collect()}
    for r in html_text.extract(table).collect():
        article = re.search(r"<article>(.*)</article>", html[r.page_id], re.S)[1]
        text = re.sub(r"</?b>", "", article)
        assert r.text == " ".join(unescape(re.sub(r"<[^>]*>", " ", text)).split())


def test_exact_dedup(docs, empty):
    def norm(t):
        return re.sub(r"[\x20\x09-\x0d]", "", t)

    groups = defaultdict(list)
    for i, t in rows_of(docs):
        groups[norm(t)].append((-len(t), i is None, i or 0, i))
    got = exact_dedup.content_sort(docs).collect()
    assert len(got) == docs.count()
    text = dict(rows_of(docs))
    for r in got:
        group = groups[norm(text[r.doc_id])]
        assert (r.keep_id, r.group_size) == (min(group)[3], len(group))
        assert r.text_sha256 == hashlib.sha256(norm(text[r.doc_id]).encode()).hexdigest()
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.content_sort(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0
    odd = docs.withColumnsRenamed({"key": "row", "n_chars": "sha", "_text": "best"})
    assert exact_dedup.drop_copies(odd).columns == odd.columns


def test_exact_dedup_of_runs_over_many_ranges(spark, monkeypatch):
    """A group of copies with one longest row, cut into many ranges, next to texts of one row."""
    monkeypatch.setattr(exact_dedup, "RANGE_ROWS", 20)
    rows = [(i, "a b c" + " " * (i == 333), "en") for i in range(400)] + [(1000 + i, f"t{i}", "de") for i in range(100)] + [(1000, "t0", "de")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(table).collect()) == [333, *range(1000, 1100)]
    got = {r.doc_id: r for r in exact_dedup.content_sort(table).collect()}
    assert all((got[i].keep_id, got[i].group_size) == (333, 400) for i in range(400)) and got[1000].group_size == 2
    assert sum(r.kept for r in exact_dedup.content_sort(table).collect()) == 101


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r.length == 1 << r.bucket for r in rows)
