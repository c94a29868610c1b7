"""Pattern packing, the conversation trie and the tiered search against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from kelpline.llm import pattern_packing, prefix_trie, tiered_search

ODD_DOCS = "doc_id long, text string, length int, _task string, row long"


# --- packing -------------------------------------------------------------------------------------------------------


def odd_documents(spark):
    rng = random.Random(4)
    words = ["the", "pack", "ing", "of", "ünï", "日本", "x1", "##"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 30, 200, 900]))) for _ in range(120)]
    rows = [(i, t, 1, "t", 2) for i, t in enumerate([*texts, "", None, " \n", "word " * 9000, texts[0], texts[0]])]
    return spark.createDataFrame([*rows, (None, "no id", 1, "t", 2), (3, texts[3], 1, "t", 2)], ODD_DOCS).repartition(4)


def test_pattern_packing(spark):
    from tokenizers import Tokenizer

    docs = odd_documents(spark)
    path = pattern_packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    found = pattern_packing.pack(docs, path).collect()
    own, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        own[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert len(r.input_ids) == 4 * r.length
    for doc_id, text in {(r.doc_id, r.text) for r in docs.collect()}:
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(own[doc_id], key=lambda r: r.piece)
        times = 2 if doc_id == 3 else 1
        assert [r.piece for r in pieces[::times]] == list(range(-(-len(want) // 4096))) and len(pieces) == times * -(-len(want) // 4096)
        assert [r.start for r in pieces[::times]] == [4096 * i for i in range(len(pieces) // times)]
        assert np.concatenate([np.frombuffer(bytes(r.input_ids), "<u4") for r in pieces[::times]]).tolist() == want
    for placed in sequences.values():
        placed.sort()
        assert [o for o, _ in placed] == np.cumsum([0, *[n for _, n in placed]])[:-1].tolist() and sum(n for _, n in placed) <= 4096
    assert len(sequences) == -(-sum(r.length for r in found) // 4096)  # as few as can be
    assert pattern_packing.pack(docs.filter("false"), path).count() == 0


def best_fit(lengths, longest):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [(f, i) for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits)[1]] -= n
        else:
            free.append(longest - n)
    return len(free)


def test_layouts_are_whole_and_about_as_tight_as_best_fit():
    rng = random.Random(6)
    for turn in range(40):
        longest = rng.choice([50, 200, 4096])
        counts = {rng.randint(1, longest): rng.randint(1, 40) for _ in range(rng.randint(1, 60))}
        groups, taken = pattern_packing.pattern_groups(counts, longest)
        filled = pattern_packing.fill_holes(groups, counts, taken, longest)
        places = defaultdict(list)
        for n, used, runs in filled:
            assert used == sum(length * m for length, _, m in runs) <= longest
            for length, first, m in runs:
                places[length].append((first, first + n * m))
        for length, n in counts.items():
            cuts = sorted(places[length])
            assert [a for a, _ in cuts] == [0, *[b for _, b in cuts[:-1]]] and cuts[-1][1] == n
        plain = best_fit([length for length, n in counts.items() for _ in range(n)], longest)
        assert sum(g[0] for g in pattern_packing.fill_holes([], counts, {}, longest)) == plain
        assert sum(g[0] for g in filled) <= 1.08 * plain + 2, turn


def test_pattern_counts_fit_a_histogram_of_whole_patterns():
    a = np.array([[1.0, 0, 2], [0, 1, 1], [1, 1, 0]])
    assert np.allclose(pattern_packing.non_negative_least_squares(a, a @ np.array([3.0, 0, 5])), [3, 0, 5])
    assert np.allclose(pattern_packing.non_negative_least_squares(a, np.array([-1.0, -1, -1])), 0)
    found = pattern_packing.patterns(12, 3)
    assert len(found) == len(set(found)) == sum(1 for i in range(13) for j in range(i + 1) for k in range(j + 1) if i + j + k == 12)
    assert all(sum(p) == 12 for p in found)
    # Sequences of one pattern are found again: 1,000 pairs that fill a sequence.
    groups, taken = pattern_packing.pattern_groups({3072: 1000, 1024: 1000}, 4096)
    assert sum(g[0] for g in pattern_packing.fill_holes(groups, {3072: 1000, 1024: 1000}, taken)) == 1000 and groups


# --- trie ----------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, text))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0], t[1], t[2][: prefix_trie.TIE_CHARS], sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()))
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])
        paths[c] = [t[1:] for t in [*base[:h], *turns[h:]]]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
        ends[tuple(paths[c])].append(c)
    kids = Counter(node[:-1] for node in members if node)
    out = set()
    for node, m in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        digest = sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        out.add((m[0], len(node), members[node[:-1]][0] if node else None, len(m), kids[node], sum(1 for n in below if not kids[n]), saved, digest))
    return out


def odd_conversations():
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "no", "", None, "é" * 70 + "a", "é" * 70 + "b"])) for c in [*range(0, 60), *range(100, 130), 317, -5, -105, -100] for t in range(rng.randint(1, 9))]
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (7, 3, "user", "tie"), (7, 3, "system", "tie"), (None, 0, "user", "lost")]
    rows += [(200, t, "user", f"long {t % 3}") for t in range(300)] + [(c, t, "user", "same") for c in range(400, 440) for t in range(3)]
    return rows


@pytest.mark.parametrize("block", [4096, 4])
def test_prefix_trie(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 40)
    rows = odd_conversations()
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame([(*r, 1, 2, "h") for r in rows], "conv_id long, turn long, role string, text string, depth int, k long, row string").repartition(5)
    got = [tuple(r) for r in prefix_trie.trie(table).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)
    if block == 4096:
        assert prefix_trie.trie(table.filter("false")).count() == 0


# --- search --------------------------------------------------------------------------------------------------------


def brute_search(docs, items, k=10):
    terms = lambda text: [t.translate(str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    found = [(i, Counter(t)) for i, t in ((i, terms(text)) for i, text in docs) if t]
    n_docs, n_terms = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = defaultdict(set)
    for item_id, text in items:
        if item_id is not None:
            asked[item_id] |= set(terms(text))
    out = []
    for item_id, own in asked.items():
        scores = []
        for doc_id, c in found:
            m = 10 + 90 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("quotas", "most_terms"), [((2, 8, 30), 1 << 18), ((256, 4096, 65536), 1 << 18), ((2, 8, 30), 3)])
def test_tiered_search(spark, monkeypatch, quotas, most_terms):
    monkeypatch.setattr(tiered_search, "QUOTAS", quotas)
    monkeypatch.setattr(tiered_search, "MOST_TERMS", most_terms)
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.7)) % 200}" for _ in range(4000)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [make(rng.choice([1, 4, 20, 60, 300])) for _ in range(300)]
    texts += [texts[0]] * 15 + [texts[1].upper(), "Ünï-ÜNÏ_x {y} 7", "", None, " \n", "w1 " * 5000, "\x00\x01", "日本w1 w1"]
    docs = [*enumerate(texts), (None, texts[0]), (5, texts[5])]
    items = [(i, make(rng.choice([1, 3, 12]))) for i in range(30)] + [(40, texts[0]), (41, "ünï X y"), (42, ""), (43, None), (44, "nowhere"), (0, "w1 w2"), (None, "w1"), (45, "w1")]
    d = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in docs], "doc_id long, text string, row int, n int, keys string").repartition(3)
    q = spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, key int")
    got = sorted((tuple(r) for r in tiered_search.rank_documents(d, q).collect()), key=str)
    assert got == brute_search(docs, items)
    if most_terms > 3 and quotas[0] == 2:
        assert tiered_search.rank_documents(d.filter("false"), q).count() == 0 and tiered_search.rank_documents(d, q.filter("false")).count() == 0


def test_proven_items_read_no_lower_tier(spark, monkeypatch):
    """Ten documents have an item's rare terms; its common one is left after the first tier, as it can't lift others."""
    monkeypatch.setattr(tiered_search, "QUOTAS", (16, 64, 256))
    texts = ["common " + " ".join(f"rare{k}" for k in range(6)) + f" own{i}" for i in range(12)] + [f"common filler{i % 7} " * (1 + i % 3) for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    items = spark.createDataFrame([(1, "common rare0 rare1 rare2 rare3 rare4 rare5")], "item_id long, text string")
    terms = tiered_search.item_terms(items)
    index = tiered_search.build_index(docs, terms)
    tiers = {r["tier"]: r["count"] for r in index.postings.groupBy("tier").count().collect()}
    assert sum(tiers.values()) == 12 * 7 + 600
    lost = tiered_search.TieredIndex(index.forward, index.postings.filter("tier = 0"), index.terms, index.n_docs, index.n_terms)
    got = sorted((tuple(r) for r in tiered_search.search(lost, terms).collect()), key=str)
    assert got == brute_search(list(enumerate(texts)), [(1, "common rare0 rare1 rare2 rare3 rare4 rare5")]) and len(got) == 10


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    from kelpline.llm.packing import PieceIds

    text = "Some text, with Ünïcödé and 123 numbers.\n\nIt's  spaced"
    for name, by_pieces in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        own = PieceIds(path)
        assert own.by_pieces == by_pieces
        assert np.frombuffer(own.text(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
