"""Fingerprints, token counts, packing and sharding against brute force on whole small tables."""

import hashlib
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest

from actlake.llm import fingerprint, langid, packing, sharding, tokencount
from actlake.llm.common import read
from actlake.llm.tokens import encoder, vocabulary_path

SF = "/root/testdata/sf0.001"


def ordered(rows):
    """Descending id, nulls last, ties by text (null first)."""
    return sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"] is not None, (r["text"] or "").encode()))


@pytest.mark.parametrize("which", ["table", "edges"])
def test_fingerprint(spark, edge_docs, which):
    docs = read(spark, SF, "documents") if which == "table" else edge_docs
    rows = ordered(docs.select("doc_id", "text").collect())
    want = defaultdict(list)
    for i, r in enumerate(rows):
        text, following = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        want[r["doc_id"]].append((len(text), hashlib.sha256(edited.encode()).hexdigest(), edited == text, following == text))
    got = defaultdict(list)
    prints = {}
    for r in fingerprint.fingerprint_edits(docs).collect():
        got[r["doc_id"]].append((r["n_chars"], r["edited_sha256"], r["near_edited"] == 1.0, r["near_next"] == 1.0))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (r["near_edited"] == 1.0) == (r["edited_paragraph"] is None)
        prints[r["edited_sha256"]] = r["edited_fingerprint"]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert len(set(prints.values())) == len(prints)


def plain_tree(text):
    """Root, section hashes, paragraph hashes, leaves, without SQL."""
    sha = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    sections = [re.split(r"(?<=\n)", s) for s in re.split(r"(?<=\n)(?=\n)", text)]
    leaves = []
    for i, paragraphs in enumerate(sections):
        leaves.append([])
        for j, p in enumerate(paragraphs):
            fine = p[:48] if i == j == 0 else ""
            found = [fine[k : k + 3] for k in range(0, len(fine), 3)]
            words = re.findall(r"[^ \t\n\x0B\f\r]{1,16}[ \t\n\x0B\f\r]*|[ \t\n\x0B\f\r]+", p[len(fine) :])
            while words:
                n = 1 if words[0][0] in " \t\n\x0b\f\r" else 2
                found.append("".join(words[:n]))
                words = words[n:]
            leaves[-1].append([sha(x) for x in found])
    paragraphs = [[sha("paragraph", *ls) for ls in s] for s in leaves]
    return sha("document", *[sha("section", *s) for s in paragraphs]), [sha("section", *s) for s in paragraphs], paragraphs, leaves


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    equal, rest = 0, ([], [])
    for k, (x, y) in enumerate(((a, b), (b, a))):
        for i, section in enumerate(x[3]):
            for j, leaves in enumerate(section):
                same = x[1][i : i + 1] == y[1][i : i + 1] or i < len(y[2]) and x[2][i][j : j + 1] == y[2][i][j : j + 1]
                if not same:
                    rest[k].extend(leaves)
                elif k == 0:
                    equal += len(leaves)
    total = 2 * equal + len(set(rest[0])) + len(set(rest[1]))
    return min(2.0 * (equal + len(set(rest[0]) & set(rest[1]))) / max(total, 1), 1 - 1 / (total + 1))


@pytest.mark.parametrize("which", ["table", "edges"])
def test_fingerprint_is_the_tree(spark, edge_docs, which):
    docs = read(spark, SF, "documents") if which == "table" else edge_docs
    rows = ordered(docs.select("doc_id", "text").collect())
    want = []
    for i, r in enumerate(rows):
        text, following = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        cut = len(text) // 3
        own, edited, other = plain_tree(text), plain_tree(text[: len(text) - cut] + following[:cut]), plain_tree(following)
        want.append((str(r["doc_id"]), own[0], edited[0], round(plain_likeness(own, edited), 12), round(plain_likeness(own, other), 12)))
    names = ("fingerprint", "edited_fingerprint")
    got = fingerprint.fingerprint_edits(docs).collect()
    assert sorted((str(r["doc_id"]), *(r[n] for n in names), round(r["near_edited"], 12), round(r["near_next"], 12)) for r in got) == sorted(want)
    if which == "table":
        assert all(r["near_edited"] > r["near_next"] for r in got if r["near_next"] < 1)


def test_likeness_of_short_and_moved_texts(spark):
    rows = [(1, "a short text", "a short tune"), (2, "a short text", "something else"), (3, "x y\n\n" + "word " * 9, "new\n\nx y\n\n" + "word " * 9), (4, "", "a"), (5, "ab", "ab")]
    df = spark.createDataFrame(rows, "id int, text string, other string")
    df = fingerprint.likeness(fingerprint.with_tree(fingerprint.with_tree(df), "other", "second"), "tree", "second", "near")
    near = {r["id"]: r["near"] for r in df.collect()}
    assert near[1] >= 0.5 > near[2] and near[3] > 0.3 and near[4] == 0 and near[5] == 1


def test_fingerprint_finds_the_edited_paragraph(spark, no_docs):
    rows = [(1, "a\nb\n\nc\nd\ne"), (2, "a\nb\n\nc\nX\ne"), (3, "a\nb\n\nc\nd\ne")]
    trees = fingerprint.with_tree(spark.createDataFrame(rows, "doc_id long, text string"))
    a, b = trees.filter("doc_id = 1").select("tree"), trees.filter("doc_id <> 1").select("doc_id", trees["tree"].alias("other"))
    both = b.join(a)
    section, paragraph = fingerprint.first_difference(both["tree"], both["other"])
    found = {r[0]: (r[1], r[2]) for r in both.select("doc_id", section, paragraph).collect()}
    assert found == {2: (1, 2), 3: (None, None)}
    assert fingerprint.fingerprint_edits(no_docs).count() == 0


def library(text):
    return encoder(vocabulary_path()).exact.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("which", ["table", "edges"])
def test_token_counts(spark, edge_docs, which):
    docs = read(spark, SF, "documents") if which == "table" else edge_docs
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(library(r["text"]))) for r in docs.collect())
    got = tokencount.count_tokens(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)


def test_every_prefix(spark, no_docs):
    text = "Hello  wörld, it's 12345 <|endoftext|>x\n\n  it'll  do\tunbelievableness 日本"
    table = tokencount.counter(vocabulary_path()).table(text)
    sizes = [len(library(text[:i])) for i in range(len(text) + 1)]
    assert [table.count(i) for i in range(len(text) + 1)] == sizes
    for budget in range(table.tokens + 2):
        kept = table.truncate(budget)
        assert kept == max(i for i, n in enumerate(sizes) if n <= budget)
    assert tokencount.count_tokens(no_docs).count() == 0
    kept = tokencount.truncate_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), 5).collect()[0]["kept"]
    assert kept == table.truncate(5)
    stored = tokencount.prefix_tables(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert stored["counts"] == sizes


def test_stored_counts_of_random_texts():
    """Every prefix as the library encodes it alone: runs of blanks, contractions, signs, special strings, other alphabets."""
    chance = np.random.default_rng(12)
    parts = [" ", "  ", "\n", "\t ", "'", "'s", "'re", "'ll", "it", "hello", "12", "12345", "!", "?!", "é", "日本", "😀", "\u00a0", "<|endoftext|>", "<|", "antidisestablishment", "Ω", "a", "A"]
    c = tokencount.counter(vocabulary_path())
    for _ in range(250):
        text = "".join(chance.choice(parts, int(chance.integers(0, 12))))
        assert c.table(text).at.tolist() == [len(library(text[:i])) for i in range(len(text) + 1)], repr(text)


def test_one_long_pre_token_is_counted_once():
    table = tokencount.counter(vocabulary_path()).table("x" * 20_000)
    assert table.tokens == len(library("x" * 20_000)) and table.count(table.truncate(100)) <= 100 < table.count(table.truncate(100) + 1) + 1


def test_latin_pattern_splits_alike():
    c = tokencount.counter(vocabulary_path())
    chance = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(map(chr, chance.choice([*range(256), 32, 39, 115, 116, 10], 12)))
        assert c.split_latin(text) == c.split_any(text), repr(text)
        assert encoder(vocabulary_path()).ids(text).tolist() == library(text)


@pytest.mark.parametrize("which", ["table", "edges"])
def test_packing(spark, edge_docs, which):
    docs = read(spark, SF, "documents") if which == "table" else edge_docs
    want = defaultdict(list)
    for r in docs.collect():
        want[r["doc_id"]].append([*library(r["text"]), 1])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for key, parts in pieces.items():
        assert sum(p["length"] for p in parts) == sum(map(len, want[key]))
        texts = want[key]
        for p in parts:
            crc = [zlib.crc32(np.array(t[p["start"] : p["start"] + p["length"]], dtype="<u4").tobytes()) for t in texts if len(t) == p["doc_tokens"]]
            assert p["ids_crc32"] in crc
        if len(texts) == 1:
            assert [p["start"] for p in sorted(parts, key=lambda p: p["start"])] == np.cumsum([0, *(p["length"] for p in sorted(parts, key=lambda p: p["start"]))])[:-1].tolist()
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist()
        total = sum(n for _, n in parts)
        assert total <= 2048 and total & (total - 1) == 0  # nothing is padded


def test_packing_takes_neighbours(spark, no_docs):
    near = np.arange(100, 400, dtype=np.uint32)
    far = np.arange(5000, 5300, dtype=np.uint32)
    shard = [near, far, far + 1000, near[:250].copy(), near[50:].copy()]
    first = next(packing.pack_shard(shard, 512))
    assert [d for d, _, _ in first][0] == 0 and first[1][0] in (3, 4)
    assert packing.pack(no_docs).count() == 0


def best_capacity(sizes, shards):
    def fits(c):
        used, held = 1, 0
        for s in sizes:
            if held + s > c:
                used, held = used + 1, 0
            held += s
        return used <= shards

    c = max(sizes)
    while not fits(c):
        c += 1
    return c


def test_minimax_cuts():
    chance = np.random.default_rng(5)
    for _ in range(60):
        sizes = chance.integers(1, 40, chance.integers(1, 30))
        shards = int(chance.integers(1, 9))
        capacity, cuts = sharding.minimax_cuts(sizes, shards)
        assert capacity == best_capacity(sizes.tolist(), shards) and len(cuts) < shards
        assert max(part.sum() for part in np.split(sizes, cuts)) <= capacity
    assert sharding.minimax_cuts(np.array([]), 4) == (0, pytest.approx(np.array([])))


@pytest.mark.parametrize("which", ["table", "edges"])
def test_shards(spark, edge_docs, no_docs, which):
    docs, shards = (read(spark, SF, "documents"), 40) if which == "table" else (edge_docs, 4)
    got = sharding.shard_documents(docs, shards).collect()
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    slots, of_text, held = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        of_text[r["text_crc32"]].add(r["shard"])
        held[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    assert all(len(s) == 1 for s in of_text.values())
    groups = defaultdict(int)
    for r in got:
        groups[r["text_crc32"]] += r["size"]
    assert max(held.values()) <= sum(held.values()) / shards + max(groups.values())
    assert sharding.shard_documents(no_docs).count() == 0


def test_a_large_group_leaves_the_other_shards_balanced(spark):
    chance = np.random.default_rng(8)
    for _ in range(60):
        sizes = chance.integers(1, 40, chance.integers(1, 30))
        sizes[chance.integers(0, len(sizes))] += chance.choice([0, 500])
        shards = int(chance.integers(1, 9))
        capacity, cuts = sharding.minimax_cuts(sizes, shards)
        parts = np.split(sizes, cuts)
        assert capacity == best_capacity(sizes.tolist(), shards) == max(p.sum() for p in parts)
        assert len(parts) == min(shards, len(sizes)) and all(len(p) for p in parts)
    sizes = np.full(2000, 10)
    sizes[700] = 10_000  # a third of all
    held = sorted(int(p.sum()) for p in np.split(sizes, sharding.minimax_cuts(sizes, 40)[1]))
    assert len(held) == 40 and held[-1] == 10_000 and held[-2] <= 530 and held[0] >= 100
    rows = [(i, "hot " * 50 if i % 3 == 0 else f"text {i} " + "x" * 190) for i in range(3000)]
    held = defaultdict(int)
    for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect():
        held[r["shard"]] += r["size"]
    assert set(held) == set(range(40)) and sorted(held.values())[-2] < 1.1 * sum(sorted(held.values())[:-1]) / 39


def test_neighbours_are_those_of_plain_bm25():
    """Scores over all terms of the seed, counted without an index."""
    chance = np.random.default_rng(5)
    documents = [chance.choice(400, int(chance.integers(1, 120)), p=np.arange(400, 0, -1) / 80_200).astype("<u4") for _ in range(60)]
    documents += [documents[7], np.array([9_000, 9_001], "<u4"), np.array([9_001], "<u4")]
    index = packing.Bm25(documents)
    counts = [defaultdict(int) for _ in documents]
    for held, d in zip(counts, documents, strict=True):
        for t in d.tolist():
            held[t] += 1
    mean = sum(map(len, documents)) / len(documents)

    def score(seed, other):
        total = 0.0
        for t in counts[seed]:
            df, tf = sum(t in c for c in counts), counts[other].get(t, 0)
            total += np.log1p((len(documents) - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(documents[other]) / mean))
        return total

    unused = np.ones(len(documents), dtype=bool)
    unused[3] = False
    for seed in range(len(documents)):
        want = {d: score(seed, d) for d in range(len(documents)) if d not in (3, seed) and set(counts[d]) & set(counts[seed])}
        got = index.neighbours(seed, unused).tolist()
        assert set(got) == set(want)
        scores = [want[d] for d in got]
        assert all(a > b - 1e-4 for a, b in zip(scores, scores[1:]))
    assert index.neighbours(len(documents) - 1, unused).tolist() == [len(documents) - 2]


def test_languages_are_fitted_in_one_copy_of_the_vectors():
    rows = np.random.default_rng(3).random((800, langid.DIMENSIONS), dtype=np.float32)
    tracemalloc.start()
    langid.fit_vectors(rows, [str(i % 4) for i in range(len(rows))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < rows.nbytes
