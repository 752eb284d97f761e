"""The n-gram model against plain dictionaries of the same counts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from actlake.llm import lm
from actlake.llm.common import read
from actlake.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"
UPPER = {c: c + 32 for c in range(65, 91)}


def tokens_of(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER)), "</end>"]


def is_held_out(doc_id):
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode()) % 10 == 0


class Plain:
    """Interpolated modified Kneser-Ney over dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.words = Counter(t for text in texts for t in tokens_of(text))
        grams = Counter()
        for text in texts:
            padded = ["<begin>"] * (order - 1) + tokens_of(text)
            grams.update(tuple(padded[i : i + order]) for i in range(len(padded) - order + 1))
        self.levels = {}
        for n in range(order, 0, -1):
            of = Counter(grams.values())
            contexts = defaultdict(list)
            for gram, c in grams.items():
                contexts[gram[:-1]].append(c)
            self.levels[n] = grams, contexts, self.discounts([of[i] for i in (1, 2, 3, 4)])
            grams = Counter(gram[1:] for gram in grams)

    @staticmethod
    def discounts(n):
        if 0 in n:
            return [0.5, 1, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return d if all(0 <= x <= i + 1 for i, x in enumerate(d)) else [0.5, 1, 1.5]

    def p(self, word, context):
        n = len(context) + 1
        grams, contexts, d = self.levels[n]
        lower = self.p(word, context[1:]) if n > 1 else 1 / (len(self.words) + 1)
        after = contexts.get(tuple(context))
        if not after:
            return lower
        c = grams.get((*context, word), 0)
        share = (c - d[min(c, 3) - 1]) / sum(after) if c else 0
        return share + sum(d[min(x, 3) - 1] for x in after) / sum(after) * lower

    def scores(self, text):
        tokens = tokens_of(text)
        n, v = sum(self.words.values()), len(self.words)
        padded = ["<begin>"] * (self.order - 1) + tokens
        p = [self.p(t, tuple(padded[i : i + self.order - 1])) if v else 1.0 for i, t in enumerate(tokens)]
        base = sum(math.log10((self.words[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        return len(tokens), sum(self.words[t] > 0 for t in tokens), n, base, sum(map(math.log10, p))


def check(got, table, order):
    model = Plain([t for i, t in table if not is_held_out(i)], order)
    want = sorted((str(i), is_held_out(i), *model.scores(t)) for i, t in table)
    rows = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got.collect())
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)


def zipf_texts(count, seed=1):
    chance = np.random.default_rng(seed)
    return [(int(i), " ".join(f"W{x}" if x % 3 else f"w{x}" for x in chance.zipf(1.4, int(chance.integers(0, 60))) % 400)) for i in range(count)]


def test_query(spark):
    table = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    got = REGISTRY["op12_lm_score"].run(spark, SF)
    kinds = {"held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}
    assert {n: t for n, t in got.dtypes if n in kinds} == kinds
    check(got, table, 2)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_orders(spark, order):
    table = zipf_texts(300)
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(7)
    check(lm.score_corpus(docs, order), table, order)


def test_many_shards_and_hot_contexts(spark, monkeypatch):
    """One context in a third of all n-grams, tables of many shards, words counted in many parts."""
    for name, value in (("SHARD", 64), ("PART_TOKENS", 500), ("SCORED_TOKENS", 300), ("PIECE_BYTES", 2000)):
        monkeypatch.setattr(lm, name, value)
    table = [(i, t + " the" + " the".join(f" x{i % 7}{j}" for j in range(i % 20))) for i, t in zipf_texts(300, 2)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    for order in (2, 3):
        model = lm.fit_model(docs, order)
        # (tasks are forked with these settings, the driver places by the stored bits)
        assert len(model.offsets) > 4 and model.levels[0].shards > 50
        check(lm.score_documents(docs, model), table, order)


def test_probabilities_sum_to_one(spark):
    """After any context, over all words and one unknown one."""
    model = lm.fit_model(spark.createDataFrame(zipf_texts(100, 4), "doc_id long, text string"), 3)
    words = sorted({t for i, text in zipf_texts(100, 4) if not is_held_out(i) for t in tokens_of(text)} - {"</end>"})
    for context in ("", "w1", "w1 w2", "w2 w1", "nothing w1", "w1 nothing"):
        texts = [f"{context} {w}".encode() for w in [*words, "unseen"]] + [context.encode()]
        tokens, bounds = lm.token_hashes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        p, _ = lm.token_probabilities(model, tokens, bounds)
        assert sum(p[bounds[1:-1] - 2]) + p[-1] == pytest.approx(1)


def test_edges(spark, edge_docs, no_docs):
    table = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    for order in (2, 3):
        check(lm.score_corpus(edge_docs, order), table, order)
    got = lm.score_corpus(no_docs)
    assert got.count() == 0 and "score" in got.columns
    held = [(i, "a b") for i in range(200) if is_held_out(i)]
    rows = lm.score_corpus(spark.createDataFrame(held, "doc_id long, text string")).collect()
    assert len(rows) == len(held) and all(r["score"] == 0 and r["train_tokens"] == 0 and r["n_known"] == 0 for r in rows)
    named = spark.createDataFrame([("x", "a b", 1, 2), (None, None, 3, 4), ("y", "", 5, 6)], "doc_id string, text string, h long, shard int")
    check(lm.score_corpus(named), [("x", "a b"), (None, None), ("y", "")], 2)


def test_better_than_words_alone(spark):
    rows = REGISTRY["op12_lm_score"].run(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
