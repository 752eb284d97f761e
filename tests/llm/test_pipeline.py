"""The pipeline against what its stages must give, and the columns it keeps."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
from actlake.llm import jaccard, langid, mixing, quality
from actlake.llm.common import read

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = read(spark, SF, "documents")
    names, at = docs.columns, docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        at = stage(spark, at, SF)
        assert at.columns == names, number


def test_pipeline_on_empty_and_odd_rows(spark, edge_docs, no_docs, tmp_path):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    read(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    for number, docs in enumerate((edge_docs.select(*names), no_docs.select(*names))):
        docs.write.parquet(f"{tmp_path}/{number}/documents.parquet")
        read(spark, SF, "labels").write.parquet(f"{tmp_path}/{number}/labels.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{number}").count() >= 0


# ---------------------------------------------------------------- near copies


def five_word_shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_distinct(rows):
    """The least id of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = sorted((i, five_word_shingles(t)) for i, t in rows)
    least = {i: i for i, _ in sets}
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 10 * len(a & b) >= 8 * len(a | b):
                old, new = max(least[i], least[j]), min(least[i], least[j])
                least = {k: new if v == old else v for k, v in least.items()}
    return set(least.values())


def copies_between_thresholds():
    """Texts with a part appended or words replaced, of many sizes, from exact copies to ones that are too far."""
    chance = np.random.default_rng(7)
    rows = []
    for size in (3, 4, 5, 8, 9, 12, 20, 50, 120, 300, 800):
        base = [f"w{x}" for x in chance.integers(0, 50_000, size)]
        rows.append(base)
        for share in (0, 0.1, 0.15, 0.2, 0.24, 0.26, 0.4):
            rows.append(base + [f"y{x}" for x in chance.integers(0, 10**9, round(size * share))])
        for share in (0.01, 0.02, 0.03, 0.1):
            words = list(base)
            for at in chance.choice(size, max(1, round(size * share)), replace=False):
                words[at] = f"x{chance.integers(0, 10**9)}"
            rows.append(words)
    return [(int(i), " ".join(words)) for i, words in zip(chance.permutation(len(rows)), rows, strict=True)]


def test_near_copies_of_five_words(spark):
    table = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    for rows in (copies_between_thresholds(), [(i, (t or "").lower()) for i, t in table if (t or "").isascii()]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = [r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, SF).collect()]
        assert sorted(got) == sorted(brute_distinct(rows))


def test_near_copies_share_signatures():
    chance = np.random.default_rng(4)
    linked = 0
    for _ in range(1500):
        a = np.unique(chance.integers(0, 2**64, int(chance.integers(4, 1500)), dtype=np.uint64))
        most = len(a) * 20 * 2 // 180
        gone = int(chance.integers(0, most + 1))
        b = np.union1d(a[gone:], chance.integers(0, 2**64, most - gone, dtype=np.uint64))
        common = len(np.intersect1d(a, b))
        if common * 100 >= 80 * (len(a) + len(b) - common):
            linked += 1
            found = jaccard.signatures(a, 80)
            assert np.intersect1d(found, jaccard.signatures(b, 80)).size and len(found) <= 6 * len(a)
    assert linked > 500


def test_one_row_of_each_component_stays(spark, edge_docs, no_docs):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(6, a), (6, a), (6, b), (None, a), (9, b), (None, "only null ids have this text here"), (None, "only null ids have this text here"), (1, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in corpus_pipeline.distinct(spark, docs, SF).collect())
    assert got == Counter({(6, a): 1, (6, b): 1, (None, "only null ids have this text here"): 1, (1, None): 1, (2, ""): 1})
    kept = corpus_pipeline.distinct(spark, edge_docs, SF)
    assert kept.columns == edge_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect())[6] == 1
    assert corpus_pipeline.distinct(spark, no_docs, SF).count() == 0


def test_pipeline_follows_its_stages(spark):
    docs = read(spark, SF, "documents")
    identified = langid.keep_identified(docs, langid.fit_languages(docs))
    good = quality.keep_good(identified, quality.fit_quality(identified, read(spark, SF, "labels")))
    least = brute_distinct([(r["doc_id"], (r["text"] or "").translate({c: c + 32 for c in range(65, 91)})) for r in good.collect()])
    mixed = Counter(r["doc_id"] for r in mixing.whole_documents(good.filter(good["doc_id"].isin(list(least)))).collect())
    ends = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, SF).filter("start + length = doc_tokens").collect())
    assert ends == mixed and 0 < len(ends) < docs.count()
