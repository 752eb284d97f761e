"""Language identification by nearest centroids.

A text is a vector of hashed byte n-grams (two and three bytes of the lower-cased text, all but letters as blanks), weighted by
1 + log(count) and inverse document frequency and normalised. Each language has several centroids, found by spherical
k-means over its labelled texts. A text gets the language of the centroid of highest cosine, which is its score. It is
rejected where that cosine is below the reach for texts of its length: a share of a low quantile of the cosines of
labelled texts that the centroids were not found from. Length is counted in different n-grams, in powers of two; a
length with few such texts also takes those of the shorter ones. Without such texts of its length or less, none is rejected.

The model is fitted to a bounded sample: labelled texts of each language, the first by a hash of the id,
``PER_LANGUAGE`` for the centroids and a third as many for the reach. Whole texts become vectors in the tasks; the driver gets at most ``DIMENSIONS`` numbers for each, however long the text is.
Prediction reads whole texts, and nothing but texts. Null texts and
texts without a letter are ``und``, score 0, rejected. Without labelled texts every text is ``und``. Repeated rows and
ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 4096
PER_LANGUAGE = 600
CENTROIDS = 4
REACH = 0.8  # share of the cosine that all but LOW of the texts of a length exceed
LOW = 0.02
LENGTHS = 12  # powers of two
FEW = 10  # texts, fewer of a length are joined by shorter ones
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
# bytes of letters as they are, others as a blank
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a text."""
    data = _FOLD[np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8)]
    blank = data == 32
    data = data[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
    x = data.astype(np.uint32)
    two = x[:-1] * np.uint32(2654435761) + x[1:] * np.uint32(2246822519)
    three = two[:-1] * np.uint32(3) + x[2:] * np.uint32(3266489917)
    return np.bincount(np.concatenate([two, three]) >> np.uint32(20), minlength=DIMENSIONS)


# 1 + log(count) for small counts
_WEIGHT = np.concatenate([[0.0], 1 + np.log(np.arange(1, 4096))]).astype(np.float32)


def vectors(texts: list[str]) -> np.ndarray:
    """1 + log of the counts, a row for each text."""
    out = np.empty((len(texts), DIMENSIONS), dtype=np.float32)
    for i, text in enumerate(texts):
        found = counts(text)
        _WEIGHT.take(found, out=out[i], mode="clip")
        if len(text) >= len(_WEIGHT):
            large = np.flatnonzero(found >= len(_WEIGHT))
            out[i, large] = 1 + np.log(found[large])
    return out


_ENTRY = np.dtype([("place", "<u2"), ("value", "<f4")])


def _packed(row: np.ndarray) -> bytes:
    """The entries of a vector that are not 0: a text has few of all n-grams."""
    places = np.flatnonzero(row)
    out = np.empty(len(places), dtype=_ENTRY)
    out["place"], out["value"] = places, row[places]
    return out.tobytes()


def normalised(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def length_class(rows: np.ndarray) -> np.ndarray:
    """The power of two in each text's number of different n-grams."""
    return np.minimum(np.log2(np.maximum((rows > 0).sum(axis=1), 1)).astype(np.int64), LENGTHS - 1)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    language_of: np.ndarray  # of each centroid
    reach: np.ndarray  # of each length

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        out = [(UNKNOWN, 0.0, True)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not len(self.centroids):
            return out
        for start in range(0, len(known), 256):
            part = known[start : start + 256]
            rows = vectors([texts[i] for i in part])
            cosines = normalised(rows * self.idf) @ self.centroids.T
            for i, row, reach in zip(part, cosines, self.reach[length_class(rows)], strict=True):
                best = int(row.argmax())
                score = float(min(max(row[best], 0.0), 1.0))
                out[i] = (self.languages[self.language_of[best]], score, bool(score < reach))
        return out


def spherical_k_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k unit centroids of unit rows; starts from evenly spaced rows, so the result does not depend on chance."""
    k = min(k, len(rows))
    centroids = rows[np.arange(k) * len(rows) // max(k, 1)]
    for _ in range(rounds):
        of = (rows @ centroids.T).argmax(axis=1)
        member = (of == np.arange(len(centroids))[:, None]).astype(np.float32)
        centroids = normalised((member @ rows)[member.any(axis=1)])
    return centroids


def fit(texts: list[str], languages: list[str], clusters: int = CENTROIDS, reach: float = REACH) -> Model:
    kept = [i for i, t in enumerate(texts) if _LETTER.search(t)]
    return fit_vectors(vectors([texts[i] for i in kept]), [languages[i] for i in kept], clusters, reach)


def fit_vectors(rows: np.ndarray, languages: list[str], clusters: int = CENTROIDS, reach: float = REACH) -> Model:
    """Fit to the ``vectors`` of texts and their languages. The vectors are overwritten, so that there is one copy of them."""
    labels = np.array(languages, dtype=object)
    names = sorted(set(languages))
    # every fourth text of a language is for the reach
    apart = np.zeros(len(labels), dtype=bool)
    for name in names:
        apart[np.flatnonzero(labels == name)[3::4]] = True
    lengths = length_class(rows)
    df = (rows > 0)[~apart].sum(axis=0)
    idf = np.log((1 + np.count_nonzero(~apart)) / (1 + df)).astype(np.float32) + 1
    for start in range(0, len(rows), 256):
        rows[start : start + 256] = normalised(rows[start : start + 256] * idf)
    centroids, owner = [], []
    for number, name in enumerate(names):
        found = spherical_k_means(rows[(labels == name) & ~apart], clusters)
        owner += [number] * len(found)
        centroids.append(found)
    centroids = np.concatenate(centroids) if centroids else np.zeros((0, DIMENSIONS), np.float32)
    return Model(names, idf, centroids, np.array(owner, dtype=np.int64), reaches(rows[apart], lengths[apart], centroids, reach))


def reaches(rows: np.ndarray, lengths: np.ndarray, centroids: np.ndarray, reach: float = REACH) -> np.ndarray:
    """The least cosine of each length that is not rejected, from unit rows that the centroids were not found from."""
    out = np.zeros(LENGTHS)
    if len(rows):
        best = (rows @ centroids.T).max(axis=1)
        for length in range(LENGTHS):
            least = length
            while least and ((lengths >= least) & (lengths <= length)).sum() < FEW:
                least -= 1
            own = best[(lengths >= least) & (lengths <= length)]
            out[length] = reach * np.quantile(own, LOW) if len(own) else 0.0
    return out


def held_out() -> F.Column:
    """Whether a document is none of those that may be learned from (null ids count as the text 'null')."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 4 == 2


def fit_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit to a bounded sample of ``docs`` (doc_id, text, lang) that are not held out; texts without a letter do not count."""
    per_language += per_language // 3  # those for the reach
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.md5(F.concat(F.lit("lang"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("place"))
    # which places are in the sample is found without the texts; equal places are ordered by text
    ranked = rows.select("lang", "place").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("place")))
    # at most ``per_language`` short keys of each language, so the texts meet them without a shuffle
    keys = ranked.filter(F.col("n") <= per_language).select("lang", "place").distinct()
    near = rows.join(F.broadcast(keys), ["lang", "place"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_packed(vectors([t])[0]) for t in batch.column("text").to_pylist()]
            columns = [batch.column("lang"), batch.column("place"), batch.column("text_md5"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "place", "text_md5", "vector"])

    made = near.select("lang", "place", F.md5("text").alias("text_md5"), "text").mapInArrow(run, "lang string, place string, text_md5 string, vector binary")
    first = Window.partitionBy("lang").orderBy("place", "text_md5")
    sample = made.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_language).select("lang", "n", "vector").collect()
    sample.sort(key=lambda r: (r["lang"], r["n"]))
    rows_of = np.zeros((len(sample), DIMENSIONS), dtype=np.float32)
    for row, r in zip(rows_of, sample, strict=True):
        found = np.frombuffer(r["vector"], dtype=_ENTRY)
        row[found["place"]] = found["value"]
    return fit_vectors(rows_of, [r["lang"] for r in sample])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.predict(batch.column("text").to_pylist())
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.predict(batch.column(names.index("text")).to_pylist())
            yield batch.filter(pa.array([not f[2] for f in found], pa.bool_()))

    return docs.mapInArrow(run, schema)
