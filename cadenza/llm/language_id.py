"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte trigrams (words lower-cased for A-Z, other characters by their UTF-8 bytes, every
word between two spaces), weighted by TF-IDF and scaled to length 1; the document frequencies are those of all learnable
texts, summed by trigram bucket. For every language the vectors of a bounded sample of labelled texts are clustered into
`clusters` spherical centroids; a text gets the language of the centroid of greatest cosine, and is marked as rejected
where that cosine is below the smallest one that the sample's own texts have, up to a quantile. Of equally near centroids the
first counts, by language and then by number.

The sample: of every language `per_language` different whole texts, fewer with many languages (`most_rows` in all) but
`LEAST` at least, or all that it has; those of least hash of language and text, so it does not depend on partitions or
copies. The driver gets trigram counts, not texts. Prediction reads whole texts and nothing else.

Defined cases: null texts and texts without a letter are "und" with score 0; with nothing to learn from all texts are
"und"; repeated rows are each predicted; `lang_pred`, `score` and `rejected` replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.tokens import LOWER, NOT_SPACE, chunks, list_array

DIMENSIONS = 1 << 13
LETTER = regex.compile(r"\p{L}")
#: Texts whose vectors are made at once.
ROWS = 512
#: Texts of every language in the sample, however many languages there are.
LEAST = 8

_CODE = LOWER.copy()
_CODE[~NOT_SPACE] = 0x20
_CODE[0x30:0x3A] = 0x20


def _features(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    code = (a.astype(np.uint32) << np.uint32(16)) | (b.astype(np.uint32) << np.uint32(8)) | c
    code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    return (code >> np.uint32(32 - 13)).astype(np.int64)


def counts_of(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Trigram counts, one row of DIMENSIONS for every text."""
    n = len(bounds) - 1
    padded = np.full(len(data) + 2 * n + 2, 0x20, np.uint8)
    text = np.repeat(np.arange(n), np.diff(bounds))
    padded[np.arange(len(data)) + 2 * text + 1] = _CODE[data]
    owner = np.repeat(np.arange(n), np.diff(bounds) + 2)[: len(padded) - 2]
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    keep = ~((a == 0x20) & (b == 0x20)) & ~((b == 0x20) & (c == 0x20)) & (b != 0x20)
    flat = _features(a[keep], b[keep], c[keep]) + owner[keep] * DIMENSIONS
    return np.bincount(flat, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray  # DIMENSIONS
    centroids: np.ndarray  # languages * clusters, DIMENSIONS
    languages: list[str]  # of every centroid
    floor: np.ndarray  # least cosine of every centroid

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest centroid, its cosine, and whether that is too low."""
        cosine = self.vectors(counts) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        return best, score, score < self.floor[best]


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from the mean and then from the vectors that are farthest from all centroids."""
    centroids = [x.mean(axis=0)]
    for _ in range(1, min(k, len(x))):
        centroids.append(x[(x @ np.array(centroids).T).max(axis=1).argmin()])
    c = np.array(centroids)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = (x @ c.T).argmax(axis=1)
        c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _sparse(batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(trigrams, their counts) of every text."""
    for data, bounds in batches:
        for i in range(0, len(bounds) - 1, ROWS):
            some = bounds[i : i + ROWS + 1]
            for row in counts_of(data[some[0] : some[-1]], some - some[0]):
                at = np.flatnonzero(row)
                yield at.astype(np.int32), row[at]


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), DIMENSIONS), np.float32)
    for row, (at, n) in zip(out, rows, strict=True):
        row[at] = n
    return out


def learn(languages: list[str], rows: list[tuple[np.ndarray, np.ndarray]], frequencies: np.ndarray, n: int, clusters: int = 4, quantile: float = 0.01) -> Model:
    """The model of texts as (trigrams, counts), by the document frequencies of `n` texts."""
    idf = np.log((1 + n) / (1 + frequencies)).astype(np.float32) + 1
    model = Model(idf, np.zeros((0, DIMENSIONS), np.float32), [], np.zeros(0))
    of = {lang: [] for lang in sorted(set(languages))}
    for lang, row in zip(languages, rows, strict=True):
        of[lang].append(row)
    centroids = []
    for lang, own in of.items():
        centroids.append(_cluster(model.vectors(_dense(own)), clusters).astype(np.float32))
        model.languages += [lang] * len(centroids[-1])
    if centroids:
        model.centroids = np.concatenate(centroids)
        cosines = [model.vectors(_dense(rows[i : i + ROWS])) @ model.centroids.T for i in range(0, len(rows), ROWS)]
        best, near = (np.concatenate([f(c) for c in cosines]) for f in (lambda c: c.max(axis=1), lambda c: c.argmax(axis=1)))
        model.floor = np.array([np.quantile(best[near == j], quantile) if (near == j).any() else 0.0 for j in range(len(model.languages))])
    return model


def fit(rows: list[tuple[str, str]], clusters: int = 4, quantile: float = 0.01) -> Model:
    """The model of (language, text) rows, by their own document frequencies."""
    texts = [t.encode() for _, t in rows]
    vectors = list(_sparse(iter([(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))])))
    frequencies = np.bincount(np.concatenate([np.zeros(0, np.int32), *(at for at, _ in vectors)]), minlength=DIMENSIONS)
    return learn([lang for lang, _ in rows], vectors, frequencies, len(rows), clusters, quantile)


def _learnable(docs: DataFrame, lang: str, text: str, learnable: Column) -> DataFrame:
    rows = docs.where(learnable).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))


def frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all `rows` (…, text) each trigram bucket occurs, and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            total[DIMENSIONS] += batch.num_rows
            for _, _, data, bounds in chunks(batch.column(0)):
                for i in range(0, len(bounds) - 1, ROWS):
                    some = bounds[i : i + ROWS + 1]
                    total[:DIMENSIONS] += (counts_of(data[some[0] : some[-1]], some - some[0]) > 0).sum(axis=0)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    found = rows.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(DIMENSIONS + 1, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out[:DIMENSIONS], int(out[DIMENSIONS])


def sample_rows(rows: DataFrame, per_language: int, most_rows: int) -> DataFrame:
    """Of `rows` (lang, text) the sample (lang, text), each text of a language once.

    Keys are ranked without texts and copies; every task sends at most `per_language` of a language.
    """
    n_languages = rows.select("lang").distinct().count()
    per_language = max(min(LEAST, per_language), min(per_language, most_rows // max(1, n_languages)))
    keyed = rows.withColumn("key", F.xxhash64("lang", "text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = keyed.select("lang", "key").distinct().withColumn("n", rank).where(F.col("n") <= per_language).select("lang", "key")
    chosen = F.broadcast(chosen)  # `most_rows`, or LEAST for every language
    return keyed.join(chosen, ["lang", "key"], "left_semi").groupBy("lang", "key").agg(F.min("text").alias("text")).select("lang", "text")


def sample(
    docs: DataFrame,
    lang: str,
    text: str,
    learnable: Column,
    per_language: int,
    most_rows: int,
    most_languages: int | None = None,
    sample_chars: int | None = None,
) -> list[tuple[str, str]]:
    """The sample's rows (language, text); only on request of the most frequent languages, or of the first characters."""
    rows = _learnable(docs, lang, text, learnable)
    if most_languages is not None:
        top = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
        rows = rows.join(F.broadcast(top.select("lang")), "lang", "left_semi")
    if sample_chars is not None:
        rows = rows.withColumn("text", F.substring("text", 1, sample_chars)).where(F.col("text").rlike(r"\p{L}"))
    return [(r.lang, r.text) for r in sample_rows(rows, per_language, most_rows).orderBy("lang", "text").collect()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, until, data, bounds in chunks(batch.column(1)):
            found = list(_sparse(iter([(data, bounds)])))
            sizes = np.array([len(at) for at, _ in found])
            lists = [list_array(np.concatenate(x), sizes, kind) for x, kind in zip(zip(*found, strict=True), (pa.int32(), pa.float32()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, until - row), *lists], names=["lang", "at", "n"])


def _predictions(batches: Iterator[pa.RecordBatch], model: Model, n_rest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(n_rest)
        names, scores, rejected = [], [], []
        for row, until, data, bounds in chunks(texts):
            raw = data.tobytes()
            for i in range(0, until - row, ROWS):
                j = min(i + ROWS, until - row)
                has = [LETTER.search(raw[bounds[t] : bounds[t + 1]].decode()) is not None for t in range(i, j)]
                if not model.languages:
                    best, score, low = np.zeros(j - i, int), np.zeros(j - i), np.ones(j - i, bool)
                    has = [False] * (j - i)
                else:
                    best, score, low = model.predict(counts_of(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]))
                names += [model.languages[b] if h else "und" for b, h in zip(best.tolist(), has, strict=True)]
                scores += [s if h else 0.0 for s, h in zip(score.tolist(), has, strict=True)]
                rejected += [bool(r) or not h for r, h in zip(low.tolist(), has, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:n_rest], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
            names=[*batch.schema.names[:n_rest], "_lang_pred", "_score", "_rejected"],
        )


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` without `text`, with lang_pred, score (0 to 1) and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS numbers for every centroid
    added = ("lang_pred", "score", "rejected")
    rest = [c for c in docs.columns if c != text and c not in added]
    kinds = dict(docs.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in rest) + "_lang_pred string, _score double, _rejected boolean"
    n = len(rest)
    out = docs.select(*rest, F.col(text).alias("_text")).mapInArrow(lambda batches: _predictions(batches, shared.value, n), schema)
    return out.withColumnsRenamed({f"_{c}": c for c in added})


def identify(
    docs: DataFrame, learnable: Column, lang: str = "lang", text: str = "text", per_language: int = 600, most_rows: int = 4000, clusters: int = 4
) -> DataFrame:
    """Learn from all `learnable` rows (frequencies) and their sample (centroids), and predict every row of `docs`."""
    rows = _learnable(docs, lang, text, learnable)
    found = sample_rows(rows, per_language, most_rows).mapInArrow(_counted, "lang string, at array<int>, n array<float>").toArrow().sort_by("lang")
    vectors = [(np.array(at.values), np.array(n.values)) for at, n in zip(found.column("at"), found.column("n"), strict=True)]
    return predict(docs, learn(found.column("lang").to_pylist(), vectors, *frequencies(rows), clusters), text)
