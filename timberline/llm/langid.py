"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams (1 to 3 code points of the lower-cased text, hashed to 2^16 features) give a matrix of log probabilities, languages by
features, with add-one smoothing. The matrix is broadcast, `CHUNK` languages (32 MB) at a time. Texts are scored in batches: the features that
occur in a batch are gathered from each language's row and summed by document in numpy. More languages than a chunk are scored in further
passes, which carry the best language so far and the sum of all likelihoods along.

Training reads at most about `TRAIN_DOCS` documents of each language, chosen by a hash of the id; that bound is a parameter. Every document is
scored over its whole text, and every language that a label names is learned.

`evidence` tells text from noise: by how much, in log likelihood for each n-gram, the language explains the text better than chance
among all features would. Below zero the n-grams are, on the whole, ones that no training text had.

Defined results: a text that is null or has no letter is `und` with score 0 and evidence 0; equal log likelihoods go to the language that sorts first;
if nothing was learned all are `und`; documents without a language teach nothing; rows that repeat count each; an empty table gives an
empty table. The result has the id and the new columns only, or with `keep` all columns but ones named like a new one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import begin, bounded, drop_clashing, slices, texts

FEATURE_BITS, ORDERS, TRAIN_DOCS = 16, (1, 2, 3), 10_000
#: Bytes of text whose n-grams are held at once: few enough that the arrays are used again instead of coming fresh from the system.
SLICE = 1 << 16
#: Languages of a broadcast.
CHUNK = 64
_LETTER = regex.compile(r"\p{L}")

#: Some languages, sorted, and their rows of the matrix.
Chunk = tuple[list[str], np.ndarray]


def features(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams, document by document, and where each document's start; no n-gram spans two documents."""
    lowered = [t.lower() for t in batch]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in lowered], np.int64)
    start = np.cumsum(lengths) - lengths
    left = np.repeat(start + lengths, lengths) - np.arange(len(points))
    found, owner = [], []
    docs = np.repeat(np.arange(len(batch), dtype=np.int32), lengths)
    value = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        value = value[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :]
        if n in ORDERS:
            fits = left[: len(value)] >= n
            mixed = (value[fits] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(64 - FEATURE_BITS)).astype(np.intp))
            owner.append(docs[: len(value)][fits])
    return np.concatenate(found), np.concatenate(owner)


def sums(matrix: np.ndarray, found: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """Languages by documents: each row's values at a document's features, added up. A document's features of one order lie side by side, so
    each such run is added up where it lies, and only the runs are dealt to documents."""
    runs = np.flatnonzero(np.diff(owner, prepend=-1))
    of = owner[runs]
    return np.stack([np.bincount(of, np.add.reduceat(row.take(found, mode="clip"), runs), docs) for row in matrix])


def train(df: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", limit: int = TRAIN_DOCS) -> Iterator[Chunk]:
    """The model, CHUNK languages at a time; from about `limit` documents of each language at most."""
    df = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in df.groupBy(lang).count().collect()}
    part = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("train")), F.lit(1 << 30)) / float(1 << 30)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("langid")
        held: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                of, docs = batch.column("row").to_numpy(), [t.decode("utf-8", "replace") for t in texts(batch.column("text"))]
                for row in np.unique(of).tolist():
                    found, _ = features([docs[i] for i in np.flatnonzero(of == row)])
                    held[row] = held.get(row, 0) + np.bincount(found, minlength=1 << FEATURE_BITS)
        for row, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["row", "feature", "n"])

    bounded(df.sparkSession)
    every = sorted(counts)
    for first in range(0, len(every), CHUNK):
        names = every[first : first + CHUNK]
        number = F.create_map(*[x for i, k in enumerate(names) for x in (F.lit(k), F.lit(i))])
        share = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(limit / counts[k]))])
        chosen = df.where(part < F.try_element_at(share, F.col(lang))).select(F.try_element_at(number, F.col(lang)).alias("row"), F.col(text).alias("text"))
        # At most CHUNK x features rows come back: this part of the model.
        table = chosen.mapInArrow(kernel, "row int, feature int, n long").groupBy("row", "feature").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros((len(names), 1 << FEATURE_BITS))
        n[table.column("row").to_numpy(), table.column("feature").to_numpy()] = table.column("n").to_numpy()
        yield names, np.log((n + 1) / (n.sum(axis=1, keepdims=True) + n.shape[1]))


#: What the passes carry: the best language, its log likelihood, and the log of the sum of all likelihoods.
_STATE = ("__best", "__top", "__sum")


def predict(df: DataFrame, model: Iterable[Chunk], text: str = "text") -> DataFrame:
    """Add lang_pred; score: the posterior of that language, all languages being equally likely beforehand; and evidence."""
    df = drop_clashing(df, "lang_pred", "score", "evidence", *_STATE)
    bounded(df.sparkSession)
    fields, sc = df.schema.fields, df.sparkSession.sparkContext
    state = [T.StructField("__best", T.StringType()), T.StructField("__top", T.DoubleType()), T.StructField("__sum", T.DoubleType())]
    chunks = [sc.broadcast(c) for c in model] or [sc.broadcast(([], np.zeros((0, 1 << FEATURE_BITS))))]

    for number, shipped in enumerate(chunks):
        first, last = number == 0, number == len(chunks) - 1
        schema = T.StructType([*fields, *([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType())] if last else state)])

        def kernel(batches: Iterator[pa.RecordBatch], shipped=shipped, first=first, last=last, names_out=schema.names) -> Iterator[pa.RecordBatch]:
            begin("langid")
            names, matrix = shipped.value
            for whole in batches:
                for batch in slices(whole, text, SLICE):
                    docs = [t.decode("utf-8", "replace") for t in texts(batch.column(text))]
                    found, owner = features(docs)
                    best: list = [None] * len(docs)
                    top, total = np.full(len(docs), -np.inf), np.full(len(docs), -np.inf)
                    if not first:
                        best, top, total = batch.column("__best").to_pylist(), batch.column("__top").to_numpy().copy(), batch.column("__sum").to_numpy()
                    if names:
                        scores = sums(matrix, found, owner, len(docs))
                        at, own = scores.argmax(axis=0), scores.max(axis=0)
                        better = own > top
                        best = [names[i] if b else x for i, b, x in zip(at.tolist(), better.tolist(), best)]
                        top = np.maximum(top, own)
                        total = np.logaddexp(total, own + np.log(np.exp(scores - own).sum(axis=0)))
                    if last:
                        said = np.array([x is not None and _LETTER.search(t) is not None for x, t in zip(best, docs)], bool)
                        score = np.where(said, np.exp(np.where(said, top - total, 0.0)), 0.0)
                        grams = np.maximum(1, np.bincount(owner, minlength=len(docs)))
                        evidence = np.where(said, np.where(said, top, 0.0) / grams + FEATURE_BITS * np.log(2), 0.0)
                        added = [pa.array([x if ok else "und" for x, ok in zip(best, said.tolist())], pa.string()), pa.array(score, pa.float64()), pa.array(evidence, pa.float64())]
                    else:
                        added = [pa.array(best, pa.string()), pa.array(top, pa.float64()), pa.array(total, pa.float64())]
                    yield pa.RecordBatch.from_arrays([*batch.columns[: len(names_out) - 3], *added], names=names_out)

        df = df.mapInArrow(kernel, schema)
    return df


def held_out(key: str = "doc_id") -> Column:
    """A fifth of the documents, by CRC-32 of the id as text; they never teach."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(df: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", keep: bool = False) -> DataFrame:
    """Train on the documents that aren't held out, then predict all."""
    model = train(df.where(~held_out(key)), lang, text, key)
    if keep:
        return predict(df, model, text)
    return predict(df.select(key, text), model, text).select(key, held_out(key).alias("held_out"), "lang_pred", "score")


def tell(df: DataFrame, least_score: float = 0.5, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """The documents whose language can be told, with that language in place of what `lang` said.

    A document goes if it has no letter, if no language is more likely than all others together, or if chance explains its n-grams better
    than the likeliest language does (noise, encoded data, scripts that nothing was learned of). What was declared is no reason to go.
    """
    columns = [F.col("lang_pred").alias(c) if c == lang else F.col(c) for c in df.columns]
    return identify(df, key, lang, text, keep=True).where(f"lang_pred <> 'und' and score >= {least_score} and evidence > 0").select(*columns)
