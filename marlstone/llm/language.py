"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are runs of one to four characters of the lower-cased text whose inner characters are
letters, a word's edges included. Each is hashed to one of BUCKETS embeddings; a text is the
average of its embeddings, trained with the softmax by stochastic gradient descent in numpy. A
temperature fitted on rows kept from training calibrates the scores; texts less certain than all
but REJECTED_RIGHT of those of these rows that were right are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import aside, bound_batches, frugal, own_columns, place_of, table, text_batches, text_blocks, text_column

BUCKETS = 1 << 16
DIMENSIONS = 16
ORDERS = 4
#: Labelled rows of each language that are fitted, taken by the hash of their doc_id and text.
ROWS_PER_LANGUAGE = 400
#: Times as many rows as are fitted are ranked.
SPREAD = 4
EPOCHS = 8
RATE = 0.2
#: The share of rightly identified texts that rejection may cost: it sets the threshold.
REJECTED_RIGHT = 0.005
#: A calibrated score from which no text is rejected, however certain the others are.
CERTAIN = 0.8
UNKNOWN = "und"
_BLOCK = 1 << 18
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def subwords(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(bucket at each place for each order, BUCKETS where there is no subword; first place of
    each text; number of letters of each text). Every text has an edge of its own at both ends, so
    no subword runs over two texts."""
    lowered = [f"\0{x.lower()}\0" for x in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    code = np.where(letter, code, 0).astype(np.uint32)
    first = np.cumsum(sizes) - sizes
    out = []
    h = np.full(len(code), 2166136261, np.uint32)
    inner = np.ones(len(code), bool)  # all but the first and last of the subword are letters
    for n in range(1, ORDERS + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        with np.errstate(over="ignore"):
            h = (h[:m] ^ code[n - 1 :]) * np.uint32(0x01000193)
            h = h ^ (h >> np.uint32(15))
            bucket = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int32) & (BUCKETS - 1)
        if n == 1:
            valid = letter
        elif n == 2:
            valid = letter[:m] | letter[1:]
        else:
            inner = letter[1 : m + 1] if n == 3 else inner[:m] & letter[n - 2 : n - 2 + m]
            valid = inner
        full = np.full(len(code), BUCKETS, np.int32)
        full[:m] = np.where(valid, bucket, BUCKETS)
        out.append(full)
    return out, first, np.add.reduceat(letter.astype(np.int64), first)


@dataclass
class LanguageModel:
    """A fitted model: ``table`` has each bucket's share of each language's logit."""

    languages: list[str]
    table: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(calibrated probability of each language, number of letters) of each text."""
        probs, letters = [np.zeros((0, len(self.languages)))], [np.zeros(0, np.int64)]
        padded = np.concatenate([self.table, np.zeros((1, len(self.languages)), np.float32)])
        for a, b in text_blocks(texts, _BLOCK):
            orders, first, n = subwords(texts[a:b])
            total, count = np.zeros((b - a, len(self.languages))), np.zeros(b - a)
            for bucket in orders:
                total += np.add.reduceat(padded[bucket], first, axis=0)
                count += np.add.reduceat((bucket < BUCKETS).astype(np.int64), first)
            probs.append(softmax(total / np.maximum(count, 1)[:, None] / self.temperature))
            letters.append(n)
        return np.concatenate(probs), np.concatenate(letters)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray, bool]], seed: int = 7) -> LanguageModel:
    """Fits (language, buckets, their counts, kept for calibration) rows."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), 1.0, 0.0)
    number = {x: i for i, x in enumerate(languages)}
    data = [(number[lang], b, (c / c.sum()).astype(np.float32), kept) for lang, b, c, kept in rows if len(b)]
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, len(languages)), np.float32)
    train = [x for x in data if not x[3]]
    steps = EPOCHS * len(train)
    step = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            y, buckets, share, _ = train[i]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = share @ embed[buckets]
            error = softmax(hidden @ out)
            error[y] -= 1
            back = out @ error
            out -= rate * np.outer(hidden, error)
            embed[buckets] -= (rate / (share @ share)) * share[:, None] * back  # moves hidden by rate * back
    logits = (embed @ out).astype(np.float32)
    check = [x for x in data if x[3]] or train
    scores = np.array([share @ logits[b] for _, b, share, _ in check]).reshape(len(check), len(languages))
    truth = np.array([x[0] for x in check], np.int64)
    best = (np.inf, 1.0)
    for t in np.geomspace(0.2, 20, 61):
        p = softmax(scores / t)[np.arange(len(check)), truth]
        best = min(best, (float(-np.log(np.maximum(p, 1e-9)).mean()), float(t)))
    p = softmax(scores / best[1])
    right = p.argmax(axis=1) == truth
    return LanguageModel(languages, logits, best[1], rejection_threshold(p.max(axis=1)[right]))


def rejection_threshold(scores: np.ndarray, rate: float = REJECTED_RIGHT) -> float:
    """The score that a share ``rate`` of these scores of right rows is below, CERTAIN at most; 0
    without rows."""
    return min(CERTAIN, float(np.quantile(scores, rate))) if len(scores) else 0.0


def held_out(doc_id) -> F.Column:
    """Whether a row is kept from learning: crc32 of its doc_id as text is 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def least_hashed(known: DataFrame, rows_per_language: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(lang, keys, _r) of the rows of least hash of each language, ranked from 1; rows of the
    same keys are one.

    Hashes above SPREAD times the share that is looked for are put aside before ranking, by the
    distinct rows that a sketch counts, so that a language's rows are not ranked in one task.
    """
    ids = known.select("lang", *keys, F.xxhash64(*keys).alias("_h"))
    counted = ids.groupBy("lang").agg(F.approx_count_distinct("_h").alias("_ids"))  # a row for each language
    near = ids.join(F.broadcast(counted), "lang")
    near = near.where((F.col("_h") / F.lit(2.0**64) + 0.5) * F.col("_ids") <= SPREAD * rows_per_language).select("lang", *keys, "_h").distinct()
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", *keys)))
    return ranked.where(F.col("_r") <= rows_per_language).select("lang", *keys, "_r")


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Learns from text and non-null lang of rows that are not held out.

    At most ``rows_per_language`` rows of each language are fitted: those of least hash of doc_id
    and text, rows that repeat both being one. Every fifth of them calibrates. Their whole texts
    are counted on the executors; what comes to the driver are their subwords with counts.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_column(docs).alias("text"))
    known = known.withColumn("row_hash", F.xxhash64("text"))
    picked = least_hashed(known, rows_per_language, ("doc_id", "row_hash"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2):
            langs, ranks, texts = (batch.column(i).to_pylist() for i in range(3))
            keep = [[], []]
            for text in texts:
                orders, _, _ = subwords([text])
                found, n = np.unique(np.concatenate(orders), return_counts=True)
                keep[0].append(found[found < BUCKETS])
                keep[1].append(n[found < BUCKETS])
            columns = [pa.array(langs, pa.string()), pa.array(ranks, pa.int32()), *(pa.array(x, pa.list_(pa.int32())) for x in keep)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "rank", "buckets", "counts"])

    # at most rows_per_language rows of each language: a bounded side
    sample = known.join(F.broadcast(picked), ["doc_id", "row_hash", "lang"]).select("lang", "_r", "text").dropDuplicates(["lang", "_r"])
    rows = sample.mapInArrow(frugal(count), "lang string, rank int, buckets array<int>, counts array<int>").toPandas()
    rows = rows.sort_values(["lang", "rank"], kind="stable")
    return fit([(a, np.asarray(b, np.int64), np.asarray(c, np.float64), r % 5 == 0) for a, r, b, c in zip(rows["lang"], rows["rank"], rows["buckets"], rows["counts"])])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds lang_pred, score and rejected to all columns of docs; predicts from text alone.

    ``und`` with score 0, and rejected, where the text is null or has no letter, or where the
    model knows no language. New columns replace old ones of these names (any letter case).
    """
    new = ("lang_pred", "score", "rejected")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = place_of(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in text_batches(batches, text_at):
            texts = [x or "" for x in batch.column(text_at).to_pylist()]
            probs, letters = m.probabilities(texts) if m.languages else (np.zeros((len(texts), 1)), np.zeros(len(texts), np.int64))
            score = np.where(letters > 0, probs.max(axis=1, initial=0), 0.0)
            which = np.where(letters > 0, probs.argmax(axis=1), len(m.languages)) if m.languages else np.zeros(len(texts), np.int64)
            rejected = (letters == 0) | (score < m.threshold) | (which == len(m.languages))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[which], pa.string()), pa.array(score), pa.array(rejected)], [*batch.schema.names, *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(frugal(run), f"{schema}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is identified, with the columns of docs."""
    named = docs.columns
    docs = aside(docs, ("lang_pred", "score", "rejected"))
    kept = identify(docs, train(docs)).where(~F.col("rejected"))
    return kept.select(*own_columns(docs)).toDF(*named)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(bound_batches(spark), sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
