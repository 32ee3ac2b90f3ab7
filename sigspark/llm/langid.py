"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training texts. The weights are fitted on the driver by
follow-the-regularised-leader with an elastic-net penalty, on a sample bounded by `sample_rows`, and a
temperature is calibrated on a part of the sample that was not fitted. Prediction is one pass over whole texts:
as a term's frequency is relative to the text's length, a text's scores are the mean over its n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sigspark.llm.common import map_batches, map_stream, small_batches

HASH_BITS = 16
ORDERS = 3
#: Labelled rows that the weights are fitted on at most, an equal share for each language (and one at least).
SAMPLE_ROWS = 3000
BLOCK_CHARS = 200_000


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, end, hashes (ORDERS, chars), begins of the texts, whether each has letters), for blocks of texts.

    Letters are lowered, anything else is a space; a text ends with spaces, so no n-gram joins two.
    """
    at = 0
    pad = " " * ORDERS
    while at < len(texts):
        end, chars, parts = at, 0, []
        while end < len(texts) and (end == at or chars < BLOCK_CHARS):
            parts.append((texts[end] or "").lower() + pad)
            chars, end = chars + len(parts[-1]), end + 1
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.cumsum([0, *map(len, parts)])[:-1]
        alpha = _letters()[codes]
        some = np.logical_or.reduceat(alpha, begins)
        codes = np.where(alpha, codes, np.uint32(32))
        out = np.empty((ORDERS, len(codes)), np.int32)
        h = np.zeros(len(codes), np.uint32)
        for n in range(ORDERS):
            h = (h ^ np.concatenate([codes[n:], np.full(n, 32, np.uint32)])) * np.uint32(2654435761) + np.uint32(n + 1)
            out[n] = (h ^ h >> np.uint32(15)) * np.uint32(2246822519) >> np.uint32(32 - HASH_BITS)
        # an n-gram that begins in the spaces after a text holds nothing but spaces
        ends = np.append(begins[1:], len(codes))
        for k in range(ORDERS - 1):
            out[:, ends - 1 - k] = out[:, ends - ORDERS]
        yield at, end, out, begins, some
        at = end


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (hashes, languages): IDF times weight
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and calibrated probabilities; `und` and 0 for null, for texts without letters, and if nothing was learnt."""
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for at, end, hashes, begins, some in grams(texts):
            sums = sum(np.add.reduceat(self.table[h], begins, axis=0) for h in hashes)
            sizes = np.diff(np.append(begins, hashes.shape[1]))
            logits = (sums / (ORDERS * sizes[:, None]) + self.bias) / self.temperature
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i in np.flatnonzero(some).tolist():
                best = int(p[i].argmax())
                names[at + i], scores[at + i] = self.languages[best], p[i, best]
        return names, scores


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts each hash occurs, over all of docs, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen, n = np.zeros((1 << HASH_BITS) + 1, np.int64), np.zeros(1 << HASH_BITS, bool), 0
        for b in batches:
            for _, _, hashes, begins, _ in grams(b[text].to_pylist()):
                for a, e in zip(begins, np.append(begins[1:], hashes.shape[1]), strict=True):
                    own = hashes[:, a:e]
                    seen[own] = True
                    df[:-1] += seen
                    seen[own] = False
            n += b.num_rows
        df[-1] = n
        h = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int32()), pa.array(df[h], pa.int64())], ["h", "n"])

    df = np.zeros((1 << HASH_BITS) + 1, np.int64)
    for h, n in map_stream(docs.select(text), run, "h int, n long").groupBy("h").agg(F.sum("n")).collect():  # a row for each hash at most
        df[h] = n
    return df[:-1], int(df[-1])


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int, alpha: float = 5.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (hashes, languages) and bias, by FTRL-proximal steps in an order fixed by a seed."""
    z, n = np.zeros((1 << HASH_BITS, languages)), np.zeros((1 << HASH_BITS, languages))
    zb, nb = np.zeros(languages), np.zeros(languages)

    def weights(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0)

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            h, x, y = rows[i]
            w, wb = weights(z[h], n[h], l1), weights(zb, nb, 0)
            logits = x @ w + wb
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            z[h] += g - (np.sqrt(n[h] + g * g) - np.sqrt(n[h])) / alpha * w
            n[h] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * wb
            nb += p * p
    return weights(z, n, l1), weights(zb, nb, 0)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least negative log-likelihood, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / math.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    a, b, r = math.log(0.05), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the rows of docs with a text and a language; key only orders the sample.

    A language with few rows has all of them in the sample, however frequent others are; of rows that repeat it has one. There is
    no bound on the languages: each takes a weight for every hash. No such rows give a model that predicts `und`.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(key, F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"))
    languages = sorted(r.lang for r in counts.select("lang").collect())  # a row for each language
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros(0), 1.0)
    df, n = document_frequencies(rows, "text")
    idf = np.log((1 + n) / (1 + df)) + 1
    quota = max(1, sample_rows // len(languages))
    # the draw leaves some rows more than the quota in all but rare cases, and all rows of small languages
    share = (quota + 4 * math.sqrt(quota) + 10) / F.col("_rows")
    drawn = rows.withColumn("draw", F.pmod(F.xxhash64(key, F.octet_length("text"), "lang"), F.lit(1 << 31))).join(F.broadcast(counts), "lang").where(F.col("draw") / float(1 << 31) < share)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    chosen = drawn.select("lang", "draw", "text").dropDuplicates(["lang", "draw"]).withColumn("nth", place).where(F.col("nth") <= quota)

    def vectors(b: pa.RecordBatch) -> pa.RecordBatch:
        hs, xs = [], []
        for _, _, hashes, begins, _ in grams(b["text"].to_pylist()):
            for a, e in zip(begins, np.append(begins[1:], hashes.shape[1]), strict=True):
                h, c = np.unique(hashes[:, a:e], return_counts=True)
                hs.append(h)
                xs.append((c / (ORDERS * (e - a)) * idf[h]).astype(np.float32))
        return pa.RecordBatch.from_arrays([b["lang"], b["draw"], b["nth"], pa.array(hs, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.float32()))], ["lang", "draw", "nth", "h", "x"])

    sample = map_batches(chosen, vectors, "lang string, draw long, nth int, h array<int>, x array<float>").toArrow().sort_by([("lang", "ascending"), ("draw", "ascending")]).combine_chunks()
    number = {name: i for i, name in enumerate(languages)}
    fit: list = []
    rest: list = []  # every fifth row of a language, so that those with few are fitted on all
    hashes, values = sample["h"], sample["x"]
    for i, (name, nth) in enumerate(zip(sample["lang"].to_pylist(), sample["nth"].to_pylist(), strict=True)):
        (rest if nth % 5 == 0 else fit).append((hashes[i].values.to_numpy(), values[i].values.to_numpy().astype(np.float64), number[name]))
    weights, bias = _ftrl(sorted(fit, key=lambda r: (r[2], len(r[0]), float(r[1].sum()))), len(languages))
    logits = np.array([x @ weights[h] + bias for h, x, _ in rest]).reshape(len(rest), len(languages))
    return Model(languages, (weights * idf[:, None]).astype(np.float32), bias, _temperature(logits, np.array([y for *_, y in rest], int)))


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with `lang_pred` string and `score` double (0 to 1); earlier columns of these names are replaced.

    A null or empty text, or one without letters, gives `und` and 0. Every row gives one, repeated ones too; an empty df gives an
    empty result. No shuffle; the model sent to the tasks has 2 ** HASH_BITS single-precision weights a language (256 kB).
    """
    small_batches(df.sparkSession)
    df = df.drop("lang_pred", "score")
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = sent.value.predict(b[text].to_pylist())
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return map_batches(df, run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from training: a fifth of them by the checksum of the key's text. A null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0
