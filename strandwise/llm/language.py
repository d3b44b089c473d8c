"""Language identification in two levels: a family first, then one-versus-one linear support vector machines within it.

Features are frequencies of byte trigrams of the whole text (A-Z lower-cased, bytes other than letters as one blank),
hashed to DIMS places. The machines are fitted on the driver from the features of at most `per_language` labelled documents
of each language, chosen by hash and read whole by the executors; prediction streams all documents and sums weights over all their trigrams.

Defined results: `und` with score 0 for a null text or one without a letter; without labelled documents all are `und`;
a null doc_id counts as the empty text when documents are held out; repeated rows are predicted alike; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import pieces, text_buffers

DIMS = 8192
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc ast",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr ne pa gu ur",
    "sinitic": "zh yue",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")
_CLASS = np.zeros(256, np.uint32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128)


def family_of(lang: str) -> str:
    return FAMILY.get(lang.split("-")[0].lower(), "of " + lang)


def _trigrams(data: np.ndarray) -> np.ndarray:
    """The place of the trigram that begins at each byte but the last two."""
    c = _CLASS[data]
    h = c[:-2] * np.uint32(0x9E3779B1)
    h ^= c[1:-1] * np.uint32(0x85EBCA77)
    h ^= c[2:] * np.uint32(0xC2B2AE3D)
    h *= np.uint32(0x27D4EB2F)
    h >>= np.uint32(19)
    return h


def features(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        data = np.frombuffer(b" " + t.encode() + b" ", np.uint8)
        x[i] = np.bincount(_trigrams(data), minlength=DIMS)
        x[i] /= max(1, len(data) - 2)
    return x


def fit_svm(x: np.ndarray, y: np.ndarray, scale: np.ndarray, penalty: float = 1e-3, steps: int = 120) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by accelerated gradient steps; y is +1 or -1."""
    z = np.hstack([x * scale, np.ones((len(x), 1), np.float32)])
    balance = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    v = np.ones(z.shape[1], np.float32)
    for _ in range(8):  # the largest curvature, by power iteration
        v = z.T @ (balance * (z @ v))
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    rate = 1 / (2 * top * 1.1 + penalty)
    w = prev = np.zeros(z.shape[1], np.float32)
    for k in range(steps):
        look = w + (k / (k + 3)) * (w - prev)
        slack = np.maximum(0, 1 - y * (z @ look))
        prev, w = w, (look - rate * (penalty * look - 2 * (z.T @ (balance * y * slack)))).astype(np.float32)
    out = w.copy()
    out[:-1] *= scale
    return out


class Model:
    """langs, families, and the weights of the machines: one a family (against the rest), then one a pair within a family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(x) for x in self.langs})
        self.members = {f: [x for x in self.langs if family_of(x) == f] for f in self.families}
        self.pairs = [(a, b) for f in self.families for a, b in itertools.combinations(self.members[f], 2)]
        lang = np.array(langs, dtype=object)
        scale = (1 / (x.std(axis=0) + 1e-4) / np.sqrt(DIMS)).astype(np.float32)
        rows, owner = [], np.array([family_of(v) for v in langs], dtype=object)
        for f in self.families:
            rows.append(fit_svm(x, np.where(owner == f, 1, -1).astype(np.float32), scale) if len(self.families) > 1 else np.append(np.zeros(DIMS, np.float32), 1))
        for a, b in self.pairs:
            use = (lang == a) | (lang == b)
            rows.append(fit_svm(x[use], np.where(lang[use] == a, 1, -1).astype(np.float32), scale))
        self.weights = np.array(rows, np.float32).reshape(len(rows), DIMS + 1)

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row of margins (documents by machines)."""
        n, k = len(margins), len(self.families)
        family = margins[:, :k].argmax(axis=1)
        if k > 1:
            two = np.sort(margins[:, :k], axis=1)
            score = two[:, -1] - two[:, -2]
        else:
            score = np.full(n, 2.0)
        out = np.empty(n, dtype=object)
        for f, name in enumerate(self.families):
            mine, names = family == f, self.members[name]
            votes, least = np.zeros((mine.sum(), len(names))), np.full((mine.sum(), len(names)), np.inf)
            for j, (a, b) in enumerate(self.pairs):
                if a in names:
                    m = margins[mine, k + j]
                    for x, sign in ((names.index(a), 1), (names.index(b), -1)):
                        votes[:, x] += (sign * m > 0) + 1e-3 * np.tanh(sign * m)
                        least[:, x] = np.minimum(least[:, x], sign * m)
            best = votes.argmax(axis=1)
            out[mine] = np.array(names, dtype=object)[best]
            if len(names) > 1:
                score[mine] = np.minimum(score[mine], 2 * least[np.arange(len(best)), best])
        return out, 1 / (1 + np.exp(-np.clip(2 * score, -30, 30)))

    def margins(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_buffers(column)
        n = len(offsets) - 1
        padded = np.full(len(data) + 2 * n + 1, 32, np.uint8)  # a blank before and after each text
        at = offsets[:-1] + 2 * np.arange(n) + 1
        lengths = np.diff(offsets)
        keep = np.ones(len(padded), bool)
        keep[at - 1] = False
        keep[at + lengths] = False
        keep[-1] = False
        padded[keep] = data
        grams = _trigrams(padded)
        valid = np.maximum(lengths, 1)
        out = np.empty((n, len(self.weights)))
        first, last = at - 1, at - 1 + lengths  # trigrams of a text begin at its leading blank
        for j, w in enumerate(self.weights):
            sums = np.zeros(len(grams) + 1)
            np.cumsum(w[:-1][grams], dtype=np.float64, out=sums[1:])
            out[:, j] = (sums[np.minimum(last, len(grams))] - sums[np.minimum(first, len(grams))]) / valid + w[-1]
        return out


def fit(docs: DataFrame, per_language: int = 400) -> Model | None:
    """Fits on the whole texts of at most per_language documents of each language; lang and text only.

    Documents are drawn by a hash of all that is known of them; that of the least hash always is, so no language is lost,
    and the rank within a language bounds the sample where one document comes many times.
    """
    draw = F.pmod(F.xxhash64(F.lit("lid"), F.col("doc_id").isNull(), "doc_id", "lang", "text"), F.lit(1 << 40)) / float(1 << 40)
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", draw.alias("draw"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")).collect()
    if not counts:
        return None
    # a little more than wanted, for the rank to cut
    upto = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], max(r["least"], min(1.0, 1.1 * (per_language + 20) / r["n"])))])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.sha2("text", 256)))
    drawn = labelled.where(F.col("draw") <= upto[F.col("lang")]).withColumn("rank", rank).where(F.col("rank") <= per_language)

    def run(batches):
        for batch in pieces(batches, "text", 4 << 20):
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = part.column("text").to_pylist()
                # sparse: the places that occur, and their frequencies
                found = [(at := np.flatnonzero(x), x[at]) for x in features(texts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), pa.array([at.astype(np.uint16).tobytes() for at, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary()), pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())],
                    names=["lang", "at", "value", "digest"],
                )

    chosen = drawn.select(F.col("text").cast("string").alias("text"), "lang").mapInArrow(run, "lang string, at binary, value binary, digest binary").collect()
    chosen.sort(key=lambda r: (r["lang"], bytes(r["digest"])))
    x = np.zeros((len(chosen), DIMS), np.float32)
    for i, r in enumerate(chosen):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["value"], np.float32)
    return Model(x, [r["lang"] for r in chosen])


def predict(docs: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    """`columns` of docs, with lang_pred and score; the model is a few hundred kilobytes, whatever the data."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    if {"lang_pred", "score", "_text"} & {c.lower() for c in columns}:
        raise ValueError("lang_pred, score and _text are columns of the result; pack the row as one column")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[F.col(c) for c in columns], F.col("text").alias("_text"))
    schema = StructType([*source.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        m = shared.value
        for batch in pieces(batches, "_text", 4 << 20):
            texts = batch.column("_text")
            data, offsets = text_buffers(texts)
            letters = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data >= 65) & (data <= 122) & ((data >= 97) | (data <= 90)), out=letters[1:])
            some = letters[offsets[1:]] > letters[offsets[:-1]]
            for i in np.flatnonzero(~some):  # letters beyond ASCII
                some[i] = bool(_LETTER.search(bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace")))
            if m is None:
                some[:] = False
                lang, score = np.full(len(some), "und", dtype=object), np.zeros(len(some))
            else:
                lang, score = m.decide(m.margins(texts))
                lang[~some], score[~some] = "und", 0.0
            rows = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    return predict(docs, fit(docs.where("NOT held_out")), ["doc_id", "held_out"])
