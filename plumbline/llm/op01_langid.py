"""Language identification by a byte convolutional network, trained in numpy and applied to fixed-length windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .textbytes import LOWER, pieces

WINDOW = 256
#: Widths of the filters, and how many there are of each.
WIDTHS, FILTERS = (2, 4), 16
#: Labelled texts that the network is fitted on, for each language; every label that a text has is learned.
TEXTS_PER_LANG = 300
#: Windows taken from each of those texts.
WINDOWS_PER_TEXT = 8
_PREDICTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def windows(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """WINDOW bytes from each start, zeros beyond the end; A-Z and the two-byte capitals of Latin-1 are lower-cased."""
    padded = np.zeros(len(buf) + WINDOW + 1, np.uint8)
    low = LOWER[buf]
    big = np.flatnonzero((low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97) & (low[:-1] == 0xC3)) + 1
    low[big] += 0x20
    padded[: len(buf)] = low
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[starts]


class ByteConvNet:
    """Filters over bytes of several widths, each max-pooled over the window, then a softmax layer."""

    def __init__(self, labels: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels = labels
        #: weight of a byte at a filter's k-th place
        self.filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.dense = rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each filter's largest value in each window, after a ReLU, and where it is."""
        out, where = [], []
        for f, w in zip(self.filters, WIDTHS, strict=True):
            n = x.shape[1] - w + 1
            value = f[0][x[:, :n]]
            for k in range(1, w):
                value += f[k][x[:, k : k + n]]
            at = value.argmax(1)
            out.append(np.take_along_axis(value, at[:, None], 1)[:, 0])
            where.append(at)
        return np.maximum(np.concatenate(out, 1), 0), where

    def probabilities(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.dense + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 0) -> None:
        """Adam on the weighted cross-entropy; a filter's gradient only reaches the bytes at its maximum."""
        rng = np.random.default_rng(seed)
        params = [*self.filters, self.dense, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                b = x[part]
                hidden, where = self.pooled(b)
                d = self.probabilities(hidden)
                d[np.arange(len(b)), y[part]] -= 1
                d *= (weight[part] / len(b))[:, None]
                back = (d @ self.dense.T) * (hidden > 0)
                grads = []
                for i, (w, at) in enumerate(zip(WIDTHS, where, strict=True)):
                    g = np.zeros_like(self.filters[i])
                    mine = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(w):
                        np.add.at(g[k], (np.take_along_axis(b, at + k, 1), np.arange(FILTERS)[None]), mine)
                    grads.append(g)
                grads += [hidden.T @ d, d.sum(0)]
                t += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def compiled(self) -> ByteConvNet:
        """For prediction, the weights of two neighbouring bytes are summed beforehand: a table over byte pairs."""
        self.pairs = []
        for f, w in zip(self.filters, WIDTHS, strict=True):
            self.pairs.append([(f[k][:, None] + f[k + 1][None]).reshape(65536, FILTERS) for k in range(0, w, 2)])
        return self

    def predict(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label number and score of each text buf[offs[i]:offs[i + 1]], over all its windows; a window counts by its
        bytes. The score is the mean probability of the label."""
        size = np.diff(offs)
        many = np.maximum(-(-size // WINDOW), 1)
        row = np.repeat(np.arange(len(size)), many)
        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        start = offs[row] + step * WINDOW
        length = np.minimum(offs[row + 1] - start, WINDOW)
        total = np.zeros((len(size), len(self.labels)))
        for lo in range(0, len(row), 64):
            part = slice(lo, lo + 64)
            x = windows(buf[start[lo] : start[part][-1] + WINDOW], start[part] - start[lo])
            x = np.where(np.arange(WINDOW) < length[part, None], x, 0)
            two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
            hidden = []
            for tables, w in zip(self.pairs, WIDTHS, strict=True):
                n = WINDOW - w + 1
                value = tables[0][two[:, :n]]
                for k in range(1, w // 2):
                    value += tables[k][two[:, 2 * k : 2 * k + n]]
                hidden.append(value.max(1))
            p = self.probabilities(np.maximum(np.concatenate(hidden, 1), 0))
            np.add.at(total, row[part], p * length[part, None])
        share = total / np.maximum(total.sum(1, keepdims=True), 1e-12)
        return share.argmax(1), share.max(1)


def held_out(doc_id: str | Column) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, seed: int = 0) -> ByteConvNet | None:
    """A network fitted on a sample of the labelled, not held-out rows of docs (doc_id, text, lang), about
    TEXTS_PER_LANG of each label (all of a label with fewer); None without any.

    The sample is by a hash of id and text, so that rows which share an id, or have none, are drawn apart; its windows lie
    evenly over each whole text. Repeated rows of one id and text count once each, and are in or out together. What reaches the driver grows with the number of labels only.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out("doc_id")).select("doc_id", "text", "lang")
    per = known.groupBy("lang").count().orderBy("lang").collect()
    if not per:
        return None
    share = F.create_map(*(x for r in per for x in (F.lit(r["lang"]), F.lit(min(1.0, TEXTS_PER_LANG / r["count"])))))
    dice = (F.xxhash64("doc_id", "text", F.lit(seed)).bitwiseAND((1 << 40) - 1)) / float(1 << 40)
    chars = F.length("text")
    at = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_PER_TEXT - 1)), lambda k: F.substring(F.col("text"), (1 + (k * chars / WINDOWS_PER_TEXT)).cast("int"), F.lit(WINDOW)))
    rows = (
        known.where(dice < share[F.col("lang")])
        .select("lang", F.array_distinct(at).alias("parts"), F.xxhash64("doc_id", "text").alias("by"))
        .orderBy("by", "lang")
        .limit(2 * TEXTS_PER_LANG * len(per))
        .collect()
    )
    labels = sorted(r["lang"] for r in per)
    number = {x: i for i, x in enumerate(labels)}
    x, y = [], []
    for r in rows:
        for part in r["parts"]:
            raw = np.frombuffer(part.encode()[:WINDOW], np.uint8)
            if len(raw) >= 8:
                x.append(windows(raw, np.array([0]))[0])
                y.append(number[r["lang"]])
    if not x:
        return None
    y = np.array(y)
    net = ByteConvNet(labels, seed)
    share_of = np.bincount(y, minlength=len(labels))
    net.fit(np.array(x), y, (len(y) / len(labels) / np.maximum(share_of, 1))[y].astype(np.float32), seed=seed)
    return net


def language(text: str | Column, net: ByteConvNet | None) -> Column:
    """Struct for a text column: lang (a learned label; `und` if the text is null or has no letter, or nothing was
    learned) and score (0 to 1; 0 for und)."""
    text = F.col(text) if isinstance(text, str) else text
    und = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    if net is None:
        return und

    @F.arrow_udf(_PREDICTED)
    def run(texts: pa.Array) -> pa.Array:
        if not hasattr(net, "pairs"):
            net.compiled()
        found = [net.predict(p.buf, p.offs) for p in pieces(texts)]
        label = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        score = np.concatenate([x for _, x in found]) if found else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(net.labels, pa.string()).take(pa.array(label)), pa.array(np.clip(score, 0, 1))], ["lang", "score"])

    return F.when(F.coalesce(text, F.lit("")).rlike(r"\p{L}"), run(F.coalesce(text, F.lit("")))).otherwise(und)


def identify(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, held_out, lang, score for every row of docs (doc_id, text, lang). The label of a row is never an input
    of its prediction. Repeated rows give a row each, other columns are ignored, an empty table gives an empty one."""
    net = train(docs, seed)
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), language("text", net).alias("m")).select("doc_id", "held_out", "m.lang", "m.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", F.col("lang").alias("lang_pred"), "score")
