"""Language identification from averaged hashed subword embeddings.

A text becomes the byte n-grams (2 to 4 bytes) of its lower-cased words, each
hashed to a bucket; the mean of the buckets' embeddings goes through a linear
softmax layer.  Embeddings and layer are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows.  A temperature and a
rejection threshold are then calibrated on a part of the sample that the
descent has not seen: a text whose calibrated confidence is below what all but
``reject_share`` of the rightly predicted calibration texts reach is rejected.

The model is embeddings x layer folded into one (buckets x languages) table of
fixed size; prediction is a single pass over the whole texts, without a
shuffle.  Defined cases: a null text or one without a letter is ``und`` with
score 0 and rejected; with no labelled rows everything is ``und``; a null id
counts as not held out and is never learned from; rows with a null language
are predicted but not learned from; repeated rows get equal predictions; other
columns are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory

BUCKETS = 1 << 14
GRAMS = (2, 3, 4)
DIMS = 16
SAMPLE_ROWS = 3000  # labelled rows to learn from, at most
UNKNOWN = "und"
SLICE = 1 << 20  # bytes hashed at a time

# letters keep their byte, other ASCII is a gap
_LETTER = np.array([c if chr(c).isalpha() or c >= 128 else 32 for c in range(256)], dtype=np.uint8)


def features(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text."""
    b = _LETTER[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    out = np.zeros(BUCKETS)
    for lo in range(0, len(b), SLICE):
        x = b[lo:lo + SLICE + GRAMS[-1] - 1].astype(np.uint32)
        for n in GRAMS:
            m = min(len(x) - n + 1, SLICE)
            if m <= 0:
                continue
            code = x[:m].copy()
            inner = np.zeros(m, dtype=bool)
            for k in range(1, n):
                code = code << np.uint32(8) | x[k:k + m]
                if k < n - 1:
                    inner |= x[k:k + m] == 32
            # a gap may open or end an n-gram, not stand inside it
            code = code[~inner & ((x[:m] != 32) | (x[n - 1:n - 1 + m] != 32))]
            code = (code + np.uint32(n)) * np.uint32(2654435761)
            out += np.bincount(code >> np.uint32(18), minlength=BUCKETS)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages): embeddings x layer, over the temperature
    bias: np.ndarray
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        c = features(text)
        z = c @ self.table / max(1.0, c.sum()) + self.bias
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best])


Rows = list[tuple[np.ndarray, np.ndarray]]  # per text: buckets and their counts


def _dense(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """The buckets in use and the texts' shares of them."""
    used = np.unique(np.concatenate([at for at, _ in rows]))
    x = np.zeros((len(rows), len(used)), dtype=np.float32)
    for i, (at, n) in enumerate(rows):
        x[i, np.searchsorted(used, at)] = n / max(1, n.sum())
    return used, x


def fit(rows: Rows, langs: list[str], epochs: int = 20, rate: float = 0.5, batch: int = 32,
        calibration: float = 0.2, reject_share: float = 0.001, seed: int = 7) -> LanguageModel:
    """Train on rows of n-gram counts and their languages."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    rng = np.random.default_rng(seed)
    y = np.array([names.index(v) for v in langs])
    order = rng.permutation(len(y))
    held = order[:int(calibration * len(y))]
    rest = order[len(held):]
    emb = rng.normal(0, 1, (BUCKETS, DIMS)).astype(np.float32)
    layer = np.zeros((DIMS, len(names)), dtype=np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    g_emb, g_layer = np.full((BUCKETS, 1), 1e-8, np.float32), np.full_like(layer, 1e-8)
    for _ in range(epochs * -(-len(rest) // batch)):
        at = rng.choice(rest, min(batch, len(rest)), replace=False)
        used, xs = _dense([rows[i] for i in at])
        h = xs @ emb[used]
        z = h @ layer + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(at)), y[at]] -= 1
        p /= len(at)
        d_layer, d_emb = h.T @ p, xs.T @ (p @ layer.T)
        g_layer += d_layer * d_layer  # steps shrink with the squared gradients so far
        g_emb[used] += (d_emb * d_emb).mean(axis=1, keepdims=True)
        layer -= rate * d_layer / np.sqrt(g_layer)
        emb[used] -= 0.2 * rate * d_emb / np.sqrt(g_emb[used])
        bias -= 0.1 * rate * p.sum(axis=0)
    table = emb @ layer
    check = held if len(held) else rest
    z = np.stack([n @ table[at] / max(1, n.sum()) for at, n in (rows[i] for i in check)]) + bias
    right = z.argmax(axis=1) == y[check]

    def softmax(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    temps = np.geomspace(0.25, 8, 41)
    loss = [-np.log(np.maximum(softmax(t)[np.arange(len(check)), y[check]], 1e-12)).mean() for t in temps]
    t = float(temps[int(np.argmin(loss))])
    sure = softmax(t).max(axis=1)[right]
    # half of the lowest confidence that is kept: unseen texts spread wider than a small calibration set
    threshold = float(min(0.5, 0.5 * np.quantile(sure, reject_share))) if len(sure) else 0.0
    return LanguageModel(names, (table / t).astype(np.float64), (bias / t).astype(np.float64),
                         max(threshold, 1.0 / len(names)) if len(names) > 1 else threshold)


def _counted(batches):
    for b in batches:
        buckets, n = [], []
        for t in b.column(0).to_pylist():
            c = features(t)
            at = np.flatnonzero(c)
            buckets.append(at.astype(np.int32))
            n.append(c[at].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(buckets, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32())), b.column(1)],
            names=["buckets", "n", "lang"])


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, **options) -> LanguageModel:
    """Fit on labelled rows that are not held out: of the distinct ones the
    ``sample_rows`` with the smallest hash.  Only their bucket counts (at most
    BUCKETS a row) come to the driver."""
    rows = (docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
            .select(F.xxhash64(F.col("doc_id").cast("string"), "lang").alias("h"), F.col("text").cast("string").alias("text"),
                    F.col("lang").cast("string").alias("lang")))
    smallest = rows.select("h").distinct().orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if smallest is None:
        return fit([], [], **options)
    sample = rows.filter(F.col("h") <= smallest).groupBy("h").agg(F.min(F.struct("text", "lang")).alias("r")).select("r.*")
    got = sample.mapInArrow(_counted, "buckets array<int>, n array<int>, lang string").toArrow()
    lists = list(zip((x.values.to_numpy() for x in got.column("buckets")), (x.values.to_numpy() for x in got.column("n")),
                     got.column("lang").to_pylist(), strict=True))
    lists.sort(key=lambda r: (r[2], len(r[0]), int(r[1].sum()), r[0].tobytes(), r[1].tobytes()))  # whatever the partitions
    model = fit([(at, n) for at, n, _ in lists], [lang for _, _, lang in lists], **options)
    del got, lists
    release_memory()  # the driver's, whose later steps would hold the sample's pages
    return model


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted) of every row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64()),
                 pa.array([x != UNKNOWN and s >= model.threshold for x, s in got], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "accepted"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, all columns kept."""
    names = docs.columns

    def run(batches):
        at = names.index("text")
        for b in batches:
            keep = []
            for t in b.column(at):
                lang, s = model.predict(t.as_py())
                keep.append(lang != UNKNOWN and s >= model.threshold)
            yield b.filter(pa.array(keep, pa.bool_()))
        release_memory()

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Train on ``docs`` and predict every row: (doc_id, held_out, lang_pred,
    score, accepted)."""
    out = predict(docs, train(docs, sample_rows))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
