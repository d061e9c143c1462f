"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it.  Learned
filters run over two pictures of each chunk: the embeddings of its bytes, and
the plane that says, for each lag, which bytes equal the one that far before
them.  Every filter is max-pooled (and averaged) over the chunk, chunks are
max-pooled and averaged over the document, and one logistic unit gives the
probability of label 1.  A window of the plane is eight bits, so its learned
responses are a table of 256 rows, and a chunk needs only the counts of its
windows.

Training: plain back-propagation on the driver over a bounded sample (at most
``PER_CLASS`` rows a class, of each text a run of at most ``MAX_CHARS`` characters), from
rows outside the held-out fold only, weighted back to the true class shares.
Scoring covers every byte of every text on the executors.

Defined results: a null text counts as empty and gets the score of one empty
chunk; without labelled rows of both classes the score is the smoothed share
of label 1; empty tables give empty results; only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandgraph.llm.common import map_rows, texts_of
from strandgraph.llm.sample import labelled_texts

CHUNK, OVERLAP = 256, 32
STEP = CHUNK - OVERLAP
DIM, WIDTH, STRIDE, FILTERS = 6, 8, 4, 16
PLACES = (CHUNK - WIDTH) // STRIDE + 1
LAGS, PLANE_FILTERS = range(2, 49), 4
FEATURES = 2 * FILTERS + 2 * PLANE_FILTERS
BITS = (np.arange(256)[:, None] >> np.arange(7, -1, -1) & 1).astype(np.float32)
#: Bounds of the training sample: rows of label 0 and 1, characters of a text.
PER_CLASS, MAX_CHARS = (600, 900), 10_000
#: Passes over a full sample; a smaller sample gets more.
EPOCHS, RATE, BATCH_CHUNKS = 8, 0.02, 1000


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(chunks as rows of bytes padded with 0, index of each text's first chunk)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.maximum(1, -(-(sizes - OVERLAP) // STEP))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    room = (counts - 1) * STEP + CHUNK
    begin = np.concatenate([[0], np.cumsum(room)[:-1]])
    flat = np.zeros(int(room.sum()), dtype=np.uint8)
    for t, at in zip(texts, begin, strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
    starts = np.repeat(begin, counts) + STEP * (np.arange(int(counts.sum())) - np.repeat(first, counts))
    view = np.lib.stride_tricks.sliding_window_view(flat, CHUNK)
    return view[starts], first


def plane_counts(chunks: np.ndarray) -> np.ndarray:
    """How often each eight-bit window (stride 4) occurs in a chunk's plane of equal bytes, summed over the lags and averaged over the places."""
    n = len(chunks)
    out = np.zeros((n, 256), dtype=np.float32)
    used = chunks != 0
    base = (np.arange(n) << 8)[:, None]
    for lag in LAGS:
        same = (chunks[:, lag:] == chunks[:, :-lag]) & used[:, lag:]
        for shift in (0, 4):
            codes = np.packbits(same[:, shift : shift + (same.shape[1] - shift) // 8 * 8], axis=1)
            out += np.bincount((base + codes).ravel(), minlength=n << 8).reshape(n, 256)
    return out * len(LAGS) / out.sum(axis=1, keepdims=True)


class ByteCnn:
    """Weights and the forward pass."""

    def __init__(self, rng: np.random.Generator | None = None, prior: float = 0.5):
        rng = rng or np.random.default_rng(7)
        self.prior, self.trained = prior, False
        self.w = {
            "embed": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "filters": rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "plane": np.abs(rng.normal(0, 8**-0.5, (8, PLANE_FILTERS))).astype(np.float32),
            "plane_bias": np.full(PLANE_FILTERS, -1, np.float32),
            "top": np.zeros(2 * FEATURES, np.float32),
            "shift": np.zeros(1, np.float32),
        }

    def convolve(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows as rows, filter responses before the rectifier)."""
        x = self.w["embed"][chunks].reshape(len(chunks), CHUNK * DIM)
        windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH * DIM, axis=1)[:, :: STRIDE * DIM]
        windows = windows.reshape(-1, WIDTH * DIM)
        return windows, (windows @ self.w["filters"] + self.w["bias"]).reshape(len(chunks), PLACES, FILTERS)

    def plane_features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(largest and mean response of each plane filter, the window of the largest, the table of responses)."""
        table = np.maximum(BITS @ self.w["plane"] + self.w["plane_bias"], 0)
        order = np.argsort(-table, axis=0, kind="stable")
        peak = np.stack([order[:, k][(counts[:, order[:, k]] > 0).argmax(axis=1)] for k in range(PLANE_FILTERS)], axis=1)
        return np.concatenate([table[peak, np.arange(PLANE_FILTERS)], counts @ table], axis=1), peak, table

    def chunk_features(self, chunks: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(chunks), 1024):
            part = chunks[at : at + 1024]
            active = np.maximum(self.convolve(part)[1], 0)
            parts.append(np.concatenate([active.max(axis=1), active.mean(axis=1), self.plane_features(plane_counts(part))[0]], axis=1))
        return np.concatenate(parts)

    @staticmethod
    def pool(features: np.ndarray, first: np.ndarray) -> np.ndarray:
        counts = np.diff(np.append(first, len(features)))[:, None]
        return np.concatenate([np.maximum.reduceat(features, first), np.add.reduceat(features, first) / counts], axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 of each text; texts are taken in groups so that memory stays bounded."""
        if not self.trained:
            return np.full(len(texts), self.prior)
        out, group, size = [], [], 0
        for i, t in enumerate(texts):
            group.append(t)
            size += len(t) + CHUNK
            if size > 1 << 20 or i == len(texts) - 1:
                out.append(self._score(group))
                group, size = [], 0
        return np.concatenate(out) if out else np.zeros(0)

    def _score(self, texts: list[bytes]) -> np.ndarray:
        if len(texts) == 1 and len(texts[0]) > 1 << 22:
            return self._score_long(texts[0])
        chunks, first = chunks_of(texts)
        z = self.pool(self.chunk_features(chunks), first) @ self.w["top"] + self.w["shift"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def _score_long(self, text: bytes) -> np.ndarray:
        """A very long text in slices of whole steps: its chunks are the same, only made bit by bit."""
        count = max(1, -(-(len(text) - OVERLAP) // STEP))
        most, total, n = None, 0.0, 0
        for k in range(0, count, 4096):
            here = min(4096, count - k)
            piece = text[k * STEP : (k + here - 1) * STEP + CHUNK]
            f = self.chunk_features(chunks_of([piece])[0][:here])
            most = f.max(axis=0) if most is None else np.maximum(most, f.max(axis=0))
            total, n = total + f.sum(axis=0, dtype=np.float64), n + here
        z = np.concatenate([most, (total / n)]) @ self.w["top"] + self.w["shift"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def train(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> None:
        """Adam on the weighted logistic loss."""
        self.trained = True
        share = float((weight * y).sum() / weight.sum())
        self.w["shift"][:] = np.log((share + 1e-3) / (1 - share + 1e-3))
        self.w["top"] = np.random.default_rng(3).normal(0, 0.05, 2 * FEATURES).astype(np.float32)
        state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}
        rng, step = np.random.default_rng(11), 0
        cut = [(*chunks_of([t]),) for t in texts]
        planes = [plane_counts(c) for c, _ in cut]
        epochs = max(EPOCHS, min(5 * EPOCHS, 1200 * EPOCHS // len(texts)))
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            batch, size = [], 0
            for n, i in enumerate(order := rng.permutation(len(texts))):
                batch.append(i)
                size += len(cut[i][0])
                if size >= BATCH_CHUNKS or n == len(order) - 1:
                    step += 1
                    for k, g in self._gradient([cut[j][0] for j in batch], [planes[j] for j in batch], y[batch], weight[batch]).items():
                        m, v = state[k]
                        m += 0.1 * (g - m)
                        v += 0.01 * (g * g - v)
                        self.w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
                    batch, size = [], 0

    def _gradient(self, parts: list[np.ndarray], planes: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        chunks = np.concatenate(parts)
        counts = np.array([len(p) for p in parts])
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        owner = np.repeat(np.arange(len(parts)), counts)
        windows, z = self.convolve(chunks)
        active = np.maximum(z, 0)
        peak = active.argmax(axis=1)
        shares = np.concatenate(planes)
        plane, plane_peak, table = self.plane_features(shares)
        features = np.concatenate([active.max(axis=1), active.mean(axis=1), plane], axis=1)
        pooled = self.pool(features, first)
        logit = pooled @ self.w["top"] + self.w["shift"]
        error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight / weight.sum()).astype(np.float32)
        d_pool = error[:, None] * self.w["top"]
        at_max = features == pooled[:, :FEATURES][owner]
        ties = np.add.reduceat(at_max.astype(np.float32), first)
        d_feat = at_max * (d_pool[:, :FEATURES] / ties)[owner] + (d_pool[:, FEATURES:] / counts[:, None])[owner]
        d_z = np.repeat(d_feat[:, None, FILTERS : 2 * FILTERS] / PLACES, PLACES, axis=1)
        rows, cols = np.indices(peak.shape)
        d_z[rows, peak, cols] += d_feat[:, :FILTERS]
        d_z *= z > 0
        flat = d_z.reshape(-1, FILTERS)
        d_x = (flat @ self.w["filters"].T).reshape(-1, WIDTH, DIM)
        d_embed = np.zeros_like(self.w["embed"])
        for k in range(WIDTH):
            at = chunks[:, k : k + STRIDE * PLACES : STRIDE][:, :PLACES].ravel()
            for d in range(DIM):
                d_embed[:, d] += np.bincount(at, weights=d_x[:, k, d], minlength=256)
        d_plane = d_feat[:, 2 * FILTERS :]
        d_table = shares.T @ d_plane[:, PLANE_FILTERS:]
        for k in range(PLANE_FILTERS):
            d_table[:, k] += np.bincount(plane_peak[:, k], weights=d_plane[:, k], minlength=256)
        d_table *= table > 0
        decay = 1e-4
        return {
            "plane": BITS.T @ d_table + decay * self.w["plane"],
            "plane_bias": d_table.sum(axis=0),
            "embed": d_embed,
            "filters": windows.T @ flat + decay * self.w["filters"],
            "bias": flat.sum(axis=0),
            "top": pooled.T @ error + decay * self.w["top"],
            "shift": error.sum(keepdims=True),
        }


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held_out: int = 0, per_class: tuple[int, int] = PER_CLASS, max_chars: int = MAX_CHARS) -> ByteCnn:
    """A network fitted on a bounded sample of the rows outside the held-out fold."""
    sample, counts = labelled_texts(docs, labels, label, modulus, held_out, per_class, max_chars)
    every = sum(counts.values())
    model = ByteCnn(prior=(counts.get(1, 0) + 1) / (every + 2))
    y = np.array([b for _, b in sample], dtype=np.float32)
    if len(set(y.tolist())) == 2:
        taken = {c: max(1, int((y == c).sum())) for c in (0, 1)}
        weight = np.array([counts[int(c)] / taken[int(c)] for c in y], dtype=np.float32)
        model.train([t.encode("utf-8") for t, _ in sample], y, weight)
    return model


def score_quality(docs: DataFrame, model: ByteCnn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and score."""

    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = model.score([t.encode("utf-8") for t in texts_of(batch)])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [id_col, "score"])

        return step

    narrow = docs.select(id_col, text_col)
    return map_rows(narrow, build, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, score double")


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = score_quality(docs, train_quality(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: ByteCnn, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the network accepts, with all their columns."""
    at = docs.columns.index(text_col)

    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = model.score([t.encode("utf-8") for t in texts_of(batch, at)])
            return batch.filter(pa.array(scores >= threshold))

        return step

    return map_rows(docs, build, docs.schema)
