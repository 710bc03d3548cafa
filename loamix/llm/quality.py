"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters run over the bytes of the whole text; their responses are
max-pooled in overlapping chunks of 512 bytes, and the means and maxima over all
chunks combine into one probability.

The model is fitted on the driver, on at most PER_CLASS labelled texts of each
class of at most LONGEST characters (both documented bounds); scoring reads
every text to its end and holds one block of a batch at a time.

Defined cases: a null or empty text scores as one chunk of zero bytes; without
labels of both classes every score is the share of label 1 (0.5 without any);
labels other than 0 and 1 are ignored; an empty table gives an empty result;
further columns pass through `accepted`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamix.llm.common import Shared, fold, numbered, sliced, utf8
from loamix.llm.sampling import sample

PER_CLASS = 1500
LONGEST = 8000
HALF = 256
WIDTH = 6
FILTERS = 16
#: Bytes that pass through the filters at a time.
BLOCK = 1 << 18


def padded(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each filled up with zeros to whole halves of chunks, and the halves of each text."""
    sizes = np.diff(at)
    halves = (sizes + WIDTH - 1 + HALF - 1) // HALF
    starts = np.concatenate([[0], np.cumsum(halves)]) * HALF
    flat = np.zeros(int(starts[-1]), np.uint8)
    for i, size in enumerate(sizes.tolist()):
        flat[starts[i] : starts[i] + size] = raw[at[i] : at[i + 1]]
    return flat, halves


def responses(flat: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Filter responses at every place: sums of one table row per byte of the window."""
    tail = np.concatenate([flat, np.zeros(WIDTH, np.uint8)])
    out = table[0][flat]
    for j in range(1, WIDTH):
        out += table[j][tail[j : j + len(flat)]]
    out[(ends[:, None] - np.arange(1, WIDTH)).ravel()] = table[:, 0].sum(axis=0)  # windows that reach into the next text
    return out


@dataclass
class Net:
    table: np.ndarray  # (WIDTH, 256, FILTERS)
    dense: np.ndarray  # (2 * FILTERS,)
    bias: float
    constant: float | None = None

    def pooled(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(texts, 2 * FILTERS): mean and maximum over chunks."""
        flat, halves = padded(raw, at)
        bounds = np.concatenate([[0], np.cumsum(halves)])
        ends = bounds[1:] * HALF
        top = np.empty((int(bounds[-1]), FILTERS), np.float32)
        for a in range(0, len(flat), BLOCK):
            b = min(len(flat), a + BLOCK)
            more = np.concatenate([flat[a:b], flat[b : b + WIDTH]])  # windows at the end of the block read on
            own = ends[(ends > a) & (ends <= b)] - a
            seen = responses(more, own, self.table)[: b - a]
            top[a // HALF : b // HALF] = seen.reshape(-1, HALF, FILTERS).max(axis=1)
        return chunk_pool(top, bounds)

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        z = self.pooled(raw, at).astype(np.float64) @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def chunk_pool(top: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Halves to overlapping chunks of two by their maximum, then mean and maximum over a text's chunks."""
    chunk = top.copy()
    inner = np.ones(len(top), bool)
    inner[bounds[1:] - 1] = False  # a text's last half has no follower
    at = np.flatnonzero(inner)
    chunk[at] = np.maximum(top[at], top[at + 1])
    single = np.diff(bounds) == 1
    chunk = np.maximum(chunk, 0)
    drop = np.zeros(len(top), bool)
    drop[bounds[1:][~single] - 1] = True
    kept = chunk[~drop]
    counts = np.where(single, 1, np.diff(bounds) - 1)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.concatenate([np.add.reduceat(kept, starts) / counts[:, None], np.maximum.reduceat(kept, starts)], axis=1)


def fit(rows: list[tuple[str, int]], steps: int = 1300, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Net:
    """Adam on the logistic loss for about that many batches; gradients flow through the places of the maxima only."""
    labels = np.array([int(y) for _, y in rows], np.float64)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
    dense = rng.normal(0, 0.3, 2 * FILTERS)
    net = Net(table, dense, 0.0)
    if len(set(labels.tolist())) < 2:
        net.constant = float(labels.mean()) if len(labels) else 0.5
        return net
    data = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t, _ in rows]
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    state = {k: [np.zeros(np.shape(v)), np.zeros(np.shape(v))] for k, v in (("t", table), ("d", dense), ("b", 0.0))}
    step = 0
    epochs = max(1, round(steps * batch / len(data)))
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        pace = rate * (1 - epoch / epochs)
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            at = np.concatenate([[0], np.cumsum([len(data[j]) for j in part])])
            flat, halves = padded(np.concatenate([data[j] for j in part]), at)
            bounds = np.concatenate([[0], np.cumsum(halves)])
            seen = responses(flat, bounds[1:] * HALF, net.table).reshape(-1, HALF, FILTERS)
            where = seen.argmax(axis=1)
            top = np.take_along_axis(seen, where[:, None, :], 1)[:, 0]
            x = chunk_pool(top, bounds).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(x @ net.dense + net.bias, -40, 40)))
            slope = (p - labels[part]) * weight[part] / len(part)
            grad_x = slope[:, None] * net.dense
            grad_t = table_gradient(flat, top, where, bounds, grad_x, net.table)
            step += 1
            net.table = net.table - adam(state["t"], grad_t, step, pace).astype(np.float32)
            net.dense = net.dense - adam(state["d"], x.T @ slope + 1e-4 * net.dense, step, pace)
            net.bias -= float(adam(state["b"], slope.sum(), step, pace))
    return net


def table_gradient(flat, top, where, bounds, grad_x, table) -> np.ndarray:
    """Gradient of the filter table from that of the pooled vectors."""
    tail = np.concatenate([flat, np.zeros(WIDTH, np.uint8)])
    rows, columns, values = [], [], []
    for n, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        own = top[a:b]
        chunks = max(1, b - a - 1)
        pick = np.arange(chunks)[:, None] + ((own[1 : chunks + 1] > own[:chunks]) if b - a > 1 else np.zeros((1, FILTERS), int))
        value = np.take_along_axis(own, pick, 0)
        grad = np.broadcast_to(grad_x[n, :FILTERS] / chunks, value.shape).copy()
        best = value.argmax(axis=0)
        grad[best, np.arange(FILTERS)] += grad_x[n, FILTERS:]
        grad[value <= 0] = 0
        rows.append((pick + a).ravel())
        columns.append(np.tile(np.arange(FILTERS), chunks))
        values.append(grad.ravel())
    row, column, value = np.concatenate(rows), np.concatenate(columns), np.concatenate(values)
    place = row * HALF + where[row, column]
    out = np.zeros(table.shape)
    for j in range(WIDTH):
        np.add.at(out[j], (tail[place + j], column), value)
    return out


def adam(moments: list, grad, step: int, rate: float):
    moments[0] = 0.9 * moments[0] + 0.1 * grad
    moments[1] = 0.999 * moments[1] + 0.001 * np.square(grad)
    return rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)


def trained(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST) -> Net:
    """A net fitted on labelled rows of folds 0 and 2 of 3."""
    own = labels.filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), 3) != 1))
    return fit(sample(own.select("doc_id", F.col("quality").cast("int").alias("label")), docs, per_class, longest))


def scored(docs: DataFrame, net: Net, columns: list[str], name: str = "score") -> DataFrame:
    """`columns` of docs with the score of the text, which travels once; one narrow pass. Column names hold no dots."""
    shared = Shared(docs.sparkSession, net)
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)
    rows = docs.select(*columns, *([] if "text" in columns else ["text"]))

    def run(batches):
        model = shared.get()
        for batch in batches:
            for part in sliced(batch, "text"):
                values = pa.array(model.score(*utf8(part.column(part.schema.get_field_index("text")))))
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in columns], values], [*columns, name])

    return rows.mapInArrow(run, f"{schema}{name} double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), trained(docs, labels), ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs whose score is at least `least`."""
    inner, names = numbered(docs)
    name_of = dict(zip(docs.columns, names))
    whole = inner.withColumnRenamed(name_of["text"], "text")
    name_of["text"] = "text"
    out = scored(whole, trained(docs.select("doc_id", "text"), labels), list(name_of.values()), "score")
    return out.filter(F.col("score") >= least).select(*[F.col(x).alias(c) for c, x in name_of.items()])
