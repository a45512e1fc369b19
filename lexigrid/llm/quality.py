"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages; only the document has a label. Each passage
is encoded, gated attention weighs the encodings, and the weighted sum is
scored (Ilse, Tomczak, Welling 2018). The passages' weights say where a
document's quality shows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.spans import Words, flat, slices
from lexigrid.shared import bound_batches

#: Words in a passage.
PASSAGE = 128
#: Labelled documents that training uses at most, the first by a hash of the
#: id; what reaches the driver is bounded by it. Scoring covers all documents.
TRAIN_DOCS = 6000

# Byte classes of a text.
CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "newline": b"\n",
    "stop": b".,;:",
    "shout": b"!?",
    "bar": b"|",
    "symbol": b"#$%&*@^~<>{}[]\\/=+_",
    "quote": b"\"'()-`",
    "high": range(128, 256),
}
N_FEATURES = len(CLASSES) + 13


def encode(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, number of passages of each row). A row
    without words is one passage of zeros."""
    w = Words(data, off)
    count = np.diff(w.first)
    bags = np.maximum(1, -(-count // PASSAGE))
    x = np.zeros((int(bags.sum()), N_FEATURES), np.float32)
    if not len(w):
        return x, bags
    index = np.arange(len(w)) - w.first[w.doc]
    passage = (np.cumsum(bags) - bags)[w.doc] + index // PASSAGE
    heads = np.flatnonzero(index % PASSAGE == 0)  # first word of each passage
    at = passage[heads]
    from_, to = w.start[heads], np.append(w.start[heads[1:]], len(data))
    last = np.append(w.doc[heads[1:]] != w.doc[heads[:-1]], True)
    to = np.where(last, off[w.doc[heads] + 1], to)
    size = np.maximum(1, to - from_).astype(np.float32)
    for k, members in enumerate(CLASSES.values()):
        table = np.zeros(256, np.int32)
        table[list(members)] = 1
        total = np.append(0, np.cumsum(table[data]))
        x[at, k] = (total[to] - total[from_]) / size
    k = len(CLASSES)
    n = np.bincount(passage, minlength=len(x)).astype(np.float32)
    n1 = np.maximum(n, 1)
    mean = lambda v: np.bincount(passage, weights=v, minlength=len(x)) / n1
    length = (w.end - w.start).astype(np.float64)
    letter = np.zeros(256, bool)
    letter[list(CLASSES["upper"]) + list(CLASSES["lower"]) + list(CLASSES["high"])] = True
    head, tail = data[w.start], data[w.end - 1]
    same = lambda d: np.append(np.zeros(min(d, len(w)), bool), (w.hash[d:] == w.hash[:-d]) & (w.doc[d:] == w.doc[:-d]))
    x[:, k] = np.log1p(mean(length))
    x[:, k + 1] = np.log1p(np.sqrt(np.maximum(0, mean(length**2) - mean(length) ** 2)))
    x[:, k + 2] = np.log1p(n) / 5
    x[:, k + 3] = mean(same(1))
    x[:, k + 4] = mean(same(2))
    x[:, k + 5] = mean((head >= 65) & (head <= 90))
    x[:, k + 6] = mean(~letter[head])
    x[:, k + 7] = mean(~letter[tail])
    x[:, k + 8] = mean(length == 1)
    x[:, k + 9] = mean(length > 14)
    # distinct words of a passage: count unique (passage, word) pairs
    order = np.lexsort((w.hash, passage))
    p, h = passage[order], w.hash[order]
    new = np.append(True, (p[1:] != p[:-1]) | (h[1:] != h[:-1]))
    x[:, k + 10] = np.bincount(p, weights=new, minlength=len(x)) / n1
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(p)))
    top = np.zeros(len(x))
    np.maximum.at(top, p[starts], runs)
    x[:, k + 11] = top / n1
    x[:, k + 12] = 1
    return x, bags


@dataclass
class Model:
    """mean, std: of the features; e: encoder; v, u: gates; a: attention; w: score."""

    params: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        p = self.params
        start = np.cumsum(bags) - bags
        x = np.clip((x - p["mean"]) / p["std"], -8, 8)
        h = np.tanh(x @ p["e"] + p["eb"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-np.clip(h @ p["u"], -30, 30)))
        s = (t * g) @ p["a"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, start), bags))
        att = s / np.repeat(np.add.reduceat(s, start), bags)
        z = np.add.reduceat(att[:, None] * h, start)
        y = 1 / (1 + np.exp(-np.clip(z @ p["w"] + p["b"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "att": att, "z": z, "y": y}

    def backward(self, f: dict[str, np.ndarray], bags: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss."""
        p, start = self.params, np.cumsum(bags) - bags
        dy = (f["y"] - label) / len(label)
        dz = np.repeat(dy[:, None] * p["w"], bags, axis=0)
        dh = f["att"][:, None] * dz
        da = (f["h"] * dz).sum(1)
        ds = f["att"] * (da - np.repeat(np.add.reduceat(f["att"] * da, start), bags))
        dtg = ds[:, None] * p["a"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh += dt @ p["v"].T + dg @ p["u"].T
        de = dh * (1 - f["h"] ** 2)
        return {"e": f["x"].T @ de, "eb": de.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ ds, "w": f["z"].T @ dy, "b": dy.sum(keepdims=True)}


def fit(x: np.ndarray, bags: np.ndarray, label: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 60, batch: int = 128, rate: float = 0.01, decay: float = 1e-4) -> Model:
    """Adam over shuffled batches of documents; the seed is fixed, so equal
    rows give an equal model. Without rows the score is one half."""
    rng = np.random.default_rng(7)
    n = x.shape[1]
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"mean": x.mean(0) if len(x) else np.zeros(n), "std": (x.std(0) if len(x) else np.ones(n)) + 1e-3, "e": init(n, hidden), "eb": np.zeros(hidden), "v": init(hidden, gate), "u": init(hidden, gate), "a": init(gate), "w": np.zeros(hidden), "b": np.zeros(1)}
    model = Model(p)
    if not len(label):
        return model
    rate_of = label.mean().clip(0.01, 0.99)
    p["b"][:] = np.log(rate_of / (1 - rate_of))
    start = np.cumsum(bags) - bags
    m, v, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        for i in range(0, len(order), batch):
            docs = order[i : i + batch]
            rows = np.concatenate([np.arange(start[d], start[d] + bags[d]) for d in docs])
            f = model.forward(x[rows], bags[docs])
            step += 1
            pace = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-5
            for k, g in model.backward(f, bags[docs], label[docs]).items():
                g = g + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def passages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, passages as one binary of floats) of each row."""
    for whole in batches:
        for b in slices(whole, "text"):
            x, bags = encode(*flat(b.column(b.schema.get_field_index("text"))))
            cut = np.append(0, np.cumsum(bags))
            yield pa.RecordBatch.from_pydict({"label": b.column(b.schema.get_field_index("label")), "x": pa.array([x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = TRAIN_DOCS, fold: int = 5) -> Model:
    """Fits on the labelled documents whose crc32(doc_id) mod ``fold`` is not
    0: at most max_docs of them, by hash. Of several labels of a document the
    largest counts; null labels and null ids are left out. Rows that share an
    id are each an example. Other columns are not looked at."""
    bound_batches(docs.sparkSession)
    crc = F.crc32(F.col("doc_id").cast("string"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc % fold != 0))
    known = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    chosen = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    got = rows.select("label", "text").mapInArrow(passages_of, "label double, x binary").toArrow()
    bags = np.array([len(v) // (4 * N_FEATURES) for v in got["x"].to_pylist()], np.int64)
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    y = got["label"].to_numpy()
    # rows arrive in any order; sort them so that reruns agree
    cut = np.append(0, np.cumsum(bags))
    order = sorted(range(len(y)), key=lambda i: (x[cut[i] : cut[i + 1]].tobytes(), y[i]))
    if order:
        x = np.concatenate([x[cut[i] : cut[i + 1]] for i in order])
    return fit(x, bags[order] if len(order) else bags, y[order] if len(order) else y)


def score(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """docs (its text only if asked for) with score: the model's probability of
    label 1 for the whole text. Null and empty texts are scored as one passage
    of zeros; repeated rows alike. A column ``score`` of docs is replaced; no
    other column is looked at. Map-only."""
    bound_batches(docs.sparkSession)
    docs = docs.drop("score")
    told = [c for c in docs.columns if keep_text or c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                x, bags = encode(*flat(b.column(b.schema.get_field_index("text"))))
                y = model.forward(x.astype(np.float64), bags)["y"]
                kept = [b.column(b.schema.get_field_index(c)) for c in told]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(y, pa.float64())], [*told, "score"])

    fields = "".join(f"`{c}` {t}, " for c, t in docs.dtypes if c in told)
    return docs.mapInArrow(run, f"{fields}score double")


def attend(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, passage, weight): the attention that each passage of
    docs(doc_id, text) gets, summing to 1 in a document. Null and empty texts
    are one passage; repeated rows each give theirs; other columns are not
    looked at."""
    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                x, bags = encode(*flat(b.column(b.schema.get_field_index("text"))))
                weight = model.forward(x.astype(np.float64), bags)["att"]
                ids = b.column(b.schema.get_field_index("doc_id")).take(pa.array(np.repeat(np.arange(b.num_rows), bags)))
                passage = np.arange(len(weight)) - np.repeat(np.cumsum(bags) - bags, bags)
                yield pa.RecordBatch.from_arrays([ids, pa.array(passage), pa.array(weight)], ["doc_id", "passage", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, passage bigint, weight double")
