"""Text quality by positive-unlabelled learning.

A small network is trained on trusted positives and unlabelled web text with the non-negative unbiased risk: the
unlabelled risk of being negative, less the positives' share of it, is kept from falling under zero. The share of
positives in the unlabelled text (class prior) is estimated from how far the unlabelled scores of a plain
positive-against-unlabelled model can be a mixture with the positive scores. Negative labels are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agroclime.llm import textvec as tv
from agroclime.llm.store import stored

SAMPLE = 20_000   # positives and unlabelled rows the model is fitted on at most, those with the smallest id hashes
HIDDEN, STEPS = 16, 600
NAMES = [
    "log_words", "log_bytes", "word_bytes", "distinct_words", "top_word", "repeat_next", "repeat_second", "repeat_line", "upper", "digit",
    "non_ascii", "space", "line_breaks", "stops", "commas", "marks", "pipes", "brackets", "mark_runs", "mark_tail", "tail_upper", "one_letter", "long_words", "no_letter",
]
_CLASS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t", "line_breaks": b"\n\r", "stops": b".", "commas": b",", "marks": b"!?$%&#*@=~^", "pipes": b"|\\/_", "brackets": b"(){}[]<>",
}


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_TABLES = {name: _table(chars) for name, chars in _CLASS.items()}


def text_features(column: pa.Array) -> np.ndarray:
    """(texts, features) of whole texts; an empty text has zeros."""
    raw, offsets = tv.text_bytes(column)
    words = tv.words_of(column)
    n, counts = len(column), np.diff(words.first)
    out = np.zeros((n, len(NAMES)))
    col = {name: i for i, name in enumerate(NAMES)}
    size = np.maximum(np.diff(offsets), 1)

    def per_byte(flag):
        total = np.concatenate(([0], np.cumsum(flag)))
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    for name, table in _TABLES.items():
        out[:, col[name]] = per_byte(table[raw])
    out[:, col["non_ascii"]] = per_byte(raw >= 128)
    mark = _TABLES["marks"][raw]
    runs = np.zeros(len(raw), bool)
    runs[1:] = mark[1:] & mark[:-1]
    out[:, col["mark_runs"]] = per_byte(runs)
    words_n = np.maximum(counts, 1)
    doc = np.repeat(np.arange(n), counts)
    share = lambda flag: np.bincount(doc, flag, n) / words_n
    h, length = words.hashes, words.ends - words.starts
    out[:, col["log_words"]], out[:, col["log_bytes"]] = np.log1p(counts), np.log1p(np.diff(offsets))
    if len(h):
        out[:, col["word_bytes"]] = share(length)
        order = np.lexsort((h, doc))
        hs, ds = h[order], doc[order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
        out[:, col["distinct_words"]] = np.bincount(ds[new], minlength=n) / words_n
        at = np.flatnonzero(new)
        most = np.zeros(n)
        np.maximum.at(most, ds[at], np.diff(np.append(at, len(hs))))
        out[:, col["top_word"]] = most / words_n
        for name, step in (("repeat_next", 1), ("repeat_second", 2)):
            again = np.zeros(len(h), bool)
            again[step:] = (h[step:] == h[:-step]) & (doc[step:] == doc[:-step])
            out[:, col[name]] = share(again)
        last = raw[words.ends - 1]
        first = raw[words.starts]
        out[:, col["mark_tail"]] = share(_TABLES["marks"][last] | _TABLES["pipes"][last])
        out[:, col["tail_upper"]] = share(_TABLES["upper"][first] & _TABLES["upper"][raw[np.maximum(words.ends - 1, 0)]] & (length > 1))
        out[:, col["one_letter"]] = share(length == 1)
        out[:, col["long_words"]] = share(length > 20)
        data = words.data
        letters = np.concatenate(([0], np.cumsum((data >= 128) | ((data >= 97) & (data <= 122)))))
        out[:, col["no_letter"]] = share(letters[words.ends] == letters[words.starts])
    # lines that occurred earlier in their text
    breaks = np.flatnonzero(raw == 10)
    ends = np.sort(np.concatenate((breaks, offsets[1:])))
    starts = np.sort(np.concatenate((breaks + 1, offsets[:-1])))
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    if len(starts):
        line, owner = tv.span_hashes(raw, starts, ends), np.searchsorted(offsets, starts, "right") - 1
        order = np.lexsort((line, owner))
        again = np.zeros(len(line), bool)
        again[order[1:]] = (line[order[1:]] == line[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        out[:, col["repeat_line"]] = np.bincount(owner, again * (ends - starts), n) / size
    return out


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in tv.sub_batches(batches):
            x = text_features(batch.column(1)).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "x"])

    return source.mapInArrow(run, "id long, x array<float>")


@dataclass
class Network:
    """One hidden layer of tanh units over standardised features and their squares."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack((z, np.ones((len(z), 1))))

    def score(self, x: np.ndarray) -> np.ndarray:
        w1, w2 = self.layers
        return np.hstack((np.tanh(self.inputs(x) @ w1), np.ones((len(x), 1)))) @ w2

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.score(x), -30, 30)))


def _adam(net: Network, positive: np.ndarray, other: np.ndarray, weights, steps: int) -> Network:
    """Full-batch Adam on ``weights(score of positives, score of others)``, the derivative of the risk."""
    xs = [net.inputs(positive), net.inputs(other)]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in net.layers]
    for step in range(1, steps + 1):
        hidden = [np.hstack((np.tanh(x @ net.layers[0]), np.ones((len(x), 1)))) for x in xs]
        slopes = weights(hidden[0] @ net.layers[1], hidden[1] @ net.layers[1])
        grads = [np.zeros_like(w) for w in net.layers]
        for x, h, g in zip(xs, hidden, slopes, strict=True):
            grads[1] += h.T @ g
            grads[0] += x.T @ (np.outer(g, net.layers[1][:-1]) * (1 - h[:, :-1] ** 2))
        for i, w in enumerate(net.layers):
            grads[i] += 1e-4 * w
            m, v = moments[i]
            m += 0.1 * (grads[i] - m)
            v += 0.001 * (grads[i] ** 2 - v)
            w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _start(x: np.ndarray, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    scale = x.std(axis=0)
    scale[scale < 1e-6] = 1
    return Network(x.mean(axis=0), scale, [rng.normal(0, 0.3, (x.shape[1] + 1, HIDDEN)), rng.normal(0, 0.3, HIDDEN + 1)])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(positive: np.ndarray, other: np.ndarray) -> float:
    """Share of positives among ``other``: the least ratio of upper tails of a plain model's scores, cross-fitted."""
    ratios = []
    for half in (0, 1):
        net = _start(np.vstack((positive, other)), 11 + half)
        p, u = positive[half::2], other[half::2]
        _adam(net, p, u, lambda a, b: ((_sigmoid(a) - 1) / len(a), _sigmoid(b) / len(b)), STEPS // 2)
        sp, su = net.score(positive[1 - half :: 2]), net.score(other[1 - half :: 2])
        cuts = np.quantile(sp, np.linspace(0.02, 0.5, 25))
        above_p = np.array([(sp >= c).mean() for c in cuts])
        above_u = np.array([(su >= c).mean() for c in cuts])
        ratios.append(float((above_u / above_p).min()))
    return float(np.clip(np.mean(ratios), 0.05, 0.98))


def train(positive: np.ndarray, other: np.ndarray, prior: float | None = None) -> tuple[Network, float]:
    """The network of least non-negative unbiased risk with logistic loss, and the class prior it took."""
    prior = class_prior(positive, other) if prior is None else prior
    net = _start(np.vstack((positive, other)), 3)

    def slopes(a, b):
        na, nb = len(a), len(b)
        soft = lambda z: np.logaddexp(0, z)
        negative = soft(b).mean() - prior * soft(a).mean()
        gain_a, gain_b = prior * (_sigmoid(a) - 1) / na, np.zeros(nb)
        back_a, back_b = -prior * _sigmoid(a) / na, _sigmoid(b) / nb
        return (gain_a + back_a, gain_b + back_b) if negative >= 0 else (-back_a, -back_b)

    return _adam(net, positive, other, slopes, STEPS), prior


def sampled(df: DataFrame, most: int) -> np.ndarray:
    rows = df.orderBy(F.xxhash64("id"), "id").select("x").limit(most)
    lists = rows.toArrow().column("x").combine_chunks()
    return lists.values.to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1) if len(lists) else np.zeros((0, len(NAMES)))


def score_documents(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """``id_col, score, predicted`` per document; score is the probability of label 1.

    ``learn(id)`` is a Column that says which rows may be learned from. Positives are their documents labelled 1;
    unlabelled text is their documents, labels unseen. A null or empty text has all features zero and is scored like
    any other. Without positives or unlabelled rows every score is 0.5. Repeated rows each give a row; other columns
    are not read.
    """
    table = stored(features(docs, id_col, text_col), "features")
    usable = table.filter(learn(F.col("id")))
    good = labels.filter(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("id")).distinct()
    positive, other = sampled(usable.join(good, "id", "left_semi"), sample), sampled(usable, sample)
    net = train(positive, other)[0] if len(positive) > 1 and len(other) > 1 else None
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = sent.value
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                s = net.predict(x) if net else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return table.mapInArrow(run, f"`{id_col}` long, score double, predicted int")
