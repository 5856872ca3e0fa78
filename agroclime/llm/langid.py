"""Language identification by a linear-chain conditional random field over words.

Word features are hashed byte n-grams (those at a word's ends are its affixes), the whole word, and membership in
each language's lexicon. Transitions between languages are learned with them, from the training documents and from
chains spliced out of them at random points, with switches of one to three words, so that a code-switched text gets
one label distribution per word by forward-backward; a document's language is the one with the largest mean marginal.

How far the likeliest labels' features stand above the other languages', on the mean over the words, is a text's
evidence. It is high in text of a learned language, switched or not, and near zero where no learned feature speaks:
what lies far under all training documents is in none of the languages.

Forward-backward runs over whole documents. Chains are cut into blocks of words only for the arithmetic: block
transfer matrices are multiplied along each document first, which gives the exact messages at every block edge.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agroclime.llm import textvec as tv

TABLE = 1 << 18
NGRAMS = (2, 3, 4)
LEXICON = 3000          # most frequent words of each language in the training sample
TRAIN_DOCS = 200        # documents per language the model learns from, those with the smallest id hashes
TRAIN_CHARS = 20_000    # of a longer document so many characters from its first letter on are learned from (all are predicted, whole)
STEPS = 30
SPLICED = 0.25          # words of spliced chains, as a share of the documents' words
SORT_BYTES = 1 << 20    # texts that the corpus stage labels at once: its workers stand beside executors that later stages have filled
FLOOR = 0.4             # of the evidence that 99 % of the training documents reach: less is no learned language
_BLOCK = 32
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray        # (TABLE, labels)
    lexicons: list[np.ndarray]  # sorted word hashes per label
    lexicon_weights: np.ndarray  # (labels, labels): row = whose lexicon the word is in
    transitions: np.ndarray
    floor: float = 0.0          # least evidence of a text in one of the languages
    sure: float = np.inf        # a score that 99 % of the training documents reach


@dataclass
class Distinct:
    """The distinct words of a batch with their feature places."""

    places: list[tuple[np.ndarray, np.ndarray]]  # per n-gram size: places in the table, first place of each word
    inverse: np.ndarray
    hashes: np.ndarray
    letters: np.ndarray


def distinct_words(words: tv.Words) -> Distinct:
    hashes, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    starts, sizes = words.starts[first], (words.ends - words.starts)[first]
    begin = np.concatenate(([0], np.cumsum(sizes + 2)))
    data = np.full(begin[-1], 32, np.uint8)
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    data[np.repeat(begin[:-1] + 1, sizes) + inner] = words.data[np.repeat(starts, sizes) + inner]
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    letters = np.add.reduceat(letter, begin[:-1]) > 0 if len(hashes) else np.zeros(0, bool)
    wide = data.astype(np.uint64)
    places = [((hashes % np.uint64(TABLE)).astype(np.int64), np.arange(len(hashes)))]
    for n in NGRAMS:
        code = np.full(max(len(wide) - n + 1, 0), n, np.uint64)
        for j in range(n):
            code = code * np.uint64(257) + wide[j : len(wide) - n + 1 + j]
        code = (tv.mix(code) % np.uint64(TABLE)).astype(np.int64)
        count = np.maximum(sizes + 2 - n + 1, 0)
        here = np.concatenate(([0], np.cumsum(count)))
        at = np.arange(here[-1]) - np.repeat(here[:-1], count) + np.repeat(begin[:-1], count)
        places.append((code[at], here[:-1]))
    return Distinct(places, inverse, hashes, letters)


def _sum_runs(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.zeros((len(begin) + 0, values.shape[1]))
    if len(values):
        padded = np.vstack((values, np.zeros((1, values.shape[1]), values.dtype)))
        total = np.add.reduceat(padded, np.minimum(begin, len(values)), axis=0)
        ends = np.append(begin[1:], len(values))
        total[ends == begin] = 0
    return total


def emissions(model: Model, d: Distinct) -> np.ndarray:
    score = np.zeros((len(d.hashes), len(model.labels)))
    for place, begin in d.places:
        score += _sum_runs(model.weights[place], begin)
    for lexicon, weight in zip(model.lexicons, model.lexicon_weights, strict=True):
        score[_among(lexicon, d.hashes)] += weight
    return score


def _among(lexicon: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(lexicon):
        return np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return lexicon[at] == hashes


def marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Label marginals (words, labels) of each chain ``first[i]:first[i + 1]``; with ``pairs`` also expected transitions.

    The label before a chain's first word is uniform and unobserved.
    """
    n, k = scores.shape
    counts = np.diff(first)
    blocks_of = -(-counts // _BLOCK)
    edge = np.concatenate(([0], np.cumsum(blocks_of)))
    total = int(edge[-1])
    if not total:
        return (np.zeros((0, k)), np.zeros((k, k))) if pairs else np.zeros((0, k))
    chain = np.repeat(np.arange(len(counts)), blocks_of)
    begin = first[:-1][chain] + (np.arange(total) - edge[:-1][chain]) * _BLOCK
    at = begin[:, None] + np.arange(_BLOCK)
    real = at < first[1:][chain][:, None]
    p = np.exp(scores - scores.max(axis=1, keepdims=True))[np.minimum(at, n - 1)]
    a = np.exp(transitions)
    transfer = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(_BLOCK):
        step = (transfer.reshape(-1, k) @ a).reshape(total, k, k) * p[:, t, None, :]
        step /= step.max(axis=(1, 2), keepdims=True)
        transfer = np.where(real[:, t, None, None], step, transfer)
    left, right = np.full((total, k), 1 / k), np.ones((total, k))
    for b in range(1, int(blocks_of.max())):
        rows = np.flatnonzero(blocks_of > b)
        now = edge[rows] + b
        x = np.einsum("ik,ikl->il", left[now - 1], transfer[now - 1])
        left[now] = x / x.sum(axis=1, keepdims=True)
        now = edge[rows + 1] - 1 - b
        y = np.einsum("ikl,il->ik", transfer[now + 1], right[now + 1])
        right[now] = y / y.sum(axis=1, keepdims=True)
    forward = np.empty((total, _BLOCK + 1, k))
    forward[:, 0] = left
    for t in range(_BLOCK):
        x = (forward[:, t] @ a) * p[:, t]
        x /= x.sum(axis=1, keepdims=True)
        forward[:, t + 1] = np.where(real[:, t, None], x, forward[:, t])
    backward = np.empty((total, _BLOCK, k))
    expected = np.zeros((k, k))
    message = right
    for t in range(_BLOCK - 1, -1, -1):
        backward[:, t] = message
        weighted = p[:, t] * message
        if pairs:
            xi = forward[:, t, :, None] * a * weighted[:, None, :]
            expected += (xi / xi.sum(axis=(1, 2), keepdims=True))[real[:, t]].sum(axis=0)
        y = weighted @ a.T
        message = np.where(real[:, t, None], y / y.sum(axis=1, keepdims=True), message)
    gamma = forward[:, 1:] * backward
    gamma /= gamma.sum(axis=2, keepdims=True)
    gamma = gamma[real]
    return (gamma, expected) if pairs else gamma


_BREAKS = re.compile("[\\x20\\x09-\\x0d]+")


def spliced(texts: list[str], labels: list[str], share: float = SPLICED, seed: int = 17) -> tuple[list[str], list[list[str]]]:
    """Chains of runs of the texts' words in which other languages take over for one to three words, and word labels."""
    by: dict[str, list[list[str]]] = {}
    for text, label in zip(texts, labels, strict=True):
        words = [w for w in _BREAKS.split(text) if w]
        if words:
            by.setdefault(label, []).append(words)
    made, tags = [], []
    if len(by) < 2:
        return made, tags
    rng, names = np.random.default_rng(seed), sorted(by)
    left = share * sum(len(w) for held in by.values() for w in held)

    def run(label: str, n: int) -> list[str]:
        words = by[label][rng.integers(len(by[label]))]
        at = rng.integers(max(1, len(words) - n + 1))
        return words[at:at + n]

    while left > 0:
        base, chain, said = names[rng.integers(len(names))], [], []
        while len(chain) < 40:
            other = names[(names.index(base) + 1 + rng.integers(len(names) - 1)) % len(names)]
            for label, n in ((base, rng.integers(3, 13)), (other, rng.integers(1, 4))):
                words = run(label, int(n))
                chain += words
                said += [label] * len(words)
        made.append(" ".join(chain))
        tags.append(said)
        left -= len(chain)
    return made, tags


def train(texts: list[str], labels: list[str], steps: int = STEPS) -> Model:
    """Maximum likelihood by AdaGrad on all chains at once; every word of a text carries the text's label.

    Spliced chains are learned from beside the texts; lexicons and the least evidence come from the texts alone.
    """
    names = sorted(set(labels))
    k = len(names)
    chains, tags = spliced(texts, labels)
    words = tv.words_of(pa.array([*texts, *chains], pa.string()))
    d = distinct_words(words)
    counts = np.diff(words.first)[: len(texts)]
    gold = np.concatenate([np.repeat([names.index(x) for x in labels], counts), [names.index(y) for t in tags for y in t]]).astype(np.int64)
    plain = int(counts.sum())
    lexicons = []
    for y in range(k):
        counts = np.bincount(d.inverse[:plain][gold[:plain] == y], minlength=len(d.hashes))
        top = np.argsort(-counts, kind="stable")[:LEXICON]
        lexicons.append(np.sort(d.hashes[top[counts[top] > 1]]))
    model = Model(names, np.zeros((TABLE, k)), lexicons, np.zeros((k, k)), np.zeros((k, k)))
    if k < 2:
        return model
    inside = [_among(x, d.hashes) for x in lexicons]
    observed = np.zeros((k, k))
    follows = np.ones(len(gold), bool)
    follows[words.first[:-1][np.diff(words.first) > 0]] = False
    at = np.flatnonzero(follows)
    np.add.at(observed, (gold[at - 1], gold[at]), 1)
    starts = np.bincount(gold[~follows], minlength=k)
    seen = [np.full((TABLE, k), 1e-6), np.full((k, k), 1e-6), np.full((k, k), 1e-6)]
    scale = 1 / max(len(gold), 1)
    for _ in range(steps):
        gamma, expected = marginals(emissions(model, d)[d.inverse], words.first, model.transitions, pairs=True)
        # A chain's first step comes from an unobserved label: given its target, that label's posterior counts.
        before = np.exp(model.transitions)
        true = observed + starts * before / before.sum(axis=0)
        residual = -gamma
        residual[np.arange(len(gold)), gold] += 1
        per_word = np.stack([np.bincount(d.inverse, residual[:, y], len(d.hashes)) for y in range(k)], axis=1)
        grad = np.zeros((TABLE, k))
        for place, begin in d.places:
            sizes = np.diff(np.append(begin, len(place)))
            for y in range(k):
                grad[:, y] += np.bincount(place, np.repeat(per_word[:, y], sizes), TABLE)
        lexicon_grad = np.stack([per_word[x].sum(axis=0) for x in inside])
        for value, g, s, rate in ((model.weights, grad * scale - 1e-7 * model.weights, seen[0], 0.3), (model.lexicon_weights, lexicon_grad * scale, seen[1], 0.1), (model.transitions, (true - expected) * scale, seen[2], 0.1)):
            s += g**2
            value += rate * g / np.sqrt(s)
    model.weights = model.weights.astype(np.float32)
    _, score, _, _, shown, n = labelled(model, pa.array(texts, pa.string()))
    if (n > 0).any():
        model.floor = FLOOR * float(np.quantile(shown[n > 0], 0.01))
        model.sure = float(np.quantile(score[n > 0], 0.01))
    return model


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_language: int = TRAIN_DOCS) -> Model | None:
    """Learn from at most ``docs_per_language`` documents of each language, those with the smallest id hashes; None without any.

    Of a document over TRAIN_CHARS characters so many are learned from, from its first letter on.
    """
    good = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and length(text) > 0")
    nth = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = good.select("id", "lang").withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= docs_per_language).select("id", "lang").distinct()
    picked = labelled.sparkSession.createDataFrame(chosen.collect(), "id long, lang string")
    piece = F.when(F.length("text") <= TRAIN_CHARS, F.col("text")).otherwise(F.substring(F.regexp_replace("text", r"\A[^\p{L}]++", ""), 1, TRAIN_CHARS))
    rows = good.join(F.broadcast(picked), ["id", "lang"], "left_semi").select("id", "lang", piece.alias("text")).collect()
    rows.sort(key=lambda r: (r["id"], r["lang"], r["text"]))
    texts, labels = [r["text"] for r in rows], [r["lang"] for r in rows]
    return train(texts, labels) if texts else None


def label_words(model: Model, column: pa.Array) -> tuple[tv.Words, np.ndarray, np.ndarray]:
    """Words of each text, their label marginals, and which words hold a letter."""
    return led_words(model, column)[:3]


def led_words(model: Model, column: pa.Array) -> tuple[tv.Words, np.ndarray, np.ndarray, np.ndarray]:
    """The same, and how far each word's likeliest label scores above the mean of the others by its features alone."""
    words, k = tv.words_of(column), len(model.labels)
    if not len(words.hashes):
        return words, np.zeros((0, k)), np.zeros(0, bool), np.zeros(0)
    d = distinct_words(words)
    score = emissions(model, d)
    gamma = marginals(score[d.inverse], words.first, model.transitions)
    others = (score.sum(axis=1, keepdims=True) - score) / max(k - 1, 1)
    return words, gamma, d.letters[d.inverse], (score - others)[d.inverse, gamma.argmax(axis=1)]


def evidence(words: tv.Words, letters: np.ndarray, lead: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's mean lead over its words with letters, and how many those are."""
    doc = np.repeat(np.arange(n), np.diff(words.first))
    held = np.bincount(doc, letters, n)
    return np.bincount(doc, lead * letters, n) / np.maximum(held, 1), held


def with_letters(texts: pa.Array) -> np.ndarray:
    return np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)


def label_texts(model: Model | None, texts: pa.Array, unknown: str = "und") -> tuple[np.ndarray, ...]:
    """Language, score, number of words and of switches of each text."""
    return labelled(model, texts, unknown)[:4]


def labelled(model: Model | None, texts: pa.Array, unknown: str = "und") -> tuple[np.ndarray, ...]:
    """The same, and each text's evidence and number of words with letters (without a model, both are 0)."""
    has_letter = with_letters(texts)
    n = len(texts)
    langs, score, switches = np.full(n, unknown, object), np.zeros(n), np.zeros(n, np.int64)
    words, gamma, letters, lead = led_words(model, texts) if model is not None else (tv.words_of(texts), None, None, None)
    counts = np.diff(words.first).astype(np.int64)
    if gamma is None:
        return langs, score, counts, switches, np.zeros(n), np.zeros(n)
    if has_letter.any():
        doc = np.repeat(np.arange(n), counts)
        votes = np.stack([np.bincount(doc, gamma[:, y] * letters, n) for y in range(len(model.labels))], axis=1)
        best, weight = votes.argmax(axis=1), votes.sum(axis=1)
        ok = has_letter & (weight > 0)
        langs[ok] = np.array(model.labels, object)[best[ok]]
        score[ok] = np.clip(votes[ok, best[ok]] / weight[ok], 0, 1)
        top, owner = gamma.argmax(axis=1)[letters], doc[letters]
        switches = np.bincount(owner[1:][(top[1:] != top[:-1]) & (owner[1:] == owner[:-1])], minlength=n)
    return langs, score, counts, switches.astype(np.int64), *evidence(words, letters, lead, n)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", unknown: str = "und") -> DataFrame:
    """``id_col, lang_pred, score, n_words, n_switches`` per document.

    ``lang_pred`` is ``unknown`` with score 0 where the text is null or has no letter (or nothing was learned).
    ``n_switches`` counts neighbouring words with letters whose likeliest languages differ. Repeated rows each give a
    row; other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, "lang_pred", "score", "n_words", "n_switches"]

    def run(batches):
        for batch in tv.sub_batches(batches):
            langs, score, counts, switches = label_texts(sent.value, batch.column(1), unknown)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(counts), pa.array(switches)], names=names)

    return source.mapInArrow(run, f"`{id_col}` long, lang_pred string, score double, n_words long, n_switches long")


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """The rows, all columns, whose text is in a language that the model learned; rows stay where they are.

    Every text is labelled as by ``predict``. A text goes if it has no letter, or if its evidence is under the model's
    floor: script, noise or a language that no feature speaks for. ``lang_col`` is the language identified: the one that
    a row says gives way to the predicted one where it is null, or another with a score that 99 % of the training
    documents reach. Without a model, or with a single language, texts with letters stay; without one, ``lang_col`` too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in tv.sub_batches(batches, text_col, SORT_BYTES):
            texts, model = batch.column(batch.schema.get_field_index(text_col)), sent.value
            keep = with_letters(texts)
            if model is not None:
                langs, score, _, _, shown, held = labelled(model, texts)
                keep &= (held > 0) & ((shown >= model.floor) | (len(model.labels) < 2))
                if lang_col is not None:
                    at = batch.schema.get_field_index(lang_col)
                    batch = batch.set_column(at, batch.schema.field(at), _identified(batch.column(at), langs, score >= model.sure))
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _identified(said: pa.Array, langs: np.ndarray, sure: np.ndarray) -> pa.Array:
    """The predicted languages where nothing is said or the prediction is sure, else what is said."""
    return pc.if_else(pc.or_(pc.is_null(said), pa.array(sure)), pa.array(langs, pa.string()).cast(said.type), said)
