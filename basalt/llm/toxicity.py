"""Toxicity by a linear-chain conditional random field over words.

Labels of tokens come from labels of documents: features (a word, its first 4, 5 or 6 letters) that
stand in far more surroundings in toxic than in clean documents mark words of toxic documents as toxic, all other words
are clean. A chain of two states with features of the word and of its neighbours is fitted to labelled
snippets by maximum likelihood (forward-backward gives the gradient). Scoring takes every whole text:
forward-backward gives each word's marginal, marginals of words above one half are offending spans,
and a logistic function of their sum and maximum is the document's score.

Most words have no feature. Over a run of g such words the chain is the g-th power of one 2 x 2 matrix,
taken from its eigenvalues, so only words with features are stepped through; the result is that of
forward-backward over all words.

The fit takes at most SAMPLE labelled rows of each class with texts of at most SAMPLE_BYTES, chosen by
hash of doc_id, and at most SNIPPETS snippets around featured words and as many of others. The least
ratio of a feature is the one of RATIOS with the least loss in cross-validation: each half of the sample
is scored by a chain fitted to the other half; rows that are held out have no part in it. Labels,
language, source and doc_id are never inputs of a score.

Defined results: a text longer than a chunk is scored as a whole, its words found in pieces; null and empty texts have the score of a text without features; rows without doc_id
are not held out; with no labels of one class no feature is found and scores are the share of toxic
labels (0 without labels); repeated rows are scored each.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm import chars
from basalt.llm.common import CHUNK_BYTES, MIX_B, SpanHasher, chunks, map_arrow, mix, pair, text_chunks, text_pieces

SAMPLE, SAMPLE_BYTES = 2500, 20_000
#: Letters of the prefixes that are features, next to the whole word (0).
PREFIXES = (0, 4, 5, 6)
#: A feature marks toxic words from this z-score and one of these ratios of document shares on.
LEAST_Z, RATIOS = 4.5, (6.0, 8.0, 12.0, 20.0)
#: Snippets with a featured word in the middle that the fit takes at most, evenly spread, and as many without.
SNIPPETS = 6000
#: Rounds of the chain's fit, and of those of cross-validation.
FIT_ROUNDS, TRIAL_ROUNDS = 80, 30
#: Words on each side of a marked word in a snippet for the fit.
AROUND = 12
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words(texts: list[str]):
    """Letter runs of lower-cased texts: (begin, end, bounds of texts in words, bounds in code points, feature names)."""
    low = [t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts]
    cp, bounds = chars.code_points(low)
    begin, end = chars.letter_runs(chars.class_table()[cp], bounds)
    named = SpanHasher(cp, MIX_B) if len(cp) else None
    names = []
    for k in PREFIXES:
        if named is None:
            names.append(np.zeros(0, np.uint64))
            continue
        name = mix(named(begin, end if k == 0 else np.minimum(begin + k, end)) + np.uint64(k))
        names.append(np.where(end - begin > k, name, np.uint64(0)) if k else name)
    return begin, end, np.searchsorted(begin, bounds), bounds, names


@dataclass
class Model:
    """Feature names (sorted) and weights; potentials of state 1 and of transitions; the document's logistic."""

    names: np.ndarray
    weights: np.ndarray
    near: np.ndarray  # weights of a featured word before, and after
    bias: float
    moves: np.ndarray  # log potentials of transitions
    logistic: np.ndarray  # of 1, log(1 + sum of marginals), largest marginal
    share: float  # of toxic labels

    def __post_init__(self):
        self.hint = np.zeros(1 << 20, bool)
        self.hint[(self.names & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def found(self, names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(places of words with a feature, sum of their features' weights)."""
        total = None
        places, values = [], []
        for name in names:
            at = np.nonzero(self.hint[(name & np.uint64((1 << 20) - 1)).astype(np.int64)])[0]
            if len(at) and len(self.names):
                k = np.minimum(np.searchsorted(self.names, name[at]), len(self.names) - 1)
                hit = self.names[k] == name[at]
                places.append(at[hit])
                values.append(self.weights[k[hit]])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0)
        where, index = np.unique(np.concatenate(places), return_inverse=True)
        total = np.bincount(index, weights=np.concatenate(values), minlength=len(where))
        return where, total


def _powers(model: Model):
    """P1, P2, r with (A diag(1, e^bias))^g = lambda^g (P1 + r^g P2)."""
    d = np.exp(model.moves) * np.array([1.0, np.exp(model.bias)])
    value, vector = np.linalg.eig(d)
    order = np.argsort(-np.abs(value))
    value, vector = value[order].real, vector[:, order].real
    inverse = np.linalg.inv(vector)
    return np.outer(vector[:, 0], inverse[0]), np.outer(vector[:, 1], inverse[1]), value[1] / value[0]


def marginals(model: Model, place: np.ndarray, emission: np.ndarray, text: np.ndarray, own: np.ndarray) -> np.ndarray:
    """P(state 1) of the featured words: place, emission and text of each, in order; own: bounds of texts in words."""
    n = len(place)
    out = np.zeros(n)
    if not n:
        return out
    p1, p2, r = _powers(model)
    a = np.exp(model.moves)
    first = np.ones(n, bool)
    first[1:] = text[1:] != text[:-1]
    begin = np.nonzero(first)[0]
    size = np.diff(np.append(begin, n))
    gap = np.where(first, place - own[text], place - np.append(0, place[:-1]) - 1).astype(float)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    e = np.exp(np.minimum(emission, 50.0))
    steps = [begin[: np.searchsorted(-size, -j, side="left")] + j for j in range(int(size[0]))]  # texts with more than j
    forward, backward = np.zeros((n, 2)), np.ones((n, 2))
    state = np.tile([1.0, 0.0], (len(begin), 1))
    for at in steps:
        g = r ** gap[at]
        x = state[: len(at)]
        x = x @ p1 + (x @ p2) * g[:, None]
        x = x @ a
        x[:, 1] *= e[at]
        state = np.maximum(x, 0) / x.sum(axis=1, keepdims=True)
        forward[at] = state
    tail = np.append(own[text[:-1] + 1][first[1:]], own[text[-1] + 1]) - place[np.append(np.nonzero(first)[0][1:] - 1, n - 1)] - 1
    after = np.zeros(n)
    after[np.append(np.nonzero(first)[0][1:] - 1, n - 1)] = tail
    for j in range(len(steps) - 1, -1, -1):
        at = steps[j]
        y = np.ones((len(at), 2))
        more = len(steps[j + 1]) if j + 1 < len(steps) else 0
        if more:
            nxt = steps[j + 1]
            z = backward[nxt].copy()
            z[:, 1] *= e[nxt]
            z = z @ a.T
            y[:more] = z @ p1.T + (z @ p2.T) * (r ** gap[nxt])[:, None]
        if more < len(at):
            one = np.ones((len(at) - more, 2))
            y[more:] = one @ p1.T + (one @ p2.T) * (r ** after[at[more:]])[:, None]
        backward[at] = np.maximum(y, 0) / y.sum(axis=1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(axis=1)


def neighbours(where: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with a feature or next to one, and for each whether its neighbour (before, after) has one."""
    total = int(own[-1])
    edge = np.zeros(total + 1, bool)
    edge[own] = True
    right = where[(where + 1 < total)]
    right = right[~edge[right + 1]] + 1  # has a featured word before it
    left = where[~edge[where]] - 1
    place = np.unique(np.concatenate([where, right, left]))
    return place, np.isin(place, right), np.isin(place, left)


def _found(model: Model, texts: list[str]):
    """(featured words, their weights, bounds of texts in words, words' begin and end, bounds in code points)."""
    if len(texts) > 1 or len(texts[0]) <= CHUNK_BYTES:
        begin, end, own, bounds, names = words(texts)
        return *model.found(names), own, begin, end, bounds
    parts, at, n = [], 0, 0  # one long text, in pieces
    for piece in text_pieces(texts[0]):
        begin, end, own, _, names = words([piece])
        where, weight = model.found(names)
        parts.append((where + n, weight, begin + at, end + at))
        at, n = at + len(piece), n + int(own[-1])
    where, weight, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    return where, weight, np.array([0, n]), begin, end, np.array([0, at])


def score_texts(model: Model, texts: list[str]):
    """(scores, places of scored words, marginals, their texts, words' begin and end, bounds in code points)."""
    where, weight, own, begin, end, bounds = _found(model, texts)
    place, before, after = neighbours(where, own)
    emission = np.full(len(place), model.bias)
    emission[np.searchsorted(place, where)] += weight
    emission += model.near[0] * before + model.near[1] * after
    text = np.searchsorted(own, place, side="right") - 1
    p = marginals(model, place, emission, text, own)
    total = np.bincount(text, weights=p, minlength=len(texts))
    top = np.zeros(len(texts))
    np.maximum.at(top, text, p)
    x = np.stack([np.ones(len(texts)), np.log1p(total), top], axis=1)
    scores = 1 / (1 + np.exp(-np.clip(x @ model.logistic, -30, 30))) if len(model.names) else np.full(len(texts), model.share)
    return scores, place, p, text, begin, end, bounds, x


def _candidates(name: np.ndarray, around: np.ndarray, y: np.ndarray):
    """(feature, z-score, ratio) of the features of one kind, by the surroundings in which they stand.

    Surroundings (word before, word after) count once: copies of a text say nothing more about its words.
    """
    have = np.flatnonzero(name)
    _, once = np.unique(pair(pair(name[have], around[have]), y[have].astype(np.uint64)), return_index=True)
    have = have[once]
    unique, index = np.unique(name[have], return_inverse=True)
    t = np.bincount(index, weights=y[have], minlength=len(unique))
    c = np.bincount(index, minlength=len(unique)) - t
    n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
    share = n1 / (n1 + n0)
    z = (t - (t + c) * share) / np.sqrt(np.maximum((t + c) * share * (1 - share), 1e-9))
    ratio = (t + 0.5) / (n1 + 1) / ((c + 0.5) / (n0 + 1))
    good = (z >= LEAST_Z) & (ratio >= min(RATIOS))
    return unique[good], ratio[good]


def _seeds(names: list[np.ndarray], own: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (sorted) that stand in far more surroundings in toxic texts than in clean ones, and their ratios."""
    y = np.repeat(toxic, np.diff(own))
    word = np.concatenate([[np.uint64(0)], names[0], [np.uint64(0)]])
    before, after = word[:-2].copy(), word[2:].copy()
    inside = own[:-1][own[:-1] < len(y)]
    before[inside], after[own[1:][own[1:] > 0] - 1] = 0, 0
    around = pair(before, after)
    del word, before, after
    name, ratio = (np.concatenate(x) for x in zip(*(_candidates(n, around, y) for n in names), strict=True))
    order = np.argsort(name)
    return name[order], ratio[order]


def _fit_chain(features: np.ndarray, before: np.ndarray, after: np.ndarray, label: np.ndarray, valid: np.ndarray, n: int, rounds: int):
    """Maximum likelihood of snippets [s, t]: feature ids [s, t, k] (n is none), neighbour flags, labels, mask."""
    weights, near, bias, moves = np.zeros(n + 1), np.zeros(2), 0.0, np.zeros((2, 2))
    velocity = [np.zeros_like(x) for x in (weights, near, np.zeros(1), moves)]
    squares = [np.zeros_like(x) for x in (weights, near, np.zeros(1), moves)]
    s, t = label.shape
    flat = features.reshape(s * t, -1)
    gold = np.zeros((2, 2))
    np.add.at(gold, (label[:, :-1][valid[:, 1:]], label[:, 1:][valid[:, 1:]]), 1)
    for i in range(1, rounds + 1):
        a = np.exp(moves)
        e = weights[features].sum(axis=2) + bias + near[0] * before + near[1] * after
        x = np.exp(np.clip(e, -30, 30))
        alpha = np.zeros((t, s, 2))
        alpha[0] = np.stack([np.ones(s), x[:, 0]], axis=1)
        alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
        for j in range(1, t):
            y = alpha[j - 1] @ a
            y[:, 1] *= x[:, j]
            y /= y.sum(axis=1, keepdims=True)
            alpha[j] = np.where(valid[:, j : j + 1], y, alpha[j - 1])
        beta = np.ones((t, s, 2))
        expected = np.zeros((2, 2))
        for j in range(t - 2, -1, -1):
            z = beta[j + 1].copy()
            z[:, 1] *= x[:, j + 1]
            y = z @ a.T
            edge = alpha[j][:, :, None] * a[None] * z[:, None, :]
            edge /= edge.sum(axis=(1, 2), keepdims=True)
            expected += edge[valid[:, j + 1]].sum(axis=0)
            beta[j] = np.where(valid[:, j + 1 : j + 2], y / y.sum(axis=1, keepdims=True), beta[j + 1])
        p = alpha * beta
        p = (p[:, :, 1] / p.sum(axis=2)).T
        off = np.where(valid, label - p, 0)
        g = [np.bincount(flat.ravel(), weights=np.repeat(off.ravel(), flat.shape[1]), minlength=n + 1) / s - 1e-4 * weights, np.array([(off * before).sum(), (off * after).sum()]) / s - 1e-4 * near, np.array([off.sum()]) / s, (gold - expected) / s - 1e-4 * moves]
        g[0][n] = 0
        now = [weights, near, np.array([bias]), moves]
        for k in range(4):  # Adam
            velocity[k] = 0.9 * velocity[k] + 0.1 * g[k]
            squares[k] = 0.99 * squares[k] + 0.01 * g[k] ** 2
            now[k] = now[k] + 0.15 * (velocity[k] / (1 - 0.9**i)) / (np.sqrt(squares[k] / (1 - 0.99**i)) + 1e-6)
        weights, near, bias, moves = now[0], now[1], float(now[2][0]), now[3]
    return weights[:n], near, bias, moves


def _words_in_chunks(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bounds of texts in words and feature names, a chunk of texts at a time: the driver's memory is small."""
    own, names = [np.zeros(1, np.int64)], [[] for _ in PREFIXES]
    for b, e in chunks(list(map(len, texts))):
        _, _, part, _, found = words(texts[b:e])
        own.append(own[-1][-1] + part[1:])
        for have, name in zip(names, found, strict=True):
            have.append(name)
    return np.concatenate(own), [np.concatenate(n) for n in names]


def _evenly(where: np.ndarray, most: int) -> np.ndarray:
    return where[:: max(1, -(-len(where) // most))]


def _fit_seeds(names: list[np.ndarray], own: np.ndarray, toxic: np.ndarray, seeds: np.ndarray, share: float, rounds: int) -> Model:
    """A chain with these features, without its document logistic."""
    ids = np.full((len(names[0]), len(names)), len(seeds), np.int32)
    for j, name in enumerate(names):
        k = np.minimum(np.searchsorted(seeds, name), len(seeds) - 1)
        hit = np.flatnonzero(seeds[k] == name)
        ids[hit, j] = k[hit]
    featured = (ids < len(seeds)).any(axis=1)
    text = np.repeat(np.arange(len(own) - 1), np.diff(own))
    label = (featured & (toxic[text] == 1)).astype(np.int64)
    middle = np.unique(np.concatenate([_evenly(np.flatnonzero(featured), SNIPPETS), _evenly(np.flatnonzero(~featured), SNIPPETS)]))
    at = middle[:, None] + np.arange(-AROUND, AROUND + 1)
    valid = (at >= own[text[middle]][:, None]) & (at < own[text[middle] + 1][:, None])
    shift = valid.argmax(axis=1)  # snippets begin at their first word
    at = np.minimum(at + shift[:, None], len(featured) - 1)
    valid = np.arange(at.shape[1])[None] < valid.sum(axis=1)[:, None]
    near_before = np.append(False, featured[:-1])
    near_before[own[:-1][own[:-1] < len(featured)]] = False
    near_after = np.append(featured[1:], False)
    near_after[own[1:][own[1:] > 0] - 1] = False
    weights, near, bias, moves = _fit_chain(ids[at], near_before[at], near_after[at], label[at], valid, len(seeds), rounds)
    return Model(seeds, weights, near, bias, moves, np.zeros(3), share)


def _document_rows(model: Model, texts: list[str]) -> np.ndarray:
    return np.concatenate([score_texts(model, texts[b:e])[-1] for b, e in chunks(list(map(len, texts)))])


def _fit_logistic(x: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Newton steps of a ridge logistic regression; rows weigh as their class does among all labelled rows."""
    row = np.where(toxic == 1, share / max(toxic.mean(), 1e-9), (1 - share) / max(1 - toxic.mean(), 1e-9))
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (row * p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(3)
        step = np.linalg.solve(h, x.T @ (row * (toxic - p)) - 1e-1 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _part(texts: list[str], toxic: np.ndarray, own: np.ndarray, names: list[np.ndarray], which: np.ndarray):
    """The same for some of the texts."""
    word = np.repeat(which, np.diff(own))
    return [t for t, w in zip(texts, which, strict=True) if w], toxic[which], np.append(0, np.cumsum(np.diff(own)[which])), [n[word] for n in names]


def choose_ratio(texts: list[str], toxic: np.ndarray, own: np.ndarray, names: list[np.ndarray], share: float) -> float:
    """The ratio with the least log loss over the halves, each scored by a fit to the other; the larger in a tie.

    Equal texts are in one half, so that a copy doesn't vouch for itself.
    """
    half = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % 2 == 1 for t in texts])
    loss = dict.fromkeys(RATIOS, 0.0)
    for which in (half, ~half):
        if not which.any() or which.all() or toxic[which].min() == toxic[which].max():
            return max(RATIOS)
        train, test = _part(texts, toxic, own, names, which), [t for t, w in zip(texts, which, strict=True) if not w]
        seeds, ratio = _seeds(train[3], train[2], train[1])
        for least in RATIOS:
            some = seeds[ratio >= least]
            p = np.full(len(test), share)
            if len(some):
                model = _fit_seeds(train[3], train[2], train[1], some, share, TRIAL_ROUNDS)
                w = _fit_logistic(_document_rows(model, train[0]), train[1], share)
                p = 1 / (1 + np.exp(-np.clip(_document_rows(model, test) @ w, -30, 30)))
            y = toxic[~which]
            row = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
            loss[least] -= (row * np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-6, 1))).sum()
    return min(RATIOS, key=lambda r: (round(loss[r], 6), -r))


def fit_texts(texts: list[str], toxic: np.ndarray, share: float) -> Model:
    """Fit to labelled texts; `share` is that of toxic rows among all labelled ones."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(2), 0.0, np.zeros((2, 2)), np.zeros(3), share)
    if not len(texts) or toxic.min() == toxic.max():
        return none
    own, names = _words_in_chunks(texts)
    if not own[-1]:
        return none
    least = choose_ratio(texts, toxic, own, names, share)
    seeds, ratio = _seeds(names, own, toxic)
    seeds = seeds[ratio >= least]
    if not len(seeds):
        return none
    model = _fit_seeds(names, own, toxic, seeds, share, FIT_ROUNDS)
    model.logistic = _fit_logistic(_document_rows(model, texts), toxic, share)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit to a bounded sample of labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*by_hash).limit(sample).unionByName(known.where("toxic = 0").orderBy(*by_hash).limit(sample))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where(F.octet_length("text") <= most_bytes)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").toArrow().sort_by("doc_id")  # at most 2 x sample rows
    return fit_texts(rows.column("text").to_pylist(), np.array(rows.column("toxic").to_pylist(), np.int64), share)


def tag_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, with_spans: bool = True) -> DataFrame:
    """doc_id, score, predicted, spans: array<struct<start, stop, p>> of offending words, in code points."""

    def run(batch):
        doc_ids, column = batch.column("doc_id"), batch.column("text")
        for b, e, texts in text_chunks(column):
            scores, place, p, text, begin, end, bounds, _ = score_texts(model, texts)
            cols = [doc_ids.slice(b, e - b), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            if with_spans:
                hit = np.nonzero(p > 0.5)[0]
                base = bounds[text[hit]]
                spans = pa.StructArray.from_arrays([pa.array((begin[place[hit]] - base).astype(np.int32)), pa.array((end[place[hit]] - base).astype(np.int32)), pa.array(p[hit])], ["start", "stop", "p"])
                cols.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(text[hit], np.arange(e - b + 1)).astype(np.int32)), spans))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "predicted", "spans"][: len(cols)])

    schema = "doc_id long, score double, predicted int" + ", spans array<struct<start:int,stop:int,p:double>>" * with_spans
    return map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, schema)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending spans of every text."""
    tagged = tag_documents(docs, fit(docs, labels))
    return tagged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows (all columns) whose text scores below the threshold."""

    def run(batch):
        for b, e, texts in text_chunks(batch.column("text")):
            kept = np.nonzero(score_texts(model, texts)[0] < threshold)[0]
            if len(kept):
                yield batch.slice(b, e - b).take(pa.array(kept))

    return map_arrow(docs, run, docs.schema)
