"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs, trained here in numpy.

A text's words are read in windows of WINDOW words that start every STRIDE words, so that all windows overlap and no word
goes unread. A word enters as its own evidence (how much oftener toxic than other training texts hold it) and that of its
character n-grams, which speaks for words never seen. Two GRUs read the window forward and backward, attention pools
their states, and a logistic unit over the windows of a text gives its score.

The model is fitted on a bounded sample: at most ``toxic`` and ``clean`` labelled rows, drawn by a hash of their id. The
evidence is cross-fitted in FOLDS parts, so that no training text is read with counts that it is part of. Scoring covers
every window of every text.

Defined results for odd input: a null or wordless text scores 0; labels that are null are no labels, an id's repeated
labels count once (the greatest); with labels of one kind only, or none, every score is 0; repeated rows score alike; an
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm._words import Words, blocks, mix, stream
from tesserae.runtime import written

WINDOW, STRIDE = 32, 16
HIDDEN = 8
GRAMS = (4, 5, 6)
BUCKETS = 1 << 17
FOLDS = 4
INPUTS = 7
#: Words that stand for the empty places of a short window.
_PAD = np.zeros(INPUTS, np.float32)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = stream(7, 256)
_MARK = np.zeros(128, bool)
_MARK[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
MARKS = np.concatenate([_MARK, np.zeros(128, bool)])


@dataclass
class Text:
    """Words of a block of texts: ``word`` points into the distinct words, whose hashes and n-grams are worked out once."""

    count: np.ndarray
    word: np.ndarray
    hashes: np.ndarray
    grams: np.ndarray
    gram_of: np.ndarray


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def read(texts: pa.Array) -> Text:
    """Lower-case words without the marks around them."""
    words = Words(pc.utf8_lower(texts.cast(pa.large_string())), lower=False)
    raw, start, end = words.raw, words.start.copy(), words.end.copy()
    if not len(start):
        none = np.zeros(0, np.int64)
        return Text(words.count, none, np.zeros(0, np.uint64), none, none)
    for _ in range(4):
        start += MARKS[raw[start]] & (end - start > 1)
        end -= MARKS[raw[end - 1]] & (end - start > 1)
    size = end - start
    at = _spans(start, size)
    begin = np.cumsum(size) - size
    k = (np.arange(len(at)) - np.repeat(begin, size)).astype(np.uint64)
    powers = np.cumprod(np.full(int(size.max()) + 1, _BASE, np.uint64))
    hashes = mix(np.add.reduceat(_BYTE[raw[at]] * powers[k], begin) + size.astype(np.uint64))
    found, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    # n-grams of ^word$, each distinct word once
    start, size = start[first], size[first]
    padded = np.zeros(int(size.sum()) + 2 * len(size), np.uint8)
    begin = np.cumsum(size + 2) - (size + 2)
    padded[begin], padded[begin + size + 1] = 94, 36
    padded[_spans(begin + 1, size)] = raw[_spans(start, size)]
    owner = np.repeat(np.arange(len(size)), size + 2)
    codes, grams, owners = _BYTE[padded], [], []
    for n in GRAMS:
        m = len(padded) - n + 1
        if m <= 0:
            continue
        code = np.zeros(m, np.uint64)
        for j in range(n):
            code = code * _BASE + codes[j : j + m]
        inside = owner[:m] == owner[n - 1 :]
        grams.append((mix(code[inside] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[:m][inside])
    grams, owners = np.concatenate(grams).astype(np.int32), np.concatenate(owners).astype(np.int32)
    order = np.argsort(owners, kind="stable")
    return Text(words.count, word, found, grams[order], owners[order])


@dataclass
class Evidence:
    """How much oftener toxic texts hold a word, or an n-gram, than others do: logarithms, shrunk where counts are few."""

    words: np.ndarray
    word_value: np.ndarray
    word_seen: np.ndarray
    gram_value: np.ndarray

    def inputs(self, text: Text) -> np.ndarray:
        """(distinct words, INPUTS): value and commonness of the word, then mean, greatest, least and share of its n-grams."""
        out = np.zeros((len(text.hashes), INPUTS), np.float32)
        if not len(out):
            return out
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, text.hashes), len(self.words) - 1)
            known = self.words[at] == text.hashes
            out[:, 0] = np.where(known, self.word_value[at], 0)
            out[:, 1] = np.where(known, self.word_seen[at], 0)
        value = self.gram_value[text.grams]
        n = np.bincount(text.gram_of, minlength=len(out))
        has = np.flatnonzero(n)
        begin = (np.cumsum(n) - n)[has]
        if len(has):
            out[has, 2] = np.add.reduceat(value, begin) / n[has]
            out[has, 3] = np.maximum.reduceat(value, begin)
            out[has, 4] = np.minimum.reduceat(value, begin)
            out[has, 5] = np.add.reduceat((value > 1).astype(np.float32), begin) / n[has]
        out[:, 6] = 1
        return out


def _odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    seen = toxic + clean
    return (np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))) * seen / (seen + 2) * (seen > 1)


def evidence(words: list[np.ndarray], kinds: list[np.ndarray], label: np.ndarray) -> Evidence:
    """Counted over whole training texts, each word and n-gram once a text."""
    n = np.array([(label == 0).sum(), (label == 1).sum()])
    grams = np.zeros((2, BUCKETS))
    for k, y in zip(kinds, label, strict=True):
        grams[y, k] += 1
    owner = np.repeat(label, [len(x) for x in words])
    found, at = np.unique(np.concatenate(words) if words else np.zeros(0, np.uint64), return_inverse=True)
    toxic = np.bincount(at, owner == 1, len(found))
    clean = np.bincount(at, owner == 0, len(found))
    often = toxic + clean > 1
    value = _odds(toxic, clean, n[1], n[0])[often].astype(np.float32)
    return Evidence(found[often], value, np.log1p(toxic + clean)[often].astype(np.float32) / 4, _odds(grams[1], grams[0], n[1], n[0]).astype(np.float32))


def windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) places among the words of texts with ``count`` words, -1 where a text has ended; and whose they are."""
    n = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(count)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.cumsum(count) - count
    place = (k * STRIDE)[:, None] + np.arange(WINDOW)
    return np.where(place < count[owner][:, None], begin[owner][:, None] + place, -1), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Net:
    """The recurrent network: parameters by name, forward and backward passes over (windows, WINDOW) of distinct words."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {
            "wx": r.normal(0, 0.3, (INPUTS, 6 * h)),
            "bx": np.zeros(6 * h),
            "uf": r.normal(0, 0.3, (h, 3 * h)),
            "ub": r.normal(0, 0.3, (h, 3 * h)),
            "att": r.normal(0, 0.3, 2 * h),
            "out": r.normal(0, 0.3, 2 * h),
            "bias": np.full(1, -2.0),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _read(self, g: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction, (WINDOW, windows, HIDDEN); g: its gates' inputs in reading order."""
        h, states = np.zeros((g.shape[1], HIDDEN), np.float32), []
        for x in g:
            a = h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((h, z, r, n, a[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            states.append(h)
        return np.stack(states)

    def forward(self, x: np.ndarray, at: np.ndarray, there: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; x: inputs of distinct words and, last, of the pad; at: (windows, WINDOW) rows of x."""
        p, h3 = self.p, 3 * HIDDEN
        gates = x @ p["wx"] + p["bx"]
        seen = at.T
        kf, kb = ([], []) if keep is not None else (None, None)
        forth = self._read(gates[:, :h3][seen], p["uf"], kf)
        back = self._read(gates[:, h3:][seen[::-1]], p["ub"], kb)[::-1]
        states = np.concatenate([forth, back], axis=2)
        score = np.where(there.T, states @ p["att"], -1e9)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep |= {"x": x, "seen": seen, "kf": kf, "kb": kb, "states": states, "weight": weight, "pooled": pooled}
        return pooled @ p["out"] + p["bias"][0]

    def _unread(self, d: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients for the gates' inputs and for u, from those for the states, in reading order."""
        du, dg, dh = np.zeros_like(u), [], np.zeros_like(d[0])
        for t in range(len(d) - 1, -1, -1):
            h, z, r, n, a = kept[t]
            dh = dh + d[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * a * r * (1 - r)
            da = np.concatenate([dz, dr, dn * r], axis=1)
            dg.append(np.concatenate([dz, dr, dn], axis=1))
            du += h.T @ da
            dh = dh * z + da @ u.T
        return np.stack(dg[::-1]), du

    def backward(self, kept: dict, dlogit: np.ndarray) -> dict[str, np.ndarray]:
        p, h3 = self.p, 3 * HIDDEN
        states, weight = kept["states"], kept["weight"]
        dpooled = dlogit[:, None] * p["out"]
        dweight = np.einsum("tnh,nh->tn", states, dpooled)
        dscore = weight * (dweight - (weight * dweight).sum(axis=0))
        dstates = weight[:, :, None] * dpooled + dscore[:, :, None] * p["att"]
        gf, duf = self._unread(dstates[:, :, :HIDDEN], kept["kf"], p["uf"])
        gb, dub = self._unread(dstates[::-1, :, HIDDEN:], kept["kb"], p["ub"])
        dgates = np.concatenate([gf, gb[::-1]], axis=2).reshape(-1, 2 * h3)
        x = kept["x"][kept["seen"].ravel()]
        return {
            "wx": x.T @ dgates,
            "bx": dgates.sum(axis=0),
            "uf": duf,
            "ub": dub,
            "att": np.einsum("tn,tnh->h", dscore, states),
            "out": kept["pooled"].T @ dlogit,
            "bias": dlogit.sum(keepdims=True),
        }


def _summary(logits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(texts, 4) of window logits: greatest, mean probability, mean of the positive part, and 1."""
    out = np.zeros((n, 4))
    out[:, 3] = 1
    if len(logits):
        size = np.bincount(owner, minlength=n)
        has = np.flatnonzero(size)
        begin = (np.cumsum(size) - size)[has]
        out[has, 0] = np.maximum.reduceat(logits, begin)
        out[has, 1] = 4 * np.add.reduceat(_sigmoid(logits), begin) / size[has]
        out[has, 2] = np.add.reduceat(np.maximum(logits, 0), begin) / size[has]
    return out


@dataclass
class Model:
    evidence: Evidence
    net: Net
    head: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        """Scores of texts, every window of each."""
        text = read(texts)
        out = np.zeros(len(texts))
        if len(text.word):
            place, owner = windows(text.count)
            logits = _window_logits(self.net, np.vstack([self.evidence.inputs(text), _PAD]), text.word, place)
            some = text.count > 0
            out[some] = _sigmoid(np.clip(_summary(logits, owner, len(texts)) @ self.head, -30, 30))[some]
        return out


def _window_logits(net: Net, x: np.ndarray, word: np.ndarray, place: np.ndarray, size: int = 4096) -> np.ndarray:
    there = place >= 0
    at = np.where(there, word[np.maximum(place, 0)], len(x) - 1)
    return np.concatenate([net.forward(x, at[i : i + size], there[i : i + size]) for i in range(0, len(at), size)])


def _part(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What forward() takes for some windows, with only those rows of x (the last for -1) that they name."""
    there = rows >= 0
    used, at = np.unique(np.where(there, rows, len(x) - 1), return_inverse=True)
    return x[used], at.reshape(rows.shape), there


def fit(texts: list[str | None], label: np.ndarray, steps: int = 220, per_text: int = 20, batch: int = 512, seed: int = 0) -> Model | None:
    """The model of labelled texts, or None if the labels are all alike.

    The network takes ``steps`` steps of ``batch`` windows, at most ``per_text`` of a text a round, drawn anew each time;
    the evidence and the unit over a text's windows learn from whole texts.
    """
    label = np.asarray(label, np.int64)
    if not 0 < label.sum() < len(label):
        return None
    r = np.random.default_rng(seed)
    fold = r.permutation(len(texts)) % FOLDS
    # texts are read twice, so that their n-grams needn't be held
    words, kinds = [], []
    for t in texts:
        one = read(pa.array([t], pa.large_string()))
        words.append(one.hashes)
        kinds.append(np.unique(one.grams))
    pick = lambda x, k: [v for v, f in zip(x, fold, strict=True) if f != k]
    tables = [evidence(pick(words, k), pick(kinds, k), label[fold != k]) for k in range(FOLDS)]
    whole = evidence(words, kinds, label)
    del words, kinds
    inputs, at, base = [], [], 0
    for t, k in zip(texts, fold, strict=True):
        one = read(pa.array([t], pa.large_string()))
        span = windows(one.count)[0]
        inputs.append(tables[k].inputs(one))
        # -1: a place after the text's end
        at.append(np.where(span >= 0, one.word[np.maximum(span, 0)] + base, -1).astype(np.int32) if len(one.word) else span.astype(np.int32))
        base += len(inputs[-1])
    x = np.vstack([*inputs, _PAD])
    del inputs
    net = Net(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    chosen = np.zeros((0, 2), np.int64)
    for step in range(1, steps + 1):
        while len(chosen) < batch:
            # the windows of the next round: at most per_text of each text, in a new order
            drawn = [(d, w) for d, a in enumerate(at) for w in (range(len(a)) if len(a) <= per_text else r.choice(len(a), per_text, replace=False))]
            if not drawn:
                return None
            chosen = np.concatenate([chosen, np.array(drawn, np.int64)[r.permutation(len(drawn))]])
        part, chosen = chosen[:batch], chosen[batch:]
        rows = np.stack([at[d][w] for d, w in part])
        kept: dict = {}
        logit = net.forward(*_part(x, rows), kept)
        y = label[part[:, 0]].astype(np.float32)
        grads = net.backward(kept, (_sigmoid(logit) - y) / len(part))
        rate = 0.02 / (1 + 2 * step / steps)
        for k, g in grads.items():
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    made = np.zeros((len(texts), 4))
    for d, rows in enumerate(at):
        if len(rows):
            logit = np.concatenate([net.forward(*_part(x, w)) for w in np.split(rows, range(4096, len(rows), 4096))])
            made[d] = _summary(logit, np.zeros(len(rows), np.int64), 1)[0]
    some = np.array([len(rows) > 0 for rows in at])
    return Model(whole, net, _logistic(made[some], label[some]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic unit."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = _sigmoid(np.clip(x @ w, -30, 30))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
    return w


def held_out(id_: Column) -> Column:
    """True for the ids whose labels are never learned from."""
    return F.crc32(id_.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = 1500, clean: int = 2500, chars: int = 1 << 26) -> Model | None:
    """The model of at most ``toxic`` and ``clean`` labelled rows that aren't held out, drawn by a hash of their id.

    Of rows that repeat an id the least text counts. Texts of more than a sixteenth of ``chars`` characters are left out; the
    others are taken whole in the order of the draw while they come to ``chars`` at most, so that what reaches the driver is
    bounded and one long text doesn't shut out those behind it.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_y IN (0, 1) AND _id IS NOT NULL")
    known = known.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
    drawn = F.xxhash64("_id"), F.col("_id")
    some = known.filter("_y = 1").orderBy(*drawn).limit(toxic).unionByName(known.filter("_y = 0").orderBy(*drawn).limit(clean))
    # at most toxic + clean rows, so the broadcast is bounded
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some), "_id")
    rows = written(rows.groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_y").alias("_y")), "labelled")
    rows = rows.filter(F.coalesce(F.length("_text"), F.lit(0)) <= chars // 16)
    order = Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = rows.withColumn("_sum", F.sum(F.coalesce(F.length("_text"), F.lit(0))).over(order)).filter(F.col("_sum") <= chars)
    rows = sized.select("_id", "_text", "_y").toPandas().sort_values("_id")
    return fit(rows["_text"].tolist(), rows["_y"].to_numpy())


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(1), 1 << 19):
                part = batch.slice(a, b - a)
                scores = np.zeros(len(part)) if model is None else model.score(pc.fill_null(part.column(1), ""))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], names=["_id", "score"])

    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return narrow.mapInArrow(run, "_id long, score double").withColumnRenamed("_id", id_col)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score and predicted."""
    out = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return out.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, less the rows that score 0.5 or more."""
    if model is None:
        return docs
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = docs.columns.index(text_col)
    schema = inner.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(at), 1 << 19):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(model.score(pc.fill_null(part.column(at), "")) < 0.5))
        pa.default_memory_pool().release_unused()

    return inner.mapInArrow(run, schema).toDF(*docs.columns)
