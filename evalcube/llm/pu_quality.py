"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are the texts labelled 1, the unlabelled are all learning texts
as they come from the web. A linear scorer over text statistics and hashed
character trigrams minimises
    prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])
with the sigmoid loss by mini-batches; where the bracket turns negative the step
goes against it, which keeps the risk from overfitting. The class prior is the
share of label 1 among the labelled learning rows. The score is the output after
Platt scaling on labelled learning rows, each class weighted to its full count.

At most ``max_positive`` positives and ``max_unlabelled`` others, chosen by hash,
are fitted on; only their feature vectors reach the driver.

Defined cases: null or empty text has all-zero features and gets a score; without
positive labels every score is the prior (0.5 if nothing is labelled); labels of
ids that occur twice count for each row; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, with_uid
from .shingles import buffers, words_of

HASHED = 256
#: Byte classes: lower, upper, digit, space, stop marks, symbols, other ASCII, beyond ASCII.
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 10, 11, 12, 13]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 5
_CLASS[128:] = 7
N_FEATURES = 8 + 10 + HASHED


def features(texts: list[bytes]) -> np.ndarray:
    """One row of N_FEATURES numbers for each text."""
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    for first, part in buffers(texts):
        raw, h, start, end, off = words_of(part)
        buf = np.frombuffer(raw, np.uint8)
        size = np.array([len(t) + 1 for t in part], np.int64)
        doc = np.repeat(np.arange(len(part)), size)
        n = np.maximum(size - 1, 1).astype(np.float64)
        rows = slice(first, first + len(part))
        out[rows, :8] = np.bincount(doc * 8 + _CLASS[buf], minlength=8 * len(part)).reshape(-1, 8) / n[:, None]
        wdoc = np.repeat(np.arange(len(part)), np.diff(off))
        words = np.diff(off)
        w = np.maximum(words, 1).astype(np.float64)
        per = lambda x: np.bincount(wdoc, weights=x, minlength=len(part)) / w  # noqa: E731, B023
        length = (end - start).astype(np.float64)
        mean = per(length)
        # distinct words and pairs, share of the commonest word, words equal to the one before
        order = np.lexsort((h, wdoc))
        hs, ds = h[order], wdoc[order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
        runs = np.diff(np.concatenate([np.flatnonzero(new), [len(hs)]]))
        top = np.zeros(len(part))
        np.maximum.at(top, ds[new], runs)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
        lines = np.bincount(doc[buf == 10], minlength=len(part)) - 1.0  # the separator is one
        upper = (buf[start] >= 65) & (buf[start] <= 90)
        shout = upper & (length > 1) & (_CLASS[buf[np.minimum(start + 1, end - 1)]] == 1)
        last = _CLASS[buf[end - 1]] if len(end) else np.zeros(0, np.int64)
        extra = (mean, np.sqrt(np.maximum(per(length * length) - mean * mean, 0)), np.log1p(words) / 5, np.bincount(ds[new], minlength=len(part)) / w,
                 top / w, per(same), per(upper), per(shout), per(last == 5), np.maximum(lines, 0) / w)
        out[rows, 8:18] = np.stack(extra, 1)
        low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint32)
        tri = ((low[:-2] * 65537 + low[1:-1] * 257 + low[2:]) * np.uint32(2654435761)) >> np.uint32(24)
        ok = (doc[:-2] == doc[2:])
        hashed = np.bincount(doc[:-2][ok] * HASHED + tri[ok], minlength=HASHED * len(part)).reshape(-1, HASHED)
        out[rows, 18:] = np.sqrt(hashed / n[:, None])
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Scorer:
    """Standardised linear scorer with Platt scaling."""

    def __init__(self, mean, scale, weight, bias, a=1.0, b=0.0):
        self.mean, self.scale, self.weight, self.bias, self.a, self.b = mean, scale, weight, bias, a, b

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.a * self.raw(x) + self.b)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, batch: int = 512, rate: float = 0.01,
             decay: float = 1e-4, seed: int = 3) -> Scorer:
    """Minimise the non-negative risk with Adam over mini-batches."""
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -6, 6).astype(np.float64) for x in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    theta = np.zeros(p.shape[1] + 1)
    m, v, t = np.zeros_like(theta), np.zeros_like(theta), 0
    steps = max(1, -(-len(u) // batch))
    for _ in range(epochs):
        pu, pp = rng.permutation(len(u)), rng.permutation(len(p))
        for s in range(steps):
            xu = u[pu[s * batch:(s + 1) * batch]]
            xp = p[pp[s * batch % len(p):][:batch]]
            fu, fp = xu @ theta[:-1] + theta[-1], xp @ theta[:-1] + theta[-1]
            # sigmoid loss l(z) = sigmoid(-z), slope -s(1 - s)
            su, sp = _sigmoid(fu), _sigmoid(fp)
            negative = su.mean() - prior * sp.mean()  # E_u[l(-f)] - prior * E_p[l(-f)]
            gu, gp = su * (1 - su) / len(su), prior * sp * (1 - sp) / len(sp)
            grad = lambda cu, cp: np.concatenate([xu.T @ cu + xp.T @ cp, [cu.sum() + cp.sum()]])  # noqa: E731, B023
            g = grad(gu, -gp - gp) if negative >= 0 else -grad(gu, -gp)
            g[:-1] += decay * theta[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Scorer(mean, scale, theta[:-1], float(theta[-1]))


def platt(scorer: Scorer, x: np.ndarray, y: np.ndarray, n_positive: float, n_negative: float, rounds: int = 50) -> None:
    """Fit a and b of sigmoid(a * raw + b) by Newton steps with smoothed targets.

    The rows of each class stand for ``n_positive`` and ``n_negative`` of them, however many were sampled.
    """
    f = scorer.raw(x)
    hi, lo = (n_positive + 1) / (n_positive + 2), 1 / (n_negative + 2)
    t = np.where(y == 1, hi, lo)
    many = np.where(y == 1, n_positive / max(1, (y == 1).sum()), n_negative / max(1, (y == 0).sum()))
    z = np.stack([f, np.ones_like(f)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        s = _sigmoid(z @ w)
        h = (z * (many * (s * (1 - s) + 1e-9))[:, None]).T @ z + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (many * (s - t)))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    scorer.a, scorer.b = float(w[0]), float(w[1])


#: Values of the hash that chooses the sample.
_HASHES = 1 << 40


def _chosen(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About ``most`` of ``n`` rows (all of fewer), by hash of the row number; never more than twice as many."""
    share = min(_HASHES, _HASHES * most // max(1, n))
    return rows.filter(F.pmod(F.xxhash64("uid", F.lit(11)), F.lit(_HASHES)) < share).limit(2 * most)


def _measured(some: DataFrame):
    """Features and labels of (text, y) rows."""

    def measure(batches):
        for b in batches:
            x = features([(t or "").encode("utf-8", "surrogatepass") for t in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1)], names=["x", "y"])

    got = some.select("text", "y").mapInArrow(measure, "x binary, y int").toPandas()
    return np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, N_FEATURES), got["y"].to_numpy()


def score_quality(docs: DataFrame, labels: DataFrame, learn: F.Column, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", max_positive: int = 12_000, max_unlabelled: int = 24_000) -> DataFrame:
    """(uid, id, score), one row for each row of ``docs``; ``learn`` says which rows may be learned from."""
    rows = with_uid(docs)
    teach = rows.filter(learn).select("uid", F.col(id_col).alias("id"))
    marked = stage(teach.join(labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
                              .filter("y IS NOT NULL"), "id").select("uid", "y"), "pu-labels")
    text = rows.select("uid", F.col(text_col).alias("text"))

    def sample(some: DataFrame, n: int, most: int):
        # at most 2 * most row numbers, so the broadcast is bounded by the parameter and no text is moved
        return _measured(text.join(F.broadcast(_chosen(some, n, most)), "uid"))

    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    scorer = None
    if counts.get(1):
        p, _ = sample(marked.filter("y = 1"), counts[1], max_positive)
        u, _ = sample(teach.select("uid", F.lit(-1).alias("y")), teach.count(), max_unlabelled)
        if len(p) and len(u):
            scorer = fit_nnpu(p, u, prior)
            bad = sample(marked.filter("y = 0"), counts[0], max_positive)[0] if counts.get(0) else p[:0]
            if len(bad):
                platt(scorer, np.concatenate([p, bad]), np.concatenate([np.ones(len(p)), np.zeros(len(bad))]), counts[1], counts[0])
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    typ = dict(docs.dtypes)[id_col]

    def predict(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(2).to_pylist()]
            s = sent.value.score(features(texts)).astype(np.float64) if sent.value is not None else np.full(len(texts), prior)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["uid", "id", "score"])

    out = rows.select("uid", F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("raw")).mapInArrow(
        predict, f"uid bigint, id {typ}, score double")
    return out.withColumnRenamed("id", id_col)


