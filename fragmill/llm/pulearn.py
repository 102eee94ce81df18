"""Text quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled documents of good quality; everything else is
unlabelled web text, good and bad, with a share ``prior`` of good.  A small
network over shape features of a text minimises

    prior * E_P[l(g, +1)] + max(0, E_U[l(g, -1)] - prior * E_P[l(g, -1)])

with the logistic loss (Kiryo and others, 2017): where the bracket falls below
zero, the step ascends it instead, so the network cannot fit the unlabelled
set by calling its good part bad.  Negative labels are never used.

The prior is estimated first from the same two sets: a classifier of P against
U has odds P : U of (n_P / n_U) * p(x | good) / p(x), and p(x) is at least
prior * p(x | good), with equality where bad text is absent.  So the share of
U over the share of P, among texts that look most like P, tends to the prior
from above.

Fitting reads bounded samples (``max_rows`` positives and as many unlabelled
documents, by a hash) and runs in one task in a fixed order; the features of a
text, and its score, see all of it.

Null and empty texts have features of zero and are scored by them.  Rows that
repeat a doc_id are scored one by one, and rows that also repeat its text teach
once.  A document is a positive if any of its labels says so; null labels are
none.  A null doc_id teaches nothing and counts as held out.  With no positives
or no unlabelled rows every score is 0.5.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm import bytesops as B
from fragmill.llm.ftrl import learnable
from fragmill.llm.runtime import sampled

MAX_ROWS = 6_000
HIDDEN, STEPS, RATE, DECAY, BATCH = 24, 1500, 5e-3, 1e-4, 256

_KIND = np.zeros(256, np.int64)  # 0: other
_KIND[0x61:0x7B] = 1
_KIND[0x41:0x5B] = 2
_KIND[0x30:0x3A] = 3
_KIND[0x80:] = 4
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 5
_KIND[0x0A] = 6
_KIND[[ord(c) for c in ".,;:'\"?-()"]] = 7
_KIND[[ord(c) for c in "!#$%&*@^~+=<>"]] = 8
_KIND[[ord(c) for c in "|/\\_{}[]`"]] = 9
N_KINDS = 10
N_FEATURES = N_KINDS + 11


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of shape features for each text: shares of byte kinds, and word statistics."""
    rows = len(offsets) - 1
    out = np.zeros((rows, N_FEATURES), np.float32)
    for i, j in B.slices(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = j - i
        size = np.maximum(np.diff(at), 1)
        kind = _KIND[part]
        row = np.repeat(np.arange(n), np.diff(at))
        shares = np.bincount(row * N_KINDS + kind, minlength=n * N_KINDS).reshape(n, N_KINDS) / size[:, None]
        starts, ends, first = B.word_spans(part, at)
        words = np.diff(first)
        many = np.maximum(words, 1)
        own = np.repeat(np.arange(n), words)
        h = B.span_hash(B.prefix_hash(part), starts, ends)
        length = (ends - starts).astype(float)
        mean = np.bincount(own, length, n) / many
        spread = np.sqrt(np.maximum(np.bincount(own, length**2, n) / many - mean**2, 0))
        order = np.lexsort((h, own))
        hs, os = h[order], own[order]
        fresh = np.ones(len(hs), bool)
        fresh[1:] = (hs[1:] != hs[:-1]) | (os[1:] != os[:-1])
        groups = np.flatnonzero(fresh)
        times = np.diff(np.concatenate([groups, [len(hs)]]))
        distinct = np.bincount(os[groups], minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, os[groups], times)
        twin = np.zeros(n)
        if len(h) > 1:
            twin = np.bincount(own[1:][(h[1:] == h[:-1]) & (own[1:] == own[:-1])], minlength=n)
        last = part[ends - 1] if len(ends) else np.zeros(0, np.uint8)
        odd = np.isin(_KIND[last], (0, 8, 9))
        lone = (length == 1) & odd if len(length) else odd
        capital = _KIND[part[starts]] == 2 if len(starts) else odd
        lines = np.bincount(row[part == 0x0A], minlength=n) + 1
        cols = [distinct / many, top / many, twin / many, np.minimum(mean, 40) / 10, np.minimum(spread, 40) / 10, np.bincount(own[odd], minlength=n) / many, np.bincount(own[lone], minlength=n) / many, np.bincount(own[capital], minlength=n) / many, np.log1p(words) / 5, np.log1p(lines) / 5, np.log1p(many / lines) / 5]
        out[i:j, :N_KINDS] = shares
        out[i:j, N_KINDS:] = np.stack(cols, axis=1)
        out[i:j][np.diff(at) == 0] = 0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    """One hidden layer of tanh; numpy arrays only, so that a model is a short list of numbers."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = len(mean)
        self.mean, self.scale = mean, scale
        self.params = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params]
        self.t = 0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b, v, c = self.params
        hidden = np.tanh(z @ w + b)
        return hidden @ v + c[0], hidden

    def step(self, z: np.ndarray, hidden: np.ndarray, slope: np.ndarray) -> None:
        """One Adam step down the gradient that ``slope`` (by row, of the output) gives."""
        w, _, v, _ = self.params
        back = slope[:, None] * v * (1 - hidden**2)
        grads = [z.T @ back + DECAY * w, back.sum(0), hidden.T @ slope + DECAY * v, np.array([slope.sum()])]
        self.t += 1
        for p, g, (m, s) in zip(self.params, grads, self.moments, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= RATE * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.999**self.t)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(self.scaled(x))[0])


def _batches(n_pos: int, n_all: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    for _ in range(STEPS):
        yield rng.integers(0, n_pos, BATCH), rng.integers(0, n_all, BATCH)


def estimate_prior(pos: np.ndarray, unl: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> float:
    """Share of good text among the unlabelled, from a classifier of one set against the other."""
    net = Net(mean, scale, seed=11)
    zp, zu = net.scaled(pos), net.scaled(unl)
    for p, u in _batches(len(zp), len(zu), 12):
        z = np.concatenate([zp[p], zu[u]])
        g, hidden = net.forward(z)
        net.step(z, hidden, (_sigmoid(g) - np.repeat([1.0, 0.0], BATCH)) / (2 * BATCH))
    sp, su = net.forward(zp)[0], net.forward(zu)[0]
    best = 1.0
    for q in (0.1, 0.2, 0.3, 0.4, 0.5):
        bar = np.quantile(sp, q)
        best = min(best, (su >= bar).mean() / max((sp >= bar).mean(), 1e-9))
    return float(np.clip(best, 0.01, 0.99))


def risk_slope(gp: np.ndarray, gu: np.ndarray, prior: float) -> np.ndarray:
    """The derivative to follow downhill, by outputs of positives and then unlabelled rows.

    That of the whole risk where the bracket is positive; else the bracket's own with its sign turned, so that it is ascended.
    """
    rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    down_p, neg_p, neg_u = -_sigmoid(-gp) * prior / len(gp), _sigmoid(gp) * prior / len(gp), _sigmoid(gu) / len(gu)
    return np.concatenate([down_p - neg_p, neg_u] if rest >= 0 else [neg_p, -neg_u])


def train(pos: np.ndarray, unl: np.ndarray, prior: float | None = None) -> tuple[Net, float]:
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    prior = estimate_prior(pos, unl, mean, scale) if prior is None else prior
    net = Net(mean, scale)
    zp, zu = net.scaled(pos), net.scaled(unl)
    for p, u in _batches(len(zp), len(zu), 13):
        z = np.concatenate([zp[p], zu[u]])
        g, hidden = net.forward(z)
        net.step(z, hidden, risk_slope(g[:BATCH], g[BATCH:], prior))
    return net, prior


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of each sampled row; rows of one h are told once a task."""
    seen: set[tuple[bool, int]] = set()
    for batch in batches:
        keys = zip(batch.column("positive").to_pylist(), batch.column("h").to_pylist(), strict=True)
        batch = batch.take(pa.array([k for k, key in enumerate(keys) if not (key in seen or seen.add(key))], pa.int64()))
        x = features(*B.text_bytes(batch.column("text")))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("positive"), lists], names=["h", "positive", "x"])


def _trainer(prior: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ps, last = [np.zeros((0, N_FEATURES))], [np.zeros(0, bool)], None
        for batch in batches:
            key = list(zip(batch.column("positive").to_pylist(), batch.column("h").to_pylist(), strict=True))
            own = np.array([a != b for a, b in zip(key, [last, *key], strict=False)], bool)
            xs.append(batch.column("x").flatten().to_numpy().reshape(-1, N_FEATURES).astype(float)[own])
            ps.append(batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)[own])
            last = key[-1] if key else last
        x, p = np.concatenate(xs), np.concatenate(ps)
        if p.any() and (~p).any():
            net, share = train(x[p], x[~p], prior)
            flat = [net.mean, net.scale, *net.params, np.array([share])]
            yield pa.RecordBatch.from_arrays([pa.array([v.ravel() for v in flat], pa.list_(pa.float64())), pa.array(range(len(flat)), pa.int32())], names=["v", "k"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, prior: float | None = None) -> tuple[Net | None, float]:
    """The network and the prior, from bounded samples; both sets leave out the held-out fold of doc_id."""
    usable = docs.where(learnable("doc_id", 5, 0)).select("doc_id", "text")
    good = labels.where((F.col(label) == 1) & learnable("doc_id", 5, 0)).select("doc_id").distinct()
    # At most about max_rows ids, so they may be broadcast.
    ids = good.where(sampled(F.xxhash64(F.lit("pu"), "doc_id"), max_rows / max(1, good.count())))
    pos = usable.join(F.broadcast(ids), "doc_id").select(F.xxhash64(F.lit("row"), "doc_id", "text").alias("h"), "text", F.lit(True).alias("positive"))
    u = F.xxhash64(F.lit("pu-all"), "doc_id", "text")
    unl = usable.where(sampled(u, max_rows / max(1, usable.count()))).select(u.alias("h"), "text", F.lit(False).alias("positive"))
    rows = pos.unionByName(unl).mapInArrow(_featurise, "h long, positive boolean, x array<float>")
    found = rows.repartition(1).sortWithinPartitions("positive", "h").mapInArrow(_trainer(prior), "v array<double>, k int").orderBy("k").collect()
    if not found:
        return None, 0.5
    v = [np.array(r["v"]) for r in found]
    net = Net(v[0], v[1])
    net.params = [v[2].reshape(N_FEATURES, HIDDEN), v[3], v[4], v[5]]
    net.moments = []
    return net, float(v[6][0])


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    """``docs`` (with a text column) and a column score, the probability of good quality; a column of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(*B.text_bytes(batch.column("text")))
            s = pa.array(held.value.score(x.astype(float)) if held.value else np.full(len(x), 0.5))
            yield pa.RecordBatch.from_arrays([s if c == "score" else y for c, y in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    out = docs.withColumn("score", F.lit(None).cast("double"))
    return out.mapInArrow(run, out.schema)


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), fit(docs, labels)[0])
    return out.select("doc_id", (~learnable("doc_id", 5, 0)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
