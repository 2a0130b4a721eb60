"""A small causal self-attention model in numpy: training and window scoring.

One head of one layer over ``dim`` numbers per token.  The next token's class
is predicted by softmax; the id within its class follows the corpus counts.
Classes are made of ids of one kind (a word's start or not, the cluster of
documents where the id is at home) and of about equal mass, so a frequent id
has a class of its own.  Products with the id vectors are tables, so scoring
gathers them.  Arrays of a batch's size are kept from batch to batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW = 32
#: Positions at the start of a window (but the first) that serve as context only.
OVERLAP = 6
DIM = 16
CLASSES = 64
CLUSTERS = 6


def equal_mass(mass: np.ndarray, n: int) -> np.ndarray:
    """Bins 0..n-1 of about equal mass, the heaviest entries first."""
    order = np.argsort(-mass, kind="stable")
    out = np.zeros(len(mass), np.int64)
    left, at = float(mass.sum()), 0
    for c in range(n):
        want, got, start = left / (n - c), 0.0, at
        # A bin takes entries until it has its share; the last takes the rest.
        while at < len(order) and (at == start or got + mass[order[at]] / 2 <= want or c == n - 1):
            got += mass[order[at]]
            out[order[at]] = c
            at += 1
        left -= got
    return out


def document_clusters(histograms: np.ndarray, k: int) -> np.ndarray:
    """k-means of documents on the main directions of their id histograms."""
    x = np.sqrt(histograms / np.maximum(histograms.sum(1, keepdims=True), 1)).astype(np.float64)
    x -= x.mean(0)
    value, vector = np.linalg.eigh(x @ x.T)
    z = vector[:, -k:] * np.sqrt(np.maximum(value[-k:], 0))
    centres = [z[0]]
    for _ in range(k - 1):
        far = np.min([((z - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(z[far.argmax()])
    centres = np.array(centres)
    for _ in range(20):
        label = ((z[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([z[label == j].mean(0) if (label == j).any() else centres[j] for j in range(k)])
    return label


def classes_of(
    counts: np.ndarray, starts_word: np.ndarray, per_cluster: np.ndarray, n_classes: int = CLASSES
) -> tuple[np.ndarray, np.ndarray, int]:
    """(class of each id, ln P(id | class), number of classes inside words).

    Ids are grouped by whether they start a word and by the document cluster
    in which they are relatively most common (``per_cluster``, clusters x ids),
    and a group is cut into classes of equal mass by the corpus ``counts``
    (one added to each).  Classes of ids that start a word come last.
    """
    mass = counts.astype(np.float64) + 1.0
    k = len(per_cluster)
    share = per_cluster.sum(0) / max(1.0, per_cluster.sum())
    rate = (per_cluster + 0.02 * share) / (per_cluster.sum(1, keepdims=True) + 1.0)
    group = starts_word.astype(np.int64) * k + rate.argmax(0)
    weight = np.bincount(group, mass, 2 * k)
    bins = np.where(weight > 0, 1 + np.floor(weight / weight.sum() * (n_classes - 2 * k)), 0).astype(int)
    kind, at = np.zeros(len(mass), np.int32), 0
    for g in range(2 * k):
        if g == k:
            inside = at
        ids = np.flatnonzero(group == g)
        if len(ids):
            kind[ids] = at + equal_mass(mass[ids], bins[g])
            at += bins[g]
    total = np.bincount(kind, mass, n_classes)
    return kind, np.log(mass / total[kind]).astype(np.float32), inside


def windows_of(starts: np.ndarray, sizes: np.ndarray, window: int = WINDOW, overlap: int = OVERLAP):
    """(first token, first scored offset, length) of the windows of token runs.

    Every token is scored in exactly one window; a window but the first of its
    run begins with ``overlap`` tokens that the one before it has scored.
    """
    step = window - overlap
    n = np.maximum(1, -(-(sizes - overlap) // step))
    run = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    first = k * step
    length = np.minimum(window, sizes[run] - first)
    return starts[run] + first, np.where(k == 0, 0, overlap), length, run


#: Multiply-adds up to which BLAS libraries keep a product in the calling thread.  Tasks
#: have a core each: products that wake other threads cost several times as much.
ONE_THREAD = 1 << 18


def rows_times(x: np.ndarray, m: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """``x @ m`` of many rows, in products of at most ``ONE_THREAD``."""
    if out is None:
        out = np.empty((len(x), m.shape[1]), np.float32)
    step = max(1, ONE_THREAD // m.size)
    whole = len(x) // step * step
    if whole:
        np.matmul(x[:whole].reshape(-1, step, x.shape[1]), m, out=out[:whole].reshape(-1, step, m.shape[1]))
    if whole < len(x):
        np.matmul(x[whole:], m, out=out[whole:])
    return out


def sum_of_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a.T @ b`` of many rows, in products of at most ``ONE_THREAD``."""
    step = max(1, ONE_THREAD // (a.shape[1] * b.shape[1]))
    whole = len(a) // step * step
    # The wider side first: libraries work on its columns some at a time.
    out = b[whole:].T @ a[whole:]
    if whole:
        out += np.matmul(b[:whole].reshape(-1, step, b.shape[1]).transpose(0, 2, 1), a[:whole].reshape(-1, step, a.shape[1])).sum(0)
    return out.T


def _exponentials(x: np.ndarray, limit: float | None) -> np.ndarray:
    """``exp(x)`` in place; a limit keeps it finite."""
    if limit is not None:
        np.minimum(x, limit, out=x)
    with np.errstate(over="ignore"):
        return np.exp(x, out=x)


def _attended(q: np.ndarray, k: np.ndarray, v: np.ndarray, out: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(masked exponentials, in ``out``; their sums of the values) of (n, w, d) queries and keys.

    The last column of the values is 1, so that of the sums is what shares are divided by.
    """
    for limit in (None, 60.0):
        np.matmul(q, k.transpose(0, 2, 1), out=out)
        _exponentials(out, limit)
        with np.errstate(invalid="ignore"):  # infinite outside the mask
            out *= mask
            sums = np.matmul(out, v)
        if np.isfinite(sums[..., -1]).all():
            break
    return out, sums


def _class_masses(x: np.ndarray, m: np.ndarray, out: np.ndarray, groups: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exp(x @ m), in ``out``; its sums by group of classes; what stood at the places ``at`` before exp)."""
    for limit in (None, 80.0):
        rows_times(x, m, out)
        if limit is not None:
            np.minimum(out, limit, out=out)
        picked = out.reshape(-1)[at]
        _exponentials(out, None)
        with np.errstate(invalid="ignore"):
            sums = rows_times(out, groups)
        if np.isfinite(sums).all():
            break
    return out, sums, picked


class Buffers:
    """Arrays of the size of a batch, kept from batch to batch."""

    def __init__(self):
        self.held: dict[tuple, np.ndarray] = {}

    def get(self, name: str, n: int, *shape: int) -> np.ndarray:
        held = self.held.get((name, *shape))
        if held is None or len(held) < n:
            held = self.held[(name, *shape)] = np.empty((n, *shape), np.float32)
        return held[:n]

    def mask(self, w: int) -> np.ndarray:
        if self.held.get("mask") is None or len(self.held["mask"]) != w:
            self.held["mask"] = np.tril(np.ones((w, w), np.float32))
        return self.held["mask"]


@dataclass
class Tables:
    """What scoring needs; see ``Attention.tables``.

    ``rows`` and ``places``: query, embedding, value and a one of each id and of each
    place in a window, side by side (a place's one is 0); embeddings are the keys,
    values are added to them.  ``last``: from (embedding, 1) to the classes.
    """

    rows: np.ndarray
    places: np.ndarray
    last: np.ndarray
    kind: np.ndarray
    inner: np.ndarray
    inside: int

    def __post_init__(self):
        self._buffers = Buffers()
        starts = np.arange(self.last.shape[1]) >= self.inside
        self._groups = np.stack([~starts, starts], 1).astype(np.float32)

    def log_probabilities(self, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ln P(target) and ln P(a word starts) at each place of (batch, window)
        inputs, or only at the ``scored`` ones, in order; places after a window's
        end hold any ids and are to be left out by the caller."""
        n, w = inputs.shape
        d, c, buffers = len(self.last) - 1, self.last.shape[1], self._buffers
        x = np.take(self.rows, inputs.ravel(), 0, out=buffers.get("x", n * w, 3 * d + 1), mode="clip").reshape(n, w, -1)
        x += self.places[:w]
        # Places before the first that is scored are only attended to.
        skip = 0 if scored is None else int(scored.any(0).argmax())
        _, h = _attended(x[:, skip:, :d], x[..., d : 2 * d], x[..., 2 * d :], buffers.get("a", n, w, w)[:, skip:], buffers.mask(w)[skip:])
        h /= h[..., d:].copy()
        h[..., :d] += x[:, skip:, d : 2 * d]
        h, goal = h.reshape(-1, d + 1), targets.ravel()
        if scored is not None:
            h, goal = h[np.flatnonzero(scored[:, skip:])], targets[scored]
        z = buffers.get("z", n * w, c)[: len(h)]
        _, mass, picked = _class_masses(h, self.last, z, self._groups, np.arange(len(h)) * c + self.kind[goal])
        every = np.log(np.maximum(mass[:, 0] + mass[:, 1], 1e-30))
        own, begin = picked - every + self.inner[goal], np.log(np.maximum(mass[:, 1], 1e-30)) - every
        return (own.reshape(n, w), begin.reshape(n, w)) if scored is None else (own, begin)


class Attention:
    """Parameters, gradients and the training loop."""

    def __init__(self, vocabulary: int, kind: np.ndarray, inner: np.ndarray, inside: int, n_classes: int = CLASSES, dim: int = DIM, window: int = WINDOW, seed: int = 3):
        rng = np.random.default_rng(seed)
        normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.kind, self.inner, self.inside, self.dim = kind, inner, inside, dim
        self.p = {
            "e": normal(vocabulary, dim, scale=0.1), "pos": normal(window, dim, scale=0.1),
            "wq": normal(dim, dim, scale=dim**-0.5), "wk": normal(dim, dim, scale=dim**-0.5),
            "wv": normal(dim, dim, scale=dim**-0.5), "wo": normal(dim, dim, scale=dim**-0.5),
            "wc": normal(dim, n_classes, scale=dim**-0.5), "b": np.zeros(n_classes, np.float32),
        }
        self.state = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.buffers = Buffers()

    def _products(self) -> tuple[np.ndarray, np.ndarray]:
        """What a query's embedding is multiplied with before it meets a key's, and
        what turns embeddings into the values that are added to a place's own."""
        p = self.p
        return p["wq"] @ p["wk"].T * np.float32(self.dim**-0.5), p["wv"] @ p["wo"]

    def loss_and_gradients(self, inputs, targets, mask):
        """Mean negative ln P(class) over the masked places, and its gradients.

        Places meet the products of two weights; the gradients of both follow from
        that of their product.  Products run over the places of all windows, those
        with the classes over the masked ones; columns of ones give sums and the
        gradient of the bias.
        """
        p, d, buffers = self.p, self.dim, self.buffers
        n, w = inputs.shape
        flat = inputs.ravel()
        x = np.take(p["e"], flat, 0, out=buffers.get("x", n * w, d), mode="clip")
        x.reshape(n, w, d)[...] += p["pos"][:w]
        into = np.hstack(self._products())
        qv = buffers.get("qv", n * w, 2 * d + 1)
        rows_times(x, into, qv[:, : 2 * d])
        qv[:, 2 * d] = 1.0
        k, qv = x.reshape(n, w, d), qv.reshape(n, w, -1)
        q, v = qv[..., :d], qv[..., d:]
        a, sums = _attended(q, k, v, buffers.get("a", n, w, w), buffers.mask(w))
        sums = sums.reshape(n * w, -1)
        o = np.divide(sums, sums[:, d:], out=buffers.get("o", n * w, d + 1))
        places = np.flatnonzero(mask)
        weight = (mask / mask.sum()).ravel()[places]
        h = np.take(o, places, 0, out=buffers.get("h", n * w, d + 1)[: len(places)], mode="clip")
        h[:, :d] += x[places]
        c = len(p["b"])
        at = np.arange(len(places)) * c + self.kind[targets.ravel()[places]]
        z, total, picked = _class_masses(h, np.vstack([p["wc"], p["b"]]), buffers.get("z", n * w, c)[: len(places)], np.ones((c, 1), np.float32), at)
        total = total[:, 0]
        loss = float((np.log(total) - picked) @ weight)
        z *= (weight / total)[:, None]
        z.reshape(-1)[at] -= weight
        last = sum_of_products(h, z)
        g = {"wc": last[:d], "b": last[d]}
        dx = buffers.get("dx", n * w, d)
        dx[...] = 0.0
        dx[places] = rows_times(z, p["wc"].T)
        do = buffers.get("do", n * w, d + 1)
        do[:, :d] = dx
        np.negative(np.einsum("ij,ij->i", dx, o[:, :d]), out=do[:, d])
        do /= sums[:, d:]
        do = do.reshape(n, w, -1)
        ds = np.matmul(do, v.transpose(0, 2, 1), out=buffers.get("ds", n, w, w))
        ds *= a
        back = buffers.get("back", n * w, 2 * d)
        own = back.reshape(n, w, -1)
        np.matmul(ds, k, out=own[..., :d])
        np.matmul(a.transpose(0, 2, 1), do[..., :d], out=own[..., d:])
        dx += np.matmul(ds.transpose(0, 2, 1), q, out=buffers.get("dk", n, w, d)).reshape(n * w, d)
        dx += rows_times(back, into.T)
        met, added = np.hsplit(sum_of_products(x, back), 2)
        met = met * np.float32(d**-0.5)
        g["wq"], g["wk"] = met @ p["wk"], met.T @ p["wq"]
        g["wv"], g["wo"] = added @ p["wo"].T, p["wv"].T @ added
        g["pos"] = np.zeros_like(p["pos"])
        g["pos"][:w] = dx.reshape(n, w, d).sum(0)
        return loss, g, self._by_id(flat, dx)

    def _by_id(self, flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids that occur, sums of their rows)."""
        seen = np.zeros(len(self.kind), bool)
        seen[flat] = True
        ids = np.flatnonzero(seen)
        number = np.empty(len(seen), np.int64)
        number[ids] = np.arange(len(ids)) * self.dim
        slot = number[flat][:, None] + np.arange(self.dim)
        return ids, np.bincount(slot.ravel(), rows.ravel(), len(ids) * self.dim).reshape(-1, self.dim).astype(np.float32)

    def step(self, g, sparse, rate: float) -> None:
        """AdaGrad: stochastic gradient descent with a rate per parameter."""
        for key, value in g.items():
            self.state[key] += value * value
            self.p[key] -= rate * value / (np.sqrt(self.state[key]) + 1e-6)
        ids, rows = sparse
        state = self.state["e"][ids] + rows * rows
        self.state["e"][ids] = state
        self.p["e"][ids] -= rate * rows / (np.sqrt(state) + 1e-6)

    def begin(self, per_id: np.ndarray) -> None:
        """The bias of each class from the counts of its ids."""
        total = np.bincount(self.kind, per_id, len(self.p["b"])) + 1.0
        self.p["b"] = np.log(total / total.sum()).astype(np.float32)

    def rows(self, of: dict) -> np.ndarray:
        """Parameters (or their states) as one array of rows of ``dim`` numbers, the ids' first."""
        return np.concatenate([of[k].reshape(-1, self.dim) for k in self.p])

    def load(self, weights: np.ndarray, state: np.ndarray) -> None:
        """The inverse of ``rows`` for both."""
        for of, rows in ((self.p, weights), (self.state, state)):
            at = 0
            for k in self.p:
                n = of[k].size // self.dim
                of[k] = rows[at : at + n].reshape(of[k].shape).astype(np.float32)
                at += n

    def fit(self, inputs, targets, mask, *, epochs: int = 1, batch: int = 128, rate: float = 0.08, seed: int = 5) -> list[float]:
        rng = np.random.default_rng(seed)
        losses = []
        for _ in range(epochs):
            order = rng.permutation(len(inputs))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                loss, g, sparse = self.loss_and_gradients(inputs[part], targets[part], mask[part])
                self.step(g, sparse, rate)
                losses.append(loss)
        return losses

    def tables(self) -> Tables:
        p, (meet, add) = self.p, self._products()
        f = lambda t: np.ascontiguousarray(t, np.float32)
        one = lambda t, v: np.full((len(t), 1), v, np.float32)
        rows, places = (np.hstack([t @ meet, t, t @ add, one(t, v)]) for t, v in ((p["e"], 1), (p["pos"], 0)))
        return Tables(f(rows), f(places), f(np.vstack([p["wc"], p["b"]])), self.kind, self.inner, self.inside)
