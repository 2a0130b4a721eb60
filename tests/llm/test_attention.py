"""The attention model against plain loops: probabilities, gradients, windows."""

import numpy as np
import pyarrow as pa

from larder.llm import attention, lm
from larder.llm.common import text_chunks


def model(vocabulary=40, classes=8, dim=4, window=7, seed=1):
    rng = np.random.default_rng(seed)
    kind = rng.permutation(np.arange(vocabulary) % classes).astype(np.int32)
    mass = rng.random(vocabulary) + 0.1
    inner = np.log(mass / np.bincount(kind, mass)[kind]).astype(np.float32)
    net = attention.Attention(vocabulary, kind, inner, 3, n_classes=classes, dim=dim, window=window, seed=seed)
    for p in net.p.values():
        p += rng.standard_normal(p.shape).astype(np.float32) * 0.5
    return net, rng


def plain(net, inputs):
    """ln P(class) at each place, position by position, heads and masks spelt out."""
    p, d = {k: v.astype(np.float64) for k, v in net.p.items()}, net.dim
    out = np.zeros((*inputs.shape, len(p["b"])))
    for i, row in enumerate(inputs):
        x = [p["e"][t] + p["pos"][j] for j, t in enumerate(row)]
        for j in range(len(row)):
            score = [x[j] @ p["wq"] @ (x[m] @ p["wk"]) / np.sqrt(d) for m in range(j + 1)]
            share = np.exp(score - np.max(score))
            share /= share.sum()
            seen = sum(s * (x[m] @ p["wv"]) for m, s in enumerate(share))
            z = (x[j] + seen @ p["wo"]) @ p["wc"] + p["b"]
            out[i, j] = z - np.log(np.exp(z - z.max()).sum()) - z.max()
    return out


def test_scores_are_those_of_masked_attention():
    net, rng = model()
    inputs, targets = rng.integers(0, 40, (5, 7)), rng.integers(0, 40, (5, 7))
    want = plain(net, inputs)
    own, begin = net.tables().log_probabilities(inputs, targets)
    rows, places = np.indices(inputs.shape)
    np.testing.assert_allclose(own, want[rows, places, net.kind[targets]] + net.inner[targets], atol=2e-5)
    np.testing.assert_allclose(begin, np.log(np.exp(want[..., net.inside :]).sum(2)), atol=2e-5)
    # Over all ids the probabilities of a place add up to one.
    total = sum(np.exp(net.tables().log_probabilities(inputs, np.full_like(targets, t))[0]) for t in range(40))
    np.testing.assert_allclose(total, 1, atol=1e-5)
    # Later ids change nothing before them; another batch size gives the same.
    changed = inputs.copy()
    changed[:, 4:] = 0
    tables = net.tables()
    np.testing.assert_allclose(tables.log_probabilities(changed, targets)[0][:, :4], own[:, :4], atol=1e-6)
    np.testing.assert_allclose(tables.log_probabilities(inputs[:2, :5], targets[:2, :5])[0], own[:2, :5], atol=1e-6)


def test_gradients_are_finite_differences():
    net, rng = model(seed=2)
    inputs, targets = rng.integers(0, 40, (6, 7)), rng.integers(0, 40, (6, 7))
    mask = (rng.random((6, 7)) < 0.7).astype(np.float32)
    rows, places = np.indices(inputs.shape)

    def loss():
        told = plain(net, inputs)[rows, places, net.kind[targets]]
        return -(told * mask).sum() / mask.sum()

    got, gradients, (ids, sparse) = net.loss_and_gradients(inputs, targets, mask)
    assert abs(got - loss()) < 1e-5
    dense = np.zeros_like(net.p["e"])
    dense[ids] = sparse
    for name, gradient in {**gradients, "e": dense}.items():
        weights = net.p[name]
        for at in rng.choice(weights.size, min(12, weights.size), replace=False):
            place = np.unravel_index(at, weights.shape)
            old, step = weights[place], np.float32(1e-2)
            weights[place] = old + step
            up = loss()
            weights[place] = old - step
            down = loss()
            weights[place] = old
            assert abs((up - down) / (2 * step) - gradient[place]) < 2e-3, (name, place)


def test_training_lowers_the_loss_of_a_pattern():
    rng = np.random.default_rng(7)
    n = 400
    ids = np.cumsum(rng.integers(0, 2, (n, 8)) + 1, axis=1) % 16  # the next id depends on the last
    net = attention.Attention(16, np.arange(16, dtype=np.int32) % 8, np.zeros(16, np.float32), 2, n_classes=8, dim=8, window=7)
    losses = net.fit(ids[:, :-1], ids[:, 1:], np.ones((n, 7), np.float32), epochs=25, batch=32)
    assert np.mean(losses[-10:]) < 0.6 * np.mean(losses[:3])


def test_every_token_is_scored_once():
    for sizes in ([1], [7], [8, 1, 30, 7, 100]):
        starts = np.cumsum(sizes) - sizes
        first, skip, length, run = attention.windows_of(np.array(starts), np.array(sizes), 8, 3)
        scored = np.concatenate([np.arange(f + s, f + n) for f, s, n in zip(first, skip, length, strict=True)])
        assert sorted(scored.tolist()) == list(range(sum(sizes)))
        assert (length <= 8).all() and len(run) == len(first)


def test_scored_places_are_those_of_all_places():
    net, rng = model(seed=3)
    inputs, targets = rng.integers(0, 40, (9, 7)), rng.integers(0, 40, (9, 7))
    scored = rng.random((9, 7)) < 0.6
    tables = net.tables()
    for first in (0, 3, 6):
        scored[:, :first] = False
        scored[0, 6] = True
        for some, every in zip(tables.log_probabilities(inputs, targets, scored), tables.log_probabilities(inputs, targets), strict=True):
            np.testing.assert_allclose(some, every[scored], atol=2e-6)


def test_large_weights_stay_finite():
    net, rng = model(seed=4)
    net.p["b"] += 100
    net.p["wq"] *= 30
    net.p["wk"] = net.p["wq"].copy()  # a place meets itself with a high score
    inputs, targets = rng.integers(0, 40, (3, 7)), rng.integers(0, 40, (3, 7))
    assert all(np.isfinite(x).all() for x in net.tables().log_probabilities(inputs, targets, np.ones((3, 7), bool)))
    loss, gradients, (_, sparse) = net.loss_and_gradients(inputs, targets, np.ones((3, 7), np.float32))
    assert np.isfinite(loss) and np.isfinite(sparse).all() and all(np.isfinite(g).all() for g in gradients.values())


def test_ids_of_words_come_from_either_table(monkeypatch):
    texts = pa.array(["The cat  sat", None, "", "on the\tmat and the élan\nof Cats 12345", "the " * 50, "zz the"])
    chunk = next(text_chunks(texts))
    every = lm.words_of(chunk, lm.NOT_SPACE)
    with open(lm.MODEL_PATH, "rb") as file:
        model_file = file.read()
    encoder = lm.Ids(model_file).encoder
    lower = [(t or "").translate({c: c + 32 for c in range(65, 91)}).split() for t in texts.to_pylist()]
    want = [[i for w in words for i in encoder.encode(w)] + [lm.END] for words in lower]
    hashes, at = np.unique(every.hash, return_index=True)
    spelt = [[w for words in lower for w in words][i] for i in at]
    for limit in (0, lm.Ids.LIMIT):
        monkeypatch.setattr(lm.Ids, "LIMIT", limit)
        for fixed in (slice(0, 0), slice(None, None, 2), slice(None)):
            offsets, flat = lm.Ids(model_file).encode(pa.array(spelt[fixed], pa.string()))
            ids = lm.Ids(model_file, hashes[fixed], offsets, flat)
            for _ in range(2):  # again when all words are known
                got, per_row, words = ids.runs(chunk)
                assert got.tolist() == [i for row in want for i in row] and per_row.tolist() == [len(row) for row in want]
                known = np.isin(every.hash, hashes[fixed])
                assert (words.place >= 0).tolist() == known.tolist()
                assert (hashes[fixed][words.place[known]] == every.hash[known]).all()
