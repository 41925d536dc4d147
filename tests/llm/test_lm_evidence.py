"""The first weights' evidence, against its sums one bit after the other."""

import math

import numpy as np
from conftest import prose

from leafmill.llm import lm_scoring as L


def test_evidence(monkeypatch):
    monkeypatch.setattr(L, "EVIDENCE_BITS", 1000)
    texts = [prose(i, 60).encode() for i in range(12)] + [b"", "über \U0001f600".encode()]
    learn = np.array([i % 3 > 0 for i in range(len(texts))])
    tree = L.Tree(L.cell_counts([x for x, t in zip(texts, learn, strict=True) if t]))
    seen, times = L.seen_symbols(texts, learn)
    key, n = L.symbol_keys(tree, seen, times)
    known = L.Known(tree, key, L.node_logits(tree, key, n), seen)
    want = np.zeros((L.GATES, L.PREDICTORS, 1 + L.PREDICTORS))
    for (*steps, mark), t in zip(known.paths.flat.view(np.int8).reshape(-1, 4).tolist(), np.repeat(times, known.paths.lens).tolist(), strict=True):
        x = np.array(steps) / L.STEP
        chance = 1 / (1 + math.exp(-min(max(L.START * x.sum(), -L.LIMIT), L.LIMIT)))
        want[mark >> 1, :, 0] += t * x * ((mark & 1) - chance)
        want[mark >> 1, :, 1:] += t * chance * (1 - chance) * np.outer(x, x)
    assert np.allclose(L.evidence(known.paths, times), want, rtol=1e-9, atol=1e-9)
    assert "places" not in vars(known.paths)  # what only scores need is not sorted for the weights
    assert np.isfinite(L.Mixer(tree, known, L.first_weights(want)).scores(texts)).all() and "places" in vars(known.paths)
