"""The quality network against a direct walk over windows and chunks of the whole text."""

import random

import numpy as np
import pytest

from cairn.llm import quality
from cairn.llm.quality import CHUNK, COPY_FILTERS, FILTERS, HALF, LAGS, PADDING, STRIDE, WIDTH, ByteConvNet


def walked(net, text):
    """One text, window by window and chunk by chunk, in plain loops."""
    data, before = text + PADDING, PADDING[:HALF] + text + PADDING
    first = [-np.inf] * FILTERS
    for start in range(0, max(1, len(text)), STRIDE):
        for f in range(FILTERS):
            first[f] = max(first[f], sum(float(net.tables[k, data[start + k], f]) for k in range(WIDTH)))
    second = [-np.inf] * COPY_FILTERS
    for chunk in range(max(1, -(-len(text) // HALF) - 1)):
        places = range(HALF + chunk * HALF, HALF + chunk * HALF + CHUNK)
        shares = [sum(before[p] == before[p - lag] for p in places) / CHUNK for lag in range(2, LAGS + 1)]
        shares.append(max(shares))
        for f in range(COPY_FILTERS):
            second[f] = max(second[f], sum(s * float(net.copy[i, f]) for i, s in enumerate(shares)))
    logit = net.out_bias + sum(max(x + float(b), 0) * float(w) for x, b, w in zip([*first, *second], net.bias, net.out, strict=True))
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


@pytest.mark.parametrize("span", [262_144, 256])
def test_scores_are_those_of_a_direct_walk(monkeypatch, span):
    monkeypatch.setattr(quality, "SPAN", span)
    rng, dice = np.random.default_rng(4), random.Random(4)
    n = FILTERS + COPY_FILTERS
    net = ByteConvNet(rng.normal(size=(WIDTH, 256, FILTERS)).astype(np.float32), rng.normal(size=(LAGS, COPY_FILTERS)).astype(np.float32), rng.normal(size=n).astype(np.float32), (rng.normal(size=n) / 8).astype(np.float32), 0.3)
    texts = [b"", b"a", b"abc" * 40, "Ünï 漢字 😀 ".encode() * 30, bytes(dice.randrange(256) for _ in range(1500)), b"x" * 255, b"x" * 256, b"y" * 257, b"some words again and again " * 33]
    texts += [bytes(dice.choice(b"ab c") for _ in range(dice.randint(0, 700))) for _ in range(12)]
    assert np.allclose(net.probabilities(texts), [walked(net, t) for t in texts], atol=2e-4, rtol=0)
