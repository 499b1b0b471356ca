"""Interpolated word n-gram models of graded text and their isotonic map.

One model a level.  A word's probability is a mixture of its bigram, its unigram
and a uniform floor, with weights fitted on held-out text.  Numbers and words outside the vocabulary are
classes by length, so names that occur once still say something.  All arrays are
plain NumPy, so a batch of texts is scored without a loop over words.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

LEVELS = ("primary", "secondary", "undergraduate", "specialist")  # fixed value: easiest first
WEIGHTS = (0.55, 0.40, 0.05)  # bigram, unigram, uniform: where the fit of the weights begins
QUANTILES = (0.25, 0.5, 0.75)  # of a document's windows
MIN_TEXTS = 2  # a word of fewer texts is a class of unknown words
WINDOW = 25  # words a surprisal is averaged over
SHARPNESS = 1.0
_CLASSES = 16


def word_class(word: str) -> int:
    """Class of a word outside the vocabulary: 0..3 numbers by length, 4.. other words by length."""
    if word[0].isdigit():
        return min(len(word), 4) - 1
    return 4 + min(len(word) // 2, _CLASSES - 5)


def encode(words: list[str], ids: dict[str, int]) -> np.ndarray:
    get = ids.get
    return np.fromiter((i if (i := get(w)) is not None else word_class(w) for w in words), np.int64, len(words))


def fit(texts: list[list[str]], levels: list[int]) -> dict:
    """Model from tokenised texts and their levels (0..3)."""
    seen = Counter(w for t in texts for w in set(t))
    ids = {w: _CLASSES + i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= MIN_TEXTS))}
    size = _CLASSES + len(ids)
    coded = [encode(t, ids) for t in texts]
    uni = np.zeros((len(LEVELS), size))
    pairs = []
    for x, level in zip(coded, levels):
        np.add.at(uni[level], x, 1)
        pairs.append((x[:-1] * size + x[1:]) * len(LEVELS) + level)
    keyed, counts = np.unique(np.concatenate(pairs) if pairs else np.zeros(0, np.int64), return_counts=True)
    keys, at = np.unique(keyed // len(LEVELS), return_inverse=True)
    bi = np.zeros((len(keys) + 1, len(LEVELS)))
    np.add.at(bi, (at, keyed % len(LEVELS)), counts)
    history = uni[:, keys // size].T if len(keys) else np.zeros((0, len(LEVELS)))
    bi[:-1] /= np.maximum(history, 1)
    unigram = (uni / np.maximum(uni.sum(axis=1, keepdims=True), 1)).T
    return {"ids": ids, "size": size, "uni": unigram, "keys": np.append(keys, np.int64(2**62)), "bi": bi, "seen": (uni > 0).T}


def known_share(model: dict, words: list[str]) -> float:
    """Share of the words that are in the vocabulary."""
    return sum(w in model["ids"] for w in words) / max(1, len(words))


def _parts(model: dict, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bigram and unigram probability of every word under every level's model."""
    x = encode(words, model["ids"])
    uni = model["uni"][x]
    pair = np.empty_like(uni)
    if len(x):
        pair[0] = uni[0]
        key = x[:-1] * model["size"] + x[1:]
        at = np.searchsorted(model["keys"], key)
        hit = model["keys"][at] == key
        pair[1:] = np.where(hit[:, None], model["bi"][np.where(hit, at, -1)], 0.0)
        # A history the level never saw leaves its bigram weight to the unigram.
        known = model["seen"][x[:-1]]
        pair[1:] = np.where(known, pair[1:], uni[1:])
    return pair, uni


def surprisals(model: dict, words: list[str]) -> np.ndarray:
    """Surprisal in nats of every word under every level's model."""
    pair, uni = _parts(model, words)
    w2, w1, w0 = model.get("weights", WEIGHTS)
    return -np.log(w2 * pair + w1 * uni + w0 / model["size"])


def held_out_weights(model: dict, texts: list[list[str]], levels: list[int], rounds: int = 15) -> np.ndarray:
    """Weights of the mixture that make texts the model has not seen most likely under their own level (expectation-maximisation)."""
    parts = [[p[:, level] for p in _parts(model, t)] for t, level in zip(texts, levels) if t]
    if not parts:
        return np.array(WEIGHTS)
    pair, uni = (np.concatenate(x) for x in zip(*parts))
    p = np.stack([pair, uni, np.full(len(uni), 1 / model["size"])])
    w = np.array(WEIGHTS)
    for _ in range(rounds):
        share = w[:, None] * p
        w = (share / share.sum(axis=0)).mean(axis=1)
    return np.maximum(w, 1e-3) / np.maximum(w, 1e-3).sum()


def grade(model: dict, words: list[str]) -> tuple[float, float, float]:
    """(difficulty 0..3, share of windows nearest to the top level, mean surprisal under the best level) of a text.

    The text's surprisals are averaged over windows of ``WINDOW`` words, all of
    them; each window has a mean level, weighted by how well the levels explain it.
    The difficulty is taken from the distribution of the windows: the mean of its
    ``QUANTILES``, so a quotation or a reference list does not move it much.
    """
    if not words:
        return float("nan"), float("nan"), float("nan")
    s = surprisals(model, words)
    starts = np.arange(0, len(words), WINDOW)
    lengths = np.diff(np.append(starts, len(words)))
    mean = np.add.reduceat(s, starts) / lengths[:, None]
    fit_ = -mean * np.minimum(lengths, WINDOW)[:, None] * SHARPNESS
    fit_ -= fit_.max(axis=1, keepdims=True)
    p = np.exp(fit_)
    p /= p.sum(axis=1, keepdims=True)
    level = p @ np.arange(len(LEVELS))
    weight = lengths / lengths.sum()
    order = np.argsort(level, kind="stable")
    middle = np.cumsum(weight[order]) - weight[order] / 2
    x = float(np.interp(QUANTILES, middle, level[order]).mean())
    return x, float((p.argmax(axis=1) == len(LEVELS) - 1) @ weight), float(mean.min(axis=1) @ weight)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on x: knots and non-decreasing values.

    Equal x are pooled first, so ties have one value.
    """
    order = np.argsort(x, kind="stable")
    xs, first = np.unique(x[order], return_index=True)
    if not len(xs):
        return np.zeros(1), np.zeros(1)
    sums = np.add.reduceat(y[order].astype(float), first)
    weights = np.diff(np.append(first, len(x))).astype(float)
    blocks: list[list[float]] = []  # total, weight, knots
    for total, weight in zip(sums, weights):
        blocks.append([total, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t, w, k = blocks.pop()
            blocks[-1][0] += t
            blocks[-1][1] += w
            blocks[-1][2] += k
    return xs, np.repeat([t / w for t, w, _ in blocks], [int(k) for _, _, k in blocks])
