"""A causal self-attention model over subword ids, in numpy: one head, trained by Adam on windows of ids.

The model predicts the class of the next subword in two steps, a group of classes and then a class of that group,
so that a step computes some two dozen outputs instead of one for every class; within a class a subword has its share
of the corpus counts.
An input is the embedding of the previous subword plus that of its place in the window. Frequent subwords have
embeddings of their own, the others share one by a hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: The model's sizes: subwords of a window, numbers of an embedding, embeddings, groups, classes of a group, classes.
WINDOW, WIDTH, EMBEDDINGS, GROUPS, MEMBERS = 32, 16, 2048, 12, 12
CLASSES = GROUPS * MEMBERS


@dataclass
class Vocabulary:
    """What the corpus counts say about each subword id: its embedding, its class, and its share of the class."""

    row: np.ndarray
    kind: np.ndarray
    log_share: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, initial: np.ndarray, end: int) -> Vocabulary:
        """From the counts by id; ``initial`` tells the ids that begin a word, ``end`` is the end of a text.

        Ids are ordered by whether they begin a word and by count, and cut into classes of about equal mass,
        so that a class holds either beginnings or continuations. The end has a class of its own.
        """
        weight = counts + 0.1
        by_count = np.argsort(-weight, kind="stable")
        row = EMBEDDINGS // 2 + np.arange(len(counts)) % (EMBEDDINGS // 2)
        row[by_count[:EMBEDDINGS // 2]] = np.arange(min(len(counts), EMBEDDINGS // 2))
        kind = np.empty(len(counts), dtype=np.int64)
        order = by_count[np.argsort(~initial[by_count], kind="stable")]
        order = order[order != end]
        starts = initial[order]
        mass = weight[order]
        share = mass[starts].sum() / mass.sum()
        n_initial = int(min(CLASSES - 2, max(1, round((CLASSES - 1) * share))))
        for chosen, first, n in ((starts, 0, n_initial), (~starts, n_initial, CLASSES - 1 - n_initial)):
            own = mass[chosen]
            middle = np.cumsum(own) - own / 2
            kind[order[chosen]] = first + np.minimum(n - 1, (middle / max(own.sum(), 1e-9) * n).astype(np.int64))
        kind[end] = CLASSES - 1
        totals = np.bincount(kind, weights=weight, minlength=CLASSES)
        return cls(row.astype(np.int32), kind.astype(np.int32), (np.log(weight) - np.log(totals[kind])).astype(np.float32))


#: The last row of ``out``, and of each group in ``inner``, is a bias.
SHAPES = {"emb": (EMBEDDINGS, WIDTH), "pos": (WINDOW, WIDTH), "qkv": (WIDTH, 3 * WIDTH), "out": (WIDTH + 1, GROUPS), "inner": (GROUPS, WIDTH + 1, MEMBERS)}
#: Added to the exponents: a place sees nothing behind it.
UNSEEN = np.triu(np.full((WINDOW, WINDOW), -np.inf, dtype=np.float32), 1)


def unflat(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters as views of one array."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = math.prod(shape)
        out[name] = flat[at:at + n].reshape(shape)
        at += n
    return out


def initial(vocabulary: Vocabulary, counts: np.ndarray, seed: int = 7) -> np.ndarray:
    """Parameters to begin with: small random numbers, and the frequencies of groups and classes as bias."""
    flat = np.random.default_rng(seed).normal(0, 0.1, sum(math.prod(s) for s in SHAPES.values())).astype(np.float32)
    mass = (np.bincount(vocabulary.kind, weights=counts + 0.1, minlength=CLASSES) + 1e-3).reshape(GROUPS, MEMBERS)
    of_group = mass.sum(axis=1)
    p = unflat(flat)
    p["out"][WIDTH] = np.log(of_group / of_group.sum())
    p["inner"][:, WIDTH] = np.log(mass / of_group[:, None])
    return flat


class Space:
    """Arrays that are filled anew in every step; to ask the system for them each time would cost as much as the arithmetic."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, like: np.dtype, *shape: int) -> np.ndarray:
        n, own = math.prod(shape), self.kept.get(name)
        if own is None or own.dtype != like or len(own) < n:
            own = self.kept[name] = np.empty(n, dtype=like)
        return own[:n].reshape(shape)


def attended(p: dict, rows: np.ndarray, space: Space) -> tuple:
    """What each place of each window knows of the inputs up to it (``h``), and what the gradient needs."""
    shape, kind = rows.shape, p["emb"].dtype
    x = np.take(p["emb"], rows, axis=0, out=space("x", kind, *shape, WIDTH), mode="clip")
    x += p["pos"]
    qkv = np.matmul(x.reshape(-1, WIDTH), p["qkv"], out=space("qkv", kind, rows.size, 3 * WIDTH)).reshape(*shape, 3 * WIDTH)
    q, k, v = qkv[:, :, :WIDTH], qkv[:, :, WIDTH:2 * WIDTH], qkv[:, :, 2 * WIDTH:]
    att = np.matmul(q, k.transpose(0, 2, 1), out=space("att", kind, *shape, WINDOW))
    att *= np.float32(WIDTH ** -0.5)
    att += UNSEEN
    att -= att.max(axis=2, keepdims=True)  # the largest of each sum becomes one: it neither overflows nor vanishes
    np.exp(att, out=att)
    att /= (att @ np.ones(WINDOW, dtype=kind))[:, :, None]
    o = np.matmul(att, v, out=space("o", kind, *shape, WIDTH))
    return x, q, k, v, att, o, np.add(o, x, out=space("h", kind, *shape, WIDTH))


def logits(p: dict, h: np.ndarray, places: np.ndarray, kinds: np.ndarray, space: Space) -> tuple:
    """Unnormalised log probabilities, zero at most, of the groups, and of the classes of the group that ``kinds`` is in, at some places.

    The rows come sorted by that group: also returned are their order, where each group ends, and their features.
    """
    group = kinds // MEMBERS
    order = np.argsort(group.astype(np.int8), kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
    f = space("f", h.dtype, len(order), WIDTH + 1)
    f[:, :WIDTH] = h.reshape(-1, WIDTH)[places[order]]
    f[:, WIDTH] = 1
    outer = np.matmul(f, p["out"], out=space("outer", h.dtype, len(order), GROUPS))
    inner = space("inner", h.dtype, len(order), MEMBERS)
    for g, (a, b) in enumerate(zip([0, *ends], ends)):
        np.matmul(f[a:b], p["inner"][g], out=inner[a:b])
    for each in (outer, inner):
        each -= each.max(axis=1, keepdims=True)
    return order, ends, f, outer, inner


def class_log_probabilities(p: dict, rows: np.ndarray, kinds: np.ndarray, wanted: np.ndarray, space: Space | None = None) -> np.ndarray:
    """Natural log probability of the class ``kinds`` at the wanted places of the windows, one after the other."""
    space = space or Space()
    h = attended(p, rows, space)[-1]
    kinds = kinds[wanted]
    order, _, _, outer, inner = logits(p, h, np.flatnonzero(wanted), kinds, space)
    at, own = np.arange(len(kinds)), kinds[order]
    found = outer[at, own // MEMBERS] + inner[at, own % MEMBERS]
    for each in (outer, inner):
        found -= np.log(np.exp(each, out=each) @ np.ones(each.shape[1], dtype=each.dtype))
    out = np.empty_like(found)
    out[order] = found
    return out


def gradient(p: dict, rows: np.ndarray, kinds: np.ndarray, space: Space | None = None) -> np.ndarray:
    """Gradient of the mean negative log probability over the places with a class (``kinds`` >= 0)."""
    space = space or Space()
    x, q, k, v, att, o, h = attended(p, rows, space)
    shape, kind = rows.shape, x.dtype
    there = np.flatnonzero(kinds.reshape(-1) >= 0)
    kinds = kinds.reshape(-1)[there]
    order, ends, f, outer, inner = logits(p, h, there, kinds, space)
    at, own, share = np.arange(len(kinds)), kinds[order], kind.type(1 / max(1, len(kinds)))
    for each, right in ((outer, own // MEMBERS), (inner, own % MEMBERS)):
        np.exp(each, out=each)
        each *= (share / (each @ np.ones(each.shape[1], dtype=kind)))[:, None]
        each[at, right] -= share
    flat = space("gradient", kind, sum(math.prod(s) for s in SHAPES.values()))
    g = unflat(flat)
    np.matmul(f.T, outer, out=g["out"])
    df = np.matmul(outer, p["out"][:WIDTH].T, out=space("df", kind, len(kinds), WIDTH))
    for n, (a, b) in enumerate(zip([0, *ends], ends)):
        np.matmul(f[a:b].T, inner[a:b], out=g["inner"][n])
        df[a:b] += inner[a:b] @ p["inner"][n, :WIDTH].T
    dh = space("dh", kind, *shape, WIDTH)
    dh[:] = 0
    dh.reshape(-1, WIDTH)[there[order]] = df
    d = space("d", kind, *shape, 3 * WIDTH)
    np.matmul(att.transpose(0, 2, 1), dh, out=d[:, :, 2 * WIDTH:])
    ds = np.matmul(dh, v.transpose(0, 2, 1), out=space("ds", kind, *shape, WINDOW))
    o *= dh
    ds -= (o @ np.ones(WIDTH, dtype=kind))[:, :, None]
    ds *= att
    ds *= np.float32(WIDTH ** -0.5)
    np.matmul(ds, k, out=d[:, :, :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), q, out=d[:, :, WIDTH:2 * WIDTH])
    d = d.reshape(-1, 3 * WIDTH)
    np.matmul(x.reshape(-1, WIDTH).T, d, out=g["qkv"])
    dx = np.matmul(d, p["qkv"].T, out=space("dx", kind, rows.size, WIDTH))
    dx += dh.reshape(-1, WIDTH)
    g["pos"][:] = dx.reshape(len(rows), -1).sum(axis=0).reshape(WINDOW, WIDTH)
    wide, places = space("wide", np.dtype(np.float64), rows.size, WIDTH), space("places", np.dtype(np.int64), rows.size, WIDTH)
    wide[:] = dx
    np.add(rows.reshape(-1, 1) * WIDTH, np.arange(WIDTH), out=places)
    g["emb"].reshape(-1)[:] = np.bincount(places.reshape(-1), weights=wide.reshape(-1), minlength=EMBEDDINGS * WIDTH)
    return flat


def trained(flat: np.ndarray, rows: np.ndarray, kinds: np.ndarray, rate: float, batch: int, seed: int) -> np.ndarray:
    """The parameters after one pass of Adam over the windows, in a fixed random order."""
    flat = flat.copy()
    first, second, change = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
    order, space = np.random.default_rng(seed).permutation(len(rows)), Space()
    for step, at in enumerate(range(0, len(order), batch), 1):
        some = order[at:at + batch]
        g = gradient(unflat(flat), rows[some], kinds[some], space)
        first *= 0.9
        first += np.multiply(g, 0.1, out=change)
        g *= g
        g *= 0.01
        second *= 0.99
        second += g
        np.sqrt(second, out=change)
        change *= (1 - 0.99 ** step) ** -0.5
        change += 1e-8
        np.divide(first, change, out=change)
        change *= rate / (1 - 0.9 ** step)
        flat -= change
    return flat
