"""A small causal self-attention model over words' first subword ids, in numpy.

One head attends over windows of ``WINDOW`` ids, of which the last ``FRESH`` are
scored and the others are context, so each id is scored once. The position before
an id gives a hidden state; from it come gates over three experts: a softmax in two
steps, over ``CLASSES`` classes of ids and over the ``SLOTS`` of a class, a pointer (the
attention itself, on equal ids in the window), and the ids' plain frequencies. Every
step reaches every id that a training word begins with: ids are dealt to classes and
slots by frequency, and only those beyond ``CLASSES * SLOTS`` share last slots, by their
frequencies. So all ids' probabilities sum to one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CONTEXT, FRESH = 8, 24
WINDOW = CONTEXT + FRESH
CLASSES, SLOTS, WIDTH = 32, 64, 16
#: Embedding rows: the most frequent ids have one each, all others the last.
ROWS = 2048
LAG = np.arange(CONTEXT, WINDOW)[:, None] - np.arange(WINDOW)[None, :]  # query minus key
CAUSAL = LAG >= 0
SEEN = np.arange(WINDOW)[None, :] >= np.arange(CONTEXT + 1)[:, None]  # keys by how many places are blank


@dataclass
class Tables:
    """What surrounds the network, by id: counts over the training words, and places in it."""

    end_id: int
    first_count: np.ndarray  # training words that begin with an id, or texts for the end
    first: np.ndarray  # the share of those
    row: np.ndarray
    group: np.ndarray
    slot: np.ndarray
    in_slot: np.ndarray  # an id's probability within its slot


def tables(first_count: np.ndarray, end_id: int) -> Tables:
    v = len(first_count)
    order = np.argsort(-first_count, kind="stable")
    rank = np.empty(v, np.int64)
    rank[order] = np.arange(v)
    group = rank % CLASSES
    slot = np.minimum(rank // CLASSES, SLOTS - 1)
    mass = np.bincount(group * SLOTS + slot, first_count, CLASSES * SLOTS)
    in_slot = first_count / np.maximum(mass[group * SLOTS + slot], 1e-12)
    first = first_count / max(first_count.sum(), 1)
    return Tables(end_id, first_count.astype(np.float64), first.astype(np.float32), np.minimum(rank, ROWS).astype(np.int32), group.astype(np.int32), slot.astype(np.int32), in_slot.astype(np.float32))


def start_network(seed: int = 3) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)

    def matrix(*shape: int, scale: float = 0.2) -> np.ndarray:
        return (random.standard_normal(shape) * scale).astype(np.float32)

    return {
        "embed": matrix(ROWS + 1, WIDTH), "lag": np.zeros(WINDOW, np.float32), "q": matrix(WIDTH, WIDTH, scale=0.1), "k": matrix(WIDTH, WIDTH), "v": matrix(WIDTH, WIDTH),
        "gate": matrix(WIDTH, 3), "gate0": np.array([1, -1, 1], np.float32),
        "group": matrix(WIDTH, CLASSES), "group0": np.zeros(CLASSES, np.float32), "slot": matrix(CLASSES, WIDTH, SLOTS), "slot0": np.zeros((CLASSES, SLOTS), np.float32),
    }


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, as a product: much faster than a reduction for few columns."""
    return x @ np.ones(x.shape[-1], x.dtype)


def _softmax(x: np.ndarray) -> np.ndarray:
    np.clip(x, -40, 40, out=x)
    np.exp(x, out=x)
    x /= _sums(x)[:, None]
    return x


def attend(net: dict[str, np.ndarray], rows: np.ndarray, blank: np.ndarray) -> tuple:
    """Attention of the fresh positions of windows over embedding rows; ``blank`` is how many places of each window have no id."""
    e = net["embed"][rows]  # windows, WINDOW, WIDTH
    flat = e.reshape(-1, WIDTH)
    q = (e[:, CONTEXT:].reshape(-1, WIDTH) @ net["q"]).reshape(-1, FRESH, WIDTH)
    k, v = ((flat @ net[x]).reshape(-1, WINDOW, WIDTH) for x in "kv")
    a = q @ k.transpose(0, 2, 1)
    a += np.where(CAUSAL, net["lag"][np.maximum(LAG, 0)], np.float32(-60))
    np.minimum(a, 30, out=a)
    np.exp(a, out=a)
    some = np.flatnonzero(blank)
    a[some] *= SEEN[blank[some]][:, None, :]
    a /= _sums(a)[:, :, None]
    h = a @ v
    h += e[:, CONTEXT:]
    return e, q, k, v, a, h


def _by_class(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of their class, and where each class begins."""
    order = np.argsort(group, kind="stable")
    return order, np.searchsorted(group[order], np.arange(CLASSES + 1))


def probabilities(net: dict[str, np.ndarray], t: Tables, before: np.ndarray, blank: np.ndarray, now: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The probability of each used fresh id, in order.

    ``before`` are windows of previous ids, ``now`` the fresh ids.
    """
    _, _, _, _, a, h = attend(net, t.row[before], blank)
    a *= before[:, None, :] == now[:, :, None]
    pointer = _sums(a)[used]
    h, now = h[used], now[used]
    gates = _softmax(h @ net["gate"] + net["gate0"])
    group, slot = t.group[now], t.slot[now]
    logits = h @ net["group"]
    logits += net["group0"]
    chosen = _softmax(logits)[np.arange(len(now)), group] * t.in_slot[now]
    order, at = _by_class(group)
    for c in range(CLASSES):
        own = order[at[c] : at[c + 1]]
        logits = h[own] @ net["slot"][c]
        logits += net["slot0"][c]
        chosen[own] *= _softmax(logits)[np.arange(len(own)), slot[own]]
    return gates[:, 0] * chosen + gates[:, 1] * pointer + gates[:, 2] * t.first[now]


def gradients(net: dict[str, np.ndarray], t: Tables, before: np.ndarray, blank: np.ndarray, now: np.ndarray, used: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss a used id and its gradient."""
    rows = t.row[before]
    e, q, k, v, a, h = attend(net, rows, blank)
    same = before[:, None, :] == now[:, :, None]
    pointer = _sums(a * same)[used]
    n = max(1, int(used.sum()))
    g = {}
    hs, ids = h[used], now[used]
    every = np.arange(len(ids))
    group, slot = t.group[ids], t.slot[ids]
    gates = _softmax(hs @ net["gate"] + net["gate0"])
    groups = _softmax(hs @ net["group"] + net["group0"])
    chosen = groups[every, group] * t.in_slot[ids]
    order, at = _by_class(group)
    slots = []
    for c in range(CLASSES):
        own = order[at[c] : at[c + 1]]
        p = _softmax(hs[own] @ net["slot"][c] + net["slot0"][c])
        chosen[own] *= p[np.arange(len(own)), slot[own]]
        slots.append(p)
    parts = np.stack([chosen, pointer, t.first[ids]], axis=1)
    parts *= gates
    mixed = _sums(parts) + np.float32(1e-12)
    loss = -np.log(mixed).sum()
    share = parts / mixed[:, None]
    dg = (gates - share) / np.float32(n)
    taken = share[:, 0] / np.float32(n)
    groups *= taken[:, None]
    groups[every, group] -= taken
    g["gate"], g["gate0"] = hs.T @ dg, dg.sum(axis=0)
    g["group"], g["group0"] = hs.T @ groups, groups.sum(axis=0)
    dhs = dg @ net["gate"].T
    dhs += groups @ net["group"].T
    g["slot"], g["slot0"] = np.empty_like(net["slot"]), np.empty_like(net["slot0"])
    for c, p in enumerate(slots):
        own = order[at[c] : at[c + 1]]
        p *= taken[own, None]
        p[np.arange(len(own)), slot[own]] -= taken[own]
        g["slot"][c], g["slot0"][c] = hs[own].T @ p, p.sum(axis=0)
        dhs[own] += p @ net["slot"][c].T
    dh = np.zeros_like(h)
    dh[used] = dhs
    dp = np.zeros(used.shape, np.float32)
    dp[used] = -gates[:, 1] / mixed / np.float32(n)
    da = dh @ v.transpose(0, 2, 1)
    da += dp[:, :, None] * same
    dv = a.transpose(0, 2, 1) @ dh
    da *= a
    da -= a * _sums(da)[:, :, None]
    lag = np.zeros(WINDOW, np.float32)
    np.add.at(lag, LAG[CAUSAL], da.sum(axis=0)[CAUSAL])
    g["lag"] = lag
    dq, dk = da @ k, da.transpose(0, 2, 1) @ q
    flat, fresh = e.reshape(-1, WIDTH), e[:, CONTEXT:].reshape(-1, WIDTH)
    dk, dv, dq = dk.reshape(-1, WIDTH), dv.reshape(-1, WIDTH), dq.reshape(-1, WIDTH)
    g["q"], g["k"], g["v"] = fresh.T @ dq, flat.T @ dk, flat.T @ dv
    de = dk @ net["k"].T
    de += dv @ net["v"].T
    de = de.reshape(e.shape)
    de[:, CONTEXT:] += dh
    de[:, CONTEXT:] += (dq @ net["q"].T).reshape(h.shape)
    place = rows.reshape(-1)
    order = np.argsort(place, kind="stable")
    own, first = np.unique(place[order], return_index=True)
    g["embed"] = np.zeros_like(net["embed"])
    g["embed"][own] = np.add.reduceat(de.reshape(-1, WIDTH)[order], first)
    return float(loss / n), g


class Trainer:
    """Adam on a copy of a network."""

    def __init__(self, net: dict[str, np.ndarray]):
        self.net = {x: y.copy() for x, y in net.items()}
        self.mean = {x: np.zeros_like(y) for x, y in net.items()}
        self.square = {x: np.zeros_like(y) for x, y in net.items()}
        self.turn = 0

    def step(self, t: Tables, windows: tuple[np.ndarray, ...], rate: float) -> float:
        """One step on windows (before, blank, now, used); returns the loss."""
        loss, g = gradients(self.net, t, *windows)
        self.turn += 1
        step = np.float32(rate * np.sqrt(1 - 0.98**self.turn) / (1 - 0.9**self.turn))
        for x, own in g.items():
            self.mean[x] *= np.float32(0.9)
            self.mean[x] += np.float32(0.1) * own
            self.square[x] *= np.float32(0.98)
            own *= own
            self.square[x] += np.float32(0.02) * own
            self.net[x] -= step * self.mean[x] / (np.sqrt(self.square[x]) + np.float32(1e-8))
        return loss


def fit(t: Tables, windows: tuple[np.ndarray, ...], epochs: int = 4, batch: int = 32, rate: float = 0.01, seed: int = 3) -> dict[str, np.ndarray]:
    """Train a new network on windows (before, blank, now, used)."""
    trainer = Trainer(start_network(seed=seed))
    random = np.random.default_rng(seed)
    n = len(windows[0])
    total = max(1, epochs * -(-n // batch))
    for _ in range(epochs):
        order = random.permutation(n)
        for at in range(0, n, batch):
            pick = np.sort(order[at : at + batch])
            trainer.step(t, tuple(w[pick] for w in windows), rate * (1 - 0.9 * (trainer.turn + 1) / total))
    return trainer.net
