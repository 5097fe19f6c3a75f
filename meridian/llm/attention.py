"""A small causal self-attention language model in numpy: forward, backward, local training.

A window is a block of context and a block of scored positions. One attention head with a bias for
every distance, a rectified layer over the input's embedding and what is attended to, and a softmax in two
levels: the class of a symbol, then the symbol in its class. Symbols are numbered by frequency. The first
`n_head` of them stand in classes of `MEMBERS`; the last class holds all others, drawn by their
counts. All weights are one flat float32 vector.
"""

from __future__ import annotations

import numpy as np

EMBED, HEAD, MEMBERS = 32, 16, 64
FAR = -1e9


#: Stands for no symbol in windows.
NONE = 0xFFFF


def by_frequency(counts: np.ndarray) -> np.ndarray:
    """Number of every symbol by falling frequency."""
    number = np.empty(len(counts), np.int32)
    number[np.lexsort((np.arange(len(counts)), -counts))] = np.arange(len(counts), dtype=np.int32)
    return number


class Lm:
    """Sizes of the model, its symbols, and what is computed from a weight vector."""

    def __init__(self, block: int, counts: np.ndarray, inputs: np.ndarray, most: int = 4096, hidden: int = 64):
        """`counts` of all symbols as the next one, `inputs` of all symbols as seen ones; at most NONE symbols."""
        self.block = block
        number, order = by_frequency(counts), np.sort(-counts, kind="stable")
        self.counts = -order
        self.n_head = min(most, int((counts > 0).sum()), len(counts) - 1)
        self.classes = -(-self.n_head // MEMBERS)
        self.target = np.full(NONE + 1, -1, np.int32)
        self.target[: len(number)] = number
        seen = by_frequency(inputs)
        self.rare = min(most, int((inputs > 0).sum()))  # as an input: any symbol but the first ones
        self.pad = self.rare + 1
        self.seen = np.full(NONE + 1, self.pad, np.int32)
        self.seen[: len(seen)] = np.minimum(seen, self.rare)
        rest = self.counts[self.n_head :] + 0.5
        self.tail = np.log(rest / rest.sum()).astype(np.float32)
        c, m = self.classes, MEMBERS
        self.shapes = {"embed": (self.pad + 1, EMBED), "qkv": (EMBED, 3 * HEAD), "near": (2 * block,), "own": (EMBED, hidden), "attended": (HEAD, hidden), "shift": (hidden,), "kind": (hidden, c + 1), "kind_shift": (c + 1,), "member": (c, hidden, m), "member_shift": (c, m)}
        self.size = sum(int(np.prod(s)) for s in self.shapes.values())
        #: Members that classes do not have.
        self.absent = (np.arange(c * m).reshape(c, m) >= self.n_head) * np.float32(FAR)
        # distance of a scored position to each position of its window
        apart = block + np.arange(block)[:, None] - np.arange(2 * block)[None, :]
        self.apart, self.later = np.maximum(apart, 0), (apart < 0) * np.float32(FAR)

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        found, at = {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            found[name] = flat[at : at + n].reshape(shape)
            at += n
        return found

    def start(self, seed: int = 0) -> np.ndarray:
        """Random weights, with shifts that give the frequencies of the pieces."""
        rng, flat = np.random.default_rng(seed), np.zeros(self.size, np.float32)
        w = self.views(flat)
        for name in ("embed", "qkv", "own", "attended", "kind", "member"):
            fan = 1.0 if name == "embed" else w[name].shape[-2] ** 0.5
            w[name][...] = rng.normal(0, 0.5 / fan, w[name].shape)
        c = np.zeros(self.classes * MEMBERS)
        c[: self.n_head] = self.counts[: self.n_head] + 0.5
        c = c.reshape(self.classes, MEMBERS)
        w["kind_shift"][:] = np.log(np.append(c.sum(axis=1), (self.counts[self.n_head :] + 0.5).sum()))
        w["kind_shift"] -= w["kind_shift"].max()
        w["member_shift"][...] = np.where(c > 0, np.log(np.maximum(c, 1) / np.maximum(c.sum(axis=1, keepdims=True), 1)), 0)
        return flat

    def tables(self, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Per input: query, key and value; and its own part of the hidden layer."""
        return w["embed"] @ w["qkv"], w["embed"] @ w["own"] + w["shift"]

    def _attend(self, w: dict, qkv: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        at = qkv.take(x, axis=0)
        q, k, v = at[:, self.block :, :HEAD], at[:, :, HEAD : 2 * HEAD], at[:, :, 2 * HEAD :]
        s = q @ (k * np.float32(HEAD**-0.5)).transpose(0, 2, 1)
        s += w["near"][self.apart] + self.later
        if (x == self.pad).any():
            s += ((x == self.pad) * np.float32(FAR))[:, None, :]
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= (s @ np.ones(2 * self.block, s.dtype))[:, :, None]
        return q, k, v, s, s @ v

    def _classes(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of every piece, an order by class, and where each class begins in it."""
        kind = np.minimum(y // MEMBERS, self.classes)
        kind[y >= self.n_head] = self.classes
        order = np.argsort(kind, kind="stable")
        return kind, order, np.searchsorted(kind[order], np.arange(self.classes + 2))

    def log_probs(self, w: dict, tables: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the symbols y (windows, block), 0 where y < 0; x: the windows' inputs."""
        qkv, own = tables
        *_, a = self._attend(w, qkv, x)
        valid = np.flatnonzero(y.ravel() >= 0)
        h = a.reshape(-1, HEAD)[valid] @ w["attended"]
        h += own.take(x[:, self.block :].ravel()[valid], axis=0)
        np.maximum(h, 0, out=h)
        target = y.ravel()[valid]
        kind, order, starts = self._classes(target)
        z = h @ w["kind"]
        z += w["kind_shift"]
        p = z[np.arange(len(z)), kind] - log_sums(z)
        for c in range(self.classes):
            rows = order[starts[c] : starts[c + 1]]
            if len(rows):
                z = h[rows] @ w["member"][c]
                z += w["member_shift"][c] + self.absent[c]
                p[rows] += z[np.arange(len(rows)), target[rows] - c * MEMBERS] - log_sums(z)
        rows = order[starts[self.classes] :]
        p[rows] += self.tail[target[rows] - self.n_head]
        out = np.zeros(y.size, np.float32)
        out[valid] = p
        return out.reshape(y.shape)

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """Mean loss over the scored positions, which count with the weight of their window, and its gradient."""
        w, slope = self.views(flat), np.zeros_like(flat)
        g = self.views(slope)
        qkv, own = self.tables(w)
        q, k, v, s, a = self._attend(w, qkv, x)
        valid = np.flatnonzero(y.ravel() >= 0)
        if not len(valid):
            return 0.0, slope
        share = np.ones(len(valid), np.float32) if weight is None else weight[valid // y.shape[1]].astype(np.float32)
        share /= share.sum()
        a2, mine = a.reshape(-1, HEAD)[valid], x[:, self.block :].ravel()[valid]
        h = np.maximum(a2 @ w["attended"] + own[mine], 0)
        target = y.ravel()[valid]
        kind, order, starts = self._classes(target)
        z = h @ w["kind"] + w["kind_shift"]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        at = np.arange(len(z))
        loss = -(share @ np.log(np.maximum(z[at, kind], 1e-30)))
        z[at, kind] -= 1
        z *= share[:, None]
        g["kind"][...], g["kind_shift"][...] = h.T @ z, z.sum(axis=0)
        dh = z @ w["kind"].T
        for c in range(self.classes):
            rows = order[starts[c] : starts[c + 1]]
            if len(rows):
                hc = h[rows]
                z = hc @ w["member"][c] + w["member_shift"][c] + self.absent[c]
                z -= z.max(axis=1, keepdims=True)
                np.exp(z, out=z)
                z /= z.sum(axis=1, keepdims=True)
                at, m = np.arange(len(rows)), target[rows] - c * MEMBERS
                loss -= share[rows] @ np.log(np.maximum(z[at, m], 1e-30))
                z[at, m] -= 1
                z *= share[rows][:, None]
                g["member"][c], g["member_shift"][c] = hc.T @ z, z.sum(axis=0)
                dh[rows] += z @ w["member"][c].T
        rows = order[starts[self.classes] :]
        loss -= share[rows] @ self.tail[target[rows] - self.n_head]
        dh *= h > 0
        g["attended"][...], g["shift"][...] = a2.T @ dh, dh.sum(axis=0)
        da = np.zeros((y.size, HEAD), np.float32)
        da[valid] = dh @ w["attended"].T
        da = da.reshape(a.shape)
        ds = da @ v.transpose(0, 2, 1)
        ds -= (ds * s).sum(axis=2, keepdims=True)
        ds *= s
        g["near"][...] = np.bincount(self.apart.ravel(), ds.sum(axis=0).ravel(), 2 * self.block)
        d = np.zeros((*x.shape, 3 * HEAD), np.float32)
        scale = np.float32(HEAD**-0.5)
        d[:, self.block :, :HEAD] = ds @ k * scale
        d[:, :, HEAD : 2 * HEAD] = ds.transpose(0, 2, 1) @ q * scale
        d[:, :, 2 * HEAD :] = s.transpose(0, 2, 1) @ da
        d_qkv = sums_by(x.ravel(), d.reshape(-1, 3 * HEAD), len(qkv))
        d_own = sums_by(mine, dh, len(own))
        g["qkv"][...], g["own"][...] = w["embed"].T @ d_qkv, w["embed"].T @ d_own
        g["embed"][...] = d_qkv @ w["qkv"].T + d_own @ w["own"].T
        return float(loss), slope

    def train(self, flat: np.ndarray, z: np.ndarray, steps: int, batch: int, rate: float, seed: int, weight: np.ndarray | None = None) -> np.ndarray:
        """Weights after `steps` steps of Adam from `flat`; z: windows, with a weight each."""
        flat, rng = flat.copy(), np.random.default_rng(seed)
        m, v, order, at = np.zeros_like(flat), np.zeros_like(flat), rng.permutation(len(z)), 0
        for t in range(1, steps + 1):
            if at >= len(z):
                order, at = rng.permutation(len(z)), 0
            rows = order[at : at + batch]
            at += batch
            _, slope = self.gradient(flat, *self.inputs(z[rows]), None if weight is None else weight[rows])
            m += np.float32(0.1) * (slope - m)
            v += np.float32(0.01) * (slope * slope - v)
            now = rate * (1 - 0.9 * (t - 1) / steps) * (1 - 0.99**t) ** 0.5 / (1 - 0.9**t)
            flat -= np.float32(now) * m / (np.sqrt(v) + np.float32(1e-8))
        return flat

    def inputs(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the seen symbols and of the next ones (-1: none) of windows of 2 * block + 1 symbols."""
        return self.seen.take(z[:, :-1]), self.target.take(z[:, self.block + 1 :])


def log_sums(z: np.ndarray) -> np.ndarray:
    """log(sum(exp(z))) of every row."""
    with np.errstate(over="ignore"):
        total = np.exp(z) @ np.ones(z.shape[1], z.dtype)
    if np.isfinite(total).all() and total.all():
        return np.log(total)
    top = z.max(axis=1)
    return top + np.log(np.exp(z - top[:, None]).sum(axis=1))


def sums_by(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each key below n."""
    order = np.argsort(keys, kind="stable")
    at = keys[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[at[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def windows(line: np.ndarray, block: int) -> np.ndarray:
    """All windows of a line of symbols (a row: 2 * block inputs and the symbol after them); each but the first symbol is scored in one."""
    blocks = -(-(len(line) - 1) // block)
    padded = np.full((blocks + 1) * block + 1, NONE, np.uint16)
    padded[block : block + len(line)] = line
    return np.lib.stride_tricks.sliding_window_view(padded, 2 * block + 1)[::block]
