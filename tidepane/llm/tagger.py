"""A bidirectional LSTM over characters with CRF transitions, in numpy: forward, gradients, posteriors, decoding."""

from __future__ import annotations

import io

import numpy as np

#: Character classes: ASCII as it is, then other letters, other signs, and the filling of short windows.
LETTER, SIGN, FILL = 128, 129, 130
N_CLASSES = 131

Params = dict[str, np.ndarray]


def _class_table() -> np.ndarray:
    table = np.full(1 << 16, SIGN, np.uint8)
    table[:128] = np.arange(128)
    table[[c for c in range(128, 1 << 16) if chr(c).isalpha()]] = LETTER
    return table


CLASS_OF = _class_table()


def classes(points: np.ndarray) -> np.ndarray:
    """Class of each code point; those beyond the basic plane count as letters."""
    return np.where(points < 1 << 16, CLASS_OF[np.minimum(points, (1 << 16) - 1)], LETTER)


def new_params(labels: int, rng: np.random.Generator, width: int = 12, hidden: int = 16) -> Params:
    def normal(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    params = {"emb": normal(N_CLASSES, width) * np.float32(np.sqrt(N_CLASSES) * 0.3)}
    for way in "fb":
        params[f"w{way}"] = normal(width, 4 * hidden)
        params[f"u{way}"] = normal(hidden, 4 * hidden)
        params[f"c{way}"] = np.concatenate((np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden))).astype(np.float32)
    params["wo"], params["bo"] = normal(2 * hidden, labels), np.zeros(labels, np.float32)
    params["trans"] = np.zeros((labels, labels), np.float32)
    return params


def _lstm(params: Params, x: np.ndarray, way: str, keep: bool):
    """Hidden states [T, B, H] for classes ``x`` [T, B], read from the left (f) or the right (b)."""
    u = params[f"u{way}"]
    hidden = u.shape[0]
    table = params["emb"] @ params[f"w{way}"] + params[f"c{way}"]  # a row per class: no product per character
    steps, batch = x.shape
    h, c = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
    out = np.empty((steps, batch, hidden), np.float32)
    cache = []
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        z = table[x[t]] + h @ u
        gates = 0.5 * np.tanh(0.5 * z[:, : 3 * hidden]) + 0.5
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        g = np.tanh(z[:, 3 * hidden :])
        before = c
        c = f * c + i * g
        squashed = np.tanh(c)
        if keep:
            cache.append((t, i, f, o, g, before, squashed, h))
        h = o * squashed
        out[t] = h
    return out, cache


def emissions(params: Params, x: np.ndarray, keep: bool = False):
    ahead, cache_f = _lstm(params, x, "f", keep)
    back, cache_b = _lstm(params, x, "b", keep)
    both = np.concatenate((ahead, back), axis=2)
    return both @ params["wo"] + params["bo"], both, cache_f, cache_b


def _messages(scores: np.ndarray, trans: np.ndarray):
    """Scaled forward and backward messages [T, B, L] of the chain, and the scaled scores."""
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(trans)
    ahead, back = np.empty_like(local), np.empty_like(local)
    a = local[0]
    for t in range(len(local)):
        if t:
            a = (a @ step) * local[t]
        a = a / a.sum(axis=1, keepdims=True)
        ahead[t] = a
    b = np.ones_like(a)
    for t in range(len(local) - 1, -1, -1):
        back[t] = b
        b = (local[t] * b) @ step.T
        b = b / b.sum(axis=1, keepdims=True)
    return ahead, back, local, step


def read(params: Params, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and, given the whole window, probabilities of each label, both [T, B, L]."""
    scores = emissions(params, x)[0]
    ahead, back, _, _ = _messages(scores, params["trans"])
    both = ahead * back
    return scores, both / both.sum(axis=2, keepdims=True)


def allowed(labels: int) -> np.ndarray:
    """Which label may follow which: the inside of a kind (2 + 2k) only its start (1 + 2k) or itself."""
    out = np.ones((labels, labels), bool)
    for inside in range(2, labels, 2):
        out[:, inside] = False
        out[[inside - 1, inside], inside] = True
    return out


def decode(scores: np.ndarray, firsts: np.ndarray, stops: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best label of each place of ``scores`` [N, L]: whole stretches ``firsts`` to ``stops`` by Viterbi, label 0 elsewhere.

    The places before and after a stretch are label 0. Long stretches come first, so those a step reaches are a prefix.
    """
    out = np.zeros(len(scores), np.int64)
    if not len(firsts):
        return out
    steps = np.where(allowed(len(trans)), trans, -1e6)
    order = np.argsort(firsts - stops, kind="stable")
    firsts, sizes = firsts[order], (stops - firsts)[order]
    reached = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # stretches longer than t
    best = steps[0][None, :] + scores[firsts]
    came = []
    for t in range(1, sizes[0]):
        n = reached[t]
        through = best[:n, :, None] + steps[None, :, :]
        came.append(through.argmax(axis=1).astype(np.uint8))
        best[:n] = through.max(axis=1) + scores[firsts[:n] + t]
    label = (best + steps[:, 0]).argmax(axis=1)
    for t in range(sizes[0] - 1, -1, -1):
        n = reached[t]
        out[firsts[:n] + t] = label[:n]
        if t:
            label[:n] = came[t - 1][np.arange(n), label[:n]]
    return out


def gradients(params: Params, x: np.ndarray, y: np.ndarray) -> Params:
    """Gradients of the mean negative log likelihood of labels ``y`` [T, B]."""
    scores, both, cache_f, cache_b = emissions(params, x, keep=True)
    ahead, back, local, step = _messages(scores, params["trans"])
    steps, batch, labels = scores.shape
    d = ahead * back
    d /= d.sum(axis=2, keepdims=True)
    pair = np.zeros((labels, labels), np.float64)
    for t in range(1, steps):
        right = local[t] * back[t]
        total = ((ahead[t - 1] @ step) * right).sum(axis=1, keepdims=True)
        pair += (ahead[t - 1] / total).T @ right * step
    np.subtract.at(pair, (y[:-1].ravel(), y[1:].ravel()), 1.0)
    tt, bb = np.meshgrid(np.arange(steps), np.arange(batch), indexing="ij")
    d[tt, bb, y] -= 1
    d = (d / batch).astype(np.float32)
    grads: Params = {"trans": (pair / batch).astype(np.float32)}
    flat = d.reshape(-1, labels)
    grads["wo"], grads["bo"] = both.reshape(-1, both.shape[2]).T @ flat, flat.sum(axis=0)
    d_both = d @ params["wo"].T
    hidden = params["uf"].shape[0]
    grads["emb"] = np.zeros_like(params["emb"])
    for way, cache, part in (("f", cache_f, d_both[..., :hidden]), ("b", cache_b, d_both[..., hidden:])):
        u, table = params[f"u{way}"], np.zeros((N_CLASSES, 4 * hidden), np.float32)
        du = np.zeros_like(u)
        dh = np.zeros((batch, hidden), np.float32)
        dc = np.zeros_like(dh)
        for t, i, f, o, g, before, squashed, h in reversed(cache):
            dh = dh + part[t]
            dc = dc + dh * o * (1 - squashed * squashed)
            dz = np.concatenate(
                (dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g * g)), axis=1
            )
            np.add.at(table, x[t], dz)
            du += h.T @ dz
            dh = dz @ u.T
            dc = dc * f
        grads[f"u{way}"] = du
        grads[f"w{way}"] = params["emb"].T @ table
        grads[f"c{way}"] = table.sum(axis=0)
        grads["emb"] += table @ params[f"w{way}"].T
    return grads


def train(
    x: np.ndarray, y: np.ndarray, labels: int, steps: int = 500, batch: int = 48, rate: float = 0.02, seed: int = 7
) -> Params:
    """Parameters fitted to windows ``x`` and labels ``y`` (both [N, T]) with Adam and a falling rate."""
    rng = np.random.default_rng(seed)
    params = new_params(labels, rng)
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    for n in range(1, steps + 1):
        rows = rng.integers(0, len(x), batch)
        grads = gradients(params, np.ascontiguousarray(x[rows].T), np.ascontiguousarray(y[rows].T))
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        shrink = min(1.0, 5.0 / max(size, 1e-9))
        pace = rate * (1 - (n - 1) / steps) + 1e-4
        for k, g in grads.items():
            g = g * np.float32(shrink)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            a, b = first[k] / (1 - 0.9**n), second[k] / (1 - 0.99**n)
            params[k] = (params[k] - pace * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
    return params


def to_bytes(params: Params) -> bytes:
    held = io.BytesIO()
    np.savez(held, **params)
    return held.getvalue()


def from_bytes(data: bytes) -> Params:
    with np.load(io.BytesIO(data)) as held:
        return {k: held[k] for k in held.files}
