"""Numeric kernels of one window, run inside Arrow tasks: wavelet features, encoder, gradients.

A parameter set is a dict of float64 arrays, in the order that ``layout`` lists them.
"""

from __future__ import annotations

import functools
import math

import numpy as np

from helixlake.functions.numeric import DROP_FACTOR, DROP_MODULUS

LABELS = 3
EPS = 1e-6
#: Bases of a window whose convolution is one product with a matrix.
SHORT = 64
#: Logits of no larger size need no shift before exp.
SAFE = 500.0
Params = dict[str, np.ndarray]

_SIGNAL = np.zeros(256, dtype=complex)
for _bases, _value in (("Aa", 1 + 1j), ("Tt", 1 - 1j), ("Gg", -1 + 1j), ("Cc", -1 - 1j)):
    for _base in _bases:
        _SIGNAL[ord(_base)] = _value


def layout(d_model: int, layers: int, d_ff: int, scales: int) -> list[tuple[str, int, int]]:
    """(name, rows, columns) of every trained matrix."""
    inner = [("wq", d_model, d_model), ("wk", d_model, d_model), ("wv", d_model, d_model), ("wo", d_model, d_model)]
    inner += [("w1", d_model, d_ff), ("b1", 1, d_ff), ("w2", d_ff, d_model), ("b2", 1, d_model)]
    inner += [("g1", 1, d_model), ("e1", 1, d_model), ("g2", 1, d_model), ("e2", 1, d_model)]
    names = [("projection", 2 * scales, d_model)]
    for k in range(layers):
        names += [(f"{k}.{name}", rows, cols) for name, rows, cols in inner]
    return [*names, ("head", d_model, LABELS)]


def initial(d_model: int, layers: int, d_ff: int, scales: int, seed: int) -> Params:
    """Uniform weights in +-sqrt(2 / fan), biases 0, norms 1. The generator is seeded and its own."""
    rng = np.random.default_rng(seed)
    made: Params = {}
    for name, rows, cols in layout(d_model, layers, d_ff, scales):
        kind = name.split(".")[-1]
        if kind in ("b1", "b2", "e1", "e2"):
            made[name] = np.zeros((rows, cols))
        elif kind in ("g1", "g2"):
            made[name] = np.ones((rows, cols))
        else:
            bound = math.sqrt(2 / (2 * scales if name == "projection" else d_model))
            made[name] = rng.uniform(-bound, bound, (rows, cols))
    return made


def wavelet_samples(scale: float, n: int) -> int:
    length = min(max(int(10 * scale), 1), n)
    return length + (length % 2 == 0)


@functools.lru_cache(maxsize=256)
def wavelet(scale: float, length: int) -> np.ndarray:
    t = (np.arange(length) - length // 2) / scale
    return np.exp(-t * t / 2) * np.exp(2j * np.pi * t) / math.sqrt(scale * math.pi**0.25)


def base_signal(seqs: list[str]) -> np.ndarray:
    """[sequence][base] of the complex signal, of sequences of one length."""
    return _SIGNAL[base_codes(seqs).reshape(len(seqs), len(seqs[0]))]


def base_codes(seqs: list[str]) -> np.ndarray:
    """A byte for each base of all sequences."""
    return np.frombuffer("".join(seqs).encode("latin-1", "replace"), dtype=np.uint8)


@functools.lru_cache(maxsize=SHORT)
def short_convolution(n: int, scales: tuple[float, ...]) -> np.ndarray:
    """[re, im of each base][base, re, im of each scale]: the convolution of windows of n bases as a matrix."""
    out = np.zeros((2, n, n, len(scales), 2))
    for k, scale in enumerate(scales):
        psi = wavelet(scale, wavelet_samples(scale, n))
        at = np.arange(n)[None, :] - np.arange(n)[:, None] + len(psi) // 2
        taps = np.where((at >= 0) & (at < len(psi)), psi[np.clip(at, 0, len(psi) - 1)], 0)
        out[0, :, :, k, 0], out[0, :, :, k, 1], out[1, :, :, k, 0], out[1, :, :, k, 1] = taps.real, taps.imag, -taps.imag, taps.real
    return out.reshape(2 * n, -1)


def features(seqs: list[str] | str, scales: tuple[float, ...]) -> np.ndarray:
    """[window][base][re, im of each scale], of windows of one length: the centred convolution with every
    wavelet, zeros beyond the window. One string gives one window's [base][..].

    Bases that a byte can't hold are 0, as all unknown ones.
    """
    return features([seqs], scales)[0] if isinstance(seqs, str) else signal_features(base_signal(seqs), scales)


def signal_features(x: np.ndarray, scales: tuple[float, ...]) -> np.ndarray:
    """``features`` of signals [window][base]: by FFT on the next power of two, by one matrix for up to SHORT bases."""
    n, out = x.shape[1], np.empty((*x.shape, 2 * len(scales)))
    if 0 < n <= SHORT:
        return (np.concatenate([x.real, x.imag], axis=1) @ short_convolution(n, tuple(scales))).reshape(out.shape)
    for k, scale in enumerate(scales):
        psi = wavelet(scale, wavelet_samples(scale, n))
        size = 1 << (n + len(psi) - 2).bit_length() if n + len(psi) > 2 else 1
        full = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(psi, size))
        part = full[:, len(psi) // 2 : len(psi) // 2 + n]
        out[..., 2 * k], out[..., 2 * k + 1] = part.real, part.imag
    return out


@functools.lru_cache(maxsize=16)
def position_codes(length: int, d_model: int) -> np.ndarray:
    i = np.arange(d_model)
    angle = np.arange(length)[:, None] / 10000.0 ** (2 * (i // 2) / d_model)
    return np.where(i % 2 == 0, np.sin(angle), np.cos(angle))


def softmax(x: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """Over the last axis; with ``inside`` (0 and 1), over the places of 1 alone."""
    if x.size and not (x.max() <= SAFE and x.min() >= -SAFE):
        x = x if inside is None else np.where(inside > 0, x, -np.inf)
        x = x - x.max(-1, keepdims=True)
    e = np.exp(x)
    if inside is not None:
        e *= inside
    e /= row_sums(e)
    return e


def row_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which stays: a product, as sums of many short rows are slow."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1])).reshape(*x.shape[:-1], 1)


def norm(x: np.ndarray, gamma: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, tuple]:
    width = x.shape[-1]
    unit = x - row_sums(x) / width
    deviation = np.sqrt(row_sums(unit * unit) / width + EPS)
    unit /= deviation
    return unit * gamma + beta, (unit, deviation)


def norm_back(dy: np.ndarray, gamma: np.ndarray, cache: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    unit, deviation = cache
    du, along, width = dy * gamma, dy * unit, dy.shape[-1]
    dx = unit * (row_sums(du * unit) / -width)
    dx += du
    dx -= row_sums(du) / width
    dx /= deviation
    return dx, summed(along), summed(dy)


def summed(x: np.ndarray) -> np.ndarray:
    """[1][column]: sums over all positions, of one window or of several."""
    return x.reshape(-1, x.shape[-1]).sum(0, keepdims=True)


def outer(x: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Sum over all positions of x_i dy_j, of one window or of several."""
    return x.reshape(-1, x.shape[-1]).T @ dy.reshape(-1, dy.shape[-1])


def heads_of(x: np.ndarray, heads: int) -> np.ndarray:
    return x.reshape(*x.shape[:-1], heads, -1).swapaxes(-3, -2)


def joined(x: np.ndarray) -> np.ndarray:
    return x.swapaxes(-3, -2).reshape(*x.shape[:-3], x.shape[-2], -1)


def dropout_mask(shape: tuple[int, int], rate: float, *numbers: int | np.ndarray) -> np.ndarray:
    """Factors of a window's values as ``numeric.dropped_out`` draws them by the numbers, row and column; those of
    several windows where a number is an array [window][1][1]."""
    u = np.ones(1, dtype=np.int64)
    for number in (*numbers, np.arange(shape[0])[:, None], np.arange(shape[1])[None, :]):
        u = (u + np.mod(number, DROP_MODULUS)) * DROP_FACTOR % DROP_MODULUS
        u = (u * u % DROP_MODULUS + 1) * DROP_FACTOR % DROP_MODULUS
    return (u / float(DROP_MODULUS) >= rate) / (1 - rate)


def forward(p: Params, x: np.ndarray, heads: int, window: int, rate: float = 0.0, drawn: tuple | None = None, lengths: np.ndarray | None = None) -> tuple[np.ndarray, list]:
    """Logits of each base and what ``backward`` needs, of one window or of several.

    Windows shorter than the array have their ``lengths``: what lies beyond is attended by no base. Post-norm encoder;
    dropout only with the numbers that it is drawn by, such as step and window, as ``dropout_mask`` takes them.
    """
    n = x.shape[-2]
    inside = None if lengths is None or np.min(lengths, initial=n) == n else (np.arange(n) < lengths[:, None]).astype(float)[:, None, None, :]

    def drop(v: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray | float]:
        if drawn is None or rate <= 0:
            return v, 1.0
        mask = np.zeros_like(v) if rate >= 1 else dropout_mask(v.shape[-2:], rate, *drawn, place)
        return v * mask, mask

    h = x @ p["projection"] + position_codes(window, p["projection"].shape[1])[np.arange(x.shape[-2]) % window]
    kept, layer = [], 0
    while f"{layer}.wq" in p:
        w = {name.split(".")[1]: v for name, v in p.items() if name.startswith(f"{layer}.")}
        q, k, v = (heads_of(part, heads) for part in np.split(h @ np.hstack([w["wq"], w["wk"], w["wv"]]), 3, axis=-1))
        a = softmax((q / math.sqrt(q.shape[-1])) @ k.swapaxes(-1, -2), inside)
        mixed = joined(a @ v)
        out, m1 = drop(mixed @ w["wo"], 2 * layer)
        n1, c1 = norm(h + out, w["g1"], w["e1"])
        hidden = np.maximum(n1 @ w["w1"] + w["b1"], 0)
        out, m2 = drop(hidden @ w["w2"] + w["b2"], 2 * layer + 1)
        n2, c2 = norm(n1 + out, w["g2"], w["e2"])
        kept.append((h, q, k, v, a, mixed, m1, n1, c1, hidden, m2, c2))
        h, layer = n2, layer + 1
    return h @ p["head"], [*kept, h]


def backward(p: Params, x: np.ndarray, caches: list, dlogits: np.ndarray, heads: int) -> Params:
    """Gradients of all parameters, summed where there are several windows; bases without a gradient in ``dlogits`` add
    nothing. Those of the attention weights are input times the gradient of their product."""
    grads: Params = {"head": outer(caches[-1], dlogits)}
    dh = dlogits @ p["head"].T
    for layer in range(len(caches) - 2, -1, -1):
        w = {name.split(".")[1]: v for name, v in p.items() if name.startswith(f"{layer}.")}
        h, q, k, v, a, mixed, m1, n1, c1, hidden, m2, c2 = caches[layer]
        g = {}
        d2, g["g2"], g["e2"] = norm_back(dh, w["g2"], c2)
        dout = d2 * m2
        g["w2"], g["b2"] = outer(hidden, dout), summed(dout)
        dhidden = (dout @ w["w2"].T) * (hidden > 0)
        g["w1"], g["b1"] = outer(n1, dhidden), summed(dhidden)
        d1, g["g1"], g["e1"] = norm_back(d2 + dhidden @ w["w1"].T, w["g1"], c1)
        dout = d1 * m1
        g["wo"] = outer(mixed, dout)
        dmixed = heads_of(dout @ w["wo"].T, heads)
        da, dv = dmixed @ v.swapaxes(-1, -2), a.swapaxes(-1, -2) @ dmixed
        # the sum of a row of da * a is dmixed times what was mixed
        da -= row_sums(dmixed * heads_of(mixed, heads))
        da *= a
        root = math.sqrt(q.shape[-1])
        dq, dk, dv = joined(da @ (k / root)), joined(da.swapaxes(-1, -2) @ (q / root)), joined(dv)
        made = np.concatenate([dq, dk, dv], axis=-1)
        g["wq"], g["wk"], g["wv"] = np.split(outer(h, made), 3, axis=-1)
        dh = made @ np.hstack([w["wq"], w["wk"], w["wv"]]).T
        dh += d1
        grads |= {f"{layer}.{name}": value for name, value in g.items()}
    grads["projection"] = outer(x, dh)
    return grads


def loss_and_gradient(logits: np.ndarray, labels: np.ndarray, lengths: np.ndarray | None = None) -> tuple[float | np.ndarray, np.ndarray]:
    """Mean cross-entropy of a window, or of each of several with their ``lengths``; labels out of range add nothing but
    count in the mean."""
    known = (labels >= 0) & (labels < logits.shape[-1])
    n = float(labels.shape[-1]) if lengths is None else lengths[:, None].astype(float)
    delta = softmax(logits)
    at = np.where(known, labels, 0)[..., None]
    hit = np.take_along_axis(delta, at, -1)
    loss = -(np.log(np.maximum(hit[..., 0], 1e-300)) * known / n).sum(-1)
    np.put_along_axis(delta, at, hit - 1, -1)
    delta *= (known / n)[..., None]
    return float(loss) if lengths is None else loss, delta


def laid_out(seqs: list[str], labels: list, scales: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[window][base][..] features, [window][base] labels (-1 beyond the end) and lengths of windows of several lengths."""
    lengths = np.array([len(s) for s in seqs])
    x, y = np.zeros((len(seqs), lengths.max(), 2 * len(scales))), np.full((len(seqs), lengths.max()), -1)
    for n in np.unique(lengths):
        same = np.flatnonzero(lengths == n)
        x[same, :n] = features([seqs[k] for k in same], scales)
        y[same, :n] = [labels[k] for k in same]
    return x, y, lengths


Packed = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def packed(ords: list[int], strands: list[str], seqs: list[str], starts: list[int], labels: list) -> Packed:
    """Windows as arrays: ords, reverse strands, starts, lengths, a byte for each base, labels of the bases (all that are out
    of range as -1). By length first, and in an order of their own, so that sums don't hang on how rows arrive."""
    order = sorted(range(len(seqs)), key=lambda k: (len(seqs[k]), ords[k], strands[k], starts[k]))
    named = np.concatenate([np.asarray(labels[k], dtype=np.int64) for k in order])
    small = np.where((named >= 0) & (named < LABELS), named, -1).astype(np.int8)
    numbers = [np.array([v[k] for k in order], dtype=np.int64) for v in (ords, [s == "-" for s in strands], starts, [len(s) for s in seqs])]
    return (*numbers, base_codes([seqs[k] for k in order]), small)


def laid_flat(codes: np.ndarray, labels: np.ndarray, lengths: np.ndarray, scales: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """As ``laid_out``, of windows by length that lie end to end."""
    x, y = np.zeros((len(lengths), lengths[-1], 2 * len(scales))), np.full((len(lengths), lengths[-1]), -1)
    cuts = np.flatnonzero(np.diff(lengths)) + 1
    at = 0
    for first, last in zip([0, *cuts], [*cuts, len(lengths)]):
        n = lengths[first]
        end = at + n * (last - first)
        x[first:last, :n] = signal_features(_SIGNAL[codes[at:end].reshape(-1, n)], scales)
        y[first:last, :n] = labels[at:end].reshape(-1, n)
        at = end
    return x, y


def groups(lengths: list[int], heads: int, cells: int) -> list[list[int]]:
    """Places of windows that are worked on together: of like lengths, with no more attention weights than ``cells``, or one."""
    found: list[list[int]] = []
    for k in sorted(range(len(lengths)), key=lambda k: lengths[k]):
        n = lengths[k]
        if not found or n > 1.5 * lengths[found[-1][0]] or heads * n * n * (len(found[-1]) + 1) > cells:
            found.append([])
        found[-1].append(k)
    return found


def adam(p: Params, grads: Params, state: dict, step: int, rate: float, beta1: float, beta2: float, eps: float) -> None:
    """One bias-corrected step, in place; ``step`` counts from 1."""
    for name, g in grads.items():
        m, v = state.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
        m, v = beta1 * m + (1 - beta1) * g, beta2 * v + (1 - beta2) * g * g
        state[name] = (m, v)
        p[name] -= rate * (m / (1 - beta1**step)) / (np.sqrt(v / (1 - beta2**step)) + eps)
