"""A gated recurrent language model with a class-factored softmax, in numpy.

Symbols are the most frequent words (``head``), the end of a text, and kinds of all other words.
Head words share ``WIDTH`` to a class in the order of their frequency; the end and every kind are a
class of their own. A symbol's probability is that of its class times, for head words, that within it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

WIDTH = 64
HIDDEN = 24
EMBED = 24

f4 = np.float32


@dataclass
class Shape:
    head: int  # number of head words, a multiple of WIDTH
    kinds: int

    @property
    def symbols(self) -> int:
        return self.head + 1 + self.kinds

    @property
    def classes(self) -> int:
        return self.head // WIDTH + 1 + self.kinds

    def class_of(self, symbols: np.ndarray) -> np.ndarray:
        top = self.head // WIDTH
        return np.where(symbols < self.head, symbols // WIDTH, symbols - self.head + top)

    def parts(self) -> dict[str, tuple[int, ...]]:
        return {
            "embed": (self.symbols, EMBED),
            "inward": (EMBED, 3 * HIDDEN),
            "bias": (3 * HIDDEN,),
            "recur": (HIDDEN, 3 * HIDDEN),
            "class_w": (HIDDEN, self.classes),
            "class_b": (self.classes,),
            "word_w": (self.head // WIDTH, HIDDEN, WIDTH),
            "word_b": (self.head // WIDTH, WIDTH),
        }

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.parts().items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def length(self) -> int:
        return sum(int(np.prod(s)) for s in self.parts().values())

    def start(self, counts: np.ndarray, seed: int = 7) -> np.ndarray:
        """Small weights; the biases give the symbols' frequencies."""
        rng = np.random.default_rng(seed)
        flat = (rng.standard_normal(self.length()) * 0.08).astype(f4)
        p = self.unpack(flat)
        p["bias"][:] = 0
        smooth = counts + 0.5
        by_class = np.bincount(self.class_of(np.arange(self.symbols)), smooth)
        p["class_b"][:] = np.log(by_class / by_class.sum())
        words = smooth[: self.head].reshape(-1, WIDTH)
        p["word_b"][:] = np.log(words / words.sum(1, keepdims=True))
        p["word_w"][:] *= 0.2
        p["class_w"][:] *= 0.2
        return flat


def _halves(gates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the update and reset gates (apart, in one array) and of the new state. The logistic
    function is that of half the sum in the hyperbolic tangent, so the gates' are halved."""
    z, r, new = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
    return np.stack([z, r]) * gates.dtype.type(0.5), np.ascontiguousarray(new)


def _of_steps(gates: np.ndarray, inputs: np.ndarray) -> np.ndarray:
    """The update and reset gates of a window's symbols, by time and gate."""
    symbols = gates.shape[1]
    at = inputs[:, None, :] + np.array([0, symbols])[:, None]
    return gates.reshape(-1, HIDDEN).take(at, 0)


def _exponentials(
    logits: np.ndarray, at: np.ndarray, parts: list[tuple[int, int]] | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The logits become exponentials. Returns the places of one column of each row in the flat
    array, what stood there, and the sums of the rows. ``parts`` of the rows are summed apart."""
    parts = [(0, len(logits))] if parts is None else parts
    if logits.max(initial=0) > 60:
        for a, b in parts:
            if logits[a:b].max() > 60:
                logits[a:b] -= logits[a:b].max(1, keepdims=True)
    places = np.arange(0, logits.size, logits.shape[1])
    places += at
    own = logits.reshape(-1).take(places)
    np.exp(logits, out=logits)
    ones, sums = np.ones(logits.shape[1], logits.dtype), np.empty(len(logits), logits.dtype)
    for a, b in parts:
        np.matmul(logits[a:b], ones, out=sums[a:b])
    return places, own, sums


def _loss_and_slope(
    logits: np.ndarray, at: np.ndarray, parts: list[tuple[int, int]] | None = None
) -> float:
    """Sum of the losses of one column of each row; the logits become their gradient."""
    places, own, sums = _exponentials(logits, at, parts)
    logits *= (1 / sums)[:, None]
    logits.reshape(-1)[places] -= 1
    return float((np.log(sums) - own).sum())


def _picked(logits: np.ndarray, at: np.ndarray, parts: list[tuple[int, int]] | None = None) -> np.ndarray:
    """Log-probability of one column of each row; overwrites the logits."""
    _, own, sums = _exponentials(logits, at, parts)
    return own.astype(np.float64) - np.log(sums)


def _by_class(shape: Shape, kinds: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Rows of head words in the order of their class, and each class's part of them."""
    tops = shape.head // WIDTH
    # small integers are sorted by their digits
    order = np.argsort(kinds.astype(np.int16), kind="stable")
    ends = np.cumsum(np.bincount(kinds, minlength=tops)[:tops]).tolist()
    parts = [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]
    return order[: ends[-1]], parts


class Lanes:
    """Texts laid one after another into at most ``width`` lanes, the longest first.

    Every text starts from the end symbol and predicts its words and the end. Lanes lie end to end,
    so memory follows the words and not the longest lane.
    """

    def __init__(self, texts: list[np.ndarray], width: int, end: int) -> None:
        sizes = np.array([len(t) + 1 for t in texts])
        order = np.argsort(-sizes, kind="stable")
        heap = [(0, lane) for lane in range(min(width, len(texts)))]
        content: list[list[int]] = [[] for _ in heap]
        for i in order.tolist():
            load, lane = heapq.heappop(heap)
            content[lane].append(i)
            heapq.heappush(heap, (load + int(sizes[i]), lane))
        loads = [int(sizes[rows].sum()) for rows in content]
        ranked = sorted(range(len(content)), key=lambda lane: -loads[lane])
        rows = [i for lane in ranked for i in content[lane]]
        self.lengths = np.array([loads[lane] for lane in ranked])
        self.starts = np.cumsum(self.lengths) - self.lengths
        last = np.array([end], np.int32)
        self.outputs = np.concatenate([x for i in rows for x in (texts[i], last)], dtype=np.int32, casting="unsafe")
        # the end of a text, or of the lane before, starts the next one
        self.inputs = np.concatenate([last, self.outputs[:-1]])
        self.owner = np.repeat(np.array(rows, np.int32), sizes[rows])

    @property
    def steps(self) -> int:
        return int(self.lengths[0])

    def live(self, t: int) -> int:
        """Lanes that go on at a step: the first ones."""
        return int(np.searchsorted(-self.lengths, -t))

    def window(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, outputs and texts by time and live lane (-1 where there is none)."""
        live, times = self.live(a), np.arange(a, b)[:, None]
        at = self.starts[:live] + times
        if b <= self.lengths[live - 1]:
            return self.inputs[at], self.outputs[at], self.owner[at]
        there = times < self.lengths[:live]
        at[~there] = 0
        return tuple(np.where(there, x[at], np.int32(-1)) for x in (self.inputs, self.outputs, self.owner))


def lanes(texts: list[np.ndarray], width: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, outputs and texts of all lanes at once."""
    laid = Lanes(texts, width, end)
    return laid.window(0, laid.steps)


class Scorer:
    def __init__(self, shape: Shape, flat: np.ndarray) -> None:
        self.shape, self.p = shape, shape.unpack(flat)
        self.gates = _halves(self.p["embed"] @ self.p["inward"] + self.p["bias"])
        self.recur = _halves(self.p["recur"])

    def score(self, texts: list[np.ndarray], width: int = 256, window: int = 32) -> np.ndarray:
        """Natural log-probability of every whole text: states go on from window to window."""
        total = np.zeros(len(texts))
        if not texts:
            return total
        laid = Lanes(texts, width, self.shape.head)
        h = np.zeros((len(laid.lengths), HIDDEN), f4)
        previous = np.full(len(h), -2)
        for a in range(0, laid.steps, window):
            b = min(a + window, laid.steps)
            inputs, outputs, owner = laid.window(a, b)
            live = inputs.shape[1]
            fresh = owner != np.vstack([previous[:live], owner[:-1]])
            previous = owner[-1]
            states = self._states(inputs, fresh, h)
            there = outputs >= 0
            if there.all():
                hs, ys, who = states.reshape(-1, HIDDEN), outputs.reshape(-1), owner.reshape(-1)
            else:
                hs, ys, who = states[there], outputs[there], owner[there]
            total += np.bincount(who, self._log_probabilities(hs, ys), len(texts))
        return total

    def _states(self, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> np.ndarray:
        """States after each step of a window; ``h`` becomes the last."""
        steps, live = inputs.shape
        inputs = np.maximum(inputs, 0)
        for_zr, for_new = _of_steps(self.gates[0], inputs), self.gates[1].take(inputs, 0)
        states = np.empty((steps, live, HIDDEN), f4)
        zr, new = np.empty((2, live, HIDDEN), f4), np.empty((live, HIDDEN), f4)
        now, new_text = h[:live], fresh.any(1).tolist()
        for t in range(steps):
            if new_text[t]:
                now = np.where(fresh[t][:, None], f4(0), now)
            np.matmul(now, self.recur[0], out=zr)
            zr += for_zr[t]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.matmul(now, self.recur[1], out=new)
            new *= zr[1]
            new += for_new[t]
            np.tanh(new, out=new)
            now = np.subtract(now, new, out=states[t])
            now *= zr[0]
            now += new
        h[:live] = now
        return states

    def _log_probabilities(self, hs: np.ndarray, ys: np.ndarray, block: int = 4096) -> np.ndarray:
        p, kinds = self.p, self.shape.class_of(ys)
        logp = np.empty(len(ys))
        for a in range(0, len(ys), block):
            part = slice(a, a + block)
            outer = hs[part] @ p["class_w"]
            outer += p["class_b"]
            logp[part] = _picked(outer, kinds[part])
        order, parts = _by_class(self.shape, kinds)
        hs, inner = hs.take(order, 0), np.empty((len(order), WIDTH), f4)
        for k, a, b in parts:
            np.matmul(hs[a:b], p["word_w"][k], out=inner[a:b])
            inner[a:b] += p["word_b"][k]
        logp[order] += _picked(inner, ys[order] % WIDTH, [part[1:] for part in parts])
        return logp


def window_gradient(
    shape: Shape, p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h0: np.ndarray
) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of losses of a window (time, lane), its gradient (flat), and the last states.

    The gradient does not reach back beyond the window.
    """
    steps, width = x.shape
    two, kind = 2 * HIDDEN, h0.dtype
    there = y >= 0
    every, new_text = there.all(1).tolist(), fresh.any(1).tolist()
    whole = all(every)
    inputs = np.maximum(x, 0).reshape(-1)
    emb = p["embed"].take(inputs, 0)
    inputs = inputs.reshape(steps, width)
    if inputs.size > shape.symbols:
        for_zr, for_new = _halves(p["embed"] @ p["inward"] + p["bias"])
        for_zr, for_new = _of_steps(for_zr, inputs), for_new.take(inputs, 0)
    else:
        for_zr, for_new = _halves(emb @ p["inward"] + p["bias"])
        for_zr = np.ascontiguousarray(for_zr.reshape(2, steps, width, HIDDEN).transpose(1, 0, 2, 3))
        for_new = for_new.reshape(steps, width, HIDDEN)
    recur_zr, recur_new = _halves(p["recur"])
    zrs = np.empty((steps, 2, width, HIDDEN), kind)
    ns, rec = (np.empty((steps, width, HIDDEN), kind) for _ in range(2))
    zs, rs = zrs[:, 0], zrs[:, 1]
    states = np.empty((steps + 1, width, HIDDEN), kind)
    states[0] = h0
    for t in range(steps):
        now, zr = states[t], zrs[t]
        if new_text[t]:
            now = np.where(fresh[t][:, None], kind.type(0), now)
        np.matmul(now, recur_zr, out=zr)
        zr += for_zr[t]
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        np.matmul(now, recur_new, out=rec[t])
        new = np.multiply(rs[t], rec[t], out=ns[t])
        new += for_new[t]
        np.tanh(new, out=new)
        h = np.subtract(now, new, out=states[t + 1])
        h *= zs[t]
        h += new
        if not every[t]:
            np.copyto(h, now, where=~there[t][:, None])
    last = states[-1].copy()
    grad = np.zeros(shape.length(), kind)
    g = shape.unpack(grad)
    ys, hs = y.reshape(-1), states[1:].reshape(-1, HIDDEN)
    if not whole:
        filled = np.flatnonzero(there)
        ys, hs = ys.take(filled), hs.take(filled, 0)
    kinds = shape.class_of(ys)
    d = hs @ p["class_w"]
    d += p["class_b"]
    loss = _loss_and_slope(d, kinds)
    np.matmul(hs.T, d, out=g["class_w"])
    np.einsum("ij->j", d, out=g["class_b"])
    dh = d @ p["class_w"].T
    # positions in the order of their class
    order, parts = _by_class(shape, kinds)
    hs = hs.take(order, 0)
    e = np.empty((len(order), WIDTH), kind)
    for k, a, b in parts:
        np.matmul(hs[a:b], p["word_w"][k], out=e[a:b])
        e[a:b] += p["word_b"][k]
    loss += _loss_and_slope(e, ys[order] % WIDTH, [part[1:] for part in parts])
    inner_dh = np.empty((len(order), HIDDEN), kind)
    for k, a, b in parts:
        np.matmul(hs[a:b].T, e[a:b], out=g["word_w"][k])
        np.einsum("ij->j", e[a:b], out=g["word_b"][k])
        np.matmul(e[a:b], p["word_w"][k].T, out=inner_dh[a:b])
    dh[order] += inner_dh
    if whole:
        outer = dh.reshape(steps, width, HIDDEN)
    else:
        outer = np.zeros((steps, width, HIDDEN), kind)
        outer.reshape(-1, HIDDEN)[filled] = dh
    # from here on the states before each step
    before = states[:-1]
    if any(new_text):
        before[fresh] = 0
    # factors that do not depend on what comes later, for all steps at once
    rest = 1 - zrs
    of_new = ns * ns
    np.subtract(1, of_new, out=of_new)
    of_new *= rest[:, 0]
    of_z = before - ns
    of_z *= zs
    of_z *= rest[:, 0]
    of_r = rec
    of_r *= rs
    of_r *= rest[:, 1]
    if not whole:
        of_new *= there[:, :, None]
        of_z *= there[:, :, None]
    dgates, drec = (np.empty((steps, width, 3 * HIDDEN), kind) for _ in range(2))
    carried = np.zeros((width, HIDDEN), kind)
    back = np.ascontiguousarray(p["recur"].T)
    for t in reversed(range(steps)):
        total, dr = outer[t], drec[t]
        total += carried
        dn = np.multiply(total, of_new[t], out=dgates[t, :, two:])
        np.multiply(total, of_z[t], out=dr[:, :HIDDEN])
        np.multiply(dn, of_r[t], out=dr[:, HIDDEN:two])
        np.multiply(dn, rs[t], out=dr[:, two:])
        if every[t]:
            total *= zs[t]
        else:
            np.multiply(total, zs[t], out=total, where=there[t][:, None])
        carried = dr @ back
        carried += total
        if new_text[t]:
            carried[fresh[t]] = 0
    dgates[:, :, :two] = drec[:, :, :two]
    np.matmul(before.reshape(-1, HIDDEN).T, drec.reshape(-1, 3 * HIDDEN), out=g["recur"])
    flat = dgates.reshape(-1, 3 * HIDDEN)
    np.einsum("ij->j", flat, out=g["bias"])
    np.matmul(emb.T, flat, out=g["inward"])
    # one index a number: the way of numpy for one dimension is several times faster
    places = np.arange(shape.symbols * EMBED).reshape(-1, EMBED).take(inputs, 0)
    np.add.at(g["embed"].reshape(-1), places.reshape(-1), (flat @ p["inward"].T).reshape(-1))
    return loss, grad, last


def train(
    shape: Shape,
    flat: np.ndarray,
    texts: list[np.ndarray],
    width: int = 256,
    window: int = 24,
    rate: float = 6e-3,
) -> np.ndarray:
    """One pass of truncated backpropagation over the texts with Adam."""
    if not texts:
        return flat
    flat = flat.copy()
    p = shape.unpack(flat)
    # no more lanes than keep the windows full
    width = max(1, min(width, sum(map(len, texts)) // window))
    laid = Lanes(texts, width, shape.head)
    m, v, spare = np.zeros_like(flat), np.zeros_like(flat), np.empty(1 << 15, f4)
    pieces = [slice(i, i + len(spare)) for i in range(0, len(flat), len(spare))]
    h = np.zeros((len(laid.lengths), HIDDEN), f4)
    previous = np.full(len(h), -2)
    for k, a in enumerate(range(0, laid.steps, window), 1):
        # lanes end one by one, the last first
        inputs, outputs, own = laid.window(a, min(a + window, laid.steps))
        live = inputs.shape[1]
        fresh = own != np.vstack([previous[:live], own[:-1]])
        previous = own[-1]
        _, grad, h = window_gradient(shape, p, inputs, outputs, fresh, h[:live])
        grad /= max(1, int((outputs >= 0).sum()))
        norm = float(np.linalg.norm(grad))
        if norm > 1:
            grad /= norm
        scale = f4(rate * np.sqrt(1 - 0.999**k) / (1 - 0.9**k))
        # pieces that stay in the cache
        for piece in pieces:
            gp, mp, vp, step = grad[piece], m[piece], v[piece], spare[: len(grad[piece])]
            mp *= 0.9
            np.multiply(gp, f4(0.1), out=step)
            mp += step
            vp *= 0.999
            np.square(gp, out=gp)
            gp *= 0.001
            vp += gp
            np.sqrt(vp, out=step)
            step += 1e-8
            np.divide(mp, step, out=step)
            step *= scale
            flat[piece] -= step
    return flat
