"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation.

Words are ids below ``size``; id 0 is any other word, id 1 the end of a text. The probability of a word is
that of its class times that of the word in its class; classes hold ids of neighbouring rank, and those of rarer words are
wider, so that the cost of a word grows far slower than ``size``.
"""

from __future__ import annotations

import heapq

import numpy as np

END = 1
LOGITS = 1 << 16  # that are taken at a time, which should stay in a core's cache
EXPONENT = 80.0  # of which a 32-bit float holds the exponential
BLOCK = 1 << 15  # parameters that are moved at a time


def _softmax(x: np.ndarray, weights: np.ndarray, cuts: np.ndarray, k: np.ndarray, own: np.ndarray, bounded: bool, keep: np.ndarray | None, gradient: np.ndarray | None):
    """Log probability of the item own among items cuts[k] to cuts[k + 1], for every row of x; rows come in order of k.

    With a gradient also sets it for the items that are met, with weights keep, and returns the slopes of x without its last column.
    The products are taken class by class into one vector, on which all else is done at once.
    """
    upto = np.append(0, np.cumsum(np.diff(cuts)[k]))
    turn = upto[:-1] // LOGITS
    fresh = np.append(True, turn[1:] != turn[:-1])
    starts = np.append(np.flatnonzero(fresh), len(x))
    edges = np.append(np.flatnonzero(fresh | np.append(True, k[1:] != k[:-1])), len(x))
    own, logs = own - cuts[k], np.empty(len(x), x.dtype)
    room = np.empty(LOGITS + int(np.diff(cuts).max()), x.dtype)
    slopes = None if gradient is None else np.empty((len(x), x.shape[1] - 1), x.dtype)
    place = 0
    for i, j in zip(starts[:-1], starts[1:], strict=True):
        at, p = upto[i:j] - upto[i], room[: upto[j] - upto[i]]
        parts = []
        while edges[place] < j:
            first, last = edges[place], edges[place + 1]
            items = slice(cuts[k[first]], cuts[k[first] + 1])
            part = p[upto[first] - upto[i] : upto[last] - upto[i]].reshape(last - first, -1)
            np.matmul(x[first:last], weights[:, items], out=part)
            parts.append((slice(first, last), items, part))
            place += 1
        if not bounded:
            p -= np.repeat(np.maximum.reduceat(p, at), np.diff(upto[i : j + 1]))
        mine = at + own[i:j]
        found = p[mine]
        np.exp(p, out=p)
        total = np.add.reduceat(p, at)
        logs[i:j] = found - np.log(total)
        if gradient is None:
            continue
        # the slope of a logit is keep * (own item or not - p / total)
        p[mine] -= total
        scale = (-keep[i:j] / total)[:, None]
        scaled = x[i:j] * scale
        for rows, items, part in parts:
            mine = scaled[rows.start - i : rows.stop - i].T
            if rows.start and k[rows.start - 1] == k[rows.start]:
                gradient[:, items] += mine @ part
            else:
                np.matmul(mine, part, out=gradient[:, items])
            np.matmul(part, weights[:-1, items].T, out=slopes[rows])
        slopes[i:j] *= scale
    return logs, slopes


class Gru:
    """Parameters live in one flat vector, so that models of several workers can be averaged."""

    def __init__(self, size: int, hidden: int = 24, seed: int = 0):
        self.size, self.hidden = size, hidden
        cuts = [0]
        while cuts[-1] < size:
            cuts.append(min(size, cuts[-1] + max(8, int(np.ceil(cuts[-1] ** (2 / 3))))))
        self.cuts, self.classes = np.array(cuts), len(cuts) - 1
        self.class_of = np.repeat(np.arange(self.classes, dtype=np.int16), np.diff(cuts))
        # weights with their biases beside them: of the classes (c, d), of the words (o, b). The rows of x come last: a window
        # touches few of them, and all of the rest
        shapes = {"u": (hidden, 3 * hidden), "cd": (hidden + 1, self.classes), "ob": (hidden + 1, size), "x": (size, 3 * hidden)}
        self.flat = np.zeros(sum(int(np.prod(s)) for s in shapes.values()), np.float32)
        self.dense = len(self.flat) - size * 3 * hidden
        self.part = self._parts(self.flat, shapes)
        self.shapes = shapes
        rng = np.random.default_rng(seed)
        for name in ("x", "u", "c", "o"):
            self.part[name][:] = rng.normal(0, 0.1, self.part[name].shape)

    def start_from(self, counts: np.ndarray):
        """Biases that give every word its share of ``counts`` (of all ids)."""
        c = counts + 0.5
        self.part["d"][:] = np.log(np.add.reduceat(c, self.cuts[:-1]) / c.sum())
        self.part["b"][:] = np.log(c / np.add.reduceat(c, self.cuts[:-1])[self.class_of])

    @staticmethod
    def _parts(flat, shapes):
        out, at = {}, 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        out["c"], out["d"], out["o"], out["b"] = out["cd"][:-1], out["cd"][-1], out["ob"][:-1].T, out["ob"][-1]
        return out

    def states(self, ids: np.ndarray, start: np.ndarray, whole: bool = True):
        """Hidden states after each step of ids (steps, lanes), and what backpropagation needs. A lane starts anew after an end.

        Lanes come last inside, so that every gate of a step is one contiguous block: start and the last states have lanes first,
        what is kept has (steps, units, lanes). Without whole, the states alone are kept of all steps.
        """
        n, (steps, lanes) = self.hidden, ids.shape
        deep, going = steps if whole else 1, (ids != END).astype(self.flat.dtype)
        h, u = start.T, self.part["u"].T
        new = np.empty((steps, n, lanes), self.flat.dtype)
        old, m = (np.empty((deep, n, lanes), self.flat.dtype) for _ in range(2))
        inner, zr = np.empty((deep, 3 * n, lanes), self.flat.dtype), np.empty((deep, 2 * n, lanes), self.flat.dtype)
        for t in range(steps):
            k = t % deep
            gates = np.take(self.part["x"], ids[t], 0).T
            np.multiply(h, going[t], out=old[k])
            np.matmul(u, old[k], out=inner[k])
            np.add(gates[: 2 * n], inner[k, : 2 * n], out=zr[k])
            np.negative(zr[k], out=zr[k])
            np.exp(zr[k], out=zr[k])
            zr[k] += 1
            np.reciprocal(zr[k], out=zr[k])
            np.multiply(zr[k, n:], inner[k, 2 * n :], out=m[k])
            m[k] += gates[2 * n :]
            np.tanh(m[k], out=m[k])
            h = new[t]
            np.subtract(old[k], m[k], out=h)
            h *= zr[k, :n]
            h += m[k]
        return h.T, (old, zr[:, :n], zr[:, n:], m, inner[:, 2 * n :], new)

    def tables(self):
        """Weights with their biases beside them: of the classes, of the words; and for which states no exponential of a logit can
        leave the range of floats, so that no maximum has to be taken out: those of at most that size."""
        both = self.part["cd"], self.part["ob"]
        most = max((np.ones(self.hidden + 1, w.dtype) @ np.abs(w)).max() for w in both)
        return *both, 1.0 if most < EXPONENT else 0.0

    def outputs(self, h: np.ndarray, words: np.ndarray, gradient: dict | None = None, keep: np.ndarray | None = None, tables: tuple | None = None):
        """Natural log probabilities of words after states h; with ``gradient`` (of zeros) also sets it, and returns the slope of h.

        tables: what ``tables()`` gives for the parameters as they are.
        """
        top, words_in, room = tables or self.tables()
        k = self.class_of[words]
        order = np.argsort(k, kind="stable")
        k, words = k[order], words[order]
        keep = None if keep is None else keep[order]
        # a one beside every state takes the biases into the products
        x = np.ones((len(h), self.hidden + 1), h.dtype)
        x[:, :-1] = np.take(h, order, 0)
        bounded = float(np.abs(h).max(initial=0)) <= room
        into = (None, None) if gradient is None else (gradient["cd"], gradient["ob"])
        found, slopes = _softmax(x, top, np.array([0, self.classes]), np.zeros_like(k), k, bounded, keep, into[0])
        inside, more = _softmax(x, words_in, self.cuts, k, words, bounded, keep, into[1])
        out = np.empty_like(found)
        out[order] = found + inside
        if gradient is None:
            return out, None
        slope = np.empty_like(slopes)
        slope[order] = slopes + more
        return out, slope

    def gradient(self, ids: np.ndarray, words: np.ndarray, keep: np.ndarray, start: np.ndarray):
        """Mean log probability of a window's words, its gradient (flat), and the last states; the state before the window is taken as given."""
        logs, flat, rows, by_row, last = self._slopes(ids, words, keep, start)
        out = np.append(flat, np.zeros(len(self.flat) - self.dense, flat.dtype))
        self._parts(out, self.shapes)["x"][rows] = by_row
        return logs, out, last

    def _slopes(self, ids: np.ndarray, words: np.ndarray, keep: np.ndarray, start: np.ndarray):
        """As ``gradient``, with the rows of x that the window touches in place of all."""
        n, (steps, lanes) = self.hidden, ids.shape
        last, kept = self.states(ids, start)
        # states as they left each step, before any fresh start
        old, z, r, m, inner, new = kept
        h = new.transpose(0, 2, 1).reshape(steps * lanes, n)
        flat = np.zeros(self.dense, self.flat.dtype)
        g = self._parts(flat, {k: s for k, s in self.shapes.items() if k != "x"})
        count = max(float(keep.sum()), 1.0)
        logs, slope = self.outputs(h, words.ravel(), g, (keep.ravel() / count).astype(np.float32))
        slope = slope.reshape(steps, lanes, n).transpose(0, 2, 1)
        # what a slope of the state after a step makes of the slopes of its gates, as the state before it met them
        one = self.flat.dtype.type(1)
        by_m = (one - z) * (one - m * m)
        by_inner = np.empty((steps, 3, n, lanes), self.flat.dtype)
        np.multiply((old - m) * z, one - z, out=by_inner[:, 0])
        np.multiply(by_m, r, out=by_inner[:, 2])
        np.multiply(by_inner[:, 2] * inner, one - r, out=by_inner[:, 1])
        going = (ids != END).astype(self.flat.dtype)
        back = np.zeros((n, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            d = slope[t] + back
            by_m[t] *= d
            by_inner[t] *= d
            d *= z[t]
            d += self.part["u"] @ by_inner[t].reshape(3 * n, lanes)
            d *= going[t]
            back = d
        by_gate = by_inner.reshape(steps, 3 * n, lanes)
        g["u"] += np.matmul(old, by_gate.transpose(0, 2, 1)).sum(0)
        # the word itself meets the new state before the gate that the state before meets
        by_inner[:, 2] = by_m
        ids = ids.ravel()
        rows = np.flatnonzero(np.bincount(ids, minlength=self.size))
        place = np.empty(self.size, np.int64)
        place[rows] = np.arange(len(rows))
        which, by_row = place[ids], np.empty((len(rows), 3 * n), self.flat.dtype)
        for c, by_cell in enumerate(by_gate.transpose(1, 0, 2).reshape(3 * n, -1)):
            by_row[:, c] = np.bincount(which, by_cell, len(rows))
        return float((logs * keep.ravel()).sum()) / count, flat, rows, by_row, last

    def train(self, stream: np.ndarray, *, lanes: int = 256, steps: int = 16, rate: float = 0.02) -> int:
        """One pass over a stream of texts (each closed by END), in windows of ``steps`` words on ``lanes`` lanes; returns the words."""
        if not len(stream):
            return 0
        lanes = max(1, min(lanes, len(stream) // (200 * steps)))  # short streams get as many windows
        length = -(-len(stream) // lanes)
        # a cell before each lane is an end, so every lane starts anew; cells behind the last word do not count
        padded = np.full(length * lanes, END, np.int64)
        padded[: len(stream)] = stream
        words = padded.reshape(lanes, length).T
        count = (np.arange(length * lanes) < len(stream)).reshape(lanes, length).T
        ids = np.concatenate([np.full((1, lanes), END), words[:-1]])
        h = np.zeros((lanes, self.hidden), np.float32)
        m, v = np.zeros(self.dense, np.float32), np.zeros(self.dense, np.float32)
        mx, vx = np.zeros_like(self.part["x"]), np.zeros_like(self.part["x"])
        for turn, at in enumerate(range(0, length, steps), 1):
            _, g, rows, gx, h = self._slopes(ids[at : at + steps], words[at : at + steps], count[at : at + steps], h)
            up, scale = np.float32(rate / (1 - 0.9**turn)), np.float32(1 / (1 - 0.99**turn))
            # the means are a tenth of m and a hundredth of v, so the root of the latter is a tenth of that of v
            root = np.sqrt(scale)
            up, least = up / root, np.float32(1e-5) / root
            for i in range(0, self.dense, BLOCK):
                some = slice(i, min(i + BLOCK, self.dense))
                self.flat[some] += self._move(g[some], m[some], v[some], up, least)
            own, square = np.take(mx, rows, 0), np.take(vx, rows, 0)
            self.part["x"][rows] += self._move(gx, own, square, up, least)
            mx[rows], vx[rows] = own, square
        return len(stream)

    @staticmethod
    def _move(g, m, v, up, least) -> np.ndarray:
        """By how much some parameters move by their slopes g, which are lost; m and v are sums of past slopes and of their squares, which fade."""
        m *= np.float32(0.9)
        m += g
        g *= g
        v *= np.float32(0.99)
        v += g
        np.sqrt(v, out=g)
        g += least
        np.divide(m, g, out=g)
        g *= up
        return g

    def score(self, texts: list[np.ndarray], *, lanes: int = 512, steps: int = 64) -> np.ndarray:
        """Natural log probability of each text (ids closed by END), in windows of ``steps`` words on ``lanes`` lanes.

        Texts follow each other on their lane, since an end starts it anew, and the longest ones are dealt first: the lanes end together.
        """
        sizes = np.array([len(x) for x in texts], np.int64)
        if not len(sizes):
            return np.zeros(0)
        lanes = int(max(1, min(lanes, sizes.sum() // sizes.max())))
        free, starts = [(0, lane) for lane in range(lanes)], np.empty((2, len(texts)), np.int64)
        for i in np.argsort(-sizes, kind="stable"):
            at, lane = free[0]
            starts[:, i] = lane, at
            heapq.heapreplace(free, (at + int(sizes[i]), lane))
        length = max(at for at, _ in free)
        words, keep, logs = np.full((lanes, length), END, np.int32), np.zeros((lanes, length), bool), np.zeros((lanes, length))
        for text, lane, at in zip(texts, *starts.tolist(), strict=True):
            words[lane, at : at + len(text)] = text
            keep[lane, at : at + len(text)] = True
        h, before, tables = np.zeros((lanes, self.hidden), np.float32), np.full((1, lanes), END, np.int32), self.tables()
        for t in range(0, length, steps):
            some, own = np.ascontiguousarray(words[:, t : t + steps].T), np.flatnonzero(keep[:, t : t + steps].T)
            h, kept = self.states(np.concatenate([before, some[:-1]]), h, whole=False)
            hidden = np.take(kept[-1].transpose(0, 2, 1).reshape(some.size, self.hidden), own, 0)
            found = np.zeros(some.size)
            found[own], _ = self.outputs(hidden, some.ravel()[own], tables=tables)
            logs[:, t : t + steps] = found.reshape(some.shape).T
            before = some[-1:]
        at = starts[0] * length + starts[1]
        order, out = np.argsort(at), np.empty(len(texts))
        # what follows the last text of a lane is zero
        out[order] = np.add.reduceat(logs.ravel(), at[order])
        return out
