"""Small reconstruction networks in NumPy, trained inside Spark tasks.

``Tensor`` is a minimal reverse-mode tape, enough for dense, LSTM and attention
layers.  It states what a network computes; training and scoring go through
``gradient`` and ``predict``, the same sums written out for whole batches without
a tape, in the type of the parameters.  The training loop itself (rounds,
averaging, early stopping) is a sequence of Spark jobs in ``neural.py``.
"""

from __future__ import annotations

import functools
import math

import numpy as np


class Tensor:
    def __init__(self, data, parents=()):
        self.data = np.asarray(data, dtype=float)
        self.grad = None
        self.parents = parents  # (tensor, function from my gradient to its gradient)

    def backward(self):
        order, seen = [], set()
        stack = [(self, False)]
        while stack:
            node, ready = stack.pop()
            if ready:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack += [(p, False) for p, _ in node.parents]
        self.grad = np.ones_like(self.data)
        for node in reversed(order):
            for parent, pull in node.parents:
                g = _fit(pull(node.grad), parent.data.shape)
                parent.grad = g if parent.grad is None else parent.grad + g

    def __add__(self, other):
        other = _tensor(other)
        return Tensor(self.data + other.data, [(self, lambda g: g), (other, lambda g: g)])

    def __sub__(self, other):
        other = _tensor(other)
        return Tensor(self.data - other.data, [(self, lambda g: g), (other, lambda g: -g)])

    def __mul__(self, other):
        other = _tensor(other)
        return Tensor(
            self.data * other.data, [(self, lambda g: g * other.data), (other, lambda g: g * self.data)]
        )

    def __matmul__(self, other):
        a, b = self.data, other.data
        return Tensor(
            a @ b, [(self, lambda g: g @ b.swapaxes(-1, -2)), (other, lambda g: a.swapaxes(-1, -2) @ g)]
        )

    def __getitem__(self, key):
        def pull(g):
            out = np.zeros_like(self.data)
            out[key] = g
            return out

        return Tensor(self.data[key], [(self, pull)])

    def reshape(self, *shape):
        return Tensor(self.data.reshape(shape), [(self, lambda g: g.reshape(self.data.shape))])

    def transpose(self, *axes):
        back = np.argsort(axes)
        return Tensor(self.data.transpose(axes), [(self, lambda g: g.transpose(back))])

    def mean(self, axis=None):
        kept = self.data.mean(axis=axis, keepdims=True)
        share = kept.size / self.data.size
        return Tensor(kept, [(self, lambda g: np.broadcast_to(g, self.data.shape) * share)])

    def map(self, value, slope):
        return Tensor(value, [(self, lambda g: g * slope)])

    def relu(self):
        return self.map(np.maximum(self.data, 0.0), (self.data > 0).astype(float))

    def tanh(self):
        y = np.tanh(self.data)
        return self.map(y, 1 - y * y)

    def sigmoid(self):
        y = 1.0 / (1.0 + np.exp(-np.clip(self.data, -60, 60)))
        return self.map(y, y * (1 - y))

    def rsqrt(self, eps):
        y = 1.0 / np.sqrt(self.data + eps)
        return self.map(y, -0.5 * y**3)

    def softmax(self):
        e = np.exp(self.data - self.data.max(-1, keepdims=True))
        y = e / e.sum(-1, keepdims=True)
        return Tensor(y, [(self, lambda g: y * (g - (g * y).sum(-1, keepdims=True)))])


def _tensor(x):
    return x if isinstance(x, Tensor) else Tensor(x)


def _fit(g, shape):
    """Sum a gradient over the axes that were broadcast."""
    while g.ndim > len(shape):
        g = g.sum(0)
    for axis, size in enumerate(shape):
        if size == 1 and g.shape[axis] != 1:
            g = g.sum(axis, keepdims=True)
    return g


def stack_time(steps):
    """(batch, d) per step to (batch, steps, d)."""
    return Tensor(
        np.stack([s.data for s in steps], axis=1),
        [(s, lambda g, i=i: g[:, i]) for i, s in enumerate(steps)],
    )


def _glorot(rng, rows, cols):
    limit = math.sqrt(6.0 / (rows + cols))
    return rng.uniform(-limit, limit, (rows, cols))


class DenseNet:
    """ReLU encoder and mirrored decoder with dropout, linear output."""

    def __init__(self, d: int, widths, dropout: float = 0.2):
        self.sizes = [d, *widths, *reversed(widths[:-1]), d]
        self.dropped = round(dropout * 65536) if dropout else 0  # of 65536 draws

    def init(self, rng):
        out = []
        for a, b in zip(self.sizes, self.sizes[1:]):
            out += [_glorot(rng, a, b), np.zeros(b)]
        return out

    def _inputs(self):
        """Rows of a layer's inputs when they lie below each other, each followed by a row of ones."""
        at = 0
        for size in self.sizes[:-1]:
            yield slice(at, at + size)
            at += size + 1

    def _kept(self, rng, shape):
        """Which inputs dropout leaves, by 16 bits each; the default generator's raw numbers have 64."""
        count = shape[0] * shape[1]
        bits = rng.bit_generator.random_raw(-(-count // 4)).view(np.uint16)
        return bits[:count].reshape(shape) >= self.dropped

    def forward(self, params, x, rng=None):
        h = Tensor(x)
        last = len(params) // 2 - 1
        places = list(self._inputs())
        if rng is not None and self.dropped:
            first = self.sizes[0] + 1
            kept = self._kept(rng, (places[-1].stop + 1 - first, len(x))) * (65536 / (65536 - self.dropped))
        for i in range(last + 1):
            h = h @ params[2 * i] + params[2 * i + 1]
            if i < last:
                h = h.relu()
                if rng is not None and self.dropped:
                    h = h * kept[places[i + 1].start - first : places[i + 1].stop - first].T
        return h

    def predict(self, params, x):
        last = len(params) // 2 - 1
        for i in range(last + 1):
            x = x @ params[2 * i]
            x += params[2 * i + 1]
            if i < last:
                np.maximum(x, 0.0, out=x)
        return x

    def gradient(self, params, x, rng=None):
        loss, grad = self.flat_gradient(flatten(params), x, rng, {})
        return loss, unflatten(grad, params)

    def flat_gradient(self, flat, x, rng, work):
        """The gradient as one vector, which ``work`` keeps with the other arrays for the next batch of this size.

        A batch lies with one column a row, over a row of ones, so that a weight matrix and its bias, neighbours
        in ``flat``, are one matrix.
        """
        w = work.get(len(x))
        if w is None or w.flat is not flat:
            w = work[len(x)] = _DenseWork(self, len(x), flat)
        last, scale = len(w.weights) - 1, 1.0
        dropping = rng is not None and self.dropped
        w.inputs[0][:] = x.T
        if dropping:
            scale = 65536 / (65536 - self.dropped)
            w.slope[:] = self._kept(rng, w.slope.shape)
            w.slope *= scale
        for i in range(last):
            h = w.inputs[i + 1]
            np.dot(w.weights[i].T, w.held[i], out=h)
            np.maximum(h, w.zeros[i], out=h)
            if dropping:
                h *= w.slopes[i]
        gap = np.dot(w.weights[last].T, w.held[last])
        gap -= w.inputs[0]
        g = gap * (2.0 / gap.size)
        w.slope[:] = w.hidden > w.zero
        w.slope *= scale
        for i in range(last, -1, -1):
            if i < last:
                g *= w.slopes[i]
            np.dot(w.held[i], g.T, out=w.grads[i])
            if i:
                g = np.dot(w.weights[i][:-1], g)
        return float(np.vdot(gap, gap)) / gap.size, w.grad


class _DenseWork:
    """Arrays of ``DenseNet.flat_gradient`` for one size of batch, and views of their layers."""

    def __init__(self, net: DenseNet, rows: int, flat):
        places, first = list(net._inputs()), net.sizes[0] + 1
        hidden = [slice(p.start - first, p.stop - first) for p in places[1:]]
        stacked = np.ones((places[-1].stop + 1, rows), flat.dtype)
        self.held, self.inputs = [stacked[p.start : p.stop + 1] for p in places], [stacked[p] for p in places]
        self.hidden = stacked[first:]
        self.zero = np.zeros_like(self.hidden)  # an array: NumPy is slower against a number
        self.slope = np.empty_like(self.hidden)
        self.zeros, self.slopes = [self.zero[p] for p in hidden], [self.slope[p] for p in hidden]
        like = [np.empty((a + 1, b)) for a, b in zip(net.sizes, net.sizes[1:])]
        self.flat, self.grad = flat, np.empty_like(flat)
        self.weights, self.grads = unflatten(self.flat, like), unflatten(self.grad, like)


class LstmNet:
    """Encoder LSTM, its output repeated, decoder LSTM from the encoder states, dense output."""

    def __init__(self, d: int, length: int, width: int):
        self.d, self.length, self.width = d, length, width

    def _cell(self, rng, inputs):
        bias = np.zeros(4 * self.width)
        bias[self.width : 2 * self.width] = 1.0  # forget gate starts open
        return [_glorot(rng, inputs, 4 * self.width), _glorot(rng, self.width, 4 * self.width), bias]

    def init(self, rng):
        return [*self._cell(rng, self.d), *self._cell(rng, self.width), _glorot(rng, self.width, self.d),
                np.zeros(self.d)]

    def _step(self, p, x, h, c):
        k = self.width
        z = x @ p[0] + h @ p[1] + p[2]
        i, f = z[:, :k].sigmoid(), z[:, k : 2 * k].sigmoid()
        g, o = z[:, 2 * k : 3 * k].tanh(), z[:, 3 * k :].sigmoid()
        c = f * c + i * g
        return o * c.tanh(), c

    def forward(self, params, x, rng=None):
        h = c = Tensor(np.zeros((len(x), self.width)))
        for t in range(self.length):
            h, c = self._step(params[:3], Tensor(x[:, t]), h, c)
        code, out = h, []
        for _ in range(self.length):
            h, c = self._step(params[3:6], code, h, c)
            out.append(h)
        return stack_time(out) @ params[6] + params[7]

    def _cells(self, p, pushed, h, c):
        """Gates, states before each step, tanh of the states and outputs after it; first axis is time.

        ``pushed`` is what the inputs add to the gates, per step or one for all.  A sigmoid is a tanh of half
        the size, so that one call serves the four gates.
        """
        k, steps = self.width, self.length
        half = np.full(4 * k, 0.5, dtype=h.dtype)
        half[2 * k : 3 * k] = 1.0
        shift = 1.0 - half
        pushed, u = pushed * half, p[1] * half
        gates = np.empty((steps, len(h), 4 * k), dtype=h.dtype)
        states, tops, outs = (np.empty((steps + 1, len(h), k), dtype=h.dtype) for _ in range(3))
        states[0], outs[0] = c, h
        for t in range(steps):
            z = gates[t]
            np.matmul(outs[t], u, out=z)
            z += pushed[t] if pushed.ndim == 3 else pushed
            np.tanh(z, out=z)
            z *= half
            z += shift
            np.multiply(z[:, k : 2 * k], states[t], out=states[t + 1])
            states[t + 1] += z[:, :k] * z[:, 2 * k : 3 * k]
            np.tanh(states[t + 1], out=tops[t + 1])
            np.multiply(z[:, 3 * k :], tops[t + 1], out=outs[t + 1])
        return gates, states, tops, outs

    def _pull(self, p, run, towards, dh, dc):
        """Gradients at the gates (per step) and at the first output and state; ``towards`` is added at each output."""
        gates, states, tops, outs = run
        k, steps = self.width, self.length
        each = gates.reshape(steps, -1, 4, k)
        slope = each * (1.0 - each)
        slope[:, :, 2] = 1.0 - each[:, :, 2] * each[:, :, 2]
        slope[:, :, 0] *= each[:, :, 2]
        slope[:, :, 1] *= states[:-1]
        slope[:, :, 2] *= each[:, :, 0]
        slope[:, :, 3] *= tops[1:]
        through = each[:, :, 3] * (1.0 - tops[1:] * tops[1:])
        forget = np.ascontiguousarray(each[:, :, 1])
        u = np.ascontiguousarray(p[1].T)
        for t in reversed(range(steps)):
            if towards is not None:
                dh = dh + towards[t]
            dc = dc + dh * through[t]
            slope[t, :, :3] *= dc[:, None]
            slope[t, :, 3] *= dh
            dc = dc * forget[t]
            dh = slope[t].reshape(-1, 4 * k) @ u
        slope = slope.reshape(steps, -1, 4 * k)
        flat = slope.reshape(-1, 4 * k)
        return slope, outs[:-1].reshape(-1, k).T @ flat, flat.sum(0), dh, dc

    def _both(self, p, x):
        steps = np.ascontiguousarray(x.transpose(1, 0, 2))
        none = np.zeros((len(x), self.width), dtype=p[1].dtype)
        coded = self._cells(p[:3], steps @ p[0] + p[2], none, none)
        code, state = coded[3][-1], coded[1][-1]
        told = self._cells(p[3:6], code @ p[3] + p[5], code, state)
        return steps, coded, told, told[3][1:] @ p[6] + p[7]

    def predict(self, params, x):
        return self._both(params, x)[-1].transpose(1, 0, 2)

    def gradient(self, params, x, rng=None):
        p, k = params, self.width
        steps, coded, told, out = self._both(p, x)
        gap = out - steps
        g = gap * (2.0 / gap.size)
        flat = g.reshape(-1, self.d)
        none = np.zeros((len(x), k), dtype=p[1].dtype)
        slope, du, db, dh, dc = self._pull(p[3:6], told, g @ p[6].T, none, none)
        pushed = slope.sum(0)
        grads = [told[3][0].T @ pushed, du, db, told[3][1:].reshape(-1, k).T @ flat, flat.sum(0)]
        slope, du, db, _, _ = self._pull(p[:3], coded, None, dh + pushed @ p[3].T, dc)
        first = steps.reshape(-1, self.d).T @ slope.reshape(-1, 4 * k)
        return float((gap * gap).mean()), [first, du, db, *grads]


class AttentionNet:
    """Input projection, sinusoidal positions, self-attention and feed-forward with add & norm."""

    def __init__(self, d: int, length: int, width: int, heads: int):
        if width % heads:
            raise ValueError("d_model must be a multiple of the number of heads")
        self.d, self.length, self.width, self.heads = d, length, width, heads
        at = np.arange(length)[:, None] * np.exp(-math.log(10000.0) * np.arange(0, width, 2) / width)
        self.positions = np.zeros((length, width))
        self.positions[:, 0::2] = np.sin(at)
        self.positions[:, 1::2] = np.cos(at)[:, : width // 2]

    def init(self, rng):
        w = self.width
        out = [_glorot(rng, self.d, w), np.zeros(w)]
        for _ in range(4):  # query, key, value, output
            out += [_glorot(rng, w, w), np.zeros(w)]
        out += [np.ones(w), np.zeros(w), _glorot(rng, w, 2 * w), np.zeros(2 * w)]
        out += [_glorot(rng, 2 * w, w), np.zeros(w), np.ones(w), np.zeros(w)]
        return [*out, _glorot(rng, w, self.d), np.zeros(self.d)]

    @staticmethod
    def _norm(x, gain, shift):
        centred = x - x.mean(-1)
        return centred * (centred * centred).mean(-1).rsqrt(1e-3) * gain + shift

    def forward(self, params, x, rng=None):
        p = params
        b, size = len(x), self.width // self.heads
        h = Tensor(x) @ p[0] + p[1] + self.positions
        q, k, v = (
            (h @ p[i] + p[i + 1]).reshape(b, self.length, self.heads, size).transpose(0, 2, 1, 3)
            for i in (2, 4, 6)
        )
        mixed = ((q @ k.transpose(0, 1, 3, 2)) * (1.0 / math.sqrt(size))).softmax() @ v
        mixed = mixed.transpose(0, 2, 1, 3).reshape(b, self.length, self.width) @ p[8] + p[9]
        h = self._norm(h + mixed, p[10], p[11])
        h = self._norm(h + ((h @ p[12] + p[13]).relu() @ p[14] + p[15]), p[16], p[17])
        return h @ p[18] + p[19]

    def _split(self, h, b):
        """(batch * length, width) to (batch * heads, length, width / heads)."""
        h = h.reshape(b, self.length, self.heads, -1).transpose(0, 2, 1, 3)
        return np.ascontiguousarray(h).reshape(b * self.heads, self.length, -1)

    def _unsplit(self, h, b):
        return h.reshape(b, self.heads, self.length, -1).transpose(0, 2, 1, 3).reshape(b * self.length, self.width)

    @staticmethod
    def _scaled(x):
        """Rows less their mean over their deviation, and one over the deviation."""
        x = x - _last_sum(x) * (1 / x.shape[1])
        spread = 1.0 / np.sqrt(_last_sum(x * x) * (1 / x.shape[1]) + 1e-3)
        x *= spread
        return x, spread

    @staticmethod
    def _pull_scaled(g, x, spread):
        share = 1 / x.shape[1]
        return spread * (g - _last_sum(g) * share - x * (_last_sum(g * x) * share))

    def _layers(self, p, x):
        b, size = len(x), self.width // self.heads
        flat = x.reshape(-1, self.d)
        h = flat @ p[0] + p[1]
        h += np.tile(self.positions.astype(h.dtype), (b, 1))
        q, k, v = (self._split(h @ p[i] + p[i + 1], b) for i in (2, 4, 6))
        weight = q @ _turned(k)
        weight *= 1.0 / math.sqrt(size)
        weight -= functools.reduce(np.maximum, (weight[..., i] for i in range(self.length)))[..., None]
        np.exp(weight, out=weight)
        weight /= _last_sum(weight)
        mixed = self._unsplit(weight @ v, b)
        first, spread_1 = self._scaled(h + mixed @ p[8] + p[9])
        h1 = first * p[10] + p[11]
        wide = np.maximum(h1 @ p[12] + p[13], 0.0)
        second, spread_2 = self._scaled(h1 + wide @ p[14] + p[15])
        h2 = second * p[16] + p[17]
        return flat, h, q, k, v, weight, mixed, first, spread_1, h1, wide, second, spread_2, h2, h2 @ p[18] + p[19]

    def predict(self, params, x):
        return self._layers(params, x)[-1].reshape(x.shape)

    def gradient(self, params, x, rng=None):
        p, b, size = params, len(x), self.width // self.heads
        flat, h, q, k, v, weight, mixed, first, spread_1, h1, wide, second, spread_2, h2, out = self._layers(p, x)
        gap = out - flat
        g = gap * (2.0 / gap.size)
        grads = [None] * len(p)
        grads[18], grads[19] = h2.T @ g, g.sum(0)
        g = g @ p[18].T
        grads[16], grads[17] = (g * second).sum(0), g.sum(0)
        g = self._pull_scaled(g * p[16], second, spread_2)
        grads[14], grads[15] = wide.T @ g, g.sum(0)
        inner = g @ p[14].T
        inner *= wide > 0
        grads[12], grads[13] = h1.T @ inner, inner.sum(0)
        g = g + inner @ p[12].T
        grads[10], grads[11] = (g * first).sum(0), g.sum(0)
        g = self._pull_scaled(g * p[10], first, spread_1)
        grads[8], grads[9] = mixed.T @ g, g.sum(0)
        to_mixed = self._split(g @ p[8].T, b)
        to_weight = to_mixed @ _turned(v)
        to_weight -= _last_sum(to_weight * weight)
        to_weight *= weight
        to_weight *= 1.0 / math.sqrt(size)
        pulled = (to_weight @ k, _turned(to_weight) @ q, _turned(weight) @ to_mixed)
        for i, part in zip((2, 4, 6), pulled):
            part = self._unsplit(part, b)
            grads[i], grads[i + 1] = h.T @ part, part.sum(0)
            g = g + part @ p[i].T
        grads[0], grads[1] = flat.T @ g, g.sum(0)
        return float((gap * gap).mean()), grads


def _last_sum(x):
    """Sum over the last axis, which is short: as a product, many times faster than a reduction."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], dtype=x.dtype)).reshape(*x.shape[:-1], 1)


def _turned(x):
    """Matrices transposed, and laid out anew for fast products."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def flatten(params) -> np.ndarray:
    return np.concatenate([np.ravel(p) for p in params])


def unflatten(flat: np.ndarray, like) -> list[np.ndarray]:
    out, at = [], 0
    for p in like:
        out.append(flat[at : at + p.size].reshape(p.shape))
        at += p.size
    return out


def errors(net, params, x, step: int = 512) -> np.ndarray:
    """Mean squared reconstruction error per sample."""
    out = np.empty(len(x))
    for at in range(0, len(x), step):
        part = x[at : at + step].astype(params[0].dtype)
        gap = net.predict(params, part) - part
        out[at : at + step] = (gap**2).reshape(len(part), -1).mean(1)
    return out


class Adam:
    """Updates ``params``, which become views of one vector."""

    def __init__(self, params, rate: float):
        self.rate, self.t, self.flat = rate, 0, flatten(params)
        # the means of the gradient and of its square, 10 and 1000 times
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.move, self.work = np.empty_like(self.flat), {}
        params[:] = unflatten(self.flat, params)

    def step(self, net, params, x, rng) -> float:
        if hasattr(net, "flat_gradient"):
            loss, grad = net.flat_gradient(self.flat, x, rng, self.work)
        else:
            loss, grads = net.gradient(params, x, rng)
            grad = flatten(grads)
        self.t += 1
        self.m *= 0.9
        self.m += grad
        grad *= grad
        self.v *= 0.999
        self.v += grad
        spread = math.sqrt(0.001 / (1 - 0.999**self.t))
        np.sqrt(self.v, out=self.move)
        self.move += 1e-7 / spread
        np.divide(self.m, self.move, out=self.move)
        self.move *= 0.1 * self.rate / (1 - 0.9**self.t) / spread
        self.flat -= self.move
        return loss
