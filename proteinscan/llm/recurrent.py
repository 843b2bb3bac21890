"""A gated recurrent network over token ids in numpy, with a class-factored softmax at its output.

Ids below `shape.head` are words of their own, in classes of PER; every other id is a class of
rarer words. The network gives P(class | state) and, for words of their own, P(word | class,
state). Documents run side by side in lanes; a lane's state goes on from window to window, and is
zero where a document starts.
"""

from __future__ import annotations

import dataclasses

import numpy as np

#: Words in a class.
PER = 32
#: Steps of a window: gradients do not go further back. Lanes that run side by side.
WINDOW, LANES = 16, 512
RATE = 0.1
#: Bound of the weights and biases at the output, so that no exponential overflows.
LARGEST = 3.0


@dataclasses.dataclass(frozen=True)
class Shape:
    """Words of their own (a multiple of PER), classes of rarer words, and cells of the state."""

    head: int
    tail: int
    hidden: int

    @property
    def start(self) -> int:
        """The id that comes before a document's first token."""
        return self.head + self.tail

    @property
    def own_classes(self) -> int:
        return self.head // PER

    @property
    def classes(self) -> int:
        return self.own_classes + self.tail

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.head, ids // PER, ids - self.head + self.own_classes)


def initial(shape: Shape, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Weights before training: small ones, and output biases that give the frequencies `counts` of the ids."""
    rng, n = np.random.default_rng(7), shape.hidden
    own = counts[: shape.head].reshape(shape.own_classes, PER).astype(np.float64)
    mass = np.concatenate([own.sum(axis=1), counts[shape.head :] + 1.0])

    def logs(x: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(x, 1e-12) / np.maximum(total, 1.0)).clip(-30, 0).astype(np.float32)

    return {
        "inputs": rng.normal(0, 0.1, (shape.start + 1, 3 * n)).astype(np.float32), "state": rng.normal(0, 0.5 / n**0.5, (n, 3 * n)).astype(np.float32),
        "out": np.zeros((n, shape.classes), np.float32), "bias": logs(mass, mass.sum()),
        "words": np.zeros((shape.own_classes, n, PER), np.float32), "word_bias": logs(own, own.sum(axis=1, keepdims=True)),
    }


class Lanes:
    """Whole documents one after another in lanes, the longest first into the shortest lane.

    Lanes are sorted by length, so those that go on in a window are the first ones. `first` holds
    the id before each document.
    """

    def __init__(self, documents: list[np.ndarray], first: list[int], most: int = LANES):
        sizes = np.fromiter(map(len, documents), np.int64, len(documents))
        order = np.argsort(-sizes, kind="stable")
        lanes = max(1, min(most, len(documents)))
        lane, filled = np.empty(len(order), np.int64), np.zeros(lanes, np.int64)
        for at in range(0, len(order), lanes):  # the longest of a round goes to the shortest lane
            part = order[at : at + lanes]
            lane[part] = np.argsort(filled, kind="stable")[: len(part)]
            filled[lane[part]] += sizes[part]
        rank = np.empty(lanes, np.int64)
        rank[np.argsort(-filled, kind="stable")] = np.arange(lanes)
        placed = np.lexsort((np.arange(len(order)), rank[lane])) if len(order) else order
        self.lengths = -np.sort(-filled)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.ids = np.concatenate([documents[i] for i in placed]).astype(np.int32) if len(order) else np.empty(0, np.int32)
        begins = (np.cumsum(sizes[placed]) - sizes[placed])[sizes[placed] > 0]
        self.before = np.roll(self.ids, 1)
        self.before[begins] = np.asarray(first, np.int32)[placed][sizes[placed] > 0]
        self.document = np.repeat(placed, sizes[placed])
        self.keep = np.ones(len(self.ids), np.float32)
        self.keep[begins] = 0

    def windows(self, steps: int):
        """`before, ids, document, keep` by (step, lane) of successive windows; where a lane has ended, `document` is -1."""
        for at in range(0, int(self.lengths.max(initial=0)), steps):
            active = int(np.searchsorted(-self.lengths, -at, side="left"))
            count = min(steps, int(self.lengths[0]) - at)
            step = at + np.arange(count)[:, None]
            place = np.minimum(self.starts[:active] + step, len(self.ids) - 1)
            yield self.before[place], self.ids[place], np.where(step < self.lengths[:active], self.document[place], -1), self.keep[place]


class _Window:
    """States of a window and what the way back needs."""

    def __init__(self, model: dict, before: np.ndarray, keep: np.ndarray, state: np.ndarray):
        steps, lanes = before.shape
        n = state.shape[1]
        turn = np.where(np.arange(3 * n) < 2 * n, np.float32(-1), np.float32(1))  # gates take exp(-x)
        fed, across = np.take(model["inputs"] * turn, before, axis=0), model["state"] * turn
        self.states = np.empty((steps + 1, lanes, n), np.float32)
        self.held, self.new = (np.empty((steps, lanes, n), np.float32) for _ in range(2))
        #: What the state adds to the update and reset gates, which then are made in its place, and to the new values.
        self.inner, self.gates = np.empty((steps, lanes, 3 * n), np.float32), np.empty((steps, lanes, 2 * n), np.float32)
        self.states[0] = state
        for t in range(steps):
            held = np.multiply(self.states[t], keep[t][:, None], out=self.held[t])
            inner = np.matmul(held, across, out=self.inner[t])
            gates = np.add(inner[:, : 2 * n], fed[t, :, : 2 * n], out=self.gates[t])
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            new = np.multiply(gates[:, n:], inner[:, 2 * n :], out=self.new[t])
            new += fed[t, :, 2 * n :]
            np.tanh(new, out=new)
            after = np.subtract(held, new, out=self.states[t + 1])
            after *= gates[:, :n]
            after += new

    def back(self, model: dict, by_state: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients by the state weights and by what is fed in, from those by the states."""
        steps, lanes, n = self.held.shape
        held, new, z, r = self.held, self.new, self.gates[..., :n], self.gates[..., n:]
        by_new = (1 - z) * (1 - new * new)
        by_gates = np.concatenate([(held - new) * z * (1 - z), by_new * self.inner[..., 2 * n :] * r * (1 - r), by_new * r], axis=2)
        turned, carried = np.ascontiguousarray(model["state"].T), np.zeros((lanes, n), np.float32)
        back = np.empty((lanes, n), np.float32)
        for t in reversed(range(steps)):
            carried += by_state[t]
            by_new[t] *= carried
            through = by_gates[t].reshape(lanes, 3, n)
            through *= carried[:, None]
            carried *= z[t]
            carried += np.matmul(by_gates[t], turned, out=back)
            carried *= keep[t][:, None]
        by_weights = held.reshape(-1, n).T @ by_gates.reshape(-1, 3 * n)
        by_gates[..., 2 * n :] = by_new
        return by_weights, by_gates


def _outputs(model: dict, shape: Shape, states: np.ndarray, ids: np.ndarray, weight: np.ndarray | None, grads: dict | None):
    """Natural log probability of each id, and with `grads` the gradient of the weighted sum by state.

    Rows are taken in the order of their classes, so that those of a class lie together.
    """
    kind = shape.class_of(ids)
    order = np.argsort(kind.astype(np.uint16), kind="stable")
    ends = np.searchsorted(kind[order], np.arange(shape.own_classes + 1))
    states, ids, kind = states[order], ids[order], kind[order]
    rows = np.arange(len(ids))
    slots = ids[: ends[-1]] % PER
    scores = states @ model["out"]
    scores += model["bias"]
    logs = scores[rows, kind]
    np.exp(scores, out=scores)
    total = scores @ np.ones(scores.shape[1], np.float32)
    logs -= np.log(total)
    back = None
    if grads is not None:
        weight = weight[order]
        scores *= (-weight / total)[:, None]
        scores[rows, kind] += weight
        grads["out"], grads["bias"] = states.T @ scores, np.ones(len(ids), np.float32) @ scores
        back = scores @ model["out"].T
        grads["words"], grads["word_bias"] = np.zeros_like(model["words"]), np.zeros_like(model["word_bias"])
    words = np.empty((ends[-1], PER), np.float32)
    met = [(k, slice(ends[k], ends[k + 1])) for k in np.flatnonzero(np.diff(ends)).tolist()]
    for k, own in met:
        np.matmul(states[own], model["words"][k], out=words[own])
        words[own] += model["word_bias"][k]
    rows = rows[: ends[-1]]
    picked = words[rows, slots]
    np.exp(words, out=words)
    sums = words @ np.ones(PER, np.float32)
    logs[: ends[-1]] += picked - np.log(sums)
    if grads is not None:
        w = weight[: ends[-1]]
        words *= (-w / sums)[:, None]
        words[rows, slots] += w
        for k, own in met:
            np.matmul(states[own].T, words[own], out=grads["words"][k])
            words[own].sum(axis=0, out=grads["word_bias"][k])
            back[own] += words[own] @ model["words"][k].T
        in_order, back = back, np.empty_like(back)
        back[order] = in_order
    out = np.empty_like(logs)
    out[order] = logs
    return out, back


def log_likelihoods(model: dict, shape: Shape, documents: list[np.ndarray], window: int = 2 * WINDOW) -> np.ndarray:
    """Log probability, to base 10, of each document's ids."""
    out = np.zeros(len(documents))
    state = np.zeros((LANES, shape.hidden), np.float32)
    for before, ids, document, keep in Lanes(documents, [shape.start] * len(documents)).windows(window):
        run = _Window(model, before, keep, state[: ids.shape[1]])
        logs, _ = _outputs(model, shape, run.states[1:].reshape(-1, shape.hidden), ids.ravel(), None, None)
        known = document.ravel() >= 0
        out += np.bincount(document.ravel()[known], weights=logs[known], minlength=len(out))
        state = run.states[-1]
    return out / np.log(10)


class Trainer:
    """Truncated backpropagation with steps that shrink as gradients add up, from given weights."""

    def __init__(self, shape: Shape, model: dict[str, np.ndarray], sums: dict[str, np.ndarray] | None = None, rate: float = RATE):
        self.shape, self.rate, self.tokens = shape, rate, 0
        self.model = {k: v.copy() for k, v in model.items()}
        self.sums = {k: (v.copy() if sums is None else sums[k].copy()) for k, v in ({k: np.full_like(v, 1e-6) for k, v in model.items()}).items()}

    def fit(self, documents: list[np.ndarray], first: list[int], lanes: int = LANES, window: int = WINDOW) -> None:
        """One run over the documents, or parts of them, that have the ids `first` before them; a step for each window of `lanes`."""
        state = np.zeros((LANES, self.shape.hidden), np.float32)
        for before, ids, document, keep in Lanes(documents, first, lanes).windows(window):
            state = self._step(before, ids, (document >= 0).ravel(), keep, state[: ids.shape[1]])

    def _step(self, before: np.ndarray, ids: np.ndarray, known: np.ndarray, keep: np.ndarray, state: np.ndarray) -> np.ndarray:
        model, n = self.model, self.shape.hidden
        count = int(known.sum())
        run = _Window(model, before, keep, state)
        grads: dict[str, np.ndarray] = {}
        _, back = _outputs(model, self.shape, run.states[1:].reshape(-1, n), ids.ravel(), known.astype(np.float32) / np.float32(max(1, count)), grads)
        grads["state"], fed = run.back(model, back.reshape(*ids.shape, n), keep)
        for name, grad in grads.items():
            self._move(name, slice(None), grad)
        order = np.argsort(before.ravel().astype(np.uint16), kind="stable")
        met = before.ravel()[order]
        starts = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]]))
        self._move("inputs", met[starts], np.add.reduceat(fed.reshape(-1, 3 * n)[order], starts, axis=0))
        self.tokens += count
        return run.states[-1]

    def _move(self, name: str, rows, grad: np.ndarray) -> None:
        self.sums[name][rows] += grad * grad
        self.model[name][rows] += self.rate * grad / np.sqrt(self.sums[name][rows])
        if name in ("out", "words"):
            np.clip(self.model[name], -LARGEST, LARGEST, out=self.model[name])
