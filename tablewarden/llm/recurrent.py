"""A gated recurrent language model with a class-factored softmax, in numpy.

The probability of a word is that of its class times that of the word within the class. Classes are runs
of words by falling frequency with about equal sums of root frequencies, so frequent words are in small
classes. Texts are laid end to end in lanes that step together; a lane's state is set to zero where a text
begins and otherwise carried on, from window to window, to the text's end.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

WIDTH = 16
CLASSES = 64
STEPS = 32  # back-propagation is cut after so many
# The more words are trained on, the more lanes they are laid into, so that a lane has about so many.
TRAIN_LANES, MOST_LANES, TOKENS_PER_LANE = 32, 512, 2048
# In training, though not in scoring, the state begins anew after so many words of a text, so that lanes are of a length.
SEGMENT = 2048
SCORE_LANES, SCORE_STEPS = 1024, 16
# Rows of logits that are worked on at a time: few enough to stay in a core's cache from one step to the next.
ROWS_AT_ONCE = 2048


def class_starts(counts: np.ndarray, alone: int, classes: int = CLASSES) -> np.ndarray:
    """First word of each class: the first `alone` words have one each, the others, by falling count, share the rest."""
    mass = np.cumsum(np.sqrt(counts[alone:] + 1.0))
    if not len(mass):
        return np.arange(alone)
    bins = np.minimum((mass - 1e-9) / mass[-1] * classes, classes - 1).astype(int)
    return np.concatenate((np.arange(alone), alone + np.flatnonzero(np.diff(bins, prepend=-1))))


def _exponentials(logits: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray | float]:
    """Exponentials of each row, in place, up to a factor of the row, with their sums and the factors' logarithms.

    `plain` rows, whose exponentials are all far from the ends of the number range, need no factor.
    """
    top: np.ndarray | float = 0.0
    if not plain:
        top = logits.max(axis=1)
        logits -= top[:, None]
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], logits.dtype), top


class Lanes:
    """Texts laid end to end in lanes, long texts first and each into the shortest lane; lanes come by falling length.

    All lanes are one array with the place where each begins, so that one very long text makes no other lane longer.
    """

    def __init__(self, texts: list[np.ndarray], count: int, start: int):
        count = max(1, min(count, len(texts)))
        free = [(0, lane) for lane in range(count)]
        own: list[list[int]] = [[] for _ in range(count)]
        for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
            used, lane = heapq.heappop(free)
            own[lane].append(i)
            heapq.heappush(free, (used + len(texts[i]), lane))
        order = sorted(free, key=lambda x: (-x[0], x[1]))
        texts_in_order = [i for _, lane in order for i in own[lane]]
        sizes = np.array([len(texts[i]) for i in texts_in_order])
        self.start, self.lengths = start, np.array([used for used, _ in order])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.target = np.concatenate([texts[i] for i in texts_in_order]).astype(np.int32, copy=False)
        self.text = np.repeat(np.array(texts_in_order, np.int32), sizes)
        self.first = np.zeros(len(self.target), bool)
        self.first[np.cumsum(sizes) - sizes] = True

    def windows(self, steps: int, cells: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
        """By step and live lane: input, target, first (a text begins), there (not past the lane's end) and text.

        A window has so many steps, or more where few lanes are live, as long as it has no more than `cells` cells.
        """
        at = 0
        while at < self.lengths[0]:
            live = int(np.searchsorted(-self.lengths, -at))
            end = min(at + max(steps, cells // live), int(self.lengths[0]))
            step = np.arange(at, end)[:, None]
            there = step < self.lengths[:live]
            place = np.where(there, self.begins[:live] + step, self.begins[:live])
            target, first = self.target[place], self.first[place] & there
            yield np.where(first, self.start, self.target[np.maximum(place - 1, 0)]), target, first, there, self.text[place]
            at = end


class LanguageModel:
    """`counts`: how often each word occurs; words are numbered by falling count after `alone` special ones."""

    def __init__(self, counts: np.ndarray, alone: int, start: int, width: int = WIDTH, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.start, self.width = start, width
        self.moments: dict[str, tuple[np.ndarray, np.ndarray]] | None = None
        self.updates = 0
        self.starts = class_starts(counts, alone)
        self.ends = np.append(self.starts[1:], len(counts))
        self.class_of = (np.searchsorted(self.starts, np.arange(len(counts)), "right") - 1).astype(np.int16)
        self.several = self.ends - self.starts > 1
        per_class = np.add.reduceat(counts + 1.0, self.starts)
        small = lambda *shape: draw.normal(0, 0.1, shape).astype(np.float32)
        self.p = {
            "embed": small(len(counts), width),
            "enter": small(width, 3 * width) * 3,
            "enter_bias": np.zeros(3 * width, np.float32),
            "carry": small(width, 3 * width) * 3,
            # Before any training the model gives each word its share of the counts.
            "class": np.zeros((width, len(self.starts)), np.float32),
            "class_bias": np.log(per_class / per_class.sum()).astype(np.float32),
            "word": np.zeros((len(counts), width), np.float32),
            "word_bias": np.log((counts + 1.0) / per_class[self.class_of]).astype(np.float32),
        }

    def weights(self) -> np.ndarray:
        """All weights, end to end."""
        return np.concatenate([v.ravel() for v in self.p.values()])

    def set_weights(self, weights: np.ndarray) -> None:
        ends = np.cumsum([v.size for v in self.p.values()])[:-1]
        self.p = {k: own.reshape(v.shape).copy() for (k, v), own in zip(self.p.items(), np.split(weights, ends))}

    def _entering(self) -> np.ndarray:
        """What each word adds to the update gate, the reset gate and the new value, as three tables."""
        own = self.p["embed"] @ self.p["enter"] + self.p["enter_bias"]
        return np.ascontiguousarray(own.reshape(-1, 3, self.width).transpose(1, 0, 2))

    def _run(self, entering: np.ndarray, inputs: np.ndarray, first: np.ndarray, h: np.ndarray, kept: bool) -> tuple[np.ndarray, ...]:
        """The states after each step, from state h on; where `kept`, also those before, the gates with what is carried, and the new values."""
        (steps, count), w, kind = inputs.shape, self.width, entering.dtype
        entered = entering.take(inputs, axis=1)
        carry = np.ascontiguousarray(self.p["carry"].reshape(w, 3, w).transpose(1, 0, 2))
        states = np.empty((steps, count, w), kind)
        slots = steps if kept else 1  # else each step overwrites the one before
        before, gates, new = np.empty((slots, count, w), kind), np.empty((slots, 3, count, w), kind), np.empty((slots, count, w), kind)
        begins = first.any(axis=1)
        for t in range(steps):
            if begins[t]:
                h = np.where(first[t][:, None], kind.type(0), h)
            slot = t if kept else 0
            both, z, n, after = gates[slot, :2], gates[slot, 0], new[slot], states[t]
            if kept:
                before[t] = h
            np.matmul(h, carry, out=gates[slot])
            # Both gates are 1 / (1 + exp(-x)), by way of tanh.
            both += entered[:2, t]
            both *= 0.5
            np.tanh(both, out=both)
            both *= 0.5
            both += 0.5
            np.multiply(gates[slot, 1], gates[slot, 2], out=n)
            n += entered[2, t]
            np.tanh(n, out=n)
            np.subtract(h, n, out=after)
            after *= z
            after += n
            h = after
        return states, before, gates, new

    def _plain(self) -> bool:
        """Whether no logit can be far from zero: states are between -1 and 1, so weights bound them."""
        of_class = np.abs(self.p["class"]).sum(axis=0) + np.abs(self.p["class_bias"])
        of_word = np.abs(self.p["word"]).sum(axis=1) + np.abs(self.p["word_bias"])
        return max(of_class.max(), of_word.max()) < 60

    def _by_class(self, kind: np.ndarray, some: np.ndarray | bool = True) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """`some` rows with a target in a class of more than one word, class by class, and (class, from, to) for their places."""
        rows = np.flatnonzero(self.several[kind] & some)
        own = kind[rows]
        ends = np.cumsum(np.bincount(own, minlength=len(self.starts))).tolist()
        return rows[np.argsort(own, kind="stable")], [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]

    def _losses(self, h: np.ndarray, target: np.ndarray, plain: bool) -> np.ndarray:
        """Negative natural logarithm of each target's probability after state h."""

        def of(logits: np.ndarray, bias: np.ndarray, chosen: np.ndarray) -> np.ndarray:
            logits += bias
            own = logits[np.arange(len(logits)), chosen]
            sums, top = _exponentials(logits, plain)
            return np.log(sums) + top - own

        p, kind = self.p, self.class_of[target]
        loss = np.empty(len(h), h.dtype)
        for at in range(0, len(h), ROWS_AT_ONCE):
            rows = slice(at, at + ROWS_AT_ONCE)
            loss[rows] = of(h[rows] @ p["class"], p["class_bias"], kind[rows])
        rows, parts = self._by_class(kind)
        here, word, within = h.take(rows, axis=0), target[rows], np.empty(len(rows), h.dtype)
        for c, a, b in parts:
            own = slice(self.starts[c], self.ends[c])
            within[a:b] = of(here[a:b] @ p["word"][own].T, p["word_bias"][own], word[a:b] - own.start)
        loss[rows] += within
        return loss

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of each whole text (an array of word numbers, its end included)."""
        total = np.zeros(len(texts))
        if not texts:
            return total
        entering, plain = self._entering(), self._plain()
        h = np.zeros((SCORE_LANES, self.width), entering.dtype)
        for inputs, target, first, there, text in Lanes(texts, SCORE_LANES, self.start).windows(SCORE_STEPS, SCORE_LANES * SCORE_STEPS):
            states = self._run(entering, inputs, first, h[: inputs.shape[1]], kept=False)[0]
            h = states[-1]
            live = slice(None) if there.all() else there.ravel()
            loss = self._losses(states.reshape(-1, self.width)[live], target.ravel()[live], plain)
            total -= np.bincount(text.ravel()[live], weights=loss, minlength=len(texts))
        return total / np.log(10)

    def train(self, texts: list[np.ndarray], rounds: int = 1, rate: float = 0.01, last: float = 0.001) -> None:
        """Truncated back-propagation through time with Adam steps, whose rate falls evenly to `last`.

        The optimizer's moments stay with the model, so texts may come in several calls.
        """
        if not texts:
            return
        if self.moments is None:
            self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        pieces = [text[at : at + SEGMENT] for text in texts for at in range(0, len(text), SEGMENT)]
        count = min(max(sum(map(len, texts)) // TOKENS_PER_LANE, TRAIN_LANES), MOST_LANES)
        laid = Lanes(pieces, count, self.start)
        steps, done = rounds * -(-int(laid.lengths[0]) // STEPS), 0
        for _ in range(rounds):
            h = np.zeros((len(laid.lengths), self.width), np.float32)
            for inputs, target, first, there, _ in laid.windows(STEPS):
                h, slopes = self._slopes(inputs, target, first, there, h[: inputs.shape[1]])
                self.updates += 1
                done += 1
                now = rate - (rate - last) * done / steps
                for name, slope in slopes.items():
                    m, v = self.moments[name]
                    m += np.float32(0.1) * (slope - m)
                    slope *= slope
                    v += np.float32(0.01) * (slope - v)
                    root = np.sqrt(v / np.float32(1 - 0.99**self.updates))
                    root += np.float32(1e-6)
                    self.p[name] -= np.float32(now / (1 - 0.9**self.updates)) * m / root

    def _slopes(self, inputs, target, first, there, h) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        p, w, kind = self.p, self.width, self.p["embed"].dtype
        steps, count = inputs.shape
        after, before, gates, new = self._run(self._entering(), inputs, first, h, kept=True)
        begins = first.any(axis=1)
        states = after.reshape(-1, w)
        flat, live = target.ravel(), there.ravel()
        scale = np.float32(1.0 / max(int(live.sum()), 1))
        out = {k: np.zeros_like(v) for k, v in p.items()}
        plain, of_class, share = self._plain(), self.class_of[flat], live * scale
        d, to_state = np.empty((len(states), len(self.starts)), kind), np.empty_like(states)
        for at in range(0, len(states), ROWS_AT_ONCE):
            rows = slice(at, at + ROWS_AT_ONCE)
            own = np.matmul(states[rows], p["class"], out=d[rows])
            own += p["class_bias"]
            sums, _ = _exponentials(own, plain)
            own *= (share[rows] / sums)[:, None].astype(kind)
            own[np.arange(len(own)), of_class[rows]] -= share[rows]
            np.matmul(own, p["class"].T, out=to_state[rows])
        out["class"], out["class_bias"] = states.T @ d, np.einsum("ij->j", d)
        rows, parts = self._by_class(of_class, live)
        here, word, more = states.take(rows, axis=0), flat[rows], np.empty((len(rows), w), kind)
        for c, a, b in parts:
            own = slice(self.starts[c], self.ends[c])
            d = here[a:b] @ p["word"][own].T
            d += p["word_bias"][own]
            sums, _ = _exponentials(d, plain)
            d *= (scale / sums)[:, None]
            d[np.arange(b - a), word[a:b] - own.start] -= scale
            out["word"][own], out["word_bias"][own] = d.T @ here[a:b], d.sum(axis=0)
            np.matmul(d, p["word"][own], out=more[a:b])
        to_state[rows] += more
        to_state = to_state.reshape(steps, count, w)
        # Slopes at the gates, of what enters and of what is carried.
        entered, carry = np.empty((2, steps, count, 3 * w), kind)
        back, over = np.zeros((count, w), kind), p["carry"].T.copy()
        for t in reversed(range(steps)):
            dh, n, (z, r, carried) = to_state[t], new[t], gates[t]
            dh += back
            dn, dz, dr = (1 - z), before[t] - n, carried * r
            dz *= z
            dz *= dn
            dz *= dh
            dn *= 1 - n * n
            dn *= dh
            dr *= 1 - r
            dr *= dn
            carry[t, :, :w], carry[t, :, w : 2 * w] = dz, dr
            entered[t, :, : 2 * w] = carry[t, :, : 2 * w]
            entered[t, :, 2 * w :] = dn
            dn *= r
            carry[t, :, 2 * w :] = dn
            back = carry[t] @ over
            dh *= z
            back += dh
            if begins[t]:
                back[first[t]] = 0
        entered, carry = entered.reshape(-1, 3 * w), carry.reshape(-1, 3 * w)
        x = p["embed"].take(inputs.ravel(), axis=0)
        # The longer matrix goes first, which takes half the time.
        out["enter"], out["enter_bias"], out["carry"] = (entered.T @ x).T, np.einsum("ij->j", entered), (carry.T @ before.reshape(-1, w)).T
        words = inputs.ravel().astype(np.min_scalar_type(len(p["embed"])))
        order, often = np.argsort(words, kind="stable"), np.bincount(words)
        present = np.flatnonzero(often)
        out["embed"][present] = np.add.reduceat((entered @ p["enter"].T).take(order, axis=0), (np.cumsum(often) - often)[present])
        return after[-1].copy(), out
