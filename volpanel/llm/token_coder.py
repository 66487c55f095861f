"""Adaptive context-mixing range coder for blocks of symbols.

Every block starts from a fresh model and is decoded alone. For each symbol the order-2 and the order-1 context name
the symbol they expect, with a trust. A binary decision tells whether the more trusted of the two is right; its
probability is a logistic mix of what the trust of either context and the block's overall hit rate (order 0) predict.
Hits are tallied per cell, which is the trust of both contexts and whether they agree; at fixed places of a block rates,
weights and probabilities of all cells learn from the tallies. What is missed is coded by order 0 alone: by the counts of all
symbols where these are given with the blocks, else with all symbols alike. All arithmetic is on whole numbers, so a
block decodes alike on every machine.

Many blocks are coded side by side, one per array lane, so the work per symbol is spread over whole-array operations.
"""

from __future__ import annotations

import numpy as np

BLOCK = 2048
LANES = 2048
#: The range stays between these; 16 bits leave at a time. A decision takes 12 bits of it, a count up to 32.
_TOP, _BOTTOM = 60, 44
_ONE = 4096
_CELLS = (4, 4, 2)  # trust of order 2, of order 1, whether they agree
_EARLY, _ROUND = (16, 64, 256), 512
#: Rates that a cell starts from, by trust, and the number of symbols they stand for.
_START, _WEIGHT = np.array([40, 1024, 2560, 3584]), 4

def _squash_table() -> np.ndarray:
    """Probability (of 4096) by logit * 256 + 2048, from whole-number knots."""
    # 4096 / (1 + exp(-x / 256)) at x = -2048, -1920, ..., 2048.
    knots = [1, 2, 4, 6, 10, 16, 27, 45, 74, 120, 194, 311, 488, 747, 1102, 1546, 2048]
    knots += [4096 - k for k in knots[-2::-1]]
    x = np.arange(4096)
    at, part = x // 128, x % 128
    table = np.asarray(knots)
    return np.clip((table[at] * (128 - part) + table[at + 1] * part) // 128, 1, _ONE - 1)


_SQUASH = _squash_table()
#: Logit by probability (of 4096): the first logit whose probability reaches it.
_STRETCH = np.minimum(np.searchsorted(_SQUASH, np.arange(_ONE)), 4095) - 2048


class _Order0:
    """Places of symbols on a line of ``total``: as wide as their counts, or all alike."""

    def __init__(self, counts: np.ndarray | None, levels: int):
        self.counts = None if counts is None else counts.astype(np.int64)
        self.total = 16**levels if counts is None else int(counts.sum())
        if counts is not None:
            # Place and width go together, as they are looked up together.
            self.places = (np.cumsum(self.counts) - self.counts) << 31 | self.counts
            self.symbols = np.repeat(np.arange(len(counts), dtype=np.int32), self.counts)

    def place(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray | int]:
        if self.counts is None:
            return symbols, 1
        found = self.places.take(symbols)
        return found >> 31, found & 0x7FFFFFFF

    def at(self, spot: np.ndarray) -> np.ndarray:
        return spot if self.counts is None else self.symbols.take(spot)


class _Coder:
    """Ranges of all lanes. Hits take the lower part, and what is left goes to the lanes that missed."""

    range: np.ndarray

    def _share(self, n: int, p: np.ndarray) -> None:
        whole = self.range[:n]
        self.bound = (whole >> 12) * p
        self.rest = whole - self.bound
        self.range[:n] = self.bound


class _Writer(_Coder):
    """Range coder, one lane per block. Words may exceed 16 bits until their carries are settled at the end."""

    def __init__(self, lanes: int, block: int):
        self.low = np.zeros(lanes, dtype=np.int64)
        self.range = np.full(lanes, 1 << _TOP, dtype=np.int64)
        self.at = np.zeros(lanes, dtype=np.int64)
        self.lanes = lanes
        self.out = np.zeros((3 * block + 2) * lanes, dtype=np.uint32)

    def decide(self, n: int, p: np.ndarray, guess: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        self._share(n, p)
        return ids == guess

    def literal(self, missed: np.ndarray, order0: _Order0, ids: np.ndarray | None) -> np.ndarray:
        symbols = ids.take(missed)
        start, width = order0.place(symbols)
        unit = self.rest.take(missed) // order0.total
        self.low[missed] = self.low.take(missed) + self.bound.take(missed) + unit * start
        self.range[missed] = unit * width
        return symbols

    def _emit(self, lanes: np.ndarray, words: np.ndarray) -> None:
        at = self.at.take(lanes)
        self.out[at * self.lanes + lanes] = words
        self.at[lanes] = at + 1

    def renew(self, n: int) -> None:
        lanes = (self.range[:n] < 1 << _BOTTOM).nonzero()[0]
        while len(lanes):
            low, wide = self.low.take(lanes), self.range.take(lanes) << 16
            self._emit(lanes, low >> _BOTTOM)
            self.low[lanes] = (low & ((1 << _BOTTOM) - 1)) << 16
            self.range[lanes] = wide
            lanes = lanes[wide < 1 << _BOTTOM]

    def close(self) -> list[bytes]:
        # One more word names a number inside the range; zeros may follow it.
        self._emit(np.arange(self.lanes), (self.low + ((1 << _BOTTOM) - 1)) >> _BOTTOM)
        words = self.out.reshape(-1, self.lanes)[: int(self.at.max())]
        for row in range(len(words) - 1, 0, -1):
            words[row - 1] += words[row] >> np.uint32(16)
        rows = np.ascontiguousarray(words.T.astype(">u2"))
        return [rows[i, :n].tobytes() for i, n in enumerate(self.at.tolist())]


class _Reader(_Coder):
    """The same ranges, with the distance of the coded number from their lower end."""

    def __init__(self, payloads: list[bytes]):
        self.lanes = len(payloads)
        words = np.zeros((self.lanes, max(map(len, payloads)) // 2 + 8), dtype=np.int64)
        for i, payload in enumerate(payloads):
            words[i, : len(payload) // 2] = np.frombuffer(payload, dtype=">u2", count=len(payload) // 2)
        # The first 60 bits are the number's start, and 16 bits follow at a time.
        self.code = words[:, 0] << 44 | words[:, 1] << 28 | words[:, 2] << 12 | words[:, 3] >> 4
        following = (words[:, 3:-1] << 12 | words[:, 4:] >> 4) & 0xFFFF
        self.rows = following.shape[1]
        self.words = following.astype(np.uint16).T.reshape(-1)
        self.range = np.full(self.lanes, 1 << _TOP, dtype=np.int64)
        self.at = np.zeros(self.lanes, dtype=np.int64)

    def decide(self, n: int, p: np.ndarray, guess: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        self._share(n, p)
        return self.code[:n] < self.bound

    def literal(self, missed: np.ndarray, order0: _Order0, ids: np.ndarray | None) -> np.ndarray:
        unit, code = self.rest.take(missed) // order0.total, self.code.take(missed) - self.bound.take(missed)
        symbols = order0.at(np.minimum(code // unit, order0.total - 1))
        start, width = order0.place(symbols)
        self.code[missed] = code - unit * start
        self.range[missed] = unit * width
        return symbols

    def renew(self, n: int) -> None:
        lanes = (self.range[:n] < 1 << _BOTTOM).nonzero()[0]
        while len(lanes):
            at, wide = self.at.take(lanes), self.range.take(lanes) << 16
            # Only damaged payloads ask for more words than there are.
            word = self.words.take(np.minimum(at, self.rows - 1) * self.lanes + lanes)
            self.code[lanes] = self.code.take(lanes) << 16 | word
            self.at[lanes] = at + 1
            self.range[lanes] = wide
            lanes = lanes[wide < 1 << _BOTTOM]


class _Cells:
    """Probability that the guess is right, by lane and cell, and what it is learned from."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.tally = np.zeros((lanes, *_CELLS, 2), dtype=np.int64)
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []
        more = np.arange(4)[:, None] >= np.arange(4)[None, :]
        #: Which of the four sets of weights a cell uses: whose guess is taken, and whether they agree.
        self.set = (more[:, :, None] * 2 + np.arange(2)).reshape(-1)
        self.weights = np.repeat(np.array([1 << 15, 1 << 15, 1 << 13])[:, None], lanes * 4, axis=1).reshape(3, lanes, 4)
        self._predict()

    def _rate(self, axes: tuple[int, ...], start: np.ndarray | int) -> np.ndarray:
        misses, hits = (self.tally[..., i].sum(axis=axes, keepdims=True) for i in (0, 1))
        return np.clip((hits * _ONE + _WEIGHT * start) // (hits + misses + _WEIGHT), 1, _ONE - 1)

    def _predict(self) -> None:
        by_trust = _START[:, None]
        rates = [self._rate((2,), by_trust[None, :, None]), self._rate((1,), by_trust[None, None]), self._rate((1, 2, 3), 1024)]
        shape = (self.lanes, *_CELLS)
        self.logits = [np.broadcast_to(_STRETCH[r], shape).reshape(self.lanes, -1) for r in rates]
        logit = sum(w[:, self.set] * s >> 16 for w, s in zip(self.weights, self.logits))
        self.p = _SQUASH[np.clip(logit, -2048, 2047) + 2048].reshape(-1)

    def learn(self) -> None:
        """Follow what was seen since the last time."""
        cells, hits = (np.concatenate(part) for part in zip(*self.seen))
        found = np.bincount(cells << 1 | hits, minlength=self.tally.size).reshape(self.tally.shape)
        self.seen = []
        self.tally += found
        misses, hits = (found[..., i].reshape(self.lanes, -1) for i in (0, 1))
        error = hits * (_ONE - 1) - (hits + misses) * self.p.reshape(self.lanes, -1)
        for w, s in zip(self.weights, self.logits):
            for k in range(4):
                cells = self.set == k
                step = (s[:, cells] * error[:, cells]).sum(axis=1) >> 9
                w[:, k] = np.clip(w[:, k] + np.clip(step, -(1 << 14), 1 << 14), -(1 << 18), 1 << 18)
        self._predict()


def _run(
    coder: _Writer | _Reader, sizes: np.ndarray, block: int, levels: int, order0: _Order0, ids: np.ndarray | None
) -> np.ndarray:
    """Code or decode all lanes, position by position; all but the last lane are of the first one's size."""
    count = len(sizes)
    bits = max(6, (block - 1).bit_length())
    down = np.uint32(32 - bits)
    # Most work is in these arrays, so they are as narrow as the symbols allow.
    kind = np.int32 if levels < 8 else np.int64
    # What a context expects, times 4, plus its trust; for the contexts of order 2 and then those of order 1.
    table = np.zeros(2 * count << bits, dtype=kind)
    base = (np.arange(2 * count) << bits).reshape(2, count)
    cells, first_cell = _Cells(count), (np.arange(count) * 32).astype(np.int32)
    out = np.zeros((block, count), dtype=kind)
    last, keys = np.zeros(count, dtype=np.uint32), np.zeros((2, count), dtype=np.uint32)
    mul2, mul1, three = np.uint32(0x85EBCA77), np.uint32(0x9E3779B1), kind(3)
    for position in range(int(sizes[0])):
        n = count if position < sizes[-1] else count - 1
        now = None if ids is None else ids[position, :n]
        np.multiply(last, mul2, out=keys[0])
        keys[0] ^= keys[1] >> 3
        np.multiply(last, mul1, out=keys[1])
        slots = base[:, :n] + (keys[:, :n] >> down)
        entry = table.take(slots)
        trust, expected = entry & three, entry >> 2
        agree = expected[0] == expected[1]
        guess = np.where(trust[0] >= trust[1], expected[0], expected[1])
        cell = first_cell[:n] + ((trust[0] << 2 | trust[1]) << 1)
        cell += agree
        hit = coder.decide(n, cells.p.take(cell), guess, now)
        found, missed = guess, (~hit).nonzero()[0]
        if len(missed):
            found[missed] = coder.literal(missed, order0, now)
        coder.renew(n)
        cells.seen.append((cell, hit))
        # A right context gains trust, a wrong one falls to the least; without trust to lose it expects what came.
        right = expected == found
        expected = np.where(right | (trust > 1), expected, found)
        trust += 1
        table[slots] = expected << 2 | np.minimum(trust, right.astype(kind) << 1 | 1)
        out[position, :n] = found
        last = out[position].astype(np.uint32)
        if position + 1 in _EARLY or (position + 1) % _ROUND == 0:
            cells.learn()
    return out


def block_size(n: int) -> int:
    """Symbols per block for ``n`` of them: the full size for much data, less where too few lanes would be busy."""
    return min(BLOCK, max(256, 1 << max(0, (n // 256).bit_length() - 1)))


def levels_for(top: int) -> int:
    """Half-bytes of the largest symbol."""
    return max(1, (int(top).bit_length() + 3) // 4)


def encode(ids: np.ndarray, block: int, levels: int, counts: np.ndarray | None = None) -> list[bytes]:
    """Payloads of consecutive blocks of ``ids``; ``counts`` by symbol must reach the reader too."""
    payloads: list[bytes] = []
    order0 = _Order0(counts, levels)
    for at in range(0, len(ids), block * LANES):
        part = ids[at : at + block * LANES]
        lanes = -(-len(part) // block)
        square = np.zeros(lanes * block, dtype=np.int32 if levels < 8 else np.int64)
        square[: len(part)] = part
        sizes = np.full(lanes, block)
        sizes[-1] = len(part) - (lanes - 1) * block
        writer = _Writer(lanes, block)
        _run(writer, sizes, block, levels, order0, np.ascontiguousarray(square.reshape(lanes, block).T))
        payloads += writer.close()
    return payloads


def decode(payloads: list[bytes], n: int, block: int, levels: int, counts: np.ndarray | None = None) -> np.ndarray:
    """The ``n`` ids of consecutive blocks."""
    out = []
    order0 = _Order0(counts, levels)
    for at in range(0, len(payloads), LANES):
        part = payloads[at : at + LANES]
        sizes = np.full(len(part), block)
        left = n - at * block
        sizes[-1] = min(block, left - (len(part) - 1) * block)
        found = _run(_Reader(part), sizes, block, levels, order0, None)
        out.append(found.T.reshape(-1)[: min(left, len(part) * block)])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
