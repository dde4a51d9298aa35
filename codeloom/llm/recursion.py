"""Exact forward and backward recursions over long symbol sequences, in blocks side by side.

A sequence is cut into blocks of ``BLOCK`` symbols.  The product of a block's step matrices says how it turns
what is known before it into what is known after it, so a short walk over the products
gives every block its exact state before the first and after the last symbol.  Then all blocks
run side by side, and the numbers are those of a recursion over the whole sequence.  Blocks are
taken ``GROUP`` at a time, so memory doesn't grow with the length of a sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK, GROUP = 256, 2048
# Steps between two scalings; emissions are scaled to a largest share of one, so numbers stay far above underflow.
SCALED = 4


@dataclass
class Parameters:
    start: np.ndarray
    usual: np.ndarray  # shares of the states over all symbols; the recursions do not use them
    moves: np.ndarray
    emit: np.ndarray  # symbols x states


def _running(length: np.ndarray) -> list[int]:
    """How many of the blocks, longest first, have a symbol at each step."""
    return np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left").tolist()


def _totals(x: np.ndarray) -> np.ndarray:
    """The sum of each row, in every column: a product with ones keeps the loops long."""
    return x @ np.ones((x.shape[1], x.shape[1]), x.dtype)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / _totals(x)


@dataclass
class Blocks:
    """Blocks of sequences, by sequence; ``nth`` counts a sequence's blocks from 0."""

    flat: np.ndarray
    text: np.ndarray
    nth: np.ndarray
    begin: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray, starts: np.ndarray, size: int = BLOCK) -> Blocks:
        whole = np.diff(starts)
        count = -(-whole // size)
        text = np.repeat(np.arange(len(whole)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        return cls(flat, text, nth, starts[:-1][text] + nth * size, np.minimum(size, whole[text] - nth * size))

    def borders(self, start: np.ndarray, moves: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every block the states' shares after the block before it, and their likelihood of all that follows it."""
        n, k = len(self.text), len(start)
        before, after = np.zeros((n, k), emit.dtype), np.ones((n, k), emit.dtype)
        later = np.flatnonzero(self.nth > 0)
        if not len(later):
            return before, after
        products = np.empty((n, k, k), emit.dtype)
        wide = np.tile(emit, (1, k))
        for group in range(0, len(later), GROUP):
            rows = later[group:group + GROUP]
            rows = rows[np.argsort(-self.length[rows], kind="stable")]
            begin = self.begin[rows]
            x = np.tile(np.eye(k, dtype=emit.dtype), (len(rows), 1, 1))
            for t, m in enumerate(_running(self.length[rows])):
                step = (x[:m].reshape(-1, k) @ moves).reshape(m, k * k)
                step *= wide.take(self.flat.take(begin[:m] + t), axis=0)
                if t % SCALED == SCALED - 1:
                    step /= step.sum(axis=1, keepdims=True)
                x[:m] = step.reshape(m, k, k)
            products[rows] = x / x.sum(axis=(1, 2), keepdims=True)
        # The first block of a longer sequence is a whole one.
        first = later[self.nth[later] == 1] - 1
        alpha = np.broadcast_to(start, (len(first), k))
        for t in range(int(self.length[first[0]])):
            alpha = _unit((alpha if t == 0 else alpha @ moves) * emit[self.flat[self.begin[first] + t]])
        before[first + 1] = alpha
        order = np.argsort(self.nth[later], kind="stable")
        by_nth = np.split(later[order], np.flatnonzero(np.diff(self.nth[later][order])) + 1)
        for rows in by_nth:
            on = rows[(rows + 1 < n)]
            on = on[self.nth[on + 1] > 0]
            before[on + 1] = _unit(np.einsum("ni,nij->nj", before[on], products[on]))
        for rows in reversed(by_nth):
            after[rows - 1] = _unit(np.einsum("nij,nj->ni", products[rows], after[rows]))
        return before, after

    def groups(self) -> Iterator[np.ndarray]:
        """Numbers of blocks to run side by side, longest first."""
        order = np.argsort(-self.length, kind="stable")
        for at in range(0, len(order), GROUP):
            yield order[at:at + GROUP]


def expected(flat: np.ndarray, starts: np.ndarray, p: Parameters, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts: states at the start of texts, moves, and symbols by state."""
    # A symbol's scale is the same for all states, so it cancels out of every share.
    emit = p.emit / p.emit.max(axis=1, keepdims=True)
    k = len(p.start)
    blocks = Blocks.of(flat, starts, size)
    before, after = blocks.borders(p.start, p.moves, emit)
    back = np.ascontiguousarray(p.moves.T)
    first, moves, emitted = np.zeros(k), np.zeros((k, k)), np.zeros(p.emit.shape)
    for rows in blocks.groups():
        begin, running = blocks.begin[rows], _running(blocks.length[rows])
        fresh = blocks.nth[rows] == 0
        carried = before[rows]
        alpha = np.where(fresh[:, None], p.start, carried @ p.moves)
        alphas, emits, seen = [], [], []
        for t, n in enumerate(running):
            symbol = flat.take(begin[:n] + t)
            e = emit.take(symbol, axis=0)
            alpha = (alpha if t == 0 else alpha[:n] @ p.moves) * e
            if t % SCALED == 0:
                alpha = _unit(alpha)
            alphas.append(alpha)
            emits.append(e)
            seen.append(symbol)
        ahead = np.empty((0, k), emit.dtype)
        for t in range(len(running) - 1, -1, -1):
            n, on = running[t], len(ahead)
            full = ahead @ back
            if on < n:
                full = np.concatenate([full, after[rows[on:n]]])
            both = alphas[t] * full
            total = _totals(both)
            if on:
                moves += alphas[t][:on].T @ (ahead / total[:on])
            alphas[t] = both / total
            ahead = emits[t] * (full / total)
        first += alphas[0][fresh].sum(axis=0)
        entering = carried[~fresh]
        if len(entering):
            # The move from the block before into this one.
            arriving = ahead[~fresh]
            moves += entering.T @ (arriving / ((entering @ p.moves) * arriving).sum(axis=1, keepdims=True))
        symbol, gamma = np.concatenate(seen), np.concatenate(alphas)
        for state in range(k):
            emitted[:, state] += np.bincount(symbol, gamma[:, state], minlength=len(emitted))
    return first, moves * p.moves, emitted


def log_likelihood(flat: np.ndarray, starts: np.ndarray, p: Parameters, size: int = BLOCK) -> np.ndarray:
    """log10 probability of each text's symbols, by the scaled forward recursion."""
    start, moves, emit = p.start.astype(np.float64), p.moves.astype(np.float64), p.emit.astype(np.float64)
    most = emit.max(axis=1, keepdims=True)
    emit = emit / most
    blocks = Blocks.of(flat, starts, size)
    before, _ = blocks.borders(start, moves, emit)
    logs = np.zeros(len(blocks.text))
    for rows in blocks.groups():
        begin, running = blocks.begin[rows], _running(blocks.length[rows])
        alpha = np.where((blocks.nth[rows] == 0)[:, None], start, before[rows] @ moves)
        for t, n in enumerate(running):
            step = (alpha if t == 0 else alpha[:n] @ moves) * emit.take(flat.take(begin[:n] + t), axis=0)
            ends = running[t + 1] if t + 1 < len(running) else 0
            # Scaled every few steps, and where a block ends.
            if t % SCALED == SCALED - 1:
                scale = _totals(step)
                logs[rows[:n]] += np.log10(scale[:, 0])
                step /= scale
            elif ends < n:
                logs[rows[ends:n]] += np.log10(step[ends:].sum(axis=1))
            alpha = step
    each = np.concatenate([[0.0], np.cumsum(np.log10(most[:, 0])[flat])])
    return np.bincount(blocks.text, logs, minlength=len(starts) - 1) + each[starts[1:]] - each[starts[:-1]]
