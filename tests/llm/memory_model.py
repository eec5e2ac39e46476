"""The toxicity model in memory, for an alphabet of 32 symbols: what the operator's tables must equal."""

from dataclasses import dataclass

import numpy as np
from pairgram.llm.toxicity import DISCOUNT, ORDER, OWN

SYMBOL_BITS = 5
GRAMS = 1 << (SYMBOL_BITS * ORDER)
CONTEXTS = GRAMS >> SYMBOL_BITS


def continuation(keys: np.ndarray) -> list[np.ndarray]:
    """For ORDER - 1, ..., 1 symbols: how many symbols precede each gram, from the distinct grams ``keys``."""
    out, seen, size = [], keys, GRAMS
    while size > 1 << SYMBOL_BITS:
        size >>= SYMBOL_BITS
        out.append(np.bincount(seen & (size - 1), minlength=size).astype(np.float64))
        seen = np.nonzero(out[-1])[0]
    return out


def backoff(own: list[np.ndarray], shared: list[np.ndarray]) -> np.ndarray:
    """P(last symbol | the others) of all (ORDER - 1)-grams from a class's and the shared continuation counts."""
    n = 1 << SYMBOL_BITS
    p = np.full(n, 1.0 / n)
    for order, counts in [(k, shared) for k in range(1, ORDER)] + [(k, own) for k in range(OWN, ORDER)]:
        table = counts[ORDER - 1 - order].reshape(-1, n)
        total, types = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
        p = (np.tile(p, n) if counts is shared and order > 1 else p).reshape(-1, *table.shape)
        mixed = (np.maximum(table - DISCOUNT, 0) + DISCOUNT * types * p) / np.maximum(total, 1)
        p = np.where(total > 0, mixed, p).reshape(-1)
    return p


@dataclass
class Model:
    #: grams that a class has seen, and their evidence
    keys: np.ndarray
    values: np.ndarray
    #: evidence of other grams: by their context, and by their last ORDER - 1 symbols
    by_context: np.ndarray
    by_suffix: np.ndarray

    def table(self) -> np.ndarray:
        """Evidence of every gram."""
        out = np.repeat(self.by_context, 1 << SYMBOL_BITS)
        out.reshape(-1, CONTEXTS)[:] += self.by_suffix
        out[self.keys] = self.values
        return out


def evidence(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Model:
    """The model of all distinct grams and their counts in the two classes."""
    shared, seen = continuation(keys), (toxic > 0) | (ordinary > 0)
    k = keys[seen]
    logs, contexts, suffixes = [], [], []
    for c in (toxic[seen], ordinary[seen]):
        lower = backoff(continuation(k[c > 0]), shared)
        at = k >> SYMBOL_BITS
        total, types = np.bincount(at, c, CONTEXTS), np.bincount(at, c > 0, CONTEXTS)
        rest = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
        logs.append(np.log(np.maximum(c - DISCOUNT, 0) / np.maximum(total[at], 1) + rest[at] * lower[k & (CONTEXTS - 1)]))
        contexts.append(np.log(rest))
        suffixes.append(np.log(lower))
    return Model(k, *((x - y).astype(np.float32) for x, y in (logs, contexts, suffixes)))
