r"""Periodic runs of words, found by seeds and extended along diagonals.

A run is a stretch of consecutive words with smallest period q and at least
``max(12, 2 q)`` words that no neighbour extends.  Along the diagonal of lag q, where
word i meets word i + q, a run of length n is n - q equal pairs in a row, which is at
least ``max(12 - q, q)``.  That is the overlap the seeds rely on:

* lags 1 to 11 have at least six equal pairs, so 6-grams are their seeds;
* lags from k to 2 k - 1, with k = 12, 24, 48, ... have at least k, so k-grams are.

Occurrences of a k-gram in one document are paired while their lag is in the range of k.
Of grams inside a run already found with a period of at most k / 2, the periodic ones,
only those at such a run's first word are paired with those of a run that touches it.
That is enough: if all grams of the equal pairs of lag q are periodic, then by the
periodicity lemma the pairs lead from one such run into a second one that starts at its
end or before, and as they cannot be prolonged to the left they start at the first word
of one of the two.  Other grams cannot return at distances up to k / 2, so each has three
partners at most, and an anchor has about k / period; all seeds of a text of n words are
of the order of n log n however repetitive it is.
Seeds are extended to both sides on the words themselves; of a lag only the
furthest covered position is kept, and seeds before it are passed over.

Documents are searched in blocks of bounded size, side by side, with a word that
equals no other between them.  A document's work stays in the task that reads it:
nothing is shuffled.

Defined cases: null and empty texts have no words and no runs, and their collapsed
text is empty; two runs may overlap, and a word goes if any of them drops it; repeated
rows are treated each; an empty table gives no rows; kept columns may have any name but
``runs``, ``collapsed`` and ``n_words``.  A document is searched as a whole, so its words
have to fit into a task (about 150 bytes a word).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from shelf.llm.common import map_texts

#: Shortest run, in words.
LEAST = 12
#: Words that are searched together; a longer document is searched alone.
BLOCK_WORDS = 200_000
#: An odd multiplier of the gram hash; arithmetic is modulo 2**64.
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits, one to one."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Grams:
    """Hashes of all grams of a sequence, of any length, in constant time each."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(words) * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(pow(_BASE, -1, 1 << 64), n)

    def at(self, where: np.ndarray, k: int) -> np.ndarray:
        return (self.sums[where + k] - self.sums[where]) * self.back[where]


def _extent(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch of equal pairs on the diagonal ``lag`` around ``at``, as [from, to);
    empty if the pair at ``at`` itself differs."""
    end, step = at, 32
    while end + lag < len(words):
        equal = words[end:end + step][:len(words) - lag - end] == words[end + lag:end + lag + step]
        differs = int(equal.argmin())
        if not equal[differs]:
            end += differs
            break
        end, step = end + len(equal), step * 2
    if end == at:
        return at, at
    start, step = at, 32
    while start:
        low = max(0, start - step)
        equal = (words[low:start] == words[low + lag:start + lag])[::-1]
        differs = int(equal.argmin())
        if not equal[differs]:
            start -= differs
            break
        start, step = low, step * 2
    return start, end


def _pairs(grams: np.ndarray, where: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and lags of all pairs of equal grams with a lag from ``low`` to below
    ``high``.  ``where`` rises, and ``grams`` belong to its positions."""
    order = np.argsort(grams, kind="stable")
    grams, where = grams[order], where[order]
    first, starts, lags, step = np.arange(len(where)), [], [], 1
    while len(first := first[first + step < len(where)]):
        lag = where[first + step] - where[first]
        near = (grams[first + step] == grams[first]) & (lag < high)
        first, lag = first[near], lag[near]
        wanted = lag >= low
        starts.append(where[first[wanted]])
        lags.append(lag[wanted])
        step += 1
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *starts]), np.concatenate([empty, *lags])


def _anchored(grams: np.ndarray, where: np.ndarray, k: int, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and lags, from ``k`` to below ``2 k``, of the pairs that lead from one run
    into one that touches it, with the first word of one of the two.  ``begin`` and
    ``stop`` bound the run of a position."""
    n, anchor = len(begin), begin[where] == where
    some = np.isin(grams, grams[anchor])
    grams, where, anchor = grams[some], where[some], anchor[some]
    group = np.unique(grams, return_inverse=True)[1].astype(np.int64) * (n + 1)
    order = np.sort(group + where)
    own, group = where[anchor], group[anchor]
    starts, lags = [], []
    for low, high in ((own - 2 * k + 1, own - k), (own + k, own + 2 * k - 1)):
        first = np.searchsorted(order, group + np.maximum(low, 0), side="left")
        number = np.maximum(np.searchsorted(order, group + np.clip(high, -1, n), side="right") - first, 0)
        at = np.repeat(first - np.cumsum(number) + number, number) + np.arange(number.sum())
        other, mine = order[at] - np.repeat(group, number), np.repeat(own, number)
        left, right = np.minimum(other, mine), np.maximum(other, mine)
        touch = (begin[left] != begin[right]) & (stop[left] >= begin[right])
        starts.append(left[touch])
        lags.append((right - left)[touch])
    return np.concatenate(starts), np.concatenate(lags)


def find_runs(words: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of documents that stand one after the other.

    ``words`` are numbers, equal for equal words, of documents of ``lengths`` words with
    one separator, a number used nowhere else, behind each."""
    n = len(words)
    document = np.repeat(np.arange(len(lengths)), lengths + 1)
    size, end = lengths[document], (np.cumsum(lengths + 1) - 1)[document]
    grams, at = Grams(words), np.arange(n)
    found: dict[tuple[int, int], int] = {}

    def extend(starts: np.ndarray, lags: np.ndarray) -> None:
        order = np.lexsort((starts, lags))
        starts, lags = starts[order], lags[order]
        covered: dict[int, int] = {}
        i = 0
        while i < len(starts):
            start, lag = int(starts[i]), int(lags[i])
            if start >= covered.get(lag, 0):
                low, high = _extent(words, start, lag)
                covered[lag] = max(high, start + 1)
                if high - low >= max(LEAST - lag, lag):
                    # a lag that is a multiple of the period gives the same stretch again
                    found.setdefault((low, high - low + lag), lag)
            # on to the first seed of this lag that is not covered, or to the next lag
            last = i + int(np.searchsorted(lags[i:], lag, side="right"))
            i += max(1, int(np.searchsorted(starts[i:last], covered[lag])))

    k = LEAST // 2
    some = at[(end - at >= k) & (size >= LEAST)]
    dense = np.zeros(n, np.uint64)
    dense[some] = grams.at(some, k)
    inside = np.zeros(n, bool)
    inside[some] = True
    for lag in range(1, LEAST):
        same = inside[lag:] & inside[:-lag] & (dense[lag:] == dense[:-lag]) & (document[lag:] == document[:-lag])
        starts = np.flatnonzero(same)
        extend(starts, np.full(len(starts), lag))

    # a gram that returns nowhere in its document has no longer gram that does
    alive, k = some, LEAST
    while len(alive := alive[(end[alive] - alive >= k) & (size[alive] >= 2 * k)]):
        begin, stop = np.full(n, -1), np.full(n, -1)
        for (start, length), period in found.items():
            if period <= k // 2 and length >= k:
                begin[start:start + length - k + 1], stop[start:start + length - k + 1] = start, start + length
        periodic = begin[alive] >= 0
        own = grams.at(alive, k) + _mixed(document[alive])
        order = np.argsort(own)
        again = own[order[1:]] == own[order[:-1]]
        returns = np.zeros(len(alive), bool)
        returns[order[1:][again]] = returns[order[:-1][again]] = True
        seeds, inner = returns & ~periodic, returns & periodic
        plain = _pairs(own[seeds], alive[seeds], k, 2 * k)
        turned = _anchored(own[inner], alive[inner], k, begin, stop)
        extend(*map(np.concatenate, zip(plain, turned, strict=True)))
        alive, k = alive[returns], 2 * k
    return sorted((start, length, period) for (start, length), period in found.items())


def _search(words: list[list[bytes]]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs and collapsed text of each document of a block."""
    numbers: dict[bytes, int] = {}
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.array(
        [x for i, own in enumerate(words) for x in (*[numbers.setdefault(w, len(numbers)) for w in own], -1 - i)], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for start, length, period in find_runs(flat, lengths):
        i = int(np.searchsorted(first, start, side="right")) - 1
        runs[i].append((start - int(first[i]), length, period))
    out = []
    for own, mine in zip(words, runs, strict=True):
        mine.sort(key=lambda r: (r[0], r[2]))
        kept = own
        if mine:
            drop = np.zeros(len(own) + 1, np.int64)
            for start, length, period in mine:
                drop[start + period] += 1
                drop[start + length] -= 1
            kept = [w for w, gone in zip(own, np.cumsum(drop)[:-1].tolist(), strict=True) if not gone]
        out.append((mine, b" ".join(kept)))
    return out


def _searcher() -> Callable[[list[str]], list[list]]:
    def search(texts: list[str]) -> list[list]:
        found, block, held = [], [], 0
        for text in texts:
            own = text.encode().split()  # splits at blanks and the controls from tab to carriage return
            if block and held + len(own) > BLOCK_WORDS:
                found += _search(block)
                block, held = [], 0
            block.append(own)
            held += len(own) + 1
        found += _search(block) if block else []
        return [[r for r, _ in found], [t.decode() for _, t in found]]

    return search


def periodic_runs(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` (doc_id by default), ``runs`` by start and period, and
    ``collapsed``: the words joined by one blank, of each run only its first period."""
    return map_texts(docs, keep or ("doc_id",), "runs array<struct<start:long,length:long,period:long>>, collapsed string", _searcher)
