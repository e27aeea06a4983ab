"""Burrows-Wheeler transforms of shards of byte strings, merged by iterative interleave refinement.

A string is read in super-symbols, stretches of ``step`` bytes; the suffix at byte i goes on at i + step, i + 2 step, and
so on, so a string makes ``step`` chains, each closed by an end mark. The Burrows-Wheeler symbol of a suffix is the
stretch before it, or the end mark at the start of a chain. Symbols are ranks of the stretches' 64-bit hashes: order among
different symbols does not matter for repeats, only that it is total.

A shard's transform lists the symbols before its suffixes, in the order of the suffixes' first ``depth`` symbols. `merge`
reads nothing but those transforms. The interleave, a vector that says for each place of the merged order which shard's
next suffix stands there, starts as one shard after another. A round walks it, takes from each shard the next symbol of
its transform, and puts the shard's number in the bucket of that symbol, stably (a counting pass); so after h rounds the
interleave is in the order of the first h symbols. Where neighbours part for the first time in round h + 1 their common
prefix is h symbols. Suffixes are never compared or sorted again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from webloom.llm.anchors import Prefixes


@dataclass
class Shard:
    """``before``: the transform, the rank of the symbol before each suffix (0: end mark). ``places``: the caller's
    places of the suffixes, in the same order."""

    before: np.ndarray
    places: np.ndarray


@dataclass
class Merged:
    places: np.ndarray
    common: np.ndarray  # symbols that a suffix shares with the one above it, up to the depth

    def repeated(self, depth: int) -> np.ndarray:
        """(first, end) of the intervals of two or more suffixes that share ``depth`` symbols."""
        edges = np.flatnonzero(np.concatenate([self.common < depth, [True]]))
        more = edges[1:] - edges[:-1] > 1
        return np.stack([edges[:-1][more], edges[1:][more]], axis=1)


def _by(keys: np.ndarray) -> np.ndarray:
    """Order by small keys, stable: counting passes of 16 bits."""
    if keys.itemsize <= 2:
        return np.argsort(keys, kind="stable")
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    if len(keys) and int(keys.max()) >> 16:
        order = order[np.argsort((keys >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def strings(sizes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For strings of ``sizes`` bytes laid one after another, each with a place for its end: the offsets of the strings,
    whether a place has a whole symbol ahead, and the place before each on its chain (of the first: the last)."""
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    place = np.arange(int(offsets[-1]), dtype=np.int32)
    at = place - np.repeat(offsets[:-1].astype(np.int32), sizes + 1)
    ahead = np.repeat(sizes.astype(np.int32), sizes + 1) - at
    previous = place - step
    start = np.flatnonzero(at < step)
    previous[start] = place[start] + step * (ahead[start] // step)
    return offsets, ahead >= step, previous


def shard(symbols: np.ndarray, previous: np.ndarray, first: int, end: int, depth: int) -> Shard:
    """Transform of the strings at the places from ``first`` to ``end``: as many counting passes as the depth, each by
    the symbol before."""
    before = previous[first:end] - first
    ranks = symbols[first:end]
    order = np.arange(end - first, dtype=np.int32)
    for _ in range(depth):
        order = before[order]
        order = order[_by(ranks[order])]
    return Shard(ranks[before[order]], order + first)


def merge(shards: list[Shard], depth: int) -> Merged:
    """One order of all shards' suffixes, from their transforms alone."""
    sizes = [len(s.before) for s in shards]
    n = sum(sizes)
    if not n:
        return Merged(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32))
    transforms = np.concatenate([s.before for s in shards])
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) <= 256 else np.int32), sizes)
    common = np.full(n, depth, dtype=np.int32)
    common[0] = 0
    block = np.zeros(n, dtype=np.int32)
    symbol = np.empty(n, dtype=np.int32)
    for h in range(depth):
        symbol[_by(interleave)] = transforms  # each shard's next symbol, wherever the interleave names the shard
        order = _by(symbol)
        interleave, sorted_symbol, block = interleave[order], symbol[order], block[order]
        part = np.zeros(n, dtype=bool)
        part[1:] = (sorted_symbol[1:] != sorted_symbol[:-1]) | (block[1:] != block[:-1])
        common[part & (common == depth)] = h
        block = np.cumsum(part, dtype=np.int32)
    places = np.empty(n, dtype=np.int32)
    places[_by(interleave)] = np.concatenate([s.places for s in shards])
    return Merged(places, common)


def repeated_starts(contexts: list[bytes], counts: list[int], lengths: tuple[int, ...], step: int, shard_bytes: int) -> list[np.ndarray]:
    """For each length, in a row of flags for each context: which of the context's first ``counts`` starts begin a
    string of that length that another of these starts begins, too. Strings that reach beyond their context are not
    looked at. Contexts are dealt in turn to shards of about ``shard_bytes``.

    A string that holds a symbol which occurs once is not repeated. So of each context only the starts that have enough
    symbols ahead which occur twice take part, with the bytes that such symbols cover."""
    if any(length % step for length in lengths):
        raise ValueError("step has to divide the lengths")
    depth, least = max(lengths) // step, min(lengths) // step
    out = [np.zeros((len(lengths), n), dtype=bool) for n in counts]
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    offsets, whole, _ = strings(sizes, step)
    begins = offsets.tolist()
    data = np.frombuffer(b"\0".join([*contexts, b""]), dtype=np.uint8)
    hashed = np.zeros(len(data), dtype=np.uint64)
    hashed[: max(0, len(data) - step + 1)] = Prefixes(data, 0).grams(step) if len(data) >= step else 0
    seen = np.bincount((hashed[whole] >> np.uint64(44)).astype(np.int64), minlength=1 << 20)
    often = whole & (seen[(hashed >> np.uint64(44)).astype(np.int64)] > 1)
    row, ahead = often, often.astype(np.int32)  # symbols ahead that occur twice, in a row
    for _ in range(1, depth):
        row = np.concatenate([row[step:], np.zeros(min(step, len(row)), dtype=bool)]) & often
        ahead += row
    asked = np.zeros(len(data), dtype=bool)
    for i, n in enumerate(counts):
        asked[offsets[i] : offsets[i] + n] = True
    hope = np.flatnonzero(asked & (ahead >= least))
    if not len(hope):
        return out
    owner = np.searchsorted(offsets, hope, side="right") - 1
    cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    live = owner[cut].tolist()
    first = dict(zip(live, hope[cut].tolist(), strict=True))
    last = dict(zip(live, hope[np.concatenate([cut[1:], [len(hope)]]) - 1].tolist(), strict=True))
    until = dict(zip(live, np.maximum.reduceat(hope + step * ahead[hope], cut).tolist(), strict=True))
    n_shards = max(1, min(len(live), -(-sum(until[i] - first[i] for i in live) // shard_bytes)))
    dealt = [i for s in range(n_shards) for i in live[s::n_shards]]
    pieces = np.concatenate([np.arange(first[i], until[i] + 1) for i in dealt])
    offsets, whole, previous = strings(np.array([until[i] - first[i] for i in dealt]), step)
    symbols = np.zeros(len(pieces), dtype=np.int32)
    symbols[whole] = np.unique(hashed[pieces[whole]], return_inverse=True)[1] + 1
    shards, at = [], 0
    for s in range(n_shards):
        end = at + len(live[s::n_shards])
        shards.append(shard(symbols, previous, int(offsets[at]), int(offsets[end]), depth))
        at = end
    merged = merge(shards, depth)
    asked = asked[pieces][merged.places]
    for k, length in enumerate(lengths):
        block = np.cumsum(merged.common < length // step)
        twice = np.zeros(len(pieces), dtype=bool)
        twice[merged.places] = (np.bincount(block[asked], minlength=len(pieces) + 1) > 1)[block]
        for j, i in enumerate(dealt):
            n = min(last[i] - first[i] + 1, until[i] - first[i] - length + 1)
            if n > 0:
                at = first[i] - begins[i]
                out[i][k, at : at + n] = twice[offsets[j] : offsets[j] + n]
    return out
