"""Induced sorting of suffixes in memory, with queues that can spill: they carry suffix tuples and common-prefix values.

The text is a byte array whose pieces end with a separator smaller than every byte. Suffixes at the left end of an ascending stretch
(S*) are ordered first, by names of their substrings and, while names repeat, by the same question one level up: the string of names
is sorted recursively (by induction while its alphabet is small, else by doubling the named prefix). All other suffixes are induced:
a queue holds, per first character, the suffixes whose successor has been placed; each tuple carries its position and the length of
the prefix it shares with the tuple before it, got from the minimum over the inducing suffixes in between.

The text, its packed words and the induced suffixes stay in memory, about 50 bytes a character at the peak; callers bound the text.

Orders are exact to ``depth`` characters, the length of the strings to be compared; ties beyond are in text order. Queues keep at most
``memory`` bytes and spill whole buckets to files in a folder of the task, removed with it.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

TUPLE = np.dtype([("pos", np.int64), ("lcp", np.int32)])
SMALL_ALPHABET = 1024


class DiskQueue:
    """A monotone priority queue of tuples: first in, first out within a bucket, buckets taken in order by the caller."""

    def __init__(self, buckets: int, memory: int, folder: str):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(buckets)]
        self.sizes = np.zeros(buckets, dtype=np.int64)
        self.on_disk = np.zeros(buckets, dtype=bool)
        self.memory, self.folder = memory, tempfile.mkdtemp(dir=folder)

    def push(self, buckets: np.ndarray, tuples: np.ndarray) -> None:
        if not len(buckets):
            return
        order = np.argsort(buckets.astype(np.uint16), kind="stable")
        buckets, tuples = buckets[order], tuples[order]
        starts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
        for s, e in zip(starts, [*starts[1:], len(buckets)], strict=True):
            self.parts[buckets[s]].append(tuples[s:e])
            self.sizes[buckets[s]] += (e - s) * TUPLE.itemsize
        while self.sizes.sum() > self.memory:
            self._spill(int(self.sizes.argmax()))

    def _spill(self, bucket: int) -> None:
        with open(f"{self.folder}/{bucket}", "ab") as out:
            for part in self.parts[bucket]:
                out.write(part.tobytes())
        self.parts[bucket], self.sizes[bucket], self.on_disk[bucket] = [], 0, True

    def pop(self, bucket: int) -> np.ndarray:
        """All tuples of a bucket in the order they came; more may be pushed into it afterwards."""
        parts = []
        if self.on_disk[bucket]:
            parts.append(np.fromfile(f"{self.folder}/{bucket}", dtype=TUPLE))
            os.remove(f"{self.folder}/{bucket}")
        parts += self.parts[bucket]
        self.parts[bucket], self.sizes[bucket], self.on_disk[bucket] = [], 0, False
        return np.concatenate(parts) if parts else np.zeros(0, dtype=TUPLE)


class Words:
    """Every position's next characters packed into one integer, the first one highest; past the end stands a greater character."""

    def __init__(self, text: np.ndarray):
        self.text, self.past = text, int(text.max()) + 1
        self.bits = max(1, self.past.bit_length())
        self.width = 62 // self.bits
        padded = np.concatenate((text.astype(np.int64), np.full(self.width + 1, self.past, dtype=np.int64)))
        self.words = np.zeros(len(text) + 1, dtype=np.int64)
        for d in range(self.width):
            self.words = (self.words << self.bits) | padded[d : d + len(text) + 1]

    def at(self, positions: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(positions, len(self.text))]


def shared_prefix(words: Words, x: np.ndarray, y: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at x and y, up to ``depth``."""
    out = np.full(len(x), depth, dtype=np.int32)
    live = np.arange(len(x))
    for d in range(0, depth, words.width):
        a, b = words.at(x[live] + d), words.at(y[live] + d)
        apart = a != b
        if apart.any():
            differ, place = a[apart] ^ b[apart], np.zeros(apart.sum(), dtype=np.int32)
            for k in range(1, words.width):  # characters that agree from the left
                place += (differ >> (words.bits * (words.width - k)) == 0).astype(np.int32)
            out[live[apart]] = np.minimum(depth, d + place)
        live = live[~apart]
        if not len(live):
            break
    return out


def types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor (type S); the last one is S."""
    n = len(text)
    differs = np.append(text[1:] != text[:-1], True)
    nxt = np.where(differs, np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]  # where the run of equal characters ends
    up = np.ones(n, dtype=bool)
    inner = nxt < n - 1
    up[inner] = text[nxt[inner]] < text[nxt[inner] + 1]
    return up


def _names(words: Words, star: np.ndarray) -> tuple[np.ndarray, bool]:
    """Rank of each S* substring (from its start to the next S*, both included), and whether all differ.

    Where one substring ends inside another, the other goes on with a character of type L and is smaller.
    """
    lengths = np.append(star[1:], len(words.text) - 1) - star + 1
    rank = np.zeros(len(star), dtype=np.int64)
    live = np.arange(len(star))
    done = 0
    while len(live):
        missing = np.clip(words.width - (lengths[live] - done), 0, words.width)
        low = (np.int64(1) << (missing * words.bits)) - 1
        key = words.at(star[live] + done) | low
        order = np.lexsort((key, rank[live])) if done else np.argsort(key, kind="stable")
        r, k = rank[live][order], key[order]
        fresh = np.concatenate(([0], np.cumsum((r[1:] != r[:-1]) | (k[1:] != k[:-1]))))
        within = np.full(len(star), len(star), dtype=np.int64)
        within[live[order]] = fresh
        order = np.lexsort((within, rank)) if done else np.argsort(within, kind="stable")
        r, k = rank[order], within[order]
        rank = np.empty_like(rank)
        rank[order] = np.concatenate(([0], np.cumsum((r[1:] != r[:-1]) | (k[1:] != k[:-1]))))
        done += words.width
        live = np.flatnonzero((lengths > done) & (np.bincount(rank)[rank] > 1))
    return rank, bool(len(rank) == 0 or rank.max() + 1 == len(rank))


def _double(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names by doubling, to ``depth`` names; ties in text order."""
    rank = names.copy()
    step = 1
    while True:
        after = np.zeros(len(rank), dtype=np.int64)
        after[: max(0, len(rank) - step)] = rank[step:] + 1
        key = rank * (len(rank) + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) if len(order) else np.zeros(0, dtype=np.int64)
        rank = np.empty_like(rank)
        rank[order] = fresh
        step *= 2
        if step >= depth or not len(order) or fresh[-1] + 1 == len(order):
            return order


def _induce(words: Words, up: np.ndarray, seeds: np.ndarray, sizes: np.ndarray, depth: int, memory: int, folder: str, rising: bool, held: list[np.ndarray]):
    """One direction of induction; yields (character, tuples in scan order) of the induced suffixes.

    Rising: L suffixes from S* ``seeds`` (sorted, cut by character into ``sizes``). Falling: S suffixes from L suffixes ``held``.
    """
    text = words.text
    queue = DiskQueue(len(sizes), memory, folder)
    carry = np.full(len(sizes), depth, dtype=np.int32)
    cuts = np.concatenate(([0], np.cumsum(sizes)))

    if not rising:  # the last suffix has no successor that could induce it
        queue.push(text[-1:], np.array([(len(text) - 1, 0)], dtype=TUPLE))

    def hand_on(scanned: np.ndarray) -> None:
        nonlocal carry
        if not len(scanned):
            return
        before = scanned["pos"] - 1
        wanted = before >= 0
        wanted[wanted] = up[before[wanted]] != rising
        at = np.flatnonzero(wanted)
        least = scanned["lcp"]
        chars = text[before[at]].astype(np.int64)
        order = np.argsort(chars.astype(np.uint16), kind="stable")
        at, chars = at[order], chars[order]
        # For each target, the minimum from past its last tuple up to this one: blocks of one running minimum by reduceat.
        lcp = np.zeros(len(at), dtype=np.int32)
        if len(at):
            first = np.concatenate(([True], chars[1:] != chars[:-1]))
            starts = np.where(first, 0, np.concatenate(([0], at[:-1] + 1)))
            low = _range_min(least, starts, at + 1)
            lcp = np.where(first, np.minimum(low, carry[chars]), low)
            last = np.append(np.flatnonzero(first)[1:], len(at)) - 1
            tail = np.full(len(last), depth, dtype=np.int32)
            rest = at[last] + 1 < len(least)
            tail[rest] = _range_min(least, at[last][rest] + 1, np.full(rest.sum(), len(least)))
            whole = np.minimum(carry, least.min())
            whole[chars[last]] = tail
            carry = whole
        else:
            carry = np.minimum(carry, least.min())
        tuples = np.empty(len(at), dtype=TUPLE)
        tuples["pos"], tuples["lcp"] = before[at], np.minimum(depth, lcp + 1)
        back = np.argsort(at, kind="stable")
        queue.push(chars[back], tuples[back])

    def seam(last: np.ndarray, first: np.ndarray) -> np.ndarray:
        """``first`` with the shared prefix of its first tuple and the one before it set."""
        if len(last) and len(first):
            first = first.copy()
            first["lcp"][0] = shared_prefix(words, last["pos"][-1:], first["pos"][:1], depth)[0]
        return first

    for c in range(len(sizes)) if rising else range(len(sizes) - 1, -1, -1):
        own = []
        while True:
            part = queue.pop(c)
            if not len(part):
                break
            if not own:
                part["lcp"][0] = 0
            own.append(part)
            hand_on(part)
        made = np.concatenate(own) if own else np.zeros(0, dtype=TUPLE)
        rest = seeds[cuts[c] : cuts[c + 1]] if rising else held[c]
        hand_on(seam(made, rest))
        yield c, made


def _range_min(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Minimum of values[start:end] for non-empty ranges, each by reduceat."""
    if not len(starts):
        return np.zeros(0, dtype=np.int32)
    padded = np.append(values, np.iinfo(np.int32).max)
    return np.minimum.reduceat(padded, np.column_stack([starts, ends]).ravel())[::2]


def sorted_suffixes(text: np.ndarray, depth: int, memory: int = 64 << 20, folder: str | None = None):
    """Yield (positions, shared prefix with the position before, 0 for the first) per first character, in suffix order or reverse.

    ``text``: integers from 0, the last being the only or one of several separators 0. Characters are yielded from the greatest down;
    within a character, positions ascend in suffix order.
    """
    own = tempfile.mkdtemp(dir=folder)
    try:
        words, up = Words(text), types(text)
        star = np.flatnonzero(up[1:] & ~up[:-1]) + 1
        names, distinct = _names(words, star)
        if distinct:
            order = np.argsort(names)
        elif names.max() < SMALL_ALPHABET and len(star) > SMALL_ALPHABET:
            ranked = np.concatenate([p for p, _ in list(sorted_suffixes(np.append(names + 1, 0), depth, memory, own))[::-1]])
            order = ranked[ranked < len(names)]
        else:
            order = _double(names, depth)
        star = star[order]
        seeds = np.empty(len(star), dtype=TUPLE)
        seeds["pos"] = star
        seeds["lcp"] = np.concatenate(([0], shared_prefix(words, star[:-1], star[1:], depth))) if len(star) else 0
        k = int(text.max()) + 1
        sizes = np.bincount(text[star], minlength=k) if len(star) else np.zeros(k, dtype=np.int64)
        lower = [made for _, made in _induce(words, up, seeds, sizes, depth, memory, own, True, [])]
        falling = []
        for made in lower:  # scanned from the greatest down: each tuple then carries what it shares with the next greater one
            turned = made[::-1].copy()
            turned["lcp"] = np.concatenate(([0], made["lcp"][:0:-1])) if len(made) else turned["lcp"]
            falling.append(turned)
        for c, made in _induce(words, up, seeds, sizes, depth, memory, own, False, falling):
            upper = made["pos"][::-1]
            upper_lcp = np.concatenate(([0], made["lcp"][:0:-1])).astype(np.int32) if len(made) else np.zeros(0, dtype=np.int32)
            if len(upper) and len(lower[c]):
                upper_lcp[0] = shared_prefix(words, lower[c]["pos"][-1:], upper[:1], depth)[0]
            lower_lcp = lower[c]["lcp"].copy()
            if len(lower_lcp):
                lower_lcp[0] = 0
            yield np.concatenate((lower[c]["pos"], upper)), np.concatenate((lower_lcp, upper_lcp))
    finally:
        shutil.rmtree(own, ignore_errors=True)


def later_copies(text: np.ndarray, length: int, valid: np.ndarray, memory: int = 64 << 20) -> np.ndarray:
    """Which valid positions start a string of ``length`` that a smaller valid position starts too."""
    out = np.zeros(len(text), dtype=bool)
    for positions, lcp in sorted_suffixes(text, length, memory):
        if not len(positions):
            continue
        group = np.cumsum(lcp < length)
        keep = valid[positions]
        positions, group = positions[keep], group[keep]
        if not len(positions):
            continue
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        least = np.minimum.reduceat(positions, starts)
        out[positions[positions != np.repeat(least, np.diff(np.append(starts, len(positions))))]] = True
    return out
