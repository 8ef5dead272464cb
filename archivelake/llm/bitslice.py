"""Bit-sliced comparison of fingerprints.

Bit planes are stored vertically: plane j holds bit j of 64 fingerprints in a machine word, so one XOR updates 64 distances.
Carry-save counters (one plane a binary digit) add the planes up, ``STEP`` of them at a time as a tree of full adders. After
each step the words all of whose distances have passed the radius are abandoned; the rest go on.

Two layouts of the pairs. ``local_components`` compares one large group: 64 members against words of the others. ``pooled``
compares many small groups at once: members lie side by side, larger groups first, and are compared with the planes shifted by
each offset, so those that still have a partner at an offset are a prefix.
"""

from __future__ import annotations

import numpy as np

STEP = 32
#: Words of 64 candidates that a block of 64 members meets at once; members of a group from which it is compared by itself.
WORDS, LARGE = 64, 128

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes_of(fps: np.ndarray, more: int = 0) -> np.ndarray:
    """bits x words of fps (m x words of 64 bits); more: words of zeros behind."""
    m, lanes = len(fps), -(-len(fps) // 64) + more
    square = np.zeros((lanes * 64, fps.shape[1]), np.uint64)
    square[:m] = fps
    each = np.unpackbits(square.astype("<u8").view(np.uint8).reshape(lanes * 64, -1), axis=1, bitorder="little")
    return np.packbits(each, axis=0, bitorder="little").T.copy().view("<u8").reshape(fps.shape[1] * 64, lanes)


def added(counters: list[np.ndarray], planes: np.ndarray) -> list[np.ndarray]:
    """counters (binary digits from the lowest) after planes were added to them."""
    out, carry = [], planes
    while len(carry) or len(out) < len(counters):
        now = np.concatenate([carry, counters[len(out)][None]]) if len(out) < len(counters) else carry
        up = []
        while len(now) > 2:
            n = len(now) // 3
            a, b, c = now[:n], now[n : 2 * n], now[2 * n : 3 * n]
            x = a ^ b
            up.append((a & b) | (x & c))
            now = np.concatenate([x ^ c, now[3 * n :]])
        if len(now) == 2:
            up.append((now[0] & now[1])[None])
            now = (now[0] ^ now[1])[None]
        out.append(now[0])
        carry = np.concatenate(up) if up else now[:0]
    return out


def above(counters: list[np.ndarray], limit: int) -> np.ndarray:
    """The lanes whose counter is greater than limit."""
    over, same = np.zeros_like(counters[0]), np.full_like(counters[0], _ALL)
    for k in reversed(range(max(len(counters), limit.bit_length()))):
        digit = counters[k] if k < len(counters) else np.uint64(0)
        if limit >> k & 1:
            same = same & digit
        else:
            over |= same & digit
            same = same & ~digit
    return over


def lanes_of(words: np.ndarray) -> np.ndarray:
    """Each word's bits, along a last axis of 64."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(*words.shape, 8), axis=-1, bitorder="little")


def join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Links places i with places j: label holds the smallest place of each component, before and after."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((up := label[label]) != label).any():
            label[:] = up


def local_components(fps: np.ndarray, radius: int) -> np.ndarray:
    """The smallest index reachable from each of fps (m x words of 64 bits) over links of at most radius bits. Words whose
    candidates are all in the component of the 64 members already have nothing to add and are passed over."""
    m, bits = len(fps), fps.shape[1] * 64
    label, planes = np.arange(m), planes_of(fps)
    lanes = planes.shape[1]
    each = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(m, -1), axis=1, bitorder="little")
    masks = (np.uint64(0) - each.astype(np.uint64)).T
    place = np.minimum(np.arange(lanes * 64), m - 1).reshape(lanes, 64)
    for q in range(0, m, 64):
        rows, w = slice(q, min(q + 64, m)), q // 64
        for first in range(w, lanes, WORDS):
            at, own = np.arange(first, min(first + WORDS, lanes)), label[q]
            if (label[rows] == own).all():
                at = at[(label[place[at]] != own).any(axis=1)]
            counters: list[np.ndarray] = []
            for j in range(0, bits, STEP):
                if not len(at):
                    break
                counters = added(counters, planes[j : j + STEP, at][:, None, :] ^ masks[j : j + STEP, rows][:, :, None])
                if j + STEP > min(radius, bits - 1):
                    over = above(counters, radius)
                    alive = (over != _ALL).any(axis=0)
                    if not alive.all():
                        at, over, counters = at[alive], over[:, alive], [c[:, alive] for c in counters]
            if len(at):
                a, word, lane = np.nonzero(lanes_of(~over))
                b = at[word] * 64 + lane
                real = b < m
                join(label, a[real] + q, b[real])
    return label


def pooled(keys: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """The smallest index reachable from each of fps over links, of at most radius bits, between those of the same key; keys are
    sorted. Groups of LARGE or more are compared by themselves."""
    label = np.arange(len(fps))
    at = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]])
    sizes = np.diff(at)
    for g in np.nonzero(sizes >= LARGE)[0]:
        label[at[g] : at[g + 1]] = at[g] + local_components(fps[at[g] : at[g + 1]], radius)
    small = np.nonzero((sizes > 1) & (sizes < LARGE))[0]
    small = small[np.argsort(-sizes[small], kind="stable")]
    held = sizes[small]
    if not len(held):
        return label
    ends = np.cumsum(held)
    order = np.repeat(at[small] - (ends - held), held) + np.arange(ends[-1])
    group, planes = np.repeat(np.arange(len(small)), held), planes_of(fps[order], more=LARGE // 64 + 2)
    for d in range(1, int(held[0])):
        n = int(ends[np.searchsorted(-held, -d, "left") - 1])  # members of groups larger than d
        i = _near(planes, n - d, d, radius)
        i = i[group[i] == group[i + d]]
        join(label, order[i], order[i + d])
    return label


def _near(planes: np.ndarray, n: int, d: int, radius: int) -> np.ndarray:
    """The places i below n with at most radius bits between i and i + d."""
    skip, turn = d >> 6, np.uint64(d & 63)
    at, counters = np.arange(-(-n // 64)), []
    for j in range(0, len(planes), STEP):
        here = planes[j : j + STEP]
        there = here[:, at + skip]
        if turn:
            there = there >> turn | here[:, at + skip + 1] << (np.uint64(64) - turn)
        counters = added(counters, here[:, at] ^ there)
        if j + STEP > min(radius, len(planes) - 1):
            over = above(counters, radius)
            alive = over != _ALL
            if not alive.all():
                at, over, counters = at[alive], over[alive], [c[alive] for c in counters]
            if not len(at):
                return at
    word, lane = np.nonzero(lanes_of(~over))
    i = at[word] * 64 + lane
    return i[i < n]
