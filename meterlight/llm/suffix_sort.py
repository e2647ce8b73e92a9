"""Two-stage suffix sorting of short passages, vectorised over many groups of passages.

A suffix is of type B if it is smaller than the suffix that follows it, else of type A. Only
those of type B are sorted directly, by their first ``depth`` bytes. The others are induced:
the buckets of equal (group, first byte) are scanned from the smallest byte on, and each suffix
found puts the one before it, if that is of type A, at the end of its own bucket's A part. The
scan takes one byte value at a time for all groups together.

Suffixes that agree in ``depth`` bytes may stand in any order; they stand together.
"""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray, size: int = 8) -> np.ndarray:
    """For each position the next eight bytes as one big-endian number; zeros follow the end."""
    out = np.concatenate([text, np.zeros(size, np.uint8)]).astype(np.uint64)
    width = 1
    while width < size:
        out[:-width] = (out[:-width] << np.uint64(8 * width)) | out[width:]
        width *= 2
    return out[: len(text)]


def type_b(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; separators (0) count as such."""
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = text[change + 1] > text[change]
    lengths = np.diff(np.concatenate([[-1], change, [len(text) - 1]]))
    out = np.repeat(np.concatenate([rises, [False]]), lengths)
    out[text == 0] = True
    return out


def sort_directly(at: np.ndarray, group: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` ordered by group and then their first ``depth`` bytes.

    Eight bytes are looked at a time. Positions that agree so far form a tie; only ties in
    which the next eight bytes differ are sorted anew.
    """
    order = at[np.argsort(group, kind="stable")]
    own = np.sort(group, kind="stable")
    first = np.concatenate([[True], own[1:] != own[:-1]])
    for offset in range(0, depth, 8):
        slots = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(slots):
            break
        where = order[slots] + offset
        key = np.where(where < len(words), words[np.minimum(where, len(words) - 1)], np.uint64(0))
        new = first[slots]
        differs = (key[1:] != key[:-1]) & ~new[1:]
        tie = np.cumsum(new) - 1
        torn = np.zeros(int(tie[-1]) + 1, bool)
        torn[tie[1:][differs]] = True
        some = torn[tie]
        slots, key, tie = slots[some], key[some], tie[some]
        if not len(slots):
            continue
        sorting = np.lexsort((key, tie))
        order[slots] = order[slots][sorting]
        key, tie = key[sorting], tie[sorting]
        first[slots] |= np.concatenate([[True], (key[1:] != key[:-1]) | (tie[1:] != tie[:-1])])
    return order


def order_of(
    text: np.ndarray,
    included: np.ndarray,
    group: np.ndarray,
    depth: int,
    is_b: np.ndarray | None = None,
    words: np.ndarray | None = None,
) -> np.ndarray:
    """Included positions ordered by group and suffix.

    ``text`` holds bytes above 0, with 0 after each passage. With every included position of
    type A the one after it must be included too.
    """
    is_b = type_b(text) if is_b is None else is_b
    words = words_at(text) if words is None else words
    direct = np.flatnonzero(included & is_b)
    direct = sort_directly(direct, group[direct], words, depth)
    induced = included & ~is_b
    by_byte = [direct[text[direct] == c] for c in range(256)] if len(direct) else [direct] * 256
    chunks: list[list[np.ndarray]] = [[] for _ in range(256)]
    done = []

    def grouped(parts: list[np.ndarray]) -> np.ndarray:
        joined = np.concatenate(parts)
        return joined[np.argsort(group[joined], kind="stable")]

    for c in range(256):
        if not chunks[c] and not len(by_byte[c]):
            continue
        found = [grouped(chunks[c])] if chunks[c] else []
        while found:  # runs of the same byte
            before = found[-1] - 1
            before = before[induced[before] & (text[before] == c) & (found[-1] > 0)]
            if not len(before):
                break
            found.append(before)
        bucket = grouped([*found, by_byte[c]])
        done.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (text[before] > c)]
        values = text[before]
        sorting = np.argsort(values, kind="stable")
        before, values = before[sorting], values[sorting]
        edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else []
        for a, b in zip(edges, [*edges[1:], len(values)]):
            chunks[int(values[a])].append(before[a:b])
    return grouped(done) if done else np.empty(0, np.int64)


def same_prefix(left: np.ndarray, right: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Which pairs of positions have a common prefix of at least ``depth`` bytes."""
    out = np.ones(len(left), bool)
    at = np.arange(len(left))
    for offset in [*range(0, depth - 8, 8), depth - 8]:
        agree = words[left[at] + offset] == words[right[at] + offset]
        out[at[~agree]] = False
        at = at[agree]
    return out


def repeated_windows(
    passages: list[bytes], counts: np.ndarray, groups: np.ndarray, order: np.ndarray, depth: int
) -> np.ndarray:
    """Which windows of ``depth`` bytes come again: ``counts`` of each passage, one after the other.

    A window is marked if the same bytes stand in a passage of its group that comes earlier;
    ``order`` (two columns: document rank, first window's place) says which is earlier.
    """
    sizes = np.fromiter(map(len, passages), np.int64, len(passages)) + 1
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"\xff".join(passages) + b"\xff", np.uint8)
    if np.count_nonzero(raw == 255) != len(passages):
        raise ValueError("texts must be UTF-8")
    text = raw + np.uint8(1)  # 0xFF, which UTF-8 never has, becomes the separator 0
    is_b = type_b(text)
    b_places = np.flatnonzero(is_b)
    last = b_places[np.searchsorted(b_places, starts + counts - 1)]
    owner = np.repeat(np.arange(len(passages), dtype=np.int32), sizes)
    group = groups.astype(np.int32)[owner]
    place = np.arange(len(text)) - starts[owner]
    valid = place < counts[owner]
    included = place <= (last - starts)[owner]
    words = words_at(text)
    found = order_of(text, included, group, depth, is_b, words)
    found = found[valid[found]]
    marked = np.zeros(len(text), bool)
    if len(found):
        same = group[found][1:] == group[found][:-1]
        at = np.flatnonzero(same)
        same[at] = same_prefix(found[at], found[at + 1], words, depth)
        run = np.cumsum(np.concatenate([[True], ~same]))
        # Only runs of several windows are looked at further.
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        found, run = found[several], run[several]
        who = owner[found]
        earliest = np.lexsort((order[who, 1] + place[found], order[who, 0], run))
        first = np.concatenate([[True], run[earliest][1:] != run[earliest][:-1]])[: len(run)]
        marked[found[earliest[~first]]] = True
    return marked[valid]
