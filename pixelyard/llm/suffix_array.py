"""Maximal repeats from an enhanced suffix array, and the byte-level deduplication that uses them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Windows, mark_repeats
from .textops import join_texts


def suffix_order(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes buf[at:at+size], and each one's common prefix with the one before it.

    Eight bytes at a time: only suffixes that still tie are compared further.  A
    suffix ends with its text; past the end it counts as zero bytes and the shorter
    comes first.
    """
    n = len(at)
    order = np.lexsort((size,))
    group = np.zeros(n, np.int64)  # by place: first place of its tie
    common = np.zeros(n, np.int64)
    live = np.arange(n)  # places that tie with a neighbour
    depth = 0
    longest = int(size.max()) if n else 0
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    while len(live) and depth < longest:
        item = order[live]
        left = size[item] - depth
        key = np.zeros(len(item), np.uint64)
        spot = np.minimum(at[item] + depth, len(buf))
        for j in range(8):
            byte = padded[spot + j].astype(np.uint64)
            byte[left <= j] = 0
            key = (key << np.uint64(8)) | byte
        by = np.lexsort((size[item], key, group[live]))
        item, key = item[by], key[by]
        order[live] = item
        tied = np.concatenate([[False], (group[live][1:] == group[live][:-1])])
        same = np.concatenate([[False], key[1:] == key[:-1]]) & tied
        apart = np.flatnonzero(tied & ~same)
        differ = key[apart] ^ key[apart - 1]
        equal = np.zeros(len(apart), np.int64)
        for j in range(8):  # leading equal bytes
            equal += (equal == j) & (((differ >> np.uint64(56 - 8 * j)) & np.uint64(255)) == 0)
        common[live[apart]] = depth + equal
        common[live[same]] = depth + 8
        start = np.where(same, 0, live)
        group[live] = np.maximum.accumulate(start)
        more = same | np.concatenate([same[1:], [False]])
        live = live[more]
        depth += 8
    if n:
        common[1:] = np.minimum(common[1:], np.minimum(size[order[1:]], size[order[:-1]]))
        common[0] = 0
    return order, common


def repeat_nodes(order: np.ndarray, common: np.ndarray, before: np.ndarray, least_length: int) -> Iterator[tuple[int, int, int]]:
    """Left-diverse intervals of the common-prefix interval tree: first place, last place, length.

    before: the byte in front of each suffix, below 0 (and unlike any other) where there is none.
    The tree is scanned with a stack, within blocks whose neighbours share least_length bytes.
    A block whose suffixes all follow the same byte is left out with all its nodes: one byte to the
    left, the same occurrences share a longer repeat.
    """
    n = len(order)
    if n < 2:
        return
    joined = common >= least_length
    joined[0] = False
    first = np.flatnonzero(~joined)
    last = np.concatenate([first[1:], [n]]) - 1
    left = before[order]
    wide = last > first
    diverse = (np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first)) | (np.minimum.reduceat(left, first) < 0)
    for a, b in zip(first[wide & diverse].tolist(), last[wide & diverse].tolist()):
        lcp, byte = common[a : b + 1].tolist(), left[a : b + 1].tolist()
        # stack entries: length, first place, the one byte before all (None: several)
        stack: list[list] = []
        for i in range(1, b - a + 2):
            length = lcp[i] if i <= b - a else least_length - 1
            start, seen = i - 1, byte[i - 1] if byte[i - 1] >= 0 else None
            while stack and stack[-1][0] > length:
                deep, start, other = stack.pop()
                seen = other if other == seen else None
                if seen is None:
                    yield a + start, a + i - 1, deep
            if length >= least_length:
                if stack and stack[-1][0] == length:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == seen else None
                else:
                    stack.append([length, start, seen])


def maximal_repeats(texts: list[bytes], least_length: int) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Each maximal repeat of at least least_length bytes with all its places (text, offset).

    A repeat is maximal if neither all places are followed by one byte nor all are preceded by one.
    """
    buf, starts, ends = join_texts(texts)
    count = np.maximum(0, ends - starts - least_length + 1)
    text = np.repeat(np.arange(len(texts)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + starts[text]
    size = ends[text] - at
    order, common = suffix_order(buf, at, size)
    before = np.where(at > starts[text], buf[np.maximum(at - 1, 0)].astype(np.int64), -1)
    for a, b, length in repeat_nodes(order, common, before, least_length):
        places = order[a : b + 1]
        yield bytes(buf[at[places[0]] : at[places[0]] + length]), sorted(zip(text[places].tolist(), (at[places] - starts[text[places]]).tolist()))


def resolve_segments(window: int):
    """Resolver for repeats.mark_repeats over bytes.

    Equal contents are one leaf of the array.  Every left-diverse node gives all its occurrences the
    smallest id below it, for each window inside its common prefix.
    """

    def resolve(contents: list[bytes], smallest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        buf, starts, ends = join_texts(contents)
        count = ends - starts - window + 1
        base = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(contents)), count)
        offset = np.arange(len(owner)) - base[owner]
        at = starts[owner] + offset
        order, common = suffix_order(buf, at, ends[owner] - at)
        before = np.where(offset > 0, buf[np.maximum(at - 1, 0)].astype(np.int64), -1)
        least = smallest[owner]
        for a, b, length in repeat_nodes(order, common, before, window):
            places = order[a : b + 1]
            low = smallest[owner[places]].min()
            inner = (places[:, None] + np.arange(length - window + 1)).ravel()
            least[inner] = np.minimum(least[inner], low)
        if not len(owner):
            return owner, owner, owner, least
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(owner)]]) - 1
        return owner[first], offset[first], offset[last], least[first]

    return resolve


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 50, gram: int = 24, **options: int) -> DataFrame:
    """Removes each byte in a string of min_bytes bytes that also starts in a document with a smaller id.

    Columns and cases: see repeats.mark_repeats; units are UTF-8 bytes.
    """
    return mark_repeats(docs, Windows(min_bytes, gram, words=False), resolve_segments(min_bytes), id_col, text_col, **options)
