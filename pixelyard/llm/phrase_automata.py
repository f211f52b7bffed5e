"""Recurring phrases confirmed, compiled into sharded Aho-Corasick automata, and located everywhere."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .repeats import NO_ID, Windows, mark_repeats
from .textops import gram_hashes, mix


def resolve_phrases(window: int):
    """Resolver for repeats.mark_repeats over words: one bucket is one shard.

    A window recurs if two documents have it.  Neighbouring windows that recur in the same contents at
    the same distance form one passage; the passages are the automaton's phrases, over word numbers.
    All of the shard's contents, which every document with one of its anchors sent, are streamed
    through it; each occurrence gives its passage the content's smallest id, and each passage's
    smallest id holds for the windows of all its occurrences.
    """

    def resolve(contents: list[bytes], smallest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        words = [c.split(b" ") for c in contents]
        size = np.fromiter(map(len, words), np.int64, len(words))
        code = pd.factorize(np.array([w for ws in words for w in ws], object))[0].astype(np.int64) + 1
        begin = np.cumsum(size) - size
        count = size - window + 1
        owner = np.repeat(np.arange(len(words)), count)
        offset = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        place = begin[owner] + offset
        hashed = gram_hashes(mix(code.astype(np.uint64)), window)[place]
        _, group = np.unique(hashed, return_inverse=True)
        members = np.bincount(group)
        # where a group's members stand, and where they would stand one window earlier
        here, back = np.zeros(len(members), np.uint64), np.zeros(len(members), np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(here, group, mix(place.astype(np.uint64)))
            np.add.at(back, group, mix((place - 1).astype(np.uint64)))
        follows = np.zeros(len(owner), bool)
        follows[1:] = (owner[1:] == owner[:-1]) & (here[group[:-1]] == back[group[1:]])
        first = np.flatnonzero(~follows)
        last = np.concatenate([first[1:], [len(owner)]]) - 1
        # a passage stands in several contents, or in one that several documents of different chunks or
        # one chunk share; the latter changes nothing but is located all the same
        _, one = np.unique(group[first], return_index=True)
        stream = np.zeros(len(code) + len(words), np.int64)  # number 0 parts the contents
        shift = np.repeat(np.arange(len(words)), size)
        stream[np.arange(len(code)) + shift] = code
        stream = stream.tolist()
        source = begin + np.arange(len(words))
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        length = []
        for passage, run in enumerate(one.tolist()):
            a = int(source[owner[first[run]]] + offset[first[run]])
            n = int(last[run] - first[run]) + window
            automaton.add_word(tuple(stream[a : a + n]), passage)
            length.append(n)
        if not length:
            return none, none, none, none
        automaton.make_automaton()
        hits = np.fromiter((x for hit in automaton.iter(tuple(stream)) for x in hit), np.int64).reshape(-1, 2)
        stop, passage = hits[:, 0], hits[:, 1]
        start = stop - np.array(length, np.int64)[passage] + 1
        content = np.searchsorted(source, start, "right") - 1
        least = np.full(len(length), NO_ID)
        np.minimum.at(least, passage, smallest[content])
        return content, start - source[content], stop - source[content] - window + 1, least[passage]

    return resolve


def phrase_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 5, bucket_bytes: int = 4 << 20, **options: int) -> DataFrame:
    """Removes each word in a passage of `window` words that also starts in a document with a smaller id.

    Columns and cases: see repeats.mark_repeats; units are words of spaces.
    """
    return mark_repeats(docs, Windows(window, gram, words=True), resolve_phrases(window), id_col, text_col, bucket_bytes=bucket_bytes, **options)
