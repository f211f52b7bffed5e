"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import nullable
from .shared import Scratch
from .textops import LETTER_WORDS, LOWER, join_texts, mix, slice_hashes, text_pieces, words_of

TABLE_BITS = 18


def spaced_words(texts: list[bytes], table: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words, each followed by one space: bytes, starts and ends of words, words up to each text's end."""
    buf, _, ends = join_texts(texts)
    starts, stops, upto = words_of(buf, ends, table)
    keep = np.take(table, buf)
    keep[stops] = True
    size = stops - starts
    to = np.cumsum(size + 1) - 1 if len(size) else size
    buf = buf[keep]
    buf[to] = 0x20
    return buf.tobytes(), to - size, to, upto


class WuManber:
    """Patterns of one length in words.

    A block is the last `block` words of the search window.  SHIFT says how far the window may move
    without passing an occurrence; where it is 0, the bucket of patterns with that last block is
    compared with the text word by word, and hits are confirmed on bytes.
    """

    def __init__(self, length: int, patterns: list[bytes]):
        self.length, self.patterns = length, patterns
        self.block = 1 if length < 3 else 2
        raw, at, to, _ = spaced_words(patterns, LETTER_WORDS)
        self.words = slice_hashes(np.frombuffer(raw, np.uint8), at, to).reshape(len(patterns), length)
        self.shift = np.full(1 << TABLE_BITS, length - self.block + 1, np.int64)
        for last in range(self.block, length + 1):
            np.minimum.at(self.shift, self.slot(self.blocks(self.words[:, last - self.block : last])), length - last)
        final = self.blocks(self.words[:, length - self.block :])
        self.order = np.argsort(final, kind="stable")
        self.final = final[self.order]

    def blocks(self, words: np.ndarray) -> np.ndarray:
        return mix(words[:, 0] * np.uint64(3) + (words[:, 1] if words.shape[1] > 1 else np.uint64(0)))

    @staticmethod
    def slot(block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, raw: bytes, words: np.ndarray, at: np.ndarray, to: np.ndarray, low: np.ndarray, high: np.ndarray, lane: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Starts (as word numbers) and patterns of all occurrences in texts that have words low:high.

        Texts are cut into lanes of possible starts, which move side by side.
        """
        m, b = self.length, self.block
        count = np.maximum(0, high - low - m + 1)
        lanes = -(-count // lane)
        begin = np.repeat(low, lanes) + lane * (np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        end = np.minimum(begin + lane, np.repeat(low + count, lanes))
        block = mix(words[:-1] * np.uint64(3) + words[1:]) if b == 2 else mix(words * np.uint64(3))
        jump = self.shift[self.slot(block)]
        stops = []
        while len(begin):
            move = jump[begin + m - b]
            stops.append(begin[move == 0])
            begin = begin + np.maximum(move, 1)
            on = begin < end
            begin, end = begin[on], end[on]
        start = np.concatenate(stops) if stops else np.zeros(0, np.int64)
        final = block[start + m - b]
        a, z = np.searchsorted(self.final, final), np.searchsorted(self.final, final, "right")
        n = z - a
        start = np.repeat(start, n)
        pattern = self.order[np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]
        same = np.ones(len(start), bool)
        for j in range(m):
            same[same] = words[start[same] + j] == self.words[pattern[same], j]
        start, pattern = start[same], pattern[same]
        sure = np.fromiter((raw[s:e] == self.patterns[p] for s, e, p in zip(at[start].tolist(), to[start + m - 1].tolist(), pattern.tolist())), bool, len(start))
        return start[sure], pattern[sure]


def compile_items(items: list[tuple[str, bytes]], window: int) -> tuple[list[WuManber], list[list[list[str]]]]:
    """A searcher for each length of window, and for each of its patterns the items that have it."""
    by_length: dict[int, dict[bytes, set[str]]] = {}
    raw, at, to, upto = spaced_words([t.translate(LOWER) for _, t in items], LETTER_WORDS)
    low = 0
    for (item, _), high in zip(items, upto.tolist()):
        n = min(window, high - low)
        for i in range(low, high - n + 1) if n else ():
            by_length.setdefault(n, {}).setdefault(raw[at[i] : to[i + n - 1]], set()).add(item)
        low = high
    lengths = sorted(by_length)
    return [WuManber(n, list(by_length[n])) for n in lengths], [[sorted(x) for x in by_length[n].values()] for n in lengths]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    block_bytes: int = 4 << 20,
    pass_bytes: int = 64 << 20,
    carry: bool = False,
) -> DataFrame:
    """One row per document: id, n_words, hits (array of [from, to) word numbers) and items (sorted ids as strings).

    Words are runs of digits, lower-cased letters and characters beyond ASCII.  A window is `window`
    consecutive words of an item, or the whole of an item with fewer; items without words have none.
    Null and empty documents have no words and no hits; null item ids are left out, repeated items count
    once.  Other columns are left out; with carry, text and the struct `rest` of all others come back.

    The benchmark is searched in blocks of items of about block_bytes bytes, each compiled and broadcast by
    itself.  Blocks of pass_bytes together are searched in one scan of the documents; where there are more,
    the documents with their hits so far are written to the shared folder between scans.  So neither the
    driver nor an executor holds more than one pass's tables, and there is no shuffle.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    context = docs.sparkSession.sparkContext
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*others, F.lit(0).alias("_")).alias("rest")] if carry else []))
    structs = {c: frame.schema[c].dataType.simpleString() for c in frame.columns if c != "id"}

    def searched(frame: DataFrame, blocks: list, kept: list[str]) -> DataFrame:
        """One pass: hits and items of the blocks, with those of passes before."""
        again = "hits" in frame.columns

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, last, texts in text_pieces(batch.column("text")):
                    part = batch.slice(first, last - first)
                    raw, at, to, upto = spaced_words([t.translate(LOWER) for t in texts], LETTER_WORDS)
                    words = slice_hashes(np.frombuffer(raw, np.uint8), at, to)
                    low = np.concatenate([[0], upto[:-1]])
                    change = np.zeros(len(words) + 1, np.int32)
                    found: list[set[str]] = [set(x) for x in part.column("items").to_pylist()] if again else [set() for _ in range(last - first)]
                    if again:
                        for d, spans in enumerate(part.column("hits").to_pylist()):
                            for start, stop in spans:
                                change[low[d] + start] += 1
                                change[low[d] + stop] -= 1
                    for block in blocks:
                        for searcher, owners in zip(*block.value):
                            start, pattern = searcher.search(raw, words, at, to, low, upto)
                            np.add.at(change, start, 1)
                            np.add.at(change, start + searcher.length, -1)
                            for d, p in set(zip((np.searchsorted(upto, start, "right")).tolist(), pattern.tolist())):
                                found[d].update(owners[p])
                    inside = np.cumsum(change[:-1]) > 0
                    hits = []
                    for a, z in zip(low.tolist(), upto.tolist()):
                        cut = inside[a:z]
                        hits.append(np.flatnonzero(np.diff(cut.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist() if cut.any() else [])
                    given = [nullable(part.column(c)) if c == "rest" else part.column(c) for c in kept]
                    results = [pa.array(upto - low, pa.int64()), pa.array(hits, pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([part.column("id"), *given, *results], ["id", *kept, "n_words", "hits", "items"])

        return frame.mapInArrow(search, "id long, " + "".join(f"{c} {structs[c]}, " for c in kept) + "n_words long, hits array<array<long>>, items array<string>")

    blocks, batch, size, held = [], [], 0, 0
    for row in items.orderBy("item").toLocalIterator():
        if size >= block_bytes:
            blocks.append(context.broadcast(compile_items(batch, window)))
            held += size
            batch, size = [], 0
        if held >= pass_bytes:
            frame = Scratch(frame.sparkSession).keep(searched(frame, blocks, list(structs))).df
            for block in blocks:
                block.destroy()
            blocks, held = [], 0
        batch.append((row["item"], row["text"].encode()))
        size += len(batch[-1][1])
    blocks.append(context.broadcast(compile_items(batch, window)))
    return searched(frame, blocks, list(structs) if carry else []).withColumnRenamed("id", id_col)


def contamination(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (a twentieth of the words is hit, or more) to find_contamination's rows."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    found = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
