"""Exchange that brings equal windows of different documents together.

A window is W neighbouring units (bytes or words) of one document.  Which
windows also start in a document with a smaller id?  Shipping every window would
multiply the corpus, so the work is cut by *minimizers*: of the k-unit grams in a
window the one with the smallest hash is its anchor, and neighbouring windows
with the same anchor form one segment.  Anchors depend on a window's content
alone, so equal windows have equal anchors wherever they stand.

1. Each chunk of documents sends the 48-bit hashes of its distinct anchors to
   buckets by hash; a bucket answers, as a bit per hash, which ones another
   document has too.  A chunk sends a hash once however often it occurs, so a
   passage in a third of all documents costs one entry a chunk.
2. Segments of repeated anchors travel once per distinct content and chunk, with
   the smallest doc id, to buckets by anchor.  The bucket's resolver (suffix array
   or phrase automaton) compares whole contents and answers with the smallest doc
   id of each run of windows.
3. Each chunk marks its documents' windows whose smallest doc id is below theirs.

The chunked texts are one hash exchange which all three steps share.  Chunks and
buckets hold a fixed number of bytes, so their number follows the corpus; no step
sends anything but replies' bits and runs back, and nothing reaches the driver
except the corpus' size.  Exchanges have partitions by the root of the corpus' size
(parts_for): tasks times tasks, the blocks of an exchange, follow the corpus, and so
neither blocks nor tasks become too many or too large at any size.  A message holds
what a chunk has for a bucket, one hash at least, so there are never more messages
than distinct anchors of chunks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import SPACE_WORDS, byte_texts, equal_slices, give_back, gram_hashes, join_texts, mix, pieces, prefix_sums, slice_hashes, words_of

NO_ID = np.iinfo(np.int64).max
MASK48 = np.uint64((1 << 48) - 1)
#: resolver(contents, smallest ids) -> content, first window, last window, smallest id
Resolver = Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Windows:
    """window and gram are counted in units; words: units are words of spaces, else bytes."""

    window: int
    gram: int
    words: bool

    @property
    def span(self) -> int:
        return self.window - self.gram + 1


@dataclass
class Piece:
    """Documents of a chunk in one buffer; unit i is buf[at[i]:to[i]], document d has units lo[d]:hi[d]."""

    first: int
    buf: np.ndarray
    at: np.ndarray
    to: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    # segments: document, first and last window as unit numbers, anchor's hash
    doc: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    anchor: np.ndarray


def first_least(x: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` neighbours, the place of its least number, of equal ones the first."""
    place, span = np.arange(len(x)), 1
    while span < width:
        step = min(span, width - span)
        right = x[step:] < x[:-step]
        x = np.where(right, x[step:], x[:-step])
        place = np.where(right, place[step:], place[:-step])
        span += step
    return place


def cut(texts: list[bytes], spec: Windows) -> Iterator[Piece]:
    """The chunk's documents with their segments, a megabyte or a document at a time."""
    for a, b in pieces(texts):
        buf, starts, ends = join_texts(texts[a:b])
        if spec.words:
            ws, we, upto = words_of(buf, ends, SPACE_WORDS)
            keep = np.take(SPACE_WORDS, buf)
            keep[we] = True  # one byte after each word stays as its space
            length = we - ws
            to = np.cumsum(length + 1) - 1 if len(ws) else np.zeros(0, np.int64)
            buf = buf[keep]
            buf[to] = 0x20
            at = to - length
            lo, hi = np.concatenate([[0], upto[:-1]]).astype(np.int64), upto.astype(np.int64)
            grams = gram_hashes(slice_hashes(buf, at, to), spec.gram)
        else:
            at = np.arange(len(buf))
            to, lo, hi = at + 1, starts, ends
            sums, inverse = prefix_sums(buf)
            n = max(0, len(buf) - spec.gram + 1)
            with np.errstate(over="ignore"):
                grams = mix((sums[len(sums) - n :] - sums[:n]) * inverse[:n])
        least = first_least(grams, spec.span) if len(grams) >= spec.span else np.zeros(0, np.int64)
        count = np.maximum(0, hi - lo - spec.window + 1)
        edge = np.zeros(len(least) + 1, np.int8)
        some = count > 0
        np.add.at(edge, lo[some], 1)
        np.add.at(edge, (lo + count)[some], -1)
        inside = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
        spot = least[inside]
        if len(inside):
            begins = np.flatnonzero(np.concatenate([[True], (spot[1:] != spot[:-1]) | (inside[1:] != inside[:-1] + 1)]))
            start, stop = inside[begins], inside[np.concatenate([begins[1:], [len(inside)]]) - 1]
            anchor = grams[spot[begins]]
        else:
            start = stop = np.zeros(0, np.int64)
            anchor = np.zeros(0, np.uint64)
        yield Piece(a, buf, at, to, lo, hi, np.searchsorted(lo, start, "right") - 1, start, stop, anchor)


def spread(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor & MASK48) % np.uint64(buckets)).astype(np.int64)


def distinct_anchors(found: list[Piece], ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and 48-bit hash of each distinct anchor, in order, and whether two documents of the chunk have it."""
    anchor = np.concatenate([p.anchor for p in found]) & MASK48 if found else np.zeros(0, np.uint64)
    doc = np.concatenate([ids[p.doc + p.first] for p in found]) if found else np.zeros(0, np.int64)
    order = np.argsort(anchor, kind="stable")
    anchor, doc = anchor[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
    many = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
    distinct = anchor[first]
    bucket = spread(distinct, buckets)
    by = np.argsort(bucket, kind="stable")
    return bucket[by], distinct[by], many[by]


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Bucket, from and to of each run in sorted bucket numbers."""
    if len(bucket):
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(bucket[a]), a, b


def pack48(x: np.ndarray) -> bytes:
    """48-bit numbers as six planes, so that sorted numbers compress."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 5::-1].T.tobytes()


def unpack48(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 5::-1] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def rows(schema: pa.Schema, columns: list[list]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


ANCHORS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary()), ("many", pa.binary())])
FLAGS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
SEGMENTS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("least", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])
RUN = np.dtype([("content", "<u4"), ("first", "<u2"), ("last", "<u2"), ("least", "<i8")])


def load(table: pa.Table) -> tuple[np.ndarray, list[bytes], pa.Table]:
    table = table.sort_by([("id", "ascending"), ("text", "ascending")])
    ids = table["id"].to_numpy() if table.num_rows else np.zeros(0, np.int64)
    return np.asarray(ids, np.int64), byte_texts(table["text"]), table


def repeated_anchors(found: list[Piece], ids: np.ndarray, replies: pa.Table, buckets: int) -> np.ndarray:
    """Sorted 48-bit hashes of the chunk's anchors that two documents have."""
    bucket, distinct, _ = distinct_anchors(found, ids, buckets)
    bits = dict(zip(replies["bucket"].to_pylist(), replies["data"].to_pylist()))
    flags = np.zeros(len(distinct), bool)
    for k, a, b in by_bucket(bucket):
        if k in bits:
            flags[a:b] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=b - a).astype(bool)
    return np.sort(distinct[flags])


@dataclass
class Contents:
    """Distinct contents of a chunk's segments with repeated anchors, by bucket and hash."""

    bucket: np.ndarray
    least: np.ndarray
    piece: np.ndarray  # of one occurrence
    segment: np.ndarray
    which: list[np.ndarray]  # for each piece: segments taken
    content: list[np.ndarray]  # and their contents' numbers


def contents_of(found: list[Piece], ids: np.ndarray, repeated: np.ndarray, buckets: int, window: int) -> Contents:
    which = []
    for p in found:
        spot = np.searchsorted(repeated, p.anchor & MASK48)
        which.append(np.flatnonzero(repeated[np.minimum(spot, len(repeated) - 1)] == (p.anchor & MASK48)) if len(repeated) else np.zeros(0, np.int64))
    join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    # all pieces as one buffer, to compare contents byte by byte
    base = np.cumsum([0, *(len(p.buf) for p in found)])
    buf = join([p.buf for p in found], np.uint8)
    at = join([p.at[p.start[w]] + b for p, w, b in zip(found, which, base)], np.int64)
    size = join([p.to[p.stop[w] + window - 1] + b for p, w, b in zip(found, which, base)], np.int64) - at
    content = slice_hashes(buf, at, at + size)
    bucket = spread(join([p.anchor[w] for p, w in zip(found, which)], np.uint64), buckets)
    doc = join([ids[p.doc[w] + p.first] for p, w in zip(found, which)], np.int64)
    piece = np.repeat(np.arange(len(found)), [len(w) for w in which])
    segment = join(which, np.int64)
    order = np.lexsort((content, bucket))
    c, k = content[order], bucket[order]
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (k[1:] != k[:-1])]) if len(c) else np.zeros(0, bool)
    alike = np.flatnonzero(~new)
    if len(alike):
        one, two = order[alike], order[alike - 1]
        new[alike[(size[one] != size[two]) | ~equal_slices(buf, at[one], at[two], np.minimum(size[one], size[two]))]] = True
    first = np.flatnonzero(new)
    number = np.empty(len(c), np.int64)
    number[order] = np.cumsum(new) - 1
    cuts = np.cumsum([len(w) for w in which])[:-1]
    least = np.minimum.reduceat(doc[order], first) if len(first) else np.zeros(0, np.int64)
    one = order[first]
    return Contents(k[first], least, piece[one], segment[one], which, np.split(number, cuts) if found else [])


def thrifty(made: Callable) -> Callable:
    """A group's function after which free memory goes back to the system."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        out = made(key, table)
        give_back()
        return out

    def two(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        out = made(key, table, replies)
        give_back()
        return out

    return one if made.__code__.co_argcount == 2 else two


def parts_for(weight: int, block_bytes: int = 64 << 10) -> int:
    """Partitions of an exchange of weight bytes, so that a block (from one task to another) has block_bytes."""
    return max(1, math.isqrt(weight // block_bytes))


def mark_repeats(
    docs: DataFrame,
    spec: Windows,
    resolver: Resolver,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = 4 << 20,
    bucket_bytes: int = 8 << 20,
    carry: bool = False,
) -> DataFrame:
    """Removes each unit that a window covers which also starts in a document with a smaller id.

    Returns a row per input row: the id, n_units, n_removed, n_spans (maximal removed
    runs), kept_sha256 (of the kept bytes, or of the kept words joined by one space)
    and spans, an array of [from, to) unit numbers.  Null and empty texts have no
    units; a null id counts as larger than any other; rows with equal ids don't remove
    each other's units.  Other columns are left out; with carry they come back as the struct `rest`, and
    kept_text has what is kept.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)] if carry else []
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*others, F.lit(0).alias("_")).alias("rest"))
    total = source.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    weight = (total[0] or 0) + 16 * total[1]
    chunks, buckets, parts = max(1, weight // chunk_bytes), max(1, weight // bucket_bytes), parts_for(weight)
    # a row number isn't needed: equal ids may share a chunk, a null id is spread by its text
    texts = source.select("id", "text", *(["rest"] if carry else []), F.pmod(F.xxhash64(F.coalesce("id", F.crc32(F.coalesce("text", F.lit(""))))), F.lit(chunks)).alias("chunk"))
    by = lambda rows, key: rows.repartition(parts, key).groupBy(key)
    keyed = by(texts, "chunk")

    @thrifty
    def send_anchors(key: tuple, table: pa.Table) -> pa.Table:
        ids, data, _ = load(_filled(table))
        bucket, distinct, many = distinct_anchors(list(cut(data, spec)), ids, buckets)
        out: list[list] = [[], [], [], []]
        for k, a, b in by_bucket(bucket):
            for column, x in zip(out, (k, key[0].as_py(), pack48(distinct[a:b]), np.packbits(many[a:b]).tobytes())):
                column.append(x)
        return rows(ANCHORS, out)

    def answer_anchors(key: tuple, table: pa.Table) -> pa.Table:
        parts = [unpack48(x) for x in table["data"].to_pylist()]
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(p)) for m, p in zip(table["many"].to_pylist(), parts)])
        _, at, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        flag = (n >= 2) | (np.bincount(at, many, len(n)) > 0)
        bits = [np.packbits(x).tobytes() for x in np.split(flag[at], np.cumsum([len(p) for p in parts])[:-1])]
        return rows(FLAGS, [table["chunk"].to_pylist(), [key[0].as_py()] * len(parts), [0] * len(parts), bits])

    @thrifty
    def send_segments(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, data, _ = load(_filled(table))
        found = list(cut(data, spec))
        c = contents_of(found, ids, repeated_anchors(found, ids, replies, buckets), buckets, spec.window)
        raw = [p.buf.tobytes() for p in found]
        pack = zstandard.ZstdCompressor(level=1)
        out: list[list] = [[], [], [], [], []]
        for k, a, b in by_bucket(c.bucket):
            texts_, sizes = [], []
            for i, s in zip(c.piece[a:b].tolist(), c.segment[a:b].tolist()):
                p = found[i]
                x = raw[i][p.at[p.start[s]] : p.to[p.stop[s] + spec.window - 1]]
                texts_.append(x)
                sizes.append(len(x))
            for column, x in zip(out, (k, key[0].as_py(), c.least[a:b].astype("<i8").tobytes(), np.array(sizes, "<u4").tobytes(), pack.compress(b"".join(texts_)))):
                column.append(x)
        return rows(SEGMENTS, out)

    @thrifty
    def answer_segments(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        number: dict[bytes, int] = {}
        places, least = [], []
        for data, sizes, ids in zip(table["data"].to_pylist(), table["sizes"].to_pylist(), table["least"].to_pylist()):
            data, ends = zstandard.decompress(data), np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64).tolist()
            places.append(np.array([number.setdefault(data[a:b], len(number)) for a, b in zip([0, *ends[:-1]], ends)], np.int64))
            least.append(np.frombuffer(ids, "<i8"))
        smallest = np.full(len(number), NO_ID)
        for at, ids in zip(places, least):
            np.minimum.at(smallest, at, ids)
        content, first, last, low = resolver(list(number), smallest)
        order = np.lexsort((first, content))
        content, first, last, low = content[order], first[order], last[order], low[order]
        begin, end = np.searchsorted(content, np.arange(len(number))), np.searchsorted(content, np.arange(len(number)), "right")
        out: list[list] = [[], [], [], []]
        for chunk, at, ids in zip(table["chunk"].to_pylist(), places, least):
            n = end[at] - begin[at]
            local = np.repeat(np.arange(len(at)), n)
            run = np.arange(len(local)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at], n)
            useful = low[run] < ids[local]
            reply = np.zeros(int(useful.sum()), RUN)
            run, local = run[useful], local[useful]
            reply["content"], reply["first"], reply["last"], reply["least"] = local, first[run], last[run], low[run]
            if len(reply):
                for column, x in zip(out, (chunk, key[0].as_py(), 1, reply.tobytes())):
                    column.append(x)
        return rows(FLAGS, out)

    result = pa.schema([("id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])
    given = f", rest {source.schema['rest'].dataType.simpleString()}, kept_text string" if carry else ""

    @thrifty
    def finish(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, data, table = load(_filled(table))
        found = list(cut(data, spec))
        kind = replies["kind"].to_numpy() if replies.num_rows else np.zeros(0, np.int32)
        c = contents_of(found, ids, repeated_anchors(found, ids, replies.filter(pa.array(kind == 0)), buckets), buckets, spec.window)
        runs, base = [], {k: a for k, a, _ in by_bucket(c.bucket)}
        answers = replies.filter(pa.array(kind == 1))
        for k, x in zip(answers["bucket"].to_pylist(), answers["data"].to_pylist()):
            run = np.frombuffer(x, RUN)
            runs.append((run["content"].astype(np.int64) + base[k], run["first"].astype(np.int64), run["last"].astype(np.int64), run["least"]))
        # each content's own smallest id holds for all its windows
        runs.append((np.arange(len(c.least)), np.zeros(len(c.least), np.int64), np.full(len(c.least), -1), c.least))
        number, first, last, least = (np.concatenate(x) for x in zip(*runs))
        order = np.argsort(number, kind="stable")
        number, first, last, least = number[order], first[order], last[order], least[order]
        begin = np.searchsorted(number, np.arange(len(c.least) + 1))
        out: list[list] = [[], [], [], [], [], []]
        texts_: list[bytes | None] = []
        void = table["text"].is_null().to_pylist()
        for i, p in enumerate(found):
            seg, content = c.which[i], c.content[i]
            n = begin[content + 1] - begin[content]
            at = np.repeat(np.arange(len(seg)), n)
            run = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[content], n)
            hit = least[run] < ids[p.doc[seg[at]] + p.first]
            at, run = seg[at[hit]], run[hit]
            lo = p.start[at] + first[run]
            hi = np.where(last[run] < 0, p.stop[at], p.start[at] + last[run]) + spec.window
            change = np.zeros(len(p.at) + 1, np.int32)
            np.add.at(change, lo, 1)
            np.add.at(change, hi, -1)
            gone = np.cumsum(change[:-1]) > 0
            raw = p.buf.tobytes()
            for d, (a, b) in enumerate(zip(p.lo.tolist(), p.hi.tolist())):
                edges = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)) if b > a else np.zeros(0, np.int64)
                spans = edges.reshape(-1, 2)
                kept = b""
                if b > a:
                    parts, left = [], 0
                    for s, e in [*spans.tolist(), [b - a, b - a]]:
                        if s > left:
                            parts.append(raw[p.at[a + left] : p.to[a + s - 1]])
                        left = e
                    kept = (b" " if spec.words else b"").join(parts)
                if carry:
                    texts_.append(kept if len(spans) else None if void[p.first + d] else data[p.first + d])
                for column, x in zip(out, (table["real"][p.first + d].as_py(), b - a, int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans.tolist())):
                    column.append(x)
        done = rows(result, out)
        if carry:  # rows are in the sorted table's order
            done = done.append_column("rest", nullable(table["rest"])).append_column("kept_text", pa.array([None if t is None else t.decode("utf-8", "ignore") for t in texts_], pa.string()))
        return done

    flags = by(keyed.applyInArrow(send_anchors, _ddl(ANCHORS)), "bucket").applyInArrow(answer_anchors, _ddl(FLAGS))
    segments = keyed.cogroup(by(flags, "chunk")).applyInArrow(send_segments, _ddl(SEGMENTS))
    marks = by(segments, "bucket").applyInArrow(answer_segments, _ddl(FLAGS))
    done = keyed.cogroup(by(flags.unionByName(marks), "chunk")).applyInArrow(finish, _ddl(result) + given)
    return done.withColumnRenamed("id", id_col)


def nullable(column: pa.Array | pa.ChunkedArray) -> pa.Array | pa.ChunkedArray:
    """A struct column whose fields may all be null, as a declared schema has them."""
    return column.cast(pa.struct([f.with_nullable(True) for f in column.type]))


def _filled(table: pa.Table) -> pa.Table:
    """Keeps the given id as `real`; a null id counts as the largest."""
    real = table["id"]
    filled = pa.array([NO_ID if x is None else x for x in real.to_pylist()], pa.int64()) if real.null_count else real
    filled_table = pa.table({"id": filled, "text": table["text"], "real": real})
    return filled_table.append_column("rest", table["rest"]) if "rest" in table.column_names else filled_table


_NAMES = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string", pa.list_(pa.list_(pa.int64())): "array<array<long>>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_NAMES[f.type]}" for f in schema)
