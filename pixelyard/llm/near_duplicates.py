"""Near-duplicate documents: fast similarity sketching, banding, exact verification, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import FEW, Scratch, Table
from .textops import LOWER, SPACE_WORDS, gram_hashes, join_texts, mix, pieces, slice_hashes, text_pieces, words_of

FULL = np.uint64(2**64 - 1)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles as sorted 64-bit hashes; fewer words make one shingle, none no set."""
    sets: list[np.ndarray] = []
    for a, b in pieces(texts):
        buf, _, ends = join_texts([t.translate(LOWER) for t in texts[a:b]])
        starts, stops, upto = words_of(buf, ends, SPACE_WORDS)
        words = slice_hashes(buf, starts, stops)
        grams = gram_hashes(words, k)
        low = 0
        for high in upto.tolist():
            if high - low >= k:
                one = np.sort(grams[low : high - k + 1])
                keep = np.empty(len(one), bool)
                keep[0] = True
                np.not_equal(one[1:], one[:-1], out=keep[1:])
                sets.append(one[keep])
            else:
                sets.append(gram_hashes(words[low:high], high - low) if high > low else np.zeros(0, np.uint64))
            low = high
    return sets


def fast_sketch(sets: list[np.ndarray], size: int, seed: int = 1) -> np.ndarray:
    """Similarity sketches of `size` (a power of two) coordinates, a row per set.

    In round i < size each element falls into the bin that its i-th hash names, with a value in
    [i, i+1); in round size + i it falls into bin i.  A bin keeps its smallest value, so an earlier
    round wins, a set leaves as soon as all bins are filled, and after 2 * size rounds every bin of
    a set that isn't empty is.  Two sets agree in a bin with their Jaccard similarity as probability.
    """
    count = np.fromiter(map(len, sets), np.int64, len(sets))
    sketch = np.full(len(sets) * size, FULL)
    row = np.repeat(np.arange(len(sets)), count)
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    shift = np.uint64(8)
    for i in range(2 * size):
        if not len(element):
            break
        hashed = mix(element ^ mix(np.full(1, seed * 1000 + i + 1, np.uint64)))
        spot = (hashed & np.uint64(size - 1)).astype(np.int64) if i < size else np.full(len(element), i - size)
        np.minimum.at(sketch, row * size + spot, (np.uint64(min(i, 255)) << np.uint64(56)) | (hashed >> shift))
        open_ = (sketch.reshape(-1, size) == FULL).any(axis=1)[row]
        element, row = element[open_], row[open_]
    return sketch.reshape(-1, size)


def band_hashes(sketch: np.ndarray, rows: int) -> np.ndarray:
    bands = sketch.reshape(len(sketch), -1, rows)
    out = np.zeros(bands.shape[:2], np.uint64) + np.arange(bands.shape[1], dtype=np.uint64)
    for j in range(rows):
        out = mix(out ^ bands[:, :, j])
    return out


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges a-b of one partition: each node but the smallest of its component, with that smallest one."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y] = above.setdefault(y, y)
            x = above[x]
        return x

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = top(x), top(y)
            above[max(x, y)] = min(x, y)
    rows = [(x, r) for x in above if (r := top(x)) != x]
    for at in range(0, len(rows), 1 << 16):
        a, b = zip(*rows[at : at + (1 << 16)])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(links: DataFrame, scratch: Scratch) -> Table:
    """node and root (the smallest node reachable) for the nodes of links a-b, roots left out.

    Few links are one task's work.  Of more, each partition makes a forest of its own ones, in which a node has
    one root; nodes with several roots pass these on to the smallest one until each has one, and pointers are
    followed.
    """
    edges = scratch.keep(links.select("a", "b"))
    if edges.rows > FEW:
        given = edges
        edges = scratch.keep(given.df.mapInArrow(forest, "a long, b long"))
        scratch.drop(given)
    while edges.rows > FEW:
        up = scratch.keep(edges.df.groupBy("a").agg(F.min("b").alias("up"), F.max("b").alias("most")))
        if up.df.where("up <> most").isEmpty():
            scratch.drop(edges)
            while True:
                above = up.df.select(F.col("a").alias("up"), F.col("up").alias("top"))
                jumped = scratch.keep(up.df.select("a", "up").join(above, "up", "left").select("a", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
                scratch.drop(up)
                up = jumped
                if up.df.where("moved").isEmpty():
                    return Table(up.df.select(F.col("a").alias("node"), F.col("up").alias("root")), up.rows, up.path)
        others = edges.df.join(up.df, "a").where("b <> up").select(F.col("b").alias("a"), F.col("up").alias("b"))
        both = others.unionByName(up.df.select("a", F.col("up").alias("b"))).distinct()
        again = scratch.keep(both.repartition("b").mapInArrow(forest, "a long, b long"))
        scratch.drop(edges, up)
        edges = again
    done = scratch.keep(edges.df.coalesce(1).mapInArrow(forest, "a long, b long").toDF("node", "root")) if edges.rows else Table(edges.df.toDF("node", "root"), 0, edges.path)
    if edges.rows:
        scratch.drop(edges)
    return done


def compare(pairs: DataFrame, full: DataFrame, scratch: Scratch, changes: bool = False) -> DataFrame:
    """a, b, n and m (sizes of both sets) and shared (elements in common) of the pairs a-b, which are distinct.

    changes: instead of shared, a row for each element e that only one of the two has (null if there is none).
    The sets of all a of one b meet it in slices of bounded size, so b's set travels once a slice.
    """
    known = scratch.keep(pairs.select("a", "b"))
    some = full.select(F.col("rep").alias("a"), F.col("elements").alias("ea"))
    slices = known.df.groupBy("b").agg((F.floor(F.count(F.lit(1)) / SLICE) + 1).cast("int").alias("slices"))
    left = known.df.join(F.broadcast(slices) if known.rows <= FEW else slices, "b").withColumn("slice", F.pmod(F.xxhash64("a"), F.col("slices")).cast("int")).select("a", "b", "slice")
    left = some.join(F.broadcast(left) if known.rows <= FEW else left, "a")
    base = slices.select("b", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    base = full.select(F.col("rep").alias("b"), F.col("elements").alias("eb")).join(F.broadcast(base) if known.rows <= FEW else base, "b")

    def meet(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        lists = mine["ea"].combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.cumsum(size)
        for other in theirs["eb"]:
            against = other.values.to_numpy(zero_copy_only=False).view(np.uint64)
            spot = np.minimum(np.searchsorted(against, flat), max(0, len(against) - 1))
            hit = against[spot] == flat if len(against) else np.zeros(len(flat), bool)
            shared = np.diff(np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], ends])])
            if not changes:
                found = zip(out, (mine["a"].to_numpy(), size, np.full(len(size), len(against)), shared, np.ones(len(size), np.int64)))
                for column, x in found:
                    column.append(x)
                continue
            for i, (a, e) in enumerate(zip((ends - size).tolist(), ends.tolist())):
                gone = np.ones(len(against), bool)
                gone[spot[a:e][hit[a:e]]] = False
                made = np.concatenate([flat[a:e][~hit[a:e]], against[gone]]).view(np.int64)
                none = len(made) == 0
                k = max(1, len(made))
                for column, x in zip(out, (np.full(k, mine["a"][i].as_py()), np.full(k, e - a), np.full(k, len(against)), np.zeros(1, np.int64) if none else made, np.full(k, not none))):
                    column.append(x)
        a, n, m, last, some_ = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
        last = pa.array(last, pa.int64(), mask=~some_.astype(bool)) if changes else pa.array(last, pa.int64())
        return pa.table([pa.array(a, pa.int64()), pa.array(np.full(len(a), key[0].as_py()), pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), last], ["a", "b", "n", "m", "e" if changes else "shared"])

    return left.groupBy("b", "slice").cogroup(base.groupBy("b", "slice")).applyInArrow(meet, f"a long, b long, n long, m long, {'e' if changes else 'shared'} long")


#: sets, about, that meet another one in one slice
SLICE = 256


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    threshold: int = 75,
    size: int = 128,
    band_rows: int = 4,
    star_rounds: int = 4,
    rounds: int = 3,
    frequent_elements: int = 200_000,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= threshold * |union| of their sets of distinct
    shingles (A-Z lower-cased, words of spaces); component_id is the smallest id reachable.  Null,
    empty and blank texts have no shingles and are linked with nothing.  Rows with equal ids are one
    node.  A null id has component null and is kept.  Other columns are left out.

    Equal sets become one representative first.  Representatives that agree in a band of the sketch
    are candidates: with 32 bands of 4 rows a pair at 0.75 is missed with probability 5e-6, a group
    practically never.  Verification compares full sets.  It first tries each representative against
    one well-connected centre of its buckets, and then, a few times, those that none of a bucket's main
    label took in against a centre among themselves.  Where a bucket still has several labels, its members
    seek each other in two exact ways: those of one centre by their rarest changes to it, others by the
    leading elements of their sets, and if the latter would make many pairs, a few members of each label
    against new centres first.  So no candidate link is left out, and neither a group whose members are
    connected nor one of many texts just below the threshold costs all of its pairs.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_pieces(batch.column("text")):
                sets = shingle_sets(texts, shingle)
                bands = band_hashes(fast_sketch(sets, size), band_rows).view(np.int64)
                count = np.fromiter(map(len, sets), np.int64, len(sets))
                some = count > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands.shape[1])]), pa.int32()), pa.array(bands[some].ravel()))
                digest = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(count), digest, lists], ["id", "n_shingles", "digest", "bands"])

    sketched = scratch.keep(source.mapInArrow(sketch, "id long, n_shingles long, digest binary, bands array<long>"))
    usable = sketched.df.where("digest is not null and id is not null")
    heads = usable.groupBy("digest").agg(F.min(F.struct("id", "n_shingles", "bands")).alias("h"), F.count(F.lit(1)).alias("copies"))
    heads = scratch.keep(heads.select("digest", F.col("h.id").alias("rep"), F.col("h.n_shingles").alias("n"), "copies", "h.bands"))
    placed = heads.df.select("rep", "n", F.explode(F.array_distinct("bands")).alias("key"))
    crowd = placed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    members = scratch.keep(placed.join(crowd, "key"))

    # which representative a row has: itself unless its set is another row's too
    several = scratch.keep(heads.df.where("copies > 1").select("digest", "rep", "copies"))
    rows = sketched.df.select("id", "n_shingles", "digest")
    if several.rows > FEW:  # sets of many copies are no key of an exchange; there are FEW of these at most
        hot = several.df.where(F.col("copies") >= max(100, sketched.rows // FEW)).select("digest", F.col("rep").alias("often"))
        cold = several.df.where(F.col("copies") < max(100, sketched.rows // FEW)).select("digest", "rep")
        rows = rows.join(F.broadcast(hot), "digest", "left")
        salted = F.when(F.col("often").isNull(), F.col("digest"))  # null joins with nothing, dealt by its row's number
        rows = rows.withColumn("sought", F.coalesce(salted, F.concat(F.lit("-"), F.col("id").cast("string")).cast("binary")))
        rows = rows.join(cold.withColumnRenamed("digest", "sought"), "sought", "left").select("id", "n_shingles", "digest", F.coalesce("often", "rep").alias("rep"))
    else:
        rows = rows.join(F.broadcast(several.df.select("digest", "rep")), "digest", "left").select("id", "n_shingles", "digest", "rep")
    rows = rows.select("id", "n_shingles", F.when(F.col("digest").isNotNull() & F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"), F.col("digest").isNotNull().alias("some"))

    # ids with several texts: their representatives are one node
    ids = rows.where("id is not null and some").groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("a"))
    spread = scratch.keep(ids.where("a <> b"))
    doubled = rows.join(spread.hinted.select("id", "b"), "id").where("rep <> b").select(F.col("rep").alias("a"), "b") if spread.rows else None

    nodes = members.df.select(F.col("rep").alias("node"))
    nodes = nodes if doubled is None else nodes.unionByName(doubled.select(F.col("a").alias("node"))).unionByName(doubled.select(F.col("b").alias("node")))
    labels = scratch.keep(nodes.distinct().withColumn("root", F.col("node")))

    def merge(links: DataFrame) -> int:
        """Labels after links a-b between nodes; how many labels went."""
        nonlocal labels
        ends = links.join(labels.hinted.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(labels.hinted.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        merged = components(ends.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")), scratch)
        if merged.rows:
            top = merged.hinted.select(F.col("node").alias("root"), F.col("root").alias("top"))
            new = scratch.keep(labels.df.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
            scratch.drop(labels)
            labels = new
        scratch.drop(merged)
        return merged.rows

    if doubled is not None:
        merge(doubled)

    def finish() -> DataFrame:
        found = rows.join(labels.hinted.withColumnRenamed("node", "rep"), "rep", "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("root", "rep", "id")).alias("found"))
        return found.select(F.col("id").alias(id_col), "n_shingles", F.col("found").alias("component_id"), F.coalesce(F.col("found") == F.col("id"), F.lit(True)).alias("kept"))

    if not members.rows:
        return finish()

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_pieces(batch.column("text")):
                sets = shingle_sets(texts, shingle)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), lists], ["rep", "elements"])

    full_table = scratch.keep(source.join(labels.hinted.select(F.col("node").alias("id")), "id", "left_semi").mapInArrow(sets_of, "rep long, elements array<long>").where(F.size("elements") > 0))
    full = full_table.df

    def linked(n: str, m: str, shared) -> Column:
        return 100 * F.col(shared) >= threshold * (F.col(n) + F.col(m) - F.col(shared))

    def verify(pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs a-b that are linked."""
        return compare(pairs, full, scratch).where(linked("n", "m", "shared")).select("a", "b")

    # sets whose sizes alone rule a link out aren't compared
    fits = 100 * F.least("n", "m") >= threshold * F.greatest("n", "m")

    def offers(crowds: DataFrame) -> DataFrame:
        """a and b: each member of the crowds (key, rep, n, many) with the best-connected centre of its buckets.

        The centre of a bucket is the member whose buckets hold most: as a rule the text that others were copied from.
        """
        degree = scratch.keep(crowds.groupBy("rep").agg(F.sum("many").alias("degree")))
        ranked = crowds.join(degree.hinted, "rep").withColumn("first", -F.col("rep"))
        centre = ranked.groupBy("key").agg(F.max(F.struct("degree", "first", "n")).alias("c"))
        centre = scratch.keep(centre.select("key", (-F.col("c.first")).alias("b"), F.col("c.n").alias("m"), F.col("c.degree").alias("reach")))
        met = crowds.join(centre.hinted, "key").where((F.col("rep") != F.col("b")) & fits)
        met = met.groupBy("rep", "b").agg(F.count(F.lit(1)).alias("agree"), F.max("reach").alias("reach"))
        best = F.max(F.struct("agree", "reach", F.col("b").alias("to"))).alias("o")
        return met.groupBy("rep").agg(best).select(F.col("rep").alias("a"), F.col("o.to").alias("b"))

    homes = scratch.keep(offers(members.df))
    above = homes.hinted.select(F.col("a").alias("b"), F.col("b").alias("top"))
    found = homes.df
    for _ in range(2):  # a centre's own centre, so that a group has one
        found = found.join(above, "b", "left").select("a", F.coalesce("top", "b").alias("b"))
    tops = found.select(F.col("b").alias("a"), "b").distinct()
    housed = scratch.keep(found.unionByName(tops.join(found.select("a"), "a", "left_anti")))
    # against both its own centre and that one's centre
    merge(verify(homes.df.unionByName(housed.df).where("a <> b").distinct()))
    scratch.drop(homes)
    homes = housed

    def mixed(known: DataFrame) -> DataFrame:
        """Members of the keys that have several labels."""
        labelled = known.drop("label").join(labels.hinted.withColumnRenamed("node", "rep"), "rep").withColumnRenamed("root", "label")
        several = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        return labelled.join(several, "key", "left_semi")

    for _ in range(star_rounds):
        known = scratch.keep(mixed(members.df))
        if not known.rows:
            break
        weight = known.df.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
        main = weight.groupBy("key").agg(F.max(F.struct("c", "label")).alias("m")).select("key", F.col("m.label").alias("main"))
        minor = known.df.join(main, "key").where("label <> main").select("key", "rep", "n")
        minor = scratch.keep(minor.join(minor.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "key"))
        scratch.drop(known)
        # where few take each other in, more rounds of this won't settle the rest
        if not minor.rows or 8 * merge(verify(offers(minor.df))) < minor.df.select("rep").distinct().count():
            break

    # Two sets that are linked share one of the first n - ceil(threshold * n / 100) + 1 elements of each, in any
    # order of all elements that puts none apart.  Frequent elements go last here, so a passage that many texts
    # share makes no pairs of texts that have little else in common.  What counts as frequent comes from an
    # eighth of the sets; that only bends the order.
    open_ = scratch.keep(mixed(members.df).select("rep").distinct())
    scratch.drop(members)
    if not open_.rows:
        scratch.drop(full_table)
        return finish()
    unsettled = scratch.keep(full.join(open_.hinted, "rep", "left_semi")).df
    counted = unsettled.where(F.pmod(F.xxhash64("rep"), F.lit(8)) == 0).select(F.explode("elements").alias("e")).groupBy("e").count().where("count > 1")
    frequent = counted.orderBy(F.desc("count"), "e").limit(frequent_elements).toPandas().sort_values("e")
    shared = spark.sparkContext.broadcast((frequent["e"].to_numpy(np.int64), frequent["count"].to_numpy(np.int64)))

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, heat = shared.value
        for batch in batches:
            lists = batch.column("elements")
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            element = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            warm = np.zeros(len(element), np.int64)
            if len(hot):
                spot = np.minimum(np.searchsorted(hot, element), len(hot) - 1)
                warm = np.where(hot[spot] == element, heat[spot], 0)
            order = np.lexsort((element, warm, row))
            place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
            keep = place < np.repeat(size + (-threshold * size) // 100 + 1, size)
            row, element = row[order][keep], element[order][keep]
            yield pa.RecordBatch.from_arrays([pa.array(element), batch.column("rep").take(pa.array(row)), pa.array(size[row])], ["key", "rep", "n"])

    # Texts with one home (the centre they chose, or its centre) are told apart by what they changed in it: two
    # sets differ by the symmetric difference of their changes.  So homes link their texts with few changes, and
    # others need a number of changes in common that only rare ones are sought for.  Changes that no other text
    # made (own) are never in common; of the others (met) the rarest ones of each text suffice.
    t, s = 100 + threshold, 100 - threshold  # linked: t * difference <= s * sum of sizes
    once = scratch.keep(full.groupBy("rep").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("rep"))
    at_home = homes.df.join(open_.hinted.withColumnRenamed("rep", "a"), "a", "left_semi")
    for side in ("a", "b"):  # of an id with several sets it isn't said which one changed
        at_home = at_home.join(once.hinted.withColumnRenamed("rep", side), side, "left_anti")
    change = scratch.keep(compare(at_home, full, scratch, changes=True).toDF("rep", "home", "n", "of", "e"))
    makers = change.df.where("e is not null").groupBy("home", "e").agg(F.count(F.lit(1)).alias("makers")).where("makers > 1")
    change2 = scratch.keep(change.df.join(makers, ["home", "e"], "left"))
    scratch.drop(change)
    change = change2.df
    counts = change.groupBy("rep", "home").agg(F.max("n").alias("n"), F.max("of").alias("of"), F.count_if(F.col("e").isNotNull() & F.col("makers").isNull()).alias("own"), F.count("makers").alias("met"))
    d = F.col("own") + F.col("met")
    near_home = t * d <= s * (F.col("n") + F.col("of"))
    # changes in common with one of the other side at least: if that side is far from home, or (long) if it may be near
    common = lambda bound: F.floor(bound / (2 * t)) + 1
    short = F.col("met") - common(t * d + s * (F.col("of") - F.col("n"))) + 1
    long = F.col("met") - common(t * d - s * (F.col("of") + F.col("n"))) + 1
    bounds = scratch.keep(counts.select("rep", "home", "n", near_home.alias("inside"), short.alias("short"), long.alias("long"), (t * d - s * F.col("n")).alias("up"), (t * (F.col("own") - F.col("met")) - s * F.col("n")).alias("down")))
    merge(bounds.df.where("inside").select(F.col("rep").alias("a"), F.col("home").alias("b")))
    rarest = F.row_number().over(Window.partitionBy("rep", "home").orderBy("makers", "e"))
    sought = change.where("makers > 1").withColumn("place", rarest).select("rep", "home", "e", "place").join(bounds.df, ["rep", "home"])
    sought = sought.join(labels.hinted.withColumnRenamed("node", "rep"), "rep").withColumnRenamed("root", "label")
    one = sought.where("place <= short").select("home", "e", "rep", "n", "label", "up", "down", "inside")
    two = sought.where("not inside and place <= long").select("home", "e", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("label").alias("to"), F.col("up").alias("up2"), F.col("down").alias("down2"), (F.col("place") <= F.col("short")).alias("early"))
    may = (F.col("label") != F.col("to")) & fits & (F.col("up") + F.col("down2") <= 0) & (F.col("up2") + F.col("down") <= 0)
    pairs = one.join(two, ["home", "e"]).where(may & (F.col("inside") | (F.col("early") & (F.col("rep") < F.col("b")))))
    merge(verify(pairs.select(F.col("rep").alias("a"), "b").distinct()))
    scratch.drop(change2)

    # texts with different homes, or none
    house = F.coalesce("home", -1 - F.col("rep")).alias("home")
    lead = unsettled.mapInArrow(leading, "key long, rep long, n long").join(bounds.hinted.select("rep", "home"), "rep", "left").select("key", "rep", "n", house)
    apart = lead.groupBy("key").agg(F.min("home").alias("lo"), F.max("home").alias("hi")).where("lo <> hi").select("key")
    led = scratch.keep(mixed(lead.join(apart, "key", "left_semi")))
    for turn in range(rounds):
        known = scratch.keep(mixed(led.df))
        if not known.rows:
            break
        tally = known.df.groupBy("key", "home").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        members_, open_pairs = tally.agg(F.sum("s"), F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()
        last = open_pairs <= 4 * members_ + 10_000 or turn == rounds - 1
        away = F.col("home") != F.col("home2")
        if last:
            other = known.df.select("key", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("label").alias("to"), F.col("home").alias("home2"))
            pairs = known.df.join(other, "key").where("label < to")
        else:
            drawn = F.xxhash64("rep", F.lit(turn))
            probes = known.df.withColumn("place", F.row_number().over(Window.partitionBy("key", "label").orderBy(drawn))).where("place <= 3")
            new = known.df.groupBy("key").agg(F.min(F.struct(drawn.alias("drawn"), "rep", "n", "label", "home")).alias("c")).select("key", "c.*")
            new = new.select("key", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("label").alias("to"), F.col("home").alias("home2"))
            pairs = probes.join(new, "key").where("label <> to")
        merge(verify(pairs.where(fits & away).select(F.col("rep").alias("a"), "b").distinct()))
        scratch.drop(known)
        if last:
            break
    scratch.drop(full_table, led)
    return finish()
