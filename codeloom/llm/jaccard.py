"""Operator 4: Jaccard self-join over word n-grams with adaptive multi-match prefixes.

Texts are lower-cased (A-Z) and cut at ASCII white space; a document is its set of distinct n-word shingles, held as
64-bit hashes.  Documents with equal word sequences are one entity from the start.

1. One pass counts all shingles in a sketch of fixed size; its counts give the global order, rare first.
2. A second pass emits each entity's prefix.  Two sets that reach the threshold share at least ``l`` shingles among
   their first ``n - needed + l``; each entity takes the ``l`` that costs least, by the estimated frequencies of its
   prefix (longer prefix: more rows to scan) against candidates left to verify (fewer, as they must share more).  A
   pair is a candidate if it shares as many as the smaller ``l`` of the two.
3. Shingles in at most ``BUCKET`` prefixes give candidate pairs by an equi-join, whose sets are then compared: no prefix
   row has more than half as many pairs, however large the table.
4. Entities that are connected by more frequent prefix shingles form a family.  Its shingles give pairs too if these cost
   less than its sets in blocks (a wide family of small, loosely connected groups); copies of one text, whose every
   prefix shingle would give each pair again, never do.  Of all other families no shingle gives pairs.  Where the
   numbers of links are asked for, a family is split into bands of length (only neighbouring bands can match) and blocks of
   bounded size; a task compares two blocks by matrix products and returns links counted for each entity and a spanning
   forest, not the pairs.  Where only classes are asked for (``count_links=False``), pairs that are connected already are
   left out: in a few rounds all of a family of several blocks is compared with a few pivots among those not yet linked to
   any, and only what stays open meets the family in blocks.  Members of two pivots can link only if the pivots' Jaccard distance is no more
   than three times that of a link (it is a metric), else their pairs are left out too.
5. Components of all links; the class of a document is the smallest doc_id in it.

No candidate is dropped: a pair that shares a shingle of a family is in that family, any other pair has all its shared
shingles in the equi-join.  Sketch and blocks have fixed bounds.

Defined results: a document without words (null or empty text too) has an empty set, is its own class and has no link;
with fewer than n words its whole sequence is its one shingle; copies link to each other; a null doc_id takes part, and
a class of null ids only is null; repeated rows are repeated in the result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from codeloom.llm.common import mapped, renamed, stored, table
from codeloom.llm.components import components

#: Counters of the sketch, as a power of two, and into how many parts it is dealt.
SKETCH_BITS = 22
PARTS = 64
#: Prefixes that one shingle may join pair by pair in any case, and what a pair costs, counted in shingles of a set in a block.
BUCKET, PAIR = 64, 8
#: Rounds of pivots at most, and pivots of a family in each; the last round is one that links a smaller share of what was open.
MOST_ROUNDS, PIVOTS, GAIN = 3, 4, 0.2
#: Most matches asked of a pair.
MOST_MATCHES = 4
#: A block of a family: entities and shingles.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Slots in which documents whose sets are needed are marked, as a power of two.
SLOT_BITS = 24
_REMEMBERED = 200_000

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of k words, of the whole sequence if it is shorter."""
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - k + 1
    x = h[:n] * _M[0]
    for i in range(1, k):
        x ^= x >> np.uint64(29)
        x = (x + h[i : i + n]) * _M[i % 3]
    x ^= x >> np.uint64(31)
    return np.unique(x * _M[2])


def needed(n, num: int, den: int):
    """The least overlap of a set of n with any set that it matches."""
    return -(-n * num // den)


def _documents(batch: pa.RecordBatch):
    """(row, words, 16-byte name of the word sequence) of each row."""
    import xxhash

    for i, x in enumerate(batch.column(1)):
        words = x.as_buffer().to_pybytes().lower().split() if x.is_valid else []
        yield i, words, xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def _count(k: int, bits: int):
    """doc_id, e, n of each document, and at a partition's end its part of the sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("e", pa.binary()), ("n", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts, held, size, seen = np.zeros(1 << bits, np.uint32), [], 0, {}
        none = None
        for b in batches:
            es, ns = [], []
            for _, words, e in _documents(b):
                if e not in seen:
                    g = shingle_set(words, k)
                    if len(seen) >= _REMEMBERED:
                        seen.clear()
                    seen[e] = len(g)
                    held.append(g >> np.uint64(64 - bits))
                    size += len(g)
                    if size >= 1 << 20:
                        counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits).astype(np.uint32)
                        held, size = [], 0
                es.append(e)
                ns.append(seen[e])
            none = pa.nulls(len(es))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(es, pa.binary()), pa.array(ns, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        if held:
            counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        if none is not None:
            parts = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in counts.reshape(PARTS, -1)]
            none = pa.nulls(PARTS)
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int64()), pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return run


def _add_up(batches):
    """The sum of each part of the sketch, as levels: eight to a doubling."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(raw), "<u4").astype(np.uint64)
            sums[chunk] = sums[chunk] + x if chunk in sums else x
    if sums:
        levels = [np.minimum(255, 8 * np.log2(1 + x)).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["chunk", "counts"])


def prefix(g: np.ndarray, level: np.ndarray, num: int, den: int, most: int = MOST_MATCHES) -> tuple[np.ndarray, int]:
    """The chosen prefix of a set in global order (by level, then hash), and how many matches it asks for."""
    n = len(g)
    least = int(needed(n, num, den))
    order = np.lexsort((g, level))
    lengths = n - least + np.arange(1, min(most, least) + 1)
    scan = np.cumsum(np.exp2(level[order[: lengths[-1]]] / 8.0))[lengths - 1]
    verify = 1 + n / 16
    best = int(np.argmin(scan * (1 + verify / np.arange(1, len(lengths) + 1))))
    return g[order[: lengths[best]]], best + 1


def _prefixes(k: int, bits: int, levels, frequent: int, num: int, den: int):
    """``frequent``: the level from which a shingle may stand in very many prefixes."""
    schema = pa.schema([("token", pa.int64()), ("e", pa.binary()), ("n", pa.int32()), ("l", pa.int32()), ("often", pa.bool_())])

    def run(batches):
        level, seen = levels.value, set()
        for b in batches:
            tokens, names, sizes, asked, often = [], [], [], [], []
            for i, words, e in _documents(b):
                if e is not None and e not in seen:
                    if len(seen) >= _REMEMBERED:
                        seen.clear()
                    seen.add(e)
                    g = shingle_set(words, k)
                    p, l = prefix(g, level[(g >> np.uint64(64 - bits)).astype(np.int64)], num, den)
                    tokens.append(p)
                    names += [e] * len(p)
                    sizes.append(np.full(len(p), len(g), np.int32))
                    asked.append(np.full(len(p), l, np.int32))
                    often.append(level[(p >> np.uint64(64 - bits)).astype(np.int64)] >= frequent)
                if tokens and (len(names) > 100_000 or i + 1 == b.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(names, pa.binary()), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(asked)), pa.array(np.concatenate(often))], schema=schema)
                    tokens, names, sizes, asked, often = [], [], [], [], []

    return run


def _slot(id_col: str):
    return F.pmod(F.xxhash64(id_col), F.lit(1 << SLOT_BITS).cast("long"))


def _marked(ids: DataFrame, id_col: str) -> np.ndarray:
    """A bit for each slot that an id of this column has; at most 2**SLOT_BITS / 64 rows come to the driver."""
    slots = ids.select(_slot(id_col).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    marks = np.zeros((1 << SLOT_BITS) // 64, np.uint64)
    marks[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return marks


def _sets(k: int, marks):
    """Sets of the documents whose slot is marked; a few others may share a slot."""
    schema = pa.schema([("e", pa.binary()), ("g", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            slot = b.column(2).to_numpy()
            b = b.filter(pa.array((marks.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1))
            names, sets, size = [], [], 0
            for i, words, e in _documents(b):
                if e is not None:
                    names.append(e)
                    sets.append(shingle_set(words, k).view(np.int64))
                    size += len(sets[-1])
                if names and (size > 1 << 20 or i + 1 == b.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], schema=schema)
                    names, sets, size = [], [], 0

    return run


def overlaps(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of all intersections of a block's sets, by matrix products over the shingles that occur twice."""
    m = len(sets)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(g) for g in sets])
    twice = count > 1
    at = np.cumsum(twice) - 1
    use = twice[col]
    row, col = row[use], at[col[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((m, m), np.float32)
    for a in range(0, int(twice.sum()), columns):
        lo, hi = np.searchsorted(col, [a, a + columns])
        x = np.zeros((m, columns), np.float32)
        x[row[lo:hi], col[lo:hi] - a] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _compare(num: int, den: int):
    """Of one pair of blocks: for each entity the documents it links with, and the smallest entity it reaches."""

    def run(key, pdf):
        import pandas as pd

        one = not key[1] and (key[2], key[3]) == (key[4], key[5])
        pdf = pdf.sort_values("e", ignore_index=True)
        sets = [np.asarray(g, np.int64) for g in pdf["g"]]
        n = np.array([len(g) for g in sets])
        i = overlaps(sets)
        link = i * den >= num * (n[:, None] + n[None, :] - i)
        np.fill_diagonal(link, False)
        if not one:
            first = pdf["first"].to_numpy()
            link &= first[:, None] != first[None, :]
        root = np.arange(len(n))
        while True:
            new = np.minimum(root, np.where(link, root[None, :], len(n)).min(axis=1))
            new = new[new]
            if (new == root).all():
                break
            root = new
        links = link @ pdf["copies"].to_numpy()
        some = links > 0
        return pd.DataFrame({"a": pdf["e"][some], "b": pdf["e"].to_numpy()[root[some]], "links": links[some]})

    return run


def _split(shared: DataFrame, bucket: int | None) -> tuple[DataFrame, DataFrame]:
    """Prefix rows that are joined pair by pair; and e, family of the entities that meet in blocks.

    ``bucket``: beyond it all families meet in blocks, whatever they cost.
    """
    seldom, often = (shared.where(F.col("c") <= (bucket or BUCKET)), shared.where(F.col("c") > (bucket or BUCKET)))
    if often.isEmpty():
        return seldom, often.select("e", F.col("e").alias("family"))
    centre = often.groupBy("token").agg(F.min("e").alias("b"))
    family = components(often.join(centre, "token").select(F.col("e").alias("a"), "b").distinct()).select(F.col("node").alias("e"), F.col("root").alias("family"))
    rows = stored(often.join(family, "e").select(*shared.columns, "family"), "frequent")
    members = stored(rows.groupBy("family", "e").agg(F.first("n").alias("n"), F.sum((F.col("c") - 1) / 2).alias("pairs")), "members")
    if bucket:
        return seldom, members.select("e", "family")
    cost = members.groupBy("family").agg(F.sum("pairs").alias("pairs"), (F.sum("n") * (1 + F.count("*") / BLOCK)).alias("blocks"))
    cheap = stored(cost.where(F.col("pairs") * PAIR <= F.col("blocks")).select("family"), "cheap")
    if cheap.isEmpty():
        return seldom, members.select("e", "family")
    return seldom.unionByName(rows.join(cheap, "family", "left_semi").select(shared.columns)), members.join(cheap, "family", "left_anti").select("e", "family")


def _members(family: DataFrame, sets: DataFrame) -> DataFrame:
    """e, g, copies, family of the entities that meet in blocks."""
    return stored(sets.join(family, "e").select("e", "g", "copies", "family"), "families")


def _by_blocks(members: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, links) of each compared pair of blocks of a family, from columns e, g, copies, family, side.

    Side 0 is compared with itself; sides 1 and 2 with each other.
    """
    own = members.withColumn("band", F.floor(F.log(F.size("g").cast("double")) / float(np.log(den / num)) + 1e-9).cast("int"))
    sizes = own.groupBy("family", "side", "band").agg(F.count("*").alias("c"), F.sum(F.size("g")).alias("s"))
    sizes = stored(sizes.select("family", "side", "band", F.ceil(F.greatest(F.col("c") / BLOCK, F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "bands")
    near = own.join(sizes, ["family", "side", "band"])
    other = sizes.withColumn("side", F.expr("if(side = 0, 0, 3 - side)"))
    for name, by in (("level", 0), ("above", -1), ("below", 1)):
        near = near.join(other.select("family", "side", (F.col("band") + by).alias("band"), F.col("blocks").alias(name)), ["family", "side", "band"], "left")
    near = near.withColumn("block", F.expr("cast(pmod(xxhash64(e), blocks) as int)"))
    # a block meets the blocks of its own band and of those beside it; side 1, else the lower band, comes first
    meets = F.expr(
        """if(side = 0, concat(
            transform(sequence(0, blocks - 1), t -> struct(band as band1, least(block, t) as block1, band as band2, greatest(block, t) as block2, block <= t as first)),
            if(above is null, array(), transform(sequence(0, above - 1), t -> struct(band as band1, block as block1, band + 1 as band2, t as block2, true as first))),
            if(below is null, array(), transform(sequence(0, below - 1), t -> struct(band - 1 as band1, t as block1, band as band2, block as block2, false as first)))),
        flatten(transform(filter(array(struct(band as at, level as many), struct(band + 1 as at, above as many), struct(band - 1 as at, below as many)), x -> x.many is not null), x ->
            transform(sequence(0, x.many - 1), t -> struct(if(side = 1, band, x.at) as band1, if(side = 1, block, t) as block1, if(side = 1, x.at, band) as band2, if(side = 1, t, block) as block2, side = 1 as first)))))"""
    )
    dealt = near.select("e", "g", "copies", "family", (F.col("side") > 0).alias("apart"), F.explode(meets).alias("m")).select("e", "g", "copies", "family", "apart", "m.*")
    found = dealt.groupBy("family", "apart", "band1", "block1", "band2", "block2").applyInPandas(_compare(num, den), "a binary, b binary, links long")
    return stored(found, "family-links")


def _overlaps(df: DataFrame, x: str, y: str, num: int, den: int):
    """Whether the sets of two columns have this Jaccard similarity."""
    i = F.size(F.array_intersect(x, y)).cast("long")
    return i * den >= (F.size(x) + F.size(y) - i) * num


def _joined(pairs: pa.Table) -> pa.Table:
    """Of one family's pivots: the least that each is tied to."""
    root: dict[bytes, bytes] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    a, b = pairs["pivot"].to_pylist(), pairs["other"].to_pylist()
    for x, y in zip(a, b, strict=True):
        lo, hi = sorted((find(x), find(y)))
        root[hi] = lo
    return pa.table({"pivot": pa.array(list(root), pa.binary()), "home": pa.array([find(x) for x in root], pa.binary())})


def _by_pivots(members: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that connect whatever links connect in a family; and the rows that were compared in blocks."""
    # a family of one block is compared at once
    sizes = members.groupBy("family").agg(F.count("*").alias("c"), F.sum(F.size("g")).alias("s"))
    large = stored(sizes.where((F.col("c") > BLOCK) | (F.col("s") > BLOCK_SHINGLES)).select("family"), "large")
    if large.isEmpty():
        return _by_blocks(members.withColumn("side", F.lit(0)), num, den).select("a", "b"), members
    small, big = members.join(large, "family", "left_anti"), stored(members.join(large, "family", "left_semi"), "big")
    open_, hits, chosen = big.select("e", "family"), None, None
    left = open_.count()
    for r in range(MOST_ROUNDS):
        place = F.row_number().over(Window.partitionBy("family").orderBy(F.xxhash64("e", F.lit(r)), "e"))
        picked = open_.withColumn("place", place).where(F.col("place") <= PIVOTS).select("family", F.col("e").alias("pivot"))
        pivots = stored(picked.join(big.select(F.col("e").alias("pivot"), F.col("g").alias("pg")), "pivot"), "pivots")
        hit = stored(big.join(pivots, "family").where(_overlaps(big, "g", "pg", num, den)).select("family", "e", "pivot"), "linked")
        hits, chosen = (hit, pivots) if hits is None else (hits.unionByName(hit), chosen.unionByName(pivots))
        open_ = stored(open_.join(hit.select("e").distinct(), "e", "left_anti"), "open", open_)
        before, left = left, open_.count()
        if not left or before - left < GAIN * before:
            break
    # members of one pivot are connected, and so are pivots with a member in common: a few pairs of each family
    least = hits.groupBy("family", "e").agg(F.min("pivot").alias("least"), F.collect_set("pivot").alias("all"))
    least = stored(least, "least")
    ties = least.select("family", F.col("least").alias("pivot"), F.explode("all").alias("other")).distinct()
    root = stored(ties.groupBy("family").applyInArrow(_joined, "pivot binary, home binary"), "homes")
    linked = big.join(least.select("e", F.col("least").alias("pivot")), "e").join(root, "pivot").select("e", "g", "copies", "family", "home")
    linked, rest = stored(linked, "linked"), big.join(open_.select("e"), "e", "left_semi")
    columns = ["e", "g", "copies", "family", "side"]
    groups = small.unionByName(rest).withColumn("side", F.lit(0)).select(columns)
    # what is open against the linked members of its family
    wide = F.concat(F.lit(b"open"), F.col("family"))
    if left:
        some = open_.select("family").distinct()
        groups = groups.unionByName(rest.withColumn("family", wide).withColumn("side", F.lit(1)).select(columns))
        groups = groups.unionByName(linked.join(some, "family", "left_semi").withColumn("family", wide).withColumn("side", F.lit(2)).select(columns))
    # and the members of two pivots that no member has joined, if these are near enough
    homes = chosen.join(root, "pivot").select("family", "pg", "home")
    p, q = homes.select("family", F.col("pg").alias("x"), F.col("home").alias("hx")), homes.select("family", F.col("pg").alias("y"), F.col("home").alias("hy"))
    pairs = stored(p.join(q, "family").where("hx < hy").where(_overlaps(p, "x", "y", 3 * num - 2 * den, den)).select("hx", "hy").distinct(), "near-homes")
    if not pairs.isEmpty():
        for side, home in ((1, "hx"), (2, "hy")):
            both = linked.join(pairs.withColumn("home", F.col(home)), "home")
            groups = groups.unionByName(both.withColumn("family", F.concat("hx", "hy")).withColumn("side", F.lit(side)).select(columns))
    found = _by_blocks(groups, num, den).select("a", "b")
    return hits.where("e <> pivot").select(F.col("e").alias("a"), F.col("pivot").alias("b")).unionByName(found), groups


def with_entity(df: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """The same rows with the name of their text's word sequence, null where there are no words."""

    def run(batches):
        for b in batches:
            t = b.column(b.schema.names.index(text_col))
            es = [e for _, _, e in _documents(pa.RecordBatch.from_arrays([t, t], names=["doc_id", "text"]))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(es, pa.binary())], names=[*b.schema.names, name])

    return mapped(df, run, StructType([*df.schema.fields, StructField(name, BinaryType())]))


def entity_classes(df: DataFrame, *, words: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", bucket: int | None = None, sketch_bits: int = SKETCH_BITS, count_links: bool = True) -> tuple[DataFrame, DataFrame]:
    """doc_id, e, n of every document; and e, root (which names the class), component, links of each entity with words.

    ``links`` is null without ``count_links``, which leaves out pairs that are connected already; ``bucket`` fixes the
    number of prefixes beyond which a shingle's entities meet in blocks, which follows from the cost else.
    """
    spark, docs = df.sparkSession, renamed(df, id_col, text_col)
    passed = stored(mapped(docs, _count(words, sketch_bits), "doc_id long, e binary, n long, chunk int, counts binary"), "shingles")
    names = passed.where("chunk is null").select("doc_id", "e", "n")
    summed = mapped(passed.where("chunk is not null").select("chunk", "counts").repartition("chunk"), _add_up, "chunk int, counts binary").collect()
    # PARTS rows of 2**sketch_bits / PARTS bytes, whatever the input
    level = np.zeros((PARTS, (1 << sketch_bits) // PARTS), np.uint8)
    for r in summed:
        level[r["chunk"]] = np.frombuffer(r["counts"], np.uint8)
    levels = spark.sparkContext.broadcast(level.reshape(-1))
    # a shingle seldom enough by the sketch is counted where its prefixes meet; those of a frequent one are dealt by entity,
    # counted by partial sums and joined back, so that no task has all prefixes of a shingle
    frequent = int(np.ceil(8 * np.log2(1 + max(4 * BUCKET, 8 * float(np.mean(np.exp2(level / 8) - 1))))))
    rows = mapped(docs, _prefixes(words, sketch_bits, levels, frequent, num, den), "token long, e binary, n int, l int, often boolean")
    rows = rows.withColumn("deal", F.when(F.col("often"), F.xxhash64("token", "e")).otherwise(F.col("token"))).repartition("deal")
    once = rows.groupBy("deal", "token", "e", "often").agg(F.first("n").alias("n"), F.first("l").alias("l"))
    met = once.withColumn("c", F.when(~F.col("often"), F.count("*").over(Window.partitionBy("deal", "token"))))
    met = stored(met.where("often or c > 1").select("token", "e", "n", "l", "c"), "met")
    many = met.where("c is null").groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    shared = stored(met.where("c is not null").unionByName(met.where("c is null").drop("c").join(many, "token")), "prefixes", met)
    cold, hot = _split(shared, bucket)

    x, y = cold.alias("x"), cold.alias("y")
    fits = (F.col("x.e") < F.col("y.e")) & (F.col("x.n") * den >= F.col("y.n") * num) & (F.col("y.n") * den >= F.col("x.n") * num)
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & fits).groupBy(F.col("x.e").alias("a"), F.col("y.e").alias("b"))
    pairs = pairs.agg(F.count("*").alias("got"), F.first("x.n").alias("na"), F.first("y.n").alias("nb"), F.least(F.first("x.l"), F.first("y.l")).alias("l")).where("got >= l")
    pairs = stored(pairs.select("a", "b", "na", "nb"), "candidates")

    entity = stored(names.where("n > 0").groupBy("e").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "entities")
    wanted = pairs.select(F.col("a").alias("e")).unionByName(pairs.select(F.col("b").alias("e"))).unionByName(hot.select("e")).distinct()
    wanted = wanted.join(entity, "e")
    wanted = stored(wanted, "wanted")
    # no text is shuffled: what stands in a marked slot without being wanted goes where names are joined
    marks = spark.sparkContext.broadcast(_marked(wanted, "rep"))
    sets = mapped(docs.withColumn("slot", _slot("doc_id")), _sets(words, marks), "e binary, g array<long>").dropDuplicates(["e"]).join(wanted.select("e", "copies"), "e")
    sets = stored(sets, "sets")

    some_hot = not hot.isEmpty()
    if some_hot:
        members = _members(hot, sets)
        hot_links = _by_blocks(members.withColumn("side", F.lit(0)), num, den) if count_links else _by_pivots(members, num, den)[0]
        fa, fb = (members.select(F.col("e").alias(c), F.col("family").alias(f"f{c}")) for c in "ab")
        pairs = pairs.join(fa, "a", "left").join(fb, "b", "left").where("fa is null or fb is null or fa <> fb")
    both = pairs.join(sets.select(F.col("e").alias("a"), F.col("g").alias("ga"), F.col("copies").alias("ca")), "a").join(sets.select(F.col("e").alias("b"), F.col("g").alias("gb"), F.col("copies").alias("cb")), "b")
    both = both.withColumn("i", F.size(F.array_intersect("ga", "gb")).cast("long")).where(F.col("i") * den >= (F.col("na") + F.col("nb") - F.col("i")) * num)
    cold_links = stored(both.select("a", "b", "ca", "cb"), "links")
    edges, degree = cold_links.select("a", "b"), cold_links.select(F.col("a").alias("e"), F.col("cb").alias("links")).unionByName(cold_links.select(F.col("b").alias("e"), F.col("ca").alias("links")))
    if some_hot:
        edges = edges.unionByName(hot_links.select("a", "b"))
    if some_hot and count_links:
        degree = degree.unionByName(hot_links.select(F.col("a").alias("e"), "links"))
    root = components(edges).select(F.col("node").alias("e"), "root")
    root = stored(root.join(entity.select("e", "rep"), "e"), "roots")
    least = root.groupBy("root").agg(F.min("rep").alias("component"))
    linked = root.join(least, "root").select("e", "root", "component")
    known = entity.join(linked, "e", "left").join(degree.groupBy("e").agg(F.sum("links").alias("links")), "e", "left")
    known = known.select("e", F.coalesce("root", "e").alias("root"), F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1 if count_links else F.lit(None).cast("long")).alias("links"))
    return names, stored(known, "classes")


def jaccard_classes(df: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other documents it links with; null without ``count_links``) of every document.

    Sets link when ``den * |intersection| >= num * |union|``; the options are those of :func:`entity_classes`.
    """
    names, known = entity_classes(df, **options)
    return names.join(known, "e", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("e").isNull(), 0).otherwise(F.col("links")).cast("long").alias("n_links")
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLE_SQL: dict[str, str] = {}
