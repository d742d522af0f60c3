"""Operator 5: approximate nearest neighbours by inner product: one NN-descent graph, greedy graph search.

Distinct vectors of one length are the nodes of one graph; blocks of about ``BLOCK`` nodes only deal out the work, and
edges go across them.  A task's group is a part of a block: a node meets candidates from ever more blocks as the table
grows, so groups are few nodes, by the length of vectors, and fewer still where very many queries come to them.  The graph starts from leaves of random hyperplanes and is improved in rounds of NN-descent: each
node gives every node of its list (and of those that name it) the others as candidates, at least one of a pair being
new.  A round is a chain of joins: the nodes of sampled lists fetch their vectors (as 16-bit codes), lists meet by node, and
only pairs that improve a list travel on.  Lists are sampled as the method has it, ``SAMPLE``
new and old edges a round in both directions; an edge that was not drawn stays new and is drawn later.  Rounds end when few
edges change.

A query begins at its own node and the best of ``PIVOTS`` nodes, and expands the best ``EXPAND`` open nodes of its beam
through the graph (forward and best reverse edges), one join after another, until its beam has no open node.  Only nodes
that the graph leads to are scored; ``n_scored`` of the result tells how many.  The graph covers every row, and every
query of a round moves at once.  Scores are inner products in double precision of the original vectors.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of
different length are never compared; repeated rows count once; rows with equal vectors tie, smaller ids first; an empty
table has no neighbours; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.shipping import ship
from codeloom.llm.common import mapped, stored, table

K = 20
#: Edges of a node, and of these the new and the old ones that a round draws.
GRAPH_K, SAMPLE = 40, 16
#: Sets of hyperplanes, nodes of a leaf, and edges of a node from each leaf.
TREES, LEAF, LEAF_K = 8, 512, 12
MOST_ROUNDS = 8
#: A round that changes a smaller share of the edges is the last.
CHANGED = 0.09
#: A beam holds ``SPARE`` and twice the neighbours asked for, and ``BEAM`` more for each doubling of the nodes beyond ``SMALL``.
SPARE, BEAM, SMALL = 12, 16, 2048
EXPAND, MOST_STEPS = 32, 40
#: Nodes that a query may begin at beside its own, for each length of vectors, and how many of them it takes.
PIVOTS, BEGIN = 256, 6
#: Nodes of a block, about; a node's number is its block's number and its place there.
BLOCK, _PLACE_BITS, _BLOCK_BITS = 4096, 20, 28
#: Components of the nodes whose lists are a task's group at once, and of the queries that a group is scored for, about.
LIST_VALUES, QUERY_VALUES = 1 << 15, 1 << 21
#: Queries of a file of beams: each holds all nodes that it was compared with, and a reader has a batch of rows in memory.
BEAM_ROWS = 256

_EDGE = "u long, v long, s double"
_GRAPH = "block long, nid long, code binary, v binary, s binary, fresh binary, least double, n_edges long, n_new long"


def nodes_of(df: DataFrame, id_col: str, vector_col: str, k: int, block_rows: int) -> DataFrame:
    """nid, block, dim, vec, ids (the k + 1 smallest ids with this vector, all that a result can name)."""
    v = F.col(vector_col)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec")).where(usable & F.col("vec_id").isNotNull()).distinct()
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    nodes = stored(first.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("vec")), "nodes")
    count = nodes.groupBy("dim").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    dealt = nodes.join(count, "dim").withColumn("block", F.expr(f"shiftleft(cast(dim as bigint), {_BLOCK_BITS}) + pmod(xxhash64(ids[0]), blocks)"))
    place = F.row_number().over(Window.partitionBy("block").orderBy(F.col("ids")[0]))
    return stored(dealt.select((F.shiftleft("block", _PLACE_BITS) + place).alias("nid"), "block", "dim", "vec", "ids"), "nodes", nodes)


def list_bits(dim: int) -> int:
    """Nodes whose numbers differ in these low bits are a group: a node's lists and candidates grow to some thousands with the table."""
    return max(0, min(_PLACE_BITS, int(np.log2(LIST_VALUES / max(1, dim)))))


def query_bits(nodes: int, queries: int, dim: int, reached: int) -> int:
    """The same for scoring, where a step takes each query to ``reached`` nodes: a block at most, fewer where queries are many."""
    most = max(1, QUERY_VALUES // max(1, dim))
    if queries <= most:
        return _PLACE_BITS
    return max(0, int(np.log2(max(1.0, most * nodes / (queries * reached)))))


def _rows(lists) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in lists])


def _codes(x: np.ndarray) -> list[bytes]:
    """Of each vector its scale and two bytes for each component: fine enough to tell near copies apart."""
    scale = np.abs(x).max(axis=1) / 32767
    return [t.tobytes() + r.tobytes() for t, r in zip(scale.astype("<f8"), np.rint(x / scale[:, None]).astype("<i2"), strict=True)]


def _vectors(codes: np.ndarray) -> np.ndarray:
    """From a row of bytes for each vector."""
    scale = np.ascontiguousarray(codes[:, :8]).view("<f8")
    return np.ascontiguousarray(codes[:, 8:]).view("<i2").astype(np.float32) * scale.astype(np.float32)


def _bytes(col: pa.ChunkedArray) -> np.ndarray:
    """A binary column whose values are equally long: a row of bytes for each."""
    col = col.combine_chunks()
    size = len(col[0].as_buffer())
    first = int(np.frombuffer(col.buffers()[1], "<i4")[col.offset])
    return np.frombuffer(col.buffers()[2], np.uint8)[first : first + size * len(col)].reshape(len(col), size)


def _best(u, v, k, s, n):
    """Positions of the k best distinct (u, v) of each u in 0 .. n - 1, best first; of equal pairs the first counts."""
    at = np.lexsort((np.arange(len(u)), v, u))
    at = at[np.concatenate([[True], (u[at[1:]] != u[at[:-1]]) | (v[at[1:]] != v[at[:-1]])])] if len(at) else at
    at = at[np.lexsort((v[at], -s[at], u[at]))]
    place = np.arange(len(at)) - np.searchsorted(u[at], np.arange(n))[u[at]]
    return at[place < k], place[place < k]


def _coded(sizes: dict[int, int], trees: int, leaf: int):
    """Each node's code, and its cell in every set of hyperplanes; the last set has none, so that each node gets edges."""

    def run(parts):
        import pandas as pd

        for pdf in parts:
            for dim, part in pdf.groupby("dim"):
                x, bits = _rows(part["vec"]), max(0, int(np.ceil(np.log2(sizes[dim] / leaf))))
                cells = [(x @ np.random.default_rng([dim, t]).standard_normal((dim, bits)) > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(x), int) for t in range(trees)]
                cells.append(np.zeros(len(x), int))
                yield pd.DataFrame({"block": part["block"], "nid": part["nid"], "dim": dim, "code": _codes(x), "cells": list(np.stack(cells, 1).astype(np.int64))})

    return run


def _leaf(k: int):
    def run(leaf: pa.Table) -> pa.Table:
        x, nid = _vectors(_bytes(leaf["code"])), leaf["nid"].to_numpy()
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        m = min(k, len(x) - 1)
        if m < 1:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
        near = np.argpartition(-s, m - 1, axis=1)[:, :m]
        return pa.table({"u": np.repeat(nid, m), "v": nid[near].ravel(), "s": np.take_along_axis(s, near, 1).ravel().astype(float)})

    return run


def _drawn(u: np.ndarray, v: np.ndarray, fresh: np.ndarray, sample: int, t: int) -> np.ndarray:
    """Which edges (rows of nodes, -1 for none) a round draws: ``sample`` new and ``sample`` old ones of each node."""
    h = (u[:, None].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (v.astype(np.uint64) + np.uint64(t)) * np.uint64(0xBF58476D1CE4E5B9)
    h = ((h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(2)
    out = np.zeros(v.shape, bool)
    for kind in (fresh, ~fresh):
        key = np.where(kind & (v >= 0), h, np.uint64(2**64 - 1))
        first = np.argsort(key, axis=1, kind="stable")[:, :sample]
        hit = np.zeros(v.shape, bool)
        np.put_along_axis(hit, first, True, 1)
        out |= hit & kind & (v >= 0)
    return out


def _edges(pdf, k: int):
    shape = (len(pdf), k)
    return (np.frombuffer(b"".join(pdf[c]), kind).reshape(shape) for c, kind in (("v", "<i8"), ("s", "<f4"), ("fresh", "?")))


def _lists(k: int, sample: int, t: int):
    """p, m, fresh, back: node p's list holds m; ``back`` rows come from an edge of m."""

    def run(parts):
        import pandas as pd

        for pdf in parts:
            u = pdf["nid"].to_numpy()
            v, _, fresh = _edges(pdf, k)
            r, c = np.nonzero(_drawn(u, v, fresh, sample, t))
            a, b, f = u[r], v[r, c], fresh[r, c]
            yield pd.DataFrame({"p": np.concatenate([a, b]), "m": np.concatenate([b, a]), "fresh": np.concatenate([f, f]), "back": np.repeat([False, True], len(a))})

    return run


def _pairs(k: int):
    """Within the lists of a group: pairs with something new that improve a list of either node."""

    def run(lists: pa.Table) -> pa.Table:
        p, fresh = lists["p"].to_numpy(), lists["fresh"].to_numpy()
        mid, first, m = np.unique(lists["m"].to_numpy(), return_index=True, return_inverse=True)
        x, least = _vectors(_bytes(lists["code"])[first]), lists["least"].to_numpy()[first]
        at = np.lexsort((~fresh, m, p))
        at = at[np.concatenate([[True], (p[at[1:]] != p[at[:-1]]) | (m[at[1:]] != m[at[:-1]])])]
        p, m, fresh = p[at], m[at], fresh[at]
        starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        sizes = np.diff(np.append(starts, len(p)))
        width = int(sizes.max())
        row, col = np.repeat(np.arange(len(starts)), sizes), np.arange(len(p)) - np.repeat(starts, sizes)
        member, new = np.full((len(starts), width), -1), np.zeros((len(starts), width), bool)
        member[row, col], new[row, col] = m, fresh
        half = np.triu(np.ones((width, width), bool), 1)
        us, vs, ss = [], [], []
        for a in range(0, len(starts), 128):
            mm, nn = member[a : a + 128], new[a : a + 128]
            y = x[mm]
            s = y @ y.transpose(0, 2, 1)
            real = mm >= 0
            low = np.where(real, least[mm], np.inf)
            ok = half & real[:, :, None] & real[:, None, :] & (nn[:, :, None] | nn[:, None, :])
            for better, one, two in ((s > low[:, :, None], 1, 2), (s > low[:, None, :], 2, 1)):
                i = np.nonzero(ok & better)
                us.append(mm[i[0], i[one]])
                vs.append(mm[i[0], i[two]])
                ss.append(s[i])
        u, v, s = np.concatenate(us), np.concatenate(vs), np.concatenate(ss).astype(float)
        at, _ = _best(u, v, k, s, len(mid))
        return pa.table({"u": mid[u[at]], "v": mid[v[at]], "s": s[at]})

    return run


def _merged(k: int, sample: int, t: int | None):
    """A group's nodes with their lists, and candidates for them: the new lists."""

    def run(nodes, cand):
        import pandas as pd

        nodes = nodes.sort_values("nid", ignore_index=True)
        nid, n = nodes["nid"].to_numpy(), len(nodes)
        cu, cv, cs = np.searchsorted(nid, cand["u"].to_numpy()), cand["v"].to_numpy(), cand["s"].to_numpy()
        if t is None:
            u, v, s, fresh, old = cu, cv, cs, np.ones(len(cu), bool), 0
        else:
            ev, es, ef = _edges(nodes, k)
            still = ef & ~_drawn(nid, ev, ef, sample, t)
            r, c = np.nonzero(ev >= 0)
            old = len(r)
            # an edge that is there already comes first, so it keeps its flag
            u, v, s, fresh = np.concatenate([r, cu]), np.concatenate([ev[r, c], cv]), np.concatenate([es[r, c], cs]), np.concatenate([still[r, c], np.ones(len(cu), bool)])
        at, place = _best(u, v, k, s, n)
        out_v, out_s, out_f = np.full((n, k), -1, "<i8"), np.full((n, k), -np.inf, "<f4"), np.zeros((n, k), bool)
        out_v[u[at], place], out_s[u[at], place], out_f[u[at], place] = v[at], s[at], fresh[at]
        n_edges, n_new = np.bincount(u[at], minlength=n), np.bincount(u[at[at >= old]], minlength=n)
        packed = {name: [x.tobytes() for x in a] for name, a in (("v", out_v), ("s", out_s), ("fresh", out_f))}
        return pd.DataFrame({"block": nodes["block"], "nid": nid, "code": nodes["code"], **packed, "least": out_s[:, -1].astype(float), "n_edges": n_edges, "n_new": n_new})

    return run


def neighbour_graph(nodes: DataFrame, sizes: dict[int, int], *, k: int = GRAPH_K, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """block, nid, v and s (binary: k numbers of nodes, -1 for none, and their scores), ...: each node's best neighbours found."""
    ship(nodes.sparkSession)
    bits = list_bits(max(sizes, default=1))
    group = lambda nid: F.shiftright(nid, bits).alias("at")
    coded = stored(nodes.select("block", "nid", "dim", "vec").mapInPandas(_coded(sizes, trees, leaf), "block long, nid long, dim int, code binary, cells array<long>"), "codes")
    cells = coded.select("dim", "nid", "code", F.posexplode("cells").alias("tree", "cell"))
    # a crowded cell is cut into leaves by hash, as equal sets of hyperplanes cannot part near copies
    leaves = coded.select("dim", F.posexplode("cells").alias("tree", "cell")).groupBy("dim", "tree", "cell").agg(F.ceil(F.count("*") / leaf).alias("parts"))
    leaves = cells.join(leaves, ["dim", "tree", "cell"]).withColumn("part", F.expr("pmod(xxhash64(nid, tree), parts)"))
    # dealt anew by leaf, so that a crowded cell is no task's alone
    begun = leaves.repartition("dim", "tree", "cell", "part").groupBy("dim", "tree", "cell", "part").applyInArrow(_leaf(min(LEAF_K, k)), _EDGE)
    graph = stored(coded.groupBy(group("nid")).cogroup(begun.groupBy(group("u"))).applyInPandas(_merged(k, sample, None), _GRAPH), "graph", coded)
    for t in range(most_rounds):
        drawn = graph.select("nid", "v", "s", "fresh").mapInPandas(_lists(k, sample, t), "p long, m long, fresh boolean, back boolean")
        place = F.row_number().over(Window.partitionBy("p", "back", "fresh").orderBy(F.xxhash64("p", "m", F.lit(t)), "m"))
        lists = drawn.withColumn("place", place).where(F.col("place") <= sample).select("p", "m", "fresh")
        lists = lists.join(graph.select(F.col("nid").alias("m"), "code", "least"), "m")
        found = lists.groupBy(group("p")).applyInArrow(_pairs(k), _EDGE)
        graph = stored(graph.groupBy(group("nid")).cogroup(found.groupBy(group("u"))).applyInPandas(_merged(k, sample, t), _GRAPH), "graph", graph)
        done = graph.agg(F.sum("n_new").alias("new"), F.sum("n_edges").alias("all")).first()
        if not done["all"] or done["new"] < CHANGED * done["all"]:
            break
    return graph


def _unpacked(k: int):
    def run(parts):
        import pandas as pd

        for pdf in parts:
            v, s, _ = _edges(pdf, k)
            r, c = np.nonzero(v >= 0)
            yield pd.DataFrame({"u": pdf["nid"].to_numpy()[r], "v": v[r, c], "s": s[r, c].astype(float)})

    return run


def walkable(graph: DataFrame, k: int) -> DataFrame:
    """n, near: the neighbours of each node, forward and the k best reverse edges; others are walked from their other end."""
    edges = stored(graph.select("nid", "v", "s", "fresh").mapInPandas(_unpacked(k), _EDGE), "edges")
    best = F.row_number().over(Window.partitionBy("v").orderBy(F.col("s").desc(), "u"))
    back = edges.withColumn("r", best).where(F.col("r") <= k).select(F.col("v").alias("n"), F.col("u").alias("m"))
    return stored(edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(back).groupBy("n").agg(F.collect_set("m").alias("near")), "walkable", edges)


def _begun(pivots: dict[int, tuple[np.ndarray, np.ndarray]], begin: int):
    """The first beam of each query: its own node and the best pivots."""

    def run(parts):
        import pandas as pd

        for pdf in parts:
            beams = []
            for q, dim, vec in zip(pdf["q"], pdf["dim"], pdf["vec"], strict=True):
                x, (nid, y) = np.asarray(vec, np.float64), pivots[dim]
                s = y @ x
                top = np.argsort(-s, kind="stable")[:begin]
                beams.append([{"s": float(x @ x), "n": int(q), "open": True}] + [{"s": float(s[i]), "n": int(nid[i]), "open": True} for i in top if nid[i] != q])
            yield pd.DataFrame({"q": pdf["q"], "vec": pdf["vec"], "beam": beams, "n_scored": [len(pivots[d][0]) for d in pdf["dim"]]})

    return run


def _dealt(bits: int):
    """q, at, vec, least, ns: of each query the new nodes that it has come to, a row for each group of nodes."""

    def run(batches):
        for b in batches:
            new = b.column("new")
            n, row = new.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), new.value_lengths().to_numpy())
            order = np.lexsort((n, row))
            n, row = n[order], row[order]
            at = n >> bits
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(n)), bool), (row[1:] != row[:-1]) | (at[1:] != at[:-1])]))
            ends = np.append(first[1:], len(n))
            for a in range(0, len(first), 1 << 13):
                f, e = first[a : a + (1 << 13)], ends[a : a + (1 << 13)]
                q, vec, least = (b.column(c).take(pa.array(row[f])) for c in ("q", "vec", "least"))
                yield pa.RecordBatch.from_arrays([q, pa.array(at[f]), vec, least, pa.ListArray.from_arrays(np.append(f, e[-1]).astype("<i4") - np.int32(f[0]), n[f[0] : e[-1]])], names=["q", "at", "vec", "least", "ns"])

    return run


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    return lists.combine_chunks().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _scored(queries: pa.Table, nodes: pa.Table) -> pa.Table:
    """Inner products of each query with the nodes of a group that it has come to."""
    if not len(queries) or not len(nodes):
        return pa.table({"q": pa.array([], pa.int64()), "n": pa.array([], pa.list_(pa.int64())), "s": pa.array([], pa.list_(pa.float64()))})
    nodes = nodes.sort_by("nid")
    nid, x, y = nodes["nid"].to_numpy(), _matrix(nodes["vec"]), _matrix(queries["vec"])
    ns = queries["ns"].combine_chunks()
    n, row = ns.flatten().to_numpy(), np.repeat(np.arange(len(y)), ns.value_lengths().to_numpy())
    at, s = np.searchsorted(nid, n), np.empty(len(n))
    for a in range(0, len(n), 1 << 14):
        z = slice(a, a + (1 << 14))
        s[z] = np.einsum("ij,ij->i", y[row[z]], x[at[z]])
    # what a full beam would drop again stays here
    good = s > queries["least"].to_numpy()[row]
    some, sizes = np.unique(row[good], return_counts=True)
    offsets = np.append(0, np.cumsum(sizes)).astype("<i4")
    return pa.table({"q": queries["q"].to_numpy()[some], "n": pa.ListArray.from_arrays(offsets, n[good]), "s": pa.ListArray.from_arrays(offsets, s[good])})


_BEAM = "array<struct<s:double,n:long,open:boolean>>"


def graph_search(nodes: DataFrame, near: DataFrame, asked: DataFrame, *, beam: int, expand: int = EXPAND, most_steps: int = MOST_STEPS, pivots: int = PIVOTS) -> DataFrame:
    """q, vec, beam (best first), n_scored of the queries ``asked`` (q: their node, dim, vec)."""
    first = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("nid"), "nid"))
    chosen: dict[int, list] = {}
    for r in nodes.select("dim", "nid", "vec").withColumn("r", first).where(F.col("r") <= pivots).collect():  # `pivots` rows for each length
        chosen.setdefault(r["dim"], []).append((r["nid"], r["vec"]))
    known = {d: (np.array([i for i, _ in x]), _rows([v for _, v in x])) for d, x in chosen.items()}
    kind = dict(asked.dtypes)["vec"]
    state = asked.mapInPandas(_begun(known, BEGIN), f"q long, vec {kind}, beam {_BEAM}, n_scored long")
    state = stored(state.select("q", "vec", F.sort_array("beam", asc=False).alias("beam"), F.col("beam.n").alias("seen"), "n_scored"), "beams")
    none = F.array().cast("array<long>")
    size = nodes.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    widest = near.agg(F.max(F.size("near"))).first()[0] or 1
    bits = query_bits(size["n"], state.count(), size["dim"] or 1, expand * widest)
    group = lambda nid: F.shiftright(nid, bits).alias("at")
    for _ in range(most_steps):
        picked = F.slice(F.filter("beam", lambda b: b["open"]), 1, expand)["n"]
        met = state.select("q", F.explode(picked).alias("n")).join(near, "n").groupBy("q").agg(F.flatten(F.collect_list("near")).alias("met"))
        now = state.join(met, "q", "left").withColumn("new", F.array_except(F.coalesce("met", none), "seen"))
        least = F.when(F.size("beam") >= beam, F.col("beam")[F.size("beam") - 1]["s"]).otherwise(float("-inf"))
        # a row for each group that a query comes to: rows of single nodes would each carry its vector
        going = mapped(now.select("q", "vec", least.alias("least"), "new"), _dealt(bits), f"q long, at long, vec {kind}, least double, ns array<long>")
        found = going.groupBy("at").cogroup(nodes.select("nid", "vec").groupBy(group("nid"))).applyInArrow(_scored, "q long, n array<long>, s array<double>")
        found = found.select("q", F.transform(F.arrays_zip("s", "n"), lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n"), F.lit(True).alias("open"))).alias("some"))
        found = found.groupBy("q").agg(F.flatten(F.collect_list("some")).alias("found"))
        closed = F.transform("beam", lambda b: F.struct(b["s"], b["n"], (b["open"] & ~F.array_contains(picked, b["n"])).alias("open")))
        longer = F.slice(F.sort_array(F.concat(closed, F.coalesce("found", F.array().cast(_BEAM))), asc=False), 1, beam)
        after = now.join(found, "q", "left").select("q", "vec", longer.alias("beam"), F.concat("seen", "new").alias("seen"), (F.col("n_scored") + F.size("new")).alias("n_scored"))
        state = stored(after, "beams", state, BEAM_ROWS)
        if state.where(F.exists("beam", lambda b: b["open"])).isEmpty():
            break
    return state


def beam_for(nodes: int, k: int) -> int:
    return 2 * k + SPARE + int(BEAM * max(0.0, np.log2(max(nodes, 1) / SMALL)))


def nearest(df: DataFrame, *, every: int = 1, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK, graph_k: int = GRAPH_K, beam: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score, n_scored: for each row whose id is divisible by ``every`` its k nearest other rows found.

    ``n_scored`` is the number of nodes that the query was compared with; it follows ``beam``, whose default grows with the
    logarithm of the number of nodes.
    """
    ship(df.sparkSession)
    nodes = nodes_of(df, id_col, vector_col, k, block_rows)
    sizes = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().collect()}  # one row for each length of vectors
    near = walkable(neighbour_graph(nodes, sizes, k=graph_k), graph_k)
    asked = df.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("vec")).where(F.col("query_id") % every == 0).distinct()
    # only vectors that are nodes can ask
    asked = stored(asked.join(nodes.select("vec", "dim", F.col("nid").alias("q")), "vec"), "queries")
    state = graph_search(nodes, near, asked.select("q", "dim", "vec").dropDuplicates(["q"]), beam=beam or beam_for(sum(sizes.values()), k))
    # a few more than needed, as ties are broken by ids
    best = state.select("q", "vec", "n_scored", F.explode(F.slice("beam", 1, k + 8)).alias("b")).select("q", F.col("vec").alias("qv"), "n_scored", F.col("b.n").alias("nid"))
    best = best.join(nodes.select("nid", "vec", "ids"), "nid")
    score = F.aggregate(F.zip_with("qv", "vec", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    rows = best.select("q", "n_scored", score.alias("score"), F.explode("ids").alias("vec_id"))
    rows = asked.select("query_id", "q").join(rows, "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_scored")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=20)


QUERIES = {"op5_nearest_neighbours": op5_nearest_neighbours}
ORACLE_SQL: dict[str, str] = {}
