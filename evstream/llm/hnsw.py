"""Near-duplicate embeddings by hierarchical navigable small-world graphs.

Vectors are compared within a label. Bit-equal vectors are first made one. Each label is dealt into
shards of a bounded size; every shard gets a graph of its own (built and searched for many vectors at
once in numpy), and every block of the label's vectors is sent to every shard's graph. A query's beam is
widened until it reaches past the link threshold, and a task's beams are widened until an audit of
queries against the whole shard by brute force finds every link. All links are verified by the cosine in
double precision. A task reports how many vectors each of its own links to, and its links as the edges
of a spanning forest; the components are united over tables.

Labels may be of any type that compares. Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
nothing; vectors of different length never link. Finite components of any
magnitude count. Null vec_ids are ignored in component_id. Repeated rows
and ties get the same answer and link with each other. An empty table gives an empty table. Other columns
are never looked at.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize, small_batches

THRESHOLD = 0.98
SHARD_ROWS = 8192
BLOCK_ROWS = 2048
MOST_ROWS = 65_536  # of a shard or block; one of so many vectors of 64 numbers takes some 60 MB
PARTS = 64
NEIGHBOURS = 12
BUILD_BEAM = 40
QUERY_BEAM = 48
AUDIT_ROWS = 64
WIDEST = 1024  # beams; beyond it rows are compared with the whole shard
SLACK = 1e-4  # searching is in single precision


class Hnsw:
    """A graph over unit vectors; the similarity is the inner product."""

    def __init__(self, vectors: np.ndarray, neighbours: int = NEIGHBOURS, beam: int = BUILD_BEAM, seed: int = 1) -> None:
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n, rng = len(vectors), np.random.default_rng(seed)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # members and neighbours (-1: none), from the top layer down
        order = rng.permutation(n).astype(np.int32)
        sizes = [n]
        while sizes[-1] > 4 * neighbours:
            sizes.append(max(1, sizes[-1] // neighbours))
        for level in range(len(sizes) - 1, -1, -1):
            self._build(order[: sizes[level]], neighbours * (1 + (level == 0)), beam)
        self.stray = np.empty(0, np.int32)
        for _ in range(4):
            if not len(stray := self._lost(beam)):
                return
            self._adopt(*stray)
        if len(stray := self._lost(beam)):
            self.stray = stray[0]

    @classmethod
    def restore(cls, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], stray: np.ndarray) -> Hnsw:
        """A graph from its links, with vectors that are kept elsewhere."""
        graph = cls.__new__(cls)
        graph.vectors, graph.layers, graph.stray = np.ascontiguousarray(vectors, np.float32), layers, stray
        return graph

    def _lost(self, beam: int) -> tuple[np.ndarray, np.ndarray] | tuple:
        """Nodes that a search for themselves misses, and the nearest it finds instead."""
        lost, near = [], []
        for k in range(0, len(self.vectors), 1024):
            own = np.arange(k, min(k + 1024, len(self.vectors)), dtype=np.int32)
            ids, _ = self.search(self.vectors[own], beam)
            missed = ~(ids == own[:, None]).any(1)
            lost.append(own[missed])
            near.append(ids[missed, 0])
        lost, near = np.concatenate([np.empty(0, np.int32), *lost]), np.concatenate([np.empty(0, np.int32), *near])
        return (lost, near) if len(lost) else ()

    def _adopt(self, lost: np.ndarray, near: np.ndarray) -> None:
        """Give lost nodes a link of their own from where the search for them ends."""
        members, links = self.layers[-1]
        order = np.argsort(near, kind="stable")
        lost, near = lost[order], near[order]
        _, first, counts = np.unique(near, return_index=True, return_counts=True)
        slot = np.arange(len(near)) - np.repeat(first, counts)
        extra = np.full((len(links), min(8, int(counts.max()))), -1, np.int32)
        fits = slot < extra.shape[1]
        extra[near[fits], slot[fits]] = lost[fits]
        self.layers[-1] = members, np.concatenate([links, extra], 1)

    def _build(self, members: np.ndarray, degree: int, beam: int) -> None:
        """Insert the layer's members batch by batch: search what is there, and the batch itself by brute force."""
        links = np.full((len(self.vectors), degree), -1, np.int32)
        done = 0
        while done < len(members):
            batch = members[done : done + max(1, min(512, done // 2 + 32))]
            x = self.vectors[batch]
            inner = x @ x.T
            np.fill_diagonal(inner, -2)
            k = min(beam, len(batch))
            near = np.argpartition(-inner, k - 1, axis=1)[:, :k]
            ids, sims = batch[near], np.take_along_axis(inner, near, 1)
            if done:
                found, score = self._search_layer(x, links, self._descend(x, members[:1]), beam)
                ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, score], 1)
            links[batch] = self._choose(ids, sims, degree)
            back = np.repeat(batch, degree), links[batch].ravel()
            here = back[1] >= 0
            self._link_back(links, back[1][here], back[0][here], degree)
            done += len(batch)
        self.layers.append((members, links))

    def _choose(self, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
        """Of each row's candidates the nearest that are nearer to the row than to any chosen before; then the nearest of the rest."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * degree]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        good = (ids >= 0) & (sims > -1.5)
        v = self.vectors[np.where(good, ids, 0)]
        between = np.einsum("bid,bjd->bij", v, v)
        chosen = np.zeros(ids.shape, bool)
        for k in range(ids.shape[1]):
            barred = (chosen[:, :k] & (between[:, k, :k] > sims[:, k, None])).any(1) | (chosen[:, :k] & (ids[:, :k] == ids[:, k, None])).any(1)
            chosen[:, k] = good[:, k] & ~barred & (chosen[:, :k].sum(1) < degree)
        rank = np.argsort(np.where(chosen, 0, np.where(good, 1, 2)), axis=1, kind="stable")[:, :degree]
        out = np.take_along_axis(np.where(good, ids, -1), rank, 1)
        if out.shape[1] < degree:
            out = np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)
        return out.astype(np.int32)

    def _link_back(self, links: np.ndarray, at: np.ndarray, new: np.ndarray, degree: int) -> None:
        order = np.argsort(at, kind="stable")
        at, new = at[order], new[order]
        nodes, first, counts = np.unique(at, return_index=True, return_counts=True)
        width = min(int(counts.max(initial=0)), 3 * degree)
        if not width:
            return
        slot = np.arange(len(at)) - np.repeat(first, counts)
        fresh = np.full((len(nodes), width), -1, np.int32)
        row = np.repeat(np.arange(len(nodes)), counts)
        fresh[row[slot < width], slot[slot < width]] = new[slot < width]
        ids = np.concatenate([links[nodes], fresh], 1)
        sims = np.einsum("bd,bkd->bk", self.vectors[nodes], self.vectors[np.maximum(ids, 0)])
        sims[ids < 0] = -2
        links[nodes] = self._choose(ids, sims, degree)

    def _descend(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The entry points of the layer below those built: greedily from the top."""
        at = np.repeat(start.astype(np.int32), len(x)) if not self.layers else np.repeat(self.layers[0][0][:1], len(x))
        for _, links in self.layers:
            sim = np.einsum("bd,bd->b", x, self.vectors[at])
            while True:
                ids = links[at]
                sims = np.einsum("bd,bkd->bk", x, self.vectors[np.maximum(ids, 0)])
                sims[ids < 0] = -2
                best = sims.argmax(1)
                top = np.take_along_axis(sims, best[:, None], 1)[:, 0]
                better = top > sim + 1e-7
                if not better.any():
                    break
                at = np.where(better, ids[np.arange(len(x)), best], at)
                sim = np.where(better, top, sim)
        return at

    def _search_layer(self, x: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """For every row of x its beam nearest nodes that a best-first walk meets, best first; -1 where there are fewer."""
        b, n = len(x), len(self.vectors)
        ids = np.full((b, beam), -1, np.int32)
        sims = np.full((b, beam), -2, np.float32)
        open_ = np.zeros((b, beam), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = entry, np.einsum("bd,bd->b", x, self.vectors[entry]), True
        seen = np.zeros((b, n + 1), bool)
        seen[np.arange(b), entry] = True
        step = min(step, beam)
        live = np.arange(b)
        while len(live):
            score = np.where(open_[live], sims[live], -3)
            pick = np.argpartition(-score, step - 1, axis=1)[:, :step] if step < beam else np.tile(np.arange(beam), (len(live), 1))
            valid = np.take_along_axis(score, pick, 1) > -2
            nodes = np.where(valid, np.take_along_axis(ids[live], pick, 1), -1)
            held = open_[live]
            np.put_along_axis(held, pick, False, 1)
            open_[live] = held
            near = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            new = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None], np.where(new, near, n)] = True
            near = np.where(new, near, -1)
            rows, cols = np.nonzero(new)
            s = np.full(near.shape, -2, np.float32)
            s[rows, cols] = np.einsum("pd,pd->p", x[live[rows]], self.vectors[near[rows, cols]])
            all_ids, all_sims = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], s], 1)
            all_open = np.concatenate([held, new], 1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], open_[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_open))
            live = live[open_[live].any(1)]
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.ascontiguousarray(x, np.float32)
        above, self.layers = self.layers, self.layers[:-1]
        try:
            entry = self._descend(x, above[-1][0][:1])
        finally:
            self.layers = above
        return self._search_layer(x, above[-1][1], entry, min(beam, len(self.vectors)))


def range_search(graph: Hnsw, x: np.ndarray, threshold: float, beam: int, rows: int = 1024) -> list[np.ndarray]:
    """For every row of x the nodes with at least that similarity, as far as the beam finds them.

    A beam that links fill is widened; past WIDEST the rows left are compared with every node. So are all rows with the
    few nodes that no walk reaches.
    """
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(x)
    todo = np.arange(len(x))
    n = len(graph.vectors)
    while len(todo):
        if beam > WIDEST:
            for k in range(0, len(todo), 256):
                for row, hit in zip(todo[k : k + 256], x[todo[k : k + 256]] @ graph.vectors.T >= threshold - SLACK):
                    out[row] = np.flatnonzero(hit).astype(np.int32)
            return out
        full = []
        block = max(16, min(rows, (8 << 20) // min(beam, n) // 4))
        for k in range(0, len(todo), block):
            at = todo[k : k + block]
            ids, sims = graph.search(x[at], beam)
            hit = (sims >= threshold - SLACK) & (ids >= 0)
            for row, i, h in zip(at, ids, hit):
                out[row] = i[h] if not len(graph.stray) else np.union1d(i[h], graph.stray)
                if h.all() and ids.shape[1] < n:
                    full.append(row)
        todo = np.array(full, np.int64)
        beam *= 4
    return out


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and unit vectors; components are scaled first, since the squares of very large or small ones leave the range of a double."""
    column = table["embedding"].combine_chunks()
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), -1)
    v /= np.abs(v).max(1, keepdims=True)
    return table["node"].to_numpy(), v / np.sqrt((v * v).sum(1, keepdims=True))


def _join(up: np.ndarray, places: np.ndarray) -> None:
    """Put places into one tree of the forest up (a place's way to its root never rises)."""
    root = up[places]
    while ((above := up[root]) != root).any():
        root = above
    up[root] = up[places] = root.min()


def link_block(graph: Hnsw, nodes: np.ndarray, unit: np.ndarray, q_nodes: np.ndarray, q_unit: np.ndarray, threshold: float, beam: int = QUERY_BEAM, audit: int = AUDIT_ROWS) -> list[tuple[int, np.ndarray]]:
    """(query node, linked nodes) for a block against a shard; beams are widened until the audited queries lose no link."""
    sample = np.linspace(0, len(q_nodes) - 1, min(audit, len(q_nodes))).astype(np.int64)
    truth = q_unit[sample] @ unit.T >= threshold
    while True:
        found = range_search(graph, q_unit, threshold, beam)
        links = []
        for node, x, near in zip(q_nodes, q_unit, found):
            near = near[(unit[near] @ x >= threshold) & (nodes[near] != node)]
            links.append((int(node), near))
        want = sum(int(t.sum() - (t & (nodes == q_nodes[s])).sum()) for s, t in zip(sample, truth))
        got = sum(int(truth[k][links[s][1]].sum()) for k, s in enumerate(sample))
        if got >= want or beam > WIDEST:
            return links
        beam *= 4


def near_links(embeddings: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (vec_id, node), links by node (node, n_links: rows linked with each row of it) and edges (a, b) between nodes.

    A label has up to PARTS shards and blocks of at least shard_rows and block_rows vectors, and more than that only once
    they have MOST_ROWS: as many times as that its vectors and graphs are sent.
    """
    small_batches(embeddings.sparkSession)
    usable = F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False))
    usable &= F.coalesce(F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))), F.lit(False))
    usable &= F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"), usable.alias("usable")).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("embedding", F.when(F.col("usable"), F.transform("embedding", lambda x: x + F.lit(0.0)))), "vectors")  # -0 is 0
    distinct = rows.where("usable").groupBy("label", "embedding").agg(F.min("row").alias("node"), F.count("*").alias("copies"))
    distinct = materialize(distinct.withColumn("dims", F.size("embedding")), "distinct-vectors")
    many = F.least(F.lit(MOST_ROWS), F.ceil(F.count("*") / PARTS))
    parts = lambda least: F.ceil(F.count("*") / F.greatest(F.lit(least), many)).cast("int")
    sizes = distinct.groupBy("label", "dims").agg(parts(shard_rows).alias("shards"), parts(block_rows).alias("blocks"))
    mixed = F.xxhash64("node")
    dealt = distinct.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, ["label", "dims"])
    dealt = materialize(dealt.withColumns({"shard": F.pmod(mixed, "shards").cast("int"), "block": F.pmod(F.shiftright(mixed, 20), "blocks").cast("int")}), "dealt")
    label_type = dealt.schema["label"].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        nodes, unit = _rows(table)
        graph = Hnsw(unit)
        packed = pickle.dumps((graph.layers, graph.stray, nodes, unit, table["copies"].to_numpy()), 5)
        return pa.table({"label": table["label"][:1], "dims": table["dims"][:1], "shard": table["shard"][:1], "graph": pa.array([packed], pa.binary())})

    wide = dealt.select("label", "dims", "shard", "block", "shards", "node", "copies", "embedding")
    graphs = wide.drop("block", "shards").groupBy("label", "dims", "shard").applyInArrow(build, f"label {label_type}, dims int, shard int, graph binary")
    graphs = materialize(graphs, "graphs")
    again = [F.col(c).alias(c) for c in ("label", "dims", "block")]  # columns of their own for each side of the cogroup
    queries = wide.select(*again, F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "node", "embedding")
    blocks = wide.select(*again).distinct()
    pairs = graphs.join(blocks, ["label", "dims"])  # each shard's graph for each block of its label's vectors

    def link(queries: pa.Table, graph: pa.Table) -> pa.Table:
        layers, stray, nodes, unit, copies = pickle.loads(graph["graph"][0].as_py())
        q_nodes, q_unit = _rows(queries)
        both = np.union1d(nodes, q_nodes)
        place, q_place, up = np.searchsorted(both, nodes), np.searchsorted(both, q_nodes), np.arange(len(both))
        found, times = [], []
        for at, (node, near) in zip(q_place, link_block(Hnsw.restore(unit, layers, stray), nodes, unit, q_nodes, q_unit, threshold)):
            if len(near):
                found.append(node)
                times.append(int(copies[near].sum()))
                _join(up, np.append(place[near], at))
        while ((above := up[up]) != up).any():
            up = above
        tied = np.flatnonzero(up != np.arange(len(both)))
        none = np.full(max(len(found), len(tied)), None, object)
        node, other = np.concatenate([np.array(found, np.int64), both[tied]]), [*none[: len(found)], *both[up[tied]].tolist()]
        return pa.table({"node": pa.array(node, pa.int64()), "n": pa.array([*times, *none[: len(tied)]], pa.int64()), "other": pa.array(other, pa.int64())})

    keys = ["label", "dims", "block", "shard"]
    found = queries.groupBy(keys).cogroup(pairs.groupBy(keys)).applyInArrow(link, "node long, n long, other long")
    found = materialize(found, "links")
    discard(dealt, graphs)
    counts = distinct.select("node", F.col("copies") - 1).toDF("node", "n").unionByName(found.where("other is null").select("node", "n"))
    counts = counts.groupBy("node").agg(F.sum("n").alias("n_links"))
    node = distinct.select("label", "embedding", "node")
    tagged = rows.join(node, ["label", "embedding"], "left").select("vec_id", "row", F.coalesce("node", "row").alias("node"))
    return tagged, counts, found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept."""
    tagged, counts, edges = near_links(embeddings, threshold, shard_rows, block_rows)
    roots = connected_components(edges, "hnsw")
    tagged = materialize(tagged, "tagged")
    lowest = tagged.groupBy("node").agg(F.min("vec_id").alias("low"))
    nodes = lowest.join(roots, "node", "left").join(counts, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    nodes = materialize(nodes, "nodes")
    components = materialize(nodes.groupBy("root").agg(F.min("low").alias("component_id")), "by-root")
    named = materialize(nodes.join(components, "root").select("node", "n_links", "component_id"), "named")
    discard(nodes, components)
    out = tagged.join(named, "node").select("vec_id", "n_links", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
