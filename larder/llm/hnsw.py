"""Approximate nearest neighbours: a navigable small-world graph for each shard, shard results merged.

Each shard is a file in the shared folder: its vectors, their smallest ids and, a layer each, flat arrays of
neighbours. Queries lie in files of BLOCK. A task holds one shard and one block of queries.
"""

from __future__ import annotations

import heapq
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_dir, parts, read, written

K = 10
LINKS = 16  # that a node chooses on each layer
BACK = 32  # links of others that it may return, beside those
BUILD = 64  # nearest of its layer that it chooses from
SEARCH = 64  # candidates kept while a query descends the ground layer
SHARD_ROWS = 16_000  # vectors of a shard, about: every query is put to every shard, so more data want larger ones
BLOCK = 4_096  # queries of a file


class Hnsw:
    """Layers of flat neighbour arrays: links[layer] is (n, width) of row numbers, -1 where there is none.

    All nodes are inserted as one batch: those of a layer get their candidates from blocked matrix products,
    choose among them as a single insertion does (nearer to the node than to any chosen before), and are linked back.
    """

    def __init__(self, x: np.ndarray, seed: int = 11, links: list[np.ndarray] | None = None, members: list[np.ndarray] | None = None):
        n = len(x)
        self.x, self.norm = x, (x * x).sum(1)
        self.seen, self.mark = np.zeros(n, np.int64), 0
        if links is not None:
            self.links, self.members = links, members
            return
        level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int), 6)
        self.members = [np.flatnonzero(level >= k).astype(np.int32) for k in range(int(level.max(initial=0)) + 1)]
        self.links = [self._layer(m) for m in self.members]

    def _layer(self, own: np.ndarray) -> np.ndarray:
        """The links of a layer's nodes, by their place in it, as places in it."""
        x, n = self.x[own], len(own)
        norm, k = self.norm[own], min(BUILD, n - 1)
        if k < 1:
            return np.full((n, 1), -1, np.int32)
        chosen, far = np.full((n, LINKS), -1, np.int32), np.full((n, LINKS), np.inf)
        for a in range(0, n, 256):
            rows = np.arange(a, min(n, a + 256))
            d = norm[rows][:, None] + norm[None, :] - 2 * x[rows] @ x.T
            d[rows - a, rows] = np.inf
            near = np.argpartition(d, k - 1, 1)[:, :k]
            dist = np.take_along_axis(d, near, 1)
            order = np.argsort(dist, 1)
            near, dist = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)
            y = x[near]
            between = norm[near][:, :, None] + norm[near][:, None, :] - 2 * y @ y.transpose(0, 2, 1)
            closest, taken, count = np.full(dist.shape, np.inf), np.zeros(dist.shape, bool), np.zeros(len(rows), int)
            for j in range(k):
                ok = (dist[:, j] < closest[:, j]) & (count < LINKS)
                taken[ok, j] = True
                count += ok
                closest[ok] = np.minimum(closest[ok], between[ok, j])
            # room that is left goes to the nearest of the rest
            rank = np.argsort(np.where(taken, 0, 1) * k + np.arange(k), 1)[:, :LINKS]
            chosen[rows, : rank.shape[1]] = np.take_along_axis(near, rank, 1)
            far[rows, : rank.shape[1]] = np.take_along_axis(dist, rank, 1)
        back = np.full((n, BACK), -1, np.int32)
        j, i = chosen.ravel(), np.repeat(np.arange(n), LINKS)
        live = j >= 0
        j, i, d = j[live], i[live], far.ravel()[live]
        one_way = ~(chosen[j] == i[:, None]).any(1)
        j, i, d = j[one_way], i[one_way], d[one_way]
        # a node that no one else chose keeps its way in: its nearest comes before all that are returned
        lonely = np.bincount(j, minlength=n) == 0
        order = np.lexsort((d, ~lonely[i], j))
        j, i = j[order], i[order]
        place = np.arange(len(j)) - np.searchsorted(j, j)
        fits = place < BACK
        back[j[fits], place[fits]] = i[fits]
        return np.concatenate([chosen, back], 1)

    def _far(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.norm[rows] - 2 * (self.x[rows] @ q)

    def _walk(self, q: np.ndarray, start: list[tuple[float, int]], layer: int, width: int) -> list[tuple[float, int]]:
        """The `width` nearest that best-first search finds, nearest first, as rows of x."""
        self.mark += 1
        seen, links, own = self.seen, self.links[layer], self.members[layer]
        todo, best = list(start), [(-d, i) for d, i in start]
        heapq.heapify(todo)
        heapq.heapify(best)
        for _, i in start:
            seen[i] = self.mark
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            near = links[i if len(own) == len(self.x) else np.searchsorted(own, i)]
            near = own[near[near >= 0]]
            near = near[seen[near] != self.mark]
            if not len(near):
                continue
            seen[near] = self.mark
            dist = self._far(q, near)
            if len(best) >= width:
                ok = dist < -best[0][0]
                near, dist = near[ok], dist[ok]
            for e, j in zip(dist.tolist(), near.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-e, j))
                    heapq.heappush(todo, (e, j))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, j))
                    heapq.heappush(todo, (e, j))
        return sorted((-d, i) for d, i in best)

    def search(self, q: np.ndarray, k: int, width: int = SEARCH) -> list[int]:
        if not len(self.x):
            return []
        first = int(self.members[-1][0])
        at = [(float(self._far(q, np.array([first]))[0]), first)]
        for layer in range(len(self.links) - 1, 0, -1):
            at = self._walk(q, at, layer, 1)[:1]
        return [i for _, i in self._walk(q, at, 0, max(width, k))[:k]]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the rows that take part: no null, zero or non-finite ones; the commonest length of a vector is the space's, other lengths take no part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return out.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def distinct_vectors(own: DataFrame, most: int) -> DataFrame:
    """v and its `most` smallest ids. Copies at one distance rank by id, so no other of its copies can ever be among a query's nearest: this keeps results exact however many there are. Ids are cut to `most` before and after the shuffle."""

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[bytes, list[int]] = {}
        for batch in batches:
            for i, v in zip(batch["vec_id"].tolist(), batch["v"], strict=True):
                ids = kept.setdefault((np.asarray(v, np.float64) + 0.0).tobytes(), [])  # -0.0 is 0.0
                heapq.heappush(ids, -i) if len(ids) < most else heapq.heappushpop(ids, -i)
            if len(kept) > 50_000:
                yield frame(kept)
                kept = {}
        yield frame(kept)

    def frame(kept: dict[bytes, list[int]]) -> pd.DataFrame:
        return pd.DataFrame({"key": list(kept), "ids": [sorted(-i for i in x) for x in kept.values()]})

    part = own.mapInPandas(least, "key binary, ids array<long>")
    return part.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, most).alias("ids"))


def stored(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes arrays under a name of this attempt alone; a lost task's file is one that no row names."""
    fs, base = pafs.FileSystem.from_uri(folder)
    np.savez(out := io.BytesIO(), **arrays)
    path = f"{name}-{uuid.uuid4().hex[:12]}.npz"
    with fs.open_output_stream(f"{base}/{path}") as f:
        f.write(out.getvalue())
    return f"{folder}/{path}"


def fetched(path: str) -> dict[str, np.ndarray]:
    fs, base = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(base) as f:
        data = np.load(io.BytesIO(f.read()))
    return {k: data[k] for k in data.files}


def graphs(points: DataFrame, shards: int, folder: str) -> DataFrame:
    """shard and path: each shard's vectors, ids and graph in a file."""

    def build(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(own["key"]), np.float64).reshape(len(own), -1)
        graph = Hnsw(x)
        ids, layers = own["ids"].tolist(), range(len(graph.links))
        more = {f"links{k}": graph.links[k] for k in layers} | {f"members{k}": graph.members[k] for k in layers}
        path = stored(folder, f"shard-{key[0]}", {"x": x, "ids": np.concatenate(ids).astype(np.int64), "copies": np.array([len(i) for i in ids])} | more)
        return pd.DataFrame({"shard": [key[0]], "path": [path]})

    sharded = points.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("long"))
    return written(sharded.groupBy("shard").applyInPandas(build, "shard long, path string"), "graphs")


def blocks_of(asked: DataFrame, blocks: int, folder: str) -> DataFrame:
    """block and path: each block of queries in a file."""

    def keep(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("vec_id")
        path = stored(folder, f"block-{key[0]}", {"ids": own["vec_id"].to_numpy(np.int64), "q": np.frombuffer(b"".join(own["key"]), np.float64).reshape(len(own), -1)})
        return pd.DataFrame({"block": [key[0]], "queries": [path]})

    own = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("long").alias("block"), "vec_id", "key")
    return written(own.groupBy("block").applyInPandas(keep, "block long, queries string"), "blocks")


def nearest(vectors: DataFrame, every: int = 100, k: int = K, shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each row whose id is divisible by `every`.

    All distinct vectors are dealt out to shards by hash and a graph is built for each. Shards and blocks of
    queries are files; every block is put to every shard, a task takes some shards of a block and gives the
    k best of these, and the tasks' bests are merged. Distances are Euclidean over the original vectors in double precision;
    ties go to the smaller id. Rows with null ids or null, zero or non-finite vectors take no part, nor do those
    whose vector has another length than the commonest; an id that is repeated with other vectors is several
    candidates, and as a query it is asked with each, the nearest of all of them counting. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    own = usable(vectors)
    size = F.size("v")
    lengths = own.groupBy(size.alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    own = own.join(F.broadcast(lengths), size == F.col("d"), "left_semi")
    points = written(distinct_vectors(own, k + 1), "vectors")
    asked = written(packed(own.where(F.col("vec_id") % every == 0)).distinct(), "queries")  # a stated query set: 1 row in `every`
    shards, blocks = (max(1, -(-t.count() // n)) for t, n in ((points, shard_rows), (asked, block)))
    folder = new_dir(spark, "hnsw")
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    put = graphs(points, shards, folder).crossJoin(blocks_of(asked, blocks, folder))  # names of files
    some = max(1, shards * blocks // max(parts(spark), blocks))  # shards that a task takes
    put = put.repartition(parts(spark), "block", F.floor(F.col("shard") / some)).sortWithinPartitions("block", "shard")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, q = None, np.zeros(0, np.int64), np.zeros((0, 0))
        best: dict[int, list[tuple[float, int]]] = {}

        def given() -> pd.DataFrame:
            rows = [(i, v, d) for i, found in best.items() for d, v in found]
            return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

        for batch in batches:
            for path, queries in zip(batch["path"], batch["queries"], strict=True):
                if queries != at:
                    yield given()
                    data, at, best = fetched(queries), queries, {}
                    ids, q = data["ids"], data["q"]
                data = fetched(path)
                layers = range(sum(name.startswith("links") for name in data))
                graph = Hnsw(data["x"], links=[data[f"links{n}"] for n in layers], members=[data[f"members{n}"] for n in layers])
                first = np.concatenate([[0], np.cumsum(data["copies"])])
                for i, v in zip(ids.tolist(), q, strict=True):
                    rows = graph.search(v, k + 1)
                    dist = np.sqrt(((graph.x[rows] - v) ** 2).sum(1))
                    found = {(d, j) for d, r in zip(dist.tolist(), rows, strict=True) for j in data["ids"][first[r] : first[r + 1]].tolist() if j != i}
                    best[i] = heapq.nsmallest(k, found.union(best.get(i, [])))
        yield given()

    found = put.mapInPandas(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def packed(own: DataFrame) -> DataFrame:
    """vec_id and key: the vector's doubles, -0.0 as 0.0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"vec_id": batch["vec_id"], "key": [(np.asarray(v, np.float64) + 0.0).tobytes() for v in batch["v"]]})

    return own.select("vec_id", "v").mapInPandas(run, "vec_id long, key binary")


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))
