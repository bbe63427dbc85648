"""Approximate nearest neighbours with learned partitions.

The index is a tree of learned partitions. A node that holds many vectors is
split: on a bounded sample of its vectors (``max_fit``) the graph of largest
inner products is built and cut into parts of balanced size with as few cut
edges as local moves find. A small softmax classifier learns to tell a vector's
part from its direction and length, another the parts of a query's neighbours
from its direction. Vectors go to their most probable part, queries to as many
parts, most probable first, as reached ``recall`` of the neighbours of sample
vectors that the classifiers had not seen. Small tables have one level; a part
of more than ``split`` vectors is a node of the next level, so parts grow with
the corpus and stay of bounded size. What reaches a leaf is reranked there by
the exact inner product in double precision; leaves are cut into blocks, so a
leaf that holds many vectors, or copies of one vector, is several tasks.

Every row is a vector of its own and so is every query row: with a repeated id
each row is answered, and finds the others. Vectors that are null, zero, of
another length than most, or hold null or non-finite components take no part,
nor do rows with a null id. Ties go to the smaller id. With fewer candidates
than asked for, all are returned. Other columns are not read.
"""

from __future__ import annotations

import io
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import discard, written

#: Vectors of a node beyond which it is split, parts of a node, rows of a block.
SPLIT, MOST_PARTS, BLOCK = 16_384, 64, 4096


@dataclass
class Router:
    weight: np.ndarray  # (dimensions + 1, parts): tells a vector's part
    bias: np.ndarray
    ask: np.ndarray  # (dimensions, parts): tells the parts of a query's neighbours
    ask_bias: np.ndarray
    probes: int
    longest: float = 1.0

    def places(self, x: np.ndarray) -> np.ndarray:
        return lengthened(x, self.longest) @ self.weight + self.bias

    def odds(self, x: np.ndarray) -> np.ndarray:
        return directions(x) @ self.ask + self.ask_bias

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, weight=self.weight, bias=self.bias, ask=self.ask, ask_bias=self.ask_bias, scalars=np.array([self.probes, self.longest]))
        return out.getvalue()

    @staticmethod
    def loaded(data: bytes) -> Router:
        held = np.load(io.BytesIO(data))
        return Router(held["weight"], held["bias"], held["ask"], held["ask_bias"], int(held["scalars"][0]), float(held["scalars"][1]))


def directions(x: np.ndarray) -> np.ndarray:
    """A query's length changes no order among its inner products."""
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1.0)


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors of length one with a dimension more, so that lengths are kept as angles."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), longest)
    return np.hstack([x, np.sqrt(np.maximum(1.0 - np.square(x).sum(axis=1, keepdims=True), 0.0))])


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest by inner product of each row, without itself."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        scores = x[at : at + 1024] @ x.T
        scores[np.arange(len(scores)), at + np.arange(len(scores))] = -np.inf
        out[at : at + 1024] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.15, seed: int = 5) -> np.ndarray:
    """Part of each vertex: seeded by nearest centres, then moved to where most
    of its neighbours are, never beyond ``slack`` times the even size."""
    n = len(x)
    draw = np.random.default_rng(seed)
    limit = int(np.ceil(slack * n / parts))
    centres = x[draw.choice(n, parts, replace=False)]
    for _ in range(8):
        near = (x @ centres.T).argmax(axis=1)
        for p in range(parts):
            if (near == p).any():
                c = x[near == p].mean(axis=0)
                centres[p] = c / (np.linalg.norm(c) or 1.0)
    part, size = np.full(n, -1), np.zeros(parts, np.int64)
    scores = x @ centres.T
    for i in np.argsort(-scores.max(axis=1), kind="stable"):
        for p in np.argsort(-scores[i], kind="stable"):
            if size[p] < limit:
                part[i] = p
                size[p] += 1
                break
    back = [[] for _ in range(n)]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            back[j].append(i)
    for _ in range(rounds):
        moved = 0
        for i in draw.permutation(n):
            votes = np.bincount(part[np.append(graph[i], np.array(back[i], np.int64))], minlength=parts)
            p = int(votes.argmax())
            if p != part[i] and votes[p] > votes[part[i]] and size[p] < limit:
                size[part[i]] -= 1
                size[p] += 1
                part[i] = p
                moved += 1
        if moved < n // 500:
            break
    return part


def softmax_fit(x: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight and bias by Adam on the cross-entropy with each row's shares."""
    weight, bias = np.zeros((x.shape[1], share.shape[1])), np.zeros(share.shape[1])
    moments = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(bias), np.zeros_like(bias)]
    for step in range(1, steps + 1):
        z = x @ weight + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for value, gradient, m in ((weight, x.T @ (p - share) / len(x), 0), (bias, (p - share).mean(axis=0), 2)):
            moments[m] = 0.9 * moments[m] + 0.1 * gradient
            moments[m + 1] = 0.999 * moments[m + 1] + 0.001 * gradient**2
            value -= 0.3 * (moments[m] / (1 - 0.9**step)) / (np.sqrt(moments[m + 1] / (1 - 0.999**step)) + 1e-9)
    return weight, bias


def fit_router(x: np.ndarray, parts: int, k: int, recall: float, steps: int = 150, held: int = 4) -> Router:
    """Partition the sample's graph of inner products, learn to place and to
    route on all but every ``held``-th vector, and choose the probes on those."""
    if parts < 2 or len(x) < 8 * parts:
        return Router(np.zeros((x.shape[1] + 1, 1)), np.zeros(1), np.zeros((x.shape[1], 1)), np.zeros(1), 1)
    longest = float(np.linalg.norm(x, axis=1).max())
    placed, asked = lengthened(x, longest), directions(x)
    learn = np.flatnonzero(np.arange(len(x)) % held)
    graph = neighbour_graph(x[learn], k)
    part = balanced_parts(placed[learn], graph, parts)

    def shares(of: np.ndarray) -> np.ndarray:
        share = np.zeros((len(learn), parts))
        np.add.at(share, (np.repeat(np.arange(len(learn)), graph.shape[1]), of[graph].ravel()), 1.0)
        return share

    share = shares(part)
    share[np.arange(len(learn)), part] += graph.shape[1] / 2
    weight, bias = softmax_fit(placed[learn], share / share.sum(axis=1, keepdims=True), steps)
    home = (placed @ weight + bias).argmax(axis=1)
    ask, ask_bias = softmax_fit(asked[learn], shares(home[learn]) / graph.shape[1], steps)
    unseen = np.flatnonzero(np.arange(len(x)) % held == 0)
    odds = asked[unseen] @ ask + ask_bias
    rank = np.empty_like(odds, dtype=np.int64)
    np.put_along_axis(rank, np.argsort(-odds, axis=1, kind="stable"), np.arange(parts)[None, :], axis=1)
    reached = np.sort(rank[np.arange(len(unseen))[:, None], home[neighbour_graph(x, k)[unseen]]].ravel())
    probes = int(reached[min(len(reached) - 1, int(np.ceil(recall * len(reached))))]) + 1
    return Router(weight, bias, ask, ask_bias, min(parts, probes), longest)


def parts_of(n: int, split: int = SPLIT, most: int = MOST_PARTS) -> int:
    """Parts of a node of n vectors: a quarter of the root, 4 at least."""
    return int(np.clip(round(math.sqrt(n) / 4), 4, most))


def levels_of(n: int, split: int = SPLIT, most: int = MOST_PARTS) -> int:
    """How deep even splitting goes until no node holds more than ``split``."""
    deep = 1
    n /= parts_of(n, split, most)
    while n > split:
        n, deep = n / parts_of(n, split, most), deep + 1
    return deep


def _vectors(table: DataFrame, queries: Column, key: str, vector: str) -> DataFrame:
    """row, id, whether it is a query, and components as doubles, only of vectors that take part."""
    rows = table.select(F.col(key).alias("id"), F.coalesce(queries, F.lit(False)).alias("query"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(_good("v"))
    return rows.withColumn("row", F.monotonically_increasing_id())


def _good(vector: str) -> Column:
    return F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(vector, lambda v: v != 0)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)


def build_index(rows: DataFrame, asked: DataFrame, total: int, k: int, max_fit: int, recall: float, split: int, most: int) -> tuple[DataFrame, DataFrame, list[dict]]:
    """Leaves of all vectors and of all queries, and a summary of each level.

    A level is four steps: count its nodes' rows, fit a router for each node on
    a sample drawn by row hash, place the node's vectors, route its queries. All
    are grouped by node, and by block of bounded size within it.
    """
    depth = levels_of(total, split, most)
    target = recall ** (1 / depth)
    open_rows, open_asked = rows.withColumn("node", F.lit("")), asked.withColumn("node", F.lit(""))
    leaves, asked_leaves, summary, past = [], [], [], []
    for level in itertools.count():
        sizes = written(open_rows.groupBy("node").agg(F.count("*").alias("n")), "nodes")
        rate = F.least(F.lit(1.0), F.lit(float(max_fit)) / F.col("n"))
        sample = open_rows.join(sizes.hint("shuffle_hash"), "node").where(F.pmod(F.xxhash64("row", F.lit(level)), F.lit(1 << 30)) < rate * (1 << 30))

        def fit(group: pd.DataFrame) -> pd.DataFrame:
            n = int(group["n"].iloc[0])
            router = fit_router(_matrix(group.sort_values("row")["v"]), parts_of(n, split, most), k, target)
            return pd.DataFrame({"node": [group["node"].iloc[0]], "blocks": [-(-n // BLOCK)], "router": [router.dumped()], "parts": [len(router.bias)], "probes": [router.probes]})

        # a sample is max_fit rows in expectation, whatever a node holds
        routers = written(sample.select("node", "n", "row", "v").groupBy("node").applyInPandas(fit, "node string, blocks int, router binary, parts int, probes int"), "routers")

        def place(key, own: pd.DataFrame, routers: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(routers):
                return own.iloc[:0].drop(columns="block")
            router = Router.loaded(routers["router"].iloc[0])
            part = router.places(_matrix(own["v"])).argmax(axis=1)
            return own.drop(columns="block").assign(node=own["node"] + "." + pd.Series(part.astype(str), index=own.index))

        def route(key, own: pd.DataFrame, routers: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(routers):
                return own.iloc[:0].drop(columns="block")
            router = Router.loaded(routers["router"].iloc[0])
            near = np.argsort(-router.odds(_matrix(own["v"])), axis=1, kind="stable")[:, : router.probes]
            out = own.loc[own.index.repeat(near.shape[1])].drop(columns="block")
            return out.assign(node=out["node"] + "." + pd.Series(near.ravel().astype(str), index=out.index))

        def stepped(df: DataFrame, f, name: str) -> DataFrame:
            counts = df.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
            dealt = df.join(counts.hint("shuffle_hash"), "node").withColumn("block", F.pmod(F.xxhash64("row", "node"), F.col("blocks")).cast("int")).drop("blocks")
            there = routers.select("node", "router").join(counts.hint("shuffle_hash"), "node").select("node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "router")
            schema = ", ".join(f"{c} {t}" for c, t in df.dtypes)
            return written(dealt.groupBy("node", "block").cogroup(there.groupBy("node", "block")).applyInPandas(f, schema), name)

        placed, routed = stepped(open_rows, place, "vectors"), stepped(open_asked, route, "queries")
        made = routers.agg(F.count("*").alias("nodes"), F.sum("parts").alias("parts"), F.sum("probes").alias("probes")).first()
        summary.append({"level": level, "nodes": made["nodes"], "parts": made["parts"] or 0, "probes": made["probes"] or 0})
        # a part with nearly all of its node stays a leaf, however large: copies of one vector cannot be told apart
        grown = placed.groupBy("node").agg(F.count("*").alias("n"))
        before = sizes.select(F.col("node").alias("parent"), F.col("n").alias("all"))
        grown = grown.withColumn("parent", F.regexp_replace("node", r"\.\d+$", "")).join(before.hint("shuffle_hash"), "parent")
        more = written(grown.where((F.col("n") > split) & (F.col("n") < 0.9 * F.col("all"))).select("node"), "split")
        past += [sizes, routers]
        leaves.append(placed.join(more.hint("shuffle_hash"), "node", "left_anti"))
        asked_leaves.append(routed.join(more.hint("shuffle_hash"), "node", "left_anti"))
        if more.isEmpty():
            break
        open_rows, open_asked = placed.join(more.hint("shuffle_hash"), "node", "left_semi"), routed.join(more.hint("shuffle_hash"), "node", "left_semi")
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    discard(*past)
    return union(leaves), union(asked_leaves), summary


def nearest(
    table: DataFrame,
    queries: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    max_fit: int = 8192,
    recall: float = 0.95,
    split: int = SPLIT,
    most: int = MOST_PARTS,
    report: list | None = None,
) -> DataFrame:
    """query_id, rank, id, score of the ``k`` nearest found for each query row.

    ``queries`` is a predicate on the table's columns; all rows are candidates.
    ``report``, if given, gets a summary of the levels (nodes, parts, probes).
    """
    rows = _vectors(table, queries, key, vector)
    lengths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    width = lengths[0]["width"] if lengths else 0
    rows = written(rows.where(F.size("v") == width), "rows")  # fixes the row numbers
    total = rows.count()
    asked = rows.where("query").select("row", "id", "v")
    leaves, routed, summary = build_index(rows.select("row", "id", "v"), asked, total, k, max_fit, recall, split, most)
    if report is not None:
        report.extend(summary)

    held = leaves.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    askers = routed.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("askers"))
    plan = written(held.join(askers.hint("shuffle_hash"), "node"), "leaves")
    candidates = leaves.join(plan.hint("shuffle_hash"), "node").select("node", F.pmod(F.hash("row"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("asker"), "row", "id", "v")
    asking = routed.join(plan.hint("shuffle_hash"), "node").select("node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.hash("row"), "askers").alias("asker"), F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.col("v").alias("query_v"))
    nothing = pd.DataFrame({"query_row": [], "query_id": [], "id": [], "score": []}).astype({"query_row": "int64", "query_id": "int64", "id": "int64", "score": "float64"})

    def rerank(own: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(some):
            return nothing
        ids, numbers, c = own["id"].to_numpy(), own["row"].to_numpy(), _matrix(own["v"])
        out = []
        for at in range(0, len(some), 256):
            part = some.iloc[at : at + 256]
            q = _matrix(part["query_v"])
            rough = q @ c.T
            for number, name, vector, scores in zip(part["query_row"].to_numpy(), part["query_id"].to_numpy(), q, rough, strict=True):
                scores[numbers == number] = -np.inf
                n = int((scores > -np.inf).sum())
                if not n:
                    continue
                least = np.partition(scores, len(scores) - min(k, n))[len(scores) - min(k, n)]
                best = np.flatnonzero(scores >= least - 1e-9 * (1 + abs(least)))  # whatever may tie
                exact = (c[best] * vector).sum(axis=1)  # the same sum for equal vectors
                top = np.lexsort((ids[best], -exact))[:k]
                out.append((np.full(len(top), number), np.full(len(top), name), ids[best][top], exact[top]))
        return pd.DataFrame({name: np.concatenate(column) for name, column in zip(nothing.columns, zip(*out, strict=True), strict=True)}) if out else nothing

    cells = ["node", "block", "asker"]
    found = candidates.groupBy(*cells).cogroup(asking.groupBy(*cells)).applyInPandas(rerank, "query_row long, query_id long, id long, score double")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
