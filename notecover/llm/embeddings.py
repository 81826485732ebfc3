"""Near-duplicate vectors by randomised-rotation binary codes (operator 7).

A vector is normalised, turned by a fixed random rotation into a space of four times its
dimension, and kept as the signs there plus one correction factor, its inner product with
its own sign vector. Signs against an exactly rotated vector, divided by that factor, give
an unbiased estimate of the cosine with a known spread; only pairs whose upper confidence
bound reaches the limit are recomputed exactly, in double precision.

Vectors of one label are dealt into blocks of bounded size and the blocks are compared with
each other inside tasks, so a label that holds a third of all rows is many tasks, and no
pair is emitted: a task returns the number of links and a root per vector. Copies are one
class with a count, compared once.

Defined cases: a vector with a null label, a null, empty or zero embedding, or null or
non-finite components links with nothing (0 links, itself as component, kept); vectors of
different length do not link; repeated rows are copies and link with each other; a null
vec_id takes part and is not kept; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notecover.llm import common as C


@dataclass(frozen=True)
class RotationCodes:
    cosine: float = 0.98
    block: int = 1024
    widen: int = 4
    spread: float = 5.0          # confidence bound, in standard deviations
    seed: int = 20


def rotation(dim: int, p: RotationCodes) -> np.ndarray:
    """dim orthonormal columns of a random rotation of the wider space."""
    g = np.random.default_rng([p.seed, dim]).standard_normal((max(128, p.widen * dim), dim))
    return np.linalg.qr(g)[0]


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, correction factors, rotated vectors)."""
    r = unit @ turn.T
    factor = np.abs(r).sum(axis=1) / np.sqrt(turn.shape[0])
    return np.packbits(r > 0, axis=1), factor, r


def upper_bounds(code: np.ndarray, factor: np.ndarray, rotated: np.ndarray, p: RotationCodes) -> np.ndarray:
    """Upper confidence bounds of the cosines of coded rows with rotated rows."""
    width = rotated.shape[1]
    signs = np.unpackbits(code, axis=1, count=width).astype(np.float32) * 2 - 1
    est = signs @ rotated.T.astype(np.float32) / (np.sqrt(width) * factor[:, None])
    slack = p.spread * np.sqrt(np.maximum(1 - factor ** 2, 0)) / factor / np.sqrt(width - 1)
    return est + slack[:, None] + 1e-5


def _coder(p: RotationCodes):
    def run(batches):
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            emb, dims = batch.column(1), batch.column(2).to_numpy()
            codes: list = [None] * batch.num_rows
            factors = np.zeros(batch.num_rows)
            flat = emb.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            start = np.concatenate([[0], np.cumsum(dims)])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = flat[start[at][:, None] + np.arange(d)]
                turn = turns.setdefault(int(d), rotation(int(d), p))
                code, f, _ = encode(x / np.linalg.norm(x, axis=1, keepdims=True), turn)
                factors[at] = f
                for i, c in zip(at, code):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), emb, batch.column(2), pa.array(codes, pa.binary()), pa.array(factors)],
                                             names=["node", "embedding", "dim", "code", "factor"])
    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each component of the links (a, b) between 0..n-1."""
    root = np.arange(n)
    while len(a):
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == old).all():
            break
    return root


def _compare(p: RotationCodes):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")
        first, second = table["bi"][0].as_py(), table["bj"][0].as_py()
        node, mult = table["node"].to_numpy(), table["mult"].to_numpy()
        side = table["block"].to_numpy()
        d = table["dim"][0].as_py()
        x = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(node), d)
        norm = np.sqrt((x * x).sum(axis=1))
        turn = rotation(d, p)
        rotated = (x / norm[:, None]) @ turn.T
        code = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(len(node), -1)
        factor = table["factor"].to_numpy()
        left, right = np.flatnonzero(side == first), np.flatnonzero(side == second)
        a_all, b_all = [], []
        if len(left) and len(right):
            for s in range(0, len(left), 256):
                rows = left[s:s + 256]
                i, j = np.nonzero(upper_bounds(code[rows], factor[rows], rotated[right], p) >= p.cosine)
                a, b = rows[i], right[j]
                if first == second:
                    a, b = a[a < b], b[a < b]
                for t in range(0, len(a), 1 << 16):                       # the exact recomputation
                    aa, bb = a[t:t + (1 << 16)], b[t:t + (1 << 16)]
                    ok = np.einsum("ij,ij->i", x[aa], x[bb]) / (norm[aa] * norm[bb]) >= p.cosine
                    a_all.append(aa[ok])
                    b_all.append(bb[ok])
        a = np.concatenate(a_all) if a_all else np.zeros(0, np.int64)
        b = np.concatenate(b_all) if b_all else np.zeros(0, np.int64)
        links = np.bincount(a, mult[b], len(node)) + np.bincount(b, mult[a], len(node))
        root = _roots(len(node), a, b)
        some = np.flatnonzero(links)
        return pa.table({"node": node[some], "links": links[some].astype(np.int64), "root": node[root[some]]})
    return run


def near_duplicate_vectors(vectors: DataFrame, p: RotationCodes = RotationCodes()) -> DataFrame:
    """One row per row of vectors(vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    v = C.only(vectors, vec_id="bigint", embedding="array<float>", label="bigint")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    able = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    v = (v.withColumn("able", able).withColumn("dim", F.size("embedding"))
         .withColumn("node", F.xxhash64("label", "embedding")).withColumn("again", F.xxhash64(F.lit(7), "embedding", "label")))
    v = C.cut_lineage(v)
    keys = ["label", "dim", "node", "again"]
    classes = v.filter("able").groupBy(*keys).agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("mult"))
    one = v.filter("able").select(*keys, "vec_id", "embedding")
    full = one.join(classes, [one[k] == classes[k] for k in keys] + [classes.least.eqNullSafe(one.vec_id)]).select(
        *[one[k] for k in keys], "embedding", "mult", "least").dropDuplicates(["node"])
    coded = C.arrow_map(full.select("node", "embedding", "dim"), _coder(p), "node bigint, embedding array<float>, dim int, code binary, factor double")
    nodes = C.cut_lineage(coded.join(full.select("node", "label", "mult", "least"), "node"))

    blocks = nodes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / p.block).cast("int").alias("nb"))
    dealt = (nodes.drop("least").join(blocks, ["label", "dim"])
             .withColumn("block", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("nb")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")))
    found = C.cut_lineage(C.arrow_groups(dealt.select("label", "dim", "bi", "bj", "block", "node", "mult", "embedding", "code", "factor"),
                                         ["label", "dim", "bi", "bj"], _compare(p), "node bigint, links bigint, root bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = C.components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = (nodes.select("node", "mult", "least").join(links, "node", "left").join(comp, "node", "left")
             .withColumn("root", F.coalesce("root", "node"))
             .withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("mult") - 1))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("node", "n_links", "component_id")
    out = v.select("vec_id", "able", F.when(F.col("able"), F.col("node")).alias("node")).join(named, "node", "left")
    cid = F.when(F.col("able"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), cid.alias("component_id"),
                      F.coalesce(F.col("vec_id") == cid, F.lit(False)).alias("kept"))
