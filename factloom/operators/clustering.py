"""Greedy clusters of documents: events (same happening, close in time) and narratives (same message).

Both are defined by the order in which documents are taken, so each runs as a sequential grouped map. Events are cut
losslessly first: once two consecutive times are farther apart than the window, no later document reaches an earlier
cluster, so each stretch is a group of its own. Documents without time come last, in one pass over the clusters' final
centroids: that task holds centroids and these documents, not the corpus. Narratives have no such cut; pass `by` where the
corpus has a partition (topic, language) that clusters shall not cross.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import durable
from factloom import registries as R
from factloom.operators import intervals


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return (m / np.where(n == 0, 1, n)).astype(np.float32)


class Clusters:
    """Growing clusters: normalised running mean, size and first time of each."""

    def __init__(self, dim: int):
        self.means, self.first, self.sizes = np.zeros((16, dim), np.float32), np.full(16, np.nan), []

    def add(self, mean: np.ndarray, first: float, size: int) -> int:
        k = len(self.sizes)
        if k == len(self.means):
            self.means, self.first = np.vstack([self.means, np.zeros_like(self.means)]), np.concatenate([self.first, np.full(k, np.nan)])
        self.means[k], self.first[k] = mean, first
        self.sizes.append(size)
        return k

    def place(self, v: np.ndarray, at: float | None, threshold: float, window: float) -> int:
        """The cluster that a unit vector joins or begins. at: no earlier than before; NaN where unknown, None to ignore time."""
        k = len(self.sizes)
        # times come in order, so clusters' first times do too: what began before the window is out of reach
        low = int(np.searchsorted(self.first[:k], at - window)) if at is not None and not np.isnan(at) else 0
        if k > low:
            sim = self.means[low:k] @ v
            if float(sim.max()) >= threshold:
                best = k - 1 - int(sim[::-1].argmax())  # the later cluster wins ties
                n = self.sizes[best] = self.sizes[best] + 1
                self.means[best] = _unit(self.means[best] * ((n - 1) / n) + v / n)
                return best
        return self.add(v, np.nan if at is None else at, 1)


def greedy(vectors: np.ndarray, times: np.ndarray | None, threshold: float, window: float, clusters: Clusters | None = None) -> np.ndarray:
    """Cluster number of each row, rows taken as they stand. times: in order, then NaN where unknown; None to ignore time."""
    held = clusters if clusters is not None else Clusters(vectors.shape[1])
    return np.array([held.place(v, None if times is None else times[i], threshold, window) for i, v in enumerate(_unit(vectors))], np.int64)


def cluster_ids(members: DataFrame, keys: list[str], prefix: str, ident: str = "doc_id") -> DataFrame:
    """(keys, cluster_id): prefix and hash of each cluster's sorted, distinct member identifiers.

    Members are sorted inside partitions and hashed as they pass, so no cluster is ever gathered in a row."""
    kinds = ", ".join(f"{k} {members.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest, last = None, None, None
        done: list[tuple] = []
        for b in batches:
            for *key, member in zip(*[b[k] for k in keys], b["_m"], strict=True):
                if key != now:
                    if digest is not None:
                        done.append((*now, f"{prefix}:{digest.hexdigest()[:21]}"))
                    now, digest, last = key, hashlib.sha256(member.encode()), member
                elif member != last:
                    digest.update(("|" + member).encode())
                    last = member
            yield pd.DataFrame(done, columns=[*keys, "cluster_id"])
            done = []
        if digest is not None:
            yield pd.DataFrame([(*now, f"{prefix}:{digest.hexdigest()[:21]}")], columns=[*keys, "cluster_id"])

    rows = members.where(F.col(ident).isNotNull()).select(*keys, F.col(ident).cast("string").alias("_m"))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "_m").mapInPandas(run, f"{kinds}, cluster_id string")


def _members(numbered: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    numbered = durable.cut(numbered, "clustered")
    return numbered.join(cluster_ids(numbered, [*keys, "cluster"], prefix), [*keys, "cluster"]).select("cluster_id", "doc_id", "step")


def events(docs: DataFrame, threshold: float = R.EVENT_COSINE, window_days: float = R.EVENT_WINDOW_DAYS) -> DataFrame:
    """(event_id, doc_id, step) of documents (doc_id, published, embedding), oldest first, unknown times last.

    step is the order of processing inside a group. Documents without a vector, or with an empty one, are in no event;
    a zero vector is alone. Ties in time go by doc_id."""
    window = window_days * 86400.0
    usable = docs.where("embedding is not null and size(embedding) > 0").select("doc_id", (F.unix_micros("published") / 1e6).alias("at"), "embedding")
    usable = durable.cut(usable, "to-cluster")
    stretch = intervals.stretches(usable.where("at is not null").select("doc_id", "at"), [], "at", window).select("doc_id", "stretch")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["at", "doc_id"]).reset_index(drop=True)
        vectors = np.stack(part["embedding"].to_list()).astype(np.float32)
        held = Clusters(vectors.shape[1])
        found = greedy(vectors, part["at"].to_numpy(dtype=float), threshold, window, held)
        out = pd.DataFrame({"doc_id": part["doc_id"], "stretch": part["stretch"], "cluster": found, "step": np.arange(len(part))})
        # each cluster's state goes with its last member
        last = ~out["cluster"].duplicated(keep="last")
        out["mean"] = [held.means[c].tolist() if z else None for c, z in zip(found, last, strict=True)]
        out["size"] = np.where(last, np.array(held.sizes)[found], 0)
        return out

    numbered = usable.where("at is not null").join(stretch, "doc_id").groupBy("stretch").applyInPandas(run, f"doc_id {kind}, stretch bigint, cluster bigint, step bigint, mean array<float>, size bigint")
    numbered = durable.cut(numbered, "timed-clusters")
    members = numbered.select("doc_id", "stretch", "cluster", "step")
    untimed = usable.where("at is null")
    if untimed.isEmpty():
        return _members(members, "evt", ["stretch"]).withColumnRenamed("cluster_id", "event_id")

    def late(part: pd.DataFrame) -> pd.DataFrame:
        states = part[part["size"] > 0].sort_values(["stretch", "cluster"])
        rest = part[part["size"] == 0].sort_values("doc_id").reset_index(drop=True)
        vectors = np.stack(rest["embedding"].to_list()).astype(np.float32)
        held = Clusters(vectors.shape[1])
        for m, n in zip(states["embedding"], states["size"], strict=True):
            held.add(np.asarray(m, np.float32), np.nan, int(n))
        found = greedy(vectors, np.full(len(rest), np.nan), threshold, window, held)
        old = len(states)
        stretch_of = np.concatenate([states["stretch"].to_numpy(), np.full(len(held.sizes) - old, -1)])
        cluster_of = np.concatenate([states["cluster"].to_numpy(), np.arange(len(held.sizes) - old)])
        # behind all timed members in the order of processing
        return pd.DataFrame({"doc_id": rest["doc_id"], "stretch": stretch_of[found], "cluster": cluster_of[found], "step": (1 << 40) + np.arange(len(rest))})

    states = numbered.where("size > 0").select("doc_id", "stretch", "cluster", F.col("mean").alias("embedding"), "size")
    waiting = untimed.select("doc_id", F.lit(0).cast("bigint").alias("stretch"), F.lit(0).cast("bigint").alias("cluster"), "embedding", F.lit(0).cast("bigint").alias("size"))
    joined = states.unionByName(waiting).withColumn("_one", F.lit("")).groupBy("_one").applyInPandas(late, f"doc_id {kind}, stretch bigint, cluster bigint, step bigint")
    return _members(members.unionByName(joined), "evt", ["stretch"]).withColumnRenamed("cluster_id", "event_id")


def narratives(docs: DataFrame, threshold: float = R.NARRATIVE_COSINE, least: int = R.NARRATIVE_MIN_SIZE, by: Column | None = None) -> DataFrame:
    """(narrative_id, doc_id, step) of the clusters of `least` or more documents (doc_id, embedding), taken by doc_id."""
    usable = docs.where("embedding is not null and size(embedding) > 0").select("doc_id", "embedding", (by if by is not None else F.lit("")).cast("string").alias("part"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id").reset_index(drop=True)
        found = greedy(np.stack(part["embedding"].to_list()).astype(np.float32), None, threshold, 0.0)
        keep = np.bincount(found)[found] >= least
        return pd.DataFrame({"doc_id": part["doc_id"], "part": part["part"], "cluster": found, "step": np.arange(len(part))})[keep]

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = usable.groupBy("part").applyInPandas(run, f"doc_id {kind}, part string, cluster bigint, step bigint")
    return _members(numbered, "nar", ["part"]).withColumnRenamed("cluster_id", "narrative_id")
