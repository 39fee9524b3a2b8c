"""Texts into containers of a fixed number of tokens (problem 7).

Optimal length buckets: dynamic programming over the global histogram of sizes places the bucket bounds so that padding
to the bounds is least. Token-budget batches form inside the buckets: a container takes as many items of its main bucket
as fit. What room is left there is given to smaller buckets, largest first, because batches of one bucket alone leave
much of it unused where items are longer than half a container (README has both figures). The plan of containers is made
from bucket counts alone; items find their container by their rank inside the bucket, which is counted in salted parts.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.durable import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's published pre-tokenisation pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
BUCKETS = 96
#: Pieces of a bucket that one task numbers.
NUMBERED = 100_000
#: Longer texts are tokenised in parts of at least so many characters.
PART = 50_000
_CUT = re.compile(r"\S(?= )")

_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def parts(text: str, size: int = PART) -> Iterator[str]:
    """`text` in parts that have the tokens of the whole: cut only between a character that is no white space and a blank.
    No alternative of PATTERN reaches over such a place or looks past it, so the pre-tokens, and with them the tokens, are
    the same. A text without such a place stays whole."""
    at = 0
    while len(text) - at > size and (m := _CUT.search(text, at + size - 1)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def count_tokens(df: DataFrame, ident: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(ident, n_tokens); a null text has no tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(tokenizer)
        for b in batches:
            yield pd.DataFrame({ident: b[ident], "n_tokens": [sum(len(enc.encode_ordinary(p)) for p in parts(t)) if t else 0 for t in b[text]]})

    kind = df.schema[ident].dataType.simpleString()
    return df.select(ident, text).mapInPandas(run, f"{ident} {kind}, n_tokens bigint")


def optimal_bounds(sizes: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Upper bounds of at most `buckets` buckets over the sorted `sizes` that minimise the sum of bound - size."""
    m = len(sizes)
    if m <= buckets:
        return np.array(sizes)
    n, w = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    # cost[i, j]: padding of sizes i..j-1 in one bucket
    cost = np.where(np.arange(m + 1)[:, None] < np.arange(1, m + 1)[None, :], (n[None, 1:] - n[:, None]) * sizes[None, :] - (w[None, 1:] - w[:, None]), np.inf)
    best, back = cost[0].copy(), [np.zeros(m, int)]
    for _ in range(buckets - 1):
        total = best[:, None] + cost[1:, :]
        arg = total.argmin(axis=0)
        better = total[arg, np.arange(m)] < best
        back.append(np.where(better, arg + 1, -1))
        best = np.minimum(best, total[arg, np.arange(m)])
    bounds, j, k = [], m - 1, len(back) - 1
    while True:
        bounds.append(sizes[j])
        while k > 0 and back[k][j] < 0:
            k -= 1
        i = back[k][j]
        if i == 0:
            return np.array(bounds[::-1])
        j, k = i - 1, k - 1


def plan(bounds: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Segments (bucket, first rank, items per container, first container, containers) that place every rank once.

    Each round opens containers for the largest bucket that has items, fills them downwards and repeats the same filling
    as often as the counts allow; a round empties at least one bucket or is followed by one that does."""
    left, used, out, container = counts.astype(np.int64).copy(), np.zeros(len(bounds), np.int64), [], 0
    while left.any():
        room, take = capacity, {}
        for b in range(len(bounds) - 1, -1, -1):
            if left[b] and bounds[b] <= room:
                take[b] = int(min(room // bounds[b], left[b]))
                room -= take[b] * int(bounds[b])
        times = int(min(left[b] // t for b, t in take.items()))
        for b, t in take.items():
            out.append((b, int(used[b]), t, container, times))
            used[b] += t * times
            left[b] -= t * times
        container += times
    return out


def pack(docs: DataFrame, ident: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, buckets: int = BUCKETS, tokens: DataFrame | None = None) -> DataFrame:
    """(ident, piece, n_tokens, container_id): no container holds more than `capacity` tokens.

    Texts over the capacity are split into full pieces, each a container of its own, and a rest that is packed like any
    other; all others are one piece. Empty and null texts take no room and stand in container 0. Repeated rows of an
    identifier count as items of their own (they have the same piece number). `tokens`: sizes if they are known."""
    sizes = cut(tokens if tokens is not None else count_tokens(docs, ident, text, tokenizer), "pack-sizes")
    pieces = F.when(F.col("n_tokens") <= capacity, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.ceil(F.col("n_tokens") / capacity) - 1).cast("int")))
    items = sizes.withColumn("piece", F.explode(pieces)).withColumn("n_tokens", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("bigint"))
    hist = sorted((r.n_tokens, r.n) for r in items.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect())  # at most `capacity` rows
    length, count = np.array([h[0] for h in hist], dtype=np.int64), np.array([h[1] for h in hist], dtype=np.int64)
    bounds = optimal_bounds(length, count, buckets) if len(hist) else np.array([capacity])
    in_bucket = np.zeros(len(bounds), np.int64)
    np.add.at(in_bucket, np.searchsorted(bounds, length), count)
    segments = pd.DataFrame(plan(bounds, in_bucket, capacity), columns=["bucket", "rank", "per", "container", "times"], dtype="int64").sort_values(["bucket", "rank"])

    @F.pandas_udf("int")
    def bucket_of(n: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, n.to_numpy()))

    # how many parts a bucket is numbered in grows with its pieces, so no task holds more than NUMBERED or so
    salts = np.maximum(1, -(-in_bucket // NUMBERED))
    first = np.concatenate([[0], np.cumsum(salts)])

    @F.pandas_udf("int")
    def salt_of(bucket: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series((h.to_numpy() % salts[bucket.to_numpy()]).astype(np.int32))

    filled = items.where("n_tokens > 0").withColumn("bucket", bucket_of("n_tokens"))
    salted = filled.withColumn("salt", salt_of("bucket", F.pmod(F.xxhash64(ident, "piece"), F.lit(1 << 40))))
    held = np.zeros(first[-1] + 1, np.int64)
    for r in salted.groupBy("bucket", "salt").agg(F.count("*").alias("n")).collect():  # at most pieces / NUMBERED + buckets rows
        held[first[r.bucket] + r.salt + 1] = r.n
    before = np.cumsum(held)

    @F.pandas_udf("bigint")
    def container_of(bucket: pd.Series, salt: pd.Series, nth: pd.Series) -> pd.Series:
        out = np.zeros(len(bucket), np.int64)
        b = bucket.to_numpy()
        rank = before[first[b] + salt.to_numpy()] - before[first[b]] + nth.to_numpy() - 1
        for k in np.unique(b):
            own, here = segments[segments.bucket == k], b == k
            at = np.searchsorted(own["rank"].to_numpy(), rank[here], side="right") - 1
            seg = own.iloc[at]
            out[here] = seg["container"].to_numpy() + (rank[here] - seg["rank"].to_numpy()) // seg["per"].to_numpy()
        return pd.Series(out)

    nth = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy(ident, "piece"))
    packed = salted.withColumn("_nth", nth).select(ident, "piece", "n_tokens", container_of("bucket", "salt", "_nth").alias("container_id"))
    return packed.unionByName(items.where("n_tokens = 0").select(ident, "piece", "n_tokens", F.lit(0).cast("bigint").alias("container_id")))
