"""p7: sources mixed to target shares of tokens.

1. Distinct texts are counted in tokens of a public tokenizer (map-only) and hashed into ``BLOCKS`` blocks per source: hash
   order is the permutation, so blocks are disjoint, random and alike in size.
2. ``block_plan`` sets each source's quota on the driver from the block totals (at most ``MAX_SOURCES`` x BLOCKS rows, a bound
   that does not grow with the data): whole passes over all blocks, then a partial pass, never more than ``max_repeats`` passes.
3. Blocks are cut finer, by further bits of the hash, until some ``BLOCKS_A_SHARD`` of them make a shard; the number of shards
   grows with the tokens.
4. A splitting tree divides the block quotas among the output shards: at every node the left half's share of each source is
   drawn from the multivariate hypergeometric distribution, so that every shard gets exactly its number of blocks and
   sources meet their quotas exactly. A node's draw is seeded by its place, so every task walks down the tree for its own
   rows; neither the tree nor a list of the blocks is ever built as a whole.
5. Each shard draws its disjoint blocks and shuffles its rows locally. Up to here only ids and digests are shuffled; the texts
   join the finished plan.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.llm.sampling import unit_interval

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Split pattern of the byte-level vocabularies (a fixed value of the public tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Blocks per source (a power of two); a quota is met to within one block, 0.1 % of the source.
BLOCKS = 1024
#: Tokens that a shard should hold, and finer blocks that make one up.
SHARD_TOKENS, BLOCKS_A_SHARD = 50_000_000, 16
#: Share of the tokens at hand below which small sources do not press the default budget.
KEEP = 0.25
#: Sources that a list of targets may name: their block totals come to the driver.
MAX_SOURCES = 2000
#: Bytes of a tokenizer's rank file, which is broadcast.
MAX_VOCABULARY = 64 << 20
_ENCODINGS: dict[bytes, object] = {}


def encoding(vocabulary: bytes):
    """The tokenizer of the contents of a rank file, built once per worker."""
    key = hashlib.sha256(vocabulary).digest()
    if key not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def source_key(source: Column) -> Column:
    """A source regardless of case, outer spaces and - for _."""
    return F.translate(F.lower(F.trim(source)), "-", "_")


@dataclass
class Quota:
    """What one source gives: whole passes, blocks of the last partial pass, its tokens and what the plan reaches."""

    passes: int
    partial: int
    available: int
    wanted: float


def block_plan(totals: dict[str, np.ndarray], targets: dict[str, tuple[float, int]], budget: int | None, keep: float = KEEP) -> dict[str, Quota]:
    """Quota of every source from its tokens per block.

    budget: tokens of the whole mixture. By default it is the most at which every source that has documents reaches its
    share; sources so small that this would take less than ``keep`` of the tokens at hand do not hold it down, they are
    taken ``max_repeats`` times and reported as short, while the others keep their proportions.
    """
    size = {s: int(totals[s].sum()) if s in totals else 0 for s in targets}
    if budget is None:
        budget = sum(size.values())
        reach = [size[s] * repeats / share for s, (share, repeats) in targets.items() if size[s] and share > 0]
        budget = int(min([budget, *(r for r in reach if r >= keep * budget)]))
    plan = {}
    for s, (share, repeats) in targets.items():
        wanted, held = share * budget, size[s]
        if not held:
            plan[s] = Quota(0, 0, 0, wanted)
            continue
        passes = min(int(wanted // held), repeats)
        rest = wanted - passes * held
        upto = np.cumsum(totals[s])
        partial = int(np.argmin(np.abs(np.concatenate([[0], upto]) - rest))) if passes < repeats else 0
        plan[s] = Quota(passes, partial, held, wanted)
    return plan


@dataclass
class SplittingTree:
    """Block draws of every source divided among ``shards``.

    Every shard gets the same number of blocks (to within one); each node draws its left part at random without replacement
    from the node's blocks, seeded by the node's place in the tree.
    """

    quotas: np.ndarray
    shards: int
    seed: int

    def end(self, shard: int) -> int:
        return shard * int(self.quotas.sum()) // self.shards

    def left(self, low: int, high: int, have: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng([self.seed, low, high])
        return rng.multivariate_hypergeometric(have, self.end((low + high) // 2) - self.end(low), method="marginals")

    def shard_of(self, source: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The shard of the draws with the given numbers, counted from 0 within their source."""
        out = np.zeros(len(rank), np.int64)
        todo = [(0, self.shards, self.quotas.astype(np.int64), np.arange(len(rank)), rank.astype(np.int64))]
        while todo:
            low, high, have, rows, at = todo.pop()
            if not len(rows) or high - low == 1:
                out[rows] = low
                continue
            left = self.left(low, high, have)
            to_left = at < left[source[rows]]
            middle = (low + high) // 2
            todo.append((low, middle, left, rows[to_left], at[to_left]))
            right = ~to_left
            todo.append((middle, high, have - left, rows[right], at[right] - left[source[rows[right]]]))
        return out


class Mixture:
    """The planned mixture of ``documents`` (``doc_id, text, source``) by ``targets`` (``source, target_share, max_repeats``).

    Rows with a null doc_id or text and sources without a target take no part. A text that stands under several ids is one
    text: it belongs to the source of its smallest id that has a target, and its repeats count together. Targets without documents are
    reported with a share of 0.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, budget: int | None = None, seed: int = 7, salt: str = "p7", shard_tokens: int = SHARD_TOKENS, keep: float = KEEP) -> None:
        self.spark, self.documents, self.salt, self.seed = documents.sparkSession, documents, f"{salt}:{seed}", seed
        wanted = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null and target_share is not null")
        listed = wanted.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")).limit(MAX_SOURCES + 1).collect()
        if len(listed) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        self.targets = {r.source: (float(r.target_share), int(r.max_repeats or 1)) for r in listed}
        self.names = sorted(self.targets)
        vocabulary = Path(tokenizer).read_bytes()
        if len(vocabulary) > MAX_VOCABULARY:
            raise ValueError("the tokenizer's file is too large to broadcast")
        self.docs = self._counted(vocabulary).persist(StorageLevel.DISK_ONLY)
        totals: dict[str, np.ndarray] = {}
        block = F.floor(F.col("u") * BLOCKS).cast("int")
        for k, b, n in self.docs.groupBy("k", block.alias("block")).agg(F.sum("n_tokens")).collect():  # at most sources x BLOCKS rows
            totals.setdefault(self.names[k], np.zeros(BLOCKS, np.int64))[b] = n
        self.totals = totals
        self.plan = block_plan(totals, self.targets, budget, keep)
        reached = sum(map(self._tokens, self.plan))
        self.shards = max(8, -(-reached // shard_tokens))
        drawn = sum(q.passes * BLOCKS + q.partial for q in self.plan.values())
        # Blocks are cut into a power of two of finer ones.
        self.fine = 1 << max(0, math.ceil(math.log2(max(1.0, BLOCKS_A_SHARD * self.shards / max(1, drawn)))))

    def _known(self) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame([(s, k) for k, s in enumerate(self.names)], "source string, k int"))

    def _counted(self, vocabulary: bytes) -> DataFrame:
        """``doc_id, digest, k, n_tokens, u`` of every distinct text: its place u in hash order and its source's number k."""
        rows = self.documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_key(F.col("source")).alias("source"), "text").filter("doc_id is not null and text is not null")
        rows = rows.join(self._known(), "source").select("doc_id", "k", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
        shared = self.spark.sparkContext.broadcast(vocabulary)  # a file of some megabytes, so executors need no copy of it

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = encoding(shared.value)
            for frame in frames:
                yield frame[["doc_id", "k", "digest"]].assign(n_tokens=list(map(len, own.encode_ordinary_batch(frame["text"].tolist(), num_threads=1))))

        counted = rows.mapInPandas(count, "doc_id bigint, k int, digest binary, n_tokens bigint")
        # One text, one row. Only digests are shuffled, and map-side aggregation leaves one row per text and task.
        single = counted.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min_by("k", "doc_id").alias("k"), F.max("n_tokens").alias("n_tokens"))
        return single.select("doc_id", "digest", "k", "n_tokens", unit_interval(F.col("doc_id"), self.salt).alias("u"))

    def _tokens(self, source: str) -> int:
        q = self.plan[source]
        if source not in self.totals:
            return 0
        return int(q.passes * q.available + self.totals[source][: q.partial].sum())

    def shares(self) -> DataFrame:
        """``source, target_share, actual_share, tokens, available_tokens, max_repeats, repeats_used, reached``."""
        tokens = {s: self._tokens(s) for s in self.plan}
        total = sum(tokens.values())
        rows = []
        for s, (share, repeats) in sorted(self.targets.items()):
            q = self.plan[s]
            actual = tokens[s] / total if total else 0.0
            rows.append((s, share, actual, tokens[s], q.available, repeats, q.passes + (q.partial > 0), abs(actual - share) <= max(0.005, 0.02 * share)))
        schema = "source string, target_share double, actual_share double, tokens bigint, available_tokens bigint, max_repeats int, repeats_used int, reached boolean"
        return self.spark.createDataFrame(rows, schema)

    def rows(self) -> DataFrame:
        """``shard, position, doc_id, source, repeat, n_tokens, text``: the mixture, shuffled within each shard."""
        quotas = [self.plan[s] for s in self.names]
        sizes = F.broadcast(self.spark.createDataFrame([(k, q.passes, q.partial) for k, q in enumerate(quotas)], "k int, passes int, partial int"))
        tree = SplittingTree(np.array([(q.passes * BLOCKS + q.partial) * self.fine for q in quotas], np.int64), self.shards, self.seed)
        blocks = BLOCKS * self.fine
        times = F.col("passes") + (F.floor(F.col("u") * BLOCKS) < F.col("partial")).cast("int")
        drawn = self.docs.join(sizes, "k").filter(times > 0)
        drawn = drawn.select("doc_id", "digest", "k", "n_tokens", F.floor(F.col("u") * blocks).cast("bigint").alias("block"), "passes", F.explode(F.sequence(F.lit(0), times - 1)).alias("repeat"))
        # Whole passes take the blocks in another order each (an affine permutation), the partial one as they come.
        step = (F.col("block") * (2 * F.col("repeat") + 1) + F.col("repeat") * (blocks // 3)) % blocks
        drawn = drawn.withColumn("rank", F.col("repeat").cast("bigint") * blocks + F.when(F.col("repeat") < F.col("passes"), step).otherwise(F.col("block")))

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                shard = tree.shard_of(frame["k"].to_numpy(), frame["rank"].to_numpy())
                yield frame[["doc_id", "digest", "k", "n_tokens", "repeat"]].assign(shard=shard)

        placed = drawn.mapInPandas(place, "doc_id bigint, digest binary, k int, n_tokens bigint, repeat int, shard bigint")
        rows = self.documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_key(F.col("source")).alias("source"), "text").filter("doc_id is not null and text is not null")
        texts = rows.join(self._known(), "source", "left_semi").select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
        texts = texts.groupBy("doc_id", "digest").agg(F.first("text").alias("text"))  # repeated rows of a document are one
        mixed = placed.join(texts, ["doc_id", "digest"]).join(self._known(), "k")
        mixed = mixed.withColumn("position", F.xxhash64(F.lit(self.salt), "shard", "doc_id", "repeat"))
        return mixed.repartition("shard").sortWithinPartitions("shard", "position", "doc_id", "repeat").select("shard", "position", "doc_id", "source", "repeat", "n_tokens", "text")
