"""p2: records that differ only in dress, collapsed to one each with the number of their copies.

1. ``canonical`` brings a text to canonical bytes with built-in expressions.
2. Every partition counts its own keys in a trie first, so that a key held by a third of all rows leaves each partition as
   one row per batch.
3. ``radix_levels`` partitions the canonical bytes recursively: buckets (byte prefixes) that hold more than ``BUCKET_BYTES``
   are split by further bytes until each fits. The limit is fixed and does not grow with the data; the oversized prefixes of
   every level stay a distributed table, known by 64-bit hashes, and nothing of them goes through the driver.
4. Every bucket is counted in a path-compressed trie with terminal counters.

A trie takes some seven times the bytes of its keys, so a worker holds some 60 MB for a bucket. Two prefixes of one hash would
share a bucket, which changes nothing, as tries hold whole keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.functions.text import let
from glossaflow.operators.manifests import bounded

#: Bytes of the prefixes at each level; doubling bounds the levels by the logarithm of the longest key.
FIRST_DEPTH, LAST_DEPTH = 4, 1 << 30
#: Levels that are sized in one pass over the keys.
DEPTHS_A_PASS = 3
#: Bytes of keys above which a bucket is split.
BUCKET_BYTES = 8 << 20
#: Groups with more than 1/HOT_GROUPS of all records are joined map-side; there are fewer than HOT_GROUPS of them.
HOT_GROUPS = 1 << 14

_MARK = r"[^\p{L}\p{M}\p{N}]"
#: Runs of marks and white space that do not count: any run but one that stands directly between two digits.
_DRESS = rf"(?U)[^\p{{L}}\p{{M}}\p{{N}}\s]*+\s{_MARK}*+|(?<!\p{{Nd}}|{_MARK}){_MARK}++|{_MARK}++(?!\p{{Nd}})"
_LABEL = r"[\W_]*\p{L}[\p{L}\p{M}\p{N}_.\-]*(?: [\p{L}\p{M}\p{N}_.\-]+){0,7}\s*:"
_FIELD = rf"(?sU)^{_LABEL}\s*[^\s:].*$"
#: Separators of fields: only those that a label follows, so that values may hold them, and colons.
_SEPARATORS = rf"(?U)[|;\u037e\uff1b/•·\n,]+(?={_LABEL})"


def _bare(text: Column) -> Column:
    return F.translate(F.lower(F.regexp_replace(text, _DRESS, "")), "ς", "σ")


def _fields(text: Column) -> Column:
    return F.filter(F.split(text, _SEPARATORS), lambda part: _bare(part) != "")


def _all_labelled(parts: Column) -> Column:
    return (F.size(parts) >= 2) & F.forall(parts, lambda part: F.regexp_like(F.trim(part), F.lit(_FIELD)))


def _field_key(parts: Column) -> Column:
    pair = lambda part: F.concat(
        _bare(F.substring_index(part, ":", 1)), F.lit("\x01"), _bare(F.substring(part, F.instr(part, ":") + 1, 1 << 30))
    )
    return F.concat(F.lit("\x03"), F.array_join(F.array_sort(F.transform(parts, pair)), "\x02"))


def canonical(text: Column) -> Column:
    """Canonical form of a record: white space, case (σ and ς alike) and marks removed, labelled fields sorted.

    A mark between two digits stays, as do accents and word order. Null stays null; a text of marks only becomes ''.
    Fields are looked for only in texts with a colon; they part where a separator and a label follow each other.
    """
    fields = lambda t: let(_fields(t), lambda parts: F.when(_all_labelled(parts), _field_key(parts)))
    return F.coalesce(F.when(text.contains(":"), fields(text)), _bare(text))


class CountingTrie:
    """Path-compressed byte trie; a terminal node counts its key and keeps the smallest id."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list = [b"", {}, 0, None]  # label, children by first byte, terminal count, smallest id

    def add(self, key: bytes, n: int, first: str) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node[2] += n
                node[3] = first if node[3] is None or first < node[3] else node[3]
                return
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, n, first]
                return
            label = child[0]
            if not key.startswith(label, at):
                same = _common(label, key, at)
                upper = [label[:same], {label[same]: child}, 0, None]
                child[0] = label[same:]
                node[1][key[at]] = child = upper
                label = upper[0]
            node, at = child, at + len(label)

    def items(self) -> Iterator[tuple[bytes, int, str]]:
        stack = [(b"", self.root)]
        while stack:
            before, node = stack.pop()
            key = before + node[0]
            if node[2]:
                yield key, node[2], node[3]
            stack.extend((key, child) for child in node[1].values())


def _common(label: bytes, key: bytes, at: int) -> int:
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[:middle] == key[at : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


#: A partition's own trie is emptied at this many key bytes.
_LOCAL_BYTES = 16 << 20


def _count_locally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trie, held = CountingTrie(), 0
    for frame in frames:
        for key, first in zip(frame["key"], frame["id"]):
            trie.add(bytes(key), 1, first)
            held += len(key)
        if held > _LOCAL_BYTES:
            yield _frame(trie.items())
            trie, held = CountingTrie(), 0
    yield _frame(trie.items())


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["key", "n", "kept_id"])


def _count_buckets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by bucket, so one trie is held at a time."""
    bucket, trie = None, CountingTrie()
    for frame in frames:
        done = []
        for b, key, n, first in zip(frame["bucket"], frame["key"], frame["n"], frame["kept_id"]):
            if b != bucket:
                done.extend(trie.items())
                bucket, trie = b, CountingTrie()
            trie.add(bytes(key), int(n), first)
        yield _frame(done)
    yield _frame(trie.items())


def _prefix(depth: int) -> Column:
    return F.xxhash64(F.lit(depth), F.substring("key", 1, depth))


def radix_levels(partial: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[list[tuple[int, DataFrame]], int]:
    """``(depth, prefixes)`` of every level that has oversized prefixes, each a table of hashes, and the depth below the last.

    A pass sizes ``DEPTHS_A_PASS`` levels of the keys inside the last oversized prefixes, map-side combined; only hashes and
    sizes are shuffled. A key that is no longer than the depth cannot be split further and is not counted.
    """
    levels, depth, inside = [], FIRST_DEPTH, partial.select("key")
    while depth < LAST_DEPTH:
        depths = [depth << i for i in range(DEPTHS_A_PASS)]
        size = F.length("key")
        parts = F.filter(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix"), size.alias("size")) for d in depths]), lambda p: p["size"] > p["depth"])
        sized = inside.select(F.explode(parts).alias("p")).groupBy("p.depth", "p.prefix").agg(F.sum("p.size").alias("size"))
        large = sized.filter(F.col("size") > bucket_bytes).select("depth", "prefix").persist(StorageLevel.DISK_ONLY)
        held = {r[0] for r in large.groupBy("depth").count().collect()}  # at most one row per depth
        for d in depths:
            if d not in held:
                return levels, d
            levels.append((d, large.filter(F.col("depth") == d).select("prefix")))
        inside = inside.join(bounded(levels[-1][1]), _prefix(depths[-1]) == F.col("prefix"), "left_semi")
        depth = depths[-1] << 1
    return levels, depth


def with_bucket(partial: DataFrame, levels: list[tuple[int, DataFrame]], depth: int) -> DataFrame:
    """Adds ``bucket``: the hash of the shortest prefix that fits."""
    df, bucket = partial, _prefix(depth)
    for i, (d, large) in reversed(list(enumerate(levels))):
        df = df.join(bounded(large.select(F.col("prefix").alias(f"_p{i}"))), _prefix(d) == F.col(f"_p{i}"), "left")
        bucket = F.when(F.col(f"_p{i}").isNull(), _prefix(d)).otherwise(bucket)
    return df.select("key", "n", "kept_id", bucket.alias("bucket"))


def records(df: DataFrame, id_col: str, text_col: str, order_col: str | None) -> DataFrame:
    """``id``, ``key`` (canonical bytes), ``digest`` of the latest delivery of every id.

    Rows with a null id are left out. A null text, or one without any letter or digit, has a null key: it is a record that
    is no copy of any other. Of several rows of an id the one with the latest ``order_col`` counts (nulls first), then the
    largest text.
    """
    order = F.col(f"`{order_col}`") if order_col else F.lit(0)
    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"), order.alias("at"))
    latest = rows.filter("id is not null").groupBy("id").agg(F.max(F.struct("at", "text"))["text"].alias("text"))
    # Exploded and not projected twice, as the optimizer would compute the form for every use.
    keyed = latest.select("id", F.explode(F.array(F.nullif(canonical(F.col("text")), F.lit("")))).alias("k"))
    return keyed.select("id", F.encode("k", "UTF-8").alias("key"), F.unhex(F.md5(F.encode("k", "UTF-8"))).alias("digest"))


def collapse(recs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``key``, ``n`` copies and ``kept_id`` (the smallest id) of every record with a key."""
    schema = "key binary, n bigint, kept_id string"
    partial = recs.filter("key is not null").select("key", "id").mapInPandas(_count_locally, schema).persist(StorageLevel.DISK_ONLY)
    levels, depth = radix_levels(partial, bucket_bytes)
    parted = with_bucket(partial, levels, depth).repartition("bucket").sortWithinPartitions("bucket")
    return parted.mapInPandas(_count_buckets, schema)


def collapsed_records(df: DataFrame, id_col: str, text_col: str, order_col: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per record: ``kept_id`` and ``n_copies``, counted over distinct ids; texts without a key are single records."""
    recs = records(df, id_col, text_col, order_col).persist(StorageLevel.DISK_ONLY)
    counted = collapse(recs, bucket_bytes).select("kept_id", F.col("n").alias("n_copies"))
    return counted.unionByName(recs.filter("key is null").select(F.col("id").alias("kept_id"), F.lit(1).cast("bigint").alias("n_copies")))


def copy_links(df: DataFrame, id_col: str, text_col: str, order_col: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``kept_id, copy_id``: one row for every id that repeats the record of a smaller id.

    Groups that hold more than 1/``HOT_GROUPS`` of all records (fewer than that many exist) are matched map-side by a
    broadcast of their digests; the rest meet in a shuffle on the digest, whose groups are small by then.
    """
    recs = records(df, id_col, text_col, order_col).filter("key is not null").persist(StorageLevel.DISK_ONLY)
    groups = collapse(recs, bucket_bytes).filter("n > 1").select(F.unhex(F.md5("key")).alias("digest"), "n", "kept_id").persist(StorageLevel.DISK_ONLY)
    hot_from = max(1000, recs.count() // HOT_GROUPS)
    hot, cold = groups.filter(F.col("n") > hot_from), groups.filter(F.col("n") <= hot_from)
    ids = recs.select("id", "digest")
    tagged = ids.join(F.broadcast(hot.select("digest", F.col("kept_id").alias("hot_id"))), "digest", "left")
    from_hot = tagged.filter("hot_id is not null").select(F.col("hot_id").alias("kept_id"), F.col("id").alias("copy_id"))
    from_cold = tagged.filter("hot_id is null").select("id", "digest").join(cold, "digest").select("kept_id", F.col("id").alias("copy_id"))
    return from_hot.unionByName(from_cold).filter("kept_id <> copy_id")
