"""p5: a sample whose categories have given shares, with floors and a report of what could not be met.

Only counts per category signature come to the driver: signatures are sets of *target* categories, so their number is
bounded by the target list and not by the data. There the plan starts from a random floor-satisfying draw and is repaired
by swaps between signatures until no swap lowers the deviation. The rows are then drawn at random inside each signature by
a hash threshold: a histogram of the hash finds the bin in which the quota ends, and only that bin is ranked.
"""

from __future__ import annotations

import math
import random
from fractions import Fraction

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossaflow.llm.sampling import unit_interval
from glossaflow.operators.manifests import bounded

#: Bins of the hash histogram; a signature of n rows ranks about n / HASH_BINS of them.
HASH_BINS = 1 << 16
#: Targets and signatures that a plan may have: they come to the driver, where every pair of a table's signatures is tried.
MAX_TARGETS, MAX_SIGNATURES = 4096, 4096
_SEP = "\x1f"


def _floor(share: float, n: int) -> int:
    return math.floor(Fraction(str(share)) * n)


def _ceil(share: float, n: int) -> int:
    return math.ceil(Fraction(str(share)) * n)


def swap_repair(have: dict[tuple[str, ...], int], size: int, targets: dict[str, tuple[float, int]], seed: int) -> dict[tuple[str, ...], int]:
    """Rows to draw of each signature.

    have: rows at hand by signature; targets: share and floor by category. The start is random but for the floors; then
    single exchanges between two signatures go on while one lowers the squared deviation from the wanted counts.
    """
    rng, size = random.Random(seed), min(size, sum(have.values()))
    take = dict.fromkeys(have, 0)
    signatures = sorted(have)
    held = lambda c: sum(take[s] for s in signatures if c in s)
    for c in sorted(targets, key=lambda c: sum(have[s] for s in signatures if c in s)):
        while (lacking := min(targets[c][1] - held(c), size - sum(take.values()))) > 0:
            open_to = [s for s in signatures if c in s and take[s] < have[s]]
            if not open_to:
                break
            s = rng.choices(open_to, [have[s] - take[s] for s in open_to])[0]
            take[s] += min(lacking, have[s] - take[s], max(1, lacking // 64))
    rest = size - sum(take.values())
    while rest > 0:  # the random start, in strides so that large samples take few draws
        open_to = [s for s in signatures if take[s] < have[s]]
        s = rng.choices(open_to, [have[s] - take[s] for s in open_to])[0]
        step = min(rest, have[s] - take[s], max(1, rest // 64))
        take[s] += step
        rest -= step
    want = {c: max(_ceil(share, size), floor) for c, (share, floor) in targets.items()}
    now = {c: held(c) for c in targets}

    def change(a: tuple[str, ...], b: tuple[str, ...], k: int) -> int | None:
        """Change of the squared deviation when k rows of a give way to k of b; None if a floor would break."""
        delta = 0
        for c in set(a) ^ set(b):
            to = now[c] + (k if c in b else -k)
            if to < targets[c][1] and to < now[c]:
                return None
            delta += (to - want[c]) ** 2 - (now[c] - want[c]) ** 2
        return delta

    step = 1 << max(0, size.bit_length() - 1)
    while step:
        best = None
        for a in signatures:
            for b in signatures:
                k = min(step, take[a], have[b] - take[b])
                if a != b and k == step and (d := change(a, b, k)) is not None and d < 0 and (best is None or d < best[0]):
                    best = (d, a, b)
        if best is None:
            step //= 2
            continue
        _, a, b = best
        take[a], take[b] = take[a] - step, take[b] + step
        for c in targets:
            now[c] += step * ((c in b) - (c in a))
    return take


def signatures(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``table_name, id, sig``: one row per id; sig joins its target categories, '' if it has none.

    rows: ``table_name, id, category`` in any number of rows per id. Null ids are left out; categories without a target
    count as none. Duplicates of an id add nothing.
    """
    known = bounded(targets.select("table_name", "category").distinct()).withColumn("_known", F.lit(True))
    tagged = rows.filter("id is not null").join(known, ["table_name", "category"], "left")
    found = F.array_sort(F.collect_set(F.when(F.col("_known"), F.col("category"))))
    return tagged.groupBy("table_name", "id").agg(F.array_join(found, _SEP).alias("sig"))


def _few(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table that is small by its nature; refuses one that is not, before it reaches the driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


class QuotaPlan:
    """The repaired plan of every table of ``targets``, its report and its sample.

    Targets without a table, category, share or sample share take no part; a null ``min_rows`` is 0.
    """

    def __init__(self, rows: DataFrame, targets: DataFrame, salt: str, seed: int = 7) -> None:
        self.spark, self.salt = rows.sparkSession, salt
        targets = targets.dropna(subset=["table_name", "category", "target_share", "sample_share"]).fillna(0, ["min_rows"])
        self.sigs = signatures(rows, targets).persist(StorageLevel.DISK_ONLY)
        counts: dict[str, dict[tuple[str, ...], int]] = {}
        for t, sig, n in _few(self.sigs.groupBy("table_name", "sig").count(), MAX_SIGNATURES, "signatures"):
            counts.setdefault(t, {})[tuple(sig.split(_SEP)) if sig else ()] = n
        wanted: dict[str, list] = {}
        for r in _few(targets.select("table_name", "category", "target_share", "min_rows", "sample_share").distinct(), MAX_TARGETS, "targets"):
            wanted.setdefault(r.table_name, []).append(r)
        self.report_rows, self.take = [], {}
        for t, rs in sorted(wanted.items()):
            have = counts.get(t, {})
            total = sum(have.values())
            size = _floor(rs[0].sample_share, total)
            take = swap_repair(have, size, {r.category: (r.target_share, r.min_rows) for r in rs}, seed)
            self.take[t] = take
            for r in rs:
                available = sum(n for s, n in have.items() if r.category in s)
                drawn = sum(n for s, n in take.items() if r.category in s)
                needed = max(_ceil(r.target_share, size), r.min_rows)
                self.report_rows.append((t, r.category, r.target_share, r.min_rows, needed, available, drawn, drawn / size if size else 0.0, max(0, needed - drawn), available >= needed))

    def report(self) -> DataFrame:
        """One row per target: what the repaired draw holds, what it is short by, and whether the rows at hand could meet it."""
        schema = "table_name string, category string, target_share double, min_rows bigint, needed bigint, available bigint, drawn bigint, drawn_share double, short_by bigint, can_be_met boolean"
        return self.spark.createDataFrame(self.report_rows, schema)

    def sample(self) -> DataFrame:
        """``table_name, id, sig``: exactly the planned number of random ids of each signature."""
        plan = [(t, _SEP.join(s), n) for t, take in self.take.items() for s, n in take.items() if n]
        planned = F.broadcast(self.spark.createDataFrame(plan, "table_name string, sig string, quota bigint"))
        keyed = self.sigs.join(planned, ["table_name", "sig"]).withColumn("u", unit_interval(F.col("id"), self.salt))
        keyed = keyed.withColumn("bin", F.floor(F.col("u") * HASH_BINS))
        histogram = keyed.groupBy("table_name", "sig", "quota", "bin").count()
        through = F.sum("count").over(Window.partitionBy("table_name", "sig").orderBy("bin"))
        edges = histogram.withColumn("upto", through).filter("upto >= quota").groupBy("table_name", "sig").agg(
            F.min(F.struct("bin", (F.col("quota") - F.col("upto") + F.col("count")).alias("left"))).alias("edge")
        )
        edged = keyed.join(F.broadcast(edges), ["table_name", "sig"])
        whole = edged.filter("bin < edge.bin").select("table_name", "id", "sig")
        rank = F.row_number().over(Window.partitionBy("table_name", "sig").orderBy("u", "id"))
        part = edged.filter("bin = edge.bin").withColumn("rank", rank).filter("rank <= edge.left").select("table_name", "id", "sig")
        return whole.unionByName(part)


def flag(value) -> object:
    """'true', 'false' or null for a flag spelled in any way; ``value`` is a string column."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("true", "1", "yes"), "true").when(v.isin("false", "0", "no"), "false")


def name_key(value) -> object:
    """A category name regardless of case, outer spaces and how its words are joined."""
    return F.lower(F.regexp_replace(value, r"[\s_\-]+", ""))


def category_rows(plain: DataFrame, morphological: DataFrame, targets: DataFrame) -> DataFrame:
    """``table_name, id, category`` of the two tables; a category is spelled as in ``targets``, null where there is none."""
    flags = plain.select("id", flag(F.col("characteristics")["has_numbers"]).alias("n"), flag(F.col("characteristics")["has_acronyms"]).alias("a"))
    first = flags.select(F.lit("dataset_01_normal_text").alias("table_name"), "id", F.concat(F.lit("numbers="), "n", F.lit(",acronyms="), "a").alias("category"))
    names = targets.filter("table_name = 'dataset_12_morphological'").select(name_key(F.col("category")).alias("k"), "category").distinct()
    subs = morphological.select("id", name_key(F.col("characteristics")["subcategory"]).alias("k")).join(bounded(names), "k", "left")
    second = subs.select(F.lit("dataset_12_morphological").alias("table_name"), "id", "category")
    return first.unionByName(second)
