"""Near-duplicate documents by MinHash bands, sequential Bayesian pruning of candidates and exact checks.

1. Each document becomes a set of k-word shingles and 128 MinHash values of 16 bits, 4 to a band.
   Documents with equal sets form a class; only one of a class goes on.
2. Classes that share a band meet in a bucket. Buckets with the same members are handled once. Inside a bucket,
   signatures are compared 16 values at a time (BayesLSH: Satuluri and Parthasarathy, 2012): with a uniform prior,
   after m matches of n the similarity has a Beta(m+1, n-m+1) posterior, and a pair goes as soon as the chance
   that it reaches the threshold is below `miss`. What survives joins its members to a family; a bucket reports
   a spanning forest, not its pairs.
3. The sets of a family's members, as 64-bit hashes of shingles, are made again from the texts, and all pairs of the
   family that are not yet connected are checked on the full sets. Families and buckets beyond a block are split into pairs of blocks, so that no
   task holds an unbounded group.
4. Connected components of the exact links give the groups.

A pair at similarity exactly 0.8 misses all 32 bands with a chance of (1 - 0.8^4)^32 = 5e-8, and each of the
8 looks drops it with a chance of at most `miss`.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import MIX_A, U64, WordHashes, batches, components, dealt_by, dropped, mixed, sorted_groups, stored

HASHES, ROWS, LOOK = 128, 4, 16
BANDS = HASHES // ROWS
#: Members of a bucket, members of a family and shingles of a family that one block takes.
BUCKET_BLOCK, FAMILY_BLOCK, FAMILY_SHINGLES = 2048, 1024, 1_000_000
#: Bytes of text that are hashed together.
CHUNK = 1_500_000

_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 2**32, HASHES, dtype=np.uint64) | U64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingles(texts: list[str | None], k: int, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, one after the other with repeats, and how many each text has.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A text of fewer than k words has its
    whole sequence as one shingle, a text without words none.
    """
    found, counts = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if not text:
            continue
        h = cache.of(text.encode("utf-8", "surrogatepass").lower().split())
        n = len(h)
        if not n:
            continue
        out = np.zeros(max(1, n - k + 1), dtype=np.uint64)
        for j in range(min(k, n)):
            out = (out ^ (out >> U64(29))) * MIX_A + h[j : j + len(out)]
        if n < k:
            out += U64(n * int(MIX_A) % 2**64)
        found.append(mixed(out))
        counts[i] = len(out)
    return (np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)), counts


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values, 16 bits each, of runs of shingle hashes that begin at starts."""
    x = (hashes >> U64(32)).astype(np.uint32)
    t, s = np.empty_like(x), np.empty_like(x)
    out = np.empty((len(starts), HASHES), dtype=np.uint32)
    for p in range(HASHES):
        np.multiply(x, _MUL[p], out=t)
        np.add(t, _ADD[p], out=t)
        np.right_shift(t, 15, out=s)
        np.bitwise_xor(t, s, out=t)
        np.multiply(t, np.uint32(0x2C1B3C6D), out=t)
        out[:, p] = np.minimum.reduceat(t, starts)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x9E3779B1)
    return (out >> np.uint32(16)).astype(np.uint16)


def _sketch(k: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cache = WordHashes()
        for batch, a, b in batches(rows, CHUNK):
            texts = batch.column(1).slice(a, b - a).to_pylist()
            h, counts = shingles(texts, k, cache)
            full = np.flatnonzero(counts)
            ends = np.cumsum(counts)
            sizes, prints = np.zeros(len(texts), dtype=np.int64), [None] * len(texts)
            for i in full:
                own = np.unique(h[ends[i] - counts[i] : ends[i]])
                sizes[i], prints[i] = len(own), xxhash.xxh3_128_digest(own.tobytes())
            bands: list = [None] * len(texts)
            if len(full):
                sig = signatures(h, ends[full] - counts[full]).view(np.int64)
                for j, i in enumerate(full):
                    bands[i] = sig[j]
            yield pa.record_batch(
                [batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "n", "print", "bands"],
            )

    return run


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each look, the fewest matches with which a pair stays: the posterior chance of reaching the threshold is at least miss."""
    out = []
    for n in range(LOOK, HASHES + 1, LOOK):
        below, m = 0.0, -1
        while below < miss:  # P(similarity >= threshold) = P(Binomial(n + 1, threshold) <= m)
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(one: np.ndarray, many: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of many stay candidates of one, looking at a batch of signature values at a time. one may be one signature or as many as many."""
    alive = np.arange(len(many))
    matches = np.zeros(len(many), dtype=np.int64)
    for look, need in enumerate(least):
        part = slice(look * LOOK, (look + 1) * LOOK)
        own = one[part] if one.ndim == 1 else one[alive, part]
        matches = matches + (many[alive, part] == own).sum(axis=1)
        stay = matches >= need
        alive, matches = alive[stay], matches[stay]
        if not len(alive):
            break
    return alive


def _forest(n: int, linked) -> list[tuple[int, int]]:
    """Edges that connect what linked(i, others) connects, looking only at pairs not connected so far."""
    label, edges = np.arange(n), []
    for i in range(n - 1):
        rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        for j in linked(i, rest) if len(rest) else ():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                edges.append((i, int(j)))
    return edges


def _bucket_forests(least: list[int]):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for table in sorted_groups(rows, "bucket"):
            ids = table.column("id").to_numpy()
            sig = table.column("bands").combine_chunks().flatten().to_numpy().view(np.uint16).reshape(len(ids), HASHES)
            if len(ids) == 2:
                pairs.append((ids, sig))
                if len(pairs) == 4000:
                    yield _of_pairs(pairs, least)
                    pairs = []
            elif len(ids) > 2:
                edges = _forest(len(ids), lambda i, rest, sig=sig: rest[survivors(sig[i], sig[rest], least)])
                if edges:
                    e = np.array(edges)
                    yield pa.record_batch([pa.array(ids[e[:, 0]]), pa.array(ids[e[:, 1]])], names=["a", "b"])
        if pairs:
            yield _of_pairs(pairs, least)

    return run


def _of_pairs(pairs: list, least: list[int]) -> pa.RecordBatch:
    ids, sig = np.stack([x for x, _ in pairs]), np.stack([x for _, x in pairs])
    stay = ids[survivors(sig[:, 0], sig[:, 1], least)]
    return pa.record_batch([pa.array(stay[:, 0]), pa.array(stay[:, 1])], names=["a", "b"])


def _sets(k: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch, a, b in batches(rows, CHUNK):
            h, counts = shingles(batch.column(1).slice(a, b - a).to_pylist(), k, cache)
            ends = np.cumsum(counts)
            own = [np.unique(h[e - c : e]).tobytes() for e, c in zip(ends, counts, strict=True)]
            yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(own, pa.binary())], names=["id", "block", "items"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted arrays, by products of 0/1 matrices over columns that two share."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    items, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    new = np.cumsum(times > 1) - 1
    column, owner = new[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out, width = np.zeros((n, n), dtype=np.int64), max(64, 4_000_000 // n)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((n, width), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def _exact_forests(percent: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for table in sorted_groups(rows, "block"):
            ids = table.column("id").to_numpy()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("items").to_pylist()]
            size = np.array([len(s) for s in sets])
            if len(ids) == 2:
                common = len(np.intersect1d(*sets, assume_unique=True))
                edges = [(0, 1)] if 100 * common >= percent * (size.sum() - common) else []
            elif len(ids) > 2:
                common = intersections(sets)
                edges = _forest(len(ids), lambda i, rest, c=common, s=size: rest[100 * c[i, rest] >= percent * (s[i] + s[rest] - c[i, rest])])
            else:
                edges = []
            for i, j in edges:
                a.append(ids[i])
                b.append(ids[j])
            if len(a) > 10_000:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _in_blocks(members: DataFrame, blocks, name: str, key) -> DataFrame:
    """A row of members for each pair of blocks it belongs to; `key` and the pair give `name`."""
    m = members.withColumn("_all", blocks.cast("long")).withColumn("_own", F.pmod(F.xxhash64("id", F.lit(5)), F.col("_all")))
    m = m.withColumn("_other", F.explode(F.when(F.col("_all") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("_all") - 1), F.col("_own")))))
    return m.withColumn(name, F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other"))).drop("_all", "_own", "_other")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """For each row of docs: id_col, n_shingles, component_id and kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of k-word shingles;
    component_id is the smallest id reachable over links and kept marks the document that bears it.
    The id is an integer. A null or empty text, or one of white space, has no shingles and is linked with nothing,
    as is a row with a null id (component_id null, kept). Rows with one id count as one document that has the
    links of each. Repeated rows are all returned. Other columns are not looked at.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = stored(texts.mapInArrow(_sketch(k), "id long, n long, print binary, bands array<long>"), "sketch")
    classes = stored(
        sketched.where("n > 0 and id is not null").groupBy("print").agg(F.min("id").alias("id"), F.min_by("bands", "id").alias("bands"), F.first("n").alias("n")), "classes"
    )

    banded = classes.select("id", F.posexplode("bands").alias("band", "value")).select("id", F.xxhash64("band", "value").alias("bucket"))
    met = (
        banded.groupBy("bucket")
        .agg(F.count("*").alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
        .where("c > 1 and lo < hi")
        .groupBy("c", "lo", "hi", "x", "y")
        .agg(F.min("bucket").alias("bucket"))
    )
    met = stored(met, "buckets")
    two = met.where("c = 2").select("bucket", "c", F.explode(F.array("lo", "hi")).alias("id"))
    more = banded.join(met.where("c > 2").select("bucket", "c"), "bucket").select("bucket", "c", "id")
    members = _in_blocks(two.union(more), F.ceil(F.col("c") / BUCKET_BLOCK), "bucket", F.col("bucket")).join(classes.select("id", "bands"), "id").select("bucket", "id", "bands")
    families = components(dealt_by(members, "bucket", "id").mapInArrow(_bucket_forests(least_matches(percent / 100, miss)), "a long, b long"), "families")

    sized = families.join(classes.select(F.col("id").alias("node"), "n"), "node")
    blocks = sized.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / FAMILY_BLOCK), F.ceil(F.sum("n") / FAMILY_SHINGLES)).alias("all"))
    family = _in_blocks(families.join(blocks, "component").withColumnRenamed("node", "id"), F.col("all"), "block", F.col("component"))
    members = texts.join(family.select("id", "block"), "id").select("id", "text", "block")
    links = dealt_by(members.mapInArrow(_sets(k), "id long, block long, items binary"), "block", "id").mapInArrow(_exact_forests(percent), "a long, b long")
    groups = components(links, "groups")
    dropped(met)

    class_of = classes.select(F.col("print"), F.col("id").alias("node")).join(groups, "node", "left").select("print", F.coalesce("component", "node").alias("component"))
    out = sketched.join(class_of, (sketched["print"] == class_of["print"]) & sketched["id"].isNotNull(), "left")
    component = F.coalesce(class_of["component"], sketched["id"])
    return out.select(
        sketched["id"].alias(id_col), sketched["n"].alias("n_shingles"), component.alias("component_id"), (sketched["id"].eqNullSafe(component)).alias("kept")
    )
