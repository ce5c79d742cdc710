"""Benchmark decontamination by winnowed word fingerprints, joined and extended.

A window is `span` consecutive words of an item, or the whole of a shorter item. Fingerprints are the least of each
span - gram + 1 consecutive hashes of `gram` words (winnowing: Schleimer, Wilkerson and Aiken, 2003), at every place where
they stand: a run of `span` words that a document shares with an item has one at the same place on both sides, chosen by
the words of the run alone. The fingerprints of documents and items are joined; each pair of places is extended word for
word to both sides as far as the words agree, and is a hit from `span` words on. Items shorter than that have one
fingerprint, of all their words, which every run of as many words of a document is compared with.

Long items are cut into pieces that overlap by span - 1 words, so that each window lies within one piece, and pieces are
put into blocks of at most `block_words` words. One block goes to every worker, which indexes it once and joins while it
reads the documents. More blocks, however many, are joined by a shuffle: the documents are scanned once for their
fingerprints, these meet the items' by hash, and a document goes to the blocks that it shares a fingerprint with, which
are dealt out again in parts where many documents share one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import MIX_A, U64, WordHashes, batches, dealt_by, mixed, sorted_groups, stored

CHUNK = 1_500_000

#: Bytes to words: A-Z lower-cased; 0-9, a-z and all bytes of non-ASCII characters stay; the rest parts words.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(k if n > 0 else 0):
        out = (out ^ (out >> U64(29))) * MIX_A + h[j : j + n]
    return mixed(out)


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """The places of hashes that are the least of some `window` consecutive ones."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least = grams[:n].copy()
    for j in range(1, window):
        np.minimum(least, grams[j : j + n], out=least)
    # A hash is the least of a window around it if the greatest of these least ones is not below it.
    most = np.zeros(len(grams), dtype=np.uint64)
    for j in range(window):
        np.maximum(most[j : j + n], least, out=most[j : j + n])
    return np.flatnonzero(most == grams)


def sized(grams: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all words of short items, apart from fingerprints and from those of other sizes."""
    return mixed(grams ^ (U64(size) * MIX_A))


class Items:
    """The fingerprints of pieces of items, with the words to extend them in."""

    def __init__(self, pieces: list[tuple[str, str]], span: int, gram: int):
        self.span, self.gram = span, gram
        cache, own = WordHashes(), defaultdict(set)
        for item, text in pieces:
            own[b" ".join(words_of(text))].add(item)
        own.pop(b"", None)
        self.words, self.names = [text.split(b" ") for text in own], list(own.values())
        keys, owners, places = [], [], []
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, words in enumerate(self.words):
            h = cache.of(words)
            if len(words) < span:
                self.short[len(words)][int(gram_hashes(h, len(words))[0])].append(i)
                continue
            grams = gram_hashes(h, gram)
            at = winnowed(grams, span - gram + 1)
            keys.append(grams[at])
            owners.append(np.full(len(at), i))
            places.append(at)
        prints = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
        order = np.argsort(prints, kind="stable")
        self.prints = prints[order]
        self.owners, self.places = (np.concatenate(x)[order] if keys else np.zeros(0, dtype=np.int64) for x in (owners, places))
        self.keys = {size: np.sort(np.fromiter(found, dtype=np.uint64, count=len(found))) for size, found in self.short.items()}

    def hits(self, words: list[bytes], h: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged runs [from, to) of hit words, and the items with windows that occur."""
        runs, found = [], set()
        if len(h) >= self.span and len(self.prints):
            grams = gram_hashes(h, self.gram)
            at = winnowed(grams, self.span - self.gram + 1)
            first = np.searchsorted(self.prints, grams[at])
            first[first == len(self.prints)] = 0
            met = np.flatnonzero(self.prints[first] == grams[at])
            ends: dict[tuple[int, int], int] = {}  # by item and shift: as far as it has been extended
            for p, j in zip(at[met].tolist(), first[met].tolist(), strict=True):
                key = self.prints[j]
                while j < len(self.prints) and self.prints[j] == key:
                    i, q = int(self.owners[j]), int(self.places[j])
                    j += 1
                    if p >= ends.get((i, p - q), 0):
                        a, b = self.extended(words, p, self.words[i], q)
                        ends[i, p - q] = max(b, p + 1)
                        if b - a >= self.span:
                            runs.append((a, b))
                            found.add(i)
        for size, keys in self.keys.items():
            if len(h) >= size:
                grams = gram_hashes(h, size)
                at = np.searchsorted(keys, grams)
                at[at == len(keys)] = 0
                for p in np.flatnonzero(keys[at] == grams).tolist():
                    own = [i for i in self.short[size][int(grams[p])] if self.words[i] == words[p : p + size]]
                    if own:
                        found.update(own)
                        runs.append((p, p + size))
        return merged(runs), {name for i in found for name in self.names[i]}

    def extended(self, words: list[bytes], p: int, own: list[bytes], q: int) -> tuple[int, int]:
        """The run [from, to) of a document's words around p that agrees with an item's around q; empty where the fingerprints' words differ."""
        if words[p : p + self.gram] != own[q : q + self.gram]:
            return p, p
        a, b = p, p + self.gram
        while a and a - p + q and words[a - 1] == own[a - 1 - p + q]:
            a -= 1
        while b < len(words) and b - p + q < len(own) and words[b] == own[b - p + q]:
            b += 1
        return a, b


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs as few disjoint ones, touching ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: The items that this worker process was last given, and their index.
_INDEX: list = []


def _index(given: Broadcast, span: int, gram: int) -> Items:
    """The items of a broadcast, indexed once in each worker process."""
    pieces = given.value
    if not _INDEX or _INDEX[0] is not pieces or _INDEX[1:3] != [span, gram]:
        _INDEX[:] = [pieces, span, gram, Items(pieces, span, gram)]
    return _INDEX[3]


def _scan(given: Broadcast, span: int, gram: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, cache = _index(given, span, gram), WordHashes()
        for batch, a, b in batches(found, CHUNK):
            counts, runs, hit = [], [], []
            for text in batch.column(1).slice(a, b - a).to_pylist():
                words = words_of(text)
                r, own = items.hits(words, cache.of(words)) if words else ([], set())
                counts.append(len(words))
                runs.append([x for pair in r for x in pair])
                hit.append(sorted(own))
            yield pa.record_batch(
                [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(hit, pa.list_(pa.string()))],
                names=["id", "n_words", "runs", "items"],
            )

    return run


def _pieces(span: int, most: int):
    """Items as pieces in blocks: (block, item, text, n), no block and no piece over `most` words."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, full = TaskContext.get().partitionId() << 32, 0
        for batch, a, b in batches(found, CHUNK):
            out = []
            for item, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                words = words_of(text)
                for start in range(0, max(len(words) - span + 1, 1) if words else 0, most - span + 1):
                    piece = words[start : start + most]
                    if full and full + len(piece) > most:
                        block, full = block + 1, 0
                    full += len(piece)
                    out.append((block, item, b" ".join(piece).decode("utf-8", "surrogatepass"), len(piece)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["block", "item", "text", "n"])

    return run


def _counted(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, a, b in batches(found, CHUNK):
        texts = batch.column(1).slice(a, b - a)
        counts = [len(words_of(t)) for t in texts.to_pylist()]
        yield pa.record_batch([batch.column(0).slice(a, b - a), texts, batch.column(2).slice(a, b - a), pa.array(counts, pa.int64())], names=["id", "text", "row", "n_words"])


def _prints(span: int, gram: int, sizes: list[int] | None):
    """(key, hash) of texts with a key: fingerprints, and of short texts (sizes None) or of all runs of those sizes the hash."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch, a, b in batches(found, CHUNK):
            keys, hashes = [], []
            for key, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                words = words_of(text)
                if not words:
                    continue
                h, own = cache.of(words), []
                if len(h) >= span:
                    grams = gram_hashes(h, gram)
                    own.append(grams[winnowed(grams, span - gram + 1)])
                elif sizes is None:
                    own.append(sized(gram_hashes(h, len(h)), len(h)))
                own += [sized(gram_hashes(h, size), size) for size in sizes or [] if len(h) >= size]
                own = np.unique(np.concatenate(own)) if own else np.zeros(0, dtype=np.uint64)
                keys.append(np.full(len(own), key))
                hashes.append(own)
            keys, hashes = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (keys, hashes))
            yield pa.record_batch([pa.array(keys.astype(np.int64)), pa.array(hashes.astype(np.uint64).view(np.int64))], names=["key", "hash"])

    return run


def _met(span: int, gram: int):
    """Hits of documents in blocks, from rows sorted by (block, part, kind): a block's pieces come before its documents."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pieces, items, cache = None, [], None, WordHashes()
        for batch in found:
            rows, runs, hit = [], [], []
            for block, part, kind, row, item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, part) != last:
                    last, pieces, items = (block, part), [], None
                if kind == 0:
                    pieces.append((item, text))
                    continue
                if items is None:
                    items, pieces = Items(pieces, span, gram), []
                words = words_of(text)
                r, own = items.hits(words, cache.of(words))
                if r:
                    rows.append(row)
                    runs.append([x for pair in r for x in pair])
                    hit.append(sorted(own))
            yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(hit, pa.list_(pa.string()))], names=["row", "runs", "items"])

    return run


def _joined(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document from its rows of all blocks."""
    for table in sorted_groups(rows, "row"):
        runs = merged([tuple(r[i : i + 2]) for r in table.column("runs").to_pylist() for i in range(0, len(r), 2)])
        items = sorted({x for own in table.column("items").to_pylist() for x in own})
        yield pa.record_batch([table.column("row").slice(0, 1).combine_chunks(), pa.array([[x for r in runs for x in r]], pa.list_(pa.int64())), pa.array([items], pa.list_(pa.string()))], names=["row", "runs", "items"])


def _by_shuffle(docs: DataFrame, pieces: DataFrame, span: int, gram: int, part: int) -> DataFrame:
    """(id, n_words, runs, items) where the pieces (block, item, text) are too many for one worker."""
    texts = stored(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_counted, "id long, text string, row long, n_words long"), "texts")
    sizes = sorted(r["n"] for r in pieces.where(F.col("n") < span).select("n").distinct().collect())  # numbers below span
    shape = "key long, hash long"
    theirs = pieces.select("block", "text").mapInArrow(_prints(span, gram, None), shape).select(F.col("key").alias("block"), "hash").distinct()
    ours = texts.where("n_words > 0").select("row", "text").mapInArrow(_prints(span, gram, sizes), shape).select(F.col("key").alias("row"), "hash")
    pairs = stored(ours.join(theirs, "hash").select("row", "block").distinct(), "pairs")
    parts = pairs.groupBy("block").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    work = pairs.join(parts, "block").select("row", "block", F.pmod(F.xxhash64("row"), "parts").cast("int").alias("part"))
    none = F.lit(None).cast("string")
    met = texts.select("row", "text").join(work, "row").select("block", "part", F.lit(1).alias("kind"), "row", none.alias("item"), "text")
    given = pieces.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", "part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("row"), "item", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = given.union(met).repartition(n, "block", "part").sortWithinPartitions("block", "part", "kind")
    hits = stored(sorted_.mapInArrow(_met(span, gram), "row long, runs array<long>, items array<string>"), "hits")
    hits = dealt_by(hits, "row").mapInArrow(_joined, "row long, runs array<long>, items array<string>")
    whole = texts.select("id", "row", "n_words").join(hits, "row", "left")
    return whole.select("id", "n_words", F.coalesce("runs", F.array().cast("array<long>")).alias("runs"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, span: int = 10, gram: int = 5, block_words: int = 1_000_000, part: int = 10_000
) -> DataFrame:
    """(id_col, n_words, runs, items): the hit words of each document as runs [from, to), flattened, and the items found.

    Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. Null and empty texts have no words, as
    documents or as items. Items with one id count as one; a null item id is left out, a null document id is kept.
    Repeated rows each get a row. With no items nothing is hit. Other columns are not looked at. Items of up to
    `block_words` words in all go to every worker; more are joined by a shuffle, at most `part` documents to a block's part.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    wanted = items.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    pieces = stored(wanted.mapInArrow(_pieces(span, max(block_words, 2 * span)), "block long, item string, text string, n long"), "pieces")
    if (pieces.agg(F.sum("n")).first()[0] or 0) <= block_words:
        given = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in pieces.select("item", "text").collect()])
        found = texts.mapInArrow(_scan(given, span, gram), "id long, n_words long, runs array<long>, items array<string>")
    else:
        found = _by_shuffle(texts, pieces, span, gram, part)
    return found.withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the digest of item ids from contamination()."""
    n_hit = F.aggregate(F.transform("runs", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )
