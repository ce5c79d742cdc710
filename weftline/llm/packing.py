"""Packing token sequences by exact complements, then best fit.

Documents are tokenised once, where they are read; what goes on is a row of a few numbers for each piece. How many
pieces of each length there are is all that the plan needs, and lengths are at most `size`, so the plan is made on the
driver from a table of `size` counts, whatever the corpus is. Going down from the longest length, the gap it leaves is
looked up in an index of single lengths, of sums of two and of sums of three, and each combination found is used as
often as its lengths are available. What is left goes to the tightest gap that takes it, counts at a time.

The plan is a table of (length, rank from, count, ...) rows. Ranks of pieces among those of their length come from
counts by task and length and their running totals, so a length that a third of all pieces have is no hot key.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import batches, stored

CHUNK = 1_500_000


class Tokens(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of what stands between single spaces, with the space before it.

    The file is read by `tokenizers`. Where it holds a byte-level BPE whose merges come in the order of their ids, what
    has no white space or markup to mind is merged piece by piece by tiktoken's core over the same vocabulary, several
    times faster; the ids are the same. Everything else goes through `tokenizers` as a whole text.
    """

    LIMIT, LONG = 250_000, 64  # words in each of two generations, and characters of the longest word that is kept

    def __init__(self, path: str):
        import json
        import re

        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.old = Tokenizer.from_file(path), {}
        #: Where a space has white space beside it, tokens may span what split(" ") parts.
        self.unsafe = re.compile("|".join([r" \s", r"\s ", *(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])).search
        self.core = None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file.get("pre_tokenizer") or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not file.get("normalizer")
        if plain and all(model["vocab"][a + b] == 256 + i for i, (a, b) in enumerate(merges)):
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in such files
            byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
            special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
            ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
            pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            coder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.core, self.coder = coder._core_bpe.encode_single_piece, coder.encode_ordinary

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            if word.isalpha():
                ids = self.core(f" {word}".encode())
            elif word[:-1].isalpha() and word[-1] in ".,!?;:":
                ids = self.core(f" {word[:-1]}".encode()) + self.core(word[-1].encode())
            else:
                ids = self.coder(" " + word)
            found = array("I", ids).tobytes()
        if len(word) <= self.LONG:
            if len(self) >= self.LIMIT:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def of(self, text: str) -> bytes:
        """The ids of a whole text. The pattern never joins a single space to the text before it, so words may be looked up one by one."""
        if not self.core or self.unsafe(text):
            return self.ids(text)
        first, *rest = text.split(" ")
        return (self.ids(first) if first else b"") + b"".join(map(self.__getitem__, rest))


@lru_cache(maxsize=2)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: full ones, behind a first one that may be shorter."""
    if n <= size:
        return [(0, n)]
    head = n % size
    return ([(0, head)] if head else []) + [(at, size) for at in range(head, n, size)]


def _pieces(path: str, size: int, end: int):
    tail = np.array([end], dtype="<u4").tobytes()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task, seen = _tokens(path), TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        for batch, a, b in batches(rows, CHUNK):
            out: list[tuple] = []
            ids = batch.column(0).slice(a, b - a).to_pylist()
            for doc, text in zip(ids, batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                data = (tokens.of(text) if text else b"") + tail
                for piece, (start, length) in enumerate(pieces_of(len(data) // 4, size)):
                    out.append((doc, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), task, int(seen[length])))
                    seen[length] += 1
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 5), strict=True)], names=["id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return run


class Plan:
    """Where the pieces of each length go: rows (length, rank, count, each, sequence, offset).

    Pieces of a length with ranks from `rank` on, `count` of them, go to sequences from `sequence` on, `each` to a
    sequence one after the other, the first at `offset`.
    """

    def __init__(self, counts: np.ndarray, size: int):
        self.size, self.left = size, np.array(counts, dtype=np.int64)
        self.rank = np.zeros(size + 1, dtype=np.int64)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by gap: (first sequence, how many)
        self._exact()
        self._best_fit()

    def _put(self, length: int, times: int, each: int, sequence: int, offset: int) -> None:
        self.rows.append((length, int(self.rank[length]), times * each, each, sequence, offset))
        self.rank[length] += times * each
        self.left[length] -= times * each

    def _fill(self, combination: list[int], times: int) -> None:
        at = 0
        for length in combination:
            self._put(length, times, 1, self.sequences, at)
            at += length
        self.sequences += times

    def _exact(self) -> None:
        size, left = self.size, self.left
        self._fill([size], int(left[size]))
        pairs = np.zeros(size + 1, dtype=np.int64)  # by sum: pairs of different lengths that are left, each way round
        live = left[: size + 1] > 0
        live[0] = False
        for a in np.flatnonzero(live):
            pairs[a:] += live[: size + 1 - a]
            if 2 * a <= size:
                pairs[2 * a] -= 1

        #: By sum: lengths that are left with pairs that are left; made anew when a length has run out since.
        triples: np.ndarray | None = None

        def gone(length: int) -> None:
            nonlocal triples
            live[length], triples = False, None
            for b in np.flatnonzero(live[: size + 1 - length]):
                pairs[length + b] -= 2

        def pair(total: int, free: np.ndarray) -> list[int] | None:
            """Two lengths with that sum, the larger one as large as can be; free: how many of each may be used."""
            both = np.flatnonzero((free[1:total] > 0) & (free[total - 1 : 0 : -1] > 0)) + 1
            for a in both[::-1]:
                if 2 * a < total:
                    return None
                if 2 * a > total or free[a] > 1:
                    return [int(a), int(total - a)]
            return None

        for longest in range(size - 1, 0, -1):
            gap = size - longest
            while left[longest] > 0:
                left[longest] -= 1
                found: list[int] | None = None
                if left[gap] > 0:
                    found = [gap]
                elif gap > 1:
                    found = pair(gap, left)
                if not found and gap > 2 and triples is None:
                    triples = np.convolve(live.astype(np.int64), pairs)[: size + 1] > 0
                    for x in np.flatnonzero(live):  # twice or three times the same length, which the pairs above leave out
                        triples[2 * x : size + 1] |= live[: size + 1 - 2 * x] if 2 * x <= size else False
                if not found and gap > 2 and triples[gap]:
                    for a in np.flatnonzero((left[1 : gap - 1] > 0) & ((pairs[gap - 1 : 1 : -1] > 0) | (left[np.arange(gap - 1, 1, -1) // 2] > 1)))[::-1] + 1:
                        left[a] -= 1
                        two = pair(gap - int(a), left)
                        left[a] += 1
                        if two:
                            found = [int(a), *two]
                            break
                left[longest] += 1
                if not found:
                    break
                use = [longest, *found]
                times = min(int(left[x]) // use.count(x) for x in set(use))
                self._fill(use, times)
                for x in set(use):
                    if left[x] < 2 and live[x] and left[x] == 0:
                        gone(x)

    def _best_fit(self) -> None:
        for length in range(self.size, 0, -1):
            while (n := int(self.left[length])) > 0:
                gap = min((g for g in self.open if g >= length), default=None)
                if gap is None:
                    first, many, gap = self.sequences, 0, self.size
                else:
                    first, many = self.open[gap].pop()
                    if not self.open[gap]:
                        del self.open[gap]
                each = min(gap // length, n)
                if not many:
                    many = max(1, n // each)
                    self.sequences += many
                times = min(many, n // each)
                self._put(length, times, each, first, self.size - gap)
                if gap > each * length:
                    self.open[gap - each * length].append((first, times))
                if many > times:
                    self.open[gap].append((first + times, many - times))


def _place(rows: list[tuple], size: int):
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
    stride = int(max(table[:, 1].max(), (table[:, 1] + table[:, 2]).max())) + 1 if len(table) else 1

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] * stride + table[:, 1]
        for batch in found:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length * stride + rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.record_batch(
                [*(batch.column(batch.schema.get_field_index(c)) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(row[:, 4] + nth // row[:, 3]), pa.array(row[:, 5] + nth % row[:, 3] * length)],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, size: int = 2048, end: int = 0) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs.

    A document is its text's ids by the tokenizer file, then the id `end`. Null and empty texts are that one id.
    Longer documents than `size` are cut into full pieces, the first piece taking what is over. Rows with a null or
    a repeated id are packed like all others. An empty table gives no rows. Other columns are not looked at.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = stored(texts.mapInArrow(_pieces(tokenizer, size, end), "id long, piece int, start long, length long, ids_crc32 long, task long, nth long"), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(by_task.withColumn("base", F.coalesce(F.sum("c").over(earlier), F.lit(0))), "ranks")
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, c in base.groupBy("length").agg(F.sum("c")).collect():  # at most `size` rows
        counts[length] = c
    ranked = pieces.join(base.drop("c"), ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.mapInArrow(_place(Plan(counts, size).rows, size), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
