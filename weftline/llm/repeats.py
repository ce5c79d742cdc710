"""Removal of long byte strings that earlier documents hold, by prefix-free parsing.

Parse. A rolling hash of GRAM bytes runs over each document. In each string of `span` bytes the least hash (the first of
equal ones) is its trigger: chosen by the bytes of the string alone, so two equal strings have equal triggers at equal
places. Strings that follow each other under one trigger form a phrase; a phrase is stored with all bytes of its strings,
the tail included that belongs to the next phrases of the parse, so no order beyond depth `span` needs the parse itself.

1. Triggers are counted, as short hashes in blobs for each part of the input and bucket; those that occur once in the
   whole corpus cannot be in a repeated string, and nothing more is done about them. A part sends a trigger once.
2. Phrases whose triggers recur go to the bucket of the trigger. Equal phrases are one entry of the dictionary, owned by
   the least document that has it; in all later documents they are removed whole. Equal phrases that follow each other in a
   document within `span` bytes, as in a run of one byte, are sent as one. A part keeps the phrases that its documents
   share and sends them for documents before the least it has seen only, so a phrase that all have does not fill a bucket.
3. The suffixes of the dictionary of a bucket, `span` bytes deep, are sorted; each run of equal ones belongs to its least
   document, and owners of larger id lose it.
4. The removed ranges of a document are merged beside its text.

Documents equal as a whole to an earlier one are settled by their hashes and take no part in 2 and 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import MIX_A, U64, batches, dropped, mixed, stored

GRAM = 24
#: Bytes parsed together, and what a bucket of triggers should hold.
CHUNK, BUCKET_TRIGGERS = 1 << 19, 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, CHUNK + 4096), _powers(_INVERSE, CHUNK + 4096)


def parse(data: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, strings, trigger) of the phrases of texts laid end to end; ends are the texts' ends in data.

    A phrase's strings begin at start, start + 1, ...; `strings` of them.
    """
    n, window = len(data), span - GRAM + 1
    none = np.zeros(0, dtype=np.int64)
    if n < span:
        return none, none, none.astype(np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + U64(1)) * _UP[:n], out=sums[1:])
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * _DOWN[: n - GRAM + 1])
    bits = U64(max(1, int(n).bit_length()))
    at = np.arange(len(grams), dtype=np.uint64)
    packed = (grams >> bits << bits) | at  # the first of equal hashes is the least
    least, width = packed, 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: len(packed) - window + 1], least[window - width : window - width + len(packed) - window + 1])
    trigger = (least & ((U64(1) << bits) - U64(1))).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(trigger)), side="right")
    inside = np.arange(len(trigger)) + span <= ends[np.minimum(text, len(ends) - 1)]
    new = np.ones(len(trigger), dtype=bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(new & inside)
    stops = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside) + 1
    return starts, stops - starts, grams[trigger[starts]]


def _laid(texts: list[str | None], span: int, chunk: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, text, offset) of texts laid end to end, about `chunk` bytes (0: CHUNK) at a time; a long text comes in pieces that overlap by span - 1."""
    chunk = chunk or CHUNK
    kept, owner, offset, size = [], [], [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(data) - span + 1), chunk - span):
            piece = data[at : at + chunk - 1]
            if len(piece) < span:
                continue
            if size + len(piece) > chunk:
                yield np.frombuffer(b"".join(kept), dtype=np.uint8), np.cumsum([len(x) for x in kept]), np.array(owner), np.array(offset)
                kept, owner, offset, size = [], [], [], 0
            kept.append(piece)
            owner.append(i)
            offset.append(at)
            size += len(piece)
    if kept:
        yield np.frombuffer(b"".join(kept), dtype=np.uint8), np.cumsum([len(x) for x in kept]), np.array(owner), np.array(offset)


def _short(trigger: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit hash of a trigger."""
    return (trigger >> U64(32)).astype(np.int64) % buckets, trigger.astype(np.uint32)


def _count_triggers(span: int, buckets: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = -1, []
        once: list[np.ndarray] = []
        more: list[np.ndarray] = []

        def fold() -> None:
            """The part's triggers, those seen once and those seen more often, as bucket and hash in one number."""
            if not found:
                return
            new, times = np.unique(np.concatenate([*once, *found]), return_counts=True)
            twice = np.unique(np.concatenate([*more, new[times > 1]]))
            once[:], more[:], found[:] = [new], [twice], []

        def said() -> Iterator[pa.RecordBatch]:
            fold()
            if once:
                bucket = (once[0] >> U64(32)).astype(np.int64)
                for b, lo, hi in zip(*(x.tolist() for x in _runs(bucket)), strict=True):
                    own = once[0][lo:hi]
                    again = np.isin(own, more[0], assume_unique=True)
                    yield pa.record_batch([pa.array([b]), pa.array([part]), pa.array([own[~again].astype(np.uint32).tobytes()]), pa.array([own[again].astype(np.uint32).tobytes()])], names=_BLOBS)
            once.clear()
            more.clear()

        for whole in rows:
            for p, lo, hi in zip(*(x.tolist() for x in _runs(whole.column(2).to_numpy())), strict=True):
                if p != part:
                    yield from said()
                    part = p
                for batch, a, b in batches(iter([whole.slice(lo, hi - lo)]), CHUNK):
                    for data, ends, _, _ in _laid(batch.column(1).slice(a, b - a).to_pylist(), span):
                        _, _, trigger = parse(data, ends, span)
                        bucket, short = _short(trigger, buckets)
                        found.append(bucket.astype(np.uint64) << U64(32) | short)
                    if sum(map(len, found)) > 1_000_000:
                        fold()
        yield from said()

    return run


_BLOBS = ["bucket", "part", "once", "more"]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, from, to) of the runs of sorted keys."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    lo = np.concatenate([[0], cuts]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[lo], lo, np.append(lo[1:], len(keys)) if len(keys) else lo


def _groups(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """(first column, rows) of rows sorted by the first column."""
    now, kept = None, []
    for batch in rows:
        for row in batch.to_pylist():
            key = next(iter(row.values()))
            if key != now and kept:
                yield now, kept
                kept = []
            now = key
            kept.append(row)
    if kept:
        yield now, kept


def _recurring(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket and part, which of the part's triggers occur elsewhere or twice in it."""
    for bucket, blobs in _groups(rows):
        own = [np.frombuffer(r["once"], dtype=np.uint32) for r in blobs]
        twice = [np.frombuffer(r["more"], dtype=np.uint32) for r in blobs]
        seen, times = np.unique(np.concatenate([*own, *twice, *twice]), return_counts=True)
        again = seen[times > 1]
        for row, x, y in zip(blobs, own, twice, strict=True):
            hit = np.union1d(x[np.isin(x, again)], y)
            if len(hit):
                yield pa.record_batch([pa.array([row["part"]]), pa.array([bucket]), pa.array([hit.tobytes()])], names=["part", "bucket", "again"])


def _phrases(span: int, buckets: int, chunk: int, most: int):
    """Reads, for each part, its recurring triggers and then its texts with their hashes; gives phrases for the buckets and ranges that are settled here."""
    width = 2 * span - GRAM  # bytes of the longest phrase

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, again, copies = None, [], set()
        keys, common = np.zeros(0, dtype=np.uint64), Common(width, most)
        for batch in rows:
            of = batch.column(0).to_numpy()
            for p, lo, hi in zip(*(x.tolist() for x in _runs(of)), strict=True):
                if p != part:
                    part, again, copies, keys, common = p, [], set(), np.zeros(0, dtype=np.uint64), Common(width, most)
                some = batch.slice(lo, hi - lo)
                kind = some.column(1).to_numpy()
                copies.update(zip(*(some.column(i).to_numpy()[kind == -1].tolist() for i in (2, 5)), strict=True))
                for i in np.flatnonzero(kind == 0).tolist():
                    again.append(np.uint64(some.column(2)[i].as_py()) << U64(32) | np.frombuffer(some.column(3)[i].as_py(), dtype=np.uint32))
                texts = some.filter(pa.array(kind == 1))
                if not texts.num_rows:
                    continue
                if again:
                    keys, again = np.unique(np.concatenate(again)), []
                text = pa.record_batch([texts.column(2), texts.column(4)], names=["id", "text"])
                for piece, a, b in batches(iter([text]), chunk):
                    doc, mark = (texts.column(i).slice(a, b - a).to_numpy() for i in (2, 5))
                    lines = [None if (d, m) in copies else t for t, d, m in zip(piece.column(1).slice(a, b - a).to_pylist(), doc.tolist(), mark.tolist(), strict=True)]
                    for data, ends, owner, offset in _laid(lines, span, chunk) if len(keys) else ():
                        yield from _emit(data, ends, doc[owner], mark[owner], offset, keys, span, buckets, width, common)

    return run


class Common:
    """Phrases that several documents of a part share, each with the least document seen: later ones need not be sent again and again.

    It holds a fixed number of phrases; those beyond go to their buckets like others.
    """

    def __init__(self, width: int, most: int):
        self.most = most
        self.hash, self.doc, self.strings = (np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int64))
        self.body = np.zeros((0, width), dtype=np.uint8)

    def later(self, body: np.ndarray, strings: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which phrases a smaller document of the part is known to have."""
        out = np.zeros(len(doc), dtype=bool)
        if len(self.hash):
            h = self._hash(body, strings)
            at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            met = np.flatnonzero((self.hash[at] == h) & (doc > self.doc[at]))
            same = (self.strings[at[met]] == strings[met]) & (self.body[at[met]] == body[met]).all(axis=1)
            out[met[same]] = True
        return out

    def learn(self, body: np.ndarray, strings: np.ndarray, doc: np.ndarray) -> None:
        """Phrases with the least document that has them."""
        if not len(doc) or len(self.hash) >= self.most:
            return
        h = np.concatenate([self.hash, self._hash(body, strings)])
        body, strings, doc = np.vstack([self.body, body]), np.concatenate([self.strings, strings]), np.concatenate([self.doc, doc])
        order = np.lexsort([doc, h])
        order = order[np.append(True, h[order][1:] != h[order][:-1])][: self.most]
        self.hash, self.body, self.strings, self.doc = h[order], body[order], strings[order], doc[order]

    @staticmethod
    def _hash(body: np.ndarray, strings: np.ndarray) -> np.ndarray:
        out = mixed(strings.astype(np.uint64) * MIX_A)
        for word in _words(body):
            out = mixed(out ^ word) * MIX_A
        return out


def _emit(data, ends, doc, mark, offset, keys, span, buckets, width, common) -> Iterator[pa.RecordBatch]:
    start, strings, trigger = parse(data, ends, span)
    bucket, short = _short(trigger, buckets)
    key = bucket.astype(np.uint64) << U64(32) | short
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    hit = keys[at] == key
    start, strings, bucket, key = start[hit], strings[hit], bucket[hit], key[hit]
    if not len(start):
        return
    text = np.searchsorted(ends, start, side="right")
    place = start - np.concatenate([[0], ends[:-1]])[text] + offset[text]
    own, row = doc[text], mark[text]
    padded = np.concatenate([data, np.zeros(width, dtype=np.uint8)])
    body = sliding_window_view(padded, width)[start]
    body[np.arange(width) >= (strings + span - 1)[:, None]] = 0
    settled = common.later(body, strings, own)
    left = np.flatnonzero(~settled)
    again, shared = _owned(body[left], strings[left], own[left])
    settled[left[again]] = True
    common.learn(body[left[shared]], strings[left[shared]], own[left[shared]])
    if settled.any():
        d, r, a, b = own[settled], row[settled], place[settled], place[settled] + strings[settled] + span - 1
        new = np.ones(len(d), dtype=bool)  # phrases in a row make one range; their starts and ends go up together
        new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (a[1:] > b[:-1]) | (a[1:] < a[:-1])
        first = np.flatnonzero(new)
        yield _ranges(d[first], r[first], a[first], b[np.append(first[1:], len(d)) - 1])
    keep, reach = _collapsed(np.flatnonzero(~settled), key, own, row, place, strings, body, span)
    by_bucket = np.argsort(bucket[keep], kind="stable")
    order, reach = keep[by_bucket], reach[by_bucket]
    for b, lo, hi in zip(*(x.tolist() for x in _runs(bucket[order])), strict=True):
        i = order[lo:hi]
        blob = b"".join(x.astype(t).tobytes() for x, t in ((own[i], np.int64), (row[i], np.int64), (place[i], np.int32), (reach[lo:hi], np.int32), (strings[i], np.int32))) + body[i].tobytes()
        yield pa.record_batch([pa.array([b]), pa.array([len(i)]), pa.array([0]), pa.array([0]), pa.array([0]), pa.array([blob])], names=_PHRASE)


def _collapsed(keep, key, own, row, place, strings, body, span) -> tuple[np.ndarray, np.ndarray]:
    """Phrases with equal ones that follow each other in a row's text at most `span` bytes on as one, and how far the last begins behind the first.

    What is removed from one of them is removed from all, and without gaps between. A run of one byte, or of a period that
    is no longer than the places of a trigger in a string, is one phrase after another, and so becomes one.
    """
    a, b = keep[:-1], keep[1:]
    near = np.flatnonzero(key[a] == key[b])
    a, b = a[near], b[near]
    near = near[(own[a] == own[b]) & (row[a] == row[b]) & (strings[a] == strings[b]) & (place[b] > place[a]) & (place[b] - place[a] <= span) & (body[a] == body[b]).all(axis=1)]
    first = np.ones(len(keep), dtype=bool)
    first[near + 1] = False
    heads = np.flatnonzero(first)
    lasts = np.append(heads[1:], len(keep)) - 1 if len(keep) else heads
    return keep[heads], place[keep[lasts]] - place[keep[heads]]


_PHRASE = ["bucket", "id", "mark", "start", "stop", "blob"]


def _ranges(doc: np.ndarray, row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    return pa.record_batch([pa.array(np.full(n, -1)), *(pa.array(x.astype(np.int64)) for x in (doc, row, start, stop)), pa.array([None] * n, pa.binary())], names=_PHRASE)


def _words(body: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as big-endian 64-bit words, which sort as the bytes do."""
    pad = -body.shape[1] % 8
    wide = np.pad(body, ((0, 0), (0, pad))) if pad else np.ascontiguousarray(body)
    wide = wide.view(">u8")
    return [wide[:, i].astype(np.uint64) for i in range(wide.shape[1])]


def _sorted_classes(columns: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by columns, then doc; whether a row begins a new class in that order; the class's least doc, in that order."""
    order = np.lexsort([doc, *columns[::-1]])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    return order, new, doc[order][first][np.cumsum(new) - 1]


def _owned(body: np.ndarray, strings: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which phrases a smaller document here has too, and places of phrases that others have, each once, with its least document."""
    order, new, least = _sorted_classes([*_words(body), strings.astype(np.uint64)], doc)
    later = np.zeros(len(doc), dtype=bool)
    later[order] = doc[order] > least
    first = np.flatnonzero(new)
    shared = first[np.add.reduceat(later[order].astype(np.int64), first) > 0] if len(first) else first
    return later, order[shared]


def _dictionary(span: int):
    width = 2 * span - GRAM

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _groups(rows):
            names, places, bodies = [], [], []
            for blob in blobs:
                n, x = blob["id"], blob["blob"]
                names.append(np.frombuffer(x, dtype=np.int64, count=2 * n).reshape(2, n))
                places.append(np.frombuffer(x, dtype=np.int32, count=3 * n, offset=16 * n).reshape(3, n))
                bodies.append(np.frombuffer(x, dtype=np.uint8, offset=28 * n).reshape(n, width))
            name, at, body = np.hstack(names), np.hstack(places).astype(np.int64), np.vstack(bodies)
            del blobs, names, places, bodies
            order, new, least = _sorted_classes([*_words(body), at[2].astype(np.uint64)], name[0])
            (doc, row), (place, reach, strings), body = name[:, order], at[:, order], body[order]
            later = doc > least
            if later.any():
                yield _ranges(doc[later], row[later], place[later], place[later] + reach[later] + strings[later] + span - 1)
            entry = np.flatnonzero(new)
            lost = _suffixes(body[entry], strings[entry], doc[entry], span)
            # An owner loses the strings of its phrase that a smaller document has in another phrase, wherever it has the phrase.
            mine = np.flatnonzero(~later)
            of = (np.cumsum(new) - 1)[mine]
            lo, hi = np.searchsorted(lost[:, 0], [of, of + 1])
            times = hi - lo
            i = np.repeat(mine, times)
            j = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(times) else np.zeros(0, dtype=np.int64)
            if len(i):
                at = place[i] + lost[j, 1]
                yield _ranges(doc[i], row[i], at, at + reach[i] + lost[j, 2] + span)

    return run


def _suffixes(body: np.ndarray, strings: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """(entry, string, further strings) of runs of strings that a smaller document has in another entry, by sorting suffixes to depth span."""
    out = []
    views = sliding_window_view(body, span, axis=1)
    entry = np.repeat(np.arange(len(strings)), strings)
    string = np.arange(len(entry)) - np.repeat(np.cumsum(strings) - strings, strings)
    step = 400_000
    if len(entry) <= step:
        parts = [np.arange(len(entry))]
    else:
        probe = mixed(_words(sliding_window_view(body, 8, axis=1)[entry, string])[0]) % U64(-(-len(entry) // step))  # equal strings meet
        parts = [np.flatnonzero(probe == p) for p in range(-(-len(entry) // step))]
    for part in parts:
        if not len(part):
            continue
        e, s = entry[part], string[part]
        order, _, least = _sorted_classes(_words(views[e, s]), doc[e])
        gone = np.zeros(len(e), dtype=bool)
        gone[order] = doc[e][order] > least
        out.append(np.stack([e[gone], s[gone]], axis=1))
    lost = np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)
    lost = lost[np.lexsort([lost[:, 1], lost[:, 0]])]
    fresh = np.ones(len(lost), dtype=bool)
    fresh[1:] = (lost[1:, 0] != lost[:-1, 0]) | (lost[1:, 1] != lost[:-1, 1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(lost)) - 1 if len(lost) else first
    return np.stack([lost[first, 0], lost[first, 1], lost[last, 1] - lost[first, 1]], axis=1) if len(lost) else np.zeros((0, 3), dtype=np.int64)


def _cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges ranges, which come before their document, and takes them out of its text."""
    now, runs = None, []
    for batch in rows:
        ids, mark, kind = (batch.column(i).to_pylist() for i in (0, 1, 2))
        start, stop, copy = (batch.column(i).to_pylist() for i in (3, 4, 5))
        out = []
        for i, doc in enumerate(zip(ids, mark, strict=True)):
            if doc != now:
                now, runs = doc, []
            if kind[i] == 0:
                if runs and start[i] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], stop[i])
                else:
                    runs.append([start[i], stop[i]])
                continue
            data = (batch.column(6)[i].as_py() or "").encode("utf-8", "surrogatepass")
            gone = [[0, len(data)]] if copy[i] else runs
            kept, at = hashlib.sha256(), 0
            for a, b in gone:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            out.append((doc[0], len(data), sum(b - a for a, b in gone), len(gone), kept.hexdigest(), [x for r in gone for x in r]))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, span: int = 50, chunk: int = CHUNK, common: int = 1 << 15) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, removed) for each row of docs.

    Texts are UTF-8 bytes. Each byte is removed that is covered by a string of `span` bytes that also starts in a
    document of smaller id; `removed` has the removed runs [from, to), flattened. Null and empty texts have no bytes.
    Rows with one id are one document's: none removes from another, and each loses what its own text has of smaller ids.
    Rows with a null id take no part and lose nothing. `span` is more than 24. Other
    columns are not looked at. `chunk` bytes are parsed together; a part remembers `common` phrases; neither changes the result.
    """
    if span <= GRAM:
        raise ValueError(f"span has to be more than {GRAM}")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Stored, so that both passes see a row in the same part, in whatever order the input is read.
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.spark_partition_id().cast("long").alias("part"))
    texts = stored(read, "texts")
    known = texts.where("id is not null")

    prints = stored(known.select("id", "part", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), F.octet_length("text").cast("long").alias("size")), "prints")
    least = prints.groupBy("h", "g", "size").agg(F.min("id").alias("owner"))
    copies = stored(prints.where(F.col("size") >= span).join(least, ["h", "g", "size"]).where("id > owner").select("id", F.col("h").alias("mark"), "part").distinct(), "copies")
    total, parts = prints.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("part"), F.lit(0)) + 1).first()
    buckets = max(1, int(2 * total / (span - GRAM + 2)) // BUCKET_TRIGGERS)

    # Parts and buckets are numbered from 0, and each is a partition of its own.
    counted = known.select("id", "text", "part").mapInArrow(_count_triggers(span, buckets), "bucket long, part long, once binary, more binary")
    again = counted.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(_recurring, "part long, bucket long, again binary")
    none, blob = F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("again")
    marks = again.select("part", F.lit(0).alias("kind"), F.col("bucket").alias("x"), "again", none, F.lit(0).cast("long").alias("mark"))
    marks = marks.union(copies.select("part", F.lit(-1), F.col("id"), blob, none, "mark"))
    body = known.select("part", F.lit(1).alias("kind"), F.col("id").alias("x"), blob, "text", F.xxhash64("text").alias("mark"))
    dealt = marks.unionByName(body).repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "kind")
    phrases = stored(dealt.mapInArrow(_phrases(span, buckets, min(chunk, CHUNK), common), "bucket long, id long, mark long, start long, stop long, blob binary"), "phrases")
    more = phrases.where("bucket >= 0").repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    more = more.mapInArrow(_dictionary(span), "bucket long, id long, mark long, start long, stop long, blob binary")
    ranges = stored(phrases.where("bucket < 0").union(more).select("id", "mark", "start", "stop"), "ranges")
    dropped(prints, phrases)

    # A copy is one by its id and its text: other rows of the id keep theirs.
    marked = copies.select("id", "mark").distinct().withColumn("copy", F.lit(True))
    given = texts.select("id", "text", F.xxhash64("text").alias("mark"))
    rows = given.join(marked, ["id", "mark"], "left").select("id", "mark", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"), F.coalesce("copy", F.lit(False)).alias("copy"), "text")
    cuts = ranges.select("id", "mark", F.lit(0).alias("kind"), "start", "stop", F.lit(False).alias("copy"), F.lit(None).cast("string").alias("text"))
    done = cuts.unionByName(rows).repartition(n, "id", "mark").sortWithinPartitions("id", "mark", "kind", "start")
    return done.mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>").withColumnRenamed("id", id_col)
