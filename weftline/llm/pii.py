"""Personal data by patterns, and by a span classifier trained from weak labels.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Further candidates (secrets, national
numbers, names after a title, numbers that miss a base pattern) are judged: labelers that look at form, at word lists
and at the words around vote for, against or not at all; how often each pattern of votes occurs is counted over all
documents; expectation-maximisation (Dawid and Skene, 1979) estimates from these counts how reliable each labeler is and how
likely each pattern is right; a logistic model of kind, votes and what the text is like (length, digits, case, the characters
around, the word before) is fitted to that and decides. The counts are bounded by kinds times votes times classes of
text, whatever the corpus is. Base spans vote too, so that labelers are known from many spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import batches, stored

CHUNK = 2_000_000
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "ssn", "name", "number")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Numbers between single dots, as many as there are; each four of them make an address. One number alone is taken too: a search that failed there would start again at each digit.
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]").search
_SECRET = re.compile(r"\b(?i:passw(?:or)?d|pwd|secret|token|api[_-]?key)[ ]?[=:][ ]?[^\s,;]+|\bAKIA[0-9A-Z]{12,20}\b")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? (?:[A-Z][a-z]+ ){0,2}[A-Z][a-z]+")
_NUMBER = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])|[0-9]([ -]?[0-9]){12,18}")

#: Generic top-level domains; those of countries have two letters.
_DOMAINS = frozenset("com org net edu gov mil int info biz name pro dev app io ai online site shop blog cloud tech example test".split())
#: Given names that are common in the languages of the corpus. Names a labeler does not list it does not vote on.
_GIVEN = frozenset(
    "James Mary John Anna Peter Maria Paul Laura Michael Sarah David Julia Thomas Emma Robert Sophie William Elizabeth Richard Jennifer Joseph Linda Charles Barbara "
    "Daniel Susan Matthew Jessica Anthony Karen Mark Nancy Steven Lisa Andrew Margaret George Sandra Kevin Emily Brian Olivia Edward Grace Henry Alice Jack Charlotte "
    "Hans Ursula Klaus Monika Stefan Sabine Andreas Petra Wolfgang Claudia Christian Katrin Jens Heike Markus Birgit Lukas Lena Felix Hannah "
    "Jean Marie Pierre Nathalie Michel Isabelle Philippe Catherine Nicolas Camille Julien Chloe Antoine Manon Louis Lea Hugo Ines "
    "Jose Carmen Antonio Ana Manuel Isabel Francisco Dolores Juan Pilar Javier Lucia Carlos Marta Miguel Elena Pablo Sofia Diego Rosa".split()
)
_CUES = re.compile(r"(?:mail|contact|write|ip|host|server|login|address|card|visa|credit|pay|phone|tel|call|fax|mobile|pass|user|key|secret|ssn|social|name|dear)\W*$", re.I)
_LAST_WORD = re.compile(r"([^\W\d_]+)\W*$")
_DOUBTS = re.compile(r"(?:[#$€£%]|version|ver\.|v|no\.|page|isbn|order|example)\s*$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, leftmost and without overlaps, in one pass."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of four numbers up to 255 with dots between, leftmost and without overlaps, in one pass."""
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        numbers = list(_DIGITS.finditer(text, run.start(), run.end()))
        for i in range(0, len(numbers) - 3, 4):
            four = [m[0].lstrip("0") for m in numbers[i : i + 4]]
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in four):
                yield numbers[i].start(), numbers[i + 3].end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base matches that hold, sorted; kinds as places in KINDS. Linear in the text."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT(text):
        out += [(a, 1, b) for a, b in _addresses(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that share characters as one, of the kind of the first."""
    out: list[tuple[int, int, int]] = []
    for s, k, e in sorted(spans):
        if out and s < out[-1][2]:
            out[-1] = (*out[-1][:2], max(out[-1][2], e))
        else:
            out.append((s, k, e))
    return out


def further_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that touch no base span and not each other, leftmost first."""
    found = []
    if "=" in text or ":" in text or "AKIA" in text:
        found += [(m.start(), 4, m.end()) for m in _SECRET.finditer(text)]
    if _DIGIT(text):
        found += [(m.start(), 5, m.end()) for m in _SSN.finditer(text)]
        found += [(m.start(), 7, m.end()) for m in _NUMBER.finditer(text)]
    if any(t in text for t in ("Mr", "Ms", "Dr", "Prof")):
        found += [(m.start(), 6, m.end()) for m in _NAME.finditer(text)]
    out, busy, at, end = [], merged(base), 0, 0
    for s, k, e in sorted(found):
        while at < len(busy) and busy[at][2] <= s:
            at += 1
        if s >= end and (at == len(busy) or busy[at][0] >= e):
            out.append((s, k, e))
            end = e
    return out


def _form(kind: int, span: str) -> int:
    if kind == 0:
        return 1 if ".." not in span and not span.startswith((".", "-")) else -1
    if kind == 1:
        return 1 if not any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else -1
    if kind in (2, 3):
        return 1
    if kind == 4:
        value = re.split(r"[=:]", span, maxsplit=1)[-1].strip()
        return 1 if len(value) >= 8 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) else -1 if len(value) < 4 or value.isalpha() else 0
    if kind == 5:
        return 1 if span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000" else -1
    if kind == 6:
        return 0
    return 1 if len(re.sub(r"[^0-9]", "", span)) == 10 else -1


def _listed(kind: int, span: str) -> int:
    if kind == 0:
        return 1 if len(last := span.rsplit(".", 1)[-1].lower()) == 2 and last.isalpha() or last in _DOMAINS else -1
    if kind == 1:
        return -1 if span.startswith(("0.", "127.", "255.")) else 1
    if kind == 2:
        return 1 if span[0] in "3456" else -1
    if kind == 3:
        return 0
    if kind == 4:
        return 1 if span.startswith("AKIA") or "passw" in span.lower() else 0
    if kind == 6:
        return 1 if any(w in _GIVEN for w in span.split()) else 0
    if kind == 7:  # a longer number that is no card has failed its checksum
        return -1 if sum(c.isdigit() for c in span) != 10 else 0
    return 0


def votes(text: str, start: int, kind: int, end: int) -> tuple[int, ...]:
    """The labelers' votes on a span: form, word lists, cue before, doubt before, free edges."""
    before = text[max(0, start - 24) : start]
    edge = lambda c: not c or not (c.isalnum() or c in "_-@")
    free = edge(text[start - 1 : start]) and edge(text[end : end + 1])
    return (_form(kind, text[start:end]), _listed(kind, text[start:end]), 1 if _CUES.search(before) else 0, -1 if _DOUBTS.search(before) else 0, 1 if free else -1)


VOTERS = 5
#: Classes of what the text of a span is like; see looks().
LOOKS = (4, 4, 4, 3, 3, 8)


def looks(text: str, start: int, end: int) -> tuple[int, ...]:
    """Classes of length, share of digits, case, the characters before and after, and the word before (by a hash of its letters)."""
    span = text[start:end]
    digits = sum(c.isdigit() for c in span)
    case = 2 * any(c.isupper() for c in span) + any(c.islower() for c in span)
    side = lambda c: 0 if not c or c.isspace() else 1 if c.isalnum() else 2
    before = _LAST_WORD.search(text, max(0, start - 24), start)
    return (min(3, len(span) // 12), min(3, 4 * digits // len(span)), case, side(text[start - 1 : start]), side(text[end : end + 1]), sum(map(ord, before[1].lower())) % 7 + 1 if before else 0)


def pattern(kind: int, cast: tuple[int, ...], look: tuple[int, ...]) -> int:
    """One number for kind, votes and looks."""
    out = kind
    for v in cast:
        out = out * 3 + v + 1
    for v, n in zip(look, LOOKS, strict=True):
        out = out * n + v
    return out


def parts(code: int) -> tuple[int, list[int], list[int]]:
    cast, look = [], []
    for n in reversed(LOOKS):
        code, v = divmod(code, n)
        look.insert(0, v)
    for _ in range(VOTERS):
        code, v = divmod(code, 3)
        cast.insert(0, v - 1)
    return code, cast, look


def reliabilities(cast: np.ndarray, kinds: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: each labeler's chance of a right vote, each pattern's chance of being personal data."""
    right, prior = np.full(cast.shape[1], 0.8), np.full(len(KINDS), 0.7)
    p = np.full(len(cast), 0.5)
    for _ in range(rounds):
        odds = np.log(prior[kinds] / (1 - prior[kinds])) + (cast * np.log(right / (1 - right))).sum(axis=1)
        p = 1 / (1 + np.exp(-odds))
        agree = np.where(cast > 0, p[:, None], 1 - p[:, None]) * (cast != 0)
        right = np.clip(((agree * counts[:, None]).sum(axis=0) + 8) / (((cast != 0) * counts[:, None]).sum(axis=0) + 10), 0.55, 0.99)
        for kind in range(len(KINDS)):
            own = kinds == kind
            prior[kind] = np.clip(((p * counts)[own].sum() + 7) / (counts[own].sum() + 10), 0.05, 0.95)
    return right, p


def accepted(codes: list[int], counts: list[int], threshold: float = 0.5, rounds: int = 300) -> set[int]:
    """The patterns that the span classifier takes."""
    if not codes:
        return set()
    split = [parts(c) for c in codes]
    kinds, cast, look = np.array([k for k, _, _ in split]), np.array([v for _, v, _ in split], dtype=float), np.array([s for _, _, s in split])
    weight = np.array(counts, dtype=float)
    _, p = reliabilities(cast, kinds, weight)
    x = np.hstack([np.ones((len(codes), 1)), cast == 1, cast == -1, np.eye(len(KINDS))[kinds], *(np.eye(n)[look[:, i]] for i, n in enumerate(LOOKS))])
    w, weight = np.zeros(x.shape[1]), np.sqrt(weight)  # a common pattern must not drown all others
    for _ in range(rounds):  # damped Newton steps on the weighted log loss with a small penalty
        q = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (weight * (p - q)) - 0.1 * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    q = 1 / (1 + np.exp(-x @ w))
    return {c for c, chance in zip(codes, q, strict=True) if chance >= threshold}


def _candidates(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, a, b in batches(rows, CHUNK):
        spans, codes, n_base = [], [], []
        for text in batch.column(1).slice(a, b - a).to_pylist():
            text = text or ""
            base = base_spans(text)
            full = base + further_spans(text, base)
            spans.append([x for span in full for x in span])
            codes.append([pattern(k, votes(text, s, k, e), looks(text, s, e)) for s, k, e in full])
            n_base.append(len(base))
        yield pa.record_batch(
            [batch.column(0).slice(a, b - a), pa.array(spans, pa.list_(pa.int64())), pa.array(codes, pa.list_(pa.int64())), pa.array(n_base, pa.int64())], names=["id", "spans", "codes", "n_base"]
        )


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _decided(taken: set[int]):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for flat, codes, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                spans = [tuple(flat[i : i + 3]) for i in range(0, len(flat), 3)]
                kinds = [k for _, k, _ in spans[:n]]
                out.append((*(kinds.count(k) for k in range(4)), _joined(spans[:n]), _joined(spans[:n] + [s for s, c in zip(spans[n:], codes[n:], strict=True) if c in taken])))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=["id", *(f"n_{k}" for k in BASE), "base", "spans"])

    return run


_FOUND = "id long, spans array<long>, codes array<long>, n_base long"


def _learned(found: DataFrame) -> set[int]:
    """The patterns to take, from the counts over all documents: at most kinds x votes x looks rows."""
    counted = found.select(F.explode("codes").alias("code")).groupBy("code").count().orderBy("code").collect()
    return accepted([r["code"] for r in counted], [r["count"] for r in counted])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base, spans) for each row of docs; spans are kind:start:end in code points.

    Null texts are as empty ones and have no spans. Repeated rows, and rows with null ids, each get a row. An empty
    table gives no rows. Other columns are not looked at.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = stored(texts.mapInArrow(_candidates, _FOUND), "candidates")
    taken = _learned(found)
    return found.mapInArrow(_decided(taken), "id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string").withColumnRenamed("id", id_col)


def _redacting(taken: set[int]):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b in batches(rows, CHUNK):
            out = []
            for text in batch.column(1).slice(a, b - a).to_pylist():
                base = base_spans(text or "")
                more = [(s, k, e) for s, k, e in further_spans(text or "", base) if pattern(k, votes(text, s, k, e), looks(text, s, e)) in taken]
                left, at = [], 0
                for s, k, e in merged(base + more):
                    left += [text[at:s], f"<{KINDS[k]}>"]
                    at = e
                out.append(text if text is None else "".join(left) + text[at:])
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(out, pa.string())], names=["id", "text"])

    return run


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col) for each row of docs, with each span replaced by its kind in angle brackets; spans that share characters go as one, of the kind of the first.

    Null texts stay null. Rows are taken as they are, whatever their ids.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    taken = _learned(stored(texts.mapInArrow(_candidates, _FOUND), "candidates"))
    return texts.mapInArrow(_redacting(taken), "id long, text string").select(F.col("id").alias(id_col), F.col("text").alias(text_col))
