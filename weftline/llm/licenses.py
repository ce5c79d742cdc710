"""License notices by conditional compression, confirmed by their wording.

Every notice has one of a few telling words, so a match goes through one of them, wherever in a line it stands and however
many lines it takes. The words around each that a template could take up, as many more as it allows, are a candidate
block if enough of the template's words are among them at all. Each block is compressed with none and with its template as
raw zstandard dictionary; candidates are ranked by the bytes that saves, whatever template and place they are of. From the
first on, a candidate is confirmed by aligning the template with the words at the least number of words missing and
added: it stands where their share is at most `differ`, all words that tell one license from another (names, numbers) are
there and unopposed, and no better candidate has the words. `saving` is the share of bytes saved on the span found.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import batches

CHUNK = 2_000_000

#: Notices by license, as commonly worded.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal Public Domain Dedication."),
    # References in a sentence.
    *((name, f"under the {said} license") for name, said in (("MIT", "MIT"), ("Apache-2.0", "Apache"), ("Apache-2.0", "Apache 2.0"), ("BSD-3-Clause", "BSD 3-Clause"), ("BSD-2-Clause", "BSD 2-Clause"), ("ISC", "ISC"), ("MPL-2.0", "Mozilla Public"))),
    *((f"{kind}-{n}.0", f"licensed under the GNU {kind} v{n}") for kind, n in (("GPL", 2), ("GPL", 3), ("LGPL", 3), ("AGPL", 3))),
    ("MIT OR Apache-2.0", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    # Titles of whole texts, and the beginnings of what they grant.
    ("MIT", "MIT License"),
    ("ISC", "ISC License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    # Identifiers as https://spdx.org/licenses lists them.
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "Apache-2.0", "ISC", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")),
    *((f"{name}.0", f"SPDX-License-Identifier: {name}.0{end}") for name in ("GPL-2", "GPL-3", "LGPL-3", "AGPL-3") for end in ("", "-only", "-or-later")),
    ("All rights reserved", "Copyright. All rights reserved."),
    ("All rights reserved", "All rights reserved."),
)

#: Every notice, also one within the allowed difference, has one of these words; see anchors().
TELLING_WORDS = ("license", "spdx-license-identifier", "permission", "fee", "hereby", "granted", "documentation", "apache", "gnu", "redistribution", "binary", "modification", "permitted", "mozilla", "domain", "cc", "cc0", "reserved")
TELLING = re.compile(rf"(?i)(?<![a-z0-9])(?:{'|'.join(TELLING_WORDS)})(?![a-z0-9])")
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: Words that tell licenses apart: changing one names another license.
_NAMES = re.compile(r"^(?:(?:mit|apache|gnu|[al]?gpl|bsd|mozilla|mpl|isc|cc0?|unlicense)(?:-[0-9a-z.-]+)?|lesser|affero|by(?:-[a-z]+)*|v?[0-9][0-9a-z.-]*|version|v|domain)$")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@lru_cache(maxsize=1)
def _coders():
    import zstandard

    plain = zstandard.ZstdCompressor(level=9)
    return plain, [zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(" ".join(words(t)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in TEMPLATES]


def saved(span: list[str], template: int) -> tuple[int, int]:
    """Bytes that the template as dictionary saves on the words of a span, and bytes without. Case and what stands between words do not count."""
    plain, coders = _coders()
    data = " ".join(span).encode()
    whole = len(plain.compress(data))
    return whole - len(coders[template].compress(data)), whole


def allowed(template: list[str], differ: float) -> int:
    """Words that may be missing or added."""
    return int(differ * len(template) + 1e-9)


@lru_cache(maxsize=8)
def anchors(differ: float) -> dict[str, list[tuple[int, int]]]:
    """Telling word: its places (template, word) in the templates.

    A match keeps all names, and so many words that of one more telling words than may be missing, one is kept. So each
    template has a name among the telling words or more of them than it may miss, and each match goes through a place given here.
    """
    out: dict[str, list[tuple[int, int]]] = {}
    for i, (_, text) in enumerate(TEMPLATES):
        w = words(text)
        own = {x for x in w if x in TELLING_WORDS}
        named = {x for x in own if _NAMES.match(x)}
        if not named and len(own) <= allowed(w, differ):
            raise ValueError(f"too few telling words for a difference of {differ}: {text}")
        for at, x in enumerate(w):
            if x in (named or own):
                out.setdefault(x, []).append((i, at))
    return out


@lru_cache(maxsize=8)
def _kept_names(template: int) -> list[frozenset[int]]:
    """Places of the template that must be kept: each name once. Where a name occurs twice, either place will do."""
    w = words(TEMPLATES[template][1])
    return [frozenset(x) for x in product(*([at for at, x in enumerate(w) if x == name] for name in sorted({x for x in w if _NAMES.match(x)})))]


def _half(template: list[str], must: list[bool], text: list[str], free: list[bool], most: int) -> tuple[int, list[int]] | None:
    """(words missing and added, places in text kept) of the best alignment of the template with the beginning of text, at most `most` off.

    Names are not added, words at must not missing, words of text that are not free not kept.
    """
    n, far = len(template), most + 1
    cost = [{j: j for j in range(min(most, len(text)) + 1) if not any(_NAMES.match(x) for x in text[:j])}]
    for i in range(1, n + 1):
        last, row = cost[-1], {}
        for j in range(max(0, i - most), min(i + most, len(text)) + 1):
            best = far if must[i - 1] else last.get(j, far) + 1
            if j and free[j - 1] and text[j - 1] == template[i - 1]:
                best = min(best, last.get(j - 1, far))
            if j and row.get(j - 1, far) + 1 < best and not _NAMES.match(text[j - 1]):
                best = row[j - 1] + 1
            if best <= most:
                row[j] = best
        if not row:
            return None
        cost.append(row)
    j = min(cost[n], key=lambda j: (cost[n][j], j))
    off, i, kept = cost[n][j], n, []
    while i:
        here = cost[i][j]
        if j and free[j - 1] and text[j - 1] == template[i - 1] and cost[i - 1].get(j - 1) == here:
            i, j = i - 1, j - 1
            kept.append(j)
        elif not must[i - 1] and cost[i - 1].get(j, far) + 1 == here:
            i -= 1
        else:
            j -= 1
    return off, kept


class Text:
    """The words of a text by their places, and which of them belong to a notice already."""

    def __init__(self, text: str):
        self.low, self.starts, self.ends, self.taken = text.lower(), array("q"), array("q"), set()
        for m in _WORD.finditer(self.low):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def words(self, a: int, b: int) -> list[str]:
        return [self.low[self.starts[i] : self.ends[i]] for i in range(max(a, 0), min(b, len(self.starts)))]

    def around(self, at: int, template: int, place: int, differ: float) -> tuple[list[str], list[str]] | None:
        """The words before and after `at` that a match with the template's word `place` there could have; None where too few of the template's are among them."""
        w = _template_words(template)
        most = allowed(w, differ)
        before, after = self.words(at - place - most, at), self.words(at + 1, at + len(w) - place + most)
        if len(before) + most < place or len(after) + most < len(w) - place - 1:
            return None
        if not most and (before != w[:place] or after != w[place + 1 :]):
            return None
        if sum(((Counter(before) + Counter(after)) & Counter(w)).values()) + 1 < len(w) - most:
            return None
        return before, after

    def match(self, at: int, template: int, place: int, differ: float) -> tuple[int, list[int]] | None:
        """(words missing and added, places of the words kept) of the best match that has the template's word `place` at `at`, in words not taken."""
        w = _template_words(template)
        most, near = allowed(w, differ), self.around(at, template, place, differ)
        if near is None or at in self.taken:
            return None
        before, after = near[0][::-1], near[1]
        best = None
        for kept in _kept_names(template):
            must = [i in kept for i in range(len(w))]
            left = _half(w[:place][::-1], must[:place][::-1], before, [at - 1 - i not in self.taken for i in range(len(before))], most)
            right = left and _half(w[place + 1 :], must[place + 1 :], after, [at + 1 + i not in self.taken for i in range(len(after))], most - left[0])
            if right and (best is None or left[0] + right[0] < best[0]):
                best = left[0] + right[0], sorted([at - 1 - i for i in left[1]] + [at] + [at + 1 + i for i in right[1]])
        return best


@lru_cache(maxsize=None)
def _template_words(template: int) -> list[str]:
    return words(TEMPLATES[template][1])


def scan(text: str | None, *, saving: float = 0.15, differ: float = 0.15) -> list[tuple[int, int, str, float, int, int]]:
    """(first line, end line, license, saving, words missing, words added) of the notices in a text, lines from 0.

    Of candidates that share words the one whose block its template saves most bytes of stands if its wording confirms it,
    earlier templates on ties; the others have the words left.
    """
    if not text or not TELLING.search(text):
        return []
    doc, places, found, heap = Text(text), anchors(differ), [], []
    for at, (a, b) in enumerate(zip(doc.starts, doc.ends, strict=True)):
        for template, place in places.get(doc.low[a:b], ()):
            near = doc.around(at, template, place, differ)
            if near:
                gain, _ = saved([*near[0], doc.low[a:b], *near[1]], template)
                heappush(heap, (-gain, template, at, place))
    while heap:
        _, template, at, place = heappop(heap)
        best = doc.match(at, template, place, differ)
        if not best:
            continue
        kept = best[1]
        gain, size = saved(doc.words(kept[0], kept[-1] + 1), template)
        if gain >= saving * size:
            doc.taken.update(kept)
            missing = len(_template_words(template)) - len(kept)
            found.append((kept[0], kept[-1], TEMPLATES[template][0], round(gain / size, 4), missing, kept[-1] + 1 - kept[0] - len(kept)))
    found.sort()
    out, line, at = [], 0, 0
    for first, last, *rest in found:
        line += doc.low.count("\n", at, doc.starts[first])
        at = doc.starts[first]
        out.append((line, line + doc.low.count("\n", at, doc.starts[last]) + 1, *rest))
    return out


def _scanned(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32())
    names = ["first_line", "end_line", "license", "saving", "words_missing", "words_added"]
    for batch, a, b in batches(rows, CHUNK):
        ids, out = [], []
        for doc, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
            for hit in scan(text):
                ids.append(doc)
                out.append(hit)
        columns = list(zip(*out, strict=True)) or [()] * 6
        yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", *names])


def license_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each notice: id_col, first_line, end_line (exclusive), license, saving, words_missing, words_added.

    Null and empty texts have none; repeated rows and rows with null ids are scanned like others. Of templates that
    share words of a text, the one that saves most bytes wins, earlier ones on ties. Other columns are not looked at.
    """
    texts = docs.where(F.col(text_col).rlike(TELLING.pattern)).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shape = "id long, first_line int, end_line int, license string, saving double, words_missing int, words_added int"
    return texts.mapInArrow(_scanned, shape).withColumnRenamed("id", id_col)
