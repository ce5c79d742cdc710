"""The corpus operators on small hand-made tables, against plain restatements."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from weftline.llm import decontam, licenses, lines, near_dup, packing, pii, quality, repeats, sharding, topk

rng = random.Random(7)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@cache
def corpus():
    base = prose(120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    rows = [(1, base), (2, base), (3, near), (4, base.upper()), (5, prose(150)), (6, ""), (7, None), (8, "one two"), (9, "One TWO"), (10, "\t \n"), (11, prose(40) + "\n" + words[0] * 9 + base[:200]), (12, base + "\n" + prose(5))]
    rows += [(20 + i, " ".join(words[:i] + ["x"] + words[i + 1 :])) for i in range(0, 120, 8)]
    return rows


SCHEMA = "doc_id long, text string"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def odd(spark):
    """Nulls, repeated rows, ties and columns whose names the operators use inside."""
    rows = [(1, "same words here again and again", 5, 6), (1, "same words here again and again", 5, 6), (None, "same words here again and again", 1, 2), (2, None, 1, 1), (3, "", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, id long, row long")


def sets(rows, k):
    out = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, docs, none, k):
    s = sets(corpus(), k)
    group = {i: i for i in s}
    for i in sorted(s):
        for j in sorted(s):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= 80 * (len(s[i]) + len(s[j]) - both):
                low, high = sorted((group[i], group[j]))
                group = {x: low if g == high else g for x, g in group.items()}
    got = near_dup.near_duplicates(docs, k=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s[i]), group[i], group[i] == i) for i in s}
    assert near_dup.near_duplicates(none).count() == 0
    assert sorted((r.doc_id or -1, r.kept) for r in near_dup.near_duplicates(odd(spark)).collect()) == [(-1, True), (1, True), (1, True), (2, True), (3, True)]


def test_blocks_lose_no_link(spark, docs, monkeypatch):
    whole = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, k=4).collect()}
    monkeypatch.setattr(near_dup, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(near_dup, "FAMILY_BLOCK", 3)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, k=4).collect()} == whole


def test_pruning_bound():
    least = near_dup.least_matches(0.8, 1e-6)
    assert least == sorted(least) and 75 < least[-1] < 102


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_token_ids(tokenizer):
    tokens = packing.Tokens(tokenizer)
    for text in ["a  b", " a", "a ", "", "it's, ok!", "a\n b", "日本 語é", "tab\t x", "x<|endoftext|>y", "1,234 (5) a_b", "été. Ça", prose(30)]:
        assert tokens.of(text) == tokens.ids(text), text


def test_packing(spark, docs, none, tokenizer):
    rows = packing.packed(docs, tokenizer, size=64).collect()
    tokens, expected = packing.Tokens(tokenizer), {}
    for i, text in corpus():
        data = tokens.ids(text or "") + b"\0\0\0\0"
        expected |= {(i, p): (s, n, zlib.crc32(data[4 * s : 4 * (s + n)])) for p, (s, n) in enumerate(packing.pieces_of(len(data) // 4, 64))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected
    at = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 64 and len(at) <= 1.1 * sum(at.values()) / 64 + 1
    assert packing.packed(none, tokenizer).count() == 0
    assert packing.packed(odd(spark), tokenizer).count() == 5


def test_sharding(spark, docs, none):
    rows = sharding.assign_shards(docs, shards=4).collect()
    texts = dict(corpus())
    sizes, slots = [0] * 4, {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert r.slot == slots.get(r.shard, 0)
        slots[r.shard] = r.slot + 1
        sizes[r.shard] += r.size
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)
    assert sharding.assign_shards(none).count() == 0
    assert sharding.assign_shards(odd(spark), shards=2).count() == 5


def test_sharding_law(spark):
    """Rows in the order of their ids; a row belongs to the shard in which the middle of its bytes falls."""
    rows = [(i, prose(rng.choice([0, 1, 3, 40, 400]))) for i in rng.sample(range(-500, 5000), 300)]
    found = {r.doc_id: (r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.assign_shards(spark.createDataFrame(rows, SCHEMA).repartition(4), shards=16).collect()}
    total, at, slots = sum(len(t.encode()) + 1 for _, t in rows), 0, [0] * 16
    for i, text in sorted(rows):
        size = len(text.encode()) + 1
        shard = int((at + size / 2) * 16 // total)
        assert found[i] == (size, zlib.crc32(text.encode()), shard, slots[shard])
        slots[shard] += 1
        at += size


def test_quality_is_repeatable(spark):
    """One id on two texts, with labels that differ, in any order of rows; and trees walked one document at a time."""
    rows = [(i, ("good words in a row, said well. " * (3 + i % 5)) if i % 2 else "x# 9$ " * (2 + i % 7)) for i in range(200)]
    rows += [(i, "another text of the same id") for i in range(0, 200, 9)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(4, 1), (None, 1), (6, None)], "doc_id long, quality int")
    one = quality.scored(spark.createDataFrame(rows, SCHEMA).repartition(3), labels).collect()
    two = quality.scored(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5), labels).collect()
    assert sorted((r.doc_id, r.text, r.score) for r in one) == sorted((r.doc_id, r.text, r.score) for r in two)


def test_trees_walked_one_by_one():
    """Each tree followed from its root for each row, and each first cut against every other cut."""
    import numpy as np

    own = np.random.default_rng(4)
    x = own.normal(size=(300, 6)).round(1)
    y = (x[:, 2] + 0.3 * x[:, 4] > 0.2).astype(float)
    model = quality.fit(x, y, trees=7, depth=3, least=1.0)
    for row, score in zip(x, model.score(x), strict=True):
        total = model.base
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12
    p = y.mean()

    def gain(f, c):
        left = x[:, f] <= c
        sums = [((y[s] - p).sum() ** 2 / (p * (1 - p) * s.sum() + 1.0)) for s in (left, ~left)]
        return sum(sums)

    cuts = [(f, c) for f in range(6) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) if 0 < (x[:, f] <= c).sum() < len(x)]
    assert gain(int(model.feature[0][0]), model.cut[0][0]) >= max(gain(f, c) for f, c in cuts) - 1.0


def test_quality(spark, none):
    texts = [(i, prose(60) if i % 3 else " ".join(w.upper() + "!!" for w in prose(60).split())) for i in range(400)]
    docs, labels = spark.createDataFrame(texts, SCHEMA), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    rows = quality.scored(docs, labels, least=1.0).collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == (r.doc_id % 3 > 0) for r in held) / len(held) > 0.95
    assert quality.scored(none, labels).count() == 0
    assert {r.score for r in quality.scored(odd(spark), labels.limit(0)).collect()} == {0.5}
    assert len(quality.statistics(None)) == len(quality.statistics("a b")) == len(quality.NAMES)


def plain_spans(rows, span):
    first, out = {}, {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = [False] * len(data)
        strings = [data[p : p + span] for p in range(len(data) - span + 1)]
        for p, s in enumerate(strings):
            if first.get(s, i) < i:
                gone[p : p + span] = [True] * span
        for s in strings:
            first.setdefault(s, i)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("span", [25, 50])
def test_repeated_spans(spark, docs, none, span):
    rows = repeats.repeated_spans(docs, span=span).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == plain_spans(corpus(), span)
    assert repeats.repeated_spans(none).count() == 0
    assert repeats.repeated_spans(odd(spark)).count() == 5


@pytest.mark.parametrize("most", [0, 5, 1 << 15])
def test_common_phrases_of_a_part(spark, most):
    """A passage that all documents have, in any order of ids, whatever is remembered of it."""
    shared = prose(40)
    rows = [(i, prose(12) + " " + shared[i % 7 :] + " " + "de " * (i % 50)) for i in range(80)]
    rng.shuffle(rows)
    found = repeats.repeated_spans(spark.createDataFrame(rows, SCHEMA).coalesce(2), chunk=700, common=most).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == plain_spans(rows, 50)


def test_runs_of_a_short_period_are_few_phrases(spark):
    """Dashes, tables and one letter, alone, between words, cut short and in several documents; a run is as few phrases as its period has bytes."""
    runs = ["-" * 3_000, "| " * 900, "A" * 260 + "B" + "A" * 260, "ab-" * 300 + "x" + "ab-" * 20, "=" * 60]
    rows = [(i, prose(i % 4) + r[: len(r) - 7 * i] + prose(i % 3)) for i, r in enumerate(runs * 4)] + [(90, "-" * 49), (91, "-" * 50), (92, "x" + "-" * 51 + "y")]
    found = repeats.repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk=2_000).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == plain_spans(rows, 50)
    for text, period in (("-" * 100_000, 1), ("| " * 50_000, 2), ("abc-" * 20_000, 4)):
        data, ends = repeats.np.frombuffer(text.encode(), dtype=repeats.np.uint8), repeats.np.array([len(text)])
        keys = repeats.np.unique(repeats.parse(data, ends, 50)[2])
        keys = repeats.np.unique(keys.astype(repeats.np.uint32).astype(repeats.np.uint64))
        zero = repeats.np.zeros(1, dtype=repeats.np.int64)
        sent = sum(b.column(1).to_pylist()[0] for b in repeats._emit(data, ends, zero + 5, zero, zero, keys, 50, 1, 76, repeats.Common(76, 100)) if b.column(0)[0].as_py() >= 0)
        assert sent <= period + 4, (text[:4], sent)


def test_rows_that_share_an_id(spark):
    """Each loses what its own text has of smaller ids, none what the other has."""
    a, b = prose(30), prose(30)
    rows = [(1, a), (1, b + " " + a[:80]), (2, a), (2, "short"), (2, b + prose(9)), (3, a[:60] + "#" + b[:70]), (3, a[:60] + "#" + b[:70]), (None, a)]
    found = repeats.repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in found)
    whole = {i: [t for j, t in rows if j == i] for i in (1, 2, 3)}
    expected = [(0, len(a), 0)]
    for i, own in whole.items():
        earlier = {t.encode()[p : p + 50] for j in whole if j < i for t in whole[j] for p in range(len(t.encode()) - 49)}
        for t in own:
            data, gone = t.encode(), set()
            for p in range(len(data) - 49):
                if data[p : p + 50] in earlier:
                    gone |= set(range(p, p + 50))
            expected.append((i, len(data), len(gone)))
    assert got == sorted(expected) and any(x[2] for x in got)


def test_long_texts_are_parsed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 300)
    rows = [(1, prose(200)), (2, prose(50) + prose(10))]
    rows.append((3, rows[0][1][100:700] + "é" + rows[1][1][30:200]))
    texts = [t for _, t in rows]
    seen = [(int(o[np_text]), bytes(d[s : s + n + 49])) for d, e, w, o in repeats._laid(texts, 50) for s, n, _ in zip(*repeats.parse(d, e, 50), strict=True) for np_text in [int((e <= s).sum())]]
    strings = {b[p : p + 50] for _, b in seen for p in range(len(b) - 49)}
    assert strings == {t.encode()[p : p + 50] for t in texts for p in range(len(t.encode()) - 49)}


def plain_lines(rows):
    seen, out = [], {}
    for i, text in sorted(rows):
        removed = []
        for p, line in enumerate((text or "").split("\n")):
            w = frozenset(line.split(" ")) - {""}
            if not w:
                continue
            if any(100 * len(w & v) >= 80 * len(w | v) for v in seen):
                removed.append(p)
            seen.append(w)
        out[i] = removed
    return out


def test_line_matches(spark, none):
    pool = [prose(rng.randint(1, 30)) for _ in range(25)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(4):
            w = rng.choice(pool).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            own.append(" ".join(w))
        rows.append((i, "\n".join(own)))
    docs = spark.createDataFrame([*rows, (90, None), (91, "")], SCHEMA).repartition(3)
    expected = plain_lines([*rows, (90, None), (91, "")])
    assert {r.doc_id: list(r.removed) for r in lines.line_matches(docs).collect()} == expected
    kept = {r.doc_id: r.text for r in lines.without_matches(docs).collect()}
    assert kept[90] is None
    for i, text in rows:
        assert kept[i] == "\n".join(x for p, x in enumerate(text.split("\n")) if p not in expected[i])
    assert lines.line_matches(none).count() == 0
    assert sorted(list(r.removed) for r in lines.line_matches(odd(spark)).collect()) == [[]] * 5


def test_line_matches_of_rows_that_were_not_read_from_files(spark):
    """A grouped input with a wide column and columns with names used inside, shuffled anew in each evaluation."""
    from pyspark.sql import functions as F

    pool = [prose(12) for _ in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(5))) for i in range(240)]
    twice = spark.createDataFrame(rows + rows, SCHEMA).repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        docs = twice.groupBy("doc_id").agg(F.first("text").alias("text"), F.repeat(F.first("text"), 20).alias("removed"), F.count("*").alias("_row"), F.max("doc_id").alias("th"), F.max("doc_id").alias("f"))
        expected = plain_lines(rows)
        kept = lines.without_matches(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert kept[0].__fields__ == docs.columns
    assert len(kept) == len(rows)
    for r in kept:
        text = dict(rows)[r.doc_id]
        assert r.text == "\n".join(x for p, x in enumerate(text.split("\n")) if p not in expected[r.doc_id])
        assert (r.removed, r._row, r.th, r.f) == (text * 20, 2, r.doc_id, r.doc_id)
    assert {r.doc_id: list(r.removed) for r in lines.line_matches(docs).collect()} == expected


def test_lines_are_cut_once_and_places_are_longs_where_they_fit(spark, monkeypatch):
    """A text is cut into lines once, no line's row carries its text's other lines, and ids that leave no room for places give the same lines."""
    assert lines._place(-5, 2**40, 999)[0].startswith("shiftleft(id, 10)")
    assert lines._place(-(2**52), 2**52 - 1, 999)[0].startswith("shiftleft")
    assert "decimal" in lines._place(0, 2**52, 999)[0] and "decimal" in lines._place(-(2**52) - 1, 0, 999)[0]
    plans, types, kept = {}, {}, lines.stored

    def seen(df, name, **how):
        plans[name], types[name] = df._jdf.queryExecution().optimizedPlan().toString(), dict(df.dtypes)
        return kept(df, name, **how)

    monkeypatch.setattr(lines, "stored", seen)
    pool = [prose(9) for _ in range(12)]
    rows = [(i - 20, "\n".join(rng.choice(pool) if rng.random() < 0.5 else prose(9) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    for shift in (0, 2**62):
        moved = [(i + shift, text) for i, text in rows]
        found = lines.line_matches(spark.createDataFrame(moved, SCHEMA)).collect()
        assert {r.doc_id: list(r.removed) for r in found} == plain_lines(moved)
        assert types["sets"]["place"] == ("decimal(32,0)" if shift else "bigint")
        assert not [x for x in plans["lines"].splitlines() if "Filter" in x and "size(split(" in x]


def test_words_are_ranked_without_casts_and_the_second_round_is_put_together_once(spark, monkeypatch):
    """No lambda function over words casts; near lines' words are one table, so that a reading of it is one join; joins on sets' names sort neither side."""
    plans, kept = {}, lines.stored

    def seen(df, name, **how):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return kept(df, name, **how)

    monkeypatch.setattr(lines, "stored", seen)
    # Changed words differ from line to line, so that lines match under several words, in both rounds; some lines occur twice.
    rows = []
    for i in range(40):
        own = []
        for k in range(6):
            w = [f"f{k}w{j}" for j in range(20)]
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(20)] = rng.choice(VOCABULARY)
            own.append(" ".join(w))
        rows.append((i, "\n".join([*own, rng.choice(own)])))
    found = lines.line_matches(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = plain_lines(rows)
    assert {r.doc_id: list(r.removed) for r in found} == expected and any(expected.values())
    for r in found:
        before = [frozenset(x.split(" ")) for i, t in rows if i < r.doc_id for x in t.split("\n")]
        own = [frozenset(x.split(" ")) for x in dict(rows)[r.doc_id].split("\n")]
        assert r.n_exact == sum(x in before or x in own[:p] for p, x in enumerate(own)) and r.n_exact + r.n_near == len(r.removed)
    for name in ("lines", "whole"):
        # Up to the end of the line: what is inside a lambda function, constants folded.
        assert not [x for x in re.findall(r"lambdafunction\((.*)", plans[name]) if re.search(r"cast\((?:lambda|\(lambda)", x)]
    assert "Join LeftOuter" in plans["words"] and plans["words"].count("strategy=shuffle_hash") == 1
    assert len(re.findall(r"\bJoin ", plans["open"])) == 1 and plans["twice"].count("strategy=shuffle_hash") == 2


def test_lines_of_repeated_rows_and_odd_ids(spark):
    """Rows with one id and one text have one result; negative and very large ids keep their order."""
    text = "one two three four five six"
    rows = [(-5, text), (-5, text), (2**62, f"{text}\n{text}"), (2**62, f"{text}\n{text}"), (-(2**62), f"x\n{text}"), (None, text), (7, f"{text}\tseven"), (7, "")]
    found = lines.line_matches(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_lines, list(r.removed)) for r in found if r.doc_id is not None) == sorted(
        [(False, -5, 1, [0])] * 2 + [(False, 2**62, 2, [0, 1])] * 2 + [(False, -(2**62), 2, []), (False, 7, 1, [0]), (False, 7, 1, [])]
    )
    assert [list(r.removed) for r in found if r.doc_id is None] == [[]]


def test_licenses(spark, none):
    texts = {1: "Released under the MIT License.", 2: "x\nThis work is licensed under the GNU General Public License, version 3.\ny", 3: "license to drive", 4: "Licensed under CC BY-NC 4.0.",
             5: "Licensed under CC BY 4.0.", 6: "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files", 7: None, 8: ""}
    found = {r.doc_id: (r.license, r.first_line, r.end_line) for r in licenses.license_notices(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()}
    assert found == {1: ("MIT", 0, 1), 2: ("GPL-3.0", 1, 2), 4: ("CC-BY-NC-4.0", 0, 1), 5: ("CC-BY-4.0", 0, 1), 6: ("MIT", 0, 2)}
    assert licenses.license_notices(none).count() == 0
    assert licenses.license_notices(odd(spark)).count() == 0


#: All wordings of notices in the given documents.
GIVEN = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
         "All rights reserved.": "All rights reserved", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}


def test_licenses_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = sorted((r.doc_id, r.first_line, r.end_line, r.license) for r in licenses.license_notices(docs).collect())
    telling = [(r.doc_id, at, line) for r in docs.collect() for at, line in enumerate((r.text or "").split("\n")) if licenses.TELLING.search(line)]
    assert {line for _, _, line in telling} == set(GIVEN)
    assert found == sorted((i, at, at + 1, GIVEN[line]) for i, at, line in telling)
    assert [x[2] for x in licenses.scan("Copyright 2020 Some One\nAll rights reserved.")] == ["All rights reserved"]


def test_licenses_inside_long_lines():
    for name, notice in licenses.TEMPLATES:
        for before, after in ((30, 0), (50, 0), (200, 200)):
            found = licenses.scan(f"{prose(5)}\n{prose(before)} {notice} {prose(after)}\n{prose(5)}")
            assert [(x[:3], x[4:]) for x in found] == [((1, 2, name), (0, 0))], notice


def test_licenses_in_any_case():
    for name, notice in licenses.TEMPLATES:
        assert len({tuple(licenses.scan(x)) for x in (notice, notice.lower(), notice.upper())}) == 1
        assert [x[2] for x in licenses.scan(notice.upper())] == [name]


def test_several_licenses_together():
    for between in ("\n", " ", "\n\n", f" {prose(3)} "):
        for _ in range(40):
            some = [rng.choice(licenses.TEMPLATES) for _ in range(3)]
            found = licenses.scan(between.join(t for _, t in some))
            assert [x[2] for x in found] == [name for name, _ in some] and all(x[4:] == (0, 0) for x in found), some
    dual = "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."
    assert [x[:3] for x in licenses.scan(dual)] == [(0, 1, "MIT"), (1, 2, "Apache-2.0")]
    inside = licenses.TEMPLATES[6][1].replace("redistribute it", "redistribute it. All rights reserved.")
    assert [x[2] for x in licenses.scan(inside)] == ["GPL-3.0", "All rights reserved"]


def test_wrapped_licenses(spark):
    header = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy was not distributed"
    texts = [header, *(t.replace(" ", "\n") for _, t in licenses.TEMPLATES), *("\n# ".join(t.split()) for _, t in licenses.TEMPLATES)]
    found = {r.doc_id: (r.license, r.first_line, r.end_line) for r in licenses.license_notices(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert found == {i: (name, 0, text.count("\n") + 1) for i, ((name, _), text) in enumerate(zip([("MPL-2.0", ""), *licenses.TEMPLATES, *licenses.TEMPLATES], texts, strict=True))}


#: Wordings of real files, with what they name.
REAL = [
    ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("# SPDX-License-Identifier: MIT", "MIT"), ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"), ("MIT License\n\nCopyright (c) 2020 Some One", "MIT"),
    ("This project is under the MIT license.", "MIT"), ("Licensed under the GNU GPL v3", "GPL-3.0"), ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0"), ("                                 Apache License\n                           Version 2.0, January 2004", "Apache-2.0"),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "MIT OR Apache-2.0"), ("Distributed under the BSD 3-Clause license; see LICENSE.", "BSD-3-Clause"),
    ("Permission to use, copy, modify, and distribute this software for any purpose\nwith or without fee is hereby granted, provided that the above copyright\nnotice and this permission notice appear in all copies.", "ISC"),
]


@pytest.mark.parametrize(("text", "name"), REAL)
def test_real_wordings(text, name):
    assert [x[2] for x in licenses.scan(f"{prose(30)}\n{text}\n{prose(30)}")] == [name]


def test_no_license():
    for text in ("my driving license", "under license from the mayor", "a GPL of sorts", "the apache helicopter", "version 3 of the text", "MIT researchers", "license MIT", "SPDX-License-Identifier: Proprietary"):
        assert licenses.scan(text) == [], text


def test_changed_licenses():
    """Every change within the allowed difference is found, wherever it strikes."""
    for name, notice in licenses.TEMPLATES:
        w = licenses.words(notice)
        for _ in range(60):
            changed, n = list(w), rng.randint(0, licenses.allowed(w, 0.15))
            for _ in range(n):
                if rng.random() < 0.5:
                    changed.pop(rng.choice([i for i, x in enumerate(changed) if not licenses._NAMES.match(x)]))
                else:
                    changed.insert(rng.randint(1, len(changed) - 1), rng.choice(VOCABULARY))
            (one,) = licenses.scan(f"{prose(20)}\n{' '.join(changed)}\n{prose(20)}")
            assert one[2] == name and one[4] + one[5] <= n and one[3] >= 0.15


def test_notices_in_odd_places():
    """Wrapped one word to a line, amid long lines, over a first line without telling words, and with words moved or parted."""
    first = next(t for n, t in licenses.TEMPLATES if t.startswith("Permission is hereby"))
    assert [x[:3] for x in licenses.scan(first.replace(" ", "\n"))] == [(0, len(first.split()), "MIT")]
    assert [x[:3] for x in licenses.scan("\n".join(" ".join(first.split()[i : i + 2]) for i in range(0, 40, 2)))] == [(0, -(-len(first.split()) // 2), "MIT")]
    for text in (f"{prose(300)} Released under the MIT License.", f"Released under the MIT License. {prose(300)}"):
        assert [x[2] for x in licenses.scan(text)] == ["MIT"]
    assert [x[:3] for x in licenses.scan("This work is\nlicensed under the GNU General Public License, version 3.")] == [(0, 2, "GPL-3.0")]
    assert [x[2] for x in licenses.scan(first.replace("is hereby", "hereby is"))] == ["MIT"]
    assert [x[2] for x in licenses.scan("Re-distribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met")] == ["BSD-3-Clause"]


def matches(words, template, differ=0.15):
    """Whether any window is the template but for few words missing or added, all names kept: every window, by longest common subsequences."""
    w = licenses.words(template)
    most = int(differ * len(w) + 1e-9)
    names = sorted(x for x in w if licenses._NAMES.match(x))
    for size in range(max(1, len(w) - most), len(w) + most + 1):
        for at in range(len(words) - size + 1):
            window = words[at : at + size]
            if sorted(x for x in window if licenses._NAMES.match(x)) != names:
                continue
            row = [0] * (size + 1)
            for x in w:
                last, row = row, [0]
                for j, y in enumerate(window):
                    row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
            if len(w) + size - 2 * row[-1] <= most:
                return True
    return False


def test_no_notice_is_lost():
    own = random.Random(8)
    for _ in range(120):
        name, template = own.choice(licenses.TEMPLATES)
        w = licenses.words(template)
        for _ in range(own.randint(0, 3)):
            at = own.randrange(len(w))
            if own.random() < 0.5 and len(w) > 1 and not licenses._NAMES.match(w[at]):
                w.pop(at)
            else:
                w.insert(at, own.choice(["zeta", "the", "of", "eta"]))
        text = [own.choice(["alpha", "beta", "the", "license", "of"]) for _ in range(own.randint(0, 6))] + w + [own.choice(["alpha", "beta"]) for _ in range(own.randint(0, 6))]
        found = licenses.scan(" ".join(text))
        if matches(text, template):
            assert found, (text, template)
        for *_, missing, added in found:
            assert missing + added <= 0.15 * 60
    assert matches(licenses.words("x " + licenses.TEMPLATES[2][1]), licenses.TEMPLATES[2][1]) and not matches(["license"] * 9, licenses.TEMPLATES[0][1])


def test_personal_data(spark, none):
    text = "mail a.b@x.com or a@b, ip 10.0.0.1 and 300.1.1.1, card 4111 1111 1111 1111 not 4111 1111 1111 1112, call +1 (555) 010-9999 password=abc123def456"
    base = [(pii.KINDS[k], text[s:e]) for s, k, e in pii.base_spans(text)]
    assert base == [("email", "a.b@x.com"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 010-9999")]
    docs = spark.createDataFrame([(1, text), (2, None), (3, "nothing here")], SCHEMA)
    rows = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert set(rows[1].base.split(",")) <= set(rows[1].spans.split(",")) and any(x.startswith("secret") for x in rows[1].spans.split(","))
    assert rows[2].spans == rows[3].spans == ""
    assert "abc123def456" not in {r.doc_id: r.text for r in pii.redacted(docs).collect()}[1]
    assert pii.personal_data(none).count() == 0 and pii.personal_data(odd(spark)).count() == 5


def test_secrets_in_any_case(spark):
    for key in ("password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "apikey"):
        for name in (key, key.upper(), key.title()):
            text = f'{prose(4)} {name} = "9233a8ec51f7" {prose(4)}'
            assert [(pii.KINDS[k], text[s:e]) for s, k, e in pii.further_spans(text, [])] == [("secret", f'{name} = "9233a8ec51f7"')]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lower(text) rlike 'token = \"[0-9a-f]{40}\"'")
    planted = [(r.doc_id, m.start(), m.end()) for r in docs.collect() for m in re.finditer('(?i)token = "[0-9a-f]{40}"', r.text)]
    assert len(planted) == 166 and any(r.text and 'TOKEN = "' in r.text for r in docs.collect())
    spans = [(r.doc_id, *map(int, x.split(":")[1:])) for r in pii.personal_data(docs).collect() for x in r.spans.split(",") if x.startswith("secret")]
    for doc, s, e in planted:
        assert any(doc == d and a <= s and e <= b for d, a, b in spans)


def plain_base(text):
    """The base patterns as they are given, by the regular expression engine alone."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        twice = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and twice % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_patterns():
    own = random.Random(11)
    bits = ["a@b.c", "@", ".", "..", "-", "1.2.3.4", "255", "256", "+1 (555) 123-4567", "378282246310005", "4111 1111 1111 1111", "x_y%z@q-r.s.t", "é", " ", "\n", "12", "0001.2.3.4", "+", "(", "a", "7-7"]
    for _ in range(4000):
        text = "".join(own.choice(bits) for _ in range(own.randint(0, 9)))
        assert pii.base_spans(text) == plain_base(text), text
    for _ in range(4000):
        text = "".join(own.choice("1230.@a-+ (") for _ in range(own.randint(0, 40)))
        assert pii.base_spans(text) == plain_base(text), text


def test_long_texts_take_time_in_proportion():
    import time

    for text in ("1" * 1_000_000, "a" * 1_000_000 + "@", "1." * 500_000, "1" * 500_000 + "...1.1.1", "a@b." * 250_000, "+1(" * 300_000, "378282246310005 " * 60_000):
        began = time.monotonic()
        pii.further_spans(text, pii.base_spans(text))
        assert time.monotonic() - began < 10


def test_redaction_of_spans_that_share_characters(spark):
    rows = [(1, "+378282246310005 tail text"), (1, "mail a@b.example.org now"), (None, "1.2.3.4"), (2, None), (3, "")]
    found = pii.redacted(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted("-" if r.text is None else r.text for r in found) == sorted(["<phone> tail text", "mail <email> now", "<ip>", "-", ""])
    assert pii.redacted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_base_spans_in_the_query(spark):
    from weftline.llm.queries import QUERIES

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op8_pii"](spark, "/root/testdata/sf0.001").collect():
        base = plain_base(docs[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_top_k(spark):
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(700)]
    rows += [(700, None), (701, [float("nan")] * 8), (702, [None] * 8), (703, rows[3][1]), (None, rows[0][1]), (704, [1e30] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(vectors, vectors.vec_id % 50 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score)) if r.vec_id != 704 else None
    import math

    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and i < 704 and v and all(x is not None and x == x for x in v)}
    expected = {}
    for q in [i for i in whole if i % 50 == 0]:
        expected[q] = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
    for q, best in expected.items():
        mine = [(-s, i) for _, i, s in sorted(got[q])]
        assert mine == best[: len(mine)] and len(mine) >= 4
    assert topk.top_k(vectors.limit(0), vectors.vec_id % 50 == 0).count() == 0


def test_top_k_with_columns_that_clash(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    odd = vectors.selectExpr("*", "1 as id", "2 as v", "3 as asks", "4 as lot", "5 as place", "6 as score", "7 as rank")
    of = lambda frame: sorted(map(tuple, topk.top_k(frame, frame.vec_id % 50 == 0, k=5).collect()))
    assert of(odd) == of(vectors) and len(of(odd)) == 10


@pytest.mark.parametrize(("n", "lot", "scale"), [(3, 1 << 20, 1), (900, 1 << 20, 1), (900, 300, 1), (400, 1 << 20, 2**24), (120, 1 << 20, 2.0**200)])
def test_top_k_in_lots_with_ties_and_repeated_rows(spark, monkeypatch, n, lot, scale):
    monkeypatch.setattr(topk, "BLOCK", 16)
    own = random.Random(n)
    rows = [(i, [own.choice([-1.0, 0.0, 0.5, 2.0]) * scale for _ in range(own.randint(3, 4))]) for i in range(n)] + [(0, [float(scale)] * 3), (n // 2, [0.5 * scale] * 4), (n // 2, [0.5 * scale] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = {}
    for r in topk.top_k(vectors, vectors.vec_id % 50 == 0, k=5, lot=lot).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints = [(i, [int(256 * x) for x in v]) for i, v in rows]
    for q in {i for i, _ in rows if i % 50 == 0}:
        clamped = lambda x: min(max(x, -(2**63)), 2**63 - 1)
        pairs = sorted((-clamped(sum(a * b for a, b in zip(u, v))), i) for j, u in ints if j == q for i, v in ints if i != q)[:5]
        assert sorted(found.get(q, [])) == [(r + 1, i, -s) for r, (s, i) in enumerate(pairs)], q


def plain_hits(text, items, span=10):
    """(n_words, n_hit, n_items, digest of the items) of one document, window by window."""
    parted = lambda t: [w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    words, hit, own = parted(text), set(), []
    for item, body in items.items():
        w = parted(body)
        size = min(span, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        at = [p for p in range(len(words) - size + 1) if tuple(words[p : p + size]) in windows] if size else []
        hit.update(x for p in at for x in range(p, p + size))
        own += [item] * bool(at)
    return len(words), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()


@pytest.mark.parametrize("most", [10**6, 25])
def test_contamination(spark, docs, none, most):
    """With one block for all workers, and with many blocks joined by a shuffle, parts of them small."""
    base = corpus()[0][1].split()
    items = {"b1": " ".join(base[10:25]), "b2": "one two", "b3": "", "b4": prose(30), "b5": " ".join(base[:80]), "b6": "a " * 40, "b7": " ".join(base[10:25]).upper(), "b8": "w1", "b9": "É\tÀ x ist gut"}
    table = spark.createDataFrame([*items.items(), ("b5", None), (None, base[0]), ("b4", "w7 w9")], "item_id string, text string")
    assert "w7 w9" not in items["b4"]
    rows = corpus() + [(200, "x " + "a " * 30), (201, "a " * 9), (202, " ".join(base[15:22] + ["q"] + base[22:25])), (203, "é à x IST gut"), (204, "É À x ist gut")]
    rows += [(300 + i, f"{i} " + " ".join(base[i : i + 9 + i % 3]) + " end") for i in range(0, 100, 3)]
    expected = {i: plain_hits(t, items) for i, t in rows}
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    extra = {i for i, t in rows if re.search(r"(?<!\S)w7 w9(?!\S)", t or "")}
    found = decontam.digest(decontam.contamination(frame, table, block_words=most, part=5)).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in found if r.doc_id not in extra} == {i: x for i, x in expected.items() if i not in extra}
    assert decontam.contamination(none, table, block_words=most).count() == 0
    assert decontam.contamination(odd(spark), table.limit(0), block_words=most).where("size(runs) > 0").count() == 0
    twice = decontam.contamination(odd(spark).union(odd(spark)), spark.createDataFrame([("i", "words here again")], "item_id string, text string"), block_words=1 if most == 25 else most)
    assert sorted(r.runs for r in twice.collect()) == [[]] * 4 + [[1, 4]] * 6


def test_fingerprints_on_random_words():
    """Every window that is shared is found, whatever repeats there are."""
    own = random.Random(5)
    for _ in range(400):
        letters = "ab" if own.random() < 0.5 else "abcdef"
        items = {f"i{k}": " ".join(own.choice(letters) for _ in range(own.randint(0, 25))) for k in range(4)}
        index = decontam.Items(list(items.items()), 6, 3)
        for _ in range(5):
            text = " ".join(own.choice(letters) for _ in range(own.randint(0, 40)))
            words = decontam.words_of(text)
            runs, names = index.hits(words, decontam.WordHashes().of(words)) if words else ([], set())
            plain = plain_hits(text, items, 6)
            assert (sum(b - a for a, b in runs), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()) == (plain[1], plain[3])


def test_very_long_texts(spark, tokenizer):
    """One text of 600 kilobytes in one line, its copy, one without spaces, and lines by the thousand, through every operator."""
    own = random.Random(2)
    long = " ".join(own.choice(VOCABULARY) for _ in range(130_000))
    rows = [(1, long), (2, long), (3, "x" * 300_000), (4, "\n".join(f"line {i % 900} of a text with words w{i % 7}" for i in range(6000))), (5, "7" * 200_000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    near = {r.doc_id: (r.component_id, r.kept) for r in near_dup.near_duplicates(docs, k=4, percent=80).collect()}
    assert near == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True), 5: (5, True)}
    pieces = packing.packed(docs, tokenizer, size=2048, end=0).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4, 5} and all(r.length <= 2048 for r in pieces)
    assert {r.doc_id: list(r.removed) for r in lines.line_matches(docs).collect()} == plain_lines(rows)
    assert licenses.license_notices(docs).count() == 0
    assert {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}[1] == ""
    hit = {r.doc_id: r.runs for r in decontam.contamination(docs, spark.createDataFrame([("i", long[3000:3200])], "item_id string, text string")).collect()}
    assert len(hit[1]) == 2 and hit[1] == hit[2] and not hit[3] and not hit[4]
    gone = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeats.repeated_spans(docs).collect()}
    assert gone[1] == (len(long), 0) and gone[2] == (len(long), len(long)) and gone[3][1] == gone[5][1] == 0
    assert {r.doc_id: r["size"] for r in sharding.assign_shards(docs).collect()}[1] == len(long) + 1
    assert all(0 <= r.score <= 1 for r in quality.scored(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")).collect())
