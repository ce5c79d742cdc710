"""Filling in the middle: ropes against plain lists of units, and the query beside its SQL."""

import hashlib
import random
import re

import pytest
from twins import compared, connected

from weftline.llm import fim
from weftline.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
UNITS = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)
rng = random.Random(3)
TEXTS = ["", "a", "é", "ab cd", "  ", "x" * 20_000, "a\U0001f600b\n\r c", "word " * 5_000, "".join(rng.choice("abé <P>SM\n") for _ in range(9_000)), "<", "a<P", "<S", "<M>"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("size", [1, 7, 4096])
def test_ropes(text, size):
    units = UNITS.findall(text)
    tree = fim.rope(text, size)
    assert (tree.units, tree.chars, fim.text_of(tree)) == (len(units), len(text), text)
    for rank in {0, 1, len(units) // 3, len(units) - 1, len(units), len(units) + 5}:
        first, rest = fim.split(tree, rank)
        left = "".join(units[: max(rank, 0)])
        assert (fim.text_of(first), fim.text_of(rest)) == (left, text[len(left) :])
        assert (first.units, rest.units, first.chars) == (len(UNITS.findall(left)), len(units) - first.units, len(left))
    for rank in {0, 1, len(text) // 2, len(text)}:
        first, rest = fim.split(tree, rank, "chars")
        assert (fim.text_of(first), fim.text_of(rest)) == (text[:rank], text[rank:])


def plain(i, text, seed=1):
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text


def test_rows(spark):
    """Nulls, empty and very long texts, sentinels and parts of them, repeated rows, a column that clashes."""
    rows = [(100 * k + i, text) for i, text in enumerate(TEXTS) for k in range(6)] + [(None, "a b"), (7, None), (7, "same"), (7, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as output", "3 as restored")
    found = fim.restored(fim.fill_in_middle(docs)).collect()
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(repr((i, *plain(i, text))) for i, text in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    empty = fim.restored(fim.fill_in_middle(docs.where("false")))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    # The way back looks at output and form alone.
    assert fim.restored(spark.createDataFrame([("<S>c<P>a<M>b", "spm", 1), (None, "psm", 2), ("x", None, 3)], "output string, form string, restored int")).select("restored").collect() == [("abc",), (None,), (None,)]


def test_query(spark):
    assert compared(spark, connected(SF), "op11", QUERIES["op11_fill_in_middle"], ORACLE_SQL["op11_fill_in_middle"], SF) is None
