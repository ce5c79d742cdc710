"""Documents rearranged for filling in the middle, by cutting and joining ropes.

A rope is a balanced tree over pieces of a text. Each leaf knows how many units (a run of A-Z and a-z, or any other single
code point) and how many code points it holds, each inner node the sums below it. A text is cut at two unit ranks by
walking down the tree, so only one leaf a cut is looked into; the parts are joined in their new order with sentinels
between, and the way back cuts the tree of the output at the code-point ranks of its sentinels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weftline.llm.common import batches

#: Code points of a leaf; a run of letters that begins in a leaf ends in it, however long.
LEAF = 4096
#: Begin of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of text that are worked on at a time.
PIECE = 16 << 20
_LETTERS = re.compile("[A-Za-z]*")


@dataclass(frozen=True, slots=True)
class Rope:
    units: int
    chars: int
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None


def unit_starts(text: str) -> np.ndarray:
    """Where units begin, as code-point offsets."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = ((code | 32) - np.uint32(97)) < 26
    begins = ~letter
    begins[1:] |= ~letter[:-1]
    begins[:1] = True
    return np.flatnonzero(begins)


def leaf(text: str) -> Rope:
    return Rope(len(unit_starts(text)), len(text), text)


EMPTY = Rope(0, 0)


def joined(left: Rope, right: Rope) -> Rope:
    if not left.chars or not right.chars:
        return left if left.chars else right
    return Rope(left.units + right.units, left.chars + right.chars, "", left, right)


def rope(text: str, size: int = LEAF) -> Rope:
    """A balanced rope whose leaves begin where units do."""
    leaves, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if _LETTERS.fullmatch(text[end - 1]):
            end = _LETTERS.match(text, end).end()
        leaves.append(leaf(text[at:end]))
        at = end
    while len(leaves) > 1:
        leaves = [joined(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else EMPTY


def split(tree: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first `rank` units (or, by "chars", code points) of a rope, and the rest."""
    if rank <= 0:
        return EMPTY, tree
    if rank >= getattr(tree, by):
        return tree, EMPTY
    if tree.left is None:
        at = int(unit_starts(tree.text)[rank]) if by == "units" else rank
        return leaf(tree.text[:at]), leaf(tree.text[at:])
    of_left = getattr(tree.left, by)
    if rank < of_left:
        first, rest = split(tree.left, rank, by)
        return first, joined(rest, tree.right)
    first, rest = split(tree.right, rank - of_left, by)
    return joined(tree.left, first), rest


def text_of(tree: Rope) -> str:
    parts, todo = [], [tree]
    while todo:
        node = todo.pop()
        if node.left is None:
            parts.append(node.text)
        else:
            todo += [node.right, node.left]
    return "".join(parts)


def rearranged(tree: Rope, marks: tuple[int, int], form: str) -> tuple[Rope, int, int]:
    """The output of a text cut at two unit ranks, with the code points of its prefix and its middle."""
    before, rest = split(tree, min(marks))
    middle, after = split(rest, max(marks) - min(marks))
    p, s, m = map(leaf, SENTINELS)
    order = (s, after, p, before, m, middle) if form == "spm" else (p, before, s, after, m, middle)
    out = EMPTY
    for part in order:
        out = joined(out, part)
    return out, before.chars, middle.chars


def original(output: str, form: str) -> str:
    """The text that an output was made of. No sentinel can begin inside another or across the end of a text without sentinels, so the first of each is the one put there."""
    if form == "plain":
        return output
    first, second, last = (SENTINELS[i] for i in ((1, 0, 2) if form == "spm" else (0, 1, 2)))
    cuts, tree = (output.index(second), output.index(last)), rope(output)
    _, tree = split(tree, len(first), "chars")
    one, tree = split(tree, cuts[0] - len(first), "chars")
    _, tree = split(tree, len(second), "chars")
    two, tree = split(tree, cuts[1] - cuts[0] - len(second), "chars")
    _, middle = split(tree, len(last), "chars")
    before, after = (two, one) if form == "spm" else (one, two)
    return text_of(joined(joined(before, middle), after))


def draws(id_col: str, seed: int) -> list[Column]:
    """Four numbers of 32 bits for a row: the first groups of eight digits of the sha256 of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 1, apply_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output) for each row of docs.

    n counts the text's units; two of the n + 1 places between them, drawn from the id, bound the middle. form is `psm`
    (prefix, suffix, middle), `spm` (suffix first) or `plain`: the text as it is, where it is empty or null, holds a
    sentinel, or was not drawn. A null id draws as the empty text would. Repeated rows come out repeatedly, an empty
    table gives no rows, other columns are not looked at. A row is worked on where it is; nothing is shuffled.
    """

    def put(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, stop in batches(rows, PIECE):
            part = batch.slice(at, stop - at)
            made = []
            for text, h1, h2, h3, h4 in zip(*(part.column(i).to_pylist() for i in range(1, 6)), strict=True):
                tree = rope(text)
                n, form = tree.units, "spm" if h4 % 100 < spm_percent else "psm"
                if h3 % 100 >= apply_percent or not text or any(mark in text for mark in SENTINELS):
                    made.append((n, "plain", None, None, text))
                    continue
                tree, prefix, middle = rearranged(tree, (h1 % (n + 1), h2 % (n + 1)), form)
                made.append((n, form, prefix, middle, text_of(tree)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*made, strict=True), kinds, strict=True))], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *draws(id_col, seed))
    made = rows.mapInArrow(put, f"id {rows.schema['id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restored(made: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """made with `restored`: the text rebuilt from output and form alone; null where either is null. All columns stay, one named `restored` is replaced."""
    made = made.drop("restored")

    def back(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                pairs = zip(batch.column(batch.schema.get_field_index(output_col)).to_pylist(), batch.column(batch.schema.get_field_index(form_col)).to_pylist(), strict=True)
                yield batch.append_column("restored", pa.array([None if x is None or form is None else original(x, form) for x, form in pairs], pa.string()))

    return made.mapInArrow(back, StructType([*made.schema.fields, StructField("restored", StringType())]))
