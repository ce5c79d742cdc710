"""Conversations as text that a model is trained on: typed parts flattened in order, turns marked, control strings escaped.

A visitor goes through the parts of a message. Text is escaped; an image, a sound or a document leaves a placeholder and is
recorded with its reference and the tokens that the placeholder expands to. The text of a conversation is kept as one piece
for each turn with its place in the whole, so formatting needs no conversation in one task.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import stored
from weftline.llm.ordered import boundaries, continued, earlier, in_order

#: What stands before and after the text of a turn; any other role is named in the mark.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
PLACEHOLDERS = {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]"}
#: A control string, with any number of backslashes after its bracket; an escaped one has one more.
CONTROL = r"([\[<])(\\*)(/?(?:SYS|INST|ROLE|TURN|IMAGE|AUDIO|DOCUMENT|FILE)\]|/?s>)"
_CONTROL, _ESCAPED = re.compile(CONTROL), re.compile(CONTROL.replace(r"(\\*)", r"\\(\\*)", 1))
_TURN = re.compile(r"\[SYS\](?P<system>.*?)\[/SYS\]|\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|\[ROLE\](?P<name>.*?)\[/ROLE\](?P<other>.*?)\[/TURN\]", re.S)
PART = "struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
ATTACHMENT = "struct<at:bigint,kind:string,ref:string,tokens:bigint>"
_ATTACHMENTS = pa.list_(pa.struct([("at", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def escaped(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


class Flattened:
    """Visits the parts of a message in order: `text` has escaped text and placeholders, `attachments` what these stand for.

    An image expands to one token for each square of `patch` points it covers, a sound to `rate` tokens a second, a
    document to `page` tokens a page, each to one at least; a part of another kind to one.
    """

    def __init__(self, patch: int = 28, rate: float = 25.0, page: int = 256):
        self.patch, self.rate, self.page = patch, rate, page
        self._texts: list[str] = []
        self._at = 0
        self.attachments: list[dict] = []

    @property
    def text(self) -> str:
        return "".join(self._texts)

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part['kind']}", self.visit_file)(part)

    def _put(self, text: str) -> None:
        self._texts.append(text)
        self._at += len(text)

    def _attach(self, part: dict, tokens: float) -> None:
        kind = part["kind"]
        self.attachments.append({"at": self._at, "kind": kind, "ref": part.get("ref"), "tokens": max(1, math.ceil(tokens))})
        self._put(PLACEHOLDERS.get(kind, "[FILE]"))

    def visit_text(self, part: dict) -> None:
        self._put(escaped(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach(part, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, (part.get("seconds") or 0) * self.rate)

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part.get("pages") or 0) * self.page)

    def visit_file(self, part: dict) -> None:
        self._attach(part, 1)


def text_parts(text: Column) -> Column:
    """A message of one text part, for tables whose messages are plain texts."""
    none = {"kind": F.lit("text"), "text": text}
    return F.array(F.struct(*[none.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in (x.split(":") for x in PART[7:-1].split(","))]))


def formatted(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", *, learn: tuple[str, ...] = ("assistant",),
    patch: int = 28, rate: float = 25.0, page: int = 256,
) -> DataFrame:
    """(conv_col, turn_col, start, chars, piece, loss, attachments, expanded) for each message.

    A conversation's text is its pieces in the order of start, the code points before a piece. loss (start, end) is the span
    of the whole text that is learned, null for roles not in `learn`; attachments have their place in the piece.
    Messages of a conversation go by (turn, role, checksum of the piece), nulls first; repeated messages are all kept. A
    null conversation is one too, a null role is an empty name, null parts are none. An empty table gives no rows; other
    columns are not looked at. Messages are formatted where they are, and ordered over range partitions.
    """

    def put(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            made = []
            for role, parts in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                flat = Flattened(patch, rate, page)
                for part in parts or ():
                    flat.visit(part)
                before, after = MARKS.get(role) or (f"[ROLE]{escaped(role)}[/ROLE]", "[/TURN]")
                text = flat.text
                piece, span = before + text + after, (len(before), len(before) + len(text)) if role in learn else (None, None)
                held = [x | {"at": x["at"] + len(before)} for x in flat.attachments]
                made.append((piece, len(piece), *span, held, sum(x["tokens"] for x in held)))
            if made:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), _ATTACHMENTS, pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, k) for x, k in zip(zip(*made, strict=True), kinds, strict=True))], [*batch.schema.names[:3], "piece", "chars", "low", "high", "attachments", "expanded"])

    def summed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the code points of a conversation's pieces in this partition, up to and with each."""
        last, no = object(), 0
        for batch in rows:
            sums = []
            for conv, chars in zip(batch.column("conv").to_pylist(), batch.column("chars").to_pylist(), strict=True):
                no = chars if conv != last else no + chars
                last = conv
                sums.append(no)
            yield batch.append_column("no", pa.array(sums, pa.int64()))

    given = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.col(parts_col).cast(f"array<{PART}>").alias("parts"))
    head = ", ".join(f"{c} {given.schema[c].dataType.simpleString()}" for c in ("conv", "turn", "role"))
    body = f"piece string, chars long, low long, high long, attachments array<{ATTACHMENT}>, expanded long"
    pieces = given.mapInArrow(put, f"{head}, {body}").withColumn("crc", F.crc32(F.col("piece").cast("binary")))
    ordered = in_order(pieces, "conv", "turn", "role", "crc").drop("crc")
    kept = stored(ordered.mapInArrow(summed, f"{head}, {body}, part int, no long"), "pieces")
    ends = boundaries(kept, "conv").withColumn("before", F.coalesce(F.sum("no").over(earlier("conv")), F.lit(0)))
    carried = stored(ends.where("kind = 0").select("part", "conv", "before"), "piece-ends")
    start = F.expr("no - chars + coalesce(before, 0)")
    found = continued(kept, carried, "conv").withColumn("start", start)
    loss = F.when(F.col("low").isNotNull(), F.struct((F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high")).alias("end")))
    return found.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), "start", "chars", "piece", loss.alias("loss"), "attachments", "expanded")


class Reader:
    """Reads turns back from the text of a conversation, which comes in pieces of any length; holds what is not yet a whole turn."""

    def __init__(self):
        self._rest = ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns that are whole now, escapes undone; placeholders stay."""
        self._rest += text
        at = 0
        while found := _TURN.match(self._rest, at):
            named = found["name"] is not None
            role = unescaped(found["name"]) if named else found.lastgroup
            yield role, unescaped(found["other"] if named else found[role])
            at = found.end()
        self._rest = self._rest[at:]

    def close(self) -> None:
        if self._rest:
            raise ValueError(f"no turn: {self._rest[:40]}")


def parts_of(piece: str, attachments: list[dict]) -> tuple[str, list[dict]]:
    """The role and the parts of a message, from its piece and what its placeholders stand for; texts between placeholders are one part each."""
    found = _TURN.fullmatch(piece)
    named = found["name"] is not None
    role, at, end = (unescaped(found["name"]) if named else found.lastgroup), found.start("other" if named else found.lastgroup), found.end("other" if named else found.lastgroup)
    parts = []
    for held in [*attachments, None]:
        text = piece[at : held["at"] if held else end]
        if text:
            parts.append({"kind": "text", "text": unescaped(text)})
        if held:
            parts.append({"kind": held["kind"], "ref": held["ref"]})
            at = held["at"] + len(PLACEHOLDERS.get(held["kind"], "[FILE]"))
    return role, parts


def digests(pieces: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the text and the mask of each conversation.

    A digest runs through a conversation from its beginning to its end, so the pieces of one pass through one task, one
    after the other; what is held is one turn.
    """

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None

        def told() -> list:
            conv, reader, turns, n, loss, lost, size = state
            reader.close()
            return [conv, n, turns.hexdigest(), lost, loss.hexdigest(), size]

        for batch in rows:
            made = []
            for conv, start, low, high, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != last or state is None:
                    if state:
                        made.append(told())
                    last, state = conv, [conv, Reader(), hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in state[1].feed(piece):
                    state[2].update(f"{role}\n{text}\n".encode())
                    state[3] += 1
                if low is not None:
                    text = unescaped(piece[low - start : high - start])
                    state[4].update(text.encode())
                    state[5] += len(text)
                state[6] += len(piece)
            if made:
                yield _told(made, batch.schema.field(0).type)
        if state:
            yield _told([told()], batch.schema.field(0).type)

    def _told(made: list, key: pa.DataType) -> pa.RecordBatch:
        kinds = (key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made, strict=True), kinds, strict=True)], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.select(F.col(conv_col).alias("conv"), "start", F.col("loss.start").alias("low"), F.col("loss.end").alias("high"), "piece").repartition(n, "conv").sortWithinPartitions("conv", "start")
    found = rows.mapInArrow(read, f"conv {rows.schema['conv'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return found.withColumnRenamed("conv", conv_col)
