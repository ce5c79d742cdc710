"""Conversations formatted and replayed: plain restatements over whole lists, and the queries beside SQL or the restatement."""

import hashlib
import random
from zlib import crc32

import pytest
from twins import compared, connected

from weftline.llm import chat, replay
from weftline.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn int, role string, text string"
CONTROLS = ["[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[/ROLE]", "[TURN]", "[IMAGE]", "[\\IMAGE]", "<\\s>", "<\\\\/s>", "[[INST]", "<<s>", "[s>", "\\", "[", "<"]
rng = random.Random(5)


def odd(n=400, convs=23, hot=None):
    """Conversations of any length, with nulls, empty texts, repeated turns, control strings and roles that no mark knows; the first may be much longer than the others."""
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool]", None]), rng.choice([None, "", "é" + rng.choice(CONTROLS) * 2 + "x", "plain", "\n" + rng.choice(CONTROLS)])) for c, t in ((rng.choice([None, *range(convs)]), rng.randrange(12)) for _ in range(n))]
    rows += rows[:5] + [(7, None, "user", "no turn")]
    return rows + [(-9, t, "user", f"long {t}") for t in range(hot or 0)]


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("text", CONTROLS + ["".join(rng.choice(CONTROLS) for _ in range(30)) for _ in range(20)])
def test_escapes(text):
    shown = chat.escaped(text)
    assert chat.unescaped(shown) == text and not any(x in shown for x in ("[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[/ROLE]", "[TURN]", "[IMAGE]"))


def test_formatted(spark):
    rows = odd()
    messages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as piece", "2 as part", "3 as start").repartition(5)
    from pyspark.sql import functions as F

    pieces = chat.formatted(messages.withColumn("parts", chat.text_parts(F.col("text"))))
    found = pieces.collect()
    assert len(found) == len(rows)
    told = {r.conv_id: r for r in chat.digests(pieces).collect()}
    groups = by_conversation(rows)
    assert told.keys() == groups.keys()
    for conv, own in groups.items():
        mine = sorted((r for r in found if r.conv_id == conv), key=lambda r: r.start)
        whole = "".join(r.piece for r in mine)
        assert [r.start for r in mine] == [sum(x.chars for x in mine[:i]) for i in range(len(mine))]
        # Turns are read back from the whole text, in order of turn and role, whatever its pieces.
        reader, turns = chat.Reader(), []
        for i in range(0, len(whole), 7):
            turns += reader.feed(whole[i : i + 7])
        reader.close()
        key = lambda r: (-1 if r[1] is None else r[1], r[2] or "")
        assert sorted(turns) == sorted((r[2] or "", r[3] or "") for r in own)
        assert [x[0] for x in turns] == [key(r)[1] for r in sorted(own, key=key)]
        learned = [chat.unescaped(whole[r.loss.start : r.loss.end]) for r in mine if r.loss]
        assert learned == [text for role, text in turns if role == "assistant"]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert told[conv][1:] == (len(own), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len("".join(learned)), sha("".join(learned)), len(whole))
    none = chat.formatted(messages.where("false").withColumn("parts", chat.text_parts(F.col("text"))))
    assert none.collect() == [] and chat.digests(none).collect() == []
    broken = chat.Reader()
    assert list(broken.feed("odd")) == []
    with pytest.raises(ValueError, match="no turn"):
        broken.close()


def test_parts(spark):
    """Images, sounds and documents in order, with references and the tokens that they expand to; unknown kinds and missing sizes."""
    part = lambda kind, text=None, ref=None, **n: {"kind": kind, "text": text, "ref": ref, "width": None, "height": None, "seconds": None, "pages": None} | n
    sent = [part("text", "see [IMAGE] "), part("image", ref="a.png", width=57, height=28), part("audio", ref="b.wav", seconds=1.5), None, part("text", "é"), part("document", ref="c.pdf", pages=3), part("clip", ref="d"), part("image"), part("text")]
    rows = [(1, 0, "user", sent), (1, 1, "assistant", [part("text", "ok")]), (1, 2, "user", None), (1, 3, "critic", [part("image", ref="x", width=1, height=1)])]
    pieces = chat.formatted(spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat.PART}>")).orderBy("start").collect()
    assert [r.piece for r in pieces] == ["[INST]see [\\IMAGE] [IMAGE][AUDIO]é[DOCUMENT][FILE][IMAGE][/INST]", "<s>ok</s>", "[INST][/INST]", "[ROLE]critic[/ROLE][IMAGE][/TURN]"]
    first = pieces[0]
    assert [(a.kind, a.ref, a.tokens) for a in first.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 768), ("clip", "d", 1), ("image", None, 1)]
    assert all(first.piece[a.at :].startswith(chat.PLACEHOLDERS.get(a.kind, "[FILE]")) for a in first.attachments) and [r.expanded for r in pieces] == [811, 0, 0, 1]
    whole = [p | {} for p in sent if p and p["kind"] != "text"]
    role, parts = chat.parts_of(first.piece, [a.asDict() for a in first.attachments])
    assert role == "user" and [p for p in parts if p["kind"] == "text"] == [{"kind": "text", "text": "see [IMAGE] "}, {"kind": "text", "text": "é"}]
    assert [(p["kind"], p["ref"]) for p in parts if p["kind"] != "text"] == [(p["kind"], p["ref"]) for p in whole]
    assert [(r.loss.start, r.loss.end) if r.loss else None for r in pieces] == [None, (first.chars + 3, first.chars + 5), None, None]


def plainly(rows):
    """Every turn's outcome from whole conversations in memory, and the release order from a sort of them."""
    out = []
    h = lambda k, c, t: crc32(f"{k}:{'' if c is None else c}:{'' if t is None else t}".encode())
    for conv, own in by_conversation(rows).items():
        own = sorted(own, key=lambda r: (-1 if r[1] is None else r[1], r[2] is not None, r[2] or "", crc32((r[3] or "").encode())))
        told = []
        for p, (_, turn, _, text) in enumerate(own):
            d, arrival = h(0, conv, turn) % 5, 7 * p
            parent = told[p - d] if 0 < d <= p else None
            if parent and parent["status"] != "delivered":
                told.append({"turn": turn, "status": "blocked", "n": 0, "first": None, "last": None})
                continue
            at = first = max(arrival, parent["last"]) if parent else arrival
            faulty, repair, n = h(1, conv, turn) % 101 < 50, arrival + h(2, conv, turn) % 101, 1
            while faulty and (at < repair or h(n + 2, conv, turn) % 3 == 0) and n <= 6:
                if n == 6:
                    n = 7
                    break
                at, n = at + 20 * 2 ** (n - 1), n + 1
            told.append({"turn": turn, "status": "dead" if n == 7 else "delivered", "n": min(n, 6), "first": first, "last": at, "crc": crc32((text or "").encode()), "p": p})
        sent = sorted((x for x in told if x["status"] == "delivered"), key=lambda x: (x["last"], -1 if x["turn"] is None else x["turn"], x["p"]))
        state = 0
        for i, x in enumerate(sent, 1):
            state += i * x["crc"]
            x |= {"no": i, "state": (state + 2**63) % 2**64 - 2**63}
        out += [(conv, x["turn"], x["status"], x["n"], x["first"], x["last"], x.get("no"), x.get("state")) for x in told]
    return sorted(map(repr, out))


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_replayed(spark, parts):
    """One conversation holds most rows, so it lies in many partitions; with 40 of them most hold but a few turns of it, or none."""
    rows = odd(300, hot=3_000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        given = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "2 as no", "3 as p").repartition(3)
        found = replay.replayed(given).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(repr(tuple(r)) for r in found) == plainly(rows)
    assert {r.status for r in found} == {"delivered", "dead", "blocked"}


def test_long_states_and_empty(spark):
    """Sums beyond 64 bits are taken modulo 2^64."""
    rows = [(1, t, "user", f"text {t}") for t in range(120_000)]
    given = spark.createDataFrame(rows, SCHEMA)
    assert sorted(repr(tuple(r)) for r in replay.replayed(given).collect()) == plainly(rows)
    none = replay.replayed(given.where("false"))
    assert none.collect() == [] and none.columns == ["conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state"]


def test_replay_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(repr(tuple(r)) for r in QUERIES["op13_quarantine_release"](spark, SF).collect()) == plainly(rows)


def test_chat_query(spark):
    assert compared(spark, connected(SF), "op12", QUERIES["op12_chat_formatting"], ORACLE_SQL["op12_chat_formatting"], SF) is None


@pytest.mark.parametrize("name", ["op3_sharding", "op13_quarantine_release"])
def test_queries_with_checksums(spark, name):
    assert compared(spark, connected(SF), name, QUERIES[name], ORACLE_SQL[name], SF) is None
