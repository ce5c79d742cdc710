"""Removal of lines that match earlier lines, as an exact set-similarity join in DataFrame operations.

A line is the set of its words. Lines with equal sets are one set, kept where it is first. Two sets match if
100 * |intersection| >= percent * |union|.

* Rarity. How often words occur over all lines is counted by word hash in a table of fixed size, so that it can go to
  every task as a constant; words sort by (count of their cell, hash), one order for the whole corpus.
* Prefix. Matching sets of t words share one of the first t - ceil(t * percent / 100) + 1 words in that order; only those
  meet in the join.
* Position and length. The join passes a pair only if the sizes and what is left behind the shared word allow the overlap.
* A bitmap of 64 word parities bounds the symmetric difference from below and drops nearly all other pairs.
* With the whole set at hand, the bitmap is one of 128 parities, which lets next to nothing but near misses through.
* Verification, in two rounds of a join with order and exact Jaccard in its condition. First each line with any partner
  comes once, with its whole set, under the rarest of its words that passed. Then lines without an earlier match meet,
  under all their words, only those earlier lines that pass with them and came under another word before.

All joins are semi joins: they say that a partner exists and never make a row for a pair, so a family of a thousand
variants of a line costs comparisons, not rows. Sort-merge joins spill, and skewed words are split at run time.

Rows are told apart by (id, 64-bit hash of the text), which is the same however often and in whatever order the input is
read; nothing hangs on row numbers. Words are compared by 64-bit hashes and sets are named by 64 bits of hash and 64
parities: two lines of 50 words that do not match are taken for matching with odds below 1e-15 a pair compared.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import dropped, stored

#: Cells of the table of word counts: as many as the first, fast level of a hash aggregation holds.
CELLS = 1 << 16
#: Bits of a word's hash below the 7 bits for its rarity.
HASH_BITS = 56


def _spaced(text) -> Column:
    """Text with all white space inside lines as spaces."""
    odd = text.contains("\t") | text.contains("\r") | text.contains("\f") | text.contains("\x0b")
    return F.when(odd, F.translate(text, "\t\r\f\x0b", "    ")).otherwise(text)


def _rarity(texts: DataFrame) -> str:
    """SQL for a constant array: by cell, three times the binary logarithm of how often its words occur.

    Other white space than spaces is left in words here: it shifts the order of words, which may be any, and spares a pass.
    """
    cell = (F.xxhash64("word").bitwiseAND(F.lit(CELLS - 1))).cast("int").alias("cell")
    words = texts.select(F.explode_outer(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("word")).where("word <> ''")
    counts = dict(words.groupBy(cell).count().collect())  # CELLS rows at most
    return "cast(split('" + ",".join(str(min(127, int(3 * log2(counts.get(i, 1))))) for i in range(CELLS)) + "', ',') as array<bigint>)"


#: The bits of a long by number, to be looked up: a step a word less than a shift, whose number would be cast.
_BITS = "array(" + ", ".join(f"shiftleft(1L, {i})" for i in range(64)) + ")"
#: The words of a line.
_WORDS = "array_remove(split(line, ' '), '')"


def _ranked(rarity: str) -> str:
    """SQL for the sorted set of a line's words: each is one number, rarity above hash, so no comparator is needed."""
    # Every cell has a value; coalesce() tells the planner, which then sorts plain numbers. No casts: each costs a step a word.
    one = f"shiftleft(coalesce({rarity}[x & {CELLS - 1}], 0L), {HASH_BITS}) | (x & {2**HASH_BITS - 1})"
    return f"array_distinct(sort_array(transform(transform({_WORDS}, x -> xxhash64(x)), x -> {one})))"


def _place(low: int, high: int, most: int) -> tuple[str, str, str]:
    """SQL for (id, pos) as one number `place`, whose minimum needs no sort, and for the pos and the id of a place.

    It is a long where ids from low to high leave room for places up to most, else a decimal, which costs a big number for each step.
    """
    shift = most.bit_length()
    if -(1 << 62 - shift) <= low and high < 1 << 62 - shift:
        return f"shiftleft(id, {shift}) | cast(pos as bigint)", f"cast(place & {(1 << shift) - 1}L as int)", f"shiftright(place, {shift})"
    pos = f"cast(pmod(place, {1 << 31}BD) as int)"
    return f"cast(cast(id as decimal(20,0)) * {1 << 31}BD + pos as decimal(32,0))", pos, f"(place - {pos}) div {1 << 31}BD"


def _gone(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, th, n_lines) for the rows of docs, and (id, th, n_exact, n_near, removed) for those with lines to remove, once for rows with equal id and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    # Counted before the explosion, so that no line's row carries all lines of its text; there is always a line, and where
    # that is left open by the outer form, the planner adds no test that cuts the text once more. The test below looks
    # at the line, so that it does not repeat the work on its words. The first line stands for its row.
    lines = texts.withColumn("lines", F.split(_spaced(F.col("text")), "\n")).select("id", "th", F.size("lines").alias("n_lines"), "lines")
    lines = lines.select("id", "th", "n_lines", F.posexplode_outer("lines").alias("pos", "line"))
    lines = lines.where((F.col("id").isNotNull() & (F.ltrim("line") != "")) | (F.col("pos") == 0))
    ranked = F.expr(_ranked(_rarity(texts)))
    kept = stored(
        lines.select("id", "th", "n_lines", "pos", ranked.alias("h")).select(
            "id", "th", "n_lines", "pos", F.size("h").alias("t"), F.xxhash64("h").alias("f"), F.expr(f"aggregate(h, 0L, (a, x) -> a ^ {_BITS}[x & 63])").alias("bits"),
            F.expr(f"case when size(h) * {100 - percent} >= {percent} then slice(h, 1, size(h) - cast(ceil(size(h) * {percent} / 100) as int) + 1) end").alias("prefix"),
        ),
        "lines",
        plain=True,
    )
    rows = kept.where("pos = 0").select("id", "th", F.col("n_lines").cast("long").alias("n_lines"))
    kept = kept.where("id is not null and t > 0")
    place, pos_of, id_of = _place(*kept.agg(*(F.coalesce(f, F.lit(0)) for f in (F.min("id"), F.max("id"), F.max("pos")))).first())
    # Each set once, with its first place.
    firsts = kept.withColumn("place", F.expr(place)).groupBy("f", "bits", "t", "prefix")
    sets = stored(firsts.agg(F.min("place").alias("place"), F.min_by("th", "place").alias("th"), F.count("*").alias("n")), "sets", plain=True)
    # Sets too small to match any but themselves have no prefix: t / (t + 1) is below the threshold.
    words = sets.where("prefix is not null").select(F.posexplode("prefix").alias("p", "w"), "f", "t", "bits").select("w", "f", (F.shiftleft(F.col("t").cast("long"), 32) + F.col("p")).alias("tp"), "bits")
    ta, tb = "(a.tp >> 32)", "(b.tp >> 32)"
    # All in whole numbers. Sets of s words in all match if they share s * percent / (100 + percent) or more; d words that only
    # one of them has leave (s - d) / 2. The most selective test comes first.
    most = f"{100 - percent} * ({ta} + {tb})"
    cheap = (
        f"a.w = b.w and {100 + percent} * bit_count(a.bits ^ b.bits) <= {most}"
        f" and {100 + percent} * least({ta} - (a.tp & 4294967295), {tb} - (b.tp & 4294967295)) >= {percent} * ({ta} + {tb})"
        f" and 100 * least({ta}, {tb}) >= {percent} * greatest({ta}, {tb}) and (a.f <> b.f or a.bits <> b.bits)"
    )
    near = stored(words.alias("a").join(words.alias("b"), F.expr(cheap), "left_semi"), "near")

    # The whole sets of lines with a partner, from the first line that has them, under the first of their words that passed.
    wanted = near.groupBy("f", "bits").agg(F.min("w").alias("w"), F.min_by("tp", "w").alias("tp"))
    places = sets.select("f", "bits", "place", "th").join(wanted.hint("shuffle_hash"), ["f", "bits"]).withColumn("pos", F.expr(pos_of))
    places = places.withColumn("id", F.expr(id_of)).groupBy("id", "th").agg(F.collect_list(F.struct("pos", "f", "bits", "w", "tp", "place")).alias("at"))
    # One small row for a document: as the built side of a hash join it spares a sort of all texts. Lines are taken out of
    # their text before the explosion, so that no row carries a whole text.
    own = ("f", "bits", "w", "tp", "place")
    parts = ", ".join(f"'{c}', x.{c}" for c in own)
    taken = F.explode_outer(F.expr(f"transform(at, x -> named_struct({parts}, 'line', get(lines, x.pos)))")).alias("at")
    fetched = texts.join(places.hint("shuffle_hash"), ["id", "th"]).withColumn("lines", F.split("text", "\n")).select("id", "th", taken).select("id", "th", "at.*")
    # Rows with equal id and text bring their lines again.
    fetched = fetched.distinct().withColumn("line", _spaced(F.col("line"))).select(*own, F.expr(f"array_distinct(transform({_WORDS}, x -> xxhash64(x)))").alias("h"))
    # Parities of the words with an odd 64th part; with `bits`, of all words, they tell those of the other words.
    half = F.expr(f"aggregate(h, 0L, (a, x) -> if(x & 64 = 0, a, a ^ {_BITS}[x & 63]))")
    whole = stored(fetched.select(*own, "h").withColumn("half", half), "whole", plain=True)
    odd = "bit_count(a.half ^ b.half) + bit_count(a.bits ^ a.half ^ b.bits ^ b.half)"
    cheap = f"{cheap} and {100 + percent} * ({odd}) <= {most} and b.place < a.place"
    exact = f"{cheap} and {100 + percent} * size(array_intersect(a.h, b.h)) >= {percent} * ({ta} + {tb})"
    once = stored(whole.alias("a").join(whole.alias("b"), F.expr(exact), "left_semi").select("f", "bits"), "once")
    # Pairs under one word have been compared: if they match, their first common word is the first of either that passed.
    again = f"{cheap} and a.w1 <> b.w1"
    # They are put together once, with what is settled, for the three readings below.
    own = whole.select("f", "bits", "place", F.col("w").alias("w1"), "half").join(once.withColumn("done", F.lit(True)), ["f", "bits"], "left")
    words = stored(near.join(own.hint("shuffle_hash"), ["f", "bits"]), "words", plain=True)
    open_ = stored(words.where("done is null").drop("done").alias("a").join(words.alias("b"), F.expr(again), "left_semi"), "open")
    other = words.drop("done").alias("b").join(open_.alias("a"), F.expr(again), "left_semi")
    full = whole.select("f", "bits", "h")
    a, b = (full.join(some.hint("shuffle_hash"), ["f", "bits"]) for some in (open_, other))
    twice = a.alias("a").join(b.alias("b"), F.expr(exact), "left_semi").select("f", "bits").distinct()
    twice = stored(twice, "twice")
    dropped(near, words, whole, open_)

    later = once.union(twice).withColumn("near", F.lit(True))
    # A set that occurs once is where it is first.
    first = sets.where("n > 1").select("f", "bits", F.col("place").alias("first")).join(later, ["f", "bits"], "full")
    marked = kept.select("id", "th", "pos", "f", "bits").join(first.hint("shuffle_hash"), ["f", "bits"])
    # A place and whether its line is there again, as one number; rows with equal id and text say the same.
    marked = marked.withColumn("again", F.expr(f"coalesce(({place}) <> first, false)")).where("again or near").select("id", "th", F.expr("pos * 2L + cast(again as int)").alias("mark"))
    gone = marked.groupBy("id", "th").agg(F.array_sort(F.collect_set("mark")).alias("marks"))
    n_exact = F.expr("cast(size(filter(marks, x -> x % 2 = 1)) as bigint)")
    return rows, gone.select("id", "th", n_exact.alias("n_exact"), (F.size("marks") - n_exact).alias("n_near"), F.expr("transform(marks, x -> cast(x div 2 as int))").alias("removed"))


def line_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 80) -> DataFrame:
    """(id_col, n_lines, n_exact, n_near, removed) for each row of docs; ids are read as 64-bit integers.

    Lines end with newlines; words are runs of anything but spaces, tabs, carriage returns, form feeds and vertical tabs.
    A line is removed if an earlier line, by (id, place in its text), has the same words (n_exact) or, for the first line
    with its words, words that match (n_near), whether that line is itself removed or not. removed has their places from 0.
    Lines without words stay. Null and empty texts have one line without words. Rows with a null id keep all lines and
    remove none. Rows with one id are ordered as one document; lines at the same place of them do not remove each other
    unless equal words make them one set, and rows with one id and one text have the same result. Other columns are not
    looked at, whatever their names.
    """
    rows, gone = _gone(docs, id_col, text_col, percent)
    zero = F.lit(0).cast("long")
    return rows.join(gone, ["id", "th"], "left").select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_lines", F.coalesce("n_exact", zero).alias("n_exact"), F.coalesce("n_near", zero).alias("n_near"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed")
    )


def without_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 80) -> DataFrame:
    """docs with the matching lines taken out of text_col; null texts stay null, and all other columns stay, whatever their names."""
    found = _gone(docs, id_col, text_col, percent)[1].select("id", "th", "removed")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th")).join(found, ["id", "th"], "left")
    own = F.col("doc").getField(text_col)
    left = F.array_join(F.filter(F.split(own, "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    cut = F.when(F.col("removed").isNull(), own).otherwise(left)
    return rows.select(*[(cut if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns])
