"""Pack ordered texts into bounded messages: folds inside one row, and packing of rows for threads of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from .segments import SEGMENT_ROWS, chain_starts, with_total_before


def pieces(text: Column, limit: int, cut: bool = False) -> Column:
    """A text as consecutive pieces of ``limit`` characters (the last may be shorter); with ``cut`` the first one only.  Null has none."""
    last = F.lit(0) if cut else F.greatest(F.floor((F.length(text) - 1) / limit).cast("int"), F.lit(0))
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * limit + 1, F.lit(limit)))
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(each)


def pack_texts(parts: Column, limit: int = V.TEXT_LIMIT, sep: str = "\n\n", cut: bool = False) -> Column:
    """Greedy packing: messages of at most ``limit`` characters, parts joined by ``sep``.

    A part longer than the limit goes on in the next message; with ``cut`` the rest of it is dropped.
    """
    none = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        joined = F.when(acc["cur"] != "", F.concat(acc["cur"], F.lit(sep), part)).otherwise(part)
        full = F.length(joined) > limit
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
                        F.when(full, part).otherwise(joined).alias("cur"))

    return F.aggregate(F.flatten(F.transform(parts, lambda p: pieces(p, limit, cut))), F.struct(none.alias("done"), F.lit("").alias("cur")), step,
                       lambda acc: F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]))


def pack_numbered(head: Column, parts: Column, foot: Column, limit: int = V.TEXT_LIMIT, rows: int = V.NUMBERED_ROWS,
                  cut: bool = False) -> Column:
    """Messages of at most ``limit`` characters and ``rows`` numbered lines.

    ``parts``: array of (text, number), number 0 for lines without buttons.  Array of (text, numbers).  A line longer than the
    limit goes on in the next message, its button stays with its beginning; with ``cut`` the rest of it is dropped.
    """
    none = F.array().cast("array<struct<text:string,numbers:array<int>>>")
    no_numbers = F.array().cast("array<int>")

    def message(acc: Column) -> Column:
        return F.array(F.struct(acc["cur"].alias("text"), acc["numbers"].alias("numbers")))

    def step(acc: Column, part: Column) -> Column:
        text = part["text"]
        numbered = part["number"] > 0
        full = (F.length(acc["cur"]) + 1 + F.length(text) > limit) | (numbered & (F.size(acc["numbers"]) >= rows))
        held = F.when(full, no_numbers).otherwise(acc["numbers"])
        return F.struct(F.when(full, F.concat(acc["done"], message(acc))).otherwise(acc["done"]).alias("done"),
                        F.when(full, text).otherwise(F.concat(acc["cur"], F.lit("\n"), text)).alias("cur"),
                        F.when(numbered, F.concat(held, F.array(part["number"]))).otherwise(held).alias("numbers"))

    def finish(acc: Column) -> Column:
        full = F.length(acc["cur"]) + 1 + F.length(foot) > limit
        closed = F.struct(acc["done"].alias("done"), F.when(foot == "", acc["cur"]).otherwise(
            F.concat(acc["cur"], F.lit("\n"), foot)).alias("cur"), acc["numbers"].alias("numbers"))
        apart = F.concat(acc["done"], message(acc), F.array(F.struct(foot.alias("text"), no_numbers.alias("numbers"))))
        return F.when((foot != "") & full, apart).otherwise(F.concat(acc["done"], message(closed)))

    def lines(part: Column) -> Column:
        return F.transform(pieces(part["text"], limit, cut), lambda t, i: F.struct(
            t.alias("text"), F.when(i == 0, part["number"]).otherwise(0).alias("number")))

    start = F.struct(none.alias("done"), head.alias("cur"), no_numbers.alias("numbers"))
    return F.aggregate(F.flatten(F.transform(parts, lines)), start, step, finish)


def pack_blocks(sizes: Column, most: int = V.BLOCKS_PER_MESSAGE, chars: int = V.BLOCK_CHARS) -> Column:
    """Number of the message each block goes to (from 0): at most ``most`` blocks and ``chars`` characters each."""
    def step(acc: Column, size: Column) -> Column:
        full = (acc["n"] > 0) & ((acc["n"] >= most) | (acc["total"] + size > chars))
        msg = F.when(full, acc["msg"] + 1).otherwise(acc["msg"])
        return F.struct(F.concat(acc["out"], F.array(msg)).alias("out"), msg.alias("msg"),
                        F.when(full, F.lit(1)).otherwise(acc["n"] + 1).alias("n"),
                        F.when(full, size).otherwise(acc["total"] + size).alias("total"))

    zero = F.lit(0)
    start = F.struct(F.array().cast("array<int>").alias("out"), zero.alias("msg"), zero.alias("n"), zero.alias("total"))
    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def cut_bytes(text: Column, limit: int = V.BYTE_LIMIT) -> Column:
    """At most ``limit`` bytes, never half a character: a broken tail is removed by its bit pattern."""
    raw = F.hex(F.substring(F.encode(text, "UTF-8"), 1, limit))
    # Continuation bytes start with 8, 9, A or B; a lead byte announces 2 (C, D), 3 (E) or 4 (F) bytes.
    broken = r"(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$"
    cut = F.decode(F.unhex(F.regexp_replace(raw, broken, "")), "UTF-8")
    return F.when(F.octet_length(text) <= limit, text).otherwise(cut)


def pack_rows(parts: DataFrame, key: str, order: str, text: str, segment: Column, limit: int = V.TEXT_LIMIT, sep: str = "\n\n",
              segment_rows: int = SEGMENT_ROWS, cut: bool = False) -> DataFrame:
    """(key, msg, text): ``pack_texts`` for parts that are rows (non-empty texts), whatever the length of a thread.

    A part longer than the limit becomes consecutive pieces, ordered by their number; with ``cut`` only the first is kept.

    A message that starts at a part ends before the first part whose end lies more than ``limit`` after that start, so
    the starts are a chain over cumulative lengths.  Positions and numbers are running sums over segments of the order;
    only the parts of one message, at most ``limit`` characters, meet in one row.
    """
    rows = parts.select(key, order, F.posexplode(pieces(F.col(text), limit, cut)).alias("_piece", "_t")).withColumn("_len", F.length("_t"))
    placed = with_total_before(rows, [key], [order, "_piece"], F.col("_len") + len(sep), segment, "_start").withColumn("_end", F.col("_start") + F.col("_len"))
    heads = chain_starts(placed.select(key, "_start", "_end"), key, limit + 1, (limit + 1) * 64, segment_rows).withColumn("_head", F.lit(1))
    flagged = placed.join(heads, [key, "_start"], "left").withColumn("_head", F.coalesce("_head", F.lit(0)))
    numbered = with_total_before(flagged, [key], [order, "_piece"], F.col("_head"), segment, "_heads")
    numbered = numbered.withColumn("msg", F.col("_heads") + F.col("_head") - 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_piece", "_t"))), lambda x: x["_t"]), sep)
    return numbered.groupBy(key, "msg").agg(joined.alias("text"))
