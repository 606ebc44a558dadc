"""Spans of regular expressions in texts as DataFrame expressions: places in code points, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<s:bigint,k:int,kind:string,e:bigint,v:string>"
#: Elements whose running values are found one by one; what comes before them is added afterwards.
PIECE = 256


def running(values: Column, op, zero: int) -> Column:
    """Of an array of longs, the result of op over each element and all before it, for an associative op with this zero.

    In pieces, since an array grows by copying: the work is in proportion to the elements as long as there are not millions.
    """
    none, start = F.expr("cast(array() as array<bigint>)"), F.lit(zero).cast("long")

    def one_by_one(c: Column) -> Column:
        state = F.struct(start.alias("p"), none.alias("out"))
        add = lambda a, x: F.struct(op(a["p"], x).alias("p"), F.concat(a["out"], F.array(op(a["p"], x))).alias("out"))
        return F.aggregate(c, state, add, lambda a: a["out"])

    def whole(v: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / PIECE).cast("int"), F.lit(0))), lambda k: F.slice(v, k * PIECE + 1, F.lit(PIECE)))
        return F.transform(pieces, one_by_one)

    def joined(parts: Column) -> Column:
        before = F.concat(F.array(start), one_by_one(F.transform(parts, lambda c: F.coalesce(F.try_element_at(c, F.lit(-1)), start))))
        return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda c, b: F.transform(c, lambda x: op(b, x))))

    # arrays of one, so that each step is computed once
    return F.get(F.transform(F.transform(F.array(values), whole), joined), F.lit(0))


def plus(a: Column, b: Column) -> Column:
    return a + b


def places(matches: Column, gaps: Column) -> Column:
    """Where each match ends, from the matches and what lies between them (one more)."""
    return running(F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda v, g: (F.length(g) + F.length(v)).cast("long")), plus, 0)


def find(text: str, regex: str, kind: str, order: int, hint: Column) -> Column:
    """All leftmost non-overlapping matches, as an array of SPAN. text: a column's name.

    hint: a condition that holds for every text with a match; others aren't searched. The places follow from the lengths
    of the matches and of what lies between them. Regexes here have no empty matches.
    """
    # an array of one, so that matches and gaps are computed once
    both = F.array(F.struct(F.regexp_extract_all(F.col(text), F.lit(regex), F.lit(0)).alias("m"), F.split(F.col(text), regex, -1).alias("g")))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    one = lambda v, e: F.struct((e - F.length(v)).alias("s"), F.lit(order).alias("k"), F.lit(kind).alias("kind"), e.alias("e"), v.alias("v")).cast(SPAN)
    found = F.transform(both, lambda x: F.zip_with(x["m"], places(x["m"], x["g"]), one))
    return F.when(hint, F.get(found, F.lit(0))).otherwise(none)


def listed(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def free_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others, sorted.

    Others that begin before a span ends overlap it if one of them ends after its start: the largest end so far tells.
    """
    at = lambda x, place, t: F.struct(place.alias("p"), F.lit(t).alias("t"), x.alias("x"))
    merged = F.array(F.array_sort(F.concat(F.transform(spans, lambda x: at(x, x["e"], 0)), F.transform(others, lambda x: at(x, x["s"], 1)))))

    def kept(m: Column) -> Column:
        reach = running(F.transform(m, lambda y: F.when(y["t"] == 1, y["x"]["e"]).otherwise(F.lit(-1).cast("long"))), F.greatest, -1)
        both = F.zip_with(m, reach, lambda y, r: F.struct(y["t"].alias("t"), y["x"].alias("x"), r.alias("r")))
        return F.array_sort(F.transform(F.filter(both, lambda y: (y["t"] == 0) & (y["r"] <= y["x"]["s"])), lambda y: y["x"]))

    return F.when(F.size(spans) == 0, spans).otherwise(F.get(F.transform(merged, kept), F.lit(0)))


def replaced(text: Column, spans: Column) -> Column:
    """text with each of the sorted spans replaced by its kind in angle brackets; what begins inside an earlier span goes with it."""
    box = F.array(spans)

    def done(x: Column) -> Column:
        upto = F.concat(F.array(F.lit(0).cast("long")), running(F.transform(x, lambda y: y["e"]), F.greatest, 0))
        return F.struct(F.zip_with(x, F.slice(upto, F.lit(1), F.size(x)), lambda y, p: F.struct(y["s"].alias("s"), p.alias("p"), y["kind"].alias("kind"))).alias("x"), F.element_at(upto, -1).alias("end"))

    def piece(c: Column) -> Column:
        # the text of the piece is cut out once, and what lies between its spans out of that
        start = F.element_at(c, 1)["p"]
        block = F.array(F.substr(text, start + 1, F.greatest(F.element_at(c, -1)["s"] - start, F.lit(0).cast("long"))))
        one = lambda b, y: F.when(y["s"] < y["p"], F.lit("")).otherwise(F.concat(F.substr(b, y["p"] - start + 1, y["s"] - y["p"]), F.lit("<"), F.upper(y["kind"]), F.lit(">")))
        return F.get(F.transform(block, lambda b: F.array_join(F.transform(c, lambda y: one(b, y)), "")), F.lit(0))

    def put(x: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(x["x"]) - 1) / PIECE).cast("int")), lambda k: F.slice(x["x"], k * PIECE + 1, F.lit(PIECE)))
        return F.concat(F.array_join(F.transform(pieces, piece), ""), F.substr(text, x["end"] + 1))

    return F.when(F.size(spans) > 0, F.get(F.transform(F.transform(box, done), put), F.lit(0))).otherwise(text)
