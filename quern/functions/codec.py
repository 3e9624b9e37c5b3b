"""Posting-list codec as SQL expressions: fixed byte width, gaps, then frequencies.

One header byte gives the width in bytes that the largest gap or frequency needs; then
come the gaps of the ascending ids and the frequencies, big-endian at that width.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def encode(doc_ids: Column, frequencies: Column) -> Column:
    """BINARY; empty for empty lists. Raises if the lists differ in length or ids descend."""

    def byte(v: Column, k: int = 0) -> Column:
        return F.chr(F.shiftright(v, 8 * k) if k else v)

    def digits(values: Column, width: Column) -> Column:
        # Latin-1 turns characters below 256 into bytes of the same value; widths of 1 and 2 are the usual ones
        short = [F.array_join(F.transform(values, lambda v: byte(v)), ""), F.array_join(F.transform(values, lambda v: F.concat(byte(v, 1), byte(v))), "")]
        each = F.when(width == 1, short[0]).when(width == 2, short[1])
        wide = F.transform(values, lambda v: F.lpad(F.hex(v), width * 2, "0"))
        narrow = F.encode(F.concat(F.chr(width.cast("long")), each), "ISO-8859-1")
        return F.when(width <= 2, narrow).otherwise(F.unhex(F.concat(F.lpad(F.hex(width.cast("long")), 2, "0"), F.array_join(wide, ""))))

    def blob(values: Column) -> Column:
        bad = F.raise_error(F.lit("document ids must be ascending and not negative")).cast("binary")
        width = F.ceil(F.length(F.bin(F.array_max(values))) / F.lit(8)).cast("int")
        return F.when(F.array_min(values) < 0, bad).otherwise(let(width, lambda w: digits(values, w)))

    before = F.concat(F.array(F.lit(0).cast("long")), F.slice(doc_ids, F.lit(1), F.greatest(F.size(doc_ids) - 1, F.lit(0))))
    values = F.concat(F.zip_with(doc_ids, before, lambda x, y: x - y), frequencies)
    bad_length = F.raise_error(F.lit("document ids and frequencies differ in length")).cast("binary")
    return F.when(F.size(doc_ids) != F.size(frequencies), bad_length).when(F.size(doc_ids) == 0, F.lit(b"")).otherwise(let(values, blob))


def _numbers(blob: Column) -> Column:
    """The gaps, then the frequencies, in one pass over the bytes, read as Latin-1 characters."""

    def parse(octets: Column) -> Column:
        def number(i: Column) -> Column:
            return F.aggregate(F.slice(octets, i * octets[0] + 2, octets[0]), F.lit(0).cast("long"), lambda a, x: a * 256 + x)

        n = (F.size(octets) - 1) / octets[0]
        at = F.sequence(F.lit(0), n.cast("int") - 1)
        two = F.transform(at, lambda i: (F.get(octets, i * 2 + 1) * 256 + F.get(octets, i * 2 + 2)).cast("long"))
        one = F.slice(octets, F.lit(2), F.size(octets) - 1).cast("array<bigint>")
        each = F.when(octets[0] == 1, one).when(octets[0] == 2, two).otherwise(F.transform(at, number))
        bad = F.raise_error(F.lit("the blob does not hold as many ids as frequencies")).cast("array<bigint>")
        return F.when(n == 0, F.array().cast("array<bigint>")).when((n == F.floor(n)) & (n % 2 == 0), each).otherwise(bad)

    return let(F.transform(F.split(F.decode(blob, "ISO-8859-1"), ""), lambda c: F.ascii(c)), parse)


def decode_gaps(blob: Column) -> Column:
    """ARRAY<STRUCT<gap, tf>>; empty for an empty blob. Linear in the length of the list."""

    def zipped(numbers: Column) -> Column:
        half = (F.size(numbers) / 2).cast("int")
        return F.zip_with(F.slice(numbers, F.lit(1), half), F.slice(numbers, half + 1, half), lambda g, f: F.struct(g.alias("gap"), f.alias("tf")))

    none = F.array().cast("array<struct<gap:bigint,tf:bigint>>")
    return let(blob, lambda b: F.when(F.length(b) == 0, none).otherwise(let(_numbers(b), zipped)))


#: Numbers that are added up at a time.
RUN = 32


def _short_sums(values: Column) -> Column:
    """Running sums by doubling the reach, log2 n passes; for short lists."""

    def reach(v: Column, by: Column) -> Column:
        return F.transform(v, lambda x, i: x + F.coalesce(F.get(v, i - by), F.lit(0).cast("long")))

    def doubled(v: Column) -> Column:
        passes = F.transform(F.sequence(F.lit(0), F.length(F.bin(F.size(v).cast("long") - 1)) - 1), lambda k: F.pow(F.lit(2), k).cast("int"))
        return F.when(F.size(v) > 1, F.aggregate(passes, v, reach)).otherwise(v)

    return let(values, doubled)


def running_sums(values: Column, levels: int = 2) -> Column:
    """Running sums of an ARRAY<BIGINT>: of runs of ``RUN`` numbers, moved by those of the runs' totals. A list
    of n numbers is passed over some log2 RUN times, whatever its length."""
    if not levels:
        return _short_sums(values)

    def moved(runs: Column) -> Column:
        totals = running_sums(F.transform(runs, lambda r: F.element_at(r, -1)), levels - 1)
        return let(totals, lambda t: F.flatten(F.transform(runs, lambda r, i: let(F.coalesce(F.get(t, i - 1), F.lit(0)), lambda by: F.transform(r, lambda v: v + by)))))

    def long(v: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(1), F.size(v), F.lit(RUN)), lambda at: _short_sums(F.slice(v, at, F.lit(RUN)))), moved)

    return let(values, lambda v: F.when(F.size(v) > RUN, long(v)).otherwise(_short_sums(v)))


def decode_lists(blob: Column) -> Column:
    """STRUCT<doc_ids, frequencies>, both ARRAY<BIGINT>; empty arrays for an empty blob."""

    def halves(numbers: Column) -> Column:
        half = (F.size(numbers) / 2).cast("int")
        return F.struct(running_sums(F.slice(numbers, F.lit(1), half)).alias("doc_ids"), F.slice(numbers, half + 1, half).alias("frequencies"))

    none = F.array().cast("array<bigint>")
    return let(blob, lambda b: let(F.when(F.length(b) == 0, none).otherwise(_numbers(b)), halves))


def decode_postings(blob: Column) -> Column:
    """ARRAY<STRUCT<id, tf>>; empty for an empty blob."""
    return let(decode_lists(blob), lambda l: F.zip_with(l["doc_ids"], l["frequencies"], lambda i, f: F.struct(i.alias("id"), f.alias("tf"))))


def decode(blob: Column) -> tuple[Column, Column]:
    """(doc_ids, frequencies), both ARRAY<BIGINT>; empty arrays for an empty blob."""
    lists = decode_lists(blob)
    return lists["doc_ids"], lists["frequencies"]
