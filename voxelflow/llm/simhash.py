"""Document fingerprints: SimHash over weighted term hashes, and an exact Hamming search over tables of blocks.

Everything here is DataFrame expressions. A term is three consecutive lower-cased words and weighs as often as it occurs. Each
term hash votes for or against each of the 128 bits; the votes of two bits share one long sum (32 bits each), so a text is 64
sums in a hash aggregate that runs in the task that holds the text. Texts are moved once, to the task that holds their
neighbours in id order.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import accumulate, combinations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import partitions, stored, whole

BITS = 128
#: Bits of 128 in which near copies differ at most: on testdata/sf0.1 the 293 pairs of different texts whose five-word sets have a
#: Jaccard similarity of 0.8 or more are 7 to 23 bits apart (5th percentile and most), 13 in the median.
RADIUS = 23
#: Blocks that a fingerprint is filed under, and bits of each.
BLOCKS, SIDE = 8, 16
#: Rows that one range of ids holds at most, about; a range is what one window partition sorts.
ROWS_PER_RANGE = 20_000
#: Cuts between ranges that are one expression; beyond that the stretches between them are divided evenly.
MOST_CUTS = 4096
#: Ranges whose first rows are found by a broadcast (some 40 bytes each); more by a shuffle.
BROADCAST_RANGES = 1_000_000
_PAIR = 0x0000000100000001


def _votes(low: str, high: str) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(F.col(h), j).bitwiseAND(F.lit(_PAIR))).alias(f"{h}{j}") for h in (low, high) for j in range(32)]


def _bits(h: str) -> Column:
    """The long of the bits that most terms vote for; an even vote is 0."""
    out = F.lit(0).cast("long")
    for j in range(32):
        votes = F.col(f"{h}{j}")
        out = out.bitwiseOR(F.when(2 * votes.bitwiseAND(F.lit(0xFFFFFFFF)) > F.col("terms"), F.lit(1 << j)).otherwise(F.lit(0)).cast("long"))
        top = (1 << (j + 32)) if j < 31 else -(1 << 63)
        out = out.bitwiseOR(F.when(2 * F.shiftrightunsigned(votes, 32) > F.col("terms"), F.lit(top)).otherwise(F.lit(0)).cast("long"))
    return out


def fingerprint(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """`keys`, lo, hi for each row; `keys` must tell rows apart. No shuffle where `rows` is partitioned by some of `keys`."""
    words = F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+")
    split = rows.select(*keys, words.alias("w"))
    tail = split.select(*keys, F.inline(F.arrays_zip("w", F.expr("slice(w, 2, size(w))"), F.expr("slice(w, 3, size(w))"))).alias("a", "b", "c"))
    hashed = tail.select(*keys, F.xxhash64("a", "b", "c").alias("lo"), F.xxhash64("c", F.lit(1), "b", "a").alias("hi"))
    votes = hashed.groupBy(*keys).agg(F.count("*").alias("terms"), *_votes("lo", "hi"))
    return votes.select(*keys, _bits("lo").alias("lo"), _bits("hi").alias("hi"))


def as_text(lo: str, hi: str) -> Column:
    """A fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def likeness(lo: str, hi: str, lo2: str, hi2: str) -> Column:
    """The share of equal bits."""
    apart = F.bit_count(F.col(lo).bitwiseXOR(F.col(lo2))) + F.bit_count(F.col(hi).bitwiseXOR(F.col(hi2)))
    return 1 - apart / F.lit(float(BITS))


@dataclass(frozen=True)
class Ranges:
    """Numbers of ranges of ids, ascending with (id, tie), null ids first.

    cuts: ascending ids at which a stretch begins; a stretch without a cut of its own comes before the first. pieces: for null and for each cut,
    in how many ranges its rows are dealt by their tie (0: with the rest of the stretch). parts: ranges of a stretch, of even width.
    """

    least: int
    greatest: int
    cuts: list[int]
    pieces: list[int]
    parts: int

    @property
    def plain(self) -> bool:
        """Whether every range but the first begins with the rows of a cut, all of which it holds."""
        return self.parts == 1 and not any(self.pieces)

    def of(self, id_col: str, tie_col: str) -> Column:
        steps = [self.pieces[0], *(p + self.parts for p in self.pieces[1:])]  # ranges before a stretch's own
        starts = list(accumulate([self.pieces[0], self.parts, *steps[1:]]))[: len(self.cuts) + 1]
        lows, highs = [self.least, *self.cuts], [*self.cuts, self.greatest + 1]
        long = lambda x: F.lit(x).cast("array<bigint>")
        at = F.col("_at") + 1
        low, high, piece = F.element_at(long(lows), at), F.element_at(long(highs), at), F.element_at(long([0, *self.pieces[1:]]), at)
        dealt = lambda n: F.least(F.floor((F.col(tie_col).cast("double") / 2.0**64 + 0.5) * n), n - 1)
        even = F.least(F.floor((F.col(id_col) - low) / F.greatest(high - low, F.lit(1)).cast("double") * self.parts), F.lit(self.parts - 1)) if self.parts > 1 else F.lit(0)
        inside = F.when((piece > 0) & (F.col(id_col) == low), dealt(piece)).otherwise(piece + even)
        return F.when(F.col(id_col).isNull(), dealt(F.lit(max(1, self.pieces[0])))).otherwise(F.element_at(long(starts), at) + inside).cast("long")


def id_ranges(docs: DataFrame, id_col: str, rows: int, nulls: int) -> Ranges:
    """Ranges of about ROWS_PER_RANGE rows: one aggregate over the id column. An id that several cuts fall on is dealt to as many ranges."""
    n = max(4 * partitions(docs.sparkSession), -(-rows // ROWS_PER_RANGE))
    parts, n = -(-n // MOST_CUTS), min(n, MOST_CUTS)
    found, least, greatest = docs.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], 20 * n), F.min(id_col), F.max(id_col)).first()
    times = Counter(x for x in found or [] if x > least)
    first = sum(x == least for x in found or [])
    cuts = sorted(times)
    pieces = [-(-nulls // ROWS_PER_RANGE) if nulls else 0, *(parts * times[x] if times[x] > 1 else 0 for x in cuts)]
    if first > 1:  # the least id alone fills ranges
        cuts, pieces = [least, *cuts], [pieces[0], parts * first, *pieces[1:]]
    return Ranges(least or 0, greatest or 0, cuts, pieces, parts)


def range_of(id_col: str, cuts: list[int]) -> Column:
    """The number of `cuts` that aren't above the id, by bisection; 0 for null."""
    depth = len(cuts).bit_length()
    if not depth:
        return F.lit(0)
    padded = cuts + [None] * ((1 << depth) - len(cuts))
    table = F.lit([x if x is not None else (1 << 63) - 1 for x in padded]).cast("array<bigint>")
    steps = F.lit([1 << i for i in reversed(range(depth))]).cast("array<int>")
    reach = lambda at, step: (at + step <= len(cuts)) & (F.element_at(table, at + step) <= F.col(id_col))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(reach(at, step), F.lit(False)), at + step).otherwise(at))


def _dealt(base: DataFrame, ranges: Ranges) -> DataFrame:
    """id, text, tie, range, guest, wrap: each row in its range, and in the range before the first row of a range as a guest."""
    numbered = base.withColumn("tie", F.xxhash64("text")).withColumn("_at", range_of("id", ranges.cuts)).withColumn("range", ranges.of("id", "tie")).drop("_at")
    if ranges.plain:
        last = len(ranges.cuts)
        heads = F.lit(ranges.cuts or [0]).cast("array<bigint>")
        head = (F.col("range") > 0) & (F.col("id") == F.element_at(heads, F.greatest(F.col("range"), F.lit(1)).cast("int")))
        spot = lambda r, guest, wrap: F.struct(r.cast("long").alias("range"), F.lit(guest).alias("guest"), F.lit(wrap).alias("wrap"))
        places = F.array(spot(F.col("range"), 0, 0), F.when(head, spot(F.col("range") - 1, 1, 0)), F.when(F.col("id") == ranges.least, spot(F.lit(last), 1, 1)))
        return numbered.withColumn("to", F.explode(F.filter(places, lambda x: x.isNotNull()))).select("id", "text", "tie", "to.range", "to.guest", "to.wrap")
    # a row per range, from which the one before it is known
    firsts = numbered.groupBy("range").agg(F.min(F.struct(F.col("id").isNotNull().alias("z"), "id", "tie")).alias("f"), F.lit(1).alias("all"))
    order = Window.partitionBy("all").orderBy("range")
    lag, last = F.lag("range").over(order), F.max("range").over(Window.partitionBy("all"))
    heads = stored(firsts.select(F.col("f.id").alias("hid"), F.col("f.tie").alias("htie"), F.coalesce(lag, last).alias("to"), F.when(lag.isNull(), 1).otherwise(0).alias("wrap")))
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_RANGES else heads
    guests = numbered.join(heads, F.col("id").eqNullSafe(F.col("hid")) & (F.col("tie") == F.col("htie"))).dropDuplicates(["to", "wrap"])
    own = numbered.select("id", "text", "tie", "range", F.lit(0).alias("guest"), F.lit(0).alias("wrap"))
    return own.unionByName(guests.select("id", "text", "tie", F.col("to").alias("range"), F.lit(1).alias("guest"), "wrap"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`, with the fingerprints of its text and of its edited text.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next row's text
    in ascending order of id; the first row follows the last, and a single row follows itself. Null ids come first; rows of one id follow
    one another by a hash of their text. Ids are integers; others raise a TypeError. Null text counts as empty, which is one empty
    term. Columns: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, lo, hi (the fingerprint
    as longs). Other columns are ignored; an empty table gives an empty result.

    Rows are dealt to ranges of ids of about equal size; an id, or null, that many rows have is dealt by a hash of the text. A range
    also gets the first row of the next one, so each text has its successor beside it; terms are then counted where the texts are.
    """
    if not isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{id_col} is no integer")
    base = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text"))
    rows, nulls = docs.agg(F.count("*"), F.count(F.when(F.col(id_col).isNull(), 1))).first()
    dealt = _dealt(base, id_ranges(docs, id_col, rows, nulls))

    order = Window.partitionBy("range").orderBy("wrap", F.col("id").asc_nulls_first(), "tie")
    paired = dealt.select("*", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next"), F.char_length("text").alias("n"))
    cut = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut))
    both = paired.withColumn("edited", edited).withColumn("sha", F.sha2("edited", 256))
    each = both.select("range", "rn", "id", "guest", F.col("n").cast("long").alias("n"), "sha", F.inline(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("content")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("content")))))
    prints = fingerprint(each.where("guest = 0 or which = 0"), "content", ["range", "rn", "id", "guest", "n", "sha", "which"])

    pick = lambda c, which: F.max(F.when(F.col("which") == which, F.col(c)))
    row = prints.groupBy("range", "rn", "id", "guest", "n", "sha").agg(pick("lo", 0).alias("lo"), pick("hi", 0).alias("hi"), pick("lo", 1).alias("elo"), pick("hi", 1).alias("ehi"))
    after = Window.partitionBy("range").orderBy("rn")
    row = row.select("*", F.lead("lo").over(after).alias("nlo"), F.lead("hi").over(after).alias("nhi")).where("guest = 0")
    return row.select(
        F.col("id").alias(id_col), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), as_text("lo", "hi").alias("fingerprint"), as_text("elo", "ehi").alias("edited_fingerprint"),
        likeness("lo", "hi", "elo", "ehi").alias("near_edited"), likeness("lo", "hi", "nlo", "nhi").alias("near_next"), "lo", "hi",
    )


def _balls(radius: int) -> list[list[int]]:
    """For each of BLOCKS blocks of SIDE bits the flips that a probe tries: all of so few bits that a pair within the radius can't escape.

    Were two fingerprints apart by more than r_i bits in every block i, they would be apart by the sum of r_i + 1 bits at least;
    the r_i are as even as can be with a sum above the radius.
    """
    most = [(radius + 1 - i + BLOCKS - 1) // BLOCKS - 1 for i in range(BLOCKS)]
    return [[sum(1 << b for b in bits) for r in range(m + 1) for bits in combinations(range(SIDE), r)] for m in most]


def _block(lo: str, hi: str, i: int) -> Column:
    return F.shiftrightunsigned(F.col(lo if i < 64 // SIDE else hi), SIDE * i % 64).bitwiseAND(F.lit((1 << SIDE) - 1)).cast("int")


def near_fingerprints(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs (lo, hi, lo2, hi2, apart) of a distinct fingerprint of `queries` and one of `prints` within the radius.

    Both are files of longs lo, hi. Fingerprints are made distinct first, so a group of copies is one row however large. Each of
    `prints` is filed under its BLOCKS blocks; each of `queries` probes all values that `_balls` allows for a block, and whatever
    meets is measured, so no pair is missed. A pair that meets in several blocks is kept in the first. Null matches nothing.
    """
    balls = _balls(radius)
    distinct = lambda rows, lo, hi: rows.select(F.col("lo").alias(lo), F.col("hi").alias(hi)).where(f"{lo} is not null and {hi} is not null").distinct()
    used = [i for i, ball in enumerate(balls) if ball]
    filed = distinct(prints, "lo2", "hi2").select("lo2", "hi2", F.inline(F.array(*[F.struct(F.lit(i).alias("block"), _block("lo2", "hi2", i).alias("value")) for i in used])))
    flips = queries.sparkSession.createDataFrame([(i, flip) for i in used for flip in balls[i]], "block int, flip int")
    probes = distinct(queries, "lo", "hi").select("lo", "hi", F.inline(F.array(*[F.struct(F.lit(i).alias("block"), _block("lo", "hi", i).alias("own")) for i in used])))
    probes = probes.join(F.broadcast(flips), "block").select("lo", "hi", "block", F.col("own").bitwiseXOR(F.col("flip")).alias("value"))

    x, y = F.col("lo").bitwiseXOR(F.col("lo2")), F.col("hi").bitwiseXOR(F.col("hi2"))
    apart = F.bit_count(x) + F.bit_count(y)
    differ = lambda i: F.bit_count((x if i < 64 // SIDE else y).bitwiseAND(F.lit(((1 << SIDE) - 1) << (SIDE * i % 64)).cast("long") if SIDE * i % 64 + SIDE < 64 else F.lit(-(1 << (64 - SIDE))).cast("long")))
    first = F.coalesce(*[F.when(differ(i) <= max(f.bit_count() for f in balls[i]), F.lit(i)) for i in used])
    met = probes.join(filed, ["block", "value"]).where(apart <= radius).where(first == F.col("block"))
    return met.select("lo", "hi", "lo2", "hi2", apart.alias("apart"))


def op10(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`fingerprints`, and for every row whose id is divisible by 100 what lies within the radius: near_prints, the number of distinct
    fingerprints, its own included, and near_ids, the ids of all other documents with one of them, ascending; null for others."""
    rows = stored(fingerprints(docs))
    queries = rows.where("doc_id % 100 = 0")
    pairs = stored(near_fingerprints(queries, rows, radius))
    holders = rows.where("doc_id is not null").select(F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("doc_id").alias("other"))
    counts = pairs.groupBy("lo", "hi").agg(F.count("*").alias("near_prints"))
    ids = pairs.join(holders, ["lo2", "hi2"]).groupBy("lo", "hi").agg(F.array_sort(F.collect_set("other")).alias("found"))
    own = queries.join(counts, ["lo", "hi"], "left").join(ids, ["lo", "hi"], "left").withColumn("near_ids", F.array_remove("found", F.col("doc_id"))).drop("found")
    rest = rows.where("not coalesce(doc_id % 100 = 0, false)").withColumns({"near_prints": F.lit(None).cast("long"), "near_ids": F.lit(None).cast("array<bigint>")})
    return own.unionByName(rest).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_prints", "near_ids")
