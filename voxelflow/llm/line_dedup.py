"""Line deduplication: exact copies by hash, near copies by a segment-partition edit join.

Lines are compared in the order of (document id, hash of its text, line number). A line goes if an equal line, or one within
EDITS edits, comes before it. Equal lines are grouped by a 128-bit hash, combined before the shuffle. For near copies each
distinct line is cut into EDITS + 1 segments; a line within EDITS edits of another holds one of its segments unchanged, near
the place that the length difference allows. Segments are filed by (length, number, content), and each line probes the substrings
at the allowed places for its own length and the EDITS lengths below.

File entries and probes are exchanged as arrays, 12 bytes each, between tasks that own ranges of the key; only keys that a
file entry and a probe of different lines share go on. A task that holds a key OFTEN keeps its lines to itself: the owner gets one of
them, the rest goes on by way of any owner, so that no owner holds a key that a third of all lines share. Under a key every
later line takes the earliest partner that lengths and counts of characters allow, and is measured by a banded bit-parallel
edit distance on its text; only lines for which that one fails take the others, too.

A key with more members than a block holds is crowded. There all are measured against the earliest first, which settles a group of near
copies at a comparison per line. The rest is filed anew: lines within k edits differ by 2 k in their counts of characters at most, so of
2 k + 1 groups of counts one is the same in both. What is crowded still is cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import release
from .common import partitions, stored, tidy
from .words import mix

#: Lines of fewer code points, without white space around, have no near copies.
LEAST = 30
#: Edits between near copies at most.
EDITS = 2
#: Characters are counted in so many classes.
BINS = 32
#: File entries that one task owns on average; members of a key that one task compares with as many others.
PER_OWNER, BLOCK = 100_000, 1024
#: Lines of a key in one message above which they don't go to the owner.
OFTEN = 16
#: Members of keys and pairs that one call takes on average, and pairs that it holds at once.
PER_SHARD, PAIRS_PER_SHARD, PAIRS = 20_000, 4_000_000, 1_000_000
#: Lines that are looked up by a broadcast at most: 16 bytes each and 48 for a document, so 64 MB at most.
BROADCAST_LINES = 1_000_000
#: Crowded keys that are broadcast at most (16 bytes each).
BROADCAST_KEYS = 1_000_000

_WHITE = " \t\n\x0b\x0c\r"
_BASE = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    name = str(base)
    if name not in _powers or len(_powers[name]) < n:
        _powers[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(1 << 16, 2 * n), base)]), dtype=np.uint64)
    return _powers[name][:n]


def lines_of(text: str, least: int = LEAST) -> list[tuple[int, str]]:
    """(number, content without white space around) of the lines of at least so many code points."""
    return [(i, s) for i, line in enumerate(text.split("\n")) if len(s := line.strip(_WHITE)) >= least]


def _hash(line: str) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    return x >> 64, x & ((1 << 64) - 1)


def within(a: str, b: str, limit: int) -> bool:
    """Whether at most `limit` edits turn one line into the other: equal ends are dropped, then a band of bits slides over the rest."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > limit:
        return False
    start = 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    start = max(0, start - limit)  # the band needs as many rows as it is wide to one side
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    m = len(a)
    if m < limit:
        return len(b) <= limit or _plain(a, b) <= limit
    full = (1 << (2 * limit + 1)) - 1
    low = 1 << (2 * limit)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score = full >> limit << limit, 0, limit
    for j, c in enumerate(b):
        rows = where.get(c, 0)
        same = (rows >> (j - limit) if j >= limit else rows << (limit - j)) & full
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        right, left = (down | ~(diagonal | up)) & full, diagonal & up
        if j + limit < m:
            score += not diagonal & low
        else:
            bit = m - (j + 1) + limit
            score += (right >> bit & 1) - (left >> bit & 1)
        up, down = (left | ~(diagonal >> 1 | right)) & full, diagonal >> 1 & right
    return score <= limit


def _plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _lines(least: int):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per compared line: its place, its hash, its length and its counts of characters."""
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, no, high, low, length = [], [], [], [], []
                kept = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    for n, line in lines_of(text, least):
                        h, lo = _hash(line)
                        row.append(i)
                        no.append(n)
                        high.append(h)
                        low.append(lo)
                        length.append(len(line))
                        kept.append(line)
                codes = np.frombuffer("".join(kept).encode("utf-32-le", "surrogatepass"), np.uint32)
                cell = (np.repeat(np.arange(len(kept)), length) * BINS) + (codes * np.uint32(2654435761) >> np.uint32(27))
                # a capped count keeps the difference of two a lower bound
                bags = np.minimum(np.bincount(cell, minlength=len(kept) * BINS), 255).astype(np.uint8).reshape(-1, BINS) if kept else np.zeros((0, BINS), np.uint8)
                take = pa.array(row, pa.int64())
                yield pa.record_batch(
                    [part.column("id").take(take), part.column("th").take(take), pa.array(no, pa.int32()), pa.array(np.array(high, np.uint64).view(np.int64)), pa.array(np.array(low, np.uint64).view(np.int64)), pa.array(length, pa.int32()), pa.array([b.tobytes() for b in bags], pa.binary())],
                    ["id", "th", "no", "ref", "low", "length", "bag"],
                )

    return lines


def segment_keys(lengths: np.ndarray, starts: np.ndarray, prefix: np.ndarray, edits: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """File entries and probes, as (key, line number) arrays. prefix: hash sums before each character; starts: of the lines."""
    back = _power(_BACK, len(prefix))
    parts = edits + 1
    entries, probes = [], []
    every = np.arange(len(lengths))

    def key(line: np.ndarray, a: np.ndarray, size: np.ndarray, length: np.ndarray, part: int) -> np.ndarray:
        left = starts[line] + a
        content = (prefix[left + size] - prefix[left]) * back[left]
        return mix(content ^ mix((length.astype(np.uint64) << np.uint64(8)) + np.uint64(part + 1)))

    for part in range(parts):
        a = part * lengths // parts
        entries.append((key(every, a, (part + 1) * lengths // parts - a, lengths, part), every))
    for less in range(edits + 1):
        line = np.flatnonzero(lengths - less >= LEAST)
        length = lengths[line] - less
        for part in range(parts):
            p = part * length // parts
            size = (part + 1) * length // parts - p
            low = np.maximum(p - part, p + less - (edits - part))
            high = np.minimum(p + part, p + less + (edits - part))
            for step in range(2 * edits + 1):
                a = low + step
                ok = (a <= high) & (a >= 0) & (a + size <= lengths[line])
                if ok.any():
                    probes.append((key(line[ok], a[ok], size[ok], length[ok], part), line[ok]))
    join = lambda x: (np.concatenate([k for k, _ in x]), np.concatenate([n for _, n in x]))
    return join(entries), join(probes)


def _exchange(owners: int, edits: int, most: int):
    bits = owners.bit_length() - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        held = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for side in (0, 1):
                if found[side]:
                    keys, refs = (np.concatenate([x[i] for x in found[side]]) for i in (0, 1))
                    order = np.argsort(keys, kind="stable")
                    keys, refs = keys[order], refs[order]
                    owner = (keys >> np.uint64(64 - bits)).astype(np.int64)
                    short = (keys >> np.uint64(32 - bits)).astype(np.uint32)
                    new = np.ones(len(keys), bool)
                    new[1:] = (owner[1:] != owner[:-1]) | (short[1:] != short[:-1])
                    size = np.diff(np.flatnonzero(new), append=len(keys))
                    often = np.repeat(size > most, size)
                    for part in np.array_split(np.flatnonzero(often), -(-int(often.sum()) // 65536) or 1):
                        if len(part):
                            full = (owner[part].astype(np.uint64) << np.uint64(32)) | short[part]
                            rows.append({"owner": int(mix(refs[part[:1]])[0] >> np.uint64(64 - bits)), "side": side + 2, "keys": full.tobytes(), "refs": refs[part].tobytes()})
                    sent = ~often | new
                    owner, short, refs = owner[sent], short[sent], refs[sent]
                    cuts = np.searchsorted(owner, np.arange(owners + 1)).tolist()
                    rows += [{"owner": i, "side": side, "keys": short[a:b].tobytes(), "refs": refs[a:b].tobytes()} for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            found[0], found[1] = [], []
            return pa.RecordBatch.from_pylist(rows, pa.schema([("owner", pa.int32()), ("side", pa.int8()), ("keys", pa.binary()), ("refs", pa.binary())]))

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                lines, refs = [], []
                for text in texts[at : at + 256]:
                    for _, line in lines_of(text):
                        ref = _hash(line)[0]
                        if ref not in seen:
                            seen.add(ref)
                            lines.append(line)
                            refs.append(ref)
                if not lines:
                    continue
                lengths = np.fromiter(map(len, lines), np.int64, len(lines))
                codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * _power(_BASE, len(codes)), dtype=np.uint64)])
                ref = np.array(refs, np.uint64)
                for side, (keys, line) in enumerate(segment_keys(lengths, np.cumsum(lengths) - lengths, prefix, edits)):
                    found[side].append((keys, ref[line]))
                    held += len(keys)
                if held > 1_000_000:
                    held = 0
                    yield flush()
        yield flush()

    return send


def _meet(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
    """Members (key, side, ref) of the keys that a file entry and a probe of different lines share; sides 2 and 3 pass as they are."""
    both = []
    for side in (0, 1):
        rows = sent[sent["side"] == side]
        keys, refs = np.frombuffer(b"".join(rows["keys"]), np.uint32), np.frombuffer(b"".join(rows["refs"]), np.uint64)
        order = np.lexsort((refs, keys))
        keys, refs = keys[order], refs[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (refs[1:] != refs[:-1])
        both.append((keys[new], refs[new]))
    (fk, fr), (pk, pr) = both
    lo, hi = np.searchsorted(fk, pk, "left"), np.searchsorted(fk, pk, "right")
    other = (hi - lo > 1) | ((hi - lo == 1) & (fr[np.minimum(lo, max(0, len(fr) - 1))] != pr if len(fr) else False))
    probe_keys, probe_refs = pk[other], pr[other]
    back = np.isin(fk, probe_keys)
    out_keys, out_refs = np.concatenate([fk[back], probe_keys]), np.concatenate([fr[back], probe_refs])
    side = np.concatenate([np.zeros(int(back.sum()), np.int8), np.ones(len(probe_keys), np.int8)])
    out = [((np.int64(key[0]) << np.int64(32)) | out_keys.astype(np.int64), side, out_refs.view(np.int64))]
    for kind in (2, 3):
        for keys, refs in sent.loc[sent["side"] == kind, ["keys", "refs"]].itertuples(index=False):
            out.append((np.frombuffer(keys, np.int64), np.full(len(keys) // 8, kind, np.int8), np.frombuffer(refs, np.int64)))
    return pd.DataFrame({name: np.concatenate([x[i] for x in out]) for i, name in enumerate(("key", "side", "ref"))})


def _partners(edits: int, every: bool):
    """For each later line that is open the earliest partner under a key's block that lengths and characters allow, or all of them.

    A group is a shard of many blocks, so that small ones cost no call each; pairs are taken PAIRS at a time.
    """

    def partners(rows: pa.Table) -> pa.Table:
        names = ("key", "i", "j", "side", "line", "rank", "length", "open")
        key, i, j, side, line, rank, length, still = (rows.column(c).to_numpy() for c in names)
        order = np.lexsort((side, j, i, key))
        key, i, j, side, line, rank, length, still = (x[order] for x in (key, i, j, side, line, rank, length, still))
        bags = np.frombuffer(b"".join(rows.column("bag").to_pylist()), np.uint8).reshape(-1, BINS)[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        start = np.flatnonzero(new)
        size = np.diff(start, append=len(key))
        filed = np.add.reduceat(side == 0, start)
        total = filed * (size - filed)
        start, filed, probing, total = (x[total > 0] for x in (start, filed, size - filed, total))
        found = [np.zeros((3, 0), np.int64)]
        ends = np.cumsum(total)
        a = 0
        while a < len(total):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - total[a] + PAIRS, "right")))
            own = np.repeat(np.arange(a, b), total[a:b])
            inside = np.arange(len(own)) - np.repeat(np.cumsum(total[a:b]) - total[a:b], total[a:b])
            f, p = start[own] + inside // probing[own], start[own] + filed[own] + inside % probing[own]
            less = length[p] - length[f]
            ok = (less >= 0) & (less <= edits) & (line[f] != line[p])
            f, p = f[ok], p[ok]
            ok = still[np.where(rank[f] < rank[p], p, f)]
            f, p = f[ok], p[ok]
            ok = np.abs(bags[f].astype(np.int16) - bags[p]).sum(axis=1) <= 2 * edits
            f, p = f[ok], p[ok]
            first = rank[f] < rank[p]
            found.append(np.stack([np.where(first, line[p], line[f]), np.where(first, line[f], line[p]), np.where(first, rank[f], rank[p])]))
            a = b
        later, earlier, at = np.concatenate(found, axis=1)
        order = np.lexsort((at, later))
        later, earlier = later[order], earlier[order]
        keep = np.ones(len(later), bool)
        keep[1:] = (later[1:] != later[:-1]) | (every & (earlier[1:] != earlier[:-1]))
        return pa.table({"later": later[keep], "earlier": earlier[keep]})

    return partners


def _sift(edits: int):
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs that lengths and counts of characters allow."""
        for batch in batches:
            near = np.abs(batch.column("length").to_numpy() - batch.column("length2").to_numpy()) <= edits
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for c in ("bag", "bag2"))
            yield batch.select(["later", "earlier"]).filter(pa.array(near & (np.abs(a - b).sum(axis=1) <= 2 * edits)))

    return sift


def _counted(bag: str, group: int, groups: int) -> Column:
    """The counts of one of so many groups of classes."""
    a, b = group * BINS // groups, (group + 1) * BINS // groups
    return F.substring(F.col(bag), a + 1, b - a)


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of documents that `wanted` names by number."""
    for batch in batches:
        names, lines = [], []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            found = dict(lines_of(text))
            for w in wanted:
                names.append(w["line"])
                lines.append(found[w["no"]])
        yield pa.record_batch([pa.array(names, pa.int64()), pa.array(lines, pa.string())], ["line", "content"])


def _measure(edits: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [within(a, b, edits) for a, b in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("later"), batch.column("earlier"), pa.array(near, pa.bool_())], ["later", "earlier", "near"])

    return measure


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n, gone = [], [], []
        for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist(), strict=True):
            lines = (text or "").split("\n")
            out = set(drop or ())
            texts.append(text if not out else "\n".join(line for i, line in enumerate(lines) if i not in out))
            n.append(len(lines))
            gone.append(len(out))
        rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("text", "drop")]
        names = [name for name in batch.schema.names if name not in ("text", "drop")]
        yield pa.record_batch([*rest, pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*names, "text", "n_lines", "n_removed"])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, shorter: bool = False) -> DataFrame:
    """(id, th, no): the lines that go, by document id, xxhash64 of the document's text, and line number from 0.

    See `without_repeated_lines` for which lines go.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").withColumn("th", F.xxhash64("text"))
    spark, kind = docs.sparkSession, source.schema["id"].dataType
    fields = [T.StructField("id", kind), T.StructField("th", T.LongType()), T.StructField("no", T.IntegerType()), T.StructField("ref", T.LongType()), T.StructField("low", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("bag", T.BinaryType())]
    lines = stored(source.mapInArrow(tidy(_lines(1 if shorter else LEAST)), T.StructType(fields)))
    place = F.struct(F.col("id").isNull().alias("z"), "id", "th", "no")
    first = lines.groupBy("ref", "low").agg(F.count("*").alias("c"), F.min(F.struct(place.alias("place"), "length", "bag")).alias("f"))
    first = stored(first.select("ref", "low", "c", "f.place", "f.length", "f.bag"))

    owners = 1 << max(4, (3 * first.where(F.col("length") >= LEAST).count() // PER_OWNER).bit_length())
    sent = source.select("text").mapInArrow(tidy(_exchange(owners, edits, OFTEN)), "owner int, side byte, keys binary, refs binary")
    met = stored(sent.repartition(owners, "owner").groupBy("owner").applyInPandas(_meet, "key long, side byte, ref long"))
    release(spark)
    met = met.where("side < 2").unionByName(met.where("side > 1").select("key", (F.col("side") - 2).cast("byte").alias("side"), "ref").distinct())
    # numbers for the lines that meet any other, in the order of their first places; a rank decides which of two is later
    known = met.select("ref").distinct().join(first, "ref").select("ref", "low", "place", "length", "bag")
    known = stored(known.withColumn("line", F.monotonically_increasing_id()))
    ranked = stored(_ranked(known.select("line", "place"), kind))
    known = known.join(ranked, "line")
    release(spark)

    def measured(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs)
        named = stored(pairs.select(F.explode(F.array("later", "earlier")).alias("line")).distinct().join(known.select("line", "place"), "line"))
        wanted = named.groupBy(F.col("place.id").alias("id"), F.col("place.th").alias("th")).agg(F.collect_set(F.struct("line", F.col("place.no").alias("no"))).alias("wanted"))
        wanted = F.broadcast(wanted) if named.count() <= BROADCAST_LINES else wanted
        held = source.alias("s").join(wanted.alias("w"), F.col("s.id").eqNullSafe(F.col("w.id")) & (F.col("s.th") == F.col("w.th"))).select("s.text", "w.wanted")
        content = held.mapInArrow(tidy(_pick), "line long, content string").groupBy("line").agg(F.min("content").alias("content"))
        content = stored(content)
        joined = pairs.join(content.select(F.col("line").alias("later"), F.col("content").alias("x")), "later").join(content.select(F.col("line").alias("earlier"), F.col("content").alias("y")), "earlier")
        return stored(joined.select("later", "earlier", "x", "y").mapInArrow(tidy(_measure(edits)), "later long, earlier long, near boolean"))

    pair, fields = "later long, earlier long", ["line", "rank", "length", "bag"]
    side = lambda k: F.count(F.when(F.col("side") == k, 1))
    counts = stored(met.groupBy("key").agg(side(0).alias("f"), side(1).alias("p")))
    crowded = counts.where(F.col("f") + F.col("p") > BLOCK).select("key")
    n_crowded, work, n_pairs = counts.agg(F.count(F.when(F.col("f") + F.col("p") > BLOCK, 1)), F.sum(F.col("f") + F.col("p")), F.sum(F.col("f").cast("double") * F.col("p"))).first()
    members = met.join(known, "ref").select("key", "side", *fields)
    near = None
    if n_crowded:
        crowded = F.broadcast(crowded) if n_crowded <= BROADCAST_KEYS else crowded
        crowd = stored(members.join(crowded, "key", "left_semi"))
        hubs = stored(crowd.groupBy("key").agg(F.min(F.struct("rank", "line", "length", "bag")).alias("h")))
        hubs = hubs.select("key", *[F.col(f"h.{c}").alias(n) for c, n in (("line", "earlier"), ("length", "length2"), ("bag", "bag2"))])
        first_tries = crowd.join(hubs, "key").where("line != earlier").select(F.col("line").alias("later"), "earlier", "length", "length2", "bag", "bag2")
        near = stored(measured(first_tries.mapInArrow(tidy(_sift(edits)), pair).distinct()).where("near").select("later").distinct())
        release(spark)
        still = crowd.join(near.select(F.col("later").alias("line"), F.lit(False).alias("open")), "line", "left").withColumn("open", F.coalesce("open", F.lit(True)))
        groups = 2 * edits + 1
        filed = still.withColumn("key", F.explode(F.array(*[F.xxhash64("key", F.lit(g), _counted("bag", g, groups)) for g in range(groups)])))
        sizes = filed.groupBy("key").agg(side(0).alias("f"), side(1).alias("p"), F.max("open").alias("any")).where("f > 0 and p > 0 and f + p > 1 and any")
        sizes = stored(sizes.select("key", "f", "p", F.ceil((F.col("f") + F.col("p")) / BLOCK).cast("int").alias("blocks")))
        filed = filed.join(sizes.select("key", "blocks"), "key").select("key", "side", *fields, "open", "blocks")
        more = sizes.agg(F.sum(F.col("blocks") * (F.col("f") + F.col("p"))), F.sum(F.col("f").cast("double") * F.col("p"))).first()
        work, n_pairs = work + (more[0] or 0), n_pairs + (more[1] or 0)
        members = members.join(crowded, "key", "left_anti").select("*", F.lit(True).alias("open"), F.lit(1).alias("blocks")).unionByName(filed)
    else:
        members = members.select("*", F.lit(True).alias("open"), F.lit(1).alias("blocks"))
    shards = max(2 * partitions(spark), 1 + int(work or 0) // PER_SHARD, 1 + int(n_pairs or 0) // PAIRS_PER_SHARD)
    members = (
        members.withColumn("block", F.pmod(F.xxhash64("line"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.when(F.col("side") == 0, F.col("block")).otherwise(F.col("other")), "j": F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("block"))})
        .withColumn("shard", F.pmod(F.xxhash64("key", "i", "j"), F.lit(shards)).cast("int"))
        .select("shard", "key", "i", "j", "side", *fields, "open")
    )
    tried = measured(members.groupBy("shard").applyInArrow(_partners(edits, False), pair).distinct())
    release(spark)
    found = tried.where("near").select("later").distinct()
    near = found if near is None else near.union(found).distinct()
    open_lines = stored(tried.select("later").distinct().join(near, "later", "left_anti").withColumnRenamed("later", "line"))
    if not open_lines.isEmpty():
        open_keys = stored(members.join(open_lines, "line", "left_semi").select("key").distinct())
        rest = members.drop("open").join(open_keys, "key", "left_semi").join(open_lines.withColumn("open", F.lit(True)), "line", "left").withColumn("open", F.coalesce("open", F.lit(False)))
        rest = rest.groupBy("shard").applyInArrow(_partners(edits, True), pair).distinct().join(tried, ["later", "earlier"], "left_anti")
        near = near.union(measured(rest).where("near").select("later")).distinct()

    near = stored(near)
    release(spark)
    flagged = known.join(near, F.col("line") == F.col("later"), "left_semi").select("ref", "low", F.lit(True).alias("near"))
    goes = first.select("ref", "low", "c", "place").join(flagged, ["ref", "low"], "left").where("c > 1 or near")
    return lines.select("id", "th", "no", "ref", "low").join(stored(goes), ["ref", "low"]).where(F.coalesce("near", F.lit(False)) | ~(F.struct(F.col("id").isNull().alias("z"), "id", "th", "no").eqNullSafe(F.col("place")))).select("id", "th", "no").distinct()


def _ranked(lines: DataFrame, kind: T.DataType) -> DataFrame:
    """(line, rank): the order of the places, without sorting them in one task."""
    cut = lines.repartitionByRange("place").sortWithinPartitions("place")
    return cut.select("line", F.monotonically_increasing_id().alias("rank"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, shorter: bool = False) -> DataFrame:
    """`docs` with its columns, `text_col` without repeated lines, and n_lines, n_removed (a clash replaces the column of `docs`).

    A line is what lies between line feeds; without white space around it must have LEAST code points. It goes, with its line feed,
    if an equal line or one within `edits` edits stands before it: in a document of smaller id, or in the same one above. Shorter
    lines stay, or if `shorter` go where an equal one stands before them; blank lines always stay. Documents of one id come in the order of a hash of their text; rows with equal id and text are one
    document and are treated alike. Null ids come last. Null text stays null and has one line. A document may be left with an
    empty text. An empty table gives an empty result.
    """
    drop = repeated_lines(docs, id_col, text_col, edits, shorter).groupBy("id", "th").agg(F.collect_set("no").alias("drop"))
    others = [c for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_removed")]
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("th"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    joined = named.alias("a").join(stored(drop).alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.th") == F.col("b.th")), "left").select("a.id", "a.text", *[f"a.c{i}" for i in range(len(others))], "b.drop")
    kept = [f for f in joined.schema if f.name not in ("text", "drop")]
    out = joined.mapInArrow(tidy(_rebuild), T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]))
    names = {"id": id_col, "text": text_col} | {f"c{i}": c for i, c in enumerate(others)}
    ordered = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    back = {v: k for k, v in names.items()}
    return out.select(*[F.col(back[c]).alias(c) for c in ordered], "n_lines", "n_removed")
