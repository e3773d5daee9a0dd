"""Near-duplicates: b-bit MinHash signatures joined under a Hamming threshold by a multi-index, links confirmed on full sets.

A document's set holds the distinct five-word shingles; equal sets form a class. A class's signature has CHUNKS * WIDTH
components of 16 bits, the low bits of as many minima. Signatures that differ in at most `2 * CHUNKS - 1` components agree, by
pigeonhole, in some chunk but for at most one component; so every class is filed under each chunk with each one component left
out, and such a pair always meets under one of these keys. Two sets of similarity s differ in 30 * (1 - s) components on
average: at 0.85 in 4.5, and the chance that a pair meets under none of the 30 keys is 2e-5; at 0.8 it is 3e-4.

Pairs are not listed by key. First every member of a key is compared with the key's hub, the member that meets most others under
its keys; in a group of edited copies that is the text they were made from. However large such a group is, it costs as many
comparisons as it has members. A comparison also gives the difference: which shingles of the hub the member lacks, and which it has
besides. What is linked is joined to components. Only keys whose members still belong to more than one component are opened, in
blocks of bounded size. The differences to the common hub are whole sets in short, so within a block the intersections of all
members follow exactly from one matrix product; of the links found only those that join two components leave the block. So
no pair is a row: a block sends fewer links than it has members. A key with more members than a block holds is not cut into
pairs of blocks, which would copy its members to each other: they are filed under rare differences to the hub that linked sets must
share (`_alike`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import release
from .common import stored, tidy
from .components import components
from .words import mix, shingle_set, exact_words

CHUNKS, WIDTH = 6, 5
COMPONENTS = CHUNKS * WIDTH
#: Texts that are looked up by a broadcast of their hashes at most (16 bytes each); more are joined by a shuffle.
BROADCAST_TEXTS = 1_000_000
#: Members of a key that one task compares with as many others.
BLOCK = 512
#: Shingles that one matrix of a block has as columns.
COLUMNS = 8192

_SEEDS = mix(np.arange(1, 2 * COMPONENTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _ODD = _SEEDS[:COMPONENTS], _SEEDS[COMPONENTS:] | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Components of 16 bits; a shingle set must not be empty. Large sets are taken in parts."""
    least = np.full(COMPONENTS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        least = np.minimum(least, ((shingles[i : i + 4096, None] ^ _XOR) * _ODD).min(axis=0))
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        sizes, digests, sigs = [], [], []
        names = [hashlib.md5(t.as_buffer().to_pybytes()).digest() for t in batch.column("text")]
        for words in exact_words(batch.column("text")):
            s = shingle_set(words)
            sizes.append(len(s))
            digests.append(_digest(s) if len(s) else None)
            sigs.append(signature(s).tobytes() if len(s) else None)
        rows = np.arange(row, row + len(sizes), dtype=np.int64)
        row += len(sizes)
        yield pa.record_batch([pa.array(rows), batch.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(names, pa.binary())], ["row", "id", "n", "digest", "sig", "name"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
        found = []
        for c in range(CHUNKS):
            for out in range(WIDTH):
                key = np.zeros(len(sigs), np.uint64)
                for j in range(WIDTH):
                    if j != out:
                        key = (key << np.uint64(16)) | sigs[:, c, j]
                found.append(mix(mix(key) + np.uint64(c * WIDTH + out + 1)))
        keys = np.stack(found, 1).ravel().view(np.int64)
        yield pa.record_batch([pa.array(keys), pa.array(np.repeat(batch.column("cid").to_numpy(), COMPONENTS))], ["key", "cid"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the sets of a hub's text x and a member's y: sizes of intersection and union, the ranks in x that y lacks, what y adds."""
    for batch in batches:
        both, either, lacks, adds = [], [], [], []
        for x, y in zip(exact_words(batch.column("x")), exact_words(batch.column("y")), strict=True):
            p, q = shingle_set(x), shingle_set(y)
            gone = np.flatnonzero(~np.isin(p, q, assume_unique=True))
            new = np.setdiff1d(q, p, assume_unique=True)
            both.append(len(p) - len(gone))
            either.append(len(p) + len(new))
            lacks.append(gone.astype(np.uint32).tobytes())
            adds.append(new.tobytes())
        yield pa.record_batch([batch.column("hub"), batch.column("cid"), pa.array(both, pa.int64()), pa.array(either, pa.int64()), pa.array(lacks, pa.binary()), pa.array(adds, pa.binary())], ["hub", "cid", "both", "either", "lacks", "adds"])


def _common(parts: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values the parts `left` and `right` have in common, by pair; values are taken COLUMNS at a time."""
    values, column, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    often = np.cumsum(counts > 1) - 1  # a value of one part is common to none
    keep = counts[column] > 1
    row, column = np.repeat(np.arange(len(parts)), [len(x) for x in parts])[keep], often[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int((counts > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        table = np.zeros((len(parts), COLUMNS), np.float32)
        table[row[a:b], column[a:b] - first] = 1
        out += table[left] @ table[right].T
    return np.rint(out).astype(np.int64)


def _across(percent: int):
    def across(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        i, j = int(key[2]), int(key[3])
        block, cid, root, n = (members[c].to_numpy() for c in ("block", "cid", "root", "n"))
        lacks = [np.frombuffer(x, np.uint32) for x in members["lacks"]]
        adds = [np.frombuffer(x, np.uint64) for x in members["adds"]]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        # |x and y| = |hub| - |lacked by x or y| + |added by both|
        lacked = np.array([len(x) for x in lacks])
        hub = n - np.array([len(x) for x in adds]) + lacked
        either = lacked[left][:, None] + lacked[right] - _common(lacks, left, right)
        both = hub[0] - either + _common(adds, left, right)
        linked = (100 * both >= percent * (n[left][:, None] + n[right] - both)) & (root[left][:, None] != root[right])
        top: dict[int, int] = {}

        def find(r: int) -> int:
            while top.get(r, r) != r:
                r = top[r]
            return r

        links = []
        for a, b in zip(*np.nonzero(linked), strict=True):
            p, q = find(int(root[left[a]])), find(int(root[right[b]]))
            if p != q:
                top[max(p, q)] = min(p, q)
                links.append((cid[left[a]], cid[right[b]]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return across


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle in which a member differs from its hub; the number of them, and the sizes of both sets."""
    for batch in batches:
        lacks = [np.frombuffer(x, np.uint32) for x in batch.column("lacks").to_pylist()]
        adds = [np.frombuffer(x, np.uint64) for x in batch.column("adds").to_pylist()]
        lost, new = np.array([len(x) for x in lacks]), np.array([len(x) for x in adds])
        n = batch.column("n").to_numpy()
        each = np.array(np.repeat(np.arange(len(n)), lost + new))
        e = np.concatenate([np.zeros(0, np.uint64), *[p for x, y in zip(lacks, adds, strict=True) for p in (mix(x.astype(np.uint64) + np.uint64(1)), y)]])
        rows = batch.select(["hub", "cid", "root"]).take(pa.array(each))
        yield pa.record_batch([*rows.columns, pa.array((lost + new)[each]), pa.array(n[each]), pa.array((n - new + lost)[each]), pa.array(e.view(np.int64))], ["hub", "cid", "root", "d", "n", "nh", "e"])


def _alike(members: DataFrame, percent: int) -> DataFrame:
    """`members` of crowded hubs, filed under the differences to the hub that a linked pair must share: hub, key, cid, ..., blocks.

    With D the shingles in which a set differs from the hub, x and y differ in |Dx| + |Dy| - 2 |Dx & Dy| of them, and are linked when
    that is at most r (|x| + |y|), r = (1 - t) / (1 + t). So with s = |D| - r |x| they share at least (sx + sy) / 2 elements of D; and at
    least one, if not both are linked to the hub itself, which `components` has seen to. By that overlap o two sets meet in the rarest
    |D| - o + 1 of their elements. Sets are filed under these by levels of s: a set enters its own level and the lower ones in which a
    partner can be, as o is known best between sets of like s. Copies of a template that differ in their own ways share no rare
    element, and so are never compared. A group that is still crowded is cut into blocks.
    """
    t = percent / 100
    r = (1 - t) / (1 + t)
    rows = stored(members.select("hub", "cid", "root", "n", "lacks", "adds").mapInArrow(tidy(_elements), "hub long, cid long, root long, d long, n long, nh long, e long"))
    often = stored(rows.groupBy("hub", "e").agg(F.count("*").alias("df")))
    s, step = F.col("d") - r * F.col("n"), F.greatest(F.lit(1.0), r * F.col("nh"))
    ranked = rows.join(often, ["hub", "e"]).withColumn("place", F.row_number().over(Window.partitionBy("hub", "cid").orderBy("df", "e"))).where("df > 1")
    levels = F.sequence(F.floor((s - 2 * r / t * F.col("n")) / step), F.floor(s / step))
    filed = ranked.withColumns({"s": s, "step": step, "level": F.explode(levels)})
    filed = filed.where(F.col("place") <= F.col("d") + 1 - F.greatest(F.lit(1), F.ceil((F.col("level") * F.col("step") + F.col("s")) / 2 - 1e-6)))
    filed = stored(filed.select("hub", F.xxhash64("level", "e").alias("key"), "cid", "root"))
    crowds = filed.groupBy("hub", "key").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    return filed.drop("root").join(crowds.select("hub", "key", "c"), ["hub", "key"]).join(members, ["hub", "cid"]).select("hub", "key", "cid", "root", "n", "lacks", "adds", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per row of `docs`: id_col, n_shingles, component_id (smallest id reachable, itself included), kept.

    Two rows are linked when 100 * intersection >= percent * union of their sets of distinct five-word shingles; words are runs
    outside `[\\x20\\x09-\\x0D]` with A-Z lower-cased. Fewer than five words make one shingle of all of them; null, empty and
    blank texts have an empty set and are linked with nothing. A null id counts as larger than any other. Repeated rows are
    copies of each other and share an id, a component and `kept`. Other columns are ignored; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("text", F.coalesce("text", F.lit("")))
    kind = source.schema["id"].dataType
    rows = stored(source.mapInArrow(tidy(_signatures), T.StructType([T.StructField("row", T.LongType()), T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("name", T.BinaryType())])))
    classes = stored(rows.where("n > 0").groupBy("digest", "sig", "n").agg(F.min("row").alias("cid")).join(rows.select(F.col("row").alias("cid"), "name"), "cid"))
    filed = classes.select("cid", "sig").mapInArrow(tidy(_keys), "key long, cid long")
    crowds = filed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    crowded = stored(filed.join(crowds, "key").select("key", "cid", "c"))
    shared = crowded.drop("c")
    fame = crowded.groupBy("cid").agg(F.sum("c").alias("fame"))
    hubs = shared.join(fame, "cid").groupBy("key").agg(F.max_by("cid", "fame").alias("hub"))
    members = stored(shared.join(stored(hubs), "key").select("key", "cid", "hub"))

    del filed, crowds, crowded, shared, fame, hubs
    release(docs.sparkSession)
    names = F.unhex(F.md5("text"))
    pairs = stored(members.where("cid != hub").select("hub", "cid").distinct())
    wanted = stored(pairs.select(F.explode(F.array("hub", "cid")).alias("cid")).distinct().join(classes.select("cid", "name"), "cid"))
    found = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
    # one text for each class: only texts that are compared are moved, found by their hashes
    texts = source.select(names.alias("name"), "text").join(found, "name").groupBy("cid", "text").agg(F.lit(1)).select("cid", "text")
    joined = pairs.join(texts.select(F.col("cid").alias("hub"), F.col("text").alias("x")), "hub").join(texts.select("cid", F.col("text").alias("y")), "cid")
    apart = stored(joined.select("hub", "cid", "x", "y").mapInArrow(tidy(_compare), "hub long, cid long, both long, either long, lacks binary, adds binary"))
    del wanted, found, texts, joined
    release(docs.sparkSession)
    links = apart.where(f"100 * both >= {percent} * either").select(F.col("hub").alias("a"), F.col("cid").alias("b"))
    joined = components(links)

    placed = stored(members.join(joined, F.col("cid") == F.col("node"), "left").select("key", "cid", "hub", F.coalesce("root", "cid").alias("root")))
    opened = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo != hi and c > 2").select("key", "c")
    # the hub has been compared with all; members of its keys that fit in one block are one group, each of them once
    narrow = stored(placed.where("cid != hub").join(stored(opened), "key").select("hub", "key", "cid", "root", "c"))
    hubs = stored(narrow.groupBy("hub").agg(F.count_distinct("cid").alias("h")))
    narrow = narrow.join(hubs, "hub")

    def whole(rows: DataFrame) -> DataFrame:
        return rows.join(classes.select("cid", "n"), "cid").join(apart.select("hub", "cid", "lacks", "adds"), ["hub", "cid"])

    few = narrow.where(F.col("h") <= BLOCK).select("hub", F.lit(0).cast("long").alias("key"), "cid", "root").distinct()
    few = whole(few.unionByName(narrow.where((F.col("h") > BLOCK) & (F.col("c") <= BLOCK)).select("hub", "key", "cid", "root")))
    few = few.select("hub", "key", "cid", "root", "n", "lacks", "adds", F.lit(1).alias("blocks"))
    many = stored(whole(narrow.where((F.col("h") > BLOCK) & (F.col("c") > BLOCK)).select("hub", "cid", "root").distinct()).select("hub", "cid", "root", "n", "lacks", "adds"))
    if not many.isEmpty():
        few = few.unionByName(_alike(many, percent))
    blocks = (
        few.withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        .select("hub", "key", "i", "j", "block", "cid", "root", "n", "lacks", "adds")
    )
    second = stored(blocks.groupBy("hub", "key", "i", "j").applyInPandas(_across(percent), "a long, b long").distinct())
    del placed, opened, narrow, hubs, few, many, blocks, members, joined
    release(docs.sparkSession)
    joined = components(links.union(second))

    placed = rows.join(classes.select("digest", "cid"), "digest", "left").join(joined, F.col("cid") == F.col("node"), "left").select("row", "id", "n", F.coalesce("root", "cid").alias("root"))
    placed = stored(placed)
    least = stored(placed.where("root is not null").groupBy("root").agg(F.min("id").alias("least")))
    out = placed.join(least, "root", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
