"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Every input partition, in parts of PER_PART rows, hashes its normalised texts to 64 bits and sends each owner of a hash range its sorted distinct
hashes, Rice-coded (Golomb with a power of two). An owner answers every partition with a bitmap: bit i says that the i-th
hash was also sent by another partition. A partition adds what is repeated within itself; rows whose hash is marked are
suspects. Only suspects' texts are shuffled: they are grouped by their bytes, copies first within each task, and a class
counts only as far as its bytes agree.

What moves per row: about three bytes of code, one bit of answer and a narrow row; texts move for suspects alone. A group of
copies sends one hash from each partition, however large it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import SPACE, stored, tidy

#: Fingerprints that one owner takes on average, and rows of an input partition that are answered together at most.
PER_OWNER, PER_PART = 1_000_000, 500_000
#: Suspect hashes that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_HASHES = 2_000_000


def rice_encode(values: np.ndarray, base: int) -> bytes:
    """Sorted distinct uint64 `values`, none below `base`, as Rice-coded gaps: parameter, count, unary part, remainders."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values, prepend=np.uint64(base))
    mean = max(1, (int(values[-1]) - base) // n)
    k = min(63, mean.bit_length() - 1)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1)
    unary = np.ones(int(ends[-1]), np.uint8)
    unary[ends - 1] = 0
    rest = (gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :]).astype(np.uint8) & 1
    return bytes([k]) + n.to_bytes(8, "little") + int(ends[-1]).to_bytes(8, "little") + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def rice_decode(blob: bytes, base: int) -> np.ndarray:
    """What `rice_encode` was given."""
    if not blob:
        return np.zeros(0, np.uint64)
    k, n, bits = blob[0], int.from_bytes(blob[1:9], "little"), int.from_bytes(blob[9:17], "little")
    cut = 17 + (bits + 7) // 8
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, offset=17, count=cut - 17), count=bits)
    quotient = np.diff(np.flatnonzero(unary == 0), prepend=-1) - 1
    gaps = quotient.astype(np.uint64) << np.uint64(k)
    if k:
        rest = np.unpackbits(np.frombuffer(blob, np.uint8, offset=cut), count=n * k).reshape(n, k)
        for j in range(k):
            gaps |= rest[:, j].astype(np.uint64) << np.uint64(j)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(base)


def owner_base(owner: int, owners: int) -> int:
    """The least hash of an owner's range."""
    return -(-(owner << 64) // owners)


def normalised(text: pa.Array) -> Iterator[bytes]:
    """Each text's UTF-8 bytes without the ignored characters; null counts as empty."""
    for value in text:
        raw = value.as_buffer()
        yield b"" if raw is None else raw.to_pybytes().translate(None, SPACE)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, rows = TaskContext.get().partitionId() << 24, 0
    for batch in batches:
        text = batch.column("text")
        own = part + rows // PER_PART  # so that a file that can't be split is no single group
        rows += len(text)
        fps, shas = [], []
        for raw in normalised(text):
            fps.append(xxhash.xxh3_64_intdigest(raw))
            shas.append(hashlib.sha256(raw).hexdigest())
        yield pa.record_batch(
            [
                pa.array(np.full(len(text), own, np.int64)),
                batch.column("id"),
                pa.array(np.array(fps, np.uint64).view(np.int64)),
                pc.fill_null(pc.utf8_length(text), 0).cast(pa.int64()),
                pa.array(shas, pa.string()),
            ],
            ["part", "id", "fp", "chars", "sha"],
        )


def _messages(owners: int):
    bases = np.array([owner_base(i, owners) for i in range(owners)], np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            part, fp = batch.column("part").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            for p in np.unique(part):
                seen.setdefault(int(p), []).append(fp[part == p])
        for p, found in seen.items():
            sent = np.unique(np.concatenate(found))
            cuts = np.append(np.searchsorted(sent, bases), len(sent))
            rows = [(i, p, rice_encode(sent[cuts[i] : cuts[i + 1]], int(bases[i]))) for i in range(owners) if cuts[i] < cuts[i + 1]]
            yield pa.RecordBatch.from_pylist([{"owner": i, "part": p, "code": code} for i, p, code in rows], pa.schema([("owner", pa.int32()), ("part", pa.int64()), ("code", pa.binary())]))

    return send


def _answers(owners: int):
    def answer(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
        base = owner_base(int(key[0]), owners)
        sets = [rice_decode(code, base) for code in sent["code"]]
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        shared = values[counts > 1]
        return pd.DataFrame({"part": sent["part"], "owner": int(key[0]), "bits": [np.packbits(np.isin(s, shared, assume_unique=True)).tobytes() for s in sets]})

    return answer


def _suspects(owners: int):
    bases = np.array([owner_base(i, owners) for i in range(owners)], np.uint64)

    def mark(rows: pa.Table, bitmaps: pa.Table) -> pa.Table:
        fp = rows["fp"].to_numpy().view(np.uint64)
        sent, where, counts = np.unique(fp, return_inverse=True, return_counts=True)
        flags = counts > 1
        cuts = np.append(np.searchsorted(sent, bases), len(sent))
        for owner, bits in zip(bitmaps["owner"].to_pylist(), bitmaps["bits"].to_pylist(), strict=True):
            a, b = cuts[owner], cuts[owner + 1]
            flags[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        return rows.drop_columns("part").append_column("suspect", pa.array(flags[where]))

    return mark


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raws = list(normalised(batch.column("text")))
        fps = np.array([xxhash.xxh3_64_intdigest(r) for r in raws], np.uint64).view(np.int64)
        yield pa.record_batch([pa.array(fps), pa.array(raws, pa.binary())], ["fp", "raw"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes agree after removal of `[\\x20\\x09-\\x0D]`; null counts as the empty text, so null and
    empty texts form one group. Of a group the row with the most code points in its original text stays, then the one with
    the smallest id; a null id comes after every other. Rows repeated with the same id are rows of their own and share
    `kept`. Other columns of `docs`, whatever their names, are ignored. An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType
    rows = stored(source.mapInArrow(tidy(_fingerprints), T.StructType([T.StructField("part", T.LongType()), T.StructField("id", kind), T.StructField("fp", T.LongType()), T.StructField("chars", T.LongType()), T.StructField("sha", T.StringType())])))
    owners = max(4, -(-rows.count() // PER_OWNER))
    bitmaps = rows.select("part", "fp").mapInArrow(tidy(_messages(owners)), "owner int, part long, code binary").groupBy("owner").applyInPandas(_answers(owners), "part long, owner int, bits binary")
    narrow = T.StructType([*(f for f in rows.schema if f.name != "part"), T.StructField("suspect", T.BooleanType())])
    marked = stored(rows.groupBy("part").cogroup(bitmaps.groupBy("part")).applyInArrow(_suspects(owners), narrow))
    suspects = marked.where("suspect")

    hashes = suspects.select("fp").distinct()
    if hashes.count() <= BROADCAST_HASHES:
        hashes = F.broadcast(hashes)
    texts = source.select("text").mapInArrow(tidy(_texts), "fp long, raw binary").join(hashes, "fp", "left_semi")
    classes = texts.groupBy("fp", "raw").count().select("fp", F.sha2("raw", 256).alias("sha"), F.col("count").alias("n"))
    best = suspects.groupBy("fp", "sha").agg(F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("z"), F.col("id").alias("id"))).alias("best"))
    verified = classes.join(best, ["fp", "sha"]).select("fp", "sha", "n", F.col("best.id").alias("keep"))
    # stored, so that both sides of the join are plain exchanges and Spark can split a group of copies that fills a task
    joined = suspects.join(stored(verified), ["fp", "sha"], "left").select("id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep"), F.coalesce("n", F.lit(1)).alias("n"), "sha")
    alone = marked.where("not suspect").select("id", F.col("id").alias("keep"), F.lit(1).cast("long").alias("n"), "sha")
    return joined.unionByName(alone).select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))
