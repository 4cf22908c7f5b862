"""Blocks of texts that ask buckets of keys about each other.

A block is one row with the texts of some neighbouring rows of a table, a few megabytes, written once
into a table that Spark keeps bucketed by block, so later passes read it without a shuffle.  In one
round every block sends its distinct keys, packed into one message per key bucket; a bucket sorts the
keys of all its messages and answers each with one bit per key; and the answers come back to the block
by a join on its number.  Keys are small hashes, so a round moves a few bytes per key and no text, and a
key that a third of all rows share arrives once per block.  A block may send itself what it knows so far
(``note``), which the next pass then has without finding it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import slices, utf8
from folioscope.session import fresh_folder

BLOCK_BYTES = 4 << 20
#: Bytes of packed keys that one bucket holds, about.
BUCKET_BYTES = 8 << 20
#: Text bytes that one task of a later pass reads, about.
TASK_BYTES = 24 << 20

BLOCK_SCHEMA = "block long, n_bytes long, ids binary, starts binary, data binary"
MESSAGE_SCHEMA = "bucket long, block long, n long, payload binary"
ANSWER_SCHEMA = "block long, bucket long, bits binary"

NO_ID = -(1 << 63)

#: Places that are hashed at a time.
_PART = 1 << 16


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def random_table(seed: int) -> np.ndarray:
    """A fixed 64-bit number for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)


def rolling(first: np.ndarray, length: int, base: int) -> np.ndarray:
    """Polynomial hashes of all windows of ``length`` places, put together from windows of powers of two."""
    power, size, whole, have = first, 1, None, 0
    while True:
        if length & size:
            whole, have = (power, size) if whole is None else (_joined(whole, power, have, size, base), have + size)
        if have == length:
            return whole
        power, size = _joined(power, power, size, size, base), 2 * size


def _joined(left: np.ndarray, right: np.ndarray, shift: int, power: int, base: int) -> np.ndarray:
    """Windows followed by other windows that start ``shift`` later and are ``power`` long."""
    n = max(min(len(left), len(right) - shift), 0)
    found = left[:n] * np.uint64(pow(base, power, 1 << 64))
    found += right[shift : shift + n]
    return found


def hashes_at(data: np.ndarray, places: np.ndarray | None, seed: int, base: int, length: int) -> np.ndarray:
    """The mixed hashes of the windows of ``length`` bytes that start at the sorted ``places`` (None: at
    all), a part of the text at a time that fits a processor's cache."""
    table = random_table(seed)
    total = max(len(data) - length + 1, 0)
    found = np.empty(total if places is None else len(places), np.uint64)
    for at in range(0, total, _PART):
        end = min(at + _PART, total)
        if places is None:
            a, b, inside = at, end, slice(None)
        else:
            a, b = np.searchsorted(places, (at, end))
            inside = places[a:b] - at
        if a < b:
            found[a:b] = mix64(rolling(table[data[at : end + length - 1]], length, base)[inside])
    return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, n = TaskContext.get().partitionId() << 32, 0
    for batch in slices(batches, 1, BLOCK_BYTES):
        data, starts = utf8(batch.column(1))
        ids = batch.column(0).fill_null(NO_ID).to_numpy()
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array([base + n]),
                "n_bytes": pa.array([len(data)]),
                "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
                "starts": pa.array([starts.astype(np.int64).tobytes()], pa.binary()),
                "data": pa.array([data.tobytes()], pa.binary()),
            }
        )
        n += 1


class Blocks:
    """The block table of a table of texts."""

    def __init__(self, documents: DataFrame, id_col: str, text_col: str):
        self.spark: SparkSession = documents.sparkSession
        texts = documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").alias("text"))
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        self.bytes = int(size)
        self.names: dict[str, str] = {}
        self.folders: dict[str, str] = {}
        self.bucketed(texts.mapInArrow(_blocks, BLOCK_SCHEMA), "blocks", "block")

    def bucketed(self, rows: DataFrame, label: str, key: str) -> DataFrame:
        """The rows, of about as many bytes as the texts at most, written once into a table bucketed by the key."""
        self.names[label] = f"{label}_{uuid.uuid4().hex}"
        self.folders[label] = fresh_folder(self.spark, label)
        writer = rows.write.format("parquet").option("compression", "zstd").option("path", self.folders[label])
        # Spark deals a bucketed table anew for a join if it has fewer buckets than a shuffle has partitions.
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        writer.bucketBy(max(least, 1 + self.bytes // TASK_BYTES), key).saveAsTable(self.names[label])
        return self.spark.table(self.names[label])

    def table(self) -> DataFrame:
        return self.spark.table(self.names["blocks"])

    def close(self) -> None:
        """Forgets the tables; their files belong to the shared folder."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def with_answers(self, rounds: list[DataFrame]) -> DataFrame:
        """The blocks with columns ``bits0``, ``bits1``, ... of each round's answers."""
        rows = self.table()
        for i, answers in enumerate(rounds):
            got = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias(f"bits{i}"))
            rows = rows.join(got, "block", "left")
        return rows.select("block", "ids", "starts", "data", *(f"bits{i}" for i in range(len(rounds))))


def texts_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, starts and bytes of a block row."""
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["starts"], np.int64), np.frombuffer(row["data"], np.uint8)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, as a block is large."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield {name: batch.column(i)[at].as_py() for i, name in enumerate(batch.schema.names)}


def pack(columns: list[np.ndarray]) -> bytes:
    """The columns byte plane by byte plane, which leaves sorted keys compressible."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)


def unpack(payload: bytes, n: int, kinds: list[type]) -> list[np.ndarray]:
    found, at = [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(payload, np.uint8, n * width, at).reshape(width, n)
        found.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * width
    return found


def messages(block: int, bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row per bucket; the keys must be sorted by bucket."""
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    names, ends = bucket[first], np.append(first[1:], len(bucket))
    payload = [pack([c[a:b] for c in columns]) for a, b in zip(first, ends, strict=True)]
    return pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array(names.astype(np.int64)),
            "block": pa.array(np.full(len(names), block, np.int64)),
            "n": pa.array((ends - first).astype(np.int64)),
            "payload": pa.array(payload, pa.binary()),
        }
    )


def note(block: int, payload: bytes) -> pa.RecordBatch:
    """A message of a block to itself, which comes back among the answers as it is."""
    row = {"bucket": -1 - block, "block": block, "n": 0, "payload": payload}
    kinds = {"bucket": pa.int64(), "block": pa.int64(), "n": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_pydict({name: pa.array([row[name]], kind) for name, kind in kinds.items()})


def noted(bits: list[dict]) -> bytes:
    return next(entry["bits"] for entry in bits if entry["bucket"] < 0)


def answered(bits: list[dict] | None, bucket: np.ndarray) -> np.ndarray:
    """The answers to the keys that a block sent, in the order it sent them."""
    found = np.zeros(len(bucket), bool)
    entries = [entry for entry in bits or [] if entry["bucket"] >= 0]
    # Of the keys' own type, and all at once: otherwise all keys are converted for every bucket.
    names = np.array([entry["bucket"] for entry in entries], bucket.dtype)
    edges = zip(np.searchsorted(bucket, names, "left").tolist(), np.searchsorted(bucket, names, "right").tolist(), strict=True)
    for entry, (a, b) in zip(entries, edges, strict=True):
        found[a:b] = np.unpackbits(np.frombuffer(entry["bits"], np.uint8), count=b - a).view(bool)
    return found


def answers(sent: DataFrame, kinds: list[type], judge: Callable[[list[np.ndarray], np.ndarray], np.ndarray]) -> DataFrame:
    """Each bucket's answers: ``judge(columns, message)`` gets the keys of all messages of a bucket and
    the number of the message of each, and returns a boolean per key."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": table.column("payload")})
        counts = table.column("n").to_numpy()
        columns = [unpack(p.as_py(), n, kinds) for p, n in zip(table.column("payload"), counts, strict=True)]
        merged = [np.concatenate([c[i] for c in columns]) for i in range(len(kinds))]
        bits = judge(merged, np.repeat(np.arange(len(counts)), counts))
        ends = np.cumsum(counts)
        packed = [np.packbits(bits[e - n : e]).tobytes() for e, n in zip(ends, counts, strict=True)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array(packed, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, ANSWER_SCHEMA)


def groups_of(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and where each run of equal ones starts in it."""
    order = np.argsort(keys[0])
    first = keys[0][order]
    same = first[1:] == first[:-1]
    for key in keys[1:]:
        # Equal first keys nearly always have equal other keys; if not, all keys are sorted by.
        if (same & (key[order][1:] != key[order][:-1])).any():
            order = np.lexsort(keys[::-1])
            same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
            break
    new = np.ones(len(order), bool)
    new[1:] = ~same
    return order, np.flatnonzero(new)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of 64-bit keys, which ascends with them."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def shared_elsewhere(columns: list[np.ndarray], message: np.ndarray) -> np.ndarray:
    """Whether another message has the key too; a message has each key once."""
    order, starts = groups_of(columns)
    sizes = np.diff(np.append(starts, len(order)))
    found = np.zeros(len(order), bool)
    found[order] = np.repeat(sizes > 1, sizes)
    return found


def smaller_elsewhere(columns: list[np.ndarray], message: np.ndarray) -> np.ndarray:
    """Whether another message has the key with a smaller last column."""
    order, starts = groups_of(columns[:-1])
    ids = columns[-1][order]
    least = np.minimum.reduceat(ids, starts) if len(starts) else ids
    found = np.zeros(len(order), bool)
    found[order] = np.repeat(least, np.diff(np.append(starts, len(order)))) < ids
    return found
