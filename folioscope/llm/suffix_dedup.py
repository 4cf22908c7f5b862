"""Repeated passages by hashed windows of ``MATCH`` bytes, with a difference cover as prefilter.

A string of ``MATCH`` (50) bytes is removed where a document with a smaller id has it too.  Suffixes are
compared to that depth only, by hashes in place of lexical order and ranks, and never all at once:

1. Region classes.  Content-defined cuts split texts into regions; the suffixes that start in a region
   are repeats if an earlier document has the whole region and the ``MATCH - 1`` bytes behind it.  These
   long ties are settled by one digest and take no further part; the first document of each keeps them.
2. Cover samples.  Of the remaining suffixes, the places of a difference cover modulo ``PERIOD``
   are sampled: for any two places there is a shift below the period that brings both onto the cover.
   So two equal strings of ``MATCH`` bytes have a pair of sampled windows of ``MATCH - PERIOD + 1`` bytes
   at one shift.  Their hashes are sorted bucket by bucket, and a window gets one bit, whether another
   document has its hash; it has no rank.  A suffix none of whose cover windows ties with another document's is unique, and is done.
3. Suffix buckets.  The suffixes that are left are dealt into buckets by their first ``MATCH`` bytes'
   hash, and one bucket at a time is sorted by that hash; in a run of equal ones all but the smallest document's are
   repeats.

A step settles the answers of the one before and notes for the next pass, as bits, which suffixes repeat and
which are left, so keys are found twice, to send them and to read their answers, and not in every later pass.

Memory is bounded by a block of texts and a bucket of keys; the keys of steps 1 and 3 are 128 and 96
bits (and the bucket's number), those of step 2 only select.  No text moves between tasks after the
blocks are written.

Defined results: null texts are empty and keep nothing; null ids count as the smallest; rows with the
same id do not match each other; texts shorter than ``MATCH`` bytes lose nothing; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import blocks as B
from folioscope.session import stored

MATCH = 50
#: A perfect difference cover: every difference modulo 13 is one of two of these.
PERIOD, COVER = 13, (0, 1, 3, 9)
WINDOW = MATCH - PERIOD + 1
#: Regions are about this many bytes.
REGION = 128
_CUT = 8

_BASES = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A4B)


def spread_back(marks: np.ndarray, reach: int) -> np.ndarray:
    """Marks every place that has a mark at itself or at most ``reach - 1`` places later."""
    found, have = marks.copy(), 1
    while have < reach:
        step = min(have, reach - have)
        found[:-step] |= found[step:].copy()
        have += step
    return found


class BlockState:
    """What a block knows about its suffixes; each step adds the answers of its round."""

    @classmethod
    def before(cls, row: dict, buckets: list[int], step: int) -> BlockState:
        """The state of a block to which the answers of all steps before ``step`` are added."""
        state = cls(row, buckets)
        if step > 1:
            state.recall(B.noted(row["bits0"]))
        if step:
            _SETTLE[step - 1](state, row["bits0"])
        return state

    def notes(self) -> bytes:
        return np.packbits(np.stack([self.repeat, self.active]), axis=1).tobytes()

    def recall(self, notes: bytes) -> None:
        bits = np.frombuffer(notes, np.uint8).reshape(2, -1)
        self.repeat, self.active = np.unpackbits(bits, axis=1, count=len(self.data)).astype(bool)

    def __init__(self, row: dict, buckets: list[int]):
        self.block = row["block"]
        self.ids, self.starts, self.data = B.texts_of(row)
        self.buckets = buckets
        n = len(self.data)
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.starts))
        #: Suffixes with MATCH bytes left in their document.
        self.full = np.zeros(n, bool)
        #: Places of the difference cover with a whole window.
        self.cover = np.zeros(n, bool)
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            self.full[a : max(a, b - MATCH + 1)] = True
            for c in COVER:
                self.cover[a + c : max(a, b - WINDOW + 1) : PERIOD] = True
        #: Suffixes known to repeat an earlier document's.
        self.repeat = np.zeros(n, bool)
        self.active = self.full

    # --- step 1 ---

    def regions(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Buckets and keys of the distinct regions; remembers where they lie."""
        cut = np.flatnonzero(B.hashes_at(self.data, None, 1, _BASES[0], _CUT) & np.uint64(REGION - 1) == 0)
        begins = np.union1d(cut, self.starts[:-1][self.starts[:-1] < len(self.data)])
        begins = begins[self.full[begins]]
        last = self.starts[self.doc[begins] + 1] - MATCH + 1  # the first place without a full suffix
        ends = np.minimum(np.append(begins[1:], len(self.data)), last)
        whole = self.data.tobytes()
        digest = b"".join(
            [hashlib.blake2b(whole[a : b + MATCH - 1], digest_size=16).digest() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        )
        keys = np.frombuffer(digest, np.uint64).reshape(-1, 2)
        self.region_at = (begins, ends)
        return self._distinct(0, [np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1])], self.doc[begins])

    def settle_regions(self, bits: list[dict] | None) -> None:
        bucket, _ = self.regions()
        known = self._repeats(B.answered(bits, bucket))
        for a, b in zip(self.region_at[0][known].tolist(), self.region_at[1][known].tolist(), strict=True):
            self.repeat[a:b] = True
        self.active = self.full & ~self.repeat

    # --- step 2 ---

    def samples(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Buckets and keys of the distinct cover windows that touch an active suffix."""
        # A window lies in the strings that start at its place or up to a period before it.
        touched = spread_back(self.active[::-1], PERIOD)[::-1]
        self.sample_at = np.flatnonzero(self.cover & touched)
        mixed = B.hashes_at(self.data, self.sample_at, 2, _BASES[0], WINDOW)
        self.sample_key = (B.bucket_of(mixed, self.buckets[1]) << np.uint64(32)) | (mixed & np.uint64(0xFFFFFFFF))
        # Keys and the documents' numbers are sorted as one number where that fits; it nearly always does.
        width = np.uint64(max(len(self.ids), 2).bit_length())
        docs = self.doc[self.sample_at].astype(np.uint64)
        if self.buckets[1].bit_length() + 32 + int(width) <= 64:
            sorted_ = np.sort((self.sample_key << width) | docs)
            keys, docs = sorted_ >> width, sorted_ & np.uint64((1 << int(width)) - 1)
        else:
            order = np.lexsort((docs, self.sample_key))
            keys, docs = self.sample_key[order], docs[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(keys)) - 1
        self.keys, self.tied_here = keys[starts], docs[starts] != docs[ends] if len(keys) else new
        return self.keys >> np.uint64(32), [self.keys.astype(np.uint32)]

    def settle_samples(self, bits: list[dict] | None) -> None:
        bucket, _ = self.samples()
        ties = self.keys[B.answered(bits, bucket) | self.tied_here]
        # Most keys are not tied: a table of their low bits tells them apart, and the rest are looked up.
        seen = np.zeros(1 << 22, bool)
        seen[ties & np.uint64(len(seen) - 1)] = True
        maybe = np.flatnonzero(seen[self.sample_key & np.uint64(len(seen) - 1)])
        key = self.sample_key[maybe]
        at = np.searchsorted(ties, key)
        tied = maybe[ties[np.minimum(at, len(ties) - 1)] == key] if len(ties) else maybe[:0]
        marks = np.zeros(len(self.data), bool)
        marks[self.sample_at[tied]] = True
        self.active = self.active & spread_back(marks, PERIOD)

    # --- step 3 ---

    def suffixes(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Buckets and keys of the distinct strings at the suffixes that are left."""
        self.suffix_at = np.flatnonzero(self.active)
        high, low = (B.hashes_at(self.data, self.suffix_at, seed, base, MATCH) for seed, base in zip((3, 4), _BASES, strict=True))
        return self._distinct(2, [high, (low >> np.uint64(32)).astype(np.uint32)], self.doc[self.suffix_at])

    def settle_suffixes(self, bits: list[dict] | None) -> None:
        bucket, _ = self.suffixes()
        self.repeat[self.suffix_at[self._repeats(B.answered(bits, bucket))]] = True

    # --- shared by steps 1 and 3 ---

    def _distinct(self, step: int, keys: list[np.ndarray], docs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sorted distinct keys with the smallest id that has each."""
        order, starts = B.groups_of(keys)
        ids = self.ids[docs][order]
        least = np.minimum.reduceat(ids, starts) if len(starts) else ids
        self.grouped = (order, starts, ids, least)
        keys = [k[order[starts]] for k in keys]
        return B.bucket_of(keys[0], self.buckets[step]), [*keys, least]

    def _repeats(self, smaller: np.ndarray) -> np.ndarray:
        """Which of the entries behind ``_distinct`` repeat a smaller id's: one of another block, or here."""
        order, starts, ids, least = self.grouped
        sizes = np.diff(np.append(starts, len(order)))
        found = np.zeros(len(order), bool)
        found[order] = np.repeat(smaller, sizes) | (ids > np.repeat(least, sizes))
        return found

    # --- results ---

    def removed(self) -> np.ndarray:
        """The bytes covered by a repeat."""
        return spread_back(self.repeat[::-1], MATCH)[::-1]


_STEPS = (
    (BlockState.regions, [np.uint64, np.uint64, np.int64], B.smaller_elsewhere),
    (BlockState.samples, [np.uint32], B.shared_elsewhere),
    (BlockState.suffixes, [np.uint64, np.uint32, np.int64], B.smaller_elsewhere),
)
_SETTLE = (BlockState.settle_regions, BlockState.settle_samples, BlockState.settle_suffixes)


def _asked(step: int, buckets: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows_of(batches):
            state = BlockState.before(row, buckets, step)
            bucket, columns = _STEPS[step][0](state)
            if len(bucket):
                yield B.messages(state.block, bucket, columns)
            if step:
                yield B.note(state.block, state.notes())

    return run


_RESULT = "row_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finished(buckets: list[int], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows_of(batches):
            state = BlockState.before(row, buckets, len(_STEPS))
            gone = state.removed()
            found = {k: [] for k in ("row_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
            for key, a, b in zip(state.ids.tolist(), state.starts[:-1].tolist(), state.starts[1:].tolist(), strict=True):
                lost, data = gone[a:b], state.data[a:b]
                kept = data[~lost].tobytes()
                edges = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]]))).reshape(-1, 2)
                found["row_id"].append(None if key == B.NO_ID else key)
                found["n_bytes"].append(b - a)
                found["n_removed"].append(int(lost.sum()))
                found["n_spans"].append(len(edges))
                found["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    found["kept"].append(kept)
                    found["spans"].append([{"start": int(x), "end": int(y)} for x, y in edges])
            kinds = {"row_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
            if with_text:
                kinds |= {"kept": pa.binary(), "spans": pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))}
            yield pa.RecordBatch.from_pydict({k: pa.array(found[k], kind) for k, kind in kinds.items()})

    return run


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, bucket_bytes: int = B.BUCKET_BYTES) -> DataFrame:
    """``row_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document and, on request, the
    remaining bytes ``kept`` (cuts may split a character) and the removed ``spans``."""
    table = B.Blocks(documents, id_col, text_col)
    # Bytes of keys for each byte of text, at most about: a region's key, the cover's share, all suffixes
    # that a tie leaves (one in four; more only make the buckets larger).
    shares = (24 / REGION, 4 * len(COVER) / PERIOD, 20 / 4)
    buckets = [1 + int(table.bytes * share) // bucket_bytes for share in shares]
    rounds: list[DataFrame] = []
    for step, (_, kinds, judge) in enumerate(_STEPS):
        sent = table.with_answers(rounds[-1:]).mapInArrow(_asked(step, buckets), B.MESSAGE_SCHEMA)
        rounds.append(stored(B.answers(sent, kinds, judge), f"repeats-{step}"))
    schema = _RESULT + (", kept binary, spans array<struct<start: long, end: long>>" if with_text else "")
    return table.with_answers(rounds[-1:]).mapInArrow(_finished(buckets, with_text), schema)
