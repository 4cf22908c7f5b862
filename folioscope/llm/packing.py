"""Packing of tokenized documents into sequences by minimum bin slack.

A document's ids and a closing id are cut at multiples of the window; only its last piece can be
shorter.  The lengths of all pieces are counted, and the packing is decided on those counts alone
(at most ``window`` numbers): the longest remaining length opens a window, and a subset-sum over
bitsets of reachable sums finds the multiset of the other lengths that leaves the least slack.
Backtracking through the bitsets gives how often each length is used, and the same filling is repeated
as often as its lengths last, so the plan has a few fillings for each length and not one for each window.
Pieces are then numbered within their length, in blocks that are counted first so that a length that
very many documents share is no single task, and each finds its window and offset by its number.

Defined results: a null text is an empty one, whose only id is the closing one; repeated rows are
packed as often as they occur; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import slices
from folioscope.session import stored

WINDOW = 1024
CLOSING_ID = 0
#: Rows that share one length are numbered in blocks of about this many.
BLOCK_ROWS = 50_000
#: Words whose ids a task remembers.
CACHED_WORDS = 100_000

_BLANK_BEFORE_SPACE = re.compile(r"\s ")
_SPECIAL = "<|endoftext|>"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> tuple[str, str, str]:
    """The installed byte-level tokenizer: its file, the same vocabulary as ranks, its word pattern."""
    import public_tokenizers

    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class WordEncoder:
    """Little-endian 32-bit ids of texts, by a byte-level tokenizer whose words never cross a space.

    Such a tokenizer starts a new word at every space that follows something other than white space,
    so the parts between those spaces have the ids that they have in the text, and repeated words
    are looked up.  New words are encoded from the same vocabulary's ranks, which is faster; texts with a
    special token's string are left to the tokenizer itself.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str, cached: int = CACHED_WORDS):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.path, self.tokenizer = path, None
        self.cached = cached
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def _special(self, text: str) -> bytes:
        from tokenizers import Tokenizer

        self.tokenizer = self.tokenizer or Tokenizer.from_file(self.path)
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if _SPECIAL in text:
            return self._special(text)
        if _BLANK_BEFORE_SPACE.search(text):
            return self._whole(text)
        first, *words = text.split(" ")
        known = self.known
        if missing := set(words).difference(known):
            if len(known) + len(missing) > self.cached:
                known.clear()
                missing = set(words)
            for word in missing:
                known[word] = self._whole(" " + word)
        return self._whole(first) + b"".join(map(known.__getitem__, words))


def _tokenized(files: tuple[str, str, str], window: int, closing: int, with_ids: bool):
    end = np.array([closing], "<u4").tobytes()
    width = 4 * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(*files)
        for batch in slices(batches, 1, 1 << 20):
            keys, starts, lengths, sums, totals, ids = [], [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = encode(text or "") + end
                total = len(data) // 4
                for at in range(0, len(data), width):
                    piece = data[at : at + width]
                    keys.append(key)
                    starts.append(at // 4)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(total)
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
            columns = [pa.array(x, pa.int64()) for x in (keys, starts, lengths, sums, totals)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def least_slack(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to use each length so that their sum is the largest that is at most ``room``."""
    lengths = sorted((n for n, c in counts.items() if c and n <= room), reverse=True)
    whole = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for length in lengths:
        trail.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left:
            step = min(step, left)
            reach |= (reach << (step * length)) & whole
            left -= step
            step *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, before in reversed(trail):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            used[length] = n
    return used


def plan_windows(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Fillings and how often each is repeated; together they use every length as often as it occurs."""
    left = {n: c for n, c in counts.items() if c}
    plan = []
    while left:
        first = max(left)
        rest = dict(left)
        rest[first] -= 1
        used = least_slack(rest, window - first)
        used[first] = used.get(first, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        plan.append((used, times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return plan


def slot_table(plan: list[tuple[dict[int, int], int]], window: int) -> list[np.ndarray]:
    """For each length, rows ``(first number, uses per window, first sequence, first offset)``."""
    rows: list[list[tuple[int, int, int, int]]] = [[] for _ in range(window + 1)]
    taken, sequence = [0] * (window + 1), 0
    for used, times in plan:
        offset = 0
        for length in sorted(used, reverse=True):
            rows[length].append((taken[length], used[length], sequence, offset))
            taken[length] += used[length] * times
            offset += used[length] * length
        sequence += times
    return [np.array(x, dtype=np.int64).reshape(-1, 4) for x in rows]


def _placed(slots: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy()
            number = batch.column(names.index("piece_number")).to_numpy()
            sequence, offset = np.empty_like(number), np.empty_like(number)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                row = slots[n][np.searchsorted(slots[n][:, 0], number[at], side="right") - 1]
                window, place = np.divmod(number[at] - row[:, 0], row[:, 1])
                sequence[at] = row[:, 2] + window
                offset[at] = row[:, 3] + place * n
            kept = [(c, batch.column(i)) for i, c in enumerate(names) if c != "piece_number"]
            kept += [("sequence_id", pa.array(sequence)), ("offset", pa.array(offset))]
            yield pa.RecordBatch.from_arrays([v for _, v in kept], names=[c for c, _ in kept])

    return run


def pack(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: tuple[str, str, str] | None = None,
    window: int = WINDOW,
    closing: int = CLOSING_ID,
    with_ids: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and,
    on request, its ``ids``.  ``tokenizer`` names its file, the file of its ranks and its word pattern."""
    files = tokenizer or byte_bpe()
    texts = documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    pieces = stored(texts.mapInArrow(_tokenized(files, window, closing, with_ids), schema), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    blocks = 1 + sum(histogram.values()) // block_rows
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("size"))
    bases = sizes.select("length", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = dealt.withColumn("nth", F.row_number().over(within)).join(bases, ["length", "block"])
    numbered = numbered.select(*pieces.columns, (F.col("base") + F.col("nth") - 1).alias("piece_number"))
    slots = slot_table(plan_windows(histogram, window), window)
    return numbered.mapInArrow(_placed(slots), schema + ", sequence_id long, offset long")
