"""Operator 2: best-fit packing with certified bin counts.

Documents become pieces of at most ``seq_len`` tokens; whole sequences need no packing, the rest is
dealt over partitions of bounded size, each packed by best-fit decreasing (BFD).  Dual feasible
functions (DFF) give a lower bound on each partition's bins.  A partition whose bins exceed its bound
has a gap.  It is first repacked by itself: bins exchange documents so that some are filled to the last
token, BFD runs again on the rest, and what needs fewer bins, or leaves their free space in fewer places,
stays.  Then the documents of its bins that aren't full are exchanged with those of other partitions with gaps and packed anew, until no gap is
left or a round no longer saves a bin.  Each partition's bins and bound are in the written tables.

Edge cases: a null text counts as an empty one and yields its end token alone; equal and repeated rows
are packed as often as they occur; null ids are carried; a text of any length is cut whole into pieces;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialise

#: Items a partition packs at once; bounds a task's memory, and one unfilled bin in some 10,000 at most.
ITEMS_PER_PARTITION = 50_000
#: The pre-tokenizer of byte-level BPE, as its library has it (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = PIECES + ", bin long, offset long, fill long, part int, part_bins long, part_bound long"


class ByteTokenizer:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library, as little-endian uint32 bytes.

    The file's vocabulary runs in a faster library, which gives the same ids; a text with the string
    of a special token goes to the file's own library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        to_byte = {c: b for b, c in _byte_alphabet().items()}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in self._tokenizer.get_vocab(with_added_tokens=False).items() if token not in self._special}
        self._bpe = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self._none: set[str] = set()

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self._special):
            return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return bytes(self._bpe.encode_to_tiktoken_buffer(text, self._none))


@functools.lru_cache(2)
def tokenizer_at(path: str | None) -> ByteTokenizer:
    """One for each Python worker; None: the public byte-level BPE of 50k tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return ByteTokenizer(path)


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: visible Latin-1 bytes stand for themselves, others follow from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


def cut(n: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of seq_len tokens but the first, which has the rest."""
    first = n % seq_len or seq_len
    return [(0, first)] + [(s, seq_len) for s in range(first, n, seq_len)]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str | None = None, seq_len: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, on demand, ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(tokenizer_path)
        end = np.asarray([end_id], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokenizer.ids(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, seq_len)):
                    own = ids[4 * start : 4 * (start + length)]
                    row = [doc_id, k, start, length, zlib.crc32(own)]
                    if with_ids:
                        row.append(np.frombuffer(own, "<u4").astype("i4"))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, PIECES + ", ids array<int>" * with_ids)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each item and the number of bins; lengths must be in descending order.

    A bit mask has the free sizes that some open bin has, so the best fit is its lowest bit at or
    above the item's length.
    """
    bins, offsets = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = n = 0
    for i, length in enumerate(lengths.tolist()):
        if rest := mask >> length:
            free = length + (rest & -rest).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                mask ^= 1 << free
        else:
            free, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - free
        if free := free - length:
            stacks[free].append(b)
            mask |= 1 << free
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of three families of dual feasible functions over the histogram of lengths."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype("i8")
    size = np.arange(capacity + 1, dtype="i8")
    best = -(-int((count * size).sum()) // capacity)
    for k in range(1, 101):  # u(k): rounds x to multiples of 1/k unless (k + 1) x is whole
        whole = (k + 1) * size % capacity == 0
        u = np.where(whole, k * size, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((count * u).sum()) // (k * capacity)))
    over, mass = np.cumsum(count[::-1])[::-1], np.cumsum(count * size)
    for e in range(1, capacity // 2 + 1):  # U(e): above 1 - e counts whole, below e nothing
        big = int(over[capacity - e + 1])
        best = max(best, big + -(-int(mass[capacity - e] - mass[e - 1]) // capacity))
    number = np.cumsum(count)
    for e in range(1, capacity // 2 + 1):  # phi(e): by how many items of e fit besides
        unit = capacity // e
        half = capacity // 2
        high = int((count[half + 1 :] * (unit - (capacity - size[half + 1 :]) // e)).sum())
        middle = int(number[half] - number[e - 1])
        best = max(best, -(-(high + middle) // unit))
    return best


def _filled(lengths: np.ndarray, capacity: int, rng: np.random.Generator, pool: int = 48) -> tuple[np.ndarray, np.ndarray, int]:
    """Like best_fit_decreasing, but bins that subset sums fill to the last token come first: the longest item
    left with some of a random pool; BFD packs what they don't take."""
    bins, offsets = np.full(len(lengths), -1, "i8"), np.zeros(len(lengths), "i8")
    sizes, n = lengths.tolist(), 0
    for head in range(len(sizes)):
        if bins[head] >= 0:
            continue
        room = capacity - sizes[head]
        left = head + 1 + np.flatnonzero(bins[head + 1 :] < 0)
        if len(left) > pool:
            left = np.sort(rng.choice(left, pool, replace=False))
        reach, mask = [1], (1 << (room + 1)) - 1
        for i in left.tolist():
            reach.append((reach[-1] | reach[-1] << sizes[i]) & mask)
            if reach[-1] >> room & 1:
                break
        if not reach[-1] >> room & 1:
            continue
        bins[head], at = n, sizes[head]
        for j in range(len(reach) - 1, 0, -1):
            if not reach[j - 1] >> room & 1:
                i = int(left[j - 1])
                bins[i], offsets[i] = n, at
                at, room = at + sizes[i], room - sizes[i]
        n += 1
    rest = np.flatnonzero(bins < 0)
    own, at, m = best_fit_decreasing(lengths[rest], capacity)
    bins[rest], offsets[rest] = own + n, at
    return bins, offsets, n + m


def repacked(lengths: np.ndarray, bins: np.ndarray, offsets: np.ndarray, n: int, capacity: int, bound: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A packing of at most n bins, made from random shares of the bins while there are more than bound.

    lengths are in descending order.  BFD runs again on the items of a share, after some of them were put
    into bins that they fill exactly; the share's new packing stays if it has fewer bins, or as many with a
    larger sum of squared fills, which gathers free space.  The number of tries goes down with the size of the
    partition, as a bin of a small one counts for more.
    """
    rng, fill = np.random.default_rng(len(lengths)), np.bincount(bins, weights=lengths, minlength=n)
    for _ in range(int(np.clip(20_000 // max(1, len(lengths)), 2, 60))):
        if n <= bound:
            break
        # Open bins first: of 400 bins at most at once, as subset sums take their time.
        weight = rng.random(n) * (1 + (fill < capacity))
        old = np.sort(np.argsort(-weight)[: int(min(400, np.ceil(n * rng.uniform(0.3, 1.0))))])
        own = np.flatnonzero(np.isin(bins, old))
        new, at, m = _filled(lengths[own], capacity, rng)
        filled = np.bincount(new, weights=lengths[own], minlength=m)
        if m < len(old) or (m == len(old) and (filled**2).sum() > (fill[old] ** 2).sum()):
            bins, offsets = bins.copy(), offsets.copy()
            bins[own], offsets[own] = old[new], at
            used, bins = np.unique(bins, return_inverse=True)
            n, fill = len(used), np.bincount(bins, weights=lengths, minlength=len(used))
    return bins, offsets, n


def _pack_partition(capacity: int):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = [f for f in frames if len(f)]
        if not all_:
            return
        items = pd.concat(all_, ignore_index=True).sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        lengths = items["length"].to_numpy("i8")
        bound = lower_bound(lengths, capacity)
        bins, offsets, n = repacked(lengths, *best_fit_decreasing(lengths, capacity), capacity, bound)
        fill = np.bincount(bins, weights=lengths, minlength=n).astype("i8")
        items["bin"], items["offset"], items["fill"] = items["part"].astype("i8") * (1 << 24) + bins, offsets, fill[bins]
        items["part_bins"], items["part_bound"] = n, bound
        yield items[[c.strip().split(" ")[0] for c in _PLACED.split(",")]]

    return pack


def _deal(items: DataFrame, n: int, seed: int, capacity: int, items_per_partition: int) -> DataFrame:
    """Pack n items, dealt at random over partitions of some items_per_partition each."""
    parts = max(1, -(-n // items_per_partition))
    salt = F.xxhash64(F.lit(seed), "doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    dealt = items.withColumn("part", F.pmod(salt, F.lit(parts)).cast("int"))
    pack = _pack_partition(capacity)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        return next(pack(iter([frame])))

    return dealt.groupBy("part").applyInPandas(one, _PLACED)


def pack_pieces(pieces: DataFrame, seq_len: int = 2048, items_per_partition: int = ITEMS_PER_PARTITION) -> DataFrame:
    """Adds sequence_id and offset to pieces (a stored table with the columns of tokenize_pieces)."""
    full = pieces.filter(F.col("length") == seq_len).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    loose, done, seed, before = pieces.filter(F.col("length") < seq_len).select(columns), [full], 0, None
    n = loose.count()
    while n:  # each further round saves a bin at least
        placed = materialise(_deal(loose, n, seed, seq_len, items_per_partition), f"pack{seed}").withColumn("sequence_id", F.col("bin") + F.lit(seed << 56))
        # Gaps: every bin that isn't full. Certified partitions add their bins under half full.
        gap = F.col("part_bins") > F.col("part_bound")
        again = F.when(gap, F.col("fill") < seq_len).otherwise(2 * F.col("fill") <= seq_len)
        bins = F.col("offset") == 0
        stat = placed.agg(F.count_if(bins).alias("bins"), F.count_if(again).alias("items"), F.count_if(again & bins).alias("again_bins"), F.max("part").alias("part")).first()
        if before is not None and stat["bins"] >= before[1]:
            done.append(before[0])
            break
        if stat["part"] == 0 or stat["again_bins"] < 2:
            done.append(placed)
            break
        done.append(placed.filter(~again))
        before = placed.filter(again), stat["again_bins"]
        loose, n, seed = before[0].select(columns), stat["items"], seed + 1
    done = [x.select(*columns, "sequence_id", "offset") for x in done]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, seq_len: int = 2048, tokenizer_path: str | None = None, end_id: int = 0, **options) -> DataFrame:
    """Tokenize and pack; a row for each piece with its sequence and place there."""
    return pack_pieces(materialise(tokenize_pieces(docs, tokenizer_path, seq_len, end_id), "pieces"), seq_len, **options)


def sequences(docs: DataFrame, packed: DataFrame, seq_len: int = 2048, tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """The training sequences: sequence_id, ids array<int>, doc_ids of the pieces in their order.

    doc_id must be unique here, as the pieces' ids are found again by it.
    """
    ids = tokenize_pieces(docs, tokenizer_path, seq_len, end_id, with_ids=True).select("doc_id", "piece", "ids")
    joined = packed.join(ids, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("x"))
    return joined.select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.doc_id").alias("doc_ids"))
