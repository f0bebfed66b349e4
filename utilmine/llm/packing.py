"""Best-fit packing of tokenised documents into fixed-length sequences.

Method: bounded-space online best-fit. A task keeps at most ``open_bins`` open sequences; a bitset
keyed by free space (bit *f* set: some open sequence has *f* free places) answers "the fullest
sequence that still takes this piece" with two integer operations. When a new sequence is needed
and all places are taken, the fullest open one closes first. Pieces arrive in look-ahead blocks
ordered from long to short, which is still online (a block is bounded). A block of about twice the open sequences wastes
least: in much longer ones so many long pieces come one after the other that sequences close before the short pieces that would fill them.

What tasks leave open is packed again: these sequences become items of the next round, ``fan_in`` tasks to a group, and
what a group leaves open goes on, until one group is left. A group holds at most ``open_bins`` open sequences and gets at most
``fan_in * open_bins`` items, which stream through it. Only (sequence, length) rows travel.

Edge cases: null text is the empty text (one piece, the end token); a document longer than
``capacity`` is cut into full pieces, the first one takes the remainder; the tokenizer's added tokens are found in texts
as the tokenizer finds them; repeated rows are packed once per row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilmine.llm.common import materialise, portions, release, spread, trimmed

#: Fixed value: the pre-tokenisation pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Fixed value: the end token, id 0, as four bytes.
END = bytes(4)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, is_open boolean"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: White space that can stand beside a space, besides the space itself.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_AFTER_SPACE = tuple((c, " " + c) for c in " " + SPACES)


class Encoder:
    """Whole texts to token ids, as little-endian unsigned 32-bit numbers in bytes.

    The vocabulary is that of the tokenizer file. A token never spans the place where white space
    follows other characters, so a text in which no space is followed by more white space is the
    concatenation of its space-separated words. Words are looked up in a bounded cache; the ones
    a block of texts misses are encoded together, and the tokens that begin with a space tell
    them apart. Other texts, and texts with an added token, are encoded whole.
    """

    LIMIT = 500_000
    _loaded: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        import numpy as np
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        added = json.loads(tokenizer.to_str())["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that depend on what stands beside them are not supported")
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        self.find_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        alphabet = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if token not in self.added}
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.begins[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.words: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def has_added(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def whole(self, text: str) -> bytes:
        """Ids of a text encoded by itself; added tokens cut it into parts that know nothing of each other."""
        if not self.has_added(text):
            return array("I", self.bpe.encode_ordinary(text)).tobytes()
        return b"".join(self.added.get(part) or array("I", self.bpe.encode_ordinary(part)).tobytes() for part in self.find_added.split(text) if part)

    def learn(self, missing: set[str]) -> None:
        import numpy as np

        missing.discard("")
        self.words[""] = self.whole(" ")
        order = list(missing)
        if not order:
            return
        ids = np.frombuffer(array("I", self.bpe.encode_ordinary(" " + " ".join(order))), dtype="<u4")
        first = np.flatnonzero(self.begins[ids])
        if len(first) != len(order):
            self.words.update((w, self.whole(" " + w)) for w in order)
            return
        data, edge = ids.tobytes(), [*(4 * first).tolist(), 4 * len(ids)]
        self.words.update((w, data[a:b]) for w, a, b in zip(order, edge, edge[1:]))

    def encode_all(self, texts: list[str], block: int = 2 << 20) -> Iterator[bytes]:
        """Token ids of each text, in order."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= block:
                yield from self._block(held)
                held, size = [], 0
        yield from self._block(held)

    def _block(self, texts: list[str]) -> Iterator[bytes]:
        # most kinds of white space are in few texts, and to look for one character is cheap
        split = [None if self.has_added(t) or any(c in t and both in t for c, both in _AFTER_SPACE) else t.split(" ") for t in texts]
        known, used = self.words, set().union(*filter(None, split))
        if missing := used - known.keys():
            if len(known) + len(missing) > self.LIMIT:
                known.clear()
                missing = used
            self.learn(missing)
        get = known.__getitem__
        for text, words in zip(texts, split):
            yield self.whole(text) if words is None else self.whole(words[0]) + b"".join(map(get, words[1:]))


class OpenBins:
    """Bounded-space best-fit over sequences of ``capacity`` places."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free_bits = 0
        self.by_free: dict[int, list[int]] = {}
        self.count = 0
        self.opened = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.free_bits &= ~(1 << free)
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(sequence number, offset) for a piece of ``length`` tokens."""
        fitting = self.free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.opened
            self.opened += 1
        left = free - length
        if left:
            if self.count >= self.limit:
                fullest = (self.free_bits & -self.free_bits).bit_length() - 1
                if fullest < left:
                    self._take(fullest)
                else:
                    return number, self.capacity - free
            self.by_free.setdefault(left, []).append(number)
            self.free_bits |= 1 << left
            self.count += 1
        return number, self.capacity - free

    def still_open(self) -> dict[int, int]:
        """Sequence number to its free places."""
        return {n: free for free, bins in self.by_free.items() for n in bins}


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: full ones, and the remainder first."""
    first = (total - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def _tokenise_and_pack(path: str, capacity: int, open_bins: int, look_ahead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        encoder, bins = Encoder.of(path), OpenBins(capacity, open_bins)
        waiting: list[list] = []
        held: list[list] = []  # rows of sequences that may still be open

        def drain():
            waiting.sort(key=lambda r: -r[3])
            for row in waiting:
                row[5], row[6] = bins.place(row[3])
            held.extend(waiting)
            waiting.clear()

        def batch(rows, is_open):
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, type=k) for c, k in zip(cols, kinds)] + [pa.array(is_open, type=pa.bool_())]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "is_open"])

        def settle(last: bool):
            open_now = bins.still_open()
            done = held if last else [r for r in held if r[5] not in open_now]
            flags = [r[5] in open_now for r in done]
            rows = [[*r[:5], base + r[5], r[6]] for r in done]
            kept = [] if last else [r for r in held if r[5] in open_now]
            held[:] = kept
            return batch(rows, flags)

        for b in portions(batches, 1, 2 << 20):
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode_all(b.column(1).to_pylist())):
                ids += END
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    waiting.append([doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), None, None])
                if len(waiting) >= look_ahead:
                    drain()
                    yield settle(False)
        drain()
        yield settle(True)
        encoder.words.clear()  # the worker stays, and other stages need its memory

    return trimmed(run)


def _merge_open(capacity: int, open_bins: int):
    """Pack the sequences that tasks left open: (group, sequence, fill), group by group, from full to empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, group, first = OpenBins(capacity, open_bins), None, {}

        def batch(rows, is_open):
            cols = list(zip(*rows)) if rows else [()] * 5
            arrays = [pa.array(c, type=pa.int64()) for c in cols] + [pa.array([is_open] * len(rows), type=pa.bool_())]
            return pa.RecordBatch.from_arrays(arrays, names=["sequence_id", "into", "shift", "g", "fill", "is_open"])

        def left():
            """A row for each sequence that is still open, which stands for all that went into it."""
            return batch([(None, first[n], None, group, capacity - free) for n, free in bins.still_open().items()], True)

        for b in batches:
            rows = []
            for g, s, fill in zip(*(b.column(i).to_pylist() for i in range(3))):
                if g != group:
                    if rows:
                        yield batch(rows, False)
                        rows = []
                    yield left()
                    bins, group, first = OpenBins(capacity, open_bins), g, {}
                number, offset = bins.place(fill)
                rows.append((s, first.setdefault(number, s), offset, g, None))
            if len(first) > 4 * open_bins:
                open_now = bins.still_open()
                first = {n: s for n, s in first.items() if n in open_now}
            yield batch(rows, False)
        yield left()

    return run


MERGED = "sequence_id long, into long, shift long, g long, fill long, is_open boolean"


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = 2048,
    open_bins: int = 1024,
    look_ahead: int | None = None,
    fan_in: int = 256,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    ``open_bins`` and ``look_ahead`` (pieces sorted at a time; by default twice ``open_bins``) bound a task's memory; ``fan_in`` bounds how many rows of two numbers
    a group of a later round gets (``fan_in * open_bins``).
    """
    spark = docs.sparkSession
    source = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    run = _tokenise_and_pack(tokenizer or default_tokenizer(), capacity, open_bins, look_ahead or 2 * open_bins)
    pieces = materialise(source.mapInArrow(run, PIECES), "pieces")
    left = pieces.where("is_open").groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.shiftright("sequence_id", 33).alias("task"))
    left = materialise(left.select("sequence_id", "fill", "task"), "open")
    opened, moved, tasks = left, None, (left.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        groups = -(-tasks // fan_in)
        dealt = left.select(F.expr(f"task div {fan_in}").alias("g"), "sequence_id", "fill").repartition(max(1, min(groups, 4096)), "g")
        step = dealt.sortWithinPartitions("g", F.desc("fill"), "sequence_id").mapInArrow(_merge_open(capacity, open_bins), MERGED)
        step = materialise(step, "merge")
        placed = step.where("NOT is_open").select("sequence_id", "into", "shift")
        if moved is None:
            moved = placed
        else:
            later = placed.select(F.col("sequence_id").alias("into"), F.col("into").alias("into2"), F.col("shift").alias("shift2"))
            moved = moved.join(later, "into", "left").select("sequence_id", F.coalesce("into2", "into").alias("into"), (F.col("shift") + F.coalesce("shift2", F.lit(0))).alias("shift"))
        if groups == 1:
            break
        left = step.where("is_open").select(F.col("into").alias("sequence_id"), "fill", F.col("g").alias("task"))
        tasks = groups
    release(opened)
    return pieces.join(moved, "sequence_id", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )
