"""Benchmark decontamination with a generalised suffix automaton of the test items.

Texts and items are normalised the same way: A-Z become lower case, words are maximal runs of
ASCII digits, ASCII letters and all characters beyond ASCII. The automaton holds every run of words of every item.
Training tokens stream through it and the length of the longest match that ends at each word is
tracked. A window is ``window`` consecutive words of an item, or the whole item if it is shorter.
A word inside an occurrence of any window is hit.

Items are taken in blocks of at most ``block_bytes`` of text, one automaton each. The driver holds one block at a time and
broadcasts its automaton, packed; a task unpacks one after the other (a single one stays) and runs a batch of documents
through each, so the corpus is read once. Words are held for one document at a time. Within a document only stretches whose word pairs all occur in the block are walked.

Edge cases: null and word-free texts have no words and no hits; items without words are ignored; items with a null id
are found and cut out like others but not named; repeated item ids and repeated texts count once per id; no items at all leaves every
document as it is; documents with repeated or null ids are judged row by row. Columns of the input pass through untouched, but for
``find_contamination``, whose three columns take the place of columns of the same names.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilmine.llm.common import portions, spread, trimmed

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SEPARATORS = bytes((32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b) for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Normalised words of a text, as UTF-8."""
    return _normalised(text).split()


def _normalised(text: str) -> bytes:
    """The text as UTF-8 in which every separator is a space."""
    return text.encode("utf-8", "surrogatepass").translate(_SEPARATORS)


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the windows of its items marked."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = []
        for name, words in items:
            if words:
                sequences.append((name, [self.ids.setdefault(w, len(self.ids)) for w in words]))
        for _, sequence in sequences:
            last = 0
            for c in sequence:
                last = self._extend(last, c)
        self.least = min([window, *(len(s) for _, s in sequences)])
        n = max(1, len(self.ids))
        self.pairs = np.unique(np.array([a * n + b for _, s in sequences for a, b in zip(s, s[1:])], dtype=np.int64))
        self.whole: dict[int, list[tuple[int, set[str]]]] = {}  # state -> (words, items) of short items
        self.full: dict[int, set[str]] = {}  # state of a full window -> items
        short: dict[int, dict[int, set[str]]] = {}
        for name, sequence in sequences:
            state, matched = 0, 0
            for c in sequence:
                state, matched = self.step(state, matched, c)
                if matched >= window:
                    self.full.setdefault(self._ancestor(state, window), set()).add(name)
            if len(sequence) < window:
                short.setdefault(self._ancestor(state, len(sequence)), {}).setdefault(len(sequence), set()).add(name)
        if short:
            for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
                above = self.whole.get(self.link[state], [])
                own = sorted(short.get(state, {}).items())
                if above or own:
                    self.whole[state] = [*above, *own]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            clone = self._clone(q, length[last] + 1)
            p = last
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            link[q] = clone
            return clone
        current = len(length)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = current
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[current] = q
            else:
                clone = self._clone(q, length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[current] = clone
        return current

    def _clone(self, q: int, n: int) -> int:
        self.next.append(dict(self.next[q])), self.link.append(self.link[q]), self.length.append(n)
        return len(self.length) - 1

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        nxt = self.next
        while state and c not in nxt[state]:
            state = self.link[state]
            matched = self.length[state]
        to = nxt[state].get(c)
        return (0, 0) if to is None else (to, matched + 1)

    def _ancestor(self, state: int, words: int) -> int:
        """The state that holds the last ``words`` words of what ``state`` has matched."""
        while self.length[self.link[state]] >= words:
            state = self.link[state]
        return state

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Maximal [from, to) in which every word and every word pair occurs in an item."""
        known = ids >= 0
        if len(ids) < self.least or not known.any():
            return []
        if self.least == 1:
            ok, add = known, 0
        else:
            code = ids[:-1] * max(1, len(self.ids)) + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            ok, add = known[:-1] & known[1:] & (self.pairs[at] == code), 1
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).astype(np.int8)))
        return [(int(a), int(b) + add) for a, b in zip(edge[::2], edge[1::2]) if b + add - a >= self.least]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Occurrences of windows as word ranges [from, to), and the items they come from."""
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        spans, found = [], set()
        for a, b in self.stretches(ids):
            state = matched = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                state, matched = self.step(state, matched, c)
                if matched >= self.window:
                    spans.append((i - self.window, i))
                    found |= self.full.get(self._ancestor(state, self.window), set())
                for n, names in self.whole.get(state, ()):
                    if matched >= n:
                        spans.append((i - n, i))
                        found |= names
        return spans, found


def _covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


SPANS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items, a block of bounded size at a time."""
    held, size = [], 0
    for row in items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        if row[1] is None:
            continue
        if held and size + len(row[1]) > block_bytes:
            yield held
            held, size = [], 0
        held.append((row[0], words_of(row[1])))
        size += len(row[1])
    if held:
        yield held


#: What is made of a batch, the number of words of each of its texts, their disjoint spans that are hit and the sets of ids of the items.
Finish = Callable[[pa.RecordBatch, list[int], list[list[tuple[int, int]]], list[set[str]]], pa.RecordBatch]


def _scanned(source: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, window: int, block_bytes: int, finish: Finish, schema) -> DataFrame:
    """What ``finish`` makes of ``source``, in the same task: a second pass through Python would be a second worker beside it."""
    spark = source.sparkSession
    packed = [spark.sparkContext.broadcast(zlib.compress(pickle.dumps(SuffixAutomaton(block, window)), 1)) for block in item_blocks(items, item_id, item_text, block_bytes)]
    at = source.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = pickle.loads(zlib.decompress(packed[0].value)) if len(packed) == 1 else None
        # several automata are unpacked for each batch, so then it stays whole
        for b in batches if len(packed) > 1 else portions(batches, at):
            texts = [_normalised(text.as_py() or "") for text in b.column(at)]
            sizes, spans, found = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
            if not packed:
                sizes = [len(text.split()) for text in texts]
            for block in packed:
                automaton = kept or pickle.loads(zlib.decompress(block.value))
                for k, text in enumerate(texts):
                    words = text.split()
                    more, ids = automaton.scan(words)
                    sizes[k] = len(words)
                    spans[k] += more
                    found[k] |= ids
            yield finish(b, sizes, [_covered(s) for s in spans], found)

    return source.mapInArrow(trimmed(run), schema)


FOUND = ["n_words", "hit_spans", "hit_items"]


def find_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """Add ``n_words`` long, ``hit_spans`` (disjoint word ranges) and ``hit_items`` (sorted ids as strings)."""
    source = spread(docs.drop(*(c for c in docs.columns if c.lower() in FOUND)))
    kinds = ("long", "array<struct<from:int,to:int>>", "array<string>")
    schema = source.withColumns({n: F.lit(None).cast(k) for n, k in zip(FOUND, kinds)}).schema

    def finish(b: pa.RecordBatch, sizes: list[int], spans: list[list[tuple[int, int]]], found: list[set[str]]) -> pa.RecordBatch:
        covered = [[{"from": x, "to": y} for x, y in s] for s in spans]
        named = [sorted(x for x in f if x is not None) for f in found]
        columns = [*b.columns, pa.array(sizes, pa.int64()), pa.array(covered, SPANS), pa.array(named, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, *FOUND])

    return _scanned(source, items, text_col, item_id, item_text, window, block_bytes, finish, schema)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, min_span: int = 1, max_coverage: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """Texts without contaminated spans.

    A document whose hit words are more than ``max_coverage`` of its words goes; in others every
    hit span of ``min_span`` words or more is cut out of the text. Spans of fewer than ``window`` words are
    whole items. Texts without hits stay as they are, byte for byte.
    """
    source = spread(docs)
    at = source.columns.index(text_col)

    def finish(b: pa.RecordBatch, sizes: list[int], spans: list[list[tuple[int, int]]], found: list[set[str]]) -> pa.RecordBatch:
        keep, texts = [], []
        for text, n, covered in zip(b.column(at), sizes, spans):
            hit = sum(y - x for x, y in covered)
            keep.append(not n or hit <= max_coverage * n)
            text = text.as_py()
            cut = [(x, y) for x, y in covered if y - x >= min_span]
            if cut and keep[-1]:
                text = without_spans(text, cut)
            texts.append(text)
        columns = list(b.columns)
        columns[at] = pa.array(texts, b.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, names=b.schema.names).filter(pa.array(keep, pa.bool_()))

    return _scanned(source, items, text_col, item_id, item_text, window, block_bytes, finish, source.schema)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """Cut word ranges out of a text, with the white space that follows them."""
    places = [m.span() for m in WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)}))]
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at : places[a][0]])
        at = places[b - 1][1]
        at = re.compile(r"[^\w\n]*\s?").match(text, at).end() if at < len(text) else at
    return "".join([*parts, text[at:]])
