"""Benchmark passages in documents, found with a generalised suffix automaton of the benchmark items.

The automaton holds every run of words of every item. A document's words are streamed through it; the state
tells the longest run that ends at the current word and occurs in some item. Where that run has at least
`window` words, the last `window` of them are a window of an item, and so are hit. An item of fewer words is
one window as a whole. Words that no item has end every run, so only stretches of known words are streamed,
and only those in which every pair of neighbours occurs in an item (a run of two words or more needs that).

Items are dealt into parts of at most PART_WORDS words, each with an automaton of its own, so what a task holds
is bounded; the documents run through the parts one after the other without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabulon.llm.text import ALNUM, Words, aliased, list_array, slices

PART_WORDS = 1_000_000
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """All runs of words of several items; words are small numbers."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[set[int]] = [set()]  # items with a run that ends in this state
        self.whole: dict[int, set[int]] = {}  # state: items of fewer than `window` words that it spells

    def _state(self, size: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.size.append(size)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The part of state q that follows p: runs of at most size[p] + 1 words."""
        copy = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.size[q] == self.size[last] + 1 else self._split(last, word, q)
        new = self._state(self.size[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
        return new

    def add(self, item: int, words: list[int]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)
            self.ends[last].add(item)

    def close(self, short: dict[int, list[int]]) -> None:
        """Pass the items on to shorter runs and find the states of the items below the window."""
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.size[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]
        for item, words in short.items():
            state = 0
            for word in words:
                state = self.next[state][word]
            self.whole.setdefault(state, set()).add(item)
        self.short_sizes = {item: len(words) for item, words in short.items()}

    def matches(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit stretches [from, to) of the words, and the items whose windows occur."""
        state = size = 0
        stretches, items = [], set()
        for at, word in enumerate(words, 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if word in self.next[state]:
                state = self.next[state][word]
                size += 1
            longest = 0
            if size >= self.window:
                while self.size[self.link[state]] >= self.window:
                    state = self.link[state]
                size = min(size, self.size[state])
                items |= self.ends[state]
                longest = self.window
            if self.whole:
                s, reach = state, size
                while s > 0:
                    for item in self.whole.get(s, ()):
                        if self.short_sizes[item] <= reach:
                            items.add(item)
                            longest = max(longest, self.short_sizes[item])
                    s = self.link[s]
                    reach = self.size[s]
            if longest:
                if stretches and stretches[-1][1] >= at - longest:
                    first = stretches[-1][0]
                    while stretches and stretches[-1][1] >= at - longest:
                        first = min(stretches.pop()[0], first)
                    stretches.append((min(first, at - longest), at))
                else:
                    stretches.append((at - longest, at))
        return stretches, items


def build(items: list[tuple[str, np.ndarray]], window: int) -> dict | None:
    """The automaton of (item id, word hashes) and the sorted hashes it knows; None without words."""
    items = [(k, h) for k, h in items if len(h)]
    if not items:
        return None
    known, codes = np.unique(np.concatenate([h for _, h in items]), return_inverse=True)
    automaton, short, at, pairs = SuffixAutomaton(window), {}, 0, []
    names = sorted({k for k, _ in items})
    number = {k: i for i, k in enumerate(names)}
    parts: list[tuple[int, list[int]]] = []
    for k, h in items:
        words = codes[at : at + len(h)].tolist()
        at += len(h)
        parts.append((number[k], words))
        pairs.append(h[:-1] * _PAIR + h[1:])
    # every short passage gets a number of its own, as an id may have several texts
    keys = list(names)
    for i, words in parts:
        automaton.add(i, words)
        if len(words) < window:
            keys.append(names[i])
            short[len(keys) - 1] = words
    automaton.close(short)
    singles = [words[0] for words in short.values() if len(words) == 1]
    return {
        "automaton": automaton, "known": known, "keys": keys, "pairs": np.unique(np.concatenate(pairs)),
        "least": min([window, *map(len, short.values())]), "single": np.unique(np.array(singles, dtype=np.int64)),
    }


def _inside(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return at, (table[at] == values) if len(table) else np.zeros(len(values), dtype=bool)


def _find(part: dict, words: Words, h: np.ndarray, rows: int) -> tuple[list[list], list[set]]:
    stretches: list[list] = [[] for _ in range(rows)]
    items: list[set] = [set() for _ in range(rows)]
    code, known = _inside(h, part["known"])
    joined = np.zeros(len(h) + 1, dtype=bool)  # word i - 1 and word i may follow each other in an item
    if len(h) > 1:
        joined[1:-1] = (words.row[1:] == words.row[:-1]) & known[1:] & known[:-1]
        maybe = np.flatnonzero(joined)
        joined[maybe] = _inside(h[maybe - 1] * _PAIR + h[maybe], part["pairs"])[1]
    starts = np.flatnonzero(known & ~joined[:-1])
    ends = np.flatnonzero(known & ~joined[1:]) + 1
    long = ends - starts >= max(part["least"], 1)
    for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        found, which = part["automaton"].matches(code[s:e].tolist())
        if found:
            row = int(words.row[s])
            offset = s - int(words.first[row])
            stretches[row] += [(a + offset, b + offset) for a, b in found]
            items[row].update(part["keys"][i] for i in which)
    return stretches, items


def _scan(shared, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = shared.value
        for batch in batches:
            for piece in slices(batch.column("text")):
                words = Words(piece, ALNUM)
                stretches, items = _find(part, words, words.hashes(), piece.rows)
                if not first:
                    old = batch.slice(piece.start, piece.rows)
                    for i, (runs, names) in enumerate(
                        zip(old.column("runs").to_pylist(), old.column("items").to_pylist(), strict=True)
                    ):
                        stretches[i] += [(r["a"], r["b"]) for r in runs]
                        items[i].update(names)
                kept = []
                for runs in stretches:
                    merged: list[list[int]] = []
                    for a, b in sorted(runs):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    kept.append(merged)
                flat = [r for runs in kept for r in runs]
                fields = pa.StructArray.from_arrays(
                    [pa.array([r[i] for r in flat], pa.int64()) for i in (0, 1)], names=["a", "b"]
                )
                rows = batch.slice(piece.start, piece.rows)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(c) for c in rows.schema.names if c not in ("n_words", "runs", "items")]
                    + [
                        pa.array(words.counts.astype(np.int64)),
                        list_array(fields, np.array([len(r) for r in kept], dtype=np.int64)),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    ],
                    names=[c for c in rows.schema.names if c not in ("n_words", "runs", "items")]
                    + ["n_words", "runs", "items"],
                )

    return run


def _parts(items: DataFrame, window: int) -> Iterator[dict]:
    """The automata of the items, at most PART_WORDS words in each (or one item)."""
    rows: list = []
    held = 0
    for batch in items.select(F.col("id").cast("string").alias("id"), "text").toLocalIterator(prefetchPartitions=True):
        piece = next(slices(pa.array([batch["text"]], pa.string())))
        h = Words(piece, ALNUM).hashes()
        if batch["id"] is None or not len(h):
            continue
        if rows and held + len(h) > PART_WORDS:
            yield build(rows, window)
            rows, held = [], 0
        rows.append((batch["id"], h))
        held += len(h)
    if rows:
        yield build(rows, window)


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, text_column: str, item_column: str) -> DataFrame:
    """docs (with a column `text`) and n_words, runs and items; text_column, item_column: the benchmark's."""
    if window < 2:
        raise ValueError("a window has at least two words")
    items = aliased(benchmark, {"id": item_column, "text": text_column})
    found, first = docs, True
    context = docs.sparkSession.sparkContext
    added = "n_words long, runs array<struct<a: long, b: long>>, items array<string>"
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(added).fields])
    empty = {
        "automaton": SuffixAutomaton(window), "known": np.zeros(0, np.uint64), "keys": [],
        "pairs": np.zeros(0, np.uint64), "least": window, "single": np.zeros(0, np.int64),
    }
    for part in _parts(items, window):
        found = found.mapInArrow(_scan(context.broadcast(part), first), schema)
        first = False
    if first:
        found = found.mapInArrow(_scan(context.broadcast(empty), True), schema)
    return found


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
) -> DataFrame:
    """Per row: id, n_words, n_hit, runs (hit stretches of word numbers), items (ids, sorted as strings), n_items.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A null or empty text has no
    words; items without id or words are left out; an id with several texts counts once. Rows are kept as they
    come, repeated ones too. Other columns are ignored.
    """
    found = _hits(
        aliased(docs, {"id": id_column, "text": text_column}), benchmark, window, text_column, item_column
    )
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["b"] - r["a"])
    return found.select(
        F.col("id").alias(id_column), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "runs"
    )


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch.column("text")):
            words = Words(piece, ALNUM)
            rows = batch.slice(piece.start, piece.rows)
            texts = []
            for i, (text, runs) in enumerate(
                zip(rows.column("text").to_pylist(), rows.column("runs").to_pylist(), strict=True)
            ):
                if runs and text:
                    raw, begin, first = text.encode(), int(piece.bounds[i]), int(words.first[i])
                    left, at = [], 0
                    for r in runs:
                        left.append(raw[at : int(words.starts[first + r["a"]]) - begin])
                        at = int(words.ends[first + r["b"] - 1]) - begin
                    text = b"".join([*left, raw[at:]]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [rows.column(c) if c != "text" else pa.array(texts, pa.string()) for c in rows.schema.names],
                names=rows.schema.names,
            )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    max_coverage: float = 0.5,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
) -> DataFrame:
    """docs without the hit stretches; documents with more than max_coverage hit words go.

    Other columns, of whatever name, stay as they are. Null texts stay null; blanks around a cut stay.
    """
    if not 0 <= max_coverage <= 1:
        raise ValueError("max_coverage is a share")
    others = [c for c in docs.columns if c != text_column]
    plain = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"),
        F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{text_column}`").alias("text"),
    )
    found = _hits(plain, benchmark, window, text_column, item_column)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["b"] - r["a"])
    kept = found.where(hit <= max_coverage * F.col("n_words")).select("row", "text", "runs")
    kept = kept.mapInArrow(_remove, kept.schema)
    return kept.select(
        *[F.col("text").alias(c) if c == text_column else F.col("row").getField(c).alias(c) for c in docs.columns]
    )
