"""Log-probabilities of texts under a probabilistic suffix tree of words.

The root's distribution has every word of the training texts, (c + 1) / (N + V + 1), and as much for a word
never seen. A context of one or two words is a candidate if some word follows it LEAST times or more, whatever
the corpus, and is kept if its next-word distribution diverges enough from that of its suffix:
n * KL >= (k + 1) / 2 * ln n, with n its occurrences and k the words that follow it LEAST times or more; suffixes of
kept contexts are kept. Its followers get (n(s, w) - DISCOUNT) / n(s), all other words share what is left in proportion
to the suffix's distribution. A word is scored in the longest context kept, so the probabilities of all words and
the unseen one add up to 1.

The tree is a table. A text's score is the root's plus a sum over its words, pairs and triples: the log of what a
context leaves to other words counts for each of its occurrences, and what a follower has beyond that for each
occurrence of the pair or triple. So every gram has one weight, and texts are scored by joining their grams with
the weights, both dealt by ranges of the grams' hashes. Only grams with at least a SHARE of all tokens (words: a
WORD_SHARE) are broadcast, at most 1 / SHARE of each length; being the frequent ones, they make no hot key in the
join. A bit table of at most 2 ** FILTER_BITS slots leaves out grams that surely have no weight; a full one only
leaves out less.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.text import SPACED, Slice, Words, list_array, mix, release, slices
from tabulon.plans.stage import discard, stage

#: Shares of all tokens from which words, and pairs and triples, are broadcast. The scores don't depend on them.
WORD_SHARE = 2e-7
SHARE = 2e-7
#: Occurrences from which a follower is explicit.
LEAST = 2
DISCOUNT = 0.5
CHUNK_TOKENS = 2_000_000
#: Lines of a chunk of scored texts, so that a gram names its line in two bytes.
CHUNK_LINES = 1 << 15
SCORED_TOKENS = 500_000
#: Bytes of texts whose grams are made together, and keys that are looked up together.
TOGETHER = 1 << 19
KEYS_TOGETHER = 1 << 18
#: Values that share their leading bits from which a table is searched without an index.
CROWDED = 64
#: Training tokens for each part that grams are dealt to.
PART_TOKENS = 2_000_000
#: The same for each part in which texts meet the weights, and for each part in which their lines are summed.
SCORED_PART_TOKENS = 2_000_000
LINE_PART_TOKENS = 128_000_000
#: Training tokens for each round in which texts are scored, and the most rounds: a round's shuffles go before the next.
ROUND_TOKENS = 256_000_000
ROUNDS = 4
FILTER_BITS = 28
_END = np.uint64(0x5851F42D4C957F2D)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def tokens(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, each row closed by an end, and where rows begin (and the last ends)."""
    words = Words(piece, SPACED)
    first = words.first + np.arange(len(words.first))
    out = np.empty(first[-1], dtype=np.uint64)
    is_end = np.zeros(first[-1], dtype=bool)
    is_end[first[1:] - 1] = True
    out[is_end] = _END
    out[~is_end] = words.hashes()
    return out, first


class Places:
    """A sorted table of hashes with an index by their leading bits, so that a value is compared with few of them."""

    def __init__(self, table: np.ndarray):
        self.table, self.low, self.shift, self.first, self.most = table, np.uint64(0), np.uint64(0), None, 0
        if len(table):
            self.low = table[0]
            span = int(table[-1]) - int(table[0])
            self.shift = np.uint64(max(0, span.bit_length() - len(table).bit_length()))
            size = np.bincount(((table - self.low) >> self.shift).astype(np.int64))
            self.most = int(size.max())
            self.first = np.zeros(len(size) + 1, dtype=np.int32 if len(table) < 1 << 31 else np.int64)
            np.cumsum(size, out=self.first[1:])

    def __len__(self) -> int:
        return len(self.table)

    def find(self, values: np.ndarray) -> np.ndarray:
        if self.most > CROWDED or not len(self):
            return _searched(values, self.table)
        out = np.full(len(values), -1, dtype=np.int64)
        for i in range(0, len(values), KEYS_TOGETHER):
            v = values[i : i + KEYS_TOGETHER]
            slot = (v - self.low) >> self.shift
            live = np.flatnonzero(slot < np.uint64(len(self.first) - 1))
            slot = slot[live].astype(np.int64)
            v, at, end = v[live], self.first[slot], self.first[slot + 1]
            more = at < end
            while more.any():
                live, v, at, end = live[more], v[more], at[more], end[more]
                there = self.table[at]
                same = there == v
                out[i + live[same]] = at[same]
                at = at + 1
                more = (there < v) & (at < end)
        return out


def _searched(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(values), -1, dtype=np.int64)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, -1)


def find(values: np.ndarray, table: np.ndarray | Places) -> np.ndarray:
    """Places of the values in a sorted table, -1 where missing."""
    if not isinstance(table, Places):
        if 4 * len(values) < len(table):
            return _searched(values, table)
        table = Places(table)
    return table.find(values)


def _order(key: np.ndarray) -> np.ndarray:
    """argsort of hashes: their leading bits are sorted with their places in the bits below, which is several times faster."""
    bits = np.uint64(len(key).bit_length())
    if not len(key):
        return np.zeros(0, dtype=np.int64)
    key = key.view(np.uint64)
    low = key.min()
    spare = 64 - int(key.max() - low).bit_length()
    places = (np.uint64(1) << bits) - np.uint64(1)
    lead = lambda x: ((x - low) << np.uint64(min(spare, 63))) & ~places
    packed = lead(key) | np.arange(len(key), dtype=np.uint64)
    packed.sort()
    packed &= places
    order = packed.view(np.int64)
    ordered = key[order]
    wrong = np.flatnonzero(ordered[1:] < ordered[:-1])
    if len(wrong) > CROWDED:
        return np.argsort(key)
    for i in wrong.tolist():  # these differ in the last bits only
        equal = lead(ordered[i : i + 1])[0]
        start, stop = i, i + 1
        while start and lead(ordered[start - 1 : start])[0] == equal:
            start -= 1
        while stop < len(key) and lead(ordered[stop : stop + 1])[0] == equal:
            stop += 1
        order[start:stop] = order[start:stop][np.argsort(key[order[start:stop]])]
    return order


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    fresh = np.ones(len(ordered), dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(fresh)


def _added(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts) if len(x) else x


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys in order, their sums, and a place of each among the given ones."""
    order = _order(key)
    key = key[order]
    at = _starts(key)
    return key[at], _added(n[order], at), order[at]


def _count_words(parts: int) -> Callable:
    """Counts of the words by chunks of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            h, n, _ = _summed(*(np.concatenate([x[j] for x in held]) for j in range(2)))
            return _packed(_parts(h, parts), {"h": h, "n": n})

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for piece in slices(batch.column("text")):
                held.append(np.unique(tokens(piece)[0], return_counts=True))
                if sum(len(x) for x, _ in held) >= CHUNK_TOKENS:
                    yield told(held)
                    held = []
        if held:
            yield told(held)
        release()

    return run


def _sum_words(table: pa.Table) -> pa.Table:
    h, n, _ = _summed(_bytes(table, "h"), _bytes(table, "n", np.int64))
    release()
    return pa.table({"h": _long(h), "n": pa.array(n)})


def joined(a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Hash of a gram of `length` words: a pair's words, or the two pairs of a triple."""
    return mix(a * _GOLDEN + mix(b + np.uint64(length)))


def grams(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the pair and the triple that end at each token, and where a row has them."""
    two = np.ones(len(h), dtype=bool)
    two[first[:-1]] = False
    three = two.copy()
    three[1:] &= two[:-1]
    pair, triple = np.zeros(len(h), dtype=np.uint64), np.zeros(len(h), dtype=np.uint64)
    pair[1:] = joined(h[:-1], h[1:], 2)
    triple[1:] = joined(pair[:-1], pair[1:], 3)
    return pair, two, triple, three


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def _dealt(part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each part, with lists of what it has of the columns: few rows, long lists."""
    if (part[1:] >= part[:-1]).all():  # sorted keys come as they are, without copies
        order = slice(None)
    else:
        order = np.argsort(part, kind="stable")
    names, size = np.unique(part, return_counts=True)
    lists = [list_array(_long(x[order]), size) for x in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *lists], names=["part", *columns])


def _packed(part: np.ndarray | int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each part, or for the one named, with the bytes of what it has of the columns (of 8 bytes a value)."""
    order = slice(None)
    if isinstance(part, int):
        names = np.array([part])
        ends = np.array([0, len(next(iter(columns.values())))])
    else:
        if not (part[1:] >= part[:-1]).all():
            order = np.argsort(part, kind="stable")
        names, size = np.unique(part, return_counts=True)
        ends = np.append(0, np.cumsum(size))
    ends = pa.py_buffer((8 * ends).astype(np.int32))
    data = [pa.py_buffer(np.ascontiguousarray(x[order])) for x in columns.values()]
    blobs = [pa.Array.from_buffers(pa.binary(), len(names), [None, ends, x]) for x in data]
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *blobs], names=["part", *columns])


def _bytes(table: pa.Table | pa.RecordBatch, name: str, kind: type = np.uint64) -> np.ndarray:
    """The values of a column of _packed, all rows one after the other."""
    column = table.column(name)
    pieces = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = chunk.drop_null().cast(pa.large_binary())
        if len(chunk):
            _, ends, data = chunk.buffers()
            ends = np.frombuffer(ends, dtype=np.int64)
            first, last = ends[chunk.offset], ends[chunk.offset + len(chunk)]
            if last > first:
                pieces.append(np.frombuffer(data, dtype=np.uint8)[first:last].view(kind))
    return np.concatenate(pieces) if pieces else np.zeros(0, dtype=kind)


def _parts(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def _flat(table: pa.Table, name: str) -> np.ndarray:
    if pa.types.is_binary(table.schema.field(name).type) or pa.types.is_large_binary(table.schema.field(name).type):
        return _bytes(table, name, np.float64 if name in ("base", "gain") else np.int64)
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _keys(table: pa.Table, name: str) -> np.ndarray:
    return _flat(table, name).astype(np.int64, copy=False).view(np.uint64)


def _passes(key: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """False only for keys that aren't in the bit table."""
    size = 8 * len(bits)
    slot = key >> np.uint64(64 - (size.bit_length() - 1))
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _bit_table(keys: DataFrame, parts: int) -> np.ndarray:
    """Bits of the keys, 16 slots a key up to the bound. keys: rows of _packed, dealt by the ranges of `key`."""
    n = (keys.agg(F.sum(F.octet_length("key"))).first()[0] or 0) // 8
    size = min(FILTER_BITS, max(parts + 3, math.ceil(math.log2(16 * max(1, n)))))
    size = max(size, parts + 3)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                here = (_bytes(row, "key") >> np.uint64(64 - size)).astype(np.int64) & ((1 << (size - parts)) - 1)
                bits = np.zeros(1 << (size - parts), dtype=np.uint8)
                bits[here] = 1
                packed = pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([row.column("part"), packed], names=["part", "bits"])

    marked = stage(keys.select("part", "key").mapInArrow(mark, "part int, bits binary"))
    out = np.zeros(1 << (size - 3), dtype=np.uint8)
    width = 1 << (size - 3 - parts)
    for row in marked.toLocalIterator():
        out[row["part"] * width : (row["part"] + 1) * width] |= np.frombuffer(row["bits"], dtype=np.uint8)
    discard(marked)
    return out


def _few_bits(keys: np.ndarray) -> np.ndarray:
    """A bit table of keys that are in memory, 8 to 16 slots each."""
    size = max(3, math.ceil(math.log2(8 * max(1, len(keys)))))
    bits = np.zeros(1 << size, dtype=np.uint8)
    bits[(keys >> np.uint64(64 - size)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def _find_few(values: np.ndarray, good: np.ndarray, table: np.ndarray | Places, bits: np.ndarray) -> np.ndarray:
    """find() for values of which few are in the table, -1 where not good."""
    out = np.full(len(values), -1, dtype=np.int64)
    at = np.flatnonzero(good & _passes(values, bits))
    out[at] = find(values[at], table)
    return out


def _count_grams(length: int, parts: int, shared=None):
    """Counts of the pairs, or of the triples whose pairs the bit table has, by chunks of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            a, b = (np.concatenate([x[j] for x in held]) for j in range(2))
            held.clear()
            key = joined(a, b, length)
            order = _order(key)
            key = key[order]
            first = _starts(key)
            n = np.diff(np.append(first, len(key)))
            key, order = key[first], order[first]
            return _packed(_parts(key, parts), {"a": a[order], "b": b[order], "n": n})

        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen = 0
        for batch in batches:
            for piece in slices(batch.column("text"), TOGETHER):
                h, first = tokens(piece)
                pair, two, _, three = grams(h, first)
                seen += len(h)
                if length == 2:
                    at = np.flatnonzero(two)
                    held.append((h[at - 1], h[at]))
                else:
                    good = two & _passes(pair, shared.value)
                    at = np.flatnonzero(three)
                    at = at[good[at] & good[at - 1]]
                    held.append((pair[at - 1], pair[at]))
                if seen >= CHUNK_TOKENS:
                    yield told(held)
                    held, seen = [], 0
        if held:
            yield told(held)
        release()

    return run


COUNTED = "part int, a binary, b binary, n binary"
PAIRS = "part int, key binary, a binary, b binary, n binary, na binary, nb binary"


def _merge(length: int, parts: int, shared=None):
    """Sum the counts of a part's grams and leave out those below LEAST.

    Pairs stay where they are, in the order of their keys, and their words get their counts if frequent, else -1.
    Triples are dealt by their second pair."""
    held: list[Places] = []

    def run(table: pa.Table) -> pa.Table:
        a, b = _bytes(table, "a"), _bytes(table, "b")
        key, sums, at = _summed(joined(a, b, length), _bytes(table, "n", np.int64))
        enough = sums >= LEAST
        at = at[enough]
        columns = {"key": key[enough], "a": a[at], "b": b[at], "n": sums[enough]}
        if shared is not None:
            words, counts = shared.value
            if not held:
                held.append(Places(words))
            for name in "ab":
                at = find(columns[name], held[0])
                known = np.append(counts, -1).astype(np.int64)[at]  # the last one where missing
                columns[f"n{name}"] = known
            out = _packed(table.column("part")[0].as_py(), columns)
        else:
            del columns["key"]
            out = _packed(_parts(columns["b"], parts), columns)
        release()
        return pa.Table.from_batches([out])

    return run


def _unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each part's pairs that have no count yet."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            h = np.unique(np.concatenate([_bytes(row, c)[_bytes(row, f"n{c}", np.int64) < 0] for c in "ab"]))
            part = np.full(len(h), row.column("part")[0].as_py(), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), _long(h)], names=["part", "h"])


def _fill(pairs: pa.Table, told: pa.Table) -> pa.Table:
    """A part's pairs with the counts of all their words."""
    h, n = (told.column(c).to_numpy() for c in ("h", "n"))
    order = _order(h)
    words, n = h.view(np.uint64)[order], n[order]
    columns = {c: _bytes(pairs, c) for c in ("key", "a", "b")} | {c: _bytes(pairs, c, np.int64) for c in ("n", "na", "nb")}
    for name in "ab":
        open_ = np.flatnonzero(columns[f"n{name}"] < 0)
        columns[f"n{name}"] = columns[f"n{name}"].copy()
        columns[f"n{name}"][open_] = n[find(columns[name][open_], words)]
    out = _packed(pairs.column("part")[0].as_py(), columns)
    release()
    return pa.Table.from_batches([out])


def _sums_of(context: np.ndarray, chance: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each run of equal contexts: its place, the sums of chance, of below and of the gain, and its length."""
    at = _starts(context)
    gain = chance * np.log(chance / below)
    return at, _added(chance, at), _added(below, at), _added(gain, at), np.diff(np.append(at, len(context)))


SUMS_OF_ONES = "a long, given double, had double, gain double, followers long, n_context long"


def _word_contexts(size: float) -> Callable:
    """Of the pairs at hand, sums by their first word; size: the root's denominator."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = _bytes(batch, "a")
            order = _order(a)
            a, (n, na, nb) = a[order], (_bytes(batch, c, np.int64)[order] for c in ("n", "na", "nb"))
            at, *sums = _sums_of(a, (n - DISCOUNT) / na, (nb + 1) / size)
            columns = [_long(a[at]), *map(pa.array, sums), pa.array(na[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "given", "had", "gain", "followers", "n_context"])

    return run


def _enough_words(sums: DataFrame) -> DataFrame:
    """Of each word: log of the rest's weight, and whether its divergence is enough."""
    sums = sums.groupBy("a").agg(
        *[F.sum(c).alias(c) for c in ("given", "had", "gain", "followers")], F.first("n_context").alias("n_context")
    )
    rest, had = (F.greatest(1 - F.col(c), F.lit(1e-12)) for c in ("given", "had"))
    gain = F.col("gain") + rest * F.log(rest / had)
    least = (F.col("followers") + 1) / 2 * F.log(F.greatest("n_context", F.lit(2)))
    return sums.select("a", F.log10(rest / had).alias("rest"), (F.col("n_context") * gain >= least).alias("enough"))


def _second_pairs(parts: int) -> Callable:
    """A part's triples with the counts of their second pairs, dealt by their first pairs."""

    def run(triples: pa.Table, pairs: pa.Table) -> pa.Table:
        a, b, n = _bytes(triples, "a"), _bytes(triples, "b"), _bytes(triples, "n", np.int64)
        n_pair = _bytes(pairs, "n", np.int64)[find(b, _bytes(pairs, "key"))] if len(b) else n
        out = _packed(_parts(a, parts), {"key": joined(a, b, 3), "a": a, "n": n, "n_pair": n_pair})
        release()
        return pa.Table.from_batches([out])

    return run


PAIR_CONTEXTS = "part int, two binary, two_rest binary, suffix binary, key binary, n binary, gain binary"


def _pair_contexts(triples: pa.Table, pairs: pa.Table) -> pa.Table:
    """Of a part's pairs, those that are kept as contexts, with the rest's weight and their suffixes, and what each
    triple in them gains."""
    a = _bytes(triples, "a")
    order = _order(a)
    a, key = a[order], _bytes(triples, "key")[order]
    n, n_pair = (_bytes(triples, c, np.int64)[order] for c in ("n", "n_pair"))
    two = _bytes(pairs, "key")
    if len(a):
        place = find(a, two)
        n_context, n_word = (_bytes(pairs, c, np.int64)[place] for c in ("n", "nb"))
    else:
        place = n_context = n_word = n
    chance, below = (n - DISCOUNT) / n_context, (n_pair - DISCOUNT) / n_word
    at, given, had, gain, followers = _sums_of(a, chance, below)
    rest, had = np.maximum(1 - given, 1e-12), np.maximum(1 - had, 1e-12)
    least = (followers + 1) / 2 * np.log(np.maximum(n_context[at], 2))
    enough = n_context[at] * (gain + rest * np.log(rest / had)) >= least
    rests = np.log10(rest / had)
    kept, each = place[at][enough], np.repeat(enough, followers)
    gains = (np.log10(chance) - np.log10(below) - np.repeat(rests, followers))[each]
    part = triples.column("part")[0].as_py() if triples.num_rows else pairs.column("part")[0].as_py()
    columns = {"two": two[kept], "two_rest": rests[enough], "suffix": np.unique(_bytes(pairs, "b")[kept])}
    columns = [_packed(part, {c: x}) for c, x in (columns | {"key": key[each], "n": n[each], "gain": gains}).items()]
    release()
    arrays = [columns[0].column("part"), *(x.column(1) for x in columns)]
    return pa.Table.from_arrays(arrays, names=["part", *(x.schema.names[1] for x in columns)])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([_long(np.unique(_bytes(batch, "suffix")))], names=["a"])


#: Words are of kind 1, pairs of 2, triples of 3, and 0 is all of a part together. Parts of frequent grams are below 0.
TAIL = "part int, kind int, key binary, base binary, known binary, gain binary, rest binary"
TAIL_KINDS = pa.schema([(x.split()[0], {"int": pa.int32(), "binary": pa.binary()}[x.split()[1]]) for x in TAIL.split(", ")])


def _tail_rows(kind: int, part: np.ndarray | int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    rows = _packed(part, columns)
    have = dict(zip(rows.schema.names, rows.columns, strict=True)) | {"kind": pa.array(np.full(rows.num_rows, kind, np.int32))}
    arrays = [have[c.name] if c.name in have else pa.nulls(rows.num_rows, c.type) for c in TAIL_KINDS]
    return pa.RecordBatch.from_arrays(arrays, schema=TAIL_KINDS)


def _pair_weights(shared, parts: int, total: int, size: float) -> Callable:
    """TAIL of a part's pairs: of the frequent ones what a follower and what a context gains, of the others the sum."""
    held: list[Places] = []

    def run(table: pa.Table) -> pa.Table:
        words, kept, rests = shared.value
        if not held:
            held.append(Places(words))
        key, a = _bytes(table, "key"), _bytes(table, "a")
        n, na, nb = (_bytes(table, c, np.int64) for c in ("n", "na", "nb"))
        rare = table.select(["h", "rest"]).filter(pc.is_valid(table.column("h")))
        h = rare.column("h").to_numpy().astype(np.int64).view(np.uint64)
        order = _order(h)
        rest_of = np.append(rare.column("rest").to_numpy()[order], np.nan)[find(a, h[order])]
        at = find(a, held[0])
        often = np.flatnonzero(at >= 0)
        rest_of[often] = np.where(kept[at[often]], rests[at[often]], np.nan)
        follower = np.log10((n - DISCOUNT) / na) - np.log10((nb + 1) / size) - rest_of
        follower[np.isnan(follower)] = 0.0
        two = _bytes(table, "two")
        order = _order(two)
        rest = np.append(_bytes(table, "two_rest", np.float64)[order], np.nan)[find(key, two[order])]
        gain = follower + np.where(np.isnan(rest), 0.0, rest)
        part, often = _parts(key, parts), n >= SHARE * total
        some = ~often & (gain != 0)
        out = [
            _tail_rows(2, -1 - part[often], {"key": key[often], "gain": follower[often], "rest": rest[often]}),
            _tail_rows(2, part[some], {"key": key[some], "gain": gain[some]}),
        ]
        release()
        return pa.Table.from_batches(out)

    return run


def _triple_weights(parts: int, total: int) -> Callable:
    """TAIL of the triples in contexts that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n, gain = _bytes(batch, "key"), _bytes(batch, "n", np.int64), _bytes(batch, "gain", np.float64)
            part, often = _parts(key, parts), n >= SHARE * total
            yield _tail_rows(3, -1 - part[often], {"key": key[often], "gain": gain[often]})
            yield _tail_rows(3, part[~often], {"key": key[~often], "gain": gain[~often]})

    return run


def _word_weights(parts: int) -> Callable:
    """TAIL of words (h, n, rest) that aren't frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            h, n, rest = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("h", "n", "rest"))
            key = h.view(np.uint64)
            return _tail_rows(1, _parts(key, parts), {"key": key, "base": np.log10(n + 1), "gain": rest})

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= KEYS_TOGETHER:
                yield told(held)
                held = []
        if held:
            yield told(held)

    return run


def _tail_part(table: pa.Table) -> pa.Table:
    """The weights of a part's words, pairs and triples in one row; frequent grams as they come."""
    part = table.column("part")[0].as_py()
    if part < 0:
        return table
    of_words = pc.equal(table.column("kind"), 1)
    words, others = table.filter(of_words), table.filter(pc.invert(of_words))
    both = lambda c, kind: np.concatenate([_bytes(words, c, kind), _bytes(others, c, kind)])
    key, gain = both("key", np.uint64), both("gain", np.float64)
    base, known = np.zeros(len(key)), np.zeros(len(key), dtype=np.int64)
    base_of = _bytes(words, "base", np.float64)
    base[: len(base_of)], known[: len(base_of)] = base_of, 1
    out = _tail_rows(0, part, {"key": key, "base": base, "known": known, "gain": gain})
    release()
    return pa.Table.from_batches([out])


def train(texts: DataFrame) -> dict:
    """The frequent grams of the column `text` with their weights, and as tables the vocabulary (h, n) and the weights
    of all other grams (key, base, known, gain; see TAIL).

    Pairs and triples stay packed by ranges of hashes from their count to their weight: pairs by their own, triples
    by that of the pair that the step at hand looks up in the pairs of the same range."""
    spark = texts.sparkSession
    context = spark.sparkContext
    cores = max(2 * context.defaultParallelism, 2)
    word_parts = min(16, math.ceil(math.log2(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    words = texts.mapInArrow(_count_words(word_parts), "part int, h binary, n binary").groupBy("part")
    vocabulary = stage(words.applyInArrow(_sum_words, "h long, n long"), texts=True)
    total, kinds = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    size = float(total + kinds + 1)
    often = vocabulary.where(F.col("n") >= WORD_SHARE * total).toArrow()  # at most 1 / WORD_SHARE
    rare = vocabulary.where(F.col("n") < WORD_SHARE * total)
    h = often.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    table, counts = h[order], often.column("n").to_numpy()[order].astype(np.float64)
    words = context.broadcast((table, counts))
    # grams travel packed by ranges of their hash; the parts grow with the cluster's cores and the texts
    parts, scored_parts, line_parts = (
        min(16, math.ceil(math.log2(max(cores, total / of)))) for of in (PART_TOKENS, SCORED_PART_TOKENS, LINE_PART_TOKENS)
    )

    def by_part(frame: DataFrame, *columns: str):
        return (frame.select("part", *columns) if columns else frame).groupBy("part")

    counted = by_part(texts.mapInArrow(_count_grams(2, parts), COUNTED))
    counted = stage(counted.applyInArrow(_merge(2, parts, words), PAIRS), texts=True)
    asked = counted.select("part", "a", "b", "na", "nb").mapInArrow(_unknown, "part int, h long")
    told = stage(asked.join(rare, "h").select("part", "h", "n"))
    pairs = stage(by_part(counted).cogroup(by_part(told)).applyInArrow(_fill, PAIRS))
    discard(counted)
    known = context.broadcast(_bit_table(pairs, parts))
    triples = by_part(texts.mapInArrow(_count_grams(3, parts, known), COUNTED))
    triples = stage(triples.applyInArrow(_merge(3, parts), COUNTED), texts=True)
    for used in (words, known):
        used.unpersist()

    sums = pairs.select("a", "n", "na", "nb").mapInArrow(_word_contexts(size), SUMS_OF_ONES)
    seconds = by_part(triples).cogroup(by_part(pairs, "key", "n"))
    seconds = seconds.applyInArrow(_second_pairs(parts), "part int, key binary, a binary, n binary, n_pair binary")
    twos = by_part(seconds).cogroup(by_part(pairs, "key", "b", "n", "nb"))
    twos = stage(twos.applyInArrow(_pair_contexts, PAIR_CONTEXTS))
    discard(triples)
    suffixes = twos.select("suffix").mapInArrow(_suffixes, "a long").distinct().withColumn("needed", F.lit(True))
    ones = _enough_words(sums).join(suffixes, "a", "left").where("enough or needed")
    ones = stage(ones.select(F.col("a").alias("one"), "rest"))

    tail = vocabulary.join(ones, vocabulary["h"] == ones["one"], "left")
    frequent = tail.where(F.col("n") >= WORD_SHARE * total).where("one is not null").select("one", "rest").toArrow()
    kept, rest1 = np.zeros(len(table), dtype=bool), np.zeros(len(table))
    at = find(frequent.column("one").to_numpy().astype(np.int64).view(np.uint64), table)
    kept[at], rest1[at] = True, frequent.column("rest").to_numpy()
    left = context.broadcast((table, kept, rest1))
    rests = told.join(ones, told["h"] == ones["one"]).select("part", "h", "rest")
    weighed = pairs.select("part", "key", "a", "n", "na", "nb")
    for more in (twos.select("part", "two", "two_rest"), rests):
        weighed = weighed.unionByName(more, allowMissingColumns=True)
    weighed = by_part(weighed).applyInArrow(_pair_weights(left, scored_parts, total, size), TAIL)
    tail = tail.where(F.col("n") < WORD_SHARE * total).select("h", "n", F.coalesce("rest", F.lit(0.0)).alias("rest"))
    tail = tail.mapInArrow(_word_weights(scored_parts), TAIL).union(weighed)
    tail = tail.union(twos.select("key", "n", "gain").mapInArrow(_triple_weights(scored_parts, total), TAIL))
    tail = stage(by_part(tail).applyInArrow(_tail_part, TAIL))
    left.unpersist()
    found = tail.where("part < 0").select("kind", "key", "gain", "rest").toArrow()

    def arrays(kind: int, *columns: str) -> list[np.ndarray]:
        got = found.filter(pc.equal(found.column("kind"), kind))
        key = _bytes(got, "key")
        order = np.argsort(key)
        return [key[order], *[_bytes(got, c, np.float64)[order] for c in columns]]

    pair, pair_gain, rest2 = arrays(2, "gain", "rest")
    triple, triple_gain = arrays(3, "gain")
    discard(ones, twos, pairs, told)
    return {
        "total": total, "kinds": kinds, "vocabulary": vocabulary, "tail": tail, "filter": _bit_table(tail.where("part >= 0"), scored_parts),
        "parts": scored_parts, "line_parts": line_parts, "table": table, "log_root": np.log10((counts + 1) / size), "kept": kept, "rest": rest1,
        "pairs": pair, "pair_gain": pair_gain, "kept2": ~np.isnan(rest2), "rest2": np.nan_to_num(rest2),
        "triples": triple, "triple_gain": triple_gain, "pair_bits": _few_bits(pair), "triple_bits": _few_bits(triple),
    }


def _gains(h: np.ndarray, ids: np.ndarray, first: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """What the frequent grams add to each token's log10, and the hashes and places of all other pairs and triples."""
    pair, two, triple, three = grams(h, first)
    out = np.zeros(len(h))
    at2 = _find_few(pair, two, model["pairs"], model["pair_bits"])
    at3 = _find_few(triple, three, model["triples"], model["triple_bits"])
    before, context = np.full(len(h), -1, dtype=np.int64), np.full(len(h), -1, dtype=np.int64)
    before[1:], context[1:] = ids[:-1], at2[:-1]
    before[~two], context[~three] = -1, -1
    for at, weights in (
        (before, model["rest"]), (at2, model["pair_gain"]), (context, model["rest2"]), (at3, model["triple_gain"])
    ):
        has = at >= 0
        out[has] += weights[at[has]]
    open2, open3 = np.flatnonzero(two & (at2 < 0)), np.flatnonzero(three & (at3 < 0))
    return out, np.concatenate([pair[open2], triple[open3]]), np.concatenate([open2, open3])


def gains(ids: np.ndarray, first: np.ndarray, model: dict) -> np.ndarray:
    """log10 of each token's chance in its context over that of the root, as far as the frequent grams say."""
    h = np.where(ids >= 0, model["table"][ids], np.uint64(0)) if len(model["table"]) else np.zeros(len(ids), np.uint64)
    return _gains(h, ids, first, model)[0]


SUMS = "part int, line array<long>, n array<long>, known array<long>, base array<double>, gain array<double>"
OWN = "own array<long>, id array<{0}>, out array<boolean>"
SCORED = SUMS + ", key array<long>, at array<short>, first long, " + OWN
SUMMED = SUMS + ", " + OWN


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch cut where its lines don't follow each other, and into at most CHUNK_LINES rows."""
    line = batch.column("line").to_numpy(zero_copy_only=False)
    cuts = {0, batch.num_rows, *range(0, batch.num_rows, CHUNK_LINES), *(np.flatnonzero(np.diff(line) != 1) + 1).tolist()}
    cuts = sorted(cuts)
    for i, j in zip(cuts, cuts[1:]):
        yield batch.slice(i, j - i)


def _with_nulls(columns: dict[str, pa.Array], names: list[str], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    """The columns in the order of names; those that are missing are null."""
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, kinds[c]) for c in names], names=names)


def _kinds(id_kind: pa.DataType) -> dict[str, pa.DataType]:
    """Arrow types of the columns of SCORED."""
    longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
    return {
        "part": pa.int32(), "line": longs, "n": longs, "known": longs, "base": doubles, "gain": doubles, "key": longs,
        "at": pa.list_(pa.int16()), "first": pa.int64(), "own": longs, "id": pa.list_(id_kind), "out": pa.list_(pa.bool_()),
    }


def _look_up(shared) -> Callable:
    """What the frequent grams give each line, with its id, and for each part the other grams with their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = dict(shared.value)
        for name in ("table", "pairs", "triples"):
            model[name] = Places(model[name])
        unseen = -math.log10(model["total"] + model["kinds"] + 1)

        def told(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            key, at = (np.concatenate([x[j] for x in held]) for j in range(2))
            line, *lines = (np.concatenate([x[2][j] for x in held]) for j in range(5))
            ids, out = (pa.concat_arrays([x[j] for x in held]) for j in (3, 4))
            kinds = _kinds(ids.type)
            names = list(kinds)
            if len(key):
                dealt = _dealt(_parts(key, model["parts"]), {"key": key, "at": (at - line[0]).astype(np.int16)})
                columns = dict(zip(dealt.schema.names, dealt.columns, strict=True))
                yield _with_nulls(columns | {"first": pa.array(np.full(dealt.num_rows, line[0]))}, names, kinds)
            whole = np.array([len(line)])
            columns = dict(zip(("line", "n", "known", "base", "gain"), (line, *lines), strict=True))
            columns = {c: list_array(_long(x), whole) for c, x in columns.items()}
            columns |= {"own": columns["line"], "id": list_array(ids, whole), "out": list_array(out, whole)}
            part = _parts(mix(line[:1].astype(np.uint64)), model["parts"])
            yield _with_nulls(columns | {"part": pa.array(part.astype(np.int32))}, names, kinds)

        held: list[tuple] = []
        seen = 0
        for batch in chain.from_iterable(map(_runs, batches)):
            for piece in slices(batch.column("text"), TOGETHER):
                line, ids, held_out = (batch.column(c).slice(piece.start, piece.rows) for c in ("line", "id", "held_out"))
                line = line.to_numpy(zero_copy_only=False).astype(np.int64)
                if held and not 0 <= line[-1] - held[0][2][0][0] < CHUNK_LINES:
                    yield from told(held)
                    held, seen = [], 0
                h, first = tokens(piece)
                words = find(h, model["table"])
                logs = np.full(len(words), unseen)
                logs[words >= 0] = model["log_root"][words[words >= 0]]
                row = np.repeat(np.arange(piece.rows), np.diff(first))
                out, key, place = _gains(h, words, first, model)
                rare = np.flatnonzero(words < 0)
                key, place = np.concatenate([h[rare], key]), np.concatenate([rare, place])
                good = _passes(key, model["filter"])
                known, base, gain = (np.add.reduceat(x, first[:-1]) for x in ((words >= 0).astype(np.int64), logs, out))  # each row has its end
                sums = (line, np.diff(first).astype(np.int64), known, base, gain)
                held.append((key[good], line[row[place[good]]], sums, ids, held_out))
                seen += len(h)
                if seen >= SCORED_TOKENS:
                    yield from told(held)
                    held, seen = [], 0
        if held:
            yield from told(held)
        release()

    return run


def _by_line(line: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = _order(line)
    line = line[order]
    first = _starts(line)
    return {"line": line[first], **{c: _added(x[order], first) for c, x in columns.items()}}


def _found(lists: pa.ChunkedArray, table: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys of all lists, one after the other, that a sorted table has, and their rows there before it was sorted."""
    hits, rows, seen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    table = Places(table)
    for chunk in lists.chunks:
        keys = chunk.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
        for i in range(0, len(keys), KEYS_TOGETHER):
            at = find(keys[i : i + KEYS_TOGETHER], table)
            hit = np.flatnonzero(at >= 0)
            hits.append(hit + (seen + i))
            rows.append(order[at[hit]])
        seen += len(keys)
    return np.concatenate(hits), np.concatenate(rows)


def _weigh(parts: int) -> Callable:
    """Sums by line of the weights of a part's grams, dealt to `parts` parts of the lines."""

    def run(texts: pa.Table, weights: pa.Table) -> pa.Table:
        key = _keys(weights, "key")
        order = _order(key)
        key = key[order]
        hit, at = _found(texts.column("key"), key, order)
        del key, order
        found = {c: _flat(weights, c)[at] for c in ("known", "base", "gain")}
        old = {c: _flat(texts, c) for c in ("n", "known", "base", "gain")}
        both = {c: np.concatenate([x, found.get(c, np.zeros(len(at), dtype=np.int64))]) for c, x in old.items()}
        grams = texts.filter(pc.is_valid(texts.column("first")))
        ends = np.cumsum(pc.list_value_length(grams.column("at")).to_numpy())
        at_line = grams.column("first").to_numpy()[np.searchsorted(ends, hit, side="right")] + _flat(grams, "at")[hit]
        sums = _by_line(np.concatenate([_flat(texts, "line"), at_line]), both)
        del both, old, at_line, hit, at
        dealt = _dealt(_parts(mix(sums["line"].astype(np.uint64)), parts), sums)
        kinds = _kinds(texts.schema.field("id").type.value_type)
        names = [c for c in kinds if c not in ("key", "at", "first")]
        found = [_with_nulls(dict(zip(dealt.schema.names, dealt.columns, strict=True)), names, kinds)]
        own = _flat(texts, "own").astype(np.int64)
        if len(own):
            part = _parts(mix(own.view(np.uint64)), parts)
            order = np.argsort(part, kind="stable")
            part, size = np.unique(part, return_counts=True)
            columns = {"part": pa.array(part.astype(np.int32)), "own": list_array(pa.array(own[order]), size)}
            for c in ("id", "out"):
                columns[c] = list_array(texts.column(c).combine_chunks().flatten().take(pa.array(order)), size)
            found.append(_with_nulls(columns, names, kinds))
        release()
        return pa.Table.from_batches(found)

    return run


def _sum_lines(table: pa.Table) -> pa.Table:
    """The sums of a part's lines, with their ids."""
    sums = _by_line(_flat(table, "line"), {c: _flat(table, c) for c in ("n", "known", "base", "gain")})
    at = np.searchsorted(sums.pop("line"), _flat(table, "own"))
    own = {c: table.column(c).combine_chunks().flatten() for c in ("id", "out")}
    return pa.table(own | {c: x[at] for c, x in sums.items()})


def score(docs: DataFrame, out: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score (log10 under the root alone) and score.

    Learns from the rows where the condition `out` is false (null counts as false). Words are runs of non-white-space
    of the text with A-Z lower-cased, and an end closes every text, so a null or empty text is one token. Rows are
    scored as they come, repeated ones too; other columns are ignored. Without training rows every token is unseen.
    Rows are numbered while they are read, so `docs` has to give them in the same order if a task runs again, as
    files do; write other frames to a table first.
    """
    out = F.coalesce(out, F.lit(False))
    plain = docs.select(
        F.col(f"`{id_column}`").alias("id"), out.alias("held_out"), F.col(f"`{text_column}`").alias("text")
    )
    model = train(plain.where("not held_out").select("text"))
    discard(model.pop("vocabulary"))
    tail, total = model.pop("tail"), model["total"]
    weights = tail.where("part >= 0").select("part", "key", "base", "known", "gain")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = plain.schema["id"].dataType.simpleString()
    rounds = min(ROUNDS, max(1, round(total / ROUND_TOKENS)))

    def scored(texts: DataFrame) -> DataFrame:
        numbered = texts.withColumn("line", F.monotonically_increasing_id()).select("line", "id", "held_out", "text")
        looked = numbered.mapInArrow(_look_up(shared), SCORED.format(kind))
        sums = looked.groupBy("part").cogroup(weights.groupBy("part")).applyInArrow(_weigh(model["line_parts"]), SUMMED.format(kind))
        return sums.groupBy("part").applyInArrow(_sum_lines, f"id {kind}, out boolean, n long, known long, base double, gain double")

    # a row's round follows from what is in it, so that each row is in one, however the rows come
    turn = F.pmod(F.xxhash64("id", "text"), F.lit(rounds))
    texts = [plain.where(turn == i) if rounds > 1 else plain for i in range(rounds)]
    lines = reduce(DataFrame.unionAll, [stage(scored(x), texts=True) for x in texts])
    discard(tail)
    shared.unpersist()
    return lines.select(
        F.col("id").alias(id_column),
        F.col("out").alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        (F.col("base") + F.col("gain")).alias("score"),
    )
