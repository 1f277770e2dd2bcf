"""Alignment of two tokenizers' tokens over the same bytes, by an associative monoid of fragments.

Tokens of both sides end at byte offsets; where both end, a group closes. A fragment is what is known of a byte range:
the tokens before its first common end (open prefix), its closed groups, and the tokens after its last common end (open
suffix); a range without a common end is all prefix. Fragments of neighbouring ranges compose: the first's
open suffix and the second's open prefix close one group. The composition is associative, so a very long text
is cut into ranges of RANGE_BYTES that any tasks work on, and its fragments are composed FAN at a time, round by round, until
one is left. A range sees the tokens that end in it; what it tokenizes for them reaches to the next safe cuts.

Before a single space or line feed between two characters that aren't white space is a safe cut: no pre-token of side A
and no piece of side B spans it (`check_pieces`), so the parts between, with what they begin with, are tokenized alike in
space + text and alone. Equal parts are
tokenized once in a task, as far as REMEMBERED parts go, and the fragment of a part serves all its occurrences.

Links (a group's last tokens) are written per text as numbers, counted by pair over the corpus and weighed with those
counts: pairs with at least a SHARE of all links are broadcast, at most 1 / SHARE of them, others are joined.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.text import aliased, list_array, release
from tabulon.plans.stage import stage

#: Bytes of a range; texts of up to LONG_BYTES are one range.
RANGE_BYTES, LONG_BYTES = 1 << 14, 1 << 16
FAN = 16
RANGES_A_TASK = 256
REMEMBERED = 300_000
TOGETHER = 1 << 20
#: Links that are counted or weighed at once.
LINKS = 500_000
SHARE = 1e-6
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_SPACE = "▁"

_sides: dict[tuple, _Sides] = {}


class Fragment(NamedTuple):
    """Open prefix, closed groups (their text, joined by ;, and their links) and open suffix of a byte range.

    n_a, n_b: its tokens. whole: False if a side's bytes aren't the text's. A range without a common end has closed
    None and all its tokens in the prefix."""

    prefix: tuple[list[int], list[int]]
    closed: str | None
    links: bytes
    suffix: tuple[list[int], list[int]]
    n_a: int
    n_b: int
    whole: bool


EMPTY = Fragment(([], []), None, b"", ([], []), 0, 0, True)


def group_text(a: list[int], b: list[int]) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def _link(a: list[int], b: list[int], width: int) -> bytes:
    return np.int64(a[-1] * width + b[-1]).tobytes() if a and b else b""


def compose(x: Fragment, y: Fragment, width: int) -> Fragment:
    """The fragment of x's range followed by y's; associative, EMPTY is neutral."""
    n_a, n_b, whole = x.n_a + y.n_a, x.n_b + y.n_b, x.whole and y.whole
    if x.closed is None or y.closed is None:
        if x.closed is None:
            prefix = (x.prefix[0] + y.prefix[0], x.prefix[1] + y.prefix[1])
            return Fragment(prefix, y.closed, y.links, y.suffix, n_a, n_b, whole)
        suffix = (x.suffix[0] + y.prefix[0], x.suffix[1] + y.prefix[1])
        return Fragment(x.prefix, x.closed, x.links, suffix, n_a, n_b, whole)
    a, b = x.suffix[0] + y.prefix[0], x.suffix[1] + y.prefix[1]
    middle = [group_text(a, b)] if a or b else []
    closed = ";".join([t for t in (x.closed, *middle, y.closed) if t])
    links = x.links + (_link(a, b, width) if middle else b"") + y.links
    return Fragment(x.prefix, closed, links, y.suffix, n_a, n_b, whole)


def _closing(f: Fragment, width: int) -> Fragment:
    """A text's fragment: its first and last offset are ends of both sides, so open tokens are groups."""
    edge = Fragment(([], []), "", b"", ([], []), 0, 0, True)
    return compose(compose(edge, f, width), edge, width)


def of_tokens(
    a: list[int], ends_a: list[int], b: list[int], ends_b: list[int], width: int, whole: bool = True, first: bool = False
) -> Fragment:
    """The fragment of tokens with their ends, in one range; first: the range begins at an end of both sides."""
    texts, links = [], []
    prefix, closed = ([], []), first
    i = j = from_a = from_b = 0
    while i < len(a) and j < len(b):
        if ends_a[i] < ends_b[j]:
            i += 1
        elif ends_a[i] > ends_b[j]:
            j += 1
        else:
            i, j = i + 1, j + 1
            one, two = a[from_a:i], b[from_b:j]
            if closed:
                texts.append(group_text(one, two))
                links.append(_link(one, two, width))
            else:
                prefix, closed = (one, two), True
            from_a, from_b = i, j
    if not closed:
        return Fragment((a, b), None, b"", ([], []), len(a), len(b), whole)
    return Fragment(prefix, ";".join(texts), b"".join(links), (a[from_a:], b[from_b:]), len(a), len(b), whole)


class _Sides:
    """Both tokenizers: the tokens of a part with their ends, and whether their bytes are the part's."""

    def __init__(self, json_text: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(json_text)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=model)
        byte = {c: i for i, c in _byte_letters().items()}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode() for name in names]
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if raw else p.replace(_SPACE, " ").encode() for p, raw in pieces]
        self.width = len(pieces)
        self.length_a, self.length_b = (np.array([len(x) for x in of]) for of in (self.bytes_a, self.bytes_b))
        shown = [str(i) for i in range(max(len(names), len(pieces)))]
        self.digit_count = np.array([len(x) for x in shown])
        self.digits = np.zeros((len(shown), len(shown[-1]) + 1), dtype=np.uint8)
        for i, x in enumerate(shown):
            self.digits[i, : len(x)] = list(x.encode())
        self.seen: dict[str, tuple] = {}

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides. Side B adds a space, which takes the place of a part's own, or is left out again."""
        a = [x.ids for x in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        b = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        return a, [ids if p[0] == " " else ids[1:] for p, ids in zip(parts, b, strict=True)]

    def tokens(self, parts: list[str]) -> Iterator[tuple[list[int], list[int], list[int], list[int], bool]]:
        for part, a, b in zip(parts, *self.encode(parts), strict=True):
            raw_a, raw_b = ([of[t] for t in ids] for of, ids in ((self.bytes_a, a), (self.bytes_b, b)))
            whole = b"".join(raw_a) == part.encode() == b"".join(raw_b)
            yield a, list(accumulate(map(len, raw_a))), b, list(accumulate(map(len, raw_b))), whole

    def learn(self, parts: set[str]) -> None:
        """Know the parts: the text of their groups, links, tokens of each side, whether all bytes are there."""
        new = [p for p in parts if p not in self.seen]
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen.clear()
            new = list(parts)
        for start in range(0, len(new), 20_000):
            some = new[start : start + 20_000]
            a, b = self.encode(some)
            if not self._aligned(some, a, b):
                for part, one, two in zip(some, a, b, strict=True):
                    if not self._aligned([part], [one], [two]):  # the offsets mean nothing
                        self.seen[part] = ("", b"", 0, 0, False)

    def _aligned(self, parts: list[str], a: list[list[int]], b: list[list[int]]) -> bool:
        """Align parts that follow each other, all at once; False if a side's bytes aren't theirs.

        Both sides end at each part's end, so groups never cross parts."""
        raw = [p.encode() for p in parts]
        at = np.cumsum([len(r) for r in raw])
        ends, ids, counts = [], [], []
        for side, of, length in ((a, self.bytes_a, self.length_a), (b, self.bytes_b, self.length_b)):
            flat = list(chain.from_iterable(side))
            if b"".join([of[t] for t in flat]) != b"".join(raw):
                return False
            ids.append(np.array(flat, dtype=np.int64))
            ends.append(np.cumsum(length[ids[-1]]))
            counts.append(np.array([len(x) for x in side]))
            last = np.cumsum(counts[-1]) - 1
            if (counts[-1] == 0).any() or (ends[-1][last] != at).any():
                return False
        there = np.searchsorted(ends[1], ends[0])
        last_a = np.flatnonzero(ends[1][there] == ends[0])  # the tokens that end a group
        last_b = there[last_a]
        links = (ids[0][last_a] * self.width + ids[1][last_b]).tobytes()
        to = np.searchsorted(ends[0][last_a], at, side="right")  # groups up to each part's end
        text, stop = self._text(ids, (last_a, last_b), to)
        begin, group = 0, 0
        for part, n_a, n_b, g, e in zip(parts, counts[0].tolist(), counts[1].tolist(), to.tolist(), stop.tolist(), strict=True):
            self.seen[part] = (text[begin : e - 1], links[8 * group : 8 * g], n_a, n_b, True)
            begin, group = e, g
        return True

    def _text(self, ids: list[np.ndarray], last: tuple[np.ndarray, np.ndarray], to: np.ndarray) -> tuple[str, np.ndarray]:
        """The groups' text, each closed by ;, and where it ends behind the first `to` groups."""
        n = [len(x) for x in ids]
        group = [np.searchsorted(l, np.arange(k)) for l, k in zip(last, n, strict=True)]
        first_b = np.concatenate([[0], last[1][:-1] + 1])  # B tokens before each group
        place = [np.arange(n[0]) + first_b[group[0]], np.arange(n[1]) + last[0][group[1]] + 1]
        token, closing = np.empty(sum(n), dtype=np.int64), np.full(sum(n), ord(","), dtype=np.uint8)
        for side, mark in ((0, "|"), (1, ";")):
            token[place[side]] = ids[side]
            closing[place[side][last[side]]] = ord(mark)
        digits = self.digits[token]
        length = self.digit_count[token]
        digits[np.arange(len(token)), length] = closing
        text = digits[np.arange(digits.shape[1]) <= length[:, None]].tobytes().decode()
        ends = np.cumsum(length + 1)
        return text, ends[place[1][last[1][to - 1]]]


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable, else one above 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def check_pieces(pieces: list[str]) -> None:
    """Raise if a piece spans a space after another character, or has a line feed, so that there would be no safe cut."""
    if any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces):
        raise ValueError("a piece of the second vocabulary spans a space or a line feed")


def _sides_of(shared) -> _Sides:
    key = (len(shared.value[0]), hashlib.sha256(shared.value[1]).digest())
    if key not in _sides:
        _sides[key] = _Sides(*shared.value)
    return _sides[key]


def _whole_texts(texts: list[str], sides: _Sides) -> Iterator[Fragment]:
    """Fragments of texts, each composed of the closed fragments of its parts."""
    parts = [_CUT.split(" " + text) if text else [] for text in texts]
    sides.learn(set(chain.from_iterable(parts)))
    for own in parts:
        found = [sides.seen[p] for p in own]
        closed, links, n_a, n_b, whole = zip(*found, strict=True) if found else ((), (), (), (), ())
        if all(whole):
            yield Fragment(([], []), ";".join(closed), b"".join(links), ([], []), sum(n_a), sum(n_b), True)
        else:
            yield EMPTY._replace(whole=False)


FRAGMENT = (
    "line long, seq long, prefix_a array<int>, prefix_b array<int>, closed string, links binary, "
    "suffix_a array<int>, suffix_b array<int>, n_a long, n_b long, whole boolean"
)


def _row(f: Fragment) -> tuple:
    return (*f.prefix, f.closed, f.links, *f.suffix, f.n_a, f.n_b, f.whole)


def _fragment(row: tuple) -> Fragment:
    return Fragment((row[0], row[1]), row[2], row[3], (row[4], row[5]), row[6], row[7], row[8])


def _fragment_table(keys: list[tuple[int, int]], rows: list[tuple]) -> list[pa.Array]:
    columns = list(zip(*rows, strict=True)) or [()] * 9
    kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.binary()]
    kinds += [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.bool_()]
    key = list(zip(*keys, strict=True)) or [(), ()]
    return [pa.array(key[0], pa.int64()), pa.array(key[1], pa.int64()), *map(pa.array, columns, kinds)]


NAMES = [c.split()[0] for c in FRAGMENT.split(", ")]
DONE = "line long, n_a long, n_b long, links array<{}>, groups string, digest string"


def _done(lines: list[int], found: list[Fragment], keep_groups: bool, kind: type) -> pa.RecordBatch:
    ok = [f.whole and f.n_a > 0 for f in found]
    links = [np.frombuffer(f.links, dtype=np.int64) if good else np.zeros(0, np.int64) for f, good in zip(found, ok, strict=True)]
    flat = (np.concatenate(links) if links else np.zeros(0, np.int64)).astype(kind)
    texts = [f.closed if good else "" for f, good in zip(found, ok, strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(lines, pa.int64()),
            pa.array([f.n_a if good else 0 for f, good in zip(found, ok, strict=True)], pa.int64()),
            pa.array([f.n_b if good else 0 for f, good in zip(found, ok, strict=True)], pa.int64()),
            list_array(pa.array(flat), np.array([len(x) for x in links], dtype=np.int64)),
            pa.array(texts if keep_groups else [None] * len(texts), pa.string()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts], pa.string()),
        ],
        names=["line", "n_a", "n_b", "links", "groups", "digest"],
    )


def _align_short(shared, keep_groups: bool, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides_of(shared)
        for batch in batches:
            lines = batch.column("line").to_pylist()
            start, held, texts = 0, 0, []
            for i, text in enumerate(batch.column("text")):
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= TOGETHER or i + 1 == batch.num_rows:
                    done = _done(lines[start : i + 1], list(_whole_texts(texts, sides)), keep_groups, kind)
                    id_ = batch.column("id").slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([id_, *done.columns], names=["id", *done.schema.names])
                    start, held, texts = i + 1, 0, []
        sides.seen.clear()  # workers outlive their task
        release()

    return run


def ranges(text: str, size: int) -> Iterator[tuple[int, str, int, int]]:
    """(number, window, from, to) of ranges of about `size` bytes of space + text: the window is what lies between the safe
    cuts around the range, which is (from, to] of the window's bytes.

    A range within one unbroken run joins the range before it, so no run is tokenized more than twice as often as
    it is long in ranges."""
    text = " " + text
    cuts = [0, *(m.start() for m in _CUT.finditer(text))]  # where parts begin
    begin = np.concatenate([[0], np.cumsum([len(text[i:j].encode()) for i, j in zip(cuts, [*cuts[1:], len(text)], strict=True)])])
    total, start, number = int(begin[-1]), 0, 0
    while start < total:
        stop = min(start + size, total)
        i = int(np.searchsorted(begin, start, side="right")) - 1
        j = int(np.searchsorted(begin, stop, side="left"))
        if j < len(begin) and begin[j] - stop > size:  # deep in a run
            stop = int(begin[j])
        here, there = cuts[i], (cuts[j] if j < len(cuts) else len(text))
        yield number, text[here:there], start - int(begin[i]), stop - int(begin[i])
        start, number = stop, number + 1


def _cut_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["line", "seq", "window", "start", "stop", "ranges"]
        for batch in batches:
            for line, text in zip(batch.column("line").to_pylist(), batch.column("text"), strict=True):
                rows = [(line, *x) for x in ranges(text.as_py(), size)]
                rows = [(*x, len(rows)) for x in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    return run


CUT = "line long, seq long, window string, start long, stop long, ranges long"


def range_fragment(window: str, start: int, stop: int, sides: _Sides) -> Fragment:
    """The tokens of a window that end in (start, stop] of its bytes, as a fragment."""
    a, ends_a, b, ends_b, at = [], [], [], [], 0
    for one, to_a, two, to_b, whole in sides.tokens(_CUT.split(window)):
        if not whole:
            return EMPTY._replace(whole=False)
        a += one
        b += two
        ends_a += [at + x for x in to_a]
        ends_b += [at + x for x in to_b]
        at = ends_a[-1]
    own_a, own_b = (slice(bisect_right(ends, start), bisect_right(ends, stop)) for ends in (ends_a, ends_b))
    return of_tokens(a[own_a], ends_a[own_a], b[own_b], ends_b[own_b], sides.width)


def _range_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides_of(shared)
        for batch in batches:
            for i in range(batch.num_rows):
                line, seq, window, start, stop = (batch.column(k)[i].as_py() for k in ("line", "seq", "window", "start", "stop"))
                row = _row(range_fragment(window, start, stop, sides))
                yield pa.RecordBatch.from_arrays(_fragment_table([(line, seq)], [row]), names=NAMES)

    return run


def _compose_group(width: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        whole = EMPTY
        for row in zip(*(table[name].to_pylist() for name in NAMES[2:]), strict=True):
            whole = compose(whole, _fragment(row), width)
        key = (table["line"][0].as_py(), table["seq"][0].as_py() // FAN)
        return pa.Table.from_arrays(_fragment_table([key], [_row(whole)]), names=NAMES)

    return run


def _finish(width: int, keep_groups: bool, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(name).to_pylist() for name in NAMES[2:]), strict=True)
            for line, row in zip(batch.column("line").to_pylist(), rows, strict=True):
                yield _done([line], [_closing(_fragment(row), width)], keep_groups, kind)

    return run


def _few_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most LINKS links, or of one row."""
    for batch in batches:
        to = batch.column("links").offsets.to_numpy()
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(to, to[start] + LINKS, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

    held: list[np.ndarray] = []
    for batch in _few_links(batches):
        held.append(batch.column("links").flatten().to_numpy(zero_copy_only=False))
        if sum(map(len, held)) >= 2_000_000:
            yield told(held)
            held = []
    if held:
        yield told(held)


def _weigh(shared):
    """Sums over each line's links of broadcast pairs; the other links' pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = shared.value
        for batch in _few_links(batches):
            links = batch.column("links")
            n = np.diff(links.offsets.to_numpy())
            flat = links.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(pairs, flat)
            at[at == len(pairs)] = 0
            hit = pairs[at] == flat if len(pairs) else np.zeros(len(flat), dtype=bool)
            to = np.concatenate([[0], np.cumsum(n)])

            def by_row(values: np.ndarray, to: np.ndarray = to) -> np.ndarray:
                sums = np.zeros(len(values) + 1, dtype=np.int64)
                np.cumsum(values, out=sums[1:])
                return np.diff(sums[to])

            known = [np.where(hit, x[at], 0) if len(pairs) else np.zeros(len(flat), np.int64) for x in (best, counts)]
            rest = list_array(pa.array(flat[~hit]), by_row(~hit))
            kept = [batch.column(k) for k in ("line", "id", "n_a", "n_b", "groups", "digest")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(n.astype(np.int64)), *(pa.array(by_row(x)) for x in known), rest],
                names=["line", "id", "n_a", "n_b", "groups", "digest", "n_groups", "n_best", "count_sum", "rest"],
            )

    return run


def aligned_tokens(
    docs: DataFrame, json_path: str, model_path: str, id_column: str = "doc_id", text_column: str = "text",
    range_bytes: int = RANGE_BYTES, long_bytes: int = LONG_BYTES, keep_groups: bool = False,
) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups if asked for.

    Side A encodes space + text by a byte-level vocabulary (.json), side B the text by pieces with byte fallback (.model),
    which adds the space; special tokens' strings are plain text. groups is `a1,a2|b1;a3|b2,b3`, ids in order. A link is
    the pair of tokens of both sides that end together, its count the corpus's links of the same ids; n_best are the links
    whose count is the highest of their B id, ties included; count_sum adds the counts. Null and empty texts, and
    texts of which a side's bytes differ from space + text, have no tokens: zeros and an empty string. Rows come out
    as they come in, repeated rows and ids too, and all take part in the counts; other columns are ignored.
    """
    spark = docs.sparkSession
    with open(json_path, encoding="utf-8") as file:
        json_text = file.read()
    with open(model_path, "rb") as file:
        model = file.read()
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    pieces = SentencePieceProcessor(model_proto=model)
    width = pieces.get_piece_size()
    check_pieces([pieces.id_to_piece(i) for i in range(width)])
    shared = spark.sparkContext.broadcast((json_text, model))
    plain = aliased(docs, {"id": id_column, "text": text_column})
    id_kind = plain.schema["id"].dataType.simpleString()
    lined = plain.select(F.monotonically_increasing_id().alias("line"), "id", "text")

    small = pieces.get_piece_size() * Tokenizer.from_str(json_text).get_vocab_size() < 1 << 31
    kind, link = (np.int32, "int") if small else (np.int64, "long")
    done_shape = DONE.format(link)

    is_long = F.coalesce(F.octet_length("text") > long_bytes, F.lit(False))
    short = stage(lined.where(~is_long).mapInArrow(_align_short(shared, keep_groups, kind), f"id {id_kind}, {done_shape}"), texts=True)
    texts = stage(lined.where(is_long).select((-1 - F.col("line")).alias("line"), "id", "text"))  # no line of a short text
    cut = stage(texts.select("line", "text").mapInArrow(_cut_batches(range_bytes), CUT))
    most, several = cut.agg(F.coalesce(F.max("ranges"), F.lit(0)), F.count("*")).first()
    tasks = max(spark.sparkContext.defaultParallelism, several // RANGES_A_TASK)
    fragments = stage(cut.repartition(tasks, "line", "seq").mapInArrow(_range_batches(shared), FRAGMENT))
    while most > 1:
        together = fragments.groupBy("line", F.floor(F.col("seq") / FAN).alias("several"))
        fragments = stage(together.applyInArrow(_compose_group(width), FRAGMENT))
        most = -(-most // FAN)
    long = fragments.mapInArrow(_finish(width, keep_groups, kind), done_shape).join(texts.select("line", "id"), "line")
    done = short.unionByName(stage(long))

    counts = done.select("links").mapInArrow(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stage(counts.withColumn("b", F.col("pair") % width), texts=True)
    top = counts.groupBy("b").agg(F.max("n").alias("top"))  # at most a row for each piece
    judged = counts.join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = judged.where(F.col("n") >= SHARE * total).toArrow().sort_by("pair")
    weights = [often[c].to_numpy().astype(np.int64) for c in ("pair", "n", "best")]
    known = spark.sparkContext.broadcast(tuple(weights))
    shape = (
        f"line long, id {id_kind}, n_a long, n_b long, groups string, digest string, n_groups long, n_best long, "
        "count_sum long, rest array<long>"
    )
    weighed = stage(done.mapInArrow(_weigh(known), shape), texts=True)
    rare = weighed.select("line", F.explode("rest").alias("pair")).join(judged.where(F.col("n") < SHARE * total), "pair")
    rare = rare.groupBy("line").agg(F.count_if("best").alias("more_best"), F.sum("n").alias("more"))
    out = weighed.drop("rest").join(rare, "line", "left")
    return out.select(
        F.col("id").alias(id_column), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"),
        F.col("digest").alias("groups_sha256"), *(["groups"] if keep_groups else []),
    )
