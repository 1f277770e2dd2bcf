"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece one token is kept: the last token of that prefix's encoding. It is the one token
that ends the prefix and forms, with the last token of the prefix before it, a pair that merging leaves alone.
So a prefix's encoding is read off backwards, bytes can be appended without touching what is there, and an
edit only redoes the entries behind it. The tables are those of tiktoken: bytes and ranks; texts are cut
into pieces by the vocabulary's pattern, and each piece is encoded by itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tabulon.llm.text import aliased, release

#: Entries that a task's memory of pieces and of pairs of tokens may hold; it starts anew beyond.
REMEMBERED = 200_000

_SEPARATORS = re.compile("[\x1c-\x1f]")


class Vocabulary:
    """Tokens by bytes and ids, and which pairs of tokens stay apart."""

    def __init__(self, raw: bytes):
        lines = (line.split() for line in raw.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = [0] * 256  # of the tokens that end in a byte
        for token in self.ranks:
            self.longest[token[-1]] = max(self.longest[token[-1]], len(token))
        self.stays_apart: dict[int, bool] = {}  # by the left token's id * 2^32 + the right one's
        self.stays_whole: dict[int, bool] = {}
        self._edges: dict[int, tuple[list[int], list[int]]] = {}

    def merged(self, data: bytes, below: int = 1 << 60) -> list[int]:
        """Merging by rank, the definition, with ranks below a bound; for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.ranks.get(x + y, below) for x, y in zip(parts, parts[1:])]
            rank = min(ranks)
            if rank >= below:
                break
            at = ranks.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def edges(self, token: int) -> tuple[list[int], list[int]]:
        """The tokens at the left and at the right end of a token while merging builds it, the byte first."""
        known = self._edges.get(token)
        if known is None:
            data = self.tokens[token]
            if len(data) == 1:
                known = ([token], [token])
            else:
                left, right = self.merged(data, token)
                known = ([*self.edges(left)[0], token], [*self.edges(right)[1], token])
            self._edges[token] = known
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens as they are: at no time is a merge across their border due
        before the next one that either token's end takes part in. A merge is due at its rank, the leftmost
        first."""
        ends, starts = self.edges(left)[1], self.edges(right)[0]
        tokens, never, i, j = self.tokens, 1 << 60, 0, 0
        while True:
            across = self.ranks.get(tokens[ends[i]] + tokens[starts[j]], never)
            before = ends[i + 1] if i + 1 < len(ends) else never
            behind = starts[j + 1] if j + 1 < len(starts) else never
            if across < before and across <= behind:
                known = False
                break
            if before == behind == never:
                known = True
                break
            if before <= behind:
                i += 1
            else:
                j += 1
        if len(self.stays_apart) >= 2 * REMEMBERED:
            self.stays_apart.clear()
        self.stays_apart[left << 32 | right] = known
        return known

    def whole(self, token: int) -> bool:
        """Whether a token's bytes are encoded as that token."""
        known = self.stays_whole.get(token)
        if known is None:
            known = self.stays_whole[token] = self.merged(self.tokens[token]) == [token]
        return known

    def extend(self, last: list[int], data: bytes, start: int, inner: bool = False) -> None:
        """Add to `last` the last tokens of the prefixes of data that are longer than start bytes.

        With inner, data is only the end of what is encoded. One token fits at most, so the short ones, which are more often found, are tried first.
        """
        rank, apart, longest, add = self.ranks.get, self.stays_apart.get, self.longest, last.append
        for end in range(start + 1, len(data) + 1):
            begin, stop = end - 1, max(0, end - longest[data[end - 1]])
            while begin >= stop:
                token = rank(data[begin:end])
                if token is not None:
                    if begin or inner:
                        left = last[begin]
                        fits = apart(left << 32 | token)
                        if fits is None:
                            fits = self.apart(left, token)
                    else:
                        fits = self.whole(token)
                    if fits:
                        add(token)
                        break
                begin -= 1
            else:
                raise ValueError(f"the vocabulary has no token for byte {data[end - 1]}")


    def encode(self, data: bytes) -> tuple[int, ...]:
        last = [-1]
        self.extend(last, data, 0)
        out, at, tokens = [], len(data), self.tokens
        while at:
            token = last[at]
            out.append(token)
            at -= len(tokens[token])
        return tuple(out[::-1])


class PrefixEncoder:
    """The encoding of a growing and changing byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), [-1]
        self.append(data)

    def append(self, data: bytes) -> PrefixEncoder:
        start = len(self.data)
        self.data += data
        reach = max(0, start - max(self.vocabulary.longest))  # new tokens begin behind
        if reach:
            recent = self.last[reach:]
            self.vocabulary.extend(recent, bytes(self.data[reach:]), start - reach, inner=True)
            self.last[reach:] = recent
        else:
            self.vocabulary.extend(self.last, bytes(self.data), start)
        return self

    def replace(self, start: int, stop: int, data: bytes) -> PrefixEncoder:
        """Put data in place of bytes [start, stop); entries before start stay. Behind the edit, entries are
        taken over once they agree with the old ones for as many bytes as the longest token has."""
        old, tail = self.last, bytes(self.data[stop:])
        shift, reach = start + len(data) - stop, max(self.vocabulary.longest)
        del self.data[start:]
        self.last = old[: start + 1]
        self.append(data)
        same = 0
        for i in range(len(tail)):
            self.append(tail[i : i + 1])
            end = len(self.data)
            same = same + 1 if self.last[end] == old[end - shift] else 0
            if same >= reach:
                self.data += tail[i + 1 :]
                self.last += old[end - shift + 1 :]
                break
        return self

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.tokens[self.last[at]])
        return out[::-1]


class _Pieces(dict):
    """Token ids by piece, computed when first asked for. Two generations: those used lately survive."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            data = piece.encode()
            rank = self.vocabulary.ranks.get(data)
            whole = rank is not None and self.vocabulary.whole(rank)
            ids = (rank,) if whole else self.vocabulary.encode(data)
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_loaded: dict[tuple[bytes, str], tuple] = {}


def ascii_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts of ASCII characters without the separators 1C to 1F, if it can be said without
    Unicode classes: there, the standard library's matching is the same and faster."""
    plain, inside, at = [], False, 0
    while at < len(pattern):
        for unicode_class, letters in (("\\p{L}", "a-zA-Z"), ("\\p{N}", "0-9")):
            if pattern.startswith(unicode_class, at):
                plain.append(letters if inside else f"[{letters}]")
                at += len(unicode_class)
                break
        else:
            if pattern[at] == "\\":
                plain.append(pattern[at : at + 2])
                at += 2
                continue
            inside = {"[": True, "]": False}.get(pattern[at], inside)
            plain.append(pattern[at])
            at += 1
    joined = "".join(plain)
    if "\\p" in joined or "(?i" in joined or "&&" in joined or "++" in joined:
        return None
    return re.compile(joined)


def _tools(raw: bytes, pattern: str) -> tuple:
    import regex

    key = (raw, pattern)
    if key not in _loaded:
        vocabulary = Vocabulary(raw)
        names = {i: str(i) for i in vocabulary.tokens}
        _loaded[key] = (regex.compile(pattern), _Pieces(vocabulary), vocabulary.tokens, names, ascii_pattern(pattern))
    return _loaded[key]


def encode_text(text: str, raw: bytes, pattern: str) -> list[int]:
    cut, pieces, _, _, plain = _tools(raw, pattern)
    if plain is not None and text.isascii() and not _SEPARATORS.search(text):
        cut = plain
    return list(chain.from_iterable(map(pieces.__getitem__, cut.findall(text))))


def decode_ids(ids: list[int], raw: bytes, pattern: str) -> bytes:
    return b"".join(map(_tools(raw, pattern)[2].__getitem__, ids))


def _encode(shared, pattern: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from _encoded(batches, shared.value, pattern, keep_ids)
        finally:
            _loaded.clear()  # workers outlive their task: what it remembered would stand beside later stages
            release()

    return run


def _encoded(batches: Iterator[pa.RecordBatch], raw: bytes, pattern: str, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    _, _, tokens, names, _ = _tools(raw, pattern)
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        first, held, column = 0, 0, batch.column("text")
        for i in range(len(column)):
            ids = encode_text(column[i].as_py() or "", raw, pattern)
            rows[0].append(len(ids))
            rows[1].append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
            rows[2].append(hashlib.sha256(b"".join(map(tokens.__getitem__, ids))).hexdigest())
            if keep_ids:
                rows[3].append(pa.array(ids, pa.int32()))
            held += len(ids)
            if held >= 2_000_000 or i + 1 == len(column):
                arrays = [batch.column("id").slice(first, i + 1 - first), pa.array(rows[0], pa.int64())]
                arrays += [pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
                fields = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    ends = [0]
                    for one in rows[3]:
                        ends.append(ends[-1] + len(one))
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(rows[3])))
                    fields.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=fields)
                first, held, rows = i + 1, 0, [[], [], [], []]


def encode(
    docs: DataFrame,
    vocabulary_path: str,
    pattern: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the bytes that
    the ids decode to) and, with keep_ids, ids.

    A null text is empty; an empty text has no token. Rows are kept as they come, other columns are ignored. The
    vocabulary file (at most 64 MB) is read on the driver and sent to the tasks.
    """
    with open(vocabulary_path, "rb") as file:
        raw = file.read()
    if len(raw) > 64 << 20:
        raise ValueError("a vocabulary of at most 64 MB is expected")
    plain = aliased(docs, {"id": id_column, "text": text_column})
    kind = plain.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    return plain.mapInArrow(_encode(shared, pattern, keep_ids), schema).withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, vocabulary_path: str, pattern: str, ids_column: str = "ids") -> DataFrame:
    """encoded with a binary column `decoded`; null ids give null."""
    with open(vocabulary_path, "rb") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                None if ids is None else decode_ids(ids, shared.value, pattern)
                for ids in batch.column(ids_column).to_pylist()
            ]
            yield batch.append_column("decoded", pa.array(out, pa.binary()))

    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, *StructType.fromDDL("decoded binary").fields]))
