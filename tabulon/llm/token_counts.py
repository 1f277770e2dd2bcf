"""Token counts of a `tokenizers` vocabulary that drops white space: lengths only, no ids leave the tasks.

Such a vocabulary normalises and splits at white space, so a space or a line feed is a safe boundary: the parts
between are tokenized alike in a text and alone. Each slice of a batch (of bounded bytes) is cut there, equal
parts are counted once, and the parts not seen before go through the library in batches of about equal bytes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabulon.llm.text import Words, aliased, slices

BATCH_BYTES = 1 << 18
REMEMBERED = 500_000

_PARTS = np.ones(256, dtype=bool)
_PARTS[[0x20, 0x0A]] = False

_loaded: dict[int, tuple] = {}


def splits_at_space(config: str) -> bool:
    """Whether the vocabulary's settings make a space or line feed a safe boundary."""
    found = json.loads(config)
    cutters = found.get("pre_tokenizer") or {}
    first = (cutters.get("pretokenizers") or [cutters])[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    wide = any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in found.get("added_tokens", []))
    return bool(drops) and "\\s" in first["pattern"].get("Regex", "") and not wide


def _lengths(tokenizer, parts: list[str]) -> Iterator[int]:
    batch, held = [], 0
    for i, part in enumerate(parts):
        batch.append(part)
        held += len(part)
        if held >= BATCH_BYTES or i + 1 == len(parts):
            for one in tokenizer.encode_batch_fast(batch, add_special_tokens=False):
                yield len(one.ids)
            batch, held = [], 0


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        key = hash(shared.value)
        if key not in _loaded:
            tokenizer = Tokenizer.from_str(shared.value)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _loaded[key] = (tokenizer, {})
        tokenizer, seen = _loaded[key]
        for batch in batches:
            for piece in slices(batch.column("text")):
                words = Words(piece, _PARTS, lower=False)
                h, first, code = np.unique(words.hashes(), return_index=True, return_inverse=True)
                names = h.tolist()
                new = [i for i, name in enumerate(names) if name not in seen]
                if len(seen) + len(new) > REMEMBERED:
                    seen.clear()
                    new = list(range(len(names)))
                spans = zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist(), strict=True)
                texts = [piece.data[a:b].tobytes().decode() for a, b in spans]
                for i, n in zip(new, _lengths(tokenizer, texts), strict=True):
                    seen[names[i]] = n
                each = np.array([seen[name] for name in names], dtype=np.int64)
                sums = np.zeros(len(words.row) + 1, dtype=np.int64)
                np.cumsum(each[code], out=sums[1:])
                if len(seen) > REMEMBERED:
                    seen.clear()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(piece.start, piece.rows),
                        pa.array(np.diff(piece.bounds)),
                        pa.array(np.diff(sums[words.first])),
                    ],
                    names=["id", "n_bytes", "n_tokens"],
                )

    return run


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Without begin, end or added special tokens, truncation or padding; special strings in a text count as the
    library counts them. A null text is empty; rows are kept as they come, other columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        config = file.read()
    if not splits_at_space(config):
        raise ValueError("this vocabulary may join text across white space")
    plain = aliased(docs, {"id": id_column, "text": text_column})
    kind = plain.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(config)
    counts = plain.mapInArrow(_count(shared), f"id {kind}, n_bytes long, n_tokens long")
    return counts.selectExpr(f"id as `{id_column}`", "n_bytes", "n_tokens", f"n_tokens > {int(limit)} as over_limit")
