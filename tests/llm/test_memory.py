"""Arrays that tasks hold at once, as numpy reports them."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tabulon.llm import langid, lm, text


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def texts(rows, words):
    rng = np.random.default_rng(1)
    return [" ".join(map("w{}x".format, rng.integers(0, 5000, words))) for _ in range(rows)]


def batch_of(rows, words):
    lang = pa.array(["en", "de"] * (rows // 2))
    return pa.RecordBatch.from_arrays([pa.array(texts(rows, words)), lang], names=["text", "lang"])


def test_language_id_holds_little_of_a_batch(monkeypatch):
    monkeypatch.setattr(text, "_powers", {})
    batch = batch_of(3000, 300)  # 6 MB, several slices
    told = []
    assert peak_mb(lambda: told.extend(langid._count(iter([batch])))) < 60
    counts = {"en": np.full(langid.BUCKETS, 0.5), "de": np.full(langid.BUCKETS, 0.5)}
    for part in told:
        for lang, bucket, n in zip(*(part.column(i).to_pylist() for i in range(3))):
            counts[lang][bucket] += n
    table = np.stack([counts["de"], counts["en"]], axis=1)
    model = {"langs": ["de", "en"], "table": np.log(table / table.sum(axis=0))}
    found = []

    def run():
        for piece in text.slices(batch.column("text"), langid.TOGETHER):
            found.append(langid.infer(piece, model)[1])

    assert peak_mb(run) < 60
    whole = langid.infer(next(text.slices(batch.column("text"), 1 << 30)), model)[1]
    np.testing.assert_allclose(np.concatenate(found), whole, rtol=1e-12)


def part_of_texts(keys, at):
    """A part's lists as _look_up gives them: two runs of lines, then these lines' own sums."""
    kinds = lm._kinds(pa.int64())
    lists = lambda x, kind: pa.array([x[: len(x) // 2], x[len(x) // 2 :]], kind)
    grams = {"part": pa.array([0, 0], pa.int32()), "key": lists(keys, kinds["key"]), "at": lists(at, kinds["at"]), "first": pa.array([0, 50])}
    line = np.arange(100)
    own = {"part": pa.array([0], pa.int32()), "own": [line], "id": [line], "line": [line], "out": [[False] * 100]}
    own |= {"n": [line], "known": [0 * line], "base": [0.0 * line], "gain": [0.0 * line]}
    own = {c: x if c == "part" else pa.array(x, kinds[c]) for c, x in own.items()}
    return pa.Table.from_batches([lm._with_nulls(x, list(kinds), kinds) for x in (grams, own)])


def test_keys_are_looked_up_in_pieces():
    rng = np.random.default_rng(2)
    n = 2_000_000
    keys = rng.integers(0, 1 << 62, n)
    known = rng.permutation(np.unique(keys[:2000]))
    keys[1_500_000] = known[0]
    at = rng.integers(0, 50, n).astype(np.int16)
    table = part_of_texts(keys, at)
    gain = rng.random(len(known))
    weights = pa.table({
        "part": pa.array([0], pa.int32()), "key": pa.array([known]), "base": pa.array([np.zeros(len(known))]),
        "known": pa.array([np.ones(len(known), np.int64)]), "gain": pa.array([gain]),
    })
    out = []
    assert peak_mb(lambda: out.append(lm._weigh(2)(table, weights))) < 30
    by_key = dict(zip(known.tolist(), gain))
    expected, hits = np.zeros(100), np.zeros(100, np.int64)
    for i in np.flatnonzero(np.isin(keys, known)).tolist():
        line = int(at[i]) + (50 if i >= n // 2 else 0)
        expected[line] += by_key[int(keys[i])]
        hits[line] += 1
    lines, sums, counted = (lm._flat(out[0], c) for c in ("line", "gain", "known"))
    order = np.argsort(lines)
    np.testing.assert_array_equal(lines[order], np.arange(100))
    np.testing.assert_allclose(sums[order], expected)
    np.testing.assert_array_equal(counted[order], hits)
