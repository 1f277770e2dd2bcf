"""Links by n-gram overlap, aligned tokenizers and hard negatives against brute force and edge cases."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_documents import spaced

from tabulon.llm import align, jaccard, minhash, negatives, overlap
from tabulon.llm.queries import QUERIES, SQL

P = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"


def against_sql(spark, name, tables):
    con = duckdb.connect()
    for table in tables:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    got = QUERIES[name](spark, FOLDER)
    want = con.execute(f"select {', '.join(got.columns)} from ({SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(
    "name, table", [("op1_minhash", "documents"), ("op11_ngram_join", "documents"), ("op13_hard_negatives", "embeddings")]
)
def test_queries_against_sql(spark, name, table):
    against_sql(spark, name, [table])


def linked(texts, width, permille):
    """{line: (set size, least line reachable)} over all pairs."""
    sets = []
    for text in texts:
        w = spaced(text)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    root = list(range(len(texts)))

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 1000 * len(x & y) >= permille * len(x | y):
                a, b = up(i), up(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(x), up(i)) for i, x in enumerate(sets)}


def test_one_shared_ngram_is_no_candidate(spark):
    few = spark.createDataFrame(
        [(7, 1, 100, 100), (7, 2, 100, 100), (8, 1, 100, 99), (8, 3, 100, 99), (9, 1, 100, 98), (9, 3, 100, 98),
         (5, 4, 2, 2), (5, 5, 2, 2), (6, 4, 2, 2), (6, 5, 2, 2)],
        "bucket long, node long, n long, rest long",
    )
    met = overlap.meetings(few, 900, 2).collect()
    assert sorted((r["a"], r["b"], r["sizes"]) for r in met) == [(1, 3, 200), (4, 5, 4)]
    small = overlap.meetings(few, 900, 3).collect()  # sets of two n-grams overlap in two at most
    assert [(r["a"], r["b"]) for r in small] == [(4, 5)]


def test_tables_of_buckets_go(spark, monkeypatch):
    gone = []
    monkeypatch.setattr(overlap, "discard", lambda *frames: gone.extend(f.columns for f in frames))
    words = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(1, words), (2, words + " end"), (3, "other " + words)], "doc_id long, text string")
    found = jaccard.ngram_join(rows).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 1, 3: 1}
    assert len(gone) == 2


@pytest.mark.parametrize("similarity", [0.5, 0.75, 0.9])
def test_small_sets_share_all_they_overlap_in(spark, similarity):
    r = random.Random(5)
    texts = [" ".join(r.choices("abcd", k=r.randrange(1, 14))) for _ in range(250)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.ngram_join(rows, width=1, similarity=similarity).collect()}
    assert got == linked(texts, 1, round(1000 * similarity))


def family(seed):
    """Near copies around cores with edits of growing size, chains, subsets, copies, and passages that many share."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    core, passage, chain = ([word() for _ in range(n)] for n in (90, 60, 120))
    texts = []
    for _ in range(110):
        w = list(core)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w[r.randrange(4) : 90 - r.randrange(4)]))
    for i in range(40):  # parts of one text, so that sizes differ
        texts.append(" ".join(core[: 60 + i % 30]))
    for _ in range(60):
        texts.append(" ".join([*passage, *[word() for _ in range(r.randrange(3, 30))]]))
    for _ in range(25):
        chain[r.randrange(len(chain))] = word()
        texts.append(" ".join(chain))
    texts += [r.choice(texts).upper() for _ in range(20)] + ["a b c", "a b c d", "a b", "A  B", "", " ", None]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("few, permille, width", [(32, 900, 3), (3, 900, 3), (3, 700, 2)])
def test_ngram_join(spark, monkeypatch, few, permille, width):
    """Hub rounds (few = 3) give the links of all pairs."""
    monkeypatch.setattr(overlap, "FEW", few)
    texts = family(few)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    found = jaccard.ngram_join(df, width=width, similarity=permille / 1000)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == linked(texts, width, permille)


def test_comparisons_of_a_group_follow_its_size(spark, monkeypatch):
    """Products of one group of near copies grow with its members, not with their square."""
    compared = []
    plain = overlap.stage

    def counting(df):
        out = plain(df)
        if df.columns == ["line", "a", "label_a", "b", "label_b", "hub"]:
            compared.append(out.count())
        return out

    monkeypatch.setattr(overlap, "stage", counting)
    for n in (300, 1500):
        r = random.Random(n)
        core = [f"w{r.randrange(9000)}" for _ in range(200)]
        texts = []
        for _ in range(n):
            w = list(core)
            for _ in range(r.randrange(6)):
                w[r.randrange(200)] = f"v{r.randrange(99999)}"
            texts.append(" ".join(w))
        compared.clear()
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert jaccard.ngram_join(df).count() == n and sum(compared) <= 2 * n


def test_joins_on_odd_and_empty_tables(odd, nothing):
    rows = collections.Counter(map(tuple, jaccard.ngram_join(odd).collect()))
    assert sum(rows.values()) == 13 and rows[(1, 0, 1)] == rows[(2, 0, 2)] == 1
    assert rows[(None, 58, 5)] == 1 and rows[(5, 58, 5)] == 2 and rows[(6, 59, 5)] == 1  # the null id's text is that of 5
    assert rows[(10, 1, 10)] == rows[(11, 1, 10)] == 1
    assert jaccard.ngram_join(nothing).count() == 0
    found = collections.Counter((r["doc_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect())
    assert found[(None, False)] == 1 and found[(5, True)] == 2 and found[(6, False)] == 1
    kept = minhash.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 7, 8, 9, 10]
    alone = odd.where("doc_id is null")
    assert [r["component_id"] for r in minhash.near_duplicates(alone.union(alone)).collect()] == [None, None]
    assert minhash.representatives(alone.union(alone)).count() == 1
    assert minhash.representatives(nothing).count() == 0


@pytest.fixture(scope="module")
def sides():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file, open(P.path("piece_bpe_32k.model"), "rb") as model:
        return align._Sides(file.read(), model.read())


def aligned(texts, sides):
    """{line: the contract's columns} by whole texts."""
    counts, out = collections.Counter(), {}
    for line, text in enumerate(texts):
        out[line] = (0, 0, 0, 0, 0, 0, "")
        if not text:
            continue
        a, b, raw = sides.a.encode(" " + text, add_special_tokens=False).ids, sides.b.encode(text), (" " + text).encode()
        if b"".join(sides.bytes_a[i] for i in a) != raw or b"".join(sides.bytes_b[i] for i in b) != raw:
            continue
        ends = [np.cumsum([len(of[i]) for i in ids]).tolist() for of, ids in ((sides.bytes_a, a), (sides.bytes_b, b))]
        at = [dict(zip(e, range(1, len(e) + 1), strict=True)) for e in ends]
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            groups.append(",".join(map(str, a[i : at[0][end]])) + "|" + ",".join(map(str, b[j : at[1][end]])))
            i, j = at[0][end], at[1][end]
            links.append((a[i - 1], b[j - 1]))
        counts.update(links)
        out[line] = (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for line, row in out.items():
        if len(row) == 5:
            links = row[3]
            sums = sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)
            out[line] = (*row[:3], len(links), *sums, row[4])
    return out


@pytest.mark.parametrize("share", [1e-6, 1e-2])
def test_alignment(spark, sides, monkeypatch, share):
    """Short and cut texts, of whatever white space and scripts, with broadcast and joined pairs."""
    monkeypatch.setattr(align, "SHARE", share)
    texts = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40).collect()]
    texts += [
        None, "", " ", "  two  spaces ", "tab\tand\nline \r\n", "<|endoftext|> and <s>hi</s> <unk>", "a▁b", "x ▁ y", " no break space",
        "漢字 かな 🙂🙂 mixed", "naïve café ́x", "null \x00 byte", "nospaces" * 700, "é" * 900, "word " * 800, "tail ▁" * 300, "1 22 333 '" * 200,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    want = aligned(texts, sides)
    for options in ({}, {"long_bytes": 200, "range_bytes": 37}):
        found = align.aligned_tokens(df, *paths, **options)
        assert {r["doc_id"]: tuple(r)[1:] for r in found.collect()} == want


def test_links_are_counted_and_weighed_in_small_runs(monkeypatch):
    monkeypatch.setattr(align, "LINKS", 4)
    lists = [[1, 2], [], [3, 3, 1], [1] * 9, [2], [3]]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32()))], names=["links"])
    cut = list(align._few_links([batch, batch.slice(2, 3)]))
    assert [b.num_rows for b in cut] == [2, 1, 1, 2, 1, 1, 1]
    assert [x for b in cut for x in b.column("links").to_pylist()] == lists + lists[2:5]
    found = pa.Table.from_batches(align._count_pairs([batch, batch.slice(2, 3)])).to_pydict()
    assert dict(zip(found["pair"], found["n"], strict=True)) == {1: 21, 2: 3, 3: 5}


def test_fragments_compose_in_any_order(sides):
    r = random.Random(5)
    text = "unbelievable tokenization, of café-words 漢字 and 12345 " * 6
    parts = [align.range_fragment(w, i, j, sides) for _, w, i, j in align.ranges(text, 2)]
    assert any(p.prefix[0] or p.suffix[0] for p in parts) and any(p.closed is None for p in parts)
    whole = next(align._whole_texts([text], sides))
    for _ in range(20):
        left = list(parts)
        while len(left) > 1:
            i = r.randrange(len(left) - 1)
            left[i : i + 2] = [align.compose(left[i], left[i + 1], sides.width)]
        assert align._closing(left[0], sides.width) == whole
    assert align.compose(align.EMPTY, parts[0], sides.width) == parts[0] == align.compose(parts[0], align.EMPTY, sides.width)


def test_a_run_without_spaces_is_cut_once():
    text = "start " + "x" * 100_000 + " end " + "y" * 10
    windows = list(align.ranges(text, 1000))
    assert sum(len(w) for _, w, _, _ in windows) <= 2 * len(text)
    assert [n for n, *_ in windows] == list(range(len(windows)))


def test_pieces_across_spaces_are_refused():
    with pytest.raises(ValueError):
        align.check_pieces(["▁a", "a▁b"])


def test_alignment_on_odd_and_empty_tables(odd, nothing):
    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    rows = align.aligned_tokens(odd, *paths, keep_groups=True).collect()
    assert len(rows) == 13
    empty = {r["doc_id"] for r in rows if r["n_a"] == 0}
    assert empty == {1, 2} and all(r["groups_sha256"] == "" for r in rows if r["doc_id"] in empty)
    assert all(r["groups"].count(";") + 1 == r["n_groups"] == r["n_links"] for r in rows if r["n_a"])
    assert align.aligned_tokens(nothing, *paths).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(1)
    x, y = np.floor(r.normal(3, 90, (60, 37))), np.floor(r.normal(-9, 30, (50, 37)))
    exact, spread = x @ y.T, []
    for width in negatives.LEVELS:
        low, high = negatives.bounds(negatives.summaries(x, width), negatives.summaries(y, width))
        assert (low <= exact).all() and (exact <= high).all()
        spread.append((high - low).mean())
    assert spread == sorted(spread, reverse=True)


def test_large_components_are_exact():
    x = np.array([[2.0**30, 3.0], [1.0, -(2.0**30)]])
    assert negatives.scores(x, x).tolist() == [[2**60 + 9, 2**30 - 3 * 2**30], [2**30 - 3 * 2**30, 2**60 + 1]]


def test_hard_negatives_edges(spark, monkeypatch):
    """Ties, repeated rows and ids, nulls, components that aren't finite, lengths that differ; small blocks."""
    monkeypatch.setattr(negatives, "ROW_BLOCK", 7)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 3)
    r = random.Random(2)
    rows = [(i, [r.randrange(-3, 9) / 4 for _ in range(r.choice([3, 5, 5, 5]))], i % 3) for i in range(120)]
    rows += [(7, [0.5, 1.0, 1.0, 1.0, 1.0], 1), (8, None, 1), (9, [None, 1.0], 1), (None, [1.0], 1), (10, [float("nan")], 1)]
    rows += [(11, [float("inf"), 0.0], 2), (12, [], 2), (13, [1.0, 1.0], None), (7, [0.5, 1.0, 1.0, 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as id", "0 as line", "1 as anchor")
    found = negatives.hard_negatives(df, F.col("vec_id") % 7 == 0, scale=4)
    good = [x for x in rows if None not in x and all(v is not None and np.isfinite(v) for v in x[1])]
    whole = [(i, [int(np.floor(4 * v)) for v in x] + [0] * (5 - len(x)), label) for i, x, label in good]
    want = []
    for q, (anchor, x, label) in enumerate(whole):
        if anchor % 7:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i, other) for k, (i, y, other) in enumerate(whole) if k != q)
        for s, positive, _ in [z for z in scored if z[2] == label][:5]:
            fits = [z for z in scored if z[2] != label and 50 * -s <= 100 * -z[0] <= 95 * -s][:3]
            want += [(anchor, positive, n + 1, z[1], -s, -z[0]) for n, z in enumerate(fits)]
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(want)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 7 == 0).count() == 0
    assert negatives.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


def test_products():
    a = pa.array([[1, 2, 3], [1, 2, 3], [], [9, 4]], pa.list_(pa.int64()))
    b = pa.array([[3, 7, 1], [5], [5], [4, 9]], pa.list_(pa.int64()))
    got = [(n, m, x.tolist(), y.tolist()) for n, m, x, y in overlap.product(a, b, pa.array([1, 1, 2, 3]))]
    assert got == [(3, 3, [7], [2]), (3, 1, [5], [1, 2, 3]), (0, 1, [5], []), (2, 2, [], [])]


def test_rows_of_a_group_without_links_follow_its_size(spark, monkeypatch):
    """Members of one family that mostly aren't linked with each other make no more rows than their buckets have."""
    written = []
    plain = overlap.stage

    def counting(df):
        out = plain(df)
        written.append(out.count())
        return out

    r = random.Random(5)
    core = [f"w{r.randrange(9000)}" for _ in range(200)]
    texts = []
    for _ in range(500):
        w = list(core)
        for _ in range(r.randrange(4, 14)):
            w[r.randrange(200)] = f"v{r.randrange(99999)}"
        texts.append(" ".join(w))
    monkeypatch.setattr(overlap, "stage", counting)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = minhash.near_duplicates(df, similarity=0.85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == linked(texts, 5, 850)
    assert max(written) <= 2 * 36 * len(texts)


@pytest.mark.parametrize("block, nearest", [(1024, 1), (40, 4)])
def test_blocks_and_nearest_members(spark, monkeypatch, block, nearest):
    """Lines of many blocks, and members multiplied with few of those near them at a time, give all links."""
    for name, value in (("FEW", 3), ("BLOCK", block), ("NEAREST", nearest)):
        monkeypatch.setattr(overlap, name, value)
    texts = family(11)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = jaccard.ngram_join(df, width=2, similarity=0.7)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == linked(texts, 2, 700)
