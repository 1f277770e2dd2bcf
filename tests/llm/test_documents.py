"""Operators over documents against brute force and edge cases."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import bpe, decontaminate, langid, lm, minhash, quality, token_counts, toxicity
from tabulon.llm.queries import QUERIES
from tabulon.llm.text import held_out

P = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def near(texts, permille=850):
    """{id: (set size, least id reachable)} over all pairs."""
    sets = {}
    for k, text in texts.items():
        w = spaced(text)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in texts}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 1000 * len(x & y) >= permille * len(x | y):
                u, v = up(a), up(b)
                root[max(u, v)] = min(u, v)
    return {k: (len(sets[k]), up(k)) for k in texts}


def as_dict(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_near_duplicates(spark):
    """A family around one text, with edits of growing size, chains, copies, and a passage that many share."""
    r = random.Random(3)
    word = lambda: f"w{r.randrange(9000)}"
    core, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    texts = {}
    for i in range(150):
        w = list(core)
        for _ in range(r.randrange(9)):
            w[r.randrange(len(w))] = word()
        texts[i] = " ".join(w[: 150 - r.randrange(4)])
    for i in range(150, 250):
        texts[i] = " ".join([*passage, *[word() for _ in range(r.randrange(8, 40))]])
    for i in range(250, 280):
        texts[i] = texts[r.randrange(250)].upper()
    chain = [word() for _ in range(200)]
    for i in range(280, 300):
        texts[i] = " ".join(chain)
        chain = [*chain[3:], word(), word(), word()]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = as_dict(minhash.near_duplicates(df), "n_shingles", "component_id", "kept")
    assert found == {k: (n, c, c == k) for k, (n, c) in near(texts).items()}


@pytest.mark.parametrize("similarity", [0.85, 0.8, 0.9, 1.0])
def test_near_duplicates_of_short_texts(spark, similarity):
    """Texts of 3 to 16 words, each with one word added at the front or the end."""
    r = random.Random(11)
    texts = {}
    for i in range(0, 420, 3):
        w = [f"s{r.randrange(10**6)}" for _ in range(3 + i // 3 % 14)]
        texts |= {i: " ".join(w), i + 1: " ".join([*w, "tail"]), i + 2: " ".join(["front", *w])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = as_dict(minhash.near_duplicates(df, similarity=similarity), "n_shingles", "component_id")
    assert found == near(texts, round(1000 * similarity))


def test_near_duplicates_edges(odd, nothing):
    rows = [tuple(r) for r in minhash.near_duplicates(odd).collect()]
    assert len(rows) == 13
    kept = {r[0]: r for r in rows}
    assert kept[1] == (1, 0, 1, True) and kept[2] == (2, 0, 2, True) and kept[3][1] == 0
    assert kept[6] == (6, 57, 5, False) and sum(r[0] == 5 for r in rows) == 2
    assert kept[11][2] == 10 and kept[10][1] == 1
    assert minhash.near_duplicates(nothing).count() == 0


def test_contamination(spark, odd, nothing, docs):
    items = spark.createDataFrame(
        [(1, "alpha beta"), (2, "word3 Word4, word5 word6 word7 word8 word9 word10 word11 word12 word13"), (3, None),
         (4, "solo"), (5, "beta alpha beta gamma"), (2, "alpha beta"), (None, "a b"), (6, "--")],
        "item_id long, text string",
    )
    texts = [
        (100, "x alpha, BETA y solo"), (101, "beta alpha beta gamma alpha beta"), (102, None),
        (103, " ".join(f"word{i}" for i in range(60))), (104, "alpha x beta"), (105, "solo"),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = as_dict(decontaminate.contamination(df, items), "n_words", "n_hit", "items")
    assert found == {
        100: (5, 3, ["1", "2", "4"]), 101: (6, 6, ["1", "2", "5"]), 102: (0, 0, []), 103: (60, 11, ["2"]), 104: (3, 0, []),
        105: (1, 1, ["4"]),
    }
    cut = as_dict(decontaminate.decontaminate(df, items, max_coverage=0.7), "text")
    assert cut[100] == ("x , y ",) or cut[100] == ("x  y ",)
    assert 101 not in cut and 105 not in cut and cut[102] == (None,)
    assert decontaminate.contamination(odd, items).count() == 13
    assert decontaminate.contamination(nothing, items).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(docs, items.limit(0)).collect()} == {0}
    kept = decontaminate.decontaminate(odd, items)
    assert kept.columns == odd.columns


def test_contamination_query_against_brute_force(spark, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = word.findall(low(r["text"]))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(r["item_id"]))
    expected = {}
    for r in docs.collect():
        w, hit, items = word.findall(low(r["text"])), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    items |= windows[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        expected[r["doc_id"]] = (len(w), len(hit), len(items), digest, bool(hit))
    found = QUERIES["op2_decontaminate"](spark, FOLDER)
    assert as_dict(found, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected


def test_parts_of_the_benchmark_give_the_same(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    whole = as_dict(decontaminate.contamination(docs, items), "n_hit", "items")
    monkeypatch.setattr(decontaminate, "PART_WORDS", 300)
    assert as_dict(decontaminate.contamination(docs, items), "n_hit", "items") == whole


def test_lm(spark, docs, odd, nothing):
    texts = {r["doc_id"]: [*spaced(r["text"]), None] for r in docs.collect()}
    out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    count = collections.Counter(w for k, t in texts.items() if not out[k] for w in t)
    n, v = sum(count.values()), len(count)
    rows = QUERIES["op3_lm_score"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            out[r["doc_id"]], len(t), sum(count[w] > 0 for w in t), n,
        )
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm.score(odd, held_out("doc_id", 7, 2)).count() == 13
    assert lm.score(nothing, held_out("doc_id", 7, 2)).count() == 0


def test_lm_chances_add_up(spark):
    """After any two words, the chances of all words, the end and the unseen word are 1."""
    texts = ["a b c a b c a b d"] * 30 + ["b c d a c"] * 20 + ["a d"] * 10
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = lm.train(df)
    model.pop("vocabulary")
    assert model["kept"].any() and model["kept2"].any()
    table, root = model["table"], 10 ** model["log_root"]
    unseen = 1 / (model["total"] + model["kinds"] + 1)
    for a in range(len(table)):
        for b in range(len(table)):
            total = 0.0
            for w in [*range(len(table)), -1]:
                gain = lm.gains(np.array([a, b, w]), np.array([0, 3]), model)[-1]
                total += 10**gain * (root[w] if w >= 0 else unseen)
            assert total == pytest.approx(1, abs=1e-9)


def lm_scores(texts, train):
    """score of each text, by the whole tree in dictionaries."""
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for t in train:
        one.update(t)
        two.update(zip(t, t[1:]))
        three.update(zip(t, t[1:], t[2:]))
    size = sum(one.values()) + len(one) + 1
    chances, rest, kept = [], [], []
    for counts, below, n_of in (
        (two, lambda g: (one[g[1]] + 1) / size, lambda c: one[c[0]]),
        (three, lambda g: chances[0][g[1:]], lambda c: two[c]),
    ):
        followers = collections.defaultdict(list)
        for g, n in counts.items():
            if n >= 2:
                followers[g[:-1]].append((g, (n - 0.5) / n_of(g[:-1]), below(g)))
        chances.append({g: p for f in followers.values() for g, p, _ in f})
        share = {c: (max(1 - sum(p for _, p, _ in f), 1e-12), max(1 - sum(q for *_, q in f), 1e-12)) for c, f in followers.items()}
        rest.append({c: a / b for c, (a, b) in share.items()})
        gain = {c: sum(p * math.log(p / q) for _, p, q in f) + share[c][0] * math.log(rest[-1][c]) for c, f in followers.items()}
        kept.append({c for c, f in followers.items() if n_of(c) * gain[c] >= (len(f) + 1) / 2 * math.log(max(n_of(c), 2))})
    kept[0] |= {c[1:] for c in kept[1]}

    def chance(t, i, length):
        if not length:
            return (one[t[i]] + 1) / size
        context = tuple(t[i - length : i])
        if i < length or context not in kept[length - 1]:
            return chance(t, i, length - 1)
        given = chances[length - 1].get((*context, t[i]))
        return given if given is not None else rest[length - 1][context] * chance(t, i, length - 1)

    return {k: sum(math.log10(chance(t, i, 2)) for i in range(len(t))) for k, t in texts.items()}


@pytest.mark.parametrize("share", [None, 0.004, 1.0])
def test_lm_tree_is_whole(spark, docs, monkeypatch, share):
    """Contexts seen twice count in a corpus of any size: the share of all tokens only says what is broadcast."""
    if share:
        monkeypatch.setattr(lm, "SHARE", share)
        monkeypatch.setattr(lm, "WORD_SHARE", share)
    texts = {r["doc_id"]: [*spaced(r["text"]), None] for r in docs.collect()}
    out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    expected = lm_scores(texts, [t for k, t in texts.items() if not out[k]])
    found = as_dict(QUERIES["op3_lm_score"](spark, FOLDER), "score")
    assert {k: s for k, (s,) in found.items()} == pytest.approx(expected, rel=1e-9)


def test_lm_tables_are_packed(spark, docs, monkeypatch):
    """What is left of the grams comes as one row for each part, not as one for each gram."""
    monkeypatch.setattr(lm, "SHARE", 1.0)
    monkeypatch.setattr(lm, "WORD_SHARE", 1.0)
    model = lm.train(docs.select("text"))
    tail = model["tail"].where("part >= 0")
    rows = tail.selectExpr("part", "octet_length(key) as key", "octet_length(base) as base", "octet_length(gain) as gain").collect()
    assert len({r["part"] for r in rows}) == len(rows) <= 1 << model["parts"]
    assert sum(r["key"] for r in rows) // 8 > 100 * len(rows) > 0
    assert all(r["key"] == r["base"] == r["gain"] for r in rows)


@pytest.mark.parametrize("low, high", [(0, 1 << 64), (1 << 62, (1 << 62) + 5000), ((1 << 64) - 9, 1 << 64), (0, 1)])
@pytest.mark.parametrize("size", [0, 1, 3000])
def test_lm_places(low, high, size):
    """Any table of hashes, also one whose values share their leading bits."""
    rng = np.random.default_rng(size)
    table = np.unique(rng.integers(low, high, size, dtype=np.uint64))
    ends = np.array([0, 1 << 62, (1 << 64) - 1], dtype=np.uint64)
    values = np.concatenate([rng.integers(0, 1 << 64, 500, dtype=np.uint64), rng.integers(low, high, 5000, dtype=np.uint64), table, ends])
    known = {v: i for i, v in enumerate(table.tolist())}
    expected = [known.get(v, -1) for v in values.tolist()]
    assert lm.Places(table).find(values).tolist() == lm.find(values, table).tolist() == expected
    crowd = np.append(np.arange(size, dtype=np.uint64), np.uint64((1 << 64) - 1))
    assert lm.find(crowd, crowd).tolist() == list(range(size + 1))


@pytest.mark.parametrize("spread", [1, 64, 1 << 40])
def test_lm_order(spread):
    """Hashes that differ in their last bits only are in order too."""
    rng = np.random.default_rng(spread)
    base = rng.integers(0, (1 << 64) - (1 << 41), 2000, dtype=np.uint64)
    for values in (base[:0], base[:1], np.concatenate([base, base[:50] + np.uint64(spread), base[:9], base[:50] + np.uint64(spread // 2)])):
        order = lm._order(values)
        assert np.array_equal(np.sort(order), np.arange(len(values)))
        assert np.array_equal(values[order], np.sort(values))


def test_lm_rounds(spark, odd, monkeypatch):
    """Texts scored in several rounds get the same rows, repeated and null ones too."""
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    rows = lambda: sorted(map(tuple, lm.score(odd, held_out("doc_id", 7, 2)).select(*columns).collect()), key=str)
    whole = rows()
    monkeypatch.setattr(lm, "ROUND_TOKENS", 100)
    parted = rows()
    assert len(parted) == len(whole) == 13
    for a, b in zip(parted, whole, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.fixture(scope="module")
def raw():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def library(raw):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_against_the_library(raw, library):
    r = random.Random(1)
    kinds = ["ab", "abcdefghij etaoin", "éüñ漢字🙂", "  \n\t\x0b\x1c\x1d", "'s'll'RE", "0123456789", "!!--==##", "aeiou"]
    for _ in range(3000):
        text = "".join(r.choice(r.choice(kinds)) for _ in range(r.randint(0, 30)))
        ids = bpe.encode_text(text, raw, P.PATTERN)
        assert ids == library.encode_ordinary(text)
        assert bpe.decode_ids(ids, raw, P.PATTERN) == text.encode()


def test_bpe_append_and_edit(raw):
    v, r = bpe.Vocabulary(raw), random.Random(2)
    for _ in range(200):
        data = bytes(r.choice(b"abc therin-") for _ in range(r.randint(0, 300)))
        cut = r.randint(0, len(data))
        assert bpe.PrefixEncoder(v, data[:cut]).append(data[cut:]).ids() == v.merged(data)
        start = r.randint(0, len(data))
        stop = r.randint(start, len(data))
        edited = bpe.PrefixEncoder(v, data).replace(start, stop, b"the")
        assert edited.ids() == v.merged(data[:start] + b"the" + data[stop:])


def test_bpe_table(odd, nothing, library):
    path = P.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(odd, path, P.PATTERN)
    texts = collections.defaultdict(list)
    for r in odd.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    rows = bpe.decode(encoded, path, P.PATTERN).collect()
    assert len(rows) == 13
    for r in rows:
        text = texts[r["doc_id"]][0]
        assert r["ids"] == library.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(nothing, path, P.PATTERN).count() == 0


def test_token_counts(docs, odd, nothing):
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    special = odd.withColumn("text", F.concat("text", F.lit("a<|endoftext|> é \u0301x")))
    for df in (docs, odd, special):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        found = as_dict(token_counts.token_counts(df, path), "n_bytes", "n_tokens", "over_limit")
        for k, text in texts.items():
            n = len(library.encode(text, add_special_tokens=False).ids)
            assert found[k] == (len(text.encode()), n, n > 2048)
    assert token_counts.token_counts(nothing, path).count() == 0


def quality_row(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def test_quality(docs, odd, nothing):
    for df in (docs, odd):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        found = quality.assess(df).collect()
        assert len(found) == df.count()
        for r in found:
            q = r["quality"]
            assert tuple(q)[:6] == quality_row(texts[r["doc_id"]])
            assert not (q["kept"] and q["base_failed"])
    assert quality.assess(nothing).count() == 0


def test_quality_lines(spark):
    good = " ".join(f"Word{i} follows{i}." for i in range(40))
    lines = [good, "a | b | c | d", "THIS!! IS!! LOUD!!", "x### y$$$ z%%%", "===== ----", "All rights reserved.", "", "Fine line."]
    text = "\n".join(lines)
    q = quality.assess(spark.createDataFrame([(text,), ("\n".join([f"a{i} | b{i} | c{i}" for i in range(40)]),)], "text string")).collect()
    assert q[0]["quality"]["clean_text"] == "\n".join([good, "", "Fine line."]) and q[0]["quality"]["kept"]
    assert q[0]["quality"]["n_lines_removed"] == 5
    assert not q[1]["quality"]["kept"] and not q[1]["quality"]["base_failed"]


def test_languages(spark, docs, odd, nothing):
    rows = QUERIES["op7_language_id"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    model = langid.train(docs)
    by = {r["lang"]: r["text"] for r in docs.where("length(text) > 2000").collect()}
    mixed = spark.createDataFrame([(by["en"][:1500] + " " + by["fr"][:800],)], "text string")
    assert set(langid.predict(mixed, model).first()["lang_set"]) >= {"en", "fr"}
    found = as_dict(langid.predict(odd, model), "lang_pred", "score", "lang_set")
    for k in (1, 2, 3, 7, 8):
        assert found[k] == ("und", 0.0, [])
    assert found[9][0] != "und"
    assert langid.predict(nothing, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.train(nothing)).collect()} == {"und"}


def test_toxicity_risk_by_plain_loops():
    r = random.Random(3)
    texts = [sorted({r.randrange(6) for _ in range(3)}) for _ in range(40)]
    positive, drawn = [i % 5 == 0 for i in range(40)], [i % 5 > 0 or i % 2 == 0 for i in range(40)]

    def plain(prior, steps, decay):
        w, m, v = [0.0] * 6 + [math.log(prior / (1 - prior))], [0.0] * 7, [0.0] * 7
        for t in range(1, steps + 1):
            z = [sum(w[x] for x in text) + w[6] for text in texts]
            p = [1 / (1 + math.exp(-x)) for x in z]
            cost = [math.log1p(math.exp(x)) for x in z]
            risk = sum(c for c, d in zip(cost, drawn) if d) / sum(drawn)
            risk -= prior * sum(c for c, d in zip(cost, positive) if d) / sum(positive)
            g = [decay * x for x in w[:6]] + [0.0]
            for i, text in enumerate(texts):
                slope = (1 if risk >= 0 else -1) * p[i] / sum(drawn) * drawn[i]
                slope += prior * (-1 if risk >= 0 else p[i]) / sum(positive) * positive[i]
                for x in [*text, 6]:
                    g[x] += slope
            for j in range(7):
                m[j], v[j] = 0.9 * m[j] + 0.1 * g[j], 0.999 * v[j] + 0.001 * g[j] ** 2
                w[j] -= 0.1 * (1 - (t - 1) / steps) * (m[j] / (1 - 0.9**t)) / (math.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        return w

    rows, at = np.repeat(np.arange(40), [len(x) for x in texts]), np.array([x for text in texts for x in text])
    for prior in (0.2, 0.6):  # the higher one makes the negative part negative
        weights, bias = toxicity.fit_risk(rows, at, np.array(positive), np.array(drawn), 6, prior, 50, 1e-3)
        assert [*weights, bias] == pytest.approx(plain(prior, 50, 1e-3), abs=1e-9)


def test_toxicity(spark, odd, nothing):
    r = random.Random(5)
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi") for b in ("ra", "sto", "ten", "vul", "zim", "qui")]
    rows = []
    for i in range(3000):
        toxic = i % 10 == 0
        text = [r.choice(words) for _ in range(r.randint(5, 200))]
        if toxic:
            text[r.randrange(len(text))] = r.choice(["scumbag", "scumlike", "vileness"])
        rows.append((i, " ".join(text), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learnt = df.where("doc_id % 3 > 0")
    model = toxicity.train(learnt.select("doc_id", "text"), learnt.where("doc_id % 2 = 0").select("doc_id", "toxic"), prior=0.1)
    found = as_dict(toxicity.score(df.select("doc_id", "text"), model), "score")
    held = [(found[i][0] >= 0.5, bool(t)) for i, _, t in rows if i % 3 == 0]
    assert np.mean([a == b for a, b in held]) > 0.98
    assert toxicity.score(odd, model).count() == 13 and toxicity.score(nothing, model).count() == 0
    empty = toxicity.train(nothing, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= s[0] <= 1 for s in as_dict(toxicity.score(odd, empty), "score").values())
