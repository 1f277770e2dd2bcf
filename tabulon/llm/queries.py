"""The operators over their whole tables: one query per operator, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_minhash(spark, folder):
    from tabulon.llm.minhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), similarity=0.85)


def groups_sql(width: int, percent: int, extra: str = "") -> str:
    """Links of word shingles and the least doc_id reachable over them."""
    return f"""
with recursive words as (
    select row_number() over () as line, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
    from documents
),
sets as (
    select line, doc_id, case
        when w is null or len(w) = 0 then []
        when len(w) < {width} then [hash(w)]
        else list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: hash(list_slice(w, i, i + {width - 1}))))
    end as s from words
),
grams as (select line, len(s) as n, unnest(s) as g from sets),
links as (
    select a.line as a, b.line as b
    from grams a join grams b on a.g = b.g and a.line < b.line
    group by a.line, b.line, a.n, b.n
    having 100 * count(*) >= {percent} * (a.n + b.n - count(*))
),
ways as (select a as x, b as y from links union all select b, a from links),
reach(x, y) as (select distinct x, x from ways union select r.x, w.y from reach r join ways w on r.y = w.x),
groups as (select r.x as line, min(d.doc_id) as low from reach r join sets d on d.line = r.y group by r.x)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(g.low, s.doc_id) as component_id{extra}
from sets s left join groups g using (line)
"""


SQL["op1_minhash"] = groups_sql(5, 85, ", s.doc_id = coalesce(g.low, s.doc_id) as kept")


@query
def op11_ngram_join(spark, folder):
    from tabulon.llm.jaccard import ngram_join

    return ngram_join(table(spark, folder, "documents"), width=3, similarity=0.9)


SQL["op11_ngram_join"] = groups_sql(3, 90)


@query
def op2_decontaminate(spark, folder):
    from tabulon.llm.decontaminate import contamination

    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10)
    return found.selectExpr(
        "doc_id", "n_words", "n_hit", "n_items", "sha2(array_join(items, ','), 256) as items_sha256", "n_hit > 0 as contaminated"
    )


@query
def op4_byte_bpe(spark, folder):
    import public_tokenizers

    from tabulon.llm.bpe import encode

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN, keep_ids=False)


@query
def op5_token_counts(spark, folder):
    import public_tokenizers

    from tabulon.llm.token_counts import token_counts

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@query
def op6_quality_rules(spark, folder):
    from tabulon.llm.quality import assess

    return assess(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id",
        *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "quality.base_failed",
        "quality.kept",
    )


@query
def op7_language_id(spark, folder):
    from tabulon.llm import langid
    from tabulon.llm.text import held_out

    docs = table(spark, folder, "documents")
    out = held_out("doc_id", 4, 2)
    model = langid.train(docs.where(~out))
    found = langid.predict(docs.select("doc_id", out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "lang_set")


@query
def op8_toxicity(spark, folder):
    from tabulon.llm import toxicity
    from tabulon.llm.text import held_out

    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    out = held_out("doc_id", 5, 0)
    model = toxicity.train(docs.where(~out), labels.where(~out))
    found = toxicity.score(docs, model)
    return found.select("doc_id", out.alias("held_out"), "score", (found["score"] >= 0.5).cast("int").alias("predicted"))


#: The rules of op9: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op9_url_filter(spark, folder):
    from tabulon.llm.urls import judge

    rows = ", ".join(str(rule) for rule in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {rows} AS rules(host, path, verdict)")
    judged = judge(table(spark, folder, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", *[f"judged.{c}" for c in ("host", "path", "rule", "verdict")])


SQL["op9_url_filter"] = """
with parts as (
    select page_id,
        case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest
    from pages
),
split as (
    select page_id,
        coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
    from parts
),
rules(rule_host, rule_path, verdict) as (
    values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
),
fits as (
    select s.page_id, r.rule_host || r.rule_path as rule, r.verdict,
        row_number() over (
            partition by s.page_id order by length(r.rule_host || r.rule_path) desc, length(r.rule_host) desc
        ) as place
    from split s join rules r
        on (s.host = r.rule_host or s.host like '%.' || r.rule_host) and starts_with(s.path, r.rule_path)
)
select s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from split s left join fits f on f.page_id = s.page_id and f.place = 1
"""


@query
def op10_html_text(spark, folder):
    from tabulon.llm.html import extract, train

    pages = table(spark, folder, "pages")
    return extract(pages.select("page_id", "url", "html"), train(pages))


@query
def op3_lm_score(spark, folder):
    from tabulon.llm.lm import score
    from tabulon.llm.text import held_out

    return score(table(spark, folder, "documents"), held_out("doc_id", 7, 2))


@query
def op13_hard_negatives(spark, folder):
    from pyspark.sql import functions as F

    from tabulon.llm.negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


SQL["op13_hard_negatives"] = """
with rows as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
    select a.vec_id as anchor_id, r.vec_id as id, a.label = r.label as same, list_dot_product(a.v, r.v)::bigint as score
    from rows a join rows r on a.vec_id % 50 = 0 and a.vec_id <> r.vec_id
),
positives as (
    select anchor_id, id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, p.positive_id,
    (row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id))::int as rank,
    s.id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
    and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id) <= 3
"""


@query
def op12_alignment(spark, folder):
    import public_tokenizers

    from tabulon.llm.align import aligned_tokens

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return aligned_tokens(table(spark, folder, "documents"), a, b)
