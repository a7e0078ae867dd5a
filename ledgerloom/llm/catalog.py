"""Queries of the numbered operators over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (decontaminate, factors, hard_negatives, language_id, language_model, packing, paragraphs,
                            phrases, quality, simhash, token_counts, url_filters, vectors)
from ledgerloom.storage import Workspace, checkpoint_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("doc_id", "stmt_id")


def as_documents(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("stmt_id", "doc_id")


URL_RULES = """
    select * from values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                         ('net', '/es/', 'block'), ('net', '/fr/', 'block') as rules(host, path, verdict)"""


@query
def op1_url_filters(spark, sf_dir):
    return url_filters.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.sql(URL_RULES))


SQL["op1_url_filters"] = """
    with parts as (
        select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
        from pages),
    split as (
        select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz') as host,
               regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
        from parts),
    judged as (
        select *, case
            when (host = 'www.example.com' or host like '%.www.example.com') and path like '/en/%'
                then 'www.example.com/en/'
            when (host = 'example.com' or host like '%.example.com') and path like '/en/%' then 'example.com/en/'
            when (host = 'net' or host like '%.net') and path like '/es/%' then 'net/es/'
            when (host = 'net' or host like '%.net') and path like '/fr/%' then 'net/fr/'
            when (host = 'com' or host like '%.com') and path like '/%' then 'com/' end as rule
        from split)
    select page_id, host, path, rule,
           case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict
    from judged"""


@query
def op2_quality(spark, sf_dir):
    return as_documents(quality.score_quality(documents(spark, sf_dir)))


@query
def op3_simhash(spark, sf_dir):
    return as_documents(simhash.near_duplicate_statements(documents(spark, sf_dir)))


@query
def op4_language_id(spark, sf_dir):
    return as_documents(language_id.identify_languages(documents(spark, sf_dir)))


@query
def op5_token_counts(spark, sf_dir):
    # one cache for all runs of a cluster: contents counted before are only looked up
    return as_documents(token_counts.count_tokens(
        documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), f"{checkpoint_root(spark)}/token-cache"))


@query
def op6_decontamination(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return as_documents(decontaminate.contaminated_statements(documents(spark, sf_dir), items))


@query
def op7_substring_dedup(spark, sf_dir):
    lines = documents(spark, sf_dir).select("stmt_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    space = Workspace(spark, "op7")
    found = space.cut(paragraphs.duplicate_lines(lines, short=True), "lines")
    passages = paragraphs.repeated_passages(lines, removed=found.where("removed").select("stmt_id", "line_no"))
    space.close(found)
    both = found.unionByName(passages.withColumn("removed", F.lit(True)), allowMissingColumns=True)
    return both.select(F.col("stmt_id").alias("doc_id"), F.col("line_no").alias("paragraph"),
                       F.col("class_stmt_id").alias("class_doc_id"), F.col("class_line_no").alias("class_paragraph"),
                       "removed", "first_word", "n_words", "class_first_word")


@query
def op8_packing(spark, sf_dir):
    return as_documents(packing.pack_statements(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
        ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken")))


@query
def op9_suffix_dedup(spark, sf_dir):
    return as_documents(factors.remove_repeated_passages(documents(spark, sf_dir)).drop("kept"))


SQL["op9_suffix_dedup"] = """
    with texts as (select doc_id, coalesce(hex(encode(text)), '') as digits from documents),
    blocks as (select doc_id, length(digits) // 2 as n_bytes, unnest(range(0, length(digits) // 2, 512)) as begin, digits from texts),
    pieces as (select doc_id, n_bytes, begin, substr(digits, 2 * begin + 1, 1124) as digits from blocks),
    places as (
        select *, begin + inside as place
        from (select *, unnest(range(1, 513)) as inside from pieces) where begin + inside <= n_bytes),
    bytes as (
        select doc_id, place, substr(digits, 2 * inside - 1, 2) as byte,
               case when place + 49 <= n_bytes then substr(digits, 2 * inside - 1, 100) end as span
        from places),
    first as (select span, min(doc_id) as low from bytes where span is not null group by span),
    covered as (
        select doc_id, place, byte, coalesce(max(case when low < doc_id then 1 end) over (
            partition by doc_id order by place rows between 49 preceding and current row), 0) as gone
        from bytes left join first using (span)),
    edges as (
        select *, gone = 1 and coalesce(lag(gone) over (partition by doc_id order by place), 0) = 0 as opens from covered),
    judged as (
        select doc_id, sum(gone) as n_removed, count(*) filter (opens) as n_spans,
               string_agg(byte, '' order by place) filter (gone = 0) as kept
        from edges group by doc_id)
    select doc_id, cast(length(digits) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
           cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
    from texts left join judged using (doc_id)"""


@query
def op10_embedding_dedup(spark, sf_dir):
    return vectors.near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL["op10_embedding_dedup"] = """
    with recursive good as (
        select vec_id, cast(embedding as double[]) as x from embeddings
        where embedding is not null and len([v for v in embedding if v is null or not isfinite(v)]) = 0
          and len([v for v in embedding if v <> 0]) > 0),
    links as (
        select a.vec_id, b.vec_id as other
        from good a join good b on a.vec_id <> b.vec_id and len(a.x) = len(b.x)
        where list_cosine_similarity(a.x, b.x) >= 0.95),
    reached as (
        select vec_id, vec_id as other from embeddings
        union
        select r.vec_id, l.other from reached r join links l on r.other = l.vec_id),
    counted as (select vec_id, count(*) as n_links from links group by vec_id),
    components as (select vec_id, min(other) as component_id from reached group by vec_id)
    select vec_id, cast(coalesce(n_links, 0) as bigint) as n_links, component_id, vec_id = component_id as kept
    from components left join counted using (vec_id)"""


@query
def op11_lm_scoring(spark, sf_dir):
    return as_documents(language_model.score_statements(documents(spark, sf_dir)))


@query
def op12_phrase_mining(spark, sf_dir):
    return phrases.mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"), text="text", per="lang")


SQL["op12_phrase_mining"] = r"""
    with pieces as (
        select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\x0A-\x0D]')) as piece
        from documents),
    worded as (select lang, [w for w in regexp_split_to_array(piece, '[\x20\x09]+') if w <> ''] as words from pieces),
    totals as (select lang, sum(len(words)) as n from worded group by lang),
    placed as (select lang, words, unnest(range(1, len(words) + 1)) as place from worded),
    phrases as (
        select lang, k, array_to_string(words[place:place + k - 1], ' ') as phrase, count(*) as f
        from placed cross join (select unnest([1, 2, 3, 4]) as k)
        where place + k - 1 <= len(words) group by all),
    candidates as (
        select lang, k, phrase, f as a, string_split(phrase, ' ') as words from phrases where k >= 2 and f >= 30),
    halves as (
        select lang, phrase, k, a, c, array_to_string(words[1:c], ' ') as head, array_to_string(words[c + 1:k], ' ') as tail
        from (select *, unnest(range(1, k)) as c from candidates)),
    cuts as (
        select h.lang, h.phrase, h.a, h.c, l.f as l, r.f as r,
               (2000000 * cast(h.a as hugeint)) // (cast(l.f as hugeint) + r.f) as score
        from halves h join phrases l on l.lang = h.lang and l.phrase = h.head
                      join phrases r on r.lang = h.lang and r.phrase = h.tail
        qualify row_number() over (partition by h.lang, h.phrase order by score, h.c) = 1),
    inner_phrases as (
        select lang, array_to_string(words[s:s + m - 1], ' ') as phrase, max(a) as longer
        from (select *, unnest(range(1, k - m + 2)) as s
              from (select *, unnest(range(2, k)) as m from candidates))
        group by all)
    select c.lang, row_number() over (partition by c.lang order by c.score desc, c.a desc, c.phrase) as rank, c.phrase,
           c.a, c.l, c.r, cast(t.n as bigint) as n, cast(c.score as bigint) as score
    from cuts c join totals t using (lang) left join inner_phrases i on i.lang = c.lang and i.phrase = c.phrase
    where i.longer is null or 100 * cast(i.longer as hugeint) < 80 * cast(c.a as hugeint)
    qualify row_number() over (partition by c.lang order by c.score desc, c.a desc, c.phrase) <= 2000"""


@query
def op13_hard_negatives(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(rows.withColumn("label", moved))


SQL["op13_hard_negatives"] = """
    with vectors as (
        select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
               [cast(floor(256 * cast(x as double)) as double) for x in embedding] as codes
        from embeddings
        where label is not null and embedding is not null and len(embedding) > 0
          and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
    scored as (
        select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
               cast(list_inner_product(a.codes, b.codes) as bigint) as score
        from vectors a join vectors b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.codes) = len(b.codes)),
    positives as (
        select anchor_id, other_id as positive_id, score as positive_score from scored where same
        qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
    select anchor_id, positive_id, positive_score, s.other_id as negative_id, s.score as negative_score,
           cast(row_number() over (partition by anchor_id, positive_id order by s.score desc, s.other_id) as integer) as rank
    from positives join scored s using (anchor_id)
    where not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
    qualify row_number() over (partition by anchor_id, positive_id order by s.score desc, s.other_id) <= 10"""
