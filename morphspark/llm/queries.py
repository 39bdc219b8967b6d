"""Queries of the training-text operators, with SQL where DuckDB can express them."""

from __future__ import annotations

from morphspark.llm import ann, decontam, html_text, licenses, neardup, packing, substring, tokencount, toxicity, warc


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisit(spark, sf_dir):
    return warc.archive(_table(spark, sf_dir, "pages"))


def op2_cross_polytope(spark, sf_dir):
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op3_minhash_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    return substring.digests(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_html_text(spark, sf_dir):
    return html_text.extract(_table(spark, sf_dir, "pages"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_warc_revisit, op2_cross_polytope, op3_minhash_near_dedup, op4_substring_dedup, op5_token_counts,
    op6_decontamination, op7_toxicity, op8_packing, op9_license_scan, op10_html_text, pipeline)}

#: Base32 of the 40 hex digits of sha1: each 5 hex digits are 4 letters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast('0x' || substr(h, {5 * k + 1}, 5) as integer) >> {s}) & 31) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))

OP1_SQL = f"""
with rows as (select page_id, regexp_replace(coalesce(url, ''), '[\\r\\n]', '', 'g') as url, sha1(coalesce(html, '')) as h, octet_length(encode(coalesce(html, ''))) as n from pages),
known as (select *, min(page_id) over (partition by h) as first_id from rows)
select page_id, url, cast(n as bigint) as payload_bytes, {_BASE32} as payload_digest,
  case when page_id = first_id or first_id is null then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from known
"""

OP4_SQL = """
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
starts as (select r, unnest(generate_series(1, len(w) - 34)) as i from d where len(w) >= 35),
windows as (select s.r, s.i, md5(array_to_string(d.w[s.i:s.i + 34], ' ')) as h from starts s join d on s.r = d.r),
repeated as (select h from windows group by h having count(*) > 1),
hit as (select r, i from windows where h in (select h from repeated)),
gone as (select distinct r, i + k as i from hit, (select unnest(generate_series(0, 34)) as k)),
words as (select r, unnest(w) as word, unnest(generate_series(1, len(w))) as i from d),
kept as (select r, string_agg(word, ' ' order by i) as text, count(*) as n from words anti join gone using (r, i) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from d left join kept using (r)
"""

#: The rest has no SQL: hashing searches, learnt models, tokenizers, ordered rules and page trees are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {"op1_warc_revisit": OP1_SQL, "op4_substring_dedup": OP4_SQL}
