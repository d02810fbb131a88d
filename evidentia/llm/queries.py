"""The registered queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import ann, fim, html_extract, licenses, pii, ranked_search, secrets
from evidentia.llm.bpe import encode_documents
from evidentia.llm.common import table
from evidentia.llm.license_templates import TEMPLATES
from evidentia.llm.line_dedup import dedup_lines
from evidentia.llm.mixing import mix
from evidentia.llm.near_dup import near_duplicates
from evidentia.llm.part_enum import similar_documents
from evidentia.llm.quality import judged, ledger


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages of three lines, or of one or two long ones, that occurred before."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed_lines")


OP1_SQL = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as ln from documents),
t as (select doc_id, ln, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as s from l),
s as (select doc_id, ln, s, row_number() over (partition by doc_id order by ln) as k from t where s <> ''),
c as (select *, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) as n from s),
w as (select doc_id, k, s, n, lead(s, 1) over o as s1, lead(s, 2) over o as s2, lead(n, 1) over o as n1 from c window o as (partition by doc_id order by k)),
v as (select doc_id, k, 3 as size, s, s1, s2 from w where s2 is not null
      union all select doc_id, k, 1, s, '', '' from w where n > 50
      union all select doc_id, k, 2, s, s1, '' from w where n <= 50 and n1 <= 50 and n + n1 > 50),
f as (select doc_id, k, size, row_number() over (partition by size, s, s1, s2 order by doc_id, k) as nth from v),
gone as (select distinct f.doc_id, s.ln from f join s on s.doc_id = f.doc_id and s.k >= f.k and s.k < f.k + f.size where nth > 1),
kept as (select l.doc_id, string_agg(l.line, chr(10) order by l.ln) as text from l anti join gone on l.doc_id = gone.doc_id and l.ln = gone.ln group by 1),
n as (select doc_id, count(*) as n_lines from s group by 1),
r as (select doc_id, count(*) as n_removed_lines from gone group by 1)
select d.doc_id, case when r.doc_id is null then d.text else coalesce(kept.text, '') end as text,
       coalesce(n_lines, 0) as n_lines, coalesce(n_removed_lines, 0) as n_removed_lines
from documents d left join kept using (doc_id) left join n using (doc_id) left join r using (doc_id)
"""


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mix(table(spark, sf_dir, "documents")).select("doc.doc_id", "size", "source_size", "target", "taken")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return encode_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices that documents hold."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest others of every twentieth vector."""
    return ann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op5_sql() -> str:
    """Exact containment of every notice in every document, without windows or bands."""
    rows = ", ".join("('{}', {}, '{}')".format(a, i, t.replace("'", "''")) for a, texts in TEMPLATES.items() for i, t in enumerate(texts))
    cut = lambda source, key: f"""select {key}, p as at_word, array_to_string(w[p + 1 : p + 5], ' ') as s from (select {key}, w, unnest(range(0, greatest(len(w) - 4, 0))) as p
        from (select {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from {source}))"""  # noqa: E731
    return f"""with n(license, notice, text) as (values {rows}), ns as (select distinct license, notice, s from ({cut("n", "license, notice")})),
    size as (select license, notice, count(*) as n_notice from ns group by all), ds as ({cut("documents", "doc_id")}),
    m as (select doc_id, license, notice, count(distinct s) as n_shared, min(at_word) as at_word from ds join ns using (s) group by all)
    select doc_id, license, notice::int as notice, n_shared, n_notice, n_shared / n_notice as containment, at_word from m join size using (license, notice) where 100 * n_shared >= 80 * n_notice"""


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets are at least 0.8 similar."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, with the terms that disclose it."""
    return pii.scan(table(spark, sf_dir, "documents")).drop("version")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.scan(table(spark, sf_dir, "documents")).drop("version")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of every document and the verdict of the present policy."""
    book = judged(ledger(table(spark, sf_dir, "documents")))
    return book.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")


OP9_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
p as (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from w),
g as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from p),
r as (select doc_id, count(distinct i + j) as n_repeat_words from g cross join (values (0), (1), (2)) as v(j) where n > 1 group by 1),
l as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
q as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
m as (select w.doc_id, len(w)::bigint as n_words, coalesce(length(list_aggregate(w, 'string_agg', '')), 0)::bigint as word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
      coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0) as n_lines,
      length(regexp_replace(text, '[^\p{L}]+', '', 'g')) as n_letters, length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) as n_capitals
      from w left join r using (doc_id) left join q using (doc_id)),
b as (select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
      + case when 10 * n_symbols > 2 * n_words then 4 else 0 end + case when n_letters > 0 and 2 * n_capitals > n_letters then 8 else 0 end
      + case when n_words > 0 and (word_chars < 2 * n_words or word_chars > 25 * n_words) then 16 else 0 end
      + case when n_lines >= 4 and 10 * n_dup_lines > 6 * n_lines then 32 else 0 end)::bigint as failed_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 as base_failed, failed_bits = 0 as kept, failed_bits from b
"""


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle lines moved to its end, as digests, and the text rebuilt from that."""
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP11_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
l as (select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as u,
      [list_sum([(strpos('0123456789abcdef', h[8 * g + i]) - 1) * (1 << (4 * (8 - i))) for i in range(1, 9)])::bigint for g in range(0, 4)] as r from d),
c as (select *, len(u) as n, least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) as a, greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) as b from l),
p as (select doc_id, n, text, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or r[3] % 100 >= 100 then 'plain'
      when r[4] % 100 < 50 then 'spm' else 'psm' end as form, array_to_string(u[1 : a], '') as x, array_to_string(u[a + 1 : b], '') as y, array_to_string(u[b + 1 : n], '') as z from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(x) end as prefix_chars, case when form <> 'plain' then length(y) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y else '<S>' || z || '<P>' || x || '<M>' || y end) as output_sha256,
       sha256(text) as restored_sha256 from p
"""


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets are at least 0.9 similar."""
    return similar_documents(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


OP12_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[p : p + 2], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as p from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
c as (select sha256(string_agg(s, chr(10) order by s)) as c, doc_id from s group by doc_id),
f as (select c, min(doc_id) as one from c group by c),
u as (select s.doc_id, s.s, n.n from s join n using (doc_id) join f on f.one = s.doc_id),
e as (select a.doc_id as a, b.doc_id as b from u a join u b on a.s = b.s and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
      group by all having 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
g as (select a, b from e union all select b, a from e),
r(id, low) as (select one, one from f union select g.b, r.low from r join g on g.a = r.id),
k as (select id, min(low) as low from r group by id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(k.low, d.doc_id) as component_id
from documents d left join n using (doc_id) left join c using (doc_id) left join f using (c) left join k on k.id = f.one
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


OP13_SQL = r"""
with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
c as (select doc_id, term, count(*) as tf from t group by all),
d as (select doc_id, sum(tf)::bigint as n from c group by 1),
z as (select count(*) as docs, sum(n)::bigint as l from d),
w as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from c cross join z group by term),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
i as (select doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // l)) as imp from c join d using (doc_id) cross join z),
s as (select item_id, doc_id, sum(w * imp)::bigint as score from q join w using (term) join i using (term) group by all having sum(w * imp) > 0)
select item_id, (row_number() over o)::int as rank, doc_id, score from s window o as (partition by item_id order by score desc, doc_id) qualify row_number() over o <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_html_text, op3_mixing, op4_bpe, op5_license_scan, op6_nearest, op7_near_duplicates, op8_pii, op9_quality_rules, op10_secrets, op11_fill_in_middle, op12_ngram_join, op13_ranked_search)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op5_license_scan": op5_sql(), "op9_quality_rules": OP9_SQL, "op11_fill_in_middle": OP11_SQL, "op12_ngram_join": OP12_SQL, "op13_ranked_search": OP13_SQL}
