"""Scalar functions and scans over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidentia.functions import scalars as S
from evidentia.scratch import shared_folder
from evidentia.plans.registry import Registry, table
from evidentia.sources import io

R = Registry()


@R.query("""
select page_id, regexp_replace(upper(regexp_replace(url, '[^A-Za-z]', '', 'g')), 'X', '', 'g') as letters, case when length(url) >= 4 then substr(url, 3, length(url) - 4) end as inner_url,
coalesce(nullif(regexp_extract(url, '^(https?)://(?:www\\.)?([^/]+)', 2), ''), '') as host,
case when regexp_matches(url, '/en/') then 'english' when regexp_matches(url, '/fr/') then 'french' else 'other' end as lang, replace(replace(url, 'https', 'http'), 'www.', '') as plain,
case when not contains(url, 'feed') then url end as no_feed, len(list_distinct(string_split(url, '/')))::int as n_parts from pages
""")
def scalar_strings(spark, sf_dir):
    """Cleaning and classes of urls."""
    p = table(spark, sf_dir, "pages")
    url = F.col("url")
    return p.select(
        "page_id",
        S.clean_sequence(F.regexp_replace(url, "[^A-Za-z]", ""), "no_x").alias("letters"),
        S.strip_termini(url).alias("inner_url"),
        F.regexp_extract(url, r"^(https?)://(?:www\.)?([^/]+)", 2).alias("host"),
        S.first_match(url, [("english", "/en/"), ("french", "/fr/")]).alias("lang"),
        S.rewrite(url, {"https": "http", "www.": ""}).alias("plain"),
        F.when(S.null_if_contained(F.lit("feed"), url).isNotNull(), url).alias("no_feed"),
        F.size(F.array_distinct(F.split(url, "/"))).alias("n_parts"),
    )


@R.query("""
select p_partkey, p_brand || ' ' || p_name as header, coalesce(nullif(regexp_extract(p_name, '^(\\S+)', 1), ''), 'NONE') as first_word, trim(regexp_replace(p_name || ' sp. unknown', '(?i)\\s+(subsp|sp)\\b.*$', '')) as taxon,
case when contains(p_type, 'E') then replace(p_type, 'E', '3') when contains(p_type, 'A') then replace(p_type, 'A', '4') else p_type end as coded, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), [p_brand]))), ';') as words from part
""")
def header_strings(spark, sf_dir):
    """Headers made of part names."""
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat_ws(" ", "p_brand", "p_name").alias("header"),
        S.id_from_header(F.concat("p_name", F.lit("."))).alias("_w"),
        S.clean_taxon(F.concat("p_name", F.lit(" sp. unknown"))).alias("taxon"),
        S.first_substitution(F.col("p_type"), [("E", "3"), ("A", "4")]).alias("coded"),
        F.array_join(S.list_union(F.split("p_name", " "), F.array("p_brand")), ";").alias("words"),
    ).select("p_partkey", "header", F.regexp_replace("_w", r"\.$", "").alias("first_word"), "taxon", "coded", "words")


@R.query("""
with l as (select l_orderkey, list_sort(list(l_discount)) as d, median(l_quantity) as m, list(l_quantity) as q from lineitem group by 1)
select l_orderkey, case when len(d) > 1 then d[2] else d[1] end as second, round(m, 6) as mid, round(log2(d[1]), 6) as log_low, round(case when d[1] > 0 then least(-ln(d[1]), 3) else 3 end, 6) as neg_log from (select l_orderkey, d, m, q from l where d[1] > 0)
""")
def scalar_numbers(spark, sf_dir):
    """Second smallest, medians and logarithms of lists."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("d"), F.collect_list("l_quantity").alias("q"))
    low = F.array_min("d")
    return lists.filter(low > 0).select(
        "l_orderkey", S.second_smallest(F.col("d")).alias("second"), F.round(S.list_median(F.col("q")), 6).alias("mid"),
        F.round(S.log2_or_null(low), 6).alias("log_low"), F.round(S.neg_log_capped(low, 3.0), 6).alias("neg_log"),
    )


@R.query("""
with r(low, high) as (values (0, 10), (10, 25), (25, 40), (40, 100)) select p_partkey, p_size, low, high from part join r on p_size between low and high
""")
def range_buckets(spark, sf_dir):
    """Sizes in inclusive ranges; a boundary lands in two."""
    return S.assign_ranges(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", [(0, 10), (10, 25), (25, 40), (40, 100)])


@R.query("""
with e as (select event_id, nullif(nullif(case when user_id % 5 = 0 then '-' when user_id % 7 = 0 then 'NA' else event_type end, '-'), 'NA') as event_type, case when event_id % 11 = 0 then null else value end as value from events)
select event_id, event_type, value, round(case when value is null then 1.0 else (value + 1) / 2 end, 6) as mean from e
""")
def null_tokens(spark, sf_dir):
    """Tokens and NaN to null, means that pass over what is missing."""
    e = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("user_id") % 5 == 0, "-").when(F.col("user_id") % 7 == 0, "NA").otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
    )
    return S.normalize_nulls(e, ["event_type", "value"]).withColumn("mean", F.round(S.row_mean(F.col("value"), F.lit(1.0)), 6))


@R.query("""
with w as (select p_partkey, string_split(p_name, ' ') as t, [p_brand || ':x'] as e from part), u as (select p_partkey, unnest(t) as term, unnest(range(len(t))) as i, e from w)
select distinct p_partkey, term, case when i = 0 then regexp_extract(e[1], '^([^:]*)', 1) else 'IEA' end as code from u
""")
def terms_with_evidence(spark, sf_dir):
    """Words of names with evidence, padded where it is missing."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("t"), F.array(F.concat("p_brand", F.lit(":x"))).alias("e"))
    return S.explode_terms(p, "t", "e").select("p_partkey", "term", "code")


@R.query("""
select o_orderkey, case o_orderstatus when 'F' then regexp_extract(o_orderpriority, '^(\\d)-(\\w+)', 1) || '.' || regexp_extract(o_orderpriority, '^(\\d)-(\\w+)', 2) else o_orderpriority end as id,
(o_orderstatus = 'F')::int as charge1, (o_orderstatus = 'O')::int as charge2, 'finished' || '|' || o_orderpriority as mapped from orders where o_orderstatus in ('F', 'O')
""")
def source_ids(spark, sf_dir):
    """Ids by source, one-hots and cells mapped by a dictionary."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus in ('F', 'O')").withColumn("k", F.when(F.col("o_orderstatus") == "F", 1).otherwise(2))
    hot = S.charge_one_hots(F.col("k"), (1, 2))
    mapped = S.map_list(F.concat(F.lit("F|"), "o_orderpriority"), {"F": "finished"})
    return o.select("o_orderkey", S.scan_id(F.col("o_orderstatus"), F.col("o_orderpriority"), {"F": r"^(\d)-(\w+)"}).alias("id"), *[c.alias(n) for n, c in hot.items()], mapped.alias("mapped"))


@R.query("""
with d as (select doc_id, repeat('-', (doc_id % 5)::int) || regexp_replace(text, '[^A-Za-z]', '', 'g') || '--' as a from documents)
select doc_id, (case when regexp_matches(a, '[A-Za-z]') then doc_id % 5 + 1 else 0 end)::int as span_start, (case when regexp_matches(a, '[A-Za-z]') then length(a) - 2 else 0 end)::int as span_end, replace(a, '-', '') as span_text from d
""")
def aligned_span(spark, sf_dir):
    """First and last letter of padded texts."""
    body = F.regexp_replace("text", "[^A-Za-z]", "")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.repeat(F.lit("-"), (F.col("doc_id") % 5).cast("int")), body, F.lit("--")).alias("a"))
    return d.select("doc_id", *[c.alias(n) for n, c in S.aligned_span(F.col("a")).items()])


def _place(spark, sf_dir, name):
    """A new path in the cluster's shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@R.query("select p_partkey::varchar as id, 'mutant A->T of ' || p_brand as description, p_name || p_type as seq from part")
def fasta_scan(spark, sf_dir):
    """A4: records with a bar in their header and sequences of two lines."""
    path = _place(spark, sf_dir, "records")
    p = table(spark, sf_dir, "part")
    p.select(F.concat(F.lit(">"), F.col("p_partkey").cast("string"), F.lit(" mutant A->T of "), "p_brand", F.lit("\n"), "p_name", F.lit("\n"), "p_type")).write.text(path)
    return io.read_fasta(spark, path)


@R.query("select p_brand as id, string_agg(p_name, ' ' order by p_partkey) as seq from part group by 1")
def fasta_roundtrip(spark, sf_dir):
    """A4: brands' names written as FASTA records and read back."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), " ")
    path = _place(spark, sf_dir, "fasta")
    io.write_fasta(table(spark, sf_dir, "part").groupBy("p_brand").agg(names.alias("seq")).withColumn("id", F.col("p_brand")), path, "id", "seq")
    return io.read_fasta(spark, path).select("id", "seq")


@R.query("select s_suppkey, s_name, s_acctbal, s_nationkey as nation from supplier")
def table_roundtrip(spark, sf_dir):
    """A1, A2: suppliers written as a TSV by nation and read in one scan, the nation taken from the path."""
    path = _place(spark, sf_dir, "tsv")
    table(spark, sf_dir, "supplier").withColumn("n", F.col("s_nationkey")).write.partitionBy("n").csv(path, sep="\t", header=True, nullValue="NA")
    made = io.read_many(spark, f"{path}/*", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", r"/n=(\d+)/")
    return made.select("s_suppkey", "s_name", "s_acctbal", F.col("source").cast("int").alias("nation"))


@R.query("select l_orderkey::varchar as id, count(*) as n_items, string_agg(distinct l_partkey::varchar, ';' order by l_partkey::varchar) as items from lineitem group by 1")
def ragged_roundtrip(spark, sf_dir):
    """A3: orders with their parts as ragged tails, read back."""
    li = table(spark, sf_dir, "lineitem")
    path = _place(spark, sf_dir, "ragged")
    tail = F.array_join(F.transform(F.collect_list("l_partkey"), lambda x: x.cast("string")), "\t")
    li.groupBy("l_orderkey").agg(tail.alias("t")).select(F.concat_ws("\t", F.col("l_orderkey").cast("string"), "t")).write.text(path)
    made = io.read_ragged(spark, path, ["id"], "items")
    return made.select("id", F.size("items").cast("long").alias("n_items"), F.array_join(F.array_sort(F.array_distinct("items")), ";").alias("items"))


@R.query("select 'T:' || p_partkey as child, 'T:' || (p_partkey // 2) as parent, 'is_a' as relation from part where p_partkey > 1")
def obo_roundtrip(spark, sf_dir):
    """Parts as ontology terms, written as stanzas among those of relations, and read back as edges."""
    path = _place(spark, sf_dir, "obo")
    p = table(spark, sf_dir, "part")
    up = F.when(F.col("p_partkey") > 1, F.concat(F.lit("\nis_a: T:"), F.floor(F.col("p_partkey") / 2).cast("string"), F.lit(" ! up"))).otherwise("")
    typedef = F.when(F.col("p_partkey") % 3 == 0, "\n[Typedef]\nid: regulates\nname: regulates\nis_a: T:999\n").otherwise("")
    p.select(F.concat(F.lit("[Term]\nid: T:"), F.col("p_partkey").cast("string"), F.lit("\nname: "), "p_name", F.lit("\nnamespace: parts"), up, F.lit("\n"), typedef)).write.text(path)
    return io.read_obo(spark, path)[0]


@R.query("select p_brand as accession, 'NA' as name, string_agg(distinct printf('GO:%07d', p_size), ';' order by printf('GO:%07d', p_size)) as go from part group by 1")
def vocabulary_roundtrip(spark, sf_dir):
    """A5: a mapping file from brands to size terms."""
    path = _place(spark, sf_dir, "map")
    p = table(spark, sf_dir, "part")
    p.select(F.format_string("Brand:%s > GO:size ; GO:%07d", "p_brand", "p_size")).write.text(path)
    made = io.read_external2go(spark, path)
    return made.select("accession", "name", F.array_join("GO", ";").alias("go"))


@R.query("select c_name as seqid, c_nationkey as start, c_nationkey + 10 as \"end\", c_mktsegment as attributes from customer")
def gff_roundtrip(spark, sf_dir):
    """A10: features written with comments and read back."""
    path = _place(spark, sf_dir, "gff")
    rows = F.format_string("%s\tsrc\tnation\t%d\t%d\t.\t+\t.\t%s", "c_name", "c_nationkey", F.col("c_nationkey") + 10, "c_mktsegment")
    table(spark, sf_dir, "customer").select(rows.alias("value")).unionByName(spark.sql("select '#comment' as value")).write.text(path)
    return io.read_gff(spark, path).select("seqid", "start", "end", "attributes")


@R.query("select p_brand || '-' || p_size as \"group\", 'm' || p_partkey as member from part where p_size < 20")
def groups_roundtrip(spark, sf_dir):
    """JSON dictionaries of groups, one a line, inverted and restricted to known members."""
    path = _place(spark, sf_dir, "json")
    p = table(spark, sf_dir, "part").withColumn("member", F.concat(F.lit("m"), F.col("p_partkey").cast("string")))
    groups = p.groupBy(F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("g")).agg(F.collect_list("member").alias("m"))
    groups.select(F.to_json(F.map_from_arrays(F.array("g"), F.array("m")))).write.text(path)
    return io.read_groups(spark, path, p.filter("p_size < 20").select("member"), lines=True).select("group", "member")


@R.query("""select p_brand || ', ' || p_size as "group", 'm"' || p_partkey || ',' || p_name as member from part where p_size < 20""")
def groups_of_one_object(spark, sf_dir):
    """One JSON object of all groups, indented, with commas and quotes in its strings, read in pieces."""
    path = _place(spark, sf_dir, "object")
    p = table(spark, sf_dir, "part").withColumn("member", F.concat(F.lit('m"'), F.col("p_partkey").cast("string"), F.lit(","), F.col("p_name")))
    groups = p.groupBy(F.concat_ws(", ", "p_brand", F.col("p_size").cast("string")).alias("g")).agg(F.collect_list("member").alias("m"))
    one = groups.agg(F.map_from_entries(F.collect_list(F.struct("g", "m"))).alias("m"))
    one.select(F.to_json("m", {"pretty": "true"})).write.text(path)
    return io.read_groups(spark, path, p.filter("p_size < 20").select("member"))


@R.query("select vec_id, len(embedding)::int as dim from embeddings where vec_id in (select p_partkey from part where p_size = 7)")
def embeddings_by_id(spark, sf_dir):
    """Vectors of ids that a table holds."""
    ids = table(spark, sf_dir, "part").filter("p_size = 7").select(F.col("p_partkey").alias("vec_id"))
    return io.read_embeddings(spark, f"{sf_dir}/embeddings.parquet", ids, "vec_id").select("vec_id", F.size("embedding").alias("dim"))


@R.query("""
with d as (select distinct regexp_replace(text, '[^A-Z]', '', 'g') as seq from documents where not contains(text, '<unk>')), n as (select seq, row_number() over (order by seq) - 1 as n from d where length(seq) >= 7)
select 'Doc' || n || '-DENOVO' as id, seq from n
""")
def denovo_peptides(spark, sf_dir):
    """Capitals of documents as sequences, numbered in order."""
    return io.denovo_to_peptides(table(spark, sf_dir, "documents"), "text", "Doc", 7).select("id", "seq")


@R.query("select c_custkey::varchar as \"Prefix\", case when c_custkey % 3 = 0 then 'mgf' else 'raw' end as kind, 'f' || c_custkey || case when c_custkey % 3 = 0 then '.mgf' else '.raw' end as path from customer")
def manifest_roundtrip(spark, sf_dir):
    """A wide manifest in long form, routed by extension."""
    path = _place(spark, sf_dir, "manifest")
    own = F.concat(F.lit("f"), F.col("c_custkey").cast("string"))
    mgf = F.col("c_custkey") % 3 == 0
    wide = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Prefix"), F.when(~mgf, F.concat(own, F.lit(".raw"))).alias("Raw"), F.when(mgf, F.concat(own, F.lit(".mgf"))).alias("mgf"))
    io.write_table(wide, path, null="")
    return io.read_manifest(spark, path, {"mgf": r"\.mgf$", "raw": r"\.raw$"})


QUERIES, ORACLES = R.queries, R.oracles
