"""Records of several sources over the driver's tables: filters, projections, attachments, reports, modifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import scalars as S
from evidentia.operators import aggregate as A
from evidentia.operators import graph as I
from evidentia.operators import joins as C
from evidentia.operators import records as X
from evidentia.operators import sequence as G
from evidentia.operators import stats as K
from evidentia.plans.positions import intervals
from evidentia.plans.registry import Registry, table
from evidentia.plans.scalars import _place
from evidentia.sources import io

R = Registry()


@R.query("select l_orderkey, l_linenumber, l_discount, l_quantity from lineitem where l_discount <= 0.05 and l_quantity >= 10 and l_tax < 0.07 and l_returnflag <> 'R'")
def filter_hits(spark, sf_dir):
    """Lines that meet four thresholds."""
    rules = {"l_discount": ("<=", 0.05), "l_quantity": (">=", 10), "l_tax": ("<", 0.07), "l_returnflag": ("<>", "R")}
    return X.filter_hits(table(spark, sf_dir, "lineitem"), rules).select("l_orderkey", "l_linenumber", "l_discount", "l_quantity")


@R.query("""
with c as (select 'c' as source, unnest([c_mktsegment, 'S' || c_nationkey]) as seq, 'p' || c_nationkey || ';' || c_custkey as proteins, c_acctbal as score from customer where c_acctbal >= 0),
s as (select 's' as source, 'S' || s_nationkey as seq, s_name || ';' || s_suppkey as proteins, s_acctbal as score from supplier),
u as (select * from c union all select * from s), r as (select *, row_number() over (partition by source, seq order by score, proteins) as r from u) select source, seq, proteins, score from r where r = 1
""")
def project_hits(spark, sf_dir):
    """Customers and suppliers as hits of two sources in one shape; negative balances are decoys."""
    c = table(spark, sf_dir, "customer").select(
        F.concat_ws("|", "c_mktsegment", F.concat(F.lit("S"), F.col("c_nationkey").cast("string"))).alias("s"),
        F.concat(F.lit("p"), F.col("c_nationkey").cast("string"), F.lit(" (note, one),"), F.col("c_custkey").cast("string")).alias("p"), "c_acctbal",
    )
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("s"), F.concat_ws("|", "s_name", F.col("s_suppkey").cast("string")).alias("p"), "s_acctbal")
    one = X.project_hits(c, "c", "s", "p", {"c_acctbal": "score"}, F.col("c_acctbal"), F.col("c_acctbal") < 0)
    return one.unionByName(X.project_hits(s, "s", "s", "p", {"s_acctbal": "score"}, F.col("s_acctbal")))


_PSM = """with p as (select l_orderkey as scan, l_linenumber, l_returnflag = 'R' as decoy, l_extendedprice as exp_mz, l_extendedprice - l_discount as calc_mz, 1 + l_linenumber % 5 as charge, l_linenumber % 3 as isotope,
l_quantity as raw_score, case when l_linenumber % 4 = 0 then 0.0 else l_quantity + l_tax end as denovo_score, l_tax + 0.001 as evalue, l_discount as explained, l_tax as n_term, l_discount * l_tax as c_term, l_extendedprice as ms2,
l_tax - 0.04 as mean_error, case when l_suppkey % 9 = 0 then null else l_discount end as stdev_error, case l_linestatus when 'F' then 'PEKTIDEK' else 'MARCOLR' end as seq, case when l_linenumber = 1 then '-' when l_linenumber % 2 = 0 then 'K' else 'A' end as pre,
case when l_linenumber = 2 then '-' when l_linenumber % 3 = 0 then 'P' else 'G' end as post from lineitem)"""


def _psms(spark, sf_dir):
    n, c = F.col("l_linenumber"), F.col
    mods = F.when(n % 2 == 0, F.array(F.struct(F.lit(3).alias("location"), F.lit("15.99").alias("mass")))).otherwise(F.array().cast("array<struct<location:int,mass:string>>"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("run.a"), n.cast("string"), F.lit(".mzML")).alias("name"), c("l_orderkey").alias("scan"), n.alias("line"), (c("l_returnflag") == "R").alias("decoy"), c("l_extendedprice").alias("exp_mz"),
        (c("l_extendedprice") - c("l_discount")).alias("calc_mz"), (1 + n % 5).alias("charge"), (n % 3).alias("isotope"), c("l_quantity").alias("raw_score"),
        F.when(n % 4 == 0, 0.0).otherwise(c("l_quantity") + c("l_tax")).alias("denovo_score"), (c("l_tax") + 0.001).alias("evalue"), c("l_discount").alias("explained"), c("l_tax").alias("n_term"),
        (c("l_discount") * c("l_tax")).alias("c_term"), c("l_extendedprice").alias("ms2_current"), (c("l_tax") - 0.04).alias("mean_error"), F.when(c("l_suppkey") % 9 != 0, c("l_discount")).alias("stdev_error"),
        F.when(c("l_linestatus") == "F", "PEKTIDEK").otherwise("MARCOLR").alias("seq"), F.when(n == 1, "-").when(n % 2 == 0, "K").otherwise("A").alias("pre"), F.when(n == 2, "-").when(n % 3 == 0, "P").otherwise("G").alias("post"),
        mods.alias("mods"), F.array(c("l_suppkey").cast("string"), F.lit("x")).alias("proteins"), "l_suppkey",
    )


@R.query(f"""{_PSM}, s as (select *, l_linenumber as n, case when l_linenumber % 2 = 0 then substr(seq, 1, 3) || '[15.99]' || substr(seq, 4) else seq end as m from p where stdev_error is not null)
select 'run.a' || n || '_SII' || scan as spec_id, case when decoy then -1 else 1 end as label, pre || '.' || m || '.' || post as peptide, round(exp_mz, 3) as exp_mass, round(case when denovo_score = 0 then 0 else raw_score / denovo_score end, 9) as score_ratio,
round(denovo_score - raw_score, 9) as energy, round(-ln(evalue), 9) as ln_evalue, round(ln(explained + 0.0001), 9) as ln_explained, round(ln(n_term + 0.0001), 9) as ln_n_term, round(ln(c_term + 0.0001), 9) as ln_c_term, round(ln(ms2), 9) as ln_ms2_current,
length(seq)::int as pep_len, round((exp_mz - isotope * 1.0033548378::double / charge - calc_mz) / exp_mz, 12) as d_m, round(-mean_error, 9) + 0 as mean_error, round(mean_error * mean_error, 9) as sq_mean_error,
(charge = 1)::int as charge1, (charge = 2)::int as charge2, (charge = 3)::int as charge3, (charge = 4)::int as charge4, (charge = 5)::int as charge5,
((pre in ('K', 'R') and substr(seq, 1, 1) <> 'P') or pre = '-')::int as enz_n, (post <> 'P')::int as enz_c, (length(regexp_replace(pre || m || post, '[^KR]', '', 'g')))::int as n_kr from s""")
def psm_features(spark, sf_dir):
    """Lines as spectrum matches, with all their features."""
    made = X.psm_features(_psms(spark, sf_dir))
    rounded = ["score_ratio", "energy", "ln_evalue", "ln_explained", "ln_n_term", "ln_c_term", "ln_ms2_current", "mean_error", "sq_mean_error"]
    plain = ["spec_id", "label", "peptide", "exp_mass", "pep_len", *[f"charge{k}" for k in range(1, 6)], "enz_n", "enz_c", "n_kr"]
    return made.select(*plain, *[(F.round(c, 9) + 0).alias(c) for c in rounded], F.round("d_m", 12).alias("d_m"))


@R.query("""select 'f' || o_custkey || '.' || o_orderkey as spec_id, case when o_orderstatus = 'F' then -1 else 1 end as label, o_orderkey as scan_nr, o_totalprice, o_orderpriority as peptide,
replace(o_orderstatus || 'REV__x', 'REV__', 'rev_') as proteins from orders where o_custkey % 10 <> 0""")
def to_pin(spark, sf_dir):
    """Orders as a vendor's table; every tenth customer's have no value and are left out."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("file"), F.when(F.col("o_orderstatus") == "F", "+").alias("reverse"),
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_totalprice")).alias("o_totalprice"), "o_orderpriority", F.concat("o_orderstatus", F.lit("REV__x")).alias("p"),
    )
    return X.to_pin(o, "file", "o_orderkey", "reverse", ["o_totalprice"], F.col("o_orderpriority"), S.rewrite(F.col("p"), {"REV__": "rev_"}))


@R.query("""with a as (select p_partkey, p_type || ';K1' as ko, 'S' || (p_partkey % 50) as seed from part where p_partkey % 3 <> 0),
u as (select distinct l_partkey from lineitem), f as (select l_partkey, ko, seed, s_name as seq from u join a on p_partkey = l_partkey left join supplier on 'S' || s_suppkey = seed)
select l_partkey, ko, seed, seq, true as found from f union all select l_partkey, null, null, null, false from u where l_partkey not in (select l_partkey from f)""")
def attach_ortholog(spark, sf_dir):
    """C14: sold parts with the annotation and sequence of their seed, and those without."""
    p = table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0")
    notes = p.select(F.col("p_partkey").alias("q"), F.concat(F.lit("ko:"), "p_type", F.lit(",ko:K1")).alias("ko"))
    seeds = p.select(F.col("p_partkey").alias("q"), F.concat(F.lit("S"), (F.col("p_partkey") % 50).cast("string")).alias("seed"))
    seqs = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("seed"), F.col("s_name").alias("seq"))
    found, rest = X.attach_ortholog(table(spark, sf_dir, "lineitem").select("l_partkey").distinct(), "l_partkey", notes, seeds, "q", "seed", seqs, "seq", ["ko"])
    return found.select("l_partkey", "ko", "seed", "seq", F.lit(True).alias("found")).unionByName(rest.withColumn("found", F.lit(False)), allowMissingColumns=True)


@R.query("""with u as (select p_type as pep, min('u' || p_brand) as u from part where p_size < 25 group by 1), l as (select s_nationkey::varchar as pep, min(s_name) as p from supplier group by 1),
m as (select l_orderkey, l_linenumber, o_totalprice, case when l_linenumber % 2 = 0 then p_type else (l_suppkey % 25)::varchar end as pep, case when l_returnflag = 'N' then 'own' end as prot from lineitem join orders on l_orderkey = o_orderkey join part on p_partkey = l_partkey where o_orderstatus <> 'P')
select l_orderkey, l_linenumber, o_totalprice, coalesce(prot, u, p) as protein from m left join u using (pep) left join l using (pep)""")
def map_scans(spark, sf_dir):
    """Lines with their order's price; missing owners filled from two tables in turn."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    pep = F.when(F.col("l_linenumber") % 2 == 0, F.col("p_type")).otherwise((F.col("l_suppkey") % 25).cast("string"))
    psms = li.select("l_orderkey", "l_linenumber", pep.alias("pep"), F.when(F.col("l_returnflag") == "N", "own").alias("protein"))
    scans = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    unmatched = table(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_type").alias("pep"), F.concat(F.lit("u"), "p_brand").alias("protein"))
    proteins = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("protein"), F.array(F.col("s_nationkey").cast("string")).alias("peps"))
    return X.map_scans(psms, scans, "l_orderkey", "protein", unmatched, proteins, "pep", "peps").select("l_orderkey", "l_linenumber", "o_totalprice", "protein")


@R.query("""with g as (select l_returnflag, l_linestatus, l_orderkey, l_partkey, l_discount, l_quantity, count(*) over (partition by l_orderkey) as m from lineitem)
select l_returnflag, l_linestatus, count(distinct l_orderkey) as n_groups, count(distinct case when m > 1 then l_orderkey end) as n_multi, count(distinct l_partkey) as n_items, count(distinct case when l_discount <= 0.02 then l_partkey end) as n_below,
count(*) filter (l_quantity > 25) as n_large, count(*) filter (l_quantity <= 25) as n_small, count(distinct case when l_discount <= 0.02 then l_partkey end) / count(distinct l_partkey) as share_below from g group by all""")
def search_report(spark, sf_dir):
    """A report on lines by flag and status."""
    li = table(spark, sf_dir, "lineitem")
    members = li.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("m"))
    kinds = {"large": F.col("l_quantity") > 25, "small": F.col("l_quantity") <= 25}
    return X.search_report(li.join(members, "l_orderkey"), ["l_returnflag", "l_linestatus"], "l_orderkey", "m", "l_partkey", "l_discount", 0.02, kinds)


@R.query("""select o_orderpriority, count(*) as n_scans, count(k) as n_matched, coalesce(sum(a), 0)::bigint as "A", coalesce(sum(n), 0)::bigint as "N", coalesce(sum(r), 0)::bigint as "R", count(k) / count(*) as share from orders left join
(select l_orderkey as k, max((l_returnflag = 'A')::int) as a, max((l_returnflag = 'N')::int) as n, max((l_returnflag = 'R')::int) as r from lineitem where l_quantity > 45 group by 1) on k = o_orderkey group by 1""")
def matched_scans(spark, sf_dir):
    """Orders by priority, and how many have large lines of each flag."""
    scans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan"), "o_orderpriority")
    hits = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("scan"), "l_returnflag")
    return X.matched_scans(scans, "scan", "o_orderpriority", hits, "l_returnflag", ["A", "N", "R"])


_MODS = """with e as (select o_custkey, o_orderpriority || o_orderstatus as pep from orders group by all), m as (select o_custkey, regexp_extract(pep, '-([A-Z]+)', 1) as modification, count(*) as n from e where regexp_extract(pep, '-([A-Z]+)', 1) <> '' group by all)"""


def _mods(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.concat("o_orderpriority", "o_orderstatus")).alias("peps"))
    return A.count_mods(o, "o_custkey", "peps", r"-([A-Z]+)")


@R.query(f"{_MODS} select o_custkey, string_agg(modification || ' ' || n, '|' order by modification) as mods from m group by 1")
def mods_cell(spark, sf_dir):
    """Words of priorities as modifications: how many distinct texts of a customer have each, in one cell."""
    return A.mods_cell(_mods(spark, sf_dir), "o_custkey")


@R.query(f"""{_MODS}, t as (select o_custkey, coalesce(sum(n) filter (modification like 'HIGH%'), 0)::bigint as h, coalesce(sum(n) filter (modification like 'LOW%'), 0)::bigint as l from m group by 1),
w as (select o_custkey, coalesce(sum(n) filter (modification = 'HIGHF'), 0)::bigint as "HIGHF", coalesce(sum(n) filter (modification = 'LOWO'), 0)::bigint as "LOWO" from m group by 1)
select o_custkey, "HIGHF", "LOWO", round(case when "HIGHF" + "LOWO" = 0 then null else "HIGHF" / ("HIGHF" + "LOWO") end, 9) as "HIGHF_share", round(case when "HIGHF" + "LOWO" = 0 then null else "LOWO" / ("HIGHF" + "LOWO") end, 9) as "LOWO_share" from w""")
def mod_matrix(spark, sf_dir):
    """The cells read back into columns and shares."""
    made = A.mod_matrix(A.mods_cell(_mods(spark, sf_dir), "o_custkey"), "o_custkey", "mods", ["HIGHF", "LOWO"])
    return made.withColumns({c: F.round(c, 9) for c in ("HIGHF_share", "LOWO_share")})


@R.query("""with w as (select p_partkey, unnest([split_part(p_name, ' ', 1), 'PF' || (p_size % 30), split_part(p_name, ' ', 2)]) as e from part), a as (select distinct 'PF' || n_nationkey as e, 'GO:' || n_regionkey as go from nation),
n as (select distinct split_part(p_name, ' ', 1) as e, 'GO:' || (p_size % 4) as go from part where p_size > 45), g as (select p_partkey, go from w join a using (e) where regexp_matches(e, '^PF\\d+$') union select p_partkey, go from w join n using (e) where not regexp_matches(e, '^PF\\d+$') union select p_partkey, 'GO:own' from part)
select p_partkey, string_agg(go, ';' order by go) as go from g group by 1""")
def map_vocabulary(spark, sf_dir):
    """Words of names by name and codes by accession, with the terms that a part has."""
    p = table(spark, sf_dir, "part")
    code = F.concat(F.lit("PF"), (F.col("p_size") % 30).cast("string"))
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    rows = p.select("p_partkey", F.array(word(1), code, word(2)).alias("e"), F.array(F.lit("GO:own")).alias("own"))
    by_code = table(spark, sf_dir, "nation").select(F.concat(F.lit("PF"), F.col("n_nationkey").cast("string")).alias("accession"), F.concat(F.lit("GO:"), F.col("n_regionkey").cast("string")).alias("go")).distinct()
    by_name = p.filter("p_size > 45").select(word(1).alias("name"), F.concat(F.lit("GO:"), (F.col("p_size") % 4).cast("string")).alias("go")).distinct()
    made = C.map_vocabulary(rows, "p_partkey", "e", r"^PF\d+$", by_code, by_name, "go", known="own")
    return made.select("p_partkey", F.array_join("go", ";").alias("go"))


@R.query("""select c_custkey, coalesce(case when c_custkey % 3 = 0 then c_mktsegment end, case when c_custkey % 3 = 1 then 'Homo sapiens' when c_custkey % 3 = 2 then 'Some bug' end) as organism, lower(c_mktsegment || ' like protein') as name from customer""")
def header_fields(spark, sf_dir):
    """Organism and name from headers made of customers."""
    k = F.col("c_custkey") % 3
    tail = F.when(k == 1, " OS=Homo sapiens OX=9606").when(k == 2, " [Some bug]").otherwise("")
    header = F.concat(F.lit("sp|X|Y "), "c_mktsegment", F.lit(" like protein"), tail)
    known = F.when(k == 0, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.organism(known, header).alias("organism"), S.name_from_header(header).alias("name"))


@R.query("""with l as (select l_orderkey, list('PEP' || l_returnflag || case when l_linenumber % 2 = 0 then '[16]' else '' end) as p from lineitem group by 1)
select l_orderkey, len(p)::int as n, len(list_distinct(list_transform(p, lambda x: regexp_replace(x, '[^A-Z]', '', 'g'))))::int as n_distinct, 4 as longest from l""")
def list_counts(spark, sf_dir):
    """Elements, distinct cleaned elements and the longest of an order's list."""
    pep = F.concat(F.lit("PEP"), "l_returnflag", F.when(F.col("l_linenumber") % 2 == 0, "[16]").otherwise(""))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(pep).alias("p"))
    return rows.select("l_orderkey", *[c.alias(n) for n, c in S.list_counts(F.col("p")).items()])


@R.query("""select l_orderkey, l_linenumber, l_partkey::varchar as ids, l_orderkey || l_returnflag as grp from lineitem union all select l_orderkey, l_linenumber, 's' || l_suppkey, l_orderkey || l_returnflag from lineitem""")
def explode_and_tag(spark, sf_dir):
    """A line's delimited ids as rows, its group tagged with its source."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(",", F.col("l_partkey").cast("string"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("ids"), F.col("l_orderkey").alias("grp"), "l_returnflag")
    return A.explode_and_tag(li, "ids", "grp", "l_returnflag").drop("l_returnflag")


@R.query("""with s as (select item_id, regexp_replace(upper(text), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') as s from benchmark), m(r, m) as (values """ + ", ".join(f"('{k}', {v})" for k, v in S.RESIDUE_MASS.items()) + """),
c as (select item_id, unnest(string_split(replace(replace(replace(replace(regexp_replace(s, '([KR])', '\\1|', 'g'), '|P', 'P'), 'K|K', 'K|K'), '||', '|'), '', ''), '|')) as p from s), p as (select distinct item_id, p from c where p <> ''),
w as (select item_id, p, 18.010565::double + sum(m::double) as mass from (select item_id, p, unnest(string_split(p, '')) as r from p) join m using (r) group by all), able as (select item_id, count(*) as observable from w where mass between 600 and 3500 group by 1),
seen as (select item_id, count(distinct p) as observed from p where length(p) % 2 = 0 group by 1) select item_id, observable, observed, round(power(10.0, observed / observable) - 1, 6) as empai from able join seen using (item_id)""")
def empai(spark, sf_dir):
    """Benchmark items as sequences; peptides of even length count as observed."""
    s = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(F.upper("text"), "[^ACDEFGHIKLMNPQRSTVWY]", "").alias("s"))
    seen = s.select("item_id", F.explode(F.split("s", "(?<=[KR])(?!P)")).alias("p")).filter("p <> '' and length(p) % 2 = 0")
    return A.empai(s, "item_id", "s", seen, "p").withColumn("empai", F.round("empai", 6))


_AMB = {"B": "ND", "Z": "QE", "J": "LI"}


@R.query("""with d as (select doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as s from documents)
select doc_id, length(s) - length(translate(s, 'XU', '')) as n_dropped, 0 as n_left, length(translate(s, 'XU', '')) as n, true as kept_others, true as one_each from d""")
def resolve_ambiguous(spark, sf_dir):
    """B, Z and J become one of their two residues throughout a text, X and U go, all else stays."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("s"))
    made = d.withColumn("r", S.resolve_ambiguous(F.col("s"), F.col("doc_id")))
    plain = F.translate("s", "XU", "")
    options = F.array(*[F.translate(F.translate(F.translate(plain, "B", b), "Z", z), "J", j) for b in _AMB["B"] for z in _AMB["Z"] for j in _AMB["J"]])
    others = lambda c: F.regexp_replace(c, "[BZJNDQELI]", "")
    return made.select(
        "doc_id", (F.length("s") - F.length("r")).cast("long").alias("n_dropped"), F.length(F.regexp_replace("r", "[^BZJXU]", "")).alias("n_left"), F.length("r").cast("long").alias("n"),
        (others("r") == others(plain)).alias("kept_others"), F.array_contains(options, F.col("r")).alias("one_each"),
    )


@R.query("select p_size as size, p_name as name, p_partkey, p_brand, p_type, p_retailprice from part")
def layout(spark, sf_dir):
    """Columns renamed where they are there, some moved to the front."""
    return S.layout(table(spark, sf_dir, "part"), ["size", "name", "absent"], {"p_size": "size", "p_name": "name", "no_such": "x"})


@R.query("""with c as (select distinct l_orderkey, l_returnflag, l_linestatus from lineitem) select o_orderkey, l_returnflag, l_linestatus from orders left join c on l_orderkey = o_orderkey""")
def merge_coverage(spark, sf_dir):
    """Parts of lines joined back to their orders; orders without any stay."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linestatus")
    parts = [li.filter("l_linestatus = 'F'"), li.filter("l_linestatus <> 'F'")]
    return G.merge_coverage(table(spark, sf_dir, "orders").select("o_orderkey"), parts, "o_orderkey")


@R.query("select c_custkey, nullif(c_name, 'Customer#000000007') as c_name, c_acctbal from customer")
def table_scan(spark, sf_dir):
    """A1: customers written as a TSV with a null token and read again."""
    path = _place(spark, sf_dir, "scan")
    io.write_table(table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_name", F.lit("Customer#000000007")).alias("c_name"), "c_acctbal"), path)
    return io.read_table(spark, path, "c_custkey long, c_name string, c_acctbal double")


@R.query("""select c_custkey, 'P' || c_nationkey || '_F:fun;Q' || c_custkey || '_C:cell' as "GO", 'I' || c_custkey as "InterPro", case when c_custkey % 2 = 0 then 'K' || c_custkey end as "KEGG", 'IEA:x;IDA:y' as "GO_evidence" from customer""")
def flatten_xrefs(spark, sf_dir):
    """Cross-references of customers as JSON, flattened by database."""
    own = F.col("c_custkey").cast("string")
    ref = lambda db, i, *v: F.struct(F.lit(db).alias("database"), i.alias("id"), F.array(*[F.struct(F.lit(x).alias("value")) for x in v]).alias("properties"))
    go = [ref("GO", F.concat(F.lit("P"), F.col("c_nationkey").cast("string")), "F:fun", "IEA:x"), ref("GO", F.concat(F.lit("Q"), own), "C:cell", "IDA:y")]
    more = F.when(F.col("c_custkey") % 2 == 0, F.array(ref("KEGG", F.concat(F.lit("K"), own), "-"))).otherwise(F.array(ref("Other", own, "-")))
    refs = F.concat(F.array(*go, ref("InterPro", F.concat(F.lit("I"), own), "Name", "1")), more)
    c = table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(refs.alias("uniProtKBCrossReferences"))).alias("j"))
    return io.flatten_xrefs(c, "j", ["GO", "InterPro", "KEGG"])


@R.query("select p_brand || '-' || p_partkey as query, p_type as target, p_size::varchar as score from part")
def preamble_scan(spark, sf_dir):
    """Parts in files of their brand behind preambles of all sorts, with comments at the end."""
    path = _place(spark, sf_dir, "marked")
    p = table(spark, sf_dir, "part").withColumn("b", F.col("p_brand"))
    row = F.concat_ws("\t", F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")), "p_type", F.col("p_size").cast("string"))
    head = F.array(F.lit("## made by a tool"), F.lit("made without marks\tx\ty"), F.lit(""), F.lit("#query\ttarget\tscore"))
    lines = p.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("p_partkey", row.alias("r")))).alias("rows"))
    text = F.array_join(F.concat(head, F.transform("rows", lambda x: x["r"]), F.array(F.lit("## end"))), "\n")
    lines.select("b", text.alias("value")).write.partitionBy("b").text(path)
    return io.read_after_marker(spark, f"{path}/*", ["#query", "#qseqid"], ["query", "target", "score"])


@R.query("""with recursive e as (select distinct p_partkey as child, unnest([p_partkey // 2, p_partkey // 3]) as parent from part), d as (select * from e where parent >= 1), c as (select child as node, parent as ancestor, 1 as depth from d union select c.node, d.parent, c.depth + 1 from c join d on d.child = c.ancestor),
l as (select node, min(depth) as level from c where ancestor = 1 group by 1 union all select 1, 0), w as (select p_partkey as node, string_split(p_name, ' ') as w from part), p as (select distinct node, ancestor from c),
n as (select ancestor as node, count(*) as n_variants from p join w using (node) join w v on v.node = p.ancestor where len(list_intersect(w.w, v.w)) > 0 group by 1) select node, n_variants, level from n join l using (node) where level > 1 and n_variants > 2""")
def generic_terms(spark, sf_dir):
    """Parts that share a word with several of those below them."""
    p = table(spark, sf_dir, "part")
    edges = p.select(F.col("p_partkey").alias("child"), F.explode(F.array_distinct(F.array(F.floor(F.col("p_partkey") / 2), F.floor(F.col("p_partkey") / 3)))).alias("parent")).filter("parent >= 1 and child <> parent")
    closed = I.closure(edges, "child", "parent")
    level = I.levels_below(edges, "child", "parent", spark.range(1, 2).select(F.col("id").alias("node")))
    return I.generic_terms(closed, p.select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name")), level, 1, 2)


_I = "with i as (select user_id, event_id, event_type, floor(epoch(ts))::bigint as a, floor(epoch(ts))::bigint + greatest(1, floor(value * 60)::bigint) as b from events)"


@R.query(f"""{_I}, x as (select user_id, unnest(['source_' || case when event_type = 'view' then 'unidentified' else event_type end, 'kind_' || case when event_id % 2 = 0 then 'even' else 'odd' end]) as o, a, b from i),
y as (select *, case when max(b) over w is null or a >= max(b) over w then 1 else 0 end as f from x window w as (partition by user_id, o order by a, b rows between unbounded preceding and 1 preceding)), g as (select *, sum(f) over (partition by user_id, o order by a, b rows unbounded preceding) as k from y),
r as (select user_id, o, k, min(a) as a, max(b) as b from g group by all), c as (select user_id, o, sum(b - a)::bigint as covered from r group by all), n as (select user_id, o, count(*) as n from x group by all), t as (select * from n join c using (user_id, o))
select user_id, """ + ", ".join(f"coalesce(sum({v}) filter (o = '{c}'), 0)::bigint as {c}_{v}" for c in ("source_click", "source_error", "source_unidentified", "kind_even", "kind_odd") for v in ("covered", "n")) + ", (select count(*) from i where i.user_id = t.user_id) as n_all from t group by user_id")
def coverage_contribution(spark, sf_dir):
    """Covered seconds and rows by type of event, by kind and without a type."""
    e = intervals(spark, sf_dir).withColumn("source", F.when(F.col("event_type") == "view", "unknown").otherwise(F.col("event_type")))
    e = e.withColumn("kind", F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd"))
    return G.coverage_contribution(e, "user_id", "source", "kind", ["click", "error"], ["even", "odd"], "a", "b")


@R.query("""with s as (select o_orderstatus as r, unnest(['price', 'key']) as metric, unnest([avg(o_totalprice), avg(o_custkey)]) as m from orders group by 1)
select metric, round(max(m) filter (r = 'F'), 6) as mean_a, round(max(m) filter (r = 'O'), 6) as mean_b, round((max(m) filter (r = 'O') - max(m) filter (r = 'F')) / max(m) filter (r = 'F'), 9) as change from s group by 1""")
def percent_change(spark, sf_dir):
    """Change of orders' means from one status to another."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("key"))
    made = A.percent_change(A.summarise(o, ["price", "key"], "o_orderstatus"), "o_orderstatus", "F", "O")
    return made.select("metric", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), F.round("change", 9).alias("change"))


@R.query("""with n as (select r_name, o_orderstatus, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all), w as (select r_name, sum(n) filter (o_orderstatus = 'F') as "F", sum(n) filter (o_orderstatus = 'O') as "O" from n group by 1)
select c as "column", max(v) filter (r_name = 'ASIA') as "ASIA", max(v) filter (r_name = 'EUROPE') as "EUROPE" from (select r_name, 'F' as c, "F"::varchar as v from w union all select r_name, 'O', "O"::varchar from w) group by 1""")
def transposed(spark, sf_dir):
    """Orders of regions by status, made wide and turned."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    wide = A.to_wide(rows.groupBy("r_name", "o_orderstatus").agg(F.count("*").alias("n")), ["r_name"], "o_orderstatus", "n", ["F", "O"])
    return A.transpose(wide, "r_name", ["ASIA", "EUROPE"])


@R.query("""with c as (select event_type as a, user_id % 7 as b, count(*) as n from events group by all), r as (select a, sum(n) as na from c group by 1), k as (select b, sum(n) as nb from c group by 1), t as (select sum(n) as t from c),
g as (select coalesce(n, 0) as n, na * nb / t as e from r cross join k cross join t left join c using (a, b)) select round(sum((n - e) ** 2 / e), 6) as chi2, ((select count(*) from r) - 1) * ((select count(*) from k) - 1) as df from g""")
def chi_square_table(spark, sf_dir):
    """K6: the whole table of events' types by a class of users; p is tested by itself."""
    e = table(spark, sf_dir, "events").withColumn("u", F.col("user_id") % 7)
    made = K.chi_square_table(A.contingency(e, "event_type", "u"), "event_type", "u")
    return made.select(F.round("chi2", 6).alias("chi2"), "df")


@R.query("""with s as (select distinct l_orderkey, l_returnflag as f from lineitem) select x.l_orderkey, x.f as a, y.f as b from s x join s y on x.l_orderkey = y.l_orderkey and x.f < y.f""")
def source_pairs(spark, sf_dir):
    """C20: pairs of an order's flags."""
    return C.pairs(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


@R.query("""with a as (select c_nationkey as k, sum(c_acctbal) as v from customer where c_custkey % 3 = 0 group by 1), b as (select s_nationkey as k, sum(s_acctbal) as v from supplier group by 1)
select k, round(v, 4) as v, 'a' as run from a where k in (select k from b) union all select k, round(v, 4), 'b' from b where k in (select k from a)""")
def compare_long(spark, sf_dir):
    """Balances by nation of two tables, stacked, nations of both alone."""
    a = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("v"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("v"))
    return C.compare_long(a, b, "k", ["v"], shared_only=True).withColumn("v", F.round("v", 4))


@R.query("select page_id, string_agg(distinct x, ';' order by x) as parts from (select page_id, unnest(string_split_regex(regexp_replace(replace(url, '/', ';'), '\\?.*$', ''), '[;,]')) as x from pages) where x not in ('', '-', 'http:', 'https:') group by 1")
def list_clean(spark, sf_dir):
    """The parts of urls as cleaned lists."""
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(S.list_clean(F.replace("url", F.lit("/"), F.lit(";")), drop=("", "-", "http:", "https:"), suffix=r"\?.*$"), ";").alias("parts"))


@R.query("select s_suppkey || '-' || 'n' || s_nationkey as id, s_acctbal, 'n' || s_nationkey as taxon from supplier where s_acctbal > 0")
def combine_taxa(spark, sf_dir):
    """H4: suppliers in a folder for each nation, stacked with the nation behind their ids."""
    path = _place(spark, sf_dir, "taxa")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("t"))
    s.write.partitionBy("t").csv(path, sep="\t", header=True, nullValue="NA")
    return io.combine_taxa(spark, f"{path}/*", "id string, s_acctbal double", "id", F.col("s_acctbal") > 0, r"/t=(n\d+)/")


@R.query("""select l_partkey, l_returnflag, median(distinct l_quantity) as l_quantity, string_agg(distinct l_suppkey::varchar, ';' order by l_suppkey::varchar) as l_suppkey from lineitem where l_quantity is not null group by all""")
def consensus_rows(spark, sf_dir):
    """Medians of a part's distinct quantities, and its distinct suppliers."""
    li = table(spark, sf_dir, "lineitem").withColumn("l_suppkey", F.col("l_suppkey").cast("string"))
    return A.distinct_median(li, ["l_partkey", "l_returnflag"], "l_quantity", ["l_suppkey"]).withColumn("l_suppkey", F.array_join("l_suppkey", ";"))


@R.query(r"""with t as (select p_partkey, p_size, p_brand, case when p_partkey % 4 = 0 then 'AB[16]C' when p_partkey % 4 = 1 then 'ABC' when p_partkey % 4 = 2 then 'A.bc' else 'A]bC' end || upper(p_type) as s from part)
select p_partkey, case when regexp_matches(s, '[\]a-z0-9.\-]') then regexp_replace(upper(s), '[^A-Z]', '', 'g') else s end as residues, regexp_replace(s, '\[[^\]]*\]', '', 'g') as plain, case when contains(s, ']') then regexp_replace(upper(s), '[^A-Z]', '', 'g') else s end as bracketed,
case p_partkey % 3 when 0 then 'P' || p_partkey || '|NAME' when 1 then 'P' || p_partkey || '.1' else 'NONE' end as id from t""")
def sequence_modes(spark, sf_dir):
    """All modes of cleaning, and ids from headers of three kinds."""
    k, own = F.col("p_partkey"), F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    s = F.concat(F.when(k % 4 == 0, "AB[16]C").when(k % 4 == 1, "ABC").when(k % 4 == 2, "A.bc").otherwise("A]bC"), F.upper("p_type"))
    header = F.when(k % 3 == 0, F.concat(F.lit("sp|"), own, F.lit("|NAME| more"))).when(k % 3 == 1, F.concat(own, F.lit(".1 protein"))).otherwise("no id here")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.clean_sequence(s, "residues").alias("residues"), S.clean_sequence(s, "strip_mods").alias("plain"), S.clean_sequence(s, "brackets_only").alias("bracketed"), S.id_from_header(header).alias("id"),
    )


@R.query("""select event_id, user_id, case when event_id % 3 = 0 then null else value end as value, round(case when event_id % 3 = 0 then (user_id + 10) / 2 else list_median([value, user_id::double, 10.0]) end, 6) as middle from events""")
def row_medians(spark, sf_dir):
    """Columns without any value go, and medians over columns."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.lit(None).cast("string").alias("nothing"))
    made = S.drop_all_null_columns(e)
    return made.withColumn("middle", F.round(S.row_median(F.col("value"), F.col("user_id"), F.lit(10.0)), 6))


@R.query("""with g as (select l_orderkey, min(l_returnflag) as l_returnflag, (count(distinct l_returnflag) > 1)::int as mixed, sum(l_extendedprice) as v from lineitem group by 1), c as (select l_returnflag, count(*) as n_groups, sum(mixed)::bigint as n_mixed, sum(v) as v from g group by 1)
select l_returnflag, n_groups, n_mixed, round(n_groups / sum(n_groups) over (), 9) as count_share, round(v / sum(v) over (), 9) as value_share, case l_returnflag when 'A' then 0.5 when 'N' then 0.3 else 0.2 end as truth,
round(v / sum(v) over () - case l_returnflag when 'A' then 0.5 when 'N' then 0.3 else 0.2 end, 9) as off from c""")
def composition_truth(spark, sf_dir):
    """Shares of orders by their smallest flag, against given ones."""
    made = A.composition(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_extendedprice", {"A": 0.5, "N": 0.3, "R": 0.2})
    return made.withColumns({c: F.round(c, 9) for c in ("count_share", "value_share", "off")})


QUERIES, ORACLES = R.queries, R.oracles
