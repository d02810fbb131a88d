"""Joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import aggregate as A
from evidentia.operators import joins as J
from evidentia.operators.windows import dedup
from evidentia.plans.registry import Registry, table

R = Registry()


@R.query("""
with s as (select l_orderkey, l_returnflag, cast(round(avg(l_discount) * 1e6) as bigint) as d from lineitem group by all),
k as (select l_orderkey from s group by 1 having count(distinct l_returnflag) >= 2)
select l_orderkey, string_agg(l_returnflag, ';' order by l_returnflag) as sources, string_agg(d::varchar, ';' order by l_returnflag) as evidence, count(*) as n_sources
from s join k using (l_orderkey) group by 1
""")
def at_least_two_sources(spark, sf_dir):
    """Orders whose lines have two return flags at least, with each flag's mean discount (millionths)."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.round(F.avg("l_discount") * 1e6).cast("long").alias("d"))
    merged = J.merge_sources(J.at_least_k_sources(li, "l_orderkey", "l_returnflag", 2), "l_orderkey", "l_returnflag", ["d"])
    text = F.array_join(F.transform("d", lambda x: x.cast("string")), ";")
    return merged.select("l_orderkey", F.array_join("l_returnflag", ";").alias("sources"), text.alias("evidence"), F.size("d").cast("long").alias("n_sources"))


@R.query("""
with r as (select l_partkey, list_sort(list(distinct l_quantity)) as q from lineitem where l_returnflag = 'R' group by 1),
a as (select l_partkey, list_sort(list(distinct l_quantity)) as q from lineitem where l_returnflag = 'A' group by 1)
select coalesce(r.l_partkey, a.l_partkey) as l_partkey, array_to_string(list_transform(list_concat(coalesce(r.q, []), coalesce(a.q, [])), lambda x: x::int), ';') as quantities,
case when a.q is null then 'left' when r.q is null then 'right' else 'both' end as origin
from r full join a on r.l_partkey = a.l_partkey
""")
def overlap_merge(spark, sf_dir):
    """Parts returned and accepted, their quantities concatenated."""
    li = table(spark, sf_dir, "lineitem")
    side = lambda f: li.filter(F.col("l_returnflag") == f).groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_quantity")).alias("q"))
    made = J.merge_overlap(side("R"), side("A"), "l_partkey", ["q"])
    return made.select("l_partkey", F.array_join(F.transform("q", lambda x: x.cast("int").cast("string")), ";").alias("quantities"), "origin")


@R.query("""
select s_suppkey, s_name from supplier where s_suppkey not in (select l_suppkey from lineitem where l_returnflag = 'R' and l_shipdate < timestamp '1993-01-01' and l_quantity > 40)
""")
def not_in_any_list(spark, sf_dir):
    """C4: suppliers in none of the delimited lists of suppliers by part."""
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_shipdate < timestamp '1993-01-01' and l_quantity > 40")
    lists = A.collapse(li, ["l_partkey"], ["l_suppkey"])
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_suppkey").cast("string").alias("id"))
    return J.not_in_any_list(s, "id", lists, "l_suppkey").drop("id")


@R.query("""
with d as (select l_orderkey, l_suppkey, l_partkey, case l_returnflag when 'R' then 1 when 'A' then 2 else 3 end as found_in from lineitem
           where (l_returnflag = 'R' and l_quantity > 30) or (l_returnflag = 'A' and l_quantity > 30) or (l_returnflag = 'N' and l_quantity > 45)),
b as (select *, row_number() over (partition by l_orderkey order by found_in, l_suppkey, l_partkey) as n from d)
select o_orderkey as l_orderkey, l_suppkey, found_in from orders left join b on o_orderkey = l_orderkey and n = 1
""")
def cascade_lookup(spark, sf_dir):
    """Each order's supplier from the first of three slices that has the order."""
    li = table(spark, sf_dir, "lineitem")
    slices = [li.filter(f"l_returnflag = '{f}' and l_quantity > {q}") for f, q in (("R", 30), ("A", 30), ("N", 45))]
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return J.cascade_lookup(keys, "l_orderkey", slices, ["l_suppkey"], ["l_suppkey", "l_partkey"])


@R.query("""
select c_custkey, coalesce(n1.n_nationkey, n2.n_nationkey, -1) as n_nationkey from (select c_custkey, case when c_custkey % 3 = 0 then n_name || ' sp. nov' when c_custkey % 3 = 1 then n_name else 'none' end as n_name
from customer join nation on c_nationkey = n_nationkey) c left join nation n1 on n1.n_name = c.n_name left join nation n2 on n2.n_name = regexp_replace(c.n_name, ' sp.*$', '')
""")
def lookup_with_retry(spark, sf_dir):
    """Nations by name, and by cleaned name where that fails."""
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat("n_name", F.lit(" sp. nov"))).when(F.col("c_custkey") % 3 == 1, F.col("n_name")).otherwise("none")
    c = c.select("c_custkey", name.alias("n_name"))
    out = J.lookup_with_retry(c, "n_name", n.select("n_name", "n_nationkey"), "n_nationkey", F.regexp_replace("n_name", " sp.*$", ""))
    return out.select("c_custkey", "n_nationkey")


@R.query("""
with p as (select l_partkey as p_partkey, round(max(l_extendedprice), 2) as p_retailprice from lineitem where l_quantity > 49 group by 1)
select part.p_partkey, p_name, case when p.p_partkey is not null then p.p_retailprice else part.p_retailprice end as p_retailprice, p.p_partkey is not null as patched
from part left join p on p.p_partkey = part.p_partkey
""")
def patch_rows(spark, sf_dir):
    """Parts whose price large lines replace."""
    patch = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.max("l_extendedprice"), 2).alias("p_retailprice"))
    return J.patch_rows(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), patch, "p_partkey")


_ORDER = "l_discount, l_extendedprice desc, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_quantity, l_tax, l_returnflag, l_linestatus"


@R.query(f"""
with h as (select *, row_number() over (partition by l_orderkey order by {_ORDER}) as n from lineitem where l_quantity >= 30 and l_discount <= 0.05)
select l_partkey, count(distinct l_orderkey) as n_queries, string_agg(distinct l_returnflag, ';' order by l_returnflag) as flags,
sum(case when n = 1 then 1 else 0 end)::bigint as n_best, (count(distinct l_orderkey) = 1)::int as single from h group by 1
""")
def fold_hits(spark, sf_dir):
    """Accepted lines folded by part, each order's best line flagged."""
    order = [F.expr(x) if " desc" not in x else F.desc(x.split()[0]) for x in _ORDER.split(", ")]
    folded = J.fold_hits(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", F.expr("l_quantity >= 30 and l_discount <= 0.05"), order, ["l_returnflag"])
    return folded.select("l_partkey", F.size("queries").cast("long").alias("n_queries"), F.array_join("l_returnflag", ";").alias("flags"), "n_best", "single")


@R.query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity >= 30 and l_discount <= 0.05)")
def rejected_queries(spark, sf_dir):
    """C7q: orders without an accepted line."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    out = J.rejected_queries(keys, table(spark, sf_dir, "lineitem"), "l_orderkey", F.expr("l_quantity >= 30 and l_discount <= 0.05"))
    return out.withColumnRenamed("l_orderkey", "o_orderkey")


@R.query("""
with b as (select l_partkey, list(distinct l_returnflag) as f from lineitem where l_linestatus = 'F' and l_quantity > 25 group by 1),
h as (select l_partkey, list(distinct l_returnflag) as f from lineitem where l_linestatus = 'O' and l_quantity > 25 group by 1)
select b.l_partkey, array_to_string(list_sort(list_distinct(list_concat(b.f, coalesce(h.f, [])))), ';') as flags, case when h.f is null then 'untouched' else 'extended' end as status
from b left join h on b.l_partkey = h.l_partkey
union all select h.l_partkey, array_to_string(list_sort(h.f), ';'), 'new' from h anti join b on h.l_partkey = b.l_partkey join part on p_partkey = h.l_partkey
""")
def split_known(spark, sf_dir):
    """Open lines' parts extend the closed ones' or are new."""
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 25")
    side = lambda s: li.filter(F.col("l_linestatus") == s).groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("f"))
    meta = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))
    return J.split_known(side("O"), side("F"), "l_partkey", "f", meta).select("l_partkey", F.array_join("f", ";").alias("flags"), "status")


@R.query("""
select a.doc_id as subject, b.item_id as query, length(a.text) as subject_length, length(b.text) as query_length from documents a join benchmark b on a.doc_id % 40 = b.item_id % 40
where length(a.text) >= length(b.text)
""")
def length_consistent(spark, sf_dir):
    """Documents at least as long as the benchmark item that they are set against."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hits = d.select(F.col("doc_id").alias("subject"), (F.col("doc_id") % 40).alias("k")).join(b.select(F.col("item_id").alias("query"), (F.col("item_id") % 40).alias("k")), "k").drop("k")
    dim = d.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.length("text").cast("long").alias("length")).unionByName(b.select(F.concat(F.lit("b"), "item_id").alias("id"), F.length("text").cast("long").alias("length")))
    keyed = hits.select(F.concat(F.lit("d"), "subject").alias("subject"), F.concat(F.lit("b"), "query").alias("query"))
    out = J.attach_two(keyed, dim, "id", "length", "subject", "query").filter("subject_length >= query_length")
    number = lambda c: F.substring(c, 2, 20).cast("long").alias(c)
    return out.select(number("subject"), number("query"), "subject_length", "query_length")


@R.query("""
with s as (select user_id, ts, lead(ts) over (partition by user_id order by ts) as nxt from events where event_type = 'signup'),
i as (select user_id, floor(epoch(ts))::bigint as a, floor(epoch(nxt))::bigint as b from s where nxt is not null),
p as (select user_id, floor(epoch(ts))::bigint as t0 from events where event_type = 'error')
select i.user_id, a, count(*) as n from i join p on p.user_id = i.user_id and t0 between a and b group by all
""")
def stab_join(spark, sf_dir):
    """Errors between a user's successive signups, by bins of a day."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    s = e.filter("event_type = 'signup'").selectExpr("user_id", "at as a", "lead(at) over (partition by user_id order by ts) as b").filter("b is not null")
    made = J.stab_join(s, e.filter("event_type = 'error'").select("user_id", "at"), "user_id", "a", "b", "at", width=86400)
    return made.groupBy("user_id", "a").agg(F.count("*").alias("n"))


@R.query("select distinct s_suppkey, c_custkey from supplier, customer where c_nationkey = s_nationkey or right(c_name, 3) = right(s_name, 3)")
def join_any_key(spark, sf_dir):
    """C11: customers and suppliers that agree in nation or in the end of their names."""
    c = table(spark, sf_dir, "customer").withColumn("c_end", F.right("c_name", F.lit(3)))
    s = table(spark, sf_dir, "supplier").withColumn("s_end", F.right("s_name", F.lit(3)))
    return J.join_any_key(c, s, [("c_nationkey", "s_nationkey"), ("c_end", "s_end")], ["s_suppkey", "c_custkey"])


@R.query("""
with w as (select p_partkey, unnest(string_split(p_name, ' ')) as word from part), m as (select unnest(string_split(p_name, ' ')) as word, p_type as target from part where p_size <= 3),
j as (select p_partkey, string_agg(distinct target, ';' order by target) as targets from w join m using (word) group by 1)
select p_partkey, coalesce(targets, '') as targets from part left join j using (p_partkey)
""")
def map_vocab(spark, sf_dir):
    """Words of part names mapped to the types of small parts that bear them."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", F.split("p_name", " ").alias("words"))
    vocabulary = p.filter("p_size <= 3").select(F.explode("words").alias("word"), F.col("p_type").alias("target")).distinct()
    return J.map_lists(p.select("p_partkey", "words"), "p_partkey", "words", vocabulary, "word", "target").select("p_partkey", F.array_join("target", ";").alias("targets"))


@R.query("""
with g as (select l_orderkey, list(distinct l_partkey) as parts from lineitem where l_returnflag = 'R' group by 1), e as (select l_orderkey, unnest(parts) as p_partkey from g)
select l_orderkey, string_agg(distinct p_brand, ';' order by p_brand) as brands from e join part using (p_partkey) group by 1
""")
def map_links(spark, sf_dir):
    """orders' part lists mapped to brands through a link table."""
    g = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    links = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    return J.map_lists(g, "l_orderkey", "parts", links, "p_partkey", "brand").select("l_orderkey", F.array_join("brand", ";").alias("brands"))


@R.query("""
with c as (select l_partkey as p_partkey, l_suppkey, 0 as p, -l_quantity as o from lineitem where l_returnflag = 'R' and l_quantity > 45
union all select l_partkey, l_suppkey, 1, l_discount from lineitem where l_returnflag = 'A' and l_discount < 0.02),
b as (select *, row_number() over (partition by p_partkey order by p, o, l_suppkey) as n from c)
select part.p_partkey, coalesce(b.l_suppkey, -1) as l_suppkey from part left join b on b.p_partkey = part.p_partkey and n = 1
""")
def priority_lookup(spark, sf_dir):
    """Each part's supplier by tiers."""
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    tiers = [(li.filter("l_returnflag = 'R' and l_quantity > 45"), -F.col("l_quantity")), (li.filter("l_returnflag = 'A' and l_discount < 0.02"), F.col("l_discount"))]
    return J.lookup_by_priority(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", tiers, "l_suppkey", -1)


@R.query("""
with m as (select o_custkey, o_orderkey from orders), v as (select o_custkey, l_extendedprice, l_quantity, rank() over (partition by o_custkey order by l_extendedprice desc, l_quantity desc) as r
from m join lineitem on l_orderkey = o_orderkey)
select o_custkey, round(avg(l_extendedprice), 4) as l_extendedprice, round(avg(l_quantity), 4) as l_quantity, count(*) as n_rows from v where r <= 3 group by 1
""")
def join_quant_top3(spark, sf_dir):
    """Means of a customer's three dearest lines, through lists of orders."""
    main = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("orders"))
    quant = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.struct("l_extendedprice", "l_quantity").alias("v"))
    joined = J.join_quant(main, "o_custkey", "orders", quant, "o", "v").filter("v is not null").select("o_custkey", "v.*")
    made = A.top_n_mean(joined, "o_custkey", ["l_extendedprice", "l_quantity"], 3)
    return made.select("o_custkey", F.round("l_extendedprice", 4).alias("l_extendedprice"), F.round("l_quantity", 4).alias("l_quantity"), "n_rows")


@R.query("""
with a as (select o_custkey, count(*) as n from orders where year(o_orderdate) = 1995 group by 1), b as (select o_custkey, count(*) as n from orders where year(o_orderdate) = 1996 group by 1)
select coalesce(a.o_custkey, b.o_custkey) as o_custkey, a.n as n_a, b.n as n_b from a full join b on a.o_custkey = b.o_custkey
""")
def compare_runs(spark, sf_dir):
    """customers' orders in two years side by side."""
    o = table(spark, sf_dir, "orders")
    year = lambda y: o.filter(F.year("o_orderdate") == y).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return J.compare_runs(year(1995), year(1996), "o_custkey", ["n"])


@R.query("""
with a as (select distinct o_custkey from orders where year(o_orderdate) = 1995), b as (select distinct o_custkey from orders where year(o_orderdate) = 1996)
select o_custkey, 'a' as side from a anti join b using (o_custkey) union all select o_custkey, 'b' from b anti join a using (o_custkey)
""")
def unique_to_each(spark, sf_dir):
    """customers with orders in one of two years only."""
    o = table(spark, sf_dir, "orders")
    return A.unique_to_each(o.filter(F.year("o_orderdate") == 1995), o.filter(F.year("o_orderdate") == 1996), "o_custkey")


@R.query("""
select c_custkey as node, coalesce(max(n_name), 'NA') as nation, coalesce(max(r_name), 'NA') as region from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1
""")
def lineage_pivot(spark, sf_dir):
    """Ancestors by rank in columns."""
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    up = c.select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("k")).join(n, F.col("k") == F.col("n_nationkey"))
    closed = up.select("node", F.concat(F.lit("n"), "n_nationkey").alias("anc")).unionByName(up.select("node", F.concat(F.lit("r"), "n_regionkey").alias("anc")))
    ranks = n.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.lit("nation").alias("rank"), F.col("n_name").alias("name")).unionByName(
        r.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("region").alias("rank"), F.col("r_name").alias("name"))
    )
    return J.lineage_ranks(closed, ranks, "node", "anc", "rank", "name", ["nation", "region"])


@R.query("""
with f as (select s_nationkey, min(s_suppkey) as fallback from supplier group by 1), l as (select l_orderkey, min(l_suppkey) as own from lineitem where l_returnflag = 'R' group by 1)
select o_orderkey, coalesce(own, fallback) as supplier, own is null as filled from orders join customer on o_custkey = c_custkey left join l on l_orderkey = o_orderkey left join f on s_nationkey = c_nationkey
""")
def attach_and_fill(spark, sf_dir):
    """orders' suppliers, filled from the customer's nation where a line gives none."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    own = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("own"))
    back = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("fallback"))
    out = o.join(own, "o_orderkey", "left").join(back, "c_nationkey", "left")
    return out.select("o_orderkey", F.coalesce("own", "fallback").alias("supplier"), F.col("own").isNull().alias("filled"))


@R.query("""
with a as (select l_orderkey, list(distinct l_returnflag) as x, list(distinct l_linestatus) as y from lineitem group by 1)
select u.x as flag, v.y as status, count(*) as n from a, unnest(a.x) as u(x), unnest(a.y) as v(y) group by all
""")
def list_by_list(spark, sf_dir):
    """C20: all pairs of an order's return flags and line states."""
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flag"), F.collect_set("l_linestatus").alias("status"))
    return J.cross_lists(a, "flag", "status").groupBy("flag", "status").agg(F.count("*").alias("n"))


@R.query("""
with a as (select l_returnflag as s, count(*) as n_lines from lineitem group by 1), b as (select l_returnflag as s, round(avg(l_quantity), 6) as mean from lineitem where l_linestatus = 'F' group by 1)
select s as l_returnflag, n_lines, mean from a join b using (s)
""")
def pair_by_source(spark, sf_dir):
    """Two aggregates paired by source."""
    li = table(spark, sf_dir, "lineitem")
    lines = li.groupBy("l_returnflag").agg(F.count("*").alias("n_lines"))
    means = li.filter("l_linestatus = 'F'").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean"))
    return J.pair_sources({"lines": lines, "means": means}, "l_returnflag")


@R.query("""
select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000) and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')
""")
def keep_and_drop(spark, sf_dir):
    """Customers with a large order and none pending."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    has = lambda cond: o.filter(cond).select(F.col("o_custkey").alias("c_custkey"))
    return J.keep_in(c, "c_custkey", has("o_totalprice > 300000"), has("o_orderstatus = 'P'"))


@R.query("""
select a.doc_id from documents a where a.text is null or not exists (select 1 from documents b where b.doc_id <> a.doc_id and contains(b.text, a.text) and (length(b.text) > length(a.text) or b.doc_id < a.doc_id))
""")
def drop_contained(spark, sf_dir):
    """Documents that lie within no other."""
    return J.drop_contained(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", k=48).select("doc_id")


@R.query("""
select s_suppkey as id, s_name as name, s_acctbal as balance, 'base' as origin from supplier union all select c_custkey, c_name, null, 'customer' from customer where c_acctbal > 9000
""")
def attach_with_source(spark, sf_dir):
    """Tables of different columns stacked with their origin."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "s_name as name", "s_acctbal as balance")
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").selectExpr("c_custkey as id", "c_name as name")
    return J.attach_with_source(s, {"customer": c})


@R.query("""
with g as (select o_custkey from orders where o_totalprice > 350000 group by 1 having true), n as (select o_custkey from orders group by 1 having count(*) > 1)
select o_orderkey from orders where o_custkey in (select o_custkey from g) and o_custkey in (select o_custkey from n) and o_totalprice <= 350000
""")
def label_from_group(spark, sf_dir):
    """Small orders of customers that have several orders and a large one."""
    return J.associated(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_totalprice") > 350000).select("o_orderkey")


@R.query("""
select event_id, user_id, event_type, coalesce(nullif(props, ''), '{}') as props, cast(json_extract_string(props, '$.k') as bigint) as k from events
""")
def flatten_json(spark, sf_dir):
    """A field out of JSON payloads (see flatten_xrefs for A7)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", F.coalesce(F.nullif("props", F.lit("")), F.lit("{}")).alias("props"), F.from_json("props", "k long")["k"].alias("k"))


@R.query("""
with d as (select *, row_number() over (partition by l_orderkey, l_returnflag order by l_extendedprice desc, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_quantity, l_discount, l_tax, l_linestatus) as n from lineitem)
select l_orderkey, l_returnflag, l_partkey, l_extendedprice from d where n = 1
""")
def keep_first(spark, sf_dir):
    """The dearest line of each order and flag."""
    order = [F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_linestatus"]
    return dedup(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], order).select("l_orderkey", "l_returnflag", "l_partkey", "l_extendedprice")


QUERIES, ORACLES = R.queries, R.oracles
