"""Aggregations and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import aggregate as A
from evidentia.operators import windows as E
from evidentia.plans.registry import Registry, table

R = Registry()
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def user_days(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


@R.query("select o_custkey, string_agg(distinct o_orderpriority, ';' order by o_orderpriority) as o_orderpriority, string_agg(distinct o_orderstatus, ';' order by o_orderstatus) as o_orderstatus from orders group by 1")
def collapse_lists(spark, sf_dir):
    """customers' distinct priorities and states."""
    return A.collapse(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderpriority", "o_orderstatus"])


@R.query("""
with u as (select user_id, strftime(ts, '%Y-%m-%d') as day, avg(value) as mean, string_agg(distinct event_type, ';' order by event_type) as types, bool_or(event_type = 'purchase') as bought from events group by all)
select 'U' || (row_number() over (order by day, user_id) - 1) as id, user_id, day, round(mean, 6) as mean, types from u where not bought
""")
def unmatched_aggregate(spark, sf_dir):
    """Days of users without a purchase, numbered."""
    e = user_days(spark, sf_dir)
    bought = e.filter("event_type = 'purchase'").select("user_id", "day").distinct()
    keyed = e.join(bought, ["user_id", "day"], "left_anti").withColumn("key", F.concat_ws("|", "day", F.lpad(F.col("user_id").cast("string"), 12, "0")))
    made = A.aggregate_unmatched(keyed, "key", "event_type", ["value"])
    made = made.select(F.split("key", r"\|")[0].alias("day"), F.split("key", r"\|")[1].cast("long").alias("user_id"), F.round("value", 6).alias("mean"), F.col("event_type").alias("types"))
    return A.assign_ids(made, "U", ["day", "user_id"], "id")


@R.query("""
with m as (select l_partkey, l_linestatus, l_returnflag, median(v) as v from (select distinct l_partkey, l_linestatus, l_returnflag, l_extendedprice as v from lineitem) group by all)
select l_partkey, coalesce(round(median(v) filter (l_linestatus = 'F'), 4), 0) as "F", coalesce(round(median(v) filter (l_linestatus = 'O'), 4), 0) as "O" from m group by 1
""")
def ion_matrix(spark, sf_dir):
    """Median of distinct prices by part and state, over return flags."""
    made = A.ion_matrix(table(spark, sf_dir, "lineitem"), "l_partkey", "l_linestatus", "l_returnflag", "l_extendedprice", ["F", "O"])
    return made.select("l_partkey", F.round("F", 4).alias("F"), F.round("O", 4).alias("O"))


@R.query("""
with l as (select o_orderkey, unnest(string_split(g.flags, ';')) as flag, o_totalprice from orders join (select l_orderkey, string_agg(distinct l_returnflag || l_linestatus, ';') as flags from lineitem group by 1) g on l_orderkey = o_orderkey)
select flag, round(median(o_totalprice), 4) as x_o_totalprice from l group by 1
""")
def median_by_member(spark, sf_dir):
    """Median order price of each flag in delimited lists."""
    lists = A.collapse(table(spark, sf_dir, "lineitem").withColumn("flag", F.concat("l_returnflag", "l_linestatus")), ["l_orderkey"], ["flag"])
    o = lists.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return A.median_by_member(o, "flag", ["o_totalprice"], "x_").withColumn("x_o_totalprice", F.round("x_o_totalprice", 4))


@R.query("""
with s as (select o_custkey, string_agg(distinct o_orderpriority, ';' order by o_orderpriority) as s from orders group by 1)
select o_custkey, min(o_custkey) over (partition by s) as group_id, count(*) over (partition by s) as n_members from s
""")
def group_by_set(spark, sf_dir):
    """Customers with the same set of priorities."""
    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return A.group_by_set(sets, "o_custkey", "p").select("o_custkey", "group_id", "n_members")


@R.query("""
select p_brand, count(*) as size, count(distinct p_type) as n_p_type, count(distinct p_size) as n_p_size, round(avg(p_retailprice), 4) as mean_price, round(median(p_retailprice), 6) as median_price from part group by 1
""")
def group_profile(spark, sf_dir):
    """Profiles of brands."""
    made = A.group_profile(table(spark, sf_dir, "part"), "p_brand", ["p_type", "p_size"], ["p_retailprice"])
    return made.select("p_brand", "size", "n_p_type", "n_p_size", F.round("mean_p_retailprice", 4).alias("mean_price"), F.round("median_p_retailprice", 6).alias("median_price"))


@R.query("with t as (select doc_id, unnest(list_distinct(string_split_regex(lower(text), '\\s+'))) as token from documents) select token, count(*) as n from t where token <> '' group by 1")
def split_and_count(spark, sf_dir):
    """Documents by word."""
    return A.split_and_count(table(spark, sf_dir, "documents"), F.split(F.lower("text"), r"\s+"), "token", per_row=True).filter("token <> ''")


@R.query("""
with e as (select event_id, case when event_type = 'view' then null else value end as value, case when user_id % 7 = 0 then null else props end as props from events)
select 'event_id' as "column", count(event_id) / count(*) * 100 as percent from e union all select 'value', count(value) / count(*) * 100 from e union all select 'props', count(props) / count(*) * 100 from e
""")
def percent_present(spark, sf_dir):
    """Completeness of columns with nulls put in by rule."""
    e = table(spark, sf_dir, "events")
    return A.percent_present(e.select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value"), F.when(F.col("user_id") % 7 != 0, F.col("props")).alias("props")))


@R.query("""
select doc_id, len(regexp_extract_all(text, 'tion'))::bigint as n_tion, len(regexp_extract_all(text, '[0-9]+'))::bigint as n_number, len(regexp_extract_all(text, '\\b[A-Z][a-z]+'))::bigint as n_capital from documents
""")
def pattern_counts(spark, sf_dir):
    """Occurrences of named patterns in documents."""
    return A.count_patterns(table(spark, sf_dir, "documents"), "doc_id", "text", {"n_tion": "tion", "n_number": "[0-9]+", "n_capital": r"\b[A-Z][a-z]+"})


@R.query("select user_id, " + ", ".join(f"count(*) filter (event_type = '{t}') as {t}" for t in EVENT_TYPES) + " from events group by 1")
def source_count_pivot(spark, sf_dir):
    """users' events by type, zero-filled."""
    return A.count_pivot(table(spark, sf_dir, "events"), "user_id", "event_type", EVENT_TYPES)


@R.query("select user_id, strftime(ts, '%Y-%m-%d') as day, " + ", ".join(f"max((event_type = '{t}')::int) as {t}" for t in EVENT_TYPES) + " from events group by all")
def incidence(spark, sf_dir):
    """Which types a user's day has, as 0/1."""
    keyed = user_days(spark, sf_dir).withColumn("key", F.struct("user_id", "day"))
    return A.incidence(keyed, "key", "event_type", EVENT_TYPES).select("key.*", *EVENT_TYPES)


@R.query("""
select l_linestatus, count(*) as n_lines, count(distinct l_orderkey) as n_orders, count(*) filter (l_discount <= 0.05) as n_below, count(distinct case when l_discount <= 0.05 then l_partkey end) as n_parts_below,
count(*) filter (l_returnflag = 'R') as n_r from lineitem group by 1
""")
def conditional_counts(spark, sf_dir):
    """Conditional counts by state."""
    ok = F.col("l_discount") <= 0.05
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        F.count("*").alias("n_lines"), F.count_distinct("l_orderkey").alias("n_orders"), F.count_if(ok).alias("n_below"),
        F.count_distinct(F.when(ok, F.col("l_partkey"))).alias("n_parts_below"), F.count_if(F.col("l_returnflag") == "R").alias("n_r"),
    )


@R.query("""
with n as (select l_orderkey, l_linenumber, count(*) as n, sum((l_returnflag = 'R')::int) as c from lineitem group by all)
select l_orderkey, sum(n)::bigint as n_mismatches, sum(case when n > 1 then n else 0 end) / 2 as n_disagreements, sum(c)::bigint as conservative, (sum(n) - sum(c))::bigint as non_conservative,
round(sum(c) / nullif(sum(n) - sum(c), 0), 9) as ratio from n group by 1
""")
def aggregate_mismatches(spark, sf_dir):
    """Repeated places and two kinds of rows by order."""
    li = table(spark, sf_dir, "lineitem").withColumn("c", (F.col("l_returnflag") == "R").cast("int"))
    return A.aggregate_mismatches(li, "l_orderkey", "l_linenumber", "c").withColumn("ratio", F.round("ratio", 9))


@R.query("""
with n as (select p_type, p_brand, count(*) as n from part group by all), t as (select p_brand, count(*) as total from part group by 1),
s as (select p_type, p_brand, n / total as share, row_number() over (partition by p_type order by n / total desc, p_brand) as r from n join t using (p_brand))
select p_type, p_brand, round(share, 9) as share from s where r = 1
""")
def dominant_label(spark, sf_dir):
    """The brand that each type is strongest in."""
    return A.dominant_label(table(spark, sf_dir, "part"), "p_type", "p_brand").withColumn("share", F.round("share", 9))


@R.query("with s as (select user_id, strftime(ts, '%Y-%m-%d') as day, string_agg(distinct event_type, '&' order by event_type) as sources from events group by all) select sources, count(*) as n_keys from s group by 1")
def overlap_partition(spark, sf_dir):
    """Days of users by their exact set of types."""
    return A.overlap_partition(user_days(spark, sf_dir), ["user_id", "day"], "event_type")


@R.query("select l_partkey from lineitem group by 1 having count(distinct l_returnflag) = 3")
def common_keys(spark, sf_dir):
    """parts that all return flags have."""
    return A.common_keys(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag", 3)


@R.query("""
with o as (select o_custkey, min(r_name) as r_name, sum(o_totalprice) as v from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1)
select r_name, count(*) as n_groups, 0::bigint as n_mixed, round(count(*) / sum(count(*)) over (), 9) as count_share, round(sum(v) / sum(sum(v)) over (), 9) as value_share from o group by 1
""")
def composition(spark, sf_dir):
    """regions' shares of customers and of revenue."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    made = A.composition(table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")), "o_custkey", "r_name", "o_totalprice")
    return made.withColumns({x: F.round(x, 9) for x in ("count_share", "value_share")})


@R.query("""
with p as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[^aeiou]*[aeiou]+'))) as piece from documents),
a as (select doc_id, count(*) as observable from p where length(piece) between 3 and 8 group by 1), b as (select doc_id, count(*) as observed from p where length(piece) = 3 group by 1)
select doc_id, observable, observed, round(power(10.0, observed / observable) - 1, 6) as empai from a join b using (doc_id)
""")
def digest_counts(spark, sf_dir):
    """Pieces of documents in a range of lengths, and the exponential of their ratio."""
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[^aeiou]*[aeiou]+"), F.lit(0)))).alias("p"))
    made = pieces.groupBy("doc_id").agg(F.count_if(F.length("p").between(3, 8)).alias("observable"), F.count_if(F.length("p") == 3).alias("observed"))
    return made.filter("observable > 0 and observed > 0").withColumn("empai", F.round(F.pow(F.lit(10.0), F.col("observed") / F.col("observable")) - 1, 6))


@R.query("""
with n as (select user_id, strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by all)
select user_id, day, event_type, n from (select *, row_number() over (partition by user_id, day order by n desc, event_type) as r from n) where r = 1
""")
def mode_per_key(spark, sf_dir):
    """The commonest type of a user's day."""
    return A.mode_per_key(user_days(spark, sf_dir), ["user_id", "day"], "event_type")


@R.query("""
with l as (select 'l_returnflag' as rank, l_returnflag as name from lineitem union all select 'l_linestatus', l_linestatus from lineitem)
select rank, name, count(*) as n, round(count(*) * 100 / sum(count(*)) over (partition by rank), 9) as percent from l group by rank, name
""")
def reshape_share(spark, sf_dir):
    """Flags in long form with their shares."""
    return A.rank_share(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]).withColumn("percent", F.round("percent", 9))


@R.query("select o_custkey, count(*) as size, count(distinct o_orderpriority) as n_evidence from orders group by 1")
def list_and_group_basics(spark, sf_dir):
    """Delimited lists taken apart, and consistency of priorities by customer."""
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list("o_orderpriority"), ";").alias("p"))
    return A.group_consistency(A.explode_list(lists, "p"), "o_custkey", "p")


@R.query("""
with k as (select p_brand, p_type, count(*) over (partition by p_brand, p_type) as n, p_retailprice from part), f as (select * from k where n >= 10)
select p_brand, metric, round(avg(v), 6) as mean, round(stddev(v), 6) as sd from (select p_brand, 'p_retailprice' as metric, p_retailprice as v from f union all select p_brand, 'n', n from f) group by all
""")
def summarise_groups(spark, sf_dir):
    """Means and deviations of brands over types of ten parts at least."""
    p = table(spark, sf_dir, "part").withColumn("key", F.concat_ws("|", "p_brand", "p_type"))
    kept = A.groups_min_size(p, "key", 10)
    kept = kept.join(kept.groupBy("key").agg(F.count("*").alias("n")), "key")
    return A.summarise(kept, ["p_retailprice", "n"], "p_brand").withColumns({c: F.round(c, 6) for c in ("mean", "sd")})


@R.query("""
with s as (select l_partkey, max(l_extendedprice) as v from lineitem group by 1), g as (select distinct l_orderkey, l_partkey from lineitem)
select l_orderkey, count(*) as n_items, round(max(v), 4) as max_score from g join s using (l_partkey) group by 1
""")
def count_and_max(spark, sf_dir):
    """Distinct parts of an order and the highest price any of them reached."""
    li = table(spark, sf_dir, "lineitem")
    lists = li.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("p"))
    made = A.count_and_max(lists, "l_orderkey", "p", li.groupBy("l_partkey").agg(F.max("l_extendedprice").alias("v")), "l_partkey", "v")
    return made.withColumn("max_score", F.round("max_score", 4))


@R.query("select c_nationkey as nation from customer where c_acctbal > 9500 union select s_nationkey from supplier where s_acctbal > 9500")
def union_distinct(spark, sf_dir):
    """nations of rich customers or suppliers."""
    return A.union_distinct(table(spark, sf_dir, "customer").filter("c_acctbal > 9500").selectExpr("c_nationkey as nation"), table(spark, sf_dir, "supplier").filter("s_acctbal > 9500").selectExpr("s_nationkey as nation"))


# profiles of up to three samples have a closed form: with all three ratios each level is the mean of its own two, with two they fit exactly
_LFQ = """
r as (select p, median(ln_a - ln_n) filter (ln_a is not null and ln_n is not null) as an, median(ln_a - ln_r) filter (ln_a is not null and ln_r is not null) as ar, median(ln_n - ln_r) filter (ln_n is not null and ln_r is not null) as nr,
      sum(a) as sa, sum(n) as sn, sum(r) as sr from (select *, log2(a) as ln_a, log2(n) as ln_n, log2(r) as ln_r from w) group by p),
x as (select *, case when an is not null and ar is not null and nr is not null then (an + ar) / 3 when an is not null or ar is not null then 0 end as xa,
      case when an is not null and ar is not null and nr is not null then (nr - an) / 3 when an is not null then -an when ar is not null and nr is not null then nr - ar when nr is not null then 0 end as xn,
      case when an is not null and ar is not null and nr is not null then (-ar - nr) / 3 when ar is not null then -ar when an is not null and nr is not null then -nr - an when nr is not null then -nr end as xr from r),
l as (select p, 'A' as s, coalesce(xa, 0) as x, sa as v, 'A' as c from x where sa is not null
      union all select p, 'N', coalesce(xn, 0), sn, case when an is not null or (ar is not null and nr is not null) then 'A' else 'N' end from x where sn is not null
      union all select p, 'R', coalesce(xr, 0), sr, case when ar is not null or (an is not null and nr is not null) then 'A' when nr is not null then 'N' else 'R' end from x where sr is not null)
select p as {p}, s as l_returnflag, c as component, round(2 ** x / sum(2 ** x) over (partition by p, c) * sum(v) over (partition by p, c), 3) as lfq from l"""


@R.query("""with c as (select p_brand as p, l_partkey as i, l_returnflag as s, sum(l_extendedprice)::double as v from lineitem join part on l_partkey = p_partkey group by all),
w as (select p, i, max(v) filter (s = 'A') as a, max(v) filter (s = 'N') as n, max(v) filter (s = 'R') as r from c group by all),""" + _LFQ.format(p="p_brand"))
def maxlfq(spark, sf_dir):
    """Profiles of brands over return flags from parts' revenues."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return A.maxlfq(li, "p_brand", "l_partkey", "l_returnflag", "l_extendedprice").withColumn("lfq", F.round("lfq", 3))


@R.query("""with b as (select l_partkey as p, l_suppkey as i, l_returnflag as s, l_quantity::double as q from lineitem), m as (select s, median(log2(q)) as m from b group by s), t as (select s, 2 ** ((select avg(m) from m) - m) as f from m),
c as (select p, i, s, sum(q * f) as v from b join t using (s) group by all), w as (select p, i, max(v) filter (s = 'A') as a, max(v) filter (s = 'N') as n, max(v) filter (s = 'R') as r from c group by all),""" + _LFQ.format(p="l_partkey"))
def maxlfq_components(spark, sf_dir):
    """Profiles of parts from suppliers' quantities, normalised between flags; flags without a common supplier are components of their own."""
    li = A.normalise_medians(table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("double")), "l_returnflag", "q")
    return A.maxlfq(li, "l_partkey", "l_suppkey", "l_returnflag", "q").withColumn("lfq", F.round("lfq", 3))


_FULL = ["l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_linestatus"]


@R.query("""
with l as (select *, row_number() over (partition by l_returnflag, l_orderkey order by l_extendedprice, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_quantity, l_discount, l_tax, l_linestatus) as n,
greatest(0.001, least(0.999, l_discount)) as p, l_tax > 0.06 as d from lineitem),
k as (select l_orderkey, string_agg(l_returnflag, '&' order by l_returnflag) as combination, product(p) as p, product(1 - p) as q, max(d::int) as decoy from l where n = 1 group by 1),
b as (select l_orderkey, combination, decoy, round(p / (p + q), 12) as bayes_pep, count(*) over (partition by combination) as size from k)
select l_orderkey, combination, decoy, bayes_pep, round(case when size // 5 > 251
then least(2 * sum(decoy) over w125, count(*) over w125) / count(*) over w125 else least(2 * sum(decoy) over w25, count(*) over w25) / count(*) over w25 end, 9) as combined_pep
from b window w125 as (partition by combination order by bayes_pep, l_orderkey rows between 125 preceding and 125 following), w25 as (partition by combination order by bayes_pep, l_orderkey rows between 25 preceding and 25 following)
""")
def combined_pep(spark, sf_dir):
    """Combined error probabilities of orders reported under several return flags."""
    li = table(spark, sf_dir, "lineitem").withColumn("pep", F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("l_discount")))).withColumn("decoy_row", F.col("l_tax") > 0.06)
    return E.combined_pep(li, "l_orderkey", "l_returnflag", "pep", "decoy_row", _FULL).withColumn("combined_pep", F.round("combined_pep", 9))


@R.query("""
with q as (select quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.75) as q3 from orders)
select o_orderkey, case when o_totalprice <= q1 then 'first' when o_totalprice >= q3 then 'third' else 'second' end as class from orders, q
""")
def quantile_class(spark, sf_dir):
    """E5: orders by quartile of their price."""
    return E.quantile_class(table(spark, sf_dir, "orders"), "o_totalprice").select("o_orderkey", "class")


@R.query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_k(spark, sf_dir):
    """The 25 dearest orders (a top-k report)."""
    return E.top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 25)


@R.query("""
with p as (select p_brand, p_partkey, (p_partkey * 37 % 1000 + 1) / 100000 as p from part), s as (select *, (count(*) over (partition by p_brand) - row_number() over (partition by p_brand order by p, p_partkey) + 1) * p as s from p)
select p_brand, p_partkey, round(p, 9) as p, round(least(1, max(s) over (partition by p_brand order by p, p_partkey rows unbounded preceding)), 9) as p_holm from s
""")
def holm(spark, sf_dir):
    """Holm's adjustment within brands."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", ((F.col("p_partkey") * 37 % 1000 + 1) / 100000).alias("p"))
    return E.p_adjust(p, "p", ["p_brand"], ["p_partkey"]).withColumns({c: F.round(c, 9) for c in ("p", "p_holm")})


@R.query("select p_partkey, p_brand, round((p_retailprice - min(p_retailprice) over (partition by p_brand)) / (max(p_retailprice) over (partition by p_brand) - min(p_retailprice) over (partition by p_brand)), 9) as scaled from part")
def min_max_scale(spark, sf_dir):
    """Prices scaled within brands."""
    return E.min_max(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand"]).select("p_partkey", "p_brand", F.round("p_retailprice_scaled", 9).alias("scaled"))


QUERIES, ORACLES = R.queries, R.oracles
