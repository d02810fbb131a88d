"""Statistics and text over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions.scalars import first_match
from evidentia.operators import aggregate as A
from evidentia.operators import enrichment as N
from evidentia.operators import graph as I
from evidentia.operators import stats as K
from evidentia.operators import text as L
from evidentia.plans.registry import Registry, table

R = Registry()

_RANKS = """r as (select g, v, count(*) over (partition by v) as t, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2 as r from d)"""


@R.query(f"""with d as (select o_orderstatus as g, o_totalprice as v from orders where o_orderstatus in ('F', 'O')), {_RANKS},
s as (select sum(r) filter (g = 'F') as ra, (count(*) filter (g = 'F'))::double as na, (count(*) filter (g = 'O'))::double as nb, sum(t * t - 1) as t from r)
select 'F' as a, 'O' as b, na::bigint as n_a, nb::bigint as n_b, round(ra - na * (na + 1) / 2, 3) as u, round((ra - na * (na + 1) / 2 - na * nb / 2) / sqrt(na * nb / 12 * ((na + nb + 1) - t / ((na + nb) * (na + nb - 1)))), 6) as z from s""")
def rank_sum(spark, sf_dir):
    """K1: prices of finished and open orders."""
    made = K.rank_sum(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus", "F", "O")
    return made.select("a", "b", "n_a", "n_b", F.round("u", 3).alias("u"), F.round("z", 6).alias("z"))


@R.query("""with d as (select l_orderkey as k, l_returnflag = 'A' as g, l_extendedprice as v, row_number() over (partition by l_orderkey order by l_extendedprice) as r, count(*) over (partition by l_orderkey) as n,
count(*) over (partition by l_orderkey, l_extendedprice) as t from lineitem where l_returnflag in ('A', 'R')), s as (select k, count(*) filter (g) as na, count(*) filter (not g) as nb, sum(case when g then r else 0 end) as ra, any_value(n) as n from d group by 1 having max(t) = 1 and bool_or(g) and bool_or(not g)),
m as (select k, na, nb, ra - na * (na + 1) / 2 as u, unnest(range(0, 1 << n)) as mask, n from s), x as (select k, na, nb, u, list_sum([case when mask & (1 << (i - 1)) > 0 then i else 0 end for i in range(1, n + 1)]) - na * (na + 1) / 2 as other from m where bit_count(mask) = na)
select k as l_orderkey, na as n_a, nb as n_b, round(u, 3) as u, round(least(1, 2 * least(avg((other >= u)::int), avg((other <= u)::int))), 9) as p, round(avg((other >= u)::int), 9) as p_greater, round(avg((other <= u)::int), 9) as p_less from x group by all""")
def rank_sum_by_order(spark, sf_dir):
    """K1: within each order, prices of accepted and returned lines; exact p-values (orders without ties)."""
    made = K.with_p(K.rank_sum(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag", "A", "R", by=["l_orderkey"]))
    whole = made.filter("n_a > 0 and n_b > 0 and not tied")
    return whole.select("l_orderkey", "n_a", "n_b", F.round("u", 3).alias("u"), *[F.round(c, 9).alias(c) for c in ("p", "p_greater", "p_less")])


@R.query("""with p as (select l_orderkey, avg(case when l_linestatus = 'F' then l_quantity end) as a, avg(case when l_linestatus = 'O' then l_quantity end) as b from lineitem group by 1), x as (select a - b as d from p where a - b <> 0),
r as (select d, count(*) over (partition by abs(d)) as t, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2 as r from x), s as (select count(*)::double as n, sum(case when d > 0 then r else 0 end) as w, sum(t * t - 1) as t from r)
select n::bigint as n, round(w, 3) as w, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48), 6) as z from s""")
def signed_rank(spark, sf_dir):
    """K2: quantities of closed and open lines within orders."""
    mean = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_quantity")))
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(mean("F").alias("a"), mean("O").alias("b"))
    return K.signed_rank(p, "a", "b").select("n", F.round("w", 3).alias("w"), F.round("z", 6).alias("z"))


@R.query(f"""with d as (select event_type as g, value as v from events), {_RANKS}, q as (select g, sum(r) as r, count(*)::double as n, sum(t * t - 1) as t from r group by 1),
s as (select sum(r * r / n) as q, sum(n) as n, sum(t) as t, count(*) - 1 as df from q)
select n::bigint as n, df, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 6) as h from s""")
def kruskal(spark, sf_dir):
    """K3: values of events by type."""
    return K.kruskal(table(spark, sf_dir, "events"), "value", "event_type").withColumn("h", F.round("h", 6))


@R.query("select round(corr(l_quantity, l_extendedprice), 9) as r, count(*) as n, round(corr(l_quantity, l_extendedprice) * sqrt((count(*) - 2) / (1 - corr(l_quantity, l_extendedprice) ** 2)), 4) as t from lineitem")
def correlation(spark, sf_dir):
    """K4: quantity and price of lines."""
    return K.cor_test(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").drop("p").withColumns({"r": F.round("r", 9), "t": F.round("t", 4)})


@R.query("""with c as (select value, sum((event_type = 'view')::int) as a, sum((event_type = 'click')::int) as b from events where event_type in ('view', 'click') group by 1),
d as (select sum(a) over (order by value) / sum(a) over () - sum(b) over (order by value) / sum(b) over () as d from c),
m as (select max(abs(d)) as d, (select sum(a) * sum(b) / (sum(a) + sum(b)) from c) as e from d), k as (select sum((case when i % 2 = 1 then 2 else -2 end) * exp(-2.0 * i * i * e * d * d)) as p from m, range(1, 101) as r(i))
select 'view' as a, 'click' as b, round(d, 9) as d, round(case when e * d * d < 0.01 then 1 else greatest(0, least(1, p)) end, 6) as p from m, k""")
def ks(spark, sf_dir):
    """K5: distributions of views' and clicks' values."""
    return K.ks2(table(spark, sf_dir, "events"), "value", "event_type", "view", "click").select("a", "b", F.round("d", 9).alias("d"), F.round("p", 6).alias("p"))


@R.query("""with n as (select p_type, p_brand, count(*) as n from part group by all), a as (select p_type, count(*) as n_a from part group by 1), b as (select p_brand, count(*) as n_b from part group by 1),
g as (select p_type, p_brand, coalesce(n, 0) as n, n_a, n_b, (select count(*) from part) as total from a cross join b left join n using (p_type, p_brand)),
c as (select *, n::double as x, (n_a - n)::double as y, (n_b - n)::double as z, (total - n_a - n_b + n)::double as w from g)
select p_type, p_brand, n, round(n_a * n_b / total, 6) as expected,
round(total * greatest(0, abs(x * w - y * z) - total / 2) ** 2 / (n_a * (total - n_a) * n_b::double * (total - n_b)), 6) as chi2, round(case when x * y * z * w = 0 then null else x * w / (y * z) end, 6) as odds_ratio,
round(case when x * y * z * w = 0 then null else exp(ln(x * w / (y * z)) - 1.96 * sqrt(1 / x + 1 / y + 1 / z + 1 / w)) end, 6) as ci_low, round(case when x * y * z * w = 0 then null else exp(ln(x * w / (y * z)) + 1.96 * sqrt(1 / x + 1 / y + 1 / z + 1 / w)) end, 6) as ci_high from c""")
def contingency_chi_or(spark, sf_dir):
    """Types by brands, one against the rest."""
    cells = K.one_vs_rest(A.contingency(table(spark, sf_dir, "part"), "p_type", "p_brand"))
    made = cells.withColumns({"chi2": K.chi_square(), **K.odds_ratio()})
    return made.select("p_type", "p_brand", "n", *[F.round(c, 6).alias(c) for c in ("expected", "chi2", "odds_ratio", "ci_low", "ci_high")])


_PAIRS = "('click', 'error'), ('click', 'purchase'), ('click', 'signup'), ('click', 'view'), ('error', 'purchase'), ('error', 'signup'), ('error', 'view'), ('purchase', 'signup'), ('purchase', 'view'), ('signup', 'view')"


@R.query(f"""with f(a, b) as (values {_PAIRS}), d as (select a, b, event_type as g, value as v from events join f on event_type in (a, b)),
r as (select *, count(*) over (partition by a, b, v) as t, rank() over (partition by a, b order by v) + (count(*) over (partition by a, b, v) - 1) / 2 as r from d),
s as (select a, b, sum(r) filter (g = a) as ra, (count(*) filter (g = a))::double as na, (count(*) filter (g = b))::double as nb, sum(t * t - 1) as t from r group by 1, 2)
select a, b, round((ra - na * (na + 1) / 2 - na * nb / 2) / sqrt(na * nb / 12 * ((na + nb + 1) - t / ((na + nb) * (na + nb - 1)))), 6) as z from s""")
def pairwise_rank_sums(spark, sf_dir):
    """K8: rank-sum statistics of all pairs of event types; p-values and words are tested by themselves."""
    made = K.all_pairs(table(spark, sf_dir, "events"), "value", "event_type", ["click", "error", "purchase", "signup", "view"])
    return made.select("a", "b", F.round("z", 6).alias("z"))


# erf by its series of positive terms: P(|Z| >= z) = 1 - erf(z / sqrt 2)
_ERF = "(2 / sqrt(pi()) * list_sum([exp(k * ln(2) + (2 * k + 1) * ln(greatest({x}, 1e-300)) - lgamma(2 * k + 3) + (k + 1) * ln(2) + lgamma(k + 2) - {x} * {x}) for k in range(0, 200)]))"
_TWO, _ONE = _ERF.format(x="(abs(zc) / sqrt(2))"), _ERF.format(x="(abs(zg) / sqrt(2))")


@R.query(f"""with f(a, b) as (values {_PAIRS}), d as (select a, b, event_type as g, value as v from events join f on event_type in (a, b)),
r as (select *, count(*) over (partition by a, b, v) as t, rank() over (partition by a, b order by v) + (count(*) over (partition by a, b, v) - 1) / 2 as r from d),
s as (select a, b, sum(r) filter (g = a) as ra, (count(*) filter (g = a))::double as na, (count(*) filter (g = b))::double as nb, sum(t * t - 1) as t from r group by 1, 2),
z as (select a, b, ra - na * (na + 1) / 2 - na * nb / 2 as off, sqrt(na * nb / 12 * ((na + nb + 1) - t / ((na + nb) * (na + nb - 1)))) as sigma from s),
c as (select a, b, off / sigma as z, (off - sign(off) * 0.5) / sigma as zc, (off - 0.5) / sigma as zg from z),
p as (select a, b, z, greatest(0, 1 - {_TWO}) as p, (1 - sign(zg) * {_ONE}) / 2 as pg from c),
l as (select a, b, 'two sided' as kind, p from p union all select a, b, 'greater', pg from p),
h as (select a, b, kind, least(1, max(p * m) over (order by p, a, b, kind rows unbounded preceding)) as h from (select *, count(*) over () - row_number() over (order by p, a, b, kind) + 1 as m from l)),
w as (select a, b, max(h) filter (kind = 'two sided') as h, max(h) filter (kind = 'greater') as hg from h group by 1, 2)
select a, b, round(z, 6) as z, round(p, 7) as p, round(pg, 7) as p_greater, round(h, 7) as p_adjusted, round(hg, 7) as p_greater_adjusted,
case when h >= 0.05 then a || ' and ' || b || ' don''t differ' when hg < 0.05 then a || ' is greater than ' || b else b || ' is greater than ' || a end as conclusion from p join w using (a, b)""")
def all_pairs_tests(spark, sf_dir):
    """Rank-sum tests of all pairs of event types, two-sided before one-sided, adjusted, in words."""
    made = K.all_pairs(table(spark, sf_dir, "events"), "value", "event_type", ["click", "error", "purchase", "signup", "view"])
    told = K.conclude(K.with_p(made))
    return told.select("a", "b", F.round("z", 6).alias("z"), *[F.round(c, 7).alias(c) for c in ("p", "p_greater", "p_adjusted", "p_greater_adjusted")], "conclusion")


def _enriched(universe: str, members: str, terms: str) -> str:
    """SQL: hypergeometric tails of groups (g, e) and terms (e, term) within a universe (e), with Holm's adjustment."""
    return f"""with v as ({universe}), u as (select distinct g, e from ({members}) where e in (from v)), t as (select distinct e, term from ({terms}) where e in (from v)),
x as (select g, term, count(*) as n_both from u join t using (e) group by all), a as (select g, count(*) as n_group from u group by 1 having count(*) >= 10), b as (select term, count(*) as n_term from t group by 1),
c as (select x.*, n_group, n_term, (select count(*) from v) as n_universe from x join a using (g) join b using (term)),
k as (select *, unnest(range(n_both, least(n_group, n_term) + 1)) as i from c),
p as (select g, term, n_both, n_group, n_term, n_universe, least(1, sum(exp(lgamma(n_term + 1) - lgamma(i + 1) - lgamma(n_term - i + 1) + lgamma(n_universe - n_term + 1) - lgamma(n_group - i + 1) - lgamma(n_universe - n_term - n_group + i + 1)
- lgamma(n_universe + 1) + lgamma(n_group + 1) + lgamma(n_universe - n_group + 1)))) as p from k where i >= n_group + n_term - n_universe group by all),
h as (select *, least(1, max(p * m) over (order by p, g, term rows unbounded preceding)) as h from (select *, count(*) over () - row_number() over (order by p, g, term) + 1 as m from p))"""


@R.query(_enriched("select distinct p_partkey as e from part", "select p_brand as g, p_partkey as e from part", "select p_partkey as e, unnest(string_split(p_name, ' ')) as term from part")
+ " select g as p_brand, term, n_both, n_group, n_term, n_universe, round(p, 6) as p from h")
def enrich(spark, sf_dir):
    """K9: words of part names over-represented in brands."""
    p = table(spark, sf_dir, "part")
    terms = p.select("p_partkey", F.explode(F.split("p_name", " ")).alias("term"))
    return N.enrich(p, "p_brand", "p_partkey", terms, "term").drop("p_adjusted").withColumn("p", F.round("p", 6))


_LINEAGE = """with recursive up as (select p_partkey as node, p_partkey // 2 as ancestor from part where p_partkey > 1 union select node, ancestor // 2 from up where ancestor > 1)
select l_suppkey as e, l_partkey as term from lineitem where l_partkey % 7 <> 0 union select l_suppkey, ancestor from lineitem join up on node = l_partkey where l_partkey % 7 <> 0"""


@R.query(_enriched("select distinct s_suppkey as e from supplier where s_acctbal > 0", "select s_nationkey as g, s_suppkey as e from supplier", _LINEAGE)
+ " select g as s_nationkey, term, n_both, n_group, n_term, n_universe, round(p, 6) as p, round(h, 6) as p_adjusted from h")
def enrich_lineage(spark, sf_dir):
    """K9: parts, and all that stand above them in a tree, over-represented in nations' suppliers; a universe of its own, obsolete terms dropped."""
    s = table(spark, sf_dir, "supplier")
    terms = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("term"))
    part = table(spark, sf_dir, "part").select("p_partkey")
    closed = I.closure(part.filter("p_partkey > 1").withColumn("up", F.floor(F.col("p_partkey") / 2)), "p_partkey", "up")
    info = part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 7 == 0).alias("obsolete"))
    made = N.enrich(s, "s_nationkey", "s_suppkey", terms, "term", closed=closed, universe=s.filter("s_acctbal > 0"), info=info)
    return made.withColumns({c: F.round(c, 6) for c in ("p", "p_adjusted")})


@R.query("""with v as (select l_partkey, sum(l_extendedprice) as v from lineitem group by 1), r as (select l_partkey, v, row_number() over (order by v desc, l_partkey) as k, count(*) over () as n from v),
h as (select p_brand, v, k, n, row_number() over (partition by p_brand order by k) as i, count(*) over (partition by p_brand) as m from r join part on p_partkey = l_partkey),
w as (select p_brand, m, sum(v) over (partition by p_brand order by k rows unbounded preceding) / sum(v) over (partition by p_brand) - (k - i) / (n - m) as es from h) select p_brand, round(max(es), 6) as es, max(m) as n_members from w group by 1""")
def running_sum_es(spark, sf_dir):
    """brands' enrichment among parts ranked by revenue."""
    return N.running_sum_es(_revenues(spark, sf_dir), "p_partkey", "v", table(spark, sf_dir, "part"), "p_brand").withColumn("es", F.round("es", 6))


def _revenues(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_extendedprice").alias("v"))


_WALK = "select {by}, any_value(m) as m, max(up / total - (k - i) / (n - m)) as es from (select {by}, k, n, m, i, sum(v) over (partition by {by} order by k rows unbounded preceding) as up, sum(v) over (partition by {by}) as total from {source}) group by all"


@R.query(f"""with v as (select l_partkey as e, sum(l_extendedprice) as v from lineitem group by 1), r as (select e, v, row_number() over (order by v desc, e) as k, count(*) over () as n from v),
h as (select p_brand, v, k, n, row_number() over (partition by p_brand order by k) as i, count(*) over (partition by p_brand) as m from r join part on p_partkey = e), w as ({_WALK.format(by="p_brand", source="h")}),
x as (select e, v, k, n, rep, row_number() over (partition by rep order by md5('1:' || rep || ':' || e), e) as nth from r, range(1, 31) as g(rep)), z as (select distinct m from w),
f as (select rep, m, m as size, v, k, n, row_number() over (partition by rep, m order by k) as i from x join z on nth <= m), y as ({_WALK.format(by="rep, size", source="f")}),
c as (select p_brand, w.es, w.m, count(*) filter (round(y.es, 9) >= round(w.es, 9)) as b, avg(y.es) as mean from w join y on y.m = w.m group by 1, 2, 3), p as (select *, (b + 1) / 31.0::double as p from c),
q as (select *, count(*) over () * p / row_number() over (order by p, p_brand) as q from p)
select p_brand, round(es, 6) as es, round(es / mean, 6) as nes, m as n_members, b as n_beyond, round(p, 9) as p, round(least(1, min(q) over (order by p desc, p_brand desc rows unbounded preceding)), 9) as p_adjusted from q""")
def gsea(spark, sf_dir):
    """brands' enrichment against thirty seeded random sets of each size, adjusted."""
    made = N.gsea(_revenues(spark, sf_dir), "p_partkey", "v", table(spark, sf_dir, "part"), "p_brand", n_perm=30, few=0)
    return made.select("p_brand", F.round("es", 6).alias("es"), F.round("nes", 6).alias("nes"), "n_members", "n_beyond", F.round("p", 9).alias("p"), F.round("p_adjusted", 9).alias("p_adjusted"))


@R.query()
def gsea_small_p(spark, sf_dir):
    """The same with small p-values by multilevel splitting; sets are parts' sizes, one of which is made of the dearest parts."""
    part = table(spark, sf_dir, "part").withColumn("set", F.when(F.col("p_retailprice") > 1800, "dear").otherwise(F.concat(F.lit("size "), F.col("p_size").cast("string"))))
    priced = part.select("p_partkey", F.col("p_retailprice").alias("v"))
    return N.gsea(priced, "p_partkey", "v", part.select("set", "p_partkey"), "set", n_perm=200).withColumns({c: F.round(c, 9) for c in ("es", "nes", "p", "p_adjusted")})


@R.query("""with t as (select source, case when contains(lower(text), 'license') then ['license'] else string_split_regex(regexp_replace(lower(text), '[^\\p{L}\\s]', '', 'g'), '\\s+') end as w from documents),
c as (select source, unnest(w) as term from t), n as (select source, term, count(*) as n from c where length(term) >= 3 and term not in ('the', 'and') group by all)
select source, term, n, rank from (select *, row_number() over (partition by source order by n desc, term) as rank from n) where rank <= 10""")
def top_terms(spark, sf_dir):
    """L1: the ten commonest words of each source (a top-k report)."""
    made = L.top_terms(table(spark, sf_dir, "documents"), "source", F.col("text"), 10, keywords=["license"], stop=["the", "and"])
    return made.withColumn("rank", F.col("rank").cast("long"))


@R.query("""with c as (select case when event_type in ('view', 'click') then 'look' when event_type = 'purchase' then 'buy' else 'other' end as kind, event_type from events), n as (select kind, event_type, count(*) as n from c group by all)
select kind, sum(n)::bigint as n, count(*) as n_types from n group by 1""")
def keyword_category(spark, sf_dir):
    """Events by the first rule that their type matches."""
    e = table(spark, sf_dir, "events").withColumn("kind", first_match(F.col("event_type"), [("look", "^(view|click)$"), ("buy", "^purchase$")]))
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("n_types"))


@R.query("""with recursive e as (select distinct p_partkey as child, p_partkey // 2 as parent from part), l as (select 1::bigint as node, 0 as level union all select e.child, l.level + 1 from e join l on e.parent = l.node),
n as (select l_partkey as node, count(*) as n from lineitem group by 1), c as (select node, n, level from n join l using (node) where level between 3 and 7), b as (select quantile_cont(n, 0.8) as bar from c)
select node, n, level from c, b where n >= bar order by n desc, node limit 50""")
def term_cloud(spark, sf_dir):
    """L2: the fifty commonest parts within a range of levels (a top-k report)."""
    p = table(spark, sf_dir, "part")
    level = p.select(F.col("p_partkey").alias("node"), F.floor(F.log2("p_partkey") + 1e-9).cast("int").alias("level"))
    return L.term_cloud(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("term")), "term", level, 3, 7).withColumnRenamed("term", "node")


@R.query("""
with l as (select case when p_size > 40 then (p_size % 7 + 1)::bigint else p_partkey end as id from lineitem join part on l_partkey = p_partkey), c as (select id, count(*) as n from l group by 1),
e as (select c.n, lower(p_name) as t, p_name, p_type = 'SMALL' as own, p_name like '%small%' or p_name like '%red%' as size, p_name like '%bolt%' as bolt from c join part on id = p_partkey where floor(log2(p_partkey) + 1e-9) between 3 and 7),
x as (select 'size' as cloud, case when t like '%small%' then 'little' else 'coloured' end as type, t as token, n from e where own and size union all
select 'bolt', case when t like '%blue%' then 'blue' else 'plain' end, t, n from e where own and bolt union all select 'main', null, p_name, n from e where not (own and (size or bolt))),
k as (select cloud, token, max(type) as type, max(n) as n from x join (select cloud, quantile_cont(n, 0.8) as bar from x group by 1) using (cloud) where n > bar group by all)
select cloud, type, regexp_replace(token, '\\bsmall\\b', 'sm.', 'g') as token, n, rank from (select *, row_number() over (partition by cloud order by n desc, token) as rank from k) where rank <= 50""")
def term_clouds(spark, sf_dir):
    """L2: the fifty commonest names of parts (a top-k report) in typed clouds and the rest, after the parts of large sizes are rolled up."""
    p = table(spark, sf_dir, "part")
    info = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("namespace"))
    level = p.select(F.col("p_partkey").alias("node"), F.floor(F.log2("p_partkey") + 1e-9).cast("int").alias("level"))
    generic = p.filter("p_size > 40").select(F.col("p_partkey").alias("child"), (F.col("p_size") % 7 + 1).cast("long").alias("parent"))
    rolled = L.rolled_up(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("term")), "term", generic)
    clouds = {"size": ("small|red", [("little", "small")], "coloured"), "bolt": ("bolt", [("blue", "blue")], "plain")}
    made = L.term_clouds(rolled, "term", info, level, namespace="SMALL", clouds=clouds, words={"small": "sm."})
    return made.withColumn("rank", F.col("rank").cast("long"))


QUERIES, ORACLES = R.queries, R.oracles
