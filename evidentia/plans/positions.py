"""Intervals, sequences and target/decoy tables over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import scalars as S
from evidentia.operators import database as H
from evidentia.operators import sequence as G
from evidentia.operators import windows as E
from evidentia.plans.registry import Registry, table

R = Registry()
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def intervals(spark, sf_dir):
    """Events as half-open intervals of whole seconds: value minutes, one at least."""
    e = table(spark, sf_dir, "events").withColumn("a", F.unix_seconds(F.col("ts").cast("timestamp")))
    return e.withColumn("b", F.col("a") + F.greatest(F.lit(1).cast("long"), F.floor(F.col("value") * 60)))


_I = "with i as (select user_id, event_type, floor(epoch(ts))::bigint as a, floor(epoch(ts))::bigint + greatest(1, floor(value * 60)::bigint) as b from events)"


def _covered(source: str, keys: str, op: str = ">=") -> str:
    return f"""
o as (select *, case when max(b) over w is null or a {op} max(b) over w then 1 else 0 end as o from {source} window w as (partition by {keys} order by a, b rows between unbounded preceding and 1 preceding)),
g as (select *, sum(o) over (partition by {keys} order by a, b rows unbounded preceding) as island from o), r as (select {keys}, island, min(a) as a, max(b) as b from g group by {keys}, island)"""


@R.query(f"{_I}, {_covered('i', 'user_id')} select user_id, sum(b - a)::bigint as covered, count(*) as n_runs from r group by 1")
def interval_coverage(spark, sf_dir):
    """Seconds that a user's events cover."""
    return E.interval_coverage(intervals(spark, sf_dir), ["user_id"], "a", "b")


@R.query(f"""{_I}, {_covered('i', 'user_id, event_type')}, c as (select user_id, event_type, sum(b - a)::bigint as c from r group by all)
select user_id, """ + ", ".join(f"coalesce(sum(c) filter (event_type = '{t}'), 0)::bigint as {t}" for t in EVENT_TYPES) + ", max(total) as total from c join (" + f"{_I}, {_covered('i', 'user_id')} select user_id, sum(b - a)::bigint as total from r group by 1" + ") t using (user_id) group by user_id")
def coverage_by_source(spark, sf_dir):
    """Covered seconds by type of event, and in all."""
    return G.coverage_by_source(intervals(spark, sf_dir), "user_id", "event_type", EVENT_TYPES, "a", "b")


@R.query(f"""{_I}, x as (select i.user_id, t.left_out, event_type, a, b from i, (select distinct event_type as left_out from events) t), y as (select * from x where event_type <> left_out), {_covered('y', 'user_id, left_out')},
c as (select user_id, left_out, sum(b - a)::bigint as covered from r group by all) select distinct x.user_id, x.left_out, coalesce(covered, 0) as covered from x left join c on c.user_id = x.user_id and c.left_out = x.left_out""")
def coverage_without(spark, sf_dir):
    """Covered seconds without each type."""
    return G.coverage_without(intervals(spark, sf_dir), "user_id", "event_type", EVENT_TYPES, "a", "b")


@R.query(f"""{_I}, o as (select *, case when max(b) over w is null or a > max(b) over w then 1 else 0 end as o from i window w as (partition by user_id order by a, b rows between unbounded preceding and 1 preceding)),
g as (select *, sum(o) over (partition by user_id order by a, b rows unbounded preceding)::bigint as island from o), c as (select *, max((event_type = 'purchase')::int) over (partition by user_id, island) as best from g)
select user_id, island, min(a) as a, max(b) as b, count(*) as n, string_agg(distinct event_type, ';' order by event_type) as event_type from c where (event_type = 'purchase')::int = best group by user_id, island""")
def resolve_overlaps(spark, sf_dir):
    """Overlapping events, of which purchases alone count where there are any."""
    return E.resolve_overlaps(intervals(spark, sf_dir), ["user_id"], "a", "b", F.col("event_type") == "purchase", ["event_type"])


@R.query(f"""{_I}, o as (select *, case when max(b) over w is null or b > max(b) over w then 1 else 0 end as o from i window w as (partition by user_id order by a, b desc rows between unbounded preceding and 1 preceding)),
g as (select *, sum(o) over (partition by user_id order by a, b desc rows unbounded preceding)::bigint as host from o)
select user_id, host, min(a) as a, max(b) as b, count(*) as n, string_agg(distinct event_type, ';' order by event_type) as event_type from g group by user_id, host""")
def merge_contained(spark, sf_dir):
    """Events within others folded into them."""
    return E.merge_contained(intervals(spark, sf_dir), ["user_id"], "a", "b", ["event_type"])


@R.query("""
with p as (select item_id, text, unnest([substr(text, 11, 40), substr(text, 31, 40), substr(text, 1, 7), 'qqqq']) as part from benchmark),
h as (select item_id, unnest(list_filter(range(1, length(text) - length(part) + 2), lambda i: substr(text, i, length(part)) = part)) as a, length(part) as n from p where length(part) > 0),
c as (select item_id, count(distinct a + k) as c from h, range(0, 40) as r(k) where k < n group by 1)
select item_id, round(coalesce(c, 0) / length(text), 9) as coverage from benchmark left join c using (item_id)
""")
def exact_coverage(spark, sf_dir):
    """G1: share of a benchmark item that pieces of it cover."""
    b = table(spark, sf_dir, "benchmark")
    cut = lambda a, n: F.substring("text", a, n)
    parts = b.select("item_id", F.explode(F.array(cut(11, 40), cut(31, 40), cut(1, 7), F.lit("qqqq"))).alias("part"))
    return G.exact_coverage(b, "item_id", "text", parts, "part").withColumn("coverage", F.round("coverage", 9))


@R.query("""
with s as (select item_id, regexp_replace(text, '[^A-Za-z]+', '', 'g') as text from benchmark), p as (select item_id, text, unnest([substr(text, length(text) // 2 + 1, 25), substr(text, length(text) - 19), substr(text, length(text) // 2 + 11, 30), 'th']) as part from s),
h as (select item_id, unnest(list_filter(range(1, length(text) - length(part) + 2), lambda i: substr(text, i, length(part)) = part)) as a, length(part) as n from p where length(part) > 0),
c as (select item_id, count(distinct a + k) as c from h, range(0, 40) as r(k) where k < n group by 1)
select item_id, round(coalesce(c, 0) / nullif(length(text), 0), 9) as coverage from s left join c using (item_id)
""")
def coverage_of_letters(spark, sf_dir):
    """G1: share of a benchmark item's letters, all else stripped first, that pieces from its middle and end and a short part cover."""
    b = table(spark, sf_dir, "benchmark")
    letters = b.select("item_id", F.regexp_replace("text", "[^A-Za-z]+", "").alias("t")).withColumn("h", F.floor(F.length("t") / 2).cast("int"))
    cut = lambda a, n: F.substring(F.col("t"), a, F.lit(n))
    parts = letters.select("item_id", F.explode(F.array(cut(F.col("h") + 1, 25), cut(F.length("t") - 19, 20), cut(F.col("h") + 11, 30), F.lit("th"))).alias("part"))
    return G.exact_coverage(b, "item_id", "text", parts, "part", strip="[^A-Za-z]+").withColumn("coverage", F.round("coverage", 9))


def aligned_documents(spark, sf_dir):
    """Documents as upper-case sequences of letters and an edited copy: every 7th place changed, every 11th a gap."""
    d = table(spark, sf_dir, "documents").filter(F.col("text").rlike("([A-Za-z][^A-Za-z]*+){30}"))  # of 30 letters or more
    d = d.select("doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]+", "")).alias("seq"))
    before = F.pmod(-F.col("doc_id"), F.lit(7)).cast("int")  # letters before the first place changed
    changed = F.concat(F.left("seq", before), F.regexp_replace(F.substring("seq", before + 1, F.length("seq")), "[A-Z]([A-Z]{0,6})", "K$1"))
    return d.withColumn("aligned", F.regexp_replace(F.coalesce(changed, "seq"), "[A-Z]([A-Z]{0,10})", "-$1"))


_D = """with d as (select doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as seq from documents), p as (select doc_id, seq, unnest(range(0, length(seq))) as i from d where length(seq) >= 30),
t as (select doc_id, i, substr(seq, i + 1, 1) as s, case when i % 11 = 0 then '-' when (i + doc_id) % 7 = 0 then 'K' else substr(seq, i + 1, 1) end as t from p)"""


_CLASSES = "c(r, k) as (values " + ", ".join(f"('{r}', '{k}')" for r, k in G.RESIDUE_CLASS.items()) + ")"


@R.query(f"""{_D}, {_CLASSES}, x as (select doc_id, i, s || '->' || t as change, a.k || '->' || b.k as type, (a.k = b.k)::int as conservative from t left join c a on a.r = s left join c b on b.r = t where t <> '-' and t <> s)
select doc_id, change, type, conservative, count(*) as n, min(i) as first, max(i) as last from x group by all""")
def mismatches(spark, sf_dir):
    """Letters that an edited copy changes, with the change of their class."""
    made = G.mismatches(aligned_documents(spark, sf_dir), "doc_id", "seq", "aligned")
    return made.groupBy("doc_id", "change", "type", "conservative").agg(F.count("*").alias("n"), F.min("index").cast("long").alias("first"), F.max("index").cast("long").alias("last"))


@R.query(f"{_D} select doc_id, sum((t <> '-' and t <> s)::int)::int as n_mismatches, round(1 - sum((t = '-')::int) / count(*), 9) as coverage from t group by 1")
def alignment_metrics(spark, sf_dir):
    """Number of changed places and share without gaps."""
    return G.alignment_metrics(aligned_documents(spark, sf_dir), "doc_id", "seq", "aligned").withColumn("coverage", F.round("coverage", 9))


_B = """with raw as (select item_id, item_id // 4 as part, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as a from benchmark), b as (select item_id, part, a || repeat('-', (max(length(a)) over (partition by part) - length(a))::int) as a from raw),
p as (select item_id, part, a, unnest(range(1, length(a) + 1)) as i from b), t as (select item_id, part, i, substr(a, i, 1) as t from p)"""


def stacked_items(spark, sf_dir):
    """Benchmark items, four by four, as lines of letters and gaps as long as the longest of the four."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.floor(F.col("item_id") / 4).alias("part"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("a"))
    longest = b.groupBy("part").agg(F.max(F.length("a")).alias("n"))
    return b.join(longest, "part").select("item_id", "part", F.concat("a", F.repeat(F.lit("-"), F.col("n") - F.length("a"))).alias("a"))


@R.query(f"""{_B}, f as (select part, i, t, min(item_id) as f from t where t <> '-' group by all), w as (select distinct part, i from t), s as (select part, i, string_agg(t, '' order by f) as s from w left join f using (part, i) group by all)
select part, string_agg(case when s is null then '-' when length(s) = 1 then s else '[' || s || ']' end, '' order by i) as consensus from s group by 1""")
def consensus(spark, sf_dir):
    """Alternatives of stacked items place by place, in the order of the items."""
    return G.merge_alignments(stacked_items(spark, sf_dir), ["part"], "a", order="item_id")


@R.query(f"""{_B}, n as (select part, i, t, sum((t <> '-')::int) as n from t group by all), r as (select *, row_number() over (partition by part, i order by n desc, t) as r from n)
select part, string_agg(case when n > 0 then t else 'X' end, '' order by i) as consensus from r where r = 1 group by 1""")
def majority_consensus(spark, sf_dir):
    """The commonest letter of stacked items place by place."""
    return G.majority_consensus(stacked_items(spark, sf_dir), ["part"], "a")


@R.query("""
with d as (select doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as s from documents), t as (select doc_id, translate(s, 'XU', '') as s from d where length(s) >= 10),
b as (select doc_id, false as decoy, s from t union all select doc_id, true, reverse(s) from t)
select doc_id, decoy, length(s)::int as n, regexp_replace(s, '[BNDZQEJLI]', '?', 'g') as others from b
""")
def target_decoy(spark, sf_dir):
    """A target and a reversed decoy for each long enough document, letters that stand for two read as either."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))
    both = H.build_database([d], "doc_id", "seq")
    own = F.regexp_replace("doc_id", "rev_", "").cast("long")
    return both.select(own.alias("doc_id"), "decoy", F.length("seq").alias("n"), F.regexp_replace("seq", "[BNDZQEJLI]", "?").alias("others"))


@R.query("""
with d as (select doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BZJXU', '') as s, source from documents), t as (select * from d where length(s) >= 10),
b as (select doc_id::varchar as id, false as decoy, length(s) as n, source as header from t union all select 'rev_' || doc_id, true, length(s), 'rev_' || source from t)
select 'P' || (row_number() over (order by n desc, id) - 1) as entry, id, decoy, n::int as n, header, count(*) over (partition by decoy) as n_view from b
""")
def database_entries(spark, sf_dir):
    """The entries of a target/decoy table, with headers and the size of the view that each belongs to."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "BZJXU", "").alias("seq"), "source")
    entries = H.database_entries(H.build_database([d], "doc_id", "seq"), "doc_id", "seq", "source")
    views = H.database_views(entries, "seq")
    sizes = views["targets"].agg(F.count("*").alias("n_view")).withColumn("decoy", F.lit(False)).union(views["decoys"].agg(F.count("*").alias("n_view")).withColumn("decoy", F.lit(True)))
    return entries.join(F.broadcast(sizes), "decoy").select("entry", F.col("doc_id").alias("id"), "decoy", F.col("length").alias("n"), "header", "n_view")


@R.query("""
with d as (select doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as s from documents where length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 10)
select count(*) as n_targets, count(*) as n_decoys, true as kept_targets, true as real_decoys from d
""")
def balance_decoys(spark, sf_dir):
    """H2: identified entries with as many decoys as targets: all targets stay, and every decoy is some target reversed."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))
    both = H.build_database([d], "doc_id", "seq")
    found = both.filter("not decoy or crc32(doc_id) % 3 = 0").select("doc_id")
    made = H.balance_decoys(found, "doc_id", both, "seq")
    targets = both.filter("not decoy").select(F.xxhash64("seq").alias("h"), F.lit(1).alias("t")).distinct()
    checked = made.withColumn("h", F.xxhash64(F.when(F.col("decoy"), F.reverse("seq")).otherwise(F.col("seq")))).join(targets, "h", "left")
    return checked.agg(
        F.count_if(~F.col("decoy")).alias("n_targets"), F.count_if("decoy").alias("n_decoys"),
        (F.count_distinct(F.when(~F.col("decoy"), F.col("doc_id"))) == F.count_if(~F.col("decoy"))).alias("kept_targets"), F.every(F.col("t").isNotNull()).alias("real_decoys"),
    )


@R.query("select source, least(count(*), 20) as n, least(count(*), 20) as n_distinct, true as all_of_source from documents group by 1")
def cap_per_stratum(spark, sf_dir):
    """H3: documents of a source, 20 different ones at most (a sampling operator)."""
    d = table(spark, sf_dir, "documents")
    made = H.cap_per_stratum(d, "source", 20, "doc_id").select("doc_id", "source")
    real = d.select("doc_id", F.col("source").alias("real"))
    return made.join(real, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_distinct"), F.every(F.col("source").eqNullSafe(F.col("real"))).alias("all_of_source"))


@R.query("""
with m(r, m) as (values """ + ", ".join(f"('{k}', {v})" for k, v in S.RESIDUE_MASS.items()) + """),
d as (select item_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') as s from benchmark), p as (select item_id, unnest(string_split(s, '')) as r from d)
select item_id, round(sum(m::double) + 18.010565::double, 4) as mass from p join m using (r) group by 1
""")
def monoisotopic_mass(spark, sf_dir):
    """Masses of benchmark items read as sequences."""
    s = F.regexp_replace(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "[^ACDEFGHIKLMNPQRSTVWY]", "")
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(S.monoisotopic_mass(s), 4).alias("mass"))


QUERIES, ORACLES = R.queries, R.oracles
