"""Queries of minutes: orders are entries and nations are bodies, written out as a clerk writes them and read back."""

from pyspark.sql import functions as F

from ..operators import minutes
from .base import query


def _name(first: str, k):
    """A surname of a number, in letters."""
    k = F.col(k) if isinstance(k, str) else k
    letter = lambda x: F.char((97 + x % 26).cast("long"))
    return F.concat(F.lit(first), letter(k), letter(F.floor(k / 26)), letter(F.floor(k / 676)), F.lit("en"))


_NAME = "'{0}' || chr((97 + {1} % 26)::int) || chr((97 + {1} // 26 % 26)::int) || chr((97 + {1} // 676 % 26)::int) || 'en'"

_ORDERS = f"""
with l as (select l_orderkey, max(l_suppkey) filter (l_linenumber = 1) as a, max(l_suppkey) filter (l_linenumber = 2) as b, max(l_suppkey) filter (l_linenumber = 3) as c from lineitem group by all),
o as (select o_orderkey, o_orderstatus, o_orderpriority, {_NAME.format("M", "a")} as a, {_NAME.format("M", "b")} as b, {_NAME.format("M", "c")} as c from orders join l on l_orderkey = o_orderkey where a is not null),
s as (select *, case when c is null then 0 else 2 end as more, case when starts_with(o_orderpriority, '1') then 'carried' else 'failed' end as aside from o),
e as (
  select o_orderkey, 1 as at, 'motion' as type, a as mover, b as seconder, 'to approve' as action, null as result, false as tie, '' as yes, '' as no from s
  union all select o_orderkey, 2, 'motion', c, a, 'to amend by striking a line', null, false, '', '' from s where c is not null
  union all select o_orderkey, 3, 'outcome', null, null, 'Motion to amend', aside, false, '', '' from s where c is not null
  union all select o_orderkey, 2 + more, 'outcome', null, null, 'Main motion', case o_orderstatus when 'F' then 'carried' else 'failed' end, o_orderstatus = 'P', '', '' from s
  union all select o_orderkey, 3 + more, 'vote', null, null, null, null, false, a, coalesce(c, '') from s)"""


def _entries(t):
    at = lambda n, c: F.max(F.when(F.col("l_linenumber") == n, F.col("l_suppkey"))).alias(c)
    lines = t.lineitem.groupBy("l_orderkey").agg(at(1, "a"), at(2, "b"), at(3, "c")).where("a is not null")
    o = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    a, b, c = (_name("M", k) for k in "abc")
    amends = F.concat(F.lit(" Ms. "), c, F.lit(" moved to amend by striking a line, seconded by Mr. "), a, F.lit(". Motion to amend "), F.when(F.col("o_orderpriority").startswith("1"), "carried").otherwise("failed"), F.lit("."))
    second = F.coalesce(F.concat(F.lit(", seconded by Dr. "), b), F.lit(""))
    result = F.when(F.col("o_orderstatus") == "F", "carried").when(F.col("o_orderstatus") == "P", "failed due to a tie vote").otherwise("failed")
    noes = F.coalesce(F.concat(F.lit(' Voting "no" – Ms. '), c, F.lit(".")), F.lit(""))
    text = F.concat(F.lit("ORDINANCE - Lot "), F.col("o_orderkey"), F.lit(". Mr. "), a, F.lit(" moved to approve"), second, F.lit("."), F.coalesce(amends, F.lit("")), F.lit(" Main motion "), result, F.lit('. Voting "yes" Mr. '), a, F.lit("."), noes)
    return o.select(F.col("o_orderkey").alias("doc"), F.lit(0).alias("seq"), text.alias("text"), F.expr("cast(array() as array<string>)").alias("members"))


@query(f"{_ORDERS} select * from e")
def d02_motion_events(t):
    e = minutes.events(_entries(t))
    return e.select(F.col("doc").alias("o_orderkey"), "at", "type", "mover", "seconder", "action", "result", "tie", F.array_join("yes", ",").alias("yes"), F.array_join("no", ",").alias("no"))


@query(f"""{_ORDERS},
m as (select mover as member, 1 as made, 0 as seconded, case when e."at" = 1 and more = 0 and o_orderstatus = 'F' then 1 when e."at" = 2 and aside = 'carried' then 1 else 0 end as carried, seconder from e join s using (o_orderkey) where type = 'motion'),
u as (select member, made, seconded, carried from m union all select seconder, 0, 1, 0 from m where seconder is not null)
select member, sum(made)::bigint as made, sum(seconded)::bigint as seconded, sum(carried)::bigint as carried from u group by all""")
def a05_motions(t):
    return minutes.motions_by_member(minutes.events(_entries(t)))


@query(f"""
select n_nationkey, {_NAME.format("B", "n_nationkey")} as mayor,
  coalesce(list_aggregate(list_sort(list({_NAME.format("S", "s_suppkey")}) filter (s_acctbal >= 0)), 'string_agg', ','), '') as present, coalesce(list_aggregate(list_sort(list({_NAME.format("S", "s_suppkey")}) filter (s_acctbal < 0)), 'string_agg', ','), '') as absent,
  coalesce(list_aggregate(list_sort(list({_NAME.format("S", "s_suppkey")}) filter (s_acctbal >= 8000)), 'string_agg', ','), '') as remote, count(*) filter (s_acctbal >= 7000 and s_acctbal < 8000) as partial, 'Kim ' || {_NAME.format("C", "n_nationkey")} as clerk
from nation join supplier on s_nationkey = n_nationkey group by n_nationkey""")
def d01_rolls(t):
    who = F.struct(F.col("s_suppkey"), F.concat(F.lit("Dr. Uli "), _name("S", "s_suppkey"), F.when(F.col("s_acctbal") >= 8000, " (via Zoom)").when(F.col("s_acctbal") >= 7000, " (arrived at 6:15)").otherwise("")).alias("n"), (F.col("s_acctbal") < 0).alias("away"))
    listed = lambda away: F.array_join(F.transform(F.filter(F.array_sort("all"), lambda x: x["away"] == F.lit(away)), lambda x: x["n"]), ", ")
    body = t.supplier.groupBy("s_nationkey").agg(F.collect_list(who).alias("all"))
    text = F.concat(F.lit("Present were: MAYOR - Lena "), _name("B", "s_nationkey"), F.lit(", COUNCIL MEMBERS - "), listed(False), F.lit(". Absent: "), listed(True), F.lit(". Also present: Kim "), _name("C", "s_nationkey"), F.lit(", Clerk. The pledge was said."))
    r = minutes.roster(body.select(F.col("s_nationkey").alias("doc"), text.alias("text")))
    # Suppliers share surnames, if they are more than 26 ** 3; each of them counts.
    members = lambda c, name: F.array_join(F.array_sort(F.filter(c, lambda n: n.startswith("S"))), ",").alias(name)
    return r.select(F.col("doc").alias("n_nationkey"), "mayor", members("listed", "present"), members("absent", "absent"), members("remote", "remote"), F.size("notes").cast("long").alias("partial"), "clerk")
