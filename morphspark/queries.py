"""Registered queries of the engine over the Shop model, each with SQL for DuckDB."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from morphspark.engine import Engine
from morphspark.errors import MorphError
from morphspark.lang.parser import parse_expression, parse_module
from morphspark.metamodel import Metamodel, Model, Reference
from morphspark.shop import shop
from morphspark.sources.resource import load_module, save_module
from morphspark.sources.xmi import expression_from_xmi, expression_to_xmi
from morphspark.types import CollType, signature

MODULE = """
module Catalogue;
create OUT : Out from IN : Shop;

helper context Shop!Order def : urgent() : Boolean = self.orderpriority.startsWith('1');
helper context Shop!Customer def : label : String = self.mktsegment + '/' + self.name;
helper context Sequence(Shop!Order) def : open() : Integer = self->select(o | o.orderstatus = 'O')->size();
helper def : most(prices : Sequence(Real)) : Integer = prices->select(p | p > 100000)->size();
helper def : limit : Integer = 3000 * 3;
helper def : factorial(n : Integer) : Integer = if n < 2 then 1 else n * factorial(n - 1) endif;
"""

#: name -> (expression, SQL). Tuples name the columns.
EXPRESSIONS: dict[str, tuple[str, str]] = {
    "extent_scan": ("Shop!Nation.allInstances()->collect(n | Tuple{nationkey = n.nationkey, name = n.name})", "select cast(n_nationkey as bigint) as nationkey, n_name as name from nation"),
    "select_filter": ("Shop!Customer.allInstances()->select(c | c.acctbal > 5000)->collect(c | Tuple{custkey = c.custkey})", "select c_custkey as custkey from customer where c_acctbal > 5000"),
    "reject_filter": ("Shop!Customer.allInstances()->reject(c | c.mktsegment = 'BUILDING')->collect(c | Tuple{custkey = c.custkey})", "select c_custkey as custkey from customer where not (c_mktsegment = 'BUILDING')"),
    "collect_map": ("Shop!Part.allInstances()->collect(p | Tuple{id = p.partkey, u = p.name.toUpperCase(), n = p.name.size()})", "select p_partkey as id, upper(p_name) as u, cast(length(p_name) as bigint) as n from part"),
    "tuple_project": ("Shop!Supplier.allInstances()->collect(s | Tuple{k = s.suppkey, rich = s.acctbal >= 0.0})", "select s_suppkey as k, s_acctbal >= 0 as rich from supplier"),
    "arith_ops": ("Shop!Lineitem.allInstances()->collect(l | Tuple{p = l.order.orderkey, d = l.linenumber * 2 + 1 - 3, m = l.linenumber.mod(3), h = l.linenumber / 2})", "select l_orderkey as p, cast(l_linenumber as bigint)*2+1-3 as d, cast(l_linenumber as bigint) % 3 as m, cast(l_linenumber as double)/2 as h from lineitem"),
    "unary_not_neg": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, neg = -c.custkey, b = not (c.acctbal < 0)})", "select c_custkey as k, -c_custkey as neg, not (c_acctbal < 0) as b from customer"),
    "logic_and_or_implies": ("Shop!Order.allInstances()->select(o | (o.orderstatus = 'F' or o.orderstatus = 'O') and (o.totalprice > 100000 implies o.orderpriority <> '5-LOW'))->collect(o | Tuple{orderkey = o.orderkey})", "select o_orderkey as orderkey from orders where (o_orderstatus='F' or o_orderstatus='O') and ((not (o_totalprice > 100000)) or o_orderpriority <> '5-LOW')"),
    "if_else_chain": ("Shop!Part.allInstances()->collect(p | Tuple{k = p.partkey, c = if p.size < 10 then 'Small' else if p.size < 30 then 'Medium' else 'Large' endif endif})", "select p_partkey as k, case when p_size < 10 then 'Small' when p_size < 30 then 'Medium' else 'Large' end as c from part"),
    "let_in": ("Shop!Order.allInstances()->collect(o | let t : Real = o.totalprice in Tuple{k = o.orderkey, big = t > 200000})", "select o_orderkey as k, o_totalprice > 200000 as big from orders"),
    "string_concat_tostring": ("Shop!Nation.allInstances()->collect(n | Tuple{v = n.name + ':' + n.nationkey.toString()})", "select n_name || ':' || cast(n_nationkey as varchar(20)) as v from nation"),
    "string_reverse_sub": ("Shop!Supplier.allInstances()->collect(s | Tuple{k = s.suppkey, r = s.name.reverse(), p = s.name.substring(1, 8)})", "select s_suppkey as k, reverse(s_name) as r, substring(s_name,1,8) as p from supplier"),
    "int_even_square_power": ("Shop!Nation.allInstances()->collect(n | Tuple{k = n.nationkey, e = n.nationkey.isEven(), s = n.nationkey.square(), p = n.nationkey.power(3)})", "select cast(n_nationkey as bigint) as k, n_nationkey % 2 = 0 as e, cast(n_nationkey as bigint)*n_nationkey as s, cast(power(n_nationkey,3) as bigint) as p from nation"),
    "nav_to_one": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, n = c.nation.name})", "select c_custkey as k, n_name as n from customer left join nation on c_nationkey=n_nationkey"),
    "nav_chain": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, n = c.nation.name, r = c.nation.region.name})", "select c_custkey as k, n_name as n, r_name as r from customer left join nation on c_nationkey=n_nationkey left join region on n_regionkey=r_regionkey"),
    "nav_undefined": ("Shop!Document.allInstances()->collect(d | Tuple{k = d.docId, q = if d.label.oclIsUndefined() then -1 else d.label.quality endif})", "select d.doc_id as k, cast(case when l.doc_id is null then -1 else l.quality end as bigint) as q from documents d left join labels l on d.doc_id=l.doc_id"),
    "to_many_size": ("Shop!Order.allInstances()->collect(o | Tuple{k = o.orderkey, n = o.lineitems->size()})", "select o_orderkey as k, coalesce(n,0) as n from orders left join (select l_orderkey, count(*) as n from lineitem group by l_orderkey) g on o_orderkey=l_orderkey"),
    "to_many_select_size": ("Shop!Order.allInstances()->collect(o | Tuple{k = o.orderkey, n = o.lineitems->select(l | l.quantity > 30)->size()})", "select o_orderkey as k, coalesce(n,0) as n from orders left join (select l_orderkey, count(*) as n from lineitem where l_quantity > 30 group by l_orderkey) g on o_orderkey=l_orderkey"),
    "to_many_is_empty": ("Shop!Order.allInstances()->select(o | o.lineitems->isEmpty())->collect(o | Tuple{orderkey = o.orderkey})", "select o_orderkey as orderkey from orders where not exists (select 1 from lineitem where l_orderkey=o_orderkey)"),
    "exists_semi": ("Shop!Order.allInstances()->select(o | o.lineitems->exists(l | l.returnflag = 'R'))->collect(o | Tuple{orderkey = o.orderkey})", "select o_orderkey as orderkey from orders where exists (select 1 from lineitem where l_orderkey=o_orderkey and l_returnflag='R')"),
    "forall_anti": ("Shop!Order.allInstances()->select(o | o.lineitems->forAll(l | l.discount < 0.08))->collect(o | Tuple{orderkey = o.orderkey})", "select o_orderkey as orderkey from orders where not exists (select 1 from lineitem where l_orderkey=o_orderkey and not (l_discount < 0.08))"),
    "one_exactly": ("Shop!Order.allInstances()->select(o | o.lineitems->one(l | l.linestatus = 'F'))->collect(o | Tuple{orderkey = o.orderkey})", "select o_orderkey as orderkey from orders join (select l_orderkey from lineitem where l_linestatus='F' group by l_orderkey having count(*)=1) g on o_orderkey=l_orderkey"),
    "any_first_match": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, o = c.orders->sortedBy(o | o.orderkey)->any(o | o.totalprice > 100000).orderkey})", "select c_custkey as k, o from customer left join (select o_custkey, min(o_orderkey) as o from orders where o_totalprice > 100000 group by o_custkey) g on c_custkey=o_custkey"),
    "first_last": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, f = c.orders->sortedBy(o | o.orderkey)->first().orderkey, l = c.orders->sortedBy(o | o.orderkey)->last().orderkey})", "select c_custkey as k, f, l from customer left join (select o_custkey, min(o_orderkey) as f, max(o_orderkey) as l from orders group by o_custkey) g on c_custkey=o_custkey"),
    "iterate_sum": ("Shop!Order.allInstances()->collect(o | Tuple{k = o.orderkey, s = o.lineitems->iterate(l; s : Integer = 0 | s + l.linenumber)})", "select o_orderkey as k, coalesce(s,0) as s from orders left join (select l_orderkey, cast(sum(l_linenumber) as bigint) as s from lineitem group by l_orderkey) g on o_orderkey=l_orderkey"),
    "iterate_conditional_sum": ("Shop!Order.allInstances()->collect(o | Tuple{k = o.orderkey, t = o.lineitems->iterate(l; t : Integer = 0 | t + if l.quantity > 25 then 3 else 2 endif)})", "select o_orderkey as k, coalesce(t,0) as t from orders left join (select l_orderkey, cast(sum(case when l_quantity > 25 then 3 else 2 end) as bigint) as t from lineitem group by l_orderkey) g on o_orderkey=l_orderkey"),
    "iterate_count_if": ("Shop!Order.allInstances()->select(o | o.lineitems->notEmpty())->collect(o | Tuple{k = o.orderkey, n = o.lineitems->iterate(l; n : Integer = 0 | if l.tax > 0.04 then n + 1 else n endif)})", "select l_orderkey as k, cast(sum(case when l_tax > 0.04 then 1 else 0 end) as bigint) as n from lineitem group by l_orderkey"),
    "iterate_max_min": ("Shop!Order.allInstances()->select(o | o.lineitems->notEmpty())->collect(o | Tuple{k = o.orderkey, mx = o.lineitems->iterate(l; m : Real = 0.0 - 1.0 | if l.quantity > m then l.quantity else m endif), mn = o.lineitems->iterate(l; m : Real = 1000000.0 | if l.quantity < m then l.quantity else m endif)})", "select l_orderkey as k, max(l_quantity) as mx, min(l_quantity) as mn from lineitem group by l_orderkey"),
    "iterate_argmax": ("Shop!Customer.allInstances()->select(c | c.orders->notEmpty())->collect(c | Tuple{k = c.custkey, o = c.orders->iterate(o; b : Shop!Order = c.orders->first() | if o.totalprice > b.totalprice then o else b endif).orderkey})", "select k, o from (select o_custkey as k, o_orderkey as o, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) t where rn=1"),
    "iterate_global": ("Tuple{n = Shop!Order.allInstances()->iterate(o; n : Integer = 0 | n + 1)}", "select count(*) as n from orders"),
    "iterate_ordered_fold": ("Shop!Nation.allInstances()->collect(n | Tuple{k = n.nationkey, s = n.suppliers->iterate(s; t : String = '' | if t = '' then s.name else t + ',' + s.name endif)})", "select cast(n_nationkey as bigint) as k, coalesce(s,'') as s from nation left join (select s_nationkey, string_agg(s_name, ',' order by s_suppkey) as s from supplier group by s_nationkey) g on n_nationkey=s_nationkey"),
    "sum_decimal_exact": ("Shop!Order.allInstances()->select(o | o.lineitems->notEmpty())->collect(o | Tuple{k = o.orderkey, s = (o.lineitems->collect(l | l.extendedprice)->sum() * 100).round()})", "select l_orderkey as k, cast(round(sum(l_extendedprice) * 100) as bigint) as s from lineitem group by l_orderkey"),
    "sum_real_three_decimals": ("Shop!Order.allInstances()->collect(o | Tuple{k = o.orderkey, s = o.lineitems->collect(l | l.quantity * 0.125)->sum(), a = o.lineitems->collect(l | l.quantity * 0.125)->max()})", "select o_orderkey as k, coalesce(s, 0) as s, a from orders left join (select l_orderkey, sum(l_quantity * cast(0.125 as double)) as s, max(l_quantity * cast(0.125 as double)) as a from lineitem group by l_orderkey) g on o_orderkey=l_orderkey"),
    "as_set_distinct": ("Shop!Part.allInstances()->collect(p | Tuple{brand = p.brand})->asSet()", "select distinct p_brand as brand from part"),
    "set_union": ("Shop!Customer.allInstances()->collect(c | c.nation.nationkey)->asSet()->union(Shop!Supplier.allInstances()->collect(s | s.nation.nationkey)->asSet())->collect(k | Tuple{k = k})", "select cast(c_nationkey as bigint) as k from customer union select cast(s_nationkey as bigint) from supplier"),
    "bag_union": ("Shop!Customer.allInstances()->collect(c | c.nation.nationkey)->union(Shop!Supplier.allInstances()->collect(s | s.nation.nationkey))->collect(k | Tuple{k = k})", "select cast(c_nationkey as bigint) as k from customer union all select cast(s_nationkey as bigint) from supplier"),
    "set_intersection": ("Shop!Customer.allInstances()->select(c | c.acctbal < 0)->collect(c | c.nation.nationkey)->asSet()->intersection(Shop!Supplier.allInstances()->select(s | s.acctbal < 0)->collect(s | s.nation.nationkey)->asSet())->collect(k | Tuple{k = k})", "select cast(c_nationkey as bigint) as k from customer where c_acctbal < 0 intersect select cast(s_nationkey as bigint) from supplier where s_acctbal < 0"),
    "set_difference": ("Shop!Nation.allInstances()->collect(n | n.nationkey)->asSet()->difference(Shop!Supplier.allInstances()->select(s | s.acctbal < 0)->collect(s | s.nation.nationkey)->asSet())->collect(k | Tuple{k = k})", "select cast(n_nationkey as bigint) as k from nation except select cast(s_nationkey as bigint) from supplier where s_acctbal < 0"),
    "symmetric_difference": ("Shop!Nation.allInstances()->select(n | n.nationkey < 15)->collect(n | n.nationkey)->asSet()->symmetricDifference(Shop!Nation.allInstances()->select(n | n.nationkey > 9)->collect(n | n.nationkey)->asSet())->collect(k | Tuple{k = k})", "select cast(n_nationkey as bigint) as k from nation where n_nationkey < 10 or n_nationkey > 14"),
    "includes_semi": ("Shop!Nation.allInstances()->select(n | Shop!Supplier.allInstances()->select(s | s.acctbal < 0)->collect(s | s.nation)->includes(n))->collect(n | Tuple{k = n.nationkey})", "select cast(n_nationkey as bigint) as k from nation where exists (select 1 from supplier where s_nationkey=n_nationkey and s_acctbal < 0)"),
    "excludes_anti": ("Shop!Nation.allInstances()->select(n | Shop!Supplier.allInstances()->select(s | s.acctbal < 0)->collect(s | s.nation)->excludes(n))->collect(n | Tuple{k = n.nationkey})", "select cast(n_nationkey as bigint) as k from nation where not exists (select 1 from supplier where s_nationkey=n_nationkey and s_acctbal < 0)"),
    "flatten_unnest": ("Shop!Customer.allInstances()->select(c | c.mktsegment = 'MACHINERY')->collect(c | c.orders->select(o | o.orderstatus = 'F')->collect(o | Tuple{c = c.custkey, o = o.orderkey}))->flatten()", "select c_custkey as c, o_orderkey as o from customer join orders on o_custkey=c_custkey where o_orderstatus='F' and c_mktsegment='MACHINERY'"),
    "sorted_topk": ("Shop!Order.allInstances()->sortedBy(o | -o.totalprice)->subSequence(1, 20)->collect(o | Tuple{k = o.orderkey, t = o.totalprice})", "select o_orderkey as k, o_totalprice as t from orders order by o_totalprice desc, o_orderkey limit 20"),
    "index_of_sibling": ("Shop!Order.allInstances()->collect(o | Tuple{k = o.orderkey, i = o.customer.orders->sortedBy(x | x.orderkey)->indexOf(o)})", "select o_orderkey as k, cast(row_number() over (partition by o_custkey order by o_orderkey) as bigint) as i from orders"),
    "subsequence_per_parent": ("Shop!Customer.allInstances()->collect(c | c.orders->sortedBy(o | o.orderkey)->subSequence(1, 3)->collect(o | Tuple{c = o.customer.custkey, k = o.orderkey}))->flatten()", "select c, k from (select o_custkey as c, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) as i from orders) t where i between 1 and 3"),
    "nested_depth2": ("Shop!Nation.allInstances()->collect(n | Tuple{k = n.nationkey, s = n.customers->collect(c | c.orders->size())->sum()})", "select cast(n_nationkey as bigint) as k, coalesce(s,0) as s from nation left join (select c_nationkey, count(*) as s from customer join orders on o_custkey=c_custkey group by c_nationkey) g on n_nationkey=c_nationkey"),
    "theta_correlated": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, n = Shop!Supplier.allInstances()->select(s | s.nation = c.nation and s.acctbal > c.acctbal)->size()})", "select c_custkey as k, coalesce(cnt,0) as n from customer left join (select c_custkey as ck, count(*) as cnt from customer join supplier on s_nationkey=c_nationkey and s_acctbal > c_acctbal group by c_custkey) g on c_custkey=ck"),
    "kind_of": ("Tuple{c = Shop!Customer.allInstances()->select(c | c.oclIsKindOf(Shop!Customer))->size(), s = Shop!Supplier.allInstances()->select(s | s.oclType().name = 'Supplier')->size()}", "select (select count(*) from customer) as c, (select count(*) from supplier) as s"),
    "helper_context": ("Shop!Order.allInstances()->collect(o | Tuple{k = o.orderkey, urgent = o.urgent()})", "select o_orderkey as k, substring(o_orderpriority,1,1)='1' as urgent from orders"),
    "helper_attribute": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, l = c.label})", "select c_custkey as k, c_mktsegment || '/' || c_name as l from customer"),
    "helper_recursive": ("Shop!Nation.allInstances()->collect(n | Tuple{k = n.nationkey, f = factorial(n.nationkey.mod(6))})", "select cast(n_nationkey as bigint) as k, cast(case n_nationkey % 6 when 0 then 1 when 1 then 1 when 2 then 2 when 3 then 6 when 4 then 24 else 120 end as bigint) as f from nation"),
    "query_string_report": ("Tuple{v = 'Model has ' + Shop!Order.allInstances()->size().toString() + ' orders, ' + Shop!Order.allInstances()->select(o | o.orderstatus = 'O')->size().toString() + ' open'}", "select 'Model has ' || cast(count(*) as varchar(20)) || ' orders, ' || cast(cast(sum(case when o_orderstatus='O' then 1 else 0 end) as bigint) as varchar(20)) || ' open' as v from orders"),
    "child_nav_in_lambda": ("Shop!Order.allInstances()->select(o | o.lineitems->exists(l | l.part.brand = 'Brand#1'))->collect(o | Tuple{orderkey = o.orderkey})", "select o_orderkey as orderkey from orders where exists (select 1 from lineitem join part on l_partkey=p_partkey where l_orderkey=o_orderkey and p_brand='Brand#1')"),
    "nested_to_many": ("Shop!Nation.allInstances()->collect(n | Tuple{k = n.nationkey, m = n.customers->select(c | c.orders->size() > 12)->size()})", "select cast(n_nationkey as bigint) as k, coalesce(m,0) as m from nation left join (select c_nationkey, count(*) as m from customer join (select o_custkey from orders group by o_custkey having count(*) > 12) g on o_custkey=c_custkey group by c_nationkey) h on n_nationkey=c_nationkey"),
    "outer_var_lambda": ("Shop!Order.allInstances()->collect(o | Tuple{k = o.orderkey, n = o.customer.orders->select(x | x <> o and x.totalprice > o.totalprice)->size()})", "select a.o_orderkey as k, cast(sum(case when b.o_orderkey <> a.o_orderkey and b.o_totalprice > a.o_totalprice then 1 else 0 end) as bigint) as n from orders a join orders b on a.o_custkey=b.o_custkey group by a.o_orderkey"),
    "array_ops": ("Shop!Nation.allInstances()->collect(n | let s : Sequence(Integer) = Sequence{n.nationkey, 3, 1, 3} in Tuple{k = n.nationkey, sz = s->asSet()->size(), inc = s->includes(7), tot = s->iterate(x; a : Integer = 0 | a + x), mx = s->sortedBy(x | -x)->first(), i = s->indexOf(3), ev = s->select(x | x.isEven())->size()})", "select cast(n_nationkey as bigint) as k, cast(case when n_nationkey in (1,3) then 2 else 3 end as bigint) as sz, n_nationkey = 7 as inc, cast(n_nationkey + 7 as bigint) as tot, cast(greatest(n_nationkey, 3) as bigint) as mx, cast(case when n_nationkey = 3 then 1 else 2 end as bigint) as i, cast(case when n_nationkey % 2 = 0 then 1 else 0 end as bigint) as ev from nation"),
    # Set operations for each parent
    "union_per_parent": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, n = c.orders->select(o | o.orderstatus = 'F')->union(c.orders->select(o | o.totalprice > 200000))->size()})", "select c_custkey as k, count(o_orderkey) as n from customer left join orders on o_custkey=c_custkey and (o_orderstatus='F' or o_totalprice > 200000) group by c_custkey"),
    "bag_union_per_parent": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, n = c.orders->collect(o | o.orderstatus)->union(c.orders->collect(o | o.orderpriority))->size()})", "select c_custkey as k, 2 * count(o_orderkey) as n from customer left join orders on o_custkey=c_custkey group by c_custkey"),
    "intersection_per_parent": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, n = c.orders->select(o | o.orderstatus = 'F')->intersection(c.orders->select(o | o.totalprice > 200000))->collect(o | o.orderkey)->max()})", "select c_custkey as k, max(o_orderkey) as n from customer left join orders on o_custkey=c_custkey and o_orderstatus='F' and o_totalprice > 200000 group by c_custkey"),
    "difference_per_parent": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, n = c.orders->difference(c.orders->select(o | o.totalprice > 200000))->size()})", "select c_custkey as k, count(o_orderkey) as n from customer left join orders on o_custkey=c_custkey and o_totalprice <= 200000 group by c_custkey"),
    "symmetric_difference_per_parent": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, n = c.orders->select(o | o.orderstatus = 'F')->symmetricDifference(c.orders->select(o | o.totalprice > 200000))->size()})", "select c_custkey as k, count(o_orderkey) as n from customer left join orders on o_custkey=c_custkey and (o_orderstatus='F') <> (o_totalprice > 200000) group by c_custkey"),
    "including_excluding": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, n = c.orders->collect(o | o.orderstatus)->including('X')->size(), m = c.orders->collect(o | o.orderstatus)->excluding('F')->size()})", "select c_custkey as k, count(o_orderkey) + 1 as n, count(case when o_orderstatus <> 'F' then 1 end) as m from customer left join orders on o_custkey=c_custkey group by c_custkey"),
    "array_union_rows": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, n = Sequence{c.custkey}->union(c.orders->collect(o | o.orderkey))->sum()})", "select c_custkey as k, cast(c_custkey + coalesce(sum(o_orderkey), 0) as bigint) as n from customer left join orders on o_custkey=c_custkey group by c_custkey"),
    "cross_parent_union": ("Shop!Nation.allInstances()->collect(n | Tuple{k = n.nationkey, m = n.customers->collect(c | c.name)->union(n.suppliers->collect(s | s.name))->size()})", "select cast(n_nationkey as bigint) as k, (select count(*) from customer where c_nationkey=n_nationkey) + (select count(*) from supplier where s_nationkey=n_nationkey) as m from nation"),
    "includes_all": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, a = c.orders->collect(o | o.orderstatus)->includesAll(Sequence{'F', 'O'}), e = c.orders->collect(o | o.orderstatus)->excludesAll(Sequence{'P'})})", "select c_custkey as k, coalesce(bool_or(o_orderstatus='F') and bool_or(o_orderstatus='O'), false) as a, not coalesce(bool_or(o_orderstatus='P'), false) as e from customer left join orders on o_custkey=c_custkey group by c_custkey"),
    "extent_includes_all": ("Tuple{a = Shop!Customer.allInstances()->collect(c | c.nation.nationkey)->includesAll(Shop!Supplier.allInstances()->collect(s | s.nation.nationkey)), e = Shop!Nation.allInstances()->collect(n | n.nationkey)->excludesAll(Sequence{1, 2})}", "select (select count(*) from supplier where s_nationkey not in (select c_nationkey from customer)) = 0 as a, not exists (select 1 from nation where n_nationkey in (1, 2)) as e"),
    # Collections as values
    "tuple_collection": ("Shop!Customer.allInstances()->collect(c | let t : TupleType(os : Sequence(Integer)) = Tuple{os = c.orders->collect(o | o.orderkey)} in Tuple{k = c.custkey, n = t.os->size(), f = t.os->last()})", "select c_custkey as k, count(o_orderkey) as n, max(o_orderkey) as f from customer left join orders on o_custkey=c_custkey group by c_custkey"),
    "collection_equality": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, e = c.orders->collect(o | o.orderstatus)->asSet() = Set{'O', 'F'}, d = c.orders->select(o | o.orderstatus = 'F')->collect(o | o.orderkey) <> c.orders->collect(o | o.orderkey)})", "select c_custkey as k, count(distinct o_orderstatus) = 2 and bool_and(o_orderstatus in ('F', 'O')) as e, coalesce(bool_or(o_orderstatus <> 'F'), false) as d from customer left join orders on o_custkey=c_custkey group by c_custkey"),
    "collection_as_argument": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, n = most(c.orders->collect(o | o.totalprice))})", "select c_custkey as k, coalesce(n, 0) as n from customer left join (select o_custkey, count(*) as n from orders where o_totalprice > 100000 group by o_custkey) g on o_custkey=c_custkey"),
    # Order and places
    "at_per_parent": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, o = c.orders->sortedBy(o | -o.totalprice)->at(2).orderkey})", "select c_custkey as k, o from customer left join (select o_custkey, o_orderkey as o, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as i from orders) g on o_custkey=c_custkey and i=2"),
    "at_of_extent": ("Tuple{k = Shop!Order.allInstances()->sortedBy(o | -o.totalprice)->at(7).orderkey}", "select o_orderkey as k from orders order by o_totalprice desc, o_orderkey limit 1 offset 6"),
    "index_of_extent": ("Shop!Supplier.allInstances()->collect(s | Tuple{k = s.suppkey, i = Shop!Supplier.allInstances()->sortedBy(x | -x.acctbal)->indexOf(s)})", "select s_suppkey as k, row_number() over (order by s_acctbal desc, s_suppkey) as i from supplier"),
    "subsequence_of_extent": ("Shop!Order.allInstances()->sortedBy(o | -o.totalprice)->subSequence(11, 30)->collect(o | Tuple{k = o.orderkey})", "select o_orderkey as k from orders order by o_totalprice desc, o_orderkey limit 20 offset 10"),
    "as_sequence_first": ("Tuple{f = Shop!Order.allInstances()->asSequence()->first().orderkey, n = Shop!Order.allInstances()->collect(o | o.orderstatus)->asSequence()->size()}", "select min(o_orderkey) as f, count(*) as n from orders"),
    "as_bag": ("Tuple{n = Shop!Nation.allInstances()->collect(n | n.region.regionkey)->asBag()->size(), s = Shop!Nation.allInstances()->collect(n | n.region.regionkey)->asSet()->size()}", "select count(*) as n, count(distinct n_regionkey) as s from nation"),
    "ordered_set_first": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, s = c.orders->sortedBy(o | -o.totalprice)->collect(o | o.orderstatus)->asOrderedSet()->first()})", "select c_custkey as k, s from customer left join (select o_custkey, o_orderstatus as s, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as i from orders) g on o_custkey=c_custkey and i=1"),
    "is_unique": ("Tuple{a = Shop!Order.allInstances()->isUnique(o | o.orderkey), b = Shop!Order.allInstances()->isUnique(o | o.orderstatus)}", "select count(*) = count(distinct o_orderkey) as a, count(*) = count(distinct o_orderstatus) as b from orders"),
    # Folds
    "iterate_and_or": ("Shop!Order.allInstances()->collect(o | Tuple{k = o.orderkey, a = o.lineitems->iterate(l; b : Boolean = true | b and l.quantity > 5), e = o.lineitems->iterate(l; b : Boolean = false | b or l.quantity > 45)})", "select o_orderkey as k, coalesce(a, true) as a, coalesce(e, false) as e from orders left join (select l_orderkey, bool_and(l_quantity > 5) as a, bool_or(l_quantity > 45) as e from lineitem group by l_orderkey) g on o_orderkey=l_orderkey"),
    "iterate_product": ("Shop!Order.allInstances()->collect(o | Tuple{k = o.orderkey, p = o.lineitems->iterate(l; p : Integer = 1 | p * l.linenumber)})", "select o_orderkey as k, cast(coalesce(p, 1) as bigint) as p from orders left join (select l_orderkey, product(l_linenumber) as p from lineitem group by l_orderkey) g on o_orderkey=l_orderkey"),
    # Scalars
    "xor_op": ("Shop!Order.allInstances()->select(o | o.orderstatus = 'F' xor o.totalprice > 150000)->collect(o | Tuple{k = o.orderkey})", "select o_orderkey as k from orders where (o_orderstatus='F') <> (o_totalprice > 150000)"),
    "string_empty_case": ("Shop!Nation.allInstances()->collect(n | Tuple{k = n.nationkey, e = n.name.isEmpty(), f = ''.isEmpty(), u = n.name.toUpper(), l = n.name.toLower()})", "select cast(n_nationkey as bigint) as k, n_name = '' as e, true as f, upper(n_name) as u, lower(n_name) as l from nation"),
    "string_split_replace": ("Shop!Supplier.allInstances()->collect(s | Tuple{k = s.suppkey, p = ('a.' + s.name + '.z').split('.')->size(), q = (s.name + '.+').replaceAll('.+', '#'), c = s.name.concat('!').indexOf('!'), b = s.name.trim().endsWith('1')})", "select s_suppkey as k, cast(len(string_split('a.' || s_name || '.z', '.')) as bigint) as p, replace(s_name || '.+', '.+', '#') as q, cast(instr(s_name || '!', '!') as bigint) as c, suffix(trim(s_name), '1') as b from supplier"),
    "int_div": ("Shop!Order.allInstances()->collect(o | Tuple{k = o.orderkey, d = o.orderkey.div(7), m = (0 - o.orderkey) div 7})", "select o_orderkey as k, o_orderkey // 7 as d, -(o_orderkey // 7) as m from orders"),
    "number_rounding": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, a = c.acctbal.abs() >= 0.0, f = c.acctbal.floor(), g = c.acctbal.ceiling(), r = (c.acctbal / 8).round(), x = c.custkey.max(50), n = c.custkey.min(50)})", "select c_custkey as k, true as a, cast(floor(c_acctbal) as bigint) as f, cast(ceil(c_acctbal) as bigint) as g, cast(round(c_acctbal / 8) as bigint) as r, greatest(c_custkey, 50) as x, least(c_custkey, 50) as n from customer"),
    "type_of_cast": ("Shop!Party.allInstances()->collect(p | Tuple{n = p.name, t = p.oclIsTypeOf(Shop!Supplier), d = p.oclAsType(Shop!Party).acctbal > 0})", "select c_name as n, false as t, c_acctbal > 0 as d from customer union all select s_name, true, s_acctbal > 0 from supplier"),
    "value_order": ("Shop!Nation.allInstances()->select(n | n.name < 'J' and n.nationkey <> 3)->sortedBy(n | n.name)->collect(n | Tuple{k = n.nationkey, e = n.name = n.name})", "select cast(n_nationkey as bigint) as k, true as e from nation where n_name < 'J' and n_nationkey <> 3"),
    # Subclasses
    "extent_subtypes": ("Shop!Party.allInstances()->collect(p | Tuple{n = p.name, c = p.oclType().name, b = p.acctbal < 0})", "select c_name as n, 'Customer' as c, c_acctbal < 0 as b from customer union all select s_name, 'Supplier', s_acctbal < 0 from supplier"),
    "kind_of_subtypes": ("Shop!Party.allInstances()->select(p | p.oclIsKindOf(Shop!Supplier) or p.acctbal > 9000)->collect(p | Tuple{n = p.name, s = p.oclIsKindOf(Shop!Supplier), p = p.oclIsKindOf(Shop!Party)})", "select c_name as n, false as s, true as p from customer where c_acctbal > 9000 union all select s_name, true, true from supplier"),
    # Helpers
    "helper_collection": ("Shop!Customer.allInstances()->collect(c | Tuple{k = c.custkey, n = c.orders->open()})", "select c_custkey as k, count(o_orderkey) as n from customer left join orders on o_custkey=c_custkey and o_orderstatus='O' group by c_custkey"),
    "helper_constant": ("Shop!Customer.allInstances()->select(c | c.acctbal > thisModule.limit)->collect(c | Tuple{k = c.custkey, l = thisModule.limit})", "select c_custkey as k, cast(9000 as bigint) as l from customer where c_acctbal > 9000"),
    "helper_registered": ("Shop!Nation.allInstances()->collect(n | Tuple{k = n.nationkey, i = initial(n.name)})", "select cast(n_nationkey as bigint) as k, substring(n_name, 1, 1) as i from nation"),
    "events_by_type": ("Shop!Event.allInstances()->select(e | e.eventType = 'purchase' and e.value > 10)->collect(e | Tuple{id = e.eventId, u = e.userId})", "select event_id as id, user_id as u from events where event_type = 'purchase' and value > 10"),
}

RULES = """
module Transform;
create OUT : Out, BANK : Bank from IN : Shop;

rule N2C { from s : Shop!Nation (s.region.regionkey < 3) to c : Out!Country (name <- s.name) }
rule C2A { from c : Shop!Customer (c.acctbal > 9000)
  to a : Bank!Account (owner <- c.name), b : Bank!Badge (account <- a) }
rule Emp { from c : Shop!Customer to e : Out!Emp (k <- c.custkey) }
rule Mgr { from c : Shop!Customer (c.acctbal >= 5000) to m : Out!Mgr (k <- c.custkey) }
rule S2V { from s : Shop!Supplier to v : Out!Vendor (k <- s.suppkey, country <- thisModule.resolveTemp(s.nation, 'c'), home <- s.nation) }
rule Pair { from r : Shop!Region, n : Shop!Nation (n.region <> r) to p : Out!Pair (r <- r.regionkey, n <- n.nationkey) }
rule Big { from c : Shop!Customer (c.acctbal > 9000) to p : Out!Pack (items <- c.orders->collect(o | thisModule.MakeItem(o))) }
rule Seg { from c : Shop!Customer to s : Out!Member (k <- c.custkey, seg <- thisModule.MakeSegment(c.mktsegment)) }
lazy rule MakeItem { from o : Shop!Order to i : Out!Item (k <- o.orderkey) }
rule MakeSegment(name : String) { to s : Out!Segment (name <- name) }
"""

MORE_RULES = """
module More;
create OUT : Out from IN : Shop;

rule Bill { from o : Shop!Order (o.orderstatus <> 'P') to b : Out!Bill (k <- o.orderkey) }
rule Book { from c : Shop!Customer (c.acctbal > 5000)
  to b : Out!Book (bills <- c.orders->sortedBy(o | -o.totalprice), prices <- c.orders->sortedBy(o | -o.totalprice)->collect(o | o.orderkey),
    all <- Sequence{t}->union(c.orders->select(o | o.orderstatus = 'F'))), t : Out!Tab (k <- c.custkey)
  do { t.name <- c.name; } }
rule Bare { from n : Nation (n.nationkey < 10) using { low : String = n.name.toLower(); } to l : Out!Land (name <- low, region <- n.region.name) }
rule Side { from p : Shop!Party (p.acctbal < 0) to d : Out!Debt (name <- p.name) }
"""

FLAGSHIP = """
module Customer2Account;
create OUT : Bank from IN : Shop;
rule Customer2Account {
  from c : Shop!Customer (c.acctbal > 0)
  to a : Bank!Account (owner <- c.name, nation <- c.nation.name, segment <- c.mktsegment)
}
"""


def _expression(name: str):
    def run(spark, sf_dir):
        engine = Engine(spark, MODULE).source("IN", shop(spark, sf_dir)).helper("initial", lambda c: F.substring(c, 1, 1))
        return engine.evaluate(EXPRESSIONS[name][0])

    run.__name__ = name
    return run


def _run(spark, sf_dir, text=RULES):
    return Engine(spark, text).source("IN", shop(spark, sf_dir)).run()


def flagship_rule(spark, sf_dir):
    return _run(spark, sf_dir, FLAGSHIP)["OUT"]["Account"].select(F.col("_id").alias("id"), "owner", "nation", "segment")


def rule_two_targets(spark, sf_dir):
    rule = RULES[RULES.index("rule C2A"):RULES.index("rule Emp")]
    both = _run(spark, sf_dir, f"module Two; create OUT : Bank from IN : Shop; {rule}").together()
    return both.select(F.col("_class").alias("cls"), F.col("_id").alias("id"), F.coalesce("owner", "account").alias("v"))


def rule_overlap(spark, sf_dir):
    out = _run(spark, sf_dir)["OUT"]
    return out["Emp"].select(F.lit("Emp").alias("cls"), "k").union(out["Mgr"].select(F.lit("Mgr"), "k"))


def multi_source_cross(spark, sf_dir):
    return _run(spark, sf_dir)["OUT"]["Pair"].select("r", "n")


def trace_links(spark, sf_dir):
    return _run(spark, sf_dir).trace.where("rule = 'N2C'").select("rule", "pattern_var", "source_id", "target_id")


def resolve_temp(spark, sf_dir):
    return _run(spark, sf_dir)["OUT"]["Vendor"].select("k", "country")


def implicit_resolution(spark, sf_dir):
    return _run(spark, sf_dir)["OUT"]["Vendor"].select("k", F.col("home").alias("country"))


def lazy_rule_memo(spark, sf_dir):
    return _run(spark, sf_dir)["OUT"]["Segment"].select(F.col("_id").alias("id"), "name")


def lazy_rule_in_collect(spark, sf_dir):
    out = _run(spark, sf_dir)["OUT"]
    owners = out["Pack"].select(F.explode("items").alias("id"), F.col("_id").alias("owner"))
    items = out["Item"].select(F.lit("Item").alias("cls"), F.col("_id").alias("id")).join(owners, "id").select("cls", "id", "owner")
    return out["Pack"].select(F.lit("Pack").alias("cls"), F.col("_id").alias("id"), F.lit(None).cast("string").alias("owner")).union(items)


def called_rule(spark, sf_dir):
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("name"))
    return Engine(spark, RULES).source("IN", shop(spark, sf_dir)).call("MakeSegment", regions)["Segment"].select(F.col("_id").alias("id"), "name")


# Ordered bindings, references, services


def _more(spark, sf_dir, **options):
    return Engine(spark, MORE_RULES).source("IN", shop(spark, sf_dir)).run(**options)


def _items(df, column: str):
    return df.select(F.col("_id").alias("id"), F.posexplode(column).alias("i", "v"))


def ordered_binding(spark, sf_dir):
    return _items(_more(spark, sf_dir)["OUT"]["Book"], "prices")


def ordered_references(spark, sf_dir):
    return _items(_more(spark, sf_dir)["OUT"]["Book"], "bills")


def targets_beside_references(spark, sf_dir):
    return _items(_more(spark, sf_dir)["OUT"]["Book"], "all")


def do_block(spark, sf_dir):
    return _more(spark, sf_dir)["OUT"]["Tab"].select("k", "name")


def bare_class_using(spark, sf_dir):
    return _more(spark, sf_dir)["OUT"]["Land"].select("name", "region")


def rule_over_supertype(spark, sf_dir):
    return _more(spark, sf_dir)["OUT"]["Debt"].select(F.col("_id").alias("id"), "name")


def strict_references(spark, sf_dir):
    """With ``strict`` an unresolved reference stops the job that reads it."""
    rule = "module S; create OUT : Out from IN : Shop; rule N { from n : Shop!Nation (n.nationkey < %d) to c : Out!Country (name <- n.name) } rule V { from s : Shop!Supplier to v : Out!Vendor (home <- s.nation) }"
    rows = []
    for least in (1000, 0):
        vendors = Engine(spark, rule % least).source("IN", shop(spark, sf_dir)).run(strict=True)["OUT"]["Vendor"]
        try:
            vendors.agg(F.max("home")).first()
            rows.append((least, "resolved"))
        except Exception as e:  # noqa: BLE001
            rows.append((least, "no target" if "no target for Nation" in str(e) else str(e)))
    return spark.createDataFrame(rows, "nations long, outcome string")


def find_element(spark, sf_dir):
    """Targets first, then sources."""
    result = _more(spark, sf_dir)
    return result.find_element("Bill#b#Order:1").select("model", F.col("_id").alias("id"), F.col("_class").alias("cls")).union(result.find_element("Nation:3").select("model", "_id", "_class"))


def extent_by_name(spark, sf_dir):
    result = _more(spark, sf_dir)
    return result.extent("Land").select("name").union(result.extent("Region").select("name"))


def run_report(spark, sf_dir):
    report = _more(spark, sf_dir).report()
    return spark.createDataFrame([("rule", n, c) for n, c in report.rules.items()] + [("class", n, c) for n, c in report.elements.items()], "what string, name string, n long")


def run_metrics(spark, sf_dir):
    """How often the plans of a run hold each helper and each navigation."""
    rule = "module M; create OUT : Out from IN : Shop; helper context Shop!Customer def : rich() : Boolean = self.acctbal > 5000; rule R { from c : Shop!Customer (c.rich()) to t : Out!Thing (n <- c.nation.name, r <- c.nation.region.name) }"
    report = Engine(spark, rule).source("IN", shop(spark, sf_dir)).run().report()
    return spark.createDataFrame([(n, c > 0) for n, c in report.uses.items()], "what string, used boolean")


def run_diagnostics(spark, sf_dir):
    """Errors, warnings and events that an engine keeps: of a run that fails for want of a model, and of one that does not."""
    text = "module D; create OUT : Out from IN : Shop; query open = 1 rule R { from r : Shop!Region to t : Out!Thing (key <- r.name) }"
    engine = Engine(spark, text)
    for model in (None, shop(spark, sf_dir)):
        try:
            (engine.source("IN", model) if model else engine).run()
        except MorphError:
            pass
    rows = [(level, message.split(":")[0].split(" before")[0].replace(chr(39), "")) for _, level, message in engine.diagnostics.timeline]
    engine.diagnostics.clear()
    return spark.createDataFrame([*rows, ("left", str(len(engine.diagnostics.timeline)))], "level string, message string")


def cache_statistics(spark, sf_dir):
    engine = Engine(spark, MODULE).source("IN", shop(spark, sf_dir))
    rows = [("before", sum(engine.cache_statistics().values())), ("kept", sum(engine.cache().cache_statistics().values()))]
    engine.clear_caches()
    return spark.createDataFrame([*rows, ("cleared", sum(engine.cache_statistics().values()))], "state string, tables long")


def plan_text(spark, sf_dir):
    plan = Engine(spark, MODULE).source("IN", shop(spark, sf_dir)).explain("Shop!Customer.allInstances()->select(c | c.acctbal > 5000)->collect(c | Tuple{k = c.custkey})")
    return spark.createDataFrame([(x, x in plan) for x in ("PushedFilters", "ReadSchema", "BroadcastHashJoin")], "part string, found boolean")


def model_all_elements(spark, sf_dir):
    return shop(spark, sf_dir).all_elements().groupBy(F.col("_class").alias("cls")).agg(F.count(F.lit(1)).alias("n"))


def model_find(spark, sf_dir):
    return shop(spark, sf_dir).find("Customer", lambda f: (f("acctbal") > 9500) & (f("mktsegment") == "BUILDING")).select(F.col("_id").alias("id"))


def model_contains(spark, sf_dir):
    ids = spark.range(0, 40).select(F.concat(F.lit("Nation:"), F.col("id").cast("string")).alias("_id"))
    return shop(spark, sf_dir).contains(ids).select(F.col("_id").alias("id"))


def model_element(spark, sf_dir):
    return shop(spark, sf_dir).element("Order:7").select(F.col("_id").alias("id"), F.col("_class").alias("cls"))


def _writable(spark, sf_dir):
    source = shop(spark, sf_dir)
    model = Model(source.metamodel, {"Region": source.tables["Region"], "Nation": source.tables["Nation"]}, writable=True)
    model.add("Region", spark.createDataFrame([(100, "ATLANTIS")], "r_regionkey int, r_name string"))
    model.remove("Nation", source.tables["Nation"].where("n_regionkey = 2").select("n_nationkey"))
    return model


def model_add_remove(spark, sf_dir):
    tables = _writable(spark, sf_dir).tables
    return tables["Region"].select(F.lit("Region").alias("cls"), F.col("r_name").alias("name")).union(tables["Nation"].select(F.lit("Nation"), "n_name"))


def model_statistics(spark, sf_dir):
    model = _writable(spark, sf_dir)
    made = model.statistics()
    model.clear_tracking()
    return spark.createDataFrame([("tracked", made["total"], made["created"]), ("cleared", model.statistics()["total"], model.statistics()["created"])], "state string, total long, created long")


def model_names(spark, sf_dir):
    """A model answers to its alias and to its metamodel's name."""
    model = shop(spark, sf_dir)
    one = Engine(spark, MODULE).source("IN", model).evaluate("Shop!Region.allInstances()->collect(r | Tuple{by = 'metamodel', name = r.name})")
    return one.union(Engine(spark, MODULE).source("IN", model).evaluate("IN!Region.allInstances()->collect(r | Tuple{by = 'alias', name = r.name})"))


def helper_recursive_elements(spark, sf_dir):
    """Helpers that call themselves on other elements: up a chain of references, and down over collections."""
    mm = Metamodel("Tree")
    mm.add("Node", {"id": ("Integer", "c_custkey"), "name": ("String", "c_name")}, [Reference("parent", "Node", "parent"), Reference("children", "Node", opposite="parent")], "id")
    nodes = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2)).alias("parent"))
    module = """module T; create OUT : Out from IN : Tree;
    helper context Tree!Node def : depth : Integer = if self.parent.oclIsUndefined() then 0 else self.parent.depth + 1 endif;
    helper context Tree!Node def : size() : Integer = 1 + self.children->collect(c | c.size())->sum();"""
    return Engine(spark, module).source("IN", Model(mm, {"Node": nodes})).evaluate("Tree!Node.allInstances()->collect(n | Tuple{k = n.id, d = n.depth, s = n.size()})")


def sorted_rows(spark, sf_dir):
    return Engine(spark, MODULE).source("IN", shop(spark, sf_dir)).evaluate("Shop!Customer.allInstances()->select(c | c.acctbal > 0)->sortedBy(c | c.name.reverse())->collect(c | Tuple{k = c.custkey})", position="i")


# Text and files

TEXT = """-- @path Shop=shop.ecore
module Texts; create OUT : Out from IN : Shop;
helper context Shop!Order def : big(least : Real) : Boolean = self.totalprice > least and not (self.orderstatus = 'P');
helper def : pair : TupleType(a : Integer, b : String) = Tuple{a = -3, b = 'x'};
query open = Shop!Order.allInstances()->select(o | o.big(1.5))->iterate(o; n : Integer = 0 | if o.orderkey > 2 then n + 1 else n endif);
query list = let x : Sequence(Integer) = Sequence{1, 2, 3} in Map{('k', x->collect(y | y * y)->sum())}.get('k');
rule One { from o : Shop!Order (o.big(10)) using { k : Integer = 1; } to t : Out!Thing (key <- o.orderkey, other <- u), u : Out!Other (n <- k) do { u.name <- 'n'; } }
lazy rule Two { from o : Shop!Order to t : Out!Thing (key <- OclUndefined) }
rule Three(name : String) { to t : Out!Thing (key <- name.size()) }
"""
ECORE = """<ecore:EPackage xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:ecore="http://www.eclipse.org/emf/2002/Ecore" name="Shop" nsURI="urn:shop" nsPrefix="s">
<eClassifiers xsi:type="ecore:EClass" name="Thing"><eStructuralFeatures xsi:type="ecore:EAttribute" name="id" eType="ecore:EDataType http://www.eclipse.org/emf/2002/Ecore#//EInt" iD="true"/></eClassifiers>
<eClassifiers xsi:type="ecore:EClass" name="Order" eSuperTypes="#//Thing"><eStructuralFeatures xsi:type="ecore:EAttribute" name="price" eType="ecore:EDataType http://www.eclipse.org/emf/2002/Ecore#//EDouble"/><eStructuralFeatures xsi:type="ecore:EReference" name="next" eType="#//Order"/></eClassifiers></ecore:EPackage>"""


def _outline(spark, module):
    rows = [("helper", h.name, h.context or "") for h in module.helpers] + [("query", q.name, "") for q in module.queries]
    rows += [(r.kind, r.name, ",".join(f"{t.var}:{len(t.bindings)}" for t in r.targets)) for r in module.rules]
    return spark.createDataFrame(rows, "kind string, name string, detail string")


def parse_text(spark, sf_dir):
    return _outline(spark, parse_module(TEXT))


def parse_file_and_metamodel(spark, sf_dir):
    """A module's file, the metamodel that its @path names beside it, and the classes' features."""
    with tempfile.TemporaryDirectory() as folder:  # read by the driver alone
        Path(folder, "texts.atl").write_text(TEXT, encoding="utf-8")
        Path(folder, "shop.ecore").write_text(ECORE, encoding="utf-8")
        module, metamodels = load_module(Path(folder, "texts.atl"))
    shop_model = metamodels["Shop"]
    rows = [("path", n, p) for n, p in module.paths] + [("feature", c, ",".join(shop_model.features(c))) for c in shop_model.classes]
    return spark.createDataFrame(rows, "kind string, name string, detail string")


def xmi_module_round_trip(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:
        save_module(parse_module(TEXT), Path(folder, "m.xmi"))
        back = load_module(Path(folder, "m.xmi"))[0]
    if back != parse_module(TEXT):
        raise ValueError("the module changed on its way through XMI")
    return _outline(spark, back)


def xmi_expression_round_trip(spark, sf_dir):
    """The catalogue's expressions, equal (and of equal hash) after XMI."""
    rows = []
    for name, (text, _) in EXPRESSIONS.items():
        e = parse_expression(text)
        back = expression_from_xmi(expression_to_xmi(e))
        rows.append((name, back == e and hash(back) == hash(e)))
    return spark.createDataFrame(rows, "name string, same boolean").where("not same").agg(F.count(F.lit(1)).alias("changed"))


def parse_with_errors(spark, sf_dir):
    """Declarations that do not parse are left out and reported."""
    errors: list = []
    module = parse_module("module E; query a = 1 + ; query b = 2; rule R { from } helper def : c : Integer = 3;", errors)
    return spark.createDataFrame([("query", q.name) for q in module.queries] + [("helper", h.name) for h in module.helpers] + [("error", str(e.line)) for e in errors], "kind string, name string")


def error_kinds(spark, sf_dir):
    """The error of each wrong expression or rule: alias and feature checks, arity, operations, types."""
    engine = Engine(spark, MODULE).source("IN", shop(spark, sf_dir))
    target = Metamodel("Out")
    target.add("Thing", {"key": "Integer"})
    rule = "module E; create OUT : Out from %s : Shop; rule R { from r : Shop!Region to t : Out!Thing (%s <- r.name) }"
    cases = {
        "variable": lambda: engine.evaluate("nothing + 1"), "helper": lambda: engine.evaluate("nothing(1)"), "arity": lambda: engine.evaluate("factorial(1, 2)"),
        "feature": lambda: engine.evaluate("Shop!Region.allInstances()->collect(r | r.size)"), "operation": lambda: engine.evaluate("5.nothing()"), "type": lambda: engine.evaluate("Shop!Region.allInstances()->select(r | r.name > 3)"),
        "class": lambda: engine.evaluate("Shop!Nothing.allInstances()"), "zero": lambda: engine.constant("1 / 0"), "parse": lambda: engine.evaluate("1 +"),
        "alias": lambda: Engine(spark, rule % ("IN", "key")).run(), "target feature": lambda: Engine(spark, rule % ("IN", "other")).source("IN", shop(spark, sf_dir)).run({"Out": target}),
    }
    rows = []
    for name, case in cases.items():
        try:
            case()
            rows.append((name, "none"))
        except MorphError as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "name string, error string")


def method_signatures(spark, sf_dir):
    return spark.createDataFrame([(signature("power", ["Integer", "Integer"]),), (signature("including", [CollType("Set", "String"), "OclAny"]),), (signature("toString", ["OclVoid"]),)], "signature string")


ACC = "'C2A#a#Customer:' || cast(c_custkey as varchar(20))"
BOOK = "select 'Book#b#Customer:' || cast(c_custkey as varchar(20)) as id, cast(row_number() over (partition by c_custkey order by %s) - 1 as integer) as i, %s as v from customer join orders on o_custkey=c_custkey where c_acctbal > 5000"
OUTLINE = "select * from (values ('helper', 'big', 'Shop!Order'), ('helper', 'pair', ''), ('query', 'open', ''), ('query', 'list', ''), ('matched', 'One', 't:2,u:2'), ('lazy', 'Two', 't:1'), ('called', 'Three', 't:1')) t(kind, name, detail)"
RULE_SQL = {
    "ordered_binding": BOOK % ("o_totalprice desc, o_orderkey", "o_orderkey"),
    "ordered_references": BOOK % ("o_totalprice desc, o_orderkey", "'Bill#b#Order:' || cast(o_orderkey as varchar(20))") + " and o_orderstatus <> 'P'",
    "targets_beside_references": "select 'Book#b#Customer:' || cast(c_custkey as varchar(20)) as id, cast(0 as integer) as i, 'Book#t#Customer:' || cast(c_custkey as varchar(20)) as v from customer where c_acctbal > 5000 union all select id, i + 1, v from ("
    + BOOK % ("o_orderkey", "'Bill#b#Order:' || cast(o_orderkey as varchar(20))") + " and o_orderstatus = 'F')",
    "do_block": "select c_custkey as k, c_name as name from customer where c_acctbal > 5000",
    "bare_class_using": "select lower(n_name) as name, r_name as region from nation left join region on n_regionkey=r_regionkey where n_nationkey < 10",
    "rule_over_supertype": "select 'Side#d#Customer:' || c_name as id, c_name as name from customer where c_acctbal < 0 union all select 'Side#d#Supplier:' || s_name, s_name from supplier where s_acctbal < 0",
    "strict_references": "select * from (values (cast(1000 as bigint), 'resolved'), (0, 'no target')) t(nations, outcome)",
    "find_element": "select 'OUT' as model, 'Bill#b#Order:1' as id, 'Bill' as cls from orders where o_orderkey = 1 and o_orderstatus <> 'P' union all select 'IN', 'Nation:3', 'Nation'",
    "extent_by_name": "select lower(n_name) as name from nation where n_nationkey < 10 union all select r_name from region",
    "run_report": "select 'rule' as what, 'Bill' as name, (select count(*) from orders where o_orderstatus <> 'P') as n union all select 'rule', 'Book', (select count(*) from customer where c_acctbal > 5000) union all select 'rule', 'Bare', 10 union all select 'rule', 'Side', (select count(*) from customer where c_acctbal < 0) + (select count(*) from supplier where s_acctbal < 0)"
    " union all select 'class', 'OUT!Bill', (select count(*) from orders where o_orderstatus <> 'P') union all select 'class', 'OUT!Book', (select count(*) from customer where c_acctbal > 5000) union all select 'class', 'OUT!Tab', (select count(*) from customer where c_acctbal > 5000) union all select 'class', 'OUT!Land', 10 union all select 'class', 'OUT!Debt', (select count(*) from customer where c_acctbal < 0) + (select count(*) from supplier where s_acctbal < 0)",
    "run_metrics": "select * from (values ('helper rich', true), ('navigation Nation', true), ('navigation Region', true)) t(what, used)",
    "run_diagnostics": "select * from (values ('error', 'MissingModel'), ('warning', 'query open without ;'), ('warning', 'query open without ;'), ('event', 'rule R planned'), ('left', '0')) t(level, message)",
    "cache_statistics": "select * from (values ('before', cast(0 as bigint)), ('kept', 11), ('cleared', 0)) t(state, tables)",
    "plan_text": "select * from (values ('PushedFilters', true), ('ReadSchema', true), ('BroadcastHashJoin', false)) t(part, found)",
    "model_all_elements": " union all ".join(f"select '{c}' as cls, count(*) as n from {t}" for c, t in (("Region", "region"), ("Nation", "nation"), ("Customer", "customer"), ("Supplier", "supplier"), ("Part", "part"), ("Order", "orders"), ("Event", "events"), ("Document", "documents"), ("Label", "labels"))),
    "model_find": "select 'Customer:' || cast(c_custkey as varchar(20)) as id from customer where c_acctbal > 9500 and c_mktsegment = 'BUILDING'",
    "model_contains": "select 'Nation:' || cast(n_nationkey as varchar(20)) as id from nation where n_nationkey < 40",
    "model_element": "select 'Order:7' as id, 'Order' as cls from orders where o_orderkey = 7",
    "model_add_remove": "select 'Region' as cls, r_name as name from region union all select 'Region', 'ATLANTIS' union all select 'Nation', n_name from nation where n_regionkey <> 2",
    "model_statistics": "select state, r + n as total, created from (values ('tracked', cast(1 as bigint)), ('cleared', 0)) t(state, created), (select count(*) + 1 as r from region), (select count(*) as n from nation where n_regionkey <> 2)",
    "model_names": "select b as by, r_name as name from region, (values ('metamodel'), ('alias')) t(b)",
    "helper_recursive_elements": "with recursive up(k, a, d) as (select c_custkey, c_custkey, cast(0 as bigint) from customer where c_custkey >= 0 union all select k, a // 2, d + 1 from up where a > 1) select k, max(d) as d, any_value(s) as s from up join (select a as b, count(*) as s from up group by a) on b=k group by k",
    "sorted_rows": "select c_custkey as k, row_number() over (order by reverse(c_name), c_custkey) as i from customer where c_acctbal > 0",
    "parse_text": OUTLINE, "xmi_module_round_trip": OUTLINE,
    "parse_file_and_metamodel": "select * from (values ('path', 'Shop', 'shop.ecore'), ('feature', 'Thing', 'id'), ('feature', 'Order', 'id,price,next')) t(kind, name, detail)",
    "xmi_expression_round_trip": "select cast(0 as bigint) as changed",
    "parse_with_errors": "select * from (values ('query', 'b'), ('helper', 'c'), ('error', '1'), ('error', '1')) t(kind, name)",
    "error_kinds": "select * from (values ('variable', 'UnknownVariable'), ('helper', 'UnknownHelper'), ('arity', 'InvalidOperation'), ('feature', 'UnknownFeature'), ('operation', 'UnknownOperation'), ('type', 'TypeMismatch'), ('class', 'UnknownClass'), ('zero', 'DivisionByZero'), ('parse', 'ParseError'), ('alias', 'MissingModel'), ('target feature', 'UnknownFeature')) t(name, error)",
    "method_signatures": "select * from (values ('power(Integer,Integer)'), ('including(Set,OclAny)'), ('toString(OclVoid)')) t(signature)",
    "flagship_rule": "select 'Customer2Account#a#Customer:' || cast(c_custkey as varchar(20)) as id, c_name as owner, n_name as nation, c_mktsegment as segment from customer left join nation on c_nationkey=n_nationkey where c_acctbal > 0",
    "rule_two_targets": f"select 'Account' as cls, {ACC} as id, c_name as v from customer where c_acctbal > 9000 union all select 'Badge', 'C2A#b#Customer:' || cast(c_custkey as varchar(20)), {ACC} from customer where c_acctbal > 9000",
    "rule_overlap": "select 'Emp' as cls, c_custkey as k from customer union all select 'Mgr', c_custkey from customer where c_acctbal >= 5000",
    "multi_source_cross": "select cast(r_regionkey as bigint) as r, cast(n_nationkey as bigint) as n from region cross join nation where n_regionkey <> r_regionkey",
    "trace_links": "select 'N2C' as rule, 'c' as pattern_var, 'Nation:' || cast(n_nationkey as varchar(20)) as source_id, 'N2C#c#Nation:' || cast(n_nationkey as varchar(20)) as target_id from nation where n_regionkey < 3",
    "resolve_temp": "select s_suppkey as k, case when n_nationkey is not null then 'N2C#c#Nation:' || cast(n_nationkey as varchar(20)) end as country from supplier left join (select * from nation where n_regionkey < 3) m on s_nationkey=n_nationkey",
    "implicit_resolution": "select s_suppkey as k, case when n_nationkey is not null then 'N2C#c#Nation:' || cast(n_nationkey as varchar(20)) end as country from supplier left join (select * from nation where n_regionkey < 3) m on s_nationkey=n_nationkey",
    "lazy_rule_memo": "select distinct 'MakeSegment#s#' || c_mktsegment as id, c_mktsegment as name from customer",
    "lazy_rule_in_collect": "select 'Pack' as cls, 'Big#p#Customer:' || cast(c_custkey as varchar(20)) as id, cast(null as varchar(60)) as owner from customer where c_acctbal > 9000 union all select 'Item', 'MakeItem#i#Order:' || cast(o_orderkey as varchar(20)), 'Big#p#Customer:' || cast(c_custkey as varchar(20)) from customer join orders on o_custkey=c_custkey where c_acctbal > 9000",
    "called_rule": "select 'MakeSegment#s#' || r_name as id, r_name as name from region",
}

QUERIES = {n: _expression(n) for n in EXPRESSIONS} | {f.__name__: f for f in (
    flagship_rule, rule_two_targets, rule_overlap, multi_source_cross, trace_links, resolve_temp, implicit_resolution, lazy_rule_memo, lazy_rule_in_collect, called_rule,
    ordered_binding, ordered_references, targets_beside_references, do_block, bare_class_using, rule_over_supertype, strict_references, find_element, extent_by_name, run_report, run_metrics, run_diagnostics, cache_statistics, plan_text,
    model_all_elements, model_find, model_contains, model_element, model_add_remove, model_statistics, model_names, sorted_rows, helper_recursive_elements,
    parse_text, parse_file_and_metamodel, xmi_module_round_trip, xmi_expression_round_trip, parse_with_errors, error_kinds, method_signatures)}
ORACLES = {n: sql for n, (_, sql) in EXPRESSIONS.items()} | RULE_SQL
