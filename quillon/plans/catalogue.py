"""Named queries over the driver's tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import showcase

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

FLAGSHIP = """
SELECT region.r_name, AVG(lineitem.l_quantity) AS avg_qty, COUNT(*) AS n
FROM lineitem
JOIN orders ON lineitem.l_orderkey = orders.o_orderkey
JOIN customer ON orders.o_custkey = customer.c_custkey
JOIN nation ON customer.c_nationkey = nation.n_nationkey
JOIN region ON nation.n_regionkey = region.r_regionkey
JOIN part ON lineitem.l_partkey = part.p_partkey
JOIN supplier ON lineitem.l_suppkey = supplier.s_suppkey
WHERE part.p_type = 'ECONOMY' AND orders.o_orderstatus = 'F'
GROUP BY region.r_name
"""

_w = "partition by o_custkey order by o_orderkey"

#: One text for both engines.
SHARED: dict[str, str] = {
    "flagship": FLAGSHIP,
    # projection, filter, predicates
    "project_filter": "select n_name as name, n_nationkey as k from nation where n_regionkey = 1 and n_name like '%A%'",
    "string_literal_filter": "select p_partkey from part where cast(p_size as varchar(10)) = '8' and p_brand is not null",
    "predicates": "select o_orderkey from orders where (o_orderstatus in ('F', 'P') or not o_totalprice between 1000 and 400000) and o_orderpriority is not null and o_orderpriority not like '5%'",
    "case_coalesce": "select cast(sum(case when o_orderpriority like '1-%' then 1 else 0 end) as bigint) a, max(coalesce(nullif(1, 1), 2)) b from orders",
    # joins
    "join_left": "select n_name, count(s_suppkey) n from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 5000 group by n_name",
    "join_right": "select n_name, s_suppkey from supplier right join nation on s_nationkey = n_nationkey",
    "join_full": "select n_nationkey, s_suppkey from nation full outer join supplier on s_nationkey = n_nationkey and s_acctbal > 9000",
    "join_cross": "select r_name, n_name from region cross join nation",
    "join_natural": "select count(*) n from nation natural join (select s_nationkey n_nationkey from supplier) s",
    "join_using": "select count(*) n from nation join (select s_nationkey n_nationkey from supplier) s using (n_nationkey)",
    "join_semi": "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)",
    "join_anti": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)",
    "join_not_in": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)",
    "join_theta": "select a.n_name x, b.n_name y from nation a join nation b on a.n_nationkey < b.n_nationkey",
    # aggregates
    "group_avg": "select o_orderpriority, avg(o_totalprice) a from orders group by o_orderpriority",
    "group_rollup": "select l_returnflag, l_linestatus, sum(l_quantity) q from lineitem group by rollup (l_returnflag, l_linestatus)",
    "group_cube": "select l_returnflag, l_linestatus, cast(grouping(l_returnflag) as bigint) g, count(*) n from lineitem group by cube (l_returnflag, l_linestatus)",
    "grouping_sets": "select l_returnflag, l_linestatus, count(*) n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())",
    "agg_distinct": "select o_orderstatus, count(distinct o_custkey) n from orders group by o_orderstatus",
    "agg_filter": "select count(*) filter (where l_discount > 0.05) n, sum(l_quantity) filter (where l_tax > 0.04) q from lineitem",
    "agg_having": "select l_suppkey, sum(l_quantity) q from lineitem group by l_suppkey having sum(l_quantity) > 15000",
    "agg_statistics": "select round(stddev(l_quantity), 6) a, round(var_pop(l_quantity), 6) b, round(corr(l_quantity, l_extendedprice), 6) c, round(covar_samp(l_quantity, l_tax), 6) e, round(regr_slope(l_extendedprice, l_quantity), 4) f from lineitem",
    "agg_median": "select median(l_quantity) a from lineitem",
    "agg_bool": "select bool_and(l_tax >= 0) a, bool_or(l_tax > 0.07) b from lineitem",
    "agg_bits": "select bit_xor(l_orderkey) a, bit_and(l_orderkey) b, bit_or(l_orderkey) c from lineitem",
    # windows, order, sets, subqueries
    "window_rank": f"select o_orderkey, cast(row_number() over ({_w}) as bigint) r, cast(rank() over (partition by o_custkey order by o_orderdate) as bigint) k, cast(dense_rank() over (partition by o_custkey order by o_orderdate) as bigint) dk, cast(ntile(4) over ({_w}) as bigint) nt, percent_rank() over ({_w}) pr, cume_dist() over ({_w}) cd from orders",
    "window_navigate": f"select o_orderkey, lag(o_totalprice) over w a, lead(o_totalprice, 1, 0.0) over w b, first_value(o_totalprice) over w c, nth_value(o_totalprice, 2) over w e from orders window w as ({_w})",
    "window_rows": f"select o_orderkey, round(sum(o_totalprice) over ({_w} rows between 2 preceding and current row), 2) a from orders",
    "window_range": "select event_id, count(*) over (partition by user_id order by ts range between interval '1' hour preceding and current row) a from events",
    "top_k": "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 10 offset 5",
    "nulls_first": "select n from (values (1), (null), (2)) t(n) order by n nulls first",
    "union_distinct": "select n_nationkey k from nation union select s_nationkey from supplier",
    "union_all": "select n_nationkey k from nation union all select s_nationkey from supplier",
    "intersect_distinct": "select c_nationkey k from customer intersect select s_nationkey from supplier",
    "intersect_all": "select c_nationkey k from customer intersect all select s_nationkey from supplier",
    "except_distinct": "select n_nationkey k from nation except select s_nationkey from supplier where s_acctbal > 5000",
    "except_all": "select c_nationkey k from customer except all select s_nationkey from supplier",
    "distinct_rows": "select distinct o_orderpriority, o_orderstatus from orders",
    "cte": "with x as (select o_custkey, sum(o_totalprice) t from orders group by o_custkey) select count(*) n from x where t > (select avg(t) from x)",
    "recursive_cte": "with recursive r(n) as (select 1 union all select n + 1 from r where n < 10) select cast(sum(n) as bigint) s from r",
    "scalar_subquery": "select p_partkey from part p where p_retailprice > (select avg(p_retailprice) from part q where q.p_brand = p.p_brand)",
    "lateral": "select n_name, m from nation, lateral (select max(s_acctbal) m from supplier where s_nationkey = n_nationkey) x",
    "pivot": "select * from (select o_orderstatus, o_totalprice from orders) pivot (sum(o_totalprice) for o_orderstatus in ('F' as f, 'O' as o, 'P' as p))",
    # scalar functions
    "string_functions": "select p_partkey, upper(p_name) a, substring(p_name, 2, 3) b, cast(length(p_name) as bigint) c, replace(p_name, ' ', '_') e, concat(p_brand, '-', p_type) f, trim('  x ') g, lpad(p_brand, 10, '*') h, left(p_name, 2) i, reverse(p_name) j, cast(position('r' in p_name) as bigint) k, split_part(p_name, ' ', 1) l, repeat('a', 2) m from part",
    "date_trunc_group": "select date_trunc('month', o_orderdate) m, count(*) n from orders group by 1",
    "date_extract": "select cast(extract(year from o_orderdate) as bigint) y, cast(extract(month from o_orderdate) as bigint) m, count(*) n from orders group by 1, 2",
    "date_interval": "select count(*) n from orders where o_orderdate < timestamp '1998-01-01' + interval '90' day",
    "math_functions": "select l_orderkey, l_linenumber, abs(l_discount - 0.05) a, cast(floor(l_extendedprice) as bigint) c, cast(ceil(l_tax * 100) as bigint) e, power(l_quantity, 2) f, round(sqrt(l_quantity), 9) g, round(ln(l_quantity), 9) h, round(exp(l_discount), 9) i, mod(-l_orderkey, 3) j, cast(sign(l_discount - 0.05) as bigint) k from lineitem",
    "casts": "select cast('12' as int) a, cast(1.26 as decimal(10, 1)) b, cast('2020-01-02' as date) f",
    "tumbling_hours": "select date_trunc('hour', ts) w, event_type, count(*) n, round(avg(value), 9) v from events group by 1, 2",
}

#: (Spark text, DuckDB text); None where DuckDB has no value to compare.
PAIRS: dict[str, tuple[str, str | None]] = {
    "qualify": (
        "select o_orderkey from (select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) rn from orders) where rn = 1",
        "select o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1",
    ),
    "regex": ("select count(*) n from part where p_name rlike '^s.*g$'", "select count(*) n from part where regexp_matches(p_name, '^s.*g$')"),
    "array_size": ("select vec_id, cast(size(embedding) as bigint) n from embeddings", "select vec_id, len(embedding) n from embeddings"),
    "json_path": ("select get_json_object(props, '$.k') k, count(*) n from events group by 1", "select json_extract_string(props, '$.k') k, count(*) n from events group by 1"),
    "unnest": ("select vec_id, round(sum(x), 4) s from (select vec_id, explode(embedding) x from embeddings) group by vec_id", "select vec_id, round(sum(x), 4) s from (select vec_id, unnest(embedding)::double x from embeddings) group by vec_id"),
    "approx_distinct": ("select abs(approx_count_distinct(o_custkey) - count(distinct o_custkey)) <= 0.15 * count(distinct o_custkey) as within from orders", "select true as within"),
    "agg_percentile_approx": ("select l_returnflag, percentile_approx(l_quantity, 0.5, 100000) a from lineitem group by 1", "select l_returnflag, quantile_disc(l_quantity, 0.5) a from lineitem group by 1"),
    "array_transform": (
        "select vec_id, round(aggregate(transform(embedding, x -> cast(x as double) * 2), 0D, (a, x) -> a + x), 4) s from embeddings",
        "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * 2)), 4) s from embeddings",
    ),
    "map_lookup": (
        "select map_from_arrays(array('F', 'O', 'P'), array(1, 2, 3))[o_orderstatus] k, cast(size(map_keys(map('a', 1, 'b', 2))) as bigint) m, count(*) n from orders group by 1, 2",
        "select map(['F', 'O', 'P'], [1, 2, 3])[o_orderstatus] k, len(map_keys(map(['a', 'b'], [1, 2]))) m, count(*) n from orders group by 1, 2",
    ),
    "json_struct": ("select from_json(props, 'k bigint').k k, count(*) n from events group by 1", "select json_extract(props, '$.k')::bigint k, count(*) n from events group by 1"),
    "try_casts": ("select try_cast('x' as int) a, try_cast('7' as int) b, try_cast('2020-02-30' as date) e", "select try_cast('x' as int) a, try_cast('7' as int) b, try_cast('2020-02-30' as date) e"),
}


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs the text with the tables it names registered as views over the folder's Parquet files."""
    for table in TABLES:
        if re.search(rf"\b{table}\b", text):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    texts = SHARED | {name: pair[0] for name, pair in PAIRS.items()}
    plain = {name: (lambda spark, sf_dir, text=text: run_sql(spark, sf_dir, text)) for name, text in texts.items()}
    return plain | {name: query for name, (query, _) in showcase.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = SHARED | {name: pair[1] for name, pair in PAIRS.items()} | {name: sql for name, (_, sql) in showcase.QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
