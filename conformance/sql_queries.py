"""SQL text over a registered table."""

from conformance import sql_query

QUERIES = {
    "sql_project": sql_query(
        "part",
        """SELECT p_partkey, split_part(p_name, ' ', 1) AS colour, split_part(p_name, ' ', 2) AS thing,
               split_part(p_name, ' ', 9) AS nothing, CAST(substring(p_brand, 7) AS INT) AS brand_no,
               CAST(p_size AS DOUBLE) / 2 AS half_size, round(p_retailprice * 1.1, 2) AS gross
           FROM source_data""",
    ),
    "sql_filter": sql_query(
        "lineitem",
        """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM source_data
           WHERE l_returnflag IN ('A', 'R') AND l_linestatus <> 'O' AND l_quantity BETWEEN 10 AND 20
             AND l_discount > 0.02 AND l_tax IS NOT NULL AND NOT (l_shipdate < TIMESTAMP_NTZ '1995-01-01 00:00:00')
             AND CAST(l_partkey AS STRING) RLIKE '[1-5]$' AND CAST(l_suppkey AS STRING) LIKE '%1%'""",
        """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM source_data
           WHERE l_returnflag IN ('A', 'R') AND l_linestatus <> 'O' AND l_quantity BETWEEN 10 AND 20
             AND l_discount > 0.02 AND l_tax IS NOT NULL AND NOT (l_shipdate < TIMESTAMP '1995-01-01 00:00:00')
             AND regexp_matches(CAST(l_partkey AS VARCHAR), '[1-5]$') AND CAST(l_suppkey AS VARCHAR) LIKE '%1%'""",
    ),
    "sql_self_join": sql_query(
        "conversations",
        """SELECT a.conv_id, a.turn, a.role, b.role AS next_role,
               CAST(length(b.text) - length(a.text) AS INT) AS longer_by, c.turn AS previous_turn
           FROM source_data a
           LEFT JOIN source_data b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
           LEFT JOIN source_data c
             ON c.conv_id = a.conv_id AND c.turn = a.turn - 1 AND length(c.text) < length(a.text)""",
    ),
    "sql_full_join": sql_query(
        "documents",
        """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.lang, l.quality, l.toxic
           FROM (SELECT * FROM source_data WHERE n_chars > 400) d
           FULL OUTER JOIN labels l ON l.doc_id = d.doc_id""",
        views=("labels",),
    ),
    "sql_join_views": sql_query(
        "lineitem",
        """SELECT n_name, CAST(year(o_orderdate) AS INT) AS year, count(*) AS lines,
               round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
           FROM source_data JOIN orders ON o_orderkey = l_orderkey
           JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
           GROUP BY n_name, year(o_orderdate)""",
        views=("orders", "customer", "nation"),
    ),
    "sql_semi_anti": sql_query(
        "customer",
        """SELECT c_custkey, 'large orders' AS kind FROM source_data
           WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
           UNION ALL
           SELECT c_custkey, 'no urgent order' AS kind FROM source_data
           WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
           UNION ALL
           SELECT c_custkey, 'open orders' AS kind FROM source_data
           WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""",
        views=("orders",),
    ),
    "sql_group_agg": sql_query(
        "lineitem",
        """SELECT l_returnflag, l_linestatus, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers,
               round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount,
               min(l_shipdate) AS first_ship, max(l_extendedprice) AS top_price,
               count(*) FILTER (WHERE l_tax > 0.04) AS taxed
           FROM source_data GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""",
    ),
    "sql_cube": sql_query(
        "orders",
        """SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS no_status,
               CAST(grouping(o_orderpriority) AS INT) AS no_priority, count(*) AS orders, round(sum(o_totalprice), 2) AS total
           FROM source_data GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    ),
    "sql_rollup": sql_query(
        "customer",
        """SELECT c_nationkey, c_mktsegment, count(*) AS customers, round(avg(c_acctbal), 4) AS balance
           FROM source_data GROUP BY ROLLUP (c_nationkey, c_mktsegment)""",
    ),
    "sql_grouping_sets": sql_query(
        "events",
        """SELECT event_type, CAST(hour(ts) AS INT) AS hour, count(*) AS events, max(value) AS top
           FROM source_data GROUP BY GROUPING SETS ((event_type, hour(ts)), (event_type), ())""",
    ),
    "sql_window_rank": sql_query(
        "orders",
        """SELECT o_custkey, o_orderkey, CAST(place AS INT) AS place, CAST(dense AS INT) AS dense, CAST(quarter AS INT) AS quarter FROM (
               SELECT o_custkey, o_orderkey,
                   row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place,
                   dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dense,
                   ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS quarter
               FROM source_data) ranked
           WHERE place <= 3""",
        """SELECT o_custkey, o_orderkey,
               CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS place,
               CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INT) AS dense,
               CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS quarter
           FROM source_data QUALIFY place <= 3""",
    ),
    "sql_window_frame": sql_query(
        "events",
        """SELECT event_id, user_id, lag(event_type) OVER w AS previous, lead(value, 2, -1.0) OVER w AS later,
               round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                   ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 2) AS recent,
               count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS so_far,
               first_value(value) OVER w AS first_value
           FROM source_data WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    ),
    "sql_topk": sql_query(
        "lineitem",
        """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM source_data
           ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 50""",
    ),
    "sql_set_ops": sql_query(
        "orders",
        """(SELECT o_custkey AS k, 'both' AS side FROM source_data WHERE o_orderstatus = 'F'
            INTERSECT SELECT o_custkey, 'both' FROM source_data WHERE o_orderstatus = 'O')
           UNION ALL
           (SELECT o_custkey, 'only P' FROM source_data WHERE o_orderstatus = 'P'
            EXCEPT SELECT o_custkey, 'only P' FROM source_data WHERE o_orderstatus = 'F')
           UNION
           SELECT o_custkey, 'any' FROM source_data""",
    ),
    "sql_cte_subquery": sql_query(
        "orders",
        """WITH recent AS (SELECT * FROM source_data WHERE year(o_orderdate) >= 1997),
                typical AS (SELECT o_custkey AS k, avg(o_totalprice) AS price FROM recent GROUP BY o_custkey)
           SELECT o_orderkey, o_custkey, o_totalprice FROM recent r
           WHERE o_totalprice > 1.5 * (SELECT price FROM typical WHERE k = r.o_custkey)
             AND o_totalprice < (SELECT max(o_totalprice) FROM source_data)""",
    ),
    "sql_string": sql_query(
        "customer",
        """SELECT c_custkey, upper(c_mktsegment) AS up, lower(substring(c_name, 1, 4)) AS low,
               concat_ws('/', c_mktsegment, c_name) AS path, CAST(length(c_name) AS INT) AS name_length,
               replace(c_name, '#', '-') AS dashed, regexp_replace(c_name, '0+', '0') AS short_name,
               lpad(CAST(c_nationkey AS STRING), 3, '0') AS padded, reverse(c_mktsegment) AS backwards,
               trim(split_part(c_name, '#', 2)) AS number_text, CAST(instr(c_name, '#') AS INT) AS hash_at
           FROM source_data""",
        """SELECT c_custkey, upper(c_mktsegment) AS up, lower(substring(c_name, 1, 4)) AS low,
               concat_ws('/', c_mktsegment, c_name) AS path, CAST(length(c_name) AS INT) AS name_length,
               replace(c_name, '#', '-') AS dashed, regexp_replace(c_name, '0+', '0', 'g') AS short_name,
               lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS padded, reverse(c_mktsegment) AS backwards,
               trim(split_part(c_name, '#', 2)) AS number_text, CAST(instr(c_name, '#') AS INT) AS hash_at
           FROM source_data""",
    ),
    "sql_date": sql_query(
        "orders",
        """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(year(o_orderdate) AS INT) AS year,
               CAST(quarter(o_orderdate) AS INT) AS quarter, date_format(o_orderdate, 'yyyy/MM/dd') AS day_text,
               CAST(o_orderdate + INTERVAL 90 DAY AS DATE) AS due, CAST(dayofyear(o_orderdate) AS INT) AS day_no,
               datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS days_left, last_day(o_orderdate) AS month_end
           FROM source_data""",
        """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(year(o_orderdate) AS INT) AS year,
               CAST(quarter(o_orderdate) AS INT) AS quarter, strftime(o_orderdate, '%Y/%m/%d') AS day_text,
               CAST(o_orderdate + INTERVAL 90 DAY AS DATE) AS due, CAST(dayofyear(o_orderdate) AS INT) AS day_no,
               CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INT) AS days_left, last_day(o_orderdate) AS month_end
           FROM source_data""",
    ),
    "sql_math": sql_query(
        "lineitem",
        """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity AS unit_price,
               CAST(floor(l_extendedprice) AS BIGINT) AS whole, CAST(ceil(l_discount * 10) AS BIGINT) AS tenths,
               abs(l_quantity - 25) AS off, l_orderkey % 7 AS weekday, round(power(l_quantity, 2), 2) AS squared,
               round(sqrt(l_quantity), 6) AS root, CAST(sign(l_quantity - 25) AS INT) AS side, round(ln(l_quantity), 6) AS logarithm,
               greatest(l_tax, l_discount) AS larger
           FROM source_data""",
    ),
    "sql_array_map": sql_query(
        "documents",
        """SELECT doc_id, words[0] AS first_word, get(words, 4) AS fifth_word, size(words) AS n_words,
               array_join(slice(words, 1, 3), '-') AS opening, size(filter(words, w -> length(w) > 6)) AS long_words,
               size(array_distinct(words)) AS different, aggregate(transform(words, w -> length(w)), 0, (a, b) -> a + b) AS letters,
               array_join(map_keys(map('lang', lang, 'source', source)), ',') AS keys,
               element_at(map('lang', lang, 'source', source), 'lang') AS lang_value
           FROM (SELECT doc_id, lang, source, split(text, ' ') AS words FROM source_data) d""",
        """SELECT doc_id, words[1] AS first_word, words[5] AS fifth_word, CAST(len(words) AS INT) AS n_words,
               array_to_string(words[1:3], '-') AS opening, CAST(len(list_filter(words, lambda w: length(w) > 6)) AS INT) AS long_words,
               CAST(len(list_distinct(words)) AS INT) AS different, CAST(list_sum(list_transform(words, lambda w: length(w))) AS INT) AS letters,
               'lang,source' AS keys, lang AS lang_value
           FROM (SELECT doc_id, lang, source, string_split(text, ' ') AS words FROM source_data) d""",
        costly=True,
    ),
    "sql_json": sql_query(
        "events",
        """SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k,
               try_variant_get(try_parse_json(props), '$.missing', 'int') AS missing,
               json_array_length(concat('[', props, ',', props, ']')) AS items,
               to_json(named_struct('id', event_id, 'type', event_type)) AS packed
           FROM source_data""",
        """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k,
               CAST(json_extract_string(props, '$.missing') AS INT) AS missing,
               CAST(json_array_length('[' || props || ',' || props || ']') AS INT) AS items,
               CAST(to_json({'id': event_id, 'type': event_type}) AS VARCHAR) AS packed
           FROM source_data""",
    ),
}
