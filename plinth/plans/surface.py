"""Queries over the dialect's surface: what clients send besides plain SQL. name -> (engine's text, oracle's text)."""

SQL: dict = {
    # literals and names
    "string_backslash": (r"SELECT p_partkey, 'a\nb' AS raw, length('a\nb') AS n, E'x\ty' AS tab, p_name ~ '^\w+ \w+$' AS two FROM part", r"SELECT p_partkey, 'a\nb' AS raw, CAST(4 AS INTEGER) AS n, 'x' || chr(9) || 'y' AS tab, regexp_matches(p_name, '^\w+ \w+$') AS two FROM part"),
    "string_variables": ("SELECT n_nationkey, '${env:HOME}' AS s FROM nation", "SELECT n_nationkey, '${env:HOME}' AS s FROM nation"),
    "like_escape": (r"SELECT n_name, n_name LIKE 'NATION\_1%' AS exact FROM nation", r"SELECT n_name, n_name LIKE 'NATION\_1%' ESCAPE '\' AS exact FROM nation"),
    "equals_twice": ("SELECT n_nationkey FROM nation WHERE n_name == 'NATION_3'", "SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3'"),
    "three_part_names": ("SELECT public.nation.n_name, nation.n_regionkey FROM public.nation WHERE public.nation.n_nationkey < 9 ORDER BY public.nation.n_name", "SELECT n_name, n_regionkey FROM nation WHERE n_nationkey < 9"),
    "named_as_table": ("WITH t AS (SELECT n_regionkey AS k FROM nation) SELECT t.k AS t, count(*) AS n FROM t GROUP BY t", "SELECT n_regionkey AS t_, count(*) AS n FROM nation GROUP BY 1"),
    "json_arrow_name": ("SELECT event_id, props->'k' FROM events", "SELECT event_id, CAST(props->'k' AS VARCHAR) AS props_k FROM events"),
    "is_null": ("SELECT n_nationkey, nullif(n_regionkey, 2) IS NULL AS a, nullif(n_regionkey, 2) IS NOT NULL AS b FROM nation", "SELECT n_nationkey, nullif(n_regionkey, 2) IS NULL AS a, nullif(n_regionkey, 2) IS NOT NULL AS b FROM nation"),
    "collate": ("SELECT n_name FROM nation WHERE n_name OPERATOR(pg_catalog.~) '^(NATION_1.*)$' COLLATE pg_catalog.default", "SELECT n_name FROM nation WHERE regexp_matches(n_name, '^(NATION_1.*)$')"),
    "from_less": ("SELECT 1 + 2 AS three, 'a' || 'b' AS ab", "SELECT CAST(3 AS INTEGER) AS three, 'ab' AS ab"),
    # DISTINCT ON
    "distinct_on_limit": ("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey DESC, o_totalprice, o_orderkey LIMIT 12", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1 ORDER BY o_custkey DESC LIMIT 12"),
    "distinct_on_expression": ("SELECT DISTINCT ON (o_custkey % 7) o_custkey % 7 AS k, lower(o_orderpriority) AS p, o_orderkey FROM orders ORDER BY 1, o_orderkey", "SELECT o_custkey % 7 AS k, lower(o_orderpriority) AS p, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) = 1"),
    "distinct_on_inside": ("SELECT count(*) AS n, sum(o_orderkey) AS keys FROM (SELECT DISTINCT ON (o_custkey) * FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey) x", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1)"),
    # arrays
    "array_subquery_other_order": ("SELECT r_regionkey, array_to_string(ARRAY(SELECT n_name FROM nation WHERE n_regionkey = 1 ORDER BY n_nationkey DESC), ',') AS s FROM region", "SELECT r_regionkey, (SELECT string_agg(n_name, ',' ORDER BY n_nationkey DESC) FROM nation WHERE n_regionkey = 1) AS s FROM region"),
    "array_subquery_correlated": ("SELECT r_regionkey, array_to_string(ARRAY(SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_nationkey DESC), ',') AS s FROM region", "SELECT r_regionkey, (SELECT string_agg(n_name, ',' ORDER BY n_nationkey DESC) FROM nation WHERE n_regionkey = r_regionkey) AS s FROM region"),
    "array_subquery_limit": ("SELECT array_to_string(ARRAY(SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5), ',') AS s", "SELECT string_agg(o_orderkey, ',' ORDER BY o_totalprice DESC, o_orderkey) AS s FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)"),
    "any_empty": ("SELECT n_nationkey FROM nation WHERE n_name = ANY('{}') OR n_nationkey = 3", "SELECT n_nationkey FROM nation WHERE n_nationkey = 3"),
    "any_quoted": ("SELECT n_nationkey FROM nation WHERE concat(n_name, ',', n_regionkey) = ANY('{\"NATION_1,1\",\"NATION_7,2\",x}')", "SELECT n_nationkey FROM nation WHERE n_name || ',' || n_regionkey IN ('NATION_1,1', 'NATION_7,2', 'x')"),
    "any_subquery": ("SELECT n_nationkey FROM nation WHERE n_regionkey = ANY(SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') AND n_nationkey <> ALL(SELECT r_regionkey FROM region)", "SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') AND n_nationkey NOT IN (SELECT r_regionkey FROM region)"),
    "array_text_cast": ("SELECT array_to_string('{a,\"b,c\",\"d \\\"e\"}'::text[], '|') AS s", "SELECT 'a|b,c|d \"e' AS s"),
    "array_to_string_text": ("SELECT main.array_to_string('[1, 2, 3]', '') AS a, pg_catalog.array_to_string('[1, 2, 3]', '-') AS b", "SELECT '123' AS a, '1-2-3' AS b"),
    "expand_array": ("SELECT (information_schema._pg_expandarray(ARRAY[10, 20])).n", "SELECT CAST(n AS BIGINT) AS n FROM (VALUES (1), (2)) t(n)"),
    "expand_array_values": ("SELECT (information_schema._pg_expandarray(ARRAY[10, 20])).x AS value", "SELECT CAST(x AS INTEGER) AS value FROM (VALUES (10), (20)) t(x)"),
    # aggregates
    "agg_string_order": ("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey DESC) AS names, string_agg(n_name) FILTER (WHERE n_nationkey = 3) AS three FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey DESC) AS names, string_agg(n_name, ',') FILTER (WHERE n_nationkey = 3) AS three FROM nation GROUP BY n_regionkey"),
    "agg_array_order": ("SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_nationkey DESC), ',') AS names, array_to_string(array_agg(DISTINCT n_regionkey), ',') AS keys, array_agg(n_name) FILTER (WHERE n_nationkey < 0) IS NULL AS none FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS names, CAST(n_regionkey AS VARCHAR) AS keys, true AS none FROM nation GROUP BY n_regionkey"),
    "agg_jsonb_filter": ("SELECT event_type, jsonb_agg(event_id ORDER BY value DESC, event_id) FILTER (WHERE value > 95) AS ids, jsonb_agg(props->'k' ORDER BY event_id) FILTER (WHERE event_id < 40) AS ks FROM events GROUP BY event_type", "SELECT event_type, CAST(to_json(list(event_id ORDER BY value DESC, event_id) FILTER (WHERE value > 95)) AS VARCHAR) AS ids, '[' || string_agg(CAST(props->'k' AS VARCHAR), ',' ORDER BY event_id) FILTER (WHERE event_id < 40) || ']' AS ks FROM events GROUP BY event_type"),
    "agg_jsonb_object": ("SELECT jsonb_object_agg(r_name, r_regionkey) AS o FROM region WHERE r_regionkey = 2", "SELECT CAST(json_group_object(r_name, r_regionkey) AS VARCHAR) AS o FROM region WHERE r_regionkey = 2"),
    # subqueries
    "scalar_first_row": ("SELECT r_regionkey, (SELECT n_regionkey FROM nation WHERE n_regionkey = r_regionkey) AS k, (SELECT r.r_regionkey FROM region r WHERE r.r_regionkey = 1) + 1 AS two FROM region", "SELECT r_regionkey, r_regionkey AS k, CAST(2 AS INTEGER) AS two FROM region"),
    "except_all": ("SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region"),
    "intersect_all": ("SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT o_custkey % 5 FROM orders WHERE o_orderkey < 40", "SELECT CAST(n_regionkey AS BIGINT) AS k FROM nation INTERSECT ALL SELECT o_custkey % 5 FROM orders WHERE o_orderkey < 40"),
    "not_in_null": ("SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT nullif(r_regionkey, 3) FROM region WHERE r_regionkey > 2)", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT nullif(r_regionkey, 3) FROM region WHERE r_regionkey > 2)"),
    # functions
    "format_kinds": ("SELECT format('%I.%s: %L %% %1$s', n_name, n_regionkey, n_name) AS f FROM nation", "SELECT '\"' || n_name || '\".' || n_regionkey || ': ''' || n_name || ''' % ' || n_name AS f FROM nation"),
    "json_elements": ("SELECT json_array_elements('[{\"a\":1},{\"a\":2}]') AS e", "SELECT e FROM (VALUES ('{\"a\":1}'), ('{\"a\":2}')) t(e)"),
    "json_elements_from": ("SELECT value FROM json_array_elements('[1,2,3]')", "SELECT CAST(v AS VARCHAR) AS value FROM (VALUES (1), (2), (3)) t(v)"),
    "json_elements_alias": ("SELECT r_regionkey, foo FROM region, jsonb_array_elements(concat('[', r_regionkey, ',', r_regionkey + 1, ']')) AS foo", "SELECT r_regionkey, CAST(foo AS VARCHAR) AS foo FROM (SELECT r_regionkey, unnest([r_regionkey, r_regionkey + 1]) AS foo FROM region)"),
    "json_path_text": ("SELECT event_id, jsonb_extract_path_text(props, VARIADIC ARRAY['k']) AS a, jsonb_extract_path_text(props, 'k') AS b FROM events", "SELECT event_id, props->>'k' AS a, props->>'k' AS b FROM events"),
    "json_cast": ("SELECT '{\"key\": [1, 2]}'::JSONB AS j, n_name AS Folded, n_regionkey AS \"Kept\" FROM nation", "SELECT '{\"key\":[1,2]}' AS j, n_name AS folded, n_regionkey AS \"Kept\" FROM nation"),
    "json_length": ("SELECT jsonb_array_length('[1, 2, 3]'::jsonb) AS n", "SELECT CAST(3 AS INTEGER) AS n"),
    "json_pretty": ("SELECT n_nationkey, jsonb_pretty(json_build_object('key', n_name)) AS p FROM nation", "SELECT n_nationkey, '{' || chr(10) || '    \"key\": \"' || n_name || '\"' || chr(10) || '}' AS p FROM nation"),
    "row_to_json": ("SELECT row_to_json(t) AS j FROM (SELECT r_name FROM region) t", "SELECT '{\"r_name\":\"' || r_name || '\"}' AS j FROM region"),
    "series_of_rows": ("SELECT r_regionkey, n FROM region, generate_series(1, r_regionkey) AS t(n)", "SELECT r_regionkey, CAST(n AS BIGINT) AS n FROM (SELECT r_regionkey, unnest(generate_series(1, r_regionkey)) AS n FROM region)"),
    "array_cast": ("SELECT n_nationkey, array_to_string(ARRAY[n_regionkey, 7]::text[], '-') AS s, (ARRAY[n_regionkey, 7]::int8[])[1] AS k FROM nation", "SELECT n_nationkey, n_regionkey || '-7' AS s, CAST(n_regionkey AS BIGINT) AS k FROM nation"),
    "unnest": ("SELECT n_nationkey, x FROM nation, unnest(ARRAY[n_regionkey, 9]) AS x", "SELECT n_nationkey, unnest([n_regionkey, 9]) AS x FROM nation"),
    "session_functions": ("SELECT version() AS v, set_config('bytea_output', 'hex', false) AS c, current_setting('default_tablespace') AS s, pg_catalog.has_database_privilege(1, 'CREATE') AS p, array_upper(current_schemas(FALSE), 1) AS n", "SELECT 'PostgreSQL 17.0, compiled by plinth' AS v, 'hex' AS c, '' AS s, true AS p, CAST(1 AS INTEGER) AS n"),
    "admin_functions": ("SELECT pg_backend_pid() AS a, pg_cancel_backend(12345) AS b, pg_catalog.pg_encoding_to_char(6) AS c, pg_catalog.pg_get_viewdef(NULL, TRUE) AS d, pg_catalog.pg_get_expr(NULL, 1) AS e, TRIM (BOTH '\"' FROM pg_catalog.pg_get_indexdef(1, 1, false)) AS f", "SELECT CAST(0 AS INTEGER) AS a, true AS b, 'UTF8' AS c, '' AS d, '' AS e, '' AS f"),
    "recovery": ("SELECT * FROM pg_is_in_recovery()", "SELECT false AS pg_is_in_recovery"),
    "all_settings": ("SELECT setting FROM pg_catalog.pg_show_all_settings() WHERE name = 'default_null_order'", "SELECT 'nulls_last' AS setting"),
    "keywords": ("SELECT pg_get_keywords.word FROM pg_catalog.pg_get_keywords() WHERE word IN ('select', 'from')", "SELECT word FROM (VALUES ('select'), ('from')) t(word)"),
    "acl": ("SELECT (d).grantee AS grantee, (d).is_grantable AS grantable FROM (SELECT pg_catalog.aclexplode(db.datacl) AS d FROM pg_catalog.pg_database db WHERE db.oid = 16388::OID) a", "SELECT CAST(NULL AS VARCHAR) AS grantee, CAST(NULL AS VARCHAR) AS grantable"),
    "interval_text": ("SELECT '1 week'::INTERVAL AS i, CAST(date_trunc('month', '2025-02-24 15:58:23'::timestamp + '-1 month'::interval) AS DATE)::text AS d", "SELECT '0 months 7 days 0 microseconds' AS i, '2025-01-01' AS d"),
    # casts to the catalog's names
    "reg_casts": ("SELECT 'pg_catalog.array_in'::regproc AS f, 1::pg_catalog.regtype::pg_catalog.text AS t, '\"public\".\"nation\"'::regclass::oid > 0 AS there, FORMAT('%I.%I', 'public', 'nation')::regclass::oid IS NULL AS unknown, 'public.nothing'::regclass IS NULL AS none FROM nation WHERE n_nationkey = 0", "SELECT 'array_in' AS f, '1' AS t, true AS there, true AS unknown, true AS none"),
    "regclass_columns": ("SELECT count(*) AS n FROM pg_attribute, region WHERE attrelid = '\"public\".\"region\"'::regclass", "SELECT CAST(10 AS BIGINT) AS n"),
    "regclass_empty": ("SELECT objoid, objsubid, description FROM pg_description WHERE classoid IN ('pg_class'::regclass, 'pg_type'::regclass) OR classoid = CASE WHEN true THEN 'pg_class'::regclass END", "SELECT CAST(1 AS BIGINT) AS objoid, CAST(1 AS INTEGER) AS objsubid, '' AS description WHERE false"),
    # system catalog
    "catalog_user": ("SELECT * FROM user", "SELECT 'plinth' AS user"),
    "catalog_shadow": ("SELECT x.usename, (SELECT rolcanlogin FROM pg_roles WHERE rolname = x.usename) AS login FROM pg_shadow x LEFT JOIN pg_catalog.pg_shdescription d ON d.objoid = x.usesysid", "SELECT 'plinth' AS usename, true AS login"),
    "catalog_procedures": ("SELECT pg_catalog.pg_get_userbyid(p.proowner) IS NOT NULL AS owned, n.nspname FROM pg_catalog.pg_proc p LEFT JOIN pg_catalog.pg_namespace n ON n.oid = p.pronamespace WHERE p.proname = 'to_char'", "SELECT true AS owned, 'pg_catalog' AS nspname"),
    "catalog_tablespaces": ("SELECT pg_tablespace_location(t.oid) loc FROM pg_catalog.pg_tablespace t", "SELECT '' AS loc"),
    "catalog_types": ("SELECT typname, typarray, typlen FROM pg_type WHERE oid IN (16, 25, 1700)", "SELECT typname, CAST(a AS BIGINT) AS typarray, CAST(n AS INTEGER) AS typlen FROM (VALUES ('bool', 1000, 1), ('text', 1009, -1), ('numeric', 1231, -1)) t(typname, a, n)"),
    "catalog_indexes": ("SELECT ARRAY(SELECT pg_get_indexdef(indexrelid, attnum, true) FROM pg_attribute WHERE attrelid = indexrelid ORDER BY attnum) AS expressions, indnullsnotdistinct FROM pg_index", "SELECT ['x'] AS expressions, true AS indnullsnotdistinct WHERE false"),
    "catalog_tables": ("SELECT table_schema, table_name, table_type, is_insertable_into FROM information_schema.tables, region WHERE r_regionkey = 0", "SELECT 'public' AS table_schema, 'region' AS table_name, 'BASE TABLE' AS table_type, 'YES' AS is_insertable_into"),
    "catalog_columns": ("SELECT column_name, data_type, udt_name FROM information_schema.columns, embeddings WHERE vec_id = 0", "SELECT * FROM (VALUES ('vec_id', 'bigint', 'int8'), ('embedding', 'ARRAY', '_float4'), ('label', 'integer', 'int4')) t(column_name, data_type, udt_name)"),
    "catalog_class": ("SELECT c.relname, c.relkind, a.attname, t.typname FROM pg_catalog.pg_class c JOIN pg_attribute a ON a.attrelid = c.oid JOIN pg_type t ON t.oid = a.atttypid, region WHERE r_regionkey = 0 AND a.attnum = 2", "SELECT 'region' AS relname, 'r' AS relkind, 'r_name' AS attname, 'text' AS typname"),
    "catalog_stats": ("SELECT schemaname, relname, n_live_tup FROM pg_stat_user_tables, region WHERE r_regionkey = 0", "SELECT 'public' AS schemaname, 'region' AS relname, CAST(1 AS BIGINT) AS n_live_tup"),
}
