"""pg_catalog and information_schema as DataFrames made from the engine's tables."""

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plinth.functions import dialect

#: Columns of catalog tables that are always empty here.
EMPTY = {
    "pg_attrdef": "oid long, adrelid long, adnum int, adbin string, drelid long",
    "pg_auth_members": "oid long, roleid long, member long, grantor long, admin_option boolean, inherit_option boolean, set_option boolean",
    "pg_constraint": "oid long, conname string, connamespace long, contype string, condeferrable boolean, condeferred boolean, convalidated boolean, conrelid long, contypid long, conindid long, conparentid long, confrelid long, confupdtype string, confdeltype string, confmatchtype string, conislocal boolean, coninhcount int, connoinherit boolean, conkey array<int>, confkey array<int>, conpfeqop array<long>, conppeqop array<long>, conffeqop array<long>, conexclop array<long>, conbin string",
    "pg_depend": "classid long, objid long, objsubid int, refclassid long, refobjid long, refobjsubid int, deptype string",
    "pg_description": "objoid long, classoid long, objsubid int, description string",
    "pg_enum": "oid long, enumtypid long, enumsortorder float, enumlabel string",
    "pg_foreign_server": "oid long, srvname string, srvowner long, srvfdw long, srvtype string, srvversion string",
    "pg_foreign_table": "ftrelid long, ftserver long, ftoptions array<string>",
    "pg_index": "indexrelid long, indrelid long, indnatts int, indnkeyatts int, indisunique boolean, indnullsnotdistinct boolean, indisprimary boolean, indisexclusion boolean, indimmediate boolean, indisclustered boolean, indisvalid boolean, indcheckxmin boolean, indisready boolean, indislive boolean, indisreplident boolean, indkey array<int>, indcollation array<long>, indclass array<long>, indoption array<int>, indexprs string, indpred string",
    "pg_indexes": "schemaname string, tablename string, indexname string, tablespace string, indexdef string",
    "pg_inherits": "inhrelid long, inhparent long, inhseqno int, inhdetachpending boolean",
    "pg_language": "oid long, lanname string, lanowner long, lanispl boolean, lanpltrusted boolean",
    "pg_locks": "locktype string, database long, relation long, pid int, mode string, granted boolean",
    "pg_opclass": "oid long, opcmethod long, opcname string, opcnamespace long, opcowner long, opcfamily long, opcintype long, opcdefault boolean, opckeytype long",
    "pg_operator": "oid long, oprname string, oprnamespace long, oprowner long, oprkind string, oprleft long, oprright long, oprresult long",
    "pg_partitioned_table": "partrelid long, partstrat string, partnatts int, partdefid long, partattrs array<int>, partexprs string",
    "pg_policy": "oid long, polname string, polrelid long, polcmd string, polpermissive boolean, polroles long, polqual string, polwithcheck string",
    "pg_publication": "oid long, pubname string, pubowner long, puballtables boolean, pubinsert boolean, pubupdate boolean, pubdelete boolean, pubtruncate boolean, pubviaroot boolean",
    "pg_publication_namespace": "oid long, pnpubid long, pnnspid long",
    "pg_publication_rel": "oid long, prpubid long, prrelid long, prqual string, prattrs string",
    "pg_range": "rngtypid long, rngsubtype long, rngmultitypid long, rngcollation long, rngsubopc long",
    "pg_replication_slots": "slot_name string, plugin string, slot_type string, datoid long, database string, temporary boolean, active boolean, active_pid int, xmin long, catalog_xmin long, restart_lsn string, confirmed_flush_lsn string, wal_status string, safe_wal_size long, two_phase boolean, conflicting boolean",
    "pg_rewrite": "oid long, rulename string, ev_class long, ev_type string, ev_enabled string, is_instead boolean, ev_qual string, ev_action string",
    "pg_sequence": "seqrelid long, seqtypid long, seqstart long, seqincrement long, seqmax long, seqmin long, seqcache long, seqcycle boolean",
    "pg_sequences": "schemaname string, sequencename string, sequenceowner string, data_type string, start_value long, min_value long, max_value long, increment_by long, cycle boolean, cache_size long, last_value long",
    "pg_shdescription": "objoid long, classoid long, description string",
    "pg_stat_activity": "datid long, datname string, pid int, leader_pid int, usesysid long, usename string, application_name string, client_addr string, client_hostname string, client_port int, backend_start timestamp, xact_start timestamp, query_start timestamp, state_change timestamp, wait_event_type string, wait_event string, state string, backend_xid long, backend_xmin long, query_id long, query string, backend_type string",
    "pg_stat_gssapi": "pid int, gss_authenticated boolean, principal string, encrypted boolean, credentials_delegated boolean",
    "pg_statio_user_tables": "relid long, schemaname string, relname string, heap_blks_read long, heap_blks_hit long, idx_blks_read long, idx_blks_hit long, toast_blks_read long, toast_blks_hit long, tidx_blks_read long, tidx_blks_hit long",
    "pg_statistic_ext": "oid long, stxrelid long, stxname string, stxnamespace long, stxowner long, stxstattarget int, stxkeys long, stxkind string, stxexprs string",
    "pg_trigger": "oid long, tgrelid long, tgparentid long, tgname string, tgfoid long, tgtype int, tgenabled string, tgisinternal boolean, tgconstrrelid long, tgconstrindid long, tgconstraint long, tgdeferrable boolean, tginitdeferred boolean, tgnargs int, tgattr array<int>, tgargs string, tgqual string, tgoldtable string, tgnewtable string",
    "pg_views": "schemaname string, viewname string, viewowner string, definition string",
}
#: Names of further catalog tables and views, always empty here, with an oid column alone.
OTHERS = frozenset(
    """pg_aggregate pg_am pg_amop pg_amproc pg_authid pg_available_extensions pg_cast pg_config pg_conversion pg_cursors pg_db_role_setting pg_default_acl
    pg_event_trigger pg_file_settings pg_foreign_data_wrapper pg_group pg_init_privs pg_largeobject pg_largeobject_metadata pg_opfamily pg_parameter_acl pg_policies
    pg_prepared_statements pg_prepared_xacts pg_publication_tables pg_replication_origin pg_replication_origin_status pg_rules pg_seclabel pg_seclabels pg_shdepend
    pg_shmem_allocations pg_shseclabel pg_statistic pg_statistic_ext_data pg_stats pg_stats_ext pg_stats_ext_exprs pg_subscription pg_subscription_rel
    pg_timezone_abbrevs pg_timezone_names pg_transform pg_ts_config pg_ts_config_map pg_ts_dict pg_ts_parser pg_ts_template pg_user_mapping pg_user_mappings
    pg_stat_all_indexes pg_stat_all_tables pg_stat_archiver pg_stat_bgwriter pg_stat_checkpointer pg_stat_database pg_stat_database_conflicts pg_stat_io
    pg_stat_progress_analyze pg_stat_progress_basebackup pg_stat_progress_cluster pg_stat_progress_copy pg_stat_progress_create_index pg_stat_progress_vacuum
    pg_stat_recovery_prefetch pg_stat_replication pg_stat_replication_slots pg_stat_slru pg_stat_ssl pg_stat_subscription pg_stat_subscription_stats
    pg_stat_sys_indexes pg_stat_sys_tables pg_stat_user_functions pg_stat_user_indexes pg_stat_wal pg_stat_wal_receiver pg_stat_xact_all_tables
    pg_stat_xact_sys_tables pg_stat_xact_user_functions pg_stat_xact_user_tables pg_statio_all_indexes pg_statio_all_sequences pg_statio_all_tables
    pg_statio_sys_indexes pg_statio_sys_sequences pg_statio_sys_tables pg_statio_user_indexes pg_statio_user_sequences""".split()
)
_UDT = {"bigint": "int8", "int": "int4", "smallint": "int2", "double": "float8", "float": "float4", "string": "text", "boolean": "bool", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "binary": "bytea"}
_NAME = {"int8": "bigint", "int4": "integer", "int2": "smallint", "float8": "double precision", "float4": "real", "text": "text", "bool": "boolean", "date": "date", "timestamptz": "timestamp with time zone", "timestamp": "timestamp without time zone", "bytea": "bytea", "numeric": "numeric"}

#: Base types by name: oid, oid of its arrays (0: none), size, category.
TYPES = {
    "bool": (16, 1000, 1, "B"), "bytea": (17, 1001, -1, "U"), "char": (18, 1002, 1, "Z"), "name": (19, 1003, 64, "S"), "int8": (20, 1016, 8, "N"), "int2": (21, 1005, 2, "N"),
    "int2vector": (22, 1006, -1, "A"), "int4": (23, 1007, 4, "N"), "regproc": (24, 1008, 4, "N"), "text": (25, 1009, -1, "S"), "oid": (26, 1028, 4, "N"), "tid": (27, 1010, 6, "U"),
    "xid": (28, 1011, 4, "U"), "cid": (29, 1012, 4, "U"), "oidvector": (30, 1013, -1, "A"), "json": (114, 199, -1, "U"), "xml": (142, 143, -1, "U"), "point": (600, 1017, 16, "G"),
    "lseg": (601, 1018, 32, "G"), "path": (602, 1019, -1, "G"), "box": (603, 1020, 32, "G"), "polygon": (604, 1027, -1, "G"), "line": (628, 629, 24, "G"), "cidr": (650, 651, -1, "I"),
    "float4": (700, 1021, 4, "N"), "float8": (701, 1022, 8, "N"), "circle": (718, 719, 24, "G"), "macaddr8": (774, 775, 8, "U"), "money": (790, 791, 8, "N"), "macaddr": (829, 1040, 6, "U"),
    "inet": (869, 1041, -1, "I"), "bpchar": (1042, 1014, -1, "S"), "varchar": (1043, 1015, -1, "S"), "date": (1082, 1182, 4, "D"), "time": (1083, 1183, 8, "D"), "timestamp": (1114, 1115, 8, "D"),
    "timestamptz": (1184, 1185, 8, "D"), "interval": (1186, 1187, 16, "T"), "timetz": (1266, 1270, 12, "D"), "bit": (1560, 1561, -1, "V"), "varbit": (1562, 1563, -1, "V"),
    "numeric": (1700, 1231, -1, "N"), "refcursor": (1790, 2201, -1, "U"), "regprocedure": (2202, 2207, 4, "N"), "regoper": (2203, 2208, 4, "N"), "regoperator": (2204, 2209, 4, "N"),
    "regclass": (2205, 2210, 4, "N"), "regtype": (2206, 2211, 4, "N"), "uuid": (2950, 2951, 16, "U"), "pg_lsn": (3220, 3221, 8, "U"), "tsvector": (3614, 3643, -1, "U"), "tsquery": (3615, 3645, -1, "U"),
    "jsonb": (3802, 3807, -1, "U"), "regnamespace": (4089, 4090, 4, "N"), "regrole": (4096, 4097, 4, "N"), "xid8": (5069, 271, 8, "U"),
}
#: Columns and the row of tables that hold one.
ONE_ROW = {
    "pg_shadow": ("usename string, usesysid long, usecreatedb boolean, usesuper boolean, userepl boolean, usebypassrls boolean, passwd string, valuntil timestamp, useconfig array<string>", ("$user", 10, False, False, True, False, "$passwd", None, None)),
    "pg_user": ("usename string, usesysid long, usecreatedb boolean, usesuper boolean, userepl boolean, usebypassrls boolean, passwd string, valuntil timestamp, useconfig array<string>", ("$user", 10, True, True, True, True, "", None, None)),
    "pg_roles": ("oid long, rolname string, rolsuper boolean, rolinherit boolean, rolcreaterole boolean, rolcreatedb boolean, rolcanlogin boolean, rolreplication boolean, rolconnlimit int, rolpassword string, rolvaliduntil timestamp, rolbypassrls boolean, rolconfig array<string>", (10, "$user", True, True, True, True, True, False, -1, None, None, False, None)),
    "pg_extension": ("oid long, extname string, extowner long, extnamespace long, extrelocatable boolean, extversion string, extconfig array<string>, extcondition array<string>", (13823, "plpgsql", 10, 11, False, "1.0", None, None)),
    "pg_database": ("oid long, datname string, datdba long, encoding int, datlocprovider string, datistemplate boolean, datallowconn boolean, datconnlimit int, datfrozenxid long, datminmxid int, dattablespace long, datcollate string, datctype string, datlocale string, daticurules string, datcollversion string, datacl array<string>", (16388, "$database", 10, 6, "c", False, True, -1, 722, 1, 1663, "en_US.UTF-8", "en_US.UTF-8", "en_US.UTF-8", None, None, None)),
    "pg_tablespace": ("oid long, spcname string, spcowner long, spcacl array<string>, spcoptions array<string>", (1663, "pg_default", 10, None, None)),
    "pg_collation": ("oid long, collname string, collnamespace long, collowner long, collprovider string, collisdeterministic boolean, collencoding int, collcollate string, collctype string, colliculocale string, collicurules string, collversion string", (100, "default", 11, 10, "d", True, -1, None, None, None, None, None)),
}


#: Catalog tables made from the engine's own tables, or with rows of their own.
_MADE = frozenset("pg_namespace pg_class pg_attribute pg_type pg_proc pg_tables pg_matviews pg_stat_user_tables pg_settings".split()) | ONE_ROW.keys()


def known(schema: str, name: str) -> bool:
    """Whether a table of the system catalog is meant."""
    if schema == "information_schema":
        return name in ("tables", "columns", "schemata")
    return schema in ("", "pg_catalog") and (name in EMPTY or name in OTHERS or name in _MADE)


def _udt(kind: T.DataType, logical: str | None) -> str:
    """The Postgres name of a column's type."""
    if isinstance(kind, T.ArrayType):
        return "_" + _udt(kind.elementType, logical)
    return "numeric" if isinstance(kind, T.DecimalType) else logical if logical in ("json", "time") else _UDT.get(kind.simpleString(), "text")


def oid(*name: str) -> int:
    return 16384 + zlib.crc32(".".join(name).encode()) % 2_000_000_000


def _frames(engine) -> list[tuple[str, str, list[tuple[str, str]], bool]]:
    """(schema, name, [(column, type's Postgres name)], whether a materialized view)."""
    views = {} if engine.store is None else {x for x in engine.store.catalog.all("SELECT schema, name FROM matviews")}
    columns = lambda fields: [(f.name, _udt(f.dataType, f.metadata.get("logical_type"))) for f in fields]
    out = [(s, n, columns(df.schema), False) for (s, n), df in sorted(engine.views.items())]
    for s, n in engine.store.tables() if engine.store else ():
        out.append((s, n, columns(engine.store.schema_of(s, n)), (s, n) in views))
    return out


def table(engine, schema: str, name: str, permissions: dict | None) -> DataFrame | None:
    """A system table by name, or None."""
    database, user, passwd = engine.identity
    make = engine.spark.createDataFrame
    if schema == "" and name == "user":
        return make([(user,)], "user string")
    if schema == "information_schema" and not known(schema, name):
        raise LookupError(f'relation "information_schema.{name}" does not exist')
    if not known(schema, name):
        return None
    # under permissions only listed tables and columns are there
    frames = [(s, n, [(i + 1, c, u) for i, (c, u) in enumerate(cs) if permissions is None or c in permissions[f"{s}.{n}"]], v) for s, n, cs, v in _frames(engine) if permissions is None or f"{s}.{n}" in permissions]
    if schema == "information_schema":
        if name == "tables":
            return make([(database, s, n, "BASE TABLE", None, None, None, None, None, "YES", "NO", None) for s, n, _, view in frames if not view], "table_catalog string, table_schema string, table_name string, table_type string, self_referencing_column_name string, reference_generation string, user_defined_type_catalog string, user_defined_type_schema string, user_defined_type_name string, is_insertable_into string, is_typed string, commit_action string")
        if name == "columns":
            rows = [(database, s, n, c, i, None, "YES", _NAME.get(u, "ARRAY" if u[0] == "_" else u), None, None, *{"int2": (16, 2, 0), "int4": (32, 2, 0), "int8": (64, 2, 0), "float4": (24, 2, None), "float8": (53, 2, None)}.get(u, (None, None, None)), None, None, database, "pg_catalog", u, "NO", "NEVER", "YES") for s, n, cs, _ in frames for i, c, u in cs]
            return make(rows, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, column_default string, is_nullable string, data_type string, character_maximum_length int, character_octet_length int, numeric_precision int, numeric_precision_radix int, numeric_scale int, datetime_precision int, interval_type string, udt_catalog string, udt_schema string, udt_name string, is_identity string, is_generated string, is_updatable string")
        return make([(database, s, user) for s in sorted({x[0] for x in frames} | {"public"})], "catalog_name string, schema_name string, schema_owner string")
    if name == "pg_namespace":
        return make([(oid(s), s, 10, None) for s in sorted({x[0] for x in frames} | {"public", "pg_catalog", "information_schema"})], "oid long, nspname string, nspowner long, nspacl array<string>")
    if name == "pg_class":
        rows = [(oid(s, n), n, oid(s), 0, 0, 10, 0, oid(s, n), 0, 0, 0.0, 0, 0, False, False, "p", "m" if view else "r", len(cs), 0, False, False, False, False, False, True, "n", False, 0, 0, 0, None, None, None) for s, n, cs, view in frames]
        return make(rows, "oid long, relname string, relnamespace long, reltype long, reloftype long, relowner long, relam long, relfilenode long, reltablespace long, relpages int, reltuples float, relallvisible int, reltoastrelid long, relhasindex boolean, relisshared boolean, relpersistence string, relkind string, relnatts int, relchecks int, relhasrules boolean, relhastriggers boolean, relhassubclass boolean, relrowsecurity boolean, relforcerowsecurity boolean, relispopulated boolean, relreplident string, relispartition boolean, relrewrite long, relfrozenxid long, relminmxid long, relacl array<string>, reloptions array<string>, relpartbound string")
    if name == "pg_attribute":
        of = lambda u: TYPES[u[1:]][1] if u[0] == "_" else TYPES[u][0]
        rows = [(oid(s, n), c, of(u), -1 if u[0] == "_" else TYPES[u][2], i, -1, 0, False, False, False, "", "", False, True, 0, 0, None, None, None) for s, n, cs, _ in frames for i, c, u in cs]
        return make(rows, "attrelid long, attname string, atttypid long, attlen int, attnum int, atttypmod int, attndims int, attbyval boolean, attnotnull boolean, atthasdef boolean, attidentity string, attgenerated string, attisdropped boolean, attislocal boolean, attinhcount int, attcollation long, attacl array<string>, attoptions array<string>, attmissingval string")
    if name == "pg_type":
        rows = [(o, n, oid("pg_catalog"), 10, size, size in (1, 2, 4, 8), "b", category, False, True, ",", 0, None, 0, array, "-", "-", 0, False, -1, 0, 0, None, None) for n, (o, array, size, category) in TYPES.items()]
        rows += [(array, f"_{n}", oid("pg_catalog"), 10, -1, False, "b", "A", False, True, ",", 0, None, o, 0, "array_in", "array_out", 0, False, -1, 0, 0, None, None) for n, (o, array, _, _) in TYPES.items() if array]
        return make(sorted(rows, key=lambda r: r[0]), "oid long, typname string, typnamespace long, typowner long, typlen int, typbyval boolean, typtype string, typcategory string, typispreferred boolean, typisdefined boolean, typdelim string, typrelid long, typsubscript string, typelem long, typarray long, typinput string, typoutput string, typbasetype long, typnotnull boolean, typtypmod int, typndims int, typcollation long, typdefault string, typacl array<string>")
    if name == "pg_proc":
        names = sorted(dialect.FUNCTIONS)
        return make([(oid("pg_proc", n), n, oid("pg_catalog"), 10, 0, "f", False, False, 0, 25, None) for n in names], "oid long, proname string, pronamespace long, proowner long, prolang long, prokind string, prosecdef boolean, proretset boolean, pronargs int, prorettype long, proacl array<string>")
    if name == "pg_tables":
        return make([(s, n, "plinth") for s, n, _, view in frames if not view], "schemaname string, tablename string, tableowner string")
    if name == "pg_matviews":
        rows = engine.store.catalog.all("SELECT schema, name, definition FROM matviews ORDER BY 1, 2") if engine.store else []
        rows = [r for r in rows if permissions is None or f"{r[0]}.{r[1]}" in permissions]
        return make(rows, "schemaname string, matviewname string, definition string")
    if name == "pg_stat_user_tables":
        return make([(oid(s, n), s, n, 1) for s, n, _, _ in frames], "relid long, schemaname string, relname string, n_live_tup long")
    if name in ONE_ROW:
        columns, values = ONE_ROW[name]
        return make([tuple({"$database": database, "$user": user, "$passwd": passwd}.get(v, v) if isinstance(v, str) else v for v in values)], columns)
    if name == "pg_settings":
        return make(sorted(engine.settings.items()), "name string, setting string")
    return make([], EMPTY.get(name, "oid long"))
