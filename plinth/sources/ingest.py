"""Ingest: exports of relational tables (full refresh), product events (append by cursor), CRM records (full refresh)."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.sources.store import Store
from plinth.sources.values import SourceColumn, field, typed

#: Text that stands for NULL in exports, so that empty strings stay empty.
NULL = "PLINTH_NULL"


def export_rows(spark: SparkSession, path: str, columns: list[SourceColumn], null: str = NULL, multiline: bool = True) -> DataFrame:
    """Rows of a CSV export with a header. Without line breaks in values, multiline=False lets Spark split files."""
    texts = T.StructType([T.StructField(c.name, T.StringType()) for c in columns])
    raw = spark.read.csv(path, schema=texts, header=True, multiLine=multiline, quote='"', escape='"', emptyValue="", enforceSchema=False)
    out = []
    for c in columns:
        text = F.coalesce(F.col(f"`{c.name}`"), F.lit(""))
        f = field(c)
        out.append(typed(F.when(text != null, text), c).alias(f.name, metadata=f.metadata))
    return raw.select(*out)


def json_rows(spark: SparkSession, path: str, columns: list[SourceColumn]) -> DataFrame:
    """Typed rows of JSON lines. A row whose keys aren't the columns, all of them, fails: the source has drifted."""
    texts = T.StructType([T.StructField(c.name, T.StringType()) for c in columns])
    names = F.array(*[F.lit(n) for n in sorted(c.name for c in columns)])
    keys = F.array_sort(F.json_object_keys("value"))
    drift = F.raise_error(F.concat(F.lit("columns of a row differ from the table's: "), F.array_join(F.coalesce(keys, F.array().cast("array<string>")), ", ")))
    raw = spark.read.text(path).select(F.when(keys == names, F.from_json("value", texts)).otherwise(drift).alias("r"))
    out = []
    for c in columns:
        f = field(c)
        out.append(typed(F.col("r")[c.name], c).alias(f.name, metadata=f.metadata))
    return raw.select(*out)


def database_rows(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 1, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """A table of a relational database in one read-only snapshot a connection; with key, parts and bounds it is read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    reader = reader.option("sessionInitStatement", "SET SESSION CHARACTERISTICS AS TRANSACTION ISOLATION LEVEL REPEATABLE READ READ ONLY")
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("numPartitions", parts).option("lowerBound", bounds[0]).option("upperBound", bounds[1])
    return reader.load()


def target_name(schema: str, table: str) -> str:
    return table if schema == "public" else f"{schema}_{table}"


def chosen(tables: Iterable[tuple[str, str]], include: set[str] | None = None, exclude: set[str] | None = None) -> list[tuple[str, str]]:
    """Tables (schema, name) that are in `include`, or not in `exclude`, both sets of `schema.table`; only one may be given."""
    if include and exclude:
        raise ValueError("include and exclude exclude each other")
    return [t for t in tables if (not include or ".".join(t) in include) and (not exclude or ".".join(t) not in exclude)]


def unique_key(indexes: dict[str, list[str]]) -> list[str]:
    """Columns of the best unique index: the fewest, then one whose name ends in `id`, then by name."""
    return min(indexes.items(), key=lambda x: (len(x[1]), not x[1][-1].endswith("id"), x[0]))[1] if indexes else []


def full_refresh(store: Store, schema: str, tables: dict[str, DataFrame]) -> None:
    """Replaces each table; those of the schema that the source no longer has are dropped."""
    for name, rows in tables.items():
        store.replace(schema, name, rows)
    for s, name in store.tables():
        if s == schema and name not in tables:
            store.drop(s, name)


# Columns of product events and their types (text, if not named).
EVENT_COLUMNS = """
adid amplitude_attribution_ids amplitude_event_type amplitude_id:long app:int city client_event_time:time client_upload_time:time
country data data_type device_brand device_carrier device_family device_id device_manufacturer device_model device_type dma
event_id:int event_properties event_time:time event_type global_user_properties group_properties groups idfa insert_id insert_key
ip_address is_attribution_event:boolean language library location_lat:float location_lng:float os_name os_version partner_id
paying:boolean plan platform processed_time:time region sample_rate:float schema server_received_time:time
server_upload_time:time session_id:long source_id start_version user_creation_time:time user_id user_properties uuid version_name
""".split()
RENAMED = {"insert_id": "$insert_id", "insert_key": "$insert_key", "schema": "$schema"}
CURSOR = "server_upload_time"


def event_schema() -> T.StructType:
    """All fields as text: JSON objects come as their JSON text."""
    return T.StructType([T.StructField(RENAMED.get(c.split(":")[0], c.split(":")[0]), T.StringType()) for c in EVENT_COLUMNS])


def events_of(raw: DataFrame) -> DataFrame:
    """Typed events from rows of event_schema(); empty texts of times are null. Batch and streaming alike."""
    out = []
    for c in EVENT_COLUMNS:
        name, _, kind = c.partition(":")
        value = F.col(f"`{RENAMED.get(name, name)}`")
        out.append((value if not kind else F.nullif(value, F.lit("")).try_cast("timestamp_ntz" if kind == "time" else kind)).alias(name))
    return raw.select(*out)


def event_rows(spark: SparkSession, path: str) -> DataFrame:
    """Events from files of JSON lines (gzip too)."""
    return events_of(spark.read.schema(event_schema()).json(path))


def append_events(store: Store, schema: str, name: str, events: DataFrame) -> None:
    """Adds events beyond the table's last cursor; the first time, all."""
    if not store.exists(schema, name):
        store.replace(schema, name, events)
        return
    last = store.last_cursor(schema, name, CURSOR)
    store.append(schema, name, events if last is None else events.filter(F.col(CURSOR) > F.lit(last).cast("timestamp_ntz")))


# Where a CRM value lies in its JSON, by kind.
PATHS = {"value": "$.value", "domain": "$.domain", "link": "$.target_record_id", "option": "$.option.title", "status": "$.status.title", "money": "$.currency_value", "seen": "$.interacted_at", "actor": "$.referenced_actor_id", "phone": "$.phone_number", "email": "$.email_address", "person": "$.full_name"}
LOCATION = "line_1 line_2 line_3 line_4 locality region postcode country_code".split()
_SOCIAL = "angellist facebook instagram linkedin twitter twitter_follower_count:value:int"
_SEEN = " ".join(f"{x}_interaction:seen:timestamp_ntz" for x in "first_calendar last_calendar next_calendar first_email last_email first last next".split())
_STRENGTH = "strongest_connection_strength_legacy:value:int strongest_connection_strength:option strongest_connection_user:actor"
_MADE = "created_at:value:timestamp_ntz created_by:actor"
# Columns of CRM records as name:kind:type (value and text, if not named); `*` takes all values of a list.
CRM_COLUMNS = {
    "companies": f"id name description domains:domain* team:link* categories:option* primary_location:place logo_url {_SOCIAL} estimated_arr_usd:option funding_raised_usd:money:float foundation_date:value:date employee_range:option {_SEEN} {_STRENGTH} associated_deals:link* associated_workspaces:link* {_MADE}",
    "people": f"id name:person description email_addresses:email* company:link job_title avatar_url phone_numbers:phone* primary_location:place {_SOCIAL} {_SEEN} {_STRENGTH} associated_deals:link* associated_users:link* {_MADE}",
    "deals": f"id name stage:status owner:actor value:money:float associated_people:link* associated_company:link {_MADE}",
}


def _place(value: Column) -> Column:
    parts = [F.nullif(F.get_json_object(value, f"$.{p}"), F.lit("")) for p in LOCATION]
    return F.when(value.isNotNull(), F.concat_ws(", ", *parts))


def _at(path: str):
    return lambda value: F.get_json_object(value, path)


def crm_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Flat records of JSON lines `{"values": {attribute: [value, ...]}}`; kind is companies, people or deals."""
    return crm_of(spark.read.schema("values map<string, array<string>>").json(path), kind)


def crm_of(raw: DataFrame, kind: str) -> DataFrame:
    """Flat records from rows of `values`, a map of attributes to lists of JSON texts."""
    out = []
    for c in CRM_COLUMNS[kind].split():
        name, how, to = c.split(":") + ["value", "string"][c.count(":") :]
        values = F.col("values")[F.lit("record_id" if name == "id" else name)]
        if how.endswith("*"):
            out.append(F.coalesce(F.transform(values, _at(PATHS[how[:-1]])), F.array().cast("array<string>")).alias(name))
            continue
        first = F.get(values, F.lit(0))
        text = _place(first) if how == "place" else F.get_json_object(first, PATHS[how])
        if to == "timestamp_ntz":
            text = F.regexp_replace(text, "Z$", "")
        out.append((text if to == "string" else F.nullif(text, F.lit("")).try_cast(to)).alias(name))
    return raw.select(*out)
