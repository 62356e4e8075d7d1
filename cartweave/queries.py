"""Queries over the test data, one or more for each operator, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartweave import views
from cartweave.functions import o5m
from cartweave.functions import opl as opl_text
from cartweave.functions import tags as tag_functions
from cartweave.operators.filters import apply_filters
from cartweave.operators.sinks import documents, write, written_lines
from cartweave.operators.workspace import fresh_path
from cartweave.schema import Metadata
from cartweave.sources import json as json_source
from cartweave.sources import opl, pbf, pbf_encode, xml
from cartweave.sources.registry import read_osm

Query = Callable[[SparkSession, str], DataFrame]
HEAD = "OSMFilter v0.2.0\n\n"
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

EVENTS = """e AS (SELECT 'node' AS type, event_id AS id, CAST(user_id AS INTEGER) AS uid, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, event_type, nullif(regexp_extract(props, '"k": ?([0-9]+)', 1), '') AS k,
  CASE WHEN event_type = 'error' THEN 'check' END AS note, CAST(event_id % 90 AS DOUBLE) AS lat, CAST(event_id % 180 AS DOUBLE) AS lon FROM events)"""
ORDERS = """l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS nodes FROM lineitem GROUP BY 1),
o AS (SELECT 'way' AS type, o_orderkey AS id, o_custkey AS changeset, o_orderstatus AS status, o_orderpriority AS priority, coalesce(nodes, []) AS nodes FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)"""
REGIONS = """r AS (SELECT 'relation' AS type, CAST(r_regionkey AS BIGINT) AS id, r_name AS name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n_members FROM region)"""
CUSTOMERS = """c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS usr, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS changeset,
  CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 2 = 0 END AS visible, c_name AS name, c_mktsegment AS segment FROM customer)"""


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def flat(elements: DataFrame, *keys: str) -> DataFrame:
    """type, id, the named tags, and how many tags there are."""
    return elements.select("type", "id", *(F.col("tags")[k].alias(f"tag_{k}") for k in keys), F.size("tags").cast("bigint").alias("n_tags"))


def _on_events(name: str, programs: list[str] | str, sql: str, keys: tuple[str, ...] = ("event_type", "k", "note")) -> None:
    """A chain of filters over the events; the SQL is over e."""
    texts = [programs] if isinstance(programs, str) else programs
    query(name, f"WITH {EVENTS} {sql}")(lambda spark, d: flat(apply_filters(views.events(spark, d), texts), *keys))


_N = "1 + CASE WHEN k IS NULL THEN 0 ELSE 1 END + CASE WHEN note IS NULL THEN 0 ELSE 1 END"
_TAGS = f"event_type AS tag_event_type, k AS tag_k, note AS tag_note, CAST({_N} AS BIGINT) AS n_tags"


# Elements and selectors


@query(
    "scan_elements",
    f"""WITH {EVENTS}, {ORDERS}, {REGIONS} SELECT type, id, CAST({_N} AS BIGINT) AS n_tags, CAST(0 AS BIGINT) AS n_nodes, CAST(0 AS BIGINT) AS n_members, CAST(-1 AS BIGINT) AS first_node FROM e
UNION ALL SELECT type, id, 2, len(nodes), 0, coalesce(nodes[1], -1) FROM o UNION ALL SELECT type, id, 1, 0, n_members, -1 FROM r""",
)
def scan_elements(spark: SparkSession, d: str) -> DataFrame:
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return views.all_elements(spark, d).select("type", "id", F.size("tags").cast("bigint").alias("n_tags"), F.greatest(size("nodes"), F.lit(0)).alias("n_nodes"), F.greatest(size("members"), F.lit(0)).alias("n_members"), F.coalesce(F.get("nodes", F.lit(0)), F.lit(-1).cast("bigint")).alias("first_node"))


def _typed(name: str, types: str, sql_types: str) -> None:
    text = f"{HEAD}TYPE {types}\n\tCOMMIT\nDROP\n"
    sql = f"WITH {EVENTS}, {ORDERS}, {REGIONS} SELECT * FROM (SELECT type, id FROM e UNION ALL SELECT type, id FROM o UNION ALL SELECT type, id FROM r) WHERE type IN ({sql_types})"
    query(name, sql)(lambda spark, d: apply_filters(views.all_elements(spark, d), [text]).select("type", "id"))


_typed("sel_type", "way", "'way'")
_typed("sel_type_multi", "node, relation", "'node', 'relation'")
_KEEP_ONLY = "\n\tCOMMIT\nDROP\n"
_on_events("sel_has", f'{HEAD}HAS "note"{_KEEP_ONLY}', f"SELECT type, id, {_TAGS} FROM e WHERE note IS NOT NULL")
_on_events("sel_has_missing", f'{HEAD}HAS "absent"{_KEEP_ONLY}', f"SELECT type, id, {_TAGS} FROM e WHERE false")
_on_events("sel_equals", f'{HEAD}EQUALS "event_type" "purchase"{_KEEP_ONLY}', f"SELECT type, id, {_TAGS} FROM e WHERE event_type = 'purchase'")
_on_events("sel_equals_missing", f'{HEAD}EQUALS "note" "other"{_KEEP_ONLY}', f"SELECT type, id, {_TAGS} FROM e WHERE coalesce(note = 'other', false)")

# Modifiers

_on_events("mod_set_new", f'{HEAD}SET "source" "survey"\n', f"SELECT type, id, event_type AS tag_event_type, 'survey' AS tag_source, CAST(1 + {_N} AS BIGINT) AS n_tags FROM e", ("event_type", "source"))
_on_events("mod_set_overwrite", f'{HEAD}SET "note" "x"\n', "SELECT type, id, k AS tag_k, 'x' AS tag_note, CAST(2 + CASE WHEN k IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_tags FROM e", ("k", "note"))
_on_events("mod_rename", f'{HEAD}RENAME "event_type" "kind"\n', f"SELECT type, id, CAST(NULL AS VARCHAR) AS tag_event_type, event_type AS tag_kind, CAST({_N} AS BIGINT) AS n_tags FROM e", ("event_type", "kind"))
_on_events(
    "mod_rename_overwrite", f'{HEAD}RENAME "note" "event_type"\n',
    "SELECT type, id, coalesce(note, event_type) AS tag_event_type, CAST(NULL AS VARCHAR) AS tag_note, CAST(1 + CASE WHEN k IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_tags FROM e", ("event_type", "note"),
)
_on_events("mod_rename_absent", f'{HEAD}RENAME "absent" "event_type"\n', f"SELECT type, id, {_TAGS} FROM e")
_on_events("mod_keep", f'{HEAD}KEEP "note", "absent"\n', "SELECT type, id, CAST(NULL AS VARCHAR) AS tag_event_type, note AS tag_note, CAST(CASE WHEN note IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_tags FROM e", ("event_type", "note"))
_on_events("mod_delete", f'{HEAD}DELETE "k", "note", "absent"\n', "SELECT type, id, event_type AS tag_event_type, CAST(NULL AS VARCHAR) AS tag_k, CAST(1 AS BIGINT) AS n_tags FROM e", ("event_type", "k"))

# Control flow

_on_events("ctl_commit_shortcircuit", f'{HEAD}HAS "note"\n\tCOMMIT\nSET "event_type" "other"\n', f"SELECT type, id, CASE WHEN note IS NULL THEN 'other' ELSE event_type END AS tag_event_type, CAST({_N} AS BIGINT) AS n_tags FROM e", ("event_type",))
_on_events("ctl_drop", f'{HEAD}EQUALS "event_type" "click"\n\tDROP\n', f"SELECT type, id, {_TAGS} FROM e WHERE event_type <> 'click'")
_on_events("ctl_default_keep", f"{HEAD}\n# nothing\n", f"SELECT type, id, {_TAGS} FROM e")
_on_events(
    "ctl_nested_block",
    f'{HEAD}TYPE node\n\tHAS "note" # inner\n\t\tSET "level" "high"\n\t\tEQUALS "k" "7"\n\t\t\tDROP\n\tEQUALS "event_type" "view"\n\t\tDELETE "k"\n\t\tCOMMIT\n\tSET "seen" "yes"\nTYPE way, relation\n\tDROP\n',
    f"""SELECT type, id, event_type AS tag_event_type, CASE WHEN event_type <> 'view' THEN k END AS tag_k, CASE WHEN note IS NOT NULL THEN 'high' END AS tag_level, CASE WHEN event_type <> 'view' THEN 'yes' END AS tag_seen,
      CAST(CASE WHEN event_type = 'view' THEN 1 ELSE 1 + {_N} + CASE WHEN note IS NULL THEN 0 ELSE 1 END END AS BIGINT) AS n_tags FROM e WHERE NOT (note IS NOT NULL AND coalesce(k = '7', false))""",
    ("event_type", "k", "level", "seen"),
)
_on_events(
    "ctl_mutate_then_select", f'{HEAD}HAS "note"\n\tDELETE "note"\n\tSET "event_type" "click"\nHAS "note"\n\tDROP\nEQUALS "event_type" "click"\n\tSET "hit" "1"\n',
    f"SELECT type, id, CASE WHEN note IS NOT NULL THEN 'click' ELSE event_type END AS tag_event_type, CASE WHEN note IS NOT NULL OR event_type = 'click' THEN '1' END AS tag_hit, CAST({_N} - CASE WHEN note IS NULL THEN 0 ELSE 1 END + CASE WHEN note IS NOT NULL OR event_type = 'click' THEN 1 ELSE 0 END AS BIGINT) AS n_tags FROM e",
    ("event_type", "hit"),
)
_on_events(
    "filter_chain", [f'{HEAD}HAS "note"\n\tSET "event_type" "bad"\n\tCOMMIT\nSET "first" "1"\n', "tags.event_type != 'click'", f'{HEAD}EQUALS "event_type" "bad"\n\tRENAME "note" "why"\nSET "last" "1"\n'],
    f"SELECT type, id, CASE WHEN note IS NOT NULL THEN 'bad' ELSE event_type END AS tag_event_type, CASE WHEN note IS NULL THEN '1' END AS tag_first, note AS tag_why, '1' AS tag_last, CAST({_N} + CASE WHEN note IS NULL THEN 2 ELSE 1 END AS BIGINT) AS n_tags FROM e WHERE note IS NOT NULL OR event_type <> 'click'",
    ("event_type", "first", "why", "last"),
)

# CEL


def _cel(name: str, text: str, where: str) -> None:
    sql = f"WITH {CUSTOMERS} SELECT id, name AS tag_name FROM c WHERE {where}"
    query(name, sql)(lambda spark, d: apply_filters(views.customers(spark, d), [text]).select("id", F.col("tags")["name"].alias("tag_name")))


_cel("cel_eq", "tags.segment == 'BUILDING' && id != 7", "segment = 'BUILDING' AND id <> 7")
_cel("cel_compare", "changeset >= 5 && id < 1000", "changeset >= 5 AND id < 1000")
_cel("cel_in", "tags['segment'] in ['MACHINERY', 'FURNITURE'] || 'absent' in tags", "segment IN ('MACHINERY', 'FURNITURE')")
_cel("cel_logic", "!(id % 2 == 0 || tags.absent == 'x') || id % 7 == 0", "id % 7 = 0")
_cel("cel_ternary", "visible == null ? id % 2 == 0 : visible", "CASE WHEN visible IS NULL THEN id % 2 = 0 ELSE visible END")
_cel("cel_string_fns", "tags.name.startsWith('Customer') && tags.name.endsWith('7') && tags.name.contains('#') && tags.name.matches('[0-9]{2,}$') && size(tags.name) > 3", "starts_with(name, 'Customer') AND ends_with(name, '7') AND contains(name, '#') AND regexp_matches(name, '[0-9]{2,}$') AND length(name) > 3")
_cel("cel_arith", "(id * 3 - 1) / 2 % 5 == 1 && -id < -10", "((id * 3 - 1) // 2) % 5 = 1 AND -id < -10")
_cel("cel_has", "has(tags.segment) && !has(tags.absent)", "true")
_cel("cel_macros", "tags.exists(k, k == 'segment' && tags[k].startsWith('M')) && tags.all(k, size(k) > 3) && tags.exists_one(k, k == 'name')", "starts_with(segment, 'M')")
_cel("cel_convert", "int(string(id)) == id && double(id) > 10.5 && type(changeset) == int", "id > 10.5 AND changeset IS NOT NULL")
_cel("cel_missing_key_drops", "tags.absent != 'x'", "false")
_cel("cel_null_equality", "user != 'nobody' && changeset != 3", "usr IS DISTINCT FROM 'nobody' AND changeset IS DISTINCT FROM 3")
_cel("cel_error_absorbed", "id / (id - id) > 0 || id % 10 == 1", "id % 10 = 1")
_cel("cel_bare_nullable", "visible", "coalesce(visible, false)")

# Functions


@query("opl_escape", "SELECT doc_id, replace(replace(replace(replace(replace(replace(text, '%', '%25%'), ' ', '%20%'), ',', '%2c%'), '=', '%3d%'), '@', '%40%'), chr(10), '%a%') AS escaped FROM documents")
def opl_escape(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", opl_text.escape(F.col("text")).alias("escaped"))


@query("opl_unescape", "SELECT doc_id, text FROM documents")
def opl_unescape(spark: SparkSession, d: str) -> DataFrame:
    return opl_escape(spark, d).select("doc_id", opl_text.unescape(F.col("escaped")).alias("text"))


@query("o5m_varint", """SELECT id, lower(CASE WHEN id < 128 THEN printf('%02x', id) WHEN id < 16384 THEN printf('%02x%02x', id % 128 + 128, id // 128) WHEN id < 2097152 THEN printf('%02x%02x%02x', id % 128 + 128, id // 128 % 128 + 128, id // 16384)
  ELSE printf('%02x%02x%02x%02x', id % 128 + 128, id // 128 % 128 + 128, id // 16384 % 128 + 128, id // 2097152) END) AS bytes FROM (SELECT event_id AS id FROM events)""")  # fmt: skip
def o5m_varint(spark: SparkSession, d: str) -> DataFrame:
    return views.events(spark, d).select("id", F.lower(F.hex(o5m.varint(F.col("id")))).alias("bytes"))


@query("o5m_tag", "SELECT c_custkey AS id, lower('00' || hex(encode('segment')) || '00' || hex(encode(c_mktsegment)) || '00') AS bytes FROM customer")
def o5m_tag(spark: SparkSession, d: str) -> DataFrame:
    return views.customers(spark, d).select("id", F.lower(F.hex(o5m.tag(F.lit("segment"), F.col("tags")["segment"]))).alias("bytes"))


@query("o5m_sort", f"WITH {EVENTS}, {ORDERS}, {REGIONS} SELECT type, id FROM e UNION ALL SELECT type, id FROM o UNION ALL SELECT type, id FROM r")
def o5m_sort(spark: SparkSession, d: str) -> DataFrame:
    return o5m.ordered(views.all_elements(spark, d)).select("type", "id")


@query("tag_functions", f"WITH {EVENTS} SELECT id, coalesce(note, 'none') AS note, event_type AS kind, CAST({_N} + CASE WHEN note IS NULL THEN 1 ELSE 0 END AS BIGINT) AS n_tags FROM e")
def tag_function_query(spark: SparkSession, d: str) -> DataFrame:
    tags = F.col("tags")
    out = tag_functions.rename_tag(F.when(tag_functions.has_tag(tags, "note"), tags).otherwise(tag_functions.set_tag(tags, "note", "none")), "event_type", "kind")
    return views.events(spark, d).select("id", out.alias("t")).select("id", F.col("t")["note"].alias("note"), F.col("t")["kind"].alias("kind"), F.size("t").cast("bigint").alias("n_tags"))


# Sources and sinks


@query(
    "opl_write_line",
    f"WITH {EVENTS} SELECT id, 'n' || id || ' t' || stamp || ' i' || uid || ' Tevent_type=' || event_type || coalesce(',k=' || k, '') || coalesce(',note=' || note, '') || ' x' || lon || ' y' || lat AS line FROM e",
)
def opl_write_line(spark: SparkSession, d: str) -> DataFrame:
    return written_lines("opl")(views.events(spark, d)).select("id", F.col("value").alias("line"))


_BACK = f"WITH {EVENTS} SELECT type, id, uid, stamp AS timestamp, lat, lon, {_TAGS} FROM e"


def _back(elements: DataFrame) -> DataFrame:
    keys = ("event_type", "k", "note")
    return elements.select("type", "id", "uid", "timestamp", "lat", "lon", *(F.col("tags")[k].alias(f"tag_{k}") for k in keys), F.size("tags").cast("bigint").alias("n_tags"))


def _round_trip(name: str, fmt: str, read: Callable[[SparkSession, str], DataFrame], single: bool = True) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        path = fresh_path(spark, name)
        write(views.events(spark, d), path, fmt, single=single)
        return _back(read(spark, path))

    query(name, _BACK)(run)


_round_trip("opl_roundtrip", "opl", opl.read, single=False)
_round_trip("json_roundtrip", "json", json_source.read)
_round_trip("overpass_roundtrip", "overpass", json_source.read)
_round_trip("xml_roundtrip", "xml", xml.read)


@query("ways_roundtrip", f"WITH {ORDERS} SELECT id, changeset, status AS tag_status, CAST(len(nodes) AS BIGINT) AS n_nodes, array_to_string(nodes, ',') AS nodes FROM o")
def ways_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "ways")
    write(views.orders(spark, d), path, "opl", single=False)
    return opl.read(spark, path).select("id", "changeset", F.col("tags")["status"].alias("tag_status"), F.size("nodes").cast("bigint").alias("n_nodes"), F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("nodes"))


@query("relations_roundtrip", "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS tag_name, CAST(n_nationkey AS BIGINT) AS ref, 'relation' AS member_type, n_name AS role FROM region JOIN nation ON n_regionkey = r_regionkey")
def relations_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "relations")
    write(views.regions(spark, d), path, "xml")
    return xml.read(spark, path).select("id", F.col("tags")["name"].alias("tag_name"), F.explode("members").alias("m")).select("id", "tag_name", F.col("m.ref").alias("ref"), F.col("m.type").alias("member_type"), F.col("m.role").alias("role"))


def _pbf_files(elements: DataFrame, path: str, dense: bool = True) -> None:
    """Executors encode a file for each partition.

    Batches to Python are bounded by their rows alone meanwhile: to bound bytes too, Spark sums up all vectors at each row, which takes longer than all else.
    A block of 8,000 elements has to fit the 64 MiB of a blob anyway.
    """

    def encode(batches):
        from pyarrow import fs

        from pyspark import TaskContext

        task = TaskContext.get()
        system, where = fs.FileSystem.from_uri(path)
        system.create_dir(where, recursive=True)
        temporary = f"{where}/.{task.partitionId()}-{task.attemptNumber()}"
        with system.open_output_stream(temporary) as f:
            f.write(pbf_encode.header())
            for b in batches:
                for i in range(0, b.num_rows, 8000):
                    f.write(pbf_encode.blocks(b.slice(i, 8000), dense))
        system.move(temporary, f"{where}/{task.partitionId()}.osm.pbf")
        yield from ()

    conf, limit = elements.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(limit, None)
    conf.set(limit, str((1 << 31) - 1))
    try:
        elements.mapInArrow(encode, "done int").count()
    finally:
        if before is None:
            conf.unset(limit)
        else:
            conf.set(limit, before)


@query("pbf_read", f"WITH {EVENTS} SELECT type, id, lat, lon, {_TAGS} FROM e")
def pbf_read(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "pbf")
    _pbf_files(views.events(spark, d).select("type", "id", "lat", "lon", "tags"), path)
    return pbf.read(spark, path).select("type", "id", "lat", "lon", *(F.col("tags")[k].alias(f"tag_{k}") for k in ("event_type", "k", "note")), F.size("tags").cast("bigint").alias("n_tags"))


# All types of elements in one document


def _shapes(elements: DataFrame) -> DataFrame:
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)).cast("bigint"), F.lit(0))
    return elements.select("type", "id", size("tags").alias("n_tags"), size("nodes").alias("n_nodes"), size("members").alias("n_members"), F.coalesce(F.get("nodes", F.lit(0)), F.lit(-1).cast("bigint")).alias("first_node"))


def _mixed(name: str, fmt: str, extension: str, single: bool = True) -> None:
    """Nodes, ways and relations written into one path and read by the format that its name says."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        path = f"{fresh_path(spark, name)}.{extension}"
        write(views.all_elements(spark, d), path, fmt, single=single)
        return _shapes(read_osm(spark, path)[0])

    query(name, _SQL["scan_elements"])(run)


_mixed("mixed_opl", "opl", "opl", single=False)
_mixed("mixed_json", "json", "json")
_mixed("mixed_overpass", "overpass", "json")
_mixed("mixed_xml", "xml", "osm")
_mixed("mixed_xml_parts", "xml", "xml", single=False)


@query("mixed_pbf", _SQL["scan_elements"])
def mixed_pbf(spark: SparkSession, d: str) -> DataFrame:
    path = f"{fresh_path(spark, 'mixed')}.pbf"
    _pbf_files(views.all_elements(spark, d).select("type", "id", "lat", "lon", "tags", "nodes", "members"), path, dense=False)
    return _shapes(read_osm(spark, path, "pbf")[0])


@query("xml_grouping", "SELECT * FROM (VALUES ('node', 1), ('way', 2), ('relation', 3)) AS t(type, place)")
def xml_grouping(spark: SparkSession, d: str) -> DataFrame:
    """The order in which types first stand in a document whose elements come mixed; that they don't come back is counted by mixed_xml."""
    path = fresh_path(spark, "grouping")
    mixed = views.regions(spark, d).unionByName(views.events(spark, d)).unionByName(views.orders(spark, d))
    write(mixed, path, "xml")
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.regexp_extract("value", "<(node|way|relation) ", 1).alias("type"))
    span = lines.where("type <> ''").groupBy("type").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    before = span.alias("a").join(span.alias("b"), F.col("b.last") < F.col("a.first"), "left").groupBy("a.type").agg(F.count("b.type").alias("n"))
    return before.select("type", (F.col("n") + 1).cast("int").alias("place"))


_MEMBERS_SQL = """WITH m AS (SELECT s_nationkey AS id, 0 AS r, s_suppkey AS ref FROM supplier UNION ALL SELECT c_nationkey, 1, c_custkey FROM customer)
SELECT CAST(id AS BIGINT) AS id, 'node' AS member_type, ref, CASE r WHEN 0 THEN 'supplier' ELSE 'customer' END AS role, CAST(row_number() OVER (PARTITION BY id ORDER BY r, ref) AS INTEGER) AS place FROM m"""


def _members(name: str, fmt: str, extension: str) -> None:
    """Members of relations in their order, with their roles."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        path = f"{fresh_path(spark, name)}.{extension}"
        write(views.nations(spark, d), path, fmt, single=fmt != "opl")
        rows = read_osm(spark, path)[0].select("id", F.posexplode("members").alias("i", "m"))
        return rows.select("id", F.col("m.type").alias("member_type"), F.col("m.ref").alias("ref"), F.col("m.role").alias("role"), (F.col("i") + 1).alias("place"))

    query(name, _MEMBERS_SQL)(run)


_members("members_opl", "opl", "opl")
_members("members_json", "json", "json")
_members("members_xml", "xml", "xml")


@query("members_pbf", _MEMBERS_SQL)
def members_pbf(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "members")
    _pbf_files(views.nations(spark, d).select("type", "id", "tags", "members"), path)
    rows = pbf.read(spark, path).select("id", F.posexplode("members").alias("i", "m"))
    return rows.select("id", F.col("m.type").alias("member_type"), F.col("m.ref").alias("ref"), F.col("m.role").alias("role"), (F.col("i") + 1).alias("place"))


@query("part_views", "SELECT p_partkey AS id, p_size AS version, p_name AS tag_name, p_brand AS tag_brand, CAST(4 AS BIGINT) AS n_tags, 1.5 AS lat, -2.25 AS lon FROM part")
def part_views(spark: SparkSession, d: str) -> DataFrame:
    path = f"{fresh_path(spark, 'parts')}.xml"
    write(views.parts(spark, d), path, "xml", single=False)
    return read_osm(spark, path)[0].select("id", "version", F.col("tags")["name"].alias("tag_name"), F.col("tags")["brand"].alias("tag_brand"), F.size("tags").cast("bigint").alias("n_tags"), "lat", "lon")


_META = Metadata(version="0.6", generator='cart & "weave" <1>', copyright="© some, 文", license="free", timestamp="2024-05-06T07:08:09Z")


@query(
    "metadata_roundtrip",
    """SELECT f AS format, '0.6' AS version, 'cart & "weave" <1>' AS generator, '© some, 文' AS copyright, CASE WHEN f <> 'overpass' THEN 'free' END AS license, CASE WHEN f = 'overpass' THEN '2024-05-06T07:08:09Z' END AS timestamp, n FROM (VALUES ('json'), ('overpass'), ('xml')) AS t(f), (SELECT count(*) AS n FROM region)""",
)
def metadata_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """What a document says of itself, as each format can say it, and how many elements it has."""
    out = None
    for fmt in ("json", "overpass", "xml"):
        path = fresh_path(spark, "metadata")
        write(views.regions(spark, d), path, fmt, _META)
        elements, meta = read_osm(spark, path, "xml" if fmt == "xml" else "json")
        row = elements.agg(F.count("*").alias("n")).select(F.lit(fmt).alias("format"), *(F.lit(v).cast("string").alias(k) for k, v in meta.as_dict().items()), "n")
        out = row if out is None else out.union(row)
    return out


@query("xml_bounds", "SELECT c_custkey AS id, c_name AS tag_name, CAST(1 AS BIGINT) AS n_tags FROM customer")
def xml_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Documents with bounds, which are ignored."""
    path = fresh_path(spark, "bounds")
    line = F.format_string('<node id="%d" lat="1" lon="2"><tag k="name" v="%s"/></node>', "id", F.col("tags")["name"])
    start = '<?xml version="1.0"?><osm version="0.6"><bounds minlat="1" minlon="2" maxlat="3" maxlon="4"/>'
    documents(views.customers(spark, d).select("type", line.alias("value")), start, "</osm>", "xml").write.text(path)
    return xml.read(spark, path).select("id", F.col("tags")["name"].alias("tag_name"), F.size("tags").cast("bigint").alias("n_tags"))


_BAD = "CASE WHEN event_id % 10 = 0 THEN 'v1 Tno=id' WHEN event_id % 10 = 1 THEN 'n' || event_id || ' d?' WHEN event_id % 10 = 2 THEN 'w' || event_id || ' x1 y2' WHEN event_id % 10 = 3 THEN 'n' || event_id || ' ix' ELSE 'n' || event_id || ' x1 y2' END"


@query("opl_errors_drop", "SELECT event_id AS id FROM events WHERE event_id % 10 > 3")
def opl_errors_drop(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/events.parquet").selectExpr(f"{_BAD} AS value")
    return opl.elements(lines, errors="drop").select("id")


@query("opl_errors_keep", f"SELECT {_BAD} AS line, CASE event_id % 10 WHEN 0 THEN 'no element id at the start' WHEN 1 THEN 'visible is neither V nor D' WHEN 2 THEN 'fields of another type of element' WHEN 3 THEN 'bad number' END AS error FROM events")
def opl_errors_keep(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/events.parquet").selectExpr(f"{_BAD} AS value")
    return opl.elements(lines, errors="keep").select("line", "error")


# o5m with places


@query("o5m_order", f"WITH {EVENTS}, {ORDERS}, {REGIONS} SELECT type, id, row_number() OVER (ORDER BY CASE type WHEN 'node' THEN 0 WHEN 'way' THEN 1 ELSE 2 END, id) AS place FROM (SELECT type, id FROM e UNION ALL SELECT type, id FROM o UNION ALL SELECT type, id FROM r)")
def o5m_order(spark: SparkSession, d: str) -> DataFrame:
    """Each element's place in the order: within its partition, after all partitions before it."""
    path = fresh_path(spark, "order")
    o5m.ordered(views.all_elements(spark, d)).select("type", "id", F.monotonically_increasing_id().alias("at")).write.parquet(path)
    rows = spark.read.parquet(path).select("type", "id", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))  # one row for each partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(before, "part").select("type", "id", (F.col("before") + F.col("row") + 1).alias("place"))


_VARINT = "CASE WHEN id < 128 THEN printf('%02x', id) WHEN id < 16384 THEN printf('%02x%02x', id % 128 + 128, id // 128) ELSE printf('%02x%02x%02x', id % 128 + 128, id // 128 % 128 + 128, id // 16384) END"


@query("o5m_user", f"SELECT id, lower('00' || {_VARINT} || '00' || hex(encode(name)) || '00') AS bytes FROM (SELECT c_custkey AS id, c_name AS name FROM customer)")
def o5m_user(spark: SparkSession, d: str) -> DataFrame:
    return views.customers(spark, d).select("id", F.lower(F.hex(o5m.user(F.col("id"), F.col("tags")["name"]))).alias("bytes"))


@query("o5m_header", f"SELECT type, id, kind || {_VARINT} || '00' AS bytes FROM (SELECT 'way' AS type, o_orderkey AS id, '11' AS kind FROM orders UNION ALL SELECT 'relation', r_regionkey, '12' FROM region UNION ALL SELECT 'node', c_custkey, '10' FROM customer)")
def o5m_header(spark: SparkSession, d: str) -> DataFrame:
    some = views.orders(spark, d).unionByName(views.regions(spark, d)).unionByName(views.customers(spark, d))
    return o5m.header(some).select("type", "id", F.lower(F.hex("bytes")).alias("bytes"))


@query(
    "o5m_string_table",
    """WITH s AS (SELECT c_nationkey AS writer, c_custkey AS id, c_mktsegment AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer
), f AS (SELECT writer, x, min(i) AS i FROM s GROUP BY 1, 2
), g AS (SELECT s.writer, s.id, s.x, s.i, f.i AS own, (SELECT count(*) FROM f h WHERE h.writer = s.writer AND h.i > f.i AND h.i <= s.i) AS newer FROM s JOIN f ON f.writer = s.writer AND f.x = s.x)
SELECT id, CASE WHEN i > own THEN CAST(newer + 1 AS INTEGER) END AS place FROM g""",
)
def o5m_string_table(spark: SparkSession, d: str) -> DataFrame:
    """One writer for each nation, which sends its customers' segments in order of id: null is a new string."""

    def run(group):
        import pandas as pd

        table, group = o5m.StringTable(), group.sort_values("id")
        return pd.DataFrame({"id": group["id"], "place": pd.array([table.place(x.encode()) for x in group["segment"]], "Int32")})

    rows = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_nationkey AS writer", "c_custkey AS id", "c_mktsegment AS segment")
    return rows.groupBy("writer").applyInPandas(run, "id long, place int")


# Grammar, and CEL on times and lists


_on_events(
    "grammar_plain_header", 'OSMFilter 0.2.0\n\nHAS "note"\n\tEQUALS "event_type" "error" # trailing\n\t\tSET "a" "1"\n\t# alone\nDELETE "k", "absent"\n\n',
    f"SELECT type, id, note AS tag_note, CASE WHEN note IS NOT NULL AND event_type = 'error' THEN '1' END AS tag_a, CAST({_N} - CASE WHEN k IS NULL THEN 0 ELSE 1 END + CASE WHEN note IS NOT NULL AND event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS n_tags FROM e", ("note", "a"),
)
_on_events("grammar_newlines", 'OSMFilter v0.2.0\r\n\r\nTYPE node, way\r\n\tSET "b" "2"\r\nTYPE relation\r\n\tDROP\r\n', f"SELECT type, id, '2' AS tag_b, CAST(1 + {_N} AS BIGINT) AS n_tags FROM e", ("b",))
_on_events("grammar_raw_strings", f'{HEAD}SET "a b" "c\\\\d \\u0041"\n', f"SELECT type, id, 'c\\\\d \\u0041' AS \"tag_a b\", CAST(1 + {_N} AS BIGINT) AS n_tags FROM e", ("a b",))
_on_events("grammar_other_version", f'OSMFilter v9.9.9\n\nEQUALS "event_type" "view"{_KEEP_ONLY}', f"SELECT type, id, {_TAGS} FROM e WHERE event_type = 'view'")


def _cel_events(name: str, text: str, where: str) -> None:
    query(name, f"WITH {EVENTS} SELECT id FROM e WHERE {where}")(lambda spark, d: apply_filters(views.events(spark, d), [text]).select("id"))


_cel_events("cel_timestamp", "timestamp(timestamp) >= timestamp('2024-01-10T00:00:00Z') && timestamp(timestamp) - timestamp('2024-01-01T00:00:00Z') < duration('480h')", "stamp >= '2024-01-10T00:00:00Z' AND stamp < '2024-01-21T00:00:00Z'")
_cel_events("cel_timestamp_text", "timestamp > '2024-01-15' && timestamp.endsWith('Z')", "stamp > '2024-01-15'")
_cel_events("cel_map_filter", "tags.filter(k, k != 'k').size() == 2 && ['a', 'b'].map(x, x + '1') == ['a1', 'b1'] && tags.map(k, size(k)).exists(n, n == 4)", "note IS NOT NULL")
_cel_events("cel_has_some", "has(tags.note)", "note IS NOT NULL")
_cel_events("cel_missing_key_or", "tags.note == 'check' || tags.event_type == 'click'", "note IS NOT NULL OR event_type = 'click'")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
