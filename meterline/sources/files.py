"""Readers of usage files: grouped scans, daily graphs, JSON lines, transcripts, SQLite tables, price catalogs.

Schemas are given, never inferred. Malformed lines become null rows and are dropped, as a reader of live logs must.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import scalars as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

# The spellings under which usage rows name their fields, in the order in which they win.
ALIASES = {
    "total": ["totalTokens", "total_tokens", "totalTokenCount", "total_token_count", "tokens", "tokenCount", "token_count"],
    "input": ["input", "inputTokens", "input_tokens", "promptTokens", "prompt_tokens", "totalInput"],
    "output": ["output", "outputTokens", "output_tokens", "completionTokens", "completion_tokens", "totalOutput"],
    "cache_read": ["cacheRead", "cacheReadTokens", "cache_read_tokens", "cachedTokens", "cached_tokens", "cacheReadInputTokens", "totalCacheRead"],
    "cache_write": ["cacheWrite", "cacheWriteTokens", "cache_write_tokens", "cacheCreationInputTokens", "totalCacheWrite"],
    "reasoning": ["reasoning", "reasoningTokens", "reasoning_tokens"],
    "cost": ["costUsd", "cost_usd", "costUSD", "cost", "totalCost", "total_cost"],
    "messages": ["messageCount", "message_count", "messages", "totalMessages", "total_messages"],
}
TEXT_ALIASES = {
    "client": ["client", "clients", "source", "platform", "agent", "tool", "name"],
    "session": ["sessionId", "session_id", "session", "conversationId", "conversation_id", "threadId", "thread_id"],
    "model": ["model", "modelId", "model_id"],
    "provider": ["provider", "providerId"],
    "started_at": ["startedAt", "started_at", "createdAt", "created_at"],
    "last_used_at": ["lastUsedAt", "last_used_at", "updatedAt", "updated_at", "lastActivityAt", "last_activity_at", "timestamp"],
}
# Components that add up to a total where none is given; reasoning is part of output for all tools but one.
COMPONENTS = [
    "input", "inputTokens", "input_tokens", "promptTokens", "prompt_tokens", "output", "outputTokens", "output_tokens", "completionTokens", "completion_tokens",
    "cacheRead", "cacheReadTokens", "cache_read_tokens", "cacheWrite", "cacheWriteTokens", "cache_write_tokens", "cachedTokens", "cached_tokens",
    "cacheCreationInputTokens", "cache_creation_input_tokens", "cacheReadInputTokens", "cache_read_input_tokens", "totalInput", "totalOutput", "totalCacheRead", "totalCacheWrite",
]
USAGE_DDL = "client string, session string, model string, provider string, started_at string, last_used_at string, total long, input long, output long, cache_read long, cache_write long, reasoning long, cost double, messages long"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file (A5)."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter("length(trim(value)) > 0")


def usage_row(json_text: Column) -> dict[str, Column]:
    """The fields of a usage row in JSON, by the first alias that is not 0 or blank."""
    field = lambda name: F.get_json_object(json_text, f"$.{name}")
    out = {k: S.first_text(*[field(a) for a in v]) for k, v in TEXT_ALIASES.items()}
    number = {k: S.first_number(*[field(a) for a in v]) for k, v in ALIASES.items()}
    client = S.client_id(F.nullif(out["client"], F.lit("")))
    every = F.lit(0.0)
    for a in COMPONENTS:
        every = every + S.lenient_number(field(a))
    extra = F.when(client == "reasonix", F.greatest(F.lit(0.0), number["reasoning"])).otherwise(0.0)  # its reasoning is not part of its output
    total = F.when(number["total"] != 0, number["total"]).otherwise(every + extra)
    out |= {k: S.whole(v) for k, v in number.items() if k not in ("cost", "total", "output")}
    out |= {"client": client, "model": S.model_id(out["model"], client), "total": S.whole(total), "output": S.whole(F.greatest(F.lit(0.0), number["output"]) + extra), "cost": number["cost"]}
    return out


def usage_rows(documents: DataFrame, column: str = "value") -> DataFrame:
    """Usage rows of JSON lines that have tokens or cost and a client, session or model."""
    rows = documents.select(*[c.alias(k) for k, c in usage_row(F.col(column)).items()])
    return rows.filter("(total <> 0 or cost <> 0) and (client is not null or session <> '' or model is not null)")


def nested_usage_rows(documents: DataFrame, column: str = "value") -> DataFrame:
    """Usage rows at any depth of JSON documents: a node that looks like a row is a leaf (A4, U). One Arrow pass; documents are bounded by what a tool prints."""

    def walk(batches):
        import pyarrow as pa

        numbers = {a for v in ALIASES.values() for a in v} | set(COMPONENTS)
        names = {a for k in ("client", "session", "model") for a in TEXT_ALIASES[k]}

        def nodes(x) -> Iterator[dict]:
            if isinstance(x, dict):
                if any(_number(x.get(a)) for a in numbers) and any(isinstance(x.get(a), str) and x[a].strip() for a in names):
                    yield x
                    return
                x = list(x.values())
            if isinstance(x, list):
                for y in x:
                    yield from nodes(y)

        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                try:
                    found += [json.dumps(n) for n in nodes(json.loads(text or "null"))]
                except (ValueError, RecursionError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["value"])

    return usage_rows(documents.select(F.col(column).alias("value")).mapInArrow(walk, "value string"))


def _number(value) -> float:
    try:
        return float(str(value).replace("$", "").replace(",", "")) if isinstance(value, (int, float, str)) and not isinstance(value, bool) else 0.0
    except ValueError:
        return 0.0


GRAPH_DDL = "contributions array<struct<date:string,activeTimeMs:bigint,clients:array<struct<client:string,modelId:string,providerId:string,tokens:struct<input:bigint,output:bigint,cacheRead:bigint,cacheWrite:bigint,reasoning:bigint>,cost:double,messages:bigint>>>>"


def graph_days(documents: DataFrame, column: str = "value") -> DataFrame:
    """A daily graph as rows of day, client and model; totals are of the components, not the reported ones."""
    days = documents.select(F.explode(F.from_json(column, GRAPH_DDL)["contributions"]).alias("d"))
    rows = days.select(S.strict_day(F.col("d.date")).alias("day"), F.explode("d.clients").alias("c")).filter("day is not null")
    part = lambda name: F.greatest(F.lit(0), F.coalesce(F.col(f"c.tokens.{name}"), F.lit(0)))
    client = S.client_id(F.col("c.client"))
    total = part("input") + part("output") + part("cacheRead") + part("cacheWrite") + F.when(client == "reasonix", part("reasoning")).otherwise(0)
    rows = rows.select("day", client.alias("client"), S.model_id(F.col("c.modelId"), client).alias("model"), total.alias("tokens"), F.coalesce("c.cost", F.lit(0.0)).alias("cost"), F.coalesce("c.messages", F.lit(0)).alias("messages"))
    return rows.groupBy("day", "client", "model").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.sum("messages").alias("messages"))


CHAT_DDL = "type string, uuid string, timestamp string, cwd string, message struct<id:string,role:string,content:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>>"


def chat_events(log: DataFrame) -> DataFrame:
    """Prompts and turns of transcripts in JSON lines (file, seq, value): repeated uuids and repeated message ids count once, tools of a message's lines join."""
    from ..operators.transcripts import first_by_message

    row = F.from_json("value", CHAT_DDL)
    rows = log.select("file", "seq", row.alias("r")).filter("r is not null and r.type in ('user', 'assistant')")
    tools = F.filter(F.from_json(F.get_json_object(F.col("r.message.content"), "$[*].name"), "array<string>"), lambda x: x.isNotNull())
    usage = "r.message.usage."
    tokens = sum((F.coalesce(F.col(usage + c), F.lit(0)) for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")), F.lit(0))
    flat = rows.select("file", "seq", F.col("r.uuid").alias("uuid"), F.when(F.col("r.type") == "assistant", F.col("r.message.id")).alias("message_id"), F.when(F.col("r.type") == "user", "prompt").otherwise("turn").alias("kind"), tokens.alias("tokens"), F.col("r.timestamp").alias("at"), F.coalesce(tools, F.array().cast("array<string>")).alias("tools"))
    return first_by_message(flat)


def last_times(log: DataFrame, pattern: str = r'"timestamp"\s*:\s*"([^"]+)"') -> DataFrame:
    """Of each file its newest timestamp and the first working directory that is not blank."""
    at = F.try_to_timestamp(F.regexp_extract("value", pattern, 1))
    cwd = F.nullif(F.coalesce(F.get_json_object("value", "$.cwd"), F.get_json_object("value", "$.project_path"), F.lit("")), F.lit(""))
    return log.groupBy("file").agg(F.max(at).alias("last_at"), F.min_by(cwd, F.when(cwd.isNotNull(), F.col("seq"))).alias("cwd"))


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """The rows, or an error if there are more than `most`."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return rows


def price_sources(documents: DataFrame) -> DataFrame:
    """Price catalogs (priority, value as JSON with timestamp and data) as rows of model keys and rates; a catalog with a bad rate is void as a whole."""
    ddl = "timestamp bigint, data map<string, struct<input_cost_per_token:double,output_cost_per_token:double,cache_read_input_token_cost:double,cache_creation_input_token_cost:double>>"
    rows = documents.select("priority", F.from_json("value", ddl).alias("c")).select("priority", S.instant(F.col("c.timestamp")).alias("dated"), F.explode("c.data").alias("model_key", "r"))
    names = ("input_cost_per_token", "output_cost_per_token", "cache_read_input_token_cost", "cache_creation_input_token_cost")
    bad = F.lit(False)
    for n in names:
        bad = bad | F.coalesce((F.col(f"r.{n}") < 0) | F.isnan(f"r.{n}"), F.lit(False))
    good = rows.groupBy("priority").agg(F.bool_or(bad).alias("bad")).filter("not bad").select("priority")
    rates = dict(zip(names, ("input_rate", "output_rate", "read_rate", "write_rate")))
    return rows.join(good, "priority").select(F.lower(F.trim("model_key")).alias("model_key"), "dated", "priority", *[F.col(f"r.{n}").alias(a) for n, a in rates.items()])


class SqliteSource(DataSource):
    """A query on SQLite files, a partition a file. Options: paths (comma-separated), query, schema."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self):
        return self.options["schema"]

    def reader(self, schema):
        return SqliteReader(self.options["paths"].split(","), self.options["query"])


class SqliteReader(DataSourceReader):
    def __init__(self, paths: list[str], query: str):
        self.paths, self.query = paths, query

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        import sqlite3

        with sqlite3.connect(f"file:{partition.value}?mode=ro", uri=True) as db:
            yield from db.execute(self.query)


def sqlite_rows(spark: SparkSession, paths: list[str], query: str, schema: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("paths", ",".join(paths)).option("query", query).option("schema", schema).load()


def decoded_requests(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows of requests with JSON columns: cached tokens split from prompt tokens, model codes named, times in any unit; the last row of a message wins."""
    token = lambda name: S.whole(S.lenient_number(F.get_json_object("token_info", f"$.{name}")))
    at = F.col("gmt_create").try_cast("double")
    when = F.when(at.isNull(), F.try_to_timestamp("gmt_create")).when(at < 1e12, F.timestamp_seconds(at)).otherwise(F.timestamp_millis(at.cast("long")))
    cached = F.least(token("cached_tokens"), token("prompt_tokens"))
    flat = rows.select("source", "row_id", F.col("id").alias("message_id"), "session_id", (token("prompt_tokens") - cached).alias("input"), cached.alias("cache_read"), token("completion_tokens").alias("output"), F.get_json_object("model_info", "$.model_key").alias("code"), when.alias("ts"))
    named = flat.join(F.broadcast(codes), "code", "left").withColumn("model", F.coalesce("model", "code")).drop("code")  # codes: a fixed list
    from ..operators.devices import latest

    return latest(named, ["message_id"], [F.col("source"), F.col("row_id")])


# Where tools keep transcripts under a home, in the order in which they are searched, and the endings of a native session's files.
TRANSCRIPT_ROOTS = {"claude": [".claude/projects", ".claude/transcripts"], "codex": [".codex/sessions"]}
META, TELEMETRY, EVENTS = ".jsonl.meta", ".jsonl.telemetry.json", ".events.jsonl"


def _listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The paths of files below a folder, unread; none if there is no such folder."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string")


def session_files(spark: SparkSession, home: str, wanted: DataFrame) -> DataFrame:
    """The transcript of each wanted session (client, session), null if there is none.

    A session that names its day is looked for in that day's folder first; else the first root that has a file of its name counts, and there the first path.
    """
    found = None
    for client, roots in TRANSCRIPT_ROOTS.items():
        for rank, root in enumerate(roots):
            one = _listed(spark, f"{home}/{root}", "*.jsonl").select(F.lit(client).alias("client"), F.lit(rank + 1).alias("rank"), "path", F.lit(root).alias("root"))
            found = one if found is None else found.unionByName(one)
    stem = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    day = F.regexp_extract(stem, r"^rollout-(\d{4}-\d{2}-\d{2})T", 1)
    own = (F.col("client") == "codex") & (day != "") & F.col("path").endswith(F.concat(F.lit("/"), F.col("root"), F.lit("/"), F.replace(day, F.lit("-"), F.lit("/")), F.lit("/"), stem, F.lit(".jsonl")))
    first = found.withColumns({"session": stem, "rank": F.when(own, 0).otherwise(F.col("rank"))}).groupBy("client", "session").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return wanted.join(first, ["client", "session"], "left")


def native_sessions(metas: DataFrame, telemetry: DataFrame, logs: DataFrame) -> DataFrame:
    """Sessions from the files beside a native transcript, joined on folder and stem (A16); the entries that native_view takes.

    `metas` and `telemetry` have folder, stem and value (JSON); `logs` has folder, stem, messages (null if the log can't be replayed) and last_message_at. A session has an
    id, and usage or a log; one whose log can't be replayed is dropped. Tokens are null without usage. Counts of the meta file are trusted from its first schema version on.
    """
    v, u = F.col("meta"), F.col("usage")
    text = lambda c, *names: S.first_text(*[F.get_json_object(c, f"$.{n}") for n in names])
    number = lambda c, *names: F.coalesce(*[F.get_json_object(c, f"$.{n}").try_cast("double") for n in names])
    ids = ["id", "ID", *[f"{b}.{i}" for b in ("BranchMeta", "branchMeta", "branch_meta", "branch") for i in ("id", "ID")]]
    key = ["folder", "stem"]
    rows = metas.select(*key, F.col("value").alias("meta")).join(telemetry.select(*key, F.col("value").alias("usage")), key, "left").join(logs.select(*key, "messages", "last_message_at", F.lit(True).alias("logged")), key, "left")
    total = number(u, "totalTokens", "total_tokens")
    root = text(v, "workspace_root", "workspaceRoot")
    scope = F.when(F.lower(text(v, "scope")) == "project", "project").otherwise("global")
    inside = (scope == "project") & F.replace(root, F.lit("\\"), F.lit("/")).rlike("^(/|[A-Za-z]:/)")
    time = lambda name, camel: F.try_to_timestamp(F.nullif(text(v, name, camel), F.lit("")))
    trusted = F.coalesce(number(v, "schema_version", "schemaVersion") >= 1, F.lit(False))
    made, changed = time("created_at", "createdAt"), time("updated_at", "updatedAt")
    fields = {
        "session": F.concat(F.lit("reasonix:"), F.nullif(text(v, *ids), F.lit(""))), "scope": scope, "model": S.model_id(text(v, "model"), F.lit("reasonix")), "project_label": F.when(inside, F.element_at(F.split(S.project_path(root), "/"), -1)),
        "project_id": F.when(inside, S.project_identity(root)), "created_at": made, "started_at": made, "last_used_at": changed, "last_message_at": F.col("last_message_at"), "messages": F.col("messages"),
        "turns": F.when(trusted, number(v, "turns").cast("long")), "preview": F.when(trusted, F.nullif(text(v, "preview"), F.lit(""))), "total": F.when(total.isNotNull(), S.whole(total)),
        **{n: F.when(total.isNotNull(), S.whole(F.coalesce(number(u, camel, snake), F.lit(0.0)))) for n, camel, snake in (("prompt", "promptTokens", "prompt_tokens"), ("completion", "completionTokens", "completion_tokens"), ("reasoning", "reasoningTokens", "reasoning_tokens"), ("cache_read", "cacheHitTokens", "cache_hit_tokens"), ("cache_write", "cacheWriteTokens", "cache_write_tokens"))},
        "parent": F.nullif(text(v, "parent_id", "parentId"), F.lit("")), "seq": F.concat_ws("/", *key),
    }
    kept = F.when(F.coalesce("logged", F.lit(False)), F.col("messages").isNotNull()).otherwise(total.isNotNull())
    return rows.filter(kept).select(*[c.alias(n) for n, c in fields.items()]).filter("session is not null")


def sidecars(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The files beside native transcripts below a folder by their ending: folder, stem and the whole text of each (A16). A file is at most what one session writes."""
    out = {}
    for ending in (META, TELEMETRY, EVENTS):
        read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{ending}").text(folder, wholetext=True)
        path = F.col("_metadata.file_path")
        out[ending] = read.select(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract(path, "([^/]*)" + ending.replace(".", r"\.") + "$", 1).alias("stem"), "value")
    return out
