"""JSON-lines message log: parse (S6), quarantine (S7), accept sources (S8), merge.

A message is one JSON value per line, externally tagged:
``"Ping"``, ``{"Handshake":{"protocol_version":1,"backend_name":"x"}}``,
``{"Event":{"ActiveWindowChanged":"kitty"}}`` (or ``null`` = focus lost),
``{"Event":{"WorkspaceChanged":3}}``, ``{"Event":{"Idle":true}}``, ``{"Event":"Tick"}``.

Lines are parsed once into VARIANT (``try_parse_json``). Values are read only when
``schema_of_variant`` names the type that was written, so ``"3"`` is no workspace and ``1`` no
flag; a present JSON null (type VOID) is told apart from an absent key (SQL NULL). Lines over
the size limit are never parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake import schema
from sessionlake.config import MAX_MESSAGE_SIZE, PROTOCOL_VERSION


def read_message_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Read envelope rows (stream_key, source, seq, ts, line) with an explicit schema.

    The log is stored as Parquet; each producer writes its own files, and
    ``seq`` orders the lines of one source.
    """
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema.ENVELOPES_KEYED).parquet(path)


#: Names of the wire types as `schema_of_variant` gives them, and the largest unsigned 32-bit number.
WIRE_INT, WIRE_TEXT, WIRE_FLAG, WIRE_NULL = "BIGINT", "STRING", "BOOLEAN", "VOID"
U32_MAX = 2**32 - 1


def _object(v: Column) -> Column:
    """The fields of a variant object by name; NULL if it is no object."""
    return F.when(F.schema_of_variant(v).startswith("OBJECT<"), F.try_variant_get(v, "$", "map<string,variant>"))


def _only(fields: Column, tag: str) -> Column:
    """The value under ``tag`` if it is the only field: messages carry exactly one tag."""
    return F.when(F.size(fields) == 1, F.element_at(fields, tag))


def _typed(v: Column, wire: str, sql: str) -> Column:
    """The value as ``sql`` if it was written as the wire type; never converted from another."""
    return F.when(F.schema_of_variant(v) == wire, F.try_variant_get(v, "$", sql))


def parse_envelopes(envelopes: DataFrame) -> DataFrame:
    """S6 + S7: every line gets ``msg_type`` (Ping, Handshake, Event) or a ``reject`` reason.

    Event rows get ``kind`` (focus, workspace, idle_on, idle_off, tick) and the
    payload columns ``app_id``, ``workspace``; handshakes get
    ``protocol_version`` and ``backend_name``. A message has exactly one tag, and each value
    the type that its tag asks for; anything else is an unknown message.
    """
    line, c = F.col("line"), F.col
    keep = [x for x in envelopes.columns if x != "line"]
    small = F.octet_length(line) <= F.lit(MAX_MESSAGE_SIZE)
    df = envelopes.select(*keep, (~small).alias("_big"), F.when(small, F.try_parse_json(line)).alias("_v"))

    def stage(df: DataFrame, **fields: Column) -> DataFrame:
        """Read each value once: fields come out of a one-row generator, below which no filter is pushed."""
        held = [x for x in df.columns if x not in fields]
        return df.select(*held, F.inline(F.array(F.struct(*(v.alias(k) for k, v in fields.items())))))

    df = stage(df, _top=_object(c("_v")), _text=_typed(c("_v"), WIRE_TEXT, "string"))
    df = stage(df, _event=_only(c("_top"), "Event"), _hello=_object(_only(c("_top"), "Handshake")))
    df = stage(df, _tags=_object(c("_event")), _etext=_typed(c("_event"), WIRE_TEXT, "string"))
    focus, idle = _only(c("_tags"), "ActiveWindowChanged"), _only(c("_tags"), "Idle")
    version = _typed(F.element_at(c("_hello"), "protocol_version"), WIRE_INT, "bigint")
    df = stage(
        df,
        _lost=F.coalesce(F.schema_of_variant(focus) == WIRE_NULL, F.lit(False)),
        _app=_typed(focus, WIRE_TEXT, "string"),
        _ws=_typed(_only(c("_tags"), "WorkspaceChanged"), WIRE_INT, "int"),
        _away=_typed(idle, WIRE_FLAG, "boolean"),
        _pv=F.when(version.between(0, U32_MAX), version),
        _bn=_typed(F.element_at(c("_hello"), "backend_name"), WIRE_TEXT, "string"),
    )
    kind = (
        F.when(c("_etext") == "Tick", "tick")
        .when(c("_lost") | c("_app").isNotNull(), "focus")
        .when(c("_ws").isNotNull(), "workspace")
        .when(c("_away"), "idle_on")
        .when(~c("_away"), "idle_off")
    )
    df = stage(df, kind=kind)
    hello = c("_pv").isNotNull() & c("_bn").isNotNull()
    msg_type = F.when(c("_text") == "Ping", "Ping").when(hello, "Handshake").when(c("kind").isNotNull(), "Event")
    df = stage(df, msg_type=msg_type)
    reject = (
        F.when(c("_big"), F.lit("message too large"))
        .when(c("_v").isNull(), F.lit("malformed json"))
        .when(c("msg_type").isNull(), F.lit("unknown message"))
    )
    return df.select(
        *keep,
        "msg_type",
        "kind",
        F.when(c("kind") == "focus", c("_app")).alias("app_id"),
        F.when(c("kind") == "workspace", c("_ws")).alias("workspace"),
        F.when(c("msg_type") == "Handshake", c("_pv")).alias("protocol_version"),
        F.when(c("msg_type") == "Handshake", c("_bn")).alias("backend_name"),
        reject.alias("reject"),
    )


def split_quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with reason). Rejects are kept, never dropped silently."""
    good = parsed.filter(F.col("reject").isNull()).drop("reject")
    bad = parsed.filter(F.col("reject").isNotNull())
    return good, bad


def accept_sources(parsed: DataFrame, enforce: bool = True, max_version: int = PROTOCOL_VERSION) -> DataFrame:
    """A source is accepted when its latest handshake declares a version ``<= max_version``.

    The latest handshake per source is a ``max_by`` aggregate (partial, no
    sort). With ``enforce=True`` only rows of accepted sources stay (left semi
    join); ``enforce=False`` keeps every row and adds ``accepted``. Spark picks
    broadcast or shuffle for the per-source table from its size estimate.
    """
    hs = (
        parsed.filter(F.col("msg_type") == "Handshake")
        .groupBy("source")
        .agg(F.max_by("protocol_version", F.struct("ts", "seq")).alias("_pv"))
        .select("source", (F.col("_pv") <= F.lit(max_version)).alias("accepted"))
    )
    if enforce:
        return parsed.join(hs.filter(F.col("accepted")).select("source"), "source", "left_semi")
    return parsed.join(hs, "source", "left").withColumn("accepted", F.coalesce(F.col("accepted"), F.lit(False)))


def merge_sources(*logs: DataFrame) -> DataFrame:
    """Several producers feed one state: union by name; order is (ts, seq) within a key."""
    out = logs[0]
    for other in logs[1:]:
        out = out.unionByName(other)
    return out


def to_session_events(parsed: DataFrame) -> DataFrame:
    """Event rows of accepted messages as sessionizer input (ticks dropped: the clock is virtual)."""
    return parsed.filter((F.col("msg_type") == "Event") & (F.col("kind") != "tick")).select(
        "stream_key", "seq", "ts", "kind", "app_id", F.col("workspace").cast("int").alias("workspace")
    )
