"""Idempotent merge of repeated uploads: one fact row per (workspace, request).

Uploads ("deliveries") of a request form a history ordered by ``seq``. Replaying it one by one means:

* a transcript upload *wins* when it is the first transcript, or its output or thinking exceeds everything
  seen before it; the last winner supplies the transcript fields;
* telemetry supplies the row until a transcript arrives; afterwards it only adds latency, source and cost;
* ``output`` is the largest seen, the first reporting device is kept.

The replay is a running maximum, so it is written as window frames followed by one grouped aggregate. Any
delivery order and any number of replays give the same result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import split_hot
from ..functions.pricing import PRICE_BOOK, price_requests
from ..schemas import DELIVERIES, REQUESTS
from .rollups import WS

REQUEST = [WS, "request_id"]
SESSION = [WS, "session_id"]

_WIN_FIELDS = (
    "message_id", "session_id", "ts", "model", "is_subagent", "agent_id", "agent_type", "skill", "plugin",
    "input", "cache_read", "cache_write_5m", "cache_write_1h", "web_search", "web_fetch", "service_tier", "speed",
    "inference_geo", "effort", "entrypoint", "cc_version", "project", "git_branch",
)
_TELEMETRY_FIELDS = (
    "session_id", "ts", "model", "agent_type", "skill", "plugin", "input", "cache_read", "cache_write_5m",
    "speed", "effort", "cc_version",
)
_EXTRA = ("duration_ms", "query_source", "otel_cost_usd")


def as_deliveries(df: DataFrame) -> DataFrame:
    """Fill missing delivery columns with nulls, in schema order."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in DELIVERIES.fields
        ]
    )


HOT_ROWS = 1_000_000
PARTS = 256


def _is_transcript() -> Column:
    return F.col("source") == "transcript"


def _thinking() -> Column:
    return F.when(_is_transcript(), F.coalesce("thinking", F.lit(0)))


def _marked(rows: DataFrame, keys: list[str], columns: list[str], carry: tuple[Column, Column, Column]) -> DataFrame:
    """``wins`` and ``leads`` of each row, from what came before it within ``keys`` and from ``carry``: the largest output and
    thinking and the number of transcripts before the first row of the group."""
    earlier = W.partitionBy(*keys).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    carry_out, carry_think, carry_t = carry
    prior_out = F.greatest(F.max("output").over(earlier), carry_out)
    prior_think = F.greatest(F.max(_thinking()).over(earlier), carry_think)
    prior_t = F.coalesce(F.sum(_is_transcript().cast("long")).over(earlier), F.lit(0)) + carry_t
    staged = rows.withColumns({"_prior_out": prior_out, "_prior_think": prior_think, "_prior_t": prior_t})
    grows = (F.col("output") > F.coalesce("_prior_out", F.lit(0))) | (
        F.coalesce("thinking", F.lit(0)) > F.coalesce("_prior_think", F.lit(0))
    )
    first = F.col("_prior_t") == 0
    is_t = _is_transcript()
    return staged.withColumn("wins", is_t & (first | grows)).withColumn("leads", ~is_t & first).select(*columns, "wins", "leads")


def _marked_parts(deliveries: DataFrame, hot_rows: int | None, parts: int) -> list[DataFrame]:
    """Marked deliveries, ordinary requests and hot ones apart.

    A request normally has a handful of uploads: one window, one shuffle. The uploads of a request repeated without end (a
    stuck collector) are cut into ranges of ``seq``. Each range is summarised, the summaries are scanned in order, and every
    range starts from the maxima of those before it. Without hot requests the second frame is empty, and Spark drops its
    plan once the counts are known. ``hot_rows=None`` skips the check.
    """
    nothing = F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(0).cast("long")
    if hot_rows is None:
        return [_marked(deliveries, REQUEST, deliveries.columns, nothing)]
    cold, hot = split_hot(deliveries, REQUEST, "seq", hot_rows, parts)
    keys = [*REQUEST, "_slice"]
    sums = hot.groupBy(*keys).agg(F.max("output").alias("_out"), F.max(_thinking()).alias("_think"), F.count_if(_is_transcript()).alias("_t"))
    before = W.partitionBy(*REQUEST).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(
        *keys, F.max("_out").over(before).alias("_carry_out"), F.max("_think").over(before).alias("_carry_think"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_carry_t"),
    )
    cut = hot.join(carried, keys)
    carry = F.col("_carry_out"), F.col("_carry_think"), F.col("_carry_t")
    return [_marked(cold, REQUEST, deliveries.columns, nothing), _marked(cut, keys, deliveries.columns, carry)]


def with_wins(deliveries: DataFrame, hot_rows: int | None = HOT_ROWS, parts: int = PARTS) -> DataFrame:
    """Mark each delivery: ``wins`` for transcripts that change the row, ``leads`` for telemetry that comes
    before any transcript."""
    return functools.reduce(DataFrame.unionByName, _marked_parts(deliveries, hot_rows, parts))


def _summed(marked: DataFrame) -> DataFrame:
    """Everything a fact row needs of the marked deliveries of its request."""
    is_t = F.col("source") == "transcript"

    def last(value, condition):
        return F.max_by(value, F.when(condition, F.col("seq")))

    def first(value, condition):
        return F.min_by(value, F.when(condition, F.col("seq")))

    wins, leads = F.col("wins"), F.col("leads")
    follows = ~is_t & ~leads
    has_device = (wins | leads) & F.col("device_id").isNotNull()
    from_agent = F.coalesce("is_subagent", F.col("agent_type").isNotNull())
    return marked.groupBy(*REQUEST).agg(
        F.count_if(is_t).alias("_n_t"),
        F.count_if(~is_t).alias("_n_o"),
        F.max("output").alias("output"),
        F.max(F.when(wins, F.col("thinking"))).alias("thinking"),
        first(F.col("device_id"), has_device).alias("device_id"),
        last(F.struct(*_WIN_FIELDS), wins).alias("_w"),
        last(F.struct(*_TELEMETRY_FIELDS), leads).alias("_o"),
        first(from_agent, leads).alias("_o_subagent"),
        last(F.struct(*_EXTRA), leads).alias("_lead"),
        *[last(F.col(c), follows & F.col(c).isNotNull()).alias(f"_late_{c}") for c in _EXTRA],
    )


def merge_deliveries(
    deliveries: DataFrame, book=PRICE_BOOK, hot_rows: int | None = HOT_ROWS, parts: int = PARTS
) -> DataFrame:
    """Fact rows from the whole delivery history (transcripts and telemetry).

    Ordinary requests are grouped where their window has dealt them already.
    """
    marked = _marked_parts(as_deliveries(deliveries), hot_rows, parts)
    grouped = functools.reduce(DataFrame.unionByName, [_summed(m) for m in marked])
    has_t = F.col("_n_t") > 0

    def field(name: str):
        kind = REQUESTS[name].dataType
        if name in _TELEMETRY_FIELDS:
            other = F.col(f"_o.{name}")
        elif name == "is_subagent":
            other = F.col("_o_subagent")
        elif name in ("cache_write_1h", "web_search", "web_fetch"):
            other = F.lit(0)
        else:
            other = F.lit(None)
        return F.when(has_t, F.col(f"_w.{name}")).otherwise(other.cast(kind)).alias(name)

    sources = F.array_compact(
        F.array(F.when(F.col("_n_o") > 0, F.lit("otel")), F.when(has_t, F.lit("transcript")))
    )
    rows = grouped.select(
        *REQUEST, "output", "thinking", "device_id",
        *[field(n) for n in _WIN_FIELDS],
        *[F.coalesce(f"_late_{c}", f"_lead.{c}").alias(c) for c in _EXTRA],
        sources.alias("sources"),
    )
    return price_requests(rows, book).select(*[f.name for f in REQUESTS.fields])


def stored_as_deliveries(current: DataFrame) -> DataFrame:
    """Rewrite stored fact rows as the shortest delivery history that produces them.

    Putting these before new uploads and merging gives the same rows as merging everything from the start,
    so an incremental upsert never needs the old uploads.
    """
    is_t = F.array_contains("sources", "transcript")
    is_o = F.array_contains("sources", "otel")
    cols = [c for c in DELIVERIES.names if c in current.columns]
    base = current.select(*cols, is_t.alias("_t"), is_o.alias("_o"))
    transcript = base.filter("_t").withColumn("source", F.lit("transcript")).withColumn("seq", F.lit(-2))
    telemetry = base.filter("_o").withColumn("source", F.lit("otel")).withColumn("seq", F.lit(-1))
    # After a transcript, telemetry carries only latency, source and cost.
    telemetry = telemetry.withColumn("output", F.when(F.col("_t"), F.lit(0)).otherwise(F.col("output")))
    return as_deliveries(transcript).unionByName(as_deliveries(telemetry))


def upsert_requests(current: DataFrame, incoming: DataFrame, book=PRICE_BOOK, hot_rows=HOT_ROWS) -> DataFrame:
    """Merged rows of every request in ``incoming``, starting from what is stored for it."""
    touched = incoming.select(*REQUEST).distinct()
    stored = stored_as_deliveries(current.join(touched, REQUEST, "left_semi"))
    return merge_deliveries(stored.unionByName(as_deliveries(incoming)), book, hot_rows)


def merge_counts(deliveries: DataFrame, by: list[str], hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Accepted and deduplicated uploads per group (a batch, a device, ...). Telemetry always counts as
    accepted."""
    marked = with_wins(as_deliveries(deliveries), hot_rows)
    duplicate = (F.col("source") == "transcript") & ~F.col("wins")
    return marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(~duplicate).alias("accepted"),
        F.count_if(duplicate).alias("deduplicated"),
    )


def is_duplicate(output="output", thinking="thinking", stored="stored"):
    """Predicate: the stored row came from a transcript and already holds at least these counts."""
    s = F.col(stored)
    return (
        F.coalesce(F.array_contains(s["sources"], "transcript"), F.lit(False))
        & (F.col(output) <= F.coalesce(s["output"], F.lit(0)))
        & (F.coalesce(F.col(thinking), F.lit(0)) <= F.coalesce(s["thinking"], F.lit(0)))
    )


def drop_known(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """Incoming transcript uploads without those the store already covers (reads four stored columns)."""
    known = current.select(*REQUEST, F.struct("sources", "output", "thinking").alias("stored"))
    joined = incoming.join(known, REQUEST, "left")
    return joined.filter(F.col("stored").isNull() | ~is_duplicate()).drop("stored")


# ---- session records -------------------------------------------------------------------------------


def merge_meta(records: DataFrame) -> DataFrame:
    """Session titles: newest non-null value wins, but a generated title never replaces a custom one.

    Generated titles count only before the first custom one of their session; that instant is aggregated
    first and joined back, so no session is ever sorted in one task.
    """
    custom = records.filter(F.col("title_source") == "custom").groupBy(*SESSION).agg(
        F.min("seq").alias("_custom")
    )
    joined = records.join(custom, SESSION, "left")
    counts = ~F.coalesce((F.col("title_source") == "ai") & (F.col("seq") > F.col("_custom")), F.lit(False))

    def last(name: str, condition):
        return F.max_by(name, F.when(condition & F.col(name).isNotNull(), F.col("seq"))).alias(name)

    clock = [F.max("updated_at").alias("updated_at")] if "updated_at" in records.columns else []
    return joined.groupBy(*SESSION).agg(
        last("title", counts), last("title_source", counts), last("agent_name", F.lit(True)), *clock
    )


def meta_changes(records: DataFrame, hot_rows: int = HOT_ROWS, parts: int = PARTS) -> DataFrame:
    """Whether each session record changed what was stored before it (records that do not are no-ops)."""
    names = ("title", "title_source", "agent_name")
    seen = records.groupBy(*SESSION).agg(
        F.min("seq").alias("_first"),
        F.min(F.when(F.col("title_source") == "custom", F.col("seq"))).alias("_custom"),
    )
    blocked = F.coalesce((F.col("title_source") == "ai") & (F.col("seq") > F.col("_custom")), F.lit(False))
    staged = records.join(seen, SESSION).select(
        *records.columns, "_first",
        F.when(~blocked, F.col("title")).alias("_title"),
        F.when(~blocked, F.col("title_source")).alias("_title_source"),
        F.col("agent_name").alias("_agent_name"),
    )
    cold, hot = split_hot(staged, SESSION, "seq", hot_rows, parts)
    keys = [*SESSION, "_slice"]
    sums = hot.groupBy(*keys).agg(
        *[F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col("seq"))).alias(f"_{n}") for n in names]
    )
    earlier_slices = W.partitionBy(*SESSION).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select(*keys, *[F.last(f"_{n}", True).over(earlier_slices).alias(f"_carry_{n}") for n in names])

    def marked(base: DataFrame, within: list[str], carried) -> DataFrame:
        up_to = W.partitionBy(*within).orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
        prior = W.partitionBy(*within).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
        same = F.lit(True)
        for n in names:
            before = F.coalesce(F.last(f"_{n}", True).over(prior), carried(n))
            after = F.coalesce(F.last(f"_{n}", True).over(up_to), carried(n))
            same = same & before.eqNullSafe(after)
        return base.withColumn("changed", (F.col("seq") == F.col("_first")) | ~same).select(*records.columns, "changed")

    ordinary = marked(cold, SESSION, lambda n: F.lit(None).cast("string"))
    return ordinary.unionByName(marked(hot.join(carry, keys), keys, lambda n: F.col(f"_carry_{n}")))


def merge_snapshots(records: DataFrame) -> DataFrame:
    """Last snapshot of each session."""
    fields = [c for c in records.columns if c not in (*SESSION, "seq")]
    return records.groupBy(*SESSION).agg(F.max_by(F.struct(*fields), "seq").alias("_s")).select(*SESSION, "_s.*")


def changed_snapshots(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming snapshots that differ from what is stored (maps compare by their sorted entries)."""
    fields = [c for c in incoming.columns if c not in SESSION and c != "updated_at"]

    def image(df: DataFrame):
        parts = []
        for c in fields:
            is_map = df.schema[c].dataType.typeName() == "map"
            parts.append(F.array_sort(F.map_entries(c)).alias(c) if is_map else F.col(c))
        return F.struct(*parts)

    stored = current.select(*SESSION, image(current).alias("_stored"))
    joined = incoming.withColumn("_new", image(incoming)).join(stored, SESSION, "left")
    return joined.filter(~F.col("_new").eqNullSafe(F.col("_stored"))).select(*incoming.columns)


def first_wins(records: DataFrame, key: str = "id") -> DataFrame:
    """Insert-or-ignore: the first upload of each id is kept."""
    keys = [WS, key]
    fields = [c for c in records.columns if c not in (*keys, "seq")]
    return records.groupBy(*keys).agg(F.min_by(F.struct(*fields), "seq").alias("_r")).select(*keys, "_r.*")


def insert_new(current: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``incoming`` whose id is not stored yet, one per id."""
    return first_wins(incoming, key).join(current.select(WS, key), [WS, key], "left_anti")
