"""Session list, session statistics and session detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import running_totals
from ..functions.pricing import PRICE_BOOK, model_label, prompt_tokens, with_prices
from ..functions.quantiles import exact_quantiles
from .rollups import WS, filtered, search_requests, top_n, value_of

SESSION = [WS, "session_id"]


_MODES = ("project", "entrypoint", "git_branch", "device_id")
_MEASURES = ("value", "subagent_value", "input", "output", "cache_read", "cache_write")


def session_rollup(requests: DataFrame) -> DataFrame:
    """One row per session; text fields take their most frequent value (ties: the smallest).

    Requests collapse to the combinations of text fields that a session has, which are dealt by session. There, values are
    counted per field and ranked, so no buffer holds the values of a session; its models are the values of one field.
    The number of parts is given, since parts merged by their size before the fields go apart grow several times after.
    """
    combined = requests.groupBy(*SESSION, "model", *_MODES).agg(
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
        F.count(F.lit(1)).alias("n"),
        F.sum("value_usd").alias("value"),
        value_of(F.col("is_subagent")).alias("subagent_value"),
        F.sum("input").alias("input"),
        F.sum("output").alias("output"),
        F.sum("cache_read").alias("cache_read"),
        F.sum(F.col("cache_write_5m") + F.col("cache_write_1h")).alias("cache_write"),
    )
    fields = F.explode(F.create_map(*[c for name in ("model", *_MODES) for c in (F.lit(name), F.col(name))]))
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    apart = combined.repartition(parts, *SESSION).select("*", fields.alias("field", "name"))
    # Every combination has one row per field; its sums count in the one of the model.
    is_model = F.col("field") == "model"
    counted = apart.groupBy(*SESSION, "field", "name").agg(
        F.sum("n").alias("n"), F.min("started").alias("started"), F.max("ended").alias("ended"),
        *[F.sum(F.when(is_model, F.col(m))).alias(m) for m in _MEASURES],
    )
    common = W.partitionBy(*SESSION, "field").orderBy(F.col("name").isNull(), F.desc("n"), "name")
    ranked = counted.withColumn("place", F.row_number().over(common))
    return ranked.groupBy(*SESSION).agg(
        F.min("started").alias("started"),
        F.max("ended").alias("ended"),
        F.sum(F.when(is_model, F.col("n"))).alias("requests"),
        *[F.sum(m).alias(m) for m in _MEASURES],
        F.array_sort(F.collect_list(F.when(is_model, F.col("name")))).alias("models"),
        *[F.max(F.when((F.col("field") == c) & (F.col("place") == 1), F.col("name"))).alias(c) for c in _MODES],
    )


def sessions(
    requests: DataFrame,
    meta: DataFrame,
    devices: DataFrame,
    session_events: DataFrame,
    errors: DataFrame,
    start,
    end,
    search: str | None = None,
    **filters: str | None,
) -> DataFrame:
    """Session list with title, machine name, compactions and errors.

    Requests collapse to sessions first; every side table is aggregated to session grain before it joins, so
    nothing fans out and all joins share one partitioning.
    """
    base = filtered(requests, start, end, **filters)
    if search:
        base = search_requests(base, meta, search)
    compactions = session_events.filter(F.col("event") == "compaction").groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("compactions")
    )
    failed = errors.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("errors"))
    names = devices.select(F.col("id").alias("device_id"), F.col("name").alias("device_name"))
    titled = meta.select(*SESSION, F.coalesce("title", "agent_name").alias("title"))
    return (
        session_rollup(base)
        .join(titled, SESSION, "left")
        .join(compactions, SESSION, "left")
        .join(failed, SESSION, "left")
        .join(names, "device_id", "left")
        .withColumn("compactions", F.coalesce("compactions", F.lit(0)))
        .withColumn("errors", F.coalesce("errors", F.lit(0)))
    )


def top_sessions(session_list: DataFrame, sort: str = "value", limit: int = 200) -> DataFrame:
    """First ``limit`` sessions per workspace by value, recency or request count."""
    column = {"recent": "ended", "requests": "requests"}.get(sort, "value")
    return top_n(session_list, [F.desc(column), F.asc("session_id")], limit)


def session_stats(requests: DataFrame, start, end) -> DataFrame:
    """Median and 95th percentile of value per session, and the number of sessions."""
    per_session = filtered(requests, start, end).groupBy(*SESSION).agg(F.sum("value_usd").alias("value"))
    return exact_quantiles(per_session, [WS], "value", {"median": 0.5, "p95": 0.95})


def context_growth(requests: DataFrame) -> DataFrame:
    """Ordinals within the session and prompt size of every request.

    ``main_ordinal`` counts main-thread requests and is null on sub-agent rows.
    """
    main = ~F.col("is_subagent")
    numbered = running_totals(
        requests, SESSION, "ts", ["request_id"],
        {"ordinal": F.lit(1), "main_ordinal": F.when(main, 1).otherwise(0)},
    )
    return numbered.select(
        *SESSION, "request_id", "ts", "model", "value_usd", "is_subagent", "ordinal",
        F.when(main, F.col("main_ordinal")).alias("main_ordinal"),
        prompt_tokens().alias("context"),
    )


def compaction_positions(requests: DataFrame, session_events: DataFrame) -> DataFrame:
    """For each compaction, the main-thread ordinal of the first request at or after it.

    A forward as-of join written as one ordered scan: compactions sort before requests of the same instant,
    and the number of requests seen so far is the position. Compactions after the last request drop out.
    """
    main = requests.filter(~F.col("is_subagent")).select(
        *SESSION, "ts", F.lit(1).alias("is_request"), F.lit("").alias("id")
    )
    marks = session_events.filter(F.col("event") == "compaction").select(
        *SESSION, "ts", F.lit(0).alias("is_request"), "id"
    )
    placed = running_totals(
        main.unionByName(marks), SESSION, "ts", ["is_request", "id"], {"seen": F.col("is_request")}
    )
    size = main.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("_main"))
    return (
        placed.filter(F.col("is_request") == 0)
        .join(size, SESSION)
        .filter(F.col("seen") < F.col("_main"))
        .select(*SESSION, "id", "ts", (F.col("seen") + 1).alias("position"))
    )


def costliest_requests(requests: DataFrame, limit: int = 400) -> DataFrame:
    """The most expensive ``limit`` requests of each session."""
    return top_n(requests, [F.desc("value_usd"), F.asc("ts"), F.asc("request_id")], limit, tuple(SESSION))


def session_machines(requests: DataFrame, devices: DataFrame) -> DataFrame:
    """Requests per machine name within a session; machines that are gone count as unknown."""
    n = requests.groupBy(*SESSION, "device_id").agg(F.count(F.lit(1)).alias("n"))
    names = devices.select(F.col("id").alias("device_id"), F.col("name"))
    return (
        n.join(names, "device_id", "left")
        .groupBy(*SESSION, F.coalesce("name", F.lit("Unknown machine")).alias("machine"))
        .agg(F.sum("n").alias("requests"))
    )


def session_detail(requests: DataFrame, session_events: DataFrame, errors: DataFrame) -> DataFrame:
    """Headline numbers of the session page: span, cache hit rate, sub-agent share, compactions, errors."""
    prompt = F.col("input") + F.col("cache_read") + F.col("cache_write_5m") + F.col("cache_write_1h")
    sums = ("input", "output", "cache_read", "cache_write_5m", "cache_write_1h")
    core = requests.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("is_subagent").alias("subagent_requests"),
        F.sum("value_usd").alias("value"),
        value_of(F.col("is_subagent")).alias("subagent_value"),
        *[F.sum(c).alias(c) for c in sums],
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1000).alias("span_ms"),
    )
    marks = session_events.filter(F.col("event") == "compaction").groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("compactions")
    )
    failed = errors.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("errors"))
    return (
        core.join(marks, SESSION, "left")
        .join(failed, SESSION, "left")
        .fillna(0, subset=["compactions", "errors"])
        .withColumn("cache_hit_rate", F.when(prompt != 0, F.col("cache_read") / prompt))
    )


def session_value_parts(requests: DataFrame, book=PRICE_BOOK) -> DataFrame:
    """Where a session's value went: one row per model and one per sub-agent type."""
    part = F.explode(
        F.array(
            F.struct(F.lit("model").alias("part"), F.col("model").alias("name")),
            F.when(
                F.col("is_subagent"),
                F.struct(F.lit("agent").alias("part"), F.coalesce("agent_type", F.lit("subagent")).alias("name")),
            ),
        )
    )
    rows = requests.select(*SESSION, "value_usd", part.alias("p")).filter(F.col("p").isNotNull())
    sums = rows.groupBy(*SESSION, "p.part", "p.name").agg(F.sum("value_usd").alias("value"))
    named = with_prices(sums, book, "name")
    label = F.when(F.col("part") == "model", model_label("name")).otherwise(F.col("name"))
    return named.select(*SESSION, "part", "name", label.alias("part_label"), "value")


def snapshot_difference(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """A session's own accounting beside the value computed from its requests."""
    computed = requests.groupBy(*SESSION).agg(F.sum("value_usd").alias("computed_usd"))
    own = snapshots.filter(F.col("total_cost_usd") > 0).select(
        *SESSION, "total_cost_usd", "lines_added", "lines_removed", "api_ms", "tool_ms"
    )
    return computed.join(own, SESSION, "left").withColumn(
        "difference_usd", F.col("computed_usd") - F.col("total_cost_usd")
    )


def request_list(requests: DataFrame) -> DataFrame:
    """Requests with their position in the session (by ts, then id)."""
    return running_totals(requests, SESSION, "ts", ["request_id"], {"position": F.lit(1)})
