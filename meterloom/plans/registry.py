"""Registration of queries with their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pricing import PRICE_BOOK, US_GEO_MULTIPLIER, WEB_SEARCH_USD
from .adapters import VIEWS, Tables, duckdb_view

Build = Callable[[Tables], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}
_DIGITS: dict[str, int] = {}

# Shared oracle building blocks beyond the adapter views.
_CTES: dict[str, str] = {}
DIGITS = 7


def query(name: str, oracle: str | None = None, digits: int = DIGITS) -> Callable[[Build], Build]:
    """Register a query. ``digits`` must be fine enough that exact values never end on a rounding tie."""

    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = build
        _DIGITS[name] = digits
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def cte(name: str, sql: str) -> None:
    _CTES[name] = sql


def present(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Result shape shared with the oracle: naive timestamps, rounded doubles."""
    out = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        column = F.col(f"`{field.name}`")
        if kind == "timestamp":
            column = column.cast("timestamp_ntz")
        elif kind == "double":
            column = F.round(column, digits)
        out.append(column.alias(field.name))
    return df.select(*out)


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    build = QUERIES[name]
    return lambda spark, folder: present(build(Tables(spark, folder)), _DIGITS[name])


def _definition(name: str) -> str | None:
    return duckdb_view(name) if name in VIEWS else _CTES.get(name)


def _number(x: float | None) -> str:
    return "null" if x is None else repr(float(x))


def _book_sql() -> str:
    rows = []
    for p in PRICE_BOOK:
        cells = [*p.rates, p.fast_multiplier, p.long_threshold, *(p.long_rates or (None,) * 5)]
        rows.append(f"('{p.key}', '{p.label}', '{p.family}', " + ", ".join(_number(c) for c in cells) + ")")
    names = "pk, label, family, ri, rw5, rw1, rr, ro, fastm, thr, li, lw5, lw1, lr, lo"
    types = ", ".join(f"cast({c} as double) as {c}" for c in names.split(", ")[3:])
    return f"select pk, label, family, {types} from (values {', '.join(rows)}) as b({names})"


def key_sql(model: str) -> str:
    """Book key of a model id in DuckDB."""
    bare = f"regexp_replace(lower({model}), '^anthropic\\.', '')"
    bare = f"regexp_replace(regexp_replace({bare}, '\\[.*\\]$', ''), '@.*$', '')"
    return f"regexp_extract({bare}, '^(.*?)(-\\d{{8}}|-v\\d.*|-latest)?$', 1)"


def value_sql(q: str = "q", web: str | None = None, speed: str | None = None, geo: str | None = None) -> str:
    """Value of a row ``q`` joined to the book ``b`` in DuckDB."""
    web = f"{q}.web_search" if web is None else web
    speed = f"{q}.speed" if speed is None else speed
    geo = f"{q}.inference_geo" if geo is None else geo
    long = f"({q}.input + {q}.cache_read + {q}.cache_write_5m + {q}.cache_write_1h > b.thr)"
    pick = {n: f"(case when {long} then b.l{n} else b.r{n} end)" for n in ("i", "o", "r", "w5", "w1")}
    tokens = (
        f"{q}.input * {pick['i']} + {q}.output * {pick['o']} + {q}.cache_read * {pick['r']} + "
        f"{q}.cache_write_5m * {pick['w5']} + {q}.cache_write_1h * {pick['w1']}"
    )
    fast = f"(case when {speed} = 'fast' then coalesce(b.fastm, 1) else 1 end)"
    us = f"(case when {geo} = 'us' then cast({US_GEO_MULTIPLIER} as double) else 1 end)"
    return f"(({tokens}) * {fast} * {us} / 1e6 + {web} * cast({WEB_SEARCH_USD} as double))"


cte("book", _book_sql())
cte(
    "requests",
    f"""select q.* exclude (sources_csv), string_split(q.sources_csv, ',') as sources,
  b.pk is not null as priced, coalesce({value_sql()}, 0) as value_usd,
  coalesce(b.family, 'other') as family, coalesce(b.label, q.model) as label, b.ri, b.rr
from raw_requests q left join book b on {key_sql('q.model')} = b.pk""",
)
cte(
    "local_requests",
    """select q.*, w.timezone, w.billing_day, w.plan_price_usd,
  timezone(w.timezone, timezone('UTC', q.ts)) as local
from requests q join workspaces w on w.id = q.workspace_id""",
)


def oracle_text(sql: str) -> str:
    """Prefix a query with the common table expressions it uses, in dependency order."""
    names = [*VIEWS, *_CTES]
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in names:
            if name not in ordered and re.search(rf"\b(from|join|in)\s+\(?\s*{name}\b", text):
                need(_definition(name))
                if name not in ordered:
                    ordered.append(name)

    need(sql)
    sql = sql.strip()
    if not ordered:
        return sql
    parts = ",\n".join(f"{n} as (\n{_definition(n)}\n)" for n in ordered)
    recursive = "recursive " if "recursive" in sql[:20] else ""
    if sql.lower().startswith("with "):
        body = re.sub(r"^with (recursive )?", "", sql, flags=re.I)
        return f"with {recursive}{parts},\n{body}"
    return f"with {recursive}{parts}\n{sql}"
