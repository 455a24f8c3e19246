"""Feeds that are served page by page, as a Spark data source in Python, in batches and as a stream.

A feed has units (accounts, lists, calendars); each is a partition, whose pages are asked for one after another inside a task. What talks to
the service is a transport that the caller names: an object with

    units(feed) -> list of unit names
    page(feed, unit, token, since) -> {"items": [{"id", "updated", ...}], "next": token of the next page or None}
    head(feed, unit) -> token of a change log's end;  changes(feed, unit, token, until) -> {"items", "next": token reached}

A row is (unit, id, updated, deleted, payload): payload is the item as JSON, for ``from_json`` with a declared schema. Filters on
``unit`` go to the list of partitions, and lower bounds of ``updated`` to the requests (``since``; Spark still checks them). A page that
fails is asked for again, ``retries`` times with doubled pauses; then the task fails and Spark runs it again from its first page.

As a stream, the offset of a micro-batch is one change-log token per unit, so a batch that is run again asks for the same changes.
A transport must be importable on executors (``module:callable``); options other than ours are given to the callable.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

SCHEMA = "unit string, id string, updated long, deleted boolean, payload string"
OWN = ("transport", "feed", "retries", "pause", "path")


@dataclass
class Unit(InputPartition):
    """What one task asks for: a unit's pages, or its changes from one token up to another."""

    unit: str
    start: str | None = None
    until: str | None = None


def connect(options: dict[str, str]):
    module, name = options["transport"].split(":")
    return getattr(importlib.import_module(module), name)({k: v for k, v in options.items() if k not in OWN})


def asked(options: dict[str, str], ask: Callable[[], dict]) -> dict:
    """ask(), again after a failure, as often as the options allow."""
    retries, pause = int(options.get("retries", 3)), float(options.get("pause", 0.5))
    for attempt in range(retries + 1):
        try:
            return ask()
        except Exception:
            if attempt == retries:
                raise
            time.sleep(pause * 2**attempt)
    raise AssertionError


def as_row(unit: str, item: dict) -> tuple:
    return unit, item.get("id"), item.get("updated"), bool(item.get("deleted", False)), json.dumps(item, ensure_ascii=False, sort_keys=True)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.only, self.since = options, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("unit",) and isinstance(f, (EqualTo, In)):
                asked_for = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = asked_for if self.only is None else self.only & asked_for
            else:
                if column == ("updated",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.since = max(f.value, self.since or f.value)
                yield f

    def partitions(self) -> list[Unit]:
        units = connect(self.options).units(self.options["feed"])
        return [Unit(u) for u in sorted(units) if self.only is None or u in self.only]

    def read(self, partition: Unit | None) -> Iterator[tuple]:
        if partition is None:  # a feed without units is one empty partition to Spark
            return
        transport, token = connect(self.options), None
        while True:
            page = asked(self.options, lambda: transport.page(self.options["feed"], partition.unit, token, self.since))
            yield from (as_row(partition.unit, item) for item in page["items"])
            token = page.get("next")
            if token is None:
                return


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        transport, feed = connect(self.options), self.options["feed"]
        return {u: asked(self.options, lambda u=u: {"head": transport.head(feed, u)})["head"] for u in sorted(transport.units(feed))}

    def partitions(self, start: dict, end: dict) -> list[Unit]:
        return [Unit(u, start.get(u), until) for u, until in sorted(end.items()) if start.get(u) != until]

    def read(self, partition: Unit) -> Iterator[tuple]:
        transport, token = connect(self.options), partition.start
        while token != partition.until:
            got = asked(self.options, lambda: transport.changes(self.options["feed"], partition.unit, token, partition.until))
            yield from (as_row(partition.unit, item) for item in got["items"])
            if got["next"] == token:
                raise ValueError(f"the change log of {partition.unit} doesn't go on after {token}")
            token = got["next"]

    def commit(self, end: dict) -> None:
        pass


class PagedFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(dict(self.options))


def read(spark: SparkSession, transport: str, feed: str, streaming: bool = False, **options: str) -> DataFrame:
    """(unit, id, updated, deleted, payload) of a feed: all its pages, or its changes as a stream."""
    spark.dataSource.register(PagedFeed)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.readStream if streaming else spark.read
    return reader.format("paged").options(transport=transport, feed=feed, **options).load()
