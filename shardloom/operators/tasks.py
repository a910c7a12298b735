"""Tasks routed to the owner of their key's partition."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.errors import AlreadyExists, InvalidArgument
from shardloom.functions.placement import partition_of

Handler = Callable[[str, dict], "dict | None"]
_OUT = "routing_key string, owner string, status string, response string, error string"


def invoke(handler: Handler, key: str, message: str | None) -> tuple[str, str | None, str | None]:
    """status, response, error: exceptions fail the task alone; None is an empty response."""
    try:
        return "completed", json.dumps(handler(key, json.loads(message) if message else {}) or {}, sort_keys=True), None
    except Exception as e:  # noqa: BLE001 - a handler may raise anything
        return "failed", None, str(e)


def route(tasks: DataFrame, assignment: DataFrame, handler: Handler) -> DataFrame:
    """routing_key, owner, status, response, error of each task (routing_key, message as JSON).

    A task without an owner fails. Tasks run where their rows are, batch by batch; ownership is a join with the partition table
    (one row a partition), so that a hot key doesn't gather in one task.
    """
    table = assignment.select(F.col("partition_id").alias("_p"), "owner")
    owned = tasks.select("routing_key", "message", partition_of(F.col("routing_key")).alias("_k")).join(F.broadcast(table), F.col("_k") == F.col("_p"), "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(k, o, *(invoke(handler, k, m) if o is not None else ("failed", None, "no owner"))) for k, m, o in zip(rows["routing_key"], rows["message"], rows["owner"])]
            yield pd.DataFrame(out, columns=["routing_key", "owner", "status", "response", "error"])

    return owned.select("routing_key", "message", "owner").mapInPandas(run, _OUT)


def to_all(assignment: DataFrame, message: str, handler: Handler) -> DataFrame:
    """The message once for each distinct owner, with an empty routing key."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([("", o, *invoke(handler, "", message)) for o in rows["owner"]], columns=["routing_key", "owner", "status", "response", "error"])

    return assignment.select("owner").where("owner IS NOT NULL").distinct().mapInPandas(run, _OUT)


class Topics:
    """Handlers by topic. A topic has one handler; a second one for it, unless it replaces, is an error."""

    def __init__(self) -> None:
        self._handlers: dict[str, Handler] = {}

    def listen(self, topic: str, handler: Handler, replace: bool = False) -> None:
        if not topic:
            raise InvalidArgument("a topic has a name")
        if topic in self._handlers and not replace:
            raise AlreadyExists(f"topic {topic} has a handler")
        self._handlers[topic] = handler

    def unlisten(self, topic: str) -> bool:
        return self._handlers.pop(topic, None) is not None

    def route(self, tasks: DataFrame, assignment: DataFrame) -> DataFrame:
        """route() of tasks that name their topic (topic, routing_key, message); those of unknown topics fail."""
        handlers = dict(self._handlers)

        def dispatch(key: str, envelope: dict) -> dict | None:
            handler = handlers.get(envelope.get("topic"))
            if handler is None:
                raise LookupError(f"no handler for topic {envelope.get('topic')}")
            return handler(key, json.loads(envelope["message"]) if envelope.get("message") else {})

        packed = tasks.select("routing_key", F.to_json(F.struct("topic", "message")).alias("message"))
        return route(packed, assignment, dispatch)
