"""Model steps as batched maps: a client per partition, a bounded number of calls at once, an error stays in its row."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class RoleSettings:
    """How one role calls its model.  Effort is held within 0 to 3, output within 0 to 2."""

    model: str
    instructions: str = ""
    endpoint: str = ""
    temperature: float = 0.0
    effort: int = 0
    output: int = 0
    timeout_s: float = 600.0

    def __post_init__(self) -> None:
        object.__setattr__(self, "effort", min(max(self.effort, 0), 3))
        object.__setattr__(self, "output", min(max(self.output, 0), 2))


def role_settings(settings: dict) -> dict[str, RoleSettings]:
    """Settings of every role of a settings file, by name."""
    return {name: RoleSettings(**values) for name, values in settings.get("roles", {}).items()}


class ModelClient(Protocol):
    def complete(self, role: str, prompt: str, schema: str | None = None) -> str:
        """The reply to a prompt; with a schema (of JSON) the reply is a JSON text of that shape."""


class StubClient:
    """Deterministic replies without a network.

    The assistant and the executor answer with a digest of their prompt, the planner groups the changes of the fenced JSON
    in its prompt by file extension, in order.
    """

    def complete(self, role: str, prompt: str, schema: str | None = None) -> str:
        if schema is not None:
            groups: dict[str, list[str]] = {}
            for change in json.loads(prompt.partition("```json\n")[2].rpartition("```")[0])["changes"]:
                path = change["path"]
                groups.setdefault(path.rpartition(".")[2] if "." in path else "", []).append(path)
            return json.dumps({"assigns": [{"reviewer_number": n, "paths": groups[k]} for n, k in enumerate(sorted(groups), 1)]})
        return f"{'summary' if role == 'assistant' else 'review'} {hashlib.md5(prompt.encode('utf-8')).hexdigest()}"


def complete_rows(
    df: DataFrame, keys: tuple[str, ...], role: str, prompt: str, out: str, client: Callable[[], ModelClient] = StubClient, failed: str | None = "", schema: str | None = None, parallel: int = 8
) -> DataFrame:
    """(keys, out): the reply to each prompt.  A null prompt, or one whose call fails, gets ``failed``.

    Only keys and prompt go to Python, and prompts don't come back.  ``parallel`` bounds the calls a task makes at once.
    Paid, changing replies must be written down before they are read twice: checkpoint the result or write it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()

        def reply(text: str | None) -> str | None:
            try:
                return failed if text is None else model.complete(role, text, schema)
            except Exception:  # noqa: BLE001  one row's failure is that row's result
                return failed

        with ThreadPoolExecutor(parallel) as pool:
            for batch in batches:
                done = batch[list(keys)].copy()
                done[out] = pd.Series(list(pool.map(reply, batch[prompt])), index=batch.index, dtype=object)
                yield done

    rows = df.select(*keys, prompt)
    return rows.mapInPandas(run, T.StructType([*(rows.schema[k] for k in keys), T.StructField(out, T.StringType())]))
