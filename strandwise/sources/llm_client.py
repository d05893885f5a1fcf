"""Chat models behind one interface, and their use over tables.

A client is a callable ``(messages, **options) -> text``.  ``make_client`` runs on the workers, so connections and
credentials stay there; credentials come from the environment.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.operators.prompts import messages

Client = Callable[..., str]


def http_client(base_url: str | None = None, model: str | None = None, timeout: float = 30.0) -> Client:
    """A client of an OpenAI-compatible endpoint; LLM_BASE_URL, LLM_MODEL and LLM_API_KEY fill what is missing."""
    import urllib.request

    url = (base_url or os.environ["LLM_BASE_URL"]).rstrip("/") + "/chat/completions"
    name, key = model or os.environ["LLM_MODEL"], os.environ.get("LLM_API_KEY", "")

    def chat(msgs: list[dict[str, str]], **options) -> str:
        body = json.dumps({"model": name, "messages": msgs, **options}).encode()
        asked = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(asked, timeout=timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"] or ""

    return chat


def recorded_client(responses: dict[str, str], default: str = "") -> Client:
    """Answers by the user message; for tests and replays."""
    return lambda msgs, **options: responses.get(msgs[-1]["content"], default)


def ask_json(client: Client, prompt: str, **options) -> dict:
    """The JSON object a client answers with, {} if it fails to."""
    try:
        got = json.loads(client(messages("Answer with one JSON object.", prompt), **options))
        return got if isinstance(got, dict) else {}
    except Exception:
        return {}


def ask(rows: DataFrame, make_client: Callable[[], Client], system: str, prompt: str = "prompt", into: str = "response", tries: int = 3, pause: float = 2.0, **options) -> DataFrame:
    """``rows`` with the model's answer to the ``prompt`` column; null after ``tries`` failures."""

    @F.pandas_udf("string")
    def answer(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make_client()
        for part in parts:
            out = []
            for text in part.fillna(""):
                for attempt in range(tries):
                    try:
                        out.append(client(messages(system, text), **options))
                        break
                    except Exception:
                        if attempt + 1 == tries:
                            out.append(None)
                        else:
                            time.sleep(pause)
            yield pd.Series(out, dtype="object")

    return rows.withColumn(into, answer.asNondeterministic()(F.col(prompt)))
