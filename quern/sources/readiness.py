"""Whether a question can be asked: the index is built, the model server answers, and it has the model."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import SparkSession

from quern.config import SETTINGS
from quern.operators.answering import is_installed
from quern.sources import index

TIMEOUT = 3.0
#: What an error class of ``answering.error_class`` asks for.
ADVICE = {
    "index_missing": "The index is not built yet: run the build command first.",
    "server_down": "The model server does not answer: start it and try again.",
    "model_missing": "The model server lacks the model: pull it and try again.",
}
Get = Callable[[str, float], bytes]


def _get(url: str, timeout: float) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as r:
        return r.read()


def installed(payload: object) -> list[str]:
    """Names of models in a server's tags answer; what is not of that form names none."""
    models = payload.get("models") if isinstance(payload, dict) else None
    parts = [m.get(key) for m in models or [] if isinstance(m, dict) for key in ("name", "model")]
    return [p.strip() for p in parts if isinstance(p, str) and p.strip()]


def probe(url: str = SETTINGS.ollama_base_url, model: str = SETTINGS.ollama_model, get: Get = _get) -> str | None:
    """The error class that stands in the way of the model, or null. An empty answer is one without models."""
    try:
        raw = get(f"{url.rstrip('/')}/api/tags", TIMEOUT)
        payload = json.loads(raw) if raw else {}
    except (OSError, ValueError):
        return "server_down"
    if not isinstance(payload, dict):
        return "server_down"
    return None if is_installed(installed(payload), model) else "model_missing"


def errors(spark: SparkSession, path: str, url: str = SETTINGS.ollama_base_url, model: str = SETTINGS.ollama_model, get: Get = _get) -> list[str]:
    """Error classes, the index's first; none if a question can be asked."""
    found = [] if index.exists(spark, path) else ["index_missing"]
    return found + [e for e in (probe(url, model, get),) if e]
