"""Plug-ins for models behind HTTP: an embedder and a generator.  Requests are made by the Python workers."""

from __future__ import annotations

import json
import urllib.request

import numpy as np


class ModelUnavailableError(RuntimeError):
    """A model that can't be reached, or whose reply makes no sense."""


def _post(url: str, body: dict, timeout: float, headers: dict[str, str]) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            found = json.load(reply)
    except (OSError, ValueError) as e:
        raise ModelUnavailableError(f"{url}: {e}") from e
    if not isinstance(found, dict):
        raise ModelUnavailableError(f"{url}: the reply is no object")
    return found


class HttpEmbedder:
    """POSTs ``{"model", "input": [texts]}``; expects ``{"data": [{"index", "embedding"}]}``, in any order."""

    query_prefix = ""

    def __init__(self, url: str, name: str, dimension: int, timeout: float = 60.0, headers: dict[str, str] | None = None):
        self.url, self.name, self.dimension, self.timeout, self.headers = url, name, dimension, timeout, headers or {}

    def embed(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.dimension))
        rows = _post(self.url, {"model": self.name, "input": texts}, self.timeout, self.headers).get("data")
        try:
            by = {int(r["index"]): r["embedding"] for r in rows}
            out = np.array([by[i] for i in range(len(texts))], float)
        except (TypeError, KeyError, ValueError) as e:
            raise ModelUnavailableError(f"{self.url}: not one vector for each text") from e
        if len(by) != len(texts) or out.shape != (len(texts), self.dimension):
            raise ModelUnavailableError(f"{self.url}: {len(by)} vectors of shape {out.shape[1:]} for {len(texts)} texts of width {self.dimension}")
        return out


class HttpGenerator:
    """POSTs ``{"model", "prompt", "stream": false}``; expects ``{"response": text}``.  A prompt that fails gives None."""

    def __init__(self, url: str, name: str, timeout: float = 120.0, headers: dict[str, str] | None = None):
        self.url, self.name, self.timeout, self.headers = url, name, timeout, headers or {}

    def one(self, prompt: str) -> str:
        text = _post(self.url, {"model": self.name, "prompt": prompt, "stream": False}, self.timeout, self.headers).get("response")
        if not isinstance(text, str):
            raise ModelUnavailableError(f"{self.url}: no response text")
        return text

    def complete(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            try:
                out.append(self.one(p))
            except ModelUnavailableError:
                out.append(None)
        return out

    def health(self) -> bool:
        """Whether it answers at all; never raises."""
        return self.complete(["ping"])[0] is not None
