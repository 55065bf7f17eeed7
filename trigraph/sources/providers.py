"""Where embeddings come from: named callables from a list of texts to (text, vector) pairs."""

from __future__ import annotations

import hashlib
import json
import math
import re
import urllib.request
from collections.abc import Callable, Iterable, Iterator

Pairs = list[tuple[str, list[float]]]
REQUEST_TEXTS, TIMEOUT_S = 100, 30


def chunked(items: Iterable, size: int) -> Iterator[list]:
    part = []
    for x in items:
        part.append(x)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def hashing(texts: list[str], dimensions: int = 64) -> Pairs:
    """Signed hashes of words and letter trigrams, unit length: offline and the same everywhere."""
    out = []
    for text in texts:
        vec = [0.0] * dimensions
        low = f" {text.lower()} "
        for part in [*re.findall(r"\w+", low), *(low[i : i + 3] for i in range(len(low) - 2))]:
            h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "big")
            vec[(h >> 1) % dimensions] += 1.0 if h & 1 else -1.0
        norm = math.sqrt(sum(x * x for x in vec)) or 1.0
        out.append((text, [x / norm for x in vec]))
    return out


def _post(url: str, body: dict, headers: dict | None = None) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    with urllib.request.urlopen(request, timeout=TIMEOUT_S) as reply:
        return json.loads(reply.read())


def custom(texts: list[str], url: str | None = None, headers: dict | None = None) -> Pairs:
    """Posts ``{"texts": [...]}`` to ``url``, which answers ``{"embeddings": [{"text", "vector"}, ...]}``, or bare vectors in order."""
    if not url:
        raise ValueError("a custom provider needs url")
    out: Pairs = []
    for part in chunked(texts, REQUEST_TEXTS):
        got = _post(url, {"texts": part}, headers)["embeddings"]
        out.extend((e["text"], e["vector"]) if isinstance(e, dict) else (t, e) for t, e in zip(part, got, strict=True))
    return out


def openai(texts: list[str], api_key: str | None = None, model: str = "text-embedding-3-small", url: str = "https://api.openai.com/v1/embeddings") -> Pairs:
    if not api_key:
        raise ValueError("this provider needs api_key")
    out: Pairs = []
    for part in chunked(texts, REQUEST_TEXTS):
        data = _post(url, {"input": part, "model": model}, {"Authorization": f"Bearer {api_key}"})["data"]
        out.extend((t, d["embedding"]) for t, d in zip(part, sorted(data, key=lambda d: d["index"])))
    return out


PROVIDERS: dict[str, Callable[..., Pairs]] = {"hashing": hashing, "custom": custom, "openai": openai}


def register(name: str, provider: Callable[..., Pairs]) -> None:
    PROVIDERS[name] = provider
