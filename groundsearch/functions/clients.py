"""HTTP clients of model servers and archives.  Everything above them takes them as functions, so tests pass in fakes."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

from groundsearch.config import Config
from groundsearch.functions import vectors
from groundsearch.functions.vectors import retried

#: Sends a JSON body and returns the response, parsed.
Post = Callable[[dict], dict]
#: Returns the bytes at a URL.
Fetch = Callable[[str], bytes]
#: Sends a JSON body and returns all bytes of a streamed response as text.
PostStream = Callable[[dict], str]
MAX_ERROR = 200


class ModelError(RuntimeError):
    """A model server's refusal, with the head of what it said."""


def _send(url: str, key: str, body: dict, timeout: float) -> bytes:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return response.read()
    except urllib.error.HTTPError as e:
        raise ModelError(f"{e.code}: {e.read().decode('utf-8', 'replace')[:MAX_ERROR]}") from None


def http_post(url: str, key: str = "", timeout: float = 60.0) -> Post:
    return lambda body: json.loads(_send(url, key, body, timeout))


def http_post_stream(url: str, key: str = "", timeout: float = 300.0) -> PostStream:
    return lambda body: _send(url, key, body, timeout).decode("utf-8", "replace")


def http_fetch(timeout: float = 60.0) -> Fetch:
    def fetch(url: str) -> bytes:
        with urllib.request.urlopen(url, timeout=timeout) as response:
            return response.read()

    return fetch


def chat_body(config: Config, messages: list[dict], stream: bool = False) -> dict:
    body = {"model": config.llm_model, "messages": messages, "temperature": config.llm_temperature, "max_tokens": config.llm_max_tokens}
    return body | {"stream": True} if stream else body


def chat_generator(config: Config, post: Post | None = None):
    """A generator for grounding.generate(): one completion for each message list, from any server with this chat API."""
    send = post or http_post(f"{config.llm_base_url}/chat/completions", config.llm_api_key)

    def make():
        def run(batch: list[list[dict]]) -> list[str]:
            out = []
            for messages in batch:
                response = retried(lambda: send(chat_body(config, messages)))  # noqa: B023  called at once
                choices = response.get("choices") or []
                if not choices:
                    raise ModelError(f"no completion: {json.dumps(response)[:MAX_ERROR]}")
                out.append((choices[0].get("message") or {}).get("content") or "")
            return out

        return run

    return make


def stream_generator(config: Config, post: PostStream | None = None):
    """The same for streamed completions: each answer is the raw event stream, for events.decode_model()."""
    send = post or http_post_stream(f"{config.llm_base_url}/chat/completions", config.llm_api_key)
    return lambda: lambda batch: [retried(lambda: send(chat_body(config, messages, True))) for messages in batch]  # noqa: B023


def embedding_provider(config: Config, local: vectors.Provider = vectors.hash_provider, post: Post | None = None) -> vectors.Provider:
    """The provider that the configuration names: `local`, or `api` (also `openai`) for an embeddings API."""
    name = config.embedding_provider
    if name == "local":
        return local
    if name in ("api", "openai"):
        return vectors.api_provider(post or http_post(f"{config.llm_base_url}/embeddings", config.llm_api_key), config.embedding_api_model, config.embedding_dims)
    raise ValueError(f"unknown embedding provider {name}")
