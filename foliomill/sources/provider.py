"""Vision-model providers: protocol, deterministic mock, retries, and how a provider is chosen."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from queue import Empty, Queue
from threading import Thread
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from ..batches import arrow_schema, in_batches, rows_of
from ..config import ConversionConfig
from ..errors import ConversionError
from ..functions.scalars import CONTINUITY, DEFAULT_MODEL, DEFAULT_MODELS, SYSTEM_PROMPT
from ..schema import RAW_PAGE


@dataclass(frozen=True)
class Response:
    content: str
    input_tokens: int
    output_tokens: int


class Provider(Protocol):
    def complete(self, messages: list[dict], options: dict) -> Response:
        """One completion; raises on failure."""


@dataclass(frozen=True)
class MockProvider:
    """Echoes the decoded image; fails the first ``failures`` attempts of pages whose digest is below ``share``."""

    share: float = 0.0
    failures: int = 99

    def complete(self, messages: list[dict], options: dict) -> Response:
        data = base64.b64decode(messages[-1]["images"][0]["data"])
        unlucky = hashlib.md5(data).digest()[0] < 256 * self.share
        if unlucky and options["attempt"] < self.failures:
            raise RuntimeError("mock failure")
        prior = sum(len(m["content"].encode()) for m in messages[1:-1])
        return Response(data.decode("utf-8", "replace"), 1000 + prior // 4, -(-len(data) // 4))


@dataclass(frozen=True)
class HttpProvider:
    """A chat-completions endpoint as many services and local servers offer it."""

    base_url: str
    model: str
    api_key: str | None = None

    def complete(self, messages: list[dict], options: dict) -> Response:
        body = {"model": self.model, "temperature": options["temperature"], "max_tokens": options["max_tokens"], "messages": [self._turn(m) for m in messages]}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=options.get("timeout")) as response:
                answer = json.load(response)
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"HTTP {e.code}: {e.read(500).decode('utf-8', 'replace')}") from e
        except urllib.error.URLError as e:
            if isinstance(e.reason, TimeoutError):
                raise e.reason from e
            raise
        usage = answer.get("usage") or {}
        return Response(answer["choices"][0]["message"]["content"] or "", usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0))

    @staticmethod
    def _turn(message: dict) -> dict:
        if not message["images"]:
            return {"role": message["role"], "content": message["content"]}
        parts = [{"type": "text", "text": message["content"]}] if message["content"] else []
        parts += [{"type": "image_url", "image_url": {"url": f"data:{i['mime_type']};base64,{i['data']}", "detail": i["detail"]}} for i in message["images"]]
        return {"role": message["role"], "content": parts}


@dataclass(frozen=True)
class Timed:
    """Gives up waiting for another provider's answer after some seconds; for providers without a timeout of their own."""

    provider: Provider
    secs: float

    def complete(self, messages: list[dict], options: dict) -> Response:
        got: Queue = Queue()

        def call() -> None:
            try:
                got.put((self.provider.complete(messages, options), None))
            except Exception as e:
                got.put((None, e))

        Thread(target=call, daemon=True).start()
        try:
            answer, error = got.get(timeout=self.secs)
        except Empty:
            raise TimeoutError from None
        if error:
            raise error
        return answer


#: Where named providers answer, and the variable with the key.
ENDPOINTS = {
    "openai": ("https://api.openai.com/v1", "OPENAI_API_KEY"), "mistral": ("https://api.mistral.ai/v1", "MISTRAL_API_KEY"),
    "ollama": ("http://localhost:11434/v1", None), "lmstudio": ("http://localhost:1234/v1", None),
}


def messages(image_b64: str, prior: str | None, config: ConversionConfig) -> list[dict]:
    out = [{"role": "system", "content": config.system_prompt or SYSTEM_PROMPT, "images": []}]
    if config.maintain_format and prior:
        out.append({"role": "system", "content": f'{CONTINUITY}"""{prior}"""', "images": []})
    return [*out, {"role": "user", "content": "", "images": [{"data": image_b64, "mime_type": "image/png", "detail": "high"}]}]


def infer_page(provider: Provider, page: dict, prior: str | None, config: ConversionConfig, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One page result; every error is retried with doubling waits, and none is raised.

    If the last attempt timed out, the page's error is a timeout.
    """
    number, began, last = int(page["page_index"]) + 1, time.monotonic(), None
    spent = lambda: int(1000 * (time.monotonic() - began))
    now = int(1000 * time.time())
    base = {"doc_id": page["doc_id"], "page_num": number, "render_ms": page.get("render_encode_ms") or 0, "started_ms": page.get("started_ms") or now}
    options = {"temperature": config.temperature, "max_tokens": config.max_tokens, "timeout": config.api_timeout_secs}
    for attempt in range(config.max_retries + 1):
        if attempt:
            sleep(config.retry_backoff_ms * 2 ** (attempt - 1) / 1000)
        try:
            got = provider.complete(messages(page["image_b64"], prior, config), options | {"attempt": attempt})
        except Exception as e:
            last = e
            continue
        return base | {"markdown": got.content, "input_tokens": got.input_tokens, "output_tokens": got.output_tokens, "duration_ms": spent(), "retries": attempt, "error": None, "ended_ms": now + spent()}
    late = isinstance(last, TimeoutError)
    error = {"kind": "Timeout" if late else "LlmFailed", "page": number, "retries": config.max_retries, "secs": config.api_timeout_secs if late else None, "detail": str(last)}
    return base | {"markdown": "", "input_tokens": 0, "output_tokens": 0, "duration_ms": spent(), "retries": config.max_retries, "error": error, "ended_ms": now + spent()}


#: Calls for each concurrent one that are handed out ahead, so that a slow one doesn't keep the others waiting.
AHEAD = 4


def infer(pages: DataFrame, provider: Provider, config: ConversionConfig) -> DataFrame:
    """RAW_PAGE rows of encoded pages, with ``concurrency`` calls at a time in each task.

    Calls cost money and are not repeatable: write the result before using it
    twice, and switch speculation off for this stage.
    """

    out = arrow_schema(RAW_PAGE)

    def results(pages: Iterator[dict], pool: ThreadPoolExecutor) -> Iterator[dict]:
        waiting: deque = deque()
        for page in pages:
            waiting.append(pool.submit(infer_page, provider, page, None, config))
            if len(waiting) >= AHEAD * config.concurrency:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(config.concurrency) as pool:
            yield from in_batches(results(rows_of(batches), pool), out)

    return pages.mapInArrow(run, RAW_PAGE)


def resolve_provider(config: ConversionConfig, injected: Provider | None = None, factories: dict[str, Callable[[str], Provider]] | None = None, env: dict[str, str] | None = None) -> Provider:
    """The injected provider; else by name; else by environment; else by API key; else an error.

    ``factories`` maps provider names to constructors taking a model name.
    """
    env = os.environ if env is None else env
    http = lambda name: lambda model: HttpProvider(ENDPOINTS[name][0], model, env.get(ENDPOINTS[name][1] or ""))
    factories = {"mock": lambda model: MockProvider()} | {name: http(name) for name in ENDPOINTS} | (factories or {})

    def make(name: str, model: str | None) -> Provider:
        if name not in factories:
            raise ConversionError("ProviderNotConfigured", provider=name, hint=f"Known: {', '.join(sorted(factories))}")
        usual = next((m for m, names in DEFAULT_MODELS.items() if name in names), DEFAULT_MODEL)
        return factories[name](model or usual)

    if injected is not None:
        return injected
    if config.provider_name:
        return make(config.provider_name, config.model)
    if env.get("LLM_PROVIDER") and env.get("LLM_MODEL"):
        return make(env["LLM_PROVIDER"], env["LLM_MODEL"])
    for variable, name in (("OPENAI_API_KEY", "openai"), ("MISTRAL_API_KEY", "mistral")):
        if env.get(variable):
            return make(name, config.model)
    raise ConversionError("ProviderNotConfigured", provider="auto", hint="Set a provider name, or an API key.")
