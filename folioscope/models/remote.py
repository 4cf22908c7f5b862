"""Clients of hosted models, used one per partition from a pandas UDF."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable

from folioscope import constants as C
from folioscope.config import Config, ModelConfig

Post = Callable[[str, dict, dict, float], dict]


def post_json(url: str, body: dict, headers: dict, timeout: float, attempts: int = 4, pause: float = 1.0) -> dict:
    """POST ``body`` and return the JSON reply.

    Overload, server errors and lost connections are tried again after growing pauses, so that one
    failed call does not repeat a task and all its other calls; other error statuses raise at once.
    """
    for attempt in range(1, attempts):
        try:
            return _post_once(url, body, headers, timeout)
        except urllib.error.HTTPError as error:
            if error.code != 429 and error.code < 500:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            pass
        time.sleep(pause * 2 ** (attempt - 1))
    return _post_once(url, body, headers, timeout)


def _post_once(url: str, body: dict, headers: dict, timeout: float) -> dict:
    request = urllib.request.Request(
        url,
        data=json.dumps(body).encode(),
        headers={"Content-Type": "application/json", **headers},
        method="POST",
    )
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


class RemoteEmbedder:
    """``POST {"text": ...}`` to ``<url>/embed`` for every text."""

    def __init__(self, url: str, size: int = C.VECTOR_SIZE, post: Post = post_json):
        self.endpoint = url.rstrip("/") + "/embed"
        self.size = size
        self._post = post

    def embed(self, texts: Iterable[str]) -> list[list[float]]:
        return [
            self._post(self.endpoint, {"text": text}, {}, C.EMBED_TIMEOUT_S)["embedding"]
            for text in texts
        ]


class FeatureExtractionEmbedder:
    """Embeddings from an inference service that takes a model name and a token."""

    def __init__(self, base_url: str, model: str, token: str, size: int = C.VECTOR_SIZE, post: Post = post_json):
        self.endpoint = base_url.rstrip("/") + "/" + model
        self.size = size
        self._headers = {"Authorization": f"Bearer {token}"}
        self._post = post

    def embed(self, texts: Iterable[str]) -> list[list[float]]:
        return [
            self._post(self.endpoint, {"inputs": text}, self._headers, C.EMBED_TIMEOUT_S)
            for text in texts
        ]


class RemoteReranker:
    """One call per question with its documents; a relevance score for each of them."""

    def __init__(self, url: str, model: str, token: str, post: Post = post_json):
        self.url, self.model = url, model
        self._headers = {"Authorization": f"Bearer {token}"}
        self._post = post

    def score(self, question: str, texts: list[str]) -> list[float]:
        body = {"model": self.model, "query": question, "documents": texts, "top_n": len(texts)}
        scores = [0.0] * len(texts)
        for result in self._post(self.url, body, self._headers, C.CHAT_TIMEOUT_S)["results"]:
            scores[result["index"]] = float(result["relevance_score"])
        return scores


class ChatModel:
    """One chat-completion call per prompt."""

    def __init__(self, url: str, api_key: str, config: ModelConfig, system: str | None = None, post: Post = post_json):
        if not api_key:
            raise ValueError("the chat model needs an API key")
        self._url = url
        self._headers = {"Authorization": f"Bearer {api_key}"}
        self.config = config
        self._system = system
        self._post = post

    def complete(self, prompt: str) -> str:
        body: dict = {"model": self.config.model, "messages": []}
        if self._system is not None:
            body["messages"].append({"role": "system", "content": self._system})
        body["messages"].append({"role": "user", "content": prompt})
        if self.config.temperature is not None:
            body["temperature"] = self.config.temperature
        if self.config.max_tokens is not None:
            body["max_tokens"] = self.config.max_tokens
        reply = self._post(self._url, body, self._headers, C.CHAT_TIMEOUT_S)
        return reply["choices"][0]["message"]["content"].strip()


def summary_model(url: str, api_key: str, config: Config, post: Post = post_json) -> ChatModel:
    return ChatModel(url, api_key, config.summary, C.SUMMARY_SYSTEM_MESSAGE, post)


def answer_model(url: str, api_key: str, config: Config, post: Post = post_json) -> ChatModel:
    return ChatModel(url, api_key, config.answer, post=post)


def judge_model(url: str, api_key: str, config: Config, post: Post = post_json) -> ChatModel:
    return ChatModel(url, api_key, config.judge, post=post)
