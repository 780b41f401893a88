"""Calls of a model that is served behind the chat-completions interface, for plans.models.called()."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from time import sleep

from gridloom.sources.paged import AGAIN, LONGEST, WAIT
from gridloom.sources.pictures import array_of, data_uri


def posted(url: str, body: dict, key: str = "EMPTY", tries: int = 6, wait: Callable[[float], None] = sleep) -> dict:
    """POST of JSON with waits that double, or as long as Retry-After says; other statuses raise at once."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    pause = WAIT
    for left in range(tries - 1, -1, -1):
        try:
            with urllib.request.urlopen(request, timeout=600) as reply:
                return json.loads(reply.read())
        except urllib.error.HTTPError as e:
            if e.code not in AGAIN or not left:
                raise
            after = e.headers.get("Retry-After") if e.headers else None
            wait(min(float(after) if after and after.isdigit() else pause, LONGEST))
            pause *= 2
    raise RuntimeError("unreachable")


def messages(prompt: str, images: list[dict], max_side: int | None) -> list[dict]:
    """One user turn: the pictures (image structs) in order, then the prompt."""
    pictures = [{"type": "image_url", "image_url": {"url": data_uri(array_of(i["data"], i["height"], i["width"], i["nChannels"]), max_side)}} for i in images]
    return [{"role": "user", "content": [*pictures, {"type": "text", "text": prompt}]}]


def served(model: str, url: str = "http://localhost:8000/v1", key: str = "EMPTY", max_side: int | None = 1536, thinking: bool = False, max_tokens: int = 2048, post: Callable[[str, dict, str], dict] = posted) -> Callable[[], Callable[[dict], str]]:
    """A model for called(): rows have prompt and may have image or images (structs), schema (a JSON schema that
    the answer has to fit), temperature and seed."""

    def open_model() -> Callable[[dict], str]:
        def ask(row: dict) -> str:
            images = row.get("images") if row.get("images") is not None else [row["image"]] if row.get("image") is not None else []
            body = {"model": model, "messages": messages(row["prompt"], list(images), max_side), "max_tokens": max_tokens, "temperature": float(row.get("temperature") or 0.0), "chat_template_kwargs": {"enable_thinking": thinking}}
            if row.get("seed") is not None:
                body["seed"] = int(row["seed"])
            if row.get("schema"):
                body["guided_json"] = json.loads(row["schema"])
            return post(f"{url}/chat/completions", body, key)["choices"][0]["message"]["content"] or ""

        return ask

    return open_model
