"""Answers by a remote chat model, with the local answer where it gives none.

The client is a function (system, user) -> text, made once a task by a factory that runs on executors, so that
connections aren't shipped. Anything it raises counts as no answer."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Client = Callable[[str, str], str]


def chat_client(base_url: str, model: str, key: str, temperature: float = 0.2, max_tokens: int = 700, timeout: float = 30) -> Callable[[], Client]:
    """A factory of clients of a chat completion service."""

    def make() -> Client:
        def ask(system: str, user: str) -> str:
            messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
            body = json.dumps({"model": model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens}).encode()
            request = urllib.request.Request(base_url.rstrip("/") + "/chat/completions", body, {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return json.load(reply)["choices"][0]["message"]["content"].strip()

        return ask

    return make


def prompts(questions: DataFrame, contexts: DataFrame, template: str) -> DataFrame:
    """questions (query_id, question), contexts (query_id, context): (query_id, prompt), the template with {question}
    and {context} filled in. Questions without a context get none."""
    before, _, after = template.partition("{context}")
    fill = lambda part: F.replace(F.lit(part), F.lit("{question}"), F.col("question"))
    return questions.join(contexts, "query_id").select("query_id", F.concat(fill(before), "context", fill(after)).alias("prompt"))


def remote_answers(prompts: DataFrame, system: str, factory: Callable[[], Client]) -> DataFrame:
    """prompts (query_id long, prompt): (query_id, remote), null where the client failed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for frame in frames:
            out = []
            for prompt in frame.prompt:
                try:
                    out.append(client(system, prompt))
                except Exception:  # no answer; the local one stands in
                    out.append(None)
            yield pd.DataFrame({"query_id": frame.query_id, "remote": pd.Series(out, dtype="object")})

    return prompts.select(F.col("query_id").cast("long").alias("query_id"), "prompt").mapInPandas(run, "query_id long, remote string")


def with_remote(local: DataFrame, remote: DataFrame) -> DataFrame:
    """local (query_id, mode, answer): the remote answer and mode where there is one."""
    rows = local.join(remote, "query_id", "left")
    return rows.select("query_id", F.when(F.col("remote").isNotNull(), "remote_llm").otherwise(F.col("mode")).alias("mode"), F.coalesce("remote", "answer").alias("answer"))
