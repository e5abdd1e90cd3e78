"""What lies outside the engine, as callables: embedding models and web search."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

log = logging.getLogger(__name__)

Embedder = Callable[[list[str]], list[list[float]]]
WebSearch = Callable[[str, int], list[dict]]
KEYLESS = frozenset({"duckduckgo"})
PROVIDERS = frozenset({"duckduckgo", "tavily", "brave"})


def embed(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """(chunk_id, doc_id, embedding) of chunks (chunk_id, doc_id, prelude, body); null where the model failed.

    A failing document is skipped, not fatal: its chunks keep a null vector.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for doc_id, rows in df.groupby("doc_id", sort=False, dropna=False):
                try:
                    vectors = embedder((rows["prelude"] + "\n\n" + rows["body"]).tolist()) if len(rows) else []
                except Exception as e:
                    log.warning("embedding failed for %s: %s", doc_id, e)
                    vectors = [None] * len(rows)
                out.append(pd.DataFrame({"chunk_id": rows["chunk_id"], "doc_id": doc_id, "embedding": [None if v is None else np.asarray(v, dtype=np.float32) for v in vectors]}))
            yield pd.concat(out) if out else pd.DataFrame({"chunk_id": [], "doc_id": [], "embedding": []})

    return chunks.select("chunk_id", "doc_id", "prelude", "body").mapInPandas(run, "chunk_id string, doc_id string, embedding array<float>")


def check_space(meta: dict[str, str], model: str, dim: int, rebuild: bool = False) -> str:
    """What to do about the recorded embedding space: 'record', 'ok' or 'reset'; a mismatch raises."""
    if "embedding_model" not in meta:
        return "record"
    if (meta["embedding_model"], int(meta["embedding_dim"])) == (model, dim):
        return "ok"
    if rebuild:
        return "reset"
    raise ValueError(f"vectors are of {meta['embedding_model']} ({meta['embedding_dim']}), not of {model} ({dim})")


def provider_available(name: str, keys: dict[str, str | None]) -> bool:
    return name in PROVIDERS and (name in KEYLESS or bool(keys.get(name)))


def web_results(questions: DataFrame, search: WebSearch, limit: int = 5) -> DataFrame:
    """(qid, ord, title, url, snippet) of a search for each question; rows without a url are dropped, failures give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for qid, question in zip(df["qid"], df["text"], strict=True):
                try:
                    found = search(question, limit)
                except Exception:
                    log.warning("web search failed", exc_info=True)
                    found = []
                texts = [tuple(str(r.get(k) or "").strip() for k in ("title", "url", "snippet")) for r in found]
                rows += [(qid, i, *t) for i, t in enumerate([t for t in texts if t[1]][:limit], 1)]
            yield pd.DataFrame(rows, columns=["qid", "ord", "title", "url", "snippet"])

    kind = questions.schema["qid"].dataType.simpleString()
    return questions.select("qid", "text").mapInPandas(run, f"qid {kind}, ord int, title string, url string, snippet string")


def answer(messages: DataFrame, generate: Callable[[str, str], str]) -> DataFrame:
    """(qid, answer) of a model called with the rules and the message of each (qid, system, message), where the row is; a failing call fails the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"qid": df["qid"], "answer": [generate(s, m) for s, m in zip(df["system"], df["message"], strict=True)]})

    return messages.select("qid", "system", "message").mapInPandas(run, f"qid {messages.schema['qid'].dataType.simpleString()}, answer string")
