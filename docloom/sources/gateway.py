"""Boundaries to the outside (models, renderers): a protocol, a scripted stand-in, and the bounded, retrying call over rows.

Nothing here reaches a network. A deployment passes its own client or renderer; the stand-in replays scripted replies, as tests do.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

#: Tries after 'rate limited' or 'unavailable', after network errors, after bad or empty bodies; first wait in seconds.
RETRIES = {"rate_limited": 3, "unavailable": 3, "network": 2, "body": 3}
FIRST_WAIT = 10.0


class Upstream(Exception):
    def __init__(self, kind: str, retry_after: float | None = None):
        super().__init__(kind)
        self.kind, self.retry_after = kind, retry_after


class Client(Protocol):
    def chat(self, prompt: str) -> str: ...


class Renderer(Protocol):
    def pages(self, content: bytes) -> list[tuple[str, bytes | None]]:
        """(text, image or None) of each page."""
        ...


@dataclass
class Scripted:
    """Replies by prompt, one after the other; an exception among them is raised."""

    replies: dict[str, list]
    at: dict[str, int] = field(default_factory=dict)

    def chat(self, prompt: str) -> str:
        n = self.at.get(prompt, 0)
        self.at[prompt] = n + 1
        got = self.replies[prompt][min(n, len(self.replies[prompt]) - 1)]
        if isinstance(got, Exception):
            raise got
        return got


class PlainRenderer:
    """Pages of a plain text by form feeds; 100 at most."""

    most = 100

    def pages(self, content: bytes) -> list[tuple[str, bytes | None]]:
        out = [(t, None) for t in content.decode("utf-8", "replace").split("\f")]
        if len(out) > self.most:
            raise ValueError(f"more than {self.most} pages")
        return out


def call(client: Client, prompt: str, sleep: Callable[[float], None], rng: random.Random | None = None) -> str:
    """One reply, with retries by kind: waits of 10, 20, 40 seconds or as told, with some jitter."""
    rng, used = rng or random.Random(), {}
    while True:
        try:
            reply = client.chat(prompt)
            if reply.strip():
                return reply
            raise Upstream("body")
        except Upstream as e:
            n = used[e.kind] = used.get(e.kind, 0) + 1
            if n > RETRIES.get(e.kind, 0):
                raise
            sleep((e.retry_after if e.retry_after is not None else FIRST_WAIT * 2 ** (n - 1)) + rng.uniform(0.1, 0.5))


def chat_rows(rows: DataFrame, key: str, prompt: str, make: Callable[[], Client], parallel: int = 4, sleep: Callable[[float], None] | None = None) -> DataFrame:
    """key, reply, error of each row's prompt; ``parallel`` partitions call at once, each with a client of its own."""
    import time

    wait = sleep or time.sleep

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for pdf in batches:
            out = []
            for k, p in zip(pdf[key], pdf[prompt]):
                try:
                    out.append((k, call(client, p, wait), None))
                except Upstream as e:
                    out.append((k, None, e.kind))
            yield pd.DataFrame(out, columns=[key, "reply", "error"])

    return rows.select(key, prompt).repartition(parallel).mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, reply string, error string")


def render(files: DataFrame, make: Callable[[], Renderer]) -> DataFrame:
    """path, page, text, image of binary files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        renderer = make()
        for pdf in batches:
            out = [(path, i, t, img) for path, c in zip(pdf["path"], pdf["content"]) for i, (t, img) in enumerate(renderer.pages(bytes(c)))]
            yield pd.DataFrame(out, columns=["path", "page", "text", "image"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, image binary")


def assemble_glyphs(glyphs: DataFrame, by: list[str], order: str) -> DataFrame:
    """Lines of text from placed glyphs (char, x, y, width, size): a break where y moves by 1.5 sizes, or x falls back and y moves by
    half a size; a space where the gap is over a tenth of the size."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy(*by).orderBy(order)
    end, py = F.lag(F.col("x") + F.col("width")).over(w), F.lag("y").over(w)
    dy = F.abs(F.col("y") - py)
    sep = F.when(py.isNull(), "").when((dy > 1.5 * F.col("size")) | ((F.col("x") < end) & (dy > 0.5 * F.col("size"))), "\n").when(F.col("x") - end > 0.1 * F.col("size"), " ").otherwise("")
    g = glyphs.withColumn("_t", F.concat(sep, F.col("char")))
    return g.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_t"))), lambda x: x["_t"]), "").alias("text"))
