"""Work of pluggable models: labels of fragments, reading of pages."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import runs

Chat = Callable[[str], str]
Reader = Callable[[bytes], str]


def _label(answer: str) -> str | None:
    """The label of a model's answer, by the rule of ``functions.text.extract_label``."""
    import re

    found = re.search(r"\{[^{}]*\}", answer or "", re.DOTALL)
    try:
        label = json.loads(found[0]).get("label") if found else None
    except ValueError:
        return None
    return label if isinstance(label, str) and label in text.LABELS else None


#: Requests that one task has open at once. Times ``partitions``, it limits the requests of a job.
AT_ONCE = 8

T = TypeVar("T")


def _together(batches: Iterator[pd.DataFrame], items: Callable[[pd.DataFrame], list], ask: Callable[[object], T], at_once: int) -> Iterator[tuple[pd.DataFrame, list[T]]]:
    """Each batch with the answers to its items, in order; at most ``at_once`` are asked for at a time, and equal items of a batch once.

    The next batch is asked for while the answers to one are awaited, and no more than that.
    """
    with ThreadPoolExecutor(at_once) as pool:
        waiting: deque = deque()

        def done() -> tuple[pd.DataFrame, list[T]]:
            pdf, own, asked = waiting.popleft()
            return pdf, [asked[i].result() for i in own]

        for pdf in batches:
            own = items(pdf)
            waiting.append((pdf, own, {i: pool.submit(ask, i) for i in dict.fromkeys(own)}))
            if len(waiting) > 1:
                yield done()
        while waiting:
            yield done()


def _prompts(fragments: DataFrame, partitions: int | None) -> DataFrame:
    rows = fragments.select("pair_id", "frag_no", text.fallback_label(F.col("opcode")).alias("fallback"), text.fragment_prompt(F.col("opcode"), F.col("old_blocks"), F.col("new_blocks")).alias("prompt"))
    return rows.repartition(partitions, "pair_id", "frag_no") if partitions else rows


def _attempts(chat: Chat) -> Callable[[str], list[tuple[str | None, str | None]]]:
    """Asks for a label: (answer, error) of one attempt, or of two if the first answer is unusable."""

    def ask(prompt: str) -> list[tuple[str | None, str | None]]:
        out: list[tuple[str | None, str | None]] = []
        for _ in range(2):
            try:
                out.append((chat(prompt), None))
            except Exception as e:  # noqa: BLE001  the callable may raise anything; its failure has a defined result
                out.append((None, type(e).__name__))
            if out[-1][1] or _label(out[-1][0]):
                break
        return out

    return ask


def ask_fragments(fragments: DataFrame, chat: Chat, partitions: int | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """A model's answers as rows ``pair_id, frag_no, attempt`` (from 1), ``content, error``, to be stored and given to ``labels_from_responses``.

    ``partitions`` times ``at_once`` requests are open at most; without ``partitions``, as many tasks ask as Spark runs.
    """
    rows = _prompts(fragments, partitions)
    runs.lean_batches(fragments.sparkSession)
    ask = _attempts(chat)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, got in _together(batches, lambda p: p["prompt"].tolist(), ask, at_once):
            made = [(pair, no, k + 1, *x) for pair, no, own in zip(pdf["pair_id"], pdf["frag_no"], got) for k, x in enumerate(own)]
            yield pd.DataFrame(made, columns=["pair_id", "frag_no", "attempt", "content", "error"])

    types = dict(rows.dtypes)
    return rows.select("pair_id", "frag_no", "prompt").mapInPandas(run, f"pair_id {types['pair_id']}, frag_no {types['frag_no']}, attempt int, content string, error string")


def classify_fragments(fragments: DataFrame, chat: Chat | None = None, partitions: int | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """``pair_id, frag_no, label, semantic`` of each fragment.

    ``chat`` answers a prompt; an unusable answer is asked for once more, an exception
    isn't; the opcode's label stands in then, with ``semantic`` false. Without ``chat`` no
    Python runs. ``partitions`` times ``at_once`` are asked at once at most; equal prompts of a
    batch are asked once. Nothing is stored; ``ask_fragments`` is for answers that must not be asked for again.
    """
    rows = _prompts(fragments, partitions)
    if chat is None:
        return rows.select("pair_id", "frag_no", F.col("fallback").alias("label"), F.lit(False).alias("semantic"))
    runs.lean_batches(fragments.sparkSession)
    ask = _attempts(chat)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, got in _together(batches, lambda p: p["prompt"].tolist(), ask, at_once):
            labels = [_label(own[-1][0] or "") for own in got]
            yield pd.DataFrame({"pair_id": pdf["pair_id"], "frag_no": pdf["frag_no"], "label": [g or f for g, f in zip(labels, pdf["fallback"])], "semantic": [g is not None for g in labels]})

    types = dict(rows.dtypes)
    return rows.mapInPandas(run, f"pair_id {types['pair_id']}, frag_no {types['frag_no']}, label string, semantic boolean")


def labels_from_responses(fragments: DataFrame, responses: DataFrame) -> DataFrame:
    """Labels from stored answers: ``responses``: ``pair_id, frag_no, attempt`` (from 1), ``content, error``.

    The second attempt counts only if the first has no error and no label; an error
    ends the asking. Else the opcode's label, with ``semantic`` false.
    """
    own = responses.withColumn("label", F.when(F.col("error").isNull(), text.extract_label(F.col("content"))))
    at = lambda n, c: F.max(F.when(F.col("attempt") == n, F.col(c)))
    both = own.groupBy("pair_id", "frag_no").agg(at(1, "label").alias("l1"), at(1, "error").alias("e1"), at(2, "label").alias("l2"), at(2, "error").alias("e2"))
    out = fragments.select("pair_id", "frag_no", "opcode").join(both, ["pair_id", "frag_no"], "left")
    label = F.when(F.col("e1").isNotNull(), F.lit(None)).otherwise(F.coalesce("l1", F.when(F.col("e2").isNull(), F.col("l2"))))
    return out.select("pair_id", "frag_no", F.coalesce(label, text.fallback_label(F.col("opcode"))).alias("label"), label.isNotNull().alias("semantic"))


def read_pages(pages: DataFrame, reader: Reader | None = None, partitions: int | None = None, fail_fast_markdown: str = "", at_once: int = AT_ONCE) -> DataFrame:
    """``pages`` (keys and ``content``) read by ``reader``: ``content`` gives way to ``markdown, unreadable, degraded``.

    Up to two attempts: an exception is tried again, an empty answer isn't. Without a
    reader every page is unreadable. ``partitions`` times ``at_once`` pages are being read at once at most.
    """
    keys = [c for c in pages.columns if c != "content"]
    if reader is None:
        return pages.select(*keys, F.lit(fail_fast_markdown).alias("markdown"), F.lit(True).alias("unreadable"), F.lit(True).alias("degraded"))

    def read(content: bytes) -> str:
        for _ in range(2):
            try:
                return (reader(content) or "").strip()
            except Exception:  # noqa: BLE001, S112  the callable may raise anything; it is tried twice
                continue
        return ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, got in _together(batches, lambda p: [bytes(c) for c in p["content"]], read, at_once):
            yield pdf[keys].assign(markdown=got, unreadable=[not g for g in got], degraded=[not g for g in got])

    types = dict(pages.dtypes)
    runs.lean_batches(pages.sparkSession)
    pages = pages.repartition(partitions, *keys) if partitions else pages
    return pages.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", markdown string, unreadable boolean, degraded boolean")


def read_pages_cached(pages: DataFrame, cache: DataFrame, reader: Reader | None, model: str, version: str, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages read with a cache: (reads of ``pages``, new rows for the cache).

    ``pages``: keys and ``content``; ``cache``: ``key, markdown``. Equal content is read
    once; what the cache has isn't read; only successes go to the cache.
    """
    keys = [c for c in pages.columns if c != "content"]
    keyed = pages.withColumn("key", text.page_cache_key(F.col("content"), model, version))
    asked = keyed.select("key", "content").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    fresh = read_pages(asked, reader, partitions).persist(StorageLevel.MEMORY_AND_DISK)  # both results need it
    hits = cache.select("key", "markdown", F.lit(False).alias("unreadable"), F.lit(False).alias("degraded"))
    out = keyed.select(*keys, "key").join(hits.unionByName(fresh), "key", "left").select(*keys, "markdown", "unreadable", "degraded")
    return out, fresh.filter("NOT unreadable").select("key", "markdown")


_CACHE = "key string, markdown string, unreadable boolean, degraded boolean"


def cached_reads_at(spark: SparkSession, path: str) -> DataFrame:
    """``key, markdown``: the last successful read of each key in the cache at ``path``."""
    rows = runs.read_runs(spark, path, "reads", _CACHE)
    return rows.filter("NOT unreadable").groupBy("key").agg(F.max_by("markdown", "run_no").alias("markdown"))


def read_pages_at(pages: DataFrame, path: str, reader: Reader | None, model: str, version: str, partitions: int | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """``pages`` (keys and ``content``) read with a cache that lives at ``path``: the keys, ``markdown, unreadable, degraded``.

    What the cache has isn't read, equal content is read once. New reads are written as one run of the cache
    before any result uses them: neither a lost executor nor another action on the result asks the
    reader again. Failures are written, too, and asked for again by the next call only.
    """
    spark = pages.sparkSession
    keys = [c for c in pages.columns if c != "content"]
    keyed = pages.withColumn("key", text.page_cache_key(F.col("content"), model, version))
    known = cached_reads_at(spark, path)
    asked = keyed.select("key", "content").dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
    runs.write_run({"reads": read_pages(asked, reader, partitions, at_once=at_once)}, path)
    found = cached_reads_at(spark, path)
    lost = F.col("markdown").isNull()
    out = keyed.select(*keys, "key").join(found, "key", "left")
    return out.select(*keys, F.coalesce("markdown", F.lit("")).alias("markdown"), lost.alias("unreadable"), lost.alias("degraded"))


def compact_reads(spark: SparkSession, path: str) -> None:
    """Write the last successful read of each key as one run in place of all before."""
    found = cached_reads_at(spark, path).select("key", "markdown", F.lit(False).alias("unreadable"), F.lit(False).alias("degraded"))
    runs.write_run({"reads": found}, path, replaces_all=True)
