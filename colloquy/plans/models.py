"""The boundary to language and embedding models: protocols, and defaults that need no network."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from colloquy.functions import domains as D
from colloquy.operators import vocabulary as V


class Extractor(Protocol):
    """Answers a window's prompt with JSON text of edges and stances. Instances are sent to executors."""

    def __call__(self, prompt: str, window_text: str) -> str: ...


class Embedder(Protocol):
    """Unit vectors of labels."""

    def __call__(self, labels: list[str]) -> list[list[float]]: ...


class Namer(Protocol):
    """Names clusters: takes (number, type, phrases) of a batch, gives (number, canonical label, type) of any of them."""

    def __call__(self, batch: list[tuple[int, str, list[str]]]) -> list[tuple[int, str, str]]: ...


class WordPairs:
    """Offline stand-in: the first two words of each line of a window make an edge, the first word a stance."""

    def __call__(self, prompt: str, window_text: str) -> str:
        edges, stances = [], []
        for line in window_text.split("\n"):
            words = line.split()
            if len(words) > 1:
                confidence = len(line) % 101 / 100
                edges.append({"source_label": words[0], "source_type": "topic", "relation": "associated_with", "target_label": words[1], "target_type": "topic", "evidence_text": f"{words[0]} {words[1]}", "stance": "asserted", "polarity": "neutral", "explicitness": "explicit", "confidence": confidence})
                stances.append({"concept_label": words[0], "concept_type": "topic", "polarity": "neutral", "evidence_text": words[0], "explicitness": "explicit", "confidence": confidence})
        return json.dumps({"edges": edges, "stances": stances})


class HashedLetters:
    """Offline stand-in: counts of hashed letter triples, so labels that share letters are near."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, labels: list[str]) -> list[list[float]]:
        from zlib import crc32

        out = []
        for label in labels:
            v = [0.0] * self.size
            padded = f"  {' '.join(label.lower().split())} "
            for k in range(len(padded) - 2):
                v[crc32(padded[k : k + 3].encode()) % self.size] += 1
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out


def attempts(call: Callable[[], str], n: int = 3, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The first answer that parses as JSON. Only unreadable answers are tried again, after pause times the attempts so
    far; errors of transport are the caller's."""
    for k in range(1, n + 1):
        raw = call()
        bare = raw.strip().removeprefix("```json").removeprefix("```").removesuffix("```")
        try:
            json.loads(bare)
            return raw
        except ValueError:
            if k == n:
                raise
            sleep(pause * k)
    raise AssertionError


def answers(windows: DataFrame, extractor: Extractor, prompt: str = "prompt", text: str = "window_text", partitions: int | None = None, at_once: int = 4) -> DataFrame:
    """windows with `raw`, the extractor's answer, and `error`; a window for which it fails has a null answer, and so no
    records, and the error's text. Each task has at_once calls under way at most. Every reading of the result asks again:
    write it to a table first."""

    def one(pair: tuple[str, str]) -> tuple[str | None, str | None]:
        try:
            return attempts(lambda: extractor(*pair)), None
        except Exception as e:  # noqa: BLE001  one failed call costs its window only
            return None, f"{type(e).__name__}: {e}"[:500]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                got = list(pool.map(one, zip(b[prompt], b[text], strict=True)))
                yield b.assign(raw=pd.Series([r for r, _ in got], b.index, object), error=pd.Series([e for _, e in got], b.index, object))

    schema = StructType([*windows.schema.fields]).add("raw", StringType()).add("error", StringType())
    w = windows.repartition(partitions) if partitions else windows
    return w.mapInPandas(run, schema)


def embedded(items: DataFrame, embedder: Embedder, label: str = "label") -> DataFrame:
    """items with `embedding`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(embedding=embedder(b[label].tolist()) if len(b) else [])

    return items.mapInPandas(run, StructType([*items.schema.fields]).add("embedding", ArrayType(DoubleType())))


def response_schema() -> str:
    """What an answer must look like, as JSON schema text for a prompt."""
    text, number = {"type": "string"}, {"type": "number", "minimum": 0, "maximum": 1}
    one = lambda *values: {"type": "string", "enum": list(values)}
    shared = {"evidence_text": text, "polarity": one(*D.POLARITIES), "explicitness": one(*D.EXPLICITNESS), "confidence": number}
    node = one(*D.NODE_TYPES)
    edge = {"source_label": text, "source_type": node, "relation": one(*D.RELATIONS), "target_label": text, "target_type": node, "stance": one(*D.STANCES)} | shared
    stance = {"concept_label": text, "concept_type": node} | shared
    item = lambda p: {"type": "array", "items": {"type": "object", "properties": p, "required": list(p)}}
    return json.dumps({"type": "object", "properties": {"edges": item(edge), "stances": item(stance)}, "required": ["edges", "stances"]})


def assigned_names(members: DataFrame, namer: Namer, batch: int = V.BATCH) -> DataFrame:
    """(type, cluster, canonical_label, canonical_type) as a namer gives them, a batch of clusters for each call.

    Numbers that are not of the batch and types that don't exist count for nothing; a call that fails, or leaves a cluster
    out, gives no row for it, and vocabulary.named() falls back to its most mentioned label.
    """
    heads = V.representatives(members).groupBy("type", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("phrases"))
    calls = F.greatest(F.ceil(F.lit(heads.count()) / batch), F.lit(1))
    numbered = heads.withColumn("call", F.pmod(F.xxhash64("type", "cluster"), calls)).withColumn("number", F.row_number().over(Window.partitionBy("call").orderBy("type", "cluster")) - 1)
    # Calls go by hashes, so some get more than a batch; these are split.
    numbered = numbered.withColumn("call", F.struct("call", F.floor(F.col("number") / batch))).withColumn("number", F.col("number") % batch)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        try:
            got = namer([(int(n), t, list(p)) for n, t, p in zip(pdf["number"], pdf["type"], pdf["phrases"], strict=True)])
        except Exception:  # noqa: BLE001  the fallback names these clusters
            got = []
        names = {n: (label, kind) for n, label, kind in got if kind in D.NODE_TYPES}
        rows = [(t, c, *names[n]) for n, t, c in zip(pdf["number"].tolist(), pdf["type"].tolist(), pdf["cluster"].tolist(), strict=True) if n in names]
        return pd.DataFrame(rows, columns=["type", "cluster", "canonical_label", "canonical_type"])

    kind = dict(members.dtypes)["cluster"]
    return numbered.groupBy("call").applyInPandas(run, f"type string, cluster {kind}, canonical_label string, canonical_type string")
