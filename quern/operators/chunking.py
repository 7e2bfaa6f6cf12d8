"""Document chunking as a table function: the window's advance depends on the text, so it runs in Python, once per document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.config import DEFAULT, Tuning
from quern.functions.hashes import chunk_hash
from quern.functions.text import summary

_SPACE = " \t\n\r\v\f\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def blocks(content: str) -> list[str]:
    """Headings, paragraphs and fenced code; a fence that never closes is a paragraph."""
    out: list[str] = []
    held: list[str] = []
    fenced = False

    def flush() -> None:
        joined = "\n".join(held).strip(_SPACE)
        held.clear()
        if joined:
            out.append(joined)

    for line in content.replace("\r\n", "\n").strip(_SPACE).split("\n"):
        bare = line.strip(_SPACE)
        if bare.startswith("```"):
            if not fenced:
                flush()
            held.append(line)
            if fenced:
                flush()
            fenced = not fenced
        elif fenced:
            held.append(line)
        elif bare.startswith("#"):
            flush()
            out.append(bare)
        elif not bare:
            flush()
        else:
            held.append(line)
    flush()
    return out


def windows(text: str, most: int, overlap: int, ratio: float = DEFAULT.sentence_ratio) -> list[str]:
    """Windows of up to `most` characters that end at a sentence or line where one ends late enough."""
    text = text.strip(_SPACE)
    if len(text) <= most:
        return [text] if text else []
    out, at = [], 0
    while True:
        end = min(at + most, len(text))
        if end < len(text):
            stop = max(text.rfind(mark, at, end) for mark in (". ", "。", "! ", "? ", "\n")) - at
            if stop > int(most * ratio):
                end = at + stop + 1
        out.append(text[at:end].strip(_SPACE))
        if end >= len(text):
            return [x for x in out if x]
        at = max(end - overlap, at + 1)


def split_text(content: str | None, target: int = DEFAULT.target_chars, most: int = DEFAULT.max_chars, overlap: int = DEFAULT.overlap_chars) -> list[str]:
    """Chunks: parts join until the target is reached or the next would exceed the maximum; the tail of one opens the next."""
    out: list[str] = []
    parts: list[str] = []
    size = 0

    def close(tail: int) -> None:
        nonlocal parts
        whole = "\n\n".join(parts).strip(_SPACE)
        parts = []
        if whole:
            out.append(whole)
            end = whole[-tail:].strip(_SPACE) if tail > 0 else ""
            parts = [end] if end else []

    for block in blocks(content or ""):
        for part in windows(block, most, overlap) if len(block) > most else [block]:
            extra = len(part) + (2 if size else 0)
            if size >= target or size and size + extra > most:
                close(overlap)
                size = len("\n\n".join(parts))
                extra = len(part) + (2 if size else 0)
            parts.append(part)
            size += extra
    close(0)
    return out


def chunk_documents(docs: DataFrame, path: str = "path", content: str = "content", t: Tuning = DEFAULT) -> DataFrame:
    """(path, chunk_index, chunk_count, content, summary, semantic_hash) of (path, content).

    Batches of documents cross to Python once through Arrow; nothing is shuffled.
    """
    target, most, overlap = t.target_chars, t.max_chars, t.overlap_chars

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, len(c), x) for p, d in zip(b["path"], b["content"]) for c in [split_text(d, target, most, overlap)] for i, x in enumerate(c)]
            yield pd.DataFrame(rows, columns=["path", "chunk_index", "chunk_count", "content"])

    out = docs.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, "path string, chunk_index int, chunk_count int, content string")
    return out.withColumn("summary", summary(F.col("content"), t)).withColumn("semantic_hash", chunk_hash(F.col("path"), F.col("chunk_index"), F.col("content")))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_count", F.count("*").over(Window.partitionBy("path")))
