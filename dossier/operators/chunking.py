"""Sentence packing with overlap: sections to chunks.

Packing is a scan whose next step depends on the last chunk, so it runs in Python, a section at a time, within
the task that holds the section; nothing is shuffled. Counter and splitter are plug-ins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Counter = Callable[[str], int]
Splitter = Callable[[str], list[str]]
_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[\"'(\[]*[A-Z0-9À-Þ])|\n+")


def count_words(text: str) -> int:
    return len(text.split())


def split_sentences(text: str) -> list[str]:
    """The default splitter: at line ends, and after closing marks before a capital or digit."""
    return [s for s in (p.strip() for p in _END.split(text) if p) if s]


def split_lines(text: str) -> list[str]:
    return [s for s in map(str.strip, text.splitlines()) if s]


@dataclass(frozen=True)
class Packer:
    target: int = 400
    overlap: int = 50
    most: int = 512
    count: Counter = count_words
    sentences: Splitter = split_sentences

    def pack(self, text: str) -> Iterator[tuple[str, int, bool]]:
        """(text, tokens, oversized) of each chunk."""
        parts = [(s, self.count(s)) for s in self.sentences(text) if s.strip()]
        at = 0
        while at < len(parts):
            if parts[at][1] > self.target:
                for piece in self.divide(parts[at][0]):
                    yield piece, self.count(piece), True
                at += 1
                continue
            stop, total = at, 0
            while stop < len(parts) and parts[stop][1] <= self.target and total + parts[stop][1] <= self.target:
                total += parts[stop][1]
                stop += 1
            joined = " ".join(s for s, _ in parts[at:stop])
            yield joined, self.count(joined), False
            if stop == len(parts):
                return
            back, shared = stop, 0  # whole sentences at the end that the next chunk repeats
            while back > at and shared + parts[back - 1][1] <= self.overlap:
                back -= 1
                shared += parts[back][1]
            at = max(at + 1, back)

    def divide(self, text: str) -> Iterator[str]:
        """Pieces of at most `most` tokens: by paragraphs, then sentences, then words, then characters."""
        if self.count(text) <= self.most:
            if text.strip():
                yield text
            return
        for cut in (lambda t: t.split("\n\n"), lambda t: t.split("\n"), self.sentences):
            if len(pieces := [p.strip() for p in cut(text) if p.strip()]) > 1:
                for p in pieces:
                    yield from self.divide(p)
                return
        words = text.split()
        if len(words) > 1:
            yield from self._by_words(words)
            return
        half = len(text) // 2
        for p in (text[:half].strip(), text[half:].strip()) if half else (text.strip(),):
            if p:
                yield from self.divide(p) if half else (p,)

    def _by_words(self, words: list[str]) -> Iterator[str]:
        """As many words in a piece as their own counts allow; a word above the cap is divided by itself."""
        held, total = [], 0
        for w in words:
            n = self.count(w)
            if held and (n > self.most or total + n > self.most):
                yield " ".join(held)
                held, total = [], 0
            if n > self.most:
                yield from self.divide(w)
            else:
                held.append(w)
                total += n
        if held:
            yield " ".join(held)


def chunk_sections(sections: DataFrame, packer: Packer | None = None) -> DataFrame:
    """sections as from detect(). doc_id, section, section_order, chunk_index (within the section), text, token_count, metadata."""
    packer = packer or Packer()

    @F.pandas_udf("array<struct<chunk_index: int, text: string, token_count: int, oversized: boolean>>")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"chunk_index": i, "text": c, "token_count": n, "oversized": big} for i, (c, n, big) in enumerate(packer.pack(t or ""))])

    rows = sections.select("doc_id", F.col("name").alias("section"), "section_order", "item_key", F.col("metadata").alias("of_section"), F.explode(packed("text")).alias("c"))
    empty = F.create_map().cast("map<string,string>")
    metadata = F.map_concat(
        F.create_map(F.lit("item_key"), F.col("item_key")),
        F.when(F.col("of_section")["part"].isNotNull(), F.create_map(F.lit("part"), F.col("of_section")["part"])).otherwise(empty),
        F.when(F.col("c.oversized"), F.create_map(F.lit("oversized"), F.lit("true"))).otherwise(empty),
    )
    return rows.select("doc_id", "section", "section_order", "c.chunk_index", "c.text", "c.token_count", metadata.alias("metadata"))


def number_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_index over the whole document; the one within the section goes to metadata."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_order", "chunk_index")) - 1
    return chunks.withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("section_chunk_index"), F.col("chunk_index").cast("string")))).withColumn("chunk_index", at.cast("int"))
