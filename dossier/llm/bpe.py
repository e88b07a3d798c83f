"""Operator 7: BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts each text into chunks whose borders depend on content only, so that
a passage that many documents share gives the same chunks in all of them. A chunk is encoded once and
kept in the Python worker's bounded memory. Where two chunks meet, tokens may differ from those of the
whole text; the join is repaired by encoding again the stretch between the nearest two places at which
the pre-tokenizer cuts whatever stands around them, so that both of its ends agree with their neighbours'
tokens. If a chunk has no such place, the stretch grows over the next chunk. The result equals the
tokenizers library's on the whole text.

Null texts count as empty and have no tokens. Ties, repeated rows and further columns don't matter: each
row is encoded by itself. Texts that hold a special token's string are encoded by the library as they are.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dossier.llm.common import pick, small

#: Fixed value: the pre-tokenizer's pattern of this public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same cuts where white space stands alone, without looking ahead, which is faster.
SIMPLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
#: Fixed value: Unicode's White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUNS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Letters, digits and marks that every Unicode version classes alike; runs with others are left to the library.
_USUAL = r"\x21-\x7e\xa1-\xac\xae-\u0233\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u2010-\u2027\u20ac"
USUAL, UNUSUAL = re.compile(rf"[{_USUAL}]+"), re.compile(rf"[^{_USUAL} \n]")
#: A place at which the pre-tokenizer always cuts: before a space that stands between two other characters.
CUT = re.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")
WORDS_KEPT, CHUNKS_KEPT = 500_000, 40_000
CHUNK_BITS, WINDOW = 9, 16


class ByteBPE:
    """encode() gives little-endian unsigned 32-bit ids, equal to the tokenizers library's."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items()}
        self.bytes_of = {i: b for b, i in ranks.items()} | {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.simple = tiktoken.Encoding("simple", pat_str=SIMPLE, mergeable_ranks=ranks, special_tokens={})
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        (self.line_id,) = self.fast.encode_ordinary("\n")
        self.words: dict[str, bytes] = {}
        self.chunks: dict[bytes, tuple[str, bytes, str] | None] = {}

    def by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _runs(self, runs: set[str]) -> None:
        """Learn runs of characters that are not white space, with or without a space before them, and of white space."""
        usual = []
        for run in runs:
            if USUAL.fullmatch(run, 1 if run[0] == " " else 0):
                usual.append(run)
            else:
                self.words[run] = self.by_library(run)
        if usual:  # all in one call, a line for each
            ids = np.array(self.fast.encode_ordinary("\n".join(usual)), "<u4")
            at = np.flatnonzero(ids == self.line_id)
            assert len(at) == len(usual) - 1
            data, ends = ids.tobytes(), [*(at * 4).tolist(), len(ids) * 4]
            start = 0
            for run, end in zip(usual, ends, strict=True):
                self.words[run] = data[start:end]
                start = end + 4

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        joined = "\n".join(texts)
        special = any(s in joined for s in self.special)
        usual = not UNUSUAL.search(joined)
        out = []
        for t in texts:
            if special and any(s in t for s in self.special):
                out.append(self.by_library(t))
            elif usual or not UNUSUAL.search(t):
                lone = not any(pair in t for pair in ("  ", "\n\n", " \n", "\n "))
                out.append(np.array((self.simple if lone else self.fast).encode_ordinary(t), "<u4").tobytes())
            else:
                runs = RUNS.findall(t)
                self._runs(set(runs).difference(self.words))
                out.append(b"".join(map(self.words.__getitem__, runs)))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_by_chunks(self, texts: list[str]) -> list[bytes]:
        """As encode_many, by shared chunks and repaired joins."""
        if len(self.chunks) > CHUNKS_KEPT:
            self.chunks.clear()
        cut = [None if any(s in t for s in self.special) else chunks(t.encode()) for t in texts]
        new = {c for own in cut if own for c in own}.difference(self.chunks)
        bodies = {}
        for c in new:
            text = c.decode()
            first = CUT.search(text)
            last = text.rfind(" ", first.end()) if first else -1
            while last > 0 and not CUT.match(text, last):
                last = text.rfind(" ", first.end(), last)
            if last < 0:
                self.chunks[c] = None  # fewer than two sure places: its tokens depend on what stands around it
            else:
                bodies[c] = (text[: first.start()], text[first.start() : last], text[last:])
        for (c, (head, _, tail)), ids in zip(bodies.items(), self.encode_many([b[1] for b in bodies.values()]), strict=True):
            self.chunks[c] = (head, ids, tail)
        joins: list[str] = []
        plans: list[list[bytes | None]] = []
        for t, own in zip(texts, cut, strict=True):
            plan: list[bytes | None] = []
            if own is None:
                plan.append(self.by_library(t))
            else:
                open_text = ""
                for c in own:
                    if (known := self.chunks[c]) is None:
                        open_text += c.decode()
                    else:
                        joins.append(open_text + known[0])
                        plan += [None, known[1]]
                        open_text = known[2]
                joins.append(open_text)
                plan.append(None)
            plans.append(plan)
        repaired = iter(self.encode_many(joins))
        return [b"".join(next(repaired) if p is None else p for p in plan) for plan in plans]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def chunks(data: bytes) -> list[bytes]:
    """Cut where a rolling hash of the last WINDOW bytes has CHUNK_BITS zeros, never inside a character."""
    if len(data) <= 2 * WINDOW:
        return [data] if data else []
    a = np.frombuffer(data, np.uint8)
    h = a.astype(np.uint32) * np.uint32(0x9E3779B1)
    width = 1
    while width < WINDOW:  # doubles the width of the hashed window
        h = h[:-width] * np.uint32(0x85EBCA6B) + h[width:]
        h ^= h >> np.uint32(15)
        width *= 2
    at = np.flatnonzero((h & np.uint32((1 << CHUNK_BITS) - 1)) == 0) + WINDOW
    at = at[at < len(a)]
    at = at[(a[at] & 0xC0) != 0x80]
    ends = [*at.tolist(), len(data)]
    return [data[s:e] for s, e in zip([0, *ends], ends, strict=False)]


_open: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    """One for each Python worker, kept over its tasks."""
    if path not in _open:
        _open[path] = ByteBPE(path)
    return _open[path]


def grouped(texts: list[str], size: int = 400_000) -> Iterator[list[str]]:
    """Consecutive texts of about size characters together, so that memory stays bounded."""
    own, n = [], 0
    for t in texts:
        own.append(t)
        n += len(t)
        if n >= size:
            yield own
            own, n = [], 0
    if own:
        yield own


def encode_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and the decoded text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in small(batches):
            at = 0
            for texts in grouped([t or "" for t in b.column(1).to_pylist()]):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode_by_chunks(texts)]
                yield pa.record_batch([b.column(0).slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x.tolist()) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])
                at += len(texts)

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_table, but with digests in place of ids and text, which then never leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in small(batches):
            n, ids_sha, text_sha = [], [], []
            for texts in grouped([t or "" for t in b.column(1).to_pylist()]):
                for x in bpe.encode_by_chunks(texts):
                    ids = np.frombuffer(x, "<u4").tolist()
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
