"""Byte-level BPE over documents: token counts by the whole-token shortcut, and chunk-reusing encoding.

Both operators take the tokenizer file as a parameter.  The driver reads it once and broadcasts its
text, whose size is that of the vocabulary and does not depend on the data.

Cases: null text counts as empty (0 tokens); special strings inside a text become the special token,
as in the library's default; repeated rows each get their own result; an empty table gives none.
Input columns other than the id and the text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricedex.llm.textkernel import _powers, mix, slices

#: Fixed value: the pattern that this tokenizer's pre-tokenizer splits text by.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_ENTRIES = 600_000
CHUNK_BYTES = 1024
CHUNK_LEAST, CHUNK_MOST = 256, 1 << 14
CHUNK_CACHE_BYTES = 24 << 20
WINDOW = 16
_BLANK = regex.compile(r"\s")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return [chr(dict(zip(kept, kept)).get(b, 256 + rest.index(b) if b in rest else b)) for b in range(256)]


class Encoder:
    """Splits texts into pre-tokens and merges these by the ranks of a tokenizer file.

    The file's merge order must be that of its ids, which holds for this family of vocabularies and is
    checked here; then the rank merges of tiktoken give the same tokens several times faster.
    """

    def __init__(self, spec: str):
        import tiktoken

        described = json.loads(spec)
        vocab, merges = described["model"]["vocab"], described["model"]["merges"]
        joined = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if joined != sorted(joined):
            raise ValueError("the tokenizer's merges are not in the order of its ids")
        back = {c: b for b, c in enumerate(byte_letters())}
        self.special = {x["content"]: x["id"] for x in described["added_tokens"]}
        self.raw = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for piece, i in vocab.items():
            if piece not in self.special:
                self.raw[i] = bytes(back[c] for c in piece)
        ranks = {raw: i for i, raw in enumerate(self.raw) if raw}
        for piece, i in self.special.items():
            self.raw[i] = piece.encode()
        self.merge = tiktoken.Encoding("from_file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special_split = regex.compile(
            "(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")"
        ) if self.special else None
        self.split = regex.compile(SPLIT).findall

    def pieces(self, text: str, make: Callable[[list[str]], Any], memo: tuple[dict[str, Any], dict[str, Any]]) -> list[Any]:
        """make() of the pre-tokens of the text's units, each unit being a space and what follows up to the next.

        A unit that ends in no white space ends at a pre-token boundary, since no pre-token holds white
        space after another character; so units are looked up whole.  A text with other units is split
        as a whole.  memo: values of units at a text's start, and of those after a space.
        """
        parts = text.split(" ")
        got = list(map(memo[1].get, parts))
        got[0] = memo[0].get(parts[0])
        if None in got:
            last = len(parts) - 1
            for i, value in enumerate(got):
                if value is None:
                    part = parts[i]
                    whole = part and not _BLANK.match(part[-1])
                    if not whole and i not in (0, last) or i == 0 < last and part and not whole:
                        return [make(self.split(text))]
                    got[i] = value = make(self.split(f" {part}" if i else part))
                    if whole and len(part) <= 48:
                        if len(memo[1]) + len(memo[0]) >= MEMO_ENTRIES:
                            memo[0].clear()
                            memo[1].clear()
                        memo[bool(i)][part] = value
        return got

    def parts(self, text: str) -> list[str]:
        """Text between special strings at even places, special strings at odd ones."""
        return self.special_split.split(text) if self.special_split and any(s in text for s in self.special) else [text]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.parts(text)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out.extend(self.merge(part))
        return out


@lru_cache(maxsize=2)
def encoder(spec: str) -> Encoder:
    return Encoder(spec)


def prove_whole_tokens(spec: str) -> dict[str, int]:
    """Vocabulary strings that the pre-tokenizer keeps in one piece and the merges turn into that one token.

    This is checked for each string with the tokenizer's own merges; strings that are not whole
    characters in UTF-8, or which the merges leave in several tokens, are left out and merged when they occur.
    """
    from tokenizers import Tokenizer

    enc, letters = encoder(spec), byte_letters()
    model = Tokenizer.from_str(spec).model
    proven = {}
    for i, raw in enumerate(enc.raw):
        try:
            piece = raw.decode()
        except UnicodeDecodeError:
            continue
        if piece and piece not in enc.special and enc.split(piece) == [piece] and [
            t.id for t in model.tokenize("".join([letters[b] for b in raw]))
        ] == [i]:
            proven[piece] = i
    return proven


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row's whole text.

    Pre-tokens in the proven whole-token table count 1 without merging; only the others are merged.  Counts
    of whole units of text are kept in the worker's bounded memo.  One map pass, no shuffle.
    """
    sc = docs.sparkSession.sparkContext
    spec = read_spec(tokenizer_path)
    shared = sc.broadcast((spec, frozenset(prove_whole_tokens(spec))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, whole = shared.value
        enc = encoder(spec)
        memo: tuple[dict[str, int], dict[str, int]] = ({}, {})

        def tokens(pieces: list[str]) -> int:
            return sum([1 if piece in whole else len(enc.merge(piece)) for piece in pieces])

        for batch in batches:
            for rows, _, offsets in slices(batch, "text"):
                totals = []
                for text in rows.column(1).to_pylist():
                    total = 0
                    for k, part in enumerate(enc.parts(text or "")):
                        total += 1 if k % 2 else sum(enc.pieces(part, tokens, memo)) if part else 0
                    totals.append(total)
                sizes = np.diff(offsets)
                totals = np.asarray(totals, np.int64)
                yield pa.record_batch(
                    [rows.column(0), pa.array(sizes), pa.array(totals), pa.array(totals > limit)],
                    names=["id", "n_bytes", "n_tokens", "over_limit"]
                )

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(count, "id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)


def chunk_bounds(data: np.ndarray) -> list[int]:
    """Content-defined cut points of one text's bytes, 0 and len included.

    A cut stands where the rolling hash of the WINDOW bytes before it is 0 modulo CHUNK_BYTES, at the
    start of a UTF-8 character, and at least CHUNK_LEAST bytes after the last; chunks end at CHUNK_MOST.
    """
    n = len(data)
    if n <= CHUNK_LEAST:
        return [0, n] if n else [0]
    marks = []
    for base in range(0, n, 1 << 20):
        a, b = max(0, base - WINDOW), min(n, base + (1 << 20))
        if b - a < WINDOW:
            continue
        up, down = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
        rolled = mix((sums[WINDOW:] - sums[:-WINDOW]) * down[: b - a - WINDOW + 1])
        marks.append(np.flatnonzero((rolled & np.uint64(CHUNK_BYTES - 1)) == 0) + a + WINDOW)
    cuts, last = [0], 0
    head = lambda i: i < n and data[i] & 0xC0 == 0x80
    for mark in [*np.concatenate(marks).tolist(), n] if marks else [n]:
        while mark - last > CHUNK_MOST:
            last += CHUNK_MOST
            while head(last):
                last += 1
            cuts.append(last)
        if mark - last >= CHUNK_LEAST and mark < n and not head(mark):
            cuts.append(mark)
            last = mark
    if cuts[-1] < n:
        cuts.append(n)
    return cuts


#: A place before white space and after a letter, digit or punctuation: no pre-token holds such a pair,
#: so every encoding of a text has a token boundary there, whatever stands around it.
_AGREED = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])[ \n]")


class ChunkEncoder:
    """Encodes each distinct chunk's inside once while it stays in the cache, and the joins between chunks each time."""

    def __init__(self, enc: Encoder):
        self.enc, self.cache, self.bytes = enc, {}, 0
        self.hits = self.misses = 0

    def chunk(self, raw: bytes) -> tuple[str, list[int] | None, str]:
        """(head, ids of the inside, tail); ids are None if encodings can't agree anywhere in the chunk."""
        got = self.cache.get(raw)
        if got is not None:
            self.hits += 1
            return got
        self.misses += 1
        text = raw.decode()
        if first := _AGREED.search(text):
            a = first.start()
            b = max(text.rfind(" "), text.rfind("\n"))
            while b > a and not _AGREED.match(text, b):
                b = max(text.rfind(" ", a, b), text.rfind("\n", a, b))
            got = text[:a], self.enc.encode(text[a:b]), text[b:]
        else:
            got = text, None, ""
        if self.bytes + len(raw) > CHUNK_CACHE_BYTES:
            self.cache.clear()
            self.bytes = 0
        self.cache[raw] = got
        self.bytes += len(raw)
        return got

    def encode(self, data: np.ndarray) -> list[int]:
        """Ids of a whole text.

        The end of one chunk and the start of the next are encoded together, and joined with further
        chunks until a place is reached where this encoding and the chunk's own must agree.
        """
        cuts, raw = chunk_bounds(data), data.tobytes()
        out: list[int] = []
        pending: list[str] = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            head, inside, tail = self.chunk(raw[a:b])
            pending.append(head)
            if inside is not None:
                out.extend(self.enc.encode("".join(pending)))
                out.extend(inside)
                pending = [tail]
        if pending:
            out.extend(self.enc.encode("".join(pending)))
        return out


_WORKER_CHUNKS: dict[str, ChunkEncoder] = {}


def worker_chunks(key: str, spec: Any) -> ChunkEncoder:
    """The encoder of this worker process, with the chunks it has seen so far; one tokenizer at a time."""
    if key not in _WORKER_CHUNKS:
        _WORKER_CHUNKS.clear()
        _WORKER_CHUNKS[key] = ChunkEncoder(encoder(spec))
    return _WORKER_CHUNKS[key]


def encode_decode(
    docs: DataFrame, tokenizer_path: str, digest: Callable[[list[int], bytes], dict[str, Any]] | None = None,
    schema: str = "n_tokens bigint, ids array<int>, decoded string", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id and what `digest` makes of each row's token ids and decoded bytes (by default both themselves).

    Chunks are content-defined, so documents that share passages share chunks.  A Python worker keeps its chunks in a
    bounded cache over all tasks that it runs and encodes each once while it stays there.  One map pass, no shuffle.
    Long texts are cut and encoded like others; ties of equal merges are resolved by rank, as the library does.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    make = digest or (lambda ids, raw: {"n_tokens": len(ids), "ids": ids, "decoded": raw.decode(errors="replace")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = worker_chunks(tokenizer_path, shared.value)
        enc = chunks.enc
        raw_of = enc.raw.__getitem__
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                made = []
                for a, b in zip(offsets[:-1], offsets[1:]):
                    ids = chunks.encode(data[a:b])
                    made.append(make(ids, b"".join(map(raw_of, ids))))
                columns = {k: [m[k] for m in made] for k in made[0]}
                yield pa.record_batch(
                    [rows.column(0), *(pa.array(v, types.field(k).type) for k, v in columns.items())], names=["id", *columns]
                )

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType.fromDDL(schema))
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id bigint, {schema}").withColumnRenamed("id", id_col)


_DECIMAL = [str(i) for i in range(1 << 16)]


def sha_digest(ids: list[int], raw: bytes) -> dict[str, Any]:
    """Digests of the ids in decimal, joined by commas, and of the decoded text in UTF-8."""
    listed = ",".join(map(_DECIMAL.__getitem__, ids) if max(ids, default=0) < len(_DECIMAL) else map(str, ids))
    try:
        raw.decode()
    except UnicodeDecodeError:
        raw = raw.decode(errors="replace").encode()
    return {
        "n_tokens": len(ids), "ids_sha256": hashlib.sha256(listed.encode()).hexdigest(), "decoded_sha256": hashlib.sha256(raw).hexdigest()
    }
