"""Byte-level BPE, encoded in fragments between certain cuts.

A cut is certain where the byte pair around it occurs inside no vocabulary token: no merge can ever span it. The
pre-tokenizer's pattern must be left undisturbed as well, so a cut is taken only where both bytes' classes tell that the
pattern either ends a match there or would go on alike from there: before white space that follows something else, and
between ASCII letters, digits and punctuation (but not behind an apostrophe, which may begin a contraction). Every text is
cut at all such places, whatever its length or alphabet. A batch's fragments are told apart by a dictionary, each distinct
one is encoded by itself, and the ids are concatenated by index.

Defined cases: null counts as the empty text (no ids); a text without any cut is one fragment; the string of a
special token in a text gives that token's id, as the tokenizers library does by default; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import cached_property
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Remembered fragments; only those of up to REMEMBERED bytes are.
MEMORY, REMEMBERED = 1 << 18, 64
#: Bytes in which cuts are searched at a time; the fragments that end there are told apart and encoded before the next ones.
STRIDE = 1 << 20
#: Bytes of texts, but one text at least, whose ids a task holds at a time.
PORTION = 1 << 22
#: Bytes of a fragment from which on the library without a bound on its pattern's stack encodes it; ids are the same.
LONG = 1 << 16
# The public split pattern of this byte-level vocabulary and its contractions.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = (b"'s", b"'d", b"'m", b"'t", b"'ll", b"'ve", b"'re")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def cut_table(tokens: list[bytes]) -> np.ndarray:
    """table[256 * a + b]: between byte a and byte b lies a certain boundary."""
    inside = np.zeros((256, 256), dtype=bool)
    for raw in (*tokens, *CONTRACTIONS):
        b = np.frombuffer(raw, dtype=np.uint8)
        inside[b[:-1], b[1:]] = True
    byte = np.arange(256)
    space = np.isin(byte, [0x20, *range(0x09, 0x0E)])
    # Last bytes of white space of any alphabet: none of these ends a word for certain.
    blank = np.isin(byte, [chr(c).encode()[-1] for c in range(0x110000) if chr(c).isspace()])
    kind = np.array([1 if chr(c).isalnum() else 2 if 0x20 < c < 0x7F else 0 for c in range(128)] + [0] * 128)
    alike = (kind[:, None] > 0) & (kind[None, :] > 0) & (byte != ord("'"))[:, None] & ((kind == 1)[:, None] | (byte != ord("'"))[None, :])
    return (~inside & ((~blank[:, None] & space[None, :]) | alike)).ravel()


class Encoded(NamedTuple):
    ids: np.ndarray  # of all rows, one after the other
    start: np.ndarray  # of each row's ids, and the end
    fragments: np.ndarray  # of each row


class FragmentCodec:
    def __init__(self, path: str, stride: int = STRIDE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        tokens = {i: bytes(alphabet[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        tokens |= {a["id"]: a["content"].encode() for a in spec["added_tokens"]}
        self.size = max(tokens) + 1
        #: Bytes, and decimal form with a comma, by id.
        self.pieces = pa.array([tokens.get(i, b"") for i in range(self.size)], pa.binary())
        self.decimal = pa.array([b"%d," % i for i in range(self.size)], pa.binary())
        self.cut = cut_table(list(tokens.values()))
        self.special = tuple(a["content"] for a in spec["added_tokens"])
        ranks = {raw: i for i, raw in tokens.items() if raw.decode("utf-8", "replace") not in self.special}
        self.short = tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.stride = stride
        self.memory: dict[bytes, list[int]] = {}

    @cached_property
    def tokenizer(self):
        """The tokenizers library's form, loaded only where a fragment needs it."""
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def edges(self, data: np.ndarray, rows: np.ndarray):
        """Where fragments begin in the bytes of rows (their offsets, the end included): at each row and each certain cut.

        One array a stride; its last edge ends its last fragment and is the next one's first.
        """
        begin, stop = int(rows[0]), int(rows[-1])
        for at in range(begin, stop, self.stride):
            end = min(at + self.stride, stop)
            b = data[at : end + (end < stop)].astype(np.uint16)
            mark = np.zeros(end - at + 1, dtype=bool)
            mark[1 : len(b)] = self.cut[b[:-1] << 8 | b[1:]]
            mark[rows[np.searchsorted(rows, at, "right") : np.searchsorted(rows, end, "right")] - at] = True
            own = np.flatnonzero(mark) + at
            if len(own):
                yield np.concatenate([[begin], own])
                begin = int(own[-1])

    def encode_fragment(self, raw: bytes) -> list[int]:
        text = raw.decode()
        if len(raw) > LONG or any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.short(text)

    def distinct(self, fragments: list[bytes]) -> list[list[int]]:
        """The ids of each fragment, every one encoded by itself unless it is remembered."""
        memory = self.memory
        if len(memory) > MEMORY:
            memory.clear()
        out = [memory.get(f) for f in fragments]
        for k, ids in enumerate(out):
            if ids is None:
                raw = fragments[k]
                out[k] = ids = self.encode_fragment(raw)
                if len(raw) <= REMEMBERED:
                    memory[raw] = ids
        return out

    def encode_column(self, texts: pa.Array) -> Encoded:
        """Ids of all rows of a column of strings."""
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        rows = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        if not n or rows[0] == rows[-1]:
            return Encoded(np.empty(0, np.int32), np.zeros(n + 1, np.int64), np.zeros(n, np.int64))
        data = texts.buffers()[2]
        ids, tokens, fragments = [], np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)  # the latter: how many there are before each row
        n_ids = n_fragments = 0
        for edges in self.edges(np.frombuffer(data, dtype=np.uint8), rows):
            found = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), data]).dictionary_encode()
            encoded = self.distinct(found.dictionary.to_pylist())
            size = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
            flat = np.fromiter(chain.from_iterable(encoded), dtype=np.int32, count=int(size.sum()))
            which = found.indices.to_numpy()
            length = size[which]
            after = np.cumsum(length)
            shift = (np.cumsum(size) - size)[which] - (after - length)
            ids.append(flat[np.repeat(shift, length) + np.arange(int(after[-1]))])
            own = slice(*np.searchsorted(rows, [edges[0], edges[-1]]))
            place = np.searchsorted(edges, rows[own])
            tokens[own], fragments[own] = n_ids + (after - length)[place], n_fragments + place
            n_ids, n_fragments = n_ids + int(after[-1]), n_fragments + len(length)
        rest = slice(np.searchsorted(rows, rows[-1]), None)
        tokens[rest], fragments[rest] = n_ids, n_fragments
        return Encoded(np.concatenate(ids), tokens, np.diff(fragments))

    def encode(self, text: str | None) -> list[int]:
        return self.encode_column(pa.array([text], pa.string())).ids.tolist()

    def fragments(self, raw: bytes) -> list[bytes]:
        found = self.edges(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
        return [raw[a:b] for edges in found for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]

    def decode(self, ids) -> str:
        return b"".join(self.pieces.take(pa.array(ids, pa.int32())).to_pylist()).decode("utf-8", "replace")


_codecs: dict[str, FragmentCodec] = {}


def codec(path: str) -> FragmentCodec:
    """One codec a worker process."""
    if path not in _codecs:
        _codecs[path] = FragmentCodec(path)
    return _codecs[path]


def portions(batch: pa.RecordBatch, column: int, most: int = PORTION):
    """The batch's rows in turn, as many at a time as have up to `most` bytes in a column of strings; a longer text comes alone."""
    texts = batch.column(column)
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, done + most, "right")))
        yield batch.slice(at, end - at)
        at, done = end, int(size[end - 1])


def spelled(forms: pa.Array, encoded: Encoded):
    """For each row the forms of its ids, joined."""
    for a, b in zip(encoded.start.tolist(), encoded.start[1:].tolist(), strict=False):
        taken = forms.take(pa.array(encoded.ids[a:b]))
        offsets = np.frombuffer(taken.buffers()[1], dtype=np.int32)
        yield bytes(taken.buffers()[2][: int(offsets[len(taken)])]) if len(taken) else b""


def encode_decode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Ids of every text and the text decoded from them, as counts and SHA-256, and into how many fragments it was cut; with_ids adds both in full.

    One row per input row, repeated rows included; a null id stays null.
    """
    path = tokenizer or default_tokenizer()
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_fragments bigint" + ", ids array<int>, decoded string" * with_ids
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        c = codec(path)
        for batch in chain.from_iterable(portions(b, 1) for b in batches):
            e = c.encode_column(batch.column(1))
            ids_sha256 = [hashlib.sha256(raw[:-1]).hexdigest() for raw in spelled(c.decimal, e)]
            decoded = [raw.decode("utf-8", "replace") for raw in spelled(c.pieces, e)]
            columns = [batch.column(0), pa.array(np.diff(e.start)), pa.array(ids_sha256, pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()), pa.array(e.fragments)]
            if with_ids:
                columns += [pa.array([e.ids[a:b].tolist() for a, b in zip(e.start, e.start[1:], strict=False)], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
