"""Encoding and decoding with public tokenizers, over Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("SIEVEWORK_TOKENIZERS", "/opt/tokenizers")
BLOCK = 1 << 18  # characters after which a long text is cut, at a place no token can span
_loaded: dict[str, object] = {}


def load(path: str):
    """The tokenizer of ``path``, once a process; strings of special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def byte_table() -> dict[int, str]:
    """Byte-level BPE's character for each byte: printable Latin-1 stays, the rest moves up from U+0100 in order."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def blocks(text: str, size: int = BLOCK) -> list[str]:
    """``text`` in blocks whose encodings concatenate to that of the whole text.

    Byte-level pre-tokenization never joins a letter or digit to what follows a single space, so a cut between a letter or
    digit and a lone space before another letter or digit changes nothing. A stretch without such a place stays whole.
    """
    out, start = [], 0
    while len(text) - start > size:
        at = start + size
        while at < len(text) - 1 and not (text[at] == " " and text[at - 1].isalnum() and text[at + 1].isalnum()):
            at += 1
        if at >= len(text) - 1:
            break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


def encode_batch(tok, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and where each text's ids begin (one more entry than texts). Null texts have no ids."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        if t:
            b = [t] if len(t) <= BLOCK else blocks(t)
            parts += b
            owner += [i] * len(b)
    encoded = tok.encode_batch_fast(parts, add_special_tokens=False) if parts else []
    ids = [np.array(e.ids, np.int32) for e in encoded]
    n = np.zeros(len(texts) + 1, np.int64)
    np.add.at(n, np.array(owner, np.int64) + 1, np.array([len(x) for x in ids], np.int64)) if ids else None
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.cumsum(n)


def _encode(path: str, id_name: str, text_name: str, counts_only: bool, step: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, step):  # few texts at a time bound a worker's memory
                rb = whole.slice(at, step)
                flat, offsets = encode_batch(tok, rb.column(text_name).to_pylist())
                rest = [rb.column(i) for i, f in enumerate(rb.schema) if f.name != text_name]
                names = [f.name for f in rb.schema if f.name != text_name]
                got = pa.array(np.diff(offsets)) if counts_only else pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*rest, got], [*names, "n_tokens" if counts_only else "ids"])

    return run


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", directory: str | None = None) -> DataFrame:
    """``id_col`` and ``ids``, the token ids of each whole text without special tokens.

    Null and empty texts have an empty list. Every row comes out once, repeated rows as often as they come in; a null id
    stays null. An empty table gives no rows. Other columns are dropped.
    """
    path = os.path.join(directory or TOKENIZER_DIR, tokenizer)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(_encode(path, "id", "text", False), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", directory: str | None = None) -> DataFrame:
    """``df`` with ``n_tokens`` (0 for null and empty texts) in place of ``text_col``."""
    path = os.path.join(directory or TOKENIZER_DIR, tokenizer)
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text_col)
    return df.mapInArrow(_encode(path, "", text_col, True), f"{rest}, n_tokens bigint")


def offsets(text: str, tokenizer: str = "byte_bpe_50k.json", directory: str | None = None) -> list[tuple[int, int]]:
    """The character span of each token; a character split over several tokens belongs to each of them."""
    return load(os.path.join(directory or TOKENIZER_DIR, tokenizer)).encode(text, add_special_tokens=False).offsets if text else []


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        back = {c: b for b, c in byte_table().items()}
        pieces: dict[int, bytes] = {}
        for rb in batches:
            out = []
            for ids in rb.column("ids").to_pylist():
                if ids is None:
                    out.append(None)
                    continue
                for i in ids:
                    if i not in pieces:
                        pieces[i] = bytes(back[c] for c in tok.id_to_token(i))
                # Bytes are joined before they are read as UTF-8, so characters split over tokens come out whole.
                out.append(b"".join(map(pieces.__getitem__, ids)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([rb.column("id"), pa.array(out, pa.string())], ["id", "text"])

    return run


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = "byte_bpe_50k.json", directory: str | None = None) -> DataFrame:
    """``id_col`` and ``text`` of lists of ids: the byte table reversed. Null lists give null, empty lists an empty text."""
    path = os.path.join(directory or TOKENIZER_DIR, tokenizer)
    src = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return src.mapInArrow(_decode(path), f"id {src.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
