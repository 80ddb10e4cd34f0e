"""Fill-in-middle documents by piece tables: descriptors over an immutable text and its sentinels are cut, permuted and put back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Parts of a document in its own order, and the order in which each form shows them.
PREFIX, MIDDLE, SUFFIX = range(3)
SHOWN = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: The buffer of each part's sentinel; buffer 0 is the text.
TEXT, MARK = 0, {PREFIX: 1, SUFFIX: 2, MIDDLE: 3}


class Piece(NamedTuple):
    """Bytes ``start`` to ``stop`` of a buffer."""

    buffer: int
    start: int
    stop: int


def split(pieces: Sequence[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The descriptors of the first ``at`` bytes and those of the rest; one across the cut becomes two."""
    before: list[Piece] = []
    for i, p in enumerate(pieces):
        size = p.stop - p.start
        if at < size:
            middle = p.start + at
            return before + [Piece(p.buffer, p.start, middle)] * (at > 0), [Piece(p.buffer, middle, p.stop), *pieces[i + 1 :]]
        before.append(p)
        at -= size
    if at:
        raise ValueError(f"a cut {at} bytes behind the end")
    return before, []


def arranged(parts: Sequence[Sequence[Piece]], form: str, buffers: Sequence[bytes]) -> list[Piece]:
    """Prefix, middle and suffix in the order of ``form``, each behind its sentinel."""
    out: list[Piece] = []
    for part in SHOWN[form]:
        out += [Piece(MARK[part], 0, len(buffers[MARK[part]])), *parts[part]]
    return out


def restored(output: bytes, form: str, sentinels: Sequence[bytes]) -> list[Piece]:
    """Descriptors over ``output`` (its buffer 0) of the text it was made from, by the output and its form alone.

    A text that holds a sentinel stays plain, so each sentinel lies where it first
    occurs: the output is cut there and the parts return to the places they came from.
    """
    rest, here = [Piece(TEXT, 0, len(output))], 0
    if form == "plain":
        return rest
    parts: list[list[Piece]] = [[], [], []]
    for i, part in enumerate(SHOWN[form]):
        mark = sentinels[MARK[part] - 1]
        if output[here : here + len(mark)] != mark:
            raise ValueError(f"no {mark!r} at byte {here}")
        _, rest = split(rest, len(mark))
        start = here + len(mark)
        here = output.index(sentinels[MARK[SHOWN[form][i + 1]] - 1], start) if i < 2 else len(output)
        parts[part], rest = split(rest, here - start)
    return [p for part in parts for p in part]


def contents(pieces: Iterable[Piece], buffers: Sequence[bytes]) -> Iterator[memoryview]:
    for p in pieces:
        yield memoryview(buffers[p.buffer])[p.start : p.stop]


def sha256(pieces: Iterable[Piece], buffers: Sequence[bytes]) -> str:
    """Hex digest of what the descriptors stand for, fed stretch by stretch."""
    digest = hashlib.sha256()
    for stretch in contents(pieces, buffers):
        digest.update(stretch)
    return digest.hexdigest()


def code_points(pieces: Iterable[Piece], buffers: Sequence[bytes]) -> int:
    return sum(int(np.count_nonzero((np.frombuffer(s, np.uint8) & 0xC0) != 0x80)) for s in contents(pieces, buffers))


def line_ends(text: bytes) -> np.ndarray:
    """Offsets behind each line; the last one need not end in a line feed."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x0A) + 1
    return np.append(ends, len(text)) if text and text[-1] != 0x0A else ends


def fill_in_middle(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, sentinels: Sequence[str] = SENTINELS, with_output: bool = True) -> DataFrame:
    """Documents with a middle part of whole lines moved to the end, for fill-in-middle training.

    The first four 32-bit numbers h1 to h4 of sha256(``seed:doc_id``) decide: the prefix
    ends after min and the middle after max of h1 and h2 modulo lines + 1; the form is
    plain for ``h3 % 100 >= fim_percent``, else spm for ``h4 % 100 < spm_percent``, else
    psm. Every text is a piece table, so arranging it copies nothing; the output's bytes
    are put together once, and the restored text is read from them.

    Returns doc_id, n (lines), form, prefix_chars, middle_chars (code points; null if
    plain), output_sha256, restored_sha256 and, with ``with_output``, the output. A null
    text counts as empty; an empty text, or one that holds a sentinel, stays plain; a
    null doc_id hashes as ``seed:``; rows of equal doc_id are cut by the same numbers,
    each in its own lines; an empty table gives no rows; other columns aren't read. It is
    one pass without a shuffle; a task holds one text and its output at a time.
    """
    marks = [s.encode() for s in sentinels]

    def form_of(text: bytes, h3: int, h4: int) -> str:
        if not text or any(m in text for m in marks) or h3 % 100 >= fim_percent:
            return "plain"
        return "spm" if h4 % 100 < spm_percent else "psm"

    def row(doc_id: int | None, text: bytes) -> tuple:
        key = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(key[8 * i : 8 * i + 8], 16) for i in range(4))
        buffers, ends, form = [text, *marks], line_ends(text), form_of(text, h3, h4)
        n, shown, sizes = len(ends), [Piece(TEXT, 0, len(text))], (None, None)
        if form != "plain":
            first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
            offset = [0, *ends.tolist()]
            before, suffix = split(shown, offset[last])
            parts = [*split(before, offset[first]), suffix]
            sizes = tuple(code_points(p, buffers) for p in parts[:2])
            shown = arranged(parts, form, buffers)
        output = b"".join(contents(shown, buffers))
        told = (doc_id, n, form, *sizes, sha256(shown, buffers), sha256(restored(output, form, marks), [output]))
        return (*told, output.decode()) if with_output else told

    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output_sha256": pa.string(), "restored_sha256": pa.string()}
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    if with_output:
        kinds, schema = kinds | {"output": pa.string()}, f"{schema}, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(d.as_py(), t.as_py()) for d, t in zip(batch.column(0), batch.column(1))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, schema)


def restore_documents(made: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """(doc_id, text) of documents as fill_in_middle returned them, from doc_id, form and output; an output that doesn't fit its form is an error."""
    marks = [s.encode() for s in sentinels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for form, output in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                texts.append(b"".join(contents(restored(output, form, marks), [output])).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return made.select("doc_id", "form", F.col("output").cast("binary").alias("output")).mapInArrow(run, "doc_id long, text string")
