"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once. Byte-level tokens have fixed byte lengths, so the running sum of lengths maps
every token to its span; the spans are joined with the sections' intervals by binary search, and a token that
crosses a boundary is allocated by an explicit rule:

- ``start``: to the section in which its first character lies;
- ``majority``: to the section that holds most of its bytes, ties to the earlier;
- ``split``: in proportion to the bytes in each section (counts are then fractions).

In every rule the counts of a document's sections add up to its token count.

Defined cases: a null or empty text has one empty section without tokens; a null field is left out; sections of
no characters get no tokens (under ``start`` and ``majority`` a token at their place belongs to the next section); repeated
rows are counted one by one; an empty table gives no rows. Texts of any length are encoded whole: runs of white space
of LONG_SPACE characters or more are words of their own for the pattern, and go to the encoder without it, since its
regular expression takes stack in proportion to a run.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.storage import slices

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("start", "majority", "split")
LONG_SPACE = 4096
SPACE_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)


@cache
def _encoder(path: str, pattern: str):
    """The encoding and the byte length of each of its tokens; once for each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    widths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        widths[rank] = len(token)
    return tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), widths


def encode_whole(encoding, text: str, byte_level: bool = True) -> list[int]:
    """Ids of a text of any length.

    The byte-level pattern takes a run of white space as one word, but for its last character where something follows it;
    so long runs are cut out there and encoded by themselves. Other patterns get the text as it is.
    """
    out, at = [], 0
    for run in SPACE_RUN.finditer(text) if byte_level else ():
        stop = run.end() - (run.end() < len(text))
        out += encoding.encode_ordinary(text[at : run.start()])
        out += encoding._core_bpe.encode_single_piece(text[run.start() : stop].encode())
        at = stop
    return out + encoding.encode_ordinary(text[at:])


def allocate(token_ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. token_ends: rising byte ends of tokens; bounds: rising byte bounds of the sections, from 0 to the end."""
    sections = len(bounds) - 1
    starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, token_ends, "left") - 1
    if rule == "start":
        return np.bincount(first, minlength=sections).astype(float)
    counts = np.bincount(first[first == last], minlength=sections).astype(float)
    for a, b, i, j in zip(starts[first != last], token_ends[first != last], first[first != last], last[first != last], strict=True):
        parts = np.minimum(bounds[i + 1 : j + 2], b) - np.maximum(bounds[i : j + 1], a)
        if rule == "majority":
            counts[i + int(parts.argmax())] += 1
        else:
            counts[i : j + 1] += parts / (b - a)
    return counts


def _char_at(raw: bytes) -> np.ndarray:
    """Code points before each byte place, from 0 to len(raw)."""
    data = np.frombuffer(raw, np.uint8)
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def attribute_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    field_cols: tuple[str, ...] = ("text",),
    section_break: str | None = "\n",
    field_break: str = "\n",
    rule: str = "majority",
    vocabulary_path: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Token counts of each section: doc_id, section (from 0), field, start_char, end_char, n_tokens.

    The document is its fields joined by ``field_break``; a section ends after each ``section_break`` (None: the
    fields themselves are the sections). Breaks belong to what stands before them. One row for each section.
    """
    import public_tokenizers

    if rule not in RULES:
        raise ValueError(f"rule is none of {RULES}")
    path, split = vocabulary_path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    names, byte_level = list(field_cols), split == public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, widths = _encoder(path, split)
        for batch in slices(batches, 128):
            out: list[list] = [[], [], [], [], [], []]
            fields = [batch.column(i + 1).to_pylist() for i in range(len(names))]
            for doc_id, *values in zip(batch.column(0).to_pylist(), *fields, strict=True):
                present = [(n, v) for n, v in zip(names, values, strict=True) if v is not None] or [(names[0], "")]
                pieces: list[tuple[str, bytes]] = []
                for k, (name, value) in enumerate(present):
                    whole = value + (field_break if k + 1 < len(present) else "")
                    parts = whole.split(section_break) if section_break else [whole]
                    cut = [p + section_break for p in parts[:-1]] if section_break else []
                    if parts[-1] or not cut:
                        cut.append(parts[-1])
                    pieces += [(name, p.encode()) for p in cut]
                raw = b"".join(p for _, p in pieces)
                ids = np.asarray(encode_whole(encoding, raw.decode(), byte_level), np.int64)
                bounds = np.concatenate([[0], np.cumsum([len(p) for _, p in pieces])])
                counts = allocate(np.cumsum(widths[ids]) if len(ids) else np.zeros(0, np.int64), bounds, rule)
                chars = bounds if raw.isascii() else _char_at(raw)[bounds]
                out[0] += [doc_id] * len(pieces)
                out[1] += range(len(pieces))
                out[2] += [n for n, _ in pieces]
                out[3] += chars[:-1].tolist()
                out[4] += chars[1:].tolist()
                out[5] += counts.tolist()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["doc_id", "section", "field", "start_char", "end_char", "n_tokens"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(f"field_{i}") for i, c in enumerate(names)])
    return slim.mapInArrow(run, "doc_id long, section long, field string, start_char long, end_char long, n_tokens double")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, boundary tokens by majority: one row for each line."""
    return attribute_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
