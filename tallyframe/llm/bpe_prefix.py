"""Exact BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that can stand last in its BPE encoding. So the encoder
walks the word once; at each place the suffix-matching automaton over the vocabulary (pyahocorasick) gives the
tokens that end there, longest first, and the first one that is compatible with the last token of the prefix
before it is stored. Following the stored tokens back from the end gives the ids. Two tokens are compatible if
encoding their joined text gives these two again; that is decided by undoing merges at the seam.

Words come from the byte-level pre-tokenizer pattern. Which code points are letters, numbers and white space is asked of
the library's own pre-tokenizer (once, on the driver), since Unicode tables differ between versions. Repeated chunks and
words are answered from bounded caches (cleared when full; they change no result). Strings of added special tokens in a
text become their ids, as in the tokenizers library.

Defined cases: null text is the empty text: no ids, and the hash of the empty string twice; repeated rows give equal rows;
a run of any length without a space is one word, encoded in time and memory in proportion to it; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.storage import claim_cache, slices

VOCABULARY = "byte_bpe_50k.json"
CACHED = 400_000
CACHED_CHUNKS = 600_000
#: Fixed value: the byte-level pattern, with places for the classes of letters (L), numbers (N) and white space (S).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"


def _ranges(points: list[int]) -> str:
    """The body of a character class that holds these rising code points."""
    out, first = [], 0
    for i in range(1, len(points) + 1):
        if i == len(points) or points[i] != points[i - 1] + 1:
            out.append(f"\\U{points[first]:08x}-\\U{points[i - 1]:08x}")
            first = i
    return "".join(out)


@cache
def character_classes() -> dict[str, str]:
    """Letters, numbers and white space as the library's pre-tokenizer has them.

    A character belongs to a class if it stays in one word with a known member before it; what joins none of them is white
    space. Blocks whose characters all belong to one class are settled by one question.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    words = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    members = {"L": "a", "N": "1", "other": "!"}
    found: dict[str, list[int]] = {"L": [], "N": [], "other": [], "S": []}
    for low in [*range(0, 0xD800, 256), *range(0xE000, 0x110000, 256)]:
        block = range(low, low + 256)
        whole = next((k for k, m in members.items() if len(words(m + "".join(map(chr, block)))) == 1), None)
        for c in block:
            found[whole or next((k for k, m in members.items() if len(words(m + chr(c))) == 1), "S")].append(c)
    return {k: _ranges(found[k]) for k in "LNS"}


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class PrefixBpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, classes: dict[str, str] | None = None) -> None:
        classes = classes or character_classes()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        ids = self.vocab
        #: (left, right) -> (rank, merged id), and each merged token's two halves.
        self.merge = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for (a, b), (rank, made) in self.merge.items():
            if made not in self.halves:
                self.halves[made], self.rank[made] = (a, b), rank
        letters = byte_alphabet()
        self.letters = {b: c for b, c in enumerate(letters)}
        back = {c: b for b, c in enumerate(letters)}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in ids.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.fits: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[str, bytes, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            if token not in self.added and self.stable(i):
                self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        self.word = re.compile(PATTERN.format(**classes))
        #: Runs of words without space between them; a word never crosses these bounds.
        self.chunk = re.compile(" ?[^{S}]+|[{S}]+(?![^{S}])|[{S}]+".format(**classes))
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def stable(self, token: int) -> bool:
        """Whether merging a token's own bytes by rank gives the token; others never occur in an encoding."""
        ids = [self.vocab[self.letters[b]] for b in self.bytes_of[token]]
        merge = self.merge
        while len(ids) > 1:
            ranked = [(merge[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merge]
            if not ranked:
                break
            _, i = min(ranked)
            ids[i : i + 2] = [merge[ids[i], ids[i + 1]][1]]
        return ids == [token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' joined text is just these two tokens."""
        if len(self.fits) >= CACHED:
            self.fits.clear()
        holds = self.fits[left << 32 | right] = self._seam_holds(left, right)
        return holds

    def _seam_holds(self, a: int, b: int) -> bool:
        """Undo the later of both tokens' merges, again and again: no merge over the seam may come before them.

        ``limit`` is the rank of the merge undone last. A pair over the seam would have merged if its rank is
        below that (or equal, for the leftmost of equal pairs, which is then on the left).
        """
        limit, left_undone = 1 << 60, True
        while True:
            made = self.merge.get((a, b))
            if made is not None and (made[0] < limit or made[0] == limit and not left_undone):
                return False
            rank_a, rank_b = self.rank.get(a, -1), self.rank.get(b, -1)
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                limit, left_undone = rank_a, True
                a = self.halves[a][1]
            else:
                limit, left_undone = rank_b, False
                b = self.halves[b][0]

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token: forward pass that stores each prefix's last token, then back-pointers."""
        letters, fits = self.letters, self.fits
        text = "".join([letters[b] for b in word.encode()])
        size = len(text)
        last, width = [-1] * (size + 1), [0] * (size + 1)
        done = -1
        for end, (n, token) in self.automaton.iter(text):
            if end == done:
                continue
            start = end + 1 - n
            if start:
                before = last[start]
                if before < 0:
                    continue
                holds = fits.get(before << 32 | token)
                if not (self.compatible(before, token) if holds is None else holds):
                    continue
            last[end + 1], width[end + 1] = token, n
            done = end
        ids, pos = [], size
        while pos:
            ids.append(last[pos])
            pos -= width[pos]
        return tuple(ids[::-1])

    def _chunk(self, chunk: str) -> tuple[str, bytes, int]:
        ids: list[int] = []
        for word in self.word.findall(chunk):
            got = self.words.get(word)
            if got is None:
                got = self.encode_word(word)
                if len(word) <= 64:
                    if len(self.words) >= CACHED:
                        self.words.clear()
                    self.words[word] = got
            ids += got
        made = (",".join(map(str, ids)), self.decode_bytes(ids), len(ids))
        if len(chunk) <= 64:
            if len(self.chunks) >= CACHED_CHUNKS:
                self.chunks.clear()
            self.chunks[chunk] = made
        return made

    def parts(self, text: str) -> Iterator[tuple[str, bytes, int]]:
        """(ids as decimal text, the bytes of these ids, their number) of each chunk."""
        pieces = self.special.split(text) if self.special and any(s in text for s in self.added) else [text]
        for piece in pieces:
            if piece in self.added:
                yield str(self.added[piece]), piece.encode(), 1
                continue
            known, make = self.chunks.get, self._chunk
            for chunk in self.chunk.findall(piece):
                yield known(chunk) or make(chunk)

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.parts(text) for i in ids.split(",") if i]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, PrefixBpe] = {}


def load(path: str, classes: dict[str, str]) -> PrefixBpe:
    """One encoder for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PrefixBpe(path, classes)
    return _LOADED[path]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """doc_id and the ids of each whole text."""
    import public_tokenizers

    path, classes = vocabulary_path or public_tokenizers.path(VOCABULARY), character_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache(("bpe", path), _LOADED.clear)
        bpe = load(path, classes)
        for batch in slices(batches, 128):
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary_path: str | None = None) -> DataFrame:
    """doc_id and the text of each id list; null ids give the empty text."""
    import public_tokenizers

    path, classes = vocabulary_path or public_tokenizers.path(VOCABULARY), character_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache(("bpe", path), _LOADED.clear)
        bpe = load(path, classes)
        for batch in slices(batches, 128):
            texts = [bpe.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digest_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """Encode, decode the ids, and return doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    import public_tokenizers

    path, classes = vocabulary_path or public_tokenizers.path(VOCABULARY), character_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache(("bpe", path), _LOADED.clear)
        bpe = load(path, classes)
        for batch in slices(batches, 128):
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                got = list(bpe.parts(text or ""))
                counts.append(sum([n for _, _, n in got]))
                ids_sha.append(hashlib.sha256(",".join([i for i, _, _ in got]).encode()).hexdigest())
                decoded = b"".join([b for _, b, _ in got])
                text_sha.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_prefix(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the byte-level vocabulary: one row each."""
    return digest_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
