"""BPE encoding and decoding with a published vocabulary; nothing is trained.

A piece of text is a doubly linked list of symbols and a priority queue of the
ranks of its neighbouring pairs.  The lowest rank, leftmost first, is merged, its two new
neighbours enter the queue, and entries whose symbols have changed meanwhile
are skipped when they come up.  Decoding joins the vocabulary's strings.

Pieces do not reach over white space, so the ids of a word between white space are
kept for the next time it comes up, in a table of bounded size; very long words are not kept.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm._spark import doc_text, pieces, table

# What the vocabulary's own pattern calls white space.
_SPACE = "\t-\r \x85\xa0  -     　"
_RUN = regex.compile(f"[{_SPACE}]+")
_ODD_SPACE = regex.compile("[\x1c-\x1f]")  # white space to str.split(), not to the vocabulary
KNOWN, LONGEST = 150_000, 64


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Recent:
    """The last ``size`` to twice ``size`` keys of up to ``LONGEST`` characters that were put or found."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(key) > LONGEST:
            return
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Codec:
    """Encoder and decoder of a tokenizer file with NFC, white space, lower-case, pattern and byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for text, number in [*self.vocab.items(), *self.special.items()]:
            self.strings[number] = text
        suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.first = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + suffix] for x in letters]
        pairs = (x.split(" ") if isinstance(x, str) else x for x in model["merges"])
        pairs = list(pairs)
        self.ranks = {self.vocab[a] << 20 | self.vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.whole = [self.vocab[a + b] for a, b in pairs]
        steps = {x["type"]: x for x in spec["pre_tokenizer"]["pretokenizers"]}
        pattern = steps["Split"]["pattern"]["Regex"].replace("[^\\s", f"[^{_SPACE}")
        self.pattern = regex.compile(pattern)
        self.marked = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words, self.pieces = Recent(KNOWN), Recent(KNOWN)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece.  Queue entries are rank and position in one whole number."""
        symbols = [self.first[b] for b in piece]
        symbols[-1] = self.last[piece[-1]]
        n = len(symbols)
        rank, whole = self.ranks.get, self.whole
        queue = [r << 32 | i for i in range(n - 1) if (r := rank(symbols[i] << 20 | symbols[i + 1])) is not None]
        if not queue:
            return symbols
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            j, left = after[i], symbols[i]
            if left < 0 or j < 0 or rank(left << 20 | symbols[j]) != entry >> 32:
                continue  # stale: one of the two has merged with another since
            symbols[i] = made = whole[entry >> 32]
            symbols[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank(made << 20 | symbols[k])) is not None:
                    push(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] << 20 | made)) is not None:
                push(queue, r << 32 | h)
        return [x for x in symbols if x >= 0]

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = self._ids(piece)
            self.pieces.put(piece, found)
        return found

    def _ids(self, piece: str) -> bytes:
        return np.array(self.merge(piece.encode("utf-8")), "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            parts = self.pattern.findall(word)
            found = b"".join(map(self._piece, parts)) if len(parts) > 1 else b"".join(map(self._ids, parts))
            self.words.put(word, found)
        return found

    def _plain(self, text: str) -> bytes:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        words = [x for x in _RUN.split(text) if x] if _ODD_SPACE.search(text) else text.split()
        if "Σ" in text:  # letter by letter where lower() looks at a letter's neighbours
            words = ["".join(map(str.lower, w)) for w in words]
        elif words:
            words = " ".join(words).lower().split(" ")
        make = self._word
        return b"".join([make(w) for w in words])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, as little-endian unsigned 32-bit integers.  Special tokens in the text are their ids."""
        if not self.marked or "<|" not in text and not self.marked.search(text):
            return np.frombuffer(self._plain(text), "<u4")
        out, at = [], 0
        for found in self.marked.finditer(text):
            out += [self._plain(text[at : found.start()]), np.array([self.special[found[0]]], "<u4").tobytes()]
            at = found.end()
        return np.frombuffer(b"".join([*out, self._plain(text[at:])]), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary's strings, joined by spaces, as there is no decoder in the file; special tokens are kept."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for part in pieces(batch, "text"):
            yield part.column(0), [x.decode("utf-8", "replace") for x in part.column(1).to_pylist()]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids array<int>)`` of every row's whole text; null and empty texts have no ids.

    ``path`` names the tokenizer's file, which every executor can read.  Rows are
    independent of each other: repeated rows have equal results, an empty table an
    empty one, and other columns are not read.
    """

    def run(batches):
        for ids, texts in _texts(batches):
            found = [codec(path).encode(x).astype(np.int32) for x in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    return doc_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of rows of ``(doc_id, ids)``; null ids are an empty text."""

    def run(batches):
        for batch in batches:
            texts = [codec(path).decode(np.array(x or [], "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: digests of the encoded ids and of their decoded text."""

    def run(batches):
        for ids, texts in _texts(batches):
            own = codec(path)
            rows = []
            for text in texts:
                found = own.encode(text)
                rows.append((len(found), hashlib.sha256(found.tobytes()).hexdigest(), hashlib.sha256(own.decode(found).encode("utf-8")).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary_path())
