"""BPE encoding and decoding.

``SuffixBpe`` encodes as the tokenizers library does with a vocabulary of words with ends (``</w>``), ``SpaceBpe`` with a
byte-level vocabulary.  Both cut a text only where every rule of the tokenizer cuts it too, and remember the pieces.

Long unsplit text (one pre-token of thousands of symbols) is encoded by tree concatenation: halves are encoded apart, down to leaves
of ``LEAF`` symbols, and joined.  Leaves may be encoded by ``threads``; workers use one, since Spark's tasks fill the cores already and
threads of pure Python take turns.  At each join a window around it is encoded again and grows until its first
and last token are those that the two sides have there.  That is exact: a token sequence is the BPE encoding of its text if
and only if each pair of neighbours is the encoding of its own text, and every pair is then either inside the window,
or known from a side.

Null text counts as empty, which has no tokens.  Rows are independent, so ties, repeated rows and empty tables need no rule;
other columns of the input are never read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.runtime import Memo

#: Symbols from which on a pre-token is encoded by tree concatenation, and those of a leaf.
LONG, LEAF = 2048, 512
MEMO = 250_000


def merge(symbols: Sequence[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """BPE of one pre-token: the pair of lowest rank first, the leftmost of equals."""
    out: list[str | None] = list(symbols)
    n = len(out)
    if n < 2:
        return list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, *p) for i in range(n - 1) if (p := (out[i], out[i + 1])) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if out[i] != a or j >= n or out[j] != b:
            continue
        out[i], out[j] = a + b, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((out[i], out[k]))) is not None:
                heapq.heappush(heap, (r, i, out[i], out[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((out[h], out[i]))) is not None:
            heapq.heappush(heap, (r, h, out[h], out[i]))
    return [x for x in out if x is not None]


def join(left: list, right: list, encode, window: int = 4) -> list:
    """The encoding of two neighbours' text from theirs.  Tokens are (first symbol, end symbol, token) spans."""
    k = window
    while True:
        a, b = left[-k:], right[:k]
        again = encode(a[0][0], b[-1][1])
        if (len(a) < k or k >= len(left) or again[0] == a[0]) and (len(b) < k or k >= len(right) or again[-1] == b[-1]):
            return left[: -len(a)] + again + right[len(b) :]
        k *= 2


def tree(symbols: Sequence[str], ranks: dict, leaf: int = LEAF, threads: int = 1) -> list[str]:
    """BPE of a long pre-token by tree concatenation."""

    def encode(start: int, end: int) -> list[tuple[int, int, str]]:
        out, at = [], start
        for token in merge(symbols[start:end], ranks):
            size = 0
            length = 0
            while length < len(token):
                length += len(symbols[at + size])
                size += 1
            out.append((at, at + size, token))
            at += size
        return out

    def halves(start: int, end: int) -> list[tuple[int, int]]:
        middle = (start + end) // 2
        return [(start, end)] if end - start <= leaf else halves(start, middle) + halves(middle, end)

    def joined(start: int, end: int) -> list[tuple[int, int, str]]:
        if end - start <= leaf:
            return leaves[start]
        middle = (start + end) // 2
        return join(joined(start, middle), joined(middle, end), encode)

    cuts = halves(0, len(symbols))
    if threads > 1:
        with ThreadPoolExecutor(threads) as pool:
            leaves = {c[0]: part for c, part in zip(cuts, pool.map(lambda c: encode(*c), cuts), strict=True)}
    else:
        leaves = {c[0]: encode(*c) for c in cuts}
    return [t for _, _, t in joined(0, len(symbols))] if symbols else []


#: The published pre-token rule of vocabularies of words with ends; on Latin texts, the same for Python's own matcher.
WORD_RULE = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
_of = lambda kind: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)
WORDS = f"'s|'t|'re|'ve|'m|'ll|'d|[{_of('L')}]+|[{_of('N')}]|[^\t\n\v\f\r \x85\xa0{_of('L')}{_of('N')}]+"
LATIN = re.compile("[^\x00-\u012f\u0131-\u017f\u2010-\u2027\u20ac]")


def _char(byte: int) -> str:
    """The character that stands for a byte: itself if it prints, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return chr(byte) if byte in shown else chr(256 + [b for b in range(256) if b not in shown].index(byte))


def _bytes() -> dict[str, int]:
    return {_char(b): b for b in range(256)}


class SuffixBpe:
    """Encoder for a vocabulary in which the last symbol of a pre-token carries an end-of-word suffix."""

    def __init__(self, path: str, long: int = LONG, leaf: int = LEAF, threads: int = 1, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = spec["model"]["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.long, self.leaf, self.threads = long, leaf, threads
        self.name = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.memo = Memo(memo)
        self.memo[""] = (b"", "")
        self._quick(spec)

    def _quick(self, spec: dict) -> None:
        """A tiktoken twin, which takes half the time.

        Its words end with byte 0, which the lowest ranks glue to the byte before it: that is the suffix.  It numbers tokens
        by rank; ``number`` has their ids, ``shown`` their strings.  The twin is used for texts of Latin letters and common
        marks only, on whose classes and normal forms all Unicode versions agree.
        """
        import tiktoken

        self.twin = None
        rules = [p.get("pattern", {}).get("Regex") for p in spec["pre_tokenizer"].get("pretokenizers", [])]
        merged = ["".join(m) for m in self.ranks]
        if self.suffix != "</w>" or rules[:1] != [WORD_RULE] or len(set(merged)) < len(merged) or len(self.vocab.keys() - self.special.keys()) != 512 + len(merged):
            return
        byte = _bytes()
        raw = lambda t: bytes(byte[c] for c in t.removesuffix("</w>")) + b"\0" * t.endswith("</w>")
        ranks = {bytes((b, 0)): b for b in range(1, 256)} | {bytes((b,)): 100_000 + b for b in range(256)}
        ranks |= {raw(t): 256 + i for i, t in enumerate(merged)}
        none = _char(0)
        by_raw = {raw(t): i for t, i in self.vocab.items() if t not in self.special and t != none}
        self.number = np.zeros(100_256, np.uint32)
        for t, r in ranks.items():
            self.number[r] = by_raw.get(t, 0)
        self.shown = [self.name[i] for i in range(len(self.name))]
        self.words = re.compile(WORDS)
        self.twin = tiktoken.Encoding("twin", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def ids(self, piece: str) -> list[int]:
        """Of a text without long unsplit parts by the library, else by tree concatenation."""
        if len(piece) < self.long:
            return self.tok.encode(piece, add_special_tokens=False).ids
        out: list[int] = []
        for part in self.specials.split(piece) if self.specials else [piece]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part)):
                symbols = [*word[:-1], word[-1] + self.suffix]
                tokens = tree(symbols, self.ranks, self.leaf, self.threads) if len(word) >= self.long else merge(symbols, self.ranks)
                out += [self.vocab[t] for t in tokens]
        return out

    def fill(self, pieces: list[str]) -> dict[str, tuple[bytes, str]]:
        """Entries of pieces that the memo's younger generation lacks."""
        out: dict[str, tuple[bytes, str]] = {}
        new = []
        for p in dict.fromkeys(pieces):
            if (known := self.memo.recall(p)) is None:
                new.append(p)
            else:
                out[p] = known
        short = [p for p in new if len(p) < self.long]
        found = [e.ids for e in self.tok.encode_batch_fast(short, add_special_tokens=False)] if short else []
        name = self.name
        for p, ids in [*zip(short, found, strict=True), *((p, self.ids(p)) for p in new if len(p) >= self.long)]:
            out[p] = (array("I", ids).tobytes(), " ".join([name[i] for i in ids]))
            if len(p) <= 64:
                self.memo.keep(p, out[p])
        return out

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text.

        No pre-token holds white space, and no normal form composes over a space or line feed, so both are safe cuts.
        """
        text = text or ""
        if self.twin is not None and (text.isascii() or not LATIN.search(text)) and "\0" not in text and not (self.specials and self.specials.search(text)):
            words = self.words.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
            if words and max(map(len, words)) < self.long // 2:
                ids = self.number[self.twin.encode_ordinary("\0".join(words) + "\0")]
                shown = self.shown
                return ids.tobytes(), " ".join([shown[i] for i in ids.tolist()])
        pieces = text.replace("\n", " ").split(" ")
        found = list(map(self.memo.get, pieces))
        if None in found:
            new = self.fill([p for p, v in zip(pieces, found, strict=True) if v is None])
            found = [new[p] if v is None else v for p, v in zip(pieces, found, strict=True)]
        return b"".join([v[0] for v in found]), " ".join([v[1] for v in found if v[1]])


#: The published pre-token rule of byte-level vocabularies.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class SpaceBpe:
    """Encoder for a byte-level vocabulary in which merges are numbered by rank.

    The vocabulary is read once from the tokenizers file and run by tiktoken, which gives the same ids in a third of the
    time.  Texts on which the two libraries could differ (special strings, letters outside the Latin blocks, whose classes
    depend on a library's Unicode version, unpaired surrogates) and vocabularies that aren't numbered so go to the
    tokenizers library.
    """

    other = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]
        self.fast = None
        if plain and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and len(vocab) == 256 + len(merges):
            byte = _bytes()
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
            self.fast = tiktoken.Encoding("file", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.fast is None or not text.isascii() and self.other.search(text) or any(s in text for s in self.special):
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=4)
def suffix_bpe(path: str, long: int = LONG) -> SuffixBpe:
    """One encoder in each Python worker."""
    return SuffixBpe(path, long)


@lru_cache(maxsize=4)
def space_bpe(path: str) -> SpaceBpe:
    return SpaceBpe(path)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", long: int = LONG) -> DataFrame:
    """``key``, ``ids`` (array<int>), ``decoded`` (string) of every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = suffix_bpe(path, long)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                pairs = [codec.encode(t) for t in part.column(1).to_pylist()]
                ids = pa.array([memoryview(b).cast("i") for b, _ in pairs], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([d for _, d in pairs], pa.string())], ["key", "ids", "decoded"])

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(work, f"key {source.schema['key'].dataType.simpleString()}, ids array<int>, decoded string").withColumnRenamed("key", key)


def digest_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", long: int = LONG) -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``: what ``encode_documents`` returns, digested where it is made."""
    import hashlib

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = suffix_bpe(path, long)
        for batch in batches:
            n, ids, decoded = [], [], []
            for value in batch.column(1):
                raw, out = codec.encode(value.as_py())
                n.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(out.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(work, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
