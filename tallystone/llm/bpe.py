"""Byte-level BPE encoding and decoding with offsets.

Texts come in Arrow batches of bounded bytes. A text is cut into the pieces of the
vocabulary's pattern; its new pieces are encoded together by the tokenizers
library, each piece separately and at most ``SLICE`` characters at a time, and the
ids of short pieces are kept (at most ``KEPT_PIECES``), so that every piece of
every text is encoded but equal pieces only once. Long texts go through part by
part. Ids are little-endian unsigned 32-bit integers throughout.

The vocabulary is the file of ranks; the tokenizers library reads the same one
from the JSON file beside it, and both are compared when they are loaded. Letters
and numbers are those of the ranks' own library (``classes_of_ranks``), which may
know fewer than the module of regular expressions.

Decoding turns each id's token string back into bytes by the reversed byte table
and joins them. A token may end inside a character: ``decode_text`` replaces only
what is no whole character at the very end, ``Decoder`` keeps such bytes until
the next call.

Null or empty text: no ids, and the digests of no bytes. Null doc_id: returned as
it is. Strings of special tokens are ordinary text. Very long texts are encoded
whole; a single piece (a run of letters, say) is never divided. Repeated rows each
get a result; an empty table gives no rows. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_batches

KEPT_PIECES = 200_000
LONGEST_KEPT = 40
#: Characters of pieces that are encoded at once; characters of a text that is cut at once, and its pieces at a time if it is longer.
SLICE = 1 << 16
LONG_TEXT, PIECES = 1 << 20, 1 << 16
#: Unicode White_Space, which the vocabulary's pattern means by \s.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The file of ranks; the same vocabulary as JSON has the same name with another ending."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def byte_table() -> dict[str, int]:
    """The character that stands for each byte in token strings, reversed: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def class_text(codes: Iterable[int]) -> str:
    """The inside of a character class that holds exactly these code points."""
    runs: list[list[int]] = []
    for c in sorted(codes):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@lru_cache(maxsize=1)
def classes_of_ranks() -> tuple[str, str, str]:
    """Letters and numbers as the library of the rank files has them, and the characters where the regex module differs.

    Found by asking both: a pattern of one class leaves of the text of all
    characters just that class.
    """
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    bytes_only = {bytes([b]): b for b in range(256)}
    found, odd = [], set()
    for name in (r"\p{L}", r"\p{N}"):
        own = tiktoken.Encoding(f"class {name}", pat_str=name, mergeable_ranks=bytes_only, special_tokens={})
        codes = set(map(ord, bytes(own.encode_ordinary(every)).decode("utf-8")))
        odd |= codes ^ set(map(ord, regex.findall(name, every)))
        found.append(class_text(codes))
    return found[0], found[1], class_text(odd)


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        pattern = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self.plain = regex.compile(pattern)
        # the exact classes are long, hence slow; only texts with a character that differs need them
        letters, numbers, odd = classes_of_ranks()
        inside = pattern.replace(rf"[^{SPACE}\p{{L}}\p{{N}}]", f"[^{SPACE}{letters}{numbers}]")
        self.exact = regex.compile(inside.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]"))
        self.odd = regex.compile(f"[{odd}]").search if odd else (lambda text: None)
        named = os.path.splitext(path)[0] + ".json"
        self.tokenizer = Tokenizer.from_file(named)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.kept: dict[str, bytes] = {}
        table, ranks = byte_table(), ranks_of(path)
        with open(named, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.tokens: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if all(c in table for c in token):
                self.tokens[i] = bytes(table[c] for c in token)
        if any(self.tokens[rank] != token for token, rank in ranks.items()):
            raise ValueError(f"{named} is not the vocabulary of {path}")
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of the given pieces; short ones are kept."""
        found: dict[str, bytes] = {}
        at = 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end]) <= SLICE):
                size += len(pieces[end])
                end += 1
            part = pieces[at:end]
            found.update((p, np.array(e.ids, dtype="<u4").tobytes()) for p, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True))
            at = end
        if len(self.kept) + len(found) > KEPT_PIECES:
            self.kept = {}
        self.kept.update((p, ids) for p, ids in islice(found.items(), KEPT_PIECES) if len(p) <= LONGEST_KEPT)
        return found

    def differs(self, text: str) -> bool:
        """Whether a character's class is another one for the ranks' library; none below U+0100 is."""
        if text.isascii():
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.odd(text) is not None
        return False

    def cut(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, those of a long one some at a time."""
        pattern = self.exact if self.differs(text) else self.plain
        if len(text) <= LONG_TEXT:
            yield pattern.findall(text)
            return
        found = pattern.finditer(text)
        while part := [m[0] for m in islice(found, PIECES)]:
            yield part

    def parts(self, text: str) -> Iterator[bytes]:
        """The ids of one text, in order, those of a long one some at a time."""
        for pieces in self.cut(text):
            kept = self.kept
            if new := [p for p in dict.fromkeys(pieces) if p not in kept]:
                found = self.learn(new)
                yield b"".join([found[p] if p in found else kept[p] for p in pieces])
            else:
                yield b"".join(map(kept.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """The ids of one text."""
        return b"".join(self.parts(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def decode_text(self, ids: bytes) -> str:
        return self.decode(ids).decode("utf-8", errors="replace")

    def byte_spans(self, ids: bytes) -> np.ndarray:
        """Byte offsets of token boundaries: 0 first, the text's length last."""
        out = np.zeros(len(ids) // 4 + 1, dtype=np.int64)
        np.cumsum(self.lengths[np.frombuffer(ids, dtype="<u4")], out=out[1:])
        return out

    def char_spans(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token. Tokens inside one character share it."""
        at = self.byte_spans(ids)
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        begins = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=begins[1:])
        # the characters that begin before an offset; a token inside a character begins with it
        inside = np.append((raw & 0xC0) == 0x80, False)
        return begins[at[:-1]] - inside[at[:-1]], begins[at[1:]]


class Decoder:
    """Decoding of ids that arrive in parts: bytes of a split character wait for the rest."""

    def __init__(self, codec_: Codec):
        self.codec, self.text = codec_, codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: bytes, last: bool = False) -> str:
        return self.text.decode(self.codec.decode(ids), final=last)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_column(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary), of every row: the operator's own output."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [codec(path).encode(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coder, counts, coded, back = codec(path), [], [], []
            for value in b.column(1):
                n, own, again = 0, hashlib.sha256(), hashlib.sha256()
                for ids in coder.parts(value.as_py() or ""):
                    n += len(ids) // 4
                    own.update(ids)
                    again.update(coder.decode(ids))
                counts.append(n)
                coded.append(own.hexdigest())
                back.append(again.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
