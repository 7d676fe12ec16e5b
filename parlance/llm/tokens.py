"""Public tokenizers inside tasks: ids of whole texts, and the bytes of ids.

A worker loads a vocabulary file once. Texts longer than LONG characters are encoded in parts, cut where
neither tokenizer joins anything: between a letter or digit and a space. The byte-level tokenizer's
splitting pattern always ends a word there; the other tokenizer is cut only if no entry of its vocabulary holds a space
behind something else and if it leaves spaces as they are. So parts give the ids of the whole text, and the
working memory of a very long text is that of its ids.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

LONG = 1 << 18


def parts(text: str, most: int = LONG) -> list[str]:
    """`text` in consecutive parts of about `most` characters; what follows a cut starts with a space."""
    out, start = [], 0
    while len(text) - start > 2 * most:
        found = CUT.search(text, start + most)
        if found is None:
            break
        out.append(text[start : found.end()])
        start = found.end()
    return [*out, text[start:]]


CUT = re.compile(r"\w(?= )")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class ByteLevel:
    """Ids of a byte-level BPE in a tokenizers file; strings of special tokens are ordinary text.

    The ids are those of the `tokenizers` library. Where the file is plain byte-level BPE, whose merges are numbered in
    the order of their ids, the same vocabulary is run by tiktoken, which is several times as fast and gives equal ids (tested on
    every code point and on texts); other files are run by `tokenizers` itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        self.path, alphabet = path, byte_alphabet()
        special = {t["content"]: t["id"] for t in found.get("added_tokens") or []}
        vocabulary = found["model"]["vocab"]
        self.bytes: list[bytes] = [b""] * (1 + max([*vocabulary.values(), *special.values()]))
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if token in special or not set(token) <= alphabet.keys() else bytes(map(alphabet.__getitem__, token))
        ranks = {self.bytes[i]: i for token, i in vocabulary.items() if token not in special}
        self.engine = self._tiktoken(found, ranks) if self._plain(found, vocabulary, special) else None
        self.plain = None if self.engine else self._tokenizers()

    @staticmethod
    def _plain(found: dict, vocabulary: dict[str, int], special: dict[str, int]) -> bool:
        model, before = found["model"], found.get("pre_tokenizer") or {}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
        return (
            model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and found.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex") is True
            and before.get("add_prefix_space") is False
            and [vocabulary.get(m) for m in merged] == list(range(256, 256 + len(merged)))
            and len(vocabulary) - len(special.keys() & vocabulary.keys()) == 256 + len(merged)
        )

    @staticmethod
    def _tiktoken(found: dict, ranks: dict[bytes, int]):
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding("byte level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _tokenizers(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def __call__(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens."""
        if self.engine is None:
            return [np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(list(texts), add_special_tokens=False)]
        ids = lambda part: self.engine.encode_to_numpy(part, disallowed_special=())
        return [ids(text) if len(text) <= 2 * LONG else np.concatenate([ids(p) for p in parts(text)]) for text in texts]


class Pieces:
    """Ids of a SentencePiece model; bytes of ids with U+2581 as a space and byte tokens as that byte."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        inside = any(re.search("[^▁]▁", p) for p in names)
        probe = " a  b "
        kept = b"".join(self.bytes[i] for i in self.model.encode(probe)) == f" {probe}".encode()
        self.cuts = kept and not inside

    def __call__(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of each text; the model puts a space before it."""
        texts = list(texts)
        cut = [parts(t) if self.cuts and len(t) > 2 * LONG else [t] for t in texts]
        # the model puts a space before a part too: the one that the part starts with
        found = self.model.encode([p[1:] if k else p for own in cut for k, p in enumerate(own)], num_threads=1)
        ids, out = iter(found), []
        for own in cut:
            out.append(np.array([i for _ in own for i in next(ids)], np.uint32))
        return out


@lru_cache(4)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@lru_cache(4)
def pieces(path: str) -> Pieces:
    return Pieces(path)
