"""Exact word-level tokenisation of whole texts with one public tokenizer file.

White space never reaches a token of ``word_bpe_49k.json``, so a text's ids are the ids of its white-space separated
chunks in order. A worker keeps the ids of chunks it has met (bounded, no eviction) and encodes the unknown chunks of
a batch in one library call. Chunks outside the plain Latin range, or holding a special token, go through the library
unchanged, so the result equals ``Tokenizer.encode(text, add_special_tokens=False)`` for every text.
"""
from __future__ import annotations

import re
from itertools import chain

import numpy as np

from .common import worker_state

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Distinct chunks a worker remembers; beyond it, unknown chunks are encoded again in each batch.
CACHE_CHUNKS = 700_000

_ODD_SPACE = re.compile("[\x1c-\x1f]")
# the tokenizer's own pre-tokenisation pattern (fixed value), for text that is lower case already
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class ChunkTokenizer:
    """Ids of whole texts as little-endian unsigned 16-bit bytes (the vocabulary has fewer than 65,536 ids)."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.encode_special_tokens = True
        # one piece a line; the byte-level mapping stays as in the file
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.specials = [t.content for t in self.full.get_added_tokens_decoder().values()]
        vocabulary = self.full.get_vocab(with_added_tokens=True)
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.pieces = regex.compile(_PIECE).findall
        self.known: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    def _encode_whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _learn(self, chunks: list[str], into: dict[str, bytes]) -> None:
        words, parts = self.words, []
        joined = "\n".join(chunks)
        if max(joined) < "\u0300" and "<|" not in joined:
            plain = chunks
        else:
            plain = []
            for chunk in chunks:
                if max(chunk) < "\u0300" and "<|" not in chunk:
                    plain.append(chunk)
                else:
                    into[chunk] = self._encode_whole(chunk)
            joined = "\n".join(plain)
        for low in joined.lower().split("\n") if plain else ():
            if low.isalpha():
                parts.append((low,))
            elif low[:-1].isalpha() and not low[-1].isalnum():
                parts.append((low[:-1], low[-1]))
            else:
                parts.append(self.pieces(low))
        fresh = [p for p in set(chain.from_iterable(parts)) if p not in words]
        if fresh:
            ids = np.array(self.bare.encode("\n".join(fresh), add_special_tokens=False).ids, "<u2")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(fresh):
                raise ValueError("pieces and word ends disagree")
            raw, start = ids.tobytes(), 0
            for piece, stop in zip(fresh, (cuts * 2).tolist()):
                words[piece] = raw[start:stop]
                start = stop
        for chunk, pieces in zip(plain, parts):
            into[chunk] = b"".join([words[p] for p in pieces]) if len(pieces) != 1 else words[pieces[0]]
        if len(words) > CACHE_CHUNKS:
            words.clear()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: empty), without the end id."""
        known, parts = self.known, []
        for text in texts:
            if text and _ODD_SPACE.search(text):
                parts.append(None)
            else:
                parts.append(text.split() if text else [])
        unknown = [c for c in set(chain.from_iterable(p for p in parts if p)) if c not in known]
        extra: dict[str, bytes] = known
        if unknown:
            if len(known) + len(unknown) > CACHE_CHUNKS:
                extra = {}
            self._learn(unknown, extra)
        if extra is known:
            return [self._encode_whole(t) if p is None else b"".join([known[c] for c in p]) for t, p in zip(texts, parts)]
        return [self._encode_whole(t) if p is None else b"".join([known[c] if c in known else extra[c] for c in p])
                for t, p in zip(texts, parts)]


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def worker_tokenizer(path: str | None = None) -> ChunkTokenizer:
    """One tokenizer per Python worker and file."""
    path = path or tokenizer_path()
    held = worker_state().setdefault("tokenizers", {})
    if path not in held:
        held[path] = ChunkTokenizer(path)
    return held[path]
