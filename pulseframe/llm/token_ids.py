"""Ids of texts, as little-endian unsigned 32-bit bytes, equal to what `tokenizers` gives by default for the same vocabulary.

The strings of added tokens become their ids. Vocabulary files stay where they are: paths are parameters, and default
to the installed package's files. Lone surrogates do not occur in Spark's strings.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Texts of more characters go to `tokenizers` itself: a long run of white space overflows the fast path's stack.
LONG_TEXT = 100_000
#: Words whose ids a worker remembers, as many again that it has not met since, and the longest such word in bytes.
MEMO_WORDS, MEMO_BYTES = 250_000, 64


def packed_ids(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def exact_ids(path: str, text: str) -> bytes:
    return packed_ids(tokenizer(path).encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=2)
def byte_encoder(path: str | None = None, ranks_path: str | None = None) -> Callable[[str], bytes]:
    """For byte_bpe_50k.json: the same vocabulary's rank file gives the same ids in less time."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    added = {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added).encode

    def encode(text: str) -> bytes:
        if len(text) > LONG_TEXT:
            return exact_ids(path, text)
        return packed_ids(fast(text, allowed_special="all"))

    return encode


def plain_words(path: str):
    """The vocabulary's model alone, for lower-case ASCII letters with a space between words."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import CharDelimiterSplit

    bare = Tokenizer(tokenizer(path).model)
    bare.pre_tokenizer = CharDelimiterSplit(" ")
    return bare


@lru_cache(maxsize=2)
def word_encoder(path: str | None = None) -> Callable[[str], bytes]:
    """For word_bpe_49k.json, which drops white space: each distinct word goes to `tokenizers` once.

    No piece of that vocabulary's pattern crosses ASCII white space, nor the border from a letter or digit to one of
    the marks below, so the ids of the words in a row are those of the text. A word of letters alone is one
    piece, whose case does not count and whose last id is one that ends a piece: a text's new ones go in one call.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("word_bpe_49k.json")
    stops = re.compile(rb"(?:(?<=[0-9A-Za-z])|(?<=\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]))(?=[.,;:!?$&*%#)])")
    vocabulary = tokenizer(path).get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    bare = plain_words(path)
    known: dict[bytes, bytes] = {}
    older: dict[bytes, bytes] = {}

    def pieces_of(pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct pieces that are not known yet."""
        letters = {w: w.lower() for w in pieces if w.decode().isalpha()}
        new = [w for w in dict.fromkeys(letters.values()) if w not in known]
        ascii_, other = [w for w in new if w.isascii()], [w for w in new if not w.isascii()]
        new = ascii_ + other
        ids = packed_ids(bare.encode_batch_fast([b" ".join(ascii_).decode()], add_special_tokens=False)[0].ids) if ascii_ else b""
        ids += exact_ids(path, b" ".join(other).decode()) if other else b""
        cut = (4 * np.flatnonzero(ends[np.frombuffer(ids, dtype="<u4")]) + 4).tolist()
        found = {}
        if len(cut) == len(new):
            found = {w: ids[a:b] for w, a, b in zip(new, [0, *cut], cut, strict=False)}
            found |= {w: found[low] if low in found else known[low] for w, low in letters.items()}
        for piece in pieces:
            if piece not in found:
                found[piece] = exact_ids(path, piece.decode())
        return found

    def learn(words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not known yet."""
        parts = {w: stops.sub(b" ", w).split() for w in words}
        found = pieces_of(list({p for own in parts.values() for p in own if p not in known}))
        return found | {w: b"".join([found[p] if p in found else known[p] for p in own]) for w, own in parts.items() if len(own) > 1}

    def encode(text: str) -> bytes:
        nonlocal known, older
        words = text.encode().split()
        ids = list(map(known.get, words))
        if None in ids:
            missing = {w for w, i in zip(words, ids, strict=True) if i is None}
            found = {w: older[w] for w in missing if w in older}
            found |= learn(missing - found.keys())
            ids = [found[w] if i is None else i for w, i in zip(words, ids, strict=True)]
            if len(known) >= MEMO_WORDS:
                known, older = {}, known
            known.update((w, i) for w, i in found.items() if len(w) <= MEMO_BYTES)
        return b"".join(ids)

    return encode
