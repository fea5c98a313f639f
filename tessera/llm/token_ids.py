"""Token ids of whole texts by a public byte-level BPE vocabulary.

Pre-tokens of this vocabulary never cross a single space or line break that
stands between two other characters. A text in which all of them stand so is
split there, and each word with the space or break before it is encoded once
per worker process; unknown words of many texts are joined and encoded in one
call, then cut by their byte lengths. Other texts are encoded as a whole. The
strings of special tokens stand for these tokens, as in the tokenizer itself.
"""

from __future__ import annotations

import functools

import numpy as np

#: Words kept for each worker process; later ones are encoded whenever they come.
MOST_WORDS = 250_000
LONGEST_KEPT = 64


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts to the bytes of little-endian 32-bit ids."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer, decoders

        tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        byte_of = {c: b for b, c in _byte_characters().items()}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in tokenizer.get_vocab(with_added_tokens=True).items() if token not in special}
        assert isinstance(tokenizer.decoder, decoders.ByteLevel)
        self._encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._special = list(special)
        self._size = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self._size[i] = len(token)
        self._known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        ids = self._encoding.encode(text, allowed_special="all") if self._has_special(text) else self._encoding.encode_ordinary(text)
        return np.array(ids, np.uint32).tobytes()

    def _has_special(self, text: str) -> bool:
        return any(s in text for s in self._special)

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        """UTF-8 bytes of each id."""
        return self._size[ids]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        if not words:
            return {}
        chunks = [w if w[0] == "\n" else " " + w for w in words]
        ids = np.array(self._encoding.encode_ordinary("".join(chunks)), np.uint32)
        ends = np.cumsum([len(c.encode()) for c in chunks])
        cut = (4 * (np.searchsorted(np.cumsum(self._size[ids]), ends) + 1)).tolist()
        raw = ids.tobytes()
        new = {w: raw[a:b] for w, a, b in zip(words, [0, *cut], cut, strict=False)}
        if len(self._known) < MOST_WORDS:
            self._known.update((w, x) for w, x in new.items() if len(w) <= LONGEST_KEPT)
        return new

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each text."""
        split: list[list[str] | None] = []
        found: list[list[bytes | None]] = []
        missing: dict[str, None] = {}
        for text in texts:
            plain = text and not text[0].isspace() and not text[-1].isspace() and "  " not in text and not self._has_special(text)
            words = text.replace("\n", " \n").split(" ") if plain else None
            got = list(map(self._known.get, words[1:])) if words else []
            if None in got:
                missing.update((w, None) for w, x in zip(words[1:], got, strict=True) if x is None)
            split.append(words)
            found.append(got)
        odd = {w for w in missing if not (b := w.removeprefix("\n")) or b[0].isspace() or b[-1].isspace()}
        new = self._learn([w for w in missing if w not in odd])
        out = []
        for text, words, got in zip(texts, split, found, strict=True):
            if words and None in got:
                if odd and not odd.isdisjoint(words[1:]):
                    words = None
                else:
                    got = [new[w] if x is None else x for w, x in zip(words[1:], got, strict=True)]
            out.append(b"".join([self.encode(words[0]), *got]) if words else self.encode(text))
        return out


def _byte_characters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one printable character: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)
