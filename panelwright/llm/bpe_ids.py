"""Ids of the public byte-level BPE vocabulary."""

from __future__ import annotations

END_OF_TEXT, END_ID = "<|endoftext|>", 50256
SPECIAL = {END_OF_TEXT}
LIBRARY_FILE = "byte_bpe_50k.json"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """The vocabulary of the ``byte_bpe_50k`` files, its special string included, at a given or the installed path."""

    def __init__(self, path: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or vocabulary_path(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: END_ID})
        self._library = None

    def encode(self, text: str):
        """Ids as a numpy array of unsigned 32-bit integers.

        The splitting pattern gives up on a run of more than a million blanks or the like; such a text goes through the
        slower library that the vocabulary comes with, which gives the same ids.
        """
        try:
            return self.bpe.encode_to_numpy(text, allowed_special=SPECIAL)
        except ValueError:
            import numpy as np

            return np.array(self.library().encode(text, add_special_tokens=False).ids, np.uint32)

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(vocabulary_path(LIBRARY_FILE))
        return self._library
