"""Token ids of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
import re

import numpy as np

#: Names of the vocabulary: for `tiktoken`, and the same one for `tokenizers`.
RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"

#: The vocabulary's special tokens and their ids.
SPECIAL = {"<|endoftext|>": 50256}


def folder() -> str:
    import public_tokenizers

    return os.path.dirname(public_tokenizers.__file__)


class Encoder:
    """Ids of texts, the same as those of `tokenizers` with the JSON file; tiktoken's
    merge loop is several times as fast. Texts that it refuses go through `tokenizers`.
    With `special`, as that library does by default, the string of a special token in a
    text is that token; without, it is ordinary text. Files load on first use in each
    task, from `place`, the folder of the tokenizer files on each machine."""

    def __init__(self, place: str | None = None, special: bool = True):
        self.place, self.special = place, special
        self.fast = self.whole = None

    def __getstate__(self):
        return {"place": self.place, "special": self.special, "fast": None, "whole": None}

    def ids(self, text: str) -> np.ndarray:
        if self.special and any(s in text for s in SPECIAL):
            parts = re.split("(" + "|".join(map(re.escape, SPECIAL)) + ")", text)
            return np.concatenate([np.array([SPECIAL[p]], dtype=np.uint32) if p in SPECIAL else self.ordinary_ids(p) for p in parts])
        return self.ordinary_ids(text)

    def ordinary_ids(self, text: str) -> np.ndarray:
        if self.fast is None:
            import public_tokenizers
            import tiktoken

            if not hasattr(tiktoken, "_shared_encodings"):
                tiktoken._shared_encodings = {}
            path = os.path.join(self.place or folder(), RANKS)
            if path not in tiktoken._shared_encodings:
                with open(path, "rb") as lines:
                    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
                tiktoken._shared_encodings[path] = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.fast = tiktoken._shared_encodings[path]
        try:
            return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
        except BaseException as error:
            # the regex engine's limits end in a panic, which is no Exception and has no public type
            if type(error).__name__ not in ("PanicException", "ValueError"):
                raise
            return self.plain_ids(text)

    def plain_ids(self, text: str) -> np.ndarray:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(os.path.join(self.place or folder(), TOKENIZER))
            self.whole.encode_special_tokens = True
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
