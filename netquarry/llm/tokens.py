"""Token ids of public vocabularies, inside Arrow tasks."""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np

#: Vocabulary of every query here; the path is a parameter of the operators.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str):
    """Function from text to ids for a vocabulary file, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    A ``.json`` file whose folder holds the same vocabulary as ranks (``.tiktoken``) is
    encoded by those: the ids are the same (tests/llm compares them), in a sixth of the CPU time.
    The file's added tokens (``<|endoftext|>``) have their own ids inside a text, too; a bare rank file has none.
    """
    ranks, added = path, []
    if path.endswith(".json"):
        ranks = path[: -len(".json")] + ".tiktoken"
        with open(path, encoding="utf-8") as file:
            added = json.load(file).get("added_tokens") or []
    plain = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if ranks.endswith(".tiktoken") and os.path.exists(ranks) and plain:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {t["content"]: t["id"] for t in added}
        table = {k: v for k, v in table.items() if v not in special.values()}
        made = tiktoken.Encoding(os.path.basename(ranks), pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
        names = tuple(special)
        return lambda text: made.encode(text, allowed_special="all") if any(x in text for x in names) else made.encode_ordinary(text)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def encode(text: str, path: str, end: int | None = None) -> np.ndarray:
    ids = encoder(path)(text)
    if end is not None:
        ids.append(end)
    return np.asarray(ids, dtype="<u4")
