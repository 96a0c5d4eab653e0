"""Where the public tokenizers lie; a parameter, never a copy."""

from __future__ import annotations

import json
import os

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def ordinary_words(tokenizer_dir: str = TOKENIZERS) -> set[str]:
    """Lower-case words of four letters or more that are one piece of the public byte-level vocabulary: ordinary words of English and of code."""
    with open(f"{tokenizer_dir}/byte_bpe_50k.json", encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = {k.lstrip("Ġ") for k in vocab if k.startswith("Ġ")}
    return {w.lower() for w in words if len(w) >= 4 and w.isalpha() and w.isascii() and w[1:] == w[1:].lower()}
