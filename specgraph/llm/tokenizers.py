"""Where vocabulary files of public tokenizers are."""

from __future__ import annotations

import os


def tokenizer_path(name: str, folder: str = "/opt/tokenizers") -> str:
    """The named file of the installed collection, or of ``folder`` where that is not installed."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(folder, name)
    return public_tokenizers.path(name)
