"""Settings: from the environment, blank counting as missing, with fixed defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    # Defaults are fixed values.
    book_title: str = "রাজর্ষি"
    book_url: str = "https://bn.wikisource.org/wiki/রাজর্ষি_(১৯৬১)"
    embedding_model: str = "intfloat/multilingual-e5-small"
    embedding_device: str = "cpu"
    ollama_model: str = "qwen2.5:3b"
    ollama_base_url: str = "http://localhost:11434"
    chunk_size: int = 500
    chunk_overlap: int = 100
    top_k: int = 5
    generation_k: int = 3
    retrieval_threshold: float = 0.40
    #: Where pages, chunks, the index and chats lie unless a command names another place.
    data_dir: str = "data"

    def place(self, what: str) -> str:
        """The default place of ``pages``, ``chunks``, ``index`` or ``chats``."""
        folders = {"pages": "raw/pages", "chunks": "processed/chunks", "index": "vectorstore/index", "chats": "chats"}
        return f"{self.data_dir.rstrip('/')}/{folders[what]}"

    @classmethod
    def load(cls, environ: dict[str, str] | None = None) -> Settings:
        """A field's variable is its name in capitals; a number that doesn't parse raises ValueError."""
        env = os.environ if environ is None else environ
        given = {}
        for f in fields(cls):
            if value := env.get(f.name.upper(), "").strip():
                given[f.name] = type(f.default)(value)
        return cls(**given)


QUERY_PREFIX, PASSAGE_PREFIX = "query: ", "passage: "
NO_ANSWER = "এই তথ্যটি নির্বাচিত বইয়ের পাঠ্যে পাওয়া যায়নি।"
SETTINGS = Settings.load()
