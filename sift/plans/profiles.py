"""Profile presets: the same operators, different parameters.

Five presets mirror the five configurations of the chatbot this engine
re-expresses: ``fast`` (small chunks, k=2), ``flan`` (MMR retrieval),
``orca``, ``advanced`` (hybrid search, validation) and ``improved``.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..functions import lexicons as L


@dataclass(frozen=True)
class ChunkSpec:
    size: int
    overlap: int
    separators: tuple[str, ...]
    add_start_index: bool = False


@dataclass(frozen=True)
class Profile:
    name: str
    chunk: ChunkSpec
    id_prefix: str
    k: int                      # retrieved documents per question
    metric: str                 # collection distance
    history_messages: int       # bounded history (H2); 0 = not kept
    memory_exchanges: int       # rolling memory window (H3); 0 = none
    history_slice: int          # messages handed to one request (H4); -1 = all
    answer_limit: int           # F6 length limit
    retriever: str = "semantic"  # semantic | mmr | hybrid
    domain_keywords: tuple[str, ...] = ()   # E2; empty: questions stay as they are
    source_cap: int = 0          # D16: file names shown; 0 = none
    source_docs: int | None = None
    source_default: str = "Unknown"
    validate: bool = False       # G1-G6
    context_tokens: int | None = None  # I2: token cap of the retrieved context


# Chunking presets (size, overlap, separators, start index).
SEPS_4 = ("\n\n", "\n", ". ", " ")
SEPS_7 = ("\n\n", "\n", ". ", "! ", "? ", " ", "")
SEPS_8 = ("\n\n", "\n", ". ", "! ", "? ", "; ", " ", "")

PROFILES = {
    "fast": Profile("fast", ChunkSpec(300, 30, SEPS_4), "doc_", k=2, metric="l2",
                    history_messages=8, memory_exchanges=2, history_slice=2, answer_limit=500),
    "flan": Profile("flan", ChunkSpec(450, 75, SEPS_7), "retail_doc_", k=4, metric="l2",
                    history_messages=0, memory_exchanges=5, history_slice=-1, answer_limit=500,
                    retriever="mmr", domain_keywords=tuple(L.DOMAIN_KEYWORDS_7), source_cap=3, source_default="Memory"),
    "orca": Profile("orca", ChunkSpec(400, 75, SEPS_7, True), "retail_doc_", k=3, metric="cosine",
                    history_messages=0, memory_exchanges=5, history_slice=-1, answer_limit=2500,
                    domain_keywords=tuple(L.DOMAIN_KEYWORDS_17), source_cap=6, source_default="Document_{i}", context_tokens=1500),
    "advanced": Profile("advanced", ChunkSpec(350, 50, SEPS_8, True), "enhanced_doc_", k=5,
                        metric="cosine", history_messages=20, memory_exchanges=0,
                        history_slice=-1, answer_limit=2000, retriever="hybrid", source_cap=5, source_docs=5, validate=True),
    "improved": Profile("improved", ChunkSpec(300, 30, SEPS_4), "doc_", k=3, metric="l2",
                        history_messages=12, memory_exchanges=8, history_slice=6,
                        answer_limit=1500, source_cap=3, source_docs=3, source_default="Doc_{i}"),
}
