"""Settings: immutable, from defaults or a file of `KEY = value` lines."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """Index, search, graph and evaluation settings. Folder settings end with a slash when read from a file."""

    use_stemmer: bool = True
    use_stopwords: bool = True
    retrieval_model: str = "OkapiBM25+"
    pagerank_threshold: float = 1e-8
    pagerank_damping_factor: float = 0.85
    pagerank_publications_weight: float = 0.25
    query_expansion_enabled: bool = False
    query_expansion_model: str = "GloVe"
    index_dir: str = "index/"
    dataset_dir: str = "data/"
    citations_stats_dir: str = "citations_stats/"
    stopwords_path: str = ""
    glove_path: str = ""
    judgements_path: str = ""
    evaluation_filename: str = "evaluation.txt"

    @classmethod
    def parse(cls, lines: Iterable[str]) -> Settings:
        """Unknown keys are ignored; values follow their default's type."""
        types = {f.name: f.type for f in fields(cls)}
        found = {}
        for line in lines:
            key, eq, value = line.partition("=")
            name = key.strip().lower()
            if not eq or line.lstrip().startswith("#") or name not in types:
                continue
            value = value.strip()
            if types[name] == "bool":
                found[name] = value.lower() == "true"
            elif types[name] == "float":
                found[name] = float(value)
            else:
                found[name] = value.rstrip("/") + "/" if name.endswith("_dir") else value
        return replace(cls(), **found)

    @property
    def model(self) -> str:
        """okapi, vsm or existential; an unknown name means existential."""
        return {"OkapiBM25+": "okapi", "VSM": "vsm"}.get(self.retrieval_model, "existential")

    @property
    def expansion(self) -> str:
        """glove, wordnet or none."""
        return {"GloVe": "glove", "WordNet": "wordnet"}.get(self.query_expansion_model, "none") if self.query_expansion_enabled else "none"
