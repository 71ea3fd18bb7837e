"""Settings of a run."""

from __future__ import annotations

from dataclasses import dataclass

from caseframe.schema import MAX_TOKENS, SEED


@dataclass(frozen=True)
class Settings:
    """Folders and parameters; paths may be in any file system that Spark reads."""

    data: str = "data"
    results: str = "results"
    model: str = "model"
    max_tokens: int = MAX_TOKENS
    seed: int = SEED

    def cases(self) -> str:
        return f"{self.data}/cases"

    def split(self, name: str) -> str:
        return f"{self.data}/samples/split={name}"

    def predictions(self, model: str) -> str:
        return f"{self.results}/predictions/{model}"
