"""Settings shared by the operators. Every operator also accepts plain arguments."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Limits and column names of the data-quality run."""

    # Column names, limits and fractions that define the results.
    id_column: str = "id"
    text_column: str = "text"
    label_column: str = "label"
    image_path_column: str | None = "image_path"
    image_bytes_column: str | None = None
    valid_image_formats: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
    min_image_size: tuple[int, int] = (32, 32)
    max_image_size_mb: float = 10
    target_image_size: tuple[int, int] = (224, 224)
    min_text_length: int = 10
    max_text_length: int = 10000
    test_size: float = 0.2
    val_size: float = 0.1
    random_state: int = 42
    tfidf_max_features: int = 5000
    tfidf_min_df: int = 2


def parse_size(text: str) -> tuple[int, int]:
    """``"224,224"`` -> ``(224, 224)``."""
    height, width = text.split(",")[:2]
    return int(height), int(width)


@dataclass(frozen=True)
class JobConfig:
    """Paths and sizes of the training job, read from the environment."""

    data_dir: str = "/data"
    model_output: str = "/app/output/model"
    epochs: int = 20
    batch_size: int = 32
    image_size: tuple[int, int] = (224, 224)

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> JobConfig:
        return cls(
            data_dir=env.get("DATA_DIR", cls.data_dir),
            model_output=env.get("MODEL_OUTPUT", cls.model_output),
            epochs=int(env.get("EPOCHS", cls.epochs)),
            batch_size=int(env.get("BATCH_SIZE", cls.batch_size)),
            image_size=parse_size(env.get("IMAGE_SIZE", "224,224")),
        )

    @property
    def csv_path(self) -> str:
        return f"{self.data_dir}/metadata.csv"

    @property
    def image_dir(self) -> str:
        return f"{self.data_dir}/all_images"

    @property
    def metrics_path(self) -> str:
        return f"{os.path.dirname(self.model_output)}/metrics"
