"""Driver-side settings: the analysis section of a YAML file, and detection data sets."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from pathlib import Path

import yaml

PARTS = ("train", "val")


def load_config(path: str, section: str = "ai") -> dict:
    """A section of a YAML file; nothing where the file or the section is missing."""
    file = Path(path)
    return ((yaml.safe_load(file.read_text(encoding="utf-8")) or {}) if file.exists() else {}).get(section) or {}


@dataclass(frozen=True)
class TrainingConfig:
    """Recorded with a data set; training itself happens elsewhere."""

    epochs: int = 100
    imgsz: int = 640
    batch: int = 16
    patience: int = 50
    workers: int = 4
    degrees: float = 0.0
    flipud: float = 0.0


@dataclass(frozen=True)
class DetectionDataset:
    root: Path
    classes: tuple[str, ...]

    def folders(self) -> list[Path]:
        return [self.root / kind / part for kind in ("images", "labels") for part in PARTS]

    def build(self) -> None:
        for folder in self.folders():
            folder.mkdir(parents=True, exist_ok=True)

    def write(self, training: TrainingConfig | None = None) -> Path:
        data = {"path": str(self.root.resolve()), **{p: f"images/{p}" for p in PARTS}, "names": dict(enumerate(self.classes))}
        path = self.root / "data.yaml"
        path.write_text(yaml.safe_dump(data | ({"training": asdict(training)} if training else {}), sort_keys=False, allow_unicode=True), encoding="utf-8")
        return path

    def validate(self) -> None:
        if missing := [str(f) for f in self.folders() if not f.is_dir()]:
            raise ValueError(f"missing folders: {', '.join(missing)}")
        if not any((self.root / "images/train").iterdir()):
            raise ValueError("no training images")
