"""Company pattern files: loading on the driver, no Spark work."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml


@dataclass(frozen=True)
class PatternConfig:
    """One company's patterns; every section may be missing."""

    raw: dict[str, Any] = field(default_factory=dict)

    def require(self, *sections: str) -> "PatternConfig":
        missing = [name for name in sections if name not in self.raw]
        if missing:
            raise ValueError(f"pattern configuration lacks section(s): {', '.join(missing)}")
        return self

    @property
    def company_name(self) -> str:
        return self.raw.get("company_name") or ""

    @property
    def link_selectors(self) -> list[dict[str, Any]]:
        return self.raw.get("job_url_selectors") or []

    @property
    def url_validation(self) -> dict[str, Any]:
        return self.raw.get("url_validation") or {}

    @property
    def pagination(self) -> dict[str, Any]:
        return self.raw.get("pagination") or {}

    @property
    def extraction(self) -> dict[str, Any]:
        """The page-extraction part: its own section, else the whole file."""
        return self.raw.get("html_extraction", self.raw) or {}

    def section(self, name: str) -> dict[str, Any]:
        return self.extraction.get(name) or {}

    def field_rule(self, section: str, name: str) -> Any:
        return self.section(section).get(name)


def load_patterns(source: str | Path | dict[str, Any]) -> PatternConfig:
    """Read a YAML pattern file (or take an already parsed mapping)."""
    if isinstance(source, dict):
        return PatternConfig(source)
    path = Path(source)
    try:
        parsed = yaml.safe_load(path.read_text(encoding="utf-8"))
    except FileNotFoundError as err:
        raise ValueError(f"pattern file not found: {path}") from err
    except yaml.YAMLError as err:
        raise ValueError(f"pattern file is not valid YAML: {path}: {err}") from err
    if not isinstance(parsed, dict):
        raise ValueError(f"pattern file must hold a mapping: {path}")
    return PatternConfig(parsed)
