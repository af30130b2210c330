"""Configuration: frozen dataclasses with the YAML keys and defaults of the pipeline."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, get_type_hints

# fixed values: severities, incident types and their wording
SEVERITIES = ("P0", "P1", "P2", "P3", "P4")
SEVERITY_DESCRIPTIONS = {
    "P0": "platform-wide, immediate executive escalation required",
    "P1": "regional or high-profile, senior on-call required",
    "P2": "significant but contained, standard escalation",
    "P3": "low-volume emerging signal, monitoring mode",
    "P4": "informational, trend tracking only",
}
INCIDENT_TYPES = (
    "political_unrest",
    "natural_disaster",
    "platform_manipulation",
    "coordinated_harassment",
    "child_safety",
    "violent_extremism",
    "self_harm",
    "misinformation",
    "data_breach",
    "regulatory",
    "other",
)


@dataclass(frozen=True)
class Thresholds:
    p0_threshold: float = 0.95
    p1_threshold: float = 0.85
    p2_threshold: float = 0.70
    p3_threshold: float = 0.50

    def __post_init__(self):
        for f in fields(self):
            if not 0.0 <= getattr(self, f.name) <= 1.0:
                raise ValueError(f"{f.name} must lie between 0 and 1")

    def assign(self, score: float) -> str:
        cuts = (self.p0_threshold, self.p1_threshold, self.p2_threshold, self.p3_threshold)
        return next((s for s, c in zip(SEVERITIES, cuts) if score >= c), "P4")


@dataclass(frozen=True)
class Detection:
    enabled: bool = True
    languages: tuple[str, ...] = ("en", "es", "pt", "fr", "de")
    batch_size: int = 64
    dedup_window_seconds: int = 300
    min_confidence: float = 0.3
    thresholds: Thresholds = field(default_factory=Thresholds)


@dataclass(frozen=True)
class Provider:
    provider: str = "openai"
    model: str = "gpt-4o-mini"
    api_base: str | None = None
    api_key_env: str = "OPENAI_API_KEY"
    temperature: float = 0.1
    max_tokens: int = 1024
    timeout_seconds: int = 30
    max_retries: int = 3
    retry_base_delay: float = 1.0
    retry_max_delay: float = 30.0


@dataclass(frozen=True)
class Classification:
    llm: Provider = field(default_factory=Provider)
    confidence_threshold: float = 0.6
    max_labels: int = 3
    boosted_prompt_iterations: int = 3
    golden_set_path: str | None = None


@dataclass(frozen=True)
class Reports:
    format: str = "markdown"
    include_raw_signals: bool = False
    max_signals_per_report: int = 50
    handover_lookback_hours: int = 8


@dataclass(frozen=True)
class Webhook:
    url: str = ""
    secret: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    timeout_seconds: float = 10.0
    max_retries: int = 3
    retry_base_delay: float = 1.0


@dataclass(frozen=True)
class Notifications:
    enabled: bool = False
    webhooks: tuple[Webhook, ...] = ()
    min_severity: str = "P2"


@dataclass(frozen=True)
class Config:
    detection: Detection = field(default_factory=Detection)
    classification: Classification = field(default_factory=Classification)
    reports: Reports = field(default_factory=Reports)
    notifications: Notifications = field(default_factory=Notifications)
    max_concurrent_tasks: int = 16
    pipeline_timeout_seconds: int = 300

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """From YAML; an empty file gives the defaults, a missing one raises FileNotFoundError, unknown keys are ignored."""
        import yaml

        with open(path, encoding="utf8") as f:
            return _build(cls, yaml.safe_load(f) or {})

    def save(self, path: str | Path) -> None:
        import yaml

        with open(path, "w", encoding="utf8") as f:
            yaml.safe_dump(_plain(asdict(self)), f, sort_keys=False)


def _plain(x: Any) -> Any:
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def _build(cls: type, values: dict[str, Any]) -> Any:
    hints, out = get_type_hints(cls), {}
    for f in fields(cls):
        if f.name not in values:
            continue
        v, hint = values[f.name], hints[f.name]
        if is_dataclass(hint):
            v = _build(hint, v or {})
        elif f.name == "webhooks":
            v = tuple(_build(Webhook, w) for w in v or ())
        elif isinstance(v, list):
            v = tuple(v)
        out[f.name] = v
    return cls(**out)
