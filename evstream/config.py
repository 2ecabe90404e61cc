"""Parameters of the engine. Defaults are fixed values that results depend on."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Sensor:
    width: int = 320
    height: int = 320


@dataclass(frozen=True)
class FrameConfig:
    """Live frames: one mono preview and one frame of three time windows."""

    three_channel: bool = True
    windows_ms: tuple[float, float, float] = (50.0, 250.0, 1000.0)
    mode: str = "cumulative"
    encoding: str = "bgr8"
    mono_topic: str = "frames/mono"
    three_channel_topic: str = "frames/windows"
    fps: float = 30.0
    window_ms: float = 100.0
    max_preview_packets: int = 10
    max_event_packets: int = 200
    contrast: float = 4.0
    step: float = 1.0
    blur_kernel: int = 2
    sort: bool = False

    def __post_init__(self) -> None:
        if self.mono_topic == self.three_channel_topic:
            raise ValueError("the mono and the three-channel frames need different names")
        if any(w <= 0 for w in self.windows_ms):
            raise ValueError("every channel window must be over 0")

    def checked(self) -> FrameConfig:
        """Unknown modes and encodings fall back to the defaults with a warning; shifted windows are put in ascending order."""
        out = self
        if out.mode not in ("cumulative", "shifted"):
            warnings.warn(f"unknown mode {out.mode}; cumulative is used", stacklevel=2)
            out = replace(out, mode="cumulative")
        if out.encoding not in ("bgr8", "rgb8"):
            warnings.warn(f"unknown encoding {out.encoding}; bgr8 is used", stacklevel=2)
            out = replace(out, encoding="bgr8")
        return replace(out, windows_ms=tuple(sorted(out.windows_ms))) if out.mode == "shifted" else out

    @property
    def max_packets(self) -> int:
        return self.max_event_packets if self.three_channel else self.max_preview_packets

    @property
    def history_ms(self) -> float:
        return max(self.window_ms, *self.windows_ms) if self.three_channel else self.window_ms


@dataclass(frozen=True)
class PreviewConfig:
    """The decaying preview."""

    fps: float = 30.0
    max_packets: int = 10
    window_ms: float = 100.0
    resize: int = 2
    decay: float = 0.94
    step: float = 0.75
    contrast: float = 10.0
    blur_kernel: int = 0
    sort: bool = False
    tune_seconds: float = 3.0

    def tag(self) -> str:
        """What a snapshot's file name says of its parameters."""
        return f"d{self.decay:.3f}_s{self.step:.3f}_c{self.contrast:.3f}_w{self.window_ms:.1f}_b{self.blur_kernel}_fps{self.fps:.1f}_sort{int(self.sort)}"


@dataclass(frozen=True)
class FlickerConfig:
    window_s: float = 4.0
    bin_us: int = 1000
    grid: int = 3
    center_hz: float = 240.0
    band_hz: float = 20.0
    min_hz: float = 40.0
    max_hz: float = 300.0
    update_hz: float = 2.0
    burst_k: float = 2.0
    burst_min: float = 30.0

    @property
    def bins(self) -> int:
        return int(round(self.window_s * 1_000_000 / self.bin_us))  # half to even


@dataclass(frozen=True)
class MotionConfig:
    radius_px: int = 6
    window_ms: float = 12.0
    min_neighbors: int = 2
    min_coherence: float = 0.45
    max_speed: float = 50.0  # pixels a millisecond
    support_only: bool = False

    @property
    def window_us(self) -> int:
        return int(self.window_ms * 1000)


@dataclass(frozen=True)
class PhaseConfig:
    tile_px: int = 16
    min_events: int = 50
    strength: float = 0.18
    bins: int = 64
    reach: int = 2


@dataclass(frozen=True)
class RecordingConfig:
    path: str = ""
    flush_every_packets: int = 50
    chunk_events: int = 100_000
    compression: str = "gzip"
    compression_level: int = 4
    source: str = "event camera"
    sensor: Sensor = field(default_factory=Sensor)

    @property
    def parquet(self) -> dict[str, str]:
        """Write options: the codec, its level, and chunk_events values a page, the unit that is compressed."""
        level = min(9, max(0, int(self.compression_level)))
        named = ("NO_COMPRESSION", "BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION")[level]
        levels = {"gzip": {"zlib.compress.level": named}, "zstd": {"parquet.compression.codec.zstd.level": str(max(1, level))}}
        return {"compression": self.codec, "parquet.page.row.count.limit": str(max(1, int(self.chunk_events)))} | levels.get(self.codec, {})

    @property
    def codec(self) -> str:
        """The Parquet codec: gzip, none, or snappy for lzf, which Parquet lacks; others fall back to gzip with a warning."""
        name = (self.compression or "").strip().lower()
        found = {"gzip": "gzip", "lzf": "snappy", "snappy": "snappy", "zstd": "zstd", "none": "none", "": "none"}.get(name)
        if found is None:
            warnings.warn(f"unknown compression {self.compression}; gzip is used", stacklevel=2)
        return found or "gzip"
