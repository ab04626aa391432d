"""Scene parameters. All times are integer microseconds."""

from dataclasses import dataclass, field

from tracklens import constants as K


@dataclass(frozen=True)
class SceneConfig:
    step_us: int = 10 * K.MICROS
    stale_us: int = 30 * K.MICROS
    history_steps: int = 12
    horizons_us: tuple[int, ...] = (30 * K.MICROS, 120 * K.MICROS, 300 * K.MICROS)
    min_aircraft: int = 3
    max_aircraft: int | None = None  # no cap unless a caller asks for one
    horizontal_m: float = K.PROXIMITY_HORIZONTAL_M
    vertical_m: float = K.PROXIMITY_VERTICAL_M
    # (youngest age, oldest age, preferred age) of the two earlier states
    prior_near_us: tuple[int, int, int] = (20 * K.MICROS, 45 * K.MICROS, 30 * K.MICROS)
    prior_far_us: tuple[int, int, int] = (45 * K.MICROS, 90 * K.MICROS, 60 * K.MICROS)
    time_scale: int = 1
    centers: dict = field(default_factory=lambda: dict(K.AIRPORT_CENTERS))

    def __post_init__(self):
        if self.step_us <= 0 or self.history_steps <= 0 or self.stale_us < 0:
            raise ValueError("step and history must be positive, staleness nonnegative")
        if self.min_aircraft < 2 or (self.max_aircraft is not None and self.max_aircraft < self.min_aircraft):
            raise ValueError("a scene needs two aircraft at least, and its cap must not be below that")
        if not self.horizons_us or any(h <= 0 for h in self.horizons_us):
            raise ValueError("horizons must be positive")
        if not (0 < self.horizontal_m < float("inf") and 0 < self.vertical_m < float("inf")):
            raise ValueError("proximity thresholds must be finite and positive")

    @property
    def carry_steps(self) -> int:
        """Whole steps a report stays usable."""
        return self.stale_us // self.step_us

    def horizon_steps(self, horizon_us: int) -> int:
        return horizon_us // self.step_us

    def scaled(self, factor: int) -> "SceneConfig":
        """The same protocol on a clock that runs `factor` times slower."""
        return SceneConfig(
            step_us=self.step_us * factor,
            stale_us=self.stale_us * factor,
            history_steps=self.history_steps,
            horizons_us=tuple(h * factor for h in self.horizons_us),
            min_aircraft=self.min_aircraft,
            max_aircraft=self.max_aircraft,
            horizontal_m=self.horizontal_m,
            vertical_m=self.vertical_m,
            prior_near_us=tuple(v * factor for v in self.prior_near_us),
            prior_far_us=tuple(v * factor for v in self.prior_far_us),
            time_scale=self.time_scale * factor,
            centers=self.centers,
        )


# The event table is sparse, so its queries run the protocol at 60 times the published time constants.
EVENT_CONFIG = SceneConfig().scaled(60)
