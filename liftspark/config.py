"""Business constants: thresholds, vocabularies, feature list.

Everything here is plain driver-side data. Operators inline it as literals, so a
changed threshold changes the plan and nothing has to be shipped to executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---- Fixed values: vocabularies -------------------------------------------------
PLATFORMS = ("tiktok", "instagram", "youtube")
CREATOR_TIERS = ("nano", "micro", "mid", "macro", "mega")
CATEGORIES = (
    "apparel",
    "beauty",
    "electronics",
    "home",
    "fitness",
    "food",
    "toys",
    "accessories",
)
RISK_TIERS = ("CRITICAL", "WARNING", "WATCH", "NORMAL")
ALERT_STATUSES = ("PENDING", "APPROVED", "DISMISSED")
SUPPRESSED = "SUPPRESSED"  # own status of alerts the hourly cap held back

# ---- Fixed values: encodings (ordinal, with the value used for anything else) ----
PLATFORM_CODES = {"tiktok": 0, "instagram": 1, "youtube": 2}
PLATFORM_DEFAULT = 0
CREATOR_TIER_CODES = {"nano": 0, "micro": 1, "mid": 2, "macro": 3, "mega": 4}
CREATOR_TIER_DEFAULT = 1

# ---- Fixed values: scores --------------------------------------------------------
SCORE_WEIGHTS = {"save_rate": 2.0, "share_rate": 3.0, "click_rate": 5.0}
PRESSURE_NORM = 0.20
VELOCITY_ROWS = 3
BADGE_FLOORS = (("MEGA", 0.20), ("HIGH", 0.10), ("MODERATE", 0.05))
BADGE_DEFAULT = "LOW"
VIDEO_TIER_FLOORS = (("CRITICAL", 3.0), ("WARNING", 2.0), ("WATCH", 1.5))
TIER_WEIGHTS = {"CRITICAL": 4.0, "WARNING": 3.0, "WATCH": 2.0, "NORMAL": 1.0}
TIER_ORDER = {"CRITICAL": 1, "WARNING": 2, "WATCH": 3, "NORMAL": 4}
INVENTORY_WATCH_DAYS = 30.0
TRENDING_SIZE = 50
TRENDING_PAGE_MAX = 100
TOP_VIDEOS_PER_SKU = 5
SNAPSHOT_HORIZON_HOURS = 48
SAFETY_STOCK_DAYS = 3
MIN_EFFECTIVE_LIFT = 0.01
NO_DEMAND_COVER_DAYS = 9999.0
FRESHNESS_WARN_HOURS = 24
FRESHNESS_ERROR_HOURS = 72

# ---- Fixed values: learning ------------------------------------------------------
FEATURE_COLUMNS = (
    "save_velocity",
    "share_rate",
    "cart_rate",
    "like_rate",
    "click_rate",
    "views_delta_1h",
    "saves_delta_1h",
    "shares_delta_1h",
    "hours_since_post",
    "is_on_foryou",
    "has_link_in_bio",
    "video_duration_s",
    "creator_tier_encoded",
    "sku_viral_sensitivity",
    "platform_encoded",
)
LABEL = "demand_lift_24h"
QUANTILES = {"p10": 0.10, "p50": 0.50, "p90": 0.90}
LIFT_COLUMNS = ("p10_demand_lift", "p50_demand_lift", "p90_demand_lift")


@dataclass(frozen=True)
class TierRule:
    """One row of the risk table: lift floor, cover ceiling, lead-time slack, action."""

    lift_min: float
    cover_max_days: float
    lead_buffer_days: int | None
    action: str


@dataclass(frozen=True)
class RiskConfig:
    """Thresholds of the SKU tiers, triage and alert throttling. Fixed values."""

    critical: TierRule = TierRule(3.0, 7, 0, "draft_purchase_order")
    warning: TierRule = TierRule(2.0, 14, 2, "draft_alert")
    watch: TierRule = TierRule(1.5, 30, None, "log_and_recheck")
    normal_action: str = "none"
    trigger_lift: float = 1.5
    max_alerts_per_hour: int = 20
    cooldown_hours: int = 4

    def with_values(self, **changes) -> RiskConfig:
        return replace(self, **changes)


@dataclass(frozen=True)
class BoostConfig:
    """Hyper-parameters of the quantile learner. Fixed values down to ``patience``."""

    rounds: int = 500
    learning_rate: float = 0.05
    max_depth: int = 6
    min_rows_per_leaf: int = 20
    subsample: float = 0.8
    column_share: float = 0.8  # of the features each tree may use
    l1: float = 0.1
    l2: float = 0.1
    subsample_rounds: int = 5  # rounds that share one sample
    patience: int = 50
    train_ratio: float = 0.8
    seed: int = 42
    cut_every: int = 10  # rounds between writes that cut the lineage
    features: tuple[str, ...] = field(default=FEATURE_COLUMNS)
