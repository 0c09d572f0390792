"""Rules as data: text patterns by intent, compatibility matrices, thresholds and bands."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

# Patterns of speed intents, in order of priority.
LONGITUDINAL = {
    "stop": (
        r"\bstop\b", r"\bstopping\b", r"\bcome to a stop\b", r"\bhalt\b", r"\bfull stop\b",
        r"\bbring .{0,20}to .{0,10}stop\b", r"\bemergency (stop|brake)\b", r"\bbrake hard\b",
    ),
    "slow_down": (
        r"\bslow(ing)? down\b", r"\bdecelerat\w*\b", r"\breduce speed\b", r"\bbrake\b", r"\bbraking\b", r"\bease off\b",
        r"\bcreep\b", r"\bcoast\b", r"\bcautious(ly)? approach\b", r"\bslow(er)? approach\b", r"\breduce .{0,10}pace\b",
        r"\blet off .{0,5}(gas|throttle)\b", r"\badapt speed\b", r"\badjust speed\b", r"\byield\w*\b",
    ),
    "maintain": (
        r"\bmaintain .{0,10}(speed|pace|velocity)\b", r"\bkeep .{0,10}(speed|pace|velocity)\b", r"\bcruise\b",
        r"\bhold .{0,10}speed\b", r"\bsteady (speed|pace)\b", r"\bconstant speed\b", r"\bproceed\b", r"\bcontinue\b",
        r"\bkeep .{0,15}(distance|gap)\b", r"\bmaintain .{0,15}(distance|gap|following)\b", r"\bsafe (distance|gap|following)\b",
    ),
    "accelerate": (
        r"\baccelerat\w*\b", r"\bspeed up\b", r"\bincrease speed\b", r"\bgo faster\b", r"\bpick up speed\b",
        r"\bgain speed\b", r"\bresume\b",
    ),
}

# Patterns of steering intents, in order of priority.
LATERAL = {
    "nudge_left": (
        r"\bnudge .{0,10}(to the )?left\b", r"\bshift .{0,10}(to the )?left\b", r"\bsteer .{0,5}left\b",
        r"\bveer .{0,5}left\b", r"\bmove .{0,10}(slightly )?(to the )?left\b", r"\badjust .{0,15}(to the )?left\b",
        r"\bswerve .{0,5}left\b", r"\boffset .{0,10}(to the )?left\b", r"\bleft.{0,3}hand curve\b", r"\bleft curve\b",
        r"\bcurve .{0,10}(to the )?left\b",
    ),
    "nudge_right": (
        r"\bnudge .{0,10}(to the )?right\b", r"\bshift .{0,10}(to the )?right\b", r"\bsteer .{0,5}right\b",
        r"\bveer .{0,5}right\b", r"\bmove .{0,10}(slightly )?(to the )?right\b", r"\badjust .{0,15}(to the )?right\b",
        r"\bswerve .{0,5}right\b", r"\boffset .{0,10}(to the )?right\b", r"\bright.{0,3}hand curve\b", r"\bright curve\b",
        r"\bcurve .{0,10}(to the )?right\b", r"\bright exit\b",
    ),
    "lane_change_left": (
        r"\b(change|switch) .{0,15}(to .{0,10})?left .{0,5}lane\b", r"\bmerge .{0,15}left\b", r"\bleft lane change\b",
        r"\bmove .{0,15}(to .{0,10})?left lane\b", r"\blane change .{0,10}(to the )?left\b", r"\bturn left\b",
    ),
    "lane_change_right": (
        r"\b(change|switch) .{0,15}(to .{0,10})?right .{0,5}lane\b", r"\bmerge .{0,15}right\b", r"\bright lane change\b",
        r"\bmove .{0,15}(to .{0,10})?right lane\b", r"\blane change .{0,10}(to the )?right\b", r"\bturn right\b",
        r"\bsplit .{0,10}(to the )?right\b",
    ),
    "hold_lane": (
        r"\bstay in .{0,15}lane\b", r"\bhold .{0,10}lane\b", r"\bkeep .{0,15}lane\b", r"\bmaintain .{0,15}lane\b",
        r"\bcenter .{0,15}lane\b", r"\bstay .{0,10}course\b", r"\bin the (same )?lane\b", r"\bthrough the intersection\b",
        r"\bstraight traffic light\b", r"\bfollow the (road|route)\b",
    ),
}

LONG_EXECUTIONS = ("stopped", "decelerating", "constant_speed", "accelerating")
LAT_EXECUTIONS = ("shift_left", "shift_right", "lane_change_left", "lane_change_right", "straight")

# Compatibility of intent (rows) with execution (columns in the order above).
LONG_COMPAT = {
    "stop": (1.0, 0.7, 0.0, 0.0),
    "slow_down": (0.5, 1.0, 0.1, 0.0),
    "maintain": (0.0, 0.3, 1.0, 0.3),
    "accelerate": (0.0, 0.0, 0.3, 1.0),
}
LAT_COMPAT = {
    "nudge_left": (1.0, 0.0, 0.6, 0.0, 0.2),
    "nudge_right": (0.0, 1.0, 0.0, 0.6, 0.2),
    "lane_change_left": (0.7, 0.0, 1.0, 0.0, 0.0),
    "lane_change_right": (0.0, 0.7, 0.0, 1.0, 0.0),
    "hold_lane": (0.2, 0.2, 0.0, 0.0, 1.0),
}

UNSPECIFIED = "unspecified"
# Hour buckets, right-open.
HOUR_BUCKETS = (("night", 0, 7), ("morning", 7, 11), ("midday", 11, 15), ("afternoon", 15, 19), ("evening", 19, 24))
# Hours of the download scenarios; scenarios that are not listed do not filter.
SCENARIO_HOURS = {"night": (0, 1, 2, 3, 4, 5, 20, 21, 22, 23), "clear": (10, 11, 12, 13, 14, 15)}
T0_LOW, T0_HIGH, T0_DEFAULT = 2_000_000, 13_000_000, 5_100_000
EGO_MIN_US, EGO_MAX_US = 300_000, 19_500_000


@dataclass(frozen=True)
class Thresholds:
    stopped: float = 0.5
    acceleration: float = 0.3
    shift: float = 0.2
    lane_change: float = 1.5


@dataclass(frozen=True)
class RuleSet:
    longitudinal: dict[str, tuple[str, ...]] = field(default_factory=lambda: LONGITUDINAL)
    lateral: dict[str, tuple[str, ...]] = field(default_factory=lambda: LATERAL)


def _without(rules: dict[str, tuple[str, ...]], gone: re.Pattern) -> dict[str, tuple[str, ...]]:
    return {k: tuple(p for p in v if not gone.search(p)) for k, v in rules.items()}


def fingerprint(*parts: object) -> str:
    """A short digest of rule sets or other plain data, in their order."""
    return hashlib.sha256(repr(parts).encode()).hexdigest()[:16]


CURRENT = RuleSet()
STRICT = RuleSet(_without(LONGITUDINAL, re.compile(r"adapt speed|adjust speed|yield|distance|gap")), _without(LATERAL, re.compile("curve")))
EXPANDED = RuleSet(
    LONGITUDINAL
    | {
        "stop": (*LONGITUDINAL["stop"], r"\bstops\b", r"\bstopped\b"),
        "slow_down": (*LONGITUDINAL["slow_down"], r"\bslows\b", r"\bslowing\b", r"\bbrakes\b"),
    },
    LATERAL,
)


def literal_of(pattern: str) -> str:
    """The longest text that every match of a pattern holds (outside groups, classes and repeats); may be empty."""
    plain = re.sub(r"\([^()]*\)\??", "\0", pattern)
    plain = re.sub(r"\\[bw]\*?|\.\{\d+,\d+\}", "\0", plain)
    return max(plain.split("\0"), key=len)
