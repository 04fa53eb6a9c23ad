"""Settings of a feed, passed to transforms as literals."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Keywords:
    roles: tuple[str, ...] = ()
    bonus: tuple[str, ...] = ()
    must_have: tuple[str, ...] = ()
    level_required: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    require_level: bool = True
    max_experience_years: int = 2


@dataclass(frozen=True)
class Pay:
    currency: str = "INR"
    min_remote: int = 30_000
    min_in_office: int = 80_000
    min_internship: int = 0
    drop_unknown: bool = False
    demote_unknown_in_office: bool = True
    rates: dict[str, float] = field(default_factory=lambda: {"USD": 83.0, "EUR": 90.0, "GBP": 105.0})

    @property
    def floors(self) -> dict[str, int]:
        return {"internship": self.min_internship, "remote": self.min_remote, "in_office": self.min_in_office}


@dataclass(frozen=True)
class Feed:
    keywords: Keywords = Keywords()
    pay: Pay = field(default_factory=Pay)
    locations: tuple[str, ...] = ()
    remote_preferred: bool = True
    grace_days: int = 3
    retire_days: int = 35
    announce_crosslisted: bool = False
