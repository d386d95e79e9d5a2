"""Job parameters given as text."""

from __future__ import annotations

from trackside.constants import FOCUS_DRIVERS


def parse_focus_drivers(text: str | None) -> dict[int, str]:
    """``"1:Name,44"`` to ``{1: "Name", 44: "Driver 44"}``; bad or empty text gives the default."""
    if not text:
        return dict(FOCUS_DRIVERS)
    chosen: dict[int, str] = {}
    for entry in text.split(","):
        number, colon, name = entry.partition(":")
        try:
            key = int(number)
        except ValueError:
            return dict(FOCUS_DRIVERS)
        chosen[key] = name.strip() if colon else f"Driver {key}"
    return chosen
