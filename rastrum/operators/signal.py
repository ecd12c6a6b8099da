"""Signal state: what each unit shows, confirmed over runs of units, and what the source does.

One row a unit goes through a small machine for each stream; the streaming form keeps the same
machine as state, so both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame

#: Units that confirm a label or a source state.
APPEARANCE, ACQUISITION, MUTE = 2, 5, 3
HELD = 0.5
LABEL_RUNS = {"program": ACQUISITION, "snow": ACQUISITION, "gray_mute": MUTE, "subblack_mute": MUTE, "no_signal": MUTE}
SOURCES = {"program": "present", "snow": "reacquiring", "gray_mute": "muted", "subblack_mute": "muted", "no_signal": "no_input"}
SOURCE_RUNS = {"muted": MUTE, "no_input": MUTE, "unknown": APPEARANCE}
AT_ONCE = ("no_signal", "subblack_mute")


@dataclass
class Signal:
    """Confirmed appearance and source of one stream; `step` takes a unit's transport, instantaneous label and confidence."""

    label: str = "unknown"
    label_confidence: float = 0.0
    candidate: str = ""
    candidate_n: int = 0
    candidate_confidence: float = 0.0
    source: str = "unknown"
    target: str = ""
    target_n: int = 0
    acquiring: bool = False
    unsettled: bool = False
    interval: int = 0
    serial: int = 0

    def _open(self) -> None:
        if not self.unsettled:
            self.serial += 1
            self.unsettled, self.interval = True, self.serial

    def step(self, transport: str, label: str | None, confidence: float | None, muted_osd: bool = False) -> dict:
        """label None: a whole unit that can't be measured. Units cut, damaged or unframed say nothing of the picture."""
        broken = transport in ("hole", "short", "unframed")
        blind = broken or label is None
        if blind:
            self._open()
        seen, sure = ("unknown", 0.0) if blind else (label, confidence or 0.0)
        if seen == self.candidate:
            self.candidate_n, self.candidate_confidence = self.candidate_n + 1, min(self.candidate_confidence, sure)
        else:
            self.candidate, self.candidate_n, self.candidate_confidence = seen, 1, sure
        if blind or seen in AT_ONCE or seen == self.label:
            self.label, self.label_confidence = seen, sure
        elif self.candidate_n >= max(APPEARANCE, LABEL_RUNS.get(seen, APPEARANCE)):
            self.label, self.label_confidence = seen, self.candidate_confidence
        # The source follows the unit's own label, so that confirmation isn't paid twice.
        target = "muted" if seen == "flat_ambiguous" and muted_osd else SOURCES.get(seen, "unknown")
        self.target_n = self.target_n + 1 if target == self.target else 1
        self.target = target
        needed = max(APPEARANCE, SOURCE_RUNS.get(target, ACQUISITION))
        begins = False
        if blind:
            self.source, self.target, self.target_n = "unknown", "unknown", 1
        elif seen == "subblack_mute" or self.target_n >= needed:
            changed, self.source = target != self.source, target
            if changed:
                self._open()
                if target in ("reacquiring", "present"):
                    begins = target == "reacquiring" or not self.acquiring
                    self.acquiring = True
                else:
                    self.acquiring = False
                    # A confirmed state without a picture is settled.
                    self.unsettled = self.unsettled and target == "unknown"
        if self.serial == 0 and self.source == "unknown":
            self._open()
        trust = 0.0 if self.source == "unknown" else min(1.0, self.target_n / needed) if target == self.source else HELD
        return {"appearance": self.label, "appearance_confidence": self.label_confidence, "source": self.source, "source_confidence": trust, "begins_segment": begins, "discontinuity": broken, "unsettled": self.unsettled, "interval": self.interval}


DECISION = "appearance string, appearance_confidence double, source string, source_confidence double, begins_segment boolean, discontinuity boolean, unsettled boolean, interval long"
STATE = "label string, label_confidence double, candidate string, candidate_n long, candidate_confidence double, source string, target string, target_n long, acquiring boolean, unsettled boolean, interval long, serial long"


def _rows(machine: Signal, pdf: pd.DataFrame, keys: list[str], order: str) -> pd.DataFrame:
    out = []
    for r in pdf.sort_values(order).to_dict("records"):
        label = r["label"] if isinstance(r["label"], str) else None
        sure = r["confidence"] if r["confidence"] == r["confidence"] else None
        out.append({k: r[k] for k in (*keys, order)} | machine.step(r["transport"], label, sure))
    return pd.DataFrame(out)


def _schema(df: DataFrame, keys: list[str], order: str) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in (*keys, order)) + ", " + DECISION


def classify(units: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, order and the decision for each unit; units: keys, order, transport, label, confidence."""
    return units.groupBy(*keys).applyInPandas(lambda pdf: _rows(Signal(), pdf, keys, order), _schema(units, keys, order))


def classify_stream(units: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The same over a stream whose rows come in order; the machine is the state of each key."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        machine = Signal(**dict(zip(asdict(Signal()), state.get, strict=True))) if state.exists else Signal()
        rows = pd.concat(list(parts))
        if len(rows):
            yield _rows(machine, rows, keys, order)
        state.update(tuple(asdict(machine).values()))

    return units.groupBy(*keys).applyInPandasWithState(run, _schema(units, keys, order), STATE, "append", "NoTimeout")
