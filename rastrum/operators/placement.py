"""Placement: which rows of a unit are its picture, decided frame by frame, and where frames go in time.

The machines here see one narrow row a frame; everything that reads pixels has been done before
and in parallel (raster.geometry). One stream (capture and epoch) is one sequential chain.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import comb_basin

FIELD, TOP1, TOP2 = 263, 23, 286
SLOT = 8008


@dataclass(frozen=True)
class Policy:
    """Thresholds of the placement decision."""

    reject: float = 2.0
    basin: float = 1.5
    window: int = 30
    alike: float = 0.6
    rigid_least: int = 2
    rigid_clarity: float = 1.3

    def __post_init__(self):
        if not (self.reject > 0 and self.basin >= 1 and self.window >= 1 and -1 <= self.alike <= 1 and self.rigid_least >= 1 and self.rigid_clarity >= 1):
            raise ValueError("thresholds out of range")


@dataclass(frozen=True)
class Correction:
    """What combing taught about two tops: the distance between the fields is this much more than the tops say."""

    tops: tuple[int, int]
    amount: int
    sure: bool  # a second frame has said so


@dataclass(frozen=True)
class Proposal:
    """The distance between the fields that a frame's edges propose."""

    tops: tuple[int, int] | None  # both first lines, if both are known
    between: int | None  # the tops' own distance
    distance: int | None
    source: str


@dataclass(frozen=True)
class Evidence:
    """Why combing is asked, and what may overrule it."""

    triggers: frozenset[str]
    motion: str | None
    still: bool
    suppressed: bool

    @property
    def asked(self) -> bool:
        return bool(self.triggers)

    @property
    def counts(self) -> bool:
        return self.asked and not self.suppressed


class Placer:
    """Placement of one stream's frames in order; `step` takes a frame's row and gives its decision.

    A frame goes through three stages: its edges propose a distance, evidence is gathered for
    or against it, a verdict is given. Between frames live the correction that combing last
    made, what was published last, and the votes for the second field's place.
    """

    def __init__(self, policy: Policy | None = None):
        self.policy = policy or Policy()
        self.anchor, self.voted = 0, False
        self.reset()

    def reset(self) -> None:
        """A break in the stream: evidence is forgotten, the anchor stays."""
        self.correction: Correction | None = None
        self.published: tuple[int, int] | None = None  # distance and second field's place
        self.votes: list[int] = []

    def propose(self, frame: dict) -> Proposal:
        tops = frame["f1"]["first"], frame["f2"]["first"]
        if not all(tops):
            return Proposal(None, None, None, "previous" if self.published else "start")
        between = tops[1] - FIELD - tops[0]
        extra = self.correction.amount if self.correction and self.correction.tops == tops else 0
        return Proposal(tops, between, between + extra, "held" if extra else "census")

    def gather(self, frame: dict, proposed: Proposal) -> Evidence:
        fields = frame["f1"], frame["f2"]
        ends = [f["last"] for f in fields]
        said = {
            "basis": self.correction is not None and self.correction.tops != (fields[0]["first"], fields[1]["first"]),
            "unmeasurable": proposed.tops is None or not all(ends) or not all(f["bottom"] for f in fields),
        }
        if proposed.tops:
            # A picture's first and last lines lie as far apart as its fields do, or one line less.
            apart = [proposed.between] + ([ends[1] - FIELD - ends[0]] if all(ends) else [])
            said["distance"] = any(proposed.distance - x not in (0, 1) for x in apart)
            said["confirm"] = self.correction is not None and not self.correction.sure and not said["basis"]
            # A motion that wasn't measured calls for the comb as any odd one does.
            said |= {f"field{k}": f["motion"] not in ("nothing", "valid move") for k, f in enumerate(fields, 1)}
        shifts = [f["shift"] for f in fields]
        motion = None if None in shifts else "moving" if any(shifts) else "still"
        still = motion == "still" and self._combs(frame, proposed.distance if proposed.tops else self._last()[0], self.policy.reject)
        triggers = frozenset(k for k, v in (said | {"still": still}).items() if v)
        return Evidence(triggers, motion, still, bool(triggers) and motion == "moving" and all(map(self._rigid, fields)))

    def _last(self) -> tuple[int, int]:
        return self.published or (0, 0)

    def _basin(self, frame: dict, distance: int) -> dict:
        return comb_basin({"shift": frame["comb_shift"], "energies": list(frame["comb_energies"])}, distance, self.policy.basin)

    def _combs(self, frame: dict, distance: int, least: float) -> bool:
        """Whether a distance combs in a frame whose comb has one clear basin."""
        seen = self._basin(frame, distance)
        return bool(seen["basin"]) and seen["ratio"] is not None and seen["ratio"] >= least

    def _rigid(self, field_: dict) -> bool:
        dx, dy, clarity = field_["rigid_dx"], field_["rigid_dy"], field_["rigid_clarity"]
        return dx == 0 and dy is not None and abs(dy) >= self.policy.rigid_least and clarity >= self.policy.rigid_clarity

    def step(self, frame: dict) -> dict:
        proposed = self.propose(frame)
        evidence = self.gather(frame, proposed)
        if "basis" in evidence.triggers:
            self.correction = None
        distance, source = proposed.distance, proposed.source
        if evidence.counts and frame["comb_decided"]:
            distance, source = frame["comb_shift"], "comb"
            self.correction = self._corrected(proposed, distance)
        if distance is None:
            distance = self._last()[0]
        second = frame["f2"]["first"] - TOP2 if frame["f2"]["first"] else self._last()[1]
        seen = self._basin(frame, distance)
        rejected = evidence.counts and seen["ratio"] is not None and seen["ratio"] > self.policy.reject
        discarded = rejected and not seen["basin"]
        if rejected:
            self.correction = None
        if discarded:
            source = "discard_previous" if self.published else "discard_start"
            distance, second = self._last()
        elif rejected:
            distance, source = frame["comb_shift"], "comb_rejection"
        self.published = distance, second
        confident = self._vote(frame, seen)
        return {
            "d1": self.anchor - distance, "d2": self.anchor, "between": distance, "engine_d2": second, "held": self.correction.amount if self.correction else 0, "triggers": "+".join(sorted(evidence.triggers)),
            "comb_ran": evidence.asked, "comb_suppressed": evidence.suppressed, "still_trigger": evidence.still, "rejected": rejected, "discarded": discarded, "relative_source": source,
            "picture_motion": evidence.motion, "vote_confident": confident, "vote_count": len(self.votes), "vote_winner_count": max((self.votes.count(v) for v in self.votes), default=0),
        }

    def _corrected(self, proposed: Proposal, distance: int) -> Correction | None:
        """The correction after combing has decided: one that says the same twice running, or nothing new, is sure."""
        if proposed.tops is None:
            return None
        before, amount = self.correction, distance - proposed.between
        doubted = before is not None and not before.sure
        return Correction(proposed.tops, amount, doubted or amount == (before.amount if before else 0))

    def _vote(self, frame: dict, seen: dict) -> bool:
        """A confident frame votes for its second field's place; the mode of the window is the anchor."""
        t1, t2 = frame["vote_top1"], frame["vote_top2"]
        placed = bool(t1 and t2) and seen["basin"] and seen["floor_lo"] <= t2 - FIELD - t1 <= seen["floor_hi"] + 1
        sure = placed and frame["vote_alike"] is not None and frame["vote_alike"] >= self.policy.alike and not frame["vote_spot"]
        if sure:
            self.votes = [*self.votes, t2 - TOP2][-self.policy.window :]
        if self.votes:
            self.anchor = mode_vote(self.votes, self.anchor)
        elif not self.voted:
            self.anchor = 0
        self.voted = True
        return sure


def mode_vote(votes: list[int], anchor: int) -> int:
    """The most frequent vote; among equals the present anchor, else the latest vote, else the first in the window."""
    most = max(votes.count(v) for v in votes)
    best = [v for v in votes if votes.count(v) == most]
    return anchor if anchor in best else votes[-1] if votes[-1] in best else best[0]


DECISION = "d1 int, d2 int, between int, engine_d2 int, held int, triggers string, comb_ran boolean, comb_suppressed boolean, still_trigger boolean, rejected boolean, discarded boolean, relative_source string, picture_motion string, vote_confident boolean, vote_count int, vote_winner_count int"


def decide(frames: DataFrame, keys: list[str], counter: str = "counter_extended", policy: Policy | None = None) -> DataFrame:
    """keys, counter and the decision for each of raster.geometry's rows; a counter that isn't one on resets."""
    policy = policy or Policy()
    names = [*keys, counter]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        placer, rows, at = Placer(policy), [], None
        for r in pdf.sort_values(counter).to_dict("records"):
            r = {k: None if isinstance(v, float) and v != v else v for k, v in r.items()}
            r["f1"], r["f2"] = ({k: None if isinstance(v, float) and v != v else v for k, v in r[f].items()} for f in ("f1", "f2"))
            if at is None or r[counter] != at + 1:
                placer.reset()
            at = r[counter]
            rows.append({n: r[n] for n in names} | placer.step(r))
        return pd.DataFrame(rows)

    ddl = ", ".join(f"`{n}` {frames.schema[n].dataType.simpleString()}" for n in names) + ", " + DECISION
    return frames.groupBy(*keys).applyInPandas(run, ddl)


# --- time ----------------------------------------------------------------------------------------------


def audio_times(frames: list[dict]) -> list[tuple[int, bool]]:
    """Ticks of each frame on the audio's clock, and whether they are estimated by the counter's steps."""
    out, before = [], None
    for f in frames:
        if f["audio_pts_known"]:
            t, guess = f["audio_pts_num"], False
        elif before is None:
            t, guess = f["pts_num"] * 240_000 // f["pts_den"], True
        else:
            t, guess = before[1] + (f["counter"] - before[0]) * SLOT, True
        before = (f["counter"], t)
        out.append((t, guess))
    return out


def slot_spans(frames: list[dict], units: list[dict] = (), lost: list[int] | None = None, snap: float = 0.75, longest: int = 15) -> Iterator[tuple[int, int, int, int, int | None]]:
    """Frames that get a slot, in order: slot, distance from its time, frame's index, empty slots before it, and the index of the frame that these repeat (None: they stay empty).

    A frame takes the slot after the one before it by the time between them, unless that is over
    `snap` slots from its own time; of frames for one slot the nearer stays, and one for a slot
    already behind goes. A single empty slot repeats the frame before it, unless a lost counter
    lies between; 2 to `longest` do if only a loss of lock lies between. lost None: nothing is held.
    """
    gone = sorted({c % 65536 for c in lost or ()})

    def parted(a: int, b: int) -> bool:
        # The next lost counter after a, if any, is the one that may lie between.
        return bool(gone) and 0 < (gone[bisect_right(gone, a % 65536) % len(gone)] - a) % 65536 < (b - a) % 65536

    def lock_loss(a: dict, b: dict) -> bool:
        span = (b["counter"] - a["counter"]) % 65536
        ends = {a["counter"] % 65536, b["counter"] % 65536}
        near = [u for u in units if (a["line"] < u["line"] < b["line"] and u["counter"] % 65536 not in ends) or (u["line"] > a["line"] and 0 < (u["counter"] - a["counter"]) % 65536 < span)]
        whole = any(u["host_lost"] or u["kind"] < 0 or u["transport"] == 1 or (u["kind"] == 0 and u["transport"] == 0) for u in near)
        return not whole and any(u["kind"] == 1 for u in near) and not parted(a["counter"], b["counter"])

    placed: list[tuple[int, float, int]] = []  # slot, distance from it, frame
    start = before = None
    for i, (t, _) in enumerate(audio_times(frames)):
        start = t if start is None else start
        x = (t - start) / SLOT
        s = round(x)
        if before is not None:
            k = before[0] + round((t - before[1]) / SLOT)
            s = k if abs(k - x) <= snap else s
        s = max(0, s)
        before, off = (s, t), abs(t - start - s * SLOT)
        if not placed or s > placed[-1][0]:
            placed.append((s, off, i))
        elif s == placed[-1][0] and off < placed[-1][1]:
            placed[-1] = (s, off, i)
    behind = -1
    for n, (s, off, i) in enumerate(placed):
        empty, behind = s - behind - 1, s
        a = placed[n - 1][2] if n and empty else None
        hold = a is not None and lost is not None and (not parted(frames[a]["counter"], frames[i]["counter"]) if empty == 1 else empty <= longest and lock_loss(frames[a], frames[i]))
        yield s, int(off), i, empty, a if hold else None


def place_slots(frames: list[dict], units: list[dict] = (), lost: list[int] | None = None, snap: float = 0.75, longest: int = 15) -> list[dict]:
    """Output slots in order: kind (frame, held, fill) and the frame's index that fills each."""
    out: list[dict] = []
    for s, off, i, empty, held in slot_spans(frames, units, lost, snap, longest):
        out += [{"slot": k, "kind": "fill" if held is None else "held", "frame": held, "off_ticks": None} for k in range(s - empty, s)]
        out.append({"slot": s, "kind": "frame", "frame": i, "off_ticks": off})
    return out


def schedule(frames: DataFrame, units: DataFrame | None = None, key: str = "capture_id", hold: bool = True) -> DataFrame:
    """key, slot, kind, counter, off_ticks of each capture's output; frames: a replay's V rows with their line number.

    A capture's frames are placed in order by one task; the slots between them, which may be many more, are made of a row a frame.
    """
    columns = [("name", pa.string()), ("slot", pa.int64()), ("off", pa.int64()), ("counter", pa.int64()), ("empty", pa.int64()), ("held", pa.bool_()), ("repeats", pa.int64())]

    def run(k: tuple, f: pa.Table, u: pa.Table) -> pa.Table:
        rows, seen = sorted(f.to_pylist(), key=lambda r: r["line"]), u.to_pylist()
        name = k[0].as_py()
        found = [
            (name, s, off, rows[i]["counter"], empty, held is not None, None if held is None else rows[held]["counter"])
            for s, off, i, empty, held in slot_spans(rows, seen, [x["counter"] for x in seen if x["host_lost"]] if hold else None)
        ]
        return pa.table({c: pa.array([r[j] for r in found], t) for j, (c, t) in enumerate(columns)})

    if units is None:
        units = frames.sparkSession.createDataFrame([], f"{key} string, line long, counter long, format int, kind int, transport int, host_lost int")
    spans = frames.groupBy(key).cogroup(units.groupBy(key)).applyInArrow(run, "name string, slot long, off long, counter long, empty long, held boolean, repeats long")
    at, own = F.col("at"), F.col("at") == F.col("slot")
    each = spans.select("*", F.explode(F.sequence(F.col("slot") - F.col("empty"), F.col("slot"))).alias("at"))
    return each.select(
        F.col("name").alias(key), at.alias("slot"), F.when(own, "frame").when(F.col("held"), "held").otherwise("fill").alias("kind"),
        F.when(own, F.col("counter")).otherwise(F.col("repeats")).alias("counter"), F.when(own, F.col("off")).alias("off_ticks"),
    )


def monotonic(times: list[int | None], nominal: int) -> list[tuple[int, bool]]:
    """Times that only rise: an unknown one is `nominal` after the one before, one that doesn't rise is 1 after; and whether it is estimated."""
    out, last = [], None
    for t in times:
        guess = t is None
        t = (0 if last is None else last + nominal) if guess else t
        t = last + 1 if last is not None and t <= last else t
        last = t
        out.append((t, guess))
    return out
