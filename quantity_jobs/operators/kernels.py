"""The few cores whose result depends on row order. Spark groups and sorts; these scan one group's arrays."""

from __future__ import annotations

import math
import json
import re
from itertools import combinations

import numpy as np


def greedy_pairs(left: np.ndarray, right: np.ndarray, shared: bool = False) -> np.ndarray:
    """Mask of the candidate rows that a scan in the given order takes: each left and each right id once; with `shared` both
    sides draw on one set of ids."""
    used_left: set = set()
    used_right = used_left if shared else set()
    taken = np.zeros(len(left), bool)
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        if a not in used_left and b not in used_right:
            taken[k] = True
            used_left.add(a)
            used_right.add(b)
    return taken


def greedy_suppress(values: np.ndarray, share: float) -> np.ndarray:
    """Mask of the values kept by a scan that drops whatever lies within the share of a kept one (relative to the larger)."""
    kept: list[float] = []
    out = np.zeros(len(values), bool)
    for k, v in enumerate(values.tolist()):
        near = any(max(v, x) > 0 and abs(v - x) / max(v, x) <= share for x in kept)
        if not near:
            kept.append(v)
            out[k] = True
    return out


def first_match(lengths: np.ndarray, wanted: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted length in order the first place whose current length is within the gap, or a new place at the end. A
    match takes the wanted length at once. Gives the places, and for each place the last wanted row that hit it (-1: none)."""
    n = len(lengths)
    now = np.concatenate([lengths.astype(float), np.zeros(len(wanted))])
    hit = np.full(len(now), -1)
    places = np.zeros(len(wanted), int)
    for row, value in enumerate(wanted.tolist()):
        close = np.flatnonzero(np.abs(now[:n] - value) < gap)
        place = int(close[0]) if len(close) else n
        n = max(n, place + 1)
        now[place], hit[place], places[row] = value, row, place
    return places, hit[:n]


def repair_json(text: str | None) -> tuple[str | None, str]:
    """(JSON text or null, outcome) of a response that failed to parse: fences stripped, trailing commas dropped and open brackets closed;
    else whole wall objects are picked out; else it goes to quarantine."""
    if not text or not text.strip():
        return None, "empty"
    body = re.sub(r"^```[a-z]*\s*|\s*```$", "", text.strip())
    starts = [k for k in (body.find("{"), body.find("[")) if k >= 0]
    if not starts:
        return None, "quarantine"
    body = body[min(starts) :]
    stack, inside, escaped, stop = [], False, False, len(body)
    for k, c in enumerate(body):
        if inside:
            escaped = c == "\\" and not escaped
            inside = c != '"' or escaped is True or body[k - 1 : k] == "\\" and not _even_slashes(body, k)
            continue
        if c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
            if not stack:
                stop = k + 1
                break
    fixed = body[:stop] + ('"' if inside else "")
    fixed = re.sub(r"[,:]\s*$", "", fixed) + "".join(reversed(stack))
    fixed = re.sub(r",(\s*[}\]])", r"\1", fixed)
    try:
        return json.dumps(json.loads(fixed), ensure_ascii=False), "repaired"
    except ValueError:
        pass
    walls = []
    for found in re.findall(r"\{[^{}]*\"wall_id\"[^{}]*\}", body):
        try:
            walls.append(json.loads(found))
        except ValueError:
            continue
    return (json.dumps({"walls": walls}, ensure_ascii=False), "recovered") if walls else (None, "quarantine")


def _even_slashes(body: str, k: int) -> bool:
    n = 0
    while k - n > 0 and body[k - n - 1] == "\\":
        n += 1
    return n % 2 == 0


def fuse_touching(lines: list[list], angle: float, touch: float) -> list[list]:
    """Lines (x1, y1, x2, y2, members): the first takes in, in order and again until none fits, every other that is within angle of what it has become and has an end closer than touch
    to one of its own; the farthest two of the four ends remain. Then the next that is left does the same."""

    def direction(z: list) -> float:
        return math.degrees(math.atan2(z[3] - z[1], z[2] - z[0])) % 180

    def fits(a: list, b: list) -> bool:
        turn = abs(direction(a) - direction(b))
        return min(turn, 180 - turn) <= angle and min(math.dist(p, q) for p in (a[:2], a[2:4]) for q in (b[:2], b[2:4])) < touch

    def fused(a: list, b: list) -> list:
        p, q = max(combinations((a[:2], a[2:4], b[:2], b[2:4]), 2), key=lambda pair: math.dist(*pair))
        return [*p, *q, a[4] + b[4]]

    waiting, done = list(lines), []
    while waiting:
        own, waiting = waiting[0], waiting[1:]
        grown = True
        while grown:
            grown, left = False, []
            for other in waiting:
                if fits(own, other):
                    own, grown = fused(own, other), True
                else:
                    left.append(other)
            waiting = left
        done.append(own)
    return done
