"""Diffs of sequences: deltas that turn one into the other."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column

from revstrata.functions.arrow import by_row
from revstrata.schemas import DELTAS

_OPS = {"delete": "DELETE", "insert": "INSERT", "replace": "CHANGE"}


def deltas(old: list[str], new: list[str]) -> list[dict]:
    """Deltas in order of position. Equal ends are set aside first, so that long texts with small edits cost little."""
    lo = 0
    while lo < min(len(old), len(new)) and old[lo] == new[lo]:
        lo += 1
    hi = 0
    while hi < min(len(old), len(new)) - lo and old[-1 - hi] == new[-1 - hi]:
        hi += 1
    a, b = old[lo : len(old) - hi], new[lo : len(new) - hi]
    out = []
    for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op != "equal":
            out.append({"op": _OPS[op], "orig_pos": lo + i, "orig": a[i:j], "rev_pos": lo + k, "rev": b[k:m]})
    return out


def patch(old: list[str], changes: list[dict]) -> list[str]:
    """The new sequence."""
    out, at = [], 0
    for d in changes:
        out += old[at : d["orig_pos"]] + list(d["rev"])
        at = d["orig_pos"] + len(d["orig"])
    return out + old[at:]


def _diff(old: list[str] | None, new: list[str] | None) -> list[dict]:
    return deltas(old or [], new or [])


def diff(old: Column | str, new: Column | str) -> Column:
    """Deltas between two arrays of strings; null counts as empty."""
    return by_row(_diff, DELTAS)(old, new)


def _patch(old: list[str] | None, changes: list[dict] | None) -> list[str]:
    return patch(old or [], changes or [])


def patched(old: Column | str, changes: Column | str) -> Column:
    """The array that the deltas make of the old one; null counts as empty."""
    return by_row(_patch, "array<string>")(old, changes)


def _rebuilt(old: list[str] | None, new: list[str] | None) -> list[str]:
    return patch(old or [], deltas(old or [], new or []))


def rebuilt(old: Column | str, new: Column | str) -> Column:
    """patched(old, diff(old, new)) in one function: deltas don't leave the Python worker, and a task has one worker, not two."""
    return by_row(_rebuilt, "array<string>")(old, new)
