"""Schema evolution: what changed between two field lists, and whether it may be applied.

Fields are compared by number. A change is safe, needs derived columns anew (reindex), or
breaks stored data (breaking).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from ..schema import Field

SAFE, REINDEX, BREAKING = "safe", "reindex", "breaking"


@dataclass(frozen=True)
class Change:
    kind: str
    no: int
    name: str
    safety: str
    detail: str = ""


@dataclass
class Plan:
    changes: list[Change]
    blockers: list[Change]
    reserved: list[int]
    rebuild: bool
    fields: list[Field] = field(default_factory=list)

    @property
    def allowed(self) -> bool:
        return not self.blockers


def _shape(f: Field) -> tuple:
    return (f.index, f.blind, f.bucket_width, f.disk)


def _new_field(f: Field, reserved: set[int]) -> Change:
    if f.no in reserved:
        return Change("reuse-reserved", f.no, f.name, BREAKING, "the number belonged to a dropped field")
    return Change("add-field", f.no, f.name, REINDEX if f.indexed else SAFE)


def _same_number(was: Field, now: Field) -> list[Change]:
    if was.type != now.type:
        # what else differs in this field says nothing as long as the type can't be read
        return [Change("retype-field", now.no, now.name, BREAKING, f"{was.type} to {now.type}")]
    out = []
    if was.name != now.name:
        out.append(Change("rename-field", now.no, now.name, REINDEX if was.indexed or now.indexed else SAFE, f"was {was.name}"))
    if _shape(was) != _shape(now):
        out.append(Change("change-index", now.no, now.name, REINDEX))
    if now.required and not was.required:
        out.append(Change("add-required", now.no, now.name, SAFE))
    return out


def diff(old: Iterable[Field], new: Iterable[Field], reserved: Iterable[int] = ()) -> list[Change]:
    """All changes: those of new's fields in new's order, then fields that are gone."""
    before, kept, out = {f.no: f for f in old}, set(), []
    reserved = set(reserved)
    for f in new:
        kept.add(f.no)
        was = before.get(f.no)
        if f.no in reserved or was is None:
            out.append(_new_field(f, reserved))
        else:
            out.extend(_same_number(was, f))
    return out + [Change("remove-field", f.no, f.name, BREAKING) for f in before.values() if f.no not in kept]


def plan(old: Iterable[Field], new: Iterable[Field], reserved: Iterable[int] = (), *, drop: Iterable[str] = (), allow_retype: bool = False) -> Plan:
    """diff with consent: fields named in drop may go (their numbers are reserved), allow_retype lets types change."""
    old, new, reserved, drop = list(old), list(new), set(reserved), set(drop)
    changes = diff(old, new, reserved)
    dropped = {c.no for c in changes if c.kind == "remove-field" and c.name in drop}
    consented = lambda c: c.kind == "remove-field" and c.no in dropped or c.kind == "retype-field" and allow_retype
    blockers = [c for c in changes if c.safety == BREAKING and not consented(c)]
    rebuild = any(c.safety == REINDEX or consented(c) for c in changes)
    return Plan(changes, blockers, sorted(reserved | dropped), rebuild, new)


def describe(blockers: Iterable[Change]) -> str:
    """One line per blocker."""
    return "\n".join(f"field {b.no} ({b.name}): {b.kind}{', ' + b.detail if b.detail else ''}" for b in blockers)


def plan_registry(old: dict[str, list[Field]], new: dict[str, list[Field]], reserved: dict[str, list[int]] | None = None, **consent) -> dict[str, Plan]:
    """Plans for several collections; nothing should be applied unless all are allowed."""
    reserved = reserved or {}
    return {name: plan(old.get(name, []), fields, reserved.get(name, ()), **consent) for name, fields in new.items()}
