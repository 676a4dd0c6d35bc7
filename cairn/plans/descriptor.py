"""Message descriptors: which ones can be stored, and which can follow a stored one.

Descriptors are small driver-side values; nothing here touches data.  Messages refer to each other by full name in one
file of definitions, so they may be recursive."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from cairn.plans.errors import CairnError

#: Kinds of fields, and the prefix that field names may not have.  Fixed values.
SIGNED = ("double", "float", "int32", "int64", "sint32", "sint64", "sfixed32", "sfixed64", "bool", "string", "bytes")
UNSIGNED = ("uint32", "uint64", "fixed32", "fixed64")
RESERVED_PREFIX = "fdb_"
UUID = "cairn.v1.UUID"
WELL_KNOWN = frozenset({UUID})

OPTIONAL, REPEATED, MAP, PLAIN = "optional", "repeated", "map", "plain"


@dataclass(frozen=True)
class Field:
    """kind: a scalar kind, or ``message:<full name>`` or ``enum:<full name>``.

    cardinality: plain (no presence), optional (presence by ``optional`` or by its oneof), repeated, map (with map_key)."""

    number: int
    name: str
    kind: str
    cardinality: str = OPTIONAL
    oneof: str | None = None
    map_key: str = "string"
    default: object = None
    group: bool = False

    @property
    def message(self) -> str | None:
        return self.kind[8:] if self.kind.startswith("message:") else None

    @property
    def enum(self) -> str | None:
        return self.kind[5:] if self.kind.startswith("enum:") else None


@dataclass(frozen=True)
class Message:
    full_name: str
    fields: tuple[Field, ...] = ()
    map_entry: bool = False

    @property
    def name(self) -> str:
        return self.full_name.rpartition(".")[2]


@dataclass(frozen=True)
class Enumeration:
    full_name: str
    values: tuple[tuple[int, str], ...]

    @property
    def name(self) -> str:
        return self.full_name.rpartition(".")[2]


@dataclass(frozen=True)
class Definitions:
    """The messages and enums of one version of a schema."""

    messages: dict[str, Message] = field(default_factory=dict)
    enums: dict[str, Enumeration] = field(default_factory=dict)
    syntax: str = "proto3"

    @staticmethod
    def of(items: Iterable[Message | Enumeration], syntax: str = "proto3") -> Definitions:
        items = list(items)
        return Definitions({x.full_name: x for x in items if isinstance(x, Message)}, {x.full_name: x for x in items if isinstance(x, Enumeration)}, syntax)


def why_not_well_formed(defs: Definitions, name: str) -> str | None:
    """The first rule that a message breaks as a record type; None if it is well formed."""
    if defs.syntax != "proto3":
        return "only proto3"
    message = defs.messages.get(name)
    if message is None:
        return f"{name} isn't defined"
    if message.map_entry:
        return "a map entry is no record"
    if name in WELL_KNOWN:
        return "a well-known type is no record"
    seen: set[str] = set()

    def walk(m: Message) -> str | None:
        if m.full_name in seen or m.full_name in WELL_KNOWN:
            return None
        seen.add(m.full_name)
        for f in m.fields:
            where = f"{m.name}.{f.name}: "
            if f.group:
                return where + "groups aren't supported"
            if f.default is not None:
                return where + "defaults aren't supported"
            if f.name.startswith(RESERVED_PREFIX):
                return where + "the name is reserved"
            if f.cardinality == PLAIN:
                return where + "a single field has to be optional or in a oneof"
            if f.cardinality == OPTIONAL and f.oneof is None:
                return where + "presence comes from a oneof"
            if f.kind in UNSIGNED:
                return where + "unsigned numbers aren't supported"
            if f.cardinality == MAP and f.map_key != "string":
                return where + "map keys are strings"
            if f.enum:
                if f.enum not in defs.enums:
                    return where + "unknown enum"
            elif f.message:
                inner = defs.messages.get(f.message)
                if inner is None and f.message not in WELL_KNOWN:
                    return where + "unknown message"
                if inner is not None:
                    if inner.map_entry:
                        return where + "a map entry is no value"
                    if found := walk(inner):
                        return found
            elif f.kind not in SIGNED:
                return where + f"unknown kind {f.kind}"
        return None

    return walk(message)


def check_well_formed(defs: Definitions, name: str) -> None:
    if why := why_not_well_formed(defs, name):
        raise CairnError("descriptor_not_well_formed", why)


def is_evolvable(old: Definitions, old_name: str, new: Definitions, new_name: str) -> bool:
    """Records written with the old message can be read with the new one: every old field is there with its number, name,
    oneof, cardinality and kind; enums keep their names and numbers; well-known types stay the same; more may be added."""
    seen: set[tuple[str, str]] = set()

    def enums(a: str, b: str) -> bool:
        x, y = old.enums[a], new.enums[b]
        return x.name == y.name and set(x.values) <= set(y.values)

    def messages(a: str, b: str) -> bool:
        if a in WELL_KNOWN or b in WELL_KNOWN:
            return a == b
        if (a, b) in seen:
            return True
        seen.add((a, b))
        x, y = old.messages[a], new.messages[b]
        if x.name != y.name:
            return False
        now = {f.number: f for f in y.fields}
        for f in x.fields:
            g = now.get(f.number)
            if g is None or (f.name, f.oneof, f.cardinality, f.map_key) != (g.name, g.oneof, g.cardinality, g.map_key):
                return False
            if f.message and g.message:
                if not messages(f.message, g.message):
                    return False
            elif f.enum and g.enum:
                if not enums(f.enum, g.enum):
                    return False
            elif f.kind != g.kind:
                return False
        return True

    return messages(old_name, new_name)
