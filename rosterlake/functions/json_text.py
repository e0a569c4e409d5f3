"""JSON texts read and written so that no text can fail a task, and records as tables of paths.

The work is in proportion to the text: no call is as deep as the text is nested.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark import cloudpickle

#: Levels of nesting beyond which a text holds nothing that is read.
MOST_LEVELS = 200
_HALVES = re.compile("[\ud800-\udfff]")
#: json.dumps would make one a call.
_WRITER = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def read(text: str | None) -> object:
    """The value of a JSON text; None if it is none, or is nested beyond MOST_LEVELS."""
    try:
        value = json.loads(text)  # type: ignore[arg-type]
    except (TypeError, ValueError, RecursionError):
        return None
    if text.count("[") + text.count("{") > MOST_LEVELS:  # type: ignore[union-attr]
        level, within = 0, [value]
        while within := [v for x in within if isinstance(x, dict | list) for v in (x.values() if isinstance(x, dict) else x)]:
            level += 1
            if level > MOST_LEVELS:
                return None
    return value


def whole(text: str) -> str:
    """Text with halves of surrogate pairs, which no encoding has, as replacement characters."""
    return _HALVES.sub("�", text)


def canonical(value: object) -> str:
    """Compact JSON with sorted keys."""
    return whole(_WRITER.encode(value))


def field_name(key: object) -> str:
    """A field's name by its letters and digits."""
    return re.sub(r"[^a-z0-9]", "", str(key).lower())


def squeezed(text: object) -> str:
    return whole(" ".join(str(text).split()))


def record_rows(value: object, deepest: int = 16) -> list[dict]:
    """The texts of a record in its order: (path, object, text, is_name).

    path is the fields around a text, each with the number of its object (in the
    order in which objects open, from 1); lists leave no trace. Names of fields
    are texts of their object. Blank texts, fields whose name begins with `_` and
    what lies below `deepest` fields are left out.
    """
    out: list[dict] = []
    todo: list[tuple] = [(value, (), 0)]
    objects = 0
    while todo:
        at, path, within = todo.pop()
        if isinstance(at, tuple):  # a field's name, kept in its place
            out.append({"path": path, "object": within, "text": squeezed(at[0]), "is_name": True})
        elif isinstance(at, dict):
            objects += 1
            if len(path) < deepest:
                for k, v in reversed([(k, v) for k, v in at.items() if not str(k).startswith("_")]):
                    todo += [(v, (*path, {"object": objects, "field": field_name(k)}), objects), ((k,), path, objects)]
        elif isinstance(at, list):
            todo += [(v, path, within) for v in reversed(at)]
        elif at is not None and (text := squeezed(at)):
            out.append({"path": path, "object": within, "text": text, "is_name": False})
    return out


def nodes(value: object, key_of: Callable[[object], str], *, own: bool, deepest: int = 10) -> Iterator[tuple[tuple, object]]:
    """(path, node) of a value from the top: a node is `dict` or `list` where more follows, else a value.

    A step is a field's name, or the key of a list's member: `key_of` at the top,
    else, and where that is empty, the member's own text. Equal members have steps
    of their own, as have those of one key if they are one's `own`.
    """
    todo: list[tuple[tuple, object]] = [((), value)]
    alone = 0
    while todo:
        path, at = todo.pop()
        if not isinstance(at, dict | list) or not at or len(path) > deepest:
            yield path, at
            continue
        steps: list[tuple[tuple, object]] = []
        if isinstance(at, dict):
            yield path, dict
            steps = [((*path, k), v) for k, v in at.items()]
        else:
            yield path, list
            seen: Counter = Counter()
            for v in at:
                key = "" if path else key_of(v)
                name = ("key", key) if key else ("is", canonical(v))
                if not key and isinstance(v, dict) and not path and key_of is not no_key:
                    alone += 1
                    name = ("alone", own, alone)
                steps.append(((*path, (*name, 0 if key and not own else seen[name])), v if key else Leaf(v)))
                seen[name] += 1
        todo += reversed(steps)


class Leaf:
    """A member of a list that is taken or left as a whole."""

    def __init__(self, value: object):
        self.value = value


def no_key(member: object) -> str:
    return ""


def _blank(node: object) -> bool:
    value = node.value if isinstance(node, Leaf) else node
    return value is None or value == "" or value == [] or value == {}


def union_by_paths(own: object, other: object, key_of: Callable[[object], str] = no_key) -> object:
    """`own` and what `other` has at paths where `own` has nothing or a blank; members of lists are told apart by key or text."""
    table: dict[tuple, object] = dict(nodes(own, key_of, own=True))
    into: set[tuple] = set()
    new: set[tuple] = set()
    for path, node in nodes(other, key_of, own=False):
        if path and path[:-1] not in into:
            continue  # own has something else above
        if path and isinstance(path[-1], tuple) and path[-1][0] == "is" and path[-1][2] and path[:-1] not in new:
            continue  # a repeat, in a list that own has too
        if path not in table or _blank(table[path]):
            table[path] = node
            into.add(path)
            if path or key_of is no_key:
                new.add(path)
        elif table[path] is node and node in (dict, list):
            into.add(path)
    return _built(table)


def _built(table: dict[tuple, object]) -> object:
    made: dict[tuple, object] = {}
    for path, node in table.items():
        value: object = {} if node is dict else [] if node is list else node.value if isinstance(node, Leaf) else node
        made[path] = value
        if path:
            above = made[path[:-1]]
            if isinstance(above, list):
                above.append(value)
            else:
                above[path[-1]] = value  # type: ignore[index]
    return made[()]


# Executors need not have this package: its functions travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
