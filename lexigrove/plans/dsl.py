"""Configuration strings: ``tokenize("en"),sentence,library/part-of-speech(model)``.

A string is a list of forms: an optional library and a slash, a component's name, and optional arguments in parentheses.
Arguments are literals (strings, numbers, booleans, bare symbols, ``{:key value}`` maps); nothing is evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from lexigrove.plans import registry
from lexigrove.plans.components import Component


class ConfigurationError(ValueError):
    """A configuration string that cannot be read; ``column`` counts from 1."""

    def __init__(self, message: str, text: str, column: int | None = None):
        super().__init__(f"{message}{f' at column {column}' if column else ''}: {text}")
        self.column = column


class Symbol(str):
    """A bare word as an argument."""


@dataclass(frozen=True)
class Form:
    func: str
    params: tuple[str, ...] | None = None
    namespace: str | None = None


_NAME = re.compile(r"[a-zA-Z0-9_.?!*<>=+-]+")


def to_forms(text: str) -> list[Form]:
    """The forms of a string, arguments unread."""
    at, out = 0, []

    def name(what: str) -> str:
        nonlocal at
        m = _NAME.match(text, at)
        if not m:
            raise ConfigurationError(f"expected {what}", text, at + 1)
        at = m.end()
        return m[0]

    while True:
        func, namespace, params = name("a component"), None, None
        if text[at : at + 1] == "/":
            at += 1
            namespace, func = func, name("a component")
        if text[at : at + 1] == "(":
            at += 1
            found = []
            while True:
                begin = at
                depth = 0
                while at < len(text) and (depth or text[at] not in ",)"):
                    depth += (text[at] == "[") - (text[at] == "]")  # commas in a vector part its elements
                    at += 1
                if at == begin or at == len(text):
                    raise ConfigurationError("expected an argument", text, at + 1)
                found.append(text[begin:at])
                at += 1
                if text[at - 1] == ")":
                    break
            params = tuple(found)
        out.append(Form(func, params, namespace))
        if at == len(text):
            return out
        if text[at] != ",":
            raise ConfigurationError("expected a comma", text, at + 1)
        at += 1


def to_metadata(text: str) -> list[dict[str, Any]]:
    """The forms as maps with func, params and, if given, namespace."""
    return [({"namespace": f.namespace} if f.namespace else {}) | {"func": f.func, "params": f.params} for f in to_forms(text)]


_LITERAL = re.compile(r'\s*(?:"((?:\\.|[^"\\])*)"|(-?\d+(?:\.\d+)?)|(:?[^\s"{}\[\],]+)|(\{)|([}\]])|(\[))')


def read_literal(text: str) -> Any:
    value, at = _read(text, 0)
    if text[at:].strip():
        raise ConfigurationError("more than one value in an argument", text, at + 1)
    return value


def _read(text: str, at: int) -> tuple[Any, int]:
    m = _LITERAL.match(text, at)
    if not m or m[5]:
        raise ConfigurationError("cannot read an argument", text, at + 1)
    at = m.end()
    if m[1] is not None:
        return re.sub(r"\\(.)", r"\1", m[1]), at
    if m[6]:
        items: list[Any] = []
        while not re.match(r"\s*\]", text[at:]):
            value, at = _read(text, at)
            items.append(value)
            at += re.match(r"[\s,]*", text[at:]).end()
        return items, at + text[at:].index("]") + 1
    if m[2] is not None and not re.match(r"[^\s\"{}\[\],]", text[at:]):
        return (float(m[2]) if "." in m[2] else int(m[2])), at
    if m[4]:
        out: dict[str, Any] = {}
        while not re.match(r"\s*\}", text[at:]):
            key, at = _read(text, at)
            out[str(key)], at = _read(text, at)
        return out, at + text[at:].index("}") + 1
    word = m[3] or m[2]
    if word in ("true", "false", "nil"):
        return {"true": True, "false": False, "nil": None}[word], at
    if word.startswith(":"):
        return word[1:].replace("-", "_").rstrip("?"), at
    return Symbol(word), at


def find_function(func: str, namespace: str | None, namespaces: list[str] | None = None) -> Callable[..., Component]:
    """The constructor of a component: of one library, or the first of all that has it."""
    known = registry.libraries()
    names = [namespace] if namespace else (namespaces or registry.registered_namespaces())
    for name in names:
        if name in known and func in known[name].constructors:
            return known[name].constructors[func]
    raise ConfigurationError(f"no component is called {func!r} in {', '.join(names)}", func)


def parse(text: str, namespaces: list[str] | None = None) -> list[Component]:
    """The components that a configuration string stands for. A map as an argument gives options by name."""
    out = []
    for form in to_forms(text):
        values = [read_literal(x) for x in form.params or ()]
        named = {k: v for x in values if isinstance(x, dict) for k, v in x.items()}
        out.append(find_function(form.func, form.namespace, namespaces)(*[x for x in values if not isinstance(x, dict)], **named))
    return out
