"""Settings in braces-and-equals files: nested keys, lists, comments, ``${a.b}`` references and -Dkey=value overrides."""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(r"""(?:\#|//)[^\n]*|(?P<string>"(?:\\.|[^"\\])*")|(?P<ref>\$\{[^}]*\})|(?P<sign>[{}\[\]=:,\n])|(?P<bare>[^\s{}\[\]=:,\#"$][^{}\[\]=:,\#"\n]*)""", re.X)


class _Ref(str):
    """A path whose value is looked up once the whole file is read."""


def _value(word: str):
    word = word.strip()
    for known, as_value in (("true", True), ("false", False), ("null", None)):
        if word == known:
            return as_value
    if re.fullmatch(r"[+-]?[0-9]+", word):
        return int(word)
    return float(word) if re.fullmatch(r"[+-]?[0-9]*\.?[0-9]+([eE][+-]?[0-9]+)?", word) else word


class _Over(tuple):
    """A reference and the dict over it, merged once the reference is looked up."""


def merged(a, b):
    """``b`` over ``a``; dicts are merged key by key."""
    if isinstance(a, (_Ref, _Over)) and isinstance(b, dict):
        return _Over((a, b))
    if not (isinstance(a, dict) and isinstance(b, dict)):
        return b
    return {k: merged(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) for k in {**a, **b}}


def _nested(path: str, value) -> dict:
    for k in reversed(path.split(".")):
        value = {k: value}
    return value


def get(tree, path: str):
    for k in path.split("."):
        tree = tree[k]
    return tree


class _Reader:
    def __init__(self, text: str):
        self.items = [(m.lastgroup, m[m.lastgroup]) for m in _TOKEN.finditer(text) if m.lastgroup]
        self.at = 0

    def peek(self, skip: str = ""):
        while self.at < len(self.items) and self.items[self.at][0] == "sign" and self.items[self.at][1] in skip:
            self.at += 1
        return self.items[self.at] if self.at < len(self.items) else (None, "")

    def take(self):
        self.at += 1
        return self.items[self.at - 1]

    def fields(self, end: str) -> dict:
        out: dict = {}
        while True:
            kind, word = self.peek("\n,")
            if kind is None or (kind, word) == ("sign", end):
                if kind is None and end:
                    raise ValueError(f"missing {end}")
                self.at += kind is not None
                return out
            if kind not in ("bare", "string"):
                raise ValueError(f"a key was expected, not {word!r}")
            self.take()
            path = json.loads(word) if kind == "string" else word.strip()
            if self.peek()[1] in ("=", ":"):
                self.take()
            out = merged(out, _nested(path, self.value()))

    def value(self):
        kind, word = self.peek("\n")
        self.take()
        if kind == "string":
            return json.loads(word)
        if kind == "ref":
            return _Ref(word[2:-1])
        if kind == "bare":
            while self.peek() == ("sign", ":"):  # addresses hold colons
                word += self.take()[1] + (self.take()[1] if self.peek()[0] == "bare" else "")
            return _value(word)
        if word == "{":
            return self.fields("}")
        if word == "[":
            out = []
            while self.peek("\n,")[1] != "]":
                out.append(self.value())
            self.take()
            return out
        raise ValueError(f"a value was expected, not {word!r}")


def _resolved(x, root: dict, seen: tuple = ()):
    if isinstance(x, _Ref):
        if x in seen:
            raise ValueError(f"{x} refers to itself")
        found = root
        for k in x.split("."):
            found = (_resolved(found, root, (*seen, x)) if isinstance(found, (_Ref, _Over)) else found)[k]
        return _resolved(found, root, (*seen, x))
    if isinstance(x, _Over):
        return merged(*[_resolved(part, root, seen) for part in x])
    if isinstance(x, dict):
        return {k: _resolved(v, root, seen) for k, v in x.items()}
    return [_resolved(v, root, seen) for v in x] if isinstance(x, list) else x


def parse(text: str, overrides: dict[str, str] | None = None) -> dict:
    reader = _Reader(text)
    if reader.peek("\n")[1] == "{":
        reader.take()
        tree = reader.fields("}")
    else:
        tree = reader.fields("")
    for path, value in (overrides or {}).items():
        tree = merged(tree, _nested(path, _value(value)))
    return _resolved(tree, tree)


def from_arguments(argv: list[str], default: str = "application.conf") -> dict:
    """The file named by --conf, with each -Dkey=value over it."""
    overrides = dict(a[2:].split("=", 1) for a in argv if a.startswith("-D") and "=" in a)
    rest = [a for a in argv if not a.startswith("-D")]
    path = rest[rest.index("--conf") + 1] if "--conf" in rest else default
    with open(path, encoding="utf-8") as f:
        return parse(f.read(), overrides)


def dump(tree: dict, path: str | None = None) -> str:
    """The settings as JSON, written to ``path`` if given."""
    text = json.dumps(tree, indent=2, sort_keys=True)
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text
