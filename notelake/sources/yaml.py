"""Frontmatter in YAML: block and flow lists and maps, quoted, plain and block scalars, comments; and one canonical text for it.

Scalars are texts, as frontmatter's fields are; an empty value is None. What isn't read (anchors, aliases, tags, several
documents, keys that aren't scalars) is an error, and so is a repeated key."""

from __future__ import annotations

import json
import re

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\[\]{},&*!|>'"%@`?-][^#]*?|-[^\s#][^#]*?)\s*:(?=\s|$)""")


def loads(text: str) -> dict:
    """The map that a text holds; ValueError where it is of another form."""
    lines = text.split("\n")
    value, at = _block(lines, _next(lines, 0), 0)
    at = _next(lines, at)
    if at < len(lines):
        raise ValueError(f"no field: {lines[at]}")
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise ValueError("no fields")
    return value


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _next(lines: list[str], at: int) -> int:
    """The next line that isn't blank or a comment."""
    while at < len(lines) and (not lines[at].strip() or lines[at].lstrip().startswith("#")):
        at += 1
    return at


def _block(lines: list[str], at: int, least: int):
    """The list or map that begins at a line indented by least or more, and the line behind it."""
    if at >= len(lines) or _indent(lines[at]) < least:
        return None, at
    indent = _indent(lines[at])
    if lines[at][indent:].startswith("\t"):
        raise ValueError(f"indented by a tab: {lines[at]}")
    listed = re.match(r"-(\s|$)", lines[at][indent:])
    out: list | dict = [] if listed else {}
    while at < len(lines) and _indent(lines[at]) == indent and bool(re.match(r"-(\s|$)", lines[at][indent:])) == bool(listed):
        rest = lines[at][indent:]
        if isinstance(out, list):
            inner = rest[1:].lstrip(" ")
            if re.match(r"-\s", inner) or _KEY.match(inner):  # a list or map that begins in the item's own line
                lines[at] = " " * (len(lines[at]) - len(inner)) + inner
                value, at = _block(lines, at, indent + 1)
            else:
                value, at = _value(lines, at, inner, indent + 1)
            out.append(value)
        else:
            m = _KEY.match(rest)
            if not m:
                raise ValueError(f"no field: {lines[at]}")
            key = _scalar(m[1])
            if key in out:
                raise ValueError(f"repeated key: {key}")
            # a list may stand as far left as its key
            then = _next(lines, at + 1)
            beside = then < len(lines) and _indent(lines[then]) == indent and re.match(r"-(\s|$)", lines[then][indent:])
            out[key], at = _value(lines, at, rest[m.end() :].strip(), indent if beside else indent + 1)
        at = _next(lines, at)
    if at < len(lines) and _indent(lines[at]) > indent:
        raise ValueError(f"no field: {lines[at]}")
    return out, at


def _value(lines: list[str], at: int, text: str, least: int):
    """The value whose first line's rest is text, with what follows it indented by least or more; and the line behind it."""
    if not text or text.startswith("#"):
        return _block(lines, _next(lines, at + 1), least)
    if m := re.fullmatch(r"([|>])([+-]?)\s*(?:#.*)?", text):
        return _literal(lines, at + 1, least, m[1], m[2])
    if text[0] in "[{" or text[0] in "\"'":
        return _flow_lines(lines, at, text)
    if text[0] in "&*!%@`|>,]}" or re.match(r"[?-](\s|$)", text):
        raise ValueError(f"not read: {text}")
    parts, at = [_uncommented(text)], at + 1
    while at < len(lines) and lines[at].strip() and _indent(lines[at]) >= max(least, 1) and not lines[at].lstrip().startswith("#"):
        if _KEY.match(lines[at].lstrip()):
            raise ValueError(f"no field: {lines[at]}")
        parts.append(_uncommented(lines[at].strip()))
        at += 1
    return " ".join(parts), at


def _uncommented(text: str) -> str:
    found = re.search(r"\s#", text)
    return (text[: found.start()] if found else text).strip()


def _literal(lines: list[str], at: int, least: int, style: str, chomp: str):
    body = []
    while at < len(lines) and (not lines[at].strip() or _indent(lines[at]) >= max(least, 1)):
        body.append(lines[at])
        at += 1
    indent = min((_indent(x) for x in body if x.strip()), default=0)
    rows = [x[indent:] if x.strip() else "" for x in body]
    kept = len(rows)
    while kept and not rows[kept - 1]:
        kept -= 1
    text = "\n".join(rows[:kept])
    if style == ">":  # single line ends become blanks, but for those of further indented lines
        text = re.sub(r"(?<=[^\n])\n(?=[^\n ])", " ", text)
        text = re.sub(r"\n\n", "\n", text)
    return text + ("" if chomp == "-" or not text else "\n" * (1 + len(rows) - kept) if chomp == "+" else "\n"), at


def _flow_lines(lines: list[str], at: int, text: str):
    """A flow or quoted value, which may go on over further lines."""
    while True:
        try:
            value, end = _flow(text, 0)
            break
        except IndexError:
            at += 1
            if at >= len(lines):
                raise ValueError(f"no end: {text}") from None
            text += " " + lines[at].strip()
    if text[end:].strip() and not re.match(r"\s+#", text[end:]):
        raise ValueError(f"no field: {text}")
    return value, at + 1


def _flow(text: str, i: int):
    """The flow value at i and the place behind it; IndexError where the text ends within."""
    while text[i].isspace():
        i += 1
    if text[i] in "\"'":
        quote = text[i]
        m = re.compile(r'"(?:[^"\\]|\\.)*"' if quote == '"' else r"'(?:[^']|'')*'").match(text, i)
        if not m:
            raise IndexError
        return _scalar(m[0]), m.end()
    if text[i] == "[":
        out, i = [], i + 1
        while True:
            i = _past(text, i)
            if text[i] == "]":
                return out, i + 1
            value, i = _flow(text, i)
            i = _past(text, i)
            if text[i] == ":":  # a map of one field
                inner, i = _flow(text, i + 1)
                value, i = {value: inner}, _past(text, i)
            out.append(value)
            i = _comma(text, i, "]")
    if text[i] == "{":
        found, i = {}, i + 1
        while True:
            i = _past(text, i)
            if text[i] == "}":
                return found, i + 1
            key, i = _flow(text, i)
            if not isinstance(key, str) or key in found:
                raise ValueError(f"repeated key: {key}")
            i, value = _past(text, i), None
            if text[i] == ":":
                i = _past(text, i + 1)
                if text[i] not in ",}":
                    value, i = _flow(text, i)
            found[key] = value
            i = _comma(text, _past(text, i), "}")
    m = re.compile(r"(?:[^\s,\[\]{}:#]|:(?=[^\s,\[\]{}])|(?<=\S)#|[ \t]+(?=[^\s,\[\]{}:#]|:[^\s,\[\]{}]))+").match(text, i)
    if not m or text[i] in "&*!%@`|>":
        raise ValueError(f"not read: {text[i:]}")
    if m.end() >= len(text):
        raise IndexError
    return m[0].strip(), m.end()


def _past(text: str, i: int) -> int:
    while text[i].isspace():
        i += 1
    return i


def _comma(text: str, i: int, end: str) -> int:
    if text[i] == ",":
        return i + 1
    if text[i] != end:
        raise ValueError(f"no end: {text}")
    return i


def _scalar(text: str) -> str:
    if text[:1] == '"':
        return json.loads(re.sub(r"\\x([0-9a-fA-F]{2})", r"\\u00\1", text), strict=False)
    return text[1:-1].replace("''", "'") if text[:1] == "'" else text.strip()


def dumps(value: dict, first: tuple[str, ...] = ()) -> str:
    """The canonical text of fields: those named first in that order, the others by name, one a line, values in flow form.

    Equal fields have equal texts, whatever form they were written in, and loads gives them back."""
    names = [n for n in first if n in value] + sorted(n for n in value if n not in first)
    return "".join(f"{json.dumps(n, ensure_ascii=False)}:{' ' if value[n] is not None else ''}{_dumped(value[n])}\n" for n in names)


def _dumped(value) -> str:
    if value is None:
        return ""
    if isinstance(value, list):
        return "[" + ", ".join('""' if x is None else _dumped(x) for x in value) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}:{' ' + _dumped(x) if x is not None else ''}" for k, x in sorted(value.items())) + "}"
    return json.dumps(value, ensure_ascii=False)
