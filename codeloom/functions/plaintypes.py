"""Java types and API strings simplified in Python workers: the same texts as :func:`javatypes.simplify_type` and :func:`javatypes.simplify_api` give."""

from __future__ import annotations

import re
from functools import lru_cache

from codeloom.functions.javatypes import ARGUMENTS, PRIMITIVE
from codeloom.functions.words import OBJECT_TYPE

_ARGUMENTS, _PRIMITIVE = re.compile(ARGUMENTS), re.compile(PRIMITIVE)
KEPT = 1 << 16  # texts that are remembered


def _split_top_level(text: str) -> list[str]:
    pieces = text.split(",")
    if "<" in text or ">" in text:
        done, held, depth = [], None, 0
        for p in pieces:
            both = p if held is None else f"{held},{p}"
            depth += p.count("<") - p.count(">")
            if depth == 0:
                done.append(both)
            held = both if depth else None
        pieces = done if held is None else [*done, held]
    return [p for p in pieces if p != ""]


def _judge(name: str) -> str:
    return name if "Tau_" not in name and "<" not in name and ("." not in name or name.startswith("java")) else OBJECT_TYPE


def _judged(inside: str) -> str:
    if "," in inside or "<" in inside or ">" in inside:
        return ",".join(map(_judge, _split_top_level(inside)))
    return _judge(inside)


def _with_simple_generics(text: str) -> str:
    if "<" not in text and ">" not in text:
        return _judged(text)
    depth, left, right = 0, 0, len(text)
    for i, c in enumerate(text):
        if c == "<":
            if depth == 0:
                left = i + 1
            depth += 1
        elif c == ">":
            depth -= 1
            if depth == 0:
                right = i
    return text[:left] + _judged(text[left:left + max(right - left, 0)]) + text[right:]


def is_primitive(name: str) -> bool:
    return _PRIMITIVE.match(name) is not None or name == "void"


@lru_cache(KEPT)
def simplify_type(name: str | None) -> str:
    if name is None:
        return OBJECT_TYPE
    if name.startswith("java"):
        return _with_simple_generics(name)
    return name if is_primitive(name) else OBJECT_TYPE


def _arguments(call: str) -> str:
    found = _ARGUMENTS.search(call)
    return found.group(0) if found else ""


@lru_cache(KEPT)
def formal_count(call: str) -> int:
    return len(_split_top_level(_arguments(call)[1:-1]))


@lru_cache(KEPT)
def simplify_api(call: str) -> str:
    plain = call.replace("$NOT$", "")
    args = _arguments(plain)
    return f"{_with_simple_generics(plain.replace(args, '') if args else plain)}({_judged(args[1:-1])})"
