"""Symbols, complexity and imports of Rust files by a tokeniser of our own.

It covers items, blocks and the operators that count for complexity; macros'
insides are read as code. Files are independent, so this is a map over rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.scalars import contains_id, dependency_id, file_id, module_id, symbol_id

SYMBOL = "path string, name string, qualified_name string, kind string, line_start long, line_end long, signature string, lines_of_code long, complexity long, parameters long"
_TOKEN = re.compile(
    r"""(?P<skip>//[^\n]*|/\*.*?\*/)|(?P<text>b?r(?P<h>\#*)".*?"(?P=h)|b?"(?:\\.|[^"\\])*"|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\])')|(?P<life>'\w+)"""
    r"""|(?P<word>[A-Za-z_]\w*|\d[\w.]*)|(?P<sign>&&|\|\||=>|->|::|[^\s\w])""",
    re.S | re.X,
)
_ITEMS = {"fn": "function", "struct": "type", "enum": "type", "union": "type", "type": "type", "trait": "trait", "mod": "module"}
_BRANCH = ("if", "while", "for", "loop")


def tokens(source: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) without comments."""
    return [(m.lastgroup if m.lastgroup != "h" else "text", m.group(), m.start(), m.end()) for m in _TOKEN.finditer(source) if not m.group("skip")]


def _close(ts: list, i: int) -> int:
    """Index of the token that closes the bracket at i."""
    depth = 0
    for j in range(i, len(ts)):
        depth += ts[j][1] in "({[" if ts[j][0] == "sign" else 0
        depth -= ts[j][1] in ")}]" if ts[j][0] == "sign" else 0
        if not depth:
            return j
    return len(ts) - 1


def balanced(source: str) -> bool:
    """Whether every bracket closes in order."""
    pairs, held = {")": "(", "}": "{", "]": "["}, []
    for kind, text, *_ in tokens(source):
        if kind == "sign" and text in "({[":
            held.append(text)
        elif kind == "sign" and text in pairs and (not held or held.pop() != pairs[text]):
            return False
    return not held


# Binary operators, by how tightly they bind (loosest first).
_LEVELS = (("||",), ("&&",), ("==", "!=", "<", ">", "<=", ">="), ("|",), ("^",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "/", "%"), ("as",))
_BINDS = {sign: k for k, level in enumerate(_LEVELS) for sign in level}
_JOINED = {a + b for a, b in ("==", "!=", "<=", ">=", "<<", ">>", "..")}
#: What ends an expression: no operator reaches across it.
_STOPS = {";", ",", "=", "=>", "->", "..", "{", "}", "if", "else", "while", "match", "for", "in", "let", "return", "break", "loop", "move", "unsafe", "where", "fn"}


def _operators(body: list) -> Iterator[tuple[str, bool]]:
    """(text, whether it is an operand's or a bracket's) with signs that belong
    together in one."""
    i = 0
    while i < len(body):
        kind, text, _, stop = body[i]
        if kind == "sign" and i + 1 < len(body) and body[i + 1][2] == stop and text + body[i + 1][1] in _JOINED:
            yield text + body[i + 1][1], False
            i += 2
            continue
        yield text, kind in ("word", "text", "life") and text not in _BINDS and text not in _STOPS
        i += 1


def logical_expressions(body: list) -> int:
    """How many binary expressions hold `&&` or `||` anywhere within them.

    Operators are read by precedence, brackets as operands that may hold some.
    A frame is the operands (whether each holds one) and operators so far."""
    found = 0

    def reduce(frame: dict, least: int) -> None:
        nonlocal found
        while frame["signs"] and _BINDS[frame["signs"][-1]] >= least and len(frame["values"]) > 1:
            sign, right = frame["signs"].pop(), frame["values"].pop()
            frame["values"][-1] |= right or sign in ("&&", "||")
            found += frame["values"][-1]

    def end(frame: dict) -> None:
        reduce(frame, 0)
        frame["any"] |= any(frame["values"])
        frame["values"], frame["signs"], frame["open"] = [], [], True

    new = lambda: {"values": [], "signs": [], "open": True, "any": False, "bars": False}
    stack = [new()]
    for text, operand in _operators(body):
        frame = stack[-1]
        if frame["bars"]:  # parameters of a closure
            frame["bars"] = text != "|"
        elif text in ("(", "["):
            stack.append(new())
        elif text in (")", "]") and len(stack) > 1:
            end(frame)
            stack.pop()
            outer, held = stack[-1], frame["any"]
            if outer["open"] or not outer["values"]:
                outer["values"].append(held)
            else:  # arguments or an index: part of the operand before
                outer["values"][-1] |= held
            outer["open"] = False
        elif text in _STOPS:
            end(frame)
        elif operand:
            if frame["open"]:
                frame["values"].append(False)
            frame["open"] = False
        elif text in _BINDS and not frame["open"]:
            reduce(frame, _BINDS[text])
            frame["signs"].append(text)
            frame["open"] = True
        elif text == "|":
            frame["bars"] = True
    for frame in stack:
        end(frame)
    return found


def complexity(body: list) -> int:
    """1, and one for each branch, match arm, `?`, and each binary expression
    that holds `&&` or `||`."""
    n = 1
    for i, (kind, text, *_) in enumerate(body):
        before = body[i - 1][1] if i else ""
        if kind == "word" and text in _BRANCH and not (text == "for" and (before == "impl" or body[i + 1 : i + 2] and body[i + 1][1] == "<")):
            n += 1
        elif kind == "sign" and text in ("=>", "?"):
            n += 1
    return n + logical_expressions(body)


def _parameters(ts: list, a: int, b: int) -> int:
    """Parameters between brackets: parts by commas outside inner brackets."""
    parts, depth, filled = 0, 0, False
    for _, text, *_ in ts[a + 1 : b]:
        if text in ("(", "[", "{", "<"):
            depth += 1
        elif text in (")", "]", "}", ">"):
            depth -= 1
        if text == "," and not depth:
            parts, filled = parts + filled, False
        else:
            filled = True
    return parts + filled


def module_parts(path: str) -> list[str]:
    p = PurePosixPath(path)
    parts = [x for x in p.parent.parts if x != "."]
    parts = parts[1:] if parts[:1] == ["src"] else parts
    return parts + ([p.stem] if p.stem not in ("lib", "main", "mod") else [])


def symbols(path: str, source: str) -> list[tuple]:
    """Rows of SYMBOL for one file."""
    ts = tokens(source)
    line = lambda at: source.count("\n", 0, at) + 1
    out: list[tuple] = []

    def walk(i: int, end: int, owners: list[str], member: bool) -> None:
        while i < end:
            kind, text, start, _ = ts[i]
            if kind == "word" and text == "impl" and (not i or ts[i - 1][1] in ("}", ";", "{", "unsafe", "]")):
                j = i + 1
                while j < end and ts[j][1] not in ("{", ";"):
                    j += 1
                names = [t for t in ts[i + 1 : j]]
                at = max((k for k, t in enumerate(names) if t[1] == "for"), default=-1)
                named = names[at + 1 :] if at >= 0 else names[_generics(names) :]
                stop = next((k for k, t in enumerate(named) if t[1] == "where"), len(named))
                owner = source[named[0][2] : named[stop - 1][3]] if stop else "impl"
                k = _close(ts, j) if j < end else j
                walk(j + 1, k, [*owners, owner], True)
                i = k + 1
                continue
            if kind == "word" and text in _ITEMS and i + 1 < end and ts[i + 1][0] == "word" and (text != "union" or ts[i + 2][1] in ("{", "<")):
                name, j = ts[i + 1][1], i + 2
                params, opened = 0, None
                while j < end and ts[j][1] not in ("{", ";"):
                    if ts[j][1] in ("(", "["):
                        k = _close(ts, j)
                        if text == "fn" and opened is None:
                            params, opened = _parameters(ts, j, k), j
                        j = k
                    j += 1
                stop = _close(ts, j) if j < end and ts[j][1] == "{" else min(j, end - 1)
                first = i
                while first and ts[first - 1][1] in ("pub", "async", "unsafe", "const", "extern", ")") and ts[first - 1][3] > (ts[first - 2][3] if first > 1 else -1):
                    first = _open(ts, first - 1) if ts[first - 1][1] == ")" else first - 1
                    if ts[first][1] == "(" and not (first and ts[first - 1][1] == "pub"):
                        first = i
                        break
                body = ts[j + 1 : stop] if j < end and ts[j][1] == "{" else []
                is_fn = text == "fn"
                a, b = line(ts[first][2]), line(ts[stop][2])
                head_end = ts[j][2] if body or (j < end and ts[j][1] == "{" and text in ("fn", "trait", "mod", "struct", "enum", "union")) else ts[stop][3]
                out.append((path, name, "::".join([*module_parts(path), *owners, name]), "method" if is_fn and member else _ITEMS[text], a, b, source[ts[first][2] : head_end].strip() or None, b - a + 1, complexity(body) if is_fn else 0, params))
                if body and text in ("fn", "trait", "mod"):
                    walk(j + 1, stop, [*owners, name], text == "trait" or member and text == "fn")
                i = stop + 1
                continue
            i += 1

    walk(0, len(ts), [], False)
    return out


def _generics(names: list) -> int:
    """Tokens that a leading <...> takes."""
    depth = 0
    for k, t in enumerate(names):
        depth += (t[1] == "<") - (t[1] == ">")
        if not depth:
            return k + 1 if t[1] == ">" else 0
    return 0


def _open(ts: list, i: int) -> int:
    """Index of the bracket that the one at i closes."""
    depth = 0
    for j in range(i, -1, -1):
        depth += (ts[j][1] == ")") - (ts[j][1] == "(")
        if not depth:
            return j
    return i


def rust_symbols(files: DataFrame) -> DataFrame:
    """SYMBOL rows with id and contains_id, of files (path, content as text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in SYMBOL.split(", ")]
        for pdf in frames:
            yield pd.DataFrame([r for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in symbols(p, c or "")], columns=names)

    found = files.select("path", "content").mapInPandas(run, SYMBOL)
    with_id = found.withColumn("id", symbol_id(F.col("path"), F.col("name"), F.col("line_start")))
    return with_id.withColumn("contains_id", contains_id(F.col("path"), F.col("id")))


def rust_imports(files: DataFrame) -> DataFrame:
    """Distinct `use` targets of each file, with the module's and edge's ids."""
    bare = F.regexp_replace("content", r"(?s)//[^\n]*|/\*.*?\*/", "")
    uses = files.select("path", F.explode(F.regexp_extract_all(bare, F.lit(r"(?ms)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);"), 1)).alias("target"))
    each = uses.select("path", F.regexp_replace(F.trim("target"), r"\s+", " ").alias("target")).distinct()
    target = module_id(F.lit("rust"), F.col("target"))
    return each.select("path", "target", target.alias("id"), dependency_id(file_id(F.col("path")), F.lit("imports"), target).alias("relation_id"))
