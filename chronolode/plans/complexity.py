"""Cyclomatic and cognitive complexity of Java methods, by the published definitions.

Cyclomatic: 1 and one for each if, loop, case, catch, conditional, ``&&`` and ``||``. Cognitive: each break of linear flow
counts one more for every level that it is nested in; an else counts one, a run of like boolean operators one. A file's
value is the largest of its methods and constructors. The parser follows statements and braces, not types.
"""

from __future__ import annotations

import re
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame

_NOISE = re.compile(r'"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*.*?(?:\*/|$)', re.DOTALL)
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|&&|\|\||->|::|\d[\w.]*|[^\s\w]")
_TYPES = {"class", "interface", "enum", "record"}
_CALLS = {"if", "for", "while", "switch", "catch", "synchronized", "try", "return", "new", "throw", "else", "do", "assert", "case", "super", "this"}


Walk = Generator["Walk", int | None, int | None]  # a walk over tokens that gives the walks it needs and gets their results


def bracket_ends(tokens: list[str]) -> dict[int, int]:
    """For each opening bracket the index after the one that closes it, whatever their kinds."""
    out, open_ = {}, []
    for i, word in enumerate(tokens):
        if word in ("(", "[", "{"):
            open_.append(i)
        elif word in (")", "]", "}") and open_:
            out[open_.pop()] = i + 1
    return out


class _Body:
    """Counts over the tokens of one method body."""

    def __init__(self, tokens: list[str], name: str) -> None:
        self.t, self.name, self.ends = tokens, name, bracket_ends(tokens)
        self.cyclomatic, self.cognitive = 1, 0

    def measure(self) -> tuple[int, int]:
        """Walks the statements with the open calls on a list, so that nesting may be as deep as it likes."""
        calls: list[Walk] = [self.block(0, len(self.t), 0)]
        given: int | None = None
        while calls:
            try:
                calls.append(calls[-1].send(given))
                given = None
            except StopIteration as done:
                calls.pop()
                given = done.value
        return self.cyclomatic, self.cognitive

    def close(self, at: int) -> int:
        """Index after the bracket that closes the one at ``at``."""
        return self.ends.get(at, len(self.t))

    def block(self, at: int, end: int, nesting: int) -> Walk:
        while at < end:
            at = yield self.statement(at, end, nesting)

    def flow(self, nesting: int) -> None:
        self.cyclomatic += 1
        self.cognitive += 1 + nesting

    def condition(self, at: int, end: int, nesting: int) -> Walk:
        """Takes in the bracketed part at ``at``."""
        if at < end and self.t[at] == "(":
            after = self.close(at)
            yield self.expression(at + 1, after - 1, nesting)
            return after
        return at

    def statement(self, at: int, end: int, nesting: int, chained: bool = False) -> Walk:
        t = self.t
        word = t[at]
        if word == "{":
            after = self.close(at)
            yield self.block(at + 1, after - 1, nesting)
            return after
        if word == "if":
            self.cyclomatic += 1
            self.cognitive += 1 if chained else 1 + nesting
            at = (yield self.statement((yield self.condition(at + 1, end, nesting)), end, nesting + 1)) if at + 1 < end else end
            if at < end and t[at] == "else":
                if at + 1 < end and t[at + 1] == "if":
                    return (yield self.statement(at + 1, end, nesting, chained=True))
                self.cognitive += 1
                return (yield self.statement(at + 1, end, nesting + 1)) if at + 1 < end else end
            return at
        if word in ("for", "while"):
            self.flow(nesting)
            at = yield self.condition(at + 1, end, nesting)
            return (yield self.statement(at, end, nesting + 1)) if at < end else end
        if word == "do":
            self.flow(nesting)
            at = (yield self.statement(at + 1, end, nesting + 1)) if at + 1 < end else end
            return (yield self.condition(at + 1, end, nesting)) if at < end and t[at] == "while" else at
        if word == "switch":
            self.cognitive += 1 + nesting
            at = yield self.condition(at + 1, end, nesting)
            after = self.close(at) if at < end and t[at] == "{" else at
            yield self.block(at + 1, after - 1, nesting + 1)
            return max(after, at + 1)
        if word in ("case", "default"):
            self.cyclomatic += word == "case"
            while at < end and t[at] not in (":", "->"):
                at += 1
            return at + 1
        if word in ("try", "synchronized", "finally", "else"):
            return (yield self.condition(at + 1, end, nesting))
        if word == "catch":
            self.flow(nesting)
            at = yield self.condition(at + 1, end, nesting)
            return (yield self.statement(at, end, nesting + 1)) if at < end else end
        if word in ("break", "continue") and at + 1 < end and t[at + 1] != ";":
            self.cognitive += 1
        after = at
        depth = 0
        while after < end and not (t[after] == ";" and depth == 0):
            depth += (t[after] in "([{") - (t[after] in ")]}")
            after += 1
        yield self.expression(at, after, nesting)
        return after + 1

    def expression(self, at: int, end: int, nesting: int) -> Walk:
        t, last = self.t, ""
        while at < end:
            word = t[at]
            if word in ("&&", "||"):
                self.cyclomatic += 1
                self.cognitive += word != last
                last = word
            elif word == "?" and t[at - 1] not in ("<", ","):
                self.flow(nesting)
            elif word == "->" and at + 1 < end and t[at + 1] == "{":
                after = self.close(at + 1)
                yield self.block(at + 2, after - 1, nesting + 1)
                at = after
                continue
            elif word == "switch":
                at = yield self.statement(at, end, nesting)
                continue
            elif word == "{":  # an anonymous class or an array
                after = self.close(at)
                yield self.block(at + 1, after - 1, nesting + 1)
                at = after
                continue
            elif word == self.name and at + 1 < end and t[at + 1] == "(" and t[at - 1] not in (".", "new"):
                self.cognitive += 1
            elif word in (",", ";", "("):
                last = ""
            at += 1


def java_complexity(source: str) -> tuple[int, int, int]:
    """(lines, cyclomatic, cognitive) of a Java file; -1 for both where it has no method."""
    tokens = _TOKEN.findall(_NOISE.sub(lambda m: '""' if m[0][0] in "\"'" else " ", source))
    best, ends = (-1, -1), bracket_ends(tokens)
    stack: list[str] = []  # what each open brace is: a type, or something else
    start = 0
    i = 0
    while i < len(tokens):
        word = tokens[i]
        if word == "{":
            head = tokens[start:i]
            in_type = not stack or stack[-1] == "type"
            if in_type and any(w in _TYPES and (k == 0 or head[k - 1] != ".") for k, w in enumerate(head)) and not (")" in head and "record" not in head):
                stack.append("type")
            elif in_type and stack and "(" in head and "=" not in head and head[max(head.index("(") - 1, 0)] not in _CALLS:
                after = ends.get(i, len(tokens))
                best = tuple(map(max, best, _Body(tokens[i + 1 : after - 1], head[head.index("(") - 1]).measure()))
                i = after
                start = i
                continue
            else:
                stack.append("type" if in_type and any(w in _TYPES for w in head) else "other")
            start = i + 1
        elif word == "}":
            if stack:
                stack.pop()
            start = i + 1
        elif word == ";":
            start = i + 1
        i += 1
    return len(source.rstrip().split("\n")) if source.strip() else 0, *best


def file_metrics(sources: DataFrame, failures: Accumulator | None = None) -> DataFrame:
    """path, loc, cyclomatic_complexity, cognitive_complexity of the text files of ``sources`` (path, content), each read once.

    Line counts are as ``line_count`` gives them, of Java files up to the last line that is not blank, and only these have
    complexities (else -1). Files that hold a NUL byte have no row. A Java file that can't be taken apart has its byte line count and -1; ``failures`` counts these.
    """

    def measured(path: str, content: bytes) -> tuple[int, int, int] | None:
        if b"\0" in content:
            return None
        if path.endswith(".java"):
            try:
                return java_complexity(content.decode("utf-8", "replace"))
            except Exception:
                if failures is not None:
                    failures.add(1)
        return content.count(b"\n") + 1 if content else 0, -1, -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *m) for p, c in zip(batch.column(0).to_pylist(), batch.column(1)) if (m := measured(p, c.as_py() or b""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32()))], names=["path", "loc", "cyclomatic_complexity", "cognitive_complexity"])

    return sources.select("path", "content").mapInArrow(run, "path string, loc int, cyclomatic_complexity int, cognitive_complexity int")
