"""Structure of source files: artifacts, what contains what, imports, inheritance and calls, one file in memory at a time.

A parser is a function of (path, source) that gives an `Outline`. Ours blank out strings and comments first, keeping every
place, and pair the brackets once; so declarations may take any number of lines, and braces in strings count for nothing.
`parsed` runs the parser of each file (callers may bring their own), and gives a row a file with its artifacts and
relations; a malformed file has an error instead. Identities are digests, as everywhere in this library.

Stated choices: lines within brackets end no Python block; `self.` calls are bound to a method of the class wherever in it
that stands; type arguments are no part of a base's name; a body on the line of its declaration is searched for calls.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weft.operators.extract import CONFIDENCE, NO_CALLS
from weft.sources.tables import small_batches

NAME = r"[A-Za-z_$][\w$]*"
#: How sure a call is, by language.
CALLS = {"python": 0.65, "typescript": 0.65, "java": 0.65, "rust": 0.7, "go": 0.8}
REF = "struct<commit_sha: string, path: string, symbol_id: string, start_line: int, end_line: int, content_hash: string>"
ARTIFACT = f"struct<artifact_id: string, kind: string, name: string, qualified_name: string, language: string, signature: string, source_ref: {REF}, content_hash: string, attributes: map<string,string>>"
RELATION = f"struct<relation_id: string, kind: string, from_id: string, to_ref: string, evidence: {REF}, confidence: double>"
SCHEMA = f"path string, language string, error string, artifacts array<{ARTIFACT}>, relations array<{RELATION}>"
#: Files whose outlines are held at a time.
FILES = 200


class Malformed(ValueError):
    """The file is refused whole."""


def digest(*parts: str) -> str:
    return hashlib.sha256(("\0".join(parts) + "\0").encode("utf-8", "surrogatepass")).hexdigest()


class Outline:
    """Artifacts and relations of one file, as they are found."""

    def __init__(self, path: str, source: str, language: str, commit: str):
        self.path, self.language, self.commit = path, language, commit
        self.source, self.lines = source, source.split("\n")
        self.starts = [0, *accumulate(len(x) + 1 for x in self.lines[:-1])]
        #: id, kind, name, qualified name, signature, first and last line, attributes; and kind, id, target, line.
        self.parts: list[tuple] = []
        self.links: list[tuple] = []
        self.root = self.add("FILE", path.rsplit("/", 1)[-1], path, "", 1, len(self.lines))

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def ref(self, first: int, last: int, symbol: str | None) -> dict:
        text = "\n".join(self.lines[first - 1 : last])
        return {"commit_sha": self.commit, "path": self.path, "symbol_id": symbol, "start_line": first, "end_line": last, "content_hash": "sha256:" + digest(text)}

    def add(self, kind: str, name: str, qualified: str, signature: str, first: int, last: int, parent: str | None = None, **attributes: str) -> str:
        """Add an artifact, contained in `parent` if that is given; its id."""
        told = " ".join(signature.split()) if kind in ("METHOD", "FUNCTION") else ""
        ident = "art_" + digest(self.path, kind, qualified, told)[:24]
        self.parts.append((ident, kind, name, qualified, signature.strip(), first, last, attributes))
        if parent:
            self.relate("CONTAINS", parent, ident, first)
        return ident

    def relate(self, kind: str, source: str, target: str, line: int) -> None:
        self.links.append((kind, source, target, line))

    @property
    def artifacts(self) -> list[dict]:
        """The artifacts with their references and hashes, which are made here."""
        refs = [self.ref(first, last, ident) for ident, _, _, _, _, first, last, _ in self.parts]
        return [
            {"artifact_id": ident, "kind": kind, "name": name, "qualified_name": qualified, "language": self.language, "signature": signature, "source_ref": ref, "content_hash": ref["content_hash"], "attributes": attributes}
            for (ident, kind, name, qualified, signature, _, _, attributes), ref in zip(self.parts, refs)
        ]

    @property
    def relations(self) -> list[dict]:
        """The relations with their ids, evidence and confidence."""
        sure = lambda kind: CALLS[self.language] if kind == "CALLS" and self.language in CALLS else CONFIDENCE[kind]
        return [
            {"relation_id": "rel_" + digest(self.path, kind, source, target)[:24], "kind": kind, "from_id": source, "to_ref": target, "evidence": self.ref(line, line, None), "confidence": sure(kind)}
            for kind, source, target, line in self.links
        ]

    def imported(self, target: str, signature: str, at: int, owner: str | None = None) -> None:
        line = self.line(at)
        self.add("IMPORT", target, target, signature, line, line)
        self.relate("IMPORTS", owner or self.root, "module:" + target, line)


#: What is blanked out, by language: comments, strings and characters.
QUOTED = r'"(?:\\.|[^"\\\n])*"?|' + r"'(?:\\.|[^'\\\n])*'?"
BLANKS = {
    "python": re.compile(r'("""|' + r"''')(?:\\.|[\s\S])*?(?:\1|\Z)|#[^\n]*|" + QUOTED),
    "typescript": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|`(?:\\[\s\S]|[^`\\])*`?|" + QUOTED),
    "java": re.compile(r'//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|"""[\s\S]*?(?:"""|\Z)|' + QUOTED),
    "go": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|`[^`]*`?|" + QUOTED),
    "rust": re.compile(r'//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|r(#+)"[\s\S]*?(?:"\1|\Z)|r"[^"]*"?|"(?:\\[\s\S]|[^"\\])*"?|' + r"'(?:\\[^\n']{1,10}|\\'|[^'\\\n])'"),
}


NO_LINE_END = re.compile(r"[^\n]")
BRACKET = re.compile(r"[()\[\]{}]")
PAIRS = {")": "(", "]": "[", "}": "{"}


def blanked(source: str, language: str) -> str:
    """The source with spaces for strings and comments, line ends kept."""
    return BLANKS[language].sub(lambda m: spaces(m[0]), source)


def spaces(text: str) -> str:
    return NO_LINE_END.sub(" ", text) if "\n" in text else " " * len(text)


def hidden(bare: str, spans: list[tuple[int, int]]) -> str:
    """The text with spaces for the spans, line ends kept."""
    out, at = [], 0
    for a, z in sorted(spans):
        if z > (a := max(a, at)):
            out += [bare[at:a], spaces(bare[a:z])]
            at = z
    return "".join([*out, bare[at:]])


class Brackets:
    """For each opening bracket its closing one, and which braces are around a place."""

    def __init__(self, bare: str, strict: bool):
        self.close: dict[int, int] = {}
        self.up: dict[int, int] = {}
        opened: list[int] = []
        for m in BRACKET.finditer(bare):
            at, sign = m.start(), m[0]
            if sign in "([{":
                self.up[at] = opened[-1] if opened else -1
                opened.append(at)
            elif opened and bare[opened[-1]] == PAIRS[sign]:
                self.close[opened.pop()] = at
            elif strict:
                raise Malformed(f"a bracket too many at place {at}")
        if strict and opened:
            raise Malformed(f"the bracket at place {opened[-1]} is not closed")
        self.places = list(self.up)  # found in order
        self.end = len(bare)

    def around(self, at: int) -> int:
        """The innermost bracket that is open at a place, or -1."""
        i = bisect_left(self.places, at) - 1
        found = self.places[i] if i >= 0 else -1
        while found >= 0 and self.close.get(found, self.end) < at:
            found = self.up[found]
        return found


def calls_in(out: Outline, bare: str, first: int, last: int, pattern: re.Pattern, skip: set[str]) -> Iterator[tuple[str, int]]:
    """(name, line) of the calls between two places, distinct within each line."""
    seen: set[tuple[str, int]] = set()
    for m in pattern.finditer(bare, first, last):
        told = ("".join(m[1].split()), out.line(m.start(1)))
        if told[0] not in skip and told not in seen:
            seen.add(told)
            yield told


CALL = re.compile(rf"(?<![\w$])({NAME}(?:\.{NAME})?)\s*\(")
PY_DECLARATION = re.compile(r"^([ \t]*)(?:(class)|(async[ \t]+)?(def))[ \t]+", re.M)
PY_NAME, PY_CLASS_END, PY_DEF_END = (re.compile(x) for x in (r"([A-Za-z_]\w*)\s*", r"\s*:", r"\s*(->[^:]+?)?\s*:"))
PY_IMPORT = re.compile(r"^[ \t]*(?:from[ \t]+([\w.]+)[ \t]+import\b|import[ \t]+([\w., \t]+))", re.M)


def python(path: str, source: str, commit: str) -> Outline:
    """Nested by indentation; a declaration reaches to the colon after its brackets."""
    out, bare = Outline(path, source, "python", commit), blanked(source, "python")
    brackets = Brackets(bare, False)
    inside = {out.line(at) for a, z in brackets.close.items() for at in out.starts[out.line(a) : out.line(z)]}
    indents = {}
    for n, line in enumerate(bare.split("\n"), 1):
        if line.strip() and n not in inside:
            indents[n] = len(line) - len(line.lstrip(" \t"))
    numbers = sorted(indents)
    open_parts = [(-1, path.removesuffix(".py"), out.root, "FILE", len(out.lines))]
    found, methods, heads = [], {}, []
    for m in PY_DECLARATION.finditer(bare):
        first = out.line(m.start())
        if first in inside:
            continue
        named = PY_NAME.match(bare, m.end())
        at = named.end() if named else m.end()
        params = ""
        if named and bare[at : at + 1] == "(" and at in brackets.close:
            params, at = source[at : brackets.close[at] + 1], brackets.close[at] + 1
        tail = (PY_CLASS_END if m[2] else PY_DEF_END).match(bare, at)
        if not named or not tail or (m[4] and not params):
            raise Malformed(f"line {first}: the declaration has no end")
        indent = len(m[1])
        while indent <= open_parts[-1][0] or first > open_parts[-1][4]:
            open_parts.pop()
        last = first
        for n in numbers[bisect_right(numbers, first) :]:
            if indents[n] <= indent:
                break
            last = n
        last = max(last, out.line(tail.end() - 1))
        _, owner, parent, kind, _ = open_parts[-1]
        qualified = f"{owner}.{named[1]}"
        if m[2]:
            mine = "CLASS"
            ident = out.add(mine, named[1], qualified, out.lines[first - 1], first, last, parent)
            for base in filter(None, map(str.strip, params[1:-1].split(","))):
                out.relate("EXTENDS", ident, "symbol:" + base, first)
        else:
            mine = "METHOD" if kind == "CLASS" else "FUNCTION"
            told = " ".join((named[1] + params + (" " + source[tail.start(1) : tail.end(1)] if tail[1] else "")).split())
            ident = out.add(mine, named[1], qualified, told, first, last, parent, **({"async": "true"} if m[3] else {}))
            methods[qualified] = ident
            found.append((first, last, ident, owner if mine == "METHOD" else None))
        heads.append((m.start(), tail.end()))
        open_parts.append((indent, qualified, ident, mine, last))
    for m in PY_IMPORT.finditer(bare):
        for name in [m[1]] if m[1] else [x.split()[0] for x in m[2].split(",") if x.strip()]:
            out.imported(name, m[0].strip(), m.end() - 1)
    first_lines = [f for f, _, _, _ in found]
    for name, line in calls_in(out, hidden(bare, heads), 0, len(bare), CALL, set(NO_CALLS)):
        at = bisect_right(first_lines, line) - 1
        while at >= 0 and found[at][1] < line:  # the innermost function around the line
            at -= 1
        if at >= 0:
            _, _, ident, owner = found[at]
            own = methods.get(f"{owner}.{name[5:]}") if owner and name.startswith("self.") else None
            out.relate("CALLS", ident, own or "symbol:" + name, line)
    return out


def bases_of(header: str) -> tuple[list[str], list[str]]:
    """What a header extends and implements, without type arguments."""
    while header != (header := re.sub(r"<[^<>]*>", " ", header)):
        pass
    parts = re.split(r"\b(extends|implements)\b", header)
    names: dict[str, list[str]] = {"extends": [], "implements": []}
    for word, told in zip(parts[1::2], parts[2::2]):
        names[word] += [x for x in map(str.strip, told.split(",")) if x]
    return names["extends"], names["implements"]


TYPE = re.compile(rf"(?<![\w$.])(class|interface)\s+({NAME})")
TS_FUNCTION = re.compile(rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({NAME})\s*(?:<[^()]*>)?\s*(\()", re.M)
TS_ARROW = re.compile(rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+({NAME})\s*(?::[^=\n]+)?=\s*(?:async\b\s*)?(?:<[^()]*>\s*)?(?:(\()|{NAME}\s*=>)", re.M)
TS_METHOD = re.compile(rf"(?:^|(?<=[{{;}}]))[ \t]*(?:(?:public|private|protected|static|async|readonly|abstract|override|get|set)\s+)*\*?({NAME})\s*(?:<[^()]*>)?\s*(\()", re.M)
JAVA_METHOD = re.compile(rf"(?:^|(?<=[{{;}}]))[ \t]*(?:@\w+\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>()]+>\s+)?(?:([\w$<>\[\],.? ]+?)\s+)?({NAME})\s*(\()", re.M)
TS_IMPORT = re.compile(r"""^[ \t]*import\s+(?:[^'";]+?\s+from\s+)?["']([^"'\n]+)["']|\brequire\s*\(\s*["']([^"'\n]+)["']\s*\)""", re.M)
JAVA_IMPORT = re.compile(r"^[ \t]*import\s+(?:static\s+)?([\w.*]+)\s*;", re.M)
BODY, BODY_OR_END = re.compile(r"\s*\{"), re.compile(r"[{;]")
#: What stands between parameters and a body, by kind or language, and whether there is no list of parameters.
TAILS = {
    ("java", False): re.compile(r"\s*throws[\w$., \n]+(?=[{;])|\s*(?=[{;])"),
    ("typescript", False): re.compile(r"\s*(?::[^={;]+)?(?=[{;])"),
    ("FUNCTION", False): re.compile(r"\s*(?::[^={;]+)?(?=\{)"),
    ("ARROW", False): re.compile(r"\s*(?::[^={;]+)?=>"),
    ("ARROW", True): re.compile(""),
}
NOT_NAMES = {*NO_CALLS, "else", "do", "try", "throw", "await", "typeof", "case", "synchronized"}


def braced(language: str) -> Callable[[str, str, str], Outline]:
    """TypeScript and Java: nested by braces."""

    def declarations(bare: str, brackets: Brackets) -> Iterator[tuple]:
        """(place, kind, name, place of its parameters, where its head ends): a brace, a semicolon, or an arrow's end."""
        for m in TYPE.finditer(bare):
            end = BODY_OR_END.search(bare, m.end())
            yield m.start(), m[1].upper(), m[2], m.end(2), end.start() if end else len(bare)
        forms = [(JAVA_METHOD, "METHOD")] if language == "java" else [(TS_FUNCTION, "FUNCTION")] * ("function" in bare) + [(TS_ARROW, "ARROW")] * ("=>" in bare) + [(TS_METHOD, "METHOD")]
        for pattern, kind in forms:
            for m in pattern.finditer(bare):
                name, at = (m[2], m.start(3)) if language == "java" else (m[1], m.start(2))
                if name in NOT_NAMES or language == "java" and m[1] and m[1].split()[0] in NOT_NAMES:
                    continue
                after = m.end() if at < 0 else brackets.close.get(at, -1) + 1
                tail = after > 0 and TAILS[kind if kind != "METHOD" else language, at < 0].match(bare, after)
                if tail:
                    # a method without a type in front of it is Java's constructor, if its name is the class's
                    yield m.start() + len(m[0]) - len(m[0].lstrip()), "CONSTRUCTOR" if language == "java" and not m[1] else kind, name, at if at >= 0 else m.end(1), tail.end()

    def parse(path: str, source: str, commit: str) -> Outline:
        out, bare = Outline(path, source, language, commit), blanked(source, language)
        brackets = Brackets(bare, False)
        open_parts = [(len(bare) + 1, path, out.root, "FILE", -1)]
        bodies, heads = [], []
        for at, kind, name, params, head in sorted(declarations(bare, brackets), key=lambda d: (d[0], d[1] in ("METHOD", "CONSTRUCTOR"))):
            while at >= open_parts[-1][0]:
                open_parts.pop()
            _, owner, parent, around, body = open_parts[-1]
            in_type = around in ("CLASS", "INTERFACE")
            if kind in ("METHOD", "CONSTRUCTOR") and not (in_type and brackets.around(at) == body) or kind == "CONSTRUCTOR" and name != owner.rsplit(".", 1)[-1]:
                continue
            start = BODY.match(bare, head)
            brace = start.end() - 1 if start else -1
            if start and kind not in ("CLASS", "INTERFACE") and (body_after := BODY.match(bare, brackets.close.get(brace, len(bare)) + 1)):
                brace = body_after.end() - 1  # the first pair was a type
            semicolon = bare.find(";", head)
            close = brackets.close.get(brace, len(bare) - 1) if start else (semicolon if semicolon >= 0 else head)
            first, last = out.line(at), out.line(close)
            qualified = f"{owner}.{name}"
            if kind in ("CLASS", "INTERFACE"):
                mine = kind
                ident = out.add(mine, name, qualified, out.lines[first - 1], first, last, parent)
                for word, names in zip(("EXTENDS", "IMPLEMENTS"), bases_of(bare[params:head])):
                    for base in names:
                        out.relate(word, ident, "symbol:" + base, first)
            else:
                mine = "METHOD" if in_type else "FUNCTION"
                ident = out.add(mine, name, qualified, name + source[params:head].removesuffix("=>"), first, last, parent)
                bodies.append((head, close, ident))
            heads.append((at, head))
            open_parts.append((close + 1, qualified, ident, mine, brace))
        text, begins = hidden(bare, heads), [b for b, _, _ in bodies]
        for m in (JAVA_IMPORT if language == "java" else TS_IMPORT).finditer(source) if "import" in bare or "require" in bare else ():
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            if bare[at : at + 6] in ("import", "requir"):
                out.imported(m[1] or m[2], m[0].strip(), at)
        seen = set()
        for m in CALL.finditer(text):
            i = bisect_right(begins, m.start()) - 1
            while i >= 0 and bodies[i][1] < m.start():
                i -= 1
            told = (bodies[i][2], m[1], out.line(m.start())) if i >= 0 else None
            if told and m[1] not in NO_CALLS and told not in seen:
                seen.add(told)
                out.relate("CALLS", told[0], "symbol:" + m[1], told[2])
        return out

    return parse


RUST_DECLARATION = re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe|default)\s+)*(mod|struct|enum|trait|fn)\s+([A-Za-z_]\w*)", re.M)
RUST_STOP, RUST_ARGUMENTS, RUST_LAST_NAME = re.compile(r"[{;(\[]"), re.compile(r"<[^<>]*>"), re.compile(r"([A-Za-z_]\w*)\s*$")
RUST_USE = re.compile(r"^[ \t]*(?:pub\s+)?use\s+([^;]+);", re.M)
RUST_IMPL = re.compile(r"^[ \t]*(?:unsafe\s+)?impl\b", re.M)
RUST_KINDS = {"mod": "MODULE", "struct": "CLASS", "enum": "CLASS", "trait": "INTERFACE", "fn": "FUNCTION"}


def bound(out: Outline, names: list[tuple[str, str]]) -> dict[str, str]:
    """Ids by name, of names that only one artifact of the file has."""
    by: dict[str, list[str]] = {}
    for name, ident in names:
        by.setdefault(name, []).append(ident)
    return {n: ids[0] for n, ids in by.items() if len(ids) == 1}


def rust(path: str, source: str, commit: str) -> Outline:
    """Declarations of any depth; a function inside an `impl` is a method of its type."""
    out, bare = Outline(path, source, "rust", commit), blanked(source, "rust")
    brackets, stem = Brackets(bare, True), path.removesuffix(".rs")

    def body(at: int) -> tuple[int, int]:
        """Where the block after a place begins and ends, or its semicolon."""
        while (m := RUST_STOP.search(bare, at)) and m[0] not in "{;":
            at = brackets.close.get(m.start(), m.start()) + 1
        at = m.start() if m else len(bare)
        return at, brackets.close.get(at, min(at, len(bare) - 1))

    owners = []
    for m in RUST_IMPL.finditer(bare):
        begin, end = body(m.end())
        head = bare[m.end() : begin]
        while head != (head := RUST_ARGUMENTS.sub("", head)):
            pass
        named = RUST_LAST_NAME.search(re.split(r"\bwhere\b", re.split(r"\bfor\b", head)[-1])[0])
        if named:
            owners.append((begin, end, named[1]))
    for m in RUST_USE.finditer(bare):
        out.imported(" ".join(m[1].split()), m[1].strip(), m.start(1))
    names, bodies = [], []
    for m in RUST_DECLARATION.finditer(bare):
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        begin, end = body(m.end())
        owner = next((o for a, z, o in reversed(owners) if a < at < z), None) if m[1] == "fn" else None
        kind = "METHOD" if owner else RUST_KINDS[m[1]]
        first = out.line(at)
        ident = out.add(kind, m[2], "::".join(filter(None, (stem, owner, m[2]))), out.lines[first - 1].strip(), first, out.line(end), out.root)
        names.append((m[2], ident))
        if m[1] == "fn":
            bodies.append((m.end(), end, m[2], ident))
    local = bound(out, names)
    for at, end, own, ident in bodies:
        for name, line in calls_in(out, bare, at, end, CALL, {*NO_CALLS, own}):
            out.relate("CALLS", ident, local.get(name, "symbol:" + name), line)
    return out


GO_PACKAGE = re.compile(r"^[ \t]*package\s+([A-Za-z_]\w*)", re.M)
GO_TOP = re.compile(r"^(import|type|func)\b[ \t]*", re.M)
GO_TYPE = re.compile(r"[ \t\n;]*([A-Za-z_]\w*)\s*(\[[^\]\n]+\]\s*(?=[A-Za-z*\[]))?(?:=\s*)?(struct|interface)?\b")
GO_RECEIVER = re.compile(r"\(\s*(?:[A-Za-z_]\w*\s+)?\*?\s*([A-Za-z_]\w*)")
GO_CALL = re.compile(r"(?<![\w\]])([A-Za-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)*)\s*\(")
#: The language's keywords that stand before a bracket.
GO_WORDS = {"func", "if", "for", "switch", "return", "range", "go", "defer", "select", "case", "map", "chan", "struct", "interface", "import", "type", "var", "const", "else"}


def go(path: str, source: str, commit: str) -> Outline:
    """Top-level declarations, in two passes: symbols first, then the calls of each function, bound where a name is only once."""
    out, bare = Outline(path, source, "go", commit), blanked(source, "go")
    brackets = Brackets(bare, True)
    named = GO_PACKAGE.search(bare)
    if not named:
        raise Malformed("no package clause")
    package = named[1]
    owner = out.add("MODULE", package, package, "package " + package, 1, 1, out.root)
    names, bodies = [], []

    def declare(kind: str, name: str, qualified: str, at: int, end: int) -> str:
        first = out.line(at)
        ident = out.add(kind, name, qualified, out.lines[first - 1].strip(), first, out.line(end), owner)
        names.append((name, ident))
        return ident

    def statement_end(at: int) -> int:
        """The line end at which a declaration ends: not within brackets, and not after an operator."""
        going_on = False
        while at < len(bare):
            if at in brackets.close:
                at, going_on = brackets.close[at] + 1, False
            elif bare[at] in ";)" or bare[at] == "\n" and not going_on:
                return at
            else:
                going_on = bare[at] in "|,=." or going_on and bare[at] in " \t\n"
                at += 1
        return len(bare)

    for m in GO_TOP.finditer(bare):
        if brackets.around(m.start()) >= 0:
            continue
        at = m.end()
        if m[1] == "import":
            grouped, at = brackets.close.get(at), m.end(1)  # a path is blank
            end = grouped or statement_end(at)
            for x in re.compile(r'"([^"\n]*)"|`([^`]*)`').finditer(source, at, end):
                if source[out.starts[out.line(x.start()) - 1] : x.start()].find("//") < 0:
                    out.imported(x[1] if x[1] is not None else x[2], x[1] or x[2] or "", x.start(), owner)
        elif m[1] == "type":
            last = brackets.close[at] if at in brackets.close else None
            at = at + 1 if last is not None else at
            while spec := GO_TYPE.match(bare, at, last if last is not None else len(bare)):
                end = statement_end(spec.end(1))
                declare("INTERFACE" if spec[3] == "interface" else "CLASS", spec[1], f"{package}.{spec[1]}", spec.start(1), end - 1)
                at = end
                if last is None:
                    break
        else:
            receiver = GO_RECEIVER.match(bare, at) if at in brackets.close else None
            at = brackets.close[at] + 1 if at in brackets.close else at
            name = re.compile(r"\s*([A-Za-z_]\w*)").match(bare, at)
            if not name:
                raise Malformed(f"line {out.line(m.start())}: a function without a name")
            end = statement_end(name.end())
            kind, qualified = ("METHOD", f"{package}.{receiver[1]}.{name[1]}") if receiver else ("FUNCTION", f"{package}.{name[1]}")
            ident = declare(kind, name[1], qualified, m.start(), end - 1)
            parameters = bare.find("(", name.end())
            bodies.append((brackets.close.get(parameters, end), end, ident))
    local = bound(out, names)
    for at, end, ident in bodies:
        for name, line in calls_in(out, bare, at, end, GO_CALL, GO_WORDS):
            out.relate("CALLS", ident, local.get(name.rsplit(".", 1)[-1], "symbol:" + name), line)
    return out


Parser = Callable[[str, str, str], Outline]
PARSERS: dict[str, Parser] = {"python": python, "typescript": braced("typescript"), "java": braced("java"), "rust": rust, "go": go}


def parsed(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """path, language, error, artifacts and relations of every file that has a parser (path, content, parser, commit_sha).

    parsers: by name; a caller's take the place of ours. A file is bounded by the admission rule, and nothing else is held."""
    shape = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def made(found: list[tuple[str, str, Outline | Malformed]]) -> pa.RecordBatch:
        rows = []
        for path, name, out in found:
            if isinstance(out, Malformed):
                rows.append((path, name, str(out), [], []))
            else:
                rows.append((path, name, None, [{**a, "attributes": list(a["attributes"].items())} for a in out.artifacts], out.relations))
        columns = zip(*rows) if rows else [()] * len(shape)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, shape)], schema=shape)

    return outlined(files, parsers, made, SCHEMA)


LISTED = "path string, kind string, name string, target string, first int, last int"


def listed(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """A row for each artifact (without a target) and relation of every sound file, by qualified names, with its lines.

    Ids and hashes that nobody asks for are not made, and there are no nested rows."""
    shape = to_arrow_schema(StructType.fromDDL(LISTED))

    def made(found: list[tuple[str, str, Outline | Malformed]]) -> pa.RecordBatch:
        rows = []
        for path, _, out in found:
            if isinstance(out, Outline):
                names = {part[0]: part[3] for part in out.parts}
                rows += [(path, kind, qualified, None, first, last) for _, kind, _, qualified, _, first, last, _ in out.parts]
                rows += [(path, kind, names.get(source), names.get(target, target), line, line) for kind, source, target, line in out.links]
        columns = zip(*rows) if rows else [()] * len(shape)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

    return outlined(files, parsers, made, LISTED)


def outlined(files: DataFrame, parsers: dict[str, Parser] | None, made: Callable[[list], pa.RecordBatch], schema: str) -> DataFrame:
    """What `made` gives for the outlines of FILES files at a time."""
    own = {**PARSERS, **(parsers or {})}

    def outline(path: str, content: str | None, name: str, commit: str | None) -> Outline | Malformed:
        try:
            return own[name](path, content or "", commit)
        except Malformed as e:
            return e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), FILES):
                rows = zip(*(c.to_pylist() for c in batch.slice(at, FILES).columns))
                yield made([(path, name, outline(path, content, name, commit)) for path, content, name, commit in rows if name in own])

    commit = F.col("commit_sha") if "commit_sha" in files.columns else F.lit(None)
    rows = files.select("path", F.col("content").cast("string").alias("content"), "parser", commit.cast("string").alias("commit_sha"))
    spark = files.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    small_batches(spark)
    return rows.repartition(tasks, "path").mapInArrow(run, schema)  # listings have few partitions, and parsing is slow


def artifacts(found: DataFrame) -> DataFrame:
    return found.select(F.explode("artifacts").alias("a")).select("a.*")


def relations(found: DataFrame) -> DataFrame:
    """A row for each relation; where a file has one several times, its first evidence."""
    each = found.select(F.posexplode("relations").alias("n", "r")).select("n", "r.*")
    rest = [c for c in each.columns if c not in ("n", "relation_id")]
    return each.groupBy("relation_id").agg(F.min_by(F.struct(*rest), "n").alias("r")).select("relation_id", "r.*")


def parts(files: DataFrame) -> DataFrame:
    """Types and functions with their names within the file and their lines."""
    each = parsed(files).select("path", F.explode("artifacts").alias("a")).select("path", "a.kind", "a.name", "a.qualified_name", "a.source_ref.start_line", "a.source_ref.end_line")
    stem = F.regexp_replace("path", r"\.(py|rs)$", "")
    within = F.when(F.startswith("qualified_name", F.concat("path", F.lit("."))), F.expr("substring(qualified_name, length(path) + 2)"))
    within = F.coalesce(within, F.when(F.startswith("qualified_name", stem), F.regexp_replace(F.expr("substring(qualified_name, length(regexp_replace(path, r'\\.(py|rs)$', '')) + 1)"), "^(::|\\.)", "")), "qualified_name")
    return each.where(~F.col("kind").isin("FILE", "IMPORT")).select("path", "kind", "name", within.alias("qualified_name"), "start_line", "end_line")
