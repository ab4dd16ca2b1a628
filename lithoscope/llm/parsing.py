"""Source files that do not parse.

Each language has a lexer, which turns a source into a string of terminals, and
a bundled grammar, run by the table-driven recogniser of :mod:`.glr`. The
whole token string is parsed; the first token no reading admits is the error.
Code inside a token (fields of f-strings and of interpolated strings, template
expressions, command substitutions, shell arithmetic) is parsed by the same
grammars, and its token is the error if it doesn't parse.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, spread
from .glr import NEWLINE, Grammar, Parser

#: fixed values: extension -> language
LANGUAGES = {
    "py": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "rs": "rust", "go": "go",
    "java": "java", "cs": "csharp", "sh": "bash", "bash": "bash",
}
ERROR = "\x01"
#: first of the characters that stand for widths of indentation
INDENTS = 0xF0000
_NAME = r"[^\W\d]\w*"
_STRING = r'"(?:[^"\\\n]|\\[^\n]|\\\n)*"'
_QUOTED = _STRING.replace('"', "'")


def _grammar_text(file: str, tag: str | None = None) -> str:
    text = (resources.files(__package__) / "grammars" / f"{file}.txt").read_text()
    out = []
    on = True
    for line in text.splitlines():
        m = re.match(r"@(\w+) ", line)
        if m:
            on = m.group(1) == tag
            line = line[m.end() :]
        elif not line.startswith(" "):
            on = True
        if on:
            out.append(line)
    return "\n".join(out)


class _Terminals(dict):
    """Token text -> terminals; short tokens are remembered."""

    def __init__(self, classify) -> None:
        super().__init__()
        self.classify = classify

    def __missing__(self, token: str) -> str:
        value = self.classify(token)
        if len(token) < 40:
            if len(self) > 300_000:
                self.clear()
            self[token] = value
        return value


class Language:
    """Lexer and parser of one language."""

    #: alternatives of one token and what lies between tokens
    token, between = "", r"(?:[ \t\f\v\r﻿]+|//[^\n]*|/\*[\s\S]*?\*/)*"
    grammar, tag = "", None
    classes: dict[str, str] = {}
    breaks = "{};"

    def __init__(self) -> None:
        g = Grammar(_grammar_text(self.grammar, self.tag))
        self.parser = Parser(g)
        self.t = g.terminals
        self.fixed = {w: c for w, c in g.terminals.items() if not w.isupper() or len(w) == 1}
        self.classed = {w: self.t.get(c, ERROR) for c, ws in self.classes.items() for w in ws.split()}
        self.find = re.compile(f"{self.between}({self.token}|\\S|\\Z)").findall
        self.scan = re.compile(f"{self.between}({self.token}|\\S|\\Z)").finditer
        self.map = _Terminals(self.classify)
        ends = "".join(re.escape(self.t[w]) for w in self.breaks if w in self.t) + NEWLINE + self.t.get("NEWLINE", "")
        self.segments = re.compile(f"[^{ends}]*[{ends}]|[^{ends}]+").findall

    def classify(self, token: str) -> str:
        got = self.classed.get(token) or self.fixed.get(token)
        if got:
            return got
        c = token[:1]
        if not c:
            return ""
        if c.isalpha() or c in "_$":
            return self.word(token)
        if c.isdigit() or (c == "." and token[1:2].isdigit()):
            return self.t["NUM"]
        if c in "\"'`" and len(token) > 1:
            return self.quoted(token)
        if c == "\n":
            return NEWLINE
        return ERROR

    def word(self, token: str) -> str:
        return self.t["ID"]

    def quoted(self, token: str) -> str:
        return self.t["STR"]

    def parses(self, source: str) -> bool:
        return self.error_at(source) is None

    def prepare(self, source: str) -> str:
        return source.replace("\r\n", "\n").lstrip("﻿")

    def terminals(self, source: str) -> str:
        return self.finish("".join(map(self.map.__getitem__, self.find(source))))

    def finish(self, tokens: str) -> str:
        return tokens

    def error_at(self, source: str) -> int | None:
        """Index of the first token in error; None for a whole or empty text."""
        tokens = self.terminals(self.prepare(source))
        if not tokens.strip(NEWLINE):
            return None
        at = self.parser.failed_at(self.segments(tokens))
        return None if at < 0 else at

    def error_line(self, source: str, at: int) -> int:
        """Line of the token with index ``at``; the last one past the end."""
        source = self.prepare(source)
        low, high = 0, source.count("\n") + 1
        lines = source.split("\n")
        while low < high:  # the shortest prefix of lines with more tokens
            mid = (low + high) // 2
            if len(self.terminals("\n".join(lines[: mid + 1]))) > at:
                high = mid
            else:
                low = mid + 1
        return min(low + 1, len(lines))


_SKIP = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`|[()\[\]{}:,!=]|[^\"'`()\[\]{}:,!=]+|[\s\S]")


def field_end(text: str, at: int, stops: str = "") -> tuple[int, int]:
    """(stop, end) of a braced field that begins at ``at``, past its brace.

    ``end`` is the place of its closing brace, -1 without one; ``stop`` that of
    the first outer character of ``stops`` (a conversion's ``!``, but not ``!=``), else ``end``.
    """
    depth, stop = 0, -1
    for m in _SKIP.finditer(text, at):
        c = m.group()
        if c in ("(", "[", "{"):
            depth += 1
        elif c == "}" and depth <= 0:
            return (m.start() if stop < 0 else stop), m.start()
        elif c in (")", "]", "}"):
            depth -= 1
        elif not depth and stop < 0 and c in stops and not (c == "!" and text[m.end() : m.end() + 1] == "="):
            stop = m.start()
    return stop, -1


class Python(Language):
    grammar = "python"
    between = r"(?:[ \t\f\r]+|\\\n)*"
    token = (
        r"(?:[ \t\f]*(?:\#[^\n]*)?\n)+[ \t\f]*|\#[^\n]*"
        r"|(?:[rRbBuUfF]{1,2}(?=[\"']))?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''"
        r"|(?<=[fF])\"(?:[^\"\\\n{]|\\[\s\S]|\{\{|\{[^{}\n]*(?:\{[^{}\n]*\}[^{}\n]*)*\})*\"|(?<=[fF])'(?:[^'\\\n{]|\\[\s\S]|\{\{|\{[^{}\n]*(?:\{[^{}\n]*\}[^{}\n]*)*\})*'"
        r"|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"
        r"|(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*[jJ]?|\d(?:_?\d)*[jJ]|0(?:_?0)*|[1-9](?:_?\d)*)(?!\w)"
        rf"|{_NAME}|\.\.\.|->|:=|\*\*=|//=|>>=|<<=|[-+*/%@&|^]=|[=!<>]=|\*\*|//|<<|>>"
    )
    classes = {
        "CONST": "None True False", "AUG": "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=",
        "OP": "== != <= >= < > << >> // % & | ^",
    }
    breaks = ";"

    def __init__(self) -> None:
        super().__init__()
        t = self.t
        self.delta: dict[str, int] = {}
        #: widths of indentation, each a character from INDENTS on
        self.widths: dict[int, int] = {}
        self.columns: list[int] = []
        # a number, string or constant at the start of a statement takes no value
        begin, value = "".join(re.escape(t[w]) for w in ("NEWLINE", "INDENT", "DEDENT", ";")), "".join(re.escape(t[w]) for w in ("NUM", "STR", "CONST"))
        self.valued = re.compile(f"(?:(?<=[{begin}])|^)([{value}]){re.escape(t['='])}").sub
        self.opens, self.closes = (t["("], t["["], t["{"]), (t[")"], t["]"], t["}"])

    def classify(self, token: str) -> str:
        if "\n" in token and token[0] in " \t\f#\n":
            width = len(token[token.rindex("\n") + 1 :].expandtabs(8))
            if width not in self.widths:
                self.widths[width] = len(self.columns)
                self.columns.append(width)
            return NEWLINE + chr(INDENTS + self.widths[width])
        if token[:1] == "#":
            return ""
        if token[-1:] in "\"'" and len(token) > 1:
            return self.t["STR"] if self.fields_parse(token) else ERROR
        if token == "|":
            return self.t["|"]
        return super().classify(token)

    def fields_parse(self, token: str) -> bool:
        """Whether all fields of an f-string hold an expression."""
        prefix = token[: re.search(r"[\"']", token).start()].lower()
        if "f" not in prefix or "{" not in token and "}" not in token:
            return True
        quotes = 3 if token[len(prefix) : len(prefix) + 3] in ('"' * 3, "'" * 3) else 1
        return self.formats(token[len(prefix) + quotes : -quotes], "r" in prefix)

    def formats(self, body: str, raw: bool, nested: bool = False) -> bool:
        at = 0
        while (m := re.compile(r"\\N\{[^}]*\}|[{}]").search(body, at)) is not None:
            at = m.end()
            if m.group()[0] == "\\" and not raw:
                continue
            place = m.start() if m.group()[0] != "\\" else m.start() + 2
            at = place + 1
            if not nested and body[place : place + 2] in ("{{", "}}"):
                at = place + 2
                continue
            if body[place] == "}":
                return False
            stop, end = field_end(body, at, "!:")
            if end < 0:
                return False
            code = body[at:stop].strip()
            if code.endswith("=") and code[-2:-1] not in ("=", "!", "<", ">"):
                code = code[:-1]
            rest = body[stop:end]
            if rest.startswith("!"):
                kind = re.match(r"![ \t]*\w+[ \t]*", rest)
                if not kind:
                    return False
                rest = rest[kind.end() :]
            if not code or not self.parses(f"({code}\n)\n") or rest and (rest[0] != ":" or not self.formats(rest[1:], raw, True)):
                return False
            at = end + 1
        return True

    def terminals(self, source: str) -> str:
        if len(self.columns) > 60_000:  # widths of other files
            self.widths, self.columns = {}, []
            self.map.clear()
        # a marker of its own before the first line gives its indentation
        parts = re.split(f"\n([{chr(INDENTS)}-{chr(0x10FFFF)}])", "".join(map(self.map.__getitem__, self.find("\n" + source))))
        t, columns = self.t, self.columns
        out, stack, depth = [], [0], 0
        for i in range(1, len(parts), 2):
            line = parts[i + 1]
            if not line:
                continue
            if depth <= 0:
                if out:
                    out.append(t["NEWLINE"])
                column = columns[ord(parts[i]) - INDENTS]
                if column > stack[-1]:
                    stack.append(column)
                    out.append(t["INDENT"])
                else:
                    while column < stack[-1]:
                        stack.pop()
                        out.append(t["DEDENT"])
                    if column != stack[-1]:
                        out.append(ERROR)
            delta = self.delta.get(line)
            if delta is None:
                if len(self.delta) > 100_000:
                    self.delta.clear()
                delta = self.delta[line] = sum(map(line.count, self.opens)) - sum(map(line.count, self.closes))
            depth += delta
            out.append(line)
        if out:
            out.append(t["NEWLINE"])
            out += [t["DEDENT"]] * (len(stack) - 1)
        return self.valued(lambda m: m.group(1) + ERROR, "".join(out))


_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^{}`]*\})*`)*\})*`"
_JS_NUMBER = r"(?:0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?n?)(?![\w$])"


class JavaScript(Language):
    grammar, tag = "ecmascript", "js"
    between = r"(?:[ \t\f\v\r﻿ ]+|//[^\n]*|/\*[\s\S]*?\*/)*"
    lead = r"(?:=>|[=!]==?|&&|\|\||\?\?|[-+*%&|^<>]=|[=(,:;!&|?{\[+\-*%~^<>]|(?:return|typeof|case|in|of|delete|void|else|do)\b)"
    literal = r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-zA-Z]*"
    token = (
        rf"\n\s*|{lead}\s*{literal}|{_TEMPLATE}|{_STRING}|{_QUOTED}|{_JS_NUMBER}|[A-Za-z_$\u0080-￿][\w$]*"
        r"|\.\.\.|=>|===|!==|==|!=|\*\*=|\*\*|<<=|<=|<<|>=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[-+*/%&|^]="
    )
    classes = {"OP": "=== !== == != **= ** <<= <= << &&= ||= ??= && || ?? += -= *= /= %= &= |= ^= / % ^", "INC": "++ --", "GE": ">="}
    _composite = re.compile(rf"({lead})\s*({literal})\Z")

    def __init__(self) -> None:
        super().__init__()
        t = self.t
        ends = "".join(re.escape(t[w]) for w in ("ID", "NUM", "STR", "TMPL", "REGEX", ")", "]", "}", "INC", "this", "super", "null", "true", "false",
                                                 "return", "break", "continue", "debugger", "yield", ">", "!", "void"))
        words = "".join(re.escape(c) for w, c in t.items() if w.isalpha() and w.islower())
        self.idle = re.compile(f"(?<=[^{ends}{words}]){NEWLINE}+|{NEWLINE}(?={NEWLINE})").sub

    def classify(self, token: str) -> str:
        m = self._composite.match(token) if "/" in token and len(token) > 2 and token[0] not in "\"'`\n" else None
        if m:
            return super().classify(m.group(1)) + self.t["REGEX"]
        return super().classify(token)

    def quoted(self, token: str) -> str:
        if token[0] != "`":
            return self.t["STR"]
        at = 0
        while (m := re.compile(r"\\[\s\S]|\$\{").search(token, at)) is not None:
            at = m.end()
            if m.group() == "${":
                stop, end = field_end(token, at)
                if end < 0 or not self.parses(f"({token[at:end]}\n);"):
                    return ERROR
                at = end + 1
        return self.t["TMPL"]

    def prepare(self, source: str) -> str:
        source = super().prepare(source)
        return "//" + source if source.startswith("#!") else source

    def finish(self, tokens: str) -> str:
        return self.idle("", tokens + NEWLINE) if tokens else tokens  # the end may end a statement, too


class TypeScript(JavaScript):
    tag = "ts"


class Go(Language):
    grammar = "go"
    between = r"(?:[ \t\f\v\r]+|//[^\n]*|/\*(?:[^*\n]|\*(?!/))*\*/)*"
    token = (
        rf"\n\s*|/\*[\s\S]*?\*/|`[^`]*`|{_STRING}|'(?:[^'\\\n]|\\[^\n]+?)'"
        rf"|(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)i?(?!\w)|{_NAME}"
        r"|\.\.\.|:=|<-|\+\+|--|&\^=|&\^|<<=|>>=|<<|>>|&&|\|\||[-+*/%&|^=!<>]="
    )
    classes = {"ASG": "+= -= *= /= %= &= |= ^= <<= >>= &^=", "INC": "++ --", "OP": "== != <= >= < > << >> && || / % &^"}

    def __init__(self) -> None:
        super().__init__()
        t = self.t
        ends = "".join(re.escape(t[w]) for w in ("ID", "NUM", "STR", ")", "]", "}", "INC", "break", "continue", "fallthrough", "return"))
        self.ends, self.all = re.compile(f"(?<=[{ends}]){NEWLINE}").sub, t[";"]

    def classify(self, token: str) -> str:
        if token.startswith("/*"):
            return NEWLINE
        return super().classify(token)

    def finish(self, tokens: str) -> str:
        tokens = self.ends(self.all, tokens).replace(NEWLINE, "")
        return tokens if not tokens or tokens[-1] == self.all else tokens + self.all


class Java(Language):
    grammar = "java"
    between = r"(?:\s+|//[^\n]*|/\*[\s\S]*?\*/)*"
    token = (
        rf"\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|{_STRING}|'(?:[^'\\\n]|\\[^\n]+?)'"
        r"|(?:0[xX][\da-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)[lLfFdD]?(?!\w)|non-sealed\b|[A-Za-z_$\u0080-￿][\w$]*"
        r"|\.\.\.|->|::|\+\+|--|<<=|<=|<<|>=|&&|\|\||[-+*/%&|^=!]="
    )
    classes = {
        "MOD": "public protected private abstract native transient volatile strictfp", "CONST": "true false null",
        "PRIM": "int long short byte char float double boolean void", "ASG": "+= -= *= /= %= &= |= ^= <<=",
        "INC": "++ --", "OP": "== != <= << && || / % ^", "GE": ">=",
    }
    reserved = {"goto", "const", "_"}

    def classify(self, token: str) -> str:
        if token == "non-sealed":
            return self.t["nonsealed"]
        return ERROR if token in self.reserved else super().classify(token)

    def quoted(self, token: str) -> str:
        return self.t["CHAR" if token[0] == "'" else "STR"]


class CSharp(Language):
    grammar = "csharp"
    between = r"(?:\s+|//[^\n]*|/\*[\s\S]*?\*/|(?<![^\n])[ \t]*\#[^\n]*)*"
    token = (
        r"\$*\"\"\"+[\s\S]*?\"\"\"+|(?:\$@|@\$)\"(?:[^\"{]|\"\"|\{\{|\{[^{}]*\})*\"|@\"(?:[^\"]|\"\")*\""
        r"|\$\"(?:[^\"{\\\n]|\\.|\{\{|\{(?:[^{}\"\n]|\"(?:[^\"\\\n]|\\.)*\"|\{[^{}\n]*\})*\})*\""
        rf"|{_STRING}|'(?:[^'\\\n]|\\[^\n]+?)'"
        rf"|(?:0[xX][\da-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*(?:[eE][+-]?\d+)?)(?:[uU]?[lL]?|[lL][uU]|[fFdDmM])(?!\w)|@?{_NAME}"
        r"|\?\?=|\?\?|\?\.(?!\d)|=>|->|::|\.\.|\+\+|--|<<=|<=|<<|>=|&&|\|\||[-+*/%&|^=!]="
    )
    classes = {
        "MOD": "public private protected internal sealed override volatile", "CONST": "true false null",
        "PRIM": "int uint long ulong short ushort byte sbyte char float double decimal bool string object nint nuint",
        "ASG": "+= -= *= /= %= &= |= ^= <<= ??=", "INC": "++ --", "OP": "== != <= << && || / % ??", "GE": ">=",
    }

    def __init__(self) -> None:
        super().__init__()
        self.classed["<="] = self.t["<="]

    def classify(self, token: str) -> str:
        if token[0:1] in "$@" and token.endswith('"'):
            return self.t["STR"] if '"""' in token or "$" not in token[:2] or self.fields_parse(token) else ERROR
        if token[0:1] == "@" and len(token) > 1:
            return self.t["ID"]
        return super().classify(token)

    def fields_parse(self, token: str) -> bool:
        """Whether all fields of an interpolated string hold an expression."""
        body, at = token[token.index('"') + 1 : -1], 0
        while (m := re.compile(r"\{\{|\}\}|\{").search(body, at)) is not None:
            at = m.end()
            if m.group() == "{":
                stop, end = field_end(body, at, ",:")
                if end < 0 or not self.parses("class C { object f = (" + body[at:stop] + "\n); }"):
                    return False
                at = end + 1
        return True

    def quoted(self, token: str) -> str:
        return self.t["CHAR" if token[0] == "'" else "STR"]


class Rust(Language):
    grammar = "rust"
    between = r"(?:\s+|//[^\n]*)*"
    _edges = re.compile(r"/\*|\*/").finditer
    token = (
        r"[bc]?r\"[^\"]*\"|[bc]?r\#\"(?:[^\"]|\"(?!\#))*\"\#|[bc]?r\#\#\"(?:[^\"]|\"(?!\#\#))*\"\#\#|[bc]?\"(?:[^\"\\]|\\[\s\S])*\""
        r"|b?'(?:[^'\\\n]|\\(?:[nrt0\\'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}))'|'[A-Za-z_]\w*(?!')"
        rf"|(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?|\d[\d_]*\.(?![.\w]))(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w)|r\#{_NAME}|{_NAME}"
        r"|\.\.=|\.\.\.|\.\.|->|=>|::|<<=|<=|>=|&&|\|\||[-+*/%&|^=!]="
    )
    classes = {"ASG": "+= -= *= /= %= &= |= ^= <<=", "OP": "== != <= / % ^", "GE": ">="}
    reserved = set("abstract become do final macro override priv typeof unsized virtual yield".split())

    def classify(self, token: str) -> str:
        if token[-1:] in "\"#" and len(token) > 1 or token[:2] == "b'" or (token[:1] == "'" and len(token) > 2 and token[-1] == "'"):
            return self.t["STR"]
        if token[:1] == "'" and len(token) > 1:
            return self.t["LIFE"]
        if token[:2] == "r#" and len(token) > 2:
            return self.t["ID"]
        return ERROR if token in self.reserved else super().classify(token)

    # nested comments and raw strings need more than the lexer's pattern
    _spans = re.compile(r"//[^\n]*|[bc]?r(\#*)\"[\s\S]*?\"\1|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\\n]|\\.[^'\n]*)'|/\*").finditer

    def prepare(self, source: str) -> str:
        source = super().prepare(source)
        if re.match(r"#!(?!\s*\[)", source):
            source = "//" + source
        if "/*" not in source:
            return source
        out, at = [], 0
        for m in self._spans(source):
            if m.start() < at or m.group() != "/*":
                continue
            depth = 0
            for e in self._edges(source, m.start()):
                depth += 1 if e.group() == "/*" else -1
                if not depth:
                    break
            else:
                break  # never closed: what is left can't be read
            out += [source[at : m.start()], "\n" * source.count("\n", m.start(), e.end()) or " "]
            at = e.end()
        return "".join(out) + source[at:]


class Bash(Language):
    grammar = "bash"
    _define = (
        r"(?(DEFINE)(?P<dq>\"(?:[^\"\\$`]++|\\[\s\S]|(?&sub)|(?&bq)|\$)*+\")(?P<sq>'[^']*+')(?P<bq>`(?:[^`\\]|\\[\s\S])*+`)"
        r"(?P<par>\((?:[^()'\"\\`$]++|\\[\s\S]|(?&dq)|(?&sq)|(?&bq)|(?&sub)|\$|(?&par))*+\))"
        r"(?P<brace>\{(?:[^{}'\"\\`$]++|\\[\s\S]|(?&dq)|(?&sq)|(?&bq)|(?&sub)|\$|(?&brace))*+\})"
        r"(?P<sub>\$(?&par)|\$(?&brace)|\$(?&sq)))"
    )
    _part = r"(?:\\[\s\S]|(?&dq)|(?&sq)|(?&bq)|(?&sub)|\$|[^\s|&;()<>\\'\"`$])"
    _lex = regex.compile(
        _define + r"(?:[ \t\r\f]|\\\n|(?<![^\s;&|()])\#[^\n]*)*+(?P<t>\n|\(\((?:[^()]|(?&par))*+\)\)|&&|\|\||\|&|;;&|;;|;&|\d*(?:>>|>\||>&|<<<|<&|<>|<<-?|>|<)|&>>|&>|[<>]\("
        r"|[|&;()]|[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=" + _part + r"*+|(?:(?!\#)" + _part + ")" + _part + r"*+|\S)"
    )
    _here = regex.compile(r"(?<!<)<<(-?)[ \t]*(?:\\?([A-Za-z_]\w*)|(['\"])([^'\"\n]+)\3)([^\n]*)\n(?s:(?:.*?\n)??)[ \t]*(?:\2|\4)[ \t]*(?=\n|\Z)")
    _assign = re.compile(r"[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=")
    breaks = ";"

    def __init__(self) -> None:
        super().__init__()
        self.breaks_nl = self.t["NL0"]
        ends = re.escape(self.t["NL0"])
        self.segments = re.compile(f"[^{ends}]*[{ends}]|[^{ends}]+").findall

    def prepare(self, source: str) -> str:
        return self._here.sub(lambda m: "<<" + m.group(1) + "EOF" + m.group(5), super().prepare(source))

    def classify(self, token: str) -> str:
        t = self.t
        if token == "\n":
            return t["NL0"]
        if token in self.fixed:
            return self.fixed[token]
        if token in (";;", ";&", ";;&"):
            return t["CASEEND"]
        if token.startswith("((") and token.endswith("))"):
            return t["ARITH"] if self.counts(token[2:-2]) else ERROR
        if ("$(" in token or "`" in token) and len(token) > 2 and not self.inner_parse(token):
            return ERROR
        if re.fullmatch(r"\d*<<-?", token):
            return t["HEREDOC0"]
        if re.match(r"\d*[<>]|&>", token):
            return t["REDIR"]
        if self._assign.match(token):
            return t["ASSIGN"]
        if token in "\"'`|&;()<>\\" or token[0] in "\x00\x01\x02\x03\x04\x05\x06\x0e\x7f":
            return ERROR
        return t["WORD"]

    _inner = regex.compile(_define + r"\\[\s\S]|\$'(?:[^'\\]|\\[\s\S])*+'|(?P<a>\$\(\((?:[^()]|(?&par))*+\)\))|(?P<c>\$(?&par))|(?P<b>(?&bq))|(?P<q>')|(?P<d>\")")
    _values = regex.compile(_define + r"(?&sub)|(?&bq)|(?&dq)|(?&sq)|\$[\w#?*@!$-]|\d+\#[\w@]+")

    def inner_parse(self, token: str) -> bool:
        """Whether the commands and sums that a word substitutes parse."""
        quoted, at = False, 0
        while (m := self._inner.search(token, at)) is not None:
            at = m.end()
            if m.group("d"):
                quoted = not quoted
            elif m.group("q"):
                end = token.find("'", at)
                at = at if quoted or end < 0 else end + 1
            elif m.group("a"):
                if not self.counts(m.group("a")[3:-2]) and not self.parses(m.group("a")[2:-1]):
                    return False
            elif m.group("c"):
                if not self.parses(m.group("c")[2:-1]):
                    return False
            elif m.group("b") and not self.parses(re.sub(r"\\([`\\$])", r"\1", m.group("b")[1:-1])):
                return False
        return True

    def counts(self, text: str) -> bool:
        """Whether a sum parses; its operators are those of JavaScript."""
        plain = re.sub(r"[A-Za-z_]\w*", "v", self._values.sub("1", text.replace("\\\n", " ")))
        return all(not part.strip() or language("javascript").parses(f"v = ({part});") for part in plain.split(";"))

    def terminals(self, source: str) -> str:
        out = "".join(self.map[m.group("t")] for m in self._lex.finditer(source))
        # runs of newlines are one
        n = self.t["NL0"]
        return re.sub(f"{re.escape(n)}+", n, out)


_KINDS = {"python": Python, "javascript": JavaScript, "typescript": TypeScript, "go": Go, "java": Java, "csharp": CSharp, "rust": Rust, "bash": Bash}


@lru_cache(maxsize=None)
def language(name: str) -> Language:
    """The worker's parser of a language, built once."""
    return _KINDS[name]()


def parse_files(files: DataFrame, id_col: str = "file_id", path: str = "path", text: str = "source") -> DataFrame:
    """``<id_col>, language, failed, error_line`` of every file.

    ``language`` is that of the path's extension, null where none is known;
    such files, null, empty, blank and comment-only sources don't fail.
    ``error_line`` is the line of the first error that no reading recovers from,
    null without one. Each source is parsed to its end or first error. Repeated
    rows give repeated results; extra columns are not read. No shuffle.
    """
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, bad, lines = [], [], []
            for p, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                name = LANGUAGES.get(p.rsplit(".", 1)[-1].lower()) if p and "." in p else None
                names.append(name)
                at = language(name).error_at(s) if name and s else None
                bad.append(at is not None)
                lines.append(language(name).error_line(s, at) if at is not None else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(bad, pa.bool_()), pa.array(lines, pa.int64())],
                names=[id_col, "language", "failed", "error_line"],
            )

    rows = files.select(F.col(id_col).cast("bigint").alias(id_col), F.col(path).alias("p"), F.col(text).alias("s"))
    return spread(rows).mapInArrow(run, f"`{id_col}` bigint, language string, failed boolean, error_line bigint")


def failure_rates(files: DataFrame, group: str) -> DataFrame:
    """``<group>, language, files, failures, rate``; languages that are known.

    Files count as often as they are delivered; a null group is one of its own.
    """
    rows = parse_files(files, group).where("language IS NOT NULL")
    return rows.groupBy(group, "language").agg(
        F.count("*").alias("files"), F.sum(F.col("failed").cast("bigint")).alias("failures"), F.avg(F.col("failed").cast("double")).alias("rate")
    )
