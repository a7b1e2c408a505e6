"""Tokenizers for TypeScript and Ruby: what is code and what is text, and where top-level definitions lie.

Both blank whatever is no code (strings, comments, regular expressions, heredocs, the text between template
expressions) and keep all positions, so that brackets and keywords can be followed by a stack.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Definition:
    """A top-level definition: kind (function, class, interface, type, const; for Ruby def, class, module), name and range."""

    kind: str
    name: str
    start: int
    stop: int
    exported: bool = False
    outer: int = -1  # where the export statement around it begins
    value: str = ""  # of a const: the code of its value


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


_BEFORE_REGEX = set("(,=:[!&|?{};+-*%~^") | {""}
_WORDS_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "do", "else", "yield", "await"}


def typescript_code(text: str) -> str:
    """The text with comments, strings, regular expressions and the fixed parts of templates blanked."""
    out: list[str] = []
    i, n = 0, len(text)
    last, word = "", ""  # the last significant character, and the word that it ends
    depths: list[int] = []  # brace depth at each open template expression
    depth = 0

    def template(at: int) -> int:
        """From inside a template to its end or past the next ${; blanks what it passes."""
        nonlocal depth
        k = at
        while k < n:
            if text[k] == "\\":
                k += 2
            elif text[k] == "`":
                out.append(_blank(text[at : k + 1]))
                return k + 1
            elif text.startswith("${", k):
                out.append(_blank(text[at : k + 2]))
                depths.append(depth)
                return k + 2
            else:
                k += 1
        out.append(_blank(text[at:n]))
        return n

    while i < n:
        c = text[i]
        if text.startswith("//", i):
            end = text.find("\n", i)
            end = n if end < 0 else end
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
        elif c in "\"'":
            found = re.compile(rf"{c}(?:\\.|[^\\\n{c}])*{c}", re.S).match(text, i)
            end = found.end() if found else i + 1
            last, word = '"', ""
        elif c == "`":
            out.append('"')
            i = template(i + 1)
            last, word = '"', ""
            continue
        elif c == "/" and (last in _BEFORE_REGEX or word in _WORDS_BEFORE_REGEX) and (found := re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*").match(text, i)):
            end, last, word = found.end(), '"', ""
        else:
            if c == "}" and depths and depth == depths[-1]:
                depths.pop()
                out.append(" ")
                i = template(i + 1)
                last, word = '"', ""
                continue
            depth += (c == "{") - (c == "}")
            if not c.isspace():
                word = (word if last and (last.isalnum() or last in "_$") and text[i - 1] == last else "") + c if c.isalnum() or c in "_$" else ""
                last = c
            out.append(c)
            i += 1
            continue
        # a quote mark stays where text was, so that it still ends a value
        out.append(_blank(text[i:end]) if text.startswith(("//", "/*"), i) else '"' + _blank(text[i + 1 : end]))
        i = end
    return "".join(out)[:n]


_TS_HEAD = re.compile(r"(export\s+(?:default\s+)?)?(?:(abstract\s+class|class|interface)\s+(?!extends\b|implements\b)([A-Za-z_$][\w$]*)|(type)\s+([A-Za-z_$][\w$]*)\s*(?=[<=])|(?:async\s+)?(function)\s*\*?\s*([A-Za-z_$][\w$]*)|(const|let)\s+(?=[A-Za-z_$\[{]))")
_CONTINUES = re.compile(r"\s*(?:[|&.?:+*/,=<>)\]}-]|as\b|satisfies\b|extends\b|instanceof\b|in\b)")
_OPEN_END = re.compile(r"(?:[=|&?:+*/,<(\[{.-]|=>|\bextends|\bkeyof|\btypeof)\s*$")


def _close(code: str, at: int) -> int:
    """The position after the bracket that closes the one at ``at``."""
    depth = 0
    for k in range(at, len(code)):
        if code[k] in "([{":
            depth += 1
        elif code[k] in ")]}":
            depth -= 1
            if depth == 0:
                return k + 1
    return len(code)


def _body(code: str, at: int) -> int:
    """The end of a body in braces that follows ``at``, past parameters and types; -1 if the statement ends before it."""
    angle, k = 0, at
    typed = False  # in a type after a colon, where braces are types
    while k < len(code):
        c = code[k]
        if c == "{" and angle <= 0 and not (typed and re.search(r"[:|&]\s*$", code[at:k])):
            return _close(code, k)
        if c in "([{":
            k = _close(code, k)
            continue
        if c == "<":
            angle += 1
        elif c == ">" and code[k - 1] != "=":
            angle -= 1
        elif c == ":":
            typed = True
        elif c == ";" or c in ")]}":
            return -1
        k += 1
    return -1


def _statement(code: str, at: int) -> int:
    """The end of a statement: a semicolon, or a line end after which nothing goes on."""
    k = at
    while k < len(code):
        c = code[k]
        if c in "([{":
            k = _close(code, k)
            continue
        if c == ";":
            return k + 1
        if c in ")]}":
            return k
        if c == "\n" and code[at:k].strip() and not _OPEN_END.search(code[at:k]) and not _CONTINUES.match(code, k):
            return k
        k += 1
    return len(code)


def typescript_definitions(text: str) -> list[Definition]:
    """The functions, classes, interfaces, type aliases and const or let statements that stand outside all brackets."""
    code, out, i, fresh = typescript_code(text), [], 0, True
    while i < len(code):
        c = code[i]
        if c.isspace():
            i += 1
            fresh |= c == "\n"
            continue
        if fresh and (m := _TS_HEAD.match(code, i)) and (i == 0 or not (code[i - 1].isalnum() or code[i - 1] in "_$.")):
            start = m.end(1) if m[1] else i
            kind = "function" if m[6] else "class" if m[2] and m[2].endswith("class") else m[2] or m[4] or "const"
            name = m[3] or m[5] or m[7] or ""
            stop = _body(code, m.end()) if kind in ("function", "class", "interface") else _statement(code, m.end())
            if stop < 0:  # a signature without a body
                i, fresh = _statement(code, m.end()), True
                continue
            if kind == "const":
                for declared, value in _declarators(code, m.end(), stop):
                    out.append(Definition(kind, declared, start, stop, bool(m[1]), i, value))
            else:
                out.append(Definition(kind, name, start, stop, bool(m[1]), i))
            i, fresh = stop, True
            continue
        if c in "([{":
            i = _close(code, i)
            fresh = code[i - 1 : i] == "}"
            continue
        fresh = c == ";"
        i += 1
    return out


def _declarators(code: str, at: int, stop: int) -> list[tuple[str, str]]:
    """(name, value) of each name in a const or let statement; patterns have no name."""
    out, k, begin = [], at, at
    angle = 0
    while k <= stop:
        c = code[k : k + 1] if k < stop else ","
        if c in ("(", "[", "{"):
            k = _close(code, k)
            continue
        if c == "<" and re.search(r"[\w$]\s*$|=\s*$", code[begin:k]):
            angle += 1
        elif c == ">" and code[k - 1] != "=" and angle:
            angle -= 1
        elif c == "," and not angle or k == stop:
            part = code[begin:k].strip().rstrip(";")
            if m := re.match(r"([A-Za-z_$][\w$]*)\s*(!?\s*:)?", part):
                rest = part[m.end() :]
                out.append((m[1], _value(rest, bool(m[2]))))
            begin = k + 1
        k += 1
    return out


def _value(rest: str, typed: bool) -> str:
    """What follows the equals sign of a declarator, past its type; empty without one."""
    k = 0
    while k < len(rest):
        if rest[k] in "([{":
            k = _close(rest, k)
        elif rest[k] == "=" and rest[k : k + 2] not in ("=>", "=="):
            return rest[k + 1 :].lstrip()
        elif not typed and not rest[k].isspace():
            return ""
        else:
            k += 1
    return ""


def is_function_value(value: str) -> bool:
    """Whether a value is an arrow function or a function expression itself, not a call that has one."""
    value = re.sub(r"^async\b\s*", "", value)
    if re.match(r"function\b", value):
        return _body(value, 8) >= len(value.rstrip())
    if re.match(r"[A-Za-z_$][\w$]*\s*=>", value):
        return True
    if value.startswith("<"):
        depth = 0
        for k, c in enumerate(value):
            depth += (c == "<") - (c == ">" and value[k - 1] != "=")
            if not depth:
                value = value[k + 1 :].lstrip()
                break
    if not value.startswith("("):
        return False
    after = value[_close(value, 0) :]
    return bool(re.match(r"\s*=>", after)) or bool(re.match(r"\s*:[^;]*?=>", after, re.S))


# --- Ruby

_HEREDOC = re.compile(r"<<([~-]?)([\"'`]?)([A-Za-z_]\w*)\2")
_RB_PERCENT = re.compile(r"%[qQwWiIrsx]?([^\w\s])")
_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
_RB_VALUE_END = re.compile(r"[\w)\]}\"'?!]$")
_RB_BEFORE_VALUE = re.compile(r"(?:^|[^\w.:@$])(?:if|unless|while|until|and|or|not|when|in|then|do|else|elsif|return|puts|case|begin)$")


def ruby_code(text: str) -> str:
    """The text with comments, strings, symbols in quotes, word lists, regular expressions and heredocs blanked."""
    out: list[str] = []
    i, n = 0, len(text)
    pending: list[tuple[str, bool]] = []  # heredocs whose bodies begin on the next line

    def skip(at: int, close: str, opens: str = "") -> int:
        depth, k = 1, at
        while k < n:
            if text[k] == "\\":
                k += 2
                continue
            if opens and text[k] == opens:
                depth += 1
            elif text[k] == close:
                depth -= 1
                if not depth:
                    return k + 1
            k += 1
        return n

    while i < n:
        c = text[i]
        line = "".join(out[-200:]).rsplit("\n", 1)[-1].rstrip() if c in "/%<?" else ""
        if c == "\n":
            out.append(c)
            i += 1
            while pending:
                mark, indented = pending.pop(0)
                end = re.compile(rf"^{'[ \t]*' if indented else ''}{mark}[ \t]*$", re.M).search(text, i)
                stop = end.end() if end else n
                out.append(_blank(text[i:stop]))
                i = stop
                if pending and i < n:  # the next body begins on the next line
                    out.append(text[i])
                    i += 1
            if text.startswith("=begin", i):
                end = re.compile(r"^=end\b[^\n]*", re.M).search(text, i)
                stop = end.end() if end else n
                out.append(_blank(text[i:stop]))
                i = stop
            elif re.compile(r"__END__[ \t]*(\n|$)").match(text, i):
                out.append(_blank(text[i:]))
                i = n
            continue
        if c == "#":
            end = text.find("\n", i)
            end = n if end < 0 else end
        elif c in "\"'`":
            end = skip(i + 1, c)
        elif c == "<" and (m := _HEREDOC.match(text, i)) and (m[1] or m[2] or m[3].isupper()) and (not _RB_VALUE_END.search(line) or m[1]) and not re.search(r"class\s*$", line):
            pending.append((re.escape(m[3]), bool(m[1])))
            end = m.end()
        elif c == "%" and (m := _RB_PERCENT.match(text, i)) and (not _RB_VALUE_END.search(line) or _RB_BEFORE_VALUE.search(line) or (text[i + 1 : i + 2].isalpha() and text[i - 1 : i] == " ")):
            end = skip(m.end(), _PAIRS.get(m[1], m[1]), m[1] if m[1] in _PAIRS else "")
        elif c == "/" and (not _RB_VALUE_END.search(line) or _RB_BEFORE_VALUE.search(line) or (text[i - 1 : i] == " " and text[i + 1 : i + 2] not in (" ", "="))) and (m := re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\[])*/[a-z]*").match(text, i)):
            end = m.end()
        elif c == "?" and not _RB_VALUE_END.search(line) and re.compile(r"\?[^\s\w](?!\w)").match(text, i):
            end = i + 2
        else:
            out.append(c)
            i += 1
            continue
        # a quote mark stays where text was, so that it still ends a value
        out.append(_blank(text[i:end]) if c == "#" else '"' + _blank(text[i + 1 : end]))
        i = end
    return "".join(out)[:n]


_RB_TOKEN = re.compile(r"(?<![\w@$.:])(?:(def|class|module|if|unless|while|until|case|begin|for|do|end)\b(?![?!:=]|\s*=>)|do\b)|\n|;")
_RB_DEF = re.compile(r"def\s+((?:self\s*\.\s*|[A-Z]\w*\s*\.\s*)?)([A-Za-z_]\w*[?!=]?|[^\w\s(]{1,3})")
_RB_NAME = re.compile(r"(?:class|module)\s+((?:::)?[A-Z][\w:]*)")
_RB_STATEMENT = re.compile(r"(?:^|[=(\[,{|&!:?;<>+*/-]|\b(?:then|do|else|begin|and|or|not|when|in|ensure|elsif|unless|if|while|until))\s*$")


def ruby_definitions(text: str) -> list[Definition]:
    """The methods, classes and modules that stand outside all others, up to their ends."""
    code, out = ruby_code(text), []
    depth, open_ = 0, None  # the definition that is open at depth 0
    loops: list[bool] = []  # for each line's loops: whether a do belongs to one
    line_start, loop_here = 0, False
    for m in _RB_TOKEN.finditer(code):
        token = m[1] or m[0]
        if token in ("\n", ";"):
            if token == "\n":
                line_start = m.end()
            loop_here = False
            continue
        before = code[line_start : m.start()].rsplit(";", 1)[-1]
        if token == "end":
            if depth:
                depth -= 1
                if depth == 0 and open_:
                    out.append(Definition(*open_, m.end()))
                    open_ = None
            continue
        if token == "do":
            if loop_here:
                loop_here = False
                continue
        elif token in ("if", "unless", "while", "until"):
            if not _RB_STATEMENT.search(before):
                continue  # a modifier
            loop_here = token in ("while", "until")
        elif token == "for":
            loop_here = True
        elif token == "def":
            found = _RB_DEF.match(code, m.start())
            stop = code.find("\n", found.end()) if found else -1
            rest = code[found.end() : stop if stop >= 0 else len(code)] if found else ""
            if found and re.match(r"\s*(\([^)]*\))?\s*=(?![=~>])", rest) and not found[2].endswith("="):  # an endless method
                if depth == 0:
                    stop = code.find("\n", m.start())
                    out.append(Definition("def", found[2], m.start(), len(code) if stop < 0 else stop))
                continue
            if depth == 0:
                open_ = ("def", found[2] if found else "anonymous", m.start())
        elif token in ("class", "module") and depth == 0:
            found = _RB_NAME.match(code, m.start())
            open_ = (token, found[1], m.start()) if found else None
        depth += 1
    if open_:  # never closed: up to the end of the text
        out.append(Definition(*open_, len(code)))
    return out
