"""Parsers that column expressions cannot hold: Arrow-batched, over whole listings or sources."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PARSED_FUNCTION

# --- names -----------------------------------------------------------------------

#: Builtin type codes of the Itanium C++ ABI
BUILTINS = {
    "v": "void", "w": "wchar_t", "b": "bool", "c": "char", "a": "signed char", "h": "unsigned char",
    "s": "short", "t": "unsigned short", "i": "int", "j": "unsigned int", "l": "long", "m": "unsigned long",
    "x": "long long", "y": "unsigned long long", "n": "__int128", "o": "unsigned __int128", "f": "float",
    "d": "double", "e": "long double", "g": "__float128", "z": "...",
}
#: Abbreviations of the same ABI
ABBREVIATIONS = {"St": "std", "Sa": "std::allocator", "Sb": "std::basic_string", "Ss": "std::string", "Si": "std::istream", "So": "std::ostream", "Sd": "std::iostream"}


#: Operator codes of the same ABI
OPERATORS = {
    "nw": "new", "na": "new[]", "dl": "delete", "da": "delete[]", "ng": "-", "ad": "&", "de": "*", "co": "~", "pl": "+", "mi": "-", "ml": "*", "dv": "/", "rm": "%",
    "an": "&", "or": "|", "eo": "^", "aS": "=", "pL": "+=", "mI": "-=", "mL": "*=", "dV": "/=", "rM": "%=", "aN": "&=", "oR": "|=", "eO": "^=", "ls": "<<", "rs": ">>",
    "lS": "<<=", "rS": ">>=", "eq": "==", "ne": "!=", "lt": "<", "gt": ">", "le": "<=", "ge": ">=", "ss": "<=>", "nt": "!", "aa": "&&", "oo": "||", "pp": "++", "mm": "--",
    "cm": ",", "pm": "->*", "pt": "->", "cl": "()", "ix": "[]",
}


class _Cursor:
    """Recursive descent over a mangled name: nested names, ctors and dtors, operators,
    templates, pointers, references, arrays, functions, qualifiers, substitutions.
    Anything else raises ValueError."""

    def __init__(self, text: str):
        self.text, self.at, self.subs = text, 0, []
        self.arguments: list[str] = []
        self.templated, self.qualifier = False, ""

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, prefix: str) -> bool:
        if self.text.startswith(prefix, self.at):
            self.at += len(prefix)
            return True
        return False

    def source_name(self) -> str:
        m = re.compile(r"\d+").match(self.text, self.at)
        if not m:
            raise ValueError("name expected")
        self.at = m.end() + int(m[0])
        name = self.text[m.end() : self.at]
        if len(name) != int(m[0]):
            raise ValueError("name cut short")
        return "(anonymous namespace)" if name.startswith("_GLOBAL__N") else name

    def substitution(self) -> str:
        if self.peek(2) in ABBREVIATIONS:
            self.at += 2
            return ABBREVIATIONS[self.text[self.at - 2 : self.at]]
        m = re.compile(r"S([0-9A-Z]*)_").match(self.text, self.at)
        if not m:
            raise ValueError("substitution expected")
        self.at = m.end()
        i = int(m[1], 36) + 1 if m[1] else 0
        if i >= len(self.subs):
            raise ValueError("unknown substitution")
        return self.subs[i]

    def nested(self) -> str:
        suffix = ""
        while self.peek() in ("K", "V", "r"):
            suffix = " const" if self.take("K") else suffix + ("" if not self.take("V") and not self.take("r") else " volatile")
        parts: list[str] = []
        while not self.take("E"):
            if self.peek() == "S":
                parts = [self.substitution()]
                continue
            if self.peek() == "L":
                self.at += 1
                continue
            if self.peek() in ("C", "D") and self.peek(2)[1:].isdigit() and parts:
                own = parts[-1].rsplit("::", 1)[-1]
                parts.append(own if self.peek() == "C" else "~" + own)
                self.at += 2
            elif self.peek() == "I" and parts:
                parts[-1] += self.template()
            else:
                parts.append(self.unqualified())
            if self.peek() != "E":
                self.subs.append("::".join(parts))
        if not parts:
            raise ValueError("empty nested name")
        self.qualifier = suffix
        return "::".join(parts)

    def name(self) -> str:
        self.qualifier = ""
        if self.take("N"):
            return self.nested()
        if self.peek() == "S" and self.peek(2) != "St":
            out = self.substitution()
        elif self.take("St"):
            out = "std::" + self.unqualified()
        else:
            self.take("L")
            out = self.unqualified()
        if self.peek() == "I":
            self.subs.append(out)
            out += self.template()
        return out

    def unqualified(self) -> str:
        """A source name or an operator's name."""
        if self.peek().isdigit():
            return self.source_name()
        code = self.peek(2)
        if code == "cv":
            self.at += 2
            return f"operator {self.type()}"
        if code in OPERATORS:
            self.at += 2
            sign = OPERATORS[code]
            return f"operator {sign}" if sign[0].isalpha() else f"operator{sign}"
        raise ValueError("name expected")

    def template(self) -> str:
        """I, arguments, E. The result type of a template function is left out by ``demangle``."""
        self.at += 1
        args = []
        while not self.take("E"):
            if self.take("J"):
                while not self.take("E"):
                    args.append(self.argument())
            else:
                args.append(self.argument())
        self.arguments = args
        self.templated = True
        return f"<{', '.join(args)}>" if not args or args[-1][-1:] != ">" else f"<{', '.join(args)} >"

    def argument(self) -> str:
        if not self.take("L"):
            return self.type()
        kind = self.type()
        m = re.compile(r"n?\d+").match(self.text, self.at)
        if not m or not self.text.startswith("E", m.end()):
            raise ValueError("literal expected")
        self.at = m.end() + 1
        value = m[0].replace("n", "-")
        suffixes = {"int": "", "unsigned int": "u", "long": "l", "unsigned long": "ul"}
        if kind == "bool":
            return "true" if value == "1" else "false"
        return value + suffixes[kind] if kind in suffixes else f"({kind}){value}"

    def parameter(self) -> str:
        """T_, T0_, ...: an argument of the last template."""
        m = re.compile(r"T([0-9A-Z]*)_").match(self.text, self.at)
        i = (int(m[1], 36) + 1 if m and m[1] else 0) if m else -1
        if not 0 <= i < len(self.arguments):
            raise ValueError("unknown template parameter")
        self.at = m.end()
        return self.arguments[i]

    def function(self) -> tuple[str, str]:
        """F, result, parameters, E as (result, parameters)."""
        self.at += 1
        result, args = self.type(), []
        while not self.take("E"):
            args.append(self.type())
        return result, "" if args == ["void"] else ", ".join(args)

    def type(self) -> str:
        for code, mark in (("P", "*"), ("R", "&"), ("O", "&&")):
            if self.take(code):
                if self.peek() == "F":
                    result, args = self.function()
                    self.subs.append(f"{result} ({args})")
                    out = f"{result} ({mark})({args})"
                elif self.peek() == "A":
                    size, item = self.array()
                    self.subs.append(f"{item} [{size}]")
                    out = f"{item} ({mark}) [{size}]"
                else:
                    out = self.type() + mark
                self.subs.append(out)
                return out
        if self.peek() == "T":
            out = self.parameter()
            self.subs.append(out)
            return out
        if self.peek() == "A":
            size, item = self.array()
            out = f"{item} [{size}]"
            self.subs.append(out)
            return out
        if self.take("K"):
            out = self.type() + " const"
            self.subs.append(out)
            return out
        if self.peek() in BUILTINS:
            self.at += 1
            return BUILTINS[self.text[self.at - 1]]
        if self.peek() == "S" and self.peek(2) != "St":
            out = self.substitution()
            if self.peek() != "I":
                return out
            out += self.template()
        else:
            out = self.name()
        self.subs.append(out)
        return out

    def array(self) -> tuple[str, str]:
        m = re.compile(r"A(\d+)_").match(self.text, self.at)
        if not m:
            raise ValueError("array size expected")
        self.at = m.end()
        return m[1], self.type()


def demangle(name: str | None) -> str | None:
    """The readable form of an Itanium-mangled name of the subset above, else the name itself."""
    if name is None or not name.startswith(("_Z", "__Z")):
        return name
    c = _Cursor(name[name.index("Z") + 1 :])
    try:
        out = c.name()
        qualifier, args = c.qualifier, []
        result = ""
        own = out.rsplit("::", 1)[-1]
        if out.endswith(">") and c.at < len(c.text) and not own.startswith(("~", "operator ")):
            # template functions carry their result type, except constructors and the like
            result = c.type() + " "
        while c.at < len(c.text):
            args.append(c.type())
    except (ValueError, IndexError):
        return name
    if not args:
        return out
    return f"{result}{out}({'' if args == ['void'] else ', '.join(args)}){qualifier}"


def plain_name(name: str | None) -> str | None:
    """The last word of a demangled signature, parameters (from the first parenthesis to a closing one at the end) left out."""
    if name is None:
        return None
    signature = name.partition("(")[0] if name.endswith(")") else name
    return next(reversed(signature.split()), signature.strip())


# --- listings and sources ----------------------------------------------------------


#: a function's first line in a listing: its address in hex, a space, its name in angle brackets, a colon
LISTING_HEAD = r"^\s*([0-9a-fA-F]+) <(.+)>:\s*$"


def listing_functions(text: Column) -> Column:
    """Functions of a disassembly listing in one text: a first line as above, then the body up to the next one.

    A null text has none. Bodies end without white space. For listings too long for a row
    there is ``sources.files.functions_of_lines``.
    """
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    firsts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.element_at(lines, i).rlike(LISTING_HEAD))
    # lines and firsts are elements of an array, so they are computed once and not for each function
    return F.element_at(F.transform(F.array(F.struct(lines.alias("l"), firsts.alias("f"))), _functions), 1)


def _functions(x: Column) -> Column:
    def function(at: Column, k: Column) -> Column:
        first = F.element_at(x.l, at)
        name = F.regexp_extract(first, LISTING_HEAD, 2)
        end = F.coalesce(F.get(x.f, k + 1), F.size(x.l) + 1)
        body = F.regexp_replace(F.array_join(F.slice(x.l, at + 1, end - at - 1), "\n"), r"\s+$", "")
        return F.struct((k + 1).alias("function_id"), name.alias("name"), F.regexp_extract(first, LISTING_HEAD, 1).alias("start_addr"), name.alias("signature"), body.alias("body"))

    return F.transform(x.f, function)


_LITERALS = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|^[ \t]*\#(?:\\\n|[^\n])*""", re.S | re.M)
_DECLARATOR = re.compile(r"((?:[A-Za-z_]\w*(?:<[^<>]*>)?::)*(?:~?[A-Za-z_]\w*|operator\s*(?:[^\s\w(]+|\(\)|\w+)))\s*\(")
_NO_FUNCTION = frozenset(("if", "for", "while", "switch", "return", "sizeof", "catch", "do", "else", "struct", "class", "union", "enum", "namespace", "extern", "typedef"))


def _blank(m: re.Match) -> str:
    return "".join(c if c == "\n" else " " for c in m[0])


def scan_functions(text: str | None) -> list[dict]:
    """Function definitions of C or C++ source, in order: comments, literals and preprocessor
    lines are blanked, then braces are matched; a block whose head ends in a parameter list
    is a function, a namespace, class or linkage block is searched inside."""
    source = text or ""
    clean = _LITERALS.sub(_blank, source)
    out: list[dict] = []
    head = i = 0
    while i < len(clean):
        c = clean[i]
        if c in ";}":
            head = i + 1
        elif c == "{":
            start = head + len(clean[head:i]) - len(clean[head:i].lstrip())
            title = clean[start:i].strip()
            m = next((x for x in _DECLARATOR.finditer(title) if x[1].split("::")[-1] not in _NO_FUNCTION), None)
            container = re.match(r"(?:inline\s+)?(namespace|class|struct|union|extern\s*|enum)\b", title)
            if m and not (container and not title.endswith(")")) and "=" not in title[: m.start()]:
                depth, j = 1, i + 1
                while j < len(clean) and depth:
                    depth += (clean[j] == "{") - (clean[j] == "}")
                    j += 1
                if depth:
                    break
                out.append({
                    "function_id": len(out) + 1, "name": re.sub(r"\s+", "", m[1]) if "operator" not in m[1] else re.sub(r"\s+", " ", m[1]).strip(),
                    "start_addr": None, "signature": source[start:i].strip(), "body": source[i + 1 : j - 1].strip(),
                })
                i = j - 1
            elif not container or title.startswith("enum"):
                depth, j = 1, i + 1
                while j < len(clean) and depth:
                    depth += (clean[j] == "{") - (clean[j] == "}")
                    j += 1
                i = j - 1
            head = i + 1
        i += 1
    return out


# --- simhash -----------------------------------------------------------------------

_CONTENT = re.compile(r"[\w一-鿌]+")


def simhash(text: str | None, width: int = 4) -> int | None:
    """Unsigned 64-bit simhash: lower-cased word characters joined, shingles of ``width``
    characters weighted by count, low 64 bits of md5, majority by bit."""
    if text is None:
        return None
    content = "".join(_CONTENT.findall(text.lower()))
    grams = Counter(content[i : i + width] for i in range(max(len(content) - width + 1, 1)))
    digests = np.frombuffer(b"".join(hashlib.md5(g.encode()).digest()[-8:] for g in grams), np.uint8).reshape(-1, 8)
    counts = np.fromiter(grams.values(), np.int64, len(grams))
    ones = counts @ np.unpackbits(digests, axis=1)
    return int.from_bytes(np.packbits(2 * ones > counts.sum()).tobytes(), "big")


# Series functions; the UDFs are made where a session is at hand, as workers import this module too


def _demangle(s: pd.Series) -> pd.Series:
    return s.map(demangle, na_action="ignore")


def _plain_name(s: pd.Series) -> pd.Series:
    return s.map(plain_name, na_action="ignore")


def _source(s: pd.Series) -> pd.Series:
    return s.map(scan_functions)


def _simhash(s: pd.Series) -> pd.Series:
    """As ``simhash``, text by text, but each distinct shingle of a group of texts is hashed once.

    A shingle is a number: four places in the group's alphabet, 16 bits each.
    """
    out: list[int | None] = []
    for at in range(0, len(s), 256):
        texts = [None if t is None or t is pd.NA or t != t else t for t in s.iloc[at : at + 256]]
        contents = ["".join(_CONTENT.findall(t.lower())) if t is not None else "" for t in texts]
        alphabet, places = np.unique(np.frombuffer("".join(contents).encode("utf-32-le"), "<u4"), return_inverse=True)
        if len(alphabet) > 1 << 16:
            out += [None if t is None else _signed64(simhash(t)) for t in texts]
            continue
        place, ends = places.astype(np.uint64), np.cumsum([len(c) for c in contents])
        # shingles across the end of a text are made too, and left out below
        keys = place[:-3] << 48 | place[1:-2] << 32 | place[2:-1] << 16 | place[3:] if len(place) > 3 else place[:0]
        distinct, number = np.unique(keys, return_inverse=True)
        spelled = alphabet[(distinct[:, None] >> np.array([48, 32, 16, 0], np.uint64) & np.uint64(0xFFFF)).astype(np.int64)].astype("<u4").tobytes().decode("utf-32-le")
        digests = b"".join(hashlib.md5(spelled[i : i + 4].encode()).digest()[-8:] for i in range(0, len(spelled), 4))
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        for text, content, end in zip(texts, contents, ends.tolist(), strict=True):
            if text is None:
                out.append(None)
            elif len(content) < 4:
                out.append(_signed64(simhash(content)))
            else:
                counts = np.bincount(number[end - len(content) : end - 3])
                some = np.flatnonzero(counts)
                ones = counts[some].astype(float) @ bits[some].astype(float)
                out.append(int(np.packbits(2 * ones > len(content) - 3).view(">i8")[0]))
    return pd.Series(out, index=s.index, dtype="Int64")


def _signed64(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def demangled(name: Column) -> Column:
    return F.pandas_udf(_demangle, "string")(name)


def function_name(name: Column) -> Column:
    return F.pandas_udf(_plain_name, "string")(name)


def readable_name(name: Column) -> Column:
    """Only mangled names are rewritten."""
    return F.when(name.rlike(r"^(_Z|__Z|\?)"), function_name(demangled(name))).otherwise(name)


def source_functions(text: Column) -> Column:
    return F.pandas_udf(_source, PARSED_FUNCTION)(text)


def simhash64(text: Column) -> Column:
    """The signed bit pattern; functions.text.unsigned shows the number."""
    return F.pandas_udf(_simhash, "long")(text)
