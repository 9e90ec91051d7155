"""The query-string language: words, "phrases"~2, AND OR NOT + - ( ) ^boost, word~1, wil?card*, [a TO b}, field:word.

Words are joined by OR. What can't be parsed is sought as one term, letter for letter.
"""

from __future__ import annotations

import regex

from tessera.operators.fulltext import Bool, Fuzzy, Match, Pattern, Phrase, Spec, Term, Weighted

_TOKEN = regex.compile(
    r"""\s*(?:(?P<op>AND(?=\s|\(|$)|OR(?=\s|\(|$)|NOT(?=\s|\(|$)|&&|\|\||!)|(?P<mod>[+-])(?=\S)|(?P<open>\()|(?P<close>\))
    |(?P<all>\*:\*)|(?P<field>(?:\\.|[^\s+\-!(){}\[\]^"~*?:\\])+):|(?P<quote>"(?:\\.|[^"\\])*")(?:~(?P<slop>\d+))?
    |(?P<range>[\[{]\s*(?P<low>"[^"]*"|\S+)\s+TO\s+(?P<high>"[^"]*"|[^\s\]}]+)\s*[\]}])
    |(?P<word>(?:\\.|[^\s!(){}\[\]^"~:\\+\-])(?:\\.|[^\s!(){}\[\]^"~:\\])*)(?P<fuzzy>~(?P<edits>\d+(?:\.\d+)?)?)?)
    (?:\^(?P<boost>\d+(?:\.\d+)?))?""",
    regex.X,
)


class ParseError(ValueError):
    pass


def _plain(text: str) -> str:
    return regex.sub(r"\\(.)", r"\1", text)


class _Reader:
    def __init__(self, text: str, field: str, fields: dict[str, str]) -> None:
        self.fields, self.default = fields, field
        self.tokens, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise ParseError(f"unexpected {text[at:]!r}")
            self.tokens.append(m)
            at = m.end()
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def group(self, field: str, inner: bool) -> Spec:
        """Clauses up to the closing bracket; AND requires both its sides, unless they are prohibited."""
        clauses: list[list] = []  # occur, spec
        joined = None
        while (m := self.peek()) is not None:
            if m["close"]:
                break
            if m["op"] and m["op"] not in ("NOT", "!"):
                if not clauses or joined:
                    raise ParseError("an operator without a clause before it")
                joined = "AND" if m["op"] in ("AND", "&&") else "OR"
                self.at += 1
                continue
            occur = "should"
            if m["op"] or m["mod"]:
                occur = "must" if m["mod"] == "+" else "must_not"
                self.at += 1
            spec = self.clause(field)
            if joined == "AND":
                if clauses[-1][0] == "should":
                    clauses[-1][0] = "must"
                if occur == "should":
                    occur = "must"
            if spec is not None:
                clauses.append([occur, spec])
            joined = None
        if joined or (inner and self.peek() is None):
            raise ParseError("the query ends too early")
        if len(clauses) == 1 and clauses[0][0] != "must_not":
            return clauses[0][1]
        by = {k: tuple(s for o, s in clauses if o == k) for k in ("must", "should", "must_not")}
        if by["must_not"] and not by["must"] and not by["should"]:
            return Bool(must=(Match(field, ""),))  # prohibited clauses alone match nothing in this language
        return Bool(**by)

    def clause(self, field: str) -> Spec | None:
        m = self.peek()
        if m is None:
            raise ParseError("the query ends too early")
        self.at += 1
        if m["field"]:
            name = _plain(m["field"])
            if name not in self.fields:
                raise ParseError(f"no text field {name}")
            return self.clause(name)
        if m["open"]:
            spec = self.group(field, True)
            self.at += 1
            close = self.tokens[self.at - 1]
            return Weighted(spec, float(close["boost"])) if close["boost"] else spec
        if m["quote"]:
            spec: Spec = Phrase(field, _plain(m["quote"][1:-1]), int(m["slop"] or 0))
        elif m["range"]:
            low, high = (None if x == "*" else x.strip('"') for x in (m["low"], m["high"]))
            r = m["range"].strip()
            spec = Pattern(field, "range", (low, high, r[0] == "[", r[-1] == "]"))
        elif m["all"]:
            spec = Bool()
        elif m["word"]:
            spec = self.word(field, m)
        else:
            raise ParseError(f"unexpected {m[0]!r}")
        return Weighted(spec, float(m["boost"])) if m["boost"] else spec

    def word(self, field: str, m) -> Spec:
        raw, bare = m["word"], regex.sub(r"\\.", "", m["word"])
        if m["fuzzy"]:
            return Fuzzy(field, _plain(raw).lower(), min(2, int(float(m["edits"] or 2))))
        if raw == "*":
            return Pattern(field, "prefix", "")
        if regex.search(r"[*?]", bare):
            low = raw.lower()
            return Pattern(field, "prefix", _plain(low[:-1])) if bare.count("*") == 1 and "?" not in bare and bare.endswith("*") else Pattern(field, "wildcard", low)
        return Match(field, _plain(raw))


def parse(text: str, field: str, fields: dict[str, str]) -> Spec:
    """The spec of a query string; fields: the analyzer of each text field."""
    try:
        reader = _Reader(text, field, fields)
        spec = reader.group(field, False)
        if reader.peek() is not None:
            raise ParseError("a bracket closes that was never opened")
        return spec
    except ParseError:
        return Term(field, text)
