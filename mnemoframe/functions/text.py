"""Text expressions shared by operators: JVM-side columns, no Python in tasks."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks that occur in the supported languages, and their plain forms.
_MARKED, _PLAIN = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"

#: Signs of a term, one by one: Java looks single signs up in a table, ranges by a call each.
SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789ß"


def ascii_borders(pattern: str) -> str:
    r"""``pattern`` with ``\b`` as a border of ASCII word characters, whatever the engine's Unicode rules."""
    return pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def folded(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), _MARKED, _PLAIN)


def terms(text: Column) -> Column:
    """Search terms in order: folded runs of letters and digits."""
    return F.array_remove(F.split(folded(text), f"[^{SIGNS}]+"), "")


def first_terms(text: Column, n: int, head: int = 400) -> Column:
    """The first ``n`` search terms; a text is only split beyond its first ``head`` characters if these don't hold more terms."""
    own = terms(F.substring(text, 1, head))
    return F.slice(F.when((F.size(own) > n) | (F.length(text) <= head), own).otherwise(terms(text)), 1, n)


def trimmed(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def token_estimate(text: Column) -> Column:
    """Tokens of a text, at four characters each."""
    return F.floor(F.length(text) / 4)


#: One sign of a pattern, a class, the head of a group or a counted repetition.
_PIECE = re.compile(r"\\.|\[(?:\\.|[^\\\]])*\]|\(\?(?::|=|!|<=|<!)|\{\d+(?:,\d*)?\}|.", re.S)


def _parsed(tokens: list[str]) -> list[list[tuple]]:
    """A pattern's alternatives up to the end of its group: lists of ``(source, sign or inner alternatives or None, repetition)``."""
    found = [[]]
    while tokens and (token := tokens.pop(0)) != ")":
        if token == "|":
            found.append([])
            continue
        source, holds = token, None
        if token.startswith("("):
            inner = _parsed(tokens)
            source, holds = f"{token}{'|'.join(map(_source, inner))})", inner if token == "(?:" else None
        elif len(token) == 1 and token not in ".^$" or len(token) == 2 and not token[1].isalnum():
            holds = token[-1]
        repeated = ""
        while tokens and (tokens[0] in ("?", "*", "+") or re.fullmatch(r"\{\d.*\}", tokens[0])):
            repeated += tokens.pop(0)
        found[-1].append((source, holds, repeated))
    return found


def _source(parts: list[tuple]) -> str:
    return "".join(source + repeated for source, _, repeated in parts)


def _alternatives(all_parts: list[list[tuple]]) -> list[list[tuple]]:
    """The alternatives with their groups written out, as far as nothing before a group can match in two ways: so their order stays."""
    found = []
    for parts in all_parts:
        at = next((k for k, (_, holds, repeated) in enumerate(parts) if repeated or isinstance(holds, list)), None)
        if at is None or parts[at][2] or any(source.startswith("(") for source, _, _ in parts[:at]):
            found.append(parts)
        else:
            found += _alternatives([parts[:at] + inner + parts[at + 1 :] for inner in parts[at][1]])
    return found


def _needed(parts: list[tuple]) -> tuple[str, ...]:
    """Lower-case strings of which a text must hold one to match; none if that can't be told."""
    options, run = [], ""
    for _, holds, repeated in [*parts, ("", None, "")]:
        if isinstance(holds, str) and not repeated and (holds.isascii() or holds.lower() == holds):
            run += holds.lower()
            continue
        options.append([run])
        run = ""
        if isinstance(holds, list) and repeated in ("", "+"):
            inner = [_needed(x) for x in holds]
            options.append([word for words in inner for word in words] if all(inner) else [""])
    options = [o for o in options if all(o)]
    return tuple(dict.fromkeys(max(options, key=lambda o: (min(map(len, o)) > 2, -len(o), min(map(len, o)))))) if options else ()


def _borders(parts: list[tuple]) -> str:
    r"""The alternative with each ``\b`` as a look to one side, where its neighbour is a word character."""
    word = lambda part: isinstance(part[1], str) and not part[2] and part[1].isascii() and (part[1].isalnum() or part[1] == "_")
    out = ""
    for k, part in enumerate(parts):
        if part[:1] != (r"\b",):
            out += ascii_borders(_source([part]))
        elif k + 1 < len(parts) and word(parts[k + 1]):
            out += "(?<![A-Za-z0-9_])"
        else:
            out += "(?![A-Za-z0-9_])" if k and word(parts[k - 1]) else ascii_borders(r"\b")
    return out


def alternatives(pattern: str) -> tuple[str, list[tuple[tuple[str, ...], str]]]:
    """A pattern's flags, and its alternatives in order, each with lower-case strings of which a text must hold one (or none).

    Any of the alternatives matches where the pattern does; so do those joined
    by ``|`` whose strings a text holds, and with the same matches.
    """
    flags = re.match(r"(?:\(\?[a-z]+\))?", pattern).group()
    parsed = _alternatives(_parsed(_PIECE.findall(pattern[len(flags) :])))
    return flags, [(_needed(parts), _borders(parts)) for parts in parsed]


def matches(text: Column, pattern: str, lower: Column) -> Column:
    """Whether a text, ``lower`` in lower case, matches: an alternative is only tried if the text holds a string that it needs."""
    flags, listed = alternatives(pattern)
    by_words: dict[tuple[str, ...], list[str]] = {}
    for words, piece in listed:
        by_words.setdefault(words, []).append(piece)
    found = None
    for words, pieces in by_words.items():
        one = text.rlike(flags + "|".join(pieces))
        one = occurs(lower, words) & one if words else one
        found = one if found is None else found | one
    return found


def match_count(text: Column, pattern: str, lower: Column) -> Column:
    """How many matches a text has, as many as of the whole pattern; only alternatives whose strings it holds are searched for."""
    flags, listed = alternatives(pattern)
    held = F.concat_ws("|", *(F.when(occurs(lower, words), piece) if words else F.lit(piece) for words, piece in listed))
    return F.when(held == "", 0).otherwise(F.regexp_count(text, F.concat(F.lit(flags), held)))


def first_match(text: Column, rules: list[tuple[str, str]], default: str, lower: Column | None = None) -> Column:
    """The label of the first rule whose pattern a text matches.

    The strings that a rule's alternatives need are looked for first, in
    ``lower``, the text in lower case, so that patterns are only tried on the
    few texts that can match.
    """
    lower = F.lower(text) if lower is None else lower
    label = None
    for name, pattern in rules:
        found = matches(text, pattern, lower)
        label = F.when(found, name) if label is None else label.when(found, name)
    return label.otherwise(default)


def occurs(text: Column, words: list[str]) -> Column:
    """Whether any of the words occurs as a substring."""
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found
