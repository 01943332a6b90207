"""Plain text that a regular expression cannot match without.

Testing for that text is far cheaper than running the expression, so rules look
for it first. The result over-approximates: no literal found means no gate.
"""

from __future__ import annotations

import re

try:
    from re import _constants as codes, _parser as parser
except ImportError:  # the standard library's parser moved or went away: run ungated
    parser = None

MIN_LENGTH = 3
# Characters that fold to an ASCII letter in caseless matching.
FOLDED_FROM, FOLDED_TO = "ſıİ\u212a", "siik"


def required_literals(pattern: str) -> list[str]:
    """Lower-case texts of which any match contains at least one; empty when none is certain."""
    if parser is None:
        return []
    try:
        tree = parser.parse(pattern, re.IGNORECASE)
    except re.error:
        return []
    return _best(list(tree))


def _best(nodes: list) -> list[str]:
    options, run = [], ""
    for op, arg in nodes:
        if op is codes.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if len(run) >= MIN_LENGTH:
            options.append([run])
        run = ""
        inner = []
        if op is codes.SUBPATTERN:
            inner = _best(list(arg[-1]))
        elif op is codes.ASSERT and arg[0] == 1:
            inner = _best(list(arg[1]))
        elif op is codes.MAX_REPEAT and arg[0] >= 1:
            inner = _best(list(arg[2]))
        elif op is codes.BRANCH:
            branches = [_best(list(b)) for b in arg[1]]
            inner = sorted({text for b in branches for text in b}) if all(branches) else []
        if inner:
            options.append(inner)
    if len(run) >= MIN_LENGTH:
        options.append([run])
    # The rarest-looking choice: fewest alternatives, then the longest shortest text.
    return min(options, key=lambda texts: (len(texts), -min(map(len, texts)))) if options else []
