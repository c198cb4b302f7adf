"""Regular expressions that read alike in Java, in RE2 and in the reviewed sources.

Patterns are written with ``\\s`` and ``.`` in their Unicode-aware meaning and
expanded here to explicit classes, since Java's own ``\\s`` is ASCII and its ``.``
has other line ends.  ``$`` is written ``\\z``.
"""

from __future__ import annotations

#: White space by the ECMAScript definition (fixed values).
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Line ends by the same definition (fixed values).
LINE_ENDS = r"\n\r\x{2028}\x{2029}"


def expand(pattern: str) -> str:
    out, k, inside = [], 0, False
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
            k += 2
        elif two == r"\S" and not inside:
            out.append(f"[^{SPACE}]")
            k += 2
        elif two[0] == "\\":
            out.append(two)
            k += 2
        else:
            c = pattern[k]
            if c == "[":
                inside = True
            elif c == "]":
                inside = False
            out.append(f"[^{LINE_ENDS}]" if c == "." and not inside else c)
            k += 1
    return "".join(out)
