"""strptime formats as regular expressions and as Java date patterns."""

from __future__ import annotations

import re

from loamline.session import EngineError

#: strptime directive -> (regular expression, Java letters)
DIRECTIVES = {"Y": (r"\d{4}", "yyyy"), "m": (r"\d{2}", "MM"), "d": (r"\d{2}", "dd"), "H": (r"\d{2}", "HH"), "M": (r"\d{2}", "mm"), "S": (r"\d{2}", "ss"), "j": (r"\d{3}", "DDD"), "f": (r"\d{6}", "SSSSSS")}


def strptime_parts(fmt: str) -> tuple[str, str]:
    """A strptime format as regular expression and as Java date pattern (literal letters quoted)."""
    regex = java = ""
    for directive, literal in re.findall(r"%(.)|([^%]+)", fmt):
        if directive:
            if directive not in DIRECTIVES:
                raise EngineError(f"date directive %{directive} is not supported")
            regex, java = regex + DIRECTIVES[directive][0], java + DIRECTIVES[directive][1]
        else:
            regex, java = regex + re.escape(literal), java + re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", literal)
    return regex, java
