"""Rules of .gitignore files as Columns over paths relative to the folder of the file."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def rule(line: str) -> tuple[str, bool] | None:
    """(pattern over a whole relative path, does it take the path back in), or None for an empty line or a comment."""
    line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n"))
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line
    line = line[1:] if line.startswith(("\\#", "\\!")) else line
    folder = line.endswith("/")
    body = line.rstrip("/")
    anchored = "/" in body
    body, out, i = body.lstrip("/"), "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if body[i:] == "**" and i and body[i - 1] == "/":
            out, i = out + ".+", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inside = body[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]", end
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 1
        else:
            out += re.escape(c)
        i += 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$", back


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether the last rule that holds for a path leaves it out. A path under a folder that is left out can't be taken back."""
    out, shut = F.lit(False), F.lit(False)
    for made in filter(None, map(rule, lines)):
        pattern, back = made
        hit = path.rlike(pattern)
        if back:
            out = out & ~hit
        else:
            out = out | hit
            inner = pattern.removesuffix("$").removesuffix("(?:/.*)?").removesuffix("/.*")
            shut = shut | path.rlike(inner + "/.+$")
    return out | shut
