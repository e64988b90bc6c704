"""Newick trees as tables of nodes."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s*([(),;]|'(?:[^']|'')*'|:\s*[-+0-9.eE]+|[^\s(),:;']+)")


def parse(text: str) -> list[tuple[int, int | None, str | None, float | None, bool]]:
    """(node, parent, name, branch length, is leaf), nodes numbered in the order in which they open; the root is 0 and has no parent."""
    parent: list[int | None] = [None]
    name: list[str | None] = [None]
    length: list[float | None] = [None]
    leaf = [True]
    at, depth, ended, pos = 0, 0, False, 0
    text = text.strip()

    def new(of: int) -> int:
        parent.append(of)
        name.append(None)
        length.append(None)
        leaf.append(True)
        leaf[of] = False
        return len(parent) - 1

    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m or ended:
            raise ValueError(f"not a Newick tree at {pos}")
        token, pos = m[1], m.end()
        if token == "(":
            depth += 1
            at = new(at)
        elif token == ",":
            if not depth:
                raise ValueError("a comma outside of brackets")
            at = new(parent[at])
        elif token == ")":
            depth -= 1
            if depth < 0:
                raise ValueError("a bracket too many")
            at = parent[at]
        elif token == ";":
            ended = True
        elif token[0] == ":":
            length[at] = float(token[1:])
        else:
            name[at] = token[1:-1].replace("''", "'") if token[0] == "'" else token
    if depth:
        raise ValueError("a bracket is open")
    return [(k, parent[k], name[k], length[k], leaf[k]) for k in range(len(parent))]


def write(nodes) -> str:
    """The tree of (node, parent, name, branch length, ...) rows, children in order of their numbers."""
    children: dict[int | None, list] = {}
    for n in sorted(nodes, key=lambda n: n[0]):
        children.setdefault(n[1], []).append(n)

    def label(n) -> str:
        text = "" if n[2] is None else n[2] if re.fullmatch(r"[^\s(),:;']+", n[2]) else "'" + n[2].replace("'", "''") + "'"
        return text + ("" if n[3] is None else f":{n[3]:g}")

    # from the last node to the first, so that deep trees need no recursion
    done: dict[int, str] = {}
    for n in sorted(nodes, key=lambda n: -n[0]):
        below = children.get(n[0])
        done[n[0]] = (f"({','.join(done[c[0]] for c in below)})" if below else "") + label(n)
    (root,) = children[None]
    return done[root[0]] + ";"
