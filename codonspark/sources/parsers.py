"""Small parsers of one file's text, run in tasks, a file a row."""

from __future__ import annotations

import re
from collections.abc import Iterator

_GROUP = re.compile(r"\([^()]*\)|\{[^{}]*\}")


def _clean(residues: str) -> str:
    """Residues without white space, an ambiguity group as one missing."""
    return re.sub(r"\s+", "", _GROUP.sub("?", residues))


def phylip(text: str) -> Iterator[tuple[str, str]]:
    """(taxon, sequence) of sequential Phylip: names, then residues up to the declared length, over any lines."""
    head, *lines = [x for x in text.splitlines() if x.strip()]
    ntaxa, nsite = map(int, head.split()[:2])
    at = 0
    for _ in range(ntaxa):
        if at >= len(lines):
            raise ValueError("fewer taxa than declared")
        name, *rest = lines[at].split(None, 1)
        seq, at = _clean(rest[0]) if rest else "", at + 1
        while len(seq) < nsite:
            if at >= len(lines):
                raise ValueError(f"sequence of {name} is shorter than declared")
            seq, at = seq + _clean(lines[at]), at + 1
        if len(seq) != nsite:
            raise ValueError(f"sequence of {name} has {len(seq)} sites, {nsite} are declared")
        yield name, seq
    if at != len(lines):
        raise ValueError("more lines than declared")


def phylip_interleaved(text: str) -> Iterator[tuple[str, str]]:
    """(taxon, sequence) of interleaved Phylip, names in the first block or in all; blocks of unequal widths are an error."""
    head, *lines = [x for x in text.splitlines() if x.strip()]
    ntaxa, nsite = map(int, head.split()[:2])
    if len(lines) % ntaxa:
        raise ValueError("a block lacks taxa")
    names = [x.split()[0] for x in lines[:ntaxa]]
    seqs = [""] * ntaxa
    for start in range(0, len(lines), ntaxa):
        block = lines[start : start + ntaxa]
        named = all(x.split()[0] == n for x, n in zip(block, names, strict=True))
        parts = [_clean(x.split(None, 1)[1] if named and len(x.split(None, 1)) > 1 else "" if named else x) for x in block]
        if len({len(p) for p in parts}) != 1:
            raise ValueError("a block has unequal widths")
        seqs = [s + p for s, p in zip(seqs, parts, strict=True)]
    if len(seqs[0]) != nsite:
        raise ValueError(f"sequences have {len(seqs[0])} sites, {nsite} are declared")
    yield from zip(names, seqs, strict=True)


def any_phylip(text: str) -> Iterator[tuple[str, str]]:
    try:
        return iter(list(phylip(text)))
    except ValueError:
        return iter(list(phylip_interleaved(text)))


def nexus(text: str) -> Iterator[tuple[str, str]]:
    """(taxon, sequence) of the matrix of a Nexus file, interleaved or not."""
    text = re.sub(r"\[[^\]]*\]", "", text)
    nsite = int(re.search(r"(?i)nchar\s*=\s*(\d+)", text)[1])
    body = re.search(r"(?is)\bmatrix\b(.*?);", text)
    if not body:
        raise ValueError("no matrix")
    seqs: dict[str, str] = {}
    for line in body[1].splitlines():
        if line.strip():
            name, *rest = line.split(None, 1)
            seqs[name.strip("'\"")] = seqs.get(name.strip("'\""), "") + _clean(rest[0] if rest else "")
    if any(len(s) != nsite for s in seqs.values()):
        raise ValueError("a sequence differs from the declared length")
    yield from seqs.items()


def special(text: str) -> Iterator[tuple[str, str]]:
    """(taxon, sequence) under a header `#SPECIALALPHABET ntaxa nsite ALPHABET`; ? - * X x and symbols outside the alphabet are missing or an error."""
    head, _, rest = text.partition("\n")
    mark, ntaxa, nsite, letters = head.split()[:4]
    if mark != "#SPECIALALPHABET":
        raise ValueError("not a file of a special alphabet")
    for name, seq in phylip(f"{ntaxa} {nsite}\n{rest}"):
        if re.search(f"[^{re.escape(letters)}?*Xx-]", seq):
            raise ValueError(f"a symbol of {name} is not in the alphabet")
        yield name, re.sub("[?*Xx-]", "-", seq)


def catalog(text: str) -> Iterator[tuple[str, str, str]]:
    """(gene, taxon, sequence) of an ALI file: N, then for each gene its name and a sequential Phylip block."""
    lines = [x for x in text.splitlines() if x.strip()]
    if lines[0].strip() != "ALI":
        raise ValueError("not an ALI file")
    at = 2
    for _ in range(int(lines[1])):
        gene, start = lines[at].strip(), at + 1
        ntaxa, nsite = map(int, lines[start].split()[:2])
        end, found = start + 1, 0
        while found < ntaxa:
            rest = lines[end].split(None, 1)
            size, end = len(_clean(rest[1])) if len(rest) > 1 else 0, end + 1
            while size < nsite:
                size, end = size + len(_clean(lines[end])), end + 1
            found += 1
        for taxon, seq in phylip("\n".join(lines[start:end])):
            yield gene, taxon, seq
        at = end


def newick(text: str) -> Iterator[tuple[int, int | None, int, str, str, float | None, bool, int]]:
    """(node_id, parent_id, child_rank, name, branch_value, branch_length, is_leaf, depth) of a tree, depth first, without recursion."""
    nodes: list[list] = []
    stack: list[int] = []
    parent: int | None = None
    ranks: dict[int | None, int] = {}

    def add() -> int:
        nodes.append([len(nodes), parent, ranks.get(parent, 0), "", "", None, True, len(stack)])
        ranks[parent] = ranks.get(parent, 0) + 1
        return len(nodes) - 1

    current = None
    for token in re.findall(r"[(),;]|[^(),;]+", text.strip()):
        if token == "(":
            current = add()
            nodes[current][6] = False
            stack.append(current)
            parent, current = current, None
        elif token in ",)":
            if current is None:
                add()
            current = None
            if token == ")":
                if not stack:
                    raise ValueError("unbalanced tree")
                current = stack.pop()
                parent = stack[-1] if stack else None
        elif token == ";":
            break
        elif token.strip():
            if current is None:
                current = add()
            name, _, value = token.strip().partition(":")
            nodes[current][3], nodes[current][4] = name.strip(), value.strip()
            try:
                nodes[current][5] = float(value)
            except ValueError:
                pass
    if stack:
        raise ValueError("unbalanced tree")
    yield from map(tuple, nodes)


def write_newick(rows: list[dict], node_value: str | None = None, branch: str = "branch_value", value_only: bool = False) -> str:
    """Newick text of node rows: name (or name_value; value_only, the value alone at inner nodes) and what the branch bears; a root bears none."""
    children: dict[int | None, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["child_rank"], r["node_id"])):
        children.setdefault(r["parent_id"], []).append(r)
    done: dict[int, str] = {}
    for r in sorted(rows, key=lambda r: -r["depth"]):
        below = children.get(r["node_id"], [])
        value = "" if node_value is None or r[node_value] is None else str(r[node_value])
        label = value if value_only and below else "_".join(x for x in (r["name"], value) if x)
        length = "" if r["parent_id"] is None and branch != "branch_value" or r[branch] in (None, "") else f":{r[branch]}"
        done[r["node_id"]] = (f"({','.join(done[c['node_id']] for c in below)})" if below else "") + label + length
    return done[children[None][0]["node_id"]] + ";"
