"""Index descriptions as text: `PCA32,IVF256,PQ8x4` and the like, parsed to a Spec and spelt again.

Order: id map, refinement, leading transforms, then one of: a graph (of vectors or of codes), a row-scaled codec, inverted
lists with a code, a plain code. Whole tokens must match; anything else is an error that names the token, as is a token
that would not do here what it says (quantized norms, two-layer codes of several levels). Ids are always kept, so an id
map adds nothing but the name. Binary descriptions (BFlat, BIVF, BHNSW, BHash) have a parser of their own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Step:
    """A named part with integer or text arguments; None where the text leaves one out."""

    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Spec:
    code: Step
    transforms: tuple[Step, ...] = ()
    coarse: Step | None = None
    refine: str | None = None
    ids: int = 0
    scaled: str = ""
    graph: Step | None = None


_TRANSFORMS = {
    "PCA": r"PCA(W?)(R?)(\d+)", "L2norm": r"L2[nN]orm", "RR": r"RR(\d+)?", "HR": r"HR(\d+)?", "ITQ": r"ITQ(\d+)?", "OPQ": r"OPQ(\d+)(?:_(\d+))?", "Pad": r"Pad(\d+)",
}
_COARSE = {"IVF": r"IVF(\d+[kM]?)(?:_(HNSW|NSG)(\d*))?", "IMI": r"IMI2x(\d+)", "Residual": r"Residual(\d+)"}
_CODES = {
    "Flat": r"(?:Flat|FlatL2Panorama\d+(?:_\d+)?|FlatIPPanorama\d+(?:_\d+)?|FlatPanorama\d*)", "FlatDedup": r"FlatDedup", "SQ": r"SQ(4|6|8|fp16|bf16|8_direct_signed|8_direct)",
    "PQR": r"PQ(\d+)\+(\d+)", "PQ": r"PQ(\d+)(?:x(\d+))?(np|fsr?|fs_\d+|fsr_\d+)?", "RQ": r"RQ(\d+)x(\d+)(_Nnone|_Nfloat)?", "LSQ": r"LSQ(\d+)x(\d+)(_Nnone|_Nfloat)?",
    "PRQ": r"PRQ(\d+)x(\d+)x(\d+)(_Nnone|_Nfloat)?", "PLSQ": r"PLSQ(\d+)x(\d+)x(\d+)(_Nnone|_Nfloat)?", "LSH": r"LSH(\d+)?(r?)(t?)", "Zn": r"ZnLattice(\d+)x(\d+)_(\d+)",
    "RaBitQ": r"RaBitQ(?:fs)?([1-9])?", "SH": r"SH([\d.]+)?([gcm]?)", "HNSW": r"HNSW(\d*)", "NSG": r"NSG(\d*)",
}
#: What an argument left out stands for.
_DEFAULTS = {"HR": (12345,), "HNSW": (32,), "NSG": (32,), "RaBitQ": (1,), "PQ": (None, 8), "OPQ": (None, None), "SH": ("0", "g")}  # SH without a period: plain thresholds


def _number(text: str) -> int | str:
    if re.fullmatch(r"\d+[kM]", text):
        return int(text[:-1]) * {"k": 1024, "M": 1024 * 1024}[text[-1]]
    return int(text) if text.isdigit() else text


def _match(token: str, table: dict[str, str]) -> Step | None:
    for name, pattern in table.items():
        if m := re.fullmatch(pattern, token):
            args = [_number(g) if g else None for g in m.groups()]
            for i, d in enumerate(_DEFAULTS.get(name, ())):
                if i < len(args) and args[i] is None:
                    args[i] = d
            return Step(name, tuple(args))
    return None


def _tokens(text: str) -> list[str]:
    """Cut at commas outside parentheses."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    if depth:
        raise ValueError("unbalanced parentheses")
    return out


def parse(text: str) -> Spec:
    todo, ids, refine, steps, coarse, scaled, graph = _tokens(text), 0, None, [], None, "", None
    for end in (0, -1):
        if len(todo) > 1 and todo[end] in ("IDMap", "IDMap2"):
            ids = 2 if todo.pop(end) == "IDMap2" else 1
    if len(todo) > 1 and (m := re.fullmatch(r"RFlat|Refine\((.+)\)|RefinePanorama\((.+)\)", todo[-1])):
        refine = m[1] or m[2] or "Flat"
        todo.pop()
    while len(todo) > 1 and (step := _match(todo[0], _TRANSFORMS)):
        steps.append(step)
        todo.pop(0)
    if len(todo) > 1 and todo[0] in ("MinMax", "MinMaxFP16"):
        scaled = todo.pop(0)
    if len(todo) > 1 and (coarse := _match(todo[0], _COARSE)):
        todo.pop(0)
    if len(todo) == 1 and (m := re.fullmatch(r"((?:HNSW|NSG)\d*)_(.+)", todo[0])):
        todo = [m[1], m[2]]
    code = _match(todo[0], _CODES)
    if code is not None and code.name in ("HNSW", "NSG"):
        graph, code = code, Step("Flat")
        todo = todo[1:] or ["Flat"]
        code = _match(todo[0], _CODES)
        if code is not None and code.name not in ("Flat", "PQ", "SQ"):
            raise ValueError(f"no graph over {todo[0]!r}")
    if code is None or len(todo) > 1:
        raise ValueError(f"not an index description: {text!r}, at {todo[0] if code is None else todo[1]!r}")
    if coarse is not None and (graph is not None or code.name == "LSH"):
        raise ValueError(f"{(graph or code).name} holds no inverted lists")
    return Spec(code, tuple(steps), coarse, refine, ids, scaled, graph)


@dataclass(frozen=True)
class BinarySpec:
    """kind: Flat, IVF (nlist, and m of a graph over its centroids), HNSW (m), Hash (b, and how many hashes)."""

    kind: str
    args: tuple = ()


def parse_binary(text: str) -> BinarySpec:
    todo = [t for t in text.split(",") if t not in ("IDMap", "IDMap2")]
    found = {"Flat": r"BFlat", "IVF": r"BIVF(\d+)(?:_HNSW(\d+))?", "HNSW": r"BHNSW(\d+)", "Hash": r"BHash(?:(\d+)x)?(\d+)"}
    for kind, pattern in found.items():
        if len(todo) == 1 and (m := re.fullmatch(pattern, todo[0])):
            return BinarySpec(kind, tuple(int(g) if g else None for g in m.groups()))
    raise ValueError(f"not a binary index description: {text!r}")


def _spelt(s: Step) -> str:
    a = s.args
    text = {
        "PCA": lambda: f"PCA{a[0] or ''}{a[1] or ''}{a[2]}", "OPQ": lambda: f"OPQ{a[0]}" + (f"_{a[1]}" if a[1] else ""), "IMI": lambda: f"IMI2x{a[0]}", "PQR": lambda: f"PQ{a[0]}+{a[1]}",
        "IVF": lambda: f"IVF{a[0]}" + (f"_{a[1]}{a[2] or ''}" if a[1] else ""), "Zn": lambda: f"ZnLattice{a[0]}x{a[1]}_{a[2]}",
    }.get(s.name)
    if text:
        return text()
    if s.name in ("PQ", "RQ", "LSQ", "PRQ", "PLSQ"):
        return s.name + "x".join(map(str, a[:-1])) + (a[-1] or "")
    if s.name == "SH" and a[0] in (0, "0"):
        return "SH" + a[1]
    return s.name + "".join(str(x) for x in a if x is not None)


def spell(spec: Spec) -> str:
    """The text that parses to this Spec."""
    parts = [*(_spelt(t) for t in spec.transforms), *([spec.scaled] if spec.scaled else []), *([_spelt(spec.graph)] if spec.graph else []), *([_spelt(spec.coarse)] if spec.coarse else []), _spelt(spec.code)]
    if spec.refine:
        parts.append("RFlat" if spec.refine == "Flat" else f"Refine({spec.refine})")
    return ",".join((["IDMap2" if spec.ids == 2 else "IDMap"] if spec.ids else []) + parts)


def code_bytes(spec: Spec, d: int) -> int:
    """Bytes of one stored vector's code, without its id."""
    for t in spec.transforms:
        d = next((x for x in (t.args[2:] if t.name == "PCA" else t.args[1:] if t.name == "OPQ" else t.args if t.name in ("RR", "ITQ", "Pad") else ()) if x), d)
        d = 1 << (d - 1).bit_length() if t.name == "HR" else d
    c, a = spec.code.name, spec.code.args
    bits = {
        "Flat": lambda: 32 * d, "FlatDedup": lambda: 32 * d, "SQ": lambda: d * (16 if "16" in str(a[0]) else int(str(a[0])[0])),
        "PQ": lambda: a[0] * a[1], "PQR": lambda: 8 * (a[0] + a[1]), "RQ": lambda: a[0] * a[1], "LSQ": lambda: a[0] * a[1], "PRQ": lambda: a[0] * a[1] * a[2], "PLSQ": lambda: a[0] * a[1] * a[2],
        "LSH": lambda: a[0] or d, "RaBitQ": lambda: d * a[0] + 64, "SH": lambda: d, "Zn": lambda: a[0] * (a[2] + 64),
    }[c]()
    nbit = 0
    if spec.coarse and spec.coarse.name == "Residual":
        nbit = max(1, (spec.coarse.args[0] - 1).bit_length())
    return -(-bits // 8) + -(-nbit // 8)
