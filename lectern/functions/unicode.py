"""Unicode and markup helpers that need Python's tables: vectorised over Arrow batches, null in and null out."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import types as ty
from pyspark.sql.functions import pandas_udf


def _each(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run


def reorder(text: str) -> str:
    """Display order back to reading order: every right-to-left run is reversed, a neutral stays in the run it follows."""
    kinds = [unicodedata.bidirectional(c) for c in text]
    if not any(k in ("R", "AL", "RLE", "RLO", "RLI") for k in kinds):
        return text
    runs: list[tuple[bool, list[str]]] = []
    for c, k in zip(text, kinds, strict=True):
        strong = True if k in ("R", "AL", "RLE", "RLO", "RLI") else False if k in ("L", "EN", "AN") else None
        side = strong if strong is not None else runs[-1][0] if runs else True
        if runs and runs[-1][0] == side:
            runs[-1][1].append(c)
        else:
            runs.append((side, [c]))
    return "".join("".join(reversed(cs) if side else cs) for side, cs in runs)


def folded_words(text: str) -> str:
    """Words without case and combining marks, space-joined."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    return " ".join(re.findall(r"\w+", plain))


_TERM = re.compile(r"([A-Za-zαβγπθλμσ]+)(\d+)?|(\d+(?:\.\d+)?)|([+\-*×⋅])")


def simple_mathml(text: str) -> str | None:
    """MathML of a single relation of up to three plain terms, such as "E = mc2"; None for anything else."""
    bare = re.sub(r"\(\s*[0-9A-Za-z]+(?:\.[0-9]+)*\s*\)$", "", " ".join(text.split())).strip()
    sides = re.fullmatch(r"([A-Za-zαβγπθλμσ]{1,2})\s*([=≈≤≥<>])\s*(.+)", bare)
    if not sides or len(sides[3].split()) > 3:
        return None
    out = []
    for token in sides[3].split():
        m = _TERM.fullmatch(token)
        if not m:
            return None
        names, power, number, sign = m.groups()
        if names and power:
            out.append("".join(f"<mi>{c}</mi>" for c in names[:-1]) + f"<msup><mi>{names[-1]}</mi><mn>{power}</mn></msup>")
        elif names:
            out.append("".join(f"<mi>{c}</mi>" for c in names))
        else:
            out.append(f"<mn>{number}</mn>" if number else f"<mo>{sign}</mo>")
    return f'<math xmlns="http://www.w3.org/1998/Math/MathML" display="block"><mrow><mi>{sides[1]}</mi><mo>{html.escape(sides[2])}</mo>{"".join(out)}</mrow></math>'


def udfs() -> dict:
    """The helpers as vectorised functions of columns; made on demand, as they need a session."""
    text = ty.StringType()

    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    def typed(f):
        f.__annotations__ = {"s": pd.Series, "return": pd.Series}
        return pandas_udf(f, text)

    return {
        "nfc": typed(_each(lambda x: unicodedata.normalize("NFC", x))), "folded_words": typed(_each(folded_words)), "reorder": typed(_each(reorder)),
        "mathml": typed(_each(simple_mathml)), "similarity": pandas_udf(ratio, ty.DoubleType()),
    }
